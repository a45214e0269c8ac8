"""Scoring, rates, sliced reports and comparison of runs, corpora and graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.numbers import ratio6
from weftline.session import written

# The closed set of statuses.
STATUSES = ("SUCCESS", "EMPTY_RESULT", "SYNTAX_ERROR", "EXECUTION_ERROR", "UNSUPPORTED")


def count_items(records: DataFrame, gold: DataFrame, predicted: DataFrame, key: str = "record_id") -> DataFrame:
    """Add n_gold, n_predicted and n_common from item tables (key, item).

    Items meet on (key, item), so a record that owns a third of all items is spread out;
    only three counts per record are left for the last join.
    """
    marked = gold.select(key, "item", F.lit(1).alias("_g"), F.lit(0).alias("_p")).unionByName(
        predicted.select(key, "item", F.lit(0).alias("_g"), F.lit(1).alias("_p"))
    )
    items = marked.groupBy(key, "item").agg(F.max("_g").alias("_g"), F.max("_p").alias("_p"))
    counts = items.groupBy(key).agg(
        F.sum("_g").alias("n_gold"), F.sum("_p").alias("n_predicted"), F.sum(F.col("_g") * F.col("_p")).alias("n_common")
    )
    zero = F.lit(0).cast("bigint")
    joined = records.join(counts, key, "left")
    for name in ("n_gold", "n_predicted", "n_common"):
        joined = joined.withColumn(name, F.coalesce(name, zero))
    return joined


def count_arrays(records: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """The same counts where each record carries its own short item arrays."""
    return (
        records.withColumn("n_gold", F.size(F.array_distinct(gold)).cast("bigint"))
        .withColumn("n_predicted", F.size(F.array_distinct(predicted)).cast("bigint"))
        .withColumn("n_common", F.size(F.array_intersect(gold, predicted)).cast("bigint"))
    )


def _guarded(value: Column, gold: Column, predicted: Column) -> Column:
    one, zero = F.lit(1).cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)")
    return (
        F.when((gold == 0) & (predicted == 0), one)
        .when((gold == 0) | (predicted == 0), zero)
        .otherwise(value)
    )


def score(counted: DataFrame) -> DataFrame:
    """Per record: status_correct, applicable and, only where applicable, exact and the ratios."""
    gold, predicted, common = F.col("n_gold"), F.col("n_predicted"), F.col("n_common")
    success = F.lit("SUCCESS")
    applicable = (F.col("expected_status") == success) & (F.col("observed_status") == success)
    ratios = {
        "precision": ratio6(common, predicted),
        "recall": ratio6(common, gold),
        "f1": ratio6(2 * common, gold + predicted),
    }
    scored = (
        counted.withColumn("status_correct", F.col("expected_status") == F.col("observed_status"))
        .withColumn("applicable", applicable)
        .withColumn("exact", F.when(applicable, (common == gold) & (common == predicted)))
    )
    for name, value in ratios.items():
        scored = scored.withColumn(name, F.when(applicable, _guarded(value, gold, predicted)))
    return scored


def _mean6(total: Column, count: Column) -> Column:
    return F.bround(F.try_divide(total.cast("decimal(18,6)"), count.cast("decimal(12,0)")), 6).cast("decimal(18,6)")


def macro_columns() -> list[Column]:
    """Means of the rounded per-record values over applicable records, with their operands."""
    rows = F.count_if("applicable")
    columns = [
        rows.alias("applicable_count"),
        F.count_if("exact").alias("exact_numerator"),
        ratio6(F.count_if("exact"), rows).alias("macro_exact"),
    ]
    for name in ("precision", "recall", "f1"):
        columns += [
            F.sum(name).cast("decimal(18,6)").alias(f"{name}_numerator"),
            _mean6(F.sum(name), rows).alias(f"macro_{name}"),
        ]
    return columns


def micro_columns() -> list[Column]:
    """Ratios of pooled counts over applicable records; null without any."""

    def pooled(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("applicable"), F.col(name))), F.lit(0).cast("bigint"))

    gold, predicted, common = pooled("n_gold"), pooled("n_predicted"), pooled("n_common")
    some = F.count_if("applicable") > 0
    return [
        common.alias("true_positive"),
        predicted.alias("predicted_total"),
        gold.alias("gold_total"),
        F.when(some, _guarded(ratio6(common, predicted), gold, predicted)).alias("micro_precision"),
        F.when(some, _guarded(ratio6(common, gold), gold, predicted)).alias("micro_recall"),
        F.when(some, _guarded(ratio6(2 * common, gold + predicted), gold, predicted)).alias("micro_f1"),
    ]


def status_columns() -> list[Column]:
    """One count per status, zeros included."""
    return [F.count_if(F.col("observed_status") == s).alias(s.lower()) for s in STATUSES]


def rate_columns() -> list[Column]:
    """Operational rates; null where the denominator is zero."""
    observed, total = F.col("observed_status"), F.count(F.lit(1))
    unsupported = F.col("expected_status") == "UNSUPPORTED"
    return [
        ratio6(F.count_if("status_correct"), total).alias("status_accuracy"),
        ratio6(F.count_if(observed != "SYNTAX_ERROR"), total).alias("syntax_success_rate"),
        ratio6(F.count_if(observed.isin("SUCCESS", "EMPTY_RESULT")), total).alias("execution_success_rate"),
        ratio6(F.count_if("recovery_attempted"), total).alias("recovery_attempt_rate"),
        ratio6(F.count_if("recovery_success"), F.count_if("recovery_attempted")).alias("recovery_success_rate"),
        ratio6(F.count_if(observed == "EMPTY_RESULT"), total).alias("strict_empty_rate"),
        ratio6(
            F.count_if(unsupported & (observed == "UNSUPPORTED")), F.count_if(unsupported)
        ).alias("unsupported_rejection_rate"),
    ]


def optional_rate_column() -> Column:
    """Bindings with any unbound optional over all bindings."""
    return ratio6(F.sum("optional_binding_count"), F.sum("binding_count")).alias("optional_binding_rate")


def optional_binding_counts(bindings: DataFrame, key: str, variables: Sequence[str]) -> DataFrame:
    """Per request: bindings, and those in which any variable is null."""
    unbound = F.lit(False)
    for variable in variables:
        unbound = unbound | F.col(variable).isNull()
    return bindings.groupBy(key).agg(
        F.count(F.lit(1)).alias("binding_count"), F.count_if(unbound).alias("optional_binding_count")
    )


def sliced_report(scored: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """All measures overall and by each dimension, in one aggregate over grouping sets."""
    tag = F.lit("overall")
    for name in dimensions:
        tag = F.when(F.grouping(name) == 0, name).otherwise(tag)
    member = F.coalesce(*[F.when(F.grouping(n) == 0, F.col(n).cast("string")) for n in dimensions])
    sets = [[], *[[F.col(name)] for name in dimensions]]
    report = scored.groupingSets(sets, *[F.col(n) for n in dimensions]).agg(
        tag.alias("slice"),
        member.alias("member"),
        F.count(F.lit(1)).alias("query_count"),
        *status_columns(),
        *macro_columns(),
        *micro_columns(),
        *rate_columns(),
        optional_rate_column(),
    )
    # A null member of a dimension is no slice of its own.
    return report.drop(*dimensions).where("slice = 'overall' OR member IS NOT NULL")


def dimension_report(cases: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Per dimension: total, passed and accuracy (1 if there is no case)."""
    counts = cases.agg(
        F.count(F.lit(1)).alias("_total"), *[F.count_if(F.col(d)).alias(d) for d in dimensions]
    )
    rows = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("passed")) for d in dimensions])
    accuracy = F.coalesce(F.try_divide(F.col("passed").cast("double"), F.col("total")), F.lit(1.0))
    return (
        counts.select(F.col("_total").alias("total"), F.inline(rows))
        .withColumn("accuracy", accuracy)
        .select("dimension", "total", "passed", "accuracy")
    )


def dimension_failures(cases: DataFrame, key: str, dimensions: Sequence[str]) -> DataFrame:
    """(dimension, key) of every failed case, as rows so that no list grows with the cases."""
    failed = F.array_compact(
        F.array(*[F.when(~F.coalesce(F.col(d), F.lit(False)), F.lit(d)) for d in dimensions])
    )
    return cases.select(F.explode(failed).alias("dimension"), key)


def difference(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Rows that one side has more often than the other: side, copies and the row.

    Copies are counted per side in one aggregate; equal tables give no rows.
    """
    columns = left.columns
    tagged = left.select(*columns, F.lit(1).alias("_n")).union(
        right.select(*columns, F.lit(-1).alias("_n"))
    )
    summed = tagged.groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return summed.select(
        F.when(F.col("_n") > 0, names[0]).otherwise(names[1]).alias("side"),
        F.abs("_n").alias("copies"),
        *columns,
    )


def graph_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Triples of one graph only, whatever the graphs are called. Blank nodes are refused."""
    columns = ["s", "p", "o", "o_kind", "datatype", "lang"]

    def plain(triples: DataFrame) -> DataFrame:
        blank = F.startswith(F.col("s"), F.lit("_:")) | (F.col("o_kind") == "bnode")
        refused = F.raise_error(F.lit("graphs with blank nodes cannot be compared by name"))
        checked = triples.withColumn("s", F.when(blank, refused.cast("string")).otherwise(F.col("s")))
        return checked.select(*columns).distinct()

    return difference(plain(left), plain(right)).drop("copies")


def compare_runs(recorded: DataFrame, current: DataFrame, volatile: Sequence[str]) -> DataFrame:
    """Differences of two runs once the columns that may differ are left out."""
    return difference(recorded.drop(*volatile), current.drop(*volatile), ("recorded", "current"))


def corpus_diff(before: DataFrame, after: DataFrame, closure_ids: DataFrame | None = None) -> DataFrame:
    """Gold items that changed per record, the status before and after, and why.

    before and after: id, gold array, status. closure_ids lists records whose gold is derived
    from a closure.
    """
    old = before.select("id", F.array_sort(F.array_distinct("gold")).alias("gold_before"), F.col("status").alias("status_before"))
    new = after.select("id", F.array_sort(F.array_distinct("gold")).alias("gold_after"), F.col("status").alias("status_after"))
    joined = old.join(new, "id", "full_outer")
    if closure_ids is not None:
        joined = joined.join(closure_ids.select("id", F.lit(True).alias("_closure")), "id", "left")
    else:
        joined = joined.withColumn("_closure", F.lit(None).cast("boolean"))
    none = F.array().cast("array<string>")
    was, now = F.coalesce("gold_before", none), F.coalesce("gold_after", none)
    added, removed = F.array_except(now, was), F.array_except(was, now)
    reason = (
        F.when(F.col("status_before").isNull(), "RECORD_ADDED")
        .when(F.col("status_after").isNull(), "RECORD_REMOVED")
        .when(F.col("_closure") & (F.size(added) > 0), "PREREQUISITE_CLOSURE_EXPANSION")
        .when(F.col("_closure"), "PREREQUISITE_CLOSURE_NORMALIZATION")
        .when(F.col("status_before") != F.col("status_after"), "STRICT_CONSTRAINT_STATUS_CORRECTION")
        .otherwise("SCHEMA_NORMALIZATION")
    )
    return joined.select(
        "id", added.alias("added"), removed.alias("removed"), "status_before", "status_after", reason.alias("reason")
    )


def id_violations(results: DataFrame, references: DataFrame) -> DataFrame:
    """Broken composite result ids, as rows (result_id, violation).

    results: corpus_id, condition, query_id; references: corpus_id, result_id.
    """
    key = F.concat_ws(":", "corpus_id", "condition", "query_id")
    keys = results.select(key.alias("result_id"), F.col("corpus_id").alias("_owner"))
    counted = keys.groupBy("result_id").agg(F.count(F.lit(1)).alias("_results"), F.min("_owner").alias("_owner"))
    referred = references.groupBy("result_id").agg(
        F.count(F.lit(1)).alias("_references"), F.min("corpus_id").alias("_low"), F.max("corpus_id").alias("_high")
    )
    joined = counted.join(referred, "result_id", "full_outer")
    foreign = (F.col("_low") != F.col("_high")) | ~F.startswith("result_id", F.concat("_low", F.lit(":")))
    checks = F.array_compact(
        F.array(
            F.when(F.col("_results") > 1, "DUPLICATE_RESULT"),
            F.when(F.col("_references") > 1, "DUPLICATE_REFERENCE"),
            F.when(F.col("_results").isNull(), "UNKNOWN_REFERENCE"),
            F.when(F.col("_references").isNull(), "UNREFERENCED_RESULT"),
            F.when(foreign, "FOREIGN_CORPUS"),
            F.when(F.size(F.split("result_id", ":")) != 3, "NOT_COMPOSITE"),
        )
    )
    return joined.select("result_id", F.explode(checks).alias("violation"))


def corpus_violations(records: DataFrame, expected: DataFrame) -> DataFrame:
    """Broken corpus records, as rows (corpus_id, id, violation).

    records: corpus_id (where filed), record_corpus, id, expected_status, reflection_reason,
    failure and intent (from diagnose); expected: corpus_id, id. What breaks a record is written once; records and expected ids
    meet in one grouping, in which an id or corpus that is null meets nothing.
    """
    supported = (F.col("failure") == "NONE") & (F.col("intent") != "UNSUPPORTED")
    declared = F.col("expected_status")
    answered = declared.isin("SUCCESS", "EMPTY_RESULT")
    changed = (F.col("intent") != "UNSUPPORTED") | ~F.col("failure").eqNullSafe(F.col("reflection_reason"))
    record_checks = F.array_compact(
        F.array(
            F.when(~F.col("record_corpus").eqNullSafe(F.col("corpus_id")), "CORPUS_MISMATCH"),
            F.when(answered & ~supported, "NOT_GROUNDED"),
            F.when((declared == "UNSUPPORTED") & changed, "UNSUPPORTED_CONTRACT"),
        )
    )
    checked = written(records.select("corpus_id", "id", record_checks.alias("_checks")), "records")
    nowhere = F.col("corpus_id").isNull() | F.col("id").isNull()

    def side(rows: DataFrame, is_record: bool) -> DataFrame:
        return rows.select("corpus_id", "id", F.when(nowhere, F.lit(is_record)).alias("_side"), F.lit(is_record).alias("_record"))

    found = side(checked, True).unionByName(side(expected, False)).groupBy("corpus_id", "id", "_side").agg(
        F.count_if("_record").alias("_n"), F.bool_or(~F.col("_record")).alias("_wanted")
    )
    presence_checks = F.array_compact(
        F.array(
            F.when(~F.col("_wanted"), "UNEXPECTED_ID"),
            F.when(F.col("_n") == 0, "MISSING_ID"),
            F.when(F.col("_n") > 1, "DUPLICATE_ID"),
        )
    )
    return found.select("corpus_id", "id", F.explode(presence_checks).alias("violation")).unionByName(
        checked.select("corpus_id", "id", F.explode("_checks").alias("violation"))
    )


def compare_golden(
    expected: DataFrame,
    actual: DataFrame,
    arrays: Sequence[str],
    scalars: Sequence[str],
    contained: Sequence[tuple[str, str]] = (),
    key: str = "case_id",
) -> DataFrame:
    """Per case, whether each dimension matches; a missing case fails everywhere.

    Arrays compare as sorted sets of one case's own items. contained pairs (required, found)
    ask that every required item of the expectation is among the found ones.
    """
    want = expected.select(key, *[F.col(c).alias(f"want_{c}") for c in expected.columns if c != key])
    joined = want.join(actual, key, "left")

    def same(column: Column) -> Column:
        return F.array_sort(F.array_distinct(column))

    results = [same(F.col(f"want_{c}")).eqNullSafe(same(F.col(c))).alias(c) for c in arrays]
    results += [F.col(f"want_{c}").eqNullSafe(F.col(c)).alias(c) for c in scalars]
    for required, found in contained:
        missing = F.array_except(F.col(f"want_{required}"), F.coalesce(F.col(found), F.array().cast("array<string>")))
        results.append((F.size(missing) == 0).alias(f"has_{required}"))
    return joined.select(key, *results)
