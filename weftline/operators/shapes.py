"""RDFS entailment and shape validation as joins over a triples table.

A shape table made by shape_table is part of the plan, so Spark knows its size and broadcasts it
by itself; one too large for that is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.closure import closure
from weftline.schemas import TRIPLE_COLUMNS
from weftline.session import cut_lineage, literal_rows, measured_side, spread, written
from weftline.sources.triples import RDF_TYPE, RDFS, XSD

SUBCLASS, SUBPROPERTY = RDFS + "subClassOf", RDFS + "subPropertyOf"
DOMAIN, RANGE = RDFS + "domain", RDFS + "range"

SHAPE_SCHEMA = (
    "shape string, target_class string, path string, constraint string, "
    "value string, allowed array<struct<value:string,datatype:string>>, message string"
)

# Constraint kinds.
CONSTRAINTS = ("minCount", "maxCount", "datatype", "languageIn", "in", "class", "minInclusive")


def _closed(triples: DataFrame, predicate: str) -> DataFrame:
    """(src, dst) of one axiom predicate, transitively closed."""
    direct = triples.where((F.col("p") == predicate) & (F.col("o_kind") != "literal"))
    links = direct.select(F.col("s").alias("src"), F.col("o").alias("dst")).distinct()
    pairs = closure(links, links.select(F.col("src").alias("seed")), None).pairs
    return pairs.select(F.col("seed").alias("src"), F.col("node").alias("dst"))


def rdfs_entail(triples: DataFrame, ontology: DataFrame | None = None, is_set: bool = False) -> DataFrame:
    """The triples plus everything subproperty, domain, range and subclass axioms imply, as a set.

    All chaining happens among the few axioms: each property is given its super-properties and
    every class its ends imply. The data then meets small sides. Triples known to be a set are not
    compared again, nor are those of a super-property that follows from one property alone and is not stated; types
    are compared as pairs of node and class. Axioms come from the ontology where given, else from the triples.
    """
    axioms = ontology if ontology is not None else triples
    if ontology is None:
        # Read once for the axioms and once for the data.
        triples = axioms = cut_lineage(triples)
    super_property = cut_lineage(_closed(axioms, SUBPROPERTY))
    super_class = cut_lineage(_closed(axioms, SUBCLASS))
    ends = axioms.where(F.col("p").isin(DOMAIN, RANGE)).select(
        F.col("s").alias("_property"), F.col("p").alias("_end"), F.col("o").alias("_class")
    )
    inherited = super_property.join(ends, F.col("dst") == F.col("_property")).select(
        F.col("src").alias("_property"), "_end", "_class"
    )
    ends = ends.unionByName(inherited)
    widened = ends.join(super_class, F.col("_class") == F.col("src")).select(
        "_property", "_end", F.col("dst").alias("_class")
    )
    ends = cut_lineage(ends.unionByName(widened).distinct())
    stated = triples.select(*TRIPLE_COLUMNS)
    if not is_set:
        stated = stated.distinct()
    met = _among(stated, super_property)
    above = super_property.groupBy(F.col("src").alias("p")).agg(
        F.collect_set(F.when(~F.col("dst").isin(met), F.col("dst"))).alias("_own"),
        F.collect_set(F.when(F.col("dst").isin(met), F.col("dst"))).alias("_met"),
    )
    sides = ends.groupBy(F.col("_property").alias("p")).agg(
        F.collect_set(F.when(F.col("_end") == DOMAIN, F.col("_class"))).alias("_of_subject"),
        F.collect_set(F.when(F.col("_end") == RANGE, F.col("_class"))).alias("_of_object"),
    )
    classes = super_class.groupBy(F.col("src").alias("_typed")).agg(F.collect_set("dst").alias("_classes"))
    above, sides, classes = measured_side(above), measured_side(sides), measured_side(classes)

    def each(values: str, make) -> Column:
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), make)

    def raised(values: Column) -> DataFrame:
        """The stated triples under each of some properties, which may take in their own."""
        given = stated.join(above, "p", "left").withColumn("p", F.explode(values))
        return given.select(*TRIPLE_COLUMNS)

    none = F.array().cast("array<string>")
    plain = F.col("o_kind").eqNullSafe("iri") & F.col("datatype").isNull() & F.col("lang").isNull()
    is_type = F.coalesce((F.col("p") == RDF_TYPE) & plain, F.lit(False))
    own, shared = F.coalesce("_own", none), F.coalesce("_met", none)
    compared = F.coalesce(F.col("p").isin(met), F.lit(False))
    single = raised(F.concat(F.when(compared, none).otherwise(F.array("p")), own)).where(~is_type)
    parts = [single]
    if met:
        parts.append(raised(F.concat(F.when(compared, F.array("p")).otherwise(none), shared)).where(~is_type).distinct())

    # Types: what is stated, raised to a type, or follows from a property's ends or a class.
    followed = stated.join(sides, "p", "left").join(
        classes, (F.col("p") == RDF_TYPE) & (F.col("o") == F.col("_typed")), "left"
    )
    typed = F.concat(
        each("_of_subject", lambda c: F.struct(F.col("s"), c.alias("o"))),
        F.when(F.col("o_kind") != "literal", each("_of_object", lambda c: F.struct(F.col("o").alias("s"), c.alias("o")))).otherwise(
            F.array().cast("array<struct<s:string,o:string>>")
        ),
        each("_classes", lambda c: F.struct(F.col("s"), c.alias("o"))),
    )
    known = raised(F.concat(F.array("p"), own, shared)).where(is_type).select("graph", "s", "o")
    types = known.unionByName(followed.select("graph", F.inline(typed))).distinct()
    null = F.lit(None).cast("string")
    types = types.withColumns({"p": F.lit(RDF_TYPE), "o_kind": F.lit("iri"), "datatype": null, "lang": null})
    return reduce(DataFrame.unionByName, [*parts, types.select(*TRIPLE_COLUMNS)])


def _among(stated: DataFrame, super_property: DataFrame) -> list[str]:
    """Super-properties whose triples may follow twice: from several properties, or also stated.

    Axioms are few: one row for each super-property reaches the driver.
    """
    below = super_property.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).collect()
    twice = {r["dst"] for r in below if r["n"] > 1}
    once = [r["dst"] for r in below if r["n"] == 1]
    also = stated.where(F.col("p").isin(once)).select("p").distinct().collect() if once else []
    return sorted(twice | {r["p"] for r in also})


def shape_table(spark, rows: Sequence[tuple]) -> DataFrame:
    """Shapes from (shape, target_class, path, constraint, value, message) tuples.

    The value of "in" is a list of (value, datatype), that of "languageIn" a list of tags.
    """
    prepared = []
    for shape, target, path, constraint, value, message in rows:
        if constraint not in CONSTRAINTS:
            raise ValueError(f"unknown constraint: {constraint}")
        allowed = None
        if constraint == "in":
            allowed = [{"value": v, "datatype": d} for v, d in value]
        elif constraint == "languageIn":
            allowed = [{"value": v, "datatype": None} for v in value]
        single = None if allowed is not None else str(value)
        prepared.append((shape, target, path, constraint, single, allowed, message))
    return literal_rows(spark, prepared, SHAPE_SCHEMA)


# Lexical forms of the checked datatypes.
_LEXICAL = {
    XSD + "integer": r"\A[+-]?[0-9]+\z",
    XSD + "decimal": r"\A[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)\z",
    XSD + "boolean": r"\A(true|false|0|1)\z",
}


def well_formed(value: Column, datatype: Column) -> Column:
    """Whether a lexical value is valid for its datatype; unlisted datatypes accept any text."""
    valid = F.lit(True)
    for iri, pattern in _LEXICAL.items():
        valid = F.when(datatype == iri, F.rlike(value, F.lit(pattern))).otherwise(valid)
    day = F.rlike(value, F.lit(r"\A-?\d{4,}-\d{2}-\d{2}\z")) & value.try_cast("date").isNotNull()
    return F.when(datatype == XSD + "date", day).otherwise(valid)


def focus_nodes(triples: DataFrame, shapes: DataFrame) -> DataFrame:
    """Instances of each shape's target class, one row per property constraint."""
    types = triples.where(F.col("p") == RDF_TYPE).select(
        F.col("s").alias("focus"), F.col("o").alias("target_class")
    ).distinct()
    return types.join(shapes, "target_class")


def _violation(frame: DataFrame, value: Column) -> DataFrame:
    return frame.select("focus", "shape", "path", "constraint", value.alias("value"), "message")


def count_violations(triples: DataFrame, shapes: DataFrame) -> DataFrame:
    """minCount and maxCount: value counts are aggregated before they meet the focus nodes."""
    counted = shapes.where(F.col("constraint").isin("minCount", "maxCount"))
    paths = counted.select("path").distinct()
    counts = (
        triples.join(paths, triples["p"] == paths["path"], "left_semi")
        .groupBy(F.col("s").alias("focus"), F.col("p").alias("path"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    checked = focus_nodes(triples, counted).join(counts, ["focus", "path"], "left")
    n, bound = F.coalesce("_n", F.lit(0).cast("bigint")), F.col("value").cast("bigint")
    broken = F.when(F.col("constraint") == "minCount", n < bound).otherwise(n > bound)
    return _violation(checked.where(broken).drop("value"), F.lit(None).cast("string"))


def value_violations(triples: DataFrame, shapes: DataFrame) -> DataFrame:
    """datatype, languageIn, in and minInclusive, each value against its constraints."""
    checked = shapes.where(F.col("constraint").isin("datatype", "languageIn", "in", "minInclusive"))
    paths = checked.select(F.col("path").alias("_path")).distinct()
    values = triples.join(paths, triples["p"] == paths["_path"], "left_semi").select(
        F.col("s").alias("focus"), F.col("p").alias("path"), "o", "o_kind", "datatype", "lang"
    )
    joined = focus_nodes(triples, checked).join(values, ["focus", "path"])
    literal = F.col("o_kind") == "literal"
    datatype_ok = literal & (F.col("datatype") == F.col("value")) & well_formed(F.col("o"), F.col("datatype"))
    # A tag also covers its regional forms: en covers en-GB.
    tag = F.lower(F.coalesce("lang", F.lit("")))
    language_ok = F.exists(
        "allowed", lambda a: (tag == F.lower(a["value"])) | F.startswith(tag, F.concat(F.lower(a["value"]), F.lit("-")))
    )
    listed = F.exists(
        "allowed", lambda a: (a["value"] == F.col("o")) & a["datatype"].eqNullSafe(F.col("datatype"))
    )
    bound_ok = F.coalesce(
        literal & (F.col("o").try_cast("decimal(38,10)") >= F.col("value").try_cast("decimal(38,10)")), F.lit(False)
    )
    kind = F.col("constraint")
    passed = (
        F.when(kind == "datatype", datatype_ok)
        .when(kind == "languageIn", language_ok)
        .when(kind == "in", listed)
        .otherwise(bound_ok)
    )
    return _violation(joined.where(~F.coalesce(passed, F.lit(False))), F.col("o"))


def class_violations(triples: DataFrame, shapes: DataFrame, rows: int = 0) -> DataFrame:
    """class: objects that are not instances of the demanded class.

    With the most triples there may be, objects meet their focus nodes in tasks whose number follows it.
    """
    checked = shapes.where(F.col("constraint") == "class").withColumnRenamed("value", "_class")
    paths = checked.select(F.col("path").alias("_path")).distinct()
    values = triples.join(paths, triples["p"] == paths["_path"], "left_semi").select(
        F.col("s").alias("focus"), F.col("p").alias("path"), "o"
    )
    types = triples.where(F.col("p") == RDF_TYPE).select(
        F.col("s").alias("o"), F.col("o").alias("_class")
    )
    joined = focus_nodes(triples, checked).join(spread(values, rows, "focus", "path"), ["focus", "path"])
    return _violation(joined.join(types, ["o", "_class"], "left_anti"), F.col("o"))


def validate(
    triples: DataFrame, shapes: DataFrame, ontology: DataFrame | None = None, entail: bool = True, rows: int = 0
) -> DataFrame:
    """Violations (focus, shape, path, constraint, value, message) of a graph held as a set.

    With an ontology, range axioms make objects instances of a class, so "class" holds for
    ranged predicates; without one only stated types count. The (entailed) graph is computed once
    and written; every check and type lookup reads that copy.
    """
    graph = cut_lineage(rdfs_entail(triples, ontology) if entail else triples)
    return reduce(
        DataFrame.unionByName,
        [count_violations(graph, shapes), value_violations(graph, shapes), class_violations(graph, shapes, rows)],
    )


def conformance(checks: Sequence[tuple[str, DataFrame, bool]]) -> DataFrame:
    """One row per (check_id, violations, expected to conform): counts and the verdict."""
    rows = [
        violations.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit(check_id).alias("check_id"),
            F.lit(expected).alias("expected_conforms"),
            (F.col("violations") == 0).alias("observed_conforms"),
            "violations",
        )
        for check_id, violations, expected in checks
    ]
    return _with_verdict(reduce(DataFrame.unionByName, rows))


def _with_verdict(stacked: DataFrame) -> DataFrame:
    agreed = F.col("expected_conforms") == F.col("observed_conforms")
    verdict = F.when(~agreed, "FAIL").when(F.col("expected_conforms"), "PASS").otherwise("EXPECTED_NONCONFORMANT")
    return stacked.withColumn("result", verdict)


def conformance_by_shape(violations: DataFrame, expected: DataFrame) -> DataFrame:
    """conformance for checks that are shapes of one validation: expected has shape and expected_conforms."""
    counts = violations.groupBy("shape").agg(F.count(F.lit(1)).alias("violations"))
    stacked = expected.join(counts, "shape", "left").select(
        F.col("shape").alias("check_id"), "expected_conforms",
        F.col("violations").isNull().alias("observed_conforms"), F.coalesce("violations", F.lit(0).cast("bigint")).alias("violations"),
    )
    return _with_verdict(stacked)


def dataset_label(triples: DataFrame, predicate: str) -> DataFrame:
    """The distinct dataset identifiers of a graph, sorted and joined by +; an error if none.

    A graph names a handful of datasets, so their distinct identifiers fit one row.
    """
    ids = triples.where(F.col("p") == predicate).select("o").distinct()
    label = F.array_join(F.array_sort(F.collect_list("o")), "+")
    missing = F.raise_error(F.lit("graph has no dataset identifier")).cast("string")
    return ids.agg(F.when(F.count("o") == 0, missing).otherwise(label).alias("dataset_id"))


def crosswalk(triples: DataFrame, match: str, broader: str, alt_label: str, rows: int = 0) -> DataFrame:
    """(class_iri, concept, relation, label): each class's taxonomy concept, everything broader
    than it, and their alternative labels (null where a concept has none).

    With the most matches there may be, classes are dealt to tasks whose number follows it and move no more: the taxonomy
    and its labels are written, so that Spark knows their size.
    """
    from weftline.operators.graph import edges, zero_or_more_path

    matched = edges(triples, match).select(F.col("src").alias("class_iri"), F.col("dst").alias("_concept"))
    above = written(zero_or_more_path(edges(triples, broader)).select(
        F.col("src").alias("_concept"), F.col("dst").alias("_above")
    ), "broader")
    related = spread(matched, rows, "class_iri").join(above, "_concept", "left").select(
        "class_iri",
        F.coalesce("_above", "_concept").alias("concept"),
        F.when(F.coalesce("_above", "_concept") == F.col("_concept"), "match").otherwise("broader").alias("relation"),
    ).distinct()
    labels = written(triples.where(F.col("p") == alt_label).select(
        F.col("s").alias("concept"), F.col("o").alias("label")
    ).distinct(), "labels")
    return related.join(labels, "concept", "left").select("class_iri", "concept", "relation", "label")
