"""Mixing sources to target weights by entropy balancing.

Among all document rates of at most ``most`` that give each source its target of words, those nearest to
one (in relative entropy) are ``min(most, exp(tilt * size))`` with one tilt for each source. Newton steps
on the convex dual find the tilts: each is one aggregate over the counts of documents by source and size,
kept inside a bracket. Rates become copies by carrying the rounding error along the sizes of a source,
which leaves an error below the source's longest document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.frames import in_few_files, keyed, unused
from weftline.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3
ROUNDS = 60
TOLERANCE = 1e-8
#: Fractions of copies are whole numbers of this part, so that sums don't depend on their order.
PART = 1_000_000_000
BUCKETS = 256


def sizes(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``target`` words for rows (source, source_size): shares of all words by weight, at most ``most`` times the own.

    Sources take the weights in turn, by code point, null last. A source is full if its cap by weight is at most
    the level that the words left give to the weights left; the final level is the largest of these. The
    windows run over one row for each source.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    given = F.array(*map(F.lit, weights))
    weighed = sources.withColumn(
        "weight", F.get(given, (F.row_number().over(turn) - 1) % len(weights)).cast("double")
    ).withColumn("cap", (most * F.col("source_size")).cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    whole = F.sum(F.col("source_size").cast("double")).over(Window.partitionBy())
    levelled = weighed.withColumn("level", (whole - full) / left)
    level = F.max("level").over(Window.partitionBy())
    return levelled.withColumn("target", F.least(F.col("cap"), F.col("weight") * level)).select(
        "source", "source_size", "target"
    )


def _rate(most: int) -> Column:
    """A document's rate from its source's tilt; sources filled to their cap take the cap."""
    tilted = F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(700.0)))
    return F.when(F.col("full"), F.lit(float(most))).otherwise(F.least(tilted, F.lit(float(most))))


def _exact(value: Column) -> Column:
    """Summed as a decimal: the same result in any order."""
    return F.sum(value.cast("decimal(38,12)")).cast("double")


def tilts(counts: DataFrame, aims: DataFrame, most: int = MOST, rounds: int = ROUNDS) -> DataFrame:
    """(source, scale, full, tilt) from counts (source, size, n) and aims (source, source_size, target)."""
    scale = counts.groupBy("source").agg(
        (_exact(F.col("n") * F.col("size") * F.col("size")) / F.greatest(_exact(F.col("n") * F.col("size")), F.lit(1.0)))
        .alias("scale")
    ).withColumnRenamed("source", "named")
    state = cut_lineage(
        aims.join(scale, aims["source"].eqNullSafe(scale["named"])).select(
            "source", "target", F.greatest("scale", F.lit(1.0)).alias("scale"),
            (F.col("target") >= most * F.col("source_size") * (1 - 1e-12)).alias("full"),
            F.lit(0.0).alias("tilt"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"),
            F.lit(1.0).alias("miss"),
        )
    )
    many = state.count()
    for _ in range(rounds):
        if not state.where(~F.col("full") & (F.col("miss") > TOLERANCE)).limit(1).count():
            break
        state = cut_lineage(in_few_files(_step(counts, state, most), many))
    return state.select("source", "scale", "full", "tilt")


def _step(counts: DataFrame, state: DataFrame, most: int) -> DataFrame:
    """One Newton step for every source on the log of its words, or a bisection if it leaves the bracket."""
    rate = _rate(most)
    size = F.col("size") / F.col("scale")
    named = state.withColumnRenamed("source", "named")
    sums = counts.join(named, counts["source"].eqNullSafe(named["named"])).groupBy("named").agg(
        _exact(F.col("n") * F.col("size") * rate).alias("got"),
        _exact(F.when(rate < most, F.col("n") * F.col("size") * size * rate).otherwise(F.lit(0.0))).alias("slope"),
    )
    over = F.col("got") > F.col("target")
    low = F.when(over, F.col("low")).otherwise(F.greatest("low", "tilt"))
    high = F.when(over, F.least("high", "tilt")).otherwise(F.col("high"))
    newton = F.col("tilt") - F.log(F.col("got") / F.col("target")) * F.col("got") / F.col("slope")
    usable = (F.col("got") > 0) & (F.col("slope") > 0)
    wide = F.when(over, F.col("tilt") - 1 - F.abs("tilt")).otherwise(F.col("tilt") + 1 + F.abs("tilt"))
    open_end = (F.col("low") == float("-inf")) | (F.col("high") == float("inf"))
    fallback = F.when(open_end, wide).otherwise((F.col("low") + F.col("high")) / 2)
    step = F.when(usable, newton)
    inside = usable & (step > F.col("low")) & (step < F.col("high")) & (F.abs(step - F.col("tilt")) < 1e6)
    miss = F.abs(F.col("got") - F.col("target")) / F.greatest("target", F.lit(1.0))
    done = F.col("full") | (miss <= TOLERANCE)
    met = state.join(sums, state["source"].eqNullSafe(sums["named"])).drop("named")
    return (
        met.withColumns({"low": low, "high": high, "miss": miss})
        .withColumn("tilt", F.when(done, F.col("tilt")).when(inside, step).otherwise(fallback))
        .select(*state.columns)
    )


def _cells(counts: DataFrame, tilted: DataFrame, most: int) -> DataFrame:
    """(source, size, copies, extra): copies of every document of a cell and how many get one more."""
    named = tilted.withColumnRenamed("source", "named")
    rated = counts.join(named, counts["source"].eqNullSafe(named["named"])).select(
        "source", "size", "n", F.round(_rate(most) * PART).cast("long").alias("parts")
    )
    whole = F.floor(F.col("parts") / PART).cast("long")
    rest = (F.col("parts") - whole * PART) * F.col("n")
    # One row for each size of a source: its documents are counted before.
    upto = Window.partitionBy("source").orderBy("size")
    carried = F.sum(rest.cast("decimal(38,0)")).over(upto)
    rounded = lambda c: F.floor((c + PART // 2) / PART).cast("long")
    return rated.select(
        "source", "size", whole.alias("copies"),
        (rounded(carried) - rounded(carried - rest.cast("decimal(38,0)"))).alias("extra"),
    )


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", keys: tuple[str, ...] = ("doc_id",),
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST,
) -> DataFrame:
    """``keys``, size, source_size, target and copies (0 to ``most``) for each row of ``docs``.

    Null and empty texts have size 0 and one copy, unless their source is filled. Rows without a source are a source of their own.
    Of documents of one source and size those with the smallest key hashes get the extra copy; repeated
    rows are rated each. An empty table gives no row; other columns are ignored.
    """
    own = [f"key{i}" for i in range(len(keys))]
    named_keys = [F.col(k).alias(o) for k, o in zip(keys, own, strict=True)]
    sized = cut_lineage(docs.select(*named_keys, F.col(source).alias("source"), sizes(F.col(text)).alias("size")))
    counts = cut_lineage(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    aims = cut_lineage(targets(counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, most))
    cells = cut_lineage(_cells(counts, tilts(counts, aims, most), most))
    # The extra copies of a cell go to its buckets in turn, and in a bucket to the smallest hashes.
    order = F.xxhash64(*own)
    dealt = cut_lineage(sized.withColumn("order", order).withColumn("bucket", F.pmod("order", F.lit(BUCKETS)).cast("int")))
    held = dealt.groupBy("source", "size", "bucket").agg(F.count("*").alias("held"))
    before = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shares = held.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
    shares = shares.join(
        cells.select(F.col("source").alias("s"), F.col("size").alias("z"), "copies", "extra"),
        F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")),
    ).select(
        F.col("source").alias("s"), F.col("size").alias("z"), F.col("bucket").alias("b"), "copies",
        (F.col("extra") - F.col("before")).alias("share"),
    )
    place = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("order", *own))
    placed = dealt.withColumn("place", place)
    rated = placed.join(
        cut_lineage(shares),
        F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("bucket") == F.col("b")),
    ).withColumn("copies", F.col("copies") + (F.col("place") <= F.col("share")).cast("long"))
    named = aims.withColumnRenamed("source", "named")
    return rated.join(named, rated["source"].eqNullSafe(named["named"])).select(
        *(F.col(o).alias(k) for k, o in zip(keys, own, strict=True)), "size", "source_size", "target", "copies"
    )


def mixed(docs: DataFrame, text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their columns as they are.

    Rows are mixed by the words of their texts; null and empty texts have none. Rows without a source are a source of their
    own, repeated rows are rows of their own, keys and columns of other names are not looked at. An empty table gives no rows.
    """
    rows, keys = keyed(docs)
    copies = unused(rows, "copies")
    taken = mix(rows, text, source, keys, weights).where("copies > 0").select(*keys, F.col("copies").alias(copies))
    repeats = F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias(unused(rows, "copy"))
    return rows.join(taken, list(keys)).select(*docs.columns, repeats).select(*docs.columns)
