"""Comparing graphs whose blank nodes are labelled differently.

Blank nodes get colours from what surrounds them, round by round, until no round tells more of them apart. Where
nodes of a connected part stay tied, the part is copied for each of them, that one is singled out, and the copy with the least
digest is kept; so the names that result do not depend on labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import evaluate
from weftline.operators.closure import strong_components
from weftline.session import cut_lineage, written
from weftline.sources import digests

_TRIPLE = ("s", "p", "o", "o_kind", "datatype", "lang")


def _hash(*parts: Column) -> Column:
    """A number of the parts; null parts count by their place."""
    return F.xxhash64(*[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts])


def _sums(value: Column) -> list[Column]:
    """Two sums that stand for a set with repeats, in any order and without holding it."""
    low = F.lit(0xFFFFFFFF)
    return [F.sum(value.bitwiseAND(low)).alias("low"), F.sum(F.shiftright(value, 32).bitwiseAND(low)).alias("high")]


def _views(facts: DataFrame) -> DataFrame:
    """(side, node, ground, other): each fact from its blank ends; other is the blank node at the other end, if any."""
    s, o = F.startswith(F.col("s"), F.lit("_:")), F.col("o_kind") == "bnode"
    itself = o & (F.col("s") == F.col("o"))
    known = [F.when(~o, F.col(c)) for c in ("o", "o_kind", "datatype", "lang")]
    out = facts.where(s).select(
        "side", F.col("s").alias("node"), _hash(F.lit("out"), F.col("p"), itself, *known).alias("ground"), F.when(o & ~itself, F.col("o")).alias("other")
    )
    into = facts.where(o & ~itself).select(
        "side", F.col("o").alias("node"), _hash(F.lit("in"), F.col("p"), F.when(~s, F.col("s"))).alias("ground"), F.when(s, F.col("s")).alias("other")
    )
    return out.unionByName(into)


def _refined(views: DataFrame, state: DataFrame) -> DataFrame:
    """Colours (branch, node, colour) in rounds, until their number stays the same in all branches together."""
    classes = state.select("branch", "colour").distinct().count()
    while True:
        around = state.select("branch", F.col("node").alias("other"), F.col("colour").alias("_other"))
        seen = views.join(around, ["branch", "other"], "left")
        summed = seen.groupBy("branch", "node").agg(*_sums(_hash(F.col("ground"), F.col("_other"))))
        state = cut_lineage(state.join(summed, ["branch", "node"], "left").select(
            "branch", "node", _hash(F.col("colour"), F.col("low"), F.col("high")).alias("colour")
        ))
        now = state.select("branch", "colour").distinct().count()
        if now == classes:
            return state
        classes = now


def _singled_out(views: DataFrame, state: DataFrame) -> DataFrame | None:
    """Colours after one tied node of each branch is singled out; None if no branch has ties."""
    tied = cut_lineage(state.groupBy("branch", "colour").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    if tied.isEmpty():
        return None
    smallest = tied.groupBy("branch").agg(F.min(F.struct("n", "colour"))["colour"].alias("colour"))
    picks = state.join(smallest, ["branch", "colour"]).select("branch", F.col("node").alias("pick"))
    branches = cut_lineage(state.select("branch").distinct().join(picks, "branch", "left"))
    own = F.coalesce(F.concat_ws("/", "branch", "pick"), F.col("branch"))
    copied = written(views.join(branches, "branch").withColumn("branch", own).drop("pick"), "views")
    marked = F.when(F.col("node") == F.col("pick"), _hash(F.col("colour"), F.lit("pick"))).otherwise(F.col("colour"))
    started = cut_lineage(state.join(branches, "branch").select(own.alias("branch"), "node", marked.alias("colour")))
    tried = _refined(copied, started)
    digest = tried.groupBy("branch").agg(*_sums(F.col("colour")))
    named = branches.select(F.col("branch").alias("parent"), own.alias("branch"))
    best = digest.join(named, "branch").groupBy("parent").agg(F.min(F.struct("low", "high", "branch"))["branch"].alias("branch"))
    return cut_lineage(tried.join(best, "branch").select(F.col("parent").alias("branch"), "node", "colour"))


def canonical(graphs: DataFrame) -> DataFrame:
    """(side, s, p, o, ...): triples of graphs told apart by ``side``, with blank nodes named by their colours.

    Graphs are coloured together, so equal parts get equal names. Blank nodes with the very same facts are
    interchangeable: one stands for them all, with their number, and they share a name; so do nodes of parts that are copies
    of each other. Copies of a triple are kept. Work for a connected part of tied nodes grows with the square of its size.
    """
    facts = cut_lineage(graphs.select("side", *_TRIPLE).distinct())
    views = cut_lineage(_views(facts))
    twins = views.groupBy("side", "node").agg(*_sums(_hash(F.col("ground"), F.col("other"))), F.count(F.lit(1)).alias("n"))
    groups = twins.groupBy("side", "low", "high", "n").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("many"))
    alike = cut_lineage(twins.join(groups, ["side", "low", "high", "n"]).select("side", "node", "first", "many"))
    stands = alike.where("node = first").select("side", "node", "many")
    kept = views.join(stands, ["side", "node"]).join(stands.select("side", F.col("node").alias("other"), F.lit(True).alias("_stays")), ["side", "other"], "left")
    kept = kept.where("other IS NULL OR _stays")
    mark = lambda c: F.concat_ws(" ", "side", c)
    links = kept.where("other IS NOT NULL").select(mark("node").alias("src"), mark("other").alias("dst"))
    parts = strong_components(links).select("node", F.col("component").alias("branch"))
    own = stands.select(mark("node").alias("node"), F.col("many").alias("colour")).join(parts, "node", "left")
    state = cut_lineage(own.select(F.coalesce("branch", "node").alias("branch"), "node", "colour"))
    moved = kept.select(mark("node").alias("node"), "ground", F.when(F.col("other").isNotNull(), mark("other")).alias("other"))
    moved = cut_lineage(moved.join(state.select("branch", "node"), "node"))
    state = _refined(moved, state)
    while (further := _singled_out(moved, state)) is not None:
        state = further
    name = F.concat(F.lit("_:c"), F.lower(F.hex("colour"))).alias("name")
    names = alike.join(state.select("node", name).toDF("_at", "name"), mark("first") == F.col("_at")).select("side", "node", "name")
    names = cut_lineage(names)
    renamed = facts.join(names.toDF("side", "s", "_s"), ["side", "s"], "left")
    renamed = renamed.join(names.toDF("side", "o", "_o"), ["side", "o"], "left")
    blank = F.col("o_kind") == "bnode"
    return renamed.select(
        "side", F.coalesce("_s", "s").alias("s"), "p", F.when(blank, F.col("_o")).otherwise(F.col("o")).alias("o"), "o_kind", "datatype", "lang"
    )


def graph_difference(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """(side, copies, s, p, o, ...): triples that one graph has more often; none for graphs equal but for their labels.

    A change shows on every blank node that is connected to it, whose surroundings it changes.
    """
    sides = [g.select(F.lit(n).alias("side"), *_TRIPLE) for g, n in zip((left, right), names, strict=True)]
    both = cut_lineage(canonical(sides[0].unionByName(sides[1])))
    plain = [both.where(F.col("side") == n).drop("side") for n in names]
    return evaluate.difference(*plain, names)


def graph_digest(graph: DataFrame) -> DataFrame:
    """One digest of a graph, the same for every labelling of its blank nodes; copies of a part count."""
    named = canonical(graph.select(F.lit("").alias("side"), *_TRIPLE)).drop("side")
    counted = named.groupBy(*_TRIPLE).agg(F.count(F.lit(1)).alias("copies"))
    line = F.to_json(F.struct(*_TRIPLE, "copies"), {"ignoreNullFields": "false"})
    return digests.tree_digest(counted.select(line.alias("line")), "line")
