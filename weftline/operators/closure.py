"""Bounded reachability and cycles over edge tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import cut_lineage, written

# Fixed value: how many hops a prerequisite search follows.
MAX_DEPTH = 16

# Outcome of a bounded search.
SUCCESS, EMPTY_RESULT = "SUCCESS", "EMPTY_RESULT"
DEPTH_EXCEEDED = "PREREQUISITE_DEPTH_EXCEEDED"


@dataclass(frozen=True)
class Closure:
    """pairs (seed, node, distance) within the bound; truncated (seed) has nodes beyond it."""

    pairs: DataFrame
    truncated: DataFrame


def all_pairs(edges: DataFrame, max_depth: int | None = MAX_DEPTH) -> Closure:
    """The closure from every source: as many pairs as the graph has, so for small graphs or short bounds."""
    return closure(edges, edges.select(F.col("src").alias("seed")), max_depth)


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = MAX_DEPTH) -> Closure:
    """Nodes reachable from each seed by shortest distance, the seed itself left out.

    edges has src and dst, seeds has seed. One round per hop: the frontier is joined to the
    edges, reduced to distinct (seed, node) and cleared of pairs already seen. Frontier and
    edges are both written before they meet, so both sides are bare shuffles on the node and
    adaptive execution splits a hub. Building the closure runs its rounds.
    """
    if max_depth is not None and (isinstance(max_depth, bool) or max_depth < 0):
        raise ValueError("max_depth must be a whole number of at least 0")
    steps = cut_lineage(edges.select("src", "dst").where("src <> dst").distinct())
    start = seeds.select("seed").distinct()
    frontier = cut_lineage(start.select("seed", F.col("seed").alias("node")))
    levels: list[DataFrame] = []
    depth = 0
    while True:
        following = _next_round(frontier, steps, levels)
        if depth == max_depth:
            truncated = following.select("seed").distinct()
            break
        depth += 1
        frontier = cut_lineage(following)
        if frontier.isEmpty():
            truncated = frontier.select("seed")
            break
        levels.append(frontier.withColumn("distance", F.lit(depth)))
    return Closure(_stack(levels, frontier), truncated)


def _next_round(frontier: DataFrame, steps: DataFrame, levels: list[DataFrame]) -> DataFrame:
    reached = (
        frontier.join(steps, frontier["node"] == steps["src"])
        .select("seed", F.col("dst").alias("node"))
        .where("seed <> node")
        .distinct()
    )
    if not levels:
        return reached
    seen = _stack(levels, frontier).select("seed", "node")
    return reached.join(seen, ["seed", "node"], "left_anti")


def _stack(levels: list[DataFrame], empty_like: DataFrame) -> DataFrame:
    if not levels:
        return empty_like.where(F.lit(False)).select("seed", "node", F.lit(0).alias("distance"))
    stacked = levels[0]
    for level in levels[1:]:
        stacked = stacked.unionByName(level)
    return stacked


def traversal_status(seeds: DataFrame, result: Closure) -> DataFrame:
    """Per seed: whether the bound cut it off, the status and the reason."""
    cut = result.truncated.distinct().withColumn("_cut", F.lit(True))
    truncated = F.coalesce(F.col("_cut"), F.lit(False))
    return seeds.select("seed").distinct().join(cut, "seed", "left").select(
        "seed",
        truncated.alias("truncated"),
        F.when(truncated, EMPTY_RESULT).otherwise(SUCCESS).alias("status"),
        F.when(truncated, DEPTH_EXCEEDED).alias("reason"),
    )


def follow(pointers: DataFrame) -> DataFrame:
    """(node, end, top): where single steps lead, and the largest node on the way; end is null for a ring.

    pointers (node, next) has each node once; an end is a node that points nowhere. The steps double every round, so
    a chain takes as many rounds as its length has binary digits. A ring is covered once a round
    reaches no end and no larger node any more.
    """
    # Written, not only checkpointed: what the optimiser knows of the first columns would double with every round.
    state = written(pointers.select("node", F.col("next").alias("end"), F.col("node").alias("top"), F.lit(False).alias("done")), "steps")
    while True:
        ahead = state.select(F.col("node").alias("_at"), F.col("end").alias("_end"), F.col("top").alias("_top"))
        arrived, seen = F.col("_at").isNull(), F.coalesce("_top", "top")
        moved = (arrived & ~F.col("done")) | (~arrived & (seen > F.col("top")))
        state = cut_lineage(state.join(ahead, state["end"] == ahead["_at"], "left").select(
            "node", F.coalesce("_end", "end").alias("end"), F.greatest("top", seen).alias("top"), arrived.alias("done"), moved.alias("moved")
        ))
        if state.where("moved").isEmpty():
            break
    return state.select("node", F.when(F.col("done"), F.col("end")).alias("end"), "top")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): mutually reachable nodes share a component; nodes on no cycle have none.

    Nodes that cannot lie on a cycle are trimmed off first, whole chains at once. Chains between the others are
    contracted to one edge, and rings taken out. In what is left, colours spread forward (the largest node name
    that reaches a node) and each colour's root collects, backward, the nodes that also reach it; those are one
    component and leave the graph. Work per round grows with the edges, never with pairs of nodes; rounds grow with the logarithm
    of the chains.
    """
    return _components(cut_lineage(edges.select("src", "dst").where("src <> dst").distinct()))


def _components(rest: DataFrame) -> DataFrame:
    """strong_components of edges that are written, distinct and no loops."""
    found = rest.select(F.col("src").alias("node"), F.col("src").alias("component")).where(F.lit(False))
    while True:
        rest = _trim(rest)
        if rest.isEmpty():
            return found
        inner = cut_lineage(_inner_nodes(rest))
        if not inner.isEmpty():
            return found.unionByName(_contracted_components(rest, inner))
        component = _root_components(rest)
        found = found.unionByName(component)
        done = component.select("node")
        rest = cut_lineage(
            rest.join(done, rest["src"] == done["node"], "left_anti").join(
                done, F.col("dst") == done["node"], "left_anti"
            )
        )


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _single(edges: DataFrame) -> DataFrame:
    """(node, next) of the nodes with one edge out."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("next"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def _trim(rest: DataFrame) -> DataFrame:
    """Drop edges of nodes that no cycle reaches, or that reach no cycle."""
    while True:
        size = 0
        for turned in (False, True):
            way = _turned(rest) if turned else rest
            first = cut_lineage(way.join(way.select(F.col("dst").alias("src")).distinct(), "src", "left_anti").select(F.col("src").alias("node")).distinct())
            if first.isEmpty():
                continue
            size += 1
            # Nodes with one edge in go with the node at the other end of their chain.
            ends = follow(_single(_turned(way)))
            gone = first.unionByName(ends.join(first.select(F.col("node").alias("end")), "end", "left_semi").select("node"))
            kept = cut_lineage(way.join(gone.select(F.col("node").alias("src")), "src", "left_anti").select("src", "dst"))
            rest = _turned(kept) if turned else kept
        if not size:
            return rest


def _inner_nodes(edges: DataFrame) -> DataFrame:
    """(node, before, next) of the nodes with one edge in and one out."""
    return _single(edges).join(_single(_turned(edges)).withColumnRenamed("next", "before"), "node")


def _contracted_components(rest: DataFrame, inner: DataFrame) -> DataFrame:
    """Components of a graph in which the chains of inner nodes are single edges, carried over to these nodes."""
    ends = cut_lineage(follow(inner.select("node", "next")))
    rings = ends.where("end IS NULL").select("node", F.col("top").alias("component"))
    # Only chains have a head: a ring, all of whose nodes are inner ones, is not followed backward as well.
    linked = ends.where("end IS NOT NULL").select("node", "end")
    back = inner.select("node", F.col("before").alias("next")).join(linked.select("node"), "node", "left_semi")
    heads = follow(back).select("node", F.col("end").alias("head"))
    chains = cut_lineage(linked.join(heads, "node"))
    outer = rest.join(inner.select(F.col("node").alias("src")), "src", "left_anti")
    to = chains.select(F.col("node").alias("dst"), "end")
    short = cut_lineage(outer.join(to, "dst", "left").select("src", F.coalesce("end", "dst").alias("dst")).distinct())
    known = cut_lineage(strong_components(short))
    # A chain that ends where it starts is a cycle, whether its end lies on others or not.
    alone = short.where("src = dst").select(F.col("src").alias("node")).join(known, "node", "left_anti")
    known = known.unionByName(alone.select("node", F.col("node").alias("component")))
    along = chains.join(known.select(F.col("node").alias("end"), "component"), "end").join(
        known.select(F.col("node").alias("head"), F.col("component").alias("_other")), "head"
    ).where("component = _other")
    return known.unionByName(rings).unionByName(along.select("node", "component"))


def _root_components(rest: DataFrame) -> DataFrame:
    nodes = rest.select(F.col("src").alias("node")).union(rest.select("dst")).distinct()
    colour = cut_lineage(nodes.select("node", F.col("node").alias("colour")))
    while True:
        spread = rest.join(colour, rest["src"] == colour["node"]).groupBy("dst").agg(
            F.max("colour").alias("best")
        )
        grown = colour.join(spread, colour["node"] == spread["dst"], "left").select(
            "node",
            F.greatest("colour", F.coalesce("best", "colour")).alias("colour"),
            (F.col("best") > F.col("colour")).alias("_changed"),
        )
        grown = cut_lineage(grown)
        colour = grown.select("node", "colour")
        if grown.where("_changed").isEmpty():
            break
    inner = (
        rest.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("_from")), "src")
        .join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("_to")), "dst")
        .where("_from = _to")
        .select(F.col("dst").alias("_reached"), F.col("src").alias("_next"), F.col("_from").alias("component"))
    )
    inner = cut_lineage(inner)
    frontier = cut_lineage(
        colour.where("node = colour").select("node", F.col("colour").alias("component"))
    )
    parts = [frontier]
    while True:
        backward = (
            frontier.join(inner.drop("component"), frontier["node"] == inner["_reached"])
            .select(F.col("_next").alias("node"), "component")
            .distinct()
        )
        seen = parts[0]
        for part in parts[1:]:
            seen = seen.unionByName(part)
        frontier = cut_lineage(backward.join(seen.select("node"), "node", "left_anti"))
        if frontier.isEmpty():
            break
        parts.append(frontier)
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _without_chains(edges: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of an acyclic graph between nodes that branch or are kept, and (node, end) of the nodes left out."""
    pointers = _single(edges).join(kept, "node", "left_anti")
    ends = cut_lineage(follow(pointers).select("node", "end"))
    outer = edges.join(ends.select(F.col("node").alias("src")), "src", "left_anti")
    to = ends.select(F.col("node").alias("dst"), "end")
    return cut_lineage(outer.join(to, "dst", "left").select("src", F.coalesce("end", "dst").alias("dst")).distinct()), ends


def cycle_edges(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, src, dst): edges on a cycle that the seed reaches or lies on, self-loops included.

    Components become single nodes and chains between them single edges before seeds are followed, so the rounds
    grow with the branchings on the way, not with the length of chains.
    """
    distinct = cut_lineage(edges.select("src", "dst").distinct())
    component = cut_lineage(_components(distinct.where("src <> dst")))
    loops = distinct.where("src = dst").select(F.col("src").alias("node"))
    if not loops.isEmpty():
        loops = loops.join(component, "node", "left_anti")
        component = cut_lineage(component.unionByName(loops.select("node", F.col("node").alias("component"))))
    of_source = component.select(F.col("node").alias("src"), F.col("component").alias("_from"))
    of_target = component.select(F.col("node").alias("dst"), F.col("component").alias("_to"))
    ends = cut_lineage(distinct.join(of_source, "src", "left").join(of_target, "dst", "left"))
    on_cycle = ends.where("_from = _to").select(F.col("_from").alias("component"), "src", "dst")
    between = ends.select(F.coalesce("_from", "src").alias("src"), F.coalesce("_to", "dst").alias("dst")).where("src <> dst").distinct()
    goals = component.select(F.col("component").alias("node")).distinct()
    short, chained = _without_chains(between, goals)
    at = seeds.select("seed").distinct().join(component, seeds["seed"] == component["node"], "left")
    at = at.select("seed", F.coalesce("component", "seed").alias("node")).join(chained, "node", "left")
    at = cut_lineage(at.select("seed", F.coalesce("end", "node").alias("start")))
    starts = at.select(F.col("start").alias("seed")).distinct()
    reached = closure(short, starts, None).pairs.select(F.col("seed").alias("start"), "node")
    reached = reached.unionByName(starts.select(F.col("seed").alias("start"), F.col("seed").alias("node")))
    met = at.join(reached, "start").select("seed", F.col("node").alias("component"))
    return met.join(on_cycle, "component").select("seed", "src", "dst")
