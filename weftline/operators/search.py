"""Note search over a notes relation, and the stepwise relaxation of empty requests."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.operators.closure import MAX_DEPTH, Closure, closure
from weftline.operators.graph import zero_or_more_path
from weftline.session import written

# Result size, steps and reasons of a relaxation.
TOP_NOTES = 25
BUDGET = 3
DROP_BOUNDS, WIDEN_COMPONENT = "RELAX_SUPPORT_PACKAGE", "WIDEN_COMPONENT"
EMPTY_STRICT, MISSING_ENTITY = "EMPTY_STRICT_RESULT", "MISSING_REQUIRED_ENTITY"

EQUALS = ("note_number", "alert_code", "component_code", "product_version", "priority")
SLOTS = (*EQUALS, "support_package")
ANCHORS = ("note_number", "alert_code", "component_code")


@dataclass(frozen=True)
class NoteGraph:
    """Notes and their links as narrow tables.

    notes: note, note_number, title, min_sp, max_sp, priority; alerts: note, alert_code;
    components: note, component_code (directly affected); versions: note, product_version;
    parents: component_code, parent_code. A slot no request uses may stay None.
    """

    notes: DataFrame
    alerts: DataFrame | None = None
    components: DataFrame | None = None
    versions: DataFrame | None = None
    parents: DataFrame | None = None


def component_ancestors(parents: DataFrame) -> DataFrame:
    """(component_code, ancestor): each component with itself and everything above it."""
    links = parents.where("parent_code IS NOT NULL").select(
        F.col("component_code").alias("src"), F.col("parent_code").alias("dst")
    )
    closed = zero_or_more_path(links)
    return closed.select(F.col("src").alias("component_code"), F.col("dst").alias("ancestor"))


def range_join(
    requests: DataFrame, notes: DataFrame, keys: Sequence[str], value: str, low: str, high: str
) -> DataFrame:
    """Requests whose value lies in a note's range: equal keys first, the range as residual."""
    if not keys:
        raise ValueError("a range join needs at least one equal key")
    inside = F.col(value).between(F.col(low), F.col(high))
    return requests.join(notes, list(keys)).where(inside)


def is_anchored(requests: DataFrame) -> Column:
    """Whether a request fills one of the slots a search starts from."""
    filled = [F.col(c).isNotNull() for c in ANCHORS if c in requests.columns]
    return reduce(lambda a, b: a | b, filled, F.lit(False))


def rejected_requests(requests: DataFrame) -> DataFrame:
    """(request_id, reason) of requests that no search can start from; the others are searched."""
    return requests.where(~is_anchored(requests)).select("request_id", F.lit(MISSING_ENTITY).alias("reason"))


def note_search(
    requests: DataFrame,
    graph: NoteGraph,
    top: int = TOP_NOTES,
    ancestors: DataFrame | None = None,
) -> DataFrame:
    """The newest matching notes of every request: (request_id, note, note_number, title, rank).

    A request column that is null does not constrain; a request without an anchor has no row
    (rejected_requests names it). Requests with the same constraints are searched once. They are
    split by which equal slots they fill, at most 32 ways, so that every split is a plain equi
    join; the package range is a residual condition. The top notes are cut per search, with a
    partial cut before the shuffle, and only they meet the requests.
    """
    asked = written(_asked(requests), "asked")
    found = _matches(asked, graph, top, ancestors).where("in_bounds")
    return _met(asked, found)


def _asked(requests: DataFrame) -> DataFrame:
    """Requests that can be searched, with the slots they have."""
    slots = _slots(requests)
    if not slots:
        raise ValueError("requests have no slot column")
    return requests.where(is_anchored(requests)).select("request_id", *slots)


def _slots(requests: DataFrame) -> list[str]:
    return [c for c in SLOTS if c in requests.columns]


def _met(asked: DataFrame, found: DataFrame) -> DataFrame:
    """Requests with the rows of their search."""
    # Equal null-safe keys as plain keys: each slot as a value and whether it is filled.
    same = reduce(lambda a, b: a & b, [asked[c].eqNullSafe(found[f"want_{c}"]) for c in _slots(asked)])
    return asked.join(found, same).select(asked["request_id"], *[found[c] for c in ("note", "note_number", "title", "rank")])


def _matches(asked: DataFrame, graph: NoteGraph, top: int, ancestors: DataFrame | None, beyond: bool = False) -> DataFrame:
    """The top matches of every distinct search, with in_bounds; matches out of bounds are kept if asked for.

    Components are raised only to those that a search names, so that a note has no row for every level above it.
    """
    slots = _slots(asked)
    searches = asked.select(*[F.col(c).alias(f"want_{c}") for c in slots]).distinct()
    equal = [c for c in slots if c in EQUALS]
    filled = asked.select(*[F.col(c).isNotNull().alias(c) for c in equal]).distinct()
    masks = [[c for c in equal if row[c]] for row in filled.collect()]
    if any("component_code" in m for m in masks):
        if ancestors is None and graph.parents is not None:
            ancestors = component_ancestors(graph.parents)
        if ancestors is not None:
            named = asked.select(F.col("component_code").alias("ancestor")).distinct()
            ancestors = written(ancestors.join(named, "ancestor", "left_semi").select("component_code", "ancestor"), "ancestors")
    # One split needs no test of which slots are filled.
    parts = [_search_mask(searches, slots, mask, len(masks) > 1, graph, ancestors, top, beyond) for mask in masks]
    return reduce(DataFrame.unionByName, parts) if parts else _no_matches(asked, graph)


def _no_matches(asked: DataFrame, graph: NoteGraph) -> DataFrame:
    wants = [F.lit(None).cast(asked.schema[c].dataType).alias(f"want_{c}") for c in _slots(asked)]
    return graph.notes.where(F.lit(False)).select(
        *wants, "note", "note_number", "title", F.lit(True).alias("in_bounds"), F.lit(0).alias("rank")
    )


def _offered_notes(
    mask: Sequence[str], bounded: bool, graph: NoteGraph, ancestors: DataFrame | None
) -> DataFrame:
    """Notes with a column per filled slot; number and title are required."""
    extra = [c for c in ("priority",) if c in mask]
    bounds = ["min_sp", "max_sp"] if bounded else []
    offered = graph.notes.where("note_number IS NOT NULL AND title IS NOT NULL").select(
        "note", "note_number", "title", *extra, *bounds
    )
    if "alert_code" in mask:
        offered = offered.join(graph.alerts.select("note", "alert_code").distinct(), "note")
    if "product_version" in mask:
        offered = offered.join(graph.versions.select("note", "product_version").distinct(), "note")
    if "component_code" in mask:
        offered = offered.join(covered_components(graph, ancestors), "note")
    return offered


def covered_components(graph: NoteGraph, ancestors: DataFrame | None) -> DataFrame:
    """(note, component_code): the components a note affects and everything above them."""
    affected = graph.components.select("note", "component_code")
    if ancestors is None:
        return affected.distinct()
    raised = affected.join(ancestors, "component_code", "left")
    return raised.select("note", F.coalesce("ancestor", "component_code").alias("component_code")).distinct()


def _search_mask(
    searches: DataFrame,
    slots: Sequence[str],
    mask: Sequence[str],
    several: bool,
    graph: NoteGraph,
    ancestors: DataFrame | None,
    top: int,
    beyond: bool,
) -> DataFrame:
    wanted = searches
    for slot in [c for c in slots if c in EQUALS and several]:
        value = F.col(f"want_{slot}")
        wanted = wanted.where(value.isNotNull() if slot in mask else value.isNull())
    bounded = "support_package" in slots
    offered = _offered_notes(mask, bounded, graph, ancestors)
    equal = [wanted[f"want_{c}"] == offered[c] for c in EQUALS if c in mask]
    matched = wanted.join(offered, reduce(lambda a, b: a & b, equal))
    inside = F.lit(True)
    if bounded:
        package = F.col("want_support_package")
        inside = F.coalesce(package.isNull() | package.between(F.col("min_sp"), F.col("max_sp")), F.lit(False))
    matched = matched.withColumn("in_bounds", inside)
    if not beyond:
        matched = matched.where("in_bounds")
    wants = [f"want_{c}" for c in slots]
    newest = Window.partitionBy(*wants, "in_bounds").orderBy(F.col("note_number").desc(), F.col("note"))
    ranked = matched.select(*wants, "note", "note_number", "title", "in_bounds").withColumn(
        "rank", F.row_number().over(newest)
    )
    return ranked.where(F.col("rank") <= top)


def prerequisite_search(
    targets: DataFrame, edge_set: DataFrame, notes: DataFrame, top: int = TOP_NOTES, max_depth: int = MAX_DEPTH
) -> tuple[DataFrame, Closure]:
    """Prerequisites of each target note that have a number and a title, lowest numbers first.

    targets has seed; notes has note, note_number, title. The target itself never counts.
    """
    result = closure(edge_set, targets, max_depth)
    titled = notes.where("note_number IS NOT NULL AND title IS NOT NULL")
    found = result.pairs.withColumnRenamed("node", "note").join(titled, "note")
    lowest = Window.partitionBy("seed").orderBy("note_number", "note")
    ranked = found.withColumn("rank", F.row_number().over(lowest)).where(F.col("rank") <= top)
    return ranked.select("seed", "note", "note_number", "title", "distance", "rank"), result


@dataclass(frozen=True)
class Relaxed:
    """Strict results, relaxed candidates, one ledger row per step tried, requests not searched, and those that were."""

    strict: DataFrame
    relaxed: DataFrame
    attempts: DataFrame
    rejected: DataFrame
    searched: DataFrame


def parent_by_code(code):
    """Named alternative to the parent table: the code without its last dash-separated part."""
    parent = F.regexp_extract(code, r"\A(.*)-[^-]*\z", 1)
    return F.nullif(parent, F.lit(""))


def widen(requests: DataFrame, parents: DataFrame | None) -> DataFrame:
    """Requests that have a component with a parent, moved to that parent."""
    if parents is None:
        wider = requests.withColumn("_parent", parent_by_code(F.col("component_code")))
    else:
        above = parents.where("parent_code IS NOT NULL").select(
            "component_code", F.col("parent_code").alias("_parent")
        )
        wider = requests.join(above, "component_code")
    wider = wider.where("_parent IS NOT NULL").withColumn("component_code", F.col("_parent"))
    return wider.select(*requests.columns)


def relax_search(
    requests: DataFrame,
    graph: NoteGraph,
    top: int = TOP_NOTES,
    budget: int = BUDGET,
    by_code: bool = False,
) -> Relaxed:
    """Strict search; what stays empty drops its package bounds, then widens its component.

    Both steps follow the order given and a request stops at its first non-empty step. One join
    gives the matches inside and outside the bounds: the strict result is those inside, the
    first step those of requests without any inside; only the rest goes to the search of the
    parents. The strict status of a relaxed request stays empty: candidates are a separate
    table, and one request's result never ends another's search; requests without an anchor
    are rejected. attempts holds one row per request and step run, with the changed slots and
    the number of bindings. Building the result runs the searches; their matches are written once for each distinct
    search and meet the requests where strict or relaxed is read.
    """
    requests = written(requests, "requests")
    rejected = rejected_requests(requests)
    asked = _asked(requests)
    parents = graph.parents
    above = None
    if graph.components is not None and parents is not None and "component_code" in requests.columns:
        above = component_ancestors(parents)
    graph = replace(graph, parents=None)
    bounds = "support_package" in requests.columns
    drops, step = bounds and budget > 0, 0
    found, tried = _tried(asked, graph, top, above, drops)
    strict = _met(asked, found.where("in_bounds"))
    attempts = [_attempts(tried, "_inside", 0, EMPTY_STRICT, "")]
    relaxed: list[DataFrame] = []
    empty = tried.where("_inside = 0")
    if drops:
        step += 1
        attempts.append(_attempts(empty.where("support_package IS NOT NULL"), "_outside", step, DROP_BOUNDS, "support_package"))
        relaxed.append(_tagged(_met(empty, found.where("NOT in_bounds")), step, DROP_BOUNDS))
    if "component_code" in requests.columns and budget > step:
        step += 1
        pending = empty.where("_outside = 0").select(*asked.columns)
        if drops:
            pending = pending.withColumn("support_package", F.lit(None).cast(requests.schema["support_package"].dataType))
        wider = written(widen(pending, None if by_code else parents), "wider")
        # A widened request still names its component, so it can be searched.
        found, tried = _tried(wider, graph, top, above, False)
        attempts.append(_attempts(tried, "_inside", step, WIDEN_COMPONENT, "component"))
        relaxed.append(_tagged(_met(wider, found), step, WIDEN_COMPONENT))
    candidates = (
        reduce(DataFrame.unionByName, relaxed)
        if relaxed
        else _tagged(strict.where(F.lit(False)), 0, "NONE")
    )
    return Relaxed(strict, candidates, reduce(DataFrame.unionByName, attempts), rejected, asked.select("request_id"))


def _tried(asked: DataFrame, graph: NoteGraph, top: int, above: DataFrame | None, beyond: bool) -> tuple[DataFrame, DataFrame]:
    """The matches of each distinct search, and the requests with how many they have inside and outside their bounds.

    Requests meet one row of counts, not their matches, of which there may be ``top`` for each. Requests that share an identifier
    share their counts.
    """
    found = written(_matches(asked, graph, top, above, beyond), "found")
    inside, wants = F.col("in_bounds").cast("long"), [c for c in found.columns if c.startswith("want_")]
    counts = found.groupBy(*wants).agg(F.sum(inside).alias("_in"), F.sum(1 - inside).alias("_out"))
    counts = written(counts, "counts")
    same = reduce(lambda a, b: a & b, [asked[c].eqNullSafe(counts[f"want_{c}"]) for c in _slots(asked)])
    again = asked.groupBy("request_id").count().where("count > 1").select(F.col("request_id").alias("_id"), F.lit(True).alias("_again"))
    again = written(again, "repeated")
    totals = [F.coalesce(n, F.lit(0).cast("bigint")).alias(name) for n, name in (("_in", "_inside"), ("_out", "_outside"))]
    counted = asked.join(counts, same, "left").select(*asked.columns, *totals)
    # Only requests that share their identifier move to each other.
    counted = written(counted.join(again, counted["request_id"].eqNullSafe(again["_id"]), "left").drop("_id"), "counted")
    own = Window.partitionBy("request_id")
    shared = counted.where("_again").withColumns({n: F.sum(n).over(own) for n in ("_inside", "_outside")})
    return found, counted.where("_again IS NULL").unionByName(shared).drop("_again")


def _tagged(found: DataFrame, step: int, reason: str) -> DataFrame:
    return found.withColumn("step", F.lit(step)).withColumn("reason", F.lit(reason))


def _attempts(tried: DataFrame, count: str, step: int, reason: str, changed: str) -> DataFrame:
    bindings = F.col(count)
    return tried.select(
        "request_id",
        F.lit(step).alias("step"),
        (F.when(bindings > 0, "NONE").otherwise(reason) if reason == EMPTY_STRICT else F.lit(reason)).alias("reason"),
        F.lit(changed).alias("changed"),
        bindings.alias("bindings"),
    )


def relaxation_outcome(requests: DataFrame, result: Relaxed) -> DataFrame:
    """Per request: strict status, scope of what it got, last step, reason and binding count.

    A request that was not searched is UNSUPPORTED, with the reason.
    """
    last = result.attempts.groupBy("request_id").agg(
        F.max_by(F.struct("step", "reason", "bindings"), "step").alias("last"),
        F.max(F.when(F.col("step") == 0, F.col("bindings"))).alias("_strict"),
    )
    joined = requests.select("request_id").join(last, "request_id")
    strict_hit = F.col("_strict") > 0
    scope = F.when(strict_hit, "strict").when(F.col("last.bindings") > 0, "relaxed").otherwise("none")
    searched = joined.select(
        "request_id",
        F.when(strict_hit, "SUCCESS").otherwise("EMPTY_RESULT").alias("status"),
        scope.alias("scope"),
        F.col("last.step").alias("step"),
        F.when(strict_hit, "NONE").otherwise(F.col("last.reason")).alias("reason"),
        F.col("last.bindings").alias("bindings"),
    )
    refused = result.rejected.select(
        "request_id", F.lit("UNSUPPORTED").alias("status"), F.lit("none").alias("scope"), F.lit(0).alias("step"), "reason",
        F.lit(0).cast("bigint").alias("bindings"),
    )
    return searched.unionByName(refused)
