"""Triple patterns, property paths and existence over a triples table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.closure import closure
from weftline.session import written
from weftline.sources.triples import RDF_TYPE, XSD_STRING


@dataclass(frozen=True)
class Literal:
    """A literal constant in a pattern."""

    value: str
    datatype: str | None = XSD_STRING
    lang: str | None = None


Term = str | Literal
Pattern = tuple[Term, Term, Term]


def _variable(term: Term) -> str | None:
    return term[1:] if isinstance(term, str) and term.startswith("?") else None


def _variables(pattern: Pattern) -> list[str]:
    return list(dict.fromkeys(v for v in map(_variable, pattern) if v))


def _matches(position: str, term: Term) -> Column:
    if isinstance(term, Literal):
        same = (F.col("o_kind") == "literal") & (F.col("o") == term.value)
        if term.datatype is not None:
            same = same & (F.col("datatype") == term.datatype)
        return same & (F.col("lang") == term.lang) if term.lang else same
    same = F.col(position) == term
    return same & (F.col("o_kind") != "literal") if position == "o" else same


def _tag(variable: str) -> str:
    return f"__{variable}_term"


def _scan(triples: DataFrame, pattern: Pattern, tagged: set[str], nodes: set[str]) -> DataFrame:
    """One filtered scan of a pattern, with variables as columns."""
    kept = triples
    for position, term in zip("spo", pattern, strict=True):
        if _variable(term) is None:
            kept = kept.where(_matches(position, term))
    columns: dict[str, Column] = {}
    for position, term in zip("spo", pattern, strict=True):
        name = _variable(term)
        if name is None:
            continue
        if position == "o" and name in nodes:
            kept = kept.where(F.col("o_kind") != "literal")
        if name in columns:
            kept = kept.where(columns[name] == F.col(position))
        else:
            columns[name] = F.col(position)
            if name in tagged:
                columns[_tag(name)] = F.concat_ws("|", "o_kind", "datatype", "lang")
    return kept.select(*[c.alias(n) for n, c in columns.items()])


def _ordered(patterns: Sequence[Pattern], sizes: Mapping[str, int]) -> list[Pattern]:
    """Most selective first (constants, then known predicate size), each joined to the last ones."""

    def weight(pattern: Pattern) -> tuple[int, int]:
        constants = sum(1 for term in pattern if _variable(term) is None)
        return (-constants, sizes.get(pattern[1], 0) if isinstance(pattern[1], str) else 0)

    rest = sorted(dict.fromkeys(patterns), key=weight)
    chosen, bound = [rest.pop(0)], set()
    bound.update(_variables(chosen[0]))
    while rest:
        linked = next((p for p in rest if bound & set(_variables(p))), None)
        if linked is None:
            raise ValueError(f"patterns share no variable with the others: {rest}")
        rest.remove(linked)
        chosen.append(linked)
        bound.update(_variables(linked))
    return chosen


def _join_tree(patterns: Sequence[Pattern]) -> list[tuple[Pattern, Pattern]] | None:
    """(pattern, the pattern it hangs on) from the leaves to the root, which is the first pattern left; None if cyclic.

    A pattern can be cut off if some other one has all the variables it shares with the rest.
    """
    rest, cut = list(patterns), []
    while len(rest) > 1:
        for leaf in reversed(rest):
            others = [p for p in rest if p != leaf]
            shared = set(_variables(leaf)) & {v for p in others for v in _variables(p)}
            holder = next((p for p in others if shared and shared <= set(_variables(p))), None)
            if holder is not None:
                cut.append((leaf, holder))
                rest.remove(leaf)
                break
        else:
            return None
    return cut


def _shared(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in right.columns if c in left.columns]


def _joined_by_tree(scans: dict[Pattern, DataFrame], tree: list[tuple[Pattern, Pattern]]) -> DataFrame:
    """Semi-joins from the leaves up, then joins from the root down.

    After the semi-joins every row of a pattern has partners all the way down, so what is joined from the root on is
    never more than the result: a hub whose other patterns match nothing is gone before it is multiplied. Patterns that
    were reduced and hang on others are written, as they are read twice.
    """
    reduced = dict(scans)
    for leaf, holder in tree:
        if reduced[leaf] is not scans[leaf]:
            reduced[leaf] = written(reduced[leaf], "pattern")
        shared = _shared(reduced[holder], reduced[leaf])
        reduced[holder] = reduced[holder].join(reduced[leaf].select(*shared), shared, "left_semi")
    result = reduced[tree[-1][1]]
    for leaf, _ in reversed(tree):
        result = result.join(reduced[leaf], _shared(result, reduced[leaf]))
    return result


def bgp(
    triples: DataFrame, patterns: Sequence[Pattern], sizes: Mapping[str, int] | None = None
) -> DataFrame:
    """Natural join of triple patterns on their shared variables ("?name").

    Constants are filters on the scan, equal patterns are used once, and patterns that would
    need a cross product are refused. An object variable joins as a whole term, so literals of
    different type do not meet. Three and more patterns that form a tree are reduced by semi-joins first, so
    that nothing joined on the way exceeds the triples and the result together; patterns that
    close a circle are joined in order. Bindings are made distinct once, at the end.
    """
    ordered = _ordered(patterns, sizes or {})
    nodes = {v for p in ordered for v in map(_variable, p[:2]) if v}
    objects = [v for p in ordered if (v := _variable(p[2])) and v not in nodes]
    tagged = {v for v in objects if objects.count(v) > 1}
    scans = {p: _scan(triples, p, tagged, nodes) for p in ordered}
    tree = _join_tree(ordered) if len(ordered) > 2 else None
    if tree:
        result = _joined_by_tree(scans, tree)
    else:
        result = scans[ordered[0]]
        for pattern in ordered[1:]:
            result = result.join(scans[pattern], _shared(result, scans[pattern]))
    return result.distinct().drop(*[_tag(v) for v in tagged])


def optional(bindings: DataFrame, triples: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """Keep every binding and add the optional patterns' variables, null where unmatched."""
    right = bgp(triples, patterns)
    shared = [c for c in right.columns if c in bindings.columns]
    if not shared:
        raise ValueError("optional patterns share no variable with the bindings")
    return bindings.join(right, shared, "left")


def edges(triples: DataFrame, predicate: str) -> DataFrame:
    """Distinct edges (src, dst) of one predicate between nodes."""
    found = triples.where((F.col("p") == predicate) & (F.col("o_kind") != "literal"))
    return found.select(F.col("s").alias("src"), F.col("o").alias("dst")).distinct()


def sequence_path(first: DataFrame, second: DataFrame) -> DataFrame:
    """Edges of first followed by edges of second."""
    step = second.select(F.col("src").alias("_via"), F.col("dst").alias("_end"))
    joined = first.withColumnRenamed("dst", "_via").join(step, "_via")
    return joined.select("src", F.col("_end").alias("dst")).distinct()


def alternative_path(first: DataFrame, second: DataFrame) -> DataFrame:
    """Edges of either set."""
    return first.unionByName(second).distinct()


def zero_or_more_path(
    edge_set: DataFrame, nodes: DataFrame | None = None, max_depth: int | None = None
) -> DataFrame:
    """(src, dst) for every node and itself or anything reachable from it.

    nodes (column node) limits the starting points; by default every edge end is one.
    """
    if nodes is None:
        nodes = edge_set.select(F.col("src").alias("node")).union(edge_set.select("dst")).distinct()
    start = nodes.select(F.col("node").alias("seed"))
    reached = closure(edge_set, start, max_depth).pairs
    itself = start.select(F.col("seed").alias("src"), F.col("seed").alias("dst"))
    return reached.select(F.col("seed").alias("src"), F.col("node").alias("dst")).union(itself).distinct()


def ask(bindings: DataFrame) -> bool:
    """Whether a pattern has any match."""
    return not bindings.isEmpty()


def exists_per_request(requests: DataFrame, bindings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requests that have at least one binding."""
    return requests.join(bindings, list(keys), "left_semi")


def missing_per_request(requests: DataFrame, bindings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requests that have none."""
    return requests.join(bindings, list(keys), "left_anti")


def exclude_target(bindings: DataFrame, node: str, target: str) -> DataFrame:
    return bindings.where(F.col(node) != F.col(target))


def node_table(triples: DataFrame, type_iri: str, columns: Mapping[str, str]) -> DataFrame:
    """Nodes of a class as rows, one column per single-valued predicate, in one pass.

    A star of patterns costs one shuffle by subject instead of one join per predicate. A
    missing value is null; of several values the smallest is kept.
    """
    wanted = triples.where(
        F.col("p").isin(*columns.values()) | ((F.col("p") == RDF_TYPE) & (F.col("o") == type_iri))
    )
    values = [F.min(F.when(F.col("p") == p, F.col("o"))).alias(c) for c, p in columns.items()]
    typed = F.bool_or(F.col("p") == RDF_TYPE).alias("_typed")
    return wanted.groupBy(F.col("s").alias("node")).agg(typed, *values).where("_typed").drop("_typed")


def canonical_order(bindings: DataFrame, keys: Sequence[str] = ("note_number", "note")) -> DataFrame:
    """Stable order: by the keys, then by the whole row as JSON."""
    present = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys if k in bindings.columns]
    document = F.to_json(F.struct(*sorted(bindings.columns)), {"ignoreNullFields": "false"})
    return bindings.sort(*present, document)
