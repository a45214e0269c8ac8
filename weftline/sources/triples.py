"""Triples as a table: reading, writing, building from tables, scoping and merging."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.schemas import TRIPLE_COLUMNS
from weftline.session import literal_rows, ranged, spread

# Standard vocabulary.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SHACL = "http://www.w3.org/ns/shacl#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
STANDARD_PREFIXES = (RDF, RDFS, OWL, XSD, SHACL)
RDF_TYPE, RDFS_LABEL = RDF + "type", RDFS + "label"
XSD_STRING, LANG_STRING = XSD + "string", RDF + "langString"

_TERM = r"(<[^>]*>|_:\S+)"
_LINE = rf'\A\s*{_TERM}\s+<([^>]*)>\s+(<[^>]*>|_:[^\s"]+|"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\s*\.\s*(?:#.*)?\z'

# Characters written as escapes in N-Triples text.
_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def read_ntriples(spark: SparkSession, path: str, graph: str) -> DataFrame:
    """Read an N-Triples file; a line that is neither a triple, blank nor a comment is an error."""
    lines = spark.read.text(path).where(~F.rlike(F.col("value"), F.lit(r"\A\s*(#.*)?\z")))
    return parse_ntriples(lines, "value", graph)


def parse_ntriples(lines: DataFrame, column: str, graph: str) -> DataFrame:
    line = F.col(column)
    term = F.regexp_extract(line, _LINE, 3)
    subject = F.regexp_extract(line, _LINE, 1)
    well_formed = F.rlike(line, F.lit(_LINE))
    is_literal = F.startswith(term, F.lit('"'))
    is_iri = F.startswith(term, F.lit("<"))
    lexical = F.regexp_extract(term, r'\A"([^"\\]*+(?:\\.[^"\\]*+)*+)"', 1)
    lexical = _unescape(lexical)
    lang = F.nullif(F.regexp_extract(term, r'"@([A-Za-z0-9-]+)\z', 1), F.lit(""))
    datatype = F.nullif(F.regexp_extract(term, r'"\^\^<([^>]*)>\z', 1), F.lit(""))
    bare = F.regexp_replace(term, r"\A<|>\z", "")
    return lines.select(
        F.lit(graph).alias("graph"),
        F.when(well_formed, F.regexp_replace(subject, r"\A<|>\z", ""))
        .otherwise(F.raise_error(F.concat(F.lit("not an N-Triples line: "), line)))
        .alias("s"),
        F.regexp_extract(line, _LINE, 2).alias("p"),
        F.when(is_literal, lexical).otherwise(bare).alias("o"),
        F.when(is_literal, "literal").when(is_iri, "iri").otherwise("bnode").alias("o_kind"),
        F.when(is_literal & lang.isNotNull(), LANG_STRING)
        .when(is_literal, F.coalesce(datatype, F.lit(XSD_STRING)))
        .alias("datatype"),
        F.when(is_literal, lang).alias("lang"),
    )


def _unescape(lexical: Column) -> Column:
    """Literal text without its escapes, which are those of JSON strings."""
    document = F.concat(F.lit('{"v":"'), lexical, F.lit('"}'))
    plain = F.from_json(document, "v string", {"allowUnquotedControlChars": "true"})["v"]
    refused = F.raise_error(F.concat(F.lit("unknown escape in literal: "), lexical))
    return F.when(~F.contains(lexical, F.lit("\\")), lexical).otherwise(F.coalesce(plain, refused))


def ntriples_line() -> Column:
    """One N-Triples line for the triple columns of the current row."""
    lexical = F.col("o")
    for plain, escaped in _ESCAPES:
        lexical = F.replace(lexical, F.lit(plain), F.lit(escaped))
    quoted = F.concat(F.lit('"'), lexical, F.lit('"'))
    literal = (
        F.when(F.col("lang").isNotNull(), F.concat(quoted, F.lit("@"), F.col("lang")))
        .when(F.col("datatype").isNull() | (F.col("datatype") == XSD_STRING), quoted)
        .otherwise(F.concat(quoted, F.lit("^^<"), F.col("datatype"), F.lit(">")))
    )
    obj = (
        F.when(F.col("o_kind") == "literal", literal)
        .when(F.col("o_kind") == "iri", F.concat(F.lit("<"), F.col("o"), F.lit(">")))
        .otherwise(F.col("o"))
    )
    subject = F.when(F.startswith(F.col("s"), F.lit("_:")), F.col("s")).otherwise(
        F.concat(F.lit("<"), F.col("s"), F.lit(">"))
    )
    return F.concat(subject, F.lit(" <"), F.col("p"), F.lit("> "), obj, F.lit(" ."))


def write_ntriples(triples: DataFrame, path: str, rows: int = 0) -> None:
    """Write the graph as sorted N-Triples text, one file per sort range.

    With the most triples there may be, the number of ranges follows it and equal lines meet in theirs.
    """
    ranged(triples.select(ntriples_line().alias("value")), rows, "value").write.text(path)


def to_triples(
    df: DataFrame,
    subject: Column,
    type_iri: str,
    properties: Mapping[str, tuple[str, str]],
    graph: str = "data",
) -> DataFrame:
    """Rows to triples: properties map a column to (predicate, kind), null objects are skipped.

    The kind is "iri", "@<language>" or a datatype IRI.
    """
    entries = [_entry(F.lit(RDF_TYPE), F.lit(type_iri), "iri")]
    entries += [
        _entry(F.lit(predicate), F.col(column).cast("string"), kind)
        for column, (predicate, kind) in properties.items()
    ]
    exploded = df.select(subject.alias("s"), F.inline(F.array(*entries)))
    return exploded.where(F.col("o").isNotNull()).select(
        F.lit(graph).alias("graph"), "s", "p", "o", "o_kind", "datatype", "lang"
    )


def _entry(predicate: Column, obj: Column, kind: str) -> Column:
    literal = kind != "iri"
    tagged = kind.startswith("@")
    datatype = LANG_STRING if tagged else kind
    none = F.lit(None).cast("string")
    return F.struct(
        predicate.alias("p"),
        obj.alias("o"),
        F.lit("literal" if literal else "iri").alias("o_kind"),
        (F.lit(datatype) if literal else none).alias("datatype"),
        (F.lit(kind[1:]) if tagged else none).alias("lang"),
    )


def complete_labels(triples: DataFrame, sources: Mapping[str, str], lang: str = "en") -> DataFrame:
    """Add a label to every typed node without one, from its class's source predicate.

    With several source values the smallest is used, so the result does not depend on order.
    """
    spark = triples.sparkSession
    rules = literal_rows(spark, list(sources.items()), "class string, source string")
    typed = triples.where(F.col("p") == RDF_TYPE).select("graph", "s", F.col("o").alias("class"))
    wanted = typed.join(rules, "class")
    unlabelled = wanted.join(
        triples.where(F.col("p") == RDFS_LABEL).select("s").distinct(), "s", "left_anti"
    )
    values = triples.where(F.col("p").isin(*set(sources.values()))).select(
        "s", F.col("p").alias("source"), "o"
    )
    added = (
        unlabelled.join(values, ["s", "source"])
        .groupBy("graph", "s", "class")
        .agg(F.min("o").alias("o"))
        .select(
            "graph", "s", F.lit(RDFS_LABEL).alias("p"), "o", F.lit("literal").alias("o_kind"),
            F.lit(LANG_STRING).alias("datatype"), F.lit(lang).alias("lang"),
        )
        .distinct()
    )
    return triples.unionByName(added)


def scope(triples: DataFrame, prefixes: Iterable[str]) -> DataFrame:
    """Keep triples whose every IRI term starts with an allowed or a standard prefix."""
    allowed = (*prefixes, *STANDARD_PREFIXES)

    def inside(term: Column) -> Column:
        found = F.lit(False)
        for prefix in allowed:
            found = found | F.startswith(term, F.lit(prefix))
        return found

    subject_ok = F.startswith(F.col("s"), F.lit("_:")) | inside(F.col("s"))
    object_ok = (F.col("o_kind") != "iri") | inside(F.col("o"))
    return triples.where(subject_ok & inside(F.col("p")) & object_ok)


def merge_graphs(graphs: Sequence[DataFrame], name: str | None = None, rows: int = 0) -> DataFrame:
    """Union with set semantics; under a common name equal triples of two graphs are one.

    With the most triples there may be, equal ones meet in tasks whose number follows it, and none is held before.
    """
    merged = graphs[0]
    for other in graphs[1:]:
        merged = merged.unionByName(other)
    if name is not None:
        merged = merged.withColumn("graph", F.lit(name))
    return spread(merged.select(*TRIPLE_COLUMNS), rows, "s", "o").distinct()


def typed_bindings(bindings: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast bound lexical values to native types; unbound or ill-formed values become null."""
    return bindings.select(
        *[
            F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c)
            for c in bindings.columns
        ]
    )
