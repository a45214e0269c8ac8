"""Grounding texts in a vocabulary and in a request lexicon."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.numbers import count_threshold, money_threshold, support_package
from weftline.functions.text import boundary_tokens, fold_case, normalize_term, plural_variants
from weftline.operators.lexicon import COMPILED_BYTES, Compiled, bit_filter, compile_entries, has
from weftline.session import cut_lineage, literal_rows, written

_WORD = r"[\p{L}\p{N}_]+"
_NO_WORD = r"[^\p{L}\p{N}_]+"
#: Bits of the filter of a lexicon that is not compiled: a literal of 512 KB.
REST_BITS = 1 << 22


def vocabulary(concepts: DataFrame, local_values: DataFrame | None = None) -> DataFrame:
    """(concept_id, term, ordinal): the terms that name a concept, in the order they are tried.

    concepts: id, name, synonyms. Name and synonyms come first, each followed by its plural;
    local_values (canonical_value, local_value, ordinal) follow, for known concepts only.
    """
    names = F.array_prepend(F.coalesce("synonyms", F.array().cast("array<string>")), F.col("name"))
    terms = concepts.select(F.col("id").alias("concept_id"), F.posexplode(names).alias("_at", "_name"))
    terms = terms.select(
        "concept_id", "_at", F.posexplode(plural_variants(F.col("_name"))).alias("_variant", "term")
    ).select(
        "concept_id", "term", F.array(F.lit(0), F.col("_at"), F.col("_variant")).cast("array<bigint>").alias("ordinal")
    )
    if local_values is not None:
        local = local_values.join(
            concepts.select(F.col("id").alias("canonical_value")), "canonical_value", "left_semi"
        ).select(
            F.col("canonical_value").alias("concept_id"),
            normalize_term(F.col("local_value")).alias("term"),
            F.array(F.lit(1), F.col("ordinal"), F.lit(0)).cast("array<bigint>").alias("ordinal"),
        )
        terms = terms.unionByName(local)
    return terms.where("term <> ''").groupBy("concept_id", "term").agg(F.min("ordinal").alias("ordinal"))


def _runs(words: int, starts: Column) -> Column:
    """Runs of so many words from the given places, as (before, phrase, after, at_start, at_end)."""

    def at(i: Column) -> Column:
        pieces = [F.get("_words", i)]
        for k in range(1, words):
            pieces += [F.get("_gaps", i + k), F.get("_words", i + k)]
        return F.struct(
            F.get("_gaps", i).alias("before"),
            F.concat(*pieces).alias("phrase"),
            F.get("_gaps", i + words).alias("after"),
            (i == 0).alias("at_start"),
            (i + words == F.size("_words")).alias("at_end"),
        )

    return F.transform(F.filter(starts, lambda i: i + words <= F.size("_words")), at)


def ground_terms(texts: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, concept_id, term): concepts named in each text as whole words, first term in order.

    The text is cut into runs of as many words as some term has, and runs meet terms by an
    equal join, so a text is never compared with every term. Marks a term starts or ends with
    are checked against the gaps around the run.
    """
    split = terms.select(
        "concept_id", "term", "ordinal",
        F.regexp_extract("term", rf"\A[^\p{{L}}\p{{N}}_]*({_WORD}(?:.*{_WORD})?)[^\p{{L}}\p{{N}}_]*\z", 1).alias("phrase"),
        F.regexp_extract("term", r"\A([^\p{L}\p{N}_]*)", 1).alias("_prefix"),
        F.regexp_extract("term", r"([^\p{L}\p{N}_]*)\z", 1).alias("_suffix"),
    )
    shape = split.select(
        F.size(F.regexp_extract_all("phrase", F.lit(f"({_WORD})"))).alias("n"),
        F.regexp_extract("phrase", rf"\A({_WORD})", 1).alias("first"),
    )
    sizes = sorted(row["n"] for row in shape.select("n").distinct().collect())
    if 0 in sizes:
        raise ValueError("a term needs at least one word")
    if not sizes:
        return texts.select(key, F.lit("").alias("concept_id"), F.lit("").alias("term")).where(F.lit(False))
    normal = normalize_term(F.col(text))
    cut = texts.select(
        key,
        F.array_remove(F.split(normal, _NO_WORD), "").alias("_words"),
        F.split(normal, _WORD).alias("_gaps"),
    )
    starts = F.when(F.size("_words") > 0, F.sequence(F.lit(0), F.size("_words") - 1)).otherwise(
        F.array().cast("array<int>")
    )
    # Runs that begin with no term's first word are dropped in the row, by a filter of fixed size; the few others
    # that pass it meet no term in the join.
    opens = bit_filter(shape.select("first"))
    starts = F.filter(starts, lambda i: opens(F.get("_words", i)))
    # The places are kept in a frame of their own: they are used once per size.
    placed = cut.select(key, "_words", "_gaps", F.explode(F.array(starts)).alias("_starts"))
    runs = reduce(lambda a, b: F.concat(a, b), [_runs(n, F.col("_starts")) for n in sizes])
    found = placed.select(key, F.inline(runs))
    matched = found.join(split, "phrase")
    prefix_ok = (F.col("_prefix") == "") | (
        F.endswith("before", F.col("_prefix"))
        & (F.col("at_start") | (F.length("before") > F.length("_prefix")))
    )
    suffix_ok = (F.col("_suffix") == "") | (
        F.startswith("after", F.col("_suffix"))
        & (F.col("at_end") | (F.length("after") > F.length("_suffix")))
    )
    return (
        matched.where(prefix_ok & suffix_ok)
        .groupBy(key, "concept_id")
        .agg(F.min_by("term", "ordinal").alias("term"))
    )


# Grammar words of support requests.
FILLERS = (
    "addressing", "addresses", "alert", "any", "an", "a", "affect", "all", "applied", "and", "application", "are",
    "at", "be", "before", "component", "directly", "database", "dependencies", "dependency", "details",
    "distribution", "does", "dump", "errors", "error", "affecting", "for", "find", "fixes", "fixing", "has", "have",
    "in", "is", "identify", "information", "list", "logged", "management", "memory", "note", "notes", "must", "of",
    "or", "on", "package", "prerequisite", "prerequisites", "required", "resolve", "resolves", "resolving",
    "retrieve", "runtime", "sales", "sap", "support", "the", "title", "under", "valid", "what", "which",
)
LOOKUP_VERBS = ("find", "get", "identify", "retrieve", "what", "which")
QUESTION_WORDS = ("find", "get", "identify", "what", "which", "list", "does")
PREREQUISITE_MARKERS = ("dependency", "dependencies", "prerequisite", "prerequisites")
UNSUPPORTED_MARKERS = ("explain", "recommend", "summarize")
PRIORITIES = {"very high": "Very High", "high": "High", "medium": "Medium", "low": "Low"}

FAMILIES = (
    "component_code", "alert_code", "product_version", "software_component",
    "support_package", "note_number", "priority",
)
LEXICON_SCHEMA = "family string, surface string, canonical string"


def lexicon(
    spark: SparkSession,
    alerts: Sequence[str] = (),
    components: Sequence[str] = (),
    software: Sequence[str] = (),
    versions: Sequence[tuple[str, str]] = (),
    cues: Sequence[str] = ("s/4hana",),
) -> DataFrame:
    """A lexicon table from lists; versions are (two-word label, code) pairs."""
    rows = [("alert_code", v, v) for v in alerts]
    rows += [("component_code", v, v) for v in components]
    rows += [("software_component", v, v) for v in software]
    rows += [("product_version", code, code) for _, code in versions]
    rows += [("product_label", label, code) for label, code in versions]
    rows += [("product_cue", cue, cue) for cue in cues]
    return literal_rows(spark, rows, LEXICON_SCHEMA)


def _by_surface(entries: DataFrame) -> DataFrame:
    """One row per surface with its canonical value in each family."""
    families = ("alert_code", "component_code", "software_component", "product_version", "product_label", "product_cue")
    folded = entries.select("family", fold_case(F.col("surface")).alias("surface"), "canonical")
    return folded.groupBy("surface").agg(
        *[F.min(F.when(F.col("family") == f, F.col("canonical"))).alias(f) for f in families]
    )


def request_tokens(
    texts: DataFrame, entries: DataFrame, key: str = "doc_id", text: str = "text", keep_empty: bool = False
) -> DataFrame:
    """Tokens with their neighbours and lexicon entries, one row per token.

    Neighbours come from shifted arrays within the row. The lexicon is joined on the token,
    the next token and both two-token labels. A text without tokens has no row, or one
    without a token if asked for.
    """
    none = F.array(F.lit(None).cast("string"))
    listed = texts.select(key, boundary_tokens(F.col(text)).alias("_t"))
    size = F.size("_t")
    before1 = F.concat(none, F.slice("_t", F.lit(1), F.greatest(size - 1, F.lit(0))))
    before2 = F.concat(none, none, F.slice("_t", F.lit(1), F.greatest(size - 2, F.lit(0))))
    after1 = F.concat(F.slice("_t", 2, F.greatest(size, F.lit(1))), none)
    after2 = F.concat(F.slice("_t", 3, F.greatest(size, F.lit(1))), none, none)
    zipped = F.arrays_zip(
        F.col("_t").alias("token"), before1.alias("b1"), before2.alias("b2"),
        after1.alias("a1"), after2.alias("a2"), F.sequence(F.lit(1), F.greatest(size, F.lit(1))).alias("pos"),
    )
    tokens = listed.select(key, F.inline_outer(zipped)) if keep_empty else listed.select(key, F.inline(zipped))
    tokens = tokens if keep_empty else tokens.where("token IS NOT NULL")
    # The lexicon is read four times: write it once.
    surfaces = cut_lineage(_by_surface(entries))

    def lookup(prefix: str) -> DataFrame:
        return surfaces.select(*[F.col(c).alias(f"{prefix}_{c}") for c in surfaces.columns])

    own, following = lookup("t"), lookup("n")
    ahead, behind = lookup("l"), lookup("k")
    return (
        tokens.withColumn("_ahead", F.concat("token", F.lit(" "), "a1"))
        .withColumn("_behind", F.concat("b1", F.lit(" "), "token"))
        .join(own, F.col("token") == F.col("t_surface"), "left")
        .join(following, F.col("a1") == F.col("n_surface"), "left")
        .join(ahead.select("l_surface", "l_product_label"), F.col("_ahead") == F.col("l_surface"), "left")
        .join(behind.select("k_surface", "k_product_label"), F.col("_behind") == F.col("k_surface"), "left")
    )


def _is_note(token: Column) -> Column:
    return F.rlike(token, F.lit(r"\A\d{7}\z"))


def _priority(first: Column, second: Column) -> Column:
    """The priority that the tokens after the word priority name, else null."""
    value = F.lit(None).cast("string")
    for surface, canonical in PRIORITIES.items():
        words = surface.split()
        same = (first == words[0]) & (second == words[1]) if len(words) == 2 else first == words[0]
        value = F.when(same, canonical).otherwise(value)
    return value


def _slot(family: str, value: Column) -> Column:
    return F.struct(F.lit(family).alias("family"), value.alias("value"))


def extract_slots(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, family, value, first_pos): distinct slot values per text, from joined tokens.

    Tokens that open no slot go before any slot is built.
    """
    token = F.col("token")
    package, note = support_package(token), _is_note(token)
    values = {
        "component_code": F.col("t_component_code"),
        "alert_code": F.col("t_alert_code"),
        "software_component": F.col("t_software_component"),
        "product_version": F.coalesce("t_product_version", "l_product_label"),
        "support_package": F.col("_package").cast("string"),
        "note_number": F.when(F.col("_note"), token),
        "priority": F.when(token == "priority", _priority(F.col("a1"), F.col("a2"))),
    }
    found = tokens.where(
        reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in ("t_surface", "l_product_label")])
        | (token == "priority") | F.startswith(token, F.lit("sp")) | note
    ).withColumns({"_package": package, "_note": note})
    slots = F.array_compact(F.array(*[F.when(v.isNotNull(), _slot(f, v)) for f, v in values.items()]))
    opened = found.select(key, "pos", F.inline(slots))
    return opened.groupBy(key, "family", "value").agg(F.min("pos").alias("first_pos"))


# Bits of a token's mark in a compiled lexicon.
(
    _ALERT, _COMPONENT, _SOFTWARE, _VERSION, _CUE, _OPENS_LABEL, _FILLER, _LOOKUP, _QUESTION, _PREREQUISITE, _UNSUPPORTED,
    _SAYS_PRIORITY, _SAYS_ALERT, _SAYS_COMPONENT, _SAYS_NOTE, _SAYS_VERY, _SP_WORD, _PACKAGE, _NOTE,
) = (1 << k for k in range(19))
_FAMILY_BITS = {
    "alert_code": _ALERT, "component_code": _COMPONENT, "software_component": _SOFTWARE, "product_version": _VERSION, "product_cue": _CUE,
}


def _grammar_marks() -> dict[str, int]:
    marks: dict[str, int] = {}
    said = {"priority": _SAYS_PRIORITY, "alert": _SAYS_ALERT, "component": _SAYS_COMPONENT, "note": _SAYS_NOTE, "very": _SAYS_VERY}
    groups = [(FILLERS, _FILLER), (LOOKUP_VERBS, _LOOKUP), (QUESTION_WORDS, _QUESTION), (PREREQUISITE_MARKERS, _PREREQUISITE),
              (UNSUPPORTED_MARKERS, _UNSUPPORTED), *(((w,), bit) for w, bit in said.items())]
    for words, bit in groups:
        for word in words:
            marks[word] = marks.get(word, 0) | bit
    return marks


def split_lexicon(entries: DataFrame, most_bytes: int = COMPILED_BYTES) -> tuple[Compiled, DataFrame | None]:
    """Grammar words and entries as a compiled lexicon of about ``most_bytes`` at most, and the entries beyond that as a table.

    Entries have a mark and slot values for each surface; a two-word label is an entry of its own. Kinds of entries are compiled
    whole, the smallest kinds first, so that what is left are the kinds that grow; a grammar word is always compiled.
    """
    surfaces = _by_surface(entries)
    slots = F.array_compact(F.array(*[
        F.when(F.col(f).isNotNull(), _slot("product_version" if f == "product_label" else f, F.col(f)))
        for f in (*_FAMILY_BITS, "product_label") if f != "product_cue"
    ]))
    mark = reduce(lambda a, b: a + b, [F.when(F.col(f).isNotNull(), bit).otherwise(0) for f, bit in _FAMILY_BITS.items()])
    own = surfaces.select("surface", mark.alias("mark"), slots.alias("slots"))
    opened = surfaces.where("product_label IS NOT NULL").select(F.split_part("surface", F.lit(" "), F.lit(1)).alias("surface")).distinct()
    nothing = F.array().cast("array<struct<family:string,value:string>>")
    rows = own.unionByName(opened.select("surface", F.lit(_OPENS_LABEL).alias("mark"), nothing.alias("slots")))
    merged = written(
        rows.groupBy("surface").agg(F.bit_or("mark").alias("mark"), F.flatten(F.collect_list("slots")).alias("slots")), "lexicon"
    )
    grammar = _grammar_marks()
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    sizes = sorted((r["size"], r["mark"]) for r in merged.groupBy("mark").agg(size.alias("size")).collect())
    if sum(n for n, _ in sizes) <= most_bytes:
        return compile_entries(merged, grammar, most_bytes), None
    kinds, room = [], most_bytes
    for n, kind in sizes:
        room -= n
        if room >= 0:
            kinds.append(kind)
    small = F.col("mark").isin(kinds) | F.col("surface").isin(*grammar)
    few = merged.where(small)
    return compile_entries(few, grammar, few.agg(size).first()[0] or 0), merged.where(~small)


class Known:
    """A compiled lexicon, and the entries of a larger one that stand beside the tokens of a row."""

    def __init__(self, words: Compiled) -> None:
        self.words = words

    def _entry(self, word: Column) -> Column:
        return F.get(F.filter("_known", lambda k: k["surface"] == word), F.lit(0))

    def mark(self, word: Column) -> Column:
        return self.words.mark(word).bitwiseOR(F.coalesce(self._entry(word)["mark"], F.lit(0)))

    def values(self, word: Column) -> Column:
        return F.coalesce(self.words.values(word), self._entry(word)["slots"])


def with_known(texts: DataFrame, words: Compiled, rest: DataFrame, key: str, text: str) -> DataFrame:
    """(key, _t, _asks, _at, _known): tokens with the entry of a word that the table ``rest`` may have, a row for each such word.

    Words that are compiled or that a bit filter rules out ask nothing, so few do; a text has one row at least.
    """
    may_be = bit_filter(rest.select("surface"), REST_BITS)
    asks = lambda word: words.at(word).isNull() & may_be(word)
    none = F.array().cast("array<string>")
    asked = F.filter("_t", asks)
    if rest.where(F.contains("surface", F.lit(" "))).limit(1).count():
        pairs = F.transform("_t", lambda t, i: F.concat(t, F.lit(" "), F.get("_t", i + 1)))
        asked = F.concat(asked, F.filter(pairs, lambda t: t.isNotNull() & asks(t)))
    listed = texts.select(key, boundary_tokens(F.col(text)).alias("_t"))
    listed = listed.select(key, "_t", F.coalesce(F.array_distinct(asked), none).alias("_words"))
    dealt = listed.select(key, "_t", F.size("_words").alias("_asks"), F.posexplode_outer("_words").alias("_at", "_word"))
    # A text that asks nothing meets nothing; it is dealt by its tokens.
    dealt = dealt.withColumns({
        "_some": F.col("_word").isNotNull(), "_word": F.coalesce("_word", F.xxhash64("_t").cast("string")),
    })
    entry = rest.select(F.lit(True).alias("_some"), F.col("surface").alias("_word"), F.struct("surface", "mark", "slots").alias("_entry"))
    met = dealt.join(entry, ["_some", "_word"], "left")
    known = F.array_compact(F.array("_entry"))
    return met.select(key, "_t", "_asks", F.coalesce("_at", F.lit(0)).alias("_at"), known.alias("_known"))


def _each_text(
    texts: DataFrame, words: Compiled, rest: DataFrame, key: str, text: str, made: Callable[[DataFrame, Known, Sequence[str]], DataFrame]
) -> DataFrame:
    """(key, *what ``made`` adds): a row for each text, from its tokens and all entries they have.

    A text that asks for one word at most is finished where it is. The rows of the others are written, as are the results, and
    meet by key and tokens; equal ones are counted and given out again.
    """
    held = ["_t", "_asks", "_at", "_known"]
    first = made(with_known(texts, words, rest, key, text), Known(words), held)
    results = [c for c in first.columns if c not in (key, *held)]
    one = F.col("_asks") <= 1
    rows = written(first.select(
        key, "_asks", "_at", *[F.when(one, F.col(c)).alias(c) for c in results], *[F.when(~one, F.col(c)).alias(c) for c in ("_t", "_known")]
    ), "looked")
    several = rows.where("_asks > 1").groupBy(key, "_t").agg(
        F.count_if(F.col("_at") == 0).alias("_copies"), F.flatten(F.collect_list("_known")).alias("_known")
    )
    again = made(several.withColumn("_known", F.array_distinct("_known")), Known(words), ["_copies"])
    again = again.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return rows.where("_asks <= 1").select(key, *results).unionByName(again.select(key, *results))


def listed_tokens(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, _t): each text's tokens in an array."""
    return texts.select(key, boundary_tokens(F.col(text)).alias("_t"))


def marked_tokens(listed: DataFrame, words: Compiled | Known, *kept: str) -> DataFrame:
    """Kept columns, tokens _t and their marks _m in two arrays."""

    def mark(token: Column) -> Column:
        package = F.when(support_package(token).isNotNull(), _SP_WORD | _PACKAGE).otherwise(_SP_WORD)
        return (
            words.mark(token)
            .bitwiseOR(F.when(F.startswith(token, F.lit("sp")), package).otherwise(0))
            .bitwiseOR(F.when((F.length(token) == 7) & _is_note(token), _NOTE).otherwise(0))
        )

    carried = [c for c in ("_known",) if c in listed.columns and c not in kept]
    return listed.select(*kept, *(c for c in ("_t",) if c not in kept), *carried, F.transform("_t", mark).alias("_m"))


def _places(wanted) -> Column:
    """Places of the tokens for which wanted(mark) holds."""
    every = F.transform("_m", lambda m, i: F.when(wanted(m), i))
    return F.array_compact(every)


def _label(words: Compiled | Known, i: Column) -> Column:
    """Entries of the two-word label at a place, null where there is none."""
    return F.when(has(F.get("_m", i), _OPENS_LABEL), words.values(F.concat(F.get("_t", i), F.lit(" "), F.get("_t", i + 1))))


_SLOT_BITS = (_ALERT, _COMPONENT, _SOFTWARE, _VERSION, _OPENS_LABEL, _SAYS_PRIORITY, _PACKAGE, _NOTE)


def _opened(listed: DataFrame, words: Compiled | Known, key: str, kept: Sequence[str] = ()) -> DataFrame:
    """(key, kept columns, _slots): the slot values that a text's tokens open, each with the first token that opens it."""
    none = F.array().cast("array<struct<family:string,value:string>>")

    def slots_at(i: Column) -> Column:
        token, mark = F.get("_t", i), F.get("_m", i)
        label = F.when(~has(mark, _VERSION), F.filter(_label(words, i), lambda s: s["family"] == "product_version"))
        ahead = _priority(F.get("_t", i + 1), F.get("_t", i + 2))
        pattern = (
            F.when(has(mark, _PACKAGE), F.array(_slot("support_package", support_package(token).cast("string"))))
            .when(has(mark, _NOTE), F.array(_slot("note_number", token)))
            .when(has(mark, _SAYS_PRIORITY) & ahead.isNotNull(), F.array(_slot("priority", ahead)))
        )
        lexical = F.when(has(mark, _ALERT, _COMPONENT, _SOFTWARE, _VERSION), words.values(token))
        every = F.concat(F.coalesce(lexical, none), F.coalesce(label, none), F.coalesce(pattern, none))
        return F.transform(every, lambda s: F.struct(s["family"].alias("family"), s["value"].alias("value"), (i + 1).alias("pos")))

    marked = marked_tokens(listed, words, key, *kept)
    opening = _places(lambda m: has(m, *_SLOT_BITS))
    return marked.select(key, *kept, F.flatten(F.transform(opening, slots_at)).alias("_slots"))


def entity_slots(
    texts: DataFrame, entries: DataFrame, key: str = "doc_id", text: str = "text", most_bytes: int = COMPILED_BYTES
) -> DataFrame:
    """(key, family, value, first_pos): distinct slot values per text, at the first token that opens them.

    The lexicon is measured and looked up within the row, what exceeds ``most_bytes`` by an equal join on the few words it may
    have. A text moves once, as one row, to the others of its key.
    """
    words, rest = split_lexicon(entries, most_bytes)
    if rest is None:
        opened = _opened(listed_tokens(texts, key, text), words, key)
    else:
        opened = _each_text(texts, words, rest, key, text, lambda rows, known, kept: _opened(rows, known, key, kept))
    # A filter on the slots would be moved down and find them twice.
    found = opened.repartition(key).select(key, F.inline_outer("_slots")).where("family IS NOT NULL")
    return found.groupBy(key, "family", "value").agg(F.min("pos").alias("first_pos"))


class _Token:
    """What is known of the token at a place of the marked arrays, and of its neighbours."""

    def __init__(self, words: Compiled | Known, i: Column) -> None:
        mark = lambda k: F.coalesce(F.get("_m", i + k), F.lit(0))
        own, before = mark(0), mark(-1)
        self.after, self.after2 = F.get("_t", i + 1), F.get("_t", i + 2)
        self.package, self.bad_package = has(own, _SP_WORD), has(own, _SP_WORD) & ~has(own, _PACKAGE)
        self.entity = has(own, _ALERT, _COMPONENT, _SOFTWARE, _VERSION, _NOTE, _SP_WORD)
        self.label_ahead = _label(words, i).isNotNull()
        self.label_behind = has(before, _OPENS_LABEL) & _label(words, i - 1).isNotNull()
        self.cue = has(own, _CUE)
        self.says_priority, self.says_alert = has(own, _SAYS_PRIORITY), has(own, _SAYS_ALERT)
        self.says_component, self.says_note = has(own, _SAYS_COMPONENT), has(own, _SAYS_NOTE)
        self.alert_ahead, self.component_ahead = has(mark(1), _ALERT), has(mark(1), _COMPONENT)
        self.note_ahead = has(mark(1), _FILLER, _NOTE)
        self.filler = has(own, _FILLER)
        self.introduced = has(before, _SAYS_PRIORITY, _SAYS_ALERT, _SAYS_COMPONENT, _CUE)
        self.very_high = has(before, _SAYS_VERY) & has(mark(-2), _SAYS_PRIORITY)
        self.after_note = has(before, _SAYS_NOTE)
        self.grammar = has(own, _FILLER, _LOOKUP, _QUESTION)


def _unknown_value(t: _Token) -> Column:
    """A cue or slot word whose value is not known."""
    return (
        (t.cue & ~t.label_ahead)
        | (t.says_priority & _priority(t.after, t.after2).isNull())
        | (t.says_alert & ~t.alert_ahead)
        | (t.says_component & ~t.component_ahead)
        | (t.says_note & ~t.note_ahead)
        | t.bad_package
    )


def _unknown_token(t: _Token) -> Column:
    """Neither grammar nor part of a slot."""
    consumed = (
        t.entity | t.cue | t.says_priority | t.says_alert | t.says_component | t.introduced | t.very_high
        | (t.after_note & ~t.filler) | t.label_ahead | t.label_behind
    )
    return ~t.grammar & ~consumed


def diagnose(
    texts: DataFrame, entries: DataFrame, key: str = "doc_id", text: str = "text", most_bytes: int = COMPILED_BYTES
) -> DataFrame:
    """Per text: token flags, slot counts, the first failure that applies and the intent.

    Rows that share a ``key`` are texts of their own. With a compiled lexicon everything is found within the text's row and
    nothing is shuffled. What exceeds ``most_bytes`` meets the words it may have by an equal join; texts that ask for several are
    put together by key and tokens.
    """
    words, rest = split_lexicon(entries, most_bytes)
    if rest is None:
        filled = _filled(listed_tokens(texts, key, text), words, key)
    else:
        filled = _each_text(texts, words, rest, key, text, lambda rows, known, kept: _filled(rows, known, key, kept))
    failure = (
        F.when(F.col("unsupported_marker"), "UNSUPPORTED_INTENT")
        .when(F.col("unknown_entity"), "UNKNOWN_ENTITY")
        .when(F.col("unknown_token"), "UNKNOWN_TOKEN")
        .when(reduce(lambda a, b: a | b, [F.col(f) > 1 for f in FAMILIES]), "AMBIGUOUS_INPUT")
        .otherwise(slot_failure())
    )
    diagnosed = filled.withColumn("failure", failure)
    return diagnosed.withColumn(
        "intent", F.when(F.col("failure") == "NONE", _candidate()).otherwise("UNSUPPORTED")
    )


def _filled(listed: DataFrame, words: Compiled | Known, key: str, kept: Sequence[str] = ()) -> DataFrame:
    """Key and kept columns, with flags and slot counts of each text from its marked tokens."""
    none = F.array().cast("array<struct<family:string,value:string>>")

    def slots_at(i: Column) -> Column:
        token, mark = F.get("_t", i), F.get("_m", i)
        ahead = _priority(F.get("_t", i + 1), F.get("_t", i + 2))
        return F.concat(
            F.when(has(mark, _ALERT, _COMPONENT, _SOFTWARE, _VERSION), words.values(token)).otherwise(none),
            F.coalesce(F.when(~has(mark, _VERSION), _label(words, i)), none),
            F.when(has(mark, _PACKAGE), F.array(_slot("support_package", support_package(token).cast("string"))))
            .when(has(mark, _NOTE), F.array(_slot("note_number", token)))
            .when(has(mark, _SAYS_PRIORITY) & ahead.isNotNull(), F.array(_slot("priority", ahead)))
            .otherwise(none),
        )

    def filled(family: str) -> Column:
        return F.greatest(F.size(F.filter("_slots", lambda s: s["family"] == family)), F.lit(0))

    marked = marked_tokens(listed, words, key, *kept)
    every = F.coalesce(F.aggregate("_m", F.lit(0), lambda a, m: a.bitwiseOR(m)), F.lit(0))
    odd = _places(lambda m: ~has(m, _FILLER, _LOOKUP, _QUESTION))
    valued = _places(lambda m: has(m, _CUE, _SAYS_PRIORITY, _SAYS_ALERT, _SAYS_COMPONENT, _SAYS_NOTE, _SP_WORD))
    opening = _places(lambda m: has(m, *_SLOT_BITS))
    known = marked.select(
        key, *kept, F.coalesce(F.size("_t"), F.lit(0)).alias("_size"), every.alias("_every"),
        F.exists(valued, lambda i: _unknown_value(_Token(words, i))).alias("_value"),
        F.exists(odd, lambda i: _unknown_token(_Token(words, i))).alias("_token"),
        F.array_distinct(F.flatten(F.transform(opening, slots_at))).alias("_slots"),
    )
    flags = {"unsupported_marker": _UNSUPPORTED, "prerequisite": _PREREQUISITE, "lookup": _LOOKUP, "question": _QUESTION}
    return known.select(
        key, *kept, F.greatest("_size", F.lit(0)).cast("long").alias("tokens"),
        *[has(F.col("_every"), bit).alias(name) for name, bit in flags.items()],
        F.coalesce("_value", F.lit(False)).alias("unknown_entity"), F.coalesce("_token", F.lit(False)).alias("unknown_token"),
        *[filled(f).alias(f) for f in FAMILIES],
    )


# The slots each intent allows.
_SEARCH_SLOTS = ("alert_code", "component_code", "priority")
ALLOWED_SLOTS = {
    "PREREQUISITE_CLOSURE": ("note_number",),
    "NOTE_LOOKUP": ("note_number",),
    "GENERAL_SEARCH": ("note_number",),
    "ALERT_RESOLUTION": _SEARCH_SLOTS,
    "COMPONENT_SEARCH": ("component_code", "priority"),
    "VERSION_FILTERED_SEARCH": (*_SEARCH_SLOTS, "product_version", "support_package"),
}


def _candidate() -> Column:
    """The intent that the filled slots select, else null."""
    return (
        F.when(F.col("prerequisite"), "PREREQUISITE_CLOSURE")
        .when((F.col("product_version") == 1) | (F.col("support_package") == 1), "VERSION_FILTERED_SEARCH")
        .when(F.col("alert_code") == 1, "ALERT_RESOLUTION")
        .when(F.col("component_code") == 1, "COMPONENT_SEARCH")
        .when((F.col("note_number") == 1) & F.col("lookup"), "NOTE_LOOKUP")
        .when((F.col("note_number") == 1) & (F.col("tokens") == 1), "GENERAL_SEARCH")
    )


def slot_failure() -> Column:
    """What the slots of a text with known, single values lack for its intent; NONE if nothing.

    Looked at in this order: no intent at all; a version search without an alert or a component;
    slots the intent does not allow; a note intent without its note; no question word where the
    intent needs one. The order of slots in the text is not looked at.
    """
    candidate = _candidate()
    extra = reduce(
        lambda a, b: a | b,
        [(candidate == name) & (F.col(f) > 0) for name, ok in ALLOWED_SLOTS.items() for f in FAMILIES if f not in ok],
    )
    asks = candidate.isin("PREREQUISITE_CLOSURE", "ALERT_RESOLUTION", "COMPONENT_SEARCH", "VERSION_FILTERED_SEARCH")
    return (
        F.when(candidate.isNull(), "MISSING_REQUIRED_ENTITY")
        .when(
            (candidate == "VERSION_FILTERED_SEARCH") & (F.col("alert_code") == 0) & (F.col("component_code") == 0),
            "UNKNOWN_TOKEN",
        )
        .when(extra, "UNSUPPORTED_INTENT")
        .when((candidate == "PREREQUISITE_CLOSURE") & (F.col("note_number") == 0), "UNSUPPORTED_INTENT")
        .when(asks & ~F.col("question"), "UNSUPPORTED_INTENT")
        .otherwise("NONE")
    )


# Phrases that ask for each metric.
LOSS_PHRASES = ("incurred loss", "debit loss", "financial loss")
ACTIVE_PHRASES = ("active polic", "active sales", "released sales")
CLAIMS_WINDOW = "last 12 months"
RATIO_PHRASES = ("claims ratio", "cost-revenue ratio", "cost revenue ratio")


def _mentions(text: Column, phrases: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])


def metric_intent(text: Column) -> Column:
    """CLAIMS, ACTIVE or RATIO where exactly one is asked for, else UNSUPPORTED.

    A claims question needs both a count and a loss threshold, joined by the only "and", and
    its window of twelve months.
    """
    question = F.lower(text)
    has_count = count_threshold(question).isNotNull()
    has_loss = _mentions(question, LOSS_PHRASES) & money_threshold(question).isNotNull()
    conjunctions = F.size(F.split(question, " and ")) - 1
    active, ratio = _mentions(question, ACTIVE_PHRASES), _mentions(question, RATIO_PHRASES)
    asked = (has_count | has_loss).cast("int") + active.cast("int") + ratio.cast("int")
    return (
        F.when(asked != 1, "UNSUPPORTED")
        .when(active, "ACTIVE")
        .when(ratio, "RATIO")
        .when(has_count & has_loss & F.contains(question, F.lit(CLAIMS_WINDOW)) & (conjunctions == 1), "CLAIMS")
        .otherwise("UNSUPPORTED")
    )
