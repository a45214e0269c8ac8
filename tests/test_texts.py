import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from weftline import functions as fn
from weftline.operators import grounding, scans
from weftline.operators.lexicon import bit_filter, compile_entries
from weftline.session import literal_rows


def values(spark, column, *texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    return [r[0] for r in frame.select("n", column(F.col("t")).alias("v")).sort("n").select("v").collect()]


def test_terms_and_plurals(spark):
    assert values(spark, fn.normalize_term, "  Sales-Order_ID/x \t Y ", "STRASSE straße") == ["sales order id x y", "strasse strasse"]
    assert values(spark, fn.plural_variants, "Policy", "Sales  Orders", "big claim", " - ") == [
        ["policy", "policies"], ["sales orders"], ["big claim", "big claims"], [],
    ]


def test_tokens(spark):
    assert values(spark, fn.boundary_tokens, "On S/4HANA 2023, NetWeaver 7.50. (SP05)?", "", "a..5 .") == [
        ["on", "s/4hana", "2023", "netweaver", "7.50", "sp05"], [], ["a", ".5"],
    ]
    assert values(spark, fn.support_package, "sp05", "sp5", "sp123", "sp", "xsp05") == [5, 5, None, None, None]


def test_thresholds(spark):
    asked = "find customers with at least three qualifying claims and total incurred loss above eur 20,000."
    assert values(spark, fn.count_threshold, asked, "more than 12 financial postings", "over many qualifying claims", "none") == [3, 12, None, None]
    assert values(spark, fn.money_threshold, asked, "greater than 7 eur", "about 7") == [20000, 7, None]


def test_sql_shapes(spark):
    texts = ("customers with at least three", "WITH x AS (SELECT 1)", "a; b", "selection", "drop it", "état with")
    assert values(spark, fn.looks_like_sql, *texts) == [True, True, True, False, True, True]
    assert values(spark, lambda c: fn.looks_like_sql(c, natural_language=True), *texts) == [False, True, True, False, True, False]


def test_redaction(spark):
    pairs = {
        "Authorization: Bearer abc.def rest": "Authorization: Bearer [REDACTED] rest",
        "sent BASIC dXNlcjpw, ok": "sent Basic [REDACTED], ok",
        "api_key=abc; password : x y": "api_key=[REDACTED]; password : [REDACTED] y",
        "at https://user:pw@host/x": "at https://[REDACTED]@host/x",
        "basic bearer xyz": "Basic [REDACTED] xyz",
        "plain": "plain",
    }
    assert values(spark, fn.redact, *pairs) == list(pairs.values())
    assert values(spark, lambda c: fn.redact(c, 4), "plain text") == ["plai"]
    with pytest.raises(ValueError):
        fn.redact(F.lit("x"), -1)


def test_iso_dates(spark):
    texts = ["2026-08-28", "20260828", "2026-W35-5", "2026W355", "2026-W35", "2020-W53-1", "2026-W54-1", "2021-W53-1", "2026-02-30", "2026-8-28",
             "0000-01-01", "2026-08", "2026-08-28T00:00:00", "", "2024-02-29", " 2026-08-28", "2026-W00-1"]

    def expected(text):
        try:
            return date.fromisoformat(text)
        except ValueError:
            return None

    assert values(spark, fn.iso_date, *texts) == [expected(t) for t in texts]


def test_identifiers(spark):
    assert values(spark, fn.local_name, "http://x/y#z", "a/b", "plain", "x/") == ["z", "b", "plain", ""]
    assert values(spark, fn.is_canonical_id, "erp:Product", "Erp:P", "erp:9", "erp:P\n") == [True, False, False, False]
    assert values(spark, fn.is_country_code, "FR", "fr", "FRA") == [True, False, False]
    assert values(spark, fn.is_semantic_version, "1.0.0", "01.0.0", "1.0") == [True, False, False]


def test_ratio_rounds_half_even(spark):
    frame = spark.createDataFrame([(25, 10_000_000), (35, 10_000_000), (1, 3), (1, 0)], "a bigint, b bigint")
    got = [None if r[0] is None else str(r[0]) for r in frame.select(fn.ratio6(F.col("a"), F.col("b"))).collect()]
    assert got == ["0.000002", "0.000004", "0.333333", None]


TERMS = [("c1", "Sales Order", ["order"]), ("c2", "C++", [".net"]), ("c3", "tat", ["no match"]), ("c4", "Policy", [])]


def _brute(texts, ordered):
    found = []
    for key, text in texts:
        normal = " ".join(re.sub(r"[-_/]", " ", text.casefold()).split())
        for concept, terms in ordered.items():
            for term in terms:
                if re.search(rf"(?<!\w){re.escape(term)}(?!\w)", normal):
                    found.append((key, concept, term))
                    break
    return sorted(found, key=repr)


def test_grounding_against_brute_force(spark, rows):
    pick = random.Random(7)
    words = ["sales", "order", "orders", "sales-order", "c++", "c", "+", ".net", "x.net", "état", "tat", "Policies", "policy,", "(order)", "no", "match", "-", "\n"]
    texts = [(n, " ".join(pick.choice(words) for _ in range(pick.randint(0, 9)))) for n in range(150)]
    texts += [(900, "order"), (901, "salesorder sales. order"), (902, "c+++ xc++ c++"), (903, "a.net .net5 ..net"), (904, "")]
    concepts = spark.createDataFrame(TERMS, "id string, name string, synonyms array<string>")
    local = spark.createDataFrame([("c4", "Vertrag_X", 0), ("c9", "sales", 1)], "canonical_value string, local_value string, ordinal bigint")
    found = grounding.ground_terms(spark.createDataFrame(texts, "doc_id int, text string"), grounding.vocabulary(concepts, local))
    ordered = {
        "c1": ["sales order", "sales orders", "order", "orders"], "c2": ["c++", "c++s", ".net", ".nets"],
        "c3": ["tat", "tats", "no match", "no matchs"], "c4": ["policy", "policies", "vertrag x"],
    }
    assert rows(found, "doc_id", "concept_id", "term") == _brute(texts, ordered)


CASES = [
    ("Retrieve the title and details for SAP Note 3012445.", "NOTE_LOOKUP", "NONE"),
    ("Which SAP note resolves alert TIME_OUT in component MM-PUR-PO?", "ALERT_RESOLUTION", "NONE"),
    ("Find notes for alert TIME_OUT in component MM-PUR-PO on S/4HANA 2023.", "VERSION_FILTERED_SEARCH", "NONE"),
    ("What are the prerequisite notes required for SAP Note 3109922?", "PREREQUISITE_CLOSURE", "NONE"),
    ("Find notes for alert TIME_OUT in component MM-PUR-PO priority very high.", "ALERT_RESOLUTION", "NONE"),
    ("3012445", "GENERAL_SEARCH", "NONE"),
    ("Find notes for alert TIME_OUT in component MM-PUR-PO priority VERY LOW.", "UNSUPPORTED", "UNKNOWN_ENTITY"),
    ("Find notes for alert TIME_OUT and alert DBSQL_NO_MORE_CONNECTION.", "UNSUPPORTED", "AMBIGUOUS_INPUT"),
    ("Find notes for alert UNKNOWN_ALERT.", "UNSUPPORTED", "UNKNOWN_ENTITY"),
    ("Find notes for alert TIME_OUT in component BC-DB-HDB for an Oracle system.", "UNSUPPORTED", "UNKNOWN_TOKEN"),
    ("Which notes resolve an unexplained outage?", "UNSUPPORTED", "UNKNOWN_TOKEN"),
    ("Explain alert NOPE", "UNSUPPORTED", "UNSUPPORTED_INTENT"),
    ("Find notes on S/4HANA 1999 for alert TIME_OUT", "UNSUPPORTED", "UNKNOWN_ENTITY"),
    ("Find notes for alert TIME_OUT at spx", "UNSUPPORTED", "UNKNOWN_ENTITY"),
    ("", "UNSUPPORTED", "MISSING_REQUIRED_ENTITY"),
    ("what is required", "UNSUPPORTED", "MISSING_REQUIRED_ENTITY"),
    ("Find notes for S/4HANA 2023", "UNSUPPORTED", "UNKNOWN_TOKEN"),
    ("find SP05", "UNSUPPORTED", "UNKNOWN_TOKEN"),
    ("what prerequisites", "UNSUPPORTED", "UNSUPPORTED_INTENT"),
    ("notes for alert TIME_OUT", "UNSUPPORTED", "UNSUPPORTED_INTENT"),
]


def test_request_diagnosis(spark, rows):
    entries = grounding.lexicon(
        spark, alerts=["TIME_OUT", "DBSQL_NO_MORE_CONNECTION"], components=["MM-PUR-PO", "BC-DB-HDB"],
        versions=[("S/4HANA 2023", "S4HANA_2023"), ("NetWeaver 7.50", "NETWEAVER_750")],
    )
    texts = spark.createDataFrame([(n, c[0]) for n, c in enumerate(CASES)], "doc_id int, text string")
    tokens = grounding.request_tokens(texts, entries)
    found = grounding.diagnose(texts, entries)
    assert [r[1:] for r in sorted(rows(found, "doc_id", "intent", "failure"))] == [c[1:] for c in CASES]
    slots = grounding.extract_slots(tokens).where("doc_id = 4")
    assert rows(slots, "family", "value") == [("alert_code", "TIME_OUT"), ("component_code", "MM-PUR-PO"), ("priority", "Very High")]


def test_compiled_lexicon_finds_what_joins_find(spark):
    """Random token runs: the lexicon probed in the row and the joined one agree on slots and on every flag."""
    rng = random.Random(4)
    entries = grounding.lexicon(
        spark, alerts=["TIME_OUT", "note", "sp07", "Straße"], components=["MM-PUR-PO", "TIME_OUT", "1234567"], software=["BASIS"],
        versions=[("S/4HANA 2023", "S4_2023"), ("S/4HANA 2021", "S4_2021"), ("NetWeaver 7.50", "NW750"), ("alert 7.50", "ODD"), ("BASIS 2023", "S4_2023")],
        cues=("s/4hana", "NetWeaver"),
    )
    said = ("time_out mm-pur-po basis s/4hana netweaver 2023 2021 7.50 s4_2023 nw750 sp05 sp5 sp123 sp07 spam 1234567 7654321 123456 priority very high low"
            " medium alert component note notes find what which list prerequisites explain unknown the for strasse STRASSE , .").split()
    texts = [(n, " ".join(rng.choice(said) for _ in range(rng.choice([0, 1, 2, 3, 5, 9])))) for n in range(600)] + [(900, None), (901, ""), (902, " ?! ")]
    frame = spark.createDataFrame(texts, "doc_id int, text string")
    near, far = (grounding.entity_slots(frame, entries, most_bytes=b) for b in (1 << 20, 0))
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, far.collect()))
    near, far = (grounding.diagnose(frame, entries, most_bytes=b) for b in (1 << 20, 0))
    columns = sorted(far.columns)
    assert columns == sorted(near.columns)
    assert sorted(map(repr, near.select(columns).collect())) == sorted(map(repr, far.select(columns).collect()))
    assert "Join" not in near._jdf.queryExecution().toString()


def test_requests_that_share_a_key_are_diagnosed_one_by_one(spark):
    """Equal and different texts of one key, in the row and by joins."""
    entries = grounding.lexicon(spark, alerts=["TIME_OUT", "OTHER"])
    texts = ["Find notes for alert TIME_OUT", "Find notes for alert OTHER", "Find notes for alert OTHER", "1234567", "1234567", "", "", None, None, "explain"]
    frame = spark.createDataFrame([(5, t) for t in texts] + [(6, "1234567")], "doc_id int, text string").repartition(3)
    near, far = (grounding.diagnose(frame, entries, most_bytes=b) for b in (1 << 20, 0))
    columns = sorted(far.columns)
    assert near.count() == far.count() == 11
    assert sorted(map(repr, near.select(columns).collect())) == sorted(map(repr, far.select(columns).collect()))


def test_only_words_that_a_large_lexicon_may_have_are_rows(spark):
    """The kinds that fit are compiled, components are joined: a row for a text, not one for each of its tokens."""
    entries = grounding.lexicon(
        spark, alerts=["TIME_OUT"], components=[f"S-{n}" for n in range(500)] + ["note"], versions=[("S/4HANA 2023", "S4_2023"), ("S-7 2021", "ODD")],
    )
    said = [f"Find notes for alert TIME_OUT in component s-{n} on S/4HANA 2023 priority high" for n in range(300)]
    said += ["what is required", "", None, "component S-1 and component s-2 on S-7 2021", "component S-1 and component s-2 on S-7 2021", "s-4 note"]
    frame = spark.createDataFrame([(n % 305, t) for n, t in enumerate(said)], "doc_id int, text string")
    words, rest = grounding.split_lexicon(entries, 4000)
    assert 490 <= rest.count() <= 501 and rest.where("surface = 'time_out' OR surface = 'note'").count() == 0
    dealt = grounding.with_known(frame, words, rest, "doc_id", "text")
    assert dealt.where("_at = 0").count() == len(said) and dealt.count() <= len(said) + 10
    for find in (grounding.diagnose, grounding.entity_slots):
        whole, parted = (find(frame, entries, most_bytes=b) for b in (1 << 20, 4000))
        columns = sorted(whole.columns)
        assert sorted(map(repr, whole.select(columns).collect())) == sorted(map(repr, parted.select(columns).collect()))
    plan = grounding.entity_slots(frame, entries)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "REPARTITION_BY_COL" in plan


def test_case_folds_of_every_code_point(spark):
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["|".join(points[i : i + 512]) for i in range(0, len(points), 512)] + ["ΑΣ ΣΑΣ", "STRASSE", "", "\x00A"]
    frame = literal_rows(spark, list(enumerate(texts)), "n int, t string")
    found = dict(frame.select("n", fn.fold_case(F.col("t"))).collect())
    assert all(found[n] == t.casefold() for n, t in enumerate(texts))
    assert frame.select(fn.fold_case(F.lit(None).cast("string"))).first()[0] is None


def test_bit_filter_keeps_every_word(spark):
    """The plan of a million words is as large as that of ten; words pass, most others do not."""
    words = spark.range(1_000_000).selectExpr("concat('w', id) AS w")
    for bits, most in ((1 << 20, 0.7), (1 << 24, 0.1)):
        may_be = bit_filter(words, bits)
        assert words.where(~may_be(F.col("w"))).count() == 0
        assert words.selectExpr("concat('x', w) AS w").where(may_be(F.col("w"))).count() < most * 1_000_000
    assert spark.range(5).selectExpr("string(id) AS w").where(bit_filter(words.limit(0))(F.col("w"))).count() == 0


def test_large_lexicon_is_placed(spark):
    entries = spark.range(20_000).selectExpr("concat('word', id) AS surface", "int(id % 8) AS mark", "array(named_struct('family', 'f', 'value', string(id))) AS slots")
    words = compile_entries(entries, {"word7": 16, "other": 32}, most_bytes=1 << 22)
    probe = spark.range(0, 40_000).selectExpr("concat('word', id) AS w", "id")
    found = probe.select("id", words.mark(F.col("w")).alias("m"), words.values(F.col("w"))[0]["value"].alias("v")).collect()
    for r in found:
        assert r["m"] == ((r["id"] % 8) | (16 if r["id"] == 7 else 0) if r["id"] < 20_000 else 0)
        assert r["v"] == (str(r["id"]) if r["id"] < 20_000 else None)
    assert compile_entries(entries, {}, most_bytes=1000) is None


def test_metric_intents(spark):
    texts = (
        "Find French partners with at least 3 qualifying postings in the last 12 months and total debit loss above EUR 20,000.",
        "Find partners with at least 3 qualifying postings and total debit loss above EUR 20,000.",
        "Find partners with at least 3 qualifying postings in the last 12 months and debts and total debit loss above EUR 20,000.", "How many partners have active policies this year?",
        "Show the cost revenue ratio", "Show the claims ratio and active policies", "at least 3 qualifying claims", "hello",
    )
    assert values(spark, grounding.metric_intent, *texts) == ["CLAIMS", "UNSUPPORTED", "UNSUPPORTED", "ACTIVE", "RATIO", "UNSUPPORTED", "UNSUPPORTED", "UNSUPPORTED"]


def test_scans(spark, rows):
    texts = spark.createDataFrame(
        [
            (1, "a\nkey: x\r\ntoken = 'ABCDEFGHIJKLMNOPQRSTUV'\npassword=short"), (2, "x bearer abcdefghijklmnopqrstuvwxyz"),
            (3, "-----BEGIN RSA PRIVATE KEY-----"), (4, "fixme later\ncodefixme"), (5, "see http://bad.test/x http://bad.test/y"),
        ],
        "doc_id int, text string",
    )
    assert rows(scans.scan_secrets(texts)) == [(1, 3), (2, 2), (3, 1)]
    assert rows(scans.scan_markers(texts)) == [(4, 1)]
    assert rows(scans.scan_addresses(texts, ["http://bad.test/", "http://worse.test/"])) == [(5, 1, "http://bad.test/")]
    allowed = spark.createDataFrame([(5,)], "doc_id int")
    assert rows(scans.scan_addresses(texts, ["http://bad.test/"], allowed=allowed)) == []
