import hashlib
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from weftline.operators import catalog, evaluate, ledger, policy
from weftline.plans.tables import Tables
from weftline.sources import digests, tables, triples
from weftline.streaming import row_local


def _chain(spark, length, name="main"):
    out, previous = [], ledger.GENESIS
    for n in range(1, length + 1):
        row = {"query_id": f"q{n}", "document": json.dumps({"query_id": f"q{n}", "v": n}), "signature": "s", "sequence": n, "previous_hash": previous}
        document = json.dumps(dict(sorted(row.items())), separators=(",", ":"))
        previous = hashlib.sha256(document.encode()).hexdigest()
        out.append((name, row["query_id"], row["document"], "s", n, row["previous_hash"], previous))
    schema = "chain_id string, query_id string, document string, signature string, sequence bigint, previous_hash string, row_hash string"
    head = spark.createDataFrame([(name, length, previous)], "chain_id string, sequence bigint, row_hash string")
    return out, schema, head


def test_ledger(spark, rows):
    chain, schema, head = _chain(spark, 5)
    good = spark.createDataFrame(chain, schema)
    assert rows(ledger.ledger_violations(good, head)) == []
    assert ledger.provenance_lookup(good, head, "q3").count() == 1

    def broken(change):
        found = ledger.ledger_violations(spark.createDataFrame(change, schema), head)
        return rows(found, "sequence", "violation")

    altered = [r if r[4] != 3 else (*r[:2], r[2] + " ", *r[3:]) for r in chain]
    assert broken(altered) == [(3, "ROW_HASH")]
    assert broken(chain[:2] + chain[3:]) == [(4, "SEQUENCE_GAP"), (None, "CHECKPOINT_SEQUENCE")]
    assert broken(chain[:4]) == [(None, "CHECKPOINT_HASH"), (None, "CHECKPOINT_SEQUENCE")]
    renamed = [r if r[4] != 5 else (r[0], "other", *r[2:]) for r in chain]
    assert broken(renamed) == [(5, "DOCUMENT_ID"), (5, "ROW_HASH")]
    with pytest.raises(ValueError):
        ledger.provenance_lookup(spark.createDataFrame(altered, schema), head, "q1")


def test_tasks_of_a_ledger_follow_its_rows(spark, rows, monkeypatch):
    """Rows meet at their places in tasks whose number follows the rows, however little room they take packed."""
    from weftline import session

    monkeypatch.setattr(session, "TASK_ROWS", 100)
    chain, schema, head = _chain(spark, 250)
    damaged = [*chain[:99], chain[99][:2] + (chain[99][2] + " ",) + chain[99][3:], *chain[100:], chain[249]]
    book = spark.createDataFrame(damaged, schema)
    found = ledger.ledger_violations(book, head, rows=len(damaged))
    assert rows(found, "sequence", "violation") == [(100, "ROW_HASH"), (250, "SEQUENCE_REPEATED"), (None, "CHECKPOINT_SEQUENCE")]
    assert rows(found) == rows(ledger.ledger_violations(book, head))
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    moved = [line for line in plan if "hashpartitioning(chain_id" in line and ", sequence" in line]
    assert moved and all(", 3), REPARTITION_BY_NUM" in line for line in moved)


def test_corpus_ids_meet_in_one_grouping(spark, rows):
    """Repeated records, repeated expected ids and ids that are null; records are diagnosed once and ids move once."""
    made = [("a", "a", 1, "SUCCESS", "NONE", "X"), ("a", "b", 2, "UNSUPPORTED", "NONE", "X"), ("a", "a", 2, "SUCCESS", "BAD", "X"),
            ("b", "b", 1, "SUCCESS", "NONE", "X"), (None, None, 7, "SUCCESS", "NONE", "X"), ("a", "a", None, "SUCCESS", "NONE", "X")]
    records = spark.createDataFrame(made, "corpus_id string, record_corpus string, id int, expected_status string, failure string, intent string")
    records = records.withColumn("reflection_reason", F.lit("BAD"))
    expected = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("a", 3), (None, 7), ("a", None)], "corpus_id string, id int")
    found = evaluate.corpus_violations(records, expected)
    assert rows(found) == sorted([
        ("a", 2, "DUPLICATE_ID"), ("a", 3, "MISSING_ID"), ("b", 1, "UNEXPECTED_ID"), ("a", 2, "CORPUS_MISMATCH"),
        ("a", 2, "UNSUPPORTED_CONTRACT"), ("a", 2, "NOT_GROUNDED"), (None, 7, "UNEXPECTED_ID"), (None, 7, "MISSING_ID"),
        ("a", None, "UNEXPECTED_ID"), ("a", None, "MISSING_ID"),
    ], key=repr)
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Join" not in plan and plan.count("Exchange ") == 1


def test_tree_digest_moves_leaves_twice(spark):
    """Once to make them distinct, once by their first levels; the levels below move nothing."""
    lines = spark.range(1000).selectExpr("id % 700 AS n").selectExpr("cast(n AS string) AS line")
    hashes = sorted({hashlib.sha256(str(n).encode()).hexdigest() for n in range(700)})
    nodes = [(h, h) for h in hashes]
    for digits in (8, 6, 4, 2, 0):
        groups = {}
        for k, h in nodes:
            groups.setdefault(k[:digits], []).append(h)
        nodes = [(k, hashlib.sha256("".join(g).encode()).hexdigest()) for k, g in sorted(groups.items())]
    made = digests.tree_digest(lines, "line")
    assert made.collect() == [(nodes[0][1],)]
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange ") == 4


def test_digests(spark, rows, tmp_path):
    lines = [f"line {n}" for n in range(700)]
    frame = spark.createDataFrame([(x,) for x in lines], "line string")
    flat = hashlib.sha256(("\n".join(sorted(lines)) + "\n").encode()).hexdigest()
    assert rows(digests.flat_digest(frame.union(frame), "line")) == [(flat,)]
    tree = rows(digests.tree_digest(frame, "line"))
    assert tree == rows(digests.tree_digest(frame.repartition(7), "line"))
    assert tree != rows(digests.tree_digest(frame.where("line <> 'line 7'"), "line"))
    assert tree != rows(digests.tree_digest(frame, "line", levels=1))
    (tmp_path / "a.bin").write_bytes(b"\x00one")
    (tmp_path / "b.bin").write_bytes(b"two")
    manifest = digests.content_manifest(digests.file_contents(spark, str(tmp_path)))
    assert rows(manifest, "sha256", "byte_length") == sorted(
        [(hashlib.sha256(b"\x00one").hexdigest(), 4), (hashlib.sha256(b"two").hexdigest(), 3)], key=repr
    )
    result = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    same = rows(ledger.result_digest(result, ["k"]))
    assert same == rows(ledger.result_digest(result.sort(F.desc("k")), ["k"])) and same[0][1] == 2


def test_raw_rows_are_numbered_through_blocks(spark, rows, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,v\n" + "".join(f"{n},{'null' if n % 3 else ''}\n" for n in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        raw = tables.read_raw(spark, str(path))
        assert raw.where("row_number <> cast(id as bigint) + 2").count() == 0
        assert rows(raw.groupBy("v").count()) == [("", 1667), ("null", 3333)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_ntriples(spark, rows, tmp_path):
    odd = 'quote " back \\ slash \\n not a break \n\t\r é "@en'
    data = spark.createDataFrame(
        [("g", "x:s", "x:p", odd, "literal", triples.XSD_STRING, None), ("g", "x:s", "x:p", "hi", "literal", triples.LANG_STRING, "en"),
         ("g", "x:s", "x:p", "x:o", "iri", None, None), ("g", "_:b", "x:p", "5", "literal", triples.XSD + "integer", None)],
        "graph string, s string, p string, o string, o_kind string, datatype string, lang string",
    )
    triples.write_ntriples(data, str(tmp_path / "out"))
    assert rows(triples.read_ntriples(spark, str(tmp_path / "out"), "g")) == rows(data)
    lines = spark.createDataFrame([('<a> <b> "\\u00e9\\\\n" .',), ("nonsense",)], "value string")
    parsed = triples.parse_ntriples(lines.limit(1), "value", "g")
    assert rows(parsed, "o") == [("é\\n",)]
    with pytest.raises(Exception, match="not an N-Triples line"):
        triples.parse_ntriples(lines.where("value = 'nonsense'"), "value", "g").collect()


RECORD = "record_id int, expected_status string, observed_status string, gold array<string>, predicted array<string>, recovery_attempted boolean, recovery_success boolean"


def test_scores(spark, rows):
    records = spark.createDataFrame(
        [(1, "SUCCESS", "SUCCESS", ["1", "2"], ["1", "3"], False, False), (2, "SUCCESS", "SUCCESS", [], [], False, False),
         (3, "SUCCESS", "SUCCESS", ["1"], [], False, False), (4, "SUCCESS", "EMPTY_RESULT", ["1"], [], True, False)],
        RECORD,
    )
    scored = evaluate.score(evaluate.count_arrays(records))
    half, one, zero = Decimal("0.500000"), Decimal("1.000000"), Decimal("0.000000")
    assert rows(scored, "record_id", "precision", "recall", "f1", "exact") == [
        (1, half, half, half, False), (2, one, one, one, True), (3, zero, zero, zero, False), (4, None, None, None, None),
    ]
    gold = records.select("record_id", F.explode("gold").alias("item"))
    predicted = records.select("record_id", F.explode("predicted").alias("item"))
    by_items = evaluate.score(evaluate.count_items(records.drop("gold", "predicted"), gold, predicted))
    assert rows(by_items, "record_id", "precision", "exact") == rows(scored, "record_id", "precision", "exact")
    assert rows(scored.agg(*evaluate.macro_columns()), "macro_f1", "macro_exact") == [(half, Decimal("0.333333"))]


def test_published_rates(spark, rows):
    """52 requests: 32 answered, 12 empty, 8 unsupported."""
    status = ["SUCCESS"] * 32 + ["EMPTY_RESULT"] * 12 + ["UNSUPPORTED"] * 8
    records = spark.createDataFrame([(n, s, s, ["1"], ["1"], False, False) for n, s in enumerate(status)], RECORD)
    scored = evaluate.score(evaluate.count_arrays(records))
    rates = scored.agg(*evaluate.rate_columns(), *evaluate.macro_columns(), *evaluate.status_columns())
    names = ("status_accuracy", "syntax_success_rate", "execution_success_rate", "strict_empty_rate", "unsupported_rejection_rate", "macro_f1")
    assert [str(v) for v in rows(rates, *names)[0]] == ["1.000000", "1.000000", "0.846154", "0.230769", "1.000000", "1.000000"]
    assert rows(rates, "recovery_success_rate", "success", "empty_result", "unsupported", "syntax_error") == [(None, 32, 12, 8, 0)]


def test_comparisons(spark, rows):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string")
    assert rows(evaluate.difference(a, a)) == []
    assert rows(evaluate.difference(a, a.distinct())) == [("left", 1, 1, "x")]
    cases = spark.createDataFrame([("a", True), ("b", False)], "case_id string, ok boolean")
    assert rows(evaluate.dimension_report(cases, ["ok"])) == [("ok", 2, 1, 0.5)]
    assert rows(evaluate.dimension_report(cases.where("false"), ["ok"]), "accuracy") == [(1.0,)]
    assert rows(evaluate.dimension_failures(cases, "case_id", ["ok"])) == [("ok", "b")]


def test_policy_order(spark, rows):
    """Every request but the last breaks two rules or more; the first one decides."""
    schema = "request_id int, role string, plan_role string, caller_country string, plan_country string, country string, products array<string>, projected array<string>"
    ask = [
        (1, "Intern", "Other", None, None, None, ["Vault"], []),
        (2, "FinanceAnalyst", "Other", None, None, None, ["Vault"], []),
        (3, "FinanceAnalyst", "FinanceAnalyst", "FR", "FR", "DE", ["SalesOrders"], []),
        (4, "ClaimsAnalystFR", "ClaimsAnalystFR", "DE", "DE", "DE", ["BusinessPartners", "SalesOrders"], []),
        (5, "ClaimsManagerGroup", "ClaimsManagerGroup", "DE", "DE", "FR", ["ACDOCAFinancials"], []),
        (6, "ClaimsManagerGroup", "ClaimsManagerGroup", "DE", "DE", "FR", ["BusinessPartners"], []),
        (7, "FinanceAnalyst", "FinanceAnalyst", None, None, "FR", ["BillingAnalytics"], ["Partner"]),
        (8, "FinanceAnalyst", "FinanceAnalyst", None, None, None, ["BillingAnalytics"], ["Partner"]),
        (9, "FinanceAnalyst", "FinanceAnalyst", None, None, "DE", ["BillingAnalytics"], ["Partner"]),
    ]
    products = spark.createDataFrame(
        [("BusinessPartners", "Restricted", "CERTIFIED"), ("SalesOrders", "Odd", "UNSAFE"), ("ACDOCAFinancials", "Internal", "DEGRADED"), ("BillingAnalytics", "Internal", "CERTIFIED")],
        "id string, classification string, quality_status string",
    )
    pii = spark.createDataFrame([("FR", "Partner")], "location string, concept string")
    found = policy.decide(spark.createDataFrame(ask, schema), policy.role_table(spark), products, pii)
    assert [r[1] for r in rows(found)] == [
        "ROLE_DENIED", "CALLER_CONTEXT_MISMATCH", "PRODUCT_DENIED", "CLASSIFICATION_DENIED", "PRODUCT_QUALITY_DENIED",
        "COUNTRY_SCOPE_DENIED", "PII_FIELD_DENIED", "PII_FIELD_DENIED", "ALLOWED",
    ]


def test_catalog_references(spark, rows):
    relation = "relationships array<struct<predicate:string,target:string,description:string>>"
    found = catalog.dangling(catalog.catalog_references({
        "concepts": spark.createDataFrame([("c:a", [("p", "c:b", "")]), ("c:c", [("p", "c:a", "")])], f"id string, {relation}"),
        "products": spark.createDataFrame([("P", ["c:a", "c:x"])], "id string, concepts array<string>"),
        "mappings": spark.createDataFrame([("M", ["P", "Q"])], "mapping_id string, data_products array<string>"),
        "mapping_fields": spark.createDataFrame([("c:a", None), ("c:y", "c:z")], "concept string, canonical_subset string"),
        "value_map": spark.createDataFrame([("products", "c:v"), ("statuses", "POSTED")], "kind string, canonical_value string"),
        "metrics": spark.createDataFrame([("m", ["P"], "c:a", "r1", ["m2"])], "id string, source_products array<string>, concept string, filter_rule string, dependencies array<string>"),
        "rules": spark.createDataFrame([("r", "c:w")], "id string, applies_to string"),
    }))
    assert rows(found, "reference", "value") == [
        ("concept.relationship", "c:b"), ("mapping.concept", "c:y"), ("mapping.normalization", "c:v"), ("mapping.product", "Q"),
        ("mapping.subset", "c:z"), ("metric.dependency", "m2"), ("metric.rule", "r1"), ("product.concept", "c:x"), ("rule.concept", "c:w"),
    ]


def test_row_local_operators_on_a_stream(spark, rows, tmp_path):
    from weftline.operators import normalize, scans
    from weftline.plans.conforming import _value_map

    given = Tables(spark, "/root/testdata/sf0.001")
    given.documents.write.parquet(str(tmp_path / "documents"))
    stream = row_local.read_files(spark, str(tmp_path / "documents"), given.documents.schema)
    found = row_local.run_available(stream, scans.scan_secrets, str(tmp_path / "secrets"), str(tmp_path / "state"))
    assert rows(found) == rows(scans.scan_secrets(given.documents))
    given.customer.write.parquet(str(tmp_path / "customer"))
    stream = row_local.read_files(spark, str(tmp_path / "customer"), given.customer.schema)

    def mark(df):
        return normalize.mark_values(df, _value_map(given), "products", "c_mktsegment", "erp")

    found = row_local.run_available(stream, mark, str(tmp_path / "marked"))
    assert rows(found) == rows(mark(given.customer))


def test_running_totals_over_ranges(spark):
    rows = spark.range(500).selectExpr("lpad(id * 7919 % 500, 4, '0') AS k", "id % 5 AS n").repartition(6)
    found = tables.running_totals(rows, ["k"], "n", "before")
    total = 0
    for r in sorted(found.collect(), key=lambda r: r["k"]):
        assert r["before"] == total
        total += r["n"]
    assert tables.running_totals(rows.limit(0), ["k"], "n", "before").count() == 0


@pytest.mark.parametrize("task_rows", [100, 1000])
def test_lines_are_written_in_ranges_by_their_number(spark, monkeypatch, tmp_path, task_rows):
    """One task holds and sorts only about TASK_ROWS lines, however little room they take packed; equal lines come once."""
    from weftline import session

    monkeypatch.setattr(session, "TASK_ROWS", task_rows)
    subjects = [f"s{n:03}" for n in range(250)] * 2
    schema = "graph string, s string, p string, o string, o_kind string, datatype string, lang string"
    data = spark.createDataFrame([("data", s, "p", "same", "literal", triples.XSD_STRING, None) for s in subjects], schema)
    path = tmp_path / "out"
    triples.write_ntriples(data, str(path), len(subjects))
    parts = [part.read_text().splitlines() for part in sorted(path.glob("part-*"))]
    assert sum(parts, []) == sorted({f'<{s}> <p> "same" .' for s in subjects})
    if task_rows == 100:
        assert len(parts) == 5 and max(map(len, parts)) <= 100
