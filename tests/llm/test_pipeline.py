"""The pipeline and the queries over the smallest tables, against plain Python or SQL."""

import base64
import hashlib
import sys
from collections import Counter, defaultdict
from itertools import pairwise
from pathlib import Path

import corpus_pipeline
import pandas as pd
import public_tokenizers
import pytest
import tiktoken

from weftline.llm import balance, keyscan, queries, simhash

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from check_oracle import compare, connect
from test_balance import filled
from test_hosts import plain as measures
from test_near_texts import shingles
from test_simhash import reach

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries(spark, name):
    ok, detail = compare(spark, connect(FOLDER), name, FOLDER, queries.queries()[name], queries.oracle_sql().get(name))
    assert ok, detail


def test_every_operator_has_a_query():
    names = {n.split("_")[0] for n in queries.queries()}
    assert names == {f"op{i}" for i in range(1, 14)} | {"pipeline"}


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{FOLDER}/documents.parquet")


def step(spark, name, docs):
    stage = dict(corpus_pipeline.STAGES)[name]
    return stage(spark, spark.createDataFrame(docs), FOLDER)


def passing(docs):
    found = [measures(t) for t in docs.text]
    return docs[[n >= 50 and 100 * repeated <= 50 * n for n, _, _, _, repeated in found]]


def similar(one, two):
    shared = len(one & two)
    return 5 * shared >= 4 * (len(one) + len(two) - shared)


def candidate(one, two):
    """Within 14 bits, and at most one bit apart in one of five runs."""
    away = one ^ two
    edges = [0, 13, 26, 38, 51, 64]
    return away.bit_count() <= 14 and any((away >> a & (1 << b - a) - 1).bit_count() <= 1 for a, b in pairwise(edges))


def distinct(docs, ask=candidate):
    """Over all pairs: one document of each group of candidates with a Jaccard similarity of 0.8 or more."""
    sets, prints = [shingles(t) for t in docs.text], [simhash.fingerprint_of(t, 5) for t in docs.text]
    near = [
        (i, j) for j in range(len(sets)) for i in range(j + 1)
        if ask(prints[i], prints[j]) and similar(sets[i], sets[j])
    ]
    least = defaultdict(list)
    for i, root in reach(near).items():
        least[root].append(docs.doc_id.iloc[i])
    return docs[docs.doc_id.isin([min(ids) for ids in least.values()])]


def test_recall_of_near_duplicates(spark):
    """Against every pair of 0.8 or more: nothing else goes, and nine in ten of what is to go do."""
    path = FOLDER.replace("0.001", "0.01") + "/documents.parquet"
    table = pd.read_parquet(path)
    whole = set(distinct(table, ask=lambda one, two: True).doc_id)
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, spark.read.parquet(path), FOLDER).collect()}
    assert whole <= kept and 10 * len(kept - whole) <= len(table) - len(whole)


def test_stages(spark, documents):
    expected = passing(documents)
    kept = step(spark, "quality_rules", documents).toPandas()
    assert sorted(kept.doc_id) == sorted(expected.doc_id) and len(expected) < len(documents)
    expected = distinct(expected)
    single = step(spark, "near_duplicates", kept).toPandas()
    assert sorted(single.doc_id) == sorted(expected.doc_id) and len(expected) < len(kept)
    clean = step(spark, "secrets", single).toPandas()
    assert dict(zip(clean.doc_id, clean.text, strict=True)) == {
        i: keyscan.redacted_of(t) for i, t in zip(single.doc_id, single.text, strict=True)
    }
    assert (clean.n_chars == clean.text.str.len()).all() and set(clean.columns) == set(documents.columns)
    mixed = step(spark, "mixing", clean).toPandas()
    assert set(mixed.columns) == set(documents.columns)
    words = clean.assign(size=clean.text.str.split().str.len())
    aims = filled(words.groupby("source")["size"].sum().to_dict(), balance.WEIGHTS)
    taken = mixed.assign(size=mixed.text.str.split().str.len()).groupby("source")["size"].sum()
    longest = words.groupby("source")["size"].max()
    assert all(abs(taken.get(s, 0) - t) <= longest[s] + 1 for s, t in aims.items())
    assert max(Counter(mixed.doc_id).values()) <= 3
    coded = step(spark, "encoding", mixed).toPandas()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = dict(zip(mixed.doc_id, mixed.text, strict=True))
    assert len(coded) == len(mixed)
    for r in coded.drop_duplicates("doc_id").itertuples():
        assert list(r.ids) == own.encode_ordinary(texts[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_is_the_stages_in_turn(spark, documents):
    found = corpus_pipeline.run(spark, FOLDER).toPandas()
    docs = documents
    for name, _ in corpus_pipeline.STAGES:
        docs = step(spark, name, docs).toPandas()
    assert sorted(found.ids_sha256) == sorted(docs.ids_sha256)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_documents(spark, odd, name):
    docs = odd.withColumnRenamed("n_words", "n_chars")
    stage = dict(corpus_pipeline.STAGES)[name]
    made = stage(spark, docs, FOLDER)
    assert name == "encoding" or made.columns == docs.columns
    made.write.format("noop").mode("overwrite").save()
    assert stage(spark, docs.limit(0), FOLDER).count() == 0
