import random
import zlib

import numpy as np
import pytest

from weftline.llm import subword
from weftline.session import literal_rows


def plain(text):
    """Words and n-grams as byte strings; their number must fit the buckets', equal ones must share a bucket."""
    out = []
    for word in text.split():
        data = f" {word} ".encode()
        out.append(word)
        out += [data[i : i + n] for n in subword.GRAMS for i in range(len(data) - n + 1)]
    return out


@pytest.mark.parametrize("text", ["", "a", "ab", "hello world", "é ß longerword x", "tab\tnew\nline  two"])
def test_features(text):
    ids = np.concatenate(list(subword.features(text)))
    grams = plain(text)
    assert len(ids) == len(grams) + 1
    assert len(set(ids[1:].tolist())) == len(set(map(repr, grams)))


def test_features_by_place_and_chunk(monkeypatch):
    one = np.sort(np.concatenate(list(subword.features("alpha beta")))[1:])
    both = np.sort(np.concatenate(list(subword.features("alpha beta alpha beta")))[1:])
    assert np.array_equal(np.unique(one), np.unique(both)) and len(both) == 2 * len(one)
    text = "some words of a text " * 50
    whole = np.sort(np.concatenate(list(subword.features(text))))
    monkeypatch.setattr(subword, "CHUNK", 64)
    assert np.array_equal(np.sort(np.concatenate(list(subword.features(text)))), whole)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    good, bad = [f"good{i}ly" for i in range(50)], [f"spam{i}###" for i in range(50)]
    rows = [(i, " ".join(rng.choices(good if i % 3 else bad, k=40)), int(i % 3 > 0)) for i in range(400)]
    docs = literal_rows(spark, [r[:2] for r in rows] + [(None, "good1ly"), (900, None), (901, ""), (5, rows[5][1])], "doc_id long, text string")
    labels = literal_rows(spark, [(r[0], r[2]) for r in rows[:300]] + [(None, 1), (901, None), (7, rows[7][2])], "doc_id long, quality int")
    return docs.selectExpr("*", "1.0 AS score", "1 AS label"), labels, {r[0]: r[2] for r in rows}


def test_held_out(corpus):
    docs, labels, truth = corpus
    found = subword.classify(docs, labels).collect()
    assert len(found) == docs.count()
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if r["doc_id"] in truth:
            assert r["predicted"] == truth[r["doc_id"]]
    assert sorted(map(str, found)) == sorted(map(str, subword.classify(docs.repartition(3), labels).collect()))


def test_bound_and_nothing(corpus):
    docs, labels, _ = corpus
    assert subword.classify(docs, labels, most=20).count() == docs.count()
    assert {r["score"] for r in subword.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert subword.classify(docs.limit(0), labels).count() == 0
