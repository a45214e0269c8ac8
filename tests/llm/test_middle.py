import hashlib
import random

import numpy as np
import pytest

from weftline.llm import middle
from weftline.session import literal_rows

CHARS = ["a", "é", "€", "\U0001F600", "\x00", "́", "<", "P>", "\U0010FFFF"]


def made(rng, size):
    return "".join(rng.choice(CHARS) for _ in range(size))


def drawn(key, seed="1"):
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def plainly(key, text, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    a, b, c, d = drawn(key)
    low, high = sorted((a % (len(text) + 1), b % (len(text) + 1)))
    pre, mid, suf = text[:low], text[low:high], text[high:]
    p, s, m = marks
    if not text or any(x in text for x in marks) or c % 100 >= 90:
        return len(text), "plain", None, None, text
    if d % 100 < 20:
        return len(text), "spm", low, high - low, s + suf + p + pre + m + mid
    return len(text), "psm", low, high - low, p + pre + s + suf + m + mid


@pytest.mark.parametrize("size", [0, 1, 7, 8, 9, 63, 64, 1000])
def test_code_points_by_words(size):
    text = made(random.Random(size), size)
    data = text.encode()
    points = middle.CodePoints(np.frombuffer(data, dtype=np.uint8))
    ends = [len(text[:k].encode()) for k in range(len(text) + 1)]
    assert points.after(np.arange(len(text) + 1)).tolist() == ends
    assert points.count(np.array(ends)).tolist() == list(range(len(text) + 1))
    inside = [sum(e <= b for e in ends[1:]) for b in range(len(data) + 1)]
    assert points.count(np.arange(len(data) + 1)).tolist() == inside


def test_against_slices(spark):
    rng = random.Random(5)
    docs = [(i, made(rng, rng.choice([0, 1, 2, 9, 50, 400]))) for i in range(400)] + [(900 + i, t) for i, t in enumerate(["<P>", "x<S>", "<M>y", "<", "<P"])]
    found = middle.infilled(literal_rows(spark, docs, "doc_id long, text string").repartition(3)).collect()
    assert len(found) == len(docs)
    texts, forms = dict(docs), set()
    for r in found:
        n, form, low, mid, out = plainly(r["doc_id"], texts[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == (n, form, low, mid, out)
        assert r["output_sha256"] == hashlib.sha256(out.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}


def test_texts_over_several_blocks(spark):
    rng = random.Random(9)
    docs = [(i, made(rng, 1000) * 2000) for i in range(3)]
    for r in middle.infilled(literal_rows(spark, docs, "doc_id long, text string"), with_output=False).collect():
        n, form, low, mid, out = plainly(r["doc_id"], docs[r["doc_id"]][1])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, low, mid)
        assert r["output_sha256"] == hashlib.sha256(out.encode()).hexdigest()


def test_odd_rows(odd):
    found = middle.infilled(odd).collect()
    docs = odd.select("doc_id", "text").collect()
    expected = sorted((repr((r["doc_id"], *plainly(r["doc_id"], r["text"]))) for r in docs))
    assert sorted(repr((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])) for r in found) == expected
    assert middle.infilled(odd.limit(0)).count() == 0


def test_marks_that_could_be_mistaken(odd):
    for marks in (("<P>", "<P>", "<M>"), ("a", "ba", "c"), ("", "x", "y"), ("aa", "b", "c")):
        with pytest.raises(ValueError):
            middle.infilled(odd, marks=marks)
