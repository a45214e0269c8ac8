import re
from collections import Counter

import pytest

from weftline.llm import hosts
from weftline.session import literal_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    )


TEXTS = [
    None, "", " \n ", "a b c", "a b c a b c", "a a a a", "x y\nx y\n x y\n\n\nz", "#*$ %&| <> a#b", "é ß \U0001F600 a\x0bb\x1cc",
    "a b c d a b c e a b c", "a b a b a b", "one two three",
]


def test_measures(spark):
    table = literal_rows(spark, [(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").selectExpr("*", "'s' AS source")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = {r["doc_id"]: tuple(r[n] for n in names) for r in hosts.judge(table).collect()}
    assert found == {i: plain(t) for i, t in enumerate(TEXTS)}


def test_odd_rows(odd):
    found = hosts.judge(odd).collect()
    assert len(found) == odd.count()
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert by_id[4]["n_words"] == 60_000 and by_id[4]["n_repeat_words"] == 0
    assert by_id[1]["base_failed"] and not by_id[1]["kept"]
    assert hosts.judge(odd.limit(0)).count() == 0
    kept = hosts.kept(odd)
    assert kept.columns == odd.columns and [r["doc_id"] for r in kept.collect()] == [4]
    assert hosts.kept(odd.limit(0)).count() == 0


def test_host_rates_are_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    docs = [(f"h{h}", good if i >= h else bad) for h in range(10) for i in range(20)]
    docs += [("rotten", bad)] * 200 + [("rotten", good)] + [("tiny", bad)] + [("clean", good)] * 200
    table = literal_rows(spark, [(i, t, s) for i, (s, t) in enumerate(docs)], "doc_id long, text string, source string")
    rates = {r["source"]: r for r in hosts.judge(table, keys=("source",)).select("source", "host_rate", "kept", "base_failed").collect()}
    counts, fails = Counter(s for s, _ in docs), Counter(s for s, t in docs if t == bad)
    n, k = len(docs), len(counts)
    mean = sum(fails.values()) / n
    squares = sum(fails[s] ** 2 / counts[s] for s in counts)
    noise = mean * (1 - mean)
    room = noise * (n - sum(c * c for c in counts.values()) / n - (k - 1))
    weight = 1 / min(max((squares - n * mean**2 - noise * (k - 1)) / room, 1e-6), 1 - 1e-6) - 1
    for s in counts:
        assert rates[s]["host_rate"] == pytest.approx((fails[s] + mean * weight) / (counts[s] + weight))
    assert mean < rates["tiny"]["host_rate"] < 1
    passing = {(r["source"], r["kept"]) for r in hosts.judge(table, keys=("source",)).collect() if not r["base_failed"]}
    assert ("rotten", False) in passing and ("rotten", True) not in passing
    assert {(f"h{h}", True) for h in range(10)} <= passing and ("clean", True) in passing
    assert hosts.kept(table).count() == sum(t == good and s != "rotten" for s, t in docs)


@pytest.mark.parametrize("texts", [["short"] * 5, [" ".join(f"w{i}" for i in range(60))] * 5])
def test_without_variation(spark, texts):
    table = literal_rows(spark, [(i, t, f"s{i % 2}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    assert {r["kept"] for r in hosts.judge(table).collect()} == {texts[0] != "short"}


def test_a_host_far_from_the_others_is_refused(spark):
    """Seven in ten against one in ten: refused, though below the plain limit."""
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    docs = [(f"h{h}", bad if i < 10 + h % 3 else good) for h in range(20) for i in range(100)]
    docs += [("poor", bad if i < 70 else good) for i in range(100)] + [("fair", bad if i < 45 else good) for i in range(100)]
    table = literal_rows(spark, [(i, t, s) for i, (s, t) in enumerate(docs)], "doc_id long, text string, source string")
    kept = Counter(r["source"] for r in hosts.kept(table).collect())
    assert "poor" not in kept and kept["fair"] == 55 and len(kept) == 21
