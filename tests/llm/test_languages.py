import zlib
from collections import Counter

import numpy as np
import pytest

from weftline.llm import languages
from weftline.session import literal_rows

WORDS = {
    "en": "the of and with that this there which from house water over", "de": "der und nicht mit für über straße haus wasser auch ein",
    "fr": "le la les avec pour où être maison eau très une dans", "el": "και το νερό σπίτι με για που είναι",
}


def texts(lang, many, seed):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS[lang].split(), 30)) for _ in range(many)]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i * 10 + k, t, lang) for k, lang in enumerate(WORDS) for i, t in enumerate(texts(lang, 60, k))]
    rows += [(9001, None, "en"), (9002, "", "en"), (9003, "123 !?", "en"), (9004, "the house", None), (None, "la maison", "fr"), (9005, "z", None), (1, "the", "en")]
    return literal_rows(spark, rows, "doc_id long, text string, lang string").selectExpr("*", "1.0 AS score", "true AS held_out")


def test_held_out_texts(corpus):
    found = languages.identify(corpus).collect()
    assert len(found) == corpus.count()
    known = {r["doc_id"]: r["lang"] for r in corpus.collect()}
    held = [r for r in found if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 9000]
    assert len(held) > 30 and all(r["lang_pred"] == known[r["doc_id"]] for r in held)
    by_id = {r["doc_id"]: r for r in found}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (9001, 9002, 9003))
    assert by_id[9004]["lang_pred"] == "en" and by_id[None]["lang_pred"] == "fr"
    assert by_id[9005]["lang_pred"] in WORDS
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_nothing_learnt(corpus):
    assert languages.identify(corpus.limit(0)).count() == 0
    blind = corpus.drop("lang").selectExpr("*", "cast(null as string) AS lang")
    assert {r["lang_pred"] for r in languages.identify(blind).collect()} == {"und"}


def test_counts_against_plain(corpus, spark):
    def grams(text):
        codes = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        return Counter(codes[i : i + 3] for i in range(len(codes) - 2) if codes[i : i + 3].strip())

    expected = Counter()
    for r in corpus.where("text is not null and lang is not null").collect():
        for g, n in grams(r["text"]).items():
            expected[r["lang"], sum(ord(c) << s for c, s in zip(g, (42, 21, 0), strict=True))] += n
    found = languages.gram_counts(corpus.where("text is not null and lang is not null"))
    assert {(r["lang"], r["gram"]): r["n"] for r in found.collect()} == expected


def test_filters_have_no_false_negatives_and_few_false_positives(corpus):
    learnt = languages.learn(corpus.where("text is not null and lang is not null"), slots=1 << 12)
    assert learnt.languages == sorted(WORDS)
    for lang in WORDS:
        total, held = learnt.counts(" ".join(WORDS[lang].split()))
        assert held[learnt.languages.index(lang)] > 0.6 * total
    assert (learnt.false_rate < 0.05).all()


def test_more_languages_than_a_word_has_bits(spark):
    rows = [(i, " ".join(chr(0x4E00 + 40 * i + k) * 3 for k in range(30)), f"l{i:03d}") for i in range(70)]
    learnt = languages.learn(literal_rows(spark, rows, "doc_id long, text string, lang string"))
    assert learnt.table.shape[0] == 2
    assert [learnt.decide(t)[0] for _, t, _ in rows] == [lang for _, _, lang in rows]


def test_chunks_lose_nothing(monkeypatch):
    text = "the quick brown fox " * 20
    whole = np.sort(np.concatenate(list(languages.grams_of(text))))
    monkeypatch.setattr(languages, "CHUNK", 17)
    assert np.array_equal(np.sort(np.concatenate(list(languages.grams_of(text)))), whole)


def test_every_learnt_trigram_is_held(spark):
    """With shares of 0 a trigram seen once in a language's texts is in its filter; by default a stray is not."""
    rows = [(0, "zzz " * 5000 + "abc", "one"), (1, "abc " * 5000 + "zzz", "two")]
    table = literal_rows(spark, rows, "doc_id long, text string, lang string")
    learnt = languages.learn(table, least_share=0.0, least_part=0.0)
    for text in ("abc", "zzz"):
        total, held = learnt.counts(text)
        assert list(held) == [total, total]
    assert learnt.table.shape == (1, languages.LEAST_SLOTS)
    assert list(languages.learn(table).counts("zzz")[1]) == [total, 0]
