import math
import random
import re
import textwrap

import pytest

from weftline.llm import licenses
from weftline.session import literal_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER))


def plain(text, templates, share):
    words = WORD.findall(lower(text))
    places = []
    for phrase, label in licenses.PHRASES:
        p = phrase.split(" ")
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    hits = set()
    lines = [WORD.findall(x) for x in lower(text).split("\n")]
    for at, line in enumerate(lines):
        held = set(line)
        for after in lines[at + 1 : at + 3]:
            if not after:
                break
            held |= set(after)
        for label, body in templates:
            own = set(WORD.findall(lower(body)))
            if len(own & held) >= math.ceil(share * len(own) - 1e-9):
                hits.add((at, label, len(own & held) / len(own)))
    return len(words), sorted(places), sorted(hits)


def found(table, **more):
    return {
        r["doc_id"]: (
            r["n_words"], sorted(map(tuple, r["places"])), sorted(map(tuple, r["matches"]))
        ) for r in licenses.scan(table, **more).collect()
    }


TEXTS = [
    None, "", "--", "Licensed under CC BY-NC 4.0.", "cc by cc by ALL Rights reserved general public license",
    "x\nReleased under the MIT License.\n\nreleased under mit", "This work is licensed under the GNU General Public License, version 3.",
    "all rights\nreserved", "CC-BY ccby cc  by", "é cc by ß", "licensed under the apache license 2 0 version " * 3, "K cc by",
]


def test_against_every_line_and_template(spark):
    table = literal_rows(spark, list(enumerate(TEXTS)), "doc_id long, text string")
    assert found(table) == {i: plain(t, licenses.TEMPLATES, licenses.SHARE) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("share", [0.5, 0.8, 1.0])
def test_filters_lose_nothing(spark, share):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    templates = tuple((f"t{i}", " ".join(rng.sample(words, rng.randrange(1, 12)))) for i in range(12))
    texts = ["\n".join(" ".join(rng.choices(words[: rng.randrange(3, 30)], k=rng.randrange(0, 25))) for _ in range(8)) for _ in range(60)]
    table = literal_rows(spark, list(enumerate(texts)), "doc_id long, text string")
    assert found(table, templates=templates, share=share) == {i: plain(t, templates, share) for i, t in enumerate(texts)}


@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_wrapped_statements(spark, mark):
    texts = [
        "\n".join(["Some words first.", mark, *(mark + x for x in textwrap.wrap(body, 72 - len(mark))), mark, "And last ones."])
        for _, body in licenses.TEMPLATES
    ]
    table = literal_rows(spark, list(enumerate(texts)), "doc_id long, text string")
    for i, (_, _, hits) in found(table).items():
        assert licenses.TEMPLATES[i][0] in {label for _, label, _ in hits}
    broken = literal_rows(spark, [(0, "Released under\n\nthe MIT License"), (1, "released under\n--\nthe mit license")], "doc_id long, text string")
    assert all(not hits for _, _, hits in found(broken).values())


def test_odd_rows(odd):
    assert licenses.scan(odd).count() == odd.count()
    assert licenses.scan(odd.limit(0)).count() == 0
