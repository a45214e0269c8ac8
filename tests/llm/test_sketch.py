import hashlib
import random

from weftline.llm import sketch
from weftline.session import literal_rows


def holding(of):
    made = sketch.Sketched("")
    made.digests = of
    return made


def test_difference_is_exact():
    rng = random.Random(2)
    for size in (0, 1, 3, 20, 200, 2000):
        shared = [rng.getrandbits(64) for _ in range(size)]
        left = shared + [rng.getrandbits(64) for _ in range(rng.randrange(size + 2))]
        right = shared + [rng.getrandbits(64) for _ in range(rng.randrange(size + 2))]
        assert sketch.difference(holding(left), holding(right)) == (set(left) - set(right), set(right) - set(left))


def test_peeling_can_stop_and_goes_on_larger():
    left, right = list(range(1, 80)), list(range(1000, 1080))
    assert sketch.peel(sketch.sketch(left), sketch.sketch(right)) is None
    assert sketch.difference(holding(left), holding(right)) == (set(left), set(right))


def test_large_sketches_spread_over_all_cells():
    rng = random.Random(3)
    for part in (1 << 12, 1 << 16, (1 << 16) + 1, 1 << 20, 1 << 23, 1 << 26):
        places = [sketch._places(rng.getrandbits(64), 3 * part) for _ in range(4000)]
        for k in range(3):
            inside = [p[k] - k * part for p in places]
            assert 0 <= min(inside) and max(inside) < part
            counts = [sum(x * 8 // part == eighth for x in inside) for eighth in range(8)]
            assert min(counts) > 400 and max(counts) < 600


def test_difference_of_many_digests():
    rng = random.Random(5)
    left, right = ([rng.getrandbits(64) for _ in range(60_000)] for _ in range(2))
    assert sketch.difference(holding(left), holding(right)) == (set(left), set(right))


def test_pieces():
    assert list(sketch.pieces("a\n\n \nb ")) == [b"a", b"b"]
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    whole = set(sketch.pieces(" ".join(words)))
    changed = set(sketch.pieces(" ".join([*words[:1500], "new", *words[1500:]])))
    assert len(whole) > 50 and len(whole ^ changed) <= 4
    assert len(sketch.digests("a\na\na")) == 3
    assert sketch.digests("a\nb") == sketch.digests("a\nb")


def test_short_texts_and_single_lines_keep_two_thirds():
    rng = random.Random(12)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choices(alphabet, k=rng.randrange(2, 9)))
    texts = [" ".join(word() for _ in range(n)) for n in (2, 3, 5, 8, 12, 20, 30, 50, 70, 100, 200, 400) for _ in range(25)]
    texts += ["\n".join(" ".join(word() for _ in range(n)) for _ in range(3)) for n in (2, 5, 30, 65) for _ in range(25)]
    texts += ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n)) for n in (20, 60, 300) for _ in range(25)]
    texts += ["".join(rng.choices(alphabet, k=n)) for n in (9, 40, 300) for _ in range(25)]
    rng.shuffle(texts)
    for own, following in zip(texts, texts[1:] + texts[:1], strict=True):
        a, b, c = map(sketch.Sketched, (own, sketch.edited(own, following), following))
        assert sketch.likeness(a, b) > sketch.likeness(a, c), own


def test_a_word_more_at_the_start_changes_few_pieces():
    rng = random.Random(13)
    words = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    whole, changed = (set(sketch.pieces(" ".join(w))) for w in (words, ["new", *words]))
    assert len(whole & changed) > 0.6 * len(whole)


def plain(rows):
    """Likeness from the digests themselves."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] is not None, r[1] or "")))
    out = []
    for at, (key, text) in enumerate(order):
        text, following = text or "", order[(at + 1) % len(order)][1] or ""
        third = len(text) // 3
        changed = text[: len(text) - third] + following[:third]

        def like(a, b):
            a, b = set(sketch.digests(a)), set(sketch.digests(b))
            return round(1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0, 9)

        out.append((key, len(text), hashlib.sha256(changed.encode()).hexdigest(), like(text, changed), like(text, following)))
    return sorted(out, key=repr)


def found(table, **more):
    return sorted((
        (r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9))
        for r in sketch.versions(table, **more).collect()
    ), key=repr)


def test_versions(spark):
    rng = random.Random(9)
    lines = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 90))) for _ in range(40)]
    rows = [(i * 3 % 101, "\n".join(rng.choices(lines, k=rng.randrange(0, 12)))) for i in range(101)]
    rows += [(7, "seven"), (7, None), (None, "no key"), (None, None)]
    table = literal_rows(spark, rows, "doc_id long, text string")
    for bins in (1, 5, 64):
        assert found(table, bins=bins) == plain(rows)


def test_one_row_and_none(spark):
    one = literal_rows(spark, [(4, "abcdef\nx")], "doc_id long, text string")
    assert found(one) == plain([(4, "abcdef\nx")])
    alone = literal_rows(spark, [(None, "abc")], "doc_id long, text string")
    assert found(alone) == plain([(None, "abc")])
    assert sketch.versions(one.limit(0)).count() == 0


def test_odd_rows(odd):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert found(odd) == plain(rows)
    made = sketch.versions(odd).collect()
    by_text = {}
    for r in made:
        by_text.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert len(by_text[5]) == 1 and by_text[1] == by_text[2] == by_text[3]
