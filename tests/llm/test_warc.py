import pytest

from weftline.llm import warc
from weftline.session import literal_rows, scratch_path

PAGES = [
    (3, "https://Blog.Example.com/a?x=1#top", "<p>one</p>"), (1, "http://example.com/b", "<p>one</p>"),
    (2, "http://example.com/c d\r\nX: y", ""), (5, "http://example.com/", None), (4, None, "é\r\n\r\nWARC/1.1"),
    (7, "http://[bad", "<p>two</p>"), (7, "http://[bad", "<p>two</p>"), (None, "http://example.com/z", "<p>one</p>"),
    (None, "http://example.com/z", "alone"), (9, "not a url", "y" * 200_000), (10, "http://example.com:81/q", "<p>two</p>"),
]
SCHEMA = "page_id long, url string, html string, sha1 string, row long, key string"


@pytest.fixture(scope="module")
def pages(spark):
    return literal_rows(spark, [(*p, "x", 1, "k") for p in PAGES], SCHEMA)


def key(row):
    return tuple((x is not None, x) for x in row)


def test_round_trip(spark, pages):
    found = warc.archived(pages, payloads=True).collect()
    rows = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload"]) for r in found), key=key)
    assert rows == sorted([
        (1, "response", None, b"<p>one</p>"), (3, "revisit", 1, None), (None, "revisit", 1, None),
        (2, "response", None, b""), (5, "revisit", 2, None), (4, "response", None, "é\r\n\r\nWARC/1.1".encode()),
        (7, "response", None, b"<p>two</p>"), (7, "revisit", 7, None), (10, "revisit", 7, None),
        (None, "response", None, b"alone"), (9, "response", None, b"y" * 200_000),
    ], key=key)
    sizes = {(r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in found}
    assert sizes == {(i, len((h or "").encode()), warc.sha1_base32((h or "").encode())) for i, _, h in PAGES}


def test_small_payloads_are_all_responses(pages):
    kinds = sorted((r["payload_bytes"], r["record_type"]) for r in warc.archived(pages, least_bytes=11).collect())
    assert all(kind == "response" for _, kind in kinds) and len(kinds) == len(PAGES)


def test_index_of_many_blocks_and_files(spark):
    pages = literal_rows(spark, [(i, f"http://h{i % 7}.example.com/{i % 50}", f"p{i % 90}") for i in range(500)], "page_id long, url string, html string")
    folder = scratch_path(spark, "archive")
    captures = warc.write_archives(pages.repartition(3), folder, archive_bytes=2000)
    assert captures.select("file").distinct().count() > 6
    index = warc.write_index(captures, folder, block_lines=7)
    assert sum(r["lines"] for r in index.collect()) == 500
    found = warc.lookup(captures.select("key", "part", "row"), index, folder)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, captures.select("part", "row", "file", "offset", "length").collect()))
    missing = literal_rows(spark, [("", 0, -1), ("com,example,h3)/zzz", 0, 5), ("zzz", 0, 1)], "key string, part long, row long")
    assert warc.lookup(missing, index, folder).count() == 0


def test_nothing(pages):
    assert warc.archived(pages.limit(0)).count() == 0


def test_keys():
    assert warc.url_key("HTTPS://Blog.Example.com/a?x=1#top") == "com,example,blog)/a?x=1"
    assert warc.url_key("http://example.com:81") == "com,example:81)/"
    assert warc.url_key(None) == ""


def test_damage_is_an_error():
    made = warc.record(1, "u", b"payload", None, False)
    assert warc.parsed(made)[0] == 1
    with pytest.raises(ValueError):
        warc.parsed(made.replace(b"payload\r\n", b"paYload\r\n"))
