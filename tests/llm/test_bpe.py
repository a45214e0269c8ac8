import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from weftline.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [
    "", " ", "Hello world", "it's they'll I'VE 12345 １２", "a\x1cb\x1fc\u0085d e   \n\n x ", "<|endoftext|>",
    "\U0001F600\U0001F468‍\U0001F469 é́ ñ 中文字 ไทย", "x" * 5000, "\x00\x01 ﻿", "tab\t\ttab \r\n", "ÀÉß ſ K",
    "".join(chr(i) for i in range(1, 0x2500)), "a" * 300 + " " * 400 + "!?" * 300,
]


@pytest.fixture(scope="module")
def codec():
    ranks = bpe.read_ranks(PATH)
    return bpe.Codec(bpe.model_of(ranks), np.array(sorted(ranks.values())), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    lines = open(PATH, "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("text", TEXTS)
def test_ids_and_round_trip(codec, reference, text):
    ids = codec.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_every_token_comes_back(codec):
    assert all(codec.decode([r]) == t for t, r in codec.whole.items())
    assert codec.processor.id_to_piece(0) == "<unk>"
    assert codec.processor.encode("", out_type=int) == []


def test_kept_pre_tokens_are_bounded(codec, reference, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 50)
    for part in range(5):
        text = " ".join(f"w{part}q{i}z" for i in range(40))
        assert codec.encode(text) == reference.encode_ordinary(text)
        assert len(codec.kept) <= 121


def test_column(spark, odd, reference):
    made = odd.select("text", bpe.coded(odd, F.col("text"), PATH, public_tokenizers.PATTERN).alias("c")).select("text", "c.*")
    for r in made.collect():
        ids = reference.encode_ordinary(r["text"] or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert odd.limit(0).select(bpe.coded(odd, F.col("text"), PATH, public_tokenizers.PATTERN)).count() == 0


def test_frequent_pre_tokens_are_encoded_once(codec, reference, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 60)
    monkeypatch.setattr(codec, "kept", {})
    asked, encode = [], codec.processor.encode
    monkeypatch.setattr(codec.processor, "encode", lambda texts, **more: asked.extend(texts) or encode(texts, **more))
    for part in range(12):
        text = "".join(f" often{chr(97 + i)}zq" for i in range(10)) + "".join(f" rare{chr(97 + part)}{chr(97 + i)}zq" for i in range(20))
        assert codec.encode(text) == reference.encode_ordinary(text)
        assert len(codec.kept) <= 60
    assert len(asked) == len(set(asked)) == 10 + 12 * 20


def test_ids_leave_a_worker_in_pieces(spark, reference):
    texts = ["", None, "Hello world " * 30_000, "it's", "x y\n" * bpe.IDS_AT_ONCE, "a b c"] * 4
    assert [len(g) for g in bpe._groups([t or "" for t in texts])] == [10, 10, 4]
    docs = spark.createDataFrame(list(enumerate(texts)), "n int, text string").coalesce(1)
    made = docs.select("n", bpe.coded(docs, F.col("text"), PATH, public_tokenizers.PATTERN).alias("c")).collect()
    assert [r["n"] for r in made] == list(range(len(texts)))
    for r in made[:6] + made[-6:]:
        ids = reference.encode_ordinary(texts[r["n"]] or "")
        assert r["c"]["ids"] == ids and r["c"]["n_tokens"] == len(ids)
        assert r["c"]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["c"]["decoded_sha256"] == hashlib.sha256((texts[r["n"]] or "").encode()).hexdigest()
