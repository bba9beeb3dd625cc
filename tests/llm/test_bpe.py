"""BPE against the tokenizers library, and exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inspectra.llm import bpe, queries
from conftest import SF_SMALL

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "   a", "a   ", "\n\n \t x", "don't I'LL we've'", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext",
       "é日本語😀‍👩́", "\x00\x1c\x1d\x1e\x1f\x85\xa0 ᠎ ​﻿", "a" * 3000, "ab" * 2000, " " * 4000 + "x", "1234567890 ²½Ⅷ",
       "***&&&###", "Straße ǅͅ", "x\r\ny\r\n\r\n", "퟿\U0010ffff", "the " * 30_000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(library, texts):
    ids, sizes = bpe.load(PATH).encode(texts)
    mine = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert mine == want
    assert bpe.load(PATH).decode(ids, sizes) == [library.decode(x, skip_special_tokens=False) for x in mine]


def test_odd_texts(library):
    same(library, ODD)


def test_every_code_point(library):
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0xE0000, 0xE0200)]
    same(library, ["".join(f"a{c}1{c} {c}" for c in points[i:i + 4000]) for i in range(0, len(points), 4000)])


@pytest.mark.parametrize("many", [1, 12, 10**9])
def test_random_merges(library, monkeypatch, many):
    monkeypatch.setattr(bpe, "_MANY", many)
    bpe.load(PATH)._forget()
    rng = random.Random(2)
    same(library, ["".join(rng.choice("abcdeinrst h") for _ in range(rng.randrange(400))) for _ in range(300)])


@given(st.lists(st.text(max_size=40), max_size=4))
@settings(max_examples=200, deadline=None)
def test_any_text(texts):
    same(Tokenizer.from_file(PATH) if not hasattr(test_any_text, "lib") else test_any_text.lib, texts)


test_any_text.lib = Tokenizer.from_file(PATH)


def test_decode_of_broken_bytes(library):
    tok = bpe.load(PATH)
    for raw in (b"\xff", b"a\xe6\x97", b"\xf0\x9f\x98b", b"\xed\xa0\x80"):
        ids = [int(tok.byte_ids[b]) for b in raw]
        assert tok.decode(np.array(ids), np.array([len(ids)])) == [library.decode(ids, skip_special_tokens=False)]


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_query_matches_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.QUERIES["op6_bpe"](spark, SF_SMALL).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(texts[r.doc_id]))


def test_nulls_repeats_clashing_columns_empty_table(spark, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    rows = [(1, None, 1), (2, "", 2), (3, "hello world", 3), (3, "hello world", 3), (None, "x", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = bpe.decode(bpe.encode(df)).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in out) == [(0, "x"), (1, ""), (2, ""), (3, "hello world"), (3, "hello world")]
    assert bpe.decode(bpe.encode(df.limit(0))).count() == 0
