from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from slotledger.llm import rans, token_files
from slotledger.llm.scratch import new_path

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return token_files.WordTokenizer(PATH)


def test_read_back_equals_library(awkward, documents, spark, tokenizer, monkeypatch):
    plain = Tokenizer.from_file(PATH)
    for docs in (documents, awkward.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        path = new_path(spark, "test")
        token_files.write_files(docs, path, tokenizer)
        found = {r["doc_id"]: r for r in token_files.read_files(spark, path, with_ids=True).collect()}
        rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
        assert len(found) == len(rows)
        start = 0
        for doc, text in rows:
            ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
            got = found[doc]
            assert (got["start"], got["n_tokens"], got["ids"]) == (start, len(ids), ids)
            assert got["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
            start += len(ids)


def test_added_tokens_and_odd_words_equal_library(tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_WORDS", 40)
    plain, own, rng = Tokenizer.from_file(PATH), tokenizer.encoder(), random.Random(3)
    words = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "a", "It's", "b2b", "é", "😀", " ", "\n", "|>",
             "<|", "we'll", "x" * 40, "é,", "été", "l'Été", "ß÷ø", "ÿ1", "e\u0301", "\xa0é", "\u2028", "12"]
    texts = ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randint(0, 25))) for _ in range(600)]
    for start in range(0, len(texts), 50):
        some = texts[start : start + 50]
        found = own.encode([t.encode() for t in some])
        for text, ids in zip(some, found, strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_null_and_repeated_ids_keep_their_own_places(awkward, tokenizer):
    rows = token_files.written_and_read(awkward, tokenizer).orderBy("start").collect()
    assert len(rows) == awkward.count() and rows[0]["doc_id"] is None and rows[0]["start"] == 0
    for a, b in zip(rows, rows[1:], strict=False):
        assert b["start"] == a["start"] + a["n_tokens"]


def test_empty_table(no_documents, tokenizer):
    assert token_files.written_and_read(no_documents, tokenizer).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 1000, 1025, 300_000])
def test_blocks_decode_to_what_was_encoded(n):
    symbols = np.minimum(np.random.default_rng(n).zipf(1.3, n), 49_407)
    table = rans.Table(rans.quantise(np.bincount(symbols, minlength=49_408) if n else np.ones(4)))
    blob = rans.encode_block(symbols, table)
    assert (rans.decode_block(blob, table) == symbols).all()
    if n > 200_000:
        assert (rans.decode_block(blob, table, first=1) == symbols[128 * 1024 :]).all()
        share = np.bincount(symbols) / n
        share = share[share > 0]
        assert len(blob) < 1.1 * n * -(share * np.log2(share)).sum() / 8


def test_damage_is_found():
    table = rans.Table(rans.quantise(np.array([5, 3])))
    blob = bytearray(rans.encode_block(np.array([0, 1, 0, 0, 1]), table))
    blob[-1] ^= 1
    with pytest.raises(ValueError):
        rans.decode_block(bytes(blob), table)


def test_table_keeps_every_symbol():
    counts = np.ones(60_000)
    counts[0] = 1e12
    freq = rans.quantise(counts)
    assert freq.sum() == 1 << rans.SCALE_BITS and freq.min() == 1
