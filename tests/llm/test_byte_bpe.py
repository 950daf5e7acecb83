from __future__ import annotations

import random

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from slotledger.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    return byte_bpe.Tokenizer(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(tokenizer):
    ranks = tokenizer.vocabulary().ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_library(tokenizer, library):
    rng, own = random.Random(1), tokenizer.vocabulary()
    texts = ["", "é😀 \n\n  x\t y", "a" * 3000, "<|endoftext|>", " " * 500, "it's WE'LL 12345 don't"]
    texts += ["".join(rng.choice("abcdefé ñ\n😀12 .,!'s") for _ in range(rng.randint(1, 900))) for _ in range(60)]
    for text in texts:
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text) and own.decode(ids) == text.encode()


def test_rows_of_many_matches_equal_single_trees(tokenizer, monkeypatch):
    """Lengths around powers of two, runs of one byte, and a cache that turns over all the time."""
    monkeypatch.setattr(byte_bpe, "CACHE_ENTRIES", 50)
    monkeypatch.setattr(byte_bpe, "CHUNK_CHARS", 300)
    monkeypatch.setattr(byte_bpe, "ROWS", 7)
    rng, own = random.Random(2), tokenizer.vocabulary()
    pieces = [bytes(rng.choice(b"abcthein \xc3\xa9\x00") for _ in range(rng.randint(2, 64))) for _ in range(400)]
    pieces += [bytes([b]) * n for b in b"a \x00\xff" for n in (2, 3, 4, 5, 31, 32, 33, 63, 64)]
    for size in (2, 4, 8, 16, 32, 64):
        fit = [p for p in pieces if size // 2 < len(p) <= size]
        ids, ends = own.merge_rows(fit, size)
        assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [_merged(own.ranks, p) for p in fit]
    texts = ["".join(rng.choice("abcdefghij 12é") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    assert own.encode_all(texts) == [own.encode(t) for t in texts]
    assert len(own.cache) < 1000


def _merged(ranks, piece):
    """Merging by its definition: the least rank first, the leftmost among equals."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_digests_of_all_rows(tokenizer, library, awkward, documents):
    for docs in (awkward, documents):
        found = sorted((tuple(r) for r in byte_bpe.round_trip(docs, tokenizer).collect()), key=repr)
        wanted = []
        for doc, text in docs.select("doc_id", "text").collect():
            ids = library.encode_ordinary(text or "")
            wanted.append((doc, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(text or "")))
        assert found == sorted(wanted, key=repr)


def test_columns_of_ids_and_bytes(tokenizer, spark):
    docs = spark.createDataFrame([("a b",), (None,), ("",)], "text string")
    ids = docs.select("text", byte_bpe.encode(docs.text, tokenizer).alias("ids"))
    rows = ids.select("text", "ids", byte_bpe.decode(ids.ids, tokenizer).alias("back")).collect()
    assert [bytes(r["back"]) for r in rows] == [b"a b", b"", b""] and rows[1]["ids"] == []


def test_empty_table(no_documents, tokenizer):
    assert byte_bpe.round_trip(no_documents, tokenizer).count() == 0
