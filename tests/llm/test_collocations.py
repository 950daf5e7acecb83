from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from slotledger.llm import collocations, quotient_filter

PIECE = re.compile(r"[.,;:!?\x0A-\x0D]")


def _brute(rows, least, longest=5, first=None):
    """Rows of (text, lang) to sorted result rows."""
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in PIECE.split(lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        often = {g: c for g, c in counts.items() if c >= least and len(g) > 1}
        best = []
        for g, a in often.items():
            m = len(g)
            if any(len(h) > m and c >= a and any(h[i : i + m] == g for i in range(len(h))) for h, c in often.items()):
                continue
            score, k = min(
                ((1000 * a * total[lang]) // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, m)
            )
            best.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def _found(df, **params):
    return sorted(tuple(r) for r in collocations.phrases(df, **params).collect())


def test_awkward_documents(spark, awkward):
    rows = [(r["text"], r["lang"]) for r in awkward.collect()]
    wanted = _brute(rows, 3)
    assert len(wanted) > 20
    assert _found(awkward, least=3) == wanted
    assert _found(awkward, least=3, first=4) == _brute(rows, 3, first=4)


def test_languages_pieces_and_ties(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        words = [rng.choice(["a", "B", "c", "É", "\xa0x", "a\x00", "\x1c", "Zz"]) for _ in range(rng.randint(0, 30))]
        joined = "".join(w + rng.choice([" ", "\t", "  ", ", ", "\n", ".", " ! ", "\x0b", "\r\n"]) for w in words)
        rows.append((joined, [None, "en", "", "und"][i % 4]))
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert _found(df, least=8) == _brute(rows, 8)


def test_many_ranges_and_wide_keys(spark, awkward, monkeypatch):
    """Filters split by range; ids that need two columns a key; a bitmap that lets much through."""
    monkeypatch.setattr(collocations, "RANGE_KEYS", 16)
    monkeypatch.setattr(collocations, "MOST_BITS", 1 << 16)
    rows = [(r["text"], r["lang"]) for r in awkward.collect()]
    assert _found(awkward, least=2, longest=5) == _brute(rows, 2)


def test_no_documents(spark, no_documents):
    assert _found(no_documents) == []
    assert _found(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")) == []


@pytest.mark.parametrize("k, bits", [(2, 1), (2, 31), (3, 31), (5, 12), (5, 13), (5, 31)])
@pytest.mark.parametrize("range_bits", [0, 1, 7, 14])
def test_filters_hold_every_count(k, bits, range_bits):
    rng = np.random.default_rng(k * bits)
    packing = quotient_filter.Packing(k, bits)
    shards, wanted = defaultdict(list), Counter()
    for _ in range(3):
        words = (rng.integers(0, 1 << bits, 4000) >> rng.integers(0, bits, 4000)).astype(np.int64)
        words[100:1500] = 1 if bits > 1 else words[100:1500]  # counts beyond a byte
        starts = np.arange(len(words) - k + 1)
        wanted.update(tuple(words[i : i + k].tolist()) for i in starts)
        keys, counts = quotient_filter.summed(packing.scatter(words, starts))
        for part, blob in quotient_filter.filters(keys, counts, range_bits, packing):
            shards[part].append(blob)
    found = Counter()
    for part, blobs in shards.items():
        keys, counts = quotient_filter.merged(blobs, part, range_bits, packing)
        for gram, n in zip(packing.gather(keys).tolist(), counts.tolist(), strict=True):
            found[tuple(gram)] = n
    assert found == wanted
    assert max(wanted.values()) > 255


@pytest.mark.parametrize("k, bytes_a_gram", [(2, 5), (5, 11)])
def test_filters_are_compact(k, bytes_a_gram):
    words = np.random.default_rng(1).integers(0, 1 << 16, 200_000)
    packing = quotient_filter.Packing(k, 16)
    keys, counts = quotient_filter.summed(packing.scatter(words, np.arange(len(words) - k + 1)))
    size = sum(len(b) for _, b in quotient_filter.filters(keys, counts, 4, packing))
    assert size < bytes_a_gram * len(keys)


@pytest.mark.parametrize("width", [1, 2, 3, 15, 16, 34, 63, 64])
def test_permutation_is_a_bijection(width):
    x = np.arange(1 << width) if width < 17 else np.random.default_rng(2).integers(0, 1 << width - 1, 1000)
    x = x.astype(np.uint64)
    y = quotient_filter.permuted(x, width)
    assert (quotient_filter.restored(y, width) == x).all()
    assert (y >> np.uint64(width - 1)).max() <= 1 and len(np.unique(y)) == len(np.unique(x))


def test_neighbouring_numbers_spread_over_the_ranges():
    parts = quotient_filter.permuted(np.arange(1 << 14, dtype=np.uint64), 34) >> np.uint64(26)
    assert np.bincount(parts.astype(int), minlength=256).max() < 2 * (1 << 14) / 256
