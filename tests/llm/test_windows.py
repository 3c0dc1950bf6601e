"""Repeated word windows against a brute-force version."""

import hashlib
import random
import re

import numpy as np
import pytest

from placewright.llm import windows


def brute(rows):
    last = (1, 0)
    order = lambda d, t: ((0, d) if d is not None else last, hashlib.blake2b((t or "").encode(), digest_size=8).digest())
    digest = lambda x: int.from_bytes(x[1], "little", signed=True)
    texts = {}
    for d, t in rows:
        key = order(d, t)
        texts[key[0], digest(key)] = (d, re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    first = {}
    for key in sorted(texts):
        words = texts[key][1]
        for k in range(len(words) - 19):
            first.setdefault(tuple(words[k : k + 20]), (key, k))
    found = []
    for d, t in rows:
        key = order(d, t)
        key = (key[0], digest(key))
        words = texts[key][1]
        gone = set()
        for k in range(len(words) - 19):
            if first[tuple(words[k : k + 20])] != (key, k):
                gone.update(range(k, k + 20))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        found.append((d, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(map(repr, found))


def drawn(seed=1, n=120):
    rng = random.Random(seed)
    few, many = ["a", "b"], [f"w{k}" for k in range(3000)] + ["é" * 9, "中文", "x" * 70]
    passages = [[rng.choice(many) for _ in range(rng.randrange(15, 60))] for _ in range(6)]
    rows = []
    for k in range(n):
        words = []
        for _ in range(rng.randrange(5)):
            words += rng.choice([lambda: [rng.choice(many) for _ in range(rng.randrange(60))], lambda: rng.choice(passages), lambda: [rng.choice(few) for _ in range(30)]])()
        rows.append((rng.randrange(10**6), rng.choice([" ", "\n", "  \t"]).join(words)))
    footer = " ".join(passages[0])
    return rows + [(k, f"own{k} " * 3 + footer + f" end{k}" * 4) for k in range(40)] + [
        (1, None), (2, ""), (3, " \n"), (None, rows[0][1]), (None, footer), (5, footer + " x"), (5, "y " + footer), rows[3], rows[3], (9, "same " * 500), (10, "z" * 300_000 + " z" * 30),
    ]


@pytest.mark.parametrize(("block_bytes", "crowded"), [(windows.BLOCK_BYTES, windows.CROWDED), (2000, 10), (1, 0)])
def test_windows_against_brute_force(spark, block_bytes, crowded):
    rows = drawn()
    docs = spark.createDataFrame([(d, t, 1, b"x") for d, t in rows], "doc_id long, text string, block int, raw binary").repartition(4)
    found = windows.repeated(docs, block_bytes=block_bytes, bucket_bytes=3000, crowded=crowded)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute(rows)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("windows_")]


def test_empty_table(spark):
    assert windows.repeated(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_super_kmers_cover_every_window_once():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") if k % 3 else f"w{rng.randrange(900)}" for _ in range(rng.randrange(200))).encode() for k in range(30)]
    words = windows.Words(texts)
    first, count, key, _ = words.super_kmers()
    covered = np.concatenate([np.arange(a, a + n) for a, n in zip(first, count, strict=True)])
    wanted = [a + k for a, n in zip(words.edges[:-1], words.counts, strict=True) for k in range(n - windows.SIZE + 1)]
    assert covered.tolist() == wanted and count.max() <= windows.WINDOWS
    for string, n in zip(words.strings(first, count), count, strict=True):
        assert len(string.split(b" ")) == n + windows.SIZE - 1
    # Equal windows have equal minimisers.
    seen = {}
    all_words = words.text.split()
    for a, n, m in zip(first.tolist(), count.tolist(), key.tolist(), strict=True):
        for k in range(a, a + n):
            assert seen.setdefault(tuple(all_words[k : k + windows.SIZE]), m) == m


def test_equal_hashes_of_different_windows(monkeypatch):
    monkeypatch.setattr(windows, "_BASE", 0)  # only a window's last word counts in its hash
    ids = np.array([*range(19), 7, *range(1, 20), 7, *range(19), 7], np.int32)
    kinds = windows.sorted_classes(ids, np.array([0, 20, 40]))
    assert kinds[0] == kinds[2] != kinds[1]


def test_word_hashes_of_long_words():
    text = b"a " + b"b" * (1 << 19) + b" a " + b"b" * (1 << 19) + b" a"
    words = windows.Words([text, text])
    h = words.hashes.reshape(2, 5)
    assert (h[0] == h[1]).all() and len(set(h[0].tolist())) == 2
