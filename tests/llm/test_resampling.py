"""Importance resampling against a brute-force version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from placewright.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_features(text):
    words = WORD.findall((text or "").translate(FOLD))
    return words, [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]


def brute(rows, target):
    s, t = (Counter(b for text in texts for b in brute_features(text)[1]) for texts in ([r[1] for r in rows], target))
    size_s, size_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (size_s + 10000) / ((s[b] + 1) * (size_t + 10000))))
    found = []
    for d, text in rows:
        words, buckets = brute_features(text)
        weight = sum(map(gain, buckets)) // len(buckets) if buckets else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        found.append([d, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    enough = sorted((f for f in found if f[5] >= 20), key=lambda f: (-f[3], f[0] is None, f[0]))
    for k, f in enumerate(enough[: 25 * len(enough) // 100]):
        f[4] = k + 1
    return sorted(map(repr, (tuple(f[:5]) for f in found)))


def drawn_rows(n=160):
    rng = random.Random(4)
    pool = [" ".join(rng.choice(["the", "Of", "naïve", "中文", "a1", "x" * 50, "É", "data-set", "q", "z" * 33]) for _ in range(rng.randrange(1, 14))) for _ in range(30)]
    rows = [(k, rng.choice(["\n", "\n\n", " \n \r", "\r\n"]).join(rng.choice(pool) for _ in range(rng.randrange(0, 9)))) for k in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "\n\n"), (None, pool[0] + "\n" + pool[1] * 4), (3, rows[3][1]), (n + 3, "...,;"), (n + 4, "word " * 70_000), (n + 5, "long" * 300_000)]


def test_resampling_against_brute_force(spark):
    rows, target = drawn_rows(), ["The data-set of naïve\nq q", None, "中文 a1 the"]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, line string, bucket int").repartition(5)
    wanted = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    found = resampling.resample(docs, wanted).collect()
    assert sorted(repr(tuple(r)) for r in found) == brute(rows, target)
    assert sum(r["rank"] is not None for r in found) > 10


def test_features_cross_lines_once():
    texts = ["One two\n\nthree four\nfive", "six", "\nseven\n eight"]
    words, owner, bucket, crosses = resampling.features([t.encode() for t in texts])
    assert words.tolist() == [5, 1, 2]
    assert Counter(zip(owner.tolist(), bucket.tolist(), strict=True)) == Counter((k, b) for k, t in enumerate(texts) for b in brute_features(t)[1])
    seams = resampling.features([t.encode() for t in texts], seams_only=True)
    assert sorted(seams[2]) == sorted(zlib.crc32(f) % 10000 for f in (b"two three", b"four five", b"seven eight"))
    assert int(crosses.sum()) == 3


def test_empty_tables_and_targets(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 15), (2, None)], "doc_id long, text string")
    assert resampling.resample(none, some).collect() == []
    found = resampling.resample(some, none)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute([(1, "a b " * 15), (2, None)], [])


def test_ties_go_to_the_smaller_id(spark, monkeypatch):
    monkeypatch.setattr(resampling, "noise", lambda id, seed: 0)
    docs = spark.createDataFrame([(k, "same words " * 12) for k in range(12, 0, -1)], "doc_id long, text string").coalesce(1)
    rank = {r["doc_id"]: r["rank"] for r in resampling.resample(docs, docs).collect()}
    assert rank == {k: k if k <= 3 else None for k in range(1, 13)}


def test_gains_of_large_counts():
    source = np.full(resampling.BUCKETS, 2**52, np.int64)
    assert set(resampling.gains(source, source).tolist()) <= {-1, 0}
