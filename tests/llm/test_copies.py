"""The pipeline's near-duplicate stage against brute-force similarity of 5-word shingles."""

import random

import numpy as np
import pytest
from test_pairs import brute_roots

import corpus_pipeline
from placewright.llm import copies


def brute_set(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def texts(rng):
    bases = [" ".join(f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 12, 60, 200]))) for _ in range(40)]
    found = list(bases)
    for base in bases:
        found += [edited(rng, base, rng.randrange(0, 12)) for _ in range(4)]
    return found + [edited(rng, bases[-1] + " tail" * 5, k % 9) for k in range(60)]


def test_near_copies_against_brute_force(spark):
    rows = list(enumerate(texts(random.Random(11))))
    random.Random(3).shuffle(rows)
    sets = {d: brute_set(t) for d, t in rows}
    roots = brute_roots([(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = corpus_pipeline.drop_near_duplicates(spark, docs, None)
    assert sorted(r["doc_id"] for r in found.collect()) == sorted({roots.get(d, d) for d in sets})
    assert 0 < len({roots.get(d, d) for d in sets}) < len(rows)


def test_rows_of_clashing_and_missing_ids(spark):
    rng = random.Random(2)
    one, two, three = (" ".join(f"{name}{k}" for k in range(80)) for name in "xyz")
    rows = [(1, one), (1, two), (2, edited(rng, one, 1)), (None, two), (None, three), (None, edited(rng, three, 1)), (7, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, None).collect()]
    assert len(found) == 4 and {(1, one), (1, two), (5, "")} < set(found)


@pytest.mark.parametrize("seed", [1, 2])
def test_sets_are_linked_as_by_all_pairs(seed):
    rng = random.Random(seed)
    sets = []
    for _ in range(20):
        base = {rng.randrange(3000) for _ in range(rng.randrange(1, 60))}
        sets += [({x for x in base if rng.random() > 0.1} | {rng.randrange(3000) for _ in range(rng.randrange(4))}) or {1} for _ in range(6)]
    want = brute_roots([(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if similar(sets[a], sets[b])])
    found = copies.by_sets([np.array(sorted(s), np.uint64) for s in sets])
    assert found.tolist() == [want.get(k, k) for k in range(len(sets))]


def test_leaks_go_by_row(spark, tmp_path):
    item = "how many apples does the farmer sell at the market every morning before noon today"
    clean = "a text of its own that gives nothing away at all to anybody who reads it now"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, "so " + item), (None, clean), (3, item + " so"), (3, clean)], "doc_id long, text string")
    found = corpus_pipeline.drop_leaks(spark, docs, str(tmp_path))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in found.collect()) == [(0, clean), (3, clean)]


def test_texts_whose_simhashes_are_near_are_linked(spark):
    rng = random.Random(8)
    prints = [rng.getrandbits(63) for _ in range(12)]
    prints += [p ^ 1 << rng.randrange(60) ^ 1 << rng.randrange(60) for p in prints[:6]] + prints[:3]
    rows = list(enumerate(prints))
    want = brute_roots([(a, b) for a, p in rows for b, q in rows if a < b and (p ^ q).bit_count() <= 2])
    found = brute_roots([(r["a"], r["b"]) for r in copies.by_bits(spark.createDataFrame(rows, "node long, fp long")).collect()])
    assert [found.get(k, k) for k in range(len(rows))] == [want.get(k, k) for k in range(len(rows))] and len(want) >= 9


def test_the_stage_reads_simhashes(spark):
    base = " ".join(f"w{k}" for k in range(900))
    docs = spark.createDataFrame([(1, base), (2, base + " end"), (3, "another text with words of its own")], "doc_id long, text string")
    prints = [copies.simhash.fingerprint(t, copies.SHINGLE) for t in (base, base + " end")]
    assert (prints[0] ^ prints[1]).bit_count() <= 2
    assert sorted(r["doc_id"] for r in copies.unlike(docs).collect()) == [1, 3]
