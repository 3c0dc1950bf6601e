"""SimHash, repeated passages, tiling, components, dialogues."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from placewright.llm import passages, perspectives, simhash, tiling
from placewright.llm.components import components


def brute_roots(edges):
    root = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 160)] + [(0, k) for k in range(1, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    edges = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in edges]
    want = brute_roots([e for e in edges if e[0] != e[1]])
    assert dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect())) == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64(" ".join(words[k : k + 3]).encode(), 42).intdigest() for k in range(max(1, len(words) - 2))]
    return sum((2 * sum(v >> k & 1 for v in h) > len(h)) << k for k in range(64))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB cÉ \n\x0b"), max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_print(text)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 1023), min_size=2, max_size=150), st.integers(1, 4))
def test_connected_inside_a_posting(values, bits):
    values = np.array(sorted(values), np.uint64)
    edges = [(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if int(values[a] ^ values[b]).bit_count() <= bits]
    want = brute_roots(edges)
    assert simhash._near(values, bits).tolist() == [want.get(k, k) for k in range(len(values))]


@pytest.mark.parametrize("bits", [2, 3])
def test_links_connect_all_within_the_bound(spark, bits):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(240):
        prints.append(rng.choice(prints) ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(0, 5))}))
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    edges = [(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= bits]
    frame = spark.createDataFrame([(p,) for p in signed + signed[:9]], "fp long")
    assert dict(map(tuple, components(simhash.links(frame, bits)).collect())) == brute_roots(edges)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(5, "a b c d"), (2, "A b\tC d"), (9, None), (8, ""), (7, "x"), (7, "x"), (None, "x"), (None, "alone here"), (1, "long " * 40_000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, fp int")
    found = sorted(((r["doc_id"] is None, r["doc_id"], r["component_id"], r["fingerprint"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert len(found) == len(rows)
    by = {}
    for missing, d, c, f in found:
        by.setdefault(d, []).append(c)
        assert len(f) == 16
    assert by[5] == by[2] == [2] and by[9] == by[8] == [8] and by[7] == [7, 7] and sorted(by[None], key=str) == [7, None]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def brute_passages(rows, size):
    first, raw = {}, [((t or "").encode(), d) for d, t in rows]
    rank = lambda d: (d is None, d)
    for b, d in raw:
        for p in range(len(b) - size + 1):
            s = b[p : p + size]
            first[s] = min(first.get(s, rank(d)), rank(d))
    out = []
    for b, d in raw:
        gone = [False] * len(b)
        for p in range(len(b) - size + 1):
            if first[b[p : p + size]] < rank(d):
                gone[p : p + size] = [True] * size
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("spread", [20_000, 3])
def test_passages(spark, monkeypatch, spread):
    monkeypatch.setattr(passages, "SPREAD", spread)
    monkeypatch.setattr(passages, "COLLECTION", 40)
    rng = random.Random(6)
    text = lambda n, a="abc é": "".join(rng.choice(a) for _ in range(n))
    shared = [text(n) for n in (50, 51, 80, 200, 49)]
    rows = [(k, text(rng.randrange(0, 120)) + rng.choice(shared) + text(rng.randrange(0, 60)) + rng.choice(shared)) for k in range(60)]
    rows += [(70, None), (71, ""), (72, "aaaa" * 60), (73, "aaaa" * 90), (74, rows[3][1]), (74, rows[3][1]), (None, rows[5][1]), (None, shared[3]), (1, shared[2] + "x"), (75, text(3000, "ab")), (76, text(3000, "ab")), (80, "x" * 49)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block int").repartition(5)
    found = passages.find(docs, block_bytes=1500, with_row=True).collect()
    got = sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found], key=str)
    assert got == brute_passages(rows, passages.LENGTH)
    assert all(r["row"]["block"] == 1 and len(r["left"].encode()) <= r["n_bytes"] - r["n_removed"] for r in found)
    assert passages.find(docs.limit(0)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=9), min_size=1, max_size=6), st.integers(1, 4))
def test_suffix_order_of_a_collection(texts, least):
    lengths = np.array([len(t) for t in texts])
    matrix = np.zeros((len(texts), max(1, lengths.max())), np.uint8)
    for row, t in zip(matrix, texts, strict=True):
        row[len(row) - len(t) :] = list(t.encode())
    who, start = passages.suffix_order(matrix, lengths, least)
    want = sorted((t[k:], n, k) for n, t in enumerate(texts) for k in range(len(t) - least + 1))
    assert [(texts[n][k:], n, k) for n, k in zip(who.tolist(), start.tolist(), strict=True)] == want
    owners = np.array([10 - n for n in range(len(texts))])
    low = passages.first_owner(matrix, lengths, owners, least)
    for n, t in enumerate(texts):
        for k in range(len(t) - least + 1):
            assert low[n, k] == min(owners[m] for m, u in enumerate(texts) if t[k : k + least] in u)


def brute_tiles(item, text, least):
    mi, mt, out = [0] * len(item), [0] * len(text), []
    while True:
        best = (0,)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not mi[i + n] and not mt[j + n]:
                    n += 1
                best = (n, i, j) if n > best[0] else best
        if best[0] < least:
            return sorted(out)
        out.append(best)
        for q in range(best[0]):
            mi[best[1] + q] = mt[best[2] + q] = 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=22), st.lists(st.integers(1, 4), max_size=28), st.integers(1, 3))
def test_greedy_tiles(item, text, least):
    assert sorted(tiling.tile(np.array(item, np.uint64), np.array(text, np.uint64), least)) == brute_tiles(item, text, least)


def test_contamination(spark):
    rng = random.Random(8)
    word = lambda: "w%d" % rng.randrange(3000)
    items = [(k, " ".join(word() for _ in range(30))) for k in range(12)] + [(50, "Short item"), (51, None), (52, ""), (None, "no id at all here now"), (53, " ".join(["again"] * 20))]
    parts = items[3][1].split()
    fill = lambda n: " ".join(word() for _ in range(n))
    docs = [
        (1, fill(50) + " " + items[0][1].upper() + "! " + fill(20)),
        (2, " ".join(parts[20:]) + " " + fill(9) + " " + " ".join(parts[10:20]) + " " + fill(3) + " " + " ".join(parts[:10])),
        (3, " ".join(parts[:14]) + " " + fill(30)),
        (4, fill(400)),
        (5, None),
        (6, ""),
        (7, "a short, item there"),
        (8, " ".join(" ".join([*parts[k : k + 4], word()]) for k in range(0, 30, 4))),
        (9, items[1][1] + " " + items[2][1]),
        (9, items[1][1] + " " + items[2][1]),
        (None, items[4][1] + " " + fill(30_000)),
        (10, "no id at all here now"),
    ]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    found = tiling.contamination(frame, bench).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == len(docs)
    assert {d for d, r in by.items() if r["contaminated"]} == {1, 2, 7, 9, None}
    assert by[2]["coverage"] == 1.0 and by[2]["item_id"] == 3 and by[9]["n_items"] == 2 and by[9]["item_id"] == 1
    assert by[8]["coverage"] == 0.0 and by[4]["item_id"] is None
    assert not any(r["contaminated"] for r in tiling.contamination(frame, bench.limit(0)).collect())
    assert tiling.contamination(frame.limit(0), bench).collect() == []


def test_dialogues_match_their_sql(spark):
    rows = [(1, 0, "system", "Be <|im_end|> kind"), (1, 1, "ann", "hé"), (1, 2, "Bob B", None), (1, 3, "ann", ""), (1, 3, "ann", ""), (1, None, None, "first"), (2, 0, "system", "only"), (None, 1, "x", "a"), (None, 0, " ", "b")]
    rows += [(9, k, f"p{k % 3}", f"turn {k}") for k in range(150)]
    rows += [(5, k, role, f"said {k}") for k, role in enumerate(["Анна", "Олег", "a b", "a_b", None, "unknown", "", "Анна", " system "])]
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, perspective string")
    frame = perspectives.rotate(turns)
    names = frame.columns
    got = sorted((tuple(r[n] for n in names) for r in frame.collect()), key=str)
    db = duckdb.connect()
    conversations = turns.toArrow()  # noqa: F841
    db.register("conversations", conversations)
    cursor = db.execute(perspectives.SQL)
    at = [[d[0] for d in cursor.description].index(n) for n in names]
    assert got == sorted((tuple(r[k] for k in at) for r in cursor.fetchall()), key=str)
    for r in frame.collect():
        for span in filter(None, r["spans"].split(",")):
            start, size = map(int, span.split(":"))
            assert r["text"][start : start + size].endswith(perspectives.END) and r["text"][:start].endswith("assistant\n")
    # Names that print alike are still speakers of their own.
    five = {r["perspective"]: r for r in frame.where("conv_id = 5").collect()}
    assert set(five) == {"____", "____#2", "a_b", "a_b#2", "unknown", "unknown#2", "unknown#3"}
    assert {p: r["n_trained"] for p, r in five.items() if r["n_trained"] != 1} == {"____": 2}
    assert all(r["text"].count("assistant\n") == r["n_trained"] and r["text"].count("|>system\n") == 1 for r in five.values())
    assert perspectives.rotate(turns.limit(0)).collect() == []
