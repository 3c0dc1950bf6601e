"""Token ids: encoder, plane files, packing."""

import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from placewright.llm import packing, planes
from placewright.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " a", "a ", "a  b", "a\n\nb", "\n", "a\tb  c", "don't I'm it's.", "<|endoftext|> x", "é b", "x\u0085y", "a\0b c", "\0", "1 2\n3", "a \nb", "a\n b", "!", "Ok, fine,\nfine, Ok", "1 \0_", "x<|endoftext|>", "x<|endoftext|>y z"]


@pytest.fixture(scope="module")
def plain():
    found = Tokenizer.from_file(PATH)
    return lambda t: found.encode(t or "", add_special_tokens=False).ids + [0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab ,.\n\t'sé 1\0"), max_size=30), max_size=6))
def test_encoder_equals_the_library(plain, texts):
    assert [x.tolist() for x in Encoder(PATH).encode(texts)] == [plain(t) for t in texts]


def test_encoder_equals_the_library_on_drawn_strings(plain):
    rng, encoder = random.Random(5), Encoder(PATH)
    letters = ["a", "b", "é", "1", "_", "'s", "\0", " \0_", " ", "  ", "\n", "\n\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "\u2028", "\u200b", "<|endoftext|>", "<|", "|>", ".", "!", "中", "😀"]
    for _ in range(20):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(12))) for _ in range(300)]
        assert [x.tolist() for x in encoder.encode(texts)] == [plain(t) for t in texts]


def test_planes_round_trip():
    ids = np.random.default_rng(0).integers(0, 1 << 32, 70_001, dtype=np.uint64).astype(np.uint32)
    for kind in planes.KINDS:
        assert (planes.from_planes(planes.to_planes(ids, kind), len(ids), kind) == ids).all()
        f = planes.PlaneFile(planes.pack_file([(5, ids[:100]), (None, ids[100:])], kind, 3, 4))
        assert (f.task, f.number, f.documents, f.lengths.tolist()) == (3, 4, [5, None], [100, 69_901])
        assert (f.read(65_000, 66_000) == ids[65_000:66_000]).all() and len(f.read(7, 7)) == 0


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_files_hold_every_document_in_order(spark, tmp_path, plain, kind):
    rows = [(k, ODD[k % len(ODD)], "x") for k in range(60, 0, -1)] + [(7, ODD[7], "x"), (None, "null id", "y"), (2**40, "far " * 3000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    folder = planes.write(docs, str(tmp_path / "p"), PATH, kind=kind, file_ids=50)
    found = sorted(planes.read(spark, folder, with_ids=True).collect(), key=lambda r: r["start"])
    keys = [r["doc_id"] for r in found]
    assert keys[0] is None and keys[1:] == sorted([r[0] for r in rows if r[0] is not None])
    at, texts = 0, dict((r[0], r[1]) for r in rows)
    for r in found:
        want = plain(texts[r["doc_id"]])
        assert (r["start"], r["n_tokens"], r["ids"]) == (at, len(want), want)
        assert r["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert planes.read(spark, planes.write(docs, str(tmp_path / "p"), PATH)).collect() == []
    assert packing.pack(docs, PATH).collect() == []


def fewest(items, capacity):
    best = [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] + items[k] <= capacity:
                bins[i] += items[k]
                go(k + 1, bins)
                bins[i] -= items[k]
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8))
def test_plan_needs_no_more_sequences_than_brute_force(items):
    patterns, bound = packing.plan(np.bincount(items or [0], minlength=21), 20)
    used = Counter()
    for lengths, times in patterns:
        assert sum(lengths) <= 20
        used.update({n: c * times for n, c in Counter(lengths).items()})
    assert used == Counter(items)
    best = fewest(sorted(items, reverse=True), 20)
    assert bound <= best == sum(t for _, t in patterns)


def test_packing_places_every_token_once(spark, plain):
    rows = [(k, "word " * (k * 37 % 300), "x") for k in range(80)] + [(3, "word " * 111, "x"), (None, None, "x"), (500, "ab cd " * 4000, "x"), (501, ODD[8], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)
    found = packing.pack(docs, PATH, capacity=64, with_ids=True)
    pieces = found.toPandas()
    assert len(pieces[pieces.doc_id == 3]) == len(plain(rows[3][1])) // 64 + 1 + len(plain("word " * 111)) // 64 + 1
    for d, text, _ in rows:
        own = pieces[pieces.doc_id == d].sort_values("piece")
        if d not in (3, None):
            assert [i for part in own.ids for i in part] == plain(text)
            assert (own.length.iloc[1:] == 64).all() and own.start.tolist() == (own.length.cumsum() - own.length).tolist()
    for _, group in pieces.sort_values("offset").groupby("sequence_id"):
        assert group.offset.tolist() == (group.length.cumsum() - group.length).tolist() and group.length.sum() <= 64
    assert len(pieces[pieces.doc_id.isna()]) == 1
    whole = packing.sequences(found).toPandas()
    assert sum(map(len, whole.ids)) == pieces.length.sum()


def brute_fillings(counts, room):
    """Maximal multisets that no exchange of some pieces for one piece at hand improves."""
    kinds = [n for n in range(1, len(counts)) if counts[n]]
    found = []

    def grow(k, chosen, left):
        if k < 0:
            found.append(tuple(sorted(chosen, reverse=True)))
            return
        for times in range(min(counts[kinds[k]], left // kinds[k]) + 1):
            grow(k - 1, chosen + [kinds[k]] * times, left - times * kinds[k])

    grow(len(kinds) - 1, [], room)

    def dominated(f):
        waste = room - sum(f)
        for size in range(len(f) + 1):
            for part in combinations(range(len(f)), size):
                s = sum(f[k] for k in part)
                for y in range(max(s, 1), s + waste + 1):
                    at_hand = y < len(counts) and counts[y] - f.count(y) > 0
                    if at_hand and not (size == 1 and y == s):
                        return True
        return False

    return {f for f in found if not dominated(f)}


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 14), max_size=9), st.integers(1, 14))
def test_fillings_are_the_undominated_ones_in_order_of_waste(items, room):
    counts = np.bincount(items or [0], minlength=15)
    counts[0] = 0
    found = list(packing.fillings(counts, room))
    assert len(found) == len(set(found)) and [sum(f) for f in found] == sorted((sum(f) for f in found), reverse=True)
    assert set(found) == brute_fillings(counts.tolist(), room)


def test_packing_is_never_worse_than_best_fit():
    rng = np.random.default_rng(1)
    mixes = {
        "large": rng.integers(512, 1024, 600), "humps": np.where(rng.random(600) < 0.5, rng.integers(300, 421, 600), rng.integers(500, 641, 600)),
        "five": rng.choice([377, 451, 523, 614, 701], 600), "middle": rng.integers(410, 741, 600), "any": rng.integers(1, 2049, 2000),
    }
    gained = 0
    for name, lengths in mixes.items():
        counts = np.bincount(lengths, minlength=2049)
        patterns, bound = packing.plan(counts, nodes=1500, steps=200_000)
        packed = np.bincount([n for p, times in patterns for n in p for _ in range(times)], minlength=2049)
        assert (packed == counts).all() and all(sum(p) <= 2048 for p, _ in patterns), name
        best_fit = sum(t for _, t in packing.best_fit(np.append(counts[:2048], 0), 2048)) + counts[2048]
        used = sum(t for _, t in patterns)
        assert bound <= used <= best_fit, name
        gained += best_fit - used
    assert gained > 5
