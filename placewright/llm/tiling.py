"""Benchmark contamination by greedy string tiling.

Documents and benchmark items are sequences of lower-cased words. A document is searched for an
item's passages by greedy tiling: the longest common run of words that no earlier tile covers is
marked in both texts, again and again, down to LEAST words (a shorter item's own length). The share
of an item's words under tiles says how much of it the document gives away, whatever the order of
its passages. Longest runs are found by running Karp-Rabin: rolling hashes of the unmarked windows
of one search length, which falls from scan to scan.

Only documents that share a LEAST-word seed with an item are tiled. Seeds are looked up in a bit
filter of bounded size first; the words around the hits are all that travels, then an exact join
finds the items.
"""

import heapq
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns, enter, settle

LEAST = 5
COVERAGE = 0.5
FILTER_BITS = (20, 27)  # the filter has 2^20 to 2^27 bits (16 MB), whatever the benchmark's size
_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CUT = 0  # stands between stretches of a document's words; no word has it
_WORDS_KEPT = 500_000


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) >= _WORDS_KEPT:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) or 1
        return value


_hashes = _Hashes()


def words(text):
    found = _WORD.findall((text or "").lower())
    return np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))


def windows(values, size):
    """A hash of every window of `size` words."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(size))
    for k in range(size):
        h = h * _BASE + values[k : k + n]
    return h ^ (h >> np.uint64(31))


def tile(item, document, least):
    """Greedy tiles (length, item start, document start) of two word arrays."""
    marked_i, marked_d = np.zeros(len(item), bool), document == _CUT
    tiles, size = [], max(least, min(20, len(item)))
    while True:
        found, longest = _scan(item, document, marked_i, marked_d, size)
        if longest > 2 * size:
            size = longest
            continue
        # Longest first, ties by place. A match that a tile cut short goes back with what is left of it.
        heap = [(-n, i, d) for n, i, d in found]
        heapq.heapify(heap)
        while heap:
            n, i, d = heapq.heappop(heap)
            taken = marked_i[i : i - n] | marked_d[d : d - n]
            if not taken.any():
                marked_i[i : i - n] = marked_d[d : d - n] = True
                tiles.append((-n, i, d))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[1], taken, [1]])))
            for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if stop - start >= size:
                    heapq.heappush(heap, (start - stop, i + start, d + start))
        if size > 2 * least:
            size //= 2
        elif size > least:
            size = least
        else:
            return tiles


def _scan(item, document, marked_i, marked_d, size):
    """Maximal unmarked matches of at least `size` words, and the longest one's length."""

    def free(marked):
        run = np.concatenate([[0], np.cumsum(marked)])
        return run[size:] == run[:-size] if len(marked) >= size else np.zeros(0, bool)

    at_i, at_d = np.flatnonzero(free(marked_i)), np.flatnonzero(free(marked_d))
    if not len(at_i) or not len(at_d):
        return [], 0
    table = {}
    for at, h in zip(at_i.tolist(), windows(item, size)[at_i].tolist(), strict=True):
        table.setdefault(h, []).append(at)
    hashes = windows(document, size)[at_d]
    hit = np.isin(hashes, np.fromiter(table, np.uint64, len(table)))
    found, longest = [], 0
    for d, h in zip(at_d[hit].tolist(), hashes[hit].tolist(), strict=True):
        for i in table[h]:
            # Only at a match's left end, so that each maximal match is told once.
            if i and d and not marked_i[i - 1] and not marked_d[d - 1] and item[i - 1] == document[d - 1]:
                continue
            m = min(len(item) - i, len(document) - d)
            bad = (item[i : i + m] != document[d : d + m]) | marked_i[i : i + m] | marked_d[d : d + m]
            n = int(bad.argmax()) if bad.any() else m
            if n >= size:
                found.append((n, i, d))
                longest = max(longest, n)
    return found, longest


def _slots(seeds, bits):
    """Two filter positions per seed."""
    mixed = seeds * np.uint64(0xC2B2AE3D27D4EB4F)
    return seeds >> np.uint64(64 - bits), mixed >> np.uint64(64 - bits)


def _seeds(items, least):
    """item_id, words (bytes), size, seed, times: a row per item and different seed."""

    def cut(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                w = words(text)
                size = min(least, len(w))
                if size:
                    kinds, times = np.unique(windows(w, size), return_counts=True)
                    out += [(item, w.tobytes(), size, s, t) for s, t in zip(kinds.view(np.int64).tolist(), times.tolist(), strict=True)]
            types = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64()]
            found = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.record_batch([pa.array(v, t) for v, t in zip(found, types, strict=True)], names=["item_id", "words", "size", "seed", "times"])

    return items.mapInArrow(cut, "item_id long, words binary, size int, seed long, times long")


def contamination(docs, benchmark, id="doc_id", text="text", item="item_id", item_text="text", least=LEAST, coverage=COVERAGE, with_row=False):
    """doc_id, contaminated, coverage (the largest of any item), item_id (that item; the smallest of
    equals), n_items (items at or above the limit), for every row.

    A null or empty text or item matches nothing; rows of equal ids are judged one by one; without
    items nothing is contaminated. Items need ids: rows of a null id are left out. Extra columns
    are ignored; with_row adds the text as `text` and the row's other columns as struct `row`.
    """
    items = columns(benchmark, item_id=item, text=item_text).where("item_id is not null").select(F.col("item_id").cast("long"), "text")
    seeds = settle(_seeds(items, least), "seeds")
    total = seeds.select("seed").distinct().count()
    sizes = sorted(r[0] for r in seeds.select("size").distinct().collect())  # at most `least` numbers
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], math.ceil(math.log2(max(1, 32 * total)))))
    spark = docs.sparkSession

    def slots(batches):
        for batch in batches:
            found = np.concatenate(_slots(batch[0].to_numpy().view(np.uint64), bits)).astype(np.int64)
            yield pa.record_batch([pa.array(found)], names=["slot"])

    # At most 2^27 / 64 rows of 64 bits come to the driver.
    parts = seeds.select("seed").mapInArrow(slots, "slot long").groupBy(F.shiftright("slot", 6).alias("part"))
    parts = parts.agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[parts["part"].to_numpy()] = parts["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(table.view(np.uint8))

    whole = [F.struct(*[docs[c] for c in docs.columns if c != text]).alias("whole")] if with_row else []
    rows = docs.select(docs[id].alias("doc_id"), docs[text].alias("text"), *whole)
    carried = ["text", "whole"] if with_row else []

    def search(batches):
        enter("tiling", _hashes.clear)
        task, number, filter_ = TaskContext.get().partitionId() << 33, 0, shared.value
        known = lambda s: filter_[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8) & np.uint8(1)
        for batch in batches:
            stretches, hits = [], []
            for text in batch[1]:
                w = words(text.as_py())
                covered, own = np.zeros(len(w) + 1, np.int32), []
                for size in sizes:
                    h = windows(w, size)
                    one, two = _slots(h, bits)
                    at = np.flatnonzero(known(one) & known(two))
                    np.add.at(covered, at, 1)
                    np.add.at(covered, at + size, -1)
                    own.append(h[at])
                own = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
                hits.append(own.view(np.int64) if len(own) else None)
                if len(own):
                    # The words that hits cover, a cut wherever words were left out.
                    on = np.cumsum(covered)[:-1] > 0
                    kept = np.where(on, w, np.uint64(_CUT))
                    kept = kept[on | np.append(True, on[:-1])]
                    stretches.append(kept.tobytes())
                else:
                    stretches.append(None)
            n = batch.num_rows
            names = pa.array(np.arange(task + number, task + number + n))
            number += n
            made = [names, batch[0], pa.array(stretches, pa.binary()), pa.array(hits, pa.list_(pa.int64()))]
            yield pa.record_batch([*made, *batch.columns[1 : 1 + len(carried)]], names=["row", "doc_id", "stretches", "hits", *carried])

    kind = T.StructType().add("row", "long").add("doc_id", rows.schema["doc_id"].dataType).add("stretches", "binary").add("hits", T.ArrayType(T.LongType()))
    if with_row:
        kind = kind.add("text", "string").add("whole", rows.schema["whole"].dataType)
    found = settle(rows.mapInArrow(search, kind), "hits")
    sought = found.where("hits is not null")
    # Tiles of c words hold at least c / size of the item's seeds, so fewer can't reach the limit.
    met = sought.select("row", F.explode("hits").alias("seed")).join(seeds.select("item_id", "size", "seed", "times"), "seed")
    met = met.groupBy("row", "item_id").agg(F.sum("times").alias("met"), F.first("size").alias("size"))
    texts = seeds.groupBy("item_id").agg(F.first("words").alias("words"))
    pairs = met.join(texts, "item_id").where(F.col("met") * F.col("size") >= coverage * F.length("words") / 8)
    pairs = pairs.join(sought.select("row", "stretches"), "row").select("row", "item_id", "size", "words", "stretches")

    def judge(batches):
        for batch in batches:
            share = []
            for size, item, stretches in zip(*(batch[k].to_pylist() for k in (2, 3, 4)), strict=True):
                item = np.frombuffer(item, np.uint64)
                share.append(sum(n for n, _, _ in tile(item, np.frombuffer(stretches, np.uint64), size)) / len(item))
            yield pa.record_batch([batch[0], batch[1], pa.array(share, pa.float64())], names=["row", "item_id", "share"])

    judged = pairs.mapInArrow(judge, "row long, item_id long, share double")
    best = judged.groupBy("row").agg(
        F.max(F.struct("share", (-F.col("item_id")).alias("item"))).alias("best"),
        F.sum((F.col("share") >= coverage).cast("long")).alias("n_items"),
    )
    share = F.coalesce("best.share", F.lit(0.0))
    return found.select("row", "doc_id", *carried).join(best, "row", "left").select(
        "doc_id",
        (share >= coverage).alias("contaminated"),
        share.alias("coverage"),
        F.when(share > 0, -F.col("best.item")).alias("item_id"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        *([F.col("text"), F.col("whole").alias("row")] if with_row else []),
    )
