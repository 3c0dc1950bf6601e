"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

A fingerprint is eight positional bytes. Two fingerprints that differ in at most d bits differ in
at most d bytes, and so share at least m = 8 - d positional bytes: that is the guaranteed minimum
of the count filter. Tallying single bytes pair by pair would put 1/256 of all fingerprints into
every posting list and emit their pairs, so the index is keyed by every choice of m positional
bytes: exactly the pairs with m or more shared bytes meet, in the posting of the bytes they share.

One posting varies in d bytes only. For d = 2 it holds at most 65,536 different fingerprints,
whatever the corpus, so it is one bounded group: its links are verified bit by bit there, and only
links to the smallest member of each connected set leave it, never all pairs.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from .common import columns, enter, settle
from .components import components

SHINGLE = 3
BITS = 2
SEED = 42


def hashes(text, shingle=SHINGLE):
    """The hash of every shingle of a text, repeats included; none for no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(p, SEED) for p in parts), dtype=np.uint64, count=max(1, len(words) - shingle + 1))


def print_of(hashes):
    """64-bit fingerprint of shingles' hashes; 0 for none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        block = hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text, shingle=SHINGLE):
    """64-bit fingerprint of a text; 0 for none or no words."""
    return print_of(hashes(text, shingle))


def fingerprints(docs, id="doc_id", text="text", shingle=SHINGLE):
    """doc_id, fp (the fingerprint as a signed long) of every row; extra columns are ignored."""
    rows = columns(docs, doc_id=id, text=text)

    def hashed(batches):
        enter("simhash")
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch[1]], dtype=np.uint64)
            yield pa.record_batch([batch[0], pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(hashed, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _near(values, bits):
    """For sorted different values of one posting: the smallest member of each one's connected set.

    Links are found by flipping bits: two values within `bits` meet at a value that each reaches by
    flipping half of them. For an odd bound the one-more-flip side is verified against the bound.
    """
    parent = np.arange(len(values))

    def top(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    vary = np.bitwise_or.reduce(values ^ values[0])
    masks = [np.uint64(1) << np.uint64(k) for k in range(64) if int(vary) >> k & 1]
    at_most = lambda n: [np.bitwise_xor.reduce(np.array(c, np.uint64)) if c else np.uint64(0) for r in range(n + 1) for c in combinations(masks, r)]
    if len(values) <= 64:
        apart = values[:, None] ^ values[None, :]
        close = np.bitwise_count(apart) <= bits
        a, b = np.nonzero(np.triu(close, 1))
    else:
        flips = at_most(bits // 2)
        if bits % 2:
            # Odd: every value against the flipped others.
            own, more = at_most(bits // 2), at_most(bits // 2 + 1)
            reached = np.concatenate([values ^ f for f in own])
            other = np.concatenate([values ^ f for f in more])
            who, whom = np.tile(np.arange(len(values)), len(own)), np.tile(np.arange(len(values)), len(more))
            order = np.argsort(reached, kind="stable")
            spot = np.searchsorted(reached[order], other)
            hit = (spot < len(order)) & (reached[order][np.minimum(spot, len(order) - 1)] == other)
            a, b = whom[hit], who[order][spot[hit]]
            # Values at one reached point are within an even bound below `bits` of each other.
            same = reached[order][1:] == reached[order][:-1]
            a, b = np.append(a, who[order][1:][same]), np.append(b, who[order][:-1][same])
        else:
            reached = np.concatenate([values ^ f for f in flips])
            who = np.tile(np.arange(len(values)), len(flips))
            order = np.argsort(reached, kind="stable")
            same = reached[order][1:] == reached[order][:-1]
            a, b = who[order][1:][same], who[order][:-1][same]
        verified = np.bitwise_count(values[a] ^ values[b]) <= bits
        a, b = a[verified], b[verified]
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return np.array([top(k) for k in range(len(values))])


def links(prints, bits=BITS):
    """Links (a, b) between different fingerprints of column fp, enough to connect all within `bits`.

    Each row names a member of a posting and the smallest member it is connected to there.
    """
    if not 0 < bits < 8:
        raise ValueError("bits must be 1..7")
    spread = [list(c) for c in combinations(range(8), 8 - bits)]
    masks = [sum(0xFF << (8 * k) for k in c) for c in spread]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    # Two longs key a posting: which positions, and the bytes there.
    postings = prints.select("fp").distinct().select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("positions", "bytes")
    )
    # A posting of one fingerprint links nothing; the lists stay bounded by the bytes that vary.
    lists = postings.groupBy("positions", "bytes").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1).select("members")

    def join(batches):
        for batch in batches:
            a, b = [], []
            for members in batch[0]:
                values = np.sort(np.array(members.as_py(), dtype=np.int64).view(np.uint64))
                low = _near(values, bits)
                moved = np.flatnonzero(low != np.arange(len(values)))
                a.append(values[moved].view(np.int64))
                b.append(values[low[moved]].view(np.int64))
            yield pa.record_batch([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (a, b)], names=["a", "b"])

    return lists.mapInArrow(join, "a long, b long")


def near_duplicates(docs, id="doc_id", text="text", shingle=SHINGLE, bits=BITS):
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable) for every row.

    Rows of equal fingerprints, those without words included, are linked. Null ids count as no id:
    such rows get their component's smallest id (null if no row of it has one). Repeated rows are
    kept. An empty table gives none.
    """
    prints = settle(fingerprints(docs, id, text, shingle), "fingerprints")
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(first, bits))
    classes = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = settle(classes, "classes")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "root").select("fp", "component_id")
    # A fingerprint that a third of all rows share is one row here; the large side may be split.
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
