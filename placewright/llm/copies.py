"""Near copies by 5-word similarity, through inverted indexes of byte positions with count filtering.

Two indexes link texts. The first is that of simhash.py over the SimHash of a text's 5-word shingles: all
texts within two bits meet there. Bits of a SimHash can't promise shared bytes at similarity 0.8: the fingerprints of such texts differ
in some 15 % of their bits at any length, which is more than one bit per byte. The positional bytes
of the second index are of smallest hashes (MinHash): two texts agree in a byte with a chance of their
similarity, so a pair of 0.8 shares some 140 of 175 bytes. The index is keyed by runs of five
bytes; a pair of 0.8 misses all 35 with a chance of 1e-6 (of 0.85: 4e-10). A pair that meets counts if it shares
LEAST_SHARED bytes (a pair of 0.8 has fewer with a chance below 1e-8). Links so found only say which
texts are compared; what is a copy is decided on the whole sets of shingles: shared / all >= 4/5.

Texts of equal sets are one node. Members of a posting, and of a set of linked texts, are searched
breadth first in the task that has them: each is compared with those that no link has reached yet,
so all pairs are linked as if all had been compared, and only links to one member leave.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import enter, settle
from .components import components

SHINGLE = 5
SHARED, ALL = 4, 5  # the least similarity is SHARED / ALL
SEED = 42
RUN, RUNS = 5, 35
LEAST_SHARED = 105

_draw = np.random.Generator(np.random.PCG64(SEED))
_TURN = _draw.integers(0, 1 << 32, RUN * RUNS, dtype=np.uint32)
_TIMES = _draw.integers(0, 1 << 32, RUN * RUNS, dtype=np.uint32) | np.uint32(1)


def shingles(text):
    """Sorted different hashes of a text's 5-word shingles; of all its words if it has fewer."""
    return np.unique(simhash.hashes(text, SHINGLE))


def positional(hashes):
    """The fingerprint of a set: a byte of the smallest hash under each of RUN * RUNS functions."""
    least = np.full(len(_TURN), 0xFFFFFFFF, np.uint32)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), 1024):
        np.minimum(least, ((high[at : at + 1024, None] ^ _TURN) * _TIMES).min(axis=0), out=least)
    return (least & np.uint32(0xFF)).astype(np.uint8)


def search(n, near):
    """Smallest index of each index's connected set. near(k, rest): those of `rest` that k is linked to."""
    root, rest = np.arange(n), np.arange(n)
    while len(rest):
        seed, rest = rest[0], rest[1:]
        queue = [seed]
        while queue and len(rest):
            hit = near(queue.pop(), rest)
            root[hit] = seed
            rest = np.setdiff1d(rest, hit, assume_unique=True)
            queue.extend(hit.tolist())
    return root


def by_bytes(prints):
    return search(len(prints), lambda k, rest: rest[(prints[rest] == prints[k]).sum(axis=1) >= LEAST_SHARED])


def by_sets(sets):
    """As `search`, for sets linked by similarity; a set's rarest shingles lead to those it can be similar to."""
    sizes = np.array([len(s) for s in sets])
    ends = np.append(0, np.cumsum(sizes))
    _, flat, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))
    flat = rank[flat.reshape(-1)]
    # Sets of similarity SHARED / ALL have one of so many rarest shingles in common.
    first = [np.sort(flat[a:b])[: (b - a) - -(-SHARED * (b - a) // ALL) + 1] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    owner, token = np.repeat(np.arange(len(sets)), [len(f) for f in first]), np.concatenate(first)
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    mark, waits = np.zeros(len(times), bool), np.zeros(len(sets), bool)

    def near(k, rest):
        waits[rest] = True
        spans = zip(np.searchsorted(token, first[k]), np.searchsorted(token, first[k], "right"), strict=True)
        met = np.unique(np.concatenate([owner[a:b] for a, b in spans]))
        met = met[waits[met]]
        waits[rest] = False
        met = met[(ALL * sizes[met] >= SHARED * sizes[k]) & (ALL * sizes[k] >= SHARED * sizes[met])]
        mark[flat[ends[k] : ends[k + 1]]] = True
        both = np.array([np.count_nonzero(mark[flat[ends[m] : ends[m + 1]]]) for m in met.tolist()], np.int64)
        mark[flat[ends[k] : ends[k + 1]]] = False
        return met[ALL * both >= SHARED * (sizes[met] + sizes[k] - both)]

    return search(len(sets), near)


def _linked(rows, group, value, read, find):
    """Links (a, b) of the members (column `node`) of each group by what `read` makes of their values."""

    def link(batches):
        enter("copies")
        last, nodes, values = None, [], []

        def close():
            nodes_, root = np.array(nodes, np.int64), find(values) if nodes else np.zeros(0, np.int64)
            moved = np.flatnonzero(root != np.arange(len(nodes_)))
            return pa.record_batch([pa.array(nodes_[moved]), pa.array(nodes_[root[moved]])], names=["a", "b"])

        for batch in batches:
            for g, node, v in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2], strict=True):
                if g != last and nodes:
                    yield close()
                    nodes, values = [], []
                last = g
                nodes.append(node)
                values.append(read(v.as_py()))
        yield close()

    return rows.select(group, "node", value).repartition(group).sortWithinPartitions(group).mapInArrow(link, "a long, b long")


def by_bits(rows):
    """Links (a, b) of the nodes of rows (node, fp) whose SimHashes are within simhash.BITS of each other."""
    first = settle(rows.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    equal = rows.join(first, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    named = lambda end: first.select(F.col("fp").alias(end), F.col("first").alias("of_" + end))
    near = simhash.links(first).join(named("a"), "a").join(named("b"), "b")
    return equal.unionByName(near.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))


def unlike(docs, id="doc_id", text="text"):
    """The rows of docs that are no near copy of a row kept: of every connected set of similarity 0.8
    or more one row, that of the smallest id (a row without id only where none has one; of equal
    ids the one of the smallest digest of its text). Texts without words are copies of each other.
    """
    taken = docs.select(F.col(id).alias("id"), F.col(text).alias("said"), F.struct(*[docs[c] for c in docs.columns if c != text]).alias("row"))

    def read(batches):
        enter("copies")
        task, number = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            nodes, prints, bits = [], [], []
            for said in batch[1]:
                every = simhash.hashes(said.as_py(), SHINGLE)
                bits.append(simhash.print_of(every))
                hashes = np.unique(every)
                nodes.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
                prints.append(positional(hashes).tobytes() if len(hashes) else None)
            numbers = np.arange(task + number, task + number + batch.num_rows)
            number += batch.num_rows
            made = [pa.array(numbers), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(prints, pa.binary()), pa.array(np.array(bits, np.uint64).view(np.int64))]
            yield pa.record_batch([*made, *batch.columns], names=["number", "node", "print", "fp", "id", "said", "row"])

    kind = T.StructType([*T.StructType().add("number", "long").add("node", "long").add("print", "binary").add("fp", "long"), *taken.schema])
    made = settle(taken.mapInArrow(read, kind), "shingles")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", F.md5(F.coalesce("said", F.lit(""))).alias("digest"), "number")
    sets = settle(made.groupBy("node").agg(F.min(rank).alias("best"), F.min("print").alias("print")), "sets")

    def keyed(batches):
        for batch in batches:
            prints = np.frombuffer(b"".join(batch[1].to_pylist()), np.uint8).reshape(-1, RUNS, RUN).astype(np.int64)
            keys = np.arange(RUNS) << (8 * RUN) | (prints << (8 * np.arange(RUN))).sum(axis=2)
            yield pa.record_batch([pa.array(keys.reshape(-1)), pa.array(np.repeat(batch[0].to_numpy(), RUNS))], names=["key", "node"])

    postings = sets.where("print is not null").select("node", "print").mapInArrow(keyed, "key long, node long")
    # A posting of one fingerprint links nothing.
    shared = postings.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    met = postings.join(shared, "key", "left_semi").join(sets.select("node", "print"), "node")
    near = _linked(met, "key", "print", lambda v: np.frombuffer(v, np.uint8), lambda v: by_bytes(np.array(v)))
    roots = components(near.unionByName(by_bits(made.where("print is not null"))))
    texts = roots.join(sets.select("node", F.col("best.number").alias("number")), "node").join(made.select("number", "said"), "number")
    copies = settle(_linked(texts, "root", "said", shingles, by_sets), "copies")
    groups = sets.join(copies.withColumnRenamed("a", "node"), "node", "left").groupBy(F.coalesce("b", "node").alias("root"))
    kept = groups.agg(F.min("best").alias("best")).select(F.col("best.number").alias("number"))
    found = made.join(kept, "number", "left_semi")
    return found.select("row.*", F.col("said").alias(text)).select(*docs.columns)
