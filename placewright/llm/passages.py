"""Repeated passages over all documents, by column-wise construction of Burrows-Wheeler transforms.

Every LENGTH-byte string has a hash of its own content, the smallest hash among its ANCHOR-byte
pieces. Neighbouring strings of one hash form a run of at most LENGTH - ANCHOR + 1 strings, which is
kept as one short text (under 100 bytes). Equal strings have equal hashes, so texts of one hash can
be compared without any other:

1. documents are written in blocks of bounded size, which all later passes read in place;
2. each block tells the hashes it holds, once each; hashes told only once by one block are done with;
3. each block sends its different texts of the shared hashes, with the smallest document id that
   has each, so a passage in a third of all documents counts once per block;
4. the texts that meet are one collection: its Burrows-Wheeler transform is built column by column
   from the right, one symbol of every text per round, inserted where the last round's transform
   says. Runs of common prefixes of LENGTH in the order that results are the repeated strings, and
   their smallest document id goes back to the blocks as bits;
5. each block marks the bytes of its documents.

A hash with very many texts (SPREAD; white space, markup) is dealt out string by string over all
buckets by a second hash of the whole string. Collections are bounded and read front to back once
per round; what lies between the steps are files of Spark's shuffles and of the shared folder.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import enter, new_folder, settle

LENGTH = 50
ANCHOR = 20
WINDOWS = LENGTH - ANCHOR + 1
BLOCK_BYTES = 8 << 20  # a block ends with the document that reaches this size
SPREAD = 20_000  # texts of one hash, over all blocks, from which its strings are dealt out one by one
COLLECTION = 8192  # texts that are ordered together, unless one hash has more
_STEP = 1 << 20  # bytes hashed at once
_LAST = np.iinfo(np.int64).max  # stands for a null document id


# ---- strings and their hashes -------------------------------------------------------------------


def _mix(h):
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(29))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _rolling(raw, size):
    """A hash of every `size` bytes: [i] is of raw[i : i + size]. Doubles the covered length."""
    power, covered, out = 0xD6E8FEB86659FD93, 1, None
    current, have, n = _BYTES[raw], 0, len(raw)
    while size:
        if size & covered:
            if out is None:
                out, have = current, covered
            else:
                m = n - have - covered + 1
                out = out[:m] * np.uint64(power) + current[have : have + m]
                have += covered
            size &= ~covered
        if size:
            m = len(current) - covered
            current = current[:m] * np.uint64(power) + current[covered : covered + m]
            power = (power * power + 2) % (1 << 64)
            covered *= 2
    return _mix(out)


def _sliding_min(values, size):
    current, covered = values, 1
    while 2 * covered <= size:
        current = np.minimum(current[:-covered], current[covered:])
        covered *= 2
    rest = size - covered
    return np.minimum(current[: len(current) - rest], current[rest:]) if rest else current


def runs(raw, stops, bits):
    """Runs of strings of one hash: start, number of strings (1..WINDOWS), hash of `bits` bits.

    raw: the bytes of all documents of a block on end; stops: where each document ends.
    """
    found = []
    for at in range(0, len(raw) - LENGTH + 1, _STEP):
        part = raw[at : at + _STEP + LENGTH - 1]
        n = len(part) - LENGTH + 1
        inside = np.ones(n, dtype=bool)
        near = np.searchsorted(stops, [at, at + n + LENGTH], side="right")
        for stop in stops[near[0] : near[1]].tolist():  # no string crosses a document's end
            inside[max(0, stop - LENGTH + 1 - at) : max(0, stop - at)] = False
        # The smallest of many hashes is small; mixed again, all buckets get alike.
        hashes = _mix(_sliding_min(_rolling(part, ANCHOR), WINDOWS)) >> np.uint64(64 - bits)
        new = np.ones(n, dtype=bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (inside[1:] != inside[:-1])
        start = np.flatnonzero(new)
        count = np.diff(start, append=n)
        keep = inside[start]
        start, count = start[keep], count[keep]
        # A run of periodic text may be long: cut it.
        pieces = (count + WINDOWS - 1) // WINDOWS
        which = np.repeat(np.arange(len(start)), pieces)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = start[which] + nth * WINDOWS
        length = np.minimum(count[which] - nth * WINDOWS, WINDOWS)
        found.append((begin + at, length, hashes[begin]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


# ---- small codecs -------------------------------------------------------------------------------


def _packed(*arrays):
    """Arrays as one compressed value; numbers are stored in byte planes."""
    press, parts = zstandard.ZstdCompressor(level=3), []
    for a in arrays:
        a = np.ascontiguousarray(a)
        raw = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if a.dtype.itemsize > 1 else a.tobytes()
        head = np.array([len(a)], np.int64).tobytes() + a.dtype.str.encode().ljust(8)
        parts += [head, raw]
    return press.compress(b"".join(parts))


def _unpacked(value):
    raw, at, out = zstandard.ZstdDecompressor().decompress(value), 0, []
    while at < len(raw):
        n, kind = int(np.frombuffer(raw, np.int64, 1, at)[0]), np.dtype(raw[at + 8 : at + 16].decode().strip())
        at += 16
        body = np.frombuffer(raw, np.uint8, n * kind.itemsize, at)
        at += n * kind.itemsize
        out.append(np.ascontiguousarray(body.reshape(kind.itemsize, n).T).view(kind).reshape(n) if kind.itemsize > 1 else body)
    return out


def _sorted_packed(values, *more):
    """Ascending uint64 values as differences."""
    return _packed(np.diff(values, prepend=np.uint64(0)), *more)


def _sorted_unpacked(value):
    first, *more = _unpacked(value)
    return [np.cumsum(first, dtype=np.uint64), *more]


# ---- the ordered collection ---------------------------------------------------------------------


def suffix_order(texts, lengths, least=LENGTH):
    """Order of all suffixes of at least `least` symbols of a collection: (text, start) arrays.

    texts: uint8 matrix, each text right-aligned in its row; a text's symbols precede an end mark
    that is smaller than any symbol. Round by round one more symbol of every text, from the right,
    goes into the transform: suffix x's entry is the symbol before it, and a stable sort of the
    entries by symbol is the order of the suffixes one symbol longer.
    """
    m, width = texts.shape
    symbols = texts.astype(np.uint16) + 1  # 0: nothing before this suffix, or not known yet
    entries = np.zeros(m, np.uint16)  # the transform; at first the empty suffixes, by text number
    place = np.arange(m)
    active = np.arange(m)
    spots = []
    for back in range(int(lengths.max(initial=0))):
        active = active[lengths[active] > back]
        entries[place[active]] = symbols[active, width - 1 - back]
        order = np.argsort(entries.astype(np.uint8) if entries.max() < 256 else entries, kind="stable")
        zeros = len(entries) - np.count_nonzero(entries)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        fresh = m - zeros + rank[place[active]]  # where the new suffixes stand
        # Where the older ones, first of all the empty ones, go on standing: all other places.
        grown = np.zeros(m + len(entries) - zeros, np.uint16)
        old = np.ones(len(grown), dtype=bool)
        old[fresh] = False
        moved = np.flatnonzero(old)
        grown[moved] = entries
        entries = grown
        spots = [(who, moved[at]) for who, at in spots]
        place = moved[place]
        place[active] = fresh
        if back + 1 >= least:
            spots.append((active * width + (lengths[active] - back - 1), fresh))
    if not spots:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    who, at = (np.concatenate(x) for x in zip(*spots, strict=True))
    who = who[np.argsort(at)]
    return who // width, who % width


def first_owner(texts, lengths, owners, least=LENGTH):
    """Per text and start (matrix, as wide as starts go): the smallest owner of an equal string."""
    width = texts.shape[1]
    out = np.full((len(texts), max(1, width - least + 1)), _LAST)
    text, start = suffix_order(texts, lengths, least)
    if not len(text):
        return out
    # Common prefixes of neighbours in the order: do they reach `least`?
    raw = texts.reshape(-1)
    at = text * width + width - lengths[text] + start
    same = np.ones(len(at), dtype=bool)
    same[0] = False
    for k in range(least):
        left = np.flatnonzero(same)
        same[left] = raw[at[left] + k] == raw[at[left - 1] + k]
    group = np.flatnonzero(~same)
    low = np.minimum.reduceat(owners[text], group)
    out[text, start] = np.repeat(low, np.diff(group, append=len(at)))
    return out


def _matrix(raw, starts, lengths, width):
    """Right-aligned texts as rows."""
    out = np.zeros((len(starts), width), np.uint8)
    column = np.arange(width) - width
    for at in range(0, len(starts), COLLECTION):  # index arrays are eight times the texts
        part = slice(at, at + COLLECTION)
        there = column[None, :] + lengths[part, None]
        out[part] = np.where(there >= 0, raw[np.maximum(starts[part, None] + there, 0)], 0)
    return out


def _distinct(matrix, lengths, hashes):
    """Order of first members and class of each row, rows equal in hash, length and symbols."""
    key = np.concatenate([hashes[:, None].view(np.uint8).reshape(len(hashes), 8)[:, ::-1], lengths[:, None].astype(np.uint8), matrix], axis=1)
    key = np.ascontiguousarray(key).view(f"V{key.shape[1]}").reshape(-1)
    _, first, kind = np.unique(key, return_index=True, return_inverse=True)
    return first, kind.reshape(-1)


def compare(raw, lengths, hashes, owners):
    """Per text, a bit per string (lowest: the first) that says whether a smaller owner has it too."""
    if not len(lengths):
        return np.zeros(0, np.uint32)
    lengths = lengths.astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    width = int(lengths.max())
    matrix = _matrix(raw, starts, lengths, width)
    first, kind = _distinct(matrix, lengths, hashes)
    low = np.full(len(first), _LAST)
    np.minimum.at(low, kind, owners)
    bits = np.zeros(len(lengths), np.uint32)
    # Distinct texts come sorted by hash. A hash with one distinct text has nothing else to compare.
    own = hashes[first]
    edges = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    sizes = np.diff(edges, append=len(own))
    lowest = np.repeat(low[:, None], WINDOWS, axis=1)
    shared = np.flatnonzero(np.repeat(sizes > 1, sizes))
    begin = 0
    stops = np.cumsum(sizes[sizes > 1])
    while begin < len(shared):
        # Whole hashes up to COLLECTION texts, one hash at least.
        k = int(np.searchsorted(stops, begin + COLLECTION, side="right"))
        stop = int(stops[k - 1]) if k and stops[k - 1] > begin else int(stops[k])
        rows = shared[begin:stop]
        take = first[rows]
        most = int(lengths[take].max())
        found = first_owner(np.ascontiguousarray(matrix[take][:, width - most :]), lengths[take], low[rows])
        lowest[rows, : found.shape[1]] = found
        begin = stop
    for k in range(WINDOWS):
        smaller = (lowest[kind, k] < owners) & (lengths - LENGTH >= k)
        bits |= smaller.astype(np.uint32) << np.uint32(k)
    return bits


# ---- blocks -------------------------------------------------------------------------------------


class _Block:
    """The documents of one block, in an order that every pass finds again."""

    def __init__(self, rows, bits):
        rows = rows.combine_chunks()
        rows = rows.take(pc.sort_indices(rows, [("doc_id", "ascending"), ("raw", "ascending")]))
        column = rows["raw"].combine_chunks() if rows.num_rows else pa.array([], pa.binary())
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        buffers = column.buffers()
        edges = np.frombuffer(buffers[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64) if len(column) else np.zeros(1, np.int64)
        whole = np.frombuffer(buffers[2], np.uint8) if len(column) and buffers[2] is not None else np.zeros(0, np.uint8)
        self.raw, edges = whole[edges[0] : edges[-1]], edges - edges[0]
        self.starts, self.stops = edges[:-1], edges[1:]
        self.rows, self.doc_ids = rows, rows["doc_id"]
        self.ids = pc.fill_null(self.doc_ids, _LAST).to_numpy()
        self.bits = bits
        self.start, self.count, self.hash = runs(self.raw, self.stops, bits)

    def owner(self, start):
        """The row that holds this byte."""
        return np.searchsorted(self.stops, start, side="right")

    def texts(self, shared, crowded):
        """Occurrences of shared hashes and their distinct texts, sorted by bucket key.

        Returns (occurrence start, strings, class), and per class key, length, first start, lowest id.
        """
        spot = np.minimum(np.searchsorted(shared, self.hash), max(0, len(shared) - 1))
        keep = np.flatnonzero(shared[spot] == self.hash) if len(shared) else np.zeros(0, np.int64)
        start, count, key = self.start[keep], self.count[keep], self.hash[keep]
        split = crowded[spot[keep]].astype(bool) if len(shared) else np.zeros(0, bool)
        if split.any():
            # One text per string, dealt by a hash of the whole string.
            n = count[split]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            single = np.repeat(start[split], n) + nth
            hashes = np.zeros(len(single), np.uint64)
            for at in range(0, len(single), _STEP // LENGTH):
                part = single[at : at + _STEP // LENGTH]
                bytes_ = self.raw[part[:, None] + np.arange(LENGTH)].reshape(-1)
                hashes[at : at + len(part)] = _rolling(bytes_, LENGTH)[::LENGTH]
            start = np.concatenate([start[~split], single])
            key = np.concatenate([key[~split], hashes >> np.uint64(64 - self.bits)])
            count = np.concatenate([count[~split], np.ones(len(single), np.int64)])
        lengths = count + LENGTH - 1
        matrix = _matrix(self.raw, start, lengths, LENGTH + WINDOWS - 1)
        first, kind = _distinct(matrix, lengths, key) if len(start) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        low = np.full(len(first), _LAST)
        np.minimum.at(low, kind, self.ids[self.owner(start)])
        return (start, count, kind), (key[first], lengths[first], start[first], low)


def _buckets(keys, bits, n):
    """Where each bucket's keys end, of ascending keys; n is a power of two."""
    shift = np.uint64(bits - int(math.log2(n)))
    return np.searchsorted(keys >> shift, np.arange(n, dtype=np.uint64), side="right")


def _write_blocks(docs, id, text, block_bytes, with_row):
    """doc_id, raw, block: a table bucketed by block, which later passes read without a shuffle."""
    spark = docs.sparkSession
    raw = F.coalesce(docs[text].cast("binary"), F.lit(b"")).alias("raw")
    others = [F.struct(*[docs[c] for c in docs.columns if c != text]).alias("row")] if with_row else []
    rows = docs.select(docs[id].cast("long").alias("doc_id"), raw, *others)

    def cut(batches):
        task, number, size = TaskContext.get().partitionId() << 24, 0, 0
        for batch in batches:
            blocks = []
            for n in pc.binary_length(batch[1]).to_pylist():
                blocks.append(task + number)
                size += n
                if size >= block_bytes:
                    number, size = number + 1, 0
            yield pa.record_batch([*batch.columns, pa.array(blocks, pa.int64())], names=[*batch.schema.names, "block"])

    name = new_folder(spark, "blocks")
    label = "passages_" + name.rsplit("-", 1)[-1]
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = T.StructType([*rows.schema.fields, T.StructField("block", T.LongType())])
    writer = rows.mapInArrow(cut, kind).write.option("path", name).option("compression", "zstd")
    writer.bucketBy(width, "block").saveAsTable(label)
    return spark.table(label)


def find(docs, id="doc_id", text="text", block_bytes=BLOCK_BYTES, with_row=False):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    with_row adds `left`, the text left (stray bytes of cut characters go), and `row`, a struct of
    the row's other columns.

    A byte goes if a LENGTH-byte string over it also starts in a document with a smaller id. A null
    text is empty; a null id counts as larger than any other; rows of one id are one document, so
    they never remove from each other. Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    whole = _write_blocks(docs, id, text, block_bytes, with_row)
    blocks = whole.select("doc_id", "raw", "block")
    total = blocks.agg(F.coalesce(F.sum(F.length("raw")), F.lit(0))).head()[0]
    parts = 1 << max(3, math.ceil(math.log2(max(1, 2 * total / block_bytes))))
    bits = min(64, max(40, math.ceil(math.log2(max(2, total))) + 14))

    def tell(rows):
        enter("passages")
        block, number = _Block(rows, bits), rows["block"][0].as_py()
        hashes, times = np.unique(block.hash, return_counts=True)
        stops, at, out = _buckets(hashes, bits, parts), 0, []
        for bucket, stop in enumerate(stops.tolist()):
            if stop > at:
                out.append((bucket, number, _sorted_packed(hashes[at:stop], np.minimum(times[at:stop], 65_535).astype(np.uint16))))
            at = stop
        return _rows(out, ["bucket", "block", "value"])

    def share(rows):
        enter("passages")
        values = [_sorted_unpacked(v.as_py()) for v in rows["value"]]
        hashes = np.concatenate([v[0] for v in values])
        times = np.concatenate([v[1] for v in values]).astype(np.int64)
        kinds, kind = np.unique(hashes, return_inverse=True)
        total = np.bincount(kind, weights=times)
        out, at, bucket = [], 0, rows["bucket"][0].as_py()
        for block, v in zip(rows["block"].to_pylist(), values, strict=True):
            n = total[kind[at : at + len(v[0])]]
            at += len(v[0])
            if (n > 1).any():
                out.append((bucket, block, _sorted_packed(v[0][n > 1], (n[n > 1] > SPREAD).astype(np.uint8))))
        return _rows(out, ["bucket", "block", "value"])

    kind = "bucket long, block long, value binary"
    told = blocks.groupBy("block").applyInArrow(tell, kind)
    shared = settle(told.groupBy("bucket").applyInArrow(share, kind), "shared")

    def known(rows):
        """Shared hashes of a block, ascending, and which of them are crowded."""
        values = [_sorted_unpacked(v) for _, v in sorted(zip(rows["bucket"].to_pylist(), rows["value"].to_pylist(), strict=True))]
        if not values:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        return np.concatenate([v[0] for v in values]), np.concatenate([v[1] for v in values])

    def send(key, rows, hashes):
        if not rows.num_rows or not hashes.num_rows:
            return _rows([], ["bucket", "block", "value"])
        enter("passages")
        block = _Block(rows, bits)
        _, (keys, lengths, starts, low) = block.texts(*known(hashes))
        stops, at, out = _buckets(keys, bits, parts), 0, []
        for bucket, stop in enumerate(stops.tolist()):
            if stop > at:
                n, s = lengths[at:stop], starts[at:stop]
                spots = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(n.sum())
                out.append((bucket, key[0].as_py(), _sorted_packed(keys[at:stop], n.astype(np.uint8), low[at:stop], block.raw[spots])))
            at = stop
        return _rows(out, ["bucket", "block", "value"])

    def meet(rows):
        enter("passages")
        values = [_sorted_unpacked(v.as_py()) for v in rows["value"]]
        keys, lengths, low, raw = (np.concatenate([v[k] for v in values]) for k in range(4))
        found, out, at = compare(raw, lengths, keys, low), [], 0
        for block, v in zip(rows["block"].to_pylist(), values, strict=True):
            out.append((rows["bucket"][0].as_py(), block, _packed(found[at : at + len(v[0])])))
            at += len(v[0])
        return _rows(out, ["bucket", "block", "value"])

    sent = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(send, kind)
    met = sent.groupBy("bucket").applyInArrow(meet, kind)
    back = shared.select("block", F.lit(0).alias("step"), "bucket", "value").unionByName(met.select("block", F.lit(1).alias("step"), "bucket", "value"))

    def mark(key, rows, values):
        enter("passages")
        block = _Block(rows, bits)
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["left"] * with_row]
        cover = np.zeros(len(block.raw) + 1, np.int8)
        if values.num_rows:
            (start, count, kind), (_, _, _, low) = block.texts(*known(values.filter(pc.equal(values["step"], 0))))
            answers = values.filter(pc.equal(values["step"], 1))
            pairs = sorted(zip(answers["bucket"].to_pylist(), answers["value"].to_pylist(), strict=True))
            found = np.concatenate([_unpacked(v)[0] for _, v in pairs]) if pairs else np.zeros(0, np.uint32)
            # A smaller document has the string: one elsewhere, or this text's lowest in the block.
            own, later = found[kind], low[kind] < block.ids[block.owner(start)]
            for k in range(WINDOWS):
                # Every string of the block starts at a place of its own, so no index comes twice.
                gone = start[(k < count) & (later | (own >> np.uint32(k) & np.uint32(1)).astype(bool))] + k
                cover[gone] += 1
                cover[gone + LENGTH] -= 1
        gone = np.cumsum(cover, dtype=np.int8)[:-1] > 0  # at most LENGTH strings cover a byte
        out = []
        for k, (a, b) in enumerate(zip(block.starts.tolist(), block.stops.tolist(), strict=True)):
            own = gone[a:b]
            n = int(np.count_nonzero(own))
            left = block.raw[a:b][~own].tobytes() if n else block.raw[a:b].tobytes()
            spans = int(own[0]) + int(np.count_nonzero(own[1:] & ~own[:-1])) if n else 0
            row = (b - a, n, spans, hashlib.sha256(left).hexdigest())
            out.append((block.doc_ids[k].as_py(), *row, *((left.decode("utf-8", "ignore"),) if with_row else ())))
        found = _rows(out, names)
        return found.append_column("row", block.rows["row"]) if with_row else found

    result = T.StructType().add("doc_id", "long").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    if with_row:
        result.add("left", "string").add("row", whole.schema["row"].dataType)
    return whole.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(mark, result)


_TYPES = {"value": pa.binary(), "left": pa.string(), "kept_sha256": pa.string()}


def _rows(rows, names):
    found = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table({n: pa.array(v, _TYPES.get(n, pa.int64())) for n, v in zip(names, found, strict=True)})
