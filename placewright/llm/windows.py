"""Repeated windows of words over all documents, by super-k-mers that travel to their minimiser's bucket.

A window is SIZE consecutive words. Its minimiser is the smallest hash among its runs of PIECE words;
neighbouring windows mostly share it, and those that do form a super-k-mer: one packed string of
their words, a third of a window's length per window at most. Equal windows have equal minimisers,
so they meet in one bucket, where sorting all windows counts them and finds the first of each.

1. documents are written in blocks of bounded size, which later passes read in place;
2. each block tells its different minimisers with their occurrences; Spark sums them, and a
   minimiser that occurs once anywhere is done with: most of all text never travels;
3. each block sends its different super-k-mers of the others once, with their first place in the
   block, so that a passage in a third of all documents counts once per block;
4. a bucket sorts all windows of its strings by word numbers and answers one bit per window: an equal
   one starts earlier elsewhere;
5. each block marks the words of its documents.

A minimiser with very many occurrences (CROWDED) may stand at the edge of a common passage, with
other words beside it every time. Its windows are dealt out one by one over all buckets, by a hash
of the whole window. Hashes only deal: windows are equal if their words are.
"""

import hashlib
import math
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import functions as F

from .common import columns, enter, new_folder, settle
from .passages import _packed as packed
from .passages import _unpacked as unpacked

SIZE = 20
PIECE = 5
WINDOWS = SIZE - PIECE + 1  # of one minimiser, at most: longer super-k-mers are cut
BLOCK_BYTES = 8 << 20  # a block ends with the document that reaches this size
BUCKET_BYTES = 8 << 20  # of text for each bucket; far less of it travels
CROWDED = 20_000
_LAST = np.iinfo(np.int64).max  # stands for a null document id


def _mix(h):
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(29))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE, _INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
_STEP = 1 << 18  # bytes hashed at once


def _powers(base):
    out = np.full(_STEP, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


def word_hashes(raw, start, stop):
    """A hash of raw[start:stop] for each word, by differences of running sums."""
    out, k = np.empty(len(start), np.uint64), 0
    while k < len(start):
        a = int(start[k])
        if stop[k] - a > _STEP:  # a word longer than a step
            digest = hashlib.blake2b(raw[a : int(stop[k])].tobytes(), digest_size=8).digest()
            out[k] = np.frombuffer(digest, np.uint64)[0]
            k += 1
            continue
        end = int(np.searchsorted(stop, a + _STEP, side="right"))
        n = int(stop[end - 1]) - a
        sums = np.append(np.uint64(0), np.cumsum(_BYTES[raw[a : a + n]] * _UP[:n], dtype=np.uint64))
        s, e = start[k:end] - a, stop[k:end] - a
        out[k:end] = (sums[e] - sums[s]) * _DOWN[s]
        k = end
    return _mix(out)


def _chained(values, size):
    """A hash of every `size` neighbouring values."""
    n = max(0, len(values) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(_BASE) + values[k : k + n]
    return _mix(out)


def _sliding_min(values, size):
    covered = 1
    while 2 * covered <= size:
        values = np.minimum(values[:-covered], values[covered:])
        covered *= 2
    rest = size - covered
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


class Words:
    """The words of some texts on end, with a space after each."""

    def __init__(self, texts):
        kept = [t.split() for t in texts]  # bytes split at the six white-space characters of ASCII
        self.counts = np.array([len(w) for w in kept], np.int64)
        self.edges = np.append(0, np.cumsum(self.counts))
        self.text = b"".join(b" ".join(w) + b" " for w in kept if w)
        raw = np.frombuffer(self.text, np.uint8)
        self.stop = np.flatnonzero(raw == 32)
        self.start = np.append(0, self.stop + 1)[: len(self.stop)]
        self.hashes = word_hashes(raw, self.start, self.stop)

    def super_kmers(self):
        """First word, number of windows (1..WINDOWS), minimiser of each super-k-mer, in order, and
        whether a run of PIECE words comes again inside it, so that its own windows may be equal."""
        n = len(self.hashes) - SIZE + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
        runs = _chained(self.hashes, PIECE)
        smallest = _mix(_sliding_min(runs, WINDOWS))  # mixed: smallest hashes are small
        inside = np.ones(n, bool)
        for stop in self.edges[1:-1].tolist():  # no window reaches into the next text
            inside[max(0, stop - SIZE + 1) : max(0, stop)] = False
        new = np.append(True, (smallest[1:] != smallest[:-1]) | (inside[1:] != inside[:-1]))
        first = np.flatnonzero(new)
        count = np.diff(first, append=n)
        first, count = first[inside[first]], count[inside[first]]
        pieces = (count + WINDOWS - 1) // WINDOWS
        which = np.repeat(np.arange(len(first)), pieces)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = first[which] + nth * WINDOWS
        count = np.minimum(count[which] - nth * WINDOWS, WINDOWS)
        again = np.zeros(len(runs) + 1, bool)  # [k + 1]: run k stands within the WINDOWS before it
        for back in range(1, WINDOWS):
            again[back + 1 :] |= runs[back:] == runs[:-back]
        seen = np.cumsum(again)
        return begin, count, smallest[begin], seen[begin + count + WINDOWS - 1] > seen[begin + 1]

    def strings(self, first, count):
        """The packed strings: words of `count` windows from word `first` on."""
        text = self.text
        spots = zip(self.start[first].tolist(), self.stop[first + count + SIZE - 2].tolist(), strict=True)
        return [text[a:b] for a, b in spots]


# ---- a bucket -----------------------------------------------------------------------------------


def sorted_classes(ids, at):
    """Class numbers of the windows of SIZE word numbers that begin at `at`: equal windows, equal class.

    Windows are sorted by a hash of their word numbers, and neighbours compared word by word. If two
    different windows share a hash, all are sorted by their words instead.
    """
    key = np.zeros(len(at), np.uint64)
    for k in range(SIZE):
        key = key * np.uint64(_BASE) + ids[at + k].astype(np.uint64)
    order = np.argsort(_mix(key), kind="stable")
    key, spots = key[order], at[order]
    same = np.append(False, key[1:] == key[:-1])[: len(at)]
    equal = same.copy()
    for k in range(SIZE):
        left = np.flatnonzero(equal)
        equal[left] = ids[spots[left] + k] == ids[spots[left - 1] + k]
    if (same != equal).any():
        order = np.lexsort([ids[at + k] for k in range(SIZE - 1, -1, -1)])
        spots, equal = at[order], np.ones(len(at), bool)
        equal[:1] = False
        for k in range(SIZE):
            left = np.flatnonzero(equal)
            equal[left] = ids[spots[left] + k] == ids[spots[left - 1] + k]
    out = np.empty(len(at), np.int64)
    out[order] = np.cumsum(~equal) - 1
    return out


def first_bits(strings, counts, owners):
    """Per string a bit per window (lowest: the first): an equal window starts earlier elsewhere.

    owners: an array per string's (document, digest, first word), whose order is the order of texts.
    """
    numbers, words = {}, b" ".join(strings).split(b" ") if strings else []
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words))
    sizes = counts + SIZE - 1
    begin = np.cumsum(sizes) - sizes
    string = np.repeat(np.arange(len(counts)), counts)
    nth = np.arange(len(string)) - np.repeat(np.cumsum(counts) - counts, counts)
    kind = sorted_classes(ids, begin[string] + nth)
    document, digest, word = (o[string] for o in owners)
    word = word + nth
    order = np.lexsort((word, digest, document, kind))
    head = np.flatnonzero(np.append(True, np.diff(kind[order]) > 0)) if len(order) else np.zeros(0, np.int64)
    lowest = np.repeat(order[head], np.diff(head, append=len(order)))
    # An equal window at the same place is this one, told by a repeated row.
    later = (document[order] != document[lowest]) | (digest[order] != digest[lowest]) | (word[order] != word[lowest])
    bits = np.zeros(len(counts), np.uint32)
    np.bitwise_or.at(bits, string[order[later]], np.uint32(1) << nth[order[later]].astype(np.uint32))
    return bits


# ---- blocks -------------------------------------------------------------------------------------


class _Block:
    """The documents of one block, in an order that every pass finds again."""

    def __init__(self, rows):
        rows = rows.combine_chunks()
        rows = rows.take(pc.sort_indices(rows, [("doc_id", "ascending"), ("raw", "ascending")]))
        self.doc_ids, texts = rows["doc_id"], rows["raw"].to_pylist()
        self.words = Words(texts)
        self.first, self.count, self.key, self.again = self.words.super_kmers()
        self.ids = pc.fill_null(self.doc_ids, _LAST).to_numpy()
        digests = [hashlib.blake2b(t, digest_size=8).digest() for t in texts]
        self.digests = np.frombuffer(b"".join(digests), np.int64)
        del texts

    def owner(self, first):
        """Id, digest and place in the text of the words `first`."""
        document = np.searchsorted(self.words.edges, first, side="right") - 1
        return self.ids[document], self.digests[document], first - self.words.edges[document]

    def sent(self, keys, crowded):
        """Super-k-mers (single windows of crowded minimisers) of the given minimisers, each different
        string once with its first occurrence: (first, count, class) of all, and per class its
        string, bucket hash and first occurrence."""
        order = np.argsort(keys)
        keys, crowded = keys[order], crowded[order]
        spot = np.minimum(np.searchsorted(keys, self.key), max(0, len(keys) - 1))
        kept = np.flatnonzero(keys[spot] == self.key) if len(keys) else np.zeros(0, np.int64)
        first, count, key = self.first[kept], self.count[kept], self.key[kept]
        alone = crowded[spot[kept]] if len(keys) else np.zeros(0, bool)
        if alone.any():
            n = count[alone]
            single = np.repeat(first[alone], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hashes = np.zeros(len(single), np.uint64)
            for k in range(SIZE):
                hashes = hashes * np.uint64(_BASE) + self.words.hashes[single + k]
            first, count = np.append(first[~alone], single), np.append(count[~alone], np.ones(len(single), np.int64))
            key = np.append(key[~alone], _mix(hashes))
        document, digest, word = self.owner(first)
        order = np.lexsort((word, digest, document))
        first, count, key = first[order], count[order], key[order]
        classes, kinds, heads = {}, np.empty(len(first), np.int64), []
        for k, string in enumerate(self.words.strings(first, count)):
            kind = classes.setdefault(string, len(heads))
            if kind == len(heads):
                heads.append(k)
            kinds[k] = kind
        return (first, count, kinds), list(classes), key[heads], np.array(heads, np.int64)


def _by_bucket(keys, buckets):
    """Numbers of the classes of each bucket that has any: (bucket, class numbers)."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.append(True, np.diff(bucket[order]) > 0)) if len(order) else []
    return [(int(bucket[part[0]]), part) for part in np.split(order, edges[1:])] if len(order) else []


def _write_blocks(docs, block_bytes):
    """doc_id, raw, block: a table bucketed by block, read without a shuffle, and its name."""
    spark = docs.sparkSession

    def cut(batches):
        number, size = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            blocks = []
            for n in pc.binary_length(batch[1]).to_pylist():
                blocks.append(number)
                size += n
                if size >= block_bytes:
                    number, size = number + 1, 0
            yield pa.record_batch([*batch.columns, pa.array(blocks, pa.int64())], names=[*batch.schema.names, "block"])

    path = new_folder(spark, "blocks")
    name = "windows_" + path.rsplit("-", 1)[-1]
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.mapInArrow(cut, "doc_id long, raw binary, block long")
    rows.repartition(width, "block").write.option("path", path).option("compression", "zstd").bucketBy(width, "block").saveAsTable(name)
    return spark.table(name), name


def _table(rows, names, **types):
    found = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table({n: pa.array(v, types.get(n, pa.int64())) for n, v in zip(names, found, strict=True)})


def repeated(docs, id="doc_id", text="text", block_bytes=BLOCK_BYTES, bucket_bytes=BUCKET_BYTES, crowded=CROWDED):
    """doc_id, n_words, n_removed, kept_sha256 of every row, written to the shared folder.

    A word goes if a SIZE-word window over it also starts earlier: in a document with a smaller id,
    or earlier in its own. A null text has no words. A null id is larger than any other; rows of one
    id come in the order of a digest of their texts, and rows equal in id and text are one document,
    so all keep or lose the same words. An empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = columns(docs, doc_id=id, raw=text).select(F.col("doc_id").cast("long"), F.coalesce(F.col("raw").cast("binary"), F.lit(b"")).alias("raw"))
    blocks, name = _write_blocks(rows, block_bytes)
    try:
        return settle(_repeated(blocks, bucket_bytes, crowded), "windows")
    finally:
        spark.sql(f"drop table {name}")  # the catalog's entry; the files stay with the shared folder


def _repeated(blocks, bucket_bytes, crowded):
    total = blocks.agg(F.coalesce(F.sum(F.length("raw")), F.lit(0))).head()[0]
    buckets = max(8, math.ceil(total / bucket_bytes))

    def tell(rows):
        enter("windows")
        block = _Block(rows)
        keys, kind = np.unique(block.key, return_inverse=True)
        times = np.bincount(kind, weights=1 + block.again, minlength=len(keys))
        number = np.full(len(keys), rows["block"][0].as_py())
        return pa.table([pa.array(keys.view(np.int64)), pa.array(number), pa.array(times.astype(np.int32))], names=["key", "block", "times"])

    told = settle(blocks.groupBy("block").applyInArrow(tell, "key long, block long, times int"), "minimisers")
    again = told.groupBy("key").agg(F.sum("times").alias("n")).where("n > 1").select("key", (F.col("n") > crowded).alias("crowded"))
    shared = settle(told.select("key", "block").join(again, "key").select("block", "key", "crowded"), "shared")

    def known(rows):
        return rows["key"].to_numpy().view(np.uint64), rows["crowded"].to_numpy(zero_copy_only=False)

    def send(key, rows, keys):
        enter("windows")
        if not rows.num_rows or not keys.num_rows:
            return _table([], ["bucket", "block", "value"], value=pa.binary())
        block, out = _Block(rows), []
        (first, count, _), strings, hashes, heads = block.sent(*known(keys))
        owners = block.owner(first[heads])
        for bucket, part in _by_bucket(hashes, buckets):
            own = [strings[k] for k in part.tolist()]
            value = packed(count[heads[part]].astype(np.uint8), *(o[part] for o in owners), np.frombuffer(b"\n".join(own), np.uint8))
            out.append((bucket, key[0].as_py(), value))
        return _table(out, ["bucket", "block", "value"], value=pa.binary())

    def meet(rows):
        enter("windows")
        values = [unpacked(v.as_py()) for v in rows["value"]]
        counts, *owners = (np.concatenate([v[k] for v in values]) for k in range(4))
        strings = b"\n".join(v[4].tobytes() for v in values).split(b"\n")
        bits, at, out = first_bits(strings, counts.astype(np.int64), owners), 0, []
        for block, v in zip(rows["block"].to_pylist(), values, strict=True):
            out.append((rows["bucket"][0].as_py(), block, packed(bits[at : at + len(v[0])])))
            at += len(v[0])
        return _table(out, ["bucket", "block", "value"], value=pa.binary())

    kind = "bucket long, block long, value binary"
    sent = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(send, kind)
    met = sent.groupBy("bucket").applyInArrow(meet, kind)
    empty = F.lit(None)
    back = shared.select("block", "key", "crowded", empty.cast("long").alias("bucket"), empty.cast("binary").alias("value")).unionByName(
        met.select("block", empty.cast("long").alias("key"), empty.cast("boolean").alias("crowded"), "bucket", "value")
    )

    def mark(key, rows, answers):
        enter("windows")
        block = _Block(rows)
        words = block.words
        cover = np.zeros(len(words.hashes) + 1, np.int32)
        if answers.num_rows:
            of_keys = pc.is_valid(answers["key"])
            (first, count, kinds), _, hashes, heads = block.sent(*known(answers.filter(of_keys)))
            told = answers.filter(pc.invert(of_keys))
            bits = np.zeros(len(heads), np.uint32)
            found = dict(zip(told["bucket"].to_pylist(), told["value"].to_pylist(), strict=True))
            for bucket, part in _by_bucket(hashes, buckets):
                bits[part] = unpacked(found[bucket])[0]
            # All but a string's first occurrence in the block have an earlier one there; rows equal
            # in id and text are the same place.
            own, lead = block.owner(first), [o[kinds] for o in block.owner(first[heads])]
            later = np.logical_or.reduce([a != b for a, b in zip(own, lead, strict=True)])
            for k in range(WINDOWS):
                gone = first[(k < count) & (later | (bits[kinds] >> np.uint32(k) & np.uint32(1)).astype(bool))] + k
                np.add.at(cover, gone, 1)
                np.add.at(cover, gone + SIZE, -1)
        kept = np.cumsum(cover)[:-1] == 0
        out, ends = [], np.append(0, words.stop + 1)
        for k, (a, b) in enumerate(zip(words.edges[:-1].tolist(), words.edges[1:].tolist(), strict=True)):
            left = words.text[int(ends[a]) : int(ends[b])][:-1]
            n = b - a - int(np.count_nonzero(kept[a:b]))
            if n:
                left = b" ".join(compress(left.split(b" "), kept[a:b].tolist()))
            out.append((block.doc_ids[k].as_py(), b - a, n, hashlib.sha256(left).hexdigest()))
        return _table(out, ["doc_id", "n_words", "n_removed", "kept_sha256"], kept_sha256=pa.string())

    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(mark, "doc_id long, n_words long, n_removed long, kept_sha256 string")
