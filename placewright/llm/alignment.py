"""Alignment of two tokenizers over the same bytes, by diagonal run skipping, and corpus counts of linked ids.

Both tokenizations of a text are lists of byte ends. While tokens correspond one to one, end k of
one list equals end k + shift of the other: from where a walk stands it compares ends at that shift
over stretches that double as long as they agree and halve after the first that doesn't, and so
jumps to the end of the one-to-one run. What follows is an irregular group: it is walked end by end
until both sides end together, which links each overlapping pair once and gives the next shift.

Tokens are looked up by space-delimited units (`Pair`), which both tokenizers encode alone; other
texts are encoded whole. Tasks write one row per block of documents: its different id pairs with
the number of documents that hold each, and each document's links as numbers into that list. Pair
counts are summed over blocks in Spark, joined back to the blocks that hold the pair, and a block
settles its own documents. A frequent pair is one row per block, joins may split it, and nothing
that grows with the number of pairs is broadcast or collected.
"""

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns, enter, settle
from .passages import _packed as packed
from .passages import _unpacked as unpacked

BLOCK_LINKS = 4_000_000  # a block ends with the part that reaches so many links
_PART = 1 << 19  # bytes of text aligned at once
_UNITS = 400_000  # at so many units the memory becomes the older half, and the half before it goes
_ODD = re.compile(r"\s")
_MARK = "▁"  # a piece's sign for a space
_PAIR = np.uint64(32)  # a pair is one number: the first id above this bit, the second below


def byte_letters():
    """The letter that byte-level BPE writes for each byte: printable ones stand for themselves."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """Ids of a text under two tokenizers: byte-level BPE of space + text, and pieces, which add the space."""

    def __init__(self, first, second):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True  # their strings in a text are plain text
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        letters = byte_letters()
        names = [self.first.id_to_token(k) or "" for k in range(self.first.get_vocab_size())]
        self.bytes_a = [bytes(letters[c] for c in n) if all(c in letters for c in n) else n.encode() for n in names]
        pieces = [self.second.id_to_piece(k) for k in range(self.second.get_piece_size())]
        is_byte = self.second.is_byte
        self.bytes_b = [bytes([int(p[3:5], 16)]) if is_byte(k) else p.replace(_MARK, " ").encode() for k, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in part], np.int64) for part in (self.bytes_a, self.bytes_b))
        self.added = [t.content for t in self.first.get_added_tokens_decoder().values() if not t.special]
        self.newline = self.first.encode("\n", add_special_tokens=False).ids
        space = self.second.encode("\n")
        # Units can be encoded alone if no piece reaches over a space or newline.
        self.separable = (
            not self.added
            and len(self.newline) == 1
            and len(space) == 2
            and pieces[space[0]] == _MARK
            and not any(_MARK in p.lstrip(_MARK) or "\n" in p for p in pieces)
        )
        own = [f"{k}{end}" for k in range(len(self.bytes_a)) for end in ",|"]
        self.said = np.array(own + [f"{k}{end}" for k in range(len(self.bytes_b)) for end in ",;"], dtype=object)
        self.seen, self.before = {}, {}

    def joined(self, ids, which):
        return b"".join(map(which.__getitem__, ids))

    def _learn(self, units):
        """Keep both sides' ids of unseen units; False marks a unit that can't be encoded alone."""
        bad = [u for u in units if u in ("", "\n") or _ODD.search(u, 1) or (u[0] != "\n" and u[0].isspace())]
        self.seen.update((u, False) for u in bad)
        units = [u for u in units if u not in self.seen]
        forms = [u[1:] if u[0] == "\n" else " " + u for u in units]
        first = self.first.encode_batch_fast(forms, add_special_tokens=False)
        for unit, a, b in zip(units, first, self.second.encode(units, num_threads=1), strict=True):
            a, raw = a.ids, (" " + unit).encode()
            if unit[0] == "\n":
                a, b, raw = self.newline + a, b[1:], raw[1:]
            exact = self.joined(a, self.bytes_a) == raw and self.joined(b, self.bytes_b) == raw
            self.seen[unit] = exact and (np.array(a, np.uint32).tobytes(), np.array(b, np.uint32).tobytes())

    def whole(self, text):
        """Both sides' ids of a text; none if their bytes are not those of space + text."""
        a, b = self.first.encode(" " + text, add_special_tokens=False).ids, self.second.encode(text)
        raw = (" " + text).encode()
        exact = self.joined(a, self.bytes_a) == raw and self.joined(b, self.bytes_b) == raw
        return [np.array(x if exact else [], np.uint32).tobytes() for x in (a, b)]

    def encode(self, texts):
        """Per text the ids of both sides as bytes of uint32; none for a null or empty text."""
        if len(self.seen) > _UNITS:
            self.before, self.seen = self.seen, {}
        parts = [t.replace("\n", " \n").split(" ") if t and self.separable else [] for t in texts]
        needed = set().union(*parts) - self.seen.keys()
        again = needed & self.before.keys()
        self.seen.update((u, self.before[u]) for u in again)
        self._learn(list(needed - again))
        out = []
        for text, units in zip(texts, parts, strict=True):
            known = [self.seen[u] for u in units]
            if not text:
                out.append([b"", b""])
            elif not units or False in known:
                out.append(self.whole(text))
            else:
                out.append([b"".join(side) for side in zip(*known, strict=True)])
        return out


def walk(a, b):
    """Diagonal run skipping over two ascending lists of ends with the same last one.

    Returns rows (start, start of the other side, one-to-one run, then tokens of the irregular group
    on either side) and the two lists of linked positions inside irregular groups.
    """
    n, i, j = len(a), 0, 0
    rows, left, right = [], [], []
    while i < n:
        start, other, step, grows = i, j, 1, True
        while step:
            probe = a[i : i + step]
            if probe and probe == b[j : j + step]:
                i, j = i + len(probe), j + len(probe)
                step = 2 * step if grows else step // 2
            else:
                grows, step = False, step // 2
        run, at, beside = i - start, i, j
        if i < n:
            x, y = a[i], b[j]
            while x != y:
                left.append(i)
                right.append(j)
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            left.append(i)
            right.append(j)
            i, j = i + 1, j + 1
        rows.append((start, other, run, i - at, j - beside))
    return rows, left, right


def _spread(starts, counts):
    """starts[k], starts[k] + 1, ... counts[k] numbers each."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def align(pair, texts):
    """Documents of some texts aligned: (n_a, n_b, n_groups, n_links, groups) and links (document, id pair)."""
    sides = pair.encode(texts)
    n = len(texts)
    ids_a, ids_b = (np.frombuffer(b"".join(s[k] for s in sides), np.uint32).astype(np.int64) for k in (0, 1))
    edge_a, edge_b = (np.append(0, np.cumsum([len(s[k]) // 4 for s in sides])).astype(np.int64) for k in (0, 1))
    # The documents follow one another: each ends on both sides at once, so one walk takes them all.
    ends = [np.cumsum(pair.sizes_a[ids_a]), np.cumsum(pair.sizes_b[ids_b])]
    rows, left, right = walk(ends[0].tolist(), ends[1].tolist())
    start, other, run, more_a, more_b = np.array(rows, np.int64).reshape(-1, 5).T
    left, right = np.append(_spread(start, run), np.array(left, np.int64)), np.append(_spread(other, run), np.array(right, np.int64))
    # Where each group ends on either side: after every token of a run, and after the irregular group.
    odd = np.flatnonzero(more_a)
    last_a = np.sort(np.append(_spread(start, run), (start + run + more_a - 1)[odd]))
    last_b = np.sort(np.append(_spread(other, run), (other + run + more_b - 1)[odd]))
    group_a, group_b = np.searchsorted(last_a, np.arange(len(ids_a))), np.searchsorted(last_b, np.arange(len(ids_b)))
    # Groups written one after the other, first side before the second.
    codes = np.empty(len(ids_a) + len(ids_b), np.int64)
    is_last = np.zeros(len(ids_a), np.int64)
    is_last[last_a] = 1
    codes[np.arange(len(ids_a)) + np.append(0, last_b + 1)[group_a]] = 2 * ids_a + is_last
    is_last = np.zeros(len(ids_b), np.int64)
    is_last[last_b] = 1
    codes[np.arange(len(ids_b)) + (last_a + 1)[group_b]] = 2 * (len(pair.bytes_a) + ids_b) + is_last
    said = pair.said[codes].tolist()
    spots = (edge_a + edge_b).tolist()
    groups = ["".join(said[x:y])[:-1] for x, y in zip(spots[:-1], spots[1:], strict=True)]
    document = np.searchsorted(edge_a, left, side="right") - 1
    n_groups = np.bincount(np.searchsorted(edge_a, last_a, side="right") - 1, minlength=n)
    counts = (np.diff(edge_a), np.diff(edge_b), n_groups, np.bincount(document, minlength=n))
    return counts, groups, document, ids_a[left].astype(np.uint64) << _PAIR | ids_b[right].astype(np.uint64)


class _Block:
    """Aligned documents until their links are many; `close` makes the block's row."""

    def __init__(self):
        self.ids, self.counts, self.digests, self.links, self.size = [], [], [], [], 0

    def add(self, ids, pair, texts):
        counts, groups, document, links = align(pair, texts)
        # Different pairs of each document, with how often it has them.
        order = np.lexsort((links, document))
        document, links = document[order], links[order]
        new = np.flatnonzero(np.append(True, (document[1:] != document[:-1]) | (links[1:] != links[:-1]))) if len(links) else np.zeros(0, np.int64)
        times = np.diff(new, append=len(links))
        sizes = np.bincount(document[new], minlength=len(ids))
        self.ids += ids
        self.counts.append(np.stack([*counts, sizes]))
        self.digests += [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
        self.links.append((links[new], times.astype(np.uint32)))
        self.size += len(links)

    def close(self, number, kind):
        links, times = (np.concatenate(x) for x in zip(*self.links, strict=True))
        pairs, index, held = np.unique(links, return_inverse=True, return_counts=True)
        counts = np.concatenate(self.counts, axis=1)
        values = (packed(*counts), packed(np.diff(pairs, prepend=np.uint64(0)), held.astype(np.uint32)), packed(index.astype(np.uint32), times))
        arrays = [pa.array([number], pa.int64()), pa.array([self.ids], pa.list_(kind)), pa.array([self.digests], pa.list_(pa.string())), *(pa.array([v], pa.binary()) for v in values)]
        return pa.record_batch(arrays, names=["block", "doc_id", "digests", "counts", "pairs", "links"])


def link_blocks(docs, first, second, id="doc_id", text="text", block_links=BLOCK_LINKS):
    """One row per block of aligned documents: block, ids, digests, and packed counts, pairs and links."""
    rows = columns(docs, doc_id=id, text=text)

    def aligned(batches):
        pair = _pair(first, second)
        number, block = TaskContext.get().partitionId() << 24, _Block()
        for batch in batches:
            kind = batch.schema.types[0]
            ids, texts, at, size = batch[0].to_pylist(), batch[1].to_pylist(), 0, 0
            for k, t in enumerate(texts):
                size += len(t or "")
                if size >= _PART or k + 1 == len(texts):
                    block.add(ids[at : k + 1], pair, texts[at : k + 1])
                    at, size = k + 1, 0
                    if block.size >= block_links:
                        yield block.close(number, kind)
                        number, block = number + 1, _Block()
        if block.ids:
            yield block.close(number, kind)

    schema = T.StructType().add("block", "long").add("doc_id", T.ArrayType(rows.schema["doc_id"].dataType)).add("digests", T.ArrayType(T.StringType()))
    for name in ("counts", "pairs", "links"):
        schema.add(name, "binary")
    return rows.mapInArrow(aligned, schema)


_pairs = {}


def _pair(first, second):
    enter("alignment", _pairs.clear)
    if (first, second) not in _pairs:
        _pairs[first, second] = Pair(first, second)
    return _pairs[first, second]


def pair_counts(blocks):
    """(block, pair, held) of every block, and (pair, n, best) over all: n documents hold the pair;
    best: no other pair of its first id is held by more."""

    def told(batches):
        for batch in batches:
            for block, value in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                pairs, held = unpacked(value)
                pairs = np.cumsum(pairs, dtype=np.uint64).view(np.int64)
                yield pa.record_batch([pa.array(np.full(len(pairs), block)), pa.array(pairs), pa.array(held.astype(np.int64))], names=["block", "pair", "held"])

    rows = blocks.select("block", "pairs").mapInArrow(told, "block long, pair long, held long")
    counts = settle(rows.groupBy("pair").agg(F.sum("held").alias("n")), "pairs")
    first = F.shiftrightunsigned("pair", 32)
    highest = counts.groupBy(first.alias("first")).agg(F.max("n").alias("most"))
    return rows, counts.join(highest, first == F.col("first")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def links(docs, first, second, id="doc_id", text="text", block_links=BLOCK_LINKS):
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    first: a byte-level BPE file of the tokenizers library, given space + text; second: a
    sentencepiece model, which adds the space. A text that is null, empty, or whose tokens of either
    side don't spell space + text has no tokens: zeros and an empty groups_sha256. Rows are documents
    of their own: repeated ids and texts count each. An empty table gives no rows; extra columns are
    ignored.
    """
    blocks = settle(link_blocks(docs, first, second, id, text, block_links), "aligned")
    rows, counts = pair_counts(blocks)
    answers = rows.select("block", "pair").join(counts, "pair")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def settled(key, block, answers):
        enter("alignment_counts")
        ids, digests = block["doc_id"].combine_chunks().values, block["digests"].combine_chunks().values
        n_a, n_b, n_groups, n_links, sizes = unpacked(block["counts"][0].as_py())
        index, times = unpacked(block["links"][0].as_py())
        order = np.argsort(answers["pair"].to_numpy().view(np.uint64))  # the block's own order of its pairs
        n, best = answers["n"].to_numpy()[order], answers["best"].to_numpy(zero_copy_only=False)[order]
        edge = np.append(0, np.cumsum(sizes))
        held = [np.append(0, np.cumsum(times * x[index])) for x in (best.astype(np.int64), n)]
        n_best, count_sum = (h[edge[1:]] - h[edge[:-1]] for h in held)
        return pa.table([ids, *map(pa.array, (n_a, n_b, n_groups, n_links, n_best, count_sum)), digests], names=names)

    schema = T.StructType([T.StructField("doc_id", blocks.schema["doc_id"].dataType.elementType)])
    for name in names[1:-1]:
        schema.add(name, "long")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(settled, schema.add("groups_sha256", "string"))
