"""Best-fit packing by bin completion with branch and bound.

Only how many pieces there are of each length matters for how many sequences are needed, so the
search runs over counts of at most CAPACITY lengths, whatever the corpus's size. A best-fit packing
comes first and is the one to beat. Then the largest piece left opens a sequence, and its undominated
fillings, of any number of pieces, are tried in order of waste; a filling is dominated if other
pieces at hand can take the place of some of its own without loss. A choice is used as often as the
counts allow, and on the way back less often. A branch ends when its waste so far leaves no room for
fewer sequences than the best packing known. The search stops at the lower bound, or where its
stated amount of work is done: bin packing has no quick exact way. The plan says for each length
which ranks go where, and pieces are numbered within their length in Spark.
"""

import zlib
from bisect import bisect_right
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns, enter, settle
from .tokens import END, encoder

CAPACITY = 2048
NODES = 5_000  # choices of the search; the packing is whole and valid wherever it stops
STEPS = 1_000_000  # pieces looked at while fillings are enumerated, over the whole search


def lower_bound(counts, capacity):
    """The least number of sequences, by total length and by pieces that can't share (Martello and Toth's L2)."""
    lengths = np.arange(len(counts))
    number, size = np.cumsum(counts), np.cumsum(counts * lengths)
    best = -(-int(size[-1]) // capacity)
    for k in range(capacity // 2 + 1):
        half, top = capacity // 2, capacity - k
        alone = number[-1] - number[min(top, len(counts) - 1)]
        large, large_size = number[min(top, len(counts) - 1)] - number[half], size[min(top, len(counts) - 1)] - size[half]
        small = size[half] - (size[k - 1] if k else 0)
        best = max(best, int(alone + large + max(0, -(-int(small - (large * capacity - large_size)) // capacity))))
    return best


def best_fit(counts, capacity):
    """Best-fit decreasing over counts: patterns (lengths of one sequence, times used)."""
    rooms, done = {}, []  # room left -> {lengths: sequences}
    for n in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[n])
        while left:
            room = min((r for r in rooms if r >= n), default=None)
            if room is None:
                # Fresh sequences, each filled with pieces of this length before the next is opened.
                most = capacity // n
                for copies, times in ((most, left // most), (left % most, 1)):
                    if copies and times:
                        into = rooms.setdefault(capacity - copies * n, {})
                        into[(n,) * copies] = into.get((n,) * copies, 0) + times
                break
            lengths, times = next(iter(rooms[room].items()))
            used = min(left, times)
            if used == times:
                del rooms[room][lengths]
                if not rooms[room]:
                    del rooms[room]
            else:
                rooms[room][lengths] = times - used
            into = rooms.setdefault(room - n, {})
            into[(*lengths, n)] = into.get((*lengths, n), 0) + used
            left -= used
    for kinds in rooms.values():
        done += kinds.items()
    return done


class _Work:
    """What is left of the stated amount of work."""

    def __init__(self, steps):
        self.steps = steps


def reachable(counts, capacity):
    """Per length the sums that pieces of at most this length can make in any number, as bits."""
    sums, reached, limit = {}, 1, (1 << (capacity + 1)) - 1
    for n in np.flatnonzero(counts).tolist():
        step = n
        while step <= capacity:
            reached |= (reached << step) & limit
            step *= 2
        sums[n] = reached
    return sums


def _spread(bits, more):
    """Bits moved up by 0, 1, ... more places."""
    covered = 0
    while 2 * covered + 1 <= more:
        bits |= bits << (covered + 1)
        covered = 2 * covered + 1
    return bits | bits << (more - covered)


def fillings(counts, room, work=None):
    """Undominated fillings of `room` from the counted lengths, least waste first, one after the other.

    A filling is dominated if a piece at hand fits where some of its pieces (or only room) are: with
    waste w, a piece at hand of s to s + w tokens in place of pieces of s in all. A piece of exactly
    the room dominates all others.
    """
    work = work or _Work(STEPS)
    there = np.flatnonzero(counts[: room + 1]).tolist() if room > 0 else []
    if not there:
        yield ()
        return
    if there[-1] == room:
        yield (room,)
        return
    sums = reachable(counts[: room + 1], room)  # of what is left now: used-up lengths would mislead
    left = {n: int(counts[n]) for n in there}
    at_hand = sum(1 << n for n in there)
    chosen = []

    def grow(rest, top, several, single, at_hand):
        """Fillings of exactly `rest` more with pieces of there[: top + 1]; several and single are the
        sums of two or more chosen pieces, and of one, as bits; at_hand the lengths left."""
        if not rest:
            yield several, single, at_hand
            return
        # A piece takes all of the rest, or leaves room for the smallest piece at least.
        last = bisect_right(there, rest) - 1
        whole = [last] if last <= top and there[last] == rest else []
        for k in chain(whole, range(min(top, bisect_right(there, rest - there[0]) - 1), -1, -1)):
            n = there[k]
            if not sums[n] >> rest & 1:
                return  # smaller pieces make even fewer sums
            if not left[n]:
                continue
            work.steps -= 1
            if work.steps < 0:
                return
            left[n] -= 1
            hand = at_hand if left[n] else at_hand ^ 1 << n
            more = several | (several | single) << n
            # A piece at hand in place of several chosen ones: whatever follows is dominated.
            if not more & hand:
                chosen.append(n)
                yield from grow(rest - n, k, more, single | 1 << n, hand)
                chosen.pop()
            left[n] += 1

    for waste in range(room + 1):
        if work.steps < 0:
            return
        if not sums[there[-1]] >> (room - waste) & 1:
            continue
        for several, single, hand in grow(room - waste, len(there) - 1, 0, 0, at_hand):
            # Equal waste is no gain for a piece in place of one of its own length.
            larger = _spread(several, waste) | (_spread(single << 1 | 2, waste - 1) if waste else 0)
            if not larger & hand:
                yield tuple(chosen)


def plan(counts, capacity=CAPACITY, nodes=NODES, steps=STEPS):
    """(patterns, lower bound): patterns are (lengths of one sequence, times used), covering all counts.

    counts[n] is the number of pieces of n tokens, n = 0..capacity (0 pieces need no room).
    """
    counts = np.asarray(counts, dtype=np.int64).copy()
    fixed = [((capacity,), int(counts[capacity]))] if counts[capacity] else []
    counts[capacity] = counts[0] = 0
    total = int((counts * np.arange(capacity + 1)).sum())
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    fewest, used, work = sum(times for _, times in best), 0, _Work(steps)
    # Depth first; a frame holds the choices still to try at its depth, and what its own choice took.
    stack, path, wasted, sequences = [], [], 0, 0
    state = counts

    def choices(top):
        """(filling, times): every filling as often as it can be used; after these, less often."""
        tried = []
        state[top] -= 1
        offered = fillings(state.copy(), capacity - top, work)
        state[top] += 1
        for filling in offered:
            # Fillings come in order of waste: if one use of this one is too much, so are all others.
            if wasted + capacity - top - sum(filling) > (fewest - 1) * capacity - total:
                break
            kinds, uses = np.unique([top, *filling], return_counts=True)
            times = int((state[kinds] // uses).min())
            tried.append((filling, times))
            yield filling, times
        for filling, times in tried:
            while times > 1:
                times //= 2
                yield filling, times

    def open_frame():
        top = int(np.flatnonzero(state)[-1])
        stack.append((top, choices(top)))

    if total and fewest > bound:
        open_frame()
    while stack:
        top, options = stack[-1]
        if len(path) == len(stack):  # back from below: undo this frame's choice
            filling, times, waste = path.pop()
            np.add.at(state, [top, *filling], times)
            wasted, sequences = wasted - waste, sequences - times
        done = fewest == bound or used >= nodes or work.steps < 0
        filling, times = (None, 0) if done else next(options, (None, 0))
        if filling is None:
            stack.pop()
            continue
        used += 1
        waste = (capacity - top - sum(filling)) * times
        # With fewer sequences than the best known, so much may be wasted in all.
        if wasted + waste > (fewest - 1) * capacity - total:
            path.append((filling, 0, 0))
            continue
        np.subtract.at(state, [top, *filling], times)
        path.append((filling, times, waste))
        wasted, sequences = wasted + waste, sequences + times
        if state.any():
            open_frame()
        elif sequences < fewest:
            fewest = sequences
            best = [((frame[0], *choice[0]), choice[1]) for frame, choice in zip(stack, path, strict=True)]
    return fixed + best, bound + (fixed[0][1] if fixed else 0)


def assignment(patterns):
    """Per length and first rank: copies in a sequence, first sequence, first offset. A few thousand rows."""
    rows, next_rank, sequence = [], {}, 0
    for lengths, times in patterns:
        offset = 0
        kinds = sorted(set(lengths), reverse=True)
        for n in kinds:
            copies = lengths.count(n)
            rank = next_rank.get(n, 0)
            rows.append((n, rank, copies, sequence, offset))
            next_rank[n] = rank + copies * times
            offset += copies * n
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _number(capacity):
    """Adds to batches of pieces (column length) the task and the rank within task and length."""

    def number(batches):
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            order = np.argsort(lengths, kind="stable")
            ordered = lengths[order]
            first = np.searchsorted(ordered, ordered)
            ranks = np.empty(len(lengths), np.int64)
            ranks[order] = np.arange(len(lengths)) - first
            ranks += seen[lengths]
            seen += np.bincount(lengths, minlength=capacity + 1)
            yield pa.record_batch([*batch.columns, pa.array([task] * len(lengths), pa.int64()), pa.array(ranks)], names=[*batch.schema.names, "_task", "_rank"])

    return number


def _fields(schema):
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def place(pieces, capacity=CAPACITY, nodes=NODES):
    """Give each row of `pieces` (column length: 1..capacity) its sequence_id and offset.

    Rows are written once with their number within task and length; counts per task and length
    make that a number within the length, and the plan says where that number goes.
    """
    numbered = pieces.mapInArrow(_number(capacity), _fields(pieces.schema) + ", _task long, _rank long")
    return _place(settle(numbered, "pieces"), capacity, nodes)


def _place(numbered, capacity, nodes):
    kept = [f.name for f in numbered.schema.fields if f.name not in ("_task", "_rank")]
    fields = _fields(numbered.select(*kept).schema)
    sizes = settle(numbered.groupBy("_task", "length").agg(F.count("*").alias("n")), "sizes")
    # At most `capacity` rows come to the driver.
    found = sizes.groupBy("length").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(capacity + 1, np.int64)
    counts[found["length"].to_numpy()] = found["n"].to_numpy()
    patterns, _ = plan(counts, capacity, nodes)
    shared = numbered.sparkSession.sparkContext.broadcast(assignment(patterns))
    earlier = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    # The starts grow with the tasks, so they are merged, not broadcast.
    ranked = numbered.join(starts.hint("merge"), ["_task", "length"]).select(*kept, (F.col("_before") + F.col("_rank")).alias("_rank"))

    def assign(batches):
        enter("packing")
        table = shared.value
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy().astype(np.int64), batch.column("_rank").to_numpy()
            if len(lengths):
                # Rows are sorted by length and rank; the last one at or before (length, rank) applies.
                step = np.int64(1) << 50
                spot = np.searchsorted(table[:, 0] * step + table[:, 1], lengths * step + ranks, side="right") - 1
                _, first, copies, sequence, offset = table[spot].T
                at = ranks - first
                places = [sequence + at // copies, offset + at % copies * lengths]
            else:
                places = [np.zeros(0, np.int64)] * 2
            yield pa.record_batch([*batch.columns[:-1], *map(pa.array, places)], names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(assign, fields + ", sequence_id long, offset long")


def cut(docs, vocabulary, id="doc_id", text="text", capacity=CAPACITY, end=END, with_ids=False, then=None, more=""):
    """Pieces of whole documents: doc_id, piece, start, length, ids_crc32 (and ids).

    Only a document of over `capacity` ids is cut; its pieces hold `capacity` ids each, and the
    first one holds what is over. A null text is empty: a piece of the end id alone. `then` goes on
    with the batches in the same worker and adds the columns of `more`.
    """
    rows = columns(docs, doc_id=id, text=text)

    def pieces(batches):
        encode = encoder(vocabulary)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), []
                for d, ids in zip(part[0].to_pylist(), encode.encode(part[1].to_pylist(), end), strict=True):
                    stops = range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)
                    start = 0
                    for k, stop in enumerate(stops):
                        own = ids[start:stop]
                        out.append((d, k, start, stop - start, zlib.crc32(own.tobytes()), *((own.tolist(),) if with_ids else ())))
                        start = stop
                yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(pieces if then is None else lambda batches: then(pieces(batches)), kind + more)


def pack(docs, vocabulary, id="doc_id", text="text", capacity=CAPACITY, end=END, with_ids=False):
    """The pieces of all documents with their sequence_id and offset.

    Repeated ids and rows are packed like any other; an empty table gives no rows; extra columns
    are ignored.
    """
    numbered = cut(docs, vocabulary, id, text, capacity, end, with_ids, _number(capacity), ", _task long, _rank long")
    return _place(settle(numbered, "pieces"), capacity, NODES)


def sequences(packed):
    """sequence_id, ids of rows from pack(with_ids=True): one bounded group per sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
