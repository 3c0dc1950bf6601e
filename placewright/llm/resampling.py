"""Importance resampling towards a target distribution, with features counted once per distinct line.

Features are runs of one and two words, hashed into BUCKETS. Newlines separate words, so a text's
features are those inside its lines and the two-word runs that cross from one line to the next that
has a word. Lines repeat (notices, menus, copies), so:

1. all texts are cut into lines, and equal lines become one row with their number of occurrences;
2. the features of each distinct line are counted once and taken that many times;
3. runs across lines are counted apart, over whole texts;
4. what a bucket gains by the target's share against the corpus's is one whole number per bucket;
5. a document's weight is the mean gain of its features; its score adds Gumbel noise drawn from its
   id, so that the highest scores are a sample without replacement in proportion to exp(weight / 1000).

Counts leave a task as one row per bucket at most. Equal lines are combined before and after the
shuffle, so a line in a third of all documents is one row per task. Ranks come from a range sort.
"""

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators.ordering import number_rows
from .common import columns, enter, settle

BUCKETS = 10_000
SEED = 7
LEAST_WORDS = 20
SHARE = 25  # per cent of the documents with LEAST_WORDS words
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LONG = 32  # longer words are hashed one by one
_PART = 1 << 20  # bytes of text worked on at once


def _crc_table():
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _crcs(raw, start, length, before=None):
    """CRC-32 of raw[start : start + length] for every word, going on from the checksums `before`."""
    state = np.zeros(len(start), np.uint32) if before is None else before
    state = state ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-length, kind="stable")
    sorted_length = -length[order]
    state, begin = state[order], start[order]
    n_long = int(np.searchsorted(sorted_length, -_LONG))
    for k in range(n_long):
        a = int(begin[k])
        first = zlib.crc32(raw[a : a + int(length[order[k]])].tobytes(), int(state[k] ^ np.uint32(0xFFFFFFFF)))
        state[k] = np.uint32(first) ^ np.uint32(0xFFFFFFFF)
    for k in range(_LONG):
        stop = int(np.searchsorted(sorted_length, -k))  # words of more than k bytes
        if stop <= n_long:
            break
        part = slice(n_long, stop)
        state[part] = _CRC[(state[part] ^ raw[begin[part] + k]) & np.uint32(0xFF)] ^ (state[part] >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


_SPACE = np.uint32(zlib.crc32(b" "))


def _after_space(state):
    """CRC-32 after one more byte, a space."""
    state = state ^ np.uint32(0xFFFFFFFF)
    return _CRC[(state ^ np.uint32(32)) & np.uint32(0xFF)] ^ (state >> np.uint32(8)) ^ np.uint32(0xFFFFFFFF)


def features(texts, seams_only=False):
    """Buckets of all features of some texts: (words per text, text of each feature, bucket, crosses lines).

    texts: bytes of each text. seams_only gives the two-word runs that cross lines alone.
    """
    n = len(texts)
    raw = _FOLD[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]  # a newline after every text
    edge = np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, n) + 1))
    inside = _WORD[raw]
    change = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, stop = change[::2], change[1::2]
    text = np.searchsorted(edge, start, side="right") - 1
    words = np.bincount(text, minlength=n)
    line = np.searchsorted(np.flatnonzero(raw == 10), start)
    follows = np.flatnonzero(text[1:] == text[:-1])  # word k and k + 1 are a run
    crosses = line[follows] != line[follows + 1]
    if seams_only:
        follows, crosses = follows[crosses], crosses[crosses]
        used = np.unique(np.append(follows, follows + 1))
        single = np.zeros(len(start), np.uint32)
        single[used] = _crcs(raw, start[used], (stop - start)[used])
    else:
        single = _crcs(raw, start, stop - start)
    pair = _crcs(raw, start[follows + 1], (stop - start)[follows + 1], _after_space(single[follows]))
    modulo = np.uint32(BUCKETS)
    if seams_only:
        return words, text[follows], (pair % modulo).astype(np.int64), crosses
    owner = np.concatenate([text, text[follows]])
    bucket = np.concatenate([single % modulo, pair % modulo]).astype(np.int64)
    return words, owner, bucket, np.concatenate([np.zeros(len(text), bool), crosses])


def _parts(values):
    """Slices of some bytes values, each of about _PART bytes."""
    part, size = [], 0
    for value in values:
        part.append(value)
        size += len(value)
        if size >= _PART:
            yield part
            part, size = [], 0
    if part:
        yield part


def _raw(column):
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def _told(counts):
    there = np.flatnonzero(counts)
    return pa.record_batch([pa.array(there), pa.array(counts[there])], names=["bucket", "n"])


def bucket_counts(texts):
    """bucket, n: the features of column `text` over all rows; at most BUCKETS rows.

    Distinct lines are counted once and multiplied by their occurrences; runs that cross lines apart.
    """
    said = F.translate("text", _UPPER, _LOWER)
    lines = texts.where("text <> ''").select(F.explode(F.split(said, "\n", -1)).alias("line")).where("line <> ''")
    distinct = lines.groupBy("line").agg(F.count("*").alias("times"))

    def of_lines(batches):
        enter("resampling")
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            times, at = batch[1].to_numpy(), 0
            for part in _parts(_raw(batch[0])):
                _, owner, bucket, _ = features(part)
                # Line by line in whole numbers: floats of bincount's weights end at 2 ** 53.
                np.add.at(counts, bucket, times[at : at + len(part)][owner])
                at += len(part)
        yield _told(counts)

    def of_seams(batches):
        enter("resampling")
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in _parts(_raw(batch[0])):
                counts += np.bincount(features(part, seams_only=True)[2], minlength=BUCKETS)
        yield _told(counts)

    kind = "bucket long, n long"
    crossing = texts.where("instr(text, '\n') > 0").select("text").mapInArrow(of_seams, kind)
    return distinct.mapInArrow(of_lines, kind).unionByName(crossing).groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(counts):
    found, out = counts.toArrow(), np.zeros(BUCKETS, np.int64)  # at most BUCKETS rows
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(source, target):
    """Per bucket: 1000 times the log of the target's smoothed share over the source's, rounded down."""
    all_source, all_target = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * all_source / ((float(s) + 1) * all_target))) for s, t in zip(source, target, strict=True)], np.int64)


def noise(id, seed=SEED):
    """Gumbel noise in thousandths, from the id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs, gain, id="doc_id", text="text", seed=SEED):
    """doc_id, n_words, n_features, weight, score of every row, by the gains of its features."""
    rows = columns(docs, doc_id=id, text=text)
    shared = docs.sparkSession.sparkContext.broadcast(np.asarray(gain))  # BUCKETS numbers

    def score(batches):
        enter("resampling")
        gain = shared.value
        for batch in batches:
            found = []
            for part in _parts(_raw(batch[1])):
                words, owner, bucket, _ = features(part)
                total = np.zeros(len(part), np.int64)
                np.add.at(total, owner, gain[bucket])
                found.append((words, total))
            words, total = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 2
            number = np.maximum(2 * words - 1, 0)
            weight = total // np.maximum(number, 1)
            own = np.array([noise(d, seed) for d in batch[0].to_pylist()], np.int64)
            yield pa.record_batch([batch[0], *map(pa.array, (words, number, weight, weight + own))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long, score long")


def resample(docs, target, id="doc_id", text="text", target_text="text", share=SHARE, least_words=LEAST_WORDS, seed=SEED):
    """doc_id, n_features, weight, score, rank of every row; rank (1, 2, 3...) where the row is drawn.

    Of the N rows with least_words words, floor(share * N / 100) are drawn: the highest scores, ties
    to the smaller id (null last), then in any order. A null text has no words; a null id draws its
    noise from the empty string. Repeated rows count and are drawn one by one. An empty table gives
    no rows, an empty target leaves the corpus's counts alone. Extra columns are ignored.
    """
    source = _dense(bucket_counts(columns(docs, text=text)))
    wanted = _dense(bucket_counts(columns(target, text=target_text)))
    scored = settle(weigh(docs, gains(source, wanted), id, text, seed), "scores")
    enough = F.col("n_words") >= least_words
    drawn = scored.where(enough).count() * share // 100
    # The last key is unique and read from a written table, so a crowded score still splits.
    order = [F.when(enough, 0).otherwise(1), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("at")]
    placed = number_rows(scored.withColumn("at", F.monotonically_increasing_id()), order)
    rank = F.when(enough & (F.col("position") <= drawn), F.col("position").cast("long")).alias("rank")
    return placed.select("doc_id", "n_features", "weight", "score", rank)
