"""Languages of a text as a mixture, found by expectation-maximisation over letter trigrams.

A model holds, per language, the probability of each hashed trigram of lower-cased letters (any
other character is a word edge). A text is taken as trigrams drawn from a mix of languages. The
set of languages grows from the single best one: the language whose share would raise the
likelihood fastest joins, EM re-estimates the shares, and it stays if the log-likelihood gains
more than the penalty 0.5 * PENALTY * ln(trigrams). The likelihood is concave in the shares, so its
gradient bounds any gain: texts whose bound is within the penalty need no EM at all.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns, enter

BUCKETS = 1 << 15
SMOOTHING = 0.05  # added to every count
PER_LANGUAGE = 3000  # labelled texts that a language's counts are taken from, on average
PENALTY = 4.0
EM_ROUNDS = 30
_BATCH_CHARS = 400_000  # characters worked on at once; a longer text is a batch of its own
_tables = {}


def _letters():
    """Lower-case code point (0: not a letter) of every code point."""
    if "lower" not in _tables:
        lower = np.zeros(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                lower[c] = ord(low) if len(low) == 1 else c
        _tables["lower"] = lower
    return _tables["lower"]


def grams(texts):
    """Bucket of each letter's trigram, all texts on end, and the number of trigrams per text."""
    codes = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), "<u4")
    codes = _letters()[codes]
    at = np.flatnonzero(codes)
    h = codes[at - 1] * np.uint32(0x9E3779B1) ^ codes[at] * np.uint32(0x85EBCA77) ^ codes[at + 1] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(at, ends, side="right"), prepend=0)
    return (h >> np.uint32(17)).astype(np.int32), counts


def fit(labelled, id="doc_id", text="text", lang="lang", per_language=PER_LANGUAGE):
    """Languages and their log-probabilities, from labelled rows.

    Each language is learnt from about `per_language` of its texts, chosen by a hash of the id at
    the rate per_language / (its rows); all of them if it has fewer. Rows with a null label, text
    or id teach nothing. Returns ([], None) if nothing is left. The result holds
    languages x BUCKETS numbers, whatever the corpus's size.
    """
    rows = columns(labelled, id=id, text=text, lang=lang).where("lang is not null and text is not null and id is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "id"), F.lit(1_000_000)) * F.col("n")
    # One row per language: far below the model's own languages x BUCKETS numbers.
    sample = rows.join(F.broadcast(sizes), "lang").where(draw < per_language * 1_000_000).select("lang", "text")

    def count(batches):
        totals = {}
        for batch in batches:
            for lang, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                found, _ = grams([text])
                totals[lang] = totals.get(lang, 0) + np.bincount(found, minlength=BUCKETS)
        for lang, c in totals.items():
            at = np.flatnonzero(c)
            yield pa.record_batch({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int64()), "n": pa.array(c[at], pa.int64())})

    counts = sample.mapInArrow(count, "lang string, bucket long, n long")
    counts = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counts["lang"].to_pylist()))
    if not names:
        return [], None
    table = np.full((BUCKETS, len(names)), SMOOTHING)
    column = {name: k for k, name in enumerate(names)}
    table[counts["bucket"].to_numpy(), [column[x] for x in counts["lang"].to_pylist()]] += counts["n"].to_numpy()
    return names, np.log(table / table.sum(axis=0)).astype(np.float32)


def _sums(values, starts):
    return np.add.reduceat(values, starts, axis=0)


def mixtures(texts, table):
    """Shares per text and language (all 0 for a text without a letter)."""
    found, counts = grams(texts)
    out = np.zeros((len(texts), table.shape[1]))
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    n = counts[some]
    starts = np.cumsum(n) - n
    logs = table[found]
    best = _sums(logs.astype(np.float64), starts).argmax(axis=1)
    out[some, best] = 1.0
    owner = np.repeat(np.arange(len(some)), n)
    slope = _sums(np.exp(logs - logs[np.arange(len(found)), best[owner]][:, None]), starts) - n[:, None]
    limit = 0.5 * PENALTY * np.log(n)
    slope[np.arange(len(some)), best] = -np.inf
    open_ = np.flatnonzero(slope.max(axis=1) > limit)
    for k in open_.tolist():
        own = found[starts[k] : starts[k] + n[k]]
        kinds, times = np.unique(own, return_counts=True)
        out[some[k]] = _grow(table[kinds].astype(np.float64), times, best[k], limit[k])
    return out


def _grow(logs, times, first, limit):
    """Shares of one text: the language set grows while the penalised likelihood does."""
    top = logs.max(axis=1, keepdims=True)
    p, n = np.exp(logs - top), times.sum()
    shares = np.zeros(p.shape[1])
    shares[first] = 1.0
    value = times @ np.log(p @ shares)
    while True:
        slope = (times / (p @ shares)) @ p - n
        slope[shares > 0] = -np.inf
        new = int(slope.argmax())
        if not slope[new] > limit:
            return shares
        trial = shares * 0.9
        trial[new] = 0.1
        for _ in range(EM_ROUNDS):
            weights = p * trial
            after = (times / weights.sum(axis=1)) @ weights / n
            moved = np.abs(after - trial).max()
            trial = after
            if moved < 1e-3:
                break
        gained = times @ np.log(p @ trial)
        if gained - value <= limit:
            return shares
        shares, value = trial, gained


def predict(docs, names, table, id="doc_id", text="text", with_row=False):
    """Per row: doc_id, lang_pred, score (the largest share), mixture; with_row adds the text as `text` and
    the row's other columns as struct `row`.

    `und` with score 0 for a null text, a text without a letter, or a model without languages.
    Equal shares go to the language first in name order. Every row gives one row; repeated ids are
    kept.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((names, table))
    whole = [F.struct(*[docs[c] for c in docs.columns if c != text]).alias("row")] if with_row else []
    # Batches of the rows' texts go through Python once each way.
    rows = docs.select(docs[id].alias("doc_id"), docs[text].alias("_text"), *whole)
    kept = ["text", "row"] if with_row else []

    def label(batches):
        enter("languages")
        names, table = shared.value
        for batch in batches:
            texts = [t or "" for t in batch[1].to_pylist()]
            shares, at = [], 0
            while at < len(texts) and names:
                stop, size = at, 0
                while stop < len(texts) and (size == 0 or size + len(texts[stop]) <= _BATCH_CHARS):
                    size += len(texts[stop]) + 1
                    stop += 1
                shares.append(mixtures(texts[at:stop], table))
                at = stop
            shares = np.concatenate(shares) if shares else np.zeros((len(texts), 1))
            score = shares.max(axis=1) if len(texts) else np.zeros(0)
            best = shares.argmax(axis=1)
            parts = [sorted(((-s, k) for k, s in enumerate(row) if s > 0)) for row in shares.tolist()]
            mixed = [",".join(f"{names[k]}:{-s:.3f}" for s, k in part) for part in parts]
            out = [
                batch[0],
                pa.array([names[b] if s > 0 else "und" for b, s in zip(best.tolist(), score.tolist(), strict=True)], pa.string()),
                pa.array(np.clip(score, 0, 1), pa.float64()),
                pa.array(mixed, pa.string()),
                *[batch[1 + k] for k in range(len(kept))],  # the texts go back as they came
            ]
            yield pa.record_batch(out, names=["doc_id", "lang_pred", "score", "mixture", *kept])

    kind = T.StructType().add("doc_id", rows.schema["doc_id"].dataType).add("lang_pred", "string").add("score", "double").add("mixture", "string")
    return rows.mapInArrow(label, kind.add("text", "string").add("row", rows.schema["row"].dataType) if with_row else kind)


def bucket(id="doc_id"):
    """crc32 of the id as text, modulo 3: rows of remainder 1 are held out."""
    return F.pmod(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(3))


def identify(docs, labelled=None, with_row=False):
    """Fit on the rows of `labelled` (default: docs) that are not held out, then label every row of docs."""
    labelled = docs if labelled is None else labelled
    names, table = fit(labelled.where(bucket() != 1))
    return predict(docs, names, table, with_row=with_row)
