"""Compression bands: zstandard ratios of whole texts and of fixed chunks, with limits by length.

The ratio is bytes / compressed bytes. A text compresses the better the longer it is, so each band
of lengths has its own lowest and highest ratio: below the lowest it is noise (random characters,
encoded data), above the highest it repeats itself. Chunks find a bad stretch inside a good text:
a text is also rejected if more than CHUNK_SHARE of its full chunks are outside the chunk limits.
"""

from collections import Counter

import pyarrow as pa
import zstandard

from .common import columns

#: (bytes up to, lowest ratio, highest ratio); the last band has no end. The lowest ratios lie just
#: below prose and above base64 and random characters of every length of the band from 257 bytes on.
#: Below that, prose (0.88 and on) and noise (up to 1.04) can't be told apart; hex digits (1.6 to 1.9
#: up to 4096 bytes, 1.96 at most) only above 4096 bytes. The highest ratios lie above prose (at most
#: 0.9, 1.6, 1.8, 2.2, 2.6, 2.8, 2.9 by band) and below texts without equal 5-word windows that still
#: repeat themselves: numbered lines of one template (1.9 at 200 bytes, 2.3 at 320, 3.6 at 800, 5.2 at
#: 2500, 6.5 at 40,000) and one sentence with every fourth word changed (2.2 to 12.9). Tables of
#: numbers (1.7 to 3.7) compress as prose does and stay.
BANDS = [(64, 0.0, 1.5), (256, 0.75, 1.85), (384, 1.16, 2.1), (1024, 1.27, 3.0), (4096, 1.6, 3.6), (16384, 1.95, 4.2), (None, 2.1, 4.8)]
CHUNK = 2048
CHUNK_LIMITS = (1.6, 4.0)
CHUNK_SHARE = 0.5
LEVEL = 3
SYMBOLS = "#*$%&|<>"


def ratio(raw, press):
    return len(raw) / len(press.compress(raw)) if raw else 0.0


def band(n):
    return next(k for k, (most, _, _) in enumerate(BANDS) if most is None or n <= most)


def verdict(raw, press, bands=None, chunk=CHUNK, chunk_limits=CHUNK_LIMITS, chunk_share=CHUNK_SHARE):
    """(ratio, band, chunks, chunks outside, kept) of a text's bytes; an empty text is not kept."""
    bands = bands or BANDS
    k = band(len(raw))
    whole = ratio(raw, press)
    # Full chunks only; a text below one chunk has none.
    parts = [ratio(raw[a : a + chunk], press) for a in range(0, len(raw) - chunk + 1, chunk)]
    outside = sum(not chunk_limits[0] <= x <= chunk_limits[1] for x in parts)
    inside = bands[k][1] <= whole <= bands[k][2]
    return whole, k, len(parts), outside, bool(raw) and inside and outside <= chunk_share * len(parts)


def repeated_words(words):
    """Words inside 5-word windows that the text holds twice or more, the first ones included."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    total = covered = 0  # covered: the first position that no counted window covers
    for at, window in enumerate(windows):
        if times[window] > 1:
            total += at + 5 - max(at, covered)
            covered = at + 5
    return total


def base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text (None: no words)."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly the six ASCII white-space characters
    lines, repeated = set(), 0
    for line in raw.split(b"\n"):
        if line.split(None, 1):
            repeated += line in lines
            lines.add(line)
    spaces = sum(map(text.count, " \t\n\v\f\r"))
    return len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), repeated, repeated_words(words)


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, ratio double, band int, n_chunks long, n_chunks_outside long"
)


def measure(docs, id="doc_id", text="text"):
    """Base counts, compression figures and the verdict of every whole text.

    A null or empty text has no words, fails the base rules and is not kept. Rows are judged one by
    one: repeated ids and texts give equal rows each. No shuffle; extra columns are ignored.
    """
    rows = columns(docs, doc_id=id, text=text)
    names = ["doc_id", *(part.split()[0] for part in SCHEMA.split(", "))]

    def judge(batches):
        press = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            out = []
            for text in batch[1]:
                text = text.as_py()
                n_words, chars, symbols, lines, repeats = base(text)
                failed = n_words < 10 or 100 * repeats > 20 * n_words
                whole, k, chunks, outside, fine = verdict((text or "").encode("utf-8", "surrogatepass"), press)
                out.append((n_words, chars, symbols, lines, repeats, failed, fine and not failed, whole, k, chunks, outside))
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.int32(), pa.int64(), pa.int64()]
            found = list(zip(*out, strict=True)) if out else [()] * len(types)
            yield pa.record_batch([batch[0], *[pa.array(v, t) for v, t in zip(found, types, strict=True)]], names=names)

    return rows.mapInArrow(judge, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
