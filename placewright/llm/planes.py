"""Token ids in files of shuffled planes.

Ids stand in ascending document order. Every block of BLOCK ids is transposed into byte planes (or
bit planes), each plane is compressed with zstandard, and an index at the end of the file says
where each block and plane lies, so that a reader can fetch any range of ids alone.

File: magic, blocks, document table, index, footer. The document table holds each document's id
and number of tokens; a document never crosses files. All integers are little-endian.
"""

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns, read_blobs, settle, write_blobs
from .tokens import END, encoder

MAGIC = b"IDPLANE1"
BLOCK = 65_536  # ids of one block
FILE_IDS = 4_194_304  # a file ends with the first document that reaches this many ids
_FOOTER = struct.Struct("<QQQIIBxxx8s")  # table, index, ids; writing task, file of the task; plane kind
KINDS = {"byte": 0, "bit": 1}


def to_planes(ids, kind):
    """Planes of one block, lowest first: 4 of a byte per id, or 32 of a bit per id."""
    raw = ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes, n, kind):
    if kind == "byte":
        raw = np.stack([np.frombuffer(p, dtype=np.uint8) for p in planes], axis=1)
    else:
        bits = [np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n, bitorder="little") for p in planes]
        raw = np.packbits(np.stack(bits, axis=1), axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


def pack_file(documents, kind="byte", task=0, number=0, level=3):
    """One file's bytes from (document id or None, ids) pairs."""
    press = zstandard.ZstdCompressor(level=level)
    ids = np.concatenate([x for _, x in documents] or [np.zeros(0, np.uint32)])
    out, at, index = [MAGIC], len(MAGIC), []
    for start in range(0, len(ids), BLOCK):
        block = ids[start : start + BLOCK]
        # An all-zero plane is stored as length 0.
        planes = [press.compress(p) if any(p) else b"" for p in to_planes(block, kind)]
        index.append(struct.pack(f"<QI{len(planes)}I", at, len(block), *map(len, planes)))
        out += planes
        at += sum(map(len, planes))
    lengths = np.array([len(x) for _, x in documents], "<i8")
    known = np.array([d is not None for d, _ in documents], np.uint8)
    names = np.array([d or 0 for d, _ in documents], "<i8")
    table = press.compress(struct.pack("<Q", len(documents)) + names.tobytes() + lengths.tobytes() + known.tobytes())
    out += [table, *index, _FOOTER.pack(at, at + len(table), len(ids), task, number, KINDS[kind], b"EDIPLAN\n")]
    return b"".join(out)


class PlaneFile:
    """Random access to one file's bytes."""

    def __init__(self, content):
        table, index, self.n_ids, self.task, self.number, kind, end = _FOOTER.unpack(content[-_FOOTER.size :])
        if content[: len(MAGIC)] != MAGIC or end != b"EDIPLAN\n":
            raise ValueError("not a plane file")
        self.content, self.press = content, zstandard.ZstdDecompressor()
        self.kind = next(k for k, v in KINDS.items() if v == kind)
        entry = struct.Struct(f"<QI{4 if self.kind == 'byte' else 32}I")
        self.blocks = list(entry.iter_unpack(content[index : -_FOOTER.size]))
        raw = self.press.decompress(content[table:index])
        (n,) = struct.unpack_from("<Q", raw)
        names = np.frombuffer(raw, "<i8", n, 8)
        known = np.frombuffer(raw, np.uint8, n, 8 + 16 * n)
        self.documents = [int(d) if k else None for d, k in zip(names, known, strict=True)]
        self.lengths = np.frombuffer(raw, "<i8", n, 8 + 8 * n)

    def block(self, k):
        at, n, *sizes = self.blocks[k]
        planes = []
        for size in sizes:
            empty = bytes(n if self.kind == "byte" else (n + 7) // 8)
            planes.append(self.press.decompress(self.content[at : at + size]) if size else empty)
            at += size
        return from_planes(planes, n, self.kind)

    def read(self, start, stop):
        """Ids start..stop-1 of the file; only their blocks are opened."""
        parts = [self.block(k) for k in range(start // BLOCK, (stop + BLOCK - 1) // BLOCK)] if stop > start else []
        first = start // BLOCK * BLOCK
        return np.concatenate(parts)[start - first : stop - first] if parts else np.zeros(0, np.uint32)


def write(docs, path, vocabulary, id="doc_id", text="text", kind="byte", end=END, file_ids=FILE_IDS):
    """Encode whole texts and write plane files in ascending document order.

    Rows are range-partitioned and sorted by id, so each task writes a run of neighbouring
    documents; files end at a bounded number of ids, whatever the partition holds. A null text is
    empty (only the end id); a null id comes first; repeated ids and rows are kept; an empty table
    writes no file. Extra columns are ignored.
    """
    rows = columns(docs, doc_id=id, text=text)
    # All columns order the rows, so that many rows of one id still split over tasks.
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def files(batches):
        encode, task, number, pending, n = encoder(vocabulary), TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for d, x in zip(part[0].to_pylist(), encode.encode(part[1].to_pylist(), end), strict=True):
                    pending.append((d, x))
                    n += len(x)
                    if n >= file_ids:
                        yield pa.record_batch({"content": pa.array([pack_file(pending, kind, task, number)], pa.binary())})
                        number, pending, n = number + 1, [], 0
        if pending:
            yield pa.record_batch({"content": pa.array([pack_file(pending, kind, task, number)], pa.binary())})

    return write_blobs(rows.mapInArrow(files, "content binary"), path)


def read(spark, path, with_ids=False):
    """One row per stored document, decoded from the files: doc_id, start, n_tokens, ids_crc32 (and ids)."""

    def documents(batches):
        for batch in batches:
            for content in batch[0]:
                f = PlaneFile(content.as_py())
                ids = f.read(0, f.n_ids)
                stops = np.cumsum(f.lengths)
                starts = stops - f.lengths
                parts = [ids[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
                out = {
                    "doc_id": pa.array(f.documents, pa.int64()),
                    "task": pa.array([f.task] * len(parts), pa.int64()),
                    "number": pa.array([f.number] * len(parts), pa.int64()),
                    "local": pa.array(starts),
                    "n_tokens": pa.array(f.lengths),
                    "ids_crc32": pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32()))
                yield pa.record_batch(out)

    kind = "doc_id long, task long, number long, local long, n_tokens long, ids_crc32 long"
    rows = read_blobs(spark, path).select("content")
    rows = settle(rows.mapInArrow(documents, kind + (", ids array<int>" if with_ids else "")), "ids")
    # Two sums over few rows: files of a task, then one row per task.
    files = rows.groupBy("task", "number").agg(F.sum("n_tokens").alias("n"))
    in_task = Window.partitionBy("task").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    tasks = files.groupBy("task").agg(F.sum("n").alias("n"))
    over = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("task", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("task_start"))
    files = files.select("task", "number", F.coalesce(F.sum("n").over(in_task), F.lit(0)).alias("file_start"))
    starts = files.join(tasks, "task").select("task", "number", (F.col("task_start") + F.col("file_start")).alias("before"))
    start = (F.col("before") + F.col("local")).alias("start")
    return rows.join(starts, ["task", "number"]).select(
        "doc_id", start, "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])
    )
