"""Legacy ARC archives to WARC.

An ARC file opens with a filedesc record whose body names the version and the fields of all later
header lines: five in version 1, ten in version 2. Every record is such a line, the declared number
of bytes, and a newline. The converter parses lines from the right (a URL may hold spaces), trusts
the declared length only, and writes one WARC record each, with what ARC lacks made up the same way
every time: record id (a UUID of locator and digest), ISO date, type and digests. Equal payloads
of at least `least` bytes are stored once; the other records revisit the one with the lowest key.
"""

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from .common import columns, read_blobs, settle, write_blobs

FIELDS = {
    b"1": b"URL IP-address Archive-date Content-type Archive-length",
    b"2": b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
LEAST = 100
FILE_BYTES = 8 << 20  # an archive ends with the record that reaches this size
KEY = b"X-Record-Key: "
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard's namespace for URLs
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# An empty gzip member closes a file; it ends in a zero byte, which the blob writer needs.
_CLOSE = zlib.compressobj(9, zlib.DEFLATED, 31).flush()


def record_id(locator, digest):
    return f"urn:uuid:{uuid.uuid5(_SPACE, f'{locator} {digest}')}"


def iso_date(digits):
    """ARC's 12 or 14 digits as a WARC date; the epoch for anything else."""
    if not re.fullmatch(rb"\d{12}(\d\d)?", digits):
        return "1970-01-01T00:00:00Z"
    d = digits.decode().ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def arc_file(name, version, records):
    """An ARC file's bytes from (url, date digits, key or None, payload) records."""
    body = version + b" 0 archive\n" + FIELDS[version] + b"\n"
    out = []

    def add(url, date, kind, block):
        middle = {b"1": [], b"2": [b"200", b"-", b"-", b"0", name]}[version]
        out.append(b" ".join([url, b"0.0.0.0", date, kind, *middle, str(len(block)).encode()]) + b"\n" + block + b"\n")

    add(b"filedesc://" + name, b"20040101000000", b"text/plain", body)
    for url, date, key, payload in records:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n" % len(payload)
        head += KEY + str(key).encode() + b"\r\n" if key is not None else b""
        add(url, date, b"text/html", head + b"\r\n" + payload)
    return b"".join(out)


def archive(pages, id="page_id", url="url", html="html", file_bytes=FILE_BYTES):
    """Pages as legacy archives: rows path, content. Versions 1 and 2 alternate. A null html is empty, a null url `-`."""
    rows = columns(pages, page_id=id, url=url, html=html)

    def files(batches):
        task, number, pending, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            name = f"part-{task:05d}-{number:05d}.arc".encode()
            content = arc_file(name, b"12"[number % 2 : number % 2 + 1], pending)
            return pa.record_batch([pa.array([name.decode()]), pa.array([content], pa.binary())], names=["path", "content"])

        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                seconds = (page_id or 0) % 86_400
                date = b"20040101%02d%02d%02d" % (seconds // 3600, seconds // 60 % 60, seconds % 60)
                named = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url).encode("utf-8", "surrogatepass") if url else b"-"
                pending.append((named, date, page_id, payload))
                size += len(payload)
                if size >= file_bytes:
                    yield close()
                    number, pending, size = number + 1, [], 0
        if pending:
            yield close()

    return rows.mapInArrow(files, "path string, content binary")


def parse_arc(content):
    """(offset, url, ip, date, content type, block) of every record of an ARC file, the filedesc too.

    Raises ValueError where the version line, a field count or a declared length is wrong.
    """
    if content[:2] == b"\x1f\x8b":
        content = b"".join(_members(content))
    at, fields = 0, len(FIELDS[b"1"].split())
    while at < len(content):
        if content[at : at + 1] == b"\n":  # the newline between records
            at += 1
            continue
        end = content.find(b"\n", at)
        line = content[at:end] if end >= 0 else content[at:]
        # The first line always has version 1's fields or version 2's; its body says which.
        parts = line.rsplit(b" ", 9 if at == 0 and line.count(b" ") >= 9 else fields - 1)
        if end < 0 or not parts[-1].isdigit() or len(parts) < 5:
            raise ValueError(f"bad ARC header line at {at}")
        length = int(parts[-1])
        block = content[end + 1 : end + 1 + length]
        if len(block) != length:
            raise ValueError(f"ARC record at {at} is shorter than declared")
        if at == 0:
            version = block[:1]
            if not parts[0].startswith(b"filedesc:") or version not in FIELDS:
                raise ValueError("not an ARC file of version 1 or 2")
            fields = len(FIELDS[version].split())
        yield at, *parts[:4], block
        at = end + 1 + length


def split_http(block):
    """Headers (with their blank line) and payload; no headers if the block isn't an HTTP response."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    found = re.search(rb"\r?\n\r?\n", block)
    return (block[: found.end()], block[found.end() :]) if found else (block, b"")


_RECORDS = (
    "path string, offset long, url string, ip string, date string, kind string, key long, locator string, "
    "head binary, digest string, length long"
)


def records(arcs, with_payload=False):
    """Parsed records of archives (columns path, content), without filedesc records."""

    def parse(batches):
        names = [part.split()[0] for part in _RECORDS.split(", ")] + ["payload"] * with_payload
        types = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64()]
        types += [pa.binary()] * with_payload
        for batch in batches:
            for path, content in zip(batch[0].to_pylist(), batch[1], strict=True):
                out = []
                for offset, url, ip, date, kind, block in parse_arc(content.as_py()):
                    if offset == 0:
                        continue
                    head, payload = split_http(block)
                    found = re.search(rb"(?im)^" + KEY + rb"(-?\d+)\r?$", head)
                    key = int(found[1]) if found else None
                    locator = str(key) if found else f"{path}:{offset}"
                    row = [path, offset, url.decode("utf-8", "replace"), ip.decode(), iso_date(date), kind.decode("utf-8", "replace")]
                    row += [key, locator, head, hashlib.sha256(payload).hexdigest(), len(payload)]
                    out.append(row + [payload] * with_payload)
                for k in range(0, len(out), 256):
                    yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*out[k : k + 256], strict=True), types, strict=True)], names=names)

    return arcs.mapInArrow(parse, _RECORDS + (", payload binary" if with_payload else ""))


def revisits(found, least=LEAST):
    """locator, digest, first (the lowest key of that digest) of records that repeat a payload.

    A record that bears the lowest key itself, repeated rows included, is no revisit; a digest
    without any key has none. Rows are two short strings and a number; a digest that a third of
    all records share is combined before the shuffle, and its join is left to adaptive splitting.
    """
    long = found.where(F.col("length") >= least).select("locator", "key", "digest")
    first = long.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    repeated = long.join(first.select("digest", "first"), "digest").where("key is null or key <> first")
    return repeated.select("locator", "digest", "first").distinct()


def warc_record(kind, row, block, more=()):
    """One WARC/1.1 record, from its named values."""
    digest = f"sha256:{hashlib.sha256(block).hexdigest()}"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{row['id']}>", f"WARC-Date: {row['date']}"]
    if row["url"] not in ("-", None):
        lines.append(f"WARC-Target-URI: {row['url']}")
    lines += [f"WARC-IP-Address: {row['ip']}"] if row.get("ip") not in (None, "0.0.0.0", "-") else []
    lines += [*more, f"WARC-Block-Digest: {digest}", f"Content-Type: {row['type']}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8") + block + b"\r\n\r\n"


def convert(arcs, path, least=LEAST, file_bytes=FILE_BYTES, level=3):
    """Write the records of archives (columns path, content) as gzipped WARC files under `path`.

    HTTP blocks become response or revisit records (a revisit keeps its HTTP head only), others
    resource records; each file opens with a warcinfo record, and each record is a gzip member.
    """
    again = settle(revisits(records(arcs), least), "revisits")
    rows = records(arcs, with_payload=True)
    # Locators are near unique, so payloads are dealt evenly whatever repeats.
    rows = rows.join(again, ["locator", "digest"], "left").select(
        "locator", "key", "url", "ip", "date", "kind", "head", "digest", "length", "first", F.when(F.col("first").isNull(), F.col("payload")).alias("payload")
    )

    def press(record):
        member = zlib.compressobj(level, zlib.DEFLATED, 31)
        return member.compress(record) + member.flush()

    def files(batches):
        task, out, size, number = TaskContext.get().partitionId(), [], 0, 0

        def close():
            return pa.record_batch([pa.array([b"".join([*out, _CLOSE])], pa.binary())], names=["content"])

        for batch in batches:
            for row in batch.to_pylist():
                if not out:
                    about = {"id": record_id(f"warcinfo {task} {number}", ""), "date": "2004-01-01T00:00:00Z", "url": None, "type": "application/warc-fields"}
                    out.append(press(warc_record("warcinfo", about, b"software: arc converter\r\nformat: WARC File Format 1.1\r\n")))
                row |= {"id": record_id(row["locator"], row["digest"]), "type": "application/http;msgtype=response"}
                more = [f"WARC-Payload-Digest: sha256:{row['digest']}"]
                if row["key"] is not None:
                    more.append(f"X-Record-Key: {row['key']}")
                if row["first"] is not None:
                    more += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(row['first'], row['digest'])}>"]
                    more += [f"X-Refers-To-Key: {row['first']}", f"X-Payload-Length: {row['length']}"]
                    record = warc_record("revisit", row, row["head"], more)
                elif row["head"]:
                    record = warc_record("response", row, row["head"] + row["payload"], more)
                else:
                    row["type"] = row["kind"]
                    record = warc_record("resource", row, row["payload"], more)
                out.append(press(record))
                size += len(record)
                if size >= file_bytes:
                    yield close()
                    out, size, number = [], 0, number + 1
        if out:
            yield close()

    return write_blobs(rows.mapInArrow(files, "content binary"), path, last=b"\0")


def _members(content, step=1 << 16):
    """The bytes of each gzip member in turn."""
    at = 0
    while at < len(content):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            piece = content[at : at + step]
            if not piece:
                raise ValueError("cut gzip member")
            parts.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
        yield b"".join(parts)


def parse_warc(content):
    """(headers by lower-case name, block) of every record of a gzipped WARC file."""
    for record in _members(content):
        if not record:
            continue
        head, _, rest = record.partition(b"\r\n\r\n")
        first, *lines = head.decode("utf-8").split("\r\n")
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        length = int(headers["content-length"])
        if not first.startswith("WARC/") or rest[length:] != b"\r\n\r\n":
            raise ValueError("bad WARC record")
        yield headers, rest[:length]


def read(spark, path):
    """Records of the WARC files under a path: record_type, record_id, key, url, date, payload_bytes,
    payload_digest (of the payload as stored; a revisit's as declared), refers_to (a key)."""
    kind = "record_type string, record_id string, key long, url string, date string, payload_bytes long, payload_digest string, refers_to long"

    def parse(batches):
        for batch in batches:
            for content in batch[0]:
                out = []
                for h, block in parse_warc(content.as_py()):
                    number = lambda name, h=h: int(h[name]) if name in h else None
                    if h["warc-type"] == "revisit":
                        size, digest = number("x-payload-length"), h["warc-payload-digest"].partition(":")[2]
                    else:
                        payload = split_http(block)[1] if h["warc-type"] == "response" else block
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    out.append((h["warc-type"], h["warc-record-id"][1:-1], number("x-record-key"), h.get("warc-target-uri"), h["warc-date"], size, digest, number("x-refers-to-key")))
                types = [pa.string()] * 2 + [pa.int64()] + [pa.string()] * 2 + [pa.int64(), pa.string(), pa.int64()]
                names = [part.split()[0] for part in kind.split(", ")]
                yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return read_blobs(spark, path).select("content").mapInArrow(parse, kind)
