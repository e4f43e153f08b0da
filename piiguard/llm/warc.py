"""WARC archives: a writer of gzip-member records and a splittable reader.

Writing: records of equal payloads are found by digest; the one with the largest id is a response,
the others are revisit records that carry the HTTP header only and refer to it. Each task writes one
archive, each record its own gzip member, under a name of its own; a manifest that Spark commits
lists the archives of the attempts that count, so files of lost attempts are never read.

Reading: archives are cut into byte ranges. A task scans its range for gzip magic, validates each
candidate by decoding the record's headers, and owns the records that start inside the range; the
last one may run past its end. A magic inside a member's data fails the validation or is skipped, as
the reader goes on behind a valid member.

Defined cases: null html is an empty payload; rows of the same id and payload that are both the
largest are both responses; a row without id is response only where no row of its payload has one;
extra columns are not read; an empty table gives no archives and an empty result.

The shared folder is opened by ``pyarrow.fs``; payloads go through no driver.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from piiguard.llm.common import materialize, shared_dir
from piiguard.shared import open_folder

#: Bytes of an archive that one reading task scans.
RANGE_BYTES = 16 << 20
#: Payloads of fewer bytes are never revisits.
MIN_REVISIT_BYTES = 0
MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 20
#: A payload is hot beyond this share of all records (so at most as many are) and ``HOT_ROWS``; its records are spread over ``SALTS`` keys.
HOT_SHARE, HOT_ROWS, SALTS = 10_000, 1_000, 4096
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, html, and of each row whether it revisits (``_revisit``) and what (``_refers``)."""
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("_body"))
    key = F.when(F.octet_length("_body") >= min_bytes, F.unhex(F.sha2("_body", 256)))
    keys = rows.select("page_id", key.alias("_key")).where(F.col("_key").isNotNull())
    counted = materialize(keys.groupBy("_key").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")), "payloads")
    least = max(HOT_ROWS, (counted.agg(F.sum("_n")).first()[0] or 0) // HOT_SHARE)
    hot = counted.where(F.col("_n") > least).select(F.col("_key").alias("_hot_key"), F.col("_first").alias("_hot"), F.lit(True).alias("_is_hot"))
    cold = counted.where((F.col("_n") > 1) & (F.col("_n") <= least)).select("_key", "_first", F.lit(0).cast("long").alias("_salt"))
    # at most HOT_SHARE rows; hot payloads then need no partner in the second join, over which they are spread
    marked = rows.withColumn("_key", key).join(F.broadcast(hot), F.col("_key") == F.col("_hot_key"), "left")
    salted = marked.withColumn("_salt", F.when(F.col("_is_hot") | F.col("_key").isNull(), 1 + F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    joined = salted.join(cold, ["_key", "_salt"], "left").withColumn("_first", F.coalesce("_first", "_hot"))
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select("page_id", "url", "_body", revisit.alias("_revisit"), F.when(revisit, F.col("_first")).alias("_refers"))


def _record(page_id: int | None, url: str | None, body: bytes, refers: int | None, revisit: bool) -> bytes:
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http if revisit else http + body
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {''.join(c for c in url or '' if c > ' ')}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write the records of ``pages`` below ``folder``; the manifest: path and bytes of each archive."""
    schema = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
    files, root = open_folder(folder)
    files.create_dir(f"{root}/archives", recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, size, records = None, "", 0, 0
        for batch in batches:
            for page_id, url, body, revisit, refers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    own, base = open_folder(folder)
                    name = f"archives/{uuid.uuid4().hex}.warc.gz"
                    out = own.open_output_stream(f"{base}/{name}", compression=None)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(_record(page_id, url, body or b"", refers, bool(revisit))) + packer.flush()
                out.write(member)
                size, records = size + len(member), records + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((name, size, records), schema, strict=True)], schema=schema)

    manifest = mark_revisits(pages).mapInArrow(run, "path string, bytes long, records long")
    manifest.write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


class _Window:
    """Bytes of a file by absolute position, kept from the place last asked for."""

    def __init__(self, source, size: int):
        self.source, self.size, self.start, self.data = source, size, 0, b""

    def upto(self, start: int, end: int) -> bytes:
        """Bytes [start, end) as far as the file has them."""
        end = min(end, self.size)
        if not self.start <= start <= self.start + len(self.data):
            self.start, self.data = start, b""
        if end > self.start + len(self.data):
            have = self.start + len(self.data)
            self.source.seek(have)
            self.data = self.data[start - self.start :] + self.source.read(max(end - have, CHUNK))
            self.start = start
        return self.data[start - self.start : end - self.start]


def _member(window: _Window, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, block and end of the record whose gzip member starts at ``at``; None if none does."""
    unpack, parts, pos, seen = zlib.decompressobj(31), [], at, b""
    while not unpack.eof:
        data = window.upto(pos, pos + (CHUNK if parts else 4096))
        if not data:
            return None
        try:
            piece = unpack.decompress(data)
        except zlib.error:
            return None
        pos += len(data)
        if len(seen) < 5:  # a member that does not open with the version line is none of ours
            seen = (seen + piece)[:5]
            if not b"WARC/".startswith(seen):
                return None
        parts.append(piece)
    pos -= len(unpack.unused_data)
    head, found, block = b"".join(parts).partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        return None
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = headers.get("content-length", "")
    if not length.isdigit() or len(block) < int(length) or "warc-type" not in headers:
        return None
    return headers, block[: int(length)], pos


def records_in(source, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Position, headers and block of the records that start in [start, end) of an archive."""
    window, at = _Window(source, size), start
    while at < end:
        data = window.upto(at, min(at + CHUNK, end + len(MAGIC) - 1))
        found = data.find(MAGIC)
        if found < 0:
            if len(data) < len(MAGIC):
                return
            at += len(data) - len(MAGIC) + 1
            continue
        at += found
        if at >= end:
            return
        member = _member(window, at)
        if member is None:
            at += 1
            continue
        yield at, member[0], member[1]
        at = member[2]


def read(manifest: DataFrame, folder: str, payloads: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the archives that ``manifest`` (path, bytes) lists, by byte ranges."""
    spark = manifest.sparkSession
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    ranges = manifest.select("path", "bytes", F.explode(starts).alias("start")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start")
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())]
    schema = pa.schema(fields + [("payload", pa.binary())] * payloads)

    def number(urn: str) -> int | None:
        digits = urn.removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_folder(folder)
        for batch in batches:
            for path, size, start in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows, held = [], 0
                with files.open_input_file(f"{base}/{path}") as source:
                    for _, headers, block in records_in(source, size, start, min(start + range_bytes, size)):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x[:15].lower() == b"content-length:")
                        digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
                        if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{path}: the payload does not have its digest")
                        refers = number(headers["warc-refers-to"]) if kind == "revisit" else None
                        row = (number(headers["warc-record-id"]), length, digest, kind, refers, headers["warc-target-uri"])
                        rows.append((*row, payload if kind == "response" else None) if payloads else row)
                        held += len(payload) if payloads else 100
                        if held > CHUNK * 8:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * payloads
    return ranges.mapInArrow(run, ddl)


# ----------------------------------------------------------------------------------------------
def op3_warc(spark, sf_dir):
    folder = shared_dir(spark)
    manifest = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read(manifest, folder, payloads=False).drop("url")


_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS s, sha256(b) AS k FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY k) AS first FROM h),
d AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(s, ((i // 4) * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER + 1, 1)), '') AS payload_digest FROM m)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM d"""

QUERIES = {"op3_warc": op3_warc}
ORACLES = {"op3_warc": _SQL}
