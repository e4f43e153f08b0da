"""Token-id files: frequency-ranked ids in a byte-aligned variable-length coding with separate control bytes.

Texts are tokenized once into a stored table of compressed ids. Its ids are counted, and each id is replaced by its
rank by falling count (then by id), so that frequent ids are small numbers; the rank table has a row for each id of
the vocabulary and is the only thing that the driver gathers. The stored rows are range-partitioned by doc_id, and
each task writes its range as files of bounded size; a manifest that Spark commits lists the files of the attempts
that count. A reading task gets whole files and decodes them with table lookups.

A file is a row of blocks. A block has a header of four unsigned 32-bit numbers: its mark, documents, ids and data
bytes; then its doc_ids (64 bits each), a byte for each whether it is null, ids of each document (64 bits), control
bytes and data bytes. Four ids share a control byte, two bits each from the lowest: bytes of the rank less one. A
rank is its bytes, lowest first. All numbers are little-endian. ``ranks.bin`` beside the files has the ids by rank.

Defined cases: a null or empty text is the end id alone; repeated rows and repeated doc_ids are kept row by row,
side by side, ordered by their ids' checksums and then as they are stored (rows alike in both are alike in the
result, but for their start); rows without doc_id come first; a very long text makes a block of its own; an empty
table gives no files and an empty result; extra columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from piiguard.llm.common import materialize, released, shared_dir
from piiguard.llm.packing import tokenize
from piiguard.llm.tokens import squeeze, unsqueeze
from piiguard.shared import open_folder

END_ID = 2
#: Ids of a block, and bytes of a file, at which the writer closes it (what crosses it included).
BLOCK_IDS = 1 << 20
FILE_BYTES = 64 << 20
#: Characters of text that are tokenized at once.
SLICE_CHARS = 4 << 20
MARK = 0x31425646
_HEAD = struct.Struct("<4I")

#: Bytes of the four values of each control byte.
LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    code = ((values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)).astype(np.uint8)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(code)] = code
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return control.tobytes(), data.tobytes()


def decode_values(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of control and data bytes, all at once by the table of lengths."""
    lengths = LENGTHS[control].ravel()[:n]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    values = np.zeros(n, np.uint32)
    for byte in range(int(lengths.max(initial=0))):
        at = np.flatnonzero(lengths > byte)
        values[at] |= data[starts[at] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return values


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, checksum and compressed ids of each row of ``docs`` (doc_id, text), with the end id."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            texts = pc.fill_null(batch.column(1), "")
            ends, start = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while start < len(texts):
                base = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + SLICE_CHARS)))
                sums, packed = [], []
                for ids in tokenize(path, texts.slice(start, stop - start)):
                    ids[-1] = END_ID
                    sums.append(zlib.crc32(ids.astype("<u4", copy=False)))
                    packed.append(squeeze(ids))
                columns = [batch.column(0).slice(start, stop - start), pa.array(sums, pa.int64()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
                start = stop

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids_crc32 long, ids binary")


def rank_ids(rows: DataFrame) -> np.ndarray:
    """The ids that occur in ``rows`` (ids), the most frequent first, of equal counts the smaller first."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(0, np.int64), [], 0

        def add() -> None:
            nonlocal counts, held, size
            more = np.bincount(np.concatenate([np.zeros(0, np.uint32), *held]), minlength=len(counts))
            more[: len(counts)] += counts
            counts, held, size = more, [], 0

        for batch in batches:
            for packed in batch.column(0):
                held.append(unsqueeze(packed.as_py()))
                size += len(held[-1])
                if size >= BLOCK_IDS:
                    add()
        add()
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], schema=schema)

    counts = rows.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # as many rows as the vocabulary has ids, at most
    ids, n = found["id"].to_numpy(), found["n"].to_numpy()
    return ids[np.lexsort((ids, -n))].astype("<u4")


def _block(doc_ids: list[int | None], ids: list[np.ndarray], rank: np.ndarray) -> bytes:
    flat = np.concatenate(ids)
    control, data = encode_values(rank[flat])
    head = _HEAD.pack(MARK, len(ids), len(flat), len(data))
    numbers = np.array([i or 0 for i in doc_ids], "<i8").tobytes() + bytes(i is None for i in doc_ids)
    return head + numbers + np.array([len(x) for x in ids], "<i8").tobytes() + control + data


def read_block(source) -> tuple[list[int | None], np.ndarray, np.ndarray] | None:
    """doc_ids, ids of each document and ranks one after another of the next block; None at the end of the file."""
    head = source.read(_HEAD.size)
    if not head:
        return None
    mark, docs, n, size = _HEAD.unpack(head)
    if mark != MARK:
        raise ValueError("not a block of token ids")
    controls = -(-n // 4)
    body = source.read(17 * docs + controls + size)
    if len(body) < 17 * docs + controls + size:
        raise ValueError("a block of token ids is cut short")
    doc_ids = np.frombuffer(body, "<i8", docs).tolist()
    null = body[8 * docs : 9 * docs]
    lengths = np.frombuffer(body, "<i8", docs, 9 * docs)
    ranks = decode_values(np.frombuffer(body, np.uint8, controls, 17 * docs), np.frombuffer(body, np.uint8, size, 17 * docs + controls), n)
    return [None if x else i for i, x in zip(doc_ids, null, strict=True)], lengths, ranks


def write(docs: DataFrame, path: str, folder: str, block_ids: int = BLOCK_IDS, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the token ids of ``docs`` below ``folder`` in ascending doc_id order.

    The manifest: path, place (task and number in it, ascending as the files are), docs and ids of each file.
    """
    rows = materialize(tokenized(docs, path).withColumn("_row", F.monotonically_increasing_id()), "tokens")
    by_rank = rank_ids(rows)
    files, root = open_folder(folder)
    files.create_dir(f"{root}/tokens", recursive=True)
    with files.open_output_stream(f"{root}/ranks.bin", compression=None) as out:
        out.write(by_rank.tobytes())
    rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(rank)  # bounded by the vocabulary
    schema = pa.schema([("path", pa.string()), ("task", pa.int64()), ("part", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, base = open_folder(folder)
        task, part, out, size, total, total_docs, doc_ids, ids, held = TaskContext.get().partitionId(), 0, None, 0, 0, 0, [], [], 0

        def flush() -> None:
            nonlocal out, name, size, total, total_docs, doc_ids, ids, held
            if not ids:
                return
            if out is None:
                name, size, total, total_docs = f"tokens/{uuid.uuid4().hex}.bin", 0, 0, 0
                out = own.open_output_stream(f"{base}/{name}", compression=None)
            block = _block(doc_ids, ids, shared.value)
            out.write(block)
            size, total, total_docs = size + len(block), total + held, total_docs + len(ids)
            doc_ids, ids, held = [], [], 0

        def closed() -> pa.RecordBatch:
            nonlocal out, part
            out.close()
            out, part = None, part + 1
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((name, task, part - 1, total_docs, total), schema, strict=True)], schema=schema)

        name = ""
        for batch in released(batches):
            for doc_id, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids.append(doc_id)
                ids.append(unsqueeze(packed.as_py()))
                held += len(ids[-1])
                if held >= block_ids:
                    flush()
                    if size >= file_bytes:
                        yield closed()
        flush()
        if out is not None:
            yield closed()

    # a third of the rows may have one doc_id: checksum and row number let their range be cut
    order = ["doc_id", "ids_crc32", "_row"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
    manifest = dealt.mapInArrow(run, "path string, task long, part long, docs long, ids long")
    manifest.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def read(manifest: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """The documents of the files that ``manifest`` lists: doc_id, start, n_tokens, ids_crc32 and, if asked, ids."""
    spark = manifest.sparkSession
    fields = [(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)
    before = Window.orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    placed = manifest.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))
    dealt = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_folder(folder)
        by_rank = None
        for batch in batches:
            for path, start in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if by_rank is None:
                    with files.open_input_stream(f"{base}/ranks.bin", compression=None) as source:
                        by_rank = np.frombuffer(source.read(), "<u4")
                with files.open_input_stream(f"{base}/{path}", compression=None) as source:
                    while block := read_block(source):
                        doc_ids, lengths, ranks = block
                        ids, ends = by_rank[ranks], np.cumsum(lengths)
                        each = [ids[b - n : b] for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                        columns = [pa.array(doc_ids, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                        if with_ids:
                            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64))))
                        start += int(ends[-1]) if len(ends) else 0
                        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c, _ in fields) + ", ids array<long>" * with_ids)


# ----------------------------------------------------------------------------------------------
def op12_token_files(spark, sf_dir):
    import public_tokenizers

    folder = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read(write(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), folder), folder, with_ids=False)


QUERIES = {"op12_token_files": op12_token_files}
ORACLES: dict[str, str] = {}
