"""Byte-level BPE: encoding through a global shuffle of distinct words, decoding by the token table.

Words are the matches of the vocabulary's pattern (pre-tokens). Tasks gather whole texts into blocks and
number each block's distinct words; a text is the sequence of these numbers, the words' positions. The
distinct words of all blocks are dealt into buckets by a hash of the word, a row for each bucket of a
block, and shuffled by bucket: a task gets every block's words of a bucket, encodes each distinct word
once in all and joins its ids to the blocks that hold it. Texts take no part in that: as packed sequences
of numbers they meet the ids of their block's words only in the last shuffle, by block, where each is
reassembled by position.

A task of the word stage holds the distinct words of one bucket and a row at a time; buckets grow in
number with the input's partitions.

The texts are read twice, once for their words and once for their sequences, as both together cost more
to keep than to make again. So ``docs`` must be a stored table, whose partitions read alike each time;
a block's number has a checksum of its words, and a block whose two readings differ is an error.

Decoding joins the token-byte table in the tasks: as a join of rows every id would be a row, and texts
would pass a shuffle a second time.

Defined cases: a null or empty text has no ids; repeated rows and repeated ids of documents are kept
row by row; a single very long text makes a block of its own; an empty table gives an empty table;
extra columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame, functions as F

#: Bytes of text in a block, at which a task closes it (the text that crosses it included).
BLOCK_BYTES = 8 << 20
#: Words of whole texts in a chunk, at which it is compressed (the text that crosses it included).
CHUNK_WORDS = 1 << 18
#: Buckets of words, at least; beyond, one for each so many partitions of the input.
LEAST_BUCKETS = 512
PARTITIONS_A_BUCKET = 64

_SQUEEZER = zstandard.ZstdCompressor(level=6)
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The tiktoken encoding of a rank file, one in each process."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_bytes(path: str) -> list[bytes]:
    """The token-byte table: the bytes of each id, a table bounded by the vocabulary."""
    with open(path, "rb") as f:
        table = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return [table.get(i, b"") for i in range(max(table) + 1)]


_CUT = regex.compile(r"\s*\S+|\s+")


def cut(text: str) -> list[str]:
    """Pieces that each begin at a run of white space (or the start); joined they are the text."""
    return _CUT.findall(text)


_SPACE = "\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
#: White space before a space, where cutting at each space would be wrong, and the mark of cuts.
_RUNS = f"[{_SPACE}] |\\x00"
#: Words that can stand side by side: no match of the pattern joins two of them.
_APART = f"(?s)^ .*[^{_SPACE}]$"


def cut_all(texts: pa.StringArray) -> pa.ListArray:
    """:func:`cut` of each text; those without runs of white space before a space all at once."""
    runs = pc.match_substring_regex(texts, _RUNS)
    plain = pc.split_pattern(pc.replace_substring(texts, " ", "\x00 "), "\x00")
    if not pc.any(runs).as_py():
        return plain
    return pa.array([cut(t) if r else p for t, r, p in zip(texts.to_pylist(), runs.to_pylist(), plain.to_pylist(), strict=True)], pa.list_(pa.string()))


_TABLES: dict[str, np.ndarray] = {}


def encode_words(path: str, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each word has, and the ids of all in order.

    Words that a space starts and none ends are encoded in one call on their concatenation; each
    word's share follows from the byte lengths of the ids. Others are encoded one by one.
    """
    enc = encoder(path)
    if path not in _TABLES:
        _TABLES[path] = np.array([len(b) for b in token_bytes(path)], np.int64)
    apart = pc.match_substring_regex(words, _APART)
    some = words.filter(apart)
    ids = np.array(enc.encode_ordinary("".join(some.to_pylist())), np.uint32)
    ends = np.searchsorted(np.cumsum(_TABLES[path][ids]), np.cumsum(pc.binary_length(some).to_numpy(zero_copy_only=False).astype(np.int64)), side="left") + 1
    flags = apart.to_numpy(zero_copy_only=False)
    if flags.all():
        return np.diff(ends, prepend=0), ids
    single = [np.array(enc.encode_ordinary(w), np.uint32) for w in words.filter(pc.invert(apart)).to_pylist()]
    count = np.zeros(len(words), np.int64)
    count[flags] = np.diff(ends, prepend=0)
    count[~flags] = [len(x) for x in single]
    owner, out = np.repeat(flags, count), np.zeros(int(count.sum()), np.uint32)
    out[owner], out[~owner] = ids, np.concatenate(single)
    return count, out


def spread(first: np.ndarray, count: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values of ``codes`` one after another, and where each code's values end."""
    n = count[codes]
    ends = np.cumsum(n)
    return np.repeat(first[codes] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0), ends


def compress(data: bytes) -> bytes:
    return _SQUEEZER.compress(data)


def squeeze(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers by byte planes, compressed."""
    return _SQUEEZER.compress(np.ascontiguousarray(numbers.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


@functools.cache
def _finder() -> Callable[[str], list[str]]:
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN).findall


#: Pieces of nothing but Latin letters behind at most one space: matches of the pattern as they are.
_LETTERS = "^ ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+$"


def words_of_block(texts: pa.StringArray) -> tuple[list[str], pa.DictionaryArray, pa.ListArray, list[int] | None, np.ndarray]:
    """The distinct words of texts in order of first occurrence, and what :func:`sequence_of` needs.

    No match of the pattern crosses a cut before white space, so it is applied to each distinct piece
    between such cuts once.
    """
    lists = cut_all(texts)
    pieces = lists.flatten().dictionary_encode()
    find, place, flat, count = _finder(), {}, [], []
    for piece, whole in zip(pieces.dictionary.to_pylist(), pc.match_substring_regex(pieces.dictionary, _LETTERS).to_pylist(), strict=True):
        if whole:
            count.append(1)
            flat.append(place.setdefault(piece, len(place)))
        else:
            found = find(piece)
            count.append(len(found))
            flat += [place.setdefault(w, len(place)) for w in found]
    return list(place), pieces, lists, flat, np.array(count, np.int64)


def sequence_of(pieces: pa.DictionaryArray, lists: pa.ListArray, flat: list[int], count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words of a block's texts as numbers, and how many each text has."""
    at, ends = spread(np.cumsum(count) - count, count, pieces.indices.to_numpy(zero_copy_only=False).astype(np.int64))
    edges = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    return np.array(flat, np.int64)[at], np.diff(np.concatenate([[0], ends])[edges])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Number, ids of documents, words and what else :func:`words_of_block` gives of each block of a task's texts."""
    task, n, ids, texts, size = 0, 0, [], [], 0

    def made() -> tuple:
        words, *rest = words_of_block(pa.concat_arrays(texts))
        mark = zlib.crc32("\0".join(words).encode())
        # 31 bits of the checksum, 20 of the task (blocks of one number would have to have all words alike), 12 of the block
        return mark >> 1 << 32 | (task & 0xFFFFF) << 12 | n & 0xFFF, ids, words, rest

    for batch in batches:
        if not batch.num_rows:
            continue
        task = batch.column(2)[0].as_py()
        column = pc.fill_null(batch.column(1), "")
        lengths, docs, start = pc.binary_length(column).to_pylist(), batch.column(0).to_pylist(), 0
        for i, length in enumerate(lengths):
            size += length
            if size >= BLOCK_BYTES or i + 1 == len(lengths):
                ids += docs[start : i + 1]
                texts.append(column.slice(start, i + 1 - start))
                start = i + 1
            if size >= BLOCK_BYTES:
                yield made()
                ids, texts, size, n = [], [], 0, n + 1
    if ids:
        yield made()


_WORDS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("codes", pa.binary()), ("lens", pa.binary()), ("words", pa.binary())])
_WORDS_DDL = "bucket long, block long, codes binary, lens binary, words binary"


def _distinct(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each bucket of a block's distinct words: their numbers, lengths and bytes."""
        for block, _, words, _ in _blocks(batches):
            raw = [w.encode() for w in words]
            hashes = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw)).astype(np.int64) % buckets
            order = np.argsort(hashes, kind="stable")
            edges = np.flatnonzero(np.diff(hashes[order], prepend=-1))
            rows = []
            for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
                own = [raw[i] for i in order[a:b].tolist()]
                rows.append((int(hashes[order[a]]), block, squeeze(np.diff(order[a:b], prepend=0)), squeeze(np.array([len(w) for w in own])), compress(b"".join(own))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _WORDS, strict=True)], schema=_WORDS)

    return run


_JOINED = pa.schema([("block", pa.int64()), ("codes", pa.binary()), ("lens", pa.binary()), ("ids", pa.binary())])
_JOINED_DDL = "block long, codes binary, lens binary, ids binary"


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of a block's texts: codes of words, and in ``lens`` whose they are; no ids."""
    for block, ids, _, rest in _blocks(batches):
        codes, counts = sequence_of(*rest)
        ends, start = np.cumsum(counts), 0
        while start < len(ids):
            base = int(ends[start - 1]) if start else 0
            stop = min(max(start + 1, int(np.searchsorted(ends, base + CHUNK_WORDS)) + 1), len(ids))
            row = (block, squeeze(codes[base : int(ends[stop - 1])]), _pack_ids(ids[start:stop], counts[start:stop]), None)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _JOINED, strict=True)], schema=_JOINED)
            start = stop


def _pack_ids(ids: list, counts: np.ndarray) -> bytes:
    """The ids of a chunk's documents, which of them are null, and how many words each has."""
    numbers = np.array([i or 0 for i in ids], np.int64)
    return _SQUEEZER.compress(numbers.tobytes() + counts.astype(np.int64).tobytes() + bytes(i is None for i in ids))


def _unpack_ids(data: bytes) -> tuple[list, np.ndarray]:
    raw = zstandard.decompress(data)
    n = len(raw) // 17
    numbers = np.frombuffer(raw, np.int64, 2 * n)
    return [None if null else i for i, null in zip(numbers[:n].tolist(), raw[16 * n :], strict=True)], numbers[n:]


def _strings(lens: np.ndarray, data: bytes) -> pa.StringArray:
    offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(lens), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))


def _encode_buckets(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids of the words of buckets that come one after another: each distinct word is encoded once."""
        now, known, counts, ids = None, {}, [], []  # of the words of one bucket: place, and ids one after another
        for batch in batches:
            rows = []
            for bucket, block, codes, lens, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if bucket != now:
                    now, known, counts, ids = bucket, {}, [], []
                words = _strings(unsqueeze(lens), zstandard.decompress(data)).to_pylist()
                new = [w for w in words if w not in known]
                if new:
                    known.update((w, len(counts) + i) for i, w in enumerate(new))
                    n, found = encode_words(path, pa.array(new, pa.string()))
                    counts += n.tolist()
                    ids += np.split(found, np.cumsum(n)[:-1])
                own = [known[w] for w in words]
                rows.append((block, codes, squeeze(np.array([counts[i] for i in own])), squeeze(np.concatenate([ids[i] for i in own]))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _JOINED, strict=True)], schema=_JOINED)

    return run


_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _reassemble(group: pa.Table) -> pa.Table:
    """The ids of each document of one block, by position."""
    own = group.filter(pc.is_valid(group["ids"]))
    lens, flat = (np.concatenate([unsqueeze(x) for x in own[c].to_pylist()] or [np.zeros(0, np.uint32)]) for c in ("lens", "ids"))
    code = np.concatenate([np.cumsum(unsqueeze(x), dtype=np.int64) for x in own["codes"].to_pylist()] or [np.zeros(0, np.int64)])
    lens = lens.astype(np.int64)
    first, count = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
    first[code], count[code] = np.cumsum(lens) - lens, lens
    docs, values, sizes = [], [], [np.zeros(0, np.int64)]
    rest = group.filter(pc.is_null(group["ids"]))
    for packed, seq in zip(rest["lens"].to_pylist(), rest["codes"].to_pylist(), strict=True):
        (ids, counts), codes = _unpack_ids(packed), unsqueeze(seq)
        if len(codes) and int(codes.max()) >= len(code):
            raise ValueError("the documents did not read alike twice: encode a stored table")
        at, ends = spread(first, count, codes)
        values.append(flat[at].astype(np.int32))
        docs += ids
        # ids of a text: where those of its last word end, less where those of the texts before do
        sizes.append(np.diff(np.concatenate([[0], ends])[np.cumsum(counts)], prepend=0))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32)))
    return pa.Table.from_arrays([pa.array(docs, pa.int64()), lists], schema=_ENCODED)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of each row of ``docs`` (doc_id, text), a stored table."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id())
    buckets = max(LEAST_BUCKETS, docs.rdd.getNumPartitions() // PARTITIONS_A_BUCKET)
    words = texts.mapInArrow(_distinct(buckets), _WORDS_DDL)
    encoded = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encode_buckets(path), _JOINED_DDL)
    sequences = texts.mapInArrow(_sequences, _JOINED_DDL)
    return encoded.unionByName(sequences).groupBy("block").applyInArrow(_reassemble, "doc_id long, ids array<int>")


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    values = column.values.to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    return (values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))


def decode(encoded: DataFrame, path: str, digests_only: bool = False) -> DataFrame:
    """doc_id and the bytes of each row of ``encoded`` (doc_id, ids): a join with the token-byte table.

    The table has one row a token id; every task joins it to its rows in memory. With ``digests_only``
    the rows carry n_tokens and the digests of ids and bytes in place of the bytes. Null ids decode
    to no bytes; an id outside the table is an error.
    """
    table = token_bytes(path)
    shared = encoded.sparkSession.sparkContext.broadcast(table)  # bounded by the vocabulary: 50,256 short entries
    schema = pa.schema([("doc_id", pa.int64()), *([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests_only else [("bytes", pa.binary())])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        names = [str(i) for i in range(len(pieces))]
        for batch in batches:
            docs, columns = batch.column(0), [[], [], []]
            for ids in _lists(batch.column(1)):
                ids = ids.tolist()
                body = b"".join([pieces[i] for i in ids])
                if digests_only:
                    columns[0].append(len(ids))
                    columns[1].append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
                    columns[2].append(hashlib.sha256(body).hexdigest())
                else:
                    columns[0].append(body)
            yield pa.RecordBatch.from_arrays([docs, *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:])]], schema=schema)  # noqa: B905

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests_only else "doc_id long, bytes binary"
    filled = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return filled.mapInArrow(run, ddl)


# ----------------------------------------------------------------------------------------------
def op1_byte_bpe(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decode(encode(docs, path), path, digests_only=True)


QUERIES = {"op1_byte_bpe": op1_byte_bpe}
ORACLES: dict[str, str] = {}
