"""Alignment of two tokenizers over a corpus: groups of tokens with common ends, and counts of linked id pairs.

A is a byte-level BPE over space+text, B a piece BPE that adds the space itself. Where A and B tokens end at one
byte the text is cut into groups; an A and a B token are linked where their bytes overlap. Between two neighbouring
ends of either there is one token of each, so links are the stretches between neighbouring ends of A or B.

Both tokenizers work on stretches: neither has a token that reaches over the place before a space behind a
non-space character (B's pieces have their spaces in front, which is checked; A's pattern starts a match there). So
blocks of texts are cut at these places, and each distinct segment of a block is tokenized, aligned and counted once.

Counting: a link's key packs both ids into 64 bits, B's above A's. Tasks sum up their keys by ``np.unique`` in bounded
tables; the partial counts are stored, range-partitioned by key and sorted, and runs of a key are summed. Each task
writes its range as a shard: its keys, then its counts, in order. As all keys of a B id follow each other, the highest
count of each B id is taken from the shards' ranges; that table is bounded by B's vocabulary and is broadcast.

Lookup: the texts are read again; each block looks up its distinct keys in the shards by ``np.searchsorted``. Shards
on a mounted shared folder are memory-mapped, so a task pages in what it touches; from other stores a task
reads the shards it needs, and keeps at most ``CACHE_BYTES`` of them.

Defined cases: texts that are null or empty, or whose joined B bytes are not space+text (B writes U+2581 as a space),
have no tokens: zeros and an empty column; strings of special tokens are plain text; repeated rows count and
are kept row by row; very long texts make blocks of their own; an empty table gives an empty table; extra columns
are not read.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from piiguard.llm.common import materialize, released, shared_dir
from piiguard.llm.tokens import encode_words, token_bytes
from piiguard.shared import open_folder

#: Bytes of text that are tokenized at once (the text that crosses it included).
BLOCK_BYTES = 4 << 20
#: Distinct keys of a task's table of counts, at which it is sent on; and bytes of shards a task keeps that are not mapped.
TABLE_KEYS = 1 << 21
CACHE_BYTES = 256 << 20
#: Segments that are joined for a call of the piece model.
JOINED_SEGMENTS = 2048
#: The mark that stands for a space in pieces.
SPACE_MARK = "▁"


@functools.cache
def _pieces(path: str):
    """The processor of a piece model, the bytes of each id, their lengths, and the id of the lone space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(SPACE_MARK in n.lstrip(SPACE_MARK) for n in names):
        raise ValueError("a piece goes on behind a space: segments can't be tokenized apart")
    table = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace(SPACE_MARK, " ").encode() for i, n in enumerate(names)]
    return model, pa.array(table, pa.large_binary()), np.array([len(b) for b in table], np.int64), model.piece_to_id(SPACE_MARK)


@functools.cache
def _names(path_a: str, path_b: str) -> tuple[pa.LargeStringArray, int]:
    """Decimal ids with what follows them: A's before a comma and a bar, then B's before a comma and a semicolon; A's number."""
    n, m = len(_lengths(path_a)), len(_pieces(path_b)[2])
    return pa.array([f"{i}{mark}" for size, marks in ((n, ",|"), (m, ",;")) for mark in marks for i in range(size)], pa.large_string()), n


def _raw(texts: pa.Array) -> np.ndarray:
    """The bytes of texts one after another."""
    wide = texts.cast(pa.large_binary())
    at = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    return np.frombuffer(wide.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if len(wide) else np.zeros(0, np.uint8)


def _encode_pieces(path: str, segments_: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """How many ids of the piece model each segment has, and all ids in order; segments start with a space.

    Segments that end in no space are joined for a call, as none of their tokens reaches into the next.
    """
    model, _, lengths, space = _pieces(path)
    alone = pc.or_(pc.ends_with(segments_, " "), pc.match_substring(segments_, SPACE_MARK))  # the mark changes lengths
    words = segments_.filter(pc.invert(alone))
    texts, size = words.to_pylist(), pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = ["".join(texts[i : i + JOINED_SEGMENTS])[1:] for i in range(0, len(texts), JOINED_SEGMENTS)]
    ids = np.array([i for found in model.encode(joined, num_threads=1) for i in found], np.int64)
    ends = np.searchsorted(np.cumsum(lengths[ids]), np.cumsum(size), side="left") + 1
    flags = alone.to_numpy(zero_copy_only=False)
    if not flags.any():
        return np.diff(ends, prepend=0), ids
    single = [b or [space] for b in model.encode([w[1:] for w in segments_.filter(alone).to_pylist()], num_threads=1)]  # the added space alone is no token to the model
    count = np.zeros(len(flags), np.int64)
    count[~flags], count[flags] = np.diff(ends, prepend=0), [len(b) for b in single]
    owner, out = np.repeat(flags, count), np.zeros(int(count.sum()), np.int64)
    out[~owner], out[owner] = ids, [i for b in single for i in b]
    return count, out


@functools.cache
def _lengths(path: str) -> np.ndarray:
    return np.array([len(b) for b in token_bytes(path)], np.int64)


#: A place that no token of A or B reaches over: before a space, behind a character that is no white space.
_PLACE = regex.compile(r"(?V1)(?<=[^\s\x1c-\x1f])(?= )")
#: White space before a space, where not every space starts a segment, and the mark of cuts.
_RUNS = "[\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}] |\\x00"


def segments(texts: pa.StringArray) -> pa.ListArray:
    """The segments of space+text of each text."""
    spaced = pc.binary_join_element_wise("", texts, " ")
    runs = pc.match_substring_regex(spaced, _RUNS)
    # the first space starts the text, so the first part of the split is empty and is left out
    plain = pc.list_slice(pc.split_pattern(pc.replace_substring(spaced, " ", "\x00 "), "\x00"), 1)
    if not pc.any(runs).as_py():
        return plain
    return pa.array([_PLACE.split(t) if r else p for t, r, p in zip(spaced.to_pylist(), runs.to_pylist(), plain.to_pylist(), strict=True)], pa.list_(pa.string()))


class Aligned:
    """Distinct segments of a block, tokenized by both and linked; those whose bytes B changes have no links."""

    def __init__(self, path_a: str, path_b: str, distinct: pa.StringArray):
        _, table, lengths_b, _ = _pieces(path_b)
        count_b, self.b = _encode_pieces(path_b, distinct)
        size = pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
        self.same = np.ones(len(distinct), bool)
        made = table.take(pa.array(self.b))
        if not np.array_equal(_raw(made), _raw(distinct)):
            edges = np.concatenate([[0], np.cumsum(count_b)]).tolist()
            self.same = np.array([b"".join(made[a:b].to_pylist()) == w.encode() for a, b, w in zip(edges, edges[1:], distinct.to_pylist(), strict=False)], bool)
            self.b, count_b, size, distinct = self.b[np.repeat(self.same, count_b)], count_b[self.same], size[self.same], distinct.filter(pa.array(self.same))
        count_a, self.a = encode_words(path_a, distinct)
        ends_a, ends_b = np.cumsum(_lengths(path_a)[self.a]), np.cumsum(lengths_b[self.b])
        if len(distinct) and ends_a[-1] != ends_b[-1]:
            raise ValueError("the byte-level tokens do not join to the text")
        # ends of links: each is an end of A or of B, or of both, where a group ends
        is_a, is_b = (np.zeros(int(size.sum()) + 1, bool) for _ in range(2))
        is_a[ends_a], is_b[ends_b] = True, True
        ends = np.flatnonzero(is_a | is_b)
        self.common = (is_a & is_b)[ends]
        self.at_a = np.cumsum(is_a[ends]) - is_a[ends]
        self.at_b = np.cumsum(is_b[ends]) - is_b[ends]
        self.keys = self.b[self.at_b] << np.int64(32) | self.a[self.at_a].astype(np.int64)
        #: Place of each distinct segment among those with tokens, and how many A and B tokens, links and groups these have.
        self.place = np.cumsum(self.same) - 1
        self.last = np.searchsorted(ends, np.cumsum(size), side="right")  # links up to the end of each segment
        self.n_a, self.n_b = count_a.astype(np.int64), count_b
        self.n_links = np.diff(self.last, prepend=0)
        self.n_groups = self.per_segment(self.common)
        self.paths = path_a, path_b

    def per_segment(self, of_link: np.ndarray) -> np.ndarray:
        """Sums over the links of each segment."""
        sums = np.concatenate([[0], np.cumsum(of_link, dtype=np.int64)])
        return np.diff(sums[self.last], prepend=0)

    def texts(self) -> pa.LargeStringArray:
        """The groups of each segment: A ids, a bar and B ids, each group followed by a semicolon.

        The names of all ids, with what follows each, are put in the order of the groups; a segment is a stretch of them.
        """
        names, n = _names(*self.paths)
        last_a, last_b = self.at_a[self.common], self.at_b[self.common]  # of each group
        code_a, code_b = self.a.astype(np.int64), self.b + 2 * n
        code_a[last_a] += n
        code_b[last_b] += (len(names) - 2 * n) // 2
        of_a = np.searchsorted(last_a, np.arange(len(code_a)))
        of_b = np.searchsorted(last_b, np.arange(len(code_b)))
        order = np.zeros(len(code_a) + len(code_b), np.int64)
        order[np.arange(len(code_a)) + np.concatenate([[0], last_b + 1])[of_a]] = code_a
        order[np.arange(len(code_b)) + last_a[of_b] + 1] = code_b
        put = names.take(pa.array(order))
        offsets = np.frombuffer(put.buffers()[1], np.int64)[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        return pa.LargeStringArray.from_buffers(len(self.n_a), pa.py_buffer(offsets.tobytes()), put.buffers()[2])


def _blocks(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[tuple]:
    """doc_ids of a block's rows, its aligned segments, their numbers text after text, where texts end, which have tokens."""
    for batch in released(batches):
        texts = pc.fill_null(batch.column(1), "")
        ends, start = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while start < len(texts):
            base = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + BLOCK_BYTES)))
            part = texts.slice(start, stop - start)
            lists = segments(part)
            words = lists.flatten().dictionary_encode()
            codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            edges = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            aligned = Aligned(path_a, path_b, words.dictionary)
            wrong = np.concatenate([[0], np.cumsum(~aligned.same[codes])])
            able = (np.diff(wrong[edges]) == 0) & (pc.binary_length(part).to_numpy(zero_copy_only=False) > 0)
            yield batch.column(0).slice(start, stop - start), aligned, codes, edges, able
            start = stop


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    unique, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(unique), np.int64)
    np.add.at(total, at, np.concatenate(counts))
    return unique, total


_COUNTS = pa.schema([("key", pa.int64()), ("n", pa.int64())])


def partial_counts(docs: DataFrame, path_a: str, path_b: str, table_keys: int = TABLE_KEYS) -> DataFrame:
    """key and n: counts of links by packed ids, as far as each task has summed them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def sent() -> pa.RecordBatch:
            unique, total = _merged(keys, counts)
            return pa.RecordBatch.from_arrays([pa.array(unique), pa.array(total)], schema=_COUNTS)

        for _, aligned, codes, edges, able in _blocks(batches, path_a, path_b):
            used = np.repeat(able, np.diff(edges))
            times = np.bincount(aligned.place[codes[used]], minlength=int(aligned.same.sum()))
            keys.append(aligned.keys)
            counts.append(np.repeat(times, aligned.n_links))
            some = counts[-1] > 0
            keys[-1], counts[-1] = keys[-1][some], counts[-1][some]
            held += len(keys[-1])
            if held >= table_keys:
                unique, total = _merged(keys, counts)
                keys, counts, held = [unique], [total], len(unique)
                if 2 * held >= table_keys:
                    yield sent()
                    keys, counts, held = [], [], 0
        if held:
            yield sent()

    return docs.select("doc_id", "text").mapInArrow(run, "key long, n long")


def write_shards(partial: DataFrame, folder: str) -> DataFrame:
    """Sum up partial counts by a global sort and write a shard a task below ``folder``.

    Returns a row a shard: its path, first and last key, n keys, and the highest count of each B id in it.
    """
    files, root = open_folder(folder)
    files.create_dir(f"{root}/shards", recursive=True)
    schema = pa.schema([("path", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("n", pa.int64()), ("b", pa.list_(pa.int64())), ("best", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, open_key, open_n = [], [], None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            k, n = (c.to_numpy() for c in batch.columns)
            starts = np.flatnonzero(np.diff(k, prepend=k[0] - 1))
            runs, sums = k[starts], np.add.reduceat(n, starts)
            if open_key == runs[0]:
                sums[0] += open_n
            elif open_key is not None:
                runs, sums = np.append(open_key, runs), np.append(open_n, sums)
            open_key, open_n = int(runs[-1]), int(sums[-1])  # goes on in the next batch, perhaps
            keys.append(runs[:-1])
            counts.append(sums[:-1])
        if open_key is None:
            return
        keys, counts = np.append(np.concatenate(keys), open_key).astype("<i8"), np.append(np.concatenate(counts), open_n).astype("<i8")
        own, base = open_folder(folder)
        name = f"shards/{uuid.uuid4().hex}.bin"
        with own.open_output_stream(f"{base}/{name}", compression=None) as out:
            out.write(keys.tobytes())
            out.write(counts.tobytes())
        ids = keys >> 32
        starts = np.flatnonzero(np.diff(ids, prepend=-1))
        row = (name, int(keys[0]), int(keys[-1]), len(keys), ids[starts], np.maximum.reduceat(counts, starts))
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    ordered = partial.repartitionByRange("key").sortWithinPartitions("key")
    return materialize(ordered.mapInArrow(run, "path string, first long, last long, n long, b array<long>, best array<long>"), "counts")


class Shards:
    """Sorted shards of counts below a shared folder, looked up by key."""

    def __init__(self, folder: str, rows: list[tuple]):
        self.files, self.base = open_folder(folder)
        self.rows, self.last, self.kept, self.held = sorted(rows, key=lambda r: r[1]), None, {}, 0
        self.last = np.array([r[2] for r in self.rows], np.int64)

    def _open(self, at: int) -> np.ndarray:
        path, n = f"{self.base}/{self.rows[at][0]}", self.rows[at][3]
        if at not in self.kept:
            if isinstance(self.files, fs.LocalFileSystem):
                self.kept[at] = np.memmap(path, "<i8", "r", shape=(2, n))
            else:
                while self.kept and self.held + 16 * n > CACHE_BYTES:
                    self.held -= self.kept.pop(next(iter(self.kept))).nbytes
                with self.files.open_input_stream(path, compression=None) as source:
                    self.kept[at] = np.frombuffer(source.read(), "<i8").reshape(2, n)
                self.held += 16 * n
        return self.kept[at]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The count of each of sorted ``keys``; a key that no shard holds is an error."""
        found = np.zeros(len(keys), np.int64)
        owner = np.searchsorted(self.last, keys)
        edges = np.flatnonzero(np.diff(owner, prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(keys)], strict=False):
            if owner[a] == len(self.rows):
                raise ValueError("a pair of ids was not counted: align a stored table")
            shard = self._open(int(owner[a]))
            at = np.searchsorted(shard[0], keys[a:b])
            if (shard[0][at] != keys[a:b]).any():
                raise ValueError("a pair of ids was not counted: align a stored table")
            found[a:b] = shard[1][at]
        return found


_RESULT = pa.schema([*[(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", pa.string())])


def align(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """Sizes, corpus-wide counts and the digest of groups of each row of ``docs`` (doc_id, text), a stored table.

    ``with_groups`` adds the groups' text itself.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = write_shards(materialize(partial_counts(docs, path_a, path_b), "partial"), folder)
    places = [tuple(r) for r in shards.select("path", "first", "last", "n").collect()]  # a row a shard
    highest = shards.select(F.explode(F.arrays_zip("b", "best")).alias("x")).groupBy("x.b").agg(F.max("x.best").alias("best")).toArrow()
    best = np.zeros(int(pc.max(highest["b"]).as_py() or 0) + 1, np.int64)  # at most B's vocabulary
    best[highest["b"].to_numpy()] = highest["best"].to_numpy()
    shared = spark.sparkContext.broadcast((places, best))
    schema = pa.schema([*_RESULT, *[("groups", pa.string())] * with_groups])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, best = shared.value
        counted = Shards(folder, places)
        for doc_ids, aligned, codes, edges, able in _blocks(batches, path_a, path_b):
            # a segment without tokens, or of none but texts without, has no counts; its links are not looked up
            used = np.zeros(int(aligned.same.sum()), bool)
            used[aligned.place[codes[np.repeat(able, np.diff(edges))]]] = True
            looked = np.repeat(used, aligned.n_links)
            keys, at = np.unique(aligned.keys[looked], return_inverse=True)
            counts = np.zeros(len(aligned.keys), np.int64)
            counts[looked] = counted.counts(keys)[at]
            highest = looked & (counts == best[np.minimum(aligned.keys >> 32, len(best) - 1)])
            facts = np.stack([aligned.n_a, aligned.n_b, aligned.n_groups, aligned.n_links, aligned.per_segment(highest), aligned.per_segment(counts)])
            known = aligned.same[codes]
            place = np.where(known, aligned.place[codes], 0)
            each = np.where(known, facts[:, place], 0) if facts.shape[1] else np.zeros((6, len(codes)), np.int64)
            sums = np.diff(np.concatenate([np.zeros((6, 1), np.int64), each.cumsum(1)], 1)[:, edges], axis=1) * able
            whole = aligned.texts().take(pa.array(place, mask=~known))
            at, data = np.frombuffer(whole.buffers()[1], np.int64)[edges].tolist(), memoryview(whole.buffers()[2] or b"")
            groups = [data[a : b - 1] if ok else data[:0] for ok, a, b in zip(able.tolist(), at, at[1:], strict=False)]
            digests = [hashlib.sha256(g).hexdigest() if len(g) else "" for g in groups]
            columns = [doc_ids, *[pa.array(s) for s in sums], pa.array(digests, pa.string()), *[pa.array([str(g, "ascii") for g in groups], pa.string()) for _ in range(with_groups)]]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ddl = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in schema)
    return docs.mapInArrow(run, ddl)


# ----------------------------------------------------------------------------------------------
def op11_alignment(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op11_alignment": op11_alignment}
ORACLES: dict[str, str] = {}
