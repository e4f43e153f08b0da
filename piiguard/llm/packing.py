"""Packing by power-of-two decomposition: no sequence crosses documents.

Each document's ids and its end id are cut into as many full sequences as fit and then into pieces
of descending powers of two. Every piece is a sequence of its own; as its length is a power of two
it needs no padding. Pieces of equal lengths are bucketed: their sequence ids are consecutive.

Ids come from the byte-level BPE; of the texts tokenized together each distinct word is encoded once,
as its ids do not depend on its neighbours (see :mod:`piiguard.llm.tokens`). Texts are first cut at the
added tokens of the tokenizer's JSON file, which have ids of their own.

Defined cases: a null or empty text is the end id alone, one piece of length 1; repeated rows are
packed row by row; pieces of very long texts are many rows of at most ``SEQUENCE`` ids; an empty table
gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from piiguard.llm.common import materialize, released
from piiguard.llm.tokens import cut_all, encode_words, spread

SEQUENCE = 1024
END_ID = 0
#: Bytes of text that are tokenized at once; a longer text alone.
SLICE_BYTES = 1 << 20


def decompose(n: int, top: int = SEQUENCE) -> list[int]:
    """Lengths of the pieces of ``n`` ids: full sequences, then the binary digits of the rest."""
    rest = n % top
    return [top] * (n // top) + [1 << b for b in range(top.bit_length() - 2, -1, -1) if rest >> b & 1]


@functools.cache
def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of the JSON file beside a rank file, longest first."""
    with open(os.path.splitext(path)[0] + ".json", encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens that take in or need neighbours are not supported")
    return {t["content"]: t["id"] for t in sorted(added, key=lambda t: -len(t["content"]))}


def tokenize(path: str, texts: pa.StringArray) -> list[np.ndarray]:
    """Ids of many texts, each followed by the end id; each distinct word is encoded once."""
    added = added_tokens(path)
    holds = np.zeros(len(texts), bool)
    for token in added:
        holds |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
    end = np.array([END_ID], np.uint32)
    plain = iter(_ids(path, texts.filter(pa.array(~holds))))
    if not holds.any():
        return [np.concatenate([x, end]) for x in plain]
    cuts = [re.split("(" + "|".join(map(re.escape, added)) + ")", t) for t in texts.filter(pa.array(holds)).to_pylist()]
    between = iter(_ids(path, pa.array([p for parts in cuts for p in parts[::2]], pa.string())))
    joined = iter([np.concatenate([np.array([added[p]], np.uint32) if i % 2 else next(between) for i, p in enumerate(parts)]) for parts in cuts])
    return [np.concatenate([next(joined if h else plain), end]) for h in holds.tolist()]


def _ids(path: str, texts: pa.StringArray) -> list[np.ndarray]:
    """Ids of texts without added tokens."""
    lists = cut_all(texts)
    words = lists.flatten().dictionary_encode()
    count, flat = encode_words(path, words.dictionary)
    at, ends = spread(np.cumsum(count) - count, count, words.indices.to_numpy(zero_copy_only=False))
    tokens, edges = flat[at], np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    bounds = np.concatenate([[0], ends])[edges]
    return [tokens[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _pieces(path: str, with_ids: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ranks = TaskContext.get().partitionId(), {}
        for batch in released(batches):
            texts = batch.column(1)
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < len(texts):
                base = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
                rows, part = [], pc.fill_null(texts.slice(start, stop - start), "")  # no second copy of the batch
                for doc, ids in zip(batch.column(0).slice(start, stop - start).to_pylist(), tokenize(path, part), strict=True):
                    at = 0
                    for length in decompose(len(ids)):
                        rank = ranks.get(length, 0)
                        ranks[length] = rank + 1
                        piece = ids[at : at + length]
                        row = (doc, at, length, zlib.crc32(piece.astype("<u4", copy=False)), len(ids), task, rank)
                        rows.append((*row, piece.astype(np.int32)) if with_ids else row)
                        at += length
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                start = stop

    return run


def pack(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """The pieces of each row of ``docs`` (doc_id, text); ``with_ids`` adds their ids."""
    fields = [(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "_task", "_rank")]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)
    ddl = ", ".join(f"{c} long" for c, _ in fields) + ", ids array<int>" * with_ids
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(path, with_ids, schema), ddl)
    pieces = materialize(made, "pieces")
    counts = pieces.groupBy("length", "_task").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.select("length", "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_inside"))
    # eleven lengths at most: one row each
    totals = pieces.groupBy("length").agg(F.count("*").alias("_total"))
    above = Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("length", F.coalesce(F.sum("_total").over(above), F.lit(0)).alias("_base"))
    offsets = inside.join(F.broadcast(bases), "length").select("length", "_task", (F.col("_base") + F.col("_inside")).alias("_offset"))
    out = pieces.join(offsets, ["length", "_task"])
    return out.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_offset") + F.col("_rank")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *["ids"] * with_ids
    )


# ----------------------------------------------------------------------------------------------
def op9_packing(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=False)


QUERIES = {"op9_packing": op9_packing}
ORACLES: dict[str, str] = {}
