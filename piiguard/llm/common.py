"""Shared plumbing of the corpus operators: words, the held-out fold, training samples, freed memory."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from piiguard.shared import clean_up, materialize, shared_dir

__all__ = ["clean_up", "held_out", "labelled_sample", "materialize", "released", "shared_dir", "table", "words_of"]

#: Words are maximal runs of anything but these ASCII white-space characters.
SEPARATORS = " \t\n\x0b\f\r"
SEPARATOR_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; what Arrow keeps of freed ones goes back to the system, as workers stay on."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


def words_of(text: Column) -> Column:
    """The array of words of a text; empty for a null or blank one."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SEPARATOR_CLASS + "+"))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int) -> list[tuple[str, int, float]]:
    """A bounded training sample: (text, label, weight) of at most ``per_class`` rows a class.

    Rows are those with the least hashes of doc_id outside the held-out fold, so the choice does
    not depend on partitioning. Texts above ``max_chars`` code points are left out of training
    (never of scoring). Weights restore the class sizes. Null ids, labels and texts are ignored; of
    several labels of an id the greatest counts, of several texts the least.
    """
    lab = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    lab = lab.groupBy("doc_id").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return []
    picks = [lab.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in sorted(sizes)]
    pick = picks[0]
    for other in picks[1:]:
        pick = pick.unionByName(other)
    # the sample has at most 2 * per_class rows of two numbers
    rows = (
        docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
        .join(F.broadcast(pick), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    got = {y: sum(r["y"] == y for r in rows) for y in sizes}
    return [(r["text"], r["y"], sizes[r["y"]] / max(got[r["y"]], 1)) for r in rows]
