"""Quality: a compression classifier.

Two zstandard dictionaries hold text labelled good and text labelled bad. A text is compressed block by
block with the good dictionary, the bad one and none, so that the dictionaries matter to the end of a
long text too. The differences of these sizes, divided by the size without a dictionary and by the
length, over the whole text and as extremes and median of its blocks, become a score by a logistic
calibration; nothing but such differences goes into it.

Training uses a bounded sample of labelled rows outside the held-out fold (``PER_CLASS`` rows of a
class, texts of at most ``MAX_CHARS`` code points). Dictionaries hold whole texts of it, in order of the
sample, as many as ``DICTIONARY_BYTES`` take; for the calibration each half of the rows is measured with
dictionaries of the other half, the final ones are of all rows. Scoring compresses every whole text.

Defined cases: a null or empty text is calibrated like any other (its sizes are those of empty frames);
repeated rows are scored row by row; without labelled rows of both classes every score is 0.5 (so
``predicted`` is 1); an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from piiguard.llm.common import held_out, labelled_sample, released, table
from piiguard.llm.toxicity import calibrate

PER_CLASS = 2000
MAX_CHARS = 60_000
#: Most bytes of a dictionary, and bytes of a block.
DICTIONARY_BYTES = 1 << 20
BLOCK_BYTES = 1024
#: Blocks of fewer bytes do not count among a text's extremes if it has longer ones.
LEAST_BYTES = 128
LEVEL = 6
THRESHOLD = 0.3


def compressors(good: bytes, bad: bytes) -> tuple:
    def make(d: bytes) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if d else None
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False)

    return make(good), make(bad), make(b"")


def block_sizes(text: bytes, tools: tuple) -> np.ndarray:
    """A row for each block: compressed sizes (good, bad, no dictionary) and bytes."""
    blocks = [text[i : i + BLOCK_BYTES] for i in range(0, max(len(text), 1), BLOCK_BYTES)]
    return np.array([[*(len(t.compress(b)) for t in tools), len(b)] for b in blocks], np.float64)


def _differences(sizes: np.ndarray) -> np.ndarray:
    """The three differences of sizes (..., 4), normalised by compressed size and by length."""
    good, bad, plain, n = np.moveaxis(sizes, -1, 0)
    n = np.maximum(n, 1)
    return np.stack([d / by for by in (plain, n) for d in (bad - good, plain - good, plain - bad)], -1)


def inputs(texts: list[np.ndarray]) -> np.ndarray:
    """A row for each text's block sizes: its differences, those of its blocks, their roots and squares."""
    rows = []
    for sizes in texts:
        n = sizes[:, 3]
        own = _differences(sizes[n >= min(LEAST_BYTES, n.max())])
        rows.append([*_differences(sizes.sum(0)), own[:, 0].max(), own[:, 0].min(), np.median(own[:, 0]), own[:, 3].max(), own[:, 3].min()])
    x = np.array(rows, np.float64).reshape(len(rows), 11)
    return np.concatenate([x, np.sign(x) * np.sqrt(np.abs(x)), x * x, np.ones((len(x), 1))], 1)


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    coefficients: tuple[float, ...]

    def score(self, texts: pa.Array, cache: dict) -> np.ndarray:
        """The score of each text, one at a time; null is empty."""
        if not self.coefficients:
            return np.full(len(texts), 0.5)
        if "c" not in cache:
            cache["c"] = compressors(self.good, self.bad)
        sizes = [block_sizes((t.as_py() or "").encode("utf-8", "replace"), cache["c"]) for t in texts]
        z = inputs(sizes) @ np.array(self.coefficients)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _dictionary(texts: list[bytes]) -> bytes:
    """Whole texts in order, as many as fit; those that do not fit are passed over."""
    out, size = [], 0
    for t in texts:
        if size + len(t) + 1 <= DICTIONARY_BYTES:
            out.append(t)
            size += len(t) + 1
    return b"\n".join(out)


def train(sample: list[tuple[str, int, float]]) -> Model:
    """The calibration across two halves, and dictionaries of all rows."""
    if len({y for _, y, _ in sample}) < 2:
        return Model(b"", b"", ())
    rows = [(t.encode("utf-8", "replace"), y, w) for t, y, w in sample]
    # both classes are dealt out by themselves, so that each half has its share
    half = {i: n % 2 for y in (0, 1) for n, i in enumerate(i for i, r in enumerate(rows) if r[1] == y)}

    def dictionaries(kept: list) -> list[bytes]:
        return [_dictionary([t for t, y, _ in kept if y == label]) for label in (1, 0)]

    sizes: list = [None] * len(rows)
    for side in (0, 1):
        tools = compressors(*dictionaries([r for i, r in enumerate(rows) if half[i] != side]))
        for i, (t, _, _) in enumerate(rows):
            if half[i] == side:
                sizes[i] = block_sizes(t, tools)
    theta = calibrate(inputs(sizes), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    return Model(*dictionaries(rows), tuple(theta.tolist()))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return train(labelled_sample(docs, labels, "quality", PER_CLASS, MAX_CHARS))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in released(batches):
            scores = shared.value.score(batch.column(1), cache)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


# ----------------------------------------------------------------------------------------------
def op4_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
ORACLES: dict[str, str] = {}
