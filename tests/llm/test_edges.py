"""Edge cases of WARC, packing and the pipeline: empty tables, nulls, repeated rows, clashing columns."""

from types import SimpleNamespace

import pyarrow as pa
import pytest

import corpus_pipeline
from piiguard.llm import packing, warc
from piiguard.llm.common import shared_dir


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_warc_edges(spark):
    rows = [(None, "u", "a", 1), (None, "u", "a", 1), (3, None, None, 1), (3, None, None, 1), (4, "u", "x" * 3_000_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, bytes int")
    folder = shared_dir(spark)
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"]) for r in warc.read(warc.write(pages, folder), folder).collect())
    assert got == sorted([("None", 1, "response")] * 2 + [("3", 0, "response")] * 2 + [("4", 3_000_000, "response")])
    folder = shared_dir(spark)
    assert warc.read(warc.write(pages.where("page_id = 9"), folder), folder).count() == 0


def test_packing_edges(spark, path):
    rows = [(None, "a b", 1), (7, "same text", 1), (7, "same text", 1), (8, None, 1)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, length int"), path).collect()
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
    assert sum(r["doc_tokens"] == 1 and r["length"] == 1 for r in got if r["doc_id"] == 8) == 1
    per = [sum(r["length"] for r in got if r["doc_id"] == i) for i in (None, 7)]
    assert per[0] == next(r["doc_tokens"] for r in got if r["doc_id"] is None) and per[1] == 2 * next(r["doc_tokens"] for r in got if r["doc_id"] == 7)


def test_packing_in_slices(path, monkeypatch):
    texts = pa.array(["one two", "", "three  four <|endoftext|> x", "y" * 50])
    whole = [x.tolist() for x in packing.tokenize(path, texts)]
    assert whole == [x.tolist() for t in texts for x in packing.tokenize(path, pa.array([t.as_py()]))]


def test_packing_tokenizes_little_at_a_time(path, monkeypatch):
    """What a worker holds beside its batch is of a slice of 1 MB at most, or of one longer text."""
    texts, seen, tokenize = [None, "word " * 60_000] * 6 + ["word " * 300_000, ""], [], packing.tokenize
    monkeypatch.setattr(packing, "tokenize", lambda p, part: seen.append(part.to_pylist()) or tokenize(p, part))
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "_task", "_rank")])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    got = pa.Table.from_batches(packing._pieces(path, False, schema)(iter([batch])))
    assert [t for part in seen for t in part] == [t or "" for t in texts]
    assert all(sum(map(len, part)) <= 1 << 20 or len(part) == 1 for part in seen)
    assert sum(got["length"].to_pylist()) == sum(len(x) for x in tokenize(path, pa.array([t or "" for t in texts])))


def test_pipeline_keeps_columns_and_takes_odd_rows(spark, tmp_path):
    text = "the cat of the house and the dog of the garden are in the sun with a friend who is not here at the end of it "
    rows = [(1, text, "en", "s", 9, "k"), (2, text, "en", "s", 9, "k"), (None, text, None, None, None, "k"), (3, None, "en", "s", 0, "k"), (4, "", "en", "s", 0, "k"), (5, text + "but " + " ".join(f"the w{i}" for i in range(90)), "en", "s", 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, kept string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, str(tmp_path))
        assert current.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in current.collect()) == ["1", "5", "None"]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {str(r["doc_id"]) for r in pieces} == {"1", "5", "None"}
    for name in ("documents", "labels"):
        table = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        table.where("doc_id = -1").write.parquet(f"{tmp_path}/empty/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_warc_spreads_hot_payloads(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT_ROWS", 5)
    rows = [(i, "u", "hot" if i < 400 else f"page {i // 2}", "x") for i in range(600)] + [(None, "u", "hot", "x"), (700, "u", None, "x"), (701, "u", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _first string").repartition(5)
    got = {(r["page_id"], r["_revisit"], r["_refers"]) for r in warc.mark_revisits(pages).collect()}
    last = {}
    for i, _, body, _ in rows:
        last[body or ""] = max(last.get(body or "", -1), -1 if i is None else i)
    assert got == {(i, i != last[b or ""], last[b or ""] if i != last[b or ""] else None) for i, _, b, _ in rows}
