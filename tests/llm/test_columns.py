"""No stage of the pipeline changes columns that the caller has besides the documents' own."""

import corpus_pipeline
from piiguard.llm import near_dedup

EXTRA = ["_key", "_null", "_id", "_first", "_row", "kept", "_doc", "_blank", "_place", "key", "rep", "comp"]


def test_extra_columns_pass_all_stages_unchanged(spark):
    words = "the river of a stone and the house in a garden with more words to read for all of us here today {} again {}"
    rows = [(i, words.format(i, i * 7) if i % 3 else words.format(0, 1), "en", "web", 1) for i in range(30)] + [(40, None, "en", "web", 1), (None, words, "en", "web", 1), (None, words, "en", "web", 1)]
    table = spark.createDataFrame([(*r, *[f"{c}{n}" for c in EXTRA]) for n, r in enumerate(rows)], ", ".join(["doc_id long, text string, lang string, source string, n_chars int", *[f"`{c}` string" for c in EXTRA]]))
    docs = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == table.columns, name
        before, after = docs.collect(), out.collect()
        assert after and set(map(repr, after)) <= set(map(repr, before)), name
        docs = out
    kept = {r["doc_id"] for r in near_dedup.keep(table).collect()}
    assert kept == {r["doc_id"] for r in near_dedup.components(table).where("kept").collect()}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").columns[:7] == "doc_id start length ids_crc32 doc_tokens sequence_id offset".split()
