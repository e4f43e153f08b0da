"""Quality rules: edge cases, very long texts, the threshold table."""

from piiguard.llm import quality_rules as Q


def test_edge_cases(spark):
    text = "the cat of the house and the dog of the garden are in the sun with a friend who is not here "
    rows = [(1, text, 0, "a"), (1, text, 0, "a"), (None, text, 0, "b"), (2, None, 0, "c"), (3, " \n\t ", 0, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept string")
    got = [(r["doc_id"], r["n_words"], r["base_failed"]) for r in Q.measure(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, 22, False)] * 2 + [(None, 22, False), (2, 0, True), (3, 0, True)]))
    kept = Q.keep(docs)
    assert kept.columns == docs.columns and kept.count() == 3
    assert Q.measure(docs.where("doc_id = 9")).count() == 0 and Q.keep(docs.where("doc_id = 9")).count() == 0


def test_very_long_texts_are_judged_by_their_ratios(spark):
    long = " ".join(f"the w{i} of a{i * 7 % 1000003} and" for i in range(250_000))
    row = Q.measure(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert row["n_words"] == 1_250_000 and row["n_repeat_words"] == 0 and row["kept"]


def test_a_table_of_rules(spark):
    docs = spark.createDataFrame([(1, "one two three " * 10)], "doc_id long, text string")
    none = Q.measure(docs, (Q.Rule("x", "symbol_ratio", 0.0, 0.0),)).first()
    some = Q.measure(docs, (Q.Rule("x", "mean_word_chars", 9.0, None),)).first()
    assert none["failed_rules"] == [] and some["failed_rules"] == ["x"] and not some["kept"]
