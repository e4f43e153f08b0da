"""Near-dedup: big buckets of unlinked members, several cells, edge cases; the shared folder."""

import random

import pytest
from piiguard import shared
from piiguard.llm import common, near_dedup as N


def test_a_bucket_of_many_unlinked_members(spark):
    """Members of one bucket, most of them unlinked, several chunks a side: all pairs of different components meet."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(700):  # 60 % common words, the rest of one's own: never linked, but sharing bands
        texts[i] = " ".join(words[:36] + [f"x{i}_{j}" for j in range(24)])
    for i in range(700, 760):  # near one of them
        t = texts[rng.randrange(700)].split()
        t[-1] = f"y{i}"
        texts[i] = " ".join(t)
    shingles = {i: {tuple(t.split()[j : j + 5]) for j in range(56)} for i, t in texts.items()}
    label = {i: i for i in texts}
    for a in range(760):
        for b in range(max(a + 1, 700), 760):
            both = len(shingles[a] & shingles[b])
            if 100 * both >= 75 * (112 - both):
                label[b] = min(label[b], label[a])
    rows = N.components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    changed = True
    while changed:  # names of names
        changed = False
        for i in label:
            if label[label[i]] != label[i]:
                label[i], changed = label[label[i]], True
    assert {r["doc_id"]: r["component_id"] for r in rows} == label


def test_cells_of_more_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(N, "CHUNK", 3)
    monkeypatch.setattr(N, "GROUP_ROWS", 5)
    base = [f"a{i}" for i in range(60)]
    texts = {}
    for i in range(40):
        t = list(base)
        t[: 2 + i % 9] = [f"z{i % 9}_{j}" for j in range(2 + i % 9)]
        texts[i] = " ".join(t)
    from test_operators import brute_components

    want = {i: w[1] for i, w in brute_components(texts).items()}
    rows = N.components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == want


def test_edge_cases(spark):
    long = " ".join(f"t{i}" for i in range(300_000))
    rows = [(1, long, "a", 1), (2, long + " end", "b", 2), (3, None, "c", 3), (3, None, "c", 3), (4, "one", "d", 4), (4, "one", "d", 4), (None, "one", "e", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, _gone int")
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in N.components(docs).collect())
    assert got == sorted([("1", 299_996, 1, True), ("2", 299_997, 1, False), ("3", 0, 3, True), ("3", 0, 3, True), ("4", 1, 4, True), ("4", 1, 4, True), ("None", None, None, True)], key=lambda x: (x[0], str(x)))
    left = N.keep(docs)
    assert left.columns == docs.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "3", "4", "None"]
    assert N.keep(docs.where("doc_id = 9")).count() == 0


def test_shared_folder(spark, monkeypatch):
    one = common.shared_dir(spark)
    assert one != common.shared_dir(spark) and spark.sparkContext.applicationId in one
    kept = common.materialize(spark.range(3), "t")
    assert kept.count() == 3

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Context:
        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        shared._run_dir(Session())


def test_clean_up_leaves_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "_run_dir", lambda spark: f"file://{tmp_path}/run")
    common.materialize(spark.range(3), "t")
    assert list(tmp_path.rglob("*.parquet"))
    common.clean_up(spark)
    common.clean_up(spark)
    assert not list(tmp_path.rglob("*.parquet"))


def test_local_folder_where_none_is_set(spark):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "local[2]"}.get(key, default)

    class Context:
        applicationId, _jvm, _jsc = "app", spark.sparkContext._jvm, spark.sparkContext._jsc

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    assert shared._run_dir(Session()) == shared._run_dir(Session()) and shared._run_dir(Session()).startswith("file:/")
