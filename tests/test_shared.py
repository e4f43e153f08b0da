"""The shared folder: where Spark writes is where tasks write."""

import pytest
from pyspark import SparkConf

from piiguard import registry, shared


@pytest.mark.parametrize(
    ("uri", "want"),
    [("file:/x/y", "file:///x/y"), ("file:///x/y", "file:///x/y"), ("hdfs://nn:8020/x", "hdfs://nn:8020/x"), ("s3a://bucket/x", "s3://bucket/x"), ("s3://bucket/x", "s3://bucket/x")],
)
def test_arrow_uri(uri, want):
    assert shared.arrow_uri(uri) == want


def test_folders_are_qualified_as_spark_does(spark, tmp_path):
    assert shared.arrow_uri(shared.qualified(spark, str(tmp_path))) == f"file://{tmp_path}"
    spark.range(3).write.parquet(f"{tmp_path}/t")
    files, path = shared.open_folder(shared.qualified(spark, f"{tmp_path}/t"))
    assert files.get_file_info(f"{path}/_SUCCESS").is_file
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("fs.defaultFS", "viewfs://store/")
    hadoop.set("fs.viewfs.mounttable.store.link./t", f"file://{tmp_path}")
    try:
        assert shared.qualified(spark, "/t") == "viewfs://store/t"
    finally:
        hadoop.set("fs.defaultFS", "file:///")


def test_local_folders_of_a_cluster_are_refused():
    assert shared.checked_base("/x", "hdfs://nn/x", "yarn") == "hdfs://nn/x"
    assert shared.checked_base("file:/mnt/x", "file:/mnt/x", "spark://m:7077") == "file:/mnt/x"
    assert shared.checked_base("/x", "file:/x", "local[4]") == "file:/x"
    for base, uri in (("/x", "file:/x"), (None, None)):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.checked_base(base, uri, "yarn")


def test_materialize_and_clean_up(spark):
    made = shared.materialize(spark.range(5), "numbers")
    assert made.count() == 5
    folder = shared._run_dir(spark)
    assert shared.open_folder(folder)[0].get_file_info(shared.open_folder(folder)[1]).type.name == "Directory"


def test_base_of_a_cluster_without_checkpoint_folder_is_the_shared_warehouse():
    """Executors of their own (also of local-cluster) don't share the driver's temporary folder."""
    uri = lambda f: f if ":" in f else f"file:{f}"
    yes, no = lambda u: True, lambda u: False
    for master in ("local-cluster[3,4,10240]", "spark://m:7077", "yarn"):
        assert shared.pick_base(None, ["file:/w"], uri, master, yes) == "file:/w"
        assert shared.pick_base("/x", ["file:/w"], uri, master, yes) == "file:/x"
        assert shared.pick_base("/x", ["file:/w"], uri, master, lambda u: u == "file:/w") == "file:/w"
        assert shared.pick_base("file:/mnt", ["file:/w"], uri, master, no) == "file:/mnt"
        assert shared.pick_base(None, ["hdfs://nn/w"], uri, master, no) == "hdfs://nn/w"
        assert shared.pick_base("/x", ["file:/w", None], uri, master, no) is None
    assert shared.pick_base("/x", [], uri, "local[4]", no) == "file:/x"
    assert shared.pick_base(None, [], uri, "local", no).startswith("file:///")


def test_probe(spark, tmp_path):
    assert shared.seen_by_all(spark, f"file:{tmp_path}")
    (tmp_path / "file").write_text("")
    assert not shared.seen_by_all(spark, f"file:{tmp_path}/file")


def test_a_cluster_without_shared_folder_keeps_tables_on_executors(spark, monkeypatch):
    monkeypatch.setattr(shared, "_run_dir", lambda spark: None)
    assert sorted(r["id"] for r in shared.materialize(spark.range(5), "numbers").collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(spark)


#: One query of each kind of F3 to F10, F14 to F17 and F19 to F22: all that keep tables in the shared folder had one fault.
KEEPING = ("el_visible_pages", "ev_category", "geo_nms_page", "pipe_flatten", "rsn_input", "san_context", "san_deep_records")


@pytest.mark.parametrize("name", KEEPING)
def test_query_keeps_its_tables_on_a_cluster(spark, monkeypatch, name):
    """A folder without scheme on the local disk was refused on a cluster's master; it is probed."""
    get = SparkConf.get
    monkeypatch.setattr(SparkConf, "get", lambda self, key, default=None: "spark://m:7077" if key == "spark.master" else get(self, key, default))
    monkeypatch.setattr(shared, "_BASES", {})
    registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert shared._BASES and None not in shared._BASES.values()
