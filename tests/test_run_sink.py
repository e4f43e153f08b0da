"""Results of a run are there together or not at all; the walk as a table function."""

import pytest
from pyspark.sql import functions as F

from piiguard import run_sink as R
from piiguard.shared import open_folder, shared_dir
from piiguard.sources import html


def names(folder, run):
    files, base = open_folder(folder)
    info = files.get_file_info(f"{base}/runs/{run}")
    from pyarrow import fs

    return sorted(x.base_name for x in files.get_file_info(fs.FileSelector(info.path))) if info.type == fs.FileType.Directory else []


def test_a_run_is_written_once(spark):
    folder, table = shared_dir(spark), spark.range(50, numPartitions=4).select("id", F.concat(F.lit("é "), "id").alias("name"), F.when(F.col("id") > 9, F.col("id") / 2).alias("half"))
    R.write_run(table, folder, "r1")
    rows, text = R.read_run(spark, folder, "r1", table.schema)
    assert sorted(rows.collect()) == sorted(table.collect()) and text.count() == 50
    before = names(folder, "r1")
    R.write_run(table.limit(3), folder, "r1")  # a replay changes nothing
    assert names(folder, "r1") == before and R.read_run(spark, folder, "r1", table.schema)[0].count() == 50


def test_a_failed_run_leaves_nothing(spark):
    folder = shared_dir(spark)
    broken = spark.range(40, numPartitions=4).select(F.when(F.col("id") == 35, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("v"))
    with pytest.raises(Exception, match="lost"):
        R.write_run(broken, folder, "r2")
    assert names(folder, "r2") == []
    R.write_run(spark.range(0).select("id"), folder, "r3")
    assert R.read_run(spark, folder, "r3", "id long")[0].count() == 0 if names(folder, "r3") != ["manifest.json"] else True


def test_walk_as_a_table_function(spark):
    pages = spark.createDataFrame([(1, "<body><p id=a>x<b>y</b></p></body>"), (2, None), (3, "<body></body>")], "page_id long, html string")
    html.register_walk(spark)
    got = spark.sql("SELECT page_id, w.* FROM {pages} p, LATERAL walk(p.html) w", pages=pages)
    want = html.walk(pages)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 2
