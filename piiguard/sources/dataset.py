"""Annotated page samples: a folder a category, in it a JSON file of annotations and an HTML file a sample."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FIXTURES = "file://" + os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "fixtures", "dataset")

_HEAD = "struct<id:string,category:int,description:string,html_file:string,url_origin:string,title:string>"
#: What each kind of annotation must have, by its field of a sample.
REQUIRED = {
    "ground_truth": ("element_id", "type", "expected_layer"),
    "expected_detections": ("element_id", "pii_type", "detection_layer"),
    "expected_redactions": ("element_id", "pii_type", "expected_placeholder", "original_value"),
    "expected_hidden_elements": ("element_id", "hidden_method"),
    "expected_action_outcomes": ("target_selector", "action_type", "expected_validation"),
}
_MORE = {"expected_hidden_elements": "contains_injection_text:boolean", "expected_action_outcomes": "expected_failure_reason:string,is_malicious:boolean"}
_INTEGERS = ("expected_layer", "detection_layer")


def _annotations(name: str) -> str:
    fields = [f"{f}:{'int' if f in _INTEGERS else 'string'}" for f in REQUIRED[name]]
    return f"array<struct<{','.join(fields + ([_MORE[name]] if name in _MORE else []))}>>"


SCHEMA = f"metadata {_HEAD}, " + ", ".join(f"{n} {_annotations(n)}" for n in REQUIRED)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """The samples of all categories with their ``html``; null where a sample's page is not there."""
    name = lambda suffix: F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+/[^/]+)\.{suffix}$", 1)
    samples = spark.read.schema(SCHEMA).json(f"{folder}/category*/*.json", multiLine=True).select("*", name("json").alias("stem"))
    pages = spark.read.text(f"{folder}/category*/*.html", wholetext=True).select(F.concat(name("html"), F.lit(".html")).alias("path"), F.col("value").alias("html"))
    place = F.concat(F.lit("category"), F.col("metadata.category").cast("string"), F.lit("/"), F.col("metadata.html_file"))
    return samples.withColumn("path", place).join(pages, "path", "left").drop("path")


def write(samples: DataFrame, pages: DataFrame, folder: str) -> None:
    """Write samples (as of :data:`SCHEMA`, and stem) and pages (path, html) in the packed layout: JSON lines, many to a file."""
    samples.write.json(f"{folder}/samples")
    pages.write.json(f"{folder}/pages")


def scan_packed(spark: SparkSession, folder: str) -> DataFrame:
    """The same table as :func:`scan`, from the packed layout."""
    samples = spark.read.schema(f"{SCHEMA}, stem string").json(f"{folder}/samples")
    pages = spark.read.schema("path string, html string").json(f"{folder}/pages")
    place = F.concat(F.lit("category"), F.col("metadata.category").cast("string"), F.lit("/"), F.col("metadata.html_file"))
    return samples.withColumn("path", place).join(pages, "path", "left").drop("path")


def by_category(samples: DataFrame, category: int) -> DataFrame:
    return samples.where(F.col("metadata.category") == category)


def by_id(samples: DataFrame, sample_id: str) -> DataFrame:
    """The first sample with an id, in order of its file."""
    return samples.where(F.col("metadata.id") == sample_id).orderBy("stem").limit(1)


def ids(samples: DataFrame) -> DataFrame:
    return samples.select(F.col("metadata.id").alias("id"), F.col("metadata.category").alias("category"), "stem")


def _invalid(name: str, lacks) -> Column:
    """An error for each annotation of a kind that lacks a value."""
    def wrong(a: Column) -> Column:
        out = F.lit(False)
        for f in REQUIRED[name]:
            out = out | lacks(a[f])
        return out

    bad = F.filter(F.coalesce(F.col(name), F.array().cast(_annotations(name))), wrong)
    return F.transform(bad, lambda _: F.lit(f"invalid {name}"))


def errors(samples: DataFrame) -> DataFrame:
    """A row an error: sample_id and error. Duplicate ids, missing fields or pages, annotations that lack a value."""
    lacks = lambda c: c.isNull() | (c.cast("string").isin("", "0"))
    m = F.col("metadata")
    found: list[Column] = [
        F.when(lacks(m["id"]) | lacks(m["category"]) | lacks(m["html_file"]), F.lit("missing metadata")), F.when(F.col("html").isNull(), F.lit("missing html")),
    ]
    listed = F.array_compact(F.array(*found))
    for name in REQUIRED:
        listed = F.concat(listed, _invalid(name, lacks))
    each = samples.select(m["id"].alias("sample_id"), F.explode(listed).alias("error"))
    twice = samples.groupBy(m["id"].alias("sample_id")).agg(F.count("*").alias("n")).where("n > 1").select("sample_id", F.lit("duplicate id").alias("error"))
    return each.unionByName(twice)
