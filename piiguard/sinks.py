"""Result sinks: result tables as JSON files, and summaries as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def write_results(results: dict[str, DataFrame], folder: str) -> None:
    """Write each table as JSON lines below ``folder``, under its name."""
    for name, df in results.items():
        df.write.mode("errorifexists").json(f"{folder}/{name}")


def read_result(df: DataFrame, folder: str, name: str) -> DataFrame:
    """A written table with the schema and column order of ``df``."""
    return df.sparkSession.read.schema(df.schema).json(f"{folder}/{name}")


def percent(c: Column, digits: int = 3) -> Column:
    """A share as text; with as many digits as results are rounded to, so that no engine rounds again."""
    return F.format_string(f"%.{digits}f%%", c * 100)


def lines(rows: DataFrame, section: int, order: Column, text: Column) -> DataFrame:
    """Lines of a part of a summary: ``section``, ``place`` (as text, in order) and ``line``."""
    return rows.select(F.lit(section).alias("section"), order.cast("string").alias("place"), text.alias("line"))


def evaluation_text(full: DataFrame, categories: DataFrame, breakdown: DataFrame) -> DataFrame:
    """The summary of an evaluation as lines: totals, a line a category, a line for each type and layer that is not all zero."""
    top = lines(full, 1, F.lit(0), F.format_string(
        "Samples: %d, evaluated %d, deferred %d; precision %s, recall %s, F1 %s, redaction %s", "samples", "evaluated", "deferred",
        percent(F.col("precision")), percent(F.col("recall")), percent(F.col("f1")), percent(F.col("redaction_precision")),
    ))
    rated = F.format_string("P=%s R=%s F1=%s", *[percent(F.col(c)) for c in ("precision", "recall", "f1")])
    safe = F.coalesce(F.concat(F.lit(", security "), percent(F.col("security_pass_rate"))), F.lit(""))
    head = F.format_string("Category %d: evaluated %d, deferred %d, %s, redaction %s%s", "category", "samples", "deferred", rated, percent(F.col("redaction_precision")), safe)
    some = breakdown.where("precision > 0 OR recall > 0 OR f1 > 0")
    parts = lines(some, 3, F.concat_ws("/", F.col("category").cast("string"), "scope", "name"), F.format_string("Category %d, %s %s: %s", "category", "scope", "name", rated))
    return top.unionByName(lines(categories, 2, F.col("category"), head)).unionByName(parts)


def strategy_text(strategies: DataFrame) -> DataFrame:
    """The comparison of strategies as lines."""
    text = F.format_string(
        "%s | %d | %s | %.6f | %.6f | %.6f | %s", "strategy", "invocations", percent(F.col("rate"), 4), "avg_ms", "avg_detections", "avg_redactions", percent(F.col("model_success_rate"), 4)
    )
    return lines(strategies, 4, F.col("strategy"), text)


def benchmark_text(stages: DataFrame) -> DataFrame:
    """Latencies by stage as lines."""
    return lines(stages, 5, F.col("stage"), F.format_string("%s: %.6f ± %.6f ms (n=%d)", "stage", "mean", "std_dev", "count"))
