"""Text reports of evaluations, experiments and benchmarks as ordered lines.

A report is a table of ``section``, ``major``, ``minor`` (its order) and ``line``. Each part of it is a projection of a
result table, so parts with a line a sample grow with the samples and are never held by one task; :func:`write_text`
sorts them by ranges. Numbers are rounded as decimals, halves up. A line whose values are null is left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Names of the categories, those that are put off or done in part, and the widths of the rules below titles.
CATEGORY_NAMES = {
    1: "Standard HTML Forms (DOM-sufficient)", 2: "Mislabeled / Custom-styled Fields", 3: "Canvas-rendered / Non-DOM Content",
    4: "Visual PII (Faces, ID Cards)", 5: "Prompt Injection Test Pages", 6: "Mixed/Realistic Composite Pages",
}
STATUS = {2: "PARTIAL", 3: "DEFERRED", 4: "DEFERRED", 6: "PARTIAL"}
RULES = {"evaluation": 40, "benchmark": 52, "experiment": 64}
STRATEGY_HEAD = "Strategy | Vision Calls | Vision Rate | Avg E2E (ms) | Avg Detections"
STRATEGY_RULE = "---------|--------------|-------------|--------------|---------------"
COMPARED_HEAD, COMPARED_RULE = STRATEGY_HEAD + " | Avg Redactions | Model Success", STRATEGY_RULE + "-|----------------|--------------"
LATENCIES = {"Mean": "mean", "Median": "median", "Min": "min", "Max": "max", "P50": "p50", "P95": "p95", "P99": "p99", "StdDev": "std_dev"}
RESOURCES = {"Heap Used": "heap_used_mb", "Heap Total": "heap_total_mb", "External": "external_mb", "RSS": "rss_mb", "Array Buffers": "array_buffers_mb"}


def fixed(c: Column, digits: int = 2) -> Column:
    """A number with that many decimals."""
    return F.round(c.try_cast("decimal(38,10)"), digits).cast("string")


def share(c: Column, digits: int = 2) -> Column:
    return F.concat(fixed(c * 100, digits), F.lit("%"))


def said(*parts: Column | str) -> Column:
    """A line of texts and columns one after another; null if one of them is."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def block(rows: DataFrame, section: int, lines: Sequence[Column | str], major: Column | None = None, first: Column | int = 0) -> DataFrame:
    """These lines of every row, in places from ``first`` on below the row's ``major``."""
    major, first = F.lit(0) if major is None else major, F.lit(first) if isinstance(first, int) else first
    array = F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])
    out = rows.select(major.cast("long").alias("major"), first.cast("int").alias("_first"), F.posexplode(array).alias("_pos", "line")).where("line IS NOT NULL")
    return out.select(F.lit(section).alias("section"), "major", (F.col("_first") + F.col("_pos")).alias("minor"), "line")


def place(c: Column, values: Sequence[str]) -> Column:
    """The place of a value in a list, from 0."""
    return F.array_position(F.array(*map(F.lit, values)), c).cast("int") - 1


def named(c: Column, table: dict[int, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c.cast("int"))


def category_name(c: Column) -> Column:
    return F.coalesce(named(c, CATEGORY_NAMES), said("Category ", c))


def head(kind: str, title: str, facts: dict[str, str]) -> list[str]:
    return [title, "=" * RULES[kind], "", *[f"{k}: {v}" for k, v in facts.items()], ""]


def joined(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def evaluation(full: DataFrame, categories: DataFrame, breakdown: DataFrame, types: Sequence[str], title: str, facts: dict[str, str]) -> DataFrame:
    """Totals, then a paragraph a category with its types and layers that are not all zero."""
    c = F.col
    rates = {"PII Precision: ": "precision", "PII Recall:    ": "recall", "PII F1:        ": "f1", "Redaction Precision: ": "redaction_precision"}
    counts = [said("Total Samples: ", c("samples")), said("Evaluated: ", c("evaluated")), said("Deferred: ", c("deferred")), ""]
    overall = ["OVERALL METRICS (DOM-only, implemented capabilities):", *[said(f"  {k}", share(c(v))) for k, v in rates.items()], "", "CATEGORY BREAKDOWN:"]
    own = [
        "", said("  ", category_name(c("category")), " (Cat ", c("category"), "):"), said("    Samples Evaluated: ", c("samples"), ", Deferred: ", c("deferred")),
        *[said(f"    {k}", share(c(v))) for k, v in rates.items()], said("    Security Pass Rate: ", share(c("security_pass_rate"))), "    Per-Type:",
    ]
    prf = [x for k in ("precision", "recall", "f1") for x in (f" {k[0].upper() if k != 'f1' else 'F1'}=", share(c(k), 1))]
    some = breakdown.where("precision > 0 OR recall > 0 OR f1 > 0")
    at = len(own)
    typed = block(some.where("scope = 'type'"), 1, [said("      ", c("name"), ":", *prf)], c("category"), place(c("name"), types) + at)
    at += len(types)
    layered = block(some.where("scope = 'layer'"), 1, [said("      Layer ", c("name"), ":", *prf)], c("category"), c("name").cast("int") + at)
    return joined(
        block(full, 0, head("evaluation", title, facts) + counts + overall), block(categories, 1, own, c("category")), typed,
        block(categories, 1, ["    Per-Layer:"], c("category"), at), layered,
    )


def experiment(runs: DataFrame, strategies: DataFrame, by_category: DataFrame, order: Sequence[str], title: str, facts: dict[str, str], config: dict[str, str]) -> DataFrame:
    """The comparison of strategies overall and by category, what the gate did, and a line a run.

    ``runs`` has a row a sample and strategy: page_id, category, strategy, mode, ms, detections, invoked, reason.
    """
    c, nth = F.col, place(F.col("strategy"), order)
    common = [c("strategy"), " | ", c("invocations"), " | ", share(c("rate"), 1), " | ", fixed(c("avg_ms")), " | ", fixed(c("avg_detections"), 1)]
    totals = runs.agg(F.count_if(c("strategy") == order[0]).alias("samples"))
    top = head("experiment", title, facts) + ["EXPERIMENT CONFIG:", *[f"  {k}: {v}" for k, v in config.items()], "", "DATASET:"]
    top += [said("  Total Unique Samples: ", c("samples")), "  Strategies Tested: " + ", ".join(order), "", "AGGREGATE STRATEGY COMPARISON:", COMPARED_HEAD, COMPARED_RULE]
    compared = said(*common, " | ", fixed(c("avg_redactions"), 1), " | ", share(c("model_success_rate"), 1))
    each = by_category.where("invocations + skips > 0")
    title_of = ["", said("Category ", c("category"), " (", category_name(c("category")), "):"), "  " + STRATEGY_HEAD, "  " + STRATEGY_RULE]
    gated = runs.where(c("strategy") == "dom_gated_vision")
    counts = gated.agg(F.count("*").alias("n"), F.count_if("invoked").alias("on"), F.count_if(~c("invoked")).alias("off"))
    rate = lambda name: share(F.try_divide(c(name), c("n")), 1)
    gate = [
        "", "GATE BEHAVIOR ANALYSIS:", "  DOM-gated strategy:", said("    Total samples: ", c("n")), said("    Gate triggered (vision invoked): ", c("on"), " (", rate("on"), ")"),
        said("    Gate skipped (vision skipped): ", c("off"), " (", rate("off"), ")"), "    Gate reasons:",
    ]
    reasons = gated.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    run = said("  ", c("page_id"), " (Cat ", c("category"), ") [", c("strategy"), " (", c("mode"), ")]: ", fixed(c("ms")), "ms, detections=", c("detections"), ", visionInvoked=", c("invoked"))
    return joined(
        block(totals, 0, top), block(strategies, 1, [compared], nth), block(totals, 2, ["", "PER-CATEGORY RESULTS:"]),
        block(each.select("category").distinct(), 3, title_of, c("category")), block(each, 3, [said("  ", *common)], c("category"), nth + len(title_of)),
        block(totals, 4, [""]), block(counts, 5, gate), block(reasons, 6, [said("      ", c("reason"), ": ", c("n"))], c("first")),
        block(totals, 7, ["", "MODEL INFERENCE:"]), block(strategies, 8, [said("  ", c("strategy"), ": Model success rate ", share(c("model_success_rate"), 1))], nth),
        block(totals, 9, ["", "PER-SAMPLE DETAILS:"]), block(runs, 10, [run], c("page_id"), nth),
    )


def benchmark(samples: DataFrame, overall: DataFrame, stages: DataFrame, resources: DataFrame, order: Sequence[str], title: str, facts: dict[str, str], config: dict[str, str]) -> DataFrame:
    """Latencies overall and by stage, mean resources (those that are known), and a line a sample (sample_id, category, ms)."""
    c, status = F.col, F.coalesce(named(F.col("category"), STATUS), F.lit(""))
    counts = samples.agg(F.count("*").alias("all"), F.count_if(status != "DEFERRED").alias("evaluated"), F.count_if(status == "DEFERRED").alias("deferred"))
    top = head("benchmark", title, facts) + ["BENCHMARK CONFIG:", *[f"  {k}: {v}" for k, v in config.items()], "", "DATASET:"]
    top += [said("  Total Samples: ", c("all")), said("  Evaluated: ", c("evaluated")), said("  Deferred: ", c("deferred")), ""]
    latency = ["OVERALL END-TO-END LATENCY:", *[said(f"  {k}: ", fixed(c(v)), " ms") for k, v in LATENCIES.items()], "", "STAGE LATENCIES (mean ± stddev):"]
    stage = said("  ", c("stage"), ": ", fixed(c("mean")), " ± ", fixed(c("std_dev")), " ms (n=", c("count"), ")")
    known = [said(f"  {k}: ", fixed(c(v)), " MB") for k, v in RESOURCES.items() if v in resources.columns]
    mark = F.when(status == "", "").otherwise(F.concat(F.lit(" ["), status, F.lit("]")))
    return joined(
        block(counts, 0, top), block(overall, 1, latency), block(stages.where(c("stage").isin(*order)), 2, [stage], place(c("stage"), order)),
        block(resources, 3, ["", "RESOURCE USAGE:", *known, ""]), block(counts, 4, ["PER-SAMPLE RESULTS:"]),
        block(samples, 5, [said("  ", c("sample_id"), " (Cat ", c("category"), "): ", fixed(c("ms")), "ms", mark)], c("sample_id")),
    )


def write_text(report: DataFrame, folder: str) -> None:
    """The report's lines in order, as text files whose names sort in that order."""
    report.orderBy("section", "major", "minor").select("line").write.mode("errorifexists").text(folder)
