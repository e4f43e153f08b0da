"""Text reports against texts written out by hand, and their files in order."""

from piiguard import reports as R

FACTS = {"Dataset Version": "1", "Timestamp": "t"}


def text(report):
    return [r["line"] for r in report.orderBy("section", "major", "minor").collect()]


def test_evaluation_text(spark):
    full = spark.createDataFrame([(3, 2, 1, 0.98765, 0.5, 1 / 3, 1.0)], "samples long, evaluated long, deferred long, precision double, recall double, f1 double, redaction_precision double")
    own = "category long, samples long, deferred long, precision double, recall double, f1 double, redaction_precision double, security_pass_rate double"
    categories = spark.createDataFrame([(5, 1, 0, 0.0, 0.0, 0.0, 1.0, 1.0), (1, 1, 1, 1.0, 1.0, 1.0, 0.25, None), (9, 0, 0, 0.0, 0.0, 0.0, 1.0, None)], own)
    rows = [(1, "type", "phone", 1.0, 0.125, 0.2), (1, "type", "email", 0.0005, 0.0, 0.0), (1, "type", "ssn", 0.0, 0.0, 0.0), (1, "layer", "2", 0.5, 0.5, 0.5)]
    breakdown = spark.createDataFrame(rows, "category long, scope string, name string, precision double, recall double, f1 double")
    got = text(R.evaluation(full, categories, breakdown, ("email", "phone", "ssn"), "Title", FACTS))
    assert got[:16] == [
        "Title", "=" * 40, "", "Dataset Version: 1", "Timestamp: t", "", "Total Samples: 3", "Evaluated: 2", "Deferred: 1", "", "OVERALL METRICS (DOM-only, implemented capabilities):",
        "  PII Precision: 98.77%", "  PII Recall:    50.00%", "  PII F1:        33.33%", "  Redaction Precision: 100.00%", "",
    ]
    assert got[16:29] == [
        "CATEGORY BREAKDOWN:", "", "  Standard HTML Forms (DOM-sufficient) (Cat 1):", "    Samples Evaluated: 1, Deferred: 1", "    PII Precision: 100.00%", "    PII Recall:    100.00%",
        "    PII F1:        100.00%", "    Redaction Precision: 25.00%", "    Per-Type:", "      email: P=0.1% R=0.0% F1=0.0%", "      phone: P=100.0% R=12.5% F1=20.0%", "    Per-Layer:",
        "      Layer 2: P=50.0% R=50.0% F1=50.0%",
    ]
    assert "    Security Pass Rate: 100.00%" in got[29:39] and "  Category 9 (Cat 9):" in got


def runs(spark, rows):
    return spark.createDataFrame(rows, "page_id long, category int, strategy string, mode string, ms double, detections long, invoked boolean, reason string")


def experiment(spark, ran, strategies, grid):
    s = spark.createDataFrame(strategies, "strategy string, invocations long, skips long, rate double, avg_ms double, avg_detections double, avg_redactions double, model_success_rate double")
    g = spark.createDataFrame(grid, "category long, strategy string, invocations long, skips long, rate double, avg_ms double, avg_detections double")
    return R.experiment(runs(spark, ran), s, g, ("dom_only", "dom_gated_vision"), "T", {}, {"Warmup Iterations": "5"})


def test_experiment_text(spark):
    ran = [(1, 2, s, "heuristic", 1.005, 4, i, r) for s, i, r in (("dom_gated_vision", True, "seen"), ("dom_only", False, "dom_only_strategy"))] + [(2, 2, "dom_gated_vision", "heuristic", 2.0, 0, False, None)]
    got = text(experiment(spark, ran, [("dom_gated_vision", 1, 1, 0.5, 1.5, 2.0, 3.0, 0.5), ("dom_only", 0, 1, 0.0, 1.0, 4.0, 1.0, 0.0)], [(2, "dom_only", 0, 1, 0.0, 1.0, 4.0), (3, "dom_only", 0, 0, 0.0, 0.0, 0.0)]))
    assert got[2:9] == ["", "", "EXPERIMENT CONFIG:", "  Warmup Iterations: 5", "", "DATASET:", "  Total Unique Samples: 1"]
    at = got.index(R.COMPARED_RULE)
    assert got[at + 1 : at + 9] == [
        "dom_only | 0 | 0.0% | 1.00 | 4.0 | 1.0 | 0.0%", "dom_gated_vision | 1 | 50.0% | 1.50 | 2.0 | 3.0 | 50.0%", "", "PER-CATEGORY RESULTS:", "", "Category 2 (Mislabeled / Custom-styled Fields):",
        "  " + R.STRATEGY_HEAD, "  " + R.STRATEGY_RULE,
    ]
    at = got.index("GATE BEHAVIOR ANALYSIS:")
    assert got[at + 2 : at + 7] == ["    Total samples: 2", "    Gate triggered (vision invoked): 1 (50.0%)", "    Gate skipped (vision skipped): 1 (50.0%)", "    Gate reasons:", "      seen: 1"]
    assert got[-3:] == [
        "  1 (Cat 2) [dom_only (heuristic)]: 1.01ms, detections=4, visionInvoked=false", "  1 (Cat 2) [dom_gated_vision (heuristic)]: 1.01ms, detections=4, visionInvoked=true",
        "  2 (Cat 2) [dom_gated_vision (heuristic)]: 2.00ms, detections=0, visionInvoked=false",
    ]


def test_experiment_text_without_runs(spark):
    got = text(experiment(spark, [], [], []))
    assert "    Total samples: 0" in got and not [x for x in got if "triggered" in x] and got[-1] == "PER-SAMPLE DETAILS:"


def test_benchmark_text_and_its_files(spark, tmp_path):
    samples = spark.createDataFrame([(i, i % 6 + 1, i / 4) for i in range(40)], "sample_id long, category int, ms double")
    stats = "min double, max double, mean double, median double, p50 double, p95 double, p99 double, std_dev double, count long"
    overall = spark.createDataFrame([(1.0, 9.0, 5.0, 4.0, 4.0, 8.0, 8.9, 2.0, 27)], stats)
    stages = spark.createDataFrame([("b", 1.0, 9.0, 5.0, 4.0, 4.0, 8.0, 8.9, 2.0, 27), ("a", 1.0, 9.0, 0.5, 4.0, 4.0, 8.0, 8.9, 0.25, 26), ("other", 1.0, 9.0, 0.5, 4.0, 4.0, 8.0, 8.9, 0.25, 26)], "stage string, " + stats)
    used = spark.createDataFrame([(10.0, None)], "rss_mb double, external_mb double")
    report = R.benchmark(samples, overall, stages, used, ("a", "b"), "T", {}, {})
    got = text(report)
    at = got.index("STAGE LATENCIES (mean ± stddev):")
    assert got[at - 2 : at + 9] == ["  StdDev: 2.00 ms", "", "STAGE LATENCIES (mean ± stddev):", "  a: 0.50 ± 0.25 ms (n=26)", "  b: 5.00 ± 2.00 ms (n=27)", "", "RESOURCE USAGE:", "  RSS: 10.00 MB", "", "PER-SAMPLE RESULTS:", "  0 (Cat 1): 0.00ms"]
    assert "  Evaluated: 26" in got and "  Deferred: 14" in got
    assert "  1 (Cat 2): 0.25ms [PARTIAL]" in got and "  2 (Cat 3): 0.50ms [DEFERRED]" in got
    R.write_text(report, str(tmp_path / "report"))
    files = sorted((tmp_path / "report").glob("part-*"))
    assert [line for f in files for line in f.read_text().split("\n")[:-1]] == got
