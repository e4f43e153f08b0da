"""Text reports of the evaluation, the experiment and the benchmark, whole and in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from piiguard import reports as R
from piiguard.operators import pages as O, statistics as S
from piiguard.plans import contexts as C, evaluation as EV
from piiguard.shared import materialize

QUERIES, ORACLES = {}, {}
#: What the runs say of themselves.
FACTS = {"Dataset Version": "1.0.0", "Timestamp": "2025-01-01T00:00:00Z", "Runtime": "spark"}
CONFIG = {"Warmup Iterations": "5", "Benchmark Iterations": "20"}
STAGES = ("click", "error", "purchase", "signup", "view")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# ---- the same in SQL ----------------------------------------------------------------------------
def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _fixed(c: str, digits: int = 2) -> str:
    return f"round(({c})::DECIMAL(38,10), {digits})::VARCHAR"


def _share(c: str, digits: int = 2) -> str:
    return f"{_fixed(f'({c}) * 100', digits)} || '%'"


def _block(rows: str, section: int, lines: list[str], major: str = "0", first: str = "0") -> str:
    return f"""SELECT {section} AS section, ({major})::BIGINT AS major, ({first} + i - 1)::INTEGER AS minor, l[i] AS line
FROM (SELECT *, [{", ".join(lines)}] AS l FROM ({rows})) CROSS JOIN (SELECT unnest(range(1, {len(lines) + 1})) AS i) WHERE l[i] IS NOT NULL"""


def _with(tables: dict[str, str], blocks: list[str]) -> str:
    """The blocks over tables that are made once; a later table may read an earlier one."""
    return "WITH " + ", ".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in tables.items()) + " " + " UNION ALL ".join(blocks)


def _over(sql: str, parts: dict[str, str]) -> str:
    for name, part in parts.items():
        sql = sql.replace(f"({part})", name)
    return sql


def _case(c: str, table: dict[int, str], other: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {k} THEN {_q(v)}" for k, v in table.items()) + f" ELSE {other} END"


def _head(kind: str, title: str, facts: dict[str, str]) -> list[str]:
    return [_q(title), f"repeat('=', {R.RULES[kind]})", "''", *[_q(f"{k}: {v}") for k, v in facts.items()], "''"]


_CAT = _case("category", R.CATEGORY_NAMES, "'Category ' || category")
_RATES = [f"'PII Precision: ' || {_share('precision')}", f"'PII Recall:    ' || {_share('recall')}", f"'PII F1:        ' || {_share('f1')}", f"'Redaction Precision: ' || {_share('redaction_precision')}"]
_OWN = ["''", f"'  ' || {_CAT} || ' (Cat ' || category || '):'", "'    Samples Evaluated: ' || samples || ', Deferred: ' || deferred", *["'    ' || " + r for r in _RATES],
        f"'    Security Pass Rate: ' || {_share('security_pass_rate')}", "'    Per-Type:'"]
_PRF = f"': P=' || {_share('precision', 1)} || ' R=' || {_share('recall', 1)} || ' F1=' || {_share('f1', 1)}"
_READ = {"scored_rows": EV._SCORED, "redacted_rows": EV.RED_SQL}
_TABLES = _READ | {f"{name}_table": _over(EV.ORACLES[f"ev_{name}"], _READ) for name in ("full", "category", "breakdown")}
_SOME = "SELECT * FROM breakdown_table WHERE (precision > 0 OR recall > 0 OR f1 > 0) AND scope = "
_COUNTS = ["'Total Samples: ' || samples", "'Evaluated: ' || evaluated", "'Deferred: ' || deferred", "''", "'OVERALL METRICS (DOM-only, implemented capabilities):'", *["'  ' || " + r for r in _RATES], "''", "'CATEGORY BREAKDOWN:'"]
_EVALUATION = [
    _block("FROM full_table", 0, _head("evaluation", "Evaluation Results", FACTS) + _COUNTS), _block("FROM category_table", 1, _OWN, "category"),
    _block(_SOME + "'type'", 1, [f"'      ' || name || {_PRF}"], "category", f"list_position({list(EV.TYPES)}, name) - 1 + {len(_OWN)}"),
    _block("FROM category_table", 1, ["'    Per-Layer:'"], "category", str(len(_OWN) + len(EV.TYPES))),
    _block(_SOME + "'layer'", 1, [f"'      Layer ' || name || {_PRF}"], "category", f"name::INTEGER + {len(_OWN) + len(EV.TYPES)}"),
]


@query(_with(_TABLES, _EVALUATION))
def snk_evaluation_text(spark, sf_dir):
    """The evaluation's report: totals, then each category with its types and layers."""
    b = EV.based(spark, sf_dir)
    parts = {"scores": EV.scores(spark, sf_dir, b.found), "redactions": EV.redactions(spark, sf_dir, b.full), "security": EV.security(spark, sf_dir, b.full)}
    scored, redacted, secured = (materialize(df, name) for name, df in parts.items())
    tables = EV.full_table(scored, redacted), EV.category_table(scored, redacted, secured), EV.breakdown_table(scored)
    return R.evaluation(*tables, EV.TYPES, "Evaluation Results", FACTS)


_NTH = f"list_position({list(O.STRATEGIES)}, strategy) - 1"
_LINE = f"strategy || ' | ' || invocations || ' | ' || {_share('rate', 1)} || ' | ' || {_fixed('avg_ms')} || ' | ' || {_fixed('avg_detections', 1)}"
_RAN = {"ran": EV._RUNS}
_COMPARED = _RAN | {"summary_table": _over(EV.ORACLES["ex_strategy_summary"], _RAN), "grid_table": _over(EV.ORACLES["ex_category_strategy"], _RAN)}
_GRID = "SELECT * FROM grid_table WHERE invocations + skips > 0"
_GATED = "SELECT * FROM ran WHERE strategy = 'dom_gated_vision'"
_ONE = "SELECT 1"
_STRATEGIES = "FROM summary_table"
_TOP = _head("experiment", "Experiment: DOM-gated vs Unconditional Vision", FACTS) + ["'EXPERIMENT CONFIG:'", *[_q(f"  {k}: {v}") for k, v in CONFIG.items()], "''", "'DATASET:'", "'  Total Unique Samples: ' || samples",
       _q("  Strategies Tested: " + ", ".join(O.STRATEGIES)), "''", "'AGGREGATE STRATEGY COMPARISON:'", _q(R.COMPARED_HEAD), _q(R.COMPARED_RULE)]
_EXPERIMENT = [
    _block("SELECT count(*) FILTER (strategy = 'dom_only') AS samples FROM ran", 0, _TOP),
    _block(_STRATEGIES, 1, [f"{_LINE} || ' | ' || {_fixed('avg_redactions', 1)} || ' | ' || {_share('model_success_rate', 1)}"], _NTH), _block(_ONE, 2, ["''", "'PER-CATEGORY RESULTS:'"]),
    _block(f"SELECT DISTINCT category FROM ({_GRID})", 3, ["''", f"'Category ' || category || ' (' || {_CAT} || '):'", _q("  " + R.STRATEGY_HEAD), _q("  " + R.STRATEGY_RULE)], "category"),
    _block(_GRID, 3, [f"'  ' || {_LINE}"], "category", f"{_NTH} + 4"), _block(_ONE, 4, ["''"]),
    _block(f"SELECT count(*) AS n, count(*) FILTER (invoked) AS a, count(*) FILTER (NOT invoked) AS z FROM ({_GATED})", 5, [
        "''", "'GATE BEHAVIOR ANALYSIS:'", "'  DOM-gated strategy:'", "'    Total samples: ' || n", f"'    Gate triggered (vision invoked): ' || a || ' (' || {_share('a / n', 1)} || ')'",
        f"'    Gate skipped (vision skipped): ' || z || ' (' || {_share('z / n', 1)} || ')'", "'    Gate reasons:'"]),
    _block(f"SELECT reason, count(*) AS n, min(page_id) AS f FROM ({_GATED}) WHERE reason IS NOT NULL GROUP BY reason", 6, ["'      ' || reason || ': ' || n"], "f"),
    _block(_ONE, 7, ["''", "'MODEL INFERENCE:'"]), _block(_STRATEGIES, 8, [f"'  ' || strategy || ': Model success rate ' || {_share('model_success_rate', 1)}"], _NTH),
    _block(_ONE, 9, ["''", "'PER-SAMPLE DETAILS:'"]),
    _block("FROM ran", 10, [f"'  ' || page_id || ' (Cat ' || category || ') [' || strategy || ' (' || mode || ')]: ' || {_fixed('ms')} || 'ms, detections=' || detections || ', visionInvoked=' || invoked"], "page_id", _NTH),
]


@query(_with(_COMPARED, _EXPERIMENT))
def snk_experiment_text(spark, sf_dir):
    """The experiment's report: strategies overall and by category, the gate, and every run."""
    runs = materialize(EV.runs(spark, sf_dir), "runs")
    return R.experiment(runs, EV.strategy_table(runs), EV.category_strategy_table(runs), O.STRATEGIES, "Experiment: DOM-gated vs Unconditional Vision", FACTS, CONFIG)


_PER_SAMPLE = f"SELECT sample_id, category, sum(ms) AS ms FROM ({EV._STAGE}) GROUP BY ALL"
_STATUS = _case("category", R.STATUS, "''")
_RESOURCES = "SELECT heap_mb AS heap_used_mb, rss_mb FROM (" + EV.ORACLES["bm_resource_means"] + ")"
_BENCH_TOP = _head("benchmark", "Latency & Resource Benchmark", FACTS) + ["'BENCHMARK CONFIG:'", *[_q(f"  {k}: {v}") for k, v in CONFIG.items()], "''", "'DATASET:'", "'  Total Samples: ' || a", "'  Evaluated: ' || e", "'  Deferred: ' || d", "''"]
_BENCHMARK = [
    _block(f"SELECT count(*) AS a, count(*) FILTER (category NOT IN (3, 4)) AS e, count(*) FILTER (category IN (3, 4)) AS d FROM ({_PER_SAMPLE})", 0, _BENCH_TOP),
    _block(f"SELECT {EV._STATS.format('ms')} FROM ({_PER_SAMPLE}) WHERE category NOT IN (3, 4)", 1, [
        "'OVERALL END-TO-END LATENCY:'", *[f"'  {k}: ' || {_fixed(v)} || ' ms'" for k, v in R.LATENCIES.items()], "''", "'STAGE LATENCIES (mean ± stddev):'"]),
    _block(f"SELECT * FROM ({EV.ORACLES['bm_summary']}) WHERE stage IN {STAGES}", 2, [f"'  ' || stage || ': ' || {_fixed('mean')} || ' ± ' || {_fixed('std_dev')} || ' ms (n=' || count || ')'"], f"list_position({list(STAGES)}, stage) - 1"),
    _block(_RESOURCES, 3, ["''", "'RESOURCE USAGE:'", f"'  Heap Used: ' || {_fixed('heap_used_mb')} || ' MB'", f"'  RSS: ' || {_fixed('rss_mb')} || ' MB'", "''"]),
    _block(_ONE, 4, ["'PER-SAMPLE RESULTS:'"]),
    _block(_PER_SAMPLE, 5, [f"'  ' || sample_id || ' (Cat ' || category || '): ' || {_fixed('ms')} || 'ms' || CASE WHEN {_STATUS} = '' THEN '' ELSE ' [' || {_STATUS} || ']' END"], "sample_id"),
]


@query(" UNION ALL ".join(_BENCHMARK))
def snk_benchmark_text(spark, sf_dir):
    """The benchmark's report: latencies, resources, and every sample."""
    means = EV.stage_means(EV.timed(spark, sf_dir))
    samples = means.groupBy("sample_id", "category").agg(F.sum("ms").alias("ms"))
    scored = samples.where("category NOT IN (3, 4)").select(F.lit(0).alias("g"), "ms")
    used = EV.bm_resource_means(spark, sf_dir).select(F.col("heap_mb").alias("heap_used_mb"), "rss_mb")
    return R.benchmark(samples, S.summary(scored, "g", "ms", EV.SHARES), EV.bm_summary(spark, sf_dir), used, STAGES, "Latency & Resource Benchmark", FACTS, CONFIG)
