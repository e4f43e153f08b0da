"""Queries over annotated samples, written results and text summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from piiguard import run_sink, sinks
from piiguard.operators import pages as O
from piiguard.plans import elements as EL, evaluation as EV
from piiguard.shared import materialize, shared_dir
from piiguard.sources import dataset, html

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Samples of the tables' pages, with faults: of some the page is not written, the id is another's, or the file is not named; a label of
#: no quality is an annotation without layer. In SQL that Spark and DuckDB share.
_SAMPLES = """SELECT p.page_id, concat('page-', p.page_id - CASE WHEN p.page_id % 50 = 7 THEN 1 ELSE 0 END) AS id, CAST(p.page_id % 6 + 1 AS INT) AS category,
 CASE WHEN p.page_id % 40 = 5 THEN '' ELSE concat('p', p.page_id, '.html') END AS html_file, concat('category', p.page_id % 6 + 1, '/p', p.page_id) AS stem,
 regexp_extract(p.html, '<title>([^<]*)</title>', 1) AS title, p.html, l.quality, l.toxic
FROM pages p LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = p.page_id"""
_WRITTEN = "page_id % 10 <> 3"
_HTML = f"CASE WHEN {_WRITTEN} AND html_file <> '' THEN html END"


def samples(spark, sf_dir):
    """The samples of the pages, written to files and scanned from them."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels")}
    made = spark.sql(_SAMPLES.replace("FROM pages", "FROM {pages}").replace("FROM labels", "FROM {labels}"), **tables)
    named = lambda kind, **fields: F.struct(*[F.lit(v).alias(k) if isinstance(v, str) else v.alias(k) for k, v in fields.items()]).cast(dataset._annotations(kind)[6:-1])
    truth = F.array(named("ground_truth", element_id=F.concat(F.lit("e"), (F.col("page_id") % 5).cast("string")), type="email", expected_layer=F.coalesce("quality", F.lit(0)).cast("int")))
    redaction = named("expected_redactions", element_id="e1", pii_type="email", expected_placeholder="[EMAIL]", original_value=F.col("title"))
    none = lambda kind: F.array().cast(dataset._annotations(kind)).alias(kind)
    head = F.struct("id", "category", F.lit("a page").alias("description"), "html_file", F.lit("https://example.test").alias("url_origin"), "title")
    rows = made.select(
        head.alias("metadata"), truth.alias("ground_truth"), none("expected_detections"), F.when(F.col("toxic") == 1, F.array(redaction, redaction)).otherwise(none("expected_redactions")).alias("expected_redactions"),
        none("expected_hidden_elements"), none("expected_action_outcomes"), "stem",
    )
    folder = shared_dir(spark)
    dataset.write(rows, made.where(_WRITTEN).select(F.concat("stem", F.lit(".html")).alias("path"), "html"), folder)
    return dataset.scan_packed(spark, folder)


@query(f"""SELECT stem, id, category, 1 AS n_truth, CASE WHEN toxic = 1 THEN 2 ELSE 0 END AS n_redactions, length({_HTML})::INTEGER AS n_chars FROM ({_SAMPLES})""")
def src_dataset_scan(spark, sf_dir):
    """Annotated samples of the pages, read back from JSON."""
    m = F.col("metadata")
    return samples(spark, sf_dir).select(
        "stem", m["id"].alias("id"), m["category"].alias("category"), F.size("ground_truth").alias("n_truth"), F.size("expected_redactions").alias("n_redactions"), F.length("html").alias("n_chars")
    )


@query(f"SELECT stem, id, title FROM ({_SAMPLES}) WHERE category = 5")
def src_dataset_lookup(spark, sf_dir):
    found = dataset.by_category(samples(spark, sf_dir), 5)
    return found.select("stem", F.col("metadata.id").alias("id"), F.col("metadata.title").alias("title"))


@query(f"""SELECT sample_id, error, count(*) AS n FROM (SELECT id AS sample_id, 'missing html' AS error FROM ({_SAMPLES}) WHERE {_HTML} IS NULL UNION ALL SELECT id, 'duplicate id' FROM ({_SAMPLES}) GROUP BY id HAVING count(*) > 1
UNION ALL SELECT id, 'missing metadata' FROM ({_SAMPLES}) WHERE html_file = '' UNION ALL SELECT id, 'invalid ground_truth' FROM ({_SAMPLES}) WHERE coalesce(quality, 0) = 0
UNION ALL SELECT id, 'invalid expected_redactions' FROM ({_SAMPLES}), range(2) WHERE toxic = 1 AND title = '') GROUP BY ALL""")
def ds_validate(spark, sf_dir):
    """Errors of the annotated samples: duplicate ids, missing fields or pages, invalid annotations of each kind."""
    return dataset.errors(samples(spark, sf_dir)).groupBy("sample_id", "error").agg(F.count("*").alias("n"))


@query(EV.ORACLES["ev_metrics"])
def snk_results(spark, sf_dir):
    """The metrics written as a run, JSON and text together, and read back."""
    metrics, folder = EV.ev_metrics(spark, sf_dir), shared_dir(spark)
    run_sink.write_run(metrics, folder, "metrics")
    return run_sink.read_run(spark, folder, "metrics", metrics.schema)[0]


_PCT = lambda c, d=3: f"printf('%.{d}f%%', {c} * 100)"
_PRF = f"'P=' || {_PCT('precision')} || ' R=' || {_PCT('recall')} || ' F1=' || {_PCT('f1')}"


@query(f"""SELECT 1 AS section, '0' AS place, 'Samples: ' || samples || ', evaluated ' || evaluated || ', deferred ' || deferred || '; precision ' || {_PCT('precision')} || ', recall ' || {_PCT('recall')} || ', F1 ' || {_PCT('f1')} || ', redaction ' || {_PCT('redaction_precision')} AS line
FROM ({EV.ORACLES['ev_full']}) UNION ALL SELECT 2, category::VARCHAR, 'Category ' || category || ': evaluated ' || samples || ', deferred ' || deferred || ', ' || {_PRF} || ', redaction ' || {_PCT('redaction_precision')} || coalesce(', security ' || {_PCT('security_pass_rate')}, '')
FROM ({EV.ORACLES['ev_category']}) UNION ALL SELECT 3, category || '/' || scope || '/' || name, 'Category ' || category || ', ' || scope || ' ' || name || ': ' || {_PRF} FROM ({EV.ORACLES['ev_breakdown']}) WHERE precision > 0 OR recall > 0 OR f1 > 0
UNION ALL SELECT 4, strategy, strategy || ' | ' || invocations || ' | ' || {_PCT('rate', 4)} || ' | ' || printf('%.6f', avg_ms) || ' | ' || printf('%.6f', avg_detections) || ' | ' || printf('%.6f', avg_redactions) || ' | ' || {_PCT('model_success_rate', 4)}
FROM ({EV.ORACLES['ex_strategy_summary']}) UNION ALL SELECT 5, stage, stage || ': ' || printf('%.6f', mean) || ' ± ' || printf('%.6f', std_dev) || ' ms (n=' || count || ')' FROM ({EV.ORACLES['bm_summary']})""")
def snk_summary_text(spark, sf_dir):
    """The text summaries of evaluation, strategies and benchmark, line by line."""
    # a row a sample each, read several times: kept in the shared folder
    b = EV.based(spark, sf_dir)
    parts = {"scores": EV.scores(spark, sf_dir, b.found), "redactions": EV.redactions(spark, sf_dir, b.full), "security": EV.security(spark, sf_dir, b.full)}
    scored, redacted, secured = (materialize(df, name) for name, df in parts.items())
    text = sinks.evaluation_text(EV.full_table(scored, redacted), EV.category_table(scored, redacted, secured), EV.breakdown_table(scored))
    return text.unionByName(sinks.strategy_text(EV.ex_strategy_summary(spark, sf_dir))).unionByName(sinks.benchmark_text(EV.bm_summary(spark, sf_dir)))


_FORM = """'<body><form id="f' || c_custkey || '"><label for="a' || c_custkey || '">Name of ' || c_name || '</label><input id="a' || c_custkey || '" value="x"><label>Wrapped <textarea id="b"></textarea></label><select id="c"></select></form></body>'"""


@query("""SELECT c_custkey AS page_id, unnest([1, 2, 3]) AS n, unnest(['INPUT', 'TEXTAREA', 'SELECT']) AS tag, unnest(['Name of ' || c_name, 'Wrapped', NULL]) AS label_text, 'f' || c_custkey AS form_id FROM customer""")
def el_label_text(spark, sf_dir):
    """Labels of made forms: by reference, around the field, and none."""
    pages = EL.customers(spark, sf_dir).select(F.col("c_custkey").alias("page_id"), F.expr(_FORM).alias("html"))
    e = html.walk(pages).where("tag IN ('INPUT', 'TEXTAREA', 'SELECT')")
    n = F.when(F.col("tag") == "INPUT", 1).when(F.col("tag") == "TEXTAREA", 2).otherwise(3)
    return e.select("page_id", n.alias("n"), "tag", "label_text", "form_id")


_NAMED = """'<body><p id="n' || c_custkey || '">Shown ' || c_name || '</p><button aria-label="Own">b</button><button aria-labelledby="n' || c_custkey || '">c</button><button aria-label="" aria-labelledby="none">d</button></body>'"""


@query("SELECT c_custkey AS page_id, unnest(range(0, 4))::INTEGER AS elem_idx, unnest([NULL, 'Own', 'Shown ' || c_name, NULL]) AS aria_label FROM customer")
def el_aria_label(spark, sf_dir):
    """The label that an element carries, else the text of the first element of its page that it names."""
    pages = EL.customers(spark, sf_dir).select(F.col("c_custkey").alias("page_id"), F.expr(_NAMED).alias("html"))
    return O.aria_labels(html.walk(pages))
