"""Scoring, statistics and experiment summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from piiguard.functions import patterns as P
from piiguard.operators import pages as O, statistics as S
from piiguard.plans import contexts as C, elements as EL
from piiguard.shared import materialize

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


r6 = lambda c: F.round(c, 6)
SHARES = {"median": 0.5, "p50": 0.5, "p95": 0.95, "p99": 0.99}
_STATS = "round(min({0}), 6) AS min, round(max({0}), 6) AS max, round(avg({0}), 6) AS mean, " + ", ".join(f"round(quantile_cont({{0}}, {s}), 6) AS {n}" for n, s in SHARES.items()) + ", round(stddev_pop({0}), 6) AS std_dev, count({0}) AS count"


@query(f"SELECT event_type, {_STATS.format('value')} FROM events GROUP BY event_type")
def st_stats(spark, sf_dir):
    return S.summary(_events(spark, sf_dir), "event_type", "value", SHARES)


@query("""SELECT event_type, value, n, (sum(n) OVER (PARTITION BY event_type ORDER BY value) - n)::BIGINT AS first_rank
FROM (SELECT event_type, value, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL)""")
def st_sorted(spark, sf_dir):
    """The sorted values of each group: each distinct one, how often it is there, and its first rank."""
    found = S.ranked(_events(spark, sf_dir), "event_type", "value")
    return found.select("event_type", "value", (F.col("_end") - F.col("_start")).alias("n"), F.col("_start").alias("first_rank"))


@query("SELECT event_type, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
def st_percentile(spark, sf_dir):
    return S.percentiles(_events(spark, sf_dir), "event_type", "value", {"p90": 0.9}).select("event_type", r6("p90").alias("p90"))


@query("SELECT round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(min(value), 6) AS min, round(max(value), 6) AS max, round(stddev_pop(value), 6) AS std_dev FROM events")
def st_scalar(spark, sf_dir):
    all_ = _events(spark, sf_dir).select(F.lit(0).alias("g"), "value")
    return S.summary(all_, "g", "value", {"median": 0.5}).select("mean", "median", "min", "max", "std_dev")


@query("SELECT user_id, l[(len(l) // 2)::BIGINT + 1] AS median, l[floor(len(l) * 0.95)::BIGINT + 1] AS p95 FROM (SELECT user_id, list_sort(list(value)) AS l FROM events WHERE value IS NOT NULL GROUP BY user_id)")
def st_percentile_nearest(spark, sf_dir):
    """Nearest rank: the sorted values' element floor(n * p)."""
    return S.nearest(_events(spark, sf_dir), "user_id", "value", {"median": 0.5, "p95": 0.95})


# timings: an event's user is the sample, its type the stage, its order by id the iteration
_TIMED = "SELECT user_id AS sample_id, user_id % 6 + 1 AS category, event_type AS stage, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1) AS iteration, value AS ms FROM events"
_STAGE = f"SELECT sample_id, category, stage, avg(ms) AS ms FROM ({_TIMED}) WHERE iteration >= 5 GROUP BY ALL"


def timed(spark, sf_dir):
    return spark.sql(_TIMED.replace("FROM events", "FROM {events}"), events=_events(spark, sf_dir))


def stage_means(measurements: DataFrame, warm_up: int = 5) -> DataFrame:
    return measurements.where(F.col("iteration") >= warm_up).groupBy("sample_id", "category", "stage").agg(F.avg("ms").alias("ms"))


@query(f"SELECT sample_id, stage, round(ms, 6) AS ms FROM ({_STAGE})")
def bm_stage(spark, sf_dir):
    return stage_means(timed(spark, sf_dir)).select("sample_id", "stage", r6("ms").alias("ms"))


@query(f"SELECT stage, {_STATS.format('ms')} FROM ({_STAGE}) WHERE category NOT IN (3, 4) GROUP BY stage")
def bm_summary(spark, sf_dir):
    """Statistics of the samples' means by stage, categories that are put off left out."""
    return S.summary(stage_means(timed(spark, sf_dir)).where("category NOT IN (3, 4)"), "stage", "ms", SHARES)


@query(f"SELECT count(*) AS samples, round(avg(heap), 6) AS heap_mb, round(avg(rss), 6) AS rss_mb FROM (SELECT user_id, max(value) * 2 AS heap, max(value) * 5 AS rss FROM events WHERE (user_id % 6 + 1) NOT IN (3, 4) GROUP BY user_id)")
def bm_resource_means(spark, sf_dir):
    """Mean resources of the evaluated samples."""
    used = _events(spark, sf_dir).where("user_id % 6 + 1 NOT IN (3, 4)").groupBy("user_id").agg((F.max("value") * 2).alias("heap"), (F.max("value") * 5).alias("rss"))
    return used.agg(F.count("*").alias("samples"), r6(F.avg("heap")).alias("heap_mb"), r6(F.avg("rss")).alias("rss_mb"))


_UNITS = ("B", "KB", "MB", "GB")
_BYTES = "CASE " + " ".join(f"WHEN b < {1024 ** (i + 1)} THEN printf('%.2f', round(b / {1024**i}.0::DOUBLE, 2)) || ' {u}'" for i, u in enumerate(_UNITS) if i in (1, 2))


@query(f"SELECT event_id, {_BYTES.replace('CASE ', 'CASE WHEN b < 1024 THEN b || ' + chr(39) + ' B' + chr(39) + ' ', 1)} ELSE printf('%.2f', round(b / 1073741824.0::DOUBLE, 2)) || ' GB' END AS size FROM (SELECT event_id, event_id * event_id * 997 AS b FROM events)")
def bm_format_bytes(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", format_bytes(F.col("event_id") * F.col("event_id") * 997).alias("size"))


def format_bytes(b: Column) -> Column:
    """Bytes in the largest unit of at most GB that they fill."""
    out = F.when(b < 1024, F.concat(b.cast("string"), F.lit(" B")))
    for i in (1, 2):
        out = out.when(b < 1024 ** (i + 1), F.format_string(f"%.2f {_UNITS[i]}", b / float(1024**i)))
    return out.otherwise(F.format_string("%.2f GB", b / float(1024**3)))


# ---- expected and found -------------------------------------------------------------------------
# Kinds and layers that metrics are kept for, and the scoring weights.
TYPES = ("email", "phone", "password", "credit_card", "ssn", "address", "name", "face", "government_id")
LAYERS = (1, 2, 3, 4)
WEIGHTS = {"visual_context": 0.25, "precision_recall": 0.20, "redaction": 0.20, "resources": 0.20, "latency": 0.15}
#: Categories whose samples are not scored.
DEFERRED = (4,)

_EXPECTED = "(VALUES (1, 'e1', 'password', 1), (2, 'e2', 'email', 1), (3, 'e3', 'credit_card', 1), (4, 'e4', 'phone', 1), (5, 'e5', 'address', 1), (6, 'e8', 'name', 1), (7, 'e10', 'face', 3), (8, 'e15', 'ssn', 1), (9, 'e16', 'email', 2), (10, 'e16', 'email', 2), (11, 'e16', 'credit_card', 2), (12, 'e12', 'government_id', 3), (13, 'e9', 'none', 1)) AS t(n, element_id, type, layer)"
_TRUTH = f"SELECT c_custkey AS sample_id, t.* FROM customer CROSS JOIN {_EXPECTED} WHERE type <> 'none'"
_LAYER = "CASE source WHEN 'layer1_typed_field' THEN 1 WHEN 'layer2_regex' THEN 2 WHEN 'layer3_visual' THEN 3 WHEN 'layer4_ocr' THEN 4 ELSE 1 END"
_ACTUAL = f"SELECT page_id AS sample_id, id AS element_id, type, source, {_LAYER} AS layer, seq FROM ({C._DET})"
_NTH = "row_number() OVER (PARTITION BY sample_id, element_id, type ORDER BY {0})"
_MATCH = f"""SELECT coalesce(g.sample_id, a.sample_id) AS sample_id, coalesce(g.element_id, a.element_id) AS element_id, coalesce(g.type, a.type) AS type, coalesce(g.layer, a.layer) AS layer,
 CASE WHEN a.sample_id IS NULL THEN 'fn' WHEN g.sample_id IS NULL THEN 'fp' ELSE 'tp' END AS outcome
FROM (SELECT *, {_NTH.format('n')} AS rn FROM ({_TRUTH})) g FULL JOIN (SELECT *, {_NTH.format('seq')} AS rn FROM ({_ACTUAL})) a
ON g.sample_id = a.sample_id AND g.element_id = a.element_id AND g.type = a.type AND g.rn = a.rn"""


def layer_of(source: Column) -> Column:
    """The layer of a detection source; 1 of an unknown one."""
    table = F.create_map(*[F.lit(x) for n, name in P.SOURCES.items() for x in (name, n)])
    return F.coalesce(F.try_element_at(table, source), F.lit(1))


def truth(spark, sf_dir):
    return EL._sql(spark, sf_dir, _TRUTH, "customer")


def actual(spark, sf_dir, found=None):
    """Detections as the matcher reads them: the element's id, type, source and its layer, in order."""
    found = O.detections(O.with_layers(EL.elements(spark, sf_dir))) if found is None else found
    return found.select(F.col("page_id").alias("sample_id"), F.regexp_replace("selector", "^#", "").alias("element_id"), "type", "source", layer_of(F.col("source")).alias("layer"), "seq")


def match(expected: DataFrame, found: DataFrame) -> DataFrame:
    """One-to-one matches on (sample, element, type): the n-th expected with the n-th found, as a greedy matcher makes them."""
    key = ["sample_id", "element_id", "type"]
    nth = lambda order: F.row_number().over(Window.partitionBy(*key).orderBy(order))
    g = expected.select(*key, F.col("layer").alias("g_layer"), nth("n").alias("rn"))
    a = found.select(*key, F.col("layer").alias("a_layer"), nth("seq").alias("rn"))
    outcome = F.when(F.col("a_layer").isNull(), "fn").when(F.col("g_layer").isNull(), "fp").otherwise("tp")
    return g.join(O.merged(a), [*key, "rn"], "full_outer").select(*key, F.coalesce("g_layer", "a_layer").alias("layer"), outcome.alias("outcome"))


def rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}


def rated(df: DataFrame, *keys: str) -> DataFrame:
    """The counts with their rates, not rounded."""
    return df.select(*keys, "tp", "fp", "fn", *[v.alias(k) for k, v in rates(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def _counts() -> list[Column]:
    return [F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn")]


def grid(spark) -> DataFrame:
    """The overall row, nine types and four layers that metrics are given for."""
    rows = [("overall", "all")] + [("type", t) for t in TYPES] + [("layer", str(n)) for n in LAYERS]
    return spark.createDataFrame(rows, "scope string, name string")


def scoped(matches: DataFrame, *by: str) -> DataFrame:
    """Counts overall, by type and by layer in one pass, for each ``by``."""
    keys = [F.col(c) for c in by]
    sets = matches.groupingSets([keys, [*keys, F.col("type")], [*keys, F.col("layer")]], *keys, F.col("type"), F.col("layer")).agg(F.grouping("type").alias("_t"), F.grouping("layer").alias("_l"), *_counts())
    scope = F.when((F.col("_t") == 1) & (F.col("_l") == 1), "overall").when(F.col("_t") == 0, "type").otherwise("layer")
    name = F.when(scope == "overall", "all").when(scope == "type", F.col("type")).otherwise(F.col("layer").cast("string"))
    return sets.select(*by, scope.alias("scope"), name.alias("name"), "tp", "fp", "fn")


_R = lambda a, b: f"round(CASE WHEN {b} > 0 THEN ({a}) / ({b})::DOUBLE ELSE 0 END, 6)"
_RATES = f"{_R('tp', 'tp + fp')} AS precision, {_R('tp', 'tp + fn')} AS recall, {_R('2 * tp', '2 * tp + fp + fn')} AS f1"
_PLAIN_RATES = _RATES.replace("round(", "(").replace(", 6)", ")")
_COUNTS = ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in ("tp", "fp", "fn"))
_GRID = "SELECT 'overall' AS scope, 'all' AS name UNION ALL SELECT 'type', unnest(" + str(list(TYPES)) + ") UNION ALL SELECT 'layer', unnest(" + str([str(n) for n in LAYERS]) + ")"
_SCOPED = f"""SELECT sample_id, 'overall' AS scope, 'all' AS name, {_COUNTS} FROM ({_MATCH}) GROUP BY sample_id UNION ALL SELECT sample_id, 'type', type, {_COUNTS} FROM ({_MATCH}) GROUP BY sample_id, type
UNION ALL SELECT sample_id, 'layer', layer::VARCHAR, {_COUNTS} FROM ({_MATCH}) GROUP BY sample_id, layer"""


@query(f"SELECT source, {_LAYER} AS layer, count(*) AS n FROM (SELECT source FROM ({C._DET}) UNION ALL SELECT unnest(['layer4_ocr', 'manual', '']) AS source) GROUP BY ALL")
def ev_layer(spark, sf_dir):
    """The layer of each source of detections, and of sources that no detector here has."""
    more = spark.createDataFrame([("layer4_ocr",), ("manual",), ("",)], "source string")
    found = O.detections(O.with_layers(EL.elements(spark, sf_dir)))
    return found.select("source").unionByName(more).groupBy("source", layer_of(F.col("source")).alias("layer")).agg(F.count("*").alias("n"))


@query(_ACTUAL)
def ev_actual(spark, sf_dir):
    return actual(spark, sf_dir)


@query(_MATCH)
def ev_match(spark, sf_dir):
    return match(truth(spark, sf_dir), actual(spark, sf_dir))


METRICS_SQL = f"SELECT g.scope, g.name, coalesce(tp, 0)::BIGINT AS tp, coalesce(fp, 0)::BIGINT AS fp, coalesce(fn, 0)::BIGINT AS fn FROM ({_GRID}) g LEFT JOIN (SELECT scope, name, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM ({_SCOPED}) GROUP BY ALL) m ON m.scope = g.scope AND m.name = g.name"


@query(f"SELECT scope, name, tp, fp, fn, {_RATES} FROM ({METRICS_SQL})")
def ev_metrics(spark, sf_dir):
    """A dense grid: overall, nine types, four layers; zeros where nothing was expected or found."""
    m = scoped(match(truth(spark, sf_dir), actual(spark, sf_dir)))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    dense = F.broadcast(grid(spark)).join(m, ["scope", "name"], "left").select("scope", "name", zero("tp"), zero("fp"), zero("fn"))
    return rated(dense, "scope", "name").withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


# ---- redaction and security ---------------------------------------------------------------------
_REDACTIONS = "(VALUES ('e1', 'password', '[PASSWORD]'), ('e2', 'email', '[EMAIL]'), ('e3', 'credit_card', '[CREDIT_CARD]'), ('e4', 'phone', '[PHONE]'), ('e13', 'email', '[EMAIL]'), ('e15', 'ssn', '[SSN]'), ('e16', 'email', '[EMAIL]')) AS t(element_id, type, placeholder)"
_RED_EXPECTED = f"SELECT c_custkey AS sample_id, t.* FROM customer CROSS JOIN {_REDACTIONS}"
_RED = f"""SELECT x.sample_id, count(*) AS expected, count(*) FILTER (coalesce(text, '') = placeholder) AS correct FROM ({_RED_EXPECTED}) x
LEFT JOIN (SELECT page_id, id, first(text ORDER BY elem_idx) AS text FROM ({C._CLEAN}) WHERE id <> '' GROUP BY ALL) c ON c.page_id = x.sample_id AND c.id = x.element_id GROUP BY x.sample_id"""


def redaction_results(expected: DataFrame, clean: DataFrame) -> DataFrame:
    """A row a sample: expected redactions, those whose element's whole text is the placeholder, the rest, precision.

    An element is the first one of a sanitized context with the expected id; without one the redaction leaked.
    """
    texts = clean.select(F.col("page_id").alias("sample_id"), O.attribute("id").alias("element_id"), F.struct("elem_idx", "text").alias("e"))
    first = texts.groupBy("sample_id", "element_id").agg(F.min("e").alias("e"))
    each = expected.join(O.merged(first), ["sample_id", "element_id"], "left")
    correct = F.coalesce(F.col("e.text"), F.lit("")) == F.col("placeholder")
    out = each.groupBy("sample_id").agg(F.count("*").alias("expected"), F.count_if(correct).alias("correct"))
    return out.select("sample_id", "expected", "correct", (F.col("expected") - F.col("correct")).alias("leaked"), r6(F.col("correct") / F.col("expected")).alias("precision"))


def redactions(spark, sf_dir, full=None):
    full = C.base(spark, sf_dir).full if full is None else full
    return redaction_results(EL._sql(spark, sf_dir, _RED_EXPECTED, "customer"), O.sanitized_deep(full))


RED_SQL = f"SELECT sample_id, expected, correct, expected - correct AS leaked, round(correct / expected::DOUBLE, 6) AS precision FROM ({_RED})"


@query(RED_SQL)
def ev_redaction(spark, sf_dir):
    return redactions(spark, sf_dir)


_HIDDEN = "(VALUES ('e13', true), ('e17', true), ('e18', true), ('e14', false)) AS t(element_id, injection)"
_OUTCOMES = "(VALUES (1, '#e1', 'fill', true), (2, '#e28', 'click', false), (3, '#e99', 'click', true), (4, '#e16', 'click', true), (5, '#e4', 'fill', true)) AS t(n, target, action, malicious)"
_ASKED = f"""SELECT c_custkey * 10 + n AS action_id, c_custkey AS page_id, concat('{{"action": "', action, '", "target": "', target, '", "reasoning_id": "r1"}}') AS raw, malicious
FROM customer CROSS JOIN {_OUTCOMES} WHERE NOT (n = 5 AND c_custkey % 2 = 1)"""
_VERDICTS = C.valid_sql(f"SELECT action_id, page_id, raw FROM ({_ASKED})")
SECURITY_SQL = f"""SELECT s.page_id AS sample_id, coalesce(found > 0 AND filtered = found, false) AS hidden_filtered, attempts > 0 AND rejected = attempts AS malicious_rejected, executed = 0 OR rejected = attempts AS rejected_not_executed, attempts, rejected, executed
FROM (SELECT a.page_id, count(*) FILTER (malicious) AS attempts, count(*) FILTER (malicious AND reason IS NOT NULL) AS rejected, count(*) FILTER (reason IS NULL) AS executed FROM ({_ASKED}) a JOIN ({_VERDICTS}) v ON v.action_id = a.action_id GROUP BY a.page_id) s
LEFT JOIN (SELECT c_custkey AS page_id, count(*) AS found, count(*) FILTER (NOT coalesce(visible, false)) AS filtered FROM customer CROSS JOIN {_HIDDEN} LEFT JOIN (SELECT page_id, id, first(visible ORDER BY elem_idx) AS visible FROM ({EL.ELEMENTS_SQL}) GROUP BY ALL) e ON e.page_id = c_custkey AND e.id = element_id WHERE injection GROUP BY c_custkey) h ON h.page_id = s.page_id"""


def security_results(hidden: DataFrame, outcomes: DataFrame, elements: DataFrame) -> DataFrame:
    """A row a sample with three flags: hidden injections filtered, malicious actions rejected, rejected ones not executed.

    ``hidden``: sample_id, element_id of expected injections; ``outcomes``: sample_id, malicious, reason of each asked action.
    """
    # no filter on the id: a condition on so long an expression takes the optimizer long in joins, and no expected id is empty
    own = elements.select(F.col("page_id").alias("sample_id"), O.attribute("id").alias("element_id"), F.struct("elem_idx", "visible").alias("e"))
    first = own.groupBy("sample_id", "element_id").agg(F.min("e").alias("e"))
    unseen = ~F.coalesce(F.col("e.visible"), F.lit(False))
    found = hidden.join(O.merged(first), ["sample_id", "element_id"], "left").groupBy("sample_id").agg(F.count("*").alias("found"), F.count_if(unseen).alias("filtered"))
    bad, caught = F.col("malicious"), F.col("reason").isNotNull()
    tried = outcomes.groupBy("sample_id").agg(F.count_if(bad).alias("attempts"), F.count_if(bad & caught).alias("rejected"), F.count_if(~caught).alias("executed"))
    all_ = tried.join(O.merged(found), "sample_id", "left")
    stopped = F.col("rejected") == F.col("attempts")
    return all_.select(
        "sample_id", F.coalesce((F.col("found") > 0) & (F.col("filtered") == F.col("found")), F.lit(False)).alias("hidden_filtered"), ((F.col("attempts") > 0) & stopped).alias("malicious_rejected"),
        ((F.col("executed") == 0) | stopped).alias("rejected_not_executed"), "attempts", "rejected", "executed",
    )


def security(spark, sf_dir, full=None):
    hidden = EL._sql(spark, sf_dir, f"SELECT c_custkey AS sample_id, element_id FROM customer CROSS JOIN {_HIDDEN} WHERE injection", "customer")
    asked = EL._sql(spark, sf_dir, _ASKED, "customer")
    annotated = C.base(spark, sf_dir).full if full is None else full  # each page is asked for
    verdicts = C.validated(spark, sf_dir, asked.select("action_id", "page_id", "raw"), full=annotated).select("action_id", "reason")
    outcomes = asked.select("action_id", F.col("page_id").alias("sample_id"), "malicious").join(O.merged(verdicts), "action_id")
    return security_results(hidden, outcomes, EL.elements(spark, sf_dir) if full is None else full)


@query(SECURITY_SQL)
def ev_security(spark, sf_dir):
    return security(spark, sf_dir)


# ---- categories ---------------------------------------------------------------------------------
_SAMPLES = f"SELECT s.*, s.sample_id % 6 + 1 AS category, {_PLAIN_RATES} FROM ({_SCOPED}) s"
_CATEGORY = "sample_id % 6 + 1"


def based(spark, sf_dir):
    """The base of an evaluation, whose annotated elements several parts read."""
    b = C.base(spark, sf_dir)
    return b._replace(full=materialize(b.full, "full"))


def scores(spark, sf_dir, found=None):
    """Each sample's rates overall, by type and by layer, with its category and whether it is scored."""
    m = rated(scoped(match(truth(spark, sf_dir), actual(spark, sf_dir, found)), "sample_id"), "sample_id", "scope", "name")
    return m.withColumn("category", F.expr(_CATEGORY)).withColumn("scored", ~F.col("category").isin(*DEFERRED))


_MEANS = ", ".join(f"coalesce(round(avg({c}) FILTER (scored), 5), 0) AS {c}" for c in ("precision", "recall", "f1"))
_SCORED = f"SELECT *, category NOT IN ({', '.join(map(str, DEFERRED))}) AS scored FROM ({_SAMPLES})"
_PASS = "hidden_filtered AND malicious_rejected AND rejected_not_executed"


def _means() -> list[Column]:
    return [F.coalesce(F.round(F.avg(F.when(F.col("scored"), F.col(c))), 5), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")]


@query(f"""SELECT * FROM (SELECT category, count(*) FILTER (scored) AS samples, count(*) FILTER (NOT scored) AS deferred, {_MEANS} FROM ({_SCORED}) WHERE scope = 'overall' GROUP BY category)
LEFT JOIN (SELECT {_CATEGORY} AS category, coalesce(round(avg(precision), 5), 1) AS redaction_precision FROM ({RED_SQL}) GROUP BY ALL) USING (category)
LEFT JOIN (SELECT {_CATEGORY} AS category, round(avg(({_PASS})::INT), 5) AS security_pass_rate FROM ({SECURITY_SQL}) GROUP BY ALL) USING (category)""")
def ev_category(spark, sf_dir):
    b = based(spark, sf_dir)
    return category_table(scores(spark, sf_dir, b.found), redactions(spark, sf_dir, b.full), security(spark, sf_dir, b.full))


def category_table(scored: DataFrame, redacted: DataFrame, secured: DataFrame) -> DataFrame:
    """Macro averages of the scored samples, mean redaction precision and security pass rate, by category."""
    own = scored.where("scope = 'overall'").groupBy("category").agg(F.count_if("scored").alias("samples"), F.count_if(~F.col("scored")).alias("deferred"), *_means())
    red = redacted.groupBy(F.expr(_CATEGORY).alias("category")).agg(F.coalesce(F.round(F.avg("precision"), 5), F.lit(1.0)).alias("redaction_precision"))
    safe = secured.groupBy(F.expr(_CATEGORY).alias("category")).agg(F.round(F.avg(F.expr(_PASS).cast("int")), 5).alias("security_pass_rate"))
    return own.join(red, "category", "left").join(safe, "category", "left")


@query(f"""SELECT c.category, g.scope, g.name, coalesce(precision, 0) AS precision, coalesce(recall, 0) AS recall, coalesce(f1, 0) AS f1 FROM (SELECT unnest(range(1, 7)) AS category) c CROSS JOIN ({_GRID}) g
LEFT JOIN (SELECT category, scope, name, {_MEANS} FROM ({_SCORED}) GROUP BY ALL) m ON m.category = c.category AND m.scope = g.scope AND m.name = g.name WHERE g.scope <> 'overall'""")
def ev_breakdown(spark, sf_dir):
    return breakdown_table(scores(spark, sf_dir))


def breakdown_table(scored: DataFrame) -> DataFrame:
    """By category and type or layer: averages over the scored samples that expect or find any there; zeros elsewhere."""
    spark = scored.sparkSession
    dense = spark.range(1, 7).select(F.col("id").alias("category")).join(F.broadcast(grid(spark).where("scope <> 'overall'")))
    have = scored.groupBy("category", "scope", "name").agg(*_means())
    joined = dense.join(have, ["category", "scope", "name"], "left")
    return joined.select("category", "scope", "name", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""SELECT * FROM (SELECT count(*) AS samples, count(*) FILTER (scored) AS evaluated, count(*) FILTER (NOT scored) AS deferred, {_MEANS} FROM ({_SCORED}) WHERE scope = 'overall'),
(SELECT coalesce(round(avg(precision), 5), 1) AS redaction_precision FROM ({RED_SQL}))""")
def ev_full(spark, sf_dir):
    b = based(spark, sf_dir)
    return full_table(scores(spark, sf_dir, b.found), redactions(spark, sf_dir, b.full))


def full_table(scored: DataFrame, redacted: DataFrame) -> DataFrame:
    """One row: numbers of samples and macro averages."""
    own = scored.where("scope = 'overall'").agg(F.count("*").alias("samples"), F.count_if("scored").alias("evaluated"), F.count_if(~F.col("scored")).alias("deferred"), *_means())
    red = redacted.agg(F.coalesce(F.round(F.avg("precision"), 5), F.lit(1.0)).alias("redaction_precision"))
    return own.withColumn("_one", F.lit(1)).join(red.withColumn("_one", F.lit(1)), "_one").drop("_one")


_PARTS = "(VALUES ('visual_context', 0.25::DOUBLE), ('precision_recall', 0.20::DOUBLE), ('redaction', 0.20::DOUBLE), ('resources', 0.20::DOUBLE), ('latency', 0.15::DOUBLE)) AS w(part, weight)"
_PARTS_OF = "CASE part WHEN 'visual_context' THEN recall WHEN 'precision_recall' THEN f1 WHEN 'redaction' THEN precision WHEN 'resources' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END"


@query(f"SELECT sample_id, round(sum(weight * {_PARTS_OF}), 6) AS score FROM ({_SCORED}) CROSS JOIN {_PARTS} WHERE scope = 'overall' GROUP BY sample_id")
def ev_weights(spark, sf_dir):
    """The weighted score of samples whose five criteria lie between 0 and 1."""
    parts = {"visual_context": F.col("recall"), "precision_recall": F.col("f1"), "redaction": F.col("precision"), "resources": F.lit(0.5), "latency": F.lit(1.0)}
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + F.lit(weight) * parts[name]
    return scores(spark, sf_dir).where("scope = 'overall'").select("sample_id", r6(total).alias("score"))


# ---- strategies ---------------------------------------------------------------------------------
_MS = "page_id * 37 % 1000 / 100.0E0"
_RUNS = f"SELECT *, {_MS} AS ms, page_id % 6 + 1 AS category FROM ({C.RUNS_SQL}) WHERE mode = 'heuristic'"
_SHARE = lambda c: f"round(count(*) FILTER ({c}) / count(*)::DOUBLE, 6)"


def runs(spark, sf_dir):
    return C.runs(spark, sf_dir).where("mode = 'heuristic'").withColumn("ms", F.expr(_MS)).withColumn("category", F.expr("page_id % 6 + 1"))


def _summary() -> list[Column]:
    i = F.col("invoked")
    share = lambda c: r6(F.count_if(c) / F.count("*"))
    return [F.count_if(i).alias("invocations"), F.count_if(~i).alias("skips"), share(i).alias("rate"), r6(F.avg("ms")).alias("avg_ms"), r6(F.avg("detections")).alias("avg_detections")]


_SUMMARY = f"count(*) FILTER (invoked) AS invocations, count(*) FILTER (NOT invoked) AS skips, {_SHARE('invoked')} AS rate, round(avg(ms), 6) AS avg_ms, round(avg(detections), 6) AS avg_detections"


@query(f"SELECT strategy, {_SUMMARY}, round(avg(redactions), 6) AS avg_redactions, {_SHARE('model_success')} AS model_success_rate FROM ({_RUNS}) GROUP BY strategy")
def ex_strategy_summary(spark, sf_dir):
    return strategy_table(runs(spark, sf_dir))


def strategy_table(ran: DataFrame) -> DataFrame:
    more = [r6(F.avg("redactions")).alias("avg_redactions"), r6(F.count_if("model_success") / F.count("*")).alias("model_success_rate")]
    return ran.groupBy("strategy").agg(*_summary(), *more)


_ZERO = ("invocations", "skips", "rate", "avg_ms", "avg_detections")


@query(f"""SELECT c AS category, s AS strategy, {', '.join(f'coalesce({z}, 0) AS {z}' for z in _ZERO)} FROM (SELECT unnest(range(1, 7)) AS c) CROSS JOIN (SELECT unnest({list(O.STRATEGIES)}) AS s)
LEFT JOIN (SELECT category, strategy, {_SUMMARY} FROM ({_RUNS}) WHERE category <> 6 GROUP BY ALL) r ON r.category = c AND r.strategy = s""")
def ex_category_strategy(spark, sf_dir):
    """A dense grid of six categories and three strategies; zeros where nothing ran (here the last category)."""
    return category_strategy_table(runs(spark, sf_dir))


def category_strategy_table(ran: DataFrame) -> DataFrame:
    spark = ran.sparkSession
    dense = spark.range(1, 7).select(F.col("id").alias("category"), F.explode(F.array(*map(F.lit, O.STRATEGIES))).alias("strategy"))
    have = ran.where("category <> 6").groupBy("category", "strategy").agg(*_summary())
    joined = dense.join(have, ["category", "strategy"], "left")
    return joined.select("category", "strategy", *[F.coalesce(z, F.lit(0)).alias(z) for z in _ZERO])
