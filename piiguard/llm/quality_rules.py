"""Quality rules: a threshold table compiled into one Spark projection (no user functions).

Defined cases: a null or empty text has no words, hence ``base_failed``; repeated rows are judged
each on its own; an empty table gives an empty table; extra columns of the input never reach the
result of :func:`measure` and never clash with it, and :func:`keep` returns the input's columns only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from piiguard.llm.common import SEPARATOR_CLASS, words_of

WINDOW = 8
SYMBOL_CLASS = "[#*$%&|<>]"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to a in is that for on was with as it by from at are this an be or not he his they have had but "
    "la les le de des et en des un une du dans que pour est au par sur avec il ne se ce pas qui son "
    "der die und in den von zu das mit ist nicht sich ein eine für auf im dem des als auch es an er so "
    "el los las y por con del no su al lo como más o pero sus"
).split()


@dataclass(frozen=True)
class Rule:
    """``metric`` must lie in [low, high] (None: open) for texts of at least ``min_words`` words."""

    name: str
    metric: str
    low: float | None
    high: float | None
    min_words: int = 0


#: The production threshold table.
RULES = (
    Rule("length", "n_words", 20, None),
    Rule("word_length", "mean_word_chars", 2.0, 12.0),
    Rule("symbols", "symbol_ratio", None, 0.10),
    Rule("stop_words", "stop_word_ratio", 0.06, None, 40),
    Rule("line_repeats", "dup_line_ratio", None, 0.50),
)


def _bind(value: Column, body) -> Column:
    """``body`` of a lambda variable that holds ``value``, which is so evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _window_hashes(words: Column) -> Column:
    """A 64-bit hash for each run of WINDOW = 8 words: runs of 2, 4 and 8 from pairs of the half."""
    def doubled(half: int):
        def body(h: Column) -> Column:
            n = F.greatest(F.size(h) - half, F.lit(0))
            return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(half + 1), n), lambda a, b: F.xxhash64(a, b))

        return body

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    for half in (1, 2, 4):
        hashes = _bind(hashes, doubled(half))
    return hashes


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words inside 8-word windows that the text has twice or more.

    Windows are compared by 64-bit hash first; only texts with an equal pair go on: their windows
    are sorted by hash and place, neighbours of one hash are compared word by word, and the spans of
    the equal ones are united.
    """
    window = lambda i: F.slice(words, i + 1, F.lit(WINDOW))

    def equal(s: Column, j: Column, x: Column) -> Column:
        other = F.get(s, j)
        return F.coalesce((other["h"] == x["h"]) & (window(other["i"]) == window(x["i"])), F.lit(False))

    spans = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = _bind(spans, lambda s: F.filter(s, lambda x, j: equal(s, j - 1, x) | equal(s, j + 1, x)))
    at = F.sort_array(F.transform(repeated, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("e"), F.lit(0).alias("t"))
    step = lambda a, i: F.struct((i + WINDOW).alias("e"), (a["t"] + i + WINDOW - F.greatest(i, a["e"])).alias("t"))
    exact = F.aggregate(at, start, step, lambda a: a["t"])
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), exact).otherwise(F.lit(0)).cast("long")


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row, its measures, ``base_failed``, ``failed_rules`` and ``kept``."""
    body = F.coalesce(F.col(text), F.lit(""))
    stops = sorted({v for w in STOP_WORDS for v in (w, w.capitalize())})
    base = docs.select(*[F.col(c) for c in keep], body.alias("_text"), words_of(F.col(text)).alias("_words"))
    base = base.withColumn("_hashes", _window_hashes(F.col("_words")))
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    one = base.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        _repeat_words(F.col("_words"), F.col("_hashes")).alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w: w.isin(*stops))).cast("long").alias("n_stop_words"),
    )
    two = one.select(
        *keep, "n_words", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", "n_stop_words", F.size("_lines").cast("long").alias("n_lines"),
    )
    return verdict(two, rules)


def verdict(measures: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Compile the threshold table into ``base_failed``, ``failed_rules`` and ``kept``."""
    n, share = F.col("n_words"), lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    metrics = {
        "n_words": n.cast("double"),
        "mean_word_chars": share("word_chars", "n_words"),
        "symbol_ratio": share("n_symbols", "word_chars"),
        "stop_word_ratio": share("n_stop_words", "n_words"),
        "dup_line_ratio": share("n_dup_lines", "n_lines"),
    }
    broken = []
    for r in rules:
        m, bad = metrics[r.metric], F.lit(False)
        if r.low is not None:
            bad = bad | (m < r.low)
        if r.high is not None:
            bad = bad | (m > r.high)
        broken.append(F.when(bad & (n >= r.min_words), F.lit(r.name)))
    failed = (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)
    out = measures.select("*", failed.alias("base_failed"), F.array_compact(F.array(*broken)).alias("failed_rules"))
    return out.select("*", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only.

    The filter also reads a row number: the optimizer moves no filter below a column that is not
    deterministic, and so does not write every measure out again in place of ``kept``.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("_body"))
    judged = measure(packed, rules, text="_body", keep=("_row",)).select("_row", "kept", F.monotonically_increasing_id().alias("_place"))
    return judged.where("kept AND _place >= 0").select("_row.*")


# ----------------------------------------------------------------------------------------------
def op2_quality_rules(spark, sf_dir):
    return measure(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql() -> str:
    stops = ", ".join(f"'{v}'" for v in sorted({v for w in STOP_WORDS for v in (w, w.capitalize())}))
    sep = SEPARATOR_CLASS.replace("\\x20", " ").replace("\\x09", "\\t").replace("\\x0D", "\\r")
    word = "'[^" + sep[1:-1] + "]+'"
    return f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid,
                  regexp_extract_all(coalesce(text, ''), {word}) AS ws FROM documents),
win AS (SELECT rid, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS s
        FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 6, 1))) AS i FROM w)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words
        FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '{SYMBOL_CLASS}'))::BIGINT AS n_symbols,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {word})) AS lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             len(list_filter(ws, lambda x: x IN ({stops})))::BIGINT AS n_stop
      FROM w LEFT JOIN rep USING (rid)),
k AS (SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / greatest(n_words, 1) BETWEEN 2.0 AND 12.0
       AND n_symbols / greatest(word_chars, 1) <= 0.10
       AND (n_words < 40 OR n_stop / greatest(n_words, 1) >= 0.06)
       AND n_dup_lines / greatest(len(lines), 1) <= 0.50 AS kept
FROM k"""


QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLES = {"op2_quality_rules": _sql()}
