"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each node of the tree a document makes one weighted hash draw a child, ``-ln(u) / weight`` with u a
hash of its id and the child's name, and goes down to the child with the least draw: to a region, then
to one of its racks, then to one of its shards. So a document costs the sum of the fan-outs on its way,
not a draw a shard. A child's weight is that of its whole subtree; if it falls, rows leave that child
for its siblings, if it rises they come from them, and nothing moves between children of equal weights.

The tree keeps its growth: weight that comes later is a further increment, a tree of its own below the
same nodes. A region's draw is the least over its increments, each hashed by itself, and the way down
from a draw stays in its increment. So the draws of older increments do not change, and rows move only
into the shards that grow.

Defined cases: a null id hashes as the word ``null``; a null text has no bytes; equal ids go to the
same shard; repeated rows each get a slot; an empty table gives an empty table; extra columns of
the input are not used and can't clash, as only id and text are read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from piiguard.llm.common import materialize

OVERHEAD_BYTES = 16
#: Shards of the first increment; further ones are increments of one shard each.
FIRST = 40


@dataclass(frozen=True)
class Leaf:
    """A share of weight of a shard; a shard has one in each increment that gives it weight."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0
    increment: int = 0


def tree(shards: int, first: int = FIRST, shards_per_rack: int = 4, racks_per_region: int = 5) -> tuple[Leaf, ...]:
    """A tree of equal shards, filled in order; a further shard opens a rack or region as needed."""
    place = lambda s: (s // (shards_per_rack * racks_per_region), s // shards_per_rack, s)
    return tuple(Leaf(*place(s), increment=max(s - first + 1, 0)) for s in range(shards))


#: Draws are taken modulo this prime.
PRIME = 2**31 - 1


def _factors(name: str) -> tuple[int, ...]:
    """A node's own multipliers below 2**28, from a digest of its name."""
    digest = hashlib.sha256(name.encode()).hexdigest()
    return tuple(int(digest[7 * i : 7 * i + 7], 16) + 1 for i in range(4))


@dataclass(frozen=True)
class Child:
    """An option of a descent: what it leads to, its name, its weight, and the leaves below."""

    number: int
    name: str
    weight: float
    leaves: tuple[Leaf, ...]


def children(leaves: tuple[Leaf, ...], level: str) -> list[Child]:
    """The options below a node with ``leaves``; of the top node one for each region and increment."""
    groups: dict[tuple[int, int], list[Leaf]] = {}
    for leaf in leaves:
        groups.setdefault((leaf.increment, getattr(leaf, level)), []).append(leaf)
    return [Child(n, f"{level}/{n}/{i}", sum(leaf.weight for leaf in own), tuple(own)) for (i, n), own in groups.items()]


def _draw(x: Column, y: Column, option: Column) -> Column:
    """An exponential draw of rate ``option.w``: a quadratic hash of the id's two 28-bit halves."""
    p = F.lit(PRIME).cast("long")
    h = (x * option["a"] + y * option["b"] + option["c"]) % p
    return -F.ln((((h * h) % p + x * option["d"] + y) % p + F.lit(0.5)) / F.lit(float(PRIME))) / option["w"]


def _table(nodes: list[list[Child]]) -> Column:
    """The options of each node of a level, as a constant: multipliers, weight, number within the level."""
    def row(o: Child, n: int) -> Column:
        factors = [F.lit(x).cast("long").alias(k) for k, x in zip("abcd", _factors(o.name), strict=True)]
        return F.struct(*factors, F.lit(float(o.weight)).alias("w"), F.lit(n).alias("n"))

    return F.array(*[F.array(*[row(o, start + i) for i, o in enumerate(options)]) for start, options in zip(_starts(nodes), nodes, strict=True)])


def _levels(leaves: tuple[Leaf, ...]) -> list[list[list[Child]]]:
    """The nodes of each level with their options; options of a level, in order, are the next one's nodes."""
    levels, nodes = [], [leaves]
    for level in ("region", "rack", "shard"):
        levels.append([children(node, level) for node in nodes])
        nodes = [option.leaves for options in levels[-1] for option in options]
    return levels


def _starts(nodes: list[list[Child]]) -> list[int]:
    """How many options the nodes before each node have."""
    return [sum(map(len, nodes[:i])) for i in range(len(nodes))]


def descend(docs: DataFrame, leaves: tuple[Leaf, ...], out: str) -> DataFrame:
    """Add the shard ``out`` that the tree gives the row with the id halves ``_x`` and ``_y``."""
    df, levels = docs.withColumn("_at", F.lit(0)), _levels(leaves)
    for nodes in levels:
        # only the options of the row's own node are drawn for; the least one's number is the next level's node
        drawn = F.transform(F.get(_table(nodes), F.col("_at")), lambda o: F.struct(_draw(F.col("_x"), F.col("_y"), o).alias("draw"), o["n"].alias("n")))
        df = df.withColumn("_at", F.array_min(drawn)["n"])
    shards = F.array(*[F.lit(o.number) for options in levels[-1] for o in options])
    return df.withColumn(out, F.get(shards, F.col("_at")).cast("int")).drop("_at")


def assign(docs: DataFrame, leaves: tuple[Leaf, ...], grown: tuple[Leaf, ...]) -> DataFrame:
    """doc_id, size, text_crc32 and the shards under both trees; ``grown`` must extend ``leaves``."""
    if grown[: len(leaves)] != leaves or {leaf.increment for leaf in grown[len(leaves) :]} & {leaf.increment for leaf in leaves}:
        raise ValueError("the grown tree must extend the tree by increments of its own")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    body = F.coalesce(F.col("text"), F.lit(""))
    half = lambda at: F.conv(F.substring(F.md5(key), at, 7), 16, 10).cast("long")
    df = docs.select(
        "doc_id", (F.octet_length(body) + OVERHEAD_BYTES).cast("long").alias("size"), F.crc32(F.encode(body, "utf-8")).alias("text_crc32"),
        half(1).alias("_x"), half(8).alias("_y"),
    )
    return descend(descend(df, leaves, "shard"), grown, "grown_shard").drop("_x", "_y")


def number(rows: DataFrame, group: str, order: list[str], out: str = "slot") -> DataFrame:
    """Gapless numbers from 0 within ``group``, in ``order``, without a task per group.

    Rows are dealt by ranges of ``order`` (a unique row number breaks ties, so hot keys split too);
    each range counts its rows by group; the offset of a range in a group is the sum of the counts
    before it. Only these counts, ranges times groups, are windowed by group.
    """
    spark = rows.sparkSession
    slim = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = slim.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in order], F.col("_row"))
    dealt = materialize(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range", group).orderBy(*[F.col(c).asc_nulls_first() for c in order], "_row")
    ranked = dealt.withColumn("_rank", F.row_number().over(inside) - 1)
    # offsets are ranges times groups: merged, never broadcast, as the ranges grow with the input
    joined = ranked.join(offsets.hint("merge"), [group, "_range"])
    return joined.select(*[c for c in rows.columns], (F.col("_offset") + F.col("_rank")).cast("long").alias(out))


def shard(docs: DataFrame, shards: int = 40, first: int = FIRST) -> DataFrame:
    """The rows of ``docs`` in a tree of ``shards``, and where one more would take them."""
    leaves, grown = tree(shards, min(shards, first)), tree(shards + 1, min(shards, first))
    numbered = number(assign(docs, leaves, grown), "shard", ["doc_id", "text_crc32", "size"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


# ----------------------------------------------------------------------------------------------
def op8_sharding(spark, sf_dir):
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _descent_sql(leaves: tuple[Leaf, ...], source: str, out: str) -> str:
    """The descent as nested queries: each level's draws as a list, and the place of its least one."""
    def draw(o: Child) -> str:
        a, b, c, d = _factors(o.name)
        h = f"((x * {a} + y * {b} + {c}) % {PRIME})"
        return f"-ln((({h} * {h} % {PRIME} + x * {d} + y) % {PRIME} + 0.5) / {PRIME}.0::DOUBLE) / {o.weight}::DOUBLE"

    sql = f"SELECT *, 0 AS node FROM {source}"
    levels = _levels(leaves)
    for nodes in levels:
        draws = " ".join(f"WHEN {i} THEN [{', '.join(map(draw, options))}]" for i, options in enumerate(nodes))
        starts = f"[{', '.join(map(str, _starts(nodes)))}]"
        sql = f"SELECT * EXCLUDE (node, l), {starts}[node + 1] + list_position(l, list_min(l)) - 1 AS node FROM (SELECT *, CASE node {draws} END AS l FROM ({sql}))"
    shards = ", ".join(str(o.number) for options in levels[-1] for o in options)
    return f"SELECT * EXCLUDE (node), [{shards}][node + 1]::INTEGER AS {out} FROM ({sql})"


def _sql(shards: int = 40) -> str:
    return f"""
WITH RECURSIVE crc(i, k, c) AS (
  SELECT i::BIGINT, 0, i::BIGINT FROM range(0, 256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
d AS (SELECT doc_id, md5(coalesce(doc_id::VARCHAR, 'null')) AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, ('0x' || substr(k, 1, 7))::BIGINT AS x, ('0x' || substr(k, 8, 7))::BIGINT AS y, octet_length(unhex(h))::BIGINT AS n, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM d),
e AS (SELECT doc_id, (n + 16)::BIGINT AS size, x, y,
        xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM b, tab),
s AS ({_descent_sql(tree(shards), 'e', 'shard')}),
g AS ({_descent_sql(tree(shards + 1), 's', 'grown_shard')})
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot, grown_shard
FROM g"""


QUERIES = {"op8_sharding": op8_sharding}
ORACLES = {"op8_sharding": _sql()}
