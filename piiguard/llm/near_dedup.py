"""Near-duplicate documents by b-bit MinHash.

A document's set is its distinct 5-word shingles, after lower-casing A-Z. ``PERMUTATIONS`` minima are
taken of each set; groups of ``BAND_ROWS`` minima are band keys, and only the ``BITS`` low bits of each
minimum are kept, packed into a signature. Documents that share a band key are candidates; equal
fields of two signatures, counted by bits and corrected for chance collisions, estimate their
similarity, and pairs well below the threshold go. The rest is confirmed on the full sets.

Links become components without listing all pairs of a group. Equal texts count as one. First each
document is compared with one smaller document of its buckets and linked components are contracted.
Then the documents outside the main component of a bucket are compared with the members of other
components there, chunk by chunk in cells of bounded size that give only links that join components.
Every candidate pair is so confirmed, refuted, or inside one component. All tables stay distributed;
rounds are cut by tables in the shared folder.

Defined cases: a text of one to four words is one shingle; a null, empty or blank text has none, is
linked with nothing and is kept; a null id takes no part: its component is null and it is kept; equal
rows share a component; rows of one id with different texts are documents of their own: each has the
component of its text, named by the least id there, and ``kept`` compares ids only, while :func:`keep`
leaves one (id, text) of a component, the one with the least id and then the least digest; an empty
table gives an empty table; extra columns are not read by :func:`components` and kept by :func:`keep`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from piiguard.llm.common import SEPARATORS, materialize, released, table

SHINGLE = 5
PERCENT = 75
PERMUTATIONS = 128
BAND_ROWS = 4
BANDS = PERMUTATIONS // BAND_ROWS
BITS = 2
#: Estimated similarity below which a pair is not confirmed; over 5 standard errors under PERCENT.
LEAST_ESTIMATE = 0.5
#: Rows of a side of a cell in the comparison of components, and rows of cells in a group, about.
CHUNK = 256
GROUP_ROWS = 4096
#: Bytes of text whose shingles are made at once; they take about 50 bytes a byte of text.
SLICE_BYTES = 1 << 20

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RANDOM.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_A = _RANDOM.integers(0, 1 << 31, PERMUTATIONS, np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RANDOM.integers(0, 1 << 32, PERMUTATIONS, np.uint32)
_P, _K = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SEPARATORS]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _K
    h = (h ^ (h >> np.uint64(29))) * _P
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text (large_binary or binary, no nulls)."""
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    # one separator behind each text keeps words of neighbours apart
    raw = np.frombuffer(b"\n".join(texts.to_pylist()) + b"\n", np.uint8)
    raw = _LOWER[raw]
    ends = np.cumsum(lengths + 1)
    inside = ~_IS_SPACE[raw]
    at = np.flatnonzero(inside)
    if not len(at):
        return [np.zeros(0, np.uint64)] * len(texts)
    begins = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    sizes = np.diff(begins, append=len(at))
    place = np.arange(len(at)) - np.repeat(begins, sizes)
    powers = np.cumprod(np.full(int(place.max()) + 1, _P))
    words = _mix(np.add.reduceat(_BYTE[raw[at]] * powers[place], begins) + sizes.astype(np.uint64))
    edges = np.searchsorted(at[begins], np.concatenate([[0], ends]))
    joined = words.copy()
    for j in range(1, SHINGLE):
        joined[: len(words) - j] = joined[: len(words) - j] * _K + words[j:]
    joined = _mix(joined)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(joined[a : b - SHINGLE + 1]))
        elif b > a:
            h = words[a : a + 1]
            for j in range(a + 1, b):
                h = h * _K + words[j : j + 1]
            out.append(_mix(h ^ np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of each permutation over the set's hashes, folded to 32 bits."""
    x, least = (found ^ (found >> np.uint64(32))).astype(np.uint32), None
    for start in range(0, len(x), 1024):
        h = x[None, start : start + 1024] * _A[:, None] + _B[:, None]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        low = h.min(axis=1)
        least = low if least is None else np.minimum(least, low)
    return least


_SIGNED = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n_shingles", pa.int64()), *[(f"s{i}", pa.int64()) for i in range(4)], ("bands", pa.list_(pa.int64()))])
_SIGNED_DDL = "doc_id long, key binary, n_shingles long, s0 long, s1 long, s2 long, s3 long, bands array<long>"


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + SLICE_BYTES)))
        yield batch.slice(start, stop - start)
        start = stop


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = np.arange(1, BANDS + 1, dtype=np.uint64) * _P
    for batch in released(batches):
        for part in _slices(batch, 2):
            sets = shingle_sets(part.column(2))
            m = np.stack([minima(s) if len(s) else np.zeros(PERMUTATIONS, np.uint32) for s in sets])
            keys = np.zeros((len(sets), BANDS), np.uint64) + salt
            for j in range(BAND_ROWS):
                keys = keys * _K + m.reshape(len(sets), BANDS, BAND_ROWS)[:, :, j].astype(np.uint64)
            keys = _mix(keys).view(np.int64)
            # two planes of 128 bits: the lowest bit of each minimum, then the next one
            planes = [np.packbits((m >> np.uint32(bit) & np.uint32(1)).astype(np.uint8), axis=1).view(np.int64) for bit in range(BITS)]
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            longs = [pa.array(np.ascontiguousarray(p[:, i])) for p in planes for i in range(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), *longs, bands], schema=_SIGNED)


def _estimate(a: str, b: str) -> Column:
    """Similarity from the share of equal BITS-bit fields, less what chance makes equal."""
    x = [F.col(f"{a}s{i}").bitwiseXOR(F.col(f"{b}s{i}")) for i in range(4)]
    differ = F.bit_count(x[0].bitwiseOR(x[2])) + F.bit_count(x[1].bitwiseOR(x[3]))
    chance = 1.0 / (1 << BITS)
    return ((F.lit(PERMUTATIONS) - differ) / float(PERMUTATIONS) - chance) / (1 - chance)


def _body() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _digest() -> Column:
    return F.unhex(F.sha2(F.encode(_body(), "utf-8"), 256))


def signatures(docs: DataFrame) -> DataFrame:
    """Key, set size, packed signature and band keys of each row with an id."""
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("key"), F.encode(_body(), "utf-8").alias("_text"))
    return rows.mapInArrow(_sign, _SIGNED_DDL)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])
    for batch in released(batches):
        for part in _slices(batch, 2):
            linked = []
            for x, y in zip(shingle_sets(part.column(2)), shingle_sets(part.column(3)), strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(linked, pa.bool_())], schema=schema)


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Which ``pairs`` (a, b) are linked by their full sets (of any of their texts in ``texts`` (id, text))."""
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("_ta")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("_tb")), "b")
    checked = both.select("a", "b", "_ta", "_tb").mapInArrow(_confirm, "a long, b long, linked boolean")
    return checked.groupBy("a", "b").agg(F.max("linked").alias("linked"))


def contract(edges: DataFrame) -> DataFrame:
    """(id, label) of each end of ``edges`` (a, b): the least id of its component.

    Each round an id takes the least label among itself and its neighbours, then labels are replaced
    by the labels of their labels; both are joins, and rounds grow with the log of a component's
    diameter. The new edges of a round join the labels of the ends, so that stars stay stars.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = materialize(both.distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("id"), "label"), "labels")
    while True:
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("_up"))
        jumped = labels.join(up, "label", "left").select("id", F.coalesce("_up", "label").alias("label"))
        near = both.join(jumped.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("_near")).withColumnRenamed("a", "id")
        new = materialize(jumped.join(near, "id").join(labels.withColumnRenamed("label", "_old"), "id").select("id", F.least("label", "_near").alias("label"), "_old"), "labels")
        if new.where("label <> _old").isEmpty():
            return new.select("id", "label")
        labels = new.select("id", "label")


def _relabel(ids: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Column ``comp`` by ``labels`` (id, label); ids without one are their own."""
    if labels is None:
        return ids.withColumn("comp", F.col("rep"))
    return ids.join(labels.select(F.col("id").alias("rep"), F.col("label").alias("_label")), "rep", "left").withColumn("comp", F.coalesce("_label", "rep")).drop("_label")


_CELL = [(c, pa.int64()) for c in ("bucket", "part", "id", "comp", "role", "s0", "s1", "s2", "s3")]


def _cells(table_: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Each cell of a group: its rows, the places of its strays, the places of its members."""
    bucket, part = table_["bucket"].to_numpy(), table_["part"].to_numpy()
    order = np.lexsort((part, bucket))
    edges = np.flatnonzero((np.diff(bucket[order], prepend=bucket[order[:1]] - 1) != 0) | (np.diff(part[order], prepend=part[order[:1]] - 1) != 0))
    role = table_["role"].to_numpy()
    for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
        own = order[a:b]
        yield own, own[role[own] == 0], own[role[own] == 1]


def _near_rows(group: pa.Table) -> pa.Table:
    """The rows of those strays and members that some estimate brings together across components."""
    group = group.combine_chunks()
    sig = np.stack([group[f"s{i}"].to_numpy() for i in range(4)], 1).view(np.uint64)  # of signed numbers NumPy counts the bits of the absolute value
    comp = group["comp"].to_numpy()
    most = PERMUTATIONS * (1 - LEAST_ESTIMATE) * (1 - 1.0 / (1 << BITS))
    keep_ = np.zeros(group.num_rows, bool)
    for _, x, y in _cells(group):
        d = sig[x][:, None, :] ^ sig[y][None, :, :]
        differ = np.bitwise_count(d[:, :, 0] | d[:, :, 2]).astype(np.int16) + np.bitwise_count(d[:, :, 1] | d[:, :, 3])
        near = (differ <= most) & (comp[x][:, None] != comp[y][None, :])
        keep_[x[near.any(1)]] = True
        keep_[y[near.any(0)]] = True
    return group.filter(pa.array(keep_))


def _links(group: pa.Table) -> pa.Table:
    """Links between components, confirmed on full sets; one for each two parts they join in a cell."""
    group = group.combine_chunks()
    ids, comp = group["id"].to_numpy(), group["comp"].to_numpy()
    sig = np.stack([group[f"s{i}"].to_numpy() for i in range(4)], 1).view(np.uint64)  # of signed numbers NumPy counts the bits of the absolute value
    most = PERMUTATIONS * (1 - LEAST_ESTIMATE) * (1 - 1.0 / (1 << BITS))
    found_a, found_b = [], []
    for own, x, y in _cells(group):
        if not len(x) or not len(y):
            continue
        texts = group["text"].combine_chunks().take(pa.array(own))
        sets = dict(zip(own.tolist(), shingle_sets(texts), strict=True))
        sizes = np.array([len(sets[j]) for j in y.tolist()])
        flat, owner = np.concatenate([sets[j] for j in y.tolist()]), np.repeat(np.arange(len(y)), sizes)
        parent = {c: c for c in set(comp[own].tolist())}

        def root(c: int, parent: dict = parent) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        for i in x.tolist():
            d = sig[i] ^ sig[y]
            differ = np.bitwise_count(d[:, 0] | d[:, 2]).astype(np.int16) + np.bitwise_count(d[:, 1] | d[:, 3])
            near = np.flatnonzero((differ <= most) & (comp[y] != comp[i]))
            if not len(near):
                continue
            own_set = sets[i]
            if len(near) * 4 < len(y):
                common = np.array([len(np.intersect1d(own_set, sets[y[k]], assume_unique=True)) for k in near])
            else:
                at = np.searchsorted(own_set, flat)
                at[at == len(own_set)] = 0
                common = np.bincount(owner[own_set[at] == flat], minlength=len(y))[near]
            linked = 100 * common >= PERCENT * (len(own_set) + sizes[near] - common)
            for k in near[linked]:
                p, q = root(int(comp[i])), root(int(comp[y[k]]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    found_a.append(min(ids[i], ids[y[k]]))
                    found_b.append(max(ids[i], ids[y[k]]))
    return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})


def _between(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between different components that share buckets; joins no pairs.

    In a bucket that several components share, documents outside its largest component are strays.
    Strays and members are dealt into chunks of about CHUNK rows by hash, and a cell compares a chunk
    of strays with a chunk of members: of each pair of different components one side is a stray, so
    every pair meets. Cells are processed in groups of about GROUP_ROWS rows, counted as they are dealt,
    first by signatures alone, then, with the texts of the rows that are left, on full sets. The cells of
    a bucket are as many as its strays times its members: exact, and quadratic where none are linked.
    """
    spark = placed.sparkSession
    sizes = placed.groupBy("bucket", "comp").agg(F.count("*").alias("_n"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("_n", "comp")).alias("_m"), F.sum("_n").alias("_all"), F.count("*").alias("_k")).where("_k > 1")
    mixed = mixed.select("bucket", F.col("_m.comp").alias("_main"), (F.col("_all") - F.col("_m._n")).alias("_strays"), "_all")
    mixed = mixed.select("*", F.ceil(F.col("_strays") / CHUNK).cast("long").alias("_x"), F.ceil(F.col("_all") / CHUNK).cast("long").alias("_y"))
    mixed = materialize(mixed, "mixed")
    open_ = materialize(placed.join(mixed, "bucket").withColumnRenamed("rep", "id"), "open")
    own = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    names = [c for c, _ in _CELL]

    def dealt(role: int, here: str, there: str, part: Column) -> DataFrame:
        rows = open_.where("comp <> _main") if role == 0 else open_
        rows = rows.withColumn("_own", own % F.col(here)).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(there) - 1)))
        return rows.withColumn("part", part).withColumn("role", F.lit(role).cast("long")).select(*names)

    rows = dealt(0, "_x", "_y", F.col("_own") * F.col("_y") + F.col("_other")).unionByName(dealt(1, "_y", "_x", F.col("_other") * F.col("_y") + F.col("_own")))
    dealt_rows = mixed.agg(F.coalesce(F.sum(F.col("_strays") * F.col("_y") + F.col("_all") * F.col("_x")), F.lit(0))).first()[0]
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), dealt_rows // GROUP_ROWS)
    key = F.pmod(F.xxhash64("bucket", "part"), F.lit(groups))
    ddl = ", ".join(f"{c} long" for c in names)
    near = materialize(rows.groupBy(key.alias("_g")).applyInArrow(_near_rows, ddl), "near")
    told = near.join(texts, "id").select(*names, "text")
    return materialize(told.groupBy(key.alias("_g")).applyInArrow(_links, "a long, b long"), "links")


def _with_nodes(picked: DataFrame) -> DataFrame:
    """Column ``rep``, the number of a text: its least id, or a 64-bit hash where that id has a lesser text."""
    again = materialize(picked.groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return picked.withColumn("rep", F.col("doc_id"))
    least = picked.join(again, "doc_id").groupBy("doc_id").agg(F.min("key").alias("_least"))
    own = F.coalesce(F.col("key") == F.col("_least"), F.lit(True))
    return picked.join(least, "doc_id", "left").withColumn("rep", F.when(own, F.col("doc_id")).otherwise(F.xxhash64("key"))).drop("_least")


def _mapping(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """key, doc_id (the least of the text) and comp of each text that has shingles."""
    sig = ["s0", "s1", "s2", "s3"]
    picked = signed.where("n_shingles > 0").groupBy("key").agg(F.min(F.struct("doc_id", *sig, "bands")).alias("_m"))
    picked = materialize(picked.select("key", F.col("_m.doc_id").alias("doc_id"), *[F.col(f"_m.{s}") for s in sig], F.col("_m.bands").alias("bands")), "picked")
    reps = _with_nodes(picked)

    exploded = reps.select("rep", F.explode("bands").alias("bucket"))
    shared = materialize(exploded.groupBy("bucket").agg(F.count("*").alias("_n")).where("_n > 1").select("bucket"), "buckets")
    member_ids = materialize(exploded.join(shared, "bucket"), "member_ids")
    members = materialize(member_ids.join(reps.select("rep", *sig), "rep"), "members")

    needed = member_ids.select("rep").distinct().join(reps.select("rep", "doc_id", "key"), "rep")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(_body(), "utf-8").alias("text"))
    texts = whole.withColumn("key", F.unhex(F.sha2("text", 256))).join(needed, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"])
    texts = materialize(texts.select(F.col("rep").alias("id"), "text"), "texts")

    # round one: each member and the least member of one of its buckets
    centers = members.groupBy("bucket").agg(F.min(F.struct("rep", *sig)).alias("_c"))
    star = members.join(centers, "bucket").where(F.col("_c.rep") < F.col("rep"))
    star = star.select("rep", F.col("_c.rep").alias("center"), *[F.col(s).alias(f"a_{s}") for s in sig], *[F.col(f"_c.{s}").alias(f"b_{s}") for s in sig])
    star = star.withColumn("_e", _estimate("a_", "b_")).where(F.col("_e") >= LEAST_ESTIMATE)
    first = star.groupBy("rep").agg(F.max(F.struct("_e", (-F.col("center")).alias("_c"))).alias("_m")).select((-F.col("_m._c")).alias("a"), F.col("rep").alias("b"))
    tested = materialize(confirm(first, texts), "tested")
    labels = contract(tested.where("linked").select("a", "b"))

    placed = materialize(_relabel(members, labels), "placed")
    more = _between(placed, texts)
    if not more.isEmpty():
        labels = contract(tested.where("linked").select("a", "b").unionByName(more))
    return materialize(_relabel(reps.select("key", "doc_id", "rep"), labels).select("key", "doc_id", "rep", "comp"), "mapping")


def _least_ids(mapping: DataFrame) -> DataFrame:
    """key and component_id: the least id of the component, whose number may be a hash."""
    hashed = mapping.where("rep <> doc_id").select("comp").distinct()
    if hashed.isEmpty():
        return mapping.select("key", F.col("comp").alias("component_id"))
    names = mapping.join(hashed, "comp", "left_semi").groupBy("comp").agg(F.min("doc_id").alias("_least"))
    return mapping.join(names, "comp", "left").select("key", F.coalesce("_least", "comp").alias("component_id"))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs`` (doc_id, text)."""
    signed = materialize(signatures(docs), "signed")
    rows = signed.select("doc_id", "key", "n_shingles").join(_least_ids(_mapping(docs, signed)), "key", "left")
    comp = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = rows.select("doc_id", "n_shingles", comp.alias("component_id"))
    nameless = docs.where(F.col("doc_id").isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(nameless).select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """One row of each component, each blank text of an id, and the rows without id; the columns of ``docs``."""
    mapping = _mapping(docs, materialize(signatures(docs), "signed"))
    first = mapping.groupBy("comp").agg(F.min(F.struct("doc_id", "key")).alias("_f")).select(F.col("_f.doc_id").alias("_id"), F.col("_f.key").alias("_first"))
    blank = F.btrim(_body(), F.lit(SEPARATORS)) == ""
    # rows travel as one column each, so that no column of the caller's meets a name used here
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    named = docs.where(F.col("doc_id").isNotNull())
    rows = named.select(row, F.col("doc_id").alias("_doc"), _digest().alias("_key"), F.col("text").isNull().alias("_null"), blank.alias("_blank"))
    left = rows.join(first, (F.col("_doc") == F.col("_id")) & (F.col("_key") == F.col("_first")), "left").where(F.col("_id").isNotNull() | F.col("_blank"))
    return left.dropDuplicates(["_doc", "_key", "_null"]).select("_row.*").unionByName(docs.where(F.col("doc_id").isNull()))


# ----------------------------------------------------------------------------------------------
def op5_near_dedup(spark, sf_dir):
    return components(table(spark, sf_dir, "documents"))


_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh)::BIGINT AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
      HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
c(id, reach) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.y, c.reach FROM c JOIN l ON l.x = c.id WHERE c.reach < l.y),
m AS (SELECT id, min(reach) AS component_id FROM c GROUP BY id)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m ON m.id = s.doc_id"""

QUERIES = {"op5_near_dedup": op5_near_dedup}
ORACLES = {"op5_near_dedup": _SQL}
