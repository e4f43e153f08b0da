"""The corpus operators against brute force, round trips and held-out accuracy."""

import base64
import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from piiguard.llm import html_extract, near_dedup, nearest, packing, quality_classifier, quality_rules, sharding, tokens, toxicity, warc
from piiguard.llm.common import shared_dir

SF = "/root/testdata/sf0.001"
ALPHABET = "a b\t\n '’s1é  x,.  世👍\r\x1c\x85\x00 z y"


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    random.seed(5)
    texts = ["".join(random.choice(ALPHABET) for _ in range(random.randint(0, 40))) for _ in range(60)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(100, None, "x"), (101, "", "x"), (102, "word " * 5000, "x"), (3, texts[3], "x"), (None, "no id", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)


def empty(docs):
    return docs.where("doc_id = -1")


def test_bpe_round_trip(spark, docs, path):
    enc = tokens.encoder(path)
    want = sorted((str(r["doc_id"]), enc.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in docs.collect())
    encoded = tokens.encode(docs, path)
    ids = sorted((str(r["doc_id"]), r["ids"]) for r in encoded.collect())
    assert ids == [w[:2] for w in want]
    out = sorted((str(r["doc_id"]), bytes(r["bytes"])) for r in tokens.decode(encoded, path).collect())
    assert out == sorted((w[0], w[2]) for w in want)
    assert tokens.decode(tokens.encode(empty(docs), path), path).count() == 0


def test_bpe_digests(spark, docs, path):
    enc = tokens.encoder(path)
    for r in tokens.decode(tokens.encode(docs.where("doc_id < 20"), path), path, digests_only=True).join(docs.where("doc_id < 20").distinct(), "doc_id").collect():
        ids = enc.encode_ordinary(r["text"])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_packing(spark, docs, path):
    from tokenizers import Tokenizer

    import public_tokenizers

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tk.encode_special_tokens = True
    got = {}
    rows = packing.pack(docs.where("doc_id <> 3"), path).collect()
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 1024 and r["offset"] == 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    for d in docs.where("doc_id <> 3").collect():
        pieces = sorted(got[d["doc_id"]], key=lambda r: r["start"])
        ids = [i for p in pieces for i in p["ids"]]
        assert ids == tk.encode(d["text"] or "", add_special_tokens=False).ids + [0]
        assert all(p["doc_tokens"] == len(ids) for p in pieces)
    assert packing.pack(empty(docs), path).count() == 0


def test_packing_knows_added_tokens(path):
    import pyarrow as pa
    from tokenizers import Tokenizer

    import public_tokenizers

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "plain  text", "<|endoftext|>", "", "x<|endoftext|><|endoftext|>y \n z", "<|endoftext<|endoftext|>", "é <|endoftext|"]
    assert [x.tolist() for x in packing.tokenize(path, pa.array(texts))] == [tk.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_decompose():
    for n in (1, 5, 1023, 1024, 1025, 5000):
        parts = packing.decompose(n)
        assert sum(parts) == n and parts == sorted(parts, reverse=True)


def repeated(words):
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)})


def test_quality_rules(spark):
    random.seed(2)
    texts = [None, "", " \n ", "one\ntwo\none\n\none", "a#b <c>"] + [" ".join(random.choice("ab") for _ in range(random.randint(0, 60))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.measure(df).collect():
        t = texts[r["doc_id"]] or ""
        words = t.split()
        lines = [x for x in t.split("\n") if x.strip()]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"]) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t) and r["n_repeat_words"] == repeated(words)
    clash = spark.createDataFrame([(1, "the cat and the dog of " * 3 + "x y z", True)], "n_words long, text string, kept boolean")
    assert quality_rules.keep(clash).columns == ["n_words", "text", "kept"]


def test_quality_filter_stays_above_the_measures(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    splits = lambda df: plan(df).count("split(")
    assert splits(quality_rules.keep(docs)) <= splits(quality_rules.measure(docs))
    kept = {r["doc_id"] for r in quality_rules.measure(docs).where("kept").collect()}
    assert kept == {r["doc_id"] for r in quality_rules.keep(docs).collect()} and kept


def test_sharding_moves_only_into_the_new_shard(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 7 = 0 THEN NULL ELSE repeat('é', CAST(id % 5 AS INT)) END AS text")
    rows = sharding.shard(df).collect()
    assert all(r["grown_shard"] in (r["shard"], 40) for r in rows) and any(r["grown_shard"] == 40 for r in rows)
    for s in range(40):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert all(r["size"] == 16 + (0 if r["doc_id"] % 7 == 0 else 2 * (r["doc_id"] % 5)) for r in rows)
    assert sharding.shard(df.where("doc_id < 0")).count() == 0


def test_warc(spark):
    pages = [(1, "u", "same"), (2, "u", "same"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 300_000 + "é"), (6, None, "\x1f\x8b\x08 not a member"), (2, "u", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = shared_dir(spark)
    manifest = warc.write(df, folder)
    for size in (50, 1 << 20):  # ranges shorter than a record, and longer than an archive
        rows = warc.read(manifest, folder, range_bytes=size).collect()
        assert len(rows) == len(pages)
        by = {}
        for r in rows:
            by.setdefault(r["page_id"], []).append(r)
        assert [r["record_type"] for r in by[2]] == ["response"] * 2 and (by[1][0]["record_type"], by[1][0]["refers_to"]) == ("revisit", 2)
        assert (by[3][0]["refers_to"], by[4][0]["record_type"]) == (4, "response")
        for page, _, html in pages:
            body = (html or "").encode()
            assert by[page][0]["payload_bytes"] == len(body) and by[page][0]["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
    assert bytes(by[5][0]["payload"]) == pages[4][2].encode()


def test_warc_false_magic():
    inner = gzip.compress(b"WARC/1.1\r\nbroken")
    data = b"\x1f\x8b\x08junk" + inner + gzip.compress(warc._record(7, "u", b"<p>", None, False))
    found = list(warc.records_in(io.BytesIO(data), len(data), 0, len(data)))
    assert [h["warc-record-id"] for _, h, _ in found] == ["<urn:page:7>"]


def test_html():
    page = """<html><head><title>T</title></head><body><header>Site</header><nav><a href=x>Menu</a></nav><div class="cookie-notice">We use cookies</div>
    <article><header><h1>Head &amp; line</h1></header><p>one <b>two</b>three<br>four&nbsp; five</p><div class="ad">Buy</div><p>tail</p>
    <section class="comments"><p>the reader said that it is in the text of a comment and so on for the most of it</p></section></article>
    <aside>side</aside><form>name</form><footer>foot</footer><script>var a = "</p>"</script></body></html>"""
    assert html_extract.main_text(page) == "Head & line one twothree four five tail"
    assert html_extract.main_text(None) == "" and html_extract.main_text("<p") == "" and html_extract.main_text("<article><p>cut &am") == "cut &am"


@pytest.mark.parametrize("name", ["has-sidebar", "comments-open", "category-social", "tag-advertising", "content-sidebar-wrap"])
def test_html_names_around_the_main_text(name):
    inner = '<p>The main text of the page.</p><div class="share-bar">Share</div>'
    for page in (f"<main class='{name}'>{inner}</main>", f"<div id={name}><div class='{name}'><article>{inner}</article></div><div class='{name}'>no</div></div>", f"<div class={name}><div role=\"main\">{inner}</div></div>"):
        assert html_extract.main_text(f"<body>{page}</body>") == "The main text of the page."
    for whole in ("comments", "comments-area", "related-posts"):
        assert html_extract.main_text(f"<main>{inner}<div class='{whole}'><article class='comment-body'>{inner}</article></div></main>") == "The main text of the page."


def test_html_without_article():
    page = "<body><ul><li><a href=a>Home</a></li></ul><div><p>" + "The cat and the dog of the house are in the garden with a friend. " * 2 + "</p><p>Short.</p></div></body>"
    assert html_extract.main_text(page).endswith("Short.") and "Home" not in html_extract.main_text(page)


def test_nearest(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[50:60] = v[49]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [None] * 8), (1004, [1.0]), (None, [1.0] * 8)]
    got = {}
    for r in nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    d = v.astype(np.float64)
    assert set(got) == set(range(0, 300, 20))
    for q, rows in got.items():
        s = np.add.accumulate(d[q] * d, axis=1)[:, -1]  # in order of components; sum() compensates
        want = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:20]
        assert [r[1] for r in sorted(rows)] == want and [r[2] for r in sorted(rows)] == [s[i] for i in want]


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()
    label = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and label[a] > label[b]:
                    label[a], changed = label[b], True
    return {i: (len(sets[i]), label[i]) for i in texts}


def test_near_dedup(spark):
    random.seed(4)
    base = [random.choice("abcdefghij") * random.randint(1, 3) + str(random.randint(0, 99)) for _ in range(120)]
    texts = {0: None, 1: "", 2: "one two", 3: "ONE  two", 4: "three"}
    for i in range(5, 60):
        words = list(base) if i % 3 else [f"w{i}{j}" for j in range(40)]
        for _ in range(random.randint(0, 5)):
            words[random.randrange(len(words))] = f"e{random.randint(0, 9999)}"
        texts[i] = " ".join(words)
    texts[60] = texts[7]
    df = spark.createDataFrame([*texts.items(), (None, "one two"), (7, texts[7])], "doc_id long, text string")
    want = brute_components(texts)
    rows = near_dedup.components(df).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r["doc_id"] is None:
            assert r["kept"] and r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == want[r["doc_id"]][1])
    left = near_dedup.keep(df)
    assert left.columns == ["doc_id", "text"] and sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == sorted(i for i, w in want.items() if w[1] == i)
    assert near_dedup.components(df.where("doc_id = -1")).count() == 0


def test_near_dedup_of_one_id_with_two_texts(spark):
    a, b, c, d, e, f = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcdef")
    # (9, e) is near (4, e y); (9, f) is not
    rows = [(3, a), (7, a), (7, b), (8, c), (8, d), (8, d), (9, e), (4, e + " y"), (9, f), (12, f), (15, d + " z"), (20, None), (20, ""), (20, " "), (21, "q r s t"), (21, "q r s t u v w")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = [(3, a), (7, b), (8, c), (8, d), (4, e + " y"), (9, f), (20, None), (20, ""), (20, " "), (21, "q r s t"), (21, "q r s t u v w")]
    norm = lambda rows: sorted((i, str(t)) for i, t in rows)
    assert norm(tuple(r) for r in near_dedup.keep(df).collect()) == norm(want)
    named = {(r["doc_id"], r["component_id"]) for r in near_dedup.components(df).collect()}
    assert named == {(3, 3), (7, 3), (7, 7), (8, 8), (9, 4), (4, 4), (9, 9), (12, 9), (15, 8), (20, 20), (21, 21)}
    near = spark.createDataFrame([(14, d), (14, d + " y"), (30, d + " y z")], "doc_id long, text string")
    assert [r["doc_id"] for r in near_dedup.keep(near).collect()] == [14]


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality_classifier, "quality")])
def test_classifiers(spark, module, label):
    rng = random.Random(1)
    good = "the of and to in is that for on was with river garden house".split()
    bad = "scum idiot moron trash stupid" .split() if label == "toxic" else "&&& ||| ### $$$ %%%".split()
    rows = []
    for i in range(600):
        y = i % 3 == 0
        words = [rng.choice(good) + rng.choice(["", "s", "ly"]) for _ in range(40)]
        if y:
            words[::6] = [rng.choice(bad) for _ in words[::6]]
        rows.append((i, " ".join(words), int(y) if label == "toxic" else int(not y)))
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    model = module.fit(df, df.withColumnRenamed("y", label))
    got = module.score(df.unionByName(spark.createDataFrame([(9999, None, 0), (None, "", 0)], df.schema)), model).collect()
    assert len(got) == 602 and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_dedup", "packing"]
    current = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, current, SF)
        assert after.columns == docs.columns and set(after.collect()) <= set(current.collect()), name
        current = after
    pieces = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in current.select("doc_id").collect()}
