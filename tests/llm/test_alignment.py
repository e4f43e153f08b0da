"""Alignment of two tokenizers against the libraries on whole texts and links pair by pair."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from piiguard.llm import alignment
from piiguard.llm.common import shared_dir

ALPHABET = [" ", "  ", "   ", "\n", "\t", "\r\n", " \n ", "\x1c", "\x85", "\xa0", "　", " ", "\x00", "a", "the", "Straße", "é", "世", "👍", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "'s", "12", "...", "-", "ﬁ", "Ａ", "é"]


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    random.seed(11)
    rows = [(i, "".join(random.choices(ALPHABET, k=random.randint(0, 30))), 1) for i in range(250)]
    rows += [(i, " ".join(random.choices(["rare", "words", "of", "many", "kinds", "unbelievable", "tokenisation"], k=50)), 1) for i in range(300, 330)]
    rows += [(400, None, 1), (401, "", 1), (402, " ", 1), (403, "foo ", 1), (404, "a▁b words", 1), (405, "x" * 5000, 1), (406, "word " * 9000, 1), (407, "▁", 1)]
    rows += [(3, rows[3][1], 1), (None, "no id", 1)] + [(500 + i, "one text in a third of the rows", 1) for i in range(100)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_a int").repartition(3)


def brute(rows, paths):
    import sentencepiece
    from tokenizers import Tokenizer

    tk, sp = Tokenizer.from_file(paths[0].replace(".tiktoken", ".json")), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    tk.encode_special_tokens = True
    table = alignment.token_bytes(paths[0])

    def piece(i):
        name = sp.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if sp.is_byte(i) else name.replace("▁", " ").encode()

    out, pairs = [], Counter()
    for doc_id, text in rows:
        whole = (" " + (text or "")).encode()
        a = tk.encode(whole.decode(), add_special_tokens=False).ids
        b = sp.encode(text or "")
        able = bool(text) and b"".join(table[i] for i in a) == whole == b"".join(map(piece, b))
        links, groups = [], []
        if able:
            ea, eb = np.cumsum([len(table[i]) for i in a]).tolist(), np.cumsum([len(piece(i)) for i in b]).tolist()
            sa, sb = [0, *ea], [0, *eb]
            links = [(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if sa[i] < eb[j] and sb[j] < ea[i]] if len(a) < 2000 else staircase(a, b, ea, eb)
            common, i, j = sorted(set(ea) & set(eb)), 0, 0
            for end in common:
                x, y = ea.index(end) + 1 if len(ea) < 2000 else np.searchsorted(ea, end) + 1, eb.index(end) + 1 if len(eb) < 2000 else np.searchsorted(eb, end) + 1
                groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
                i, j = x, y
        pairs.update(links)
        out.append((doc_id, len(a) if able else 0, len(b) if able else 0, len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if able else "", ";".join(groups)))
    best = {}
    for (_, y), n in pairs.items():
        best[y] = max(best.get(y, 0), n)
    return sorted((str(d), a, b, g, len(ls), sum(pairs[p] == best[p[1]] for p in ls), sum(pairs[p] for p in ls), h, t) for d, a, b, g, ls, h, t in out)


def staircase(a, b, ea, eb):
    i = j = 0
    links = []
    while i < len(a) and j < len(b):
        links.append((a[i], b[j]))
        x, y = ea[i], eb[j]
        i, j = i + (x <= y), j + (y <= x)
    return links


def test_documents_equal_the_libraries(spark, docs, paths):
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], paths)
    out = alignment.align(docs, *paths, with_groups=True)
    assert out.columns == [*"doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split(), "groups"]
    got = sorted((str(r["doc_id"]), *r[1:]) for r in out.collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g == w


def test_segments_join_to_the_text():
    random.seed(2)
    texts = ["".join(random.choices(ALPHABET, k=20)) for _ in range(300)] + ["plain words\nhere ", "", " "]
    got = alignment.segments(pa.array(texts)).to_pylist()
    assert ["".join(x) for x in got] == [" " + t for t in texts]
    assert all(s.startswith(" ") for x in got for s in x) and got[-3] == [" plain", " words\nhere", " "]


def test_partial_counts_are_bounded_and_whole(spark, docs, paths):
    count = lambda n: {r["key"]: r["n"] for r in alignment.partial_counts(docs, *paths, n).groupBy("key").agg(F.sum("n").alias("n")).collect()}
    assert count(50) == count(1 << 20)


def test_shards_are_sorted_and_looked_up(spark):
    rng = np.random.default_rng(4)
    keys = (rng.integers(0, 50, 5000) << 32 | rng.integers(0, 40, 5000)).tolist() + [7 << 32 | 3] * 3000
    folder = shared_dir(spark)
    shards = alignment.write_shards(spark.createDataFrame([(k, 2) for k in keys], "key long, n long").repartition(7), folder)
    rows = [tuple(r)[:4] for r in shards.collect()]
    total, best = Counter(keys), {}
    for k, n in total.items():
        best[k >> 32] = max(best.get(k >> 32, 0), 2 * n)
    wanted = np.array(sorted(total))
    for local in (True, False):
        found = alignment.Shards(folder, rows)
        if not local:
            found.files = fs.SubTreeFileSystem("/", fs.LocalFileSystem())
        assert found.counts(wanted).tolist() == [2 * total[k] for k in wanted.tolist()]
        with pytest.raises(ValueError, match="not counted"):
            found.counts(np.array([1 << 60]))
    got = shards.select(F.explode(F.arrays_zip("b", "best")).alias("x")).groupBy("x.b").agg(F.max("x.best").alias("n")).collect()
    assert {r["b"]: r["n"] for r in got} == best


def test_no_documents(spark, docs, paths):
    assert alignment.align(docs.where(F.lit(False)), *paths).count() == 0
    assert [tuple(r) for r in alignment.align(docs.where("doc_id = 400"), *paths).collect()] == [(400, 0, 0, 0, 0, 0, 0, "")]
