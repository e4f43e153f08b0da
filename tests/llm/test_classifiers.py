"""The two classifiers against straightforward versions, and their edge cases."""

import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from piiguard.llm import common, quality_classifier as Q, toxicity as T

WORDS = "the of and to in is that for on was with river garden house".split()


def texts(n, bad, seed=1, every=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice(WORDS) + rng.choice(["", "s", "ly"]) for _ in range(40)]
        if i % every == 0:
            words[::6] = [rng.choice(bad) for _ in words[::6]]
        out.append((" ".join(words), int(i % every == 0)))
    return out


def naive_features(text):
    """Distinct hashed n-grams, gram by gram."""
    s, found = f" {text.lower()} ", set()
    for n in T.SIZES:
        for i in range(len(s) - n + 1):
            h = n
            for c in s[i : i + n]:
                h = ((h ^ ord(c)) * 0x9E3779B1) & 0xFFFFFFFF
                h ^= h >> 15
            found.add(h >> (32 - T.BITS))
    return found


def test_features_of_short_and_long_texts(monkeypatch):
    samples = ["", "a", "Ab", "héllo  wörld 👍", "x" * 50, " ".join(WORDS)]
    for t in samples:
        assert set(T.features(t).tolist()) == naive_features(t) and len(T.features(t)) == len(naive_features(t))
    monkeypatch.setattr(T, "PIECE_CHARS", 7)
    for t in samples:
        assert set(T.features(t).tolist()) == naive_features(t)


def test_ratios_and_scores_by_dictionaries():
    sample = texts(90, ["scum", "moron", "trash"])
    y = np.array([s[1] for s in sample], float)
    counts = {}
    for t, label in sample:
        for g in naive_features(t):
            counts.setdefault(g, [0, 0])[label] += 1
    want = {}
    for g, (neg, pos) in counts.items():
        r = math.log((pos + 1) / (y.sum() + 2)) - math.log((neg + 1) / ((1 - y).sum() + 2))
        want[g] = 0.0 if pos + neg < T.LEAST_TEXTS or abs(r) < T.LEAST_RATIO else r
    got = T.ratios([T.features(t) for t, _ in sample], y)
    assert all(abs(got[g] - r) < 1e-12 for g, r in want.items()) and np.count_nonzero(got) == sum(r != 0 for r in want.values())
    model = T.train([(t, label, 1.0) for t, label in sample])
    w = np.frombuffer(model.weights, np.float32)
    for t in [sample[0][0], sample[1][0], ""]:
        grams = naive_features(t)
        z = sum(float(w[g]) for g in grams) + model.bias + model.length_slope * math.log1p(len(grams))
        assert abs(model.score(pa.array([t]))[0] - 1 / (1 + math.exp(-z))) < 1e-6
    scores = model.score(pa.array([t for t, _ in texts(60, ["scum", "moron", "trash"], 7)]))
    assert ((scores >= 0.5) == [i % 3 == 0 for i in range(60)]).mean() > 0.95


def naive_inputs(text, good, bad):
    """Block sizes by plain calls, differences one by one."""
    def size(piece, d):
        held = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if d else None
        return len(zstandard.ZstdCompressor(level=Q.LEVEL, dict_data=held, write_checksum=False, write_content_size=False).compress(piece))

    raw = text.encode()
    blocks = [raw[i : i + Q.BLOCK_BYTES] for i in range(0, len(raw), Q.BLOCK_BYTES)] or [b""]
    rows = [(size(b, good), size(b, bad), size(b, b""), len(b)) for b in blocks]
    longest = max(len(b) for b in blocks)
    own = [r for r in rows if r[3] >= min(Q.LEAST_BYTES, longest)]
    g, b, p, n = (sum(r[i] for r in rows) for i in range(4))
    n = max(n, 1)
    by_size = [(r[1] - r[0]) / r[2] for r in own]
    by_length = [(r[1] - r[0]) / max(r[3], 1) for r in own]
    return [*((d / p) for d in (b - g, p - g, p - b)), *((d / n) for d in (b - g, p - g, p - b)), max(by_size), min(by_size), float(np.median(by_size)), max(by_length), min(by_length)]


def test_inputs_are_differences_of_sizes_only():
    good, bad = (" ".join(WORDS) * 30).encode(), b"&&& ||| ### " * 90
    rng = random.Random(3)
    cases = ["", "x", " ".join(rng.choice(WORDS) for _ in range(900)), "&&& ||| " * 400 + "the river " * 5]
    x = Q.inputs([Q.block_sizes(t.encode(), Q.compressors(good, bad)) for t in cases])
    for row, t in zip(x, cases, strict=True):
        want = naive_inputs(t, good, bad)
        assert np.allclose(row[:11], want) and np.allclose(row[11:22], np.sign(want) * np.sqrt(np.abs(want))) and np.allclose(row[22:33], np.square(want))
    alike = Q.inputs([Q.block_sizes(t.encode(), Q.compressors(good, good)) for t in cases])
    assert np.all(alike[:, [0, 3, 6, 7, 8, 9, 10]] == 0)


def test_dictionaries_hold_whole_texts(monkeypatch):
    monkeypatch.setattr(Q, "DICTIONARY_BYTES", 100)
    assert Q._dictionary([b"a" * 60, b"b" * 60, b"c" * 30]) == b"a" * 60 + b"\n" + b"c" * 30


@pytest.mark.parametrize("n", [2, 3, 4, 7, 50])
@pytest.mark.parametrize("module", [Q, T])
def test_training_on_few_rows_has_one_rule(module, n):
    model = module.train([(t, y, 1.0) for t, y in texts(n, ["&&&", "scum"])])
    got = model.score(pa.array(["&&& scum", "the river", "", None]), *([{}] if module is Q else []))
    assert len(got) == 4 and np.all((got >= 0) & (got <= 1)) and got[2] == got[3]


@pytest.mark.parametrize("module,label,nothing", [(Q, "quality", (0.5, 1)), (T, "toxic", (0.0, 0))])
def test_classifier_edge_cases(spark, module, label, nothing):
    docs = spark.createDataFrame([(1, "a b", 9), (1, "a b", 9), (None, "c", 9), (2, None, 9), (3, "word " * 60_000, 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], f"doc_id long, {label} int")
    for known in (labels, labels.where("doc_id = 1"), labels.where("doc_id = -1")):  # one class at most
        rows = module.score(docs, module.fit(docs, known)).collect()
        assert len(rows) == 5 and {(r["score"], r["predicted"]) for r in rows} == {nothing}
        assert module.score(docs.where("doc_id = -1"), module.fit(docs, known)).count() == 0
    assert module.fit(docs.where("doc_id = -1"), labels) == module.fit(docs, labels.where("doc_id = -1"))
    if module is T:
        kept = T.keep(docs, T.fit(docs, labels))
        assert kept.columns == docs.columns and kept.count() == 5
        all_ = T.Model(np.zeros(1 << T.BITS, np.float32).tobytes(), 0.0)  # every score is the threshold
        assert T.keep(docs, all_).count() == 0 and {r["predicted"] for r in T.score(docs, all_).collect()} == {1}


def test_training_sample_is_defined(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(200)] + [(ids[0], "a first"), (ids[0], "zz last"), (ids[1], "x" * 99)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(ids[0], 1), (None, 1)], "doc_id long, y int")
    got = common.labelled_sample(docs, labels, "y", 1000, 50)
    assert len(got) == len(ids) and ("a first", 1) in [g[:2] for g in got] and not any(t.startswith("zz") for t, _, _ in got)
    assert all(zlib.crc32(t[1:].encode()) % 5 for t, _, _ in got if t != "a first")
    few = common.labelled_sample(docs, labels, "y", 10, 50)
    assert len(few) == 20 and abs(sum(w for _, _, w in few) - len(ids)) < 1e-9
    assert common.labelled_sample(docs, labels.where("doc_id = -1"), "y", 10, 50) == []


def test_toxicity_counts_columns_in_little_memory():
    """The driver trains: beside the sample's columns it holds no number for each of them while it counts."""
    rng = np.random.default_rng(3)
    columns = [np.flatnonzero(rng.random(1 << T.BITS) < 0.3).astype(np.int32) for _ in range(60)]
    y = np.arange(60.0) % 2
    tracemalloc.start()
    got = T.ratios(columns, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * sum(map(len, columns))
    pos, neg = (np.bincount(np.concatenate([c for c, label in zip(columns, y, strict=True) if label == k]), minlength=1 << T.BITS) for k in (1, 0))
    assert np.array_equal(got != 0, (pos + neg >= T.LEAST_TEXTS) & (np.abs(np.log((pos + 1) / 32) - np.log((neg + 1) / 32)) >= T.LEAST_RATIO))
