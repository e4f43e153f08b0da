"""Byte-level BPE in parts: words of the pattern, blocks and chunks, one encoding a word."""

import random

import numpy as np
import pyarrow as pa
import pytest

from piiguard.llm import tokens


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def some_texts(n, seed=3):
    rng = random.Random(seed)
    alphabet = "a b\t\n '’s1é  x,.  世👍\r\x1c\x85\x00 #z y"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_words_are_the_matches_of_the_pattern():
    import public_tokenizers
    import regex

    texts = [*some_texts(200), "", ".\x1c b", "x #\x1c y", "a  \n b"]
    words, *rest = tokens.words_of_block(pa.array(texts))
    codes, counts = tokens.sequence_of(*rest)
    edges = np.concatenate([[0], np.cumsum(counts)])
    got = [[words[c] for c in codes[a:b]] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    assert got == [regex.findall(public_tokenizers.PATTERN, t) for t in texts] and len(set(words)) == len(words)


@pytest.mark.parametrize("block,chunk", [(1, 1), (300, 50), (1 << 20, 1 << 18)])
def test_blocks_and_chunks(path, monkeypatch, block, chunk):
    monkeypatch.setattr(tokens, "BLOCK_BYTES", block)
    monkeypatch.setattr(tokens, "CHUNK_WORDS", chunk)
    texts = [*some_texts(80), None, "", "word " * 400]
    ids = [*range(80), None, 7, 81]
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[a : a + 30], pa.int64()), pa.array(texts[a : a + 30], pa.string()), pa.array([5] * len(ids[a : a + 30]))], names=["doc_id", "text", "part"]) for a in range(0, len(ids), 30)]
    rows = sorted((r for b in tokens._distinct(16)(iter(batches)) for r in b.to_pylist()), key=lambda r: r["bucket"])
    ordered = pa.Table.from_pylist(rows, schema=tokens._WORDS).to_batches(max_chunksize=7)  # buckets go over the ends of batches
    joined = pa.Table.from_batches([*tokens._encode_buckets(path)(iter(ordered)), *tokens._sequences(iter(batches))])
    numbers = set(joined["block"].to_pylist())
    assert len(numbers) == len({r["block"] for r in rows} | numbers) and (block > 1 << 19) == (len(numbers) == 1)
    got = [(r["doc_id"], r["ids"]) for n in numbers for r in tokens._reassemble(joined.filter(pa.compute.equal(joined["block"], n))).to_pylist()]
    want = [(i, tokens.encoder(path).encode_ordinary(t or "")) for i, t in zip(ids, texts, strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_word_is_encoded_once(path, monkeypatch):
    asked = []
    plain = tokens.encode_words
    monkeypatch.setattr(tokens, "encode_words", lambda p, w: asked.extend(w.to_pylist()) or plain(p, w))
    row = lambda bucket, block, words: {"bucket": bucket, "block": block, "codes": b"", "lens": tokens.squeeze(np.array([len(w.encode()) for w in words])), "words": tokens._SQUEEZER.compress("".join(words).encode())}
    rows = [row(1, b, ["a", " b"]) for b in range(5)] + [row(2, b, ["é", " c"][: 1 + b % 2]) for b in range(5)]
    list(tokens._encode_buckets(path)(iter(pa.Table.from_pylist(rows, schema=tokens._WORDS).to_batches(max_chunksize=3))))
    assert asked == ["a", " b", "é", " c"]


def test_unlike_readings_are_an_error(spark):
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["x y"]), pa.array([0])], names=["doc_id", "text", "part"])
    with pytest.raises(ValueError, match="alike"):
        tokens._reassemble(pa.Table.from_batches(list(tokens._sequences(iter([batch])))))
