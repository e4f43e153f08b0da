"""Token-id files against the tokenizers library, and the coding against its definition."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from piiguard.llm import token_files
from piiguard.llm.common import shared_dir
from piiguard.shared import open_folder


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    random.seed(8)
    words = ["the", "token", "é世", "  ", "\n", "12", "<|endoftext|>", "x-y", "👍", "'s", "\x00"]
    rows = [(i, " ".join(random.choices(words, k=random.randint(0, 60))), "x") for i in range(120)]
    rows += [(500, None, "x"), (-7, "", "x"), (501, "word " * 30000, "x"), (3, rows[3][1], "x"), (3, "another", "x"), (None, "no id", "x")]
    rows += [(77, "one hot id", "x")] * 60
    return spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(4)


@pytest.mark.parametrize("n", [0, 1, 4, 7, 1000])
def test_values_round_trip(n):
    rng = np.random.default_rng(n)
    values = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
    control, data = token_files.encode_values(values)
    assert len(control) == -(-n // 4) and len(data) == sum(max(1, (int(v).bit_length() + 7) // 8) for v in values)
    assert (token_files.decode_values(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == values).all()


def test_coding_is_the_stated_one():
    control, data = token_files.encode_values(np.array([1, 0x1FF, 0x30201, 0x4030201, 0xFF], np.uint32))
    assert control == bytes([0b11_10_01_00, 0]) and data == bytes([1, 0xFF, 1, 1, 2, 3, 1, 2, 3, 4, 0xFF])


@pytest.mark.parametrize(("block_ids", "file_bytes"), [(token_files.BLOCK_IDS, token_files.FILE_BYTES), (200, 600)])
def test_documents_equal_the_library(spark, docs, path, block_ids, file_bytes):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(path.replace(".tiktoken", ".json"))
    rows = [(r["doc_id"], [*tk.encode(r["text"] or "", add_special_tokens=False).ids, token_files.END_ID]) for r in docs.collect()]
    folder = shared_dir(spark)
    manifest = token_files.write(docs, path, folder, block_ids, file_bytes)
    assert manifest.count() >= (1 if block_ids > 200 else 10)
    out = token_files.read(manifest, folder).collect()
    key = lambda i: (i is not None, i or 0)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    want, start = [], 0
    for doc_id, ids in sorted(rows, key=lambda r: (key(r[0]), crc(r[1]))):
        want.append((doc_id, start, len(ids), crc(ids), ids))
        start += len(ids)
    assert sorted((tuple(r) for r in out), key=lambda r: r[1]) == want


def test_ranks_fall_with_counts(spark, docs, path):
    folder = shared_dir(spark)
    token_files.write(docs, path, folder)
    files, root = open_folder(folder)
    with files.open_input_stream(f"{root}/ranks.bin", compression=None) as source:
        ranks = np.frombuffer(source.read(), "<u4")
    counts = np.bincount(np.concatenate([token_files.unsqueeze(r["ids"]) for r in token_files.tokenized(docs, path).collect()]))[ranks]
    assert len(set(ranks.tolist())) == len(ranks) and all(a > b or a == b and x < y for a, b, x, y in zip(counts, counts[1:], ranks, ranks[1:], strict=False))


def test_no_documents(spark, docs, path):
    folder = shared_dir(spark)
    assert token_files.read(token_files.write(docs.where(F.lit(False)), path, folder), folder).count() == 0
