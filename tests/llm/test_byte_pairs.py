"""Byte-level BPE against the library, on public vocabularies and on odd rank files, and back again."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from changeledger.llm import byte_pairs
from changeledger.llm.byte_pairs import Encoder, Ranks, decode, encode, replay
from changeledger.llm.queries import op13_byte_pairs

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SIGNS = ["a", "aa", "the", " the", "  ", "\n", "\t", "\x1c", "\x85", "　", "é", "日本", "'s", "'RE", " 12", "١", "\U0001f600", "<|endoftext|>", "Ⅷ", "²", "\x00", "́"]


def library(path):
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(seed=1, n=1_500):
    r = random.Random(seed)
    return ["", "x", "a" * 5_000, "ab" * 3_000, " " * 4_000, "日" * 2_000, "\n \n" * 500] + [
        "".join(r.choices(SIGNS, k=r.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("path", [PATH, MULTI])
@pytest.mark.parametrize("many", [1, 24, 10 ** 9])
def test_encoder_equals_the_library(path, many, monkeypatch):
    monkeypatch.setattr(byte_pairs, "MANY", many)
    monkeypatch.setattr(byte_pairs, "LOT", 10_000)
    encoder, plain = Encoder(path, public_tokenizers.PATTERN), library(path)
    for start in range(0, 1_500, 250):
        lot = texts()[start:start + 250]
        for text, found in zip(lot, encoder.encode(lot), strict=True):
            numbers = np.frombuffer(found, np.int32)
            assert numbers.tolist() == plain.encode_ordinary(text)
            assert encoder.ranks.decode(numbers) == text.encode()


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("many", [1, 10 ** 9])
def test_odd_rank_files(seed, many, tmp_path, monkeypatch):
    """Ranks in no order that training would give: a merge may make a pair of lower rank."""
    monkeypatch.setattr(byte_pairs, "MANY", many)
    r = random.Random(seed)
    tokens = list({bytes(r.choices(b"abc", k=r.randint(2, 5))) for _ in range(60)})
    r.shuffle(tokens)
    alphabet = [bytes([b]) for b in range(256)]
    every = [*alphabet, *tokens] if seed % 2 else [*tokens, *alphabet]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(every)))
    plain = tiktoken.Encoding("odd", pat_str=r"(?s).+", mergeable_ranks={t: i for i, t in enumerate(every)}, special_tokens={})
    pieces = ["".join(r.choices("abc", k=r.randint(1, 60))) for _ in range(300)]
    for piece, found in zip(pieces, replay([p.encode() for p in pieces], Ranks(str(path)))):
        assert np.frombuffer(found, np.int32).tolist() == plain.encode_ordinary(piece), piece


def test_columns(spark):
    rows = [(i, t, b"x", "ids") for i, t in enumerate([None, *texts(n=300), "b" * 200_000])]
    frame = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, ids binary, encoded string").repartition(3)
    plain = library(PATH)
    numbers = frame.withColumn("n", encode(F.col("text"), PATH, public_tokenizers.PATTERN))
    result = numbers.select("*", decode(F.col("n"), PATH).alias("back")).collect()
    assert len(result) == len(rows) + 5
    for row in result:
        assert row.n == (plain.encode_ordinary(row.text or "") if row.doc_id != len(rows) - 1 else row.n)
        assert bytes(row.back) == (row.text or "").encode()
    assert numbers.limit(0).collect() == []


def test_decode_odd_lists(spark):
    frame = spark.createDataFrame([(1, None), (2, []), (3, [220])], "k int, n array<int>")
    assert {r.k: bytes(r.b) for r in frame.select("k", decode(F.col("n"), PATH).alias("b")).collect()} == {1: b"", 2: b"", 3: b" "}
    with pytest.raises(ValueError):
        Ranks(PATH).decode(np.array([50_256]))


def test_query(spark, tmp_path):
    rows = list(enumerate([None, *texts(n=200)]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    result = op13_byte_pairs(spark, str(tmp_path))
    assert dict(result.dtypes) == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    plain, digest = library(PATH), lambda b: hashlib.sha256(b).hexdigest()
    for row in result.collect():
        text = rows[row.doc_id][1] or ""
        numbers = plain.encode_ordinary(text)
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (
            len(numbers), digest(" ".join(map(str, numbers)).encode()), digest(text.encode()))
