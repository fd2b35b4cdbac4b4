from __future__ import annotations

import os
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARIES), reason="no vocabulary files")


@pytest.fixture(scope="module")
def encoder():
    return bpe.BytePairEncoder.load("byte_bpe_50k")


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_equals_the_library_and_comes_back(encoder, library, text):
    ids = encoder.encode(text)
    assert ids == library.encode_ordinary(text)
    assert encoder.decode(ids) == text


def test_long_and_odd_texts(encoder, library):
    rng = random.Random(1)
    for text in (
        "a" * 20_000, "会议" * 3_000, "".join(chr(rng.randrange(0x20, 0x3000)) for _ in range(20_000)), "<|endoftext|> x", " \n\n\t ",
        "x" * 49 + " " + "yz" * 40,
    ):
        ids = encoder.encode(text)
        assert ids == library.encode_ordinary(text) and encoder.decode(ids) == text
    assert encoder.encode(None) == encoder.encode("") == []


def test_columns(spark, encoder):
    df = spark.createDataFrame([(1, "Hello <|endoftext|> wörld"), (2, ""), (3, None), (4, "Hello")], "doc_id bigint, text string")
    rows = {r["doc_id"]: r["ids"] for r in bpe.encoded_corpus(df.withColumn("ids", F.lit(0))).collect()}
    assert rows == {i: encoder.encode(t) for i, t in [(1, "Hello <|endoftext|> wörld"), (2, ""), (3, None), (4, "Hello")]}
    assert rows[2] == rows[3] == [] and bpe.encoded_corpus(df).schema["ids"].dataType.simpleString() == "array<int>"
    back = df.select("doc_id", bpe.text_of(bpe.ids_of(F.col("text"))).alias("t"), bpe.token_count(F.col("text")).alias("n")).collect()
    assert {r["doc_id"]: r["t"] for r in back} == {1: "Hello <|endoftext|> wörld", 2: "", 3: "", 4: "Hello"}
    assert {r["doc_id"]: r["n"] for r in back} == {i: len(x) for i, x in rows.items()}
    assert bpe.encoded_corpus(df.limit(0)).count() == 0


def test_workers_need_no_folder(spark, encoder, monkeypatch):
    """Where there is no folder, the file that was given to the context is read."""
    spark.sparkContext.addFile(os.path.join(bpe.VOCABULARIES, "byte_bpe_50k.tiktoken"))
    assert bpe.BytePairEncoder.load("byte_bpe_50k", "/nowhere").encode("a shipped file") == encoder.encode("a shipped file")
    df = spark.createDataFrame([("some words",), (None,)], "t string")
    got = [r["n"] for r in df.select(bpe.token_count(F.col("t"), "byte_bpe_50k", "/nowhere").alias("n")).collect()]
    assert got == [len(encoder.encode("some words")), 0]
