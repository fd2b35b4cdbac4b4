"""Byte-level BPE with a public vocabulary, encoded and decoded here.

Each pre-token is a doubly linked list of symbols; a priority queue holds the merges of
adjacent symbols by rank, and entries whose symbols have changed since are skipped when
they come up. Decoding concatenates vocabulary strings.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the vocabulary files; a parameter of every operator here.
VOCABULARIES = os.environ.get("COLLOQUY_TOKENIZERS", "/opt/tokenizers")
#: The published pre-token pattern of the byte-level vocabularies (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens whose ids each worker remembers; only speed depends on it.
REMEMBERED = 200_000
_LONGEST_REMEMBERED = 48


class BytePairEncoder:
    """Ids of texts by merge ranks; ``ranks`` gives the id of each byte string."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks, self.strings = ranks, {i: s for s, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self._known: dict[str, tuple[int, ...]] = {}

    @classmethod
    def load(cls, name: str, folder: str = VOCABULARIES) -> BytePairEncoder:
        path = os.path.join(folder, f"{name}.tiktoken")
        with open(path if os.path.exists(path) else SparkFiles.get(f"{name}.tiktoken"), "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        symbol: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            if (rank := ranks.get(piece[i : i + 2])) is not None:
                queue.append((rank, i, 2))
        heapify(queue)
        while queue:
            rank, left, length = heappop(queue)
            mine = symbol[left]
            if mine is None or (right := after[left]) < 0 or len(mine) + len(symbol[right]) != length or ranks.get(mine + symbol[right]) != rank:
                continue  # stale: one of the two has been merged since
            symbol[left] = mine = mine + symbol[right]
            symbol[right] = None
            after[left] = following = after[right]
            if following >= 0:
                before[following] = left
                joined = mine + symbol[following]
                if (rank := ranks.get(joined)) is not None:
                    heappush(queue, (rank, left, len(joined)))
            if (previous := before[left]) >= 0:
                joined = symbol[previous] + mine
                if (rank := ranks.get(joined)) is not None:
                    heappush(queue, (rank, previous, len(joined)))
        return [ranks[s] for s in symbol if s is not None]

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text``; an empty or null text has none. Strings that look like special
        tokens are ordinary text; lone surrogates become U+FFFD."""
        ids: list[int] = []
        if not text:
            return ids
        known = self._known
        for piece in self.split(text):
            found = known.get(piece)
            if found is None:
                found = tuple(self.merge(piece.encode("utf-8", "replace")))
                if len(piece) <= _LONGEST_REMEMBERED:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = found
            ids += found
        return ids

    def decode(self, ids: Sequence[int]) -> str:
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(name: str, folder: str) -> BytePairEncoder:
    """One encoder a worker process."""
    return BytePairEncoder.load(name, folder)


def ship(name: str, folder: str) -> None:
    """Give a vocabulary file to the workers of a cluster, once a context: they need no folder of
    their own."""
    spark, path = SparkSession.getActiveSession(), os.path.join(folder, f"{name}.tiktoken")
    if spark is None or spark.sparkContext.master.startswith("local") or not os.path.exists(path):
        return
    shipped = spark.sparkContext.__dict__.setdefault("_colloquy_vocabularies", set())
    if path not in shipped:
        spark.sparkContext.addFile(path)
        shipped.add(path)


def ids_of(text: Column, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> Column:
    """ARRAY<INT> of token ids, empty for empty and null texts."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(name, folder)
        for batch in texts:
            yield batch.map(own.encode)

    ship(name, folder)
    return encode(text)


def token_count(text: Column, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> Column:
    """BIGINT number of tokens, 0 for empty and null texts; the ids never leave the worker."""

    @F.pandas_udf(T.LongType())
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(name, folder)
        for batch in texts:
            yield batch.map(lambda t: len(own.encode(t)))

    ship(name, folder)
    return count(text)


def text_of(ids: Column, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> Column:
    """Texts of token ids."""

    @F.pandas_udf(T.StringType())
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(name, folder)
        for batch in batches:
            yield batch.map(own.decode)

    ship(name, folder)
    return decode(ids)


def encoded_corpus(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """doc_id and ids of every document. No shuffle: one pass over doc_id and text."""
    return documents.select("doc_id", ids_of(F.col("text"), name, folder).alias("ids"))
