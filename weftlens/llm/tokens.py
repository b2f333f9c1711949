"""Encoding a corpus with a public byte-pair tokenizer (problem 7).

Per-prefix dynamic programming. For every prefix of a piece exactly one token can be the last one of its encoding. The
tokens that end at a place come from an automaton over the whole vocabulary (a trie with suffix links); of these the
last one is the token that either is the whole prefix or forms a compatible pair with the last token of the prefix
before it, where two tokens are compatible if merging their joined bytes gives the two back. The table of last tokens is
filled from left to right and read back from the end: the ids are exactly those of the tokenizer, in time linear in the
piece. Pieces (the tokenizer's own split of a text) repeat, so a worker remembers the encodings it has made.

Defined cases: null and empty texts give an empty list; strings of special tokens in a text are ordinary text; blank
texts are encoded like any other; lone surrogates are read as the replacement character.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlens.runtime import ship_package, spread

TOKENIZER_DIR = "/opt/tokenizers"
#: The split of byte-level BPE tokenizers of this family.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = 1 << 30


def read_ranks(name: str, folder: str = TOKENIZER_DIR) -> dict[bytes, int]:
    """Token bytes and ids of a ``.tiktoken`` file; the id is also the rank of its merge."""
    lines = (Path(folder) / f"{name}.tiktoken").read_bytes().splitlines()
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, lines))}


class PrefixEncoder(dict):
    """Encodes pieces; as a dictionary it holds the encodings made so far (at most ``remember``, then it starts anew)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, remember: int = 400_000) -> None:
        super().__init__()
        self.ranks, self.remember = ranks, remember
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """The plain encoding of a few bytes: merge the pair of lowest rank until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], _NONE), i) for i in range(len(parts) - 1))
            if rank == _NONE:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, first: int, second: int) -> bool:
        """Whether the two tokens stay as they are when their bytes are encoded together (``first`` -1: alone)."""
        key = (first + 1) << 32 | second
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            if first < 0:
                known = self.merged(self.bytes_of[second]) == [second]
            else:
                known = self.merged(self.bytes_of[first] + self.bytes_of[second]) == [first, second]
            self.pairs[key] = known
        return known

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "replace").decode("latin-1")
        size = len(data)
        last, length = array("i", [-1]) * (size + 1), array("i", [0]) * (size + 1)
        for end, (n, token) in self.automaton.iter(data):
            end += 1
            begin = end - n
            if last[end] < 0 and (begin == 0 or last[begin] >= 0) and self.compatible(last[begin] if begin else -1, token):
                last[end], length[end] = token, n
        found = []
        at = size
        while at:
            found.append(last[at])
            at -= length[at]
        return tuple(found[::-1])

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= self.remember:
            self.clear()
        found = self[piece] = self.encode_piece(piece)
        return found

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self.__getitem__, self.split(text))))

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.__getitem__, self.split(text)))) if text else 0


_ENCODERS: dict[tuple, PrefixEncoder] = {}


def encoder(key: tuple, ranks: dict[bytes, int]) -> PrefixEncoder:
    """One encoder per tokenizer and Python worker."""
    if key not in _ENCODERS:
        _ENCODERS[key] = PrefixEncoder(ranks)
    return _ENCODERS[key]


def token_ids(df: DataFrame, id_col: str, text_col: str, tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """``doc_id`` and ``ids`` of each row. The vocabulary is read on the driver and broadcast (its size is fixed)."""
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(read_ranks(tokenizer, tokenizer_dir))
    key = (tokenizer_dir, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(key, shared.value)
        for batch in batches:
            flat, ends = array("i"), array("i", [0])
            for text in batch.column(1).to_pylist():
                flat.extend(own.encode(text))
                ends.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])

    return spread(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))).mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(df: DataFrame, text_col: str, keep: list[str], tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the length of the text in tokens (0 for null and empty)."""
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(read_ranks(tokenizer, tokenizer_dir))
    key = (tokenizer_dir, tokenizer)
    picked = spread(df.select(*keep, F.col(text_col).alias("counted_text")))
    schema = picked.drop("counted_text").withColumn("tokens", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(key, shared.value)
        for batch in batches:
            counts = [own.count(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*batch.schema.names[:-1], "tokens"])

    return picked.mapInArrow(run, schema)
