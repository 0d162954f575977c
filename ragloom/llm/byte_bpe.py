"""Operator 8, byte-level BPE encoding and decoding.

Bytes stand as Latin-1 characters, so that a byte string is a Python string for the automaton. For each match of the split pattern the
encoder walks from longest matches: a token may follow another only if merging the two byte strings together would end with exactly
these two tokens (adjacent-token compatibility, memoised); where no match fits, it goes back one token. Every position is given up at
most once, so the work is linear in the text, and a sequence of pairwise compatible tokens is the one that the merges would make.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from ragloom.llm.common import safe_text, table

#: Entries of a worker's memo tables; they start afresh beyond it, which costs time, never results.
MEMO_WORDS, MEMO_PAIRS = 500_000, 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank per line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class ByteBPE:
    """Exact byte-level BPE over a rank table; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.rank_of = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.token_of = {rank: token for token, rank in self.rank_of.items()}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        if missing := [b for b in range(256) if chr(b) not in self.rank_of]:
            raise ValueError(f"the rank table lacks {len(missing)} single bytes")
        self.find = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.rank_of.items():
            self.automaton.add_word(token, (len(token), rank))
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes `token`; None for a single byte, or one that merges never reach."""
        if token not in self.halves:
            parts = list(self.token_of[token])
            rank_of = self.rank_of
            while len(parts) > 2:
                ranked = [(rank_of.get(a + b, token), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
                rank, i = min(ranked)
                if rank >= token:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[token] = (rank_of[parts[0]], rank_of[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both leaves exactly these two tokens.

        The last merges are undone one by one, the later first; at each moment the tokens that then touched at the border must not
        have had a merge that was due before the merge just undone.
        """
        known = self.fits.get((left, right))
        if known is not None:
            return known
        a, b, due = left, right, len(self.rank_of) + 1
        while True:
            joined = self.rank_of.get(self.token_of[a] + self.token_of[b])
            if joined is not None and joined < due:
                good = False
                break
            undo_a, undo_b = self.split(a), self.split(b)
            if undo_a is None and undo_b is None:
                good = True
                break
            if undo_b is None or (undo_a is not None and a > b):
                # of equal ranks the left one merges first, so a merge at the border waits for it
                due, a = a, undo_a[1]
            else:
                due, b = b + 1, undo_b[0]
        if len(self.fits) >= MEMO_PAIRS:
            self.fits.clear()
        self.fits[left, right] = good
        return good

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one match of the pattern, given as Latin-1 characters."""
        whole = self.rank_of.get(word)
        if whole is not None and (len(word) == 1 or self.split(whole) is not None):
            return (whole,)
        size = len(word)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for end, (length, rank) in self.automaton.iter(word):
            starts[end + 1 - length].append((length, rank))
        # the matches of a place are in order of length, as ends come in order; they are used from the longest on
        left = [len(x) for x in starts]
        dead = bytearray(size + 1)
        path: list[int] = []
        places: list[int] = []
        at = 0
        while at < size:
            options, k = starts[at], left[at]
            while k:
                k -= 1
                length, rank = options[k]
                if not dead[at + length] and (not path or self.compatible(path[-1], rank)):
                    break
            else:
                # nothing fits here after path[-1]: this place is given up for good
                dead[at] = 1
                if not path:
                    raise ValueError("no token sequence reproduces the merges")
                path.pop()
                at = places.pop()
                continue
            left[at] = k
            path.append(rank)
            places.append(at)
            at += length
            if at < size:
                left[at] = len(starts[at])
        return tuple(path)

    def encode(self, text: str) -> list[int]:
        """Ids of a text, as ordinary text: special tokens have no meaning here."""
        words, out = self.words, []
        for match in self.find(text):
            ids = words.get(match)
            if ids is None:
                ids = self.encode_word(match.encode("utf-8").decode("latin-1"))
                if len(match) <= 64:
                    if len(words) >= MEMO_WORDS:
                        words.clear()
                    words[match] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def byte_bpe(docs: DataFrame, *, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, `ids` (array of int) and `decoded` (binary, from the ids alone).

    The rank table (bounded by the vocabulary file) is read on the driver and broadcast; nothing is shuffled. Defined results: a null
    text is empty and has no ids; ids of rows are passed through, null and repeated ones too; an empty table gives no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((read_ranks(path), pattern))
    src = docs.select(F.col(id_col).alias("doc_id"), safe_text(text_col).alias("t"))
    kind = src.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(shared)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.fromiter((i for x in ids for i in x), np.int32, int(ends[-1]))
                arrays = [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array([bpe.decode(x) for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "decoded"])

    return src.mapInArrow(run, StructType([StructField("doc_id", kind), StructField("ids", ArrayType(IntegerType())), StructField("decoded", BinaryType())]))


_CACHE: list = [None, None]


def _encoder(shared) -> ByteBPE:
    """One encoder for each worker process, as long as the broadcast is the same."""
    if _CACHE[0] is not shared.value:
        _CACHE[:] = [shared.value, ByteBPE(*shared.value)]
    return _CACHE[1]


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the columns named."""
    return encoded.select("doc_id", *more, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(byte_bpe(table(spark, sf_dir, "documents"), path=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN))
