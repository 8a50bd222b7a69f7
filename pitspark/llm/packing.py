"""Best-fit packing of tokenized documents into sequences.

Bounded-space online best-fit: a fixed number of sequences is open; a bitset has bit f set where an open one has f tokens
free, so the best fit for a piece of n tokens is the lowest set bit from n on. If none fits, a new sequence opens, and
where too many are open the fullest closes first. Pieces come in hash order, in parts that pack alone; of each WINDOW that
arrives the longest go first, so that short ones fill what long ones leave. Nothing but the window and the open sequences
is held, however many pieces a part has. No two pieces over half length share a sequence; there are more sequences open
than a window has pieces, so none closes before short pieces have had a chance to fill it.
"""

from __future__ import annotations

import base64
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, table

LENGTH, OPEN, WINDOW, END_ID = 1024, 8192, 4096, 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class BestFit:
    """Packs lengths as they come: place(n) returns (sequence, offset)."""

    def __init__(self, size: int = LENGTH, most_open: int = OPEN):
        self.size, self.most_open = size, most_open
        self.bits, self.at = 0, [[] for _ in range(size + 1)]
        self.n_open = self.n_made = 0

    def place(self, n: int) -> tuple[int, int]:
        fits = self.bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            seq = self._take(free)
        else:
            if self.n_open == self.most_open:  # the fullest has the lowest bit
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, seq = self.size, self.n_made
            self.n_made += 1
        left = free - n
        if left:
            self.at[left].append(seq)
            self.bits |= 1 << left
            self.n_open += 1
        return seq, self.size - free

    def _take(self, free: int) -> int:
        seq = self.at[free].pop()
        if not self.at[free]:
            self.bits ^= 1 << free
        self.n_open -= 1
        return seq


_encoders: dict = {}


def encoder(json_path: str):
    """What the tokenizer in json_path gives with add_special_tokens=False, as a function from text to ids.

    A tiktoken encoder of the same byte-level ranks gives the same ids about five times as fast; it reads all texts but those
    that hold the string of a special token, which the tokenizer's own library reads, as it reads all where no ranks stand
    beside the file.
    """
    if json_path not in _encoders:
        import os

        from tokenizers import Tokenizer

        own = Tokenizer.from_file(json_path)
        special = [t.content for t in own.get_added_tokens_decoder().values()]
        slow = lambda text: own.encode(text, add_special_tokens=False).ids
        ranks = json_path.removesuffix(".json") + ".tiktoken"
        _encoders[json_path] = slow
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={}).encode_ordinary
            _encoders[json_path] = lambda text: slow(text) if any(x in text for x in special) else fast(text)
    return _encoders[json_path]


def cut(ids: np.ndarray, size: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces, the first of which may be shorter."""
    n = len(ids)
    first = n if n <= size else n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def tokenized_pieces(docs: DataFrame, tokenizer: str, size: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document; null text counts as empty, which leaves the end id alone.

    Repeated rows are documents of their own; columns other than doc_id and text are not carried.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for df in parts:
            out = []
            for doc, text in zip(df["doc_id"], df["text"], strict=True):
                ids = np.array([*(encode(text) if text else ()), END_ID], dtype="<u4")
                out += [(doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes()), *([ids[s : s + n].astype(int).tolist()] if with_ids else [])) for k, (s, n) in enumerate(cut(ids, size))]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, PIECES + (", ids array<int>" if with_ids else ""))


def place_all(lengths: Iterator[np.ndarray], size: int = LENGTH, most_open: int = OPEN, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sequence, offset) of the lengths of each array; arrays have at most window lengths, and the longest of each go first."""
    bins = BestFit(size, most_open)
    for part in lengths:
        seq, offset = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        for i in np.argsort(-part, kind="stable").tolist():
            seq[i], offset[i] = bins.place(int(part[i]))
        yield seq, offset


def _windows(parts: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """The rows of parts in frames of size rows, the last one shorter."""
    held, n = [], 0
    for df in parts:
        while len(df):
            held.append(df.iloc[: size - n])
            df = df.iloc[size - n :]
            n += len(held[-1])
            if n == size:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def pack_pieces(pieces: DataFrame, size: int = LENGTH, most_open: int = OPEN, part_rows: int = 100_000) -> DataFrame:
    """pieces with sequence_id and offset.

    Full pieces are sequences of their own and need no packing. The others are dealt evenly, whatever their values, into
    parts of about part_rows. Pieces longer than size raise. Repeated rows are packed each. An empty table gives an empty
    result.
    """
    small = pieces.filter(F.col("length") < size)
    n_parts = max(1, -(-small.count() // part_rows))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        windows, again = itertools.tee(_windows(parts, WINDOW))
        placed = place_all((w["length"].to_numpy() for w in windows), size, most_open)
        for df, (seq, offset) in zip(again, placed, strict=True):
            yield df.assign(sequence_id=seq + (part << 32), offset=offset)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    dealt = small.repartition(n_parts).sortWithinPartitions(F.xxhash64("doc_id", "piece", "ids_crc32"), "doc_id")
    packed = dealt.mapInPandas(run, f"{fields}, sequence_id long, offset long")
    big = pieces.filter(F.col("length") >= size)
    # negative numbers: no part of the others has them
    alone = big.withColumn("sequence_id", F.when(F.col("length") == size, -1 - F.monotonically_increasing_id()).otherwise(F.raise_error(F.lit("a piece is longer than a sequence")))).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = LENGTH) -> DataFrame:
    """Tokenize once into a staged table of piece lengths and checksums, then pack."""
    return pack_pieces(stage(tokenized_pieces(docs, tokenizer, size), "pieces"), size)


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens. Null and empty texts are the end id alone; repeated rows are packed each."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
