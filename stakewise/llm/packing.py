"""Best-fit packing of token sequences by hierarchical residual packing.

Each task tokenizes its documents, cuts only those longer than a sequence, and packs its pieces best-fit,
largest first. Bins that are nearly full are final. The underfull ones become items themselves: groups of
bounded size are packed again, round after round, until one group is left or a round saves less than a hundredth of
the bins. What is shuffled is a few numbers a bin, never tokens.

A null text counts as empty, and an empty text is its end token alone. Equal lengths are taken in the order
of the input, so a packing is repeatable. Ids may be of any type, null or repeated: each row is packed for itself.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stakewise.llm.common import stored

CAPACITY = 4096
#: A bin with at most so many free places is final.
NEARLY_FULL = 8
#: Items packed together at most, in a task or in a merge group.
BLOCK = 200_000
GROUP = 20_000
#: Share of the bins that a round may leave for another one to follow.
LEAST_GAIN = 0.99
#: Words whose ids a worker remembers; the memory is emptied when full.
CACHED_WORDS = 500_000
#: Documents tokenized together.
BATCH = 500

PIECES = ["piece", "start", "length", "ids_crc32", "bin", "at"]


def letters(word: str) -> bool:
    """Whether a word is letters alone, also as the tokenizer normalises it."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


class WordIds:
    """Little-endian ids of white-space-free strings, remembered by worker.

    The tokenizer's rules never look across white space, so a text's ids are its words' ids in a row. Letters
    and the stops after them are separate units too; unknown runs of letters are encoded many at a time and
    told apart by the ids that end a word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: set[str]) -> None:
        """Remember the ids of ``new`` words: letters and the stops after them apart, anything else whole."""
        cores, rest, split = set(), set(), []
        for word in new:
            core = word.rstrip(".,")
            if letters(core):
                cores.add(core)
                if len(core) < len(word):
                    split.append((word, core, word[len(core) :]))
            else:
                rest.add(word)
        rest.update({tail for _, _, tail in split})
        cores, rest = list(cores.difference(self.known)), list(rest.difference(self.known))
        chunks = [cores[i : i + 64] for i in range(0, len(cores), 64)]
        found = self.encoded([" ".join(c) for c in chunks])
        if chunks:
            ids = np.concatenate(found)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(cores):
                self.remember(cores, ids.tobytes(), (4 * ends).tolist())
            else:
                for word, one in zip(cores, self.encoded(cores), strict=True):
                    self.known[word] = one.tobytes()
        for word, one in zip(rest, self.encoded(rest), strict=True):
            self.known[word] = one.tobytes()
        known = self.known
        known.update([(word, known[core] + known[tail]) for word, core, tail in split])

    def remember(self, words: list[str], data: bytes, ends: list[int]) -> None:
        self.known.update(zip(words, [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def texts(self, texts: list[str | None], end: int) -> list[bytes]:
        """The ids of each text and the end id, four bytes each."""
        if len(self.known) > CACHED_WORDS:
            self.known = {"": b""}
        split = [(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        self.learn(set().union(*split).difference(self.known))
        tail, ids = int(end).to_bytes(4, "little"), self.known.__getitem__
        return [b"".join(map(ids, words)) + tail for words in split]


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: each item's bin and place, and the bins' fill. A bit set finds the tightest bin."""
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_sizes = 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        fitting = open_sizes >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                open_sizes &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[i], places[i] = b, fill[b]
        fill[b] += n
        if left := room - n:
            free[left].append(b)
            open_sizes |= 1 << left
    return bins, places, fill


def local_packing(tokenizer: str, capacity: int, end: int):
    """Tokenize, cut and pack the documents of one task, ``BLOCK`` pieces at a time. Ids stay Arrow values."""

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        ids, first = word_ids(tokenizer), TaskContext.get().partitionId() << 36
        owners: list = []
        rows: list[tuple] = []

        def packed():
            nonlocal first, owners, rows
            columns = [np.array(c, np.int64) for c in zip(*rows, strict=True)]
            bins, places, fill = best_fit(columns[2], capacity)
            made = [pa.concat_arrays(owners), *map(pa.array, (*columns, bins + first, places))]
            first, owners, rows = first + len(fill), [], []
            return pa.RecordBatch.from_arrays(made, names=["doc_id", *PIECES])

        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                owner: list[int] = []
                for k, data in enumerate(ids.texts(part.column("text").to_pylist(), end)):
                    for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                        cut = data[at : at + 4 * capacity]
                        rows.append((piece, at // 4, len(cut) // 4, zlib.crc32(cut)))
                        owner.append(k)
                owners.append(part.column("doc_id").take(pa.array(owner, pa.int64())))
            if len(rows) >= BLOCK:
                yield packed()
        if rows:
            yield packed()

    return pack


def merge_rounds(bins: DataFrame, capacity: int) -> DataFrame | None:
    """Pack underfull ``bins`` (bin, used) into each other; bin, new bin and the shift of its contents.

    A round deals the bins to new groups of ``GROUP`` on average and packs each group best-fit. It takes the still
    underfull results of the last round. Rounds end with one that had a single group, or when one saved next to nothing.
    """

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["used", "bin"])
        names = frame["bin"].to_numpy()
        to, shift, fill = best_fit(frame["used"].to_numpy(np.int64), capacity)
        head = np.zeros(len(fill), np.int64)
        head[to[::-1]] = names[::-1]
        return pd.DataFrame({"bin": names, "to": head[to], "shift": shift, "filled": np.array(fill, np.int64)[to]})

    moved, bins, last, salt = None, stored(bins, "underfull"), None, 0
    while (n := bins.count()) > 1 and (last is None or n < LEAST_GAIN * last):
        groups, last, salt = -(-n // GROUP), n, salt + 1
        packed = bins.withColumn("g", F.pmod(F.xxhash64("bin", F.lit(salt)), F.lit(groups))).groupBy("g").applyInPandas(pack, "bin long, to long, shift long, filled long")
        packed = stored(packed, "packed")
        if moved is None:
            moved = packed
        else:
            later = packed.select(F.col("bin").alias("to"), F.col("to").alias("to2"), F.col("shift").alias("shift2"))
            moved = stored(moved.join(later, "to", "left").select("bin", F.coalesce("to2", "to").alias("to"), (F.col("shift") + F.coalesce("shift2", F.lit(0))).alias("shift")), "moved")
        if groups == 1:
            break
        left = packed.groupBy(F.col("to").alias("bin")).agg(F.first("filled").alias("used")).filter(F.col("used") < capacity - NEARLY_FULL)
        bins = stored(left, "underfull")
    return moved


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([named.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in PIECES]])
    pieces = named.mapInArrow(local_packing(tokenizer, capacity, end), schema)
    pieces = stored(pieces.withColumn("piece", F.col("piece").cast("int")), "pieces")
    bins = pieces.groupBy("bin").agg(F.sum("length").alias("used")).filter(F.col("used") < capacity - NEARLY_FULL)
    moved = merge_rounds(bins, capacity)
    if moved is None:
        return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    moved = moved.select("bin", "to", "shift")
    return pieces.join(moved, "bin", "left").select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("to", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"))
