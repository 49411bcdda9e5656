"""Quality rules: counts of words, symbols and repeats, and zstandard compression bands.

Repetitive text compresses far below what language does, and encoded or random text far above. How far a
text compresses also depends on its length (short texts cannot amortise the coder's tables), so the limits
are a table of bands by size in bytes. The ratio is taken over the whole text, over its fixed chunks and over the
tail behind the last of them, each with the band of its own length: a long document with a boilerplate half passes
the first test and fails the others. Chunks and tail count by their bytes. Hexadecimal noise compresses as prose
does, so no ratio tells it apart; a piece with a large share of hexadecimal words is out as well.

Empty or null texts have zero counts and fail the base rule. Rows are judged one by one, so ids don't matter: null,
repeated or of any type. Every other column of the input is untouched: the result is one struct column.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (bytes from, least ratio, greatest ratio) for zstandard level 3. The lower limits are wide on purpose. The upper ones
#: lie between prose in four languages and base64 words, both cut to the band's lengths; below 128 bytes the two
#: compress alike.
BANDS = (
    (0, 0.0, 100.0), (64, 0.35, 1.25), (128, 0.40, 0.99), (144, 0.40, 0.95), (176, 0.40, 0.91), (220, 0.40, 0.87), (256, 0.40, 0.85), (384, 0.40, 0.81), (512, 0.38, 0.78), (768, 0.38, 0.75),
    (1024, 0.35, 0.72), (2048, 0.35, 0.69), (4096, 0.32, 0.66), (16384, 0.30, 0.63),
)
CHUNK_BYTES = 4096
CHUNK_SHARE = 0.3
LEVEL = 3
SYMBOLS = "#*$%&|<>"
#: Words of hexadecimal digits that have letters and digits, and the share of bytes in them from which a piece is out.
HEX = re.compile(rb"(?<![0-9A-Za-z])(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]+(?![0-9A-Za-z])")
HEX_SHARE = 0.3
RULES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("ratio", T.DoubleType()), T.StructField("chunks_out", T.LongType()), T.StructField("chunks", T.LongType()), T.StructField("tail_out", T.BooleanType()), T.StructField("kept", T.BooleanType())]
)


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words inside windows of ``width`` (a power of two) words that the list holds twice or more.

    Without two equal window hashes there are none. Else windows get exact ids by prefix doubling: an id of 2k
    words is the rank of two ids of k words.
    """
    if len(words) < width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    hashes = ids * -7046029254386353131
    span = 1
    while span < width:
        hashes = hashes[: len(hashes) - span] * 2862933555777941757 + (hashes[span:] ^ (hashes[span:] >> 29))
        span *= 2
    hashes = np.sort(hashes)
    if not (hashes[1:] == hashes[:-1]).any():
        return 0
    span = 1
    while span < width:
        pairs = ids[: len(ids) - span] * (len(words) + 1) + ids[span:]
        distinct, ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        span *= 2
        if len(distinct) == len(pairs):
            return 0
    starts = np.flatnonzero(counts[ids] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(edges)))


def is_hexadecimal(data: bytes) -> bool:
    """Whether hexadecimal words take ``HEX_SHARE`` of the bytes. Without a tenth of digits they can't."""
    if 10 * (len(data) - len(data.translate(None, b"0123456789"))) < len(data):
        return False
    return sum(map(len, HEX.findall(data))) >= HEX_SHARE * len(data)


def text_rules(bands=BANDS, chunk_bytes: int = CHUNK_BYTES, chunk_share: float = CHUNK_SHARE, level: int = LEVEL, min_words: int = 20, max_repeat_percent: int = 30):
    """A pandas UDF from text to the ``RULES`` struct."""
    froms = [b[0] for b in bands]

    def outside(data: bytes, packed: int) -> bool:
        _, least, most = bands[bisect.bisect_right(froms, len(data)) - 1]
        return not least <= packed / len(data) <= most or is_hexadecimal(data)

    @F.pandas_udf(RULES)
    def rules(texts: pd.Series) -> pd.DataFrame:
        import zstandard

        packer = zstandard.ZstdCompressor(level=level)
        rows = []
        for text in texts:
            text = text or ""
            data = text.encode("utf-8", "surrogatepass")
            words = data.split()
            lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
            repeats = repeated_words(words)
            failed = len(words) < min_words or 100 * repeats > max_repeat_percent * len(words)
            ratio, out, chunks, tail_out, kept = None, 0, 0, None, False
            if data:
                whole = len(packer.compress(data))
                ratio, all_out = whole / len(data), outside(data, whole)
                chunks = len(data) // chunk_bytes
                pieces = [data[at : at + chunk_bytes] for at in range(0, chunks * chunk_bytes, chunk_bytes)]
                out = sum(outside(piece, len(packer.compress(piece))) for piece in pieces)
                if tail := data[chunks * chunk_bytes :]:
                    tail_out = outside(tail, len(packer.compress(tail))) if chunks else all_out
                bytes_out = out * chunk_bytes + len(tail) * bool(tail_out)
                kept = not failed and not all_out and bytes_out <= chunk_share * len(data)
            space = sum(map(text.count, " \t\n\v\f\r"))
            rows.append((len(words), len(text) - space, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, failed, ratio, out, chunks, tail_out, kept))
        return pd.DataFrame(rows, columns=RULES.names)

    return rules


def quality_rules(docs: DataFrame, text: str | Column = "text", out: str = "rules", **limits) -> DataFrame:
    """``docs`` with the struct column ``out``; a narrow step, no shuffle, rows and other columns as they were."""
    return docs.withColumn(out, text_rules(**limits)(F.col(text) if isinstance(text, str) else text))
