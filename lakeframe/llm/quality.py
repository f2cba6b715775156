"""Quality rules by compression bands.

zstandard's ratio over a whole document, and over its chunks of fixed size, tells repetitive text (high) and noise such
as encoded binaries or keys (low). What is usual depends on length, as short texts compress less, so the limits are a
table of bands by size in bytes. A document is rejected if its own ratio leaves its band, or if more than
CHUNK_SHARE of its chunks leave the chunks' band. Plain counts of words, symbols, repeated lines and repeated 3-word
windows come along, and two of them reject a document beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, parts

#: (bytes below, least ratio, greatest ratio); set a little beyond the range that clean texts of each length have.
BANDS = (
    (64, 0.0, 1.6),
    (128, 0.7, 1.7),
    (256, 0.85, 1.85),
    (512, 1.05, 2.0),
    (1024, 1.15, 2.1),
    (2048, 1.35, 2.25),
    (4096, 1.5, 2.32),
    (16384, 1.6, 2.52),
    (65536, 1.7, 2.65),
    (1 << 62, 1.75, 2.85),
)
CHUNK = 2048
CHUNK_BAND = (1.3, 2.6)
#: A last chunk under this size is not judged by itself.
CHUNK_LEAST = 1024
CHUNK_SHARE = 0.25
LEVEL = 3
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
SPACES = " \t\n\x0b\x0c\r"


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a 3-word window that occurs twice or more, its first occurrence included."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    m = len(numbers)
    pair = ids[:-2] * m + ids[1:-1]
    if m > 2_000_000:  # three numbers no longer fit in 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair * m + ids[2:]
    _, place, count = np.unique(window, return_inverse=True, return_counts=True)
    twice = count[place] > 1
    inside = np.zeros(len(words), bool)
    for i in range(3):
        inside[i : i + len(twice)] |= twice
    return int(inside.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()  # on exactly the ASCII white space
    word_chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), word_chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def compression(data: bytes, compress) -> tuple[float, float]:
    """The ratio over the whole, and the share of chunks outside their band."""
    if not data:
        return 0.0, 0.0
    ratio = len(data) / len(compress(data))
    chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
    chunks = [x for x in chunks if len(x) >= CHUNK_LEAST]
    low, high = CHUNK_BAND
    out = sum(not low <= len(x) / len(compress(x)) <= high for x in chunks)
    return ratio, out / len(chunks) if chunks else 0.0


def within_bands(n_bytes: int, ratio: float, chunk_share: float, bands: tuple = BANDS) -> bool:
    low, high = next((low, high) for below, low, high in bands if n_bytes < below)
    return low <= ratio <= high and chunk_share <= CHUNK_SHARE


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    for batch in parts(batches):
        rows = []
        for text in batch.column("text").to_pylist():
            text = text or ""
            n_words, word_chars, symbols, dup_lines, repeat = base_counts(text)
            failed = n_words < LEAST_WORDS or 100 * repeat > 50 * n_words
            data = text.encode("utf-8", "surrogatepass")
            ratio, share = compression(data, compress)
            rows.append((n_words, word_chars, symbols, dup_lines, repeat, failed, not failed and within_bands(len(data), ratio, share), ratio, share))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 9
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "chunks_out"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True))], names=["doc_id", *names])


def quality_bands(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio, chunks_out.

    Null and empty texts have no words and fail; each row is judged by itself, so repeated rows get equal results and
    a null doc_id is kept as it is; a line is a duplicate if it equals an earlier one exactly; other columns are not read.
    """
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunks_out double"
    return bounded(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_judge, schema)
