"""Quality rules: counts over words and lines, then compression bands.

Method: zstandard ratios (bytes before over bytes after) of the whole document
and of its fixed chunks.  A ratio above the band for that length marks
repetitive text, one below it text that is close to incompressible.  Bands
depend on length since a short text compresses less whatever it says.

The bands are those of the training corpus and the same at every size of it:
the distinct texts of sf0.1 that are labelled quality 1, pass the base rules and
have an even CRC-32 of their id (the others are held out) were cut into pieces
of each length below, eight at most a text.  Limits are the 0.1 % and 99.9 %
quantiles of the pieces' ratios, rounded outward to 0.01; from 12,288 bytes,
where pieces are few, the extremes; from 24,576 bytes pieces of the texts of one
language joined.  Lower limits then stand 10 % below (``least_slack``): they are to
meet noise, which compresses far less than prose, and prose of richer vocabulary
than the sample's lies up to 7 % under its least ratios.  Below 32 bytes zstandard's frame outweighs the text, so limits
there are wide.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vistaspark.llm.rows import BLANKS, with_columns_from_text

#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """limits: (bytes, least ratio, largest ratio), by ascending length; between two lengths limits go straight
    over the logarithm of the length, beyond the ends they stay."""

    limits: tuple[tuple[int, float, float], ...] = (
        (1, 0.0, 0.8), (16, 0.5, 0.8), (32, 0.78, 0.87), (64, 0.87, 1.19), (96, 0.97, 1.36), (128, 1.07, 1.46),
        (192, 1.2, 1.58), (256, 1.28, 1.65), (384, 1.36, 1.72), (512, 1.43, 1.76), (768, 1.59, 1.9), (1024, 1.7, 1.98),
        (1536, 1.83, 2.07), (2048, 1.9, 2.12), (3072, 2.01, 2.21), (4096, 2.08, 2.26), (6144, 2.15, 2.31), (8192, 2.21, 2.34),
        (12288, 2.26, 2.38), (16384, 2.29, 2.39), (24576, 2.33, 2.48), (32768, 2.36, 2.51), (65536, 2.41, 2.6), (131072, 2.47, 2.64),
    )
    #: Factor on the least ratios.
    least_slack: float = 0.9
    level: int = 3
    #: Texts of this length or more are judged by chunks too, the shorter last one included; one outside its band is enough.
    chunk_bytes: int = 4096

    def band(self, n_bytes: int) -> tuple[float, float]:
        at = bisect.bisect_right(self.limits, n_bytes, key=lambda x: x[0])
        if at in (0, len(self.limits)):
            return self.limits[max(0, at - 1)][1:]
        (n0, least0, largest0), (n1, least1, largest1) = self.limits[at - 1 : at + 1]
        share = math.log(n_bytes / n0) / math.log(n1 / n0)
        return least0 + share * (least1 - least0), largest0 + share * (largest1 - largest0)

    def verdict(self, n_bytes: int, ratio: float) -> str | None:
        least, largest = self.band(n_bytes)
        return "repetitive" if ratio > largest else "incompressible" if ratio < least * self.least_slack else None


def repeated_window_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    windows = list(zip(*[words[i:] for i in range(width)]))
    if len(set(windows)) == len(windows):
        return 0
    first: dict[tuple, int] = {}
    covered = bytearray(len(words))
    mark = b"\x01" * width
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            covered[i : i + width] = mark
            covered[j : j + width] = mark
    return sum(covered)


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(BLANKS.decode())]
    return len(lines) - len(set(lines))


def scan(text: str | None, bands: Bands, compress) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    bare = len(raw.translate(None, BLANKS))
    word_chars = len(text) - (len(raw) - bare)
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    repeated = repeated_window_words(words)
    base_failed = len(words) < 50 or 100 * repeated > 50 * len(words)
    n = len(raw)
    ratio = n / len(compress(raw)) if n else 0.0
    reason = bands.verdict(n, ratio) if n else None
    bad = 0
    if n >= bands.chunk_bytes:
        for lo in range(0, n, bands.chunk_bytes):
            part = raw[lo : lo + bands.chunk_bytes]
            bad += bands.verdict(len(part), len(part) / len(compress(part))) is not None
        if reason is None and bad:
            reason = "chunks"
    kept = not base_failed and reason is None
    return len(words), word_chars, symbols, duplicate_lines(text), repeated, base_failed, kept, ratio, bad, reason


def quality_rules(docs: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """docs with counts, ``base_failed``, ``kept``, ``zstd_ratio``, ``bad_chunks`` and ``reject_reason``.

    Null and empty texts have no words, hence fail the base rules; their ratio is
    0.  Texts of any length are compressed whole.  Each row is judged alone, so
    ties, repeated rows and order do not matter; an empty table gives an empty
    table.  Input columns named like a new one give way.
    """
    long, boolean, double, string = T.LongType(), T.BooleanType(), T.DoubleType(), T.StringType()
    fields = [
        ("n_words", long), ("word_chars", long), ("n_symbols", long), ("n_dup_lines", long), ("n_repeat_words", long),
        ("base_failed", boolean), ("kept", boolean), ("zstd_ratio", double), ("bad_chunks", long), ("reject_reason", string),
    ]

    def start():
        import zstandard

        compress = zstandard.ZstdCompressor(level=bands.level).compress
        return lambda x: scan(x, bands, compress)

    return with_columns_from_text(docs, text, fields, start)
