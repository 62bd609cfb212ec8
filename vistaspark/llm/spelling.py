"""Groups of spelling variants: a symmetric-delete join.

Every word emits itself and its distinct single deletions as 64-bit keys; keys
are equi-joined.  Words that differ by one inserted or deleted code point share
the shorter word itself; words that differ by one replaced code point share what
is left without it.  A deletion key keeps the stretch of places whose deletion
gives it (equal neighbours), so the join takes just those that were changed at
one place; a pair meets under one key only, and every pair is verified by its
words.  Pairs are then counted by word, each word points to its most frequent
neighbour if that is frequent enough, and pointers are followed by iterated joins.

A key is shared by at most (alphabet x places) words, whatever the corpus holds.
Words go by their number in code-point order, so neither keys nor pairs carry text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistaspark.operators.order import with_ordinal
from vistaspark.sources.workspace import Workspace

#: A word: a longest run of these.
WORD = "[A-Za-zÀ-ÿ]+"
_NO_WORD = "[^A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def runs(text: Column) -> Column:
    """All words of a text, in order, with A-Z lower-cased and no other letter changed."""
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.filter(F.split(lowered, _NO_WORD, -1), lambda w: w != "")


def _mixed(codes: np.ndarray) -> np.ndarray:
    """A well spread 64-bit number for each code point."""
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_keys(words: list[str]) -> dict[str, np.ndarray]:
    """Keys that words emit: ``row`` (place in words), ``key``, ``size`` (of the word), ``lo`` and ``hi``.

    The word itself has lo = -1; a deletion has the first and the last place whose
    deletion gives it.  Equal strings have equal keys; cost and size are linear in
    the words' lengths.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    row = np.repeat(np.arange(sizes.size), sizes)
    place = np.arange(codes.size) - starts[row]
    longest = int(sizes.max(initial=0)) + 1
    power, inverse = _powers(_BASE, longest), np.uint64(_INVERSE)
    value = _mixed(codes) * power[place]
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    whole = upto[ends] - upto[starts]
    # Places after the deleted one move one to the left.
    at = np.arange(codes.size)
    less = (upto[at] - upto[starts[row]]) + (upto[ends[row]] - upto[at + 1]) * inverse
    fresh = np.ones(codes.size, bool)
    fresh[1:] = (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], codes.size)[: first.size] - 1
    own = np.arange(sizes.size)
    return {
        "row": np.concatenate([own, row[first]]),
        "key": np.concatenate([whole, less[first]]).view(np.int64),
        "size": np.concatenate([sizes, sizes[row[first]]]),
        "lo": np.concatenate([np.full(own.size, -1), place[first]]),
        "hi": np.concatenate([np.full(own.size, -1), place[last]]),
    }


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, pending = 0, []
        texts = batch.column("word").to_pylist()
        ids = batch.column("id").to_numpy()
        while at < len(texts):
            size, lo = 0, at
            while at < len(texts) and (at == lo or size + len(texts[at]) < 1 << 18):
                size += len(texts[at])
                at += 1
            k = word_keys(texts[lo:at])
            pending = [k["key"], ids[lo:at][k["row"]], k["size"].astype(np.int32), k["lo"].astype(np.int32), k["hi"].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in pending], names=["key", "id", "size", "lo", "hi"])


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): ids of words exactly one inserted, deleted or replaced code point apart, both ways round.

    ``words``: distinct ``word`` with a distinct ``id`` (long).
    """
    keys = words.select("id", "word").mapInArrow(_emit, "key long, id long, size int, lo int, hi int")
    keys = Workspace(words.sparkSession, "spelling-keys").put(keys, "keys")
    left = keys.select("key", *[F.col(c).alias(f"{c}_a") for c in ("id", "size", "lo", "hi")])
    right = keys.select("key", *[F.col(c).alias(f"{c}_b") for c in ("id", "size", "lo", "hi")])
    # One word itself and the other's deletion, or two deletions at a common place.
    shorter = (F.col("lo_a") == -1) & (F.col("lo_b") >= 0) & (F.col("size_a") + 1 == F.col("size_b"))
    replaced = (F.col("lo_a") >= 0) & (F.col("lo_b") >= 0) & (F.col("size_a") == F.col("size_b")) & (F.col("lo_a") <= F.col("hi_b")) & (F.col("lo_b") <= F.col("hi_a")) & (F.col("id_a") < F.col("id_b"))
    met = left.join(right, "key").where(shorter | replaced).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    texts = words.select("id", "word")
    both = (
        met.join(texts.select(F.col("id").alias("a"), F.col("word").alias("word_a")), "a")
        .join(texts.select(F.col("id").alias("b"), F.col("word").alias("word_b")), "b")
        .where(F.levenshtein("word_a", "word_b", 1) == 1).select("a", "b")
    )
    return both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))


def follow(pointers: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, root) for every id that has a ``form``: the last id reached along forms.

    Each round doubles the steps taken: a joined table of its own roots.  Forms must
    not go in circles (here each step leads to a more frequent word).
    """
    work = Workspace(pointers.sparkSession, "spelling-roots")
    current = work.put(pointers.select("id", F.col("form").alias("root")), "r0")
    for k in range(1, max_rounds + 1):
        further = current.select(F.col("id").alias("root"), F.col("root").alias("next"))
        after = work.put(current.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"r{k}")
        if after.where("moved").isEmpty():
            return after.select("id", "root")
        current = after.select("id", "root")
    raise RuntimeError(f"forms did not end in {max_rounds} rounds")


def variants(counts: DataFrame, word: str = "word", n: str = "n", ratio: int = 5) -> DataFrame:
    """One row per word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``counts``: distinct words with their numbers of occurrences.  A word's near
    words are those one code point apart; its form is the most frequent of them
    (ties: the smallest in code-point order) if that has at least ``ratio`` times
    the word's occurrences, else null; its root is where forms lead, the word itself
    without one.  Null words go, null numbers count as 0; words of any length are
    compared whole.  An empty table gives an empty table.
    """
    work = Workspace(counts.sparkSession, "spelling")
    plain = counts.select(F.col(word).alias("word"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("n")).where(F.col("word").isNotNull())
    words = work.put(with_ordinal(plain, ["word"], "id"), "words")
    pairs = near_pairs(words)
    best = (
        pairs.join(words.select(F.col("id").alias("b"), F.col("n").alias("n_b")), "b")
        .groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.max(F.struct(F.col("n_b").alias("n"), (-F.col("b")).alias("b"))).alias("top"))
        .select(F.col("a").alias("id"), "n_near", F.col("top.n").alias("top_n"), (-F.col("top.b")).alias("top"))
    )
    taken = F.col("top_n") >= F.lit(ratio) * F.col("n")
    told = work.put(
        words.join(best, "id", "left").select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(taken, F.col("top")).alias("form"), F.when(taken, F.col("top_n")).alias("form_n")), "told")
    roots = follow(told.where(F.col("form").isNotNull()))
    name = lambda key, to: words.select(F.col("id").alias(key), F.col("word").alias(to))
    named = told.join(roots, "id", "left").join(name("form", "form_word"), "form", "left").join(name("root", "root_word"), "root", "left")
    return named.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def count_words(words: DataFrame, word: str = "word", min_chars: int = 6, min_count: int = 5) -> DataFrame:
    """(word, n) of words with at least ``min_chars`` code points and ``min_count`` occurrences; counted before anything is exchanged."""
    return words.where(F.length(word) >= min_chars).groupBy(F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
