"""A Katz backoff language model: Good-Turing discounted counts, exactly normalised backoff weights.

    P(w)     = d(c(w)) c(w) / N,  unknown words as one type with the mass that is left
    P(w | h) = s(h) d(c(h w)) c(h w) / c(h)        where h w was seen
             = a(h) P(w | h without its first)     elsewhere

d is Katz's discount for counts up to 5, by order.  s(h) is 1, or c(h) / (c(h) + 1)
where nothing after h is discounted: Good-Turing then leaves no mass to back off
with.  a(h) makes P(. | h) sum to 1 exactly; it is 1 where h was not seen.

Counts and backoff weights are tables by key range (``Model.tables``): a row holds
a range's keys, sorted, with their counts, or with s and a.  Text lies in blocks; a
block asks the tables for its distinct n-grams (see ``blocks.exchange``) and
evaluates the recursion from words up to the model's order.  A stored model scores
other texts in the same way (``score_with``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaspark.llm import blocks as B
from vistaspark.sources.workspace import Workspace

#: Counts above this are not discounted.
CUTOFF = 5
#: Bits a level of an exchange deals by: keys are most of what is shuffled, so few levels (1 to 256 blocks, 2 to 65,536).
FAN_BITS = 8
#: The lowest bits of a key are its order, 1 to 7.
ORDER_BITS = np.uint64(7)
#: Keys of the mark before a text (a context only) and of the end token.
START, END = np.uint64(0x51A21), np.uint64(0xE7D09)
SCORES = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def of_order(keys: np.ndarray, order: int) -> np.ndarray:
    return (keys & ~ORDER_BITS) | np.uint64(order)


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """Factors for counts 0 to CUTOFF + 1 (the last: all larger) from n_1 .. n_{CUTOFF + 1}.

    Good-Turing needs every n_r and factors in (0, 1]; small corpora may lack
    them, and then (r - 0.5) / r takes their place.
    """
    n = [0, *counts_of_counts]
    out = np.ones(CUTOFF + 2)
    spare = np.array([1.0] + [(r - 0.5) / r for r in range(1, CUTOFF + 1)] + [1.0])
    if min(n[1 : CUTOFF + 2]) <= 0:
        return spare
    common = (CUTOFF + 1) * n[CUTOFF + 1] / n[1]
    if common >= 1:
        return spare
    for r in range(1, CUTOFF + 1):
        out[r] = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
    return out if ((out > 0) & (out <= 1)).all() else spare


def _build(number: int, rows: list[dict]) -> dict:
    return B.token_block(number, rows) | {"held": B.pack(np.array([bool(r["held"]) for r in rows]))}


class Block:
    """A block's distinct n-grams by order, where its tokens find theirs, and all keys in one sorted array."""

    def __init__(self, row: dict, order: int):
        self.ids = row["ids"]
        self.lengths = B.unpack(row["lengths"], np.int64)
        self.held = B.unpack(row["held"], bool)
        keys = of_order(np.concatenate([[START, END], B.unpack(row["words"], np.uint64)]), 1)
        by_key = np.argsort(keys)
        place = np.empty(by_key.size, np.int64)
        place[by_key] = np.arange(by_key.size)
        words = keys[by_key]
        self.start = place[0]
        # Every text as its words and one end; the start comes before the first word.
        sizes = self.lengths + 1
        ends = np.cumsum(sizes) - 1
        starts = ends - self.lengths
        total = int(sizes.sum())
        # A block has far fewer than 2**31 tokens, hence of n-grams: places in 32 bits halve its memory.
        self.doc = np.repeat(np.arange(sizes.size, dtype=np.int32), sizes)
        inner = np.ones(total, bool)
        inner[ends] = False
        token = np.full(total, place[1], np.int32)
        token[inner] = place[B.unpack(row["tokens"], np.uint32).astype(np.int32) + 2]
        del inner

        #: By order: a token's n-gram (-1: its text has too few tokens before it); an n-gram without its last and without its first word; keys.
        self.at_token, self.left, self.suffix, by_order = [token], [None], [None], [words]
        nth = np.arange(total, dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)
        for k in range(2, order + 1):
            here = nth >= k - 2
            before = np.roll(self.at_token[-1], 1)
            if k == 2:
                before[starts] = self.start
            pairs = before[here].astype(np.int64)
            del before
            pairs *= words.size
            pairs += token[here]
            pairs, at = np.unique(pairs, return_inverse=True)
            at = at.astype(np.int32)
            left, word = np.divmod(pairs, words.size)
            suffix = np.empty(pairs.size, np.int32)
            suffix[at] = self.at_token[-1][here]
            grams = np.full(total, -1, np.int32)
            grams[here] = at
            by_order.append(of_order(B.follow(by_order[-1][left], words[word]), k))
            self.at_token.append(grams)
            self.left.append(left.astype(np.int32))
            self.suffix.append(suffix)
            del pairs, at, word, left, here
        del nth

        self.edges = np.cumsum([len(x) for x in by_order])[:-1]
        keys = np.concatenate(by_order)
        del by_order
        by_key = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[by_key]
        self.at = np.empty(by_key.size, np.int32)
        self.at[by_key] = np.arange(by_key.size, dtype=np.int32)

    @property
    def order(self) -> int:
        return len(self.left)

    def counts(self) -> np.ndarray:
        """Training occurrences of the n-grams (of the start: its texts), in order of the keys."""
        train = ~self.held[self.doc]
        out = [np.bincount(g[train & (g >= 0)], minlength=n.size) for g, n in zip(self.at_token, np.split(self.keys, self.edges))]
        out[0][self.start] = int((~self.held).sum())
        counts = np.empty(self.keys.size, np.int64)
        counts[self.at] = np.concatenate(out)
        return counts

    def by_order(self, values: np.ndarray) -> list[np.ndarray]:
        """Values in order of the keys as one array an order."""
        return np.split(values[self.at], self.edges)

    def contexts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of order k in sorted order, and which of the block's n-grams of that order they are."""
        mine = self.by_order(self.keys)[k - 1]
        by_key = np.argsort(mine, kind="stable")
        return mine[by_key], by_key


def statistics(order: int) -> tuple[str, ...]:
    """Counts of counts by order, training tokens and types."""
    return (*[f"n{k}_{r}" for k in range(1, order + 1) for r in range(1, CUTOFF + 2)], "tokens", "types")


def _totals(keys: np.ndarray, data: dict, order: int) -> tuple[dict, dict]:
    total, of = data["times"], keys & ORDER_BITS
    stats = {}
    for k in range(1, order + 1):
        mine = total[(of == k) & (keys != START)]
        stats |= {f"n{k}_{r}": int((mine == r).sum()) for r in range(1, CUTOFF + 2)}
        if k == 1:
            stats |= {"tokens": int(mine.sum()), "types": int((mine > 0).sum())}
    return {"totals": total, "owned": np.ones(total.size, bool)}, stats


def count_table(order: int) -> B.Sums:
    """Occurrences are added up; one of the blocks that hold an n-gram answers for it."""
    return B.Sums({"times": "i8"}, {"totals": "i8", "owned": "u1"}, partial(_totals, order=order), statistics(order), keeps=True, fan_bits=FAN_BITS)


def _weights(keys: np.ndarray, data: dict) -> tuple[dict, dict]:
    total, seen = data["total"], data["seen"]
    scale = np.where(seen > 1 - 1e-12, total / (total + 1.0), 1.0)
    return {"scale": scale, "weight": (1 - scale * seen) / np.maximum(1 - data["lower"], 1e-300)}, {}


#: s and a of a context from its count and the sums, over the n-grams after it, of their own and of their lower-order probabilities.
WEIGHTS = B.Sums({"seen": "f8", "lower": "f8", "total": "i8"}, {"scale": "f8", "weight": "f8"}, _weights, keeps=True, fan_bits=FAN_BITS)
#: Stored tables and what texts ask of them: absent numbers are zero.
LOOKUP = B.Sums({"totals": "i8", "scale": "f8", "weight": "f8"}, {"totals": "i8", "scale": "f8", "weight": "f8"}, lambda keys, data: (data, {}), fan_bits=FAN_BITS)


@dataclass(frozen=True)
class Numbers:
    """Discounts and the distribution of words: what does not depend on a key."""

    order: int
    tokens: int
    types: int
    discount: tuple[np.ndarray, ...]
    scale: float
    unknown: float

    @classmethod
    def of(cls, stats: dict, order: int) -> Numbers:
        stats = {k: v or 0 for k, v in stats.items()}
        n = [[stats[f"n{k}_{r}"] for r in range(1, CUTOFF + 2)] for k in range(1, order + 1)]
        found = tuple(discounts(x) for x in n)
        tokens = stats["tokens"]
        lost = sum((1 - found[0][r]) * r * n[0][r - 1] for r in range(1, CUTOFF + 1))
        # Counts above the cutoff only: a count of 1 in N + 1 is left for unknown words.
        scale, unknown = (1.0, lost / tokens) if lost > 0 else (tokens / (tokens + 1), 1 / (tokens + 1))
        return cls(order, tokens, stats["types"], found, scale, unknown)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(counts.size)
        known = self.scale * self.discount[0][np.minimum(counts, CUTOFF + 1)] * counts / self.tokens
        return np.where(counts > 0, known, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.types + 1))


class Answers:
    """A block with the training counts of its n-grams, and the recursion over orders."""

    def __init__(self, block: Block, totals: np.ndarray, numbers: Numbers):
        self.block, self.numbers = block, numbers
        self.totals = block.by_order(totals)
        self.unigram = numbers.unigram(self.totals[0])

    def discounted(self, k: int) -> np.ndarray:
        """d(c) c / c(context) of the block's n-grams of order k; 0 where not seen."""
        count = self.totals[k - 1]
        context = np.maximum(self.totals[k - 2][self.block.left[k - 1]], 1)
        return np.where(count > 0, self.numbers.discount[k - 1][np.minimum(count, CUTOFF + 1)] * count / context, 0.0)

    def probabilities(self, weights: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """P of the n-grams of orders 1, 2, ..., as far as s and a are given for the contexts of the next."""
        p = [self.unigram]
        for k, (scale, weight) in enumerate(weights, 2):
            left, suffix = self.block.left[k - 1], self.block.suffix[k - 1]
            p.append(np.where(self.totals[k - 1] > 0, scale[left] * self.discounted(k), weight[left] * p[-1][suffix]))
        return p

    def scores(self, p: list[np.ndarray], id_type: pa.DataType) -> pa.Table:
        """Each token by its longest context."""
        block, n = self.block, self.block.lengths.size
        log_p = np.log10(p[0])[block.at_token[0]]
        for k in range(2, len(p) + 1):
            grams = block.at_token[k - 1]
            here = grams >= 0
            log_p[here] = np.log10(p[k - 1])[grams[here]]
        sums = lambda x: np.bincount(block.doc, x, n)
        token, counts = block.at_token[0], self.totals[0]
        return pa.table({
            "id": pa.array(block.ids, id_type),
            "held_out": pa.array(block.held),
            "n_tokens": pa.array(block.lengths + 1),
            "n_known": pa.array(sums((counts > 0)[token]).astype(np.int64)),
            "train_tokens": pa.array(np.full(n, self.numbers.tokens, np.int64)),
            "base_score": pa.array(sums(self.numbers.base(counts)[token])),
            "score": pa.array(sums(log_p)),
        })


def _ask(batches: Iterator[pa.RecordBatch], table: B.Sums, order: int, count: bool) -> Iterator[pa.RecordBatch]:
    """Distinct n-grams of each block, with training counts where they are to be counted."""
    for batch in batches:
        for row in batch.to_pylist():
            block = Block(row, order)
            data = {"keys": block.keys} | {n: np.zeros(block.keys.size, t) for n, t in table.up.items()}
            if count:
                data["times"] = block.counts()
            yield from B.as_table(B.messages(table, row["block"], data), B.asked_fields(table)).to_batches()


def _answered(row: dict, replies: list[dict], numbers: Numbers, upto: int) -> tuple[Answers, np.ndarray, list]:
    """A block with its totals, which of its n-grams it answers for, and s and a for orders 2 to ``upto``."""
    block = Block(row, numbers.order)
    of = {k: [r for r in replies if r["level"] == k] for k in range(1, numbers.order + 1)}
    told = count_table(numbers.order).take(of[1])
    weights = []
    for k in range(2, upto + 1):
        found = WEIGHTS.take(of[k])
        by_key = block.contexts(k - 1)[1]
        both = np.empty((2, by_key.size))
        both[:, by_key] = found["scale"], found["weight"]
        weights.append((both[0], both[1]))
    return Answers(block, told["totals"], numbers), told["owned"] > 0, weights


def _sums(left: pa.Table, right: pa.Table, numbers: Numbers, k: int) -> pa.Table:
    """By context of order k - 1: mass and lower-order mass of the n-grams this block answers for."""
    (row,) = left.to_pylist()
    a, owned, weights = _answered(row, right.to_pylist(), numbers, k - 1)
    owned = a.block.by_order(owned)
    mine = (a.totals[k - 1] > 0) & owned[k - 1]
    keys, by_key = a.block.contexts(k - 1)
    context = a.block.left[k - 1][mine]
    lower = a.probabilities(weights)[k - 2][a.block.suffix[k - 1][mine]]
    data = {
        "keys": keys,
        "seen": np.bincount(context, a.discounted(k)[mine], keys.size)[by_key],
        "lower": np.bincount(context, lower, keys.size)[by_key],
        "total": np.where(owned[k - 2], a.totals[k - 2], 0)[by_key],
    }
    return B.as_table(B.messages(WEIGHTS, row["block"], data), B.asked_fields(WEIGHTS))


def _evaluate(left: pa.Table, right: pa.Table, numbers: Numbers) -> pa.Table:
    (row,) = left.to_pylist()
    a, _, weights = _answered(row, right.to_pylist(), numbers, numbers.order)
    return a.scores(a.probabilities(weights), left.schema.field("ids").type.value_type)


def _evaluate_stored(left: pa.Table, right: pa.Table, numbers: Numbers) -> pa.Table:
    (row,) = left.to_pylist()
    block = Block(row, numbers.order)
    told = LOOKUP.take(right.to_pylist())
    # A context that is not in the table was not seen.
    known = told["weight"] > 0
    scale, weight = block.by_order(np.where(known, told["scale"], 1.0)), block.by_order(np.where(known, told["weight"], 1.0))
    a = Answers(block, told["totals"], numbers)
    return a.scores(a.probabilities(list(zip(scale, weight))[: numbers.order - 1]), left.schema.field("ids").type.value_type)


@dataclass(frozen=True)
class Model:
    """``tables`` (level, part, keys, totals, scale, weight): one row a key range, packed; level 1 holds the counts of all
    orders, level k > 1 holds s and a of contexts of k - 1 words.  ``stats``: see ``statistics``."""

    order: int
    stats: dict
    tables: DataFrame

    @property
    def numbers(self) -> Numbers:
        return Numbers.of(self.stats, self.order)

    def save(self, path: str) -> None:
        self.tables.write.mode("overwrite").partitionBy("level").parquet(f"{path}/tables")
        stats = self.tables.sparkSession.createDataFrame([(self.order, {k: v or 0 for k, v in self.stats.items()})], "order int, stats map<string, long>")
        stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/numbers")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        numbers = spark.read.parquet(f"{path}/numbers").first()
        tables = spark.read.schema("part long, keys binary, totals binary, scale binary, weight binary, level int").parquet(f"{path}/tables")
        return cls(numbers["order"], numbers["stats"], tables)


def _blocks(work: Workspace, docs: DataFrame, held_out, text: str, id_col: str, block_tokens: int) -> DataFrame:
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text].alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    made = B.make_blocks(rows, "block long, tokens binary, words binary, lengths binary, held binary, ids array<long>", B.text_weight, block_tokens, _build)
    return work.put(made, "blocks")


def _learn(work: Workspace, blocks: DataFrame, order: int) -> tuple[Model, DataFrame]:
    """The model, and its replies to the blocks it was made of."""
    if not 2 <= order <= 7:
        raise ValueError("order must be 2 to 7")
    counts = count_table(order)
    count = blocks.select("block").count()
    asked = blocks.mapInArrow(partial(_ask, table=counts, order=order, count=True), B.asked_schema(counts))
    replies, stats, kept = B.exchange_and_keep(work, "counts", asked, count, counts)
    numbers = Numbers.of(stats, order)
    replies = replies.select("block", "part", F.lit(1).alias("level"), "totals", "owned")
    tables = kept.select(F.lit(1).alias("level"), "part", "keys", "totals")
    for k in range(2, order + 1):
        sums = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(partial(_sums, numbers=numbers, k=k), B.asked_schema(WEIGHTS))
        found, _, kept = B.exchange_and_keep(work, f"weights{k}", sums, count, WEIGHTS)
        level = F.lit(k).alias("level")
        replies = replies.unionByName(found.select("block", "part", level, "scale", "weight"), allowMissingColumns=True)
        tables = tables.unionByName(kept.select(level, "part", "keys", "scale", "weight"), allowMissingColumns=True)
    return Model(order, stats, tables), replies


def fit(docs: DataFrame, held_out=None, text: str = "text", id_col: str = "doc_id", order: int = 2, block_tokens: int = 2_000_000) -> Model:
    """A model of docs' texts, those left out where the boolean Column ``held_out`` is true.

    Its tables lie in the workspace and go with the application; ``Model.save`` keeps them.
    """
    work = Workspace(docs.sparkSession, "katz-model")
    blocks = _blocks(work, docs, F.lit(False) if held_out is None else held_out, text, id_col, block_tokens)
    return _learn(work, blocks, order)[0]


def score_with(model: Model, docs: DataFrame, text: str = "text", id_col: str = "doc_id", block_tokens: int = 2_000_000) -> DataFrame:
    """Rows as those of ``score`` for docs that teach nothing (``held_out`` is true), by a stored model.

    The model's ranges take part in the exchange as further blocks, so a text's
    n-grams meet their counts and weights by key range; nothing of the model is
    broadcast or collected.  Nulls, empties and clashing columns as in ``score``.
    """
    work = Workspace(docs.sparkSession, "katz-lookup")
    blocks = _blocks(work, docs, F.lit(True), text, id_col, block_tokens)
    asked = blocks.mapInArrow(partial(_ask, table=LOOKUP, order=model.order, count=False), B.asked_schema(LOOKUP))

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = {"keys": B.unpack_sorted(row["keys"], np.uint64)}
                data |= {n: B.unpack_sorted(row[n], t) if row[n] else np.zeros(data["keys"].size, t) for n, t in LOOKUP.up.items()}
                # Ranges are numbered below zero: blocks of text are not.
                number = -2 - (row["part"] * 8 + row["level"])
                yield from B.as_table(B.messages(LOOKUP, number, data), B.asked_fields(LOOKUP)).to_batches()

    tables = model.tables.select("level", "part", "keys", "totals", "scale", "weight")
    count = blocks.select("block").count() + model.tables.select("part").count()
    replies, _ = B.exchange(work, "lookup", asked.unionByName(tables.mapInArrow(stored, B.asked_schema(LOOKUP))), count, LOOKUP)
    numbers = model.numbers
    out = blocks.groupBy("block").cogroup(replies.where("block >= 0").groupBy("block")).applyInArrow(partial(_evaluate_stored, numbers=numbers), SCORES)
    return out.withColumnRenamed("id", id_col)


def score(docs: DataFrame, held_out, text: str = "text", id_col: str = "doc_id", order: int = 2, block_tokens: int = 2_000_000) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    ``held_out``: a boolean Column over docs; rows where it is true are scored but
    teach nothing (null: they teach).  Null and empty texts are one end token.
    Each row is a text of its own, repeated rows included; null ids are kept as
    null.  Equal counts are not ranked, so ties have no effect.  With no training
    text every token has probability 1 in ``score``.  Other columns, whatever
    their names, are not looked at.  An empty table gives an empty table.  Whole
    texts of any length are used, and every n-gram of the training texts, up to
    ``order`` words, is counted.
    """
    work = Workspace(docs.sparkSession, "katz")
    blocks = _blocks(work, docs, held_out, text, id_col, block_tokens)
    model, replies = _learn(work, blocks, order)
    out = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(partial(_evaluate, numbers=model.numbers), SCORES)
    return out.withColumnRenamed("id", id_col)
