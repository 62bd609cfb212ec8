"""Language identification by cross-parsing.

A suffix automaton of labelled text per language gives, at every point of a
text, the longest stretch that also occurs in that language's sample.  The text
is parsed greedily into such stretches; phrases times log2(sample length) is
what the text would cost in that language, and the cheapest language wins.

Automata are held sparsely, as double arrays: a state's transitions lie at its base
plus the symbol, among those of other states.  Parsing runs over many stretches of
text at a time; a missing transition ends a phrase and goes on from the root.  A
long text's stretches first run from the root, then again from the state in which
the stretch before has ended, until nothing changes: what comes out is the parse of
the whole text.
"""

from __future__ import annotations

import itertools
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Symbol classes: white space, digits, marks (one blank), letters outside every sample.
BLANK, FOREIGN, FIRST = 0, 1, 2
UNKNOWN = "und"
#: Symbols of a stretch within which another way in has mostly met the first.
_HEAD = 48
#: Rounds in which stretches are parsed side by side; a text that needs more is parsed in order.
_ROUNDS = 6


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _lower(c: str) -> str:
    low = c.lower()
    return low if len(low) == 1 else c


class Parser:
    """Machines for the languages of ``samples`` ({language: text})."""

    def __init__(self, samples: dict[str, str], segment: int = 512):
        self.names = sorted(samples)
        self.segment = segment
        letters = _letters()
        alphabet = sorted({_lower(c) for x in samples.values() for c in set(x) if letters[ord(c)]})
        self.classes = np.where(letters, FOREIGN, BLANK).astype(np.int32)
        of = {c: FIRST + i for i, c in enumerate(alphabet)}
        for c in range(sys.maxunicode + 1) if alphabet else ():
            if letters[c] and (k := of.get(_lower(chr(c)))):
                self.classes[c] = k
        self.width = FIRST + len(alphabet)
        self.tables = []
        self.bits = []
        for name in self.names:
            symbols = self._squeeze(self._symbols(samples[name]))[0]
            self.tables.append(self._machine(symbols.tolist()))
            self.bits.append(np.log2(max(2, symbols.size)))

    def _symbols(self, text: str) -> np.ndarray:
        return self.classes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    @staticmethod
    def _squeeze(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without blanks that follow a blank; and which were kept."""
        keep = np.ones(symbols.size, bool)
        keep[1:] = (symbols[1:] != BLANK) | (symbols[:-1] != BLANK)
        return symbols[keep], keep

    def _machine(self, symbols: list[int]) -> tuple[np.ndarray, ...]:
        """Suffix automaton: each state's base, the owner and the target of each slot, and where each symbol leads from the root."""
        edges: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            cur = len(edges)
            edges.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in edges[p]:
                edges[p][c] = cur
                p = link[p]
            if p != -1:
                q = edges[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    twin = len(edges)
                    edges.append(dict(edges[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and edges[p].get(c) == q:
                        edges[p][c] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur
        begin = np.zeros(self.width, np.int32)
        for c, to in edges[0].items():
            begin[c] = to
        # The root's transitions are apart, so no slot is its own.
        base, slots = [0] * len(edges), 2 * sum(map(len, edges)) + self.width
        owner, target = [-1] * (slots + self.width), [0] * (slots + self.width)
        draw = np.random.default_rng(len(edges)).integers(0, slots, 4096).tolist()
        at = 0
        for state in sorted(range(1, len(edges)), key=lambda x: -len(edges[x])):
            out = edges[state]
            if not out:
                break
            while True:
                place = (draw[at & 4095] + at * 7919) % slots
                at += 1
                if all(owner[place + c] < 0 for c in out):
                    break
            base[state] = place
            for c, to in out.items():
                owner[place + c], target[place + c] = state, to
        return np.array(base, np.int32), np.array(owner, np.int32), np.array(target, np.int32), begin

    @staticmethod
    def _parse(machine: tuple[np.ndarray, ...], grid: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that begin in each column of symbols, entered in the given states, and the states at its end.

        ``size``: the columns' lengths, falling.
        """
        base, owner, target, begin = machine
        phrases, state = np.zeros(size.size, np.int32), state.copy()
        for row, n in zip(grid, np.searchsorted(-size, -np.arange(len(grid)))):
            if not n:
                break
            was, row = state[:n], row[:n]
            at = base[was] + row
            on = owner[at] == was
            phrases[:n] += ~on
            state[:n] = np.where(on, target[at], begin[row])
        return phrases, state

    @staticmethod
    def _in_order(machine, grid, size, texts, first_part, parts, column, entered, first_phrases, rest_phrases, left) -> None:
        """Parses texts stretch by stretch, changing phrases and states left; a stretch entered as before stands as it is."""
        base, owner, target, begin = machine
        for text in texts.tolist():
            state = 0
            for c in column[first_part[text] : first_part[text] + parts[text]].tolist():
                if state != entered[c]:
                    entered[c] = state
                    phrases = 0
                    for symbol in grid[: size[c], c].tolist():
                        at = base[state] + symbol
                        if owner[at] == state:
                            state = target[at]
                        else:
                            phrases += 1
                            state = begin[symbol]
                    first_phrases[c], rest_phrases[c], left[c] = phrases, 0, state
                state = left[c]

    def costs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per language (rows: texts) and whether a text has a letter."""
        lengths = np.array([len(x or "") for x in texts], np.int64)
        symbols = self._symbols("".join(x or "" for x in texts))
        owner = np.repeat(np.arange(len(texts)), lengths)
        has_letter = np.zeros(len(texts), bool)
        has_letter[owner[symbols != BLANK]] = True
        keep = np.ones(symbols.size, bool)
        keep[1:] = (symbols[1:] != BLANK) | (symbols[:-1] != BLANK) | (owner[1:] != owner[:-1])
        symbols, owner = symbols[keep], owner[keep]
        sizes = np.bincount(owner, minlength=len(texts))
        parts = -(-sizes // self.segment)
        first_part = np.cumsum(parts) - parts
        first = np.cumsum(sizes) - sizes
        within = np.arange(symbols.size) - first[owner]
        of_part = np.repeat(np.arange(len(texts)), parts)
        of_symbol = first_part[owner] + within // self.segment
        size = np.bincount(of_symbol, minlength=of_part.size)
        # Stretches in columns by falling length.
        order = np.argsort(-size, kind="stable")
        column = np.empty(order.size, np.int64)
        column[order] = np.arange(order.size)
        size = size[order]
        grid = np.zeros((self.segment, order.size), np.int32)
        grid[within % self.segment, column[of_symbol]] = symbols
        later = np.ones(of_part.size, bool)
        later[first_part[parts > 0]] = False
        follows, comes_after = column[later], column[np.flatnonzero(later) - 1]
        out = np.zeros((len(texts), len(self.names)))
        for k, (machine, bits) in enumerate(zip(self.tables, self.bits)):
            # Entered from elsewhere, a stretch mostly comes into the same state within a few symbols; then the rest stands.
            head, rest = grid[:_HEAD], grid[_HEAD:]
            left_over = np.maximum(size - _HEAD, 0)
            entered = np.zeros(order.size, np.int32)
            first_phrases, middle = self._parse(machine, head, np.minimum(size, _HEAD), entered)
            rest_phrases, left = self._parse(machine, rest, left_over, middle)
            for turn in itertools.count():
                before = np.zeros(order.size, np.int32)
                before[follows] = left[comes_after]
                todo = np.flatnonzero(before != entered)
                if not todo.size:
                    break
                if turn == _ROUNDS:
                    # Stretches that never come into the same state: what is left of these texts is parsed in order.
                    self._in_order(machine, grid, size, np.unique(of_part[order[todo]]), first_part, parts, column, entered, first_phrases, rest_phrases, left)
                    break
                entered = before
                first_phrases[todo], now = self._parse(machine, head[:, todo], np.minimum(size[todo], _HEAD), entered[todo])
                other = now != middle[todo]
                middle[todo] = now
                again = todo[other]
                rest_phrases[again], left[again] = self._parse(machine, rest[:, again], left_over[again], middle[again])
            phrases = first_phrases + rest_phrases
            out[:, k] = np.bincount(of_part[order], phrases, len(texts)) * bits
        return out, has_letter

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score): score is 1 - cheapest / second cheapest cost, 1 with one language, 0 when undecided."""
        if not self.names or not texts:
            return [(UNKNOWN, 0.0)] * len(texts)
        costs, has_letter = self.costs(texts)
        best = costs.argmin(axis=1)
        found = []
        for i, b in enumerate(best):
            if not has_letter[i]:
                found.append((UNKNOWN, 0.0))
                continue
            rest = np.delete(costs[i], b)
            score = 1.0 if not rest.size else 1.0 - costs[i, b] / rest.min() if rest.min() > 0 else 0.0
            found.append((self.names[b], float(min(1.0, max(0.0, score)))))
        return found


def sample_languages(labelled: DataFrame, text: str = "text", lang: str = "lang", docs_per_lang: int = 24, doc_chars: int = 4000) -> dict[str, str]:
    """Each language's sample: ``docs_per_lang`` of its distinct texts, those with the smallest hashes.

    Texts of at most ``doc_chars`` characters come first, longer ones where a
    language has too few of them; all are taken whole.  The sample is thus bounded by
    ``docs_per_lang`` rows a language, and copies of a text never keep others out.  Rows with null or
    empty text or null language teach nothing.  An empty table gives no sample.
    """
    usable = labelled.select(labelled[lang].alias("lang"), labelled[text].alias("text")).where(F.col("lang").isNotNull() & (F.length("text") > 0))
    usable = usable.withColumn("h", F.xxhash64(F.lit("sample"), "text")).withColumn("long", F.length("text") > doc_chars)
    order = Window.partitionBy("lang").orderBy("long", "h")
    chosen = (
        usable.select("lang", "long", "h").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= docs_per_lang)
        .select("lang", "h", "rank").collect()
    )
    if not chosen:
        return {}
    rank = {(r["lang"], r["h"]): r["rank"] for r in chosen}
    some = usable.where(F.col("h").isin(sorted({h for _, h in rank}))).select("lang", "h", "text")
    rows = {(r["lang"], r["h"]): r["text"] for r in some.groupBy("lang", "h").agg(F.min("text").alias("text")).collect()}
    out: dict[str, str] = {}
    for key in sorted(rank, key=lambda k: (k[0], rank[k])):
        out[key[0]] = f"{out[key[0]]} {rows[key]}" if key[0] in out else rows[key]
    return out


_PARSERS: dict[int, Parser] = {}


def _portions(batch: pa.RecordBatch, at: int, rows: int = 512, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in slices of bounded rows and bytes of text (a longer text is a slice of its own)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
    lo = held = 0
    for i, n in enumerate(sizes):
        if i > lo and (i - lo == rows or held + n > size):
            yield batch.slice(lo, i - lo)
            lo, held = i, 0
        held += n
    if sizes:
        yield batch.slice(lo)


def identify(docs: DataFrame, samples: dict[str, str], text: str = "text") -> DataFrame:
    """docs with ``lang_pred`` and ``lang_score``.

    Null texts and texts without a letter get ``und`` and 0; so does every text if
    there are no samples.  Equal costs: the language first in code point order.
    Texts of any length are parsed whole, as one; repeated rows get the same answer; an
    empty table gives an empty table; input columns named like a new one give way.
    """
    names = ["lang_pred", "lang_score"]
    docs = docs.select(*[docs[c] for c in docs.columns if c.lower() not in names])
    at = docs.columns.index(text)
    schema = T.StructType(list(docs.schema.fields) + [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    key = hash(tuple(sorted(samples.items())))
    shared = docs.sparkSession.sparkContext.broadcast(samples)  # bounded: languages * docs_per_lang texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _PARSERS.get(key)
        if parser is None:
            _PARSERS.clear()
            parser = _PARSERS[key] = Parser(shared.value)
        for batch in batches:
            for part in _portions(batch, at):
                found = parser.predict(part.column(at).to_pylist())
                cols = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*part.schema.names, *names])

    return docs.mapInArrow(run, schema)
