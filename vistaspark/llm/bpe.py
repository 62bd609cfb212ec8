"""Byte pair encoding and decoding as streaming transducers.

Encoding: the merge list has a sufficient lookahead.  A merge changes the token
to its left only by taking a token that a later-ranked merge wanted, so a change
travels left along merges of rising rank, each wanting the token that the one
before has taken.  The longest such chain bounds how far right of a token the
text can still change it; tokens further than that from the end of what has been
read are stable and are emitted at once.  Memory is the lookahead plus one
token, whatever the length of the word.

Decoding: a state machine takes the packed ids in pieces of any size and holds an
unfinished id, or an unfinished UTF-8 sequence of the bytes that tokens stand
for, and no more.

A text goes through both piece by piece (about ``PIECE`` characters, cut at white
space), so beside the text itself memory does not depend on its length.
"""

from __future__ import annotations

import codecs
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vistaspark.llm.rows import with_columns_from_text

#: Characters of a text that are encoded at a time.
PIECE = 1 << 16


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeList:
    """The merges over token ids, and what follows from them."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]]):
        self.vocab = vocab
        #: left id * 2**20 + right id to rank; rank to the merged id.
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        pairs = []
        for left, right in merges:
            key = vocab[left] << 20 | vocab[right]
            if key not in self.ranks:
                self.ranks[key] = len(self.merged)
                self.merged.append(vocab[left + right])
                pairs.append((left, right))
        self.longest = max(map(len, vocab), default=1)
        self.lookahead = self._lookahead(pairs)
        #: Symbols that each id spans.
        self.width: dict[int, int] = {}
        for left, right in pairs:
            i, j = vocab[left], vocab[right]
            self.width[vocab[left + right]] = self.width.setdefault(i, 1) + self.width.setdefault(j, 1)

    def _lookahead(self, pairs: list[tuple[str, str]]) -> int:
        """Characters of the longest chain of merges of rising rank, each ending in the token the one before took first."""
        wanting: dict[str, int] = {}
        most = 0
        for left, right in reversed(pairs):
            reach = len(left) + wanting.get(left, 0)
            wanting[right] = max(wanting.get(right, 0), reach)
            most = max(most, reach)
        return most + self.longest

    def merge(self, ids: list[int]) -> list[int]:
        """All merges, lowest rank first, leftmost first."""
        rank, merged, none = self.ranks.get, self.merged, 1 << 60
        wanted = [rank(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while wanted:
            best = min(wanted)
            if best == none:
                break
            i = wanted.index(best)
            new = ids[i] = merged[best]
            del ids[i + 1], wanted[i]
            if i < len(wanted):
                wanted[i] = rank(new << 20 | ids[i + 1], none)
            if i:
                wanted[i - 1] = rank(ids[i - 1] << 20 | new, none)
        return ids

    def stream(self, symbols: Iterable[int]) -> Iterator[int]:
        """Tokens of one word, each as soon as it is stable; holds at most 4 lookaheads of symbols."""
        window = 4 * self.lookahead
        held: list[int] = []
        for s in symbols:
            held.append(s)
            if len(held) >= window:
                size, done = len(held), 0
                for token in self.merge(held[:]):
                    n = self.width.get(token, 1)
                    if done + n > size - self.lookahead:
                        break
                    yield token
                    done += n
                held = held[done:]
        yield from self.merge(held)


class Cache(dict):
    """Values met lately: two generations of bounded size.  Leaving values out changes speed only."""

    def __init__(self, make, size: int):
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 48:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


# What the vocabulary file's library knows of characters, where Python's unicodedata may say otherwise.
#: Letters and numbers of Unicode 16 and 17.
LATER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
LATER_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: (first, last, lower case of the first): upper-case letters of Unicode 16 and 17.
LATER_CASES = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
#: Marks later than Unicode 9, the version of its normalisation: to it they neither reorder nor compose.
LATER_MARKS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE),
    (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070),
    (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34),
    (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F),
    (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)


def _ranges(pairs: Iterable[tuple[int, int]]) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in pairs)


@lru_cache(maxsize=2)
def classes(end: int) -> tuple[str, str]:
    """Regular expression ranges of the letters and of the numbers below a code point."""
    out = []
    for kind, later in (("L", LATER_LETTERS), ("N", LATER_NUMBERS)):
        pairs, start = [(a, b) for a, b in later if b < end], None
        for c in range(end + 1):
            is_in = c < end and unicodedata.category(chr(c))[0] == kind
            if is_in and start is None:
                start = c
            elif not is_in and start is not None:
                pairs.append((start, c - 1))
                start = None
        out.append(_ranges(pairs))
    return out[0], out[1]


#: White space to the vocabulary file's patterns (Unicode White_Space), as ranges.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK = re.compile(f"[{SPACE}]")
#: Stretches between white space; str.split() is faster but splits at CONTROLS too, which are no White_Space.
STRETCH = re.compile(f"[^{SPACE}]+")
CONTROLS = re.compile("[\x1c-\x1f]")
ASTRAL = re.compile("[\U00010000-\U0010ffff]")
UNMOVED = re.compile(f"([{_ranges(LATER_MARKS)}])")
#: Lower case by single characters: a final sigma is a sigma like any other.
CASES = {0x3A3: 0x3C3} | {c: low + c - a for a, b, low in LATER_CASES for c in range(a, b + 1)}


def normalise(text: str) -> str:
    """NFC as of Unicode 9, in lower case."""
    if UNMOVED.search(text):
        text = "".join(unicodedata.normalize("NFC", x) for x in UNMOVED.split(text))
    else:
        text = unicodedata.normalize("NFC", text)
    return text.translate(CASES).lower()


def pieces_of(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut at white space."""
    at = 0
    while len(text) - at > size:
        cut = BLANK.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class WordBpe:
    """A vocabulary file with word ends: normalise, split into words, encode each word by the transducer."""

    def __init__(self, path: str, cache_size: int = 240_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.merges = MergeList(vocab, [m.split(" ") if isinstance(m, str) else m for m in model["merges"]])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        alphabet = byte_alphabet()
        self._bytes = {c: b for b, c in enumerate(alphabet)}
        self._inner = [vocab.get(c) for c in alphabet]
        self._final = [vocab.get(c + self.suffix) for c in alphabet]
        self.after_space = {i: (" " + t).encode() for i, t in self.names.items()}
        self.of_name = {i: bytes(self._bytes[c] for c in (t[: -len(self.suffix)] if self.ends(t) else t)) for i, t in self.names.items() if i not in self.special.values()}
        self._mark = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._ascii = re.compile(r"[a-z]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\x09-\x0d a-z0-9]+", re.ASCII)
        self._wide, self._basic = (
            re.compile(rf"[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d|[{numbers}]|[^{SPACE}{letters}{numbers}]+")
            for letters, numbers in (classes(0x110000), classes(0x10000))
        )
        #: Packed ids by word, and by stretch between blanks (before normalisation).
        self._of_word = Cache(self._word, cache_size // 4)
        self._of_stretch = Cache(self._stretch, cache_size)

    def ends(self, name: str) -> bool:
        """Whether a token ends a word."""
        return bool(self.suffix) and name.endswith(self.suffix) and name not in self.special

    def words(self, text: str) -> list[str]:
        """Words of a stretch without special tokens."""
        if text.isascii():
            return self._ascii.findall(text.lower())
        text = normalise(text)
        return (self._wide if ASTRAL.search(text) else self._basic).findall(text)

    def tokens(self, word: str) -> Iterator[int]:
        raw = word.encode("utf-8", "surrogatepass")

        def symbols() -> Iterator[int]:
            for b in raw[:-1]:
                if self._inner[b] is not None:
                    yield self._inner[b]
            if self._final[raw[-1]] is not None:
                yield self._final[raw[-1]]

        return self.merges.stream(symbols())

    @staticmethod
    def _pack(ids: Iterable[int]) -> bytes:
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _word(self, word: str) -> bytes:
        return self._pack(self.tokens(word))

    def _stretch(self, text: str) -> bytes:
        """A stretch of text between white space."""
        found: list[bytes] = []
        of, at = self._of_word, 0
        for m in self._mark.finditer(text) if self._mark and "<|" in text else ():
            found += [of[w] for w in self.words(text[at : m.start()])]
            found.append(self._pack([self.special[m[0]]]))
            at = m.end()
        found += [of[w] for w in self.words(text[at:] if at else text)]
        return found[0] if len(found) == 1 else b"".join(found)

    def packed(self, text: str | None) -> Iterator[bytes]:
        """The whole text's ids, little-endian in 32 bits, piece by piece.

        Neither normalisation nor a word reaches across white space, so stretches
        between white space are encoded on their own.
        """
        of = self._of_stretch
        for piece in pieces_of(text or ""):
            yield b"".join([of[w] for w in (STRETCH.findall(piece) if CONTROLS.search(piece) else piece.split())])

    def encode(self, text: str | None) -> list[int]:
        ids = b"".join(self.packed(text))
        return [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)]

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Readable text, token by token."""
        state = Decoder(self)
        for i in ids:
            yield state.feed(self._pack([i]))
        yield state.end()


class Decoder:
    """Packed ids, fed in pieces cut anywhere, to text: a word end gives a space, bytes that are no UTF-8 the replacement character.

    ``names``: token names joined by spaces instead, as the vocabulary file asks
    for (it names no decoder).  Ids outside the vocabulary are left out.
    """

    def __init__(self, bpe: WordBpe, names: bool = False):
        self.bpe, self.names = bpe, names
        self.rest, self.begun = b"", False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def _ids(self, data: bytes) -> array:
        data = self.rest + data if self.rest else data
        whole = len(data) & ~3
        self.rest = data[whole:]
        out = array("I")
        out.frombytes(data[:whole])
        if sys.byteorder == "big":
            out.byteswap()
        return out

    def feed(self, data: bytes) -> str | bytes:
        """Text; with ``names`` its UTF-8 bytes."""
        ids = self._ids(data)
        if self.names:
            out = b"".join([self.bpe.after_space.get(i, b"") for i in ids])
            if out and not self.begun:
                self.begun, out = True, out[1:]
            return out
        out = []
        for i in ids:
            raw = self.bpe.of_name.get(i)
            if raw is not None:
                ends = self.bpe.ends(self.bpe.names[i])
                out.append(self.utf8.decode(raw, ends) + (" " if ends else ""))
            elif i in self.bpe.names:
                out.append(self.utf8.decode(b"", True) + self.bpe.names[i])
        return "".join(out)

    def end(self) -> str | bytes:
        return b"" if self.names else self.utf8.decode(b"", True)


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """The vocabulary, once a Python worker."""
    return WordBpe(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bpe_round_trip(docs: DataFrame, text: str = "text", vocabulary: str | None = None, keep_ids: bool = True) -> DataFrame:
    """docs with ``token_count``, ``ids_sha256``, ``decoded_sha256``, and ``token_ids`` unless told otherwise.

    The hashes are of the ids as little-endian unsigned 32-bit integers, as they
    come out of the encoder, and of what the decoder makes of them (token names
    joined by spaces, since the vocabulary file names no decoder).  Null text counts as empty: no tokens.  Texts
    of any length are encoded whole.  Rows stand alone; an empty table gives an
    empty table; input columns named like a new one give way.  ``vocabulary``: a
    path that exists on every executor; None: the installed package's file.
    """
    fields: list[tuple[str, T.DataType]] = [("token_count", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    if keep_ids:
        fields.append(("token_ids", T.ArrayType(T.IntegerType())))

    def start():
        from hashlib import sha256

        import numpy as np

        bpe = load(vocabulary or default_vocabulary())

        def of(x: str | None) -> tuple:
            state, count, of_ids, of_text, held = Decoder(bpe, names=True), 0, sha256(), sha256(), []
            for ids in bpe.packed(x):
                count += len(ids) // 4
                of_ids.update(ids)
                of_text.update(state.feed(ids))
                if keep_ids:
                    held.append(ids)
            of_text.update(state.end())
            out = (count, of_ids.hexdigest(), of_text.hexdigest())
            return (*out, np.frombuffer(b"".join(held), "<u4").astype(np.int32)) if keep_ids else out

        return of

    return with_columns_from_text(docs, text, fields, start)
