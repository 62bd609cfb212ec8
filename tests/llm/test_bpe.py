"""Encoding and decoding against the tokenizers library, on every code point and on streams cut anywhere."""

import random
import unicodedata

import pytest

from tests.llm.test_text_operators import tokenizer
from vistaspark.llm import bpe


@pytest.fixture(scope="module")
def own():
    return bpe.load(bpe.default_vocabulary())


def test_every_code_point(own):
    t = tokenizer()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}1{chr(c)}{chr(c)}b" for c in points[k : k + 64]) for k in range(0, len(points), 64)]
    assert [own.encode(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_marks_in_any_order(own):
    t, r = tokenizer(), random.Random(1)
    marks = [c for c in range(0x110000) if unicodedata.combining(chr(c))] + [0x11930, 0x11935, 0x1100, 0x1161, 0x11A8]
    texts = ["".join(chr(r.choice(marks)) if r.random() < 0.6 else r.choice("aeiouAEÅΣ") for _ in range(12)) for _ in range(3000)]
    assert [own.encode(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_pieces_change_nothing(own, monkeypatch):
    r = random.Random(4)
    text = "".join(r.choice(["the ", "\n", "Ünï", "  ", "\x1d", "<|endoftext|>", "日本", "x" * 30, " "]) for _ in range(4000))
    whole = own.encode(text)
    monkeypatch.setattr(bpe.pieces_of, "__defaults__", (50,))
    assert len(list(own.packed(text))) > 100 and own.encode(text) == whole == tokenizer().encode(text, add_special_tokens=False).ids


def test_decoder_takes_ids_cut_anywhere(own):
    r = random.Random(3)
    text = "Grüße <|endoftext|> don't 日本 𝒳 naïve"
    data = b"".join(own.packed(text))
    for names in (True, False):
        want = bpe.Decoder(own, names)
        want = want.feed(data) + want.end()
        for _ in range(20):
            state, out, at = bpe.Decoder(own, names), [], 0
            while at < len(data):
                n = r.randint(1, 9)
                out.append(state.feed(data[at : at + n]))
                at += n
            out.append(state.end())
            assert type(want)().join(out) == want
        if names:
            assert want.decode() == tokenizer().decode(own.encode(text), skip_special_tokens=False)
        else:
            assert unicodedata.normalize("NFC", text).lower().replace(" ", "").replace("'", "") == want.replace(" ", "").replace("'", "")
