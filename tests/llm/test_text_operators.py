"""Operators over documents against brute force, on a corpus of awkward rows."""

import collections
import hashlib
import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from vistaspark.llm import blocks as B
from vistaspark.llm import bpe, jaccard, katz, langid, line_dedup, mixing, quality, suffix_dedup

BLANKS = " \t\n\x0b\x0c\r"
sha = lambda b: hashlib.sha256(b).hexdigest()
low = lambda t: t.encode().lower().decode()


def bag(rows):
    return collections.Counter(rows)


def test_line_dedup(docs, rows, empty):
    distinct = {(r[0], r[1]) for r in rows}
    key = lambda line: low(line.strip(BLANKS))
    seen = collections.Counter(k for _, t in distinct for k in {key(x) for x in (t or "").split("\n")} if k)
    want = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not key(x) or seen[key(x)] < 10]
        want.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    out = line_dedup.drop_shared_lines(docs, batches=3, fanout=2)
    assert set(docs.columns) <= set(out.columns)
    got = bag(tuple(r) for r in out.select("doc_id", "line_count", "line_dropped", "line_kept").collect())
    assert got == bag(want) and any(w[2] for w in want)
    assert line_dedup.drop_shared_lines(empty).count() == 0


def test_suffix_dedup(docs, rows, empty):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    seen, want = set(), []
    for k in order:
        b = (rows[k][1] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            s = b[i : i + 100]
            if s in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((rows[k][0], len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), sha(kept)))
    out = suffix_dedup.remove_repeats(docs, block_bytes=900).collect()
    got = bag((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out)
    assert got == bag(want) and sum(w[2] for w in want) > 1000
    for r in out:
        assert sha(bytes(r.kept)) == r.kept_sha256 and sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2])) == r.n_removed
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_repeated_intervals_equal_all_substrings():
    import numpy as np

    rng = np.random.default_rng(4)
    parts = [rng.integers(0, 2, rng.integers(0, 80)).astype(np.uint8) for _ in range(40)]
    parts += [parts[3].copy(), np.zeros(50, np.uint8)]
    for length in (8, 20, 33):
        places, group = suffix_dedup.repeated_intervals(np.concatenate(parts), np.array([p.size for p in parts]), length)
        base = np.cumsum([0, *[p.size for p in parts]])
        want = collections.defaultdict(list)
        for p, at in zip(parts, base):
            for i in range(p.size - length + 1):
                want[p[i : i + length].tobytes()].append(int(at + i))
        got = collections.defaultdict(list)
        for p, g in zip(places.tolist(), group.tolist()):
            got[g].append(p)
        assert sorted(map(sorted, got.values())) == sorted(v for v in want.values() if len(v) > 1)


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            o = len(a & sets[j])
            if o and 100 * o >= 80 * (len(a) + len(sets[j]) - o):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def check_jaccard(spark, frame, rows, **kw):
    sets = [shingles(r[1]) for r in rows]
    comp = components(sets)
    least = {}
    for r, c in zip(rows, comp):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = bag((r[0], len(s), least.get(c)) for r, s, c in zip(rows, sets, comp))
    out = jaccard.near_duplicates(frame, **kw).collect()
    assert bag((r.doc_id, r.n_shingles, r.component_id) for r in out) == want
    assert sum(r.keeper for r in out) == len(set(comp))
    return want


def test_jaccard(spark, docs, rows, empty):
    check_jaccard(spark, docs, rows, block_tokens=600, chunk=4)
    assert jaccard.near_duplicates(empty).count() == 0


def test_jaccard_small_sets_and_chains(spark):
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(words[i : i + n]) for n in (5, 6, 7, 8, 9, 10, 12, 14, 18, 30) for i in range(0, 9)]
    rows = [(k, t) for k, t in enumerate(texts)]
    check_jaccard(spark, spark.createDataFrame(rows, "doc_id long, text string"), rows, block_tokens=40, chunk=8)


def test_overlaps_by_both_ways():
    import numpy as np

    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(90)] + [np.zeros(0, np.uint64)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    got = jaccard.overlaps(sets, dense_cells=500)
    assert all(got[i, j] == want[i][j] for i in range(91) for j in range(91) if i != j)


def katz_brute(rows, held):
    train, start = [], 0
    for r, h in zip(rows, held):
        if not h:
            train.append((r[1] or "").encode().lower().split() + [None])
            start += 1
    uni = collections.Counter(w for t in train for w in t)
    bi = collections.Counter((a, b) for t in train for a, b in zip(["<s>", *t], t))
    n = sum(uni.values())
    coc = lambda c: [sum(v == r for v in c.values()) for r in range(1, 7)]
    du, db = katz.discounts(coc(uni)), katz.discounts(coc(bi))
    lost = sum((1 - du[min(c, 6)]) * c for c in uni.values())
    pu = {w: (1.0 if lost > 0 else n / (n + 1)) * du[min(c, 6)] * c / n for w, c in uni.items()}
    unk = lost / n if lost > 0 else 1 / (n + 1)
    context = collections.Counter(uni)
    context["<s>"] = start
    seen, lower = collections.Counter(), collections.Counter()
    for (a, b), c in bi.items():
        seen[a] += db[min(c, 6)] * c / context[a]
        lower[a] += pu[b]

    def p(a, b):
        scale = context[a] / (context[a] + 1) if seen[a] > 1 - 1e-12 else 1.0
        if (a, b) in bi:
            return scale * db[min(bi[a, b], 6)] * bi[a, b] / context[a]
        return (1 - scale * seen[a]) / (1 - lower[a]) * pu.get(b, unk)

    return uni, n, p, pu, unk


def test_katz(docs, rows, empty):
    held = [r[0] is not None and (r[0] // 3) % 5 == 2 for r in rows]
    uni, n, p, pu, unk = katz_brute(rows, held)
    want = []
    for r, h in zip(rows, held):
        t = (r[1] or "").encode().lower().split() + [None]
        base = sum(math.log10((uni[w] + 1) / (n + len(uni) + 1)) for w in t)
        want.append((r[0], h, len(t), sum(uni[w] > 0 for w in t), n, round(base, 5), round(sum(math.log10(p(a, b)) for a, b in zip(["<s>", *t], t)), 5)))
    out = katz.score(docs, (F.col("doc_id") / 3).cast("long") % 5 == 2, block_tokens=600).collect()
    assert bag((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in out) == bag(want)
    # Exactly normalised: over all known types and the unknown one, for every kind of context.
    for a in ["<s>", *list(uni)[:40], b"never seen"]:
        if a is not None:
            assert sum(p(a, b) for b in uni) + p(a, b"\0unknown") == pytest.approx(1.0, abs=1e-9)
    assert sum(pu.values()) + unk == pytest.approx(1.0)
    assert katz.score(empty, F.lit(False)).count() == 0
    only_held = katz.score(docs.limit(5), F.lit(True)).collect()
    assert all(r.train_tokens == 0 for r in only_held)


def katz_recursion(rows, held, order):
    """log10 probability of a text, and P of a word after a context, straight from the formula, by tuples of words."""
    texts = [["<s>", *(r[1] or "").encode().lower().split(), None] for r in rows]
    train = [t for t, h in zip(texts, held) if not h]
    count = [None, *[collections.Counter(tuple(t[i : i + k]) for t in train for i in range(len(t) - k + 1)) for k in range(1, order + 1)]]
    starts = count[1].pop(("<s>",), 0)
    factors = [None, *[katz.discounts([sum(v == r for v in count[k].values()) for r in range(1, 7)]) for k in range(1, order + 1)]]
    d = lambda k, c: factors[k][min(c, 6)] * c
    n = sum(count[1].values())
    lost = sum((1 - factors[1][min(c, 6)]) * c for c in count[1].values())
    seen, lower = collections.Counter(), collections.Counter()
    times = lambda h: starts if h == ("<s>",) else count[len(h)][h]

    def p(context, w):
        k = len(context) + 1
        if k == 1:
            c = count[1][w,]
            return (d(1, c) / n * (1.0 if lost > 0 else n / (n + 1))) if c else (lost / n if lost > 0 else 1 / (n + 1))
        if not times(context):
            return p(context[1:], w)
        scale = times(context) / (times(context) + 1) if seen[context] > 1 - 1e-12 else 1.0
        c = count[k][*context, w]
        return scale * d(k, c) / times(context) if c else (1 - scale * seen[context]) / (1 - lower[context]) * p(context[1:], w)

    for k in range(2, order + 1):
        for g, c in count[k].items():
            seen[g[:-1]] += d(k, c) / times(g[:-1])
            lower[g[:-1]] += p(g[1:-1], g[-1])
    return texts, p, count


@pytest.mark.parametrize("order", [2, 3, 5])
def test_katz_orders_and_stored_model(spark, docs, rows, tmp_path, order):
    held_col, held = (F.col("doc_id") / 3).cast("long") % 5 == 2, [r[0] is not None and (r[0] // 3) % 5 == 2 for r in rows]
    texts, p, count = katz_recursion(rows, held, order)
    want = [(r[0], round(sum(math.log10(p(tuple(t[max(0, i - order + 1) : i]), t[i])) for i in range(1, len(t))), 4)) for r, t in zip(rows, texts)]
    scored = katz.score(docs, held_col, order=order, block_tokens=600).collect()
    assert bag((r.doc_id, round(r.score, 4)) for r in scored) == bag(want)
    kinds = [w for (w,) in count[1]] + [b"\0unknown"]
    for context in [*list(count[order - 1])[:15], *[(b"never", b"seen", b"in", b"it")[: order - 1]]]:
        if None not in context:
            assert sum(p(context, w) for w in kinds) == pytest.approx(1.0, abs=1e-9)

    katz.fit(docs, held_col, order=order, block_tokens=600).save(str(tmp_path / "model"))
    model = katz.Model.load(spark, str(tmp_path / "model"))
    stored = model.tables.where("level = 1").select("keys", "totals").collect()
    keys, totals = ([x for r in stored for x in B.unpack_sorted(r[c], t).tolist()] for c, t in (("keys", "u8"), ("totals", "i8")))
    assert len(set(keys)) == len(keys) and sorted(t for t in totals if t) == sorted([sum(not h for h in held), *[c for k in range(1, order + 1) for c in count[k].values()]])
    # Blocks of another size, and texts in another order, find the same numbers.
    again = katz.score_with(model, docs.repartition(2).select("text", "doc_id", "source"), block_tokens=2_000).collect()
    assert bag((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in again) == bag(
        (r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in scored)
    assert katz.score_with(model, docs.limit(0)).count() == 0


def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_padding()
    t.no_truncation()
    return t


def test_bpe(docs, rows, empty):
    t = tokenizer()
    want = []
    for r in rows:
        e = t.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(e), sha(b"".join(i.to_bytes(4, "little") for i in e)), sha(t.decode(e, skip_special_tokens=False).encode()), tuple(e)))
    out = bpe.bpe_round_trip(docs).collect()
    assert bag((r.doc_id, r.token_count, r.ids_sha256, r.decoded_sha256, tuple(r.token_ids)) for r in out) == bag(want)
    assert bpe.bpe_round_trip(empty).count() == 0


def test_bpe_streams_long_words_and_decodes(rows):
    import random

    own, t, r = bpe.load(bpe.default_vocabulary()), tokenizer(), random.Random(2)
    for _ in range(25):
        word = "".join(r.choice("thearniosu") for _ in range(r.randint(1, 5000)))
        assert list(own.tokens(word)) == t.encode(word, add_special_tokens=False).ids
    text = "hello wörld ' s 日本"
    assert "".join(own.decode(own.encode(text))).strip() == unicodedata.normalize("NFC", text)
    assert len("".join(own.decode(own.encode("x" * 10_000)))) >= 10_000
    assert own.merges.lookahead < 1000


def test_quality(docs, rows, empty):
    import zstandard

    compress = zstandard.ZstdCompressor(level=3).compress
    out = quality.quality_rules(docs.drop("kept")).collect()
    texts = collections.defaultdict(list)
    for r in rows:
        texts[r[0]].append(r[1] or "")
    for r in out:
        text = texts[r.doc_id][0]
        words = [w for w in text.translate({ord(c): " " for c in BLANKS}).split(" ") if w]
        windows = collections.Counter(zip(words, words[1:], words[2:]))
        covered = {k + d for k, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for d in range(3)}
        lines, seen, dup = text.split("\n"), set(), 0
        for x in lines:
            if x.strip(BLANKS):
                dup += x in seen
                seen.add(x)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert r.zstd_ratio == pytest.approx(len(text.encode()) / len(compress(text.encode())) if text else 0)
        assert r.kept == (not r.base_failed and r.reject_reason is None)
    assert quality.quality_rules(empty).count() == 0
    assert quality.Bands().verdict(5000, 30.0) == "repetitive" and quality.Bands().verdict(5000, 1.01) == "incompressible" and quality.Bands().verdict(5000, 2.2) is None


def test_quality_bands_reject_junk_that_passes_the_base_rules():
    import random

    import pyarrow.parquet as pq
    import zstandard

    from tests.conftest import SF

    compress, bands, r = zstandard.ZstdCompressor(level=3).compress, quality.Bands(), random.Random(5)
    scan = lambda text: quality.scan(text, bands, compress)
    labels = {x["doc_id"]: x["quality"] for x in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    clean = [x["text"] for x in pq.read_table(f"{SF}/documents.parquet").to_pylist() if labels.get(x["doc_id"]) == 1 and not scan(x["text"])[5]]
    assert sum(scan(x)[6] for x in clean) >= 0.95 * len(clean) > 0
    english = "\n".join(dict.fromkeys(x["text"] for x in pq.read_table(f"{SF}/documents.parquet").to_pylist() if x["lang"] == "en" and x["text"] in set(clean)))
    words = english.split()
    prose = lambda lo, n: english.encode()[lo : lo + n].decode()
    tagged = lambda n: " ".join(r.choice(words) + r.choice(["###", "$$$", "%%%", "&&&", "***"]) for _ in range(n))
    noise = lambda n: " ".join("".join(chr(r.randint(33, 126)) for _ in range(8)) for _ in range(n))
    assert scan(prose(0, 9000))[6] and scan(prose(0, 9000))[9] is None
    # (text, reason): junk all through, in one chunk of many, in the last part chunk, and in a text of one chunk and a part.
    planted = [
        (tagged(400), "repetitive"), (tagged(2000), "repetitive"), (noise(100), "incompressible"), (noise(1000), "incompressible"),
        (prose(0, 8 * 4096) + tagged(900)[:4096] + prose(8 * 4096, 3 * 4096), "chunks"),
        (prose(0, 5 * 4096) + tagged(200), "chunks"), (prose(0, 4096) + tagged(90), "chunks"),
    ]
    for text, reason in planted:
        _, _, _, _, _, base_failed, kept, _, bad, found = scan(text)
        assert not base_failed and not kept and found == reason and (reason != "chunks" or bad == 1)


def test_language_id(spark, docs, empty):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    samples = langid.sample_languages(real.where(~held))
    out = langid.identify(real.where(held), samples).collect()
    assert sum(r.lang_pred == r.lang for r in out) >= 0.98 * len(out) and all(0 <= r.lang_score <= 1 for r in out)
    odd = {r.text: r for r in langid.identify(docs, samples).collect()}
    assert odd[None].lang_pred == odd[""].lang_pred == odd["\n\n"].lang_pred == "und" and odd["one"].lang_pred in samples
    assert langid.identify(empty, samples).count() == 0 and langid.sample_languages(empty) == {}
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}


def test_cross_parsing_is_greedy_longest_match():
    import random

    r = random.Random(5)
    sample = "".join(r.choice("abc ") for _ in range(400))
    parser = langid.Parser({"x": sample})
    squeezed = " ".join(sample.split(" ")) if "  " not in sample else __import__("re").sub(" +", " ", sample)
    for _ in range(20):
        text = __import__("re").sub(" +", " ", "".join(r.choice("abcd ") for _ in range(60)))
        phrases, at = 0, 0
        while at < len(text):
            n = 1
            while at + n < len(text) and text[at : at + n + 1] in squeezed:
                n += 1
            phrases, at = phrases + 1, at + n
        cost, _ = parser.costs([text])
        assert cost[0, 0] / parser.bits[0] == pytest.approx(phrases)


def test_mixing(docs, rows, empty):
    out = mixing.mix(docs).collect()
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len((r[1] or "").encode().split())
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    budget, target = 1.5 * sum(size.values()), {}
    free = set(names)
    while True:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * size[s] for s in over}
        free -= over
    taken = collections.Counter()
    for r in out:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source] and r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    largest = max(r.size for r in out)
    assert all(abs(taken[s] - target[s]) <= largest + 1 for s in names) and sum(taken.values()) <= budget
    again = mixing.mix(docs.repartition(5)).collect()
    assert bag((r.doc_id, r.source, r.taken) for r in again) == bag((r.doc_id, r.source, r.taken) for r in out)
    assert mixing.mix(empty).count() == 0
