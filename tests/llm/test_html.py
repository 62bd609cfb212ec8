"""Main text: hosts of every size against brute force over all substrings, and what repetition alone decides."""

import collections
import random

import numpy as np
import pytest

from vistaspark.llm import html_extract as H


def brute(pages, settings):
    """Texts of one host's pages: every window of tokens looked up in a table of all pages."""
    parsed = [[b for b in H.blocks_of(p) if b[1] != H.OUT] for p in pages]
    tokens = [[w for text, _ in b for w in text.split(" ")] for b in parsed]
    n = settings.min_tokens
    windows = lambda t: [tuple(t[i : i + n]) for i in range(len(t) - n + 1)]
    distinct = {tuple(t) for t in tokens}
    on = collections.Counter(w for t in distinct for w in set(windows(t)))
    out = []
    for blocks, t in zip(parsed, tokens):
        cover = {}
        for share in (settings.open_share, settings.main_share):
            cover[share] = [False] * len(t)
            for i, w in enumerate(windows(t)):
                if on[w] - settings.chance >= share * len(distinct):
                    cover[share][i : i + n] = [True] * n
        main = any(r == H.MAIN for _, r in blocks)
        spans, at = [], 0
        for text, region in blocks:
            spans.append((at, at + len(text.split(" ")), region))
            at = spans[-1][1]
        body = [x for a, b, r in spans if r == (H.MAIN if main else H.OPEN) for x in cover[settings.main_share][a:b]]
        copy = sum(body) >= settings.copy_share * max(1, len(body))
        lines = []
        for a, b, region in spans:
            if region == H.OUT:
                continue
            gone = cover[settings.main_share if region == H.MAIN else settings.open_share][a:b]
            if copy and (region == H.MAIN or not main):
                gone = [False] * (b - a)
            if not all(gone):
                i = 0
                while i < len(gone):
                    j = i
                    while j < len(gone) and gone[j]:
                        j += 1
                    if 0 < j - i < n:
                        gone[i:j] = [False] * (j - i)
                    i = max(j, i + 1)
            kept = [w for w, g in zip(t[a:b], gone) if not g]
            if kept:
                lines.append(" ".join(kept))
        out.append("\n".join(lines))
    return out


def site(r, n):
    word = lambda: "".join(r.choice("abcdefg") for _ in range(3))
    prose = lambda k: " ".join(word() for _ in range(k))
    menu, notice, article = prose(12), prose(20), prose(60)
    pages: list = []
    for k in range(n):
        kind = r.random()
        body = article if kind < 0.3 else prose(r.randint(0, 60)) + (" " + notice if kind < 0.7 else "")
        parts = [f"<div>{menu}</div>" if r.random() < 0.9 else "", f"<p>{body}</p><p>{prose(5)}"]
        if r.random() < 0.5:
            parts[1] = f"<article><p>{notice if r.random() < 0.8 else word()}</p>{parts[1]}</article><div>{prose(r.choice([3, 40]))}</div>"
        pages.append("".join(parts) + "<footer>f</footer>")
        if r.random() < 0.2:
            pages.append(r.choice(pages))
    return pages + r.sample([None, "", "<p>Not Found</p>"], min(3, n // 2))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 40])
def test_hosts_of_every_size(n):
    for seed in range(4):
        pages = site(random.Random(100 * n + seed), n)
        assert H.main_texts(pages) == brute(pages, H.Settings())
    for pages in (["<p>Not Found</p>"] * n, ["x"] * n, [""] * n, [None] * n, ["<p>a</p>"] + [None] * n, [""] * n + ["x"]):
        assert H.main_texts(pages) == brute(pages, H.Settings())


def test_table_equals_brute_force_however_hosts_are_split(spark):
    r, rows, want = random.Random(9), [], []
    for host, n in (("a.org", 60), ("b.org", 7), ("c.org", 1), (None, 3)):
        pages = site(r, n)
        for page, text in zip(pages, brute(pages, H.Settings())):
            want.append((len(rows), text))
            rows.append((len(rows), host and f"https://{host}/{len(rows)}", page, "old", "x", "y"))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, main_text string, part string, groups string").repartition(3)
    for settings in (H.Settings(), H.Settings(group_pages=6), H.Settings(group_tokens=300)):
        out = H.extract_main_text(frame, settings=settings)
        assert out.columns == ["page_id", "url", "part", "groups", "main_text", "main_chars"]
        assert sorted((x.page_id, x.main_text) for x in out.collect()) == want


def test_repetition_decides_inside_articles_and_copies_stay(monkeypatch):
    word = lambda k, j: f"w{k}x{j}"
    menu = "Home News Sport Weather Travel Culture Business Opinion Video"
    pages = [f"<article><p>{menu}</p><p>" + " ".join(word(k, j) for j in range(40)) + "</p></article>" for k in range(12)]
    licence = "This text may be shared by anyone under the terms of the public licence"
    pages[3] = pages[3].replace("</article>", f"<p>{licence}</p></article>")
    pages[8] = pages[8].replace("</article>", f"<p>{licence}</p></article>")
    texts = H.main_texts(pages)
    assert not any(menu in t for t in texts) and texts[3].endswith(licence) and texts[8].endswith(licence)
    copies = [p.replace("w1x", "w0x").replace("</article>", f"<p>{k}</p></article>") for k, p in enumerate([pages[0]] * 9)]
    assert all("w0x39" in t for t in H.main_texts(copies + pages[1:4])[:9])
    monkeypatch.setattr(H, "repeated_runs", lambda streams, depth: (lambda o, p, e: (o, np.zeros_like(p), e))(*_real(streams, depth)))
    assert all(menu in t for t in H.main_texts(pages))


_real = H.repeated_runs


def test_names_and_open_paragraphs():
    one = lambda page: H.main_texts([page])[0]
    for page in ('<article class="post no-sidebar"><p>Text</p></article>', '<body class="single has-comments"><p>Text</p></body>', '<main class="search-results"><p>Text</p></main>', '<article><div id="related-work"><p>Text</p></div></article>'):
        assert one(page) == "Text"
    assert one('<article><p class="promo">Buy<p>Real text</p><p>More</p></article>') == "Real text\nMore"
    assert one('<article><p>T</p><ul><li class="ad">x<li>y</ul><div class="cookie-banner">c</div><ol class="comment-list"><li>no</ol><div class="widget site-footer">f</div></article>') == "T\ny"
    long = " ".join(f"u{k}" for k in range(30))
    assert one(f"<div>short</div><article><p>T</p></article><div>{long}</div>") == f"short\nT\n{long}"


def test_long_page():
    text = " ".join(f"t{k % 977}" for k in range(200_000))
    assert H.main_texts([f"<p>{text}</p>", "<p>other</p>"]) == [text, "other"]


def test_parsing_takes_linear_time():
    import time

    def took(page):
        began = time.perf_counter()
        H.blocks_of(page)
        return time.perf_counter() - began

    for unit in ("<a ", "<a x='", '<a b="', "<!", "</b", "<div>", "<div></b>", "<p x=\"y' >", "<script>", "<!--", "&amp;<", "<li>", "<form><p>w", '<a "x <a ', "<p title=it's>"):
        pages = [unit * (n // len(unit)) for n in (250_000, 1_000_000)]
        few, many = took(pages[0]), took(pages[1])
        assert many < 12 and many < 10 * few + 0.5, (unit, few, many)
    assert took("<div>" * 100_000 + "</b>" * 100_000) < 10


def test_tags_that_never_close_are_text_and_quotes_need_an_equals_sign():
    text = lambda page: [t for t, _ in H.blocks_of(page)]
    assert text("<p>a <b c</p> d <i") == ["a d <i"]
    assert text("1 < 2 <3 </ <p title=it's>x</p><p title='a>b'>y</p>") == ["1 < 2 <3 </", "x", "y"]
    assert text('<p>a</p><a href="open <p>b</p>') == ["a", "b"]
    assert text("<p>a<!-- x") == ["a"] and text("<script>x") == [] and text("a<!b") == ["a<!b"] and text("<!doctype html>a") == ["a"]


def test_forms_titles_and_articles_named_like_comments():
    one = lambda page: H.main_texts([page])[0]
    assert one("<body><form action='x'><h1>T</h1><article><p>story</p><form>no</form></article></form></body>") == "T\nstory\nno"
    assert one("<article><form><p>T</p></form></article>") == "T"
    assert one("<article><p>a long enough story of words</p><form><p>send us</p></form></article>") == "a long enough story of words"
    assert one("<h1>Title</h1><article><p>body</p></article><p>short end</p>") == "Title\nbody\nshort end"
    assert one('<article class="comments"><p>T</p></article>') == "T"
    assert one('<article><p>T</p></article><article class="comment"><p>reader</p></article>') == "T"
