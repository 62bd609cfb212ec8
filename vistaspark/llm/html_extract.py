"""Main text of web pages.

Method: a suffix array per host.  The visible text of a host's distinct pages
becomes token streams, concatenated with separators; sorting their suffixes (by
prefix doubling, to the depth of the least length that counts) brings equal
substrings together.  A substring on a large enough share of the host's pages is
boilerplate; covered runs go, unique runs stay.

Hosts with many pages are split into groups of bounded size.  A substring on a
share s of a host's pages is on a share s of some group's pages at least, so the
groups' suffix arrays name all candidates; candidates of hosts with several
groups are then counted over all of them.  Results do not depend on the split.

Markup decides what repetition can't tell: elements declared as navigation,
footer, advert, form, comment or the like go even where their text is unique, and
inside an article a larger share is needed.  Length decides nothing.  Articles are also copied from page to page: equal
pages count once, and a page that is covered nearly whole is a copy, of which
nothing goes.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistaspark.llm import blocks as B
from vistaspark.sources.workspace import Workspace

#: Elements whose content is never the article's text.
DROPPED = frozenset("script style template noscript iframe svg math canvas object head title nav aside footer button select textarea option dialog menu".split())
#: Elements that break a line of text.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that nothing needs to close; they don't nest regions.
LOOSE = frozenset("p b i u em strong a span li dt dd tr td th tbody thead tfoot option small sub sup code font".split())
#: Names (class, id, role) of regions that are no part of the article: whole, or as the last part of a compound.
HINTS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert sidebar comment comments commentlist disqus replies respond menu nav navbar navigation topnav breadcrumb breadcrumbs footer masthead related share sharing social newsletter subscribe subscription signup login popup modal overlay widget pagination pager search skip toolbar complementary contentinfo".split())
#: Hints that count outside an article only.
OUTER_HINTS = frozenset("header banner top".split())
#: Last parts of compounds that say nothing themselves: the part before decides (comment-list).
HOLDERS = frozenset("area bar block body box container content form group holder inner item items link links list panel row section slot thread unit wrap wrapper".split())
#: First parts that turn a compound around (no-sidebar) or speak of the page (has-comments).
TURNS = frozenset("no non not without has have with is hide hidden show".split())
#: Elements that hold the article: compounds never condemn them, and the outermost ones nothing does.
HOLDING, OUTERMOST = frozenset("article main body html".split()), frozenset("main body html".split())
#: Start tags that end an open element of the same kind.
SIBLINGS = {name: frozenset(kind.split()) for kind in ("li", "dt dd", "td th", "tr", "option") for name in kind.split()}

#: Elements whose content is not parsed as markup; they end at their own end tag or the page's end.
RAW = frozenset("script style title textarea template noscript iframe svg".split())
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*+")
# A value's quotes begin right after "="; nothing is tried twice.
_REST = re.compile(r"(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+>")
_RAW_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Regions of a block.
OPEN, MAIN, OUT = 0, 1, 2


@dataclass(frozen=True)
class Settings:
    #: Tokens of a repeated substring, at least.
    min_tokens: int = 8
    #: Share of the host's distinct pages it must be on, besides ``chance`` pages: outside an article, and inside.
    open_share: float = 0.1
    main_share: float = 0.5
    chance: int = 2
    #: A page of whose text this share is covered is a copy.
    copy_share: float = 0.8
    #: Bounds of a group: distinct pages, and tokens unless a single page has more.
    group_pages: int = 4096
    group_tokens: int = 1_000_000


def _is_out(name: str, attributes: str, in_main: bool) -> bool:
    if not attributes.strip() or name in OUTERMOST:
        return False
    names: list[str] = []
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key in ("class", "id", "role"):
            names += value.split()
        elif key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    bare = re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes).lower().split()
    if "hidden" in bare:
        return True
    hints = HINTS if in_main else HINTS | OUTER_HINTS
    for whole in names:
        parts = [x for x in re.split(r"[_-]+", whole) if x]
        if whole in hints and name != "article":
            return True
        if len(parts) < 2 or name in HOLDING or parts[0] in TURNS:
            continue
        if parts[-1] in hints or parts[-1] in HOLDERS and parts[-2] in HINTS:
            return True
    return False


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, value, attributes) of a page in one pass: "text" and its characters, "start" and "end" and the element's name.

    Comments, declarations and raw elements give nothing.  Time is linear: a scan for
    a tag's end that fails ends at the page's end, and happens once; after that a tag
    ends at the next ">" whatever its quotes.
    """
    at, n, last, quotes = 0, len(page), page.rfind(">"), True
    begun = 0
    while True:
        lt = page.find("<", at)
        if lt < 0:
            break
        name = _NAME.match(page, lt + 2 if page.startswith("</", lt) else lt + 1)
        if name is None and not page.startswith(("<!", "<?"), lt) or name is not None and last < lt:
            at = lt + 1
            continue
        if name is None and not page.startswith("<!--", lt) and last < lt:
            at = lt + 1
            continue
        closing = page[lt + 1] == "/"
        if name is None:
            end = page.find("-->", lt + 4) if page.startswith("<!--", lt) else page.find(">", lt) - 2
            end = n if end < 0 and page.startswith("<!--", lt) else end + 3
        elif closing or not quotes:
            end = page.find(">", name.end()) + 1
        else:
            rest = _REST.match(page, name.end())
            if rest is None:
                quotes = False
                end = page.find(">", name.end()) + 1
            else:
                end = rest.end()
        if begun < lt:
            yield "text", page[begun:lt], ""
        if name is not None:
            kind = name[0].lower()
            if closing:
                yield "end", kind, ""
            elif kind in RAW:
                stop = _RAW_END[kind].search(page, end)
                end = n if stop is None else stop.end()
            else:
                yield "start", kind, page[name.end() : end - 1]
        begun = at = end
    if begun < n:
        yield "text", page[begun:], ""


@dataclass
class _Holder:
    """A form, or an article named like no article: what it holds decides at the page's end."""

    form: bool
    inside: bool = False


def blocks_of(page: str | None) -> list[tuple[str, int]]:
    """(text, region) of a page's blocks in order: references decoded, white space squeezed, no empty blocks.

    A form that holds an article or over half of the page's words wraps the page and
    says nothing; other forms go.  An article whose whole name is that of comments
    or the like goes only where the page has another one.
    """
    out: list[tuple[str, int, _Holder | None]] = []
    stack: list[tuple[str, int, _Holder | None]] = []
    opened: dict[str, int] = {}
    region, holder, held = OPEN, None, []

    def close() -> None:
        text = " ".join("".join(held).split())
        if text:
            out.append((text, region, holder))
        held.clear()

    def leave(at: int) -> None:
        nonlocal region, holder
        close()
        region, holder = stack[at][1:]
        for name, *_ in stack[at:]:
            opened[name] -= 1
        del stack[at:]

    for kind, name, attributes in tokens(page or ""):
        if kind == "text":
            held.append(entities.unescape(name))
        elif kind == "start":
            if name in BLOCKS:
                close()
                # An open paragraph ends at the next block, an item or cell at the next of its kind.
                while stack and (stack[-1][0] == "p" or stack[-1][0] in SIBLINGS.get(name, ())):
                    leave(len(stack) - 1)
            if name in VOID:
                continue
            ruled_out = bool(attributes) and _is_out(name, attributes, region == MAIN)
            if name in LOOSE and name not in DROPPED and not ruled_out or attributes.endswith("/"):
                continue
            close()
            stack.append((name, region, holder))
            opened[name] = opened.get(name, 0) + 1
            if holder is not None and name in ("article", "main"):
                holder.inside = True
            if region == OUT or name in DROPPED or name == "header" and region != MAIN or ruled_out:
                region = OUT
            elif name in ("article", "main"):
                region = MAIN
                if holder is None and name == "article" and _is_out("div", attributes, False):
                    holder = _Holder(False)
            elif name == "form" and holder is None:
                holder = _Holder(True)
        else:
            if name in BLOCKS:
                close()
            if opened.get(name):
                leave(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
    close()
    count = lambda found: sum(text.count(" ") + 1 for text, *_ in found)
    shown = [b for b in out if b[1] != OUT]
    whole, another = count(shown), any(r == MAIN and (h is None or h.form) for _, r, h in shown)
    words: dict[int, int] = {}
    for text, _, h in shown:
        if h is not None:
            words[id(h)] = words.get(id(h), 0) + text.count(" ") + 1

    def kept(h: _Holder | None) -> bool:
        if h is None:
            return True
        return h.inside or 2 * words.get(id(h), 0) > whole if h.form else not another

    return [(text, r if r == OUT or kept(h) else OUT) for text, r, h in out]


def window_hashes(stream: np.ndarray, depth: int) -> np.ndarray:
    """Keys of the ``depth`` tokens from each place on where they are whole."""
    size = max(0, stream.size - depth + 1)
    h = stream[:size].copy()
    for k in range(1, depth):
        h = B.follow(h, stream[k : k + size])
    return h


def repeated_runs(streams: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the concatenated streams: each position's stream, and the number of streams that hold the ``depth`` tokens
    from there (0 where a separator or the end comes first); and where each stream's separator is."""
    lengths = np.array([s.size for s in streams], np.int64)
    owner = np.repeat(np.arange(len(streams)), lengths + 1)
    n = owner.size
    ends = np.cumsum(lengths + 1) - 1
    within = np.ones(n, bool)
    within[ends] = False
    # A separator equals nothing else.
    text = np.empty(n, np.int64)
    if lengths.sum():
        text[within] = np.unique(np.concatenate(streams), return_inverse=True)[1] + len(streams)
    text[ends] = np.arange(len(streams))
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    have = 1
    while have < depth:
        step = min(have, depth - have, n)
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        have += min(have, depth - have)
    order = np.argsort(rank, kind="stable")
    sorted_rank, sorted_owner = rank[order], owner[order]
    new_group = np.ones(n, bool)
    new_group[1:] = sorted_rank[1:] != sorted_rank[:-1]
    new_page = new_group.copy()
    new_page[1:] |= sorted_owner[1:] != sorted_owner[:-1]
    group = np.cumsum(new_group) - 1
    pages = np.zeros(n, np.int64)
    if n:
        pages[order] = np.bincount(group, new_page)[group].astype(np.int64)
    # Substrings that run into a separator are unique already; those that run off the end don't count.
    left = ends[owner] - np.arange(n)
    pages[left < depth] = 0
    return owner, pages, ends


def candidates(streams: list[np.ndarray], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the windows on the least share of a group's distinct pages, by the group's suffix array, and their numbers of pages."""
    owner, pages, ends = repeated_runs(streams, settings.min_tokens)
    enough = pages >= max(1, settings.open_share * len(streams))
    begins = ends - np.array([s.size for s in streams], np.int64)
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for stream, lo in zip(streams, begins):
        own = window_hashes(stream, settings.min_tokens)
        hit = enough[lo : lo + own.size]
        keys.append(own[hit])
        counts.append(pages[lo : lo + own.size][hit])
    distinct, first = np.unique(np.concatenate(keys), return_index=True)
    return distinct, np.concatenate(counts)[first]


def count_pages(streams: list[np.ndarray], wanted: np.ndarray, depth: int) -> np.ndarray:
    """On how many of the streams each of the ``wanted`` windows (sorted keys) is."""
    total = np.zeros(wanted.size, np.int64)
    for stream in streams:
        own = np.unique(window_hashes(stream, depth))
        at = np.minimum(np.searchsorted(wanted, own), max(0, wanted.size - 1))
        total[at[wanted[at] == own]] += 1 if wanted.size else 0
    return total


def _long_runs(gone: np.ndarray, least: int) -> np.ndarray:
    """A block's covered tokens, but for short runs in a block that is not all covered: a repeated substring that
    began in the block before may end on a word that pages merely share."""
    if gone.all():
        return gone
    steps = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    out = gone.copy()
    for a, b in steps.reshape(-1, 2):
        if b - a < least:
            out[a:b] = False
    return out


def main_text(blocks: list[tuple[str, int]], stream: np.ndarray, keys: np.ndarray, shares: np.ndarray, settings: Settings) -> str:
    """A page's text without its boilerplate; keys (sorted) and shares: the host's repeated windows."""
    depth = settings.min_tokens
    own = window_hashes(stream, depth) if keys.size else np.zeros(0, np.uint64)
    at = np.minimum(np.searchsorted(keys, own), max(0, keys.size - 1))
    share = np.where(keys[at] == own, shares[at], 0.0) if keys.size else np.zeros(own.size)
    if not (share >= min(settings.open_share, settings.main_share)).any():
        return "\n".join([text for text, _ in blocks])
    covered = []
    for needed in (settings.open_share, settings.main_share):
        edge = np.zeros(stream.size + 1, np.int64)
        hits = np.flatnonzero(share >= needed)
        np.add.at(edge, hits, 1)
        np.add.at(edge, hits + depth, -1)
        covered.append(np.cumsum(edge)[: stream.size] > 0)
    has_main = any(r == MAIN for _, r in blocks)
    split = [text.split(" ") for text, _ in blocks]
    ends = np.cumsum([len(w) for w in split])
    chosen, repeated = 0, 0
    for (_, region), words, end in zip(blocks, split, ends):
        if region == (MAIN if has_main else OPEN):
            chosen += len(words)
            repeated += int(covered[1][end - len(words) : end].sum())
    copy = repeated >= settings.copy_share * max(1, chosen)
    lines = []
    for (text, region), words, end in zip(blocks, split, ends):
        gone = covered[1 if region == MAIN else 0][end - len(words) : end]
        if copy and (region == MAIN or not has_main):
            gone = np.zeros(gone.size, bool)
        if gone.any():
            gone = _long_runs(gone, depth)
            text = " ".join(w for w, g in zip(words, gone) if not g)
        if text:
            lines.append(text)
    return "\n".join(lines)


def stream_of(blocks: list[tuple[str, int]]) -> np.ndarray:
    """Keys of a page's words in order."""
    import xxhash

    key = xxhash.xxh3_64_intdigest
    text = " ".join([text for text, _ in blocks])
    return np.array([key(w) for w in text.encode("utf-8", "surrogatepass").split(b" ")] if text else [], np.uint64)


def visible(blocks: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Blocks that may be text: all but those that markup rules out."""
    return [b for b in blocks if b[1] != OUT]


def _stored(blocks: list[tuple[str, int]]) -> str:
    """Blocks as lines, each with its region first (a block has no line break)."""
    return "\n".join([f"{region}{text}" for text, region in blocks])


def _loaded(data: str) -> list[tuple[str, int]]:
    return [(x[1:], int(x[0])) for x in data.split("\n")] if data else []


def main_texts(pages: list[str | None], settings: Settings = Settings()) -> list[str]:
    """Main texts of pages of one small host."""
    parsed = [visible(blocks_of(p)) for p in pages]
    streams = [stream_of(b) for b in parsed]
    distinct = list({s.tobytes(): s for s in streams}.values())
    if not distinct:
        return []
    found, counts = candidates(distinct, settings)
    shares = (counts - settings.chance) / len(distinct)
    return [main_text(b, s, found, shares, settings) for b, s in zip(parsed, streams)]


def extract_main_text(pages: DataFrame, html: str = "html", url: str = "url", settings: Settings = Settings()) -> DataFrame:
    """pages without their html, with ``main_text`` and ``main_chars`` (its code points).

    Null html and pages without text give the empty text.  A null url, or one
    without a host, belongs to the host ''.  Pages of any length are read whole;
    repeated rows are pages of their own with equal results and count once; an
    empty table gives an empty table; input columns named like a new one give way.
    Hosts of any number of pages, down to one, are decided by the same shares.
    """
    own = ["main_text", "main_chars"]
    kept = [c for c in pages.columns if c.lower() not in own and c != html]
    host = F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://([^/?#:]*)", 1), F.lit(""))
    work = Workspace(pages.sparkSession, "html")
    # Columns of pages go by number meanwhile, whatever their names.
    held = [f"__c{k}" for k in range(len(kept))]
    base = pages.select(*[pages[c].alias(n) for c, n in zip(kept, held)], pages[html].alias("__html"), host.alias("__host"))
    extra = [("__hash", T.LongType(), pa.int64()), ("__tokens", T.LongType(), pa.int64()), ("__blocks", T.StringType(), pa.string())]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                at = part.schema.get_field_index("__html")
                found = [_stored(visible(blocks_of(x))) for x in part.column(at).to_pylist()]
                hashes = [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in found]
                cols = [pa.array(hashes, pa.int64()), pa.array([x.count(" ") + x.count("\n") + 1 for x in found], pa.int64()), pa.array(found, pa.string())]
                rest = [(n, c) for n, c in zip(part.schema.names, part.columns) if n != "__html"]
                yield pa.RecordBatch.from_arrays([*[c for _, c in rest], *cols], names=[*[n for n, _ in rest], *[n for n, _, _ in extra]])

    schema = T.StructType([f for f in base.schema.fields if f.name != "__html"] + [T.StructField(n, t) for n, t, _ in extra])
    parsed = work.put(base.mapInArrow(parse, schema), "parsed", compression="zstd")
    groups = F.greatest(F.ceil(F.count(F.lit(1)) / settings.group_pages), F.ceil(F.sum("__tokens") / settings.group_tokens), F.lit(1)).cast("long")
    hosts = work.put(parsed.select("__host", "__hash", "__tokens").distinct().groupBy("__host").agg(F.count(F.lit(1)).alias("n"), groups.alias("groups")), "hosts")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages packed; those that this task has met go no further (as far back as it remembers)."""
        import zstandard

        met, compress = set(), zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            new = []
            for key in zip(batch.column("__host").to_pylist(), batch.column("__hash").to_pylist()):
                new.append(key not in met)
                met.add(key)
            if len(met) > 1_000_000:
                met.clear()
            batch = batch.filter(pa.array(new, pa.bool_()))
            packed = pa.array([compress(x.encode("utf-8", "surrogatepass")) for x in batch.column("__blocks").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("__host"), batch.column("__hash"), packed], names=["__host", "__hash", "__packed"])

    few = parsed.select("__host", "__hash", "__blocks")
    dealt = few.mapInArrow(once, "__host string, __hash long, __packed binary").join(hosts, "__host").withColumn("part", F.pmod("__hash", F.col("groups")))

    def grouped(rows: DataFrame, of: list[str]) -> DataFrame:
        """Groups side by side, the pages of one in order of their hashes."""
        ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(ranges, "__host", "part").sortWithinPartitions("__host", "part", "__hash").select(*of)

    def each(batches: Iterator[pa.RecordBatch], decide) -> Iterator[pa.RecordBatch]:
        """decide(first row, streams of the distinct pages) for one group after another; holds one group's tokens."""
        group, last, first, streams = None, None, None, []
        for batch in batches:
            names, parts, hashes, texts = (batch.column(c).to_pylist() for c in ("__host", "part", "__hash", "__packed"))
            for k, key in enumerate(zip(names, parts)):
                if key != group:
                    if streams:
                        yield decide(first, streams)
                    group, last, streams = key, None, []
                    first = {c: batch.column(c)[k].as_py() for c in batch.schema.names if c not in ("__packed", "__hash")}
                if hashes[k] != last:
                    last = hashes[k]
                    streams.append(stream_of(_loaded(B.unpack(texts[k], np.uint8).tobytes().decode("utf-8", "surrogatepass"))))
        if streams:
            yield decide(first, streams)

    def find(first: dict, streams: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = candidates(streams, settings)
        if first["groups"] == 1:
            keys, counts = keys[counts > settings.chance], counts[counts > settings.chance]
        return pa.RecordBatch.from_pydict({
            "host": pa.array([first["__host"]] * keys.size, pa.string()), "key": pa.array(keys.view(np.int64), pa.int64()), "pages": pa.array(counts, pa.int64()),
            "n": pa.array([first["n"]] * keys.size, pa.int64()), "groups": pa.array([first["groups"]] * keys.size, pa.int64()),
        })

    found = grouped(dealt, ["__host", "part", "__hash", "__packed", "n", "groups"]).mapInArrow(lambda b: each(b, find), "host string, key long, pages long, n long, groups long")
    found = work.put(found, "found")

    # Hosts of several groups: candidates of any group, counted over all.
    many = found.where("groups > 1").select("host", "key", "groups").distinct()
    asked = many.groupBy("host", "groups").agg(F.sort_array(F.collect_list("key")).alias("keys")).select(
        F.col("host").alias("__host"), "keys", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part"))

    def count(first: dict, streams: list[np.ndarray]) -> pa.RecordBatch:
        wanted = np.sort(np.array(first["keys"], np.int64).view(np.uint64))
        total = count_pages(streams, wanted, settings.min_tokens)
        return pa.RecordBatch.from_pydict({"host": pa.array([first["__host"]] * wanted.size, pa.string()), "key": pa.array(wanted.view(np.int64), pa.int64()), "pages": pa.array(total, pa.int64())})

    several = grouped(dealt.where("groups > 1").join(asked, ["__host", "part"]), ["__host", "part", "__hash", "__packed", "keys"])
    counted = (
        several.mapInArrow(lambda b: each(b, count), "host string, key long, pages long")
        .groupBy("host", "key").agg(F.sum("pages").alias("pages")).join(hosts.select(F.col("__host").alias("host"), "n"), "host").select("host", "key", "pages", "n")
    )
    total = found.where("groups = 1").select("host", "key", "pages", "n").unionByName(counted)
    # A window on a share s of the pages: at most (mean tokens of a page) / s a host.
    share = (F.col("pages") - settings.chance) / F.col("n")
    often = total.where(share >= settings.open_share)
    verdict = often.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("key", share.alias("share")))).alias("runs"))
    verdict = work.put(verdict, "verdict")
    spread = hosts.join(verdict, hosts["__host"] == verdict["host"]).select(
        F.col("__host").alias("host"), "runs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("salt"))
    # Written, so that Spark knows its size and broadcasts it where it is small.
    spread = work.put(spread, "spread")
    # Rows of a host are dealt evenly over its groups, equal ones too.
    salted = parsed.join(hosts.select(F.col("__host").alias("h"), "groups"), F.col("__host") == F.col("h")).withColumn(
        "salt", F.pmod(F.monotonically_increasing_id(), F.col("groups")))
    joined = salted.join(spread, (F.col("__host") == F.col("host")) & (salted["salt"] == spread["salt"]), "left").select(*held, "__host", "__blocks", "runs")
    out_schema = T.StructType([f for f in pages.schema.fields if f.name in kept] + [T.StructField("main_text", T.StringType()), T.StructField("main_chars", T.LongType())])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, keys, shares = None, np.zeros(0, np.uint64), np.zeros(0)
        for batch in batches:
            runs, names = batch.column("runs"), batch.column("__host").to_pylist()
            texts = []
            for k, (name, data) in enumerate(zip(names, batch.column("__blocks").to_pylist())):
                if name != last:
                    last, of = name, runs[k].as_py() or []
                    keys = np.array([r["key"] for r in of], np.int64).view(np.uint64)
                    order = np.argsort(keys)
                    keys, shares = keys[order], np.array([r["share"] for r in of])[order]
                blocks = _loaded(data)
                stream = stream_of(blocks) if keys.size else np.zeros(0, np.uint64)
                texts.append(main_text(blocks, stream, keys, shares, settings))
            cols = [batch.column(batch.schema.get_field_index(n)) for n in held]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, *own])

    return joined.mapInArrow(clean, out_schema)
