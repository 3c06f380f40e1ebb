"""Main text of web pages, with suffix arrays over the pages of a host.

A page is cut into blocks by its markup. Blocks in menus, headers, footers, side bars, notices, adverts, forms,
comments, scripts and the like are structural boilerplate. What markup does not tell is found by repetition: the
token streams of the pages of one host are concatenated, a suffix array brings equal substrings together, and the
long ones that stand on several distinct pages cover template text, which goes; unique runs stay.

The text of a page with an article element lies in the element: unique text outside it is not of it. The articles of a
host go through suffix arrays of their own. Copied articles and shared passages repeat as templates do, so a substring
is a template's only if it stands in more than half of the different articles of the host (MIN_PAGES at least). A block
of an article that such substrings cover whole goes (a notice, an advert or a call to subscribe that markup does not
tell), unless more than half of the article would go: then the article is a copy, and stays whole. On pages without an
article element the streams are what the host has outside articles, and every covered token goes.

Streams are dealt into shards of about SHARD_TOKENS tokens, small hosts several to a shard, large ones over many, by their
content, so that equal ones meet. Outside articles each shard counts the pages of its substrings, the counts of a host
are summed by a shuffle, and shards learn which of theirs count. Of articles no counts of unique substrings move: what
stands in more than half of a host's articles does so in one of its shards, so these name the substrings, and only they
are counted in all articles of the host. The result does not depend on the size of the shards.

Edge cases: null html or url gives the text that is there (empty for null html, no host for a null url); unclosed
elements end with their parent; a tag that never ends is text; repeated rows are pages of their own, but count once as
evidence of repetition if their articles, or their texts outside articles, are equal; an empty table gives an empty
result. Scanning takes linear time whatever the markup.
"""

from __future__ import annotations

import html as html_module
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, checkpoint, fields_for, hinted, window_hashes

SHARD_TOKENS = 400_000
#: Articles that a task remembers, so that copies in it are evidence once.
SEEN = 200_000
#: A repeated substring has at least so many tokens and stands on so many distinct pages.
MIN_TOKENS, MIN_PAGES = 6, 3

_RAW = frozenset("script style noscript template textarea iframe svg title".split())
_BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUT = frozenset("nav footer aside form head menu dialog button select canvas audio video".split())
_TAG = re.compile(r"[a-z][a-z0-9:-]*", re.I)
_STOP = re.compile(r"[>\"']")
#: One attribute, read from where the last one ended, so that nothing inside a value is taken for one.
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]*)))?""")
_TELLING = frozenset("class id role style hidden aria-hidden".split())
#: Raw elements that hold others of their kind; of these svg, which is foreign, may close itself.
_NESTED = {t: re.compile(rf"<(/?){t}(?=[\s/>])", re.I) for t in ("svg", "template")}
#: Whole class or id names of containers that are not the article's.
_NAMES = re.compile(
    r"(?:(?:site|page|global|main|top|bottom|post|article|entry|blog|user|reader|story|primary|secondary|left|right|sticky)[-_]*)*"
    r"(?:ads?|advert\w*|sponsor\w*|promos?|promoted|banner|cookies?\w*|consent|gdpr|notices?|notifications?|popup|modal|overlay|newsletter\w*|subscri\w*|paywall|sidebar|menus?|nav|navbar|navigation|breadcrumbs?|masthead|topbar|footer"
    r"|comments?|disqus\w*|replies|respond|related[-_]*(?:posts?|articles?|stories|links?|content|news)|recommended\w*|recommendations?|more[-_]*stories|share|sharing|social|widgets?|toolbar|log-?in|sign-?in|sign-?up|search|pager|pagination|copyright|skip\w*|hidden|sr-only|author[-_]*box|trending)"
    r"(?:[-_]*(?:box|bar|block|section|area|container|wrapper|list|form|links?|banner|notice|message|unit|slot|inner|items?|menu|thread|buttons?|icons?|content|widget|panel|top|bottom|left|right|\d+))*",
    re.I,
)
_HEADS = re.compile(r"(?:(?:site|page|global|main|top)[-_]*)?header(?:[-_]*(?:wrapper|container|inner|bar))?", re.I)
#: Elements that names can take out; paragraphs and the like only as adverts or hidden text, articles only as comments.
_CONTAINERS = frozenset("div section ul ol dl table center details header".split())
_SMALL = re.compile(r"ads?|advert\w*|sponsored|cookie[-_]*(?:notice|banner|consent)|sr-only|visually-hidden|hidden", re.I)
_COMMENT = re.compile(r"(?:user|reader)?[-_]*comments?(?:[-_]*(?:body|item|content|text|\d+))?", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Whole class or id names that mark the article; they outweigh the others on the same element.
_CONTENT = re.compile(r"(?:article|content|post|entry|story|main)(?:[-_]*(?:body|text|content|main|inner))?", re.I)
_SPACE = re.compile(r"\s+")


def _attributes(text: str) -> dict[str, str]:
    """The telling attributes; of repeated ones the first."""
    out: dict[str, str] = {}
    if text and text != "/":
        for m in _ATTR.finditer(text):
            name = m[1].lower()
            if name in _TELLING:
                out.setdefault(name, m[2] or m[3] or m[4] or "")
    return out


def _raw_end(page: str, tag: str, at: int) -> int:
    """Where the contents of a raw element that start at ``at`` and its end tag end; the end of the page if it has none."""
    depth = 1
    if tag not in _NESTED:
        over = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
        return over.end() if over else len(page)
    for m in _NESTED[tag].finditer(page, at):
        end = page.find(">", m.end())
        if end < 0:
            break
        depth += -1 if m[1] else 0 if tag == "svg" and page[end - 1] == "/" else 1
        if not depth:
            return end + 1
    return len(page)


def markup(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of a page: kinds are text, open and close. Contents of raw elements and comments
    are left out. Every search either moves on or is never made again, so it takes linear time."""
    at, n = 0, len(page)
    quotes = {'"': True, "'": True}  # whether any is left
    while at < n:
        low = page.find("<", at)
        if low != at:
            yield "text", page[at : low if low >= 0 else n], ""
            if low < 0:
                return
        at = low
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else n
            continue
        close = page.startswith("/", at + 1)
        name = _TAG.match(page, at + 1 + close)
        if name is None and not page.startswith(("!", "?", "/"), at + 1):
            yield "text", "<", ""
            at += 1
            continue
        end = begin = name.end() if name else at + 1
        while True:
            stop = _STOP.search(page, end)
            if stop is None:
                end = -1
                break
            if stop[0] == ">":
                end = stop.start()
                break
            after = page.find(stop[0], stop.end()) if name and not close and quotes[stop[0]] else -1
            if after < 0 and name and not close:
                quotes[stop[0]] = False
            end = after + 1 if after >= 0 else stop.end()
        if end < 0 and any(quotes.values()):  # all ends are inside quotes: those are no quotes
            quotes = dict.fromkeys(quotes, False)
            end = page.find(">", begin)
        if end < 0:
            yield "text", page[at:], ""
            return
        at = end + 1
        if name is None:
            continue
        tag = name[0].lower()
        if close:
            yield "close", tag, ""
        elif tag in _RAW:
            at = at if tag == "svg" and page[end - 1] == "/" else _raw_end(page, tag, at)
        else:
            yield "open", tag, page[begin:end]


def _is_out(tag: str, attrs: dict[str, str], names: list[str], rank: int) -> bool:
    """Whether an element is structural boilerplate."""
    if tag in ("html", "body", "main"):
        return False
    if tag in _OUT or tag == "header" and rank < 3 or attrs.get("role", "").lower() in _ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    if any(_CONTENT.fullmatch(n) for n in names):
        return False
    if tag == "article":
        return any(_COMMENT.fullmatch(n) for n in names)
    if tag in _CONTAINERS:
        return any(_NAMES.fullmatch(n) or rank < 3 and _HEADS.fullmatch(n) for n in names)
    return any(_SMALL.fullmatch(n) for n in names)


def blocks_of(page: str | None) -> list[tuple[str, int, bool, float]]:
    """(text, rank of the container, outside the article by markup, share of text in links) of every block.

    Ranks: 3 inside an article element, 2 in main, 1 in an element named as content, 0 elsewhere."""
    out: list[tuple[str, int, bool, float]] = []
    # open elements: (tag, rank inside, out inside, link inside)
    stack: list[tuple[str, int, bool, bool]] = []
    opened: Counter = Counter()
    rank, outside, link = 0, False, False
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html_module.unescape("".join(parts))).strip()
            if text:
                out.append((text, rank, outside, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    for kind, tag, rest in markup(page or ""):
        if kind == "text":
            parts.append(tag)
            if link:
                linked += len(tag.strip())
            continue
        if tag in _BLOCKS:
            flush()
        if kind == "close":
            if opened[tag]:
                while True:  # what is still open inside ends with it
                    last = stack.pop()
                    opened[last[0]] -= 1
                    if last[0] == tag:
                        break
                now = stack[-1][1:] if stack else (0, False, False)
                if now[:2] != (rank, outside):
                    flush()
                rank, outside, link = now
            continue
        if tag in _VOID or rest.endswith("/"):
            continue
        attrs = _attributes(rest)
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}".split()
        now, gone = rank, outside or _is_out(tag, attrs, names, rank)
        if tag == "article" or attrs.get("role") == "article":
            now = 3
        elif tag == "main" or attrs.get("role") == "main":
            now = max(now, 2)
        elif tag in ("div", "section", "td") and any(_CONTENT.fullmatch(n) for n in names):
            now = max(now, 1)
        if (now, gone) != (rank, outside):
            flush()
        rank, outside, link = now, gone, link or tag == "a"
        stack.append((tag, rank, outside, link))
        opened[tag] += 1
    flush()
    return out


# ------------------------------------------------------------------ suffix array


def suffix_array(tokens: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``length`` tokens or more (prefix doubling), and their ranks."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    n, k = len(rank), 1
    order = np.argsort(rank, kind="stable")
    while k < length:
        second = np.full(n, -1, np.int64)
        second[:-k] = rank[k:]
        order = np.lexsort((second, rank))
        change = (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(change)))
        rank, k = new, 2 * k
    return order, rank


def repeated_classes(streams: list[np.ndarray], pages: np.ndarray, min_tokens: int = MIN_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of distinct pages) of every substring of ``min_tokens``: neighbours in the suffix array with that
    many tokens in common are one. ``pages``: number of the page's content, equal pages have the same."""
    sizes = np.array([len(s) for s in streams], np.int64)
    if not len(sizes) or sizes.max() < min_tokens:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    tokens = np.concatenate(streams)
    # a token of its own ends every stream, so that no substring runs over it
    ends = np.cumsum(sizes + 1) - 1
    inner = np.ones(len(tokens) + len(streams), bool)
    inner[ends] = False
    known, dense = np.unique(tokens, return_inverse=True)
    number = np.empty(len(inner), np.int64)
    number[inner] = dense
    number[ends] = len(known) + np.arange(len(ends))
    order, _ = suffix_array(number, min_tokens)
    same = np.ones(len(order) - 1, bool)
    padded = np.concatenate((number, np.full(min_tokens, -1)))
    for j in range(min_tokens):
        same &= padded[order[1:] + j] == padded[order[:-1] + j]
    group = np.concatenate(([0], np.cumsum(~same)))
    several = int(pages.max()) + 1
    pairs = np.unique(group * several + np.repeat(pages, sizes + 1)[order]) // several
    first = order[np.flatnonzero(np.concatenate(([True], ~same)))]
    hashes = np.zeros(len(inner), np.uint64)
    whole = np.zeros(len(inner), bool)
    for s, e in zip(streams, ends, strict=True):
        n = len(s) - min_tokens + 1
        if n > 0:
            hashes[e - len(s) : e - len(s) + n] = window_hashes(s, min_tokens)
            whole[e - len(s) : e - len(s) + n] = True
    counts = np.bincount(pairs, minlength=len(first))
    return hashes[first][whole[first]], counts[whole[first]]


def covered_tokens(stream: np.ndarray, classes: np.ndarray, min_tokens: int = MIN_TOKENS) -> np.ndarray:
    """Mask of the tokens that the substrings with these hashes cover."""
    edge = np.zeros(len(stream) + 1, np.int64)
    starts = np.flatnonzero(np.isin(window_hashes(stream, min_tokens), classes))
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + min_tokens, -1)
    return np.cumsum(edge[:-1]) > 0


# ------------------------------------------------------------------ operator


def _stream(blocks: list[tuple[str, int, bool, float]]) -> np.ndarray:
    """Hashes of the tokens outside article elements."""
    words = [w for text, rank, _, _ in blocks if rank < 3 for w in text.split(" ")]
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def unique_text(blocks: list[tuple[str, int, bool, float]], covered: np.ndarray) -> str:
    """Blocks of the best container without covered tokens; blocks that are mostly links go."""
    best = max((b[1] for b in blocks if not b[2]), default=0)
    kept, at = [], 0
    for text, rank, outside, links in blocks:
        words = text.split(" ")
        mask = covered[at : at + len(words)].tolist()
        at += len(words)
        if not (outside or rank < best or links > 0.6):
            kept.append(" ".join(w for w, gone in zip(words, mask, strict=True) if not gone))
    return " ".join(t for t in kept if t)


def article_text(texts: list[str], classes: np.ndarray, hashes: WordHashes) -> tuple[str, int]:
    """The blocks of an article without those that the host's template substrings cover whole, and the tokens that went;
    an article that would lose more than half of its tokens is a copy and stays."""
    words = [t.encode().split(b" ") for t in texts]
    covered = covered_tokens(hashes.of([w for block in words for w in block]), classes)
    ends = np.cumsum([len(block) for block in words])
    gone = [bool(covered[e - len(block) : e].all()) for block, e in zip(words, ends, strict=True)]
    n = sum(len(block) for block, g in zip(words, gone, strict=True) if g)
    if 2 * n > ends[-1]:
        return " ".join(texts), 0
    return " ".join(t for t, g in zip(texts, gone, strict=True) if not g), n


def _host(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1))


def _packed(blocks: list) -> bytes:
    return zlib.compress(json.dumps(blocks, ensure_ascii=False).encode(), 6)


def _unpacked(data: bytes) -> list:
    return json.loads(zlib.decompress(data))


def _parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, key (of the row), inside (whether it has an article), blocks (packed: texts of the article elements,
    else all blocks), stream (hashes of the tokens outside articles), content (hash of the stream), size, article (hash of
    the article's text), tokens (of the article), fresh (whether the article is the first of its kind in the task)."""
    rows = fields_for(pages, "page_id", "url", "html").withColumn("host", F.xxhash64(_host("url"))).withColumn("key", F.xxhash64("page_id", "url", "html"))
    names = ["page_id", "url", "host", "key", "inside", "blocks", "stream", "content", "size", "article", "tokens", "fresh"]
    schema = "page_id long, url string, host long, key long, inside boolean, blocks binary, stream binary, content long, size long, article long, tokens long, fresh boolean"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            held, found, streams = [], [], []
            for host, page in zip(b.column(3).to_pylist(), b.column(2), strict=True):
                blocks = blocks_of(page.as_py())
                inside = [t for t, rank, outside, _ in blocks if rank == 3 and not outside]
                held.append(_packed(inside or blocks))
                streams.append(_stream(blocks))
                article = xxhash.xxh64_intdigest(" ".join(inside)) - (1 << 63)
                fresh = bool(inside) and (host, article) not in seen
                if fresh and len(seen) < SEEN:
                    seen.add((host, article))
                found.append((bool(inside), article, sum(t.count(" ") + 1 for t in inside), fresh))
            inside, article, tokens, fresh = zip(*found, strict=True) if found else ((),) * 4
            columns = [
                pa.array(inside, pa.bool_()), pa.array(held, pa.binary()), pa.array([s.tobytes() for s in streams], pa.binary()),
                pa.array([xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in streams], pa.int64()), pa.array([len(s) for s in streams], pa.int64()),
                pa.array(article, pa.int64()), pa.array(tokens, pa.int64()), pa.array(fresh, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), *columns], names)

    return rows.mapInArrow(parse, schema)


def _shard(rows: DataFrame, size: str, content: str, shard_tokens: int):
    """Rows (host, ...) with n (tokens of a host of more than a shard, else null), and the expression of their shard."""
    large = checkpoint(rows.groupBy("host").agg(F.sum(size).alias("n")).where(F.col("n") > shard_tokens))
    total = rows.agg(F.sum(size)).first()[0] or 0
    groups = max(1, math.ceil(total / shard_tokens))
    shard = F.when(F.col("n").isNull(), F.pmod(F.xxhash64("host"), F.lit(groups))).otherwise(F.xxhash64("host", F.pmod(content, F.ceil(F.col("n") / shard_tokens))))
    return rows.join(hinted(large), "host", "left"), shard


def _templates(parsed: DataFrame, shard_tokens: int) -> DataFrame:
    """host, classes: hashes of the substrings that stand in more than half of the different articles of a host."""
    articles = parsed.where("fresh").select("host", "article", "tokens", "blocks")
    met, shard = _shard(articles, "tokens", "article", shard_tokens)
    dealt = met.select(shard.alias("shard"), "host", "article", F.col("n").isNotNull().alias("part"), "blocks")

    def count(table: pa.Table) -> pa.Table:
        hashes = WordHashes()
        by_host: dict[tuple[int, bool], dict[int, bytes]] = {}
        for host, article, part, blocks in zip(*[table.column(c).to_pylist() for c in ("host", "article", "part", "blocks")], strict=True):
            by_host.setdefault((host, part), {}).setdefault(article, blocks)
        out = []
        for (host, part), rows in by_host.items():
            out.append((np.array([host]), np.array([0]), np.array([len(rows)]), np.array([True]), np.array([part])))
            if part or len(rows) >= MIN_PAGES:
                streams = [hashes.of([w for t in _unpacked(x) for w in t.encode().split(b" ")]) for x in rows.values()]
                classes, n = repeated_classes(streams, np.arange(len(streams)))
                often = 2 * n > len(rows)
                k = int(often.sum())
                out.append((np.full(k, host), classes[often].view(np.int64), n[often], np.zeros(k, bool), np.full(k, part)))
        return pa.table(dict(zip(("host", "class", "n", "all", "part"), (pa.array(np.concatenate(c)) for c in zip(*out, strict=True)), strict=True)))

    counts = checkpoint(dealt.groupBy("shard").applyInArrow(count, "host long, class long, n long, all boolean, part boolean"))
    whole = counts.where("all").groupBy("host").agg(F.sum("n").alias("articles"))
    exact = counts.where("not all and not part").select("host", "class", "n")
    asked = checkpoint(counts.where("not all and part").groupBy("host").agg(F.sort_array(F.collect_set("class")).alias("asked")))
    if not asked.isEmpty():

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for b in batches:
                for host, article, blocks, wanted in zip(*b.columns, strict=True):
                    stream = hashes.of([w for t in _unpacked(blocks.as_py()) for w in t.encode().split(b" ")])
                    found = np.intersect1d(window_hashes(stream, MIN_TOKENS).view(np.int64), wanted.values.to_numpy())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), host.as_py(), np.int64)), pa.array(found), pa.array(np.full(len(found), article.as_py(), np.int64))], ["host", "class", "article"])

        in_all = articles.join(hinted(asked), "host").select("host", "article", "blocks", "asked").mapInArrow(places, "host long, class long, article long")
        exact = exact.unionByName(in_all.distinct().groupBy("host", "class").agg(F.count("*").alias("n")))
    often = exact.join(whole.hint("merge"), "host").where((F.col("n") >= MIN_PAGES) & (2 * F.col("n") > F.col("articles")))
    return checkpoint(often.groupBy("host").agg(F.sort_array(F.collect_set("class")).alias("classes")))


def _repeated(streams: DataFrame, shard_tokens: int) -> DataFrame:
    """key, covered (packed bits, one for each token) of the pages that ask, from distinct streams of whole hosts (host, key,
    content, size, stream, asks)."""
    met, shard = _shard(streams, "size", "content", shard_tokens)
    dealt = checkpoint(met.select(shard.alias("shard"), "host", "key", "content", "stream", "asks"))

    def count(table: pa.Table) -> pa.Table:
        by_host: dict[int, list] = {}
        for host, content, stream in zip(*[table.column(c).to_pylist() for c in ("host", "content", "stream")], strict=True):
            by_host.setdefault(host, []).append((content, np.frombuffer(stream, np.uint64)))
        out = []
        for host, rows in by_host.items():
            hashes, n = repeated_classes([r[1] for r in rows], np.unique([r[0] for r in rows], return_inverse=True)[1])
            out.append((np.full(len(hashes), host, np.int64), hashes.view(np.int64), n))
        host, hashes, n = (np.concatenate([o[i] for o in out]) for i in range(3))
        return pa.table({"shard": pa.array(np.full(len(host), table.column("shard")[0].as_py(), np.int64)), "host": pa.array(host), "class": pa.array(hashes), "n": pa.array(n, pa.int64())})

    counts = checkpoint(dealt.groupBy("shard").applyInArrow(count, "shard long, host long, class long, n long"))
    wide = counts.groupBy("host", "class").agg(F.sum("n").alias("pages")).where(F.col("pages") >= MIN_PAGES)
    told = counts.join(wide.hint("merge"), ["host", "class"]).select("shard", "host", "class")

    def cover(rows: pa.Table, known: pa.Table) -> pa.Table:
        hosts, classes = known.column("host").to_numpy(), known.column("class").to_numpy().view(np.uint64)
        order = np.argsort(hosts, kind="stable")
        hosts, classes = hosts[order], classes[order]
        out = []
        for host, key, stream, asks in zip(*[rows.column(c).to_pylist() for c in ("host", "key", "stream", "asks")], strict=True):
            if asks:
                mine = classes[np.searchsorted(hosts, host) : np.searchsorted(hosts, host, "right")]
                out.append((key, np.packbits(covered_tokens(np.frombuffer(stream, np.uint64), mine)).tobytes()))
        return pa.table({"key": pa.array([o[0] for o in out], pa.int64()), "covered": pa.array([o[1] for o in out], pa.binary())})

    return dealt.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(cover, "key long, covered binary")


def extract_main_text(pages: DataFrame, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_repeated (tokens that went as repeated)."""
    parsed = checkpoint(_parsed(pages))
    schema, names = "page_id long, url string, text string, n_chars long, n_repeated long", ["page_id", "url", "text", "n_chars", "n_repeated"]

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            out = [
                article_text(_unpacked(blocks), classes.values.to_numpy().view(np.uint64), hashes) if classes.is_valid else (" ".join(_unpacked(blocks)), 0)
                for blocks, classes in zip(b.column(2).to_pylist(), b.column(3), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t for t, _ in out], pa.string()), pa.array([len(t) for t, _ in out], pa.int64()), pa.array([n for _, n in out], pa.int64())], names)

    articles = parsed.where("inside").select("host", "page_id", "url", "blocks").join(hinted(_templates(parsed, shard_tokens)), "host", "left")
    done = articles.select("page_id", "url", "blocks", "classes").mapInArrow(inner, schema)
    bare = parsed.where("not inside")
    hosts = checkpoint(bare.select("host").distinct())
    if hosts.isEmpty():
        return done
    streams = parsed.join(hinted(hosts), "host", "left_semi").groupBy("host", "key").agg(*[F.first(c).alias(c) for c in ("content", "size", "stream")], F.first(~F.col("inside")).alias("asks"))
    masks = _repeated(checkpoint(streams), shard_tokens)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, gone = [], []
            for blocks, covered in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                rows = [tuple(x) for x in _unpacked(blocks)]
                n = sum(r[0].count(" ") + 1 for r in rows)
                mask = np.unpackbits(np.frombuffer(covered or b"", np.uint8), count=n).astype(bool) if n else np.zeros(0, bool)
                texts.append(unique_text(rows, mask))
                gone.append(int(mask.sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(gone, pa.int64())], names)

    met = bare.join(masks.hint("merge"), "key", "left").select("page_id", "url", "blocks", "covered")
    return done.unionByName(met.mapInArrow(pick, schema))
