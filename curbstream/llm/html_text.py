"""Main text of web pages by consensus host paths.

First pass: every page votes for its containers by the text in the blocks below them, less twice what is inside links, as a
share of the page; a container is named by its generalised path of tags and classes. The votes of a path are summed per host
in Spark, and all paths with at least a tenth of their host's votes win. Second pass: a page's text is all its blocks but
those of containers that are mostly links and under no winning path of the host; where containers marked as content (article,
main, or by role or class) hold at least MOST of the page's score, only blocks inside marked ones. So a page whose layout is not its host's
still gives its whole text. Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles are left
out wherever they stand, by tag, role and class words.

Inside a block white space becomes one space; blocks are joined by a newline. Null and empty pages, and pages without
text, give an empty string. Pages without a host share the votes of the host ''. Repeated rows give equal results.
"""
from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbstream.llm.common import record, stage

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul head title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select".split())
SKIP_TAGS = frozenset("nav header footer aside form button dialog head menu".split()) | RAW
#: What an end tag can close. RAW elements are never open: they are passed over as a whole.
CLOSES = BLOCKS | (SKIP_TAGS - RAW)
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id names that mark what is not the article.
SKIP_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget comment comments disqus reply replies respond cookie cookies consent gdpr notice notices banner popup modal overlay newsletter subscribe signup share sharing social related recommended toolbar pagination pager search login".split())
#: Words that say nothing beside those; a name with any other word (search-engine-history) may mean something else.
PLAIN_WORDS = frozenset("list area box wrapper wrap section inner outer container block bar links link item items form left right top bottom site page primary secondary global posts articles panel group row col column icon icons button buttons count title text thread body the".split())
CONTENT_WORDS = frozenset("article content entry post story main".split())
#: The share of a page's score from which a container, or the marked ones together, stand for the page.
MOST = 0.9
_SPLIT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
#: A slash that is not the end of a value without quotes.
_SELF_CLOSED = re.compile(r"(?:^|[\s\"'])[^\s\"'=]*/$")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS - RAW))})(?=[\s/>])", re.I)
_RAW_TAG = {t: re.compile(rf"<(/?){t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
Block = tuple[tuple[str, ...], tuple[bool, ...], str, int]  # container path, its content marks, text, characters in links


def _attributes(raw: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)} if raw.strip(" /") else {}


def _words(attrs: dict[str, str]) -> list[str]:
    return [w.lower() for w in _NAME.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}")]


def _skipped(tag: str, attrs: dict[str, str]) -> bool:
    return tag in SKIP_TAGS or attrs.get("role", "").lower() in SKIP_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()


def _named(tag: str, attrs: dict[str, str]) -> tuple[bool, bool | None]:
    """Whether an element is marked as content, and what its class and id names say against it: None nothing, True clearly,
    False perhaps. Names of categories and tags say what a page is about, not what the element is."""
    mark, against, last = tag in ("article", "main") or attrs.get("role") in ("main", "article"), None, ""
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = [w.lower() for w in _NAME.findall(name)]
        if not words or len(words) > 1 and words[0] in ("category", "tag"):
            continue
        if any(w in SKIP_WORDS and p not in ("has", "with", "no") for w, p in zip(words, [last, *words], strict=False)):
            against = against or all(w in SKIP_WORDS or w in PLAIN_WORDS or w in CONTENT_WORDS for w in words)
        elif CONTENT_WORDS & set(words):
            mark = True
        last = words[-1]
    return mark, None if mark or tag in ("html", "body", "h1", "h2", "h3", "h4", "h5", "h6") else against


def _past_raw(html: str, tag: str, at: int, closed: bool, endless: set[str]) -> int:
    """Where the text goes on after the start tag of a RAW element that ends at ``at``.

    A self-closed one is empty, unless it is HTML's own and its end tag comes before another start tag: browsers ignore the
    slash there. One that is never closed ends with its block. ``endless`` has the tags without a further end tag.
    """
    if closed and (tag in ("svg", "math") or not (m := _RAW_TAG[tag].search(html, at)) or not m[1]):
        return at
    m = None if tag in endless else _RAW_END[tag].search(html, at)
    if m:
        return m.end()
    endless.add(tag)
    m = _BLOCK_TAG.search(html, at)
    return m.start() if m else len(html)


def blocks(html: str) -> list[Block]:
    """Text blocks in page order that stand in nothing skipped, with the path of their containers.

    What class and id names speak against is left out, unless that would be most of the page's text: names that may mean
    something else, if they would take half of it and marked containers elsewhere have less than a quarter; clear ones, if
    they would take nine tenths and those have less than a tenth. Elements that are mostly links stay out.
    """
    sure: list[bool] = []
    got = list(_blocks(html, sure))
    free: set[int] = set()  # elements that are judged to be text
    while sure:
        total, marked = 0, 0
        held: dict[int, list[int]] = {}
        for _, marks, text, linked, against in got:
            score = max(0, len(text) - 2 * linked)
            total += score
            top = next((e for e in against if e not in free), None)
            if top is None:
                marked += score if any(marks) else 0
                continue
            h = held.setdefault(top, [0, 0, 0])
            h[0] += score
            h[1] += len(text)
            h[2] += linked
        texts = [e for e, (_, chars, links) in held.items() if chars > 2 * links]
        maybe = [e for e in texts if not sure[e]]
        if 2 * sum(held[e][0] for e in maybe) > total and 4 * marked < total:
            free.update(maybe)
        elif sum(held[e][0] for e in texts) > MOST * total and 10 * marked < total:
            free.update(texts)
        else:
            break
    return [b[:4] for b in got if free.issuperset(b[4])]


def _blocks(html: str, sure: list[bool]) -> Iterator[tuple[tuple[str, ...], tuple[bool, ...], str, int, tuple[int, ...]]]:
    """Blocks that no tag, role or attribute hides, with the elements around them whose names speak against them, outermost
    first; ``sure`` gets, for each of those, whether its names do so clearly."""
    stack: list[tuple[str, str, bool, bool, tuple[int, ...]]] = []  # tag, name, skipped (itself or above), content mark, elements with names against them
    parts: list[str] = []
    linked, link, at, end = 0, False, 0, len(html)
    endless: set[str] = set()

    def close() -> Iterator[tuple[tuple[str, ...], tuple[bool, ...], str, int, tuple[int, ...]]]:
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split())
        if text and not (stack and stack[-1][2]):
            # A paragraph, heading or list item belongs to the container around it.
            n = len(stack)
            while n and stack[n - 1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "blockquote", "pre", "dd", "dt", "dl", "td", "tr", "th", "tbody", "thead", "table", "figure", "figcaption"):
                n -= 1
            yield tuple(s[1] for s in stack[:n]), tuple(s[3] for s in stack[:n]), text, linked, stack[-1][4] if stack else ()
        parts.clear()
        linked = 0

    while at < end:
        m = _SPLIT.search(html, at)
        piece = html[at : m.start()] if m else html[at:]
        if piece:
            parts.append(piece)
            if link:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                link = False
            elif tag in CLOSES:
                yield from close()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            continue
        if tag in RAW:
            at = _past_raw(html, tag, at, _SELF_CLOSED.search(m[3]) is not None, endless)
            continue
        if tag == "a":
            link = True
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS or tag in SKIP_TAGS:
            yield from close()
            link = False
            while stack and stack[-1][0] == "p" and tag != "button" or stack and tag == "li" and stack[-1][0] == "li":
                stack.pop()
            if tag in VOID or m[3].endswith("/"):
                continue
            attrs = _attributes(m[3])
            name = tag + "".join(f".{w}" for w in sorted(set(_words(attrs))))
            mark, against = _named(tag, attrs)
            around = stack[-1][4] if stack else ()
            if against is not None:
                around = (*around, len(sure))
                sure.append(against)
            stack.append((tag, name, bool(stack and stack[-1][2]) or _skipped(tag, attrs), mark, around))
    yield from close()


def _path(names: tuple[str, ...], marks: tuple[bool, ...]) -> tuple[str, ...]:
    """The container that stands for a block: the outermost one marked as content, else the innermost."""
    for i, mark in enumerate(marks):
        if mark:
            return names[: i + 1]
    return names


class _Container:
    __slots__ = ("score", "chars", "linked", "marked")

    def __init__(self, marked: bool) -> None:
        self.score, self.chars, self.linked, self.marked = 0, 0, 0, marked

    @property
    def plain(self) -> bool:
        return self.chars > 2 * self.linked


def _containers(got: list[Block]) -> dict[tuple[str, ...], _Container]:
    out: dict[tuple[str, ...], _Container] = {}
    for names, marks, text, linked in got:
        p = _path(names, marks)
        c = out.get(p)
        if c is None:
            c = out[p] = _Container(any(marks))
        c.score += max(0, len(text) - 2 * linked)
        c.chars += len(text)
        c.linked += linked
    return out


def scores(html: str) -> dict[str, int]:
    return {">".join(p): c.score for p, c in _containers(blocks(html)).items()}


def votes(html: str) -> dict[str, int]:
    """What a page says of its containers, in millionths of its score: each marked one has what is below it; what is not in
    a marked one goes to the innermost container with MOST of the page below it, unless that is the whole page."""
    found = _containers(blocks(html))
    total, marked = sum(c.score for c in found.values()), sum(c.score for c in found.values() if c.marked)
    if not total:
        return {}
    out = {">".join(p): c.score * 1_000_000 // total for p, c in found.items() if c.marked and c.score}
    rows, at = [(p, c.score) for p, c in found.items() if c.score], ()
    while True:
        below: dict[str, int] = {}
        for p, s in rows:
            if len(p) > len(at):
                below[p[len(at)]] = below.get(p[len(at)], 0) + s
        name = max(below, key=lambda n: below[n], default=None)
        if name is None or below[name] < MOST * total:
            break
        rows, at = [(p, s) for p, s in rows if len(p) > len(at) and p[len(at)] == name], (*at, name)
    if at and marked < total and at[-1].split(".")[0] not in ("html", "body"):
        path = ">".join(at)
        out[path] = out.get(path, 0) + (total - marked) * 1_000_000 // total
    return out


def extract(html: str, paths: Iterable[str] | None = None) -> str:
    """The text of a page; ``paths``: the winning containers of its host."""
    got = blocks(html)
    found = _containers(got)
    total, marked = sum(c.score for c in found.values()), sum(c.score for c in found.values() if c.marked)
    bounded, heads = 0 < MOST * total <= marked, tuple(f"{p}>" for p in paths or ())
    kept = {p for p, c in found.items() if (c.marked or not bounded) and (c.plain or (">".join(p) + ">").startswith(heads))}
    return "\n".join([t for names, marks, t, _ in got if _path(names, marks) in kept] or [t for _, _, t, _ in got])


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, path, score, share, paths: the best container path of each host, and all with at least a tenth of its votes."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple[str, str], int] = {}
            for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                for p, s in votes(page).items():
                    sums[host, p] = sums.get((host, p), 0) + s
            yield record(["host", "path", "score"], pa.array([h for h, _ in sums], pa.string()), pa.array([p for _, p in sums], pa.string()), pa.array(list(sums.values()), pa.int64()))

    cast = pages.select(*_pages(pages, url, html)).mapInArrow(vote, "host string, path string, score bigint")
    cast = stage(cast.groupBy("host", "path").agg(F.sum("score").alias("score")), "host-votes")
    best = cast.groupBy("host").agg(F.max(F.struct("score", "path")).alias("best"), F.sum("score").alias("all"))
    # At most ten of each host.
    many = cast.join(best.select("host", "all"), "host").where(F.col("score") * 10 >= F.col("all")).groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return best.join(many, "host").select("host", "best.path", "best.score", F.when(F.col("all") > 0, F.col("best.score") / F.col("all")).otherwise(0.0).alias("share"), "paths")


def _pages(pages: DataFrame, url: str, html: str) -> list[Column]:
    host = F.lower(F.coalesce(F.regexp_extract(pages[url].cast("string"), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("")))
    return [host.alias("host"), F.coalesce(pages[html].cast("string"), F.lit("")).alias("html")]


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars, host, path (the host's best path, null where none stands out)."""
    winners = stage(host_paths(pages, url, html), "host-paths")
    rows = pages.select(pages[page_id].alias("page_id"), pages[url].cast("string").alias("url"), *_pages(pages, url, html))
    joined = rows.join(winners.select("host", "path", "paths"), "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h, p) for h, p in zip(b.column("html").to_pylist(), b.column("paths").to_pylist(), strict=True)]
            yield record(["page_id", "url", "text", "n_chars", "host", "path"], b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), b.column("host"), b.column("path"))

    kind = dict(rows.dtypes)["page_id"]
    return joined.select("page_id", "url", "html", "host", "path", "paths").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint, host string, path string")
