"""Main text of web pages by the container that the pages of a host agree on.

Every page scores its containers and votes for one of them by its path: tags and classes from the root down,
digits made equal. Votes are counted by host; then each page is read again and its text taken from the container
that has the most votes among those it has itself.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.frames import unused
from weftline.session import cut_lineage, measured_side

_words = str.split
# Element names of HTML by what they do to a text.
VOID = frozenset(_words("area base br col embed hr img input link meta param source track wbr"))
RAW = frozenset(_words("script style title textarea xmp iframe noembed noframes"))
CONTAINERS = frozenset(_words("html body main article section div td center details"))
BLOCKS = CONTAINERS | frozenset(_words(
    "address aside blockquote caption dd dialog dir dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header"
    " hgroup hr legend li menu nav ol optgroup option p pre search select summary table tbody tfoot th thead tr ul"
))
#: A start tag that ends an open element of these kinds.
CLOSES_ITEM = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "body": ("head",),
}
#: Ends the search for the element that a start tag ends.
SCOPES = frozenset(_words("ul ol menu dl table select div article section main body html td th"))
#: Elements that hold no article text.
DROPPED = frozenset(_words(
    "head nav header footer aside dialog menu search script style noscript template title textarea xmp iframe noembed noframes"
    " svg math canvas object audio video button select datalist"
))
DROPPED_ROLES = frozenset(_words("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form"))
#: First or last part of a class or id that says an element is not the article, and parts that say it is.
NOT_ARTICLE = frozenset(_words(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb"
    " breadcrumbs sidebar footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter"
    " subscribe subscription signup login share sharing social related recommended comment comments disqus respond reply replies pagination pager"
))
ARTICLE = frozenset(_words("article content main body post entry story text page"))
#: A container that holds more of a page's text than this, with none further down doing so, is voted for.
SHARE = 0.6
#: A path that at least one in so many votes of its host went to counts.
VOTES = 16
LONGEST_PATH = 400
HELD_VOTES = 50_000

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_TAG_END = re.compile(r"[\s/]*>?")
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")
_DIGITS = re.compile(r"\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])", re.I)


_RAW_ENDS = {name: _raw_end(name) for name in RAW}


def markup(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("text", characters, {}), ("start", name, attributes) and ("end", name, {}) in order; one pass, comments left out.

    A quote that is never closed ends at the next blank or >, an unfinished tag at the end is left out.
    """
    at = 0
    while at < len(page):
        mark = page.find("<", at)
        if mark < 0:
            yield "text", page[at:], {}
            return
        if mark > at:
            yield "text", page[at:mark], {}
        following = page[mark + 1 : mark + 2]
        if following in ("!", "?"):
            end = page.find("-->", mark + 2) + 2 if page.startswith("<!--", mark) else page.find(">", mark)
            if end < mark:
                return
            at = end + 1
            continue
        tag = _NAME.match(page, mark + 1)
        if not tag:
            yield "text", "<", {}
            at = mark + 1
            continue
        name, at, attributes = tag[2].lower(), tag.end(), {}
        while at < len(page) and page[at] != ">":
            found = _ATTRIBUTE.match(page, at)
            if not found:
                at = _TAG_END.match(page, at).end() - 1
                break
            value = next((v for v in found.groups()[1:] if v is not None), "")
            attributes.setdefault(found[1].lower(), value)
            at = found.end()
        if at >= len(page) or page[at] != ">":
            return
        at += 1
        if tag[1]:
            yield "end", name, {}
            continue
        yield "start", name, attributes
        if name in RAW:
            end = _RAW_ENDS[name].search(page, at)
            at = end.start() if end else len(page)


def _not_article(attributes: dict[str, str]) -> bool:
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    if not names:
        return False
    parts = [[p.lower() for p in _PART.findall(n)] for n in names]
    bad = [bool(p) and (p[0] in NOT_ARTICLE or p[-1] in NOT_ARTICLE) for p in parts]
    return any(bad) and not any(not b and ARTICLE.intersection(p) for b, p in zip(bad, parts, strict=True))


def _dropped(name: str, attributes: dict[str, str]) -> bool:
    if name in DROPPED:
        return True
    if not attributes or name in ("html", "body", "main", "article"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or attributes.get("role", "").lower() in DROPPED_ROLES:
        return True
    return bool(_HIDDEN.search(attributes.get("style", ""))) or _not_article(attributes)


def _step(name: str, attributes: dict[str, str]) -> str:
    classes = sorted(set(_DIGITS.sub("0", attributes.get("class", "")).split()))
    return ".".join([name, *classes])


def _extended(path: str, step: str) -> str:
    """The path one step further down; where it gets long, its digest, so that deep pages stay small."""
    longer = f"{path}>{step}"
    return longer if len(longer) <= LONGEST_PATH else "#" + hashlib.blake2b(longer.encode("utf-8", "replace"), digest_size=16).hexdigest()


class Page:
    """The containers of a page (parent, path) and its blocks of text (container, text, linked characters, in a form)."""

    def __init__(self, page: str | None) -> None:
        self.parents, self.paths, self.blocks = [0], [""], []
        self._pieces: list[str] = []
        self._linked = 0
        #: Open elements: name, container, dropped, in a form.
        self._open: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        self._names: dict[str, int] = {}
        self._link = False
        for kind, value, attributes in markup(page or ""):
            if kind == "text":
                self._text(value)
            elif kind == "start":
                self._start(value, attributes)
            else:
                self._end(value)
        self._flush()
        self._settle_forms()

    def _text(self, value: str) -> None:
        if not self._open[-1][2]:
            value = entities.unescape(value) if "&" in value else value
            self._pieces.append(value)
            if self._link:
                self._linked += len(value.strip())

    def _flush(self) -> None:
        text = " ".join("".join(self._pieces).split()) if self._pieces else ""
        if text:
            _, container, _, form = self._open[-1]
            self.blocks.append((container, text, min(self._linked, len(text)), form))
        self._pieces, self._linked = [], 0

    def _pop_to(self, depth: int) -> None:
        self._flush_if_block(depth)
        for name, *_ in self._open[depth:]:
            self._names[name] -= 1
        del self._open[depth:]
        self._link = False

    def _flush_if_block(self, depth: int) -> None:
        if any(name in BLOCKS or "-" in name for name, *_ in self._open[depth:]):
            self._flush()

    def _close_implied(self, kinds: tuple[str, ...], scopes: frozenset[str]) -> None:
        if any(self._names.get(k) for k in kinds):
            for depth in range(len(self._open) - 1, 0, -1):
                name = self._open[depth][0]
                if name in kinds:
                    self._pop_to(depth)
                    return
                if name in scopes:
                    return

    def _start(self, name: str, attributes: dict[str, str]) -> None:
        if name == "br":
            self._pieces.append(" ")
        elif name == "a":
            self._link = "href" in attributes
        block = name in BLOCKS or "-" in name
        if block:
            self._close_implied(("p",), SCOPES)
            if name in CLOSES_ITEM:
                self._close_implied(CLOSES_ITEM[name], SCOPES - {name})
            self._flush()
        _, container, dropped, form = self._open[-1]
        drop = dropped or _dropped(name, attributes)
        if name in VOID or not (block or (drop and not dropped)):
            return
        if name in CONTAINERS or "-" in name:
            self.parents.append(container)
            self.paths.append(_extended(self.paths[container], _step(name, attributes)))
            container = len(self.parents) - 1
        self._open.append((name, container, drop, form or name == "form"))
        self._names[name] = self._names.get(name, 0) + 1

    def _end(self, name: str) -> None:
        if name == "a":
            self._link = False
        if self._names.get(name):
            depth = next(d for d in range(len(self._open) - 1, 0, -1) if self._open[d][0] == name)
            self._pop_to(depth)
        elif name in BLOCKS:
            self._flush()

    def _settle_forms(self) -> None:
        """Blocks in forms go, unless a form holds most of the page, as on pages that are one form."""
        inside = sum(len(t) for _, t, _, form in self.blocks if form)
        if 2 * inside <= sum(len(t) for _, t, _, _ in self.blocks):
            self.blocks = [b for b in self.blocks if not b[3]]

    def totals(self) -> list[int]:
        """Score of each container: the characters below it in blocks that are not mostly links, without linked ones."""
        total = [0] * len(self.parents)
        for container, text, linked, _ in self.blocks:
            if 2 * linked < len(text):
                total[container] += len(text) - linked
        for k in range(len(total) - 1, 0, -1):
            total[self.parents[k]] += total[k]
        return total

    def best(self) -> tuple[int, int]:
        """The innermost container with most of the page's score, and its score."""
        total = self.totals()
        # With more than half needed these lie inside each other, and the last one to open is the innermost.
        found = max(k for k in range(len(total)) if total[k] >= SHARE * total[0])
        return (found, total[found]) if total[0] else (0, 0)

    def below(self, chosen: set[int]) -> str:
        """Text of the blocks in or below the chosen containers, in page order."""
        under = [k in chosen for k in range(len(self.parents))]
        for k in range(1, len(under)):
            under[k] = under[k] or under[self.parents[k]]
        return "\n\n".join(text for container, text, _, _ in self.blocks if under[container])

    def text(self, paths: list[str]) -> str:
        """By the first path that leads to text; else by the page's own container; else all that is left."""
        for path in paths:
            found = self.below({k for k, own in enumerate(self.paths) if own == path})
            if found:
                return found
        return self.below({self.best()[0]}) or self.below({0})


def host_of(url: Column) -> Column:
    """Lower-case host of an address, without user, port and a leading www; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"(?i)\A\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1))
    return F.nullif(found, F.lit(""))


def votes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, votes, score): how many pages of a host chose a container, and the characters it held there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list[int]] = {}

        def given() -> pa.RecordBatch:
            rows = [(*k, *v) for k, v in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["host", "path", "votes", "score"])

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen = Page(page.as_py())
                best, score = seen.best()
                if score:
                    cast = held.setdefault((host, seen.paths[best]), [0, 0])
                    cast[0] += 1
                    cast[1] += score
            if len(held) > HELD_VOTES:
                yield given()
        if held:
            yield given()

    cast = pages.select(host_of(F.col(url)).alias("host"), F.col(html)).where(F.col("host").isNotNull())
    counted = cast.mapInArrow(run, "host string, path string, votes long, score long")
    return counted.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))


def winning_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, paths): each host's paths with a sixteenth of its votes or more, most votes first.

    Ties go to the higher score, then to the first path. The share bounds the list.
    """
    counted = cut_lineage(votes(pages, url, html))
    all_votes = counted.groupBy("host").agg(F.sum("votes").alias("all"))
    strong = counted.join(all_votes, "host").where(F.col("votes") * VOTES >= F.col("all"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), (-F.col("score")).alias("s"), "path")))
    return strong.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("paths"))


def extracted(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with a column of main text, named ``main_text`` with underscores in front where that is taken.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are left out, by element,
    role, class and id. Blocks are joined by an empty line; white space of any kind within a block is one space. A
    null or empty page has an empty text; a page without a host, or without any of its host's paths, uses its own best
    container. Pages of any length are read whole; repeated rows vote each. An empty table gives no rows.
    """
    host, paths, out = unused(pages, "host"), unused(pages, "paths"), unused(pages, "main_text")
    agreed = measured_side(winning_paths(pages, url, html)).toDF(host, paths)
    met = pages.withColumn(host, host_of(F.col(url))).join(agreed, host, "left")

    @F.pandas_udf("string")
    def run(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([Page(t).text([] if p is None else list(p)) for t, p in zip(texts, found, strict=True)], dtype=object)

    return met.withColumn(out, run(F.col(html), F.col(paths))).drop(host, paths)
