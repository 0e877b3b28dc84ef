"""Main text of web pages, with site templates removed.

A page is read once, in linear time, into elements and blocks of text. Container subtrees (divisions, sections, lists, tables, ...)
are hashed bottom-up, each element once, in two ways: with their tags, class names and text; and, for subtrees of nothing but
links outside the main text, without what the links say and how many follow each other, as menus differ from page to page.
Spark counts the pages of each host that have each hash, and subtrees that recur across many pages of a host are that site's
template and are deleted. What is left is the article (or main) element, or the body without one, less the elements that are
never main text: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, told by
tag, role, class or id.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.llm.common import materialise, tidy

TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: A tag's rest up to its end or to a quote that nothing closes.
REST = re.compile(r"(?:[^>\"']+|\"[^\"]*\"|'[^']*')*")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Starting one of these ends an open p.
ENDS_P = BLOCK - {"body", "head", "html", "option", "select", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
RAW_END = {t: re.compile(rf"</{t}(?![a-z0-9])", re.I) for t in RAW}
FENCES = frozenset("article main td th body".split())
CONTAINERS = frozenset("div section aside nav header footer ul ol dl menu table form details figure fieldset center".split())
NEVER = frozenset("head nav footer aside form script style noscript template iframe svg canvas object select button textarea title menu dialog audio video map input label fieldset".split())
#: Words of class, id and role names of what isn't main text, wherever it stands.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices popup modal overlay sidebar "
    "menu nav navbar navigation breadcrumb breadcrumbs topbar footer bottombar comment comments commentlist disqus replies reply respond "
    "newsletter subscribe subscription signup login pagination contentinfo complementary".split()
)
#: Words that may also name a section of an article: they count outside the main text only.
OUTSIDE = frozenset("side aside toc alert discussion share sharing social related recommended promotion search form widget toolbar pager skip header masthead".split())
#: Names of what holds the main text on a page without article and main.
INSIDE = frozenset("article content entry main post story".split())
#: A name that begins so tells of something else on the page, such as has-sidebar.
ABOUT = frozenset({"has", "with", "no", "without", "is", "not"})
NAME = re.compile(r"[a-z]+")
#: An implied end: starting the key ends an open element of the values, up to the nearest of the scope.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
MANY_PAGES, SHARE = 5, 0.3
#: Template hashes of all hosts that are sent to every task at most; with more, pages meet their host's list in SALTS tasks a host.
SENT_HASHES, SALTS = 1 << 20, 64


def _named(attributes: str) -> tuple[str, bool, bool, bool]:
    """(class and id; whether names or role say that it isn't main text, that it isn't outside the main text, that it holds it)."""
    if not attributes or "=" not in attributes:
        return "", bool(attributes) and attributes.strip().lower() == "hidden", False, False
    names, out, outside, inside = [], False, False, False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            names.append(value)
        if key == "aria-hidden":
            out |= value == "true"
        elif key == "hidden":
            out = True
        else:
            for name in value.split():
                words = NAME.findall(name)
                if words and words[0] not in ABOUT:
                    out |= not WORDS.isdisjoint(words)
                    outside |= not OUTSIDE.isdisjoint(words)
                    inside |= not INSIDE.isdisjoint(words)
    return " ".join(names), out, outside, inside


class Element(NamedTuple):
    tag: str
    names: str
    never: bool  # never main text
    outside: bool  # not main text outside of it
    holds: bool  # named as what holds the main text
    parent: int
    first: int  # its first block


def _digest(*parts: bytes) -> int:
    return xxhash.xxh64_intdigest(b"\0".join(parts)) - (1 << 63)


def _pack(n: int) -> bytes:
    return n.to_bytes(8, "little", signed=True)


class Page:
    """Blocks of text of one page, and the open elements that they stand in. Reading and hashing are linear in the page."""

    def __init__(self, source: str):
        #: (text, the innermost element around it, whether all of it stands in links)
        self.blocks: list[tuple[str, int, bool]] = []
        self.elements: list[Element] = []
        #: The end of each element's blocks; its child elements k and blocks ~b in order.
        self.ends: list[int] = []
        self.kids: list[list[int]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        stack: list[int] = []
        tags: list[str] = []
        opened: Counter[str] = Counter()
        parts: list[str] = []
        plain = False  # whether the open block has text outside of links
        elements, ends, kids, blocks = self.elements, self.ends, self.kids, self.blocks

        def say(text: str) -> None:
            nonlocal plain
            parts.append(text)
            if not plain and not opened["a"] and not text.isspace():
                plain = True

        def flush() -> None:
            nonlocal plain
            if parts:
                text = " ".join("".join(parts).split())
                parts.clear()
                if text:
                    if stack:
                        kids[stack[-1]].append(~len(blocks))
                    blocks.append((text, stack[-1] if stack else -1, not plain))
            plain = False

        def close(depth: int) -> None:
            if any(t in BLOCK for t in tags[depth:]):
                flush()
            for k in stack[depth:]:
                ends[k] = len(blocks)
            for t in tags[depth:]:
                opened[t] -= 1
            del stack[depth:], tags[depth:]

        def depth_of(tag: str) -> int:
            depth = len(tags) - 1
            while tags[depth] != tag:
                depth -= 1
            return depth

        at, end = 0, len(source)
        last = {q: source.rfind(q) for q in "\"'"}
        while at < end:
            start = source.find("<", at)
            if start < 0:
                say(html.unescape(source[at:]))
                break
            if start > at:
                say(html.unescape(source[at:start]))
            if source.startswith("<!--", start):
                stop = source.find("-->", start + 4)
                at = stop + 3 if stop >= 0 else end
                continue
            m = TAG.match(source, start + 1)
            if m is None:
                if source[start + 1 : start + 2] in ("!", "?") and (stop := source.find(">", start)) >= 0:
                    at = stop + 1
                else:
                    say("<")
                    at = start + 1
                continue
            # quotes that nothing closes are letters like others; each is met once, as it is the last of its kind
            at = REST.match(source, m.end()).end() if source.find(">", m.end()) >= 0 else end
            while at < end and source[at] != ">":
                at = REST.match(source, at + 1).end()
            if at >= end:
                # a tag that never ends: all the rest is text
                say(html.unescape(source[start:]))
                break
            attributes = source[m.end() : at]
            at += 1
            tag = m[2].lower()
            if m[1]:
                if opened[tag]:
                    depth = len(tags) - 1
                    # an end tag doesn't reach out of the article or table cell around it
                    while tags[depth] != tag and (tag in BLOCK or tags[depth] not in FENCES):
                        depth -= 1
                    if tags[depth] == tag:
                        close(depth)
                elif tag == "br":
                    parts.append(" ")
                continue
            if tag == "br":
                parts.append(" ")
                continue
            if tag in ENDS_P and opened["p"]:
                close(depth_of("p"))
            if tag in IMPLIED:
                ended, scope = IMPLIED[tag]
                if any(opened[t] for t in ended):
                    for depth in range(len(tags) - 1, -1, -1):
                        if tags[depth] in scope:
                            break
                        if tags[depth] in ended:
                            close(depth)
                            break
            if tag in BLOCK:
                flush()
            if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCK:
                continue
            if tag in RAW:
                # the element's text isn't markup and never main text
                stop = RAW_END[tag].search(source, at)
                at = source.find(">", stop.end()) + 1 if stop else 0
                at = at or end
                continue
            names, out, outside, holds = _named(attributes)
            # the page's frame and its main elements are what they are, however they are styled
            frame = tag in ("html", "body", "main")
            if stack:
                kids[stack[-1]].append(len(elements))
            elements.append(Element(tag, names, tag in NEVER or out and not frame, tag == "header" or outside and not frame, holds, stack[-1] if stack else -1, len(blocks)))
            ends.append(-1)
            kids.append([])
            stack.append(len(elements) - 1)
            tags.append(tag)
            opened[tag] += 1
        flush()
        for k in stack:
            ends[k] = len(blocks)

    def main(self) -> str:
        """The tag that holds the main text: article or main where one has text, else empty for the whole page."""
        for want in ("article", "main"):
            if any(e.tag == want and not e.never and end > e.first for e, end in zip(self.elements, self.ends, strict=True)):
                return want
        return ""

    def inside(self) -> list[bool]:
        """Whether each element lies in the main text: in the article or main, or, without these, in what is named like them."""
        want, out = self.main(), []
        for e in self.elements:
            out.append((e.parent >= 0 and out[e.parent]) or (e.tag == want if want else e.holds) and not e.never)
        return out

    def subtrees(self) -> dict[int, list[int]]:
        """Hashes of each container element with text: with its text, and, for lists of links outside the main text, without."""
        n = len(self.elements)
        whole, blind, linked = [b""] * n, [b""] * n, [False] * n
        own = [_pack(_digest(t.encode())) for t, _, _ in self.blocks]
        inside, out = self.inside(), {}
        half = sum(len(t) for t, _, _ in self.blocks) / 2
        chars = [0] * n
        for k in range(n - 1, -1, -1):
            e = self.elements[k]
            if self.ends[k] == e.first:
                continue
            parts, shapes, links = [], [], True
            for kid in self.kids[k]:
                if kid < 0:
                    text, _, link = self.blocks[~kid]
                    part, shape = own[~kid], b"a" if link else own[~kid]
                    links &= link
                    chars[k] += len(text)
                elif whole[kid]:
                    part, shape = whole[kid], blind[kid]
                    links &= linked[kid]
                    chars[k] += chars[kid]
                else:
                    continue
                parts.append(part)
                if not shapes or shapes[-1] != shape:
                    shapes.append(shape)
            tag = e.tag.encode()
            whole[k], blind[k], linked[k] = _pack(_digest(tag, *parts)), _pack(_digest(tag, *shapes)), links
            if e.tag in CONTAINERS:
                out[k] = [_digest(b"whole", e.names.encode(), whole[k])]
                if links and self.ends[k] - e.first > 1 and not inside[k] and chars[k] <= half:
                    out[k].append(_digest(b"links", e.names.encode(), blind[k]))
        return out

    def text(self, template: set[int]) -> str:
        want, inside, gone = self.main(), self.inside(), set()
        if template:
            gone = {k for k, hashes in self.subtrees().items() if not template.isdisjoint(hashes)}
        lost: list[bool] = []
        for k, e in enumerate(self.elements):
            lost.append(e.never or k in gone or (e.outside and not inside[k]) or (e.parent >= 0 and lost[e.parent]))
        return "\n".join(t for t, k, _ in self.blocks if (not want if k < 0 else not lost[k] and (inside[k] or not want)))


def host_of(url):
    """The host of a url column, lower-case, without user and port; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def extract_text(spark: SparkSession, pages: DataFrame, many_pages: int = MANY_PAGES, share: float = SHARE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_template for each row: the main text, and how many template subtrees its host has.

    A container subtree is template if at least many_pages pages and a share of the pages of its host have it; paragraphs and
    headings by themselves never are. Null and empty pages give an empty text. Pages without a host (null or odd urls) count
    as one host of their own kind and lose no subtrees. Repeated rows count as pages of their own. Other columns are ignored,
    whatever their names; an empty table gives an empty one.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))

    @tidy
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, hashes = [], []
            for source, host in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = sorted({h for both in Page(source.as_py()).subtrees().values() for h in both}) if host and source.is_valid else []
                hosts += [host] * len(found)
                hashes += found
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64())], names=["host", "hash"])

    counts = rows.select("html", "host").mapInArrow(hashed, "host string, hash long").groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= many_pages)
    sizes = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    # a share of a host's pages can have only so many subtrees: this list stays as small as a few pages
    templates = counts.join(sizes, "host").where(F.col("n") >= share * F.col("pages")).groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("template"))

    @tidy
    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, many = [], []
            for source, template in zip(batch.column(2), batch.column(3), strict=True):
                known = set(template.as_py() or ())
                many.append(len(known))
                texts.append(Page(source.as_py() or "").text(known))
            columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(many, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["page_id", "url", "text", "n_chars", "n_template"])

    kind = pages.schema[id_col].dataType.simpleString()
    url_kind = pages.schema[url_col].dataType.simpleString()
    templates = materialise(spark, templates, "templates")
    size = templates.agg(F.coalesce(F.sum(F.size("template") + 4), F.lit(0))).first()[0]
    if size <= SENT_HASHES:
        # of a checked size: the pages stay where they are read
        joined = rows.join(F.broadcast(templates), "host", "left")
    else:
        # each host's pages are dealt over several tasks, and its list goes to all of them
        salts = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salts, ["host", "salt"], "left")
    joined = joined.select("page_id", "url", "html", "template")
    return joined.mapInArrow(cleaned, f"page_id {kind}, url {url_kind}, text string, n_chars long, n_template int")
