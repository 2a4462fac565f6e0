"""Main text of web pages, by equivalence-class template deduction.

*Tokens.*  A page is read as tokens: each block-level tag with its path of enclosing tags (tag, class, id and role names,
as one rolling hash), and each text block with its path.

*Classes.*  For every host, a token's occurrence vector says how often it stands on each of the host's different pages
(rows of equal html on a host are one page); it is summed up as two sums of hashes, so no host meets in one place.  Tokens
of equal vectors form a class.  A class is valid if it holds on MIN_SHARE of the host's pages, has MIN_TOKENS tokens, and
its tokens stand in one order on ORDERED of its pages.

*Template.*  The tags of all valid classes, each under the nearest valid tag that encloses it, are the host's template: a
tree whose root class stands once on every page, and below whose tags further classes nest.  A class of two tags or more
that stands several times a page is a list of records.

*Slots.*  What a template tag encloses is its slot.  From the root down, the slot that has most running text (characters
outside links, short blocks counting less) is followed; what stands beside it is judged against it by share of text,
length of blocks and links.  Tags that HTML keeps for other things (nav, footer, aside, form and so on) are no content,
article and main tags are; a slot of records, or class words, only weigh a slot up or down.  Text that stands on almost
all pages of a host in the same place, and is little of the followed slot, is template text.  A page without the followed
slot is read as a host of its own, as are pages without a host; with one page there is no constant text.

Defined results: null and empty html give '' and 0; a page without text gives ''; repeated rows each get the same row and
count once in their host's template; of slots with equal text the first is followed; very long and very deep pages are
read whole, in linear time; an empty table gives an empty table; other input columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import lean, materialize, release
from lodestone.session import ship

#: A class needs this share of a host's pages, so many tokens, and one order on this share of its pages.
MIN_SHARE, MIN_TOKENS, ORDERED = 0.5, 2, 0.9
#: Constant text stands on so many pages at least and this share of them, and is at most this share of the followed slot.
TEXT_PAGES, TEXT_SHARE, TEXT_PART = 3, 0.8, 0.25
#: What records, class words against it and for it, and an article or main tag make of a slot's text when slots are compared.
RECORDS, WORDS_AGAINST, WORDS_FOR, MAIN = 0.5, 0.25, 2.0, 4.0
#: Words of a block that count in full; share of the followed slot's text and block length that a slot beside it needs.
FULL_BLOCK, BESIDE, LENGTH = 8, 0.3, 0.5
#: Share of link text from which a slot is a list of links.
LINKS = 0.6
#: Decisions that are sent to every task; with more, pages and decisions are joined by host.
BROADCAST_TOKENS = 100_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[a-zA-Z/!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'])(class|id|role|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[a-z0-9]+")
_NUMBER = re.compile(r"\d{3,}")
#: Tags without content, tags inside a line, tags whose content is no markup, tags that close their like.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_RAW = frozenset("script style textarea title noscript iframe template svg math object canvas audio video xmp noembed noframes".split())
_SAME = frozenset("li tr td th dt dd option p".split())
#: Tags of other things than content, of content, of one block, of headings, of lists and tables.
_OUT_TAGS = frozenset("nav header footer aside form button select dialog menu head fieldset".split())
_MAIN_TAGS = frozenset("article main".split())
_LEAF_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre caption figcaption summary address".split())
_HEADINGS = frozenset("h1 h2 h3".split())
_LIST_TAGS = frozenset("ul ol dl table thead tbody tfoot tr td th blockquote figure details".split())
#: Words in class, id and role that speak for other things, and for content.
_AGAINST = frozenset("ad ads advert advertisement sponsored promo banner menu nav navigation breadcrumbs sidebar widget cookie notice popup newsletter share social related comment comments replies pagination copyright search".split())
_FOR = frozenset("article content story post entry main body text".split())
_OUT, _MAIN, _LEAF, _HEADING, _LIST, _SAYS_NO, _SAYS_YES, _HEADER, _FORM, _TOP = 1, 2, 4, 8, 16, 32, 64, 128, 256, 512

_FIELDS = ("token", "parent", "info", "count", "first", "last", "chars", "links", "blocks", "words")
_STRUCT = ", ".join(f"{f}: bigint" for f in _FIELDS)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _info(tag: str, names: list[str]) -> int:
    """What tag and names say, as bits."""
    return (
        _OUT * (tag in _OUT_TAGS) | _MAIN * (tag in _MAIN_TAGS) | _LEAF * (tag in _LEAF_TAGS) | _HEADING * (tag in _HEADINGS) | _LIST * (tag in _LIST_TAGS)
        | _SAYS_NO * (not _AGAINST.isdisjoint(names)) | _SAYS_YES * (not _FOR.isdisjoint(names)) | _HEADER * (tag == "header") | _FORM * (tag == "form") | _TOP * (tag in ("html", "body"))
    )


def _is_out(info: int, inside: bool) -> bool:
    """Whether a tag is for other things than content; a header in an article or main tag is that one's own."""
    return info & _OUT > 0 and not (inside and info & _HEADER)


def _names(attributes: str) -> tuple[list[str], bool]:
    """The names in class, id and role (long numbers are one name), and whether the tag is hidden."""
    names, hidden = [], False
    for m in _ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if kind == "hidden":
            hidden = hidden or attributes[m.end() : m.end() + 1] in ("", " ", "/", "\n", "\t")
        elif kind == "style":
            hidden = hidden or "display:none" in value.replace(" ", "")
        else:
            names += _NAME.findall(_NUMBER.sub("0", value))
    return sorted(set(names)), hidden


class Page:
    """The block-level tags of a page in order, and its text blocks.

    Of a tag: token, parent (a place in the list), info, and of the text that it encloses chars, links (chars inside
    links), blocks, words.  Of a block: place of its tag, text, token, and how many of its characters are links.
    """

    def __init__(self, html: str) -> None:
        self.token, self.parent, self.info, self.at = [0], [-1], [_TOP], [0]
        self.blocks: list[tuple[int, str, int, int, int]] = []
        self._read(html)
        n = len(self.token)
        self.stats = np.zeros((n, 4), np.int64)
        for place, text, _, linked, _ in self.blocks:
            self.stats[place] += (len(text), min(linked, len(text)), 1, text.count(" ") + 1)
        for i in range(n - 1, 0, -1):  # what a tag encloses comes after it
            self.stats[self.parent[i]] += self.stats[i]

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, place, hidden, inline
        opened: dict[str, int] = {}
        line: list[str] = []
        linked, link_depth, clock = 0, 0, 0

        def flush() -> None:
            nonlocal linked, clock
            if line:
                _, place, hidden, _ = stack[-1]
                if not hidden and (text := " ".join(unescape("".join(line)).split())):
                    clock += 1
                    self.blocks.append((place, text, _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), self.token[place] & (1 << 64) - 1)), linked, clock))
                line.clear()
            linked = 0

        def pop() -> str:
            nonlocal link_depth
            tag = stack.pop()[0]
            opened[tag] -= 1
            if len(stack) < link_depth:
                link_depth = 0
            return tag

        at, n = 0, len(html)
        while at < n:
            m = _TOKEN.search(html, at)
            part = html[at : m.start() if m else n]
            if part:
                line.append(part)
                if link_depth:
                    linked += len(part.strip())
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "a":
                    link_depth = 0
                if tag not in _INLINE:
                    flush()
                if opened.get(tag):
                    if tag in _INLINE:
                        flush()
                    while pop() != tag:
                        pass
                continue
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = end.end() if end else n
                continue
            if tag in _VOID:
                if tag == "br":
                    line.append(" ")
                elif tag == "hr":
                    flush()
                continue
            names, hidden = _names(m[3]) if m[3] else ([], False)
            if tag in _INLINE:
                if tag == "a":
                    link_depth = len(stack)
                if hidden and not m[3].endswith("/"):
                    flush()
                    stack.append((tag, stack[-1][1], True, True))
                    opened[tag] = opened.get(tag, 0) + 1
                continue
            flush()
            if stack[-1][0] == "p" or tag in _SAME and stack[-1][0] == tag:
                pop()
            _, place, out, _ = stack[-1]
            clock += 1
            stack.append((tag, len(self.token), out or hidden, False))
            opened[tag] = opened.get(tag, 0) + 1
            self.at.append(clock)
            self.token.append(_signed(xxhash.xxh64_intdigest(" ".join((tag, *names)), self.token[place] & (1 << 64) - 1)) or 1)
            self.parent.append(place)
            self.info.append(_info(tag, names))
        flush()

    def tokens(self) -> dict[int, list[int]]:
        """The fields of each different token; info of a text is -1; token 0 is the page itself."""
        out: dict[int, list[int]] = {}
        for i, (token, at) in enumerate(zip(self.token, self.at)):
            row = out.setdefault(token, [token, self.token[self.parent[i]] if i else 0, self.info[i], 0, at, at, 0, 0, 0, 0])
            row[3] += 1
            row[5] = at
            for k, v in enumerate(self.stats[i].tolist()):
                row[6 + k] += v
        for place, text, token, _, at in self.blocks:
            row = out.setdefault(token, [token, self.token[place], -1, 0, at, at, 0, 0, 0, 0])
            row[3] += 1
            row[5] = at
            row[6] += len(text)
        return out


class Slot:
    """A tag of the template, or the page itself, and what it encloses."""

    __slots__ = ("blocks", "chars", "children", "first", "info", "links", "records", "token", "words")

    def __init__(self, token: int, info: int, first: float, chars: int, links: int, blocks: int, words: int, records: bool) -> None:
        self.token, self.info, self.first, self.chars, self.links, self.blocks, self.words, self.records = token, info, first, chars, links, blocks, words, records
        self.children: list[Slot] = []

    def length(self) -> float:
        return self.words / max(1, self.blocks)

    def linked(self) -> float:
        return self.links / max(1, self.chars)

    def text(self) -> float:
        """Running text: characters outside links, less for short blocks."""
        return (self.chars - self.links) * min(1.0, self.length() / FULL_BLOCK)

    def weight(self) -> float:
        w = self.text() * (RECORDS if self.records else 1)
        return w * (MAIN if self.info & _MAIN else WORDS_AGAINST if self.info & _SAYS_NO else WORDS_FOR if self.info & _SAYS_YES else 1)

    def direct(self) -> Slot:
        """What stands in the slot beside its children that are no single blocks."""
        own = Slot(self.token, self.info, self.first, self.chars, self.links, self.blocks, self.words, False)
        for c in self.children:
            if not c.info & _LEAF:
                own.chars, own.links, own.blocks, own.words = own.chars - c.chars, own.links - c.links, own.blocks - c.blocks, own.words - c.words
        return own


def _beside(slot: Slot, core: Slot, inside: bool) -> bool:
    """Whether a slot beside the followed one is content too. inside: they stand in an article or main tag, or in the last
    slot that was followed, where only what something speaks against is left out."""
    if _is_out(slot.info, inside) or slot.linked() > LINKS:
        return False
    if slot.info & _HEADER:
        return True
    if slot.info & _LIST:
        return inside or slot.length() >= LENGTH * core.length()
    if not slot.info & _SAYS_NO and slot.first < core.first and slot.length() >= max(FULL_BLOCK, LENGTH * core.length()):
        return True  # an introduction: running text before the rest
    if slot.info & _SAYS_NO or slot.records or not inside:
        return slot.weight() >= BESIDE * core.text() and slot.length() >= LENGTH * core.length()
    return True


def decide(root: Slot) -> tuple[dict[int, bool], int, int]:
    """Which slots are content (what is not named is like its parent), the last slot that was followed, and its characters."""
    says: dict[int, bool] = {root.token: False}
    at, inside = root, False
    while True:
        own, best = at.direct(), None
        open_ = [c for c in at.children if not c.info & _LEAF and not _is_out(c.info, inside) and not c.info & _HEADER]
        if open_:
            best = max(open_, key=lambda c: (c.weight(), -c.first, -c.token))
        elif not own.blocks and (forms := [c for c in at.children if c.info & _FORM]):
            best = max(forms, key=lambda c: (c.text(), -c.first, -c.token))  # a page in one form
        if best and (best.weight() <= own.text() or not best.blocks or inside and best.info & _LIST):
            best = None
        core = best or own
        says[at.token] = best is None
        for c in at.children:
            if c is best:
                continue
            if best and best.info & _MAIN and not c.info & _MAIN:
                says[c.token] = False
            elif c.info & _LEAF:
                if best:  # a block beside the followed slot
                    says[c.token] = c.linked() <= LINKS and (c.info & _HEADING > 0 or c.length() >= LENGTH * core.length())
            else:
                says[c.token] = _beside(c, core, inside or best is None and not at.info & _TOP)
        if best is None:
            return says, at.token, own.chars
        inside = inside or best.info & _MAIN > 0
        at = best


def _tree(rows: list[tuple], valid: set[int], records: set[int]) -> Slot:
    """The template: rows are (token, parent, info, first, chars, links, blocks, words) of tags, with all their ancestors."""
    parent = {r[0]: r[1] for r in rows}
    slots = {r[0]: Slot(r[0], r[2], *r[3:], r[0] in records) for r in rows if r[0] in valid or not r[0]}
    slots.setdefault(0, Slot(0, _TOP, 0, 0, 0, 0, 0, False))
    above: dict[int, int] = {0: 0}

    def nearest(token: int) -> int:
        way = []
        while token not in above and token not in slots and token in parent:
            way.append(token)
            token = parent[token]
        found = above.get(token, token if token in slots else 0)
        for t in way:
            above[t] = found
        return found

    for token, slot in slots.items():
        if token:
            slots[nearest(parent[token])].children.append(slot)
    return slots[0]


def _own(page: Page) -> tuple[dict[int, bool], int]:
    """The decision for a page that is a host of its own: each class is the tokens that stand equally often on it."""
    rows = [r for r in page.tokens().values() if r[2] >= 0]
    often: dict[int, int] = {}
    for r in rows:
        often[r[3]] = often.get(r[3], 0) + 1
    valid = {r[0] for r in rows if often[r[3]] >= MIN_TOKENS}
    records = {r[0] for r in rows if r[3] > 1 and often[r[3]] >= MIN_TOKENS}
    says, core, _ = decide(_tree([(r[0], r[1], r[2], r[4], *r[6:10]) for r in rows], valid, _record_slots(rows, records)))
    return says, core


def _record_slots(rows: list[tuple], records: set[int]) -> set[int]:
    """The tags that enclose records directly, when those hold most of their blocks."""
    by = {r[0]: r for r in rows}
    held: dict[int, int] = {}
    for token in records:
        r = by[token]
        if r[1] not in records and not r[2] & (_LEAF | _LIST):
            held[r[1]] = held.get(r[1], 0) + r[8]
    return {t for t, blocks in held.items() if t in by and 2 * blocks > by[t][8]}


def main_text(html: str | None, says: dict[int, bool] | None = None, core: int = 0, constant: frozenset[int] = frozenset()) -> str:
    """The content of a page's slots, a block a line, by a host's decision (its own without one)."""
    if not html:
        return ""
    page = Page(html)
    if not page.blocks:
        return ""
    if says is None or core not in set(page.token):
        says, _ = _own(page)
        constant = frozenset()
    kept, inside = [False] * len(page.token), [False] * len(page.token)
    for i, (token, parent, info) in enumerate(zip(page.token, page.parent, page.info)):
        if not i:
            kept[0] = says.get(0, True)
            continue
        inside[i] = inside[parent] or info & _MAIN > 0
        known = says.get(token)
        kept[i] = known if known is not None else kept[parent] and not _is_out(info, inside[parent])
    return "\n".join(text for place, text, token, _, _ in page.blocks if kept[place] and token not in constant)


def host_of(url: str | None) -> str:
    return (url or "").partition("://")[2].partition("/")[0].partition("?")[0].partition("#")[0].lower()


def _page_tokens(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """host, page and the tokens of each different page of a host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: dict[tuple[str, bytes], int] = {}
            fields, ends = [], [0]
            for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key = (host_of(url), xxhash.xxh3_128_digest((html or "").encode("utf-8", "surrogatepass")))
                if not key[0] or key in keys:
                    continue
                keys[key] = len(keys)
                fields += Page(html or "").tokens().values()
                ends.append(len(fields))
            table = np.array(fields, np.int64).reshape(-1, len(_FIELDS))
            rows = pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(len(_FIELDS))], names=list(_FIELDS))
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in keys], pa.string()), pa.array([p for _, p in keys], pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)], names=["host", "page", "tokens"])

    # rows of equal html on a host are one page: copies give no support
    return pages.select(url_col, html_col).mapInArrow(lean(run), f"host string, page binary, tokens array<struct<{_STRUCT}>>").dropDuplicates(["host", "page"])


def _decisions(table: pd.DataFrame) -> pd.DataFrame:
    """One host's frequent tokens (as many as a page has, at most 1 / MIN_SHARE times): its decision."""
    tags = table[table["info"] >= 0]
    rows = list(tags[["token", "parent", "info", "first", "chars", "links", "blocks", "words"]].itertuples(index=False, name=None))
    valid = {t for t, ok in zip(tags["token"], tags["valid"]) if ok}
    many = tags[tags["valid"] & (tags["often"] > tags["pages"])]
    sizes = many.groupby(["v1", "v2"])["token"].transform("size") if len(many) else many["token"]
    full = [(r.token, r.parent, r.info, 0, 0, 0, r.chars, r.links, r.blocks, r.words) for r in tags.itertuples()]
    says, core, chars = decide(_tree(rows, valid, _record_slots(full, set(many["token"][sizes >= 2]))))
    texts = table[(table["info"] < 0) & table["valid"] & (table["pages"] >= np.maximum(TEXT_PAGES, TEXT_SHARE * table["all"]))]
    # constant text of the followed slot is little of it, or it is no template but copies
    parent, within = dict(zip(tags["token"], tags["parent"])), 0
    for at, n in zip(texts["parent"], texts["chars"]):
        while at and at != core:
            at = parent.get(at, 0)
        within += n if at == core else 0
    constant = [] if within > TEXT_PART * chars else texts["token"].tolist()
    return pd.DataFrame({"host": [table["host"].iloc[0]], "core": [core], "yes": [sorted(t for t, v in says.items() if v)], "no": [sorted(t for t, v in says.items() if not v)], "constant": [sorted(constant)]})


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per host: core (the followed slot), yes and no (slots that are content or not) and constant (tokens of template text)."""
    held = materialize(_page_tokens(pages, url_col, html_col))
    each = held.select("host", "page", F.inline("tokens"))
    add = lambda seed: F.sum(F.pmod(F.xxhash64(F.lit(seed), "page", "count"), F.lit(1 << 40)))
    tokens = each.groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("pages"), add(1).alias("v1"), add(2).alias("v2"), F.min("parent").alias("parent"), F.min("info").alias("info"), F.sum("count").alias("often"), F.avg("first").alias("first"),
        *(F.sum(c).alias(c) for c in ("chars", "links", "blocks", "words")),
    )
    tokens = materialize(tokens)
    hosts = tokens.filter("token = 0").select("host", F.col("pages").alias("all"))
    frequent = tokens.join(hosts, "host").filter((F.col("pages") >= MIN_SHARE * F.col("all")) & ((F.col("info") >= 0) | (F.col("pages") >= TEXT_PAGES)))
    large = frequent.groupBy("host", "v1", "v2").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= MIN_TOKENS)
    frequent = materialize(frequent.join(large, ["host", "v1", "v2"], "left"))
    places = each.select("host", "page", "token", F.col("first").alias("f"), F.col("last").alias("l")).join(frequent.filter("size IS NOT NULL").select("host", "token", "v1", "v2", F.col("first").alias("mean")), ["host", "token"])
    line = places.groupBy("host", "page", "v1", "v2").agg(F.array_sort(F.collect_list(F.struct("mean", "token", "f", "l"))).alias("row"))
    after = F.forall(F.sequence(F.lit(1), F.size("row") - 1), lambda i: (F.get("row", i - 1)["f"] < F.get("row", i)["f"]) & (F.get("row", i - 1)["l"] < F.get("row", i)["l"]))
    ordered = line.groupBy("host", "v1", "v2").agg(F.avg(F.when(F.size("row") < 2, True).otherwise(after).cast("double")).alias("share")).filter(F.col("share") >= ORDERED)
    marked = frequent.join(ordered, ["host", "v1", "v2"], "left").withColumn("valid", F.col("share").isNotNull())
    made = materialize(marked.select("host", "token", "parent", "info", "first", "chars", "links", "blocks", "words", "pages", "often", "all", "v1", "v2", "valid").groupBy("host").applyInPandas(_decisions, "host string, core long, yes array<long>, no array<long>, constant array<long>"))
    release(held, tokens, frequent)
    return made


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every page."""
    ship(pages.sparkSession)
    made = templates(pages, url_col, html_col)
    total = made.agg(F.sum(F.size("yes") + F.size("no") + F.size("constant"))).first()[0] or 0
    host = F.lower(F.regexp_extract(F.col(url_col), r"://([^/?#]*)", 1))
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.coalesce(host, F.lit("")).alias("h"))
    side = made.withColumnRenamed("host", "h")
    joined = base.join(F.broadcast(side) if total <= BROADCAST_TOKENS else side, "h", "left").select("id", "url", "html", "h", "core", "yes", "no", "constant")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, tuple] = {}
            hosts, core, sides = batch.column(3).to_pylist(), batch.column(4).to_pylist(), [batch.column(k) for k in (5, 6, 7)]
            texts = []
            for i, html in enumerate(batch.column(2).to_pylist()):
                if core[i] is not None and hosts[i] not in known:
                    yes, no, constant = (c[i].as_py() for c in sides)
                    known[hosts[i]] = (dict.fromkeys(yes, True) | dict.fromkeys(no, False), core[i], frozenset(constant))
                texts.append(main_text(html, *known.get(hosts[i], ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], names=["id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(lean(run), f"id {kind}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
