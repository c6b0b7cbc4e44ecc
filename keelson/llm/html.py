"""HTML main text: a suffix array over each host's pages, with the pages' structure as a hint.

A page becomes blocks of text with the elements around them. What stands in
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or
reader comments, by its elements or by a plain word in a class, id or role, is
template. Where a page has an article (else a main element), the rest of the
page is left out. What remains is decided by the host's suffix array: the token
streams of its pages are concatenated and their suffixes ordered by their first
``LONG`` tokens (by prefix doubling). Neighbours that agree in all of these are
one substring, of which the distinct pages are counted. Tokens inside a
substring that enough pages share are covered; a block that is covered for the
most part is boilerplate; the others, the unique runs, stay. Two kinds of text
are told apart, each with streams of its own:

* loose text, of pages without an article or main element and of elements whose
  class is only doubtful (``DOUBTFUL``): ``PAGES`` pages are enough;
* framed text, inside an article or the main element: ``PAGES`` and ``SHARE`` of
  the host's pages. Text of an article may recur on some pages of a host (a
  title, a quoted passage, a copied article); what stands in most of its
  articles is the host's own.

A host's pages are dealt to groups of about ``GROUP`` characters, each with a
suffix array of its own. For hosts of several groups, pages are counted over the
whole host, so the result does not depend on its size. Each group sends the
hashes and counts of its loose substrings, dealt by hash, and gets back those
that are repeated. Of framed substrings it sends only those on ``SHARE`` of its
own pages: one on that share of the host's pages is so in one group at least.
Where there are such, every group counts them, and gets the sums.
"""

from __future__ import annotations

import html as html_lib
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm import common
from keelson.llm.words import mix

LONG, PAGES, SHARE, COVERED, GROUP = 8, 3, 0.5, 0.8, 1 << 20

#: Elements by what they mean for the text.
RAW = frozenset("script style noscript template iframe svg math object title textarea select".split())
TEMPLATE = frozenset("head nav header footer aside form button menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Words in a class, id or role that mark template.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr notice notices newsletter subscribe signup "
    "sidebar menu menubar nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead comment comments replies disqus share sharing "
    "widget toolbar complementary contentinfo".split()
)
#: Words that mark template outside an article, and inside one only where the host repeats the text.
DOUBTFUL = frozenset("promotion banner alert subscription social related recommended popup modal overlay search login".split())
PROTECT = frozenset(("html", "body", "article", "main"))
COMMENT_WORDS = frozenset("comment comments reply replies".split())

#: What a head holds; other elements end it, as HTML has it.
HEAD = RAW | frozenset("base link meta".split())
#: Where a raw element without an end tag ends.
_BREAK = re.compile(rf"</?(?:{'|'.join(sorted(CLOSES_P | {'body', 'html', 'head', 'li'}))})(?![a-z0-9-])", re.I)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>", re.S)
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(slots=True)
class Block:
    text: str
    template: bool  # inside an element that is never text
    doubtful: bool  # inside an element that may be template
    main: int  # 2 inside an article, 1 inside the main element, else 0


def _is_template(name: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is template, and whether it may be."""
    if name in TEMPLATE:
        return not (name == "header" and in_article), False
    if not attributes:
        return False, False
    marks = {w for m in _MARKS.finditer(attributes) for w in _WORD.split(_CAMEL.sub("-", m[1] or m[2] or m[3] or "").lower())}
    if name in PROTECT:
        return bool(marks & COMMENT_WORDS), False
    return bool(marks & WORDS), bool(marks & DOUBTFUL)


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of text in order. Unclosed elements end with what holds them."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[bool, bool, int]]] = []  # name, (template, doubtful, main)
    held: list[str] = []
    outside = now = (False, False, 0)
    unclosed: set[str] = set()  # raw elements without an end tag from here on

    def end() -> None:
        if held:
            text = " ".join(html_lib.unescape("".join(held)).split())
            if text:
                out.append(Block(text, *now))
            held.clear()

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        close, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            if name in VOID:
                continue
            if close:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        before = stack[k - 1][1] if k else outside
                        if before[:2] != now[:2]:
                            end()
                        del stack[k:]
                        now = before
                        break
                    if stack[k][0] not in INLINE:
                        break
                continue
        else:
            end()
        if close:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    end()
                    del stack[k:]
                    now = stack[-1][1] if stack else outside
                    break
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name in RAW:
            stop = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if stop:
                at = stop.end()
            else:
                unclosed.add(name)
                stop = _BREAK.search(page, at)
                at = stop.start() if stop else n
            continue
        if stack and stack[-1][0] == "head" and name not in HEAD:
            stack.pop()
            now = stack[-1][1] if stack else outside
        hidden, may_be = _is_template(name, attributes, now[2] == 2)
        if name in INLINE:
            if (hidden and not now[0]) or (may_be and not now[1]):
                end()
        elif name in CLOSES_P or name == "li":
            gone = "li" if name == "li" else "p"
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == gone:
                    del stack[k:]
                    now = stack[-1][1] if stack else outside
                    break
                if stack[k][0] not in INLINE:
                    break
        now = (now[0] or hidden, now[1] or may_be, max(now[2], 2 if name == "article" else 1 if name == "main" else 0))
        stack.append((name, now))
    end()
    return out


@dataclass(slots=True)
class Substrings:
    """All substrings of ``long`` tokens of some pages, in suffix array order."""

    sizes: np.ndarray  # tokens of each page
    start: np.ndarray  # where each occurrence stands in the concatenation, by substring, then place
    which: np.ndarray  # the substring of each occurrence
    pages: np.ndarray  # per substring, its distinct pages
    mark: np.ndarray  # per substring, a hash of its tokens
    long: int

    def covered(self, often: np.ndarray) -> list[np.ndarray]:
        """Per page which of its tokens lie in one of the substrings that are often."""
        begins = np.r_[0, np.cumsum(self.sizes + 1)]
        edges = np.zeros(int(begins[-1]) + self.long + 1, np.int64)
        starts = self.start[often[self.which]]
        edges[starts] += 1
        edges[starts + self.long] -= 1
        mask = np.cumsum(edges) > 0
        return [mask[b : b + s] for b, s in zip(begins[:-1], self.sizes, strict=True)]


def substrings(streams: list[np.ndarray], long: int = LONG) -> Substrings:
    """The suffix array of the concatenated streams (token hashes), ordered as far as ``long`` tokens, a power of two."""
    sizes = np.array([len(s) for s in streams], np.int64)
    total = int(sizes.sum()) + len(streams)
    begins = np.r_[0, np.cumsum(sizes + 1)]
    owner = np.repeat(np.arange(len(streams)), sizes + 1)
    tokens = np.zeros(total, np.uint64)
    for b, s in zip(begins, streams):
        tokens[b : b + len(s)] = s
    _, rank = np.unique(tokens, return_inverse=True)
    rank = rank.astype(np.int64) + len(streams)
    rank[begins[1:] - 1] = np.arange(len(streams))  # a separator equals no other
    reach = 1
    marks = mix(tokens)
    while reach < long:
        after = np.full(total, -1, np.int64)
        after[: max(total - reach, 0)] = rank[reach:]
        _, rank = np.unique(rank * (total + len(streams) + 1) + after + 1, return_inverse=True)
        with np.errstate(over="ignore"):
            marks[: max(total - reach, 0)] += mix(marks[reach:], reach)
            marks = mix(marks, long + reach)
        reach *= 2
    inside = np.arange(total) + long <= begins[1:][owner] - 1 if total else np.zeros(0, bool)
    start = np.flatnonzero(inside)
    start = start[np.argsort(rank[start], kind="stable")]  # within a substring by place, so by page
    new = np.r_[True, rank[start][1:] != rank[start][:-1]][: len(start)]
    new_page = new | np.r_[True, owner[start][1:] != owner[start][:-1]][: len(start)]
    first = np.flatnonzero(new)
    pages = np.add.reduceat(new_page.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return Substrings(sizes, start, np.cumsum(new) - 1, pages, marks[start[first]], long)


def _tokens(texts: list[str], known: dict[str, int]) -> list[list[int]]:
    """Per block the hashes of its lower-cased words."""
    out = []
    for text in texts:
        words = text.lower().split()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        out.append([known[w] for w in words])
    return out


@dataclass(slots=True)
class Parsed:
    """A page with the kind of each block (0 left out, 1 loose, 2 framed) and its tokens' hashes."""

    blocks: list[Block]
    kinds: list[int]
    tokens: list[list[int]]

    def stream(self, kind: int) -> np.ndarray:
        return np.array([t for k, own in zip(self.kinds, self.tokens, strict=True) if k == kind for t in own], np.uint64)


LOOSE, FRAMED = 1, 2


def _parsed(pages: list[list[Block]]) -> list[Parsed]:
    known: dict[str, int] = {}
    out = []
    for page in pages:
        best = max((b.main for b in page if not b.template), default=0)
        kinds = [0 if b.template or b.main < best or (b.doubtful and not best) else LOOSE if b.doubtful or not best else FRAMED for b in page]
        out.append(Parsed(page, kinds, _tokens([b.text if k else "" for b, k in zip(page, kinds, strict=True)], known)))
    return out


def _least(kind: int, pages: int) -> float:
    return PAGES if kind == LOOSE else max(PAGES, SHARE * pages)


def kept_texts(pages: list[list[Block]], host_pages: int | None = None, known: dict[int, tuple[np.ndarray, np.ndarray]] | None = None, parts: int = 1) -> list[str]:
    """The main texts of one group of a host's pages: all of them, or with the host's number of pages and by kind the counts of its repeated substrings (marks ascend)."""
    parsed, own = _parsed(pages), {}
    for kind in (LOOSE, FRAMED):
        found = substrings([p.stream(kind) for p in parsed])
        distinct = found.pages
        marks, counts = (known or {}).get(kind, (None, None))
        if marks is not None and len(marks):
            short = _short(found.mark, parts)
            at = np.minimum(np.searchsorted(marks, short), len(marks) - 1)
            distinct = np.where(marks[at] == short, counts[at], distinct)
        own[kind] = found.covered(distinct >= _least(kind, len(pages) if host_pages is None else host_pages))
    out = []
    for n, page in enumerate(parsed):
        kept, at = [], {LOOSE: 0, FRAMED: 0}
        for block, kind, words in zip(page.blocks, page.kinds, page.tokens, strict=True):
            if kind:
                hidden = own[kind][n][at[kind] : at[kind] + len(words)]
                at[kind] += len(words)
                if hidden.mean() < COVERED:
                    kept.append(block.text)
        out.append("\n".join(kept))
    return out


def main_texts(pages: list[str]) -> list[str]:
    """The main texts of a host's pages."""
    return kept_texts([blocks_of(p) for p in pages])


_PARSED = "host string, part int, parts int, host_pages long, pages binary"
_COUNTED = "kind int, host string, deal int, part int, marks binary, counts binary"
_COUNTED_SCHEMA = pa.schema([("kind", pa.int32()), ("host", pa.string()), ("deal", pa.int32()), ("part", pa.int32()), ("marks", pa.binary()), ("counts", pa.binary())])
#: Characters of html that a task parses before it hands the pages on.
HELD = 16 << 20


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, part, parts, host_pages, page, url, html) to packs of parsed pages (page, url, kinds, texts), one a host and part.

    A kind is a byte a block; a text has its blocks in lines. Packs are compressed, since they are shuffled.
    """
    names = ["host", "part", "parts", "host_pages", "pages"]

    def packed(held: dict) -> pa.RecordBatch:
        packs = [zstandard.compress(pickle.dumps(rows)) for rows in held.values()]
        cols = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)]
        return pa.record_batch([*cols, pa.array(packs, pa.binary())], names=names)

    held, have = {}, 0
    for batch in batches:
        keys = zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True)
        for (host, part, parts, n, page, url), cell in zip(keys, batch.column(6), strict=True):
            html = cell.as_py()
            blocks = blocks_of(html)
            kinds = bytes(b.main | b.doubtful << 2 | b.template << 3 for b in blocks)
            held.setdefault((host, part, parts, n), []).append((page, url, kinds, "\n".join(b.text for b in blocks)))
            have += len(html)
            if have > HELD:
                yield packed(held)
                held, have = {}, 0
    if held:
        yield packed(held)


def _pages(group: pa.Table) -> list[tuple[int | None, str | None, list[Block]]]:
    out = []
    for pack in group.column("pages").to_pylist():
        for page, url, kinds, text in pickle.loads(zstandard.decompress(pack)):
            out.append((page, url, [Block(t, bool(k & 8), bool(k & 4), k & 3) for t, k in zip(text.split("\n") if kinds else [], kinds, strict=True)]))
    return out


def _short(marks: np.ndarray, parts: int) -> np.ndarray:
    """As many bits of the marks as tell a host's substrings apart: all but some 2**-22 of them meet no other among 2**18 a part."""
    return marks >> np.uint64(64 - min(64, parts.bit_length() + 18 + 22))


def _pack(values: np.ndarray) -> bytes:
    """Ascending whole numbers as differences of four bytes, or of eight where one is larger."""
    steps = np.diff(values, prepend=np.uint64(0))
    small = not len(steps) or steps.max() < 1 << 32
    return (b"4" if small else b"8") + steps.astype(np.uint32 if small else np.uint64).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint32 if data[:1] == b"4" else np.uint64, offset=1), dtype=np.uint64)


def _counted_table(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_COUNTED_SCHEMA)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _COUNTED_SCHEMA.types, strict=True)], schema=_COUNTED_SCHEMA)


def _dealt(kind: int, host: str, part: int, parts: int, marks: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """Ascending marks with their counts, dealt by mark over as many tasks as the host has parts."""
    deal = marks % np.uint64(parts)
    return [(kind, host, int(d), part, _pack(marks[deal == d]), zstandard.compress(counts[deal == d].astype(np.int32).tobytes())) for d in np.unique(deal)]


def _of_group(group: pa.Table) -> tuple[str, int, int]:
    return tuple(group.column(c)[0].as_py() for c in ("host", "part", "parts"))


def _summed(found: Substrings, parts: int) -> tuple[np.ndarray, np.ndarray]:
    marks, at = np.unique(_short(found.mark, parts), return_inverse=True)
    return marks, np.bincount(at, weights=found.pages, minlength=len(marks)).astype(np.int64)


def _counts(group: pa.Table) -> pa.Table:
    """The substrings of one group of a host of several groups: all loose ones, and the framed ones on SHARE of the group's pages."""
    host, part, parts = _of_group(group)
    rows = []
    if parts > 1:
        parsed = _parsed([blocks for *_, blocks in _pages(group)])
        for kind in (LOOSE, FRAMED):
            marks, pages = _summed(substrings([p.stream(kind) for p in parsed]), parts)
            often = pages >= (1 if kind == LOOSE else SHARE * len(parsed))
            rows += _dealt(kind, host, part, parts, marks[often], pages[often])
    return _counted_table(rows)


def _recount(group: pa.Table, wanted: pa.Table) -> pa.Table:
    """One group's counts of the host's wanted framed substrings, none left out."""
    if not group.num_rows or not wanted.num_rows:
        return _counted_table([])
    host, part, parts = _of_group(group)
    ask = np.unique(np.concatenate([_unpack(x) for x in wanted.column("marks").to_pylist()]))
    marks, pages = _summed(substrings([p.stream(FRAMED) for p in _parsed([blocks for *_, blocks in _pages(group)])]), parts)
    at = np.minimum(np.searchsorted(marks, ask), max(len(marks) - 1, 0))
    counts = np.where(marks[at] == ask, pages[at], 0) if len(marks) else np.zeros(len(ask), np.int64)
    return _counted_table(_dealt(FRAMED, host, part, parts, ask, counts))


def _repeated(group: pa.Table) -> pa.Table:
    """The parts' counts of one kind, host and deal summed; each part gets back those of its substrings that are repeated."""
    marks = [_unpack(x) for x in group.column("marks").to_pylist()]
    counts = [np.frombuffer(zstandard.decompress(x), np.int32) for x in group.column("counts").to_pylist()]
    _, at = np.unique(np.concatenate(marks), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts)).astype(np.int32)
    rows, begin = [], 0
    for kind, host, deal, part, own in zip(*(group.column(c).to_pylist() for c in ("kind", "host", "deal", "part")), marks, strict=True):
        sums = total[at[begin : begin + len(own)]]
        begin += len(own)
        rows.append((kind, host, deal, part, _pack(own[sums >= PAGES]), zstandard.compress(sums[sums >= PAGES].tobytes())))
    return _counted_table(rows)


_TEXTS = pa.schema([("page", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def _texts_alone(group: pa.Table) -> pa.Table:
    return _texts_with(group, None)


def _texts_with(group: pa.Table, repeated: pa.Table | None) -> pa.Table:
    """The main texts of one group, given what the host repeats."""
    if not group.num_rows:
        return _TEXTS.empty_table()
    pages, known = _pages(group), {}
    for kind in (LOOSE, FRAMED) if repeated is not None and repeated.num_rows else ():
        rows = [r for r in repeated.to_pylist() if r["kind"] == kind]
        if rows:
            marks = np.concatenate([_unpack(r["marks"]) for r in rows])
            counts = np.concatenate([np.frombuffer(zstandard.decompress(r["counts"]), np.int32) for r in rows])
            by = np.argsort(marks)
            known[kind] = marks[by], counts[by]
    texts = kept_texts([blocks for *_, blocks in pages], group.column("host_pages")[0].as_py(), known, group.column("parts")[0].as_py())
    return pa.Table.from_arrays([pa.array([p[0] for p in pages], pa.int64()), pa.array([p[1] for p in pages], pa.string()), pa.array(texts, pa.string())], schema=_TEXTS)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group: int = GROUP) -> DataFrame:
    """(id, url, text, n_chars) of every row.

    A null html is an empty page with an empty text; null urls form a host of
    their own. Repeated rows count as pages of their own, null ids stay. Other columns, of
    any name, are ignored; an empty table gives an empty result. ``group`` says
    how many characters one suffix array takes; the result does not depend on it.
    """
    spark = pages.sparkSession
    common.bounded_batches(spark)
    host = F.regexp_extract(F.lower(F.coalesce(F.col(url_col), F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    rows = pages.select(host.alias("host"), F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), common.text_or_empty(html_col).alias("html"))
    sizes = rows.groupBy("host").agg(F.ceil(F.sum(F.length("html")) / group).cast("int").alias("parts"), F.count("*").alias("host_pages"))
    sizes = common.saved(sizes.where("parts > 1"), "hosts")  # hosts above one group: few, and counted
    several = sizes.count()
    dealt = rows.join(common.broadcast_if_small(sizes, several), "host", "left")
    own = F.pmod(F.xxhash64("page", "url", F.xxhash64("html")), F.col("parts")).cast("int")
    dealt = dealt.select("host", F.coalesce(own, F.lit(0)).alias("part"), F.coalesce("parts", F.lit(1)).alias("parts"), "host_pages", "page", "url", "html")
    parsed = dealt.mapInArrow(_parse, _PARSED)
    alone = parsed.groupBy("host", "part")
    counted = common.saved(alone.applyInArrow(_counts, _COUNTED), "counts") if several else None
    if counted is None or counted.isEmpty():
        found = alone.applyInArrow(_texts_alone, "page long, url string, text string")
    else:
        framed = counted.where(F.col("kind") == FRAMED).select("host", "marks")
        parts_of = sizes.select("host", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        asked = framed.join(parts_of, "host").groupBy("host", "part")
        recounted = alone.cogroup(asked).applyInArrow(_recount, _COUNTED) if not framed.isEmpty() else counted.limit(0)
        repeated = counted.where(F.col("kind") == LOOSE).union(recounted).groupBy("kind", "host", "deal").applyInArrow(_repeated, _COUNTED)
        found = alone.cogroup(repeated.groupBy("host", "part")).applyInArrow(_texts_with, "page long, url string, text string")
    return found.select(F.col("page").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
