"""Main text of web pages, by host suffix arrays.

Each page is parsed into blocks. Blocks of a host's pages, as streams of words with a mark between
blocks, are concatenated and their suffixes sorted; stretches of REPEAT words or more that stand in
at least two pages of different content are repeated runs, and what they cover is boilerplate of
the host. A block goes if repeated runs cover most of its words, and unique runs stay.

The page's own marks come first. What it marks as navigation, header, footer, sidebar, form, advert,
notice or comments (by element, role, class or id) outside its article is never text. Where it marks
its article (article or main elements), the blocks inside it are the text, repeated runs or not: an
article may quote passages that other pages have too, and copies of a page are pages. Inside, elements,
roles and whole names (STRONG, or one that starts with one of LEADING and goes on with words of layout)
still count; a name that an article's own section may have (DOUBTFUL: related, notice) counts where it holds
little text or mostly links, and ids of headings never do. A mark that is only a part of a longer name
(side-effects, cookie-recipe) counts, inside an article and outside, if repeated runs cover the block. Forms
go unless they hold an article or more than half of the page's words. A marked element inside another is part of it. Where several are marked, the one with the most words outside repeated runs
counts, and so do its siblings of any size, but for teasers: those with half of their words or more
in links, or mostly covered by repeated runs where that one is not. A page all of whose blocks are covered keeps its
unmarked blocks.

A host's pages are dealt to groups of about GROUP_PAGES and GROUP_BYTES by a hash of the page, so that
no host meets in one task. What repeats is found over the whole host: where a host of several groups has
a page whose text depends on repeated runs (none or several articles marked, or partial marks inside
one; most others are told by plain patterns, without parsing them twice), the stretches of REPEAT words
of its pages are counted by their hashes over all its groups, and those in two pages of different
content go back to the groups with such a page that holds them. Other hosts need no counts.

Defined cases: a null or empty html has an empty text; a null url has no host, and such pages form a
host of their own; repeated rows are each answered; pages without a mark and without a repeated run
keep all blocks; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegraph.llm.common import BROADCAST_BYTES, cut, load, slices

REPEAT, COVERED, LINKED, GROUP_PAGES, GROUP_BYTES = 8, 0.6, 0.5, 256, 16 << 20
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("aside button canvas datalist dialog footer head iframe input map menu meter nav noscript object progress script select style svg template textarea title video audio".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar alert dialog alertdialog".split())
#: Parts of class names and ids that mark what is not text.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus disclaimer footer foot gdpr header menu masthead modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted recommended related replies reply respond share sharing sidebar side social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split())
#: Those that mark it inside an article too, where they are whole names, or the first part of one whose other parts are marks or say where or what a block is.
STRONG = MARKS - frozenset("banner header side foot".split())
LEADING = frozenset("advert advertisement comment comments cookie cookies disqus gdpr newsletter sidebar breadcrumb breadcrumbs pagination".split())
LAYOUT = frozenset("area articles author bar block body bottom box button buttons container content count disclosure fixed form global group headlines icon icons inner item items label left link links list main message meta more news number outer overlay page policy post posts primary right row section secondary signup site slot stories text thread title top trail unit wrap wrapper".split())
#: Of these, those that an article's own section may be named by: they mark it only where it has little text.
DOUBTFUL = frozenset("disclaimer menu navigation notice notices notification promoted recommended related social tags".split())
#: The words from which text of such a section, not mostly links, is the article's.
OWN_WORDS = 50
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an opening tag of the key closes when they are still open.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SPACES = re.compile(r"\s+")
#: Forms and doubtful sections inside each other that are counted one by one; those further in share the fate of the last.
MOST_DOUBTS = 8


class Doubt:
    """A form, or a section of an article named by a doubtful mark: whether it is text shows at its end."""

    def __init__(self, is_form: bool):
        self.is_form, self.words, self.linked, self.holds_article = is_form, 0, 0, False

    def is_text(self, words: int) -> bool:
        """words: those of the whole page outside marks."""
        return self.holds_article or (2 * self.words > words if self.is_form else self.words >= OWN_WORDS and self.linked < LINKED * self.words)


class Parser(HTMLParser):
    """Blocks of a page outside all marks: (text, number of the outermost article that holds it or 0, whether a partial mark holds it, what it depends on)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, bool, tuple[Doubt, ...]]] = []  # name, skipped, article, partly marked, doubts
        self.names: Counter[str] = Counter()  # of the open elements
        self.blocks: list[tuple[str, int, bool, tuple[Doubt, ...]]] = []
        self.text: list[str] = []
        self.articles = self.words = 0
        self.linked: Counter[int] = Counter()  # words in links, by article

    def parse_marked_section(self, i: int, report: int = 1) -> int:  # as a bogus comment
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def _state(self) -> tuple[bool, int, bool, tuple[Doubt, ...]]:
        return self.open[-1][1:] if self.open else (False, 0, False, ())

    def end_block(self) -> None:
        if self.text:
            skipped, article, partly, doubts = self._state()
            text = SPACES.sub(" ", "".join(self.text)).strip()
            self.text = []
            if text and not skipped:
                self.blocks.append((text, article, partly, doubts))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        if tag in BLOCKS or tag in SKIPPED:
            self.end_block()
        if tag in BLOCKS:
            self._close_open("p", ("button", "td", "th", "table", "div", "section", "article", "li", "blockquote"))
        for name in CLOSES.get(tag, ()):
            self._close_open(name, ("ul", "ol", "dl", "table", "select", "menu"))
        if tag in VOID:
            return
        skipped, article, partly, doubts = self._state()
        if not skipped:
            mark = self._mark(tag, attrs)
            skipped = tag in SKIPPED or (tag == "header" and not article) or mark == "whole" or mark in ("layout", "doubtful") and not article
            partly = partly or mark in ("layout", "part")
            if not skipped and (tag == "form" or mark == "doubtful") and len(doubts) < MOST_DOUBTS:
                doubts = (*doubts, Doubt(tag == "form"))
            if tag in ("article", "main") and not skipped and not article:
                self.articles += 1
                article, partly = self.articles, False
                for d in doubts:
                    d.holds_article = True
        self.open.append((tag, skipped, article, partly, doubts))
        self.names[tag] += 1

    @staticmethod
    def _mark(tag: str, attrs: list[tuple[str, str | None]]) -> str:
        """What a class, id or role marks: "whole" for a name that is a mark, "doubtful" for one that an article's section may have, "layout" for one of marks and words of layout, "part" for one with another word in it, else ""."""
        if tag in ("html", "body", "article", "main"):
            return "whole" if tag == "article" and any(k in ("class", "id") and v and re.search(r"comment|reply", v, re.IGNORECASE) for k, v in attrs) else ""
        found = ""
        for k, v in attrs:
            if k == "hidden" or v and (k == "role" and v.lower() in ROLES and (tag != "form" or v.lower() != "form") or k == "aria-hidden" and v == "true" or k == "style" and re.search(r"display\s*:\s*none", v, re.IGNORECASE)):
                return "whole"
            if v and (k == "class" or k == "id" and tag not in HEADINGS):
                for name in v.lower().split():
                    parts = re.split("[_-]", name)
                    if MARKS.isdisjoint(parts):
                        continue
                    plain = all(p in MARKS or p in LAYOUT or p.isdigit() or not p for p in parts)
                    if name in DOUBTFUL:
                        found = "doubtful"
                    elif name in STRONG or parts[0] in LEADING and plain:
                        return "whole"
                    elif found != "doubtful":
                        found = "layout" if plain or found == "layout" else "part"
        return found

    def _drop(self, at: slice) -> None:
        for x in self.open[at]:
            self.names[x[0]] -= 1
        del self.open[at]

    def _close_open(self, name: str, barriers: tuple[str, ...]) -> None:
        if not self.names[name]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == name:
                self._drop(slice(k, k + 1))
                return
            if self.open[k][0] in barriers:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        if tag in BLOCKS or tag in SKIPPED:
            self.end_block()
        if not self.names[tag]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._drop(slice(k, k + 1) if tag not in BLOCKS and tag not in SKIPPED else slice(k, None))
                return
            if tag not in BLOCKS and tag not in SKIPPED and self.open[k][0] in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        skipped, article, _, doubts = self._state()
        if not skipped:
            self.text.append(data)
            linked = self.names["a"] > 0
            if doubts or linked and article:
                n = len(data.split())
                self.linked[article] += n * (linked and article > 0)
                for d in doubts:
                    d.words += n
                    d.linked += n * linked


def blocks_of(html: str | None) -> list[tuple[str, int, bool]]:
    """(text, article, partly marked): article is 0 outside all articles, less than 0 in one that is mostly links.

    A form is text if it holds an article or more than half of the page's words, as one around the whole page
    does; a doubtful section of an article if it has OWN_WORDS or more that are not mostly links, and then
    repeated runs may still remove it.
    """
    if not html:
        return []
    parser = Parser()
    parser.feed(html)
    parser.close()
    parser.end_block()
    if any(d for *_, d in parser.blocks):
        words = sum(len(t.split()) for t, *_ in parser.blocks)
        blocks = [(t, a, p or any(not x.is_form and not x.holds_article for x in d)) for t, a, p, d in parser.blocks if all(x.is_text(words) for x in d)]
    else:
        blocks = [x[:3] for x in parser.blocks]
    if not parser.linked:
        return blocks
    length: Counter[int] = Counter()
    for text, a, _ in blocks:
        length[a] += len(text.split())
    return [(t, -a if parser.linked[a] >= LINKED * length[a] and a else a, p) for t, a, p in blocks]


def articles_of(blocks: list[tuple[str, int, bool]]) -> set[int]:
    """Numbers of the marked articles; those that are mostly links only where there are no others."""
    return {a for _, a, _ in blocks if a > 0} or {a for _, a, _ in blocks if a}


def suffix_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the words, and for each suffix in it the words that it shares with the one before.

    Prefix doubling, in which only suffixes that still share their rank are ranked again.
    """
    n = len(words)
    ordered = np.sort(words)
    rank, span, levels = np.searchsorted(ordered, words), 1, []
    while True:
        levels.append(rank.copy())
        active = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(active):
            break
        after = np.where(active + span < n, rank[np.minimum(active + span, n - 1)], -1)
        by = np.lexsort((after, rank[active]))
        active, after = active[by], after[by]
        old, at = rank[active], np.arange(len(active))
        outer = np.concatenate([[True], old[1:] != old[:-1]])
        inner = outer | np.concatenate([[True], after[1:] != after[:-1]])
        rank[active] = old + np.maximum.accumulate(np.where(inner, at, 0)) - np.maximum.accumulate(np.where(outer, at, 0))
        span *= 2
    order = np.argsort(rank)
    shared = np.zeros(n, np.int64)
    if n > 1:
        a, b = order[:-1].copy(), order[1:].copy()
        for k in range(len(levels) - 1, -1, -1):
            same = (np.maximum(a, b) + (1 << k) <= n) & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
            step = same.astype(np.int64) << k
            shared[1:] += step
            a, b = a + step, b + step
    return order, shared


def hash_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def windows(blocks: list[str], length: int = REPEAT) -> np.ndarray:
    """Hashes of the stretches of `length` words of a page, by where they start; marks between blocks count as words."""
    names: dict[str, int] = {}
    words: list[int] = []
    for text in blocks:
        words += [names.get(w) or names.setdefault(w, hash_of(w)) for w in text.split()]
        words.append(1)
    w, n = np.asarray(words, np.uint64), len(words) - length + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(length if n > 0 else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + w[j : j + n]
    return out


def repeated(pages: list[list[str]], length: int = REPEAT, more: np.ndarray | None = None) -> list[np.ndarray]:
    """For each page, given as its blocks' texts, the share of each block's words that repeated runs cover.

    Pages of the same words are one page. more: hashes of stretches that repeat outside these pages.
    """
    names: dict[str, int] = {}
    words: list[int] = []
    page_of, spans, begins = [], [], []
    distinct: dict[str, tuple[int, int]] = {}  # to the place of its blocks among the spans
    for blocks in pages:
        name = "\n".join(blocks)
        if name in distinct:
            continue
        begins.append((len(words), blocks))
        distinct[name] = (len(spans), len(spans) + len(blocks))
        for text in blocks:
            ids = [names.setdefault(w, len(names) + 1) for w in text.split()]
            spans.append((len(words), len(words) + len(ids)))
            words += ids
            words.append(0)  # between blocks
        words.append(-len(distinct))  # between pages, never twice the same
        page_of += [len(distinct)] * (len(words) - len(page_of))
    covered = np.zeros(len(words) + 1, np.int64)
    if words:
        order, shared = suffix_order(np.asarray(words, np.int64))
        run = np.cumsum(shared < length)
        page, n = np.asarray(page_of, np.int64)[order], len(distinct) + 1
        often = np.bincount(np.unique(run * n + page) // n, minlength=run[-1] + 1) > 1
        starts = order[often[run]]
        if more is not None:
            starts = np.concatenate([starts, *(b + np.flatnonzero(np.isin(windows(p, length), more)) for b, p in begins)])
        np.add.at(covered, starts, 1)
        np.add.at(covered, np.minimum(starts + length, len(words)), -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    share = [(inside[hi] - inside[lo]) / max(1, hi - lo) for lo, hi in spans]
    return [np.asarray(share[slice(*distinct["\n".join(blocks)])]) for blocks in pages]


def depends(blocks: list[tuple[str, int, bool]]) -> bool:
    """Whether repeated runs can change the text of a page."""
    marked = articles_of(blocks)
    return bool(blocks) and (len(marked) != 1 or any(p for _, a, p in blocks if a in marked))


def plainly_independent(html: Column) -> Column:
    """True only for pages that depends() would deny, told without parsing: what is sure for most pages of a common make.

    The page has one article element, without attributes, with text in it, and no main element; before it,
    once comments and whole simple elements are taken out, stand the tags of html and body alone; and
    after it no element has a class or an id, so that none is marked by a part of a name.
    """
    low = F.lower(html)
    before, after = F.substring_index(low, "<article", 1), F.substring_index(low, "<article", -1)
    bare = F.regexp_replace(before, r"(?s)<!--.*?-->", "")
    bare = F.regexp_replace(bare, r"(?s)<(head|script|style|nav|header|div)\b[^>]*>.*?</\1\s*>", "")
    once = (F.length(before) + F.length(after) + len("<article") == F.length(low)) & ~low.contains("<main")
    starts = bare.rlike(r"^\s*(<!doctype[^>]*>)?\s*<html[^>]*>\s*<body[^>]*>\s*$")
    text = after.rlike(r"^>\s*(<(h[1-6]|p|b|i|em|strong)>\s*){0,4}[^<\s&]") & ~after.rlike(r"[\s/\"'](class|id)\s*=") & ~after.contains("hidden")
    return F.coalesce(once & starts & text, F.lit(False))


def main_text(blocks: list[tuple[str, int, bool]], covered: np.ndarray) -> str:
    """The text of a page from its blocks and their covered shares."""
    marked = articles_of(blocks)
    if marked:
        size = dict.fromkeys(marked, 0.0)
        length = dict.fromkeys(marked, 0)
        for (text, a, _), c in zip(blocks, covered, strict=True):
            if a in marked:
                size[a] += len(text.split()) * (1 - c)
                length[a] += len(text.split())
        best = max(marked, key=lambda a: (size[a], length[a], -abs(a)))
        own = {a for a in marked if size[a] > (1 - COVERED) * length[a]}
        kept = own if best in own else marked  # on a copy, runs tell no teasers
        return "\n\n".join(t for (t, a, partly), c in zip(blocks, covered, strict=True) if a in kept and not (partly and c >= COVERED))
    kept = [t for (t, _, _), c in zip(blocks, covered, strict=True) if c < COVERED]
    return "\n\n".join(kept or [t for t, _, _ in blocks])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars. Pages are parsed where they are read; only their blocks shuffle."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            found = [blocks_of(h) for h in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array([[x[k] for x in b] for b in found], pa.list_(t)) for k, t in enumerate((pa.string(), pa.int32(), pa.bool_())))], ["page_id", "url", "host", "part", "blocks", "articles", "partly"])

    def find_dependent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: set[str] = set()
        for batch in slices(batches, 64):
            found = {host for host, html in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True) if host not in hosts and depends(blocks_of(html))}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["host"])
            if len(hosts) < 10_000:
                hosts |= found

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            for host, part, html in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                blocks = blocks_of(html)
                texts = [x[0] for x in blocks]
                found = np.unique(windows(texts)).view(np.int64)
                page = np.uint64(hash_of("\n".join(texts))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(found), pa.string()), pa.array(found), pa.array(np.full(len(found), page)), pa.array([part if depends(blocks) else None] * len(found), pa.int32())], ["host", "hash", "page", "part"])

    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    sizes = cut(rows.groupBy("host").agg(F.greatest(F.ceil(F.count(F.lit(1)) / GROUP_PAGES), F.ceil(F.sum(F.octet_length("html")) / GROUP_BYTES)).cast("int").alias("groups")).where("groups > 1").select(F.col("host").alias("_host"), "groups"))
    small = lambda t: F.broadcast(t) if t.count() * 64 <= BROADCAST_BYTES else t
    part = F.coalesce(F.pmod(F.xxhash64("page_id", "url", "html"), F.col("groups")), F.lit(0)).cast("int")
    rows = rows.join(small(sizes), F.col("host") == F.col("_host"), "left").select("page_id", "url", "host", part.alias("part"), "html", F.col("groups").isNotNull().alias("dealt"))
    dealt, rows = rows.where("dealt").drop("dealt"), rows.drop("dealt")
    parsed = rows.mapInArrow(parse, "page_id long, url string, host string, part int, blocks array<string>, articles array<int>, partly array<boolean>")
    result = "page_id long, url string, text string, n_chars long"

    def choose(table: pa.Table, more: np.ndarray | None = None) -> pa.Table:
        blocks, articles, partly = (table[c].to_pylist() for c in ("blocks", "articles", "partly"))
        texts = [main_text(list(zip(*parts, strict=True)), c) for *parts, c in zip(blocks, articles, partly, repeated(blocks, more=more), strict=True)]
        return pa.table({"page_id": table["page_id"], "url": table["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    def choose_by(table: pa.Table, more: pa.Table) -> pa.Table:
        return choose(table, more["hash"].to_numpy().view(np.uint64))

    dependent = cut(dealt.where(~plainly_independent(F.col("html"))).mapInArrow(find_dependent, "host string").distinct().select(F.col("host").alias("_host")))
    if dependent.isEmpty():
        return parsed.groupBy("host", "part").applyInArrow(lambda table: choose(table), result)
    found = dealt.join(small(dependent), F.col("host") == F.col("_host"), "left_semi").mapInArrow(hashes, "host string, hash long, page long, part int")
    found = found.groupBy("host", "hash").agg(F.min("page").alias("first"), F.max("page").alias("last"), F.collect_set("part").alias("parts")).where("first <> last").select("host", F.explode("parts").alias("part"), "hash")
    return parsed.groupBy("host", "part").cogroup(found.groupBy("host", "part")).applyInArrow(choose_by, result)


def op7_main_text(spark, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages"))
