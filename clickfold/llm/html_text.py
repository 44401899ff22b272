"""Main text of HTML pages, with boilerplate found by a suffix array per host.

Markup names most of what is not article. What is left of a host's pages comes together in
bounded stretches; there the token streams are concatenated and their suffixes sorted, which
gives every run of tokens with the number of pages it is on. Runs that a stretch alone cannot
decide are added up over the host in Spark and joined back to their pages, so that the result
depends on the host's pages and not on how they were dealt. Blocks that repeated runs cover are
boilerplate and go. Inside an article texts are quoted and copied, so there a block must stand
on nearly all pages of the host to go.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickfold.llm.scratch import Scratch

#: A run of at least so many tokens on at least so many distinct pages is boilerplate, and so
#: is a block that such runs cover to this share.
RUN, PAGES, COVERED = 8, 3, 0.8
#: A block inside an article is boilerplate on at least so many distinct pages of the host and
#: on this share of them.
ARTICLE_PAGES, ARTICLE_SHARE = 8, 0.8
#: Pages of a host per group; a larger host is dealt over several groups.
GROUP_PAGES = 512
#: Characters whose tokens are sorted at a time.
CHUNK_CHARS = 4_000_000

# Elements of HTML by what they mean here.
_RAW = "script|style|noscript|template|svg|math|textarea|iframe|object|title|xmp"
_SKIPPED = frozenset(
    "head nav footer aside form button select option menu dialog label fieldset input".split()
)
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol "
    "p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_CLOSED_BY_NEXT = frozenset("p li dt dd tr td th option".split())
_CLOSES_P = _BLOCKS
_WHOLE = frozenset("html body article main".split())
_NOT_ARTICLE = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside notice notices "
    "cookie cookies consent banner ad ads advert adverts advertisement advertising sponsored "
    "sponsor promo promotion comment comments reply replies respond share sharing social related "
    "recommended newsletter subscribe subscription popup modal overlay login signup search "
    "pagination pager toolbar widget copyright disclaimer".split()
)
_OTHER_ARTICLE = frozenset("comment reply related recommended ad advert promo sponsored".split())
_NOT_OUTSIDE = frozenset("header masthead topbar".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:--!?>|\Z)|<({_RAW})\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    # Quoted values end before the next tag, and nothing is tried twice: linear in the page.
    r"|<(/?)([a-z][^\s/>]*+)((?:[^<>\"']++|\"[^<\"]*+\"|'[^<']*+')*+)>"
    r"|<(/?)([a-z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+(?:>|\Z)|</?[a-z][^>]*+\Z|</>",
    re.IGNORECASE | re.DOTALL,
)
_NAMES = re.compile(
    r"\b(?:class|id|role|itemprop|aria-hidden|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?",
    re.IGNORECASE,
)
_WORDS = re.compile(r"[a-z0-9]+")


@dataclass
class Block:
    """Text of one block, and where it stands."""

    text: str
    skipped: bool
    article: bool
    main: bool


@dataclass
class _Parser:
    blocks: list[Block] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    # Open elements: name, skipped, inside an article, inside a main element.
    open: list[tuple[str, bool, bool, bool]] = field(default_factory=list)
    # Places of the open elements of a name, and of the open blocks.
    places: dict[str, list[int]] = field(default_factory=dict)
    blocks_open: list[int] = field(default_factory=list)

    def state(self) -> tuple[bool, bool, bool]:
        return self.open[-1][1:] if self.open else (False, False, False)

    def flush(self) -> None:
        if self.text:
            text = " ".join(html.unescape("".join(self.text)).split())
            self.text = []
            if text:
                self.blocks.append(Block(text, *self.state()))

    def start(self, name: str, rest: str) -> None:
        if name in _BLOCKS:
            self.flush()
            if name in _CLOSES_P:
                self.close_open("p")
        if name in _CLOSED_BY_NEXT:
            self.close_open(name)
        if name == "br":
            self.text.append("\n")
        if name in _VOID or rest.rstrip().endswith("/") and name not in _BLOCKS:
            return
        skipped, article, main = self.state()
        named = set()
        if rest.strip():
            for values in _NAMES.findall(rest):
                named.update(_WORDS.findall("".join(values).lower()))
        # The names of a whole page or article tell what it has, not what it is.
        telling = _OTHER_ARTICLE if name in _WHOLE else _NOT_ARTICLE
        if name in _SKIPPED or named & telling:
            skipped = True
        elif (name == "header" or named & _NOT_OUTSIDE) and not (article or main):
            skipped = True
        if name == "article" or "articlebody" in named:
            article = True
        if name == "main" or "main" in named and "role" in rest:
            main = True
        if skipped != self.state()[0]:
            self.flush()
        self.places.setdefault(name, []).append(len(self.open))
        if name in _BLOCKS:
            self.blocks_open.append(len(self.open))
        self.open.append((name, skipped, article, main))

    def cut(self, at: int) -> None:
        """Close all elements from a place on."""
        for name, *_ in self.open[at:]:
            self.places[name].pop()
            if name in _BLOCKS:
                self.blocks_open.pop()
        del self.open[at:]

    def close_open(self, name: str) -> None:
        """Close an element left open, unless another block began inside it."""
        at = self.places.get(name)
        if at and (not self.blocks_open or at[-1] >= self.blocks_open[-1]):
            self.flush()
            self.cut(at[-1])

    def end(self, name: str) -> None:
        at = self.places.get(name)
        if at:
            if name in _BLOCKS or self.open[at[-1]][1]:
                self.flush()
            self.cut(at[-1])


def parse_blocks(page: str) -> list[Block]:
    """The blocks of a page in order, white space collapsed and references decoded."""
    parser, at = _Parser(), 0
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            parser.text.append(page[at : token.start()])
        at = token.end()
        name = token[3] or token[6]
        if name:
            if token[2] or token[5]:
                parser.end(name.lower())
            else:
                parser.start(name.lower(), token[4] or token[7] or "")
        elif token[1]:
            parser.text.append(" ")
    if at < len(page):
        parser.text.append(page[at:])
    parser.flush()
    return parser.blocks


def suffix_array(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by prefix doubling, sorted by the first ``depth`` tokens (a power of
    two), and the rank of every suffix: equal ranks share these tokens."""
    rank, width = ids, 1
    while width < depth:
        following = np.concatenate([rank[width:], np.full(min(width, len(rank)), -1)])
        pair = (rank.astype(np.int64) << 32) + (following + 1)
        rank = np.unique(pair, return_inverse=True)[1]
        width *= 2
    return np.argsort(rank, kind="stable"), rank


def run_pages(
    ids: np.ndarray, pages: np.ndarray, asked: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """For every token, the rank of the run that starts there and the number of distinct pages
    on which that run starts at a token that is ``asked`` for.

    ``ids`` are the tokens of all streams, each stream closed by an id of its own, so that no
    run that repeats crosses streams; ``pages`` the page each token is on, ascending.
    """
    order, rank = suffix_array(ids, RUN)
    order = order[asked[order]]
    page, of = pages[order], rank[order]
    # Neighbours in the array that share a run, on another page than the one before.
    first = np.r_[True, of[1:] != of[:-1]]
    fresh = first | np.r_[True, page[1:] != page[:-1]]
    counts = np.bincount(of, fresh[: len(of)], minlength=int(rank.max(initial=0)) + 1)
    return rank, counts[rank].astype(np.int64)


# --- evidence ------------------------------------------------------------------------------


@dataclass
class Page:
    """The blocks of a page that markup lets pass, one per line, and for each whether it lies
    inside an article ("1"), else inside a main element ("m") or neither ("0")."""

    text: str
    inside: str

    @classmethod
    def of(cls, page: str) -> Page:
        kept = [b for b in parse_blocks(page) if not b.skipped]
        where = ["1" if b.article else "m" if b.main else "0" for b in kept]
        return cls("\n".join(b.text for b in kept), "".join(where))

    def blocks(self) -> list[str]:
        return self.text.split("\n") if self.inside else []


def _spans(blocks: list[str]) -> list[tuple[int, int]]:
    """First token and number of tokens of each block, in the page's stream."""
    spans, at = [], 0
    for block in blocks:
        n = block.count(" ") + 1
        spans.append((at, n))
        at += n
    return spans


def _key(kind: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}\n{text}") - (1 << 63)


#: page, start and length in the page's stream, whether inside an article, key (null: decided)
#: and the pages of the stretch that this row adds to the key's. A row of length 0 says of a key
#: that was decided here how often it occurs, for the host's other stretches.
Mark = tuple[int, int, int, bool, int | None, int]


def marks_of(pages: list[Page], alone: bool) -> list[Mark]:
    """What a stretch of distinct pages of one host says about their blocks.

    ``alone``: these are all pages of the host, so that every repeat is decided here. Otherwise
    runs on too few pages of the stretch, and blocks of articles, are given with their keys,
    to be added up over the host.
    """
    blocks = [page.blocks() for page in pages]
    spans = [_spans(b) for b in blocks]
    marks: list[Mark] = []
    # Whole blocks: those of articles, and those too short to hold a run.
    found: dict[int, list[tuple[int, int, int, bool, int]]] = {}
    for n, page in enumerate(pages):
        seen = set()
        for block, (start, length), inside in zip(blocks[n], spans[n], page.inside):
            if inside == "1" or length < RUN:
                key = _key(inside if inside == "1" else "0", block)
                place = (n, start, length, inside == "1", int(key not in seen))
                found.setdefault(key, []).append(place)
                seen.add(key)
    for key, places in found.items():
        on = sum(place[4] for place in places)
        article = places[0][3]
        if _common(on, len(pages), article) and (alone or not article):
            marks += [(*place[:4], None, 0) for place in places]
            if not alone:
                marks.append((places[0][0], 0, 0, False, key, on))
        elif not alone:
            marks += [(*place[:4], key, place[4]) for place in places]
    # Runs, wherever a page has anything outside articles.
    streams = [n for n, page in enumerate(pages) if page.inside.strip("1")]
    if streams:
        marks += _run_marks(pages, blocks, spans, streams, alone)
    return marks


def _common(on: int, of: int, article: bool) -> bool:
    if article:
        return on >= ARTICLE_PAGES and on >= ARTICLE_SHARE * of
    return on >= PAGES


def _run_marks(
    pages: list[Page],
    blocks: list[list[str]],
    spans: list[list[tuple[int, int]]],
    streams: list[int],
    alone: bool,
) -> Iterator[Mark]:
    known: dict[str, int] = {}
    ids: list[int] = []
    outside, sizes = [], []
    for n in streams:
        words = " ".join(blocks[n]).split(" ")
        ids += [known.setdefault(w, len(known)) for w in words]
        ids.append(-1)
        sizes.append(len(words) + 1)
        for (_, length), inside in zip(spans[n], pages[n].inside):
            outside.append(np.full(length, inside != "1"))
        outside.append([False])
    tokens = np.array(ids, np.int64)
    ends = np.flatnonzero(tokens < 0)
    tokens[ends] = len(known) + np.arange(len(ends))
    page = np.repeat(np.arange(len(streams)), sizes)
    first = np.cumsum([0, *sizes])[:-1]
    free = np.concatenate(outside)
    # A run counts where it ends before its page does and touches what is outside articles;
    # what articles have in common proves nothing.
    whole = np.arange(len(tokens)) + RUN <= ends[page]
    touched = np.concatenate([[0], np.cumsum(free)])
    until = np.minimum(np.arange(len(tokens)) + RUN, len(tokens))
    asked = whole & (touched[until] > touched[: len(tokens)])
    rank, on = run_pages(tokens, page, asked)
    known_runs = asked & (on >= PAGES)
    for begin, end in _stretches(known_runs):
        # Runs that start one after the other are one stretch of covered tokens.
        while begin < end:
            stop = min(end, ends[page[begin]])
            start, length = int(begin - first[page[begin]]), int(stop - begin) + RUN - 1
            yield streams[page[begin]], start, length, False, None, 0
            begin = stop
    if alone:
        return
    words = list(known)

    def key_of(at: int) -> int:
        return _key("r", " ".join(words[i] for i in tokens[at : at + RUN]))

    decided = np.flatnonzero(known_runs)
    for at in decided[np.unique(rank[decided], return_index=True)[1]].tolist():
        yield streams[page[at]], 0, 0, False, key_of(at), int(on[at])
    seen: set[tuple[int, int]] = set()
    for at in np.flatnonzero(asked & (on < PAGES)).tolist():
        place = (int(page[at]), int(rank[at]))
        start = int(at - first[place[0]])
        yield streams[place[0]], start, RUN, False, key_of(at), int(place not in seen)
        seen.add(place)


def _stretches(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return zip(edges[::2].tolist(), edges[1::2].tolist())


# --- choice --------------------------------------------------------------------------------


def chosen(page: Page, marks: list[tuple[int, int, bool]]) -> str:
    """Main text of a page, given its boilerplate as (start, length, inside an article).

    Of an article all blocks stay but those marked as such; if all are, the page is a copy of
    others rather than boilerplate, and they stay. What lies outside an article, or else outside
    the main element, stays where it is a unique run of its own, with short blocks that lead to
    it; a page with neither keeps all that is not covered.
    """
    blocks = page.blocks()
    spans = _spans(blocks)
    covered = np.zeros(sum(n for _, n in spans), bool)
    common = set()
    for start, length, article in marks:
        if article:
            common.add(start)
        else:
            covered[start : start + length] = True
    plain = [not covered[a : a + n].sum() >= COVERED * n for a, n in spans]
    region = next((r for r in "1m" if r in page.inside), None)
    keep = [False] * len(blocks)
    articles = [i for i, where in enumerate(page.inside) if where == "1"]
    own = [i for i in articles if spans[i][0] not in common]
    for i in own or articles:
        keep[i] = True
    for i in range(len(blocks) - 1, -1, -1):
        if page.inside[i] == "1" or not plain[i]:
            continue
        leads = i + 1 < len(blocks) and keep[i + 1] and page.inside[i + 1] == page.inside[i]
        keep[i] = region is None or page.inside[i] == region or spans[i][1] >= RUN or leads
    return "\n\n".join(b for b, k in zip(blocks, keep) if k)


def main_texts(pages: list[str]) -> list[str]:
    """Main text of each page, the given pages being all of their host."""
    read = [Page.of(page) for page in pages]
    # A copy of a page is no further page.
    distinct = list(dict.fromkeys(pages))
    place = {page: n for n, page in enumerate(distinct)}
    marks: list[list[tuple[int, int, bool]]] = [[] for _ in distinct]
    for n, start, length, article, _, _ in marks_of([read[pages.index(p)] for p in distinct], True):
        marks[n].append((start, length, article))
    return [chosen(page, marks[place[text]]) for page, text in zip(read, pages)]


# --- Spark ---------------------------------------------------------------------------------

_PARSED = "host string, part long, parts long, mix long, size long, text string, inside string"
_MARKS = (
    "host string, mix long, size long, start long, length long, article boolean, "
    "key long, pages long"
)


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of each page; of copies met by this task the first."""
    seen: set[tuple] = set()
    for batch in batches:
        rows = []
        for host, part, parts, mix, size, page in batch.itertuples(index=False, name=None):
            if (host, mix, size) not in seen:
                seen.add((host, mix, size))
                read = Page.of(page)
                rows.append((host, part, parts, mix, size, read.text, read.inside))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PARSED.split(", ")])


def _marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From pages sorted by group: their marks, a bounded stretch of one group at a time."""
    columns = [c.split()[0] for c in _MARKS.split(", ")]

    def done(rows: list[tuple], alone: bool) -> pd.DataFrame:
        marks = marks_of([Page(r[5], r[6]) for r in rows], alone)
        named = [(rows[m[0]][0], *rows[m[0]][3:5], *m[1:]) for m in marks]
        out = pd.DataFrame(named, columns=columns)
        out["key"] = pd.array(out["key"].tolist(), "Int64")
        return out

    rows, size, last, cut = [], 0, None, False
    for batch in batches:
        for row in batch.itertuples(index=False, name=None):
            if last is not None and row[:2] == last[:2] and row[3:5] == last[3:5]:
                continue
            ended = last is not None and row[:2] != last[:2]
            if rows and (ended or size > CHUNK_CHARS):
                cut = cut or not ended
                yield done(rows, last[2] == 1 and not cut)
                rows, size = [], 0
            if ended:
                cut = False
            rows.append(row)
            size += len(row[5])
            last = row
    if rows:
        yield done(rows, last[2] == 1 and not cut)


def _choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = []
        for page, marks in zip(batch["html"], batch["marks"]):
            given = [] if marks is None else [(m["start"], m["length"], m["article"]) for m in marks]
            texts.append(chosen(Page.of(page), given))
        yield pd.DataFrame({"id": batch["id"].astype("Int64"), "url": batch["url"], "text": texts})


def boilerplate(slim: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, mix, size, marks): the repeated runs and blocks of every page that has any, from
    pages with ``host``, ``html``, ``mix`` and ``size`` (a hash and the length of the html)."""
    hosts = slim.select("host", "mix", "size").distinct().groupBy("host").count()
    hosts = scratch.put(hosts.select("host", F.col("count").alias("host_pages")), "hosts")
    large = hosts.filter(F.col("host_pages") > GROUP_PAGES).select(
        "host", F.ceil(F.col("host_pages") / GROUP_PAGES).alias("parts")
    )
    large = scratch.put(large, "large-hosts")
    parts = F.coalesce("parts", F.lit(1))
    dealt = slim.join(large, "host", "left").select(
        "host", F.pmod("mix", parts).alias("part"), parts.alias("parts"), "mix", "size", "html"
    )
    parsed = dealt.mapInPandas(_parsed, _PARSED).filter("inside != ''")
    grouped = parsed.repartition("host", "part").sortWithinPartitions("host", "part", "mix", "size")
    marks = scratch.put(grouped.mapInPandas(_marked, _MARKS), "marks")
    open_marks = marks.filter(F.col("key").isNotNull())
    counted = open_marks.groupBy("host", "key", "article").agg(F.sum("pages").alias("pages"))
    enough = F.when(
        F.col("article"),
        (F.col("pages") >= ARTICLE_PAGES) & (F.col("pages") >= ARTICLE_SHARE * F.col("host_pages")),
    ).otherwise(F.col("pages") >= PAGES)
    likely = scratch.put(counted.filter(F.col("pages") >= PAGES), "likely")
    common = likely.join(hosts, "host").filter(enough).select("host", "key", "article")
    # Stored, so that Spark can split the join where a host or run is hot.
    common = scratch.put(common, "common")
    added = open_marks.filter("length > 0").join(common, ["host", "key", "article"], "left_semi")
    all_marks = marks.filter(F.col("key").isNull()).unionByName(added)
    one = F.struct("start", "length", "article")
    # As many as the page has tokens at most, whatever the number of its copies.
    return all_marks.groupBy("host", "mix", "size").agg(F.collect_list(one).alias("marks"))


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per input row: its id and url, ``text`` and ``n_chars`` (code points).

    Blocks are joined by an empty line; inside a block any white space is one blank. A null or
    empty page has the empty text. Pages without a host share one. A page's text depends on the
    distinct pages of its host, not on their order or grouping. Repeated rows give repeated
    results, copies of a page (equal in hash and length) count once as evidence, and an empty
    table gives an empty result. Other columns are not read.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    html_ = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    slim = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).alias("url"),
        html_.alias("html"),
        F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)).alias("host"),
    ).select("*", F.xxhash64("html").alias("mix"), F.char_length("html").cast("long").alias("size"))
    scratch = Scratch(pages.sparkSession, "html-text")
    marks = scratch.put(boilerplate(slim, scratch), "boilerplate")
    made = slim.join(marks, ["host", "mix", "size"], "left").select("id", "url", "html", "marks")
    texts = made.mapInPandas(_choose, "id long, url string, text string")
    return texts.select(
        F.col("id").alias(id_col),
        F.col("url").alias(url_col),
        "text",
        F.char_length("text").cast("long").alias("n_chars"),
    )
