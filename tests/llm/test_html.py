"""HTML extraction: blocks, suffix array and whole pages."""

import html
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickfold.llm import html_text
from tests.conftest import SF_DIR


def text_of(page):
    return html_text.main_texts([page])[0]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain &amp; simple\n\n text", "plain & simple text"),
        ("<article><p>a<p>b<br>c</article>d", "a\n\nb c"),
        ("<article><h1>T</h1><p><b>x<br><p>y</p></article>", "T\n\nx\n\ny"),
        ("<nav>n</nav><article>a<nav>m</nav>b</article><footer>f</footer>", "a\n\nb"),
        ("<header>h</header><article><header><h1>T</h1></header><p>x</article>", "T\n\nx"),
        ("<article>a<!-- <p>c</p> -->b<script>if (a<b) '</p>'</script></article>", "ab"),
        ("<article><p title='a>b' class=\"x\">t</p></article>", "t"),
        ("<ARTICLE><P>Up &lt;b&gt; &#233;&nbsp;&eacute;</P></ARTICLE>", "Up <b> é é"),
        ("<article><div class='ad'>buy</div><p>x<div class='comments'><p>c</div></article>", "x"),
        ("<main><p>m</p><aside>s</aside></main><p>o</p>", "m"),
        ("<div id=sidebar>s</div><div class=content><p>c</div><form>f</form>", "c"),
        ("<article>3 < 4 and 5 > 2</article>", "3 < 4 and 5 > 2"),
        ("<article><p>cut off <a href='x", "cut off"),
        ("<article><p>one <i>t</i>wo<span class=share>tweet</span> three</article>", "one two\n\nthree"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\n\nb\n\nc\n\nd"),
        ("<article class=comment>c</article><article>a</article>", "a"),
        ("<title>t</title><style>p{}</style><body class='has sidebar'><p>b</body>", "b"),
        ("</p></div><p>x</article>", "x"),
    ],
)
def test_blocks_of_a_page(page, text):
    assert text_of(page) == text


def repeated_by_hand(streams):
    """Tokens in runs of RUN that occur on PAGES streams."""
    on = {}
    for n, stream in enumerate(streams):
        for i in range(len(stream) - html_text.RUN + 1):
            on.setdefault(tuple(stream[i : i + html_text.RUN]), set()).add(n)
    out = []
    for stream in streams:
        marks = [False] * len(stream)
        for i in range(len(stream) - html_text.RUN + 1):
            if len(on[tuple(stream[i : i + html_text.RUN])]) >= html_text.PAGES:
                marks[i : i + html_text.RUN] = [True] * html_text.RUN
        out += [*marks, False]
    return out


def test_repeated_runs_equal_brute_force():
    random = np.random.default_rng(5)
    for _ in range(30):
        shared = random.integers(0, 6, (3, 14)).tolist()
        streams = []
        for _ in range(8):
            stream = random.integers(0, 6, random.integers(0, 30)).tolist()
            stream += shared[random.integers(3)] + random.integers(0, 6, 5).tolist()
            streams.append(stream)
        read = [html_text.Page(" ".join(map(str, stream)), "0") for stream in streams]
        covered = [np.zeros(len(stream), bool) for stream in streams]
        for n, start, length, article, key, _ in html_text.marks_of(read, True):
            assert not article and key is None
            covered[n][start : start + length] = True
        got = [x for c in covered for x in [*c.tolist(), False]]
        assert got == repeated_by_hand(streams)


def test_stretches_add_up_to_the_whole_host():
    """Marks of the parts of a host, keys counted over all of them, are those of the whole."""
    random = np.random.default_rng(6)
    lines = [" ".join(f"w{i}" for i in random.integers(0, 40, 12)) for _ in range(4)]
    lines += ["short line", "other"]
    pages = []
    for n in range(24):
        picked = random.choice(lines, 3, replace=False).tolist()
        blocks = [*picked, f"page {n} of its own with some more words here", "the same in articles"]
        where = "".join(random.choice(list("01m"), len(blocks) - 1)) + "1"
        pages.append(html_text.Page("\n".join(blocks), where))
    whole = {
        (n, t, article)
        for n, start, length, article, _, _ in html_text.marks_of(pages, True)
        for t in range(start, start + length)
    }
    parts, counts, rows = [range(0, 5), range(5, 6), range(6, 24)], {}, []
    for part in parts:
        for n, *mark, key, on in html_text.marks_of([pages[i] for i in part], False):
            rows.append((part[n], *mark, key))
            counts[key] = counts.get(key, 0) + on
    added = {
        (n, t, article)
        for n, start, length, article, key in rows
        if key is None or html_text._common(counts[key], len(pages), article)
        for t in range(start, start + length)
    }
    assert added == whole and any(a for *_, a in whole)


def test_suffix_array_is_sorted():
    ids = np.random.default_rng(2).integers(0, 3, 200)
    order, rank = html_text.suffix_array(ids, 8)
    keys = [tuple(ids[i : i + 8]) for i in order]
    assert keys == sorted(keys)
    assert all((rank[a] == rank[b]) == (tuple(ids[a : a + 8]) == tuple(ids[b : b + 8]))
               for a in range(50) for b in range(50))


def test_repeated_blocks_go_where_markup_says_nothing():
    line = "Read our terms of use before you go on reading here"
    pages = [f"<div>{line}</div><div>{f'own words of page {i} ' * 5}</div>" for i in range(5)]
    texts = html_text.main_texts(pages)
    assert texts == [" ".join((f"own words of page {i} " * 5).split()) for i in range(5)]
    # On two pages only it stays, and copies of a page are one page.
    assert line in html_text.main_texts(pages[:2])[0]
    assert line in html_text.main_texts([pages[0]] * 9)[0]


LINE = "Sign up for the letter that we send on Mondays"


def test_a_line_of_nearly_all_articles_goes():
    def inside(n, with_line):
        return [
            f"<article><p>page {i} tells this</p>{f'<p>{LINE}</p>' * (i < with_line)}</article>"
            for i in range(n)
        ]

    assert html_text.main_texts(inside(10, 10)) == [f"page {i} tells this" for i in range(10)]
    assert html_text.main_texts(inside(10, 8)) == [f"page {i} tells this" for i in range(10)]
    # A quotation in some articles stays, as does a line of few pages.
    assert html_text.main_texts(inside(10, 7))[0] == f"page 0 tells this\n\n{LINE}"
    assert html_text.main_texts(inside(7, 7))[0] == f"page 0 tells this\n\n{LINE}"
    # Pages that differ outside the article alone are copies of one text.
    copies = [f"<p>{i}</p><article><p>{LINE}</p></article>" for i in range(20)]
    assert html_text.main_texts(copies) == [LINE] * 20


def test_a_teaser_does_not_hide_the_story():
    story = "The story itself is long enough to be told from the rest"
    page = f"<div>Home</div><main><article>teaser</article><div><h2>Title</h2><p>{story}</div></main><p>x</p>"
    assert text_of(page) == f"teaser\n\nTitle\n\n{story}"
    # What repeats on the host is no story.
    pages = [f"<article>teaser {i}</article><div>{story}</div>" for i in range(3)]
    assert html_text.main_texts(pages) == [f"teaser {i}" for i in range(3)]


@pytest.mark.parametrize(
    "page",
    [
        "<a" + "n" * 1_000_000,
        "<a " * 300_000,
        "<a '" * 250_000,
        '<a ">x" ' * 120_000,
        "<a b='" + "<p " * 300_000,
        "<!--" * 250_000,
        "<script" * 140_000,
        "<script>" * 125_000,
        "</script " * 100_000 + " " * 100_000,
        "<p>" * 300_000,
        "<b>" * 300_000,
        "<div><p>" * 100_000 + "</p>" * 100_000,
    ],
)
def test_a_megabyte_of_open_markup_is_linear(page):
    started = time.process_time()
    text_of(page)
    assert time.process_time() - started < 10


def _pages(spark, rows):
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    return table.withColumns({c: F.lit("clash") for c in ("id", "host", "part", "parts", "mix", "size", "text", "marks", "key", "start")})


def test_awkward_rows(spark):
    long = "<article>" + "<p>many words " * 30_000 + "</article>"
    rows = [
        (1, None, None), (2, "x", ""), (None, "http://a/", "<p>x</p>"), (None, "http://a/", "<p>x</p>"),
        (3, "http://a/", long), (4, None, "<p>y</p>"), (4, None, "<p>y</p>"),
    ]
    got = html_text.extract_main_text(_pages(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {(r.page_id, r.text) for r in got}
    body = "\n\n".join(["many words"] * 30_000)
    assert texts == {(1, ""), (2, ""), (None, "x"), (3, body), (4, "y")}
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract_main_text(_pages(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [(20, 2_000), (1_000, 4_000_000)])
def test_results_do_not_depend_on_grouping(spark, monkeypatch, sizes):
    monkeypatch.setattr(html_text, "GROUP_PAGES", sizes[0])
    monkeypatch.setattr(html_text, "CHUNK_CHARS", sizes[1])
    line = "The same legal notice stands on each and every page"
    seldom = "A notice that only three pages of this host have got in all"
    rows = [
        (i, "http://one.host/", f"<p>{line}</p><p>page number {i}</p>" + f"<p>{seldom}</p>" * (i % 100 == 0))
        for i in range(300)
    ]
    # Copies of one page, and a host where the notice is on two pages only.
    rows += [(1000 + i, "http://one.host/c", f"<p>{seldom}</p><p>copied</p>") for i in range(150)]
    rows += [(2000 + i, "http://two.host/", f"<p>{seldom}</p><p>other {i}</p>") for i in range(2)]
    rows += [(3000 + i, "http://a.host/", f"<article><p>{LINE}</p>text {i}</article>") for i in range(40)]
    got = html_text.extract_main_text(_pages(spark, rows)).collect()
    want = [(i, f"page number {i}") for i in range(300)]
    want += [(1000 + i, "copied") for i in range(150)]
    want += [(2000 + i, f"{seldom}\n\nother {i}") for i in range(2)]
    want += [(3000 + i, f"text {i}") for i in range(40)]
    assert sorted((r.page_id, r.text) for r in got) == want


def test_articles_of_the_given_pages(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract_main_text(pages).collect()}
    for page in pages.collect():
        article = re.search("<article>(.*?)</article>", page.html, re.DOTALL)[1]
        blocks = [
            " ".join(html.unescape(re.sub("<[^>]+>", " ", b)).split())
            for b in re.split("</?(?:p|h1)>", article)
        ]
        assert got[page.page_id] == "\n\n".join(b for b in blocks if b)
