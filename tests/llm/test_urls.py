"""URL rules and language models against plain versions."""

import math

import numpy as np
import pandas as pd

from clickfold.llm import url_filter
from clickfold.llm.queries import URL_RULES

CLASH = "id host path rule ruled verdict score accepted bin run n key context good".split()


def pages(spark, urls):
    from pyspark.sql import functions as F

    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return table.withColumns({c: F.lit("clash") for c in CLASH})


def parts_by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min((rest.find(c) for c in "?#" if c in rest), default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def rule_by_hand(host, path):
    fits = [
        (len(h + p), h + p, verdict)
        for verdict, h, p in URL_RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    "http://a.example.org/es/1", "HTTPS://EXAMPLE.ORG/en/12?x=://y", "http://example.org/en/2",
    "http://org/", "http://org", "http://notorg/", "http://x.com/fr/", "http://x.com/fr",
    "http://x.com/de/#f", "http://com/de/", "ftp://x.net:80/a b", "no scheme", "", None, "://",
    "http://b.example.org?x=/es/", "http://é.org/ü", "http://x.net/", "http://x.net/",
    "http://x.org/\nline", "a://b://c.org/", "http://sub.x.com/de/9" * 2000,
]


def test_rules_equal_the_plain_definition(spark):
    got = url_filter.judge_urls(pages(spark, URLS), URL_RULES).collect()
    assert len(got) == len(URLS)
    for row in got:
        host, path = parts_by_hand(URLS[row.page_id])
        rule, verdict = rule_by_hand(host, path)
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict in ("allow", "block")
        if rule:
            assert row.verdict == verdict and row.score is None


def runs_by_hand(url):
    rest = (url or "").partition("://")[2].partition("#")[0]
    rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest)
    padded = url_filter.START * url_filter.ORDER + rest + url_filter.END
    return [padded[i : i + url_filter.RUN] for i in range(len(rest) + 1)]


def model_by_hand(urls):
    """Witten-Bell by recursion over the runs of some URLs."""
    after = {}
    for url in urls:
        for run in runs_by_hand(url):
            for k in range(1, url_filter.RUN + 1):
                tail = run[-k:]
                seen = after.setdefault(tail[:-1], {})
                seen[tail[-1]] = seen.get(tail[-1], 0) + 1
    return after


def chance_by_hand(after, run, symbols):
    chance = 1.0 / symbols
    for k in range(1, url_filter.RUN + 1):
        seen = after.get(run[-k:][:-1])
        if seen:
            total = sum(seen.values())
            chance = (seen.get(run[-1], 0) + len(seen) * chance) / (total + len(seen))
    return chance


def difference_by_hand(url, good, bad, symbols):
    of = [
        math.log(chance_by_hand(good, r, symbols)) - math.log(chance_by_hand(bad, r, symbols))
        for r in runs_by_hand(url)
    ]
    return sum(of) / len(of)


def test_verdicts_equal_the_plain_definition(spark):
    """The whole query against a plain version, calibration included."""
    random = np.random.default_rng(8)
    words = ["garden", "rose", "win", "cash", "é", "a", "b-c", "x?y=1", "Z"]

    def some(host, path):
        tail = "/".join(random.choice(words, random.integers(0, 4)))
        return f"http://{random.choice(words)}.{host}{path}{tail}{'#end' * int(random.integers(2))}"

    urls = [some("org", "/") for _ in range(150)] + [some("example.org", "/es/") for _ in range(60)]
    urls += [some("com", "/de/") for _ in range(120)] + [some("net", "/") for _ in range(80)]
    urls += URLS + urls[:40] + [urls[-1]] * 30
    got = url_filter.judge_urls(pages(spark, urls), URL_RULES).collect()
    ruled = [rule_by_hand(*parts_by_hand(u))[1] for u in urls]
    fold = {
        r.url: r.fold == 0
        for r in spark.createDataFrame([(u or "",) for u in urls], "url string")
        .selectExpr("url", f"pmod(xxhash64(url), {url_filter.CALIBRATION}) AS fold")
        .collect()
    }
    train = [(u, v) for u, v in zip(urls, ruled) if v and not fold[u or ""]]
    good = model_by_hand([u for u, v in train if v == "allow"])
    bad = model_by_hand([u for u, v in train if v == "block"])
    symbols = len({*good[""], *bad[""]}) + 1
    held = [
        (v == "allow", difference_by_hand(u, good, bad, symbols))
        for u, v in zip(urls, ruled)
        if v and fold[u or ""]
    ]
    assert {a for a, _ in held} == {True, False}
    least = None
    edges = [i / url_filter.BINS * 2 * url_filter.LIMIT - url_filter.LIMIT for i in range(url_filter.BINS + 1)]
    wrong = [
        np.mean([d < e for a, d in held if a]) + np.mean([d >= e for a, d in held if not a]) for e in edges
    ]
    best = [e for e, w in zip(edges, wrong) if w <= min(wrong) + 1e-12]
    least = (best[0] + best[-1]) / 2
    assert len(got) == len(urls)
    for row in got:
        url = urls[row.page_id]
        if ruled[row.page_id]:
            assert row.verdict == ruled[row.page_id] and row.score is None
        else:
            score = difference_by_hand(url, good, bad, symbols) - least
            assert math.isclose(row.score, score, abs_tol=1e-6)
            assert abs(score) < 1e-6 or row.verdict == ("allow" if score >= 0 else "block")


def test_the_model_grows_with_its_urls(spark):
    urls = [f"http://{i:05d}.org/{i * i}" for i in range(400)]
    labelled = spark.createDataFrame([(u, True) for u in urls], "url string, accepted boolean")
    small, large = (url_filter.model_table(labelled.limit(n)).count() for n in (40, 400))
    assert large > 4 * small
    after = model_by_hand(urls)
    rows = {(r.context, r.key): r for r in url_filter.model_table(labelled).collect()}
    for context, seen in after.items():
        row = rows[(True, context)]
        assert (row.good, row.good_kinds, row.bad) == (sum(seen.values()), len(seen), 0)
        assert all(rows[(False, context + c)].good == n for c, n in seen.items())


def test_threshold_weighs_both_kinds():
    bins = pd.DataFrame(
        {"accepted": [True] * 100 + [False] * 10, "bin": [*range(2000, 2100), *range(1990, 2000)], "n": 1}
    )
    assert url_filter.fit_threshold(bins) == 0.0
    edge = url_filter.fit_threshold(bins.assign(bin=bins["bin"] + 500))
    assert round((edge + url_filter.LIMIT) / (2 * url_filter.LIMIT) * url_filter.BINS) == 2500
    # A rejected URL among many accepted ones weighs as its share of its kind.
    mixed = pd.DataFrame({"accepted": [True, True, False], "bin": [3000, 1000, 1500], "n": [990, 10, 3]})
    edge = url_filter.fit_threshold(mixed)
    assert 1501 <= (edge + url_filter.LIMIT) / (2 * url_filter.LIMIT) * url_filter.BINS <= 3000
    assert url_filter.fit_threshold(bins[:100]) == url_filter.fit_threshold(bins[:0]) == 0.0


def test_unruled_urls_follow_the_models(spark):
    good = [f"http://garden{i}.org/flowers/rose-{i}" for i in range(200)]
    bad = [f"http://casino{i}.com/de/win-cash-{i}" for i in range(200)]
    asked = [f"http://garden{i}.net/flowers/tulip-{i}" for i in range(20)]
    asked += [f"http://casino{i}.net/de/win-cash-{i}" for i in range(20)]
    got = url_filter.judge_urls(pages(spark, good + bad + asked), URL_RULES).collect()
    judged = {r.page_id - 400: r.verdict for r in got if r.page_id >= 400}
    assert [judged[i] for i in range(20)] == ["allow"] * 20
    assert [judged[i] for i in range(20, 40)] == ["block"] * 20


def test_one_kind_of_label_or_none_allows_the_rest(spark):
    got = url_filter.judge_urls(pages(spark, ["http://a.org/", "http://b.net/"]), URL_RULES)
    assert {r.verdict for r in got.collect()} == {"allow"}
    got = url_filter.judge_urls(pages(spark, ["http://a.org/", None]), ()).collect()
    assert {(r.rule, r.verdict) for r in got} == {(None, "allow")}


def test_empty_table(spark):
    assert url_filter.judge_urls(pages(spark, ["http://a.org/"]).limit(0), URL_RULES).count() == 0


def test_a_url_of_a_million_characters(spark):
    url = "http://a.net/" + "xyz/" * 250_000
    rows = pages(spark, [url, "http://a.org/", "http://b.org/x", "http://c.com/de/"] * 3)
    got = url_filter.judge_urls(rows, URL_RULES).collect()
    assert len(got) == 12 and {len(r.path) for r in got if r.rule is None} == {1_000_001}
