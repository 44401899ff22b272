"""URL filters: rules first, then the ratio of two character language models.

Every URL a rule accepts or rejects counts into a smoothed variable-order Markov model of its
kind. Any other URL is judged by the difference of its log-likelihoods under the two models,
per character, against a threshold calibrated on ruled URLs of both kinds that were left out.

The models are tables: a row per run of characters that occurs, whatever their number. Scoring
looks up each distinct run of the URLs in question once, with all its shorter contexts.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickfold.llm.scratch import Scratch

#: (verdict, host, path): a rule fits its host and all subdomains below the path.
Rule = tuple[str, str, str]

ALLOW, BLOCK = "allow", "block"

#: Characters that are seen before the next, at most; a run is these and the next.
ORDER = 5
RUN = ORDER + 1
#: Stand before the first character and after the last.
START, END = "\x02", "\x03"
#: One in so many labelled URLs calibrates the threshold and does not count into a model.
CALIBRATION = 5
#: Scores of calibrating URLs are counted in so many bins between -LIMIT and LIMIT.
BINS, LIMIT = 4000, 4.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- runs of characters ----------------------------------------------------------------------


def runs(url: Column) -> Column:
    """The run that ends at every character (and at the end) of a URL, after the scheme and
    without a fragment; A-Z count as a-z. Linear in its length: the characters, shifted by 0 to
    :data:`ORDER` places, are laid side by side."""
    rest = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^#]*)", 1), _UPPER, _LOWER)
    characters = F.filter(F.split(rest, ""), lambda c: c != "")
    padded = F.concat(F.array(*[F.lit(START)] * ORDER), characters, F.array(F.lit(END)))
    length = F.char_length(rest) + 1
    shifted = [F.slice(padded, 1 + d, length).alias(f"c{d}") for d in range(RUN)]
    return F.transform(
        F.arrays_zip(*shifted), lambda z: F.concat(*(z[f"c{d}"] for d in range(RUN)))
    )


def _tail(run: Column, length: int) -> Column:
    return run.substr(F.lit(RUN - length + 1), F.lit(length))


def model_table(labelled: DataFrame) -> DataFrame:
    """The counts behind both models, from (url, accepted).

    A row per run of 1 to :data:`RUN` characters (``context`` false) with its counts ``good``
    and ``bad``, and one per context of 0 to :data:`ORDER` characters (``context`` true) with its
    counts and the numbers of different characters seen after it, ``good_kinds`` and
    ``bad_kinds``. Copies are counted before they are cut up.
    """
    urls = labelled.groupBy("url", "accepted").agg(F.count(F.lit(1)).alias("n"))
    cut = urls.select(F.explode(runs(F.col("url"))).alias("run"), "accepted", "n")
    longest = cut.groupBy("run").agg(
        F.sum(F.when(F.col("accepted"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("accepted"), 0).otherwise(F.col("n"))).alias("bad"),
    )
    tails = F.array(*(_tail(F.col("run"), k) for k in range(1, RUN + 1)))
    seen = (
        longest.select(F.explode(tails).alias("key"), "good", "bad")
        .groupBy("key")
        .agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    )
    before = F.col("key").substr(F.lit(1), F.char_length("key") - 1)
    contexts = seen.groupBy(before.alias("key")).agg(
        F.sum("good").alias("good"),
        F.sum("bad").alias("bad"),
        F.count_if(F.col("good") > 0).alias("good_kinds"),
        F.count_if(F.col("bad") > 0).alias("bad_kinds"),
    )
    none = F.lit(0).cast("long")
    return seen.select(
        F.lit(False).alias("context"), "key", "good", "bad", none.alias("good_kinds"), none.alias("bad_kinds")
    ).unionByName(contexts.select(F.lit(True).alias("context"), "*"))


def _chance(kind: str, symbols: int) -> Column:
    """Probability of a run's last character after its context, Witten-Bell smoothed: a context
    gives way to the next shorter one in proportion to the number of different characters seen
    after it, so that an unseen context has no weight."""
    chance = F.lit(1.0 / symbols)
    for k in range(1, RUN + 1):
        seen, total, kinds = (F.coalesce(f"{c}{k}", F.lit(0)) for c in (kind, f"{kind}_total", f"{kind}_kinds"))
        # Of an unseen context all three are 0, and a weight of 1 hands the chance on.
        kinds = F.greatest(kinds, F.lit(1))
        chance = (seen + kinds * chance) / (total + kinds)
    return chance


def run_ratios(wanted: DataFrame, model: DataFrame) -> DataFrame:
    """(run, ratio): log of the chance under accepted URLs less that under rejected ones, for
    distinct runs. Every run asks for its tails and their contexts; one join answers all."""
    symbols = model.filter(~F.col("context") & (F.char_length("key") == 1)).count() + 1
    # The empty context is one row, which every run would ask for.
    base = model.filter(F.col("context") & (F.col("key") == "")).first()
    asked = []
    for k in range(1, RUN + 1):
        tail = _tail(F.col("run"), k)
        asked.append(F.struct(F.lit(k).alias("k"), F.lit(False).alias("context"), tail.alias("key")))
        if k > 1:
            context = tail.substr(F.lit(1), F.lit(k - 1))
            asked.append(F.struct(F.lit(k).alias("k"), F.lit(True).alias("context"), context.alias("key")))
    rows = wanted.select("run", F.explode(F.array(*asked)).alias("a")).select("run", "a.*")
    found = rows.join(model, ["context", "key"], "left")
    columns = []
    for kind in ("good", "bad"):
        for k in range(1, RUN + 1):
            at = F.col("k") == k
            columns.append(F.max(F.when(at & ~F.col("context"), F.col(kind))).alias(f"{kind}{k}"))
            if k > 1:
                in_context = at & F.col("context")
                columns.append(F.max(F.when(in_context, F.col(kind))).alias(f"{kind}_total{k}"))
                columns.append(
                    F.max(F.when(in_context, F.col(f"{kind}_kinds"))).alias(f"{kind}_kinds{k}")
                )
            else:
                columns.append(F.max(F.lit(base[kind])).alias(f"{kind}_total1"))
                columns.append(F.max(F.lit(base[f"{kind}_kinds"])).alias(f"{kind}_kinds1"))
    told = found.groupBy("run").agg(*columns)
    return told.select("run", (F.log(_chance("good", symbols)) - F.log(_chance("bad", symbols))).alias("ratio"))


def url_scores(urls: DataFrame, model: DataFrame, scratch: Scratch) -> DataFrame:
    """(url, difference): mean log-ratio per character of distinct URLs."""
    # URLs are small but become many rows each, so that they go to a fixed number of tasks. It
    # differs from the usual one, with which Spark would take the step as done already.
    parts = 2 * int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A number stands for the URL, which may be long, in its many rows; stored, as it holds for one
    # reading only.
    numbered = urls.select("url", F.monotonically_increasing_id().alias("url_id"))
    numbered = scratch.put(numbered, "asked")
    dealt = numbered.repartition(parts, "url_id")
    cut = dealt.select("url_id", F.explode(runs(F.col("url"))).alias("run"))
    cut = cut.groupBy("url_id", "run").agg(F.count(F.lit(1)).alias("n"))
    # Stored, so that Spark can split the join where very many URLs share a run.
    cut = scratch.put(cut, "cut")
    ratios = scratch.put(run_ratios(cut.select("run").distinct(), model), "ratios")
    weighted = F.sum(F.col("n") * F.col("ratio")) / F.sum("n")
    scored = cut.join(ratios, "run").groupBy("url_id").agg(weighted.alias("difference"))
    return numbered.join(scored, "url_id").select("url", "difference")


# --- verdicts ----------------------------------------------------------------------------------


def fit_threshold(bins: pd.DataFrame) -> float:
    """The score that tells accepted from rejected URLs with the least sum of both error shares,
    from columns ``accepted``, ``bin`` and ``n``; the middle one where several do. 0 where one
    kind has none."""
    counts = []
    for kind in (True, False):
        part = bins[bins["accepted"].astype(bool) == kind]
        counts.append(np.bincount(part["bin"].astype(int), part["n"], minlength=BINS))
    good, bad = counts
    if not good.sum() or not bad.sum():
        return 0.0
    # At edge i, bins from i on are allowed.
    lost = np.r_[0, np.cumsum(good)] / good.sum()
    passed = 1 - np.r_[0, np.cumsum(bad)] / bad.sum()
    wrong = lost + passed
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float(best[0] + best[-1]) / 2 / BINS * 2 * LIMIT - LIMIT


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without a scheme mark."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(text, parts, 1), _UPPER, _LOWER)
    return host, F.regexp_extract(text, parts, 2)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null where none does."""
    name = verdict = None
    for says, at, below in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(below)
        name = F.when(fits, at + below) if name is None else name.when(fits, at + below)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    if name is None:
        name = verdict = F.lit(None).cast("string")
    return name, verdict


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """One row per input row: its id, ``host``, ``path``, ``rule``, ``verdict`` and ``score``
    (log-likelihood difference per character less the threshold; null under a rule).

    A URL no rule fits is allowed from score 0 on. Where the rules accept or reject nothing
    there is no second model to compare with, and all such URLs are allowed, with score 0. A
    null URL, or one without ``://``, has an empty host and path and is judged by its lack of
    characters. Repeated rows count as often as they occur; an empty table gives an empty
    result. Other columns are not read.

    Each distinct URL is scored once. What moves are URLs and their runs of characters; the
    driver learns two counts and a histogram of fixed size.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = host_and_path(F.col("url"))
    slim = pages.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
    )
    parted = slim.select("id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = parted.select("*", rule.alias("rule"), verdict.alias("ruled"))
    labelled = ruled.filter("rule IS NOT NULL").select(
        "url", (F.col("ruled") == ALLOW).alias("accepted")
    )
    calibrates = F.pmod(F.xxhash64("url"), F.lit(CALIBRATION)) == 0
    model = scratch.put(model_table(labelled.filter(~calibrates)), "model")
    kinds = model.agg(F.max("good").alias("good"), F.max("bad").alias("bad")).first()
    if not kinds.good or not kinds.bad:
        scores = slim.select("url").distinct().withColumn("difference", F.lit(0.0))
        threshold = 0.0
    else:
        asked = ruled.filter(F.col("rule").isNull() | calibrates).select("url").distinct()
        scores = scratch.put(url_scores(asked, model, scratch), "scores")
        place = F.floor((F.col("difference") + LIMIT) / (2 * LIMIT) * BINS)
        bins = (
            labelled.filter(calibrates)
            .join(scores, "url")
            .select("accepted", F.greatest(F.lit(0), F.least(F.lit(BINS - 1), place)).alias("bin"))
            .groupBy("accepted", "bin")
            .agg(F.count(F.lit(1)).alias("n"))
            .toPandas()
        )
        threshold = fit_threshold(bins)
    # Only URLs without a rule look their score up.
    open_ = ruled.filter(F.col("rule").isNull()).join(scores, "url", "left")
    score = F.col("difference") - F.lit(threshold)
    own = F.when(score >= 0, ALLOW).otherwise(BLOCK)
    judged = open_.select("id", "host", "path", "rule", own.alias("verdict"), score.alias("score"))
    by_rule = ruled.filter(F.col("rule").isNotNull()).select(
        "id", "host", "path", "rule", F.col("ruled").alias("verdict"), F.lit(None).cast("double").alias("score")
    )
    return by_rule.unionByName(judged).withColumnRenamed("id", id_col)
