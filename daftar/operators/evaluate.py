"""Scores of searches: recall, reciprocal rank, scoreboards, intervals, latency and mixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daftar.operators.order import running_counts

RESAMPLES, SEED = 10_000, 20260923


def per_question(expected: DataFrame, hits: DataFrame, k: int, decimals: int = 6) -> DataFrame:
    """(query_id, recall, rr): ``expected`` (query_id, id) with duplicates counting, ``hits`` (query_id, id, rank)."""
    best = hits.where(F.col("rank") <= k).groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    joined = expected.join(best, ["query_id", "id"], "left")
    rank = F.min("rank")
    return joined.groupBy("query_id").agg(F.round(F.avg(F.when(F.col("rank").isNotNull(), 1.0).otherwise(0.0)), decimals).alias("recall"), F.round(F.coalesce(1.0 / rank, F.lit(0.0)), decimals).alias("rr"))


def scoreboard(questions: DataFrame, scores: DataFrame, decimals: int = 4) -> DataFrame:
    """(category, questions, scored, recall, mrr) per category and in TOTAL; unanswerable questions count but are not scored.

    ``questions`` (query_id, category, answerable); averages of no score are null."""
    rows = questions.join(scores, "query_id", "left").withColumn("scored", F.col("answerable") & F.col("recall").isNotNull())
    out = rows.rollup("category").agg(
        F.grouping("category").alias("g"),
        F.count("*").alias("questions"),
        F.count_if("scored").alias("scored"),
        F.round(F.avg(F.when(F.col("scored"), F.col("recall"))), decimals).alias("recall"),
        F.round(F.avg(F.when(F.col("scored"), F.col("rr"))), decimals).alias("mrr"),
    )
    return out.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.coalesce("category", F.lit("(none)"))).alias("category"), "questions", "scored", "recall", "mrr")


def bootstrap_interval(values: DataFrame, value: str, order: str, resamples: int = 1000, seed: int = SEED, decimals: int = 6) -> DataFrame:
    """One row (n, mean, low, high): percentile bootstrap of the mean.

    The index of draw i of resample b is the first 8 hex digits of md5('seed:b:i') modulo n, so any engine draws the same.
    Draws are joined to the values by position; nothing is collected."""
    at = running_counts(values.select(F.col(value).alias("v"), F.col(order).alias("o")), [], ["o"]).select("v", F.col("before").alias("i"))
    n = at.agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    draws = values.sparkSession.range(resamples).withColumnRenamed("id", "b").crossJoin(F.broadcast(n)).where("n > 0")
    draws = draws.select("b", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("draw"))
    index = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("bigint") % F.col("n")
    means = draws.select("b", index.alias("i")).join(at, "i").groupBy("b").agg(F.avg("v").alias("m"))
    place = means.withColumn("r", F.row_number().over(Window.orderBy("m", "b")) - 1)
    low, high = int(0.025 * resamples), min(resamples - 1, int(0.975 * resamples))
    bounds = place.agg(F.max(F.when(F.col("r") == low, F.col("m"))).alias("low"), F.max(F.when(F.col("r") == high, F.col("m"))).alias("high"))
    return n.crossJoin(bounds).select("n", *[F.round(c, decimals).alias(c) for c in ("mean", "low", "high")])


def latency_summary(samples: DataFrame, group: str, value: str, decimals: int = 4) -> DataFrame:
    """(group, n, median, p95, min, max, mean): p95 is the nearest rank round(0.95 n + 0.5), halves to the even one."""
    # equal values are counted before anything is sorted, and positions are found without sorting a group in one task
    counts = samples.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    placed = running_counts(counts, ["g"], ["v"], "c")
    totals = counts.groupBy("g").agg(F.sum("c").alias("n"))
    n, low, high = F.col("n"), F.col("before"), F.col("before") + F.col("c")
    at = lambda place: F.max(F.when((low < place) & (place <= high), F.col("v")))
    place = F.least(n, F.greatest(F.lit(1), F.bround(n * F.lit(95) / F.lit(100) + F.lit(0.5), 0).cast("bigint")))
    out = placed.join(totals, "g").groupBy("g", "n").agg(
        at(F.floor((n + 1) / 2)).alias("left"), at(F.floor(n / 2) + 1).alias("right"), at(place).alias("p95"),
        F.min("v").alias("min"), F.max("v").alias("max"), F.sum(F.col("v") * F.col("c")).alias("sum"),
    )
    numbers = {"median": (F.col("left") + F.col("right")) / 2, "p95": F.col("p95"), "min": F.col("min"), "max": F.col("max"), "mean": F.col("sum") / F.col("n")}
    return out.select(F.col("g").alias(group), "n", *[F.round(c, decimals).alias(k) for k, c in numbers.items()])


def mix(rows: DataFrame, category: str, decimals: int = 3) -> DataFrame:
    """(category, n, share)."""
    counts = rows.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("category", "n", F.round(F.col("n") / F.col("total"), decimals).alias("share"))


def reweighted(rates: DataFrame, old_mix: DataFrame, decimals: int = 6) -> DataFrame:
    """One row (rate): category rates under another mix.  ``rates`` (category, rate), ``old_mix`` (category, share)."""
    return rates.join(old_mix.select("category", "share"), "category").agg(F.round(F.sum(F.col("rate") * F.col("share")), decimals).alias("rate"))


def order_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(rank, a, b, same): two score tables (name, score) compared place by place."""
    def order(x: DataFrame, name: str) -> DataFrame:
        return x.select(F.row_number().over(Window.orderBy(F.desc("score"), "name")).cast("bigint").alias("rank"), F.col("name").alias(name))

    return order(a, "a").join(order(b, "b"), "rank", "full").select("rank", "a", "b", F.col("a").eqNullSafe(F.col("b")).alias("same"))


def closest(rows: DataFrame, value: str, target: float, tie: str, pick: str) -> DataFrame:
    """One row: the ``pick`` whose ``value`` is closest to the target, the smaller ``tie`` first."""
    return rows.agg(F.min_by(pick, F.struct(F.abs(F.col(value) - target), F.col(tie))).alias(pick))


def ablation(scores: DataFrame, questions: DataFrame, base: str, categories: list[str], decimals: int = 6) -> DataFrame:
    """(config, recall, mrr, <category>_recall..., delta): configurations side by side, ``delta`` against the recall of ``base``.

    ``scores`` (config, query_id, recall, rr), ``questions`` (query_id, category)."""
    rows = scores.join(questions.select("query_id", "category"), "query_id")
    by_category = [F.round(F.avg(F.when(F.col("category") == c, F.col("recall"))), decimals).alias(f"{c}_recall") for c in categories]
    out = rows.groupBy("config").agg(F.avg("recall").alias("r"), F.round(F.avg("rr"), decimals).alias("mrr"), *by_category)
    own = out.where(F.col("config") == base).select(F.col("r").alias("b"))  # one row
    return out.join(F.broadcast(own)).select("config", F.round("r", decimals).alias("recall"), "mrr", *[f"{c}_recall" for c in categories], F.round(F.col("r") - F.col("b"), decimals).alias("delta"))


def probe_ranks(cases: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """(query_id, expected, expected_rank, outranked_by, passed): the rank of the expected document, and the distractors in front of it.

    ``cases`` (query_id, expected, distractors array), ``hits`` (query_id, id, rank).  A document that is no hit has no rank; a
    distractor among the hits is in front of an expected document that is none."""
    roles = cases.select("query_id", "expected", F.explode_outer(F.array_distinct(F.concat(F.array("expected"), F.coalesce("distractors", F.array().cast("array<string>"))))).alias("id"))
    best = hits.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    ranked_ = roles.join(best, ["query_id", "id"], "left")
    own = F.max(F.when(F.col("id") == F.col("expected"), F.col("rank")))
    others = F.collect_list(F.when((F.col("id") != F.col("expected")) & F.col("rank").isNotNull(), F.struct("rank", "id")))
    out = ranked_.groupBy("query_id", "expected").agg(own.alias("expected_rank"), others.alias("o"))
    ahead = F.transform(F.array_sort(F.filter("o", lambda x: F.col("expected_rank").isNull() | (x["rank"] < F.col("expected_rank")))), lambda x: x["id"])
    out = out.withColumn("outranked_by", ahead)
    return out.select("query_id", "expected", "expected_rank", "outranked_by", (F.coalesce(F.col("expected_rank") <= k, F.lit(False)) & (F.size("outranked_by") == 0)).alias("passed"))


def page_hits(rows: DataFrame, pages: str, expected: str) -> DataFrame:
    """``rows`` with ``page_hit``: whether a retrieved page is an expected one; none is expected of a row without pages."""
    return rows.withColumn("page_hit", F.coalesce(F.arrays_overlap(pages, expected), F.lit(False)))
