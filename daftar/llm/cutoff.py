"""Problem 7: text cut off by field limits.

Method: the lengths of the finished values of each source follow a log-normal distribution; values that look unfinished
are right-censored observations of it.  The distribution is fitted per source by maximum likelihood (EM over a histogram
of lengths).  Candidate limits are lengths of any size, in characters or bytes, at which unfinished values pile up.  Each
value gets the posterior probability that it was censored at its length.  How much an ending (open word or sentence, open
citation, broken character, debris, a refusal without a mark by what its last words do elsewhere) says is a likelihood ratio on
the same scale: expectation and maximization over the counts of (ending, posterior) fit the endings of censored and of
finished values, where ``EVIDENCE`` weighs as much as all values do.  The sum of both log odds decides.  A closed
sentence or citation and a whole answer are finished by definition; a refusal without a mark is what the length can decide.

The scan gives one small row per value; fits see histograms only, so a source with a third of all rows is no larger than
another.

Cases: null, empty, sign-only and placeholder texts are no cases; a finished sentence or citation, a bare yes or no and a
whole refusal or repeated question without a full stop are finished whatever the statistics say; sources of few
values fall back to the pooled fit; a row delivered twice counts once; texts of any length are judged whole.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daftar.llm import wording
from daftar.session import cut_lineage, spread

#: What an ending says of having been cut, as log odds, before the data speak.  A refusal without a mark is told by its last words: they
#: hardly ever end refusals (inner), do so again and again, as no cut at any place does (final), or stand in no other (unseen).
EVIDENCE = {"empty": -99.0, "closed": -99.0, "whole": -99.0, "doubtful": 0.0, "unseen": 0.0, "final": -4.0, "inner": 1.5, "open": 7.0, "debris": 9.0}
ENDINGS, FINISHED = ("closed", "whole", "unseen", "final", "inner", "open", "debris"), ("closed", "whole")
#: What ``EVIDENCE`` weighs beside the values, last words that are looked at, and the share of their places that end sentences from which they are final.
PRIOR, LAST_WORDS, FINAL_SHARE = 1.0, 3, 0.05
#: Share of finished values whose length follows no model, evenly spread over so many powers of e.
STRAY, STRAY_RANGE = 0.1, 14.0
#: A question that has more than this share of all rows is joined apart.
HOT_SHARE = 0.01
_HARD = re.compile(r"(?:\s*(?:�+|\\u?[0-9a-fA-F]{0,3}|</?[a-zA-Z]{0,6}|&#?[a-zA-Z0-9]{0,5}))+$")
_DOTS = re.compile(r"\s*(?:\.{2,}|…)+\s*$")
_CLOSED = re.compile(r"[.!?؟]['\"»”’)\]]*$")
_OPEN_CITATION = re.compile(r"\[[^\[\]]{0,24}$|\([^()]{0,24}$")
_ANY_WORD = re.compile(r"[^\W_]+")
_MARK = re.compile(r"[.!?؟]+(?=[\s'\"»”)]|$)")


def _same_words(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Share of the longer word list that both have."""
    if not a or not b:
        return 0.0
    rest = list(b)
    hit = 0
    for w in a:
        if w in rest:
            rest.remove(w)
            hit += 1
    return hit / max(len(a), len(b))


def word_ends(text: str) -> tuple[list[str], list[str]]:
    """(last words of each sentence, words in front of all other places) of a text, ``LAST_WORDS`` at a time; a text without a mark
    at its end has its own last words last among the first."""
    finals, inner = [], []
    for sentence in _MARK.split(text.casefold()):
        words = _ANY_WORD.findall(sentence)
        runs = [" ".join(words[max(0, i - LAST_WORDS) : i]) for i in range(1, len(words) + 1)]
        finals += runs[-1:]
        inner += runs[:-1]
    return finals, inner


def ending(text: str | None, question: str | None = None) -> str:
    """Class of a value's ending; ``doubtful`` is a refusal without a mark, to be settled by its last word."""
    if wording.is_empty(text):
        return "empty"
    bare = text.rstrip(" \t\r\n​‎‏﻿")
    core = _HARD.sub("", bare)
    if core != bare:
        return "debris" if core.strip() else "empty"
    dotless = _DOTS.sub("", bare)
    dots = dotless != bare
    if dots:
        bare = dotless.rstrip()
        if not bare:
            return "empty"
    if _OPEN_CITATION.search(bare):
        return "open"
    if _CLOSED.search(bare) or bare[-1] in "])»\"”":
        return "closed"
    if bare.strip(" ،,").casefold() in wording.YES_NO:
        return "whole"
    if not dots and not question and not wording.REFUSAL.search(bare) and not wording.APOLOGY.search(bare):
        return "open"
    last = wording.clauses(bare)[-1]
    if wording.is_refusal(last) or wording.APOLOGY.search(last):
        return "debris" if dots else "doubtful"
    if not dots and question:
        own, asked = wording.bag(last), wording.bag(question)
        if _same_words(own, asked) >= 0.8 or _same_words(wording.bag(bare), asked) >= 0.8:
            return "whole"
    return "debris" if dots else "open"


_ENDING = T.StructType([T.StructField("kind", T.StringType()), T.StructField("chars", T.IntegerType()), T.StructField("bytes", T.IntegerType()), T.StructField("last", T.StringType()), T.StructField("finals", T.ArrayType(T.StringType())), T.StructField("inner", T.ArrayType(T.StringType()))])


@F.arrow_udf(_ENDING)
def _ending_column(text: pa.Array, question: pa.Array) -> pa.Array:
    out = []
    for t, q in zip(text.to_pylist(), question.to_pylist()):
        kind = ending(t, q)
        last = finals = inner = None
        if kind == "doubtful":
            last = (word_ends(t)[0] or [None])[-1]
        elif kind == "closed" and (wording.REFUSAL.search(t) or wording.APOLOGY.search(t)):
            finals, inner = (sorted(set(x)) for x in word_ends(t))
        out.append({"kind": kind, "chars": len(t or ""), "bytes": len((t or "").encode()), "last": last, "finals": finals, "inner": inner})
    return pa.array(out, pa.struct([("kind", pa.string()), ("chars", pa.int32()), ("bytes", pa.int32()), ("last", pa.string()), ("finals", pa.list_(pa.string())), ("inner", pa.list_(pa.string()))]))


def with_questions(answers: DataFrame, questions: DataFrame, key: str = "answer_no") -> DataFrame:
    """Answers with the text of their question.

    Questions with more than ``HOT_SHARE`` of the rows, at most 1 / HOT_SHARE of them, are broadcast; the other rows meet theirs by
    id.  In that join a row of a hot or of no question has a place of its own, so no key is hot."""
    asked = questions.select("id", "question").where("id is not null").dropDuplicates(["id"])
    counts = answers.where("id is not null").groupBy("id").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    hot = counts.crossJoin(F.broadcast(total)).where(F.col("n") > HOT_SHARE * F.col("total")).select("id")
    hot = F.broadcast(asked.join(F.broadcast(hot), "id").select(F.col("id").alias("_hot"), F.col("question").alias("_hot_question")))
    rows = answers.join(hot, answers["id"] == F.col("_hot"), "left")
    own = F.when(F.col("_hot").isNull(), F.col("id"))
    rows = rows.withColumn("_at", F.coalesce(own, F.concat(F.lit("\0"), F.col(key).cast("string"))))
    rows = rows.join(asked.withColumnRenamed("id", "_at"), "_at", "left")
    return rows.withColumn("question", F.coalesce("question", "_hot_question")).drop("_at", "_hot", "_hot_question")


# ---------------------------------------------------------------------------------------------------
# length model


def _phi(z: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def _upper(z: np.ndarray) -> np.ndarray:
    return np.maximum(np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in np.atleast_1d(z)]), 1e-12)


def fit_lengths(log_length: np.ndarray, whole: np.ndarray, cut: np.ndarray, rounds: int = 40) -> tuple[float, float]:
    """(mu, sigma) of log lengths by EM: ``whole`` counts are exact, ``cut`` counts right-censored."""
    x = log_length
    n = whole.sum() + cut.sum()
    mu, sigma = (whole * x).sum() / max(whole.sum(), 1), 1.0
    for _ in range(rounds):
        z = (x - mu) / sigma
        hazard = _phi(z) / _upper(z)
        mean = mu + sigma * hazard
        square = mu * mu + sigma * sigma + sigma * (x + mu) * hazard
        first = (whole * x + cut * mean).sum() / n
        second = (whole * x * x + cut * square).sum() / n
        mu, sigma = first, math.sqrt(max(second - first * first, 1e-4))
    return float(mu), float(sigma)


_FIT = "source string, mu double, sigma double, limits array<struct<unit:string,length:int,share:double>>, hazard double"


def _fit_source(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    """Parameters of one source from its length histograms."""
    chars = part[part.unit == "chars"]
    bins = chars.assign(x=np.round(np.log(chars.length.clip(lower=1)) * 20) / 20).groupby("x")[["whole", "cut"]].sum()
    mu, sigma = fit_lengths(bins.index.to_numpy(float), bins.whole.to_numpy(float), bins.cut.to_numpy(float))
    limits = []
    for unit, own in part.groupby("unit"):
        own = own.sort_values("length")
        cut, length, whole = own.cut.to_numpy(float), own.length.to_numpy(int), own.whole.to_numpy(float)
        typical = max(cut.sum() / max(np.ptp(length) + 1, 1), 0.2)
        for i in np.flatnonzero((cut >= 5) & (cut >= 12 * typical) & (length >= 20)):
            reached = cut[length >= length[i]].sum() + whole[length >= length[i]].sum()
            limits.append({"unit": unit, "length": int(length[i]), "share": float(cut[i] / max(reached, 1))})
    total = chars.whole.sum() + chars.cut.sum()
    at_limits = sum(chars.cut[chars.length == x["length"]].sum() for x in limits if x["unit"] == "chars")
    hazard = max(chars.cut.sum() - at_limits, 0.5) / max(total, 1)
    return pd.DataFrame({"source": [key[0]], "mu": [mu], "sigma": [sigma], "limits": [limits], "hazard": [float(hazard)]})


def length_models(judged: DataFrame, source: str) -> DataFrame:
    """(source, mu, sigma, limits, hazard): one row per source, fitted on its counts of lengths, as many as there are lengths."""
    units = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("e.chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("e.bytes").alias("length")))).alias("u")
    open_ = F.col("kind").isin("open", "debris")
    rows = judged.where("e.kind <> 'empty'").select(F.col(source).alias("source"), F.col("kind"), units, "e").select("source", "kind", F.col("u.unit").alias("unit"), F.col("u.length").alias("length"))
    histogram = rows.groupBy("source", "unit", "length").agg(F.count_if(~open_).cast("double").alias("whole"), F.count_if(open_).cast("double").alias("cut"))
    return histogram.groupBy("source").applyInPandas(_fit_source, _FIT)


def _posterior(mu: Column, sigma: Column, limits: Column, hazard: Column, chars: Column, bytes_: Column) -> Column:
    """Probability that a value of this length was censored at it.

    ``STRAY`` of the finished values may have any length, so one far from the usual is no proof."""
    z = (F.log(F.greatest(chars, F.lit(1))) - mu) / sigma
    upper = 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))
    density = F.exp(-0.5 * z * z) / (2.5066 * sigma * F.greatest(chars, F.lit(1)))
    density = (1 - STRAY) * density + STRAY / (STRAY_RANGE * F.greatest(chars, F.lit(1)))
    at = F.aggregate(limits, F.lit(0.0), lambda s, x: F.greatest(s, F.when(x["length"] == F.when(x["unit"] == "bytes", bytes_).otherwise(chars), x["share"]).otherwise(0.0)))
    cut = upper * (at + hazard / F.exp(mu))
    return cut / F.greatest(cut + density * (1 - hazard), F.lit(1e-12))


def fit_endings(counts: list[tuple[str, float, float]], rounds: int = 50) -> dict[str, float]:
    """Log odds of each ending from (ending, log odds of its length, values), by expectation and maximization.

    Each value is cut or finished; its length says how likely that is, and its ending is drawn from one of two distributions, each half
    ``EVIDENCE`` and half what the values say: an ending that never came keeps the odds it began with."""
    place = {e: i for i, e in enumerate(ENDINGS)}
    finished = [place[e] for e in FINISHED]
    rows = [(place[e], x, n) for e, x, n in counts if e in place]
    kind, odds, n = np.array([r[0] for r in rows], dtype=int), np.array([r[1] for r in rows], dtype=float), np.array([r[2] for r in rows], dtype=float)
    start = np.array([EVIDENCE[e] for e in ENDINGS])
    share = 1 / (1 + np.exp(-start))
    prior = np.stack([share, 1 - share]) * 2 / len(ENDINGS)  # shares of the endings among cut and among finished values
    log_ratio = start
    for _ in range(rounds):
        cut = np.where(np.isin(kind, finished), 0.0, n / (1 + np.exp(-np.clip(log_ratio[kind] + odds, -60, 60))))
        seen = np.stack([np.bincount(kind, cut, len(ENDINGS)), np.bincount(kind, n - cut, len(ENDINGS))])
        # the prior weighs on either side by that side's size, so an ending that never came keeps the odds it began with
        total = seen.sum(1, keepdims=True)
        seen = seen / np.maximum(total, 1e-9) + PRIOR * prior
        log_ratio = np.log(np.maximum(seen[0], 1e-12)) - np.log(np.maximum(seen[1], 1e-12))
    return {e: EVIDENCE[e] if e in FINISHED else float(x) for e, x in zip(ENDINGS, log_ratio)}


def judged_values(answers: DataFrame, questions: DataFrame, key: str = "answer_no", source: str = "model", text: str = "text") -> DataFrame:
    """(key, source, kind, chars, posterior, ending_odds, score, cut) of each value; ``cut`` is the decision, by ``score``: the log odds
    of the length's posterior and of the ending together."""
    rows = answers.select(key, "id", F.col(source).alias("source"), F.col(text).alias("text")).dropDuplicates([key])
    rows = spread(with_questions(rows, questions, key))
    judged = cut_lineage(rows.select(key, "source", _ending_column("text", "question").alias("e")))
    # what the last words of a refusal without a mark do in all other refusals
    ends = judged.select(F.explode(F.concat(F.coalesce("e.finals", F.array().cast("array<string>")), F.array_compact(F.array("e.last")))).alias("last")).groupBy("last").agg(F.count("*").alias("ends"))
    stays = judged.select(F.explode("e.inner").alias("last")).groupBy("last").agg(F.count("*").alias("stays"))
    unmarked = judged.where("e.kind = 'doubtful'").select(key, "e.last").join(ends, "last", "left").join(stays, "last", "left")
    others, stays = F.coalesce(F.col("ends"), F.lit(1)) - 1, F.coalesce(F.col("stays"), F.lit(0))
    unmarked = unmarked.select(key, F.when(others + stays > 0, others / (others + stays)).alias("share"))
    unmarked = unmarked.select(key, F.when(F.col("share").isNull(), "unseen").when(F.col("share") >= FINAL_SHARE, "final").otherwise("inner").alias("own"))
    judged = judged.join(unmarked, key, "left").select(key, F.coalesce("source", F.lit("")).alias("source"), "e", F.coalesce("own", "e.kind").alias("kind"))
    fits = length_models(judged, "source")
    p = F.coalesce(_posterior(F.col("mu"), F.col("sigma"), F.col("limits"), F.col("hazard"), F.col("e.chars"), F.col("e.bytes")), F.lit(0.5))
    out = cut_lineage(judged.join(fits, "source", "left").select(key, "source", "kind", F.col("e.chars").alias("chars"), p.alias("posterior")))
    odds = F.log(F.greatest("posterior", F.lit(1e-6)) / F.greatest(1 - F.col("posterior"), F.lit(1e-6)))
    counts = out.where(F.col("kind") != "empty").groupBy("kind", (F.round(odds * 4) / 4).alias("odds")).agg(F.count("*").alias("n")).collect()  # endings times at most 112 steps of the odds
    fitted = fit_endings([(r.kind, r.odds, float(r.n)) for r in sorted(counts, key=lambda r: (r.kind, r.odds))]) | {"empty": EVIDENCE["empty"]}
    ending = F.create_map(*[x for k, v in fitted.items() for x in (F.lit(k), F.lit(v))])[F.col("kind")]
    return out.withColumn("ending_odds", ending).withColumn("score", F.col("ending_odds") + odds).withColumn("cut", F.col("score") > 0)


def cut_values(answers: DataFrame, questions: DataFrame, key: str = "answer_no") -> DataFrame:
    return judged_values(answers, questions, key).where("cut").select(key)


def cut_rates(answers: DataFrame, questions: DataFrame, key: str = "answer_no") -> DataFrame:
    """(model, answers, cut, rate): values that are not empty, and how many of them were cut."""
    rows = judged_values(answers, questions, key).where("kind <> 'empty'")
    return rows.groupBy(F.col("source").alias("model")).agg(F.count("*").alias("answers"), F.count_if("cut").alias("cut")).withColumn("rate", F.round(F.col("cut") / F.col("answers"), 6))
