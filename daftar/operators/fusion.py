"""Fusing ranked lists and scoring their candidates again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.functions.text import bound
from daftar.operators.lexical import ranked

RRF_CONSTANT, DEPTH = 60, 20


def reciprocal_rank_fusion(lists: list[DataFrame], k: int, constant: int = RRF_CONSTANT, decimals: int = 6) -> DataFrame:
    """(query_id, id, rank, score): sum of 1 / (constant + rank) over the lists; ties by id."""
    rows = reduce(DataFrame.unionByName, [x.select("query_id", "id", "rank") for x in lists])
    return ranked(rows.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), decimals).alias("score")), k)


def rerank(candidates: DataFrame, texts: DataFrame, queries: DataFrame, scorer: Column, k: int, decimals: int = 4) -> DataFrame:
    """(query_id, id, rank, score): candidates by a pair score over full texts.

    ``texts`` (id, text) and ``queries`` (query_id, query) are joined to the candidates only; ``scorer`` is a column over ``query``
    and ``text``: an expression, or a model in a pandas UDF."""
    pairs = candidates.select("query_id", "id").join(texts, "id", "left").join(queries, "query_id", "left")
    return ranked(pairs.select("query_id", "id", F.round(F.coalesce(scorer, F.lit(0.0)), decimals).alias("score")), k)


def containment(query_terms: Column, doc_terms: Column) -> Column:
    """Share of the query's terms (each occurrence) that the document has; 0 for a query without terms.

    Both lists are worked out once a row, however many terms the query has."""
    share = lambda x: F.when(F.size(x["q"]) > 0, F.size(F.filter(x["q"], lambda t: F.array_contains(x["d"], t))) / F.size(x["q"])).otherwise(0.0)
    return bound(F.struct(query_terms.alias("q"), doc_terms.alias("d")), share)
