"""Search by vectors: unit length, dot products, best window of a document, several indexes merged.

The query side is a stated set of bounded size: it is shipped in blocks that are size-checked (``BLOCK``), and each block meets the
vectors in one Arrow pass as a matrix product.  Nothing is shuffled but the few best of each partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daftar.functions.text import bound
from daftar.operators.lexical import ranked

#: Query vectors shipped at once.
BLOCK = 4096
#: Queries multiplied with a batch at once.
QUERIES_AT_ONCE = 256


def unit(v: Column) -> Column:
    """A vector at length one; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return bound(norm, lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))


def hashed_terms(terms: Column, dimensions: int = 64) -> Column:
    """A unit vector that counts terms by the bucket of their hash: a deterministic stand-in for an encoder, inside the JVM."""
    buckets = F.transform(terms, lambda t: F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("bigint") % dimensions)
    counts = bound(buckets, lambda bs: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda k: F.size(F.filter(bs, lambda b: b == k)).cast("double")))
    return bound(counts, unit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarities(queries: DataFrame, query_key: str, vectors: DataFrame, keys: list[str], embedding: str = "embedding", keep: int | None = None, pooled: bool = False) -> DataFrame:
    """(query_id, *keys, score): dot products of each query with each vector.

    With ``keep`` only rows that can be among the ``keep`` best rows of their query leave a batch; if ``pooled``, only the best row
    of each document (first of ``keys``) that can be among the ``keep`` best documents.  Rows within 1e-4 of the edge stay, so
    ties after rounding are not cut."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    schema = f"query_id {queries.schema[query_key].dataType.simpleString()}, " + ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", score double"
    rows = vectors.select(*keys, embedding).where(f"`{embedding}` is not null")
    parts, block, blocks = [], [], []
    for q, v in queries.select(query_key, embedding).where(f"`{embedding}` is not null").toLocalIterator():
        block.append((q, v))
        if len(block) == BLOCK:
            blocks.append(block)
            block = []
    blocks += [block] if block or not blocks else []
    sc = vectors.sparkSession.sparkContext
    for own in blocks:
        shipped = sc.broadcast(([q for q, _ in own], np.array([v for _, v in own], dtype=np.float64)))

        def score(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            ids, asked = np.array(shipped.value[0], dtype=object), shipped.value[1]
            for batch in batches:
                if not len(batch) or not len(ids):
                    continue
                v = np.stack(batch[embedding].to_numpy()).astype(np.float64)
                codes, docs = pd.factorize(batch[keys[0]])
                for at in range(0, len(ids), QUERIES_AT_ONCE):
                    got = asked[at : at + QUERIES_AT_ONCE] @ v.T
                    mask = np.ones(got.shape, dtype=bool)
                    if keep is not None:
                        best = got
                        if pooled:
                            best = np.full((len(docs), len(got)), -np.inf)
                            np.maximum.at(best, codes, got.T)
                            best = best.T
                            mask = got == best[:, codes]
                        if best.shape[1] > keep:
                            edge = np.partition(best, -keep, axis=1)[:, -keep]
                            mask &= got >= (edge - 1e-4)[:, None]
                    q, r = np.nonzero(mask)
                    yield pd.DataFrame({"query_id": ids[at + q], **{k: batch[k].to_numpy()[r] for k in keys}, "score": got[q, r]})

        parts.append(rows.mapInPandas(score, schema))
    return reduce(DataFrame.union, parts)


def cosine_topk(queries: DataFrame, query_key: str, vectors: DataFrame, key: str, k: int, decimals: int = 4, embedding: str = "embedding", ties: str = "asc") -> DataFrame:
    """(query_id, id, rank, score): the best window of each document, the ``k`` best documents of each query."""
    scores = similarities(queries, query_key, vectors, [key], embedding, keep=k, pooled=True)
    pooled = scores.groupBy("query_id", F.col(key).alias("id")).agg(F.round(F.max("score"), decimals).alias("score"))
    return ranked(pooled, k, ties)


def library_search(queries: DataFrame, query_key: str, vectors: DataFrame, doc: str, chunk: str, k: int, live: DataFrame | None = None, embedding: str = "embedding", decimals: int = 4) -> DataFrame:
    """(query_id, doc, chunk, rank, score): the ``k`` best chunks of each document, merged over the documents in scope.

    ``live`` (doc, created_at) restricts the scope and breaks ties: rounded score, created_at, chunk, doc."""
    scope = vectors if live is None else vectors.join(live.select(doc).distinct(), doc, "left_semi")
    scores = similarities(queries, query_key, scope, [doc, chunk], embedding, keep=k)
    own = Window.partitionBy("query_id", doc).orderBy(F.desc("score"), chunk)
    best = scores.withColumn("r", F.row_number().over(own)).where(F.col("r") <= k).withColumn("score", F.round("score", decimals))
    best = best.withColumn("created_at", F.lit(None).cast("timestamp")) if live is None else best.join(live.select(doc, "created_at"), doc, "left")
    merged = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("created_at"), chunk, doc)
    out = best.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= k)
    return out.select("query_id", F.col(doc).alias("doc"), F.col(chunk).alias("chunk"), F.col("rank").cast("bigint").alias("rank"), "score")


def index_problems(vectors: DataFrame, docs: DataFrame, key: str, dimension: int, embedding: str = "embedding") -> DataFrame:
    """(problem, rows): what makes a stored index unusable; no row means it can be read."""
    v = F.col(embedding)
    checks = vectors.agg(
        F.count("*").alias("all"),
        F.count_if(v.isNull() | (F.size(v) != dimension)).alias("wrong_dimension"),
        F.count_if(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).alias("not_finite"),
    )
    rows = checks.select(F.explode(F.array(F.struct(F.lit("empty").alias("problem"), (F.col("all") == 0).cast("bigint").alias("rows")), F.struct(F.lit("wrong_dimension").alias("problem"), F.col("wrong_dimension").alias("rows")), F.struct(F.lit("not_finite").alias("problem"), F.col("not_finite").alias("rows")))).alias("x")).select("x.*")
    keys, known = vectors.select(key).distinct(), docs.select(key).distinct()
    lost = known.join(keys, key, "left_anti").agg(F.count("*").alias("rows")).select(F.lit("document_without_vector").alias("problem"), "rows")
    stray = keys.join(known, key, "left_anti").agg(F.count("*").alias("rows")).select(F.lit("vector_without_document").alias("problem"), "rows")
    return rows.unionByName(lost).unionByName(stray).where("rows > 0")
