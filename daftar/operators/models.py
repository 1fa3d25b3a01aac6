"""Contracts of injected models: encoder, pair scorer and chat model.  Each is a callable that a Python worker makes once."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[list[tuple[str, str]]], list[float]]
Chat = Callable[[list[dict]], str]

QUERY_PREFIX, PASSAGE_PREFIX = "query: ", "passage: "


def encoded(rows: DataFrame, key: list[str], text: str, make: Callable[[], Encoder], prefix: str = PASSAGE_PREFIX, batch: int = 64) -> DataFrame:
    """(*key, embedding): unit vectors of ``prefix`` + text; the encoder is made once per worker and fed in batches."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make()
        for part in parts:
            texts = [prefix + (t or "") for t in part[text]]
            got = [np.asarray(encoder(texts[i : i + batch]), dtype=np.float32) for i in range(0, len(texts), batch)]
            v = np.concatenate(got) if got else np.zeros((0, 0), dtype=np.float32)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            yield part[key].assign(embedding=list(np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)))

    return rows.select(*key, text).mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", embedding array<float>")


def scored_pairs(pairs: DataFrame, query: str, text: str, make: Callable[[], Scorer]) -> DataFrame:
    """``pairs`` with ``score`` by an injected pair scorer.  Cut the candidates by rank before: nothing is pushed through Python."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for part in parts:
            yield part.assign(score=[float(x) for x in scorer(list(zip(part[query], part[text].fillna(""))))] if len(part) else [])

    return pairs.mapInPandas(run, pairs.schema.add("score", "double"))


def formatted_sources(texts: F.Column) -> F.Column:
    """``[i]`` and text of each source, parted by blank lines, i from 1."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]\n"), t)), "\n\n")


def asked_json(prompts: DataFrame, key: str, prompt: str, system: str, make: Callable[[], Chat], check: Callable[[str], str | None]) -> DataFrame:
    """(key, reply, violation, attempts): one call per row, and one more with the error if the reply breaks the contract.

    ``check`` gives the violation of a reply or None.  A model's exception ends the task: Spark's retry is no part of the contract."""
    kind = prompts.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chat = make()
        for part in parts:
            out = []
            for k, text in zip(part[key], part[prompt]):
                messages = [{"role": "system", "content": system}, {"role": "user", "content": text}]
                reply = chat(messages)
                violation, attempts = check(reply), 1
                if violation is not None:
                    reply = chat([*messages, {"role": "assistant", "content": reply}, {"role": "user", "content": violation}])
                    violation, attempts = check(reply), 2
                out.append((k, reply, violation, attempts))
            yield pd.DataFrame(out, columns=[key, "reply", "violation", "attempts"])

    return prompts.select(key, prompt).mapInPandas(run, f"`{key}` {kind}, reply string, violation string, attempts int")


def staged_claims(questions: DataFrame, key: str, sources: str, make: Callable[[], Chat], relevance_system: str, claims_system: str) -> DataFrame:
    """(key, own_reason, reply, violation): relevance first, claims only for what passed it.

    No sources, a no, or a broken relevance reply ends in an abstention with its reason; the claims model never sees those rows."""
    rows = questions.select(key, F.col("question"), F.col(sources).alias("s"))
    none = rows.where(F.coalesce(F.size("s"), F.lit(0)) <= 0).select(key, F.lit("no_sources").alias("own_reason"), F.lit(None).cast("string").alias("reply"), F.lit(None).cast("string").alias("violation"))
    some = rows.where(F.size("s") > 0).select(key, F.concat(formatted_sources(F.col("s")), F.lit("\n\n"), F.col("question")).alias("prompt"))

    def relevance_violation(reply: str) -> str | None:
        try:
            data = json.loads(reply)
        except ValueError:
            return "invalid JSON"
        return None if isinstance(data, dict) and isinstance(data.get("answers"), bool) else "answers is not a boolean"

    first = asked_json(some, key, "prompt", relevance_system, make, relevance_violation)
    yes = F.coalesce(F.get_json_object("reply", "$.answers") == "true", F.lit(False)) & F.col("violation").isNull()
    stopped = first.where(~yes).select(key, F.when(F.col("violation").isNull(), "relevance_no").otherwise("relevance_failure").alias("own_reason"), F.lit(None).cast("string").alias("reply"), F.lit(None).cast("string").alias("violation"))
    passed = some.join(first.where(yes).select(key), key, "left_semi")
    claims = asked_json(passed, key, "prompt", claims_system, make, claims_violation).select(key, F.lit(None).cast("string").alias("own_reason"), "reply", "violation")
    return none.unionByName(stopped).unionByName(claims)


def claims_violation(reply: str) -> str | None:
    """First broken rule of a claims reply, or None."""
    try:
        data = json.loads(reply)
    except ValueError:
        return "invalid JSON"
    if not isinstance(data, dict):
        return "not an object"
    if not isinstance(data.get("abstain"), bool):
        return "abstain is not a boolean"
    claims = data.get("claims")
    if not isinstance(claims, list):
        return "claims is not a list"
    if len(claims) > 3:
        return "too many claims"
    for c in claims:
        if not isinstance(c, dict):
            return "claim is not an object"
        text, sources = c.get("text"), c.get("sources")
        if not isinstance(text, str):
            return "claim has no text"
        if not text.strip():
            return "claim text is empty"
        if len(text) > 300:
            return "claim text is too long"
        if not isinstance(sources, list) or any(isinstance(n, bool) or not isinstance(n, int) for n in sources):
            return "claim sources are not integers"
    return None
