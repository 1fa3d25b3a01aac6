"""Claims, gate, audit and the tallies over saved answers.  Plain deterministic rules over rows; no model is called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.functions import citations as ci
from daftar.functions import text as tx
from daftar.session import cut_lineage

MOST_CLAIMS, MOST_CLAIM_TEXT = 3, 300
ABSTENTION_GOAL, LEAST_CITED = 0.80, 10


def copied_sentences(answers: DataFrame, key: str, retrieved: str, texts: DataFrame, number: str, text: str = "text") -> DataFrame:
    """(key, copied): numbers from 0 of the sentences of an answer that are copied from any text of a retrieved article.

    ``texts`` (number, text) may have any number of texts for an article."""
    windows = F.transform(tx.sentences(F.col(text)), lambda s, i: F.transform(ci.copied_windows(s), lambda w: F.struct(i.alias("i"), w["h"].alias("h"), w["g"].alias("g"))))
    rows = answers.select(key, F.array_distinct(retrieved).alias("ns"), F.flatten(windows).alias("ws")).where("size(ns) > 0 and size(ws) > 0")
    rows = cut_lineage(rows).select(key, "ns", F.explode("ws").alias("w")).select(key, "ns", "w.*")
    # runs that no answer has and windows that no text has are left out before they meet: few of either stay
    runs = cut_lineage(ci.run_hashes(texts, number, F.col("text"), ci.hash_marks(rows)))
    rows = ci.marked(rows, ci.hash_marks(runs)).select(key, "i", "h", "g", F.explode("ns").alias(number))
    hits = rows.join(runs.hint("merge"), [number, "h", "g"], "left_semi")
    return hits.groupBy(key).agg(F.collect_set("i").alias("copied"))


def audit(answers: DataFrame, corpus: Column, retrieved: Column, context: Column, text: str = "text", copied: Column | None = None) -> DataFrame:
    """``answers`` with the verdict on free text: a_abstained, a_cited, a_copied, a_strict, a_fabricated, a_ungrounded, a_uncited, a_grounded.

    ``corpus`` and ``retrieved`` are arrays of article numbers, ``context`` the texts that were retrieved.
    ``copied``, if given, says which sentences are copied (numbers from 0) in place of the texts.  An abstention is not audited."""
    t = F.coalesce(F.col(text), F.lit(""))
    parts = F.transform(tx.sentences(t), lambda s, i: F.struct(s.alias("s"), ci.citations(s).alias("c"), (ci.copied(s, context) if copied is None else F.array_contains(copied, i)).alias("copied")))
    none = F.array().cast("array<int>")
    rows = answers.withColumn("_p", parts).withColumn("a_abstained", ci.is_abstention(t))
    own = F.array_distinct(F.flatten(F.transform(F.filter("_p", lambda p: ~p["copied"]), lambda p: p["c"])))
    other = F.array_distinct(F.flatten(F.transform(F.filter("_p", lambda p: p["copied"]), lambda p: p["c"])))
    rows = rows.withColumn("a_cited", F.when(F.col("a_abstained"), none).otherwise(own)).withColumn("a_copied", F.when(F.col("a_abstained"), none).otherwise(F.array_except(other, own)))
    uncited = F.transform(F.filter("_p", lambda p: (F.length(p["s"]) >= ci.LEAST_CLAIM) & ((F.size(p["c"]) == 0) | p["copied"])), lambda p: p["s"])
    rows = (
        rows.withColumn("a_strict", F.when(F.col("a_abstained"), none).otherwise(ci.strict_citations(t)))
        .withColumn("a_fabricated", F.filter("a_cited", lambda n: ~F.array_contains(corpus, n)))
        .withColumn("a_ungrounded", F.filter("a_cited", lambda n: F.array_contains(corpus, n) & ~F.array_contains(retrieved, n)))
        .withColumn("a_uncited", F.when(F.col("a_abstained"), F.array().cast("array<string>")).otherwise(uncited))
    )
    return rows.withColumn("a_grounded", (F.size("a_fabricated") == 0) & (F.size("a_ungrounded") == 0) & (F.size("a_uncited") == 0)).drop("_p")


def parsed_claims(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """``replies`` with ``violation`` (the first broken rule, null if none), ``abstain`` and ``claims`` of the strict contract.

    Types are told by a lenient variant parse, so a number is no string and true is no number."""
    v = F.expr(f"try_parse_json(`{raw}`)")
    top = F.schema_of_variant(v)
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    items = get("$.claims", "array<variant>")
    text_kind = lambda c: F.schema_of_variant(F.try_variant_get(c, "$.text", "variant"))
    text = lambda c: F.try_variant_get(c, "$.text", "string")
    sources = lambda c: F.try_variant_get(c, "$.sources", "array<variant>")
    is_list = lambda c: F.coalesce(F.schema_of_variant(F.try_variant_get(c, "$.sources", "variant")).startswith("ARRAY"), F.lit(False))

    def broken(c: Column) -> Column:
        integers = F.coalesce(F.forall(sources(c), lambda s: F.coalesce(F.schema_of_variant(s) == "BIGINT", F.lit(False))), F.lit(False))
        return (
            F.when(~F.coalesce(F.schema_of_variant(c).startswith("OBJECT"), F.lit(False)), "claim is not an object")
            .when(F.coalesce(text_kind(c), F.lit("")) != "STRING", "claim has no text")
            .when(F.trim(text(c)) == "", "claim text is empty")
            .when(F.length(text(c)) > MOST_CLAIM_TEXT, "claim text is too long")
            .when(~is_list(c) | ~integers, "claim sources are not integers")
        )

    rows = replies.withColumn("_items", items)
    rows = rows.withColumn(
        "violation",
        F.when(v.isNull(), "invalid JSON")
        .when(~top.startswith("OBJECT"), "not an object")
        .when(F.coalesce(kind("$.abstain"), F.lit("")) != "BOOLEAN", "abstain is not a boolean")
        .when(~F.coalesce(kind("$.claims").startswith("ARRAY"), F.lit(False)), "claims is not a list")
        .when(F.size("_items") > MOST_CLAIMS, "too many claims")
        .otherwise(F.when(F.size("_items") > 0, F.try_element_at(F.filter(F.transform("_items", broken), lambda x: x.isNotNull()), F.lit(1)))),
    )
    good = F.col("violation").isNull()
    claims = F.transform("_items", lambda c: F.struct(text(c).alias("text"), F.transform(sources(c), lambda s: s.try_cast("int")).alias("sources")))
    return rows.withColumn("abstain", F.when(good, get("$.abstain", "boolean"))).withColumn("claims", F.when(good, claims)).drop("_items")


def parsed_relevance(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """``replies`` with ``violation`` and ``relevant`` of the contract {"answers": bool}."""
    v = F.expr(f"try_parse_json(`{raw}`)")
    answers = F.try_variant_get(v, "$.answers", "variant")
    violation = F.when(v.isNull(), "invalid JSON").when(~F.schema_of_variant(v).startswith("OBJECT"), "not an object").when(F.coalesce(F.schema_of_variant(answers), F.lit("")) != "BOOLEAN", "answers is not a boolean")
    return replies.withColumn("violation", violation).withColumn("relevant", F.when(F.col("violation").isNull(), F.try_variant_get(v, "$.answers", "boolean")))


def gate(claims: DataFrame, sources: DataFrame, compat: bool = True) -> DataFrame:
    """``claims`` (query_id, claim_no, text, sources array<int>) with reason (uncited, fabricated, ungrounded, null if kept) and copied.

    ``sources`` (query_id, n, article, text), n from 1.  Rules apply in that order, so no claim is dropped twice.  The sources of an
    answer (a handful) are gathered to one row and joined once."""
    rows = _ruled(claims, sources, compat)
    cited = F.flatten(F.transform("_cited", lambda x: ci.citations(tx.strip_invisible(x["text"]))))
    rows = rows.withColumn("reason", F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.coalesce(F.size(F.array_except("_stray", cited)) > 0, F.lit(False)), "ungrounded"))
    texts = F.transform("_cited", lambda x: tx.strip_invisible(x["text"]))
    rows = rows.withColumn("copied", F.when(F.col("reason").isNull(), ci.copied(F.col("_plain"), texts)))
    return rows.drop("m", "k", "_plain", "_cited", "_stray")


def gate_corpus(claims: DataFrame, sources: DataFrame | str, texts: DataFrame, compat: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, claim_no, reason, copied, articles): the rules of :func:`gate` for ``sources`` (query_id, n, article), or the column
    of ``claims`` that lists their articles, with any number of ``texts`` (article, text) an article: what one of them cites is allowed,
    what stands in one of them is copied.  ``articles`` are those that a kept claim rests on; columns of ``claims`` to ``keep`` follow.

    The ruled claims are written once; only their stray numbers meet what the texts cite, and only their windows the texts' runs."""
    plain = tx.strip_invisible(F.col("text"))
    rows = _ruled(claims, sources if isinstance(sources, str) else sources.select("query_id", "n", "article"), compat)
    open_ = F.col("reason").isNull()
    articles = F.array_distinct(F.filter(F.transform("_cited", lambda x: x["article"]), lambda a: a.isNotNull()))
    rows = rows.select("query_id", "claim_no", "reason", F.when(open_, F.col("_stray")).alias("stray"), F.when(open_, articles).alias("articles"), F.when(open_, ci.copied_windows(F.col("_plain"))).alias("ws"), *keep)
    rows = cut_lineage(rows)

    cites = texts.select("article", F.explode(ci.citations(plain)).alias("c")).distinct().withColumn("known", F.lit(True))
    stray = rows.where("size(stray) > 0").select("query_id", "claim_no", "articles", F.explode("stray").alias("c"))
    stray = stray.select("query_id", "claim_no", "c", F.explode_outer("articles").alias("article")).join(cites.hint("merge"), ["article", "c"], "left")
    stray = stray.groupBy("query_id", "claim_no", "c").agg(F.max("known").alias("known")).where("known is null")

    windows = rows.where("size(articles) > 0 and size(ws) > 0").select("query_id", "claim_no", "articles", F.explode("ws").alias("w"))
    windows = windows.select("query_id", "claim_no", F.explode("articles").alias("article"), "w.*")
    runs = ci.run_hashes(texts, "article", plain, ci.hash_marks(windows))
    found = windows.join(runs.hint("merge"), ["article", "h", "g"], "left_semi")

    marks = stray.select("query_id", "claim_no", F.lit(True).alias("away"), F.lit(False).alias("hit")).unionByName(found.select("query_id", "claim_no", F.lit(False).alias("away"), F.lit(True).alias("hit")))
    marks = marks.groupBy("query_id", "claim_no").agg(F.max("away").alias("away"), F.max("hit").alias("hit"))
    rows = rows.select("query_id", "claim_no", "reason", "articles", *keep).join(marks.hint("merge"), ["query_id", "claim_no"], "left")
    reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.coalesce("away", F.lit(False)), "ungrounded")
    open_ = F.col("reason").isNull()
    rows = rows.select("query_id", "claim_no", reason.alias("reason"), "hit", "articles", *keep)
    return rows.select("query_id", "claim_no", "reason", F.when(open_, F.coalesce("hit", F.lit(False))).alias("copied"), F.when(open_, F.col("articles")).alias("articles"), *keep)


def _ruled(claims: DataFrame, sources: DataFrame | str, compat: bool) -> DataFrame:
    """Claims with their plain text, cited sources, the reason as far as it needs no text, and ``_stray``: cited numbers that are no
    article of a cited source, which makes a claim ungrounded unless a text of one cites them."""
    if isinstance(sources, str):
        rows = claims.withColumn("k", F.coalesce(F.size(sources), F.lit(0)))
        rows = rows.withColumn("_cited", F.transform(F.filter("sources", lambda s: (s >= 1) & (s <= F.col("k"))), lambda s: F.struct(F.get(sources, s - 1).alias("article"))))
    else:
        kept = [c for c in sources.columns if c not in ("query_id", "n")]
        own = sources.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("n", F.struct(*kept)))).alias("m"), F.max("n").alias("k"))
        rows = claims.join(own, "query_id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
        rows = rows.withColumn("_cited", F.filter(F.transform("sources", lambda s: F.try_element_at("m", s)), lambda x: x.isNotNull()))
    numbers = F.filter(F.transform("_cited", lambda x: x["article"]), lambda n: n.isNotNull())
    rows = rows.withColumn("_plain", tx.strip_invisible(tx.evaluation_form(F.col("text"), compat)))
    rows = rows.withColumn("_stray", F.array_except(ci.citations(F.col("_plain")), numbers))
    hazard = tx.has_unsafe_gap(F.col("text")) | tx.has_override(F.col("text"))
    reason = (
        F.when(F.coalesce(F.size("sources"), F.lit(0)) <= 0, "uncited")
        .when(F.exists("sources", lambda s: (s < 1) | (s > F.col("k"))), "fabricated")
        .when(hazard, "ungrounded")
    )
    return rows.withColumn("reason", reason)


def gate_verdicts(answers: DataFrame, gated: DataFrame) -> DataFrame:
    """(query_id, status, kept, dropped, uncited, fabricated, ungrounded, ignored_on_abstain, abstain_reason) per answer.

    ``answers`` (query_id, parsed, abstain, own_reason): claims of an abstention are counted, not checked."""
    counts = gated.groupBy("query_id").agg(
        F.count("*").alias("claims"),
        F.count_if(F.col("reason").isNull()).alias("kept"),
        *[F.count_if(F.coalesce(F.col("reason") == r, F.lit(False))).alias(r) for r in ("uncited", "fabricated", "ungrounded")],
    )
    rows = answers.join(counts, "query_id", "left").na.fill(0, ["claims", "kept", "uncited", "fabricated", "ungrounded"])
    quiet = ~F.col("parsed") | F.coalesce("abstain", F.lit(False))
    zero = lambda c: F.when(quiet, F.lit(0).cast("bigint")).otherwise(F.col(c))
    rows = rows.select(
        "query_id", "parsed", "abstain", "own_reason",
        zero("kept").alias("kept"),
        F.when(quiet, F.lit(0).cast("bigint")).otherwise(F.col("claims") - F.col("kept")).alias("dropped"),
        *[zero(c).alias(c) for c in ("uncited", "fabricated", "ungrounded")],
        F.when(F.col("parsed") & F.coalesce("abstain", F.lit(False)), F.col("claims")).otherwise(F.lit(0).cast("bigint")).alias("ignored_on_abstain"),
    )
    status = F.when(F.col("kept") == 0, "abstained").when(F.col("dropped") > 0, "partial").otherwise("answered")
    why = (
        F.when(F.col("own_reason").isNotNull(), F.col("own_reason"))
        .when(~F.col("parsed"), "schema_failure")
        .when(F.coalesce("abstain", F.lit(False)), "model_abstained")
        .when((F.col("kept") == 0) & (F.col("dropped") > 0), "all_dropped")
        .when(F.col("kept") == 0, "no_claims")
    )
    return rows.withColumn("status", status).withColumn("abstain_reason", why).drop("parsed", "abstain", "own_reason")


def grounding_tally(rows: DataFrame, category: str = "category", batch: str = "model") -> DataFrame:
    """(category, batch, answers, answered, abstained, grounded, fabricated, ungrounded, uncited, copied, rate) by category, by batch and in all.

    Answered, not answerable, is the denominator of the rate."""
    answered = ~F.coalesce(F.col("abstained"), F.lit(False))
    has = lambda c: answered & (F.coalesce(F.size(c), F.lit(0)) > 0)
    out = rows.groupingSets([[F.col(category)], [F.col(batch)], []], F.col(category), F.col(batch)).agg(
        F.grouping(category).alias("gc"),
        F.grouping(batch).alias("gb"),
        F.count("*").alias("answers"),
        F.count_if(answered).alias("answered"),
        F.count_if(~answered).alias("abstained"),
        F.count_if(answered & F.coalesce(F.col("grounded"), F.lit(False))).alias("grounded"),
        *[F.count_if(has(c)).alias(c) for c in ("fabricated", "ungrounded", "uncited", "copied")],
    )
    name = lambda g, c: F.when(F.col(g) == 1, "(all)").otherwise(F.coalesce(F.col(c), F.lit("(none)")))
    return out.select(name("gc", category).alias("category"), name("gb", batch).alias("batch"), "answers", "answered", "abstained", "grounded", "fabricated", "ungrounded", "uncited", "copied", F.round(F.col("grounded") / F.when(F.col("answered") > 0, F.col("answered")), 4).alias("rate"))


def contract_report(rows: DataFrame) -> DataFrame:
    """One row: the headline counts of a free-text run and whether abstention on unanswerable questions meets its goal."""
    answered = ~F.coalesce(F.col("abstained"), F.lit(False))
    able = F.coalesce(F.col("answerable"), F.lit(False))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    out = rows.agg(
        F.count("*").alias("answers"),
        F.count_if(answered).alias("answered"),
        F.count_if(answered & F.coalesce(F.col("grounded"), F.lit(False))).alias("grounded"),
        *[F.count_if(answered & size(c)).alias(c) for c in ("fabricated", "ungrounded", "uncited", "copied")],
        F.count_if(~able).alias("unanswerable"),
        F.count_if(~able & ~answered).alias("abstained_right"),
        F.count_if(able & ~answered).alias("abstained_wrong"),
        F.count_if(able & answered & F.coalesce(F.col("cited_expected"), F.lit(False))).alias("cited_expected"),
        F.round(F.median("seconds"), 4).alias("median_seconds"),
    )
    rate = F.col("abstained_right") / F.when(F.col("unanswerable") > 0, F.col("unanswerable"))
    return out.withColumn("abstention_rate", F.round(rate, 4)).withColumn("abstention_met", F.coalesce(rate >= ABSTENTION_GOAL, F.lit(False))).withColumn("adopted", F.col("abstention_met") & (F.col("cited_expected") >= LEAST_CITED) & (F.col("fabricated") == 0))


def cites_expected(cited: Column, expected: Column) -> Column:
    return F.coalesce(F.arrays_overlap(cited, expected), F.lit(False))


def call_statistics(rows: DataFrame, stats: str = "stats") -> DataFrame:
    """(stage, calls, tokens, tokens_per_s, truncated, cut): tokens per second is a ratio of sums; null stages are ``(none)``."""
    calls = rows.select(F.explode(stats).alias("c")).select("c.*")
    return calls.groupBy(F.coalesce("stage", F.lit("(none)")).alias("stage")).agg(
        F.count("*").alias("calls"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("bigint").alias("tokens"),
        F.round(F.sum("output_tokens") / F.when(F.sum("output_s") > 0, F.sum("output_s")), 3).alias("tokens_per_s"),
        F.count_if(F.coalesce("truncated", F.lit(False))).alias("truncated"),
        F.count_if(F.coalesce("cut", F.lit(False))).alias("cut"),
    )


def retries(rows: DataFrame, key: str, stats: str = "stats") -> DataFrame:
    """(stage, rows, retries): calls beyond the first of a row and stage, summed."""
    per_row = rows.select(key, F.explode(stats).alias("c")).groupBy(key, F.coalesce("c.stage", F.lit("(none)")).alias("stage")).agg(F.count("*").alias("n"))
    return per_row.groupBy("stage").agg(F.count("*").alias("rows"), F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("retries"))


def run_comparison(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, side, <column>_same...): two runs joined by key; ``side`` is both, a or b; comparisons treat nulls as equal."""
    x, y = a.select(F.col(key), F.lit(1).alias("_a"), *[F.col(c).alias(f"a_{c}") for c in columns]), b.select(F.col(key), F.lit(1).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    joined = x.join(y, key, "full")
    side = F.when(F.col("_a").isNull(), "b").when(F.col("_b").isNull(), "a").otherwise("both")
    return joined.select(key, side.alias("side"), *[F.when(side == "both", F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(f"{c}_same") for c in columns])


def variance(rows: DataFrame, run: str, question: str, text: str, metric: str, decimals: int = 4) -> DataFrame:
    """One row (runs, signatures, varying, span): how far repeated runs differ.

    A run's signature is the hash of its sorted (question, text) pairs' hashes, so no run's texts are gathered."""
    pairs = rows.select(run, question, F.sha2(F.coalesce(text, F.lit("\0")), 256).alias("h"), metric)
    # order-free: the sum of row hashes stands for the set of a run's rows
    signature = pairs.groupBy(run).agg(F.sum(F.xxhash64(question, "h").cast("decimal(38,0)")).alias("sig"), F.avg(metric).alias("m"))
    varying = pairs.groupBy(question).agg(F.count_distinct("h").alias("n")).where("n > 1").agg(F.count("*").alias("varying"))
    return signature.agg(F.count("*").alias("runs"), F.count_distinct("sig").alias("signatures"), F.round(F.max("m") - F.min("m"), decimals).alias("span")).crossJoin(varying).select("runs", "signatures", "varying", "span")


def set_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): keys added to and dropped from a set."""
    a, b = old.select(key).distinct(), new.select(key).distinct()
    return b.join(a, key, "left_anti").select(key, F.lit("added").alias("change")).unionByName(a.join(b, key, "left_anti").select(key, F.lit("dropped").alias("change")))


def claims_report(answers: DataFrame, verdicts: DataFrame, claims: DataFrame, least_cited: int = LEAST_CITED) -> DataFrame:
    """One row: a claims run in figures, and whether it may be adopted.

    ``answers`` (query_id, answerable, cites_expected), ``verdicts`` as of :func:`gate_verdicts`, ``claims`` (query_id, reason, copied, and
    text, or short: whether it is shorter than a claim).
    Claims of an abstention were not checked and count as ignored only.  Adopted: nothing fabricated, four fifths of the unanswerable
    questions declined, enough expected articles cited."""
    rows = answers.join(verdicts, "query_id")
    able = F.coalesce(F.col("answerable"), F.lit(False))
    away = F.col("status") == "abstained"
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    out = rows.agg(
        F.count_if(able).alias("answerable"), F.count_if(~able).alias("unanswerable"), F.count_if(able & (F.col("kept") > 0)).alias("covered"),
        F.count_if(able & away).alias("false_abstentions"), F.count_if(~able & away).alias("right_abstentions"),
        F.count_if(able & F.coalesce("cites_expected", F.lit(False))).alias("cited_expected"),
        F.count_if(F.coalesce(F.col("abstain_reason") == "schema_failure", F.lit(False))).alias("schema_failures"),
        *[F.count_if(F.col("status") == x).alias(x) for x in ("answered", "partial", "abstained")],
        *[total(c) for c in ("ignored_on_abstain", "fabricated", "uncited", "ungrounded")],
    )
    kept = claims.where("reason is null").join(verdicts.where("kept > 0").select("query_id"), "query_id", "left_semi")
    short = F.col("short") if "short" in claims.columns else F.length(F.trim("text")) < ci.LEAST_CLAIM
    texts = kept.agg(F.count("*").alias("kept_claims"), F.count_if(F.coalesce("copied", F.lit(False))).alias("copied_claims"), F.count_if(short).alias("short_claims"))
    rate = F.when(F.col("unanswerable") > 0, F.col("right_abstentions") / F.col("unanswerable")).otherwise(0.0)
    out = out.crossJoin(F.broadcast(texts)).withColumn("abstention_rate", F.round(rate, 4))
    return out.withColumn("adopted", (F.col("fabricated") == 0) & (rate >= ABSTENTION_GOAL) & (F.col("cited_expected") >= least_cited))


def app_summary(rows: DataFrame, decimals: int = 4) -> DataFrame:
    """One row of an app run: coverage, page-grounded answers, abstentions right and wrong, fabricated claims, mean seconds.

    ``rows`` (answerable, status, kept, page_grounded, fabricated, seconds), one a question."""
    able, away = F.coalesce(F.col("answerable"), F.lit(False)), F.col("status") == "abstained"
    return rows.agg(
        F.count_if(able).alias("answerable"), F.count_if(~able).alias("out_of_document"), F.count_if(able & (F.col("kept") > 0)).alias("covered"),
        F.count_if(able & F.coalesce("page_grounded", F.lit(False))).alias("page_grounded"), F.count_if(~able & away).alias("right_abstentions"), F.count_if(able & away).alias("false_abstentions"),
        F.coalesce(F.sum("fabricated"), F.lit(0)).cast("bigint").alias("fabricated"), F.round(F.avg("seconds"), decimals).alias("mean_seconds"),
    )


def missing_articles(answers: DataFrame, key: str, retrieved: str, numbers: DataFrame, number: str) -> DataFrame:
    """(key, number): retrieved articles that the corpus doesn't have; any row means that it is not the corpus the run saw."""
    return answers.select(key, F.explode(F.array_distinct(retrieved)).alias(number)).join(numbers.select(number).distinct(), number, "left_anti").select(key, number)


def require_articles(answers: DataFrame, key: str, retrieved: str, numbers: DataFrame, number: str) -> None:
    """Raise if a saved answer retrieved an article that the corpus lacks, before it is audited again."""
    lost = missing_articles(answers, key, retrieved, numbers, number).limit(5).collect()
    if lost:
        raise ValueError(f"retrieved articles that the corpus lacks: {', '.join(f'{r[0]}: {r[1]}' for r in lost)}")
