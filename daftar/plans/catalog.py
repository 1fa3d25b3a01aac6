"""Query names of the core -> (callable, SQL twin).

Searches ask with every row whose id is divisible by 100, against all rows; every other query runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.functions import citations as ci
from daftar.functions import text as tx
from daftar.operators import answers as an
from daftar.operators import dense, drift, evaluate, fusion, glyphs, identity, lexical, ocr, quality, segment
from daftar.plans import sql
from daftar.session import cut_lineage, spread, table
from daftar.streaming import limits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# --- tables, one row a key --------------------------------------------------------------------------


def articles(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "articles")).select("article_ref", "id", "text", "search_text", "char_len", "law_name", "source_file").dropDuplicates(["article_ref"])


def questions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "questions").dropDuplicates(["id"])


def answers(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "answer_rows")).dropDuplicates(["answer_no"])


def asked(s: SparkSession, d: str) -> DataFrame:
    """The stated query set: questions whose number is divisible by 100."""
    return questions(s, d).where("cast(substring(id, 2) as bigint) % 100 = 0 and question is not null")


A = "(SELECT DISTINCT article_ref, id, text, search_text, char_len, law_name, source_file FROM articles)"
Q = "(SELECT DISTINCT id, category, question, expected_articles, expected_keywords, answerable, split, source FROM questions)"
ASKED = f"(SELECT * FROM {Q} WHERE CAST(substr(id, 2) AS BIGINT) % 100 = 0 AND question IS NOT NULL)"
R = "(SELECT DISTINCT ON (answer_no) * FROM answer_rows)"
DOC_TERMS = f"SELECT article_ref AS id, {sql.search_tokens('text')} AS ts FROM {A} WHERE text IS NOT NULL"
QUERY_TERMS = f"SELECT id AS query_id, {sql.search_tokens('question')} AS ts FROM {ASKED}"
DOC_CONTENT = f"SELECT article_ref AS id, {sql.content_tokens('text')} AS ts FROM {A} WHERE text IS NOT NULL"
QUERY_CONTENT = f"SELECT id AS query_id, {sql.content_tokens('question')} AS ts FROM {ASKED}"


def _terms(c: str) -> Column:
    return tx.search_tokens(F.col(c), compat=False)


def _content(c: str) -> Column:
    return tx.content_tokens(F.col(c), compat=False)


def _bm25(s: SparkSession, d: str, k: int, terms: Callable[[str], Column] = _terms) -> DataFrame:
    return lexical.bm25(asked(s, d), "id", terms("question"), articles(s, d).where("text is not null"), "article_ref", terms("text"), k)


# --- text functions ---------------------------------------------------------------------------------


@query(f"SELECT article_ref, {sql.evaluation('text')} AS evaluation, {sql.orthographic('text')} AS orthographic FROM {A}")
def normalize_articles(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return articles(s, d).select("article_ref", tx.evaluation_form(t, compat=False).alias("evaluation"), tx.orthographic_form(t, compat=False).alias("orthographic"))


@query(f"WITH {sql.nfkc(A, 'article_ref', 'text')} SELECT key AS article_ref, {sql.evaluation('text')} AS evaluation, array_to_string({sql.search_tokens('text')}, ' ') AS search FROM compat")
def normalize_articles_nfkc(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return articles(s, d).select("article_ref", tx.evaluation_form(t).alias("evaluation"), tx.search_form(t).alias("search"))


@query(f"SELECT article_ref, array_to_string({sql.search_tokens('text')}, ' ') AS search FROM {A}")
def search_normalize_articles(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).select("article_ref", tx.search_form(F.col("text"), compat=False).alias("search"))


@query(f"SELECT id, array_to_string({sql.content_tokens('question')}, ' ') AS tokens, CAST(len({sql.content_tokens('question')}) AS BIGINT) AS n FROM {Q} WHERE question IS NOT NULL")
def content_tokens_questions(s: SparkSession, d: str) -> DataFrame:
    ts = _content("question")
    return questions(s, d).where("question is not null").select("id", F.array_join(ts, " ").alias("tokens"), F.size(ts).cast("bigint").alias("n"))


_EDGE = "[،.:؛()\"'“”]+"
_STRIPPED = f"list_transform(list_filter(string_split_regex(text, {sql.q(tx.SPACE + '+')}), lambda t: t <> ''), lambda t: regexp_replace(t, {sql.q(f'^{_EDGE}|{_EDGE}$')}, '', 'g'))"
_VOCABULARY = f"SELECT term, count(*) AS n FROM (SELECT unnest({_STRIPPED}) AS term FROM {A}) WHERE term <> '' GROUP BY term"


@query(_VOCABULARY)
def vocabulary_counts(s: SparkSession, d: str) -> DataFrame:
    return quality.vocabulary(articles(s, d))


@query(f"""SELECT article_ref, substr(text, 1, 280) AS snippet, CAST(length({sql.replace_all('text', tx.SPACE)}) AS BIGINT) AS visible,
    coalesce(TRY_CAST(regexp_extract(id, '^law-(\\d+)$', 1) AS BIGINT), 0) AS number, CAST(coalesce(TRY_CAST(regexp_extract(article_ref, '(\\d+)', 1) AS INTEGER), 0) AS BIGINT) AS place,
    {sql.typist('text', 'all')} AS typed, {sql.replace_all('text', tx.INVISIBLE)} AS shown, regexp_matches(text, {sql.q(tx.DIRECTION)}) AS override,
    array_to_string(regexp_extract_all(text, {sql.q('(' + tx.DIGIT_RUN + ')')}, 1), ' ') AS digits FROM {A} WHERE text IS NOT NULL""")
def scalar_functions(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return articles(s, d).where("text is not null").select(
        "article_ref", tx.snippet(t).alias("snippet"), tx.visible_length(t).cast("bigint").alias("visible"), F.coalesce(tx.article_number(F.col("id")).cast("bigint"), F.lit(0)).alias("number"),
        tx.page_order(F.col("article_ref")).cast("bigint").alias("place"), tx.typist_form(t, "all").alias("typed"), tx.strip_invisible(t).alias("shown"),
        tx.has_override(t).alias("override"), F.array_join(tx.digit_tokens(t), " ").alias("digits"),
    )


_STRONG = r"\x{200F}\x{061C}\x{0640}\x{06E5}\x{06E6}\x{06DD}"
_DIGIT = "[0-9٠-٩۰-۹]"
_DROPPED = tx.INVISIBLE[:-1] + tx.MARKS[1:-1] + "ـ]"


@query(f"""SELECT answer_no, regexp_matches(text, {sql.q(f"{_DIGIT}{_DROPPED}*[{_STRONG}]{_DROPPED}*{_DIGIT}")}) AS gap, regexp_matches(text, {sql.q(tx.DIRECTION)}) AS override, md5({sql.tidy('text')}) AS tidy_md5 FROM {R} WHERE text IS NOT NULL""")
def unsafe_text(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    rows = answers(s, d).where("text is not null").select("answer_no", tx.has_unsafe_gap(t).alias("gap"), tx.has_override(t).alias("override"), tx.tidy(t).alias("tidy"))
    return rows.select("answer_no", "gap", "override", F.md5("tidy").alias("tidy_md5"))


@query(f"SELECT DISTINCT law_name FROM {A} WHERE law_name <> ''")
def law_names(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).where("law_name <> ''").select("law_name").distinct()


# --- lexical search ---------------------------------------------------------------------------------


@query(f"WITH {sql.bm25(QUERY_TERMS, DOC_TERMS, 5)} SELECT query_id, id, rank, score FROM hits")
def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    return _bm25(s, d, 5)


@query(f"WITH {sql.bm25(QUERY_TERMS, DOC_TERMS, 5)} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_term_stats(s: SparkSession, d: str) -> DataFrame:
    tokens = lexical.tokenized(articles(s, d).where("text is not null"), "article_ref", _terms("text"))
    stats = lexical.term_stats(lexical.postings(tokens), lexical.corpus_stats(tokens))
    return stats.select("term", "df", F.round("idf", 6).alias("idf"))


def _expected(s: SparkSession, d: str) -> DataFrame:
    return asked(s, d).where("size(expected_articles) > 0").select(F.col("id").alias("query_id"), F.explode("expected_articles").alias("id"))


def _by_id(s: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    ids = articles(s, d).select("article_ref", F.col("id").alias("article"))
    return hits.join(ids, hits["id"] == ids["article_ref"]).groupBy("query_id", F.col("article").alias("id")).agg(F.min("rank").alias("rank"))


def _scores(s: SparkSession, d: str, k: int) -> DataFrame:
    return evaluate.per_question(_expected(s, d), _by_id(s, d, _bm25(s, d, k)), k)


def _scores_sql(k: int) -> str:
    return f"""{sql.bm25(QUERY_TERMS, DOC_TERMS, k)},
        by_id AS (SELECT h.query_id, a.id, min(rank) AS rank FROM hits h JOIN {A} a ON h.id = a.article_ref GROUP BY ALL),
        wanted AS (SELECT id AS query_id, unnest(expected_articles) AS id FROM {ASKED} WHERE len(expected_articles) > 0),
        scores_q AS (SELECT query_id, round(avg(CASE WHEN rank IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS recall, round(coalesce(1.0::DOUBLE / min(rank), 0.0::DOUBLE), 6) AS rr
            FROM wanted LEFT JOIN by_id USING (query_id, id) GROUP BY query_id)"""


@query(f"WITH {_scores_sql(5)} SELECT query_id, recall, rr FROM scores_q")
def bm25_recall(s: SparkSession, d: str) -> DataFrame:
    return _scores(s, d, 5)


@query(f"""WITH {_scores_sql(5)},
    rows_q AS (SELECT q.id, q.category, q.answerable, s.recall, s.rr, q.answerable AND s.recall IS NOT NULL AS scored FROM {ASKED} q LEFT JOIN scores_q s ON q.id = s.query_id)
    SELECT CASE WHEN grouping(category) = 1 THEN 'TOTAL' ELSE coalesce(category, '(none)') END AS category, count(*) AS questions, count(*) FILTER (scored) AS scored,
        round(avg(recall) FILTER (scored), 4) AS recall, round(avg(rr) FILTER (scored), 4) AS mrr FROM rows_q GROUP BY ROLLUP (category)""")
def bm25_scoreboard(s: SparkSession, d: str) -> DataFrame:
    return evaluate.scoreboard(asked(s, d).select(F.col("id").alias("query_id"), "category", "answerable"), _scores(s, d, 5))


DIMENSIONS = 64
_BUCKETS = lambda ts: f"list_transform({ts}, lambda t: CAST('0x' || substr(md5(t), 1, 6) AS BIGINT) % {DIMENSIONS})"
_COUNTS = f"list_transform(range(0, {DIMENSIONS}), lambda k: CAST(len(list_filter(bs, lambda b: b = k)) AS DOUBLE))"
_UNIT = "CASE WHEN list_sum(list_transform(v, lambda x: x * x)) > 0 THEN list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) ELSE v END"
_ENCODED = lambda key, select: f"(SELECT {key}, {_UNIT} AS v FROM (SELECT {key}, {_COUNTS} AS v FROM (SELECT {key}, {_BUCKETS('ts')} AS bs FROM ({select}))))"
_DENSE_HITS = f"""dense_scores AS (SELECT q.query_id, t.id, round(list_sum(list_transform(list_zip(q.v, t.v), lambda z: z[1] * z[2])), 4) AS score FROM {_ENCODED('query_id', QUERY_TERMS)} q, {_ENCODED('id', DOC_TERMS)} t),
    dense_hits AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, score FROM dense_scores) WHERE rank <= 20)"""
_RRF = f"""a AS (WITH {sql.bm25(QUERY_TERMS, DOC_TERMS, 20)} SELECT * FROM hits), {_DENSE_HITS}, b AS (SELECT * FROM dense_hits),
    fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL),
    best AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, score FROM fused)"""


def _dense(s: SparkSession, d: str, k: int) -> DataFrame:
    """Cosine search over hashed terms, which stand for an encoder's vectors: any encoder may be injected in their place."""
    vector = lambda c: dense.hashed_terms(_terms(c), DIMENSIONS).alias("embedding")
    queries = asked(s, d).select("id", vector("question"))
    return dense.cosine_topk(queries, "id", articles(s, d).where("text is not null").select("article_ref", vector("text")), "article_ref", k)


def _fused(s: SparkSession, d: str, k: int) -> DataFrame:
    """Hybrid search: the lexical and the dense list of twenty, fused."""
    return fusion.reciprocal_rank_fusion([_bm25(s, d, 20), _dense(s, d, 20)], k)


@query(f"WITH {_RRF} SELECT query_id, id, rank, score FROM best WHERE rank <= 5")
def rrf_fusion(s: SparkSession, d: str) -> DataFrame:
    return _fused(s, d, 5)


@query(f"""WITH {_RRF}, wanted AS (SELECT id AS query_id, unnest(expected_articles) AS id FROM {ASKED} WHERE len(expected_articles) > 0),
    by_id AS (SELECT h.query_id, a.id, min(rank) AS rank FROM best h JOIN {A} a ON h.id = a.article_ref WHERE rank <= 20 GROUP BY ALL),
    per_q AS (SELECT query_id, avg(CASE WHEN rank IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS recall FROM wanted LEFT JOIN by_id USING (query_id, id) GROUP BY query_id)
    SELECT count(*) AS questions, round(avg(recall), 6) AS ceiling FROM per_q""")
def candidate_ceiling(s: SparkSession, d: str) -> DataFrame:
    scores = evaluate.per_question(_expected(s, d), _by_id(s, d, _fused(s, d, 20)), 20, decimals=12)
    return scores.agg(F.count("*").alias("questions"), F.round(F.avg("recall"), 6).alias("ceiling"))


@query(f"""WITH {_RRF}, t AS ({DOC_CONTENT}), qq AS ({QUERY_CONTENT}),
    scored AS (SELECT b.query_id, b.id, round(CASE WHEN len(qq.ts) > 0 THEN CAST(len(list_filter(qq.ts, lambda x: list_contains(t.ts, x))) AS DOUBLE) / len(qq.ts) ELSE 0.0 END, 4) AS score
        FROM best b JOIN t ON b.id = t.id JOIN qq ON b.query_id = qq.query_id WHERE b.rank <= 20)
    SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, score FROM scored) WHERE rank <= 5""")
def rerank_overlap(s: SparkSession, d: str) -> DataFrame:
    return _reranked(s, d, _fused(s, d, 20))


def _reranked(s: SparkSession, d: str, candidates: DataFrame) -> DataFrame:
    texts = articles(s, d).select(F.col("article_ref").alias("id"), "text")
    return fusion.rerank(candidates, texts, asked(s, d).select(F.col("id").alias("query_id"), F.col("question").alias("query")), fusion.containment(_content("query"), _content("text")), 5)


_ABLATION = ["direct", "multi_article", "colloquial"]


@query(f"""WITH {_RRF}, t AS ({DOC_CONTENT}), qq AS ({QUERY_CONTENT}),
    scored AS (SELECT b.query_id, b.id, round(CASE WHEN len(qq.ts) > 0 THEN CAST(len(list_filter(qq.ts, lambda x: list_contains(t.ts, x))) AS DOUBLE) / len(qq.ts) ELSE 0.0 END, 4) AS score
        FROM best b JOIN t ON b.id = t.id JOIN qq ON b.query_id = qq.query_id WHERE b.rank <= 20),
    configs AS (SELECT 'bm25' AS config, query_id, id, rank FROM a WHERE rank <= 5 UNION ALL SELECT 'dense', query_id, id, rank FROM b WHERE rank <= 5 UNION ALL SELECT 'hybrid', query_id, id, rank FROM best WHERE rank <= 5
        UNION ALL SELECT 'hybrid_rerank', query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 5),
    by_id AS (SELECT config, query_id, a.id, min(rank) AS rank FROM configs h JOIN {A} a ON h.id = a.article_ref GROUP BY ALL), names AS (SELECT unnest(['bm25', 'dense', 'hybrid', 'hybrid_rerank']) AS config),
    wanted AS (SELECT id AS query_id, category, unnest(expected_articles) AS id FROM {ASKED} WHERE len(expected_articles) > 0),
    sc AS (SELECT n.config, w.query_id, any_value(w.category) AS category, round(avg(CASE WHEN rank IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS recall, round(coalesce(1.0::DOUBLE / min(rank), 0.0::DOUBLE), 6) AS rr FROM names n CROSS JOIN wanted w LEFT JOIN by_id b ON b.config = n.config AND b.query_id = w.query_id AND b.id = w.id GROUP BY n.config, w.query_id),
    cf AS (SELECT config, avg(recall) AS r, round(avg(rr), 6) AS mrr, {', '.join(f"round(avg(recall) FILTER (category = '{c}'), 6) AS {c}_recall" for c in _ABLATION)} FROM sc GROUP BY config)
    SELECT config, round(r, 6) AS recall, mrr, {', '.join(f'{c}_recall' for c in _ABLATION)}, round(r - (SELECT r FROM cf WHERE config = 'bm25'), 6) AS delta FROM cf""")
def ablation_table(s: SparkSession, d: str) -> DataFrame:
    # each list of twenty is made once, and the shorter lists are its heads
    bm25, near = cut_lineage(_bm25(s, d, 20)), cut_lineage(_dense(s, d, 20))
    fused = cut_lineage(fusion.reciprocal_rank_fusion([bm25, near], 20))
    head = lambda hits: hits.where("rank <= 5")
    configs = {"bm25": head(bm25), "dense": head(near), "hybrid": head(fused), "hybrid_rerank": _reranked(s, d, fused)}
    scores = [evaluate.per_question(_expected(s, d), _by_id(s, d, hits), 5).withColumn("config", F.lit(name)) for name, hits in configs.items()]
    return evaluate.ablation(reduce(DataFrame.unionByName, scores), asked(s, d).select(F.col("id").alias("query_id"), "category"), "bm25", _ABLATION)


_PROBES = f"""cases AS (SELECT id AS query_id, expected_articles[1] AS expected, regexp_extract(expected_articles[1], '^([a-z]+)-', 1) AS book, TRY_CAST(regexp_extract(expected_articles[1], '-(\\d+)$', 1) AS INTEGER) AS n FROM {ASKED} WHERE len(expected_articles) > 0)"""


@query(f"""WITH {sql.bm25(QUERY_TERMS, DOC_TERMS, 20)}, by_id AS (SELECT h.query_id, a.id, min(rank) AS rank FROM hits h JOIN {A} a ON h.id = a.article_ref GROUP BY ALL), {_PROBES},
    ranked AS (SELECT query_id, expected, (SELECT rank FROM by_id b WHERE b.query_id = c.query_id AND b.id = c.expected) AS expected_rank, list_filter([book || '-' || (n - 1), book || '-' || (n + 1)], lambda x: x IS NOT NULL) AS ds FROM cases c),
    ahead AS (SELECT r.query_id, string_agg(b.id, ',' ORDER BY b.rank, b.id) AS ids FROM ranked r JOIN by_id b ON b.query_id = r.query_id AND list_contains(ds, b.id) WHERE expected_rank IS NULL OR b.rank < expected_rank GROUP BY r.query_id)
    SELECT r.query_id, expected, expected_rank, coalesce(ids, '') AS outranked_by, coalesce(expected_rank <= 5, false) AND ids IS NULL AS passed FROM ranked r LEFT JOIN ahead USING (query_id)""")
def probe_ranks(s: SparkSession, d: str) -> DataFrame:
    """The first expected article of each question against its two neighbours in the law as distractors."""
    first = F.element_at("expected_articles", 1)
    book, n = F.regexp_extract(first, "^([a-z]+)-", 1), F.regexp_extract(first, r"-(\d+)$", 1).try_cast("int")
    near = lambda k: F.concat_ws("-", book, (n + k).cast("string"))
    cases = asked(s, d).where("size(expected_articles) > 0").select(F.col("id").alias("query_id"), first.alias("expected"), F.when(n.isNotNull(), F.array(near(-1), near(1))).alias("distractors"))
    out = evaluate.probe_ranks(cases, _by_id(s, d, _bm25(s, d, 20)), 5)
    return out.withColumn("outranked_by", F.array_join("outranked_by", ","))


def _sweep(s: SparkSession, d: str) -> DataFrame:
    """(form, query_id, article, rank): ranks of the expected articles under each spelling."""
    forms = ["as_written", *tx.TYPIST_FORMS, "all"]
    rows = asked(s, d).select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("form"), tx.typist_form(F.col("question"), f).alias("question")) for f in forms])).alias("x")).select(F.struct("x.form", "id").alias("key"), "x.question")
    hits = lexical.bm25(rows, "key", _terms("question"), articles(s, d).where("text is not null"), "article_ref", _terms("text"), 20)
    found = _by_id(s, d, hits).select("query_id.form", F.col("query_id.id").alias("query_id"), F.col("id").alias("article"), "rank")
    wanted = _expected(s, d).select("query_id", F.col("id").alias("article")).distinct().crossJoin(F.broadcast(s.createDataFrame([(f,) for f in forms], "form string")))
    return wanted.join(found, ["form", "query_id", "article"], "left")


_SWEEP = " UNION ALL ".join(f"SELECT {sql.q(f)} || '/' || id AS query_id, {sql.search_tokens(sql.typist('question', f))} AS ts FROM {ASKED}" for f in ["as_written", *tx.TYPIST_FORMS, "all"])
_SWEEP_SQL = f"""{sql.bm25(_SWEEP, DOC_TERMS, 20)},
    by_id AS (SELECT split_part(query_id, '/', 1) AS form, split_part(query_id, '/', 2) AS query_id, a.id AS article, min(rank) AS rank FROM hits h JOIN {A} a ON h.id = a.article_ref GROUP BY ALL),
    wanted AS (SELECT DISTINCT id AS query_id, unnest(expected_articles) AS article FROM {ASKED} WHERE len(expected_articles) > 0),
    swept AS (SELECT f.form, w.query_id, w.article, b.rank FROM wanted w, (SELECT unnest(['as_written', {', '.join(sql.q(f) for f in [*tx.TYPIST_FORMS, 'all'])}]) AS form) f LEFT JOIN by_id b ON b.form = f.form AND b.query_id = w.query_id AND b.article = w.article)"""


@query(f"""WITH {_SWEEP_SQL} SELECT v.form, count(DISTINCT v.query_id) FILTER (v.rank IS DISTINCT FROM o.rank) AS moved,
    count(*) FILTER (coalesce(o.rank <= 5, false) AND NOT coalesce(v.rank <= 5, false)) AS left_top, count(*) FILTER (NOT coalesce(o.rank <= 5, false) AND coalesce(v.rank <= 5, false)) AS entered_top
    FROM swept v JOIN swept o ON o.form = 'as_written' AND o.query_id = v.query_id AND o.article = v.article WHERE v.form <> 'as_written' GROUP BY v.form""")
def orthographic_sweep(s: SparkSession, d: str) -> DataFrame:
    rows = cut_lineage(_sweep(s, d))  # both sides of the join come from one search
    before = rows.where("form = 'as_written'").select("query_id", "article", F.col("rank").alias("was"))
    both = rows.where("form <> 'as_written'").join(before, ["query_id", "article"])
    was, now = F.coalesce(F.col("was") <= 5, F.lit(False)), F.coalesce(F.col("rank") <= 5, F.lit(False))
    return both.groupBy("form").agg(F.count_distinct(F.when(~F.col("rank").eqNullSafe(F.col("was")), F.col("query_id"))).alias("moved"), F.count_if(was & ~now).alias("left_top"), F.count_if(~was & now).alias("entered_top"))


@query(f"""WITH {_SWEEP_SQL} SELECT query_id, article, count(DISTINCT coalesce(rank, -1)) = 1 AS stable, coalesce(max(coalesce(rank, 1000)) <= 5, false) AND count(DISTINCT coalesce(rank, -1)) = 1 AS passed, min(rank) AS best FROM swept GROUP BY ALL""")
def orthographic_stability(s: SparkSession, d: str) -> DataFrame:
    stable = F.count_distinct(F.coalesce("rank", F.lit(-1))) == 1
    return _sweep(s, d).groupBy("query_id", "article").agg(stable.alias("stable"), ((F.max(F.coalesce("rank", F.lit(1000))) <= 5) & stable).alias("passed"), F.min("rank").alias("best"))


# --- dense search -----------------------------------------------------------------------------------


def _vectors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(s, d, "embeddings")
    return v.where("vec_id % 100 = 0"), v


_DOT = "list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_SIMILAR = f"sim AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, {_DOT} AS score FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q, embeddings v)"


@query(f"WITH {_SIMILAR} SELECT * FROM (SELECT query_id, vec_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, vec_id) AS rank, round(score, 4) AS score FROM sim) WHERE rank <= 5")
def dense_topk(s: SparkSession, d: str) -> DataFrame:
    return dense.cosine_topk(*_pair(s, d), "vec_id", 5)


def _pair(s: SparkSession, d: str) -> tuple[DataFrame, str, DataFrame]:
    queries, vectors = _vectors(s, d)
    return queries, "vec_id", vectors


@query(f"""WITH {_SIMILAR}, pooled AS (SELECT query_id, vec_id // 4 AS id, round(max(score), 4) AS score FROM sim GROUP BY ALL)
    SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, score FROM pooled) WHERE rank <= 5""")
def dense_maxpool(s: SparkSession, d: str) -> DataFrame:
    queries, vectors = _vectors(s, d)
    return dense.cosine_topk(queries, "vec_id", vectors.withColumn("doc", F.expr("vec_id div 4")), "doc", 5)


@query(f"""WITH {_SIMILAR}, own AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS r FROM sim WHERE label IS NOT NULL)
    SELECT * FROM (SELECT query_id, label AS doc, vec_id AS chunk, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, vec_id, label) AS rank, round(score, 4) AS score FROM own WHERE r <= 5) WHERE rank <= 5""")
def library_scoped_search(s: SparkSession, d: str) -> DataFrame:
    queries, vectors = _vectors(s, d)
    live = vectors.where("label is not null").select("label").distinct().withColumn("created_at", F.lit(None).cast("timestamp"))
    return dense.library_search(queries, "vec_id", vectors, "label", "vec_id", 5, live)


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm, CAST(len(embedding) AS BIGINT) AS size FROM embeddings")
def vector_norms(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return v.select("vec_id", F.round(norm, 6).alias("norm"), F.size("embedding").cast("bigint").alias("size"))


_STORED = """v AS (SELECT CASE WHEN vec_id % 13 = 5 THEN vec_id + 1000000 ELSE vec_id END AS vec_id, CASE WHEN vec_id % 7 = 3 THEN embedding[1:63] WHEN vec_id % 11 = 4 THEN list_concat([CAST('nan' AS FLOAT)], embedding[2:]) ELSE embedding END AS e FROM embeddings WHERE vec_id % 17 <> 6)"""


@query(f"""WITH {_STORED}, p AS (SELECT 'wrong_dimension' AS problem, count(*) FILTER (len(e) <> 64) AS rows FROM v UNION ALL SELECT 'not_finite', count(*) FILTER (len(list_filter(e, lambda x: isnan(x))) > 0) FROM v
    UNION ALL SELECT 'document_without_vector', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM v) UNION ALL SELECT 'vector_without_document', count(DISTINCT vec_id) FROM v WHERE vec_id NOT IN (SELECT vec_id FROM embeddings))
    SELECT * FROM p WHERE rows > 0""")
def index_problems(s: SparkSession, d: str) -> DataFrame:
    """A stored index with faults of each kind, made of the vectors by rules on their ids, against the vectors as they are."""
    v = table(s, d, "embeddings")
    e = F.when(F.col("vec_id") % 7 == 3, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 11 == 4, F.concat(F.array(F.lit(float("nan")).cast("float")), F.slice("embedding", 2, 63))).otherwise(F.col("embedding"))
    stored = v.where("vec_id % 17 <> 6").select(F.when(F.col("vec_id") % 13 == 5, F.col("vec_id") + 1000000).otherwise(F.col("vec_id")).alias("vec_id"), e.alias("embedding"))
    return dense.index_problems(stored, v, "vec_id", 64)


# --- guards -----------------------------------------------------------------------------------------


@query(f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY added_at) AS r FROM questions)
    SELECT id, CAST(r AS BIGINT) AS delivery, array_to_string(list_filter([CASE WHEN id IS NULL THEN 'missing id' END, CASE WHEN coalesce(question, '') = '' THEN 'missing question' END,
        CASE WHEN NOT coalesce(category IN ('direct', 'multi_article', 'colloquial', 'out_of_corpus'), false) THEN 'unknown category' END,
        CASE WHEN NOT coalesce(split IN ('train', 'dev', 'test'), false) THEN 'unknown split' END, CASE WHEN r > 1 THEN 'duplicate id' END,
        CASE WHEN answerable AND coalesce(len(expected_articles), 0) = 0 THEN 'answerable without expected articles' END,
        CASE WHEN NOT answerable AND coalesce(len(expected_articles), 0) > 0 THEN 'unanswerable with expected articles' END], lambda e: e IS NOT NULL), '; ') AS errors FROM x""")
def question_errors(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = quality.question_errors(table(s, d, "questions"), "added_at").withColumn("delivery", F.row_number().over(Window.partitionBy("id").orderBy("added_at")).cast("bigint"))
    return rows.select("id", "delivery", F.array_join("errors", "; ").alias("errors"))


@query(f"""WITH f AS (SELECT DISTINCT source_file FROM {A} WHERE source_file IS NOT NULL), known AS (SELECT DISTINCT source_file, id FROM {A} WHERE id IS NOT NULL), w AS (SELECT DISTINCT id, unnest(expected_articles) AS article_id FROM {Q})
    SELECT 'all' AS corpus, id, article_id FROM w WHERE article_id NOT IN (SELECT id FROM known) UNION ALL SELECT (SELECT min(source_file) FROM f), id, article_id FROM w WHERE article_id NOT IN (SELECT id FROM known WHERE source_file = (SELECT min(source_file) FROM f))""")
def missing_references(s: SparkSession, d: str) -> DataFrame:
    """References that the whole corpus lacks, and those that its first source file alone lacks."""
    rows = articles(s, d)
    first = rows.agg(F.min("source_file").alias("source_file"))
    lost = quality.missing_references(questions(s, d), rows).select(F.lit("all").alias("corpus"), "id", "article_id")
    alone = quality.missing_references(questions(s, d), rows.join(F.broadcast(first), "source_file", "left_semi"))
    return lost.unionByName(alone.crossJoin(F.broadcast(first)).select(F.col("source_file").alias("corpus"), "id", "article_id"))


@query(f"""WITH w AS (SELECT DISTINCT id, unnest(expected_articles) AS article_id, expected_keywords FROM {Q}),
    p AS (SELECT w.id, a.text, unnest(expected_keywords) AS keyword FROM w JOIN {A} a ON a.id = w.article_id WHERE a.text IS NOT NULL)
    SELECT id, keyword FROM p GROUP BY ALL HAVING NOT max(contains(text, keyword))""")
def missing_keywords(s: SparkSession, d: str) -> DataFrame:
    return quality.missing_keywords(questions(s, d), articles(s, d))


@query(f"""WITH t AS (SELECT id AS article_id, list_sort(list_distinct(flatten(list({sql.content_tokens('text')})))) AS dt FROM {A} WHERE text IS NOT NULL GROUP BY id),
    p AS (SELECT DISTINCT id, category, question, unnest(expected_articles) AS article_id FROM {Q} WHERE question IS NOT NULL),
    x AS (SELECT p.id, p.category, p.article_id, {sql.content_tokens('p.question')} AS qt, dt FROM p JOIN t USING (article_id)),
    y AS (SELECT *, list_filter(qt, lambda w: list_contains(dt, w)) AS common FROM x),
    z AS (SELECT *, round(CASE WHEN len(qt) > 0 THEN CAST(len(common) AS DOUBLE) / len(qt) ELSE 0.0 END, 4) AS overlap,
        coalesce(CASE category WHEN 'direct' THEN 0.15 WHEN 'multi_article' THEN 0.15 WHEN 'colloquial' THEN 0.0 END, 0.0) AS lo, coalesce(CASE category WHEN 'direct' THEN 0.55 WHEN 'multi_article' THEN 0.60 WHEN 'colloquial' THEN 0.35 END, 0.55) AS hi FROM y)
    SELECT id, article_id, overlap, CASE WHEN overlap > hi THEN 'HIGH' WHEN overlap < lo THEN 'LOW' ELSE 'OK' END AS verdict, array_to_string({sql.first_seen('common')}, ' ') AS leaked FROM z""")
def containment_band(s: SparkSession, d: str) -> DataFrame:
    """Against the terms of all texts that stand under an article id, in whatever source; each text is tokenized once."""
    terms = articles(s, d).where("text is not null").select(F.col("id").alias("article_id"), F.explode(F.array_distinct(_content("text"))).alias("t"))
    terms = terms.groupBy("article_id").agg(F.collect_set("t").alias("dt"))
    asked_ = questions(s, d).where("question is not null").select("id", "category", "expected_articles", _content("question").alias("qt"))
    pairs = asked_.select("id", "category", "qt", F.explode(F.array_distinct("expected_articles")).alias("article_id"))
    bands = s.createDataFrame([(c, lo, hi) for c, (lo, hi) in quality.BANDS.items()], "category string, lo double, hi double")
    # an article without a word still has a text, so its pairs stay
    ids = articles(s, d).where("text is not null").select(F.col("id").alias("article_id")).distinct()
    joined = pairs.join(ids, "article_id").join(terms, "article_id", "left").withColumn("dt", F.coalesce("dt", F.array().cast("array<string>")))
    rows = quality.overlap_bands(joined, bands, F.col("qt"), F.col("dt"))
    return rows.select("id", "article_id", "overlap", "verdict", F.array_join("leaked", " ").alias("leaked"))


_SPLIT = "(^| )([^ ]{4})([^ ]{2})( |$)"


@query(f"""WITH tx AS (SELECT article_ref, text FROM {A} WHERE text IS NOT NULL UNION ALL SELECT article_ref || 'x', regexp_replace(text, '{_SPLIT}', '\\1\\2 \\3\\4', 'g') FROM {A} WHERE text IS NOT NULL), voc AS ({_VOCABULARY.replace(f'FROM {A}', 'FROM tx')}), t AS (SELECT article_ref, {_STRIPPED} AS ts FROM tx),
    p AS (SELECT article_ref, unnest(list_transform(range(1, len(ts)), lambda i: struct_pack(a := ts[i], b := ts[i + 1]))) AS p FROM t),
    c AS (SELECT article_ref AS id, p.a || ' ' || p.b AS broken, p.a || p.b AS joined FROM p WHERE length(p.a) >= 2 AND length(p.b) BETWEEN 1 AND 4)
    SELECT id, broken, joined, n AS joined_seen FROM c JOIN voc ON term = joined""")
def broken_words(s: SparkSession, d: str) -> DataFrame:
    """Over the texts and over copies in which words of six letters are broken in two."""
    rows = articles(s, d).where("text is not null").select("article_ref", "text")
    broken = rows.select(F.concat("article_ref", F.lit("x")).alias("article_ref"), F.regexp_replace("text", _SPLIT, "$1$2 $3$4").alias("text"))
    return quality.broken_words(rows.unionByName(broken), "article_ref")


@query("SELECT source_file, coalesce(bool_or(contains(law_name, 'Act')), false) AS bound FROM articles GROUP BY source_file")
def corpus_binding(s: SparkSession, d: str) -> DataFrame:
    return quality.binding_problem(table(s, d, "articles"), "Act", "source_file")


@query(f"""WITH t AS (SELECT DISTINCT id AS article_id, text FROM {A} WHERE text IS NOT NULL),
    p AS (SELECT DISTINCT id, unnest(expected_articles) AS article_id, expected_keywords FROM {Q} WHERE len(expected_keywords) > 0)
    SELECT p.id, p.article_id, bool_or(len(list_filter(expected_keywords, lambda k: NOT contains(text, k))) = 0) AS evidence FROM p JOIN t USING (article_id) WHERE len(list_filter(expected_keywords, lambda k: k IS NULL)) = 0 GROUP BY ALL""")
def page_evidence(s: SparkSession, d: str) -> DataFrame:
    """Whether one text of the article holds all keywords; equal keyword lists and equal texts of an article meet once."""
    pairs = questions(s, d).where("size(expected_keywords) > 0 and not exists(expected_keywords, k -> k is null)").select("id", F.explode("expected_articles").alias("article_id"), "expected_keywords").distinct()
    texts = articles(s, d).where("text is not null").select(F.col("id").alias("article_id"), "text").distinct()
    found = pairs.select("article_id", "expected_keywords").distinct().join(texts, "article_id")
    found = found.groupBy("article_id", "expected_keywords").agg(F.bool_or(F.forall("expected_keywords", lambda k: F.contains("text", k))).alias("evidence"))
    return pairs.join(found, ["article_id", "expected_keywords"]).select("id", "article_id", "evidence")


# --- segmentation -----------------------------------------------------------------------------------

_TOKENS = f"list_filter(string_split_regex(text, {sql.q(tx.SPACE + '+')}), lambda t: t <> '')"


def _tokens(c: str = "text") -> Column:
    return F.filter(F.split(F.col(c), tx.SPACE + "+"), lambda t: t != "")


@query(f"""WITH t AS (SELECT doc_id AS id, {_TOKENS} AS ts FROM documents WHERE text IS NOT NULL),
    w AS (SELECT id, ts, unnest(range(0, CAST(greatest(0, ceil((len(ts) - 256) / 192.0)) AS BIGINT) + 1)) AS window_no FROM t WHERE len(ts) > 0)
    SELECT id, window_no, window_no * 192 AS start, CAST(len(ts[window_no * 192 + 1 : window_no * 192 + 256]) AS BIGINT) AS n, md5(array_to_string(ts[window_no * 192 + 1 : window_no * 192 + 256], ' ')) AS md5 FROM w""")
def token_windows(s: SparkSession, d: str) -> DataFrame:
    docs = spread(table(s, d, "documents").select("doc_id", "text")).where("text is not null")
    rows = segment.token_windows(docs, "doc_id", _tokens(), 256)
    return rows.select("id", F.col("window_no").cast("bigint").alias("window_no"), F.col("start").cast("bigint").alias("start"), F.size("tokens").cast("bigint").alias("n"), F.md5(F.array_join("tokens", " ")).alias("md5"))


@query(f"""WITH t AS (SELECT len({_TOKENS}) AS n FROM documents WHERE text IS NOT NULL)
    SELECT count(*) AS documents, count(*) FILTER (n > 256) AS over, CAST(coalesce(sum(greatest(n - 256, 0)), 0) AS BIGINT) AS beyond, round(CAST(sum(greatest(n - 256, 0)) AS DOUBLE) / sum(n), 6) AS share FROM t""")
def encoder_coverage(s: SparkSession, d: str) -> DataFrame:
    return segment.window_coverage(spread(table(s, d, "documents").select("text")).where("text is not null"), _tokens(), 256)


_PAGES = "SELECT doc_id AS doc, unnest(range(0, len(ps))) AS page, unnest(ps) AS text FROM (SELECT doc_id, string_split(text, chr(12)) AS ps FROM documents WHERE text IS NOT NULL)"


@query(f"WITH {sql.chunks(_PAGES, segment.CHUNK_MOST, segment.CHUNK_LEAST)} SELECT doc, CAST(number AS BIGINT) AS number, CAST(page AS BIGINT) AS page, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS size FROM chunked")
def page_chunks(s: SparkSession, d: str) -> DataFrame:
    docs = spread(table(s, d, "documents").select("doc_id", "text")).where("text is not null")
    pages = docs.select("doc_id", F.posexplode(F.split("text", "\f")).alias("page", "text"))
    rows = segment.page_chunks(pages, "doc_id", "page", "text", compat=False)
    return rows.select("doc", "number", F.col("page").cast("bigint").alias("page"), F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("size"))


def _headers_sql(lines: str) -> str:
    """CTEs ending in ``parts`` (doc, pos, book, number, page, body) of ``lines``, a select of (doc, line_no, page, line)."""
    return f"""l AS ({lines}),
    n AS (SELECT doc, line_no, page, line, TRY_CAST({sql.digits(f"regexp_extract(line, {sql.q(tx.NUMERIC_HEADER)}, 1)")} AS INTEGER) AS num, regexp_extract(line, {sql.q(tx.ORDINAL_HEADER)}, 1) AS word FROM l),
    h AS (SELECT doc, line_no, page, line, coalesce(num, CASE word {' '.join(f"WHEN {sql.q(k)} THEN {v}" for k, v in tx.ORDINALS.items())} END) AS number, CASE WHEN word <> '' THEN 'issuance' WHEN num IS NOT NULL THEN 'law' END AS book FROM n),
    p AS (SELECT *, sum(CASE WHEN number IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no) AS pos FROM h),
    b AS (SELECT doc, pos, max(number) AS number, max(book) AS book, max(page) FILTER (number IS NOT NULL) AS page, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (number IS NULL), '') AS body FROM p WHERE pos > 0 GROUP BY doc, pos),
    r AS (SELECT *, book = 'law' AND number <= last_value(CASE WHEN book = 'law' THEN number END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS restart FROM b),
    f AS (SELECT *, min(CASE WHEN restart THEN pos END) OVER (PARTITION BY doc) AS first FROM r),
    parts AS (SELECT doc, pos, CASE WHEN pos < first THEN 'issuance' ELSE book END AS book, number, page, {sql.replace_all('body', f'^{tx.SPACE}+|{tx.SPACE}+$')} AS body FROM f)"""


_HEADERS = _headers_sql("SELECT doc_id AS doc, unnest(range(0, len(ls))) AS line_no, NULL AS page, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)")


def _parts(s: SparkSession, d: str) -> DataFrame:
    return segment.articles(spread(table(s, d, "documents").select("doc_id", "text")).where("text is not null"), "doc_id", "text")


@query(f"WITH {_HEADERS} SELECT doc, CAST(pos AS BIGINT) AS pos, book || '-' || number AS id, md5(body) AS body_md5 FROM parts WHERE body <> ''")
def header_articles(s: SparkSession, d: str) -> DataFrame:
    return _parts(s, d).select("doc", F.col("pos").cast("bigint").alias("pos"), "id", F.md5("body").alias("body_md5"))


_PROBLEMS = """good AS (SELECT * FROM parts WHERE body <> ''), c AS (SELECT doc, book, number, count(*) AS n FROM good GROUP BY ALL), sp AS (SELECT doc, book, min(number) AS lo, max(number) AS hi FROM c GROUP BY ALL),
    problems AS (SELECT doc, book, 'duplicate' AS problem, number FROM c WHERE n > 1
        UNION ALL SELECT doc, book, 'gap', number FROM (SELECT doc, book, CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS number FROM sp) g WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc = g.doc AND c.book = g.book AND c.number = g.number)
        UNION ALL SELECT doc, book, 'start', lo FROM sp WHERE lo <> 1
        UNION ALL SELECT DISTINCT doc, book, 'short', number FROM good WHERE length(body) < 20)"""
# the corpus as raw statutes, one for each source file and stretch of references, two articles a page; and all documents as they are
_STATUTES = f"""st AS (SELECT doc, string_agg(CASE WHEN r % 2 = 1 AND r > 1 THEN chr(12) ELSE '' END || 'مادة (' || r || ')' || chr(13) || chr(10) || text, chr(10) ORDER BY r) AS text
        FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY article_ref) AS r FROM (SELECT source_file || '/' || CAST(substr(article_ref, 2) AS BIGINT) // 500 AS doc, article_ref, text FROM {A} WHERE text IS NOT NULL AND source_file IS NOT NULL)) GROUP BY doc
    UNION ALL SELECT 'd' || doc_id, text FROM documents WHERE text IS NOT NULL)"""
_STATUTE_PAGES = r"sp0 AS (SELECT doc, unnest(range(1, len(ps) + 1)) AS page, unnest(ps) AS text FROM (SELECT doc, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(12)) AS ps FROM st))"
_STATUTE_LINES = "SELECT doc, page * 1000000 + unnest(range(1, len(ls) + 1)) AS line_no, page, unnest(ls) AS line FROM (SELECT doc, page, string_split(text, chr(10)) AS ls FROM sp0)"


def _statutes(s: SparkSession, d: str) -> DataFrame:
    """(doc, text): all articles as raw statutes, at most 500 references of a source file each, and all documents."""
    from pyspark.sql import Window

    rows = articles(s, d).where("text is not null and source_file is not null").withColumn("doc", F.concat_ws("/", "source_file", F.expr("cast(cast(substring(article_ref, 2) as bigint) div 500 as string)")))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("doc").orderBy("article_ref")))
    part = F.concat(F.when((F.col("r") % 2 == 1) & (F.col("r") > 1), "\f").otherwise(""), F.lit("مادة ("), F.col("r").cast("string"), F.lit(")\r\n"), F.col("text"))
    made = rows.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", part.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return made.unionByName(spread(table(s, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc"), "text")).where("text is not null"))


@query(f"""WITH {_STATUTES}, {_STATUTE_PAGES}, {_headers_sql(_STATUTE_LINES)}, {_PROBLEMS},
    ok AS (SELECT doc FROM good GROUP BY doc HAVING count(*) >= 3 AND doc NOT IN (SELECT doc FROM problems)),
    {sql.chunks('SELECT doc, page, text FROM sp0 WHERE doc NOT IN (SELECT doc FROM ok)', segment.CHUNK_MOST, segment.CHUNK_LEAST)},
    own AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY pos) AS number, CASE WHEN book = 'law' THEN number END AS article, {sql.q(segment.ARTICLE_LABEL)} || number || CASE WHEN book = 'law' THEN '' ELSE {sql.q(segment.ISSUANCE_LABEL)} END AS label, page, {sql.evaluation('body')} AS b FROM good WHERE doc IN (SELECT doc FROM ok))
    SELECT doc, CAST(number AS BIGINT) AS number, article, label, CAST(page AS BIGINT) AS page, md5({sql.tidy('b')}) AS text_md5 FROM own
    UNION ALL SELECT doc, CAST(number AS BIGINT), NULL, {sql.q(segment.PAGE_LABEL)} || page, CAST(page AS BIGINT), md5(text) FROM chunked""")
def chunk_documents(s: SparkSession, d: str) -> DataFrame:
    return segment.chunk_documents(_statutes(s, d), "doc", "text", compat=False).select("doc", "number", "article", "label", F.col("page").cast("bigint").alias("page"), F.md5("text").alias("text_md5"))


@query(f"""WITH parts AS (SELECT source_file AS doc, split_part(id, '-', 1) AS book, TRY_CAST(split_part(id, '-', 2) AS INTEGER) AS number, text AS body FROM {A} WHERE text IS NOT NULL AND regexp_matches(id, '^(law|issuance)-[0-9]+$')), {_PROBLEMS} SELECT * FROM problems""")
def validate_numbering(s: SparkSession, d: str) -> DataFrame:
    """Over the corpus itself: the articles of each source file."""
    rows = articles(s, d).where("text <> '' and id rlike '^(law|issuance)-[0-9]+$'")
    book, number = F.split_part("id", F.lit("-"), F.lit(1)), F.split_part("id", F.lit("-"), F.lit(2)).try_cast("int")
    return segment.numbering_problems(rows.select(F.col("source_file").alias("doc"), book.alias("book"), number.alias("number"), F.col("text").alias("body")))


_BARE = sql.replace_all("coalesce(text, '')", tx.SPACE)


@query(f"""WITH t AS (SELECT doc_id, {_BARE} AS bare, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
    SELECT doc_id, CASE WHEN length(bare) < 200 THEN 'too little text' ELSE array_to_string(list_filter([
        CASE WHEN CAST(length({sql.replace_all('bare', r'[^\x{0600}-\x{06FF}]')}) AS DOUBLE) / greatest(length(bare), 1) < 0.3 THEN 'not arabic' END,
        CASE WHEN len(list_filter(ls, lambda x: regexp_matches(x, {sql.q(tx.NUMERIC_HEADER)}) OR regexp_matches(x, {sql.q(tx.ORDINAL_HEADER)}))) = 0 THEN 'no headers' END], lambda e: e IS NOT NULL), '; ') END AS problems FROM t""")
def extraction_problems(s: SparkSession, d: str) -> DataFrame:
    return segment.extraction_problems(spread(table(s, d, "documents").select("doc_id", "text"))).select("doc_id", F.array_join("problems", "; ").alias("problems"))


# --- glyph geometry: chunks set as pages, and read again -------------------------------------------------

_ARABIC_WORDS = f"list_filter({_TOKENS}, lambda w: regexp_full_match(w, '[ء-غف-ي]{{2,}}'))"
_SET_LINES = f"""ws AS (SELECT id AS doc, {_ARABIC_WORDS} AS ws FROM (SELECT DISTINCT id, text FROM chunks) WHERE text IS NOT NULL),
    ln AS (SELECT doc, i AS line, array_to_string(ws[i * 8 + 1 : i * 8 + 8], ' ') AS t FROM (SELECT doc, ws, unnest(range(0, CAST(ceil(len(ws) / 8.0) AS BIGINT))) AS i FROM ws))"""


def _glyphs(s: SparkSession, d: str) -> DataFrame:
    """Glyphs of the Arabic words of each chunk, eight to a line and from right to left, with a second column in Latin letters on every
    second page and a vowel mark painted above every fifth letter of every third line."""
    words = F.filter(_tokens(), lambda w: w.rlike("^[ء-غف-ي]{2,}$"))
    rows = table(s, d, "chunks").where("text is not null").select("id", "text").distinct().select(F.col("id").alias("doc"), words.alias("ws")).where(F.size("ws") > 0)
    rows = spread(rows.select("doc", "ws", F.explode(F.sequence(F.lit(0), F.ceil(F.size("ws") / 8).cast("int") - 1)).alias("line")).select("doc", "line", F.array_join(F.slice("ws", F.col("line") * 8 + 1, F.lit(8)), " ").alias("t")))
    y = F.col("line") * 20.0
    glyph = lambda text, x, b: F.struct(text.alias("text"), x.cast("double").alias("x0"), (x + 5).cast("double").alias("x1"), b.alias("bottom"))
    at = F.sequence(F.lit(1), F.length("t"))
    body = F.transform(at, lambda i: glyph(F.substring("t", i, F.lit(1)), 600 - i * 6, y + (i % 2) * 0.3))
    marks = F.transform(F.filter(at, lambda i: (i % 5 == 0) & (F.col("line") % 3 == 2)), lambda i: glyph(F.lit("\u064e"), 600 - i * 6, y - 5.0))
    latin = F.when(F.crc32("doc") % 2 == 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(12), F.floor(F.length("t") / 3).cast("int"))), lambda i: glyph(F.lit("e"), 700 + i * 6, y))).otherwise(F.array().cast("array<struct<text:string,x0:double,x1:double,bottom:double>>"))
    return rows.select("doc", F.lit(1).alias("page"), F.explode(F.concat(body, marks, latin)).alias("g")).select("doc", "page", "g.*", F.lit(12.0).alias("size"))


@query(f"WITH {_SET_LINES} SELECT doc, md5(string_agg(t, chr(10) ORDER BY line)) AS text_md5, count(*) AS lines FROM ln GROUP BY doc")
def glyph_pages(s: SparkSession, d: str) -> DataFrame:
    """Columns, lines, marks and reading order put back: the text that was set must come out."""
    rows = glyphs.page_texts(_glyphs(s, d))
    return rows.select("doc", F.md5("text").alias("text_md5"), F.size(F.split("text", "\n")).cast("bigint").alias("lines"))


@query("""SELECT id AS doc, md5('(' || coalesce(number, 0) || ') [VPN] (كلمة) «' || regexp_replace(text, '[(){}<>«»\\[\\]]', '', 'g') || '»') AS text_md5 FROM (SELECT DISTINCT id, number, text FROM chunks) WHERE text IS NOT NULL""")
def mirrored_brackets(s: SparkSession, d: str) -> DataFrame:
    """Pages of brackets drawn the wrong way round in every second document; quotations over 200 characters or lines are no evidence,
    so they are turned only with a short one in front."""
    rows = table(s, d, "chunks").where("text is not null").select("id", "number", "text").distinct()
    bare = F.regexp_replace("text", r"[(){}<>«»\[\]]", "")
    right = F.concat(F.lit("("), F.coalesce("number", F.lit(0)).cast("string"), F.lit(") [VPN] (كلمة) «"), bare, F.lit("»"))
    text = F.when(F.crc32("id") % 2 == 0, F.translate(right, "()[]", ")(][")).otherwise(right)
    told = F.when((F.crc32("id") % 2 == 0) & (F.length(bare) > 0) & (F.length(bare) <= 200) & ~F.contains(bare, F.lit("\n")), F.translate(text, "«»", "»«")).otherwise(text)
    return glyphs.mirrored_pages(rows.select(F.col("id").alias("doc"), F.lit(1).alias("page"), told.alias("text"))).select("doc", F.md5("text").alias("text_md5"))


# --- identity and library ---------------------------------------------------------------------------


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def duplicate_documents(s: SparkSession, d: str) -> DataFrame:
    return identity.duplicates(table(s, d, "documents").select("doc_id", "text"), "doc_id", "text")


@query("""SELECT doc_id, title, chunks, created_at FROM (SELECT DISTINCT doc_id, title, chunks, created_at, deleted FROM doc_meta) WHERE NOT coalesce(deleted, false)""")
def live_documents(s: SparkSession, d: str) -> DataFrame:
    meta = identity.latest(table(s, d, "doc_meta"), "doc_id", [F.desc("created_at"), F.asc("title")])
    return identity.live(meta).select("doc_id", "title", "chunks", "created_at")


@query(f"""WITH h AS (SELECT sha256(concat_ws('|', coalesce(id, ''), coalesce(category, ''), coalesce(question, ''), coalesce(array_to_string(expected_articles, ','), ''), coalesce(CAST(answerable AS VARCHAR), ''), coalesce(split, ''))) AS h
        FROM (SELECT DISTINCT ON (id) * FROM questions)), p AS (SELECT substr(h, 1, 2) AS p, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(h, '' ORDER BY p)) AS fingerprint FROM p""")
def question_set_fingerprint(s: SparkSession, d: str) -> DataFrame:
    rows = questions(s, d).withColumn("expected", F.array_join("expected_articles", ","))
    return identity.set_fingerprint(rows, ["id", "category", "question", "expected", "answerable", "split"])


# --- citations, answers, calls ----------------------------------------------------------------------


@query(f"""SELECT answer_no, CAST(len({sql.sentences('text')}) AS BIGINT) AS sentences, array_to_string({sql.strict_citations('text')}, ',') AS strict, array_to_string({sql.loose_citations('text')}, ',') AS loose,
    contains(text, {sql.q(ci.ABSTENTION)}) AS abstention FROM {R} WHERE text IS NOT NULL""")
def sentences_citations(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    joined = lambda c: F.array_join(F.transform(c, lambda n: n.cast("string")), ",")
    return answers(s, d).where("text is not null").select("answer_no", F.size(tx.sentences(t)).cast("bigint").alias("sentences"), joined(ci.strict_citations(t)).alias("strict"), joined(ci.loose_citations(t)).alias("loose"), ci.is_abstention(t).alias("abstention"))


def _law_numbers(s: SparkSession, d: str) -> DataFrame:
    """One row: the article numbers of the corpus, a set bounded by the numbers three digits can show."""
    return articles(s, d).select(tx.article_number(F.col("id")).alias("n")).where("n < 1000").agg(F.collect_set("n").alias("corpus"))


def _numbered_texts(s: SparkSession, d: str, number: str) -> DataFrame:
    """All distinct texts of each article number: an id is unique only within its source file."""
    return articles(s, d).where("text is not null").select(tx.article_number(F.col("id")).alias(number), "text").where(F.col(number).isNotNull()).distinct()


_LAW = "TRY_CAST(regexp_extract(id, '^law-(\\d+)$', 1) AS INTEGER)"
_WINDOWS = lambda c: f"list_transform(range(1, greatest(length({c}) - {ci.COPIED_RUN} + 1, 1) + 1, {ci.COPIED_RUN // 2}), lambda i: substr({c}, i, {ci.COPIED_RUN}))"
_AUDIT = f"""r AS (SELECT answer_no, coalesce(text, '') AS text, coalesce(retrieved, []) AS retrieved FROM {R}), corpus AS (SELECT DISTINCT {_LAW} AS n FROM {A}),
    sn AS (SELECT answer_no, unnest(range(0, len(ss))) AS i, unnest(ss) AS s FROM (SELECT answer_no, {sql.sentences('text')} AS ss FROM r)),
    cs AS (SELECT answer_no, i, s, {sql.collapse('s')} AS c FROM sn), w AS (SELECT answer_no, i, unnest({_WINDOWS('c')}) AS win FROM cs WHERE length(c) >= {ci.COPIED_RUN}),
    rt AS (SELECT DISTINCT answer_no, unnest(retrieved) AS n FROM r), tt AS (SELECT DISTINCT {_LAW} AS n, {sql.collapse('text')} AS c FROM {A} WHERE text IS NOT NULL),
    dw AS (SELECT DISTINCT n, win FROM w JOIN rt USING (answer_no)), dh AS (SELECT DISTINCT n, win FROM dw JOIN tt USING (n) WHERE contains(c, win)), hit AS (SELECT DISTINCT answer_no, i FROM w JOIN rt USING (answer_no) JOIN dh USING (n, win)),
    x AS (SELECT cs.*, {sql.citations('s')} AS cit, hit.i IS NOT NULL AS copied FROM cs LEFT JOIN hit ON cs.answer_no = hit.answer_no AND cs.i = hit.i),
    g AS (SELECT answer_no, coalesce(flatten(list(cit ORDER BY i) FILTER (NOT copied)), []) AS own, coalesce(flatten(list(cit ORDER BY i) FILTER (copied)), []) AS other, count(*) FILTER (length(s) >= {ci.LEAST_CLAIM} AND (len(cit) = 0 OR copied)) AS uncited FROM x GROUP BY answer_no),
    v AS (SELECT r.answer_no, contains(r.text, {sql.q(ci.ABSTENTION)}) AS abstained, retrieved, coalesce({sql.first_seen('own')}, []) AS own, coalesce({sql.first_seen('other')}, []) AS other, coalesce(uncited, 0) AS uncited FROM r LEFT JOIN g USING (answer_no)),
    vc AS (SELECT *, CASE WHEN abstained THEN [] ELSE own END AS cited, CASE WHEN abstained THEN [] ELSE list_filter(other, lambda n: NOT list_contains(own, n)) END AS copied, (SELECT list(n) FROM corpus WHERE n < 1000) AS corpus FROM v),
    vf AS (SELECT *, list_filter(cited, lambda n: NOT list_contains(corpus, n)) AS fabricated, list_filter(cited, lambda n: list_contains(corpus, n) AND NOT list_contains(retrieved, n)) AS ungrounded, CASE WHEN abstained THEN 0 ELSE uncited END AS un FROM vc)"""


@query(f"""WITH {_AUDIT} SELECT answer_no, abstained, array_to_string(cited, ',') AS cited, array_to_string(copied, ',') AS copied, array_to_string(fabricated, ',') AS fabricated, array_to_string(ungrounded, ',') AS ungrounded, un AS uncited,
    len(fabricated) = 0 AND len(ungrounded) = 0 AND un = 0 AS grounded FROM vf""")
def audit_answers(s: SparkSession, d: str) -> DataFrame:
    numbers = _law_numbers(s, d)
    rows = answers(s, d).select("answer_no", "text", F.coalesce("retrieved", F.array().cast("array<int>")).alias("retrieved"))
    none = F.array().cast("array<int>")
    rows = rows.join(an.copied_sentences(rows, "answer_no", "retrieved", _numbered_texts(s, d, "n"), "n"), "answer_no", "left").crossJoin(F.broadcast(numbers))
    out = an.audit(rows, F.col("corpus"), F.col("retrieved"), none.cast("array<string>"), copied=F.coalesce("copied", none))
    joined = lambda c: F.array_join(F.transform(c, lambda n: n.cast("string")), ",")
    return out.select("answer_no", F.col("a_abstained").alias("abstained"), joined("a_cited").alias("cited"), joined("a_copied").alias("copied"), joined("a_fabricated").alias("fabricated"), joined("a_ungrounded").alias("ungrounded"), F.size("a_uncited").alias("uncited"), F.col("a_grounded").alias("grounded"))


def _gated(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All sentences of saved answers as claims, their citations as places in the retrieved list."""
    rows = answers(s, d).select(F.col("answer_no").alias("query_id"), "text", F.coalesce("retrieved", F.array().cast("array<int>")).alias("retrieved"))
    claims = rows.where("text is not null").select("query_id", "retrieved", F.posexplode(tx.sentences(F.col("text"))).alias("claim_no", "text"))
    places = F.transform(ci.citations(F.col("text")), lambda n: F.array_position("retrieved", n).cast("int"))
    claims = claims.select("query_id", "claim_no", "text", "retrieved", places.alias("sources"), (F.length(F.trim("text")) < ci.LEAST_CLAIM).alias("short"))
    heads = rows.select("query_id", F.col("text").isNotNull().alias("parsed"), ci.is_abstention(F.col("text")).alias("abstain"), F.when(F.size("retrieved") == 0, "no_sources").alias("own_reason"))
    return heads, an.gate_corpus(claims, "retrieved", _numbered_texts(s, d, "article"), compat=False, keep=("short",))


_PLAIN = sql.replace_all(sql.evaluation("text"), tx.INVISIBLE)
_SHOWN = sql.replace_all("text", tx.INVISIBLE)
_GATE = f"""r AS (SELECT answer_no AS query_id, text, coalesce(retrieved, []) AS retrieved, answerable, seconds, expected FROM {R}),
    c0 AS (SELECT query_id, retrieved, unnest(range(0, len(ss))) AS claim_no, unnest(ss) AS text FROM (SELECT query_id, retrieved, {sql.sentences('text')} AS ss FROM r WHERE text IS NOT NULL)),
    c1 AS (SELECT *, {sql.citations('text')} AS cit, {_PLAIN} AS plain, regexp_matches(text, {sql.q(f"{_DIGIT}{_DROPPED}*[{_STRONG}]{_DROPPED}*{_DIGIT}")}) OR regexp_matches(text, {sql.q(tx.DIRECTION)}) AS hazard FROM c0),
    c2 AS (SELECT *, {sql.citations('plain')} AS pcit, list_transform(cit, lambda n: coalesce(list_position(retrieved, n), 0)) AS sources FROM c1),
    art AS (SELECT DISTINCT {_LAW} AS n, {_SHOWN} AS t FROM {A} WHERE text IS NOT NULL), ac AS (SELECT n, flatten(list({sql.citations('t')})) AS cites FROM art GROUP BY n),
    ca AS (SELECT query_id, claim_no, list(DISTINCT n) AS arts, coalesce(flatten(list(cites)), []) AS cites FROM (SELECT query_id, claim_no, unnest(list_transform(list_filter(sources, lambda s: s >= 1), lambda s: retrieved[s])) AS n FROM c2) LEFT JOIN ac USING (n) GROUP BY ALL),
    c3 AS (SELECT c2.*, list_concat(coalesce(arts, []), coalesce(cites, [])) AS allowed, coalesce(arts, []) AS arts FROM c2 LEFT JOIN ca USING (query_id, claim_no)),
    c4 AS (SELECT *, CASE WHEN len(sources) = 0 THEN 'uncited' WHEN len(list_filter(sources, lambda s: s < 1)) > 0 THEN 'fabricated' WHEN hazard OR len(list_filter(pcit, lambda n: NOT list_contains(allowed, n))) > 0 THEN 'ungrounded' END AS reason FROM c3),
    cw AS (SELECT query_id, claim_no, arts, unnest({_WINDOWS('p')}) AS win FROM (SELECT query_id, claim_no, arts, {sql.collapse('plain')} AS p FROM c4 WHERE reason IS NULL) WHERE length(p) >= {ci.COPIED_RUN}), cwa AS (SELECT query_id, claim_no, win, unnest(arts) AS n FROM cw),
    ch AS (SELECT DISTINCT query_id, claim_no FROM cwa JOIN (SELECT n, {sql.collapse('t')} AS t FROM art) USING (n) WHERE contains(t, win)),
    gated AS (SELECT c4.query_id, c4.claim_no, c4.text, c4.cit, c4.arts, reason, CASE WHEN reason IS NULL THEN ch.query_id IS NOT NULL END AS copied FROM c4 LEFT JOIN ch ON c4.query_id = ch.query_id AND c4.claim_no = ch.claim_no),
    cn AS (SELECT query_id, count(*) AS claims, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason = 'uncited') AS uncited, count(*) FILTER (reason = 'fabricated') AS fabricated, count(*) FILTER (reason = 'ungrounded') AS ungrounded FROM gated GROUP BY query_id),
    hd AS (SELECT query_id, text IS NOT NULL AS parsed, coalesce(contains(text, {sql.q(ci.ABSTENTION)}), false) AS abstain, len(retrieved) = 0 AS none FROM r),
    vd AS (SELECT query_id, parsed, abstain, none, NOT parsed OR abstain AS quiet, coalesce(claims, 0) AS claims, coalesce(kept, 0) AS k, coalesce(uncited, 0) AS u, coalesce(fabricated, 0) AS f, coalesce(ungrounded, 0) AS g FROM hd LEFT JOIN cn USING (query_id)),
    ve AS (SELECT *, CASE WHEN quiet THEN 0 ELSE k END AS kept, CASE WHEN quiet THEN 0 ELSE claims - k END AS dropped, CASE WHEN quiet THEN 0 ELSE u END AS uncited, CASE WHEN quiet THEN 0 ELSE f END AS fabricated, CASE WHEN quiet THEN 0 ELSE g END AS ungrounded, CASE WHEN parsed AND abstain THEN claims ELSE 0 END AS ignored_on_abstain FROM vd),
    verdicts AS (SELECT query_id, CAST(kept AS BIGINT) AS kept, CAST(dropped AS BIGINT) AS dropped, CAST(uncited AS BIGINT) AS uncited, CAST(fabricated AS BIGINT) AS fabricated, CAST(ungrounded AS BIGINT) AS ungrounded, CAST(ignored_on_abstain AS BIGINT) AS ignored_on_abstain,
        CASE WHEN kept = 0 THEN 'abstained' WHEN dropped > 0 THEN 'partial' ELSE 'answered' END AS status,
        CASE WHEN none THEN 'no_sources' WHEN NOT parsed THEN 'schema_failure' WHEN abstain THEN 'model_abstained' WHEN kept = 0 AND dropped > 0 THEN 'all_dropped' WHEN kept = 0 THEN 'no_claims' END AS abstain_reason FROM ve)"""


@query(f"WITH {_GATE} SELECT query_id, CAST(claim_no AS INTEGER) AS claim_no, coalesce(reason, 'kept') AS reason, copied FROM gated")
def gate_claims(s: SparkSession, d: str) -> DataFrame:
    return _gated(s, d)[1].select("query_id", "claim_no", F.coalesce("reason", F.lit("kept")).alias("reason"), "copied")


@query(f"WITH {_GATE} SELECT * FROM verdicts")
def gate_verdicts(s: SparkSession, d: str) -> DataFrame:
    return an.gate_verdicts(*_gated(s, d))


@query(f"WITH {_GATE} SELECT coalesce(abstain_reason, '(none)') AS reason, status, count(*) AS answers FROM verdicts GROUP BY ALL")
def abstain_reasons(s: SparkSession, d: str) -> DataFrame:
    return an.gate_verdicts(*_gated(s, d)).groupBy(F.coalesce("abstain_reason", F.lit("(none)")).alias("reason"), "status").agg(F.count("*").alias("answers"))


_REPORT = f"""{_GATE}, good AS (SELECT query_id, claim_no, text, copied FROM gated WHERE reason IS NULL AND query_id IN (SELECT query_id FROM verdicts WHERE kept > 0)),
    ex AS (SELECT query_id, list_contains(list_transform(flatten(list(arts)), lambda n: list_contains(expected, n)), true) AS cites FROM gated JOIN r USING (query_id) WHERE reason IS NULL AND query_id IN (SELECT query_id FROM verdicts WHERE kept > 0) GROUP BY query_id, expected),
    an AS (SELECT r.query_id, coalesce(r.answerable, false) AS able, seconds, coalesce(cites, false) AS cites FROM r LEFT JOIN ex USING (query_id))"""


def _kept_articles(s: SparkSession, d: str, gated: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(query_id, answerable, seconds, cites_expected): whether a kept claim rests on an article that the question expects."""
    rows = answers(s, d).select(F.col("answer_no").alias("query_id"), "expected", "answerable", "seconds")
    good = gated.where("reason is null").join(verdicts.where("kept > 0").select("query_id"), "query_id", "left_semi")
    arts = good.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("articles"))).alias("arts"))
    return rows.join(arts, "query_id", "left").select("query_id", "answerable", "seconds", F.coalesce(F.arrays_overlap("arts", "expected"), F.lit(False)).alias("cites_expected"))


@query(f"""WITH {_REPORT}, t AS (SELECT count(*) FILTER (able) AS answerable, count(*) FILTER (NOT able) AS unanswerable, count(*) FILTER (able AND kept > 0) AS covered, count(*) FILTER (able AND status = 'abstained') AS false_abstentions, count(*) FILTER (NOT able AND status = 'abstained') AS right_abstentions,
        count(*) FILTER (able AND cites) AS cited_expected, count(*) FILTER (abstain_reason = 'schema_failure') AS schema_failures, count(*) FILTER (status = 'answered') AS answered, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'abstained') AS abstained,
        CAST(sum(ignored_on_abstain) AS BIGINT) AS ignored_on_abstain, CAST(sum(fabricated) AS BIGINT) AS fabricated, CAST(sum(uncited) AS BIGINT) AS uncited, CAST(sum(ungrounded) AS BIGINT) AS ungrounded FROM an JOIN verdicts USING (query_id)),
    u AS (SELECT count(*) AS kept_claims, count(*) FILTER (copied) AS copied_claims, count(*) FILTER (length(trim(text)) < {ci.LEAST_CLAIM}) AS short_claims FROM good)
    SELECT *, round(CASE WHEN unanswerable > 0 THEN CAST(right_abstentions AS DOUBLE) / unanswerable ELSE 0.0 END, 4) AS abstention_rate,
        fabricated = 0 AND CASE WHEN unanswerable > 0 THEN CAST(right_abstentions AS DOUBLE) / unanswerable ELSE 0.0 END >= 0.8 AND cited_expected >= 10 AS adopted FROM t, u""")
def claims_report(s: SparkSession, d: str) -> DataFrame:
    heads, gated = _gated(s, d)
    gated = cut_lineage(gated)
    verdicts = an.gate_verdicts(heads, gated)
    return an.claims_report(_kept_articles(s, d, gated, verdicts), verdicts, gated)


@query(f"""WITH {_REPORT} SELECT count(*) FILTER (able) AS answerable, count(*) FILTER (NOT able) AS out_of_document, count(*) FILTER (able AND kept > 0) AS covered, count(*) FILTER (able AND cites) AS page_grounded, count(*) FILTER (NOT able AND status = 'abstained') AS right_abstentions,
    count(*) FILTER (able AND status = 'abstained') AS false_abstentions, CAST(sum(fabricated) AS BIGINT) AS fabricated, round(avg(seconds), 4) AS mean_seconds FROM an JOIN verdicts USING (query_id)""")
def app_summary(s: SparkSession, d: str) -> DataFrame:
    """The expected articles stand for the expected pages: one page an article."""
    heads, gated = _gated(s, d)
    gated = cut_lineage(gated)
    verdicts = an.gate_verdicts(heads, gated)
    told = _kept_articles(s, d, gated, verdicts)
    return an.app_summary(told.join(verdicts, "query_id").withColumnRenamed("cites_expected", "page_grounded"))


@query(f"SELECT answer_no, len(list_filter(coalesce(retrieved, []), lambda n: list_contains(list_transform(coalesce(expected, []), lambda e: e // 10), n // 10))) > 0 AS page_hit FROM {R}")
def page_hits(s: SparkSession, d: str) -> DataFrame:
    """Ten articles to a page."""
    pages = lambda c: F.transform(F.coalesce(c, F.array().cast("array<int>")), lambda n: F.floor(n / 10))
    return evaluate.page_hits(answers(s, d).select("answer_no", pages("retrieved").alias("p"), pages("expected").alias("e")), "p", "e").select("answer_no", "page_hit")


@query(f"WITH n AS (SELECT DISTINCT {_LAW} AS n FROM {A} WHERE source_file = (SELECT min(source_file) FROM {A})) SELECT DISTINCT answer_no, number FROM (SELECT answer_no, unnest(retrieved) AS number FROM {R}) WHERE number IS NOT NULL AND number NOT IN (SELECT n FROM n WHERE n IS NOT NULL)")
def missing_articles(s: SparkSession, d: str) -> DataFrame:
    """Against the first source file alone, which lacks what only the others have."""
    rows = articles(s, d)
    first = F.broadcast(rows.agg(F.min("source_file").alias("source_file")))
    numbers = rows.join(first, "source_file", "left_semi").select(tx.article_number(F.col("id")).alias("number")).where("number is not null")
    return an.missing_articles(answers(s, d), "answer_no", "retrieved", numbers, "number").where("number is not null")


# replies made of saved answers, with a fault of each kind by the answer's number; what is found wrong is known from how they were made
_FAULTS = ["invalid JSON", "not an object", "abstain is not a boolean", "claims is not a list", "too many claims", "claim is not an object", "claim has no text", "claim text is empty", "claim text is too long", "claim sources are not integers"]


@query(f"""WITH x AS (SELECT answer_no, answer_no % 13 AS k, coalesce(text, '-') AS text, coalesce(retrieved, []) AS retrieved FROM {R})
    SELECT answer_no, CASE k {' '.join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FAULTS))} WHEN 12 THEN NULL ELSE CASE WHEN trim(substr(text, 1, 300)) = '' THEN 'claim text is empty' END END AS violation,
        CASE WHEN k = 12 THEN true WHEN k > 9 AND trim(substr(text, 1, 300)) <> '' THEN false END AS abstain, CASE WHEN k = 12 THEN '' WHEN k > 9 AND trim(substr(text, 1, 300)) <> '' THEN substr(text, 1, 300) || '|' || array_to_string(retrieved, ',') END AS claims FROM x""")
def parsed_claims(s: SparkSession, d: str) -> DataFrame:
    k = F.col("answer_no") % 13
    text, none = F.substring(F.coalesce("text", F.lit("-")), 1, 300), F.array().cast("array<int>")
    claim = F.struct(text.alias("text"), F.coalesce("retrieved", none).alias("sources"))
    reply = lambda claims: F.to_json(F.struct(F.lit(False).alias("abstain"), claims.alias("claims")))
    broken = [
        F.lit("{abstain"), F.lit("[1]"), F.lit('{"abstain": "no", "claims": []}'), F.lit('{"abstain": false, "claims": {}}'), reply(F.array_repeat(claim, 4)), F.lit('{"abstain": false, "claims": ["x"]}'),
        F.lit('{"abstain": false, "claims": [{"text": 7, "sources": [1]}]}'), F.lit('{"abstain": false, "claims": [{"text": " ", "sources": [1]}]}'), F.concat(F.lit('{"abstain": false, "claims": [{"text": "'), F.repeat(F.lit("x"), 301), F.lit('", "sources": [1]}]}')),
        F.lit('{"abstain": false, "claims": [{"text": "x", "sources": [true]}]}'),
    ]
    raw = F.when(k == 12, '{"abstain": true, "claims": []}')
    for i, b in enumerate(broken):
        raw = raw.when(k == i, b)
    rows = an.parsed_claims(answers(s, d).select("answer_no", raw.otherwise(reply(F.array(claim))).alias("raw")))
    shown = F.array_join(F.transform("claims", lambda c: F.concat_ws("|", c["text"], F.array_join(F.transform(c["sources"], lambda n: n.cast("string")), ","))), ";")
    return rows.select("answer_no", "violation", "abstain", shown.alias("claims"))


@query(f"SELECT answer_no, CASE answer_no % 5 WHEN 0 THEN 'invalid JSON' WHEN 1 THEN 'not an object' WHEN 2 THEN 'answers is not a boolean' END AS violation, CASE WHEN answer_no % 5 > 2 THEN answer_no % 5 = 3 END AS relevant FROM {R}")
def parsed_relevance(s: SparkSession, d: str) -> DataFrame:
    k = F.col("answer_no") % 5
    raw = F.when(k == 0, "yes").when(k == 1, "[true]").when(k == 2, '{"answers": 1}').when(k == 3, '{"answers": true}').otherwise('{"answers": false, "why": "x"}')
    return an.parsed_relevance(answers(s, d).select("answer_no", raw.alias("raw"))).select("answer_no", "violation", "relevant")


_ANS = "NOT coalesce(abstained, false)"
_HAS = lambda c: f"count(*) FILTER ({_ANS} AND coalesce(len({c}), 0) > 0) AS {c}"


@query(f"""SELECT CASE WHEN grouping(category) = 1 THEN '(all)' ELSE coalesce(category, '(none)') END AS category, CASE WHEN grouping(model) = 1 THEN '(all)' ELSE coalesce(model, '(none)') END AS batch, count(*) AS answers,
    count(*) FILTER ({_ANS}) AS answered, count(*) FILTER (NOT ({_ANS})) AS abstained, count(*) FILTER ({_ANS} AND coalesce(grounded, false)) AS grounded, {_HAS('fabricated')}, {_HAS('ungrounded')}, {_HAS('uncited')}, {_HAS('copied')},
    round(CAST(count(*) FILTER ({_ANS} AND coalesce(grounded, false)) AS DOUBLE) / nullif(count(*) FILTER ({_ANS}), 0), 4) AS rate FROM {R} GROUP BY GROUPING SETS ((category), (model), ())""")
def grounding_tally(s: SparkSession, d: str) -> DataFrame:
    return an.grounding_tally(answers(s, d))


@query(f"""WITH x AS (SELECT count(*) AS answers, count(*) FILTER ({_ANS}) AS answered, count(*) FILTER ({_ANS} AND coalesce(grounded, false)) AS grounded, {_HAS('fabricated')}, {_HAS('ungrounded')}, {_HAS('uncited')}, {_HAS('copied')},
    count(*) FILTER (NOT coalesce(answerable, false)) AS unanswerable, count(*) FILTER (NOT coalesce(answerable, false) AND NOT ({_ANS})) AS abstained_right, count(*) FILTER (coalesce(answerable, false) AND NOT ({_ANS})) AS abstained_wrong,
    count(*) FILTER (coalesce(answerable, false) AND {_ANS} AND coalesce(cited_expected, false)) AS cited_expected, round(median(seconds), 4) AS median_seconds FROM {R})
    SELECT *, round(CAST(abstained_right AS DOUBLE) / nullif(unanswerable, 0), 4) AS abstention_rate, coalesce(CAST(abstained_right AS DOUBLE) / nullif(unanswerable, 0) >= 0.8, false) AS abstention_met,
    coalesce(CAST(abstained_right AS DOUBLE) / nullif(unanswerable, 0) >= 0.8, false) AND cited_expected >= 10 AND fabricated = 0 AS adopted FROM x""")
def contract_report(s: SparkSession, d: str) -> DataFrame:
    return an.contract_report(answers(s, d))


@query(f"SELECT answer_no, coalesce(len(list_intersect(cited, expected)) > 0, false) AS cites_expected FROM {R}")
def expected_citations(s: SparkSession, d: str) -> DataFrame:
    return answers(s, d).select("answer_no", an.cites_expected(F.col("cited"), F.col("expected")).alias("cites_expected"))


_CALLS = f"(SELECT answer_no, unnest(stats) AS c FROM {R})"


@query(f"""SELECT coalesce(c.stage, '(none)') AS stage, count(*) AS calls, CAST(coalesce(sum(c.output_tokens), 0) AS BIGINT) AS tokens, round(sum(c.output_tokens) / CASE WHEN sum(c.output_s) > 0 THEN sum(c.output_s) END, 3) AS tokens_per_s,
    count(*) FILTER (coalesce(c.truncated, false)) AS truncated, count(*) FILTER (coalesce(c.cut, false)) AS cut FROM {_CALLS} GROUP BY 1""")
def call_stats_by_stage(s: SparkSession, d: str) -> DataFrame:
    return an.call_statistics(answers(s, d))


@query(f"SELECT stage, count(*) AS rows, CAST(sum(greatest(n - 1, 0)) AS BIGINT) AS retries FROM (SELECT answer_no, coalesce(c.stage, '(none)') AS stage, count(*) AS n FROM {_CALLS} GROUP BY ALL) GROUP BY stage")
def retries(s: SparkSession, d: str) -> DataFrame:
    return an.retries(answers(s, d), "answer_no")


@query(f"""WITH p AS (SELECT model, run_id, id, max(answerable) AS answerable, md5(string_agg(coalesce(sha256(text), 'null'), ',' ORDER BY coalesce(sha256(text), 'null'))) AS texts FROM {R} WHERE model IS NOT NULL AND run_id IS NOT NULL AND id IS NOT NULL GROUP BY ALL),
    f AS (SELECT model, min(run_id) AS first FROM p GROUP BY model), ru AS (SELECT DISTINCT p.model, p.run_id FROM p JOIN f ON p.model = f.model WHERE run_id <> first),
    a AS (SELECT ru.model, ru.run_id, p.id, p.answerable, p.texts FROM ru JOIN f USING (model) JOIN p ON p.model = ru.model AND p.run_id = f.first), b AS (SELECT p.* FROM p JOIN ru USING (model, run_id))
    SELECT coalesce(a.model, b.model) AS model, coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'b' WHEN b.id IS NULL THEN 'a' ELSE 'both' END AS side,
        CASE WHEN a.id IS NULL OR b.id IS NULL THEN 'absent' WHEN a.answerable IS NOT DISTINCT FROM b.answerable THEN 'yes' ELSE 'no' END AS answerable_same,
        CASE WHEN a.id IS NULL OR b.id IS NULL THEN 'absent' WHEN a.texts = b.texts THEN 'yes' ELSE 'no' END AS texts_same
    FROM a FULL JOIN b ON a.model = b.model AND a.run_id = b.run_id AND a.id = b.id""")
def run_compare(s: SparkSession, d: str) -> DataFrame:
    """Every run of a model against its first one, by the multiset of answers that a question has in each."""
    rows = answers(s, d).where("model is not null and run_id is not null and id is not null")
    # the sum of hashes stands for the multiset of texts, so none is gathered
    own = rows.groupBy("model", "run_id", "id").agg(F.max("answerable").alias("answerable"), F.struct(F.count("*").alias("n"), F.sum(F.xxhash64(F.coalesce("text", F.lit("\0"))).cast("decimal(38,0)")).alias("sum")).alias("texts"))
    first = own.groupBy("model").agg(F.min("run_id").alias("first"))
    runs = own.select("model", "run_id").distinct().join(first, "model").where("run_id <> first")
    a = runs.join(own.withColumnRenamed("run_id", "first"), ["model", "first"]).drop("first")
    key = F.struct("model", "run_id", "id").alias("key")
    out = an.run_comparison(a.select(key, "answerable", "texts"), own.join(runs, ["model", "run_id"], "left_semi").select(key, "answerable", "texts"), "key", ["answerable", "texts"])
    told = lambda c: F.when(F.col(c).isNull(), "absent").when(F.col(c), "yes").otherwise("no").alias(c)
    return out.select("key.*", "side", told("answerable_same"), told("texts_same"))


@query(f"""WITH p AS (SELECT run_id, id, coalesce(sha256(text), 'null') AS h, seconds FROM {R} WHERE run_id IS NOT NULL AND id IS NOT NULL),
    sg AS (SELECT run_id, md5(string_agg(id || h, ',' ORDER BY id, h)) AS sig, avg(seconds) AS m FROM p GROUP BY run_id), vr AS (SELECT id FROM p GROUP BY id HAVING count(DISTINCT h) > 1)
    SELECT count(*) AS runs, count(DISTINCT sig) AS signatures, (SELECT count(*) FROM vr) AS varying, round(max(m) - min(m), 4) AS span FROM sg""")
def run_variance(s: SparkSession, d: str) -> DataFrame:
    return an.variance(answers(s, d).where("run_id is not null and id is not null"), "run_id", "id", "text", "seconds")


@query(f"""WITH o AS (SELECT DISTINCT id FROM {Q}), n AS (SELECT DISTINCT id FROM {R} WHERE id IS NOT NULL)
    SELECT id, 'added' AS change FROM n WHERE id NOT IN (SELECT id FROM o) UNION ALL SELECT id, 'dropped' FROM o WHERE id NOT IN (SELECT id FROM n)""")
def answered_questions(s: SparkSession, d: str) -> DataFrame:
    return an.set_changes(questions(s, d), answers(s, d).where("id is not null"), "id")


# --- scanned pages ----------------------------------------------------------------------------------


_FURN = ", ".join(sql.q(w) for w in tx.FURNITURE_WORDS)
_FURNITURE = f"""x AS (SELECT *, {sql.replace_all('line', f'^{tx.SPACE}+|{tx.SPACE}+$')} AS s FROM l), y AS (SELECT *, list_filter(string_split_regex(s, {sql.q(tx.SPACE + '+')}), lambda t: t <> '') AS parts FROM x),
    z AS (SELECT *, list_filter(list_transform(list_filter(parts, lambda t: NOT regexp_matches(t, {sql.q(tx.NUMBER_LINE)})), lambda t: regexp_replace(t, '^[()،.:\\-–—]+|[()،.:\\-–—]+$', '', 'g')), lambda w: length(w) > 1) AS ev FROM y),
    told AS (SELECT *, CASE WHEN s = '' THEN false WHEN regexp_matches(s, {sql.q(tx.NUMBER_LINE)}) THEN true ELSE len(parts) <= 14 AND (len(ev) = 0 OR len(list_filter(ev, lambda w: list_contains([{_FURN}], w))) * 2 > len(ev)) END AS furniture FROM z)"""
_ENTITIES = "text"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", chr(0xA0)), ("&amp;", "&")):
    _ENTITIES = f"replace({_ENTITIES}, {sql.q(_a)}, {sql.q(_b)})"
_BOLD = r"^[ \t]*\*\*(.*)\*\*[ \t]*$"
_OCR_LINES = f"""o AS (SELECT DISTINCT ON (page_key) page_key, scan_id, page, {_ENTITIES.replace('text', "regexp_replace(text, '" + tx.TAG + "', '', 'g')", 1)} AS text FROM ocr_pages WHERE text IS NOT NULL),
    l0 AS (SELECT page_key, scan_id, page, unnest(range(0, len(ls))) AS line_no, regexp_replace(unnest(ls), {sql.q(tx.LINE_PREFIX.removeprefix('(?m)'))}, '') AS line FROM (SELECT *, string_split(text, chr(10)) AS ls FROM o)),
    l1 AS (SELECT *, regexp_extract(line, {sql.q(_BOLD)}, 1) AS bold FROM l0), l2 AS (SELECT * EXCLUDE (line, bold), CASE WHEN bold <> '' AND NOT contains(bold, '**') AND NOT regexp_matches(bold, '^\\s|\\s$') THEN bold ELSE line END AS line FROM l1),
    l AS (SELECT * EXCLUDE (line), regexp_replace(line, {sql.q(tx.NUMBER_FIRST.removeprefix('(?m)'))}, '\\2 (\\1)') AS line FROM l2), {_FURNITURE}"""


@query(f"WITH {_OCR_LINES} SELECT page_key, CAST(line_no AS INTEGER) AS line_no, {sql.replace_all('line', tx.SPACE + '+$')} AS line, furniture FROM told")
def ocr_raw_lines(s: SparkSession, d: str) -> DataFrame:
    pages = table(s, d, "ocr_pages").where("text is not null").dropDuplicates(["page_key"])
    return ocr.raw_lines(pages, "page_key", "text")


@query(f"""WITH {_OCR_LINES}, k AS (SELECT scan_id, coalesce(TRY_CAST(regexp_extract(page, '(\\d+)', 1) AS INTEGER), 0) AS page_no, line_no, {sql.replace_all('line', tx.SPACE + '+$')} AS line, furniture FROM told)
    SELECT scan_id, md5(coalesce(string_agg(line, chr(10) ORDER BY page_no, line_no, line) FILTER (NOT furniture), '')) AS text_md5, count(*) FILTER (furniture) AS dropped FROM k GROUP BY scan_id""")
def ocr_raw_text(s: SparkSession, d: str) -> DataFrame:
    pages = table(s, d, "ocr_pages").where("text is not null").dropDuplicates(["page_key"])
    return ocr.raw_text(pages, "scan_id", "page", "text").select(F.col("doc").alias("scan_id"), F.md5("text").alias("text_md5"), "dropped")


@query(f"""WITH l AS (SELECT page_key, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT page_key, string_split(regexp_replace(text, '<[^>]+>', '', 'g'), chr(10)) AS ls FROM (SELECT DISTINCT page_key, text FROM ocr_pages) WHERE text IS NOT NULL)), {_FURNITURE}
    SELECT page_key, CAST(line_no AS BIGINT) AS line_no, furniture FROM told""")
def ocr_furniture(s: SparkSession, d: str) -> DataFrame:
    pages = table(s, d, "ocr_pages").where("text is not null").select("page_key", "text").distinct()
    lines = pages.select("page_key", F.posexplode(F.split(tx.strip_tags(F.col("text")), "\n")).alias("line_no", "line"))
    return lines.select("page_key", F.col("line_no").cast("bigint").alias("line_no"), tx.is_furniture(F.col("line")).alias("furniture"))


_DIGITS = lambda c: f"SELECT article_ref AS key, {sql.digits('t')} AS token, count(*) AS n FROM (SELECT article_ref, unnest(regexp_extract_all({c}, '([٠-٩۰-۹0-9]+)', 1)) AS t FROM {A}) GROUP BY ALL"
_DIGIT_SCORES = f"""e AS ({_DIGITS('text')}), f AS ({_DIGITS('search_text')}), j AS (SELECT coalesce(e.key, f.key) AS key, coalesce(e.n, 0) AS e, coalesce(f.n, 0) AS f FROM e FULL JOIN f ON e.key = f.key AND e.token = f.token),
    sc AS (SELECT key, CAST(sum(e) AS BIGINT) AS expected, CAST(sum(f) AS BIGINT) AS found, CAST(sum(least(e, f)) AS BIGINT) AS correct, CAST(sum(greatest(e - f, 0)) AS BIGINT) AS missing, CAST(sum(greatest(f - e, 0)) AS BIGINT) AS spurious FROM j GROUP BY key)"""


def _digit_scores(s: SparkSession, d: str) -> DataFrame:
    return ocr.digit_scores(ocr.digit_counts(articles(s, d), "article_ref", "text"), ocr.digit_counts(articles(s, d), "article_ref", "search_text"))


@query(f"WITH {_DIGIT_SCORES} SELECT *, round(CASE WHEN expected > 0 THEN CAST(correct AS DOUBLE) / expected ELSE 0.0 END, 6) AS recall FROM sc")
def digit_multiset_scores(s: SparkSession, d: str) -> DataFrame:
    return _digit_scores(s, d)


@query(f"""WITH {_DIGIT_SCORES}, t AS (SELECT CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(spurious) AS BIGINT) AS spurious FROM sc)
    SELECT *, round(CAST(correct AS DOUBLE) / expected, 6) AS recall, CAST(correct AS DOUBLE) / expected >= 0.99 AND spurious = 0 AS passed FROM t""")
def digit_gate(s: SparkSession, d: str) -> DataFrame:
    return ocr.gate_totals(_digit_scores(s, d))


@query(f"""WITH {_DIGIT_SCORES}, c AS (SELECT key, min(token) AS token FROM e GROUP BY key) SELECT key, token FROM c WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.key = c.key AND f.token = c.token)""")
def critical_digits(s: SparkSession, d: str) -> DataFrame:
    """The least number of each text is its critical one."""
    rows = articles(s, d)
    critical = ocr.digit_counts(rows, "article_ref", "text").groupBy("key").agg(F.min("token").alias("token"))
    return ocr.critical_failures(critical, ocr.digit_counts(rows, "article_ref", "search_text"))


# --- statistics -------------------------------------------------------------------------------------


@query(f"""WITH {_scores_sql(5)}, vals AS (SELECT recall AS v, row_number() OVER (ORDER BY query_id) - 1 AS i FROM scores_q), m AS (SELECT count(*) AS n, avg(v) AS mean FROM vals),
    dr AS (SELECT b, n, unnest(range(0, n)) AS dw FROM (SELECT unnest(range(0, 1000)) AS b), m WHERE n > 0),
    ix AS (SELECT b, CAST('0x' || substr(md5('20260923:' || b || ':' || dw), 1, 8) AS BIGINT) % n AS i FROM dr),
    me AS (SELECT b, avg(v) AS mm FROM ix JOIN vals USING (i) GROUP BY b), pl AS (SELECT mm, row_number() OVER (ORDER BY mm, b) - 1 AS r FROM me)
    SELECT n, round(mean, 6) AS mean, round((SELECT max(mm) FROM pl WHERE r = 25), 6) AS low, round((SELECT max(mm) FROM pl WHERE r = 975), 6) AS high FROM m""")
def bootstrap_ci(s: SparkSession, d: str) -> DataFrame:
    return evaluate.bootstrap_interval(_scores(s, d, 5), "recall", "query_id", 1000)


@query("""WITH x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, count(*) AS n, round(median(value), 4) AS median, round(max(CASE WHEN r = least(n, greatest(1, CAST(round_even(n * 95 / 100.0 + 0.5, 0) AS BIGINT))) THEN value END), 4) AS p95, round(min(value), 4) AS min, round(max(value), 4) AS max, round(avg(value), 4) AS mean FROM x GROUP BY event_type""")
def latency_summary(s: SparkSession, d: str) -> DataFrame:
    return evaluate.latency_summary(table(s, d, "events"), "event_type", "value")


@query(f"SELECT coalesce(category, '(none)') AS category, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 3) AS share FROM {Q} GROUP BY ALL")
def category_mix(s: SparkSession, d: str) -> DataFrame:
    return evaluate.mix(questions(s, d).withColumn("category", F.coalesce("category", F.lit("(none)"))), "category")


@query(f"""WITH r AS (SELECT category, CAST(count(*) FILTER ({_ANS} AND coalesce(grounded, false)) AS DOUBLE) / count(*) AS rate FROM {R} WHERE category IS NOT NULL GROUP BY category),
    m AS (SELECT category, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 3) AS share FROM {Q} WHERE category IS NOT NULL GROUP BY category) SELECT round(sum(rate * share), 6) AS rate FROM r JOIN m USING (category)""")
def reweighted_rate(s: SparkSession, d: str) -> DataFrame:
    good = ~F.coalesce(F.col("abstained"), F.lit(False)) & F.coalesce(F.col("grounded"), F.lit(False))
    rates = answers(s, d).where("category is not null").groupBy("category").agg((F.count_if(good) / F.count("*")).alias("rate"))
    return evaluate.reweighted(rates, evaluate.mix(questions(s, d).where("category is not null"), "category"))


@query(f"""WITH a AS (SELECT model AS name, round(avg(seconds), 6) AS score FROM {R} WHERE model IS NOT NULL GROUP BY model), b AS (SELECT model AS name, round(CAST(count(*) FILTER (coalesce(grounded, false)) AS DOUBLE) / count(*), 6) AS score FROM {R} WHERE model IS NOT NULL GROUP BY model),
    x AS (SELECT name AS a, row_number() OVER (ORDER BY score DESC, name) AS rank FROM a), y AS (SELECT name AS b, row_number() OVER (ORDER BY score DESC, name) AS rank FROM b) SELECT rank, a, b, a IS NOT DISTINCT FROM b AS same FROM x FULL JOIN y USING (rank)""")
def order_changes(s: SparkSession, d: str) -> DataFrame:
    rows = answers(s, d).where("model is not null").groupBy(F.col("model").alias("name"))
    a = rows.agg(F.round(F.avg("seconds"), 6).alias("score"))
    b = rows.agg(F.round(F.count_if(F.coalesce(F.col("grounded"), F.lit(False))) / F.count("*"), 6).alias("score"))
    return evaluate.order_changes(a, b)


@query(f"SELECT min_by(answer_no, struct_pack(a := abs(seconds - 20), b := answer_no)) AS answer_no FROM {R} WHERE seconds IS NOT NULL")
def closest_answer(s: SparkSession, d: str) -> DataFrame:
    return evaluate.closest(answers(s, d).where("seconds is not null"), "seconds", 20.0, "answer_no", "answer_no")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    w AS (SELECT user_id, event_id, r, true AS accepted, [t] AS kept FROM e WHERE r = 1
        UNION ALL SELECT e.user_id, e.event_id, e.r, len(list_filter(w.kept, lambda x: x > e.t - 86400)) < 3,
            CASE WHEN len(list_filter(w.kept, lambda x: x > e.t - 86400)) < 3 THEN list_append(list_filter(w.kept, lambda x: x > e.t - 86400), e.t) ELSE list_filter(w.kept, lambda x: x > e.t - 86400) END
        FROM w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1)
    SELECT user_id AS key, event_id, accepted FROM w""")
def rate_limiter(s: SparkSession, d: str) -> DataFrame:
    return limits.limited(table(s, d, "events"), "user_id", "ts", "event_id", 3, 86400.0).select("key", "event_id", "accepted")


# --- problem 2 --------------------------------------------------------------------------------------


@query()
def p2_found(s: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(s, d, "run_lines")).select("file_name", "change_kind", "old_path", "new_path").distinct()


@query()
def p2_changes(s: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(s, d, "run_lines"), moves=True)


@query()
def p2_table(s: SparkSession, d: str) -> DataFrame:
    return drift.consistent_table(table(s, d, "run_lines"))
