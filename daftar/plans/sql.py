"""SQL twins of the column functions, for the oracle queries (DuckDB)."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from daftar.functions import citations as ci
from daftar.functions import text as tx


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def replace_all(c: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(by)}, 'g')"


def digits(c: str) -> str:
    return f"translate({c}, {q(tx.DIGITS_FROM)}, {q(tx.DIGITS_TO)})"


def collapse(c: str) -> str:
    return f"trim({replace_all(c, tx.SPACE + '+', ' ')})"


def evaluation(c: str) -> str:
    return collapse(digits(f"replace({replace_all(c, tx.MARKS)}, {q(tx.TATWEEL)}, '')"))


def orthographic(c: str) -> str:
    return f"translate({evaluation(c)}, {q(tx.FOLD_FROM)}, {q(tx.FOLD_TO)})"


def clitic(t: str) -> str:
    cases = " ".join(f"WHEN starts_with({t}, {q(p)}) AND length({t}) - {len(p)} >= 3 THEN substr({t}, {len(p) + 1})" for p in tx.CLITICS)
    return f"CASE {cases} ELSE {t} END"


def search_tokens(c: str) -> str:
    bare = collapse(replace_all(orthographic(c), tx.NOT_WORD, " "))
    return f"list_transform(list_filter(string_split({bare}, ' '), lambda t: t <> ''), lambda t: {clitic('t')})"


def content_tokens(c: str) -> str:
    stop = ", ".join(q(w) for w in tx.STOPWORDS)
    return f"list_filter({search_tokens(c)}, lambda t: length(t) > 2 AND NOT list_contains([{stop}], t))"


def typist(c: str, form: str) -> str:
    pairs = list(tx.TYPIST_FORMS.values()) if form == "all" else [tx.TYPIST_FORMS[form]] if form in tx.TYPIST_FORMS else []
    for a, b in pairs:
        c = f"translate({c}, {q(a)}, {q(b)})"
    return c


def sentences(c: str) -> str:
    edge = f"^{tx.SPACE}+|{tx.SPACE}+$"
    return f"list_filter(list_transform(string_split_regex({c}, {q(tx.SENTENCE_END)}), lambda s: {replace_all('s', edge)}), lambda s: s <> '')"


def numbers(groups: str) -> str:
    return f"list_transform(flatten(list_transform({groups}, lambda g: regexp_extract_all(g, '([0-9٠-٩۰-۹]{{1,3}})', 1))), lambda n: CAST({digits('n')} AS INTEGER))"


def strict_citations(c: str) -> str:
    return numbers(f"regexp_extract_all({c}, {q(ci.STRICT)}, 1)")


def loose_citations(c: str) -> str:
    return numbers(f"regexp_extract_all({c}, {q(ci.LOOSE)}, 1)")


#: First occurrence of each element, in order.
def first_seen(xs: str) -> str:
    return f"list_transform(list_filter(list_zip({xs}, range(1, len({xs}) + 1)), lambda z: list_position({xs}, z[1]) = z[2]), lambda z: z[1])"


def bm25(queries: str, docs: str, k: int) -> str:
    """CTEs ending in ``hits`` (query_id, id, rank, score); ``queries`` (query_id, ts) and ``docs`` (id, ts) are selects."""
    return f"""
        qs AS ({queries}), ds AS ({docs}),
        stats AS (SELECT count(*) AS n, avg(len(ts)) AS avg_len FROM ds),
        asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(ts) AS term FROM qs) GROUP BY ALL),
        posted AS (SELECT doc, dl, term, count(*) AS tf FROM (SELECT id AS doc, len(ts) AS dl, unnest(ts) AS term FROM ds) GROUP BY ALL),
        terms AS (SELECT term, count(*) AS df FROM posted GROUP BY term),
        idf AS (SELECT term, df, greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1), 1e-6::DOUBLE) AS idf FROM terms, stats),
        scores AS (SELECT query_id, doc AS id, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_len))), 4) AS score
            FROM asked JOIN idf USING (term) JOIN posted USING (term), stats GROUP BY ALL),
        hits AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, score FROM scores) WHERE rank <= {k})"""


def tidy(c: str) -> str:
    """Twin of ``text.tidy``; ``c`` must be a column."""
    toks, gaps = f"string_split_regex({c}, {q(tx.SPACE + '+')})", f"regexp_extract_all({c}, {q(tx.SPACE + '+')})"
    glued = f"regexp_matches({toks}[i + 1], {q('^' + tx.CLOSING_MARKS + '+$')}) OR regexp_matches({toks}[i], {q('^' + tx.OPENING_MARKS + '+$')}) OR (regexp_matches({toks}[i], '[A-Za-z]-$') AND regexp_matches({toks}[i + 1], '^[A-Za-z]'))"
    return f"{toks}[1] || array_to_string(list_transform(range(1, len({gaps}) + 1), lambda i: CASE WHEN {glued} THEN '' ELSE {gaps}[i] END || {toks}[i + 1]), '')"


def bare(c: str) -> str:
    """Marks, tatweel and digit script folded, blanks as they are."""
    return digits(f"replace({replace_all(c, tx.MARKS)}, {q(tx.TATWEEL)}, '')")


def citations(c: str) -> str:
    both = f"list_concat({strict_citations(c)}, {loose_citations(c)})"
    return first_seen(both)


@lru_cache(maxsize=1)
def _compatible() -> str:
    """(c, by) rows: each character of the basic plane that compatibility composition changes, by rule."""
    pairs = [(chr(cp), unicodedata.normalize("NFKD", chr(cp))) for cp in range(0x80, 0x10000) if not 0xD800 <= cp < 0xE000]
    return ", ".join(f"({q(c)}, {q(d)})" for c, d in pairs if d not in (c, unicodedata.normalize("NFD", c)))


def nfkc(rows: str, key: str, c: str) -> str:
    """CTE ``compat`` (key, text): compatibility composition by a table of single characters, then the engine's own composition."""
    return f"""signs (c, repl) AS (VALUES {_compatible()}), letters AS (SELECT {key} AS key, unnest(range(1, length({c}) + 1)) AS i, unnest(string_split({c}, '')) AS c FROM {rows} WHERE length({c}) > 0),
        compat AS (SELECT key, nfc_normalize(string_agg(coalesce(repl, l.c), '' ORDER BY i)) AS text FROM letters l LEFT JOIN signs s ON l.c = s.c GROUP BY key
            UNION ALL SELECT {key}, {c} FROM {rows} WHERE coalesce(length({c}), 0) = 0)"""


def chunks(pages: str, most: int, least: int) -> str:
    """CTEs ending in ``chunked`` (doc, number, page, text) of ``pages`` (doc, page, text): lines in normal form, packed by folding lists."""
    ends = r"[.!؟؛][)\]»\"'']*$"
    normal = f"list_filter(list_transform(string_split_regex({bare('text')}, {q(tx.LINE_BREAK)}), lambda x: {collapse('x')}), lambda x: x <> '')"
    words = f"flatten(list_transform(string_split(line, ' '), lambda w: list_transform(range(0, CAST(ceil(length(w) / {most}.0) AS BIGINT)), lambda k: substr(w, CAST(k * {most} + 1 AS BIGINT), {most}))))"
    size = lambda xs: f"(coalesce(list_sum(list_transform({xs}, lambda u: length(u))), 0) + len({xs}) - 1)"
    cut = f"coalesce(list_max(list_filter(range(1, len(a.now) + 1), lambda c: regexp_matches(a.now[c], '{ends}') AND {size('a.now[1:c]')} >= {least})), len(a.now))"
    return f"""pg AS ({pages}), ln AS (SELECT doc, page, unnest(range(1, len(ls) + 1)) AS line_at, unnest(ls) AS line FROM (SELECT doc, page, {normal} AS ls FROM pg)),
        un AS (SELECT doc, page, line_at, CASE WHEN length(line) <= {most} THEN [line] ELSE (
            SELECT list_append(f.done, f.now) FROM (SELECT list_reduce(list_transform({words}, lambda w: {{'done': CAST([] AS VARCHAR[]), 'now': w}}),
                lambda a, x: CASE WHEN length(a.now) + 1 + length(x.now) <= {most} THEN {{'done': a.done, 'now': a.now || ' ' || x.now}} ELSE {{'done': list_append(a.done, a.now), 'now': x.now}} END) AS f)) END AS us FROM ln),
        pu AS (SELECT doc, page, flatten(list(us ORDER BY line_at)) AS us FROM un GROUP BY doc, page),
        packs AS (SELECT doc, page, list_reduce(list_transform(us, lambda u: {{'done': CAST([] AS VARCHAR[][]), 'now': [u]}}), lambda a, x: CASE
            WHEN {size('a.now')} + 1 + length(x.now[1]) <= {most} THEN {{'done': a.done, 'now': list_append(a.now, x.now[1])}}
            WHEN {cut} = len(a.now) THEN {{'done': list_append(a.done, a.now), 'now': x.now}}
            WHEN {size(f'a.now[{cut} + 1:]')} + 1 + length(x.now[1]) <= {most} THEN {{'done': list_append(a.done, a.now[1:{cut}]), 'now': list_append(a.now[{cut} + 1:], x.now[1])}}
            ELSE {{'done': list_append(list_append(a.done, a.now[1:{cut}]), a.now[{cut} + 1:]), 'now': x.now}} END) AS f FROM pu),
        rn AS (SELECT doc, page, list_transform(list_append(f.done, f.now), lambda r: array_to_string(r, ' ')) AS rs FROM packs),
        tl AS (SELECT doc, page, CASE WHEN len(rs) > 1 AND length(rs[len(rs)]) < {least} THEN list_append(rs[1:len(rs) - 2], rs[len(rs) - 1] || ' ' || rs[len(rs)]) ELSE rs END AS rs FROM rn),
        ck AS (SELECT doc, page, unnest(range(1, len(rs) + 1)) AS i, unnest(rs) AS c FROM tl), td AS (SELECT doc, page, i, {tidy('c')} AS text FROM ck),
        chunked AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY page, i) AS number, page, text FROM td WHERE text <> '')"""
