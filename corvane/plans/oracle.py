"""Pieces of SQL that the queries' oracles share, in DuckDB's dialect."""

from __future__ import annotations

from corvane.functions import lexicon as X


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def array(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def casefold(c: str) -> str:
    return f"replace(lower({c}), 'ß', 'ss')"


def tokens(c: str) -> str:
    return rf"list_filter(regexp_extract_all({casefold(f'coalesce({c}, {q('')})')}, '[\p{{L}}\p{{N}}]+'), lambda t: length(t) > 1 AND t NOT IN {listed(X.STOPWORDS)})"


def expand(c: str) -> str:
    groups = " ".join(f"|| CASE WHEN list_has_any({c}, {array(g)}) THEN {array(g)} ELSE [] END" for g in X.SYNONYM_GROUPS)
    return f"list_sort(list_distinct({c} {groups}))"


def confidence(s: str) -> str:
    return f"CASE WHEN coalesce({s}, 0) <= 0 THEN 0 ELSE round(least({s} / ({s} + 2.0), 1.0), 4) END"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def excerpt(c: str) -> str:
    return rf"CASE WHEN length({strip(c)}) > 1200 THEN regexp_replace(substr({strip(c)}, 1, 1197), ' [^ ]*$', '') || '...' ELSE {strip(c)} END"


def bm25(docs: str, questions: str, k: int, body: str = "text", meta: str | None = None) -> str:
    """CTEs up to `best` (q, key, score, rank). docs and questions: FROM items with doc_id, text / q, question."""
    whole = f"concat_ws(' ', nullif({meta}, ''), nullif({body}, ''))" if meta else body
    return f"""
tk AS (SELECT doc_id AS key, {tokens(whole)} AS toks, {tokens(meta) if meta else 'CAST([] AS VARCHAR[])'} AS mtoks FROM {docs}),
st AS (SELECT count(*)::DOUBLE AS n, greatest(avg(len(toks)), 1.0) AS avgdl FROM tk),
qt AS (SELECT q, unnest({expand('ts')}) AS term FROM (SELECT q, {tokens('question')} AS ts FROM {questions})),
tf AS (SELECT key, len(toks) AS dl, term, count(*) AS tf FROM (SELECT key, toks, unnest(toks) AS term FROM tk) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
mtf AS (SELECT key, term, count(*) AS mtf FROM (SELECT key, unnest(mtoks) AS term FROM tk) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (SELECT q, key, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) + 1.25 * coalesce(mtf, 0)) AS score
  FROM tf JOIN df USING (term) JOIN qt USING (term) LEFT JOIN mtf USING (key, term) CROSS JOIN st GROUP BY q, key),
best AS (SELECT * FROM (SELECT q, key, score, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, key) AS rank FROM scored) WHERE rank <= {k})"""


def nearest(rows: str, queries: str, k: int, same: str | None = None) -> str:
    """CTE `near` (q, key, similarity, rank). rows: vec_id, embedding; queries: q, u (and the column `same`)."""
    on = f"JOIN {queries} USING ({same})" if same else f"CROSS JOIN {queries}"
    return f"""
near AS (SELECT * FROM (SELECT q, vec_id AS key, greatest(0, least(1, list_cosine_similarity(embedding::DOUBLE[], u::DOUBLE[]))) AS similarity,
  row_number() OVER (PARTITION BY q ORDER BY round(greatest(0, least(1, list_cosine_similarity(embedding::DOUBLE[], u::DOUBLE[]))), 9) DESC, vec_id) AS rank
  FROM {rows} {on}) WHERE rank <= {k})"""
