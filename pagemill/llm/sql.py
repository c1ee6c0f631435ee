"""DuckDB SQL of the queries that SQL can express; the others are tested against brute force in tests/llm.

The SQL of the URL filter holds for pages that name no alias, as the given tables do; aliases are tested by brute force.
"""

from __future__ import annotations

from pagemill.llm.url_rules import RULES


def exact_top_k(every: int = 50, k: int = 5) -> str:
    return f"""
    WITH v AS (
      SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings
      WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
    ), s AS (
      SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % {every} = 0
    )
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s
    ) WHERE rank <= {k}"""


def hard_negatives(every: int = 50, positives: int = 5, negatives: int = 3) -> str:
    return f"""
    WITH v AS (
      SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
    ), s AS (
      SELECT a.r AS anchor, a.vec_id AS anchor_id, c.vec_id AS vec_id, c.label = a.label AS same,
             CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v c ON a.r <> c.r WHERE a.vec_id % {every} = 0
    ), p AS (
      SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place FROM s WHERE same
      ) WHERE place <= {positives}
    ), n AS (
      SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same
      WHERE 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
    )
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
    FROM n WHERE rank <= {negatives}"""


def url_filter() -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1]))
    fits = [
        f"WHEN (host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{path}') THEN"
        for _, host, path in ordered
    ]
    rules = " ".join(f"{test} '{host}{path}'" for test, (_, host, path) in zip(fits, ordered, strict=True))
    verdicts = " ".join(f"{test} '{verdict}'" for test, (verdict, _, _) in zip(fits, ordered, strict=True))
    return f"""
    WITH r AS (
      SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), u AS (
      SELECT page_id,
             translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
      FROM r
    )
    SELECT page_id, host, path, CASE {rules} END AS rule, CASE {verdicts} ELSE 'allow' END AS verdict FROM u"""


def chat_format() -> str:
    """Holds for conversations of plain messages, as the given ones are."""
    return """
    SELECT conv_id, turn, role, turn AS order_turn, CAST(0 AS INTEGER) AS order_level, CAST(0 AS INTEGER) AS order_part,
           'text' AS state, '' AS problems, CAST(json_object('content', text, 'role', role) AS VARCHAR) AS json
    FROM conversations"""


ORACLE_SQL = {
    "op5_exact_top_k": exact_top_k(),
    "op11_hard_negatives": hard_negatives(),
    "op7_url_filter": url_filter(),
    "op9_chat_format": chat_format(),
}
