"""SQL pieces (DuckDB dialect) shared by the checks: the derived tables and the heavier steps.

Each constant or function gives common table expressions for a WITH clause.
"""

from __future__ import annotations

from passagework import fixed
from workload.views import CHUNKS_PER_ARTICLE, DIM

ARTICLES = """
articles AS (
  SELECT d.doc_id AS id, split_part(d.text, chr(10), 1) AS title, d.text AS content,
         'https://example.org/wiki/' || d.source || '/' || d.doc_id AS url,
         e.embedding AS title_vector
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""

CHUNKS = f"""
chunks AS (
  SELECT e.vec_id AS chunk_id, d.doc_id AS article_id,
         e.embedding AS content_chunk_vector, d.text AS content_chunk
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id // {CHUNKS_PER_ARTICLE})"""

_SLOTS = ",\n".join(
    f"max(CASE WHEN slot = {i} THEN link END) AS {fixed.LINK_COLUMN_PREFIX}{i}"
    for i in range(1, fixed.LINK_COLUMN_COUNT + 1)
)
LINKS = f"""
all_links AS (
  SELECT page_id // {fixed.LINK_COLUMN_COUNT} AS q_id, page_id % {fixed.LINK_COLUMN_COUNT} + 1 AS slot,
         regexp_replace(url, '^http://', '') AS link FROM pages
  UNION ALL
  SELECT page_id // {fixed.LINK_COLUMN_COUNT} + 1000000000, page_id % {fixed.LINK_COLUMN_COUNT} + 1, url FROM pages),
questions_wide AS (SELECT q_id, {_SLOTS} FROM all_links GROUP BY q_id),
links AS (SELECT q_id, slot::INT AS slot, link FROM all_links WHERE link IS NOT NULL)"""

TOOL_CALLS = """
conv_questions AS (
  SELECT conv_id, arg_min(text, turn) AS query FROM conversations GROUP BY conv_id),
tool_calls AS (
  SELECT conv_id, turn AS seq,
         CASE WHEN role = 'user'
              THEN '{"query":' || to_json(text)::VARCHAR
                   || CASE WHEN turn % 3 = 0 THEN ',"top_k":7' ELSE '' END || '}'
              ELSE '{"top_k":4}' END AS input_json
  FROM conversations)"""


def rounds(default_k: int) -> str:
    """Answered calls with their parsed input; follows TOOL_CALLS."""
    return f"""
rounds AS (
  SELECT * FROM (
    SELECT c.conv_id, c.seq, c.input_json, q.query AS question,
           (row_number() OVER (PARTITION BY c.conv_id ORDER BY c.seq))::INT AS round,
           coalesce(json_extract_string(c.input_json, '$.query'), q.query) AS query,
           json_extract_string(c.input_json, '$.query') IS NOT NULL AS valid,
           coalesce(json_extract(c.input_json, '$.top_k')::INT, {default_k}) AS top_k
    FROM tool_calls c LEFT JOIN conv_questions q USING (conv_id))
  WHERE round <= {fixed.MAX_TOOL_ROUNDS})"""


def word_lists(text: str) -> str:
    return (
        f"flatten(list_transform(string_split({text}, chr(10)), "
        f"lambda line: list_concat(string_split(line, ' '), [chr(10)])))"
    )


def tokens(word: str) -> str:
    return (
        f"CASE WHEN {word} = '' THEN 0 WHEN {word} = chr(10) THEN 1 "
        f"ELSE ceil(length({word}) / 4)::INT END"
    )


def text_tokens(text: str) -> str:
    return f"list_sum(list_transform({word_lists(text)}, lambda w: {tokens('w')}))::BIGINT"


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def chunked(source: str, budget: int) -> str:
    """`cut(id, chunk_no, content_chunk, n_tokens)` of `source(id, text)`.

    Steps from chunk to chunk over running totals. Needs WITH RECURSIVE.
    """
    body = STRIP.format("array_to_string(ws[s:e], ' ')")
    return f"""
word_list AS MATERIALIZED (SELECT id, {word_lists('text')} AS ws FROM {source}),
words AS (SELECT id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM word_list),
sums AS MATERIALIZED (
  SELECT id, i, {tokens('w')} AS tok,
         sum({tokens('w')}) OVER (PARTITION BY id ORDER BY i) AS ps FROM words),
starts AS (
  SELECT id, 1::BIGINT AS s, 0::HUGEINT AS base FROM word_list
  UNION ALL
  SELECT n.id, n.i, n.ps - n.tok FROM starts c, LATERAL (
    SELECT id, i, ps, tok FROM sums u
    WHERE u.id = c.id AND u.i > c.s AND u.ps - c.base > {budget} ORDER BY i LIMIT 1) n),
spans AS (
  SELECT st.id, st.s, st.base,
         coalesce(lead(st.s) OVER (PARTITION BY st.id ORDER BY st.s) - 1, len(wl.ws)) AS e, wl.ws
  FROM starts st JOIN word_list wl USING (id)),
bodies AS (
  SELECT p.id, p.s, {body} AS content_chunk, (u.ps - p.base)::BIGINT AS n_tokens
  FROM spans p JOIN sums u ON u.id = p.id AND u.i = p.e),
cut AS (
  SELECT id, (row_number() OVER (PARTITION BY id ORDER BY s) - 1)::INT AS chunk_no,
         content_chunk, n_tokens
  FROM bodies WHERE content_chunk <> '')"""


def hashed(source: str, out: str = "hashed", dim: int = DIM) -> str:
    """`hashed(id, v)`: the offline vectors of `source(id, text)`."""
    return f"""
{out}_words AS (
  SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS word FROM {source}),
{out}_buckets AS (
  SELECT id, ('0x' || substr(md5(word), 1, 4))::INT % {dim} AS b,
         sum(CASE WHEN ('0x' || substr(md5(word), 5, 1))::INT < 8 THEN 1 ELSE -1 END)::DOUBLE AS c
  FROM {out}_words GROUP BY ALL),
{out}_norms AS (SELECT id, sqrt(sum(c * c)) AS norm FROM {out}_buckets GROUP BY id),
{out} AS (
  SELECT s.id, list(coalesce(CASE WHEN n.norm > 0 THEN k.c / n.norm ELSE k.c END, 0)::FLOAT
                    ORDER BY d.range) AS v
  FROM {source} s CROSS JOIN range({dim}) d
  LEFT JOIN {out}_buckets k ON k.id = s.id AND k.b = d.range
  LEFT JOIN {out}_norms n ON n.id = s.id
  GROUP BY s.id)"""


def ranked(
    corpus: str, id_col: str, vector_col: str, k: str, queries: str = "hashed", ids: str = "id"
) -> str:
    """`hits(qid, id, similarity, rank)` for `queries(id, v)`; `k` may use `q.`."""
    score = f"round(list_inner_product(c.{vector_col}::DOUBLE[], q.v::DOUBLE[]), 12) + 0.0"
    return f"""
scored AS (
  SELECT q.{ids} AS qid, c.{id_col} AS id, {score} AS similarity, {k} AS k
  FROM {corpus} c, {queries} q WHERE c.{vector_col} IS NOT NULL),
hits AS (
  SELECT qid, id, similarity, rank FROM (
    SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id))::INT AS rank FROM scored)
  WHERE rank <= k)"""


def contexts(corpus: str, id_col: str, text_col: str) -> str:
    """`contexts(qid, context)` of `hits`."""
    return f"""
contexts AS (
  SELECT h.qid, string_agg('Related content ' || h.rank || ' (similarity: '
           || printf('%.2f', h.similarity) || '):' || chr(10) || c.{text_col},
           chr(10) || chr(10) ORDER BY h.rank) AS context
  FROM hits h JOIN {corpus} c ON c.{id_col} = h.id GROUP BY h.qid)"""


def prompt(context: str, query: str) -> str:
    return (
        f"'{fixed.PROMPT_OPENING}' || chr(10) || chr(10) || coalesce({context}, '') || chr(10) "
        f"|| chr(10) || '{fixed.PROMPT_REQUEST}' || chr(10) || {query}"
    )


TRANSCRIPT = f"""
transcript AS (
  SELECT conv_id, 0 AS seq, 'user' AS role, query AS content FROM conv_questions
  UNION ALL SELECT conv_id, round * 3 - 2, 'assistant', input_json FROM rounds
  UNION ALL SELECT r.conv_id, r.round * 3 - 1, 'user', coalesce(c.context, '')
    FROM rounds r LEFT JOIN contexts c ON c.qid = r.conv_id * {fixed.MAX_TOOL_ROUNDS} + r.round - 1
  UNION ALL SELECT conv_id, round * 3, 'user', '{fixed.ROUND_LIMIT_MESSAGE}'
    FROM rounds WHERE round >= {fixed.MAX_TOOL_ROUNDS})"""

# Text of the <article> of a page: what stands between <p> tags, the heading left out.
_INNER = r"regexp_replace(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '(?s)<h1>.*?</h1>', '', 'g')"
_PLAIN = (
    "replace(replace(regexp_replace(piece, '<[^>]*>', '', 'g'), '&quot;', '\"'), '&amp;', '&')"
)
PAGE_TEXT = f"""
page_text AS (
  SELECT page_id, url,
         nullif(array_to_string(list_filter(list_transform(string_split({_INNER}, '<p>'),
           lambda piece: {STRIP.format(_PLAIN)}), lambda x: x <> ''), chr(10) || chr(10)), '') AS content
  FROM pages)"""


def title_of(url: str) -> str:
    """Title from a URL that has no path parameters (the test pages have none)."""
    path = rf"regexp_replace(regexp_replace({url}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '')"
    return f"replace(url_decode(list_last(string_split({path}, '/'))), '_', ' ')"
