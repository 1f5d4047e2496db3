"""What DuckDB is to find for the registered queries that SQL can express."""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_OP12 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
sized AS (SELECT r, doc_id, terms, len(terms) AS n FROM docs WHERE len(terms) > 0),
totals AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM sized),
held AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM sized) GROUP BY r, term),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
spread AS (SELECT term, count(*) AS df FROM held WHERE term IN (SELECT term FROM asked) GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM spread, totals),
lengths AS (SELECT r, doc_id, 10 + (90 * n * big_n) // big_l AS m FROM sized, totals),
scores AS (
    SELECT item_id, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN held USING (term) JOIN lengths USING (r) GROUP BY item_id, r
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0
) WHERE rank <= 10
"""

# pieces of a text, with the ends of sentences made line breaks first
_PARTS = r"list_filter(list_transform(regexp_split_to_array(regexp_replace({0}, '([.!?])[ \t]+', '\1' || chr(10), 'g'), '\r?\n'), lambda p: trim(p, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), lambda p: p <> '')"

_OP13 = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
chained AS (
    SELECT doc_id, text, length(text) AS n_chars,
        coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS after,
        coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), first_value(doc_id) OVER (ORDER BY doc_id DESC)) AS after_id
    FROM texts
),
edited AS (SELECT *, substring(text, 1, n_chars - n_chars // 2) || substring(after, 1, n_chars // 2) AS changed FROM chained),
versions AS (
    SELECT doc_id, false AS is_edited, {_PARTS.format("text")} AS parts FROM edited
    UNION ALL SELECT doc_id, true, {_PARTS.format("changed")} FROM edited
),
hashed AS (SELECT doc_id, is_edited, sha256(unnest(parts)) AS h FROM versions),
words AS (SELECT doc_id, is_edited, i, ('0x' || substr(h, 1 + 8 * i, 8))::BIGINT AS word FROM hashed, (SELECT unnest(range(8)) AS i)),
word_sums AS (SELECT doc_id, is_edited, i, count(*) AS n, sum(word)::BIGINT & 4294967295 AS s FROM words GROUP BY ALL),
word_lists AS (SELECT doc_id, is_edited, any_value(n) & 4294967295 AS n, list(s ORDER BY i) AS words FROM word_sums GROUP BY ALL),
sign_sums AS (
    SELECT doc_id, is_edited, i, b, ((sum(2 * ((word >> (31 - b)) & 1) - 1)::BIGINT + 32768) & 65535) - 32768 AS s
    FROM words, (SELECT unnest(range(32)) AS b) GROUP BY ALL
),
sign_lists AS (SELECT doc_id, is_edited, list(s ORDER BY i, b) AS signs FROM sign_sums GROUP BY ALL),
vectors AS (
    SELECT doc_id, is_edited, coalesce(n, 0) AS n, coalesce(words, list_transform(range(8), lambda x: 0::BIGINT)) AS words,
        coalesce(signs, list_transform(range(256), lambda x: 0::BIGINT)) AS signs
    FROM versions LEFT JOIN word_lists USING (doc_id, is_edited) LEFT JOIN sign_lists USING (doc_id, is_edited)
),
named AS (
    SELECT doc_id, is_edited, signs, list_sum(list_transform(signs, lambda x: x * x))::BIGINT AS size,
        printf('%08X', n) || array_to_string(list_transform(words, lambda x: printf('%08X', x)), '')
            || array_to_string(list_transform(signs, lambda x: printf('%04X', x & 65535)), '') AS fingerprint
    FROM vectors
),
pairs AS (
    SELECT e.doc_id, e.n_chars, sha256(e.changed) AS edited_sha256, a.fingerprint, b.fingerprint AS edited_fingerprint, c.fingerprint AS next_fingerprint,
        list_sum(list_transform(list_zip(a.signs, b.signs), lambda x: x[1] * x[2]))::BIGINT AS with_edited, a.size + b.size AS size_edited,
        list_sum(list_transform(list_zip(a.signs, c.signs), lambda x: x[1] * x[2]))::BIGINT AS with_next, a.size + c.size AS size_next
    FROM edited e JOIN named a ON a.doc_id = e.doc_id AND NOT a.is_edited JOIN named b ON b.doc_id = e.doc_id AND b.is_edited
        JOIN named c ON c.doc_id = e.after_id AND NOT c.is_edited
)
SELECT doc_id, n_chars::BIGINT AS n_chars, edited_sha256, fingerprint, edited_fingerprint,
    CASE WHEN fingerprint = edited_fingerprint THEN 1::DOUBLE ELSE least(greatest(coalesce(2::DOUBLE * with_edited / nullif(size_edited, 0), 0), 0), 1) END::DOUBLE AS near_edited,
    CASE WHEN fingerprint = next_fingerprint THEN 1::DOUBLE ELSE least(greatest(coalesce(2::DOUBLE * with_next / nullif(size_next, 0), 0), 0), 1) END::DOUBLE AS near_next
FROM pairs
"""

SQL: dict[str, str] = {"op12_lexical_search": _OP12, "op13_fingerprints": _OP13}
