"""DuckDB SQL with the same rows as the registered queries, where SQL can express them."""

OP3 = r"""
WITH d AS (
  SELECT rowid AS r, doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM (SELECT *, row_number() OVER () AS rowid FROM documents)
), g AS (
  SELECT text_sha256, count(*) AS group_size,
         first(doc_id ORDER BY n DESC, doc_id NULLS LAST, r) AS keep_id,
         first(r ORDER BY n DESC, doc_id NULLS LAST, r) AS keep_r
  FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, r = keep_r AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), i AS (
  SELECT row_number() OVER () AS i, item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM benchmark
), q AS (
  SELECT i, item_id, term, count(*) AS repeats FROM (SELECT i, item_id, unnest(ts) AS term FROM i) GROUP BY ALL
), s AS (
  SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0
), t AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s
), m AS (
  SELECT r, doc_id, 100 - 25 + ((25 * len(ts)::BIGINT * n_docs) // n_terms) AS m FROM d, s WHERE len(ts) > 0
), scores AS (
  SELECT i, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id,
         sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY i, r
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
  FROM scores WHERE score > 0
) WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3, "op11_lexical_search": OP11}
