"""Independent DuckDB SQL for the training-data queries that SQL can express."""

OP1 = """
WITH p AS (SELECT row_number() OVER () AS rid, page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, strlen(html)::BIGINT AS n, max(page_id) OVER (PARTITION BY html) AS latest FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> latest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> latest THEN latest END AS refers_to
FROM d"""

OP8 = r"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
),
b AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark WHERE text IS NOT NULL
),
windows AS (
    SELECT DISTINCT item_id, width, array_to_string(words[i : i + width - 1], ' ') AS phrase
    FROM (SELECT *, least(len(words), 10) AS width, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS i
          FROM b WHERE len(words) > 0)
),
places AS (
    SELECT rid, i, width, array_to_string(words[i : i + width - 1], ' ') AS phrase
    FROM (SELECT d.rid, d.words, w.width, unnest(range(1, len(d.words) - w.width + 2)) AS i
          FROM d, (SELECT DISTINCT width FROM windows) w WHERE len(d.words) >= w.width)
),
found AS (SELECT rid, i, width, item_id FROM places JOIN windows USING (width, phrase)),
hit AS (
    SELECT rid, count(DISTINCT word) AS n_hit
    FROM (SELECT rid, unnest(range(i, i + width)) AS word FROM (SELECT DISTINCT rid, i, width FROM found)) GROUP BY rid
),
items AS (
    SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)"""

OP11 = r"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents WHERE text IS NOT NULL
),
held AS (SELECT * FROM d WHERE len(terms) > 0),
size AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM held),
tf AS (
    SELECT rid, doc_id, term, count(*) AS tf, any_value(n) AS n
    FROM (SELECT rid, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM held) GROUP BY rid, doc_id, term
),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
i AS (
    SELECT row_number() OVER () AS iid, item_id,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)
),
q AS (SELECT iid, item_id, term, count(*) AS times FROM i GROUP BY iid, item_id, term),
scored AS (
    SELECT q.iid, q.item_id, tf.rid, tf.doc_id,
           sum(q.times * floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df.df + 1)))::BIGINT
               * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * tf.n * n_docs) // n_terms))))::BIGINT AS score
    FROM q JOIN df USING (term) JOIN tf USING (term) CROSS JOIN size
    GROUP BY q.iid, q.item_id, tf.rid, tf.doc_id
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id ASC NULLS LAST, rid) AS rank
    FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def _op13() -> str:
    """Two rounds of means and three assignments, each a step of the WITH clause."""
    steps = [
        """kept AS (
    SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        """cut AS (
    SELECT rid, p, list_slice(w, p * (len(w) // 16) + 1, (p + 1) * (len(w) // 16)) AS part
    FROM kept, (SELECT unnest(range(16)) AS p)
)""",
        "first AS (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, w) - 1 AS e FROM kept)",
        "book0 AS (SELECT p, e, part AS entry FROM cut JOIN first USING (rid) WHERE e < 64)",
    ]
    for k in range(3):
        steps.append(
            f"""near{k} AS (
    SELECT rid, p, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (
        SELECT rid, p, e, list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM cut JOIN book{k} USING (p)
    ) GROUP BY rid, p
)"""
        )
        if k < 2:
            steps.append(
                f"""mean{k} AS (
    SELECT p, e, list(total // n ORDER BY i) AS entry FROM (
        SELECT p, e, i, sum(part[i])::BIGINT AS total, count(*) AS n
        FROM cut JOIN near{k} USING (rid, p), (SELECT unnest(range(1, 4097)) AS i) WHERE i <= len(part) GROUP BY p, e, i
    ) GROUP BY p, e
)"""
            )
            # division truncates towards zero, so floors are taken on doubles
            steps[-1] = steps[-1].replace("total // n", "floor(total / n)::BIGINT")
            steps.append(
                f"book{k + 1} AS (SELECT p, e, coalesce(mean{k}.entry, book{k}.entry) AS entry FROM book{k} LEFT JOIN mean{k} USING (p, e))"
            )
    steps += [
        "digest AS (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)",
        """coded AS (
    SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY rid
)""",
        "labelled AS (SELECT kept.rid, vec_id, label, code, error FROM kept JOIN coded USING (rid))",
    ]
    return (
        "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM labelled, digest"""
    )


ORACLES: dict[str, str] = {"op1_warc_captures": OP1, "op8_fm_index": OP8, "op11_hybrid_search": OP11, "op13_vector_codes": _op13()}
