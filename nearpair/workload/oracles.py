"""What each query returns, as DuckDB SQL over the same tables.

Written from the definitions (all pairs, exact measures, plain ranks), not from the plans.
"""

from __future__ import annotations

SPLIT = "list_filter(string_split({0}, ' '), lambda t: t <> '')"
PADDED = "('##' || {0} || '$$')"
GRAMS = "list_transform(range(1, length({0}) + 3), lambda i: substr(" + PADDED + ", i::INT, 3))"

PARTS = "SELECT p_partkey AS id, p_name || ' ' || p_brand AS text FROM part"
DOCUMENTS = "SELECT doc_id AS id, text FROM documents"
BENCHMARK = "SELECT item_id AS id, text FROM benchmark"
CUSTOMERS = "SELECT c_custkey AS id, c_name AS text FROM customer"
URLS = "SELECT page_id AS id, url AS text FROM pages"


def texts(records: str) -> str:
    return (
        "SELECT min(id) AS id, text, count(*) AS records FROM "
        f"({records}) WHERE text IS NOT NULL GROUP BY text"
    )


def sets(records: str, tokens: str = SPLIT) -> str:
    return (
        "SELECT min(id) AS id, toks, len(toks) AS n, count(*) AS records FROM "
        f"(SELECT id, list_sort(list_distinct({tokens.format('text')})) AS toks FROM ({records})) "
        "WHERE len(toks) > 0 GROUP BY toks"
    )


def self_ed(records: str, tau: int) -> str:
    return f"""
WITH t AS MATERIALIZED ({texts(records)})
SELECT a.id AS id_l, b.id AS id_r, levenshtein(a.text, b.text) AS score,
       a.records * b.records AS pairs
FROM t a JOIN t b ON a.id < b.id AND abs(length(a.text) - length(b.text)) <= {tau}
WHERE levenshtein(a.text, b.text) <= {tau}
UNION ALL
SELECT id, id, 0, records * (records - 1) // 2 FROM t WHERE records > 1"""


def rs_ed(left: str, right: str, tau: int) -> str:
    return f"""
WITH l AS MATERIALIZED ({texts(left)}), r AS MATERIALIZED ({texts(right)})
SELECT l.id AS id_l, r.id AS id_r, levenshtein(l.text, r.text) AS score,
       l.records * r.records AS pairs
FROM l JOIN r ON abs(length(l.text) - length(r.text)) <= {tau}
WHERE levenshtein(l.text, r.text) <= {tau}"""


SIMILARITY = {
    "jaccard": "o / (na + nb - o)::DOUBLE",
    "cosine": "o / sqrt(na::DOUBLE * nb)",
    "dice": "2.0::DOUBLE * o / (na + nb)",
}


def scored(left: str, right: str, ordered: bool, measure: str, ratio: str = "0.24") -> str:
    """CTEs ending in `scored` (i, j, ra, rb, s): all pairs with a common token."""
    order = "AND a.id < b.id" if ordered else ""
    return f"""
l AS MATERIALIZED ({left}), r AS MATERIALIZED ({right}),
lt AS (SELECT id, n, records, unnest(toks) AS token FROM l),
rt AS (SELECT id, n, records, unnest(toks) AS token FROM r),
common AS (SELECT a.id AS i, b.id AS j, a.n AS na, b.n AS nb, a.records AS ra, b.records AS rb,
                  count(*) AS o
           FROM lt a JOIN rt b ON a.token = b.token {order}
             AND least(a.n, b.n) >= {ratio} * greatest(a.n, b.n)
           GROUP BY ALL),
scored AS (SELECT i, j, ra, rb, {SIMILARITY[measure]} AS s FROM common)"""


def self_sets(records: str, measure: str, passes: str, tokens: str = SPLIT) -> str:
    groups = sets(records, tokens)
    return f"""
WITH {scored(groups, groups, True, measure)}
SELECT i AS id_l, j AS id_r, round(s, 6) AS score, ra * rb AS pairs FROM scored WHERE {passes}
UNION ALL
SELECT id, id, 1.0, records * (records - 1) // 2 FROM l WHERE records > 1"""


def rs_sets(left: str, right: str, measure: str, passes: str, ratio: str = "0.24") -> str:
    return f"""
WITH {scored(sets(left), sets(right), False, measure, ratio)}
SELECT i AS id_l, j AS id_r, round(s, 6) AS score, ra * rb AS pairs FROM scored WHERE {passes}"""


PART_PAIRS = self_ed(PARTS, 1)
JACCARD_8 = self_sets(DOCUMENTS, "jaccard", "s >= 0.8")
MINHASH = self_sets(DOCUMENTS, "jaccard", "s > 0.8 + 1e-9")  # 1 - s < 0.2 without the rounding of 1 - s

TURNS = f"""
SELECT a.conv_id, a.turn, list_distinct({SPLIT.format('a.text')}) AS x,
       list_distinct({SPLIT.format('b.text')}) AS y
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""


def turn_score(measure: str) -> str:
    return f"""
WITH p AS (SELECT conv_id, turn, len(x) AS na, len(y) AS nb, len(list_intersect(x, y)) AS o
           FROM ({TURNS}))
SELECT conv_id, turn,
       CASE WHEN na > 0 AND nb > 0 THEN round({SIMILARITY[measure]}, 6) END AS score FROM p"""


# tokens of the distinct sets, ranked rarest first
RANKED_SETS = f"""
g AS MATERIALIZED ({sets(DOCUMENTS)}),
tok AS (SELECT id, n, unnest(toks) AS token FROM g),
freq AS (SELECT token, count(*) AS freq FROM tok GROUP BY token),
ranked AS (SELECT id, n, token, row_number() OVER (PARTITION BY id ORDER BY freq, token) AS rank
           FROM tok JOIN freq USING (token)),
prefix AS MATERIALIZED (
    SELECT * FROM ranked WHERE rank <= n - ceil(0.8 * n - 1e-9) + 1)"""


def overlapping(left: str, right: str, order: str, t: str) -> str:
    """Pairs that share a prefix token and pass the size, prefix and position bounds."""
    return f"""
SELECT DISTINCT least(a.id, b.id) AS x, a.id AS id_l, b.id AS id_r
FROM {left} a JOIN {right} b ON a.token = b.token {order}
WHERE least(a.n, b.n) >= ceil({t}::DOUBLE * greatest(a.n, b.n) - 1e-9)
  AND CASE WHEN a.n >= b.n THEN b.rank <= b.n - ceil(2 * {t} / (1 + {t}) * b.n - 1e-9) + 1
           ELSE a.rank <= a.n - ceil(2 * {t} / (1 + {t}) * a.n - 1e-9) + 1 END
  AND 1 + least(a.n - a.rank, b.n - b.rank) >= ceil({t} / (1 + {t}) * (a.n + b.n) - 1e-9)"""


# For equal sizes in a self join the later id takes the shorter prefix.
CANDIDATES_SELF = f"""
WITH {RANKED_SETS}
SELECT DISTINCT least(a.id, b.id) AS id_l, greatest(a.id, b.id) AS id_r
FROM prefix a JOIN prefix b
  ON a.token = b.token AND (a.n > b.n OR (a.n = b.n AND a.id < b.id))
WHERE b.n >= ceil(0.8 * a.n - 1e-9)
  AND b.rank <= b.n - ceil(1.6 / 1.8 * b.n - 1e-9) + 1
  AND 1 + least(a.n - a.rank, b.n - b.rank) >= ceil(0.8 / 1.8 * (a.n + b.n) - 1e-9)"""

CANDIDATES_RS = f"""
WITH l AS MATERIALIZED ({sets(DOCUMENTS)}), r AS MATERIALIZED ({sets(BENCHMARK)}),
lt AS (SELECT id, n, unnest(toks) AS token FROM l),
rt AS (SELECT id, n, unnest(toks) AS token FROM r),
lr AS (SELECT id, n, token, row_number() OVER (PARTITION BY id ORDER BY token) AS rank FROM lt),
rr AS (SELECT id, n, token, row_number() OVER (PARTITION BY id ORDER BY token) AS rank FROM rt),
lp AS (SELECT * FROM lr WHERE rank <= n - ceil(0.3 * n - 1e-9) + 1),
rp AS (SELECT * FROM rr WHERE rank <= n - ceil(0.3 * n - 1e-9) + 1)
SELECT DISTINCT id_l, id_r FROM ({overlapping('lp', 'rp', '', '0.3')})"""

# q-grams of the distinct part texts, ranked rarest first; the first q * tau + 1 = 7 of them
RANKED_GRAMS = f"""
t AS MATERIALIZED ({texts(PARTS)}),
grams AS (SELECT id, length(text) + 2 AS n, unnest({GRAMS.format('text')}) AS gram,
                 unnest(range(0, length(text) + 2)) AS pos FROM t),
freq AS (SELECT gram, count(*) AS freq FROM grams GROUP BY gram),
ranked AS (SELECT id, n, gram, pos,
                  row_number() OVER (PARTITION BY id ORDER BY freq, gram, pos) AS rank
           FROM grams JOIN freq USING (gram)),
prefix AS MATERIALIZED (SELECT * FROM ranked WHERE rank <= 7)"""

GRAM_CANDIDATES = f"""
{RANKED_GRAMS},
cand AS MATERIALIZED (
    SELECT DISTINCT a.id AS id_l, b.id AS id_r FROM prefix a JOIN prefix b
    ON a.gram = b.gram AND a.id < b.id AND abs(a.n - b.n) <= 2)"""

# greedy from the left over positions + 1; state = edits * 100000 + last position reached
ERRORS = (
    "list_reduce(list_sort(list_transform({0}, lambda p: p + 1)), "
    "lambda s, x: CASE WHEN x > s % 100000 THEN (s // 100000 + 1) * 100000 + x + 2 ELSE s END, "
    "0::BIGINT) // 100000"
)

FIRST_POSITIONS = f"""
WITH {RANKED_GRAMS},
p AS (SELECT id, list(pos::BIGINT ORDER BY rank) AS ps FROM prefix GROUP BY id)"""

ALL_POSITIONS = f"""
WITH {RANKED_GRAMS},
p AS (SELECT id, list(pos::BIGINT ORDER BY rank) AS ps FROM ranked GROUP BY id)"""

MISMATCHES = f"""
WITH {GRAM_CANDIDATES},
side AS (SELECT c.id_l, c.id_r, a.gram, a.pos FROM cand c JOIN grams a ON a.id = c.id_l),
missing AS (
    SELECT s.id_l, s.id_r, s.pos FROM side s
    WHERE NOT EXISTS (SELECT 1 FROM grams b WHERE b.id = s.id_r AND b.gram = s.gram
                      AND abs(b.pos - s.pos) <= 2)),
m AS MATERIALIZED (
    SELECT c.id_l, c.id_r, count(x.pos) AS mismatches,
           coalesce(list(x.pos::BIGINT) FILTER (x.pos IS NOT NULL), []) AS ps
    FROM cand c LEFT JOIN missing x ON c.id_l = x.id_l AND c.id_r = x.id_r
    GROUP BY c.id_l, c.id_r HAVING count(x.pos) <= 6)"""

CELLS = f"""
WITH t AS MATERIALIZED ({texts(PARTS)}),
anchors AS (SELECT row_number() OVER (ORDER BY id) - 1 AS anchor_id, text FROM
            (SELECT id, text FROM t ORDER BY id LIMIT 8)),
d AS MATERIALIZED (SELECT t.id, anchor_id, levenshtein(t.text, a.text)::DOUBLE AS dist
                   FROM t CROSS JOIN anchors a),
home AS MATERIALIZED (SELECT id, anchor_id, dist FROM
         (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, anchor_id) AS k FROM d)
         WHERE k = 1),
outer_cells AS MATERIALIZED (
    SELECT d.id, d.anchor_id, d.dist FROM d JOIN home h ON d.id = h.id
    WHERE d.anchor_id <> h.anchor_id AND d.dist <= h.dist + 2
      AND (h.anchor_id < d.anchor_id) <> ((h.anchor_id + d.anchor_id) % 2 = 1))"""

SPACE_TOKENS = f"SELECT id, unnest({SPLIT.format('text')}) AS token FROM ({DOCUMENTS})"
RECORD_TEXT = "concat_ws(',', p_name, p_brand, p_type, p_size::VARCHAR)"

ORACLES = {
    "records_from_columns": f"SELECT p_partkey AS id, {RECORD_TEXT} AS text FROM part",
    "records_row_ids": "SELECT row_number() OVER () - 1 AS id, p_partkey, p_name FROM part",
    "records_csv": f"SELECT p_partkey AS id, {RECORD_TEXT} AS text FROM part",
    "write_pairs": PART_PAIRS,
    "record_groups_text": f"SELECT id, min(id) OVER (PARTITION BY text) AS group_id FROM ({PARTS})",
    "record_groups_tokens": f"""
        SELECT id, min(id) OVER (PARTITION BY toks) AS group_id FROM
        (SELECT id, list_sort(list_distinct({SPLIT.format('text')})) AS toks FROM ({DOCUMENTS}))
        WHERE len(toks) > 0""",
    "tokens_space": SPACE_TOKENS,
    "tokens_qgram": f"SELECT id, unnest({GRAMS.format('text')}) AS token FROM ({PARTS})",
    "tokens_qgram_pos": f"""
        SELECT id, unnest({GRAMS.format('text')}) AS token,
               unnest(range(0, length(text) + 2))::INT AS pos FROM ({PARTS})""",
    "tokens_char": f"""
        SELECT DISTINCT id, token FROM
        (SELECT id, unnest(string_split(text, '')) AS token FROM ({DOCUMENTS})) WHERE token <> ''""",
    "token_frequency": f"SELECT token, count(*) AS freq FROM ({SPACE_TOKENS}) GROUP BY token",
    "token_frequency_joint": f"""
        SELECT token, count(*) AS freq FROM
        (SELECT token FROM ({SPACE_TOKENS}) UNION ALL
         SELECT unnest({SPLIT.format('text')}) FROM conversations) GROUP BY token""",
    "token_order_idf": f"""
        WITH tok AS MATERIALIZED ({SPACE_TOKENS}),
        freq AS (SELECT token, count(*) AS freq FROM tok GROUP BY token)
        SELECT id, row_number() OVER (PARTITION BY id ORDER BY freq, token) AS rank, token
        FROM tok JOIN freq USING (token)""",
    "token_order_alpha": f"""
        SELECT id, row_number() OVER (PARTITION BY id ORDER BY token) AS rank, token
        FROM ({SPACE_TOKENS})""",
    "gram_order_idf": f"""
        WITH tok AS MATERIALIZED (
            SELECT id, unnest({GRAMS.format('text')}) AS token,
                   unnest(range(0, length(text) + 2))::INT AS pos FROM ({PARTS})),
        freq AS (SELECT token, count(*) AS freq FROM tok GROUP BY token)
        SELECT id, row_number() OVER (PARTITION BY id ORDER BY freq, token, pos) AS rank, token, pos
        FROM tok JOIN freq USING (token)""",
    "prefix_length": f"""
        WITH s AS (SELECT id, len(list_distinct({SPLIT.format('text')})) AS tokens,
                          length(text) + 2 AS grams FROM ({DOCUMENTS}))
        SELECT id, tokens, grams,
               CASE WHEN tokens = 0 THEN 0 ELSE tokens - ceil(0.8 * tokens - 1e-9)::BIGINT + 1 END AS jaccard,
               CASE WHEN tokens = 0 THEN 0 ELSE tokens - ceil(0.64 * tokens - 1e-9)::BIGINT + 1 END AS cosine,
               CASE WHEN tokens = 0 THEN 0 ELSE tokens - ceil(0.8 / 1.2 * tokens - 1e-9)::BIGINT + 1 END AS dice,
               least(grams, 4) AS ed
        FROM s""",
    "prefix_tokens": f"WITH {RANKED_SETS} SELECT id, token, rank FROM prefix",
    "min_edit_errors": f"{ALL_POSITIONS} SELECT id, {ERRORS.format('ps')} AS errors FROM p",
    "min_prefix_length": f"""
        {FIRST_POSITIONS},
        k AS (SELECT id, ps, unnest(range(1, len(ps) + 1)) AS k FROM p)
        SELECT id, coalesce(min(k) FILTER ({ERRORS.format('ps[1:k]')} > 2), max(k)) AS length
        FROM k GROUP BY id""",
    "inverted_index": f"WITH {RANKED_SETS} SELECT token, id FROM prefix",
    "bucket_sizes": f"""
        WITH {RANKED_SETS}
        SELECT size, count(*) AS entries FROM
        (SELECT token, count(*) AS size FROM prefix GROUP BY token) WHERE size > 1 GROUP BY size""",
    "candidates_self": CANDIDATES_SELF,
    "candidates_rs": CANDIDATES_RS,
    "filter_length": f"WITH {GRAM_CANDIDATES} SELECT id_l, id_r FROM cand",
    "filter_position": f"""
        WITH {RANKED_GRAMS}
        SELECT DISTINCT a.id AS id_l, b.id AS id_r FROM prefix a JOIN prefix b
        ON a.gram = b.gram AND a.id < b.id AND a.rank <= 4 AND b.rank <= 4
           AND abs(a.n - b.n) <= 1 AND abs(a.pos - b.pos) <= 1""",
    "filter_count": f"""
        WITH {GRAM_CANDIDATES},
        bag AS (SELECT id, n, gram, count(*) AS copies FROM grams GROUP BY ALL)
        SELECT id_l, id_r FROM cand c
        JOIN bag a ON a.id = c.id_l JOIN bag b ON b.id = c.id_r AND b.gram = a.gram
        GROUP BY id_l, id_r, a.n, b.n
        HAVING sum(least(a.copies, b.copies)) >= greatest(a.n, b.n) - 6""",
    "filter_mismatch_count": f"{MISMATCHES} SELECT id_l, id_r, mismatches FROM m",
    "filter_mismatch_location": f"""
        {MISMATCHES} SELECT id_l, id_r FROM m WHERE {ERRORS.format('ps')} <= 2""",
    "filter_content": f"""
        WITH {GRAM_CANDIDATES},
        chars AS (SELECT id, c, count(*) AS copies FROM
                  (SELECT id, unnest(string_split(text, '')) AS c FROM t) GROUP BY ALL),
        size AS (SELECT id, sum(copies) AS n FROM chars GROUP BY id),
        same AS (SELECT id_l, id_r, sum(least(a.copies, b.copies)) AS common FROM cand
                 JOIN chars a ON a.id = id_l JOIN chars b ON b.id = id_r AND a.c = b.c
                 GROUP BY id_l, id_r)
        SELECT id_l, id_r FROM same JOIN size a ON a.id = id_l JOIN size b ON b.id = id_r
        WHERE a.n + b.n - 2 * common <= 4""",
    "filter_content_windows": f"""
        {MISMATCHES},
        run AS (
            SELECT id_l, id_r, ps, unnest(list_sort(list_filter(ps, lambda p: NOT list_contains(ps, p - 1)))) AS low,
                   unnest(list_sort(list_filter(ps, lambda p: NOT list_contains(ps, p + 1)))) AS high FROM m),
        win AS (
            SELECT id_l, id_r, list_filter(ps, lambda p: p > high + 2) AS behind,
                   string_split(substr(a.text, greatest(low - 2, 0) + 1, high + 1 - greatest(low - 2, 0)), '') AS x,
                   string_split(substr(b.text, greatest(low - 2, 0) + 1, high + 1 - greatest(low - 2, 0)), '') AS y
            FROM run JOIN t a ON a.id = id_l JOIN t b ON b.id = id_r),
        far AS (
            SELECT DISTINCT id_l, id_r FROM win WHERE 4 <
                list_sum(list_transform(list_distinct(list_filter(x || y, lambda c: c <> '')), lambda c:
                    abs(len(list_filter(x, lambda d: d = c))::BIGINT - len(list_filter(y, lambda d: d = c))::BIGINT)))
                + 2 * CASE WHEN len(behind) = 0 THEN 0 ELSE {ERRORS.format('behind')} END)
        SELECT id_l, id_r FROM m ANTI JOIN far USING (id_l, id_r)""",
    "gram_counts": f"""
        WITH {RANKED_GRAMS},
        bag AS (SELECT id, n, gram, count(*) AS copies FROM grams GROUP BY ALL)
        SELECT a.id AS id_l, b.id AS id_r, sum(least(a.copies, b.copies))::BIGINT AS common
        FROM bag a JOIN bag b ON a.gram = b.gram AND a.id < b.id AND abs(a.n - b.n) <= 1 AND greatest(a.n, b.n) > 3
        GROUP BY a.id, b.id, a.n, b.n
        HAVING sum(least(a.copies, b.copies)) >= greatest(a.n, b.n) - 3""",
    "score_edit_distance": """
        SELECT a.page_id AS id, levenshtein(a.url, b.url) AS score
        FROM pages a JOIN pages b ON b.page_id = a.page_id + 1""",
    "score_jaccard": turn_score("jaccard"),
    "score_cosine": turn_score("cosine"),
    "score_dice": turn_score("dice"),
    "cross_self_ed": self_ed(URLS, 2),
    "cross_self_jaccard": self_sets(URLS, "jaccard", "s >= 0.7", GRAMS),
    "cross_self_jaccard_documents": JACCARD_8,
    "cross_rs_ed": rs_ed(PARTS, PARTS, 1),
    "prefix_self_ed": PART_PAIRS,
    "prefix_self_jaccard": JACCARD_8,
    "prefix_self_cosine": self_sets(DOCUMENTS, "cosine", "s >= 0.8"),
    "prefix_self_dice": self_sets(DOCUMENTS, "dice", "s >= 0.8"),
    "prefix_rs_ed": rs_ed(PARTS, PARTS, 1),
    "prefix_rs_jaccard": rs_sets(DOCUMENTS, BENCHMARK, "jaccard", "s >= 0.3"),
    "prefix_rs_cosine": rs_sets(DOCUMENTS, BENCHMARK, "cosine", "s >= 0.3", "0.08"),
    "prefix_rs_dice": rs_sets(DOCUMENTS, BENCHMARK, "dice", "s >= 0.3", "0.17"),
    **{
        name: self_ed(CUSTOMERS, 1)
        for name in (
            "prefix_self_ed_skew", "ed_join_self_skew", "gram_count_self_skew", "cluster_self_ed_skew",
            "cross_self_ed_skew", "cluster_self_ed_split",
        )
    },
    "prefix_self_jaccard_hot": JACCARD_8,
    "similarity_join_records": f"""
        SELECT a.id AS id_l, a.text AS text_l, b.id AS id_r, b.text AS text_r,
               levenshtein(a.text, b.text) AS score
        FROM ({URLS}) a JOIN ({URLS}) b
        ON a.id < b.id AND levenshtein(a.text, b.text) <= 2""",
    "similarity_join_group_records": f"""
        WITH m AS MATERIALIZED (
            SELECT id, min(id) OVER (PARTITION BY toks) AS g FROM
            (SELECT id, list_sort(list_distinct({SPLIT.format('text')})) AS toks FROM ({DOCUMENTS}))
            WHERE len(toks) > 0)
        SELECT least(a.id, b.id) AS id_l, greatest(a.id, b.id) AS id_r, p.score
        FROM ({JACCARD_8}) p JOIN m a ON a.g = p.id_l JOIN m b ON b.g = p.id_r
        WHERE p.id_l <> p.id_r OR a.id < b.id""",
    "ed_join_self": PART_PAIRS,
    "gram_count_self": PART_PAIRS,
    "cluster_self_ed": PART_PAIRS,
    "cluster_self_jaccard": JACCARD_8,
    "minhash_self_jaccard": MINHASH,
    "cluster_home": f"{CELLS} SELECT id, anchor_id, dist FROM home",
    "cluster_outer": f"{CELLS} SELECT id, anchor_id, dist FROM outer_cells",
    "cluster_cell_sizes": f"""
        {CELLS}
        SELECT anchor_id, count(*) FILTER (is_home) AS home, count(*) FILTER (NOT is_home) AS outer
        FROM (SELECT anchor_id, true AS is_home FROM home UNION ALL
              SELECT anchor_id, false FROM outer_cells) GROUP BY anchor_id""",
    "pairs_normalize": f"""
        SELECT DISTINCT least(id_l, id_r) AS id_l, greatest(id_l, id_r) AS id_r
        FROM ({rs_sets(DOCUMENTS, DOCUMENTS, 'jaccard', 's >= 0.8')})""",
    "pairs_sorted": f"SELECT * FROM ({JACCARD_8}) ORDER BY id_l, id_r",
    "pairs_difference": self_sets(DOCUMENTS, "jaccard", "s >= 0.5 AND s < 0.8").split("UNION ALL")[0],
    "pairs_intersection": f"""
        SELECT * FROM ({JACCARD_8}) WHERE (id_l, id_r) IN
        (SELECT (id_l, id_r) FROM ({self_sets(DOCUMENTS, 'cosine', 's >= 0.95')}))""",
    "evaluate_pairs": f"""
        WITH p AS MATERIALIZED (SELECT id_l, id_r FROM ({MINHASH})),
        t AS MATERIALIZED (
            SELECT id_l, id_r FROM ({self_sets(DOCUMENTS, 'cosine', 's >= 0.9')})),
        c AS (SELECT (SELECT count(*) FROM p) AS predicted, (SELECT count(*) FROM t) AS truth,
                     (SELECT count(*) FROM p JOIN t USING (id_l, id_r)) AS hits)
        SELECT predicted, truth, hits, round(hits / predicted::DOUBLE, 6) AS precision,
               round(hits / truth::DOUBLE, 6) AS recall FROM c""",
    "stage_counts": f"""
        WITH {RANKED_SETS},
        entry AS MATERIALIZED (SELECT token, count(*) AS size FROM prefix GROUP BY token)
        SELECT 'tokenized' AS stage, count(*) AS rows FROM documents WHERE text IS NOT NULL
        UNION ALL SELECT 'groups', count(*) FROM g
        UNION ALL SELECT 'index_entries', count(*) FROM entry
        UNION ALL SELECT 'useful_entries', count(*) FROM entry WHERE size > 1
        UNION ALL SELECT 'candidates', count(*) FROM ({CANDIDATES_SELF})
        UNION ALL SELECT 'verified', count(*) FROM ({JACCARD_8}) WHERE id_l < id_r""",
    "method_counts": f"""
        SELECT method, sum(pairs)::BIGINT AS pairs FROM ({PART_PAIRS})
        CROSS JOIN (SELECT unnest(['cross', 'prefix', 'ed_join', 'gram_count', 'cluster']) AS method)
        GROUP BY method""",
}
