"""DuckDB SQL of the operators that SQL can express: the quality rules, the source mix, archived
pages, centroid clusters and repaired conversations.

The others rest on trained or random vectors, keyed hashes, a tokenizer or connected components
of links between all documents; they are tested against brute force.
"""

# Measures of each text: least spread of a group, and whether low values count as well.
_SLACK = {"word_length": (150, True), "symbols": (40, False), "dup_lines": (300, False), "repeats": (200, False)}
_LIST = ", ".join(f"('{name}', {least}, {str(low).lower()})" for name, (least, low) in _SLACK.items())

QUALITY = rf"""
WITH doc AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS lang,
           coalesce('=' || source, '') AS source, coalesce(text, '') AS t,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)),
                       lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents),
win AS (SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS g
        FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM doc WHERE len(w) > 2)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cover AS (SELECT r, count(DISTINCT p) AS n FROM
          (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
base AS MATERIALIZED (
    SELECT doc.r, doc_id, lang, source, len(w)::BIGINT AS n_words,
           coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
           coalesce(cover.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
    FROM doc LEFT JOIN cover ON cover.r = doc.r),
judged AS MATERIALIZED (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
value AS MATERIALIZED (
    SELECT r, lang, source, base_failed, m.measure, m.x FROM judged, LATERAL (
        SELECT unnest(['word_length', 'symbols', 'dup_lines', 'repeats']) AS measure,
               unnest([word_chars * 100 // greatest(n_words, 1), n_symbols * 1000 // greatest(word_chars, 1),
                       n_dup_lines * 1000 // greatest(n_lines, 1),
                       n_repeat_words * 1000 // greatest(n_words, 1)]) AS x) m),
rounded AS (
    SELECT lang, source, measure, (((x >> s) + 1) << s) - 1 AS v
    FROM (SELECT *, greatest(0, length(bin(x)) - 6) AS s FROM value WHERE NOT base_failed)),
grouped AS (
    SELECT 0 AS level, lang, source, measure, v FROM rounded
    UNION ALL SELECT 1, lang, '', measure, v FROM rounded
    UNION ALL SELECT 2, '', '', measure, v FROM rounded),
sketch AS (SELECT level, lang, source, measure, v, count(*) AS n FROM grouped GROUP BY ALL),
upto AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY v) AS u,
                sum(n) OVER (PARTITION BY level, lang, source, measure) AS a FROM sketch),
quart AS (SELECT level, lang, source, measure, min(v) FILTER (u * 4 >= a) AS q1,
                 min(v) FILTER (u * 4 >= a * 3) AS q3, max(a) AS n FROM upto GROUP BY ALL),
fence AS MATERIALIZED (
    SELECT level, lang, source, q.measure, n, q3 + greatest(3 * (q3 - q1), least_spread) AS high,
           CASE WHEN both_sides THEN q1 - greatest(3 * (q3 - q1), least_spread) END AS low
    FROM quart q JOIN (VALUES {_LIST}) k(measure, least_spread, both_sides) ON k.measure = q.measure),
chosen AS MATERIALIZED (
    SELECT r, coalesce((SELECT min(level) FROM fence f WHERE n >= 200 AND level < 2
                        AND f.lang = j.lang AND (level = 1 OR f.source = j.source)), 2) AS level
    FROM judged j),
outside AS (
    SELECT v.r FROM value v JOIN chosen c ON c.r = v.r JOIN fence f
    ON f.level = c.level AND f.measure = v.measure AND (f.level = 2 OR f.lang = v.lang)
       AND (f.level > 0 OR f.source = v.source)
    WHERE v.x > f.high OR v.x < f.low)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND j.r NOT IN (SELECT r FROM outside) AS kept, c.level::INT AS fence_level
FROM judged j JOIN chosen c ON c.r = j.r"""

# The mix: shares fill up to three times a source's size; a source's rate of copies per weight
# likewise; what is left over is taken in the order of the random odds, to the nearest word count.
MIX = r"""
WITH doc AS MATERIALIZED (
    SELECT doc_id, coalesce('=' || source, '') AS k,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
drawn AS MATERIALIZED (
    SELECT *, length(bin(greatest(size, 1)))::DOUBLE AS weight,
           (('0x' || substr(md5(concat_ws('|', '17', doc_id::VARCHAR, size::VARCHAR)), 1, 13))::BIGINT::DOUBLE
            + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM doc),
src AS (SELECT k, sum(size)::BIGINT AS source_size FROM doc GROUP BY k),
share AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY k = '', k) - 1) % 3 + 1]::DOUBLE AS w,
                 source_size * 3::DOUBLE AS cap FROM src),
level AS (SELECT *, (sum(source_size) OVER ()
                     - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                    / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l
          FROM share),
found AS (SELECT l AS height FROM level WHERE cap >= l * w ORDER BY cap / w, k LIMIT 1),
target AS MATERIALIZED (
    SELECT k, source_size, least(cap, coalesce((SELECT height FROM found) * w, cap)) AS target FROM share),
bins AS (SELECT k, weight, sum(size)::BIGINT AS words FROM drawn GROUP BY k, weight),
tried AS (SELECT k, weight, (target - 3 * coalesce(sum(words) OVER (
                     PARTITION BY k ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / nullif(sum(words * weight) OVER (
                     PARTITION BY k ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS rate
          FROM bins JOIN target USING (k)),
rate AS (SELECT k, max_by(rate, weight) FILTER (rate * weight <= 3 * (1 + 1e-12)) AS rate FROM tried GROUP BY k),
allotted AS (
    SELECT *, greatest(least(3::DOUBLE, coalesce(rate * weight, 3::DOUBLE)), 0) AS e
    FROM drawn JOIN target USING (k) JOIN rate USING (k)),
ranked AS MATERIALIZED (
    SELECT *, CASE WHEN p > 1e-9 AND size > 0 THEN o / (1 + o) END AS rank FROM (
        SELECT *, (u / (1 - u)) / nullif(p / (1 - p), 0) AS o FROM (
            SELECT *, floor(e + 1e-9) AS whole, e - floor(e + 1e-9) AS p FROM allotted))),
missing AS (SELECT k, max(target) - sum(size * whole) AS m FROM ranked GROUP BY k),
upto AS (SELECT k, rank, size, sum(size) OVER (PARTITION BY k ORDER BY rank RANGE UNBOUNDED PRECEDING) AS s
         FROM ranked WHERE rank IS NOT NULL),
cut AS (SELECT k, max(rank) AS last FROM upto JOIN missing USING (k)
        WHERE abs(m - s) <= abs(m - (s - size)) GROUP BY k),
decided AS (SELECT *, (whole + CASE WHEN rank <= last THEN 1 ELSE 0 END)::BIGINT AS copies
            FROM ranked LEFT JOIN cut USING (k))
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM decided"""

# Base32 takes five bits at a time, out of two hexadecimal digits.
ARCHIVES = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS lead FROM p)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + (
           ((strpos('0123456789abcdef', substr(h, 5 * i // 4 + 1, 1)) - 1) * 16
            + strpos('0123456789abcdef', substr(h, 5 * i // 4 + 2, 1)) - 1) // (1 << (3 - 5 * i % 4))::BIGINT) % 32)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> lead THEN lead END AS refers_to, NULL::VARCHAR AS error
FROM d
"""


def _centroids(rounds: int = 3, k: int = 16, dim: int = 64) -> str:
    parts = [f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)::BIGINT) AS x
    FROM embeddings WHERE len(embedding) = {dim} AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c)))),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS k, x AS c
    FROM v ORDER BY k LIMIT {k})"""]
    near = """a{i} AS MATERIALIZED (
    SELECT r, arg_min(k, d * 1024 + k) AS k, min(d) AS d FROM (
        SELECT r, k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM v, c{i}) GROUP BY r)"""
    mean = """c{j} AS MATERIALIZED (
    SELECT c{i}.k, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
        SELECT k, list(floor_mean ORDER BY place) AS c FROM (
            SELECT k, place, ((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS floor_mean
            FROM (SELECT a{i}.k, unnest(x) AS e, unnest(range(len(x))) AS place FROM v JOIN a{i} USING (r))
            GROUP BY k, place) GROUP BY k) m ON m.k = c{i}.k)"""
    for i in range(rounds):
        parts += [near.format(i=i), mean.format(i=i, j=i + 1)]
    parts.append(near.format(i=rounds))
    return ",\n".join(parts) + f"""
SELECT vec_id, a.k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.k = a.k
"""


CONVERSATIONS = r"""
WITH RECURSIVE raw AS (
    SELECT row_number() OVER () AS r, coalesce('=' || conv_id, '') AS k, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
    FROM conversations),
hashed AS MATERIALIZED (
    SELECT *, (4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda x: ord(x)::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
            lambda z, i: CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384) ELSE z >> 1 END))) % 20 AS kind
    FROM raw),
damaged AS (
    SELECT r, k, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM hashed WHERE kind <> 0),
placed AS MATERIALIZED (
    SELECT k, turn, role, text, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, r, copy) AS i,
           rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
    FROM damaged),
judged AS MATERIALIZED (
    SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 'duplicate'
                   WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
           left(role, 1) AS first, lag(left(role, 1)) OVER (PARTITION BY k ORDER BY i) AS previous
    FROM placed),
grown(now, mid, inserts, added) AS (VALUES
    ('', '', '', ''), ('', 'u', 'I', 'user:'), ('', 'a', 'II', 'user:' || chr(10) || 'assistant:'), ('s', 's', '', ''),
    ('s', 'u', 'I', chr(10) || 'user:'), ('s', 'a', 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), ('u', 'u', '', ''),
    ('u', 'a', 'I', chr(10) || 'assistant:'), ('a', 'a', '', ''), ('a', 'u', 'I', chr(10) || 'user:')),
edit(kind, now, mid, inserts, added) AS (SELECT e.kind, g.* FROM grown g, (VALUES ('K'), ('R'), ('D')) e(kind)),
path AS (
    SELECT DISTINCT k, 0::BIGINT AS i, '' AS state, 0::BIGINT AS cost, '' AS audit, '' AS kept FROM raw
    UNION ALL
    SELECT k, i, state, cost, audit, kept FROM (
        SELECT p.k, j.i, CASE e.kind WHEN 'D' THEN mid WHEN 'K' THEN first ELSE CASE mid WHEN 'u' THEN 'a' ELSE 'u' END END AS state,
               p.cost + 3 * length(inserts) + CASE e.kind WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END
                   + CASE WHEN e.kind <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END AS cost,
               p.audit || inserts || e.kind AS audit,
               p.kept || added || CASE WHEN e.kind = 'D' THEN '' ELSE
                   CASE mid WHEN '' THEN '' ELSE chr(10) END
                   || CASE WHEN e.kind = 'K' THEN role WHEN mid = 'u' THEN 'assistant' ELSE 'user' END || ':' || text END AS kept
        FROM path p JOIN judged j ON j.k = p.k AND j.i = p.i + 1 JOIN edit e ON e.now = p.state
        WHERE e.kind = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (e.kind = 'R' OR (mid || first) IN ('s', 'u', 'su', 'ua', 'au'))))
    QUALIFY row_number() OVER (PARTITION BY k, state ORDER BY cost, audit) = 1),
seen AS (
    SELECT k, max(i) AS n, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (previous IS NOT NULL AND (previous || first) NOT IN ('su', 'ua', 'au')) AS illegal,
           coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
    FROM judged GROUP BY k),
ended AS (
    SELECT p.k, p.cost + 3 * length(inserts) AS cost, p.audit || inserts AS audit, p.kept || added AS kept
    FROM path p LEFT JOIN seen s ON s.k = p.k JOIN grown g ON g.now = p.state AND (g.mid = 'a' OR (g.mid = '' AND g.now = ''))
    WHERE p.i = coalesce(s.n, 0)
    QUALIFY row_number() OVER (PARTITION BY p.k ORDER BY p.cost + 3 * length(inserts), p.audit || inserts) = 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, cost::BIGINT AS cost, audit, sha256(kept) AS repaired_sha256
FROM (SELECT DISTINCT k, conv_id FROM raw) c JOIN ended USING (k) LEFT JOIN seen USING (k)
"""

ORACLES = {
    "op7_quality_rules": QUALITY,
    "op9_mix_sources": MIX,
    "op11_warc": ARCHIVES,
    "op12_centroids": _centroids(),
    "op13_conversations": CONVERSATIONS,
}
