"""DuckDB SQL for the queries that SQL can express."""

ORACLE: dict[str, str] = {}

ORACLE["op1_mix_sources"] = r"""
WITH sized AS (
    SELECT doc_id, source, md5(text) AS digest,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size) AS cap,
           [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
    FROM sized GROUP BY source
), ranked AS (
    SELECT *, coalesce(sum(cap) OVER below, 0) AS clamped,
           sum(weight) OVER () - coalesce(sum(weight) OVER below, 0) AS free
    FROM sources
    WINDOW below AS (ORDER BY cap / weight, source NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
    SELECT ((SELECT sum(size) FROM sized) - clamped) / free AS level,
           cap > weight * (((SELECT sum(size) FROM sized) - clamped) / free) AS above, cap / weight AS ratio
    FROM ranked
), targets AS (
    SELECT source, source_size,
           least(cap, weight * (SELECT arg_min(level, ratio) FROM levels WHERE above)) AS target
    FROM sources
), placed AS (
    SELECT s.*, t.source_size, t.target, floor(t.target / t.source_size) AS whole,
           sum(size) OVER (PARTITION BY s.source
                           ORDER BY md5('42' || chr(31) || doc_id || coalesce(chr(31) || digest, '')), size
                           ROWS UNBOUNDED PRECEDING) AS run
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), counted AS (
    SELECT *, (whole + CASE WHEN target - whole * source_size > 0
                             AND run - size / 2 <= target - whole * source_size
                        THEN 1 ELSE 0 END)::INTEGER AS copies
    FROM placed
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM counted
"""

ORACLE["op10_warc_index"] = """
WITH hashed AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex
    FROM pages
), grouped AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload) AS kept,
           unhex(hex)::BIT::VARCHAR AS bits
    FROM hashed
)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i:
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
               (1 + 16 * substr(bits, 5 * i + 1, 1)::INTEGER + 8 * substr(bits, 5 * i + 2, 1)::INTEGER
                + 4 * substr(bits, 5 * i + 3, 1)::INTEGER + 2 * substr(bits, 5 * i + 4, 1)::INTEGER
                + substr(bits, 5 * i + 5, 1)::INTEGER)::INTEGER]), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM grouped
"""

ORACLE["op8_decontaminate"] = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id,
           coalesce(regexp_extract_all(
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
    FROM documents
), items AS (
    SELECT item_id,
           coalesce(regexp_extract_all(
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
    FROM benchmark
), passages AS (
    SELECT DISTINCT item_id, least(10, len(words)) AS n,
           array_to_string(words[i:i + 9], ' ') AS passage
    FROM (SELECT *, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS i FROM items WHERE len(words) > 0)
), windows AS (
    SELECT r, i, n, array_to_string(words[i:i + n - 1], ' ') AS passage
    FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS i
          FROM docs, (SELECT DISTINCT n FROM passages) WHERE len(words) >= n)
), matches AS (
    SELECT r, i, n, item_id FROM windows JOIN passages USING (n, passage)
), hit AS (
    SELECT r, count(DISTINCT w) AS n_hit
    FROM (SELECT r, unnest(range(i, i + n)) AS w FROM (SELECT DISTINCT r, i, n FROM matches)) GROUP BY r
), held AS (
    SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM matches WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN held USING (r)
"""

ORACLE["op3_divergence"] = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce('=' || lang, '') AS tongue
    FROM documents
), parted AS (
    SELECT *, length(t) AS n_chars,
           length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS capitals,
           length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS letters,
           length(regexp_replace(t, '[^\p{N}]+', '', 'g')) AS digits,
           length(regexp_replace(t, '[^\x20\x09-\x0D]+', '', 'g')) AS spaces,
           length(regexp_replace(t, '[^.,;:!?''"()\-]+', '', 'g')) AS points,
           length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
           regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
           list_transform(regexp_extract_all(t, '\p{L}+'), lambda x: lower(x)) AS letter_words
    FROM docs
), classes AS (
    SELECT r, tongue, n_chars, unnest(range(6)) AS k,
           unnest([capitals, letters - capitals, digits, spaces, points,
                   n_chars - letters - digits - spaces - points]) AS n
    FROM parted
), class_shares AS (
    SELECT tongue, k, sum(n) / sum(sum(n)) OVER (PARTITION BY tongue) AS q FROM classes GROUP BY tongue, k
), char_terms AS (
    SELECT r, n / n_chars AS p, q FROM classes JOIN class_shares USING (tongue, k) WHERE n_chars >= 300
), char_distances AS (
    SELECT r, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) / 2 ELSE 0 END
                                + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) / 2 ELSE 0 END), 0)) AS char_distance
    FROM char_terms GROUP BY r
), counted AS (
    SELECT tongue, word, count(*) AS n, sum(count(*)) OVER (PARTITION BY tongue) AS total,
           row_number() OVER (PARTITION BY tongue ORDER BY count(*) DESC, word) AS nth
    FROM (SELECT tongue, unnest(letter_words) AS word FROM parted) GROUP BY tongue, word
), common AS (
    SELECT tongue, word, n / total AS q FROM counted WHERE nth <= 16
), own AS (
    SELECT r, word, count(*) AS n FROM (SELECT r, unnest(letter_words) AS word FROM parted) GROUP BY r, word
), word_terms AS (
    SELECT r, coalesce(own.n, 0) / len(letter_words) AS p, q
    FROM parted JOIN common USING (tongue) LEFT JOIN own USING (r, word) WHERE len(letter_words) >= 50
), with_rest AS (
    SELECT * FROM word_terms UNION ALL SELECT r, 1 - sum(p), 1 - sum(q) FROM word_terms GROUP BY r
), word_distances AS (
    SELECT r, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) / 2 ELSE 0 END
                                + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) / 2 ELSE 0 END), 0)) AS word_distance
    FROM with_rest GROUP BY r
), windows AS (
    SELECT r, i, array_to_string(words[i:i + 7], ' ') AS w
    FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM parted WHERE len(words) > 7)
), repeated AS (
    SELECT r, count(DISTINCT j) AS n
    FROM (SELECT r, unnest(range(i, i + 8)) AS j
          FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS times FROM windows) WHERE times > 1)
    GROUP BY r
), base AS (
    SELECT r, doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
           n_symbols::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
           coalesce(n, 0)::BIGINT AS n_repeat_words, len(words) < 20 OR 100 * coalesce(n, 0) > 30 * len(words) AS base_failed
    FROM parted LEFT JOIN repeated USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       round(word_distance, 6) AS word_distance, round(char_distance, 6) AS char_distance,
       NOT base_failed AND coalesce(word_distance, 0) <= 0.32 AND coalesce(char_distance, 0) <= 0.22 AS kept
FROM base LEFT JOIN word_distances USING (r) LEFT JOIN char_distances USING (r)
"""

ORACLE["op11_jaccard_components"] = r"""
WITH RECURSIVE docs AS (
    SELECT row_number() OVER () AS r, doc_id,
           coalesce(regexp_extract_all(
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x20\x09-\x0D]+'), []) AS words
    FROM documents
), sets AS (
    SELECT DISTINCT r, array_to_string(words[i:i + 4], ' ') AS shingle
    FROM (SELECT *, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS i FROM docs WHERE len(words) > 0)
), sizes AS (
    SELECT r, count(*) AS n FROM sets GROUP BY r
), links AS (
    SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS m FROM sets x JOIN sets y USING (shingle) GROUP BY ALL)
    JOIN sizes s ON s.r = a JOIN sizes t ON t.r = b WHERE 100 * m >= 80 * (s.n + t.n - m)
), reach AS (
    SELECT r, r AS s FROM sizes UNION SELECT reach.r, b FROM reach JOIN links ON a = s
), least AS (
    SELECT reach.r, min(doc_id) AS component_id FROM reach JOIN docs ON docs.r = s GROUP BY reach.r
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS component_id
FROM docs LEFT JOIN sizes USING (r) LEFT JOIN least USING (r)
"""

ORACLE["op12_source_audit"] = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), held AS (
    SELECT r, lang, source, term, count(*) AS n
    FROM (SELECT r, lang, source, unnest(terms) AS term FROM docs) GROUP BY ALL
), kept AS (
    SELECT lang, term FROM held GROUP BY lang, term HAVING count(*) >= 30
), sizes AS (
    SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang
), counts AS (
    SELECT lang, source, term, sum(n)::HUGEINT AS n FROM held JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
    SELECT DISTINCT lang, source FROM docs
), totals AS (
    SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total
    FROM groups g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL
), shares AS (
    SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
           1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (t.total + 5 * v) AS p
    FROM totals t JOIN kept k USING (lang) JOIN sizes USING (lang)
    LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), of_lang AS (
    SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * any_value(v)) AS q
    FROM shares JOIN sizes USING (lang) GROUP BY lang, term
), pairs AS (
    SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
), found AS (
    SELECT p.lang, p.source, 'pair' AS part, p.item, coalesce(sum(abs(a.p - b.p)), 0)::BIGINT AS value
    FROM pairs p LEFT JOIN shares a ON a.lang = p.lang AND a.source = p.source
    LEFT JOIN shares b ON b.lang = p.lang AND b.source = p.item AND b.term = a.term
    GROUP BY ALL
    UNION ALL
    SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares JOIN of_lang USING (lang, term) WHERE n > 0 AND p > q
)
SELECT * FROM (
    SELECT lang, source, part, item, value,
           row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
    FROM found
) WHERE part = 'pair' OR rank <= 50
"""


def _rounds(rounds: int) -> str:
    """One CTE for the assignments and one for the centroids of each round of k-means."""
    parts = []
    for t in range(rounds + 1):
        parts.append(f"""
a{t} AS MATERIALIZED (
    SELECT r, k, d FROM (
        SELECT r, k, d, row_number() OVER (PARTITION BY r ORDER BY d, k) AS nth
        FROM (SELECT r, k, sum((a.x - c.x) * (a.x - c.x)) AS d FROM parts a JOIN c{t} c USING (i) GROUP BY r, k)
    ) WHERE nth = 1
)""")
        if t < rounds:
            parts.append(f"""
c{t + 1} AS MATERIALIZED (
    SELECT c.k, c.i, coalesce(m.x, c.x) AS x FROM c{t} c LEFT JOIN (
        SELECT k, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
        FROM parts JOIN a{t} USING (r) GROUP BY k, i
    ) m ON m.k = c.k AND m.i = c.i
)""")
    return ",".join(parts)


ORACLE["op13_centroids"] = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id,
           list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), parts AS MATERIALIZED (
    SELECT r, i, v[i] AS x FROM (SELECT r, v, unnest(range(1, 65)) AS i FROM kept)
), firsts AS (
    SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS k FROM kept
    ORDER BY sha256('3:' || vec_id), v LIMIT 8
), c0 AS MATERIALIZED (
    SELECT k, i, x FROM firsts JOIN parts USING (r)
), {_rounds(10)}, named AS (
    SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c10 GROUP BY k
)
SELECT vec_id, k::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a10 JOIN kept USING (r) JOIN named USING (k)
"""
