"""DuckDB SQL for the operators that SQL can express."""

ORACLE: dict[str, str] = {}

ORACLE["op4_exact_dedup"] = r"""
WITH normal AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS normal FROM documents
), ranked AS (
    SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, sha256(normal) AS text_sha256
    FROM normal WINDOW same AS (PARTITION BY normal)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
"""

ORACLE["op7_chat_format"] = r"""
WITH turns AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length('### ' || role || ': ') + length(text) + len(regexp_extract_all(text, '###|</turn>'))
        + length(chr(10) || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

ORACLE["op10_url_filter"] = r"""
WITH parsed AS (
    SELECT page_id, lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)) AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
    FROM pages
), units AS (
    SELECT *, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain,
        list_last(string_split(host, '.')) AS suffix FROM parsed
), marks AS (
    SELECT doc_id AS page_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) <> 1 THEN 1 ELSE 0 END) AS good
    FROM labels GROUP BY doc_id
), hosts AS (
    SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix, count(*) AS n, sum(good) AS good
    FROM units JOIN marks USING (page_id) GROUP BY host
), s0 AS (
    SELECT suffix, sum(n) AS n, sum(good) AS good, (SELECT sum(good) / sum(n) FROM hosts) AS prior FROM hosts GROUP BY suffix
), s1 AS (
    SELECT *, least(greatest(prior, 0.001), 0.999) AS m FROM s0
), s2 AS (
    SELECT *, 1 / (SELECT least(greatest((sum((good - n * m) ^ 2 / (n * m * (1 - m))) - count(*))
        / greatest(sum(n - 1), 1), 0.005), 0.5) FROM s1) - 1 AS strength FROM s1
), s3 AS (
    SELECT suffix, strength * prior + good AS a, strength * (1 - prior) + n - good AS b FROM s2
), d0 AS (
    SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY domain
), d1 AS (
    SELECT d0.*, a / (a + b) AS prior, least(greatest(a / (a + b), 0.001), 0.999) AS m FROM d0 JOIN s3 USING (suffix)
), d2 AS (
    SELECT *, 1 / (SELECT least(greatest((sum((good - n * m) ^ 2 / (n * m * (1 - m))) - count(*))
        / greatest(sum(n - 1), 1), 0.005), 0.5) FROM d1) - 1 AS strength FROM d1
), d3 AS (
    SELECT domain, strength * prior + good AS a, strength * (1 - prior) + n - good AS b FROM d2
), h1 AS (
    SELECT hosts.*, a / (a + b) AS prior, least(greatest(a / (a + b), 0.001), 0.999) AS m FROM hosts JOIN d3 USING (domain)
), h2 AS (
    SELECT *, 1 / (SELECT least(greatest((sum((good - n * m) ^ 2 / (n * m * (1 - m))) - count(*))
        / greatest(sum(n - 1), 1), 0.005), 0.5) FROM h1) - 1 AS strength FROM h1
), h3 AS (
    SELECT host, strength * prior + good AS a, strength * (1 - prior) + n - good AS b FROM h2
), unseen AS (
    -- A host without labels has the posterior of no pages around its domain's rate, or else its suffix's.
    SELECT max(strength) AS strength FROM h2
), bounds AS (
    SELECT page_id, host, path,
        coalesce(h3.a, strength * d3.a / (d3.a + d3.b), strength * s3.a / (s3.a + s3.b)) AS a,
        coalesce(h3.b, strength * (1 - d3.a / (d3.a + d3.b)), strength * (1 - s3.a / (s3.a + s3.b))) AS b
    FROM units CROSS JOIN unseen LEFT JOIN h3 USING (host) LEFT JOIN d3 USING (domain) LEFT JOIN s3 USING (suffix)
), ruled AS (
    SELECT *, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
    FROM bounds
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN least(a / (a + b) + 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 1) < 0.7 THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""

ORACLE["op11_topk"] = """
WITH valid AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM valid q JOIN valid c ON len(q.v) = len(c.v) AND q.vec_id IS DISTINCT FROM c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

#: The table of the CRC's bytes comes from its polynomial; a feature's CRC is a fold over its bytes.
ORACLE["op12_importance"] = r"""
WITH crc AS (
    SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b)
        ORDER BY b) AS steps FROM range(256) t(b)
), hex_digits AS (
    SELECT map(list(printf('%02X', b) ORDER BY b), list(b ORDER BY b)) AS value FROM range(256) t(b)
), texts AS (
    SELECT 'd' AS side, row_number() OVER () AS r, doc_id, text FROM documents
    UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark
), worded AS (
    SELECT side, r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), features AS (
    SELECT side, r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS feature FROM worded
), spelled AS (
    SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM features)
), bucketed AS (
    SELECT feature, xor(list_reduce(
        list_transform(range(len(h) // 2), lambda i: value[substr(h, 2 * i::INT + 1, 2)]),
        lambda c, b: xor(c // 256, steps[xor(c % 256, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket
    FROM spelled, crc, hex_digits
), counted AS (
    SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t
    FROM features JOIN bucketed USING (feature) GROUP BY bucket
), sums AS (
    SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM counted
), gained AS (
    SELECT bucket, floor(1000 * ln(((t::DOUBLE + 1) * (s_all + 10000)) / ((s::DOUBLE + 1) * (t_all + 10000))))::BIGINT AS gain
    FROM counted, sums
), weighed AS (
    SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS gain
    FROM features JOIN bucketed USING (feature) JOIN gained USING (bucket) WHERE side = 'd' GROUP BY r
), scored AS (
    SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
        coalesce(floor(gain::DOUBLE / n_features), 0)::BIGINT AS weight,
        ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
    FROM worded LEFT JOIN weighed USING (r) WHERE side = 'd'
), noisy AS (
    SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
        count(*) FILTER (n_words >= 20) OVER () AS n FROM noisy
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM placed
"""

ORACLE["op13_divergence"] = r"""
WITH texts AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), words AS (
    SELECT r, lang, source, unnest(terms) AS term FROM texts
), kept AS (
    SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), sizes AS (
    SELECT lang, count(*) AS v FROM kept GROUP BY lang
), groups AS (
    SELECT DISTINCT lang, source FROM texts
), found AS (
    SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), grid AS (
    SELECT groups.lang, groups.source, term, coalesce(n, 0)::HUGEINT AS n, v,
        sum(coalesce(n, 0)) OVER (PARTITION BY groups.lang, groups.source) AS of_group,
        sum(coalesce(n, 0)) OVER (PARTITION BY groups.lang, term) AS of_lang,
        sum(coalesce(n, 0)) OVER (PARTITION BY groups.lang) AS of_all
    FROM groups JOIN kept USING (lang) JOIN sizes USING (lang) LEFT JOIN found USING (lang, source, term)
), shares AS (
    SELECT lang, source, term, n, (1 + (1000000000 * (n + 5)) // (of_group + 5 * v))::BIGINT AS p,
        (1 + (1000000000 * (of_lang + 5)) // (of_all + 5 * v))::BIGINT AS q
    FROM grid
), distances AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY a.lang, a.source, b.source
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
), parts AS (
    SELECT * FROM pairs UNION ALL
    SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
