"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

OP8 = r"""
WITH sized AS (
    SELECT doc_id, coalesce('=' || source, '~') AS source,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))), 1, 8))::BIGINT // 4 AS place
    FROM documents
), totals AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           (row_number() OVER (ORDER BY source) - 1) % 3 + 1.0::DOUBLE AS weight
    FROM sized GROUP BY source
), limits AS (
    SELECT *, 3.0::DOUBLE * source_size AS bound,
           row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source) AS n FROM totals
), shares AS (
    SELECT *, (sum(source_size) OVER () - (sum(bound) OVER (ORDER BY n) - bound))
           / (sum(weight) OVER () - (sum(weight) OVER (ORDER BY n) - weight)) AS share FROM limits
), shared AS (
    SELECT source, source_size, least(bound, coalesce((SELECT s.share FROM shares s WHERE s.share * s.weight <= s.bound
           ORDER BY s.n LIMIT 1) * weight, bound)) AS target FROM shares
), goals AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS fulls FROM shared
), places AS (
    SELECT source, place, sum(size) AS here FROM sized GROUP BY source, place
), running AS (
    SELECT p.*, g.target - g.fulls * g.source_size AS missing,
           sum(here) OVER (PARTITION BY p.source ORDER BY place) AS upto
    FROM places p JOIN goals g USING (source)
), cuts AS (
    SELECT source, max(place + 1) AS cut FROM running
    WHERE missing > 0 AND (upto <= missing OR (upto - here < missing AND upto - missing <= missing - (upto - here)))
    GROUP BY source
)
SELECT doc_id, size, source_size, target, (size * (fulls + CASE WHEN place < cut THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized JOIN goals USING (source) LEFT JOIN cuts USING (source)
"""


OP2 = r"""
WITH texts AS (
    SELECT row_number() OVER () AS n, doc_id, source, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), windows AS (
    SELECT n, unnest(range(1, len(words) - 1)) AS i, words FROM texts WHERE len(words) > 3
), grams AS (
    SELECT n, i, count(*) OVER (PARTITION BY n, words[i], words[i + 1], words[i + 2]) AS times FROM windows
), covered AS (
    SELECT n, count(DISTINCT i + d) AS n_repeat_words FROM grams, (SELECT unnest([0, 1, 2]) AS d) WHERE times > 1 GROUP BY n
), lines AS (
    SELECT n, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT n, unnest(string_split(text, chr(10))) AS line FROM texts)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY n
), measured AS (
    SELECT doc_id, source, len(words)::BIGINT AS n_words,
           len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
           (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM texts LEFT JOIN covered USING (n) LEFT JOIN lines USING (n)
), judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
), hosts AS (
    SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS failed FROM judged WHERE source IS NOT NULL GROUP BY source
), sums AS (
    SELECT count(*)::DOUBLE AS k, sum(n) AS n, sum(failed) / sum(n) AS mean, sum(failed / n * failed) / sum(n) AS squares FROM hosts
), prior AS (
    SELECT mean, CASE WHEN squares - mean * mean > mean * (1 - mean) * k / n
           THEN least(greatest(mean * (1 - mean) / (squares - mean * mean - mean * (1 - mean) * k / n) - 1, 1.0), 1e6) ELSE 1e6 END AS strength FROM sums
), rejected AS (
    SELECT source, (failed + mean * strength) / (n + strength) > 0.5 AS host_rejected FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(host_rejected, false) AS kept, coalesce(host_rejected, false) AS host_rejected
FROM judged LEFT JOIN rejected USING (source)
"""


def _op9() -> str:
    steps, before = [], "groups0"
    for d in range(1, 7):  # as deep as the paths of the tables, and deeper
        steps.append(f"""
sums{d} AS (SELECT host, template, coalesce(p[{d}], '') AS s, sum(n) AS n, sum(bad) AS bad, sum(bad + good) AS seen FROM {before} GROUP BY ALL),
literal{d} AS (
    SELECT *, bad / greatest(seen, 1) AS rate FROM sums{d} JOIN (SELECT host, template, sum(n) AS total FROM sums{d} GROUP BY ALL) USING (host, template)
    WHERE n >= 0.05::DOUBLE * total AND s <> ''
), before{d} AS (
    SELECT *, lag(seen) OVER w AS seen0, lag(bad) OVER w AS bad0, lag(rate) OVER w AS rate0
    FROM literal{d} WINDOW w AS (PARTITION BY host, template ORDER BY seen = 0, rate, s)
), same{d} AS (
    SELECT *, CASE WHEN seen = 0 AND seen0 = 0 THEN 0 WHEN seen > 0 AND seen0 > 0 AND rate - rate0 <= 1.96::DOUBLE * sqrt(
        ((bad + bad0) / (seen + seen0)) * (1 - (bad + bad0) / (seen + seen0)) * (1 / seen + 1 / seen0)) THEN 0 ELSE 1 END AS step FROM before{d}
), grouped{d} AS (
    SELECT *, sum(step) OVER (PARTITION BY host, template ORDER BY seen = 0, rate, s) AS g FROM same{d}
), branches{d} AS (
    SELECT host, template, s, string_agg(s, '|' ORDER BY s) OVER (PARTITION BY host, template, g
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS branch FROM grouped{d}
), groups{d} AS (
    SELECT x.* REPLACE (x.template || CASE WHEN coalesce(p[{d}], '') = '' THEN '' ELSE '/' || coalesce(branch, '*') END AS template)
    FROM {before} x LEFT JOIN branches{d} b ON x.host = b.host AND x.template = b.template AND coalesce(x.p[{d}], '') = b.s
)""")
        before = f"groups{d}"
    shape = r"CASE WHEN regexp_matches(x, '^[0-9]+(\.[A-Za-z0-9]+)?$') THEN regexp_replace(x, '[0-9]+', '{n}', 'g') WHEN regexp_matches(x, '^[0-9a-f]{8,}$') THEN '{h}' ELSE x END"
    keys = "host, p"
    return rf"""
WITH split AS (
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
    FROM pages
), ruled AS (
    SELECT *, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                   WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
                   WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
                   WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
                   WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
    FROM split
), parts AS (
    SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS decided,
           list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: {shape}) AS p
    FROM ruled
), listed AS (
    SELECT * FROM parts
), groups0 AS (
    SELECT {keys}, '' AS template, count(*)::DOUBLE AS n, (count(*) FILTER (decided = 'block'))::DOUBLE AS bad, (count(*) FILTER (decided = 'allow'))::DOUBLE AS good
    FROM listed GROUP BY {keys}
),{",".join(steps)},
final AS (SELECT * FROM {before}),
everywhere AS (SELECT CASE WHEN sum(bad + good) > 0 THEN sum(bad) / sum(bad + good) ELSE 0 END AS rate FROM final),
hosts AS (SELECT host, (sum(bad) + 2.0::DOUBLE * max(rate)) / (sum(bad) + sum(good) + 2.0::DOUBLE) AS host_rate FROM final, everywhere GROUP BY host),
judged AS (
    SELECT host, template, (sum(bad) + 2.0::DOUBLE * max(host_rate)) / (sum(bad) + sum(good) + 2.0::DOUBLE) >= 0.8::DOUBLE AS rejected
    FROM final JOIN hosts USING (host) GROUP BY host, template
)
SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict, template
FROM listed JOIN final USING ({keys}) JOIN judged USING (host, template)
"""


OP7 = """
WITH usable AS (
    SELECT vec_id, min(embedding::DOUBLE[]) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    GROUP BY vec_id
), pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
    FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


OP11 = r"""
WITH RECURSIVE crc_table AS (
    SELECT n, n::BIGINT AS value, 0 AS step FROM range(256) t(n)
    UNION ALL
    SELECT n, CASE WHEN value % 2 = 1 THEN xor(value // 2, 3988292384) ELSE value // 2 END, step + 1 FROM crc_table WHERE step < 8
), crc AS (
    SELECT list(value ORDER BY n) AS entries FROM crc_table WHERE step = 8
), named AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
), drawn AS (
    SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda c: ord(c)::BIGINT)),
           lambda value, byte: xor(value // 256, entries[xor(value, byte) % 256 + 1])), 4294967295::BIGINT) % 20 AS kind
    FROM named, crc
), damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM (SELECT *, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM drawn)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS pos,
           left(role, 1) AS initial, right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS ending FROM damaged
), marked AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS seen,
           lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS two FROM placed
), judged AS (
    SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
    FROM marked
), best AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS pos, {'cost': 0::BIGINT, 'audit': ''} AS b0, {'cost': 1000000000::BIGINT, 'audit': ''} AS b1,
           {'cost': 1000000000::BIGINT, 'audit': ''} AS b2, {'cost': 1000000000::BIGINT, 'audit': ''} AS b3 FROM judged
    UNION ALL
    SELECT conv_id, pos,
           {'cost': e0.cost + 4, 'audit': e0.audit || 'D'},
           least({'cost': e1.cost + 4, 'audit': e1.audit || 'D'}, {'cost': e0.cost + s, 'audit': e0.audit || 'K'}),
           least({'cost': e2.cost + 4, 'audit': e2.audit || 'D'},
                 {'cost': e0.cost + u, 'audit': e0.audit || 'K'}, {'cost': e1.cost + u, 'audit': e1.audit || 'K'}, {'cost': e3.cost + u, 'audit': e3.audit || 'K'},
                 {'cost': e0.cost + r, 'audit': e0.audit || 'R'}, {'cost': e1.cost + r, 'audit': e1.audit || 'R'}, {'cost': e3.cost + r, 'audit': e3.audit || 'R'}),
           least({'cost': e3.cost + 4, 'audit': e3.audit || 'D'}, {'cost': e2.cost + a, 'audit': e2.audit || 'K'}, {'cost': e2.cost + r, 'audit': e2.audit || 'R'})
    FROM (
        SELECT j.conv_id, j.pos, b0 AS e0, b1 AS e1,
               least(b2, {'cost': b0.cost + 3, 'audit': b0.audit || 'I'}, {'cost': b1.cost + 3, 'audit': b1.audit || 'I'}, {'cost': b3.cost + 3, 'audit': b3.audit || 'I'}) AS e2,
               least(b3, {'cost': b2.cost + 3, 'audit': b2.audit || 'I'}, {'cost': b0.cost + 6, 'audit': b0.audit || 'II'}, {'cost': b1.cost + 6, 'audit': b1.audit || 'II'}) AS e3,
               must + late + CASE WHEN initial = 's' THEN 0 ELSE 1000000000 END AS s, must + late + CASE WHEN initial = 'u' THEN 0 ELSE 1000000000 END AS u,
               must + late + CASE WHEN initial = 'a' THEN 0 ELSE 1000000000 END AS a, must + late + 3 AS r
        FROM best b JOIN (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000 ELSE 0 END AS must,
                          CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS late FROM judged) j
          ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.pos = b.pos + 1
    )
), audits AS (
    SELECT conv_id, least(b0, b3, {'cost': b2.cost + 3, 'audit': b2.audit || 'I'}, {'cost': b1.cost + 6, 'audit': b1.audit || 'II'}) AS found
    FROM best QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1
), steps AS (
    SELECT conv_id, found.audit AS audit, unnest(range(1, len(found.audit) + 1)) AS i FROM audits
), lines AS (
    SELECT conv_id, i, audit[i] AS edit, len(replace(audit[1:i], 'I', '')) AS pos, len(replace(audit[1:i], 'D', '')) - len(replace(audit, 'D', '')) % 2 AS place FROM steps
), texts AS (
    SELECT l.conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN j.role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
           CASE WHEN edit = 'I' THEN '' ELSE j.text END, chr(10) ORDER BY i)) AS sha
    FROM lines l LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM l.conv_id AND j.pos = l.pos WHERE edit <> 'D' GROUP BY l.conv_id
), sums AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
           count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal
    FROM judged GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(found.cost, 0) AS cost, coalesce(found.audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""


OP12 = r"""
WITH docs AS (
    SELECT row_number() OVER () AS n_row, doc_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
    FROM documents WHERE text IS NOT NULL
), totals AS (
    SELECT count(*)::BIGINT AS n_docs, sum(len(words))::BIGINT AS n_terms FROM docs WHERE len(words) > 0
), items AS (
    SELECT row_number() OVER () AS item, item_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
    FROM benchmark WHERE text IS NOT NULL
), asked AS (
    SELECT item, item_id, term, count(*)::BIGINT AS times FROM (SELECT item, item_id, unnest(words) AS term FROM items) GROUP BY ALL
), counted AS (
    SELECT n_row, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT n_row, doc_id, len(words)::BIGINT AS n, unnest(words) AS term FROM docs)
    WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counted, totals GROUP BY term, n_docs
), scores AS (
    SELECT item, item_id, n_row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM asked JOIN counted USING (term) JOIN weights USING (term), totals GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, n_row)::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""


def registry() -> dict[str, str]:
    return {
        "op2_quality": OP2, "op7_vector_search": OP7, "op8_mixing": OP8, "op9_url_filter": _op9(),
        "op11_conversation_repair": OP11, "op12_lexical_search": OP12,
    }
