"""The operators that SQL can express, in DuckDB's dialect."""

_WORDS = r"[^\x20\x09-\x0D]+"

ORACLE: dict[str, str] = {}

ORACLE["op1_exact_dedup"] = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
FROM (
    SELECT doc_id, coalesce(text, '') AS body,
        max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
        count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size
    FROM documents
)
"""

_RULES = "['few_words', 'repeated_words', 'short_words', 'long_words', 'many_symbols', 'repeated_lines', 'few_letters', 'mostly_upper']"
_POLICIES = ", ".join(
    f"failed & {mask} = 0 AS kept_{version}, CASE WHEN bit_count(failed & {mask}) = 1 THEN {_RULES}[bit_count((failed & {mask}) - 1) + 1] END AS only_{version}"
    for version, mask in (("base", 3), ("v1", 31), ("v2", 223), ("strict", 255))
)

ORACLE["op2_quality_rules"] = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS words FROM documents),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM docs),
windows AS (
    SELECT doc_id, pos, lead(word, 7) OVER w AS last,
        concat_ws(' ', word, lead(word, 1) OVER w, lead(word, 2) OVER w, lead(word, 3) OVER w,
            lead(word, 4) OVER w, lead(word, 5) OVER w, lead(word, 6) OVER w, lead(word, 7) OVER w) AS words
    FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
),
repeated AS (
    SELECT doc_id, pos FROM windows WHERE last IS NOT NULL
    QUALIFY count(*) OVER (PARTITION BY doc_id, words) > 1
),
covered AS (
    SELECT doc_id, count(DISTINCT pos + step) AS n_repeat_words
    FROM repeated, (SELECT unnest(range(8)) AS step) GROUP BY doc_id
),
split AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM docs),
lines AS (
    SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM split WHERE regexp_matches(line, '{_WORDS}') GROUP BY doc_id
),
measured AS (
    SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
        length(regexp_replace(body, '\P{{L}}', '', 'g')) AS n_letters, length(regexp_replace(body, '\P{{Lu}}', '', 'g')) AS n_upper
    FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)
),
ruled AS (
    SELECT *,
        CASE WHEN n_words < 20 THEN 1 ELSE 0 END
        + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END
        + CASE WHEN word_chars > 20 * n_words THEN 8 ELSE 0 END
        + CASE WHEN n_symbols > 0.5 * n_words THEN 16 ELSE 0 END
        + CASE WHEN n_lines > 3 AND n_dup_lines > 0.5 * n_lines THEN 32 ELSE 0 END
        + CASE WHEN n_letters < 0.5 * word_chars THEN 64 ELSE 0 END
        + CASE WHEN n_letters > 0 AND n_upper > 0.7 * n_letters THEN 128 ELSE 0 END AS failed
    FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
    failed & 3 <> 0 AS base_failed, failed & 223 = 0 AS kept, n_lines, n_letters, n_upper, CAST(failed AS BIGINT) AS failed,
    {_POLICIES}
FROM ruled
"""

_LOWERED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HOST = _LOWERED.format("regexp_extract({0}, '://([^/?#]*)', 1)")
_PATH = "regexp_extract({0}, '://[^/?#]*([^?#]*)', 1)"
_SEGMENTS = "string_split(" + _PATH + ", '/')"
_WALKED = (
    "list_reduce(list_prepend('', " + _SEGMENTS + "[2:]), lambda b, x: CASE x WHEN '..' THEN regexp_replace(b, '/[^/]*$', '') WHEN '.' THEN b ELSE b || '/' || x END)"
    " || CASE WHEN " + _SEGMENTS + "[-1] IN ('.', '..') THEN '/' ELSE '' END"
)
_ADDRESS = (
    _LOWERED.format("regexp_extract({0}, '^(.*?)://', 1, 's')") + " || '://' || " + _HOST
    + " || CASE WHEN " + _PATH + " = '' THEN '/' WHEN contains(" + _PATH + ", '/.') THEN " + _WALKED + " ELSE " + _PATH + " END"
    + " || regexp_extract({0}, '://[^/?#]*[^?#]*([^#]*)', 1)"
)

ORACLE["op7_url_filter"] = rf"""
WITH RECURSIVE rules(verdict, host, path) AS (
    VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
),
parts AS (
    SELECT page_id, url, html,
        CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
        CASE WHEN contains(url, '://') THEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
    FROM pages
),
tags AS (
    SELECT url, regexp_extract(unnest(regexp_extract_all(html, '(?is)<link\b[^>]*>')), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS target,
        unnest(regexp_extract_all(html, '(?is)<link\b[^>]*>')) AS tag FROM pages WHERE contains(url, '://')
),
metas AS (
    SELECT url, unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*>')) AS tag FROM pages WHERE contains(url, '://')
),
found AS (
    SELECT url, target FROM tags WHERE regexp_matches(tag, '(?is)\brel\s*=\s*("([^"]*\s)?canonical(\s[^"]*)?"|''([^'']*\s)?canonical(\s[^'']*)?''|canonical([\s/>]|$))')
    UNION ALL
    SELECT url, regexp_extract(tag, '(?is)\bcontent\s*=\s*["'']?[^"''>]*?\burl\s*=\s*["'']?([^"''\s>]+)', 1)
    FROM metas WHERE regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b')
),
decoded AS (
    SELECT url, replace(replace(replace(replace(replace(replace(replace(replace(replace(target, '&quot;', '"'), '&#34;', '"'), '&apos;', chr(39)), '&#39;', chr(39)),
        '&lt;', '<'), '&gt;', '>'), '&#47;', '/'), '&#38;', '&'), '&amp;', '&') AS target,
        regexp_extract(url, '^(.*?)://', 1, 's') AS scheme, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path
    FROM found
),
targets AS (
    SELECT url, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
        WHEN regexp_matches(target, '^([A-Za-z][A-Za-z0-9+.-]*:|#|$)') THEN NULL
        WHEN target LIKE '//%' THEN scheme || ':' || target
        WHEN target LIKE '/%' THEN scheme || '://' || host || target
        WHEN target LIKE '?%' THEN scheme || '://' || host || path || target
        ELSE scheme || '://' || host || CASE WHEN contains(path, '/') THEN regexp_replace(path, '[^/]*$', '') ELSE '/' END || target END AS target
    FROM decoded
),
edges AS (
    SELECT {_ADDRESS.format("url")} AS a, {_ADDRESS.format("target")} AS b FROM targets WHERE target IS NOT NULL
),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
asked AS (
    SELECT DISTINCT url AS target, host, path FROM parts
    UNION SELECT a, translate(regexp_extract(a, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), regexp_extract(a, '://[^/?#]*([^?#]*)', 1) FROM both_ways
),
ruled AS (
    SELECT target, rules.host || rules.path AS rule, verdict
    FROM asked JOIN rules ON (asked.host = rules.host OR asked.host LIKE '%.' || rules.host) AND starts_with(asked.path, rules.path)
    QUALIFY row_number() OVER (PARTITION BY target ORDER BY length(rules.host || rules.path) DESC) = 1
),
decided AS (
    SELECT a, bool_or(verdict = 'allow') AS allowed
    FROM (
        SELECT reach.a, ruled.verdict FROM reach JOIN ruled ON ruled.target = reach.b
        UNION ALL
        SELECT reach.a, ruled.verdict FROM reach JOIN parts ON reach.b = {_ADDRESS.format("parts.url")} JOIN ruled ON ruled.target = parts.url
    ) GROUP BY a
)
SELECT page_id, parts.host, parts.path, rule,
    coalesce(verdict, CASE WHEN allowed THEN 'allow' WHEN NOT allowed THEN 'block' END, 'allow') AS verdict,
    CASE WHEN verdict IS NOT NULL THEN 'rule' WHEN allowed IS NOT NULL THEN 'alias' ELSE 'default' END AS via
FROM parts LEFT JOIN ruled ON ruled.target = parts.url
    LEFT JOIN decided ON contains(parts.url, '://') AND decided.a = {_ADDRESS.format("parts.url")}
"""

# CRC-32 of decimal text: `crc.steps` is the table of one byte's remainders, by their rule
_CRC = """crc AS (
    SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
        lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
)"""
_CRC_OF = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)))"""
_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_HEAD = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op12_merkle_manifest"] = f"""
WITH RECURSIVE {_CRC},
leaves AS (
    SELECT doc_id, coalesce('=' || source, '') AS key, sha256({_HEAD} || {_FIELD.format("text")}) AS leaf,
        CASE WHEN {_CRC_OF.format("doc_id")} % 5 = 0 THEN sha256({_HEAD} || {_FIELD.format(_LOWER)}) END AS other
    FROM documents, crc
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM leaves
),
tree(key, level, pos, h, n) AS (
    SELECT key, 0, pos, leaf, n FROM placed
    UNION ALL
    SELECT key, level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM tree WHERE n > 1 GROUP BY key, level, pos // 16, n
),
subroots AS (SELECT key, h, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top(level, pos, h, n) AS (
    SELECT 0, pos, h, n FROM subroots
    UNION ALL
    SELECT level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM top WHERE n > 1 GROUP BY level, pos // 16, n
),
beside AS (
    SELECT a.key, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lefts,
        coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS rights
    FROM tree a JOIN tree b ON a.key = b.key AND a.level = b.level AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY a.key, a.level, a.pos
),
top_beside AS (
    SELECT a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lefts,
        coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS rights
    FROM top a JOIN top b ON a.level = b.level AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY a.level, a.pos
),
steps AS (
    SELECT key, pos, lefts, rights, row_number() OVER (PARTITION BY key, pos ORDER BY part, level) AS step
    FROM (
        SELECT p.key, p.pos, 0 AS part, b.level, lefts, rights FROM placed p JOIN beside b ON p.key = b.key AND b.pos = p.pos >> CAST(4 * b.level AS BIGINT)
        UNION ALL
        SELECT p.key, p.pos, 1, b.level, lefts, rights FROM placed p JOIN subroots s ON p.key = s.key JOIN top_beside b ON b.pos = s.pos >> CAST(4 * b.level AS BIGINT)
    )
),
proofs AS (SELECT key, pos, string_agg(lefts || rights, '' ORDER BY step) AS proof, max(step) AS steps FROM steps GROUP BY key, pos),
folded(key, pos, step, h) AS (
    SELECT key, pos, 0, coalesce(other, leaf) FROM placed
    UNION ALL
    SELECT f.key, f.pos, f.step + 1, sha256(lefts || h || rights) FROM folded f JOIN steps s ON f.key = s.key AND f.pos = s.pos AND s.step = f.step + 1
)
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, sha256(coalesce(proof, '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM placed p JOIN subroots s ON p.key = s.key JOIN (SELECT h FROM top WHERE n = 1) r ON true
    LEFT JOIN proofs ON p.key = proofs.key AND p.pos = proofs.pos
    JOIN folded f ON p.key = f.key AND p.pos = f.pos AND f.step = coalesce(proofs.steps, 0)
"""

ORACLE["op11_prefix_trie"] = rf"""
WITH RECURSIVE {_CRC},
turns AS (
    SELECT conv_id AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text,
        md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS pos
    FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (SELECT conv, conv - conv % 20 AS base, {_CRC_OF.format("conv")} % 4 AS head FROM (SELECT DISTINCT conv FROM turns), crc),
rebuilt AS (
    SELECT c.conv, 0 AS part, pos, role, text FROM convs c JOIN turns t ON t.conv = c.base AND t.pos < c.head
    UNION ALL
    SELECT c.conv, 1, pos, role, text FROM convs c JOIN turns t ON t.conv = c.conv AND t.pos >= c.head
),
steps AS (
    SELECT conv, row_number() OVER w AS depth, string_agg(strlen(role) || ':' || strlen(text) || ':' || role || text, '') OVER w AS prefix,
        len(regexp_extract_all(text, '{_WORDS}')) AS words
    FROM rebuilt WINDOW w AS (PARTITION BY conv ORDER BY part, pos ROWS UNBOUNDED PRECEDING)
    UNION ALL
    SELECT conv, 0, '', 0 FROM convs
),
marked AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv) AS ends FROM steps),
nodes AS (
    SELECT prefix, depth, min(conv) AS conv, count(*) AS n_convs, max(words) AS words,
        sha256(coalesce(string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (ends), '')) AS ends_sha256
    FROM marked GROUP BY prefix, depth
),
placed AS (
    SELECT n.*, p.prefix AS up, q.conv AS parent
    FROM nodes n LEFT JOIN steps p ON p.conv = n.conv AND p.depth = n.depth - 1
        LEFT JOIN nodes q ON q.prefix = p.prefix AND q.depth = p.depth
),
children AS (SELECT up, depth - 1 AS depth, count(*) AS n FROM placed WHERE up IS NOT NULL GROUP BY ALL),
counted AS (SELECT placed.*, coalesce(children.n, 0) AS n_children FROM placed LEFT JOIN children ON children.up = placed.prefix AND children.depth = placed.depth),
totals AS (
    SELECT s.prefix, s.depth, count(*) FILTER (n.n_children = 0) AS n_leaves, CAST(sum((n.n_convs - 1) * n.words) AS BIGINT) AS saved_tokens
    FROM counted n JOIN steps s ON s.conv = n.conv AND s.depth <= n.depth GROUP BY s.prefix, s.depth
)
SELECT conv AS conv_id, depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM counted JOIN totals USING (prefix, depth)
"""

ORACLE["op13_substring_dedup"] = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS words FROM documents),
placed AS (SELECT doc_id, words, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM docs),
windows AS (SELECT doc_id, pos, array_to_string(words[pos : pos + 19], ' ') AS passage FROM placed WHERE pos + 19 <= len(words)),
later AS (SELECT doc_id, pos FROM windows QUALIFY row_number() OVER (PARTITION BY passage ORDER BY doc_id, pos) > 1),
gone AS (SELECT DISTINCT doc_id, pos + step AS pos FROM later, (SELECT unnest(range(20)) AS step)),
kept AS (
    SELECT doc_id, count(gone.pos) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (gone.pos IS NULL), '') AS body
    FROM placed LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""
