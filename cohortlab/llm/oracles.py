"""SQL for the queries that it can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

_KNOTS = "[[0.0, 1.5, 0.5, 1.0, 1.0, 0.5], [0.0, 1.0, 0.5, 1.0, 1.0, 1.0], [0.0, 0.5, 0.5, 1.0, 1.0, 1.5]]"

# A source is capped if it would get more than three times its words although all that reach the cap earlier do.
# Both halves of each schedule have a time of 0.5 and the weights of _KNOTS, whose integral is 1.
SQL["op1_mix_sources"] = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS size,
    ('0x' || substr(md5('mix' || coalesce(doc_id::varchar, '')), 1, 15))::bigint AS key
  FROM documents
), sources AS (
  SELECT source, sum(size)::bigint AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, rank % 3 + 1 AS w, (rank % 3)::int AS schedule, sum(s) OVER () AS total FROM sources
), tried AS (
  SELECT *, (total - coalesce(sum(3 * s) OVER before, 0))::double / (sum(w) OVER rest)::double AS level
  FROM weighed
  WINDOW before AS (ORDER BY 3 * s / w::double, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (ORDER BY 3 * s / w::double, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), capped AS (
  SELECT *, (3 * s)::double <= level * w AS is_capped FROM tried
), level AS (
  SELECT (any_value(total) - coalesce(sum(3 * s) FILTER (is_capped), 0))::double
    / (sum(w) FILTER (NOT is_capped))::double AS level FROM capped
), targets AS (
  SELECT source, s, schedule, CASE WHEN is_capped THEN (3 * s)::double ELSE level.level * w END AS target
  FROM capped, level
), rounds AS (
  SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END::int AS rounds FROM targets
), placed AS (
  SELECT d.doc_id, d.size, r.s, r.target, r.schedule, r.rounds,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized d JOIN rounds r ON d.source IS NOT DISTINCT FROM r.source
), taken AS (
  SELECT *, rounds + CASE WHEN start + size / 2.0::double <= target - rounds * s AND rounds < 3 THEN 1 ELSE 0 END AS copies,
    coalesce((start + size / 2.0::double) / nullif(target, 0), 0) AS share
  FROM placed
), timed AS (
  SELECT *, {_KNOTS}[schedule + 1] AS k FROM taken
), halves AS (
  SELECT *, 0.25::double * (k[2] + k[4]) AS first_half, k[2]::double AS w0, k[4]::double AS w1, k[6]::double AS w2 FROM timed
)
SELECT doc_id, size, s::bigint AS source_size, target, (copies * size)::bigint AS taken, copies::int AS copies,
  CASE WHEN copies > 0 THEN round(CASE WHEN share <= first_half
    THEN least(2 * greatest(share, 0) / (w0 + sqrt(greatest(w0 * w0 + 4 * (w1 - w0) * greatest(share, 0), 0))), 0.5)
    ELSE least(0.5 + coalesce(2 * (share - first_half)
      / nullif(w1 + sqrt(greatest(w1 * w1 + 4 * (w2 - w1) * (share - first_half), 0)), 0), 0), 1) END, 6) END AS position
FROM halves
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _host(url: str) -> str:
    return f"coalesce(translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '')"


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def _key(url: str) -> str:
    query = f"regexp_extract({url}, '(?s)^.*?://[^?#]*\\?([^#]*)', 1)"
    query = f"regexp_replace({query}, '(?:^|&)(?:utm_[a-z]+|ref|gclid|fbclid)=[^&]*', '', 'g')"
    query = f"regexp_replace({query}, '^&', '')"
    place = f"regexp_replace({_host(url)}, '^(?:www|m)\\.', '') || regexp_replace({_path(url)}, '/$', '')"
    return (f"CASE WHEN {_host(url)} <> '' THEN {place} "
            f"|| CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END END")


def _absolute(target: str) -> str:
    site = f"'http://' || {_host('url')}"
    folder = f"coalesce(nullif(regexp_extract({_path('url')}, '(?s)^(.*/)', 1), ''), '/')"
    return (f"CASE WHEN {target} = '' THEN NULL WHEN contains({target}, '://') THEN {target} "
            f"WHEN starts_with({target}, '//') THEN 'http:' || {target} "
            f"WHEN starts_with({target}, '/') THEN {site} || {target} ELSE {site} || {folder} || {target} END")


_NAMED = ("replace(regexp_extract(regexp_extract(html, "
          "'(?is)<link\\b[^<>]*?\\brel\\s*=\\s*[\"'']?canonical\\b[^<>]*>', 0), "
          "'(?is)\\bhref\\s*=\\s*[\"'']?([^\"''\\s<>]+)', 1), '&amp;', '&')")
_LED = ("replace(regexp_extract(regexp_extract(html, "
        "'(?is)<meta\\b[^<>]*?\\bhttp-equiv\\s*=\\s*[\"'']?refresh\\b[^<>]*>', 0), "
        "'(?is)\\burl\\s*=\\s*[\"'']?([^\"''\\s<>]+)', 1), '&amp;', '&')")


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


# The rules of the query, longest first.
_RULES = (
    ("allow", "www.example.com", "/en/"), ("block", "example.com", "/en/"), ("block", "net", "/es/"),
    ("block", "net", "/fr/"), ("allow", "com", "/"),
)
_RULE = "CASE " + " ".join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for _, h, p in _RULES) + " END"
_RULED = "CASE " + " ".join(f"WHEN {_fits(h, p)} THEN '{v}'" for v, h, p in _RULES) + " END"

SQL["op6_url_filter"] = f"""
WITH RECURSIVE parsed AS (
  SELECT page_id, {_host('url')} AS host, {_path('url')} AS path, {_key('url')} AS key,
    {_absolute(_NAMED)} AS named, {_absolute(_LED)} AS led
  FROM pages
), judged AS (
  SELECT *, {_RULE} AS rule, {_RULED} AS ruled FROM parsed
), links AS (
  SELECT key AS a, {_key('named')} AS b FROM judged WHERE named IS NOT NULL
  UNION SELECT key, {_key('led')} FROM judged WHERE led IS NOT NULL
), edges AS (
  SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b
), reach(a, b) AS (
  SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
), least AS (
  SELECT a, least(a, min(b)) AS label FROM reach GROUP BY a
), classed AS (
  SELECT j.*, coalesce(l.label, j.key) AS class FROM judged j LEFT JOIN least l ON j.key = l.a
), said AS (
  SELECT class, bool_or(ruled = 'block') AS blocked, bool_or(ruled = 'allow') AS allowed
  FROM classed WHERE ruled IS NOT NULL GROUP BY class
)
SELECT page_id, host, path, rule,
  coalesce(ruled, CASE WHEN blocked AND NOT allowed THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN ruled IS NOT NULL THEN 'rule' WHEN blocked IS NOT NULL THEN 'alias' ELSE 'default' END AS decided_by
FROM classed LEFT JOIN said USING (class)
"""

# Checksums of bytes: the table of the reflected polynomial, and the steps over the bytes of a text.
_TABLE = """(SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
    ORDER BY i) FROM (SELECT unnest(range(256)) AS i))"""


def _crc32(text: str, table: str) -> str:
    byte = f"('0x' || substr(hex(encode({text})), (2 * i + 1)::int, 2))::bigint"
    places = f"range(octet_length(encode({text})))"
    step = f"xor(c >> 8, {table}[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce([4294967295::bigint] || [{byte} FOR i IN {places}], lambda c, b: {step}), 4294967295)"


SQL["op11_prefix_trie"] = f"""
WITH crc AS (SELECT {_TABLE} AS t), turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS source, {_crc32('conv_id::varchar', 't')} % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc
), rebuilt AS (
  SELECT c.conv_id, 0 AS side, t.i, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.source AND t.i <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.i, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i > c.h
), placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY side, i) AS pos, text, md5(len(role) || ':' || role || text) AS k
  FROM rebuilt
), prefixes AS (
  SELECT conv_id, pos, octet_length(encode(text)) AS bytes, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY pos) AS p
  FROM placed
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), ends AS (
  SELECT p, sha256(string_agg(conv_id::varchar, ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, arg_max(p, pos) AS p FROM prefixes GROUP BY conv_id) GROUP BY p
), nodes AS (
  SELECT p, any_value(pos) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes
  FROM prefixes GROUP BY p
), children AS (
  SELECT left(p, -32) AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), counted AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (p)
), below AS (
  SELECT a.p, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.bytes) AS saved_tokens
  FROM prefixes a JOIN counted b ON a.conv_id = b.conv_id AND b.depth >= a.pos GROUP BY a.p
)
SELECT n.conv_id, n.depth::bigint AS depth, parent.conv_id AS parent_conv_id, n.n_convs::bigint AS n_convs,
  n.n_children::bigint AS n_children, n_leaves::bigint AS n_leaves, saved_tokens::bigint AS saved_tokens,
  coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM counted n JOIN below USING (p) LEFT JOIN ends USING (p)
LEFT JOIN nodes parent ON n.depth > 0 AND parent.p = left(n.p, -32)
"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL["op12_target_resampling"] = f"""
WITH crc AS (SELECT {_TABLE} AS t), listed AS (
  SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS words FROM documents
), raw AS (
  SELECT row, unnest(words) AS word FROM listed
), aim AS (
  SELECT unnest({_WORDS}) AS word FROM benchmark
), buckets AS (
  SELECT word, {_crc32('word', 't')} % 10000 AS bucket FROM (SELECT word FROM raw UNION SELECT word FROM aim), crc
), counted AS (
  SELECT bucket, sum(s)::bigint AS s, sum(t)::bigint AS t FROM (
    SELECT word, count(*) AS s, 0 AS t FROM raw GROUP BY word UNION ALL SELECT word, 0, count(*) FROM aim GROUP BY word
  ) JOIN buckets USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::double * (sum(s) OVER () + 10000)::double)
    / ((s + 1)::double * (sum(t) OVER () + 10000)::double)))::bigint AS gain FROM counted
), weighed AS (
  SELECT row, sum(gain)::bigint AS weight FROM raw JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY row
), scored AS (
  SELECT doc_id, len(words)::bigint AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
    (('0x' || left(sha256('2024:' || coalesce(doc_id::varchar, '')), 8))::bigint + 0.5::double) / 4294967296)))::bigint AS score
  FROM listed LEFT JOIN weighed USING (row)
), placed AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM placed
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_features < 20
"""
