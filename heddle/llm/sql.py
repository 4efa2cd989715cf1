"""DuckDB SQL of those queries of this subpackage that SQL can express."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from heddle.llm.chat import END, START
from heddle.llm.warc import LEAST_REVISIT

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate({text}, '{_UPPER}', '{_LOWER}'), '{pattern}')"


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SOLID = r"[^\x20\x09-\x0D]+"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({_words("text", _ALNUM)}, []) AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words("text", _ALNUM)} AS w FROM benchmark),
win AS (SELECT item, least(10, len(w)) AS n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS x FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(p) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win), known AS (SELECT n, x, list(DISTINCT item) AS items FROM win GROUP BY 1, 2),
occ AS (SELECT d.r, p, s.n, array_to_string(w[p:p + s.n - 1], ' ') AS x FROM d, sizes s, unnest(range(1, len(w) - s.n + 2)) t(p)),
hit AS (SELECT o.r, o.p, o.n, k.items FROM occ o JOIN known k ON k.n = o.n AND k.x = o.x),
covered AS (SELECT r, count(DISTINCT q) AS n_hit FROM hit, unnest(range(p, p + n)) t(q) GROUP BY 1),
named AS (SELECT r, list_sort(list_distinct(flatten(list(items)))) AS items FROM hit GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({_words("text", _SOLID)}, []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS x FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 75 * (x.n + y.n - inter)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, link.b FROM r JOIN link ON link.a = r.reach)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages), k AS (SELECT h, max(page_id) AS kept, count(*) AS times FROM p WHERE n >= {LEAST_REVISIT} GROUP BY 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN times > 1 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN times > 1 AND page_id <> kept THEN kept END AS refers_to FROM p LEFT JOIN k USING (h)
"""

_ESCAPED = r"replace(replace({c}, '\', '\\'), '<|', '<\|')"

CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{END}{START}assistant ok' UNION ALL SELECT -1, 1, 'assistant', '{END}{START}assistant ok'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said, coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum({len(START) + len(END) + 2} + length(replace({_ESCAPED.format(c="role")}, chr(10), '\\n')) + length({_ESCAPED.format(c="text")})) AS formatted FROM c GROUP BY 1)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted AS BIGINT) AS formatted_chars FROM g
"""


def mix_sql(levels: Sequence[str], weights: Mapping[str, Mapping[str, float]], domain: str, budget_share: float, max_epochs: int, seed: int) -> str:
    """Budgets by levels, whole epochs, and the prefix of the last one by one running sum."""
    steps = [
        f"rows AS (SELECT doc_id, {domain} AS domain, lang, source, CAST(ceil(coalesce(octet_length(encode(text)), 0) / 4.0) AS BIGINT) AS tokens FROM documents)",
        f"tree AS (SELECT {', '.join(levels)}, CAST(sum(tokens) AS BIGINT) AS supply FROM rows WHERE tokens > 0 GROUP BY ALL)",
        f"b0 AS (SELECT *, CAST(floor(sum(supply) OVER () * {budget_share}) AS BIGINT) AS budget FROM tree)",
    ]
    for d, level in enumerate(levels):
        keys, parent = ", ".join(levels[: d + 1]), ", ".join(levels[:d]) or "1"
        w = f"CASE {level} " + " ".join(f"WHEN '{n}' THEN {v}" for n, v in weights.get(level, {}).items()) + " ELSE 1.0 END"
        steps += [
            f"k{d} AS (SELECT {keys}, CAST(sum(supply) AS BIGINT) * {max_epochs} AS cap, min(budget) AS budget, CAST({w} AS DOUBLE) AS w FROM b{d} GROUP BY {keys})",
            f"f{d} AS (SELECT *, (budget - coalesce(sum(cap) OVER p, 0)) / greatest(sum(w) OVER (PARTITION BY {parent}) - coalesce(sum(w) OVER p, 0), 1e-300) AS rate FROM k{d} WINDOW p AS (PARTITION BY {parent} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
            f"s{d} AS (SELECT *, greatest(0, least(cap, CASE WHEN cap / w <= rate THEN cap ELSE floor(w * max(CASE WHEN cap / w > rate THEN rate END) OVER (PARTITION BY {parent}) + 1e-6) END)) AS own FROM f{d})",
            f"b{d + 1} AS (SELECT t.* EXCLUDE (budget), CAST(s.own AS BIGINT) AS budget FROM b{d} t JOIN s{d} s USING ({keys}))",
        ]
    last = f"b{len(levels)}"
    return f"""
WITH {", ".join(steps)},
leaf AS (SELECT r.*, budget // supply AS whole, budget % supply AS rest FROM rows r JOIN {last} USING ({", ".join(levels)}) WHERE tokens > 0),
run AS (SELECT *, sum(tokens) OVER (PARTITION BY {", ".join(levels)} ORDER BY md5('{seed}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null'))[1:15], tokens ROWS UNBOUNDED PRECEDING) AS upto FROM leaf)
SELECT doc_id, {", ".join(levels)}, tokens, CAST(whole AS INTEGER) AS epoch FROM run WHERE upto <= rest UNION ALL SELECT doc_id, {", ".join(levels)}, tokens, CAST(e AS INTEGER) FROM leaf, unnest(range(whole)) t(e)
"""


def shards_sql(n: int, blocks: int = 256) -> str:
    """Rendezvous hashing with equal weights (the largest hash wins), and the CRC-32 of the
    UTF-8 bytes by its polynomial."""
    table = "list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    best = lambda m: f"list_max(list_transform(range({m}), lambda s: [('0x' || md5(concat(k, ':', s))[1:15])::BIGINT, -s]))"
    return f"""
WITH t AS (SELECT {table} AS tab), d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, k, length(h) // 2 + 16 AS size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)),
  lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))) AS crc FROM d, t),
s AS (SELECT *, CAST(-({best(n)})[2] AS INTEGER) AS shard, CAST(-({best(n + 1)})[2] AS INTEGER) AS grown, ('0x' || md5(concat(k, ':', crc, ':', size))[1:15])::BIGINT % {blocks} AS block FROM c)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY block, doc_id, crc, size) - 1 AS slot, grown AS grown_shard FROM s
"""


def secrets_sql() -> str:
    """Spans of each kind: matches and the pieces between them give positions; a further pattern
    picks those that count."""
    letters = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    head = "(?:" + "|".join(letters(w) for w in ("password", "passwd", "secret", "token")) + f"|{letters('api')}_?{letters('key')})"
    gap = r"""["'']?\x20*[:=]\x20*["'']?"""
    value = "[A-Za-z0-9+/_.=-]"
    kinds = [
        ("assign", f"{head}{gap}{value}+", f"{head}{gap}{value}{{8,}}"),
        ("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{12,}"),
        ("hex", "[0-9a-f]+", "[0-9a-f]{32,}"),
        ("pem", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", ""),
        ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", ""),
    ]
    cut = ", ".join(f"regexp_extract_all(t, '{p}') AS m{i}, regexp_split_to_array(t, '{p}') AS s{i}" for i, (_, p, _) in enumerate(kinds))
    spans = " UNION ALL ".join(
        f"""SELECT r, {i} AS k, '{name}' AS kind, list_sum(list_transform(s{i}[1:p], lambda x: length(x))) + coalesce(list_sum(list_transform(m{i}[1:p - 1], lambda x: length(x))), 0) AS b, length(m{i}[p]) AS n
        FROM d, unnest(range(1, len(m{i}) + 1)) t(p) WHERE {f"regexp_full_match(m{i}[p], '{fine}')" if fine else "true"}"""
        for i, (name, _, fine) in enumerate(kinds)
    )
    listed = lambda w: f"coalesce(string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(b + n AS BIGINT), ',' ORDER BY b, k) FILTER ({w}), '')"
    return f"""
WITH d AS (SELECT r, doc_id, {cut} FROM (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents)),
x AS ({spans}),
g AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, {listed("k < 3")} AS base, {listed("true")} AS spans FROM x GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)
"""


SECRETS = secrets_sql()

FILTER_AUDIT = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), fails AS (
  SELECT d.doc_id, part,
    CASE WHEN len(w) < 50 THEN ['A'] ELSE [] END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN ['B'] ELSE [] END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN ['C'] ELSE [] END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN ['D'] ELSE [] END
    || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY text) THEN ['E'] ELSE [] END AS f,
    coalesce(g.good, 0) AS good, coalesce(g.toxic, 0) AS toxic
  FROM docs d LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id) g ON g.doc_id = d.doc_id
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), orders AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), cells AS (
  SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, f
), steps AS (SELECT o, array_to_string(o, '') AS filter_order, k AS step, o[k] AS x, o[:k - 1] AS earlier FROM orders, range(1, 6) r(k)), counts AS (
  SELECT part, filter_order, step, x,
    sum(n) FILTER (NOT list_contains(f, x) AND NOT list_has_any(f, earlier)) AS kept,
    sum(n) FILTER (list_contains(f, x) AND NOT list_has_any(f, earlier)) AS removed,
    sum(n) FILTER (list_contains(f, x) AND list_has_any(f, earlier)) AS redundant,
    sum(n) FILTER (f = [x]) AS unique_fails,
    sum(good) FILTER (list_contains(f, x) AND NOT list_has_any(f, earlier)) AS good_lost,
    sum(toxic) FILTER (list_contains(f, x) AND NOT list_has_any(f, earlier)) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, x
)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, x), 0)::BIGINT AS shapley
FROM counts
"""

LINE_RULES = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SOLID}') AS w FROM documents
), windows AS (
  SELECT r, p, array_to_string(w[p:p + 7], ' ') AS x FROM docs, unnest(range(1, len(w) - 6)) t(p)
), repeated AS (
  SELECT r, count(DISTINCT q) AS n FROM (SELECT r, p, count(*) OVER (PARTITION BY r, x) AS times FROM windows), unnest(range(p, p + 8)) t(q) WHERE times > 1 GROUP BY r
), lines AS (
  SELECT r, doc_id, host, line, {_words("line", _SOLID)} AS w FROM docs, unnest(string_split(text, chr(10))) t(line) WHERE regexp_matches(line, '{_SOLID}')
), same AS (SELECT r, sum(n - 1) AS n FROM (SELECT r, line, count(*) AS n FROM lines GROUP BY r, line) GROUP BY r
), hosts AS (SELECT host, count(DISTINCT doc_id) AS n FROM docs GROUP BY host
), frequent AS (
  SELECT host, x FROM (SELECT host, array_to_string(w, ' ') AS x, count(DISTINCT doc_id) AS n FROM lines GROUP BY 1, 2) l JOIN hosts h USING (host) WHERE l.n > 20 AND 100 * l.n > h.n
), removed AS (SELECT r, sum(len(w)) AS n FROM lines l JOIN frequent f ON f.host = l.host AND f.x = array_to_string(w, ' ') GROUP BY r
), counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(s.n, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words, coalesce(g.n, 0)::BIGINT AS n_removed
  FROM docs LEFT JOIN same s USING (r) LEFT JOIN repeated p USING (r) LEFT JOIN removed g USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_removed >= 20 AND 100 * (n_words - n_removed) >= 30 * n_words AS kept
FROM counts
"""
