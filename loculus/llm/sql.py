"""DuckDB SQL for those queries of the corpus operators that SQL can express, over the same tables."""

from __future__ import annotations

import re
from html.entities import html5

from . import quality, queries, urlfilter, warc

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _uuid(expr: str) -> str:
    h = f"md5({expr})"
    return f"concat('<urn:uuid:', concat_ws('-', {', '.join(f'substr({h}, {a}, {n})' for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))}), '>')"


def _entities(t: str) -> str:
    """References that end with a semicolon, each replaced in turn, the ampersand last; a reference made by another one is not
    told apart, so the SQL is exact only for texts without those."""
    numeric = r"list_transform(list_distinct(regexp_extract_all(t, '&#([0-9]{1,6});', 1)), lambda n: concat('&#', n, ';', chr(1), chr(n::INT)))"
    names = sorted((k, v) for k, v in html5.items() if k.endswith(";") and k.lower() != "amp;" and "'" not in v)
    pairs = ", ".join(_q(f"&{k}\x01{v}") for k, v in names)
    step = "lambda a, x: replace(a, split_part(x, chr(1), 1), split_part(x, chr(1), 2))"
    decoded = f"(SELECT replace(replace(list_reduce(list_concat([t], list_filter([{pairs}], lambda x: contains(t, split_part(x, chr(1), 1))), {numeric}, ['&apos;' || chr(1) || chr(39)]), {step}), '&AMP;', '&'), '&amp;', '&') FROM (SELECT {t} AS t))"
    return decoded


def op1() -> str:
    t = r"regexp_replace(payload, '(?s)<!--.*?-->', '', 'g')"
    for tag in warc.DROPPED:
        t = rf"regexp_replace({t}, '(?is)<{tag}[\s>].*?</{tag}\s*>', ' ', 'g')"
    t = rf"regexp_replace({t}, '(?i)</?(?:{warc.BREAKS})(?:[\s/][^>]*)?>', chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^>]*>', '', 'g')"
    t = f"replace({_entities(t)}, chr(160), ' ')"
    t = rf"regexp_replace({t}, '[ \t\r\f]+', ' ', 'g')"
    t = rf"regexp_replace(regexp_replace({t}, ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"
    return rf"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload, {_uuid("concat_ws('|', coalesce(page_id::VARCHAR, ''), coalesce(url, ''), 'response', concat('sha256:', sha256(coalesce(html, ''))))")} AS rid FROM pages),
s AS (SELECT *, concat('HTTP/1.1 200 OK', chr(13), chr(10), 'Content-Type: text/html; charset=utf-8', chr(13), chr(10), 'Content-Length: ', strlen(payload)) AS head, concat('sha256:', sha256(payload)) AS pd FROM p),
m AS (
  SELECT *, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
    concat('http-status: 200', chr(13), chr(10), 'http-content-type: text/html', chr(13), chr(10), 'source-block-digest: sha256:', sha256(concat(head, chr(13), chr(10), chr(13), chr(10), payload)),
      chr(13), chr(10), 'source-payload-digest: ', pd, chr(13), chr(10), 'source-payload-length: ', strlen(payload), chr(13), chr(10)) AS body FROM s
  UNION ALL
  SELECT *, 'conversion', 'text/plain', {t} FROM s)
SELECT rid AS refers_to, warc_type, {_uuid("concat_ws('|', rid, coalesce(url, ''), warc_type)")} AS record_id, url AS target_uri, '2024-01-01T00:00:00Z' AS warc_date, content_type,
  strlen(body)::BIGINT AS content_length, concat('sha256:', sha256(body)) AS block_digest, pd AS payload_digest, rid AS source_id, strlen(head)::BIGINT AS http_header_bytes
FROM m"""


def op2() -> str:
    words = WORDS.replace("coalesce(text, '')", LOWER.format("coalesce(text, '')"))
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, {words} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * x >= 85 * (p.n + q.n - x)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, seen) AS (SELECT doc_id, doc_id FROM w UNION SELECT b, seen FROM reach JOIN both_ways ON a = id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(seen) AS component_id, w.doc_id = min(seen) AS kept
FROM w JOIN reach ON reach.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id, n.n"""


def _glob(g: str) -> str:
    out, i = "", 0
    while i < len(g):
        if g[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(g[i], re.escape(g[i])), i + 1
    return f"(?s){out}"


def op3() -> str:
    fits = lambda r: f"(host = {_q(r.host)} OR ends_with(host, {_q('.' + r.host)})) AND starts_with(path, {_q(r.path)})"
    rules = sorted(queries.RULES, key=lambda r: -len(r.name))
    rule = " ".join(f"WHEN {fits(r)} THEN {_q(r.name)}" for r in rules)
    verdict = " ".join(f"WHEN rule = {_q(r.name)} THEN {_q(r.verdict)}" for r in rules)
    pattern = " ".join(f"WHEN regexp_full_match(s, {_q(_glob(g.lower()))}) THEN {_q(g)}" for g in queries.BLOCKED)
    low = lambda x: LOWER.format(x)
    free = lambda t: f"contains({_q(urlfilter.UNRESERVED)}, chr(('0x' || {t}[2:3])::INT))"
    undone = lambda c: low(rf"array_to_string(list_transform(regexp_extract_all({c}, '(?s)%[0-9A-Fa-f]{{2}}|[^%]+|%'), lambda t: CASE WHEN regexp_full_match(t, '%[0-9A-Fa-f]{{2}}') THEN CASE WHEN {free('t')} THEN chr(('0x' || t[2:3])::INT) ELSE t END ELSE t END), '')")
    port = " ".join(f"WHEN {_q(k)} THEN regexp_replace(h, '(?s):({v})?$', '')" for k, v in urlfilter.PORTS.items())
    segments = "list_reduce(string_split(p, '/'), lambda acc, x: CASE WHEN x IN ('', '.') THEN acc WHEN x = '..' THEN acc[1:len(acc) - 1] ELSE list_append(acc, x) END, []::VARCHAR[])"
    host = LOWER.format(r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")
    return rf"""
WITH u AS (SELECT page_id, {host} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, {low("coalesce(regexp_extract(url, '(?s)^(.*?)://', 1), '')")} AS scheme FROM pages),
e AS (SELECT *, regexp_replace({undone("host")}, '(?s)^.*@', '') AS h, {undone("path")} AS p FROM u),
n AS (SELECT *, regexp_replace(CASE scheme {port} ELSE regexp_replace(h, '(?s):$', '') END, '(?s)\.$', '') AS hc, CASE WHEN contains(p, '//') OR contains(p, '/.') THEN {segments} END AS kept FROM e),
r AS (SELECT *, CASE WHEN host = '' AND path = '' THEN '' ELSE '.' || hc || CASE WHEN kept IS NOT NULL THEN '/' || array_to_string(kept, '/') || CASE WHEN len(kept) > 0 AND regexp_matches(p, '(?s)(/|/\.|/\.\.)$') THEN '/' ELSE '' END WHEN p = '' THEN '/' ELSE p END END AS s, CASE {rule} END AS rule FROM n),
p AS (SELECT *, CASE {pattern} END AS pattern FROM r)
SELECT page_id, host, path, rule, CASE {verdict} WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern FROM p"""


def op4() -> str:
    said = " OR ".join(f"contains(lower(l), {_q(b)})" for b in quality.BOILERPLATE)
    fails = rf"""(NOT regexp_matches(l, '[\p{{L}}\p{{N}}]') OR ((length(l) - length(translate(l, '|›»•', ''))) >= 3 AND (length(l) - length(translate(l, '|›»•', ''))) * 40 >= length(l))
      OR (length(l) - length(translate(l, '{quality.SYMBOLS}', ''))) * 10 > length(l) OR {said} OR (length(l) > 400 AND NOT regexp_matches(l, '[.!?;:…。！？]')))"""
    words = lambda c: rf"len(list_filter(string_split_regex({c}, '[\x20\x09-\x0D]+'), lambda w: w <> ''))"
    chars = lambda c: rf"length(regexp_replace({c}, '[\x20\x09-\x0D]+', '', 'g'))"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
twice AS (SELECT doc_id, s FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win JOIN twice USING (doc_id, s), range(8) AS o(k) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, {chars("t")} AS word_chars, length(t) - length(translate(t, '{quality.SYMBOLS}', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines, list_filter(ls, lambda l: NOT {fails}) AS good FROM d LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, coalesce(array_to_string(good, chr(10)), '') AS clean FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND {chars("clean")} >= 0.5 * word_chars AND {words("clean")} >= 5 AS kept, n_lines::BIGINT AS n_lines, len(good)::BIGINT AS n_lines_kept FROM f"""


def op5() -> str:
    return rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
twice AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT i + k) AS g FROM win JOIN twice USING (s), range(35) AS o(k) GROUP BY doc_id),
k AS (SELECT doc_id, w, list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(coalesce(g, []), i)), lambda i: w[i]) AS kept FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(kept))::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k"""


def op6() -> str:
    sql = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(role || chr(0) || text ORDER BY place) AS s FROM t GROUP BY conv_id),
one AS (SELECT min(conv_id) AS conv_id, s FROM c GROUP BY s),
best AS (SELECT conv_id, len(s) AS n FROM one WHERE NOT EXISTS (SELECT 1 FROM c AS o WHERE len(o.s) > len(one.s) AND o.s[1 : len(one.s)] = one.s))
SELECT conv_id, ((place - 1) // 256)::BIGINT AS chunk, n::BIGINT AS n_turns, min(place)::BIGINT AS first_turn, count(*)::BIGINT AS chunk_turns,
  string_agg('<|im_start|>' || harmless(role) || chr(10) || harmless(text) || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
FROM t JOIN best USING (conv_id) GROUP BY conv_id, chunk, n"""
    return re.sub(r"harmless\((\w+)\)", r"regexp_replace(\1, '<\\|(im_start|im_end)\\|>', '<| \\\\1 |>', 'g')", sql)


def op7() -> str:
    """The exact rule: every window of an item's size that holds a shingle of it, weighted shingle sets, the best of each pair."""
    words = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
    return rf"""
WITH iw AS (SELECT row_number() OVER () AS item, item_id, w, least(5, len(w)) AS k FROM (SELECT DISTINCT item_id, {words} AS w FROM benchmark) WHERE len(w) >= 4),
il AS (SELECT item, item_id, k, len(w) - k + 1 AS n FROM iw),
ig AS (SELECT item, k, n, g, count(*) AS c FROM (SELECT item, k, len(w) - k + 1 AS n, array_to_string(w[i : i + k - 1], ' ') AS g FROM iw, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)) GROUP BY ALL),
dw AS (SELECT DISTINCT doc_id, md5(coalesce(text, '')) AS mark, {words} AS w FROM documents),
dl AS (SELECT row_number() OVER () AS row, doc_id, mark, w FROM dw),
dg AS (SELECT row, k, i - 1 AS pos, len(w) - k + 1 AS size, array_to_string(w[i : i + k - 1], ' ') AS g FROM dl, (SELECT DISTINCT k FROM iw), LATERAL (SELECT unnest(range(1, greatest(len(w) - k + 2, 1))) AS i)),
hit AS (SELECT row, item, n, size, pos, g, c FROM dg JOIN ig USING (k, g)),
cand AS (SELECT row, item FROM hit GROUP BY row, item HAVING count(*) * 100 >= any_value(n) * 80),
near AS (SELECT hit.* FROM hit SEMI JOIN cand USING (row, item)),
st AS (SELECT DISTINCT row, item, n, size, s FROM near, LATERAL (SELECT unnest(range(greatest(0, pos - n + 1), pos + 1)) AS s) WHERE s <= greatest(0, size - n)),
win AS (SELECT st.row, st.item, st.s, st.n, least(st.n, st.size) AS held, near.g, least(count(*), any_value(c)) AS m FROM st JOIN near ON near.row = st.row AND near.item = st.item AND near.pos >= st.s AND near.pos < st.s + st.n GROUP BY ALL),
sc AS (SELECT row, item, s, sum(m) AS shared, any_value(held) + any_value(n) - sum(m) AS total FROM win GROUP BY row, item, s HAVING sum(m) * 100 >= (any_value(held) + any_value(n) - sum(m)) * 80)
SELECT doc_id, mark, item_id, first(s ORDER BY shared / total DESC, s)::BIGINT AS start_word, first(shared ORDER BY shared / total DESC, s)::BIGINT AS shared, first(total ORDER BY shared / total DESC, s)::BIGINT AS total,
  max(shared / total) AS similarity FROM sc JOIN dl USING (row) JOIN il USING (item) GROUP BY doc_id, mark, item_id"""


def op11() -> str:
    """All rows against all anchors."""
    return """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS s FROM r a JOIN r b ON a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same AND other <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, other) <= 5)
SELECT p.anchor_id, p.other AS positive_id, row_number() OVER w::INT AS rank, n.other AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s
WINDOW w AS (PARTITION BY p.anchor_id, p.other ORDER BY n.s DESC, n.other) QUALIFY row_number() OVER w <= 10"""


def op13() -> str:
    """The cheapest edits row by row: for each state the least of cost and audit in one string, then the edits played again."""
    blank = r"[\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
src AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
cd AS (SELECT src.*, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(s) + 1), lambda i: ascii(s[i])::BIGINT)), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 20 AS code FROM src, tab),
dm AS (SELECT c, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM cd, LATERAL (SELECT unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END))) WHERE code <> 0),
nm AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i, role[1] AS first, regexp_extract(text, '([^ 	-
]){blank}*$', 1) AS tail FROM dm),
ft AS MATERIALIZED (SELECT *, CASE WHEN tail = '' THEN 0 WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 1 WHEN tail NOT IN ('.', '!', '?') THEN 2 ELSE -1 END AS f FROM nm),
conv AS MATERIALIZED (SELECT c, any_value(conv_id) AS conv_id, (SELECT count(*) FROM ft WHERE ft.c = src.c) AS n FROM src GROUP BY c),
ins(st, j, mid) AS (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (3, 0, 3), (3, 1, 2)),
nx(st, st2, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
op(mid, letter, first, st2, price) AS (SELECT st, 'D', NULL::VARCHAR, st, 2 FROM nx UNION ALL SELECT st, 'R', NULL::VARCHAR, st2, 1 FROM nx UNION ALL VALUES (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0)),
dp AS (
  SELECT c, 0::BIGINT AS i, 0 AS st, '000000000' AS key FROM conv
  UNION ALL
  SELECT dp.c, dp.i + 1, op.st2, min(lpad((left(key, 9)::INT + 5 * j + price + CASE WHEN letter <> 'D' AND f = 2 THEN 5 ELSE 0 END)::VARCHAR, 9, '0') || substr(key, 10) || repeat('I', j) || letter)
  FROM dp JOIN ft ON ft.c = dp.c AND ft.i = dp.i + 1 JOIN ins ON ins.st = dp.st JOIN op ON op.mid = ins.mid AND (op.first IS NULL OR op.first = ft.first) AND (letter = 'D' OR f NOT IN (0, 1))
  GROUP BY dp.c, dp.i, op.st2),
best AS MATERIALIZED (SELECT c, min(lpad((left(key, 9)::INT + 5 * t.j)::VARCHAR, 9, '0') || substr(key, 10) || repeat('I', t.j)) AS key FROM dp JOIN conv USING (c) JOIN (VALUES (0, 0), (3, 0), (2, 1), (1, 2)) t(st, j) ON t.st = dp.st WHERE dp.i = n GROUP BY c),
play AS (
  SELECT c, 0 AS p, 0::BIGINT AS i, 0 AS st, ''::VARCHAR AS said, FALSE AS begun FROM best
  UNION ALL
  SELECT c, p + 1, CASE WHEN l = 'I' THEN i ELSE i + 1 END, CASE WHEN l = 'D' THEN st WHEN l = 'K' THEN CASE first WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE made END,
    CASE WHEN l = 'D' THEN said ELSE said || CASE WHEN begun THEN chr(10) ELSE '' END || CASE WHEN l = 'K' THEN role ELSE maker END || ':' || CASE WHEN l = 'I' THEN '' ELSE text END END, begun OR l <> 'D'
  FROM (SELECT play.*, substr(key, 10 + p, 1) AS l, nx.st2 AS made, nx.role AS maker, ft.role, ft.text, ft.first FROM play JOIN best USING (c) JOIN nx ON nx.st = play.st LEFT JOIN ft ON ft.c = play.c AND ft.i = play.i + 1 WHERE p < len(key) - 9)),
done AS (SELECT c, said FROM play JOIN best USING (c) WHERE p = len(key) - 9),
st AS (SELECT c, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE f = 0) AS blank, count(*) FILTER (WHERE f = 1) AS duplicate, count(*) FILTER (WHERE f = 2) AS truncated FROM ft GROUP BY c),
il AS (SELECT a.c, count(*) AS illegal FROM ft a JOIN ft b ON b.c = a.c AND b.i = a.i + 1 WHERE a.first || b.first NOT IN ('su', 'ua', 'au') GROUP BY a.c)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  left(key, 9)::BIGINT AS cost, substr(key, 10) AS audit, sha256(said) AS repaired_sha256
FROM conv JOIN best USING (c) JOIN done USING (c) LEFT JOIN st USING (c) LEFT JOIN il USING (c)"""


def oracles() -> dict[str, str]:
    return {
        "op1_warc_derivatives": op1(),
        "op2_minmax_near_dedup": op2(),
        "op3_url_globs": op3(),
        "op4_line_first_cleaning": op4(),
        "op5_superkmer_substrings": op5(),
        "op6_snapshot_collapse": op6(),
        "op7_simhash_decontamination": op7(),
        "op11_distance_key_negatives": op11(),
        "op13_conversation_repair": op13(),
    }
