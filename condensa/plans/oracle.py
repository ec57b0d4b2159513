"""The engine's queries as DuckDB SQL: the same results by other means (joins and windows, not arrays in the row)."""

from __future__ import annotations

from condensa.functions.fixed import BLOCKS, LADDER, LEVEL_WORDS, LOG_WORDS, SKIPPED, STREAM_WORDS, WHITE
from condensa.functions.stats import Z
from condensa.functions.text import query_terms
from condensa.plans.queries import BUDGET, BUDGETS, DIAGNOSTIC, HOPS, LOG_QUERY, METHODS, QUERY, SMALL, TABLE_QUERY
from condensa.sources.cases import CASE_UNITS, KINDS, TASK_UNITS, TASKS
from condensa.sources.synth import METHODS as SOLVERS

_W = "chr(32)||" + "||".join(f"chr({ord(c)})" for c in WHITE[1:])
_LINES = r"'\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]'"
_BLANKS = r"'[\s\x0B\x1C-\x1F\x{85}\p{Z}]+'"


def strip(c: str) -> str:
    return f"trim({c}, {_W})"


def tok(c: str) -> str:
    return f"CAST((length(coalesce({c}, '')) + 3) // 4 AS INTEGER)"


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, {_BLANKS}), lambda w: w <> '')"


def full_lines(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, {_LINES}), lambda s: {strip('s')} <> '')"


def windows(ws: str, size: int, step: int) -> str:
    return f"list_transform(range(0, len({ws}), {step}), lambda k: array_to_string({ws}[k + 1:k + {size}], ' '))"


def capped(c: str) -> str:
    """A list of chunks for one chunk."""
    sentences = f"list_filter(list_transform(string_split(regexp_replace({c}, '([.!?])' || {_BLANKS}, '\\1' || chr(1), 'g'), chr(1)), lambda t: {strip('t')}), lambda t: t <> '')"
    pieces = f"flatten(list_transform({sentences}, lambda t: CASE WHEN {tok('t')} <= 200 THEN [t] ELSE {windows(words('t'), 40, 40)} END))"
    return f"CASE WHEN {tok(c)} <= 200 THEN [{c}] ELSE {pieces} END"


def text_chunks(src: str = "src") -> str:
    """CTEs up to c(id, idx, chunk) from ``src(id, payload)``."""
    return f"""
    t1 AS (SELECT id, payload, list_filter(list_transform(string_split(replace(payload, chr(13)||chr(10), chr(10)), chr(10)||chr(10)), lambda s: {strip('s')}), lambda s: s <> '') AS b FROM {src}),
    t2 AS (SELECT id, CASE WHEN len(b) > 1 THEN b ELSE list_transform({full_lines('payload')}, lambda s: {strip('s')}) END AS l FROM t1),
    t3 AS (SELECT id, flatten(list_transform(l, lambda s: {capped('s')})) AS l FROM t2),
    c AS (SELECT id, unnest(l) AS chunk, generate_subscripts(l, 1) - 1 AS idx FROM t3)"""


def line_windows(size: int, step: int, src: str = "src") -> str:
    return f"""
    t1 AS (SELECT id, payload, flatten(list_transform({full_lines('payload')}, lambda s: CASE WHEN len({words('s')}) <= {size} THEN [{strip('s')}] ELSE {windows(words('s'), size, step)} END)) AS l FROM {src}),
    t3 AS (SELECT id, CASE WHEN len(l) > 0 THEN l ELSE [payload] END AS l FROM t1),
    c AS (SELECT id, unnest(l) AS chunk, generate_subscripts(l, 1) - 1 AS idx FROM t3)"""


def html_chunks(src: str = "src") -> str:
    return f"""
    t3 AS (SELECT id, list_filter(string_split({html('payload')}, chr(10)||chr(10)), lambda s: s <> '') AS l FROM {src}),
    c AS (SELECT id, unnest(l) AS chunk, generate_subscripts(l, 1) - 1 AS idx FROM t3)"""


#: Stands for the column ``question`` of ``src`` where a query is asked for.
OWN = "?"


def asked(query: str | None) -> str:
    """CTE q(id, term) for a literal query, or for each payload's own one: every payload's terms."""
    if query == OWN:
        return f"q AS (SELECT DISTINCT id, unnest({terms('question')}) AS term FROM src)"
    values = ", ".join(f"('{t}')" for t in query_terms(query or ""))
    return f"q AS (SELECT id, term FROM src, (VALUES {values}) v(term))" if values else "q AS (SELECT id, CAST(NULL AS VARCHAR) AS term FROM src WHERE false)"


_TERMS = "regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_]+')"


def terms(c: str) -> str:
    return _TERMS.format(c=c)


def scored(name: str = "s") -> str:
    """CTE s(id, idx, chunk, score) from c and q."""
    return f"""
    tk AS (SELECT id, idx, {terms('chunk')} AS t FROM c),
    st AS (SELECT id, count(*) AS n, sum(len(t)) AS total FROM tk GROUP BY id),
    tf AS (SELECT x.id, x.idx, x.term, count(*) AS f FROM (SELECT id, idx, unnest(t) AS term FROM tk) x JOIN (SELECT DISTINCT id, term FROM q) y ON x.id = y.id AND x.term = y.term GROUP BY ALL),
    dfr AS (SELECT id, term, count(*) AS df FROM tf GROUP BY ALL),
    sc AS (SELECT tf.id, tf.idx, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * greatest(len(t), 1) / (CASE WHEN total > 0 THEN total / n ELSE 1.0 END)))), 9) AS score
           FROM tf JOIN dfr USING (id, term) JOIN st USING (id) JOIN tk USING (id, idx) GROUP BY tf.id, tf.idx),
    {name} AS (SELECT c.id, c.idx, c.chunk, coalesce(score, 0.0) AS score FROM c LEFT JOIN sc USING (id, idx))"""


def fitted(budget: int, neighbour: int, p: str = "") -> str:
    """CTE f(id, body) from s; payloads without chunks are absent."""
    offsets = ", ".join(f"i - {k}, i + {k}" for k in range(1, neighbour + 1))
    near = f"""
    {p}k2 AS (SELECT k.id, n, CASE WHEN sig THEN list_reduce(list_transform(list_filter(flatten(list_transform(kept, lambda i: [{offsets}])), lambda j: j >= 0 AND j < n), lambda j: {{'u': cost[j + 1], 'k': [j]}}),
              lambda a, x: CASE WHEN list_contains(a.k, x.k[1]) OR a.u + x.u > {budget} THEN a ELSE {{'u': a.u + x.u, 'k': list_append(a.k, x.k[1])}} END, {{'u': used, 'k': kept}}).k ELSE kept END AS kept
              FROM {p}k AS k JOIN {p}m AS m USING (id)),""" if neighbour else f"{p}k2 AS (SELECT k.id, n, kept FROM {p}k AS k JOIN {p}m AS m USING (id)),"
    return f"""
    {p}m AS (SELECT id, count(*) AS n, bool_or(score > 0) AS sig, list(CAST({tok('chunk')} + 2 AS BIGINT) ORDER BY idx) AS cost FROM s GROUP BY id),
    {p}o AS (SELECT s.id, idx, {tok('chunk')} + 2 AS cost, CASE WHEN sig THEN -score WHEN 2 * idx <= n - 1 THEN 2 * idx ELSE 2 * (n - 1 - idx) + 1 END AS key FROM s JOIN {p}m AS m USING (id) WHERE NOT sig OR score > 0),
    {p}r AS (SELECT *, row_number() OVER w AS rn, CAST(sum(cost) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM {p}o WINDOW w AS (PARTITION BY id ORDER BY key, idx)),
    {p}k AS (SELECT id, list(idx ORDER BY rn) AS kept, max(cum) AS used FROM {p}r WHERE rn = 1 OR cum <= {budget} GROUP BY id),
    {near}
    {stitched(f'{p}f', f'{p}k2', 's', 'chr(10)||chr(10)', p)}"""


def stitched(name: str, kept: str, chunks: str, sep: str, p: str = "") -> str:
    return f"""
    {p}u AS (SELECT id, n, unnest(kept) AS idx FROM {kept}),
    {p}g AS (SELECT u.id, n, u.idx, chunk, lag(u.idx) OVER (PARTITION BY u.id ORDER BY u.idx) AS before FROM {p}u AS u JOIN {chunks} AS ch ON u.id = ch.id AND u.idx = ch.idx),
    {name} AS (SELECT id, string_agg(CASE WHEN idx - before > 1 THEN '[…]' || {sep} ELSE '' END || chunk, {sep} ORDER BY idx) || CASE WHEN max(idx) < max(n) - 1 THEN {sep} || '[…]' ELSE '' END AS body FROM {p}g GROUP BY id)"""


DOCS = "src AS (SELECT doc_id AS id, text AS payload FROM documents)"
PAGES = "src AS (SELECT page_id AS id, html AS payload FROM pages)"
LOG_LINE = "strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || ' ' || event_type || ' ' || props"
LOGS = f"src AS (SELECT user_id AS id, string_agg({LOG_LINE}, chr(10) ORDER BY event_id) AS payload FROM events WHERE user_id IS NOT NULL GROUP BY user_id)"
TABLES = "src AS (SELECT o_custkey AS id, 'id,status,priority' || chr(10) || string_agg(o_orderkey || ',' || o_orderstatus || ',' || o_orderpriority, chr(10) ORDER BY o_orderkey) AS payload FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey)"
ORDER_JSON = """'{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '","priority":"' || o_orderpriority || '"}'"""
JSON = f"""src AS (SELECT o_custkey AS id, '{{"customer":' || o_custkey || ',"orders":[' || string_agg({ORDER_JSON}, ',' ORDER BY o_orderkey) || ']}}' AS payload FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey)"""


def html(c: str) -> str:
    out = rf"regexp_replace({c}, '(?s)<!--.*?(-->|\z)', '', 'g')"
    for tag in ["script", "style", *[t for t in SKIPPED if t not in ("script", "style")]]:
        out = rf"regexp_replace({out}, '(?is)<{tag}\b.*?(</{tag}\s*>|\z)', ' ', 'g')"
    out = rf"regexp_replace({out}, '(?is)</?({'|'.join(BLOCKS)})\b[^>]*>', chr(10), 'g')"
    out = rf"regexp_replace(regexp_replace({out}, '(?s)<[a-zA-Z/!][^>]*>', ' ', 'g'), '<[a-zA-Z/!][^>]*\z', '', 'g')"
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        out = f"replace({out}, '&{name};', '{char}')"
    return f"array_to_string(list_filter(list_transform(string_split({out}, chr(10)), lambda s: {strip(f'regexp_replace(s, {_BLANKS}, chr(32), {chr(39)}g{chr(39)})')}), lambda s: s <> ''), chr(10)||chr(10))"


def references(c: str) -> str:
    """Numeric character references, each of the common ones replaced by name, then the rest of them one by one."""
    code = "CASE WHEN lower(p[3:3]) = 'x' THEN CAST('0x' || p[4:-2] AS BIGINT) ELSE CAST(p[3:-2] AS BIGINT) END"
    out = f"array_to_string(list_transform(regexp_extract_all({c}, '&#[0-9]{{{{1,7}}}};|&#[xX][0-9a-fA-F]{{{{1,6}}}};|[^&]+|&'), lambda p: CASE WHEN p LIKE '&#%;' THEN chr(CAST({code} AS INTEGER)) ELSE p END), '')".replace("{{", "{").replace("}}", "}")
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        out = f"replace({out}, '&{name};', '{char}')"
    return out


def fit_result(key: str, body: str = "f.body", of: str = "src LEFT JOIN f USING (id)", empty: bool = True) -> str:
    text = f"CASE WHEN payload IS NULL THEN NULL ELSE coalesce({body}, '') END" if empty else body
    return f"SELECT src.id AS {key}, {tok('payload')} AS original_tokens, {tok(text)} AS body_tokens, sha1({text}) AS body_sha FROM {of}"


def compressed(src: str, key: str, query: str | None, budget: int, neighbour: int, chunks=text_chunks) -> str:
    return f"WITH {src}, {chunks()}, {asked(query)}, {scored()}, {fitted(budget, neighbour)} {fit_result(key)}"


def windows_body(budget: int, p: str = "") -> str:
    """CTE {p}w(id, body) of first-fit windows from s and src."""
    return f"""
    {p}m AS (SELECT id, list({{'u': CAST({tok('chunk')} + 1 AS BIGINT), 'k': [idx]}} ORDER BY score DESC, idx) FILTER (score > 0) AS items, arg_min(chunk, (-score, idx)) AS best, bool_or(score > 0) AS sig FROM s GROUP BY id),
    {p}k AS (SELECT id, best, sig, CASE WHEN sig THEN list_reduce(items, lambda a, x: CASE WHEN a.u >= {budget} OR a.u + x.u > {budget} THEN a ELSE {{'u': a.u + x.u, 'k': list_append(a.k, x.k[1])}} END, {{'u': CAST(0 AS BIGINT), 'k': CAST([] AS BIGINT[])}}).k ELSE [] END AS kept FROM {p}m),
    {p}j AS (SELECT u.id, string_agg(chunk, chr(10) ORDER BY u.idx) AS body FROM (SELECT id, unnest(kept) AS idx FROM {p}k) u JOIN s ON u.id = s.id AND u.idx = s.idx GROUP BY u.id),
    {p}w AS (SELECT src.id, CASE WHEN payload IS NULL OR {tok('payload')} <= {budget} THEN payload WHEN NOT sig THEN substr(payload, 1, {4 * budget}) WHEN len(kept) = 0 THEN substr(best, 1, {4 * budget}) ELSE j.body END AS body
             FROM src LEFT JOIN {p}k AS k USING (id) LEFT JOIN {p}j AS j ON src.id = j.id)"""


def logs_body(query: str | None, budget: int, passes: int) -> str:
    return f"WITH {LOGS}, {logs_fitted(query, budget, passes)} {fit_result('id')}"


def logs_fitted(query: str | None, budget: int, passes: int = 3) -> str:
    """CTEs up to f(id, body) from ``src`` of logs."""
    severe = r"(?i)\b(" + "|".join(LOG_WORDS) + r")\b"
    items = [f"list_transform(imp, lambda j: {{'u': cost[j + 1], 'k': [j], 'p': 1}})"]
    if passes > 1:
        items.append("list_transform(list_filter(flatten(list_transform(imp, lambda j: [j - 1, j + 1])), lambda j: j >= 0 AND j < n), lambda j: {'u': cost[j + 1], 'k': [j], 'p': 2})")
        items.append("list_transform(range(0, n), lambda j: {'u': cost[j + 1], 'k': [j], 'p': 3})")
    joined = items[0] if passes == 1 else f"list_concat(list_concat({items[0]}, {items[1]}), {items[2]})"
    step = f"""CASE WHEN list_contains(a.k, x.k[1]) OR (x.p <> 2 AND a.p = x.p) THEN a
        WHEN a.u + x.u > {budget} AND len(a.k) > 0 THEN (CASE WHEN x.p = 2 THEN a ELSE {{'u': a.u, 'k': a.k, 'p': x.p}} END)
        ELSE {{'u': a.u + x.u, 'k': list_append(a.k, x.k[1]), 'p': a.p}} END"""
    return f"""
    l0 AS (SELECT id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT id, list_transform({full_lines('payload')}, lambda s: rtrim(s, {_W})) AS l FROM src)),
    l1 AS (SELECT *, sum(CASE WHEN line = before THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(line) OVER (PARTITION BY id ORDER BY pos) AS before FROM l0)),
    c AS (SELECT id, CAST(run - 1 AS BIGINT) AS idx, any_value(line) AS chunk, count(*) AS times FROM l1 GROUP BY id, run),
    {asked(query)}, {scored()},
    sh AS (SELECT s.id, s.idx, CASE WHEN times = 1 THEN s.chunk ELSE s.chunk || '  (x' || times || ')' END AS chunk, CASE WHEN regexp_matches(s.chunk, '{severe}') THEN 2.0 ELSE 0.0 END + score AS weight FROM s JOIN c ON s.id = c.id AND s.idx = c.idx),
    m AS (SELECT id, count(*) AS n, list(CAST({tok('chunk')} + 1 AS BIGINT) ORDER BY idx) AS cost, coalesce(list(idx ORDER BY weight DESC, idx) FILTER (weight > 0), CAST([] AS BIGINT[])) AS imp FROM sh GROUP BY id),
    it AS (SELECT id, n, {joined} AS items FROM m),
    k2 AS (SELECT id, n, CASE WHEN len(items) = 0 THEN [] ELSE list_reduce(items, lambda a, x: {step}, {{'u': CAST(0 AS BIGINT), 'k': CAST([] AS BIGINT[]), 'p': 0}}).k END AS kept FROM it),
    {stitched('f', 'k2', 'sh', 'chr(10)')}"""


def tabular_body(query: str | None, budget: int) -> str:
    return f"WITH {TABLES}, {tabular_fitted(query, budget)} {fit_result('id', of='src JOIN f ON src.id = f.id')}"


def tabular_fitted(query: str | None, budget: int) -> str:
    """CTEs up to f(id, body) from ``src`` of comma-separated tables."""
    return f"""
    l0 AS (SELECT id, {full_lines('payload')} AS l FROM src),
    c AS (SELECT id, unnest(l[2:]) AS chunk, generate_subscripts(l[2:], 1) - 1 AS idx FROM l0),
    {asked(query)}, {scored()},
    o AS (SELECT s.id, idx, chunk, row_number() OVER w AS rn, {tok('l[1]')} + 12 + sum({tok('chunk')} + 1) OVER (w ROWS UNBOUNDED PRECEDING) AS cum FROM s JOIN l0 ON s.id = l0.id WINDOW w AS (PARTITION BY s.id ORDER BY score DESC, idx)),
    k AS (SELECT id, count(*) AS kept, string_agg(chunk, chr(10) ORDER BY idx) AS rows FROM o WHERE rn = 1 OR cum <= {budget} GROUP BY id),
    f AS (SELECT src.id, CASE WHEN len(l) <= 2 THEN payload ELSE l[1] || chr(10) || rows || CASE WHEN len(l) - 1 > kept THEN chr(10) || '# (+' || (len(l) - 1 - kept) || ' more rows, ' || len(string_split(l[1], ',')) || ' columns total)' ELSE '' END END AS body
          FROM src JOIN l0 ON src.id = l0.id LEFT JOIN k ON src.id = k.id)"""


def json_fitted(query: str | None, budget: int) -> str:
    """CTEs up to f(id, body) from ``src`` of JSON: the engine's own tree table, needs from the root down, each rung's text whole."""
    values = ", ".join(f"('{t}')" for t in query_terms(query or ""))
    asked_terms = f"SELECT DISTINCT c.id, term FROM c, (VALUES {values}) v(term)" if values else "SELECT id, CAST(NULL AS VARCHAR) AS term FROM c WHERE false"
    if query == OWN:
        asked_terms = f"SELECT DISTINCT c.id, term FROM c JOIN (SELECT id AS pid, unnest({terms('question')}) AS term FROM src) w ON split_part(c.id, '|', 1) = CAST(w.pid AS VARCHAR)"
    rungs = ", ".join(f"({r}, {k}, {c}, {d}, {str(w).lower()})" for r, (k, c, d, w) in enumerate(LADDER))
    cut = "CASE WHEN length(said) <= chars OR (NOT contains(said, ' ') AND length(said) <= 128) THEN said ELSE left(said, chars) || '…(+' || (length(said) - chars) || ' chars)' END"
    elided = """CASE WHEN type = 'OBJECT' THEN '{"…":"(' || inner_n || ' keys elided)"}' ELSE '["(' || inner_n || ' items elided)"]' END"""
    return f"""
    tr AS (SELECT src.id AS pid, t.id AS pos, t.parent, t.key, t.type, CAST(t.value AS VARCHAR) AS value, json_extract_string(t.value, '$') AS said FROM src, json_tree(src.payload) t),
    ch AS (SELECT x.*, y.type AS holder, count(*) OVER fam AS n, row_number() OVER (fam ORDER BY x.pos) AS ord, bool_and(x.type = 'OBJECT') OVER fam AS maps, bool_or(x.type IN ('OBJECT', 'ARRAY')) OVER fam AS nested
           FROM tr x LEFT JOIN tr y ON x.pid = y.pid AND x.parent = y.pos WINDOW fam AS (PARTITION BY x.pid, x.parent)),
    li AS (SELECT *, coalesce(holder = 'ARRAY' OR (holder = 'OBJECT' AND ((n >= 3 AND maps) OR (n >= 20 AND NOT nested))), false) AS listed FROM ch),
    c AS (SELECT pid || '|' || parent AS id, ord - 1 AS idx, CASE WHEN holder = 'OBJECT' THEN key || ' ' ELSE '' END || value AS chunk FROM li WHERE listed),
    q AS ({asked_terms}), {scored()},
    sr AS (SELECT li.*, coalesce(s.score, 0.0) AS score, max(coalesce(s.score, 0.0)) OVER (PARTITION BY pid, parent) AS best FROM li LEFT JOIN s ON li.listed AND s.id = li.pid || '|' || li.parent AND s.idx = li.ord - 1),
    nr AS (SELECT *, CASE WHEN best > 0 THEN score > 0 AND score >= 0.5 * best ELSE true END AS near, row_number() OVER (PARTITION BY pid, parent ORDER BY score DESC, pos) AS rk FROM sr),
    nd AS (SELECT *, CASE WHEN NOT listed THEN 0 WHEN NOT near THEN 1000000 ELSE rk END AS tight, CASE WHEN NOT listed THEN 0 WHEN NOT near THEN 1000000 WHEN n <= 10 THEN 0 ELSE rk END AS loose FROM nr),
    wy AS (WITH RECURSIVE w(pid, pos, depth, tight, loose) AS (SELECT pid, pos, 0, 0, 0 FROM nd WHERE parent IS NULL
           UNION ALL SELECT nd.pid, nd.pos, w.depth + 1, greatest(w.tight, nd.tight), greatest(w.loose, nd.loose) FROM w JOIN nd ON nd.pid = w.pid AND nd.parent = w.pos) SELECT * FROM w),
    up AS (WITH RECURSIVE u(pid, pos, low) AS (SELECT pid, pos, pos FROM tr UNION ALL SELECT u.pid, tr.parent, u.low FROM u JOIN tr ON tr.pid = u.pid AND tr.pos = u.pos WHERE tr.parent IS NOT NULL) SELECT pid, pos, max(low) AS ends FROM u GROUP BY ALL),
    cn AS (SELECT pid, parent, count(*) AS inner_n FROM tr WHERE parent IS NOT NULL GROUP BY ALL),
    al AS (SELECT r, chars, deepest, nd.pid, nd.pos, nd.parent, nd.key, nd.type, nd.value, nd.said, nd.holder, wy.depth, up.ends, coalesce(cn.inner_n, 0) AS inner_n
           FROM nd JOIN wy USING (pid, pos) JOIN up USING (pid, pos) LEFT JOIN cn ON cn.pid = nd.pid AND cn.parent = nd.pos, (VALUES {rungs}) g(r, k, chars, deepest, whole)
           WHERE CASE WHEN whole THEN wy.loose ELSE wy.tight END <= k AND wy.depth <= deepest),
    kc AS (SELECT r, pid, parent, count(*) AS kept FROM al WHERE parent IS NOT NULL GROUP BY ALL),
    pc AS (SELECT r, pid, pos AS spot, 0 AS turn, 0 AS inside,
               CASE WHEN row_number() OVER (PARTITION BY r, pid, parent ORDER BY pos) > 1 THEN ',' ELSE '' END || CASE WHEN holder = 'OBJECT' THEN CAST(to_json(key) AS VARCHAR) || ':' ELSE '' END
               || CASE WHEN type = 'VARCHAR' THEN CAST(to_json({cut}) AS VARCHAR) WHEN type NOT IN ('OBJECT', 'ARRAY') THEN value WHEN depth = deepest THEN {elided}
                       WHEN inner_n = 0 THEN value WHEN type = 'OBJECT' THEN '{{' ELSE '[' END AS piece FROM al
           UNION ALL
           SELECT al.r, al.pid, ends, 1, -depth, CASE WHEN kept < inner_n THEN CASE WHEN type = 'OBJECT' THEN ',"…":"(+' || (inner_n - kept) || ' more entries)"' ELSE ',"(+' || (inner_n - kept) || ' more items)"' END ELSE '' END
               || CASE WHEN type = 'OBJECT' THEN '}}' ELSE ']' END FROM al JOIN kc ON kc.r = al.r AND kc.pid = al.pid AND kc.parent = al.pos WHERE depth < deepest),
    tx AS (SELECT r, pid, string_agg(piece, '' ORDER BY spot, turn, inside) AS body FROM pc GROUP BY ALL),
    f AS (SELECT src.id, coalesce(arg_min(body, r) FILTER ({tok('body')} <= {budget}), '"…"') AS body FROM src LEFT JOIN tx ON src.id = tx.pid GROUP BY src.id)"""


def routed(query: str, budget: int, source: str = "") -> str:
    """CTEs up to z(origin, id, content_type, original_tokens, body, ...) of all payloads, or of ``source``'s ap(origin, id, payload, question): body is null for those that pass."""
    room = max(16, budget - 24)
    lanes = {
        "text": f"{text_chunks()}, {asked(query)}, {scored()}, {fitted(room, 1)}", "html": f"{html_chunks()}, {asked(query)}, {scored()}, {fitted(room, 1)}",
        "logs": logs_fitted(query, room), "tabular": tabular_fitted(query, room), "json": json_fitted(query, room),
    }
    parts = " UNION ALL ".join(f"SELECT id, body FROM (WITH src AS (SELECT key AS id, payload{', question' if source else ''} FROM ov WHERE content_type = '{k}'), {lane} SELECT src.id, coalesce(f.body, '') AS body FROM src LEFT JOIN f ON src.id = f.id)" for k, lane in lanes.items())
    return f"""{source or ALL},
    kd AS (SELECT *, origin || ':' || id AS key, {kind('payload')} AS content_type, {tok('payload')} AS original_tokens FROM ap),
    ov AS (SELECT * FROM kd WHERE original_tokens > {budget}),
    bd AS ({parts}),
    z AS (SELECT kd.*, CASE WHEN original_tokens > {budget} THEN body END AS body FROM kd LEFT JOIN bd ON kd.key = bd.id)"""


def kind(c: str) -> str:
    log = r"(?i)^\s*(\d{4}-\d{2}-\d{2}[ t]\d{2}:\d{2}|\[\d{2}:\d{2}:\d{2}\]|(" + "|".join(LEVEL_WORDS) + r")\b)"
    head = f"{full_lines(c)}[1:40]"
    times = lambda s, d: f"(length({s}) - length(replace({s}, {d}, '')))"
    top = f"{full_lines(c)}[1:20]"
    steady = " OR ".join(f"({times(top + '[1]', d)} >= 1 AND len(list_filter({top}, lambda s: {times('s', d)} <> {times(top + '[1]', d)})) = 0)" for d in ("chr(9)", "','", "'|'"))
    return rf"""CASE WHEN {c} IS NULL OR {strip(c)} = '' THEN 'text'
        WHEN left(ltrim({c}), 1) IN ('{{', '[') AND json_valid({c}) THEN 'json'
        WHEN regexp_matches({c}, '(?i)<!doctype html|<html[\s>]|<body[\s>]|<div[\s>]|<p[\s>]') OR len(regexp_extract_all({c}, '<[a-zA-Z/][^>]{{0,200}}>')) >= 5 THEN 'html'
        WHEN len({head}) >= 4 AND len(list_filter({head}, lambda s: regexp_matches(s, '{log}'))) >= greatest(3, len({head}) // 3) THEN 'logs'
        WHEN len({top}) >= 3 AND ({steady}) THEN 'tabular' ELSE 'text' END"""


def _part(name: str, cte: str) -> str:
    return f"SELECT '{name}' AS origin, id, payload FROM ({'WITH ' + cte + ' SELECT id, payload FROM src'})"


ALL = "ap AS (" + " UNION ALL ".join(_part(n, c) for n, c in (("documents", DOCS), ("pages", PAGES), ("logs", LOGS), ("tables", TABLES), ("json", JSON))) + ")"


def wilson(k: str, n: str) -> tuple[str, str]:
    centre, spread = f"({k} / {n} + {Z * Z} / (2 * {n}))", f"({Z} * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + {Z * Z} / (4 * {n} * {n})))"
    return (f"round(CASE WHEN {n} > 0 THEN greatest(({centre} - {spread}) / (1 + {Z * Z} / {n}), 0.0) ELSE 0.0 END, 6)",
            f"round(CASE WHEN {n} > 0 THEN least(({centre} + {spread}) / (1 + {Z * Z} / {n}), 1.0) ELSE 0.0 END, 6)")


def mcnemar(b: str, c: str) -> str:
    """The p value by the series erf(x) = sum of exp(-x^2) x^(2k+1) / gamma(k + 3/2)."""
    x = f"sqrt(power(abs({b} - {c}) - 1, 2) / ({b} + {c}) / 2)"
    erf = f"list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln({x}) - {x} * {x} - lgamma(k + 1.5))))"
    return f"round(CASE WHEN {b} + {c} = 0 OR abs({b} - {c}) = 1 THEN 1.0 WHEN {x} > 6 THEN 0.0 ELSE greatest(least(1 - {erf}, 1.0), 0.0) END, 6)"


def normal(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


def matches(a: str, g: str) -> str:
    """``a`` and ``g`` are normal forms."""
    wanted = f"string_split({g}, ' ')"
    toks = f"list_filter(CASE WHEN len(list_filter({wanted}, lambda w: length(w) > 2)) > 0 THEN list_filter({wanted}, lambda w: length(w) > 2) ELSE {wanted} END, lambda w: w <> '')"
    have = f"len(list_filter({toks}, lambda w: list_contains(string_split({a}, ' '), w)))"
    return f"coalesce(CASE WHEN {g} = '' THEN false ELSE contains({a}, {g}) OR (len({toks}) > 0 AND {have} / len({toks}) >= 0.7) END, false)"


def verdicts() -> str:
    """CTEs up to v(doc_id, lang, method, budget, full_tokens, tokens, full_ok, ok).

    Scores of chunks don't depend on the budget, so lines and windows are scored once each.
    """
    gold = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
    ctes = f"""
    cs AS (SELECT doc_id AS id, coalesce(lang, 'none') AS lang, text AS payload, array_to_string({gold}[len({gold}) // 2 + 1:len({gold}) // 2 + 5], ' ') AS gold FROM documents WHERE text IS NOT NULL),
    src AS (SELECT id, payload FROM cs),
    q AS (SELECT DISTINCT id, unnest({terms('gold')}) AS term FROM cs)"""
    text = f"{text_chunks()}, {scored()}"
    rag = f"{line_windows(40, 32)}, {scored()}"
    parts = []
    for b in BUDGETS:
        over = f"{tok('payload')} > {b}"
        parts += [
            f"SELECT id, 'full' AS method, {b} AS budget, payload AS body FROM cs",
            f"SELECT id, 'head', {b}, substr(payload, 1, {4 * b}) FROM cs",
            f"SELECT id, 'tail', {b}, right(payload, {4 * b}) FROM cs",
            f"SELECT id, 'windows', {b}, body FROM (WITH {rag}, {windows_body(b, f'r{b}')} SELECT id, body FROM r{b}w)",
            f"SELECT src.id, 'condense', {b}, CASE WHEN {over} THEN coalesce(body, '') ELSE payload END FROM src LEFT JOIN (WITH {text}, {fitted(b, 1, f'x{b}')} SELECT id, body FROM x{b}f) y ON src.id = y.id",
        ]
    return f"""{ctes},
    bodies AS ({' UNION ALL '.join(parts)}),
    nb AS (SELECT bodies.id, lang, method, budget, payload, {tok('body')} AS tokens, {normal('body')} AS a, {normal('payload')} AS pa, {normal('gold')} AS g FROM bodies JOIN cs USING (id)),
    v AS (SELECT id AS doc_id, lang, method, budget, {tok('payload')} AS full_tokens, tokens, {matches('pa', 'g')} AS full_ok, {matches('a', 'g')} AS ok FROM nb)"""


def solves() -> str:
    chance = " ".join(f"WHEN '{m}' THEN {c}" for m, c in SOLVERS.items())
    return f"""tk AS (SELECT user_id AS task, count(*) AS tool_calls, count(*) FILTER (event_type = 'error' AND user_id % 4 <> 0) AS compressed FROM events WHERE user_id IS NOT NULL GROUP BY user_id),
    so AS (SELECT method, task, trial, CAST(CAST(concat('0x', substr(sha1(method || '|' || task || '|' || trial), 1, 8)) AS BIGINT) % 100 < CASE method {chance} END AS DOUBLE) AS reward, tool_calls, compressed
           FROM tk, (SELECT unnest({list(SOLVERS)}) AS method), (SELECT unnest(range(0, 5)) AS trial))"""


GAPS = "gp AS (SELECT task, avg(reward) FILTER (method = 'router') - avg(reward) FILTER (method = 'none') AS gap FROM so GROUP BY task)"
STRATA = f"""e AS (SELECT task, sum(compressed) AS c, CASE WHEN sum(tool_calls) > 0 THEN sum(compressed) / sum(tool_calls) ELSE 0.0 END AS exposure FROM so WHERE method = 'router' GROUP BY task),
    strat AS (SELECT task, exposure, CASE WHEN c = 0 THEN 'placebo' WHEN exposure < (SELECT quantile_cont(exposure, 0.5) FROM e WHERE c > 0) THEN 'low' ELSE 'high' END AS stratum,
              task NOT IN ({', '.join(map(str, DIAGNOSTIC))}) AS headline FROM e)"""


def replicates(src: str, n_boot: int = 20_000, leaf: int = 32) -> str:
    """CTE rp(stratum, rep, mean) from ``src(stratum, task, value)``: the generator's d-th draw is x * 48271^d mod 2^31 - 1, from a table of powers."""
    seed = lambda key: f"(CAST(concat('0x', substr(sha1({key}), 1, 8)) AS BIGINT) % 2147483646 + 1)"
    return f"""pl AS (SELECT stratum, value, count(*) OVER (PARTITION BY stratum) AS n, row_number() OVER (PARTITION BY stratum ORDER BY sha1(CAST(task AS VARCHAR)), task) - 1 AS place FROM {src}),
    pw AS (WITH RECURSIVE w(d, m) AS (SELECT 1, CAST(48271 AS BIGINT) UNION ALL SELECT d + 1, m * 48271 % 2147483647 FROM w WHERE d < (SELECT max(n) FROM pl)) SELECT list(m ORDER BY d) AS ms FROM w),
    vals AS (SELECT stratum, place // {leaf} AS a, list(value ORDER BY place) AS own FROM pl GROUP BY ALL),
    tree AS (WITH RECURSIVE t(stratum, n, rep, a, b, c) AS (
        SELECT stratum, n, rep, CAST(0 AS BIGINT), CAST(ceil(n / {leaf}) AS BIGINT), n FROM (SELECT stratum, count(*) AS n FROM pl GROUP BY stratum), (SELECT unnest(range(0, {n_boot})) AS rep)
        UNION ALL
        SELECT stratum, n, rep, CASE side WHEN 0 THEN a ELSE h END, CASE side WHEN 0 THEN h ELSE b END, CASE side WHEN 0 THEN l ELSE c - l END
        FROM (SELECT *, len(list_filter(ms[1:c], lambda m: (x * m % 2147483647) * (least(b * {leaf}, n) - a * {leaf}) < (h - a) * {leaf} * 2147483647)) AS l
              FROM (SELECT *, (a + b) // 2 AS h, {seed("'0|' || stratum || '|' || rep || '|' || a || '|' || b")} AS x FROM t, pw WHERE b - a > 1 AND c > 0)), (SELECT unnest([0, 1]) AS side))
        SELECT * FROM t WHERE b - a = 1 AND c > 0),
    rp AS (SELECT stratum, rep, sum(s) / max(n) AS mean FROM (
        SELECT stratum, rep, n, list_sum(list_transform(ms[1:c], lambda m: own[(x * m % 2147483647) * len(own) // 2147483647 + 1])) AS s
        FROM (SELECT *, {seed("'0|' || stratum || '|' || rep || '|' || a")} AS x FROM tree JOIN vals USING (stratum, a), pw)) GROUP BY stratum, rep)"""


def episodes() -> str:
    """Every call of every episode in turn: first outputs, expanded ones, what the program picks, second outputs, answers."""
    room = max(16, SMALL - 24)
    note = lambda body, whole: f"{body} || chr(10) || '[condensed ' || {tok(whole)} || ' -> ' || {tok(body)} || ' tokens; whole text: expand(' || substr(sha1({whole}), 1, 8) || ')]'"
    lane = lambda src, ctes: f"(WITH src AS (SELECT id, payload FROM {src}), {ctes} SELECT src.id, coalesce(f.body, '') AS body FROM src LEFT JOIN f ON src.id = f.id)"

    def outputs(src: str, query: str, fitted) -> str:
        """(id, method, payload, body, shown): ``shown`` with the footer, where there is one."""
        return f"""SELECT id, 'full' AS method, payload, payload AS body, payload AS shown FROM {src} UNION ALL SELECT id, 'head', payload, substr(payload, 1, {4 * SMALL}), substr(payload, 1, {4 * SMALL}) FROM {src}
        UNION ALL SELECT id, 'condense', payload, CASE WHEN {tok('payload')} <= {SMALL} THEN payload ELSE body END AS b, b FROM {src} JOIN {lane(src, fitted(query, SMALL))} USING (id)
        UNION ALL SELECT id, 'recovery', payload, CASE WHEN {tok('payload')} <= {SMALL} THEN payload ELSE body END AS b, CASE WHEN {tok('payload')} <= {SMALL} THEN payload ELSE {note('body', 'payload')} END FROM {src} JOIN {lane(src, fitted(query, room))} USING (id)"""

    return f"""j1 AS (WITH {JSON} SELECT id, payload FROM src),
    j2 AS (SELECT l_orderkey AS id, 'line,quantity,part' || chr(10) || string_agg(l_linenumber || ',' || CAST(l_quantity AS BIGINT) || ',' || l_partkey, chr(10) ORDER BY l_linenumber) AS payload FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey),
    o1 AS ({outputs('j1', HOPS[0], json_fitted)}),
    e1 AS (SELECT *, method = 'recovery' AND shown <> body AND regexp_matches(body, 'more items|elided') AS expanded FROM o1),
    r1 AS (SELECT *, CASE WHEN expanded THEN substr(payload, 1, 8000) || CASE WHEN length(payload) > 8000 THEN chr(10) || '[' || (length(payload) - 8000) || ' more characters: expand from 8000]' ELSE '' END END AS page FROM e1),
    v1 AS (SELECT *, coalesce(page, body) AS text, json_valid(coalesce(page, body)) AS sound FROM r1),
    u1 AS (SELECT id, method, max(CAST(json_extract_string(o, '$.id') AS BIGINT)) FILTER (json_extract_string(o, '$.priority') = '1-URGENT') AS pick
           FROM (SELECT id, method, unnest(CAST(json_extract(text, '$.orders[*]') AS JSON[])) AS o FROM v1 WHERE sound) WHERE json_type(o) = 'OBJECT' GROUP BY ALL),
    s1 AS (SELECT v1.*, pick FROM v1 LEFT JOIN u1 USING (id, method)),
    o2 AS ({outputs('(SELECT j2.* FROM j2 WHERE id IN (SELECT pick FROM s1)) j3', HOPS[1], tabular_fitted)}),
    q2 AS (SELECT id, method, CAST(coalesce(sum(CAST(split_part(x, ',', 2) AS BIGINT)), 0) AS BIGINT) AS total FROM (SELECT id, method, unnest(string_split(body, chr(10))) AS x FROM o2) WHERE regexp_matches(x, '^[0-9]+,[0-9]+,') GROUP BY ALL),
    gd AS (SELECT o_custkey AS task, max(o_orderkey) FILTER (o_orderpriority = '1-URGENT') AS k FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1),
    gq AS (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1),
    g AS (SELECT task, CASE WHEN k IS NULL THEN 'none' ELSE k || ':' || coalesce(q, 0) END AS gold FROM gd LEFT JOIN gq ON k = l_orderkey),
    a AS (SELECT s1.method, s1.id AS task, CASE WHEN NOT sound THEN NULL WHEN pick IS NULL THEN 'none' ELSE pick || ':' || coalesce(total, 0) END AS answer, CAST(expanded AS INT) AS more, sound AND pick IS NOT NULL AS second,
          {tok('s1.payload')} AS raw1, {tok('s1.shown')} + CASE WHEN expanded THEN {tok('page')} ELSE 0 END AS ctx1, {tok('o2.payload')} AS raw2, {tok('o2.shown')} AS ctx2
          FROM s1 LEFT JOIN o2 ON o2.id = pick AND o2.method = s1.method LEFT JOIN q2 ON q2.id = pick AND q2.method = s1.method)"""


_LOW, _HIGH = "CAST(floor(len(l) * 0.025) AS BIGINT) + 1", "CAST(greatest(floor(len(l) * 0.975) - 1, 0) AS BIGINT) + 1"
_JSON_ITEMS = f"""{JSON},
    c AS (SELECT o_custkey AS id, {ORDER_JSON} AS chunk, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx FROM orders WHERE o_custkey IS NOT NULL),
    {asked(TABLE_QUERY)}, {scored()}"""


def one_level() -> str:
    def rung(k: int) -> str:
        return f"""SELECT id, {k} AS k, '{{"customer":' || id || ',"orders":[' || string_agg(chunk, ',' ORDER BY idx) || CASE WHEN max(n) > count(*) THEN ',"(+' || (max(n) - count(*)) || ' more items)"' ELSE '' END || ']}}' AS body
            FROM z WHERE (best > 0 AND rk <= {k} AND score >= 0.5 * best AND score > 0) OR (best = 0 AND idx < {k}) GROUP BY id"""

    return f"""WITH {_JSON_ITEMS},
    z AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, max(score) OVER (PARTITION BY id) AS best, row_number() OVER (PARTITION BY id ORDER BY score DESC, idx) AS rk FROM s),
    rungs AS ({' UNION ALL '.join(rung(k) for k in (10, 6, 3, 2, 1))}),
    b AS (SELECT id, arg_max(body, k) AS body FROM rungs WHERE {tok('body')} <= {SMALL} GROUP BY id)
    SELECT src.id, {tok('payload')} AS original_tokens, {tok("coalesce(body, '" + chr(34) + "…" + chr(34) + "')")} AS body_tokens, sha1(coalesce(body, '"…"')) AS body_sha FROM src LEFT JOIN b USING (id)"""


def sketch(top: int = 256, matter: int = 64) -> str:
    hot = "(?i)" + "|".join(STREAM_WORDS)
    asked_list = "[" + ", ".join(f"'{t}'" for t in query_terms(LOG_QUERY)) + "]"
    w = "OVER (PARTITION BY id ORDER BY event_id, part ROWS UNBOUNDED PRECEDING)"
    return f"""WITH li AS (SELECT user_id AS id, event_id, {strip(LOG_LINE)} AS line FROM events WHERE user_id IS NOT NULL),
    pc AS (SELECT id, event_id, unnest(l) AS chunk, generate_subscripts(l, 1) AS part FROM (SELECT id, event_id, {capped('line')} AS l FROM li WHERE line <> '')),
    fl AS (SELECT *, regexp_matches(chunk, '{hot}') AS hot, len(list_intersect({asked_list}, {terms('chunk')})) AS ov FROM pc),
    lv AS (SELECT id, ov, sum(n) OVER (PARTITION BY id ORDER BY ov DESC ROWS UNBOUNDED PRECEDING) - n AS above FROM (SELECT id, ov, count(*) AS n FROM fl WHERE ov > 0 GROUP BY ALL)),
    le AS (SELECT id, min(ov) AS level, arg_min({top} - above, ov) AS room FROM lv WHERE above < {top} GROUP BY id),
    rk AS (SELECT fl.*, level, room, row_number() {w} AS pos, row_number() OVER (PARTITION BY id ORDER BY event_id DESC, part DESC) AS back,
           sum(CAST(hot AS INT)) {w} AS hot_at, sum(CAST(coalesce(ov >= level, false) AS INT)) {w} AS reach FROM fl LEFT JOIN le USING (id)),
    lt AS (SELECT *, sum(CAST(coalesce(ov = level AND reach <= {top}, false) AS INT)) OVER (PARTITION BY id ORDER BY event_id DESC, part DESC ROWS UNBOUNDED PRECEDING) AS late FROM rk),
    kp AS (SELECT * FROM lt WHERE pos <= 8 OR back <= 8 OR (hot AND hot_at <= {matter}) OR ov > level OR (ov = level AND reach <= {top} AND late <= room)),
    c AS (SELECT id, chunk, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS idx FROM kp),
    src AS (SELECT DISTINCT id FROM c), {asked(LOG_QUERY)}, {scored()}, {fitted(BUDGET, 1)}
    SELECT f.id AS user_id, CAST(n AS INTEGER) AS n_kept, {tok('body')} AS body_tokens, sha1(body) AS body_sha FROM f JOIN m USING (id)"""


_MSG = f"""WITH uq AS (SELECT conv_id, arg_max(text, turn) AS query FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY conv_id),
    x AS (SELECT row_number() OVER () AS id, conv_id, turn, role, text, query FROM conversations LEFT JOIN uq USING (conv_id)),
    src AS (SELECT id, text AS payload FROM x WHERE role = 'assistant' AND {tok('text')} > {BUDGET}),
    q AS (SELECT DISTINCT id, unnest({terms("coalesce(query, '')")}) AS term FROM x),
    {text_chunks()}, {scored()}, {fitted(BUDGET, 1)},
    ot AS (SELECT x.*, src.id IS NOT NULL AS rewritten, CASE WHEN src.id IS NULL THEN text ELSE coalesce(body, '') END AS content FROM x LEFT JOIN src ON x.id = src.id LEFT JOIN f ON x.id = f.id)"""

_CUT = f"CASE WHEN role = 'assistant' THEN substr(text, 1, {4 * BUDGET}) ELSE text END"


def bodies(said: str, of: str, more: str = "", named: bool = True, heat: bool = True) -> str:
    """What is read from request bodies whose messages say ``said``; ids that end in 8 have no messages, those in 9 don't parse."""
    open_ = "id % 10 IN (8, 9)"
    return f"""bg AS (SELECT conv_id AS id, count(*) AS n, count(*) FILTER (role = 'assistant') AS named, string_agg({said}, '|' ORDER BY turn) AS t {more} FROM {of} GROUP BY conv_id)
        SELECT id, {open_} AS failed_open, CASE WHEN id % 10 = 9 THEN NULL ELSE 'small' END AS model, {f"CASE WHEN {open_} THEN NULL ELSE CAST(0.5 AS DOUBLE) END AS temperature," if heat else ''}
        CASE WHEN {open_} THEN NULL ELSE CAST(n AS INTEGER) END AS n, {f'CASE WHEN {open_} THEN NULL ELSE CAST(named AS INTEGER) END AS named,' if named else ''} CASE WHEN {open_} THEN NULL ELSE sha1(t) END AS said_sha"""


def planted(least: int) -> str:
    """CTE c0(id, turns..., words, n): documents in units of eight words."""
    return f"c0 AS (SELECT doc_id AS id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+') AS ws, CAST(greatest({least}, ceil(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+')) / 8)) AS BIGINT) AS n FROM documents WHERE doc_id IS NOT NULL)"


_UNIT = "CASE WHEN r * 8 < len(ws) THEN array_to_string(ws[r * 8 + 1:r * 8 + 8], ' ') ELSE 'note ' || r END"


def case_rows() -> str:
    """CTEs up to fc(id, kind, category, notes, ...): the planted cases, by the same arithmetic."""
    kinds = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    return f"""{planted(CASE_UNITS)},
    c1 AS (SELECT *, id % 66 AS t, CASE WHEN id % 66 < 50 THEN 'single' WHEN id % 66 < 56 THEN 'multi' WHEN id % 66 < 62 THEN 'distractor' ELSE 'aggregate' END AS category FROM c0),
    c2 AS (SELECT *, CASE WHEN t >= 62 AND t % 2 = 0 THEN 'tabular' WHEN t < 50 THEN {kinds}[t // 10 + 1] WHEN t % 2 = 0 THEN 'text' ELSE 'json' END AS kind, 1000 + id * 37 AS code FROM c1),
    c3 AS (SELECT *, (id * 37 + 11) % n AS spot, CASE WHEN category = 'aggregate' THEN 'crane one of pier ' || id || ' lifts ' || code ELSE 'harbor code of pier ' || id || ' is ' || code END AS gold,
           CASE category WHEN 'multi' THEN 'harbor fee of pier ' || id || ' is ' || (code + 11) WHEN 'distractor' THEN 'harbor code of pier ' || (id + 100) || ' is ' || (code + 11)
                         WHEN 'aggregate' THEN 'crane two of pier ' || id || ' lifts ' || (code + 11) END AS second,
           CASE WHEN category = 'aggregate' THEN 'crane three of pier ' || id || ' lifts ' || (code + 22) END AS third,
           CASE category WHEN 'multi' THEN 'what are harbor code and harbor fee of pier ' || id WHEN 'aggregate' THEN 'which crane of pier ' || id || ' lifts how much' ELSE 'what is the harbor code of pier ' || id END AS question FROM c2),
    rw AS (SELECT *, unnest(range(0, n)) AS r FROM c3),
    fc AS (SELECT id, kind, category, question, gold, second, third, list(CASE WHEN r = spot THEN gold WHEN r = (spot + n // 2) % n AND second IS NOT NULL THEN second WHEN r = (spot + n // 4) % n AND third IS NOT NULL THEN third ELSE {_UNIT} END ORDER BY r) AS notes
           FROM rw GROUP BY id, kind, category, question, gold, second, third)"""


def task_rows() -> str:
    tasks = "[" + ", ".join(f"'{t}'" for t in TASKS) + "]"
    some = "CASE WHEN task = 'lookup' THEN 2 ELSE 5 END"
    return f"""{planted(TASK_UNITS)},
    c1 AS (SELECT *, CASE WHEN id % 10 < 6 THEN 'json' ELSE 'tabular' END AS kind, {tasks}[id % 10 + 1] AS task, 'salvage tug ' || (id + 40) AS marker FROM c0),
    c2 AS (SELECT *, list_sort(list_transform(range(1, {some}), lambda k: (id * 13 + k * (n // {some})) % n)) AS places FROM c1),
    c3 AS (SELECT *, CASE task WHEN 'count' THEN CAST(len(places) AS VARCHAR) WHEN 'sum' THEN CAST(CAST(list_sum(list_transform(places, lambda p: p * 7 % 100)) AS BIGINT) AS VARCHAR)
           WHEN 'list' THEN array_to_string(list_transform(places, lambda p: p + 1), ',') ELSE CAST(places[1] * 7 % 100 AS VARCHAR) END AS expected FROM c2),
    rw AS (SELECT *, unnest(range(0, n)) AS r FROM c3),
    fc AS (SELECT id, kind, task, expected, list(CASE WHEN list_contains(places, r) THEN marker || ' at berth ' || r ELSE {_UNIT} END ORDER BY r) AS notes FROM rw GROUP BY id, kind, task, expected)"""


def case_payload() -> str:
    at = "notes[r + 1]"
    status = "CASE r % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'open' ELSE 'held' END"
    every = lambda e: f"list_transform(range(0, len(notes)), lambda r: {e})"
    two = lambda e: f"lpad(CAST({e} AS VARCHAR), 2, '0')"
    links = "array_to_string(list_transform(range(1, 41), lambda k: '<a href=/p' || k || '>page ' || k || '</a>'), ' ')"
    item = f"""'{{"id":' || (r + 1) || ',"status":"' || {status} || '","amount":' || (r * 7 % 100) || ',"note":"' || {at} || '"}}'"""
    log = f"'2026-03-01 ' || {two('r // 60 % 24')} || ':' || {two('r % 60')} || ':' || {two('r * 7 % 60')} || ' ' || CASE WHEN contains({at}, 'pier') THEN 'ERROR' ELSE 'INFO' END || ' ' || {at}"
    row = f"(r + 1) || ',' || CASE WHEN r % 2 = 0 THEN 'north' ELSE 'south' END || ',' || {status} || ',' || (r * 7 % 100) || ',' || {at}"
    return f"""CASE kind WHEN 'text' THEN array_to_string(notes, chr(10)||chr(10))
        WHEN 'html' THEN '<!doctype html><html><head><title>ports</title><style>p{{margin:0}}</style></head><body><nav>' || {links} || '</nav>' || array_to_string(list_transform(notes, lambda s: '<p>' || s || '</p>'), '') || '<footer>end</footer></body></html>'
        WHEN 'json' THEN '{{"page":1,"total":' || len(notes) || ',"results":[' || array_to_string({every(item)}, ',') || ']}}'
        WHEN 'logs' THEN array_to_string({every(log)}, chr(10)) ELSE 'id,region,status,amount,note' || chr(10) || array_to_string({every(row)}, chr(10)) END"""


def downstream() -> str:
    """Cut JSON parses only if nothing was cut; a cut table parses if all of its lines have two commas."""
    cut = {"full": "payload", "head": f"substr(payload, 1, {4 * SMALL})", "tail": f"right(payload, {4 * SMALL})", "condense": f"CASE WHEN {tok('payload')} <= {SMALL} THEN payload ELSE body END"}
    parts = []
    for m, t in cut.items():
        cells = f"list_filter({full_lines(t)}, lambda s: s[1] <> '#')"
        table = f"len({cells}) >= 2 AND len(list_filter({cells}, lambda s: length(s) - length(replace(s, ',', '')) <> 2)) = 0"
        parts.append(f"SELECT '{m}' AS method, 'json' AS kind, json_valid({t}) AS p, json_valid({t}) AND {matches(normal(t), normal('gold'))} AS x FROM j")
        parts.append(f"SELECT '{m}', 'tabular', {table}, {table} AND {matches(normal(t), normal('gold'))} FROM t")
    last = "SELECT o_custkey AS id, CAST(max(o_orderkey) AS VARCHAR) AS gold FROM orders GROUP BY o_custkey"
    return f"""WITH la AS ({last}), j AS (SELECT * FROM (WITH {JSON}, {json_fitted('urgent', SMALL)} SELECT src.id, payload, body FROM src LEFT JOIN f ON src.id = f.id) JOIN la USING (id)),
        t AS (SELECT * FROM (WITH {TABLES}, {tabular_fitted('urgent', SMALL)} SELECT src.id, payload, body FROM src LEFT JOIN f ON src.id = f.id) JOIN la USING (id))
        SELECT method, kind, count(*) AS n, count(*) FILTER (x) AS extracted, count(*) FILTER (p) AS parsed FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"""


def _violations() -> str:
    cases = [("method", "method IS NULL"), ("track", "track IS NULL OR track = ''"), ("source", "source IS NULL")]
    parts = [f"SELECT entry, 'missing {n}' AS problem FROM b WHERE {w}" for n, w in cases]
    parts += ["SELECT entry, 'rate out of range' FROM b WHERE value > 1 OR value < 0", "SELECT entry, 'n is not positive' FROM b WHERE n <= 0", "SELECT entry, 'verified without evidence' FROM b WHERE verified AND evidence IS NULL"]
    return f"""WITH b AS (SELECT c_custkey AS entry, CASE WHEN c_custkey % 11 <> 0 THEN c_name END AS method, c_mktsegment AS track, c_custkey % 130 / 100 AS value, c_custkey % 9 AS n,
        CASE WHEN c_custkey % 13 <> 0 THEN 'run' END AS source, c_custkey % 5 = 0 AS verified, CASE WHEN c_custkey % 10 = 0 THEN 'paired test' END AS evidence FROM customer) {' UNION ALL '.join(parts)}"""


_GRID_LOW, _GRID_HIGH = wilson("k", "n")
_BY_WINDOW = """SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY ALL"""
_HEADS = f"substr(payload, 1, {4 * SMALL})"

ORACLE: dict[str, str] = {
    "token_stats": f"SELECT doc_id, t AS tokens, t <= {BUDGET} AS passes, greatest(t - {BUDGET}, 0) AS saved_tokens, round(CASE WHEN t > 0 THEN greatest(t - {BUDGET}, 0) / t ELSE 0.0 END, 6) AS saved_ratio FROM (SELECT doc_id, {tok('text')} AS t FROM documents)",
    "token_stats_by_lang_rollup": f"SELECT lang, CAST(grouping(lang) AS INT) AS is_total, count(*) AS n, CAST(sum(t) AS BIGINT) AS tokens, count(*) FILTER (t > {BUDGET}) AS over FROM (SELECT lang, {tok('text')} AS t FROM documents) GROUP BY ROLLUP (lang)",
    "content_type": f"WITH {ALL} SELECT origin, {kind('payload')} AS content_type, count(*) AS n FROM ap GROUP BY ALL",
    "content_ref_dedup": "SELECT substr(sha1(text), 1, 8) AS ref, count(*) AS copies, min(doc_id) AS first_id, max(length(text)) AS chars FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "store_expand_slice": """WITH k AS (SELECT substr(sha1(text), 1, 8) AS ref, min(text) AS t FROM documents WHERE text IS NOT NULL GROUP BY 1),
        a AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'deadbeef' ELSE substr(sha1(text), 1, 8) END AS ref, doc_id % 7 * 500 AS s FROM documents)
        SELECT doc_id, a.ref, sha1(CASE WHEN t IS NULL THEN 'no stored text under ' || a.ref WHEN length(t) > s + 1000 THEN substr(t, s + 1, 1000) || chr(10) || '[' || (length(t) - s - 1000) || ' more characters: expand from ' || (s + 1000) || ']' ELSE substr(t, s + 1, 1000) END) AS page_sha,
        CASE WHEN length(t) > s + 1000 THEN s + 1000 END AS next_start FROM a LEFT JOIN k ON a.ref = k.ref""",
    "tokenize_terms": f"SELECT term, count(*) AS n FROM (SELECT unnest({terms('text')}) AS term FROM documents) GROUP BY term",
    "bm25_lines": f"WITH {DOCS}, {text_chunks()}, {asked(QUERY)}, {scored()} SELECT id AS doc_id, idx, round(score, 6) AS score, length(chunk) AS chars FROM s WHERE score > 0",
    "bm25_top3_windows": f"""WITH {DOCS}, {line_windows(30, 20)}, {asked(QUERY)}, {scored()},
        rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, idx) AS r FROM s WHERE score > 0),
        kp AS (SELECT DISTINCT id, unnest([idx - 1, idx, idx + 1]) AS idx FROM rk WHERE r <= 3),
        a AS (SELECT s.id, string_agg(chunk, ' ' ORDER BY s.idx) AS t FROM kp JOIN s ON kp.id = s.id AND kp.idx = s.idx GROUP BY s.id),
        z AS (SELECT src.id, coalesce(a.t, CASE WHEN payload IS NOT NULL THEN s.chunk END) AS t FROM src LEFT JOIN a ON src.id = a.id LEFT JOIN s ON src.id = s.id AND s.idx = 0)
        SELECT id AS doc_id, sha1(t) AS answer_sha, length(t) AS chars FROM z""",
    "text_compress_query": compressed(DOCS, "doc_id", QUERY, BUDGET, 0),
    "text_compress_neighbors": compressed(DOCS, "doc_id", QUERY, BUDGET, 2),
    "text_head_tail": compressed(DOCS, "doc_id", None, BUDGET, 0),
    "truncate_head": f"WITH {DOCS} {fit_result('doc_id', f'substr(payload, 1, {4 * BUDGET})', 'src', False)}",
    "truncate_tail": f"WITH {DOCS} {fit_result('doc_id', f'right(payload, {4 * BUDGET})', 'src', False)}",
    "rag_topk_first_fit": f"WITH {DOCS}, {line_windows(40, 32)}, {asked(QUERY)}, {scored()}, {windows_body(BUDGET)} {fit_result('doc_id', 'w.body', 'src JOIN w ON src.id = w.id', False)}",
    "html_extract_exact": rf"""WITH {PAGES},
        t0 AS (SELECT id, regexp_extract_all(payload, '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|</?[a-z][^>]*(?:>|\z)|<[!?][^>]*(?:>|\z)|[^<]+|<') AS l FROM src),
        t1 AS (SELECT id, unnest(l) AS tok, generate_subscripts(l, 1) AS pos FROM t0),
        t2 AS (SELECT *, lower(regexp_extract(tok, '^</?([a-zA-Z][^\s/>]*)', 1)) AS name FROM t1),
        t3 AS (SELECT *, CASE WHEN name NOT IN ({', '.join(f"'{x}'" for x in SKIPPED)}) OR tok LIKE '%/>' OR (name IN ('script', 'style') AND tok NOT LIKE '</%') THEN 0 WHEN tok LIKE '</%' THEN -1 ELSE 1 END AS w FROM t2),
        t4 AS (SELECT *, sum(w) OVER (PARTITION BY id ORDER BY pos) AS s FROM t3),
        t5 AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY id ORDER BY pos)) AS depth FROM t4),
        t6 AS (SELECT id, string_agg(CASE WHEN name IN ({', '.join(f"'{x}'" for x in BLOCKS)}) THEN chr(10) WHEN depth = 0 AND NOT regexp_matches(tok, '^<[a-zA-Z/!?]') THEN {references('tok')} ELSE '' END, ' ' ORDER BY pos) AS said FROM t5 GROUP BY id),
        t7 AS (SELECT src.id, CASE WHEN payload IS NOT NULL THEN array_to_string(list_filter(list_transform(string_split(coalesce(said, ''), chr(10)), lambda s: {strip(f'regexp_replace(s, {_BLANKS}, chr(32), {chr(39)}g{chr(39)})')}), lambda s: s <> ''), chr(10)||chr(10)) END AS text FROM src LEFT JOIN t6 ON src.id = t6.id)
        SELECT id AS page_id, length(text) AS chars, sha1(text) AS text_sha FROM t7""",
    "html_extract": f"SELECT page_id, length({html('html')}) AS chars, sha1({html('html')}) AS text_sha FROM pages",
    "html_compress": compressed(PAGES, "page_id", QUERY, BUDGET, 1, html_chunks),
    "log_run_length": """WITH e AS (SELECT user_id AS id, event_id, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || ' ' || event_type AS line, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type AS same FROM events WHERE user_id IS NOT NULL),
        r AS (SELECT id, line, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY event_id ROWS UNBOUNDED PRECEDING) - 1 AS run FROM e)
        SELECT id, CAST(run AS INTEGER) AS run, line, CAST(count(*) AS INTEGER) AS n FROM r GROUP BY id, run, line""",
    "log_run_length_table": """WITH e AS (SELECT user_id AS id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) <> event_type AS new FROM events WHERE user_id IS NOT NULL),
        r AS (SELECT id, event_type, CAST(sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM e)
        SELECT id, run, event_type, count(*) AS n FROM r GROUP BY ALL""",
    "log_compress_pass1": logs_body(None, BUDGET, 1),
    "log_compress": logs_body(LOG_QUERY, BUDGET, 3),
    "tabular_compress": tabular_body(None, SMALL),
    "tabular_compress_query": tabular_body(TABLE_QUERY, SMALL),
    "json_cliff": f"""WITH {_JSON_ITEMS}, z AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, max(score) OVER (PARTITION BY id) AS best, row_number() OVER (PARTITION BY id ORDER BY score DESC, idx) AS rk FROM s)
        SELECT id, CAST(idx AS INTEGER) AS idx, round(score, 6) AS score FROM z WHERE score > 0 AND score >= 0.5 * best AND (n <= 10 OR rk <= 10)""",
    "json_one_level_compress": one_level(),
    "json_prune_recursive": f"WITH {JSON}, {json_fitted(TABLE_QUERY, SMALL)} {fit_result('id')}",
    "router_compress": f"""WITH {routed(f'{QUERY} {LOG_QUERY}', BUDGET)},
        t AS (SELECT *, CASE WHEN body IS NULL THEN original_tokens ELSE {tok("body || chr(10) || '[condensed ' || original_tokens || ' -> ' || " + tok('body') + " || ' tokens; whole text: expand(' || substr(sha1(payload), 1, 8) || ')]'")} END AS compressed_tokens FROM z)
        SELECT origin, id, content_type, original_tokens, compressed_tokens, CASE WHEN body IS NOT NULL THEN substr(sha1(payload), 1, 8) END AS ref, body IS NOT NULL AS compressed, greatest(original_tokens - compressed_tokens, 0) AS saved_tokens FROM t""",
    "router_passthrough": f"""WITH {ALL}, t AS (SELECT origin, {kind('payload')} AS content_type, {tok('payload')} AS t FROM ap)
        SELECT origin, content_type, t > {BUDGET} AS compressed, count(*) AS n, CAST(sum(t) AS BIGINT) AS original_tokens, count(*) FILTER (t > {BUDGET}) AS refs, 0 AS passed_savings FROM t GROUP BY ALL""",
    "embedding_topk": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL), w AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v),
        p AS (SELECT q.vec_id AS query_id, w.vec_id, round(CASE WHEN q.n * w.n > 0 THEN list_dot_product(q.e, w.e) / (q.n * w.n) ELSE 0.0 END, 9) AS x FROM w q JOIN w ON q.vec_id % 20 = 0 AND q.vec_id <> w.vec_id)
        SELECT query_id, vec_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT query_id, vec_id, round(x, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 6) DESC, vec_id) AS r FROM p WHERE round(x, 6) > 0) WHERE r <= 5""",
    "cosine_floor": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL), w AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v),
        p AS (SELECT q.vec_id AS query_id, w.vec_id, round(CASE WHEN q.n * w.n > 0 THEN list_dot_product(q.e, w.e) / (q.n * w.n) ELSE 0.0 END, 9) AS x FROM w q JOIN w ON q.vec_id % 20 = 0 AND q.vec_id <> w.vec_id)
        SELECT query_id, count(*) AS n, max(round(x, 6)) AS best FROM p WHERE x > 0.2 GROUP BY query_id""",
    "latest_user_query": "SELECT conv_id, arg_max(text, turn) AS query FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY conv_id",
    "messages_compress": f"{_MSG} SELECT conv_id, turn, {tok('text')} AS original_tokens, {tok('content')} AS content_tokens, rewritten, sha1(content) AS content_sha FROM ot",
    "request_stats": f"{_MSG} SELECT count(*) FILTER (rewritten) AS messages, CAST(coalesce(sum({tok('text')}) FILTER (rewritten), 0) AS BIGINT) AS original_tokens, CAST(coalesce(sum({tok('content')}) FILTER (rewritten), 0) AS BIGINT) AS compressed_tokens FROM ot",
    "dialogue_grounding": """WITH l AS (SELECT conv_id, turn, substr(text, 1, 400) AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role IN ('user', 'assistant')),
        g AS (SELECT conv_id, 'find what the caller asks for' || chr(10) || string_agg(said, chr(10) ORDER BY turn) AS t FROM l WHERE r <= 6 GROUP BY conv_id) SELECT conv_id, length(t) AS chars, sha1(t) AS grounding_sha FROM g""",
    "request_body_fail_open": f"WITH {bodies(_CUT, 'conversations')} FROM bg",
    "request_body_blocks": f"WITH {bodies(_CUT, 'conversations', named=False)} FROM bg",
    "request_body_router": f"{_MSG}, {bodies('content', 'ot', f", count(*) FILTER (rewritten) AS k, sum({tok('text')}) FILTER (rewritten) AS o, sum({tok('content')}) FILTER (rewritten) AS s", False, False)}, "
        "CASE WHEN id % 10 IN (8, 9) THEN 0 ELSE k END AS messages, CAST(CASE WHEN id % 10 IN (8, 9) THEN 0 ELSE coalesce(o, 0) END AS BIGINT) AS original_tokens, CAST(CASE WHEN id % 10 IN (8, 9) THEN 0 ELSE coalesce(s, 0) END AS BIGINT) AS compressed_tokens FROM bg",
    "trace_extraction": """SELECT id, step, 'desk' AS tool, length(text) AS chars, sha1(text) AS content_sha FROM (SELECT conv_id AS id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS step, role, text FROM conversations)
        WHERE role = 'assistant' AND id % 10 NOT IN (8, 9)""",
    "judge_matches": f"""WITH i AS (SELECT item_id, {normal('text')} AS g FROM benchmark WHERE text IS NOT NULL), d AS (SELECT doc_id, {normal('text')} AS a FROM documents WHERE text IS NOT NULL),
        m AS (SELECT item_id, doc_id FROM i, d WHERE g <> '' AND {matches('a', 'g')}) SELECT item_id, count(*) AS n_docs, min(doc_id) AS first_doc FROM m GROUP BY item_id""",
    "method_grid": f"""WITH {verdicts()}, g AS (SELECT method, budget, count(*) AS n, sum(tokens) AS t, sum(full_tokens) AS ft, count(*) FILTER (ok) AS k, count(*) FILTER (full_ok) AS fk FROM v GROUP BY ALL)
        SELECT method, budget, n, round(t / n, 6) AS avg_tokens, round(CASE WHEN ft > 0 THEN 1 - t / ft ELSE 0.0 END, 6) AS saved_ratio, round(k / n, 6) AS accuracy, {_GRID_LOW} AS ci_low, {_GRID_HIGH} AS ci_high,
        round(CASE WHEN fk > 0 THEN k / fk ELSE 0.0 END, 6) AS retention, 1.0 AS parseable_rate, CAST(NULL AS DOUBLE) AS downstream_rate FROM g""",
    "full_pass": f"""WITH cs0 AS (SELECT 1), {verdicts()}, g AS (SELECT count(*) AS n, avg(full_tokens) AS t, count(*) FILTER (full_ok) AS k FROM v WHERE method = 'full' AND budget = {BUDGETS[0]})
        SELECT n, round(t, 6) AS avg_tokens, round(k / n, 6) AS accuracy, {_GRID_LOW} AS ci_low, {_GRID_HIGH} AS ci_high FROM g""",
    "category_breakdown": f"""WITH {verdicts()} SELECT method, budget, coalesce(lang, 'all') AS category, count(*) AS n, round(avg(CAST(full_ok AS INT)), 6) AS full_accuracy, round(avg(CAST(ok AS INT)), 6) AS accuracy FROM v GROUP BY GROUPING SETS ((method, budget, lang), (method, budget))""",
    "method_pivot": f"WITH {verdicts()} SELECT method, " + ", ".join(f"round(avg(CAST(ok AS INT)) FILTER (budget = {b}), 6) AS acc_{b}" for b in BUDGETS) + " FROM v GROUP BY method",
    "mcnemar_grid": f"""WITH {verdicts()}, p AS (SELECT o.budget, o.method, count(*) FILTER (a.ok AND NOT o.ok) AS won, count(*) FILTER (NOT a.ok AND o.ok) AS lost FROM v a JOIN v o ON a.doc_id = o.doc_id AND a.budget = o.budget WHERE a.method = 'condense' AND o.method <> 'condense' GROUP BY ALL)
        SELECT budget, method, won, lost, {mcnemar('won', 'lost')} AS p FROM p""",
    "parseable_rate": f"""SELECT * FROM (
        WITH {TABLES} SELECT 'condense' AS method, 'tabular' AS kind, count(*) AS n, count(*) AS parseable FROM src UNION ALL
        SELECT 'head', 'tabular', count(*), count(*) FILTER (length({_HEADS}) - length(replace({_HEADS}, ',', '')) = 2 * len({full_lines(_HEADS)}) AND len({full_lines(_HEADS)}) >= 2 AND len(list_filter({full_lines(_HEADS)}, lambda s: length(s) - length(replace(s, ',', '')) <> 2)) = 0) FROM src)
        UNION ALL (WITH {JSON} SELECT 'full', 'json', count(*), count(*) FILTER (json_valid(payload)) FROM src UNION ALL SELECT 'head', 'json', count(*), count(*) FILTER (json_valid({_HEADS})) FROM src)
        UNION ALL (WITH {LOGS} SELECT 'head', 'logs', count(*), count(*) FILTER (len(list_filter({full_lines(_HEADS)}, lambda s: NOT regexp_matches(s, '(?i)^\\s*\\d{{4}}-\\d{{2}}-\\d{{2}}[ T]\\d{{2}}:\\d{{2}}:\\d{{2}}\\s+(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL)\\b'))) = 0) FROM src
          UNION ALL SELECT 'condense', 'logs', count(*), count(*) FILTER ({tok('payload')} + len({full_lines('payload')}) <= 0) FROM src)""",
    "solve_report": f"""WITH {solves()}, r AS (SELECT method, count(*) AS n, count(*) FILTER (reward >= 1) AS k, CAST(sum(tool_calls) AS BIGINT) AS tool_calls, CAST(sum(compressed) AS BIGINT) AS compressed FROM so GROUP BY method),
        mv AS (SELECT method, task, 2 * count(*) FILTER (reward >= 1) >= count(*) AS ok FROM so GROUP BY ALL),
        t AS (SELECT b.method, count(*) FILTER (a.ok AND NOT b.ok) AS won, count(*) FILTER (NOT a.ok AND b.ok) AS lost FROM mv a JOIN mv b ON a.task = b.task WHERE a.method = 'none' AND b.method <> 'none' GROUP BY b.method)
        SELECT r.method, n, round(k / n, 6) AS rate, {_GRID_LOW} AS ci_low, {_GRID_HIGH} AS ci_high, tool_calls, compressed, won, lost, p FROM r LEFT JOIN (SELECT *, {mcnemar('won', 'lost')} AS p FROM t) t ON r.method = t.method""",
    "per_case_verdicts": f"""WITH {verdicts()} SELECT doc_id, max(full_tokens) AS full_tokens, bool_or(full_ok) AS full_ok, CAST({len(METHODS) * len(BUDGETS)} AS INTEGER) AS verdicts,
        {', '.join(f"bool_or(ok) FILTER (method = '{m}' AND budget = {b}) AS {m}_{b}" for m in METHODS for b in BUDGETS)} FROM v GROUP BY doc_id""",
    "downstream_rate": downstream(),
    "faithfulness_cases": f"""WITH {case_rows()}, p AS (SELECT *, {case_payload()} AS payload FROM fc) SELECT id, kind, category, {tok('payload')} AS tokens, sha1(payload) AS payload_sha, question, gold,
        CASE category WHEN 'multi' THEN second WHEN 'aggregate' THEN second || '|' || third ELSE '' END AS all_of, CASE WHEN category = 'distractor' THEN second ELSE '' END AS none_of FROM p""",
    "agent_task_cases": f"WITH {task_rows()} SELECT id, kind, task, sha1({case_payload()}) AS payload_sha, expected, expected AS computed FROM fc",
    "run_comparison": f"""WITH {solves()}, r AS (SELECT CAST(trial AS VARCHAR) AS model, method, count(*) AS n, count(*) FILTER (reward >= 1) AS k FROM so GROUP BY ALL)
        SELECT model, method, {SMALL} AS budget, n, round(k / n, 6) AS accuracy, {wilson("k", "n")[0]} AS ci_low, {wilson("k", "n")[1]} AS ci_high, round(k / n - base, 6) AS change FROM r JOIN (SELECT method, k / n AS base FROM r WHERE model = '0') USING (method)""",
    "budget_reuse": f"WITH {solves()} SELECT method, budget, count(*) AS n, sum(reward) AS solved FROM so, (SELECT unnest({BUDGETS}) AS budget) GROUP BY ALL",
    "go_no_go_budgets": f"""WITH {solves()}, r AS (SELECT avg(CAST(reward >= 1 AS INT)) FILTER (method = 'router') AS m, avg(CAST(reward >= 1 AS INT)) FILTER (method = 'none') AS c, avg(CAST(reward >= 1 AS INT)) FILTER (method = 'truncate-head') AS w, count(*) FILTER (method = 'router') AS n FROM so)
        SELECT budget, n, round(c, 6) AS control, round(m - c, 6) AS delta, CASE WHEN n < 100 THEN 'PENDING' WHEN c < 0.3 OR w > c THEN 'VOID' WHEN m - c >= bound THEN 'GO' ELSE 'NO-GO' END AS decision FROM r, (VALUES ({BUDGETS[0]}, -0.05), ({BUDGETS[1]}, 0.5)) b(budget, bound)""",
    "cost_projection": f"SELECT count(*) AS n, CAST(sum(g) AS BIGINT) AS saved_tokens, round(sum(g) / 1e6 * 2.5, 6) AS saved, round(sum(g) / 1e6 * 2.5 / count(*) * 1000000, 4) AS projected FROM (SELECT greatest({tok('text')} - {BUDGET}, 0) AS g FROM documents)",
    "solve_stats": f"WITH {solves()} SELECT method, CAST(trial AS INTEGER) AS trial, CAST(sum(tool_calls) AS BIGINT) AS tool_calls, CAST(sum(compressed) AS BIGINT) AS compressed, CAST(sum(tool_calls * 90) AS BIGINT) AS raw_tokens, CAST(sum(tool_calls * 30) AS BIGINT) AS context_tokens, CAST(sum(compressed % 2) AS BIGINT) AS expand_calls FROM so GROUP BY ALL",
    "leaderboard_order": """WITH b AS (SELECT c_custkey AS entry, CASE WHEN c_custkey % 11 <> 0 THEN c_name END AS method, c_mktsegment AS track, c_custkey % 130 / 100 AS value FROM customer)
        SELECT track, row_number() OVER (PARTITION BY track ORDER BY value DESC, entry) AS place, entry, method, value FROM b""",
    "store_expiry": "SELECT CAST(user_id AS VARCHAR) AS ref, max(ts) AS stored_at FROM events WHERE user_id IS NOT NULL GROUP BY user_id HAVING epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(max(ts))) <= 864000",
    "paired_equivalence": f"""WITH {solves()}, {GAPS}, vv AS (SELECT 'all' AS stratum, task, gap AS value FROM gp WHERE gap IS NOT NULL), {replicates('vv')},
        en AS (SELECT list_sort(list(round(mean, 9))) AS l FROM rp), x AS (SELECT l[{_LOW}] AS low, l[{_HIGH}] AS high FROM en)
        SELECT (SELECT count(*) FROM vv) AS tasks, round((SELECT avg(value) FROM vv), 6) AS gap, round(low, 6) AS low, round(high, 6) AS high, margin,
        CASE WHEN low >= -margin AND high <= margin THEN 'EQUIVALENT' WHEN low > margin OR high < -margin THEN 'DIFFERENT' ELSE 'INCONCLUSIVE' END AS verdict FROM x, (VALUES (CAST(0.05 AS DOUBLE)), (CAST(0.1 AS DOUBLE))) m(margin)""",
    "noise_floor": f"""WITH {solves()}, p AS (SELECT a.method, a.task, count(*) AS pairs, count(*) FILTER (a.reward <> b.reward) AS d FROM so a JOIN so b ON a.method = b.method AND a.task = b.task AND a.trial < b.trial GROUP BY ALL)
        SELECT method, CAST(sum(pairs) AS BIGINT) AS pairs, CAST(sum(d) AS BIGINT) AS discordant, round(sum(d) / sum(pairs), 6) AS discordant_rate, round(avg(CAST(d > 0 AS INT)), 6) AS flaky_share FROM p GROUP BY method""",
    "exposure_strata": f"WITH {solves()}, {STRATA} SELECT task, round(exposure, 6) AS exposure, stratum, headline FROM strat",
    "did_headline": f"""WITH {solves()}, {GAPS}, {STRATA}, vv AS (SELECT CASE WHEN stratum = 'placebo' THEN 'placebo' ELSE 'affected' END AS stratum, gp.task, gap AS value FROM gp JOIN strat USING (task) WHERE headline AND gap IS NOT NULL), {replicates('vv')},
        dd AS (SELECT rep, max(mean) FILTER (stratum = 'affected') - max(mean) FILTER (stratum = 'placebo') AS d FROM rp GROUP BY rep), en AS (SELECT list_sort(list(round(d, 9))) AS l FROM dd), x AS (SELECT l[{_LOW}] AS low, l[{_HIGH}] AS high FROM en),
        mm AS (SELECT count(*) AS tasks, avg(value) FILTER (stratum = 'affected') AS a, avg(value) FILTER (stratum = 'placebo') AS p FROM vv)
        SELECT tasks, round(a, 6) AS affected, round(p, 6) AS placebo, round(a - p, 6) AS did, round(low, 6) AS low, round(high, 6) AS high,
        CASE WHEN high < 0 THEN 'HARM' WHEN low > 0 THEN 'BENEFIT' WHEN low >= -0.15 THEN 'CONFIRMED' ELSE 'UNRESOLVED' END AS verdict FROM mm, x""",
    "sample_size": f"WITH {solves()}, {GAPS} SELECT round(sd, 6) AS sd, CAST(m AS DOUBLE) AS margin, CAST(ceil(power({Z} * sd / m, 2)) AS BIGINT) AS tasks FROM (SELECT stddev_samp(gap) AS sd FROM gp), (SELECT unnest([0.02, 0.05, 0.1]) AS m)",
    "go_no_go": f"""WITH {solves()}, r AS (SELECT avg(CAST(reward >= 1 AS INT)) FILTER (method = 'router') AS m, avg(CAST(reward >= 1 AS INT)) FILTER (method = 'none') AS c, avg(CAST(reward >= 1 AS INT)) FILTER (method = 'truncate-head') AS w, count(*) FILTER (method = 'router') AS n FROM so)
        SELECT n, round(c, 6) AS control, round(m - c, 6) AS delta, CASE WHEN n < 100 THEN 'PENDING' WHEN c < 0.3 OR w > c THEN 'VOID' WHEN m - c >= -0.05 THEN 'GO' ELSE 'NO-GO' END AS decision FROM r""",
    "resume_pending": f"WITH {solves()} SELECT method, task, trial FROM so WHERE (task + trial) % 3 <> 0",
    "agent_task_consume": "SELECT o_custkey AS id, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS id_sum, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ids, max(o_orderkey) AS last_id FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey",
    "episode_loop": f"""WITH {episodes()}
        SELECT method, task, answer, true AS finished, coalesce(answer = gold, false) AS success, CAST(2 + more + CAST(second AS INT) AS INTEGER) AS steps, CAST(raw1 + CASE WHEN second THEN raw2 ELSE 0 END AS BIGINT) AS raw_tokens,
               CAST(ctx1 + CASE WHEN second THEN ctx2 ELSE 0 END AS BIGINT) AS context_tokens, more AS expand_calls FROM a JOIN g USING (task)""",
    "savings_benchmark": f"""WITH {routed(OWN, 400, f"{case_rows()}, ap AS (SELECT kind AS origin, id, gold, question, {case_payload()} AS payload FROM fc WHERE category = 'single')")},
        t AS (SELECT *, CASE WHEN body IS NULL THEN payload ELSE body || chr(10) || '[condensed ' || original_tokens || ' -> ' || {tok('body')} || ' tokens; whole text: expand(' || substr(sha1(payload), 1, 8) || ')]' END AS text FROM z)
        SELECT origin AS kind, count(*) AS n, CAST(sum(original_tokens) AS BIGINT) AS original_tokens, CAST(sum({tok('text')}) AS BIGINT) AS compressed_tokens, count(*) FILTER (contains(text, gold)) AS found FROM t GROUP BY origin""",
    "two_hop_sum": """WITH p AS (SELECT o_orderkey, o_orderstatus, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey), s AS (SELECT c_nationkey, count(*) AS open_orders, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM p WHERE o_orderstatus = 'O' GROUP BY 1)
        SELECT o_orderkey, n_name, open_orders, key_sum FROM p JOIN s USING (c_nationkey) JOIN nation ON n_nationkey = c_nationkey""",
    "stream_sketch_batch": sketch(),
    "savings_by_window": _BY_WINDOW,
    "savings_by_window_stream": _BY_WINDOW,
    "savings_session_window": """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events WHERE user_id IS NOT NULL),
        r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM r GROUP BY user_id, s""",
    "latency_percentiles": """WITH l AS (SELECT event_type, list_sort(list(value)) AS l, avg(value) AS m FROM events WHERE value IS NOT NULL GROUP BY event_type)
        SELECT event_type, len(l) AS n, round(m, 6) AS mean, """ + ", ".join(f"l[least(CAST(floor({q} * len(l)) AS BIGINT), len(l) - 1) + 1] AS p{round(100 * q)}" for q in (0.5, 0.9, 0.99)) + " FROM l",
    "lru_compaction": "SELECT user_id, max(ts) AS ts FROM events WHERE user_id IS NOT NULL GROUP BY user_id ORDER BY ts DESC, user_id LIMIT 64",
    "leaderboard_violations": _violations(),
}
