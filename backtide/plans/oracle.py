"""The catalog's queries as SQL over the same tables."""

from __future__ import annotations

#: The relations of sources.bridge and what is derived from them, as common table expressions.
LOGS = """
ev AS (
  SELECT event_id, ts AS time, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
         'r' || CAST(event_id // 5 AS VARCHAR) AS rid, CAST(user_id AS VARCHAR) AS pk FROM events),
e AS (SELECT *, 't' || CAST(k % 4 AS VARCHAR) AS tbn, 'c' || CAST(k % 3 AS VARCHAR) AS col FROM ev),
reads AS (SELECT rid, tbn, pk, event_id AS seq, time, event_id - (k % 50) * 20 AS xmin, event_id AS xmax FROM e WHERE event_type IN ('view', 'click')),
writes AS (
  SELECT rid, tbn, pk, col, CASE event_type WHEN 'signup' THEN 'insert' ELSE 'update' END AS op, CAST(CAST(floor(value / 25) AS INT) AS VARCHAR) AS vtext,
         time, event_id AS xid, event_id AS line FROM e WHERE event_type IN ('signup', 'purchase')),
deletes AS (SELECT rid, tbn, pk, time, event_id AS xid, event_id AS line FROM e WHERE event_type = 'error' AND event_id % 10 = 0),
firsts AS (SELECT rid, arg_min(event_type, event_id) AS event_type, arg_min(user_id, event_id) AS first_user, min(event_id) AS event_id, min(user_id) AS user_id, arg_min(time, event_id) AS time FROM ev GROUP BY rid),
contexts AS (SELECT rid, 'u' || CAST(user_id AS VARCHAR) AS user_id, event_type AS api_id FROM firsts),
requests AS (SELECT rid, time, CASE WHEN event_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, '/' || event_type || '/' || CAST(first_user AS VARCHAR) AS path FROM firsts),
gold AS (SELECT rid FROM requests WHERE CAST(substr(rid, 2) AS BIGINT) % 7 < 3),
root AS (SELECT arg_max(rid, seq) AS rid FROM reads),
cells AS (SELECT DISTINCT tbn, pk, col FROM writes),
row_writes AS (SELECT rid, tbn, pk, time, line FROM writes UNION ALL SELECT rid, tbn, pk, time, line FROM deletes)
"""

HISTORY = LOGS + """,
w0 AS (SELECT *, row_number() OVER c AS pos, lag(vtext) OVER c AS before, lag(xid) OVER c AS xid_before FROM writes WINDOW c AS (PARTITION BY tbn, pk, col ORDER BY xid)),
w1 AS (SELECT *, pos = 1 OR op = 'insert' OR before IS DISTINCT FROM vtext AS raw_new FROM w0),
w2 AS (SELECT *, raw_new OR EXISTS (SELECT 1 FROM deletes d WHERE d.tbn = w1.tbn AND d.pk = w1.pk AND d.xid >= w1.xid_before AND d.xid < w1.xid) AS life_new,
       (SELECT min(d.xid) FROM deletes d WHERE d.tbn = w1.tbn AND d.pk = w1.pk AND d.xid >= w1.xid) AS next_delete FROM w1),
w3 AS (SELECT *, sum(CAST(raw_new AS INT)) OVER c AS raw_run, max(CASE WHEN raw_new THEN pos END) OVER c AS raw_pos, max(CASE WHEN life_new THEN pos END) OVER c AS origin_pos
       FROM w2 WINDOW c AS (PARTITION BY tbn, pk, col ORDER BY xid ROWS UNBOUNDED PRECEDING)),
v AS (SELECT w3.*, a.rid AS raw_rid, b.rid AS origin_rid FROM w3 JOIN w3 a ON a.tbn = w3.tbn AND a.pk = w3.pk AND a.col = w3.col AND a.pos = w3.raw_pos
      JOIN w3 b ON b.tbn = w3.tbn AND b.pk = w3.pk AND b.col = w3.col AND b.pos = w3.origin_pos),
rc AS (SELECT reads.*, cells.col FROM reads JOIN cells USING (tbn, pk))
"""

SNAPSHOT = HISTORY + """,
hi0 AS (SELECT rc.seq, rc.col, max(v.pos) AS pos FROM rc JOIN v ON v.tbn = rc.tbn AND v.pk = rc.pk AND v.col = rc.col AND v.xid < rc.xmax GROUP BY ALL),
lo0 AS (SELECT rc.seq, rc.col, max(v.pos) AS pos FROM rc JOIN v ON v.tbn = rc.tbn AND v.pk = rc.pk AND v.col = rc.col AND v.xid < rc.xmin GROUP BY ALL),
hi AS (SELECT rc.seq, v.* FROM hi0 JOIN rc USING (seq, col) JOIN v ON v.tbn = rc.tbn AND v.pk = rc.pk AND v.col = rc.col AND v.pos = hi0.pos WHERE v.next_delete IS NULL OR v.next_delete >= rc.xmax),
lo AS (SELECT rc.seq, v.* FROM lo0 JOIN rc USING (seq, col) JOIN v ON v.tbn = rc.tbn AND v.pk = rc.pk AND v.col = rc.col AND v.pos = lo0.pos WHERE v.next_delete IS NULL OR v.next_delete >= rc.xmin),
ruled AS (
  SELECT rc.*, lo.xid AS low_xid, hi.xid AS high_xid, lo.rid AS low_rid, hi.rid AS high_rid, lo.origin_rid AS low_origin, hi.origin_rid AS high_origin, lo.vtext AS low_text, hi.vtext AS high_text,
    CASE WHEN hi.xid IS NULL THEN 'none' WHEN hi.rid = rc.rid THEN '0' WHEN lo.xid IS NULL AND hi.op = 'insert' THEN '1' WHEN lo.xid IS NULL THEN '1w'
         WHEN lo.pos = hi.pos THEN '2' WHEN lo.raw_run = hi.raw_run THEN '3' ELSE '4' END AS rule
  FROM rc LEFT JOIN hi ON hi.seq = rc.seq AND hi.col = rc.col LEFT JOIN lo ON lo.seq = rc.seq AND lo.col = rc.col),
ww AS (SELECT r.rid, r.tbn, r.pk, r.col, r.seq AS read_seq, v.xid AS writer_xid, v.rid AS writer, v.vtext, r.rule FROM ruled r JOIN v ON v.tbn = r.tbn AND v.pk = r.pk AND v.col = r.col AND v.xid >= r.xmin AND v.xid < r.xmax WHERE r.rule IN ('1w', '4')),
found AS (
  SELECT rid, tbn, pk, col, seq AS read_seq, CASE WHEN rule IN ('2', '4') THEN low_xid ELSE high_xid END AS latest_xid, CASE WHEN rule IN ('2', '4') THEN low_rid ELSE high_rid END AS latest_rid,
         CASE WHEN rule IN ('2', '4') THEN low_origin ELSE high_origin END AS origin_rid, CASE WHEN rule IN ('2', '4') THEN low_text ELSE high_text END AS vtext, rule <> '4' AS certain, rule
  FROM ruled WHERE rule IN ('0', '1', '2', '3', '4')
  UNION ALL SELECT rid, tbn, pk, col, read_seq, writer_xid, writer, writer, vtext, false, rule FROM ww),
candidates AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY rid, tbn, pk, col, latest_xid, certain ORDER BY read_seq, rule) = 1),
links AS (SELECT rid AS child, tbn, pk, col, origin_rid AS parent, latest_rid AS latest, vtext AS value, certain, read_seq FROM candidates WHERE rid <> origin_rid)
"""

TRACE = SNAPSHOT + """,
reach AS (SELECT rid FROM root UNION SELECT links.parent FROM reach JOIN links ON links.child = reach.rid AND links.certain),
trace_links AS (SELECT * FROM links WHERE child IN (SELECT rid FROM reach))
"""

ROWS = LOGS + """,
first_reads AS (SELECT * FROM reads QUALIFY row_number() OVER (PARTITION BY rid, tbn, pk ORDER BY time, seq) = 1),
row_found AS (SELECT r.rid, r.tbn, r.pk, r.time, max(w.line) AS line FROM first_reads r JOIN row_writes w ON w.tbn = r.tbn AND w.pk = r.pk AND w.time <= r.time GROUP BY ALL),
row_links AS (SELECT f.rid AS child, f.tbn, f.pk, w.rid AS parent, f.time AS read_time, w.time AS write_time FROM row_found f JOIN row_writes w ON w.tbn = f.tbn AND w.pk = f.pk AND w.line = f.line WHERE f.rid <> w.rid)
"""

POLICY = LOGS + """,
parts AS (SELECT rid, method, unnest(string_split(path, '/')) AS part, generate_subscripts(string_split(path, '/'), 1) AS place FROM requests),
ends AS (SELECT rid, method || ' ' || string_agg(CASE WHEN regexp_full_match(part, '[0-9]+') THEN '{id}' ELSE part END, '/' ORDER BY place) AS endpoint FROM parts GROUP BY rid, method),
size AS (SELECT count(DISTINCT rid) AS n, count(DISTINCT endpoint) AS m FROM ends),
acc AS (SELECT a.*, endpoint FROM (SELECT rid, tbn, pk, false AS is_write FROM reads UNION ALL SELECT rid, tbn, pk, true FROM row_writes) a JOIN ends USING (rid)),
tm0 AS (SELECT tbn, count(DISTINCT rid) AS request_count, count(DISTINCT endpoint) AS endpoint_count, count(DISTINCT CASE WHEN NOT is_write THEN rid END) AS nr, count(DISTINCT CASE WHEN is_write THEN rid END) AS nw FROM acc GROUP BY tbn),
tm AS (SELECT tbn, request_count, endpoint_count, nw AS write_request_count, request_count / n AS request_coverage, endpoint_count / greatest(m, 1) AS endpoint_coverage,
              least(nr, nw) / greatest(nr, nw, 1) AS rw_balance, nw / n AS write_request_coverage FROM tm0, size),
rm AS (SELECT tbn, pk, request_count, endpoint_count, write_fanout, request_count / n AS request_coverage, endpoint_count / greatest(m, 1) AS endpoint_coverage FROM
       (SELECT tbn, pk, count(DISTINCT rid) AS request_count, count(DISTINCT endpoint) AS endpoint_count, count(DISTINCT CASE WHEN is_write THEN rid END) AS write_fanout FROM acc GROUP BY tbn, pk), size),
lim AS (SELECT greatest((SELECT quantile_cont(request_coverage, 0.9) FROM tm), 0.2) AS tc, greatest((SELECT quantile_cont(endpoint_coverage, 0.9) FROM tm), 0.3) AS te, 0.2::DOUBLE AS rc,
               greatest((SELECT quantile_cont(endpoint_coverage, 0.9) FROM rm), 0.3) AS re, 3.0::DOUBLE AS am, 3.0::DOUBLE AS wf),
cr AS (SELECT tbn, pk, CASE WHEN request_coverage >= rc AND endpoint_coverage >= re THEN 'block' WHEN write_fanout >= wf THEN 'gray' ELSE 'keep' END AS verdict,
              (least(request_coverage / rc, 1) + least(endpoint_coverage / re, 1)) / 2 AS noise_score FROM rm, lim)
"""

#: JSON records as the loaders are to read them: line numbers, keys, numbers that are missing.
LOADED = """
rl AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS line, CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END AS keys, CASE WHEN event_id % 8 <> 1 THEN event_id - (k % 50) * 20 END AS lower,
       CASE WHEN event_id % 8 <> 1 AND event_id % 17 <> 0 THEN event_id END AS upper FROM e WHERE event_type IN ('view', 'click')),
rg AS (SELECT *, coalesce(CASE WHEN event_id % 3 <> 0 THEN event_id END, sum(keys) OVER (ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seq FROM rl WHERE (lower IS NULL) = (upper IS NULL)),
both_keys AS (SELECT unnest([0, 1]) AS i),
loaded AS (SELECT rid, tbn, CAST(user_id + i AS VARCHAR) AS pk, CAST(seq AS BIGINT) AS seq, time, lower AS xmin, upper AS xmax, line, CAST(event_id % 5 AS VARCHAR) AS seen_text,
           CASE WHEN event_id % 4 = 1 AND event_id % 5 <> 0 THEN 'c' || CASE WHEN event_id % 7 = 0 THEN 9 ELSE k % 3 END END AS seen_col FROM rg, both_keys WHERE i < keys),
wl AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS line, 1 + event_id % 2 AS n FROM e WHERE event_type IN ('signup', 'purchase', 'error')),
wg AS (SELECT *, CAST(coalesce(CASE WHEN event_id % 3 = 0 THEN event_id END, sum(n) OVER (ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS number FROM wl)
"""

#: What logged reads may have seen: by snapshot where they have bounds, else by time; some tell the value they saw.
OBSERVED = HISTORY + ", " + LOADED + """,
lc AS (SELECT *, row_number() OVER (ORDER BY line, pk, col) AS id FROM (
  SELECT l.rid, l.tbn, l.pk, l.seq, l.time, l.xmin, l.xmax, l.line, c.col, NULL AS seen FROM loaded l LEFT JOIN cells c ON c.tbn = l.tbn AND c.pk = l.pk WHERE l.seen_col IS NULL
  UNION ALL SELECT rid, tbn, pk, seq, time, xmin, xmax, line, seen_col, seen_text FROM loaded WHERE seen_col IS NOT NULL)),
b AS (SELECT r.id, max(v.pos) FILTER (v.xid < r.xmax) AS high, max(v.pos) FILTER (v.xid < r.xmin) AS low, max(v.pos) FILTER (v.time <= r.time) AS latest
      FROM lc r JOIN v ON v.tbn = r.tbn AND v.pk = r.pk AND v.col = r.col GROUP BY r.id),
x AS (
  SELECT r.*, h.xid AS h_xid, h.origin_rid AS h_origin, h.vtext AS h_text, l.xid AS l_xid, l.origin_rid AS l_origin, l.vtext AS l_text, t.xid AS t_xid, t.origin_rid AS t_origin, t.vtext AS t_text,
    CASE WHEN r.xmin IS NULL AND t.xid IS NULL THEN 'none' WHEN r.xmin IS NULL THEN 'time' WHEN h.xid IS NULL THEN 'none' WHEN h.rid = r.rid THEN '0' WHEN l.xid IS NULL AND h.op = 'insert' THEN '1' WHEN l.xid IS NULL THEN '1w'
         WHEN l.pos = h.pos THEN '2' WHEN l.raw_run = h.raw_run THEN '3' ELSE '4' END AS rule
  FROM lc r LEFT JOIN b USING (id)
  LEFT JOIN v h ON h.tbn = r.tbn AND h.pk = r.pk AND h.col = r.col AND h.pos = b.high AND (h.next_delete IS NULL OR h.next_delete >= r.xmax)
  LEFT JOIN v l ON l.tbn = r.tbn AND l.pk = r.pk AND l.col = r.col AND l.pos = b.low AND (l.next_delete IS NULL OR l.next_delete >= r.xmin)
  LEFT JOIN (SELECT v.*, (SELECT min(d.time) FROM deletes d WHERE d.tbn = v.tbn AND d.pk = v.pk AND d.time >= v.time) AS gone FROM v) t
    ON t.tbn = r.tbn AND t.pk = r.pk AND t.col = r.col AND t.pos = b.latest AND (t.gone IS NULL OR t.gone > r.time)),
attempts AS (
  SELECT id, rid, tbn, pk, col, seq, time, seen, CASE WHEN rule = 'time' THEN t_xid WHEN rule IN ('2', '4') THEN l_xid ELSE h_xid END AS latest_xid, CASE WHEN rule = 'time' THEN t_origin WHEN rule IN ('2', '4') THEN l_origin ELSE h_origin END AS origin_rid,
         CASE WHEN rule = 'time' THEN t_text WHEN rule IN ('2', '4') THEN l_text ELSE h_text END AS vtext, rule <> '4' AS certain, rule FROM x WHERE rule NOT IN ('none', '1w')
  UNION ALL SELECT id, x.rid, x.tbn, x.pk, x.col, seq, x.time, seen, v.xid, v.rid, v.vtext, false, rule FROM x JOIN v ON v.tbn = x.tbn AND v.pk = x.pk AND v.col = x.col AND v.xid >= x.xmin AND v.xid < x.xmax WHERE rule IN ('1w', '4')),
m AS (SELECT *, min(latest_xid) OVER (PARTITION BY id) = max(latest_xid) OVER (PARTITION BY id) AND seen IS NOT NULL AS settled FROM attempts WHERE seen IS NULL OR seen = vtext),
c AS (SELECT rid, tbn, pk, col, seq AS read_seq, time, latest_xid, origin_rid, certain OR settled AS certain, CASE WHEN settled AND NOT certain THEN 'observed' ELSE rule END AS rule FROM m)
"""

#: Tables by their real amplification.
CLASSES = """ct AS (SELECT tbn, request_coverage >= tc AND endpoint_coverage >= te AND coalesce(amplification, 0) >= am AND rw_balance > 0 AND write_request_coverage < 0.1 AS block,
  (least(request_coverage / tc, 1) + least(endpoint_coverage / te, 1) + least(coalesce(amplification, 0) / am, 1) + least(rw_balance * 2, 1)) / 4 AS noise_score FROM tm LEFT JOIN amp USING (tbn), lim)"""

#: Rows written by seven requests or more are shown, but followed only from the root.
GRAY = "gray AS (SELECT tbn, pk FROM (SELECT tbn, pk, rid FROM row_writes WHERE rid IN (SELECT rid FROM requests)) GROUP BY tbn, pk HAVING count(DISTINCT rid) >= 7)"

#: Budgets: fixed ones up to the last rank, shares of it, and the one that finds all gold requests.
_CURVE = """ranked AS (SELECT rid, CAST(substr(rid, 2) AS BIGINT) + 1 AS rank FROM requests), full_budget AS (SELECT max(rank) AS total FROM ranked),
budgets AS (
  SELECT DISTINCT budget FROM (
    SELECT 0 AS budget UNION ALL SELECT total FROM full_budget UNION ALL SELECT max(rank) FROM ranked JOIN gold USING (rid)
    UNION ALL SELECT b FROM (SELECT unnest([1, 2, 5, 10, 25, 50, 100, 200, 500, 1000]) AS b), full_budget WHERE b <= total
    UNION ALL SELECT least(total, greatest(1, CAST(round_even(total * p / 100.0, 0) AS BIGINT))) FROM (SELECT unnest([1, 5, 10, 25, 50, 75, 100]) AS p), full_budget)),
curve AS (SELECT b.budget, count(r.rid) AS predicted, count(g.rid) AS tp, (SELECT count(*) FROM gold) AS total FROM budgets b LEFT JOIN ranked r ON r.rank <= b.budget LEFT JOIN gold g ON g.rid = r.rid GROUP BY b.budget),
scored AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p, CASE WHEN total > 0 THEN tp / total ELSE 0 END AS r FROM curve)"""

_CDC = """
raw AS (SELECT event_id // 5 AS n, event_id, event_type, 't' || CAST(event_id % 4 AS VARCHAR) AS tbn, user_id, CAST(floor(value) AS INT) % 3 AS v, CASE WHEN event_id % 11 = 0 THEN user_id + 1 ELSE user_id END AS old_id, event_id % 3 AS old_v
        FROM events WHERE event_id % 4 < 3 AND (event_id // 5) % 7 <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY event_id) - 1 AS seq, 'id=' || user_id || ',v=' || v AS whole FROM raw),
cdc AS (
  SELECT n, seq, tbn, 'insert' AS event, user_id AS pk, whole AS cells FROM numbered WHERE event_type = 'signup'
  UNION ALL SELECT n, seq, tbn, 'delete', old_id, '' FROM numbered WHERE event_type = 'error'
  UNION ALL SELECT n, seq, tbn, 'update', user_id, CASE WHEN v <> old_v THEN 'v=' || v ELSE '' END FROM numbered WHERE event_type NOT IN ('signup', 'error') AND old_id = user_id
  UNION ALL SELECT n, seq, tbn, 'delete', old_id, '' FROM numbered WHERE event_type NOT IN ('signup', 'error') AND old_id <> user_id
  UNION ALL SELECT n, seq, tbn, 'insert', user_id, whole FROM numbered WHERE event_type NOT IN ('signup', 'error') AND old_id <> user_id)
"""


#: Requests that each variant of a policy reaches and the links that it shows; needs kinds (variant) and grayv (variant, tbn, pk).
_VARIANTS = """
vreach AS (
  SELECT variant, rid, true AS is_root FROM kinds, root
  UNION SELECT g.variant, l.parent, false FROM vreach g JOIN links l ON l.child = g.rid AND l.certain
  WHERE g.is_root OR NOT EXISTS (SELECT 1 FROM grayv WHERE grayv.variant = g.variant AND grayv.tbn = l.tbn AND grayv.pk = l.pk)),
shownv AS (SELECT g.variant, l.*, y.tbn IS NOT NULL AND l.child NOT IN (SELECT rid FROM root) AS context FROM (SELECT DISTINCT variant, rid FROM vreach) g JOIN links l ON l.child = g.rid
           LEFT JOIN grayv y ON y.variant = g.variant AND y.tbn = l.tbn AND y.pk = l.pk),
predv AS (SELECT variant, rid FROM kinds, root UNION SELECT variant, child FROM shownv WHERE certain UNION SELECT variant, parent FROM shownv WHERE certain),
cv AS (SELECT variant, count(*) AS predicted, count(g.rid) AS tp FROM predv LEFT JOIN gold g USING (rid) GROUP BY variant),
lv AS (SELECT variant, count(*) AS links, count(*) FILTER (NOT certain) AS uncertain_no_recurse, count(*) FILTER (context) AS gray_no_recurse FROM shownv GROUP BY variant),
sv AS (SELECT cv.*, coalesce(links, 0) AS links, coalesce(uncertain_no_recurse, 0) AS uncertain_no_recurse, coalesce(gray_no_recurse, 0) AS gray_no_recurse, (SELECT count(*) FROM gold) AS gold,
              tp / predicted AS p, CASE WHEN (SELECT count(*) FROM gold) > 0 THEN tp / (SELECT count(*) FROM gold) ELSE 0 END AS r FROM cv LEFT JOIN lv USING (variant))
"""

_SCORED = "SELECT variant, tp, predicted - tp AS fp, gold - tp AS fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, links, uncertain_no_recurse, gray_no_recurse FROM sv"


def _after_logs(parts: str) -> str:
    return parts.removeprefix(LOGS).lstrip().removeprefix(",")


def _with(parts: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts} {select}"


def _markers(markers: tuple[str, ...], text: str, most: int, yes: str, no: str, table: str, key: str) -> str:
    listed = ", ".join("'" + m.replace("'", "''") + "'" for m in markers)
    found = f"list_filter([{listed}], lambda m: contains(lower(coalesce({text}, '')), m))"
    return f"SELECT {key}, len(f) > 0 AS tainted, CASE WHEN len(f) > 0 THEN '{yes}' ELSE '{no}' END AS confidence, array_to_string(f[1:{most}], ',') AS evidence FROM (SELECT {key}, {found} AS f FROM {table})"


def _oracle() -> dict[str, str]:
    from backtide.operators.taint import CELL_MARKERS, ROW_MARKERS
    from backtide.plans.variants import ABLATION, scan_parameters

    cell = "tbn, pk, col"
    path = "regexp_extract(regexp_replace(url, '^[a-z]+://[^/]*', ''), '^[^?#]*')"
    scores = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r"
    final = "SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1"
    compared = "compared AS (SELECT coalesce(a.rid, b.rid) AS rid, CASE WHEN a.rid IS NULL THEN 'missing' WHEN b.rid IS NULL THEN 'extra' ELSE 'hit' END AS status FROM reach a FULL JOIN gold b ON a.rid = b.rid)"
    counted = "counted AS (SELECT count(*) FILTER (status = 'hit') AS tp, count(*) FILTER (status = 'extra') AS fp, count(*) FILTER (status = 'missing') AS fn FROM compared)"
    link = f"child, {cell}, parent, latest, certain, read_seq"
    fan = "fan AS (SELECT rid, count(DISTINCT tbn || '.' || pk) AS fanout FROM reads GROUP BY rid)"
    ident = "ident AS (SELECT w.rid, coalesce(c.user_id, 'request:' || w.rid) AS u, coalesce(c.api_id, 'unknown-api') AS a FROM (SELECT DISTINCT rid FROM writes) w LEFT JOIN contexts c USING (rid))"
    div = f"div AS (SELECT {cell}, count(DISTINCT u || '|' || a) AS diversity FROM v JOIN ident ON ident.rid = v.raw_rid GROUP BY {cell})"
    hist = f"hist AS (SELECT {cell}, count(*) AS history FROM writes GROUP BY {cell})"
    breadth = "breadth AS (SELECT rid, r.tbn, count(DISTINCT r.pk) AS table_rows, greatest(count(DISTINCT r.pk || '.' || c.col), 1) AS table_cells FROM (SELECT DISTINCT rid, tbn, pk FROM reads) r LEFT JOIN cells c ON c.tbn = r.tbn AND c.pk = r.pk GROUP BY rid, r.tbn)"
    gray_reach = "greach AS (SELECT rid, true AS is_root FROM root UNION SELECT l.parent, false FROM greach g JOIN {links} l ON l.child = g.rid {certain} WHERE g.is_root OR NOT EXISTS (SELECT 1 FROM gray WHERE gray.tbn = l.tbn AND gray.pk = l.pk))"
    # Nodes of traces of at most four steps, for each blocked table ('' for none) and root.
    sizes = (
        "{roots}, starts AS (SELECT b.blocked, r.rid AS root FROM roots r, (SELECT '' AS blocked UNION ALL SELECT DISTINCT tbn FROM reads) b), "
        "steps AS (SELECT blocked, root, root AS rid, 0 AS depth FROM starts UNION SELECT s.blocked, s.root, l.parent, s.depth + 1 FROM steps s JOIN row_links l ON l.child = s.rid AND l.tbn <> s.blocked WHERE s.depth < 4), "
        "used AS (SELECT DISTINCT s.blocked, s.root, l.parent, l.tbn, l.pk FROM steps s JOIN row_links l ON l.child = s.rid AND l.tbn <> s.blocked WHERE s.depth < 4), "
        "nodes AS (SELECT blocked, root, 'q' || parent AS node FROM used UNION SELECT blocked, root, 'd' || tbn || '|' || pk FROM used), "
        "sizes AS (SELECT s.blocked, s.root, count(n.node) AS size FROM starts s LEFT JOIN nodes n ON n.blocked = s.blocked AND n.root = s.root GROUP BY ALL)"
    )
    every = sizes.replace("{roots}", "roots AS (SELECT DISTINCT rid FROM reads)")
    # 128 reading requests at even distances in order of time stand for all where a policy is learned.
    even = sizes.replace("{roots}", "reading AS (SELECT rid, row_number() OVER (ORDER BY time, rid) - 1 AS place, count(*) OVER () AS total FROM requests WHERE rid IN (SELECT rid FROM reads)), "
        "roots AS (SELECT rid FROM reading WHERE total <= 128 OR place IN (SELECT CAST(round_even(i * (total - 1) / 127.0, 0) AS BIGINT) FROM range(128) x(i)))")
    means = "means AS (SELECT blocked, avg(size) AS mean FROM sizes GROUP BY blocked), amp AS (SELECT m.blocked AS tbn, b.mean / greatest(m.mean, 1) AS amplification FROM means m, means b WHERE b.blocked = '' AND m.blocked <> '')"
    learned = f"{POLICY}, {ROWS.removeprefix(LOGS).lstrip().removeprefix(',')}, {even}, {means}, {CLASSES}"
    ablated = ", ".join(f"('{name}', {a}, {b}, {c})" for name, (a, b, c) in ABLATION.items())
    ablation = (
        f"{SNAPSHOT}, {_after_logs(POLICY)}, kinds AS (SELECT * FROM (VALUES {ablated}) AS k(variant, of_tables, of_blocked, of_gray)), vt AS (SELECT tbn FROM tm, lim WHERE request_coverage >= tc), "
        "vr AS (SELECT tbn, pk, write_fanout >= 9 AS blocked FROM rm WHERE write_fanout >= 6), grayv AS (SELECT variant, tbn, pk FROM kinds, vr WHERE (blocked AND of_blocked) OR (NOT blocked AND of_gray) "
        f"UNION SELECT variant, tbn, pk FROM kinds, (SELECT DISTINCT tbn, pk FROM cells) JOIN vt USING (tbn) WHERE of_tables), {_VARIANTS}"
    )
    scan = ", ".join(f"('{name}', {v.q}, {v.table_request_floor}, {v.table_endpoint_floor}, {v.row_request_threshold}, {v.row_endpoint_floor}, {v.amplification_threshold}, {v.write_fanout_threshold}, {v.write_request_guard})" for name, v in scan_parameters().items())
    shares = " UNION ALL ".join(
        f"SELECT {q}::DOUBLE AS q, (SELECT quantile_cont(request_coverage, {q}) FROM tm) AS pt, (SELECT quantile_cont(endpoint_coverage, {q}) FROM tm) AS pe, (SELECT quantile_cont(endpoint_coverage, {q}) FROM rm) AS pr" for q in sorted({v.q for v in scan_parameters().values()})
    )
    sensitivity = (
        f"{SNAPSHOT}, {_after_logs(POLICY)}, {_after_logs(ROWS)}, {every}, {means}, kinds AS (SELECT variant, q::DOUBLE AS q, trf::DOUBLE AS trf, tef::DOUBLE AS tef, rrt::DOUBLE AS rrt, ref::DOUBLE AS ref, amt::DOUBLE AS amt, wft::DOUBLE AS wft, guard::DOUBLE AS guard "
        f"FROM (VALUES {scan}) AS k(variant, q, trf, tef, rrt, ref, amt, wft, guard)), shares AS ({shares}), levels AS (SELECT * FROM kinds JOIN shares USING (q)), "
        "bt AS (SELECT variant, tbn FROM levels, (SELECT * FROM tm LEFT JOIN amp USING (tbn)) t WHERE request_coverage >= greatest(pt, trf) AND endpoint_coverage >= greatest(pe, tef) AND coalesce(amplification, 0) >= amt AND rw_balance > 0 AND write_request_coverage < guard), "
        "grayv AS (SELECT variant, tbn, pk FROM levels, rm WHERE (request_coverage >= rrt AND endpoint_coverage >= greatest(pr, ref)) OR write_fanout >= wft "
        f"UNION SELECT variant, tbn, pk FROM bt JOIN (SELECT DISTINCT tbn, pk FROM cells) USING (tbn)), {_VARIANTS}"
    )
    bulk = "bulk AS (SELECT rid FROM (SELECT DISTINCT rid, tbn, pk FROM row_writes) GROUP BY rid HAVING count(*) >= 3), kept AS (SELECT * FROM row_links WHERE parent NOT IN (SELECT rid FROM bulk))"
    compared_rows = (
        f"{ROWS}, {GRAY}, {bulk}, {gray_reach.format(links='kept', certain='')}, rawreach AS (SELECT rid FROM root UNION SELECT l.parent FROM rawreach g JOIN kept l ON l.child = g.rid), "
        "rawl AS (SELECT child, tbn, pk, parent FROM kept WHERE child IN (SELECT rid FROM rawreach)), "
        "prl AS (SELECT child, tbn, pk, parent, (tbn, pk) IN (SELECT tbn, pk FROM gray) AND child NOT IN (SELECT rid FROM root) AS context FROM kept WHERE child IN (SELECT rid FROM greach)), "
        "dropped AS (SELECT child, tbn, pk, parent FROM row_links WHERE parent IN (SELECT rid FROM bulk) AND child IN (SELECT rid FROM greach))"
    )
    return {
        "ablation": _with(ablation, _SCORED, True),
        "sensitivity": _with(sensitivity, _SCORED, True),
        "raw_against_pruned": _with(compared_rows, ", n AS (SELECT (SELECT count(*) FROM (SELECT rid FROM root UNION SELECT child FROM rawl UNION SELECT parent FROM rawl)) AS raw_requests, (SELECT count(*) FROM rawl) AS raw_links, "
            "(SELECT count(*) FROM (SELECT rid FROM root UNION SELECT child FROM prl UNION SELECT parent FROM prl)) AS pruned_requests, (SELECT count(*) FROM prl) AS pruned_links, (SELECT count(*) FROM prl WHERE context) AS context_only, (SELECT count(*) FROM dropped) AS bulk_suppressed) "
            "SELECT raw_requests, raw_links, pruned_requests, pruned_links, round(1 - (pruned_requests + pruned_links) / (raw_requests + raw_links), 6) AS graph_reduction, context_only, bulk_suppressed FROM n", True),
        "raw_only_links": _with(compared_rows, "SELECT * FROM rawl WHERE child NOT IN (SELECT rid FROM greach)", True),
        "suppressed_examples": _with(compared_rows, "SELECT child, tbn, pk, parent, reason FROM (SELECT *, 'bulk-writer' AS reason FROM dropped UNION ALL SELECT child, tbn, pk, parent, 'gray-no-recurse' FROM prl WHERE context) QUALIFY row_number() OVER (PARTITION BY reason ORDER BY child, tbn, pk, parent) <= 20", True),
        "suppression_ledger": _with(f"{SNAPSHOT}, {GRAY}, {gray_reach.format(links='links', certain='AND l.certain')}", f", f AS (SELECT *, NOT certain AS uncertain_no_recurse, (tbn, pk) IN (SELECT tbn, pk FROM gray) AND child NOT IN (SELECT rid FROM root) AS gray_no_recurse FROM links WHERE child IN (SELECT rid FROM greach)) "
            f"SELECT child, {cell}, parent, read_seq, uncertain_no_recurse, gray_no_recurse FROM f WHERE uncertain_no_recurse OR gray_no_recurse", True),
        "normalize_names": "SELECT event_id, event_type AS tbn, upper(event_type[1]) || event_type[2:] AS tbn_cased, 'public.app.' || event_type AS col FROM events",
        "path_template": f"SELECT page_id, CASE WHEN t = '' THEN '/' ELSE t END AS template FROM (SELECT page_id, regexp_replace(array_to_string(list_transform(string_split({path}, '/'), lambda p: CASE WHEN regexp_full_match(p, '[0-9]+') THEN '{{id}}' "
        "WHEN regexp_full_match(p, '(?i)[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}') THEN '{uuid}' WHEN regexp_full_match(p, '[0-9A-Fa-f]{16,}|[0-9A-Za-z_-]{24,}') THEN '{token}' ELSE p END), '/'), '/+$', '') AS t FROM pages)",
        "logged_path": f"SELECT page_id, array_to_string(list_transform(string_split({path}, '/'), lambda p: CASE WHEN regexp_full_match(p, '[0-9]+') THEN '{{id}}' ELSE p END), '/') || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS logged FROM (SELECT *, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages)",
        "identity_ladder": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'u' || user_id WHEN 1 THEN 'a' || user_id WHEN 2 THEN 'session:' || substr(sha256('c' || user_id), 1, 24) ELSE 'request:' || event_id END AS who FROM events",
        "typed_runs": _with(HISTORY, f"SELECT {cell}, xid, pos, CAST(raw_run AS BIGINT) AS raw_run, 'int' AS vtype, vtext FROM v"),
        "origin_of_run": _with(HISTORY, f"SELECT {cell}, xid, raw_rid AS origin_rid, raw_pos AS origin_pos FROM v"),
        "delete_adjusted_origin": _with(HISTORY, f"SELECT {cell}, xid, origin_rid, origin_pos, coalesce(next_delete, -1) AS next_delete FROM v"),
        "last_write_per_xid": _with(LOGS, f"SELECT {cell}, xid // 200 AS xid, max(line) AS line FROM writes GROUP BY {cell}, xid // 200"),
        "asof_time_cell": _with(HISTORY, ", t0 AS (SELECT rc.seq, rc.col, max(v.pos) AS pos FROM rc JOIN v ON v.tbn = rc.tbn AND v.pk = rc.pk AND v.col = rc.col AND v.time <= rc.time GROUP BY ALL) "
            "SELECT rc.rid, rc.tbn, rc.pk, rc.col, rc.seq AS read_seq, v.xid AS latest_xid, v.rid AS latest_rid, v.origin_rid FROM t0 JOIN rc USING (seq, col) JOIN v ON v.tbn = rc.tbn AND v.pk = rc.pk AND v.col = rc.col AND v.pos = t0.pos "
            "WHERE NOT EXISTS (SELECT 1 FROM deletes d WHERE d.tbn = rc.tbn AND d.pk = rc.pk AND d.time >= v.time AND d.time <= rc.time)"),
        "asof_time_row": _with(ROWS, "SELECT child, tbn, pk, parent, CAST(read_time AS VARCHAR) AS read_time, CAST(write_time AS VARCHAR) AS write_time FROM row_links"),
        "asof_xid_low_high": _with(SNAPSHOT, f"SELECT rid, {cell}, seq AS read_seq, coalesce(low_xid, -1) AS low_xid, coalesce(high_xid, -1) AS high_xid FROM ruled"),
        "snapshot_rules": _with(SNAPSHOT, "SELECT rule, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs FROM ruled GROUP BY rule"),
        "snapshot_window_writers": _with(SNAPSHOT, f"SELECT rid, {cell}, read_seq, writer_xid, rule FROM ww"),
        "observed_disambiguation": _with(SNAPSHOT, f", k AS (SELECT *, CASE WHEN read_seq % 3 = 0 THEN CAST(read_seq % 4 AS VARCHAR) END AS seen FROM candidates), m AS (SELECT *, count(*) OVER (PARTITION BY rid, {cell}, read_seq) AS n FROM k WHERE seen IS NULL OR seen = vtext) "
            f"SELECT rid, {cell}, read_seq, latest_xid, certain OR (seen IS NOT NULL AND n = 1) AS certain, seen IS NOT NULL AND NOT certain AND n = 1 AS observed FROM m"),
        "request_candidates": _with(SNAPSHOT, f"SELECT rid, {cell}, read_seq, latest_xid, origin_rid, certain, rule FROM candidates"),
        "candidate_order": _with(SNAPSHOT, f"SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY time, {cell}, certain DESC, latest_xid) - 1 AS place, {cell}, read_seq, latest_xid FROM (SELECT c.*, r.time FROM candidates c JOIN reads r ON r.seq = c.read_seq)"),
        "unresolved_cells": _with(SNAPSHOT, f"SELECT DISTINCT r.rid, r.tbn, r.pk, c.col FROM reads r LEFT JOIN cells c ON c.tbn = r.tbn AND c.pk = r.pk WHERE c.col IS NULL OR (r.rid, r.tbn, r.pk, c.col) NOT IN (SELECT rid, {cell} FROM candidates)"),
        "loaded_reads": _with(f"{LOGS}, {LOADED}", "SELECT rid, tbn, pk, seq, CAST(time AS VARCHAR) AS time, coalesce(xmin, -1) AS xmin, coalesce(xmax, -1) AS xmax, CASE WHEN seen_col IS NULL THEN '' ELSE seen_col || ':int:' || seen_text END AS seen, line FROM loaded"),
        "loaded_read_errors": _with(f"{LOGS}, {LOADED}", "SELECT line, 'xmin and xmax go together' AS error FROM rl WHERE lower IS NOT NULL AND upper IS NULL"),
        "loaded_writes": _with(f"{LOGS}, {LOADED}", "SELECT rid, tbn, pk, CASE i WHEN 0 THEN col ELSE 'c9' END AS col, CASE event_type WHEN 'signup' THEN 'insert' ELSE 'update' END AS op, 'int' AS vtype, CASE i WHEN 0 THEN CAST(CAST(floor(value / 25) AS INT) AS VARCHAR) ELSE pk END AS vtext, "
            "event_id AS xid, number AS seq, line FROM wg, both_keys WHERE i < n AND event_type <> 'error'"),
        "loaded_deletes": _with(f"{LOGS}, {LOADED}", "SELECT rid, tbn, CASE i WHEN 0 THEN pk ELSE 'x' END AS pk, event_id AS xid, number AS seq, line FROM wg, both_keys WHERE i < n AND event_type = 'error'"),
        "loaded_rows": _with(f"{LOGS}, {LOADED}", "SELECT rid, tbn, CAST(user_id + i AS VARCHAR) AS pk, 'select' AS event, line FROM rl, both_keys WHERE keys = 2"),
        "observed_candidates": _with(OBSERVED, f"SELECT rid, {cell}, read_seq, latest_xid, origin_rid, certain, rule FROM c QUALIFY row_number() OVER (PARTITION BY rid, {cell}, latest_xid, certain ORDER BY read_seq, time, rule) = 1"),
        "unresolved_reasons": _with(OBSERVED, f"SELECT DISTINCT rid, {cell}, CAST(time AS VARCHAR) AS read_time, CASE WHEN col IS NULL THEN 'row has no available cell write history' WHEN rule <> 'none' THEN 'cell value in the read log does not match any snapshot candidate' "
            "WHEN xmin IS NOT NULL THEN 'no traceable version for this cell before the snapshot upper bound' ELSE 'no traceable version for this cell before the read time' END AS reason "
            "FROM x WHERE col IS NULL OR rule = 'none' OR (seen IS NOT NULL AND id NOT IN (SELECT id FROM m))"),
        "next_alternate": _with(SNAPSHOT, f"SELECT rid, {cell}, read_seq, latest_xid AS xid, CASE WHEN count(*) OVER g > 1 THEN coalesce(lead(latest_xid) OVER o, min(latest_xid) OVER g) ELSE -1 END AS alternate FROM candidates WHERE NOT certain "
            f"WINDOW g AS (PARTITION BY rid, {cell}, read_seq), o AS (PARTITION BY rid, {cell}, read_seq ORDER BY latest_xid)"),
        "earliest_read": _with(LOGS, "SELECT rid, tbn, pk, min(seq) AS seq FROM reads GROUP BY rid, tbn, pk"),
        "latest_read": _with(LOGS, "SELECT rid, tbn, pk, max(seq) AS seq FROM reads GROUP BY rid, tbn, pk"),
        "even_sample": _with(LOGS, "SELECT rid, seq FROM (SELECT rid, seq, row_number() OVER (ORDER BY seq) - 1 AS place, count(*) OVER () AS n FROM reads) WHERE place IN (SELECT CAST(round_even(i * (n - 1) / 15, 0) AS BIGINT) FROM range(16) x(i))"),
        "seed_writers": _with(LOGS, "SELECT 'u' || pk AS rid, count(*) AS rows FROM writes GROUP BY pk HAVING count(*) >= 20"),
        "read_sequence": _with(LOGS, "SELECT rid, seq AS event, row_number() OVER (PARTITION BY rid ORDER BY seq) - 1 AS position FROM reads"),
        "statement_read_set": "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS parts FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) = 1) GROUP BY 1",
        "writer_identities": _with(LOGS, "SELECT w.rid, coalesce(c.user_id, 'request:' || w.rid) AS writer_user, coalesce(c.api_id, 'unknown-api') AS writer_api FROM (SELECT DISTINCT rid FROM writes) w LEFT JOIN (SELECT * FROM contexts WHERE right(rid, 1) <> '3') c USING (rid)"),
        "writer_diversity": _with(f"{HISTORY}, {ident}, {div}", "SELECT * FROM div"),
        "read_fanout": _with(f"{LOGS}, {fan}", "SELECT * FROM fan"),
        "history_count": _with(f"{LOGS}, {hist}", "SELECT * FROM hist"),
        "child_breadth": _with(f"{LOGS}, {breadth}", "SELECT * FROM breadth"),
        "task_scores": _with(f"{SNAPSHOT}, {fan}, {ident}, {div}, {hist}, {breadth}", f", tw AS (SELECT DISTINCT rid, {cell}, read_seq, origin_rid FROM candidates), "
            f"t AS (SELECT tw.rid, {cell}, read_seq, CAST(coalesce(sum(fanout), 0) AS BIGINT) AS fanout FROM tw LEFT JOIN fan ON fan.rid = tw.origin_rid GROUP BY ALL), "
            "x AS (SELECT t.*, diversity, history, table_rows, table_cells, 0.5 / (1 + ln(1 + diversity)) + 0.5 / (1 + ln(1 + fanout)) AS base, (1 + ln(2)) / (1 + ln(1 + history)) AS hp, "
            "CASE WHEN table_rows = 2 THEN 1 ELSE (1 + ln(2)) / (1 + ln(1 + table_rows)) END AS sp, CASE WHEN table_rows = 2 THEN 1 + 1 / (1 + table_cells) ELSE 1 END AS cb "
            f"FROM t JOIN div USING ({cell}) JOIN hist USING ({cell}) JOIN breadth ON breadth.rid = t.rid AND breadth.tbn = t.tbn) "
            f"SELECT rid, {cell}, read_seq, fanout, diversity, history, table_rows, table_cells, round(base * hp * sp * cb, 6) AS priority FROM x"),
        "table_metrics": _with(POLICY, "SELECT tbn, request_count, endpoint_count, write_request_count, round(request_coverage, 6) AS request_coverage, round(endpoint_coverage, 6) AS endpoint_coverage, round(rw_balance, 6) AS rw_balance, round(write_request_coverage, 6) AS write_request_coverage FROM tm"),
        "row_metrics": _with(POLICY, "SELECT tbn, pk, request_count, endpoint_count, write_fanout, round(request_coverage, 6) AS request_coverage, round(endpoint_coverage, 6) AS endpoint_coverage FROM rm"),
        "thresholds": _with(POLICY, "SELECT round(tc, 6) AS tc, round(te, 6) AS te, round(rc, 6) AS rc, round(re, 6) AS re, round(am, 6) AS am, round(wf, 6) AS wf FROM lim"),
        "classify_tables": _with(learned, "SELECT tbn, block, round(noise_score, 6) AS noise_score FROM ct", True),
        "classify_rows": _with(POLICY, "SELECT tbn, pk, verdict, round(noise_score, 6) AS noise_score FROM cr"),
        "policy_decide": _with(learned, "SELECT tbn, pk, CASE WHEN (tbn, pk) IN (SELECT tbn, pk FROM cr WHERE verdict <> 'keep') OR tbn IN (SELECT tbn FROM ct WHERE block) THEN 'gray' ELSE 'keep' END AS decision FROM (SELECT DISTINCT tbn, pk FROM reads)", True),
        "trace_size_d4": _with(f"{ROWS}, {every}", "SELECT root AS rid, size FROM sizes WHERE blocked = ''", True),
        "amplification": _with(f"{ROWS}, {every}, {means}", "SELECT tbn, round(amplification, 6) AS amplification FROM amp", True),
        "basic_trace_links": _with(TRACE, f"SELECT {link} FROM trace_links", True),
        "basic_trace_requests": _with(TRACE, "SELECT rid FROM reach", True),
        "pruned_trace_links": _with(f"{SNAPSHOT}, {GRAY}, {gray_reach.format(links='links', certain='AND l.certain')}", f"SELECT {link} FROM links WHERE child IN (SELECT rid FROM greach)", True),
        "taint_trace": _with(f"{SNAPSHOT}, tl AS (SELECT * FROM links WHERE value <> '0'), treach AS (SELECT rid FROM root UNION SELECT tl.parent FROM treach JOIN tl ON tl.child = treach.rid AND tl.certain)", f"SELECT {link} FROM tl WHERE child IN (SELECT rid FROM treach)", True),
        "row_trace_links": _with(f"{ROWS}, rreach AS (SELECT rid FROM root UNION SELECT l.parent FROM rreach JOIN row_links l ON l.child = rreach.rid)", "SELECT child, tbn, pk, parent FROM row_links WHERE child IN (SELECT rid FROM rreach)", True),
        "row_pruned_trace": _with(f"{ROWS}, {GRAY}, kept AS (SELECT * FROM row_links WHERE parent NOT IN (SELECT rid FROM (SELECT DISTINCT rid, tbn, pk FROM row_writes) GROUP BY rid HAVING count(*) >= 3)), {gray_reach.format(links='kept', certain='')}", "SELECT child, tbn, pk, parent FROM kept WHERE child IN (SELECT rid FROM greach)", True),
        "simple_paths_bounded": _with(f"{SNAPSHOT}, ce AS (SELECT DISTINCT child, parent FROM links WHERE certain), paths AS (SELECT [rid] AS path FROM root UNION ALL SELECT list_append(path, parent) FROM paths JOIN ce ON ce.child = path[-1] AND NOT list_contains(path, parent) WHERE len(path) < 5)", "SELECT array_to_string(path, '>') AS path FROM paths WHERE len(path) > 1", True),
        "cycle_paths": _with(f"{SNAPSHOT}, ce AS (SELECT DISTINCT child, parent FROM links WHERE certain), paths AS (SELECT [rid] AS path, CAST(NULL AS VARCHAR) AS ended FROM root "
            "UNION ALL SELECT CASE WHEN ce.parent IS NULL OR (len(path) = 4 AND NOT list_contains(path, ce.parent)) THEN path WHEN list_contains(path, ce.parent) THEN list_append(path, '(cycle: ' || ce.parent || ')') ELSE list_append(path, ce.parent) END, "
            "CASE WHEN ce.parent IS NULL THEN 'leaf' WHEN list_contains(path, ce.parent) THEN 'cycle' WHEN len(path) = 4 THEN 'cut' END FROM paths LEFT JOIN ce ON ce.child = path[-1] WHERE ended IS NULL)",
            "SELECT DISTINCT array_to_string(path, '>') AS path, ended FROM paths WHERE ended IS NOT NULL", True),
        "predecessor_requests": _with(f"{SNAPSHOT}, ce AS (SELECT DISTINCT child, parent FROM links WHERE certain), n AS (SELECT count(*) AS most FROM requests), far AS (SELECT rid, 0 AS level FROM root UNION SELECT ce.parent, level + 1 FROM far JOIN ce ON ce.child = far.rid WHERE level < 60), "
            "near AS (SELECT rid, min(level) AS level FROM far GROUP BY rid)", "SELECT near.rid, level, count(ce.parent) AS dependencies FROM near LEFT JOIN ce ON ce.child = near.rid WHERE level > 0 GROUP BY near.rid, level", True),
        "image_trace_links": _with(f"{ROWS}, il AS (SELECT f.rid AS child, f.tbn, f.pk, w.rid AS parent, coalesce(x.op, 'delete') AS event, CASE WHEN x.op IS NULL THEN '{{}}' ELSE '{{\"' || x.col || '\": ' || x.vtext || '}}' END AS row, coalesce(x.vtext <> '0', true) AS tainted "
            "FROM row_found f JOIN row_writes w ON w.tbn = f.tbn AND w.pk = f.pk AND w.line = f.line LEFT JOIN writes x ON x.line = f.line WHERE f.rid <> w.rid), ireach AS (SELECT rid FROM root UNION SELECT l.parent FROM ireach JOIN il l ON l.child = ireach.rid AND l.tainted)",
            "SELECT child, tbn, pk, parent, event, row, tainted FROM il WHERE child IN (SELECT rid FROM ireach)", True),
        "collapsed_dag": _with(TRACE, "SELECT child, parent, n AS cells, CASE WHEN n = 1 THEN one ELSE n || ' cells' END AS label, uncertain FROM (SELECT child, parent, count(DISTINCT tbn || '.' || pk || '.' || col) AS n, min(tbn || '.' || pk || '.' || col) AS one, bool_or(NOT certain) AS uncertain FROM trace_links GROUP BY child, parent)", True),
        "graph_counts": _with(TRACE, "SELECT count(*) AS links, count(*) FILTER (certain) AS certain_links, count(*) FILTER (NOT certain) AS uncertain_links, count(DISTINCT tbn || '.' || pk || '.' || col) AS cells, count(DISTINCT tbn) AS tables, count(DISTINCT tbn || '.' || pk) AS rows, "
            "(SELECT count(*) FROM (SELECT child FROM trace_links UNION SELECT parent FROM trace_links)) AS requests FROM trace_links", True),
        "taint_markers_cell": _markers(CELL_MARKERS, "html", 3, "high", "medium", "pages", "page_id"),
        "taint_markers_row": _markers(ROW_MARKERS, "text", 5, "medium", "high", "documents", "doc_id"),
        "llm_stub": "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^([a-z]+)://', 1) = 'http' AS tainted FROM pages",
        "precision_recall_f1": _with(f"{TRACE}, {compared}, {counted}, s AS (SELECT *, {scores} FROM counted)", f"{final} FROM s", True),
        "missing_extra": _with(f"{TRACE}, {compared}", "SELECT rid, status FROM compared", True),
        "label_scores": f"WITH counted AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 1 AND toxic <> 0) AS fp, count(*) FILTER (quality <> 1 AND toxic = 0) AS fn FROM labels), s AS (SELECT *, {scores} FROM counted) {final} FROM s",
        "budget_curve": _with(f"{LOGS}, {_CURVE}", "SELECT CAST(budget AS BIGINT) AS budget, predicted, tp, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM scored"),
        "budget_auc": _with(f"{LOGS}, {_CURVE}", "SELECT round(sum(piece) / (max(budget) - min(budget)), 6) AS area FROM (SELECT budget, (budget - lag(budget) OVER (ORDER BY budget)) * (r + lag(r) OVER (ORDER BY budget)) / 2 AS piece FROM scored)"),
        "cdc_cell_flatten": _with(_CDC, "SELECT 'R' || n AS rid, n AS xid, seq, event, tbn, CAST(pk AS VARCHAR) AS pk, cells FROM cdc"),
        "cdc_row_batch": _with(_CDC, "SELECT 'R' || n AS rid, n AS xid, tbn, event, string_agg(CAST(pk AS VARCHAR), ',' ORDER BY seq) AS pks FROM cdc GROUP BY n, tbn, event"),
        "cdc_row_stream": _with(_CDC, ", k AS (SELECT *, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS event, CASE WHEN event_type = 'error' THEN old_id ELSE user_id END AS pk FROM raw) "
            "SELECT 'R' || n AS rid, event, tbn, string_agg(CAST(pk AS VARCHAR), ',' ORDER BY event_id) AS pks, coalesce(string_agg(old_id || '>' || user_id, ',' ORDER BY event_id) FILTER (event = 'update' AND old_id <> user_id), '') AS pk_changes FROM k GROUP BY n, tbn, event"),
        "cdc_table_sets": _with(_CDC, ", one AS (SELECT DISTINCT n, event, CAST(pk AS VARCHAR) AS pk FROM cdc WHERE tbn = 't1') SELECT n AS xid, coalesce(string_agg(pk, ',' ORDER BY pk) FILTER (event = 'insert'), '') AS insert_ids, "
            "coalesce(string_agg(pk, ',' ORDER BY pk) FILTER (event = 'update'), '') AS update_ids, coalesce(string_agg(pk, ',' ORDER BY pk) FILTER (event = 'delete'), '') AS delete_ids FROM one GROUP BY n"),
        "strategy_comparison": "WITH o AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS budget, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders WHERE o_orderstatus IN ('F', 'O')), "
            "r AS (SELECT o_custkey, o_orderstatus, max(budget) AS budget, max(total) AS total FROM o GROUP BY ALL), p AS (SELECT a.budget AS a, b.budget AS b, a.total FROM r a JOIN r b USING (o_custkey) WHERE a.o_orderstatus = 'F' AND b.o_orderstatus = 'O') "
            "SELECT count(*) FILTER (a < b) AS first_wins, count(*) FILTER (a = b) AS ties, count(*) FILTER (a > b) AS second_wins, round(avg(a - b), 6) AS macro_delta, round(1 - sum(a) / sum(total), 6) AS weighted_reduction FROM p",
        "request_times": _with(ROWS, "SELECT rid, CAST(min(time) AS VARCHAR) AS time FROM (SELECT parent AS rid, write_time AS time FROM row_links UNION ALL SELECT child, read_time FROM row_links) GROUP BY rid"),
        "policy_profile": _with(POLICY, "SELECT n AS request_count, m AS endpoint_template_count, (SELECT count(*) FROM reads WHERE rid IN (SELECT rid FROM requests)) AS read_event_count, (SELECT least(128, count(DISTINCT rid)) FROM reads WHERE rid IN (SELECT rid FROM requests)) AS sampled_root_count, "
            "(SELECT count(*) FROM row_writes) AS write_event_count, 4 AS trace_depth FROM size"),
        "run_summary": "SELECT round(avg(score), 3) AS macro, round(quantile_cont(score, 0.5), 3) AS median, round(sum(score * n) / sum(n), 3) AS weighted, round(stddev_samp(score), 3) AS deviation FROM (SELECT o_custkey, avg(o_totalprice) AS score, count(*) AS n FROM orders GROUP BY 1)",
    }


ORACLE_SQL = _oracle()
