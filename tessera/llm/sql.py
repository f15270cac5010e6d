"""SQL of the problems' queries that DuckDB can run over the same tables."""

from __future__ import annotations

from tessera.llm import canonical

_SPLIT = "CASE WHEN lower(trim(split)) IN ('valid', 'validation') THEN 'val' WHEN lower(trim(split)) IN ('train', 'val', 'test') THEN lower(trim(split)) END"
_SRC = r"""nullif(regexp_replace(regexp_replace(trim(lower(regexp_extract(regexp_replace(regexp_replace(src, '[\s\x{a0}\x{2007}\x{202f}\x{200b}\x{feff}]+', ' ', 'g'), '[/\\ ]+$', ''), '([^/\\]*)$', 1))),
 '(\.v\d+i\.[a-z0-9]+|\.(zip|tar|tgz|gz|rar|7z))+$', ''), '[^a-z0-9]', '', 'g'), '')"""
_STEM = r"""nullif(regexp_replace(regexp_replace(trim(regexp_extract(replace(img, '\', '/'), '([^/]*)$', 1)), '\.[A-Za-z0-9]{1,5}$', ''), '_[A-Za-z]+\.rf\.[0-9a-fA-F]+$', ''), '')"""


def _path(c: str) -> str:
    return rf"""nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace({c}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g'), '\', '/'), '^file:(//)?', ''), '/{{2,}}', '/', 'g'), '^(\./)+', ''), '^(?i)(/?datasets/)?_?raw/', ''), '')"""


_CLIPS = r"""clips AS (SELECT DISTINCT group_id AS id, regexp_replace(regexp_extract(c, '\d{4}-\d{2}-\d{2}[^0-9]+\d{2}[^0-9]\d{2}[^0-9]\d{2}'), '[^0-9]', '', 'g') AS k
 FROM (SELECT group_id, unnest(clips) AS c FROM resplit_dataset) WHERE regexp_matches(c, '\d{4}-\d{2}-\d{2}[^0-9]+\d{2}[^0-9]\d{2}[^0-9]\d{2}'))"""
_TIED = """tied AS (SELECT a.id AS x, b.id AS y FROM clips a JOIN clips b ON a.k = b.k),
 reach(v, u) AS (SELECT x, y FROM tied UNION SELECT r.v, t.y FROM reach r JOIN tied t ON r.u = t.x),
 heads AS (SELECT v, min(u) AS h, count(*) AS n FROM reach GROUP BY v)"""

_P1 = f"""WITH RECURSIVE {_CLIPS}, {_TIED},
img AS (SELECT DISTINCT image_id AS id, {_SPLIT} AS s, {_SRC} AS k FROM build_dataset WHERE image_id IS NOT NULL),
iu AS (SELECT k, min(id) AS u FROM img WHERE k IS NOT NULL GROUP BY k HAVING count(DISTINCT s) > 1),
grp AS (SELECT DISTINCT group_id AS id, {_SPLIT} AS s, h AS u FROM resplit_dataset JOIN heads ON v = group_id),
gu AS (SELECT u FROM grp GROUP BY u HAVING count(DISTINCT s) > 1)
SELECT 'image' AS kind, id AS record_id, u AS unit_id FROM img JOIN iu USING (k)
UNION ALL SELECT 'group', id, u FROM grp JOIN gu USING (u)"""

_PICS = f"""r AS (SELECT DISTINCT image_id AS id, {_SPLIT} AS s, CASE WHEN hash <> 0 THEN hash END AS h, {_SRC} AS k, {_STEM} AS f FROM build_dataset),
ev AS (SELECT * FROM r WHERE s IN ('val', 'test')), tr AS (SELECT * FROM r WHERE s = 'train'),
p AS (SELECT tr.id AS t, ev.id AS e FROM tr JOIN ev ON bit_count(xor(tr.h, ev.h)) <= 6 UNION SELECT tr.id, ev.id FROM tr JOIN ev ON tr.k = ev.k AND tr.f = ev.f)"""
_P2 = f"WITH {_PICS} SELECT least(t, e) AS image_id_a, greatest(t, e) AS image_id_b FROM p"
_P2R = f"""WITH {_PICS}, side AS (SELECT t AS id, count(*) AS n FROM p GROUP BY t UNION ALL SELECT e, count(*) FROM p GROUP BY e)
SELECT s AS split, k AS source, CAST(sum(n) AS BIGINT) AS n_pairs, count(*) AS n_records FROM side JOIN r USING (id) GROUP BY s, k"""

_P2L = f"""WITH {_PICS}, side AS (SELECT t AS id, count(*) AS n FROM p GROUP BY t UNION ALL SELECT e, count(*) FROM p GROUP BY e),
 c AS (SELECT id, min(id) OVER (PARTITION BY s = 'train', h, k, f) AS class_id FROM r WHERE s IS NOT NULL) SELECT id AS image_id, class_id, n AS n_links FROM side JOIN c USING (id)"""
_P2N = f"""WITH {_PICS} SELECT DISTINCT ev.k AS source, ev.f AS eval_name, tr.f AS train_name, CAST(levenshtein(ev.f, tr.f) AS INT) AS edits
 FROM (SELECT DISTINCT k, f FROM ev) ev JOIN (SELECT DISTINCT k, f FROM tr) tr ON ev.k = tr.k AND ev.f <> tr.f AND abs(length(ev.f) - length(tr.f)) <= 2 AND levenshtein(ev.f, tr.f) <= 2"""

_RUNS = r"""WITH a AS (SELECT *, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(lower(coalesce(weapons, '')), '[,;]'), lambda x: trim(x)), lambda x: x <> ''))), ','), '') AS w
 FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, person_id, "timestamp", alert_id ORDER BY received_at) AS copy FROM alerts
 WHERE person_id IS NOT NULL AND threat_level IS NOT NULL AND "timestamp" IS NOT NULL AND alert_id IS NOT NULL) WHERE copy = 1),
b AS (SELECT *, CASE WHEN lag(w) OVER o = w AND lag(threat_level) OVER o = threat_level AND epoch_us("timestamp") - lag(epoch_us("timestamp")) OVER o <= 5000000 THEN 0 ELSE 1 END AS new
 FROM a WINDOW o AS (PARTITION BY stream_id, person_id ORDER BY "timestamp", alert_id)),
c AS (SELECT *, sum(new) OVER (PARTITION BY stream_id, person_id ORDER BY "timestamp", alert_id ROWS UNBOUNDED PRECEDING) AS run FROM b),
d AS (SELECT stream_id, person_id, run, any_value(threat_level) AS threat_level, any_value(w) AS weapons, arg_min(alert_id, ("timestamp", alert_id)) AS first_alert_id,
 arg_max(alert_id, ("timestamp", alert_id)) AS last_alert_id, count(*) AS n_alerts, round((max(epoch_us("timestamp")) - min(epoch_us("timestamp"))) / 1e6, 6) AS duration_s FROM c GROUP BY stream_id, person_id, run)
"""

_P5 = f"""WITH RECURSIVE {_CLIPS}, {_TIED},
nm AS (SELECT n, min(image_id) AS id FROM (SELECT image_id, {_path('img')} AS n FROM build_dataset) GROUP BY n),
pr AS (SELECT DISTINCT {_path('left_img')} AS l, {_path('right_img')} AS r FROM image_pair WHERE is_match),
ed AS (SELECT a.id AS x, b.id AS y FROM pr JOIN nm a ON a.n = pr.l JOIN nm b ON b.n = pr.r WHERE a.id <> b.id),
both_ways AS (SELECT x, y FROM ed UNION SELECT y, x FROM ed),
ireach(v, u) AS (SELECT x, y FROM both_ways UNION SELECT r.v, t.y FROM ireach r JOIN both_ways t ON r.u = t.x),
ihead AS (SELECT v, least(v, min(u)) AS h FROM ireach GROUP BY v)
SELECT 'image' AS kind, v AS record_id, h AS head_id FROM ihead
UNION ALL SELECT 'group', v, h FROM heads WHERE n > 1"""

_PLANS = """WITH im AS (SELECT DISTINCT image_id AS id, CASE WHEN labels IS NULL THEN NULL WHEN len(labels) = 0 THEN '__background__' WHEN greatest(g, k, l) = 0 THEN NULL
 WHEN g >= k AND g >= l THEN 'guns' WHEN k >= l THEN 'knife' ELSE 'long_gun' END AS c FROM (SELECT *, len(list_filter(labels, lambda b: b.cls = 0)) AS g,
 len(list_filter(labels, lambda b: b.cls = 1)) AS k, len(list_filter(labels, lambda b: b.cls = 2)) AS l FROM build_dataset)),
gr AS (SELECT DISTINCT group_id AS id, CASE WHEN greatest(g, k, l) = 0 THEN '__background__' WHEN g >= k AND g >= l THEN 'guns' WHEN k >= l THEN 'knife' ELSE 'long_gun' END AS c
 FROM (SELECT group_id, greatest(coalesce(counts.guns, 0), 0) AS g, greatest(coalesce(counts.knife, 0), 0) AS k, greatest(coalesce(counts.long_gun, 0), 0) AS l FROM resplit_dataset)),
rec AS (SELECT 'build_dataset' AS t, id, c FROM im UNION ALL SELECT 'resplit_dataset', id, c FROM gr),
seen AS (SELECT t, c, count(*) AS n FROM rec WHERE c IS NOT NULL GROUP BY t, c),
pl AS (SELECT plan_id, category, over_table, CAST(max(greatest(min_rows, round(share * sample_size))) AS BIGINT) AS need, max(share) AS share FROM sample_plan WHERE over_table IN ('build_dataset', 'resplit_dataset') GROUP BY ALL),
got AS (SELECT pl.*, least(need, coalesce(n, 0)) AS drawn FROM pl LEFT JOIN seen ON t = over_table AND c = category)
"""
_P6 = _PLANS + "SELECT plan_id, category FROM got WHERE drawn < need"
_P6R = _PLANS + "SELECT plan_id, category, need, drawn, need - drawn AS lacking, share AS wanted_share, round(drawn / sum(drawn) OVER (PARTITION BY plan_id), 9) AS drawn_share FROM got"
_P6S = _PLANS + """SELECT plan_id, category, id AS record_id, over_table FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, category, over_table ORDER BY (CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 10) AS BIGINT) + CAST('0x' || substr(md5('plan/' || plan_id || '/0'), 1, 10) AS BIGINT)) % 1099511627776, id) AS k
 FROM got JOIN rec ON t = over_table AND c = category) WHERE k <= drawn"""


def _plain(c: str) -> str:
    looks, digits = canonical.LOOKS, canonical.DIGITS
    return f"translate(regexp_replace(translate(lower({c}), '{looks[0]}', '{looks[1]}'), '[^a-z0-9]+', '', 'g'), '{digits[0]}', '{digits[1]}')"


_GRAMS = "list_distinct(list_concat(list_transform(range(1, length({0}) + 2), lambda i: substr('^' || {0} || '$', i, 2)), list_transform(range(1, length({0}) + 1), lambda i: substr('^' || {0} || '$', i, 3))))"
_P4 = f"""WITH typed AS (SELECT DISTINCT * FROM (SELECT entry_id, 'sources' AS field, sources AS v FROM class_map UNION ALL SELECT entry_id, 'classes', classes FROM class_map)
 WHERE trim(regexp_replace(v, '[\\s\\x{{a0}}]+', ' ', 'g')) <> ''),
exact AS (SELECT 'sources' AS field, source_id AS ref_id, slug AS name FROM source_ref UNION ALL SELECT 'classes', class_id, class_name FROM class_ref),
named AS (SELECT * FROM exact UNION ALL SELECT 'classes', class_id, unnest(aliases) FROM class_ref),
opened AS (SELECT * FROM typed WHERE (field, v) NOT IN (SELECT (field, name) FROM exact)),
r AS (SELECT DISTINCT field, ref_id, {_plain('name')} AS name FROM named WHERE {_plain('name')} <> ''),
n AS (SELECT field, count(*) AS n FROM r GROUP BY field),
rg AS (SELECT *, unnest({_GRAMS.format('name')}) AS g FROM r),
w AS (SELECT field, g, ln(1 + any_value(n) / count(*)) AS w FROM rg JOIN n USING (field) GROUP BY field, g),
rn AS (SELECT field, ref_id, name, sqrt(sum(w * w)) AS rn FROM rg JOIN w USING (field, g) GROUP BY ALL),
s AS (SELECT DISTINCT field, {_plain('v')} AS s FROM opened WHERE {_plain('v')} <> ''),
vg AS (SELECT *, unnest({_GRAMS.format('s')}) AS g FROM s),
vn AS (SELECT field, s, sqrt(sum(coalesce(w, 0.3 * ln(1 + n)) ** 2)) AS vn FROM vg JOIN n USING (field) LEFT JOIN w USING (field, g) GROUP BY field, s),
sc AS (SELECT field, s, ref_id, max(dot / rn) AS part FROM (SELECT vg.field, s, ref_id, name, sum(w * w) AS dot FROM vg JOIN rg USING (field, g) JOIN w USING (field, g) GROUP BY ALL) JOIN rn USING (field, ref_id, name) GROUP BY ALL),
two AS (SELECT *, coalesce(lead(part) OVER o, 0) AS next, row_number() OVER o AS k FROM sc WINDOW o AS (PARTITION BY field, s ORDER BY part DESC, ref_id)),
m AS (SELECT field, s, ref_id FROM two JOIN vn USING (field, s) WHERE k = 1 AND part / vn >= 0.47 AND (part - next) / vn >= 0.04),
got AS (SELECT DISTINCT entry_id, opened.field, v, coalesce(ref_id, -1) AS ref_id FROM opened LEFT JOIN m ON m.field = opened.field AND m.s = {_plain('v')})
"""

SQL = {
    "p1_found": _P1, "p2_found": _P2, "p2_report": _P2R, "p2_pictures": _P2L, "p2_names": _P2N, "p3_found": _RUNS + "SELECT first_alert_id, last_alert_id FROM d WHERE n_alerts >= 2",
    "p3_events": _RUNS + "SELECT stream_id, person_id, threat_level, weapons, first_alert_id, last_alert_id, n_alerts, duration_s FROM d", "p4_found": _P4 + "SELECT DISTINCT entry_id, field, ref_id FROM got",
    "p4_unmatched": _P4 + "SELECT field, v AS value, count(*) AS n_entries FROM got WHERE ref_id = -1 GROUP BY field, v",
    "p5_found": _P5, "p6_found": _P6, "p6_report": _P6R, "p6_sample": _P6S,
}
