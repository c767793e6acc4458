"""Equivalent SQL of the queries of this subpackage, where SQL can express them on whole tables."""

_P2 = """
WITH RECURSIVE l AS (
  SELECT lower(trim(node_a, ' ' || chr(9))) AS a, lower(trim(node_b, ' ' || chr(9))) AS b
  FROM match_pairs WHERE upper(trim(decision, ' ' || chr(9))) = 'MERGE'
), e AS (
  SELECT a AS x, b AS y FROM l WHERE a <> '' AND b <> '' AND a <> b
  UNION SELECT b, a FROM l WHERE a <> '' AND b <> '' AND a <> b
), r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
g AS (SELECT x AS node_id, least(x, min(y)) AS group_id FROM r GROUP BY x)
"""

_P5 = r"""
WITH m AS (
  SELECT DISTINCT cluster_id, lower(trim(node_id, ' ' || chr(9))) AS node_id FROM merge_log
  WHERE upper(trim(decision, ' ' || chr(9))) = 'MERGE' AND cluster_id IS NOT NULL AND trim(node_id, ' ' || chr(9)) <> ''
), many AS (SELECT cluster_id FROM m GROUP BY 1 HAVING count(*) >= 2),
n AS (SELECT * EXCLUDE (node_id), lower(trim(node_id, ' ' || chr(9))) AS node_id, row_number() OVER (PARTITION BY lower(trim(node_id, ' ' || chr(9))) ORDER BY ingested_at DESC) AS rn FROM nodes),
r AS (SELECT m.cluster_id, n.* FROM m JOIN many USING (cluster_id) JOIN n ON m.node_id = n.node_id AND n.rn = 1),
p AS (SELECT *, trim(regexp_replace(regexp_replace(coalesce(description, ''), '<[^>]*>|&nbsp;', ' ', 'g'), '\s+', ' ', 'g')) AS plain,
  trim(regexp_replace(lower(coalesce(title, '')), '[^\pL\pN]+', ' ', 'g')) AS name FROM r),
e AS (SELECT lower(plain) AS empty FROM p WHERE description IS NOT NULL GROUP BY 1 HAVING count(DISTINCT cluster_id) >= greatest(3, 0.005 * (SELECT count(DISTINCT cluster_id) FROM p))),
s AS (SELECT *, list_distinct(list_filter(list_transform(string_split(regexp_replace(plain, '([.!?]["”)]?) ([\p{Lu}\pN“"(¿¡])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: lower(trim(x))),
  lambda x: regexp_matches(x, '[^.!?][.!?]["”)]?$') AND trim(regexp_replace(x, '[^\pL\pN]+', ' ', 'g')) <> name)) AS sentences0,
  list_distinct(list_filter(list_transform(coalesce(sources, []), lambda x: trim(x.source_id, ' ' || chr(9))), lambda x: x <> '')) AS ids, upper(trim(granularity, ' ' || chr(9))) AS level, coalesce(last_validated, created_at) AS seen,
  coalesce(list_max(list_transform(sources, lambda x: CASE x.source_type WHEN 'curated_list' THEN 1.2 WHEN 'paper' THEN 1.0 WHEN 'grant' THEN 0.9 WHEN 'patent' THEN 0.7 ELSE 0.5 END)), 0.5)::DOUBLE AS trust FROM p),
t AS (SELECT *, CASE WHEN lower(plain) IN (SELECT empty FROM e) THEN [] ELSE list_filter(list_transform(string_split(regexp_replace(plain, '([.!?]["”)]?) ([\p{Lu}\pN“"(¿¡])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: lower(trim(x))), lambda x: list_contains(sentences0, x)) END AS sentences FROM s),
l AS (
  SELECT cluster_id, node_id, 'description' AS field_name, len(sentences0)::DOUBLE AS merit, array_to_string(list_filter(sentences, lambda x, i: list_position(sentences, x) = i), ' ') AS key, description AS value, trust, seen FROM t WHERE len(sentences) > 0
  UNION ALL SELECT cluster_id, node_id, 'granularity', coalesce(epoch_us(seen)::DOUBLE, -1e300), level, level, trust, seen FROM t WHERE level IN ('L0', 'L1', 'L2', 'L3')
  UNION ALL SELECT cluster_id, node_id, 'confidence', confidence, printf('%.6f', confidence), confidence::VARCHAR, trust, seen FROM t WHERE confidence >= 0 AND confidence <= 1
  UNION ALL SELECT cluster_id, node_id, 'sources', len(ids)::DOUBLE, array_to_string(list_sort(ids), chr(1)), array_to_string(list_transform(sources, lambda x: x.source_id), ','), trust, seen FROM t WHERE len(ids) > 0
)
"""

SQL: dict[str, str] = {
    "p2_found": _P2 + "SELECT node_id, group_id FROM g",
    "p2_group_sizes": _P2 + """
, t AS (SELECT DISTINCT lower(trim(node_id, ' ' || chr(9))) AS node_id, nullif(lower(trim(title, ' ' || chr(9))), '') AS title_key FROM nodes)
SELECT g.group_id, count(DISTINCT g.node_id) AS n_members, count(DISTINCT t.title_key) AS n_titles, count(t.title_key) AS n_with_title
FROM g LEFT JOIN t ON g.node_id = t.node_id GROUP BY g.group_id""",
    "p5_found": _P5 + "SELECT cluster_id, field_name, node_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, field_name ORDER BY merit DESC, node_id) AS k FROM l) WHERE k = 1",
    "p5_survivors": _P5 + """
, v AS (SELECT cluster_id, field_name, key, sum(trust * pow(0.5, coalesce(date_sub('second', seen, (SELECT max(seen) FROM l)) / 86400.0, 3650) / 365)) AS votes,
    arg_min(struct_pack(merit, node_id, value), struct_pack(m := -merit, n := node_id)) AS b FROM l GROUP BY 1, 2, 3),
w AS (SELECT cluster_id, field_name, b.value AS value, row_number() OVER (PARTITION BY cluster_id, field_name ORDER BY round(votes, 9) DESC, b.merit DESC, b.node_id) AS k FROM v)
SELECT cluster_id, max(value) FILTER (WHERE field_name = 'description') AS description, max(value) FILTER (WHERE field_name = 'granularity') AS granularity,
  max(value) FILTER (WHERE field_name = 'confidence') AS confidence, max(value) FILTER (WHERE field_name = 'sources') AS sources FROM w WHERE k = 1 GROUP BY 1""",
}
