"""The registered queries as DuckDB SQL on the same tables, written independently of the
operators: window functions and self-joins over the whole tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def sql(name: str, body: str, *ctes: str) -> None:
    head = "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" if ctes else ""
    ORACLE[name] = head + body.strip()


# series

PART = "s AS (SELECT p_partkey AS ord, p_brand AS category, p_retailprice AS value FROM part)"
EVENT = "s AS (SELECT event_id AS ord, event_type AS category, value FROM events)"
BANDS = """
cat AS (SELECT category, min(ord) AS first_seen FROM s GROUP BY category),
bands AS (
  SELECT category, row_number() OVER (ORDER BY first_seen) - 1 AS index,
         2 * pi() / ((SELECT count(*) FROM cat) + 0.1::DOUBLE) AS step
  FROM cat)
"""
LENGTH = "sign(value / mx) * sqrt(abs(value / mx))"
TOP = "top AS (SELECT max(value) AS mx FROM s)"

sql("series_values", "SELECT * FROM s", PART)
sql(
    "series_map_sum",
    """
SELECT event_id AS ord, event_type AS category,
       coalesce((SELECT sum(CAST(json_extract(props, '$."' || k || '"') AS DOUBLE))
                 FROM unnest(json_keys(props)) AS t(k)), 0) AS value
FROM events
""",
)
sql("series_max", "SELECT max(value) AS largest FROM s", PART)
sql("series_categories", "SELECT category, min(ord) AS first_seen FROM s GROUP BY category", PART)
sql(
    "series_bands",
    """
SELECT category, index, round(step * (index + 0.1::DOUBLE), 9) AS start_angle,
       round(step * (1 - 0.1::DOUBLE), 9) AS width
FROM bands
""",
    PART,
    BANDS,
)
sql("series_lengths", f"SELECT ord, category, value, round({LENGTH}, 9) AS length FROM s, top", PART, TOP)
sql(
    "series_overlay",
    f"""
SELECT category, value, n_rows, round({LENGTH}, 9) AS length
FROM (SELECT category, max(value) AS value, count(*) AS n_rows FROM s GROUP BY category), top
""",
    PART,
    TOP,
)
sql(
    "series_bars",
    f"""
SELECT ord, s.category, value, round({LENGTH}, 9) AS length,
       round(step * (index + 0.1::DOUBLE), 9) AS start_angle,
       round(step * (index + 0.1::DOUBLE) + step * (1 - 0.1::DOUBLE), 9) AS end_angle
FROM s JOIN bands USING (category), top
""",
    EVENT,
    BANDS,
    TOP,
)

# links between entities

ORDERS = """
items AS (
  SELECT l_orderkey, list(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey, n_name) AS suppliers,
         list(n_name ORDER BY l_linenumber, l_partkey, l_suppkey, n_name) AS nations
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY l_orderkey),
deals AS (
  SELECT o_orderkey AS ord, n_name AS nation, nations, suppliers[1] AS supplier, suppliers[2:] AS others, o_totalprice,
         o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN items ON l_orderkey = o_orderkey)
"""
CELLS = """
ent AS (SELECT entity, min(ord) AS first_seen FROM rec GROUP BY entity),
kept AS (SELECT entity AS source, target FROM rec WHERE target IN (SELECT entity FROM ent)),
cells AS (
  SELECT source, target, count(*) AS value
  FROM (SELECT source, target FROM kept UNION ALL SELECT target, source FROM kept)
  GROUP BY source, target)
"""
TRADE = f"""
{ORDERS.strip()},
rec AS (SELECT ord, nation AS entity, unnest(CASE WHEN nations IS NULL THEN [NULL] ELSE nations END) AS target FROM deals),
{CELLS.strip()}
"""
TOTALS = """
totals AS (
  SELECT entity, first_seen, CAST(coalesce(sum(value), 0) AS BIGINT) AS total
  FROM ent LEFT JOIN cells ON source = entity GROUP BY entity, first_seen)
"""
ARCS = """
scale AS (SELECT greatest(0, 2 * pi() - 0.05::DOUBLE * count(*)) / sum(total) AS k FROM totals),
arcs AS (
  SELECT entity, first_seen, total, k, row_number() OVER w - 1 AS index,
         coalesce(CAST(sum(total) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) * k
         + (row_number() OVER w - 1) * 0.05::DOUBLE AS start_angle
  FROM totals, scale WINDOW w AS (ORDER BY first_seen))
"""
CHORDS = """
chords AS (
  SELECT source, target, value
  FROM cells JOIN ent es ON es.entity = source JOIN ent et ON et.entity = target
  WHERE es.first_seen <= et.first_seen)
"""
SUBARCS = """
sub AS (
  SELECT source, target, value, row_number() OVER w - 1 AS position,
         coalesce(CAST(sum(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS "offset"
  FROM cells JOIN ent ON entity = target
  WINDOW w AS (PARTITION BY source ORDER BY value DESC, first_seen))
"""

sql("link_entities", "SELECT entity, row_number() OVER (ORDER BY first_seen) - 1 AS index FROM ent", TRADE)
sql("link_matrix", "SELECT * FROM cells", TRADE)
sql(
    "link_pages",
    "SELECT * FROM cells",
    """
paged AS (SELECT page_id AS ord, regexp_extract_all(lower(html), 'href="/([^"]*)"', 1) AS found FROM pages),
rec AS (SELECT ord, found[1] AS entity, unnest(CASE WHEN len(found) < 2 THEN [NULL] ELSE found[2:] END) AS target
        FROM paged WHERE found[1] IS NOT NULL)
""",
    CELLS,
)
sql(
    "link_labels",
    """
SELECT 'The customers of ' || entity AS entity, row_number() OVER (ORDER BY first_seen) - 1 AS index, total,
       'The customers o...' AS label
FROM totals
""",
    TRADE,
    TOTALS,
)
sql(
    "link_totals",
    "SELECT entity, total, round(total / (SELECT sum(total) FROM totals)::DOUBLE, 9) AS share FROM totals",
    TRADE,
    TOTALS,
)
sql(
    "link_arcs",
    """
SELECT entity, index, total,
       CASE WHEN length(entity) > 15 THEN substring(entity, 1, 15) || '...' ELSE entity END AS label,
       round(start_angle, 9) AS start_angle, round(start_angle + total * k, 9) AS end_angle
FROM arcs
""",
    TRADE,
    TOTALS,
    ARCS,
)
sql("link_pairs", "SELECT * FROM chords", TRADE, CHORDS)
sql("link_subarcs", "SELECT * FROM sub", TRADE, SUBARCS)
sql(
    "link_ribbons",
    """
SELECT c.source, c.target, c.value,
       round(a.start_angle + s."offset" * a.k, 9) AS source_start,
       round(a.start_angle + s."offset" * a.k + s.value * a.k, 9) AS source_end,
       round(b.start_angle + t."offset" * b.k, 9) AS target_start,
       round(b.start_angle + t."offset" * b.k + t.value * b.k, 9) AS target_end
FROM chords c
JOIN sub s ON s.source = c.source AND s.target = c.target
JOIN sub t ON t.source = c.target AND t.target = c.source
JOIN arcs a ON a.entity = c.source
JOIN arcs b ON b.entity = c.target
""",
    TRADE,
    TOTALS,
    ARCS,
    CHORDS,
    SUBARCS,
)
sql("link_incident", "SELECT * FROM chords WHERE source = 'NATION_3' OR target = 'NATION_3'", TRADE, CHORDS)

# node/link graph

PAGES = """
rec AS (
  SELECT page_id AS ord, regexp_extract_all(lower(html), 'href="/([^"]*)"', 1) AS links, length(html)::DOUBLE AS strength
  FROM pages),
g AS (SELECT ord, links[1] AS node, links[2:] AS links, coalesce(strength, 0) AS v FROM rec),
span AS (SELECT min(v) AS lo, max(v) AS hi FROM g),
nodes AS (
  SELECT node AS id, v AS value, ord AS first_seen,
         CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0.5 END AS norm
  FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ord) AS rn FROM g), span WHERE rn = 1),
ends AS (
  SELECT ord, node AS source, unnest(links) AS target,
         CAST(generate_subscripts(links, 1) - 1 AS INTEGER) AS pos FROM g),
found AS (
  SELECT ord, pos, source, target, 1 AS value FROM ends
  WHERE source <> '' AND target <> '' AND target IN (SELECT node FROM g)),
near AS (
  SELECT ord, pos, source AS node, target AS neighbour FROM found
  UNION ALL SELECT ord, pos, target, source FROM found WHERE source <> target)
"""
SUPPLY = f"""
{ORDERS.strip()},
g AS (SELECT ord, supplier AS node, others AS links, coalesce(o_totalprice, 0) AS v,
             CASE WHEN o_orderstatus <> 'F' THEN o_totalprice ELSE 0 END AS open_v FROM deals),
nodes AS (
  SELECT node AS id, v, open_v FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ord) AS rn FROM g) WHERE rn = 1),
ends AS (
  SELECT ord, node AS source, unnest(links) AS target,
         CAST(generate_subscripts(links, 1) - 1 AS INTEGER) AS pos FROM g),
found AS (
  SELECT ord, pos, source, target, 1 AS value FROM ends
  WHERE source <> 0 AND target <> 0 AND target IN (SELECT node FROM g))
"""


def scaled(value: str) -> str:
    norm = f"({value} - (SELECT min({value}) FROM g)) / (SELECT max({value}) - min({value}) FROM g)"
    return f"SELECT id, {value} AS value, round({norm}, 9) AS norm, round(10 + {norm} * 20, 9) AS size FROM nodes"


sql("graph_nodes", "SELECT id, value, round(norm, 9) AS norm, round(10 + norm * 20, 9) AS size FROM nodes", PAGES)
sql("graph_links", "SELECT * FROM found", PAGES)
sql("graph_nodes_numeric", scaled("v"), SUPPLY)
sql("graph_nodes_missing", scaled("open_v"), SUPPLY)
sql("graph_links_numeric", "SELECT * FROM found", SUPPLY)
sql("graph_neighbors", "SELECT * FROM near", PAGES)
sql(
    "graph_neighbor_text",
    """
SELECT id, coalesce(part, 0) AS part, rtrim(rtrim(format('{:,}', floor(round(value / 16, 3))::BIGINT)
           || substring(printf('%.3f', round(value / 16, 3) - floor(round(value / 16, 3))), 2), '0'), '.') AS strength, coalesce(text, 'None') AS text
FROM nodes LEFT JOIN (
  SELECT node, part, string_agg(neighbour, ', ' ORDER BY rn) AS text
  FROM (SELECT *, (rn - 1) // 100 AS part
        FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ord, pos) AS rn FROM near))
  GROUP BY node, part) ON node = id
""",
    PAGES,
)
sql("graph_incident", "SELECT * FROM found WHERE source = 'la' OR target = 'la'", PAGES)
sql(
    "graph_drawn",
    """
SELECT id, count(source) AS n_links FROM nodes LEFT JOIN found ON source = id
WHERE EXISTS (SELECT 1 FROM found) GROUP BY id
""",
    PAGES,
)

# hierarchy

TREE = """
rec AS (
  SELECT c_custkey AS ord, r_name AS l1, n_name AS l2, c_mktsegment AS l3,
         coalesce(CAST(c_acctbal AS DECIMAL(18, 2)), 0) AS v
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
leaves AS (
  SELECT l1, l2, l3, first_seen, v AS value
  FROM (SELECT *, min(ord) OVER p AS first_seen,
               row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY ord DESC) AS back
        FROM rec WINDOW p AS (PARTITION BY l1, l2, l3))
  WHERE back = 1)
"""
NODES = """
n1 AS (SELECT l1, sum(value)::DOUBLE AS value, min(first_seen) AS f FROM leaves GROUP BY ALL),
n2 AS (SELECT l1, l2, sum(value)::DOUBLE AS value, min(first_seen) AS f FROM leaves GROUP BY ALL),
n3 AS (SELECT l1, l2, l3, value::DOUBLE AS value, first_seen AS f FROM leaves),
nodes AS (
  SELECT l1, NULL AS l2, NULL AS l3, l1 AS name, 1 AS depth, value, f AS f1, NULL AS f2, NULL AS f3 FROM n1
  UNION ALL
  SELECT n2.l1, n2.l2, NULL, n2.l2, 2, n2.value, n1.f, n2.f, NULL FROM n2 JOIN n1 USING (l1)
  UNION ALL
  SELECT n3.l1, n3.l2, n3.l3, n3.l3, 3, n3.value, n1.f, n2.f, n3.f FROM n3 JOIN n2 USING (l1, l2) JOIN n1 USING (l1))
"""


def partition_sql(where: str, top: int) -> tuple[str, str]:
    """Sibling offsets per ring, added up from the top; backward intervals become their middle."""
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    leaves = f"picked AS (SELECT * FROM leaves WHERE {where})"
    ctes = f"""
{leaves},
k AS (SELECT 2 * pi() / sum(value)::DOUBLE AS k FROM picked),
p1 AS (SELECT l1, sum(value) AS value, min(first_seen) AS f FROM picked GROUP BY ALL),
p2 AS (SELECT l1, l2, sum(value) AS value, min(first_seen) AS f FROM picked GROUP BY ALL),
o1 AS (SELECT l1, value, coalesce(sum(value) OVER (ORDER BY f {before}), 0)::DOUBLE AS off FROM p1),
o2 AS (SELECT l1, l2, value, coalesce(sum(value) OVER (PARTITION BY l1 ORDER BY f {before}), 0)::DOUBLE AS off FROM p2),
o3 AS (SELECT l1, l2, l3, value,
              coalesce(sum(value) OVER (PARTITION BY l1, l2 ORDER BY first_seen {before}), 0)::DOUBLE AS off FROM picked),
a1 AS (SELECT l1 AS path, l1, value::DOUBLE AS value, 1 AS depth, off * k AS r0 FROM o1, k),
a2 AS (SELECT l1 || '/' || l2 AS path, l1, l2, o2.value::DOUBLE AS value, 2 AS depth, r0 + off * k AS r0
       FROM o2 JOIN a1 USING (l1), k),
a3 AS (SELECT l1 || '/' || l2 || '/' || l3 AS path, o3.value::DOUBLE AS value, 3 AS depth, r0 + off * k AS r0
       FROM o3 JOIN a2 USING (l1, l2), k),
raw AS (
  SELECT path, depth, value, r0, r0 + value * k AS r1
  FROM (SELECT path, depth, value, r0 FROM a1 UNION ALL SELECT path, depth, value, r0 FROM a2
        UNION ALL SELECT path, depth, value, r0 FROM a3), k)
"""
    rings = 4 - top
    body = f"""
SELECT path, depth, round(value, 9) AS value,
       round(CASE WHEN r1 < r0 THEN (r0 + r1) / 2 ELSE r0 END, 9) AS x0,
       round(CASE WHEN r1 < r0 THEN (r0 + r1) / 2 ELSE r1 END, 9) AS x1,
       round((depth - {top}) / {rings}::DOUBLE, 9) AS y0, round((depth - {top} + 1) / {rings}::DOUBLE, 9) AS y1
FROM raw
"""
    return ctes, body


sql("tree_leaves", "SELECT concat_ws('/', l1, l2, l3) AS path, value::DOUBLE AS value, first_seen FROM leaves", TREE)
sql(
    "tree_rollup",
    """
SELECT concat_ws('/', l1, l2, l3) AS path, 3 - bit_count(grouping(l1, l2, l3)::INTEGER)::INTEGER AS depth,
       CASE WHEN grouping(l1) = 1 THEN 'root' WHEN grouping(l2) = 1 THEN l1 WHEN grouping(l3) = 1 THEN l2 ELSE l3 END AS name,
       CASE WHEN grouping(l1) = 1 THEN NULL WHEN grouping(l2) = 1 THEN '' WHEN grouping(l3) = 1 THEN l1
            ELSE l1 || '/' || l2 END AS parent,
       sum(value)::DOUBLE AS value, min(first_seen) AS first_seen,
       CASE WHEN grouping(l1) = 1 THEN count(DISTINCT l1) WHEN grouping(l2) = 1 THEN count(DISTINCT l2)
            WHEN grouping(l3) = 1 THEN count(DISTINCT l3) ELSE 0 END AS n_children,
       grouping(l3) = 0 AS is_leaf
FROM leaves GROUP BY ROLLUP (l1, l2, l3)
""",
    TREE,
)
_ctes, _body = partition_sql("true", 0)
sql("tree_partition", _body, TREE, _ctes)
sql(
    "tree_labels",
    "SELECT concat_ws(' > ', 'root', l1, l2, l3) AS label, value FROM nodes",
    TREE,
    NODES,
)
_ctes, _body = partition_sql("l1 = 'EUROPE'", 1)
sql("tree_subtree", _body, TREE, _ctes)
sql(
    "tree_ancestors",
    """
SELECT concat_ws('/', l1, l2, l3) AS path, step,
       CASE step WHEN 0 THEN '' WHEN 1 THEN l1 WHEN 2 THEN l1 || '/' || l2 ELSE concat_ws('/', l1, l2, l3) END AS ancestor,
       CASE step WHEN 0 THEN 'root' WHEN 1 THEN l1 WHEN 2 THEN l2 ELSE l3 END AS name
FROM (SELECT l1, l2, l3, depth FROM nodes UNION ALL SELECT NULL, NULL, NULL, 0)
JOIN (VALUES (0), (1), (2), (3)) AS t(step) ON step <= depth
""",
    TREE,
    NODES,
)

sql(
    "tree_text",
    """
SELECT concat_ws('/', l1, l2, l3) AS path, 3 - bit_count(grouping(l1, l2, l3)::INTEGER)::INTEGER AS depth,
       sum(value)::DOUBLE AS value
FROM (
  SELECT l1, l2, l3, CASE WHEN ord % 7 = 0 THEN 0 ELSE floor(bal) END AS value
  FROM (SELECT rec.*, c_acctbal AS bal, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY ord DESC) AS back
        FROM rec JOIN customer ON ord = c_custkey)
  WHERE back = 1)
GROUP BY ROLLUP (l1, l2, l3)
""",
    TREE,
)
sql(
    "tree_year",
    """
SELECT '1995' || CASE WHEN p IS NULL THEN '' ELSE '/' || p END AS path, CASE WHEN p IS NULL THEN 1 ELSE 2 END AS depth,
       value::DOUBLE AS value,
       CASE WHEN p IS NULL THEN 0 ELSE round(2 * pi() * coalesce(before, 0)::DOUBLE / whole, 9) END AS x0,
       CASE WHEN p IS NULL THEN round(2 * pi(), 9) ELSE round(2 * pi() * coalesce(before, 0)::DOUBLE / whole + 2 * pi() * value::DOUBLE / whole, 9) END AS x1
FROM (
  SELECT p, value, sum(value) OVER (ORDER BY first_seen ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
         (SELECT sum(value) FROM last)::DOUBLE AS whole
  FROM last
  UNION ALL SELECT NULL, (SELECT sum(value) FROM last), 0, 1)
""",
    ORDERS,
    """
last AS (
  SELECT o_orderpriority AS p, min(ord) AS first_seen, arg_max(round(o_totalprice * 100)::DECIMAL(18, 0), ord) AS value
  FROM deals WHERE year = 1995 GROUP BY ALL)
""",
)

# shared selection

sql("select_series", "SELECT *, category IN ('Brand#7', 'Brand#9') AS lit FROM s", PART)
sql("select_entities", "SELECT *, entity IN ('NATION_3', 'NATION_11') AS lit FROM ent", TRADE)
sql(
    "select_chords",
    """
SELECT *, source IN ('NATION_3', 'NATION_11') OR target IN ('NATION_3', 'NATION_11') AS lit FROM chords
""",
    TRADE,
    CHORDS,
)
sql("select_nodes", "SELECT id, value, id IN ('la', 'the') AS lit FROM nodes", PAGES)
sql("select_links", "SELECT *, source IN ('la', 'the') OR target IN ('la', 'the') AS lit FROM found", PAGES)
sql(
    "select_tree",
    """
, sel AS (SELECT * FROM nodes WHERE name IN ('BUILDING', 'NATION_7')),
first AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY depth, f1, f2, f3) AS rn FROM sel) WHERE rn = 1),
names AS (SELECT l1 AS n FROM first UNION SELECT l2 FROM first UNION SELECT l3 FROM first)
SELECT concat_ws('/', l1, l2, l3) AS path, name,
       name IN (SELECT n FROM names WHERE n IS NOT NULL)
       OR EXISTS (SELECT 1 FROM sel WHERE sel.l1 = nodes.l1 AND (nodes.l2 IS NULL OR sel.l2 = nodes.l2)
                  AND (nodes.l3 IS NULL OR sel.l3 = nodes.l3)) AS lit
FROM nodes
""",
    TREE,
    NODES,
)
sql("select_empty", "SELECT *, true AS lit FROM chords", TRADE, CHORDS)
sql(
    "select_toggle",
    """
SELECT coalesce(was, clicked) AS key
FROM (SELECT DISTINCT n_name AS was FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000)
FULL JOIN (SELECT DISTINCT n_name AS clicked FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000)
  ON was = clicked
WHERE was IS NULL OR clicked IS NULL
""",
)
sql(
    "select_remove",
    """
SELECT * FROM s
WHERE category IN (SELECT category FROM s WHERE value < 1000 OR value > 1090) AND category <> 'Brand#7'
""",
    PART,
)
sql("select_clear", "SELECT *, true AS lit FROM s", PART)
YEAR_NODES = """
paths AS (SELECT year AS l1, o_orderpriority AS l2, nation AS l3, min(ord) AS f FROM deals GROUP BY ALL),
y1 AS (SELECT l1, min(f) AS f FROM paths GROUP BY ALL),
y2 AS (SELECT l1, l2, min(f) AS f FROM paths GROUP BY ALL),
years AS (
  SELECT l1, NULL AS l2, NULL AS l3, NULL AS name, 1 AS depth, f AS f1, NULL AS f2, NULL AS f3 FROM y1
  UNION ALL SELECT l1, y2.l2, NULL, y2.l2, 2, y1.f, y2.f, NULL FROM y2 JOIN y1 USING (l1)
  UNION ALL SELECT l1, l2, paths.l3, paths.l3, 3, y1.f, y2.f, paths.f FROM paths JOIN y2 USING (l1, l2) JOIN y1 USING (l1))
"""
sql(
    "select_all_views",
    """
SELECT 'numbers' AS chosen, 'series' AS view, ord::VARCHAR AS item FROM deals WHERE year IN (1995, 3, 7)
UNION ALL SELECT 'numbers', 'nodes', node::VARCHAR FROM (SELECT DISTINCT node FROM g) WHERE node IN (1995, 3, 7)
UNION ALL SELECT 'numbers', 'links', ord || '/' || pos FROM found WHERE source IN (1995, 3, 7) OR target IN (1995, 3, 7)
UNION ALL SELECT 'numbers', 'tree', l1::VARCHAR FROM years WHERE depth = 1 AND l1 IN (1995, 3, 7)
UNION ALL SELECT 'texts', 'entities', entity FROM ent WHERE entity = 'NATION_3'
UNION ALL SELECT 'texts', 'chords', source || '/' || target FROM chords WHERE source = 'NATION_3' OR target = 'NATION_3'
UNION ALL SELECT 'texts', 'tree', concat_ws('/', l1::VARCHAR, l2, l3)
FROM years
WHERE name IN (SELECT n FROM names) OR (depth = 1 AND l1 IN (SELECT l1 FROM first))
   OR EXISTS (SELECT 1 FROM sel WHERE sel.l1 = years.l1 AND (years.l2 IS NULL OR sel.l2 = years.l2)
              AND (years.l3 IS NULL OR sel.l3 = years.l3))
""",
    TRADE,
    CHORDS,
    SUPPLY.replace(ORDERS.strip() + ",", ""),
    YEAR_NODES,
    """
sel AS (SELECT * FROM years WHERE name IN ('NATION_3', '1-URGENT', '1995')),
first AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY depth, f1, f2, f3) AS rn FROM sel) WHERE rn = 1),
names AS (SELECT l2 AS n FROM first WHERE l2 IS NOT NULL UNION SELECT l3 FROM first WHERE l3 IS NOT NULL)
""",
)
sql(
    "key_dictionary",
    """
SELECT key, kind, index, index % 10 AS "group"
FROM (SELECT key, kind, row_number() OVER (ORDER BY view, depth, f1, f2) - 1 AS index
      FROM (SELECT *, row_number() OVER (PARTITION BY key, kind ORDER BY view, depth, f1, f2) AS rn FROM listed)
      WHERE rn = 1)
""",
    TRADE,
    YEAR_NODES,
    """
listed AS (
  SELECT year::VARCHAR AS key, 'number' AS kind, 0 AS view, 0 AS depth, ord AS f1, NULL AS f2 FROM deals
  UNION ALL SELECT entity, 'text', 1, 0, first_seen, NULL FROM ent
  UNION ALL SELECT supplier::VARCHAR, 'number', 2, 0, ord, NULL FROM deals WHERE supplier IS NOT NULL
  UNION ALL SELECT l1::VARCHAR, 'text', 3, 1, f1, NULL FROM years WHERE depth = 1
  UNION ALL SELECT l2, 'text', 3, 2, f1, f2 FROM years WHERE depth = 2)
""",
)
ORACLE["select_tree"] = ORACLE["select_tree"].replace("\n, sel AS", ", sel AS")

# sources, profile, roles

KINDS = [
    ("event_id", "number"), ("ts", "timestamp"), ("user_id", "number"), ("event_type", "string"), ("value", "number"),
    ("props", "string"), ("entries", "object"), ("tags", "array"),
]
FIELDS = f"""
fields(key, kind, is_numeric, position) AS (
  VALUES {", ".join(f"('{k}', '{kind}', {kind in ('number', 'object')}, {i})" for i, (k, kind) in enumerate(KINDS))}),
seen AS (SELECT *, props AS entries, [event_type] AS tags FROM events),
present AS (
  {" UNION ALL ".join(f"SELECT '{k}' AS key, min(event_id) FILTER ({k} IS NOT NULL) AS first_seen, count(*) FILTER ({k} IS NULL) AS n_missing FROM seen" for k, _ in KINDS)})
"""
sql("ingest_lines", "SELECT * FROM events")
sql("ingest_arrays", "SELECT * FROM conversations")
sql(
    "ingest_bad",
    """
SELECT event_id, event_id % 10 = 0 AS bad, CASE WHEN event_id % 10 <> 0 THEN ts END AS ts,
       CASE WHEN event_id % 10 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 10 <> 0 THEN event_type END AS event_type,
       CASE WHEN event_id % 10 <> 0 THEN value END AS value, CASE WHEN event_id % 10 <> 0 THEN props END AS props
FROM events
""",
)
sql(
    "ingest_variants",
    """
SELECT key, CASE WHEN key = 'ts' THEN 'string' ELSE kind END AS kind, is_numeric, first_seen
FROM present JOIN fields USING (key) WHERE key <> 'tags' AND first_seen IS NOT NULL
""",
    FIELDS,
)
sql(
    "profile_typed",
    """
SELECT key, kind, is_numeric, first_seen, position, n_missing
FROM present JOIN fields USING (key) WHERE key <> 'tags' AND first_seen IS NOT NULL
""",
    FIELDS,
)
sql(
    "bindings",
    """
SELECT view, part, agg, key AS field, first_seen,
       CASE need WHEN 'plain' THEN kind NOT IN ('array', 'object') WHEN 'number' THEN kind = 'number' WHEN 'list' THEN kind = 'array'
                 WHEN 'object' THEN kind = 'object' WHEN 'size' THEN kind IN ('number', 'string') END AS accepted
FROM fields JOIN present USING (key), (VALUES
  ('series', 'category', 'value', 'plain'), ('series', 'value', 'value', 'number'), ('series', 'value', 'entry_sum', 'object'),
  ('links', 'entity', 'value', 'plain'), ('links', 'connections', 'value', 'list'), ('graph', 'node', 'value', 'plain'),
  ('graph', 'links', 'value', 'list'), ('graph', 'strength', 'value', 'number'), ('hierarchy', 'level', 'value', 'plain'),
  ('hierarchy', 'size', 'value', 'size')) AS o(view, part, agg, need)
WHERE first_seen IS NOT NULL
""",
    FIELDS,
)
sql(
    "profile_variant",
    """
SELECT key, CASE WHEN type IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') THEN 'number' WHEN type = 'VARCHAR' THEN 'string'
                 ELSE lower(type) END AS kind,
       type IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') AS is_numeric, event_id AS first_seen, 0 AS position
FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY event_id) AS rn
      FROM (SELECT event_id, key, json_type(props, '$."' || key || '"') AS type
            FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events))
      WHERE type <> 'NULL')
WHERE rn = 1
""",
)
sql(
    "roles",
    """
SELECT view, part, key AS field, agg, CASE WHEN agg = 'entry_sum' THEN 'Sum of ' || key ELSE key END AS label,
       any_field = false OR kind NOT IN ('array', 'object') AS bindable
FROM fields JOIN present USING (key) JOIN (VALUES
  ('series', 'category', 'value', true), ('links', 'entity', 'value', true), ('graph', 'node', 'value', true),
  ('series', 'value', 'value', false), ('series', 'value', 'entry_sum', false), ('graph', 'strength', 'value', false),
  ('hierarchy', 'level', 'value', false), ('hierarchy', 'size', 'value', false),
  ('links', 'connections', 'value', false), ('graph', 'links', 'value', false)
) AS o(view, part, agg, any_field)
  ON any_field
  OR (part = 'level' AND kind NOT IN ('array', 'object'))
  OR (part IN ('connections', 'links') AND kind = 'array')
  OR (agg = 'entry_sum' AND kind = 'object' AND is_numeric)
  OR (part IN ('value', 'strength', 'size') AND agg = 'value' AND kind <> 'object' AND is_numeric)
WHERE first_seen IS NOT NULL AND key <> 'tags'
""",
    FIELDS,
)

# The records of mixed shape, with keys as kind and text.
_MIXED = """records AS (
    SELECT event_id, event_type AS type, CAST(user_id % 7 AS VARCHAR) AS usr, CAST(round(value * 100) AS BIGINT) AS cents,
        CASE event_id % 6 WHEN 0 THEN 'text:' || event_type WHEN 1 THEN 'number:' || usr WHEN 2 THEN 'text:' || usr
            WHEN 3 THEN 'boolean:' || CASE WHEN event_id % 4 = 1 THEN 'true' ELSE 'false' END END AS label,
        CASE WHEN event_id % 10 <> 0 AND event_id % 9 <> 0 THEN CAST(cents AS DOUBLE) END AS strength,
        CASE WHEN event_id % 10 = 0 OR event_id % 9 <> 0 THEN CAST(cents AS DOUBLE) END AS sized,
        ['text:' || event_type, 'number:' || usr, NULL, 'boolean:true', 'text:' || usr] AS near
    FROM events
),
entities AS (SELECT label AS entity, min(event_id) AS seen FROM records WHERE label IS NOT NULL GROUP BY label),
ends AS (SELECT label AS s, unnest(near) AS t FROM records WHERE label IS NOT NULL),
kept AS (SELECT s, t FROM ends WHERE t IN (SELECT entity FROM entities)),
matrix AS (SELECT source, target, count(*) AS value FROM (SELECT s AS source, t AS target FROM kept UNION ALL SELECT t, s FROM kept) GROUP BY source, target),
nodes AS (SELECT label AS id, arg_min(coalesce(strength, 0), event_id) AS value FROM records GROUP BY label)
"""

ORACLE["mixed_series"] = f"""
WITH {_MIXED},
bands AS (SELECT label, row_number() OVER (ORDER BY min(event_id)) - 1 AS i, count(*) OVER () AS n FROM records GROUP BY label)
SELECT event_id AS ord, coalesce(r.label, '') AS category, strength AS value,
    round(sign(strength) * sqrt(abs(strength / (SELECT max(strength) FROM records))), 9) AS length,
    round(2 * pi() / (n + 0.1) * (i + 0.1), 9) AS start_angle
FROM records r JOIN bands b ON r.label IS NOT DISTINCT FROM b.label
"""

ORACLE["mixed_links"] = f"WITH {_MIXED} SELECT source, target, value FROM matrix"

ORACLE["mixed_arcs"] = f"""
WITH {_MIXED},
sums AS (SELECT entity, seen, coalesce(sum(value), 0) AS total FROM entities LEFT JOIN matrix ON entity = source GROUP BY entity, seen),
placed AS (
    SELECT entity, total, row_number() OVER (ORDER BY seen) - 1 AS i, count(*) OVER () AS n, sum(total) OVER () AS links,
        sum(total) OVER (ORDER BY seen) AS upto
    FROM sums
)
SELECT entity, i AS "index", CAST(total AS BIGINT) AS total,
    CASE WHEN length(substring(entity, strpos(entity, ':') + 1)) > 15 THEN substring(entity, strpos(entity, ':') + 1, 15) || '...'
        ELSE substring(entity, strpos(entity, ':') + 1) END AS label,
    round(upto * ((2 * pi() - 0.05 * n) / links) + i * 0.05, 9) AS end_angle
FROM placed
"""

ORACLE["mixed_nodes"] = f"""
WITH {_MIXED},
spread AS (SELECT min(coalesce(strength, 0)) AS low, max(coalesce(strength, 0)) AS high FROM records)
SELECT coalesce(id, '') AS id, value, round((value - low) / (high - low), 9) AS norm, round(10 + (value - low) / (high - low) * 20, 9) AS size
FROM nodes, spread
"""

ORACLE["mixed_graph_links"] = f"""
WITH {_MIXED},
listed AS (SELECT event_id, label, unnest(near) AS target, generate_subscripts(near, 1) - 1 AS pos FROM records)
SELECT event_id AS ord, CAST(pos AS INTEGER) AS pos, label AS source, target FROM listed
WHERE label NOT IN ('number:0', 'boolean:false', 'text:') AND target NOT IN ('number:0', 'boolean:false', 'text:')
    AND target IN (SELECT id FROM nodes WHERE id IS NOT NULL)
"""

ORACLE["mixed_tree"] = f"""
WITH {_MIXED},
leaves AS (SELECT label, type, arg_max(coalesce(sized, 0), event_id) AS value FROM records GROUP BY label, type),
shown AS (SELECT *, coalesce(substring(label, strpos(label, ':') + 1), '-') AS name, coalesce(split_part(label, ':', 1), '-') AS kind FROM leaves)
SELECT name || '/' || type AS names, kind || '/text' AS kinds, 2 AS depth, round(value, 9) AS value, 0 AS n_children FROM shown
UNION ALL SELECT name, kind, 1, round(sum(value), 9), count(*) FROM shown GROUP BY label, name, kind
UNION ALL SELECT '', '', 0, round(sum(value), 9), count(DISTINCT coalesce(label, '')) FROM shown
"""

ORACLE["mixed_select"] = f"""
WITH {_MIXED},
chosen(chosen, key) AS (VALUES ('number', 'number:3'), ('text', 'text:3')),
chords AS (
    SELECT CASE WHEN a.seen <= b.seen THEN source ELSE target END AS s, CASE WHEN a.seen <= b.seen THEN target ELSE source END AS t
    FROM matrix JOIN entities a ON source = a.entity JOIN entities b ON target = b.entity WHERE source <= target
)
SELECT chosen, 'series' AS view, CAST(event_id AS VARCHAR) AS item FROM records JOIN chosen ON label = key
UNION ALL SELECT chosen, 'entities', entity FROM entities JOIN chosen ON entity = key
UNION ALL SELECT chosen, 'nodes', id FROM nodes JOIN chosen ON id = key
UNION ALL SELECT chosen, 'chords', s || '/' || t FROM chords JOIN chosen ON s = key OR t = key
"""

ORACLE["ingest_array_file"] = "SELECT conv_id, turn, role, text FROM conversations"

ORACLE["ingest_objects"] = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"

ORACLE["ingest_versions"] = """
SELECT step, version, event_id, event_type, value
FROM events JOIN (VALUES (0, 1, 0), (1, 1, 0), (2, 3, 1), (3, 1, 0)) AS t(step, version, part) ON event_id % 2 = part
"""

ORACLE["link_incident_stored"] = ORACLE["link_incident"]
ORACLE["graph_incident_stored"] = ORACLE["graph_incident"]

sql("graph_empty", "SELECT count(DISTINCT coalesce(supplier, -1)) AS n_nodes, 0 AS n_shown, 0 AS n_links FROM deals", ORDERS)

ORACLE["tree_zoom"] = ORACLE["tree_subtree"]

sql(
    "tree_way",
    """
SELECT concat_ws('/', l1, l2) AS path, depth, coalesce(name, 'root') AS name, round(value::DOUBLE, 9) AS value
FROM (SELECT l1, l2, depth, name, value FROM nodes WHERE l3 IS NULL AND l1 = 'EUROPE' AND (l2 IS NULL OR l2 = 'NATION_3')
      UNION ALL SELECT NULL, NULL, 0, NULL, sum(value) FROM nodes WHERE depth = 1)
WHERE EXISTS (SELECT 1 FROM nodes WHERE l1 = 'EUROPE' AND l2 = 'NATION_3')
""",
    TREE,
    NODES,
)
sql(
    "tree_intervals",
    """
, numbered AS (
  SELECT *, row_number() OVER (ORDER BY f1, coalesce(f2, -1), coalesce(f3, -1)) AS enter FROM nodes),
held AS (
  SELECT n.*, (SELECT count(*) FROM nodes b WHERE b.l1 = n.l1 AND (n.l2 IS NULL OR b.l2 = n.l2) AND (n.l3 IS NULL OR b.l3 = n.l3)) AS size
  FROM numbered n)
SELECT concat_ws('/', l1, l2, l3) AS path, enter, enter + size - 1 AS leave FROM held
UNION ALL SELECT '', 0, count(*) FROM nodes
""",
    TREE,
    NODES,
)
ORACLE["tree_intervals"] = ORACLE["tree_intervals"].replace("\n, numbered AS", ", numbered AS")
ORACLE["select_tree_intervals"] = ORACLE["select_tree"]

ORACLE["key_dictionary_grown"] = """
WITH first AS (SELECT p_brand AS key, 'text' AS kind, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS index FROM part WHERE p_retailprice > 990 GROUP BY p_brand),
paths AS (SELECT p_brand AS l1, p_size AS l2, min(p_partkey) AS f2 FROM part GROUP BY ALL),
brands AS (SELECT p_brand AS l1, min(p_partkey) AS f1 FROM part GROUP BY ALL),
listed AS (
    SELECT l1 AS key, 'text' AS kind, 0 AS view, f1, 0 AS f2 FROM brands
    UNION ALL SELECT CAST(l2 AS VARCHAR), 'number', 1, f1, f2 FROM paths JOIN brands USING (l1)
),
later AS (SELECT key, kind, view, f1, f2 FROM listed QUALIFY row_number() OVER (PARTITION BY key, kind ORDER BY view, f1, f2) = 1),
added AS (
    SELECT key, kind, (SELECT count(*) FROM first) + row_number() OVER (ORDER BY view, f1, f2) - 1 AS index
    FROM later WHERE NOT EXISTS (SELECT 1 FROM first WHERE first.key = later.key AND first.kind = later.kind)
)
SELECT key, kind, index, index % 10 AS "group" FROM (SELECT * FROM first UNION ALL SELECT * FROM added)
"""

ORACLE["key_numbers"] = """
WITH keys AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part)
SELECT key, 'number' AS kind, index, index % 10 AS "group"
FROM (
    SELECT rtrim(rtrim((k // 1000000) || '.' || lpad(CAST(k % 1000000 AS VARCHAR), 6, '0'), '0'), '.') AS key, i AS index FROM keys
    UNION ALL SELECT k || '000000000000000', n + row_number() OVER (ORDER BY k) - 1 FROM keys WHERE k > 0
)
"""

_SELECTED = """
WITH log AS (
    SELECT CAST(user_id % 50 AS VARCHAR) AS session, event_id AS place, 'k' || event_id % 23 AS key,
        CASE WHEN event_type = 'purchase' THEN 'remove' WHEN event_type = 'error' AND user_id % 5 = 0 THEN 'clear' ELSE 'add' END AS action
    FROM events
),
cleared AS (SELECT session, max(place) AS since FROM log WHERE action = 'clear' GROUP BY session),
last AS (SELECT session, key, place, action FROM log WHERE action <> 'clear' QUALIFY row_number() OVER (PARTITION BY session, key ORDER BY place DESC) = 1)
SELECT session, key, place AS "at" FROM last LEFT JOIN cleared USING (session) WHERE action = 'add' AND (since IS NULL OR place > since)
"""
ORACLE["select_clicks"] = ORACLE["select_click_stream"] = _SELECTED

ORACLE["profile_key_order"] = """
WITH shown AS (
    SELECT event_id, event_id % 6 < 4 AS labelled, event_id % 6 < 5 AS has_label, event_id % 10 = 0 OR event_id % 9 <> 0 AS has_strength FROM events
),
kinds AS (
    SELECT 'label' AS key, CASE event_id % 6 WHEN 1 THEN 'number' WHEN 3 THEN 'boolean' ELSE 'string' END AS kind, event_id, 3 AS position FROM shown WHERE labelled
    UNION ALL SELECT 'strength', CASE WHEN event_id % 10 = 0 THEN 'string' ELSE 'number' END, event_id, CASE WHEN has_label THEN 4 ELSE 3 END FROM shown WHERE has_strength
    UNION ALL SELECT unnest(['near', 'event_id', 'type']), unnest(['array', 'number', 'string']), event_id, unnest([0, 1, 2]) FROM shown
)
SELECT key, kind, kind = 'number' AS is_numeric, event_id AS first_seen, position
FROM kinds QUALIFY row_number() OVER (PARTITION BY key ORDER BY event_id) = 1
"""
