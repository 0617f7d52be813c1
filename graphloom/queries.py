"""Queries over the test tables, one per operator, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries_graph, queries_more, queries_paths
from .operators import closure, drift, hierarchy, nested
from .sources import spill, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of a field from a store's preceding dump file."""
    return drift.changes(table(spark, d, "dump_lines"), table(spark, d, "dump_files"))


def p1_entries(spark: SparkSession, d: str) -> DataFrame:
    """All dumped entries in one table under the union schema; what has no column as name=value."""
    t = drift.unified(table(spark, d, "dump_lines"), table(spark, d, "dump_files"))
    pairs = F.transform(F.map_entries("extra"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return t.withColumn("extra", F.array_join(F.array_sort(pairs), "\n"))


def p1_log(spark: SparkSession, d: str) -> DataFrame:
    """The changes of p1_found in the order of stores and time."""
    return drift.change_log(table(spark, d, "dump_lines"), table(spark, d, "dump_files"))


def _predicate(name: str):
    """A predicate's name in its one form: lower case, `biolink:` before it, runs of blanks,
    hyphens and underscores as one underscore; null for the signs of no predicate."""
    bare = F.regexp_replace(F.lower(F.col(name)), r"(?U)^\s*(biolink:)?\s*|\s+$", "")
    bare = F.regexp_replace(bare, r"(?U)[\s_-]+", "_")
    return F.when(bare.isin("", "~") | F.col(name).isNull(), F.lit(None)).otherwise(F.concat(F.lit("biolink:"), bare))


def _parents(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "predicate_parents").select("snapshot_id", _predicate("predicate").alias("predicate"), _predicate("parent_predicate").alias("parent"), "loaded_at")
    return hierarchy.latest(rows, ["snapshot_id", "predicate"], "parent", "loaded_at")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every predicate, and the predicates on rings of inverses."""
    tree = hierarchy.hierarchy(_parents(spark, d), "snapshot_id", "predicate", "parent")
    rows = table(spark, d, "predicate_inverses").select("snapshot_id", _predicate("predicate").alias("predicate"), _predicate("inverse_predicate").alias("inverse"), "loaded_at")
    ring = hierarchy.rings(hierarchy.latest(rows, ["snapshot_id", "predicate"], "inverse", "loaded_at"), "snapshot_id", "predicate", "inverse")
    parents = tree.select("snapshot_id", F.lit("parent").alias("link_kind"), F.col("node").alias("predicate"), F.coalesce("root", F.lit("")).alias("root_predicate"), F.col("depth").alias("node_depth"))
    return parents.unionByName(ring.select("snapshot_id", F.lit("inverse").alias("link_kind"), F.col("node").alias("predicate"), F.lit("").alias("root_predicate"), F.lit(-1).alias("node_depth")))


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every predicate's full path, depth, root and number of descendants; whether it is on a ring."""
    tree = hierarchy.with_paths(hierarchy.hierarchy(_parents(spark, d), "snapshot_id", "predicate", "parent"), "snapshot_id", " > ")
    return tree.select("snapshot_id", F.col("node").alias("predicate"), "root", "depth", "path", "n_descendants", "on_ring")


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of a predicate and one below it, with the number of links between."""
    tree = hierarchy.hierarchy(_parents(spark, d), "snapshot_id", "predicate", "parent")
    return hierarchy.descendants(hierarchy.with_paths(tree, "snapshot_id"), "snapshot_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every JSON object that is an element of an array in a cache entry's documents."""
    return nested.elements(table(spark, d, "cache_entries"))


def p5_objects(spark: SparkSession, d: str) -> DataFrame:
    """All objects of the documents with their parents and scalar members."""
    return nested.shredded(table(spark, d, "cache_entries")).withColumn("n_scalars", F.size("scalars"))


def p5_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of knowledge and query graphs and of paths, tied to what holds them and to their entry."""
    return nested.held_table(nested.shredded(table(spark, d, "cache_entries")), "edges", "edge", ("subject", "predicate", "object"))


def p5_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of knowledge and query graphs, tied to what holds them and to their entry."""
    return nested.held_table(nested.shredded(table(spark, d, "cache_entries")), "nodes", "node", ("id", "name"))


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    """Array elements that are strings, numbers, booleans or nulls, tied to their object and entry."""
    return nested.array_values(table(spark, d, "cache_entries"))


_PLAIN_DOCS = ("request_json", "meta_json")


def p5_text_objects(spark: SparkSession, d: str) -> DataFrame:
    """All objects of the two documents that are stored as plain text, without their scalars."""
    return nested.shredded(table(spark, d, "cache_entries"), fields=_PLAIN_DOCS).drop("scalars", "holder")


def p5_text_members(spark: SparkSession, d: str) -> DataFrame:
    """Every scalar member of the objects of the two documents that are stored as plain text."""
    return nested.members(nested.shredded(table(spark, d, "cache_entries"), fields=_PLAIN_DOCS))


def p5_bindings(spark: SparkSession, d: str) -> DataFrame:
    """Node and edge bindings of results, tied to their analysis or result and entry."""
    objects = nested.shredded(table(spark, d, "cache_entries"))
    return nested.flat_table(objects.where(F.col("node_path").rlike("/(node|edge)_bindings/")).withColumn("member", F.lit("binding")), ("binding",), ("id",))


def gr7_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """Every ancestor of every predicate that has a root, with its distance."""
    tree = hierarchy.hierarchy(_parents(spark, d), "snapshot_id", "predicate", "parent")
    return closure.ancestors(hierarchy.with_paths(tree, "snapshot_id"), "snapshot_id")


def gr8_nearest_active(spark: SparkSession, d: str) -> DataFrame:
    """GR8-9: the nearest predicate, itself or above, that is not deprecated."""
    tree = hierarchy.with_paths(hierarchy.hierarchy(_parents(spark, d), "snapshot_id", "predicate", "parent"), "snapshot_id")
    rows = table(spark, d, "predicate_parents").select("snapshot_id", _predicate("predicate").alias("node"), F.coalesce("is_deprecated", F.lit(False)).alias("old"), "loaded_at")
    facts = rows.groupBy("snapshot_id", "node").agg(F.max_by("old", F.struct("loaded_at", "old")).alias("old")).withColumn("active", F.col("node"))
    return closure.nearest(tree, facts, "snapshot_id", "active", ~F.col("old"))


def gr10_leaves(spark: SparkSession, d: str) -> DataFrame:
    """The number of leaves under each inner predicate."""
    tree = hierarchy.hierarchy(_parents(spark, d), "snapshot_id", "predicate", "parent")
    return closure.leaves_below(hierarchy.with_paths(tree, "snapshot_id"), "snapshot_id")


def _pathed_facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The predicates' hierarchy, and marks of each by the length of its name and its row."""
    tree = hierarchy.with_paths(hierarchy.hierarchy(_parents(spark, d), "snapshot_id", "predicate", "parent"), "snapshot_id").where("depth >= 0")
    rows = table(spark, d, "predicate_parents").select("snapshot_id", _predicate("predicate").alias("node"), F.coalesce("is_deprecated", F.lit(False)).alias("old"), "loaded_at")
    old = rows.groupBy("snapshot_id", "node").agg(F.max_by("old", F.struct("loaded_at", "old")).alias("is_deprecated"))
    n = F.length("node")
    return spill(tree), old.withColumn("is_mixin", n % 3 == 0).withColumn("is_abstract", n % 7 == 0)


def gr10_concrete(spark: SparkSession, d: str) -> DataFrame:
    """How many predicates at or below each one can stand for themselves."""
    tree, facts = _pathed_facts(spark, d)
    return closure.concrete(tree, facts, "snapshot_id").groupBy("snapshot_id", "node").agg(F.count(F.lit(1)).alias("n_concrete"))


def gr5_satisfies(spark: SparkSession, d: str) -> DataFrame:
    """GR5-6: whether predicates satisfy their roots, and roots the predicates just below them
    (a mixin does so through its implementers)."""
    tree, facts = _pathed_facts(spark, d)
    pairs = tree.where("depth > 0").select("snapshot_id", F.col("node").alias("have"), F.col("root").alias("want")).union(tree.where("depth = 1").select("snapshot_id", "root", "node")).distinct()
    mixins = closure.concrete(tree, facts, "snapshot_id").join(facts.where("is_mixin").select("snapshot_id", "node"), ["snapshot_id", "node"]).withColumnRenamed("node", "mixin")
    return closure.satisfies(tree, pairs, "snapshot_id", mixins)


def gr6_family(spark: SparkSession, d: str) -> DataFrame:
    """The first of some given predicates that each predicate is or stands below."""
    tree, _ = _pathed_facts(spark, d)
    roots = tree.where("depth in (1, 2) and n_descendants >= 3").select("snapshot_id", F.col("node").alias("root"), (-F.col("depth")).alias("place"))
    return closure.family(tree, roots, "snapshot_id")


def gr11_inverses(spark: SparkSession, d: str) -> DataFrame:
    """Inverses given one way, both ways."""
    rows = table(spark, d, "predicate_inverses").select("snapshot_id", _predicate("predicate").alias("predicate"), _predicate("inverse_predicate").alias("inverse"), "loaded_at")
    return closure.completed_inverses(hierarchy.latest(rows, ["snapshot_id", "predicate"], "inverse", "loaded_at"), "snapshot_id", "predicate", "inverse")


def fil27_scope(spark: SparkSession, d: str) -> DataFrame:
    """FIL27, JOIN18, GR12: the predicates that fall under one of some given roots, with the root that admits them."""
    tree = hierarchy.with_paths(hierarchy.hierarchy(_parents(spark, d), "snapshot_id", "predicate", "parent"), "snapshot_id")
    allowed = tree.where("depth = 0 and n_descendants >= 10").select("snapshot_id", F.col("node").alias("root"))
    return tree.join(allowed, ["snapshot_id", "root"], "left_semi").select("snapshot_id", F.col("node").alias("predicate"), "root")


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p1_entries": p1_entries, "p1_log": p1_log, "p3_found": p3_found, "p3_paths": p3_paths, "p3_descendants": p3_descendants, "p5_found": p5_found, "p5_objects": p5_objects, "p5_values": p5_values, "p5_edges": p5_edges, "p5_nodes": p5_nodes, "p5_text_objects": p5_text_objects, "p5_text_members": p5_text_members, "p5_bindings": p5_bindings}
QUERIES |= {"gr7_ancestors": gr7_ancestors, "gr8_nearest_active": gr8_nearest_active, "gr10_leaves": gr10_leaves, "gr11_inverses": gr11_inverses, "gr10_concrete": gr10_concrete, "gr5_satisfies": gr5_satisfies, "gr6_family": gr6_family, "fil27_scope": fil27_scope, **queries_graph.QUERIES, **queries_more.QUERIES, **queries_paths.QUERIES}

_FORM = """CASE WHEN {0} IS NULL THEN NULL WHEN b_{0} IN ('', '~') THEN NULL ELSE concat('biolink:', b_{0}) END"""
_BARE = """regexp_replace(regexp_replace(lower({0}), '^\\s*(biolink:)?\\s*|\\s+$', '', 'g'), '[\\s_-]+', '_', 'g') AS b_{0}"""
_TREE = f"""WITH RECURSIVE raw_p AS (SELECT *, {_BARE.format('predicate')}, {_BARE.format('parent_predicate')} FROM predicate_parents),
par AS (SELECT snapshot_id, node, max_by(coalesce(parent, ''), (loaded_at, coalesce(parent, ''))) AS parent FROM (SELECT snapshot_id, {_FORM.format('predicate')} AS node, {_FORM.format('parent_predicate')} AS parent, loaded_at FROM raw_p) GROUP BY ALL),
names AS (SELECT snapshot_id, node FROM par UNION SELECT snapshot_id, parent FROM par WHERE parent <> ''),
up AS (SELECT snapshot_id, node, node AS anc, 0 AS distance FROM names UNION ALL SELECT up.snapshot_id, up.node, par.parent, distance + 1 FROM up JOIN par ON par.snapshot_id = up.snapshot_id AND par.node = up.anc WHERE par.parent <> '' AND distance < 2000),
tops AS (SELECT u.snapshot_id, u.node, u.anc AS root, u.distance AS depth FROM up u LEFT JOIN par p ON p.snapshot_id = u.snapshot_id AND p.node = u.anc WHERE coalesce(p.parent, '') = '') """
_FACTS = """, fact AS (SELECT snapshot_id, node, max_by(coalesce(is_deprecated, false), (loaded_at, coalesce(is_deprecated, false))) AS old FROM (SELECT snapshot_id, {0} AS node, is_deprecated, loaded_at FROM raw_p) GROUP BY ALL),
ok AS (SELECT u.snapshot_id, u.node, u.anc, u.distance FROM up u SEMI JOIN tops t ON t.snapshot_id = u.snapshot_id AND t.node = u.node),
real AS (SELECT ok.* FROM ok LEFT JOIN fact f ON f.snapshot_id = ok.snapshot_id AND f.node = ok.node WHERE f.node IS NULL OR NOT (f.old OR length(f.node) % 3 = 0 OR length(f.node) % 7 = 0)) """.replace("{0}", _FORM.format("predicate"))
_VOCABULARY = {
    "gr10_concrete": "SELECT snapshot_id, anc AS node, count(*) AS n_concrete FROM real GROUP BY ALL",
    "gr6_family": ", root AS (SELECT t.snapshot_id, t.node, t.depth FROM tops t WHERE t.depth IN (1, 2) AND (t.snapshot_id, t.node) IN (SELECT (snapshot_id, anc) FROM ok WHERE distance > 0 GROUP BY snapshot_id, anc HAVING count(*) >= 3)) SELECT ok.snapshot_id, ok.node, arg_min(r.node, (-r.depth, r.node)) AS family FROM ok JOIN root r ON r.snapshot_id = ok.snapshot_id AND r.node = ok.anc GROUP BY ALL",
    "gr5_satisfies": """, pair AS (SELECT snapshot_id, node AS have, root AS want FROM tops WHERE depth > 0 UNION SELECT snapshot_id, root, node FROM tops WHERE depth = 1),
direct AS (SELECT p.*, o.node IS NOT NULL AS yes FROM pair p LEFT JOIN ok o ON o.snapshot_id = p.snapshot_id AND o.node = p.have AND o.anc = p.want),
each_one AS (SELECT d.snapshot_id, d.have, d.want, o.node IS NOT NULL AS hit FROM direct d LEFT JOIN fact f ON f.snapshot_id = d.snapshot_id AND f.node = d.have AND length(f.node) % 3 = 0 LEFT JOIN real r ON r.snapshot_id = f.snapshot_id AND r.anc = f.node LEFT JOIN ok o ON o.snapshot_id = r.snapshot_id AND o.node = r.node AND o.anc = d.want WHERE NOT d.yes)
SELECT snapshot_id, have, want, true AS is_satisfied FROM direct WHERE yes UNION ALL SELECT snapshot_id, have, want, bool_and(hit) FROM each_one GROUP BY ALL""",
}
_DRIFT_CTE = """WITH RECURSIVE lines AS (SELECT file_id, line_no, try_cast(regexp_replace(raw_line, '^\ufeff+', '') AS JSON) AS j FROM dump_lines),
obj AS (SELECT * FROM lines WHERE json_type(j) = 'OBJECT'),
keyed AS (SELECT file_id, line_no, j, unnest(json_keys(j)) AS name FROM obj),
vals AS (SELECT file_id, line_no, name, list_position(json_keys(j), name) AS pos, j ->> '$.key' AS k, j ->> '$.fetched_at' AS t, json_extract(j, concat('$."', name, '"')) AS v FROM keyed),
typed AS (SELECT *, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS type,
  CASE json_type(v) WHEN 'VARCHAR' THEN v ->> '$' WHEN 'ARRAY' THEN NULL WHEN 'OBJECT' THEN NULL ELSE CAST(v AS VARCHAR) END AS txt FROM vals WHERE json_type(v) <> 'NULL'),
per AS (SELECT file_id, name, type, count(*) AS n, min(line_no) AS first_line FROM typed GROUP BY ALL),
held AS (SELECT file_id, name, arg_max(type, (n, -first_line)) AS type FROM per JOIN (SELECT file_id, count(*) AS n_lines FROM obj GROUP BY file_id) USING (file_id) GROUP BY file_id, name, n_lines HAVING sum(n) * 10 >= n_lines),
seq AS (SELECT * FROM (SELECT file_id, lag(file_id) OVER (PARTITION BY store_id ORDER BY dumped_at, file_id) AS prev_id FROM (SELECT DISTINCT file_id, store_id, dumped_at FROM dump_files)) WHERE prev_id IS NOT NULL),
sides AS (SELECT coalesce(a.file_id, b.file_id) AS file_id, coalesce(a.name, b.name) AS name, a.type AS new_type, b.type AS old_type
  FROM (SELECT s.file_id, name, type FROM seq s JOIN held h ON h.file_id = s.file_id) a FULL JOIN (SELECT s.file_id, name, type FROM seq s JOIN held h ON h.file_id = s.prev_id) b ON a.file_id = b.file_id AND a.name = b.name),
entry AS (SELECT file_id, name, k, t, arg_min(coalesce(txt, chr(0)), line_no) AS txt FROM typed WHERE k IS NOT NULL AND t IS NOT NULL GROUP BY ALL),
cand AS (SELECT q.file_id, o.name AS old_name, w.name AS new_name, count(*) AS n, count(*) FILTER (WHERE o.txt = w.txt AND o.txt <> chr(0)) AS e FROM seq q
  JOIN entry o ON o.file_id = q.prev_id JOIN entry w ON w.file_id = q.file_id AND w.k = o.k AND w.t = o.t
  JOIN sides g ON g.file_id = q.file_id AND g.name = o.name AND g.new_type IS NULL JOIN sides c ON c.file_id = q.file_id AND c.name = w.name AND c.old_type IS NULL GROUP BY ALL HAVING count(*) >= 3 AND e * 5 >= n * 4),
ranked AS (SELECT *, row_number() OVER (PARTITION BY file_id, old_name ORDER BY e / n DESC, n DESC, old_name, new_name) AS r1, row_number() OVER (PARTITION BY file_id, new_name ORDER BY e / n DESC, n DESC, old_name, new_name) AS r2 FROM cand),
ren AS (SELECT file_id, old_name, new_name FROM ranked WHERE r1 = 1 AND r2 = 1) """
_CHANGES = """SELECT file_id, 'renamed' AS change_kind, new_name AS field_name, old_name FROM ren
UNION ALL SELECT file_id, 'removed', name, '' FROM sides WHERE new_type IS NULL AND (file_id, name) NOT IN (SELECT (file_id, old_name) FROM ren)
UNION ALL SELECT file_id, 'added', name, '' FROM sides WHERE old_type IS NULL AND (file_id, name) NOT IN (SELECT (file_id, new_name) FROM ren)
UNION ALL SELECT file_id, 'retyped', name, '' FROM sides WHERE new_type <> old_type
UNION ALL SELECT r.file_id, 'retyped', new_name, '' FROM ren r JOIN sides g ON g.file_id = r.file_id AND g.name = old_name JOIN sides c ON c.file_id = r.file_id AND c.name = new_name WHERE g.old_type <> c.new_type"""
#: The union schema of sf0.01: a table's columns are fixed in SQL, so they are named here.
_P1_TEXT = ("arax_commit", "arax_version", "biolink_version", "endpoint", "error_message", "key", "kind", "model_build", "num_results", "plan_id", "shard", "status", "tool_version", "trapi_version")
_P1_TYPED = {"elapsed_s": "DECIMAL(5,2)", "fetched_at": "TIMESTAMP", "http_status": "BIGINT", "retry_count": "BIGINT"}
_UNION = f""", store AS (SELECT DISTINCT file_id, store_id FROM dump_files),
n_files AS (SELECT name, count(*) AS n FROM held GROUP BY name),
tie AS (SELECT store_id, old_name AS a, new_name AS b FROM ren JOIN store USING (file_id) UNION SELECT store_id, new_name, old_name FROM ren JOIN store USING (file_id)),
reach AS (SELECT a AS name, a AS other FROM tie UNION SELECT r.name, t.b FROM reach r JOIN tie t ON t.a = r.other),
comp AS (SELECT name, min(other) AS comp FROM reach GROUP BY name),
torn AS (SELECT DISTINCT comp FROM (SELECT file_id, comp FROM held JOIN comp USING (name) GROUP BY file_id, comp HAVING count(*) > 1)),
tied AS (SELECT name, field FROM comp JOIN (SELECT comp, arg_max(name, (n, name)) AS field FROM comp JOIN n_files USING (name) WHERE comp NOT IN (SELECT comp FROM torn) GROUP BY comp) USING (comp)),
near AS (SELECT store_id, a AS name, a AS other FROM tie WHERE a IN (SELECT name FROM comp WHERE comp IN (SELECT comp FROM torn)) UNION SELECT r.store_id, r.name, t.b FROM near r JOIN tie t ON t.a = r.other AND t.store_id = r.store_id),
local AS (SELECT store_id, near.name, arg_max(other, (n, other)) AS own FROM near JOIN n_files f ON f.name = near.other GROUP BY ALL),
place AS (SELECT file_id, name, coalesce(field, own, name) AS field FROM (SELECT DISTINCT file_id, name FROM typed) JOIN store USING (file_id) JOIN n_files USING (name) LEFT JOIN tied USING (name) LEFT JOIN local USING (store_id, name)),
cell AS (SELECT t.file_id, t.line_no, t.name, field, coalesce(txt, CAST(v AS VARCHAR)) AS txt, type, pos FROM typed t LEFT JOIN place USING (file_id, name)),
fit AS (SELECT *, CASE {" ".join(f"WHEN field = '{c}' THEN try_cast(txt AS {'DOUBLE' if t.startswith('DEC') else t}) IS NOT NULL" for c, t in _P1_TYPED.items())} ELSE field IN {_P1_TEXT} END AS fits FROM cell),
put AS (SELECT *, fits AND pos = min(pos) FILTER (WHERE fits) OVER (PARTITION BY file_id, line_no, field) AS in_column FROM fit)
SELECT file_id, line_no, {", ".join(f"max(txt) FILTER (WHERE in_column AND field = '{c}') AS f_{c}" for c in _P1_TEXT)}, {", ".join(f"CAST(max(txt) FILTER (WHERE in_column AND field = '{c}') AS {t}) AS f_{c}" for c, t in _P1_TYPED.items())},
 coalesce(string_agg(concat(name, '=', txt), chr(10) ORDER BY concat(name, '=', txt)) FILTER (WHERE NOT coalesce(in_column, false)), '') AS extra
FROM (SELECT file_id, line_no FROM obj) LEFT JOIN put USING (file_id, line_no) GROUP BY file_id, line_no"""
_DOCS = """WITH RECURSIVE raw AS (SELECT DISTINCT entry_id, doc_field, doc FROM (SELECT entry_id, 'request_json' AS doc_field, request_json AS doc FROM cache_entries UNION ALL SELECT entry_id, 'meta_json', meta_json FROM cache_entries)),
top AS (SELECT entry_id, doc_field, try_cast(ltrim(doc, chr(65279)) AS JSON) AS j FROM raw UNION ALL SELECT entry_id, doc_field, try_cast(j ->> '$' AS JSON) FROM top WHERE json_type(j) = 'VARCHAR'),
node AS (SELECT DISTINCT entry_id, doc_field, '' AS path, CAST(NULL AS VARCHAR) AS holder, CAST(NULL AS VARCHAR) AS member, CAST(NULL AS INT) AS place, 0 AS depth, CAST(j AS VARCHAR) AS j FROM top WHERE json_type(j) IN ('OBJECT', 'ARRAY')
 UNION ALL SELECT n.entry_id, n.doc_field, concat(n.path, '/', e.key), CASE WHEN json_type(n.j) = 'OBJECT' THEN n.path ELSE coalesce(n.holder, '') END, CASE WHEN json_type(n.j) = 'OBJECT' THEN e.key ELSE n.member END, CASE WHEN json_type(n.j) = 'ARRAY' THEN CAST(e.key AS INT) END, depth + 1, CAST(e.value AS VARCHAR)
 FROM node n, json_each(n.j) e WHERE json_type(n.j) IN ('OBJECT', 'ARRAY'))
"""
SQL: dict[str, str] = {
    "p5_text_objects": _DOCS + "SELECT DISTINCT entry_id, doc_field, path AS node_path, holder AS parent_path, coalesce(member, '') AS member, place, CAST(depth AS INT) AS depth FROM node WHERE json_type(j) = 'OBJECT'",
    "p5_text_members": _DOCS + "SELECT DISTINCT entry_id, doc_field, holder AS node_path, member AS name, json(j) ->> '$' AS value FROM node WHERE json_type(j) NOT IN ('OBJECT', 'ARRAY') AND place IS NULL AND depth > 0",
    "p1_found": _DRIFT_CTE + _CHANGES,
    "p1_log": _DRIFT_CTE + f""", c AS ({_CHANGES}), o AS (SELECT file_id, store_id, dumped_at, CAST(row_number() OVER (PARTITION BY store_id ORDER BY dumped_at, file_id) AS INT) AS file_no FROM (SELECT DISTINCT file_id, store_id, dumped_at FROM dump_files))
SELECT store_id, file_no, dumped_at, CAST(row_number() OVER (PARTITION BY file_id ORDER BY change_kind, field_name, old_name) AS INT) AS change_no, file_id, change_kind, field_name, old_name FROM c JOIN o USING (file_id)""",
    "p1_entries": _DRIFT_CTE + _UNION,
    **queries_graph.SQL,
    **queries_more.SQL,
    **queries_paths.SQL,
    "p3_found": _TREE + f""", raw_i AS (SELECT *, {_BARE.format('predicate')}, {_BARE.format('inverse_predicate')} FROM predicate_inverses),
inv AS (SELECT snapshot_id, node, max_by(coalesce(other, ''), (loaded_at, coalesce(other, ''))) AS other FROM (SELECT snapshot_id, {_FORM.format('predicate')} AS node, {_FORM.format('inverse_predicate')} AS other, loaded_at FROM raw_i) GROUP BY ALL),
walk AS (SELECT snapshot_id, node, other AS cur, 1 AS n FROM inv WHERE other <> '' UNION ALL SELECT w.snapshot_id, w.node, i.other, n + 1 FROM walk w JOIN inv i ON i.snapshot_id = w.snapshot_id AND i.node = w.cur WHERE i.other <> '' AND w.cur <> w.node AND n < 200)
SELECT n.snapshot_id, 'parent' AS link_kind, n.node AS predicate, coalesce(t.root, '') AS root_predicate, CAST(coalesce(t.depth, -1) AS INT) AS node_depth FROM names n LEFT JOIN tops t USING (snapshot_id, node)
UNION ALL SELECT DISTINCT snapshot_id, 'inverse', node, '', -1 FROM walk WHERE cur = node AND n >= 3""",
    "p3_paths": _TREE + """, trail AS (SELECT up.snapshot_id, up.node, string_agg(anc, ' > ' ORDER BY distance DESC) AS path FROM up JOIN tops USING (snapshot_id, node) GROUP BY ALL),
below AS (SELECT snapshot_id, anc AS node, count(*) AS n FROM up WHERE distance > 0 AND (snapshot_id, node) IN (SELECT (snapshot_id, node) FROM tops) GROUP BY ALL),
ring AS (SELECT DISTINCT snapshot_id, node FROM up WHERE distance > 0 AND anc = node)
SELECT n.snapshot_id, n.node AS predicate, t.root, CAST(coalesce(t.depth, -1) AS INT) AS depth, trail.path, CASE WHEN t.root IS NOT NULL THEN coalesce(b.n, 0) END AS n_descendants, r.node IS NOT NULL AS on_ring
FROM names n LEFT JOIN tops t USING (snapshot_id, node) LEFT JOIN trail USING (snapshot_id, node) LEFT JOIN below b USING (snapshot_id, node) LEFT JOIN ring r USING (snapshot_id, node)""",
    "gr7_ancestors": _TREE + "SELECT up.snapshot_id, up.node, up.anc AS ancestor, CAST(up.distance AS INT) AS distance FROM up JOIN tops USING (snapshot_id, node) WHERE up.distance > 0",
    "p3_descendants": _TREE + "SELECT up.snapshot_id, up.anc AS node, up.node AS descendant, CAST(up.distance AS INT) AS distance FROM up JOIN tops USING (snapshot_id, node) WHERE up.distance > 0",
    "gr10_leaves": _TREE + ", inner_n AS (SELECT DISTINCT snapshot_id, parent AS node FROM par WHERE parent <> '') SELECT up.snapshot_id, up.anc AS node, count(*) AS n_leaves FROM up JOIN tops USING (snapshot_id, node) WHERE up.distance > 0 AND (up.snapshot_id, up.node) NOT IN (SELECT (snapshot_id, node) FROM inner_n) GROUP BY ALL",
    "gr8_nearest_active": _TREE + """, old AS (SELECT snapshot_id, node, max_by(coalesce(is_deprecated, false), (loaded_at, coalesce(is_deprecated, false))) AS old FROM (SELECT snapshot_id, {0} AS node, is_deprecated, loaded_at FROM raw_p) GROUP BY ALL)
SELECT up.snapshot_id, up.node, min_by(up.anc, up.distance) AS active FROM up JOIN old o ON o.snapshot_id = up.snapshot_id AND o.node = up.anc AND NOT o.old WHERE up.distance = 0 OR (up.snapshot_id, up.node) IN (SELECT (snapshot_id, node) FROM tops) GROUP BY ALL""".replace("{0}", _FORM.format("predicate")),
    "gr11_inverses": f"""WITH raw_i AS (SELECT *, {_BARE.format('predicate')}, {_BARE.format('inverse_predicate')} FROM predicate_inverses),
inv AS (SELECT snapshot_id, node, max_by(coalesce(other, ''), (loaded_at, coalesce(other, ''))) AS other FROM (SELECT snapshot_id, {_FORM.format('predicate')} AS node, {_FORM.format('inverse_predicate')} AS other, loaded_at FROM raw_i) GROUP BY ALL)
SELECT snapshot_id, node AS predicate, other AS inverse FROM inv WHERE other <> '' UNION SELECT snapshot_id, other, node FROM inv WHERE other <> ''""",
    **{n: _TREE + _FACTS + q for n, q in _VOCABULARY.items()},
    "fil27_scope": _TREE + "SELECT t.snapshot_id, t.node AS predicate, t.root FROM tops t WHERE (t.snapshot_id, t.root) IN (SELECT (snapshot_id, root) FROM tops GROUP BY snapshot_id, root HAVING count(*) >= 11)",
}
