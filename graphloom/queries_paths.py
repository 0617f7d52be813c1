"""Queries of paths, candidates and grounding over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scoring as S
from .functions.fixed import CONFLATION_GROUPS, STRENGTHS, TAXON_SCOPED
from .operators import grounding, paths, ranking, resolve, sets
from .queries_graph import SCORE_SQL, STRENGTH_SQL, _two_paths, scored
from .sources import table
from .sources.graph import SQL_VIEWS, edges

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (SQL_VIEWS + sql) if views else sql
        return f

    return add


# ---- a pool of paths: from one supplier to orders and to suppliers of the same part ------

_POOL = f""", sc AS MATERIALIZED (SELECT *, {SCORE_SQL} AS score, {STRENGTH_SQL} AS strength FROM edges WHERE predicate IN ('x:supplies', 'x:contains', 'x:fulfils')),
pool AS (SELECT [subject, object] AS nodes, object AS id, [edge_id] AS eids, [predicate] AS preds, CAST([] AS VARCHAR[]) AS mids, [negated] AS neg, [num_publications] AS pubs, [strength] AS strengths, [score] AS scores, 1 AS length FROM sc WHERE subject = 'SUPP:3' AND predicate = 'x:fulfils'
 UNION ALL SELECT [a.subject, a.object, b.subject], b.subject, [a.edge_id, b.edge_id], [a.predicate, b.predicate], [p_brand], [a.negated, b.negated], [a.num_publications, b.num_publications], [a.strength, b.strength], [a.score, b.score], 2
 FROM sc a JOIN sc b ON b.object = a.object AND b.edge_id <> a.edge_id AND b.predicate IN ('x:supplies', 'x:contains') JOIN part ON concat('PART:', p_partkey) = a.object WHERE a.subject = 'SUPP:3' AND a.predicate = 'x:supplies') """


def path_pool(spark: SparkSession, d: str) -> DataFrame:
    """Paths with what their edges say, in arrays by edge."""
    e = scored(edges(spark, d, "x:supplies", "x:contains", "x:fulfils")).withColumn("strength", S.strength(F.col("knowledge_level"), F.col("agent_type"), F.col("num_publications"), F.col("primary_source")))
    said = {"edges": "edge_id", "predicates": "predicate", "negated": "negated", "publications": "num_publications", "strengths": "strength", "scores": "score"}
    first = e.where("subject = 'SUPP:3'")
    one = first.where("predicate = 'x:fulfils'").select(F.array("subject", "object").alias("nodes"), F.col("object").alias("id"), F.array().cast("array<string>").alias("middles"), *[F.array(c).alias(n) for n, c in said.items()], F.lit(1).alias("length"))
    a = first.where("predicate = 'x:supplies'").select("object", F.col("subject").alias("start"), *[F.col(c).alias(f"a_{c}") for c in said.values()])
    b = e.where("predicate in ('x:supplies', 'x:contains')").select("object", F.col("subject").alias("id"), *[F.col(c).alias(f"b_{c}") for c in said.values()])
    brand = table(spark, d, "part").select(F.concat(F.lit("PART:"), "p_partkey").alias("object"), F.array("p_brand").alias("middles"))
    two = a.join(b, "object").where("a_edge_id != b_edge_id").join(brand, "object")
    return one.unionByName(two.select(F.array("start", "object", "id").alias("nodes"), "id", "middles", *[F.array(f"a_{c}", f"b_{c}").alias(n) for n, c in said.items()], F.lit(2).alias("length")))


_BRANDS = tuple(f"Brand#{i}" for i in range(1, 21))
RULE_SETS = {
    "middles": {"allowed_middles": _BRANDS, "banned_middles": ("Brand#3",)},
    "listed": {"allowed": ("x:supplies", "x:fulfils")},
    "required": {"banned": ("x:fulfils",), "required": ("x:contains",)},
    "evidence": {"least_publications": 1, "least_strength": "moderate"},
    "strength": {"least_strength": "strong"},
}
_STRONG = {n: list(STRENGTHS[: STRENGTHS.index(n) + 1]) for n in ("strong", "moderate")}
_DROP = {
    "middles": f"WHEN NOT list_has_all({list(_BRANDS)}, mids) THEN 'middle_category_not_allowed' WHEN list_has_any(mids, ['Brand#3']) THEN 'middle_category_excluded' WHEN list_bool_or(neg) THEN 'negated_edge'",
    "listed": "WHEN NOT list_has_all(['x:supplies', 'x:fulfils'], preds) THEN 'predicate_not_whitelisted' WHEN list_bool_or(neg) THEN 'negated_edge'",
    "required": "WHEN list_has_any(preds, ['x:fulfils']) THEN 'predicate_blacklisted' WHEN NOT list_has_any(preds, ['x:contains']) THEN 'required_predicate_absent' WHEN list_bool_or(neg) THEN 'negated_edge'",
    "evidence": f"WHEN list_bool_or(neg) THEN 'negated_edge' WHEN list_min(pubs) < 1 THEN 'insufficient_publications' WHEN NOT list_has_all({_STRONG['moderate']}, strengths) THEN 'weak_edge'",
    "strength": f"WHEN list_bool_or(neg) THEN 'negated_edge' WHEN NOT list_has_all({_STRONG['strong']}, strengths) THEN 'weak_edge'",
}


@query(_POOL + " UNION ALL ".join(f"SELECT '{n}' AS rule_set, CASE WHEN len(list_distinct(nodes)) < len(nodes) THEN 'repeated_node' {c} ELSE 'kept' END AS reason, count(*) AS n FROM pool GROUP BY ALL" for n, c in _DROP.items()))
def fil19_path_filter(spark: SparkSession, d: str) -> DataFrame:
    """How many paths each rule of several requests drops, the first broken rule counting: one pass."""
    c = F.col
    reasons = F.array(*[F.struct(F.lit(n).alias("rule_set"), paths.drop_reason(c("nodes"), c("middles"), c("predicates"), c("negated"), c("publications"), c("strengths"), **r).alias("reason")) for n, r in RULE_SETS.items()])
    return path_pool(spark, d).select(F.explode(reasons).alias("r")).groupBy("r.rule_set", "r.reason").agg(F.count(F.lit(1)).alias("n"))


_MEANING = {"x:fulfils": "biolink:contraindicated_in", "x:supplies": "biolink:related_to", "x:contains": "biolink:affects"}


@query(_POOL + """SELECT CASE WHEN list_has_any(mids, ['Brand#5']) THEN 'malformed' WHEN list_bool_or(neg) THEN 'negated' WHEN preds[-1] = 'x:fulfils' THEN 'contrary' WHEN list_has_all(['x:supplies'], preds) THEN 'no_mechanism' ELSE 'ok' END AS verdict, count(*) AS n FROM pool GROUP BY ALL""")
def gr15_path_review(spark: SparkSession, d: str) -> DataFrame:
    """FIL20, GR15: paths by what they may be used for."""
    names = F.create_map(*[F.lit(x) for pair in _MEANING.items() for x in pair])
    said = F.when(~F.array_contains("middles", "Brand#5"), F.transform("predicates", lambda p: names[p]))
    return path_pool(spark, d).groupBy(paths.verdict(said, F.col("negated")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


_KEYS = {"shortest": "length, list_min(scores) DESC", "evidence": "list_min(scores) DESC, length", "composite": "round(list_avg(scores) - 0.05 * length, 6) DESC, length"}


@query(_POOL + " UNION ALL ".join(f"SELECT '{n}' AS way, id, array_to_string(eids, '|') AS path, CAST(rank AS INT) AS rank FROM (SELECT id, eids, row_number() OVER (PARTITION BY id ORDER BY {k}, array_to_string(eids, '|')) AS rank FROM pool) WHERE rank <= 2" for n, k in _KEYS.items()))
def win9_path_order(spark: SparkSession, d: str) -> DataFrame:
    """The two best paths to every end, by each of three orders."""
    pool = path_pool(spark, d).select("id", F.array_join("edges", "|").alias("path"), "scores", "length")
    out = None
    for way in _KEYS:
        order = [*paths.path_order(way, F.col("scores"), F.col("length"), 6), F.col("path")]
        part = ranking.top_in_groups(pool, ["id"], order, 2).select(F.lit(way).alias("way"), "id", "path", "rank")
        out = part if out is None else out.unionByName(part)
    return out


_CANDIDATES = """, cand AS (SELECT id, list_sort(list(DISTINCT path_id)) AS path_ids FROM (
 SELECT object AS id, 'P1' AS path_id FROM edges WHERE predicate = 'x:supplies' AND subject = 'SUPP:3' UNION ALL SELECT b.object, 'P2' FROM edges a JOIN edges b ON a.object = b.subject WHERE a.predicate = 'x:placed' AND a.subject = 'CUST:7' AND b.predicate = 'x:contains') GROUP BY id) """


@query(_CANDIDATES + "SELECT CAST(rank AS INT) AS rank, id FROM (SELECT id, row_number() OVER (ORDER BY len(path_ids) DESC, id) AS rank FROM cand WHERE list_has_any(path_ids, ['P2'])) WHERE rank <= 5")
def gr3_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """The five best candidates of a path, from which an explanation starts."""
    c = sets.union_of(_two_paths(spark, d), "id").withColumn("path_ids", F.split("path_ids", ";"))
    return paths.endpoints(c, ("P2",), 5, [F.col("n_paths").desc(), F.col("id")]).select("rank", "id")


@query(_POOL + """, c AS (SELECT concat('SUPP:', s_suppkey) AS id FROM supplier), per AS (SELECT id, count(*) AS n FROM pool GROUP BY id)
SELECT id, coalesce(n, 0) AS n_paths FROM c LEFT JOIN per USING (id) UNION ALL SELECT 'unattached', count(*) FROM pool WHERE id NOT IN (SELECT id FROM c)""")
def join14_attached_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths attached to the candidates they reach; the others are counted, not lost."""
    c = table(spark, d, "supplier").select(F.concat(F.lit("SUPP:"), "s_suppkey").alias("id"))
    got, rest = paths.attached(c, path_pool(spark, d).select("id"))
    return got.unionByName(rest.agg(F.lit("unattached").alias("id"), F.count(F.lit(1)).alias("n_paths")))


@query(_POOL + """SELECT CAST(rank AS INT) AS rank, eid AS edge_id FROM (SELECT eid, row_number() OVER (ORDER BY first_len, first_path, eid) AS rank FROM (SELECT eid, min(length) AS first_len, arg_min(path, (length, path)) AS first_path FROM (SELECT length, array_to_string(eids, '|') AS path, unnest(eids) AS eid FROM pool) GROUP BY eid)) WHERE rank <= 200""")
def win13_budget(spark: SparkSession, d: str) -> DataFrame:
    """WIN13, SET6: the first 200 different edges in the order of the paths that name them."""
    pool = path_pool(spark, d).select("length", F.array_join("edges", "|").alias("path"), F.explode("edges").alias("edge_id"))
    return ranking.budgeted(pool, "edge_id", ["length", "path"], 200).select("rank", "edge_id")


_TIED = "SELECT concat('PART:', p_partkey) AS id, p_name AS name, p_size % 4 AS score, CASE WHEN p_size > 10 THEN p_size END AS path_priority, CASE WHEN p_size > 20 THEN 2000 + p_size END AS recency FROM part"
_TIE_SQL = {"path_priority": "coalesce(path_priority, 1000000)", "alphabetical": "lower(name) NULLS LAST", "recency": "recency DESC NULLS LAST", "random": "md5(concat('7:', id))"}


@query(" UNION ALL ".join(f"SELECT '{n}' AS rule, id, CAST(rank AS INT) AS rank FROM (SELECT id, row_number() OVER (ORDER BY score DESC, {k}, id) AS rank FROM ({_TIED})) WHERE rank <= 20" for n, k in _TIE_SQL.items()), views=False)
def win3_tie_rules(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty of many equal scores, by each rule for ties."""
    c = table(spark, d, "part").selectExpr("concat('PART:', p_partkey) as id", "p_name as name", "p_size % 4 as score", "case when p_size > 10 then p_size end as path_priority", "case when p_size > 20 then 2000 + p_size end as recency")
    out = None
    for rule in _TIE_SQL:
        part = ranking.top(c, [F.col("score").desc(), *ranking.tie_keys(rule, "id", seed=7)], 20).select(F.lit(rule).alias("rule"), "id", "rank")
        out = part if out is None else out.unionByName(part)
    return out


# ---- candidates of names -----------------------------------------------------------------

_FOUND = """WITH c AS (SELECT concat('PART:', p_partkey) AS id, concat(p_name, '/', p_size) AS name, CASE p_size % 3 WHEN 0 THEN 'Gene' WHEN 1 THEN 'biolink:Protein' ELSE 'Disease' END AS category,
 CASE p_partkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['T:1'] WHEN 2 THEN ['T:2'] ELSE ['T:1', 'T:2'] END AS taxa, CASE p_partkey % 5 WHEN 0 THEN ['Gene'] WHEN 1 THEN ['Protein', 'Polypeptide'] WHEN 2 THEN ['Drug'] WHEN 3 THEN ['SmallMolecule'] ELSE [] END AS types FROM part) """


def _found(spark: SparkSession, d: str) -> DataFrame:
    kind = "case p_size % 3 when 0 then 'Gene' when 1 then 'biolink:Protein' else 'Disease' end as category"
    taxa = "case p_partkey % 4 when 0 then cast(array() as array<string>) when 1 then array('T:1') when 2 then array('T:2') else array('T:1', 'T:2') end as taxa"
    types = "case p_partkey % 5 when 0 then array('Gene') when 1 then array('Protein', 'Polypeptide') when 2 then array('Drug') when 3 then array('SmallMolecule') else cast(array() as array<string>) end as types"
    return table(spark, d, "part").selectExpr("concat('PART:', p_partkey) as id", "concat(p_name, '/', p_size) as name", kind, taxa, types)


@query(_FOUND + f"SELECT id, name FROM c WHERE replace(category, 'biolink:', '') NOT IN {TAXON_SCOPED} OR len(taxa) = 0 OR list_has_any(taxa, ['T:1'])", views=False)
def fil16_taxon_filter(spark: SparkSession, d: str) -> DataFrame:
    """The candidates of a taxon, where their category has taxa at all."""
    return resolve.taxon_filter(_found(spark, d), ["T:1"]).select("id", "name")


_GENES, _DRUGS = sorted({"Gene", *CONFLATION_GROUPS["gene_protein"]}), sorted({"Drug", *CONFLATION_GROUPS["drug_chemical"]})


@query(_FOUND + " UNION ALL ".join(f"SELECT '{n}' AS asked, id, NOT fits AS is_fallback FROM (SELECT id, fits, bool_or(fits) OVER (PARTITION BY name) AS any_fits FROM (SELECT *, list_has_any(types, {a}) AS fits FROM c)) WHERE fits OR NOT any_fits" for n, a in (("gene", _GENES), ("drug", ["Drug"]), ("drug_or_chemical", _DRUGS))), views=False)
def fil17_category_filter(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of a category or one taken for it; where a name has none, all its candidates."""
    asked = {"gene": ("biolink:Gene", ()), "drug": ("Drug", ()), "drug_or_chemical": ("Drug", ("drug_chemical",))}
    out = None
    for n, (category, flags) in asked.items():
        part = resolve.category_filter(_found(spark, d), category, flags).select(F.lit(n).alias("asked"), "id", "is_fallback")
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT event_type, CASE WHEN event_type IN ('click', 'view') THEN 'up' WHEN event_type IN ('error') THEN 'down' ELSE 'undirected' END AS side, count(*) AS n FROM events GROUP BY ALL""", views=False)
def fil18_direction(spark: SparkSession, d: str) -> DataFrame:
    """Records split by direction, by sets of synonyms."""
    t = resolve.by_direction(table(spark, d, "events").select("event_type"), "event_type", {"up": ["Click", "view"], "down": ["ERROR"]})
    return t.groupBy("event_type", "side").agg(F.count(F.lit(1)).alias("n"))


@query(_FOUND + "SELECT id, CASE WHEN len(types) = 0 THEN 'skipped' WHEN list_contains(types, 'Protein') THEN 'ok' ELSE 'mismatch' END AS verdict FROM c", views=False)
def fil21_category_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether results are of the category asked for."""
    return _found(spark, d).select("id", resolve.category_check(F.col("types"), "biolink:Protein").alias("verdict"))


@query("""SELECT doc_id, CASE WHEN lang IS NULL AND journal_id IS NULL THEN 'absent' WHEN journal_id IS NOT NULL AND journal_id <> 'J' THEN CASE WHEN doc_id % 3 = 0 THEN 'curie_drift' WHEN coalesce(lower(trim(lang, ' ')) <> lower(trim(home_lang, ' ')), false) THEN 'label_drift' ELSE 'match' END WHEN coalesce(lower(trim(lang, ' ')) <> lower(trim(home_lang, ' ')), false) THEN 'label_drift' ELSE 'match' END AS verdict
FROM documents LEFT JOIN journals USING (journal_id)""", views=False)
def fil22_concept_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether what came back agrees with what it is anchored to, in label and identifier."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "journal_id").join(table(spark, d, "journals").select("journal_id", "home_lang"), "journal_id", "left")
    anchor = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("journal_id"), F.lit("-old"))).otherwise(F.col("journal_id"))
    return docs.select("doc_id", resolve.concept_verdict(F.col("lang"), F.col("home_lang"), F.col("journal_id"), anchor).alias("verdict"))


# ---- grounding ---------------------------------------------------------------------------

_SAID = """WITH l AS (SELECT DISTINCT string_id, result_id AS result, lexicon_field AS field, pubid, string_text AS t FROM lexicon_strings WHERE string_text IS NOT NULL AND result_id IS NOT NULL),
st AS (SELECT result, string_id AS statement_id, CASE string_id % 3 WHEN 0 THEN 'anchors' WHEN 1 THEN 'resolution_options' ELSE 'finding' END AS kind, [concat('E', string_id % 40)] AS cites,
 CASE WHEN field = 'quarantine' AND string_id % 2 = 0 THEN concat('It says ', t) ELSE concat('See ', coalesce(pubid, 'PMID:0'), ' and Q:', string_id % 4, ' “', substring(t, 3, 20), '”') END AS text FROM l),
edge AS (SELECT result, concat('E', i) AS token FROM (SELECT DISTINCT result FROM l), range(30) r(i)),
vq AS (SELECT DISTINCT result, t FROM l WHERE field = 'verified_quotes' AND string_id % 5 <> 0),
qu AS (SELECT DISTINCT result, t FROM l WHERE field = 'quarantine' AND length(t) >= 40),
named AS (SELECT DISTINCT result, statement_id, kind, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_.]*:[A-Za-z0-9_.|/-]*[A-Za-z0-9]')) AS token FROM st),
quo AS (SELECT DISTINCT result, statement_id, unnest(regexp_extract_all(text, '“([^”]+)”', 1)) AS token FROM st)
SELECT statement_id, 'unknown_edge' AS fault, cites[1] AS token FROM st WHERE CAST(cites[1][2:] AS INT) >= 30
UNION ALL SELECT statement_id, 'ungrounded_identifier', token FROM named n WHERE (result, token) NOT IN (SELECT (result, pubid) FROM l WHERE pubid IS NOT NULL AND string_id % 2 = 0) AND NOT (kind = 'anchors' AND token = 'Q:1') AND NOT (kind = 'resolution_options' AND token = 'Q:2')
UNION ALL SELECT statement_id, 'unverified_quote', token FROM quo q WHERE NOT EXISTS (SELECT 1 FROM vq WHERE vq.result = q.result AND (contains(vq.t, trim(q.token, ' ')) OR contains(q.token, vq.t)))
UNION ALL SELECT DISTINCT statement_id, 'model_authored_text', t FROM st JOIN qu USING (result) WHERE contains(text, t)"""


@query(_SAID, views=False)
def ctl22_grounding(spark: SparkSession, d: str) -> DataFrame:
    """CTL22, AGG20: what statements say that their result does not hold: edges, identifiers,
    quotations, and text that a model wrote."""
    rows = table(spark, d, "lexicon_strings").where("string_text is not null and result_id is not null").select("string_id", F.col("result_id").alias("result"), F.col("lexicon_field").alias("field"), "pubid", F.col("string_text").alias("token")).distinct()
    results = rows.select("result").distinct()
    lex = grounding.lexicon({
        "edge": results.select("result", F.explode(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.concat(F.lit("E"), i))).alias("token")),
        "publication": rows.where("string_id % 2 = 0").select("result", F.col("pubid").alias("token")),
        "verified_quote": rows.where("field = 'verified_quotes' and string_id % 5 != 0"),
        "quarantine": rows.where("field = 'quarantine'"),
        "query_term": results.withColumn("token", F.lit("Q:1")),
        "candidate": results.withColumn("token", F.lit("Q:2")),
    })
    kind = "case string_id % 3 when 0 then 'anchors' when 1 then 'resolution_options' else 'finding' end as kind"
    text = "case when field = 'quarantine' and string_id % 2 = 0 then concat('It says ', token) else concat('See ', coalesce(pubid, 'PMID:0'), ' and Q:', string_id % 4, ' “', substring(token, 3, 20), '”') end as text"
    said = rows.selectExpr("result", "string_id as statement_id", kind, text, "array(concat('E', string_id % 40)) as supported_by")
    return grounding.faults(said, lex)
