"""Queries of the graph operators over the order tables seen as a graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import attributes as A
from .functions import scoring as S
from .functions.compare import apply_op
from .operators import match, paths, ranking, rules, sets
from .plans import Entity, Hop, Plan
from .sources import table
from .sources.graph import SQL_VIEWS, edges, line_evidence, nodes

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (SQL_VIEWS + sql) if views else sql
        return f

    return add


# Fixed source lists of the sample graph.
CURATED, TEXT_MINED = ("infores:src0", "infores:base"), ("infores:src3",)

CUSTOMER = "CUST:7"
CHAIN = Plan(
    (Entity("customer", "Customer", (CUSTOMER,), False), Entity("purchase", "Order"), Entity("part", "Part"), Entity("supplier", "Supplier")),
    (Hop("customer", "x:placed", "purchase"), Hop("purchase", "x:contains", "part"), Hop("supplier", "x:supplies", "part")),
    "supplier",
)
TRIANGLE = Plan(
    (Entity("supplier", "Supplier", ("SUPP:3",), False), Entity("purchase", "Order"), Entity("part", "Part")),
    (Hop("supplier", "x:fulfils", "purchase"), Hop("purchase", "x:contains", "part"), Hop("supplier", "x:supplies", "part")),
    "part",
)


def scored(e: DataFrame) -> DataFrame:
    return e.withColumn("score", S.edge_score(F.col("knowledge_level"), F.col("agent_type"), F.col("num_publications"), F.col("num_sources"), S.primary_source_score(F.col("primary_source"), CURATED, TEXT_MINED)))


SCORE_SQL = """round(0.30 * CASE knowledge_level WHEN 'knowledge_assertion' THEN 1.0 WHEN 'prediction' THEN 0.3 ELSE 0.5 END
 + 0.20 * CASE agent_type WHEN 'manual_agent' THEN 1.0 WHEN 'text_mining_agent' THEN 0.4 ELSE 0.5 END
 + 0.20 * CASE WHEN num_publications <= 0 THEN 0.5 ELSE least(1.0, 0.5 + 0.5 * log10(1 + num_publications) / log10(11.0)) END
 + 0.15 * CASE WHEN num_sources <= 0 THEN 0.4 WHEN num_sources = 1 THEN 0.6 WHEN num_sources = 2 THEN 0.8 ELSE 1.0 END
 + 0.15 * CASE WHEN primary_source IN ('infores:src3') THEN 0.5 WHEN primary_source IN ('infores:src0', 'infores:base') THEN 0.9 ELSE 0.7 END, 4)"""


# ---- sources -----------------------------------------------------------------------------


@query("""SELECT s.category AS subject_category, predicate, o.category AS object_category, count(*) AS n
FROM edges JOIN nodes s ON s.id = subject JOIN nodes o ON o.id = object GROUP BY ALL""")
def src4_meta_graph(spark: SparkSession, d: str) -> DataFrame:
    """What kinds of nodes each predicate links, and how often."""
    return match.meta_triples(edges(spark, d), nodes(spark, d))


@query("""SELECT * FROM (SELECT id, name, category, row_number() OVER (ORDER BY id) AS rank FROM nodes WHERE lower(trim(name)) = 'red widget' AND category IN ('Part')) WHERE rank <= 20""")
def src5_name_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 nodes of a name and category."""
    hits = nodes(spark, d).where((F.lower(F.trim("name")) == "red widget") & F.col("category").isin("Part"))
    return ranking.top(hits, [F.col("id")], 20)


@query("""SELECT doc_id, pubid, journal_name, pub_year FROM documents LEFT JOIN journals USING (journal_id) WHERE pubid IS NOT NULL""", views=False)
def src6_publications(spark: SparkSession, d: str) -> DataFrame:
    """Publication records with the names of their journals."""
    j = table(spark, d, "journals").select("journal_id", "journal_name")
    return table(spark, d, "documents").where("pubid is not null").select("doc_id", "pubid", "journal_id", "pub_year").join(j, "journal_id", "left").select("doc_id", "pubid", "journal_name", "pub_year")


TTL_SQL = "CASE status WHEN 'error' THEN 3600.0 WHEN 'timeout' THEN 604800.0 ELSE 2592000.0 END"


@query(f"""SELECT cache_key, entry_id, status, age_s <= ttl_s AS is_fresh FROM (
  SELECT cache_key, entry_id, status, {TTL_SQL} AS ttl_s, epoch_us(TIMESTAMP '2031-12-01 00:00:00' - ingested_at) / 1000000.0 AS age_s,
         row_number() OVER (PARTITION BY cache_key ORDER BY ingested_at DESC, entry_id DESC) AS r FROM cache_entries) WHERE r = 1""".replace("epoch_us(TIMESTAMP '2031-12-01 00:00:00' - ingested_at) / 1000000.0", "(epoch_us(TIMESTAMP '2031-12-01 00:00:00') - epoch_us(ingested_at)) / 1000000.0"), views=False)
def src14_cache_read(spark: SparkSession, d: str) -> DataFrame:
    """The latest entry of each key, and whether its time to live has passed at a given time."""
    from .streaming.expiry import latest_fresh

    return latest_fresh(table(spark, d, "cache_entries"), "cache_key", "ingested_at", "entry_id", "2031-12-01 00:00:00").select("cache_key", "entry_id", "status", "is_fresh")


# ---- projections -------------------------------------------------------------------------


_NO_NAMES = ", ".join(f"'{f}', cast(null as string)" for f in A.NAME_FIELDS[1:])
_NO_OTHERS = ", ".join(f"'{f}', cast(null as string)" for f in A.NAME_FIELDS[2:])


def edge_records(spark: SparkSession, d: str) -> DataFrame:
    """Supplies edges in the nested form in which a graph service returns them."""
    li = line_evidence(spark, d)

    def attr(name: str, value, inner: str = "array()") -> str:
        return f"named_struct('attribute_type_id', '{name}', {_NO_NAMES}, 'value', {value}, 'attributes', {inner})"

    level = attr("biolink:knowledge_level", "filter(array(knowledge_level), x -> x is not null)", f"cast(array() as array<{A.INNER}>)")
    agent = attr("biolink:agent_type", "filter(array(agent_type), x -> x is not null)", f"cast(array() as array<{A.INNER}>)")
    pubs = "transform(sequence(1, num_publications), k -> concat('PMID:', l_orderkey, '-', k))"
    outer = attr("biolink:primary_support", "array('see below')", f"array(named_struct('attribute_type_id', 'biolink:publications', {_NO_NAMES}, 'value', {pubs}))")
    none = f"cast(array() as array<{A.ATTRIBUTE}>)"
    neg = attr("negated", "array(cast(negated as string))", f"cast(array() as array<{A.INNER}>)")
    sources = f"concat(if(primary_source is null, cast(array() as array<{A.SOURCE}>), array(named_struct('resource_id', primary_source, 'resource_role', 'primary_knowledge_source'))), if(num_sources > 1, array(named_struct('resource_id', 'infores:second', 'resource_role', cast(null as string))), cast(array() as array<{A.SOURCE}>)))"
    return li.selectExpr("lid as edge_id", f"concat(array({level}, {agent}, {neg}), if(num_publications > 0, array({outer}), {none})) as attributes", f"{sources} as sources")


@query("""SELECT lid AS edge_id, coalesce(array_to_string(list_sort(list_transform(range(1, num_publications + 1), lambda k: concat('PMID:', l_orderkey, '-', k))), ';'), '') AS pubs,
 coalesce(knowledge_level, 'not_provided') AS knowledge_level, coalesce(agent_type, 'not_provided') AS agent_type, negated,
 primary_source, concat_ws(';', CASE WHEN num_sources > 1 THEN 'infores:second' END, primary_source) AS sources, CASE WHEN num_sources > 1 THEN 1 ELSE 0 END AS n_unknown_role FROM line""")
def prj_edge_attributes(spark: SparkSession, d: str) -> DataFrame:
    """PRJ1-9, PRJ13: publications (one level down), level, agent, sign and sources of nested edge records."""
    e, a, s = edge_records(spark, d).withColumn("flat", A.flat(F.col("attributes"))), F.col("flat"), F.col("sources")
    return e.select(
        "edge_id",
        F.array_join(A.publications(a), ";").alias("pubs"),
        A.first_value(a, "knowledge_level", "not_provided").alias("knowledge_level"),
        A.first_value(a, "agent_type", "not_provided").alias("agent_type"),
        A.negated(F.lit(None).cast("boolean"), a).alias("negated"),
        A.primary_source(s).alias("primary_source"),
        F.array_join(A.all_sources(s), ";").alias("sources"),
        F.size(A.by_role(s, "unknown")).alias("n_unknown_role"),
    )


NODE_STATUS = "CASE WHEN p_size <= 15 THEN 'approved' WHEN p_size <= 30 THEN 'not_approved' WHEN p_size <= 40 THEN CAST(p_size AS VARCHAR) END"


@query(f"""SELECT concat('PART:', p_partkey) AS id, {NODE_STATUS} AS approval, CASE WHEN p_size <= 15 THEN 1.0 WHEN p_size <= 30 THEN 0.0 WHEN p_size <= 40 THEN CAST(p_size AS DOUBLE) END AS approval_value,
 CASE WHEN p_size <= 40 THEN 'approval_status;brand' ELSE 'brand' END AS names FROM part""", views=False)
def prj_node_fields(spark: SparkSession, d: str) -> DataFrame:
    """PRJ10-12, PRJ14: a node's field by local name on either level, all names, words as numbers."""
    status = "case when p_size <= 15 then 'approved' when p_size <= 30 then 'not_approved' when p_size <= 40 then cast(p_size as string) end"
    inner = f"named_struct('attribute_type_id', cast(null as string), 'original_attribute_name', 'Approval-Status', {_NO_OTHERS}, 'value', array(status))"
    attrs = f"array(named_struct('attribute_type_id', 'x:brand', {_NO_NAMES}, 'value', array(p_brand), 'attributes', if(status is null, cast(array() as array<{A.INNER}>), array({inner})))) as attributes"
    p = table(spark, d, "part").selectExpr("concat('PART:', p_partkey) as id", "p_brand", f"{status} as status").selectExpr("id", attrs).withColumn("flat", A.flat(F.col("attributes")))
    value = F.get(A.named(F.col("flat"), "approval_status"), 0)
    return p.select("id", value.alias("approval"), A.number_or_flag(value).alias("approval_value"), F.array_join(A.names(F.col("flat")), ";").alias("names"))


@query("""SELECT DISTINCT parent_predicate AS raw, CASE WHEN starts_with(parent_predicate, 'biolink:') THEN parent_predicate ELSE concat('biolink:', parent_predicate) END AS prefixed,
 list_reduce(list_transform(regexp_split_to_array(lower(replace(parent_predicate, 'biolink:', '')), '[_ ]+'), lambda w: concat(upper(substring(w, 1, 1)), substring(w, 2, 1000))), lambda a, b: concat(a, b)) AS camel
 FROM predicate_parents WHERE parent_predicate IS NOT NULL AND parent_predicate <> ''""", views=False)
def prj_name_forms(spark: SparkSession, d: str) -> DataFrame:
    """PRJ15, PRJ19: names with their prefix, and in camel case."""
    p = table(spark, d, "predicate_parents").where("parent_predicate is not null and parent_predicate != ''").select(F.col("parent_predicate").alias("raw")).distinct()
    return p.select("raw", A.prefixed(F.col("raw")).alias("prefixed"), A.camel_case(F.regexp_replace("raw", "biolink:", "")).alias("camel"))


@query("""SELECT doc_id, CASE WHEN pub_year > 1800 AND pub_year < 2200 THEN pub_year ELSE CAST(year(collected_at) AS INT) END AS year, coalesce(length(text) > 50, false) AS has_text FROM documents""", views=False)
def prj_publication_fields(spark: SparkSession, d: str) -> DataFrame:
    """PRJ17, PRJ18: the first plausible year of several fields; whether there is text to read."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", A.year(F.col("pub_year"), F.year("collected_at")).alias("year"), F.coalesce(F.length("text") > 50, F.lit(False)).alias("has_text"))


@query("""SELECT doc_id, substring(sha256(concat('pepper::', text)), 1, 16) AS digest FROM documents WHERE doc_kind = 'question' AND text IS NOT NULL""", views=False)
def prj25_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Questions as salted digests."""
    q = table(spark, d, "documents").where("doc_kind = 'question' and text is not null")
    return q.select("doc_id", A.digest(F.col("text"), "pepper").alias("digest"))


@query("""SELECT id, min_by(label, precedence) AS label FROM (
  SELECT id, name AS label, 1 AS precedence FROM nodes WHERE name IS NOT NULL UNION ALL SELECT object, concat('object of ', min(edge_id)), 2 FROM edges GROUP BY object
  UNION ALL SELECT subject, concat('subject of ', min(edge_id)), 3 FROM edges GROUP BY subject) GROUP BY id""")
def prj26_label_index(spark: SparkSession, d: str) -> DataFrame:
    """One label for each id of all nodes and all edges, from the best of several sources."""
    e = edges(spark, d)
    own = nodes(spark, d).where("name is not null").select("id", F.col("name").alias("label"), F.lit(1).alias("precedence"))
    o = e.groupBy(F.col("object").alias("id")).agg(F.concat(F.lit("object of "), F.min("edge_id")).alias("label")).withColumn("precedence", F.lit(2))
    s = e.groupBy(F.col("subject").alias("id")).agg(F.concat(F.lit("subject of "), F.min("edge_id")).alias("label")).withColumn("precedence", F.lit(3))
    return own.unionByName(o).unionByName(s).groupBy("id").agg(F.min_by("label", "precedence").alias("label"))


# ---- filters -----------------------------------------------------------------------------

OP_CASES = [("eq", "p_type", "economy"), ("neq", "p_type", "economy"), ("in", "p_type", ["ECONOMY", "promo"]), ("not_in", "p_type", ["ECONOMY", "promo"]), ("gte", "p_size", 25), ("lte", "p_size", 25), ("gt", "p_size", "25"), ("lt", "p_size", 25), ("contains", "p_name", "RED"), ("exists", "p_name", None), ("not_exists", "p_name", None), ("gt", "p_name", 3), ("gt", "p_size", "many")]
_OP_SQL = ["lower(p_type) = 'economy'", "lower(p_type) <> 'economy'", "lower(p_type) IN ('economy', 'promo')", "lower(p_type) NOT IN ('economy', 'promo')", "p_size >= 25", "p_size <= 25", "p_size > 25", "p_size < 25", "contains(lower(p_name), 'red')", "p_name IS NOT NULL", "p_name IS NULL", "false", "false"]


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{i}_{op}_{c}' AS op_case, count(*) FILTER (WHERE {s}) AS n FROM part" for i, ((op, c, _), s) in enumerate(zip(OP_CASES, _OP_SQL))) + ")", views=False)
def fil1_apply_op(spark: SparkSession, d: str) -> DataFrame:
    """How many parts meet each comparison: one scan for all."""
    p = table(spark, d, "part")
    one = p.agg(*[F.count_if(apply_op(op, F.array(F.col(c).cast("string")) if op not in ("exists", "not_exists") else F.col(c), x)).alias(f"{i}_{op}_{c}") for i, (op, c, x) in enumerate(OP_CASES)])
    return one.unpivot([], one.columns, "op_case", "n")


RULES = lambda: [rules.present("primary", "primary_source"), rules.at_least("publications", "num_publications", 2), rules.one_of("agent", "agent_type", ["manual_agent"]), rules.one_of("level", "knowledge_level", ["knowledge_assertion", "logical_entailment"]), rules.none_of("not_src3", "primary_source", ["infores:src3"]), rules.at_least("year", "pub_year", 1998), rules.is_false("sign", "negated")]
_RULE_SQL = {"primary": ("primary_source IS NOT NULL", "primary_source IS NULL"), "publications": ("num_publications >= 2", "num_publications = 0"), "agent": ("coalesce(agent_type = 'manual_agent', false)", "agent_type IS NULL"), "level": ("coalesce(knowledge_level IN ('knowledge_assertion', 'logical_entailment'), false)", "knowledge_level IS NULL"), "not_src3": ("coalesce(primary_source <> 'infores:src3', true)", "primary_source IS NULL"), "year": ("coalesce(pub_year >= 1998, false)", "pub_year IS NULL"), "sign": ("NOT negated", "negated IS NULL")}
_ALL_RULES = " AND ".join(k for k, _ in _RULE_SQL.values())


@query("SELECT *, n_dropped - n_missing AS n_mismatch, round(n_dropped / greatest(n_checked, 1), 6) AS drop_rate FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) AS n_checked, count(*) FILTER (WHERE NOT ({k})) AS n_dropped, count(*) FILTER (WHERE NOT ({k}) AND ({m})) AS n_missing FROM edges WHERE predicate = 'x:supplies'" for n, (k, m) in [*_RULE_SQL.items(), ("all", (_ALL_RULES, "false"))]) + ")")
def fil10_rule_accounts(spark: SparkSession, d: str) -> DataFrame:
    """FIL2-10, AGG6: what every rule drops, for want of a value or for a wrong one."""
    return rules.account(edges(spark, d, "x:supplies"), RULES())


@query(f"SELECT edge_id, subject, object FROM edges WHERE predicate = 'x:supplies' AND {_ALL_RULES}")
def fil14_filtered_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges that pass all rules."""
    return rules.kept(edges(spark, d, "x:supplies"), RULES()).select("edge_id", "subject", "object")


@query("""SELECT concat('PART:', p_partkey) AS id, CASE WHEN p_size > 40 THEN 'missing' WHEN p_size <= 15 THEN 'kept' ELSE 'mismatch' END AS outcome FROM part""", views=False)
def fil11_entity_constraint(spark: SparkSession, d: str) -> DataFrame:
    """FIL11-12: the first present of several aliased fields decides; none present fails as missing."""
    p = table(spark, d, "part").selectExpr("concat('PART:', p_partkey) as id", "case when p_size <= 15 then 'approved' end as approval_status", "case when p_size between 16 and 40 then 'withdrawn' end as max_phase_status")
    field = F.coalesce("approval_status", "max_phase_status")
    met = apply_op("in", F.array(field), ["approved", "ever_approved"])
    return p.select("id", rules.first_reason([("missing", field.isNull()), ("mismatch", ~met)]).alias("outcome"))


@query(f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN NOT ({_ALL_RULES.replace('num_publications', 'e.num_publications').replace('primary_source', 'e.primary_source').replace('agent_type', 'e.agent_type').replace('knowledge_level', 'e.knowledge_level').replace('pub_year', 'e.pub_year').replace('negated', 'e.negated')}) THEN 'unsupported_edge' WHEN p.p_size > 40 THEN 'constraint:part.size' ELSE 'kept' END AS reason
 FROM edges o JOIN edges e ON e.subject = o.object JOIN part p ON concat('PART:', p.p_partkey) = e.object WHERE o.predicate = 'x:placed' AND e.predicate = 'x:contains') GROUP BY reason""")
def fil13_instance_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The first reason for which each two-hop instance falls."""
    e = edges(spark, d, "x:placed", "x:contains")
    whole = F.lit(True)
    for r in RULES():
        whole = whole & r.keep
    placed = e.where("predicate = 'x:placed'").select(F.col("object").alias("purchase"))
    flagged = e.where("predicate = 'x:contains'").select(F.col("subject").alias("purchase"), F.col("object").alias("part"), whole.alias("ok"))
    sizes = table(spark, d, "part").selectExpr("concat('PART:', p_partkey) as part", "p_size")
    inst = placed.join(flagged, "purchase").join(sizes, "part")
    return inst.select(rules.first_reason([("unsupported_edge", ~F.col("ok")), ("constraint:part.size", F.col("p_size") > 40)]).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


STRENGTH_SQL = """CASE WHEN knowledge_level = 'knowledge_assertion' AND agent_type = 'manual_agent' THEN 'asserted_only' WHEN knowledge_level = 'knowledge_assertion' OR num_publications >= 3 THEN 'strong'
 WHEN num_publications >= 1 OR (primary_source IS NOT NULL AND coalesce(knowledge_level, 'not_provided') NOT IN ('prediction', 'not_provided')) THEN 'moderate' WHEN primary_source IS NOT NULL THEN 'weak' ELSE 'any' END"""


@query(f"SELECT predicate, {STRENGTH_SQL} AS strength, count(*) AS n FROM edges GROUP BY ALL")
def fil15_strength(spark: SparkSession, d: str) -> DataFrame:
    """Edges by predicate and evidence strength."""
    e = edges(spark, d)
    return e.groupBy("predicate", S.strength(F.col("knowledge_level"), F.col("agent_type"), F.col("num_publications"), F.col("primary_source")).alias("strength")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, CASE WHEN text IS NULL OR length(trim(text)) < 3 THEN 'too_short' WHEN length(trim(text)) > 600 THEN 'too_long' WHEN regexp_matches(lower(text), '(ignore|disregard) (all|previous)|<\\|endoftext\\|>|<s>') THEN 'control' ELSE 'ok' END AS verdict FROM documents WHERE doc_kind = 'question'""", views=False)
def fil23_text_screen(spark: SparkSession, d: str) -> DataFrame:
    """Ordered screens of submitted text by length and patterns."""
    q = table(spark, d, "documents").where("doc_kind = 'question'")
    n = F.length(F.trim("text"))
    bad = F.lower("text").rlike(r"(ignore|disregard) (all|previous)|<\|endoftext\|>|<s>")
    return q.select("doc_id", rules.first_reason([("too_short", F.col("text").isNull() | (n < 3)), ("too_long", n > 600), ("control", bad)], "ok").alias("verdict"))


@query("""SELECT predicate, count(*) >= 50000 AS is_truncated, least(count(*), 50000) AS n_kept FROM edges GROUP BY predicate""")
def fil28_truncation(spark: SparkSession, d: str) -> DataFrame:
    """Whether a result reaches a given size, and so may be cut."""
    n = F.count(F.lit(1))
    return edges(spark, d).groupBy("predicate").agg((n >= 50000).alias("is_truncated"), F.least(n, F.lit(50000)).cast("bigint").alias("n_kept"))


# ---- joins -------------------------------------------------------------------------------


@query(f"SELECT subject AS customer, object AS purchase, edge_id AS edge_1 FROM edges WHERE predicate = 'x:placed' AND subject = '{CUSTOMER}'")
def join1_one_hop(spark: SparkSession, d: str) -> DataFrame:
    """All edges of one predicate from a pinned node."""
    plan = Plan(CHAIN.entities[:2], CHAIN.hops[:1], "purchase")
    return match.match(edges(spark, d, "x:placed"), plan, nodes(spark, d))


@query(f""", a AS MATERIALIZED (SELECT edge_id, subject, object FROM edges WHERE predicate = 'x:placed' AND subject = '{CUSTOMER}'), b AS MATERIALIZED (SELECT edge_id, subject, object FROM edges WHERE predicate = 'x:contains'), c AS MATERIALIZED (SELECT edge_id, subject, object FROM edges WHERE predicate = 'x:supplies'),
ab AS MATERIALIZED (SELECT a.subject AS customer, a.object AS purchase, b.object AS part, a.edge_id AS edge_1, b.edge_id AS edge_2 FROM a JOIN b ON b.subject = a.object)
SELECT ab.customer, ab.purchase, ab.part, c.subject AS supplier, edge_1, edge_2, c.edge_id AS edge_3 FROM ab JOIN c ON c.object = ab.part""")
def join2_chain(spark: SparkSession, d: str) -> DataFrame:
    """JOIN2-3: three hops from a pinned node."""
    return match.match(edges(spark, d, "x:placed", "x:contains", "x:supplies"), CHAIN, nodes(spark, d))


@query(""", a AS MATERIALIZED (SELECT edge_id, subject, object FROM edges WHERE predicate = 'x:fulfils' AND subject = 'SUPP:3'), b AS MATERIALIZED (SELECT edge_id, subject, object FROM edges WHERE predicate = 'x:contains'), c AS MATERIALIZED (SELECT edge_id, subject, object FROM edges WHERE predicate = 'x:supplies' AND subject = 'SUPP:3'),
ab AS MATERIALIZED (SELECT a.subject AS supplier, a.object AS purchase, b.object AS part, a.edge_id AS edge_1, b.edge_id AS edge_2 FROM a JOIN b ON b.subject = a.object)
SELECT ab.supplier, ab.purchase, ab.part, edge_1, edge_2, c.edge_id AS edge_3 FROM ab JOIN c ON c.object = ab.part AND c.subject = ab.supplier""")
def join4_closing_hop(spark: SparkSession, d: str) -> DataFrame:
    """A triangle: the last hop joins on both of its ends."""
    return match.match(edges(spark, d, "x:fulfils", "x:contains", "x:supplies"), TRIANGLE)


@query("""SELECT count(*) FILTER (WHERE ok) AS n_kept, count(*) FILTER (WHERE NOT ok) AS n_rejected FROM (SELECT e.object IN (SELECT concat('PART:', p_partkey) FROM part WHERE p_size <= 10) AS ok FROM edges e WHERE predicate = 'x:supplies')""")
def join5_anchor_guard(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs bind an anchor to an id that is allowed, and to another."""
    allowed = table(spark, d, "part").where("p_size <= 10").selectExpr("concat('PART:', p_partkey) as id")
    good, bad = match.anchor_guard(edges(spark, d, "x:supplies").select("edge_id", "object"), "object", allowed)
    return good.agg(F.count(F.lit(1)).alias("n_kept")).select("n_kept", bad.agg(F.count(F.lit(1))).scalar().alias("n_rejected"))


@query(f"""SELECT 1 AS step, 'customer-x:placed-purchase' AS hop, (SELECT count(*) FROM edges WHERE predicate = 'x:placed' AND subject = '{CUSTOMER}') AS n_edges, (SELECT count(*) FROM edges WHERE predicate = 'x:placed' AND subject = '{CUSTOMER}') AS n_joined
UNION ALL SELECT 2, 'purchase-x:contains-part', (SELECT count(*) FROM edges WHERE predicate = 'x:contains'), (SELECT count(*) FROM edges a JOIN edges b ON b.subject = a.object WHERE a.predicate = 'x:placed' AND a.subject = '{CUSTOMER}' AND b.predicate = 'x:contains')
UNION ALL SELECT 3, 'supplier-x:supplies-part', (SELECT count(*) FROM edges WHERE predicate = 'x:supplies'), (SELECT count(*) FROM edges a JOIN edges b ON b.subject = a.object JOIN edges c ON c.object = b.object WHERE a.predicate = 'x:placed' AND a.subject = '{CUSTOMER}' AND b.predicate = 'x:contains' AND c.predicate = 'x:supplies')""")
def join6_localised(spark: SparkSession, d: str) -> DataFrame:
    """JOIN6, AGG7: edges of each hop alone and bindings after it."""
    return match.hop_counts(edges(spark, d, "x:placed", "x:contains", "x:supplies"), CHAIN)


@query("""SELECT id, count(DISTINCT path_id) AS n_paths, array_to_string(list_sort(list(DISTINCT path_id)), ';') AS path_ids FROM (
 SELECT object AS id, 'P1' AS path_id FROM edges WHERE predicate = 'x:supplies' AND subject = 'SUPP:3' UNION ALL SELECT b.object, 'P2' FROM edges a JOIN edges b ON a.object = b.subject WHERE a.predicate = 'x:placed' AND a.subject = 'CUST:7' AND b.predicate = 'x:contains') GROUP BY id""")
def join8_merged_paths(spark: SparkSession, d: str) -> DataFrame:
    """JOIN8, SET1, SET3: the candidates of two paths as one set with their supporting paths."""
    return sets.union_of(_two_paths(spark, d), "id")


def _two_paths(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    p1 = edges(spark, d, "x:supplies").where("subject = 'SUPP:3'").select(F.col("object").alias("id"))
    e = edges(spark, d, "x:placed", "x:contains")
    plan = Plan(CHAIN.entities[:3], CHAIN.hops[:2], "part")
    return {"P1": p1, "P2": match.match(e, plan).select(F.col("part").alias("id"))}


@query("""SELECT h.*, EXISTS (SELECT 1 FROM t WHERE t.s = subject_category AND t.p = predicate AND t.o = object_category) AS is_supported, EXISTS (SELECT 1 FROM t WHERE t.o = subject_category AND t.p = predicate AND t.s = object_category) AS is_reverse_supported,
 (SELECT count(*) FROM t WHERE t.s = subject_category AND t.o = object_category AND t.p <> predicate) AS n_alternatives FROM (VALUES ('Customer', 'x:placed', 'Order'), ('Order', 'x:placed', 'Customer'), ('Supplier', 'x:contains', 'Part'), ('Part', 'x:contains', 'Nation')) h(subject_category, predicate, object_category)""".replace("SELECT h.*", ", t AS (SELECT DISTINCT s.category AS s, predicate AS p, o.category AS o FROM edges JOIN nodes s ON s.id = subject JOIN nodes o ON o.id = object) SELECT h.*"))
def join10_meta_support(spark: SparkSession, d: str) -> DataFrame:
    """JOIN10-11: whether the graph has the kinds of edges that hops ask for."""
    hops = spark.createDataFrame([("Customer", "x:placed", "Order"), ("Order", "x:placed", "Customer"), ("Supplier", "x:contains", "Part"), ("Part", "x:contains", "Nation")], "subject_category string, predicate string, object_category string")
    return match.supported(hops, match.meta_triples(edges(spark, d), nodes(spark, d)))


@query("SELECT id, category FROM nodes WHERE id NOT IN (SELECT subject FROM edges WHERE predicate = 'x:located_in') AND id NOT IN (SELECT object FROM edges WHERE predicate = 'x:located_in')")
def join12_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that no edge of a kind names."""
    e = edges(spark, d, "x:located_in")
    used = e.select(F.col("subject").alias("id")).union(e.select("object")).distinct()
    return nodes(spark, d).join(used, "id", "left_anti").select("id", "category")


_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_QUOTES = f"concat(replace(translate(substring(text, cast(length(text) / 3 as int) + 1, 40), '{_LOWER}', '{_UPPER}'), ' ', '  '), case when doc_id % 3 = 0 then ' zq' else '' end)"


@query(f"""WITH q AS (SELECT doc_id AS quote_id, pubid, trim(regexp_replace(translate({_QUOTES.replace('length(text) / 3', 'length(text) // 3')}, '{_UPPER}', '{_LOWER}'), '\\s+', ' ', 'g'), ' ') AS quote FROM documents WHERE pubid IS NOT NULL AND text IS NOT NULL)
SELECT DISTINCT quote_id, doc_id FROM q JOIN documents d USING (pubid) WHERE length(quote) >= 15 AND contains(trim(regexp_replace(translate(text, '{_UPPER}', '{_LOWER}'), '\\s+', ' ', 'g'), ' '), quote)""", views=False)
def join17_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Quotes that stand in the publication they name, whatever their case and blanks: stretches
    of all documents in other case and with wider blanks, a third of them with a word put in."""
    docs = table(spark, d, "documents").where("pubid is not null and text is not null").select("doc_id", "pubid", "text")
    quotes = docs.selectExpr("doc_id as quote_id", "pubid", f"{_QUOTES} as quote")
    return match.quoted(quotes, docs, "pubid")


# ---- paths -------------------------------------------------------------------------------

ROUTE_SQL = """, steps AS (SELECT subject AS a, object AS b, edge_id, predicate FROM edges WHERE predicate = 'x:located_in' UNION ALL SELECT object, subject, edge_id, predicate FROM edges WHERE predicate = 'x:located_in'),
walk AS (SELECT concat('|', a, '|', b, '|') AS trail, predicate AS preds, b AS cur, 1 AS n FROM steps WHERE a = 'SUPP:2'
 UNION ALL SELECT concat(trail, s.b, '|'), concat(preds, ',', s.predicate), s.b, n + 1 FROM walk JOIN steps s ON s.a = walk.cur WHERE n < 4 AND walk.cur NOT IN ('SUPP:3', 'SUPP:4', 'SUPP:5', 'SUPP:6', 'SUPP:7', 'SUPP:8', 'SUPP:9', 'SUPP:10', 'SUPP:11', 'SUPP:12') AND NOT contains(trail, concat('|', s.b, '|'))) """


@query(ROUTE_SQL + "SELECT trim(trail, '|') AS trail, n AS length FROM walk WHERE cur IN ('SUPP:3', 'SUPP:4', 'SUPP:5', 'SUPP:6', 'SUPP:7', 'SUPP:8', 'SUPP:9', 'SUPP:10', 'SUPP:11', 'SUPP:12')")
def gr1_simple_paths(spark: SparkSession, d: str) -> DataFrame:
    """GR1, GR3-4: simple paths of up to four hops from one supplier to several others."""
    p = paths.simple_paths(edges(spark, d, "x:located_in"), ["SUPP:2"], [f"SUPP:{i}" for i in range(3, 13)], 4)
    return p.select(F.array_join("nodes", "|").alias("trail"), "length")


@query("""SELECT concat(a.subject, ' --[x:supplies]--> ', a.object, ' --[x:supplies]--> ', b.subject) AS route, count(*) AS variant_count FROM edges a JOIN edges b ON a.object = b.object WHERE a.predicate = 'x:supplies' AND b.predicate = 'x:supplies' AND a.subject = 'SUPP:1' AND b.subject = 'SUPP:2' GROUP BY ALL""")
def gr2_route_variants(spark: SparkSession, d: str) -> DataFrame:
    """GR2, PRJ22: routes with the number of parallel edges behind each, described."""
    p = paths.simple_paths(edges(spark, d, "x:supplies"), ["SUPP:1"], ["SUPP:2"], 2)
    return paths.distinct_routes(p).select(A.path_description(F.col("nodes"), F.col("predicates")).alias("route"), "variant_count")


# ---- aggregates --------------------------------------------------------------------------


@query(f"SELECT edge_id, {SCORE_SQL} AS score FROM edges WHERE predicate = 'x:supplies'")
def agg2_edge_scores(spark: SparkSession, d: str) -> DataFrame:
    """The evidence score of every edge."""
    return scored(edges(spark, d, "x:supplies")).select("edge_id", "score")


@query(f""", s AS (SELECT subject, object, {SCORE_SQL} AS score FROM edges WHERE predicate = 'x:supplies')
SELECT subject, object, min(score) AS weakest, max(score) AS strongest, round(avg(score), 8) AS mean_score, round(product(score), 8) AS product_score, count(*) AS n_edges FROM s GROUP BY subject, object""")
def agg3_instance_scores(spark: SparkSession, d: str) -> DataFrame:
    """One score for the parallel edges of each pair, four ways."""
    s = scored(edges(spark, d, "x:supplies")).groupBy("subject", "object").agg(F.array_sort(F.collect_list("score")).alias("all"), F.count(F.lit(1)).alias("n_edges"))
    return s.select("subject", "object", S.combined(F.col("all"), "min").alias("weakest"), F.array_max("all").alias("strongest"), F.round(S.combined(F.col("all"), "mean"), 8).alias("mean_score"), F.round(S.combined(F.col("all"), "product"), 8).alias("product_score"), "n_edges")


BUCKET_SQL = "CASE WHEN num_publications = 0 THEN '0' WHEN num_publications = 1 THEN '1' WHEN num_publications <= 4 THEN '2-4' WHEN num_publications <= 9 THEN '5-9' ELSE '10+' END"


@query(f"""SELECT facet, value, count(*) AS n FROM (SELECT unnest([{{'facet': 'level', 'value': coalesce(knowledge_level, 'not_provided')}}, {{'facet': 'agent', 'value': coalesce(agent_type, 'not_provided')}}, {{'facet': 'primary', 'value': coalesce(primary_source, 'none')}}, {{'facet': 'publications', 'value': {BUCKET_SQL}}}, {{'facet': 'decile', 'value': CAST(CAST(floor({SCORE_SQL} * 10) AS INT) AS VARCHAR)}}, {{'facet': 'negated', 'value': CASE WHEN negated THEN 'true' ELSE 'false' END}}], recursive := true) FROM edges) GROUP BY facet, value""")
def agg4_distribution(spark: SparkSession, d: str) -> DataFrame:
    """The evidence of all edges by several facets, in one pass."""
    e = scored(edges(spark, d))
    n = F.col("num_publications")
    bucket = F.when(n == 0, "0").when(n == 1, "1").when(n <= 4, "2-4").when(n <= 9, "5-9").otherwise("10+")
    facets = {"level": F.coalesce("knowledge_level", F.lit("not_provided")), "agent": F.coalesce("agent_type", F.lit("not_provided")), "primary": F.coalesce("primary_source", F.lit("none")), "publications": bucket, "decile": F.floor(F.col("score") * 10).cast("int").cast("string"), "negated": F.col("negated").cast("string")}
    pre = e.groupBy(*[c.alias(k) for k, c in facets.items()]).agg(F.count(F.lit(1)).alias("n"))
    return pre.unpivot(["n"], list(facets), "facet", "value").groupBy("facet", "value").agg(F.sum("n").alias("n"))


@query("""SELECT level, n, CAST(sum(n) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n_so_far FROM (SELECT coalesce(knowledge_level, 'not_provided') AS level, CASE coalesce(knowledge_level, 'not_provided') WHEN 'knowledge_assertion' THEN 1 WHEN 'not_provided' THEN 5 ELSE 6 END AS place, count(*) AS n FROM edges WHERE predicate = 'x:supplies' GROUP BY ALL)""")
def agg5_threshold_preview(spark: SparkSession, d: str) -> DataFrame:
    """How many edges would pass at each level, best first: a running sum over a handful of levels."""
    from pyspark.sql import Window

    level = F.coalesce("knowledge_level", F.lit("not_provided"))
    per = edges(spark, d, "x:supplies").groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))
    place = F.when(F.col("level") == "knowledge_assertion", 1).when(F.col("level") == "not_provided", 5).otherwise(6)
    return per.withColumn("n_so_far", F.sum("n").over(Window.orderBy(place).rowsBetween(Window.unboundedPreceding, 0))).select("level", "n", "n_so_far")


@query(f""", s AS (SELECT subject, object, predicate, edge_id, num_publications, primary_source, pub_year, {SCORE_SQL} AS score FROM edges WHERE predicate = 'x:supplies')
SELECT subject AS id, count(DISTINCT object) AS n_parts, count(*) AS n_edges, round(avg(score), 4) AS mean_score, CAST(sum(num_publications) AS BIGINT) AS n_publications, count(DISTINCT primary_source) AS n_sources, max(pub_year) AS latest FROM s GROUP BY subject""")
def agg1_candidate_metrics(spark: SparkSession, d: str) -> DataFrame:
    """What is known of each supplier; what is unknown stays null."""
    s = scored(edges(spark, d, "x:supplies"))
    return s.groupBy(F.col("subject").alias("id")).agg(F.count_distinct("object").alias("n_parts"), F.count(F.lit(1)).alias("n_edges"), F.round(F.avg("score"), 4).alias("mean_score"), F.sum("num_publications").alias("n_publications"), F.count_distinct("primary_source").alias("n_sources"), F.max("pub_year").alias("latest"))


@query("""SELECT subject, predicate, object, count(*) AS n_edges, array_to_string(list_sort(list(DISTINCT primary_source) FILTER (WHERE primary_source IS NOT NULL)), ';') AS sources, max(num_publications) AS most_publications, bool_or(negated) AS any_negated FROM edges WHERE predicate = 'x:supplies' GROUP BY subject, predicate, object""")
def agg12_triples(spark: SparkSession, d: str) -> DataFrame:
    """Parallel edges collapsed to triples."""
    e = edges(spark, d, "x:supplies")
    out = e.groupBy("subject", "predicate", "object").agg(F.count(F.lit(1)).alias("n_edges"), F.array_join(F.array_sort(F.collect_set("primary_source")), ";").alias("sources"), F.max("num_publications").alias("most_publications"), F.bool_or("negated").alias("any_negated"))
    return out.withColumn("sources", F.when(F.col("sources") != "", F.col("sources")))


@query("""SELECT subject, round(avg(lit), 6) AS literature_score FROM (SELECT subject, CASE WHEN num_publications = 0 THEN NULL WHEN CAST(l_quantity AS INT) % 3 = 0 THEN 0.0 ELSE least(1.0, 0.6 + 0.4 * least(1.0, (num_publications - 1) / 2)) END AS lit FROM (SELECT concat('SUPP:', l_suppkey) AS subject, num_publications, l_quantity FROM line)) GROUP BY subject""")
def agg13_literature(spark: SparkSession, d: str) -> DataFrame:
    """AGG13-14: edges without texts are left out of the mean, unsupported ones count as 0."""
    li = line_evidence(spark, d)
    supporting = F.when(F.col("l_quantity").cast("int") % 3 == 0, 0).otherwise(F.col("num_publications"))
    s = li.select(F.concat(F.lit("SUPP:"), F.col("l_suppkey")).alias("subject"), S.literature_score(F.col("num_publications"), supporting).alias("lit"))
    return s.groupBy("subject").agg(F.round(F.avg("lit"), 6).alias("literature_score"))


@query("""SELECT kind, status, count(*) AS n, round(avg(elapsed_s), 4) AS mean_elapsed, round(median(elapsed_s), 4) AS median_elapsed, max(elapsed_s) AS max_elapsed FROM cache_entries GROUP BY kind, status""", views=False)
def agg16_run_stats(spark: SparkSession, d: str) -> DataFrame:
    """AGG16-17: runs by kind and status with their times."""
    return table(spark, d, "cache_entries").groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("elapsed_s"), 4).alias("mean_elapsed"), F.round(F.median("elapsed_s"), 4).alias("median_elapsed"), F.max("elapsed_s").alias("max_elapsed"))


@query("""SELECT run_id, count(*) AS n_attempts, CASE WHEN bool_or(accepted) THEN 'accepted' WHEN bool_and(parse_error IS NOT NULL) THEN 'unreadable' WHEN bool_or(accepted IS NULL) THEN 'inconclusive' ELSE 'rejected' END AS verdict FROM decision_attempt GROUP BY run_id""", views=False)
def agg8_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """AGG8-9: one verdict for the attempts of each run, by precedence."""
    t = table(spark, d, "decision_attempt")
    g = t.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_attempts"), F.bool_or("accepted").alias("a"), F.bool_and(F.col("parse_error").isNotNull()).alias("p"), F.bool_or(F.col("accepted").isNull()).alias("u"))
    return g.select("run_id", "n_attempts", rules.first_reason([("accepted", F.col("a")), ("unreadable", F.col("p")), ("inconclusive", F.col("u"))], "rejected").alias("verdict"))


@query("""SELECT token, count(DISTINCT kind) AS n_kinds FROM (SELECT 'id' AS kind, id AS token FROM nodes UNION ALL SELECT 'label', name FROM nodes WHERE name IS NOT NULL UNION ALL SELECT 'predicate', predicate FROM edges UNION ALL SELECT 'source', primary_source FROM edges WHERE primary_source IS NOT NULL) GROUP BY token""")
def agg20_lexicon(spark: SparkSession, d: str) -> DataFrame:
    """The tokens of ids and names of all nodes, and of predicates and sources of all edges."""
    n, e = nodes(spark, d), edges(spark, d)
    parts = [n.select(F.lit("id").alias("kind"), F.col("id").alias("token")), n.where("name is not null").select(F.lit("label"), "name"), e.select(F.lit("predicate"), "predicate").distinct(), e.where("primary_source is not null").select(F.lit("source"), "primary_source").distinct()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("token").agg(F.count_distinct("kind").alias("n_kinds"))


# ---- windows and ranks -------------------------------------------------------------------

RANKED_SQL = f""", s AS (SELECT subject AS id, count(DISTINCT object) AS n_parts, avg({SCORE_SQL}) AS mean_score, CASE WHEN count(*) % 7 = 0 THEN NULL ELSE max(pub_year) END AS latest FROM edges WHERE predicate = 'x:supplies' GROUP BY subject),
e AS (SELECT min(n_parts) AS a, max(n_parts) AS b, min(mean_score) AS c, max(mean_score) AS d, min(latest) AS f, max(latest) AS g FROM s),
n AS (SELECT id, CASE WHEN a = b THEN 0.5 ELSE (n_parts - a) / CAST(b - a AS DOUBLE) END AS n1, CASE WHEN c = d THEN 0.5 ELSE (mean_score - c) / (d - c) END AS n2, CASE WHEN latest IS NULL THEN NULL WHEN f = g THEN 0.5 ELSE 1 - (latest - f) / CAST(g - f AS DOUBLE) END AS n3 FROM s, e),
w AS (SELECT id, n1, n2, n3, (0.5 * n1 + 0.3 * n2 + coalesce(0.2 * n3, 0)) / (0.8 + CASE WHEN n3 IS NULL THEN 0 ELSE 0.2 END) AS score FROM n) """


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    s = scored(edges(spark, d, "x:supplies")).groupBy(F.col("subject").alias("id")).agg(F.count_distinct("object").alias("n_parts"), F.avg("score").alias("mean_score"), F.when(F.count(F.lit(1)) % 7 != 0, F.max("pub_year")).alias("latest"))
    n = ranking.normalised(s, {"n_parts": "desc", "mean_score": "desc", "latest": "asc"})
    return n.withColumn("score", ranking.weighted_mean({"n_parts": 0.5, "mean_score": 0.3, "latest": 0.2}))


@query(RANKED_SQL + "SELECT id, round(n1, 6) AS n1, round(n2, 6) AS n2, round(n3, 6) AS n3, round(score, 6) AS score FROM w")
def win1_normalised(spark: SparkSession, d: str) -> DataFrame:
    """WIN1-2: min-max over the pool, and the weighted mean of what is known."""
    return _ranked(spark, d).select("id", F.round("n_n_parts", 6).alias("n1"), F.round("n_mean_score", 6).alias("n2"), F.round("n_latest", 6).alias("n3"), F.round("score", 6).alias("score"))


@query(RANKED_SQL + "SELECT CAST(rank AS INT) AS rank, id, score FROM (SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS rank FROM w) WHERE rank <= 10")
def win3_top_ten(spark: SparkSession, d: str) -> DataFrame:
    """WIN3-4, WIN16: the ten best by a total order."""
    s = _ranked(spark, d).select("id", F.round("score", 6).alias("score"))
    return ranking.top(s, [F.col("score").desc(), F.col("id")], 10).select("rank", "id", "score")


@query("""SELECT edge_id, round(CASE coalesce(knowledge_level, 'none') WHEN 'knowledge_assertion' THEN 1.0 WHEN 'prediction' THEN 0.4 ELSE 0.2 END, 4) AS preference FROM edges WHERE predicate = 'x:supplies'""")
def win5_preference(spark: SparkSession, d: str) -> DataFrame:
    """A score by place in an ordered list of preferred values."""
    return edges(spark, d, "x:supplies").select("edge_id", F.round(S.preference_score(F.col("knowledge_level"), ["knowledge_assertion", "prediction"]), 4).alias("preference"))


@query(f""", s AS (SELECT subject, object, edge_id, {SCORE_SQL} AS score FROM edges WHERE predicate = 'x:supplies')
SELECT subject, edge_id, score, CAST(rank AS INT) AS rank FROM (SELECT subject, edge_id, score, row_number() OVER (PARTITION BY subject ORDER BY score DESC, edge_id) AS rank FROM s) WHERE rank <= 3""")
def win9_best_edges(spark: SparkSession, d: str) -> DataFrame:
    """The three best edges of every supplier."""
    return ranking.top_in_groups(scored(edges(spark, d, "x:supplies")).select("subject", "edge_id", "score"), ["subject"], [F.col("score").desc(), F.col("edge_id")], 3)


@query("""SELECT id, p_type, CAST(rank AS INT) AS rank FROM (SELECT id, p_type, row_number() OVER (ORDER BY turn, p_retailprice DESC, id) AS rank FROM (SELECT concat('PART:', p_partkey) AS id, p_type, p_retailprice, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, concat('PART:', p_partkey)) AS turn FROM part) WHERE turn <= 25) WHERE rank <= 25""", views=False)
def win10_diverse(spark: SparkSession, d: str) -> DataFrame:
    """The 25 best in turn from the groups."""
    p = table(spark, d, "part").selectExpr("concat('PART:', p_partkey) as id", "p_type", "p_retailprice")
    return ranking.round_robin(p, ["p_type"], [F.col("p_retailprice").desc(), F.col("id")], 25).select("id", "p_type", "rank")


@query("""SELECT journal_id, max_by(pubid, (CASE WHEN doc_kind = 'abstract' THEN 1 ELSE 0 END, coalesce(pub_year, 0), doc_id)) AS best FROM documents WHERE journal_id IS NOT NULL AND pubid IS NOT NULL GROUP BY journal_id""", views=False)
def win11_best_citation(spark: SparkSession, d: str) -> DataFrame:
    """One citation for each journal: abstracts before others, then the newest."""
    docs = table(spark, d, "documents").where("journal_id is not null and pubid is not null")
    best = F.max_by("pubid", F.struct((F.col("doc_kind") == "abstract").cast("int"), F.coalesce("pub_year", F.lit(0)), "doc_id"))
    return docs.groupBy("journal_id").agg(best.alias("best"))


@query("""SELECT journal_id, doc_id, CAST(position AS INT) AS position FROM (SELECT journal_id, doc_id, row_number() OVER w AS position, coalesce(sum(CASE WHEN n_chars % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY journal_id ORDER BY coalesce(pub_year, 0) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents WHERE journal_id IS NOT NULL WINDOW w AS (PARTITION BY journal_id ORDER BY coalesce(pub_year, 0) DESC, doc_id)) WHERE position <= 5 AND (position <= 3 OR before = 0)""", views=False)
def win12_reading(spark: SparkSession, d: str) -> DataFrame:
    """Texts read newest first until three are read and one supports, five at most."""
    docs = table(spark, d, "documents").where("journal_id is not null").select("journal_id", "doc_id", "pub_year", "n_chars")
    order = [F.coalesce("pub_year", F.lit(0)).desc(), F.col("doc_id")]
    return ranking.reading_prefix(docs, ["journal_id"], order, F.coalesce(F.col("n_chars") % 4 == 0, F.lit(False))).select("journal_id", "doc_id", "position")


@query("""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS n_in_window FROM events""", views=False)
def win14_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Requests of each caller in the hour up to each request."""
    from .streaming.ratelimit import window_counts

    return window_counts(table(spark, d, "events"), "user_id", "ts", "event_id", 3600)


@query("""WITH RECURSIVE n AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE ts IS NOT NULL),
r AS (SELECT event_id, user_id, i, true AS ok, 0.0::DOUBLE AS retry, CAST(NULL AS BIGINT) AS h1, t AS h2 FROM n WHERE i = 1
 UNION ALL SELECT n.event_id, n.user_id, n.i, r.h1 IS NULL OR r.h1 < n.t - 3600000000, CASE WHEN r.h1 IS NULL OR r.h1 < n.t - 3600000000 THEN 0.0 ELSE (r.h1 + 3600000000 - n.t) / 1000000.0 END, CASE WHEN r.h1 IS NULL OR r.h1 < n.t - 3600000000 THEN r.h2 ELSE r.h1 END, CASE WHEN r.h1 IS NULL OR r.h1 < n.t - 3600000000 THEN n.t ELSE r.h2 END FROM r JOIN n ON n.user_id IS NOT DISTINCT FROM r.user_id AND n.i = r.i + 1)
SELECT event_id, user_id, ok AS is_admitted, CAST(retry AS DOUBLE) AS retry_after_s FROM r UNION ALL SELECT event_id, user_id, false, NULL FROM events WHERE ts IS NULL""", views=False)
def str1_admitted(spark: SparkSession, d: str) -> DataFrame:
    """Requests that a sliding limit admits: refused ones take no place in the window."""
    from .streaming.ratelimit import admitted

    return admitted(table(spark, d, "events"), "user_id", "ts", "event_id", limit=2, window_s=3600)


# ---- sets --------------------------------------------------------------------------------


@query("""SELECT DISTINCT a.id FROM (SELECT object AS id FROM edges WHERE predicate = 'x:supplies' AND subject = 'SUPP:3') a JOIN (SELECT b.object AS id FROM edges a JOIN edges b ON a.object = b.subject WHERE a.predicate = 'x:placed' AND a.subject = 'CUST:7' AND b.predicate = 'x:contains') b USING (id)""")
def set2_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that every path supports."""
    return sets.intersection_of(_two_paths(spark, d), "id").select("id")


@query("""SELECT DISTINCT object AS id FROM edges WHERE predicate = 'x:supplies' AND subject = 'SUPP:3' EXCEPT SELECT b.object FROM edges a JOIN edges b ON a.object = b.subject WHERE a.predicate = 'x:placed' AND a.subject = 'CUST:7' AND b.predicate = 'x:contains'""")
def set7_difference(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of the one path only."""
    p = _two_paths(spark, d)
    return sets.except_of(p["P1"], p["P2"], "id")


@query("""SELECT lower(trim(p_name)) AS merge_key, min_by(concat('PART:', p_partkey), p_partkey) AS id, CAST(sum(p_size) AS BIGINT) AS p_size, count(*) AS n_merged FROM part GROUP BY lower(trim(p_name))""", views=False)
def set4_merged_by_name(spark: SparkSession, d: str) -> DataFrame:
    """SET4-6: rows of one name merged into the first."""
    p = table(spark, d, "part").selectExpr("concat('PART:', p_partkey) as id", "p_partkey", "p_name", "p_size")
    return sets.merged_by(p, F.lower(F.trim("p_name")), ["p_partkey"], ["id"], ["p_size"])


# ---- the flagship ------------------------------------------------------------------------


@query(f""", m AS (SELECT c.subject AS id, b.edge_id AS e2, c.edge_id AS e3, least({SCORE_SQL.replace('knowledge_level', 'b.knowledge_level').replace('agent_type', 'b.agent_type').replace('num_publications', 'b.num_publications').replace('num_sources', 'b.num_sources').replace('primary_source', 'b.primary_source')}, {SCORE_SQL.replace('knowledge_level', 'c.knowledge_level').replace('agent_type', 'c.agent_type').replace('num_publications', 'c.num_publications').replace('num_sources', 'c.num_sources').replace('primary_source', 'c.primary_source')}) AS score
 FROM edges a JOIN edges b ON b.subject = a.object JOIN edges c ON c.object = b.object WHERE a.predicate = 'x:placed' AND b.predicate = 'x:contains' AND c.predicate = 'x:supplies' AND a.subject = '{CUSTOMER}' AND b.num_publications >= 1 AND NOT c.negated),
g AS (SELECT id, count(*) AS n_instances, round(avg(score), 4) AS mean_score FROM m GROUP BY id)
SELECT CAST(rank AS INT) AS rank, id, name AS label, n_instances, mean_score FROM (SELECT *, row_number() OVER (ORDER BY mean_score DESC, n_instances DESC, id) AS rank FROM g) JOIN nodes USING (id) WHERE rank <= 10""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Which suppliers provide the parts in a customer's orders, best evidence first."""
    e = scored(edges(spark, d, "x:placed", "x:contains", "x:supplies"))
    m = match.match(e, CHAIN, carry=("score", "num_publications", "negated"))
    got = m.where("num_publications_2 >= 1 and not negated_3").select(F.col("supplier").alias("id"), F.least("score_2", "score_3").alias("score"))
    g = got.groupBy("id").agg(F.count(F.lit(1)).alias("n_instances"), F.round(F.avg("score"), 4).alias("mean_score"))
    best = ranking.top(g, [F.col("mean_score").desc(), F.col("n_instances").desc(), F.col("id")], 10)
    names = nodes(spark, d).where("category = 'Supplier'").select("id", F.col("name").alias("label"))
    return best.join(names, "id").select("rank", "id", "label", "n_instances", "mean_score")
