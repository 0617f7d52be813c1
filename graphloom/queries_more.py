"""Further queries of the graph operators: lookups, attachments, checks of sources and states."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import attributes as A
from .functions import scoring as S
from .operators import nested, ranking, rules
from .queries_graph import SCORE_SQL, scored
from .sources import table
from .sources.graph import SQL_VIEWS, edges, nodes

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (SQL_VIEWS + sql) if views else sql
        return f

    return add


def _is_request(raw: str) -> bool:
    """Whether a body, or the JSON text that it holds as a string, is an object with exactly the allowed members."""
    pairs = type("Pairs", (list,), {})
    try:
        value = raw.removeprefix("\ufeff")
        while isinstance(value, str):
            value = json.loads(value, object_pairs_hook=pairs, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return False
    return isinstance(value, pairs) and sorted(k for k, _ in value) == ["endpoint", "query_graph"]


def _refuse(_: str):
    raise ValueError("no JSON")


@query("""WITH RECURSIVE body AS (SELECT DISTINCT entry_id, request_json FROM cache_entries WHERE request_json IS NOT NULL),
un AS (SELECT entry_id, request_json, try_cast(ltrim(request_json, chr(65279)) AS JSON) AS j FROM body UNION ALL SELECT entry_id, request_json, try_cast(j ->> '$' AS JSON) FROM un WHERE json_type(j) = 'VARCHAR')
SELECT entry_id, coalesce(CASE WHEN json_type(j) = 'OBJECT' THEN list_sort(json_keys(j)) = ['endpoint', 'query_graph'] END, false) AS is_accepted FROM un WHERE json_type(j) IS DISTINCT FROM 'VARCHAR'""", views=False)
def src16_strict_requests(spark: SparkSession, d: str) -> DataFrame:
    """Every request body that is not null, accepted or refused; a string that holds JSON is what it holds."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            verdicts = [_is_request(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(verdicts, pa.bool_())], ["entry_id", "request_json", "is_accepted"])

    body = table(spark, d, "cache_entries").where("request_json is not null").select(F.col("entry_id").cast("bigint").alias("entry_id"), "request_json").distinct()
    return body.mapInArrow(judge, "entry_id bigint, request_json string, is_accepted boolean").drop("request_json")


@query("""SELECT entry_id, CASE WHEN regexp_matches(coalesce(error_message, ''), '(?i)time ?out') THEN 'timeout' WHEN coalesce(error_message, '') <> '' THEN 'error' WHEN response_blob IS NULL THEN 'lost' WHEN coalesce(num_results, 0) = 0 THEN 'empty' WHEN contains(coalesce(meta_json, ''), '"truncated": true') THEN 'partial' ELSE 'success' END AS outcome, status FROM cache_entries""", views=False)
def fil29_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What each run came to by its content, beside the status it was given."""
    c = table(spark, d, "cache_entries")
    message = F.coalesce("error_message", F.lit(""))
    outcome = rules.first_reason([("timeout", message.rlike("(?i)time ?out")), ("error", message != ""), ("lost", F.col("response_blob").isNull()), ("empty", F.coalesce("num_results", F.lit(0)) == 0), ("partial", F.contains(F.coalesce("meta_json", F.lit("")), F.lit('"truncated": true')))], "success")
    return c.select("entry_id", outcome.alias("outcome"), "status")


@query("""SELECT DISTINCT fetched_at, coalesce(CASE WHEN regexp_matches(fetched_at, '^\\s*\\d{4}-') THEN try_cast(fetched_at AS TIMESTAMPTZ) END < TIMESTAMPTZ '2031-06-01 00:00:00+00', true) AS is_stale FROM cache_entries""", views=False)
def fil31_stale(spark: SparkSession, d: str) -> DataFrame:
    """Times before a date in all spellings; one that is missing or cannot be read counts as stale."""
    t = table(spark, d, "cache_entries").select("fetched_at").distinct()
    at = F.when(F.col("fetched_at").rlike(r"^\s*\d{4}-"), F.try_to_timestamp("fetched_at"))
    return t.select("fetched_at", F.coalesce(at < F.lit("2031-06-01 00:00:00").cast("timestamp"), F.lit(True)).alias("is_stale"))


@query(f""", s AS (SELECT edge_id, subject, object, {SCORE_SQL} AS score FROM edges WHERE predicate = 'x:fulfils') SELECT s.edge_id, n.name AS subject_name, score, o.o_orderstatus AS status FROM s JOIN nodes n ON n.id = s.subject LEFT JOIN orders o ON concat('ORD:', o.o_orderkey) = s.object""")
def join9_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Edges with what is looked up for their ends."""
    e = scored(edges(spark, d, "x:fulfils")).select("edge_id", "subject", "object", "score")
    n = nodes(spark, d).where("category = 'Supplier'").select(F.col("id").alias("subject"), F.col("name").alias("subject_name"))
    o = table(spark, d, "orders").select(F.concat(F.lit("ORD:"), "o_orderkey").alias("object"), F.col("o_orderstatus").alias("status"))
    return e.join(n, "subject").join(o, "object", "left").select("edge_id", "subject_name", "score", "status")


@query("""SELECT f.file_id, CASE WHEN n IS NULL THEN 'empty' WHEN store_id IS NULL THEN 'unknown_store' ELSE 'ok' END AS verdict, coalesce(n, 0) AS n_lines FROM dump_files f LEFT JOIN (SELECT file_id, count(*) AS n FROM dump_lines GROUP BY file_id) USING (file_id)""", views=False)
def join13_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Files of a manifest against what has come."""
    n = table(spark, d, "dump_lines").groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    f = table(spark, d, "dump_files").select("file_id", "store_id").join(n, "file_id", "left")
    return f.select("file_id", rules.first_reason([("empty", F.col("n").isNull()), ("unknown_store", F.col("store_id").isNull())], "ok").alias("verdict"), F.coalesce("n", F.lit(0)).alias("n_lines"))


@query("""SELECT result_id, count(*) AS n_strings, count(DISTINCT pubid) AS n_publications, max(pubid) AS last_publication FROM lexicon_strings GROUP BY result_id""", views=False)
def join15_literature(spark: SparkSession, d: str) -> DataFrame:
    """What has been read for each result."""
    return table(spark, d, "lexicon_strings").groupBy("result_id").agg(F.count(F.lit(1)).alias("n_strings"), F.count_distinct("pubid").alias("n_publications"), F.max("pubid").alias("last_publication"))


@query("""SELECT name, min_by(id, (priority, id)) AS id, min(priority) AS priority FROM (SELECT name, id, 1 AS priority FROM nodes WHERE category = 'Part' UNION ALL SELECT name, id, 2 FROM nodes WHERE category = 'Supplier' UNION ALL SELECT lower(name), id, 3 FROM nodes WHERE category IN ('Nation', 'Region')) GROUP BY name""")
def join16_fallback_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The first lookup, in a fixed order, that knows a name."""
    n = nodes(spark, d)
    parts = [n.where("category = 'Part'").select("name", "id", F.lit(1).alias("priority")), n.where("category = 'Supplier'").select("name", "id", F.lit(2).alias("priority")), n.where("category in ('Nation', 'Region')").select(F.lower("name").alias("name"), "id", F.lit(3).alias("priority"))]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.groupBy("name").agg(F.min_by("id", F.struct("priority", "id")).alias("id"), F.min("priority").alias("priority"))


@query("""SELECT subject AS id, round(avg(CASE knowledge_level WHEN 'knowledge_assertion' THEN 1.0 WHEN 'prediction' THEN 0.4 ELSE 0.2 END), 8) AS level_score FROM edges WHERE predicate = 'x:supplies' GROUP BY subject""")
def agg15_level_criterion(spark: SparkSession, d: str) -> DataFrame:
    """The mean of ordinal scores as a criterion."""
    s = edges(spark, d, "x:supplies").select(F.col("subject").alias("id"), S.preference_score(F.col("knowledge_level"), ["knowledge_assertion", "prediction"]).alias("s"))
    return s.groupBy("id").agg(F.round(F.avg("s"), 8).alias("level_score"))


@query(f""", s AS (SELECT subject, edge_id, {SCORE_SQL} AS score FROM edges WHERE predicate = 'x:supplies'),
r AS (SELECT subject, avg(score) AS m, row_number() OVER (ORDER BY round(avg(score), 6) DESC, subject) AS place FROM s GROUP BY subject),
c AS (SELECT subject, place, CASE WHEN place % 3 = 0 THEN place - 2.5 ELSE NULL END AS proposed FROM r WHERE place <= 20),
b AS (SELECT subject, min(edge_id) AS cited FROM s GROUP BY subject)
SELECT c.subject AS id, CAST(place AS INT) AS deterministic_rank, CAST(row_number() OVER (ORDER BY coalesce(proposed, place), place) AS INT) AS rank FROM c JOIN b USING (subject)""")
def win8_grounded_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The head of a ranking, moved by proposals that cite an edge of their candidate only."""
    s = scored(edges(spark, d, "x:supplies")).select("subject", "edge_id", "score")
    head = ranking.top(s.groupBy("subject").agg(F.round(F.avg("score"), 6).alias("m")), [F.col("m").desc(), F.col("subject")], 20, "place")
    cited = s.groupBy("subject").agg(F.min("edge_id").alias("own_edge"))
    proposals = head.where("place % 3 = 0").select("subject", (F.col("place") - 2.5).alias("proposed")).join(cited, "subject").withColumn("cited", F.array("own_edge"))
    false_ones = head.where("place % 5 = 1 and place % 3 != 0").select("subject", F.lit(0.0).alias("proposed"), F.array(F.lit("supplies|of another")).alias("cited"))
    made = proposals.select("subject", "proposed", "cited").unionByName(false_ones)
    known = made.select("subject", "proposed", F.explode("cited").alias("edge_id"), F.size("cited").alias("n")).join(s.select("subject", "edge_id").distinct(), ["subject", "edge_id"], "left_semi").groupBy("subject", "proposed", "n").agg(F.count(F.lit(1)).alias("hits")).where("hits = n")
    out = head.join(known.select("subject", "proposed"), "subject", "left")
    return out.select(F.col("subject").alias("id"), F.col("place").alias("deterministic_rank"), F.row_number().over(Window.orderBy(F.coalesce("proposed", F.col("place").cast("double")), "place")).alias("rank"))


@query("""SELECT event_type, n, CAST(row_number() OVER (ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 9 END, event_type) AS INT) AS place FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)""", views=False)
def win15_axis_order(spark: SparkSession, d: str) -> DataFrame:
    """Groups in a given order, unknown ones last."""
    g = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    at = F.array_position(F.array(*[F.lit(x) for x in ("purchase", "click", "view")]), F.col("event_type"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.when(at == 0, 9).otherwise(at), "event_type")))


@query("""SELECT status, count(*) FILTER (WHERE age_s <= ttl) AS n_kept, count(*) FILTER (WHERE NOT coalesce(age_s <= ttl, false)) AS n_purged FROM (SELECT status, (epoch_us(TIMESTAMP '2031-12-01 00:00:00') - epoch_us(ingested_at)) / 1000000.0 AS age_s, CASE status WHEN 'error' THEN 3600.0 WHEN 'timeout' THEN 604800.0 ELSE 2592000.0 END AS ttl FROM cache_entries) GROUP BY status""", views=False)
def str2_purge(spark: SparkSession, d: str) -> DataFrame:
    """How many entries of each status a purge at a given time leaves and takes."""
    from .streaming.expiry import ttl

    age = (F.unix_micros(F.lit("2031-12-01 00:00:00").cast("timestamp")) - F.unix_micros(F.col("ingested_at").cast("timestamp"))) / 1e6
    live = F.coalesce(age <= ttl(F.col("status")), F.lit(False))
    return table(spark, d, "cache_entries").groupBy("status").agg(F.count_if(live).alias("n_kept"), F.count_if(~live).alias("n_purged"))


@query("""SELECT DISTINCT lang AS raw, regexp_replace(concat('http://x.example/obo/', upper(trim(lang)), '_', length(lang)), '^.*/([A-Za-z]+)_([^/_]+)$', '\\1:\\2') AS curie FROM documents WHERE lang IS NOT NULL""", views=False)
def prj20_curies(spark: SparkSession, d: str) -> DataFrame:
    """Names of resources in their short form."""
    docs = table(spark, d, "documents").where("lang is not null").select("lang").distinct()
    iri = F.concat(F.lit("http://x.example/obo/"), F.upper(F.trim("lang")), F.lit("_"), F.length("lang"))
    return docs.select(F.col("lang").alias("raw"), A.iri_to_curie(iri).alias("curie"))


def _flat(members: tuple[str, ...], columns: tuple[str, ...]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return nested.flat_table(nested.shredded(table(spark, d, "cache_entries")), members, columns)

    return run


#: Flat tables of the nested documents (problem 5): member names and the columns taken out.
QUERIES |= {
    "p5_results": _flat(("results", "analyses"), ("score", "resource_id")),
    "p5_attributes": _flat(("attributes",), ("attribute_type_id", "value", "original_attribute_name")),
    "p5_sources": _flat(("sources",), ("resource_id", "resource_role")),
    "p5_constraints": _flat(("attribute_constraints", "qualifier_constraints", "qualifier_set"), ("id", "operator", "qualifier_type_id", "qualifier_value")),
    "p5_logs": _flat(("logs", "degraded_logs", "retries"), ("level", "message", "kp", "after_s")),
}
