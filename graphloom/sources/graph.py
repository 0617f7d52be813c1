"""The order tables as a property graph: nodes and edges with evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """(id, name, category) of all nodes."""
    t = lambda n: table(spark, d, n)

    def part(df: DataFrame, prefix: str, key: str, name: str | None, category: str) -> DataFrame:
        ident = F.concat(F.lit(f"{prefix}:"), F.col(key))
        return df.select(ident.alias("id"), (F.col(name) if name else ident).alias("name"), F.lit(category).alias("category"))

    parts = [part(t("customer"), "CUST", "c_custkey", "c_name", "Customer"), part(t("supplier"), "SUPP", "s_suppkey", "s_name", "Supplier"), part(t("part"), "PART", "p_partkey", "p_name", "Part"), part(t("orders"), "ORD", "o_orderkey", None, "Order"), part(t("nation"), "NAT", "n_nationkey", "n_name", "Nation"), part(t("region"), "REG", "r_regionkey", "r_name", "Region")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def line_evidence(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with an id and the evidence that its edges carry."""
    li = table(spark, d, "lineitem")
    return li.select(
        "*",
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("lid"),
        F.when(F.col("l_returnflag") == "A", "knowledge_assertion").when(F.col("l_returnflag") == "N", "prediction").alias("knowledge_level"),
        F.when(F.col("l_linestatus") == "F", "manual_agent").when(F.col("l_linestatus") == "O", "text_mining_agent").alias("agent_type"),
        (F.col("l_linenumber") % 4).cast("int").alias("num_publications"),
        F.year("l_shipdate").alias("pub_year"),
        F.when(F.col("l_suppkey") % 11 != 0, F.concat(F.lit("infores:src"), F.col("l_suppkey") % 5)).alias("primary_source"),
        F.when(F.col("l_quantity") > 25, 2).otherwise(1).alias("num_sources"),
        (F.col("l_discount") + F.lit(0.0) == 0).alias("negated"),
    )


EVIDENCE = ["knowledge_level", "agent_type", "num_publications", "pub_year", "primary_source", "num_sources", "negated"]


def edges(spark: SparkSession, d: str, *predicates: str) -> DataFrame:
    """(edge_id, subject, predicate, object, evidence) of the predicates wanted, or of all.
    Only the tables behind them are read."""
    wanted = predicates or ("x:contains", "x:supplies", "x:fulfils", "x:placed", "x:located_in")
    parts = []
    ends = {"x:contains": ("ORD:", "l_orderkey", "PART:", "l_partkey"), "x:supplies": ("SUPP:", "l_suppkey", "PART:", "l_partkey"), "x:fulfils": ("SUPP:", "l_suppkey", "ORD:", "l_orderkey")}
    for p, (a, ka, b, kb) in ends.items():
        if p in wanted:
            parts.append(line_evidence(spark, d).select(F.concat(F.lit(p[2:] + "|"), F.col("lid")).alias("edge_id"), F.concat(F.lit(a), F.col(ka)).alias("subject"), F.lit(p).alias("predicate"), F.concat(F.lit(b), F.col(kb)).alias("object"), *EVIDENCE))
    bare = [F.lit("knowledge_assertion").alias("knowledge_level"), F.lit("manual_agent").alias("agent_type"), F.lit(0).alias("num_publications"), F.lit(None).cast("int").alias("pub_year"), F.lit("infores:base").alias("primary_source"), F.lit(1).alias("num_sources"), F.lit(False).alias("negated")]

    def plain(df: DataFrame, p: str, a: str, ka: str, b: str, kb: str) -> DataFrame:
        return df.select(F.concat(F.lit(f"{p[2:]}|{a}"), F.col(ka), F.lit("|"), F.col(kb)).alias("edge_id"), F.concat(F.lit(a), F.col(ka)).alias("subject"), F.lit(p).alias("predicate"), F.concat(F.lit(b), F.col(kb)).alias("object"), *bare)

    if "x:placed" in wanted:
        parts.append(plain(table(spark, d, "orders"), "x:placed", "CUST:", "o_custkey", "ORD:", "o_orderkey"))
    if "x:located_in" in wanted:
        parts.append(plain(table(spark, d, "customer"), "x:located_in", "CUST:", "c_custkey", "NAT:", "c_nationkey"))
        parts.append(plain(table(spark, d, "supplier"), "x:located_in", "SUPP:", "s_suppkey", "NAT:", "s_nationkey"))
        parts.append(plain(table(spark, d, "nation"), "x:located_in", "NAT:", "n_nationkey", "REG:", "n_regionkey"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: The same views in SQL, as the head of a WITH clause.
SQL_VIEWS = """WITH RECURSIVE nodes AS (
  SELECT concat('CUST:', c_custkey) AS id, c_name AS name, 'Customer' AS category FROM customer
  UNION ALL SELECT concat('SUPP:', s_suppkey), s_name, 'Supplier' FROM supplier
  UNION ALL SELECT concat('PART:', p_partkey), p_name, 'Part' FROM part
  UNION ALL SELECT concat('ORD:', o_orderkey), concat('ORD:', o_orderkey), 'Order' FROM orders
  UNION ALL SELECT concat('NAT:', n_nationkey), n_name, 'Nation' FROM nation
  UNION ALL SELECT concat('REG:', r_regionkey), r_name, 'Region' FROM region),
line AS (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS lid,
  CASE l_returnflag WHEN 'A' THEN 'knowledge_assertion' WHEN 'N' THEN 'prediction' END AS knowledge_level,
  CASE l_linestatus WHEN 'F' THEN 'manual_agent' WHEN 'O' THEN 'text_mining_agent' END AS agent_type,
  CAST(l_linenumber % 4 AS INT) AS num_publications, CAST(year(l_shipdate) AS INT) AS pub_year,
  CASE WHEN l_suppkey % 11 <> 0 THEN concat('infores:src', l_suppkey % 5) END AS primary_source,
  CASE WHEN l_quantity > 25 THEN 2 ELSE 1 END AS num_sources, l_discount + 0.0 = 0 AS negated FROM lineitem),
edges AS (
  SELECT concat('contains|', lid) AS edge_id, concat('ORD:', l_orderkey) AS subject, 'x:contains' AS predicate, concat('PART:', l_partkey) AS object, knowledge_level, agent_type, num_publications, pub_year, primary_source, num_sources, negated FROM line
  UNION ALL SELECT concat('supplies|', lid), concat('SUPP:', l_suppkey), 'x:supplies', concat('PART:', l_partkey), knowledge_level, agent_type, num_publications, pub_year, primary_source, num_sources, negated FROM line
  UNION ALL SELECT concat('fulfils|', lid), concat('SUPP:', l_suppkey), 'x:fulfils', concat('ORD:', l_orderkey), knowledge_level, agent_type, num_publications, pub_year, primary_source, num_sources, negated FROM line
  UNION ALL SELECT concat('placed|CUST:', o_custkey, '|', o_orderkey), concat('CUST:', o_custkey), 'x:placed', concat('ORD:', o_orderkey), 'knowledge_assertion', 'manual_agent', 0, NULL, 'infores:base', 1, false FROM orders
  UNION ALL SELECT concat('located_in|CUST:', c_custkey, '|', c_nationkey), concat('CUST:', c_custkey), 'x:located_in', concat('NAT:', c_nationkey), 'knowledge_assertion', 'manual_agent', 0, NULL, 'infores:base', 1, false FROM customer
  UNION ALL SELECT concat('located_in|SUPP:', s_suppkey, '|', s_nationkey), concat('SUPP:', s_suppkey), 'x:located_in', concat('NAT:', s_nationkey), 'knowledge_assertion', 'manual_agent', 0, NULL, 'infores:base', 1, false FROM supplier
  UNION ALL SELECT concat('located_in|NAT:', n_nationkey, '|', n_regionkey), concat('NAT:', n_nationkey), 'x:located_in', concat('REG:', n_regionkey), 'knowledge_assertion', 'manual_agent', 0, NULL, 'infores:base', 1, false FROM nation)
"""
