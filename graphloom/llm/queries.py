"""Queries of the language-model text operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import spill, table
from . import encoding, packing, sentences, spans, truncation

Query = Callable[[SparkSession, str], DataFrame]


def _stored_texts(spark: SparkSession, d: str) -> DataFrame:
    def part(name: str, key: str, text: str) -> DataFrame:
        return table(spark, d, name).select(F.lit(name).alias("record_table"), F.col(key).alias("record_id"), "writer", F.col(text).alias("text"))

    return part("decision_attempt", "attempt_id", "raw_response").unionByName(part("plan_attempt", "attempt_id", "raw_response")).unionByName(part("cache_entries", "entry_id", "error_message"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The records whose stored text lost its end."""
    return truncation.Truncation(_stored_texts(spark, d)).cut()


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of cut records of each table and writer."""
    return truncation.Truncation(_stored_texts(spark, d)).shares()


def p2_limits(spark: SparkSession, d: str) -> DataFrame:
    """The hidden storage limits: table, writer, measure and length."""
    return truncation.Truncation(_stored_texts(spark, d)).limits


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of lexicon strings that share a run of at least 80 characters."""
    return spans.SharedSpans(table(spark, d, "lexicon_strings"), "string_id", "string_text").pairs("string_a", "string_b")


def p4_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much of each lexicon string also stands in another one."""
    return spans.SharedSpans(table(spark, d, "lexicon_strings"), "string_id", "string_text").coverage()


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row for each lexicon string that shares a run, with the class that sharing connects."""
    return spans.SharedSpans(table(spark, d, "lexicon_strings"), "string_id", "string_text").connected()


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Every document's token ids by byte_bpe_50k."""
    return encoding.encode(table(spark, d, "documents"))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document (or piece of one) for each prompt budget."""
    return packing.pack(encoding.token_counts(table(spark, d, "documents")), table(spark, d, "pack_budgets"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per budget: containers, tokens, and the share of capacity left unused."""
    packed = p7_pack(spark, d).groupBy("budget_name", "container").agg(F.sum("piece_tokens").alias("held"))
    caps = table(spark, d, "pack_budgets").select("budget_name", "capacity_tokens")
    per = packed.groupBy("budget_name").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("held").alias("n_tokens"), F.max("held").alias("fullest"))
    return per.join(caps, "budget_name").withColumn("unused_share", F.round(1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6))


def p7_laws(spark: SparkSession, d: str) -> DataFrame:
    """What must not be, per budget: containers over the capacity, texts whose pieces do not
    follow each other from the first token to the last, and texts cut though they fit."""
    counts = encoding.token_counts(table(spark, d, "documents"))
    caps = table(spark, d, "pack_budgets").select("budget_name", F.col("capacity_tokens").cast("bigint").alias("cap"))
    packed = spill(packing.pack(counts, table(spark, d, "pack_budgets")))
    over = packed.groupBy("budget_name", "container").agg(F.sum("piece_tokens").alias("held")).join(caps, "budget_name").groupBy("budget_name").agg(F.count_if(F.col("held") > F.col("cap")).alias("n_overfull"))
    per = packed.groupBy("budget_name", "doc_id").agg(F.sum("piece_tokens").alias("held"), F.count(F.lit(1)).alias("k"), F.max(F.col("first_token") + F.col("piece_tokens")).alias("stop"), F.count_distinct("first_token").alias("starts"), F.count_if((F.col("piece") > 0) & (F.col("first_token") == 0)).alias("odd"))
    want = counts.where("n_tokens > 0").select("doc_id", "n_tokens").crossJoin(F.broadcast(caps))  # three budgets, which do not grow
    each = want.join(per, ["budget_name", "doc_id"], "left")
    whole = F.coalesce((F.col("held") == F.col("n_tokens")) & (F.col("stop") == F.col("n_tokens")) & (F.col("starts") == F.col("k")) & (F.col("odd") == 0), F.lit(False))
    laws = each.groupBy("budget_name").agg(F.count_if(~whole).alias("n_not_whole"), F.count_if((F.col("k") > 1) & (F.col("n_tokens") <= F.col("cap"))).alias("n_cut"))
    return over.join(laws, "budget_name")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The end of every sentence unit of every document."""
    return sentences.sentence_ends(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {"p8_found": p8_found, "p2_found": p2_found, "p2_shares": p2_shares, "p2_limits": p2_limits, "p4_found": p4_found, "p4_coverage": p4_coverage, "p4_classes": p4_classes, "p6_ids": p6_ids, "p7_pack": p7_pack, "p7_fill": p7_fill, "p7_laws": p7_laws}
_GRAMS = """WITH s AS (SELECT DISTINCT string_id, string_text FROM lexicon_strings WHERE string_id IS NOT NULL AND length(string_text) >= 80),
g AS (SELECT string_id, i, substring(string_text, i, 80) AS gram FROM s, range(1, length(string_text) - 78) t(i)),
twice AS (SELECT gram FROM g GROUP BY gram HAVING count(DISTINCT string_id) > 1),
shared AS (SELECT g.* FROM g JOIN twice USING (gram)) """
SQL: dict[str, str] = {
    "p7_laws": "SELECT budget_name, CAST(0 AS BIGINT) AS n_overfull, CAST(0 AS BIGINT) AS n_not_whole, CAST(0 AS BIGINT) AS n_cut FROM pack_budgets",
    "p4_found": _GRAMS + "SELECT DISTINCT a.string_id AS string_a, b.string_id AS string_b FROM shared a JOIN shared b ON a.gram = b.gram AND a.string_id < b.string_id",
    "p4_classes": _GRAMS.replace("WITH", "WITH RECURSIVE") + """, pair AS (SELECT DISTINCT a.string_id AS a, b.string_id AS b FROM shared a JOIN shared b ON a.gram = b.gram AND a.string_id <> b.string_id),
reach AS (SELECT a AS string_id, a AS other FROM pair UNION SELECT r.string_id, p.b FROM reach r JOIN pair p ON p.a = r.other)
SELECT string_id, min(other) AS class_id, count(*) AS n_records FROM reach GROUP BY string_id""",
    "p4_coverage": _GRAMS + """, c AS (SELECT string_id, count(DISTINCT i + k) AS n FROM shared, range(0, 80) r(k) GROUP BY string_id)
SELECT string_id, length(string_text) AS n_chars, coalesce(n, 0) AS shared_chars, round(coalesce(n, 0) / length(string_text), 6) AS shared_share FROM s LEFT JOIN c USING (string_id)""",
}
