"""Whether statements say only what a result holds, checked over tables.

A lexicon is a table (result, kind, token): what each result may be quoted with. Statements
are rows (result, statement_id, kind, text, supported_by). Every fault of every statement is
a row; identifiers and edges are anti-joins on (result, token). Containment of texts joins
on (result, anchor), the anchor being the first ANCHOR characters of the shorter text and
all runs of that length of the longer one, so that a hot result is spread over its anchors
and no pair is made that does not share a run.

Defined cases: null texts and tokens are nothing; a quotation is verified if it stands in a
verified quote of its result or the other way round; strings below ANCHOR characters are
compared with all texts of their result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import CANDIDATE_KINDS, QUERY_KINDS

ANCHOR = 12
IDENTIFIER = r"[A-Za-z][A-Za-z0-9_.]*:[A-Za-z0-9_.|/-]*[A-Za-z0-9]"
QUOTATION = "“([^”]+)”"

#: Kinds of tokens that name what a result asserts.
KNOWN_KINDS = ("curie", "label", "source", "predicate", "publication", "knowledge_level", "edge")


def lexicon(parts: dict[str, DataFrame]) -> DataFrame:
    """(result, kind, token) of the tokens (result, token) of each kind, each once. Strings of
    quarantine count from 40 characters on: shorter ones are everyday words."""
    out = None
    for kind, df in parts.items():
        part = df.select("result", F.lit(kind).alias("kind"), "token").where(F.col("token").isNotNull() & ((F.lit(kind) != "quarantine") | (F.length("token") >= 40)))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def contained(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle_id, text_id): where `needle` of (result, needle_id, needle) stands in `body` of
    (result, text_id, body); each pair once."""
    n = needles.where(F.length("needle") > 0)
    grams: Column = F.transform(F.sequence(F.lit(1), F.length("body") - ANCHOR + 1), lambda i: F.col("body").substr(i, F.lit(ANCHOR)))
    spread = texts.where(F.length("body") >= ANCHOR).select("result", "text_id", "body", F.explode(F.array_distinct(grams)).alias("anchor"))
    long = n.where(F.length("needle") >= ANCHOR).withColumn("anchor", F.substring("needle", 1, ANCHOR))
    hit = long.join(spread, ["result", "anchor"]).where(F.contains("body", F.col("needle"))).select("needle_id", "text_id")
    short = n.where(F.length("needle") < ANCHOR).join(texts, "result").where(F.contains("body", F.col("needle"))).select("needle_id", "text_id")
    return hit.unionByName(short).distinct()


def faults(statements: DataFrame, lex: DataFrame, quotes_allowed: bool = True) -> DataFrame:
    """(statement_id, fault, token) of everything a statement may not say: unknown_edge,
    ungrounded_identifier, unverified_quote or quote_not_permitted, model_authored_text."""
    of = lambda *kinds: lex.where(F.col("kind").isin(*kinds)).select("result", "token").distinct()
    cites = statements.select("result", "statement_id", F.explode("supported_by").alias("token"))
    edges = cites.join(of("edge"), ["result", "token"], "left_anti").select("statement_id", F.lit("unknown_edge").alias("fault"), "token")
    named = statements.select("result", "statement_id", F.col("kind").alias("says"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(IDENTIFIER), 0))).alias("token"))
    loose = named.join(of(*KNOWN_KINDS), ["result", "token"], "left_anti")
    asked, offered = of("query_term").withColumn("asked", F.lit(True)), of("candidate").withColumn("offered", F.lit(True))
    loose = loose.join(asked, ["result", "token"], "left").join(offered, ["result", "token"], "left")
    excused = (F.col("says").isin(*QUERY_KINDS) & F.col("asked").isNotNull()) | (F.col("says").isin(*CANDIDATE_KINDS) & F.col("offered").isNotNull())
    loose = loose.where(~F.coalesce(excused, F.lit(False))).select("statement_id", F.lit("ungrounded_identifier").alias("fault"), "token")
    quotes = statements.select("result", "statement_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(QUOTATION), 1))).alias("token"))
    if quotes_allowed:
        verified = of("verified_quote")
        q = quotes.select("result", F.struct("statement_id", "token").alias("needle_id"), F.trim("token").alias("needle"))
        inside = contained(q, verified.select("result", F.col("token").alias("text_id"), F.col("token").alias("body"))).select("needle_id")
        around = contained(verified.select("result", F.col("token").alias("needle_id"), F.col("token").alias("needle")), quotes.select("result", F.struct("statement_id", "token").alias("text_id"), F.col("token").alias("body"))).select(F.col("text_id").alias("needle_id"))
        good = inside.unionByName(around).select("needle_id.statement_id", "needle_id.token").distinct()
        bad = quotes.join(good, ["statement_id", "token"], "left_anti").select("statement_id", F.lit("unverified_quote").alias("fault"), "token")
    else:
        bad = quotes.select("statement_id", F.lit("quote_not_permitted").alias("fault"), "token")
    held = of("quarantine").select("result", F.col("token").alias("needle_id"), F.col("token").alias("needle"))
    authored = contained(held, statements.select("result", F.col("statement_id").alias("text_id"), F.col("text").alias("body"))).select(F.col("text_id").alias("statement_id"), F.lit("model_authored_text").alias("fault"), F.col("needle_id").alias("token"))
    return edges.unionByName(loose).unionByName(bad).unionByName(authored)
