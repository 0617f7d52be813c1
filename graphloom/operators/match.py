"""Graph patterns as joins: one hop, many hops, closing hops, and where a pattern breaks.

A plan becomes one chain of equi-joins over the edge table. Pins are filters on the
first hop (so they reach the scan), every later hop joins on the one entity already
bound, a hop between two bound entities on both. Nothing is broadcast by hand: the
optimizer broadcasts a side whose size it has measured, and splits skewed keys. One row
stands for one binding with one edge per hop; parallel edges give parallel rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import normal_text
from ..functions.compare import apply_op
from ..plans import Hop, Plan, PlanError


def predicate_column(hop: Hop, below: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The hop's predicate, with those below it where the hop asks for them."""
    names = (hop.predicate, *(below or {}).get(hop.predicate, ())) if hop.descendants else (hop.predicate,)
    return F.col("predicate").isin(*names)


def hop_edges(edges: DataFrame, plan: Plan, i: int, nodes: DataFrame | None = None, below: dict | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """The edges that fit hop i by itself: predicate, pins, sign, filters and categories,
    as (subject ref, object ref, edge_i) and the columns of `carry` as <column>_i."""
    hop = plan.hops[i]
    out = edges.where(predicate_column(hop, below) & (F.col("negated") == F.lit(hop.negated)) if "negated" in edges.columns and hop.negated else predicate_column(hop, below))
    for name, op, expected in hop.filters:
        out = out.where(apply_op(op, F.array(F.col(name).cast("string")), expected))
    for ref, end in ((hop.subject, "subject"), (hop.object, "object")):
        e = plan.entity(ref)
        if e.ids:
            out = out.where(F.col(end).isin(*e.ids))
        if e.category and nodes is not None:
            out = out.join(nodes.where(F.col("category") == e.category).select(F.col("id").alias(end)), end, "left_semi")
    return out.select(F.col("subject").alias(hop.subject), F.col("object").alias(hop.object), F.col("edge_id").alias(f"edge_{i + 1}"), *[F.col(c).alias(f"{c}_{i + 1}") for c in carry])


def match(edges: DataFrame, plan: Plan, nodes: DataFrame | None = None, below: dict | None = None, distinct_nodes: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """All bindings of a plan: one column for each entity, one edge id for each hop, and the
    edge columns of `carry`, so that nothing has to be joined to the edges again. With
    `distinct_nodes` an id stands for one entity only."""
    if faults := plan.check():
        raise PlanError("; ".join(faults))
    out: DataFrame | None = None
    bound: set[str] = set()
    for i in plan.join_order():
        hop = plan.hops[i]
        step = hop_edges(edges, plan, i, None, below, carry)
        ends = {hop.subject, hop.object}
        if out is None:
            out = step
        else:
            new = ends - bound
            out = out.join(step, sorted(ends & bound))
            if distinct_nodes:
                for ref in new:
                    for other in bound:
                        out = out.where(F.col(ref) != F.col(other))
        # categories are checked on what is bound so far, not on whole edge tables
        for ref in sorted(ends - bound):
            category = plan.entity(ref).category
            if category and nodes is not None:
                out = out.join(nodes.where(F.col("category") == category).select(F.col("id").alias(ref)), ref, "left_semi")
        bound |= ends
    refs = list(dict.fromkeys(r for h in plan.hops for r in (h.subject, h.object)))
    return out.select(*refs, *[f"{c}_{i + 1}" for c in ("edge", *carry) for i in range(len(plan.hops))])


def hop_counts(edges: DataFrame, plan: Plan) -> DataFrame:
    """(step, hop, n_edges, n_joined): edges that fit each hop alone, and bindings once all
    hops so far are joined, in the order of the joins. The first step with edges but no
    joined rows is where a pattern breaks."""
    rows: DataFrame | None = None
    order = plan.join_order()
    for n, i in enumerate(order, 1):
        h = plan.hops[i]
        alone = hop_edges(edges, plan, i).agg(F.count(F.lit(1)).alias("n_edges"))
        part = Plan(plan.entities, tuple(plan.hops[j] for j in order[:n]), plan.returns)
        joined = _fold(edges, part).agg(F.count(F.lit(1)))
        row = alone.select(F.lit(n).alias("step"), F.lit(f"{h.subject}-{h.predicate}-{h.object}").alias("hop"), "n_edges", joined.scalar().alias("n_joined"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


def _fold(edges: DataFrame, plan: Plan) -> DataFrame:
    out, bound = None, set()
    for i, hop in enumerate(plan.hops):
        step = hop_edges(edges, plan, i)
        ends = {hop.subject, hop.object}
        out = step if out is None else out.join(step, sorted(ends & bound))
        bound |= ends
    return out


def anchor_guard(pairs: DataFrame, end: str, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): pairs whose `end` is, or is not, one of the allowed ids (column id)."""
    ids = allowed.select(F.col("id").alias(end)).distinct()
    return pairs.join(ids, end, "left_semi"), pairs.join(ids, end, "left_anti")


def meta_triples(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(subject_category, predicate, object_category, n): what kinds of edges the graph has.
    Categories are aggregated per pair of ends before the second join, so that the hot ends
    of an edge table are joined once."""
    s = nodes.select(F.col("id").alias("subject"), F.col("category").alias("subject_category"))
    o = nodes.select(F.col("id").alias("object"), F.col("category").alias("object_category"))
    by_object = edges.join(s, "subject").groupBy("subject_category", "predicate", "object").agg(F.count(F.lit(1)).alias("n"))
    return by_object.join(o, "object").groupBy("subject_category", "predicate", "object_category").agg(F.sum("n").cast("bigint").alias("n"))


def supported(hops: DataFrame, triples: DataFrame) -> DataFrame:
    """Of each hop (subject_category, predicate, object_category): whether the graph has such
    edges, has them the other way round, and by how many other predicates the categories
    are linked."""
    t = triples.select("subject_category", "predicate", "object_category").distinct().withColumn("yes", F.lit(True))
    back = t.select(F.col("object_category").alias("subject_category"), "predicate", F.col("subject_category").alias("object_category"), F.col("yes").alias("back"))
    other = t.groupBy("subject_category", "object_category").agg(F.count(F.lit(1)).alias("k"))
    key = ["subject_category", "predicate", "object_category"]
    out = hops.join(t, key, "left").join(back, key, "left").join(other, ["subject_category", "object_category"], "left")
    yes = F.col("yes").isNotNull()
    return out.select(*key, yes.alias("is_supported"), F.col("back").isNotNull().alias("is_reverse_supported"), (F.coalesce("k", F.lit(0)) - yes.cast("int")).cast("bigint").alias("n_alternatives"))


def quoted(quotes: DataFrame, texts: DataFrame, key: str, least: int = 15) -> DataFrame:
    """(quote_id, doc_id): the `quotes` (quote_id, key, quote) that stand in a text (doc_id, key,
    text) of their key, without regard to ASCII case and runs of white space; shorter ones than
    `least` characters prove nothing."""
    q = quotes.select("quote_id", key, normal_text(F.col("quote")).alias("quote")).where(F.length("quote") >= least).distinct()
    t = texts.select("doc_id", key, normal_text(F.col("text")).alias("body"))
    return q.join(t, key).where(F.contains("body", F.col("quote"))).select("quote_id", "doc_id").distinct()
