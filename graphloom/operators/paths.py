"""Simple paths of bounded length between two nodes, and what may be said of them.

The frontier grows by one join per hop and keeps only paths that end at new nodes; both
directions of an edge may be walked. The distance to the nearest end is computed first
(one join per hop, new nodes only), so that a path is extended only where it can still
arrive: the frontier follows the answer, not the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import CONTRARY_PREDICATES, NON_MECHANISTIC_PREDICATES, PATH_REASONS, STRENGTHS
from ..sources import spill
from .ranking import top
from .rules import first_reason

MAX_HOPS = 5


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, edge_id, predicate) of each edge in both directions, without loops."""
    fwd = edges.where("subject != object").select(F.col("subject").alias("a"), F.col("object").alias("b"), "edge_id", "predicate")
    return fwd.unionByName(fwd.select(F.col("b").alias("a"), F.col("a").alias("b"), "edge_id", "predicate"))


def simple_paths(edges: DataFrame, starts: list[str], ends: list[str], max_hops: int = 4) -> DataFrame:
    """(nodes, edges, predicates, length) of the paths that repeat no node."""
    if not 1 <= max_hops <= MAX_HOPS:
        raise ValueError(f"max_hops must be 1 to {MAX_HOPS}")
    steps = both_ways(edges)
    # the least number of steps from each node to an end, for those below max_hops
    reach = spill(steps.where(F.col("b").isin(*ends)).select(F.col("b").alias("id"), F.lit(0).alias("steps")).distinct())
    ring = reach
    for k in range(1, max_hops):
        new = steps.join(ring.select(F.col("id").alias("b")), "b", "left_semi").select(F.col("a").alias("id")).distinct()
        ring = spill(new.join(reach, "id", "left_anti").withColumn("steps", F.lit(k)))
        reach = reach.unionByName(ring)
    towards = steps.join(reach.select(F.col("id").alias("b"), "steps"), "b")
    frontier = towards.where(F.col("a").isin(*starts) & (F.col("steps") <= max_hops - 1)).select(F.array("a", "b").alias("nodes"), F.array("edge_id").alias("edges"), F.array("predicate").alias("predicates"), F.col("b").alias("at"))
    done = None
    for k in range(1, max_hops + 1):
        at_end = F.col("at").isin(*ends)
        arrived = frontier.where(at_end).select("nodes", "edges", "predicates", F.lit(k).alias("length"))
        done = arrived if done is None else done.unionByName(arrived)
        if k == max_hops:
            break
        step = towards.where(F.col("steps") <= max_hops - k - 1)
        frontier = frontier.where(~at_end).join(step, F.col("at") == F.col("a")).where(~F.array_contains("nodes", F.col("b"))).select(F.array_append("nodes", F.col("b")).alias("nodes"), F.array_append("edges", F.col("edge_id")).alias("edges"), F.array_append("predicates", F.col("predicate")).alias("predicates"), F.col("b").alias("at"))
    return done


def distinct_routes(paths: DataFrame) -> DataFrame:
    """One row for each (nodes, predicates), with the number of edge variants behind it."""
    return paths.groupBy("nodes", "predicates", "length").agg(F.count(F.lit(1)).alias("variant_count"), F.min("edges").alias("edges"))


def verdict(predicates: Column, negated: Column) -> Column:
    """What a path (arrays by edge) may be used for: malformed, negated, contrary (its last
    predicate speaks against the candidate), no_mechanism (all its predicates link without
    one), else ok."""
    reasons = [
        ("malformed", predicates.isNull() | (F.size(predicates) == 0)),
        ("negated", F.exists(negated, lambda x: x)),
        ("contrary", F.try_element_at(predicates, F.lit(-1)).isin(*CONTRARY_PREDICATES)),
        ("no_mechanism", F.forall(predicates, lambda p: p.isin(*NON_MECHANISTIC_PREDICATES))),
    ]
    return first_reason(reasons, "ok")


def drop_reason(nodes: Column, middles: Column, predicates: Column, negated: Column, publications: Column, strengths: Column | None = None, *, allowed_middles: tuple[str, ...] = (), banned_middles: tuple[str, ...] = (), allowed: tuple[str, ...] = (), banned: tuple[str, ...] = (), required: tuple[str, ...] = (), least_publications: int = 0, least_strength: str | None = None) -> Column:
    """The first rule of a request that a path breaks, else `kept`: no node twice, every middle
    category allowed and none banned, all predicates allowed and none banned, one required
    one present, no edge negated, every edge with enough publications and strong enough."""

    def of(names: tuple[str, ...]) -> Column:
        return F.array(*[F.lit(n) for n in names]).cast("array<string>")

    known = F.filter(middles, lambda m: m.isNotNull() & (m != ""))
    twice, not_allowed, excluded, not_listed, listed, absent, negative, few, weak = PATH_REASONS
    reasons = [(twice, F.size(F.array_distinct(nodes)) < F.size(nodes))]
    if allowed_middles:
        reasons.append((not_allowed, F.size(F.array_except(known, of(allowed_middles))) > 0))
    if banned_middles:
        reasons.append((excluded, F.arrays_overlap(known, of(banned_middles))))
    if allowed:
        reasons.append((not_listed, F.size(F.array_except(predicates, of(allowed))) > 0))
    if banned:
        reasons.append((listed, F.arrays_overlap(predicates, of(banned))))
    if required:
        reasons.append((absent, ~F.arrays_overlap(predicates, of(required))))
    reasons.append((negative, F.exists(negated, lambda x: x)))
    if least_publications:
        reasons.append((few, F.exists(publications, lambda n: n < least_publications)))
    if least_strength:
        enough = of(STRENGTHS[: STRENGTHS.index(least_strength) + 1])
        reasons.append((weak, F.size(F.array_except(strengths, enough)) > 0))
    return first_reason(reasons)


def path_order(how: str, scores: Column, length: Column, digits: int = 4) -> list[Column]:
    """The keys by which paths are ordered: `shortest` first, the best `evidence` of the weakest
    edge first, or `composite`, the mean evidence less a twentieth for each hop."""
    weakest = F.coalesce(F.array_min(scores), F.lit(0.0))
    mean = F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)).otherwise(0.0)
    if how == "shortest":
        return [length.asc(), weakest.desc()]
    if how == "evidence":
        return [weakest.desc(), length.asc()]
    if how == "composite":
        return [F.round(mean - 0.05 * length, digits).desc(), length.asc()]
    raise ValueError(how)


def endpoints(ranked: DataFrame, path_ids: tuple[str, ...], k: int, order: list[Column]) -> DataFrame:
    """The first k candidates (with `path_ids`, an array) that one of the given paths supports:
    from these an explanation fans out. k is small, so the ids may come to the driver."""
    return top(ranked.where(F.arrays_overlap("path_ids", F.array(*[F.lit(p) for p in path_ids]))), order, k)


def attached(candidates: DataFrame, paths: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(candidates with n_paths, the paths that reach no candidate)."""
    per = paths.groupBy(key).agg(F.count(F.lit(1)).alias("n_paths"))
    return candidates.join(per, key, "left").withColumn("n_paths", F.coalesce("n_paths", F.lit(0))), paths.join(candidates.select(key), key, "left_anti")
