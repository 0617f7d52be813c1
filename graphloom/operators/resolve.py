"""Filters over the candidates of a name: taxon, category with conflation, direction, concept.

Candidates are rows; what is unknown about one never rejects it. Fallbacks (no candidate of
a name fits) are an anti-join on the name, so that no name is gathered in one task beyond
the join's own partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import CONFLATION_GROUPS, TAXON_SCOPED
from .rules import first_reason

#: Conflations that are on without being asked for.
DEFAULT_CONFLATION = ("gene_protein",)


def _names(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def bare(category: str) -> str:
    return category.removeprefix("biolink:")


def taxon_filter(candidates: DataFrame, taxa: list[str], category: str = "category", own: str = "taxa") -> DataFrame:
    """The candidates of a wanted taxon: only categories that a taxon narrows are filtered, and
    a candidate that names no taxon (null or empty) is unknown, not wrong."""
    scoped = F.coalesce(F.regexp_replace(category, "^biolink:", "").isin(*TAXON_SCOPED), F.lit(False))
    unknown = F.col(own).isNull() | (F.size(own) == 0)
    return candidates.where(~scoped | unknown | F.arrays_overlap(own, _names(taxa)))


def acceptable(category: str, conflation: tuple[str, ...] = ()) -> list[str]:
    """A category and those taken for it under the asked and the default conflations; a
    conflation counts only for categories of its own group."""
    out = {bare(category)}
    for flag in (*conflation, *DEFAULT_CONFLATION):
        group = CONFLATION_GROUPS.get(flag, ())
        if bare(category) in group:
            out |= set(group)
    return sorted(out)


def category_filter(candidates: DataFrame, category: str, conflation: tuple[str, ...] = (), name: str = "name", types: str = "types") -> DataFrame:
    """The candidates of an acceptable category, with `is_fallback`; where a name has none, all
    of its candidates."""
    c = candidates.withColumn("fits", F.coalesce(F.arrays_overlap(types, _names(acceptable(category, conflation))), F.lit(False)))
    good = c.where("fits").select(name).distinct()
    rest = c.where("not fits").join(good, name, "left_anti")
    return c.where("fits").withColumn("is_fallback", F.lit(False)).unionByName(rest.select(c.columns).withColumn("is_fallback", F.lit(True))).drop("fits")


def by_direction(rows: DataFrame, direction: str, synonyms: dict[str, list[str]]) -> DataFrame:
    """`rows` with `side`: the direction that their own word means, without case and outer
    blanks; `undirected` where it means none, which is an error of the input."""
    word = F.lower(F.trim(F.col(direction)))
    return rows.withColumn("side", first_reason([(side, word.isin(*[w.lower() for w in words])) for side, words in synonyms.items()], "undirected"))


def concept_verdict(label: Column, anchor_label: Column, curie: Column, anchor_curie: Column) -> Column:
    """absent (nothing came back), curie_drift (another identifier), match or label_drift."""
    same = F.lower(F.trim(label)) == F.lower(F.trim(anchor_label))
    return first_reason([("absent", label.isNull() & curie.isNull()), ("curie_drift", curie.isNotNull() & (curie != anchor_curie)), ("label_drift", ~same)], "match")


def category_check(types: Column, expected: str) -> Column:
    """Whether a result is of the category asked for; one without categories is skipped."""
    return first_reason([("skipped", types.isNull() | (F.size(types) == 0)), ("ok", F.array_contains(types, bare(expected)))], "mismatch")
