"""Evidence scores of edges and answers. Unknown is null and never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scoring rule.
WEIGHTS = {"knowledge_level": 0.30, "agent_type": 0.20, "publications": 0.20, "source_count": 0.15, "primary_source": 0.15}
KNOWLEDGE_LEVEL = {"knowledge_assertion": 1.0, "logical_entailment": 0.9, "observation": 0.7, "statistical_association": 0.6, "prediction": 0.3, "not_provided": 0.5}
AGENT_TYPE = {"manual_agent": 1.0, "manual_validation_of_automated_agent": 0.9, "data_analysis_pipeline": 0.7, "computational_model": 0.5, "automated_agent": 0.5, "text_mining_agent": 0.4, "image_processing_agent": 0.4, "not_provided": 0.5}
UNKNOWN = 0.5


def by_table(value: Column, table: dict[str, float], unknown: float = UNKNOWN) -> Column:
    out = F.when(F.lit(False), 0.0)
    for k, v in table.items():
        out = out.when(value == k, v)
    return out.otherwise(unknown)


def publication_score(n: Column) -> Column:
    """0.5 without publications, rising with the logarithm to 1 at ten."""
    return F.when(n <= 0, 0.5).otherwise(F.least(F.lit(1.0), 0.5 + 0.5 * F.log10(1 + n) / F.log10(F.lit(11.0))))


def source_count_score(n: Column) -> Column:
    return F.when(n <= 0, 0.4).when(n == 1, 0.6).when(n == 2, 0.8).otherwise(1.0)


def primary_source_score(source: Column, curated: tuple[str, ...], text_mined: tuple[str, ...]) -> Column:
    """Text-mined is tested first; a source on neither list, or none, is between."""
    return F.when(source.isin(*text_mined), 0.5).when(source.isin(*curated), 0.9).otherwise(0.7)


def edge_score(level: Column, agent: Column, n_publications: Column, n_sources: Column, source_score: Column) -> Column:
    w = WEIGHTS
    total = w["knowledge_level"] * by_table(level, KNOWLEDGE_LEVEL) + w["agent_type"] * by_table(agent, AGENT_TYPE) + w["publications"] * publication_score(n_publications) + w["source_count"] * source_count_score(n_sources) + w["primary_source"] * source_score
    return F.round(total, 4)


def combined(scores: Column, how: str = "min") -> Column:
    """One score for the edges of an instance."""
    if how == "min":
        return F.array_min(scores)
    if how == "mean":
        return F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    if how == "product":
        return F.aggregate(scores, F.lit(1.0), lambda a, x: a * x)
    raise ValueError(how)


def strength(level: Column, agent: Column, n_publications: Column, primary: Column) -> Column:
    """asserted_only > strong > moderate > weak > any."""
    return (
        F.when((level == "knowledge_assertion") & (agent == "manual_agent"), "asserted_only")
        .when((level == "knowledge_assertion") | (n_publications >= 3), "strong")
        .when((n_publications >= 1) | (primary.isNotNull() & ~F.coalesce(level, F.lit("not_provided")).isin("prediction", "not_provided")), "moderate")
        .when(primary.isNotNull(), "weak")
        .otherwise("any")
    )


def literature_score(n_read: Column, n_supporting: Column) -> Column:
    """Null if unread, 0 if unsupported, else 0.6 rising to 1 with three supporting texts."""
    return F.when(n_read == 0, F.lit(None).cast("double")).when(n_supporting == 0, 0.0).otherwise(F.least(F.lit(1.0), 0.6 + 0.4 * F.least(F.lit(1.0), (n_supporting - 1) / 2)))


def preference_score(value: Column, preferred: list[str]) -> Column:
    """1.0 for the first of an ordered list down to 0.4 for the last, 0.2 for others."""
    out = F.when(F.lit(False), 0.0)
    for i, p in enumerate(preferred):
        out = out.when(value == p, 1.0 if len(preferred) == 1 else 1.0 - 0.6 * i / (len(preferred) - 1))
    return out.otherwise(0.2)
