"""What graph records say about themselves: attributes, sources, publications, names."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import CURATED_SOURCES, NAME_FIELDS, PUBLICATION_TYPES, TEXT_MINED_SOURCES

INNER = "struct<" + ",".join(f"{f}:string" for f in NAME_FIELDS) + ",value:array<string>>"
ATTRIBUTE = INNER[:-1] + f",attributes:array<{INNER}>>"
SOURCE = "struct<resource_id:string,resource_role:string>"


def _inner(a: Column) -> Column:
    return F.struct(*[a[f].alias(f) for f in NAME_FIELDS], a["value"].alias("value"))


def flat(attributes: Column) -> Column:
    """The attributes, each followed by those one level below it: what the functions below look
    at. Make it a column of its own first, so that it is built once for all of them."""
    nested = F.transform(attributes, lambda a: F.concat(F.array(_inner(a)), F.coalesce(a["attributes"], F.array().cast(f"array<{INNER}>"))))
    return F.coalesce(F.flatten(nested), F.array().cast(f"array<{INNER}>"))


def local_name(name: Column) -> Column:
    """The part after the last colon, lower case, hyphens and blanks as underscores."""
    return F.translate(F.lower(F.substring_index(name, ":", -1)), "- ", "__")


def named(attributes: Column, name: str) -> Column:
    """The values of the first attribute, on either level, that has the local name in any of
    the fields in which a name may stand."""

    def called(a: Column) -> Column:
        out = F.lit(False)
        for f in NAME_FIELDS:
            out = out | (local_name(F.coalesce(a[f], F.lit(""))) == name)
        return out

    hit = F.filter(attributes, called)
    return F.get(hit, 0)["value"]


def names(attributes: Column) -> Column:
    """All local names that occur, sorted."""
    return F.array_sort(F.array_distinct(F.transform(attributes, lambda a: local_name(F.coalesce(a["attribute_type_id"], a["original_attribute_name"])))))


def first_value(attributes: Column, name: str, default: str) -> Column:
    """The first value that is not empty of an attribute, else `default`."""
    hits = F.filter(attributes, lambda a: local_name(F.coalesce(a["attribute_type_id"], F.lit(""))) == name)
    values = F.filter(F.flatten(F.transform(hits, lambda a: a["value"])), lambda v: v.isNotNull() & (v != ""))
    return F.coalesce(F.get(values, 0), F.lit(default))


def publications(attributes: Column, type_names: tuple[str, ...] = PUBLICATION_TYPES) -> Column:
    """Distinct publication ids (PMID or PMC, any case), sorted."""
    hits = F.filter(attributes, lambda a: local_name(F.coalesce(a["attribute_type_id"], F.lit(""))).isin(*type_names))
    values = F.flatten(F.transform(hits, lambda a: a["value"]))
    return F.array_sort(F.array_distinct(F.filter(values, lambda v: F.upper(v).rlike("^(PMID|PMC)"))))


def negated(flag: Column, attributes: Column) -> Column:
    """The record's own flag; else the first `negated` attribute decides, as a word."""
    said = F.get(F.filter(attributes, lambda a: local_name(F.coalesce(a["attribute_type_id"], F.lit(""))) == "negated"), 0)["value"]
    return F.coalesce(flag, F.lit(False)) | F.coalesce(F.lower(F.get(said, 0)) == "true", F.lit(False))


def by_role(sources: Column, role: str) -> Column:
    """Ids of the sources of a role, in order; a source without a role is `unknown`."""
    return F.transform(F.filter(sources, lambda s: F.coalesce(s["resource_role"], F.lit("unknown")) == role), lambda s: s["resource_id"])


def primary_source(sources: Column) -> Column:
    return F.get(by_role(sources, "primary_knowledge_source"), 0)


def all_sources(sources: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(sources, lambda s: s["resource_id"]), lambda x: x.isNotNull())))


def source_matches(source: Column, keywords: tuple[str, ...]) -> Column:
    """Whether a source id (`infores:automat-ctd`) means one of the keywords: equal without
    separators, as a whole word of the id, or, for keywords of five letters or more, inside it."""
    bare = F.regexp_replace(F.lower(F.trim(source)), "^[^:]*:", "")
    joined, words = F.regexp_replace(bare, "[-_.]", ""), F.split(bare, "[-_.]+")
    squeezed = [k.lower().replace("-", "").replace("_", "").replace(".", "") for k in keywords]
    hit = joined.isin(*squeezed) | F.arrays_overlap(words, F.array(*[F.lit(k) for k in squeezed]))
    long = [k for k in squeezed if len(k) >= 5]
    return F.coalesce((joined != "") & (hit | joined.rlike("|".join(long)) if long else hit), F.lit(False))


def source_class(source: Column) -> Column:
    """text_mined (tested first), curated or other."""
    return F.when(source_matches(source, TEXT_MINED_SOURCES), "text_mined").when(source_matches(source, CURATED_SOURCES), "curated").otherwise("other")


def number_or_flag(value: Column) -> Column:
    """A number; words of approval are 1, of refusal 0; anything else is unknown."""
    word = F.lower(F.trim(value.cast("string")))
    return F.coalesce(word.try_cast("double"), F.when(word.isin("approved", "true", "yes"), 1.0).when(word.isin("not_approved", "false", "no"), 0.0))


def year(*fields: Column) -> Column:
    """The first plausible year (1801 to 2199) in any of the fields."""
    found = [F.regexp_extract(f.cast("string"), r"(\d{4})", 1).try_cast("int") for f in fields]
    return F.coalesce(*[F.when((y > 1800) & (y < 2200), y) for y in found])


def prefixed(name: Column, prefix: str = "biolink:") -> Column:
    return F.when(F.startswith(name, F.lit(prefix)), name).otherwise(F.concat(F.lit(prefix), name))


def camel_case(name: Column) -> Column:
    """`gene or protein` and `gene_or_protein` to `GeneOrProtein`."""
    return F.array_join(F.transform(F.split(F.lower(name), "[_ ]+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def iri_to_curie(iri: Column) -> Column:
    """`http://x.example/obo/ABC_12` to `ABC:12`; other names stay."""
    return F.regexp_replace(iri, r"^.*/([A-Za-z]+)_([^/_]+)$", "$1:$2")


def path_description(labels: Column, predicates: Column) -> Column:
    """`A --[p]--> B --[q]--> C`."""
    return F.concat(F.element_at(labels, 1), F.array_join(F.zip_with(predicates, F.slice(labels, 2, F.greatest(F.lit(0), F.size(labels) - 1)), lambda p, b: F.concat(F.lit(" --["), p, F.lit("]--> "), b)), ""))


def digest(text: Column, salt: str, length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt + "::"), text), 256), 1, length)


def normal_text(text: Column) -> Column:
    """ASCII letters in lower case, runs of white space as one blank, none at the ends. Other
    letters stay: their case depends on the letters around them, which a quote may lack."""
    return F.trim(F.regexp_replace(F.translate(text, ascii_uppercase, ascii_lowercase), r"\s+", " "))
