"""Names that must be as they are for the results to be right."""

# Attribute types that hold publication ids.
PUBLICATION_TYPES = ("publications", "publication", "has_supporting_publications", "supporting_publications")

# Fields in which an attribute's name may stand.
NAME_FIELDS = ("attribute_type_id", "original_attribute_name", "value_type_id", "attribute_source", "description")

# Curated and text-mined knowledge sources.
CURATED_SOURCES = ("drugcentral", "drugbank", "chembl", "ctd", "disgenet", "hmdb", "kegg", "reactome", "go", "gocam", "uniprot", "omim", "orphanet", "hpo", "mondo", "clinicaltrials", "dgidb", "pharmgkb", "gtopdb", "sider", "panther", "intact", "biogrid", "string-db", "monarchinitiative")
TEXT_MINED_SOURCES = ("semmeddb", "text-mining-provider", "text-mining-provider-targeted", "text-mining-provider-cooccurrence", "pubtator", "chemotext")

# Categories that a taxon can narrow.
TAXON_SCOPED = ("Gene", "Protein", "GeneOrGeneProduct", "GeneProductMixin", "Polypeptide", "GeneFamily", "Transcript", "RNAProduct", "MacromolecularComplex", "NucleicAcidEntity", "Genome", "OrganismTaxon", "GenomicEntity", "ProteinFamily", "ProteinDomain")

# Categories that are taken for one another.
CONFLATION_GROUPS = {
    "gene_protein": ("Gene", "Protein", "GeneOrGeneProduct", "GeneProductMixin", "Polypeptide", "GeneFamily"),
    "drug_chemical": ("Drug", "SmallMolecule", "ChemicalEntity", "MolecularMixture", "ChemicalMixture", "ChemicalOrDrugOrTreatment", "MolecularEntity"),
}

# Predicates at the end of a path that speak against a candidate.
CONTRARY_PREDICATES = ("biolink:contraindicated_in", "biolink:contraindicated_for", "biolink:has_adverse_event", "biolink:causes_adverse_event", "biolink:has_side_effect", "biolink:causes", "biolink:contributes_to", "biolink:exacerbates", "biolink:exacerbates_condition", "biolink:has_phenotype")

# Predicates that link without a mechanism.
NON_MECHANISTIC_PREDICATES = ("biolink:subclass_of", "biolink:superclass_of", "biolink:related_to", "biolink:related_to_at_concept_level", "biolink:correlated_with", "biolink:positively_correlated_with", "biolink:negatively_correlated_with", "biolink:associated_with", "biolink:coexists_with", "biolink:close_match", "biolink:same_as", "biolink:broad_match", "biolink:narrow_match", "biolink:has_member", "biolink:member_of")

# Reasons for which a path is dropped, in the order in which they are tried.
PATH_REASONS = ("repeated_node", "middle_category_not_allowed", "middle_category_excluded", "predicate_not_whitelisted", "predicate_blacklisted", "required_predicate_absent", "negated_edge", "insufficient_publications", "weak_edge")

# Strengths of evidence, the best first.
STRENGTHS = ("asserted_only", "strong", "moderate", "weak", "any")

# Kinds of statements that describe the query, and that offer candidates.
QUERY_KINDS = ("query_description", "anchors", "policy_description", "explanation_absence")
CANDIDATE_KINDS = ("resolution_options",)
