"""Declared record types. Readers take these; nothing is inferred. Field names are fixed values."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType, TimestampType


def _s(name: str, nullable: bool = True) -> StructField:
    return StructField(name, StringType(), nullable)


CASE_REPORT = StructType([
    _s("pubmed_id", False), _s("disease"), _s("title"), _s("abstract"),
    StructField("misdiagnosis_sequence", ArrayType(StringType())),
    StructField("extracted_at", TimestampType()),
])

EXTRACTED_FIGURE = StructType([
    _s("pubmed_id", False), _s("disease"), StructField("figure_index", IntegerType()), _s("figure_type"),
    _s("file_path"), _s("caption"), _s("clinical_relevance"), StructField("extracted_at", TimestampType()),
    _s("source_pdf"),
])

MERGED_RECORD = StructType([
    _s("pubmed_id", False), _s("disease", False),
    StructField("case_report", CASE_REPORT, True),
    StructField("figures", ArrayType(EXTRACTED_FIGURE)),
    StructField("merged_at", TimestampType()),
])

NESTED_FIGURE = StructType([_s("label"), _s("caption"), _s("img_ref"), _s("figure_type")])

ARTICLE_FIGURES = StructType([
    _s("pubmed_id"), _s("pmc_id"), _s("disease"), _s("title"), StructField("figure_count", IntegerType()),
    StructField("figures", ArrayType(NESTED_FIGURE)),
])

GROUND_TRUTH = StructType([
    _s("pubmed_id"), StructField("has_misdiagnosis", IntegerType()), _s("true_wrong_diagnosis"), _s("rationale"),
    _s("review_status"),
])

GOLD_CASE = StructType([_s(n) for n in (
    "pubmed_id", "disease", "title", "abstract", "misdiagnosis_sequence", "extracted_at", "annotation_confidence",
    "annotator_notes")])

PHENOTYPE_MAP = StructType([_s(n) for n in (
    "disease", "hpo_id", "hpo_term", "phenotype_category", "clinical_relevance", "notes")])

FIGURE_CSV_COLUMNS = ["pubmed_id", "disease", "figure_index", "figure_type", "file_path", "caption",
                      "clinical_relevance", "extracted_at", "source_pdf"]

#: Rules of the validator: field -> (kind, presence, rules of a nested record). Kinds are str, int, strlist, time, object, objectlist.
#: "required" must be there and not null, "default" may be missing but not null, "optional" may be either.
CASE_RULES = {
    "pubmed_id": ("str", "required"), "disease": ("str", "required"), "title": ("str", "required"),
    "abstract": ("str", "required"), "misdiagnosis_sequence": ("strlist", "default"),
    "extracted_at": ("time", "required"),
}
FIGURE_RULES = {
    "pubmed_id": ("str", "required"), "disease": ("str", "default"), "figure_index": ("int", "required"),
    "figure_type": ("str", "default"), "file_path": ("str", "required"), "caption": ("str", "default"),
    "clinical_relevance": ("str", "default"), "extracted_at": ("time", "required"), "source_pdf": ("str", "default"),
}
MERGED_RULES = {
    "pubmed_id": ("str", "required"), "disease": ("str", "required"), "case_report": ("object", "optional", CASE_RULES),
    "figures": ("objectlist", "default", FIGURE_RULES), "merged_at": ("time", "required"),
}
MODELS = {"CaseReport": CASE_RULES, "ExtractedFigure": FIGURE_RULES, "MergedRecord": MERGED_RULES}
