"""Queries of the problems tagged llm, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from casetrail.llm import canonical, encode, history, lookalike, packing, repetition, scanned
from casetrail.session import cut, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.equal_looking({
        "case_reports": lookalike.forms(table(spark, sf, "case_reports"), "report_id", ["title", "abstract"]),
        "extracted_figures": lookalike.forms(table(spark, sf, "extracted_figures"), "figure_id", ["caption"]),
    })


def p1_canonical_reports(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.canonicalize(table(spark, sf, "case_reports"), "report_id", ["title", "abstract"])


def p1_canonical_captions(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.canonicalize(table(spark, sf, "extracted_figures"), "figure_id", ["caption"])


def p3_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return scanned.repair(table(spark, sf, "extracted_figures"), "figure_id", "caption")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_repaired(spark, sf).select("figure_id", F.explode("damage").alias("damage"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    _, pairs = history.repeats(table(spark, sf, "case_reports"), "report_id", "batch_no", "pubmed_id", "abstract")
    return pairs.select(F.col("row_id_a").alias("report_id_a"), F.col("row_id_b").alias("report_id_b"))


def _typed_values(spark: SparkSession, sf: str) -> DataFrame:
    reports = table(spark, sf, "case_reports").select(
        F.lit("misdiagnosis_sequence").alias("field_name"), F.lit("diagnosis").alias("list_name"),
        F.col("report_id").alias("row_id"), F.posexplode("misdiagnosis_sequence").alias("item_no", "value"))
    reports = reports.withColumn("item_no", F.col("item_no") + 1)

    def single(name: str, key: str, field: str, which: str) -> DataFrame:
        return table(spark, sf, name).select(F.lit(field).alias("field_name"), F.lit(which).alias("list_name"),
                                             F.col(key).alias("row_id"), F.lit(1).alias("item_no"), F.col(field).alias("value"))

    return (reports.unionByName(single("sle_labels", "label_id", "true_wrong_diagnosis", "diagnosis"))
            .unionByName(single("hpo_mapping_table", "map_id", "hpo_term", "hpo")))


def _reference_lists(spark: SparkSession, sf: str) -> dict[str, list[tuple[str, str]]]:
    return {"diagnosis": canonical.read_terms(table(spark, sf, "diagnosis_terms"), "term_id", "term_name"),
            "hpo": canonical.read_terms(table(spark, sf, "hpo_terms"), "term_id", "term_name")}


def p6_mapped(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.map_values(_typed_values(spark, sf), _reference_lists(spark, sf)).select(
        "field_name", "row_id", "item_no", "value", "term_id")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    lists = _reference_lists(spark, sf)
    exact = spark.createDataFrame([(n, t) for n, terms in lists.items() for _, t in terms], "list_name string, value string")
    typed = _typed_values(spark, sf).join(F.broadcast(exact), ["list_name", "value"], "left_anti")  # at most MAX_TERMS rows a list
    return canonical.map_values(typed, lists).select("field_name", "row_id", "item_no", "term_id")


def p6_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    return (p6_mapped(spark, sf).where(F.col("term_id") == canonical.NONE)
            .groupBy("field_name", "value").agg(F.count("*").alias("n_values")))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode.encode(table(spark, sf, "documents"), "doc_id", "text")


def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's pieces with their container, for each capacity."""
    sizes = cut(encode.count_tokens(table(spark, sf, "documents"), "doc_id", "text"))
    out = None
    for row in table(spark, sf, "context_sizes").orderBy("size_name").collect():  # a fixed list of capacities
        part = packing.pack(sizes, "doc_id", "n_tokens", row["capacity_tokens"]).select(F.lit(row["size_name"]).alias("size_name"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def p8_use(spark: SparkSession, sf: str) -> DataFrame:
    """How much of the containers' room is used, for each capacity."""
    per = p8_packed(spark, sf).groupBy("size_name", "container_id").agg(F.sum("n_tokens").alias("used"))
    return (per.groupBy("size_name").agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"))
            .join(table(spark, sf, "context_sizes"), "size_name")
            .withColumn("share_used", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))))


def p9_judged(spark: SparkSession, sf: str) -> DataFrame:
    return repetition.judge(table(spark, sf, "documents"), "doc_id", "text", "source")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_judged(spark, sf).where("is_repetitive").select("doc_id")


def p9_sources(spark: SparkSession, sf: str) -> DataFrame:
    shares = repetition.repeated_share(table(spark, sf, "documents"), "doc_id", "text", ["source"])
    judged = shares.withColumn("is_repetitive", F.col("share") >= repetition.LIMIT - 1e-12)
    return repetition.source_verdicts(judged, "source", "is_repetitive")


QUERIES = {f.__name__: f for f in (p1_found, p1_canonical_reports, p1_canonical_captions, p3_found, p3_repaired, p4_found, p6_found, p6_mapped, p6_unmatched, p7_ids, p8_packed, p8_use, p9_found, p9_judged, p9_sources)}
_TEXTS = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{f}' AS field_name, {k} AS row_id, {f} AS raw, {f} AS look FROM {t} WHERE {f} <> ''"
    for t, k, f in (("case_reports", "report_id", "title"), ("case_reports", "report_id", "abstract"), ("extracted_figures", "figure_id", "caption")))


def _canonical(name: str, key: str, fields: list[str]) -> str:
    return lookalike.canonical_sql(f"(SELECT {key}, {', '.join(fields)} FROM {name})", [key], fields)


#: The other llm queries cannot be put in SQL; they are tested against brute force, the library or invariants.
ORACLE = {
    "p1_found": f"""
        WITH seen AS ({lookalike.canonical_sql(f'({_TEXTS})', ['table_name', 'field_name', 'row_id', 'raw'], ['look'])})
        SELECT a.table_name, a.field_name, a.row_id AS row_id_a, b.row_id AS row_id_b FROM seen a JOIN seen b
        ON a.table_name = b.table_name AND a.field_name = b.field_name AND a.look = b.look AND a.row_id < b.row_id AND a.raw <> b.raw
        WHERE a.look <> ''""",
    "p1_canonical_reports": _canonical("case_reports", "report_id", ["title", "abstract"]),
    "p1_canonical_captions": _canonical("extracted_figures", "figure_id", ["caption"]),
}
