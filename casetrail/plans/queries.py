"""Queries of the core, each over its whole tables, with the oracle's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from casetrail.functions import extraction, figures
from casetrail.functions.keys import article_key
from casetrail.functions.scalar import base_name, file_stem_id, first_line, text_or_empty, two_decimals, url_quote, version_number
from casetrail.operators import evaluate, merge, orphans, overlay, packed, quality, report, search
from casetrail.session import spread, table
from casetrail.sources import files


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return packed.split_packed(table(spark, sf, "annotated_cases"), "case_no", "misdiagnosis_sequence", at_least=2)


def p2_values(spark: SparkSession, sf: str) -> DataFrame:
    return packed.split_packed(table(spark, sf, "annotated_cases"), "case_no", "misdiagnosis_sequence")


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    refs = orphans.references({"extracted_figures": (table(spark, sf, "extracted_figures"), "figure_id"),
                               "sle_labels": (table(spark, sf, "sle_labels"), "label_id")}, "pubmed_id", "loaded_at")
    parent = orphans.parents(table(spark, sf, "case_reports"), table(spark, sf, "withdrawals"), "pubmed_id", "loaded_at",
                             "withdrawn_at")
    return orphans.find_orphans(refs, parent)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).select("table_name", "row_id")


def p5_counts(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_counts(_orphans(spark, sf))


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "case_reports").withColumn("article", article_key("pubmed_id"))


def _figures(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "extracted_figures").withColumn("article", article_key("pubmed_id"))


def _abstracts(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "case_reports").select("report_id", "disease", "abstract", "misdiagnosis_sequence"))


def extract_levels(spark: SparkSession, sf: str) -> DataFrame:
    """The tier cascade over every report, with what it leaves in the sequence."""
    return extraction.apply_extraction(_abstracts(spark, sf)).select(
        "report_id", "evidence_level", F.array_join("misdiagnosis_sequence", " | ").alias("sequence"))


def extract_summary(spark: SparkSession, sf: str) -> DataFrame:
    return report.level_counts(extraction.apply_extraction(_abstracts(spark, sf)))


def signal_only_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Reports with a signal but no entity, for review."""
    return extraction.apply_extraction(_abstracts(spark, sf)).where("evidence_level = 'signal_only'").select("report_id")


def signal_by_disease(spark: SparkSession, sf: str) -> DataFrame:
    return report.coverage(table(spark, sf, "case_reports"), "disease", F.coalesce(extraction.has_signal(F.col("abstract")), F.lit(False)))


def diagnostic_delays(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "case_reports").select("report_id", extraction.diagnostic_delay(F.col("abstract")).alias("delay_days"))
    return d.where(F.col("delay_days").isNotNull())


def caption_classes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "extracted_figures").select("figure_id", figures.classify_caption(F.col("caption")).alias("class"))


def figures_by_type(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "extracted_figures").select(F.coalesce("disease", F.lit("")).alias("disease"), F.lower(F.coalesce("figure_type", F.lit("other"))).alias("type"))
    return d.rollup("disease", "type").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))


def last_reports(spark: SparkSession, sf: str) -> DataFrame:
    d = _reports(spark, sf).where(F.col("article").isNotNull()).select("article", "report_id", "batch_no", "disease")
    return merge.last_wins(d, "article", "report_id")


def merged_summary(spark: SparkSession, sf: str) -> DataFrame:
    """One row per article, with or without a report, and its figures in order."""
    c = _reports(spark, sf).select("article", "report_id", "disease")
    f = _figures(spark, sf).select("article", "figure_index", "figure_id", "disease")
    return merge.merged_summary(c, f, "article", ["report_id"], ["figure_index", "figure_id"]).select(
        "article", "disease", "has_case_report", "n_figures", F.coalesce("first.figure_id", F.lit(-1).cast("long")).alias("first_figure"))


def label_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """Reports with a wrong diagnosis on record against the labels; the last row of an article counts."""
    p = _reports(spark, sf).where(F.col("article").isNotNull()).select(
        "article", "report_id", (F.coalesce(F.size("misdiagnosis_sequence"), F.lit(0)) > 0).alias("predicted"))
    t = table(spark, sf, "sle_labels").select(article_key("pubmed_id").alias("article"), "label_id", (F.col("has_misdiagnosis") == 1).alias("truth"))
    t = t.where(F.col("article").isNotNull() & F.col("truth").isNotNull())
    pairs = evaluate.join_predictions(merge.last_wins(p, "article", "report_id"), merge.last_wins(t, "article", "label_id"), "article")
    return evaluate.confusion(pairs, "article", "predicted", "truth")


def wrong_diagnosis_edges(spark: SparkSession, sf: str) -> DataFrame:
    return report.confusion_edges(table(spark, sf, "case_reports"), "misdiagnosis_sequence", "disease")


def diagnosis_trails(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "case_reports").where(F.size("misdiagnosis_sequence") > 0)
    return d.select("report_id", report.trail(F.col("misdiagnosis_sequence")).alias("trail"))


def sequence_items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "case_reports").select("report_id", F.posexplode("misdiagnosis_sequence").alias("place", "item"))


TOPICS = {"kidney": "(?i)nephr|renal|urine", "skin": "(?i)rash|skin|purpura", "lung": "(?i)lung|pleur|cough", "nerve": "(?i)seizure|neur|headache"}


def topics_by_disease(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "case_reports").withColumn("disease", F.coalesce("disease", F.lit("")))
    return report.topic_matrix(d, "disease", "abstract", TOPICS).groupBy("topic", "disease").agg(F.count("*").alias("n"))


def file_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "extracted_figures").select("figure_id", base_name(F.col("file_path")).alias("file"), file_stem_id(F.col("file_path")).alias("stem_id"))


def newest_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Versioned prefixes made of order and line number: ".10/" beats ".9/", unnumbered ones lose."""
    d = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("c"))
    d = d.select(F.col("l_orderkey").alias("k"), F.concat(F.lit("P"), F.col("l_orderkey"), F.when(F.col("l_linenumber") == 1, F.lit("/")).otherwise(
        F.concat(F.lit("."), F.col("l_linenumber") * 2, F.lit("/")))).alias("prefix"), F.col("l_linenumber").alias("o"))
    d = figures.pick_version(d, "k", "prefix", "o")
    return d.select("k", "prefix", version_number(F.col("prefix")).alias("version"))


def annotated_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions laid over figures: every third open figure is typed, every seventh removed."""
    f = table(spark, sf, "extracted_figures").select("figure_id", F.when(F.col("figure_index") % 2 == 0, F.lit("unlabeled")).otherwise(F.col("figure_type")).alias("figure_type"))
    d = f.where((F.col("figure_id") % 3 == 0) | (F.col("figure_id") % 7 == 0)).select(
        "figure_id", F.when(F.col("figure_id") % 3 == 0, "histology").alias("new_type"), (F.col("figure_id") % 7 == 0).alias("remove"))
    return overlay.apply_decisions(f, d, ["figure_id"])


def unlabelled_reports(spark: SparkSession, sf: str) -> DataFrame:
    labelled = table(spark, sf, "sle_labels").select(article_key("pubmed_id").alias("article")).where("article is not null")
    return _reports(spark, sf).where("article is not null").join(labelled, "article", "left_anti").select("report_id", "article")


def zero_shot_types(spark: SparkSession, sf: str) -> DataFrame:
    """The first four vectors stand for the four classes' prompts."""
    e = table(spark, sf, "embeddings")
    prompts = [r["embedding"] for r in e.where("vec_id < 4").orderBy("vec_id").collect()]
    guess = figures.zero_shot(F.col("embedding"), prompts)
    d = e.select("vec_id", F.when(F.col("label") < 5, "other").otherwise("imaging").alias("figure_type"), guess.alias("g"))
    return d.select("vec_id", F.col("g.label").alias("label"), F.round("g.p", 6).alias("p"), figures.accept_zero_shot(F.col("figure_type"), F.col("g")).alias("accepted"))


def nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    query = e.where("vec_id = 7").first()["embedding"]
    return search.top_k_by_vector(e, "vec_id", "embedding", query, 10).select("vec_id", F.round("score", 6).alias("score"))


def nearest_vectors_of_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest rows of every row whose id is divisible by 50."""
    e = table(spark, sf, "embeddings")
    found = search.top_k_of_queries(e, "vec_id", "embedding", e.where("vec_id % 50 = 0"), 10)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"))


def keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    hits = search.bm25(table(spark, sf, "case_reports"), "report_id", "abstract", ["tuberculosis", "lymphoma", "seizures"])
    return hits.select("report_id", F.round("score", 6).alias("score"))


def keyword_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred best of two keyword searches, their ranks fused."""
    d = table(spark, sf, "case_reports")
    parts = [search.bm25(d, "report_id", "abstract", t).withColumn("score", F.round("score", 6)) for t in (["tuberculosis", "lymphoma"], ["seizures", "rash"])]
    return search.fuse([search.ranked(p, "report_id", 100) for p in parts], "report_id").select("report_id", F.round("score", 9).alias("score"))


def topic_table(spark: SparkSession, sf: str) -> DataFrame:
    return report.topic_table(table(spark, sf, "case_reports").withColumn("disease", F.coalesce("disease", F.lit(""))), "disease", "abstract", TOPICS)


def figure_totals(spark: SparkSession, sf: str) -> DataFrame:
    return report.figure_totals(_figures(spark, sf), "article", "file_path")


def diagnosis_directions(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "case_reports").select(report.direction(F.col("misdiagnosis_sequence"), F.col("disease")).alias("direction"))
    return d.groupBy("direction").agg(F.count("*").alias("n"))


def figure_diseases(spark: SparkSession, sf: str) -> DataFrame:
    """Every figure's disease by its article's last report, "" where there is none."""
    known = merge.last_wins(_reports(spark, sf).where("article is not null").select("article", "report_id", F.coalesce("disease", F.lit("")).alias("report_disease")), "article", "report_id")
    return files.lookup(_figures(spark, sf).select("figure_id", "article"), known.select("article", "report_disease"), "article", "report_disease", "").select("figure_id", "report_disease")


def reported_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Figures of articles with a report; the others drop out."""
    known = merge.last_wins(_reports(spark, sf).where("article is not null").select("article", "report_id"), "article", "report_id")
    return files.lookup(_figures(spark, sf).select("figure_id", "article"), known, "article", "report_id").select("figure_id", "report_id")


def nearest_captions(spark: SparkSession, sf: str) -> DataFrame:
    """Of three text blocks a figure, composed from its own columns, the one that captions an image ending at 40."""
    blocks = F.array(*[F.struct(y.cast("double").alias("y0"), t.alias("text")) for y, t in (
        (F.col("figure_index") % 9 * 10, F.col("caption")), (F.lit(60), F.concat(F.lit("Figure "), F.col("figure_index"))), (F.lit(41), F.lit("body text")))])
    d = table(spark, sf, "extracted_figures").where("figure_index is not null")
    return d.select("figure_id", figures.nearest_caption(F.lit(40.0), blocks).alias("caption"))


def term_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Scalar functions on typed terms: trimmed, first line, quoted for an address, a number with two places."""
    d = table(spark, sf, "hpo_mapping_table").where("hpo_term is not null")
    return d.select("map_id", text_or_empty(F.col("hpo_term")).alias("trimmed"), first_line(F.concat(F.col("hpo_term"), F.lit("\nsecond"))).alias("line"),
                    url_quote(F.col("hpo_id")).alias("address"), two_decimals(F.col("map_id") / 8).alias("number"), F.substring("hpo_term", 1, 12).alias("start"))


def first_reports(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten reports with an article, by their place in the input (the limit is the feature)."""
    return _reports(spark, sf).where("article is not null").orderBy("report_id").limit(10).select("report_id", "article")


def unreadable_props(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose properties, cut off every third time, are no JSON."""
    d = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props")).alias("value"))
    return quality.bad_json(d).select("event_id")


def phenotype_map(spark: SparkSession, sf: str) -> DataFrame:
    terms = table(spark, sf, "hpo_terms")
    return table(spark, sf, "hpo_mapping_table").join(F.broadcast(terms), F.col("hpo_term") == F.col("term_name")).select("map_id", "disease", "term_id", "phenotype_category")


def invalid_records(spark: SparkSession, sf: str) -> DataFrame:
    """Every report as a JSON line, nulls kept, with the errors its own fields give."""
    line = F.to_json(F.struct("pubmed_id", "disease", "title", "abstract", "misdiagnosis_sequence",
                              F.date_format("extracted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("extracted_at")), {"ignoreNullFields": "false"})
    v = quality.validate(table(spark, sf, "case_reports").select("report_id", line.alias("value")), "CaseReport")
    return v.select("report_id", F.array_join(F.transform("errors", lambda e: F.concat(e["field"], F.lit(":"), e["code"])), ",").alias("errors"))


QUERIES = {f.__name__: f for f in (
    extract_levels, extract_summary, signal_only_reports, signal_by_disease, diagnostic_delays, caption_classes, figures_by_type, last_reports, merged_summary,
    label_confusion, wrong_diagnosis_edges, diagnosis_trails, sequence_items, topics_by_disease, file_ids, newest_versions, annotated_figures,
    unlabelled_reports, zero_shot_types, nearest_vectors, nearest_vectors_of_queries, keyword_search, keyword_fusion, topic_table, figure_totals, diagnosis_directions, figure_diseases, reported_figures,
    nearest_captions, term_forms, first_reports, unreadable_props, phenotype_map, invalid_records, p2_found, p2_values, p5_found, p5_counts)}
