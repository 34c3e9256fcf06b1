"""Readers and writers at the edges: JSON lines, CSV, XML and binary landing files.

Remote calls are no part of a DataFrame job: searches, listings and downloads are landed as files by
whoever may reach the network, and these readers take them from there.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from casetrail.schemas import FIGURE_CSV_COLUMNS, NESTED_FIGURE
from casetrail.session import ship


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: StructType, strict: bool = True) -> DataFrame:
    """Records of JSON-lines files; blank lines are skipped, a bad line fails the job unless not strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(paths)


def read_jsonl_in_order(spark: SparkSession, paths: list[str], schema: StructType) -> DataFrame:
    """Records of several files with (file_no, line_no), for steps in which the last one wins."""
    out = None
    for i, path in enumerate(paths):
        part = read_lines(spark, path).where(~F.rlike("value", F.lit(r"(?U)^\s*$"))).select(
            F.lit(i).alias("file_no"), "line_no", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("file_no", "line_no", "r.*")
        out = part if out is None else out.unionByName(part)
    return out


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a text file, numbered from 1. Positions come from the file itself, so they are
    the same however often a task is run."""
    rdd = spark.read.text(path).rdd.map(lambda r: r[0]).zipWithIndex()
    return rdd.map(lambda x: (x[1] + 1, x[0])).toDF("line_no long, value string")


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """CSV with a header; doubled quotes within quoted cells stand for themselves. Strings without a schema."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path)


def write_jsonl(df: DataFrame, path: str, nulls: bool = True) -> None:
    """One object a line; without ``nulls``, fields without a value are left out, so that a reader's defaults hold."""
    df.write.mode("overwrite").option("ignoreNullFields", not nulls).json(path)


def write_figures_csv(figures: DataFrame, path: str) -> None:
    figures.select(*FIGURE_CSV_COLUMNS).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def rewrite_jsonl(spark: SparkSession, path: str, schema: StructType, change, dry_run: bool = False) -> DataFrame:
    """Reads, changes and rewrites a folder of JSON lines: the new version is written beside it and swapped in."""
    changed = change(read_jsonl(spark, path, schema))
    if dry_run:
        return changed
    new = path.rstrip("/") + ".new"
    write_jsonl(changed, new)
    jvm = spark.sparkContext._jvm
    old_path, new_path = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(new)
    fs = old_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + ".old")
    fs.delete(aside, True)
    # at every moment one whole version is there, under its name or beside it
    for source, target in ((old_path, aside), (new_path, old_path)):
        if not fs.rename(source, target):
            raise OSError(f"{source} could not be renamed to {target}")
    fs.delete(aside, True)
    return read_jsonl(spark, path, schema)


def write_xml_archive(records: DataFrame, path: str, root: str = "records", row: str = "record") -> None:
    records.write.mode("overwrite").format("xml").option("rootTag", root).option("rowTag", row).save(path)


def read_binary(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(path, modificationTime, length, content) of landed files such as *.pdf, by path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).orderBy("path")


def search_rows(landed: DataFrame, disease: str) -> DataFrame:
    """Landed search results as case reports: the id's first line, trimmed texts, an empty sequence;
    rows without an id drop out."""
    from casetrail.functions.scalar import first_line, text_or_empty

    return (landed.select(first_line(F.coalesce("pubmed_id", F.lit(""))).alias("pubmed_id"), F.lit(disease).alias("disease"),
                          text_or_empty(F.col("title")).alias("title"), text_or_empty(F.col("abstract")).alias("abstract"),
                          F.array().cast("array<string>").alias("misdiagnosis_sequence"), F.current_timestamp().alias("extracted_at"))
            .where(F.col("pubmed_id") != ""))


def resolve_ids(records: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Adds pmc_id from a landed crosswalk (pubmed_id, link_no, pmc_number), by the first link; null where there is none."""
    first = crosswalk.groupBy("pubmed_id").agg(F.min_by("pmc_number", "link_no").alias("_n"))
    return records.join(first, "pubmed_id", "left").withColumn("pmc_id", F.concat(F.lit("PMC"), F.col("_n"))).drop("_n")


def lookup(rows: DataFrame, table: DataFrame, key: str | list[str], value: str, default: str | None = None) -> DataFrame:
    """Rows with a value from a small keyed table: misses take the default, or drop out without one."""
    if default is None:
        return rows.join(table, key, "inner")
    return rows.join(table, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def figures_of_xml(xml: str | None) -> list[tuple[str, str, str]]:
    """(label, caption, image reference) of every figure of an article, in document order; none for bad XML."""
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return []
    out = []
    for fig in (e for e in root.iter() if _local(e.tag) == "fig"):
        label = next(((e.text or "").strip() for e in fig if _local(e.tag) == "label"), "")
        caption = next((e for e in fig if _local(e.tag) == "caption"), None)
        parts = [] if caption is None else ["".join(c.itertext()).strip() for c in caption]
        graphic = next((e for e in fig.iter() if _local(e.tag) == "graphic"), None)
        ref = "" if graphic is None else next((v for k, v in graphic.attrib.items() if _local(k).endswith("href")), "")
        out.append((label, " ".join(" ".join(parts).split()), ref))
    return out


def parse_articles(articles: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, figures): every article's figures with their class; articles without any drop out."""
    from casetrail.functions.figures import classify_caption

    ship(articles.sparkSession)
    source = articles.select(key, xml)
    schema = StructType([source.schema[key], StructField("n", IntegerType()), StructField("label", StringType()),
                         StructField("caption", StringType()), StructField("img_ref", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [figures_of_xml(x) for x in b.column(1).to_pylist()]
            rows = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            flat = [x for f in found for x in f]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(rows), pa.array([k for f in found for k in range(len(f))], pa.int32()),
                 *[pa.array([x[j] for x in flat], pa.string()) for j in range(3)]], names=schema.names)

    flat = source.mapInArrow(run, schema).withColumn("figure_type", classify_caption(F.col("caption")))
    nested = F.struct(*[F.col(f.name) for f in NESTED_FIGURE.fields])
    return (flat.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", nested.alias("f")))).alias("l"))
            .select(key, F.size("l").alias("figure_count"), F.transform("l", lambda x: x["f"]).alias("figures")))
