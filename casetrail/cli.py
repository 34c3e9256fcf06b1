"""The jobs from the command line: python -m casetrail.cli JOB ... Each reads and writes files; run() puts them in order."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from casetrail.functions import extraction
from casetrail.operators import evaluate, merge, quality, report
from casetrail.schemas import CASE_REPORT, EXTRACTED_FIGURE, GROUND_TRUTH, MODELS
from casetrail.session import get_session
from casetrail.sources import files

#: Search text per disease and focus; the block of words of wrong diagnosis is shared.
WRONG_DIAGNOSIS = '(misdiagnos*[tiab] OR "initially diagnosed"[tiab] OR "delayed diagnosis"[tiab] OR mimick*[tiab])'


def search_text(disease_terms: list[str], focused: bool) -> str:
    """A literature search for case reports of a disease, focused on wrong diagnoses or not."""
    names = " OR ".join(f'"{t}"[tiab]' for t in disease_terms)
    return f"({names}) AND case reports[pt]" + (f" AND {WRONG_DIAGNOSIS}" if focused else "")


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in input order; 0 stands for all."""
    return df.orderBy(*order).limit(n) if n else df


def extract(spark: SparkSession, path: str, dry_run: bool = False) -> dict:
    """Extraction over a folder of JSON lines, written in place. Counts per level, and up to three examples of each level with
    an entity, for display."""
    done = extraction.apply_extraction(files.read_jsonl(spark, path, CASE_REPORT))
    counts = report.level_counts(done).first().asDict()
    counts["examples"] = {level: [r["pubmed_id"] for r in done.where(F.col("evidence_level") == level).select("pubmed_id").orderBy("pubmed_id").limit(3).collect()]
                          for level in ("high", "medium", "gazetteer")}
    if not dry_run:
        files.rewrite_jsonl(spark, path, CASE_REPORT, lambda d: extraction.apply_extraction(d).drop("evidence_level"))
    return counts


def score(spark: SparkSession, predictions: list[str], labels: str) -> DataFrame | None:
    """Predictions (JSON lines, later files and lines win) against labels (CSV); None where no id is in both."""
    p = files.read_jsonl_in_order(spark, predictions, CASE_REPORT).select(
        "pubmed_id", "file_no", "line_no", (F.coalesce(F.size("misdiagnosis_sequence"), F.lit(0)) > 0).alias("predicted"))
    t = files.read_csv(spark, labels, GROUND_TRUTH).select("pubmed_id", (F.col("has_misdiagnosis") == 1).alias("truth"))
    t = t.groupBy("pubmed_id").agg(F.last("truth").alias("truth"))  # labels are a small file of one part, read in its order
    pairs = evaluate.join_predictions(merge.last_wins(p, "pubmed_id", "file_no", "line_no"), t, "pubmed_id")
    return evaluate.confusion(pairs, "pubmed_id", "predicted", "truth", with_ids=True) if evaluate.has_overlap(pairs) else None


def merged(spark: SparkSession, cases: list[str], figures: list[str]) -> DataFrame:
    c = files.read_jsonl_in_order(spark, cases, CASE_REPORT)
    f = files.read_jsonl_in_order(spark, figures, EXTRACTED_FIGURE)
    return merge.merge_records(c, f, "pubmed_id", ["file_no", "line_no"], ["file_no", "line_no"])


def check(spark: SparkSession, path: str, model: str, optional: bool = False) -> int:
    """0 if every line is valid, 1 if not, 2 for an unknown model or a missing file that is not optional."""
    if model not in MODELS or quality.missing_files(spark, {"lines": path}):
        return 0 if optional and model in MODELS else 2
    return quality.exit_code(quality.validate(files.read_lines(spark, path), model))


def run(spark: SparkSession, cases: str, figures: str, labels: str, out: str) -> dict:
    """The steps in order: validate, extract, validate, score (whose failure does not stop the rest), merge."""
    done = {"before": check(spark, cases, "CaseReport")}
    if done["before"]:
        return done
    done["levels"] = extract(spark, cases)
    done["after"] = check(spark, cases, "CaseReport")
    result = score(spark, [cases], labels) if not quality.missing_files(spark, {"labels": labels}) else None
    done["score"] = result.first().asDict() if result is not None else None
    files.write_jsonl(merged(spark, [cases], [figures]), out, nulls=False)
    return done


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="casetrail")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name, names in (("extract", ["path"]), ("score", ["predictions", "labels"]), ("merge", ["cases", "figures", "out"]), ("validate", ["path", "model"]),
                        ("run", ["cases", "figures", "labels", "out"])):
        job = jobs.add_parser(name)
        for x in names:
            job.add_argument(x)
        if name == "extract":
            job.add_argument("--dry-run", action="store_true")
        if name == "validate":
            job.add_argument("--optional", action="store_true")
    a = parser.parse_args(args)
    spark = get_session()
    if a.job == "validate":
        return check(spark, a.path, a.model, a.optional)
    if a.job == "merge":
        files.write_jsonl(merged(spark, [a.cases], [a.figures]), a.out, nulls=False)
        return 0
    if a.job == "extract":
        out = extract(spark, a.path, a.dry_run)
    elif a.job == "run":
        out = run(spark, a.cases, a.figures, a.labels, a.out)
    else:
        result = score(spark, [a.predictions], a.labels)
        if result is None:
            print("no id is in both files", file=sys.stderr)
            return 1
        out = result.first().asDict()
    print(json.dumps(out, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
