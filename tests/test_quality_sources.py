import json

import pytest

from casetrail.operators.quality import bad_json_lines, error_summary, exit_code, validate
from casetrail.schemas import CASE_REPORT
from casetrail.sources import files
from casetrail.streaming.extract import stream_reports, write_stream

GOOD = {"pubmed_id": "1", "disease": "SLE", "title": "t", "abstract": "a", "misdiagnosis_sequence": [], "extracted_at": "2026-01-01T00:00:00Z"}


def but(**x):
    return json.dumps({k: v for k, v in {**GOOD, **x}.items() if v != "-"})


CASES = [(but(), []), (but(abstract="-"), ["abstract:missing"]), (but(title=None), ["title:null"]), (but(pubmed_id=7), ["pubmed_id:wrong_type"]),
         (but(misdiagnosis_sequence="-"), []), (but(misdiagnosis_sequence=None), ["misdiagnosis_sequence:null"]),
         (but(misdiagnosis_sequence=[1]), ["misdiagnosis_sequence:wrong_type"]), (but(extracted_at="2026-01-01 10:00:00"), []),
         (but(extracted_at=1700000000), []), (but(extracted_at="never"), ["extracted_at:wrong_type"]), (but(more=1), []), (but(pubmed_id=""), []),
         ("{bad", [":invalid_json"]), ("[1]", [":not_an_object"]), ("  ", [])]


def test_validation(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "line_no int, value string")
    v = validate(df, "CaseReport")
    got = {r["line_no"]: [f"{e['field']}:{e['code']}" for e in r["errors"]] for r in v.collect()}
    assert got == {i: c[1] for i, c in enumerate(CASES)}
    assert tuple(error_summary(v).first()) == (15, sum(bool(c[1]) for c in CASES)) and exit_code(v) == 1
    assert [r["line_no"] for r in bad_json_lines(df).collect()] == [12]
    with pytest.raises(KeyError):
        validate(df, "Nothing")


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(but() + "\n\n" + but(pubmed_id="2") + "\n")
    (tmp_path / "b.jsonl").write_text(but(pubmed_id="1", disease="MCTD") + "\n")
    paths = [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")]
    assert files.read_jsonl(spark, paths, CASE_REPORT).count() == 3
    rows = files.read_jsonl_in_order(spark, paths, CASE_REPORT).orderBy("file_no", "line_no").collect()
    assert [(r["file_no"], r["line_no"], r["pubmed_id"]) for r in rows] == [(0, 1, "1"), (0, 3, "2"), (1, 1, "1")]
    folder = str(tmp_path / "out")
    files.write_jsonl(files.read_jsonl(spark, paths[0], CASE_REPORT), folder)
    assert files.rewrite_jsonl(spark, folder, CASE_REPORT, lambda d: d.where("pubmed_id = '2'")).count() == 1
    (tmp_path / "c.csv").write_text('id,seq\n1,"[""a, b"", ""c""]"\n')
    assert files.read_csv(spark, str(tmp_path / "c.csv")).first()["seq"] == '["a, b", "c"]'
    left = spark.createDataFrame([("1",), ("9",)], "k string")
    right = spark.createDataFrame([("1", "x")], "k string, v string")
    assert files.lookup(left, right, "k", "v", "").count() == 2 and files.lookup(left, right, "k", "v").count() == 1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(but(abstract="She was initially diagnosed with tuberculous pleurisy, then worsened.") + "\n")
    write_stream(stream_reports(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["evidence_level"] == "high"


def test_nested_records_are_validated(spark):
    figure = {"pubmed_id": "1", "figure_index": 0, "file_path": "a.jpg", "extracted_at": "2026-01-01T00:00:00Z"}
    whole = {"pubmed_id": "1", "disease": "SLE", "case_report": GOOD, "figures": [figure], "merged_at": "2026-01-01T00:00:00Z"}
    cases = [(whole, []), ({**whole, "case_report": None, "figures": []}, []), ({**whole, "case_report": {**GOOD, "pubmed_id": 7}}, ["case_report.pubmed_id:wrong_type"]),
             ({**whole, "figures": [figure, {"x": 1}]}, [f"figures[1].{f}:missing" for f in ("pubmed_id", "figure_index", "file_path", "extracted_at")]),
             ({**whole, "case_report": 5, "figures": 5}, ["case_report:wrong_type", "figures:wrong_type"]), ({**whole, "figures": None}, ["figures:null"]),
             ({**whole, "figures": [{**figure, "caption": None}]}, ["figures[0].caption:null"])]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)], "line_no int, value string")
    got = {r["line_no"]: [f"{e['field']}:{e['code']}" for e in r["errors"]] for r in validate(df, "MergedRecord").collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_jobs_end_to_end(spark, tmp_path):
    from casetrail import cli

    text = "She was initially diagnosed with tuberculous pleurisy, then worsened."
    files.write_jsonl(spark.read.schema(CASE_REPORT).json(spark.sparkContext.parallelize([but(abstract=text), but(pubmed_id="2")])), str(tmp_path / "cases"))
    figure = {"pubmed_id": "3", "figure_index": 0, "file_path": "a.jpg", "extracted_at": "2026-01-01T00:00:00Z"}
    (tmp_path / "figures.jsonl").write_text(json.dumps(figure) + "\n")
    (tmp_path / "labels.csv").write_text("pubmed_id,has_misdiagnosis,true_wrong_diagnosis,rationale,review_status\n1,1,x,,\n2,1,,,\n9,0,,,\n")
    done = cli.run(spark, str(tmp_path / "cases"), str(tmp_path / "figures.jsonl"), str(tmp_path / "labels.csv"), str(tmp_path / "merged"))
    assert (done["before"], done["after"], done["levels"]["n_high"], done["levels"]["examples"]["high"]) == (0, 0, 1, ["1"])
    assert (done["score"]["tp"], done["score"]["fn"], done["score"]["fn_ids"]) == (1, 1, ["2"])
    assert sorted(r["pubmed_id"] for r in spark.read.json(str(tmp_path / "merged")).collect()) == ["1", "2", "3"]
    assert cli.check(spark, str(tmp_path / "merged"), "MergedRecord") == 0 and cli.check(spark, "/nowhere", "CaseReport") == 2 and cli.check(spark, "/nowhere", "CaseReport", True) == 0
    (tmp_path / "other.csv").write_text("pubmed_id,has_misdiagnosis,true_wrong_diagnosis,rationale,review_status\n77,1,x,,\n")
    assert cli.score(spark, [str(tmp_path / "cases")], str(tmp_path / "other.csv")) is None
    assert not (tmp_path / "cases.old").exists() and not (tmp_path / "cases.new").exists()


def test_crosswalk_takes_the_first_link(spark):
    rows = spark.createDataFrame([("1",), ("2",)], "pubmed_id string")
    links = spark.createDataFrame([("1", 1, "9"), ("1", 2, "10")], "pubmed_id string, link_no int, pmc_number string")
    assert {(r[0], r[1]) for r in files.resolve_ids(rows, links).collect()} == {("1", "PMC9"), ("2", None)}
