from pyspark.sql import functions as F

from casetrail.functions import figures
from casetrail.operators import evaluate, merge, overlay
from casetrail.sources.files import figures_of_xml, parse_articles


def test_caption_classes(spark):
    cases = {"Chest CT with contrast": "imaging", "Renal biopsy": "histology", "Time course of C3": "lab_chart", "Malar rash": "rash_image",
             "CT and biopsy": "imaging", "glomeruli": "other", "seen at 40×4": "histology", "at 40×10": "other", "": "other"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, "other")], "c string, want string")
    assert df.where(figures.classify_caption(F.col("c")) != F.col("want")).count() == 0


def test_versions_and_zero_shot(spark):
    df = spark.createDataFrame([("k", "P1.2/", 0), ("k", "P1.10/", 1), ("k", "P1/", 2)], "k string, p string, o int")
    assert figures.pick_version(df, "k", "p", "o").first()["p"] == "P1.10/"
    v = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],)], "v array<double>")
    got = v.select(figures.zero_shot(F.col("v"), [[1.0, 0.0], [0.0, 1.0]], ("a", "b")).alias("g")).collect()
    assert got[0]["g"]["label"] == "a" and got[0]["g"]["p"] > 0.99
    assert got[1]["g"]["label"] == "a" and abs(got[1]["g"]["p"] - 0.5) < 1e-9


def test_xml(spark):
    xml = """<article xmlns:xlink="u"><body><fig><label> Fig 1 </label><caption><title>Skin</title><p>a  <b>rash</b></p></caption>
             <graphic xlink:href="f1.jpg"/></fig></body></article>"""
    assert figures_of_xml(xml) == [("Fig 1", "Skin a rash", "f1.jpg")]
    inner = "<a><fig><label>Fig <b>2</b></label><caption>bare</caption></fig></a>"
    assert figures_of_xml(inner) == [("Fig", "", "")]  # a label's direct text, the texts of a caption's children
    assert figures_of_xml("<broken") == [] and figures_of_xml(None) == []
    df = spark.createDataFrame([("1", xml), ("2", "<broken"), ("3", None)], "id string, x string")
    rows = parse_articles(df, "id", "x").collect()
    assert [(r["id"], r["figure_count"], r["figures"][0]["figure_type"]) for r in rows] == [("1", 1, "rash_image")]


def test_merge(spark):
    cases = spark.createDataFrame([("1", 1, "SLE"), ("1", 2, ""), ("2", 3, "MCTD"), (None, 4, "x")], "k string, o int, disease string")
    figs = spark.createDataFrame([("1", 1, "A"), ("1", 0, "B"), ("3", 0, None)], "k string, n int, disease string")
    got = {r["k"]: r for r in merge.merge_records(cases, figs, "k", ["o"], ["n"]).collect()}
    assert set(got) == {"1", "2", "3"}
    assert got["1"]["disease"] == "" and [f["n"] for f in got["1"]["figures"]] == [0, 1] and got["1"]["case_report"]["o"] == 2
    short = {r["k"]: (r["disease"], r["has_case_report"], r["n_figures"], r["first"] and r["first"]["n"]) for r in merge.merged_summary(cases, figs, "k", ["o"], ["n"]).collect()}
    assert short == {k: (r["disease"], r["case_report"] is not None, len(r["figures"]), r["figures"][0]["n"] if r["figures"] else None) for k, r in got.items()}
    assert got["2"]["figures"] == [] and got["3"]["case_report"] is None and got["3"]["disease"] == ""


def test_confusion_and_overlay(spark):
    pairs = spark.createDataFrame([("a", True, True), ("b", True, False), ("c", False, False)], "k string, p boolean, t boolean")
    r = evaluate.confusion(pairs, "k", "p", "t", with_ids=True).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["precision"], r["fp_ids"]) == (1, 1, 0, 1, 0.5, ["b"])
    none = evaluate.confusion(pairs.limit(0), "k", "p", "t").first()
    assert none["precision"] == none["f1"] == none["accuracy"] == 0.0
    figs = spark.createDataFrame([(1, "unlabeled"), (2, None), (3, "rash_image")], "id int, figure_type string")
    choice = spark.createDataFrame([(1, "histology", False), (2, None, True), (3, "other", True)], "id int, new_type string, remove boolean")
    assert {tuple(r) for r in overlay.apply_decisions(figs, choice, ["id"]).collect()} == {(1, "histology"), (3, "rash_image")}
