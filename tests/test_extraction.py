import pytest
from pyspark.sql import functions as F

from casetrail.functions.extraction import diagnostic_delay, extract

CASES = [
    ("She was initially diagnosed with tuberculous pleurisy, then worsened.", "SLE", ["tuberculous pleurisy"], "high"),
    ("The illness was misdiagnosed as viral hepatitis and then treated.", "SLE", ["viral hepatitis"], "high"),
    ("This disease was thought to have bacterial meningitis before review.", "SLE", ["bacterial meningitis"], "medium"),
    ("The rash had been misdiagnosed. Work-up showed nothing of note at all.", "SLE", [], "signal_only"),
    ("The illness had been misdiagnosed although leprosy was considered early.", "SLE", ["leprosy"], "gazetteer"),
    ("The illness had been misdiagnosed. Later on leprosy was considered too.", "SLE", [], "signal_only"),
    ("A quiet course without any trouble was seen over many long years.", "SLE", [], "none"),
    ("She was initially diagnosed with systemic lupus, then got worse again.", "SLE", [], "signal_only"),
    ("She was initially diagnosed with myeloma (stage two) and got worse.", "SLE", ["myeloma"], "high"),
    ("She was initially diagnosed with the patient history, which was long.", "SLE", [], "signal_only"),
    ("Il fut misdiagnosed as syndrome de Ménière, puis revu.", "SLE", ["syndrome de ménière"], "high"),
    ("She was initially diagnosed with tuberculous pleurisy, then worsened.", "", [], "signal_only"),
    ("too short", "SLE", [], "none"), (None, "SLE", [], "none"),
]


def test_levels(spark):
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)], "i int, a string, d string")
    got = {r["i"]: r["x"] for r in df.select("i", extract(F.col("a"), F.col("d")).alias("x")).collect()}
    for i, (_, _, entities, level) in enumerate(CASES):
        assert (list(got[i]["entities"]), got[i]["level"]) == (entities, level), CASES[i]


def test_no_python_and_no_shuffle(spark):
    df = spark.createDataFrame([("x", "y")], "a string, d string").select(extract(F.col("a"), F.col("d")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("text,days", [
    # a length of time alone is no delay: it has to stand beside words of delay or of the way to the diagnosis
    ("The diagnosis came after 3 weeks of pain.", 21), ("1 year", None), ("after 3 weeks of pain", None), ("no time", None), (None, None),
    ("A 45 years old woman was seen; the diagnosis came after 3 weeks.", 21), ("A 45-year-old man, aged 45 years, after 2 months was diagnosed.", 60),
    ("with a delay of about 2 years", 730), ("She had 14 days of fever before the diagnosis.", 14), ("Lasting 9 weeks. The diagnosis was gout.", None)])
def test_delay(spark, text, days):
    assert spark.createDataFrame([(text,)], "a string").select(diagnostic_delay(F.col("a"))).first()[0] == days
