import math
import random
from datetime import datetime

from casetrail.operators import search
from casetrail.plans import queries


def test_search_of_a_query_set(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, [float(r.randint(-2, 2)) for _ in range(3)]) for i in range(260)] + [(300, None), (350, [0.0, 0.0, 0.0]), (351, [1.0, 2.0])]

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or not any(a) or not any(b):
            return 0.0
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))

    want = {}
    for q, v in rows:
        if q % 50 == 0:
            want[q] = sorted((-round(cosine(v, w), 9), i) for i, w in rows)[:10]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.nearest_vectors_of_queries(spark, str(tmp_path)).collect()
    assert {(x["query_id"], x["vec_id"]) for x in got} == {(q, i) for q, w in want.items() for _, i in w} and len(got) == 80
    df = spark.read.parquet(str(tmp_path / "embeddings.parquet"))
    small = search.top_k_of_queries(df, "vec_id", "embedding", df.where("vec_id % 50 = 0"), 10, size=7).collect()
    assert {(x["query_id"], x["vec_id"]) for x in small} == {(x["query_id"], x["vec_id"]) for x in got}


def test_every_report_is_validated(spark, tmp_path):
    good = ("1", "SLE", "t", "a", ["x"], datetime(2026, 1, 1))
    rows = [(0, *good), (5, *good), (3, *good)] + [(10 + i, *good[:i], None, *good[i + 1:]) for i in range(6)] + [(20, *[None] * 6)]
    spark.createDataFrame(rows, "report_id long, pubmed_id string, disease string, title string, abstract string, "
                                "misdiagnosis_sequence array<string>, extracted_at timestamp").write.parquet(str(tmp_path / "case_reports.parquet"))
    fields = ["pubmed_id", "disease", "title", "abstract", "misdiagnosis_sequence", "extracted_at"]
    got = {x["report_id"]: x["errors"] for x in queries.invalid_records(spark, str(tmp_path)).collect()}
    assert got == {0: "", 5: "", 3: "", **{10 + i: f"{f}:null" for i, f in enumerate(fields)}, 20: ",".join(f"{f}:null" for f in fields)}


def test_reports_without_disease_are_counted(spark, tmp_path):
    text = "She was initially diagnosed with tuberculosis."
    rows = [(1, "SLE", text), (2, "SLE", "x"), (3, None, text), (4, None, None), (5, "", "x")]
    spark.createDataFrame(rows, "report_id long, disease string, abstract string").write.parquet(str(tmp_path / "case_reports.parquet"))
    got = {(x["disease"], x["is_total"]): (x["n"], x["n_flagged"]) for x in queries.signal_by_disease(spark, str(tmp_path)).collect()}
    assert got == {("SLE", 0): (2, 1), (None, 0): (2, 1), ("", 0): (1, 0), (None, 1): (5, 2)}
