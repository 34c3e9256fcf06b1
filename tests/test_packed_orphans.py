import datetime as dt

import numpy as np
import pytest

from casetrail.operators import orphans, packed

SPLITS = [
    ('lichen planus,"depression, postpartum"', ["lichen planus", "depression, postpartum"]),
    ("a; b, c; d", ["a", "b, c", "d"]), ("(1) x\n(2) y\n(3) z", ["x", "y", "z"]), ('["p","q/r"]', ["p", "q/r"]), ("['it''s', 'b']", ["it's", "b"]),
    ("a -> b -> a", ["a", "b", "a"]), ("a||b", ["a", "b"]), ("- a\n\n- b", ["a", "b"]), ("hand/foot rash / gout", ["hand/foot rash", "gout"]),
    ('"so-called ""growing"" pains" | x', ['so-called "growing" pains', "x"]), ("gout", ["gout"]), ("gout;", ["gout"]), ("", []), (None, []), ("  ", []),
    ("a followed by b", ["a", "b"]), ("a\tb", ["a", "b"]), ('"open, b', ['"open', "b"]),
]


@pytest.mark.parametrize("text,want", SPLITS)
def test_split(text, want):
    assert packed.split_values(text) == want


def test_long_and_clashing(spark):
    df = spark.createDataFrame([(1, "; ".join(["x"] * 20000), "?"), (2, None, "?"), (3, "a;b", "?")], "k long, f string, item string")
    got = packed.split_packed(df, "k", "f", at_least=2)
    assert got.where("k = 1").count() == 20000 and got.where("k = 3").count() == 2 and got.where("k = 2").count() == 0
    assert packed.split_packed(df.limit(0), "k", "f").count() == 0


def test_bitmap():
    r = np.random.default_rng(1)
    for n in (0, 10, 5000, 60000):
        a, b = np.unique(r.integers(0, 65536, n)), np.unique(r.integers(0, 65536, 30000))
        assert np.array_equal(orphans.Bitmap(a).and_not(orphans.Bitmap(b)).values(), np.setdiff1d(a, b))


def test_orphans_against_brute_force(spark):
    r = np.random.default_rng(2)
    day = dt.datetime(2026, 1, 1)
    when = lambda: day + dt.timedelta(days=int(r.integers(0, 120)))
    key = lambda: [None, "none", f"PMID 00{r.integers(1, 40)}", str(r.integers(1, 40))][r.choice(4, p=[.05, .05, .3, .6])]
    reports = [(key(), when()) for _ in range(60)]
    gone = [(key(), when()) for _ in range(15)]
    refs = [(i, "7" if i % 3 == 0 else key(), None if i % 50 == 9 else when()) for i in range(600)]
    num = lambda p: int("".join(c for c in p if c.isdigit())) if p and any(c.isdigit() for c in p) else None
    want = set()
    for i, p, at in refs:
        if num(p) is None:
            continue
        first = min([t for q, t in reports if num(q) == num(p)], default=None)
        end = min([t for q, t in gone if num(q) == num(p)], default=None)
        if first is None or (at is None and end is not None) or (at is not None and (at < first or (end is not None and at >= end))):
            want.add(i)
    p = orphans.parents(spark.createDataFrame(reports, "pubmed_id string, loaded_at timestamp"),
                        spark.createDataFrame(gone, "pubmed_id string, withdrawn_at timestamp"), "pubmed_id", "loaded_at", "withdrawn_at")
    f = spark.createDataFrame(refs, "id long, pubmed_id string, loaded_at timestamp")
    found = orphans.find_orphans(orphans.references({"t": (f, "id")}, "pubmed_id", "loaded_at"), p)
    assert {x["row_id"] for x in found.collect()} == want
    assert sum(x["n_orphans"] for x in orphans.orphan_counts(found).collect()) == len(want)
    assert orphans.find_orphans(orphans.references({"t": (f.limit(0), "id")}, "pubmed_id", "loaded_at"), p).count() == 0
