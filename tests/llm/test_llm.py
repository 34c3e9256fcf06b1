import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casetrail.llm import canonical, encode, fold, history, lookalike, packing, repetition, scanned, segments

FORMS = [("Ｆigure １", "Figure 1"), ("сell", "cell"), ("ce​ll­", "cell"), ("é", "é"), ("a b", "a b"), ("ﬁbre", "fibre"),
         ("x² α", "x² α"), ("D‑dimer", "D-dimer"), (" pad ", "pad"), ("a\r\nb", "a\nb"), ("", ""), (None, None), ("  ", ""), ("е́", "é")]


def test_p1_forms(spark):
    df = spark.createDataFrame([(i, a, "x") for i, (a, _) in enumerate(FORMS)], "k long, t string, look string")
    got = {r["k"]: r["t"] for r in lookalike.canonicalize(df, "k", ["t"]).collect()}
    assert got == {i: b for i, (_, b) in enumerate(FORMS)}
    for a, b in FORMS:
        if a is not None:
            assert fold.fold(a).replace("\r\n", "\n").strip() == b


def test_p1_pairs_against_brute_force(spark):
    r = random.Random(3)
    base = ["cell", "Cell", "cells", "c e", "x2", "x²"]
    swap = {"c": "с", "e": "ｅ", "l": "l​", " ": " "}
    rows = [(i, "".join(swap.get(c, c) if r.random() < 0.2 else c for c in r.choice(base))) for i in range(120)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "k long, t string")
    got = {(x["row_id_a"], x["row_id_b"]) for x in lookalike.equal_looking({"t": lookalike.forms(df, "k", ["t"])}).collect()}
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x and y and x != y and fold.fold(x) == fold.fold(y)}
    assert got == want
    assert lookalike.equal_looking({"t": lookalike.forms(df.limit(0), "k", ["t"])}).count() == 0


def test_p1_hot_look(spark, monkeypatch):
    """A look that a third of all rows have, spread over salts: the same pairs."""
    monkeypatch.setattr(lookalike, "SALT_ROWS", 7)
    rows = [(i, "cell") for i in range(40)] + [(100 + i, "c\u0435ll") for i in range(3)] + [(200 + i, f"other {i}") for i in range(80)] + [(300, "other\u00a01")]
    df = spark.createDataFrame(rows, "k long, t string")
    got = [(x["row_id_a"], x["row_id_b"]) for x in lookalike.equal_looking({"t": lookalike.forms(df, "k", ["t"])}).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, 100 + b) for a in range(40) for b in range(3)} | {(201, 300)}


def test_p1_unseen_characters(spark):
    """Code points written out here, not taken from the operator's tables."""
    cases = {"a\u3164b": "ab", "a\uffa0b": "ab", "a\U000e0101b": "ab", "a\U000e0001b": "ab", "a\u200db": "ab", "a\ufe0fb": "ab", "a\u2060b": "ab", "\u051apex": "Qpex",
             "\u04c0gG": "IgG", "c\u0585re": "core", "\uff21\uff22\uff23": "ABC", "fi\u00adbre": "fibre", "a\u3000b": "a b", "\u00e9": "e\u0301", "\u03b1": "\u03b1"}
    df = spark.createDataFrame([(i, a) for i, a in enumerate(cases)], "k long, t string")
    got = {r["k"]: r["t"] for r in lookalike.canonicalize(df, "k", ["t"]).collect()}
    import unicodedata
    for i, (a, b) in enumerate(cases.items()):
        assert got[i] == unicodedata.normalize("NFC", b) == fold.fold(a), ascii(a)


def test_p3_repair(spark):
    words = "biopsy of the renal cortex showed plasma cells and drug-related change without severe overlapping rash in wrists".split()
    r = random.Random(1)
    clean = [" ".join(r.choice(words) for _ in range(14)) + "." for _ in range(300)]
    several = [c[:20].rsplit(" ", 1)[0] + "\nATLAS OF CASES, VOL. 9\n" + c[20:].split(" ", 1)[-1] for c in clean[:40]]
    cases = [("plasma cells and over-\nlapping rash", ["hyphenation"]), ("B1opsy of the renal cortex", ["misread"]), ("renal cortex drug-\nrelated change", []),
             ("plasma cells\nPage 3 of 9\nand rash", ["running_text"]), ("plasma ce11s and over¬\n12\nlapping rash", ["hyphenation", "misread", "running_text"]),
             ("plasma cells\nand rash", []), ("Figure 1.", []), ("", []), (None, []), ("severe over- lapping rash", ["hyphenation"])]
    texts = clean + several + [c[0] for c in cases]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {x["k"]: x for x in scanned.repair(df, "k", "t").collect()}
    n = len(clean) + len(several)
    assert [list(got[n + i]["damage"]) for i in range(len(cases))] == [c[1] for c in cases]
    assert got[n]["repaired"] == "plasma cells and overlapping rash" and got[n + 1]["repaired"] == "Biopsy of the renal cortex"
    assert got[n + 5]["repaired"] == "plasma cells\nand rash" and got[n + 8]["repaired"] is None
    assert all(not got[i]["damage"] for i in range(len(clean))) and all(got[len(clean) + i]["damage"] == ["running_text"] for i in range(len(several)))
    assert scanned.repair(df.limit(0), "k", "t").count() == 0


def test_p3_trie_against_brute_force():
    r = random.Random(2)
    vocabulary = {"".join(r.choice("climnorh") for _ in range(r.randint(2, 5))) for _ in range(200)}
    trie = scanned.Trie(dict.fromkeys(vocabulary, 9))
    for w in sorted(vocabulary)[:60]:
        for a, b in scanned.CONFUSED:
            at = w.find(a)
            if at >= 0:
                assert trie.search(w[:at] + b + w[at + len(a):], 1, 0)[w][0] <= 1
        assert trie.search(w, 0, 0) == {w: (0, 0, 9)}


def test_p3_automaton_gives_every_word_within_the_distance():
    """Any letter put in, left out or changed: the trie's answer equals the edit distance to every word."""
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    r = random.Random(12)
    vocabulary = {"".join(r.choice("xyzpqr") for _ in range(r.randint(2, 7))): r.randint(1, 50) for _ in range(400)}  # no confused shapes
    trie = scanned.Trie(vocabulary)
    for _ in range(60):
        w = "".join(r.choice("xyzpqrs") for _ in range(r.randint(2, 7)))
        for most, floor in ((1, 0), (2, 0), (2, 25)):
            want = {v: distance(w, v) for v, n in vocabulary.items() if n >= floor and distance(w, v) <= most}
            got = trie.search(w, most, most, floor)
            assert {v: x[0] for v, x in got.items() if x[0] == x[1]} == {v: d for v, d in want.items() if got[v][0] == got[v][1]} and set(want) <= set(got)
    one = scanned.Trie({"biopsy": 9})
    assert all("biopsy" in one.search(w, 3, 1) for w in ("bxopsy", "bopsy", "biopsyy", "b1opsy", "bi0psv"))


def test_p3_headers_of_many_journals(spark):
    """Headers of journals far below 1/150 of the captions go, one large journal beside them or not; recurring lines of sound text stay."""
    r = random.Random(6)
    words = "biopsy of the renal cortex showed plasma cells and change without severe overlapping rash wrists scalp lesion margin".split()
    text = lambda: " ".join(r.choice(words) for _ in range(6))
    name = lambda i: "".join("bdfgkmpz"[int(c)] + "aeo"[int(c) % 3] for c in f"{i:03o}")
    texts, want = [text() for _ in range(2000)], {}
    for i in range(1500):
        want[len(texts)] = i % 3 == 0
        texts.append(f"{text()}\n{'Great Journal, p. 7' if i % 3 == 0 else 'renal cortex showed'}\n{text()}")
    for journal in range(60):
        for j in range(5):
            want[len(texts)] = True
            head = f"Acta {name(journal)} {name(journal + 100)} {journal}"
            texts.append(f"{head}\n{text()}\n{text()}" if j % 2 else f"{text()}\n{head}\n{text()}")
    odd = text() + "\nunheard of wording\n" + text()  # one caption, extracted five times
    for _ in range(5):
        want[len(texts)] = False
        texts.append(odd)
    texts[:500] = [f"{t} renal cortex showed {t}" for t in texts[:500]]
    # the sound recurring line must not reach the share itself
    keep = [i for i in range(len(texts)) if want.get(i) is not False or i % 300 == 1 or i >= len(texts) - 5]
    df = spark.createDataFrame([(i, texts[i]) for i in keep], "k long, t string")
    got = {x["k"]: "running_text" in x["damage"] for x in scanned.repair(df, "k", "t").collect()}
    wrong = [texts[i] for i in keep if i in want and got[i] != want[i]]
    assert not wrong, wrong[:5]


def test_p3_rare_words(spark):
    """Words under a share of 1/20,000 of many texts, and under four in few, count as often as they occur."""
    common = ["the patient wore a support stocking"] * 160_000
    rare = ["a purple nodule"] * 4 + ["skin of the nodule"] * 3  # seven times 'nodule'
    cases = ["seen a n0dule", "seen a nod-\nule"]
    bands = ["a tight band here"] * 4 + ["her swollen hand now"] * 20  # ratio 5: 'band' is sound
    texts = common + rare + cases + bands
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").repartition(4)
    got = {x["k"]: list(x["damage"]) for x in scanned.repair(df, "k", "t").where("k >= 160000").collect()}
    n = len(common) + len(rare)
    assert got[n] == ["misread"] and got[n + 1] == ["hyphenation"]
    assert not any(got[i] for i in range(len(common), n)) and not any(got[i] for i in range(n + 2, len(texts)))


def _greedy(rows):
    key = lambda p: (("".join(c for c in p if c.isdigit())).lstrip("0") or "0") if p and any(c.isdigit() for c in p) else None
    codes = history._Codes()
    text = {i: np.array([codes[w] for w in history.content_words(t)], np.int64) if t and len(t) >= 30 else np.empty(0, np.int64) for i, _, _, t in rows}
    kept, pairs = [], set()
    for i, b, p, t in sorted(rows, key=lambda x: (x[1], x[0])):
        hits = {j for j, q in kept if (key(p) and key(p) == key(q)) or (len(text[i]) and len(text[j]) and history.same_but_for_small_changes(text[i], text[j]))}
        pairs |= {(j, i) for j in hits}
        if not hits:
            kept.append((i, p))
    return pairs


def test_p4_against_brute_force(spark):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    texts = [[r.choice(vocabulary) for _ in range(r.choice([8, 25, 60, 90]))] for _ in range(25)]
    rows = []
    for i in range(160):
        w = list(r.choice(texts))
        for _ in range(int(r.choice([0, 0.03, 0.08, 0.12, 0.4]) * len(w))):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        t = r.choice([None, "", "short", "No abstract."]) if r.random() < 0.1 else " ".join(w).upper() if r.random() < 0.2 else ", ".join(w)
        rows.append((i, r.randint(1, 5), r.choice([None, "x", f"00{r.randint(1, 60)}", str(r.randint(1, 60))]), t))
    df = spark.createDataFrame(rows, "id long, b int, p string, t string")
    got = {tuple(x) for x in history.repeats(df, "id", "b", "p", "t")[1].collect()}
    assert got == _greedy(rows)
    assert history.repeats(df.limit(0), "id", "b", "p", "t")[1].count() == 0


def test_p4_share_of_all_words(spark):
    """Against a brute force of the stated rule: five sixths of all the shorter one's words, changes on content words too."""
    r = random.Random(11)
    vocabulary = ["".join(r.choice("klmnopqrst") for _ in range(6)) for _ in range(900)]
    small = "the of and with was in to a".split()
    rows, plain = [], {}
    for base in range(40):
        w = [r.choice(small) if r.random() < 0.3 else r.choice(vocabulary) for _ in range(r.choice([30, 60, 100, 145]))]
        content = [i for i, x in enumerate(w) if x not in small]
        for share in (0, 0.12, 0.15, 1 / 6, 0.2):
            v = list(w)
            for i in r.sample(content, min(len(content), int(share * len(w) + 1e-9))):
                v[i] = f"x{r.randrange(10**9)}"
            rows.append((len(rows), 1, None, " ".join(v)))
        rows.append((len(rows), 1, None, " ".join([r.choice(vocabulary) for _ in range(len(w) // 4)] + w)))  # a sentence before it
    for i, _, _, t in rows:
        plain[i] = Counter(re.findall(r"\w+", t.lower()))
    kept, want = [], set()
    for i in plain:
        hits = {j for j in kept if 6 * (plain[i] & plain[j]).total() >= 5 * min(plain[i].total(), plain[j].total())}
        want |= {(j, i) for j in hits}
        if not hits:
            kept.append(i)
    df = spark.createDataFrame(rows, "id long, b int, p string, t string")
    assert {tuple(x) for x in history.repeats(df, "id", "b", "p", "t")[1].collect()} == want


def test_p4_kept_index(spark, tmp_path):
    """Batch after batch into an index that is opened anew each time gives what all at once gives, and a batch reads no rows of
    those before it. Words put in front, moved sentences and scattered changes up to a sixth, measured."""
    r = random.Random(21)
    vocabulary = ["".join(r.choice("bcdfglmnprst") for _ in range(6)) for _ in range(3000)]
    rows, plain, kinds = [], {}, {}
    for base in range(60):
        w = [r.choice(vocabulary) for _ in range(r.choice([24, 60, 75, 100, 145]))]
        third = len(w) // 3
        for kind in ("first", "front", "moved", "changed", "lacking"):
            v = list(w)
            if kind == "front":
                v = [r.choice(vocabulary) for _ in range(len(w) // 4)] + v
            elif kind == "moved":
                v = v[-third:] + v[:-third]
            elif kind == "changed":
                for i in r.sample(range(len(v)), len(v) // 6):
                    v[i] = f"x{r.randrange(10**9)}"
            elif kind == "lacking":
                v = v[:-len(v) // 5]
            kinds[len(rows)] = kind
            plain[len(rows)] = Counter(v)
            rows.append((len(rows), 1 + len(rows) % 5, None, " ".join(v)))
    order = sorted(rows, key=lambda x: (x[1], x[0]))
    kept, want = [], set()
    for i, _, _, _ in order:
        hits = {j for j in kept if 6 * (plain[i] & plain[j]).total() >= 5 * min(plain[i].total(), plain[j].total())}
        want |= {(j, i) for j in hits}
        if not hits:
            kept.append(i)
    df = spark.createDataFrame(rows, "id long, b int, p string, t string")
    whole = {tuple(x) for x in history.repeats(df, "id", "b", "p", "t")[1].collect()}
    assert len(whole & want) >= 0.98 * len(want) and not whole - want
    assert {x for x in want if kinds[x[1]] != "changed"} <= whole  # only scattered changes at the full sixth may be missed
    got = set()
    for batch in range(1, 4):
        df.where(f"b = {batch}").write.parquet(str(tmp_path / f"batch{batch}"))
        index = history.SegmentIndex(spark, str(tmp_path / "index"), buckets=2, bits=4)
        part = spark.read.parquet(str(tmp_path / f"batch{batch}"))
        got |= {tuple(x) for x in index.add(history.strings(part, "id", "b", "p", "t"))[1].collect()}
        index.drop()
        import shutil
        shutil.rmtree(tmp_path / f"batch{batch}")  # a later batch cannot read it
    until = {x[0] for x in rows if x[1] <= 3}
    assert got == {x for x in whole if x[0] in until and x[1] in until}


def test_p4_words_are_kept_once(spark, monkeypatch):
    """Beside the index's own table nothing that is written between the steps holds the words of the rows."""
    written = []
    monkeypatch.setattr(history, "cut", lambda df, cut=history.cut: (written.append(df.columns), cut(df))[1])
    texts = ["one " * 8 + "text of a row", "one " * 8 + "text of a row", "quite another text " * 4]
    df = spark.createDataFrame([(i, 1, None, t) for i, t in enumerate(texts)], "id long, b int, p string, t string")
    assert [tuple(x) for x in history.repeats(df, "id", "b", "p", "t")[1].collect()] == [(0, 1)]
    assert written and not [x for x in written if "words" in x]


def test_p4_few_pairs_are_verified(spark, monkeypatch, tmp_path):
    """Texts that share stock phrases but too few words are not held against each other word for word."""
    r = random.Random(5)
    stock = [f"stock{i}" for i in range(30)]  # as many segments as two copies have to share
    rows = [(i, 1, None, " ".join(stock + [f"w{r.randrange(5000)}" for _ in range(60)])) for i in range(7)]
    rows.append((7, 1, None, rows[0][3] + " end"))

    def counted(batches, inner=history._verify, at=str(tmp_path / "verified")):
        for b in batches:
            with open(at, "a") as f:
                f.write(f"{b.num_rows}\n")
            yield from inner(iter([b]))

    monkeypatch.setattr(history, "_verify", counted)
    df = spark.createDataFrame(rows, "id long, b int, p string, t string")
    assert [tuple(x) for x in history.repeats(df, "id", "b", "p", "t")[1].collect()] == [(0, 7)]
    assert sum(map(int, (tmp_path / "verified").read_text().split())) == 1


def test_p4_sketches():
    """Two texts that are the same but for small changes always pass; most others don't. Also with words that come very often."""
    r, told = random.Random(6), Counter()
    for size in (1, 2, 7, 30, 150, 1500, 6000):
        for _ in range(40):
            a = [r.choice([r.randrange(-2**63, 2**63), 7, 7 + 128, r.randrange(400)]) for _ in range(size)]
            b = [r.randrange(-2**63, 2**63) if r.random() < r.choice([0, 0.1, 0.2]) else x for x in a[:r.randrange(len(a) * 3 // 4, len(a)) + 1]]
            b = r.choice([b, b, [r.randrange(-2**63, 2**63) for _ in a], a + a])
            x, y = np.array(a, np.int64), np.array(b, np.int64)
            both = segments.sketches(np.r_[x, y], np.array([len(x), len(y)]))
            told[history.same_but_for_small_changes(x, y), bool(segments.enough_in_common(pa.array(both[:1]), pa.array(both[1:]))[0])] += 1
    assert told[True, True] > 50 and told[True, False] == 0 and told[False, False] > 0.8 * told[False, True] > 0
    assert segments.sketches(np.empty(0, np.int64), np.empty(0, np.int64)) == []


def test_p4_words_by_chunk():
    """The words of a text are those of its chunks between blanks, whatever characters stand beside a blank."""
    r, code, chunk = random.Random(3), history._Codes(), history._Chunks()
    for _ in range(5000):
        t = "".join(r.choice("ab1  .-_e\u0301\u00e9\u200b\u00a0\u0391\u03a3\u0130\ufb01\u3000\u0308\t\n\u00b4\u5929") for _ in range(r.randrange(90)))
        assert b"".join(chunk[x] for x in t.split(" ")) == np.array([code[w] for w in history.content_words(t)], np.int64).tobytes()


def test_p6_matching():
    m = canonical.Matcher([("1", "juvenile idiopathic arthritis"), ("2", "bullous pemphigoid"), ("3", "Q fever"), ("4", "rheumatic fever"),
                           ("5", "Reduced complement C3"), ("6", "Reduced complement C4"), ("7", "granulomatosis with polyangiitis")])
    for value, want in {"JIA": "1", "j.i.a.": "1", "pemphigoid, bullous": "2", "r/o Q fever (seen abroad)": "3", "hay fever": "none", "rheumtic fevr": "4",
                        "C4 reduced complement": "6", "reduced complemnt c3": "5", "juvenile idiopath. arthritis": "1", "bullouspemphigoid": "2",
                        "granulomatosis with poliangiitis": "7", "Q fever or rheumatic fever": "none", "fever": "none", "?": "none",
                        "Ｑ fеver": "3", "x " * 5000: "none"}.items():
        assert m.resolve(value) == want, value
    assert canonical.Matcher([]).resolve("anything") == "none"


def test_p6_join(spark):
    items = spark.createDataFrame([("f", "l", 1, 1, "q fever"), ("f", "l", 1, 2, " "), ("f", "l", 2, 1, None), ("f", "l", 3, 1, "q fever"), ("f", "l", 4, 1, "gout")],
                                  "field_name string, list_name string, row_id long, item_no int, value string")
    got = {(r["row_id"], r["term_id"]) for r in canonical.map_values(items, {"l": [("3", "Q fever")]}).collect()}
    assert got == {(1, "3"), (3, "3"), (4, "none")}


def test_p7_against_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    try:
        data = open(encode.VOCAB, "rb").read()
    except OSError:
        pytest.skip("no vocabulary file")
    ranks = encode.read_ranks(data)
    own, lib = encode.Encoder(ranks), tiktoken.Encoding("x", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
                                                        mergeable_ranks=ranks, special_tokens={})
    r = random.Random(7)
    texts = ["".join(r.choice("ab '’\n\t  é漢😀1") for _ in range(r.randint(0, 30))) for _ in range(2000)] + ["a" * 50000, "xyz" * 9000, "<|endoftext|>"]
    assert [own.encode(t) for t in texts] == [lib.encode_ordinary(t) for t in texts]
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "k long, text string")
    assert {x["k"]: list(x["ids"]) for x in encode.encode(df, "k", "text").collect()} == {1: [], 2: [], 3: lib.encode_ordinary("a b")}


def test_p7_rank_queue():
    q, r, want = encode.RankQueue(50_000), random.Random(1), {}
    for i in range(3000):
        k = r.randrange(50_000)
        q.push(k, i)
        want.setdefault(k, []).append(i)
    got = []
    while (x := q.pop()) is not None:
        got.append(x)
    assert got == sorted(want.items())


@pytest.mark.parametrize("capacity", [64, 512, 4096])
def test_p8_containers(spark, capacity):
    r = random.Random(capacity)
    rows = [(i, r.choice([0, None, 1, 5, 40, 300, 700, 5000, 5000]) if i % 3 else r.randint(1, 600)) for i in range(1500)]
    got = packing.pack(spark.createDataFrame(rows, "k long, n int"), "k", "n", capacity).collect()
    load, pieces = {}, {}
    for x in got:
        load[x["container_id"]] = load.get(x["container_id"], 0) + x["n_tokens"]
        pieces.setdefault(x["k"], []).append((x["piece_no"], x["start"], x["n_tokens"]))
    assert max(load.values()) <= capacity and len(pieces) == len(rows)
    for k, n in rows:
        own = sorted(pieces[k])
        assert sum(p[2] for p in own) == (n or 0) and (len(own) == 1 or n > capacity)
        assert [p[1] for p in own] == list(np.cumsum([0, *[p[2] for p in own]])[:-1])
    ideal = sum(n or 0 for _, n in rows) / capacity
    assert len([1 for v in load.values() if v]) <= 1.35 * ideal + 2
    assert packing.pack(spark.createDataFrame([], "k long, n int"), "k", "n", capacity).count() == 0


def test_p9_shares_against_brute_force(spark):
    def brute(t):
        w = repetition.words(t or "")
        seen, hit = set(), set()
        for i in range(len(w) - 4):
            g = tuple(w[i:i + 5])
            if g in seen:
                hit.update(range(i, i + 5))
            seen.add(g)
        return len(w), len(hit)

    r = random.Random(4)
    texts = [None, "", "  ", "one two three", "feet " * 50, "1. a b c d e\n2) A, b c d e!\n"] + [" ".join(r.choice("abc") for _ in range(r.randint(0, 60))) for _ in range(100)]
    n, k = repetition.shares(texts)
    assert list(zip(n.tolist(), k.tolist())) == [brute(t) for t in texts]
    df = spark.createDataFrame([(i, t, None if i % 4 == 0 else f"s{i % 3}") for i, t in enumerate(texts)], "k long, t string, source string")
    judged = repetition.judge(df, "k", "t", "source").collect()
    assert len(judged) == len(texts) and all(0 < x["shrunk_rate"] < 1 for x in judged)
    assert {x["k"] for x in judged if x["is_repetitive"]} == {i for i in range(len(texts)) if n[i] and k[i] / n[i] >= 1 / 3 - 1e-12}
    assert repetition.judge(df.limit(0), "k", "t", "source").count() == 0
