"""Freely typed values mapped to the entries of a reference list.

A multi-pattern automaton over the list's names and aliases finds every mention embedded in a value;
the longest non-overlapping mentions win. Values without a mention go to token-set similarity: each word
of an entry must find its word in the value, in any order, misspelt or cut short, and what is left over
must be remarks. Typed values are first reduced to distinct ones, so one that a third of all rows hold is
resolved once; the results are joined back by value.

Aliases follow from the list itself: plurals, the words of a name turned round, and initials where one
entry alone has them. Defined results: null and blank values give no row; mentions of two different
entries, and ties between entries, are unmatched ("none"); the reference list may be empty.
The lists are read by the driver, up to MAX_TERMS entries, and broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from casetrail.llm.fold import bare
from casetrail.llm.skew import join_by_size
from casetrail.session import cut, ship

MAX_TERMS = 100_000
#: Words of remarks and doubt, which neither make nor hinder a match.
REMARKS = frozenset("""possible possibly poss probable probably prob presumed presumably suspected suspect likely query
queried question old new recent previous previously prior past history hx h o of r rule out ruled dx diagnosis diagnosed
nos per gp seen abroad the a an and with in on at by for from is was as to type unspecified known  confirmed
unconfirmed ?""".split())
_SPLIT = re.compile(r"[\s_\-–—/,;:()\[\]{}\"“”«»?!*+=|<>#&]+")
NONE = "none"


def words_of(value: str) -> list[tuple[str, bool]]:
    """(word, is cut short by a full stop) of a value, folded."""
    out = []
    for w in _SPLIT.split(bare(value)):
        short = len(w) > 2 and w.endswith(".") and "." not in w[:-1]
        w = w.strip(".'’`")
        w = w.replace("'s", "").replace("’s", "").replace("'", "").replace("’", "")
        if w:
            out.append((w, short))
    return out


@lru_cache(50_000)
def _masks(word: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(word):
        out[c] = out.get(c, 0) | 1 << i
    return out


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, or most + 1 where it is beyond. Bit-parallel: a column
    of the table is two integers, so a pair costs one step per letter of ``a``."""
    n = len(b)
    if abs(len(a) - n) > most:
        return most + 1
    if not n:
        return len(a)
    get, full, last = _masks(b).get, (1 << n) - 1, 1 << n - 1
    up, down, diagonal, before, score = full, 0, 0, 0, n
    for c in a:
        here = get(c, 0)
        swap = ((full & ~diagonal & here) << 1) & before
        diagonal = (((here & up) + up) ^ up) | here | down | swap
        right, left = down | full & ~(diagonal | up), diagonal & up
        if right & last:
            score += 1
        if left & last:
            score -= 1
        right = right << 1 | 1
        up, down, before = full & (left << 1 | ~(diagonal | right)), full & right & diagonal, here
    return score if score <= most else most + 1


def allowed(word: str) -> int:
    """Edits that a word of the list may differ by: none in short words and those with digits."""
    if any(c.isdigit() for c in word):
        return 0
    return (0 if len(word) < 3 else 1 if len(word) <= 5 else 2 if len(word) <= 8 else 3 if len(word) <= 11 else 4)


def sounded(word: str) -> str:
    """A spelling by sound: variants such as ph and f, y and i, k and c, or doubled letters fall together."""
    for a, b in (("ph", "f"), ("th", "t"), ("rh", "r"), ("ch", "c"), ("sch", "sc"), ("ae", "e"), ("oe", "e"), ("y", "i"), ("k", "c"), ("z", "s")):
        word = word.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", word)


def letter_counts(text: str) -> list[int]:
    out = [0] * 37
    for c in text:
        out[ord(c) - 97 if "a" <= c <= "z" else 26 + int(c) if c in "0123456789" else 36] += 1
    return out


def plurals(word: str) -> set[str]:
    out = {word + "s", word + "es"}
    if word.endswith("is"):
        out.add(word[:-2] + "es")
    if word.endswith("y"):
        out.add(word[:-1] + "ies")
    return out


class Matcher:
    """Resolves values against one list of (term_id, term_name)."""

    def __init__(self, terms: list[tuple[str, str]]):
        terms = [(i, n) for i, n in terms if words_of(n)]
        self.terms = [(i, [w for w, _ in words_of(n)]) for i, n in terms]
        self.spaced = [[w.replace("-", "") for w in bare(n).split()] for _, n in terms]
        self.content = [[x for x in w if x not in REMARKS] or w for _, w in self.terms]
        self.joined = ["".join(w) for _, w in self.terms]
        self.counts = np.array([letter_counts(j) for j in self.joined]).reshape(-1, 37)
        aliases: dict[str, set[int]] = {}
        initials: dict[str, set[int]] = {}
        for k, (_, w) in enumerate(self.terms):
            for v in ([*w], *([*w[:-1], p] for p in plurals(w[-1])), [*w[1:], w[0]], [w[-1], *w[:-1]]):
                aliases.setdefault(" ".join(v), set()).add(k)
            if len(w) > 1:
                initials.setdefault("".join(x[0] for x in w), set()).add(k)
        self.initials = {a: next(iter(ks)) for a, ks in initials.items() if len(ks) == 1}
        self.automaton = ahocorasick.Automaton()
        for a, ks in aliases.items():
            if len(ks) == 1:
                self.automaton.add_word(f" {a} ", (len(a), next(iter(ks))))
        if aliases:
            self.automaton.make_automaton()
        self.vocabulary: dict[str, list[int]] = {}
        for k, (_, w) in enumerate(self.terms):
            for x in dict.fromkeys(w):
                self.vocabulary.setdefault(x, []).append(k)
        self.by_length: dict[int, list[tuple[str, frozenset[str], str, frozenset[str], int]]] = {}
        for x in self.vocabulary:
            self.by_length.setdefault(len(x), []).append(
                (x, frozenset(x), sounded(x), frozenset(sounded(x)), allowed(x)))
        self.near = lru_cache(200_000)(self._near)

    def mentions(self, text: str) -> set[int]:
        """Entries mentioned in a value of single-spaced words, longest first, without overlaps."""
        if not self.terms:
            return set()
        hits = sorted(((n, -(end - n), end, k) for end, (n, k) in self.automaton.iter(f" {text} ")), reverse=True)
        taken: list[tuple[int, int]] = []
        out = set()
        for n, _, end, k in hits:
            a, b = end - n, end
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                out.add(k)
        return out

    def _near(self, word: str, short: bool) -> tuple[tuple[str, float], ...]:
        """Words of the list that a typed word may stand for, with their similarity."""
        if word in self.vocabulary and not short:
            return ((word, 1.0),)
        best: dict[str, float] = {}
        if short and len(word) >= 3:
            most = 0 if len(word) < 5 else 1 if len(word) < 7 else 2
            for x in self.vocabulary:
                if len(x) > len(word) and (x[0] == word[0] or x[1] == word[1]):
                    d = min(distance(x[:n], word, most) for n in {len(word), min(len(x), len(word) + 1)})
                    if d <= most:
                        best[x] = 0.95 - 0.1 * d
        forms = [(word, 0.0)] + [(word[:-len(e)], 0.3) for e in ("s", "es", "ses", "eses") if word.endswith(e) and len(word) > len(e) + 3]
        for form, extra in forms:
            letters, heard = frozenset(form), sounded(form)
            heard_letters = frozenset(heard)
            for n in range(max(1, len(form) - 4), len(form) + 5):
                for x, own, x_heard, own_heard, most in self.by_length.get(n, ()):
                    if abs(n - len(form)) > most:
                        continue
                    d = 9.0
                    if len(own - letters) <= most and len(letters - own) <= most:
                        got = distance(form, x, most)
                        d = got if got <= most else d
                    if d > 1 and most and len(own_heard - heard_letters) <= most and len(heard_letters - own_heard) <= most:
                        got = distance(heard, x_heard, most)
                        d = min(d, got + 0.5) if got <= most else d
                    if d < 9:
                        best[x] = max(best.get(x, 0.0), 1 - (d + extra) / max(len(x), len(form)))
        return tuple(sorted(best.items(), key=lambda p: (-p[1], p[0])))

    def similar(self, words: list[tuple[str, bool]]) -> int | None:
        """The entry whose set of words the value's words cover best, or None."""
        spelled = [(w, s) for w, s in words if w not in REMARKS]
        if not spelled:
            return None
        close = [self.near(w, s) for w, s in spelled]
        candidates = {k for c in close for x, _ in c for k in self.vocabulary[x]}
        scored = []
        for k in candidates:
            own = self.content[k]
            options = sorted(((s, i, j) for i, c in enumerate(close) for x, s in c for j, y in enumerate(own) if x == y),
                             key=lambda o: (-o[0], o[1], o[2]))
            used, met, total = set(), set(), 0.0
            for s, i, j in options:
                if i not in used and j not in met:
                    used.add(i)
                    met.add(j)
                    total += s * len(own[j])
            if len(met) < len(own):
                continue
            whole = sum(map(len, own))
            extra = len(spelled) - len(used)
            scored.append((total / whole - 0.04 * extra, k))
        if not scored:
            return None
        scored.sort(reverse=True)
        if scored[0][0] < 0.68 or (len(scored) > 1 and scored[0][0] - scored[1][0] < 1e-9):
            return None
        return scored[0][1]

    def resolve(self, value: str) -> str:
        words = words_of(value)
        plain = [w for w, _ in words]
        found = self.mentions(" ".join(plain))
        if len(found) == 1:
            return self.terms[found.pop()][0]
        if found:
            return NONE
        spelled = [w for w in plain if w not in REMARKS]
        for form in (spelled, ["".join(_SPLIT.sub("", bare(value)).split("."))]):
            joined = "".join(form)
            if len(form) == 1 and joined in self.initials and len(joined) > 1:
                return self.terms[self.initials[joined]][0]
        dotted = "".join(w.replace(".", "") for w in spelled)
        if spelled and all(len(w.replace(".", "")) <= 1 or "." in w for w in spelled) and dotted in self.initials:
            return self.terms[self.initials[dotted]][0]
        if (k := self.similar(words)) is None:
            k = self.run_together(spelled)
        if k is None and any(short for _, short in words):
            k = self.cut_short(value)
        return NONE if k is None else self.terms[k][0]

    def run_together(self, words: list[str]) -> int | None:
        """The entry whose letters, blanks aside, are those of the value but for a few."""
        typed = "".join(words)
        if len(typed) < 6 or not self.terms:
            return None
        apart = self.counts - np.array(letter_counts(typed))
        same_digits = (apart[:, 26:36] == 0).all(axis=1)
        gap = np.maximum(np.maximum(apart, 0).sum(axis=1), np.maximum(-apart, 0).sum(axis=1))
        scored = []
        for k in np.flatnonzero(same_digits & (gap <= 1 + 0.26 * max(len(typed), 1))):
            most = int(0.26 * max(len(typed), len(self.joined[k])))
            d = distance(typed, self.joined[k], most)
            if d <= most:
                scored.append((d / max(len(typed), len(self.joined[k])), int(k)))
        scored.sort()
        if not scored or (len(scored) > 1 and scored[1][0] == scored[0][0]):
            return None
        return scored[0][1]

    def cut_short(self, value: str) -> int | None:
        """The one entry whose blank-separated words the value has in order, some cut short by a full stop."""
        typed = [(w.rstrip(".").replace("-", ""), w.endswith(".")) for w in bare(value).replace("_", " ").split()]
        typed = [(w, s) for w, s in typed if w and w not in REMARKS and re.search(r"\w", w)]
        hits = []
        for k, name in enumerate(self.spaced):
            if len(name) == len(typed) and all(
                    x.startswith(w) if s else distance(w, x, 2) <= min(2, len(x) // 4) for (w, s), x in zip(typed, name)):
                hits.append(k)
        return hits[0] if len(hits) == 1 else None


def read_terms(terms: DataFrame, id_col: str, name_col: str) -> list[tuple[str, str]]:
    rows = terms.select(id_col, name_col).where(F.col(name_col).isNotNull()).orderBy(id_col).limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"a reference list of over {MAX_TERMS} entries")
    return [(r[0], r[1]) for r in rows]


def resolve_values(values: DataFrame, lists: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """(list_name, value, n, term_id) of distinct (list_name, value, n)."""
    spark = values.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(lists)
    schema = StructType([*[StructField(c, StringType()) for c in ("list_name", "value")], StructField("n", LongType()), StructField("term_id", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers: dict[str, Matcher] = {}
        for batch in batches:
            names, texts, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for name, text in zip(names, texts):
                if name not in matchers:
                    matchers[name] = Matcher(shared.value[name])
                out.append(matchers[name].resolve(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.string())], names=schema.names)

    return values.select("list_name", "value", "n").mapInArrow(run, schema)


def map_values(items: DataFrame, lists: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """``items`` (field_name, list_name, row_id, item_no, value) with term_id; blank values drop out.
    Each distinct value is resolved once; a value that many rows have is joined back without a shuffle of these rows."""
    items = items.where(F.col("value").isNotNull() & (F.regexp_replace("value", r"(?U)[\s\p{Cf}]+", "") != ""))
    # an explicit number of partitions, as these few bytes cost much time each and would be put together
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = items.groupBy("list_name", "value").agg(F.count("*").alias("n")).repartition(tasks, "value")
    return join_by_size(items, cut(resolve_values(distinct, lists)), ["list_name", "value"], "n").drop("n")
