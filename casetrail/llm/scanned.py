"""Texts from scanned pages made whole: broken words, misread characters, page furniture.

1. Words, neighbouring words and stand-alone lines are counted over all texts, with count 0 also those that only come to
   stand together when lines are joined.
2. Every distinct word meets the vocabulary: the Levenshtein automaton of the word (any letter substituted, inserted or
   deleted, and the merges and splits of shapes that scanning confuses) is intersected with the vocabulary's trie,
   which gives every vocabulary word within the bound. Branches without a word frequent enough are left out.
3. The texts are walked with this evidence: candidates are ranked by frequency, by how likely the misreading is (confused
   shapes cost less than other edits) and by the words beside them; halves are joined, page furniture goes, and the rest
   is reflowed into one paragraph. A word reached by other edits than confused shapes counts only if both
   neighbours speak for it and it occurs nowhere else.

What is broadcast are the words and those pairs of neighbours that a misread word or what it may stand for is part of, all with their
true counts. Where that is more than BOUND entries, the texts are worked off in slices, each with the evidence its own
texts ask for; a vocabulary of more than BOUND words is met in shards. Rules mean the same at every number of texts.

Defined results: null stays null without damage; empty, blank and bare-label texts and texts without
damage come out unchanged, line breaks included; repeated rows are each repaired; texts are handled
whole. Look-alike characters are no damage.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from casetrail.llm.fold import fold
from casetrail.session import cut, ship, spread

#: A half of a word is a word of its own if it occurs so often.
MIN_COUNT = 4
#: A line is a running header if it stands alone in so many different texts and its words follow each other hardly anywhere else.
HEADER_COUNT = 4
ALONE = 0.75
#: A word is misread if a word it may stand for is at least so many times as frequent.
RATIO = 6
#: Edits of any kind, and other edits than confused shapes: the longer word allows the second only where one gives nothing.
MOST_EDITS, OTHER_EDITS, LONG_WORD = 3, 2, 8
BOUND = 5_000_000

HYPHENS = "-‐‑¬­"
LETTERS = r"[^\W\d_]"
#: A word as scanned: letters and what letters are misread as.
TOKEN = re.compile(r"(?:(?<![\w!])[@!|$](?=[^\W\d_]))?[^\W_]+(?:[@!|$€¢+](?=[^\W\d_])[^\W_]+|[@$+](?!\w)|[!|](?=\s[a-z]))*")
LABEL = re.compile(r"^\W*(?:fig(?:ure)?|image|plate|table)\b\.?\s*(?:\d+\s?[a-z]?)?\s*[.:]?\W*$", re.I)
PAGE = re.compile(r"^\W*(?:p(?:age|p|g)?\.?\s*)?\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?\W*$", re.I)
# Shapes that scanning confuses, right and read.
CONFUSED = (("i", "1"), ("l", "1"), ("i", "!"), ("l", "!"), ("l", "|"), ("i", "|"), ("o", "0"), ("a", "@"), ("s", "5"), ("s", "$"), ("g", "9"),
            ("b", "6"), ("b", "8"), ("z", "2"), ("e", "c"), ("c", "e"), ("m", "rn"), ("rn", "m"), ("n", "ri"), ("h", "li"), ("d", "cl"),
            ("cl", "d"), ("w", "vv"), ("u", "ii"), ("n", "u"), ("u", "n"), ("i", "l"), ("l", "i"), ("f", "t"), ("t", "f"), ("y", "v"), ("v", "y"),
            ("li", "h"), ("ri", "n"), ("o", "c"), ("a", "o"), ("o", "a"), ("e", "o"), ("h", "b"), ("b", "h"), ("m", "nn"), ("k", "lc"), ("g", "q"),
            ("q", "g"), ("t", "l"), ("l", "t"), ("i", "j"), ("e", "6"), ("t", "7"), ("a", "4"), ("e", "€"), ("c", "¢"), ("t", "+"))
_READ = sorted({r for _, r in CONFUSED}, key=len, reverse=True)
_RIGHT: dict[str, list[str]] = {}
for _a, _b in CONFUSED:
    _RIGHT.setdefault(_b, []).append(_a)


def tokens(text: str) -> list[str]:
    return ["#" if t.isdigit() else t.lower() for t in TOKEN.findall(text)]


def split_lines(text: str) -> list[str]:
    return re.split(r"\r\n|[\r\n\x0b\x0c\x85  ]", text)


def line_form(line: str) -> str:
    return re.sub(r"\d+", "9", re.sub(r"\s+", " ", fold(line))).strip().lower()


# ---- first pass -------------------------------------------------------------------------------

_COUNTS = StructType([StructField("kind", StringType()), StructField("item", StringType()), StructField("n", LongType())])


COMPOUND = re.compile(rf"{LETTERS}+(?:-{LETTERS}+)+")


def _words_of_piece(piece: str) -> tuple[list[str], list[str]]:
    """(words, compounds with their own hyphen) of a piece between blanks."""
    plain = fold(piece.replace("\xad", "¬"))
    return tokens(plain), [x.lower() for x in COMPOUND.findall(plain)] if "-" in plain else []


BROKEN = re.compile(rf"[{HYPHENS}]\s")


def _may_meet(text: str) -> Iterator[tuple[str, str]]:
    """Words and neighbours that stand together once a line between them goes or halves are joined."""
    lines = [p for x in split_lines(text.replace("\xad", "¬")) if (p := x.split())]
    heads = [tokens(fold(" ".join(p[:2]))) for p in lines]
    tails = [tokens(fold(" ".join(p[-2:]))) for p in lines]
    halved = [p[-1][-1] in HYPHENS for p in lines]
    pairs = [(tails[i], heads[i + 1], True) for i in range(len(lines) - 1) if halved[i]]  # others stand together as they are
    pairs += [(tails[i], heads[i + 2], halved[i]) for i in range(len(lines) - 2)]
    pairs += [(tokens(fold(" ".join(p[max(0, i - 1):i + 1]))), tokens(fold(" ".join(p[i + 1:i + 3]))), True)
              for p in lines for i, x in enumerate(p[:-1]) if x[-1] in HYPHENS]
    for left, right, half in pairs:
        if not left or not right:
            continue
        yield "pair", f"{left[-1]} {right[0]}"
        if half:
            whole = left[-1] + right[0]
            yield "word", whole
            if len(left) > 1:
                yield "pair", f"{left[-2]} {whole}"
            if len(right) > 1:
                yield "pair", f"{whole} {right[1]}"


def _joined(piece: str) -> Iterator[str]:
    """Neighbouring parts of a piece with hyphens, joined."""
    parts = [tokens(fold(x)) for x in re.split(rf"[{HYPHENS}]", piece)]
    for a, b in zip(parts, parts[1:]):
        if a and b:
            yield a[-1] + b[0]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    piece, pair, line = Counter(), Counter(), Counter()
    asked: set[tuple[str, str]] = set()

    def flush() -> Iterator[pa.RecordBatch]:
        word, beside, parts = Counter(), Counter(), {}
        for p, n in piece.items():
            parts[p] = found, compounds = _words_of_piece(p)
            for w in (*found, *compounds):
                word[w] += n
            for w in map(" ".join, zip(found, found[1:])):
                beside[w] += n
            if len(found) > 1:
                for w in _joined(p):
                    word[w] += 0
        for (a, b), n in pair.items():
            left, right = parts[a][0], parts[b][0]
            if left and right:
                beside[f"{left[-1]} {right[0]}"] += n
        for kind, x in asked:
            (word if kind == "word" else beside)[x] += 0
        for kind, c in (("word", word), ("pair", beside), ("line", line)):
            if c:
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(c)), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())],
                                                 names=_COUNTS.names)
        for c in (piece, pair, line, asked):
            c.clear()

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            if "\n" in text or "\r" in text:
                line.update(f for x in split_lines(text) if x.strip() and (f := line_form(x)) and not LABEL.match(x))
                asked.update(_may_meet(text))
            elif BROKEN.search(text):
                asked.update(_may_meet(text))
            pieces = text.split()
            piece.update(pieces)
            pair.update(zip(pieces, pieces[1:]))
        if len(piece) + len(pair) + len(line) + len(asked) > 300_000:
            yield from flush()
    yield from flush()


class Evidence:
    """What the whole corpus says about words, neighbours and lines, and what a misread word may stand for."""

    def __init__(self, words: dict[str, int], pairs: dict[str, int], headers: set[str], options: dict[str, tuple]):
        self.words, self.pairs, self.headers, self.options = words, pairs, headers, options


_OPTION = "word string, right string, n long, edits int, other int"


def _options(words: DataFrame) -> DataFrame:
    """(word, right, n, edits, other) for each of (item, n) that may be a misread word: the frequent enough words within
    the bound, how often they occur, and the edits, those beside confused shapes apart."""
    spark = words.sparkSession
    vocabulary = words.where((F.col("n") >= RATIO) & F.rlike("item", F.lit(rf"^\p{{L}}+$")))
    shards = max(1, math.ceil(vocabulary.count() / BOUND))
    out = None
    for shard in range(shards):
        part = vocabulary.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == shard).toArrow()  # at most BOUND words or so
        shared = spark.sparkContext.broadcast(dict(zip(part.column("item").to_pylist(), part.column("n").to_pylist())))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            trie = Trie(shared.value)
            for batch in batches:
                rows = [(word, *x) for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in may_stand_for(trie, word, n)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32()))],
                                                 names=["word", "right", "n", "edits", "other"])

        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        found = words.select("item", "n").repartition(tasks, "item").mapInArrow(run, _OPTION)
        out = found if out is None else out.unionByName(found)
    return out


def _headers(counts: DataFrame, df: DataFrame, text: str) -> set[str]:
    """Lines that recur in different texts and whose words hardly stand together elsewhere."""
    lines = counts.where((F.col("kind") == "line") & (F.col("n") >= HEADER_COUNT)).select("item", "n")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(line, n, *x) for line, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in _line_parts(line)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                                              pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.string())],
                                             names=["line", "n_line", "kind", "item"])

    asked = lines.mapInArrow(parts, "line string, n_line long, kind string, item string")
    least = (asked.join(counts, ["kind", "item"], "left").groupBy("line").agg(F.max("n_line").alias("n_line"), F.min(F.coalesce("n", F.lit(0))).alias("least")))
    alone = {r["line"] for r in least.where(F.col("n_line") >= F.lit(ALONE) * F.col("least")).select("line").collect()}
    return _in_different_texts(df, text, alone)


def _line_parts(line: str) -> Iterator[tuple[str, str]]:
    """The counts that tell whether a line's words stand together elsewhere: its pairs of neighbours, or its one word."""
    if line[-1] in HYPHENS:  # the half of a broken word
        return
    parts = [_words_of_piece(p)[0] for p in line.split()]
    found = [w for p in parts for w in p]
    if len(found) == 1 and found[0].isalpha():
        yield "word", found[0]
    for a, b in [x for p in parts for x in zip(p, p[1:])] + [(a[-1], b[0]) for a, b in zip(parts, parts[1:]) if a and b]:
        if not re.search(r"\d", a + b):  # forms hold 9 for every number, so what has digits besides letters has no count
            yield "pair", f"{a} {b}"


def gather(df: DataFrame, key: str, text: str) -> Iterator[tuple[DataFrame, Evidence]]:
    """(texts, evidence) by slices, one slice as a rule."""
    ship(df.sparkSession)

    def count(part: DataFrame) -> DataFrame:
        return part.select(text).mapInArrow(_counted, _COUNTS).groupBy("kind", "item").agg(F.sum("n").alias("n"))

    counts = cut(count(df))
    options = cut(_options(counts.where("kind = 'word'")))
    headers = _headers(counts, df, text)
    pairs = counts.where("kind = 'pair'").select(F.substring_index("item", " ", 1).alias("a"), F.substring_index("item", " ", -1).alias("b"), "n")

    def needed(pairs: DataFrame, asked: DataFrame) -> DataFrame:
        """Of the pairs, those beside a word that may be misread, and the same with what it may stand for."""
        odd = options.select("word", "right")
        left = asked.join(odd, F.col("b") == F.col("word")).select("a", F.explode(F.array("word", "right")).alias("b"))
        right = asked.join(odd, F.col("a") == F.col("word")).select(F.explode(F.array("word", "right")).alias("a"), "b")
        return pairs.join(left.unionByName(right).distinct(), ["a", "b"], "left_semi")

    beside = cut(needed(pairs, pairs))
    words = counts.where("kind = 'word'").select("item", "n")
    slices = max(1, math.ceil((beside.count() + words.count() + options.count()) / BOUND))
    for at in range(slices):
        part, own_words, own_pairs, own_options = df, words, beside, options
        if slices > 1:
            part = df.where(F.pmod(F.xxhash64(key), F.lit(slices)) == at)
            asked = cut(count(part))
            own = asked.where("kind = 'word'").select("item")
            own_options = options.join(own.withColumnRenamed("item", "word"), "word", "left_semi")
            own_words = words.join(own, "item", "left_semi")
            own_pairs = needed(pairs, asked.where("kind = 'pair'").select(F.substring_index("item", " ", 1).alias("a"), F.substring_index("item", " ", -1).alias("b")))
        w, p, o = (x.toArrow() for x in (own_words, own_pairs, own_options))
        found: dict[str, list] = {}
        for word, *x in zip(*(o.column(i).to_pylist() for i in range(5))):
            found.setdefault(word, []).append(tuple(x))
        yield part, Evidence(dict(zip(w.column(0).to_pylist(), w.column(1).to_pylist())),
                             {f"{a} {b}": n for a, b, n in zip(*(p.column(i).to_pylist() for i in range(3)))}, headers,
                             {k: tuple(sorted(v)) for k, v in found.items()})


_AROUND = StructType([StructField("line", StringType()), StructField("around", LongType())])


def _in_different_texts(df: DataFrame, text: str, lines: set[str]) -> set[str]:
    """Those of some lines that stand in HEADER_COUNT texts or more that differ in the rest."""
    if not lines:
        return set()
    shared = df.sparkSession.sparkContext.broadcast(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list[str], list[int]] = ([], [])
            for t in batch.column(0).to_pylist():
                if t and ("\n" in t or "\r" in t):
                    forms = [line_form(x) for x in split_lines(t)]
                    for f in set(forms) & shared.value:
                        rest = " ".join(x for x in forms if x != f)
                        out[0].append(f)
                        out[1].append(int.from_bytes(hashlib.blake2b(rest.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64())], names=_AROUND.names)

    several = df.select(text).where(F.rlike(F.col(text), F.lit("[\n\r]")))  # texts of one line have no line to look for
    found = several.mapInArrow(run, _AROUND).groupBy("line").agg(F.countDistinct("around").alias("n"))
    return {r["line"] for r in found.where(F.col("n") >= HEADER_COUNT).collect()}


# ---- candidates -------------------------------------------------------------------------------

class Trie:
    """The vocabulary by letters, with the largest count below every node; search() intersects it with the Levenshtein
    automaton of a word.

    A state of the automaton is a place in the read word with the edits so far; its steps are a letter that agrees, any letter
    substituted, inserted or deleted, and the substitutions, merges and splits of confused shapes, each one
    edit. A branch ends as soon as it has no state left or no word frequent enough."""

    def __init__(self, words: dict[str, int]):
        self.root: dict = {0: 0}
        for w, n in words.items():
            node = self.root
            node[0] = max(node[0], n)
            for c in w:
                node = node.setdefault(c, {0: 0})
                node[0] = max(node[0], n)
            node[""] = (w, n)

    def search(self, read: str, most: int, other: int, floor: int = 0) -> dict[str, tuple[int, int, int]]:
        """Every vocabulary word seen ``floor`` times or more within ``most`` edits, of which at most ``other`` are no confused
        shapes: word -> (edits, other edits, count), the fewest other edits first."""
        out: dict[str, tuple[int, int, int]] = {}
        n = len(read)
        steps = [[(r, a) for r in _READ if read.startswith(r, j) for a in _RIGHT[r]] for j in range(n)]
        seen: dict[tuple[int, int], list[tuple[int, int]]] = {}

        def walk(node: dict, j: int, edits: int, odd: int) -> None:
            if node[0] < floor:
                return
            if edits:
                at = seen.setdefault((id(node), j), [])
                if any(e <= edits and o <= odd for e, o in at):
                    return
                at.append((edits, odd))
            if j == n:
                if (hit := node.get("")) is not None and hit[1] >= floor and (hit[0] not in out or (odd, edits) < (out[hit[0]][1], out[hit[0]][0])):
                    out[hit[0]] = (edits, odd, hit[1])
            elif (below := node.get(read[j])) is not None:
                walk(below, j + 1, edits, odd)
            if edits == most:
                return
            if j < n:
                for r, a in steps[j]:
                    below = node
                    for c in a:
                        if (below := below.get(c)) is None:
                            break
                    else:
                        walk(below, j + len(r), edits + 1, odd)
            if odd < other:
                if j < n:
                    walk(node, j + 1, edits + 1, odd + 1)
                for c, below in node.items():
                    if c and c.__class__ is str:
                        if j < n and c != read[j]:
                            walk(below, j + 1, edits + 1, odd + 1)
                        walk(below, j, edits + 1, odd + 1)

        walk(self.root, 0, 0, 0)
        return out


def may_stand_for(trie: Trie, word: str, own: int) -> list[tuple[str, int, int, int]]:
    """(word it may stand for, count, edits, other edits) of a word seen ``own`` times; none if it is sound."""
    odd = not re.fullmatch(rf"{LETTERS}+", word)
    letters = sum(c.isalpha() for c in word)
    if len(word) < 2 or "-" in word or odd and (letters < max(1, len(word) - 3) or letters * 2 < len(word)):
        return []
    floor = RATIO * max(own, 1)
    # the shape of a digit or sign says what it stands for; other edits are for words of letters that occur once, as no others
    # may be taken for another word by them
    for other in (0,) if odd or len(word) < 4 or own != 1 else (1, OTHER_EDITS) if len(word) >= LONG_WORD else (1,):
        # at most one edit per three letters, or per two where digits or signs give them away
        found = [(w, n, edits, o) for w, (edits, o, n) in trie.search(word, MOST_EDITS, other, floor).items()
                 if w != word and edits <= max(1.0, len(w) / (2 if odd else 3))]
        if found:
            break
    return found


class Repairer:
    def __init__(self, evidence: Evidence):
        self.words, self.pairs, self.headers, self.options = evidence.words, evidence.pairs, evidence.headers, evidence.options
        self.sound: set[str] = set()

    # -- words
    def candidates(self, word: str) -> tuple[tuple[str, int, int, int], ...]:
        """(word it may stand for, count, edits, other edits) of a suspicious word; none if it is sound."""
        return self.options.get(word, ())

    def best(self, word: str, before: str, after: str) -> str | None:
        """What a word should read, by frequency, shape and its neighbours; None if it is sound."""
        options = self.candidates(word)
        own = self.words.get(word, 0) - 1  # besides this occurrence, as with its neighbours
        scored = []
        for w, n, edits, other in options:
            left, right = self.pairs.get(f"{before} {w}", 0), self.pairs.get(f"{w} {after}", 0)
            # short words and other edits than confused shapes: only a word seen nowhere else, both neighbours for the other
            if (other or len(word) < 4 and word.isalpha()) and (own > 0 or left < RATIO or right < RATIO):
                continue
            scored.append((math.log(n) - 3 * edits - 3 * other + 2 * math.log1p(left) + 2 * math.log1p(right), w, n))
        if not scored:
            return None
        top = max(scored)
        if own > 0:  # a word seen elsewhere: only where its neighbours speak against it
            beside = [max(self.pairs.get(p, 0) - 1, 0) for p in (f"{before} {word}", f"{word} {after}")]
            here = math.log(own) + 2 * math.log1p(beside[0]) + 2 * math.log1p(beside[1])
            if top[0] + 3 < here + 3 * (own >= top[2] / 20):
                return None
        return top[1]

    def known(self, word: str) -> int:
        """How often a word occurs, or the word it is a misreading of by confused shapes."""
        n = self.words.get(word, 0)
        if n:
            return n
        return max((n for _, n, _, other in self.candidates(word) if not other), default=0) // 4

    # -- broken words
    def joins(self, left: str, mark: str, right: str, at_line_end: bool) -> bool:
        """Is a word cut in two here, or is the mark a compound's own hyphen?"""
        a, b = left.lower(), right.lower()
        whole, compound = self.known(a + b), self.words.get(f"{a}-{b}", 0)
        if mark in "¬­":
            return at_line_end or whole > 0
        if compound > whole:
            return False
        if whole:
            return not (self.words.get(a, 0) > 20 * whole and self.words.get(b, 0) > 20 * whole) or at_line_end and whole > compound
        if not at_line_end:
            return False
        return not (self.words.get(a, 0) >= MIN_COUNT and self.words.get(b, 0) >= MIN_COUNT)

    def is_furniture(self, line: str) -> bool:
        if not line.strip() or LABEL.match(line):
            return False
        return bool(PAGE.match(line)) or line_form(line) in self.headers

    def repair(self, text: str | None) -> tuple[str | None, list[str]]:
        """(readable text, kinds of damage). A text on one line whose every piece is sound by itself is sound."""
        if not text or not text.strip():
            return text, []
        if "\n" not in text and "\r" not in text:
            for piece in set(text.split()) - self.sound:
                if not self._is_sound(piece):
                    break
            else:
                return text, []
        return self._repair(text)

    def _is_sound(self, piece: str) -> bool:
        """Whether a piece between blanks shows no damage, whatever stands beside it."""
        if piece[-1] in HYPHENS or self._repair(piece)[1] or any(self.candidates(w) for w in tokens(fold(piece))):
            return False
        if len(piece) <= 40:
            if len(self.sound) > 500_000:
                self.sound.clear()
            self.sound.add(piece)
        return True

    def _repair(self, text: str) -> tuple[str, list[str]]:
        damage: set[str] = set()
        lines = split_lines(text)
        if len(lines) > 1:
            body = []
            filled = [x for x in lines if x.strip()]
            for x in lines:
                if len(filled) > 1 and self.is_furniture(x):
                    damage.add("running_text")
                elif x.strip():
                    body.append(x.strip(" \t"))
        else:
            body = lines
        # halves at line ends
        out = body[0] if body else ""
        for x in body[1:]:
            m = re.search(rf"({LETTERS}[\w@!|$+]*)([{HYPHENS}])\s*$", out)
            n = re.match(rf"\s*([\w@!|$+]+)", x)
            if m and n and not n[1].isdigit():
                left, right = fold(m[1]), fold(n[1])
                joined = self.joins(left, m[2], right, True)
                if joined:
                    damage.add("hyphenation")
                out = out[:m.end(1)] + ("" if joined else "-") + x.lstrip()
            else:
                out = out + " " + x.lstrip()
        # halves on one line
        def lost(m: re.Match) -> str:
            if self.joins(fold(m[1]), m[2], fold(m[4]), False):
                damage.add("hyphenation")
                return m[1] + m[4]
            return m[0]

        out = re.sub(rf"({LETTERS}+)([{HYPHENS}])([ \t\xa0]+)({LETTERS}+)", lost, out)
        out = re.sub(rf"(?<!-)\b({LETTERS}{{2,}})([-‐‑¬])()({LETTERS}{{2,}})\b(?!-)", lost, out)
        # misread words
        plain = fold(out)
        spans = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(plain)]
        low = ["#" if w.isdigit() else w.lower() for _, _, w in spans]
        fixes = []
        for i, (a, b, w) in enumerate(spans):
            if self.words.get(low[i], 0) and not self.candidates(low[i]) or (w.isupper() and len(w) > 1 and w.isalpha()):
                continue
            if plain[max(0, a - 1):a] in ("-",) and re.search(r"[A-Z0-9]-$", plain[:a]) and any(c.isdigit() for c in w):
                continue
            if any(c.isdigit() for c in w) and not any(c.islower() for c in w):
                continue
            right = self.best(low[i], low[i - 1] if i else "", low[i + 1] if i + 1 < len(low) else "")
            if right:
                damage.add("misread")
                fixes.append((a, b, right.capitalize() if w[0].isupper() or (i == 0 and not w[0].isalpha()) else right))
        if fixes:
            parts, at = [], 0
            for a, b, w in fixes:
                parts += [plain[at:a], w]
                at = b
            out = "".join([*parts, plain[at:]])
        return (out if damage else text), sorted(damage)


_repairers: dict[int, Repairer] = {}


def repair(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, repaired, damage): every row's readable text and the kinds of damage found in it."""
    source = spread(df.select(key, text))
    schema = StructType([source.schema[key], StructField("repaired", StringType()), StructField("damage", ArrayType(StringType()))])
    out = None
    for part, evidence in gather(source, key, text):
        shared = df.sparkSession.sparkContext.broadcast((evidence.words, evidence.pairs, evidence.headers, evidence.options))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            mine = shared.id if hasattr(shared, "id") else id(shared)
            if mine not in _repairers:
                _repairers.clear()
                _repairers[mine] = Repairer(Evidence(*shared.value))
            fix = _repairers[mine].repair
            for batch in batches:
                done = [fix(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d[0] for d in done], pa.string()),
                                                  pa.array([d[1] for d in done], pa.list_(pa.string()))], names=schema.names)

        done = part.mapInArrow(run, schema)
        out = done if out is None else out.unionByName(done)
    return out
