"""Wrong-diagnosis extraction from abstracts: ordered tiers of patterns, then a lexicon.

Everything is a Column expression; no Python worker and no shuffle. Regular expressions carry
``(?iU)`` because letters, boundaries and blanks are meant in the Unicode sense.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from casetrail.functions.scalar import let, strip

# The words and patterns below decide which entities come out and must stay as they are.
FILLER_WORDS = ("and", "or", "but", "with", "for", "in", "of", "at", "to", "a", "an", "the", "was", "were", "has", "have",
                "after", "before", "until", "during", "since", "which", "that", "who", "as", "by", "on", "from")
NOISE_STARTS = ("the", "this", "a", "an", "its", "their", "these", "following", "above", "below", "symptom", "sign",
                "finding", "evaluation", "investigation", "workup", "treatment", "therapy", "patient", "case", "report",
                "study", "literature", "result", "outcome", "data", "underlying", "concurrent", "coexist")
PERSON_WORDS = ("patient", "case", "individual", "subject", "woman", "man", "male", "female", "boy", "girl", "child",
                "infant", "adult", "who", "she", "he", "they", "year-old")
TARGET_TERMS = ("sle", "systemic lupus", "lupus erythematosus", "lupus", "sjogren", "mctd", "mixed connective tissue",
                "myositis", "antiphospholipid")
STOP_WORDS = ("and", "but", "however", "which", "who", "that", "was", "were", "after", "before", "until", "while")
ENTITY = r"([\w][\w\s'\-]{2,60}?)"
HIGH_TRIGGERS = (
    r"(?:initially|first)\s+diagnosed\s+(?:as|with|for)\s+",
    r"misdiagnosed\s+(?:as|with|for)\s+",
    r"previously\s+diagnosed\s+(?:as|with|for)\s+",
    r"prior\s+diagnosis\s+of\s+",
    r"wrongly\s+diagnosed\s+(?:as|with|for)\s+",
    r"presenting\s+diagnosis\s+(?:was|of)\s+",
    r"delayed\s+diagnosis\s+of\s+",
    r"referred\s+after[^\n]{3,60}?diagnosis\s+of\s+",
)
PASSIVE = r"((?:[A-Za-z][\w'\-]*\s+){0,3}[A-Za-z][\w'\-]*)\s+(?:was|were)\s+(?:initially|first)\s+diagnosed\b"
MASQUERADE = r"([\w][\w\s'\-]{3,50}?)\s+(?:masquerad\w*|mimick\w*)\s+as\s+(?:SLE|systemic lupus|lupus erythematosus|lupus)"
#: Cheap tests without which a pattern cannot be found; the two patterns have no fixed beginning and try every place.
NEEDS = {PASSIVE: r"(?:was|were)\s+(?:initially|first)\s+diagnosed", MASQUERADE: r"masquerad|mimick"}
MEDIUM_TRIGGERS = (
    r"initially\s+(?:treated|managed)\s+(?:as|for)\s+",
    r"thought\s+to\s+have\s+",
    r"suspicious\s+of\s+",
    r"suspected\s+(?:of\s+having\s+|to\s+have\s+)?",
)
SIGNALS = ("misdiagnos", "initially diagnosed", "previously diagnosed", "prior diagnosis", "delayed diagnosis",
           "wrongly diagnosed", "masquerad", "mimick")
LEXICON = (
    "LRBA deficiency", "CTLA-4 insufficiency", "HELIOS deficiency", "SOCS1 haploinsufficiency", "TLR7 deficiency",
    "UNC93B1 deficiency", "IRE1α deficiency", "DOCK11 deficiency", "autoimmune lymphoproliferative disorder",
    "DNASE1L3 deficiency", "SPENCD", "Aicardi-Goutières syndrome", "AGS", "SAVI", "PRAAS", "Singleton-Merten syndrome",
    "dermatomyositis", "polymyositis", "Still's disease", "neuromyelitis optica spectrum disorder", "NMOSD",
    "multiple sclerosis", "Castleman disease", "parvovirus B19", "endocarditis", "hepatitis", "HIV",
    "Epstein-Barr virus", "cytomegalovirus", "Borrelia", "Lyme disease", "toxoplasmosis", "histoplasmosis",
    "tuberculosis", "leprosy", "leishmaniasis", "Whipple's disease", "angioimmunoblastic T-cell lymphoma", "lymphoma",
    "myelodysplastic syndrome", "atrial myxoma", "drug-induced lupus", "graft-versus-host disease",
    "hypocomplementemic urticarial vasculitis syndrome", "Schnitzler syndrome",
)
SHORTEST_TEXT = 30
LEVELS = ("high", "medium", "gazetteer", "signal_only", "none")


def _any(words) -> str:
    return "|".join(words)


@dataclass(frozen=True)
class Rules:
    """What a caller may replace: triggers per tier, signal words, lexicon, target terms."""

    high: tuple[str, ...] = HIGH_TRIGGERS
    medium: tuple[str, ...] = MEDIUM_TRIGGERS
    signals: tuple[str, ...] = SIGNALS
    lexicon: tuple[str, ...] = LEXICON
    targets: tuple[str, ...] = TARGET_TERMS
    extra_high: tuple[str, ...] = field(default=(PASSIVE, MASQUERADE))

    @property
    def stop(self) -> str:
        return rf"(?=[,;.!?(]|\s+(?:{_any(w + chr(92) + 'b' for w in STOP_WORDS)})|\z)"


DEFAULT = Rules()


def clean_entity(raw: Column) -> Column:
    """The entity in lower case without trailing filler words; null for what is no disease name."""
    e = strip(F.regexp_replace(strip(raw), rf"(?iU)(?:\s*\b(?:{_any(FILLER_WORDS)})\b\s*){{1,5}}\z", ""))
    keep = ((F.length(e) >= 4) & (F.length(e) <= 80)
            & ~F.rlike(e, F.lit(rf"(?iU)^(?:{_any(NOISE_STARTS)})\b"))
            & ~F.rlike(e, F.lit(rf"(?iU)\b(?:{_any(PERSON_WORDS)})\b")))
    out = F.btrim(F.lower(e), F.lit(" .,;-"))
    return F.when(keep & (out != ""), out)


def is_target(entity: Column, disease: Column, rules: Rules = DEFAULT) -> Column:
    """Is the entity one of the target diseases or the record's own? An empty disease excludes
    every entity; a null one excludes none beyond the fixed terms."""
    own = F.concat(F.lit(r"(?iU)\b\Q"), F.replace(F.lower(disease), F.lit("_"), F.lit(" ")), F.lit(r"\E\b"))
    return (F.rlike(entity, F.lit(rf"(?iU)\b(?:{_any(rules.targets)})\b"))
            | F.coalesce(F.rlike(entity, own), F.lit(False)))


def _tier(text: Column, disease: Column, patterns: list[str], rules: Rules) -> Column:
    def found(p: str) -> Column:
        all_of_it = F.regexp_extract_all(text, F.lit("(?iU)" + p), F.lit(1))
        if p not in NEEDS:
            return all_of_it
        return F.when(F.rlike(text, F.lit("(?iU)" + NEEDS[p])), all_of_it).otherwise(F.array().cast("array<string>"))

    raw = F.flatten(F.array(*map(found, patterns)))
    cleaned = F.filter(F.transform(raw, clean_entity), lambda e: e.isNotNull())
    return F.array_distinct(F.filter(cleaned, lambda e: ~is_target(e, disease, rules)))


def high_entities(text: Column, disease: Column, rules: Rules = DEFAULT) -> Column:
    return _tier(text, disease, [t + ENTITY + rules.stop for t in rules.high] + list(rules.extra_high), rules)


def medium_entities(text: Column, disease: Column, rules: Rules = DEFAULT) -> Column:
    return _tier(text, disease, [t + ENTITY + rules.stop for t in rules.medium], rules)


def has_signal(text: Column, rules: Rules = DEFAULT) -> Column:
    return F.rlike(text, F.lit(f"(?iU){_any(rules.signals)}"))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?U)(?<=[.!?])\s+")


def lexicon_entities(text: Column, disease: Column, rules: Rules = DEFAULT) -> Column:
    """Terms found whole in a sentence that itself holds a signal word, in sentence then term order."""
    terms = F.array(*[F.struct(F.lit(t.lower()).alias("term"), F.lit(rf"(?iU)\b\Q{t}\E\b").alias("pattern"))
                      for t in rules.lexicon])
    any_term = rf"(?iU)\b(?:{_any(rf'{chr(92)}Q{t}{chr(92)}E' for t in rules.lexicon)})\b"  # once a sentence, before each by itself
    hits = F.flatten(F.transform(
        F.filter(sentences(text), lambda s: has_signal(s, rules) & F.rlike(s, F.lit(any_term))),
        lambda s: F.transform(F.filter(terms, lambda t: F.rlike(s, t["pattern"])), lambda t: t["term"])))
    return F.array_distinct(F.filter(hits, lambda e: ~is_target(e, disease, rules)))


def extract(text: Column, disease: Column, rules: Rules = DEFAULT) -> Column:
    """struct(entities, level): the first tier that yields an entity wins.

    Null, empty and short texts (under 30 characters) give no entity and "none".
    """
    none = F.array().cast("array<string>")

    def found(entities: Column, level: str) -> Column:
        return F.struct(entities.alias("entities"), F.lit(level).alias("level"))

    high, medium = high_entities(text, disease, rules), medium_entities(text, disease, rules)
    lexicon = lexicon_entities(text, disease, rules)
    # every tier is computed once, and only where the tiers above it gave nothing
    last = let(lexicon, lambda e: F.when(F.size(e) > 0, found(e, "gazetteer")).otherwise(found(none, "signal_only")))
    last = F.when(~has_signal(text, rules), found(none, "none")).otherwise(last)
    rest = let(medium, lambda e: F.when(F.size(e) > 0, found(e, "medium")).otherwise(last))
    best = let(high, lambda e: F.when(F.size(e) > 0, found(e, "high")).otherwise(rest))
    return F.when(F.length(F.coalesce(text, F.lit(""))) < SHORTEST_TEXT, found(none, "none")).otherwise(best)


def apply_extraction(df, rules: Rules = DEFAULT):
    """Adds evidence_level and overwrites misdiagnosis_sequence where something was found;
    otherwise the stale sequence stays. Short abstracts get the level "no_abstract"."""
    short = F.length(F.coalesce(F.col("abstract"), F.lit(""))) < SHORTEST_TEXT
    df = df.withColumn("_x", extract(F.col("abstract"), F.col("disease"), rules))
    return (df.withColumn("evidence_level", F.when(short, "no_abstract").otherwise(F.col("_x.level")))
            .withColumn("misdiagnosis_sequence", F.when(F.size("_x.entities") > 0, F.col("_x.entities"))
                        .otherwise(F.col("misdiagnosis_sequence")))
            .drop("_x"))


#: Ages are no delays. A delay is a length of time that words of delay, or of the way to the diagnosis, stand beside.
AGES = r"(?i)\bage[ds]?(?:\s+of)?\s+[0-9]+\s+(?:day|week|month|year)s?|\b[0-9]+[\s-]+(?:day|week|month|year)s?[\s-]+old"
_SPAN = r"([0-9]+)[\s-]+(day|week|month|year)s?"
DELAYS = (
    rf"(?i)\b(?:delay\w*|lag)\s+(?:of|by|was|for)\s+(?:about\s+|nearly\s+|over\s+|some\s+)?{_SPAN}\b",
    rf"(?i)\b{_SPAN}\s+(?:of\s+[^.!?]{{1,40}}\s+)?(?:before|prior\s+to|until|elapsed)\b[^.!?]{{0,40}}\bdiagnos",
    rf"(?i)\bdiagnos\w*\s[^.!?]{{0,40}}\b(?:after|following)\s+(?:about\s+|nearly\s+|over\s+|some\s+)?{_SPAN}\b",
    rf"(?i)\bafter\s+(?:about\s+|nearly\s+|over\s+|some\s+)?{_SPAN}\b[^.!?]{{0,40}}\bdiagnos",
)


def diagnostic_delay(text: Column) -> Column:
    """The stated delay of the diagnosis in days, by the first of DELAYS that is found; null where none is stated.
    Other lengths of time, and ages, are no delays."""
    plain = F.regexp_replace(text, AGES, " ")

    def days(p: str) -> Column:
        n, unit = F.regexp_extract(plain, p, 1), F.lower(F.regexp_extract(plain, p, 2))
        length = F.when(unit == "day", 1).when(unit == "week", 7).when(unit == "month", 30).when(unit == "year", 365)
        return F.when(n != "", n.try_cast("bigint") * length)

    return F.coalesce(*map(days, DELAYS))
