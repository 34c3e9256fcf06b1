"""Figure classes from captions, image vectors and page geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casetrail.functions.scalar import dot, first_arg_max, let

# Classes in order of test with their patterns, and the acceptance bound of the vector fallback.
CLASS_PATTERNS = (
    ("imaging", r"\b(?:CT|MRI|ultrasound|radiograph\w*|X-ray|PET|scan\w*|contrast-enhanced|sonograph\w*|echocardiogra\w*|angiogra\w*)\b"),
    ("histology", r"\b(biopsy|histolog\w*|histopatholog\w*|stain|H&E|PAS|immunohistochem|magnif|×\s?\d|microscop|glomerul|tubul)\b"),
    ("lab_chart", r"\b(trend|level over|titer|graph|plot|curve|timeline|chart|time course)\b"),
    ("rash_image", r"\b(rash|erythema|skin|cutaneous|malar|purpura|papule|macule|dermat|necrotic)\b"),
)
ZERO_SHOT_LABELS = ("imaging", "histology", "lab_chart", "rash_image")
ACCEPT_FROM = 0.5
UNLABELED = "unlabeled"


def classify_caption(caption: Column) -> Column:
    """The first class whose pattern is found, else "other"; null captions are "other"."""
    out = None
    for name, pattern in CLASS_PATTERNS:
        hit = F.rlike(caption, F.lit("(?iU)" + pattern))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def zero_shot(vector: Column, prompts: list[list[float]], labels: tuple[str, ...] = ZERO_SHOT_LABELS) -> Column:
    """struct(label, p): softmax over 100 x cosine with each prompt; the first label on ties."""
    rows = F.lit([_unit(p) for p in prompts])

    def decide(likeness: Column) -> Column:
        top = F.array_max(likeness)
        total = F.aggregate(likeness, F.lit(0.0), lambda s, x: s + F.exp(x - top))
        return F.struct(F.element_at(F.array(*map(F.lit, labels)), first_arg_max(likeness)).alias("label"), (F.lit(1.0) / total).alias("p"))

    scale = let(F.sqrt(dot(vector, vector)), lambda n: F.transform(
        rows, lambda r: F.coalesce(F.try_divide(F.lit(100.0) * dot(vector, r), n), F.lit(0.0))))
    return let(scale, decide)


def _unit(v: list[float]) -> list[float]:
    norm = sum(float(x) * float(x) for x in v) ** 0.5
    return [float(x) / norm if norm else 0.0 for x in v]


def accept_zero_shot(figure_type: Column, guess: Column) -> Column:
    """The guessed label where the type is still "other" and the guess is sure enough."""
    return F.when((figure_type == "other") & (guess["p"] >= ACCEPT_FROM), guess["label"]).otherwise(figure_type)


def is_annotated(figure_type: Column) -> Column:
    return F.coalesce(figure_type, F.lit(UNLABELED)) != UNLABELED


def nearest_caption(image_bottom: Column, blocks: Column) -> Column:
    """Of blocks array<struct<y0,text>>, the text of the nearest one that starts with "fig" at or
    below the image's bottom less 5; line breaks become blanks; "" where there is none."""
    fit = F.filter(blocks, lambda b: (b["y0"] >= image_bottom - 5) & F.startswith(F.lower(b["text"]), F.lit("fig")))
    best = F.array_min(F.transform(fit, lambda b: F.struct(b["y0"].alias("y0"), b["text"].alias("text"))))
    return F.coalesce(F.replace(best["text"], F.lit("\n"), F.lit(" ")), F.lit(""))


def unnest_figures(articles: DataFrame) -> DataFrame:
    """One row per figure with its 0-based place among all figures of the article."""
    keep = [c for c in articles.columns if c != "figures"]
    return (articles.select(*keep, F.posexplode("figures").alias("figure_index", "figure"))
            .select(*keep, "figure_index", "figure.*"))


def pick_version(df: DataFrame, key: str, prefix: str, order: str) -> DataFrame:
    """Per key the prefix with the highest version number; the first in ``order`` on ties."""
    from casetrail.functions.scalar import version_number

    return df.groupBy(key).agg(
        F.max_by(F.col(prefix), F.struct(version_number(F.col(prefix)), -F.col(order))).alias(prefix))
