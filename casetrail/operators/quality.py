"""Validation of JSON lines against declared rules, and checks of files.

Rules tell apart missing, null and ill-typed fields, which a lenient parser does not: a line is parsed
to VARIANT and every field's own JSON type is held against its kind. One projection, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casetrail.schemas import MODELS


def _type(v: Column, path: str) -> Column:
    """JSON type of a path: null where missing, VOID for an explicit null."""
    return F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant"))


def _fits(v: Column, kind: str, path: str) -> Column:
    typ = _type(v, path)
    text = F.try_variant_get(v, f"$.{path}", "string")
    if kind == "str":
        return typ == "STRING"
    if kind == "int":  # whole numbers, texts of them, and booleans
        return ((typ == "BIGINT") | (typ == "BOOLEAN") | ((typ == "STRING") & F.rlike(text, F.lit(r"^\s*[+-]?\d+\s*$")))
                | (typ.startswith("DECIMAL") | (typ == "DOUBLE")) & F.rlike(text, F.lit(r"^-?\d+(?:\.0*)?$")))
    if kind == "strlist":
        return (typ == "ARRAY<STRING>") | (typ == "ARRAY<VOID>") & (F.size(F.try_variant_get(v, f"$.{path}", "array<string>")) == 0)
    if kind == "time":
        return ((typ == "BIGINT") | typ.startswith("DECIMAL") | (typ == "DOUBLE") | (typ == "STRING")
                & (text.try_cast("timestamp").isNotNull() | F.rlike(text, F.lit(r"^-?\d+(?:\.\d+)?$"))))
    if kind == "object":
        return typ.startswith("OBJECT")
    return typ.startswith("ARRAY<OBJECT") | (typ == "ARRAY<VOID>")


_ERROR = "array<struct<field:string,code:string>>"


def _errors(v: Column, rules: dict, prefix: Column) -> Column:
    """Errors of one object, those of the records nested in it behind its own."""
    def error(field: str, code: str) -> Column:
        return F.struct(F.concat(prefix, F.lit(field)).alias("field"), F.lit(code).alias("code"))

    checks, nested = [], []
    for field, (kind, presence, *inner) in rules.items():
        typ = _type(v, field)
        checks.append(
            F.when(typ.isNull(), error(field, "missing") if presence == "required" else None)
            .when(typ == "VOID", None if presence == "optional" else error(field, "null"))
            .when(~F.coalesce(_fits(v, kind, field), F.lit(False)), error(field, "wrong_type")))
        if inner and kind == "object":
            own = _errors(F.try_variant_get(v, f"$.{field}", "variant"), inner[0], F.concat(prefix, F.lit(f"{field}.")))
            nested.append(F.when(F.coalesce(_fits(v, kind, field), F.lit(False)), own))
        elif inner:
            items = F.try_variant_get(v, f"$.{field}", "array<variant>")
            each = _each(items, inner[0], F.concat(prefix, F.lit(f"{field}[")))
            nested.append(F.when(F.coalesce(_fits(v, kind, field), F.lit(False)), F.flatten(each)))
    own = F.array_compact(F.array(*checks))
    return F.concat(own, *[F.coalesce(x, F.array().cast(_ERROR)) for x in nested]) if nested else own


def _each(items: Column, rules: dict, prefix: Column) -> Column:
    return F.transform(items, lambda x, i: _errors(x, rules, F.concat(prefix, i.cast("string"), F.lit("]."))))


def validate(lines: DataFrame, model: str, value: str = "value") -> DataFrame:
    """``lines`` with errors: array of (field, code). Codes: invalid_json, not_an_object, missing, null,
    wrong_type. Fields of nested records are named with their path. Blank lines pass without errors, as they are skipped; extra
    fields are allowed."""
    if model not in MODELS:
        raise KeyError(f"unknown model {model}; known: {', '.join(MODELS)}")
    d = lines.withColumn("_v", F.expr(f"try_parse_json({value})"))
    whole = F.expr("schema_of_variant(_v)")

    def one(code: str) -> Column:
        return F.array(F.struct(F.lit("").alias("field"), F.lit(code).alias("code")))

    errors = (F.when(F.coalesce(F.rlike(F.col(value), F.lit(r"(?U)^\s*$")), F.lit(True)), F.array().cast(_ERROR))
              .when(F.col("_v").isNull(), one("invalid_json"))
              .when(~whole.startswith("OBJECT"), one("not_an_object"))
              .otherwise(_errors(F.col("_v"), MODELS[model], F.lit(""))))
    return d.withColumn("errors", errors).drop("_v")


def error_summary(validated: DataFrame) -> DataFrame:
    """One row: lines and lines with errors."""
    return validated.agg(F.count("*").alias("n_lines"), F.count_if(F.size("errors") > 0).alias("n_invalid"))


def exit_code(validated: DataFrame) -> int:
    """0 if every line passes, 1 if not."""
    return int(validated.where(F.size("errors") > 0).limit(1).count() > 0)


def bad_json(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines that are neither blank nor JSON."""
    return lines.where(F.expr(f"try_parse_json({value})").isNull() & ~F.rlike(F.col(value), F.lit(r"(?U)^\s*$")))


def bad_json_lines(lines: DataFrame, value: str = "value", show: int = 3) -> DataFrame:
    """The first lines, by number, that are no JSON."""
    return bad_json(lines, value).orderBy("line_no").limit(show)


def header_equals(df: DataFrame, expected: list[str]) -> bool:
    return df.columns == expected


def missing_files(spark: SparkSession, roles: dict[str, str]) -> list[str]:
    """Roles whose file is not there, on whatever file system the path names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = {role: jvm.org.apache.hadoop.fs.Path(path) for role, path in roles.items()}
    return [role for role, path in paths.items() if not path.getFileSystem(conf).exists(path)]
