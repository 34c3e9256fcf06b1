"""Texts that look the same but differ in their characters, brought to one form.

DuckDB runs inside each Arrow partition and maps invisible characters, compatibility forms and
look-alike letters with regular expressions, ``translate`` and ``nfc_normalize`` in embedded SQL. Rows
never leave their partition for it; pure ASCII texts take the short way through the same SQL.

Defined results: null stays null; blank texts become ""; end blanks go, other blanks and line breaks
stay where they are (CR LF counts as one line break); upper and lower case, accents, digits, raised
digits and punctuation stay. Texts of any length are handled whole. Columns other than the named ones
are not read, so clashing names cannot occur.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from casetrail.llm.fold import ARMENIAN, CYRILLIC, GREEK, OTHER, UNSEEN_CLASS, tables
from casetrail.llm.skew import join_by_size
from casetrail.session import cut, ship

DUCK_MEMORY = "300MB"
SALT_ROWS = 100_000


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _one_to_one(chars: list[str], one: dict[str, str]) -> str:
    table = f"{_quote(''.join(chars))}, {_quote(''.join(one[c] for c in chars))}"
    return f"CASE WHEN regexp_matches({{c}}, '[{''.join(chars)}]') THEN translate({{c}}, {table}) ELSE {{c}} END"


def _one_to_many(chars: list[str], many: dict[str, str]) -> str:
    by_form: dict[str, str] = {}
    for c in chars:
        by_form[many[c]] = by_form.get(many[c], "") + c
    expr = reduce(lambda e, x: f"regexp_replace({e}, '[{x[1]}]', {_quote(x[0])}, 'g')", by_form.items(), "{c}")
    return f"CASE WHEN regexp_matches({{c}}, '[{''.join(chars)}]') THEN {expr} ELSE {{c}} END"


@functools.cache
def steps() -> tuple[str, ...]:
    """The embedded SQL's expressions in order, each on {c}. Characters are mapped in groups, since
    ``translate`` costs by the size of its table: a text meets only the tables it has characters of."""
    one, many = tables()
    wide = [c for c in one if "\uff00" <= c <= "\uffef"]
    blank = [c for c in one if one[c] == " "]
    letters = [c for c in one if c in GREEK + CYRILLIC + ARMENIAN + OTHER]
    rest = sorted(set(one) - {*wide, *blank, *letters})
    ligatures = [c for c in many if "\ufb00" <= c <= "\ufb06"]
    others = [c for c in many if c not in ligatures]
    return (
        f"regexp_replace({{c}}, '{UNSEEN_CLASS}', '', 'g')",
        *[_one_to_one(group, one) for group in (blank, letters, wide, rest)],
        _one_to_many(ligatures, many), _one_to_many(others, many),
        "CASE WHEN regexp_matches({c}, '[^\\x00-\\x7F]') THEN nfc_normalize({c}) ELSE {c} END",
        "CASE WHEN contains({c}, chr(13)) THEN regexp_replace({c}, '\\r\\n?', chr(10), 'g') ELSE {c} END",
        "regexp_replace(regexp_replace({c}, '^\\s+', ''), '\\s+$', '')",
    )


def canonical_sql(source: str, keep: list[str], columns: list[str]) -> str:
    """A query over ``source`` that gives the columns in their one form beside those to keep."""
    return reduce(lambda q, e: "SELECT " + ", ".join([*keep, *(f"{e.replace('{c}', c)} AS {c}" for c in columns)]) + f" FROM ({q})",
                  steps(), f"SELECT * FROM {source}")


def _duck():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": DUCK_MEMORY, "autoinstall_known_extensions": False,
                                  "autoload_known_extensions": False})


def canonicalize(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, fields...) with every field in its one form."""
    ship(df.sparkSession)
    source = df.select(key, *fields)
    schema = StructType([source.schema[key], *[StructField(f, StringType()) for f in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        names = ["k", *[f"c{i}" for i in range(len(fields))]]
        sql = canonical_sql("part", ["k"], names[1:])
        for batch in batches:
            con.register("part", pa.Table.from_batches([batch.rename_columns(names)]))
            for out in con.sql(sql).to_arrow_table().to_batches():
                yield out.rename_columns([key, *fields])
            con.unregister("part")

    return source.mapInArrow(run, schema)


_FORMS = StructType([StructField("row_id", LongType()), StructField("field_name", StringType()),
                     StructField("look_hi", LongType()), StructField("look_lo", LongType()), StructField("form", LongType())])


def forms(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(row_id, field_name, look_hi, look_lo, form): what each non-empty text looks like, as 128 bits
    of its one form, and its characters as they are, as 64 bits."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        names = ["k", *[f"c{i}" for i in range(len(fields))]]
        part = " UNION ALL ".join(
            f"SELECT k AS row_id, {_quote(f)} AS field_name, {c} AS look, {c} AS raw FROM part WHERE {c} <> ''"
            for c, f in zip(names[1:], fields))
        bits = "CAST(CAST({0} AS HUGEINT) - 9223372036854775808 AS BIGINT)"
        sql = (f"SELECT row_id, field_name, {bits.format('md5_number_upper(look)')} AS look_hi, "
               f"{bits.format('md5_number_lower(look)')} AS look_lo, {bits.format('md5_number_lower(raw)')} AS form "
               f"FROM ({canonical_sql(f'({part})', ['row_id', 'field_name', 'raw'], ['look'])}) WHERE look <> ''")
        for batch in batches:
            con.register("part", pa.Table.from_batches([batch.rename_columns(names)]))
            yield from con.sql(sql).to_arrow_table().to_batches()
            con.unregister("part")

    return df.select(F.col(key).cast("long").alias(key), *fields).mapInArrow(run, _FORMS)


def equal_looking(parts: dict[str, DataFrame]) -> DataFrame:
    """(table_name, field_name, row_id_a, row_id_b): rows of one table and field that look the same
    and are not the same characters. ``parts`` holds the output of forms() by table.

    Groups of one form, the vast majority, end in a partial aggregation. In the rest, the rows of the
    group's most frequent form meet the others only, so a form that a third of all rows have costs what
    it gives and no more. A look of many rows is joined to what belongs to it without a shuffle of its rows, and
    its rows are spread over as many salts as hold SALT_ROWS each, the others being copied to every salt.
    """
    rows = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("table_name"), "*")
        rows = df if rows is None else rows.unionByName(df)
    rows = cut(rows)
    look = ["table_name", "field_name", "look_hi", "look_lo"]
    by_form = rows.groupBy(*look, "form").agg(F.count("*").alias("n"))
    mixed = cut(by_form.groupBy(*look).agg(F.max_by("form", F.struct("n", "form")).alias("main"), F.count("*").alias("forms"), F.sum("n").alias("n"))
                .where("forms > 1").drop("forms"))
    inside = cut(join_by_size(rows, mixed, look, "n").withColumn("is_main", F.col("form") == F.col("main")).drop("main"))
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    others = (inside.where(~F.col("is_main")).select(*look, F.col("row_id").alias("o"), F.col("form").alias("of"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")))
    inside = inside.withColumn("salt", F.pmod(F.xxhash64("row_id"), salts).cast("int"))
    pairs = inside.join(others, [*look, "salt"]).where((F.col("form") != F.col("of")) & (F.col("is_main") | (F.col("row_id") < F.col("o"))))
    return pairs.select("table_name", "field_name", F.least("row_id", "o").alias("row_id_a"),
                        F.greatest("row_id", "o").alias("row_id_b"))
