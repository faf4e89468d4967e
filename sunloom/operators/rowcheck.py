"""Rows of delimited files that can't be read, set apart with a reason.

Records come as text, one a row, with the header as line 1 of each file.  Each
record is parsed into cells with JVM expressions only: the text is split at its
quote marks, which tells quoted from unquoted stretches and shows broken quoting;
delimiters in quoted stretches are masked, and the rest is split at the delimiter.
The cells are exploded into (file, line, column, value), a rule table with one rule
for each kind of column is joined, the violated rules are aggregated to one reason
a record, and the clean records are those that the anti-join with the bad ones keeps.

Defined results
* a null record is an empty one: one empty field;
* an empty file has no rows, a file of a header alone neither; records of a file
  without line 1 have no columns to fit and are bad for ``columns``;
* records with equal (file_id, line_no) count as one key: it is bad if one of them
  is, for the first reason that fits any of them; records without a line number are told
  apart by their text;
* a file without a name has no header, so its records are bad for ``columns``; a name
  that a header repeats stays a column each time;
* tables with extra columns, also named like internal ones, are allowed: only
  file_id, line_no and line are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reasons in the order in which they are tried.
REASONS = ("quoting", "columns", "value")
#: Characters that can't stand in a record: they mask delimiters and marks in quoted stretches.
_MASKED_DELIMITER, _MASKED_QUOTE = "\x01", "\x02"
_NUMBER = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"
#: The rule table: kind of cell, delimiter (null: any), rank of the reason, pattern of valid texts (null: any), whether a null text is valid.
#: The kinds quoting and columns stand for a whole record that has no cells to look at; no text is valid for them.
RULES = (
    ("quoting", None, 0, "(?!)", False),
    ("columns", None, 1, "(?!)", False),
    ("ts", None, 2, r"([0-9]{4})-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])[ T]([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?", False),
    ("status", None, 2, r"[+-]?[0-9]+", True),
    ("note", None, 2, None, True),
    ("number", ",", 2, _NUMBER, True),
    ("number", "\t", 2, _NUMBER, True),
    ("number", ";", 2, _NUMBER.replace(r"\.", "[.,]"), True),
)
NULL_TEXTS = ("", "NA", "NaN")
#: Parts into which the records of each file are spread to meet their header, so that no file is one task.
PARTS = 32


def _unmask(cell: Column, delimiter: Column) -> Column:
    return F.replace(F.replace(cell, F.lit(_MASKED_DELIMITER), delimiter), F.lit(_MASKED_QUOTE), F.lit('"'))


def _stretches(line: Column) -> Column:
    return F.split(line, '"', -1)


def _outside_ok(stretch: Column, i: Column, n: Column, delimiter: Column) -> Column:
    """Whether an unquoted stretch between quote marks starts and ends with a delimiter where it must."""
    bare = F.when(delimiter == "\t", F.btrim(stretch, F.lit(" "))).otherwise(F.btrim(stretch, F.lit(" \t")))
    first, last = i == 0, i == n - 1
    starts, ends = F.startswith(bare, delimiter), F.endswith(bare, delimiter)
    # In the middle nothing at all between two marks is a doubled mark.
    return (
        F.when(first & last, F.lit(True))
        .when(first, (bare == "") | ends)
        .when(last, (bare == "") | starts)
        .otherwise((stretch == "") | (starts & ends))
    )


def parse_cells(lines: DataFrame) -> DataFrame:
    """Add ``quoting_ok`` and ``cells`` (array<string>) to rows with ``text`` and ``delimiter``.

    Lines without a quote mark (most) are only split.
    """
    parts = _stretches(F.col("text"))
    n = F.size("parts")
    ok = (n % 2 == 1) & F.forall(
        F.transform("parts", lambda s, i: F.when(i % 2 == 0, _outside_ok(s, i, n, F.col("delimiter"))).otherwise(F.lit(True))),
        lambda x: x,
    )
    # Masked text: quoted stretches lose their delimiters, a doubled mark becomes a masked one.
    masked = F.concat_ws(
        "",
        F.transform(
            "parts",
            lambda s, i: F.when(i % 2 == 1, F.replace(s, F.col("delimiter"), F.lit(_MASKED_DELIMITER)))
            .when((s == "") & (i > 0) & (i < n - 1), F.lit(_MASKED_QUOTE))
            .otherwise(s),
        ),
    )
    quoted = F.contains("text", F.lit('"'))
    # The pattern of the delimiter is a literal, as it is one of three single characters that need no escape.
    split = lambda text: F.split(text, F.col("delimiter"), -1)
    plain = lines.withColumn("parts", F.when(quoted, parts))
    return plain.withColumns(
        {
            "quoting_ok": F.when(quoted, ok).otherwise(F.lit(True)),
            "cells": F.when(quoted, F.transform(split(masked), lambda c: _unmask(c, F.col("delimiter")))).otherwise(split(F.col("text"))),
        }
    ).drop("parts")


def headers(raw: DataFrame) -> DataFrame:
    """(file_id, delimiter, columns) of each file, from its line 1."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce("line", F.lit("")), "^\ufeff+", ""), "\r$", "")
    count = lambda d: F.length(text) - F.length(F.replace(text, F.lit(d), F.lit("")))
    most = F.greatest(*[count(d) for d in ",;\t"])
    delimiter = F.when(most == 0, F.lit(",")).when(count(",") == most, F.lit(",")).when(count(";") == most, F.lit(";")).otherwise(F.lit("\t"))
    first = raw.filter(F.col("line_no") == 1).select("file_id", text.alias("text"), delimiter.alias("delimiter"))
    named = parse_cells(first).select("file_id", "delimiter", F.transform("cells", lambda c: F.lower(F.trim(c))).alias("columns"))
    # A file sent with two headers keeps one of them, by a fixed order.
    return named.groupBy("file_id").agg(F.min(F.struct("delimiter", "columns")).alias("h")).select("file_id", "h.*")


def parsed_lines(raw: DataFrame) -> DataFrame:
    """Records after the header with ``rid``, ``delimiter``, ``columns``, ``quoting_ok`` and ``cells``."""
    raw = raw.select("file_id", F.col("line_no").cast("int").alias("line_no"), F.col("line").cast("string").alias("line"))
    body = raw.filter(~F.col("line_no").eqNullSafe(1)).select(
        "file_id", "line_no", F.regexp_replace(F.coalesce("line", F.lit("")), "\r$", "").alias("text")
    )
    part = F.pmod(F.xxhash64("line_no", "text"), F.lit(PARTS))
    heads = headers(raw).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    joined = body.withColumn("part", part).join(heads, ["file_id", "part"], "left").drop("part").withColumns(
        {"delimiter": F.coalesce("delimiter", F.lit(",")), "columns": F.coalesce("columns", F.array().cast("array<string>"))}
    )
    return parse_cells(joined)


def rule_table(df: DataFrame) -> DataFrame:
    """The rule table as rows, a fixed handful."""
    rows = [(i, *rule) for i, rule in enumerate(RULES)]
    return df.sparkSession.createDataFrame(rows, "rule int, rule_kind string, rule_delimiter string, rank int, pattern string, nullable boolean")


def cell_errors(parsed: DataFrame, keys: tuple[str, ...] = ("file_id", "line_no")) -> DataFrame:
    """(keys, column, value, rank) of each cell that violates its rule.

    A record with broken quoting or a wrong number of fields counts as one cell of
    that kind, so one pass over the records finds all errors.
    """
    cell = lambda name, value: F.struct(name.alias("name"), value.alias("value"))
    whole = lambda kind: F.array(cell(F.lit(kind), F.col("text")))
    pairs = (
        F.when(~F.col("quoting_ok"), whole("quoting"))
        .when(F.size("cells") != F.size("columns"), whole("columns"))
        .otherwise(F.zip_with("columns", "cells", lambda n, v: cell(n, v)))
    )
    cells = parsed.select(
        *keys,
        "delimiter",
        (F.col("quoting_ok") & (F.size("cells") == F.size("columns"))).alias("parsed"),
        F.explode(pairs).alias("cell"),
    ).select(*keys, "delimiter", "parsed", "cell.name", "cell.value")
    kind = F.when(~F.col("parsed") | F.col("name").isin("ts", "status", "note"), F.col("name")).otherwise(F.lit("number"))
    value = F.btrim("value", F.lit(" \t"))
    # The rule of a cell is looked up in the table; its pattern is a literal here, so that it is compiled once.
    fits = F.lit(False)
    for i, (name, _, _, pattern, _) in enumerate(RULES):
        if name in REASONS:
            continue
        ok = F.lit(True) if pattern is None else value.rlike(f"^(?:{pattern})$")
        if name == "ts":
            # The first of the month is a date; days past 28 are looked up.
            ok &= (F.substring(value, 9, 2) <= "28") | (F.dayofmonth(F.last_day(F.try_to_date(F.concat(F.substring(value, 1, 8), F.lit("01"))))) >= F.substring(value, 9, 2).try_cast("int"))
        fits = F.when(F.col("rule") == i, ok).otherwise(fits)
    valid = F.when(value.isin(*NULL_TEXTS), F.col("nullable")).otherwise(F.coalesce(fits, F.lit(False)))
    return (
        cells.withColumn("kind", kind)
        .join(
            F.broadcast(rule_table(parsed)),
            (F.col("kind") == F.col("rule_kind")) & (F.col("rule_delimiter").isNull() | (F.col("rule_delimiter") == F.col("delimiter"))),
        )
        .filter(~valid)
        .select(*keys, F.col("name").alias("column"), "value", "rank")
    )


def bad_lines(raw: DataFrame) -> DataFrame:
    """(file_id, line_no, reason) of each record that can't be loaded, with the first reason that fits."""
    first = cell_errors(parsed_lines(raw)).groupBy("file_id", "line_no").agg(F.min("rank").alias("rank"))
    return first.select("file_id", "line_no", F.element_at(F.array(*map(F.lit, REASONS)), F.col("rank") + 1).alias("reason"))


def _good(raw: DataFrame) -> DataFrame:
    """The parsed records that the anti-join with the bad ones keeps."""
    parsed = parsed_lines(raw)
    keys = ("file_id", "line_no", "text")
    bad = cell_errors(parsed, keys).select(*[F.col(k).alias(f"bad_{k}") for k in keys]).distinct()
    same = F.col("file_id").eqNullSafe(F.col("bad_file_id")) & F.col("line_no").eqNullSafe(F.col("bad_line_no"))
    return parsed.join(bad, same & (F.col("line_no").isNotNull() | (F.col("text") == F.col("bad_text"))), "left_anti")


def _value(cell: Column) -> Column:
    text = F.btrim(cell, F.lit(" \t"))
    return F.when(~text.isin(*NULL_TEXTS), text)


def clean_lines(raw: DataFrame) -> DataFrame:
    """The valid records as (file_id, line_no, values array<struct<column, value>>) in the order of the header, nulls for the null texts."""
    pairs = F.zip_with("columns", "cells", lambda n, c: F.struct(n.alias("column"), _value(c).alias("value")))
    return _good(raw).select("file_id", "line_no", pairs.alias("values"))


def loaded_cells(raw: DataFrame) -> DataFrame:
    """(file_id, line_no, position, column, value) of each cell of the valid records, position from 1."""
    cells = _good(raw).select("file_id", "line_no", "columns", F.posexplode("cells").alias("i", "cell"))
    return cells.select("file_id", "line_no", (F.col("i") + 1).alias("position"), F.get("columns", F.col("i")).alias("column"), _value(F.col("cell")).alias("value"))
