"""Labelled delimited text: one record per line, fields separated by one comma or one space, ``?`` for missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearspark.operators.roles import Attributes
from nearspark.session import cut_lineage

SEPARATOR = "[, ]"
MISSING = "?"
MODES = ("dropmalformed", "failfast", "permissive")

CONTROL_AND_BLANK = "".join(chr(c) for c in range(1, 33))


def read_lines(spark: SparkSession, path: str | list[str], whole_path: bool = False) -> DataFrame:
    """Lines of text files: ``value``, ``input_file`` (name or path), ``line`` (from 0 in its file), ``id`` (over all files).

    Files are read in splits, each a run of lines of one file. Lines are written with their place in the split; numbers
    are that place plus the sizes of the earlier splits, so nothing is sorted and a retry cannot change a number.
    """
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_name").alias("input_file"),
        F.col("_metadata.file_block_start").alias("__block"),
    )
    raw = cut_lineage(raw.withColumn("__place", F.monotonically_increasing_id()))
    split = ["__file", "__block"]
    sizes = raw.groupBy(*split).agg(F.count("*").alias("n"), F.min("__place").alias("__first"))
    order = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    in_file = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *split, "__first", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("__all"),
        F.coalesce(F.sum("n").over(in_file), F.lit(0)).alias("__own"),
    )
    place = F.col("__place") - F.col("__first")
    name = F.col("__file") if whole_path else F.col("input_file")
    return raw.join(starts, split).select(
        "value", name.alias("input_file"), (F.col("__own") + place).alias("line"), (F.col("__all") + place).alias("id")
    )


def tokens_of(value: Column | str) -> Column:
    """Fields of a line; separators at the end of the line do not open further fields."""
    value = F.col(value) if isinstance(value, str) else value
    return F.split(F.regexp_replace(value, f"{SEPARATOR}+$", ""), SEPARATOR)


def _token(position: int) -> Column:
    return F.btrim(F.get("tokens", F.lit(position)), F.lit(CONTROL_AND_BLANK))


def line_status(value: Column, attributes: Attributes) -> Column:
    """``empty``, ``arity``, ``missing``, ``malformed`` or ``ok``, tested in this order on the ``tokens`` column."""
    missing, malformed = F.lit(False), F.lit(False)
    for i, _, role in attributes.kept:
        missing = missing | (_token(i) == MISSING)
        if attributes.is_numeric(role):
            malformed = malformed | _token(i).try_cast("double").isNull()
    return (
        F.when(value == "", "empty")
        .when(F.size("tokens") != len(attributes.roles), "arity")
        .when(missing, "missing")
        .when(malformed, "malformed")
        .otherwise("ok")
    )


def with_status(lines: DataFrame, attributes: Attributes, value: str = "value") -> DataFrame:
    """Add the line's ``tokens`` and its ``status``.

    The tokens go through ``explode`` of a one-element array: a filter is not moved below it, so each line is split
    once and not again for every token that a filter looks at.
    """
    lines = lines.select("*", F.explode(F.array(tokens_of(value))).alias("tokens"))
    return lines.withColumn("status", line_status(F.col(value), attributes))


def drop_empty(lines: DataFrame, value: str = "value") -> DataFrame:
    return lines.where(F.col(value) != "")


def parse_lines(
    lines: DataFrame,
    attributes: Attributes,
    value: str = "value",
    mode: str = "dropmalformed",
    keep_missing: bool = False,
) -> DataFrame:
    """Typed columns of the records in ``value``; the other columns of ``lines`` are passed through.

    Empty lines are skipped, and so are records with a missing value unless ``keep_missing``, which turns missing
    values into NULL (for query rows that stay in the output without a prediction). Records with a wrong number of
    fields or a bad number are dropped (``dropmalformed``), end the job (``failfast``), or are kept with NULLs and
    their ``status`` (``permissive``).
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}, expected one of {MODES}")
    rows = with_status(lines, attributes, value).where(F.col("status") != "empty")
    if not keep_missing:
        rows = rows.where(F.col("status") != "missing")
    if mode == "dropmalformed":
        rows = rows.where(~F.col("status").isin("arity", "malformed"))
    elif mode == "failfast":
        bad = F.col("status").isin("arity", "malformed")
        message = F.concat(F.lit("bad record ("), F.col("status"), F.lit("): "), F.col(value))
        rows = rows.withColumn("status", F.when(bad, F.raise_error(message)).otherwise(F.col("status")))
        rows = rows.where(F.col("status").isNotNull())
    passed = [c for c in lines.columns if c != value] + (["status"] if mode == "permissive" else [])
    typed = []
    for i, name, role in attributes.kept:
        token = F.nullif(_token(i), F.lit(MISSING))
        typed.append((token.try_cast("double") if attributes.is_numeric(role) else token).alias(name))
    return rows.select(*passed, *typed)


def read_header(lines: DataFrame, value: str = "value") -> DataFrame:
    """Ordered class dictionary ``(label, code)`` from the class attribute's line of a header text."""
    listed = F.regexp_extract(F.col(value), r"(?i)@attribute\s+class\s*\{([^}]*)\}", 1)
    names = F.split(F.regexp_replace(listed, " ", ""), ",")
    found = lines.where(F.col(value).rlike(r"(?i)@attribute\s+class\s*\{"))
    return found.select(F.posexplode(names).alias("code", "label")).select("label", "code")
