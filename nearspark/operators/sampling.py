"""Random samples that are exact in size and repeatable: every draw is a hash of a seed and a row id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearspark.functions.vectors import draw
from nearspark.operators.rowid import with_row_id

DRAW_BITS = 60


def _draw_counts(df: DataFrame, seed: int) -> DataFrame:
    """How often each of N row ids is drawn in N draws with replacement."""
    rows = df.count()
    spark = df.sparkSession
    if rows == 0:
        return spark.createDataFrame([], "row_id bigint, times bigint")
    drawn = spark.range(rows).select(F.pmod(draw(seed, "id"), F.lit(rows)).alias("row_id"))
    return drawn.groupBy("row_id").agg(F.count("*").alias("times"))


def bagging(df: DataFrame, order_cols: list[str], seed: int) -> DataFrame:
    """N of N rows drawn with replacement; a row appears as often as it was drawn. Keeps the ``row_id``."""
    flagged = bagging_flags(df, order_cols, seed).where("sampled")
    copies = F.sequence(F.lit(1), F.col("times").cast("int"))
    return flagged.withColumn("__copy", F.explode(copies)).drop("__copy", "times", "sampled")


def bagging_flags(df: DataFrame, order_cols: list[str], seed: int) -> DataFrame:
    """Every row with its ``row_id``, the number of ``times`` it was drawn and whether it was ``sampled``."""
    numbered = with_row_id(df, order_cols)
    joined = numbered.join(_draw_counts(df, seed), "row_id", "left")
    return joined.withColumn("times", F.coalesce("times", F.lit(0))).withColumn("sampled", F.col("times") > 0)


def out_of_bag(df: DataFrame, order_cols: list[str], seed: int) -> DataFrame:
    """Rows that the same bagging call did not draw."""
    return bagging_flags(df, order_cols, seed).where(~F.col("sampled")).drop("times", "sampled")


def random_split(df: DataFrame, id_col: str, take: int, seed: int, drawn: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Exactly ``take`` rows drawn without replacement, and the rest. ``id_col`` must be unique.

    The rows with the lowest draws are taken. Counting draws by their leading bits finds the draw at which the
    ``take``-th row lies, so both parts are plain filters: no sort and no shuffle of the table. ``drawn`` names a column
    of ``df`` that holds the draws already.
    """
    if take < 0:
        raise ValueError("take must not be negative")
    key = F.struct((F.col(drawn) if drawn else draw(seed, id_col)).alias("d"), F.col(id_col).alias("i"))
    last = _nth_draw(df.select(key.alias("key")).select("key.*"), take)
    if take == 0:
        taken = F.lit(False)
    elif last is None:
        taken = F.lit(True)
    else:
        last_id = F.lit(last["i"]).cast(df.schema[id_col].dataType)
        taken = key <= F.struct(F.lit(last["d"]).cast("bigint").alias("d"), last_id.alias("i"))
    return df.where(taken), df.where(~taken)


def _nth_draw(draws: DataFrame, n: int, bits: int = 12, small: int = 10_000):
    """The n-th smallest ``(d, i)`` row, or None when there are fewer: narrow a bit prefix, then sort what is left."""
    if n == 0:
        return None
    shift, inside = DRAW_BITS, draws
    while True:
        shift = max(0, shift - bits)
        prefix: Column = F.shiftright("d", shift)
        counts = sorted(tuple(r) for r in inside.groupBy(prefix.alias("p")).count().collect())  # at most 2**bits rows
        for p, count in counts:
            if n <= count:
                break
            n -= count
        else:
            return None
        inside = inside.where(prefix == p)
        if count <= small:
            rows = sorted(inside.collect())
            if len(set(rows)) < len(rows):
                raise ValueError("ids are not unique")
            return rows[n - 1]
        if shift == 0:
            raise ValueError("ids are not unique")
