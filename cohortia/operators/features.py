"""Preparing a training frame: fill, encode, split, describe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType, StringType

from cohortia.functions.text import UNKNOWN
from cohortia.session import scratch_path, stored
from cohortia.sources.ordered import read_ordered, with_row_numbers, write_ordered

MEDIAN_ACCURACY = 10_000
EDGES = 63
NO_VALUE = "None"
TRAIN_SHARE = 80


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, StringType)]


def present(df: DataFrame, name: str) -> Column:
    """The column, with NaN as missing."""
    value = F.col(name)
    return F.nanvl(value, F.lit(None)) if isinstance(df.schema[name].dataType, (DoubleType, FloatType)) else value


def cells(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """The columns as (column_name, value) rows."""
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), present(df, c).cast(kind).alias("value")) for c in columns])))


def placed(value: Column, edges: list[float]) -> Column:
    """Place of a value among sorted edges: 2 i before edge i, 2 i + 1 on it."""
    def among(begin: int, end: int) -> Column:
        if begin == end:
            return F.lit(2 * begin)
        middle = (begin + end) // 2
        edge = F.lit(edges[middle])
        return F.when(value < edge, among(begin, middle)).when(value == edge, 2 * middle + 1).otherwise(among(middle + 1, end))

    return among(0, len(edges))


def exact_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact medians by narrowing histograms: nothing is sorted, no task and not the driver holds a column.

    A mergeable sketch gives EDGES values that cut what is left of a column into parts of about equal
    size. One aggregation counts the rows on and between the edges, with their least and
    largest value; the part that holds the middle is cut next. A value that many rows share becomes
    an edge and ends the search, so each round leaves about one in EDGES / 2 rows, whatever the distribution.
    """
    found: dict[str, float | None] = dict.fromkeys(columns)
    value = {c: present(df, c).cast("double") for c in columns}
    # What is left of a column: values between two that are out, and the rows up to the lower one.
    left = {c: (None, None, 0) for c in columns}
    ranks: dict[str, tuple[int, int]] = {}

    def inside(c: str) -> Column:
        low, high, _ = left[c]
        kept = value[c] if low is None else F.when(value[c] > F.lit(low), value[c])
        return kept if high is None else F.when(value[c] < F.lit(high), kept)

    while left:
        shares = [(i + 1) / (EDGES + 1) for i in range(EDGES)]
        cut = df.agg(*[F.percentile_approx(inside(c), shares, MEDIAN_ACCURACY).alias(c) for c in left]).first()
        edges = {c: sorted(set(cut[c])) for c in left if cut[c]}
        if not edges:
            break
        parts = df.select(F.inline(F.array(*[F.struct(
            F.lit(c).alias("column_name"), inside(c).alias("value"), placed(value[c], edges[c]).alias("part")) for c in edges])))
        counts = parts.where(F.col("value").isNotNull()).groupBy("column_name", "part").agg(
            F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).orderBy("column_name", "part").collect()
        for c in edges:
            own = [r for r in counts if r["column_name"] == c]
            total = sum(r["n"] for r in own)
            lower, upper = ranks.setdefault(c, ((total + 1) // 2, total // 2 + 1))
            before, holds = left[c][2], {}
            for r in own:
                for rank in (lower, upper):
                    if before < rank <= before + r["n"]:
                        holds[rank] = (r, before)
                before += r["n"]
            (first, below), (second, _) = holds[lower], holds[upper]
            if first is not second:  # neighbouring ranks in two parts: the end of one, the beginning of the other
                found[c] = (first["high"] + second["low"]) / 2
            elif first["low"] == first["high"]:
                found[c] = first["low"]
            else:
                place = first["part"] // 2
                own_edges = edges[c]
                left[c] = (own_edges[place - 1] if place else left[c][0], own_edges[place] if place < len(own_edges) else left[c][1], below)
        left = {c: bounds for c, bounds in left.items() if c in edges and found[c] is None}
    return found


def modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent text per column, the smallest on ties, ``Unknown`` if there is none.

    Counted per value first, so no task holds all values of a column.
    """
    if not columns:
        return {}
    counts = cells(df, columns, "string").where(F.col("value").isNotNull()).groupBy(
        "column_name", "value").agg(F.count("*").alias("n"))
    best = counts.groupBy("column_name").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode")).collect()
    return {**dict.fromkeys(columns, UNKNOWN), **{row["column_name"]: row["mode"] for row in best}}


def clean_data(df: DataFrame) -> DataFrame:
    """Drop repeated rows, then fill numbers by median and text by mode.

    The rows left are stored once; the passes that find what to fill in read
    single columns of the stored table.
    """
    rows = stored(df.dropDuplicates(), "deduplicated")
    missing = rows.agg(*[F.count_if(present(rows, c).isNull()).alias(c) for c in rows.columns]).first()
    numbers = [c for c in numeric_columns(rows) if missing[c]]
    texts = [c for c in text_columns(rows) if missing[c]]
    fills = {c: v for c, v in exact_medians(rows, numbers).items() if v is not None}
    fills.update(modes(rows, texts))
    rows = rows.withColumns({c: F.col(c).cast("double") for c in numbers})
    return rows.na.fill(fills) if fills else rows


def label_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, code): place of each distinct text in sorted order, from 0.

    The distinct values of all columns are found in one pass, range sorted and
    stored; their codes follow from the stored positions.
    """
    values = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"),
                 F.coalesce(F.col(c).cast("string"), F.lit(NO_VALUE)).alias("value"))
        for c in columns]))).distinct()
    path = scratch_path(df.sparkSession, "codes")
    write_ordered(values, ["column_name", "value"], path)
    numbered = with_row_numbers(read_ordered(df.sparkSession, path))
    first = numbered.groupBy("column_name").agg(F.min("row_no").alias("first_row"))
    return numbered.join(F.broadcast(first), "column_name").select(  # one row per column
        "column_name", "value", (F.col("row_no") - F.col("first_row")).alias("code"))


def encode_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``<column>_encoded`` for every named column that is there."""
    named = [c for c in columns if c in df.columns]
    if not named:
        return df
    # Stored by column, so that Spark sees the size of each list it joins.
    path = scratch_path(df.sparkSession, "code-lists")
    label_codes(df, named).withColumn("list", F.array_position(F.array(*map(F.lit, named)), F.col("column_name"))).drop(
        "column_name").write.partitionBy("list").parquet(path)
    codes = df.sparkSession.read.schema("value string, code bigint, list int").parquet(path)
    for number, c in enumerate(named, 1):
        one = codes.where(F.col("list") == number).select(
            F.col("value").alias("code_value"), F.col("code").alias(f"{c}_encoded"))
        text = F.coalesce(F.col(c).cast("string"), F.lit(NO_VALUE))
        df = df.join(one, text == F.col("code_value"), "left").drop("code_value")
    return df


def split_bucket(keys: list[str]) -> Column:
    """A number from 0 to 99 that depends on the row's content alone."""
    digest = F.substring(F.md5(F.concat_ws("|", *keys)), 1, 8)
    return F.conv(digest, 16, 10).cast("bigint") % 100


def train_test_split(df: DataFrame, keys: list[str], train_share: int = TRAIN_SHARE) -> tuple[DataFrame, DataFrame]:
    """Split by content, so that the parts do not depend on how rows are partitioned."""
    bucket = split_bucket(keys)
    return df.where(bucket < train_share), df.where(bucket >= train_share)


def feature_summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns, numeric and text columns, missing values."""
    missing = sum((F.count_if(present(df, c).isNull()) for c in df.columns), F.lit(0))
    return df.agg(
        F.count("*").alias("total_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        F.lit(len(numeric_columns(df))).cast("bigint").alias("numeric_columns"),
        F.lit(len(text_columns(df))).cast("bigint").alias("categorical_columns"),
        missing.cast("bigint").alias("missing_values"))
