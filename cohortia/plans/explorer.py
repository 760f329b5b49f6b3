"""The programme-plan explorer: display columns, snapshot, options, search, pages."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType

from cohortia.plans.programme import PLAN_ORDER
from cohortia.sources.ordered import PART, POSITION, read_ordered, write_ordered

# Display names, in display order, of the plan columns.
DISPLAY_NAMES = {
    "ca_name": "CA Name",
    "prog_code": "Prog Code",
    "prog_name": "Prog Name",
    "aim": "Aim",
    "level_desc": "Level",
    "site": "Site",
    "course_id": "Course ID",
    "start_date": "Start",
    "end_date": "End",
    "main_qual_glh": "Main Qual GLH",
    "tutorial_hours": "Tutorial Hours",
    "blended_hours": "Blended Hours",
    "review_hours": "Review Hours",
    "as_hours": "As Hours",
    "groups_2021_22": "2021-22 Groups",
    "groups_2022_23": "2022-23 Groups",
    "actual_16_18_21_22": "16-18 Actual (21/22)",
    "aeb_actual_21_22": "AEB Actual (21/22)",
    "fcr_actual_21_22": "FCR Actual (21/22)",
    "total_actual_learners_21_22": "Total Actual Learners (21/22)",
    "target_16_18_22_23": "16-18 Target (22/23)",
    "aeb_target_22_23": "AEB Target (22/23)",
    "total_target_learners_22_23": "Total Target Learners (22/23)",
    "cs_risk_rating": "CS Risk rating",
    "total_income_22_23": "Total Income (22/23)",
    "total_costs": "Total Costs",
    "contribution_pct": "Contribution %",
    "infill_parent_prog_code": "Infill Parent Prog Code",
    "parent": "Parent",
    "approval_status": "Approval Status",
}
COMPAT_COLUMNS = list(DISPLAY_NAMES.values())
INFILL = "Infill"
ZERO_WHEN_MISSING = ("Main Qual GLH", "Blended Hours", "Tutorial Hours")
NUMERIC_COLUMNS = (
    "2021-22 Groups", "2022-23 Groups", "16-18 Actual (21/22)", "AEB Actual (21/22)",
    "FCR Actual (21/22)", "Total Actual Learners (21/22)", "16-18 Target (22/23)",
    "AEB Target (22/23)", "Total Target Learners (22/23)", "Total Income (22/23)",
    "Total Costs", "Contribution %", "As Hours",
)
# Quick filters: preferred columns and the most values they may have.
QUICK_FILTERS = (
    ("Approval Status", 25), ("Infill", 12), ("Site", 60), ("Level", 25), ("Parent", 30),
    ("CA Name", 100),
)
QUICK_FILTER_COUNT = 6
QUICK_FILTER_FALLBACK = (2, 20)

PAGE_SIZES = (50, 100, 250, 500)
DEFAULT_PAGE_SIZE, LARGEST_PAGE_SIZE = 100, 500


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def display_order(columns: list[str]) -> list[str]:
    """The plan's total order in display names, as far as the columns go."""
    names = [{**DISPLAY_NAMES, "infill": INFILL}[name] for name in PLAN_ORDER]
    return [name for name in names if name in columns]


def compat_rows(plans: DataFrame) -> DataFrame:
    """Display names, missing columns added, numbers coerced, nameless rows dropped."""
    names = {column.strip().lower(): column for column in plans.columns}
    target = {**DISPLAY_NAMES, "infill": INFILL}

    def column(source: str, display: str) -> Column:
        found = names.get(source, names.get(display.lower()))
        value = quoted(found) if found else F.lit(None).cast("string")
        kind = plans.schema[found].dataType if found else StringType()
        if display in ZERO_WHEN_MISSING + NUMERIC_COLUMNS and isinstance(kind, StringType):
            value = value.try_cast("double")
        if display in ZERO_WHEN_MISSING:
            value = F.coalesce(value, F.lit(0).cast("bigint"))
        return value.alias(display)

    rows = plans.select(*[column(source, display) for source, display in target.items()])
    return rows.dropna(how="all", subset=["CA Name", "Prog Name"])


def compat_data(
    rows: DataFrame, infill: str | None = None, approval_status: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """The 30 display columns, of all rows or of the first ``limit`` in plan order."""
    for name, value in ((INFILL, infill), ("Approval Status", approval_status)):
        if value is not None and str(value).strip():
            rows = rows.where(F.trim(quoted(name).cast("string")) == F.lit(str(value).strip()))
    if limit is not None and limit > 0:
        rows = rows.orderBy(*[quoted(n) for n in display_order(rows.columns)]).limit(limit)
    return rows.select(*[quoted(name) for name in COMPAT_COLUMNS])


def as_text(rows: DataFrame) -> DataFrame:
    """Every column as text, NULL as the empty string, floats with all their digits.

    A float is written without an exponent wherever that keeps its value.
    """
    def text(field) -> Column:
        value = quoted(field.name)
        shown = value.cast("string")
        if isinstance(field.dataType, (DoubleType, FloatType)):
            plain = value.try_cast("decimal(38,18)")
            kept = F.contains(shown, F.lit("E")) & (plain.cast(field.dataType) == value)
            shown = F.when(kept, F.regexp_replace(plain.cast("string"), r"(\.[0-9]+?)0+$", "$1")).otherwise(shown)
        return F.coalesce(shown, F.lit("")).alias(field.name)

    return rows.select(*[text(field) for field in rows.schema])


# -- snapshot ----------------------------------------------------------------

@dataclass(frozen=True)
class Snapshot:
    """All-text plan rows in a fixed order, stored with their positions."""

    spark: SparkSession
    path: str

    @classmethod
    def write(cls, rows: DataFrame, path: str) -> Snapshot:
        """Store display rows; the path must be new, readers of older ones go on."""
        text = as_text(rows)
        write_ordered(text, display_order(text.columns), path)
        return cls(rows.sparkSession, path)

    @property
    def numbered(self) -> DataFrame:
        return read_ordered(self.spark, self.path)

    @property
    def rows(self) -> DataFrame:
        return self.numbered.drop(PART, POSITION)

    def info(self) -> DataFrame:
        files = self.numbered
        width = len(files.columns) - 2
        return files.select(F.col("_metadata.file_modification_time").alias("modified")).agg(
            F.lit("Programme Plans Dataset").alias("name"),
            F.count("*").alias("row_count"),
            F.lit(width).cast("bigint").alias("column_count"),
            F.date_format(F.max("modified"), "yyyy-MM-dd HH:mm:ss").alias("last_modified"),
            F.lit("snapshot").alias("source"),
        )


# Line breaks in a cell are written as codes, so that one row stays on one line and files can be split.
LINE_CODES = (("\\", "\\b"), ("\n", "\\n"), ("\r", "\\r"))


def _coded(value: Column, codes) -> Column:
    for text, code in codes:
        value = F.replace(value, F.lit(text), F.lit(code))
    return value


def write_text_csv(rows: DataFrame, path: str) -> None:
    """CSV that keeps blanks, quotes and line breaks; for exchange with other tools."""
    coded = rows.select(*[_coded(quoted(name), LINE_CODES).alias(name) for name in rows.columns])
    (
        coded.write.option("header", True).option("escape", '"').option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text, nothing inferred, missing values as the empty string."""
    rows = (
        spark.read.option("header", True).option("escape", '"').option("multiLine", False)
        .csv(path)
    )
    back = [(code, text) for text, code in reversed(LINE_CODES)]
    return rows.na.fill("").select(*[_coded(quoted(name), back).alias(name) for name in rows.columns])


# -- options -----------------------------------------------------------------

def filter_values(text_rows: DataFrame) -> DataFrame:
    """Distinct trimmed non-blank values of every column, as (column, value) rows."""
    cells = F.array(*[
        F.struct(F.lit(name).alias("column_name"), F.trim(quoted(name)).alias("value"))
        for name in text_rows.columns])
    return text_rows.select(F.inline(cells)).where(F.col("value") != "").distinct()


def filter_counts(text_rows: DataFrame) -> DataFrame:
    """Number of values per column, 0 for empty columns, with the column's place."""
    counted = filter_values(text_rows).groupBy("column_name").agg(F.count("*").alias("n"))
    names = text_rows.sparkSession.createDataFrame(
        list(enumerate(text_rows.columns)), "column_position int, column_name string")
    return names.join(counted, "column_name", "left").select(
        "column_name", "column_position", F.coalesce("n", F.lit(0)).alias("unique_count"))


def quick_filters(counts: DataFrame) -> DataFrame:
    """At most six columns: preferred ones within their ceiling, then short ones."""
    low, high = QUICK_FILTER_FALLBACK
    n, name = F.col("unique_count"), F.col("column_name")
    rank = F.when(n.between(low, high), 1000 + F.col("column_position"))
    for place, (column, ceiling) in enumerate(QUICK_FILTERS):
        rank = F.when((name == column) & n.between(1, ceiling), place).otherwise(rank)
    ranked = counts.withColumn("rank", rank).where(F.col("rank").isNotNull())
    chosen = ranked.orderBy("rank").limit(QUICK_FILTER_COUNT)
    position = F.row_number().over(Window.orderBy("rank"))  # six rows
    return chosen.select("column_name", "unique_count", position.alias("quick_position"))


# -- search and pages --------------------------------------------------------

def search_rows(text_rows: DataFrame, search: str | None = None, filters: dict | None = None) -> DataFrame:
    """Equality per known column, then a case-insensitive substring in any column."""
    hidden = {PART, POSITION}
    known = [name for name in text_rows.columns if name not in hidden]
    for name, value in (filters or {}).items():
        if str(name).strip() in known:
            wanted = "" if value is None else str(value).strip()
            text_rows = text_rows.where(F.trim(F.coalesce(quoted(str(name).strip()), F.lit(""))) == F.lit(wanted))
    needle = str(search or "").strip().lower()
    if needle:
        hits = [F.contains(F.lower(F.coalesce(quoted(name), F.lit(""))), F.lit(needle)) for name in known]
        text_rows = text_rows.where(reduce(Column.__or__, hits))
    return text_rows


def check_page(page: int, page_size: int) -> tuple[int, int]:
    if page_size > LARGEST_PAGE_SIZE:
        raise ValueError(f"page_size must be less than or equal to {LARGEST_PAGE_SIZE}")
    return max(int(page), 1), max(int(page_size), 1)


def page_info(rows: DataFrame, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """One row of totals; the page is clamped to the last one."""
    page, page_size = check_page(page, page_size)
    total = F.col("total_rows")
    counted = rows.agg(F.count("*").alias("total_rows"))
    shown = counted.select(
        "*", F.greatest(F.lit(1), F.ceil(total / page_size)).cast("bigint").alias("total_pages"))
    shown = shown.select("*", F.least(F.lit(page), "total_pages").cast("bigint").alias("page"))
    start = (F.col("page") - 1) * page_size
    return shown.select(
        "page",
        F.lit(page_size).cast("bigint").alias("page_size"),
        "total_rows",
        "total_pages",
        (F.col("page") > 1).alias("has_previous"),
        (F.col("page") < F.col("total_pages")).alias("has_next"),
        F.when(total > 0, start + 1).otherwise(0).alias("start_row"),
        F.least(start + page_size, total).alias("end_row"),
    )


def page_rows(
    snapshot: Snapshot, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE,
    search: str | None = None, filters: dict | None = None,
) -> DataFrame:
    """Rows of one page in stored order.

    Matching rows are counted per stored partition, which tells the one or
    few partitions that hold the page, however deep it lies. Only those are
    read again; nothing before the page is sorted or moved.
    """
    page, page_size = check_page(page, page_size)
    matching = search_rows(snapshot.numbered, search, filters)
    # One small row per stored partition.
    counts = sorted((r[PART], r["count"]) for r in matching.groupBy(PART).count().collect())
    total = sum(n for _, n in counts)
    first = (min(page, max(1, ceil(total / page_size))) - 1) * page_size
    last = first + page_size

    before, starts = 0, {}
    for part, n in counts:
        if before < last and before + n > first:
            starts[part] = before
        before += n
    columns = snapshot.rows.columns
    if not starts:
        return matching.limit(0).select(*[quoted(name) for name in columns])
    rank = F.row_number().over(Window.partitionBy(PART).orderBy(POSITION))
    base = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])[F.col(PART)]
    place = base + F.col("rank_in_part")
    return (
        matching.where(F.col(PART).isin(list(starts)))
        .withColumn("rank_in_part", rank)
        .where((place > first) & (place <= last))
        .select(*[quoted(name) for name in columns])
    )
