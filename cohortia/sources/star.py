"""The enrolment star schema as Spark frames.

``Star`` reads a warehouse that is stored as one Parquet folder per table.
``TableStar`` (see ``tables.py``) gives the same interface over the raw tables.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession

YEAR, PROVIDER = "dim_academic_year", "dim_provider"
SSA, LEVEL, AGE = "dim_ssa", "dim_level", "dim_age"
DELIVERY, AIM, LEARNER = "dim_learning_delivery", "dim_learning_aim", "dim_learner"

DIMENSION_KEYS = {
    YEAR: "academic_year_skey",
    PROVIDER: "provider_skey",
    SSA: "ssa_skey",
    LEVEL: "level_skey",
    AGE: "age_skey",
    DELIVERY: "learning_delivery_skey",
    AIM: "learning_aim_skey",
    LEARNER: "learner_skey",
}

DIMENSION_OF = {key: name for name, key in DIMENSION_KEYS.items()}

ENROLMENT_COLUMNS = (
    "learner_skey", "provider_skey", "academic_year_skey", "learning_aim_skey", "ssa_skey",
    "level_skey", "age_skey", "learning_delivery_skey", "enrolment_count",
    "guided_learning_hours", "start_date", "planned_end_date", "actual_end_date",
)

COST_COLUMNS = (
    "staff_costs", "teaching_costs", "teaching_support_costs", "administration_costs",
    "operational_maintenance_costs", "examination_costs", "rent_and_lease_costs",
)

Years = tuple[int | None, int | None] | DataFrame


class Star:
    """A stored star schema. Surrogate keys are unique in their dimension."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str) -> DataFrame:
        """A stored table; its files are listed once per star."""
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(self.path(name))
        return self._frames[name]

    def dim(self, name: str, *columns: str | Column) -> DataFrame:
        """A dimension: its key and the named columns, or all of it."""
        frame = self.table(name)
        return frame.select(DIMENSION_KEYS[name], *columns) if columns else frame

    def side(self, key: str, side: DataFrame | list) -> DataFrame:
        """A frame as it is, a list of columns as these columns of the key's dimension."""
        return self.dim(DIMENSION_OF[key], *side) if isinstance(side, list) else side

    def keys_of(self, name: str) -> DataFrame:
        """The key alone, to keep only facts whose member exists."""
        return self.dim(name).select(DIMENSION_KEYS[name])

    def accounts(self, years: Years = (None, None)) -> DataFrame:
        """Account rows; ``years`` may be left out of account, it only saves reading."""
        return self.table("fact_account")

    def enrolments(
        self,
        columns: Iterable[str],
        inner: Iterable[tuple[str, DataFrame]] = (),
        left: Iterable[tuple[str, DataFrame | list]] = (),
        years: Years = (None, None),
    ) -> DataFrame:
        """Enrolment rows with the named fact columns and those of the joined frames.

        ``inner`` and ``left`` hold (key, frame) pairs; in ``left`` a list stands for these
        columns of the key's whole dimension, which a source may also work out without a join.
        Inner ones come first, so that the fact shrinks first; a fact stored by academic year is
        pruned through them. ``years`` repeats a range of start years that the
        frames already apply, for sources that can push it into the scan: two
        numbers, or a frame of one row with the first and the last year.
        """
        columns, inner = list(columns), list(inner)
        left = [(key, self.side(key, side)) for key, side in left]
        keys = [key for key, _ in (*inner, *left)]
        rows = self.table("fact_enrolment").select(*dict.fromkeys([*columns, *keys]))
        for key, frame in inner:
            rows = rows.join(frame, key)
        for key, frame in left:
            rows = rows.join(frame, key, "left")
        attributes = [name for key, frame in (*inner, *left) for name in frame.columns if name != key]
        return rows.select(*dict.fromkeys([*columns, *attributes]))


def frames(star: Star) -> dict[str, DataFrame]:
    """All tables of a star by name."""
    return {
        "fact_enrolment": star.enrolments(ENROLMENT_COLUMNS),
        "fact_account": star.accounts(),
        **{name: star.dim(name) for name in DIMENSION_KEYS},
    }


def run_sql(star: Star, text: str, **arguments) -> DataFrame:
    """SQL over the star's tables; ``:name`` parameters are bound, never pasted in."""
    tables = frames(star)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    try:
        return star.spark.sql(text, args=arguments)  # resolved at once, so the views can go
    finally:
        for name in tables:
            star.spark.catalog.dropTempView(name)


def store_star(star: Star, folder: str) -> Star:
    """Write a star once as Parquet, both facts by academic year.

    Later queries then join no raw tables, and a range of years reads only its
    folders. Rebalancing splits years that hold most of the rows over several
    files instead of giving each year to one task.
    """
    year = DIMENSION_KEYS[YEAR]
    for name, df in frames(star).items():
        if name.startswith("fact_"):
            df.hint("rebalance", year).write.partitionBy(year).parquet(f"{folder}/{name}")
        else:
            df.write.parquet(f"{folder}/{name}")
    return Star(star.spark, folder)
