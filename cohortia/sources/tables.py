"""The star schema seen through the raw order tables.

Facts are joined only as far as the asked columns need: the orders
are read for learners and deliveries, the parts for subject areas and levels,
the customers for ages. Members of levels, ages and deliveries are the distinct values
of the raw columns; years are all that a date can name.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.sources.star import (
    AGE, AIM, DELIVERY, DIMENSION_KEYS, LEARNER, LEVEL, PROVIDER, SSA, YEAR, Star, Years,
)

# What raw values stand for; any other value has the last meaning.
FUNDING = {"A": "16-19 (excluding Apprenticeships)", "R": "Adult skills"}
OTHER_FUNDING = "Apprenticeships (from 1 May 2017)"
COMPLETION_CODES = {"A": 2, "R": 3}
OTHER_COMPLETION = 9
AGE_GROUPS = {"BUILDING": "16-18", "FURNITURE": "24-30", "HOUSEHOLD": "31-49", "MACHINERY": "19-23"}
OTHER_AGE = "50+"
NAMED_BANDS = 4          # size bands with a level of their own
YEAR_SHIFT = 20
DATE_YEARS = (1, 9999)   # of the date type
ACADEMIC_START_MONTH = 8
MISSING_SSA_TYPE = "SMALL"

# Where the keys of an enrolment are found.
ON_LINE = ("academic_year_skey", "provider_skey")
FROM_ORDER = {"learner_skey", "learning_delivery_skey", "start_date", "age_skey"}
FROM_PART = {"ssa_skey", "level_skey"}


def _meaning(of: Column, values: dict, other: object) -> Column:
    known = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(known[of], F.lit(other))


def academic_year_of(day: Column) -> Column:
    before_start = F.when(F.month(day) < ACADEMIC_START_MONTH, 1).otherwise(0)
    return F.year(day) + YEAR_SHIFT - before_start


class TableStar(Star):
    """Star views over ``lineitem``, ``orders``, ``part``, ``customer`` and the rest."""

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    # -- facts ---------------------------------------------------------------

    def enrolments(
        self,
        columns: Iterable[str],
        inner: Iterable[tuple[str, DataFrame]] = (),
        left: Iterable[tuple[str, DataFrame | list]] = (),
        years: Years = (None, None),
    ) -> DataFrame:
        """Joined so that the lines are shuffled as rarely and as narrow as possible.

        Frames on keys of the line limit it first. Whatever hangs on a learner
        or a part is joined to the customers or parts beforehand, so that the
        lines meet each of them once, the text of the parts last. Columns of the
        delivery follow from raw values of the row, without a join.
        """
        delivery = DIMENSION_KEYS[DELIVERY]
        left = list(left)
        on_row = [name for key, side in left if key == delivery and isinstance(side, list) for name in side]
        joins = [(key, frame, "inner") for key, frame in inner]
        joins += [(key, self.side(key, side), "left") for key, side in left
                  if not (key == delivery and isinstance(side, list))]
        wanted = list(dict.fromkeys([*columns, *[key for key, _, _ in joins], *([delivery] if on_row else [])]))
        attributes = [name for key, frame, _ in joins for name in frame.columns if name != key] + on_row

        line = self._line_columns()
        need_part = not FROM_PART.isdisjoint(wanted)
        need_order = not FROM_ORDER.isdisjoint(wanted)
        picked = [name for name in wanted if name in line]
        if need_part and "learning_aim_skey" not in picked:
            picked.append("learning_aim_skey")
        extra = ["l_orderkey"] if need_order else []
        if delivery in wanted:
            extra += ["l_returnflag", "l_linestatus"]

        rows = self.table("lineitem")
        for bound in self._ship_date_bounds(years):
            rows = rows.where(bound)
        rows = rows.select(*[line[name].alias(name) for name in picked], *extra)

        def on(*keys: str, how: tuple[str, ...] = ("inner", "left")) -> list:
            return [join for join in joins if join[0] in keys and join[2] in how]

        for key, frame, _ in on(*ON_LINE, how=("inner",)):
            rows = rows.join(frame, key)
        if need_order:
            rows = rows.join(self._order_keys(), "l_orderkey", "left")
        customers = self._customer_keys() if "age_skey" in wanted else None
        rows = self._join_side(rows, "learner_skey", customers, on("age_skey", "learner_skey"))
        parts = self._part_keys() if need_part else None
        rows = self._join_side(rows, "learning_aim_skey", parts, on("ssa_skey", "level_skey", "learning_aim_skey"))
        for key, frame, _ in on(*ON_LINE, how=("left",)):
            rows = rows.join(frame, key, "left")
        if delivery in wanted:
            rows = rows.withColumn(delivery, self._delivery_key())
            known, values = F.col(delivery).isNotNull(), self._delivery_columns()
            rows = rows.withColumns({name: F.when(known, values[name]) for name in on_row})
        for key, frame, how in on(delivery):
            rows = rows.join(frame, key, how)
        return rows.select(*dict.fromkeys([*columns, *attributes]))

    @staticmethod
    def _join_side(rows: DataFrame, key: str, side: DataFrame | None, joins: list) -> DataFrame:
        """Join a raw table together with the frames that hang on it.

        An inner frame makes the whole side inner: the line counts only where
        its member is there.
        """
        if side is None:
            for _, frame, how in joins:
                rows = rows.join(frame, key, how)
            return rows
        kind = "left"
        for frame_key, frame, how in joins:
            side = side.join(frame, frame_key, how)
            kind = "inner" if how == "inner" else kind
        return rows.join(side, key, kind)

    def _order_keys(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("l_orderkey"),
            F.col("o_custkey").alias("learner_skey"),
            F.col("o_orderdate").cast("date").alias("start_date"),
            F.col("o_orderpriority"),
        )

    def _part_keys(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("learning_aim_skey"),
            F.concat_ws("|", "p_type", "p_brand").alias("ssa_skey"),
            F.floor((F.col("p_size") - 1) / 10).cast("int").alias("level_skey"),
        )

    def _customer_keys(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("learner_skey"), F.col("c_mktsegment").alias("age_skey"))

    @staticmethod
    def _line_columns() -> dict[str, Column]:
        number, quantity = F.col("l_linenumber"), F.col("l_quantity")
        shipped = F.col("l_shipdate").cast("date")
        return {
            "provider_skey": F.col("l_suppkey"),
            "academic_year_skey": academic_year_of(F.col("l_shipdate")),
            "learning_aim_skey": F.col("l_partkey"),
            "enrolment_count": F.when(number != 7, (number % 2 + 1).cast("bigint")),
            "guided_learning_hours": F.when(quantity < 45, quantity.cast("bigint")),
            "planned_end_date": F.when(number != 5, shipped),
            "actual_end_date": shipped,
        }

    @staticmethod
    def _ship_date_bounds(years: Years) -> list[Column]:
        """Start years as ranges of the ship date, which the scan can use.

        Years of a frame become dates inside the subquery: only a bare value reaches the scan.
        """
        def start_of(year: Column) -> Column:
            day = F.make_date(year - YEAR_SHIFT, F.lit(ACADEMIC_START_MONTH), F.lit(1))
            return day.cast("timestamp_ntz")

        if isinstance(years, DataFrame):
            first, last = (F.col(name) for name in years.columns)
            begin, end = (years.select(start_of(year).alias("day")).scalar() for year in (first, last + 1))
        else:
            first, last = years
            begin = None if first is None else start_of(F.lit(first))
            end = None if last is None else start_of(F.lit(last + 1))
        bounds = [] if begin is None else [F.col("l_shipdate") >= begin]
        return bounds if end is None else [*bounds, F.col("l_shipdate") < end]

    def accounts(self, years: Years = (None, None)) -> DataFrame:
        price = F.col("l_extendedprice").cast("decimal(12,2)")
        discount = F.col("l_discount").cast("decimal(4,2)")
        tax = F.col("l_tax").cast("decimal(4,2)")

        def money(value: Column) -> Column:
            return value.cast("decimal(18,4)")

        rows = self.table("lineitem")
        for bound in self._ship_date_bounds(years):
            rows = rows.where(bound)
        return rows.select(
            F.col("l_suppkey").alias("provider_skey"),
            academic_year_of(F.col("l_shipdate")).alias("academic_year_skey"),
            money(price * (F.lit(1) - discount)).alias("adjusted_income"),
            money(price * F.lit("0.50").cast("decimal(4,2)")).alias("staff_costs"),
            money(price * F.lit("0.10").cast("decimal(4,2)")).alias("teaching_costs"),
            money(price * tax).alias("teaching_support_costs"),
            F.lit(None).cast("decimal(18,4)").alias("administration_costs"),
            money(F.col("l_quantity")).alias("operational_maintenance_costs"),
            money(F.lit(0)).alias("examination_costs"),
            money(F.lit(1)).alias("rent_and_lease_costs"),
        )

    # -- dimensions ----------------------------------------------------------

    def dim(self, name: str, *columns: str | Column) -> DataFrame:
        build = {
            YEAR: self._years, PROVIDER: self._providers, SSA: self._subject_areas,
            LEVEL: self._levels, AGE: self._ages, DELIVERY: self._deliveries,
            AIM: self._aims, LEARNER: self._learners,
        }[name]
        if name == PROVIDER and columns == ("provider_name",):
            return self._provider_names()
        return build().select(DIMENSION_KEYS[name], *columns) if columns else build()

    def keys_of(self, name: str) -> DataFrame:
        return self._provider_names().select("provider_skey") if name == PROVIDER else super().keys_of(name)

    def _provider_names(self) -> DataFrame:
        """Providers without their towns, which take two more tables."""
        return self.table("supplier").select(
            F.col("s_suppkey").alias("provider_skey"), F.col("s_name").alias("provider_name"))

    def _years(self) -> DataFrame:
        """Every academic year that a date can be in: 10,000 rows.

        Key and label come from one list of pairs, so that the label is no expression of the
        key. Otherwise a filter on labels would be carried over to the lines and evaluated as
        text for each of them, where the join with the few rows left is cheaper.
        """
        first, last = (year + YEAR_SHIFT for year in DATE_YEARS)

        def two_digits(year: Column) -> Column:
            return F.lpad(F.pmod(year, F.lit(100)).cast("string"), 2, "0")

        pairs = F.transform(F.sequence(F.lit(first - 1), F.lit(last)), lambda year: F.struct(
            year.alias("academic_year_skey"),
            F.concat(two_digits(year), F.lit("/"), two_digits(year + 1)).alias("academic_year")))
        return F.broadcast(self.spark.range(1).select(F.inline(pairs)))

    def _providers(self) -> DataFrame:
        nation = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        town = F.when(F.col("n_nationkey") % 6 == 0, F.lit("  ")).otherwise(F.col("n_name"))
        return (
            self.table("supplier")
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
            .select(
                F.col("s_suppkey").alias("provider_skey"),
                F.col("s_name").alias("provider_name"),
                town.alias("contact_town"),
                F.col("r_name").alias("college_type"),
            )
        )

    def _subject_areas(self) -> DataFrame:
        kind = F.col("p_type")
        return (
            self.table("part").where(kind != MISSING_SSA_TYPE)
            .select(
                F.concat_ws("|", "p_type", "p_brand").alias("ssa_skey"),
                F.when(kind != "PROMO", kind).alias("ssa_tier_1_description"),
                F.col("p_brand").alias("ssa_tier_2_description"),
            )
            .distinct()
        )

    def _levels(self) -> DataFrame:
        band = F.col("level_skey")
        label = F.when(band < NAMED_BANDS, F.concat(F.lit("Level "), band + 1)).otherwise("")
        return self._part_keys().select(band).where(band.isNotNull()).distinct().withColumn("level_description", label)

    def _ages(self) -> DataFrame:
        segment = F.col("age_skey")
        return self._customer_keys().select(segment).where(segment.isNotNull()).distinct().withColumn(
            "age_group_fes", _meaning(segment, AGE_GROUPS, OTHER_AGE))

    @staticmethod
    def _delivery_key() -> Column:
        return F.concat("l_returnflag", F.lit("|"), "l_linestatus", F.lit("|"), "o_orderpriority")

    @staticmethod
    def _delivery_columns() -> dict[str, Column]:
        """What two flags of the line and the priority of its order stand for."""
        flag, status, priority = F.col("l_returnflag"), F.col("l_linestatus"), F.col("o_orderpriority")
        return {
            "funding_model": F.when(priority == "5-LOW", F.lit(" ")).otherwise(_meaning(flag, FUNDING, OTHER_FUNDING)),
            "programme_type": F.when(priority != "1-URGENT", F.concat(F.lit("Programme "), F.left(priority, F.lit(1)))),
            "learning_aim_reference": F.when(status == "F", F.concat(F.lit("REF-"), flag)).otherwise(""),
            "completion_status": F.when(status == "O", "Continuing").otherwise(" "),
            "completion_status_code": _meaning(flag, COMPLETION_CODES, OTHER_COMPLETION),
            "is_non_funded": F.when(priority == "2-HIGH", "true").when(priority != "3-MEDIUM", "N"),
        }

    def _deliveries(self) -> DataFrame:
        """Every delivery that a line has; only stored stars and SQL read it."""
        lines = self.table("lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
        members = lines.join(self._order_keys(), "l_orderkey").select(
            "l_returnflag", "l_linestatus", "o_orderpriority").distinct()
        key = DIMENSION_KEYS[DELIVERY]
        return members.select(self._delivery_key().alias(key), *[
            value.alias(name) for name, value in self._delivery_columns().items()]).where(F.col(key).isNotNull())

    def _aims(self) -> DataFrame:
        key, size = F.col("p_partkey"), F.col("p_size")
        return self.table("part").select(
            key.alias("learning_aim_skey"),
            F.when(key % 10 != 0, F.concat(F.lit("AIM"), key)).alias("learn_aim_ref"),
            F.when(key % 13 == 0, F.lit(" ")).otherwise(F.col("p_name")).alias("learn_aim_ref_title"),
            F.when(size % 3 != 0, F.concat(F.lit("NVQ"), size % 5)).alias("nvq_level_v2"),
            F.concat(F.lit("N"), size % 4).alias("nvq_level"),
            size.cast("bigint").alias("guided_learning_hours"),
        )

    def _learners(self) -> DataFrame:
        key, nation = F.col("c_custkey"), F.col("c_nationkey")
        return self.table("customer").select(
            key.alias("learner_skey"),
            F.when(key % 4 == 0, F.lit(" ")).otherwise(F.concat(F.lit("Campus "), nation))
            .alias("campus_identifier"),
            F.when(key % 8 != 0, nation).alias("campus_id"),
            F.when(key % 5 != 0, key % 40).alias("planned_eep_hours"),
        )


def table_star(spark: SparkSession, folder: str) -> TableStar:
    return TableStar(spark, folder)
