import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from cohortia.plans import explorer as ex
from cohortia.plans import programme as pg
from cohortia.session import scratch_path
from cohortia.sources.ordered import PART

COLUMNS = ["CA Name", "Prog Name", "Approval Status", "Infill", "Site", "Level", "Parent", "Course ID"]
HEALTH = "Health, Public Services and Care"
PLANS = [
    (HEALTH, "Adult Care Diploma", "Completed", "N", "Main Campus", "Level 3", "College A", "AC-001"),
    ("Engineering and Manufacturing Technologies", "Machining Basics", "Continuing", "N", "Skills Centre",
     "Level 2", "College B", "EN-002"),
    (HEALTH, "Nursing Pathway", "Completed", "N", "Main Campus", "Level 3", "College A", "NU-003"),
]


@pytest.fixture(scope="module")
def plans(spark):
    return spark.createDataFrame(PLANS, ", ".join(f"`{c}` string" for c in COLUMNS))


@pytest.fixture(scope="module")
def snapshot(spark, plans):
    return ex.Snapshot.write(plans, scratch_path(spark, "test-plans"))


def test_snapshot_info(snapshot):
    info = snapshot.info().first()
    assert (info.row_count, info.column_count, info.source) == (3, 8, "snapshot")
    assert len(info.last_modified) == 19


def test_quick_filters_hold_the_status(plans):
    chosen = ex.quick_filters(ex.filter_counts(plans)).orderBy("quick_position").collect()
    assert [r.column_name for r in chosen] == ["Approval Status", "Infill", "Site", "Level", "Parent", "CA Name"]
    assert ex.PAGE_SIZES == (50, 100, 250, 500)


@pytest.mark.parametrize("search, count", [("nursing", 1), ("care", 2), ("CARE", 2), ("zzz", 0), ("", 2), (".", 0)])
def test_search_within_completed(snapshot, search, count):
    found = ex.page_rows(snapshot, 1, 10, search, {"Approval Status": "Completed"})
    assert found.count() == count
    meta = ex.page_info(ex.search_rows(snapshot.rows, search, {"Approval Status": "Completed"}), 1, 10).first()
    assert meta.total_rows == count and meta.total_pages == 1 and meta.end_row == count


def test_unknown_filter_columns_are_ignored_and_empty_text_is_a_value(snapshot):
    assert ex.search_rows(snapshot.rows, None, {"Nothing": "x"}).count() == 3
    assert ex.search_rows(snapshot.rows, None, {"Site": ""}).count() == 0


def test_page_size_has_a_limit(snapshot):
    with pytest.raises(ValueError, match="page_size"):
        ex.page_rows(snapshot, 1, 999)


def test_page_is_clamped(snapshot):
    assert ex.page_rows(snapshot, 99, 2).count() == 1
    meta = ex.page_info(snapshot.rows, 99, 2).first()
    assert tuple(meta) == (2, 2, 3, 2, True, False, 3, 3)


def test_no_rows_still_give_one_page(snapshot):
    meta = ex.page_info(ex.search_rows(snapshot.rows, "zzz"), 5, 2).first()
    assert tuple(meta) == (1, 2, 0, 1, False, False, 0, 0)


@pytest.fixture(scope="module")
def large(spark):
    """Many rows, two thirds of them alike in the first key, over several partitions."""
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("area "), F.col("id") % 7)).otherwise("hot area").alias("CA Name"),
        F.format_string("programme %05d", (F.col("id") * 7919) % 5000).alias("Prog Name"),
        F.when(F.col("id") % 11 == 0, "Completed").otherwise("Continuing").alias("Approval Status"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return ex.Snapshot.write(rows, scratch_path(spark, "test-large"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pages_together_are_the_whole(large):
    expected = [tuple(r) for r in large.rows.orderBy("CA Name", "Prog Name").collect()]
    assert large.numbered.select(PART).distinct().count() > 1
    for page in (1, 2, 7, 10):
        found = sorted(tuple(r) for r in ex.page_rows(large, page, 500).collect())
        assert found == expected[(page - 1) * 500:page * 500]


def test_filtered_pages_together_are_the_filtered_whole(large):
    expected = [tuple(r) for r in large.rows.where("`Approval Status` = 'Completed'").orderBy("CA Name", "Prog Name").collect()]
    found = []
    for page in range(1, 12):
        found += sorted(tuple(r) for r in ex.page_rows(large, page, 50, None, {"Approval Status": "Completed"}).collect())
    assert len(expected) == 455 and found == expected + expected[450:]  # the last page again, clamped


def test_csv_keeps_blanks_and_quotes(spark, folder):
    rows = spark.createDataFrame([(' a "b", c ', ""), (" ", "x")], "`One` string, `Two Three` string")
    ex.write_text_csv(rows, f"{folder}/csv")
    assert rows_of(ex.read_text_csv(spark, f"{folder}/csv")) == rows_of(rows)


def test_compat_rows_add_columns_and_coerce(spark):
    rows = spark.createDataFrame(
        [("A", "P", "12", "n/a", "x"), (None, None, "1", "2", "3"), (None, "Q", None, "4", "5")],
        "ca_name string, prog_name string, main_qual_glh string, total_costs string, extra string")
    found = ex.compat_rows(rows).orderBy("Prog Name").collect()
    assert len(found) == 2 and len(found[0]) == 31
    assert (found[0]["Main Qual GLH"], found[0]["Total Costs"], found[0]["Infill"]) == (12.0, None, None)
    assert (found[1]["Main Qual GLH"], found[1]["Total Costs"]) == (0.0, 4.0)


def test_hours_total_is_the_sum_and_nothing_gives_no_rows(star):
    plans = pg.programme_plans(star)
    found = {r.row_labels: r.sum_of_main_qual_glh for r in pg.hours_summary(plans).collect()}
    total = found.pop(pg.GRAND_TOTAL)
    assert total == sum(found.values()) > 0
    assert pg.hours_summary(plans, infill="nothing").count() == 0


def test_csv_keeps_every_cell(spark, folder):
    cells = ["a\nb", "a\\nb", "\r\n", "\\", 'say "x", y', "  blank  ", "", "\\b"]
    rows = spark.createDataFrame([(f"{k:02d}", cell) for k, cell in enumerate(cells)], "k string, cell string")
    ex.write_text_csv(rows, f"{folder}/csv")
    assert [r.cell for r in ex.read_text_csv(spark, f"{folder}/csv").orderBy("k").collect()] == cells


def test_compat_data_is_whole_unless_limited(spark):
    rows = spark.range(2100).select(F.col("id").cast("string").alias("prog_name"), F.lit("x").alias("ca_name"))
    assert ex.compat_data(ex.compat_rows(rows)).count() == 2100
    assert ex.compat_data(ex.compat_rows(rows), limit=7).count() == 7


def test_floats_keep_all_digits(spark):
    values = [0.0, 0.1 + 0.2, -12.5, 1 / 3, 1e-4, 12345678.25, 5e9, 1e-30, 1e300, None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    shown = [r.v for r in ex.as_text(rows).orderBy(F.col("i").cast("int")).collect()]
    assert shown[:8] == ["0.0", "0.30000000000000004", "-12.5", repr(1 / 3), "0.0001", "12345678.25", "5000000000.0", "1.0E-30"]
    assert float(shown[8]) == 1e300 and shown[9] == ""
