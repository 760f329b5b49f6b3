import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from cohortia.forecasting import service as fc
from cohortia.forecasting.series import FORECAST_SCHEMA
from cohortia.operators import enrolment as en
from cohortia.operators.filters import FilterSet
from cohortia.operators.regression import LINEAR, RIDGE, Regressions
from cohortia.plans import jobs
from cohortia.plans.explorer import Snapshot
from cohortia.session import scratch_path, shared_root
from cohortia.sources import files
from cohortia.sources.tables import table_star


def test_training_needs_extracts(spark, folder):
    with pytest.raises(RuntimeError, match="Refresh the data"):
        jobs.train_all(spark, f"{folder}/none", folder)


@pytest.fixture(scope="module")
def trained(spark, star):
    data, output = scratch_path(spark, "test-data"), scratch_path(spark, "test-models")
    jobs.refresh_extracts(star, data)
    return data, output, jobs.train_all(spark, data, output).collect()


def test_extracts_match_the_single_queries(spark, star, trained):
    data = trained[0]
    def written(name, *columns):
        return rows_of(spark.read.parquet(f"{data}/{name}").select(*columns))
    assert written("enrolment_by_ssa", "academic_year", "ssa_tier1", "learner_count", "enrolment_count") == rows_of(
        en.enrolment_by_ssa(star))
    assert written("enrolment_by_age", "academic_year", "age_group", "learner_count") == rows_of(en.enrolment_by_age(star))
    assert written("enrolment_by_level", "academic_year", "level_desc", "learner_count") == rows_of(
        en.enrolment_by_level(star))
    assert written("enrolment_total", "academic_year", "learner_count", "enrolment_count") == rows_of(
        en.enrolment_trends(star))
    columns = ("academic_year", "provider_skey", "provider_name", "college_type", "learner_count", "enrolment_count")
    assert written("enrolment_by_provider", *columns) == rows_of(en.enrolment_by_provider(star).select(*columns))


def test_lines_move_to_their_learner_before_they_are_counted_five_times(star):
    """Distinct learners are found where the learner is: no exchange moves five rows for each line."""
    plan = jobs.extract_counts(star)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert any("hashpartitioning(learner_skey" in line and "spread" in line for line in exchanges)
    assert not any("extract" in line and "learner_skey" in line for line in exchanges)


def test_extracts_of_lines_without_a_learner(spark, star, folder):
    """Lines without an order count as enrolments only, in every breakdown but that by age."""
    tables = {name: star.table(name) for name in ("nation", "region", "customer", "supplier", "part", "lineitem")}
    tables["orders"] = star.table("orders").where(F.col("o_orderkey") % 3 != 0)
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    some = table_star(spark, folder)
    counts = jobs.extract_counts(some)
    def part(name, *columns):
        return rows_of(counts.where(F.col("extract") == name).select(*columns))
    assert part("enrolment_total", "academic_year", "learner_count", "enrolment_count") == rows_of(en.enrolment_trends(some))
    assert part("enrolment_by_ssa", "academic_year", "name", "learner_count", "enrolment_count") == rows_of(en.enrolment_by_ssa(some))
    assert part("enrolment_by_age", "academic_year", "name", "learner_count") == rows_of(en.enrolment_by_age(some))


def test_training_writes_forecasts_and_metrics(spark, star, trained):
    _, output, counts = trained
    assert {r.model: r.row_count for r in counts}["arima"] == 3
    accuracy = {r.model: r for r in files.model_accuracy(spark, f"{output}/metrics").collect()}
    assert set(accuracy) == {"ARIMA", "SARIMA", "LSTM"}
    assert accuracy["ARIMA"].mae > 0 and accuracy["LSTM"].mae is None and accuracy["LSTM"].data_points == 8
    saved = fc.saved_or_filtered_ssa_forecast(star, output, "lstm")
    assert {r.model_type for r in saved.collect()} == {"LSTM"}
    assert fc.saved_or_filtered_ssa_forecast(star, f"{output}/none").count() == 0
    total = fc.resolve_forecast(star, "arima", saved=output)
    assert rows_of(total.select("model_type", "year")) == [("ARIMA", y) for y in (2022, 2023, 2024)]


def test_missing_metrics_are_null(spark, folder):
    found = files.model_accuracy(spark, f"{folder}/none").collect()
    assert len(found) == 3 and all(r.mae is None for r in found)


def test_resolution_order(spark, star):
    store = scratch_path(spark, "test-store")
    only = FilterSet.of(provider_id=3)
    one = spark.createDataFrame([("30/31", 2030, 1.0, 0.0, 2.0, "SARIMA", 3)], FORECAST_SCHEMA)
    files.append_forecasts(one, store)
    assert rows_of(fc.resolve_forecast(star, "sarima", only, store)) == rows_of(one)
    assert fc.resolve_forecast(star, "arima", only, store).first().model_type == "ARIMA"
    filtered = fc.resolve_forecast(star, "sarima", FilterSet.of(provider_id=3, start_year=2014), store)
    assert filtered.first().academic_year != "30/31"
    assert fc.resolve_forecast(star, "arima", FilterSet(), store).count() == 0
    assert fc.resolve_forecast(star, None, FilterSet.of(location="nowhere")).count() == 0


def test_unknown_model_runs_the_default_under_its_own_name(star):
    only = FilterSet.of(provider_id=3)
    odd, usual = fc.provider_forecast(star, "odd", only), fc.provider_forecast(star, None, only)
    assert rows_of(odd.drop("model_type")) == rows_of(usual.drop("model_type"))
    assert odd.first().model_type == "ODD"


def test_saved_file_with_and_without_provider_keys(spark, folder):
    text = "ACADEMIC_YEAR,YEAR,PREDICTED_ENROLMENTS,PROVIDER_KEY\n23/24,2023,1.5,7\n24/25,x,2.5,seven\n"
    (folder_path := __import__("pathlib").Path(folder) / "f.csv").write_text(text)
    found = files.saved_forecast(spark, str(folder_path), 7).collect()
    assert [(r.year, r.predicted_enrolments, r.provider_key, r.lower_ci) for r in found] == [(2023, 1.5, 7, None)]
    everything = files.saved_forecast(spark, str(folder_path)).orderBy("academic_year").collect()
    assert [(r.year, r.provider_key) for r in everything] == [(2023, 7), (None, None)]
    bare = __import__("pathlib").Path(folder) / "g.csv"
    bare.write_text("ACADEMIC_YEAR,YEAR\n23/24,2023\n")
    assert files.saved_forecast(spark, str(bare), 7).count() == 0
    assert files.saved_forecast(spark, str(bare)).count() == 1
    assert files.saved_forecast(spark, f"{folder}/none") is None


def test_newest_stored_rows(spark):
    store = scratch_path(spark, "test-store")
    for value in (1.0, 2.0):
        files.append_forecasts(
            spark.createDataFrame([("30/31", 2030, value, 0.0, 3.0, "ARIMA", 3)], FORECAST_SCHEMA), store)
    assert files.stored_forecasts(spark, store, "arima").count() == 2
    newest = files.stored_forecasts(spark, store, "arima", 3, latest_only=True).collect()
    assert [r.predicted_enrolments for r in newest] == [2.0]
    plan = files.stored_forecasts(spark, store, "arima")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model_type" in plan


def test_metrics_of_a_new_run_replace_the_old(spark, folder):
    for value in (1.0, 2.0):
        frame = spark.createDataFrame([("ARIMA", "111", value)], "model string, `order` string, mae double")
        files.write_metrics(frame, f"{folder}/metrics", "arima")
    found = {r.model: r.mae for r in files.model_accuracy(spark, f"{folder}/metrics").collect()}
    assert found == {"ARIMA": 2.0, "SARIMA": None, "LSTM": None}


def test_comparison_looks_up_the_store(spark, star):
    store = scratch_path(spark, "test-store")
    files.append_forecasts(
        spark.createDataFrame([("30/31", 2030, 1.0, 0.0, 2.0, "LSTM", 3)], FORECAST_SCHEMA), store)
    only = FilterSet.of(provider_id=3)
    found = fc.compare_models(star, only, store=store).collect()
    assert sorted({(r.model_type, r.academic_year == "30/31") for r in found}) == [
        ("ARIMA", False), ("LSTM", True), ("SARIMA", False)]
    assert fc.compare_models(star).count() == 0
    kinds = {r.data_type for r in fc.history_with_forecast(star, "lstm", only, store).collect()}
    assert kinds == {"Historical", "Forecast"}
    assert {r.data_type for r in fc.history_with_forecast(star, "lstm").collect()} == {"Historical"}


def test_snapshot_refresh(spark, star):
    snapshot = jobs.refresh_snapshot(star, scratch_path(spark, "test-snapshot"))
    assert isinstance(snapshot, Snapshot) and snapshot.info().first().row_count == snapshot.rows.count() > 0


def test_scratch_lies_in_the_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_root(spark) == named.rstrip("/")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_sketched_profile_agrees_on_counts(star):
    tables = {"nation": star.table("nation")}
    columns = ["table_name", "column_name", "ordinal_position", "data_type", "row_count", "null_count"]
    assert rows_of(files.table_profile(tables).select(*columns)) == rows_of(
        files.table_profile(tables, exact=False).select(*columns))


def test_stamped_export(spark, folder):
    path = files.export_csv(spark.range(2), folder, "numbers")
    assert path.startswith(f"{folder}/numbers_2") and spark.read.option("header", True).csv(path).count() == 2


def test_linear_models_find_a_line(spark):
    rows = spark.range(400).select(
        (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    rows = rows.withColumn("learner_count", 1000 + 5 * F.col("a") - 3 * F.col("b"))
    models = Regressions(["a", "b"]).fit(rows, [LINEAR, RIDGE])
    found = {r.model: r for r in models.compare(rows).collect()}
    assert found[LINEAR].rmse < 1e-6 and found[LINEAR].r2 > 0.999999 and found[LINEAR].is_best
    # the ridge solution in closed form
    import numpy as np
    data = np.array([(r.a, r.b, r.learner_count) for r in rows.collect()])
    x, y = data[:, :2] - data[:, :2].mean(0), data[:, 2] - data[:, 2].mean()
    expected = np.linalg.solve(x.T @ x + np.eye(2), x.T @ y)
    assert np.allclose(models.models[RIDGE].coefficients, expected, atol=1e-5)
    assert models.predict(rows).select("prediction").count() == 400


def test_offline_run_trains_and_exports(spark, star, folder, monkeypatch):
    from cohortia.operators import regression
    monkeypatch.setattr(regression, "TREES", 3)
    monkeypatch.setattr(regression, "BOOSTING_ROUNDS", 2)
    monkeypatch.setattr(regression, "FOREST_DEPTH", 3)
    done = jobs.run_offline(star, folder)
    results = done["model_results"].collect()
    assert len(results) == 5 and sum(r.is_best for r in results) == 1
    assert min(results, key=lambda r: r.rmse).is_best
    exported = spark.read.option("header", True).csv(f"{folder}/forecast_combined")
    assert {r.data_type for r in exported.select("data_type").distinct().collect()} == {"Historical", "Forecast"}
