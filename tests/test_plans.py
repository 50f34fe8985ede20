"""What the optimizer makes of the operators."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  fills the registry
from veritally.operators.align import align_predictions, dedupe_slots, failed_requests
from veritally.operators.binary import binary_metrics
from veritally.operators.counts import outcome_counts
from veritally.operators.multiclass import confusion_matrix, per_class_metrics
from veritally.operators.requests import cross_models, expand_iterations
from veritally.plans import shared
from veritally.plans.shared import clean_scratch, scratch_path, shared_dir, small_rows, written
from workload import views as v
from workload.registry import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.fixture
def stored(spark, tmp_path_factory):
    """Responses and requests as stored tables."""
    base = tmp_path_factory.mktemp("tables")
    v.responses(spark, SF).withColumn("raw_response", F.lit("raw")).write.parquet(f"{base}/responses")
    v.requests(spark, SF).write.parquet(f"{base}/requests")
    return spark.read.parquet(f"{base}/responses"), spark.read.parquet(f"{base}/requests")


def test_metrics_read_only_their_columns(stored):
    responses, requests = stored
    text = formatted(binary_metrics(align_predictions(responses, requests, v.SAFE)))
    schemas = [line for line in text.splitlines() if line.startswith("ReadSchema")]
    assert len(schemas) == 2
    assert not any(c in s for s in schemas for c in ("text", "raw_response", "latency", "timestamp"))
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_filters_reach_the_scan(stored):
    responses, requests = stored
    df = binary_metrics(align_predictions(responses, requests, v.SAFE)).where("model_name = 'model_a'")
    assert "EqualTo(model_name,model_a)" in formatted(df)


def test_no_cross_join_in_expansion_or_grid(spark, stored):
    responses, requests = stored
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        expanded = expand_iterations(cross_models(requests, v.MODELS), 5)
        assert "Exchange" not in plan(expanded)
        dense = per_class_metrics(confusion_matrix(align_predictions(responses, requests, v.SAFE), v.CLASSES))
        for df in (dense, failed_requests(expanded, responses)):
            assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)
        # Large label tables are joined by key, not broadcast.
        assert "SortMergeJoin" in plan(dense) and "Broadcast" not in plan(dense)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_counts_are_combined_before_the_shuffle(stored):
    responses, requests = stored
    text = plan(outcome_counts(align_predictions(responses, requests, v.SAFE)))
    assert "partial_count" in text
    assert "partial_max" in plan(dedupe_slots(responses))


# Nested-loop joins with a table of one row, which an aggregation without keys has made.
ONE_ROW = {"run_log_summary"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_global_window_and_no_row_python(spark, name):
    """Every registered query, those that write files on the way included."""
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text, name
    assert "NestedLoop" not in text or name in ONE_ROW, name
    assert "BatchEvalPython" not in text, name
    # A window without keys would order all rows in one task; aggregates without keys are combined first.
    assert not re.search(r"Window \[[^\n]*\], \[\], \[", text), name


def test_small_tables_are_checked(spark):
    df = spark.range(50)
    assert len(small_rows(df, 50)) == 50 and small_rows(df, 49) is None


def test_written_tables_are_computed_once(spark):
    kept = written(spark.range(50).selectExpr("id", "uuid() AS u"), "once")
    assert kept.collect() == kept.collect() and "Scan parquet" in plan(kept)


def test_scratch_of_an_application_can_be_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_dir", lambda session: str(tmp_path))
    assert written(spark.range(5), "x").count() == 5
    (tmp_path / "other-app").mkdir()
    assert clean_scratch(spark) and [p.name for p in tmp_path.iterdir()] == ["other-app"]
    assert not clean_scratch(spark)


class FakeSession:
    """Just the settings that the folder choice looks at."""

    def __init__(self, master, settings):
        self.conf = self
        self.sparkContext = self
        self.master, self.applicationId, self._settings = master, "app-x", settings

    def get(self, key, default=None):
        return self._settings.get(key, default)


def test_shared_folder_comes_from_the_session(spark):
    named = {"spark.checkpoint.dir": "hdfs://shared/x/"}
    assert shared_dir(FakeSession("spark://host", named)) == "hdfs://shared/x"
    with pytest.raises(ValueError):
        shared_dir(FakeSession("spark://host", {}))
    local = FakeSession("local[2]", {})
    assert shared_dir(local) == shared_dir(local)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
