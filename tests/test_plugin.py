"""Loaders registered as formats: parts as tasks, pushed comparisons, rows."""

import json

import pytest
from pyspark.sql import functions as F

from veritally.operators.requests import valid_requests
from veritally.sources.plugin import PUSHDOWN, DatasetLoader, register_loader

CLASSES = ("safe", "unethical", "off-topic")


class Categories(DatasetLoader):
    """A folder with a file of JSON lines per class; one part per file, only the wanted classes."""

    schema = "instance_index long, text string, category string"
    pushable = ("category",)

    def parts(self, wanted):
        return [c for c in CLASSES if c in wanted.get("category", CLASSES)]

    def rows(self, part, wanted):
        if part == "safe":
            # Rows that were not asked for are left out by the reader.
            yield 99, "stray", "unethical"
        with open(f"{self.options['path']}/{part}.jsonl", encoding="utf-8") as lines:
            for line in lines:
                item = json.loads(line)
                yield item["id"], item.get("message"), part


class Failing(DatasetLoader):
    schema = "text string"

    def rows(self, part, wanted):
        raise RuntimeError("cannot load")
        yield


@pytest.fixture
def folder(tmp_path):
    for k, c in enumerate(CLASSES):
        (tmp_path / f"{c}.jsonl").write_text("".join(json.dumps({"id": 10 * k + i, "message": f"{c} {i}" if i else None}) + "\n" for i in range(4)))
    return str(tmp_path)


@pytest.fixture(params=["true", "false"])
def pushdown(spark, request):
    spark.conf.set(PUSHDOWN, request.param)
    yield request.param == "true"
    spark.conf.unset(PUSHDOWN)


def test_loader_is_a_format(spark, folder, pushdown):
    register_loader(spark, f"categories_{pushdown}", Categories)
    df = spark.read.format(f"categories_{pushdown}").load(folder)
    assert df.rdd.getNumPartitions() == 3 and df.count() == 13
    assert valid_requests(df).groupBy("category").count().orderBy("category").collect() == [("off-topic", 3), ("safe", 3), ("unethical", 4)]
    for where, n, parts in (("category = 'safe'", 4, 1), ("category IN ('safe', 'off-topic')", 8, 2), ("category = 'none'", 0, 1),
                            ("category IN ('safe', 'x') AND instance_index > 1", 2, 1), ("text LIKE '%2'", 3, 3)):
        some = df.where(where)
        assert some.count() == n, where
        if pushdown:
            assert some.rdd.getNumPartitions() == parts, where
    # A comparison that the loader takes is no longer Spark's.
    plan = df.where("category = 'safe'")._jdf.queryExecution().executedPlan().toString()
    assert ("= safe" in plan) != pushdown and "(Python)" in plan


def test_loader_errors_reach_the_user(spark):
    register_loader(spark, "failing", Failing)
    with pytest.raises(Exception, match="cannot load"):
        spark.read.format("failing").load().select(F.upper("text")).collect()
