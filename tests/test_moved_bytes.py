"""Texts are moved and stored once, not once per response."""

import glob
import json
import os
import random

from veritally.plans.shared import scratch_path
from veritally.sources.result_files import scan_results
from veritally.sources.sinks import write_predictions
from workload import file_queries, run_queries, views as v

SF = "/root/testdata/sf0.01"


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)


def test_staged_results_hold_each_text_about_once(spark):
    text = v.requests(spark, SF).selectExpr("sum(length(text)) AS n").first()["n"]
    assert size(file_queries.stage_result_objects(spark, SF)) < 2 * text


def test_predictions_of_a_request_stay_together(spark, tmp_path):
    rng = random.Random(1)
    texts = [(i, "%02000x" % rng.getrandbits(8000), "safe") for i in range(2_000)]
    requests = spark.createDataFrame(texts, "instance_index long, text string, category string").repartition(4)
    responses = spark.range(40_000).selectExpr("id % 2000 AS instance_index", "'m' AS model_name", "cast(id / 2000 AS int) AS iteration", "true AS is_safe")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        write_predictions(responses, requests, str(tmp_path), "e", 0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert spark.read.parquet(str(tmp_path)).count() == 40_000
    assert size(tmp_path) < 6 * 2_000 * 2_000


def test_records_of_result_documents_are_not_moved_to_be_numbered(spark):
    path = scratch_path(spark, "doc")
    items = ",\n".join('{"request_text": "%s", "prediction": {"is_safe": true}}' % ("%0300x" % i) for i in range(3_000))
    spark.createDataFrame([('{"model": "m", "predictions": [\n' + items + "]}",)], "value string").coalesce(1).write.text(path)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "30000")
    try:
        out = scan_results(spark, path, split=True)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 3_000 and out.select("run_model").distinct().collect()[0][0] == "m"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" not in plan


def test_result_documents_are_staged_in_groups_and_not_kept(spark, tmp_path, monkeypatch):
    # Ten ranges of keys, a key twice, a text that is NULL or has quotes and braces, and documents without a label.
    ids = [i * 5_000 for i in range(40)] + [20_000]
    texts = [(i, None if i == 5_000 else '}"{\\' if i == 10_000 else "text %d " % i * 50, "en", "web", 400 + i % 7) for i in ids]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, i % 2, i // 5_000 % 2) for i in sorted(set(ids))[:-4]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    made, kept, orders = [], [], []

    def path_of(spark, name):
        made.append(scratch_path(spark, name))
        return made[-1]

    def scan(spark, path, **how):
        kept.append(sum(size(p) for p in made))
        for file in glob.glob(f"{path}/*/part-*"):
            with open(file) as f:
                keys = [(r["prediction"]["instance_index"], r["prediction"]["iteration"]) for r in json.load(f)["predictions"]]
            orders.append((len(keys), [k for k, _ in keys] == sorted(k for k, _ in keys)))
        return scan_results(spark, path, **how)

    monkeypatch.setattr(file_queries, "scratch_path", path_of)
    monkeypatch.setattr(file_queries, "scan_results", scan)
    answers, asked = v.responses(spark, str(tmp_path)), v.requests(spark, str(tmp_path))
    want = sorted(
        answers.join(asked.selectExpr("instance_index", "md5(text) AS m"), "instance_index")
        .selectExpr("model_name", "instance_index", "iteration", "is_safe", "category AS predicted", "latency", "coalesce(m, '') AS m").collect(),
        key=str,
    )
    for bytes_, groups in ((1 << 40, 1), (1, 8)):
        monkeypatch.setattr(file_queries, "GROUP_BYTES", bytes_, raising=False)
        made.clear(), kept.clear(), orders.clear()
        got = file_queries.q_scan_result_documents(spark, str(tmp_path))
        assert not any(os.path.exists(p) for p in made)
        rows = got.selectExpr("model_name", "instance_index", "iteration", "is_safe", "predicted", "latency", "coalesce(text_md5, '') AS m").collect()
        assert sorted(rows, key=str) == want and {r["run_model"] for r in got.select("run_model", "model_name").collect()} == {f"run-{m}" for m in v.MODELS}
        assert sum(n for n, _ in orders) == len(want) and all(ordered for _, ordered in orders) and len(kept) == groups
        whole = kept[0] if groups == 1 else whole
    assert max(kept) < whole / 2


def test_stream_input_is_written_by_many_tasks(spark, monkeypatch):
    made = []
    monkeypatch.setattr(run_queries, "scratch_path", lambda s, name: made.append((name, scratch_path(s, name))) or made[-1][1])
    assert run_queries.q_stream_slot_counts(spark, SF).count() > 0
    assert len([f for f in os.listdir(dict(made)["writes"]) if f.endswith(".parquet")]) > 3
