import json
import random

import pytest
from pyspark.sql import functions as F

from veritally.operators.requests import invalid_requests, normalize_academic, normalize_chat, valid_requests
from veritally.sources.category_json import scan_category_json, with_instance_index
from veritally.sources import json_blocks
from veritally.sources.chat_json import chat_items, scan_chat_json
from veritally.sources.json_blocks import first_member, split_items
from veritally.sources.result_files import scan_result_metrics, scan_results
from veritally.sources.run_logs import scan_run_logs
from veritally.sources.sinks import json_record, next_experiment_index, write_predictions, write_results

ITEMS = {
    "off-topic": [{"id": "o1", "message": "futebol", "explanation": "why"}],
    "safe": [
        {"id": "s1", "parameters": {"aspect": "A", "style": "B"}, "message": "olá, ação"},
        {"id": 33, "parameters": {"aspect": "A2"}, "message": "two"},
    ],
    "unethical": [],
    "unsafe": [{"id": 7, "message": ""}],
    "other": [{"id": 1, "message": "ignored"}],
}


def save(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, indent=1))
    return str(path)


def test_category_file_is_flattened_in_class_order(spark, tmp_path):
    items = scan_category_json(spark, save(tmp_path / "d.json", ITEMS))
    got = [(r["item_index"], r["category"], r["id"], r["message"]) for r in items.orderBy("item_index").collect()]
    assert got == [
        (0, "safe", "s1", "olá, ação"), (1, "safe", "33", "two"), (2, "off-topic", "o1", "futebol"), (3, "unsafe", "7", ""),
    ]
    requests = normalize_academic(with_instance_index(items), "src").orderBy("instance_index").collect()
    assert requests[0]["metadata"] == {
        "source": "src", "original_id": "s1", "category": "safe", "aspect": "A", "style": "B", "explanation": "",
    }
    assert requests[2]["metadata"]["explanation"] == "why" and requests[2]["metadata"]["aspect"] is None


def test_missing_text_is_quarantined_or_raises(spark, tmp_path):
    data = {"safe": [{"id": 1, "message": "x"}, {"id": 2}, {"id": 3, "message": ""}, 5]}
    items = scan_category_json(spark, save(tmp_path / "d.json", data))
    requests = normalize_academic(with_instance_index(items), "src")
    assert sorted(r["instance_index"] for r in invalid_requests(requests).collect()) == [1, 2, 3]
    assert valid_requests(requests).count() == 1
    with pytest.raises(Exception, match="missing text"):
        valid_requests(requests, strict=True).collect()


def test_empty_and_odd_classes(spark, tmp_path):
    empty = {c: [] for c in ("safe", "unethical", "off-topic")}
    assert scan_category_json(spark, save(tmp_path / "e.json", empty)).count() == 0
    odd = {"safe": "no list", "unethical": [{"id": 1, "message": "m"}, 5]}
    got = scan_category_json(spark, save(tmp_path / "o.json", odd)).orderBy("item_index").collect()
    assert [(r["category"], r["id"]) for r in got] == [("unethical", "1"), ("unethical", None)]


def test_bad_files_raise(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        scan_category_json(spark, str(tmp_path / "none.json")).collect()
    with pytest.raises(ValueError):
        scan_category_json(spark, str(tmp_path / "x.csv"))
    with pytest.raises(Exception, match="invalid JSON"):
        scan_category_json(spark, save(tmp_path / "bad.json", "{\"safe\": [1, 2")).collect()
    with pytest.raises(Exception, match="invalid JSON"):
        scan_chat_json(spark, save(tmp_path / "bad2.json", "[{\"text\": ")).collect()


def test_lines_are_numbered_densely(spark, tmp_path):
    for f in range(3):
        lines = [json.dumps({"safe": [{"id": f"{f}-{i}-{j}", "message": "m"} for j in range(i + 1)]}) for i in range(4)]
        (tmp_path / f"{f}.jsonl").write_text("\n".join(lines))
    items = scan_category_json(spark, str(tmp_path), lines=True)
    got = with_instance_index(items, single_object=False).collect()
    assert sorted(r["instance_index"] for r in got) == list(range(30))
    assert len({r["id"] for r in got}) == 30


CHAT = [
    {"id": 1, "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "toxic": True, "lang": "pt", "_x": 1},
    {"id": 2, "text": "plain", "content": "no"},
    {"id": 3, "content": "body", "message": "no"},
    {"id": 4, "message": "msg"},
    {"id": 5, "zeta": "first", "alpha": "second", "n": 3, "messages": []},
    {"id": 6, "n": 3},
    {"id": 7, "messages": [{"role": "user"}], "text": "fallback"},
]
TEXTS = {"1": "hi\nyo", "2": "plain", "3": "body", "4": "msg", "5": "first second", "6": None, "7": "fallback"}


@pytest.mark.parametrize("shape", ["array", "data", "lines"])
def test_chat_shapes_and_text_precedence(spark, tmp_path, shape):
    if shape == "lines":
        path = save(tmp_path / "c.jsonl", "\n".join(json.dumps(c) for c in CHAT))
        items = scan_chat_json(spark, path, lines=True)
    else:
        items = scan_chat_json(spark, save(tmp_path / "c.json", CHAT if shape == "array" else {"data": CHAT, "v": 1}))
    got = {r["metadata"]["original_id"]: r for r in normalize_chat(items.select("item"), "chat").collect()}
    assert {k: r["text"] for k, r in got.items()} == TEXTS
    assert got["1"]["metadata"] == {"source": "chat", "original_id": "1", "toxic": "true", "lang": "pt"}
    assert got["2"]["metadata"] == {"source": "chat", "original_id": "2", "toxic": "false"}
    assert got["1"]["toxic"] and not got["2"]["toxic"]
    assert got["1"]["category"] is None
    label = F.when(F.col("toxic"), "bad").otherwise("safe")
    assert normalize_chat(items.select("item"), "chat", label).where("category = 'bad'").count() == 1


def test_extra_chat_fields_keep_their_types(spark, rows):
    items = [{**CHAT[0], "n": 3, "f": 0.5, "l": [1, "x", None], "o": {"a": {"b": True}}, "s": "5", "z": None}, {"id": 2, "text": "t"}, {"id": 3, "text": "t", "_n": 1}]
    df = normalize_chat(rows("item string", [(json.dumps(i),) for i in items]), "chat", typed=True)
    got = {r["i"]: json.loads(r["e"]) if r["e"] else None for r in df.selectExpr("metadata['original_id'] AS i", "to_json(extra) AS e").collect()}
    assert got == {"1": {"toxic": True, "lang": "pt", "n": 3, "f": 0.5, "l": [1, "x", None], "o": {"a": {"b": True}}, "s": "5", "z": None}, "2": None, "3": None}


def test_single_chat_object(spark, tmp_path, rows):
    items = scan_chat_json(spark, save(tmp_path / "c.json", CHAT[1]))
    assert [r["item_index"] for r in items.collect()] == [0]
    # An array element with a "data" field is an item, not a wrapper.
    inner = chat_items(rows("value string", [('[{"id": 1, "data": [1, 2]}]',)]))
    assert inner.count() == 1


def test_result_files_fall_back_and_keep_raw(spark, tmp_path):
    good = {"is_safe": True, "score": -1, "category": ["b", "a"], "latency": 2.5, "model_name": "m",
            "timestamp": "2026-02-25T00:21:00.754028+00:00", "instance_index": 4, "iteration": 1}
    doc = {"model": "m", "metrics": {"a": 1}, "predictions": [
        {"request_text": "t0", "request_metadata": {"category": "safe", "original_id": 3}, "prediction": good},
        {"request_text": "t1", "response": {**good, "category": "x"}},
        {"request_text": "t2", "result": "just text"},
        {"request_text": "t3", "prediction": {"is_safe": True}},
        {"request_text": "t4", "prediction": None},
    ]}
    path = save(tmp_path / "r.json", doc)
    r = scan_results(spark, path).orderBy("position").collect()
    assert (r[0]["categories"], r[0]["category"], r[0]["actual"], r[0]["metadata"]["original_id"]) == (["b", "a"], "b", "safe", "3")
    assert r[0]["timestamp"].isoformat() == "2026-02-25T00:21:00.754028"
    assert (r[1]["categories"], r[1]["instance_index"]) == (["x"], 4)
    for k, raw in ((2, "just text"), (3, '{"is_safe":true}'), (4, None)):
        assert (r[k]["is_safe"], r[k]["score"], r[k]["latency"], r[k]["model_name"], r[k]["raw_response"]) == (False, 0.0, 0.0, "unknown", raw)
    [m] = scan_result_metrics(spark, path).collect()
    assert json.loads(m["metrics"]) == {"a": 1}
    [n] = scan_result_metrics(spark, save(tmp_path / "n.json", {"x": 1, "r": {"metrics": {"b": 2}}})).collect()
    assert json.loads(n["metrics"]) == {"b": 2}
    with pytest.raises(Exception, match="no metrics"):
        scan_result_metrics(spark, save(tmp_path / "z.json", {"x": 1})).collect()


def test_log_lines(spark, tmp_path):
    text = (
        "2026-02-22 22:06:58 | INFO     | Loaded 109 samples from dataset\n"
        "2026-02-22 22:06:59 | ERROR    | a | b\n"
        "Traceback line\n"
    )
    lines = scan_run_logs(spark, save(tmp_path / "run.log", text)).collect()
    assert [(r["level"], r["message"]) for r in lines] == [
        ("INFO", "Loaded 109 samples from dataset"), ("ERROR", "a | b"), (None, "Traceback line"),
    ]
    assert lines[0]["ts"].isoformat() == "2026-02-22T22:06:58" and lines[2]["ts"] is None


def test_sinks_round_trip_and_rerun(spark, rows, tmp_path):
    report = rows("model_name string, f1 double", [("m", 0.5), ("n", 0.25)])
    path = str(tmp_path / "results")
    write_results(report, path, "exp", 0, "d", classes={"safe": "ok"})
    write_results(report, path, "exp", 1, "d", mode="overwrite")
    write_results(report.where("model_name = 'm'"), path, "exp", 1, "d", mode="overwrite")
    back = spark.read.parquet(path)
    # Index 0 is untouched, index 1 was replaced.
    assert back.groupBy("experiment_index").count().orderBy("experiment_index").collect() == [(0, 2), (1, 1)]
    assert next_experiment_index(back.select("experiment", "experiment_index")).collect() == [("exp", 2)]
    names = rows("experiment string", [("exp",), ("new",)])
    assert sorted(map(tuple, next_experiment_index(back, names, first=1).collect())) == [("exp", 2), ("new", 1)]
    responses = rows("model_name string, instance_index long, iteration int, is_safe boolean, category string",
                     [("m", 1, 0, True, "safe"), ("m", 1, 1, False, None)])
    requests = rows("instance_index long, text string, category string", [(1, "t", "safe"), (2, "u", "safe")])
    out = str(tmp_path / "predictions")
    write_predictions(responses, requests, out, "exp", 0, fmt="json")
    got = spark.read.json(out)
    assert got.count() == 2 and got.where("request_text = 't'").count() == 2


def test_json_record_keeps_nulls_and_iso_times(spark):
    df = spark.sql("SELECT timestamp'2024-01-02 03:04:05.678' AS t, map('k', 1) AS m, CAST(NULL AS STRING) AS n")
    record = df.select(json_record(["t", "m", "n"]).alias("r")).collect()[0]["r"]
    assert json.loads(record) == {"t": "2024-01-02T03:04:05.678000Z", "m": {"k": 1}, "n": None}


def drawn(rng, depth=0):
    """Any JSON value, with texts that look like structure."""
    texts = ["a", "}", "{", '"', "\\", '\\"', '}"', '\\\\"}', ",", ":", "[", "]", "é", "日", "\n", '","', '":[{"', '{"metrics":1}']
    text = "".join(rng.choice(texts) for _ in range(rng.randint(0, 6)))
    k = rng.random()
    if k < 0.3 or depth > 4:
        return text
    if k < 0.45:
        return rng.choice([1, -2.5, True, False, None])
    names = [text, "metrics", "k", text + "x"]
    if k < 0.75:
        return {rng.choice(names): drawn(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    return [drawn(rng, depth + 1) for _ in range(rng.randint(0, 4))]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_large_documents_are_cut_anywhere(spark, tmp_path, seed):
    """Items of documents read in a dozen ranges each equal those of the whole documents."""
    rng, want = random.Random(seed), []
    for f in range(4):
        if f % 2:
            doc = [drawn(rng, 1) for _ in range(rng.randint(0, 500))]
        else:
            doc = {rng.choice(["safe", "p}q"]) if rng.random() < 0.4 else f"k{i}": drawn(rng) if rng.random() < 0.3 else [drawn(rng, 1) for _ in range(rng.randint(0, 200))]
                   for i in range(rng.randint(2, 6))}
        text = json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1, 4])) + rng.choice(["", " ", "\n\n"])
        (tmp_path / f"{f}.json").write_text(text)
        name = f"{f}.json"
        for k, v in [(None, doc)] if isinstance(doc, list) else doc.items():
            if isinstance(v, list):
                want += [(name, k, "[", i, json.dumps(x, sort_keys=True)) for i, x in enumerate(v)]
            elif not isinstance(v, dict):
                want.append((name, k, "s", None, json.dumps(v, sort_keys=True)))
    size = sum(p.stat().st_size for p in tmp_path.iterdir())
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(max(3_000, size // 13)))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() >= 8
        rows = split_items(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = [(r["source_file"].rsplit("/", 1)[1], r["key"], r["kind"], r["item_index"], json.dumps(json.loads(r["item"]), sort_keys=True)) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    """A file of 20 MB in ranges of 2 MB: as many tasks, and the rows of the whole-file form."""
    item = '{"id": %d, "message": "m } { \\" \\\\ ] %d", "parameters": {"aspect": "a%d", "style": "}"}, "explanation": "%s"}'
    text = ",\n".join(item % (i, i, i % 7, "x" * (i % 400)) for i in range(60_000))
    path = save(tmp_path / "big.json", '{"other": {"a": [1]}, "unsafe": [%s],\n"n": 3, "safe": [%s], "unethical": []}' % (text, text[: text.index("\n") - 1]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(2 << 20))
    try:
        assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() >= 8
        got = scan_category_json(spark, path, split=True)
        whole = scan_category_json(spark, path)
        assert got.count() == whole.count() == 60_001 and got.exceptAll(whole).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("limit", [20, 10**6])
def test_split_forms_equal_whole_forms(spark, tmp_path, limit, monkeypatch):
    """Small files too, with the starts of ranges broadcast or joined by key."""
    monkeypatch.setattr(json_blocks, "MOST_BROADCAST", limit if limit > 100 else 0)
    path = save(tmp_path / "d.json", ITEMS)
    assert sorted(scan_category_json(spark, path, split=True).collect()) == sorted(scan_category_json(spark, path).collect())
    for name, shape in (("a", CHAT), ("b", {"data": CHAT, "v": 1}), ("c", []), ("e", {"v": "x", "data": []})):
        path = save(tmp_path / f"{name}.json", shape)
        got, want = scan_chat_json(spark, path, split=True), scan_chat_json(spark, path)
        parsed = [sorted((r["item_index"], json.dumps(json.loads(r["item"]))) for r in x.collect()) for x in (got, want)]
        assert parsed[0] == parsed[1] and got.columns == want.columns


def test_split_reading_raises_on_bad_files(spark, tmp_path):
    for i, text in enumerate(('{"safe": [1, 2', '[{"a": "x}, {"b": 1}]', '[{"a": 1}, {"b" 2}]', "12", "[1]]")):
        with pytest.raises(Exception, match="invalid JSON"):
            scan_chat_json(spark, save(tmp_path / f"{i}.json", text), split=True).collect()


def find(obj, key):
    if isinstance(obj, dict):
        if key in obj:
            return obj[key]
        obj = list(obj.values())
    for v in obj if isinstance(obj, list) else []:
        found = find(v, key)
        if found is not None:
            return found
    return None


def test_first_member_at_any_depth(spark, rows):
    rng = random.Random(8)
    docs = [drawn(rng) for _ in range(1_500)] + [
        {"a": [{"b": {"metrics": 1}}], "metrics": 2}, {"a": {"metrics": None, "c": {"metrics": 3}}, "d": [[{"metrics": 4}]]},
        {"metrics": {"x": [1, {"metrics": 5}]}}, {"metrics": None, "z": {"metrics": 6}}, [[[[{"q": {"metrics": {"deep": True}}}]]]], [], {},
    ]
    texts = [json.dumps(d, indent=rng.choice([None, 2])) for d in docs] + [None, '{"a": {"\\u006detrics": 7}}']
    df = rows("i int, t string", list(enumerate(texts))).withColumn("m", first_member(F.col("t"), "metrics"))
    found = 0
    for r in df.collect():
        want = None if r["t"] is None else find(json.loads(r["t"]), "metrics")
        got = r["m"] if r["m"] is None or isinstance(want, str) else json.loads(r["m"])
        assert got == want, r["t"]
        found += want is not None
    assert found > 100


def test_predictions_at_any_depth(spark, tmp_path):
    good = {"is_safe": True, "score": 1.5, "category": "a", "latency": 2.5, "model_name": "m"}
    records = [{"request_text": f"t{i}", "prediction": good} for i in range(3)]
    nested = save(tmp_path / "n.json", {"run": [{"x": 1}, {"metrics": {"a": 1}, "predictions": records}]})
    top = save(tmp_path / "t.json", {"model": "m}1", "predictions": records, "dataset": "d"})
    want = [("t0", 0), ("t1", 1), ("t2", 2)]
    assert sorted((r["text"], r["position"]) for r in scan_results(spark, nested).collect()) == want
    whole, split = (sorted(scan_results(spark, top, split=x).collect(), key=lambda r: r["position"]) for x in (False, True))
    assert whole == split and [(r["text"], r["position"], r["run_model"], r["dataset"]) for r in split] == [(*w, "m}1", "d") for w in want]
