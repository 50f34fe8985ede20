"""Scans and sinks: Spark writes the given tables in the file format, then the
reader under test reads them back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from veritally.operators.binary import binary_accumulative, binary_metrics
from veritally.operators.align import align_predictions
from veritally.operators.requests import conversation_texts, normalize_chat
from veritally.operators.views import run_summary
from veritally.plans.shared import discard, scratch_path
from veritally.sources.category_json import CATEGORY_KEYS, scan_category_json
from veritally.sources.chat_json import scan_chat_json
from veritally.sources.result_files import scan_result_metrics, scan_results
from veritally.sources.run_logs import scan_run_logs
from veritally.sources.sinks import (
    json_record,
    next_experiment_index,
    save_run,
    write_predictions,
    write_results,
)

from . import views as v
from .registry import query, rounded
from .sql import BINARY

# Items per staged JSON object: keeps every group and line small.
OBJECT_ITEMS = 500


def stage_category_objects(spark: SparkSession, d: str) -> str:
    """Labelled documents as lines of category-keyed objects."""
    item = F.struct(
        F.col("instance_index").alias("id"),
        F.struct(F.col("lang").alias("aspect"), F.col("source").alias("style")).alias("parameters"),
        F.col("text").alias("message"),
    )
    bucket = F.floor(F.col("instance_index") / OBJECT_ITEMS)
    classes = [
        F.array_sort(F.collect_list(F.when(F.col("category") == c, item))).alias(c)
        for c in CATEGORY_KEYS
    ]
    path = scratch_path(spark, "category-objects")
    objects = v.requests(spark, d).groupBy(bucket.alias("bucket")).agg(*classes)
    objects.select(
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in CATEGORY_KEYS])).alias("value")
    ).write.text(path)
    return path


@query(
    "scan_category_json",
    """
    SELECT instance_index, category, lang AS aspect, source AS style, text AS message,
      CAST(row_number() OVER (PARTITION BY instance_index // 500
        ORDER BY CASE category WHEN 'safe' THEN 1 WHEN 'unethical' THEN 2 ELSE 3 END, instance_index) - 1
        AS BIGINT) AS item_index
    FROM v_requests
    """,
)
def q_scan_category_json(spark, d):
    items = scan_category_json(spark, stage_category_objects(spark, d), lines=True)
    return items.select(
        F.col("id").cast("long").alias("instance_index"), "category", "aspect", "style", "message",
        "item_index",
    )


def chat_items(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as chat items (one JSON object string each)."""
    turn = F.struct("turn", "role", F.col("text").alias("content"))
    messages = F.transform(
        F.array_sort(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))
    )
    return (
        v.table(spark, d, "conversations")
        .groupBy("conv_id")
        .agg(messages.alias("messages"), F.count(F.lit(1)).alias("turns"))
        .select(
            F.to_json(
                F.struct(
                    F.col("conv_id").alias("id"),
                    "messages",
                    (F.col("conv_id") % 3 == 0).alias("toxic"),
                    "turns",
                    F.lit("x").alias("_node"),
                )
            ).alias("item")
        )
    )


_CHAT_SQL = """
    SELECT conv_id AS id, string_agg(text, chr(10) ORDER BY turn) AS text,
      conv_id % 3 = 0 AS toxic, CAST(count(*) AS VARCHAR) AS turns,
      CASE WHEN conv_id % 3 = 0 THEN 'unethical' ELSE 'safe' END AS category, 4 AS n_metadata
    FROM conversations GROUP BY conv_id
"""


def _chat_rows(items: DataFrame) -> DataFrame:
    label = F.when(F.col("toxic"), "unethical").otherwise("safe")
    return normalize_chat(items, "chat", label).select(
        F.try_element_at("metadata", F.lit("original_id")).cast("long").alias("id"),
        "text",
        "toxic",
        F.try_element_at("metadata", F.lit("turns")).alias("turns"),
        "category",
        F.size("metadata").alias("n_metadata"),
    )


@query("scan_chat_json", _CHAT_SQL)
def q_scan_chat_json(spark, d):
    path = scratch_path(spark, "chat-items")
    chat_items(spark, d).write.text(path)
    return _chat_rows(scan_chat_json(spark, path, lines=True).select("item"))


@query("normalize_chat", _CHAT_SQL)
def q_normalize_chat(spark, d):
    return _chat_rows(chat_items(spark, d))


@query(
    "extract_chat_text",
    """
    SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text
    FROM conversations GROUP BY conv_id
    """,
)
def q_extract_chat_text(spark, d):
    return conversation_texts(v.table(spark, d, "conversations"))


def stage_result_objects(spark: SparkSession, d: str) -> str:
    """Predictions as lines of saved-result objects, up to 1000 records each."""
    responses = v.responses(spark, d)
    labels = v.requests(spark, d).select("instance_index", F.col("category").alias("actual"), "source", "text")
    # One model saves scalar classes, the others lists, as real files do.
    category = F.when(
        F.col("model_name") == "model_a", F.col("category").cast("variant")
    ).when(F.col("category").isNotNull(), F.array("category").cast("variant"))
    prediction = F.struct(
        "is_safe", "score", category.alias("category"), "latency", "model_name",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"),
        "instance_index", "iteration",
    )
    # A text is moved once, with all answers to it; it is repeated only where a bucket's lines are made.
    answers = responses.select("instance_index", prediction.alias("p")).groupBy("instance_index").agg(F.collect_list("p").alias("answers"))
    asked = F.struct(
        F.col("text").alias("request_text"),
        F.struct(F.col("source").alias("source"), F.col("actual").alias("category")).alias("request_metadata"),
        "answers",
    )
    buckets = (
        answers.join(labels, "instance_index")
        .groupBy(F.floor(F.col("instance_index") / 200).alias("bucket"))
        .agg(F.collect_list(asked).alias("asked"))
        .select("asked", F.explode(F.array(*[F.lit(m) for m in v.MODELS])).alias("model_name"))
    )
    own = lambda r: F.filter(r["answers"], lambda p: p["model_name"] == F.col("model_name"))
    record = lambda r, p: F.struct(r["request_text"], r["request_metadata"], p.alias("prediction"))
    predictions = F.flatten(F.transform("asked", lambda r: F.transform(own(r), lambda p: record(r, p))))
    groups = buckets.select("model_name", predictions.alias("predictions")).withColumn("n", F.size("predictions").cast("long"))
    path = scratch_path(spark, "result-objects")
    groups.where("n > 0").select(
        F.to_json(
            F.struct(
                F.col("model_name").alias("model"), F.lit("documents").alias("dataset"),
                F.col("n").alias("total_samples"),
                F.struct(F.col("n").alias("total_samples")).alias("metrics"),
                "predictions",
            )
        ).alias("value")
    ).write.option("compression", "gzip").text(path)
    return path


@query(
    "scan_results",
    """
    SELECT r.model_name, r.instance_index, r.iteration, r.is_safe, r.predicted, r.actual, r.latency, r.ts_s, md5(q.text) AS text_md5
    FROM v_responses r JOIN v_requests q USING (instance_index)
    """,
)
def q_scan_results(spark, d):
    saved = scan_results(spark, stage_result_objects(spark, d), lines=True)
    return saved.select(
        "model_name", "instance_index", "iteration", "is_safe", F.col("category").alias("predicted"),
        "actual", "latency", F.unix_seconds("timestamp").alias("ts_s"), F.md5("text").alias("text_md5"),
    )


# Items of a staged whole document: one document per so many keys.
DOCUMENT_ITEMS = 20_000


def stage_documents(
    rows: DataFrame, name: str, group: Column, first: Column, last: Column, item: Column | None = None, within: tuple[str, ...] = ()
) -> str:
    """One JSON document of many lines per ``doc``: items in the order of
    (``ord``, ``id``) between the texts of ``first``, ``group`` and ``last``.

    ``item`` is the text of a row's items, by default its column of that name;
    it is made after the rows are in order.  ``within`` names columns that a
    document has one value of, by which the rows may be together already.
    """
    keys = ("doc", *within)
    order = Window.partitionBy(*keys).orderBy("ord", "id")
    before, after = F.lag("ord").over(order), F.lead("ord").over(order)
    placed = rows.select("*", before.alias("before"), after.alias("after"))
    start = F.when(F.col("before").isNull(), F.concat(first, group)).when(F.col("before") != F.col("ord"), F.concat(F.lit("], "), group)).otherwise(",")
    line = F.concat(start, F.col("item") if item is None else item, F.when(F.col("after").isNull(), last).otherwise(""))
    path = scratch_path(rows.sparkSession, name)
    lines = placed.select(*keys, "ord", "id", line.alias("value")).sortWithinPartitions(*keys, "ord", "id")
    lines.select("doc", "value").write.partitionBy("doc").text(path)
    return path


def document_of(key: str) -> Column:
    return F.floor(F.col(key) / DOCUMENT_ITEMS).alias("doc")


@query(
    "scan_category_documents",
    """
    SELECT instance_index // 20000 AS doc, instance_index, category, lang AS aspect, source AS style, text AS message,
      CAST(row_number() OVER (PARTITION BY instance_index // 20000
        ORDER BY CASE category WHEN 'safe' THEN 1 WHEN 'unethical' THEN 2 ELSE 3 END, instance_index) - 1
        AS BIGINT) AS item_index
    FROM v_all_requests
    """,
)
def q_scan_category_documents(spark, d):
    """Whole documents of many items, each read by many tasks."""
    item = F.struct(
        F.col("instance_index").alias("id"),
        F.struct(F.col("lang").alias("aspect"), F.col("source").alias("style")).alias("parameters"),
        F.col("text").alias("message"),
    )
    # In the documents the classes stand in another order than they are read in.
    rows = v.all_requests(spark, d).select(
        document_of("instance_index"), F.col("category").alias("ord"), F.col("instance_index").alias("id"), F.to_json(item).alias("item")
    )
    path = stage_documents(
        rows, "category-documents", F.concat(F.lit('"'), "ord", F.lit('": [\n')), F.lit('{"other": {"safe": [0]},\n'), F.lit("]}")
    )
    return scan_category_json(spark, path, split=True).select(
        F.regexp_extract("source_file", r"doc=(-?\d+)", 1).cast("long").alias("doc"), F.col("id").cast("long").alias("instance_index"),
        "category", "aspect", "style", "message", "item_index",
    )


@query("scan_chat_documents", _CHAT_SQL)
def q_scan_chat_documents(spark, d):
    """Arrays, and objects with a ``data`` array, read by many tasks each."""
    id = F.get_json_object("item", "$.id").cast("long")
    rows = chat_items(spark, d).select(id.alias("id"), "item").select(document_of("id"), F.lit(0).alias("ord"), "id", "item")
    odd = F.col("doc") % 2 == 1
    path = stage_documents(
        rows, "chat-documents", F.lit("[\n"), F.when(odd, '{"data": ').otherwise(""), F.when(odd, '], "v": 1}').otherwise("]")
    )
    return _chat_rows(scan_chat_json(spark, path, split=True).select("item"))


# Result documents are staged in one group for so many bytes that all answers to all texts would take, but in
# no more groups than the second number, since the tables are read for each.
GROUP_BYTES, MOST_GROUPS = 8 << 30, 8


def result_document_groups(spark: SparkSession, d: str) -> int:
    size = v.table(spark, d, "documents").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, min(MOST_GROUPS, -(-size * len(v.MODELS) * v.ITERATIONS // GROUP_BYTES)))


def stage_result_documents(spark: SparkSession, d: str, group: int = 0, groups: int = 1) -> str:
    """Saved results as one document per model and range of keys; of several ``groups`` of ranges, one."""
    here = F.pmod(F.xxhash64(document_of("instance_index")), F.lit(groups)) == group if groups > 1 else F.lit(True)
    labels = v.requests(spark, d).where(here).select("instance_index", F.col("category").alias("actual"), "text")
    prediction = F.struct("is_safe", "score", "category", "latency", "model_name", "instance_index", "iteration")
    answer = F.struct("iteration", prediction.alias("prediction"))
    # A text goes to its range of keys once for all answers, is repeated there for the models, and for their answers in the lines.
    answers = v.responses(spark, d).where(here).groupBy("instance_index").agg(F.collect_list(answer).alias("answers"))
    asked = answers.join(labels, "instance_index").withColumn("keys", document_of("instance_index")).repartition("keys")
    models = F.array_distinct(F.transform("answers", lambda a: a["prediction"]["model_name"]))
    own = F.filter("answers", lambda a: a["prediction"]["model_name"] == F.col("model_name"))
    rows = asked.select("*", F.explode(models).alias("model_name")).select(
        F.concat_ws("-", "model_name", "keys").alias("doc"), "keys", F.lit(0).alias("ord"), F.col("instance_index").alias("id"),
        "model_name", "text", "actual", F.array_sort(own).alias("answers"),
    )
    record = lambda a: F.struct(
        F.col("text").alias("request_text"), F.struct(F.col("actual").alias("category")).alias("request_metadata"),
        a["prediction"].alias("prediction"),
    )
    items = F.array_join(F.transform("answers", lambda a: F.to_json(record(a))), ",\n")
    first = F.concat(F.lit('{"model": "run-'), "model_name", F.lit('", "metrics": {"n": [1]},\n'))
    return stage_documents(
        rows, "result-documents", F.lit('"predictions": [\n'), first, F.lit('], "total_samples": 1}'), items, within=("keys",)
    )


@query(
    "scan_result_documents",
    """
    SELECT r.model_name, r.instance_index, r.iteration, r.is_safe, r.predicted, r.actual, r.latency, md5(q.text) AS text_md5,
      'run-' || r.model_name AS run_model
    FROM v_responses r JOIN v_requests q USING (instance_index)
    """,
)
def q_scan_result_documents(spark, d):
    """Result files of whole runs, each read by many tasks.

    The files hold every text once per answer.  So they are staged in groups,
    and a group is deleted when its records are cut out and stored.
    """
    groups = result_document_groups(spark, d)
    saved = []
    for group in range(groups):
        path = stage_result_documents(spark, d, group, groups)
        saved.append(scan_results(spark, path, split=True))
        discard(spark, path)
    return reduce(DataFrame.unionByName, saved).select(
        "model_name", "instance_index", "iteration", "is_safe", F.col("category").alias("predicted"), "actual", "latency",
        F.md5("text").alias("text_md5"), "run_model",
    )


def nested_result(depth: Column, metrics: Column, name: Column) -> Column:
    """A result object with its metrics ``depth`` levels down, through objects and lists, between others that do not count."""
    inner = F.concat(F.lit('{"text": "\\"metrics\\": {1", "metrics": '), metrics, F.lit("}"))
    wrap = F.aggregate(
        F.sequence(F.lit(1), depth), inner,
        lambda acc, i: F.when(i % 2 == 0, F.concat(F.lit('[{"metrics": null, "in": {"metrics": 1}}, 7, '), acc, F.lit("]"))).otherwise(
            F.concat(F.lit('{"b": '), acc, F.lit(', "a": {"metrics": {"n": -1}}}'))
        ),
    )
    return F.when(depth == 0, inner).otherwise(F.concat(F.lit('{"model": "'), name, F.lit('", "runs": '), wrap, F.lit("}")))


@query(
    "scan_result_metrics",
    """
    SELECT CASE WHEN depth = 0 THEN NULL ELSE model_name END AS model, '{"n":' || n || ',"bucket":' || bucket || '}' AS metrics
    FROM (SELECT model_name, instance_index // 10 AS bucket, count(*) AS n, (instance_index // 10) % 7 AS depth
          FROM v_all_responses GROUP BY ALL)
    """,
)
def q_scan_result_metrics(spark, d):
    """Metrics at the top and up to six levels down, through objects and lists."""
    bucket = F.floor(F.col("instance_index") / 10)
    runs = v.all_responses(spark, d).groupBy("model_name", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    metrics = F.concat(F.lit('{"n": '), "n", F.lit(', "bucket": '), "bucket", F.lit("}"))
    path = scratch_path(spark, "nested-results")
    runs.select(nested_result((F.col("bucket") % 7).cast("int"), metrics, F.col("model_name")).alias("value")).write.text(path)
    return scan_result_metrics(spark, path, lines=True).select("model", "metrics")


def errors(spark: SparkSession, d: str) -> DataFrame:
    """The failed calls with an error text per branch."""
    i = F.col("instance_index") % 4
    hint = F.concat(
        F.lit("429 RESOURCE_EXHAUSTED. Please retry in "), F.col("n_chars") % 50, F.lit(".5s")
    )
    error = (
        F.when(i == 0, hint)
        .when(i == 1, "Quota exceeded for requests per minute")
        .when(i == 2, "Invalid response format from service: missing key")
        .otherwise("Unexpected error during evaluation: Quota exceeded")
    )
    return v.slots(spark, d, labelled=False).where(F.col("h") == 19).select(
        "model_name", "instance_index", "iteration", (F.col("iteration") + 1).alias("attempt"),
        error.alias("error"),
    )


def stage_logs(spark: SparkSession, d: str) -> str:
    """One folder of log lines per model and iteration."""
    run = F.concat_ws("-", "model_name", "iteration")
    at = F.unix_seconds("timestamp")
    samples = v.all_requests(spark, d).agg(F.count(F.lit(1)).alias("samples"))
    runs = (
        v.all_responses(spark, d).groupBy("model_name", "iteration")
        .agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
        .join(F.broadcast(samples))  # one row
    )
    steps = F.array(
        F.struct(
            F.col("first").alias("ts_s"),
            F.concat(F.lit("Loaded "), "samples", F.lit(" samples from dataset")).alias("message"),
        ),
        F.struct(
            F.col("first").alias("ts_s"),
            F.concat(F.lit("Evaluating "), "model_name", F.lit(" on "), "samples", F.lit(" samples")).alias("message"),
        ),
        F.struct(
            (F.col("last") + 60).alias("ts_s"),
            F.concat(F.lit("Completed evaluation. Got "), "n", F.lit(" responses")).alias("message"),
        ),
    )
    info = runs.select(run.alias("run"), F.lit("INFO").alias("level"), F.inline(steps))
    failed = errors(spark, d).select(
        run.alias("run"), F.lit("ERROR").alias("level"),
        (F.lit(v.EPOCH) + F.col("instance_index") * 5 + F.col("iteration")).alias("ts_s"),
        F.concat(F.lit("Call "), "instance_index", F.lit(" failed: "), "error").alias("message"),
    )
    path = scratch_path(spark, "logs")
    line = F.concat_ws(
        " | ", F.date_format(F.timestamp_seconds("ts_s"), "yyyy-MM-dd HH:mm:ss"),
        F.rpad("level", 8, " "), "message",
    )
    info.unionByName(failed).select("run", line.alias("value")).hint("rebalance", "run").write.partitionBy(
        "run"
    ).text(path)
    return path


def run_of(lines: DataFrame) -> DataFrame:
    """The run folder of a log line."""
    return lines.withColumn("run", F.regexp_extract("source_file", r"/run=([^/]+)/", 1))


@query("scan_run_logs", "SELECT run, ts_s, level, message FROM v_log")
def q_scan_run_logs(spark, d):
    lines = run_of(scan_run_logs(spark, stage_logs(spark, d)))
    return lines.select("run", F.unix_seconds("ts").alias("ts_s"), "level", "message")


def aligned(spark: SparkSession, d: str) -> DataFrame:
    return align_predictions(v.responses(spark, d), v.requests(spark, d), v.SAFE)


@query(
    "write_results",
    """
    SELECT 'demo' AS experiment, 7 AS experiment_index, 'documents' AS dataset, model_name,
      round(macro_accuracy, 6) AS macro_accuracy, round(macro_f1, 6) AS macro_f1, round(micro_f1, 6) AS micro_f1
    FROM v_binary_acc
    """,
)
def q_write_results(spark, d):
    path = scratch_path(spark, "results")
    report = binary_accumulative(aligned(spark, d), v.ITERATIONS)
    write_results(report, path, "demo", 7, "documents", classes=v.CLASSES)
    back = spark.read.parquet(path)
    return rounded(
        back.select("experiment", "experiment_index", "dataset", "model_name", "macro_accuracy", "macro_f1", "micro_f1"),
        "macro_accuracy", "macro_f1", "micro_f1",
    )


@query(
    "write_predictions",
    """
    SELECT 'demo' AS experiment, 7 AS experiment_index, r.model_name, r.instance_index, r.iteration,
      r.is_safe, r.predicted, q.category AS actual, md5(q.text) AS text_md5
    FROM v_responses r JOIN v_requests q ON r.instance_index = q.instance_index
    """,
)
def q_write_predictions(spark, d):
    path = scratch_path(spark, "predictions")
    write_predictions(v.responses(spark, d), v.requests(spark, d), path, "demo", 7)
    p = F.col("prediction")
    return spark.read.parquet(path).select(
        "experiment", "experiment_index", p["model_name"].alias("model_name"),
        p["instance_index"].alias("instance_index"), p["iteration"].alias("iteration"),
        p["is_safe"].alias("is_safe"), p["category"].alias("predicted"),
        F.col("request_category").alias("actual"), F.md5("request_text").alias("text_md5"),
    )


@query(
    "to_json_record",
    """
    SELECT r.model_name, r.instance_index, r.iteration, CAST(json_object(
      'request_category', r.actual, 'prediction', json_object('is_safe', r.is_safe, 'category', r.predicted,
        'latency', r.latency, 'instance_index', r.instance_index, 'iteration', r.iteration,
        'timestamp', strftime(make_timestamp(r.ts_s * 1000000), '%Y-%m-%dT%H:%M:%S.%f') || 'Z')) AS VARCHAR) AS record
    FROM v_responses r
    """,
)
def q_to_json_record(spark, d):
    prediction = F.struct(
        F.col("predicted_safe").alias("is_safe"), F.col("predicted").alias("category"), "latency",
        "instance_index", "iteration", "timestamp",
    )
    rows = aligned(spark, d).select(
        "model_name", "instance_index", "iteration", F.col("actual").alias("request_category"),
        prediction.alias("prediction"),
    )
    return rows.select(
        "model_name", "instance_index", "iteration",
        json_record(["request_category", "prediction"]).alias("record"),
    )


@query(
    "next_experiment_index",
    """
    SELECT e.experiment, CAST(coalesce(max(r.iteration) + 1, 0) AS INTEGER) AS next_index
    FROM (SELECT DISTINCT model_name AS experiment FROM v_all_responses
          UNION SELECT DISTINCT category FROM v_all_requests) e
    LEFT JOIN v_all_responses r ON r.model_name = e.experiment GROUP BY e.experiment
    """,
)
def q_next_experiment_index(spark, d):
    runs = v.all_responses(spark, d).select(
        F.col("model_name").alias("experiment"), F.col("iteration").alias("experiment_index")
    )
    names = (
        runs.select("experiment")
        .union(v.all_requests(spark, d).select("category"))
        .distinct()
    )
    return next_experiment_index(runs, names)


@query(
    "run_summary",
    f"""
    SELECT 'demo' AS experiment, 'documents' AS dataset, model_name, metric, round(value, 4) AS value FROM (
      SELECT model_name, unnest(['accuracy', 'precision', 'recall', 'f1']) AS metric,
        unnest([accuracy, "precision", recall, f1]) AS value
      FROM (SELECT model_name, {BINARY} FROM v_binary))
    """,
)
def q_run_summary(spark, d):
    metrics = ("accuracy", "precision", "recall", "f1")
    return run_summary(
        binary_metrics(aligned(spark, d)), metrics, experiment="demo", dataset="documents"
    )


@query(
    "claimed_runs",
    f"""
    SELECT 'demo' AS experiment, i.experiment_index, model_name, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1
    FROM (SELECT model_name, {BINARY} FROM v_binary) CROSS JOIN (VALUES (0), (1)) i(experiment_index)
    """,
)
def q_claimed_runs(spark, d):
    """Two runs of an experiment, each under a number of its own."""
    path = scratch_path(spark, "claimed")
    report = binary_metrics(aligned(spark, d)).select("model_name", "accuracy", "f1")
    for _ in range(2):
        save_run(report, path, "demo", "documents")
    back = spark.read.parquet(path).select("experiment", "experiment_index", "model_name", "accuracy", "f1")
    return rounded(back, "accuracy", "f1")


@query(
    "chat_typed_fields",
    """
    SELECT conv_id AS id, count(*) AS turns, conv_id % 3 = 0 AS toxic, list(CAST(turn AS BIGINT) ORDER BY turn) AS marks,
      CAST(max(turn) AS BIGINT) AS last
    FROM conversations GROUP BY conv_id
    """,
)
def q_chat_typed_fields(spark, d):
    """Extra fields of chat items keep their types: numbers, booleans, lists, objects."""
    marks = F.array_sort(F.collect_list("turn"))
    items = v.table(spark, d, "conversations").groupBy("conv_id").agg(marks.alias("marks"), F.count(F.lit(1)).alias("turns")).select(
        F.to_json(F.struct(
            F.col("conv_id").alias("id"), F.lit("x").alias("text"), (F.col("conv_id") % 3 == 0).alias("toxic"), "turns", "marks",
            F.struct(F.array_max("marks").alias("last")).alias("about"),
        )).alias("item")
    )
    field = lambda path, kind: F.try_variant_get("extra", path, kind)
    return normalize_chat(items, "chat", typed=True).select(
        F.try_element_at("metadata", F.lit("original_id")).cast("long").alias("id"), field("$.turns", "bigint").alias("turns"),
        field("$.toxic", "boolean").alias("toxic"), field("$.marks", "array<bigint>").alias("marks"), field("$.about.last", "bigint").alias("last"),
    )
