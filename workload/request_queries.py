"""Projections, parsers and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from veritally.functions.labels import truth_is_safe
from veritally.functions.prompts import GUARD_HEAD, GUARD_TAIL
from veritally.functions.verdicts import HARM_CLASSES, MODERATION_CLASSES
from veritally.functions.labels import primary_category
from veritally.operators import parsing as P
from veritally.operators.align import (
    answered_requests,
    class_universe,
    dedupe_slots,
    failed_requests,
    map_taxonomy,
)
from veritally.operators.requests import (
    assign_batches,
    cross_models,
    expand_iterations,
    invalid_requests,
    normalize_academic,
    render_guard_prompts,
    render_prompts,
    stride_sample,
)

from . import views as v
from .file_queries import aligned
from .registry import query


@query(
    "normalize_academic",
    """
    SELECT instance_index, text, category, 'documents' AS source, CAST(instance_index AS VARCHAR) AS original_id,
      lang AS aspect, source AS style, '' AS explanation
    FROM v_all_requests
    """,
)
def q_normalize_academic(spark, d):
    items = v.all_requests(spark, d).select(
        "instance_index", F.col("instance_index").alias("id"), "category", F.col("lang").alias("aspect"),
        F.col("source").alias("style"), F.col("text").alias("message"), F.lit(None).cast("string").alias("explanation"),
    )
    rows = normalize_academic(items, "documents")
    keys = ("source", "original_id", "aspect", "style", "explanation")
    return rows.select(
        "instance_index", "text", "category",
        *[F.try_element_at("metadata", F.lit(k)).alias(k) for k in keys],
    )


@query(
    "invalid_requests",
    """
    SELECT instance_index, lang FROM v_prompts WHERE coalesce(text, '') = ''
    """,
)
def q_invalid_requests(spark, d):
    """Documents' whole texts; orders without a document have none."""
    return invalid_requests(v.prompts(spark, d)).select("instance_index", "lang")


@query(
    "expand_iterations",
    """
    SELECT instance_index, iteration, category, instance_index * 5 + iteration AS exp_index
    FROM v_all_requests CROSS JOIN v_iters
    """,
)
def q_expand_iterations(spark, d):
    return expand_iterations(v.all_requests(spark, d).select("instance_index", "category"), v.ITERATIONS)


@query(
    "assign_batches",
    """
    SELECT batch_no, count(*) AS size, min(exp_index) AS first_index, max(exp_index) AS last_index
    FROM (SELECT instance_index * 5 + iteration AS exp_index, (instance_index * 5 + iteration) // 64 AS batch_no
          FROM v_all_requests CROSS JOIN v_iters) GROUP BY batch_no
    """,
)
def q_assign_batches(spark, d):
    expanded = expand_iterations(v.all_requests(spark, d).select("instance_index"), v.ITERATIONS)
    return assign_batches(expanded, 64).groupBy("batch_no").agg(
        F.count(F.lit(1)).alias("size"), F.min("exp_index").alias("first_index"), F.max("exp_index").alias("last_index")
    )


@query(
    "truth_is_safe",
    """
    SELECT d.doc_id AS instance_index, q.category, coalesce(q.category = 'safe', false) AS actual_safe
    FROM documents d LEFT JOIN v_requests q ON d.doc_id = q.instance_index
    """,
)
def q_truth_is_safe(spark, d):
    """All documents: one without a label counts as unsafe."""
    docs = v.table(spark, d, "documents").select("doc_id")
    labels = v.table(spark, d, "labels").selectExpr("doc_id", v.LABEL)
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("instance_index"), "category", truth_is_safe("category", v.SAFE).alias("actual_safe")
    )


@query(
    "primary_category",
    """
    SELECT model_name, instance_index, iteration,
      CASE WHEN h < 6 THEN 'safe' WHEN h < 12 THEN 'unethical' WHEN h < 15 THEN 'off-topic' END AS primary_class
    FROM v_all_responses
    """,
)
def q_primary_category(spark, d):
    h = F.col("h")
    lists = (
        F.when(h < 6, F.array(F.lit("safe"), F.lit("unethical")))
        .when(h < 12, F.array(F.lit("unethical")))
        .when(h < 15, F.array(F.lit("off-topic"), F.lit("safe")))
        .when(h < 17, F.array().cast("array<string>"))
    )
    rows = v.all_responses(spark, d, keep_branch=True).withColumn("categories", lists)
    return rows.select(
        "model_name", "instance_index", "iteration", primary_category("categories").alias("primary_class")
    )


_BASE = "Classify the following text."


@query(
    "render_prompts",
    f"""
    SELECT instance_index, md5(prompt || text) AS prompt_md5, length(prompt) AS prompt_chars
    FROM v_all_requests CROSS JOIN (
      SELECT '{_BASE}' || chr(10) || chr(10) || 'Categories:' || chr(10)
        || '- safe: on topic and harmless' || chr(10) || '- unethical: ethically risky' || chr(10)
        || '- off-topic: unrelated to the subject' AS prompt)
    """,
)
def q_render_prompts(spark, d):
    rows = render_prompts(v.all_requests(spark, d), v.CLASSES, _BASE)
    return rows.select(
        "instance_index", F.md5(F.concat("system_prompt", "text")).alias("prompt_md5"),
        F.length("system_prompt").cast("long").alias("prompt_chars"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(
    "render_guard_prompts",
    f"SELECT instance_index, {_quoted(GUARD_HEAD)} || text || {_quoted(GUARD_TAIL)} AS prompt FROM v_all_requests",
)
def q_render_guard_prompts(spark, d):
    return render_guard_prompts(v.all_requests(spark, d)).select("instance_index", "prompt")


def guard_raw(spark: SparkSession, d: str) -> DataFrame:
    """Raw generations: every layout the parser has to tell apart."""
    h = F.col("h")
    raw = (
        F.when(h == 18, "safe")
        .when(h < 6, "\n\n safe")
        .when(h < 10, "\n\nunsafe\nA2")
        .when(h < 13, "head\nmeta\nunsafe\nA3\nA1\n")
        .when(h < 15, "\n\nunsafe\nS2")
        .when(h < 17, "\n\nunsafe\nA1,A3")
        .otherwise("\n\n\n")
    )
    return v.all_responses(spark, d, keep_branch=True).select(
        "model_name", "instance_index", "iteration", raw.alias("raw_response")
    )


@query(
    "parse_guard_output",
    """
    SELECT model_name, instance_index, iteration, h < 6 AS is_safe, -1.0::DOUBLE AS score,
      CASE WHEN h < 6 THEN NULL WHEN h < 10 THEN 'unethical' WHEN h < 13 THEN 'safe' END AS category,
      CASE WHEN h < 6 THEN NULL WHEN h < 10 THEN 'unethical' WHEN h < 13 THEN 'safe,off-topic' END AS categories
    FROM v_guard_raw WHERE length(raw_response) - length(replace(raw_response, chr(10), '')) >= 2
    """,
)
def q_parse_guard_output(spark, d):
    parsed = P.parse_guard_output(guard_raw(spark, d), v.CLASSES)
    return parsed.drop("raw_response").withColumn("categories", F.array_join("categories", ","))


@query(
    "guard_output_failures",
    "SELECT model_name, instance_index, iteration, raw_response FROM v_guard_raw WHERE h = 18",
)
def q_guard_output_failures(spark, d):
    return P.guard_output_failures(guard_raw(spark, d)).drop("error")


@query(
    "parse_label_output",
    """
    SELECT model_name, instance_index, iteration, h % 3 <> 0 AS is_safe, h / 20.0::DOUBLE AS score,
      CASE WHEN h % 3 = 0 THEN CASE WHEN h < 9 THEN 'hate_speech' WHEN h < 15 THEN 'S99' ELSE '' END END AS category
    FROM v_all_responses
    """,
)
def q_parse_label_output(spark, d):
    h = F.col("h")
    raw = v.all_responses(spark, d, keep_branch=True).select(
        "model_name", "instance_index", "iteration",
        F.when(h % 3 == 0, "UNSAFE").when(h % 3 == 1, "SAFE").alias("label"),
        (h / 20.0).alias("label_score"),
        F.when(h < 9, "unsafe: S3, S1").when(h < 15, "unsafe S99").otherwise("unsafe").alias("raw_response"),
    )
    return P.parse_label_output(raw).drop("label", "label_score", "raw_response")


_SCORE_NAMES = ("hate", "violence/graphic", "custom", "sexual")


@query(
    "parse_moderation_scores",
    """
    SELECT model_name, instance_index, iteration, NOT flagged AS is_safe,
      greatest(s1, s2, s3, s4) AS score,
      CASE WHEN flagged THEN
        CASE WHEN s1 >= greatest(s2, s3, s4) THEN 'hate_speech' WHEN s2 >= greatest(s3, s4) THEN 'violence'
             WHEN s3 >= s4 THEN 'custom' ELSE 'sexual_content' END END AS category
    FROM (SELECT *, h % 2 = 0 AS flagged, (n_chars % 5) / 8.0::DOUBLE AS s1, (n_chars % 7) / 8.0::DOUBLE AS s2,
            (instance_index % 6) / 8.0::DOUBLE AS s3, (h % 8) / 8.0::DOUBLE AS s4 FROM v_all_responses)
    """,
)
def q_parse_moderation_scores(spark, d):
    values = (F.col("n_chars") % 5, F.col("n_chars") % 7, F.col("instance_index") % 6, F.col("h") % 8)
    scores = F.map_from_arrays(
        F.array(*[F.lit(n) for n in _SCORE_NAMES]), F.array(*[x / 8.0 for x in values])
    )
    raw = v.all_responses(spark, d, keep_branch=True).select(
        "model_name", "instance_index", "iteration", (F.col("h") % 2 == 0).alias("flagged"),
        scores.alias("category_scores"),
    )
    return P.parse_moderation_scores(raw).drop("flagged", "category_scores")


@query(
    "parse_safety_ratings",
    """
    SELECT model_name, instance_index, iteration, greatest(p1, p2, p3) <= 2 AS is_safe,
      greatest(p1, p2, p3) / 4.0::DOUBLE AS score,
      CASE WHEN greatest(p1, p2, p3) > 2 THEN
        CASE WHEN p1 >= greatest(p2, p3) THEN 'harassment' WHEN p2 >= p3 THEN 'violence' ELSE 'HARM_OTHER' END END AS category
    FROM (SELECT *, 1 + n_chars % 4 AS p1, 1 + instance_index % 3 AS p2, 1 + h % 4 AS p3 FROM v_all_responses)
    """,
)
def q_parse_safety_ratings(spark, d):
    def rating(name, p):
        return F.struct(F.lit(name).alias("category"), (p + 1).cast("int").alias("probability"))

    ratings = F.array(
        rating("HARM_CATEGORY_HARASSMENT", F.col("n_chars") % 4),
        rating("HARM_CATEGORY_DANGEROUS_CONTENT", F.col("instance_index") % 3),
        rating("HARM_OTHER", F.col("h") % 4),
    )
    raw = v.all_responses(spark, d, keep_branch=True).select(
        "model_name", "instance_index", "iteration", ratings.alias("ratings")
    )
    return P.parse_safety_ratings(raw, names=HARM_CLASSES).drop("ratings")


@query(
    "parse_structured_category",
    """
    SELECT model_name, instance_index, iteration, predicted AS category, predicted = 'safe' AS is_safe,
      -1.0::DOUBLE AS score
    FROM v_responses WHERE predicted IN ('safe', 'unethical')
    """,
)
def q_parse_structured_category(spark, d):
    """Two allowed classes; a third one and NULL are failures."""
    raw = v.responses(spark, d).select(
        "model_name", "instance_index", "iteration", F.col("category").alias("chosen")
    )
    return P.parse_structured_category(raw, ["safe", "unethical"], v.SAFE).drop("chosen")


_KEYWORD_SQL = """
    CASE WHEN contains(t, 'kill') OR contains(t, 'hurt') OR contains(t, 'attack') THEN 'violence'
         WHEN contains(t, 'hate') OR contains(t, 'despise') OR contains(t, 'detest') THEN 'hate_speech'
         WHEN contains(t, 'sex') OR contains(t, 'nude') OR contains(t, 'explicit') THEN 'sexual_content'
         WHEN contains(t, 'bully') OR contains(t, 'harass') OR contains(t, 'mock') THEN 'harassment'
         WHEN contains(t, 'fake') OR contains(t, 'false') OR contains(t, 'lie') THEN 'misinformation'
         ELSE 'none' END"""


@query(
    "keyword_classify",
    f"""
    SELECT kind, id, predicted, predicted = 'none' AS is_safe FROM (
      SELECT kind, id, {_KEYWORD_SQL} AS predicted FROM (
        SELECT 'document' AS kind, doc_id AS id, lower(text) AS t FROM documents
        UNION ALL SELECT 'turn', conv_id * 1000000 + turn, lower(text) FROM conversations))
    """,
)
def q_keyword_classify(spark, d):
    docs = v.table(spark, d, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text"
    )
    turns = v.table(spark, d, "conversations").select(
        F.lit("turn").alias("kind"), (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("id"), "text"
    )
    return P.keyword_classify(docs.unionByName(turns)).select("kind", "id", "predicted", "is_safe")


@query(
    "stride_sample",
    "SELECT instance_index, category FROM v_all_requests WHERE instance_index % 6 = 0",
)
def q_stride_sample(spark, d):
    return stride_sample(v.all_requests(spark, d).select("instance_index", "category"), 6)


@query(
    "align_predictions",
    """
    SELECT model_name, instance_index, iteration, actual, predicted, is_safe AS predicted_safe, actual_safe, latency
    FROM v_responses
    """,
)
def q_align_predictions(spark, d):
    return aligned(spark, d).select(
        "model_name", "instance_index", "iteration", "actual", "predicted", "predicted_safe", "actual_safe", "latency"
    )


def _expected(spark, d):
    requests = v.all_requests(spark, d).select("instance_index")
    return expand_iterations(cross_models(requests, v.MODELS), v.ITERATIONS).drop("exp_index")


@query(
    "failed_requests",
    "SELECT model_name, instance_index, iteration FROM v_all_slots WHERE h = 19",
)
def q_failed_requests(spark, d):
    return failed_requests(_expected(spark, d), v.all_responses(spark, d))


@query(
    "answered_requests",
    "SELECT model_name, instance_index, iteration FROM v_all_slots WHERE h <> 19",
)
def q_answered_requests(spark, d):
    return answered_requests(_expected(spark, d), v.all_responses(spark, d))


@query(
    "dedupe_slots",
    """
    SELECT model_name, instance_index, iteration,
      CASE WHEN h % 4 = 0 THEN NOT is_safe ELSE is_safe END AS is_safe,
      CASE WHEN h % 4 = 0 THEN 'rewritten' ELSE predicted END AS category, latency
    FROM v_all_responses
    """,
)
def q_dedupe_slots(spark, d):
    """Every slot has an earlier write; every fourth branch a later one."""
    base = v.all_responses(spark, d, keep_branch=True).drop("n_chars", "ord")
    write = F.explode(F.array(F.lit(-60), F.lit(0), F.lit(60)))
    shift = F.col("shift")
    writes = (
        base.withColumn("shift", write)
        .where((shift <= 0) | (F.col("h") % 4 == 0))
        .select(
            "model_name", "instance_index", "iteration",
            F.when(shift == 0, F.col("is_safe")).otherwise(~F.col("is_safe")).alias("is_safe"),
            F.when(shift == 0, F.col("category")).otherwise("rewritten").alias("category"),
            "latency",
            F.timestamp_seconds(F.unix_seconds("timestamp") + shift).alias("timestamp"),
        )
    )
    return dedupe_slots(writes).drop("timestamp")


@query(
    "cross_models",
    "SELECT instance_index, category, model_name FROM v_all_requests CROSS JOIN v_models",
)
def q_cross_models(spark, d):
    return cross_models(v.all_requests(spark, d).select("instance_index", "category"), v.MODELS)


@query(
    "map_taxonomy",
    """
    SELECT model_name, instance_index, iteration,
      CASE WHEN h < 4 THEN 'harassment' WHEN h < 8 THEN 'self_harm' WHEN h < 12 THEN 'hate_speech'
           WHEN h < 16 THEN 'novel/class' END AS standard
    FROM v_all_responses
    """,
)
def q_map_taxonomy(spark, d):
    h = F.col("h")
    raw = (
        F.when(h < 4, "harassment/threatening").when(h < 8, "self-harm/intent").when(h < 12, "hate").when(h < 16, "novel/class")
    )
    rows = v.all_responses(spark, d, keep_branch=True).withColumn("category", raw)
    return map_taxonomy(rows, MODERATION_CLASSES).select("model_name", "instance_index", "iteration", "standard")


@query(
    "class_universe",
    """
    SELECT DISTINCT class FROM (
      SELECT actual AS class FROM v_responses UNION ALL SELECT predicted FROM v_responses) WHERE class IS NOT NULL
    """,
)
def q_class_universe(spark, d):
    return class_universe(aligned(spark, d))
