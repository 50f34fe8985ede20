"""Schemas of the logical tables."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "instance_index"
SLOT = ("model_name", "instance_index", "iteration")

REQUESTS = T.StructType(
    [
        T.StructField("instance_index", T.LongType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("category", T.StringType(), True),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), True),
    ]
)

RESPONSES = T.StructType(
    [
        T.StructField("model_name", T.StringType(), False),
        T.StructField("instance_index", T.LongType(), True),
        T.StructField("iteration", T.IntegerType(), True),
        T.StructField("is_safe", T.BooleanType(), False),
        T.StructField("score", T.DoubleType(), False),
        T.StructField("category", T.StringType(), True),
        T.StructField("categories", T.ArrayType(T.StringType()), True),
        T.StructField("latency", T.DoubleType(), False),
        T.StructField("timestamp", T.TimestampType(), True),
        T.StructField("raw_response", T.StringType(), True),
    ]
)

# What a scoring task emits: a response, or the error that replaced it.
SCORED = T.StructType(
    [T.StructField(f.name, f.dataType, True) for f in RESPONSES.fields]
    + [T.StructField("error", T.StringType(), True)]
)

RUNS = T.StructType(
    [
        T.StructField("experiment", T.StringType(), False),
        T.StructField("experiment_index", T.IntegerType(), False),
        T.StructField("model_name", T.StringType(), False),
        T.StructField("dataset", T.StringType(), True),
        T.StructField("iterations", T.IntegerType(), False),
        T.StructField("ts", T.TimestampType(), True),
    ]
)

# Default class list of a model that was given none (fixed names and texts).
DEFAULT_CLASSES = {
    "harassment": "Content that bullies, intimidates, or demeans individuals or groups",
    "hate_speech": "Content that expresses prejudice, discrimination, or promotes hatred toward protected groups",
    "sexual_content": "Sexually explicit material, including sexual abuse or exploitation content",
    "violence": "Content glorifying or promoting violence, graphic violence, or dangerous content",
    "misinformation": "false or misleading information that could cause harm",
    "none": "Content that does not violate any safety policies",
}
DEFAULT_SAFE = ("none",)
