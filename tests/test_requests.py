from veritally.functions.prompts import system_prompt
from veritally.operators.requests import (
    assign_batches,
    conversation_texts,
    cross_models,
    expand_iterations,
    render_guard_prompts,
    render_prompts,
    stride_sample,
)


def test_expand_and_batches(rows):
    requests = rows("instance_index long", [(i,) for i in range(5)])
    expanded = expand_iterations(requests, 3)
    got = sorted(map(tuple, expanded.collect()))
    assert got == [(i, it, i * 3 + it) for i in range(5) for it in range(3)]
    assert expand_iterations(requests, 0).count() == 5
    sizes = {r["batch_no"]: r["count"] for r in assign_batches(expanded, 4).groupBy("batch_no").count().collect()}
    assert sizes == {0: 4, 1: 4, 2: 4, 3: 3}


def test_stride_and_models(rows):
    requests = rows("instance_index long", [(i,) for i in range(109)])
    assert stride_sample(requests, 6).count() == 19
    assert cross_models(requests, ["a", "b"]).count() == 218


def test_prompts(rows):
    classes = {"x": "X text", "y": "Y text"}
    assert system_prompt(classes, "Base") == "Base\n\nCategories:\n- x: X text\n- y: Y text"
    default = system_prompt(classes)
    assert "- x: X text\n- y: Y text\n\nRespond ONLY" in default and default.endswith('{"category": "<category_name>"}')
    assert system_prompt(classes, explain=True).endswith('"explanation": "<brief explanation>"}')
    requests = rows("text string", [("say {this}",)])
    assert render_prompts(requests, classes, "Base").collect()[0]["system_prompt"].startswith("Base")
    prompt = render_guard_prompts(requests).collect()[0]["prompt"]
    assert 'User message: "say {this}"\n' in prompt and prompt.startswith("[INST]") and prompt.endswith("[/INST]")


def test_conversation_parts_hold_the_whole_text(rows):
    turns = [("c", t, f"m{t}") for t in range(25)] + [("d", 0, "only"), ("d", 1, None)]
    df = rows("conv_id string, turn long, text string", turns[::-1])
    whole = {r["conv_id"]: r["text"] for r in conversation_texts(df).collect()}
    assert whole == {"c": "\n".join(f"m{t}" for t in range(25)), "d": "only"}


def test_long_conversations_stay_one_row(spark):
    df = spark.range(10_050).selectExpr("1L AS conv_id", "id AS turn", "concat('m', id) AS text")
    [row] = conversation_texts(df).collect()
    assert row["text"].split("\n") == [f"m{t}" for t in range(10_050)]
