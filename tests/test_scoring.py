import pytest

from veritally.operators.requests import expand_iterations
from veritally.operators.scoring import score_requests, scored_failures, scored_responses
from veritally.plans.runs import compare_models, evaluate_run, missing_slots


def make():
    def classify(texts):
        if any(t == "boom" for t in texts):
            raise RuntimeError("429 RESOURCE_EXHAUSTED")
        return [{"is_safe": "bad" not in t, "category": ["bad", "worse"] if "bad" in t else "safe", "score": 0.5} for t in texts]

    return classify


def make_short():
    return lambda texts: []


@pytest.fixture
def requests(rows):
    texts = ["fine", "bad one", "boom", "fine too", "", "bad"]
    cats = ["safe", "bad", "bad", "safe", "safe", "safe"]
    return rows("instance_index long, text string, category string", [(i, t, c) for i, (t, c) in enumerate(zip(texts, cats))])


@pytest.mark.parametrize("batch", [1, 4, 100])
def test_one_bad_row_fails_alone(requests, batch):
    scored = score_requests(expand_iterations(requests, 2), "m", make, batch_size=batch).cache()
    good, bad = scored_responses(scored).collect(), scored_failures(scored).collect()
    assert len(good) == 10 and len(bad) == 2
    assert {(r["instance_index"], r["iteration"]) for r in bad} == {(2, 0), (2, 1)}
    assert all(r["error"] == "RuntimeError: 429 RESOURCE_EXHAUSTED" for r in bad)
    by_key = {r["instance_index"]: r for r in good}
    assert (by_key[1]["is_safe"], by_key[1]["category"], by_key[1]["categories"]) == (False, "bad", ["bad", "worse"])
    assert (by_key[0]["category"], by_key[0]["categories"], by_key[0]["score"]) == ("safe", ["safe"], 0.5)
    assert all(r["latency"] >= 0 and r["timestamp"] is not None for r in good)


def test_wrong_number_of_verdicts_is_a_failure(requests):
    scored = score_requests(expand_iterations(requests, 1), "m", make_short)
    assert scored_failures(scored).count() == 6


def test_concurrency_cap_sets_the_task_count(requests):
    scored = score_requests(expand_iterations(requests, 3), "m", make, max_concurrency=2)
    assert scored.rdd.getNumPartitions() == 2
    assert scored.count() == 18


def test_whole_run(requests, tmp_path):
    run = evaluate_run(requests, {"m": make, "k": make}, iterations=2, batch_size=3, store=str(tmp_path / "scored"))
    assert [r["instance_index"] for r in run.invalid.collect()] == [4]
    assert run.responses.count() == 2 * 2 * 4
    assert run.failures.count() == 4
    missing = missing_slots(run.requests, run.responses, ["m", "k"], 2)
    assert {tuple(r) for r in missing.select("model_name", "instance_index", "iteration").collect()} == {
        (m, 2, i) for m in ("m", "k") for i in (0, 1)
    }
    table = {r["model_name"]: r for r in compare_models(run.responses, run.requests, ["safe", "bad"], ["safe"], 2).collect()}
    assert table["m"]["accuracy"] == table["k"]["accuracy"] == 0.75
    with pytest.raises(ValueError):
        evaluate_run(requests, {})
