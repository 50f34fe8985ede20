import random

from veritally.operators.align import (
    align_predictions,
    answered_requests,
    class_universe,
    dedupe_slots,
    failed_requests,
)
from veritally.operators.categories import (
    category_distribution,
    performance_by_category,
    performance_by_category_accumulative,
)

RESPONSES = "model_name string, instance_index long, iteration int, is_safe boolean, category string, latency double"
REQUESTS = "instance_index long, category string"


def test_list_predictions_and_missing_labels(rows):
    responses = rows(
        "model_name string, instance_index long, is_safe boolean, category string, categories array<string>",
        [("m", 1, True, None, ["b", "a"]), ("m", 2, False, "x", None), ("m", 3, True, None, []), ("m", 9, True, "x", None)],
    )
    requests = rows(REQUESTS, [(1, "safe"), (2, None), (3, "bad"), (4, "safe")])
    got = {r["instance_index"]: r for r in align_predictions(responses, requests, ["safe"]).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1]["predicted"], got[1]["actual_safe"]) == ("b", True)
    assert (got[2]["predicted"], got[2]["actual_safe"], got[2]["predicted_safe"]) == ("x", False, False)
    assert (got[3]["predicted"], got[3]["actual_safe"]) == (None, False)


def test_failed_and_answered_split_the_expected_calls(rows):
    keys = "model_name string, instance_index long, iteration int"
    expected = rows(keys, [(m, i, it) for m in "ab" for i in range(4) for it in range(2)])
    done = rows(keys, [("a", 0, 0)] * 500 + [("a", 1, 1), ("b", 3, 0)])
    assert failed_requests(expected, done).count() == 13
    assert sorted(map(tuple, answered_requests(expected, done).collect())) == [("a", 0, 0), ("a", 1, 1), ("b", 3, 0)]


def test_dedupe_keeps_last_write_of_a_hot_slot(rows):
    data = [("m", 0, 0, f"v{t}", t) for t in range(3000)] + [("m", 1, 0, "x", 5), ("m", 1, 0, "y", 5), ("m", 2, 0, None, 1)]
    random.Random(3).shuffle(data)
    df = rows("model_name string, instance_index long, iteration int, v string, timestamp long", data).repartition(8)
    got = {r["instance_index"]: r["v"] for r in dedupe_slots(df).collect()}
    assert got == {0: "v2999", 1: "y", 2: None}


def test_universe_and_distribution(rows):
    df = rows("actual string, predicted string", [("b", "a"), ("b", None), (None, "c")])
    assert [r["class"] for r in class_universe(df).collect()] == ["a", "b", "c"]
    dist = category_distribution(rows(REQUESTS, [(0, "safe"), (1, "bad"), (2, "safe"), (3, None)]), 5)
    assert [tuple(r) for r in dist.collect()] == [(None, 5, 1), ("bad", 5, 1), ("safe", 10, 2)]


def test_performance_by_hand(rows):
    requests = rows(REQUESTS, [(0, "safe"), (1, "bad"), (2, "bad"), (3, None), (4, "quiet")])
    responses = rows(RESPONSES, [
        ("m", 0, 0, True, "safe", 1.0), ("m", 0, 1, False, "bad", 1.0), ("m", 1, 0, False, "bad", 1.0),
        ("m", 3, 0, False, "bad", 1.0), ("n", 1, 0, True, "safe", 1.0),
    ])
    want = [
        ("m", None, 1, 1.0, 1.0), ("m", "bad", 2, 1.0, 0.5), ("m", "quiet", 1, 0.0, 0.0), ("m", "safe", 1, 0.5, 0.5),
        ("n", None, 1, 0.0, 0.0), ("n", "bad", 2, 0.0, 0.0), ("n", "quiet", 1, 0.0, 0.0), ("n", "safe", 1, 0.0, 0.0),
    ]

    out = performance_by_category_accumulative(responses, requests, ["safe"])
    assert sorted(map(tuple, out.collect()), key=lambda t: (t[0], t[1] or "")) == want
    single = performance_by_category(align_predictions(responses, requests, ["safe"]))
    got = {(r["model_name"], r["category"]): (r["total"], r["correct"]) for r in single.collect()}
    assert got == {("m", "safe"): (2, 1), ("m", "bad"): (1, 1), ("m", None): (1, 1), ("n", "bad"): (1, 0)}
