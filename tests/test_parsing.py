import pytest
from pyspark.sql import functions as F

from veritally.operators import parsing as P
from veritally.operators.align import map_taxonomy, map_taxonomy_table
from veritally.functions.verdicts import MODERATION_CLASSES

CLASSES = ["violence", "hate_speech", "privacy"]


def test_guard_text(rows):
    cases = {
        "\n\nunsafe\nA1": (False, "violence", ["violence"]),
        "\n\nunsafe\nS2": (False, None, None),
        "\n\nsafe": (True, None, None),
        "Header line\nMeta line\nsafe\nA1\nA3\n": (True, "violence", ["violence", "privacy"]),
        "\n\nunsafe\nA3\nA1": (False, "violence", ["violence", "privacy"]),
        "\n\n\n": (False, None, None),
        "Header\nMeta\nunsafe\n": (False, None, None),
        "\n\nunsafe\nA1,A3": (False, None, None),
        "\n\nunsafe\nA11": (False, None, None),
        "\n\n \tsafe\r\nA2": (True, "hate_speech", ["hate_speech"]),
        "\n\nSAFE": (False, None, None),
    }
    df = rows("raw_response string", [(c,) for c in cases] + [("safe",), (None,)])
    got = {r["raw_response"]: r for r in P.parse_guard_output(df, CLASSES).collect()}
    assert set(got) == set(cases)
    for raw, want in cases.items():
        assert (got[raw]["is_safe"], got[raw]["category"], got[raw]["categories"]) == want
        assert got[raw]["score"] == -1.0
    assert {r["raw_response"] for r in P.guard_output_failures(df).collect()} == {"safe", None}
    none = P.parse_guard_output(df.where("raw_response like '%A1%'"), [])
    assert none.where("categories IS NOT NULL").count() == 0


def test_label_rows(rows):
    df = rows("label string, label_score double, raw_response string", [
        ("SAFE", 0.9, "S1"), ("Unsafe", 0.8, "unsafe S10 S1"), ("UNSAFE", None, "S42"), ("unsafe", 0.5, "?"), (None, None, None),
    ])
    got = [tuple(r)[3:] for r in P.parse_label_output(df).collect()]
    assert got == [
        (True, 0.9, None), (False, 0.8, "intellectual_property"), (False, 0.0, "S42"), (False, 0.5, ""), (True, 0.0, None),
    ]


def test_moderation_keeps_first_maximum(rows):
    df = rows("flagged boolean, category_scores map<string,double>", [
        (True, {"hate": 0.5, "violence": 0.5, "sexual": 0.1}), (True, {"odd": 0.9, "hate": 0.2}), (False, {"hate": 0.4}), (False, {}),
    ])
    got = [tuple(r)[2:] for r in P.parse_moderation_scores(df).collect()]
    assert got == [(False, 0.5, "hate_speech"), (False, 0.9, "odd"), (True, 0.4, None), (True, 0.0, None)]


# Levels of (harassment, dangerous content, other) -> safe, score, class: the highest level decides, above 2 of 4
# it is unsafe, and of equal highest levels the first one names the class.
RATED = [
    ((1, 1, 1), True, 0.25, None),
    ((2, 2, 2), True, 0.5, None),
    ((1, 2, 1), True, 0.5, None),
    ((3, 1, 1), False, 0.75, "harassment"),
    ((1, 3, 2), False, 0.75, "violence"),
    ((2, 1, 3), False, 0.75, "HARM_X"),
    ((3, 3, 3), False, 0.75, "harassment"),
    ((2, 3, 3), False, 0.75, "violence"),
    ((3, 4, 3), False, 1.0, "violence"),
    ((3, 3, 4), False, 1.0, "HARM_X"),
    ((4, 4, 1), False, 1.0, "harassment"),
]


def test_ratings_by_table(rows):
    names = ["HARM_CATEGORY_HARASSMENT", "HARM_CATEGORY_DANGEROUS_CONTENT", "HARM_X"]
    data = [(str(levels), list(zip(names, levels))) for levels, *_ in RATED] + [("[]", []), ("NULL", None)]
    df = rows("id string, ratings array<struct<category:string,probability:int>>", data)
    got = {r["id"]: (r["is_safe"], r["score"], r["category"]) for r in P.parse_safety_ratings(df).collect()}
    want = {str(levels): tuple(rest) for levels, *rest in RATED}
    assert got == want | {"[]": (True, 0.0, None), "NULL": (True, 0.0, None)}


def test_structured_and_keywords(rows):
    df = rows("chosen string", [("none",), ("violence",), ("bogus",), (None,)])
    ok = P.parse_structured_category(df, ["none", "violence"], ["none"]).collect()
    assert [(r["category"], r["is_safe"]) for r in ok] == [("none", True), ("violence", False)]
    assert P.structured_category_failures(df, ["none", "violence"]).count() == 2
    samples = [
        ("Bread needs flour and time.", "none"), ("The storm may hurt the harvest.", "violence"),
        ("They despise cold coffee", "hate_speech"), ("An EXPLICIT cast is required here", "sexual_content"),
        ("Do not mock the referee", "harassment"), ("a false bottom in the drawer", "misinformation"),
        ("attack of the mockingbirds", "violence"), ("detest every fake", "hate_speech"),
        ("the clientele arrives late", "misinformation"), ("", "none"),
    ]
    got = P.keyword_classify(rows("text string, want string", samples)).collect()
    for r in got:
        assert r["predicted"] == r["want"] and r["is_safe"] == (r["want"] == "none")


def test_taxonomy(rows):
    df = rows("category string", [("hate",), ("novel",), (None,)])
    want = [("hate_speech",), ("novel",), (None,)]
    assert [tuple(r)[1:] for r in map_taxonomy(df, MODERATION_CLASSES).collect()] == want
    table = rows("raw string, standard string", list(MODERATION_CLASSES.items()))
    got = {r["category"]: r["standard"] for r in map_taxonomy_table(df, table).collect()}
    assert got == {"hate": "hate_speech", "novel": "novel", None: None}
