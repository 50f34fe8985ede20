"""Running a user's classifier over requests on the executors."""

from __future__ import annotations

import re
import sys
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from ..schema import SCORED
from .monitoring import ATTEMPTS, BACKOFF_MAX, BACKOFF_MIN

# Executors get these small helpers inside the task itself, so they need no
# copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_COLUMNS = [f.name for f in SCORED.fields]


def _first_and_list(category):
    """Scalar or list prediction to (first class, list or None)."""
    if category is None:
        return None, None
    if isinstance(category, (list, tuple)):
        return (category[0] if category else None), list(category)
    return category, [category]


# The rule of ``classify_failures`` for a call that has just failed (fixed values, as there).
_QUOTA = re.compile(r"\A(429 RESOURCE_EXHAUSTED|Quota exceeded)")
_HINT = re.compile(r"retry in (\d+\.?\d*)s")


def retry_wait(error: str, attempt: int, attempts: int = ATTEMPTS) -> float | None:
    """Seconds to wait before calling again, None when calling again is no use."""
    if attempt >= attempts or not _QUOTA.search(error):
        return None
    hint = _HINT.search(error)
    return float(hint.group(1)) + 1.0 if hint else max(BACKOFF_MIN, min(BACKOFF_MAX, 2.0 ** min(attempt - 1, 6)))


class Pace:
    """A token bucket: ``rate`` texts a second in the long run, ``burst`` at once."""

    def __init__(self, rate: float | None, burst: int):
        self.rate, self.burst, self.tokens, self.last = rate, max(1, burst), float(max(1, burst)), time.monotonic()

    def take(self, n: int) -> None:
        if not self.rate:
            return
        now = time.monotonic()
        self.tokens = min(self.burst, self.tokens + (now - self.last) * self.rate) - n
        self.last = now
        if self.tokens < 0:
            time.sleep(-self.tokens / self.rate)


def _row(model_name, key, iteration, verdict, latency, error, attempt) -> tuple:
    v = verdict or {}
    first, every = _first_and_list(v.get("category"))
    raw = v.get("raw_response")
    return (
        model_name, key, iteration,
        bool(v["is_safe"]) if verdict is not None else None,
        float(v.get("score", -1.0)) if verdict is not None else None,
        first, every, latency, datetime.now(timezone.utc),
        None if raw is None else str(raw), error, attempt,
    )


def _score_chunk(model_name, classify, keys, iterations, texts, tried, pace, attempts) -> list[tuple]:
    """One call for the chunk; when it fails, one call per row so that only
    the bad rows become failures.  Batch time is shared evenly.  A row that
    fails for its quota is called again after the wait it asks for."""
    pace.take(len(texts))
    start = time.perf_counter()
    try:
        verdicts = classify(texts)
        if len(verdicts) != len(texts):
            raise ValueError(f"classifier returned {len(verdicts)} verdicts for {len(texts)} texts")
        each = (time.perf_counter() - start) * 1000.0 / max(len(texts), 1)
        return [
            _row(model_name, k, i, v, each, None, t + 1) for k, i, v, t in zip(keys, iterations, verdicts, tried)
        ]
    except Exception as e:  # noqa: BLE001 - any classifier error is data here
        if len(texts) == 1:
            error = f"{type(e).__name__}: {e}"
            # The rule looks at the provider's message.
            wait = retry_wait(str(e), tried[0] + 1, attempts)
            if wait is None:
                spent = (time.perf_counter() - start) * 1000.0
                return [_row(model_name, keys[0], iterations[0], None, spent, error, tried[0] + 1)]
            time.sleep(wait)
            return _score_chunk(model_name, classify, keys, iterations, texts, [tried[0] + 1], pace, attempts)
    rows = []
    for k, i, t, n in zip(keys, iterations, texts, tried):
        rows += _score_chunk(model_name, classify, [k], [i], [t], [n], pace, attempts)
    return rows


def score_slots(
    expanded: DataFrame,
    model_name: str,
    make_classifier: Callable[[], Callable[[list[str]], list[dict]]],
    batch_size: int = 64,
    max_concurrency: int | None = None,
    calls_per_second: float | None = None,
    attempts: int = 1,
) -> DataFrame:
    """Responses and failures with the number of calls made for each slot.

    ``expanded`` may have ``attempt``, the calls made before.  A slot that
    fails for its quota is called up to ``attempts`` times in all, each after
    the wait that the failure asks for.  ``max_concurrency`` joins input
    partitions into that many tasks, without a shuffle.  ``calls_per_second``
    is the pace of all tasks together: each of those that can run at a time
    gets its share, so the texts stay where they are.
    """
    columns = ["instance_index", "iteration", "text"]
    tried = F.col("attempt") if "attempt" in expanded.columns else F.lit(0)
    rows = expanded.select(*columns, tried.cast("int").alias("attempt"))
    if max_concurrency is not None:
        rows = rows.coalesce(int(max_concurrency))
    tasks = expanded.sparkSession.sparkContext.defaultParallelism
    share = calls_per_second / min(tasks, max_concurrency or tasks) if calls_per_second else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classify, pace = make_classifier(), Pace(share, batch_size)
        for pdf in batches:
            out: list[tuple] = []
            for at in range(0, len(pdf), batch_size):
                part = pdf.iloc[at : at + batch_size]
                out += _score_chunk(
                    model_name, classify, part["instance_index"].tolist(), part["iteration"].tolist(),
                    part["text"].tolist(), part["attempt"].tolist(), pace, attempts,
                )
            yield pd.DataFrame(out, columns=[*_COLUMNS, "attempt"])

    return rows.mapInPandas(run, T.StructType([*SCORED.fields, T.StructField("attempt", T.IntegerType())]))


def score_requests(
    expanded: DataFrame,
    model_name: str,
    make_classifier: Callable[[], Callable[[list[str]], list[dict]]],
    batch_size: int = 64,
    max_concurrency: int | None = None,
    calls_per_second: float | None = None,
    attempts: int = 1,
) -> DataFrame:
    """Responses and failures of one model over expanded requests.

    ``make_classifier`` runs once per Python worker task and returns a
    function from a list of texts to a list of verdict dicts (``is_safe``,
    optional ``score``, ``category``, ``raw_response``).  Only the slot key
    and the text travel to Python, in Arrow batches.  Limits are those of
    :func:`score_slots`; unset, every input partition runs at full pace.  A
    retried task repeats its slots, so a sink that is not transactional
    should be read through ``dedupe_slots``.
    """
    return score_slots(
        expanded, model_name, make_classifier, batch_size, max_concurrency, calls_per_second, attempts
    ).drop("attempt")


def scored_responses(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("error").isNull()).drop("error")


def scored_failures(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("error").isNotNull()).select(
        "model_name", "instance_index", "iteration", "latency", "timestamp", "error"
    )
