"""Calls to an external corrector: retries, format checks, an identity fallback, and a journal row for each."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_response, response_error

CALLED = "id long, prompt string, request_key string, raw string, attempts int, fallback boolean, seconds double, error string"


class ContentFiltered(Exception):
    """The corrector refuses the text: the source itself is the correction."""


def badly_formatted(prompt: str, raw: str) -> str | None:
    """Why an answer is no correction, as far as its form tells before it is cleaned; null if it may be one."""
    source = "".join(prompt.rsplit("句子如下：", 1)[-1].split())
    said = "".join(raw.split())
    if not said:
        return "empty answer"
    if len(said) > max(512, 8 * len(source)):
        return "answer far longer than the source"
    return None


def call(
    prompts: DataFrame, make_corrector: Callable[[], Callable[[str], str]], retries: int = 3, per_minute: float | None = None, pause: float = 0.0,
    check: Callable[[str, str], str | None] = badly_formatted, again: str = "\n只输出修改后的句子。",
) -> DataFrame:
    """``prompts(id, prompt)`` with what the corrector said, as ``CALLED`` rows.

    ``make_corrector`` is called once for each task.  Calls of one task are
    serial; a rate for the whole job is shared equally among its partitions.  An
    answer that ``check`` finds badly formatted is asked for again, with ``again``
    after the prompt; the last one stands with its error if none is better.
    """
    share = None if per_minute is None else 60.0 * max(1, prompts.rdd.getNumPartitions()) / per_minute

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        correct, next_at = make_corrector(), 0.0
        for frame in batches:
            out = []
            for key, prompt in zip(frame["id"], frame["prompt"]):
                raw, error, fallback, began, attempt = None, None, False, time.time(), 0
                asked = prompt
                for attempt in range(1, retries + 1):
                    if share is not None:
                        time.sleep(max(0.0, next_at - time.time()))
                        next_at = time.time() + share
                    try:
                        raw, error = correct(asked), None
                        wrong = check(prompt, raw)
                        if wrong is None:
                            break
                        error, asked = f"format: {wrong}", f"{prompt}{again}"
                    except ContentFiltered:
                        raw, error, fallback = prompt.rsplit("句子如下：", 1)[-1], None, True
                        break
                    except Exception as e:  # a failed call is a row, not the end of the job
                        error = f"{type(e).__name__}: {e}"
                        time.sleep(pause * attempt)
                request = hashlib.sha256(prompt.encode()).hexdigest()
                out.append((key, prompt, request, raw, attempt, fallback, time.time() - began, error))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CALLED.split(", ")])

    return prompts.select("id", "prompt").mapInPandas(run, CALLED)


def accepted(called: DataFrame) -> DataFrame:
    """``called`` with the cleaned correction, ok, and the reason where it is not."""
    cleaned = called.withColumn("correction", clean_response(F.coalesce("raw", F.lit(""))))
    bad = F.coalesce("error", response_error(F.col("prompt"), F.coalesce("raw", F.lit("")), F.col("correction")))
    return cleaned.withColumn("error", bad).withColumn("ok", F.col("error").isNull())
