"""Calling a model over a table of prompts. The caller gives the function; it is run in batches in the tasks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def infer(prompts: DataFrame, call: Callable[[str], str], prompt: str = "prompt", tries: int = 3) -> DataFrame:
    """prompts with model_answer and latency_s. A call that fails is tried again; after the last try the answer is null."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            answers, seconds = [], []
            for text in part[prompt]:
                began, answer = time.perf_counter(), None
                for _ in range(tries):
                    try:
                        answer = call(text)
                        break
                    except Exception:  # noqa: BLE001  the caller's function may raise anything
                        continue
                answers.append(answer)
                seconds.append(time.perf_counter() - began)
            yield part.assign(model_answer=answers, latency_s=seconds)

    schema = prompts.select("*", F.lit("").cast("string").alias("model_answer"), F.lit(0.0).alias("latency_s")).schema
    return prompts.mapInPandas(run, schema)


def backoff(attempt: int, base: float = 1.0, most: float = 60.0, draw: float = 0.5) -> float:
    """Seconds to wait before a try: doubled each time up to a limit, spread by a draw in [0, 1)."""
    return min(most, base * 2**attempt) * (0.5 + draw)
