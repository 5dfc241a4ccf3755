"""The language-model step as data: answers are a table joined on a prompt's hash."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSWERS = "prompt_hash string, attempt int, answer string, stop_reason string"


def with_prompt_hash(prompts: DataFrame, prompt: str = "prompt") -> DataFrame:
    """``prompts`` with ``prompt_hash``: 24 digits of the SHA-1 of the prompt."""
    return prompts.withColumn("prompt_hash", F.left(F.sha1(F.col(prompt)), F.lit(24)))


class ResponseProvider(Protocol):
    """Answers prompts: a row (``prompt_hash``, ``attempt``, ``answer``, ``stop_reason``) for each attempt."""

    def answer(self, prompts: DataFrame) -> DataFrame: ...


class TableProvider:
    """Answers from a table; a prompt without one stops with UNCHANGED, which keeps the old value."""

    def __init__(self, answers: DataFrame) -> None:
        self._answers = answers

    def answer(self, prompts: DataFrame) -> DataFrame:
        asked = with_prompt_hash(prompts).select("prompt_hash").distinct()
        joined = asked.join(self._answers, "prompt_hash", "left")
        none = F.col("attempt").isNull()
        return joined.select(
            "prompt_hash",
            F.coalesce("attempt", F.lit(0)).alias("attempt"),
            "answer",
            F.when(none, "UNCHANGED").otherwise(F.col("stop_reason")).alias("stop_reason"),
        )


class FunctionProvider:
    """Answers from a Python function over a batch of prompts, called on the executors."""

    def __init__(self, function: Callable[[list[str]], list[str]]) -> None:
        self._function = function

    def answer(self, prompts: DataFrame) -> DataFrame:
        function = self._function

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                answers = function(frame["prompt"].tolist())
                yield pd.DataFrame({"prompt_hash": frame["prompt_hash"], "attempt": 0, "answer": answers, "stop_reason": None})

        asked = with_prompt_hash(prompts).select("prompt", "prompt_hash").dropDuplicates(["prompt_hash"])
        return asked.mapInPandas(run, ANSWERS)


def stream_tokens(tokens: Iterable[str], stops: Iterable[str] = ()) -> Iterator[str]:
    """The text so far after each token, up to the first stop string, which is left out.

    The end of the text is held back while it may yet become a stop string, so no part of one is ever shown.
    """
    stops = [s for s in stops if s]
    text, shown = "", ""
    for token in tokens:
        text += token
        ends = [i for i in (text.find(s) for s in stops) if i >= 0]
        if ends:
            yield text[: min(ends)]
            return
        held = max((n for s in stops for n in range(1, len(s)) if text.endswith(s[:n])), default=0)
        ready = text[: len(text) - held]
        if ready != shown:
            shown = ready
            yield shown
    if text != shown:
        yield text


def cached_by_seed(answers: DataFrame, seed: str) -> DataFrame:
    """One answer for each seed, the first attempt's: what a seed gave once is not asked for again."""
    rest = [c for c in answers.columns if c not in (seed, "attempt")]
    first = F.min(F.struct("attempt", *rest)).alias("a")
    return answers.groupBy(seed).agg(first).select(seed, "a.*")
