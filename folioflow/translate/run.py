"""Runs a translator over chunk prompts in the tasks, with bounded retries; failures are rows, not losses."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARK = re.compile(r"\[\[\[P_([^\]]*)\]\]\]\n?")


class Translator(Protocol):
    def translate(self, prompt: str) -> str: ...


class StubTranslator:
    """Deterministic stand-in for a model: keeps the markers, prefixes the text; blank stays blank."""

    def translate(self, prompt: str) -> str:
        parts = _MARK.split(prompt)
        out = []
        for ident, text in zip(parts[1::2], parts[2::2]):
            text = text.strip()
            out.append(f"[[[P_{ident}]]]\n" + (f"vi: {text}" if text else ""))
        return "\n\n".join(out)


def run_prompts(prompts: DataFrame, keys: list[str], make: Callable[[], Translator], attempts: int = 4, parallel: int | None = None) -> DataFrame:
    """keys, reply, calls, error of each prompt. Only calls count as attempts; a failed prompt keeps its error.

    ``parallel`` bounds the concurrent calls by the number of partitions of this step alone.
    """
    rows = prompts.select(*keys, "prompt")
    rows = rows.repartition(parallel) if parallel else rows
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in filter(len, it):
            replies, calls, errors = [], [], []
            for prompt in pdf["prompt"]:
                reply, error, n = None, None, 0
                while n < attempts and reply is None:
                    n += 1
                    try:
                        reply, error = model.translate(prompt), None
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"[:200]
                replies.append(reply)
                calls.append(n)
                errors.append(error)
            yield pdf[keys].astype(object).assign(reply=replies, calls=calls, error=errors)

    return rows.mapInPandas(run, f"{types}, reply string, calls int, error string")


def failed(runs: DataFrame) -> DataFrame:
    """What the next run has to take up again."""
    return runs.filter(F.col("error").isNotNull())
