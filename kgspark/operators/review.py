"""First-pass review of extraction samples by a judging backend: only unlabelled rows, with retries and a rate limit."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import strip_ws

# What a service says when it can be asked again later.
TRANSIENT = ("429", "RESOURCE_EXHAUSTED", "503", "UNAVAILABLE")


def is_transient(message: str) -> bool:
    """Whether an error message names a passing condition."""
    return any(t in message for t in TRANSIENT)


@dataclass
class Patience:
    """How often and after which pauses (seconds) a call is repeated, and the least time between calls."""

    attempts: int = 6
    busy_wait: float = 65.0
    step_wait: float = 5.0
    interval: float = 0.0

    def call(self, f: Callable[[], object], sleep: Callable[[float], None] = time.sleep) -> object:
        """The result of ``f``; the last error is raised when every attempt failed."""
        for n in range(self.attempts):
            try:
                return f()
            except Exception as e:
                if n == self.attempts - 1:
                    raise
                sleep(self.busy_wait if is_transient(str(e)) else self.step_wait * (n + 1))
        raise ValueError("no attempt allowed")


class Judge(Protocol):
    """Verdicts on review rows; ``judge`` gets a row's columns and returns is_correct, corrected_type, notes or None."""

    def judge(self, row: dict) -> dict | None: ...


class NoJudge:
    """Default: no verdict, the row stays unlabelled."""

    def judge(self, row: dict) -> dict | None:
        return None


def unlabelled(rows: DataFrame) -> DataFrame:
    """Rows whose label is blank after stripping."""
    return rows.where(strip_ws(F.coalesce("is_correct", F.lit(""))) == "")


def pre_review(rows: DataFrame, judge: Judge | None = None, patience: Patience | None = None) -> DataFrame:
    """``rows`` with verdicts filled into the unlabelled ones; labelled rows pass unchanged, so a run can be resumed.

    A boolean verdict becomes 'Y' or 'N'.  A row the judge fails on stays unlabelled and carries the error in
    its notes.  With a rate limit the rows go through one task, as the limit holds for the service as a whole.
    """
    model, wait = judge or NoJudge(), patience or Patience()
    todo = unlabelled(rows)
    done = rows.where(strip_ws(F.coalesce("is_correct", F.lit(""))) != "")
    if wait.interval:
        todo = todo.repartition(1)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0.0
        for pdf in batches:
            for i in range(len(pdf)):
                row = pdf.iloc[i].to_dict()
                if wait.interval:
                    time.sleep(max(0.0, last + wait.interval - time.monotonic()))
                    last = time.monotonic()
                try:
                    got = wait.call(lambda r=row: model.judge(r))
                except Exception as e:  # noqa: BLE001
                    got = {"notes": f"error: {e}"}
                for k, v in (got or {}).items():
                    if k in pdf.columns:
                        pdf.iat[i, pdf.columns.get_loc(k)] = ("Y" if v else "N") if isinstance(v, bool) else v
            yield pdf

    return done.unionByName(todo.mapInPandas(work, rows.schema))
