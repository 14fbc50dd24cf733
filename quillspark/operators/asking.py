"""Questions to a transcriber about images: paced, backed off after errors, and taken up again later.

The service is any function; it runs in the tasks, so the number of tasks is the number of
calls at a time. What a call cost and gave is a row; written, these rows are what a later run
starts from.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Timer = Callable[[], tuple[Callable[[], float], Callable[[float], None]]]


def real_time() -> tuple[Callable[[], float], Callable[[float], None]]:
    return time.monotonic, time.sleep


@dataclass(frozen=True)
class Pace:
    """Seconds between the calls of a task, and after the first, second, ... error of a page (the last value from then on).

    timer gives the clock and the sleep of a task; tests give their own.
    """

    delay: float = 1.5
    backoff: tuple[float, ...] = (5.0, 15.0, 45.0)
    timer: Timer = real_time

    def after_error(self, n: int) -> float:
        return self.backoff[min(n, len(self.backoff)) - 1] if self.backoff else 0.0


AT_ONCE = Pace(0.0, ())


class Refused(Exception):
    """An error that asking again doesn't mend."""


class _Caller:
    """One task's calls, one after the other."""

    def __init__(self, ask: Callable[[bytes, int], str], holds_answer: Callable[[str], bool], tries: int, pace: Pace):
        self.ask, self.holds_answer, self.tries, self.pace = ask, holds_answer, tries, pace
        self.clock, self.sleep = pace.timer()
        self.free_at: float | None = None

    def _turn(self) -> None:
        """Wait until the task may call again."""
        if self.free_at is not None and (left := self.free_at - self.clock()) > 0:
            self.sleep(left)

    def page(self, image: bytes, before: int) -> tuple[str, str | None, int, bool, float]:
        """(raw, error, tries, answered, seconds backed off) of one page that has been asked about `before` times."""
        raw, error, errors, waited, n = "", None, 0, 0.0, before
        while n < self.tries:
            self._turn()
            try:
                raw, error = self.ask(image, n), None
            except Exception as e:  # a service that fails must not fail the other pages
                raw, error, errors = "", str(e), errors + 1
                final = isinstance(e, Refused)
            n += 1
            self.free_at = self.clock() + self.pace.delay
            if error is None and self.holds_answer(raw):
                return raw, None, n, True, waited
            if error is not None:
                if final or n == self.tries:
                    break
                waited += (pause := self.pace.after_error(errors))
                self.sleep(pause)
        return raw, error, n, False, waited


def asked(images: DataFrame, ask: Callable[[bytes, int], str], holds_answer: Callable[[str], bool], content: str = "content", tries: int = 2, pace: Pace = AT_ONCE) -> DataFrame:
    """images, without their content, with raw, error, tries, answered, backed_off: what `ask(content, n)` gives, n from 0.

    ask may be stricter as n grows; the first answer that holds_answer is kept, else the last;
    the error of the last try is kept as text. A column `tries` of images counts former calls
    (null: none), which use up tries.
    """
    keep = [c for c in images.columns if c not in (content, "tries")]
    added = [T.StructField("raw", T.StringType()), T.StructField("error", T.StringType()), T.StructField("tries", T.IntegerType()), T.StructField("answered", T.BooleanType()), T.StructField("backed_off", T.DoubleType())]
    if "tries" not in images.columns:
        images = images.withColumn("tries", F.lit(0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller = _Caller(ask, holds_answer, tries, pace)
        for b in batches:
            before = b["tries"].fillna(0).astype(int)
            got = pd.DataFrame([caller.page(bytes(x), n) for x, n in zip(b[content], before, strict=True)], columns=[f.name for f in added], index=b.index)
            yield pd.concat([b[keep], got], axis=1)

    return images.select(*keep, content, "tries").mapInPandas(run, T.StructType([images.schema[c] for c in keep] + added))


def unfinished(images: DataFrame, answers: DataFrame, key: list[str], tries: int) -> DataFrame:
    """images that no former answer settles and that have tries left, with `tries`: how often they have been asked about."""
    former = answers.groupBy(*key).agg(F.max("answered").alias("__done"), F.max("tries").alias("tries"))
    return images.join(former, key, "left").where("NOT coalesce(__done, false) AND coalesce(tries, 0) < " + str(int(tries))).drop("__done")
