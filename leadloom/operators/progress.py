"""Counters of a running job, observed on the writes the job makes anyway."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation

#: Called with the step that has ended and the counters so far.
Progress = Callable[[str, dict], None]

#: The counters of a run.
RUN_COUNTERS = ("discovered", "skipped", "queued_fetch", "fetching", "queued_score", "scoring", "matched", "rejected", "failed")


class Reporter:
    """Adds up what is observed step by step and tells it; without a listener nothing is observed."""

    def __init__(self, progress: Progress | None, counters: tuple[str, ...] = RUN_COUNTERS):
        self.progress = progress
        self.counters = dict.fromkeys(counters, 0)
        self.watched: dict[str, Observation] = {}

    def watch(self, df: DataFrame, step: str, **metrics: Column) -> DataFrame:
        """``df``, its rows counted into ``metrics`` when it is written; a counter may go down."""
        if self.progress is None:
            return df
        self.watched[step] = Observation(step)
        return df.observe(self.watched[step], *(metric.alias(name) for name, metric in metrics.items()))

    def tell(self, step: str) -> None:
        """Report a step whose rows have been written."""
        if self.progress is None:
            return
        for name, change in self.watched.pop(step).get.items():
            self.counters[name] += change
        self.progress(step, dict(self.counters))
