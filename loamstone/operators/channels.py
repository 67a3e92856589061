"""Channels of one recall as concurrent jobs: each has a tag and is cancelled on its own, what is done in time stays."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


class Channels:
    """Runs named pieces of work side by side until a share of ``seconds`` after it was made; without a limit until they end.

    ``late`` has the names of those that weren't done then; their jobs are cancelled, those that they begin later too.
    """

    def __init__(self, spark: SparkSession, seconds: float | None = None):
        self.spark, self.id, self.late = spark, f"recall-{uuid.uuid4().hex}", set()
        self.began, self.seconds = time.monotonic(), seconds

    def left(self, share: float = 1.0) -> float | None:
        """Seconds until that share of the limit; none without one."""
        return None if self.seconds is None else max(0.0, self.began + share * self.seconds - time.monotonic())

    def run(self, works: dict[str, Callable[[], DataFrame]], share: float = 1.0) -> dict[str, DataFrame | None]:
        """What each piece gave, or None where it is late; an error of one that isn't late is raised."""
        done: dict[str, DataFrame] = {}
        errors: dict[str, BaseException] = {}
        sc = self.spark.sparkContext

        def one(name: str) -> None:
            sc.setJobGroup(f"{self.id}-{name}", name, True)
            sc.addJobTag(f"{self.id}-{name}")
            try:
                done[name] = works[name]()
            except BaseException as e:  # told to the caller below, unless its jobs were cancelled
                errors[name] = e

        threads = {n: threading.Thread(target=inheritable_thread_target(self.spark)(one), args=(n,), daemon=True) for n in works}
        for t in threads.values():
            t.start()
        for t in threads.values():
            t.join(self.left(share))
        for name, t in threads.items():
            if name in done:
                continue
            if t.is_alive():
                self.late.add(name)
                sc.cancelJobsWithTag(f"{self.id}-{name}")
                sc._jsc.sc().cancelJobGroupAndFutureJobs(f"{self.id}-{name}")
            else:
                raise errors[name]
        return {n: None if n in self.late else done[n] for n in works}
