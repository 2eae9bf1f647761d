"""Deadlines and cancellation of operations: an operation's Spark jobs carry a tag that can be interrupted."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

from vecgrove.errors import IndexError_

T = TypeVar("T")


class Control:
    def __init__(self, spark: SparkSession, deadline_s: float | None = None):
        self.spark, self.tag = spark, f"vecgrove-{uuid.uuid4().hex}"
        self.until = None if deadline_s is None else time.monotonic() + deadline_s
        self.cancelled = False

    def cancel(self) -> None:
        self.cancelled = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def check(self) -> None:
        """Between units of work, and before a commit."""
        if self.cancelled:
            raise IndexError_("Cancelled")
        if self.until is not None and time.monotonic() >= self.until:
            raise IndexError_("DeadlineExceeded")

    def run(self, work: Callable[[], T]) -> T:
        """The result of ``work``; its jobs stop at the deadline or when cancelled, and then this is an error."""
        self.check()
        context = self.spark.sparkContext
        context.addJobTag(self.tag)
        timer = None
        if self.until is not None:
            timer = threading.Timer(max(0.0, self.until - time.monotonic()), lambda: context.cancelJobsWithTag(self.tag))
            timer.start()
        try:
            out = work()
        except Exception:
            self.check()
            raise
        finally:
            if timer is not None:
                timer.cancel()
            context.removeJobTag(self.tag)
        self.check()
        return out
