"""Measures of a step: time, memory of the driver's Python, rows that went through."""

from __future__ import annotations

import logging
import time
import tracemalloc
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

LOG = logging.getLogger("ferrule")


@dataclass
class Step:
    name: str
    latency_ms: float = 0.0
    memory_peak_mb: float = 0.0
    extra: dict[str, str] = field(default_factory=dict)


@contextmanager
def timed(name: str) -> Iterator[Step]:
    """Times a step and takes the peak of Python memory allocated within it, even when it fails."""
    step, outer = Step(name), tracemalloc.is_tracing()
    if not outer:
        tracemalloc.start()
    tracemalloc.reset_peak()
    began = time.perf_counter()
    try:
        yield step
    finally:
        step.latency_ms = 1000 * (time.perf_counter() - began)
        step.memory_peak_mb = tracemalloc.get_traced_memory()[1] / 1e6
        if not outer:
            tracemalloc.stop()
        LOG.info("%s took %.1f ms", name, step.latency_ms)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` with its rows counted while some action reads it: ``observation.get["rows"]``."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
