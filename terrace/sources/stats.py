"""What tasks report of the regions that they write, and progress while they do."""

from __future__ import annotations

import threading
from collections.abc import Callable
from contextlib import contextmanager
from typing import Any

from pyspark import AccumulatorParam
from pyspark.sql import SparkSession


class _Sums(AccumulatorParam):
    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, a: dict, b: dict) -> dict:
        for k, v in b.items():
            a[k] = a.get(k, 0) + v
        return a


def sums(spark: SparkSession):
    """An accumulator of numbers by key.  Tasks that fail or run again may count twice, so results don't depend on it."""
    return spark.sparkContext.accumulator({}, _Sums())


class Stats(dict):
    """Numbers by level; the level may be asked for as text."""

    def __missing__(self, key: Any) -> Any:
        if isinstance(key, str) and key.isdigit():
            return self[int(key)]
        raise KeyError(key)


def progress_bar(total: int) -> Callable[[int, int], None]:
    try:
        from tqdm.auto import tqdm
    except ImportError as e:
        raise ImportError("progress=True needs tqdm; install it, or give a function of done and total") from e
    bar = tqdm(total=total, unit="region")

    def show(done: int, total: int) -> None:
        bar.update(done - bar.n)
        if done == total:
            bar.close()

    return show


class Progress:
    """Calls ``show(done, total)`` with a count of regions that never falls and ends at the total."""

    def __init__(self, show: Callable[[int, int], None] | bool | None, total: int):
        self.show = progress_bar(total) if show is True else show or None
        self.total, self.done = total, 0
        self._lock = threading.Lock()

    def to(self, done: float) -> None:
        with self._lock:
            if self.show and (now := min(int(done), self.total)) > self.done:
                self.done = now
                self.show(now, self.total)

    @contextmanager
    def watched(self, counted, regions: int, tiles: int, every: float = 0.2):
        """While a job runs: of its ``regions``, as many as its tiles that are done; all of them when it has ended well."""
        start, ended = self.done, threading.Event()

        def poll() -> None:
            while not ended.wait(every):
                self.to(start + regions * min(1.0, counted.value.get("tiles", 0) / max(tiles, 1)))

        thread = threading.Thread(target=poll, daemon=True)
        if self.show:
            thread.start()
        try:
            yield
        finally:
            ended.set()
            if self.show:
                thread.join()
        self.to(start + regions)
