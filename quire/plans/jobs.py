"""Job requests and their log: a JSON file of options, lines that outlast the run, and their tail."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

REQUEST = "files array<string>, out string, format string, pages string, name string, engine string, doc_type string, workers int, backend string, renderer string, store string, work string, log string"


def request(spark: SparkSession, path: str) -> dict:
    """The options that a JSON file gives; fails if it can't be read as one object."""
    rows = spark.read.schema(REQUEST + ", _bad string").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).withColumn("_there", F.lit(True)).collect()
    if len(rows) != 1 or rows[0]["_bad"] is not None:
        raise ValueError(f"not a job request: {path}")
    return {k: v for k, v in rows[0].asDict(True).items() if v is not None and not k.startswith("_")}


class Log:
    """Lines added to a file; each is on the disk before the next step, so that a dead run shows how far it came."""

    def __init__(self, path: str):
        self.path = path
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)

    def add(self, line: str) -> None:
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(line.rstrip("\n") + "\n")
            f.flush()
            os.fsync(f.fileno())


def tail(path: str, at: int, emit: Callable[[str], None]) -> int:
    """Gives the whole lines behind a byte to ``emit``; where to go on from. A file that isn't there yet has none."""
    try:
        with open(path, "rb") as f:
            f.seek(at)
            new = f.read()
    except FileNotFoundError:
        return at
    whole = new[: new.rfind(b"\n") + 1]
    for line in whole.decode("utf-8", "replace").splitlines():
        emit(line)
    return at + len(whole)


def follow(path: str, ended: Callable[[], bool], emit: Callable[[str], None], every: float = 0.2) -> None:
    """Gives lines as they come until the job has ended, then the rest."""
    at = 0
    while not ended():
        at = tail(path, at, emit)
        time.sleep(every)
    tail(path, at, emit)


def eta(done: int, total: int, elapsed: float) -> float:
    """Seconds left if the rest goes as what is done; 0 before anything is."""
    return elapsed / done * (total - done) if done else 0.0
