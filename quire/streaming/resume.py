"""Incremental runs: new files once, and runs of flagged pages over a stream.

A file stream with ``availableNow`` takes each new file once and ends; a file whose content
changed under the same name has another digest, and results are kept by digest, so what is
joined from the store is never stale. Each batch writes a folder of its own number, whole, so a
batch that runs again leaves its rows once. Documents are named by their path, so files of one
name in several folders stay apart. Failures are rows of kind ``error``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.sources.pdf import SCHEMA, layout_objects

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def new_files(spark: SparkSession, folder: str, suffix: str = "*.[pP][dD][fF]") -> DataFrame:
    """A stream of the files of a folder as bytes."""
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", suffix).load(folder)


def convert_new(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Layout objects of files not seen yet, with their digest, appended to ``out``; ends when all are done.

    ``checkpoint`` and ``out`` must be folders that all executors share."""

    def batch(df: DataFrame, number: int) -> None:
        own = df.select(F.col("path").alias("doc_id"), F.sha2("content", 256).alias("digest"))
        layout_objects(df).join(own, "doc_id").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return new_files(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """The layout objects of what the folder's files hold now: rows of older contents are left out."""
    files = spark.read.format("binaryFile").load(folder)
    now = files.select(F.col("path").alias("doc_id"), F.sha2("content", 256).alias("digest"))
    return spark.read.parquet(out).join(now, ["doc_id", "digest"], "left_semi").select(*(c.split()[0] for c in SCHEMA.split(", ")), "digest")


STATE, RUNS = "page int, run int", "doc_id bigint, page_no int, image_sequence int"


def _runs(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Numbers of runs of pages that follow each other, over batches that come in page order."""
    page, run = state.get if state.exists else (None, 0)
    rows = pd.concat(list(batches)).sort_values("page_no")["page_no"].drop_duplicates()
    out = []
    for p in rows:
        p = int(p)
        if page is not None and p <= page:
            continue
        run += page is None or p != page + 1
        page = p
        out.append((key[0], p, run))
    if page is not None:
        state.update((page, run))
    yield pd.DataFrame(out, columns=["doc_id", "page_no", "image_sequence"])


def stream_sequences(flagged: DataFrame) -> DataFrame:
    """doc_id, page_no, image_sequence of a stream of flagged pages (doc_id, page_no), state kept per document.

    Pages that come after a later one of their document are left out, as a run's number can't change once given."""
    return flagged.groupBy("doc_id").applyInPandasWithState(_runs, RUNS, STATE, "append", GroupStateTimeout.NoTimeout)


def run_to_end(query: StreamingQuery, after: Callable[[], None] = lambda: None) -> None:
    """Waits until a query has ended, and fails if it did."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    after()
