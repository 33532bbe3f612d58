"""Documents stitched from a stream of their recognised pages.

A document leaves when its last page has come, or when its time is up since its first
page came; pages wait in keyed state, by page number, so a page that is delivered again
changes nothing. The state survives restarts with the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import SEPARATOR

PAGES = "original_index long, page_index long, n_pages long, text string"
DOCUMENTS = "original_index long, text string, n_pages long, complete boolean"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StitchPages(StatefulProcessor):
    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page_index long", "text string")
        self.done = handle.getValueState("done", "done boolean")

    def _leave(self, key, complete: bool) -> Row:
        pages = sorted((k[0], v[0]) for k, v in list(self.pages.iterator()))
        self.pages.clear()
        self.done.update((True,))
        for timer in list(self.handle.listTimers()) if self.patience_ms else ():
            self.handle.deleteTimer(timer)
        return Row(original_index=key[0], text=SEPARATOR.join(t for _, t in pages if t is not None), n_pages=len(pages), complete=complete)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803 - the names Spark calls
        come = {row.page_index: (row.text, row.n_pages) for row in rows}
        if self.done.exists():
            return  # pages of a document that has left
        if self.patience_ms and not list(self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
        for page_index, (text, _) in come.items():
            self.pages.updateValue((page_index,), (text,))
        if len(list(self.pages.keys())) >= max(n for _, n in come.values()):
            yield self._leave(key, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if not self.done.exists():
            yield self._leave(key, False)


def stream_pages(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def stitch_stream(pages: DataFrame, patience_ms: int = 0) -> DataFrame:
    """Documents (see DOCUMENTS) of a stream of pages (see PAGES); patience 0 waits for ever.
    The session's state store must keep maps and timers (STATE_STORE)."""
    return pages.groupBy("original_index").transformWithState(StitchPages(patience_ms), DOCUMENTS, "Append", "ProcessingTime" if patience_ms else "None")


def run_stitching(spark: SparkSession, folder: str, out: str, checkpoint: str, patience_ms: int = 0, files_per_trigger: int = 100, partitions: int = 0):
    """Stitch what has come, and stop; a restart goes on from the checkpoint, with as many
    partitions of state as at first (0: the session's number of shuffle partitions).

    With patience, all that has come is one batch: Spark goes on with empty batches for as
    long as a query may have timers of processing time, and so would never stop. Documents whose
    time is up leave in the batch of the next run."""
    own = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        # the query takes a copy of the session's settings when it starts
        return (
            stitch_stream(stream_pages(spark, folder, files_per_trigger), patience_ms)
            .writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(**({"once": True} if patience_ms else {"availableNow": True})).start()
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
