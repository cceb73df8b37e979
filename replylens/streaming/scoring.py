"""Scoring new messages as they arrive."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..session import reused_stages


def score_stream(
    messages: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    trigger: dict[str, str | bool] | None = None,
) -> StreamingQuery:
    """Run ``score`` (a batch function with a fixed model and index) on every batch of
    a message stream and append the result to ``out``.

    Messages are independent, so no state is kept. A batch writes its own folder and
    overwrites it when it is replayed after a failure, so no row is doubled. ``trigger``
    takes what ``DataStreamWriter.trigger`` takes, such as ``{"processingTime": "10
    seconds"}`` for a service that keeps running; by default the stream takes what there
    is and stops. The rate of input is set on the reader (``maxFilesPerTrigger``).
    Started again with the same ``checkpoint``, it goes on where it stopped. The stage
    tables of a batch replace those of the batch before.
    """
    name = f"stream_{uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        with reused_stages(batch.sparkSession, name):
            score(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        messages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
