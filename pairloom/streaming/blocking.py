"""Blocking a streamed search side against a static index table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pairloom.plans.executor import Blocker
from pairloom.plans.program import Program
from pairloom.sources import scratch


def block_stream(table_a: DataFrame, stream: DataFrame, program: Program, sink: Callable[[DataFrame, int], None], checkpoint: str, id_a: str = "_id", id_b: str = "_id", available_now: bool = True) -> StreamingQuery:
    """Run ``program`` on every micro-batch of ``stream`` and hand its pairs (id1, id2) to ``sink(pairs, batch_id)``.

    A search record's result depends on A alone, so batches are independent of each other, top-k
    predicates included. With an idempotent sink the result is exactly once. Indexes of A are built once
    per stream; the scratch tables of a batch are deleted when ``sink`` returns.
    """
    blocker = Blocker(table_a, stream, id_a, id_b)

    def run(batch: DataFrame, batch_id: int) -> None:
        with scratch.scope():
            sink(blocker.over(batch).pairs(program), batch_id)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
