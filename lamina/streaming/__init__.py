"""Micro-batches as layers: each batch of a stream of long rows is committed as one child revision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.edit import NewChild, WorkingRecord
from lamina.sources.store import Store


def commits(store: Store, revision: str, attribute: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: every non-empty batch sets ``attribute`` on top of the last commit.

    Rows are (name, dims..., value).  ``commits.head`` of the returned function names the newest
    revision.  Layers are write-once, so a batch that is replayed after a crash becomes one more
    layer of the same values and resolves alike.
    """

    def each(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        w = WorkingRecord(store.record(each.head))
        w.set(attribute, batch.withColumn("value", F.col("value")))
        each.head = w.commit(NewChild()).id

    each.head = revision
    return each
