"""Filters over streams.

A lowered filter is a plain column, so a bound streaming frame filters as a batch frame does: without state, in the
stream's own plan. What needs more is here: lists that change while a stream runs, and routing by several filters.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.engine import BoundFrame, bind
from ..scheme import Scheme


def filter_batches(stream: DataFrame, scheme: Callable[[], Scheme], text: str, sink: Callable[[DataFrame, int], None], checkpoint: str, columns: Mapping[str, Column | str] | None = None, **options: str) -> StreamingQuery:
    """Each micro-batch is filtered by a scheme made anew, so its lists are as current as the batch; ``sink`` gets the matches."""

    def one(batch: DataFrame, number: int) -> None:
        sink(bind(batch, scheme(), columns).filter(text), number)

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if options.pop("available_now", None) else writer).options(**options).start()


def route(frame: BoundFrame, filters: Mapping[str, str]) -> DataFrame:
    """The frame with an array column ``routes``: the names of the filters that a row matches, in one pass.

    Table lists are joined as static tables; under ``[*]`` they need batches (:func:`filter_batches`).
    """
    return frame.route(filters)
