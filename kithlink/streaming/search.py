"""Search per micro-batch: a stream of query records against a static store. An addition; the batch search is ``operators.search``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from kithlink.operators.search import search
from kithlink.plans.model import Model
from kithlink.sources.store import Store


def search_stream(store: Store, queries: DataFrame, model: Model, emit: Callable[[dict, DataFrame, int], None], checkpoint: str, k: int = 10, **options):
    """Start a query that answers each record of ``queries`` (columns of the schema) and calls ``emit(record, hits, batch)``; a micro-batch's queries are few, its answers are k rows each."""

    def answer(batch: DataFrame, number: int) -> None:
        for r in batch.toLocalIterator():
            record = {n: v for n, v in r.asDict().items() if v is not None}
            emit(record, search(store, record, model, k, **options), number)

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).start()
