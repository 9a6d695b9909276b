"""Protocol folds over streams, with the fold's state kept by Spark between batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def fold_stream(stream: DataFrame, key: str, order: list[str], start: Callable[[], Callable], schema: str) -> DataFrame:
    """As protocols.ordered_fold, on a stream whose batches come in order: rows of schema for each new row.

    start() makes a fold with dump() and load(text) for its state, one for each value of key. Within a batch rows are
    sorted by order; a batch of a key is held by one task, so sources should bound their batches.
    """
    names = [part.strip().split()[0] for part in schema.split(",")]

    def step(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = start()
        if state.exists:
            fold.load(state.get[0])
        rows = pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable")
        out = [made for row in rows.itertuples(index=False) for made in fold(row)]
        state.update((fold.dump(),))
        yield pd.DataFrame(out, columns=names)

    return stream.groupBy(key).applyInPandasWithState(step, schema, "state string", "append", GroupStateTimeout.NoTimeout)
