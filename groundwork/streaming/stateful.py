"""Steps of operators.folds as stateful streaming operators: the same state per key, kept by Spark between batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from groundwork.operators.folds import Step


def stateful(events: DataFrame, key: str, order: list[str], inputs: list[str], carry: list[str], step: Step, outputs: str) -> DataFrame:
    """A stream of key, carry and outputs, one row per event, in order within a batch; a key's rows arrive batch by batch.

    Late rows are taken when they come. State is one JSON text per key, so it survives restarts and moves between executors.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    columns = [key, *carry]
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", " + outputs
    names = columns + [o.split()[0] for o in outputs.split(", ")]

    def run(k: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        state = json.loads(held.get[0]) if held.exists else {}
        batch = pd.concat(list(frames)).sort_values(order, kind="stable")
        rows = [(k[0], *row[: len(carry)], *step(state, row[len(carry) :])) for row in batch[carry + inputs].itertuples(index=False, name=None)]
        held.update((json.dumps(state),))
        yield pd.DataFrame(rows, columns=names)

    picked = events.select(key, *dict.fromkeys([*carry, *inputs, *order]))
    return picked.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)
