"""Batches over a stream of items: one open batch per stratum in keyed state, kept across restarts by the checkpoint."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtile.operators.batching import Constraint

OUT = "stratum long, batch long, id string, measure double"
STATE = "batch long, ids array<string>, measures array<double>"


def batch_stream(items: DataFrame, constraint: Constraint, stratum: str, measure: str = "duration") -> DataFrame:
    """(stratum, batch, id, measure): a batch goes out when it is nearly full; the open one stays in state."""

    def update(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        batch, ids, sizes = state.get if state.exists else (0, [], [])
        ids, sizes, out = list(ids), list(sizes), []
        for pdf in pdfs:
            for i, m in sorted(zip(pdf["id"], pdf["measure"])):
                ids.append(i)
                sizes.append(float(m))
                eff = [constraint.size(x) for x in sizes]
                if constraint.close_to_exceeding(len(eff), max(eff), sum(eff)):
                    out += [(key[0], batch, a, b) for a, b in zip(ids, sizes)]
                    batch, ids, sizes = batch + 1, [], []
        state.update((batch, ids, sizes))
        if out:
            yield pd.DataFrame(out, columns=["stratum", "batch", "id", "measure"])

    d = items.select(F.col(stratum).cast("long").alias("stratum"), F.col("id").cast("string").alias("id"), F.col(measure).cast("double").alias("measure")).where("measure is not null")
    return d.groupBy("stratum").applyInPandasWithState(update, OUT, STATE, "append", "NoTimeout")
