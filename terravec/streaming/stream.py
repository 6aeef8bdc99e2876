"""Structured Streaming twins of the running feature state and of the decomposition averages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravec.operators.sae import EMA_BETA, EMA_FROM_STEP, ema


def stream_threshold_ema(rows: DataFrame, beta: float = EMA_BETA, after: int = EMA_FROM_STEP) -> DataFrame:
    """(run, step, threshold) as rows (run, step, value) arrive; all rows of a step come in one micro-batch, steps in order.
    State by run: the moving average so far. Each task first keeps the minimum of its rows of a step, so that the state gets a row
    for each step and task, however many rows a step has."""

    def minima(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least = None
        for some in frames:
            now = some.groupby(["run", "step"], as_index=False)["value"].min()
            least = now if least is None else pd.concat([least, now]).groupby(["run", "step"], as_index=False)["value"].min()
        if least is not None:
            yield least

    def update(key, frames: Iterator[pd.DataFrame], state):
        least = pd.concat([f[["step", "value"]] for f in frames]).groupby("step")["value"].min().sort_index()
        start = state.get[0] if state.exists else None
        values = ema(least.to_numpy(float), beta, start)
        state.update((float(values[-1]),))
        yield pd.DataFrame({"run": key[0], "step": least.index.astype(np.int64), "threshold": values})

    some = rows.select(F.col("run").cast("int"), F.col("step").cast("long"), F.col("value").cast("double")).filter(F.col("step") > after)
    least = some.mapInPandas(minima, "run int, step long, value double")
    return least.groupBy("run").applyInPandasWithState(update, "run int, step bigint, threshold double", "threshold double", "append", "NoTimeout")


def stream_rows_since_fired(rows: DataFrame, steps: int = 10_000) -> DataFrame:
    """(neuron, part, step, seen, last) as rows (neuron, step, batch_size, fired) arrive, steps in order. State by feature and range of
    ``steps`` steps: the rows seen in it and the count at which the feature last fired there. So a feature's micro-batch is
    as many groups as it has ranges; ``sae.settled`` joins the ranges of what has been written."""

    def update(key, frames: Iterator[pd.DataFrame], state):
        pdf = pd.concat([f[["step", "batch_size", "fired"]] for f in frames]).sort_values("step", kind="stable")
        seen0, last0 = state.get if state.exists else (0, 0)
        seen = seen0 + pdf["batch_size"].to_numpy(np.int64).cumsum()
        last = np.maximum(np.maximum.accumulate(np.where(pdf["fired"].to_numpy(bool), seen, 0)), last0)
        state.update((int(seen[-1]), int(last[-1])))
        yield pd.DataFrame({"neuron": key[0], "part": key[1], "step": pdf["step"].to_numpy(np.int64), "seen": seen, "last": last})

    some = rows.select(F.col("neuron").cast("int"), "step", "batch_size", "fired", F.floor(F.col("step") / steps).cast("long").alias("part"))
    return some.groupBy("neuron", "part").applyInPandasWithState(update, "neuron int, part bigint, step bigint, seen bigint, last bigint", "seen bigint, last bigint", "append", "NoTimeout")


def stream_decompose(encoded: DataFrame) -> DataFrame:
    """Running totals of an encoded stream (concepts, weights, l0, cosine): concept_id, weight_sum, and under concept_id -1 the
    number of rows (weight_sum), which the means are to be divided by. For complete mode."""
    both = F.concat(F.arrays_zip("concepts", "weights"), F.array(F.struct(F.lit(-1).alias("concepts"), F.lit(1.0).alias("weights"))))
    return encoded.select(F.inline(both)).groupBy(F.col("concepts").alias("concept_id")).agg(F.sum("weights").alias("weight_sum"))


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """All that is there now, through the stream, as Parquet beside the checkpoint. In complete mode each micro-batch writes the
    whole result to a folder of its own, and the last one is read."""
    w = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    out, done = f"{checkpoint}-{name}", []

    def whole(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch-{batch}")
        done.append(batch)

    q = w.format("parquet").start(out) if mode == "append" else w.foreachBatch(whole).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    if mode != "append":
        out = f"{out}/batch-{max(done)}" if done else out
    read = stream.sparkSession.read.schema(stream.schema)
    return read.parquet(out) if mode == "append" or done else stream.sparkSession.createDataFrame([], stream.schema)


def run_arrivals(parts: list[DataFrame], build: Callable[[DataFrame], DataFrame], name: str, folder: str) -> DataFrame:
    """What an append stream writes as parts arrive one after another: each is written beside those before it, and the query goes on
    from its checkpoint, with the state it left."""
    spark, out = parts[0].sparkSession, None
    for i, part in enumerate(parts):
        part.write.parquet(f"{folder}/in/arrival={i}")
        out = run_to_table(build(spark.readStream.schema(part.schema).parquet(f"{folder}/in/*")), name, "append", f"{folder}/state")
    return out
