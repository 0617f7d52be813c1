"""A sliding-window limit on requests of each caller. Refused requests take no place.

Each decision depends on the decisions before it, so a caller's requests are decided in
order; all callers run in parallel. A caller's rows stream through one task in sorted
batches, and the state is the `limit` latest admissions, whatever the number of rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def window_counts(requests: DataFrame, caller: str, at: str, key: str, window_s: int) -> DataFrame:
    """(key, caller, n_in_window): requests of the caller in the window_s seconds up to each
    request, both ends included. Time is cut into stretches of a window; each is counted with
    the one before it, so that a hot caller is as many groups as there are stretches. A null
    caller is a caller; a request without a time has a null count."""
    us, width = F.unix_micros(F.col(at).cast("timestamp")), window_s * 1_000_000
    rows = requests.select(F.col(key).alias("k"), F.col(caller).alias("c"), us.alias("t"))
    timed = rows.where("t is not null").withColumn("stretch", F.floor(F.col("t") / width))
    both = timed.withColumn("own", F.lit(True)).unionByName(timed.withColumn("stretch", F.col("stretch") + 1).withColumn("own", F.lit(False)))
    w = Window.partitionBy("c", "stretch").orderBy("t").rangeBetween(-width, 0)
    counted = both.withColumn("n_in_window", F.count(F.lit(1)).over(w)).where("own")
    out = counted.select("k", "c", "n_in_window").unionByName(rows.where("t is null").select("k", "c", F.lit(None).cast("bigint").alias("n_in_window")))
    return out.select(F.col("k").alias(key), F.col("c").alias(caller), "n_in_window")


def admitted(requests: DataFrame, caller: str, at: str, key: str, limit: int, window_s: int) -> DataFrame:
    """(key, caller, is_admitted, retry_after_s): an admission counts for window_s seconds,
    both ends included; retry_after_s is the time until the oldest one leaves. A null
    caller is a caller; requests without a time are refused."""
    us = F.unix_micros(F.col(at).cast("timestamp"))
    rows = requests.select(F.col(key).alias("k"), F.col(caller).alias("c"), us.alias("t"))
    ordered = rows.repartition(F.col("c")).sortWithinPartitions("c", "t", "k")
    kinds = rows.schema

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, started = None, deque(), False
        for b in batches:
            ok, retry = [], []
            for c, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if not started or c != current:
                    current, held, started = c, deque(), True
                if t is None:
                    ok.append(False)
                    retry.append(None)
                    continue
                while held and held[0] < t - window_s * 1_000_000:
                    held.popleft()
                if len(held) < limit:
                    held.append(t)
                    ok.append(True)
                    retry.append(0.0)
                else:
                    ok.append(False)
                    retry.append((held[0] + window_s * 1_000_000 - t) / 1e6)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_()), pa.array(retry, pa.float64())], [key, caller, "is_admitted", "retry_after_s"])

    return ordered.mapInArrow(decide, f"`{key}` {kinds['k'].dataType.simpleString()}, `{caller}` {kinds['c'].dataType.simpleString()}, is_admitted boolean, retry_after_s double")


def admitted_stream(requests: DataFrame, caller: str, at: str, key: str, limit: int, window_s: int, delay: str = "1 minute") -> DataFrame:
    """The same over a stream: the state of a caller is the list of its admissions in the
    window; it is dropped once the watermark has passed them all."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    schema = requests.schema
    out = f"`{key}` {schema[key].dataType.simpleString()}, `{caller}` {schema[caller].dataType.simpleString()}, is_admitted boolean"

    def step(who: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(parts)).sort_values([at, key])  # one micro-batch of one caller
        ok = []
        for t in (rows[at].astype("int64") // 1000 if str(rows[at].dtype).startswith("datetime64[ns") else rows[at].astype("datetime64[us]").astype("int64")):
            while held and held[0] < t - window_s * 1_000_000:
                held.popleft()
            ok.append(len(held) < limit)
            if ok[-1]:
                held.append(int(t))
        state.update((list(held),))
        if held:
            state.setTimeoutTimestamp(max(held[-1] // 1000 + window_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: rows[key], caller: who[0], "is_admitted": ok})

    return requests.withWatermark(at, delay).groupBy(caller).applyInPandasWithState(step, out, "held array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
