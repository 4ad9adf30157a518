"""Request limits per subject, as batch aggregates and as streams that give the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Requests allowed to a guest.
PER_MINUTE, PER_HOUR = 4, 30


def counts(events: DataFrame, unit: str, subject: str = "user_id", ts: str = "ts") -> DataFrame:
    """(subject, window_start, n) of each minute or hour."""
    return events.groupBy(subject, F.date_trunc(unit, ts).alias("window_start")).agg(F.count(F.lit(1)).alias("n"))


def verdicts(events: DataFrame, subject: str = "user_id", ts: str = "ts", id_: str = "event_id") -> DataFrame:
    """Every event with its number in its minute and hour, and whether both limits allow it."""
    place = lambda unit: F.row_number().over(Window.partitionBy(subject, F.date_trunc(unit, ts)).orderBy(ts, id_))
    rows = events.select(id_, subject, ts, place("MINUTE").alias("in_minute"), place("HOUR").alias("in_hour"))
    return rows.withColumn("allowed", (F.col("in_minute") <= PER_MINUTE) & (F.col("in_hour") <= PER_HOUR))


def stream(events: DataFrame, unit: str = "1 hour", late: str = "1 hour", subject: str = "user_id", ts: str = "ts") -> DataFrame:
    """The running counts of a stream; windows leave the state when the watermark has passed them."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = timed.groupBy(F.window(ts, unit), subject).agg(F.count(F.lit(1)).alias("n"))
    return out.select(subject, F.col("window.start").alias("window_start"), "n")


#: The state store that keyed state with timers needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Groups of subjects that share a piece of state; fixed for a checkpoint.
GROUPS = 1024
HOUR = 3600


class Limiter(StatefulProcessor):
    """Of one group of subjects: how many requests each minute has had, with its hour, and a timer for when no more can
    come in the earliest of these.  The counters are one value, which a batch reads and writes once."""

    def __init__(self, id_: str):
        self.id = id_

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("windows", "counters binary")

    def held(self):
        import pandas as pd
        import pyarrow as pa

        found = self.counts.get()
        if found is None:
            return pd.DataFrame({"subject": pd.Series(dtype=object), "hour": pd.Series(dtype="int64"), "minute": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})
        return pa.ipc.open_stream(bytes(found[0])).read_pandas()

    def hold(self, windows, watermark: int) -> None:
        """Keeps those windows whose hour is not over by the watermark, as later requests for the others are dropped."""
        import pyarrow as pa

        windows = windows[(windows["hour"] + HOUR) * 1000 > watermark]
        if not len(windows):
            self.counts.clear()
            return
        columns = [pa.array(windows["subject"], pa.string(), from_pandas=True), *(pa.array(windows[c], pa.int64()) for c in ("hour", "minute", "n"))]
        batch, sink = pa.RecordBatch.from_arrays(columns, ["subject", "hour", "minute", "n"]), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
            out.write_batch(batch)
        self.counts.update((sink.getvalue().to_pybytes(),))
        self.handle.registerTimer((int(windows["hour"].min()) + HOUR) * 1000)

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np
        import pandas as pd

        held, asked = self.held(), pd.concat([r[[self.id, "subject", "at", "minute", "hour"]] for r in rows], ignore_index=True)
        asked = asked.sort_values(["at", self.id], kind="stable", ignore_index=True)
        # What is held stands first, with its counts; each request counts one.
        windows = pd.concat([held[["subject", "hour", "minute"]], asked[["subject", "hour", "minute"]]], ignore_index=True)
        windows["n"] = np.concatenate([held["n"].to_numpy("int64"), np.ones(len(asked), "int64")])
        code = pd.Series(pd.factorize(windows["subject"], use_na_sentinel=False)[0])
        numbers = {unit: windows["n"].groupby([code, windows[unit]], sort=False).cumsum().to_numpy()[len(held) :] for unit in ("minute", "hour")}
        total = windows["n"].groupby([code, windows["minute"]], sort=False).transform("sum")
        last = ~pd.DataFrame({"s": code, "m": windows["minute"]}).duplicated()
        self.hold(windows.assign(n=total)[last], timerValues.getCurrentWatermarkInMs())
        yield asked[[self.id, "subject", "at"]].assign(in_minute=numbers["minute"], in_hour=numbers["hour"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        self.hold(self.held(), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()))
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def verdict_stream(events: DataFrame, late: str = "1 hour", subject: str = "user_id", ts: str = "ts", id_: str = "event_id") -> DataFrame:
    """As ``verdicts``, for a stream: every request with its numbers and whether it is allowed, once, as it comes.

    Requests that come together are numbered by time and id, later ones after those that came before; where requests come
    in the order of time this equals the batch form.  A window's counters leave the state when the watermark has passed
    its hour; requests later than ``late`` get no verdict.  The session needs the settings ``STORE``.  Rows without a
    subject are of one subject; rows without a time are dropped.  Subjects are of a type that its text gives back.
    """
    spark = events.sparkSession
    kinds = {f.name: f.dataType for f in events.schema.fields}
    at = F.col(ts).cast("timestamp")
    start = lambda unit: F.unix_seconds(F.date_trunc(unit, at))
    timed = events.filter(F.col(ts).isNotNull()).select(F.col(id_), F.col(subject).cast("string").alias("subject"), at.alias("time"), F.unix_micros(at).alias("at"), start("MINUTE").alias("minute"), start("HOUR").alias("hour")).withWatermark("time", late)
    grouped = timed.withColumn("part", F.pmod(F.xxhash64("subject"), F.lit(GROUPS)).cast("int"))
    for name, value in STORE.items():
        if spark.conf.get(name, None) != value:
            raise ValueError(f"{name} must be {value}")
    out = f"{id_} {kinds[id_].simpleString()}, subject string, at long, in_minute long, in_hour long"
    rows = grouped.groupBy("part").transformWithStateInPandas(Limiter(id_), out, "append", "eventTime")
    allowed = (F.col("in_minute") <= PER_MINUTE) & (F.col("in_hour") <= PER_HOUR)
    return rows.select(id_, F.col("subject").cast(kinds[subject]).alias(subject), F.timestamp_micros("at").alias(ts), "in_minute", "in_hour", allowed.alias("allowed"))
