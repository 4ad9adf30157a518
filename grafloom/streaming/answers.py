"""An answer cache as a stream: what is asked, stored and called invalid comes as events, and state answers.

An entry lives in keyed state: its answer, when it ends, how often and when it was last used.  It ends ``TTL`` hours after
it was stored, or when it is called invalid while it holds; storing again renews it and keeps its counters.  Ended entries
are kept for ``GRACE`` days, so that a renewal goes on counting; then a timer takes them from the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

TTL, GRACE = 24, 7
HOUR = 3_600_000
ENTRY = "answer string, ends long, hits long, last long"


class Entry(StatefulProcessor):
    def __init__(self, ttl: int, grace: int):
        self.ttl, self.grace = ttl * HOUR, grace * 24 * HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.entry = handle, handle.getValueState("entry", ENTRY)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        frame = pd.concat(list(rows)).sort_values(["ts", "id"], kind="stable")
        held = tuple(self.entry.get()) if self.entry.exists() else None
        out = []
        for id_, ts, at, kind, answer in zip(frame["id"], frame["ts"], frame["ts"].to_numpy("datetime64[ms]").astype("int64").tolist(), frame["kind"], frame["answer"]):
            if held and held[1] + self.grace < at:
                held = None
            if kind == "store":
                held = (answer, at + self.ttl, *(held[2:] if held else (0, None)))
            elif kind == "invalid" and held and held[1] > at:
                held = (held[0], at, *held[2:])
            elif kind == "ask":
                hit = held is not None and held[1] > at
                if hit:
                    held = (held[0], held[1], held[2] + 1, at)
                out.append((key[0], id_, ts, hit, held[0] if hit else None, held[2] if hit else None))
        if held:
            self.entry.update(held)
            self.handle.registerTimer(held[1] + self.grace + 1)
        elif self.entry.exists():
            self.entry.clear()
        yield pd.DataFrame(out, columns=["key", "id", "ts", "hit", "answer", "hits"]).astype({"hits": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        if self.entry.exists() and self.entry.get()[1] + self.grace < expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def answered(events: DataFrame, late: str = "1 hour", ttl: int = TTL, grace: int = GRACE) -> DataFrame:
    """(key, id, ts, hit, answer, hits) of every question of a stream (key, id, ts, kind, answer), where kind is ``ask``,
    ``store`` or ``invalid``, once.

    Events that come together are taken by time and id.  Rows without a time are dropped, those without a key are of one
    key, other kinds do nothing; events later than ``late`` are dropped.  The session needs the settings
    ``limits.STORE``.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    timed = events.select("key", "id", F.col("ts").cast("timestamp").alias("ts"), "kind", "answer").filter(F.col("ts").isNotNull()).withWatermark("ts", late)
    out = f"key {kinds['key']}, id {kinds['id']}, ts timestamp, hit boolean, answer string, hits long"
    return timed.groupBy("key").transformWithStateInPandas(Entry(ttl, grace), out, "append", "eventTime")
