"""Result caches with a time to live, on streams: state for each key, timers for lookups that wait and for entries that expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Stores and lookups of a cache as one table: kind is store or lookup; a lookup has an id and no output.
EVENTS = "cache_key string, kind string, at timestamp, lookup_id long, output string"
ANSWERS = "cache_key string, lookup_id long, at timestamp, output string, hit boolean"


def as_of(events: DataFrame, hours: float) -> DataFrame:
    """S35 on a table: what each lookup finds: the output stored last under its key, not after it and at most `hours` before.

    A stored null output is a hit. Of outputs stored at one time the greatest counts. Lookups without a key find nothing.
    A lookup needs nothing older than `hours`, so a key is taken apart by stretches of that length, in which the stores of the
    stretch before stand too: a busy key is as many groups as its time has stretches.
    """
    life = int(hours * 3_600_000_000)
    stretch = F.expr(f"unix_micros(at) div {life}L")
    store = F.col("kind") == "store"
    dealt = events.withColumn("_b", F.explode(F.when(store, F.array(stretch, stretch + 1)).otherwise(F.array(stretch))))
    stored = F.when(store, F.struct("at", F.struct("output").alias("o")))
    w = Window.partitionBy("cache_key", "_b").orderBy("at", ~store, F.col("output").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumn("_s", F.last(stored, True).over(w)).where("kind = 'lookup'")
    hit = F.col("cache_key").isNotNull() & (F.unix_micros("at") - F.unix_micros(F.col("_s.at")) <= life)
    return found.select("cache_key", "lookup_id", "at", F.when(hit, F.col("_s.o.output")).alias("output"), F.coalesce(hit, F.lit(False)).alias("hit"))


def _ms(at: pd.Timestamp) -> int:
    return int(at.value // 1_000_000)


class Lookups(StatefulProcessor):
    """State of one key: entries that a lookup may still need, and lookups that wait until the watermark has passed them."""

    def __init__(self, hours: float):
        self.life = int(hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "at long", "output string")
        self.waiting = handle.getMapState("waiting", "at long, lookup_id long", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for kind, at, lookup, output in zip(frame["kind"], frame["at"], frame["lookup_id"], frame["output"]):
                at = _ms(at)
                if kind == "store":
                    output = None if pd.isna(output) else output
                    known = self.entries.getValue((at,)) if self.entries.containsKey((at,)) else None
                    if known is None or known[0] is None or (output is not None and output > known[0]):
                        self.entries.updateValue((at,), (output,))
                    self.handle.registerTimer(at + self.life + 1)
                else:
                    n = self.waiting.getValue((at, int(lookup)))[0] if self.waiting.containsKey((at, int(lookup))) else 0
                    self.waiting.updateValue((at, int(lookup)), (n + 1,))
                    self.handle.registerTimer(at)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark has passed a time: lookups of that time and before are answered, and entries that no open lookup can find any more go."""
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((at, lookup, value[0]) for (at, lookup), value in self.waiting.iterator() if at <= now)
        entries = sorted((at[0], output[0]) for at, output in self.entries.iterator())
        made = []
        for at, lookup, n in due:
            last = [(t, o) for t, o in entries if at - self.life <= t <= at][-1:]
            made += [(key[0], lookup, pd.Timestamp(at, unit="ms"), last[0][1] if last else None, bool(last))] * n
            self.waiting.removeKey((at, lookup))
        first = min([at for (at, _), _ in self.waiting.iterator()], default=now)
        for at, _ in entries:
            if at + self.life < min(first, now):
                self.entries.removeKey((at,))
        if made:
            yield pd.DataFrame(made, columns=["cache_key", "lookup_id", "at", "output", "hit"])

    def close(self) -> None:
        pass


def answered(events: DataFrame, hours: float, late: str) -> DataFrame:
    """S35, TTL caches on a stream: as_of() of everything that arrives no later than `late` behind the newest.

    A lookup is answered when the watermark has passed its time, so that stores which arrive after it but lie before it count.
    An entry is held while a lookup may need it and dropped by its timer after that. Times are taken to the millisecond. The
    session needs the RocksDB state store.
    """
    known = events.where("cache_key IS NOT NULL").withWatermark("at", late)
    return known.groupBy("cache_key").transformWithStateInPandas(Lookups(hours), ANSWERS, "append", "eventtime")
