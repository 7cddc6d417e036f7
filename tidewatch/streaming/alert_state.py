"""Alerts as state per group of users: what was claimed, what is on its way, what waits for another try.

The ledger isn't a table that each batch reads: a user's claims are state of the user's group, so a batch touches the parts
of groups that it has rows for. Retries are timers in event time. A batch that is run again begins from the state before it, so a restart after a
crash repeats nothing beyond what ``write_batches`` overwrites.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import dates
from ..operators.matching import MOST_ATTEMPTS

INPUT = ["user_id", "impressao", "event_id", "especie", "status_code", "quando", "esperas"]
OUTPUT = "user_id long, impressao string, event_id long, accao string, tentativa int, quando timestamp"
LOOK_BACK = timedelta(days=30)
#: Groups of users that share a state and its timers, and alerts in a part of one, on average at most.
GROUPS, PART = 4096, 128
MINUTE, WINDOW = 60_000_000, LOOK_BACK // timedelta(microseconds=1)  # instants are counted in microseconds
#: State of transformWithState needs this store.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def waits(key: Column, ladder: list[int] | None = None) -> Column:
    """Minutes to wait after the first, second, ... failed try of a message; without a ``ladder`` those of ``retry_delay_minutes``."""
    found = [F.lit(m) for m in ladder] if ladder else [dates.retry_delay_minutes(F.lit(n), key) for n in range(1, MOST_ATTEMPTS)]
    return F.array(*[x.cast("long") for x in found])


def alerts(rows: DataFrame, ladder: list[int] | None = None) -> DataFrame:
    """Matched alerts (user_id, impressao, event_id, quando) as input."""
    return rows.select("user_id", "impressao", "event_id", F.lit("alerta").alias("especie"), F.lit(None).cast("int").alias("status_code"), F.col("quando").cast("timestamp").alias("quando"), waits(F.col("event_id"), ladder).alias("esperas"))


def responses(rows: DataFrame) -> DataFrame:
    """Answers to messages (user_id, impressao, status_code, quando) as input."""
    return rows.select("user_id", "impressao", F.lit(None).cast("long").alias("event_id"), F.lit("resposta").alias("especie"), F.col("status_code").cast("int").alias("status_code"), F.col("quando").cast("timestamp").alias("quando"), F.array().cast("array<long>").alias("esperas"))


class Held:
    """A group's alerts by user and fingerprint. Each call to the state costs a round trip, so alerts are kept in parts by the
    checksum of their key: a part is read and written as a whole, and the more alerts there are, the more parts."""

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getMapState("avisos", "parte int", "avisos string")
        self.head = handle.getMapState("cabeca", "um int", "cabeca string")

    def opened(self) -> Opened:
        return Opened(self)

    def __len__(self) -> int:
        return self.opened().n

    def __contains__(self, key: tuple) -> bool:
        held = self.opened()
        return key in held.part(held.place(key))


class Opened:
    """``Held`` of one group during one call: what was read, and what is to be written at its end.

    ``wakes``: of each part the instants, in milliseconds, when it has something to try again and something to forget.
    ``timers``: those that are set and didn't expire yet.
    """

    def __init__(self, held: Held) -> None:
        self.held, self.read, self.changed = held, {}, set()
        head = json.loads(held.head.getValue((0,))[0]) if held.head.containsKey((0,)) else {"bits": 0, "n": 0, "wakes": {}, "timers": []}
        self.bits, self.n, self.timers, self.wakes = head["bits"], head["n"], set(head["timers"]), {int(i): x for i, x in head["wakes"].items()}
        self.there = head["n"] > 0

    def place(self, key: tuple) -> int:
        return zlib.crc32(repr(key).encode()) & (1 << self.bits) - 1

    def part(self, i: int) -> dict:
        """Of a part's alerts, by user and fingerprint: event, state, tries, begin, next try, waits."""
        if i not in self.read:
            there = self.there and self.held.parts.containsKey((i,))
            self.read[i] = {(user, name): rest for user, name, *rest in json.loads(self.held.parts.getValue((i,))[0])} if there else {}
        return self.read[i]

    def close(self, now: int) -> set[int]:
        """Writes what was changed, in more parts if there are too many alerts for those there are. Gives the timers to set."""
        if self.n > PART << self.bits:
            found = [x for i in range(1 << self.bits) for x in self.part(i).items()]
            while self.n > PART << self.bits:
                self.bits += 1
            self.read, self.changed = {i: {} for i in range(1 << self.bits)}, set(range(1 << self.bits))
            for key, alert in found:
                self.read[self.place(key)][key] = alert
        for i in self.changed:
            self.wakes[i] = wakes(self.read[i], now)
            if self.read[i]:
                self.held.parts.updateValue((i,), (json.dumps([[*key, *alert] for key, alert in self.read[i].items()]),))
            elif self.there and self.held.parts.containsKey((i,)):
                self.held.parts.removeKey((i,))
        set_, self.wakes = self.timers, {i: x for i, x in self.wakes.items() if any(x)}
        wanted = {min(x) for x in ([x for x in some if x is not None] for some in zip(*self.wakes.values(), strict=True)) if x}
        self.timers = set_ | wanted
        if self.n:
            self.held.head.updateValue((0,), (json.dumps({"bits": self.bits, "n": self.n, "wakes": self.wakes, "timers": sorted(self.timers)}),))
        elif self.there:
            self.held.head.removeKey((0,))  # and all parts with it
        return wanted - set_


class Alerts(StatefulProcessor):
    """Alerts of a group of users, by user and fingerprint: claimed once, sent, sent again after a wait, failed for good, forgotten when too old."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = Held(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = [x for part in rows for x in told(part)]
        found.sort(key=lambda x: x[:3])
        now, out, held = timerValues.getCurrentWatermarkInMs(), [], self.held.opened()
        floor = now * 1000 - WINDOW
        for when, kind, event_id, user, name, code, steps in found:
            i = held.place((user, name))
            part = held.part(i)
            alert = part.get((user, name))
            if kind == "alerta":
                if when <= floor or alert is not None:
                    continue
                out.append((user, name, event_id, "enviar", 1, when))
                part[user, name] = [event_id, "em_voo", 1, when, None, [int(x) for x in steps]]
                held.n += 1
            elif alert is None or alert[1] != "em_voo":
                continue
            elif code is not None and 200 <= code <= 299:
                alert[1] = "enviado"
                out.append((user, name, alert[0], "enviado", alert[2], when))
            elif (code is None or code == 429 or code >= 500) and alert[2] <= len(alert[5]):
                alert[1], alert[4] = "espera", when + alert[5][alert[2] - 1] * MINUTE
            else:
                alert[1] = "falhou"
                out.append((user, name, alert[0], "falhou", alert[2], when))
            held.changed.add(i)
        self.written(held, now)
        if out:
            yield frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, out, held = expiredTimerInfo.getExpiryTimeInMs(), [], self.held.opened()
        now = at if timerValues is None else max(at, timerValues.getCurrentWatermarkInMs() - 1)  # all that expires in this batch
        for i in [i for i, x in held.wakes.items() if any(t is not None and t <= now for t in x)]:
            part = held.part(i)
            for alert_key, alert in list(part.items()):
                _, state, tries, begun, again, _ = alert
                if state == "espera" and again <= now * 1000:
                    alert[1], alert[2], alert[4] = "em_voo", tries + 1, None
                    out.append((*alert_key, alert[0], "enviar", tries + 1, again))
                elif state in ("enviado", "falhou") and begun + WINDOW <= now * 1000:
                    del part[alert_key]  # an event as old isn't alerted any more
                    held.n -= 1
            held.changed.add(i)
        held.timers.discard(at)
        self.written(held, now)
        if out:
            yield frame(out)

    def written(self, held: Opened, now: int) -> None:
        for at in sorted(held.close(now)):
            self.handle.registerTimer(at)


def wakes(part: dict, now: int) -> list[int | None]:
    """When a part's next try is due, and when its next alert is to be forgotten: at once after ``now`` where that was answered too late."""
    tries = [above(x[4]) for x in part.values() if x[1] == "espera"]
    old = [max(above(x[3] + WINDOW), now + 1) for x in part.values() if x[1] in ("enviado", "falhou") or above(x[3] + WINDOW) > now]
    return [min(tries, default=None), min(old, default=None)]


def above(at: int) -> int:
    """The first millisecond that isn't before a microsecond: timers know no finer."""
    return -(-at // 1000)


def ms(at: pd.Timestamp) -> int:
    """The first millisecond that isn't before an instant."""
    return above(-(-pd.Timestamp(at).as_unit("ns").value // 1000))


def told(rows: pd.DataFrame) -> Iterator[tuple]:
    """(instant, kind, event, user, fingerprint, status, waits) of input rows; no event comes after all, no status is None."""
    when = rows["quando"].to_numpy("datetime64[us]").astype("int64").tolist()
    events = [float("inf") if x is None or x != x else int(x) for x in rows["event_id"].tolist()]
    codes = [None if x is None or x != x else int(x) for x in rows["status_code"].tolist()]
    return zip(when, rows["especie"].tolist(), events, rows["user_id"].tolist(), rows["impressao"].tolist(), codes, rows["esperas"].tolist(), strict=True)


def frame(rows: list[tuple]) -> pd.DataFrame:
    kinds = {"user_id": "int64", "event_id": "int64", "tentativa": "int32", "quando": "datetime64[us]"}
    names = [c.split()[0] for c in OUTPUT.split(", ")]
    return pd.DataFrame({c: np.array(x, dtype=kinds.get(c, "object")) for c, x in zip(names, zip(*rows, strict=True), strict=True)})


def actions(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """What is to be done, as a stream: messages to send with the number of the try, and messages that went or failed for good.

    ``rows``: a stream of ``alerts`` and ``responses``. Rows later than ``late`` behind the newest may miss their timers, never
    their state. The session needs ``spark.sql.streaming.stateStore.providerClass`` to name ``PROVIDER``.
    """
    group = F.pmod(F.xxhash64("user_id"), F.lit(GROUPS)).cast("int").alias("grupo")
    return rows.select(group, *INPUT).withWatermark("quando", late).groupBy("grupo").transformWithStateInPandas(Alerts(), OUTPUT, "append", "eventTime")


def write_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs a stream over all there is; the folder of a batch is overwritten by its repetition."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/lote={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stateful(spark: SparkSession) -> SparkSession:
    """The session with the store that state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark
