"""Alerts as state against a plain loop, with repeats, late rows, retries, a crash and a restart."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.streaming import alert_state

START = dt.datetime(2024, 1, 1)
LADDER = [15, 60]


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def batches(spark, path, *files):
    for i, rows in enumerate(files):
        a = spark.createDataFrame([(u, i_, e, at(m)) for u, i_, e, m in rows if not isinstance(e, str)], "user_id long, impressao string, event_id long, quando timestamp")
        b = spark.createDataFrame([(u, i_, None if s == "-" else int(s), at(m)) for u, i_, s, m in rows if isinstance(s, str)], "user_id long, impressao string, status_code int, quando timestamp")
        alert_state.alerts(a, LADDER).unionByName(alert_state.responses(b)).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    schema = spark.read.parquet(path).schema
    return alert_state.actions(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), "0 seconds")


def found(spark, path):
    return sorted((r.user_id, r.impressao, r.event_id, r.accao, r.tentativa, int((r.quando - START).total_seconds() // 60)) for r in spark.read.parquet(path).collect())


FIRST = [(1, "a", 10, 0), (1, "a", 11, 1), (1, "b", 12, 2), (2, "a", 13, 2), (1, "a", "503", 3), (2, "a", "200", 3), (1, "b", "404", 4)]
SECOND = [(1, "a", 14, 17), (1, "a", "200", 18), (3, "z", 15, 40), (2, "a", "500", 41)]
THIRD = [(1, "a", "-", 42), (3, "z", "429", 43)]
FOURTH = [(9, "far", 16, 60 * 24 * 40)]
FIFTH = [(1, "old", 17, 10), (9, "far", "204", 60 * 24 * 40 + 1), (2, "a", 18, 60 * 24 * 40 + 2)]
WANT = [
    (1, "a", 10, "enviar", 1, 0), (1, "b", 12, "enviar", 1, 2), (1, "b", 12, "falhou", 1, 4), (2, "a", 13, "enviado", 1, 3), (2, "a", 13, "enviar", 1, 2), (3, "z", 15, "enviar", 1, 40),
    (1, "a", 10, "enviar", 2, 18), (1, "a", 10, "enviar", 3, 102), (3, "z", 15, "enviar", 2, 58), (9, "far", 16, "enviar", 1, 57600), (9, "far", 16, "enviado", 1, 57601), (2, "a", 18, "enviar", 1, 57602),
]


@pytest.fixture(scope="module")
def session(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield alert_state.stateful(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_claims_retries_and_a_crash(session, tmp_path):
    spark, path, out, check = session, *[str(tmp_path / x) for x in ("in", "out", "check")]
    batches(spark, path, FIRST, SECOND)
    broken = {"yet": True}

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/lote={number}")
        if number == 1 and broken["yet"]:
            broken["yet"] = False
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        stream(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    for more in (THIRD, FOURTH, FIFTH):
        alert_state.write_batches(stream(spark, path), out, check).awaitTermination()
        batches(spark, path, more)
    alert_state.write_batches(stream(spark, path), out, check).awaitTermination()
    got = found(spark, out)
    assert len(got) == len(set(got)) and got == sorted(WANT)
    alert_state.write_batches(stream(spark, path), out, check).awaitTermination()
    assert found(spark, out) == got


def test_waits_are_those_of_the_ladder(spark):
    (r,) = spark.range(1).select(alert_state.waits(F.col("id")).alias("w"), alert_state.waits(F.col("id"), LADDER).alias("l")).collect()
    assert r.l == LADDER and len(r.w) == 4 and [a <= b <= a + 10 for a, b in zip([15, 60, 360, 1440], r.w, strict=True)] == [True] * 4


class Store(dict):
    """A map of state that can't be gone through."""

    containsKey, getValue, updateValue = dict.__contains__, dict.get, dict.__setitem__  # noqa: N815

    def removeKey(self, key):  # noqa: N802
        self.pop(key, None)

    def iterator(self):
        raise AssertionError("all alerts of a user are read")


def test_a_timer_reads_only_the_alerts_that_it_is_for():
    from types import SimpleNamespace as Of

    import pandas as pd

    timers, now = set(), alert_state.ms(pd.Timestamp(START))
    user = alert_state.Alerts()
    user.init(Of(getMapState=lambda *_: Store(), registerTimer=timers.add))
    rows = [(1, f"i{i}", i, "alerta", None, pd.Timestamp(at(0)), LADDER) for i in range(50)] + [(1, "i7", None, "resposta", 503, pd.Timestamp(at(1)), [])]
    list(user.handleInputRows((1,), iter([pd.DataFrame(rows, columns=alert_state.INPUT)]), Of(getCurrentWatermarkInMs=lambda: now)))
    first, last = sorted(timers)
    expire = lambda t: [tuple(r) for part in user.handleExpiredTimer((1,), None, Of(getExpiryTimeInMs=lambda: t)) for r in part[["impressao", "tentativa"]].itertuples(index=False)]
    assert expire(first) == [("i7", 2)] and expire(last) == [] and len(user.held) == 50  # none was answered for good
    answer = pd.DataFrame([(1, "i3", None, "resposta", 200, pd.Timestamp(at(2)), [])], columns=alert_state.INPUT)
    list(user.handleInputRows((1,), iter([answer]), Of(getCurrentWatermarkInMs=lambda: last)))
    assert expire(last + 1) == [] and ("i3",) not in user.held and len(user.held) == 49
