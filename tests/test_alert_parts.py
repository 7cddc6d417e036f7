"""A group's alerts are read and written in parts: few calls to the state however many alerts, with the results of a plain loop."""

import datetime as dt
from types import SimpleNamespace as Of

import pandas as pd

from tidewatch.streaming import alert_state

START = pd.Timestamp(dt.datetime(2024, 1, 1))
LADDER = [15, 60]


class Store(dict):
    calls = 0

    def _counted(method):  # noqa: N805
        def call(self, *given):
            Store.calls += 1
            return method(self, *given)

        return call

    containsKey, getValue, updateValue, removeKey = _counted(dict.__contains__), _counted(dict.get), _counted(dict.__setitem__), _counted(dict.pop)  # noqa: N815


def user_of(timers):
    def register(at):
        Store.calls += 1
        timers.add(at)

    user = alert_state.Alerts()
    user.init(Of(getMapState=lambda *_: Store(), registerTimer=register))
    return user


def row(i, kind, code, minute):
    return (1, f"i{i}", i if kind == "alerta" else None, kind, code, START + pd.Timedelta(minutes=minute), LADDER if kind == "alerta" else [])


def fed(user, rows, now):
    return [tuple(r) for part in user.handleInputRows((1,), iter([pd.DataFrame(rows, columns=alert_state.INPUT)]), Of(getCurrentWatermarkInMs=lambda: now)) for r in part[["impressao", "accao", "tentativa"]].itertuples(index=False)]


def expired(user, timers, now):
    """All timers before ``now``, as a batch does."""
    out = []
    for at in sorted(t for t in timers if t < now):
        timers.discard(at)
        out += [tuple(r) for part in user.handleExpiredTimer((1,), Of(getCurrentWatermarkInMs=lambda: now), Of(getExpiryTimeInMs=lambda at=at: at)) for r in part[["impressao", "accao", "tentativa"]].itertuples(index=False)]
    return out


def test_many_alerts_take_few_calls():
    Store.calls, n, timers, first = 0, 1000, set(), alert_state.ms(START)
    user = user_of(timers)
    got = fed(user, [row(i, "alerta", None, i) for i in range(n)] + [row(i, "resposta", [200, 404, 503][i % 3], i + 1) for i in range(n)], first)
    assert sorted(got) == sorted([(f"i{i}", "enviar", 1) for i in range(n)] + [(f"i{i}", "enviado" if i % 3 == 0 else "falhou", 1) for i in range(n) if i % 3 < 2])
    half = first + 516 * 60_000 + 1  # i + 1 + 15 minutes, of which those up to 500 are over
    assert sorted(expired(user, timers, half)) == sorted((f"i{i}", "enviar", 2) for i in range(2, 501, 3))
    late = first + 1100 * 60_000
    assert sorted(expired(user, timers, late)) == sorted((f"i{i}", "enviar", 2) for i in range(503, n, 3))
    assert fed(user, [row(i, "alerta", None, 1100) for i in range(n)], late) == []
    assert Store.calls < n / 4, Store.calls


def test_all_are_forgotten():
    n, timers, first = 400, set(), alert_state.ms(START)
    user = user_of(timers)
    fed(user, [row(i, "alerta", None, i) for i in range(n)] + [row(i, "resposta", 200, i + 1) for i in range(n - 1)], first)
    days = 30 * 24 * 60
    assert expired(user, timers, first + (days + 200) * 60_000) == [] and len(user.held) == n - 200
    now = first + (days + 2 * n) * 60_000
    assert expired(user, timers, now) == [] and len(user.held) == 1  # the one that nobody answered
    assert fed(user, [row(n - 1, "resposta", 404, n)], now) == [(f"i{n - 1}", "falhou", 1)]
    assert expired(user, timers, now + 2) == [] and len(user.held) == 0
