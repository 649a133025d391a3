import datetime as dt

import pytest

from tripmarts.adapter import table
from tripmarts.plans import events as E


def brute(hourly, events, zones, cross):
    """Event lift by plain loops over the hourly table."""
    ev_dates = {e["date"] for e in events}
    days = {h[0] for h in hourly}
    rows = list(hourly)
    if cross:
        rows += [(d - dt.timedelta(days=1), hr + 24, z, p, q) for d, hr, z, p, q in hourly]
    out = {}
    for e in events:
        if e["date"] not in days:
            continue
        for w, (a, b) in E.WINDOWS.items():
            per_day = {}
            for d, hr, z, p, q in rows:
                if z in zones[e["venue_id"]] and e["start_hour"] + a <= hr < e["start_hour"] + b and d.weekday() == e["date"].weekday():
                    s = per_day.setdefault(d, [0, 0])
                    s[0] += p
                    s[1] += q
            base = [v for d, v in per_day.items() if d == e["date"] or d not in ev_dates]
            own = per_day.get(e["date"], [0, 0])
            for i, s in enumerate(("pu", "do")):
                mean = max(sum(v[i] for v in base) / len(base), 1.0) if base else 1.0
                out[(e["date"], e["title"], f"{w}_{s}_lift_pct")] = 100 * (own[i] / mean - 1)
    return out


@pytest.mark.parametrize("cross", [False, True])
def test_event_impact_against_loops(spark, sf, cross):
    trips, venues, cal = (table(spark, sf, n) for n in ("fhvhv_trips", "venues", "event_calendar"))
    vz = E.venue_zones(venues)
    zones = {}
    for r in vz.collect():
        zones.setdefault(r["venue_id"], set()).add(r["zone"])
    hourly = [(r["d"], r["hr"], r["zone"], r["pu_trips"], r["do_trips"]) for r in E.zone_hourly(trips, vz).collect()]
    want = brute(hourly, [r.asDict() for r in cal.collect()], zones, cross)
    got = {}
    for r in E.event_impact(cal, venues, trips, cross_midnight=cross).collect():
        for c in r.asDict():
            if c.endswith("_lift_pct"):
                got[(r["date"], r["title"], c)] = r[c]
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
