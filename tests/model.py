"""Row-by-row model of the session rules, in plain Python, for random logs.

Written straight from the rules as stated in the documentation, with scans
over the whole unit, so that it shares nothing with the windowed operators.
"""

from __future__ import annotations

import math
import random

LIMIT = 12 * 3600 * 1_000_000


def priority(kind, stops, known):
    if kind == "Activity Resumed":
        return 0
    if kind in stops:
        return 2
    return 1 if kind in known else 3


def order_unit(rows, stops, known, fix=True):
    """Sort rows (dicts with us, order, kind) and add moved, seq, gap."""
    rows = [dict(r) for r in rows]
    far = 2**62
    if not fix:
        rows.sort(key=lambda r: (far if r["us"] is None else r["us"], r["order"]))
        for r in rows:
            r["moved"] = r["us"]
    else:
        for r in rows:
            r["moved"] = r["us"]
        for us in {r["us"] for r in rows if r["us"] is not None}:
            group = [r for r in rows if r["us"] == us]
            if len(group) > 1:
                group.sort(key=lambda r: (priority(r["kind"], stops, known), r["order"]))
                for i, r in enumerate(group):
                    r["moved"] = us - (i + 1)
        rows.sort(
            key=lambda r: (
                far if r["us"] is None else r["us"],
                far if r["moved"] is None else r["moved"],
                -priority(r["kind"], stops, known),
                -r["order"],
            )
        )
    last = None
    for i, r in enumerate(rows):
        r["seq"] = i + 1
        if i == 0:
            r["gap"] = 0.0
        elif r["moved"] is None or last is None:
            r["gap"] = None
        else:
            r["gap"] = (r["moved"] - last) / 1e6 / 3600.0
        last = r["moved"]
    return rows


def first_later(rows, i, accept):
    for r in rows[i + 1 :]:
        if accept(r):
            return r
    return None


def close(rows, resumed, paused, stopped, usage, same, other, limited, start_missing):
    kinds = [r["kind"] for r in rows]
    out = [dict(r) for r in rows]
    for i, r in enumerate(rows):
        if kinds[i] != resumed:
            continue
        app = r["app"]
        own = lambda x: app is not None and x["app"] == app
        s = first_later(rows, i, lambda x: own(x) and x["kind"] in same)
        o = first_later(rows, i, lambda x: not own(x) and x["kind"] in other)
        z = first_later(rows, i, lambda x: own(x) and x["kind"] == stopped)
        s = None if s is None or s["us"] is None else s
        o = None if o is None or o["us"] is None else o
        z = None if z is None or z["us"] is None else z
        stop = None
        if r["us"] is not None:
            short = (
                z["moved"] if z and z["moved"] - r["moved"] < LIMIT else None
            )
            if s and o:
                pick = s if s["us"] <= o["us"] else o
                stop = pick["moved"] if pick["moved"] - r["moved"] < LIMIT else short
            elif z:
                stop = short if limited else z["moved"]
        if stop is not None:
            out[i].update(kind=usage, start=r["moved"], stop=stop)
        else:
            out[i]["kind"] = "End of Usage Missing"
            if start_missing:
                out[i]["start"] = r["moved"]
    return [r for r in out if r["kind"] != paused]


def details(rows, custom=300):
    usage = ("App Usage", "Filtered App Usage")
    first_any = next((r["seq"] for r in rows if r["kind"] in usage), None)
    first_valid = next((r["seq"] for r in rows if r["kind"] == "App Usage"), None)
    for i, r in enumerate(rows):
        for scope, member in (("any", usage), ("valid", ("App Usage",))):
            r[scope] = [0, 0, 0, 0.0] if r["kind"] in member else None
        if r["kind"] not in usage:
            continue
        if r["seq"] == first_any:
            r["any" if r["kind"] != "App Usage" else "valid"][:2] = [1, 1]
            continue
        if r["seq"] == first_valid:
            r["valid"][:2] = [1, 1]
            continue
        for scope, member in (("any", usage), ("valid", ("App Usage",))):
            if r[scope] is None:
                continue
            back = [
                x for x in rows[:i] if x["kind"] in member and x.get("stop") is not None
            ]
            if not back or r.get("start") is None:
                continue
            p = back[-1]
            seconds = (r["start"] - p["stop"]) / 1e6
            same = r["app"] is not None and r["app"] == p["app"]
            r[scope] = [
                int(seconds > 30),
                int(seconds > custom),
                int(not same),
                float(math.floor(seconds / 3600)),
            ]
    return rows


KINDS = (
    ["Activity Resumed"] * 5
    + ["Activity Paused"] * 3
    + ["Activity Stopped", "Activity Destroyed", "Screen Non-Interactive"] * 2
    + ["Filtered App Resumed"] * 3
    + ["Filtered App Paused"] * 2
    + ["Filtered App Stopped", "Device Shutdown", "Device Startup", "Odd", None]
)


def random_log(seed, units, rows, spread_hours=3.0, apps=3, ties=0.3, bad=0.02):
    rng = random.Random(seed)
    out = []
    for u in range(units):
        us = 1_704_067_200_000_000
        for n in range(rows):
            if rng.random() > ties:
                step = rng.choice([5e6, 40e6, 400e6, rng.random() * spread_hours * 3.6e9])
                us += int(step)
            app = rng.choice([f"app{a}" for a in range(apps)] + [None])
            out.append(
                {
                    "unit": f"u{u}",
                    "order": n,
                    "us": None if rng.random() < bad else us,
                    "kind": rng.choice(KINDS),
                    "app": app,
                }
            )
    rng.shuffle(out)
    return out
