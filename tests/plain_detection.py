"""Conflict detection in plain Python, a pair at a time: what skylane.plans.detection is held against.

A flight is a dict of flight_id, lat, lon, level, knots, track, fpm, ts and route; a plan is a list of (lat, lon, tas, level).
"""

import math

EARTH, NM, LEVEL_KM, HORIZON, LOOK_AHEAD = 6371.0, 1.852, 0.03048, 0.25, 0.5


def nm_between(a, b):
    (p, q), (s, t) = ([math.radians(x) for x in pair] for pair in ((a[0], b[0]), (a[1], b[1])))
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin((t - s) / 2) ** 2
    return 2 * EARTH * math.atan2(math.sqrt(h), math.sqrt(1 - h)) / NM


def heading(a, b):
    p, q, d = math.radians(a[0]), math.radians(b[0]), math.radians(b[1] - a[1])
    return int((math.degrees(math.atan2(math.sin(d) * math.cos(q), math.cos(p) * math.sin(q) - math.sin(p) * math.cos(q) * math.cos(d))) + 360) % 360)


def velocity(f):
    a = math.radians(f["track"])
    return (f["knots"] * math.sin(a), f["knots"] * math.cos(a), f["fpm"] * 60 * 0.3048 / 1852)


def offset(f, nm):
    """Where f would be if it were displaced by nautical miles east, north and up, on a flat earth."""
    e, n, u = (x * NM for x in nm)
    return (f["lat"] + math.degrees(n / EARTH), f["lon"] + math.degrees(e / (EARTH * math.cos(math.radians(f["lat"])))), f["level"] + u / LEVEL_KM)


def seen_from(f, g):
    """East, north and up of g in NM."""
    xyz = []
    for x in (f, g):
        r, p, q = EARTH + x["level"] * LEVEL_KM, math.radians(x["lat"]), math.radians(x["lon"])
        xyz.append((r * math.cos(p) * math.cos(q), r * math.cos(p) * math.sin(q), r * math.sin(p)))
    d = [v - u for u, v in zip(*xyz, strict=True)]
    p, q = math.radians(f["lat"]), math.radians(f["lon"])
    axes = ((-math.sin(q), math.cos(q), 0), (-math.sin(p) * math.cos(q), -math.sin(p) * math.sin(q), math.cos(p)), (math.cos(p) * math.cos(q), math.cos(p) * math.sin(q), math.sin(p)))
    e, n, u = (sum(x * y for x, y in zip(axis, d, strict=True)) for axis in axes)
    return (e / NM, n / NM, (u + (e * e + n * n) / (2 * EARTH)) / NM)


def within(r, v):
    """First and last hour inside the cylinder of 5 NM and 1000 ft, or None."""
    a, b, c = v[0] ** 2 + v[1] ** 2, 2 * (r[0] * v[0] + r[1] * v[1]), r[0] ** 2 + r[1] ** 2 - 25
    if a < 1e-10:
        if c >= 0:
            return None
        flat = (-math.inf, math.inf)
    elif b * b < 4 * a * c:
        return None
    else:
        root = math.sqrt(b * b - 4 * a * c)
        flat = ((-b - root) / (2 * a), (-b + root) / (2 * a))
    high = 1000 * 0.3048 / 1852
    if abs(v[2]) >= 1e-10:
        tall = sorted(((high - r[2]) / v[2], (-high - r[2]) / v[2]))
    elif abs(r[2]) < high:
        tall = (-math.inf, math.inf)
    else:
        return None
    first, last = max(flat[0], tall[0]), min(flat[1], tall[1])
    return (first, last) if first <= last and last >= 0 else None


def closest(f, g, later, horizon):
    """The conflict of two flights on straight lines, its times later by some hours, or None."""
    r, a, b = seen_from(f, g), velocity(f), velocity(g)
    v = [y - x for x, y in zip(a, b, strict=True)]
    vv = sum(x * x for x in v)
    if vv < 1e-10:
        return None
    t = -sum(x * y for x, y in zip(r, v, strict=True)) / vv
    span = within(r, v)
    if t < -0.75 / 60 or span is None or math.inf in map(abs, span):
        return None
    d = [x + y * t for x, y in zip(r, v, strict=True)]
    far = math.hypot(*d[:2])
    if span[0] + later > horizon or far >= 5 or abs(d[2]) >= 950 * 0.3048 / 1852 or t + later < 0:
        return None
    at = lambda start, speed, h: offset(f, [x + y * h for x, y in zip(start, speed, strict=True)])
    zero = (0, 0, 0)
    middle = offset(f, [x * t + y / 2 for x, y in zip(a, d, strict=True)])
    return (far, d[2], span[0] + later, span[1] + later, t + later, *at(zero, a, span[0]), *at(zero, a, span[1]), *at(r, b, span[0]), *at(r, b, span[1]), *middle)


def next_index(f, plan):
    for i, (a, b) in enumerate(zip(plan, plan[1:], strict=False)):
        c = math.cos(math.radians((a[0] + b[0]) / 2))
        u, v = (b[0] - a[0], (b[1] - a[1]) * c), (f["lat"] - a[0], (f["lon"] - a[1]) * c)
        size = u[0] ** 2 + u[1] ** 2
        share = (u[0] * v[0] + u[1] * v[1]) / size if size else 1.1
        if share < 1:
            return i + 1 if share >= 0 else i
    return len(plan) - 1


def on_leg(a, b, share, hours):
    """lat, lon, level, track and feet per hour at a share of a leg between (lat, lon, level)."""
    rate = (b[2] - a[2]) * 100 / hours if hours > 1e-12 else 0.0
    return {"lat": a[0] + (b[0] - a[0]) * share, "lon": a[1] + (b[1] - a[1]) * share, "level": round(a[2] + (b[2] - a[2]) * share), "track": heading(a, b), "fpm": rate}


def moved(f, plan, hours):
    """f some hours later: along its plan if it has a route and one, else straight on."""
    if hours <= 0:
        return f
    if not (f["route"] and plan):
        lat, lon, level = offset(f, [x * hours for x in velocity(f)])
        return f | {"lat": lat, "lon": lon, "level": round(level)}
    left, here = hours * f["knots"], (f["lat"], f["lon"], f["level"])
    for lat, lon, _, level in plan[next_index(f, plan) :]:
        there = (lat, lon, level)
        leg = nm_between(here, there)
        if leg >= 1e-12 and left < leg:
            return f | on_leg(here, there, left / leg, leg / f["knots"])
        left -= leg
        before, here = here, there
    return f | {"lat": here[0], "lon": here[1], "level": here[2], "track": heading(before, here), "fpm": 0.0}


def ahead(f, plan):
    """The flight and its waypoints within half an hour: (lat, lon, level, tas, hours by plan, hours at ground speed)."""
    points, way, by_plan = [(f["lat"], f["lon"], f["level"], f["knots"], 0.0, 0.0)], 0.0, 0.0
    planned = instead = None
    for lat, lon, tas, level in plan[next_index(f, plan) :]:
        leg = nm_between(points[-1], (lat, lon))
        way, by_plan = way + leg, by_plan + leg / tas
        if planned is None:
            planned, guess = level, f["level"]
            if abs(f["fpm"]) >= 100:
                guess = f["level"] + f["fpm"] * 0.6 * by_plan
                if (level - f["level"]) * f["fpm"] > 0:
                    guess = min(guess, level) if f["fpm"] > 0 else max(guess, level)
                guess = round(guess)
            instead = guess if abs(guess - level) > 4 else None
        elif level != planned:
            instead = None
        points.append((lat, lon, level if instead is None else instead, tas, by_plan, way / f["knots"]))
        if way > f["knots"] * LOOK_AHEAD:
            break
    return points


def apart(p, q):
    """Whether the boxes of two lists of points, with margins, leave a gap."""
    return any(max(x[i] for x in a) + margin < min(x[i] for x in b) - margin for a, b in ((p, q), (q, p)) for i, margin in ((0, 0.25), (1, 0.25), (2, 10)))


def conflicts(f, g, plans):
    """All conflicts of a pair."""
    if not f["knots"] or not g["knots"]:
        return []
    last = max(f["ts"], g["ts"])
    if abs((f["ts"] - g["ts"]).total_seconds()) > 10:
        f, g = (moved(x, plans.get(x["flight_id"], []), (last - x["ts"]).total_seconds() / 3600) for x in (f, g))
    if f["route"] is None or g["route"] is None:
        found = closest(f, g, 0.0, HORIZON)
        return [found] if found else []
    own = [plans.get(x["flight_id"], []) for x in (f, g)]
    if min(map(len, own)) < 2:
        return []
    one, two = ahead(f, own[0]), ahead(g, own[1])
    out = []
    if apart(one, two):
        return out
    for a in zip(one, one[1:], strict=False):
        for b in zip(two, two[1:], strict=False):
            if apart(a, b) or a[1][5] < b[0][5] or a[0][5] > b[1][5]:
                continue
            start, end = max(a[0][5], b[0][5]), min(a[1][5], b[1][5])
            states = []
            for p, q in (a, b):
                hours = q[5] - p[5] + 0.0001
                states.append({"knots": p[3]} | on_leg(p, q, (start - p[5]) / hours, hours))
            found = closest(*states, min(a[0][4], b[0][4]), min(end - start, HORIZON))
            out += [found] if found else []
    return out
