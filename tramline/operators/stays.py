"""Stay points: sequential per-user scans, run as grouped Arrow functions."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

STAYS = "imsi string, stay_id string, lat double, lng double, cell_id string, first_seen timestamp_ntz, last_seen timestamp_ntz, duration_hours double, visit_count int, observation_count int"


def _metres(a, b) -> float:
    lat1, lng1, lat2, lng2 = map(math.radians, (a[0], a[1], b[0], b[1]))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lng2 - lng1) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1.0, math.sqrt(h)))


def _near(p, q, radius_m: float) -> bool:
    if None not in (p[0], p[1], q[0], q[1]):
        return _metres(p, q) <= radius_m
    return p[2] == q[2] if p[2] and q[2] else True


def _candidates(points: list[tuple], radius_m: float, least_s: float) -> list[list[tuple]]:
    """Runs of points near the first of each, of at least least_s seconds."""
    out, run = [], []
    for p in points:
        if run and _near(run[0], p, radius_m):
            run.append(p)
            continue
        if run and run[-1][3] - run[0][3] >= least_s:
            out.append(run)
        run = [p]
    if run and run[-1][3] - run[0][3] >= least_s:
        out.append(run)
    return out


def _by_cell(points: list[tuple]) -> list[list[tuple]]:
    """The records of each cell; without cells, all that have a place."""
    cells: dict[str, list[tuple]] = {}
    for p in points:
        if p[2] is not None:
            cells.setdefault(p[2], []).append(p)
    located = [p for p in points if p[0] is not None and p[1] is not None]
    return list(cells.values()) or ([located] if located else [])


def _clusters(places: list[tuple[float, float]], eps_m: float) -> list[int]:
    """Connected places within eps_m, through grid cells of that size."""
    cell = eps_m / 111_320
    grid: dict[tuple[int, int], list[int]] = {}
    label = list(range(len(places)))

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i, (lat, lng) in enumerate(places):
        x, y = int(lat // cell), int(lng * math.cos(math.radians(lat)) // cell)
        for a in (x - 1, x, x + 1):
            for b in (y - 1, y, y + 1):
                for j in grid.get((a, b), []):
                    if root(i) != root(j) and _metres(places[i], places[j]) <= eps_m:
                        label[max(root(i), root(j))] = min(root(i), root(j))
        grid.setdefault((x, y), []).append(i)
    return [root(i) for i in range(len(places))]


def detect_stays(obs: DataFrame, radius_m: float = 500.0, min_minutes: float = 30.0, merge_m: float = 300.0, min_visits: int = 1) -> DataFrame:
    """STAYS of each user, from imsi, ts, lat, lng and cell_id.

    A candidate is a run of observations within radius_m of its first, of min_minutes or more; a
    user with none is scanned again at 1.5 times the radius, then half the time, then both; one
    with none even then has a stay at each cell, or, without cells, one of all located records,
    which count as min_visits visits.
    Candidates whose centres connect within merge_m are one stay; those with fewer visits go.
    A user's records form one group, as the scan is sequential; keep_users() bounds them.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["ts"]).sort_values(["ts", "cell_id"], kind="stable")
        clock = pdf["ts"].astype("int64").to_numpy() / {"ns": 1e9, "us": 1e6, "ms": 1e3, "s": 1}[np.datetime_data(pdf["ts"].dtype)[0]]
        none = lambda s: [None if pd.isna(v) else v for v in s]
        points = list(zip(none(pdf["lat"]), none(pdf["lng"]), none(pdf["cell_id"]), clock))
        found = []
        for r, t in ((1, 1), (1.5, 1), (1, 0.5), (1.5, 0.5)):
            if found := _candidates(points, radius_m * r, min_minutes * 60 * t):
                break
        sparse = not found
        if sparse:
            found = _by_cell(points)
        rows = []
        for c in found:
            located = [(p[0], p[1]) for p in c if p[0] is not None and p[1] is not None]
            cells = Counter(p[2] for p in c if p[2] is not None)
            cell = min(cells, key=lambda k: (-cells[k], k)) if cells else None
            centre = tuple(np.mean(located, axis=0)) if located else (None, None)
            rows.append((*centre, cell, c[0][3], c[-1][3], len(c)))
        placed = [i for i, r in enumerate(rows) if r[0] is not None]
        group = {i: ("s", i) if sparse else ("p", g) for i, g in zip(placed, _clusters([rows[i][:2] for i in placed], merge_m))}
        members: dict = {}
        for i, r in enumerate(rows):
            members.setdefault(group.get(i, ("c", r[2])), []).append(r)
        out = []
        for part in members.values():
            if len(part) < min_visits and not sparse:
                continue
            weights = [r[5] for r in part]
            lat = float(np.average([r[0] for r in part], weights=weights)) if part[0][0] is not None else None
            lng = float(np.average([r[1] for r in part], weights=weights)) if part[0][1] is not None else None
            cells = Counter(r[2] for r in part if r[2] is not None)
            cell = min(cells, key=lambda k: (-cells[k], k)) if cells else None
            out.append((lat, lng, cell, min(r[3] for r in part), max(r[4] for r in part), sum(r[4] - r[3] for r in part) / 3600, max(min_visits, 1) if sparse else len(part), sum(weights)))
        out.sort(key=lambda s: s[3])
        user = str(pdf["imsi"].iloc[0]) if len(pdf) else ""
        stamp = lambda s: pd.Timestamp(round(s * 1e6), unit="us")
        return pd.DataFrame(
            [(user, f"{user}_S{i:03d}", s[0], s[1], s[2], stamp(s[3]), stamp(s[4]), s[5], s[6], s[7]) for i, s in enumerate(out, 1)],
            columns=["imsi", "stay_id", "lat", "lng", "cell_id", "first_seen", "last_seen", "duration_hours", "visit_count", "observation_count"],
        )

    slim = obs.selectExpr("cast(imsi as string) imsi", "cast(ts as timestamp_ntz) ts", "cast(lat as double) lat", "cast(lng as double) lng", "cast(cell_id as string) cell_id")
    return slim.where("imsi is not null").groupBy("imsi").applyInPandas(run, STAYS)


def assign_to_stays(obs: DataFrame, stays: DataFrame, row_id: str = "id", max_m: float = 1000.0) -> DataFrame:
    """obs with stay_id: the user's first stay at the same cell, else the nearest within max_m, else null."""
    from pyspark.sql import functions as F

    from tramline.functions import geo

    s = stays.select(F.col("imsi").alias("_u"), "stay_id", F.col("cell_id").alias("_cell"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    pairs = obs.select(row_id, "imsi", "cell_id", "lat", "lng").join(s, F.col("imsi").cast("string") == F.col("_u"))
    d = geo.haversine_m(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng"))
    same = F.min(F.when(F.col("cell_id").cast("string") == F.col("_cell"), F.col("stay_id")))
    near = F.min(F.when(d <= max_m, F.struct(d.alias("d"), F.col("stay_id").alias("s"))))
    best = pairs.groupBy(row_id).agg(same.alias("_same"), near.alias("_near")).select(F.col(row_id).alias("_id"), F.coalesce("_same", "_near.s").alias("stay_id"))
    return obs.join(best, F.col(row_id) == F.col("_id"), "left").drop("_id")
