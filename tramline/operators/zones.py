"""Traffic zones: cells, features, region growing, skims, shortest paths and validation."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import geo
from tramline.operators.quantiles import exact_quantiles
from tramline.operators.storage import cut


def grid_cells(lat_min: float, lat_max: float, lng_min: float, lng_max: float, spacing_km: float, spark) -> DataFrame:
    """(row, col, lat, lng) of a grid of points every spacing_km; the step in longitude follows the latitude."""
    step = spacing_km / geo.KM_PER_DEGREE
    rows = spark.range(int((lat_max - lat_min) / step) + 1).select(F.col("id").cast("int").alias("row"), (F.lit(lat_min) + F.col("id") * step).alias("lat"))
    lng_step = F.lit(step) / F.cos(F.radians("lat"))
    cols = F.sequence(F.lit(0), F.floor((lng_max - lng_min) / lng_step).cast("int"))
    return rows.select("row", "lat", F.explode(cols).alias("col"), lng_step.alias("_s")).select("row", "col", "lat", (F.lit(lng_min) + F.col("col") * F.col("_s")).alias("lng"))


def neighbours(cells: DataFrame, k: int = 1) -> DataFrame:
    """(row, col, row2, col2): pairs of cells at most k rows and columns apart that both exist, each cell with itself too."""
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-k, k + 1) for j in range(-k, k + 1)])
    near = cells.select("row", "col", F.explode(around).alias("d")).select("row", "col", (F.col("row") + F.col("d.i")).alias("row2"), (F.col("col") + F.col("d.j")).alias("col2"))
    return near.join(cells.select(F.col("row").alias("row2"), F.col("col").alias("col2")), ["row2", "col2"])


#: Classes of tags, first match first (fixed values).
ROAD_CLASSES = {"motorway": ("motorway", "motorway_link"), "trunk": ("trunk", "trunk_link"), "primary": ("primary", "primary_link"), "secondary": ("secondary", "secondary_link"), "tertiary": ("tertiary", "tertiary_link")}


def road_class(highway: Column) -> Column:
    out = F.lit("local")
    for name, tags in reversed(ROAD_CLASSES.items()):
        out = F.when(highway.isin(*tags), name).otherwise(out)
    return out


def building_levels(levels: Column) -> Column:
    """The first number of a levels tag, else 2."""
    return F.coalesce(F.split(levels, "[,;]")[0].try_cast("int"), F.lit(2))


def robust_z(df: DataFrame, value: str, name: str, clip: float = 5.0) -> DataFrame:
    """Distance from the median over the interquartile range, within plus or minus clip; 0 where all are alike."""
    q = exact_quantiles(df, value, [0.25, 0.5, 0.75])
    if q is None or q[2] == q[0]:
        return df.withColumn(name, F.lit(0.0))
    z = (F.col(value) - F.lit(q[1])) / F.lit(q[2] - q[0])
    return df.withColumn(name, F.greatest(F.lit(-clip), F.least(F.lit(clip), z)))


def z_scores(df: DataFrame, values: list[str], clip: float = 3.0) -> DataFrame:
    """Columns z_<value>: population z-scores within plus or minus clip; constant columns give 0."""
    one = df.agg(*[F.avg(v).alias(f"m_{v}") for v in values], *[F.stddev_pop(v).alias(f"s_{v}") for v in values]).first()
    z = lambda v: F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col(v) - one[f"m_{v}"]) / one[f"s_{v}"])) if one[f"s_{v}"] else F.lit(0.0)
    return df.withColumns({f"z_{v}": z(v) for v in values})


def entropy(counts: list[Column]) -> Column:
    """Shannon entropy of shares, natural log; 0 for nothing."""
    total = sum(counts[1:], counts[0])
    share = lambda c: c / F.nullif(total, F.lit(0))
    term = lambda c: F.when(c > 0, -share(c) * F.log(share(c))).otherwise(0.0)
    return sum((term(c) for c in counts), F.lit(0.0))


def poi_profile(pois: DataFrame, keys: list[str], types: list[str], weights: dict[str, float]) -> DataFrame:
    """Counts by type (poi_<type>), total, weighted intensity and entropy of the points of each cell."""
    wide = pois.groupBy(*keys).pivot("poi_type", types).count().fillna(0, types)
    wide = wide.select(*keys, *[F.col(f"`{t}`").cast("long").alias(f"poi_{t}") for t in types])
    cols = [F.col(f"poi_{t}") for t in types]
    weighted = sum((F.col(f"poi_{t}") * weights.get(t, 1.0) for t in types), F.lit(0.0))
    return wide.withColumns({"total_pois": sum(cols[1:], cols[0]), "intensity": weighted, "poi_entropy": entropy(cols)})


def land_use(employment: Column, population: Column, commercial: float = 2000.0, mixed: float = 800.0, residential: float = 1000.0) -> Column:
    """First match of commercial, mixed, residential, low_density and vacant."""
    return F.when(employment >= commercial, "commercial").when((employment >= mixed) & (population >= residential), "mixed").when(population >= residential, "residential").when(population > 0, "low_density").otherwise("vacant")


def grow_regions(cells: DataFrame, edges: DataFrame, area: str, target: float, low: float = 0.6, high: float = 1.4, cap: float = 1.8, max_distance: float = 4.0) -> DataFrame:
    """(area, cell, zone): zones grown from the cells with most employment towards a target population.

    cells has area, cell, population, employment, barrier, and z columns; edges has area, a and b.
    Growth is sequential within a study area, so each area is one group, of bounded extent.
    """
    z_cols = [c for c in cells.columns if c.startswith("z_")]

    def run(key, cells_pdf: pd.DataFrame, edges_pdf: pd.DataFrame) -> pd.DataFrame:
        data = cells_pdf.sort_values("cell").reset_index(drop=True)
        pos = {c: i for i, c in enumerate(data["cell"])}
        near: list[set[int]] = [set() for _ in pos]
        for a, b in zip(edges_pdf["a"], edges_pdf["b"]):
            if a in pos and b in pos and a != b:
                near[pos[a]].add(pos[b])
                near[pos[b]].add(pos[a])
        people, side = data["population"].fillna(0).to_numpy(), data["barrier"].to_numpy()
        z = data[z_cols].fillna(0).to_numpy() if z_cols else np.zeros((len(data), 1))
        zone = np.full(len(data), -1)
        nth = 0
        for seed in sorted(range(len(data)), key=lambda i: (-float(data["employment"].fillna(0)[i]), data["cell"][i])):
            if zone[seed] >= 0:
                continue
            zone[seed], total = nth, people[seed]
            heap = [(float(np.linalg.norm(z[j] - z[seed])), j) for j in near[seed]]
            heapq.heapify(heap)
            while heap and total < target * low or heap and total < target:
                far, j = heapq.heappop(heap)
                if zone[j] >= 0 or side[j] != side[seed] or far > max_distance or total + people[j] > target * (high if total >= target * low else cap):
                    continue
                zone[j], total = nth, total + people[j]
                for k in near[j]:
                    if zone[k] < 0:
                        heapq.heappush(heap, (float(np.linalg.norm(z[k] - z[seed])), k))
            nth += 1
        return pd.DataFrame({area: [key[0]] * len(data), "cell": data["cell"], "zone": zone})

    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    links = edges.select(*[F.col(c).alias(c) for c in edges.columns])  # apart from cells, if both come from one table
    return cells.groupBy(area).cogroup(links.groupBy(area)).applyInPandas(run, f"`{area}` {kinds[area]}, cell {kinds['cell']}, zone int")


def skim(zones: DataFrame, zone: str = "zone_id", most: int = 20_000) -> DataFrame:
    """(origin, destination, distance_km) for all ordered pairs of zone centroids, up to `most` zones.

    The all-pairs matrix is the result asked for. The list of zones, bounded by `most`, is sent to all
    tasks, and each origin explodes it.
    """
    n = zones.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} zones")
    place = F.struct(F.col(zone).alias("z"), "lat", "lng")
    listed = zones.groupBy().agg(F.collect_list(place).alias("_all")).withColumn("_k", F.lit(1))
    origins = zones.repartition(zone).select(place.alias("o"), F.lit(1).alias("_k"))
    pairs = origins.join(F.broadcast(listed), "_k").select("o", F.explode("_all").alias("d"))
    d = geo.haversine_m(F.col("o.lat"), F.col("o.lng"), F.col("d.lat"), F.col("d.lng")) / 1000
    return pairs.select(F.col("o.z").alias("origin"), F.col("d.z").alias("destination"), d.alias("distance_km"))


def travel_time_min(km: Column, v_max: float = 45.0, d0: float = 5.0, v_min: float = 12.0) -> Column:
    """Minutes at a speed that rises with distance, v_max (1 - exp(-d / d0)), not under v_min; infinite stays infinite."""
    v = F.greatest(F.lit(v_min), v_max * (1 - F.exp(-km / d0)))
    return F.when(km == float("inf"), float("inf")).otherwise(km / v * 60)


def generalized_cost(minutes: Column, km: Column, value_of_time: float = 0.5, cost_per_km: float = 0.1) -> Column:
    return minutes * value_of_time + km * cost_per_km


def intra_zonal_s(area_km2: Column, kmh: float = 20.0) -> Column:
    """Seconds of a typical trip within a zone: 0.52 of the root of its area at kmh; 300 if unknown."""
    return F.coalesce(0.52 * F.sqrt(area_km2) / kmh * 3600, F.lit(300.0))


def _paths(graph: dict, origin) -> pd.DataFrame:
    """(origin, node, cost) of the nodes that one origin reaches."""
    best, heap = {origin: 0.0}, [(0.0, origin)]
    while heap:
        d, u = heapq.heappop(heap)
        if d > best[u]:
            continue
        for v, c in graph.get(u, ()):
            if d + c < best.get(v, math.inf):
                best[v] = d + c
                heapq.heappush(heap, (d + c, v))
    return pd.DataFrame({"origin": origin, "node": list(best), "cost": list(best.values())})


def _graph(rows: pd.DataFrame) -> dict:
    graph: dict = {}
    for a, b, c in rows[["a", "b", "cost"]].itertuples(index=False):
        graph.setdefault(a, []).append((b, c))
        graph.setdefault(b, []).append((a, c))
    return graph


def shortest_paths(edges: DataFrame, origins: DataFrame, small_edges: int = 500_000) -> DataFrame:
    """(origin, node, cost) from each origin to all nodes it reaches, over undirected edges (a, b, cost).

    A network of up to small_edges edges is sent to all tasks, and origins are spread over them. A
    larger one is split into its connected components, each of which meets its origins in one group.
    """
    spark = edges.sparkSession
    usable = edges.select("a", "b", "cost").where("cost >= 0")
    starts = origins.select(F.col(origins.columns[0]).alias("origin")).distinct()
    kind = edges.schema["a"].dataType.simpleString()
    schema = f"origin {kind}, node {kind}, cost double"
    if usable.limit(small_edges + 1).count() <= small_edges:
        sent = spark.sparkContext.broadcast(_graph(usable.toPandas()))

        def run(batches):
            for pdf in batches:
                for origin in pdf["origin"]:
                    yield _paths(sent.value, origin)

        return starts.mapInPandas(run, schema)
    nodes = usable.select(F.col("a").alias("node")).union(usable.select("b")).union(starts).distinct()
    parts = connected(usable, nodes, "node")
    of_edges = usable.join(parts.withColumnRenamed("node", "a"), "a").select(F.col("component").alias("component"), "a", "b", "cost")
    of_starts = starts.join(parts.withColumnRenamed("node", "origin"), "origin").select(F.col("component").alias("component"), "origin")

    def group(some: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        graph = _graph(rows)
        found = [_paths(graph, o) for o in some["origin"]]
        return pd.concat(found) if found else pd.DataFrame({"origin": [], "node": [], "cost": []})

    return of_starts.groupBy("component").cogroup(of_edges.groupBy("component")).applyInPandas(group, schema)


def connected(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """(node, component), the smallest node reachable; by label spreading over the edges (a, b) until nothing changes."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct()
    label = nodes.select(F.col(node).alias("node"), F.col(node).alias("component"))
    before = None
    while True:
        spread = label.join(both, F.col("node") == F.col("a")).groupBy(F.col("b").alias("node")).agg(F.min("component").alias("m"))
        hop = label.join(spread, "node", "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"))
        up = hop.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        label = hop.join(up, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("_c", "component").alias("component"))
        label = cut(label)
        mark = label.agg(F.sum(F.xxhash64("node", "component").cast("decimal(38,0)"))).first()[0]
        if mark == before:
            return label
        before = mark


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners (lat, lng), counter-clockwise by longitude and latitude; fewer than three distinct points as they are."""
    pts = sorted({(lng, lat) for lat, lng in points})
    if len(pts) < 3:
        return [(lat, lng) for lng, lat in pts]

    def half(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    lower, upper = half(pts), half(reversed(pts))
    return [(lat, lng) for lng, lat in lower[:-1] + upper[:-1]]


def hulls(points: DataFrame, key: str) -> DataFrame:
    """(key, n_points, hull): hull corners as array<struct<lat, lng>>. Hulls of parts come first, so that a large group is met in pieces."""
    kind = points.schema[key].dataType.simpleString()
    corners = "array<struct<lat:double,lng:double>>"

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = convex_hull(list(zip(pdf["lat"], pdf["lng"])))
        return pd.DataFrame({key: pdf[key].iloc[0], "lat": [p[0] for p in ring], "lng": [p[1] for p in ring], "n": [len(pdf)] + [0] * (len(ring) - 1)})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = convex_hull(list(zip(pdf["lat"], pdf["lng"])))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "n_points": [int(pdf["n"].sum())], "hull": [[{"lat": a, "lng": b} for a, b in ring]]})

    known = points.where(F.col("lat").isNotNull() & F.col("lng").isNotNull() & F.col(key).isNotNull()).select(key, "lat", "lng", F.pmod(F.xxhash64("lat", "lng"), F.lit(32)).alias("_salt"))
    parts = known.groupBy(key, "_salt").applyInPandas(part, f"`{key}` {kind}, lat double, lng double, n long")
    return parts.groupBy(key).applyInPandas(whole, f"`{key}` {kind}, n_points long, hull {corners}")


def weighted_centroids(points: DataFrame, key: str, weight: str) -> DataFrame:
    """Weighted mean place by key; the plain mean where the weights sum to nothing."""
    w = F.sum(F.when(F.col("lat").isNotNull(), F.col(weight)))
    mean = lambda c: F.coalesce(F.sum(F.col(c) * F.col(weight)) / F.nullif(w, F.lit(0.0)), F.avg(c))
    return points.groupBy(key).agg(mean("lat").alias("lat"), mean("lng").alias("lng"))


def validate_zones(zones: DataFrame, population: tuple[float, float], area: tuple[float, float], max_cv: float) -> DataFrame:
    """One row: zones outside the bounds, variation of population, mean compactness, and the verdict."""
    bad_p = ~F.col("population").between(*population)
    bad_a = ~F.col("area_km2").between(*area)
    compact = 4 * math.pi * F.col("area_km2") / F.nullif(F.col("perimeter_km") * F.col("perimeter_km"), F.lit(0.0))
    out = zones.agg(
        F.count(F.lit(1)).alias("n_zones"), F.count_if(bad_p).alias("n_bad_population"), F.count_if(bad_a).alias("n_bad_area"), (F.stddev_samp("population") / F.nullif(F.avg("population"), F.lit(0.0))).alias("population_cv"), F.avg(compact).alias("mean_compactness")
    )
    return out.withColumn("is_valid", (F.col("n_bad_population") == 0) & (F.col("n_bad_area") == 0) & (F.coalesce("population_cv", F.lit(float("inf"))) <= max_cv))


def routing_connectivity(skims: DataFrame, sentinel_km: float = 9000.0) -> DataFrame:
    """One row: unreachable pairs (null, infinite or beyond the sentinel) and the zones in them."""
    bad = F.col("distance_km").isNull() | F.isnan("distance_km") | (F.col("distance_km") >= sentinel_km)
    pairs = skims.agg(F.count_if(bad).alias("n_unreachable"), F.count(F.lit(1)).alias("n_pairs"))
    touched = skims.where(bad).select(F.explode(F.array("origin", "destination")).alias("z")).agg(F.countDistinct("z").alias("n_zones_involved"))
    return pairs.join(touched, F.lit(True)).withColumn("is_connected", F.col("n_unreachable") == 0)


def zone_summary(cells: DataFrame, zone: str = "zone") -> DataFrame:
    """Cells, sums, means and the commonest land use (ties to the lesser) by zone."""
    return cells.groupBy(zone).agg(F.count(F.lit(1)).alias("n_cells"), F.sum("population").alias("population"), F.avg("employment").alias("mean_employment"), F.mode("land_use", True).alias("land_use"), F.bool_or("is_special").alias("is_special"))


def with_shares(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """df with each row's share of its group's sum."""
    return df.withColumn("share", F.col(value) / F.nullif(F.sum(value).over(Window.partitionBy(*keys)), F.lit(0)))


def generation_summary(zones: DataFrame) -> DataFrame:
    """One row: number, total and mean area, population and employment, zones of the centre, and the zones of each land use as a map."""
    sums = {"area_km2": "area", "population": "population", "employment": "employment"}
    one = zones.agg(F.count(F.lit(1)).alias("n_zones"), *[F.sum(c).alias(f"total_{n}") for c, n in sums.items()], *[F.avg(c).alias(f"avg_{n}") for c, n in sums.items()], F.count_if("is_cbd").alias("n_cbd"))
    uses = zones.groupBy("land_use").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("land_use", "n")))).alias("land_uses"))
    return one.withColumn("_k", F.lit(1)).join(uses.withColumn("_k", F.lit(1)), "_k").drop("_k")
