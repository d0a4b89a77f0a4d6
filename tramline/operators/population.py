"""Population and demand models: proportional fitting, gravity, regression and departure sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.operators.storage import cut


def fit_margins(seed: DataFrame, rows: DataFrame, cols: DataFrame, rounds: int = 20) -> DataFrame:
    """Iterative proportional fitting: seed (origin, destination, flow) scaled in turn to rows (origin, total) and cols (destination, total).

    Factors stay beside the seed; only margins are aggregated in a round, and each round's factors
    are small tables joined by key.
    """
    a = rows.select("origin", F.col("total").cast("double").alias("_a"))
    b = cols.select("destination", F.col("total").cast("double").alias("_b"))
    base = seed.join(a, "origin").join(b, "destination").where("flow > 0")
    u = base.select("origin").distinct().withColumn("_u", F.lit(1.0))
    v = base.select("destination").distinct().withColumn("_v", F.lit(1.0))
    for _ in range(rounds):
        u = base.join(v, "destination").groupBy("origin").agg((F.first("_a") / F.sum(F.col("flow") * F.col("_v"))).alias("_u"))
        v = base.join(u, "origin").groupBy("destination").agg((F.first("_b") / F.sum(F.col("flow") * F.col("_u"))).alias("_v"))
        u, v = cut(u), cut(v)
    return base.join(u, "origin").join(v, "destination").select("origin", "destination", (F.col("flow") * F.col("_u") * F.col("_v")).alias("flow"))


def gravity(pairs: DataFrame, mass_o: str, mass_d: str, km: str, power: float = 2.0) -> DataFrame:
    """pairs with attraction: product of masses over distance to a power, distance at least 100 m."""
    return pairs.withColumn("attraction", F.col(mass_o) * F.col(mass_d) / F.pow(F.greatest(F.col(km), F.lit(0.1)), F.lit(power)))


def building_population(area_m2: Column, levels: Column, m2_per_person: float = 30.0, occupancy: float = 0.9, share: float = 1.0) -> Column:
    """People in a building from floor space."""
    return area_m2 * levels / m2_per_person * occupancy * share


def poisson_glm(df: DataFrame, target: str, features: list[str], ridge: float = 0.0):
    """A fitted Poisson regression with a log link; rows with a null feature are left out by the caller."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    vector = VectorAssembler(inputCols=features, outputCol="_x")
    return vector, GeneralizedLinearRegression(family="poisson", link="log", featuresCol="_x", labelCol=target, regParam=ridge).fit(vector.transform(df))


def boosted_trees(df: DataFrame, target: str, features: list[str], rounds: int = 20, depth: int = 5, seed: int = 42):
    """Fitted gradient-boosted regression trees."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    vector = VectorAssembler(inputCols=features, outputCol="_x")
    return vector, GBTRegressor(featuresCol="_x", labelCol=target, maxIter=rounds, maxDepth=depth, seed=seed).fit(vector.transform(df))


def uniform(row_id: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the row's id and the salt alone, so that reruns agree."""
    return F.pmod(F.xxhash64(row_id, F.lit(salt)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def departure(first: Column, last: Column, row_id: Column, how: str = "uniform") -> Column:
    """A departure between two sightings: their midpoint, or a place that row_id draws."""
    micros = F.timestamp_diff("MICROSECOND", first, last)
    share = F.lit(0.5) if how == "midpoint" else uniform(row_id, "departure")
    return F.timestamp_add("MICROSECOND", F.floor(micros * share).cast("long"), first)


def partial_route(stops: Column, row_id: Column, keep: float = 0.6, least: int = 3) -> Column:
    """An ordered part of a route as an observer might see it: each stop by chance, at least `least` of them (the likeliest)."""
    drawn = F.transform(stops, lambda s, i: F.struct(uniform(F.concat_ws(":", row_id.cast("string"), i.cast("string")), "route").alias("u"), i.alias("i"), s.alias("s")))
    n = F.greatest(F.lit(least), F.round(F.size(stops) * keep)).cast("int")
    return F.transform(F.array_sort(F.transform(F.slice(F.array_sort(drawn), 1, F.least(n, F.size(stops))), lambda x: F.struct(x["i"], x["s"]))), lambda x: x["s"])


def noisy_gps(track: DataFrame, row_id: str, sigma_m: float = 10.0, dropout: float = 0.1) -> DataFrame:
    """track with places moved by normal noise and rows dropped, both drawn from the row's id."""
    u, v = F.greatest(F.lit(1e-12), uniform(F.col(row_id), "noise-a")), uniform(F.col(row_id), "noise-b")
    size = F.sqrt(-2 * F.log(u)) * sigma_m / 111_320
    turn = 2 * 3.141592653589793 * v
    kept = track.where(uniform(F.col(row_id), "drop") >= dropout)
    return kept.withColumns({"lat": F.col("lat") + size * F.cos(turn), "lng": F.col("lng") + size * F.sin(turn) / F.cos(F.radians("lat"))})


def laplacian(edges: DataFrame) -> DataFrame:
    """(a, b, weight): the symmetric normalised adjacency of weighted undirected edges (a, b, weight) with a loop at each node."""
    both = edges.select("a", "b", "weight").union(edges.select(F.col("b"), F.col("a"), "weight"))
    nodes = both.select("a").distinct()
    every = both.union(nodes.select("a", F.col("a").alias("b"), F.lit(1.0)))
    degree = every.groupBy("a").agg(F.sum("weight").alias("d"))
    joined = every.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("e")), "b")
    return joined.select("a", "b", (F.col("weight") / F.sqrt(F.col("d") * F.col("e"))).alias("weight"))


class CountModel:
    """A fitted negative-binomial regression with a log link: coefficients (the first constant) and fit statistics."""

    def __init__(self, features: list[str], coefficients: list[float], alpha: float, stats: dict[str, float]):
        self.features, self.coefficients, self.alpha, self.stats = features, coefficients, alpha, stats

    def mean(self) -> Column:
        """Expected count of a row."""
        return F.exp(_linear(self.features, self.coefficients))


def _linear(features: list[str], coefficients: list[float]) -> Column:
    at = F.lit(float(coefficients[0]))
    for f, b in zip(features, coefficients[1:]):
        at = at + F.col(f).cast("double") * float(b)
    return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), at))


def negative_binomial(df: DataFrame, target: str, features: list[str], alpha: float = 1.0, rounds: int = 50, tolerance: float = 1e-8) -> CountModel:
    """Iteratively reweighted least squares for counts with variance mu + alpha mu^2.

    Each round aggregates the moments of the features, so that the driver sees a matrix of their
    number only. Rows with a null feature or target are left out. stats has log-likelihood, AIC, BIC,
    deviance, McFadden's pseudo R2, n and the residual degrees of freedom.
    """
    import numpy as np

    rows = df.dropna(subset=[*features, target])
    y = F.col(target).cast("double")
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    n, mean = rows.agg(F.count(F.lit(1)), F.avg(y)).first()
    if not n or not mean:
        return CountModel(features, [0.0] * len(x), alpha, {"n": float(n or 0)})
    b = np.zeros(len(x))
    b[0] = np.log(mean)
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    for _ in range(rounds):
        eta = _linear(features, b.tolist())
        mu = F.exp(eta)
        w = mu / (1 + alpha * mu)
        z = eta + (y - mu) / mu
        got = rows.select(w.alias("w"), z.alias("z"), *[c.alias(f"x{i}") for i, c in enumerate(x)])
        sums = got.agg(*[F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs], *[F.sum(F.col("w") * F.col("z") * F.col(f"x{i}")) for i in range(len(x))]).first()
        m = np.zeros((len(x), len(x)))
        for (i, j), s in zip(pairs, sums):
            m[i, j] = m[j, i] = s
        new = np.linalg.lstsq(m, np.array(sums[len(pairs) :], float), rcond=None)[0]
        moved, b = float(np.abs(new - b).max()), new
        if moved < tolerance:
            break
    rising = F.aggregate(F.when(y >= 1, F.sequence(F.lit(0), (y - 1).cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, j: s + F.log(j + 1 / alpha) - F.log(j + 1.0))
    score = lambda mu: rising + y * F.log(alpha * mu / (1 + alpha * mu)) - F.log(1 + alpha * mu) / alpha
    mu = F.exp(_linear(features, b.tolist()))
    deviance = 2 * (F.when(y > 0, y * F.log(y / mu)).otherwise(0.0) - (y + 1 / alpha) * F.log((1 + alpha * y) / (1 + alpha * mu)))
    ll, null, dev = rows.agg(F.sum(score(mu)), F.sum(score(F.lit(float(mean)))), F.sum(deviance)).first()
    k = len(x)
    stats = {"log_likelihood": ll, "aic": 2 * k - 2 * ll, "bic": k * float(np.log(n)) - 2 * ll, "deviance": dev, "pseudo_r2": 1 - ll / null, "n": float(n), "df_residual": float(n - k)}
    return CountModel(features, b.tolist(), alpha, stats)
