import math
import random

import pytest
from pyspark.sql import functions as F

from ridelattice.functions import geo

R = geo.EARTH_RADIUS_KM


def hav(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * R * math.asin(math.sqrt(max(0.0, min(1.0, h))))


def similarity(a, b, tol=0.5):
    pts = a + b
    lat0 = (min(p[0] for p in pts) + max(p[0] for p in pts)) / 2
    lon0 = (min(p[1] for p in pts) + max(p[1] for p in pts)) / 2
    plane = lambda r: [(R * math.radians(p[1] - lon0) * math.cos(math.radians(lat0)), R * math.radians(p[0] - lat0)) for p in r]

    def near(p, line):
        best = math.inf
        for u, v in zip(line, line[1:]):
            d = (v[0] - u[0], v[1] - u[1])
            q = d[0] ** 2 + d[1] ** 2
            t = 0 if q == 0 else max(0, min(1, ((p[0] - u[0]) * d[0] + (p[1] - u[1]) * d[1]) / q))
            best = min(best, math.hypot(p[0] - u[0] - t * d[0], p[1] - u[1] - t * d[1]))
        return best <= tol + 1e-10

    def share(x, y):
        total = sum(math.dist(u, v) for u, v in zip(x, x[1:]))
        n = min(2048, max(2, math.ceil(total / 0.1) + 1))
        hits = 0
        for i in range(n):
            left = total * i / (n - 1)
            for u, v in zip(x, x[1:]):
                size = math.dist(u, v)
                if left <= size or (u, v) == (x[-2], x[-1]):
                    t = left / size if size else 0
                    hits += near((u[0] + t * (v[0] - u[0]), u[1] + t * (v[1] - u[1])), y)
                    break
                left -= size
        return hits / n

    x, y = plane(a), plane(b)
    return (share(x, y) + share(y, x)) / 2


def insertion(route, p, q):
    """Try every ordered pair of edges."""
    best = math.inf
    legs = list(zip(route, route[1:]))
    for i, (a, b) in enumerate(legs):
        best = min(best, max(0, hav(a, p) + hav(p, q) + hav(q, b) - hav(a, b)))
        for c, d in legs[i + 1:]:
            best = min(best, max(0, hav(a, p) + hav(p, b) - hav(a, b)) + max(0, hav(c, q) + hav(q, d) - hav(c, d)))
    return best


def random_route(rng, n):
    return [(31 + rng.random() * 0.1, 75 + rng.random() * 0.1) for _ in range(n)]


def as_points(route):
    return [{"lat": a, "lon": b} for a, b in route]


def test_polyline_similarity_and_insertion(spark):
    rng = random.Random(5)
    cases = [(i, random_route(rng, rng.choice([2, 3, 4])), random_route(rng, rng.choice([2, 3]))) for i in range(20)]
    cases.append((20, cases[0][1], cases[0][1]))
    df = spark.createDataFrame(
        [(i, as_points(a), as_points(b)) for i, a, b in cases], "id int, a array<struct<lat:double,lon:double>>, b array<struct<lat:double,lon:double>>")
    b0, b1 = F.get("b", F.lit(0)), F.element_at("b", -1)
    got = {r.id: r for r in geo.with_route_similarity(df, "a", "b", out="sim").select(
        "id", "sim", geo.polyline_km(F.col("a")).alias("km"),
        geo.insertion_detour(F.col("a"), b0["lat"], b0["lon"], b1["lat"], b1["lon"]).alias("detour")).collect()}
    for i, a, b in cases:
        assert got[i].sim == pytest.approx(similarity(a, b), abs=0.02)
        assert got[i].km == pytest.approx(sum(hav(u, v) for u, v in zip(a, a[1:])))
        assert got[i].detour == pytest.approx(insertion(a, b[0], b[-1]), abs=1e-9)
    assert got[20].sim == 1.0


def test_two_point_similarity_equals_samples(spark):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        a = random_route(rng, 2)
        b = [(p[0] + rng.uniform(-0.006, 0.006), p[1] + rng.uniform(-0.006, 0.006)) for p in a] if i % 2 else random_route(rng, 2)
        rows.append((i, *a[0], *a[1], *b[0], *b[1]))
    cols = ["id", "a1", "a2", "a3", "a4", "b1", "b2", "b3", "b4"]
    df = geo.with_route_similarity_2pt(spark.createDataFrame(rows, cols), ("a1", "a2", "a3", "a4"), ("b1", "b2", "b3", "b4"))
    got = {r.id: r.route_sim for r in df.collect()}
    for r in rows:
        assert got[r[0]] == pytest.approx(similarity([(r[1], r[2]), (r[3], r[4])], [(r[5], r[6]), (r[7], r[8])]), abs=1e-9)


def test_known_values(spark):
    one = spark.range(1)
    c = F.lit
    row = one.select(
        geo.haversine_km(c(0.0), c(0.0), c(0.0), c(1.0)).alias("deg"), geo.bearing_deg(c(0.0), c(0.0), c(0.0), c(1.0)).alias("east"),
        geo.direction_similarity((c(0.0), c(0.0)), (c(0.0), c(1.0)), (c(0.0), c(1.0)), (c(0.0), c(0.0))).alias("opposite")).first()
    assert row.deg == pytest.approx(111.195, abs=1e-3)
    assert row.east == pytest.approx(90.0)
    assert row.opposite == pytest.approx(0.0, abs=1e-12)
