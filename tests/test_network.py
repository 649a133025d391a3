import heapq
import math
import random

from tripmarts.operators import network as N
from tripmarts.operators import spatial


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(500, 500 + k) for k in range(1, 80)] + [(900, 900)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in N.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {n: find(n) for n in parent}
    small = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "u bigint, v bigint")
    assert {r["u"] for r in N.largest_component(small, N.components(small)).collect()} == {1, 2}


def test_edge_load(spark):
    routes = spark.createDataFrame([([1, 2, 3], 5), ([2, 3], 2), ([9], 4)], "nodes array<bigint>, trips int")
    assert {(r["u"], r["v"]): r["load"] for r in N.edge_load(routes).collect()} == {(1, 2): 5, (2, 3): 7}


def test_shortest_paths_against_dijkstra(spark):
    rng = random.Random(5)
    edges = [(a, b, rng.uniform(1, 9)) for a in range(25) for b in rng.sample(range(25), 3) if a != b]
    od = [(0, 7, 3), (0, 24, 2), (5, 11, 4), (6, 6, 1)]
    e = spark.createDataFrame(edges, "u bigint, v bigint, length_m double")
    o = spark.createDataFrame(od, "u bigint, v bigint, trips int")
    best = N.shortest_paths(e, o)
    got = {(r["source"], r["node"]): r["dist"] for r in best.collect()}
    adj = {}
    for a, b, w in edges:
        adj.setdefault(a, []).append((b, w))
    for s in {0, 5, 6}:
        dist, heap = {s: 0.0}, [(0.0, s)]
        while heap:
            d, n = heapq.heappop(heap)
            if d > dist[n]:
                continue
            for m, w in adj.get(n, []):
                if d + w < dist.get(m, math.inf):
                    dist[m] = d + w
                    heapq.heappush(heap, (d + w, m))
        mine = {n: d for (src, n), d in got.items() if src == s}
        assert mine.keys() <= dist.keys() and all(mine[n] >= dist[n] - 1e-9 for n in mine)
        assert all(abs(mine[n] - dist[n]) < 1e-9 if n in dist else n not in mine for n in {b for a, b, _ in od if a == s})
    length = {(a, b): min(w for x, y, w in edges if (x, y) == (a, b)) for a, b, _ in edges}
    walked = {}
    for r in N.route_edges(best, o).collect():
        walked[(r["source"], r["target"])] = walked.get((r["source"], r["target"]), 0) + length[(r["u"], r["v"])]
    assert all(abs(walked[k] - got[k]) < 1e-9 for k in walked) and set(walked) == {(a, b) for a, b, _ in od if a != b and (a, b) in got}


def test_nearest_against_brute_force(spark):
    rng = random.Random(6)
    pts = [(i, 40 + rng.random(), -74 + rng.random()) for i in range(60)] + [(99, 10.0, 10.0)]
    tgt = [(i, 40.3 + rng.random() / 10, -73.9 + rng.random() / 10) for i in range(40)] + [(77, 40.9, -73.1)]
    got = {r["id"]: (r["dist_m"], r["target"]) for r in spatial.nearest(spark.createDataFrame(pts, "id int, lat double, lon double"), "id",
                                                                       spark.createDataFrame(tgt, "tid int, lat double, lon double"), target_id="tid").collect()}

    def hav(a, b, c, d):
        p, q = math.radians(a), math.radians(c)
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    for i, la, lo in pts:
        d, t = min((hav(la, lo, c, e), k) for k, c, e in tgt)
        assert abs(got[i][0] - d) < 1e-5 and got[i][1] == t


def test_square_centroid(spark):
    v = spark.createDataFrame([("a", i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])], "k string, seq int, x double, y double")
    r = spatial.polygon_centroids(v, "k").first()
    assert (r["cx"], r["cy"], r["area"]) == (.5, .5, 1.0)


def test_paths_keep_routes_and_not_every_node(spark):
    side = 24  # a grid with a far corner that no route needs, two places without a way between, a one-way end
    edges = [((x, y), (x + i, y + j), 1 + ((7 * x + 13 * y) % 5) / 10) for x in range(side) for y in range(side) for i, j in ((0, 1), (1, 0)) if x + i < side and y + j < side]
    key = lambda p: p[0] * 1000 + p[1]
    rows = [(key(a), key(b), w) for a, b, w in edges] + [(key(b), key(a), w) for a, b, w in edges] + [(90000, 90001, 1.0), (90002, 0, 0.5)]
    od = [(0, 2002, 1), (0, 5, 1), (0, 90001, 1), (90000, 0, 1), (90002, 3, 1), (3, 90002, 1), (7, 7, 1)]
    best = N.shortest_paths(spark.createDataFrame(rows, "u bigint, v bigint, length_m double"), spark.createDataFrame(od, "u bigint, v bigint, trips int")).collect()
    adj = {}
    for a, b, w in rows:
        adj.setdefault(a, []).append((b, w))
    for s, t, _ in od:
        dist, heap = {s: 0.0}, [(0.0, s)]
        while heap:
            d, n = heapq.heappop(heap)
            for m, w in adj.get(n, []) if d == dist[n] else []:
                if d + w < dist.get(m, math.inf):
                    dist[m] = d + w
                    heapq.heappush(heap, (d + w, m))
        got = {r["node"]: (r["dist"], r["prev"]) for r in best if r["source"] == s}
        assert (t in got) == (t in dist) and got[s] == (0.0, None)
        assert all(abs(d - dist[n]) < 1e-9 and (p in got or n == s) for n, (d, p) in got.items())
    assert len(best) < 40  # routes only: every node within reach of the sources would be some hundreds
