import random

from pyspark.sql import functions as F

from tidings.operators import communities as C


def value(edges, label, resolution):
    """Modularity in plain Python."""
    whole, inside, total = 0.0, {}, {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            whole += w
            total[label[x]] = total.get(label[x], 0) + w
            if label[x] == label[y]:
                inside[label[x]] = inside.get(label[x], 0) + w
    return sum(inside.get(c, 0) / whole - resolution * (t / whole) ** 2 for c, t in total.items())


def plain(edges, resolution):
    """The usual sequential algorithm."""
    graph, members = {}, {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            graph.setdefault(x, {})[y] = graph.get(x, {}).get(y, 0) + w
    members = {n: n for n in graph}
    whole = sum(w for x in graph.values() for w in x.values())
    while True:
        label, degree = {n: n for n in graph}, {n: sum(x.values()) for n, x in graph.items()}
        total, moved_any, moved = dict(degree), False, True
        while moved:
            moved = False
            for n in sorted(graph):
                near = {}
                for m, w in graph[n].items():
                    if m != n:
                        near[label[m]] = near.get(label[m], 0) + w
                total[label[n]] -= degree[n]
                gain = lambda c: near.get(c, 0) - resolution * degree[n] * total[c] / whole  # noqa: E731, B023
                best = max([label[n], *sorted(near)], key=lambda c: (round(gain(c), 9), c == label[n], -c))  # noqa: B023
                if best != label[n]:
                    label[n], moved, moved_any = best, True, True
                total[best] += degree[n]
        if not moved_any:
            return members
        members = {n: label[m] for n, m in members.items()}
        coarse = {}
        for n, x in graph.items():
            for m, w in x.items():
                own = coarse.setdefault(label[n], {})
                own[label[m]] = own.get(label[m], 0) + w
        graph = coarse


def planted(groups, size, seed):
    rng = random.Random(seed)
    out = []
    for a in range(groups * size):
        for b in range(a):
            if rng.random() < (0.5 if a // size == b // size else 0.03):
                out.append((a, b, float(rng.randint(1, 3))))
    return out


def found(spark, edges, resolution):
    df = spark.createDataFrame(edges, "x long, y long, w double")
    return {r.node: r.community for r in C.louvain(df, "x", "y", "w", resolution).collect()}


def test_planted_groups(spark):
    edges = planted(6, 12, 3)
    got = found(spark, edges, 1.0)
    assert all(got[n] == n // 12 * 12 for n in got) and len(got) == 72


def test_no_worse_than_the_sequential_form(spark):
    rng = random.Random(5)
    loose = [(rng.randint(0, 59), rng.randint(0, 59), float(rng.randint(1, 4))) for _ in range(240)]
    for edges, resolution in ((loose, 1.5), (planted(5, 8, 1) + [(0, 0, 2.0), (0, 20, 1.0)], 1.5)):
        got, want = found(spark, edges, resolution), plain(edges, resolution)
        assert got.keys() == want.keys()
        assert value(edges, got, resolution) >= value(edges, want, resolution) - 0.02


def test_media_links(spark):
    from tidings.plans.graph import _edges
    from tidings.sources.entities import Entities

    links = _edges(Entities(spark, "/root/testdata/sf0.001"))
    edges = [tuple(r) for r in links.select("source_media_id", "ref_media_id", F.col("link_count").cast("double")).collect()]
    got = {r.node: r.community for r in C.louvain(links, "source_media_id", "ref_media_id", "link_count").collect()}
    assert value(edges, got, C.RESOLUTION) >= value(edges, plain(edges, C.RESOLUTION), C.RESOLUTION) - 0.01
    labels = spark.createDataFrame(list(got.items()), "node long, community long")
    total = C.modularity(C.both_ways(links, "source_media_id", "ref_media_id", "link_count"), labels).agg(F.sum("part")).first()[0]
    assert abs(total - value(edges, got, C.RESOLUTION)) < 1e-9


def test_empty_and_odd_links(spark):
    assert found(spark, [], 1.0) == {}
    got = found(spark, [(1, 2, 1.0), (None, 3, 1.0), (4, 5, None), (4, 5, 0.0), (7, 7, 2.0)], 1.0)
    assert got == {1: 1, 2: 1, 7: 7}
