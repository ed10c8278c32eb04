import random

from mapforge.queries import QUERIES


def union_find(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in root}


def test_components_of_all_links(spark, tmp_path):
    """Chains, small groups and one hot supplier; quantities and priorities that ``linked_components`` leaves out."""
    rng = random.Random(1)
    edges = [(c, -c) for c in range(1, 40)] + [(c + 1, -c) for c in range(1, 39)] + [(c, -500) for c in range(100, 300)]
    edges += [(rng.randint(400, 480), -rng.randint(600, 660)) for _ in range(60)]
    spark.createDataFrame([(k, a, "5-LOW") for k, (a, _) in enumerate(edges)], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, -b, 7.0) for k, (_, b) in enumerate(edges)], "l_orderkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.node: r.component for r in QUERIES["linked_components_whole"](spark, str(tmp_path)).collect()}
    assert got == union_find(edges)
