"""The forest: exact samples, and Shapley values against sums over all coalitions."""

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from brontide.config import FEATURES, VARIABLES
from brontide.operators import forest

WIDE = len(FEATURES)


def frame_of(spark, n: int, variables=VARIABLES, seed: int = 0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(np.round(rng.normal(size=(n * len(variables), WIDE)), 2), columns=list(FEATURES))
    pdf["station_id"], pdf["variable"] = "S", np.repeat(variables, n)
    pdf["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.tile(np.arange(n), len(variables)), unit="h")
    return spark.createDataFrame(pdf)


def small_tree(seed: int, rows: int, most: int, features: int) -> forest.Tree:
    rng = np.random.default_rng(seed)
    x = np.zeros((rows, WIDE))
    x[:, :features] = np.round(rng.normal(size=(rows, features)), 2)
    nodes = forest.build_tree(x, lambda node: forest.draws("temp_c", seed, node, 7), most)
    return forest.Tree(*(np.array(c) for c in zip(*nodes, strict=True)))


def expected(tree: forest.Tree, sizes: dict, x: np.ndarray, known: set, at: int) -> float:
    """The expected length where features outside ``known`` are averaged by the sizes of branches."""
    if tree.feature[at] < 0:
        return float(tree.length[at])
    a, b = int(tree.left[at]), int(tree.right[at])
    if int(tree.feature[at]) in known:
        return expected(tree, sizes, x, known, a if x[tree.feature[at]] < tree.cut[at] else b)
    return (sizes[a] * expected(tree, sizes, x, known, a) + sizes[b] * expected(tree, sizes, x, known, b)) / sizes[at]


def test_shapley_values_are_sums_over_all_coalitions():
    for seed, rows, most, features in ((1, 24, 4, 11), (2, 40, 6, 3), (3, 16, 3, 11), (4, 2, 4, 11), (5, 1, 4, 11)):
        rng = np.random.default_rng(seed)
        x0 = np.zeros((rows, WIDE))
        x0[:, :features] = np.round(np.random.default_rng(seed).normal(size=(rows, features)), 2)
        nodes = forest.build_tree(x0, lambda node, seed=seed: forest.draws("temp_c", seed, node, 7), most)
        tree = forest.Tree(*(np.array(c) for c in zip(*nodes, strict=True)))
        sizes, root = {i: r[5] for i, r in enumerate(nodes)}, [r[0] for r in nodes].index(1)
        asked = np.round(rng.normal(size=(3, WIDE)), 2)
        got = tree.shapley(asked)
        for x, own in zip(asked, got, strict=True):
            worth = {s: expected(tree, sizes, x, set(s), root) for k in range(WIDE + 1) for s in itertools.combinations(range(WIDE), k)}
            for j in range(WIDE):
                want = sum(math.factorial(len(s)) * math.factorial(WIDE - 1 - len(s)) / math.factorial(WIDE) * (worth[tuple(sorted((*s, j)))] - v) for s, v in worth.items() if j not in s)
                assert abs(own[j] - want) < 1e-9
            assert abs(own.sum() - (tree.lengths(x[None])[0] - worth[()])) < 1e-9


def test_samples_are_exact_whatever_the_order(spark):
    f = frame_of(spark, 900, ("temp_c", "rh_pct"))
    one = forest.subsamples(f, 13, 64, 42)
    assert {(r["variable"], r["tree"]): r["count"] for r in one.groupBy("variable", "tree").count().collect()} == {(v, t): 64 for v in ("temp_c", "rh_pct") for t in range(13)}
    again = forest.subsamples(f.repartition(7).orderBy(F.rand(3)), 13, 64, 42)
    assert one.exceptAll(again).count() == 0
    few = frame_of(spark, 20)
    assert {r["count"] for r in forest.subsamples(few, 5, 64, 1).groupBy("variable", "tree").count().collect()} == {20}


def test_pool_of_many_rows(spark):
    """More rows than the pool takes: every tree still has its rows, all of them rows of the table."""
    f = frame_of(spark, 6000, ("temp_c",))
    got = forest.subsamples(f, 8, 32, 5)
    assert {r["count"] for r in got.groupBy("tree").count().collect()} == {32}
    assert got.select(*FEATURES).distinct().join(f.select(*FEATURES), list(FEATURES), "left_anti").count() == 0


def test_contributions_of_flagged_rows(spark):
    f = frame_of(spark, 300)
    model = forest.Forest(forest.fit_forest(f, trees=60, subsample=64))
    odd = f.limit(40).withColumn("diff_1", F.lit(25.0)).withColumn("status", F.when(F.hour("ts") % 2 == 0, "SUSPECT").otherwise("NORMAL"))
    scored = forest.score_forest(odd, model).join(odd.select("station_id", "ts", "variable", "status"), ["station_id", "ts", "variable"])
    rows = forest.contributions(scored, model).collect()
    assert {len(r["shap_top"]) for r in rows if r["status"] == "NORMAL"} == {0}
    flagged = [r for r in rows if r["status"] != "NORMAL"]
    assert flagged and all(len(r["shap_top"]) == 3 and "diff_1" in [c["label"] for c in r["shap_top"]] for r in flagged)
    assert sum(r["shap_top"][0]["label"] == "diff_1" for r in flagged) >= 0.8 * len(flagged)
    assert all(a["contribution"] >= b["contribution"] for r in flagged for a, b in zip(r["shap_top"], r["shap_top"][1:], strict=False))


def test_scale_follows_the_rows_of_each_tree():
    forest_of = object.__new__(forest.Forest)
    forest_of.trees = {"temp_c": [small_tree(k, 40, 8, 11) for k in range(5)]}
    x = np.zeros((1, WIDE))
    lengths = [t.lengths(x)[0] for t in forest_of.trees["temp_c"]]
    assert abs(forest_of.score(x, "temp_c")[0] - 2 ** (-np.mean(lengths) / float(forest.usual_depth(40)))) < 1e-12
