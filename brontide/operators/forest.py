"""Isolation forest: trees built in parallel groups, scored from broadcast node arrays, calibrated to percentiles, explained by Shapley values."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brontide.config import CONFIG, FEATURES, VARIABLES
from brontide.sources.folders import written

NODES = "variable string, tree int, node int, feature int, threshold double, left int, right int, size long, depth int"
CALIBRATION = "variable string, score double, rows long"
#: Scores are ranked to so many decimals, so that a calibration has no more than 10^5 distinct ones per variable whatever its rows.
DIGITS = 5
_EULER = 0.5772156649015329


def usual_depth(n) -> np.ndarray:
    """The mean depth of a failed search among n, by Liu, Ting and Zhou."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + _EULER) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def draws(variable: str, tree: int, node: int, seed: int) -> tuple[float, float]:
    """Two numbers from 0 to 1 for a node: which feature, and where it is cut."""
    h = hashlib.md5(f"{seed}|{variable}|{tree}|{node}".encode()).hexdigest()
    return int(h[:8], 16) / 2.0**32, int(h[8:16], 16) / 2.0**32


def build_tree(x: np.ndarray, draw, most: int) -> list[tuple]:
    """(node, feature, threshold, left, right, size, depth) rows of a tree; node k has the children 2k and 2k + 1, leaves have feature -1."""
    rows: list = []
    todo = [(x, 1, 0)]
    while todo:
        own, node, depth = todo.pop()
        lo, hi = (own.min(axis=0), own.max(axis=0)) if len(own) else (np.zeros(1), np.zeros(1))
        open_to = np.flatnonzero(hi > lo)
        if depth >= most or len(own) < 2 or not len(open_to):
            rows.append((node, -1, 0.0, -1, -1, len(own), depth))
            continue
        which, where = draw(node)
        f = int(open_to[int(which * len(open_to))])
        cut = float(lo[f] + where * (hi[f] - lo[f]))
        rows.append((node, f, cut, 2 * node, 2 * node + 1, len(own), depth))
        below = own[:, f] < cut
        todo += [(own[~below], 2 * node + 1, depth + 1), (own[below], 2 * node, depth + 1)]
    return sorted(rows)


def _fixed(features: DataFrame, *keys: str) -> DataFrame:
    """Features to six decimals, so that no tree hangs on the last bits of a sum."""
    return features.select(*keys, *[F.round(f, 6).alias(f) for f in FEATURES])


def subsamples(features: DataFrame, trees: int, subsample: int, seed: int) -> DataFrame:
    """tree and FEATURES of the ``subsample`` rows with the least hashes for each variable and tree, or of all rows where there are no more.

    A pool of rows with the least hashes, twice as many as all trees together take, is drawn from; rows that stand no
    chance in a tree are left out before they are ranked, and where that leaves a tree short, it is done again with wider limits.
    """
    n = {r["variable"]: r["count"] for r in features.groupBy("variable").count().collect()}
    share = {v: min(1.0, 2.0 * trees * subsample / max(1, n.get(v, 0))) for v in VARIABLES}
    hex_of = lambda rate: format(min(0xFFFFFFFF, int(rate * 2.0**32)), "08x") + ("" if rate < 1 else "g")
    limit = lambda rates: F.create_map(*[F.lit(x) for v in VARIABLES for x in (v, hex_of(rates[v]))])[F.col("variable")]
    key = F.concat_ws("|", F.lit(str(seed)), "station_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "variable")
    pool = _fixed(features, "station_id", "ts", "variable").withColumn("key", key).where(F.substring(F.md5(F.col("key").cast("binary")), 1, 8) < limit(share))
    wide = 6.0
    while True:
        rates = {v: min(1.0, (subsample + wide * math.sqrt(subsample) + 10) / max(1.0, n.get(v, 0) * share[v] - wide * math.sqrt(n.get(v, 0) * share[v]))) if n.get(v, 0) * share[v] > 100 else 1.0 for v in VARIABLES}
        top = limit(rates)
        # one hash for four trees, eight digits for each
        of_block = lambda b: F.transform(F.array(F.md5(F.concat("key", F.lit("|"), b.cast("string")).cast("binary"))), lambda h: F.filter(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct((4 * b + k).alias("tree"), F.substring(h, 8 * k + 1, F.lit(8)).alias("h"))), lambda d: (d["h"] < top) & (d["tree"] < trees)))
        found = pool.withColumn("d", F.explode(F.flatten(F.flatten(F.transform(F.sequence(F.lit(0), F.lit((trees - 1) // 4)), of_block)))))
        rank = F.row_number().over(Window.partitionBy("variable", "tree").orderBy("h", "station_id", "ts", *FEATURES))
        chosen = found.select("station_id", "ts", "variable", *FEATURES, "d.tree", "d.h").withColumn("rank", rank).where(F.col("rank") <= subsample)
        if all(r >= 1 for r in rates.values()):
            return chosen.select("variable", "tree", *FEATURES)
        chosen = written(chosen.select("variable", "tree", *FEATURES))
        got = {(r["variable"], r["tree"]): r["count"] for r in chosen.groupBy("variable", "tree").count().collect()}
        if all(got.get((v, t), 0) == min(subsample, c) for v, c in n.items() for t in range(trees)):
            return chosen
        wide *= 4


def fit_forest(features: DataFrame, trees: int = CONFIG["trees"], subsample: int = CONFIG["subsample"], seed: int = CONFIG["seed"]) -> DataFrame:
    """NODES of a tree for each variable and number, each from ``subsample`` rows; hashes pick rows, features and cuts, so it is repeatable."""
    most = math.ceil(math.log2(subsample))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        variable, tree = key[0].as_py(), key[1].as_py()
        x = np.column_stack([table[f].to_numpy() for f in FEATURES])
        nodes = build_tree(x, lambda node: draws(variable, tree, node, seed), most)
        columns = list(zip(*nodes, strict=True))
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
        return pa.table([pa.array([variable] * len(nodes)), pa.array([tree] * len(nodes), pa.int32()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[c.split()[0] for c in NODES.split(", ")])

    return subsamples(features, trees, subsample, seed).groupBy("variable", "tree").applyInArrow(run, NODES)


class Tree:
    """Node arrays of one tree, and of each leaf the box of features that leads to it."""

    def __init__(self, node, feature, cut, left, right, size, depth):
        place = {int(k): i for i, k in enumerate(node)}
        self.feature, self.cut = feature, cut
        self.left, self.right = (np.array([place.get(int(k), 0) for k in side]) for side in (left, right))
        self.length = depth + usual_depth(size)
        self.usual = float(usual_depth(size[place[1]]))
        boxes = []
        todo = [(place[1], {})]
        while todo:
            at, box = todo.pop()
            if feature[at] < 0:
                boxes.append((self.length[at], box))
                continue
            f = int(feature[at])
            lo, hi, share = box.get(f, (-np.inf, np.inf, 1.0))
            for to, a, b in ((self.left[at], lo, min(hi, cut[at])), (self.right[at], max(lo, cut[at]), hi)):
                todo.append((to, {**box, f: (a, b, share * size[to] / size[at])}))
        # places up to the longest path are filled with a feature that is always as asked, which takes nothing from the others
        wide = max(1, max(len(b) for _, b in boxes))
        self.box_feature = np.zeros((len(boxes), wide), dtype=np.int64)
        self.low, self.high = np.full((len(boxes), wide), -np.inf), np.full((len(boxes), wide), np.inf)
        self.share, self.value = np.ones((len(boxes), wide)), np.array([v for v, _ in boxes])
        for i, (_, box) in enumerate(boxes):
            for j, (f, (a, b, share)) in enumerate(box.items()):
                self.box_feature[i, j], self.low[i, j], self.high[i, j], self.share[i, j] = f, a, b, share

    def lengths(self, x: np.ndarray) -> np.ndarray:
        """The expected depth that each row comes to."""
        at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while True:
            inner = self.feature[at] >= 0
            if not inner.any():
                return self.length[at]
            at = np.where(inner, np.where(x[rows, np.maximum(self.feature[at], 0)] < self.cut[at], self.left[at], self.right[at]), at)

    def shapley(self, x: np.ndarray) -> np.ndarray:
        """Shapley values of each row's features for its length, where a feature left out is averaged by the trees' own rows.

        A leaf counts with the product of its features' shares, or of whether they lead to it. Its part in a feature's value hangs on
        which of its features do, so each combination that occurs is worked out once.
        """
        n, (leaves, wide) = len(x), self.share.shape
        meets = (x[:, self.box_feature] >= self.low) & (x[:, self.box_feature] < self.high)
        code = (meets * (1 << np.arange(wide))).sum(axis=2) + (np.arange(leaves) << wide)
        known, which = np.unique(code, return_inverse=True)
        leaf = known >> wide
        one = ((known[:, None] >> np.arange(wide)) & 1).astype(float)
        part = shapley_parts(self.share[leaf], one) * self.value[leaf, None]
        out = np.zeros((n, len(FEATURES)))
        flat = (np.arange(n)[:, None, None] * len(FEATURES) + self.box_feature).ravel()
        np.add.at(out.ravel(), flat, part[which.reshape(n, leaves)].ravel())
        return out


def shapley_parts(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Shapley values of the game whose worth is the product of ``one`` over a coalition and of ``zero`` over the others; a row for each game.

    The products by size of coalition are the coefficients of the polynomial of all factors zero + one t; a player's own factor is
    divided out of it.
    """
    rows, wide = zero.shape
    whole = np.zeros((rows, wide + 1))
    whole[:, 0] = 1
    for j in range(wide):
        grown = whole * zero[:, j : j + 1]
        grown[:, 1:] += whole[:, :-1] * one[:, j : j + 1]
        whole = grown
    weight = [math.factorial(s) * math.factorial(wide - 1 - s) / math.factorial(wide) for s in range(wide)]
    out = np.zeros((rows, wide))
    for j in range(wide):
        z, on = zero[:, j], one[:, j] > 0
        rest, upper = np.zeros(rows), np.zeros(rows)
        for s in range(wide - 1, -1, -1):
            # where the player's factor is z + t, from the highest coefficient down; where it is z alone, all are divided by it
            upper = whole[:, s + 1] - z * upper
            rest += weight[s] * np.where(on, upper, np.divide(whole[:, s], z, out=np.zeros(rows), where=z > 0))
        out[:, j] = (one[:, j] - z) * rest
    return out


class Forest:
    """All trees of each variable; its size is set by the numbers of trees and rows per tree."""

    def __init__(self, nodes: DataFrame):
        self.trees: dict[str, list[Tree]] = {v: [] for v in VARIABLES}
        pdf = nodes.toPandas().sort_values(["variable", "tree", "node"])
        for (v, _), t in pdf.groupby(["variable", "tree"]):
            self.trees[v].append(Tree(*(t[c].to_numpy() for c in ("node", "feature", "threshold", "left", "right", "size", "depth"))))

    def score(self, x: np.ndarray, variable: str) -> np.ndarray:
        """Raw scores; lengths are held against those usual for the rows that each tree got."""
        trees = self.trees[variable]
        usual = sum(t.usual for t in trees)
        return 2.0 ** (-sum((t.lengths(x) for t in trees), np.zeros(len(x))) / usual) if usual else np.ones(len(x))

    def shapley(self, x: np.ndarray, variable: str, rows: int = 256) -> np.ndarray:
        """Shapley values of the features for the mean length, by runs of rows."""
        trees, out = self.trees[variable], np.zeros((len(x), len(FEATURES)))
        for a in range(0, len(x), rows):
            for t in trees:
                out[a : a + rows] += t.shapley(x[a : a + rows])
        return out / max(1, len(trees))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch[f].to_numpy(zero_copy_only=False) for f in FEATURES]) if batch.num_rows else np.zeros((0, len(FEATURES)))


def score_forest(features: DataFrame, forest: Forest, calibration: dict[str, tuple[np.ndarray, np.ndarray]] | None = None) -> DataFrame:
    """station_id, ts, variable, raw, ml_score (percentile among the calibration, ties counted) and features, those the trees read."""
    shared = features.sparkSession.sparkContext.broadcast((forest, calibration or {}))
    kind = features.schema["ts"].dataType.simpleString()

    def run(batches):
        forest, known = shared.value
        for batch in batches:
            x = _matrix(batch)
            names = np.array(batch["variable"].to_pylist(), dtype=object)
            raw, rank = np.zeros(len(x)), np.zeros(len(x))
            for v in VARIABLES:
                own = np.flatnonzero(names == v)
                if len(own):
                    raw[own] = forest.score(x[own], v)
                    rank[own] = ranks(raw[own], known.get(v))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch["station_id"], batch["ts"], batch["variable"], pa.array(raw), pa.array(rank), lists], names=["station_id", "ts", "variable", "raw", "ml_score", "features"])

    return _fixed(features, "station_id", "ts", "variable").mapInArrow(run, f"station_id string, ts {kind}, variable string, raw double, ml_score double, features array<double>")


def score_rows(rows: DataFrame, forest: Forest, calibration: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """rows (variable, features, ...) with ml_score; they pass through whole, so a stream can be scored."""
    shared = rows.sparkSession.sparkContext.broadcast((forest, calibration))

    def run(batches):
        forest, known = shared.value
        for batch in batches:
            names, rank = np.array(batch["variable"].to_pylist(), dtype=object), np.zeros(batch.num_rows)
            for v in VARIABLES:
                own = np.flatnonzero(names == v)
                if len(own):
                    rank[own] = ranks(forest.score(_features_of(batch, own), v), known.get(v))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank)], names=[*batch.schema.names, "ml_score"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *StructType.fromDDL("ml_score double").fields]))


def ranks(raw: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """The share of a calibration (distinct scores and rows of each) that is not above each raw score; 0 without one."""
    if known is None or not len(known[0]):
        return np.zeros(len(raw))
    return np.append(0, np.cumsum(known[1]))[np.searchsorted(known[0], np.round(raw, DIGITS), side="right")] / known[1].sum()


def _features_of(batch: pa.RecordBatch, own: np.ndarray) -> np.ndarray:
    return batch["features"].take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)


TOP = "array<struct<label:string,contribution:double>>"


def contributions(rows: DataFrame, forest: Forest, top: int = 3) -> DataFrame:
    """rows (variable, status, features, ...) with shap_top: the ``top`` features of greatest Shapley values, by size, of rows that are not NORMAL.

    The rows pass through whole, so nothing is joined, and what has no need of an explanation costs none.
    """
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for batch in batches:
            names = np.array(batch["variable"].to_pylist(), dtype=object)
            asked = np.array([s not in (None, "NORMAL") for s in batch["status"].to_pylist()], dtype=bool)
            tops: list = [[] for _ in range(batch.num_rows)]
            for v in VARIABLES:
                own = np.flatnonzero((names == v) & asked)
                if len(own):
                    size = np.abs(shared.value.shapley(_features_of(batch, own), v))
                    for i, by, part in zip(own, np.argsort(-size, axis=1, kind="stable")[:, :top], size, strict=True):
                        tops[i] = [{"label": FEATURES[j], "contribution": round(float(part[j]), 4)} for j in by]
            told = pa.array(tops, pa.list_(pa.struct([("label", pa.string()), ("contribution", pa.float64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns, told], names=[*batch.schema.names, "shap_top"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *StructType.fromDDL(f"shap_top {TOP}").fields]))


def _by_variable(rows: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    pdf = rows.toPandas().sort_values(["variable", "score"])
    return {v: (g["score"].to_numpy(), g["rows"].to_numpy()) for v, g in pdf.groupby("variable")}


def calibrate(features: DataFrame, forest: Forest) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per variable the distinct scores of all rows, sorted, and the number of rows of each."""
    scores = score_forest(features, forest).select("variable", F.col("raw").alias("score"))
    rounded = scores.mapInArrow(_rounded, "variable string, score double")
    return _by_variable(rounded.groupBy("variable", "score").agg(F.count("*").alias("rows")))


def _rounded(batches):
    """By numpy's rounding, as scoring does it."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(batch.column(1).to_numpy(zero_copy_only=False), DIGITS))], names=["variable", "score"])


def save_model(nodes: DataFrame, calibration: dict[str, tuple[np.ndarray, np.ndarray]], path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    rows = [(v, float(s), int(n)) for v, k in calibration.items() for s, n in zip(*k, strict=True)]
    nodes.sparkSession.createDataFrame(rows, CALIBRATION).write.mode("overwrite").parquet(f"{path}/calibration")


def load_model(spark, path: str) -> tuple[Forest, dict[str, tuple[np.ndarray, np.ndarray]]]:
    return Forest(spark.read.schema(NODES).parquet(f"{path}/nodes")), _by_variable(spark.read.schema(CALIBRATION).parquet(f"{path}/calibration"))


def percentile_rank(scores: DataFrame, calibration: DataFrame, buckets: int = 4096, side: str = "right") -> DataFrame:
    """scores (variable, raw, ...) with ml_score: the share of the calibration (variable, score) that is not above raw, or
    (side "left") below it; side "both" gives the one as ml_score and the other as below.

    Scores, mostly between 0 and 1, fall into buckets by size; distinct scores asked for and known are counted together and ranked within
    their bucket, once for both sides. Only the buckets' totals are summed up along a whole variable, so no task holds all scores.
    """
    bucket = F.greatest(F.least(F.floor(F.col("score") * buckets), F.lit(buckets)), F.lit(-1)).alias("bucket")
    asked = scores.select("variable", F.col("raw").alias("score"), F.lit(0).cast("long").alias("k"), F.lit(True).alias("asked"))
    known = calibration.select("variable", "score", F.lit(1).cast("long").alias("k"), F.lit(False).alias("asked"))
    own = asked.unionByName(known).groupBy("variable", bucket, "score").agg(F.sum("k").alias("k"), F.max("asked").alias("asked"))
    upto = F.sum("k").over(Window.partitionBy("variable", "bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = written(own.withColumn("upto", upto))
    totals = own.groupBy("variable", "bucket").agg(F.sum("k").alias("n"))
    along = Window.partitionBy("variable")
    base = totals.select("variable", "bucket", F.coalesce(F.sum("n").over(along.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("under"), F.sum("n").over(along).alias("total"))
    ranked = own.where("asked").join(base, ["variable", "bucket"]).where("total > 0")
    share = {"right": (F.col("under") + F.col("upto")) / F.col("total"), "left": (F.col("under") + F.col("upto") - F.col("k")) / F.col("total")}
    columns = [share["right"].alias("ml_score"), share["left"].alias("below")] if side == "both" else [share[side].alias("ml_score")]
    return scores.join(ranked.select("variable", F.col("score").alias("raw"), *columns), ["variable", "raw"])
