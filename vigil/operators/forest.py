"""Random forest over counted cells, for training tables of any length.

A forest only sees which of at most ``maxBins`` ranges a value falls into, so rows of equal ranges, categories, label and
weight are one cell with a count.  A row that is drawn Poisson(1) times a tree makes a cell of n rows drawn Poisson(n)
times: the bootstrap of the rows, in work by cells.  Ranges come from all rows.  Each task grows whole trees over the cells,
level by level, by the rules of ``RandomForestClassifier`` (Gini gain, a random subset of the features a node, siblings that
predict alike merged), and the result is Spark's own model.
"""

from __future__ import annotations

import math
import uuid
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.curve import count_less
from vigil.operators.ordered import running_sums
from vigil.session import run_folder, written

MIN_ROWS = 20_000  # shorter tables are left to Spark's own forest over rows
MAX_CELLS = 1 << 22  # cells that every task may hold, about 25 bytes each
BLOCK = 1 << 16  # cells that travel or are counted at once
TASK_TREES = 5
MAX_CODES = 1 << 16

_NODES = ("treeID int, id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double, "
          "leftChild int, rightChild int, featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int")


def split_points(df: DataFrame, values: Sequence[str], weight: str, bins: int) -> list[list[float]]:
    """Per column of ``values`` the points that cut it: between all distinct values where these are at most
    ``bins``, else up to ``bins - 1`` points next to equal shares of the weight, a value heavier than a share counting as one."""
    per = df.select(F.posexplode(F.array(*values)).alias("slot", "v"), F.col(weight).alias("w"))
    counts = written(per.groupBy("slot", "v").agg(F.round(F.sum("w"), 6).alias("w")), "values")
    slots = {r["slot"]: r for r in counts.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")).collect()}
    share = F.element_at(F.array(*[F.lit(slots[s]["w"] / bins) for s in sorted(slots)]), F.col("slot") + 1)
    line = running_sums(counts.withColumn("c", F.least(F.col("w"), share)), "v", ["c"], "slot", totals=True, count="n", lead_cols=["v"])
    mid = (F.col("v") + F.col("v_next")) / 2.0
    part = F.col("c_tot") / bins
    near = F.when(F.col("n") <= bins, F.col("v")).otherwise(F.round(F.col("c_cum") / part))
    off = F.when(F.col("n") <= bins, F.lit(0.0)).otherwise(F.abs(F.col("c_cum") - near * part))
    cuts = line.where(F.col("v_next").isNotNull()).select("slot", "n", near.alias("near"), off.alias("off"), "v",
                                                          F.when(mid < F.col("v_next"), mid).otherwise(F.col("v")).alias("at"))
    held = (cuts.where((F.col("n") <= bins) | F.col("near").between(1, bins - 1))
            .groupBy("slot", "near").agg(F.min_by("at", F.struct("off", "v")).alias("at")).collect())
    return [sorted({r["at"] for r in held if r["slot"] == s}) for s in sorted(slots)]


def cells_of(df: DataFrame, values: Sequence[str], cuts: Sequence[Sequence[float]], indices: Sequence[str], label: str,
             weight: str) -> tuple[DataFrame, list[str]]:
    """One row per distinct ranges ``c0…`` of the values and categories, label ``y`` and weight ``w``, with its number of rows ``n``."""
    codes = [count_less(list(c), F.col(v)) for v, c in zip(values, cuts)] + [F.col(i) for i in indices]
    names = [f"c{i}" for i in range(len(codes))]
    coded = df.select(*[c.cast("int").alias(n) for c, n in zip(codes, names)], F.col(label).cast("int").alias("y"), F.col(weight).alias("w"))
    return written(coded.groupBy(*names, "y", "w").agg(F.count(F.lit(1)).alias("n")), "cells"), names


def packed(cells: DataFrame, names: Sequence[str], kind: str) -> DataFrame:
    """The cells in one order, ``BLOCK`` to a row: ``part, nth, codes, y, w, n`` as bytes, codes cell by cell."""
    schema = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("codes", pa.binary()), ("y", pa.binary()), ("w", pa.binary()), ("n", pa.binary())])
    names = list(names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                s = b.slice(at, BLOCK)
                col = lambda c, t: s.column(c).to_numpy(zero_copy_only=False).astype(t)
                yield pa.RecordBatch.from_pydict({
                    "part": [part], "nth": [nth], "codes": [np.stack([col(c, kind) for c in names], axis=1).tobytes()],
                    "y": [col("y", "u1").tobytes()], "w": [col("w", "<f8").tobytes()], "n": [col("n", "<i8").tobytes()]}, schema=schema)
                nth += 1

    return written(cells.orderBy(*names, "y", "w").mapInArrow(pack, "part int, nth int, codes binary, y binary, w binary, n binary"), "packed")


class Shape:
    """The bins of each code column, and the features and splits they offer."""

    def __init__(self, cuts: Sequence[Sequence[float]], slots: Sequence[int]):
        self.cuts, self.slots = [list(c) for c in cuts], list(slots)
        self.bins = [len(c) + 1 for c in self.cuts] + [s + 1 for s in self.slots]
        self.features = len(self.cuts) + sum(self.slots)
        feature, column, code, value = [], [], [], []  # of every split; a range goes left up to its code, a category unless it is its code
        for c, points in enumerate(self.cuts):
            for k, t in enumerate(points):
                feature.append(c), column.append(c), code.append(k), value.append(t)
        first = len(self.cuts)
        for c, s in enumerate(self.slots):
            for v in range(s):
                feature.append(first + v), column.append(len(self.cuts) + c), code.append(v), value.append(0.5)
            first += s
        self.feature, self.column, self.code, self.value = (np.array(x, t) for x, t in ((feature, "i8"), (column, "i8"), (code, "i8"), (value, "f8")))


def _sides(hists: Sequence[np.ndarray], shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Class weights left and right of every split: (nodes, splits, 2) each; an empty side is exactly 0."""
    left, right = [], []
    for c, h in enumerate(hists):
        if c < len(shape.cuts):
            left.append(np.cumsum(h, axis=1)[:, :-1])
            right.append(np.cumsum(h[:, ::-1], axis=1)[:, ::-1][:, 1:])
        else:
            there = h.sum(axis=2) > 0
            others = (there.sum(axis=1)[:, None] - there[:, :-1]) > 0
            left.append(np.where(others[:, :, None], np.maximum(h.sum(axis=1)[:, None] - h[:, :-1], 0.0), 0.0))
            right.append(h[:, :-1])
    return np.concatenate(left, axis=1), np.concatenate(right, axis=1)


def _gini(stats: np.ndarray) -> np.ndarray:
    total = stats.sum(axis=-1)
    return 1.0 - ((stats / np.maximum(total, 1e-300)[..., None]) ** 2).sum(axis=-1)


def grow(codes: np.ndarray, y: np.ndarray, w: np.ndarray, n: np.ndarray, shape: Shape, depth: int, subset: int,
         bootstrap: bool, rng: np.random.Generator) -> list[list]:
    """One tree's nodes, parents first: ``[stats, impurity, raw count, gain, left, right, split]`` (a leaf's split is -1)."""
    parts, root, raw = [], np.zeros(2), 0
    for at in range(0, len(n), BLOCK):
        drawn = rng.poisson(n[at:at + BLOCK]) if bootstrap else n[at:at + BLOCK]
        rows = np.flatnonzero(drawn)
        if len(rows):
            d = drawn[rows]
            rows += at
            weight = w[rows] * d
            root += np.bincount(y[rows], weight, 2)
            raw += int(d.sum())
            parts.append([rows.astype("i4"), weight, d.astype("f8"), np.zeros(len(rows), "i4")])
    nodes: list[list] = [[root, float(_gini(root)), raw, -1.0, -1, -1, -1]]
    level = [0] if raw and depth > 0 and nodes[0][1] > 1e-15 else []
    for d in range(depth):
        if not level:
            break
        many = len(level)
        hists = [np.zeros(many * b * 2) for b in shape.bins]
        for rows, weight, _, node in parts:
            at, label, own = 2 * node.astype("i8"), y[rows], codes[rows]
            for c, b in enumerate(shape.bins):
                hists[c] += np.bincount(at * b + (2 * own[:, c].astype("i8") + label), weight, len(hists[c]))
        left, right = _sides([h.reshape(many, b, 2) for h, b in zip(hists, shape.bins)], shape)
        wl, wr = left.sum(axis=2), right.sum(axis=2)
        total = np.maximum(wl + wr, 1e-300)
        parent = np.array([nodes[i][1] for i in level])
        gain = parent[:, None] - (wl * _gini(left) + wr * _gini(right)) / total
        gain[(wl <= 0) | (wr <= 0)] = -np.inf
        if subset < shape.features:
            seen = np.zeros((many, shape.features), bool)
            np.put_along_axis(seen, np.argpartition(rng.random((many, shape.features)), subset - 1, axis=1)[:, :subset], True, axis=1)
            gain[~seen[:, shape.feature]] = -np.inf
        best = gain.argmax(axis=1) if gain.shape[1] else np.zeros(many, "i8")
        splits = np.array([gain.shape[1] > 0 and gain[i, b] > 0 for i, b in enumerate(best)], bool)
        # where a code goes from a node: 0 left, 1 right; rows of nodes that stay leaves are dropped
        column = np.where(splits, shape.column[best] if len(shape.column) else 0, 0)
        code = np.where(splits, shape.code[best] if len(shape.code) else 0, 0)
        is_range = column < len(shape.cuts)
        children = np.zeros(2 * many)
        for part in parts:
            rows, weight, times, node = part
            if not splits.all():
                stay = splits[node]
                rows, weight, times, node = rows[stay], weight[stay], times[stay], node[stay]
            value = codes.ravel()[rows.astype("i8") * codes.shape[1] + column[node]]
            goes = np.where(is_range[node], value > code[node], value == code[node])
            child = 2 * node + goes
            children += np.bincount(child, times, 2 * many)
            part[:] = rows, weight, times, child.astype("i4")
        following, place = [], np.full(2 * many, -1, "i4")
        for i in np.flatnonzero(splits):
            b = best[i]
            me = nodes[level[i]]
            me[3:7] = float(gain[i, b]), len(nodes), len(nodes) + 1, int(b)
            for side, stats in enumerate((left[i, b], right[i, b])):
                impurity = float(_gini(stats))
                if d + 1 < depth and impurity > 1e-15:
                    place[2 * i + side] = len(following)
                    following.append(len(nodes))
                nodes.append([stats.copy(), impurity, int(children[2 * i + side]), -1.0, -1, -1, -1])
        for part in parts:
            node = place[part[3]]
            stay = node >= 0
            part[:] = part[0][stay], part[1][stay], part[2][stay], node[stay]
        parts, level = [p for p in parts if len(p[0])], following
    return nodes


def _merged(nodes: list[list]) -> list[list]:
    """Siblings that are leaves and predict alike become one leaf, from below; then the nodes in preorder."""
    says = lambda x: int(x[0][1] > x[0][0])
    for x in reversed(nodes):  # children stand after their parent
        if x[6] >= 0 and nodes[x[4]][6] < 0 and nodes[x[5]][6] < 0 and says(nodes[x[4]]) == says(nodes[x[5]]):
            x[3:7] = -1.0, -1, -1, -1
    out: list[list] = []
    waiting: list[tuple] = [(0, None, 0)]
    while waiting:
        i, parent, side = waiting.pop()
        if parent is not None:
            parent[side] = len(out)
        x = list(nodes[i])
        out.append(x)
        if x[6] >= 0:
            waiting += [(x[5], x, 5), (x[4], x, 4)]
    return out


def trees(blocks: DataFrame, columns: int, kind: str, shape: Shape, n_trees: int, depth: int, subset: int, bootstrap: bool, seed: int) -> DataFrame:
    """The nodes of all trees; each task takes the cells once and grows ``TASK_TREES`` of them."""
    tasks = -(-n_trees // TASK_TREES)
    schema = pa.schema([("treeID", pa.int32()), ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()),
                        ("impurityStats", pa.list_(pa.float64())), ("rawCount", pa.int64()), ("gain", pa.float64()),
                        ("leftChild", pa.int32()), ("rightChild", pa.int32()), ("featureIndex", pa.int32()),
                        ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for b in batches:
            for task, part, nth, *data in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                held.setdefault(task, []).append((part, nth, *data))
        for task in sorted(held):
            own = sorted(held.pop(task), key=lambda x: x[:2])
            codes, y, w, n = (np.concatenate([np.frombuffer(x[i], t) for x in own]) for i, t in ((2, kind), (3, "u1"), (4, "<f8"), (5, "<i8")))
            codes = codes.reshape(-1, columns)
            del own
            for tree in range(task * TASK_TREES, min(n_trees, (task + 1) * TASK_TREES)):
                rng = np.random.default_rng([seed & 0xFFFFFFFF, tree])
                rows = _merged(grow(codes, y, w, n, shape, depth, subset, bootstrap, rng))
                split = [x[6] for x in rows]
                yield pa.RecordBatch.from_pydict({
                    "treeID": [tree] * len(rows), "id": list(range(len(rows))), "prediction": [float(x[0][1] > x[0][0]) for x in rows],
                    "impurity": [x[1] for x in rows], "impurityStats": [x[0].tolist() for x in rows], "rawCount": [x[2] for x in rows],
                    "gain": [x[3] for x in rows], "leftChild": [x[4] for x in rows], "rightChild": [x[5] for x in rows],
                    "featureIndex": [int(shape.feature[s]) if s >= 0 else -1 for s in split],
                    "leftCategoriesOrThreshold": [[float(shape.value[s])] if s >= 0 else [] for s in split],
                    "numCategories": [-1] * len(rows)}, schema=schema)

    dealt = blocks.sparkSession.range(0, tasks, 1, tasks).select(F.col("id").cast("int").alias("task")).crossJoin(F.broadcast(blocks))
    return written(dealt.select("task", "part", "nth", "codes", "y", "w", "n").mapInArrow(run, _NODES), "trees")


def _model(estimator: RandomForestClassifier, nodes: DataFrame, features: int) -> RandomForestClassificationModel:
    """Spark's model of the trees: one of the same parameters fitted on two rows is saved, and read back with these nodes."""
    spark = nodes.sparkSession
    label, weight = estimator.getLabelCol(), estimator.getWeightCol()
    two = spark.createDataFrame([(float(i), 1.0, Vectors.dense([float(i)] * features)) for i in range(2)],
                                [label, weight, estimator.getFeaturesCol()]).coalesce(1)
    path = f"{run_folder(spark)}/forest-{uuid.uuid4().hex}"
    estimator.fit(two).write().save(path)
    names = [c for c in nodes.columns if c not in ("treeID", "featureIndex", "leftCategoriesOrThreshold", "numCategories")]
    split = F.struct("featureIndex", "leftCategoriesOrThreshold", "numCategories").alias("split")
    nodes.select("treeID", F.struct(*names, split).alias("nodeData")).write.mode("overwrite").parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)


def fit(df: DataFrame, estimator: RandomForestClassifier, values: str, indices: Sequence[str], slots: Sequence[int]) -> RandomForestClassificationModel | None:
    """A forest of ``estimator``'s parameters over ``df``'s scaled numbers (vector ``values``) and category ``indices`` (of
    ``slots`` one-hot slots each), or None where this way doesn't apply: few rows, other labels than 0 and 1 or only one
    of them, no positive weights, more than ``MAX_CELLS`` cells."""
    label = estimator.getLabelCol()
    weight = estimator.getWeightCol() if estimator.isDefined("weightCol") else None
    if not weight or max(slots, default=0) >= MAX_CODES - 1 or estimator.getSubsamplingRate() != 1.0:
        return None
    y, w = F.col(label), F.col(weight)
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(y.isin(0.0, 1.0) & (w > 0)).alias("good"), F.count_if(y == 1.0).alias("positive")).first()
    if seen["n"] < MIN_ROWS or seen["good"] < seen["n"] or seen["positive"] in (0, seen["n"]):
        return None
    array, plain = vector_to_array(values), [f"_v{i}" for i in range(df.schema[values].metadata["ml_attr"]["num_attrs"])]
    numbers = written(df.select(*[array[i].alias(c) for i, c in enumerate(plain)], *indices, label, weight), "numbers")
    cuts = split_points(numbers, plain, weight, estimator.getMaxBins())
    cells, names = cells_of(numbers, plain, cuts, indices, label, weight)
    if cells.count() > MAX_CELLS:
        return None
    shape = Shape(cuts, slots)
    kind = "u1" if max(shape.bins) <= 256 else "<u2"
    n_trees = estimator.getNumTrees()
    subset = shape.features if n_trees == 1 else math.ceil(math.sqrt(shape.features))
    nodes = trees(packed(cells, names, kind), len(names), kind, shape, n_trees, estimator.getMaxDepth(), subset, estimator.getBootstrap(), estimator.getSeed())
    return _model(estimator, nodes, shape.features)


def _compact(model: RandomForestClassificationModel) -> list[tuple[np.ndarray, ...]] | None:
    """Per tree (feature, threshold, children, class shares, steps), a leaf being its own child; None with a category split that
    is no 0/1 slot."""
    spark = SparkSession.active()
    path = f"{run_folder(spark)}/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    rows = (spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").select("treeID", "id", "leftChild", "rightChild", "impurityStats", "split.*")
            .toArrow().sort_by([("treeID", "ascending"), ("id", "ascending")]))
    col = {c: rows.column(c).combine_chunks() for c in rows.column_names}
    tree, left, right, feature, arity = (col[c].to_numpy() for c in ("treeID", "leftChild", "rightChild", "featureIndex", "numCategories"))
    stats = col["impurityStats"].flatten().to_numpy().reshape(len(tree), -1)
    inner = left >= 0
    first = np.full(len(tree), 0.5)
    many = np.diff(col["leftCategoriesOrThreshold"].offsets.to_numpy())
    if stats.shape[1] != 2 or (many[inner] != 1).any() or (arity[inner] > 2).any():
        return None
    first[inner] = col["leftCategoriesOrThreshold"].flatten().to_numpy()
    category = inner & (arity >= 0)
    swapped = category & (first == 1.0)  # the slot's ones go left
    left, right = np.where(swapped, right, left), np.where(swapped, left, right)
    first[category | ~inner] = 0.5
    out = []
    for at in np.split(np.arange(len(tree)), np.flatnonzero(np.diff(tree)) + 1):
        own = np.arange(len(at))
        ends = left[at] < 0
        children = np.stack([np.where(ends, own, left[at]), np.where(ends, own, right[at])], axis=1)
        depth = np.zeros(len(at), "i4")
        for i in np.flatnonzero(~ends):  # parents come first
            depth[children[i]] = depth[i] + 1
        total = stats[at].sum(axis=1)
        shares = np.where(total[:, None] > 0, stats[at] / np.where(total > 0, total, 1.0)[:, None], 0.0)
        out.append((np.where(ends, 0, feature[at]).astype("i8"), first[at], children.ravel().astype("i8"), shares, int(depth.max())))
    return out


def probability(model: RandomForestClassificationModel, features: Column) -> Column | None:
    """``model``'s probability of label 1 for the array column ``features``: its own sums in its own order, a step of one tree
    for many rows at once; None where ``_compact`` knows no way."""
    compact = _compact(model)
    if compact is None:
        return None

    def of(v: pa.Array) -> pa.Array:
        offsets = v.offsets.to_numpy()
        x = v.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]].reshape(len(v), -1) if len(v) else np.zeros((0, 1))
        votes = np.zeros((len(v), 2))
        row = np.arange(len(v)) * x.shape[1]
        flat = x.ravel()
        for feature, threshold, children, shares, steps in compact:
            node = np.zeros(len(v), "i8")
            for _ in range(steps):
                node = children[2 * node + ~(flat[row + feature[node]] <= threshold[node])]
            votes += shares[node]
        total = votes.sum(axis=1)
        return pa.array(np.where(total > 0, votes[:, 1] / np.where(total > 0, total, 1.0), votes[:, 1]))

    of.__annotations__ = {"v": pa.Array, "return": pa.Array}
    return F.arrow_udf(of, "double")(features)
