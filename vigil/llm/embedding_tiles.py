"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors are scaled to length 1 and rotated by the principal axes of a bounded
sample (any rotation is right; the axes only decide how early a comparison
ends).  Ordered by the first axis they are cut into blocks, and block pairs are
compared whose intervals on that axis are within reach: two unit vectors with
cosine >= t are at most sqrt(2 - 2t) apart on every axis.

In a pair of blocks the leading dimensions are multiplied first; the rest of a
product is at most the product of the two suffix norms.  Pairs that cannot
reach the threshold stop there; the others take the next dimensions, and what
is left is decided by the double-precision cosine of the original vectors.

A block pair returns how many links each vector has in it and a spanning forest
of its links, never the links themselves; degrees are summed and components are
found over the forests.  Blocks stand still or move: of each pair one block
receives the other (in turn, so that none receives all), and a task streams
the arriving blocks past the one it holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigil.llm.common import connected_components, materialize

THRESHOLD = 0.9
BLOCK_BYTES = 4 << 20  # of a block's vectors in double precision; what a task holds is a few times that
SAMPLE = 4096  # vectors for the axes
_SAFE = 1e-4  # allowance for single precision in the bound
_PAIRS = 1 << 16  # candidate pairs verified at once


def _valid(c: str):
    v = F.col(c)
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ok & F.exists(v, lambda x: x != 0), F.lit(False))


def principal_axes(vectors: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Axes (as columns, strongest first) by dimension, from at most ``sample`` vectors."""
    n = vectors.count()
    if not n:
        return {}
    share = min(1.0, sample / n)
    rows = (vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))
            .select("v").limit(2 * sample).collect())
    axes = {}
    for d in {len(r["v"]) for r in rows}:
        x = np.array([r["v"] for r in rows if len(r["v"]) == d])
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        _, u = np.linalg.eigh(x.T @ x)
        axes[d] = u[:, ::-1]
    return axes


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow or underflow on the way."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def blocks(vectors: DataFrame, axes: dict[int, np.ndarray], block: int, kind: str = "<f8") -> DataFrame:
    """(block, dim, lo, hi, ids, vals): vectors in order of their first coordinate, ``block`` to a row; components as ``kind``."""
    n = max(1, -(-vectors.count() // block))

    def first(batches):
        for b in batches:
            lists = b.column(1).to_pylist()
            at = []
            for v in lists:
                d = len(v)
                u = unit(np.array([v]))[0]
                at.append(float(u @ axes[d][:, 0]) if d in axes else float(u[0]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.float64())),
                                              pa.array([len(v) for v in lists], pa.int32()), pa.array(at, pa.float64())],
                                             names=["vec_id", "v", "dim", "at"])

    placed = materialize(vectors.mapInArrow(first, "vec_id long, v array<double>, dim int, at double"), "vectors")
    spread = placed.withColumn("tie", F.xxhash64("vec_id"))  # equal vectors must not share a partition
    sorted_ = spread.repartitionByRange(n, "dim", "at", "tie").sortWithinPartitions("dim", "at", "tie")

    def cut(batches):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def rows(flush):
            nonlocal k, held
            while held and (len(held) >= block or flush or held[-1][1] != held[0][1]):
                d = held[0][1]
                m = next((i for i, r in enumerate(held) if r[1] != d), len(held))
                m = min(m, block)
                if m == len(held) < block and not flush:
                    return
                own, held = held[:m], held[m:]
                yield pa.RecordBatch.from_pydict({
                    "block": [(part << 20) | k], "dim": [d], "lo": [own[0][2]], "hi": [own[-1][2]],
                    "ids": [np.array([r[0] for r in own], "<i8").tobytes()],
                    "vals": [np.array([r[3] for r in own], kind).tobytes()]}, schema=cut_schema)
                k += 1

        for b in batches:
            held += zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("vec_id", "dim", "at", "v")))
            yield from rows(False)
        yield from rows(True)

    cut_schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()),
                            ("ids", pa.binary()), ("vals", pa.binary())])
    made = sorted_.select("vec_id", "dim", "at", "v").mapInArrow(
        cut, "block long, dim int, lo double, hi double, ids binary, vals binary")
    return materialize(made, "blocks")


def block_pairs(made: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(home, guest): block pairs within reach of each other, each once, a block with itself included.

    An equi-join over cells of the axis as long as the reach: a block stands in
    the cells of its interval, and looks in those of its interval widened."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + _SAFE
    cell = max(reach, 0.05)
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell)))
    small = made.select("block", "dim", "lo", "hi")
    a = small.select(F.col("block").alias("a"), F.col("dim").alias("a_dim"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"),
                     cells(F.col("lo"), F.col("hi")).alias("a_cell"))
    b = small.select(F.col("block").alias("b"), "dim", "lo", "hi", cells(F.col("lo") - reach, F.col("hi") + reach).alias("cell"))
    near = a.join(b, (F.col("a_cell") == F.col("cell")) & (F.col("a_dim") == F.col("dim")) & (F.col("a") <= F.col("b"))
                  & (F.col("lo") - reach <= F.col("a_hi")) & (F.col("a_lo") <= F.col("hi") + reach))
    pairs = near.select("a", "b").distinct()
    odd = F.pmod(F.xxhash64("a", "b"), F.lit(2)) == 1
    return pairs.select(F.when(odd, F.col("a")).otherwise(F.col("b")).alias("home"),
                        F.when(odd, F.col("b")).otherwise(F.col("a")).alias("guest"))


class _Block:
    def __init__(self, ids: bytes, vals: bytes, dim: int, axes: dict[int, np.ndarray]):
        self.ids = np.frombuffer(ids, "<i8")
        kind = "<f4" if len(vals) == 4 * dim * len(self.ids) else "<f8"
        self.unit = unit(np.frombuffer(vals, kind).reshape(-1, dim).astype(float))
        turned = (self.unit @ axes[dim] if dim in axes else self.unit)
        self.turned = turned.astype(np.float32)
        rest = np.sqrt(np.maximum(0, np.cumsum((turned ** 2)[:, ::-1], axis=1)[:, ::-1]))
        self.rest = np.concatenate([rest, np.zeros((len(turned), 1))], axis=1).astype(np.float32)  # norm from dimension k on


def compare(a: _Block, b: _Block, threshold: float):
    """Index pairs with cosine >= threshold, in parts: candidates by leading dimensions, then exactly."""
    dim = a.unit.shape[1]
    lead = max(1, dim // 4)
    x = np.concatenate([a.turned[:, :lead], a.rest[:, lead:lead + 1]], axis=1)  # the last column is the bound of the rest
    y = np.concatenate([b.turned[:, :lead], b.rest[:, lead:lead + 1]], axis=1)
    step = max(1, (1 << 21) // max(1, len(b.ids)))
    for s in range(0, len(a.ids), step):
        hot = x[s:s + step] @ y.T >= threshold - _SAFE
        i, j = np.nonzero(hot)
        i += s
        for t in range(0, len(i), _PAIRS):
            p, q = i[t:t + _PAIRS], j[t:t + _PAIRS]
            done, got = lead, np.einsum("ij,ij->i", a.turned[p, :lead], b.turned[q, :lead])
            while done < dim and len(p):  # more dimensions, while the rest may still decide
                more = min(dim, 2 * done)
                got = got + np.einsum("ij,ij->i", a.turned[p, done:more], b.turned[q, done:more])
                alive = got + a.rest[p, more] * b.rest[q, more] >= threshold - _SAFE
                p, q, got, done = p[alive], q[alive], got[alive], more
            exact = np.einsum("ij,ij->i", a.unit[p], b.unit[q]) >= threshold
            yield p[exact], q[exact]


def _links(home: _Block, guest: _Block, same: bool, threshold: float):
    """(degrees of home, degrees of guest, forest edges as ids) of one block pair."""
    up, down = np.zeros(len(home.ids), np.int64), np.zeros(len(guest.ids), np.int64)
    root = list(range(len(home.ids) + (0 if same else len(guest.ids))))
    off = 0 if same else len(home.ids)

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    edges = []
    for p, q in compare(home, guest, threshold):
        if same:
            p, q = p[p < q], q[p < q]
        np.add.at(up, p, 1)
        np.add.at(up if same else down, q, 1)
        for v, w in zip(p.tolist(), (q + off).tolist()):
            v_, w_ = find(v), find(w)
            if v_ != w_:
                root[w_] = v_
                edges.append((v, w))
    ids = home.ids if same else np.concatenate([home.ids, guest.ids])
    return up, down, [(int(ids[v]), int(ids[w])) for v, w in edges]


def block_links(made: DataFrame, pairs: DataFrame, axes: dict[int, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, other, n): links of vec_id within one block pair (other null), or an edge of its forest (n 0)."""
    stays = made.select(F.col("block").alias("home"), F.lit(0).alias("turn"), "block", "dim", "ids", "vals")
    comes = pairs.where("home <> guest").join(made, F.col("guest") == F.col("block")).select(
        "home", F.lit(1).alias("turn"), "block", "dim", "ids", "vals")
    dealt = stays.unionByName(comes).repartition("home").sortWithinPartitions("home", "turn", "block")

    def run(batches):
        at, own = None, None
        for b in batches:
            ids, other, n = [], [], []
            for r in range(b.num_rows):
                home, turn, _, dim, key, vals = (b.column(c)[r].as_py() for c in range(6))
                block = _Block(key, vals, dim, axes)
                if turn == 0:
                    at, own = home, block
                assert at == home
                up, down, edges = _links(own, block, turn == 0, threshold)
                for held, degree in ((own, up), (block, down)):
                    k = np.nonzero(degree)[0]
                    ids += held.ids[k].tolist()
                    n += degree[k].tolist()
                    other += [None] * len(k)
                ids += [e[0] for e in edges]
                other += [e[1] for e in edges]
                n += [0] * len(edges)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(other, pa.int64()), pa.array(n, pa.int64())],
                                             names=["vec_id", "other", "n"])

    return materialize(dealt.mapInArrow(run, "vec_id long, other long, n long"), "links")


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, block: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``embeddings(vec_id, embedding, ...)``.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, nor do vectors of different dimensions.  Rows that repeat
    a vec_id are one vector each, count as links of each other if near, and share
    what is returned for their id; a null vec_id links with nothing.  Columns
    besides these two are not read; an empty table gives no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    good = rows.where(_valid("v") & F.col("vec_id").isNotNull())
    axes = principal_axes(good, sample)
    # components travel as they were given: single precision is half as long and exact
    kind = "<f4" if embeddings.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    made = blocks(good, axes, block or max(64, BLOCK_BYTES // (8 * max(axes, default=1))), kind)
    links = block_links(made, block_pairs(made, threshold), axes, threshold)
    degree = links.where("n > 0").groupBy("vec_id").agg(F.sum("n").alias("n_links")).withColumnRenamed("vec_id", "d_id")
    comp = connected_components(links.where("n = 0").select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    out = rows.select("vec_id").join(degree, F.col("vec_id") == F.col("d_id"), "left").join(comp, F.col("vec_id") == F.col("node"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component", "vec_id").alias("component_id"),
                      F.coalesce(F.col("component") == F.col("vec_id"), F.lit(True)).alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
         WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.9),
reach(node, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT node, b FROM reach JOIN link ON other = a),
deg AS (SELECT a, count(*) AS n FROM link GROUP BY a),
comp AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN comp ON node = vec_id LEFT JOIN deg ON a = vec_id
"""
