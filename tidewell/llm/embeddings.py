"""Embedding near-duplicates by spherical-cap filters: structured random product codes.

A filter is a direction; a vector belongs to it if their inner product reaches `alpha`. Directions
are concatenations of codewords, one from a small random code for each block of (rotated)
coordinates, so the filters that a vector exceeds are list-decoded from its blocks' scores without
looking at the others; a vector in an empty corner takes its `LEAST` best filters anyway. `alpha` is
set by simulating pairs right at the threshold, the hardest ones: `RECALL` of them share a filter by
`alpha` alone, more with the best filters, and closer pairs nearly always do. Pairs that meet in a
filter are verified in double precision.

Equal vectors form one class first. Members of a filter meet in cells of at most two blocks of
`BLOCK` classes; filters that hold more are cut into blocks, every two of which have a cell, so no filter
makes one task large. A pair that shares several filters counts in the first one alone, which both
members' decoded lists tell; thus a cell returns a sum and a local component for each member, and
no pair leaves it.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows
with a null id. Vectors of different lengths don't link. Repeated rows are vectors of their own. Columns
besides the id and the vector aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import content_key, cut
from tidewell.llm.components import connected_components

THRESHOLD = 0.9
RECALL = 0.98
#: Filters that every vector takes at least.
LEAST = 16
#: Blocks of coordinates, the mean number of classes that a filter should hold, and classes in a block of a cell.
CODE_BLOCKS, LOAD, BLOCK = 2, 384, 1024
SEED = 20240229
#: Filters over BLOCK members, up to so many of which are broadcast.
BROADCAST_ROWS = 100_000


class ProductCode:
    """Random codes for vectors of one length: `words` codewords for each of the blocks."""

    def __init__(self, dim: int, words: int, threshold: float, recall: float = RECALL):
        rng = np.random.default_rng([SEED, dim, words])
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.blocks = np.array_split(np.arange(dim), min(CODE_BLOCKS, dim))
        codes = [rng.normal(size=(words, len(b))) for b in self.blocks]
        self.codes = [c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(len(self.blocks)) for c in codes]
        self.words, self.least = words, 0
        v = rng.normal(size=(600, dim))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        w = rng.normal(size=v.shape)
        w -= (w * v).sum(axis=1, keepdims=True) * v
        norm = np.linalg.norm(w, axis=1, keepdims=True)
        w = threshold * v + math.sqrt(1 - threshold**2) * w / np.where(norm < 1e-9, 1, norm)
        low, high = -1.01, 1.0
        for _ in range(14):
            self.alpha = (low + high) / 2
            both = sum(bool(np.intersect1d(a, b, assume_unique=True).size) for a, b in zip(self.decode(v), self.decode(w), strict=True))
            low, high = (self.alpha, high) if both >= recall * len(v) else (low, self.alpha)
        self.alpha, self.least = low, LEAST
        self.mean_keys = float(np.mean([len(x) for x in self.decode(v[:200])]))

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """Sorted filter numbers of each unit vector, whatever other vectors are decoded beside it."""
        # einsum adds up in one order always; BLAS may not, and a list must come out alike wherever it is made.
        r = np.einsum("ij,jk->ik", unit, self.rotation)
        scores = [np.einsum("ij,kj->ik", r[:, b], c) for b, c in zip(self.blocks, self.codes, strict=True)]
        halves = []
        for part in (scores[: (len(scores) + 1) // 2], scores[(len(scores) + 1) // 2 :]):
            h = np.zeros((len(r), 1))
            for s in part:
                h = (h[:, :, None] + s[:, None, :]).reshape(len(r), -1)
            halves.append(h)
        left, right = halves
        best_left, best_right = left.max(axis=1), right.max(axis=1)
        out = []
        for i in range(len(r)):
            a = np.flatnonzero(left[i] >= self.alpha - best_right[i])
            b = np.flatnonzero(right[i] >= self.alpha - best_left[i])
            x, y = np.nonzero(left[i, a][:, None] + right[i, b][None, :] >= self.alpha)
            if len(x) < self.least:
                a, b = np.argsort(-left[i], kind="stable")[: self.least], np.argsort(-right[i], kind="stable")[: self.least]
                best = np.argsort(-(left[i, a][:, None] + right[i, b][None, :]), axis=None, kind="stable")[: self.least]
                x, y = np.unravel_index(best, (len(a), len(b)))
            out.append(np.sort(a[x].astype(np.int64) * right.shape[1] + b[y]))
        return out


@lru_cache(maxsize=8)
def product_code(dim: int, words: int, threshold: float) -> ProductCode:
    return ProductCode(dim, words, threshold)


def words_for(n: int, dim: int) -> int:
    """Codewords per block so that n classes fill filters with about LOAD of them each, at some 24 filters for a vector."""
    return max(2, round((n * 24 / LOAD) ** (1 / min(CODE_BLOCKS, max(dim, 1)))))


def unit_rows(vectors: list[bytes], dtype: str) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), dtype).reshape(len(vectors), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that neither huge nor tiny components spoil the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def meet(unit: np.ndarray, weight: np.ndarray, block: np.ndarray, key: int, code: ProductCode, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, links by weight, least member of its local component) for the linked members of one cell of filter `key`."""
    n = len(unit)
    whole = block.min() == block.max()
    rows, cols = [], []
    for i in range(0, n, BLOCK):
        for j in range(0, i + 1, BLOCK):
            r, c = np.nonzero(unit[i : i + BLOCK] @ unit[j : j + BLOCK].T >= threshold)
            r, c = r + i, c + j
            ok = r > c
            if not whole:
                ok &= block[r] != block[c]
            rows.append(r[ok])
            cols.append(c[ok])
    r, c = np.concatenate(rows), np.concatenate(cols)
    if not len(r):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
    linked, inverse = np.unique(np.concatenate([r, c]), return_inverse=True)
    r, c = inverse[: len(r)], inverse[len(r) :]
    root = np.arange(len(linked))
    while True:  # least label of the neighbours, with pointer jumping
        before = root.copy()
        np.minimum.at(root, r, root[c])
        np.minimum.at(root, c, root[r])
        root = root[root]
        if (root == before).all():
            break
    lists = [x[x < key] for x in code.decode(unit[linked])]
    lower = np.unique(np.concatenate(lists))
    first = np.ones(len(r), bool)
    member = np.zeros((len(linked), 2048), np.float32)
    for at in range(0, len(lower), 2048):  # do they also meet in an earlier filter?
        part = lower[at : at + 2048]
        member[:] = 0
        for i, x in enumerate(lists):
            x = x[(x >= part[0]) & (x <= part[-1])]
            member[i, np.searchsorted(part, x)] = 1
        first &= (member @ member.T)[r, c] == 0
    total = np.zeros(len(linked), np.int64)
    np.add.at(total, r[first], weight[linked[c[first]]])
    np.add.at(total, c[first], weight[linked[r[first]]])
    return linked, total, linked[root]


def _prepare(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, str]:
    """(vec_id, vec: bytes, or null where it can't link; dim), and the bytes' dtype."""
    dtype = "float32" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "float64"

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out, dims = [], []
            for i, v in zip(b.column(0), b.column(1), strict=True):
                x = None
                if i.is_valid and v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(dtype)
                    if not np.isfinite(x).all() or not x.any():
                        x = None
                out.append(None if x is None else x.tobytes())
                dims.append(0 if x is None else len(x))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), pa.array(dims, pa.int32())], names=["vec_id", "vec", "dim"])

    typed = F.col(vec_col) if dtype == "float32" else F.col(vec_col).cast("array<double>")
    return vectors.select(F.col(id_col).cast("long"), typed).mapInArrow(run, "vec_id bigint, vec binary, dim int"), dtype


def linked_classes(classes: DataFrame, dtype: str, sizes: dict[int, int], threshold: float) -> DataFrame:
    """(cid, n: weight of the classes it links to, root: a class of its local component), several rows for a class."""
    words = {d: words_for(n, d) for d, n in sizes.items()}

    def filters(batches):
        import pyarrow as pa

        for b in batches:
            dims = b.column(3).to_numpy()
            for d in np.unique(dims):
                part = np.flatnonzero(dims == d)
                vec = [b.column(2)[int(i)].as_py() for i in part]
                for at in range(0, len(part), 512):
                    lists = product_code(int(d), words[int(d)], threshold).decode(unit_rows(vec[at : at + 512], dtype))
                    who = np.repeat(part[at : at + 512], [len(x) for x in lists])
                    if len(who):
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists)), *(b.column(k).take(pa.array(who)) for k in range(4))], names=["key", "cid", "cnt", "vec", "dim"])

    def cell(key, table):
        import pyarrow as pa

        dim, k = key[0].as_py(), key[1].as_py()
        unit = unit_rows(table.column("vec").to_pylist(), dtype)
        cid = table.column("cid").to_numpy()
        who, n, root = meet(unit, table.column("cnt").to_numpy(), table.column("block").to_numpy(), k, product_code(dim, words[dim], threshold), threshold)
        return pa.table({"cid": pa.array(cid[who], pa.int64()), "n": pa.array(n, pa.int64()), "root": pa.array(cid[root], pa.int64())})

    member = classes.select("cid", "cnt", "vec", "dim").mapInArrow(filters, "key bigint, cid bigint, cnt bigint, vec binary, dim int")
    held = cut(member.groupBy("dim", "key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"))
    large = held.filter(F.col("held") > 2 * BLOCK).select("dim", "key", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks"))
    large = F.broadcast(large) if large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else large
    placed = member.join(large, ["dim", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks").cast("long")).cast("int"))
    cells = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).withColumn("a", F.least("block", "other")).withColumn("b", F.greatest("block", "other"))
    return cells.select("dim", "key", "a", "b", "cid", "cnt", "vec", "block").groupBy("dim", "key", "a", "b").applyInArrow(cell, "cid bigint, n bigint, root bigint")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (least id reachable by links), kept (it is that one)."""
    prepared, dtype = _prepare(vectors, id_col, vec_col)
    k1, k2 = content_key(F.col("vec"))
    prepared = cut(prepared.select("vec_id", "vec", "dim", k1.alias("k1"), k2.alias("k2")))
    able = prepared.filter("vec is not null")
    grouped = cut(able.groupBy("k1", "k2", "vec", "dim").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("cnt")))
    classes = grouped.withColumn("cid", F.monotonically_increasing_id())  # stable, as the checkpoint is
    sizes = {r["dim"]: r["n"] for r in grouped.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = cut(linked_classes(classes, dtype, sizes, threshold))
    links = found.groupBy("cid").agg(F.sum("n").alias("others"))
    parts = connected_components(found.filter("cid <> root").select(F.col("cid").alias("u"), F.col("root").alias("v")))
    named = classes.select("cid", "k1", "k2", "rep", "cnt").join(links, "cid", "left").join(parts.withColumnRenamed("id", "cid"), "cid", "left")
    named = cut(named.select("k1", "k2", "rep", F.coalesce("component", "cid").alias("part"), (F.coalesce("others", F.lit(0)) + F.col("cnt") - 1).alias("n_links")))
    least = named.groupBy("part").agg(F.min("rep").alias("component_id"))
    by_vector = named.join(least, "part").select("k1", "k2", "n_links", "component_id")
    out = prepared.select("vec_id", "k1", "k2", (F.col("vec").isNotNull()).alias("able")).join(by_vector, ["k1", "k2"], "left")
    component = F.when(F.col("able"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select(F.col("vec_id").alias(id_col), F.when(F.col("able"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
