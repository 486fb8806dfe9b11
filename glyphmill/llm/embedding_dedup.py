"""Near-duplicate embeddings by product quantisation.

Vectors of equal direction form a class first; one stands for it from there on. Unit vectors are put
into about sqrt(N) inverted lists by their nearest coarse centroid; what remains after the centroid
is coded, SUBSPACES parts of it at a time, by the nearest of at most 256 codewords. Centroids and
codewords are fitted by Lloyd steps on a bounded sample, SAMPLE vectors by hash; every vector is
indexed and every one is a query. A query searches its own list and the next nearest ones, PROBES
lists in all whatever their number; a pair is found if either of its vectors has the other's list
among its own. In a list the distances of a query to all members are sums of looked-up table
entries; a member whose looked-up distance exceeds the search radius by more than the member's own
coding error can't lie within the radius, and all others are compared exactly. Long lists are
divided into blocks of members and of queries, each pair of blocks a group of its own. Pairs are
counted where they are found and never written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grouping
from .common import dropping_shuffles, folder, pick, remove, written

SUBSPACES, WORDS, LLOYD = 8, 256, 6
#: Lists that a vector searches; vectors that the index is fitted on; the most lists.
PROBES, SAMPLE, MOST_LISTS = 12, 1 << 16, 1 << 12


def matrix(column: pa.Array | pd.Series, dim: int) -> np.ndarray:
    """(row, dim) float32 of equally long lists."""
    if isinstance(column, pd.Series):
        return np.stack(column.to_numpy()).astype(np.float32) if len(column) else np.empty((0, dim), np.float32)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def nearest(x: np.ndarray, centres: np.ndarray, block: int = 4096) -> np.ndarray:
    """The nearest centre of each row; the first of equals."""
    half = (centres * centres).sum(1) / 2
    return np.concatenate([(half - x[i : i + block] @ centres.T).argmin(1) for i in range(0, len(x), block)]) if len(x) else np.empty(0, np.int64)


def parts(dim: int) -> list[slice]:
    """Consecutive, nearly equal subspaces, SUBSPACES of them or as many as there are dimensions."""
    m = min(SUBSPACES, dim)
    at = [dim * i // m for i in range(m + 1)]
    return [slice(a, b) for a, b in zip(at, at[1:])]


def encode(residual: np.ndarray, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, subspace) codes, and the length of what the codewords miss."""
    cut = parts(residual.shape[1])
    codes = np.stack([nearest(residual[:, s], w) for s, w in zip(cut, words)], 1)
    missed = sum(((residual[:, s] - w[codes[:, i]]) ** 2).sum(1) for i, (s, w) in enumerate(zip(cut, words)))
    return codes.astype(np.uint8), np.sqrt(missed)


def lookups(residual: np.ndarray, words: list[np.ndarray]) -> list[np.ndarray]:
    """By subspace: squared distances (query, codeword)."""
    cut = parts(residual.shape[1])
    return [((residual[:, s] ** 2).sum(1)[:, None] + (w * w).sum(1)[None, :] - 2 * residual[:, s] @ w.T) for s, w in zip(cut, words)]


def lloyd(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Means of the members of each centre, LLOYD times over; a centre without members stays."""
    for _ in range(LLOYD):
        k = nearest(x, centres)
        n = np.bincount(k, minlength=len(centres))
        order = np.argsort(k, kind="stable")
        sums = np.add.reduceat(x[order], (np.cumsum(n) - n)[n > 0], axis=0) if len(x) else x
        centres = centres.copy()
        centres[n > 0] = sums / n[n > 0][:, None]
    return centres.astype(np.float32)


def fit(sample: np.ndarray, lists: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Coarse centroids, and the codewords of each subspace of what remains after them."""
    coarse = lloyd(sample, sample[:lists])
    left = sample - coarse[nearest(sample, coarse)]
    return coarse, [lloyd(np.ascontiguousarray(left[:, s]), np.ascontiguousarray(left[:WORDS, s])) for s in parts(sample.shape[1])]


def one_dimension(vectors: DataFrame, dim: int, n: int, threshold: float, path: str) -> DataFrame:
    """a, b, links of distinct unit vectors (cls, n, x) of one dimension: for a vector with neighbours (b null) the copies of others within reach, in parts that add up; and (a, b) that hold each connected group together."""
    spark = vectors.sparkSession
    lists = min(MOST_LISTS, math.isqrt(n - 1) + 1)
    # the bound holds on the driver whatever the number of vectors
    sample = vectors.select("x", F.xxhash64(F.lit(3), "cls").alias("u")).orderBy("u").limit(SAMPLE).toPandas()
    handle = spark.sparkContext.broadcast(fit(matrix(sample["x"], dim), lists))
    radius, probes = math.sqrt(2 - 2 * threshold) + 1e-4, min(PROBES, lists)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each list that a vector searches, the own one first; members carry the code."""
        centres, own_words = handle.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                m = part.num_rows
                x = matrix(part.column(2), dim)
                d = (centres * centres).sum(1) - 2 * x @ centres.T
                near = np.argpartition(d, probes - 1, axis=1)[:, :probes] if probes < lists else np.tile(np.arange(lists), (m, 1))
                near = np.take_along_axis(near, np.lexsort((near, np.take_along_axis(d, near, 1))), 1).astype(np.int32)
                codes, missed = encode(x - centres[near[:, 0]], own_words)
                row = np.repeat(np.arange(m), probes)
                first = np.tile(np.arange(probes) == 0, m)
                code = np.where(first, np.array([c.tobytes() for c in codes], dtype=object)[row], None)
                lists_of = pa.ListArray.from_arrays(pa.array(np.arange(0, m * probes + 1, probes, dtype=np.int32)), pa.array(near.ravel()))
                cols = [pa.array(near.ravel()), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), part.column(2).take(pa.array(row)), lists_of.take(pa.array(row)), pa.array(code.tolist(), pa.binary()), pa.array(missed.astype(np.float32)[row])]
                yield pa.RecordBatch.from_arrays(cols, ["list", "cls", "n", "x", "near", "code", "missed"])

    def search(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        centres, own_words = handle.value
        start, out = 0, ([], [], [])
        for m in grouping.group_lengths(batch).tolist():
            if m > 1:
                for column, more in zip(out, in_list(batch.slice(start, m), centres, own_words)):
                    column += more
            start += m
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b", "links"])

    def in_list(rows: pa.RecordBatch, centres: np.ndarray, own_words: list[np.ndarray]) -> tuple[list, list, list]:
        here, i, j = (rows.column(c)[0].as_py() for c in range(3))
        ids, weight, near = rows.column(3).to_numpy(), rows.column(4).to_numpy(), rows.column(6).flatten().to_numpy().reshape(rows.num_rows, -1)
        member = np.flatnonzero((rows.column(9).to_numpy() == i) & np.asarray(rows.column(7).is_valid()))
        query = np.flatnonzero(rows.column(10).to_numpy() == j)
        if not len(member) or not len(query):
            return [], [], []
        x = matrix(rows.column(5), dim)
        mx, codes = x[member], np.frombuffer(b"".join(rows.column(7).take(pa.array(member)).to_pylist()), np.uint8).reshape(len(member), -1)
        reach = (radius + rows.column(8).to_numpy()[member].astype(np.float32) + 1e-3) ** 2
        links, p, q = np.zeros(rows.num_rows, np.int64), [], []
        block = max(1, 2_000_000 // len(member))
        for s in range(0, len(query), block):
            own = query[s : s + block]
            tables = lookups(x[own] - centres[here], own_words)
            d = tables[0][:, codes[:, 0]]
            for k in range(1, len(tables)):
                d += tables[k][:, codes[:, k]]
            a, b = np.nonzero(d <= reach[None, :])
            for e in range(0, len(a), 500_000):
                u, v = own[a[e : e + 500_000]], member[b[e : e + 500_000]]
                cos = np.einsum("ij,ij->i", x[u].astype(np.float64), x[v].astype(np.float64))
                # a pair that the other one's query finds too counts where the smaller one asks
                other = (near[v] == near[u, :1]).any(1)
                ok = (cos >= threshold - 1e-7) & (ids[u] != ids[v]) & (~other | (ids[u] < ids[v]))
                np.add.at(links, u[ok], weight[v[ok]])
                np.add.at(links, v[ok], weight[u[ok]])
                p.append(u[ok])
                q.append(v[ok])
        some = np.flatnonzero(links)
        if not len(some):
            return [], [], []
        u, v = grouping.spanning(rows.num_rows, np.concatenate(p), np.concatenate(q))
        return ids[some].tolist() + ids[u].tolist(), [None] * len(some) + ids[v].tolist(), links[some].tolist() + [None] * len(u)

    rows = written(vectors.select("cls", "n", "x").mapInArrow(place, "list int, cls long, n long, x array<float>, near array<int>, code binary, missed float"), f"{path}/placed-{dim}")
    counted = rows.groupBy(F.col("list").alias("grp")).agg(F.count("code").alias("members"), F.count("*").alias("queries"))
    # two numbers a list, MOST_LISTS lists
    rows = rows.withColumnRenamed("list", "grp").join(F.broadcast(counted), "grp")
    parts_of = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / grouping.BLOCK).cast("int"))
    bm, bq = F.pmod(F.xxhash64(F.lit(7), "cls"), parts_of("members")).cast("int"), F.pmod(F.xxhash64(F.lit(9), "cls"), parts_of("queries")).cast("int")
    rows = rows.withColumns({"bm": bm, "bq": bq})
    asks = F.transform(F.sequence(F.lit(0), parts_of("members") - 1), lambda i: F.struct(i.alias("i"), F.col("bq").alias("j")))
    holds = F.transform(F.sequence(F.lit(0), parts_of("queries") - 1), lambda j: F.struct(F.col("bm").alias("i"), j.alias("j")))
    places = F.when(F.col("code").isNull(), asks).otherwise(F.array_union(asks, holds))
    rows = rows.withColumn("g", F.explode(places)).select("grp", "g.i", "g.j", "cls", "n", "x", "near", "code", "missed", "bm", "bq")
    return written(grouping.by_group(rows, search, "a long, b long, links long"), f"{path}/found-{dim}")


def near_duplicates(embeddings: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, class_id, n_copies, n_links: a row for each vector.

    n_links counts the other vectors whose cosine is at least the threshold, of which n_copies point
    the same way (equal after scaling to unit length). class_id is the smallest vec_id of those that
    links connect with it; its own where there is no link. The search is approximate: a pair is
    missed if neither vector's list is among the other's PROBES nearest ones; what is counted is
    exact.

    Null ids, null or empty vectors, those with null, infinite or undefined entries and those of
    length zero give no row. Vectors of different dimensions don't pair. A row that repeats a vec_id
    and its direction counts once; one vec_id with two directions counts as two vectors. Extra
    columns are ignored. Ties at the threshold pair. An empty table gives no rows.
    """
    if not 0.5 <= threshold <= 1:
        raise ValueError("threshold must lie in [0.5, 1]")
    spark = embeddings.sparkSession
    raw = pick(embeddings, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<double>").alias("e")).filter("doc_id is not null and size(e) > 0")
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, v: s + v * v))
    unit = raw.withColumn("norm", norm).filter("norm > 0 and norm < double('infinity')").select("doc_id", F.expr("transform(e, v -> float(v / norm))").alias("x"))
    path, kept = folder(spark, "near"), folder(spark, "near-duplicates")
    with dropping_shuffles(spark):
        members, classes = grouping.classes_of(unit.select("doc_id", F.xxhash64("x").alias("k1"), F.xxhash64(F.lit(1), "x").alias("k2"), "x"), path)
        sizes = {r["dim"]: r["n"] for r in classes.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).collect()}
        found = spark.createDataFrame([], "a long, b long, links long")
        for dim, n in sorted(sizes.items()):
            if n > 1:
                found = found.unionByName(one_dimension(classes.filter(F.size("x") == dim), dim, n, threshold, path))
        rows = grouping.one_row_each(members, classes, found, path).withColumnRenamed("doc_id", "vec_id")
        rows = written(rows, kept)
        remove(spark, path)
    return rows


#: Over embeddings, exactly.
NEAR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
half AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95 - 1e-7),
edges AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reached AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, e.b FROM reached r JOIN edges e ON e.a = r.other),
u AS (SELECT vec_id, list_transform(e, lambda x: (x / sqrt(list_sum(list_transform(e, lambda y: y * y))))::FLOAT) AS x FROM v),
copies AS (SELECT vec_id, count(*) OVER (PARTITION BY x) - 1 AS n_copies FROM u)
SELECT vec_id, (SELECT min(other) FROM reached r WHERE r.vec_id = v.vec_id) AS class_id, n_copies::BIGINT AS n_copies, (SELECT count(*) FROM edges e WHERE e.a = v.vec_id)::BIGINT AS n_links FROM v JOIN copies USING (vec_id)
"""
