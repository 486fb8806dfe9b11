"""Groups of equal and of similar items: classes of copies, groups in blocks, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, remove, written

#: Members of a group that are compared with as many others in one task.
BLOCK = 2048


def classes_of(rows: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Tables members (doc_id, k1, k2; a row for each item) and classes (cls, k1, k2, rep, n and all other columns; a row for each distinct content), of rows doc_id, k1, k2 and others.

    k1 and k2 are 64-bit hashes of the content. Copies are counted before they are shuffled.
    """
    sets = written(rows, f"{path}/sets")
    members = written(sets.select("doc_id", "k1", "k2").distinct(), f"{path}/members")
    each = members.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    first = sets.withColumnRenamed("doc_id", "rep").join(each, ["k1", "k2", "rep"]).dropDuplicates(["k1", "k2", "rep"])
    classes = first.select(F.monotonically_increasing_id().alias("cls"), "k1", "k2", "rep", "n", *sets.columns[3:])
    classes = written(classes, f"{path}/classes")
    remove(rows.sparkSession, f"{path}/sets")
    return members, classes


def with_classes(members: DataFrame, table: DataFrame) -> DataFrame:
    """Members joined with a table by k1, k2. A class that holds a thousandth of all documents or more would overload a task of the shuffle; there are a thousand of them at most, so these are broadcast."""
    many = members.count() // 1000 + 1
    usual = members.join(table.filter(F.col("n") < many), ["k1", "k2"])
    return usual.unionByName(members.join(F.broadcast(table.filter(F.col("n") >= many)), ["k1", "k2"]))


def own_block(item: Column, size: Column) -> Column:
    """The block of an item in a group of the given size."""
    return F.pmod(F.xxhash64(F.lit(7), item), F.ceil(size / BLOCK)).cast("int")


def blocks_of(group: Column, item: Column, size: Column) -> Column:
    """(grp, i, j) for each pair of blocks that an item takes part in: one for groups of up to BLOCK, else BLOCK items or so are a block."""
    own, others = own_block(item, size), F.sequence(F.lit(0), F.ceil(size / BLOCK).cast("int") - 1)
    return F.transform(others, lambda o: F.struct(group.alias("grp"), F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))


def by_group(rows: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work(batch) for batches of whole groups (grp, i, j), as Arrow, many small groups at a time."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(parts).combine_chunks()
            if whole.num_rows:
                yield from work(whole.to_batches()[0])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in range(3)]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            if held and [held[-1].column(c)[-1].as_py() for c in range(3)] != [k[0].item() for k in keys]:
                yield from flush(held)
                held = []
            if len(change):
                at = int(change[-1])
                yield from flush([*held, batch.slice(0, at)])
                held = [batch.slice(at)]
            else:
                held.append(batch)
        if held:
            yield from flush(held)

    return rows.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(stream, schema)


def group_lengths(batch: pa.RecordBatch) -> np.ndarray:
    keys = [batch.column(c).to_numpy() for c in range(3)]
    first = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]
    return np.diff(np.r_[np.flatnonzero(first), batch.num_rows])


def spanning(m: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the pairs, as they come."""
    parent = list(range(m))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    take = []
    for e, (i, k) in enumerate(zip(x.tolist(), y.tolist())):
        p, q = root(i), root(k)
        if p != q:
            parent[max(p, q)] = min(p, q)
            take.append(e)
    return x[take], y[take]


def one_row_each(members: DataFrame, classes: DataFrame, found: DataFrame, path: str) -> DataFrame:
    """doc_id, class_id, n_copies, n_links of each member.

    found: a, b, links; parts of the number of links of a class where b is null, else two classes of one group.
    """
    links = found.filter("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    small = classes.select("cls", "k1", "k2", "rep", "n")
    group = components(found.filter("b is not null").select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))).select(F.col("doc_id").alias("cls"), F.col("group_id").alias("grp"))
    least = group.join(small.select("cls", "rep"), "cls").groupBy("grp").agg(F.min("rep").alias("class_id"))
    table = small.join(links, "cls", "left").join(group.join(least, "grp").select("cls", "class_id"), "cls", "left")
    table = written(table.select("k1", "k2", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("class_id", "rep").alias("class_id")), f"{path}/table")
    return with_classes(members, table).select("doc_id", "class_id", (F.col("n") - 1).alias("n_copies"), (F.col("links") + F.col("n") - 1).alias("n_links"))


def components(edges: DataFrame) -> DataFrame:
    """doc_id, group_id (smallest id reachable) by alternating large-star and small-star steps until nothing changes."""
    e = checkpoint(edges.select(F.col("doc_a").alias("u"), F.col("doc_b").alias("v")).filter("u <> v").distinct())
    while True:
        both = e.union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.u", "p.v").filter("u <> v").distinct()
        nxt = checkpoint(small)
        stats = lambda d: d.agg(F.count("*"), F.bit_xor(F.xxhash64(F.greatest("u", "v"), F.least("u", "v")))).first()
        done = stats(nxt) == stats(e)
        e = nxt
        if done:
            break
    return e.select(F.col("u").alias("doc_id"), F.col("v").alias("group_id")).union(e.select(F.col("v"), F.col("v")).distinct())
