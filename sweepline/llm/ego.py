"""Operator 10: embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine >= t lie within eps = sqrt(2 - 2 t). The vectors are projected on their leading
principal axes (the cell coordinates), sorted by grid cell of side eps, first axis first, and cut into blocks of
consecutive vectors. Sequence intervals are joined recursively: two intervals whose boxes on the leading
axes are more than eps apart hold no pair and are skipped, others are halved down to ``LEAF`` vectors and then
compared: a float32 product with a safety margin, then the cosine in double precision for what is near.

Equal vectors are compared once, as a class. Blocks of ``BLOCK_ROWS`` vectors are files of the shared folder that tasks
map into memory. A partition of the sorted vectors is an interval of the sequence, at most ``BLOCKS`` blocks or so: the driver
holds the box of each partition only. A task takes one of them against all later ones and passes the pairs of blocks on; a task
that gets a pair of blocks sends back the number of links by class and a spanning forest, never the pairs.

Vectors that are null, zero or hold null or non-finite components link with nothing and are rows of their
own. Vectors of different lengths never link. Repeated ids are rows of their own. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, _mapped, components, cut, forest, put_array, tidy

AXES, BLOCK_ROWS, BLOCKS, LEAF = 8, 2048, 64, 256
SLACK = 1e-9  # of distances that are rounded


def _gram(batches):
    """Sums of x x' over unit vectors, by length of the vector."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for x in _matrices(batch.column(0)):
            d = x.shape[1]
            sums[d] = sums.get(d, 0) + x.T @ x
    for d, s in sums.items():
        i, j = np.indices((d, d)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d)), pa.array(i), pa.array(j), pa.array(s.ravel())], ["d", "i", "j", "s"])


def _matrices(column, most: int = 4096):
    """Unit vectors of a list column whose lists are of one length."""
    for s in range(0, len(column), most):
        part = column.slice(s, most)
        flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        x = flat.reshape(len(part), -1)
        x = x / np.abs(x).max(1, keepdims=True)  # else squares of very large or small numbers are infinite or 0
        yield x / np.sqrt((x * x).sum(1, keepdims=True))


def _axes(classes: DataFrame, dim: int) -> np.ndarray:
    """Leading principal axes of the unit vectors (dim x AXES), from the sum of their outer products."""
    rows = classes.select("embedding").mapInArrow(tidy(_gram), "d long, i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    gram = np.zeros((dim, dim))
    gram[rows["i"], rows["j"]] = rows["s"]
    _, vectors = np.linalg.eigh(gram)
    return vectors[:, ::-1][:, : min(AXES, dim)]


def _apart(low1, high1, low2, high2, eps: float) -> bool:
    gap = np.maximum(0, np.maximum(low1 - high2, low2 - high1))
    return bool((gap * gap).sum() > eps * eps * (1 + SLACK) + SLACK)


def _boxes(one: np.ndarray, two: np.ndarray, same: bool, eps: float):
    """Pairs (a, c) of blocks that may hold a link (``same``: a <= c): intervals are joined recursively, distant ones skipped.

    ``one`` and ``two``: by block, the lowest and the highest coordinate on each axis.
    """
    todo = [(0, len(one), 0, len(two))]
    while todo:
        a, b, c, d = todo.pop()
        if same and a >= d:
            continue
        if _apart(one[a:b, 0].min(0), one[a:b, 1].max(0), two[c:d, 0].min(0), two[c:d, 1].max(0), eps):
            continue
        if b - a == 1 and d - c == 1:
            yield a, c
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]


def _join(x, y, px, py, same: bool, eps: float, cosine: float):
    """(rows of x, rows of y) with cosine of at least ``cosine``: the recursion below the level of blocks."""
    us, vs = [], []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if same and a >= d:
            continue
        if _apart(px[a:b].min(0), px[a:b].max(0), py[c:d].min(0), py[c:d].max(0), eps):
            continue
        if b - a > LEAF or d - c > LEAF:
            if b - a >= d - c:
                m = (a + b) // 2
                todo += [(a, m, c, d), (m, b, c, d)]
            else:
                m = (c + d) // 2
                todo += [(a, b, c, m), (a, b, m, d)]
            continue
        near = x[a:b].astype(np.float32) @ y[c:d].astype(np.float32).T >= cosine - 1e-4
        if same and a + 1 > c:
            near &= np.arange(a, b)[:, None] < np.arange(c, d)[None]
        i, j = np.nonzero(near)
        if len(i):
            i, j = i + a, j + c
            true = np.einsum("ij,ij->i", x[i], y[j]) >= cosine
            us.append(i[true])
            vs.append(j[true])
    z = np.zeros(0, np.int64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (z, z)


def _class_links(classes: DataFrame, dim: int, cosine: float) -> DataFrame:
    """(kind, u, n): links of class u (kind 0: n more vectors; kind 1: n is a class of the same component)."""
    spark = classes.sparkSession
    eps = float(np.sqrt(2 - 2 * cosine))
    axes = _axes(classes, dim)
    total, rows = classes.count(), BLOCK_ROWS
    folder = Scratch(spark, "ego")

    def project(batches):
        for batch in batches:
            p = np.concatenate([x @ axes for x in _matrices(batch.column(2))]) if len(batch) else np.zeros((0, axes.shape[1]))
            cells = np.floor(p / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells), pa.list_(pa.int32()))], ["rep", "n", "embedding", "cell"])

    def write(batches):
        from pyspark import TaskContext

        part, held, k = TaskContext.get().partitionId(), [], 0
        out = []

        def block(t):
            nonlocal k
            x = np.concatenate(list(_matrices(t.column(2).combine_chunks())))
            p = x @ axes
            name = f"{part}-{k}"
            k += 1
            put_array(f"{folder.path}/{name}.vec", x)
            put_array(f"{folder.path}/{name}.id", t.column(0).to_numpy().astype("<i8"))
            put_array(f"{folder.path}/{name}.n", t.column(1).to_numpy().astype("<i8"))
            out.append((p.min(0), p.max(0)))

        for batch in batches:
            held.append(batch)
            t = pa.Table.from_batches(held)
            while len(t) >= rows:
                block(t.slice(0, rows))
                t = t.slice(rows)
            held = t.to_batches()
        t = pa.Table.from_batches(held) if held else None
        if t is not None and len(t):
            block(t)
        if out:
            box = np.array(out)
            put_array(f"{folder.path}/{part}.boxes", box)
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([k]), pa.array([box[:, 0].min(0).tolist()]), pa.array([box[:, 1].max(0).tolist()])], ["part", "blocks", "low", "high"])

    kind = f"rep long, n long, embedding {classes.schema['embedding'].dataType.simpleString()}, cell array<int>"
    parts = max(min(-(-total // rows), 4 * spark.sparkContext.defaultParallelism), -(-total // (rows * BLOCKS)), 1)
    ordered = classes.select("rep", "n", "embedding").mapInArrow(tidy(project), kind).repartitionByRange(parts, "cell", "rep").sortWithinPartitions("cell", "rep")
    held = ordered.mapInArrow(tidy(write), "part long, blocks long, low array<double>, high array<double>").orderBy("part").collect()  # a row a partition
    boxes = np.array([(r["low"], r["high"]) for r in held])
    names, blocks = [r["part"] for r in held], sum(r["blocks"] for r in held)

    def meet(batches):
        def load(i):
            return _mapped(f"{folder.path}/{names[i]}.boxes", "<f8").reshape(-1, 2, axes.shape[1])

        for batch in batches:
            for i in batch.column(0).to_pylist():
                one = load(i)
                for j in range(i, len(names)):
                    if not _apart(*boxes[i], *boxes[j], eps):
                        if found := list(_boxes(one, load(j), i == j, eps)):
                            a, c = zip(*found, strict=True)
                            yield pa.RecordBatch.from_arrays([pa.array([f"{names[i]}-{x}" for x in a]), pa.array([f"{names[j]}-{x}" for x in c])], ["a", "b"])

    def compare(batches):
        def load(name):
            x = _mapped(f"{folder.path}/{name}.vec", "<f8").reshape(-1, dim)
            return x, x @ axes, _mapped(f"{folder.path}/{name}.id", "<i8"), _mapped(f"{folder.path}/{name}.n", "<i8")

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, px, xid, xn = load(a)
                y, py, yid, yn = (x, px, xid, xn) if a == b else load(b)
                i, j = _join(x, y, px, py, a == b, eps, cosine)
                if not len(i):
                    continue
                ids = np.r_[xid[i], yid[j]]
                who, at = np.unique(ids, return_inverse=True)
                more = np.bincount(at, weights=np.r_[yn[j], xn[i]]).astype(np.int64)
                u, v = forest(xid[i], yid[j])
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.zeros(len(who), np.int32), np.ones(len(u), np.int32)]), pa.array(np.r_[who, u]), pa.array(np.r_[more, v])], ["kind", "u", "n"])

    tasks = max(1, min(blocks * (blocks + 1) // 2, max(16 * spark.sparkContext.defaultParallelism, blocks // 4)))
    intervals = spark.range(0, len(names), 1, max(1, min(len(names), 4 * spark.sparkContext.defaultParallelism)))
    work = intervals.mapInArrow(tidy(meet), "a string, b string").repartition(tasks, "a", "b")
    out = cut(work.mapInArrow(tidy(compare), "kind int, u long, n long"))
    folder.drop()
    return out


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``."""
    kind = "array<float>" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("embedding"))
    usable = F.expr("embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x != 0)")
    v = v.withColumn("_ok", F.coalesce(usable & F.col("vec_id").isNotNull(), F.lit(False)))
    # 0.0 and -0.0 are one value
    good = v.where("_ok").select("vec_id", F.expr("transform(embedding, x -> x + cast(0 as float))").alias("embedding"))
    members = cut(good.withColumn("_key", F.xxhash64("embedding")))
    classes = cut(members.groupBy("_key", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("_d", F.size("embedding")))
    found = None
    for r in classes.groupBy("_d").count().orderBy("_d").collect():  # vectors of a table mostly have one length
        part = _class_links(classes.where(F.col("_d") == r["_d"]), r["_d"], cosine)
        found = part if found is None else found.unionByName(part)
    alone = v.where("not _ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if found is None:
        out = alone
    else:
        more = found.where("kind = 0").groupBy("u").agg(F.sum("n").alias("more"))
        comp = components(found.where("kind = 1").select("u", F.col("n").alias("v")))
        table = (
            classes.join(more.hint("merge"), classes.rep == more.u, "left").join(comp.hint("merge"), classes.rep == comp.node, "left")
            .select("_key", "embedding", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
        )
        out = members.join(table.hint("merge"), ["_key", "embedding"]).select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: all rows of embeddings at cosine 0.9."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
