"""Embedding near-duplicates: tiled comparison in the order of principal components, with suffix-norm bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import components, smallest_ids, with_nodes
from lodestone.llm.session import checkpointed

#: Vectors compared with each other at once, and leading dimensions after which pairs are given up.
BLOCK, STEPS = 1024, (4, 8, 16, 32)
#: A cell is dealt into so many blocks, each of BLOCK vectors at least and of so many bytes at most. Each block travels to every block that it meets.
BLOCKS, BLOCK_BYTES = 4, 16 << 20
#: Pairs nearer to the threshold than this are decided by the plain formula in the vectors' own coordinates.
NEAR = 1e-9
#: Cells along the first component that a link can span.
CELLS = 2


def _moments(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of outer products of unit vectors, by dimension, as (d, i, j, s)."""
    sums: dict[int, np.ndarray] = {}
    for batch in stream:
        dims = batch.column("d").to_numpy()
        for d in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == d)).column("v")
            x = _units(part.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d))
            sums[d] = sums.get(d, 0) + x.T @ x
    for d, m in sums.items():
        i, j = np.divmod(np.arange(d * d), d)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d)), pa.array(i), pa.array(j), pa.array(m.ravel())], names=["d", "i", "j", "s"])


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, so that squares neither vanish nor pass all bounds; cosines stay what they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _units(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension an orthogonal matrix whose columns are principal directions, strongest first."""
    sums = vectors.select("d", "v").mapInArrow(_moments, "d long, i long, j long, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s")).toPandas()
    out = {}
    for d, part in sums.groupby("d"):
        m = np.zeros((int(d), int(d)))
        m[part["i"], part["j"]] = part["s"]
        if not np.isfinite(m).all():
            raise ValueError(f"no principal directions of the vectors with {d} components")
        out[int(d)] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()
    return out


def _celled(rotations: dict[int, np.ndarray], width: float):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            dims = batch.column("d").to_numpy()
            cell = np.zeros(batch.num_rows, np.int64)
            for d in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == d)
                x = _units(batch.take(pa.array(mine)).column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d))
                cell[mine] = np.floor(x @ rotations[d][:, 0] / width).astype(np.int64)
            yield batch.append_column("cell", pa.array(cell))

    return run


def _blocked(rows: pa.Table) -> pa.Table:
    rows = rows.combine_chunks()
    data = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    one = rows.slice(0, 1).select(["label", "d", "cell", "sub"])
    for name, x in (("ids", rows["doc"].to_numpy().astype("<i8")), ("copies", rows["copies"].to_numpy().astype("<i8")), ("data", data)):
        one = one.append_column(name, pa.array([x.tobytes()], pa.binary()))
    return one


def linked_pairs(a: np.ndarray, b: np.ndarray, rotation: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of rows of a and b with cosine >= threshold.

    Rows are turned longo principal order. After each step of leading dimensions a pair's cosine is at
    most its partial product plus the product of the norms of what is left; below the threshold it is done.
    """
    d = a.shape[1]
    x, y = _units(a) @ rotation, _units(b) @ rotation
    rest = lambda z: np.sqrt(np.maximum(np.cumsum((z * z)[:, ::-1], axis=1)[:, ::-1], 0))
    rx, ry = np.pad(rest(x), ((0, 0), (0, 1))), np.pad(rest(y), ((0, 0), (0, 1)))
    cuts = [0, *(s for s in STEPS if s < d), d]
    partial, i, j, values = np.zeros((len(x), len(y))), None, None, None
    for low, high in zip(cuts, cuts[1:], strict=False):
        if i is None:
            partial += x[:, low:high] @ y[:, low:high].T
            open_ = partial + rx[:, high, None] * ry[None, :, high] >= threshold - NEAR
            n = np.count_nonzero(open_)
            if n * 20 < open_.size or high == d:
                i, j = np.nonzero(open_)
                values = partial[i, j]
        else:
            values = values + np.einsum("ij,ij->i", x[i, low:high], y[j, low:high])
            keep = values + rx[i, high] * ry[j, high] >= threshold - NEAR
            i, j, values = i[keep], j[keep], values[keep]
        if i is not None and not len(i):
            break
    near = np.flatnonzero(np.abs(values - threshold) < NEAR)
    keep = values >= threshold
    for k in near.tolist():
        p, q = _scaled(a[i[k]][None])[0], _scaled(b[j[k]][None])[0]
        keep[k] = float(p @ q) / float(np.sqrt(p @ p) * np.sqrt(q @ q)) >= threshold
    return i[keep], j[keep]


def block_pairs(a: np.ndarray, b: np.ndarray, rotation: np.ndarray, threshold: float, block: int) -> tuple[np.ndarray, np.ndarray]:
    """``linked_pairs`` of two long lists, ``block`` by ``block`` vectors at once; of a list with itself (a is b) each pair once."""
    out = []
    for i in range(0, len(a), block):
        for j in range(i if a is b else 0, len(b), block):
            p, q = linked_pairs(a[i : i + block].astype(float), b[j : j + block].astype(float), rotation, threshold)
            p, q = p + i, q + j
            out.append((p[p < q], q[p < q]) if a is b else (p, q))
    return np.concatenate([p for p, _ in out]), np.concatenate([q for _, q in out])


def _compared(rotations: dict[int, np.ndarray], threshold: float, block: int, kind: str):
    def run(rows: pa.Table) -> pa.Table:
        """One tile: for each vector with links in it, how many vectors it links with and the smallest one of its class here."""
        d = rows["d"][0].as_py()
        ids = [np.frombuffer(x.as_buffer(), "<i8") for x in rows["ids"]]
        copies = [np.frombuffer(x.as_buffer(), "<i8") for x in rows["copies"]]
        data = [np.frombuffer(x.as_buffer(), kind).reshape(-1, d) for x in rows["data"]]
        i, j = block_pairs(data[0], data[-1], rotations[d], threshold, block)
        if len(ids) == 2:
            j = j + len(ids[0])
        every, weight = np.concatenate(ids), np.concatenate(copies)
        n = (np.bincount(i, weight[j], len(every)) + np.bincount(j, weight[i], len(every))).astype(np.int64)
        order = np.argsort(every)
        place = np.empty(len(every), np.int64)
        place[order] = np.arange(len(every))
        p, q = place[i], place[j]
        root = np.arange(len(every))
        while True:
            before = root.copy()
            low = np.minimum(root[p], root[q])
            np.minimum.at(root, p, low)
            np.minimum.at(root, q, low)
            root = root[root]
            if (root == before).all():
                break
        some = np.flatnonzero(n)
        return pa.table({"doc": pa.array(every[some]), "n": pa.array(n[some]), "to": pa.array(every[order][root[place[some]]])})

    return run


def near_duplicate_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str | None = "label", threshold: float = 0.93, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: links of cosine >= threshold and the classes they connect.

    Vectors are compared if their labels are equal and not null (without a label column, all) and they
    have the same length. Equal vectors are one, with a number of copies. The others are dealt into
    cells along the first principal component and cells into blocks; two blocks make a tile if their
    cells are near enough for a link: unit vectors with cosine t differ by at most sqrt(2 - 2 t) in any
    direction. A block travels whole to each tile, in the numbers' own width, and has more vectors where a
    label has more, up to 16 MB; a tile compares ``block`` by ``block`` vectors at once. It returns counts
    and one edge for each vector, not its pairs.

    Null, empty and zero vectors, and those with null or non-finite components, link with nothing: n_links
    is 0 and they are their own class. Rows that repeat an id are vectors each, with links of their own; a
    class's id is the smallest of its rows. A null id is kept, unjudged, with 0 links. An empty table gives
    an empty result; other columns are not looked at.
    """
    label = F.col(label_column).cast("string") if label_column else F.lit("")
    single = vectors.schema[vector_column].dataType.simpleString() == "array<float>"
    numbers, kind = ("array<float>", "<f4") if single else ("array<double>", "<f8")
    source = vectors.select(F.col(id_column).cast("long").alias("vec_id"), label.alias("label"), F.col(vector_column).cast(numbers).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    source = source.withColumn("valid", F.coalesce(valid, F.lit(False)))
    good = source.where("valid").select("vec_id", "label", "v", F.size("v").cast("long").alias("d"), F.xxhash64("v").alias("key1"), F.xxhash64("v", F.lit(1)).alias("key2"))
    same = ["label", "d", "key1", "key2"]
    classes = good.groupBy(*same).agg(F.min("vec_id").alias("doc"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    classes = checkpointed(with_nodes(classes, good, "vec_id", same))
    rotations = _rotations(classes)
    width = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6) / CELLS
    celled = classes.select(F.col("node").alias("doc"), "copies", "label", "d", "v").mapInArrow(_celled(rotations, width), f"doc long, copies long, label string, d long, v {numbers}, cell long")
    celled = checkpointed(celled)
    most = F.floor(F.lit(BLOCK_BYTES) / (F.col("d") * int(kind[2])))
    per_block = F.greatest(F.lit(1), F.least(most, F.greatest(F.lit(block), F.ceil(F.col("n") / BLOCKS))))
    sizes = celled.groupBy("label", "d", "cell").agg(F.count(F.lit(1)).alias("n")).select("label", "d", "cell", F.ceil(F.col("n") / per_block).alias("subs"))
    celled = celled.join(sizes, ["label", "d", "cell"]).withColumn("sub", F.pmod(F.xxhash64("doc"), "subs"))
    blocks = celled.groupBy("label", "d", "cell", "sub").applyInArrow(_blocked, "label string, d long, cell long, sub long, ids binary, copies binary, data binary")
    names = sizes.withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1))).drop("subs")
    left = names.select("label", "d", F.col("cell").alias("cell1"), F.col("sub").alias("sub1"), F.explode(F.sequence(F.col("cell"), F.col("cell") + CELLS + 1)).alias("cell"))
    tiles = left.join(names, ["label", "d", "cell"]).where("cell1 < cell or sub1 <= sub")
    tile = F.struct("label", "d", "cell1", "sub1", F.col("cell").alias("cell2"), F.col("sub").alias("sub2")).alias("tile")
    both = tiles.select(tile, "label", "d", F.explode(F.array_distinct(F.array(F.struct(F.col("cell1").alias("cell"), F.col("sub1").alias("sub")), F.struct("cell", "sub")))).alias("part"))
    both = both.select("tile", "label", "d", "part.cell", "part.sub")
    compared = checkpointed(both.join(blocks, ["label", "d", "cell", "sub"]).select("tile", "d", "ids", "copies", "data").groupBy("tile").applyInArrow(_compared(rotations, threshold, block, kind), "doc long, n long, to long"))
    found = smallest_ids(components(compared, "doc", "to"), classes)
    counts = compared.groupBy(F.col("doc").alias("node")).agg(F.sum("n").alias("n"))
    judged = classes.select(*same, "doc", "node", "copies").join(counts, "node", "left").join(found, "node", "left")
    judged = judged.select(*same, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "doc").alias("component_id"))
    linked = good.select("vec_id", *same).join(judged, same).select("vec_id", "n_links", "component_id")
    alone = source.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
