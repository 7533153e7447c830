"""Whitening of embeddings on MLlib's BlockMatrix.

Vectors become whole numbers, and every task packs its vectors into blocks of ``rows_per_block`` rows, written to the
shared folder as one table row each; numbered through, they are the rows of a distributed matrix. The means are taken
from exact sums. The blocks, centred, make a BlockMatrix A; its transpose times itself is the scatter (dimensions
squared, whatever the number of vectors), decomposed on the driver; A times the whitening matrix projects all rows.

The inner dimension of the scatter product is split (``multiply`` of the Scala API with mid-dimension splits, which the
Python method does not pass on), so no task holds more than ``BLOCKS_PER_SPLIT`` blocks. Vectors are never shuffled row
by row: ids travel in the same packing, and results meet their ids by block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanmill.llm.tasks import Batches, in_arrow
from spanmill.llm.vectors import exact_sums, lengths, matrix
from spanmill.session import cut_lineage

COMPONENTS, SCALE, SHIFT = 8, 1024, 100_000
ROWS_PER_BLOCK, BLOCKS_PER_SPLIT = 2048, 8
#: Entries beyond this size count as this size, so that the whole numbers stay far inside a long.
LIMIT = 1 << 31
#: Directions with less than this share of the largest eigenvalue carry no variance and are no components.
_FLAT = 1e-12

_BLOCKS = "dims int, part int, place int, rows int, ids array<bigint>, x binary, sums array<bigint>"
_RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Fit:
    """The fit list's size, whole and rest of the means (sum = n * whole + rest), eigenvalues, trace and whitening matrix."""

    n: int
    whole: np.ndarray
    rest: list[int]
    values: np.ndarray
    trace: float
    whitening: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - np.array(self.rest, np.float64) / self.n


def pack(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Blocks of vectors of one length: (dims, part, place, rows, ids, x, sums), as a written table.

    A task numbers its blocks by ``part`` and ``place``; ``x`` holds the rows' longs, ``sums`` their exact column sums.
    """
    schema = pa.schema([("dims", pa.int32()), ("part", pa.int32()), ("place", pa.int32()), ("rows", pa.int32()), ("ids", pa.list_(pa.int64())), ("x", pa.binary()), ("sums", pa.list_(pa.int64()))])

    def run(batches: Batches) -> Batches:
        part, place = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[pa.Array, np.ndarray]]] = {}

        def block(dims: int, ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
            columns = [[dims], [part], [place], [len(x)], [ids.to_pylist()], [np.ascontiguousarray(x).tobytes()], [x.sum(axis=0).tolist()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

        def join(dims: int) -> tuple[pa.Array, np.ndarray]:
            ids, rows = zip(*held.pop(dims), strict=True)
            return pa.concat_arrays(ids), np.concatenate(rows)

        for batch in batches:
            column = batch.column("embedding")
            for dims in lengths(column):
                kept, values = matrix(column, dims)
                if not len(kept):
                    continue
                x = np.floor(scale * np.clip(values, -LIMIT, LIMIT)).astype(np.int64) + shift
                held.setdefault(dims, []).append((batch.column("vec_id").take(pa.array(kept)), x))
                ids, x = join(dims)
                while len(x) >= rows_per_block:
                    yield block(dims, ids[:rows_per_block], x[:rows_per_block])
                    ids, x, place = ids[rows_per_block:], x[rows_per_block:], place + 1
                if len(x):
                    held[dims] = [(ids, x)]
            # Tables of very many lengths do not pile up: all of them together stay near one block.
            if sum(rows.size for parts in held.values() for _, rows in parts) > 64 * rows_per_block * max(held, default=1):
                for dims in list(held):
                    yield block(dims, *join(dims))
                    place += 1
        for dims in list(held):
            yield block(dims, *join(dims))
            place += 1

    return cut_lineage(in_arrow(vectors.select("vec_id", "embedding"), run, _BLOCKS))


def numbered(packed: DataFrame, dims: int) -> DataFrame:
    """Blocks of length ``dims`` with a number each, from 0 without gaps."""
    mine = packed.filter(F.col("dims") == dims)
    # Places of other lengths leave gaps, so blocks are ranked within their part. Keys only: blocks are not held together.
    keys = mine.groupBy("part").agg(F.array_sort(F.collect_list("place")).alias("places"))
    # One row for each task that packed.
    before = F.sum(F.size("places")).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    listed = keys.withColumn("offset", F.coalesce(before, F.lit(0)))
    numbers = listed.select("part", F.posexplode("places").alias("at", "place"), "offset").select("part", "place", (F.col("offset") + F.col("at")).cast("int").alias("block"))
    return cut_lineage(mine.join(numbers, ["part", "place"]).select("block", "rows", "ids", "x"))


def _rows(data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(-1, dims)


def _as_block(values: np.ndarray, rows_per_block: int) -> DenseMatrix:
    """A full block: rows of zeros fill a short one, which changes no product."""
    full = np.zeros((rows_per_block, values.shape[1]))
    full[: len(values)] = values
    return DenseMatrix(*full.shape, full.ravel(order="F"))


def _times(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    java = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, left.rowsPerBlock, right.colsPerBlock)


def identity_error(projected: DataFrame, n: int, components: int) -> float:
    """Largest absolute entry of the covariance of the projected rows minus the identity; one small row a task comes back."""

    def run(batches: Batches) -> Batches:
        sums, products = np.zeros(components), np.zeros((components, components))
        for batch in batches:
            for rows, data in zip(batch.column("rows").to_pylist(), batch.column("whitened"), strict=True):
                values = np.frombuffer(data.as_buffer()).reshape(-1, components)[:rows]
                sums += values.sum(axis=0)
                products += values.T @ values
        yield pa.RecordBatch.from_arrays([pa.array([[*sums, *products.ravel()]], pa.list_(pa.float64()))], ["sums"])

    parts = in_arrow(projected.select("rows", "whitened"), run, "sums array<double>")
    totals = parts.select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value")).orderBy("at")
    found = np.array([r["value"] for r in totals.collect()])
    means, products = found[:components] / n, found[components:].reshape(components, components) / n
    return float(np.abs(products - np.outer(means, means) - np.eye(components)).max())


def deviations(x: np.ndarray, fit: Fit) -> list[int | None]:
    """For each row the sum of (n * x - sum)**2 over the dimensions, exactly; None where a long cannot hold it."""
    away = x - fit.whole  # n * x - sum = n * away - rest
    if np.abs(away).max(initial=0) < 1 << 24 and fit.n < 1 << 32 and x.shape[1] < 1 << 7:
        squares, mixed = (away * away).sum(axis=1).tolist(), (away @ np.array(fit.rest, np.int64)).tolist()
    else:
        whole = away.astype(object)
        squares, mixed = (whole * whole).sum(axis=1).tolist(), (whole @ np.array(fit.rest, object)).tolist()
    constant = sum(r * r for r in fit.rest)
    exact = (fit.n * fit.n * s - 2 * fit.n * m + constant for s, m in zip(squares, mixed, strict=True))
    return [v if v < 1 << 63 else None for v in exact]


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every kept row of ``vectors`` (vec_id, embedding) and component.

    Kept are vectors without null, infinite or NaN entries, as x = floor(scale * entry) + shift. All of them are the fit
    list: ``n`` and the sums S. ``deviation`` is the sum of (n * x - S)**2; ``whitened`` is x - S / n projected on the
    component and divided by the root of its eigenvalue, of which ``explained`` is the share of the trace.

    Edge cases: null and empty vectors are left out. If vectors differ in length, the length that most of them have
    counts (of two as frequent, the longer), and the others are left out. Entries beyond ``LIMIT`` count as ``LIMIT``.
    Repeated rows count and come back each, rows without vec_id too. Fewer dimensions than ``components``, or directions
    without variance, give fewer components; a single vector, or equal ones, have none and so no rows. Equal eigenvalues
    keep the order of the decomposition, and each component has one sign in all rows. A deviation that a long cannot hold
    is null. Vectors of many dimensions make wide blocks and a scatter of dimensions squared on the driver. An empty
    table gives an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], _RESULT)
    packed = pack(vectors, scale, shift, rows_per_block)
    found = packed.groupBy("dims").agg(F.sum(F.col("rows").cast("long")).alias("n")).orderBy(F.col("n").desc(), F.col("dims").desc()).first()
    if found is None:
        return empty
    dims, n = found["dims"], found["n"]
    totals = exact_sums(packed.filter(F.col("dims") == dims), []).orderBy("dim").collect()
    sums = [int(r["total"]) for r in totals]
    blocks = numbered(packed, dims)
    n_blocks = blocks.count()

    fit = Fit(n, np.array([s // n for s in sums], np.int64), [s % n for s in sums], np.zeros(0), 0.0, np.zeros((dims, 0)))
    centre = fit.centred
    entries = blocks.select("block", "x").rdd.map(lambda r: ((r["block"], 0), _as_block(centre(_rows(r["x"], dims)), rows_per_block)))
    # Both products read the blocks, each twice. Kept on the executors' disks; a lost executor's are made again.
    table = BlockMatrix(entries, rows_per_block, dims, n_blocks * rows_per_block, dims).persist(StorageLevel.DISK_ONLY)
    scatter = _times(table.transpose(), table, -(-n_blocks // BLOCKS_PER_SPLIT)).toLocalMatrix().toArray()

    covariance = scatter / n
    values, directions = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > _FLAT * max(values.max(), 0)]
    if not len(order) or values.max() <= 0:
        table._java_matrix_wrapper.call("blocks").unpersist(False)
        return empty
    fit = Fit(n, fit.whole, fit.rest, values[order], float(np.trace(covariance)), directions[:, order] / np.sqrt(values[order]))
    width = len(order)
    whitening = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(dims, width, fit.whitening.ravel(order="F")))], 1), dims, width, dims, width)
    product = _times(table, whitening, 1).blocks.map(lambda b: (b[0][0], bytearray(np.ascontiguousarray(b[1].toArray()).tobytes())))
    whitened = spark.createDataFrame(product, "block int, whitened binary")
    projected = cut_lineage(blocks.join(whitened, "block"))
    table._java_matrix_wrapper.call("blocks").unpersist(False)
    error = identity_error(projected, n, width)
    shares = (fit.values / fit.trace).tolist()

    def unpack(batches: Batches) -> Batches:
        for batch in batches:
            for ids, data, white in zip(batch.column("ids"), batch.column("x"), batch.column("whitened"), strict=True):
                x = _rows(data.as_buffer(), dims)
                rows = len(x)
                scores = np.frombuffer(white.as_buffer()).reshape(-1, width)[:rows]
                repeat = pa.array(np.repeat(np.arange(rows), width))
                yield pa.RecordBatch.from_arrays([
                    ids.values.take(repeat), pa.array(np.tile(np.arange(1, width + 1), rows), pa.int32()), pa.array(np.full(rows * width, n)),
                    pa.array(deviations(x, fit), pa.int64()).take(repeat), pa.array(scores.ravel()), pa.array(np.tile(shares, rows)), pa.array(np.full(rows * width, error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return in_arrow(projected.select("ids", "x", "whitened"), unpack, _RESULT)
