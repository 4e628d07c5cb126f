"""Whitening of embeddings with distributed block matrices of Spark's MLlib."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.operators.storage import settle, with_row

#: Numbers of a block, its columns at most, blocks that one piece of a product adds up, components returned.
NUMBERS, COLUMNS, MIDDLE, KEPT = 1 << 18, 1024, 16, 32
#: Components whose variance is below this share of the largest have none but rounding errors.
RANK = 1e-12


def scaled(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each component c; null if the vector or a component is null, not finite, or too large for a long."""
    wide = F.transform(vector, lambda c: c.cast("double"))
    fine = F.forall(wide, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < 2.0**52), F.lit(False)))
    return F.when(fine, F.transform(wide, lambda c: F.floor(c * 64) + 1000000))


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``i``, 0 ... n - 1 without gaps: the rows before the own partition plus those before in it. ``rows`` are settled first, so the numbers hold."""
    placed = settle(rows.withColumn("at", F.monotonically_increasing_id()), "placed").withColumn("part", F.shiftright("at", 33))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n")).toPandas().sort_values("part")  # one row per partition
    before = sizes["n"].cumsum() - sizes["n"]
    table = rows.sparkSession.createDataFrame(list(zip(map(int, sizes["part"]), map(int, before))), "part bigint, before bigint")
    return placed.join(table, "part").withColumn("i", F.col("before") + F.col("at") - F.shiftleft("part", 33)).drop("part", "at", "before")


def block_rows(dim: int) -> int:
    """Rows of a block: as many as NUMBERS allows. The driver lists the blocks (not their contents) when it plans a product."""
    return max(1, NUMBERS // min(dim, COLUMNS))


def block_matrix(rows: DataFrame, n: int, dim: int) -> BlockMatrix:
    """The block matrix of rows (i, v); v is an array of doubles. Kept on the executors that built it; what is lost is built again from the settled rows."""
    vectors = rows.select(F.col("i").alias("index"), array_to_vector("v").alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n, dim).toBlockMatrix(block_rows(dim), min(dim, COLUMNS)).persist(StorageLevel.MEMORY_AND_DISK)


def product(left: BlockMatrix, right: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """left x right; the inner dimension is cut into ``splits`` pieces, whose products are added."""
    found = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(found, left.rowsPerBlock, right.colsPerBlock)


def released(matrix: BlockMatrix) -> None:
    matrix._java_matrix_wrapper._java_model.blocks().unpersist(False)


def scatter(matrix: BlockMatrix, n: int) -> np.ndarray:
    """Transpose of the matrix times itself: dim x dim numbers, whatever the number of rows."""
    return product(matrix.transpose(), matrix, max(1, -(-n // (matrix.rowsPerBlock * MIDDLE)))).toLocalMatrix().toArray()


def local_blocks(matrix: np.ndarray, like: DataFrame, rows: int) -> BlockMatrix:
    """A small matrix as a block matrix with blocks of ``rows`` rows."""
    d, k = matrix.shape
    blocks = [((b, 0), DenseMatrix(min(rows, d - b * rows), k, matrix[b * rows:(b + 1) * rows].ravel(order="F"))) for b in range(-(-d // rows))]
    return BlockMatrix(like.sparkSession.sparkContext.parallelize(blocks, 1), rows, k, d, k)


def components(covariance: np.ndarray, kept: int = KEPT) -> tuple[np.ndarray, np.ndarray]:
    """Variances, falling, and unit eigenvectors (columns) of the components with a variance."""
    value, vector = np.linalg.eigh((covariance + covariance.T) / 2)
    value, vector = value[::-1], vector[:, ::-1]
    some = int((value > RANK * max(value[0], 0)).sum()) if len(value) and value[0] > 0 else 0
    return value[:min(some, kept)], vector[:, :min(some, kept)]


SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, kept: int = KEPT) -> DataFrame:
    """Principal components of (vec_id, x), x an array of longs, each scaled to unit variance: one row per row and component.

    Rows whose x is null take no part. The commonest length of x is the dimension (of equals the greatest); rows of another
    length take no part either. n counts the rows that do, each as often as it occurs; a null or repeated vec_id is only
    carried along. deviation is the sum over dimensions of (n x - S)^2, S the sum of the dimension; null beyond a long. Components without
    variance (equal rows, fewer rows than dimensions) cannot be scaled and have no rows; an empty table gives none. The
    dim x dim covariance is the only thing that the driver sees. Other columns are ignored.

    Sums are exact longs, so centred rows (n x - S) / n have one rounding each however large the common offset is.
    """
    given = rows.where("x IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "x")
    lengths = given.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    empty = rows.sparkSession.createDataFrame([], SCHEMA)
    if lengths is None or not lengths["d"]:
        return empty
    dim, n = lengths["d"], lengths["n"]
    indexed = settle(numbered(given.where(F.size("x") == dim)), "vectors")
    sums = indexed.select(F.posexplode("x").alias("p", "c")).groupBy("p").agg(F.sum("c").alias("s"))
    total = F.lit(n).cast("long")
    sums = settle(sums.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "s"))), lambda e: e["s"]).alias("sums")), "sums")
    apart = F.zip_with("x", "sums", lambda c, s: F.try_subtract(F.try_multiply(total, c), s))
    square = F.aggregate("m", F.lit(0).cast("long"), lambda a, c: F.try_add(a, F.try_multiply(c, c)))
    moved = with_row(indexed, sums).withColumn("m", apart)
    centred = settle(moved.select("i", "vec_id", square.alias("deviation"), F.transform("m", lambda c: c / F.lit(float(n))).alias("v")), "centred")
    matrix = block_matrix(centred, n, dim)
    covariance = scatter(matrix, n) / n
    value, vector = components(covariance, kept)
    if not len(value):
        released(matrix)
        return empty
    projected = product(matrix, local_blocks(vector / np.sqrt(value), rows, min(dim, COLUMNS))).toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)
    found = settle(found.select(F.col("index").alias("i"), vector_to_array("vector").alias("v")), "whitened")
    released(matrix)
    matrix = block_matrix(found, n, len(value))
    error = np.abs(scatter(matrix, n) / n - np.eye(len(value))).max()
    released(matrix)
    share = F.array(*[F.lit(float(e)) for e in value / np.trace(covariance)])
    joined = centred.select("i", "vec_id", "deviation").join(found, "i")
    return joined.select("vec_id", "deviation", F.posexplode("v").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).alias("component"), total.alias("n"), "deviation", "whitened",
        F.get(share, F.col("k")).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
