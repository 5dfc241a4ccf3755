"""Exact similarity search of a query set against all vectors, in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of one block on either side.
BLOCK_ROWS = 4_096


def _blocks(vectors: DataFrame, key: str, count: int, name: str) -> DataFrame:
    """Vectors with the number of their block; blocks are even, whatever the ids."""
    return vectors.withColumn(name, F.pmod(F.xxhash64(key), F.lit(count)).cast("int"))


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, per: str | None = None) -> DataFrame:
    """The ``k`` vectors most like each query by cosine, itself left out; ties go to the smaller id.

    Both inputs: ``vec_id``, ``embedding`` and ``per`` if given, which asks for the best
    ``k`` of each of its values.  Each block of queries is sent to each block of vectors
    by an equi-join on block numbers and multiplied there; only each block's best leave
    it.  Null vectors and vectors of length zero take no part.
    """
    extra = [per] if per else []
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    left = queries.where(usable).select("vec_id", "embedding")
    right = vectors.where(usable).select(F.col("vec_id").alias("other_id"), F.col("embedding").alias("other"), *[F.col(c).alias("part") for c in extra])
    n_left, n_right = left.count(), right.count()
    lefts, rights = max(1, -(-n_left // BLOCK_ROWS)), max(1, -(-n_right // BLOCK_ROWS))
    query_side = _blocks(left, "vec_id", lefts, "qb").withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(rights - 1))))
    vector_side = _blocks(right, "other_id", rights, "vb").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(lefts - 1))))
    kind = vectors.schema[per].dataType.simpleString() if per else "int"

    def unit(series: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        matrix = np.array(series.tolist(), dtype=np.float64)
        norms = np.linalg.norm(matrix, axis=1)
        return matrix / np.where(norms == 0, 1, norms)[:, None], norms > 0

    def multiply(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "part", "score"]
        if a.empty or b.empty:
            return pd.DataFrame({c: [] for c in columns})
        ua, ok_a = unit(a["embedding"])
        ub, ok_b = unit(b["other"])
        scores = np.where(ok_a[:, None] & ok_b[None, :], ua @ ub.T, -np.inf)
        ids_a, ids_b = a["vec_id"].to_numpy(), b["other_id"].to_numpy()
        scores[ids_a[:, None] == ids_b[None, :]] = -np.inf
        parts = b["part"].to_numpy() if per else np.zeros(len(b), dtype=np.int32)
        out = []
        for part in pd.unique(parts):
            at = np.flatnonzero(parts == part)
            order = np.lexsort((np.broadcast_to(ids_b[at], (len(a), at.size)), -np.round(scores[:, at], 12)), axis=1)[:, :k]
            rows = np.repeat(np.arange(len(a)), order.shape[1])
            chosen = at[order.ravel()]
            out.append(pd.DataFrame({"query_id": ids_a[rows], "vec_id": ids_b[chosen], "part": part, "score": scores[rows, chosen]}))
        best = pd.concat(out)
        return best[np.isfinite(best["score"])]

    pieces = (
        query_side.groupBy("qb", "vb")
        .cogroup(vector_side.groupBy("qb", "vb"))
        .applyInPandas(multiply, f"query_id bigint, vec_id bigint, part {kind}, score double")
    )
    ranked = Window.partitionBy("query_id", "part").orderBy(F.desc(F.round("score", 9)), "vec_id")
    best = pieces.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= k)
    named = best.withColumnRenamed("part", per) if per else best.drop("part")
    return named.withColumn("score", F.round("score", 6))


