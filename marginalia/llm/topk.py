"""Exact top-k inner-product search by block-at-a-time pruning.

Vectors are quantised to whole numbers, cut into blocks of consecutive ids, and
every block keeps the largest and smallest value of each dimension.  The bound of
a block for a query is the sum over dimensions of the larger of query value times
maximum and query value times minimum.  Per query blocks come in descending order
of their bounds and are scored through the block's own rows until the next bound
falls below the k-th score.

Blocks of queries meet groups of document blocks as keyed rows, so a task holds
one query block and one group at a time and nothing is sent to every executor.

Defined results.  Vectors that are null, empty of an id, or hold a null or
non-finite component take no part.  Vectors of unlike length compare as if the
shorter one ended in zeros.  Rows with one id and equal values count once; other
rows under one id are all candidates, and none of them for a query with that id.
Components beyond 2^26 after scaling are refused with an error, as their sums
would leave whole numbers of 64 bits.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import stage

BLOCK = 256  # vectors of a block
GROUP = 64  # document blocks that meet in a task, about
SIDE = 16  # query blocks that meet them, about
LARGEST = 2.0**26


def quantise(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``vec_id, v``: ``floor(scale * x)`` of every usable vector, once each."""
    v = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    good = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    checked = F.when(F.forall("v", lambda x: F.abs(x) <= LARGEST), F.col("v")).otherwise(F.raise_error(F.lit("component too large for whole-number scores")))
    return (vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & good)
            .select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
            .select("vec_id", checked.alias("v")).distinct())


def _blocks(rows: DataFrame, out: str) -> DataFrame:
    """Pack sorted rows into blocks: ``<out>`` (block name), ``n``, ``dims``, ``ids`` and ``data`` (raw doubles)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pack(ids: list, vs: list) -> pd.DataFrame:
            dims = max(len(v) for v in vs)
            m = np.zeros((len(vs), dims))
            for i, v in enumerate(vs):
                m[i, : len(v)] = v
            return pd.DataFrame({out: [f"{ids[0]}-{ids[-1]}-{len(ids)}"], "n": [len(ids)], "dims": [dims],
                                 "ids": [np.array(ids, np.int64).tobytes()], "data": [m.tobytes()]})

        ids: list = []
        vs: list = []
        for pdf in frames:
            for i, v in zip(pdf["vec_id"], pdf["v"], strict=True):
                ids.append(i)
                vs.append(v)
                if len(ids) == BLOCK:
                    yield pack(ids, vs)
                    ids, vs = [], []
        if ids:
            yield pack(ids, vs)

    return rows.mapInPandas(run, f"{out} string, n int, dims int, ids binary, data binary")


def _matrix(row) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a packed block."""
    return np.frombuffer(row.ids, np.int64), np.frombuffer(row.data, np.float64).reshape(row.n, row.dims)


def _widen(m: np.ndarray, dims: int) -> np.ndarray:
    return m if m.shape[1] == dims else np.pad(m, ((0, 0), (0, dims - m.shape[1])))


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole-number products; doubles hold them exactly while sums stay below 2^53."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1]) < 2.0**53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def _search(k: int):
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max

    def of_block(qid: np.ndarray, q: np.ndarray, blocks: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best rows for every query; absent ones have the id ``high``."""
        bound = _product(np.maximum(q, 0), np.array([x.max(axis=0) for _, x in blocks]))
        bound += _product(np.minimum(q, 0), np.array([x.min(axis=0) for _, x in blocks]))
        order = np.argsort(-bound, axis=1, kind="stable")
        ids, scores = np.full((len(qid), k), high), np.full((len(qid), k), low)
        live = np.arange(len(qid))
        for step in range(len(blocks)):
            # An equal bound may still win by a smaller id.
            live = live[bound[live, order[live, step]] >= scores[live, -1]]
            at = order[live, step]
            for b in np.unique(at):
                mine, (doc, x) = live[at == b], blocks[b]
                own = doc[None, :] == qid[mine][:, None]
                new_id = np.where(own, high, np.broadcast_to(doc, own.shape))
                new_score = np.where(own, low, _product(q[mine], x))
                all_id, all_score = np.hstack([ids[mine], new_id]), np.hstack([scores[mine], new_score])
                pick = np.lexsort((all_id, ~all_score), axis=1)[:, :k]
                ids[mine], scores[mine] = np.take_along_axis(all_id, pick, 1), np.take_along_axis(all_score, pick, 1)
        return ids, scores

    def run(queries: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")]
        blocks = [_matrix(r) for r in docs.itertuples(index=False)]
        for row in queries.itertuples(index=False) if blocks else ():
            qid, q = _matrix(row)
            dims = max([q.shape[1], *(x.shape[1] for _, x in blocks)])
            ids, scores = of_block(qid, _widen(q, dims), [(i, _widen(x, dims)) for i, x in blocks])
            real = ids != high
            found.append(pd.DataFrame({"query_id": np.repeat(qid, real.sum(axis=1)), "vec_id": ids[real], "score": scores[real]}))
        return pd.concat(found, ignore_index=True)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products per query, ties to smaller ids."""
    rows = stage(quantise(vectors, id_col, vec_col, scale).repartitionByRange("vec_id").sortWithinPartitions("vec_id"), "vectors")
    docs = stage(_blocks(rows.repartitionByRange("vec_id").sortWithinPartitions("vec_id"), "block"), "blocks")
    asked = stage(_blocks(rows.filter(is_query).repartitionByRange("vec_id").sortWithinPartitions("vec_id"), "block"), "asked")
    groups, sides = -(-docs.count() // GROUP) or 1, -(-asked.count() // SIDE) or 1
    of = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    left = asked.withColumn("side", of(sides)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = docs.withColumn("part", of(groups)).withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    keep = ["side", "part", "n", "dims", "ids", "data"]
    found = left.select(keep).groupBy("side", "part").cogroup(right.select(keep).groupBy("side", "part")).applyInPandas(
        _search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
