"""Operator 3. Exact top-k search by inner product: no-random-access aggregation over sorted component lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, written

#: Vectors in one packed block of candidates and of queries; candidate blocks that one task searches one after another.
CANDIDATES, QUERIES, BLOCKS_PER_GROUP = 4096, 1024, 16
#: How deep the sorted lists have been read when the bounds are looked at, as fractions of a block.
DEPTHS = (0.0625, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0)
#: Reading stops once no more candidates than so many times k can qualify; these are resolved.
FEW = 4
PACK = "n int, dim int, ids binary, values binary"
FOUND = "query_id long, vec_id long, score long"


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component x as double; null for a vector that is null or holds a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _pack(size: int):  # noqa: ANN202
    """Packs rows (vec_id, q) into blocks of up to `size` vectors, short ones padded with zeros."""

    def block(ids: list[int], rows: list[np.ndarray]) -> pd.DataFrame:
        dim = max((len(r) for r in rows), default=0)
        values = np.zeros((len(rows), dim), np.int64)
        for i, r in enumerate(rows):
            values[i, : len(r)] = r
        return pd.DataFrame({"n": np.array([len(rows)], np.int32), "dim": np.array([dim], np.int32), "ids": [np.array(ids, np.int64).tobytes()], "values": [values.tobytes()]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[int] = []
        rows: list[np.ndarray] = []
        for batch in batches:
            for i, q in zip(batch["vec_id"], batch["q"], strict=True):
                ids.append(i)
                rows.append(np.asarray(q, np.int64))
                if len(rows) >= size:
                    yield block(ids, rows)
                    ids, rows = [], []
        if rows:
            yield block(ids, rows)

    return run


def packed(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks of vectors, numbered from 0 without gaps; written, so that the numbers hold whatever is computed anew."""
    blocks = written(vectors.mapInPandas(_pack(size), PACK), name)
    # numbers without gaps, from the narrow column alone
    blocks = blocks.withColumn("at", F.monotonically_increasing_id())
    order = blocks.select("at").withColumn("block", F.row_number().over(Window.orderBy("at")) - 1)  # one row per block of thousands of vectors
    return written(blocks.join(order, "at").drop("at"), name)


class Lists:
    """One sorted list per component over a block of candidates, read from the top or from the bottom, entry after entry."""

    def __init__(self, values: np.ndarray) -> None:
        self.n, self.dim = values.shape
        self.order = np.ascontiguousarray(np.argsort(values, 0, kind="stable").T)
        self.values = np.take_along_axis(values.T, self.order, 1).astype(np.float64)
        #: The place of each candidate in each list: what has been seen of it, told without marking entry by entry.
        self.place = np.empty((self.dim, self.n), np.min_scalar_type(self.n))
        np.put_along_axis(self.place, self.order, np.arange(self.n, dtype=self.place.dtype)[None, :], 1)
        self.most = float(np.abs(self.values).max(initial=0))
        self.first = 0  # of DEPTHS: where bounds are looked at first, a step before the depth that sufficed for the last query

    def read(self, query: np.ndarray, own: np.ndarray, floor: float, k: int) -> tuple[np.ndarray, int]:
        """Places of the candidates that can be among the query's k best, and how many entries were read to tell.

        A list is read from its top where the query's component is positive, from its bottom where it is negative, and not at all where
        it is 0: the product falls from entry to entry. A candidate's score lies between what its entries read so far add up to, with
        the list's last product for each entry not seen, and the same with the last product read. Reading stops when all but a few have
        an upper bound below the k-th lower bound or below `floor`."""
        q, n = query.astype(np.float64), self.n
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        least, last = np.zeros(self.dim), np.zeros(self.dim)
        least[up], least[down] = q[up] * self.values[up, 0], q[down] * self.values[down, -1]
        lower = np.full(n, least.sum())
        # whole numbers, so exact in 32 bits where they are small
        unseen = np.zeros((self.dim, n), np.float32 if 2 * self.most * np.abs(q).max(initial=0) * self.dim < 2**24 else np.float64)
        at = depth = 0
        for look in range(self.first, len(DEPTHS)):
            at, depth = depth, max(1, round(DEPTHS[look] * n))
            if at == depth:
                continue
            for lists, part, end in ((up, slice(n - depth, n - at), 0), (down, slice(at, depth), -1)):
                product = q[lists, None] * self.values[lists, part]
                last[lists] = product[:, end]
                product -= least[lists, None]
                lower += np.bincount(self.order[lists, part].ravel(), product.ravel(), n)
            unseen[up], unseen[down] = self.place[up] < n - depth, self.place[down] >= depth
            upper = lower + (last - least).astype(unseen.dtype) @ unseen
            known = np.where(own, -np.inf, lower)
            kth = np.partition(known, n - k)[n - k] if n > k else -np.inf
            may = np.flatnonzero((upper >= max(kth, floor)) & ~own)
            if len(may) <= FEW * k:
                break
        self.first = max(look - 1, 0)
        return may, depth * (len(up) + len(down))


def search(queries: np.ndarray, query_ids: np.ndarray, blocks: Iterator[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of all blocks for each query, its own id left out: places of queries, ids, scores."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    floor = np.full(len(queries), -np.inf)  # the k-th best exact score so far: a candidate below it can't qualify
    for values, ids in blocks:
        dim = max(values.shape[1], queries.shape[1])
        values, q = (np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in (values, queries))
        exact = float(np.abs(values).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(dim, 1) < 2**53
        n = len(values)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        if exact and dim and n:
            lists = Lists(values)
            for i, (own, least) in enumerate(zip(query_ids.tolist(), floor.tolist(), strict=True)):
                may, _ = lists.read(q[i], ids == own, least, k)
                pairs.append((np.full(len(may), i), may))
        else:  # components too large for exact doubles, or none: every candidate is resolved
            a, b = np.nonzero(query_ids[:, None] != ids[None, :])
            pairs.append((a, b))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        if exact:
            score = np.concatenate([np.einsum("ij,ij->i", q[a[s : s + 65536]], values[b[s : s + 65536]]) for s in range(0, len(a), 65536)] or [np.empty(0, np.int64)])
        else:
            score = np.array([sum(int(x) * int(y) for x, y in zip(q[i], values[j], strict=True)) for i, j in zip(a, b, strict=True)], object)
            score = np.array([int(s) for s in score], np.int64)  # beyond 64 bits: OverflowError
        held.append((a, ids[b], score))
        a, i, s = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((i, -s, a))
        a, i, s = a[order], i[order], s[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        held = [(a[rank < k], i[rank < k], s[rank < k])]
        full = rank == k - 1
        floor[a[full]] = s[full]
    return held[0] if held else (np.empty(0, np.int64),) * 3


def _matrix(row: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["values"], np.int64).reshape(row["n"], row["dim"]), np.frombuffer(row["ids"], np.int64)


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest integer inner products of each query with all other rows: query_id, rank, vec_id, score; ties to the smaller id.

    Queries and candidates are packed into blocks of bounded size. Every block of queries meets every group of candidate blocks in a
    task of its own, which searches block after block: for a query it reads the components' sorted lists in step, entry after entry, adds
    up what it has seen of each candidate, holds a lower and an upper bound for every one, and stops once few can still reach its k-th
    best lower bound, or the k-th best score of the blocks before; these are then resolved exactly. So a task's memory doesn't grow with the data,
    equal or frequent vectors cost what others do, and each group hands on at most k rows per query.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows with a null id; shorter vectors count as
    padded with zeros; a query leaves out every row that bears its own id; rows that repeat an id each count as candidates; an empty
    table, or none that is a query, gives no rows; scores beyond 64 bits raise an error; further columns are ignored."""
    bounded_batches(vectors.sparkSession)
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("q"), is_query.alias("is_query")).where("vec_id is not null and q is not null")
    candidates = packed(good.select("vec_id", "q"), CANDIDATES, "topk-candidates")
    queries = packed(good.where("is_query").select("vec_id", "q"), QUERIES, "topk-queries")
    n_groups = -(-candidates.count() // BLOCKS_PER_GROUP)
    n_queries = queries.count()
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0))))
    left = queries.select("*", F.col("block").cast("int").alias("qb")).select("*", numbers(n_groups).alias("cg"))
    right = candidates.select("*", (F.col("block") % max(n_groups, 1)).cast("int").alias("cg")).select("*", numbers(n_queries).alias("qb"))

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({x: np.empty(0, np.int64) for x in ("query_id", "vec_id", "score")})
        own, ids = _matrix(q.iloc[0])
        a, i, s = search(own, ids, (_matrix(row) for _, row in c.iterrows()), k)
        return pd.DataFrame({"query_id": ids[a], "vec_id": i, "score": s})

    met = left.groupBy("qb", "cg").cogroup(right.groupBy("qb", "cg")).applyInPandas(meet, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
