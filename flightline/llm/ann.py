"""Nearest neighbours by multi-index hashing of learned rotated binary codes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 20_000  # rows that the rotations and radii are learned from
ROTATIONS, SHARE = 4, 0.15
ROWS, QUERIES = 8192, 2048  # a task's block of rows and of queries


def learned_codes(sample: np.ndarray, rotations: int, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): each rotation is refined so that the signs lie close to the rotated vectors (iterative quantisation)."""
    mean = sample.mean(axis=0)
    x = sample - mean
    rng, made = np.random.default_rng(17), []
    for _ in range(rotations):
        r = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.sign(x @ r).T @ x)
            r = (u @ vt).T
        made.append(r)
    return mean, np.concatenate(made, axis=1)


def codes_of(vectors: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    return np.packbits((vectors - mean) @ projection > 0, axis=1)


NEAR = [[np.flatnonzero(np.bitwise_count(np.arange(256, dtype=np.uint8) ^ np.uint8(q)) <= r) for r in range(9)] for q in range(256)]


class SubstringIndex:
    """For each byte of the codes, the rows in order of that byte's value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, s], kind="stable") for s in range(codes.shape[1])]
        self.first = [np.searchsorted(codes[o, s], np.arange(257)) for s, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code differs in at most ``radius`` bits: with radius = m a + b over m substrings, one of the first b + 1 differs in at most a bits
        or one of the others in at most a - 1."""
        m = self.codes.shape[1]
        a, b = divmod(radius, m)
        seen = np.zeros(len(self.codes), bool)
        for s in range(m):
            r = a if s <= b else a - 1
            if r >= 0:
                first, order = self.first[s], self.order[s]
                for v in NEAR[code[s]][min(r, 8)].tolist():
                    seen[order[first[v]:first[v + 1]]] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= radius]


def usable(vector: Column) -> Column:
    """Vectors that are null, zero, or hold null or non-finite components take no part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def neighbours(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, share: float = SHARE, rotations: int = ROTATIONS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found by Euclidean distance, ties to the smaller id.

    Rotations are learned from the ``SAMPLE`` rows of smallest id hash; a query's radius is that of the nearest ``share`` of the sample's codes.  Each task
    indexes a block of rows by code substrings, probes it for every code within the radius of a block of queries, and ranks these by their exact
    distances; where a block has fewer than ``k`` within the radius all its rows are ranked, so no query comes short.  At most ``k`` rows a query and block go on.
    Rows of another length than the sample's commonest, a null id, or of :func:`usable` false take no part; rows with the query's id aren't candidates.  Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q")).filter("vec_id IS NOT NULL")
    rows = rows.filter(usable(F.col("v")))
    taken = rows.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()["v"].tolist()
    if not taken:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths, n = np.unique([len(v) for v in taken], return_counts=True)
    size = int(lengths[n.argmax()])
    sample = np.array([v for v in taken if len(v) == size])
    mean, projection = learned_codes(sample, rotations)
    told = rows.sparkSession.sparkContext.broadcast((mean, projection, codes_of(sample, mean, projection)[:2000]))  # the sample's bound holds for it
    rows = rows.filter(F.size("v") == size)
    total, asked = rows.agg(F.count("*"), F.count_if("q")).first()
    blocks, rounds = total // ROWS + 1, asked // QUERIES + 1
    spread = lambda df, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("a"), spread(rows, rounds).alias("b"))
    right = rows.filter("q").select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(rounds)).cast("int").alias("b"), spread(rows, blocks).alias("a"))

    def search(key, table, queries):
        mean, projection, known = told.value
        matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy().reshape(len(t), size)
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(table) and len(queries):
            x, ids, y = matrix(table), table.column("vec_id").to_numpy(), matrix(queries)
            index = SubstringIndex(codes_of(x, mean, projection))
            nearest = max(0, int(share * len(known)) - 1)
            for name, vector, code in zip(queries.column("vec_id").to_pylist(), y, codes_of(y, mean, projection)):
                radius = int(np.partition(np.bitwise_count(known ^ code).sum(axis=1), nearest)[nearest])
                found = index.within(code, radius)
                found = found[ids[found] != name]
                if len(found) < k:
                    found = np.flatnonzero(ids != name)
                distance = np.sqrt(((x[found] - vector) ** 2).sum(axis=1))
                best = np.lexsort((ids[found], distance))[:k]
                out["query_id"] += [name] * len(best)
                out["vec_id"] += ids[found[best]].tolist()
                out["score"] += distance[best].tolist()
        return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
