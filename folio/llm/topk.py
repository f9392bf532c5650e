"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates lie in blocks; a block keeps, for each dimension, the list of its vectors sorted by that component. For a query the lists are
read from the end its sign favours, in growing steps; each vector met is scored in full. No vector not yet
met can score more than the query's product with the components at the current places, so reading stops once that bound
is below the kth score so far. Where the bound shows beforehand that reading would meet most of the block, the block is
scored as a matrix instead. A task holds one block, whose lists are sorted once, and streams the queries past it; what leaves
it is k rows for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, pick

K, SCALE = 20, 64
#: Vectors in a block of candidates, at most; queries scored together; list entries that give a first kth score; first step of reading.
BLOCK, QUERIES, HEAD, STEP = 16_384, 256, 1024, 1 / 128
#: Once reading to the bound would leave at most one in FEW vectors of a block unmet, all are scored.
FEW = 4
LEAST = np.iinfo(np.int64).min


def quantize(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v: floor(SCALE * x) as longs. Null or empty vectors, and those with a null or non-finite component, are left out."""
    d = pick(vectors, vec_id=vec_id, v=embedding).select("vec_id", F.transform("v", lambda x: x.cast("double")).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return d.filter(F.col("v").isNotNull() & (F.size("v") > 0) & fine).select("vec_id", F.transform("v", lambda x: F.floor(x * SCALE).cast("long")).alias("v"))


class Lists:
    """One block of candidates (ids ascending) with its sorted per-dimension lists."""

    def __init__(self, ids: np.ndarray, m: np.ndarray):
        self.ids, self.m = ids, m
        self.largest = int(np.abs(m).max(initial=0))
        self.order = np.argsort(m, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(m, self.order, axis=0)
        self.f = m.astype(np.float64)
        n = len(ids)
        self.depths = []
        depth = max(1, int(n * STEP))
        while depth < n:
            self.depths.append(depth)
            depth *= 2
        #: Vectors at the ends of the lists: they give each query a kth score before its lists are read.
        ends = min(n, -(-HEAD // (2 * m.shape[1])))
        self.head = np.unique(np.concatenate([self.order[:ends].ravel(), self.order[n - ends :].ravel()]))

    def _scores(self, rows: np.ndarray | slice, q: np.ndarray) -> np.ndarray:
        """Exact products of rows with the columns of q: through doubles only where no sum can leave 53 bits."""
        if self.largest * int(np.abs(q).max(initial=0)) * len(q) < 1 << 53:
            return (self.f[rows] @ q.astype(np.float64)).astype(np.int64)
        return self.m[rows] @ q

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each of depths and each row of q: what a vector that the lists have not shown up to there can score at most."""
        n, up, down = len(self.ids), np.maximum(q, 0).T, np.minimum(q, 0).T
        high = np.array([self.sorted[n - 1 - d] for d in self.depths]).reshape(-1, q.shape[1])
        low = np.array([self.sorted[d] for d in self.depths]).reshape(-1, q.shape[1])
        return high @ up + low @ down

    def read(self, q: np.ndarray, mine: slice, floor: int, k: int) -> tuple[np.ndarray, int]:
        """The vectors whose score may be among the k best, by reading the lists in turn; and how many were scored.

        mine: the query's own rows, which count for no kth score. floor: a score that k other candidates reach.
        """
        n, used = len(self.ids), np.flatnonzero(q)
        down = q[used] > 0
        met, scores, before = np.zeros(n, bool), np.full(n, LEAST), 0
        met[mine] = True
        limits = self.bounds(q[None])[:, 0]
        for depth, limit in zip(self.depths, limits):
            part = np.concatenate([self.order[n - depth : n - before, used[down]].ravel(), self.order[before:depth, used[~down]].ravel()])
            new = np.zeros(n, bool)
            new[part] = True
            fresh = np.flatnonzero(new & ~met)
            met[fresh] = True
            scores[fresh] = self._scores(fresh, q)
            if limit < floor:
                break
            if n > k:
                floor = max(floor, int(np.partition(scores, n - k)[n - k]))
            if limit < floor:
                break
            before = depth
        else:
            rest = np.flatnonzero(~met)
            met[rest] = True
            scores[rest] = self._scores(rest, q)
        return np.flatnonzero(met & (scores >= floor)), int(met.sum())

    def top(self, own: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """For the queries (own ids, vectors as rows): query numbers, row numbers and scores of the best k each (ties to smaller ids);
        and how many vectors were scored."""
        n, count = len(self.ids), len(q)
        who, rows, scored = [], [], 0
        mine = [slice(a, b) for a, b in zip(np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, "right"))]
        # a kth score from the lists' ends
        floor = np.full(count, LEAST)
        if len(self.head) > k:
            ends = np.where(self.ids[self.head][:, None] == own[None], LEAST, self._scores(self.head, q.T))
            floor = np.partition(ends, len(self.head) - k, axis=0)[len(self.head) - k]
            scored += ends.size
        if self.depths:
            stops = self.bounds(q) < floor[None]
            share = 1 - (1 - np.minimum(1, np.array(self.depths)[:, None] / n)) ** np.count_nonzero(q, axis=1)[None]
            soon = (stops & (share < 1 - 1 / FEW)).any(0)
        else:
            soon = np.zeros(count, bool)
        for i in np.flatnonzero(soon):
            found, met = self.read(q[i], mine[i], int(floor[i]), k)
            who.append(np.full(len(found), i))
            rows.append(found)
            scored += met
        all_ = np.flatnonzero(~soon)
        if len(all_):
            s = self._scores(slice(None), q[all_].T)
            scored += s.size
            for j, i in enumerate(all_):
                s[mine[i], j] = LEAST
            least = np.partition(s, n - k, axis=0)[n - k] if n > k else floor[all_]
            at, j = np.nonzero(s >= least[None])
            who.append(all_[j])
            rows.append(at)
        who, rows = np.concatenate(who), np.concatenate(rows)
        other = self.ids[rows] != own[who]
        who, rows = who[other], rows[other]
        scores = np.einsum("ij,ij->i", self.m[rows], q[who])
        order = np.lexsort((self.ids[rows], -scores, who))
        who, rows, scores = who[order], rows[order], scores[order]
        first = np.concatenate([[True], who[1:] != who[:-1]]) if len(who) else np.zeros(0, bool)
        place = np.arange(len(who)) - np.repeat(np.flatnonzero(first), np.diff(np.append(np.flatnonzero(first), len(who))))
        best = place < k
        return who[best], rows[best], scores[best], scored


def _meet(k: int):
    """Rows sorted by dims, block and query (candidates first, by vec_id) -> query_id, vec_id, score of each query's k best of the block."""

    def answer(lists: Lists, ids: list, vectors: list) -> pa.RecordBatch:
        own = np.array(ids, np.int64)
        who, rows, scores, _ = lists.top(own, np.stack(vectors), k)
        return pa.RecordBatch.from_arrays([pa.array(own[who]), pa.array(lists.ids[rows]), pa.array(scores)], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lists = None, None
        held: tuple[list, list] = ([], [])  # candidates until the block's first query, then queries
        for b in batches:
            flat, offsets = b.column("v").flatten().to_numpy(), b.column("v").offsets.to_numpy()
            offsets = offsets - offsets[0] if len(offsets) else offsets
            for i, (dims, block, query, vec_id) in enumerate(zip(*(b.column(c).to_pylist() for c in ("dims", "block", "query", "vec_id")))):
                if (dims, block) != key:
                    if lists is not None and held[0]:
                        yield answer(lists, *held)
                    key, lists, held = (dims, block), None, ([], [])
                if query and lists is None:
                    if not held[0]:
                        continue  # no candidates of these dimensions in this block
                    lists, held = Lists(np.array(held[0], np.int64), np.stack(held[1])), ([], [])
                held[0].append(vec_id)
                held[1].append(flat[offsets[i] : offsets[i + 1]])
                if lists is not None and len(held[0]) >= QUERIES:
                    yield answer(lists, *held)
                    held = ([], [])
        if lists is not None and held[0]:
            yield answer(lists, *held)

    return run


def top_k(vectors: DataFrame, work: Workspace, is_query: str, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row (SQL condition on vec_id) its k best other rows.

    Repeated rows of one vec_id are each candidates for other queries; a query's own id is no candidate for it, and
    equal query rows are answered once. Vectors of different lengths do not meet. No valid vectors: no rows. Fewer than k: all.
    Scores must fit a long. Each vector is shuffled once as a candidate; the queries, which a search states, go to every block.
    """
    q = work.keep(quantize(vectors, vec_id, embedding), "vectors").withColumn("dims", F.size("v"))
    n = q.count()
    # full blocks, or as many as there are cores where that makes smaller ones
    blocks = max(1, -(-n // BLOCK), min(vectors.sparkSession.sparkContext.defaultParallelism, n // 2048))
    own = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")
    candidates = q.select("dims", own.alias("block"), F.lit(False).alias("query"), "vec_id", "v")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = q.filter(is_query).dropDuplicates(["vec_id", "v"]).select("dims", every.alias("block"), F.lit(True).alias("query"), "vec_id", "v")
    rows = candidates.unionByName(asked).repartitionByRange(blocks, "dims", "block").sortWithinPartitions("dims", "block", "query", "vec_id")
    found = rows.mapInArrow(_meet(k), "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def oracle_sql(k: int = K) -> str:
    return f"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 20 = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
