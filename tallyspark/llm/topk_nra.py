"""Exact top-k inner products by no-random-access aggregation of sorted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tallyspark.llm import common
from tallyspark.sources import store

#: Rows of one set of sorted lists, and queries answered against it by one task.
SHARD_ROWS = 8192
QUERY_BLOCK = 2048
#: Reads of every list between two looks at the bounds: as a share of the list.
STEPS = 8
#: Queries whose bounds for all rows of a shard are held at once.
LOOK_QUERIES = 64


def top_k(
    vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", query_every: int = 50, scale: int = 256
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` rows with the largest integer inner product for every query.

    Components become floor(scale * x). Queries are the rows whose id is divisible by `query_every`; candidates are all
    rows but the query's own. Ties go to the smaller id, and fewer than `k` rows come back where there are fewer candidates.

    Rows are dealt to shards of about SHARD_ROWS; a shard keeps one list per component, sorted by value. For a query,
    all lists of a shard are read in step from the end that its sign favours. A row read in some lists has an upper bound (the
    value that each unread list has reached). Reading stops when k rows are known completely and no other row, seen or
    not, can still reach them. The best of all shards are merged by rank. The lists are read once for a block of queries:
    which rows are complete is kept in bits, and bounds come from one product of weights and what was read, made only for
    queries with k complete rows. Queries come in blocks, so no task holds all of them and none is broadcast. A block of
    queries is copied to every shard, and cells meet by block and shard, so no join key gathers more than one shard and
    one block. The number of (query, row) pairs still grows as the square of the rows where bounds allow no early stop.

    NULL vectors, NULL ids and vectors with NULL or non-finite components take no part. Shorter vectors count as ending in
    zeros. Rows that repeat an id are each candidates, of one another too, and each queries. Scores are exact; where those of
    a query and shard could pass 2 ** 52, the lists are read query by query in integers instead of doubles. Only a
    score that no long holds stops with an error.
    """
    spark, folder = vectors.sparkSession, common.scratch(vectors.sparkSession)
    x = F.col(vector_col)
    sound = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    )
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    rows = store.staged(
        vectors.filter(F.coalesce(sound, F.lit(False))).select(
            F.col(id_col).cast("long").alias("id"), whole.alias("v"), F.monotonically_increasing_id().alias("row")
        ), folder, "vectors"
    )
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    asked = rows.filter(F.col("id") % query_every == 0)
    shards, blocks = _cells(rows.count(), SHARD_ROWS), _cells(asked.count(), QUERY_BLOCK)
    packed = rows.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)))
    packed = _bundled(packed, ["shard"], width)
    packed = packed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    asked = _bundled(asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1), "v"), F.lit(blocks)).cast("int")), ["block"], width)
    asked = asked.withColumnsRenamed({"ids": "query_ids", "rows": "query_rows", "values": "queries"})
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    met = packed.join(asked.hint("shuffle_hash"), ["block", "shard"])
    met = met.select("block", "ids", "rows", "values", "query_ids", "query_rows", "queries")
    best = met.mapInArrow(_reader(k, width), "query_id long, nth long, vec_id long, score long")
    by_score = W.partitionBy("query_id", "nth").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _cells(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def _bundled(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """One row per cell: its ids and its components as arrays of 64-bit integers in bytes. Cells are bounded in size."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for cell, *found in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(cell, []).append(found)
        for cell, found in held.items():
            ids, places = (np.array([f[c] for f in found], np.int64) for c in (0, 1))
            values = np.zeros((len(found), width), np.int64)
            for r, (_, _, v) in enumerate(found):
                values[r, : len(v)] = v
            packed = [pa.array([a.tobytes()], pa.binary()) for a in (ids, places, values)]
            yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), *packed], [keys[0], "ids", "rows", "values"])

    dealt = rows.select(F.col(keys[0]).cast("long"), "id", "row", "v").repartition(keys[0])
    return dealt.mapInArrow(bundle, f"{keys[0]} long, ids binary, rows binary, values binary")


def _reader(k: int, width: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                places = np.frombuffer(row["rows"], np.int64)
                lists = SortedLists(ids, np.frombuffer(row["values"], np.int64).reshape(len(ids), width))
                query_ids, query_rows = (np.frombuffer(row[c], np.int64) for c in ("query_ids", "query_rows"))
                queries = np.frombuffer(row["queries"], np.int64).reshape(len(query_ids), width)
                found, out = lists.best_of(queries, k, places, query_rows), []
                for nth, (query_id, (at, scores)) in enumerate(zip(query_ids.tolist(), found), row["block"] << 32):
                    out += [(query_id, nth, int(ids[p]), int(s)) for p, s in zip(at, scores)]
                columns = list(zip(*out)) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "nth", "vec_id", "score"])

    return read


def _packed(marks: np.ndarray) -> np.ndarray:
    """Each row of marks as bits in 64-bit words."""
    words = np.zeros((len(marks), -(-marks.shape[1] // 64) * 8), np.uint8)
    words[:, : -(-marks.shape[1] // 8)] = np.packbits(marks, axis=1)
    return words.view(np.uint64)


class SortedLists:
    """One list of (row, value) per component, by falling value; read from either end, never at a chosen row."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        self.ids, self.values = ids, values
        order = np.argsort(-values, axis=0, kind="stable").T  # component x position
        found = np.take_along_axis(values.T, order, axis=1).astype(np.float64)
        # The second half holds the same lists from their far end, for weights below zero.
        self.order = np.concatenate([order, order[:, ::-1]])
        self.sorted = np.concatenate([found, found[:, ::-1]])

    def best(self, q: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the k best rows for one query, ties by id; the query's own row is left out."""
        return self.best_of(q[None], k, own.astype(np.int64), np.ones(1, np.int64))[0]

    def best_of(self, queries: np.ndarray, k: int, places: np.ndarray, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """`best` for every query; left out for each is the row whose place is its own."""
        width = queries.shape[1]
        ends = np.maximum(np.abs(self.sorted[:width, 0]), np.abs(self.sorted[:width, -1]))
        largest = np.abs(queries.astype(np.float64)) @ ends  # what any sum of reads can reach
        exact, found = largest < 2.0**52, {}
        together = np.flatnonzero(exact)
        if len(together):
            kind = np.float32 if largest[together].max() < 2.0**23 else np.float64  # either holds all such sums exactly
            found.update(zip(together.tolist(), self._read(queries[together], k, places, own[together], kind)))
        for at in np.flatnonzero(~exact).tolist():
            found[at] = self._best_in_integers(queries[at], k, places != own[at])
        return [found[at] for at in range(len(queries))]

    def _best_in_integers(self, q: np.ndarray, k: int, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        used = np.flatnonzero(q)
        lists = np.where(q[used] > 0, used, used + len(q))
        largest = np.maximum(np.abs(self.sorted[lists, 0]), np.abs(self.sorted[lists, -1])) * np.abs(q[used].astype(np.float64))
        kind = np.int64 if largest.sum() < 2.0**61 else object  # Python numbers where sums could leave 64 bits on the way
        weights = q[used].astype(kind)
        last = self._integers(lists, -1, kind) * weights  # the least a list can still add
        seen, gained = self._read_integers(weights, lists, last, free, k)
        at, scores = self._first(seen, gained + last.sum(), len(used), free, k)
        if any(abs(int(s)) >= 1 << 63 for s in scores):
            raise OverflowError("a score does not fit 64 bits")
        return at, scores

    def _first(self, seen: np.ndarray, scores: np.ndarray, used: int, free: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        known = np.flatnonzero(free & (seen == used))
        order = np.lexsort((self.ids[known], -scores[known]))[:k]
        return known[order], scores[known][order]

    def _read(
        self, queries: np.ndarray, k: int, places: np.ndarray, own: np.ndarray, kind: type
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """The best rows of each query, from lists that are read in step for all of them; settled queries leave."""
        n, (m, width) = len(self.ids), queries.shape
        weights = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1).astype(kind)
        known, read = np.zeros((2 * width, n), kind), np.zeros((2 * width, n), bool)
        skipped = [np.flatnonzero(places == place) for place in own]
        found: list = [None] * m
        step, waiting = max(1, -(-n // STEPS)), list(range(m))
        for begin in range(0, n, step):
            end = min(n, begin + step)
            np.put_along_axis(known, self.order[:, begin:end], self.sorted[:, begin:end], axis=1)
            if end < n:
                np.put_along_axis(read, self.order[:, begin:end], True, axis=1)
                np.copyto(known, self.sorted[:, end - 1, None], where=~read, casting="same_kind")  # no unread entry is better
                bits = _packed(read)
            for at in range(0, len(waiting), LOOK_QUERIES):
                batch = waiting[at : at + LOOK_QUERIES]
                if end == n:  # read to their end, the lists say the same from either end
                    for q, scores in zip(batch, queries[batch].astype(kind) @ known[:width]):
                        scores[skipped[q]] = -np.inf
                        found[q] = self._best_rows(scores, None, k)
                elif ready := self._ready(queries, batch, skipped, bits, k):
                    for (q, complete), most in zip(ready.items(), weights[list(ready)] @ known):
                        best = self._best_rows(most, complete, k)
                        most[skipped[q]] = most[complete] = -np.inf
                        if most.max() < best[1][-1]:
                            found[q] = best
            waiting = [q for q in waiting if found[q] is None]
            if not waiting:
                break
        return found

    def _ready(self, queries: np.ndarray, batch: list[int], skipped: list[np.ndarray], bits: np.ndarray, k: int) -> dict[int, np.ndarray]:
        """The queries with k complete rows, and these rows: read in all lists that the query uses."""
        n, width, out = len(self.ids), queries.shape[1], {}
        every = _packed(np.ones((1, n), bool))
        bits, complete = np.concatenate([bits, every]), np.repeat(every, len(batch), axis=0)
        for component, weights in enumerate(queries[batch].T):  # the last of the bits are for components of zero
            complete &= bits[np.where(weights > 0, component, np.where(weights < 0, component + width, 2 * width))]
            if not complete.any():
                break
        for at in np.flatnonzero(np.bitwise_count(complete).sum(axis=1) >= k):
            rows = np.flatnonzero(np.unpackbits(complete[at].view(np.uint8), count=n))
            rows = rows[~np.isin(rows, skipped[batch[at]])]
            if len(rows) >= k:
                out[batch[at]] = rows
        return out

    def _best_rows(self, scores: np.ndarray, rows: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of these rows, or of all; ties by id. Those of score -inf are left out."""
        if rows is None:
            least = np.partition(scores, -k)[-k] if len(scores) > k else -np.inf
            rows = np.flatnonzero((scores >= least) & (scores > -np.inf))
        order = np.lexsort((self.ids[rows], -scores[rows]))[:k]
        return rows[order], scores[rows[order]].astype(np.int64)

    def _read_integers(
        self, weights: np.ndarray, lists: np.ndarray, last: np.ndarray, free: np.ndarray, k: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """The same reads with whole numbers, for values that a double would round."""
        n = len(self.ids)
        seen, gained, step = np.zeros(n, np.int64), np.zeros(n, weights.dtype), max(1, -(-n // STEPS))
        for begin in range(0, n, step):
            end = min(n, begin + step)
            for a, (at, weight, least) in enumerate(zip(self.order[lists, begin:end], weights, last)):
                gained[at] += self.values[at, lists[a] % self.values.shape[1]].astype(weights.dtype) * weight - least
                seen[at] += 1
            if end < n:
                frontier = self._integers(lists, end - 1, weights.dtype) * weights - last
                if self._settled(seen, gained, frontier, free, k):
                    break
        return seen, gained

    def _integers(self, lists: np.ndarray, place: int, kind) -> np.ndarray:
        """What the lists hold at one place."""
        return self.values[self.order[lists, place], lists % self.values.shape[1]].astype(kind)

    def _settled(self, seen: np.ndarray, gained: np.ndarray, frontier: np.ndarray, free: np.ndarray, k: int) -> bool:
        """True if k rows are complete and no other can reach the last of them. An unread list adds its frontier at most."""
        done = free & (seen == len(frontier))
        if np.count_nonzero(done) < k:
            return False
        kth = np.sort(gained[done])[-k]
        most = np.sort(frontier)[::-1].cumsum()
        open_rows = free & (seen < len(frontier))
        if not open_rows.any():
            return True
        missing = (len(frontier) - seen[open_rows]).astype(np.int64)
        return bool((gained[open_rows] + most[missing - 1]).max() < kth)  # the largest frontiers bound any unread lists
