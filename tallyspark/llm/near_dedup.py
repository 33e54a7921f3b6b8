"""Near-duplicate groups by SuperMinHash, banding, verification on full sets and union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.llm import common, shingles
from tallyspark.llm.components import connected_components
from tallyspark.sources import store

#: Members of a block; two blocks are compared in one task at a time. A member is offered once per block it may meet.
BLOCK = 1024


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    similarity_pct: int = 80,
    bands: int = 32,
    band_slots: int = 4,
) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id, kept.

    Two texts are linked when their sets of distinct word shingles have a Jaccard similarity of at least
    `similarity_pct` per cent; component_id is the least id that links reach. Sets are SuperMinHash
    signatures of `bands` * `band_slots` slots; texts that agree in a band are candidates. The chance to miss
    a pair at 80 per cent is (1 - 0.8 ** 4) ** 32 = 5e-8, falling fast above.

    1. Equal sets form a class; only one text of each goes on.
    2. Of every band bucket the least class is compared with the others, on full sets, and the links are
       contracted. That settles a group of mutual copies without comparing all its pairs.
    3. A bucket that still holds several components has its remaining pairs tested in blocks of 1,024 by their
       sketches (a byte of each slot). Members outside its largest component are offered to that once in all. Pairs below 75 % of the wanted similarity there (more than five standard
       deviations) go no further. The others are compared on full sets: few of them as pairs, many of them
       in place within the blocks, which return only the links that join components.

    NULL, empty and blank texts have no shingles: n_shingles 0, linked with nothing, kept. A text shorter than
    `shingle_words` words is one shingle. Repeated rows are each returned and share a component; with repeated
    or NULL ids the component has the least non-NULL id. Other columns of `docs` are ignored.
    """
    spark, folder = docs.sparkSession, common.scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    signed = store.staged(
        texts.mapInArrow(
            _signer(shingle_words, bands, band_slots),
            "id long, n long, set_key binary, sketch binary, bands array<long>",
        ),
        folder, "signed",
    )
    first_ids = signed.filter("n > 0").groupBy("set_key").agg(F.min("id").alias("first_id"))
    classes = store.staged(
        signed.filter("n > 0").select("set_key", "n", "sketch", "bands").dropDuplicates(["set_key"])
        .join(first_ids, "set_key").withColumn("cls", F.monotonically_increasing_id()),
        folder, "classes",
    )
    members = classes.select("cls", "n", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("cls", "n")).alias("lead"))
    members = store.staged(members.join(shared.filter("size > 1"), "bucket"), folder, "members")
    sets = store.staged(_full_sets(texts, classes, members, shingle_words), folder, "sets")

    close = F.least("n", "lead.n") * 100 >= F.greatest("n", "lead.n") * similarity_pct
    stars = members.filter((F.col("cls") != F.col("lead.cls")) & close)
    stars = stars.select(F.col("lead.cls").alias("a"), F.col("cls").alias("b")).distinct()
    links = store.staged(_verified(stars, sets, similarity_pct), folder, "star_links")
    roots = connected_components(links, folder)

    tiles = _open_tiles(members, roots, classes, folder)
    tested = store.staged(
        _by_tile(tiles).mapInArrow(
            _sketch_tester(similarity_pct), "dense boolean, bucket long, kind int, i int, j int, side int, a long, b long"
        ),
        folder, "tested",
    )
    pairs = tested.filter("not dense").select("a", "b").distinct()
    dense = tested.filter("dense").drop("dense", "b").withColumnRenamed("a", "cls")
    dense = dense.join(_root_of(classes.select("cls"), roots), "cls").join(sets, "cls")
    more = _verified(pairs, sets, similarity_pct).unionByName(
        _by_tile(dense).mapInArrow(_set_tester(similarity_pct), "a long, b long")
    )
    roots = connected_components(links.unionByName(more), folder)

    of_class = _root_of(classes.select("set_key", "cls", "first_id"), roots)
    component = of_class.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = of_class.join(component, "root").select("set_key", "component_id")
    whole = F.coalesce("component_id", "id")
    return signed.select("id", "n", "set_key").join(labels, "set_key", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), whole.alias("component_id"),
        F.col("id").eqNullSafe(whole).alias("kept"),
    )


def _root_of(classes: DataFrame, roots: DataFrame) -> DataFrame:
    found = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    return found.withColumn("root", F.coalesce("root", "cls"))


def _full_sets(texts: DataFrame, classes: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(cls, shingles) of every class that shares a bucket; the text of one member is read again."""
    wanted = members.select("cls").distinct().join(classes.select("cls", "set_key", "first_id"), "cls")
    ids = wanted.select("first_id").distinct().hint("shuffle_hash")
    again = texts.join(ids, F.col("id").eqNullSafe(F.col("first_id")), "left_semi").select("text")
    found = again.mapInArrow(_set_reader(k), "set_key binary, shingles array<long>").dropDuplicates(["set_key"])
    return found.join(wanted.select("set_key", "cls"), "set_key").select("cls", "shingles")


def _similar(inter: Column, a: Column, b: Column, pct: int) -> Column:
    return inter * 100 >= (a + b - inter) * pct


def _verified(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    inter = F.size(F.array_intersect("sa", "sb")).cast("long")
    return pairs.join(right, "b").join(left, "a").filter(_similar(inter, F.size("sa"), F.size("sb"), pct)).select("a", "b")


def _open_tiles(members: DataFrame, roots: DataFrame, classes: DataFrame, folder: str) -> DataFrame:
    """Rows of the tiles that must still be compared: pairs of different components within a bucket.

    The largest component of a bucket is compared with the others, whose members are offered to it once, however many
    buckets they share with it: such tiles are named by the component. The others are compared with each other in
    tiles named by the bucket. Buckets with the same members count once.
    """
    named = store.staged(_root_of(members.select("bucket", "cls"), roots), folder, "named")
    by_root = named.groupBy("bucket", "root").agg(
        F.count(F.lit(1)).alias("n_root"), F.bit_xor(F.xxhash64("cls")).alias("h1"),
        F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("h2"),
    )
    buckets = by_root.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n_roots"), F.sum("n_root").alias("size"), F.max(F.struct("n_root", "root")).alias("top"),
        F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"),
    ).filter("n_roots > 1")
    buckets = buckets.groupBy("size", "h1", "h2").agg(F.min(F.struct("bucket", "top", "n_roots")).alias("b")).select(
        "b.bucket", F.col("b.top.root").alias("top"), "b.n_roots", (F.col("size") - F.col("b.top.n_root")).alias("n_rest"),
    )
    at = store.staged(named.join(buckets, "bucket").withColumn("is_top", F.col("root") == F.col("top")), folder, "open")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    block = lambda n: F.pmod(F.xxhash64("cls", "tile"), blocks(n)).cast("int")
    span = lambda n, f: F.explode(F.transform(F.sequence(F.lit(0), blocks(n) - 1), f)).alias("t")
    tile = lambda kind, i, j, side: F.struct(
        F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side")
    )
    named_by = lambda df: df.select(F.col("tile").alias("bucket"), "t.*", "cls", "root")

    met = store.staged(at.select(F.col("top").alias("tile"), "cls", "root", "is_top").distinct(), folder, "met")
    sizes = met.groupBy("tile").agg(F.count_if("is_top").alias("n_top"), F.count_if(~F.col("is_top")).alias("n_others"))
    met = met.join(sizes, "tile")
    inside = met.filter("is_top").select("tile", "cls", "root", span("n_others", lambda j: tile(0, block("n_top"), j, F.lit(0))))
    others = met.filter("NOT is_top").select("tile", "cls", "root", span("n_top", lambda i: tile(0, i, block("n_others"), F.lit(1))))

    rest = at.filter("NOT is_top AND n_roots > 2").select(F.col("bucket").alias("tile"), "cls", "root", "n_rest")
    own = block("n_rest")
    rest = rest.select("tile", "cls", "root", span("n_rest", lambda j: tile(
        1, F.least(j, own), F.greatest(j, own), F.when(j == own, 2).when(j > own, 0).otherwise(1))))
    rows = named_by(inside).unionByName(named_by(others)).unionByName(named_by(rest))
    return rows.join(classes.select("cls", "n", "sketch"), "cls")


_TILE = ["bucket", "kind", "i", "j"]


def _by_tile(rows: DataFrame) -> DataFrame:
    names = [*_TILE, "side", "cls", *[c for c in rows.columns if c not in (*_TILE, "side", "cls")]]
    return rows.repartition(*_TILE).sortWithinPartitions(*_TILE, "side", "cls").select(*names)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows, one table per tile; a tile holds two blocks at most."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)])
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for start, end in zip(cuts, cuts[1:]):
            if held and last != keys[start].tolist():
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = keys[start].tolist()
    if held:
        yield pa.Table.from_batches(held)


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions to compare with each other: side 0 with side 1, or side 2 with itself."""
    return np.flatnonzero(side != 1), np.flatnonzero(side != 0)


def _signer(k: int, bands: int, band_slots: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.pieces(whole, 1):
                found = [shingles.shingle_set(t, k) for t in batch.column(1).to_pylist()]
                full = [i for i, s in enumerate(found) if len(s)]
                signatures = shingles.superminhash([found[i] for i in full], bands * band_slots)
                keys = dict(zip(full, shingles.band_keys(signatures, bands)))
                sketch = dict(zip(full, (signatures & np.uint64(255)).astype(np.uint8)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(s) for s in found], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary()),
                        pa.array([sketch[i].tobytes() if i in sketch else None for i in range(len(found))], pa.binary()),
                        pa.array([keys[i] if i in keys else None for i in range(len(found))], pa.list_(pa.int64())),
                    ],
                    ["id", "n", "set_key", "sketch", "bands"],
                )

    return sign


def _set_reader(k: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.pieces(whole, 0):
                found = [shingles.shingle_set(t, k) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary()),
                        pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64())),
                    ],
                    ["set_key", "shingles"],
                )

    return read


def _sketch_tester(pct: int):
    """Per tile: the pairs whose sketches agree well enough, or the whole tile as dense where those are many."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for t in _groups(batches):
            bucket, kind, i, j = (t.column(c)[0].as_py() for c in range(4))
            side, cls, root, n = (t.column(c).to_numpy() for c in ("side", "cls", "root", "n"))
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(cls), -1)
            left, right = _sides(side)
            ra, rb = [], []
            for p in left:
                q = right[(root[right] != root[p]) & ((side[right] != 2) | (right > p))]
                q = q[np.minimum(n[q], n[p]) * 100 >= np.maximum(n[q], n[p]) * pct]
                q = q[(sketch[q] == sketch[p]).sum(axis=1) * 100 >= 0.75 * pct * sketch.shape[1]]
                ra += [p] * len(q)
                rb += q.tolist()
            if len(ra) > 4 * len(cls):
                out += [(True, bucket, kind, i, j, int(s), int(c), None) for s, c in zip(side, cls)]
            else:
                out += [(False, bucket, kind, i, j, None, int(min(cls[p], cls[q])), int(max(cls[p], cls[q]))) for p, q in zip(ra, rb)]
            if len(out) > 20_000:
                yield _rows(out)
                out = []
        yield _rows(out)

    return test


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["dense", "bucket", "kind", "i", "j", "side", "a", "b"]
    kinds = [pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _set_tester(pct: int):
    """Per dense tile: links on full sets, reduced to those that join components not yet joined there."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            side, cls, root = (t.column(c).to_numpy() for c in ("side", "cls", "root"))
            lists = t.column("shingles").combine_chunks()
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(cls)), sizes)
            _, term = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            order = np.argsort(term, kind="stable")
            posted = owner[order]
            starts = np.searchsorted(term[order], np.arange(term.max() + 2))
            begins = np.concatenate([[0], np.cumsum(sizes)])
            left, right = _sides(side)
            top = {int(r): int(r) for r in np.unique(root)}

            def find(x: int) -> int:
                while top[x] != x:
                    top[x] = top[top[x]]
                    x = top[x]
                return x

            found = []
            for p in left:
                terms = term[begins[p] : begins[p + 1]]
                hits = np.concatenate([posted[starts[x] : starts[x + 1]] for x in terms])
                inter = np.bincount(hits, minlength=len(cls))[right]
                q = right[(100 * inter >= pct * (sizes[p] + sizes[right] - inter)) & (root[right] != root[p])]
                for x in q:
                    a, b = find(int(root[p])), find(int(root[x]))
                    if a != b:
                        top[max(a, b)] = min(a, b)
                        found.append((int(cls[p]), int(cls[x])))
            columns = list(zip(*found)) if found else [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    return test
