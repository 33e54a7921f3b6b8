"""Packing of documents into training windows with their lexical neighbours."""

from __future__ import annotations

import gc
import os
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache, wraps
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyspark.llm import common, lexical_tree
from tallyspark.sources import store

K1, B = lexical_tree.K1, lexical_tree.B
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Words whose ids a worker remembers while texts are tokenized, about 190 MB.
CACHED_WORDS = 1_000_000
#: Text that is tokenized at a time; what a worker needs besides its words grows with it.
PIECE_BYTES = 8_000_000
#: Splits of the lexical order beyond one leaf per shard, sampled documents for each leaf, and the most of them in all.
MORE_SPLITS, DOCS_A_LEAF, MOST_SAMPLED = 2, 32, 1 << 18
ENCODED = "id long, draw long, start long, length long, doc_tokens long, crc long, ids binary"


# How byte-level models write a byte as a character. Printable bytes stand for themselves, the others follow 255.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
BYTE_CHARACTERS = {b: 256 + n for n, b in enumerate(_OTHERS)}
_BESIDE_SPACES = {b: c for b, c in BYTE_CHARACTERS.items() if b != 0x20}
_PROBES = ["a", "the", "été", "zzqx", "internationalization", "straße", "ñandú", "x.", "ß,", "Öl", "ab!!", "zu###", "é'.)", ",", "!!"]
#: Letters below U+0130, ASCII marks, or the first and then the second. Such text is in composed form.
_PLAIN = re.compile(f"([{''.join(filter(str.isalpha, map(chr, range(0x130))))}]*)([!-/:-@\\[-`{{-~]*)")

_LOWER = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")  # the same of small letters below U+0100, the most usual ones


class WordEncoder:
    """The ids that a tokenizer gives for whole texts, put together from those of their words.

    For tokenizers that drop white space and never merge across it. Texts are cut at ASCII white space and before a comma or
    full stop that ends a word, every distinct word goes through the library once, and its ids are kept as bytes. Words of plain
    letters, perhaps with ASCII marks behind, are handed to the library's merge model at once, as its normaliser and splitter
    leave them as they are; all other words take the library's full way. Probes at the start tell whether the short way is right.
    """

    def __init__(self, content: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_buffer(content)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model
        self.merger = Tokenizer(self.model)
        self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary, suffix = self.whole.get_vocab(), getattr(self.model, "end_of_word_suffix", None)
        self.kind = np.dtype("<u2") if len(vocabulary) <= 1 << 16 else np.dtype("<u4")
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.short = True
        probes = [w.encode() for w in _PROBES]
        self.short = self._known(probes) == self._full(probes)
        self.known.clear()  # the short way's ids, right or not

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if self.short:  # special tokens alone depend on case before the normaliser
            texts = [t if b"<|" in t else t.lower() for t in texts]
        if len(self.known) > CACHED_WORDS // 2:  # words that are met again come back from the older half
            self.known, self.older = {}, self.known
        collecting = gc.isenabled()
        gc.disable()  # millions of small objects and no cycles among them
        try:
            words = pc.ascii_split_whitespace(_strings(texts, self.short))
            coded = words.values.dictionary_encode()
            distinct = _listed(coded.dictionary)  # an empty one too, where white space comes first or last
            ids = pa.array(self._known(distinct), pa.large_binary()).take(coded.indices)
            _, offsets, data = ids.buffers()
            ends = np.frombuffer(offsets, np.int64)[words.offsets.to_numpy()].tolist()
            data = memoryview(data or b"")
            return [bytes(data[begin:end]) for begin, end in zip(ends, ends[1:])]
        finally:
            if collecting:
                gc.enable()

    def _known(self, words: list[bytes]) -> list[bytes]:
        """Ids by word; those that are not there yet are found and kept."""
        found = list(map(self.known.get, words))
        if None not in found:
            return found
        missing = [w for w, ids in zip(words, found) if ids is None]
        again = list(map(self.older.get, missing))
        self.known.update((w, ids) for w, ids in zip(missing, again) if ids is not None)
        new = [w for w, ids in zip(missing, again) if ids is None]
        if self.short:
            letters = [w for w in new if w.isalpha() or _LOWER.fullmatch(w)]
            self.known.update(zip(letters, self._merged(letters)))
            new = self._plain([w for w in new if w not in self.known])
        self.known.update(zip(new, self._full(new)))
        return [self.known[w] if ids is None else ids for w, ids in zip(words, found)]

    def _plain(self, words: list[bytes]) -> list[bytes]:
        """Finds the ids of those words for which the short way serves, and returns the others."""
        single, double, others = {}, {}, []
        for word in words:
            if plain := _PLAIN.fullmatch(word.decode("utf-8", "replace").lower()):
                core, marks = (part.encode() for part in plain.groups())
                if core and marks:  # which stand alone behind letters
                    double[word] = core, marks
                else:
                    single[word] = core or marks
            else:
                others.append(word)
        self.known.update(zip(single, self._merged(single.values())))
        parts = list({part for both in double.values() for part in both})
        ids = dict(zip(parts, self._known(parts)))
        self.known.update((word, ids[core] + ids[marks]) for word, (core, marks) in double.items())
        return others

    def _full(self, words: list[bytes]) -> list[bytes]:
        found = self.whole.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def _merged(self, words: Iterable[bytes]) -> list[bytes]:
        """Ids by word as the merge model gives them, many words at a time: the last id of each tells where it ends."""
        words, out = list(words), []
        parts = [b" ".join(words[i : i + 256]).lower().decode("latin-1") for i in range(0, len(words), 256)]
        parts = [p if p.isascii() else p.translate(_BESIDE_SPACES) for p in parts]
        for part, found in zip(parts, self.merger.encode_batch_fast(parts, add_special_tokens=False)):
            ids, characters = np.array(found.ids, self.kind), part.split(" ")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(characters) and ends[-1] == len(ids):
                coded, ends = ids.tobytes(), (ends * self.kind.itemsize).tolist()
                out += [coded[begin:end] for begin, end in zip([0, *ends], ends)]
            else:
                out += [np.array([t.id for t in self.model.tokenize(c)], self.kind).tobytes() for c in characters]
        return out


def _strings(texts: list[bytes], marks_apart: bool) -> pa.Array:
    """The texts, with a space before each comma and full stop that has a letter before it and white space behind, if wanted."""
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    if marks_apart:
        at = np.flatnonzero((data[1:-1] == ord(",")) | (data[1:-1] == ord("."))) + 1
        before, behind = data[at - 1], data[at + 1]
        letter = (before >= ord("a")) & (before <= ord("z"))
        letter |= (data[at - 2] == 0xC3) & (at > 1) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)  # À to ÿ without × and ÷
        at = at[letter & ((behind == ord(" ")) | (behind >= 9) & (behind <= 13))]
        data, offsets = np.insert(data, at, ord(" ")), offsets + np.searchsorted(at, offsets)
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _listed(words: pa.Array) -> list[bytes]:
    """The words themselves, which hold no spaces."""
    if not len(words):
        return []
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[1 : len(words)]
    return np.insert(np.frombuffer(data or b"", np.uint8), ends, ord(" ")).tobytes().split(b" ")


@lru_cache(maxsize=1)
def _encoder(content: bytes) -> WordEncoder:
    """Kept by the worker, so that later tasks find the words of earlier ones, until a step of `_after_tokenizing` begins."""
    return WordEncoder(content)


def _after_tokenizing(step):
    """A step that runs when all texts are tokenized: the worker gives its words back first, and at the end what the step has freed."""

    @wraps(step)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _encoder.cache_clear()
        common.release_memory()
        try:
            yield from step(batches)
        finally:
            common.release_memory()

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 4096,
    shard_docs: int = 2048,
    query_terms: int | None = None,
    seed: int = 17,
) -> DataFrame:
    """Pieces of documents in sequences of at most `window` tokens: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    A document is its token ids and `end_id`. Whole windows of a long document are sequences of their own; what remains,
    under a window, goes to a shard of `shard_docs` documents. Shards are cut by exact rank from an order in which documents
    that share terms stand near each other (a tree over BM25 vectors, learned from a bounded sample). A shard has an
    inverted index over token ids; document frequencies, their number and mean length are those of all remainders. A window
    begins with a seed document, then takes the unused documents of its shard with the highest BM25 score for all distinct terms of
    the seed (or its `query_terms` rarest shared ones), and cuts the one that no longer fits; its rest begins the next window.
    The last window of a shard is cut into powers of two, which need no padding. Every id lies in exactly one piece.

    NULL and empty texts are the end id alone. Repeated rows are packed each; ids may repeat. Other columns are
    ignored; an empty table gives no rows. One task holds the token ids of one shard at a time, each document under a window.
    """
    spark, folder = docs.sparkSession, common.scratch(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).cast("binary").alias("text"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("draw"),
    )
    encoded = rows.mapInArrow(_splitter(spark, tokenizer_path, end_id, window), ENCODED)
    encoded = store.staged(encoded.withColumn("row", F.monotonically_increasing_id()), folder, "encoded")
    kind, terms = _kind(tokenizer_path)
    terms = max(terms, end_id + 1)
    statistics = collection_statistics(encoded, kind, terms)
    placed = store.staged(_placed(encoded, kind, statistics, shard_docs), folder, "placed")
    place = ["leaf", "draw", "start", "row"]
    ranked = common.running_totals(placed.select(*place), folder, [F.col(c) for c in place], {"rank": F.lit(1)})
    bounds = ranked.filter(F.col("rank") % shard_docs == 0).select(*place).collect()  # one row per shard
    bounds = spark.sparkContext.broadcast(sorted(map(tuple, bounds)))
    sharded = placed.mapInArrow(_sharder(bounds), f"{ENCODED}, shard long")
    dealt = sharded.repartition("shard").sortWithinPartitions("shard", "draw", "id", "start")
    packed = dealt.mapInArrow(_packer(kind, window, query_terms, spark.sparkContext.broadcast(statistics)), PIECE)
    return packed.withColumnRenamed("doc_id", id_col)


class Statistics(NamedTuple):
    """Of all documents in the index: their number, mean length, and how many have each term of the vocabulary."""

    docs: int
    mean_length: float
    frequency: np.ndarray

    def idf(self) -> np.ndarray:
        found = np.log1p((self.docs - self.frequency + 0.5) / (self.frequency + 0.5))
        return np.where(self.frequency > 0, found, 0.0)


def collection_statistics(encoded: DataFrame, kind: str, terms: int) -> Statistics:
    """One row per term of the vocabulary comes to the driver."""

    @_after_tokenizing
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = np.zeros(terms, np.int64)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                frequency[np.frombuffer(ids, kind)] += 1  # an id that repeats in one index counts once
        term = np.flatnonzero(frequency)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(frequency[term])], ["term", "docs"])

    rest = encoded.filter("ids is not null")
    docs, length = rest.agg(F.count(F.lit(1)), F.sum("length")).first()
    found = rest.select("ids").mapInArrow(count, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).toArrow()
    frequency = np.zeros(terms, np.int64)
    frequency[found.column("term").to_numpy()] = found.column("docs").to_numpy()
    return Statistics(docs, (length or 0) / max(1, docs), frequency)


def _placed(encoded: DataFrame, kind: str, statistics: Statistics, shard_docs: int) -> DataFrame:
    """Adds `leaf`, the place in lexical order; whole windows, which need no neighbours, come first."""
    whole = F.col("ids").isNull()
    shards = -(-statistics.docs // shard_docs)
    if shards < 2:
        return encoded.withColumn("leaf", F.when(whole, -1).otherwise(0).cast("long"))
    depth = min((shards - 1).bit_length() + MORE_SPLITS, (MOST_SAMPLED // DOCS_A_LEAF).bit_length() - 1)

    def sample(wanted: int) -> DataFrame:  # equal rows count once, so that their number does not matter
        share = int(min(1.0, wanted / statistics.docs) * (1 << 30))
        drawn = encoded.filter(~whole & (F.pmod(F.xxhash64("draw", F.lit(3)), F.lit(1 << 30)) < share))
        return drawn.select("draw", "start", "ids").dropDuplicates(["draw", "start"])

    @_after_tokenizing
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = space.value.points([np.frombuffer(b, kind) for b in batch.column(2).to_pylist()])
            columns = [batch.column(0), batch.column(1), pa.array([p.tobytes() for p in points], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["draw", "start", "point"])

    @_after_tokenizing
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            leaf = np.full(len(ids), -1, np.int64)
            rest = [i for i, b in enumerate(ids) if b is not None]
            leaf[rest] = tree.value.leaves(space.value.points([np.frombuffer(ids[i], kind) for i in rest]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    context = encoded.sparkSession.sparkContext
    known = sorted(map(tuple, sample(lexical_tree.BASIS_DOCS).collect()))
    space = lexical_tree.TermSpace([np.frombuffer(ids, kind) for *_, ids in known], statistics.idf(), statistics.mean_length)
    space = context.broadcast(space)
    points = sample(DOCS_A_LEAF << depth).mapInArrow(project, "draw long, start long, point binary").toArrow()
    points = sorted(zip(*(c.to_pylist() for c in points.columns)))
    points = np.frombuffer(b"".join(p for *_, p in points), np.float32).reshape(-1, lexical_tree.DIMS)
    tree = context.broadcast(lexical_tree.LexicalTree(points, depth))
    return encoded.mapInArrow(place, f"{ENCODED}, row long, leaf long")


def _sharder(bounds):
    @_after_tokenizing
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = zip(*(batch.column(c).to_pylist() for c in ("leaf", "draw", "start", "row")))
            names = batch.schema.names[:-2]
            shards = pa.array([bisect_left(bounds.value, p) for p in places], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], shards], [*names, "shard"])

    return cut


def _kind(path: str) -> tuple[str, int]:
    """How ids are stored, and how many there are."""
    with open(path, "rb") as f:
        encoder = WordEncoder(f.read())
    return encoder.kind.str, encoder.whole.get_vocab_size()


def _splitter(spark: SparkSession, path: str, end_id: int, window: int):
    with open(path, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())

    def coded(encoder: WordEncoder, batch: pa.RecordBatch) -> pa.RecordBatch:
        end, width = np.array([end_id], encoder.kind).tobytes(), encoder.kind.itemsize
        out: list[tuple] = []
        ids, draws = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for i, draw, own in zip(ids, draws, encoder.encode(batch.column(1).to_pylist())):
            own += end
            total = len(own) // width
            full = total - total % window
            out += [
                (i, draw, s, window, total, _crc(own[s * width : (s + window) * width], encoder.kind), None)
                for s in range(0, full, window)
            ]
            if full < total:
                out.append((i, draw, full, total - full, total, None, own[full * width :]))
        kinds = [pa.int64()] * 6 + [pa.binary()]
        names = ["id", "draw", "start", "length", "doc_tokens", "crc", "ids"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content.value)
        try:
            for whole in batches:
                for batch in common.pieces(whole, 1, PIECE_BYTES):
                    yield coded(encoder, batch)
        finally:
            common.release_memory()

    return split


def _crc(coded: bytes, kind: np.dtype) -> int:
    return zlib.crc32(np.frombuffer(coded, kind).astype("<u4").tobytes())


def _packer(kind: str, window: int, query_terms: int | None, statistics):
    @_after_tokenizing
    def pack_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, held in _by_shard(batches):
            out = list(_shard_pieces(shard, held, np.dtype(kind), window, query_terms, statistics.value))
            names = [c.split()[0] for c in PIECE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    return pack_shards


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    held, last = [], None
    for batch in batches:
        for *row, shard in zip(*(c.to_pylist() for c in batch.columns)):
            if held and shard != last:
                yield last, held
                held = []
            held.append(row)
            last = shard
    if held:
        yield last, held


def _shard_pieces(
    shard: int, rows: list[tuple], kind: np.dtype, window: int, query_terms: int | None, statistics: Statistics
) -> Iterator[tuple]:
    sequence = shard << 32
    for i, _, start, length, total, crc, ids in rows:
        if ids is None:
            yield i, start, length, crc, total, sequence, 0
            sequence += 1
    rest = [(i, start, total, np.frombuffer(ids, kind)) for i, _, start, _, total, _, ids in rows if ids is not None]
    index = Bm25([ids for *_, ids in rest], query_terms, statistics)
    room, cut = window, 0
    filled: list[tuple[int, int, int]] = []
    for at in index.reading_order(lambda: room == window):
        begin, end = 0, len(rest[at][3])
        while begin < end:
            take = min(end - begin, room)
            filled.append((at, begin, begin + take))
            begin, room = begin + take, room - take
            if not room:
                yield from _sequence(filled, rest, sequence)
                sequence, room, filled = sequence + 1, window, []
                if begin < end:
                    index.seed = at
    left = window - room
    while left:  # the largest power of two first
        size = 1 << (left.bit_length() - 1)
        part: list[tuple[int, int, int]] = []
        cut = size
        while cut:
            at, begin, end = filled.pop(0)
            take = min(cut, end - begin)
            part.append((at, begin, begin + take))
            if begin + take < end:
                filled.insert(0, (at, begin + take, end))
            cut -= take
        yield from _sequence(part, rest, sequence)
        sequence, left = sequence + 1, left - size


def _sequence(filled: list[tuple[int, int, int]], rest: list[tuple], sequence: int) -> Iterator[tuple]:
    offset = 0
    for at, begin, end in filled:
        i, start, total, ids = rest[at]
        crc = zlib.crc32(ids[begin:end].astype("<u4").tobytes())
        yield i, start + begin, end - begin, crc, total, sequence, offset
        offset += end - begin


def _changes(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]]))


class Bm25:
    """Inverted index over the token ids of one shard's documents; hands out every document once.

    Frequencies and mean length are those of `statistics`, or of these documents alone.
    """

    def __init__(self, docs: list[np.ndarray], query_terms: int | None = None, statistics: Statistics | None = None) -> None:
        self.query_terms, self.seed, n = query_terms, None, len(docs)
        lengths = np.array([len(d) for d in docs], np.float64)
        most = max((int(d.max(initial=0)) for d in docs), default=0)
        kind = np.int32 if (most + 1) * n < 1 << 31 else np.int64
        pairs = np.concatenate(docs).astype(kind) if n else np.empty(0, kind)
        pairs *= kind(n)
        pairs += np.repeat(np.arange(n, dtype=kind), lengths.astype(np.int64))
        pairs.sort()
        first = _changes(pairs)
        count = np.diff(first, append=len(pairs))
        term, self.doc = pairs[first] // max(1, n), (pairs[first] % max(1, n)).astype(np.int64)
        self.starts = _changes(term)
        frequency = np.diff(self.starts, append=len(term))
        self.ends = self.starts + frequency
        if statistics is None:
            statistics = Statistics(n, lengths.mean() if n else 0.0, np.bincount(term, minlength=1))
        known = statistics.frequency[term[self.starts]]
        self.idf = np.log1p((statistics.docs - known + 0.5) / (known + 0.5))
        scale = K1 * (1 - B + B * lengths / max(1.0, statistics.mean_length))
        self.weight = np.repeat(self.idf, frequency) * count * (K1 + 1) / (count + scale[self.doc])
        by_doc = np.argsort(self.doc.astype(np.uint16) if n <= 1 << 16 else self.doc, kind="stable")
        self.forward = np.repeat(np.arange(len(self.starts)), frequency)[by_doc]
        self.begin = np.searchsorted(self.doc[by_doc], np.arange(n + 1))
        self.shared = frequency > 1  # the others match no other document here
        self.unused, self.held = np.ones(n, bool), np.arange(n)
        # Terms that most documents have are rows of a table, which adds faster than postings.
        common_terms = np.flatnonzero(frequency * 2 > n)
        self.row = np.full(len(frequency), -1)
        self.row[common_terms] = np.arange(len(common_terms))
        self.table = np.zeros((len(common_terms), n))
        for r, t in enumerate(common_terms):
            self.table[r, self.doc[self.starts[t] : self.ends[t]]] = self.weight[self.starts[t] : self.ends[t]]
        self._list_postings()

    def _list_postings(self) -> None:
        spans = list(zip(self.starts.tolist(), self.ends.tolist()))
        self.docs_of, self.weights_of = [self.doc[a:b] for a, b in spans], [self.weight[a:b] for a, b in spans]

    def _forget_used(self) -> None:
        """Used documents leave the postings and the table; `held` has the numbers of those that stay."""
        stays = self.unused[self.held]
        kept = stays[self.doc]
        before = np.concatenate([[0], np.cumsum(kept)])
        self.starts, self.ends = before[self.starts], before[self.ends]
        self.doc, self.weight = (np.cumsum(stays) - 1)[self.doc[kept]], self.weight[kept]
        self.table, self.held = np.ascontiguousarray(self.table[:, stays]), self.held[stays]
        self._list_postings()

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused documents by falling score for the seed's terms, ties in seeded order."""
        return np.concatenate([np.empty(0, np.int64), *self.nearest(seed)])

    def nearest(self, seed: int) -> Iterator[np.ndarray]:
        """The neighbours of now, a few at first and ever more, as a window seldom needs them all."""
        if 2 * np.count_nonzero(self.unused) < len(self.held):
            self._forget_used()
        own = self.forward[self.begin[seed] : self.begin[seed + 1]]
        own = own[self.shared[own]]
        if self.query_terms is not None and len(own) > self.query_terms:
            own = own[np.argsort(-self.idf[own], kind="stable")[: self.query_terms]]
        rows = self.row[own]
        scores = np.zeros(len(self.held))
        for row in rows[rows >= 0].tolist():
            scores += self.table[row]
        if listed := own[rows < 0].tolist():
            docs, weights = (np.concatenate([of[t] for t in listed]) for of in (self.docs_of, self.weights_of))
            scores += np.bincount(docs, weights, len(self.held))
        free = self.unused[self.held]
        free, behind = self.held[free], -scores[free]
        wanted = 32
        while len(free) > 2 * wanted:
            near = behind <= np.partition(behind, wanted)[wanted]  # equal ones come together
            yield free[near][np.argsort(behind[near], kind="stable")]
            free, behind, wanted = free[~near], behind[~near], 2 * wanted
        yield free[np.argsort(behind, kind="stable")]

    def reading_order(self, window_is_empty) -> Iterator[int]:
        """Documents in the order in which they fill windows; a new window asks for a new seed.

        The seed is the document whose rest begins the window (set by the caller), or else the next unused one.
        """
        next_seed = 0
        while True:
            seed, self.seed = self.seed, None
            if seed is None:
                while next_seed < len(self.unused) and not self.unused[next_seed]:
                    next_seed += 1
                if next_seed == len(self.unused):
                    return
                seed = next_seed
                self.unused[seed] = False
                yield seed
                if window_is_empty():
                    continue
            for at in chain.from_iterable(self.nearest(seed)):
                self.unused[at] = False
                yield int(at)
                if self.seed is not None or window_is_empty():
                    break
            else:
                if self.seed is None:
                    return
