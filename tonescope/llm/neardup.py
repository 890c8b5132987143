"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

A document's set holds its distinct 2-word shingles (words: runs of anything but ASCII white space, A-Z lower-cased). One hash
per shingle is enough: its leading bits choose one of ROWS * BANDS bins, the smallest hash of a bin is its value. An empty bin
borrows from the first full bin in a random order of its own, the same for all documents. BANDS groups of ROWS bins are
the document's buckets. In a bucket each document is compared with the smallest doc_id only (a star), so a bucket of n
gives n - 1 candidates. Candidates are confirmed on their full sets, as word pairs. What its star leaves in different
components is open: open documents are indexed by the rarest of their shingles, one of which any two similar sets share, and
pairs that meet there, share a bucket, are not ruled out by sizes and parity bits and were not compared before are confirmed, the CENTRES
smallest doc_ids for each larger one in the first round, eight times as many in each further one, as long as pairs of
different components are left. So no similar pair of a bucket is missed, and documents that share only a template meet nowhere.

Documents with equal sets are one class, represented by its smallest doc_id, and only representatives are compared. At
similarity 0.8 a pair shares no bucket with probability below 1e-6.

Null, empty and white-space texts have empty sets and are linked with nothing; a text of one word has that word as its
set. Rows repeated whole get equal results; rows without doc_id are linked with nothing and not kept. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonescope.llm.common import only, settle
from tonescope.llm.graphs import components

ROWS, BANDS = 6, 48
SIMILAR = 80
CACHE_WORDS = 300_000
#: Parity bits of a set, in longs.
PARITY = 8
#: Pairs that are compared for one document in the first round after the star; eight times as many in each further one.
CENTRES = 8
SIGNATURES = "doc_id long, n_shingles long, one long, two long, bands array<long>, parity array<long>"


class _Hashes(dict):
    """64-bit hash of a word, kept in a bounded cache."""

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) > CACHE_WORDS:
            self.clear()
        own = self[word] = xxhash.xxh3_64_intdigest(word)
        return own


def _mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x += b
        x *= np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
        return x


def shingle_hashes(words: list[bytes], hashes: _Hashes, n: int = 2) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of the whole sequence, if it is shorter."""
    own = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(n, len(own))
    if not n:
        return own
    named = _mix(own[:len(own) - n + 1], np.uint64(n))
    for i in range(1, n):
        named = _mix(named, own[i:len(own) - n + 1 + i])
    return np.unique(named)


class OnePermutation:
    """Signatures of `rows * bands` bins."""

    def __init__(self, rows: int, bands: int) -> None:
        self.rows, self.bands, self.bins = rows, bands, rows * bands
        order = np.random.default_rng(rows * 1000 + bands)
        #: turn[i, j]: when the empty bin i asks bin j.
        self.turn = np.argsort(order.random((self.bins, self.bins)), axis=1).astype(np.int32)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        bins = ((shingles >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        full = bins[first]
        out = np.zeros(self.bins, dtype=np.uint64)
        out[full] = shingles[first]
        empty = np.ones(self.bins, dtype=bool)
        empty[full] = False
        empty = np.flatnonzero(empty)
        if len(empty):
            out[empty] = out[full[np.argmin(self.turn[np.ix_(empty, full)], axis=1)]]
        return out

    def buckets(self, signature: np.ndarray) -> np.ndarray:
        table = signature.reshape(self.bands, self.rows)
        name = np.arange(self.bands, dtype=np.uint64)
        for i in range(self.rows):
            name = _mix(name, table[:, i])
        return name


def parity(shingles: np.ndarray) -> np.ndarray:
    """For each value of the last bits of a hash whether an odd number of shingles has it, as PARITY longs."""
    bins = PARITY * 64
    odd = np.bincount((shingles & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, shingle: int = 2, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, one and two (128-bit name of the set, null if empty), bands (bucket names) and parity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        hashes, oph = _Hashes(), OnePermutation(rows, bands)
        for batch in batches:
            sizes, one, two, named, odd = [], [], [], [], []
            for text in batch.column(1):
                own = shingle_hashes((text.as_py() or "").encode().lower().split(), hashes, shingle)
                sizes.append(len(own))
                odd.append(parity(own))
                if not len(own):
                    one.append(None)
                    two.append(None)
                    named.append(np.empty(0, np.int64))
                    continue
                whole = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), dtype=np.int64)
                one.append(int(whole[0]))
                two.append(int(whole[1]))
                named.append(oph.buckets(oph.signature(own)).view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(n) for n in named])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*named, np.empty(0, np.int64)])))
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(odd) + 1, dtype=np.int32) * PARITY),
                                            pa.array(np.concatenate([*odd, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                 lists, bits], names=["doc_id", "n_shingles", "one", "two", "bands", "parity"])

    return only(docs, "doc_id", "text").mapInArrow(run, SIGNATURES)


def _set(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    n = min(n, len(words))
    return set(zip(*(words[i:] for i in range(n)))) if n else set()


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, similar: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, as integers: 100 * common >= similar * all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, centre = None, set()
        for batch in batches:
            keep = []
            for a, one, two in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:  # rows come sorted by their centre
                    last, centre = a, _set((one.as_py() or "").encode().lower().split(), shingle)
                other = _set((two.as_py() or "").encode().lower().split(), shingle)
                both = len(centre & other)
                keep.append(100 * both >= similar * (len(centre) + len(other) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 1)], names=["a", "b"])

    of_b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    of_a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    return pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def shingles(texts: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, hash) for every distinct shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            ids, found, size = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found.append(shingle_hashes((text.as_py() or "").encode().lower().split(), hashes, shingle))
                ids.append(np.full(len(found[-1]), doc, np.int64))
                size += len(found[-1])
                if size > 500_000:
                    yield told(ids, found)
                    ids, found, size = [], [], 0
            yield told(ids, found)

    def told(ids: list[np.ndarray], found: list[np.ndarray]) -> pa.RecordBatch:
        none = np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([none, *ids])), pa.array(np.concatenate([none, *(f.view(np.int64) for f in found)]))],
            names=["doc_id", "hash"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, hash long")


def uncompared(open_: DataFrame, texts: DataFrame, tested: DataFrame, shingle: int, similar: int) -> DataFrame:
    """Pairs (a, b), a < b, of documents in different components that are not tested and can be similar.

    `open_` has doc_id, component, n_shingles and parity. Two similar sets share one of the rarest shingles of each: of a set
    of n, all but one less than the least common number may be missing in the other, so the n - least + 1 rarest hold a common
    one, whatever order of rarity all sets use. Shingles of one document alone take up places of it and are not joined. Families
    that share a template and differ by more than a fifth meet in no rare shingle, so they give no pairs.

    Two sets hold nothing in common before the first shingle in which they meet, so what follows it in the shorter rest must
    make up the whole overlap that similar sets need. A meeting that leaves too little is no pair: similar sets that differ in
    few rare shingles meet early, and the further shingles they share, like the pairs of a template, make no rows.
    """
    rows = settle(shingles(texts.join(open_.select("doc_id"), "doc_id"), shingle), "shingles")
    spread = rows.groupBy("hash").agg(F.count("*").alias("spread")).where("spread > 1")
    shared = rows.join(spread, "hash")
    rare = Window.partitionBy("doc_id").orderBy("spread", "hash")
    placed = shared.withColumns({"nth": F.row_number().over(rare), "held": F.count("*").over(Window.partitionBy("doc_id"))})
    least = F.ceil(F.col("n_shingles") * similar / 100)
    # Shingles from the post on, itself included.
    rest = F.col("held") - F.col("nth") + 1
    first = placed.join(open_, "doc_id").withColumn("rest", rest).where(F.col("rest") >= least)
    posts = settle(first.select("hash", "doc_id", "component", "n_shingles", "parity", "rest"), "posts")
    # Only shingles of several components; in each the component of its smallest document needs no pair of its own.
    met = posts.groupBy("hash").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    posts = posts.join(met.select("hash"), "hash", "left_semi")
    one = posts.select("hash", F.col("doc_id").alias("x"), F.col("component").alias("of_x"), F.col("n_shingles").alias("n_x"),
                       F.col("parity").alias("bits_x"), F.col("rest").alias("rest_x"))
    two = posts.select(F.col("hash").alias("other"), F.col("doc_id").alias("y"), F.col("component").alias("of_y"),
                       F.col("n_shingles").alias("n_y"), F.col("parity").alias("bits_y"), F.col("rest").alias("rest_y"))
    # 100 * common >= similar * all, as bounds of the sizes and of the shingles in one set only.
    sizes = 100 * F.least("n_x", "n_y") >= similar * F.greatest("n_x", "n_y")
    single = sum(F.bit_count(F.get("bits_x", F.lit(i)).bitwiseXOR(F.get("bits_y", F.lit(i)))) for i in range(PARITY))
    near = single * (100 + similar) <= (F.col("n_x") + F.col("n_y")) * (100 - similar)
    enough = F.least("rest_x", "rest_y") * (100 + similar) >= similar * (F.col("n_x") + F.col("n_y"))
    found = one.join(two, (F.col("hash") == F.col("other")) & (F.col("of_x") != F.col("of_y"))
                     & (F.col("x") < F.col("y")) & sizes & enough & near)
    return found.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")


def sharing(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that share a bucket: these are the candidates, whatever else the index finds."""
    of = lambda c: sets.select(F.col("doc_id").alias(c), F.col("bands").alias(f"bands_{c}")).dropDuplicates([c])
    return pairs.join(of("a"), "a").join(of("b"), "b").where(F.arrays_overlap("bands_a", "bands_b")).select("a", "b")


def apart(pairs: DataFrame, reached: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    of = lambda c: reached.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(
        F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 2, similar: int = SIMILAR, rows: int = ROWS,
                    bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept (doc_id = component_id)."""
    sets = settle(signatures(docs, shingle, rows, bands), "sets")
    named = sets.where("n_shingles > 0")
    n = named.count()
    classes = settle(named.groupBy("one", "two").agg(F.min("doc_id").alias("rep")), "classes", n)
    members = named.select("doc_id", "one", "two").join(classes, ["one", "two"]).select("doc_id", "rep").distinct()
    alone = named.join(classes, ["one", "two"]).where("doc_id = rep").select("doc_id", F.explode("bands").alias("bucket"))
    shared = alone.groupBy("bucket").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("last")).where(
        "centre < last").drop("last")
    buckets = settle(alone.join(shared, "bucket").distinct(), "buckets", n * bands)
    held = buckets.count()
    pairs = settle(buckets.where("doc_id <> centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b"))
                   .distinct(), "pairs", held)
    involved = buckets.select("doc_id").distinct()
    texts = settle(only(docs, "doc_id", "text").join(involved, "doc_id").dropDuplicates(["doc_id"]), "texts")
    links = settle(confirmed(pairs, texts, shingle, similar), "links", 20 * held)
    reached = components(links)
    # Members of a bucket that its star has left in different components.
    held_by = buckets.select("bucket", "doc_id").join(reached.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "bucket", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = held_by.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    open_ = held_by.join(mixed, "bucket", "left_semi").select("doc_id", "component").distinct()
    marks = sets.select("doc_id", "n_shingles", "parity").dropDuplicates(["doc_id"])
    open_ = settle(open_.join(marks, "doc_id"), "open", held)
    found = settle(uncompared(open_, texts, pairs, shingle, similar), "found")
    members_of = sets.join(open_.select("doc_id"), "doc_id", "left_semi")
    waiting, most = settle(sharing(found, members_of), "waiting"), CENTRES
    while not waiting.isEmpty():
        nth = F.row_number().over(Window.partitionBy("b").orderBy("a"))
        turns = waiting.withColumn("nth", nth)
        more = settle(confirmed(turns.where(F.col("nth") <= most).drop("nth"), texts, shingle, similar), "more")
        if not more.isEmpty():
            links = links.unionByName(more)
            reached = components(links)
        waiting = settle(apart(turns.where(F.col("nth") > most).drop("nth"), reached), "waiting")
        most *= 8
    reached = members.join(reached.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", F.coalesce("component", "rep").alias("component_id"))
    return (sets.select("doc_id", "n_shingles").join(reached, "doc_id", "left")
            .withColumn("component_id", F.coalesce("component_id", "doc_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))
