"""Line dedup: two Bloom filters tell lines seen once from lines seen twice; only suspected repeats are shuffled.

A text is split at line feeds. A line's key is the line without ASCII white space at its ends, A-Z lower-cased; keys of at
least `shortest` code points count. A key that stands in at least `least` documents loses all its lines but those of the
largest doc_id that holds it. Other lines stay, joined by line feeds.

The filters are saturating: a position is "once" after one document's key has hit it and "twice" after the second, so a key of
two documents has all its positions at "twice" and none is missed. They are cut by the key's hash into segments of 1 MB, as
many as the keys need. Tasks send only the positions that they hit, with counts up to two, and a segment is merged from
them in a stream. Up to BROADCAST segments go to all tasks; beyond that the hashes go to their segment, and a segment with
many rows (a key of very many documents) is copied to several tasks. Both ways ask the same filters and give the same rows.
What is suspected is then counted by 128-bit digests, document by document.

A null or empty text is one empty line. Rows repeated whole, or with the same doc_id, are one document for the count and each
lose their own lines. Rows without doc_id count for nothing and lose nothing. An empty table gives an empty result. Other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonescope.llm.common import only, pick_parts, settle

SHORTEST, LEAST = 40, 5
#: Keys and bits of a segment; a key sets PROBES bits.
SEGMENT_KEYS, SEGMENT_BITS, PROBES = 1 << 20, 1 << 23, 3
#: Segments of 1 MB that are sent to all tasks; beyond it the hashes are sent to their segment.
BROADCAST = 32
#: Hashes that a task gathers before it sends their positions.
GATHER = 1 << 18
SALTS = 16


def key_of(line: bytes, shortest: int) -> bytes | None:
    key = line.strip().lower()  # of bytes: ASCII white space and A-Z only
    if len(key) < shortest or (len(key) < 4 * shortest and len(key.decode()) < shortest):
        return None
    return key


def marks(docs: DataFrame, shortest: int) -> DataFrame:
    """(doc_id, one, two): the 128-bit digest of every distinct key of a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            ids, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if doc is None or not text.is_valid:
                    continue
                own = {digest(k) for k in (key_of(line, shortest) for line in text.as_py().encode().split(b"\n"))
                       if k is not None}
                found.extend(own)
                ids.extend([doc] * len(own))
            both = np.frombuffer(b"".join(found), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])],
                                             names=["doc_id", "one", "two"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, one long, two long")


def places(one: np.ndarray, two: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The segment of each digest and its PROBES positions within."""
    a, b = one.view(np.uint64), two.view(np.uint64)
    segment = ((a >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
    mask, shift = np.uint64(SEGMENT_BITS - 1), np.uint64(SEGMENT_BITS.bit_length() - 1)
    probes = np.stack([(b >> shift * np.uint64(i)) & mask for i in range(PROBES - 1)] + [a & mask], axis=1)
    return segment, probes.astype(np.int64)


def filters(hashes: DataFrame, segments: int) -> DataFrame:
    """(segment, bits): the filter of positions that were hit twice."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def hits() -> pa.RecordBatch:
            segment, probes = places(*(np.concatenate(c) for c in zip(*held)), segments)
            at, n = np.unique(segment[:, None] * SEGMENT_BITS + probes, return_counts=True)
            names, first = np.unique(at // SEGMENT_BITS, return_index=True)
            within, ends = (at % SEGMENT_BITS).astype(np.int32), [*first[1:], len(at)]
            cut = [(within[a:b], n[a:b] > 1) for a, b in zip(first, ends)]
            return pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array([w[~t].tobytes() for w, t in cut], pa.binary()),
                 pa.array([w[t].tobytes() for w, t in cut], pa.binary())], names=["segment", "once", "twice"])

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                rows += batch.num_rows
            if rows >= GATHER:
                yield hits()
                held, rows = [], 0
        if rows:
            yield hits()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, level = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int64()),
                                               pa.array([np.packbits(level > 1).tobytes()], pa.binary())],
                                              names=["segment", "bits"])

        for batch in batches:
            for i, segment in enumerate(batch.column(0).to_pylist()):
                if segment != last:
                    if last is not None:
                        yield done()
                    last, level = segment, np.zeros(SEGMENT_BITS, np.uint8)
                once, twice = (np.frombuffer(batch.column(c)[i].as_py(), dtype=np.int32) for c in (1, 2))
                level[once] = np.minimum(level[once] + 1, 2)
                level[twice] = 2
        if last is not None:
            yield done()

    pieces = hashes.select("one", "two").mapInArrow(sent, "segment long, once binary, twice binary")
    # A segment's pieces are 12 MB at most; a task gets few segments.
    parts = min(segments, max(pick_parts(hashes.sparkSession), segments // 8))
    return (pieces.repartition(parts, "segment").sortWithinPartitions("segment")
            .mapInArrow(merged, "segment long, bits binary"))


def _asked(bits: np.ndarray, probes: np.ndarray) -> np.ndarray:
    return ((bits[probes >> 3] >> (7 - (probes & 7)).astype(np.uint8)) & 1).all(axis=1)


def suspected(hashes: DataFrame, twice: DataFrame, segments: int, most: int) -> DataFrame:
    """The rows (doc_id, one, two) whose digest the filters hold for seen twice."""
    if segments > most:
        return _suspected_by_segment(hashes, twice, segments)
    held = hashes.sparkSession.sparkContext.broadcast({r["segment"]: bytes(r["bits"]) for r in twice.collect()})

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = bytes(SEGMENT_BITS // 8)
        bits = np.concatenate([np.frombuffer(held.value.get(s, blank), dtype=np.uint8) for s in range(segments)])
        for batch in batches:
            if batch.num_rows:
                segment, probes = places(batch.column(1).to_numpy(), batch.column(2).to_numpy(), segments)
                yield batch.filter(pa.array(_asked(bits, segment[:, None] * SEGMENT_BITS + probes)))

    return hashes.mapInArrow(ask, hashes.schema)


def _suspected_by_segment(hashes: DataFrame, twice: DataFrame, segments: int) -> DataFrame:
    high = F.shiftrightunsigned("one", 32) * F.lit(segments)
    rows = hashes.withColumn("segment", F.shiftrightunsigned(high, 32))
    counts = rows.groupBy("segment").count()
    # At most one segment in four can be listed, two numbers each.
    crowded = F.broadcast(counts.where(F.col("count") > 4 * SEGMENT_KEYS).select(
        "segment", F.ceil(F.col("count") / (4 * SEGMENT_KEYS)).alias("copies")))
    copies = F.coalesce("copies", F.lit(1))
    asked = rows.join(crowded, "segment", "left").select(
        "segment", F.pmod(F.xxhash64("doc_id", "two"), copies).alias("copy"), F.lit(1).alias("kind"), "doc_id", "one",
        "two", F.lit(None).cast("binary").alias("bits"))
    none = F.lit(None).cast("long")
    ready = twice.join(crowded, "segment", "left").select(
        "segment", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy"), F.lit(0).alias("kind"),
        none.alias("doc_id"), none.alias("one"), none.alias("two"), "bits")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bits = None, None
        for batch in batches:
            segment, copy, kind = (batch.column(i).to_numpy() for i in range(3))
            starts = np.flatnonzero(np.concatenate([[True], kind[1:] == 0])) if len(kind) else []
            for a, b in zip(starts, [*starts[1:], len(kind)]):
                if kind[a] == 0:
                    last = (segment[a], copy[a])
                    bits = np.frombuffer(batch.column(6)[int(a)].as_py(), dtype=np.uint8)
                    a += 1
                own = batch.slice(a, b - a).select(["doc_id", "one", "two"])
                if own.num_rows:
                    assert (segment[a], copy[a]) == last
                    probes = places(own.column(1).to_numpy(), own.column(2).to_numpy(), segments)[1]
                    yield own.filter(pa.array(_asked(bits, probes)))

    return (ready.unionByName(asked).repartition(pick_parts(hashes.sparkSession), "segment", "copy")
            .sortWithinPartitions("segment", "copy", "kind").mapInArrow(ask, "doc_id long, one long, two long"))


def repeated(hashes: DataFrame, least: int) -> DataFrame:
    """(doc_id, dropped): for every document the digests of the keys that it loses."""
    rows = hashes.distinct()
    counted = rows.groupBy("one", "two").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).where(
        F.col("n") >= least)
    # A key of very many documents is met by them in SALTS places.
    wide = counted.select("one", "two", "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return (salted.join(wide, ["one", "two", "salt"]).where("doc_id < last").groupBy("doc_id")
            .agg(F.collect_list(F.struct("one", "two")).alias("dropped")))


def without_repeated_lines(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST,
                           broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept (the remaining lines, joined)."""
    hashes = settle(marks(docs, shortest), "marks")
    segments = 1 + hashes.count() // SEGMENT_KEYS
    twice = settle(filters(hashes, segments), "filters")
    lost = settle(repeated(settle(suspected(hashes, twice, segments, broadcast), "suspects"), least), "lost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, dropped in zip(batch.column(1).to_pylist(), batch.column(2)):
                text, gone = text or "", 0
                n_lines.append(text.count("\n") + 1)
                if dropped.is_valid:
                    own = {np.array([d["one"], d["two"]], np.int64).tobytes() for d in dropped.as_py()}
                    left = []
                    for line in text.encode().split(b"\n"):
                        key = key_of(line, shortest)
                        if key is None or xxhash.xxh3_128_digest(key) not in own:
                            left.append(line)
                    gone = n_lines[-1] - len(left)
                    text = b"\n".join(left).decode()
                n_dropped.append(gone)
                kept.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                 pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])

    return only(docs, "doc_id", "text").join(lost.hint("merge"), "doc_id", "left").select("doc_id", "text", "dropped").mapInArrow(
        run, "doc_id long, n_lines long, n_dropped long, kept string")
