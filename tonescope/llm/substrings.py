"""Suffix-array dedup by distributed prefix doubling on sampled positions: bytes covered by a repeated string are removed.

A byte goes if a string of `least` bytes that covers it also starts earlier (smaller doc_id, or the same document, earlier
start). Positions get names that stand for the rank of the string that begins there; names of 2h bytes come from the pair of
names of h bytes at offset h, doubled from 1 to 32 bytes within the document. A dense suffix array would sort one row per
byte and round. Instead:

1. Sampling. Every string of `least` bytes elects the 32 bytes with the smallest name in it (leftmost on ties), so equal
   strings elect the same place in themselves. Only elected places, about one in 35 bytes, go on, each with the span of the
   strings that elect it.
2. First sort, by (name of 32 bytes, name of the whole span). A place whose first name is unique in the corpus is
   done: no string that elects it repeats. One whose whole span stands earlier is done too: every string in the
   span repeats. Others are still open.
3. Second sort, of the open ones, past the threshold: by the name of each string of `least` bytes in an open span. All but
   the first of equal strings repeat. Equal strings have the same first name, so open spans are dealt out by it and
   sorted in runs of whole names; a name with more than HOT open spans is settled by an aggregate over its strings instead.
The first sort is a range partition on the full key including document and place, so a string that a third of all
documents share is spread over many tasks. What a task can't know of its neighbours at the edges of its range counts as
open, which the second sort settles. Names have 64 bits; strings are compared by 128 bits. Texts that must meet their
marks are shuffled in compressed form.

Null text counts as empty. doc_id is taken as the key of a document; rows repeated whole get equal results and don't count
as each other's earlier copy; rows without doc_id stay whole and aren't anyone's earlier copy. Texts under `least` bytes stay whole. An empty table gives an empty result. Other columns of
the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonescope.llm.common import only, pick_parts, settle

LEAST = 100
NAMED = 32
#: Bytes of text handled at a time; strings longer than PART are handled in overlapping parts.
AT_ONCE = 1 << 17
PART = 1 << 20
PLACE_BITS = 24
#: More than the strings that can elect one place.
SPANS = 128
#: Spans with one name that are sorted within a task; rows that a task takes up at a time.
HOT = 4_000
AT_LEAST = 2_000
U = np.uint64
#: A fixed random value for each byte value, and one for "outside the document".
_SEEDS = np.random.default_rng(20240229).integers(0, 2**63, 257, dtype=np.uint64) * U(2) + U(1)
_ONE, _TWO, _THREE = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)


def _pair(a: np.ndarray, b: np.ndarray, factor: np.uint64 = _ONE) -> np.ndarray:
    """Name of the pair (a, b)."""
    with np.errstate(over="ignore"):
        x = a * factor
        x ^= x >> U(32)
        x += b
        x *= _TWO
        x ^= x >> U(29)
        return x


def _names(symbols: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """Names of the NAMED bytes from each place, by doubling."""
    names = _SEEDS[symbols]
    names[outside] = _SEEDS[256]
    h = 1
    while h < NAMED:
        names = _pair(names[:-h], names[h:])
        h *= 2
    return names


def _elected(names: np.ndarray, least: int) -> np.ndarray:
    """For each place the place elected by the string of `least` bytes from there."""
    reach = least - NAMED + 1
    assert len(names) < 1 << PLACE_BITS, "the layout is longer than places can be told apart"
    low = (names >> U(PLACE_BITS) << U(PLACE_BITS)) | np.arange(len(names), dtype=np.uint64)
    h = 1
    while 2 * h <= reach:
        low = np.minimum(low[:-h], low[h:])
        h *= 2
    low = np.minimum(low[:len(low) - (reach - h)], low[reach - h:]) if reach > h else low
    return (low & U((1 << PLACE_BITS) - 1)).astype(np.int64)


class _Parts:
    """Texts laid out in one array with gaps, so that numpy works on many short texts at once."""

    def __init__(self, least: int) -> None:
        self.least = least
        self.gap = least + 2 * NAMED
        self.reset()

    def reset(self) -> None:
        self.pieces: list[bytes] = []
        self.rows: list[tuple[int, int, int, int]] = []  # row, shift to places in the document, first and last start
        self.size = self.gap

    def cut(self, text: bytes) -> Iterator[tuple[int, int, int, bytes]]:
        """Begin, first and last start, and the bytes of each part of a text."""
        last = len(text) - self.least
        for low in range(0, last + 1, PART):
            begin = max(0, low - self.gap) if len(text) > PART else 0
            piece = text[begin:low + PART + 2 * self.gap] if len(text) > PART else text
            yield begin, low, min(low + PART - 1, last), piece

    def add(self, row: int, begin: int, first: int, last: int, piece: bytes) -> None:
        self.rows.append((row, begin - self.size, first, last))
        self.pieces.append(piece)
        self.size += len(piece) + self.gap

    def layout(self) -> tuple[np.ndarray, np.ndarray]:
        gap = b"\0" * self.gap
        symbols = np.frombuffer(gap + b"".join(x for p in self.pieces for x in (p, gap)), dtype=np.uint8)
        outside = np.ones(len(symbols), dtype=bool)
        at = self.gap
        for p in self.pieces:
            outside[at:at + len(p)] = False
            at += len(p) + self.gap
        return symbols, outside


def _string_names(names: np.ndarray, at: np.ndarray, least: int, factor: np.uint64 = _ONE) -> np.ndarray:
    """Names of the strings of `least` bytes from `at`."""
    out = names[at]
    for s in [*range(NAMED, least - NAMED, NAMED), least - NAMED]:
        out = _pair(out, names[at + s], factor)
    return out


def _batches(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[pa.RecordBatch, _Parts]]:
    parts = _Parts(least)
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        for i, text in enumerate(texts):
            # By part, not by text: a layout of a very long text would outgrow the places.
            for part in parts.cut(text.as_py() or b""):
                parts.add(i, *part)
                if parts.size > AT_ONCE:
                    yield batch, parts
                    parts.reset()
        if parts.rows:
            yield batch, parts
            parts.reset()


def sampled_positions(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Elected places of all texts: name (32 bytes), whole (name of the span), doc_id and span: start of the first string
    that elects the place, times SPANS, plus the number of further ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, parts in _batches(batches, least):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            names = _names(*parts.layout())
            elected = _elected(names, least)
            place, low, high, owner, shift = [], [], [], [], []
            for row, back, first, last in parts.rows:
                own = elected[first - back:last - back + 1]
                start = np.flatnonzero(np.diff(own, prepend=-1))
                place.append(own[start])
                low.append(first - back + start)
                high.append(first - back + np.append(start[1:], len(own)) - 1)
                owner.append(np.full(len(start), row))
                shift.append(np.full(len(start), back))
            place, low, high = np.concatenate(place), np.concatenate(low), np.concatenate(high)
            whole = _pair(_string_names(names, low, least), _string_names(names, high, least))
            whole = _pair(whole, ((high - low) * SPANS + place - low).astype(np.uint64), _THREE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[place].view(np.int64)), pa.array(whole.view(np.int64)),
                 pa.array(ids[np.concatenate(owner)]), pa.array((low + np.concatenate(shift)) * SPANS + high - low)],
                names=["name", "whole", "doc_id", "span"])

    return only(docs, "doc_id", "text").where(
        (F.octet_length("text") >= least) & F.col("doc_id").isNotNull()).mapInArrow(
        run, "name long, whole long, doc_id long, span long")


def judged_positions(positions: DataFrame, parts: int) -> DataFrame:
    """First sort. doc_id, span and, for the open ones, name (null: the whole span stands earlier); unique names are
    dropped."""
    keys = ["name", "whole", "doc_id", "span"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Neighbours decide, so each batch is judged with the row before it and the row after it.
        prior, held = None, None
        for batch in chain(batches, (None,)):
            after = None if batch is None else [batch.column(i).to_numpy() for i in range(4)]
            if held is not None:
                name, whole, doc, span = (np.concatenate([a[-1:] if a is not None else b[:0], b,
                                                             c[:1] if c is not None else b[:0]])
                                             for a, b, c in zip(prior or [None] * 4, held, after or [None] * 4))
                same_name = name[1:] == name[:-1]
                same = same_name & (whole[1:] == whole[:-1])
                twice = same & (doc[1:] == doc[:-1]) & (span[1:] == span[:-1])
                low = 1 if prior else 0
                own = slice(low, low + len(held[0]))
                left_name = np.concatenate([[True], same_name])[own]  # beyond the range: perhaps
                right_name = np.concatenate([same_name, [True]])[own]
                repeat, again = np.concatenate([[False], same])[own], np.concatenate([[False], twice])[own]
                keep = (left_name | right_name) & ~again
                yield pa.RecordBatch.from_arrays(
                    [pa.array(held[2][keep]), pa.array(held[3][keep]), pa.array(held[0][keep], mask=repeat[keep])],
                    names=["doc_id", "span", "name"])
            if after is not None and not len(after[0]):
                continue
            prior, held = held, after

    return (positions.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
            .mapInArrow(run, "doc_id long, span long, name long"))


def zipped(docs: DataFrame) -> DataFrame:
    """doc_id and the compressed bytes of the text, as less is shuffled that way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = [pack(t.as_py()) if t.is_valid else None for t in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "zipped"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, zipped binary")


def open_spans(docs: DataFrame, judged: DataFrame, least: int = LEAST) -> DataFrame:
    """name, doc_id, start and the bytes of every open span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, packed in enumerate(batch.column(1)):
                text, marks = unpack(packed.as_py()), batch.column(2)[i].values.flatten()
                starts, more = np.divmod(marks[0].to_numpy(), SPANS)
                own = [text[a:b] for a, b in zip(starts.tolist(), (starts + more + least).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [marks[1], pa.array([ids[i]] * len(own), pa.int64()), pa.array(starts), pa.array(own, pa.binary())],
                    names=["name", "doc_id", "start", "own"])

    per = judged.where("name is not null").groupBy("doc_id").agg(F.collect_list(F.struct("span", "name")).alias("marks"))
    return zipped(docs).join(per, "doc_id").mapInArrow(run, "name long, doc_id long, start long, own binary")


def _strings(table: pa.Table | pa.RecordBatch, least: int) -> tuple[np.ndarray, ...]:
    """one, two (names), doc_id, start of every string of `least` bytes in the spans."""
    parts = _Parts(least)
    for row, own in enumerate(table.column("own")):
        for part in parts.cut(own.as_py()):
            parts.add(row, *part)
    names = _names(*parts.layout())
    at = np.concatenate([np.arange(a - b, z - b + 1) for _, b, a, z in parts.rows])
    count = np.array([z - a + 1 for _, _, a, z in parts.rows])
    shift = np.array([b for _, b, _, _ in parts.rows])
    start = table.column("start").to_numpy()
    return (_string_names(names, at, least), _string_names(names, at, least, _THREE),
            np.repeat(table.column("doc_id").to_numpy(), count), at + np.repeat(shift + start, count))


def _runs(doc: np.ndarray, start: np.ndarray, least: int) -> pa.RecordBatch:
    """doc_id, start, stop of the runs of strings, sorted by document and start, with less than `least` between starts."""
    first = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(start) > least)])[:len(doc)])
    last = np.append(first[1:], len(doc))[:len(first)] - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(start[first]), pa.array(start[last] + least)],
                                      names=["doc_id", "start", "stop"])


def repeated_strings(spans: DataFrame, parts: int, least: int = LEAST) -> DataFrame:
    """Second sort. doc_id, start, stop of runs of strings in the spans that also start earlier."""

    def judge(table: pa.Table) -> pa.RecordBatch:
        one, two, doc, start = _strings(table, least)
        order = np.lexsort((start, doc, two, one))
        one, two, doc, start = one[order], two[order], doc[order], start[order]
        again = np.concatenate([[False], (one[1:] == one[:-1]) & (two[1:] == two[:-1])
                                & ((doc[1:] != doc[:-1]) | (start[1:] != start[:-1]))])
        # A string that occurs at one place in two parts of a text is one string; what follows it is still a repeat.
        head = np.maximum.accumulate(np.where(np.concatenate(
            [[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]), np.arange(len(one)), 0))
        again |= (doc != doc[head]) | (start != start[head])
        doc, start = doc[again], start[again]
        order = np.lexsort((start, doc))
        return _runs(doc[order], start[order], least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < AT_LEAST:
                continue
            table = pa.Table.from_batches(held)
            name = table.column("name").to_numpy()
            whole = int(np.searchsorted(name, name[-1]))  # the last name may go on in the next batch
            if whole:
                yield judge(table.slice(0, whole).combine_chunks())
                held = table.slice(whole).combine_chunks().to_batches()
        if held:
            yield judge(pa.Table.from_batches(held).combine_chunks())

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two, doc, start = _strings(batch, least)
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                                              pa.array(doc), pa.array(start)], names=["one", "two", "doc_id", "start"])

    hot = settle(spans.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("name"), "hot")
    few = (spans.join(hot, "name", "left_anti").repartition(parts, "name").sortWithinPartitions("name")
           .mapInArrow(run, "doc_id long, start long, stop long"))
    if hot.isEmpty():
        return few
    strings = spans.join(hot, "name", "left_semi").mapInArrow(explode, "one long, two long, doc_id long, start long")
    here = F.struct("doc_id", "start")
    first = (strings.groupBy("one", "two").agg(F.min(here).alias("first"), F.max(here).alias("last"))
             .where("first < last").drop("last"))
    many = (strings.join(first, ["one", "two"]).where(here > F.col("first"))
            .select("doc_id", "start", (F.col("start") + least).alias("stop")))
    return few.unionByName(many)


def repeated_ranges(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, start, stop: byte ranges, of `least` bytes or more, in which every string of `least` bytes starts earlier."""
    parts = pick_parts(docs.sparkSession)
    judged = settle(judged_positions(sampled_positions(docs, least), parts), "judged")
    spans = settle(open_spans(docs, judged, least), "spans")
    start = F.floor(F.col("span") / SPANS)
    whole = judged.where("name is null").select(
        "doc_id", start.alias("start"), (start + F.pmod("span", F.lit(SPANS)) + least).alias("stop"))
    return whole.unionByName(repeated_strings(spans, parts, least))


def _cut(text: bytes, starts: np.ndarray, stops: np.ndarray, characters: bool = False) -> tuple[int, int, list[bytes]]:
    """Removed bytes, removed runs, kept pieces. With `characters`, one of which only a part is covered stays."""
    if not len(starts):
        return 0, 0, [text]
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(np.minimum(stops[order], len(text)))
    fresh = np.flatnonzero(np.concatenate([[True], starts[1:] > stops[:-1]]))
    begin, end = starts[fresh].tolist(), stops[np.concatenate([fresh[1:] - 1, [len(stops) - 1]])].tolist()
    if characters:
        inner = range(0x80, 0xC0)
        for i in range(len(begin)):
            while begin[i] < len(text) and text[begin[i]] in inner:
                begin[i] += 1
            while end[i] < len(text) and text[end[i]] in inner:
                end[i] -= 1
    pieces = [text[a:b] for a, b in zip([0, *end], [*begin, len(text)])]
    return sum(end) - sum(begin), len(begin), pieces


def removed(docs: DataFrame, least: int = LEAST, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; if asked for also `kept`, the remaining text, and
    then only whole characters go."""
    marks = repeated_ranges(docs, least).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        unpack, none = zstandard.ZstdDecompressor().decompress, np.empty(0, np.int64)
        for batch in batches:
            n_bytes, gone, spans, sums, kept = [], [], [], [], []
            for packed, own in zip(batch.column(1), batch.column(2)):
                text = unpack(packed.as_py()) if packed.is_valid else b""
                own = own.values.flatten() if own.is_valid else [none, none]
                n, m, left = _cut(text, *(np.asarray(x) for x in own), characters=with_text)
                left = b"".join(left)
                n_bytes.append(len(text))
                gone.append(n)
                spans.append(m)
                sums.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()),
                 pa.array(sums, pa.string()), pa.array(kept, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = zipped(docs).join(marks, "doc_id", "left").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    return out if with_text else out.drop("kept")
