"""Best-fit packing planned on the length histogram: no document is looked at while the plan is made.

Texts are tokenized where they lie; of each piece (at most `room` ids of a document and its closing id) only place, length
and checksum go on. The histogram of lengths, at most `room` rows whatever the input, is packed by best fit in descending
order: a group of sequences with the same space left is filled in one step. The plan says which ranks of a length go to
which sequences and at which place; pieces take their slots by joining on (length, rank within length).

Null text counts as empty: a piece of one closing id. Rows repeated whole are packed as often as they occur. An empty table
gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonescope.llm.common import only, settle

ROOM = 2048
CLOSING = 0
CACHE_WORDS = 1_500_000
SEGMENT = 50_000
RANKED = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class _Ids(dict):
    """Ids, as little-endian bytes, of ASCII-lower-cased words; filled by the tokenizer when a word is first met."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        text = word.decode()
        # Plain letters are one unit of the vocabulary's own split, unchanged by its normalization.
        ids = [t.id for t in self.model.tokenize(text)] if LETTERS(word) else \
            self.whole.encode(text, add_special_tokens=False).ids
        own = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        return own


LETTERS = re.compile(rb"[a-z]+").fullmatch
#: The vocabulary's split also cuts between a letter or digit and a full stop or comma, so fewer words are distinct.
CUT = re.compile(rb"(?<=[0-9a-z])(?=[.,])")
_caches: dict[str, _Ids] = {}


def tokenized(docs: DataFrame, vocabulary: str | None = None, room: int = ROOM) -> DataFrame:
    """The pieces of every document.

    The vocabulary lower-cases, drops white space, and merges nothing across its splits; so ids are kept per word in a
    bounded cache that lives as long as the Python worker.
    """
    path = vocabulary or default_vocabulary()
    closing = struct.pack("<I", CLOSING)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _caches.setdefault(path, _Ids(path)).__getitem__
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = CUT.sub(b" ", (text.as_py() or "").encode().lower()).split()
                ids = b"".join([*map(ids_of, words), closing])
                for i, at in enumerate(range(0, len(ids), 4 * room)):
                    own = ids[at:at + 4 * room]
                    rows.append((doc, i, at // 4, len(own) // 4, zlib.crc32(own)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return only(docs, "doc_id", "text").mapInArrow(run, PIECES)


def plan(histogram: dict[int, int], room: int = ROOM) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, how many, first sequence, place): `how many` pieces go to as many sequences in a row.

    Best fit, longest first. `left[r]` lists runs of sequences with r ids of space; a run takes r // length pieces per
    sequence, as each placed piece makes its sequence the best fit for the next one.
    """
    left: dict[int, list[tuple[int, int]]] = {}
    out, fresh = [], 0

    def place(length: int, rank: int, first: int, many: int, space: int, each: int) -> None:
        out.extend((length, rank + i * many, many, first, room - space + i * length) for i in range(each))
        left.setdefault(space - each * length, []).append((first, many))

    for length in sorted(histogram, reverse=True):
        need, rank = histogram[length], 0
        while need:
            space = min((r for r in left if r >= length and left[r]), default=room)
            if left.get(space):
                first, many = left[space].pop()
            else:
                first, many = fresh, -(-need // (room // length))
                fresh += many
            each = space // length
            full = min(many, need // each)
            if full:
                place(length, rank, first, full, space, each)
                rank, need = rank + full * each, need - full * each
            if full < many and need < each and need:
                place(length, rank, first + full, 1, space, need)
                full, need = full + 1, 0
            if full < many:
                left.setdefault(space, []).append((first + full, many - full))
    return out


def ranked(pieces: DataFrame) -> DataFrame:
    """`rank` of every piece within its length, from 0. Lengths are dealt into slices by a hash of the piece, so a
    length that a third of all pieces share is ranked in many tasks."""
    slices = 1 + pieces.count() // RANKED
    rows = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(slices)))
    counts = rows.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n"))
    order = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    return (rows.withColumn("within", F.row_number().over(order) - 1)
            .join(before.drop("n"), ["length", "slice"])
            .withColumn("rank", F.col("before") + F.col("within")).drop("before", "within", "slice"))


def pack(docs: DataFrame, vocabulary: str | None = None, room: int = ROOM) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    spark = docs.sparkSession
    pieces = settle(tokenized(docs, vocabulary, room), "pieces")
    histogram = {r["length"]: r["n"] for r in
                 pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    segments = [(length, rank + i, min(SEGMENT, many - i), first + i, offset)
                for length, rank, many, first, offset in plan(histogram, room) for i in range(0, many, SEGMENT)]
    slots = (spark.createDataFrame(segments or [(0, 0, 0, 0, 0)],
                                   "length long, first long, many long, sequence long, offset long")
             .where("many > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)))
             .select("length", (F.col("first") + F.col("i")).alias("rank"),
                     (F.col("sequence") + F.col("i")).alias("sequence_id"), "offset"))
    return ranked(pieces).join(slots, ["length", "rank"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
