"""Document fingerprints by winnowing: hashes of k pieces, the minimum of each window, rightmost on ties, with positions.

Pieces are the words (runs of anything but ASCII white space), cut where they have no limit: code points of scripts written
without spaces are pieces of their own, and longer words fall into pieces of PIECE code points, counted from the word's
start. A text of n >= 1 pieces has max(1, n - k + 1) grams (a shorter text is one gram) and each window of w grams (all of
them, if fewer) keeps its smallest hash, on ties the rightmost. So two texts that share k + w - 1 pieces in a row share a
fingerprint hash; a text of fewer pieces has one window, so its likeness to another is mostly 0 or 1. The gram's hash and its
place are packed in one long, hash first and place negated, so that the plain minimum of longs is the rightmost smallest hash.

Null text counts as empty; an empty text, or one of white space alone, has no hashes and an empty fingerprint, and two empty
fingerprints have likeness 1. Rows of equal doc_id are ordered by their text. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonescope.llm.common import bounds_search, lookup, only

K, W = 4, 8
#: Scripts without spaces between words: Thai to Tibetan, Myanmar, Khmer, kana, ideographs.
UNSPACED = r"\x{0E00}-\x{0FFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
PIECE = 24
PIECES = rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]{{1,{PIECE}}}"
#: Place of a gram within a text: 28 bits; its hash: 35 bits.
PLACES = 1 << 28
ROWS_PER_RANGE = 4_000
MOST_RANGES = 20_000


def packed(text: Column, k: int = K, w: int = W) -> Column:
    """array<long>: the packed minima of all windows, in text order, each once."""
    words = F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))
    top = lambda ws: F.greatest(F.size(ws) - F.lit(k - 1), F.least(F.size(ws), F.lit(1)))

    def grams(ws: Column) -> Column:
        return F.when(top(ws) > 0, F.transform(F.sequence(F.lit(1), top(ws)), lambda i: (
            F.shiftrightunsigned(F.xxhash64(F.slice(ws, i, F.lit(k))), 29) * F.lit(PLACES) + F.lit(PLACES - 1) - i)))

    def minima(hs: Column) -> Column:
        last = F.greatest(F.size(hs) - F.lit(w - 1), F.lit(1))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda j: F.array_min(F.slice(hs, j, F.lit(w)))))

    # A lambda's argument is evaluated once, so that the words and hashes aren't made anew for each place.
    return F.flatten(F.transform(F.array(words), lambda ws: F.flatten(F.transform(
        F.array(F.coalesce(grams(ws), F.array().cast("array<long>"))),
        lambda hs: F.when(F.size(hs) > 0, minima(hs)).otherwise(F.array().cast("array<long>"))))))


def hashes(prints: Column) -> Column:
    return F.array_distinct(F.transform(prints, lambda p: F.shiftright(p, 28)))


def places(prints: Column) -> Column:
    """Places of the kept grams, from 0."""
    return F.transform(prints, lambda p: F.lit(PLACES - 2) - p.bitwiseAND(F.lit(PLACES - 1)))


def as_text(prints: Column) -> Column:
    """`place:hash` for each kept gram, in text order; the hash in hexadecimal."""
    return F.array_join(F.transform(prints, lambda p: F.concat(
        (F.lit(PLACES - 2) - p.bitwiseAND(F.lit(PLACES - 1))).cast("string"), F.lit(":"),
        F.lower(F.hex(F.shiftright(p, 28))))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes of all hashes (Jaccard) of two packed fingerprints; 1 for two empty ones."""
    def of(pair: Column) -> Column:
        both = F.size(F.array_intersect(pair[0], pair[1]))
        every = F.size(pair[0]) + F.size(pair[1]) - both
        return F.when(every == 0, 1.0).otherwise(both / every)
    return F.element_at(F.transform(F.array(F.array(hashes(a), hashes(b))), of), 1)


def with_next(rows: DataFrame, key: str, carried: list[str]) -> DataFrame:
    """`rows` with next_<c> of the row that follows by `key` (after the last: the first), for each carried column.

    Rows are cut into key ranges by quantiles; each range gets a copy of the first row of the next range, so a row finds
    its follower within its range. No window spans the table. One shuffle of the rows.
    """
    n = rows.count()
    parts = min(MOST_RANGES, n // ROWS_PER_RANGE + 1)
    cuts = rows.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    bounds = sorted(set(cuts)) if parts > 1 else []
    here = bounds_search(bounds, F.col(key)).cast("int")
    full = sorted(r[0] for r in rows.select(here.alias("r")).distinct().collect())
    before = [-1] * (len(bounds) + 1)
    for a, b in zip([full[-1]] + full[:-1] if full else [], full):
        before[b] = a
    lows = {r["r"]: r["low"] for r in rows.groupBy(here.alias("r")).agg(F.min(key).alias("low")).collect()}
    low = lookup([lows.get(i) for i in range(len(bounds) + 1)], F.col("_range"))
    ranged = rows.withColumn("_range", here)
    to = F.when(F.col(key).eqNullSafe(low), F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("copy")),
                F.struct(lookup(before, F.col("_range"), "int").alias("r"), F.lit(1).alias("copy")))
                ).otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("copy"))))
    # Plain columns and one select: the followers of all carried columns come from one exchange and one window.
    dealt = ranged.withColumn("_to", F.explode(to)).withColumns(
        {"_to_range": F.col("_to.r"), "_copy": F.col("_to.copy")}).drop("_range", "_to")
    order = Window.partitionBy("_to_range").orderBy("_copy", key, *carried[:1])
    return (dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried])
            .where("_copy = 0").drop("_to_range", "_copy"))


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, text and prints (packed) of every row."""
    rows = only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.withColumn("prints", packed(F.col("text"), k, w))


def edited(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Per row its fingerprint, that of its edited text (the last half replaced by the start of the next document's
    text) and the likeness of its fingerprint to that and to the next document's."""
    rows = with_next(fingerprints(docs, k, w), "doc_id", ["text", "prints"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(
        F.substring("text", F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.withColumn("edited_prints", packed(F.col("edited"), k, w))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("prints")).alias("fingerprint"), as_text(F.col("edited_prints")).alias("edited_fingerprint"),
        likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"),
        likeness(F.col("prints"), F.col("next_prints")).alias("near_next"))
