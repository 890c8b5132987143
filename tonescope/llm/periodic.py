"""Periodic runs of words: sampled suffixes, longest common extensions, and a harmonic grid over all periods.

Words are runs of anything but ASCII white space. A run is a stretch with smallest period q (words q apart are identical) and a
length of at least max(shortest, 2 * q) that no neighbouring word extends. A run of period q holds both ends of a grid step
(i, i + q), i a multiple of q, so all runs are found from the n/1 + n/2 + n/3 + ... grid steps whose two words are equal: the
common extensions of a step forwards and backwards are the run.

Extensions compare a few words first, which ends nearly all of them. For the rest the suffixes at the places of a
difference cover (COVER modulo MODULUS: any two places reach sampled ones within MODULUS words, at the same offset) are
sorted by prefix doubling over blocks of MODULUS words; the common prefixes of neighbours in that order go into a sparse
table, and an extension is a few compared words plus one range minimum. Texts are handled many at a time, with marks between
them that equal nothing. A text is one task's work; its steps are made in blocks, so memory is a few numbers a word.

A word is dropped from `collapsed` if any run contains it after that run's first q words; what stays is joined by one space.
A null, empty or white-space text has no words, no runs and an empty `collapsed`. Rows repeated whole, and rows without
doc_id, are treated row by row. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tonescope.llm.common import only

SHORTEST = 12
#: Any difference modulo 13 is that of two members.
MODULUS, COVER = 13, (0, 1, 3, 9)
FEW = 6
#: Words of the texts handled together, and grid steps of a block.
TOGETHER, STEPS = 200_000, 2_000_000


def matching(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray | int, step: int = 1) -> np.ndarray:
    """How many words are equal from the places a and b on (backwards if step is -1), `most` compared."""
    most = np.broadcast_to(most, a.shape)
    n, open_ = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
    done = 0
    while len(open_):
        equal = words[a[open_] + step * done] == words[b[open_] + step * done]
        open_ = open_[equal]
        done += 1
        n[open_] = done
        open_ = open_[most[open_] > done]
    return n


def _offsets() -> np.ndarray:
    """For two places modulo MODULUS the words to the next offset at which both are sampled."""
    ahead = np.array([[(r + d) % MODULUS in COVER for d in range(MODULUS)] for r in range(MODULUS)])
    return np.argmax(ahead[:, None, :] & ahead[None, :, :], axis=2)


class Extensions:
    """Longest common extensions (forwards) of places of a word array whose texts stand between unique marks."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.offsets = words, _offsets()
        n = len(words)
        at = np.flatnonzero(np.isin(np.arange(n) % MODULUS, COVER))
        #: number of a sampled place among the sampled ones
        nth = np.full(n + 1, -1, np.int64)
        nth[at] = np.arange(len(at))
        # What follows the last mark decides nothing, as that mark is unique.
        padded = np.concatenate([words, np.zeros(MODULUS, words.dtype)])
        columns = [padded[at + i] for i in range(MODULUS)]
        order = np.lexsort(columns[::-1])
        new = np.zeros(len(at), bool)
        for column in columns:
            new[1:] |= column[order][1:] != column[order][:-1]
        name = np.empty(len(at), np.int64)
        name[order] = np.cumsum(new)
        levels, span = [], MODULUS
        while name.max(initial=-1) + 1 < len(at):
            levels.append((span, name))
            onward = np.minimum(at + span, n)
            second = np.where(nth[onward] >= 0, name[nth[onward]], -1) + 1
            name = np.unique(name * (len(at) + 1) + second, return_inverse=True)[1]
            span *= 2
        self.nth, self.rank = nth, name
        in_order = np.empty(len(at), np.int64)
        in_order[name] = at
        a, b = in_order[:-1], in_order[1:]
        common = np.zeros(len(a), np.int64)
        for span, name in reversed(levels):
            common += span * (name[nth[a + common]] == name[nth[b + common]])
        common += matching(words, a + common, b + common, MODULUS)
        self.least = [common.astype(np.int32)]
        while 2 << (len(self.least) - 1) <= len(common):
            half, last = 1 << (len(self.least) - 1), self.least[-1]
            self.least.append(np.minimum(last[:-half], last[half:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        offset = self.offsets[a % MODULUS, b % MODULUS]
        n = matching(self.words, a, b, offset)
        reached = np.flatnonzero(n == offset)
        x, y = (self.rank[self.nth[p[reached] + offset[reached]]] for p in (a, b))
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            own, rows = level == k, self.least[k]
            n[reached[own]] += np.minimum(rows[low[own]], rows[high[own] - (1 << int(k))])
        return n


def grid_steps(starts: np.ndarray, lengths: np.ndarray, shortest: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, i, q) for all grid steps (i, i + q) of all texts, i a place, in blocks of about STEPS."""
    half = np.where(lengths >= shortest, lengths // 2, 0)
    text = np.repeat(np.arange(len(lengths)), half)
    q = np.arange(len(text)) - np.repeat(np.cumsum(half) - half, half) + 1
    steps = (lengths[text] - 1) // q
    total = np.cumsum(steps)
    low = 0
    while low < len(text):
        before = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, before + STEPS, side="right")))
        n = steps[low:high]
        row = np.repeat(np.arange(low, high), n)
        turn = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        yield text[row], starts[text[row]] + turn * q[row], q[row]
        low = high


def runs_of(texts: list[np.ndarray], shortest: int) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of the runs of word-number arrays, by text, start and period."""
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths + 1) - lengths
    words = np.full(int(lengths.sum()) + len(texts) + 1, 0, np.int64)
    words[np.concatenate([[0], starts + lengths])] = -1 - np.arange(len(texts) + 1)  # the marks
    for start, own in zip(starts, texts):
        words[start:start + len(own)] = own
    found = [[], [], [], [], []]
    for text, i, q in grid_steps(starts, lengths, shortest):
        equal = words[i] == words[i + q]
        text, i, q = text[equal], i[equal], q[equal]
        forth = matching(words, i, i + q, FEW)
        back = matching(words, i - 1, i + q - 1, FEW, -1)
        keep = (forth == FEW) | (back == FEW) | (forth + back >= np.maximum(shortest - q, q))
        for out, got in zip(found, (text, i, q, forth, back)):
            out.append(got[keep])
    text, i, q, forth, back = (np.concatenate(f) if f else np.empty(0, np.int64) for f in found)
    open_ = np.flatnonzero((forth == FEW) | (back == FEW))
    if len(open_):
        # The sampled suffixes of the texts that need them, forwards and mirrored.
        own = np.unique(text[open_])
        size = lengths[own] + 1
        ends = np.cumsum(size)
        moved = np.zeros(len(texts), np.int64)
        moved[own] = ends - size + 1 - starts[own]
        part = np.concatenate([[-1 - len(texts) - 1], *(words[starts[t]:starts[t] + lengths[t] + 1] for t in own)])
        a = i[open_] + moved[text[open_]]
        b = a + q[open_]
        forth[open_] = Extensions(part).of(a, b)
        back[open_] = Extensions(part[::-1].copy()).of(len(part) - a, len(part) - b)
    start, length = i - back - starts[text], q + forth + back
    good = length >= np.maximum(shortest, 2 * q)
    text, start, length, q = text[good], start[good], length[good], q[good]
    # A stretch has one smallest period; its multiples and other grid steps give the same stretch.
    order = np.lexsort((q, length, start, text))
    text, start, length, q = text[order], start[order], length[order], q[order]
    first = np.ones(len(text), bool)
    first[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    text, start, length, q = text[first], start[first], length[first], q[first]
    order = np.lexsort((q, start, text))
    return text[order], start[order], length[order], q[order]


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST,
                  edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length and period, by start and period) and collapsed.

    `edit`, where given, makes the words to be searched from a row's doc_id and words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, size = [], [], 0
            last = batch.num_rows - 1
            for nth, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                words = text.as_py().encode().split() if text.is_valid else []
                held.append(edit(doc, words) if edit else words)
                ids.append(doc)
                size += len(held[-1])
                if size >= TOGETHER or nth == last:
                    yield handled(ids, held)
                    ids, held, size = [], [], 0

    def handled(ids: list[int | None], texts: list[list[bytes]]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        text, start, length, period = runs_of(
            [np.fromiter((numbers.setdefault(w, len(numbers)) for w in t), np.int64, len(t)) for t in texts], shortest)
        ends = np.searchsorted(text, np.arange(len(texts) + 1))
        collapsed = []
        for nth, words in enumerate(texts):
            own = slice(ends[nth], ends[nth + 1])
            if ends[nth] < ends[nth + 1]:
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, start[own] + period[own], 1)
                np.add.at(cover, start[own] + length[own], -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(cover)[:-1] == 0)]
            collapsed.append(b" ".join(words).decode())
        runs = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)],
                                          names=["start", "length", "period"])
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs), pa.array(collapsed, pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"])

    return only(docs, "doc_id", "text").mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
