"""Spelling variants: words that differ by one inserted, deleted or replaced code point, found in a trie of letter counts.

The letters are dealt to GROUPS groups of like frequency. A word's vector is its length and its letter count per group (each
with an upper bound; beyond it counts are equal). Words arranged by their successive counts are a trie. Two near words differ
in at most one group by one more and in at most one by one less, so a word searches the trie depth-first with a budget of one
surplus and one deficit. A pair is met once, from the word whose first differing count is the smaller one: the deficit is
spent after the surplus only. Words of a leaf are compared in full.

The first levels of the trie (length and PREFIX groups) deal the words to tasks: a word goes to its own subtree, and asks in each
of at most ten others that exist. Subtrees are told apart by 17 bits, so their sizes fit on the driver; one of more than LEAF words
is cut into copies that are each asked. A task reads its subtrees in order, many small ones or a part of a large one at a time.

A word's form is its near word of largest n (ties: smallest in code-point order), if that n >= 10 * the word's own. The root is
reached by doubling, in rounds that grow with the logarithm of the longest chain.

Null words are left out, repeated words are added up. An empty table gives an empty result. In `word_counts` null and empty
texts hold no words and rows repeated whole count as often as they stand. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonescope.llm.common import only, pick_parts, settle

SHORTEST, LEAST, STRONGER = 7, 2, 10
GROUPS, PREFIX = 12, 3
#: Upper bounds of the length and of a count in a vector.
LONGEST, MOST = 31, 15
#: Words of a subtree in one copy; rows that a task searches together.
LEAF, BLOCK = 200_000, 100_000
#: Words a task counts before it sends their counts.
GATHER = 300_000
#: The most frequent letters have a group by frequency, all others by code.
LETTERS = 64
WIDTH = LONGEST + 1
#: What a search may still spend: a surplus and then a deficit, a deficit, nothing, a surplus.
BOTH, DEFICIT, NOTHING, SURPLUS = range(4)
ROWS = "tree int, copy int, state int, rest long, n long, word string"
PAIRS = "word string, n long, other string, other_n long"
_REST = 4 * (GROUPS - PREFIX)


def word_counts(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST,
                edit: Callable[[int | None, str], str] | None = None) -> DataFrame:
    """(word, n): words of at least `shortest` code points that occur at least `least` times.

    Words are maximal runs of Latin letters (U+00C0 to U+00FF besides A-Z, a-z), A-Z lower-cased. `edit` makes the word that
    counts from a row's doc_id and a word of at least `shortest` code points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = re.compile(f"[a-zÀ-ÿ]{{{shortest},}}")
        total: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                              names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if text.is_valid:
                    own = Counter(letters.findall(text.as_py().encode().lower().decode()))
                    for word, n in own.items():
                        word = edit(doc, word) if edit else word
                        if len(word) >= shortest:
                            total[word] += n
                if len(total) >= GATHER:
                    yield told()
                    total.clear()
        if total:
            yield told()

    counted = only(docs, "doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def letter_groups(words: DataFrame) -> dict[int, int]:
    """A group for each of the most frequent letters; frequent letters first, each to the group with fewest so far."""
    letter = F.explode(F.split("word", "")).alias("letter")
    rows = words.where("word <> ''").select(letter).groupBy("letter").count().orderBy(F.desc("count"), "letter").limit(LETTERS).collect()
    load, groups = [0] * GROUPS, {}
    for row in rows:
        own = min(range(GROUPS), key=lambda g: (load[g], g))
        load[own] += row["count"]
        groups[ord(row["letter"])] = own
    return groups


def vectors(words: list[str], groups: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(tree, rest): the length and the first PREFIX counts as one number, the other counts as another."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    known = np.arange(1 + max(groups, default=0)) % GROUPS
    known[list(groups)] = list(groups.values())
    group = np.where(codes < len(known), known[np.minimum(codes, len(known) - 1)], codes % GROUPS)
    at = np.repeat(np.arange(len(words)), sizes) * GROUPS + group
    counts = np.minimum(np.bincount(at, minlength=len(words) * GROUPS).reshape(-1, GROUPS), MOST)
    tree = np.minimum(sizes, LONGEST)
    for g in range(PREFIX):
        tree = tree * (MOST + 1) + counts[:, g]
    rest = np.zeros(len(words), np.int64)
    for g in range(PREFIX, GROUPS):
        rest = rest * (MOST + 1) + counts[:, g]
    return tree, rest


def visits() -> list[tuple[int, int, int, list[tuple[int, int]]]]:
    """(change of length, change of tree, state, [(level, change)]) of the subtrees in which a word asks."""
    weight = [(MOST + 1) ** (PREFIX - 1 - g) for g in range(PREFIX)]
    longer = (MOST + 1) ** PREFIX
    out = [(0, 0, BOTH, []), (1, longer, SURPLUS, [])]
    for g in range(PREFIX):
        out.append((0, weight[g], DEFICIT, [(g, 1)]))
        out.append((1, longer + weight[g], NOTHING, [(g, 1)]))
        out.extend((0, weight[g] - weight[h], NOTHING, [(g, 1), (h, -1)]) for h in range(g + 1, PREFIX))
    return out


def dealt(words: DataFrame, groups: dict[int, int], copies: dict[int, int]) -> DataFrame:
    """Every word once as a target (state -1) in its subtree and once for each subtree in which it asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = np.zeros((LONGEST + 2) * (MOST + 1) ** PREFIX, np.int64)
        cut[list(copies)] = list(copies.values())
        for batch in batches:
            text = batch.column(0)
            tree, rest = vectors(text.to_pylist(), groups)
            length = tree // (MOST + 1) ** PREFIX
            count = [tree // (MOST + 1) ** (PREFIX - 1 - g) % (MOST + 1) for g in range(PREFIX)]
            # Equal vectors are spread over the copies of their subtree by a hash of the word, the same in every attempt.
            place = np.zeros(len(tree), np.int64)
            for i in np.flatnonzero(cut[tree] > 1):
                place[i] = zlib.crc32(text[int(i)].as_py().encode()) % cut[tree[i]]
            trees, copy, state, row = [tree], [place], [np.full(len(tree), -1)], [np.arange(len(tree))]
            for change, step, spent, levels in visits():
                fits = (length < LONGEST) if change else np.ones(len(tree), bool)
                for level, by in levels:
                    fits = fits & ((count[level] < MOST) if by > 0 else (count[level] > 0))
                at = np.flatnonzero(fits)
                at = at[cut[tree[at] + step] > 0]
                many = cut[tree[at] + step]
                trees.append(np.repeat(tree[at] + step, many))
                copy.append(np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many))
                state.append(np.full(int(many.sum()), spent))
                row.append(np.repeat(at, many))
            of = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c), pa.int32()) for c in (trees, copy, state)]
                + [pa.array(rest).take(of), batch.column(1).take(of), text.take(of)],
                names=["tree", "copy", "state", "rest", "n", "word"])

    return words.mapInArrow(run, ROWS)


def search(root: np.ndarray, rest: np.ndarray, q_root: np.ndarray, q_rest: np.ndarray,
           q_state: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(query, target, whether the pair is met from the other side too) for all leaves within the budget.

    Targets come sorted by (root, rest).
    """
    levels = range(_REST - 4, -4, -4)
    node = np.unique(root, return_inverse=True)[1]
    roots = np.unique(root)
    tries = []
    for shift in levels:
        paths = node * (MOST + 1) + (rest >> shift & MOST)
        keys, node = np.unique(paths, return_inverse=True)
        tries.append(keys)
    leaf_ends = np.searchsorted(node, np.arange(len(tries[-1]) + 1))
    for low in range(0, len(q_root), BLOCK):
        own = slice(low, low + BLOCK)
        at = np.minimum(np.searchsorted(roots, q_root[own]), len(roots) - 1)
        query = np.flatnonzero(roots[at] == q_root[own]) + low
        at, state = at[query - low], q_state[query]
        for shift, keys in zip(levels, tries):
            count = q_rest[query] >> shift & MOST
            more = np.flatnonzero(((state == BOTH) | (state == SURPLUS)) & (count < MOST))
            less = np.flatnonzero((state == DEFICIT) & (count > 0))
            wanted = np.concatenate([at * (MOST + 1) + count, (at * (MOST + 1) + count + 1)[more],
                                     (at * (MOST + 1) + count - 1)[less]])
            state = np.concatenate([state, np.where(state[more] == BOTH, DEFICIT, NOTHING), np.full(len(less), NOTHING)])
            query = np.concatenate([query, query[more], query[less]])
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            there = keys[place] == wanted
            at, state, query = place[there], state[there], query[there]
        size = leaf_ends[at + 1] - leaf_ends[at]
        ends = np.cumsum(size)
        # Pairs of a leaf, a block at a time.
        part = 0
        while part < len(at):
            until = max(part + 1, int(np.searchsorted(ends, (ends[part - 1] if part else 0) + 2 * BLOCK, side="right")))
            some = size[part:until]
            within = np.arange(int(some.sum())) - np.repeat(np.cumsum(some) - some, some)
            yield (np.repeat(query[part:until], some), np.repeat(leaf_ends[at[part:until]], some) + within,
                   np.repeat(state[part:until] == BOTH, some))
            part = until


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, cut at WIDTH, and their whole lengths."""
    codes = np.frombuffer("".join(w[:WIDTH].ljust(WIDTH, "\0") for w in words).encode("utf-32-le"), dtype=np.uint32)
    return codes.reshape(-1, WIDTH), np.fromiter(map(len, words), np.int64, len(words))


def differ_by_one(a: str, b: str) -> bool:
    """By exactly one inserted, deleted or replaced code point."""
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1 or a == b:
        return False
    first = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[first + (len(a) == len(b)):] == b[first + 1:]


def near(a: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """`differ_by_one` for rows of matrices of words shorter than WIDTH; a is not longer than b, or of its length."""
    same = a != b
    first = np.where(same.any(axis=1), same.argmax(axis=1), WIDTH)
    column = np.arange(WIDTH)
    replaced = (a_len == b_len) & (same.sum(axis=1) == 1)
    shifted = np.zeros(len(a), bool)
    at = np.flatnonzero(b_len == a_len + 1)
    behind = (column[None, :-1] >= first[at, None]) & (column[None, :-1] < a_len[at, None])
    shifted[at] = ~((a[at, :-1] != b[at, 1:]) & behind).any(axis=1)
    return replaced | shifted


def pairs(rows: DataFrame, parts: int) -> DataFrame:
    """(word, n, other, other_n) for all near words, both ways."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # targets of the subtree that the last block ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            is_target = batch.column(2).to_numpy() < 0
            targets = batch.filter(pa.array(is_target))
            if kept is not None:
                targets = pa.concat_batches([kept, targets])
            asking = batch.filter(pa.array(~is_target))
            if targets.num_rows and asking.num_rows:
                yield from found(targets, asking)
            open_ = [batch.column(c)[batch.num_rows - 1].as_py() for c in (0, 1)]
            mine = (targets.column(0).to_numpy() == open_[0]) & (targets.column(1).to_numpy() == open_[1])
            kept = targets.filter(pa.array(mine))

    def root_of(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()

    def found(targets: pa.RecordBatch, asking: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        root, rest = root_of(targets), targets.column(3).to_numpy()
        order = np.lexsort((rest, root))
        targets = targets.take(pa.array(order))
        t_words, q_words = targets.column(5).to_pylist(), asking.column(5).to_pylist()
        (b, b_len), (a, a_len) = _matrix(t_words), _matrix(q_words)
        for query, target, twice in search(root[order], rest[order], root_of(asking), asking.column(3).to_numpy(),
                                           asking.column(2).to_numpy()):
            good = near(a[query], a_len[query], b[target], b_len[target])
            for i in np.flatnonzero(np.maximum(a_len[query], b_len[target]) >= WIDTH):
                good[i] = differ_by_one(q_words[query[i]], t_words[target[i]])
            query, target, once = query[good], target[good], ~twice[good]
            ask, answer = (pa.array(x) for x in (np.concatenate([query, query[once]]), np.concatenate([target, target[once]])))
            word = asking.column(5).take(ask), targets.column(5).take(answer)
            n = asking.column(4).take(ask), targets.column(4).take(answer)
            # What is met from one side only is told both ways.
            swap = pa.array(np.arange(len(ask)) >= len(query))
            yield pa.RecordBatch.from_arrays(
                [pc.if_else(swap, word[1], word[0]), pc.if_else(swap, n[1], n[0]), pc.if_else(swap, word[0], word[1]),
                 pc.if_else(swap, n[0], n[1])], names=["word", "n", "other", "other_n"])

    return (rows.repartition(parts, "tree", "copy").sortWithinPartitions("tree", "copy", "state").mapInArrow(run, PAIRS))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of every chain word, form, form's form, ..."""
    known = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = settle(known.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                 F.col("next").isNotNull().alias("moved")), "roots")
        known = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return known


def variants(words: DataFrame, stronger: int = STRONGER) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of (word, n)."""
    words = settle(only(words, "word", "n").where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    groups = letter_groups(words)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(vectors(batch.column(0).to_pylist(), groups)[0], pa.int32())],
                                             names=["tree"])

    # At most 2^17 subtrees.
    sizes = words.mapInArrow(trees, "tree int").groupBy("tree").count().collect()
    copies = {r["tree"]: -(-r["count"] // LEAF) for r in sizes}
    linked = pairs(dealt(words, groups, copies), pick_parts(words.sparkSession))
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best")
    told = settle(words.join(linked.groupBy("word").agg(F.count("*").alias("n_near"), best), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(-F.col("best.minus") >= stronger * F.col("n"), F.struct(
            F.col("best.other").alias("form"), (-F.col("best.minus")).alias("form_n"))).alias("to")).select(
        "word", "n", "n_near", "to.form", "to.form_n"), "told")
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n",
                                                  F.coalesce("root", "word").alias("root"))
