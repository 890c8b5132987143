"""Repeated lines, periodic runs and spelling variants: against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tonescope.llm import lines, periodic, spelling
from tonescope.llm.queries import QUERIES, letter_lost, tail_repeated

WHITE = " \t\n\v\f\r"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def lines_left(rows, shortest, least):
    spread = defaultdict(set)
    for doc, text in rows:
        if doc is not None:
            for line in (text or "").split("\n"):
                spread[lower(line.strip(WHITE))].add(doc)
    out = []
    for doc, text in rows:
        own = (text or "").split("\n")
        keys = [lower(line.strip(WHITE)) for line in own]
        kept = [line for line, k in zip(own, keys) if doc is None or len(k) < shortest or len(spread[k]) < least
                or max(spread[k]) == doc]
        out.append((doc, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def lined(spark):
    """Lines in four, five and many documents, in other case and space, ties, repeated rows, nulls."""
    draw = random.Random(4)
    often = "The line that a third of all documents hold, É and others"
    rows = []
    for i in range(60):
        own = [f"line number {draw.randrange(10 ** 9)} of its own and long enough to count" for _ in range(3)]
        own += [often.upper().replace("É", "É") if i % 2 else "  " + often + "\t"] if i % 3 == 0 else []
        own += ["exactly five documents hold this line here!"] * 2 if i < 5 else []
        own += ["only four documents hold this other line, so it stays"] if i < 4 else []
        own += ["short line"] * 2
        own += ["é" * 40 if i < 10 else "é" * 39]
        draw.shuffle(own)
        rows.append((i, "\n".join(own)))
    rows += [(57, rows[57][1]), (None, often), (None, None), (100, None), (101, ""), (102, "\n\n"), (103, often * 4000),
             (104, "\r\n".join([often] * 3))]
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, dropped int, one int").repartition(3)


@pytest.mark.parametrize("table", ["lined", "nasty", "small"])
@pytest.mark.parametrize("sharded", [False, True])
def test_lines_match_brute_force(request, monkeypatch, table, sharded):
    docs = request.getfixturevalue(table)
    if sharded:  # many segments, some of them crowded, none sent to all tasks
        monkeypatch.setattr(lines, "SEGMENT_KEYS", 8)
    got = lines.without_repeated_lines(docs, broadcast=0 if sharded else lines.BROADCAST).collect()
    assert sorted([tuple(r) for r in got], key=str) == lines_left(rows_of(docs), 40, 5)


def test_filters_hold_every_repeated_line_and_few_others(spark):
    rows = [(i, "\n".join([f"a line that only document {i} has, and no other one", f"a line of the pair {i // 2 % 500} of documents"]))
            for i in range(2000)]
    hashes = lines.marks(spark.createDataFrame(rows, "doc_id long, text string"), 20)
    told = lines.suspected(hashes, lines.filters(hashes, 2), 2, 10).count()
    assert 2000 <= told <= 2040


def test_empty_tables(nothing):
    assert lines.without_repeated_lines(nothing).collect() == []
    assert periodic.periodic_runs(nothing).collect() == []
    assert spelling.variants(spelling.word_counts(nothing)).collect() == []


def runs_by_comparing(words, shortest=12):
    """Maximal stretches for each period; the smallest period of each stretch."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(shortest, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(i + 1, j + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def test_runs_of_random_words():
    draw = random.Random(5)
    for _ in range(150):
        texts = []
        for _ in range(draw.randrange(1, 6)):
            k, n = draw.choice([1, 2, 3, 50]), draw.choice([0, 1, 5, 11, 12, 30, 100, 300])
            own = [draw.randrange(k) for _ in range(n)]
            if draw.random() < .5 and n:
                a = draw.randrange(n)
                p = 1 + (n - a) // (3 + draw.randrange(8))
                own = own[:a] + [own[a + (i - a) % p] for i in range(a, n)]
            texts.append(own)
        text, *rest = periodic.runs_of([np.array(t, np.int64) for t in texts], 12)
        for nth, own in enumerate(texts):
            assert [tuple(map(int, r)) for t, *r in zip(text, *rest) if t == nth] == runs_by_comparing(own)


def test_few_steps_a_block_give_the_same(monkeypatch):
    own = [np.array([i % 7 for i in range(200)] + list(range(300, 320)), np.int64), np.zeros(50, np.int64)]
    want = [x.tolist() for x in periodic.runs_of(own, 12)]
    monkeypatch.setattr(periodic, "STEPS", 10)
    assert [x.tolist() for x in periodic.runs_of(own, 12)] == want


def words_of(text):
    return (text or "").encode().split()


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("table", ["nasty", "small"])
def test_periodic_runs_of_tables(request, table):
    docs = request.getfixturevalue(table)
    docs = docs.where("doc_id <> 21 or doc_id is null")  # its 20,000 words are too many for the comparison
    want = []
    for doc, text in rows_of(docs):
        words = words_of(text)
        runs = runs_by_comparing(words)
        want.append((doc, len(words), runs, collapsed(words, runs).decode()))
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"])
           for r in periodic.periodic_runs(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_run_digests_of_the_query(spark, folder):
    got = {r["doc_id"]: r for r in QUERIES["op12_runs"](spark, folder).collect()}
    for doc, text in rows_of(spark.read.parquet(f"{folder}/documents.parquet")):
        words = words_of(text)
        h, n = zlib.crc32(str(doc).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert words == tail_repeated(doc, words_of(text))
        runs = runs_by_comparing(words)
        row = got.pop(doc)
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        assert row["n_runs"] == len(runs)
        assert (row["start"], row["length"], row["period"], row["exponent_milli"]) == (
            (best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4)
        told = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
        assert row["runs_sha256"] == hashlib.sha256(told).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs)).hexdigest()
    assert not got


def one_apart(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped(counts, stronger=10):
    close = defaultdict(set)
    for word in counts:
        for key in {word[:i] + word[i + 1:] for i in range(len(word))} | {word}:
            close[key].add(word)
    near = defaultdict(set)
    for words in close.values():
        for a in words:
            near[a] |= {b for b in words if one_apart(a, b)}
    form = {}
    for word, n in counts.items():
        best = min(near[word], key=lambda o: (-counts[o], o), default=None)
        form[word] = best if best is not None and counts[best] >= stronger * n else None
    out = {}
    for word, n in counts.items():
        root = word
        while form[root] is not None:
            root = form[root]
        out[word] = (word, n, len(near[word]), form[word], counts[form[word]] if form[word] else None, root)
    return out


def counted(rows, edit=lambda doc, word: word, least=2):
    total = Counter()
    for doc, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            word = edit(doc, lower(run)) if run else ""
            total[word] += len(word) >= 7
            run = ""
    return {w: n for w, n in total.items() if n >= least}


def test_spelling_query_matches_brute_force(spark, folder):
    rows = rows_of(spark.read.parquet(f"{folder}/documents.parquet"))
    want = grouped(counted(rows, lambda doc, word: word if zlib.crc32(f"{doc}:{word}".encode()) % 31 else letter_lost(doc, word)))
    assert {r["word"]: tuple(r) for r in QUERIES["op13_spelling"](spark, folder).select(
        "word", "n", "n_near", "form", "form_n", "root").collect()} == want


def test_words_of_nasty_texts(nasty):
    assert {r["word"]: r["n"] for r in spelling.word_counts(nasty, least=1).collect()} == counted(rows_of(nasty), least=1)


@pytest.mark.parametrize("leaf", [3, spelling.LEAF])
def test_variants_of_awkward_words(spark, monkeypatch, leaf):
    """Very long words, anagrams, chains of forms, ties, one letter only, letters without a group, hot vectors."""
    monkeypatch.setattr(spelling, "LEAF", leaf)
    draw = random.Random(8)
    counts = {"a" * n: 3 for n in range(1, 40)} | {"b" * 29 + c: 5 for c in "bcdé漢🎉"} | {"x" * 5000: 1, "x" * 5001: 20}
    counts |= {"".join(draw.sample("listens", 7)): draw.randrange(1, 50) for _ in range(60)}
    counts |= {"chain": 1, "chains": 10, "chainse": 100, "chainsed": 1000, "tieword": 1, "tiewora": 10, "tieworb": 10, "": 4, "z": 2}
    counts |= {"".join(draw.choice("abc") for _ in range(draw.randrange(6, 9))): draw.randrange(1, 300) for _ in range(400)}
    rows = [(w, n, 0) for w, n in counts.items()] + [(None, 5, 0), ("chain", 0, 0)]
    words = spark.createDataFrame(rows, "word string, n long, root int").repartition(3)
    got = {r["word"]: tuple(r) for r in spelling.variants(words).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    assert got == grouped(counts)
