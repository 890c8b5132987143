"""Near copies, repeated substrings, fingerprints: against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tonescope.llm import neardup, substrings, winnowing
from tonescope.llm.graphs import components


def shingles(text, n=2):
    own = (text or "").encode().lower().split()
    n = min(n, len(own))
    return {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if n else set()


def linked(texts, n=2, similar=80):
    """Smallest id reachable, by comparing all pairs."""
    sets = {i: shingles(t, n) for i, t in texts.items()}
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= similar * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("table", ["nasty", "small"])
def test_near_duplicates_match_all_pairs(request, table):
    docs = request.getfixturevalue(table)
    want = linked({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect() if r["doc_id"] is not None})
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"] is False
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_stars_go_on_where_the_first_centre_resembles_neither(spark):
    """Many documents share most of their bins' values with a centre that is not similar enough."""
    common = [f"c{i}" for i in range(60)]
    rows = [(0, " ".join(common[:40] + [f"z{i}" for i in range(40)]))]
    for k in range(1, 13):
        own = common[:45] + [f"k{k // 2}x{i}" for i in range(40)] + [f"u{k}"]
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = linked(dict(rows))
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()} == {
        i: c for i, (_, c) in want.items()}


def test_members_of_a_template_make_no_pairs(spark):
    """Long texts that share three quarters are told apart where they meet; those that are similar are still found."""
    common, own = [f"c{i}" for i in range(500)], lambda k, n: [f"u{k}x{i}" for i in range(n)]
    rows = [(k, " ".join(common + own(k, 83))) for k in range(1, 30)]
    rows += [(40, " ".join(own("z", 40) + common)), (41, " ".join(own("y", 40) + common))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = neardup.signatures(docs, 1)
    open_ = sets.select("doc_id", F.col("doc_id").alias("component"), "n_shingles", "parity")
    none = spark.createDataFrame([], "a long, b long")
    found = {tuple(r) for r in neardup.uncompared(open_, docs, none, 1, 80).collect()}
    words = {i: set(t.split()) for i, t in rows}
    near = {(a, b) for a in words for b in words if a < b and 100 * len(words[a] & words[b]) >= 80 * len(words[a] | words[b])}
    assert near == found == {(40, 41)} | {(k, z) for k in range(1, 30) for z in (40, 41)
                                          if 100 * 500 >= 80 * len(words[k] | words[z])}


def test_the_third_and_fourth_member_of_every_shared_bucket_are_found(spark):
    """With one bin all texts with the smallest of all shingles share one bucket; its first two members resemble none."""
    hashes = neardup._Hashes()
    common = min((f"c{i}" for i in range(500)), key=lambda w: neardup.shingle_hashes([w.encode()], hashes, 1)[0])
    pair = [f"p{i}" for i in range(30)]
    rows = [(k, " ".join([common, *(f"d{k}x{i}" for i in range(30))])) for k in (1, 2)]
    rows += [(3, " ".join([common, *pair])), (4, " ".join([common, *pair, "more"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shared = {tuple(r["bands"]) for r in neardup.signatures(docs, 1, 1, 1).collect()}
    assert len(shared) == 1
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, 1, rows=1, bands=1).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3}


@pytest.mark.parametrize("centres", [8, 1])
def test_all_pairs_of_a_bucket_are_compared(spark, monkeypatch, centres):
    """Families on one template in few buckets, against all pairs that share one."""
    import random
    monkeypatch.setattr(neardup, "CENTRES", centres)
    draw, rows = random.Random(4), []
    template = [f"t{i}" for i in range(90)]
    for family in range(12):
        own = template[:60] + [f"f{family}x{i}" for i in range(30)]
        for _ in range(4):
            rows.append((len(rows), " ".join(w if draw.random() > 0.12 else f"r{draw.random()}" for w in own)))
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bands = {r["doc_id"]: set(r["bands"]) for r in neardup.signatures(docs, 1, 1, 2).collect()}
    sets, top = {i: shingles(t, 1) for i, t in rows}, {i: i for i, _ in rows}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and bands[a] & bands[b] and 100 * both >= 70 * len(sets[a] | sets[b]):
                low, high = sorted((top[a], top[b]))
                top = {i: low if t == high else t for i, t in top.items()}
    assert len(set(top.values())) < len(rows)
    got = {r["doc_id"]: r["component_id"]
           for r in neardup.near_duplicates(docs, 1, 70, rows=1, bands=2).collect()}
    assert got == top


def test_one_permutation_estimates_similarity():
    oph, hashes = neardup.OnePermutation(6, 48), neardup._Hashes()
    for shared, total in ((8, 10), (300, 400), (50, 1000)):
        a = [b"%d" % i for i in range(shared)] + [b"a%d" % i for i in range((total - shared) // 2)]
        b = [b"%d" % i for i in range(shared)] + [b"b%d" % i for i in range((total - shared) // 2)]
        one, two = (oph.signature(neardup.shingle_hashes(x, hashes, 1)) for x in (a, b))
        assert abs((one == two).mean() - shared / total) < 0.15


def test_components_of_paths_and_cycles(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (300, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100, 200: 200, 300: 200}


def cut_by_hand(texts, least):
    seen, out = set(), {}
    for i in sorted(texts):
        text = (texts[i] or "").encode()
        gone = bytearray(len(text))
        for p in range(len(text) - least + 1):
            own = text[p:p + least]
            if own in seen:
                gone[p:p + least] = b"\1" * least
            seen.add(own)
        kept = bytes(x for x, g in zip(text, gone) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(text), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4_000, 1])
def test_repeated_substrings_match_brute_force(nasty, monkeypatch, hot):
    """The second run sends every name with two open spans down the way for hot ones."""
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "AT_LEAST", 3)
    texts = {r["doc_id"]: r["text"] for r in nasty.where("doc_id <> 22").select("doc_id", "text").collect()
             if r["doc_id"] is not None}
    want = cut_by_hand(texts, 100)
    got = substrings.removed(nasty.where("doc_id <> 22 or doc_id is null")).collect()
    assert len(got) == nasty.count() - 1
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]


def test_very_long_texts_are_cut_across_parts(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PART", 5_000)
    import random
    draw = random.Random(3)
    long = "".join(draw.choice("abcdefghij ") for _ in range(40_000))
    texts = {1: long, 2: "start " + long[4_900:5_200] + " then " + long[20_000:31_000], 3: "q" * 12_000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in substrings.removed(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert got == cut_by_hand(texts, 100)


def test_a_layout_holds_few_parts_of_a_text(monkeypatch):
    """A text longer than 2^PLACE_BITS elects the same places as by brute force."""
    import random

    import numpy as np
    import pyarrow as pa
    text = bytes(random.Random(5).choices(b"abcdefghij ", k=40_000))
    whole = substrings._Parts(100)
    for part in whole.cut(text):
        whole.add(0, *part)
    names = substrings._names(*whole.layout())[whole.gap:]
    monkeypatch.setattr(substrings, "PART", 5_000)
    monkeypatch.setattr(substrings, "AT_ONCE", 5_000)
    monkeypatch.setattr(substrings, "PLACE_BITS", 14)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["doc_id", "text"])
    starts = []
    for _, parts in substrings._batches(iter([batch]), 100):
        elected = substrings._elected(substrings._names(*parts.layout()), 100)
        for _, back, first, last in parts.rows:
            starts.extend(range(first, last + 1))
            for p in range(first, last + 1, 7):
                reach = names[p:p + 100 - substrings.NAMED + 1] >> np.uint64(14)
                assert elected[p - back] + back == p + int(np.argmin(reach))
    assert starts == list(range(len(text) - 99))


def test_kept_text_has_whole_characters(spark):
    first, second = "é" * 70 + "abc" * 40, "è" + "é" * 69 + "abc" * 40 + "end"
    docs = spark.createDataFrame([(1, first), (2, second)], "doc_id long, text string")
    kept = {r["doc_id"]: r["kept"] for r in substrings.removed(docs, with_text=True).collect()}
    assert kept[2].startswith("è") and kept[2].endswith("end") and len(kept[2]) < 20


def by_hand(text, k, w):
    own, word = [], ""
    for c in text or "":
        alone = any(a <= ord(c) <= b for a, b in (
            (0xE00, 0xFFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF),
            (0x20000, 0x3FFFF)))
        if word and (alone or c in " \t\n\v\f\r" or len(word) == winnowing.PIECE):
            own.append(word)
            word = ""
        if alone:
            own.append(c)
        elif c not in " \t\n\v\f\r":
            word += c
    own += [word] if word else []
    return [(i, tuple(own[i:i + k])) for i in range(max(len(own) - k + 1, min(1, len(own))))]


def test_winnowing_keeps_the_guarantee_and_the_edited_text(nasty, small):
    for docs in (nasty.where("doc_id is not null"), small):
        rows = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").orderBy("doc_id").collect()}
        ids = sorted(rows)
        got = winnowing.edited(docs).collect()
        assert len(got) == docs.count()
        prints, repeated = {}, len(got) - len(ids)
        for r in got:
            text = rows[r["doc_id"]]
            half = len(text) // 2
            follower = rows[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
            if not (repeated and r["doc_id"] == 24):
                edited = text[:len(text) - half] + follower[:half]
                assert hashlib.sha256(edited.encode()).hexdigest() == r["edited_sha256"]
            assert r["n_chars"] == len(text) and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
            assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
            places = [int(p.split(":")[0]) for p in r["fingerprint"].split()]
            grams = by_hand(text, winnowing.K, winnowing.W)
            # Every window of W grams has a kept place.
            last = -1
            for p in places:
                assert p - last <= winnowing.W
                last = p
            assert bool(places) == bool(grams) and (not grams or len(grams) - last <= winnowing.W)


def test_fingerprints_and_likeness_against_brute_force(spark, nasty):
    """Every gram hashed one by one, every window looked through; texts without spaces are found again in part."""
    draw = random.Random(4)
    plain = "".join(chr(0x4E00 + draw.randrange(3000)) for _ in range(480))
    more = [(100, plain), (101, "other words that follow here " * 20), (102, "q" + "xyz0123456789" * 60), (103, None)]
    docs = nasty.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(
        spark.createDataFrame(more, "doc_id long, text string"))
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    ids = sorted(rows)
    follower = {a: rows[b] for a, b in zip(ids, ids[1:] + ids[:1])}
    halves = {i: t[:len(t) - len(t) // 2] + follower[i][:len(t) // 2] for i, t in rows.items()}
    k, w = winnowing.K, winnowing.W
    grams = {t: [g for _, g in by_hand(t, k, w)] for t in {*rows.values(), *halves.values()}}
    every = sorted({g for own in grams.values() for g in own})
    table = spark.createDataFrame([(i, list(g)) for i, g in enumerate(every)], "i int, g array<string>")
    value = {every[r["i"]]: (r["h"] % (1 << 64)) >> 29 for r in table.select("i", F.xxhash64("g").alias("h")).collect()}

    def kept(text):
        hashed = [value[g] for g in grams[text]]
        out = []
        for a in range(max(1, len(hashed) - w + 1) if hashed else 0):
            at = min(range(a, min(a + w, len(hashed))), key=lambda i: (hashed[i], -i))
            if at not in out[-1:]:
                out.append(at)
        return " ".join(f"{i}:{hashed[i]:x}" for i in sorted(set(out)))

    def like(x, y):
        x, y = ({p.split(":")[1] for p in v.split()} for v in (x, y))
        return len(x & y) / len(x | y) if x | y else 1.0

    got = {r["doc_id"]: r for r in winnowing.edited(docs).collect()}
    for i in ids:
        own, half, after = kept(rows[i]), kept(halves[i]), kept(follower[i])
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (own, half)
        assert abs(got[i]["near_edited"] - like(own, half)) < 1e-12
        assert abs(got[i]["near_next"] - like(own, after)) < 1e-12
    assert got[100]["near_edited"] > 0.25 and got[102]["near_edited"] > 0.25


def test_winnowing_takes_the_rightmost_of_equal_hashes(spark):
    docs = spark.createDataFrame([(1, "a " * 40)], "doc_id long, text string")
    places = [int(p.split(":")[0]) for p in winnowing.edited(docs).first()["fingerprint"].split()]
    assert places == list(range(winnowing.W - 1, 40 - winnowing.K + 1))


def test_followers_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "ROWS_PER_RANGE", 7)
    rows = spark.range(100).selectExpr("id * id % 101 AS id").distinct().selectExpr("id", "cast(id AS string) AS text")
    ids = sorted(r["id"] for r in rows.collect())
    got = {r["id"]: r["next_text"] for r in winnowing.with_next(rows, "id", ["text"]).collect()}
    assert got == {a: str(b) for a, b in zip(ids, ids[1:] + ids[:1])}


def test_empty_tables(nothing):
    assert neardup.near_duplicates(nothing).count() == 0
    assert substrings.removed(nothing).count() == 0
    assert winnowing.edited(nothing).count() == 0
