"""Packing, sharding, mixing, classifier, pages, urls, vectors: against brute force, round trips and held-out labels."""

import collections
import html
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonescope.llm import importance, mixing, neighbours, packing, pagetext, sharding, urlfilter
from tonescope.llm.queries import ORACLES, QUERIES, URL_RULES


@pytest.mark.parametrize("table", ["nasty", "small"])
def test_packing_round_trip(request, table):
    from tokenizers import Tokenizer
    docs = request.getfixturevalue(table)
    model = Tokenizer.from_file(packing.default_vocabulary())
    want = collections.Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = np.array(model.encode(r["text"] or "", add_special_tokens=False).ids + [0], dtype="<u4")
        for i, at in enumerate(range(0, len(ids), 2048)):
            want[(r["doc_id"], i, at, len(ids[at:at + 2048]), zlib.crc32(ids[at:at + 2048].tobytes()))] += 1
    rows = packing.pack(docs).collect()
    assert collections.Counter(tuple(r)[:5] for r in rows) == want
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert len(places) <= -(-total // 2048) * 1.05 + 1


def test_plan_is_best_fit_over_counts():
    draw = random.Random(5)
    for _ in range(50):
        histogram = {draw.randint(1, 100): draw.randint(1, 60) for _ in range(draw.randint(1, 25))}
        placed, slots = collections.defaultdict(set), collections.defaultdict(list)
        for length, rank, many, first, offset in packing.plan(histogram, 100):
            for i in range(many):
                placed[length].add(rank + i)
                slots[first + i].append((offset, length))
        assert {n: len(s) for n, s in placed.items()} == histogram
        assert all(s == set(range(len(s))) for s in placed.values())
        left = []  # plain best fit, longest first
        for length in sorted(histogram.keys(), reverse=True):
            for _ in range(histogram[length]):
                fits = [x for x in left if x >= length]
                best = min(fits) if fits else 100
                if fits:
                    left.remove(best)
                left.append(best - length)
        assert len(slots) == len(left)


@pytest.mark.parametrize("table", ["nasty", "small"])
def test_shards_are_even_and_keep_equal_texts(request, table):
    docs = request.getfixturevalue(table)
    rows = sharding.shard(docs, 16).collect()
    texts = collections.Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode()))
                                for r in docs.select("doc_id", "text").collect())
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
    sizes, slots, where = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in rows:
        assert 0 <= r["shard"] < 16 and r["law"] == "bytes" and r["grown_shard"] is None
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        where[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    share, largest = sum(sizes.values()) / 16, max(r["size"] for r in rows)
    assert max(sizes.values()) <= max(1.1 * share, largest + 0.1 * share)
    assert all(len(s) == 1 for s in where.values())


def test_a_text_heavier_than_a_shard_is_sliced(spark):
    rows = [(i, "the same text in half of all rows" if i % 2 else f"text {i} " + "x" * (i % 40)) for i in range(4000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 16).collect()
    sizes = collections.Counter()
    for r in out:
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 16 and max(sizes.values()) < 1.1 * min(sizes.values())
    assert len({(r["shard"], r["slot"]) for r in out}) == 4000


def test_targets_fill_up_to_the_limit():
    assert mixing.targets([100, 100, 100]) == [187.5, 75.0, 37.5]
    assert mixing.targets([10, 500, 490]) == [30.0, pytest.approx(970 * 2 / 3), pytest.approx(970 / 3)]
    assert mixing.targets([0, 0]) == [0.0, 0.0] and mixing.targets([]) == []


def test_splitting_tree_splits_quotas_exactly():
    shares = mixing.splitting_tree([5, 1000, 37, 0], 12, seed=3)
    assert len(shares) == 12 and np.sum(shares, axis=0).tolist() == [5, 1000, 37, 0]
    assert max(map(sum, shares)) - min(map(sum, shares)) <= 4
    assert shares == mixing.splitting_tree([5, 1000, 37, 0], 12, seed=3)


@pytest.mark.parametrize("table", ["nasty", "small"])
def test_mix_comes_near_its_targets(request, table):
    docs = request.getfixturevalue(table)
    want = collections.Counter()
    for r in docs.select("doc_id", "source", "text").collect():
        want[r["source"]] += len((r["text"] or "").encode().split())
    rows = mixing.mix_draws(docs, 8).collect()
    assert len(rows) == docs.count()
    taken, largest, targets = collections.Counter(), collections.Counter(), {}
    for r in rows:
        n = len(r["draws"] or [])
        assert n <= 3 and r["source_size"] == want[r["source"]]
        taken[r["source"]] += n * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        targets[r["source"]] = r["target"]
    order = sorted((s for s in want if s is not None)) + [None] * (None in want)
    assert [targets[s] for s in order] == pytest.approx(mixing.targets([want[s] for s in order]))
    for s in order:
        assert abs(taken[s] - targets[s]) <= max(largest[s], 1)
    again = mixing.mix(docs, 8).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7), 8).collect()), key=str)


def test_classifier_on_held_out_labels(spark, folder):
    folder = folder.replace("0.001", "0.1")  # enough labelled documents for shares to mean something
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in importance.resample(docs, labels).collect()}
    marks = importance.labelled(labels)
    held = [(d, good, bad) for d, (good, bad, model) in marks.items() if not model]
    good = [rows[d]["kept"] for d, g, _ in held if g]
    bad = [rows[d]["kept"] for d, _, b in held if b]
    assert np.mean(good) >= 0.95 and np.mean(bad) <= 0.15
    least = min(r["draw"] for r in rows.values() if r["kept"])
    assert all(r["kept"] == (r["draw"] is not None and r["draw"] >= least) for r in rows.values())
    assert sum(r["kept"] for r in rows.values()) == sum((r["log_weight"] or 0) > 0 for r in rows.values())


def test_classifier_against_brute_force(spark, folder):
    """Counts, ratios, scores, scale, noise and choice, one document and one n-gram after the other."""
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in importance.resample(docs, labels).collect()}
    half = importance.BUCKETS
    grams = {r["doc_id"]: importance._grams(r["text"], importance._Hashes(), half).tolist() for r in docs.collect()}
    key = {r["doc_id"]: r["key"] for r in labels.select("doc_id", F.xxhash64(F.lit("label"), "doc_id").alias("key")).collect()}
    per = collections.defaultdict(list)
    for r in labels.collect():
        per[r["doc_id"]].append((r["quality"], r["toxic"]))
    good = {d for d, own in per.items() if min(q for q, _ in own) == 1 and not max(t for _, t in own)}
    bad = {d for d, own in per.items() if min(q for q, _ in own) == 0}
    raw, target = collections.Counter(), collections.Counter()
    for d, own in grams.items():
        raw.update(own)
        if d in good and key[d] % 2 == 0:
            target.update(own)
    total = [[sum(n for g, n in c.items() if g // half == part) for part in (0, 1)] for c in (raw, target)]

    def ratio(g):
        share = (raw[g] + 0.5) / (total[0][g // half] + 0.5 * half)
        goal = (target[g] + importance.SMOOTHING * share) / (total[1][g // half] + importance.SMOOTHING)
        return math.log(goal / share)

    score = {d: sum(map(ratio, own)) / len(own) for d, own in grams.items() if own}
    assert {d for d, r in got.items() if r["score"] is not None} == set(score)
    assert all(abs(got[d]["score"] - v) < 1e-9 for d, v in score.items())
    fine = sorted(v for d, v in score.items() if d in good and key[d] % 2)
    poor = [v for d, v in score.items() if d in bad and key[d] % 2]
    zero, cuts = np.quantile(fine, 0.01), sorted({*fine, *poor})
    if poor:
        costs = [importance.COST * sum(v < c for v in fine) / len(fine) + sum(v >= c for v in poor) / len(poor) for c in cuts]
        best = min(range(len(cuts)), key=lambda i: (round(costs[i], 12), i))
        zero = (cuts[best] + cuts[max(best - 1, 0)]) / 2
    weight = {d: (v - zero) * 10 / max(np.median(fine) - zero, 1e-9) for d, v in score.items()}
    assert all(abs(got[d]["log_weight"] - v) < 1e-6 for d, v in weight.items())
    hashed = docs.select("doc_id", F.xxhash64(F.lit(0), F.lit("gumbel"), "doc_id").alias("h")).collect()
    even = {r["doc_id"]: (r["h"] % (1 << 52) + 0.5) / (1 << 52) for r in hashed}
    draw = {d: v - math.log(-math.log(even[d])) for d, v in weight.items()}
    k = sum(v > 0 for v in weight.values())
    assert {d for d, r in got.items() if r["kept"]} == set(sorted(draw, key=draw.get, reverse=True)[:k])


def test_classifier_edges(spark, nasty, nothing):
    labels = spark.createDataFrame([(10, 1, 0), (None, 1, 0), (11, None, None), (99, 0, 1), (10, 1, None)],
                                   "doc_id long, quality int, toxic int")
    rows = importance.resample(nasty, labels).collect()
    assert len(rows) == nasty.count()
    assert all(not r["kept"] and r["score"] is None for r in rows if r["doc_id"] in (13, 14, 15))
    unlabelled = importance.resample(nasty, labels.where("false")).collect()
    assert all(r["kept"] == (r["score"] is not None) for r in unlabelled)
    assert importance.resample(nothing, labels).count() == 0


def test_largest_finds_the_kth(spark):
    values = [random.Random(i).gauss(0, 10) for i in range(500)] + [3.5] * 40
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 7, 250, 540):
        assert importance.largest(rows, "x", k) == sorted(values, reverse=True)[k - 1]


PAGES = [
    (1, "http://a.example/1", "<html><body><nav>Menu One Two</nav><article><h1>Title &amp; more</h1><p>First <b>bold</b>text"
        "<br>line<p>Second&nbsp;par<div class='comments'><p>reader says</div></article><footer>foot</footer></body></html>",
     "Title & more First boldtext line Second par"),
    (2, "http://a.example/2", "<div class='cookie-notice'>We use cookies</div><main><header><h1>Head</h1></header>"
        "<aside>side</aside><p>Body 1 &lt; 2<script>var x='</p>';</script></p><form>q<input></form></main>",
     "Head Body 1 < 2"),
    (3, None, None, ""), (4, "x", "", ""), (5, "http://b.example/", "plain text only", "plain text only"),
    (6, "http://b.example/2", "<p>one</p><!-- no <p>hidden</p> --><p hidden>gone</p><style>p{}</style>two", "one two"),
]


def test_page_text(spark):
    rows = spark.createDataFrame([(i, u, h, 1, 2) for i, u, h, _ in PAGES],
                                 "page_id long, url string, html string, text int, host int")
    got = {r["page_id"]: r for r in pagetext.main_text(rows).collect()}
    for i, url, _, text in PAGES:
        assert (got[i]["text"], got[i]["url"], got[i]["n_chars"]) == (text, url, len(text)), i
    assert pagetext.main_text(rows.where("false")).count() == 0


def test_open_blocks_lose_what_repeats_on_their_host(spark):
    shared = " ".join(f"menu{i}" for i in range(15))
    rows = [(i, f"http://h{i % 2}.example/{i}", f"<div>{shared} start</div><div>own words of page {i} stay here</div>"
             + ("<div>short line</div>" if i < 3 else "")) for i in range(6)]
    rows.append((9, "http://alone.example/", f"<div>{shared} start</div>"))
    got = {r["page_id"]: r["text"] for r in pagetext.main_text(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[4] == "own words of page 4 stay here" and got[1] == "own words of page 1 stay here short line"
    assert got[9] == f"{shared} start"


def test_articles_of_real_pages(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in pagetext.main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        plain = re.sub(r"</?(?:h1|p|br)>", " ", inner).replace("<b>", "")
        assert got[r["page_id"]] == " ".join(html.unescape(plain).split())


URLS = ["http://Example.ORG/es/x?q", "https://sub.example.org/en/17", "ftp://notexample.org/es/", "no scheme", None, "",
        "http://example.org", "http://a.b.com/fr/#x", "http://com/de/y", "http://x.de/de/", "http://example.org/en/2",
        "://org/", "http://user@a.org:80/x", "http://a.org?x/y", "http://É.org/ü", "x://a.example.org/es"]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for v, r in URL_RULES if (h := r.split("/")[0]) and (host == h or host.endswith("." + h))
            and path.startswith(r[len(h):])]
    return host, path, *(max(fits)[1:] if fits else (None, "allow"))


@pytest.mark.parametrize("bits", [urlfilter.MOST_BITS, 10])
def test_url_filter(spark, bits):
    """The second run is over the filters' bound and takes the join."""
    rows = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(URLS + URLS[:2])],
                                 "page_id long, url string, host string, keys string")
    got = {r["page_id"]: tuple(r)[1:] for r in urlfilter.url_filter(rows, URL_RULES, bits).collect()}
    assert got == {i: judged(u) for i, u in enumerate(URLS + URLS[:2])}
    assert urlfilter.url_filter(rows.where("false"), URL_RULES, bits).count() == 0


def test_cascade_is_exact_on_its_universe(spark):
    keys = urlfilter._hashed(spark.range(20_000).selectExpr("concat('k', id) AS key"))
    listed, others = (keys.where(f"cast(substr(key, 2) AS int) % 9 {op} 0") for op in ("=", "<>"))
    cascade = urlfilter.build_cascade(listed, others)
    for side, member in ((listed, True), (others, False)):
        rows = side.toPandas()
        assert (cascade.member(rows["one"].to_numpy(), rows["two"].to_numpy()) == member).all()
    assert len(cascade.levels) > 2


def nearest(rows, k=5):
    good = {i: np.array(v, dtype=float) for i, v in rows if i is not None and v and None not in v
            and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q in good:
        if q % 50 == 0:
            sims = [(-round(float(v @ good[q] / np.sqrt(v @ v) / np.sqrt(good[q] @ good[q])), 12), i)
                    for i, v in good.items() if i != q]
            out[q] = [i for _, i in sorted(sims)[:k]]
    return out


def test_search_edges(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=8).round(3).tolist()) for i in range(150)]
    rows[0:4] = [(0, None), (1, [0.0] * 8), (2, [None] + [1.0] * 7), (3, [float("nan")] * 8)]
    rows[50:60] = [(i, rows[100][1]) for i in range(50, 60)]
    rows += [rows[100], (None, [1.0] * 8), (200, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows],
                                  "vec_id long, embedding array<double>, node int, near double")
    got = collections.defaultdict(list)
    for r in neighbours.search(table, table["vec_id"] % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert dict(got) == nearest(rows[:-1])
    assert neighbours.search(table.where("false"), table["vec_id"] % 50 == 0).count() == 0
    few = neighbours.search(table.where("vec_id in (50, 70, 80)"), table["vec_id"] % 50 == 0).collect()
    assert [r["vec_id"] for r in few] and {r["vec_id"] for r in few} == {70, 80}


def test_small_tables_are_answered_whole_whatever_the_partitions(spark):
    """All five nearest of 20 vectors and their exact scores, with more partitions than vectors."""
    draw = np.random.default_rng(2)
    rows = {i: draw.normal(size=6) for i in range(40, 60)}
    table = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        got = neighbours.search(table, table["vec_id"] % 50 == 0).orderBy("rank").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    cosine = {i: float(rows[50] @ v / np.linalg.norm(rows[50]) / np.linalg.norm(v)) for i, v in rows.items() if i != 50}
    want = sorted(cosine, key=lambda i: (-cosine[i], i))[:5]
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(50, n, i) for n, i in enumerate(want, 1)]
    assert np.allclose([r["score"] for r in got], [cosine[i] for i in want], rtol=0, atol=1e-14)


def test_repeated_rows_leave_room_for_other_ids(spark):
    same = [1.0, 2.0, 3.0, 4.0]
    rows = [(0, same)] * 20 + [(i, same) for i in range(1, 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(table, table["vec_id"] == 0, 5).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3, 4, 5]


def test_search_recall(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    want = nearest([(r["vec_id"], r["embedding"]) for r in vectors.collect()])
    got = collections.defaultdict(set)
    for r in QUERIES["op10_neighbours"](spark, folder).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert np.mean([len(got[q] & set(w)) / len(w) for q, w in want.items()]) >= 0.9


def test_empty_tables(nothing):
    assert packing.pack(nothing).count() == 0
    assert sharding.shard(nothing).count() == 0
    assert mixing.mix_draws(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def test_sql_agrees(spark, folder):
    import duckdb
    base = duckdb.connect()
    base.sql(f"CREATE VIEW pages AS FROM '{folder}/pages.parquet'")
    want = base.sql(f"SELECT page_id, host, path, rule, verdict FROM ({ORACLES['op1_urlfilter']}) ORDER BY 1").fetchall()
    assert [tuple(r) for r in QUERIES["op1_urlfilter"](spark, folder).orderBy("page_id").collect()] == want
