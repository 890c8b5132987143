"""Each stage against what its operator says, on difficult and on empty input."""

import collections

import corpus_pipeline as pipeline
from tests.llm.test_texts import linked

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_difficult_rows(spark, nasty, nothing, folder):
    for docs in (nasty, nothing):
        columns = docs.columns
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == columns, name
            out.count()
        packed = pipeline.STAGES[-1][1](spark, docs, folder)
        assert packed.count() >= docs.count()


def test_stage_results(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = pipeline.good_quality(spark, docs, folder)
    assert 0.6 * docs.count() < good.count() < docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    single = pipeline.without_near_copies(spark, docs, folder)
    assert {r["doc_id"] for r in single.collect()} == {i for i, (n, c) in linked(texts, 5).items() if i == c}
    cut = pipeline.without_repeats(spark, docs, folder).collect()
    assert all(r["n_chars"] == len(r["text"]) and r["text"] for r in cut)
    assert sum(r["n_chars"] for r in cut) < sum(map(len, texts.values()))
    mixed = pipeline.mixed(spark, docs, folder).collect()
    assert max(collections.Counter(r["doc_id"] for r in mixed).values()) <= 3
    words = sum(len(r["text"].encode().split()) for r in mixed)
    assert abs(words / sum(len(t.encode().split()) for t in texts.values()) - 1) < 0.1


def test_run(spark, folder):
    out = pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 0


def test_stages_keep_one_row_a_document_whatever_the_columns_are_called(spark, folder):
    """Repeated rows, rows without doc_id, empty texts, ties and names that the stages use themselves."""
    from tests.llm.conftest import words
    passage = words(40, 60)
    own = {1: words(41, 80) + "A " + passage, 2: words(42, 80) + "B " + passage + " " + words(43, 30), 3: words(44, 90), 4: "", 5: None}
    rows = [(i, t, len(t or "")) for i, t in own.items()] + [(3, own[3], len(own[3]))] * 2 + [(None, own[1], len(own[1]))]
    clash = ["_doc", "_kept", "_shard", "_order", "kept", "n_removed", "shard", "order", "its_kept", "draw"]
    docs = spark.createDataFrame([(i, t, "en", "s", n, *range(len(clash))) for i, t, n in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, "
                                 + ", ".join(f"`{c}` int" for c in clash)).repartition(3)
    beside = tuple(range(len(clash)))

    def told(out):
        assert out.columns == docs.columns
        return sorted((tuple(r) for r in out.collect()), key=str)

    def row(i, text):
        return (i, text, "en", "s", len(text or ""), *beside)

    assert told(pipeline.without_near_copies(spark, docs, folder)) == sorted([row(i, t) for i, t in own.items()], key=str)
    cut = told(pipeline.without_repeats(spark, docs, folder))
    second = own[2].replace(" " + passage, "")
    assert cut == sorted([row(i, second if i == 2 else t) for i, t in own.items()], key=str)
    # One source, whose target is its size: each document is taken once.
    assert told(pipeline.mixed(spark, docs, folder)) == sorted([row(i, t) for i, t in own.items()], key=str)
    good = told(pipeline.good_quality(spark, docs, folder))
    assert len(good) == len([r for r in good if r[0] in (1, 2, 3)]) and all(r[5:] == beside for r in good)
    once = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    pieces = pipeline.packed(spark, once, folder).collect()
    assert sorted(r["doc_id"] for r in pieces) == [1, 2, 3, 4, 5]
