"""A corpus made ready for training: filter by quality, drop near copies, cut repeated passages, mix sources, pack.

Each stage takes (spark, docs, folder), works on all that its predecessor kept and, but for the last, returns the columns
of documents; it is written as Parquet and read again as the next one's docs.

Documents are followed by their doc_id. Rows without one belong to no document and go, in whatever stage they come. Rows
that repeat a doc_id are one document: the stages that need texts once keep one of them. Columns that documents have besides
are carried along, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonescope.llm.common import documents, settle
from tonescope.llm.importance import resample
from tonescope.llm.mixing import mix
from tonescope.llm.neardup import near_duplicates
from tonescope.llm.packing import pack
from tonescope.llm.substrings import removed

SHINGLE, SIMILAR = 5, 80
SHARDS = 16


def beside(docs: DataFrame, facts: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`facts` under column names that `docs` has not, and those names by the old ones."""
    names = {c: c for c in facts.columns}
    for c in names:
        while names[c] in docs.columns:
            names[c] = f"its_{names[c]}"
    return facts.withColumnsRenamed(names), names


def good_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier rejects go: those whose draw is too small, and those without a word (null, empty)."""
    judged = resample(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return docs.join(judged.where("kept").select("doc_id"), "doc_id", "left_semi")


def without_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near copies (rows that repeat a doc_id included) the one of smallest doc_id stays.

    Texts without a word are near copies of nothing and stay.
    """
    kept = near_duplicates(docs, SHINGLE, SIMILAR).where("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def without_repeats(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Passages that stand earlier are cut from the texts; documents of which nothing stays go.

    Texts of which nothing is cut stay as they are, also null and empty ones; n_chars follows the new text. Of rows that
    repeat a doc_id one stays.
    """
    cut = removed(docs, with_text=True).where("n_removed = 0 or kept <> ''").select("doc_id", "n_removed", "kept")
    cut, name = beside(docs, cut.dropDuplicates(["doc_id"]))
    # The texts come from the operator; the rows themselves bring all other columns.
    rest = docs.withColumn("text", F.col("text").isNotNull()).dropDuplicates(["doc_id"])
    joined = rest.join(cut, rest["doc_id"] == cut[name["doc_id"]])
    return joined.withColumns({
        "text": F.when(F.col("text"), F.col(name["kept"])),
        "n_chars": F.when(F.col(name["n_removed"]) > 0, F.char_length(name["kept"]).cast("long")).otherwise(
            F.col("n_chars"))}).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """A row for each time that the mix takes a document; a partition holds one shard, shuffled.

    Documents without a word have size 0 and are taken with their source. Ties of the shuffle go by doc_id.
    """
    docs = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    taken, name = beside(docs, settle(mix(docs, SHARDS).select("doc_id", "shard", "order"), "taken"))
    shard = name["shard"]
    shards = 1 + (taken.agg(F.max(shard)).first()[0] or 0)
    return (docs.join(taken, docs["doc_id"] == taken[name["doc_id"]]).repartitionByRange(shards, shard)
            .sortWithinPartitions(shard, name["order"], docs["doc_id"]).select(*docs.columns))


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token pieces and their places in training sequences; null and empty texts are their end mark alone."""
    return pack(docs)


STAGES = [("quality classifier", good_quality), ("near-dedup", without_near_copies),
          ("suffix-array dedup", without_repeats), ("mixing", mixed), ("packing", packed)]

#: SQL can express neither the classifier nor the tokenizer; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, folder), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, folder)
