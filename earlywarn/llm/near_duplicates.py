"""Near-duplicate documents by an exact Jaccard join of 5-word shingles with signature trees.

See ``signature_trees`` for the method and its plan. Two documents link at a similarity of ``num / den`` (0.75) or more; a class is what links reach.

Defined cases: a document without words (null, empty or blank text) has an empty set, links with nothing and is a class of its own; fewer than five words are one
shingle; repeated rows are equal sets, so one class; rows with one id are judged by their own texts; a null id stays null and never names a class unless
all ids of the class are null; an empty table gives no rows; other columns pass through ``drop_near_duplicates`` untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earlywarn.llm import setjoin, signature_trees
from earlywarn.llm.storage import materialize

NUM, DEN, WORDS = 3, 4, 5


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = NUM, den: int = DEN) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (ids are longs)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return named_classes(*signature_trees.link_sets(rows, setjoin.shingle_sets(WORDS), num, den))


def named_classes(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` from sets (row, n, key) and the classes of their keys (key, label): a class bears its smallest id."""
    # equal keys first, then linked keys: both are small rows without text
    by_key = members.where("n > 0").groupBy("key").agg(F.min("row").alias("first"))
    named = by_key.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    of_class = named.groupBy("label").agg(F.min("first").alias("component_id"))
    of_key = materialize(named.join(of_class, "label").select("key", "component_id"))
    joined = members.where("n > 0").join(of_key, "key").select("row", "n", "component_id")
    alone = members.where("n = 0").select("row", "n", F.col("row").alias("component_id"))
    return joined.unionByName(alone).select(F.col("row").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each class: the one with the smallest id. Of repeated rows with that id and an equal text one stays.

    Only the ids of removed documents meet the texts, by an anti join. They are written before, so that Spark knows their size when it picks the plan."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    found = materialize(near_duplicate_classes(docs, doc_id, text, **options))
    gone = materialize(found.where("not doc_id <=> component_id").select(F.col("doc_id").alias("_gone")).distinct())
    d = docs.toDF(*names)
    i, t = names[docs.columns.index(doc_id)], names[docs.columns.index(text)]
    kept = d.join(gone, F.col(i).cast("long").eqNullSafe(F.col("_gone")), "left_anti")
    # only tables with repeated ids pay for telling their rows apart
    if found.groupBy("doc_id").count().where("count > 1").limit(1).count():
        heads = found.where("doc_id <=> component_id").select(F.col("doc_id").alias("_keep")).distinct()
        other = d.join(heads, F.col(i).cast("long").eqNullSafe(F.col("_keep")), "left_semi")
        kept = other.dropDuplicates([i, t])
    return kept.toDF(*docs.columns)
