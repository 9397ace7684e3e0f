"""Queries of problems 6, 7 and 8 over the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragloom.llm.leaks import leak_spans, leaked_items, without_leaks
from fragloom.llm.packing import pack
from fragloom.llm.subjects import document_subjects
from fragloom.llm.tokens import token_counts
from fragloom.plans.tables import table
from fragloom.session import Scratch


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a bin of every container."""
    scratch = Scratch(spark, "p6")
    targets = [(r.container, r.capacity_tokens) for r in table(spark, sf_dir, "pack_targets").collect()]
    return pack(scratch.table(token_counts(table(spark, sf_dir, "documents"))), targets, scratch)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins, pieces and the part of the room that is used, by container."""
    bins = p6_pack(spark, sf_dir).groupBy("container", "bin").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    capacity = table(spark, sf_dir, "pack_targets").select("container", "capacity_tokens")
    per = bins.groupBy("container").agg(F.count(F.lit(1)).alias("n_bins"), F.sum("n").alias("n_pieces"), F.sum("size").alias("n_tokens"), F.max("size").alias("fullest"))
    return per.join(capacity, "container").withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_bins") * F.col("capacity_tokens")), 4))


def p6_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for each container: every document is in it with all its tokens, no bin holds too much, and none is split that fits."""
    scratch = Scratch(spark, "p6")
    lengths = scratch.table(token_counts(table(spark, sf_dir, "documents")))
    capacity = table(spark, sf_dir, "pack_targets").select("container", F.col("capacity_tokens").cast("bigint").alias("capacity"))
    packed = scratch.table(pack(lengths, [(r.container, r.capacity) for r in capacity.collect()], scratch))
    over = packed.groupBy("container", "bin").agg(F.sum("size").alias("size")).join(capacity, "container").groupBy("container").agg(F.count_if(F.col("size") > F.col("capacity")).alias("n_over"))
    own = packed.groupBy("container", "doc_id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("pieces"), F.max("piece").alias("last"))
    held = own.join(lengths, "doc_id").join(capacity, "container")
    wrong = (F.col("size") != F.col("n_tokens")) | (F.col("last") + 1 != F.col("pieces"))
    needless = F.col("pieces") > F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("capacity")))
    per = held.groupBy("container", "capacity").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(wrong).alias("n_wrong"), F.count_if(needless).alias("n_needless"))
    return per.join(over, "container")


def p7_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of stretches without a touched word."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), one_in=1_000_000)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affected documents with the number of passages, and their length before and after these are taken out."""
    documents = table(spark, sf_dir, "documents")
    spans = Scratch(spark, "p7").table(leak_spans(documents, table(spark, sf_dir, "eval_items")))
    affected = spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_passages"))
    clean = without_leaks(documents.join(affected, "doc_id"), spans)
    return clean.select("doc_id", "n_passages", F.length("text").cast("bigint").alias("n_before"), F.length("clean_text").cast("bigint").alias("n_after"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    subjects = sorted(r.subject for r in table(spark, sf_dir, "subject_areas").select("subject").collect() if r.subject)
    return document_subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_seeds"), subjects, table(spark, sf_dir, "eval_items"), Scratch(spark, "p8"))


def p8_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the result stands to the labelled documents: their labels, and whether nine in ten are found, and most of what is found are theirs (nearly all, but for a corpus of a hundred files)."""
    scratch = Scratch(spark, "p8")
    labels = table(spark, sf_dir, "subject_seeds").select("doc_id", "subject").distinct()
    found = scratch.table(p8_found(spark, sf_dir)).join(labels.select("doc_id").distinct(), "doc_id")
    both = labels.withColumn("label", F.lit(1)).join(found.withColumn("found", F.lit(1)), ["doc_id", "subject"], "full_outer")
    n = both.agg(F.count("label").alias("n_labels"), F.count("found").alias("n_found"), F.count_if(F.col("label").isNotNull() & F.col("found").isNotNull()).alias("n_both"))
    return n.select("n_labels", (F.col("n_both") >= F.col("n_labels") * 0.9).alias("recalled"), (F.col("n_both") * 2 >= F.col("n_found")).alias("precise"))


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters of the corpus by subject; a document of several subjects counts for each."""
    sizes = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("bigint").alias("n"))
    return p8_found(spark, sf_dir).join(sizes, "doc_id").groupBy("subject").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("n_characters"))


QUERIES = {q.__name__: q for q in (p6_pack, p6_fill, p6_check, p7_found, p7_clean, p7_verbatim, p8_found, p8_composition, p8_seeds)}
_WORDS = "regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+')"
_FORTY = "SELECT DISTINCT {key}, hash(w[k : k + 39]) AS h FROM (SELECT {key}, w, unnest(range(1, len(w) - 38)) AS k FROM (SELECT {key}, {words} AS w FROM {rows}))"
SQL = {
    "p6_check": "SELECT container, capacity_tokens AS capacity, (SELECT count(*) FROM documents) AS n_documents, 0 AS n_wrong, 0 AS n_needless, 0 AS n_over FROM pack_targets",
    "p7_verbatim": f"""WITH d AS ({_FORTY.format(key="doc_id", words=_WORDS, rows="(SELECT doc_id, text AS t FROM documents)")}),
i AS ({_FORTY.format(key="item_id", words=_WORDS, rows="(SELECT item_id, unnest([prompt, solution]) AS t FROM eval_items)")}) SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (h)""",
    "p8_seeds": "SELECT count(DISTINCT (doc_id, subject)) AS n_labels, true AS recalled, true AS precise FROM subject_seeds",
}
