"""Mixes of sources to target weights, cut at exact token budgets.

Documents get a hash-random key and are sorted by it within their source. The prefix sums
of token counts are distributed: a source is cut into key ranges (buckets), the sums of
the buckets are summed up over the short table (source, bucket), and each bucket sums its
own documents from there. A source with a third of the corpus is as many buckets as its
documents need, so no task and no window holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .bpe import VOCABULARIES, token_count

#: Documents a bucket of a source holds on average.
BUCKET_DOCS = 2_000
#: Parts that a source's documents are joined in.
SLICES = 64
_KEYS = 1 << 62


def random_key(seed: int, *ids: Column) -> Column:
    """A number in 0 .. 2**62 - 1, the same for the same ids wherever it is computed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), *ids), 2)


def sized(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """doc_id, source and tokens of each document."""
    return documents.select("doc_id", "source", token_count(F.col("text"), tokenizer, folder).alias("tokens"))


def prefix_sums(docs: DataFrame, seed: int = 0, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """Adds ``upto``, the tokens of the documents of the source up to and with this one in
    hash order (ties by doc_id), and ``source_tokens``. ``docs`` has doc_id, source and
    tokens and is read three times: materialise it before."""
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("source_tokens"))
    sizes = sizes.withColumn("buckets", F.ceil(F.col("n") / bucket_docs).cast("long"))
    # One row a source: sources are names of collections, but their number has no proven
    # bound, so Spark decides by size whether to broadcast.
    # The join is on (source, slice of the key), so that the largest source is many tasks if it
    # is none.
    slices = F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))
    sizes = sizes.drop("n").withColumnRenamed("source", "_s").withColumn("_slice", slices)
    keyed = docs.withColumn("key", random_key(seed, F.col("doc_id")))
    keyed = keyed.join(
        sizes, keyed["source"].eqNullSafe(F.col("_s")) & (F.pmod("key", F.lit(SLICES)) == F.col("_slice")),
    ).drop("_s", "_slice")
    keyed = keyed.withColumn("bucket", F.floor(F.col("key") / (F.lit(_KEYS) / F.col("buckets"))).cast("long"))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("tokens").alias("t"))
    # The table (source, bucket) is smaller than the corpus by BUCKET_DOCS.
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("t").over(order), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    joined = keyed.join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return joined.select("doc_id", "source", "tokens", (F.col("base") + F.sum("tokens").over(within)).alias("upto"), "source_tokens")


def budgets(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: mix_name, source, target_share, max_repeats, ``corpus_tokens``,
    ``source_tokens``, ``budget`` and ``whole`` (uses that every document of the source has)
    and ``rest`` (tokens of one more use).

    The budget is size_ratio * corpus * share, but never more than max_repeats times the
    source. What a source cannot give is not given to others: their shares stay as asked.
    """
    totals = docs.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    corpus = docs.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("corpus_tokens"))
    t = targets.join(totals, targets["source_name"] == totals["source"], "left").crossJoin(F.broadcast(corpus))  # one row
    own = F.coalesce(F.col("source_tokens"), F.lit(0))
    asked = F.floor(F.col("size_ratio") * F.col("corpus_tokens") * F.col("target_share")).cast("long")
    budget = F.when(
        own > 0, F.least(asked, own * F.greatest(F.coalesce(F.col("max_repeats"), F.lit(0)), F.lit(0))),
    ).otherwise(F.lit(0)).cast("long")
    return (
        t.select(
            "mix_name", F.col("source_name").alias("source"), "size_ratio", "target_share", "max_repeats", "corpus_tokens",
            own.alias("source_tokens"), asked.alias("asked"), budget.alias("budget"),
        )
        .withColumn(
            "whole", F.when(F.col("source_tokens") > 0, F.floor(F.col("budget") / F.col("source_tokens"))).otherwise(F.lit(0)).cast("int"),
        )
        .withColumn("rest", F.col("budget") - F.col("whole") * F.col("source_tokens"))
    )


def mixed(
    documents: DataFrame, targets: DataFrame, seed: int = 0, tokenizer: str = "byte_bpe_50k", folder: str = VOCABULARIES,
) -> DataFrame:
    """Documents of each mix: mix_name, doc_id, source, tokens, repeats (1 or more).

    Sources are whole epochs (all documents so many times) and the head, in hash order, of
    one more, cut where the next document would pass the budget; documents of no tokens
    come in with the head they stand in. Sources without a target, a null source and a
    share of zero give nothing; an empty corpus gives an empty mix.
    """
    docs = cut_lineage(sized(documents, tokenizer, folder))
    # One row per mix and source: the fixed table of targets, a few rows a mix.
    plan = budgets(docs, targets).where(F.col("budget") > 0).select("mix_name", F.col("source").alias("s"), "whole", "rest")
    rows = prefix_sums(docs, seed).join(plan, F.col("source") == F.col("s"))
    repeats = F.col("whole") + (F.col("upto") <= F.col("rest")).cast("int")
    return rows.select("mix_name", "doc_id", "source", "tokens", repeats.alias("repeats")).where(F.col("repeats") > 0)


def mix_report(
    documents: DataFrame, targets: DataFrame, seed: int = 0, tokenizer: str = "byte_bpe_50k", folder: str = VOCABULARIES,
) -> DataFrame:
    """Per mix and target: asked and actual tokens, target and actual share, documents used,
    most repeats, and ``short`` where max_repeats or missing documents leave tokens undone."""
    docs = cut_lineage(sized(documents, tokenizer, folder))
    plan = budgets(docs, targets)
    head = prefix_sums(docs, seed).select(F.col("source").alias("s"), "tokens", "upto")
    cut = head.join(plan, F.col("source") == F.col("s")).groupBy("mix_name", "source").agg(
        F.coalesce(F.sum(F.when(F.col("upto") <= F.col("rest"), F.col("tokens"))), F.lit(0)).alias("head_tokens"),
        F.sum(F.when((F.col("upto") <= F.col("rest")) | (F.col("whole") > 0), 1).otherwise(0)).alias("docs"),
        F.max(F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)).alias("more"),
    )
    rows = plan.join(cut, ["mix_name", "source"], "left")
    actual = F.col("whole") * F.col("source_tokens") + F.coalesce(F.col("head_tokens"), F.lit(0))
    rows = rows.withColumn("tokens", F.when(F.col("budget") > 0, actual).otherwise(F.lit(0)).cast("long"))
    share = F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(Window.partitionBy("mix_name")))
    used = F.when(F.col("budget") > 0, F.coalesce(F.col("docs"), F.lit(0))).otherwise(F.lit(0)).cast("long")
    most = F.when(F.col("budget") > 0, F.col("whole") + F.coalesce(F.col("more"), F.lit(0))).otherwise(F.lit(0)).cast("int")
    return rows.select(
        "mix_name", "source", "target_share", F.round(share, 6).alias("actual_share"), F.col("asked").alias("asked_tokens"),
        F.col("tokens").alias("actual_tokens"),
        used.alias("docs"), most.alias("most_repeats"), (F.col("budget") < F.col("asked")).alias("short"),
    )
