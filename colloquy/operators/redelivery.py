"""Exactly one row per message of an at-least-once delivery log.

Identifiers are screened by Bloom filters, one per time bucket of delivery: an identifier
that no other bucket's filter holds, delivered in one bucket only, is definitely not
repeated across buckets. The rest, true repeats and false positives alike, is verified
exactly against the stored identifiers of only the buckets whose filters matched.

The filters are blocked: an identifier has one 64-bit word and four bits in it, so a filter
is a table (word, bucket, bits) built by ``bit_or`` with map-side combine and probed by a
join on the word; nothing is broadcast or collected, whatever the number of identifiers.
Copies are aggregated per (identifier, bucket) before anything else, so a message that
arrived in a third of all rows is one row a bucket. They are stored in the shared folder,
partitioned by bucket: the exact check reads only partitions that some filter matched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored_table

#: Identifiers that share a word of the filter, on average.
IDS_PER_WORD = 5


def bloom_word(words: int, *ids: Column) -> Column:
    """The word of an identifier among ``words``."""
    return F.pmod(F.xxhash64(F.lit(7), *ids), F.lit(words).cast("long"))


def bloom_bits(*ids: Column) -> Column:
    """Four bits (some may coincide) in a word of 64."""
    digest = F.xxhash64(F.lit(11), *ids)
    bits = F.lit(0).cast("long")
    for shift in (0, 12, 24, 36):
        place = F.shiftrightunsigned(digest, shift).bitwiseAND(F.lit(63).cast("long")).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return bits


def time_bucket(at: Column, days: int) -> Column:
    """Number of the bucket of ``days`` days; rows without a time share the bucket -1."""
    return F.coalesce(F.floor(F.unix_seconds(at) / (86_400 * days)).cast("long"), F.lit(-1).cast("long"))


def message_buckets(df: DataFrame, ids: Sequence[Column], at: Column, order: Sequence[Column], days: int = 30) -> DataFrame:
    """Copies per message and bucket: ids ``_id0``.., ``_bucket``, ``_copies`` and the least
    ``order`` struct as ``_first``."""
    names = [f"_id{i}" for i in range(len(ids))]
    return (
        df.select(*[c.alias(n) for c, n in zip(ids, names)], time_bucket(at, days).alias("_bucket"), F.struct(*order).alias("_o"))
        .groupBy(*names, "_bucket")
        .agg(F.count(F.lit(1)).alias("_copies"), F.min("_o").alias("_first"))
    )


def message_counts(df: DataFrame, ids: Sequence[Column], at: Column, order: Sequence[Column], days: int = 30) -> DataFrame:
    """One row per message: ids ``_id0``.., ``_copies`` in all, ``_buckets`` and ``_first``,
    the least ``order`` struct of its copies. Null identifiers compare as equal. ``order``
    must be orderable and should end in a unique column, so that ties cannot occur."""
    names = [f"_id{i}" for i in range(len(ids))]
    stored = stored_table(message_buckets(df, ids, at, order, days), "redelivery", ["_bucket"])
    words = max(1, stored.count() // IDS_PER_WORD)
    key = [F.col(n) for n in names]
    stored = stored.withColumn("_word", bloom_word(words, *key)).withColumn("_bits", bloom_bits(*key))
    filters = (
        stored.groupBy("_word", "_bucket").agg(F.bit_or("_bits").alias("_bits"))
        .groupBy("_word").agg(F.collect_list(F.struct(F.col("_bucket").alias("b"), F.col("_bits").alias("m"))).alias("_filters"))
    )
    matches = F.transform(
        F.filter("_filters", lambda f: (f["b"] != F.col("_bucket")) & (f["m"].bitwiseAND(F.col("_bits")) == F.col("_bits"))), lambda f: f["b"]
    )
    screened = stored.join(filters, "_word").withColumn("_match", matches).drop("_filters", "_bits", "_word")
    new = screened.where(F.size("_match") == 0)
    possible = screened.where(F.size("_match") > 0)
    # Exact check: of a possible repeat, only the stored ids of the buckets that matched.
    asked = possible.select(*names, F.explode("_match").alias("_bucket")).distinct()
    same = F.lit(True)
    renamed = asked.select(*[F.col(n).alias(f"{n}_a") for n in names], F.col("_bucket").alias("_bucket_a"))
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}_a"))
    found = stored.drop("_word", "_bits").join(renamed, same & (F.col("_bucket") == F.col("_bucket_a")), "left_semi")
    columns = [*names, "_bucket", "_copies", "_first"]
    # A row found in a matching bucket is itself a possible repeat of its partner there, so
    # the rows of one message are either all among the found ones or it has just one row.
    verified = possible.select(*columns).unionByName(found.select(*columns)).groupBy(*names, "_bucket").agg(
        F.max("_copies").alias("_copies"), F.min("_first").alias("_first"),
    )
    verified = verified.groupBy(*names).agg(
        F.sum("_copies").alias("_copies"), F.count(F.lit(1)).alias("_buckets"), F.min("_first").alias("_first"),
    )
    return new.select(*names, "_copies", F.lit(1).cast("long").alias("_buckets"), "_first").unionByName(verified)


def normal_id(x: Column) -> Column:
    """Identifiers compare without letter case and surrounding white space."""
    return F.lower(F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def messages(scores: DataFrame, days: int = 30) -> DataFrame:
    """Messages of direction_scores: target_id, arm, copies, buckets, delivery_id of the copy
    that is kept, the first delivered (then the least delivery_id; copies without a time come
    last). A message is a row with outcome ``ok`` and a target_id that is not blank; a null
    arm is an arm of its own. Empty in, empty out; repeated rows are copies."""
    ok = scores.where((F.col("outcome") == "ok") & (normal_id(F.col("target_id")) != ""))
    order = [F.col("delivered_at").isNull().alias("late"), F.col("delivered_at").alias("at"), F.col("delivery_id").alias("id")]
    counts = message_counts(ok, [normal_id(F.col("target_id")), normal_id(F.col("arm"))], F.col("delivered_at"), order, days)
    return counts.select(
        F.col("_id0").alias("target_id"), F.col("_id1").alias("arm"), F.col("_copies").alias("copies"), F.col("_buckets").alias("buckets"), F.col("_first.id").alias("delivery_id")
    )


def one_row_per_message(scores: DataFrame, days: int = 30) -> DataFrame:
    """The rows of ``scores`` that are kept, with all their columns."""
    kept = messages(scores, days).select(F.col("delivery_id").alias("_kept"))
    return scores.join(kept, F.col("delivery_id") == F.col("_kept"), "left_semi")
