"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import bpe, epochs, mixing, residue, splitting, transcripts, truncation


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(
        table(spark, sf_dir, "parse_results"), table(spark, sf_dir, "direction_scores"),
    ).select("record_kind", "record_id")


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, sf_dir, "parse_results"), table(spark, sf_dir, "direction_scores"))


def _turns(spark: SparkSession, sf_dir: str, texts: bool) -> DataFrame:
    return transcripts.transcript_turns(
        *(table(spark, sf_dir, t) for t in ("transcribed_segments", "score_turns", "speaker_roster")), texts=texts,
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir, False)


def p3_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir, True)


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(*(table(spark, sf_dir, t) for t in ("runtime_dialogues", "runtime_turns", "piece_limits")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every oversized item has a piece 0, and one only
    return p4_pieces(spark, sf_dir).where("piece_no = 0").select("profile", "uniq_id", "turn_index")


def p4_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the pieces, which should be nothing, and the items per profile."""
    return splitting.piece_faults(p4_pieces(spark, sf_dir), table(spark, sf_dir, "piece_limits"))


def _store(sf_dir: str, name: str) -> str:
    """The store of a table: one for each data directory."""
    return f"{hashlib.md5(sf_dir.rstrip('/').encode()).hexdigest()}-{name}"


def p6_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epochs.persisted_members(table(spark, sf_dir, "runtime_dialogues"), _store(sf_dir, "dialogues"), "uniq_id", "manifest_batch")


def p6_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epochs.persisted_members(table(spark, sf_dir, "earnings22_inputs"), _store(sf_dir, "inputs"), "file_id", "manifest_batch")


def p6_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First epochs and rates that a fresh store would freeze, of both tables."""
    seen = lambda t, c, k: epochs.first_seen(table(spark, sf_dir, t), c, "manifest_batch").select(F.lit(k).alias("kind"), F.col("id"), F.col("epoch"), F.round("rate", 9).alias("rate"))
    return seen("runtime_dialogues", "uniq_id", "dialogue").unionByName(seen("earnings22_inputs", "file_id", "input"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_corpus(table(spark, sf_dir, "documents"))


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", bpe.token_count(F.col("text")).alias("tokens"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents")).select("doc_id")


def p9_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents")).select("doc_id", F.array_join("reasons", "+").alias("reasons"))


def p9_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.without_residue(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_rates, p3_found, p3_turns, p4_found, p4_pieces, p4_faults, p6_dialogues, p6_inputs, p6_epochs, p7_ids, p7_counts,
        p8_mix, p8_shares, p9_found, p9_reasons, p9_corpus,
    )
}

_OVERSIZED = """
        WITH t AS (SELECT DISTINCT uniq_id, turn_index, start_s, end_s FROM runtime_turns
                   WHERE end_s > start_s AND isfinite(start_s) AND isfinite(end_s)),
        e AS (SELECT uniq_id, max(end_s) AS last_s FROM t GROUP BY uniq_id),
        d AS (SELECT r.uniq_id, greatest(coalesce(max(CASE WHEN isfinite(r.duration) THEN r.duration END), -1), coalesce(max(e.last_s), -1)) AS length
              FROM runtime_dialogues r LEFT JOIN e ON e.uniq_id = r.uniq_id WHERE r.uniq_id IS NOT NULL GROUP BY r.uniq_id)
        SELECT p.profile, d.uniq_id, CAST(-1 AS INT) AS turn_index FROM d JOIN piece_limits p ON floor((d.length - p.max_s) * 1e6 + 1e-3) >= 1
        UNION ALL
        SELECT DISTINCT p.profile, t.uniq_id, t.turn_index FROM t JOIN piece_limits p ON floor((t.end_s - t.start_s - p.max_s) * 1e6 + 1e-3) >= 1
"""
_RATE = "CASE WHEN min(manifest_batch) IS NULL THEN 0.05 ELSE greatest(0.05, 0.2 * power(0.95, greatest(min(manifest_batch), 1) - 1)) END"

ORACLES: dict[str, str] = {
    "p4_found": _OVERSIZED,
    "p4_faults": f"SELECT profile, count(*) AS items, CAST(0 AS BIGINT) AS too_long, CAST(0 AS BIGINT) AS wrong_overlap, CAST(0 AS BIGINT) AS not_advancing, CAST(0 AS BIGINT) AS misnumbered FROM ({_OVERSIZED}) GROUP BY profile",
    "p6_epochs": f"""
        SELECT 'dialogue' AS kind, uniq_id AS id, min(manifest_batch) AS epoch, round({_RATE}, 9) AS rate FROM runtime_dialogues WHERE uniq_id IS NOT NULL GROUP BY uniq_id
        UNION ALL SELECT 'input', file_id, min(manifest_batch), round({_RATE}, 9) FROM earnings22_inputs WHERE file_id IS NOT NULL GROUP BY file_id
    """,
}
