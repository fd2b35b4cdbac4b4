"""Queries of matching, reconciliation and plan comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import matching, slicing, wer
from ..session import table
from .interval_plans import _GRID, _GRID_ROWS, _PACKED
from .registry import Registry
from .text_plans import _GRAMS, _LEVEL, TURNS, shared_sql, turns

registry = Registry()


@registry.query(
    "claimed_turns",
    f"WITH RECURSIVE {TURNS}, "
    + f"""q AS (SELECT DISTINCT uniq_id, request_id FROM transcribed_segments), g AS (SELECT q.request_id AS meeting, CAST(turn_index AS VARCHAR) AS gold, regexp_extract_all(lower(said), '[a-z0-9]+') AS a FROM t JOIN q USING (uniq_id) WHERE said IS NOT NULL),
    p AS (SELECT request_id AS meeting, seg_ord AS pred, regexp_extract_all(lower(min(text)), '[a-z0-9]+') AS b FROM transcribed_segments WHERE text IS NOT NULL GROUP BY request_id, seg_ord),
    f AS (SELECT meeting, gold, pred, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE CAST(2.0 * {shared_sql('a', 'b')} AS DOUBLE) / (len(a) + len(b)) END AS f1 FROM g JOIN p USING (meeting)), c AS (SELECT * FROM f WHERE f1 >= 0.3),
    r AS (SELECT meeting, []::VARCHAR[] AS golds, []::INT[] AS preds, 0::BIGINT AS n, 0.0::DOUBLE AS total FROM c GROUP BY meeting
      UNION ALL SELECT r.meeting, list_append(golds, x.gold), list_append(preds, x.pred), n + 1, total + x.f1 FROM r, LATERAL (SELECT gold, pred, f1 FROM c WHERE c.meeting = r.meeting AND NOT list_contains(r.golds, c.gold) AND NOT list_contains(r.preds, c.pred) ORDER BY f1 DESC, gold, pred LIMIT 1) x)
    SELECT meeting, max(n) AS claims, round(arg_max(total, n) / max(n), 6) AS f1 FROM r GROUP BY meeting""",
)
def claimed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of each request claim turns of its dialogue by token F1, from the reference's
    0.3 on (greedy; tested)."""
    segments = table(spark, sf_dir, "transcribed_segments")
    asked = segments.select("uniq_id", F.col("request_id").alias("meeting")).distinct()
    gold = turns(spark, sf_dir).where("said is not null").join(asked, "uniq_id").select(
        "meeting", F.col("turn_index").cast("string").alias("gold"), text.ascii_tokens(F.col("said")).alias("tokens"),
    )
    predicted = segments.where("text is not null").groupBy(
        F.col("request_id").alias("meeting"), F.col("seg_ord").alias("pred"),
    ).agg(text.ascii_tokens(F.min("text")).alias("tokens"))
    claims = matching.greedy_claims(gold, predicted)
    return claims.groupBy("meeting").agg(F.count(F.lit(1)).alias("claims"), F.round(F.avg("f1"), 6).alias("f1"))


@registry.query(
    "reconciled_turns",
    """WITH a AS (SELECT uniq_id, turn_index, count(*) AS planned FROM runtime_turns GROUP BY ALL), b AS (SELECT uniq_id, turn_index, count(*) AS done FROM score_turns GROUP BY ALL)
    SELECT uniq_id, turn_index, coalesce(planned, 0) AS planned, coalesce(done, 0) AS done, CASE WHEN planned IS NULL THEN 'unplanned' WHEN done IS NULL THEN 'missing' WHEN done > planned THEN 'repeated' ELSE 'complete' END AS state FROM a FULL JOIN b USING (uniq_id, turn_index)""",
)
def reconciled_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.reconciled(table(spark, sf_dir, "runtime_turns"), table(spark, sf_dir, "score_turns"), ["uniq_id", "turn_index"])


@registry.query(
    "positional_pairs",
    f"""WITH {TURNS}, a AS (SELECT uniq_id, row_number() OVER (PARTITION BY uniq_id ORDER BY turn_index) - 1 AS place, turn_index FROM t), r AS (SELECT DISTINCT uniq_id, turn_index FROM runtime_turns WHERE end_s > start_s),
    b AS (SELECT uniq_id, row_number() OVER (PARTITION BY uniq_id ORDER BY turn_index) - 1 AS place, turn_index FROM r)
    SELECT uniq_id, CAST(place AS INT) AS place, a.turn_index AS said, b.turn_index AS timed FROM a FULL JOIN b USING (uniq_id, place)""",
)
def positional_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = table(spark, sf_dir, "runtime_turns").where("end_s > start_s").select("uniq_id", "turn_index").distinct()
    rows = matching.positional(turns(spark, sf_dir).select("uniq_id", "turn_index"), timed, "uniq_id", "turn_index")
    return rows.select("uniq_id", "place", F.col("a.turn_index").alias("said"), F.col("b.turn_index").alias("timed"))


@registry.query(
    "changed_slices",
    f"WITH RECURSIVE {_PACKED}, {_GRID}, gr AS ({_GRID_ROWS}) SELECT coalesce(ps.uniq_id, gr.uniq_id) AS uniq_id, count(*) FILTER (WHERE ps.start_ms IS DISTINCT FROM gr.start_ms OR ps.end_ms IS DISTINCT FROM gr.end_ms) AS changed, "
    "count(*) AS places FROM ps FULL JOIN gr ON gr.uniq_id = ps.uniq_id AND gr.slice_no = ps.slice_no GROUP BY 1",
)
def changed_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places at which packed slices and the pause grid of a dialogue differ."""
    rows = table(spark, sf_dir, "runtime_turns")
    return matching.changed_positions(slicing.turn_slices(rows), slicing.pause_grid(rows), "uniq_id", "slice_no", ["start_ms", "end_ms"])


@registry.query(
    "token_budget",
    """WITH r AS (SELECT request_id, source_name, completion_tokens, sum(coalesce(completion_tokens, 0)) OVER w AS spent FROM parse_results WINDOW w AS (PARTITION BY source_name ORDER BY recorded_utc, request_id ROWS UNBOUNDED PRECEDING))
    SELECT request_id, source_name, CAST(spent AS BIGINT) AS spent, spent <= 4000 AS allowed FROM r""",
)
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching.within_budget(
        table(spark, sf_dir, "parse_results"), ["source_name"], ["recorded_utc", "request_id"], "completion_tokens", 4_000,
    )
    return rows.select("request_id", "source_name", "spent", "allowed")


@registry.query(
    "rotated_requests",
    """WITH i AS (SELECT DISTINCT uniq_id FROM runtime_dialogues WHERE uniq_id IS NOT NULL), a AS (SELECT * FROM (VALUES (0, 'A-grid'), (1, 'A-free'), (2, 'A-turn')) v(n, arm))
    SELECT uniq_id, arm, CAST((n - ('0x' || substr(md5(uniq_id), 1, 6))::BIGINT % 3 + 3) % 3 AS INT) AS turn FROM i, a""",
)
def rotated_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.rotated_requests(
        table(spark, sf_dir, "runtime_dialogues").where("uniq_id is not null"), "uniq_id", ["A-grid", "A-free", "A-turn"],
    )


@registry.query(
    "relisted_rows",
    """WITH a AS (SELECT file_id, split_name, count(*) AS n_a FROM earnings22_inputs WHERE manifest_batch <= 5 GROUP BY ALL), b AS (SELECT file_id, split_name, count(*) AS n_b FROM earnings22_inputs WHERE manifest_batch > 5 GROUP BY ALL)
    SELECT coalesce(a.file_id, b.file_id) AS file_id, coalesce(a.split_name, b.split_name) AS split_name, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM a FULL JOIN b ON a.file_id IS NOT DISTINCT FROM b.file_id AND a.split_name IS NOT DISTINCT FROM b.split_name WHERE coalesce(n_a, 0) <> coalesce(n_b, 0)""",
)
def relisted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "earnings22_inputs")
    half = lambda c: rows.where(c).select("file_id", "split_name")
    return matching.same_rows(half("manifest_batch <= 5"), half("manifest_batch > 5"))


@registry.query(
    "term_kinds",
    f"WITH {TURNS}"
    + r""", k AS (SELECT uniq_id, regexp_extract_all(regexp_replace(said, '\{[^}]*\}', ' ', 'g'), '[\p{L}\p{N}][\p{L}\p{N}''\-]*|[.!?]') AS w FROM t WHERE said IS NOT NULL),
    f AS (SELECT uniq_id, w, unnest(range(1, len(w) + 1)) AS i FROM k),
    g AS (SELECT uniq_id, w[i] AS surface, regexp_full_match(w[i], '\p{Lu}{2,}') OR (regexp_matches(w[i], '\p{L}') AND regexp_matches(w[i], '\p{N}')) AS strict,
      regexp_full_match(w[i], '\p{Lu}\p{Ll}{2,}') AND i > 1 AND w[i - 1] NOT IN ('.', '!', '?') AS name FROM f)
    SELECT uniq_id, surface, CASE WHEN bool_or(strict) THEN 'strict' ELSE 'name_like' END AS kind, count(*) AS n FROM g WHERE strict OR name GROUP BY ALL""",
)
def term_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acronyms, codes and names inside sentences, per dialogue (tested on fixtures)."""
    return text.term_kinds(turns(spark, sf_dir), ["uniq_id"], "said")


def _spoken_sql() -> str:
    """The steps of the spoken form, from the same fixed values."""
    quote = lambda x: x.replace("'", "''")
    out = "(' ' || replace(CASE WHEN regexp_matches(text, '[A-Za-z]') AND upper(text) = text THEN lower(text) ELSE text END, '’', QQ) || ' ')"
    out = rf"regexp_replace(regexp_replace({out}, '\sO''\s', ' O ', 'g'), '\so''\s', ' o ', 'g')"
    for _ in range(2):
        for pattern, full in text.contraction_steps():
            out = f"regexp_replace({out}, '{quote(pattern)}', '{quote(full.replace('$', chr(92)))}', 'g')"
    out = f"regexp_replace({out}, '{quote(text._PUNCTUATION_CLASS)}', ' ', 'g')"
    return out.replace("QQ", chr(39) * 4)


@registry.query(
    "spoken_forms",
    rf"""WITH s AS (SELECT delivery_id, list_filter(string_split_regex(regexp_replace({_spoken_sql()}, '[-'']', ' ', 'g'), '\s+'), lambda w: w <> '') AS w FROM direction_scores WHERE text IS NOT NULL)
    SELECT delivery_id, lower(array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i = 1 OR (regexp_full_match(w[i], '\p{{L}}s?') AND regexp_full_match(w[i - 1], '\p{{L}}s?')) THEN w[i] ELSE ' ' || w[i] END), '')) AS form FROM s""",
)
def spoken_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spoken form of every response with text."""
    rows = table(spark, sf_dir, "direction_scores").where("text is not null")
    return rows.select("delivery_id", text.spoken_form(F.col("text")).alias("form"))


def _ngram_sql() -> str:
    from .score_plans import _KEPT

    grams = lambda x, n: _GRAMS.replace("$n", str(n)).replace("$", x)
    f1 = lambda x, y: f"coalesce(2.0 * {shared_sql(x, y)} / nullif(len({x}) + len({y}), 0), 0.0)"
    return (
        _KEPT.replace("WITH ", "WITH RECURSIVE ", 1)
        + ", w AS (SELECT target_id, arm, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM m1), q AS (SELECT x.target_id AS uniq_id, 0 AS turn_index, x.w AS a, y.w AS b FROM w x JOIN w y ON x.target_id = y.target_id WHERE x.arm = 'd0-global' AND y.arm = 'd1-speaker' AND x.w IS NOT NULL AND y.w IS NOT NULL), "
        + _LEVEL.replace("d AS", "dd AS").replace("FROM d ", "FROM dd ")
        + f", z AS (SELECT *, {grams('a', 2)} AS a2, {grams('b', 2)} AS b2 FROM dd WHERE i = len(a))"
        + f" SELECT uniq_id AS target_id, round({f1('a', 'b')}, 6) AS f1_1, round({f1('a2', 'b2')}, 6) AS f1_2, round(coalesce(2.0 * c[len(c)] / nullif(len(a) + len(b), 0), 0.0), 6) AS f1_l FROM z"
    )


@registry.query("ngram_f1", _ngram_sql())
def ngram_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram, bigram and longest-subsequence F1 of the two arms' responses to a target."""
    from .score_plans import ARMS, messages

    rows = messages(spark, sf_dir).select("target_id", "arm", text.ascii_tokens(F.col("text")).alias("w"))
    side = lambda arm, name: rows.where(F.col("arm") == arm).select("target_id", F.col("w").alias(name))
    both = side(ARMS[0], "a").join(side(ARMS[1], "b"), "target_id").where("a is not null and b is not null")
    a, b = F.col("a"), F.col("b")
    longest = F.coalesce(F.try_divide(2.0 * text.lcs_length(a, b), F.size(a) + F.size(b)), F.lit(0.0))
    return both.select(
        "target_id", F.round(matching.overlap_f1(a, b), 6).alias("f1_1"),
        F.round(matching.overlap_f1(wer.ngrams(a, 2), wer.ngrams(b, 2)), 6).alias("f1_2"), F.round(longest, 6).alias("f1_l"),
    )


@registry.query(
    "prompt_blocks",
    """WITH o AS (SELECT uniq_id, speaker_no, display_name FROM speaker_roster WHERE display_name IS NOT NULL), r AS (SELECT *, sum(length(display_name) + 1) OVER (PARTITION BY uniq_id ORDER BY speaker_no ROWS UNBOUNDED PRECEDING) AS upto FROM o)
    SELECT uniq_id, string_agg(display_name, chr(10) ORDER BY speaker_no) AS block, count(*) AS n_lines FROM r WHERE ceil((upto - 1) / 4.0) <= 12 GROUP BY uniq_id""",
)
def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of each roster, in order, as far as twelve tokens go."""
    return matching.capped_block(table(spark, sf_dir, "speaker_roster"), "uniq_id", ["speaker_no"], "display_name", 12)


_ROLES = "n AS (SELECT uniq_id, list_distinct(list(lower(role_title))) AS needles FROM speaker_roster WHERE role_title IS NOT NULL GROUP BY uniq_id)"


@registry.query("fuzzy_roles")
def fuzzy_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles and names of a dialogue's roster that its replies name, words a few edits off too
    (a cursor over windows is no SQL; compared with brute force in tests)."""
    roster = table(spark, sf_dir, "speaker_roster").select(
        "uniq_id", F.explode(F.array_compact(F.array(F.lower("role_title"), F.lower("display_name")))).alias("needle"),
    )
    needles = roster.groupBy("uniq_id").agg(F.array_sort(F.collect_set("needle")).alias("needles"))
    replies = table(spark, sf_dir, "parse_results").where("raw_text is not null").select(
        "request_id", "uniq_id", text.ascii_tokens(F.col("raw_text")).alias("w"),
    )
    return replies.join(needles, "uniq_id", "left").select(
        "request_id", F.array_join(matching.fuzzy_matches("w", "needles"), "|").alias("found"),
    )


@registry.query(
    "response_gaps",
    """SELECT request_id, CAST(abs(coalesce(n_segments, 0) - len(list_filter(string_split_regex(raw_text, '\\r\\n|\\n|\\r'), lambda x: trim(x) <> ''))) AS INT) AS gap,
      abs(coalesce(n_segments, 0) - len(list_filter(string_split_regex(raw_text, '\\r\\n|\\n|\\r'), lambda x: trim(x) <> ''))) > 0 AS diverges FROM parse_results WHERE raw_text IS NOT NULL""",
)
def response_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two counts of each reply's segments, the recorded one and that of its lines."""
    rows = table(spark, sf_dir, "parse_results").where("raw_text is not null")
    told = rows.select("request_id", F.coalesce("n_segments", F.lit(0)).alias("v"))
    seen = rows.select("request_id", F.size(F.filter(F.split("raw_text", r"\r\n|\n|\r"), lambda x: F.trim(x) != "")).alias("v"))
    gaps = matching.scorer_gaps(told, seen, "request_id", "v", 0.0)
    return gaps.select("request_id", F.abs("gap").cast("int").alias("gap"), "diverges")


@registry.query(
    "best_alternatives",
    f"""WITH {TURNS}, g AS (SELECT uniq_id, list(regexp_extract_all(lower(said), '[a-z0-9]+')) AS golds FROM t WHERE said IS NOT NULL AND turn_index < 5 GROUP BY uniq_id),
    p AS (SELECT p.request_id, regexp_extract_all(lower(p.raw_text), '[a-z0-9]+') AS w, coalesce(g.golds, []) AS golds FROM parse_results p LEFT JOIN g USING (uniq_id) WHERE p.raw_text IS NOT NULL),
    e AS (SELECT request_id, w AS b, unnest(CASE WHEN len(golds) > 0 THEN golds ELSE [[]] END) AS a FROM p),
    f AS (SELECT request_id, CASE WHEN len(a) + len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 2.0 * {shared_sql('a', 'b')} / (len(a) + len(b)) END AS f1, CASE WHEN a = b THEN 1 ELSE 0 END AS exact FROM e)
    SELECT request_id, round(max(f1), 6) AS f1, CAST(max(exact) AS INT) AS exact FROM f GROUP BY request_id""",
)
def best_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reply against the first turns of its dialogue as alternatives: best F1 and match."""
    said = turns(spark, sf_dir).where("said is not null and turn_index < 5")
    golds = said.groupBy("uniq_id").agg(F.collect_list(text.ascii_tokens(F.col("said"))).alias("golds"))
    rows = table(spark, sf_dir, "parse_results").where("raw_text is not null").join(golds, "uniq_id", "left")
    rows = rows.select(
        "request_id", text.ascii_tokens(F.col("raw_text")).alias("w"),
        F.coalesce("golds", F.array().cast("array<array<string>>")).alias("golds"),
    )
    return matching.best_alternative(rows, "w", "golds").select("request_id", F.round("f1", 6).alias("f1"), "exact")


@registry.query(
    "legal_log",
    """WITH l AS (SELECT file_id, file_path, manifest_batch, lag(file_path) OVER (PARTITION BY file_id ORDER BY manifest_batch, file_path) AS before FROM (SELECT DISTINCT file_id, file_path, manifest_batch FROM earnings22_inputs WHERE file_id IS NOT NULL))
    SELECT file_id, manifest_batch, file_path AS entry, before FROM l WHERE before IS NOT NULL AND before <> file_path""",
)
def legal_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of a file as a log whose links should repeat the path before: the broken ones."""
    from ..operators import carry

    rows = table(spark, sf_dir, "earnings22_inputs").where("file_id is not null").select(
        "file_id", "manifest_batch", F.col("file_path").alias("entry"),
    ).distinct()
    log = rows.withColumn("seq", F.struct("manifest_batch", "entry")).withColumn("previous", F.col("entry"))
    first = log.groupBy("file_id").agg(F.min("seq").alias("seq"))
    # the first entry has nothing before it
    log = log.join(first.withColumn("_first", F.lit(True)), ["file_id", "seq"], "left").withColumn(
        "previous", F.when(F.col("_first"), F.lit(None)).otherwise(F.col("entry")),
    ).drop("_first")
    broken = carry.broken_links(log, "file_id", "seq")
    from pyspark.sql import Window

    before = F.lag("entry").over(Window.partitionBy("file_id").orderBy("seq"))
    named = log.select("file_id", "manifest_batch", "entry", before.alias("before"))
    return named.join(broken.select("file_id", "manifest_batch", "entry"), ["file_id", "manifest_batch", "entry"], "left_semi")


_HEADS = ("TERMS", "SPEAKERS")
_EMPTY = ("(no terms)", "(no speakers)")


def _supply_sql() -> str:
    from .carry_plans import _UNITS

    body = "CASE WHEN {n} > 0 THEN array_to_string(list_slice({l}, 1, {n}), chr(10)) ELSE '{e}' END"
    text_ = (
        f"'{_HEADS[0]}' || chr(10) || " + body.format(n="x.g", l="gl", e=_EMPTY[0]) + f" || chr(10) || chr(10) || '{_HEADS[1]}' || chr(10) || " + body.format(n="x.s", l="sp", e=_EMPTY[1])
    )
    return (
        _UNITS
        + f""", k AS (SELECT meeting, surface, count(*) AS evidence, min(position) AS first_seen FROM u GROUP BY ALL),
    g AS (SELECT meeting AS uniq_id, list_slice(list('- ' || surface ORDER BY evidence DESC, first_seen, surface), 1, 8) AS gl FROM k GROUP BY meeting),
    s AS (SELECT uniq_id, list('Speaker ' || speaker_no || ' - ' || display_name ORDER BY speaker_no) AS sp FROM speaker_roster WHERE display_name IS NOT NULL AND speaker_no IS NOT NULL GROUP BY uniq_id),
    b AS (SELECT coalesce(g.uniq_id, s.uniq_id) AS uniq_id, coalesce(gl, []) AS gl, coalesce(sp, []) AS sp FROM g FULL JOIN s ON g.uniq_id = s.uniq_id),
    c AS (SELECT uniq_id, gl, sp, unnest(list_concat(list_transform(range(len(sp), -1, -1), lambda n: {{'g': len(gl), 's': n}}), list_transform(range(len(gl) - 1, -1, -1), lambda n: {{'g': n, 's': 0::BIGINT}}))) AS x FROM b),
    tx AS (SELECT uniq_id, x, {text_} AS text FROM c)
    SELECT uniq_id, arg_min(text, (ceil(length(text) / 4.0) > 40, -x.g, -x.s)) AS text, CAST(arg_min(x.g, (ceil(length(text) / 4.0) > 40, -x.g, -x.s)) AS INT) AS n_first, CAST(arg_min(x.s, (ceil(length(text) / 4.0) > 40, -x.g, -x.s)) AS INT) AS n_second,
      CAST(ceil(length(arg_min(text, (ceil(length(text) / 4.0) > 40, -x.g, -x.s))) / 4.0) AS BIGINT) AS tokens FROM tx GROUP BY uniq_id"""
    )


@registry.query("supply_blocks", _supply_sql())
def supply_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best terms and the roster of each dialogue as a block of at most forty tokens: speakers
    go first, then terms."""
    from ..operators import carry
    from .carry_plans import units

    ranked = carry.ranked_terms(units(spark, sf_dir), 8)
    terms = ranked.groupBy(F.col("meeting").alias("uniq_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "surface"))).alias("r"))
    terms = terms.select("uniq_id", F.transform("r", lambda x: F.concat(F.lit("- "), x["surface"])).alias("gl"))
    named = table(spark, sf_dir, "speaker_roster").where("display_name is not null and speaker_no is not null")
    line = F.concat(F.lit("Speaker "), F.col("speaker_no").cast("string"), F.lit(" - "), F.col("display_name"))
    people = named.groupBy("uniq_id").agg(
        F.array_sort(F.collect_list(F.struct("speaker_no", line.alias("l")))).alias("r")
    ).select("uniq_id", F.transform("r", lambda x: x["l"]).alias("sp"))
    rows = terms.join(people, "uniq_id", "full")
    return rows.select(
        "uniq_id", matching.trimmed_sections(F.col("gl"), F.col("sp"), _HEADS, _EMPTY, 40).alias("x"),
    ).select("uniq_id", "x.*")
