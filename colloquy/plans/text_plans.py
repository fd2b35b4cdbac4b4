"""Queries of text functions and reply grammars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import grammar, text
from ..operators import matching, scoring, speakers, wer
from ..session import table
from .registry import Registry

registry = Registry()

#: White space and word characters in the Unicode sense, for regular expressions of SQL.
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}\x{24B6}-\x{24E9}"
#: Labels of the roster that one speaker only has, and a label's own form.
_FORM = rf"coalesce(lower(trim(regexp_replace(regexp_replace(LABEL, '^[\s<\[>]+|[\s:|>\]]+$', '', 'g'), '{SPACE}+', ' ', 'g'))), '')"
_ROSTER = (
    rf"ro AS (SELECT uniq_id, speaker_no, lower(trim(regexp_replace(display_name, '{SPACE}+', ' ', 'g'))) AS nm, lower(trim(regexp_replace(role_title, '{SPACE}+', ' ', 'g'))) AS rl FROM speaker_roster), "
    "rp AS (SELECT *, split_part(nm, ' ', 1) AS fi, split_part(nm, ' ', -1) AS la FROM ro), "
    "rf AS (SELECT uniq_id, form, min(speaker_no) AS n FROM (SELECT uniq_id, speaker_no, unnest([nm, fi, la, substr(fi, 1, 1) || '. ' || la, la || ', ' || fi, rl]) AS form FROM rp) WHERE form <> '' GROUP BY ALL HAVING min(speaker_no) = max(speaker_no))"
)


def speaker_sql(label: str, rows: str) -> str:
    """Rows of a table with the resolved ``speaker`` of a label, as ``speakers.resolved``."""
    form = _FORM.replace("LABEL", label)
    number = rf"nullif(regexp_extract({form}, '^(?:speaker|spkr?|s)[\s_\-]*0*(\d+)$', 1), '')"
    return f"(SELECT x.*, coalesce('#' || coalesce({number}, CAST(rf.n AS VARCHAR)), {form}) AS speaker FROM {rows} x LEFT JOIN rf ON rf.uniq_id = x.uniq_id AND rf.form = {form})"


#: One row a turn: one delivery as a whole, with text before one without, then the least.
TURNS = (
    f"{_ROSTER}, ls AS {speaker_sql('speaker_id', 'score_turns')}, "
    "tm AS (SELECT uniq_id, turn_index, arg_min({'s': speaker, 'x': reference_text}, (reference_text IS NULL, coalesce(reference_text, ''), NOT starts_with(speaker, '#'), speaker)) AS m FROM ls GROUP BY uniq_id, turn_index), "
    "t AS (SELECT uniq_id, turn_index, m.s AS speaker, m.x AS said FROM tm)"
)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uniq_id, turn_index, speaker (resolved against the roster) and said, one row a turn. Of
    several deliveries one is taken as a whole."""
    rows = speakers.resolved(table(spark, sf_dir, "score_turns"), table(spark, sf_dir, "speaker_roster"), "speaker_id")
    said = F.col("reference_text")
    order = F.struct(
        said.isNull().alias("a"), F.coalesce(said, F.lit("")).alias("said"), (~F.col("speaker").startswith("#")).alias("b"), "speaker",
    )
    return rows.groupBy("uniq_id", "turn_index").agg(F.min(order).alias("_m")).select(
        "uniq_id", "turn_index", "_m.speaker", F.when(~F.col("_m.a"), F.col("_m.said")).alias("said"),
    )


@registry.query(
    "normal_terms",
    """SELECT file_id, file_path, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(file_path)), '[‐‑‒–—−_]', '-', 'g'), '[^\\w\\s\\-]', '', 'g'), '\\s+', ' ', 'g'), '-') AS term
       FROM earnings22_inputs""",
)
def normal_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "earnings22_inputs")
    return rows.select("file_id", "file_path", text.normal_term(F.col("file_path")).alias("term"))


_NUMBERS = ", ".join(f"'{k}': '{v}'" for k, v in text.NUMBER_WORDS.items())


@registry.query(
    "normal_answers",
    rf"""WITH n AS (SELECT delivery_id, regexp_replace(regexp_replace(lower(text), '(\d),(\d\d\d)', '\1\2', 'g'), '(\d),(\d\d\d)', '\1\2', 'g') AS x FROM direction_scores WHERE text IS NOT NULL),
        w AS (SELECT delivery_id, string_split(trim(regexp_replace(regexp_replace(x, '[^{WORD}\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]', ' ', 'g'), '{SPACE}+', ' ', 'g')), ' ') AS w FROM n)
        SELECT delivery_id, array_to_string(list_transform(w, lambda x: coalesce(MAP {{{_NUMBERS}}}[x], x)), ' ') AS answer FROM w""",
)
def normal_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every response with text, in any script."""
    rows = table(spark, sf_dir, "direction_scores").where("text is not null")
    return rows.select("delivery_id", text.normal_answer(F.col("text")).alias("answer"))


_ARTICLE = rf"'(^|[^{WORD}])(?:a|an|the)($|[^{WORD}])', '\1 \2', 'g'"


@registry.query(
    "normal_spans",
    rf"""WITH n AS (SELECT request_id, regexp_replace(lower(regexp_replace(raw_text, 'Speaker [0-9]*: ', '', 'g')), '[!-/:-@\[-`{{-~]', '', 'g') AS x FROM parse_results WHERE raw_text IS NOT NULL)
        SELECT request_id, trim(regexp_replace(regexp_replace(regexp_replace(x, {_ARTICLE}), {_ARTICLE}), '{SPACE}+', ' ', 'g')) AS span FROM n""",
)
def normal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reply with text, in any script."""
    rows = table(spark, sf_dir, "parse_results").where("raw_text is not null")
    return rows.select("request_id", text.normal_span(F.col("raw_text")).alias("span"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir)
    before = F.lag("said").over(Window.partitionBy("uniq_id").orderBy("turn_index"))
    return rows.select(
        "uniq_id", "turn_index", text.ascii_tokens(F.col("said")).alias("a"), text.ascii_tokens(before).alias("b"),
    ).where("a is not null and b is not null")


_NEIGHBOURS = f"""WITH {TURNS}, p AS (SELECT uniq_id, turn_index, said, lag(said) OVER (PARTITION BY uniq_id ORDER BY turn_index) AS before FROM t),
q AS (SELECT uniq_id, turn_index, regexp_extract_all(lower(said), '[a-z0-9]+') AS a, regexp_extract_all(lower(before), '[a-z0-9]+') AS b FROM p WHERE said IS NOT NULL AND before IS NOT NULL)"""


@registry.query(
    "token_f1",
    _NEIGHBOURS
    + """, o AS (SELECT *, list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))) AS n FROM q)
    SELECT uniq_id, turn_index, round(CASE WHEN len(a) + len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 2.0 * coalesce(n, 0) / (len(a) + len(b)) END, 6) AS f1,
      round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(list_concat(a, b))) END, 6) AS iou FROM o""",
)
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _neighbours(spark, sf_dir).select(
        "uniq_id", "turn_index", F.round(text.token_f1(a, b), 6).alias("f1"), F.round(text.token_iou(a, b), 6).alias("iou"),
    )


# Rows of the table of a distance, one after the other: each is a fold over the columns.
_LEVEL = """d AS (SELECT uniq_id, turn_index, a, b, 0 AS i, CAST(range(0, len(b) + 1) AS BIGINT[]) AS r, CAST(list_transform(range(0, len(b) + 1), lambda x: 0) AS BIGINT[]) AS c FROM q
  UNION ALL SELECT uniq_id, turn_index, a, b, i + 1,
    list_reduce(list_transform(range(1, len(b) + 1), lambda j: [least(r[j + 1] + 1, r[j] + CASE WHEN b[j] = a[i + 1] THEN 0 ELSE 1 END)]), lambda acc, v: list_append(acc, least(v[1], acc[len(acc)] + 1)), [r[1] + 1]),
    list_reduce(list_transform(range(1, len(b) + 1), lambda j: [greatest(c[j + 1], c[j] + CASE WHEN b[j] = a[i + 1] THEN 1 ELSE 0 END)]), lambda acc, v: list_append(acc, greatest(v[1], acc[len(acc)])), [0::BIGINT])
  FROM d WHERE i < len(a))"""


@registry.query(
    "token_distances",
    _NEIGHBOURS.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _LEVEL + " SELECT uniq_id, turn_index, CAST(r[len(r)] AS INT) AS errors, CAST(len(b) AS INT) AS ref_words FROM d WHERE i = len(a)",
)
def token_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word edit distance of a turn to the one before it."""
    return _neighbours(spark, sf_dir).select(
        "uniq_id", "turn_index", text.token_distance("a", "b").alias("errors"), F.size("b").alias("ref_words"),
    )


_GRAMS = "list_transform(range(1, len($) - $n + 2), lambda i: array_to_string(list_slice($, i, i + $n - 1), ' '))"


def shared_sql(a: str, b: str) -> str:
    """Size of the multiset intersection of two lists."""
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda x: least(len(list_filter({a}, lambda y: y = x)), len(list_filter({b}, lambda y: y = x))))), 0)"


@registry.query(
    "common_subsequences",
    _NEIGHBOURS.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _LEVEL
    + f", g AS (SELECT *, {_GRAMS.replace('$n', '2').replace('$', 'a')} AS a2, {_GRAMS.replace('$n', '2').replace('$', 'b')} AS b2 FROM d WHERE i = len(a))"
    + f" SELECT uniq_id, turn_index, CAST(c[len(c)] AS INT) AS lcs, CAST({shared_sql('a', 'b')} AS INT) AS unigrams, CAST({shared_sql('a2', 'b2')} AS INT) AS bigrams FROM g",
)
def common_subsequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest common subsequence and unigram and bigram overlap of neighbouring turns."""
    a, b = F.col("a"), F.col("b")
    return _neighbours(spark, sf_dir).select(
        "uniq_id", "turn_index", text.lcs_length(a, b).alias("lcs"), text.multiset_overlap(a, b).alias("unigrams"), text.multiset_overlap(wer.ngrams(a, 2), wer.ngrams(b, 2)).alias("bigrams")
    )


@registry.query(
    "phrase_hits",
    """WITH n AS (SELECT ' ' || array_to_string(regexp_extract_all(lower(role_title), '[a-z0-9]+'), ' ') || ' ' AS needle, uniq_id, speaker_no FROM speaker_roster WHERE role_title IS NOT NULL),
    d AS (SELECT uniq_id, request_id, ' ' || array_to_string(regexp_extract_all(lower(raw_text), '[a-z0-9]+'), ' ') || ' ' AS hay FROM parse_results WHERE raw_text IS NOT NULL)
    SELECT d.request_id, n.speaker_no FROM d JOIN n USING (uniq_id) WHERE contains(hay, needle) AND length(trim(needle)) > 0""",
)
def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = table(spark, sf_dir, "speaker_roster").where("role_title is not null").select("uniq_id", "speaker_no", "role_title")
    replies = table(spark, sf_dir, "parse_results").where("raw_text is not null").select("uniq_id", "request_id", "raw_text")
    return replies.join(roles, "uniq_id").where(text.holds_phrase(F.col("raw_text"), F.col("role_title"))).select("request_id", "speaker_no")


@registry.query(
    "copy_rates",
    """WITH t AS (SELECT DISTINCT uniq_id, regexp_extract_all(lower(reference_text), '[a-z0-9]+') AS n FROM score_turns WHERE reference_text IS NOT NULL),
    p AS (SELECT p.request_id, regexp_extract_all(lower(p.raw_text), '[a-z0-9]+') AS h, t.n FROM parse_results p JOIN t USING (uniq_id) WHERE p.raw_text IS NOT NULL),
    c AS (SELECT *, CASE WHEN len(n) = 0 OR len(h) < len(n) THEN 0 ELSE len(list_filter(range(1, len(h) - len(n) + 2), lambda i: list_slice(h, i, i + len(n) - 1) = n)) END AS copies FROM p)
    SELECT request_id, count(*) AS pairs, count(*) FILTER (WHERE copies > 0) AS hits, CAST(sum(copies) AS BIGINT) AS copies FROM c GROUP BY request_id""",
)
def copy_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    needles = table(spark, sf_dir, "score_turns").where("reference_text is not null").select(
        "uniq_id", text.ascii_tokens(F.col("reference_text")).alias("n"),
    ).distinct()
    replies = table(spark, sf_dir, "parse_results").where("raw_text is not null").select(
        "uniq_id", "request_id", text.ascii_tokens(F.col("raw_text")).alias("h"),
    )
    counted = scoring.copy_counts(replies.join(needles, "uniq_id"), "h", "n")
    return counted.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("copies") > 0).alias("hits"), F.sum("copies").alias("copies"),
    )


@registry.query(
    "capital_terms",
    rf"""WITH s AS (SELECT doc_id, text, string_split(regexp_replace(trim(regexp_replace(text, '{SPACE}+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents WHERE text IS NOT NULL),
    r AS (SELECT doc_id, text, flatten(list_transform(l, lambda x: regexp_extract_all(regexp_replace(regexp_replace(x, '^\S+\s*', ''), '[^\p{{L}}\p{{N}}\s''\-]', ' | ', 'g'), '(?:^|[^\p{{L}}\p{{N}}_])(\p{{Lu}}[\p{{L}}\p{{N}}''\-]*(?: \p{{Lu}}[\p{{L}}\p{{N}}''\-]*)*)', 1))) AS c FROM s)
    SELECT doc_id, CAST(len(list_filter(c, lambda x: NOT regexp_matches(x, '^I(''|$)'))) AS INT) AS runs, CAST(len(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}\p{{M}}_]+'), lambda x: regexp_full_match(x, '\p{{Lu}}{{2,}}'))) + len(regexp_extract_all(text, '(?:^|[^\p{{L}}\p{{N}}_])((?:\p{{Lu}} ){{2,}}\p{{Lu}})(?:$|[^\p{{L}}\p{{N}}_])', 1)) AS INT) AS acronyms FROM r""",
)
def capital_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised runs within sentences and acronyms of each document (tested on fixtures)."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select(
        "doc_id", F.size(text.capital_runs(F.col("text"))).alias("runs"), F.size(text.acronyms(F.col("text"))).alias("acronyms"),
    )


@registry.query(
    "swapped_names",
    """SELECT uniq_id, speaker_no, array_to_string(list_transform(string_split(display_name, ' '), lambda w: CASE WHEN length(w) >= 4 THEN w[1] || w[3] || w[2] || substr(w, 4) ELSE w || 'x' END), ' ') AS swapped
       FROM speaker_roster WHERE display_name IS NOT NULL""",
)
def swapped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "speaker_roster").where("display_name is not null")
    return rows.select("uniq_id", "speaker_no", text.swapped(F.col("display_name")).alias("swapped"))


_LINES = r"""WITH l AS (SELECT request_id, unnest(list_filter(string_split_regex(raw_text, '\r\n|\n|\r'), lambda x: trim(x) <> '')) AS line FROM parse_results WHERE raw_text IS NOT NULL),
f AS (SELECT request_id, CASE WHEN trim(regexp_extract(trim(line), '^([^|\n]+)\|(.+)$', 1)) <> '' AND trim(regexp_extract(trim(line), '^([^|\n]+)\|(.+)$', 2)) <> '' THEN 'strict' WHEN trim(regexp_extract(trim(line), '^\[([^\]\n]+)\]\s*(.+)$', 1)) <> '' AND trim(regexp_extract(trim(line), '^\[([^\]\n]+)\]\s*(.+)$', 2)) <> '' THEN 'lenient'
  WHEN trim(regexp_extract(trim(line), '^([A-Za-z0-9 _.\-]{1,40}?):\s*(.+)$', 1)) <> '' AND trim(regexp_extract(trim(line), '^([A-Za-z0-9 _.\-]{1,40}?):\s*(.+)$', 2)) <> '' THEN 'lenient' ELSE 'malformed' END AS form FROM l)"""


@registry.query(
    "reply_modes",
    _LINES
    + """ SELECT request_id, count(*) AS lines, count(*) FILTER (WHERE form = 'strict') AS strict, count(*) FILTER (WHERE form = 'lenient') AS lenient, count(*) FILTER (WHERE form = 'malformed') AS malformed,
    CASE WHEN count(*) FILTER (WHERE form = 'strict') = count(*) THEN 'strict' WHEN count(*) FILTER (WHERE form <> 'malformed') > 0 THEN 'lenient' ELSE 'failed' END AS mode, round(count(*) FILTER (WHERE form = 'strict') / count(*), 6) AS compliance
    FROM f GROUP BY request_id""",
)
def reply_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar.reply_modes(table(spark, sf_dir, "parse_results"), "raw_text", ["request_id"])


@registry.query(
    "token_counts",
    "SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS INT) AS tokens, CAST(ceil(length(text) / 4.0) AS BIGINT) AS estimate FROM documents WHERE text IS NOT NULL",
)
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with text, in any script."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select(
        "doc_id", F.size(text.ascii_tokens(F.col("text"))).alias("tokens"), text.token_estimate(F.col("text")).alias("estimate"),
    )


_TOKENS = r"[\p{L}\p{M}\p{Nd}\p{Nl}\x{200C}\x{200D}\x{24B6}-\x{24E9}]+"
# Streams of words per speaker, distances of each pair of streams, and the least total by sets of taken streams.
_CP = f"""WITH RECURSIVE {_ROSTER}, hl AS {speaker_sql('label', '(SELECT * RENAME (speaker AS label) FROM transcribed_segments)')}, ls AS {speaker_sql('speaker_id', 'score_turns')},
ra AS (SELECT uniq_id, turn_index AS ordinal, regexp_extract_all(lower(reference_text), '{_TOKENS}') AS w, arg_min(speaker, (NOT starts_with(speaker, '#'), speaker)) AS speaker FROM ls WHERE reference_text IS NOT NULL GROUP BY ALL),
ss AS (SELECT DISTINCT uniq_id, request_id AS session FROM transcribed_segments), rr AS (SELECT session, speaker, ordinal, w FROM ra JOIN ss USING (uniq_id)),
hh AS (SELECT request_id AS session, seg_ord AS ordinal, regexp_extract_all(lower(text), '{_TOKENS}') AS w, arg_min(speaker, (NOT starts_with(speaker, '#'), speaker)) AS speaker FROM hl WHERE text IS NOT NULL GROUP BY ALL),
rs AS (SELECT session, speaker, coalesce(flatten(list(w ORDER BY ordinal NULLS FIRST, w)), []) AS b, row_number() OVER (PARTITION BY session ORDER BY speaker) AS i FROM rr GROUP BY session, speaker),
hs AS (SELECT session, speaker, coalesce(flatten(list(w ORDER BY ordinal NULLS FIRST, w)), []) AS a, CAST(1 AS BIGINT) << CAST(row_number() OVER (PARTITION BY session ORDER BY speaker) - 1 AS INT) AS bit FROM hh GROUP BY session, speaker),
q AS (SELECT session AS uniq_id, rs.i AS turn_index, a, b, bit FROM rs JOIN hs USING (session)),
{_LEVEL.replace('turn_index, a, b,', 'turn_index, bit, a, b,')},
ce AS (SELECT uniq_id AS session, turn_index AS i, bit, r[len(r)] - len(a) AS cost FROM d WHERE d.i = len(a)),
rn AS (SELECT session, max(i) AS n, CAST(sum(len(b)) AS BIGINT) AS ref_words FROM rs GROUP BY session), hn AS (SELECT session, CAST(sum(len(a)) AS BIGINT) AS hyp_words FROM hs GROUP BY session),
dp AS (SELECT session, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS taken, CAST(0 AS BIGINT) AS best FROM rn
  UNION ALL SELECT session, i, taken, CAST(min(best) AS BIGINT) FROM (SELECT dp.session, dp.i + 1 AS i, dp.taken, dp.best + len(rs.b) AS best FROM dp JOIN rs ON rs.session = dp.session AND rs.i = dp.i + 1
    UNION ALL SELECT dp.session, dp.i + 1, dp.taken | ce.bit, dp.best + ce.cost FROM dp JOIN ce ON ce.session = dp.session AND ce.i = dp.i + 1 WHERE dp.taken & ce.bit = 0) GROUP BY ALL),
be AS (SELECT dp.session, min(best) AS best FROM dp JOIN rn ON rn.session = dp.session AND dp.i = rn.n GROUP BY dp.session)
SELECT coalesce(rn.session, hn.session) AS session, CAST(coalesce(best, 0) + coalesce(hyp_words, 0) AS BIGINT) AS errors, coalesce(ref_words, 0) AS ref_words, coalesce(hyp_words, 0) AS hyp_words, round((coalesce(best, 0) + coalesce(hyp_words, 0)) / nullif(coalesce(ref_words, 0), 0), 6) AS cp_wer
FROM rn FULL JOIN hn ON hn.session = rn.session LEFT JOIN be ON be.session = coalesce(rn.session, hn.session)"""


@registry.query("speaker_error_rates", _CP)
def speaker_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cpWER of each request's segments against the raw turns of its dialogue. All words of
    both sides count: labels are resolved by number or roster, one that cannot be (null too) is
    a speaker of its own. Deliveries with the same words count once (tested on fixtures)."""
    asked, roster = table(spark, sf_dir, "transcribed_segments"), table(spark, sf_dir, "speaker_roster")
    least = F.min(F.struct(~F.col("speaker").startswith("#"), "speaker"))["speaker"].alias("speaker")  # numbers first
    ref = speakers.resolved(table(spark, sf_dir, "score_turns").where("reference_text is not null"), roster, "speaker_id")
    ref = ref.groupBy("uniq_id", F.col("turn_index").alias("ordinal"), text.word_tokens(F.col("reference_text")).alias("words")).agg(least)
    ref = ref.join(
        asked.select("uniq_id", F.col("request_id").alias("session")).distinct(), "uniq_id",
    ).select("session", "speaker", "ordinal", "words")
    hyp = speakers.resolved(asked.where("text is not null").withColumnRenamed("speaker", "_label"), roster, "_label")
    hyp = hyp.groupBy(
        F.col("request_id").alias("session"), F.col("seg_ord").alias("ordinal"), text.word_tokens(F.col("text")).alias("words"),
    ).agg(least)
    return wer.cp_wer(ref, hyp.select("session", "speaker", "ordinal", "words"))


@registry.query(
    "repeated_terms",
    f"WITH {TURNS}, w AS (SELECT uniq_id, unnest(list_filter(string_split(said, ' '), lambda x: regexp_full_match(x, '[a-z]{{4,}}'))) AS term FROM t WHERE said IS NOT NULL) SELECT uniq_id, term, count(*) AS n FROM w WHERE term NOT IN ('that', 'this', 'with', 'from', 'have', 'they', 'were', 'will', 'what') GROUP BY ALL HAVING count(*) >= 2",
)
def repeated_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower-case words of four letters or more, no stop words, that a dialogue says twice."""
    words = turns(spark, sf_dir).select(
        "uniq_id", F.explode(F.filter(F.split("said", " "), lambda x: x.rlike("^[a-z]{4,}$"))).alias("term"),
    )
    kept = words.where(~F.col("term").isin("that", "this", "with", "from", "have", "they", "were", "will", "what"))
    return kept.groupBy("uniq_id", "term").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
