"""Text normalisers and token functions as Column expressions, without Python workers but
for ``casefolded`` and the two distances of token arrays.

Null in, null out unless a docstring says otherwise. Regular expressions are Java's; where
word characters are meant in the Unicode sense, ``(?U)`` says so.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
HYPHENS = "‐‑‒–—−_"
NUMBER_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "ten": "10",
    "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17",
    "eighteen": "18", "nineteen": "19", "twenty": "20",
    "thirty": "30", "forty": "40", "fifty": "50", "sixty": "60", "seventy": "70", "eighty": "80", "ninety": "90", "hundred": "100",
    "thousand": "1000",
}
ASCII_PUNCTUATION = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"


def squeezed(text: Column) -> Column:
    """White space, Unicode's too, as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normal_term(text: Column) -> Column:
    """A glossary key: lower case, hyphen-like signs as ``-``, other punctuation deleted."""
    hyphened = F.regexp_replace(F.lower(F.trim(text)), f"[{HYPHENS}]", "-")
    return F.regexp_replace(squeezed(F.regexp_replace(hyphened, r"(?U)[^\w\s\-]", "")), r"^-+|-+$", "")


def normal_answer(text: Column) -> Column:
    """Lower case, thousands separators out, number words as digits, punctuation as blanks."""
    plain = F.regexp_replace(F.lower(text), r"(?<=\d),(?=\d{3})", "")
    words = F.split(squeezed(F.regexp_replace(plain, r"(?U)[^\w\s]", " ")), " ")
    table = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def normal_span(text: Column) -> Column:
    """Lower case, speaker prefixes, ASCII punctuation and articles deleted."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(text, r"Speaker [0-9]*: ", "")), ASCII_PUNCTUATION, "")
    return squeezed(F.regexp_replace(plain, r"(?U)\b(a|an|the)\b", " "))


def ascii_tokens(text: Column) -> Column:
    """Runs of ``[a-z0-9]`` of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def word_tokens(text: Column) -> Column:
    """Unicode words without underscores, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[^\W_]+"), F.lit(0))


def holds_phrase(text: Column, phrase: Column, refuse_empty: bool = True) -> Column:
    """Whether the tokens of ``phrase`` stand together in ``text``. An empty phrase is in
    nothing, or with ``refuse_empty`` off in texts without tokens."""
    padded = lambda c: F.concat(F.lit(" "), F.array_join(ascii_tokens(c), " "), F.lit(" "))
    found = F.contains(padded(text), padded(phrase))
    return found & (F.size(ascii_tokens(phrase)) > 0) if refuse_empty else found


def window_places(tokens: Column, needle: Column) -> Column:
    """0-based places at which ``needle`` stands in ``tokens``; overlapping ones count."""
    last = F.size(tokens) - F.size(needle)
    places = F.when(
        (last >= 0) & (F.size(needle) > 0), F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
    ).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: F.slice(tokens, i + 1, F.size(needle)) == needle)


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""
    return F.aggregate(
        F.array_distinct(a), F.lit(0), lambda n, t: n + F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t)))
    )


def token_f1(a: Column, b: Column, empty_pair: float = 1.0) -> Column:
    """F1 of two token arrays: ``empty_pair`` if both are empty, 0.0 if one is."""
    both, shared = F.size(a) + F.size(b), multiset_overlap(a, b)
    return F.when(both == 0, F.lit(empty_pair)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(2.0 * shared / both)


def token_iou(a: Column, b: Column, empty_pair: float = 1.0) -> Column:
    """Jaccard similarity of the token sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty_pair)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def edit_distance(a: Sequence[str], b: Sequence[str]) -> int:
    """Levenshtein distance of two token sequences, a row of the table at a time."""
    codes: dict[str, int] = {}
    x, y = ([codes.setdefault(w, len(codes)) for w in t] for t in (a, b))
    columns, index = np.array(y, np.int64), np.arange(len(y) + 1)
    row = index.copy()
    for w in x:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (columns != w))
        row = np.minimum.accumulate(new - index) + index  # insertions, all at once
    return int(row[-1])


def common_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence of two token sequences."""
    codes: dict[str, int] = {}
    x, y = ([codes.setdefault(w, len(codes)) for w in t] for t in (a, b))
    columns = np.array(y, np.int64)
    row = np.zeros(len(y) + 1, np.int64)
    for w in x:
        new = row.copy()
        new[1:] = np.maximum(row[1:], row[:-1] + (columns == w))
        row = np.maximum.accumulate(new)
    return int(row[-1])


def _of_pairs(f):
    @F.pandas_udf(T.IntegerType())
    def column(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(list(x), list(y)) for x, y in zip(a, b)], dtype="Int32")

    return column


#: Levenshtein distance, and longest common subsequence, of two token arrays; null if one is.
token_distance = _of_pairs(edit_distance)
lcs_length = _of_pairs(common_length)


def capital_runs(text: Column) -> Column:
    """Runs of capitalised words, the first word of each sentence left out, ``I`` too."""
    sentences = F.split(squeezed(text), r"(?<=[.!?])\s+")
    inner = F.transform(sentences, lambda s: F.regexp_replace(s, r"^\S+\s*", ""))
    clean = F.transform(inner, lambda s: F.regexp_replace(s, r"[^\p{L}\p{N}\s'\-]", " | "))
    runs = F.flatten(
        F.transform(clean, lambda s: F.regexp_extract_all(s, F.lit(r"\b\p{Lu}[\p{L}\p{N}'\-]*(?: \p{Lu}[\p{L}\p{N}'\-]*)*"), F.lit(0)))
    )
    return F.filter(runs, lambda r: ~r.rlike(r"^I('|$)"))


def acronyms(text: Column) -> Column:
    """Runs of capitals, and capitals spelled apart (``P G L``), written together."""
    spelled = F.transform(
        F.regexp_extract_all(text, F.lit(r"\b(?:\p{Lu} ){2,}\p{Lu}\b"), F.lit(0)), lambda x: F.replace(x, F.lit(" "), F.lit("")),
    )
    return F.concat(F.regexp_extract_all(text, F.lit(r"\b\p{Lu}{2,}\b"), F.lit(0)), spelled)


# What introduces a name.
INTRODUCTIONS = ("this is", "i am", "i'm", "my name is")


def self_introduction(text: Column) -> Column:
    """The name after an introduction: up to three neighbouring words that begin with a capital
    A to Z and hold nothing but letters, apostrophes and hyphens. The introduction is in any
    case; the first that a name follows counts; null if there is none."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    small = F.transform(words, lambda w: F.lower(w))
    # what a word begins with that can be a name, and whether that is all of it
    name = F.transform(words, lambda w: F.regexp_extract(w, r"^[A-Z][A-Za-z'\-]*", 0))
    whole = lambda i: F.get(name, i) == F.get(words, i)

    def behind(phrase: str) -> Column:
        """Places right behind an introduction."""
        first, *rest = phrase.split(" ")
        n = len(rest) + 1
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0)))
        follows = lambda i: (F.slice(small, i + 2, F.lit(n - 1)) == F.array(*[F.lit(x) for x in rest])) if rest else F.lit(True)
        at = F.filter(starts, lambda i: follows(i) & F.coalesce(F.get(small, i).rlike(r"(?:^|[^a-z0-9_])" + first + "$"), F.lit(False)))
        return F.transform(at, lambda i: i + n)

    places = F.array_sort(F.filter(F.concat(*[behind(x) for x in INTRODUCTIONS]), lambda i: F.coalesce(F.get(name, i) != "", F.lit(False))))
    i = F.element_at(F.when(F.size(places) > 0, places), 1)
    second = whole(i) & (F.coalesce(F.get(name, i + 1), F.lit("")) != "")
    third = second & whole(i + 1) & (F.coalesce(F.get(name, i + 2), F.lit("")) != "")
    return F.when(i.isNotNull(), F.concat_ws(" ", F.get(name, i), F.when(second, F.get(name, i + 1)), F.when(third, F.get(name, i + 2))))


def swapped(text: Column) -> Column:
    """Each word of four letters or more with its second and third swapped, shorter ones with
    an ``x`` more: a corrupted copy for controls."""
    word = lambda w: F.when(F.length(w) >= 4, F.concat(F.substr(w, F.lit(1), F.lit(1)), F.substr(w, F.lit(3), F.lit(1)), F.substr(w, F.lit(2), F.lit(1)), F.substr(w, F.lit(4)))).otherwise(F.concat(w, F.lit("x")))
    return F.array_join(F.transform(F.split(text, " "), word), " ")


def tag_runs(tokens: Column, tags: Column) -> Column:
    """Runs of tokens whose tag is not ``O``, as texts; neighbours of any tag are one run."""
    marked = F.transform(F.arrays_zip(tokens.alias("t"), tags.alias("g")), lambda x: F.when(x["g"] == "O", F.lit("\x00")).otherwise(x["t"]))
    parts = F.transform(F.split(F.array_join(marked, " "), "\x00"), squeezed)
    return F.filter(parts, lambda p: p != "")


def speaker_numbers(text: Column) -> Column:
    """Distinct numbers of ``Speaker n`` in a text, ascending."""
    return F.array_sort(
        F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"Speaker (\d+)"), F.lit(1)), lambda x: x.cast("int")))
    )


def even_division(start: Column, end: Column, n: Column) -> Column:
    """``n`` equal spans of [start, end); the last ends at ``end`` exactly."""
    step = (end - start) / n
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct((start + step * i).alias("s"), F.when(i == n - 1, end).otherwise(start + step * (i + 1)).alias("e")),
    )


def token_estimate(text: Column) -> Column:
    """Tokens of a prompt part, at four characters a token."""
    return F.ceil(F.length(text) / 4.0).cast("long")


def fold_of(identifier: Column, salt: str, folds: int = 4) -> Column:
    """Fold by the first eight bytes of sha256(salt:id), for a power of two of folds up to 16."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), identifier), 256)
    return (F.conv(F.substr(digest, F.lit(16), F.lit(1)), 16, 10).cast("int") % folds).cast("int")


def md5_draw(n: Column, *parts: Column) -> Column:
    """A number in 0 .. n - 1 from the md5 of the parts joined by colons."""
    number = F.conv(F.substr(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), F.lit(1), F.lit(8)), 16, 10).cast("long")
    return F.pmod(number, n)


def lexemes(text: Column) -> Column:
    """Term candidates of a text: array of (surface, kind). ``strict``: an acronym of two
    capitals or more, or letters mixed with digits; ``name_like``: three letters or more with
    one capital in front, not at the start of a sentence. Notes in braces are not there."""
    plain = F.regexp_replace(text, r"\{[^}]*\}", " ")
    tokens = F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}][\p{L}\p{N}'\-]*|[.!?]"), F.lit(0))

    def kind(t: Column, i: Column) -> Column:
        starts = (i == 0) | F.get(tokens, i - 1).isin(".", "!", "?")
        strict = t.rlike(r"^\p{Lu}{2,}$") | (t.rlike(r"\p{L}") & t.rlike(r"\p{N}"))
        name = t.rlike(r"^\p{Lu}\p{Ll}{2,}$") & ~starts
        return F.struct(t.alias("surface"), F.when(strict, "strict").when(name, "name_like").alias("kind"))

    return F.filter(F.transform(tokens, kind), lambda x: x["kind"].isNotNull())


def term_kinds(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per key and surface; a surface that is strict anywhere is strict."""
    found = rows.select(*keys, F.inline(lexemes(F.col(text))))
    return found.groupBy(*keys, "surface").agg(F.max(F.col("kind") == "strict").alias("_s"), F.count(F.lit(1)).alias("n")).select(
        *keys, "surface", F.when(F.col("_s"), "strict").otherwise("name_like").alias("kind"), "n",
    )


@F.pandas_udf(T.StringType())
def casefolded(texts: pd.Series) -> pd.Series:
    """Compatibility-normalised, case-folded and squeezed: what no built-in function does."""
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


# Punctuation that the spoken form turns to blanks, contractions that are words
# of their own, endings that stand for a word, and words after which ``'s`` is ``is``.
SPOKEN_PUNCTUATION = ",;(){}[]\"|:!?.#$%&*+/<=>@\\^_`~"
SPOKEN_PUNCTUATION_WIDE = "，；､、丶｟｠《》（）｢｣［］｛｝「」『』【】〔〕！？｡。"
WHOLE_CONTRACTIONS = {
    "won't": "will not", "can't": "cannot", "shan't": "shall not", "ain't": "are not", "let's": "let us", "y'all": "you all",
    "ma'am": "madam", "o'clock": "of the clock", "'cause": "because", "'em": "them", "'tis": "it is", "'twas": "it was",
}
CONTRACTED_ENDINGS = {"n't": " not", "'re": " are", "'ll": " will", "'ve": " have", "'m": " am", "'d": " would"}
BEFORE_IS = (
    "he", "how", "it", "she", "so", "somebody", "someone", "something", "that", "there", "this", "what", "when", "where", "who", "why",
    "here", "everyone", "nobody",
)
_PUNCTUATION_CLASS = "[" + "".join("\\" + c if c in "[]\\^" else c for c in SPOKEN_PUNCTUATION) + SPOKEN_PUNCTUATION_WIDE + "]"


def contraction_steps() -> list[tuple[str, str]]:
    """Patterns and replacements that write contractions out, in order, in any case; ``'s``
    after other words is a genitive and stays. Other engines' regular expressions know them,
    too."""
    edge = "([^A-Za-z0-9_'])"
    steps = [(f"(?i){edge}{short}{edge}", rf"$1{full}$2") for short, full in WHOLE_CONTRACTIONS.items()]
    steps += [(rf"(?i)([A-Za-z]){short}{edge}", rf"$1{full}$2") for short, full in CONTRACTED_ENDINGS.items()]
    return [*steps, (rf"(?i){edge}({'|'.join(BEFORE_IS)})'s{edge}", r"$1$2 is$3")]


def spoken_form(text: Column) -> Column:
    """For word error rates of English: an all-capital text in lower case, ``O'`` as a word of
    its own, contractions written out, punctuation, hyphens and apostrophes as blanks, single
    letters spelled apart (with a last ``s``) written together, and all in lower case.

    Contractions follow the rule above, not a published table, so rare ones differ. A
    contraction right behind another one (one blank between) is left to the second pass."""
    letters = F.regexp_replace(text, "[^A-Za-z]", "")
    out = F.when((letters != "") & (F.upper(text) == text), F.lower(text)).otherwise(text)
    out = F.concat(F.lit(" "), F.replace(out, F.lit("’"), F.lit("'")), F.lit(" "))
    out = F.regexp_replace(F.regexp_replace(out, r"\sO'\s", " O "), r"\so'\s", " o ")
    for _ in range(2):
        for pattern, full in contraction_steps():
            out = F.regexp_replace(out, pattern, full)
    out = F.regexp_replace(out, _PUNCTUATION_CLASS, " ")
    words = F.filter(F.split(F.regexp_replace(out, r"[-']", " "), r"\s+"), lambda w: w != "")
    single = lambda w: w.rlike(r"^\p{L}s?$")
    glued = lambda w, i: F.concat(F.when((i > 0) & single(w) & single(F.get(words, i - 1)), F.lit("")).when(i > 0, F.lit(" ")).otherwise(F.lit("")), w)
    return F.lower(F.array_join(F.transform(words, glued), ""))
