"""Template residue, filler, error pages and script notices in documents.

1. Texts are split into lines; equal lines are handled once for the whole corpus and split
   into units, the sentences within them, with numbers masked.
2. A prefix tree of fixed depth groups all units of the corpus: by token count and the first
   ``DEPTH`` tokens. A leaf's template is what its units share at their beginning and end,
   with ``*`` for what differs. Leaves are described by four mergeable aggregates (least and
   greatest unit, forwards and backwards), so no leaf is gathered.
3. A naive Bayes classifier judges every template once: ``error``, ``scripts``, ``filler`` or
   ordinary. It is trained on the example messages below against word counts of the whole
   corpus. The verdict of a template goes to all its units. A unit that its template does not
   condemn is a template of its own and is judged as it stands, so no majority acquits it.
4. Verdicts go on by documents: a line that is in ``COMPANY_TEXTS`` texts or more, nearly all
   of them condemned, is part of the same page (a footer, a hint whom to tell) and condemns
   the other documents that hold it.
5. Slots that nobody filled, such as ``{{owner}}`` or ``[INSERT DATE]``, are looked for in
   every distinct line. What a bracket holds decides; where it doesn't, the frame around it
   does: one in which other lines have sure slots is a frame for slots.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from http import HTTPStatus

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sampling import hashed_head
from ..session import stored_table

#: Tokens of a unit that are levels of the prefix tree.
DEPTH = 5
#: A line is a page's company from so many different condemned texts, and such a share of all
#: documents that hold it.
COMPANY_TEXTS, COMPANY_SHARE = 8, 0.95
#: Evidence (log odds) and share of telling words from which a unit is condemned.
LEAST_SCORE, LEAST_SHARE = 2.5, 0.6
#: Log odds of a word that no example holds, the most of any word, and the background
#: probability of a word that the corpus has not shown.
STRANGE, MOST, RARE = -1.2, 3.0, 1e-4
_PRIOR_WORDS = 2_000
#: Units that begin with ``lorem ipsum`` whose words are learnt, at most (the least by hash).
LOREM_UNITS = 2_000
#: Sure slots of different contents, and their share, that make a frame one for slots.
FRAME_SLOTS, FRAME_SHARE = 2, 0.5

# Example messages the classifier is trained on. ``404`` stands for any status.
# ``lorem`` is filler, too; its words are learnt from the corpus besides.
EXAMPLES: dict[str, tuple[str, ...]] = {
    "error": (
        *(f"404 {x.phrase}" for x in HTTPStatus if x >= 400),
        "404 page not found", "404 file not found", "resource not found", "404 page unavailable", "404 request entity too large",
        "404 unprocessable entity", "404 service temporarily unavailable",
        "404 gateway time-out", "gateway timeout", "request timeout", "404 unauthorised", "forbidden", "unauthorized", "HTTP error 404",
        "HTTP status 404", "error 404", "error code: 404", "status code 404", "404. That's an error.",
        "access denied", "permission denied", "you don't have permission to view this page", "you do not have access to this resource",
        "you are not authorized to view this page",
        "your session has expired", "session expired, please sign in again", "please log in again to continue",
        "the server encountered an unexpected condition",
        "the server encountered an internal error and was unable to complete your request",
        "the server is temporarily unable to service your request",
        "internal server error", "the requested URL was not found on this server", "the requested recording could not be located",
        "the requested document does not exist", "the page you requested could not be found",
        "the file could not be opened", "the transcript could not be loaded", "we can't find the page you are looking for",
        "we could not load the document", "unable to load the resource", "failed to load resource", "failed to fetch",
        "this page has been removed", "this page does not exist", "this page is no longer available", "this page isn't working",
        "this content is not available", "this site can't be reached", "the link may be broken or the page may have been moved",
        "something went wrong, reload the page", "an error occurred", "an unexpected error has occurred",
        "an error occurred while processing your request", "unknown error, error code", "fatal error", "unhandled exception",
        "too many requests, you have been rate limited", "the service did not respond in time", "the service is unavailable",
        "service unavailable", "connection timed out", "the connection was reset", "connection refused",
        "upstream unavailable", "upstream connect error", "no response from backend server", "please contact the administrator",
        "try reloading the page", "try again later", "not found", "contact the site administrator for help", "bad gateway",
        "ERR_CONNECTION_RESET", "ERR_CONNECTION_TIMED_OUT", "ERR_NAME_NOT_RESOLVED", "error message code 404", "database connection failed",
        "request failed with status code 404",
        "Zugriff verweigert", "Ihre Sitzung ist abgelaufen", "Seite nicht gefunden", "die angeforderte Seite existiert nicht mehr",
        "die angeforderte Aufnahme wurde nicht gefunden", "interner Serverfehler", "bitte versuchen Sie es später erneut", "Fehler 404",
        "Dienst nicht verfügbar", "Sie haben keine Berechtigung", "die Verbindung wurde unterbrochen", "es ist ein Fehler aufgetreten",
        "accès refusé", "votre session a expiré", "page introuvable", "le document demandé n'existe pas ou a été déplacé",
        "erreur 404 : service momentanément indisponible", "erreur interne du serveur", "vous n'avez pas l'autorisation",
        "une erreur est survenue",
        "acceso denegado", "la sesión ha caducado", "su sesión ha expirado", "página no encontrada", "el documento solicitado no existe",
        "error interno del servidor", "inténtelo de nuevo más tarde", "se ha producido un error", "servicio no disponible",
        "página não encontrada", "acesso negado", "erro interno do servidor", "sessão expirada", "ocorreu um erro", "pagina non trovata",
        "accesso negato", "errore interno del server", "si è verificato un errore",
        "服务器内部错误，请稍后再试", "页面不存在", "页面找不到", "您访问的页面已被删除", "访问被拒绝，请重新登录", "请求超时", "请求已超时，请重试", "会话已过期", "服务暂时不可用", "服务器繁忙", "服务器没有响应",
    ),
    "scripts": (
        "please enable JavaScript to view this page", "enable JavaScript to open this document",
        "this page needs JavaScript to play the video", "enable JavaScript to load this application",
        "to read this article, enable JavaScript", "client-side scripts are required",
        "we're sorry but this app doesn't work properly without JavaScript enabled", "you need to enable JavaScript to run this app",
        "enable JavaScript to continue", "enable JavaScript and cookies to continue", "enable cookies and JavaScript, then refresh",
        "JavaScript is disabled in your browser", "JavaScript is required", "JavaScript required", "JavaScript must be enabled",
        "JavaScript seems to be disabled", "this site requires JavaScript", "this viewer requires scripts",
        "this page needs JavaScript to work", "this player does not work without JavaScript enabled",
        "this application will not run without JavaScript", "your browser does not support scripts or they have been switched off",
        "your browser does not support JavaScript", "your browser has scripting turned off", "turn on JavaScript and reload the page",
        "turn on JavaScript in your browser", "switch on JavaScript in your browser settings", "to continue, switch on JavaScript",
        "allow scripts for this site", "noscript: scripts are blocked", "activate JavaScript in your browser",
        "checking your browser before accessing the site", "we need to verify that you are human", "verify you are human",
        "bitte aktivieren Sie JavaScript in Ihrem Browser", "JavaScript ist deaktiviert", "diese Seite benötigt JavaScript",
        "veuillez activer JavaScript dans votre navigateur", "veuillez activer JavaScript pour afficher cette page",
        "JavaScript est désactivé", "ce site nécessite JavaScript",
        "debe habilitar JavaScript en su navegador", "active JavaScript para continuar", "JavaScript está desactivado",
        "habilite JavaScript para ver esta página", "ative o JavaScript no seu navegador", "attiva JavaScript nel tuo browser",
        "请启用JavaScript", "请启用浏览器的JavaScript功能", "请在浏览器中开启脚本", "需要启用脚本",
    ),
    "filler": (
        "foo bar baz", "your text here", "your text goes here", "your title here", "your content goes here", "insert text here",
        "insert your content here", "enter text here", "enter a title",
        "type your text here", "type a description", "write your summary here", "add your text here", "add a title", "add a heading",
        "add your bullet points here", "click to add title", "click to add text", "click to add notes", "click to edit",
        "click here to enter text", "sample text", "sample paragraph for display only", "sample content for display purposes", "dummy text",
        "dummy content", "placeholder text", "placeholder paragraph", "this is placeholder text", "this is dummy content",
        "filler text", "replace this text with your content", "replace this placeholder before publishing", "body copy goes here",
        "section content goes here", "description goes here", "heading goes here", "heading 1", "text to be replaced",
        "dies ist ein Blindtext", "dies ist ein Platzhalter", "Platzhaltertext", "hier steht Ihr Text", "hier steht später der Inhalt",
        "hier Text eingeben", "Beispieltext",
        "votre texte ici", "texte factice", "texte provisoire à remplacer", "texte de remplissage", "insérez votre texte ici",
        "cliquez pour ajouter un titre",
        "su texto aquí", "texto de relleno", "texto de ejemplo", "sustituir por el contenido final", "haga clic para agregar título",
        "seu texto aqui", "testo di esempio",
        "此处为占位文字", "占位文本", "示例文字", "点击此处添加标题", "请替换为正文内容", "在此输入文本",
    ),
    "lorem": (
        "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua",
        "ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat",
        "duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur",
        "excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum",
    ),
}
# Words that say nothing about the kind of a message, and everyday words that
# add to the evidence but are none by themselves.
FUNCTION = frozenset(
    "a an the of to in on at for and or by with it its is are was were be been being has have had will would may might can could do does did as that this these those there then than from into any some we i he she they them our us "
    "der die das den dem des ein eine einen einem und oder zu zum zur im in auf mit von es ist sind war wurde werden sie ihr wir bei um le la les l un une des du de d et ou à au aux en dans sur pour est a été ce cette se y o el los las un una del al por para "
    "con es su que os par but too longer mehr we're i'm it's as um uma do da dos das e em no na il lo gli di del".split()
)
COMMON = frozenset("you your my please sorry here goes now only time again later new back no more one looking add type enter click write edit steht hier ihr bitte votre ici vous su aquí view read".split())
SAID_OFTEN = frozenset("yeah yes yep okay well really very bye right sure thanks what come hello good great stop wait please sorry never more now here there".split())
NEGATORS = frozenset(
    "not cannot can't couldn't don't doesn't didn't isn't aren't won't wasn't nicht kein keine n'existe non não never".split()
)

INVISIBLE = "[\\u200b-\\u200f\\u2060\\ufeff\\u00ad\\u0000-\\u0008\\u000b\\u000c\\u000e-\\u001f\\u007f]"
_QUOTED = re.compile(
    r"(?<![^\s(])(?:\"[^\"\n]{2,60}\"|'[^'\n]{2,60}'|“[^”\n]{2,60}”|‘[^’\n]{2,60}’|„[^“\n]{2,60}“|«[^»\n]{2,60}»)(?=[\s.,;:!?)]|$)"
)
_TAGS = re.compile(r"https?://\S+|</?[A-Za-z][A-Za-z0-9#]*(?:\s[^<>\n]*)?/?>")
_TOKEN = re.compile(r"#e?|\*(?=\s|$)|[A-Z]{2,}(?:['’][A-Z]+)?(?![a-zà-ÿ])|[^\W\d_][^\W\d_A-Z]*(?:['’][^\W\d_]+)?|[^\W\d_]")
_CODE = re.compile(r"(?<![\d.,:])[45]\d\d(?![.,:]?\d)")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CJK = re.compile(r"[\u3400-\u9fff]")
_LOREM = re.compile(r"^lorem ipsum\b", re.I)
#: Words before a status number that leave it one.
_BEFORE_CODE = frozenset("http https error erreur fehler erro errore status code statuscode response".split())
_SCRIPT_NAMES = frozenset("javascript js script scripts scripting".split())
_HUMPS = re.compile(r"[a-zà-ÿ][A-Z]")
_TRACE = re.compile(r"^(?:[\w$]+\.)*[A-Z][\w$]*(?:Exception|Error): \S|^at [\w.$]+\([\w.]+:#e?\)|^Traceback \(most recent")


def masked(unit: str) -> str:
    """Status numbers as ``#e``, other numbers as ``#``."""
    return _NUMBER.sub("#", _CODE.sub("#e", unit))


def words_of(unit: str) -> list[str]:
    """Words of a masked unit for the classifier: quotes and tags left out, identifiers taken
    apart, a negator joined to the next telling word, Chinese as pairs of signs. A status
    number counts at the start, after words like ``error`` and at the end in brackets only."""
    text = _TAGS.sub(" ", _QUOTED.sub(" ", unit)).replace("’", "'")
    out: list[str] = []
    negated = False
    for found in _TOKEN.finditer(re.sub(r"java ?script", "javascript", text, flags=re.I)):
        w = found.group(0).lower()
        if w == "#e":
            at = not out or out[-1] in _BEFORE_CODE or text[found.start() - 1] == "("
            out.append("#e" if at else "#")
        elif _CJK.match(w):
            out += [w[i : i + 2] for i in range(len(w) - 1)] or [w]
        elif w in NEGATORS or (w == "no" and out and out[-1] not in FUNCTION):
            negated = True
            if w == "n'existe":
                out.append("not_existe")
        elif w in FUNCTION or (len(w) == 1 and w not in "#*"):
            continue
        else:
            w = "javascript" if w in _SCRIPT_NAMES else w
            out.append(f"not_{w}" if negated else w)
            negated = False
    return out


_LEARNT = {kind: [words_of(masked(x)) for x in texts] for kind, texts in EXAMPLES.items()}
#: Words of the examples, whose counts in the corpus are the classifier's background.
VOCABULARY = frozenset(w for texts in _LEARNT.values() for t in texts for w in t)
Examples = dict[str, list[list[str]]]
_TELLING = frozenset(w.removeprefix("not_") for w in VOCABULARY if w not in COMMON and not w.startswith("#")) | _SCRIPT_NAMES


def repeats(words: list[str]) -> bool:
    """Whether the words are one to four words said over and over, three times or more, or one
    word comes five times on end."""
    run = 1
    for a, b in zip(words, words[1:]):
        run = run + 1 if a == b and len(a) > 1 and a[0].isalpha() else 1
        if run == 5:
            return True
    for period in range(1, 5):
        run = longest = end = 0
        for i in range(period, len(words)):
            run = run + 1 if words[i] == words[i - period] else 0
            if run > longest:
                longest, end = run, i
        # the rest, a fifth at most, may be something else
        if longest and longest + period >= max(3 * period, 0.8 * len(words)):
            one = words[end - period + 1 : end + 1]
            return not SAID_OFTEN.issuperset(one) and any(len(w) > 2 and w[0].isalpha() for w in one)
    return False


#: What kinds of examples are reported as.
KINDS = {"lorem": "filler"}


class Verdicts:
    """A naive Bayes classifier of units; ``background`` counts words among ``total``, and
    ``lorem`` are units of the corpus that begin so, as words."""

    def __init__(self, background: dict[str, int] | None = None, total: int = 0, lorem: list[list[str]] | None = None) -> None:
        background = background or {}
        self.telling = _TELLING | {w for t in lorem or [] for w in t if w not in COMMON}
        self.odds: dict[str, dict[str, float]] = {}
        self.whole: dict[frozenset[str], str] = {}
        for kind, texts in _LEARNT.items():
            texts = texts + (lorem or []) if kind == "lorem" else texts
            counts = Counter(w for t in texts for w in t)
            n = sum(counts.values())
            own = {}
            for w, c in counts.items():
                usual = max((background.get(w, 0) + _PRIOR_WORDS * RARE) / (total + _PRIOR_WORDS), 5e-3 if w in COMMON else 0.0)
                own[w] = 0.0 if w == "#" else max(-1.0, min(MOST, math.log((c / n) / usual)))
            self.odds[kind] = own
            self.whole |= {frozenset(t): kind for t in texts if t and (len(t) > 1 or t[0] in ("not_found", "forbidden", "unauthorized", "platzhaltertext", "beispieltext"))}

    def of(self, unit: str) -> str | None:
        """``error``, ``scripts``, ``filler`` or None of one masked unit or template."""
        plain = _LETTERS.findall(unit.lower())
        if len(plain) > 2 and len(set(plain)) <= len(plain) - 2 and repeats(_LETTERS.findall(_QUOTED.sub(" ", unit.lower()))):
            return "filler"
        if self.telling.isdisjoint(plain) and not _CJK.search(unit) and not _HUMPS.search(unit):
            return None
        if _TRACE.search(unit):
            return "error"
        words = words_of(unit)
        if not words:
            return None
        if _LOREM.search(unit):
            return "filler"
        if (exact := self.whole.get(frozenset(words))) is not None and len(words) <= 12:
            return KINDS.get(exact, exact)
        told = [w for w in words if w != "#"]
        best: tuple[float, str] | None = None
        for kind, odds in self.odds.items():
            found = [w for w in told if w in odds]
            telling = {w for w in found if w not in COMMON and odds[w] > 0}
            if len(set(found)) < 2 or len(telling) < (1 if kind == "filler" else 2) or len(found) < LEAST_SHARE * len(told):
                continue
            score = sum(odds[w] for w in found) + STRANGE * (len(told) - len(found))
            if score >= LEAST_SCORE and (best is None or score > best[0]):
                best = (score, kind)
        return KINDS.get(best[1], best[1]) if best else None


# Slots ------------------------------------------------------------------------------------

# Words that name a value to be filled in, and words that ask to fill it in.
SLOT_NOUNS = frozenset(
    "name names date deadline company client customer owner chair title agenda item speaker recipient attendees attendee room project summary decision action meeting address email phone department topic time place location signature "
    "placeholder amount number subject sender datum titel firma kunde ort thema teilnehmer uhrzeit raum platzhalter nom client date société titre lieu sujet nombre cliente fecha título empresa lugar tema".split()
)
SLOT_ASKS = frozenset("insert add enter your fill type replace tbd todo here einfügen eintragen einsetzen hier ergänzen insérer saisir votre ajouter ici insertar su tu aquí introducir".split())
SLOT_JOINTS = frozenset("of the a an first last full and in la le de del der die das du des el los summary text value".split())
SLOT_ASKS_ZH = re.compile("请输入|在此插入|此处填写|请填写|在此输入|此处插入")
_IDENT = r"[A-Za-z][A-Za-z0-9_.]*"
#: Slots whose delimiters are not used for anything else.
PLAIN_SLOT = re.compile(
    r"\{\{\{?\s*" + _IDENT + r"(?:\s*\|\s*" + _IDENT + r")?\s*\}?\}\}|\$\{\s*" + _IDENT + r"\s*\}|#\{\s*" + _IDENT + r"\s*\}|%%\s*" + _IDENT + r"\s*%%|%\(" + _IDENT + r"\)s"
    r"|<%=?\s*" + _IDENT + r"\s*%>|@@\s*" + _IDENT + r"\s*@@|(?<![A-Za-z0-9_])__[A-Za-z]+(?:_[A-Za-z]+)*__(?![A-Za-z0-9_])"
)
#: Brackets that may also hold notes, asides or data: what is inside decides.
BRACKET_SLOT = re.compile(
    r"\[\[([^\[\]\n]{2,40})\]\]|<<([^<>\n]{2,40})>>|(?<!\[)\[([^\[\]\n]{2,40})\](?!\])|(?<![{$#])\{([^{}\n]{2,40})\}(?!\})|(?<!<)<(?!title>)([^<>/\n]{2,40})>(?!>)"
    r"|(?<!%)\(([^()\n]{2,40})\)|«([^«»\n]{2,40})»|【([^【】\n]{2,40})】|（([^（）\n]{2,40})）"
)
_QUOTES = "\"'“”‘’„`«»‹›「」"


def names_a_value(inside: str, round_: bool) -> bool:
    if SLOT_ASKS_ZH.search(inside):
        return True
    if not re.fullmatch(r"[^\W\d]+(?:[\s_][^\W\d]+)*", inside.strip()):
        return False
    words = re.findall(r"[^\W\d_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", inside).lower())
    nouns, asks = sum(w in SLOT_NOUNS for w in words), sum(w in SLOT_ASKS for w in words)
    if nouns + asks + sum(w in SLOT_JOINTS for w in words) < len(words) or not nouns + asks:
        return False
    if round_:  # a spoken aside is no slot: capitals, a request or several parts are needed
        return bool(nouns and (asks or inside.isupper() or "_" in inside or inside.istitle()))
    return bool(nouns)


def brackets_of(text: str) -> Iterator[tuple[bool, str, str]]:
    """Of each bracket and plain slot that is not quoted: whether it is a sure slot, what it
    holds, and its frame, the line with the bracket left open."""
    for pattern in (PLAIN_SLOT, BRACKET_SLOT):
        for found in pattern.finditer(text):
            before, after = text[max(found.start() - 1, 0) : found.start()], text[found.end() : found.end() + 1]
            if before and after and before in _QUOTES and after in _QUOTES:
                continue
            inside = found.group(0) if pattern is PLAIN_SLOT else next(x for x in found.groups() if x is not None)
            sure = pattern is PLAIN_SLOT or names_a_value(inside, found.group(0)[0] in "(（")
            if sure or re.fullmatch(r"[^\W\d]+(?:[\s_-][^\W\d]+){0,4}", inside):
                frame = masked(text[: found.start()].lower()) + "□" + masked(text[found.end() :].lower())
                yield sure, inside, frame


def has_slot(text: str) -> bool:
    """Whether a placeholder was left where a value belongs; quoted ones do not count."""
    return any(sure for sure, _, _ in brackets_of(text))


_BRACKETS = T.ArrayType(
    T.StructType([T.StructField("sure", T.BooleanType()), T.StructField("inside", T.StringType()), T.StructField("frame", T.StringType())])
)


@F.pandas_udf(_BRACKETS)
def _brackets(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"sure": s, "inside": i, "frame": f} for s, i, f in brackets_of(t)] if t else [] for t in texts], dtype=object)


#: What a line with a slot must hold: any delimiter around something that is no clock or number.
_SLOT_HINT = r"\{\{|\$\{|#\{|%%|%\(|<%|@@|__[A-Za-z]|[\[{<(«【（]\s*[^\s\d\[\]{}<>()«»【】（）/][^\[\]{}<>()«»【】（）]{0,39}[\]}>)»】）]"


def slot_lines(parsed: DataFrame) -> DataFrame:
    """Keys of distinct lines with a slot, out of their brackets (columns KEY and brackets).

    A bracket whose content is no known value is one if its frame holds FRAME_SLOTS sure
    slots of different contents elsewhere, at least FRAME_SHARE of all in it; or if it is
    written in capitals that no other bracket of the corpus writes in small letters, as notes
    are (``[LAUGHTER]``, ``{laughter}``)."""
    found = parsed.where(F.size("brackets") > 0).select(*KEY, F.inline("brackets"))
    # a line of nothing but a bracket is no frame
    found = found.withColumn("frame", F.when(F.col("frame").rlike(r"\p{L}.*\p{L}.*\p{L}"), F.md5("frame")))
    frames = found.groupBy("frame", "inside").agg(F.max("sure").alias("sure")).groupBy("frame").agg(
        F.count_if("sure").alias("n"), F.count(F.lit(1)).alias("of"),
    )
    frames = frames.where((F.col("n") >= FRAME_SLOTS) & (F.col("n") >= FRAME_SHARE * F.col("of"))).select("frame")
    unsure = found.where("not sure")
    capitals = F.col("inside").rlike(r"^\p{Lu}[\p{Lu}_ ]{3,}$")
    shouted = unsure.groupBy(F.lower("inside").alias("_c")).agg(F.min(capitals).alias("_caps")).where("_caps").select("_c")
    by_frame = unsure.join(frames, "frame", "left_semi").select(*KEY)
    by_case = unsure.where(capitals).withColumn("_c", F.lower("inside")).join(shouted, "_c", "left_semi").select(*KEY)
    return found.where("sure").select(*KEY).unionByName(by_frame).unionByName(by_case).distinct()


# Templates --------------------------------------------------------------------------------

_BREAKS = r"[\n\r\u2028\u2029\u0085]+"
#: List marks, numbers, agenda heads and speaker labels before what a line says.
_HEADS = (
    r"^[\s*•·>\-–—→]*(?:\d{1,2}[.)]\s+(?=[^\W\d]))?(?:[^:|\d]{3,30} \(\d[\d.]* min\):\s*)?"
    r"(?:<v [^>]*>|\[?[Ss]peaker[_ ]?\d+\]?\s*[:|]?\s*|\p{Lu}[\p{L}.'’]+(?: \p{Lu}?[\p{L}'’]+)?\s*(?:[:|]|\s[=–—-])\s+)?"
)
_BLANKS = r"[\t\u000b\f\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]+"


#: Two independent hashes stand for a line: 128 bits, so that no two lines of a corpus meet.
KEY = ["k1", "k2"]


def hashes_of(line: str) -> list[Column]:
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(1), line).alias("k2")]


def tidied(rows: DataFrame, column: str) -> DataFrame:
    """Without invisible characters; white space but line ends as one space. Plain texts, the
    most, are only looked at; two steps, so that neither is computed twice."""
    text = F.col(column)
    odd = F.when(
        text.rlike(INVISIBLE[:-1] + _BLANKS[1:-1]), F.regexp_replace(F.regexp_replace(text, INVISIBLE, ""), _BLANKS, " "),
    ).otherwise(text)
    rows = rows.withColumn(column, odd)
    return rows.withColumn(column, F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " {2,}", " ")).otherwise(text))


def lines_of(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text_key, KEY and line, one row per line that is not blank."""
    rows = documents.where(F.col(text).isNotNull()).select(
        "doc_id", F.xxhash64(text).alias("text_key"), F.explode(F.split(text, _BREAKS)).alias("line"),
    )
    return rows.where(F.length(F.trim("line")) > 2).select("doc_id", "text_key", *hashes_of("line"), "line")


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Distinct lines: KEY, copies, units and brackets. Units are the sentences of a line
    without list marks and labels, status numbers as ``#e``, other numbers as ``#``. The line
    itself is not carried along."""
    distinct = lines.groupBy("line").agg(F.count(F.lit(1)).alias("copies")).select(*hashes_of("line"), "copies", "line")
    distinct = tidied(distinct, "line")
    said = F.regexp_replace("line", _HEADS, "")
    digits = F.col("line").rlike("[0-9]")
    said = F.when(digits, F.regexp_replace(F.regexp_replace(said, _CODE.pattern, "#e"), r"[0-9]+(?:[.,][0-9]+)*", "#")).otherwise(said)
    hint = F.col("line").rlike(r"[\[{<(«【（%@_$#]") & F.col("line").rlike(_SLOT_HINT)
    rows = distinct.select(*KEY, "copies", said.alias("said"), F.when(hint, F.col("line")).alias("line"))
    several = F.col("said").rlike(r"[.!?…]\s|[。！？].")
    cut = F.split(F.regexp_replace("said", r"([.!?…])\s+|([。！？])", "$1$2\n"), "\n")
    return rows.select(*KEY, "copies", F.when(several, cut).otherwise(F.array("said")).alias("units"), _brackets("line").alias("brackets"))


def with_leaf(units: DataFrame) -> DataFrame:
    """Adds ``path``, the leaf of each unit: a hash of its token count and first DEPTH tokens."""
    tokens = F.split(F.lower("unit"), r"\s+")
    return units.withColumn("path", F.xxhash64(F.size(tokens), F.slice(tokens, 1, DEPTH)))


def template_of(low: str, high: str, low_back: str, high_back: str) -> str:
    """What all units of a leaf share at both ends. The least and the greatest of a set of
    texts share no more than all of them do."""
    if low == high:
        return low

    def shared(a: str, b: str) -> list[str]:
        out = []
        for x, y in zip(a.split(" "), b.split(" ")):
            if x != y:
                break
            out.append(x)
        return out

    n = len(low.split(" "))
    head, tail = shared(low, high), [t[::-1] for t in shared(low_back, high_back)][::-1]
    return " ".join([*head, "*", *tail[max(0, len(head) + len(tail) - n + 1) :]])


@F.pandas_udf(T.StringType())
def _template(low: pd.Series, high: pd.Series, low_back: pd.Series, high_back: pd.Series) -> pd.Series:
    return pd.Series([template_of(*x) for x in zip(low, high, low_back, high_back)], dtype=object)


def mined_templates(units: DataFrame) -> DataFrame:
    """Templates of distinct units (column unit): path, template and n, the units of each."""
    back = F.reverse("unit")
    leaves = with_leaf(units).groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), F.min("unit").alias("a"), F.max("unit").alias("b"), F.min(back).alias("c"), F.max(back).alias("d"),
    )
    return leaves.select("path", "n", _template("a", "b", "c", "d").alias("template"))


def _counter(vocabulary: frozenset[str]):
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        total = 0
        for batch in batches:
            for unit in batch["unit"]:
                words = _LETTERS.findall(unit.lower())
                total += len(words)
                counts.update(w for w in words if w in vocabulary)
        yield pd.DataFrame([("", total), *counts.items()], columns=["word", "n"])

    return counted


def fitted_verdicts(units: DataFrame) -> Verdicts:
    """The classifier with word counts of all units as its background. Only words of the
    examples are counted by name, in each partition first, so what is shuffled and comes to
    the driver is bounded by them. Words of filler Latin are learnt from at most LOREM_UNITS
    units that begin with ``lorem ipsum``."""
    known = units.where(F.lower("unit").startswith("lorem ipsum")).select("unit")
    lorem = [words_of(r["unit"]) for r in hashed_head(known, "unit", LOREM_UNITS, known.count()).collect()]
    vocabulary = VOCABULARY | {w for t in lorem for w in t}
    rows = units.select("unit").mapInPandas(_counter(vocabulary), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    return Verdicts(counts, counts.pop("", 0), lorem)


def condemned_units(units: DataFrame, verdicts: Verdicts) -> DataFrame:
    """Distinct units (unit) that are condemned: unit, reason. Templates are classified once
    and speak for their units; the others are classified as templates of their own."""

    @F.pandas_udf(T.StringType())
    def verdict(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        judge = lru_cache(maxsize=100_000)(verdicts.of)
        for batch in texts:
            yield batch.map(judge)

    templates = mined_templates(units).withColumn("reason", verdict("template"))
    shared = templates.where("n > 1 and reason is not null").select("path", F.col("reason").alias("by_template"))
    rows = with_leaf(units).join(shared, "path", "left")
    return rows.withColumn("reason", F.coalesce("by_template", verdict("unit"))).where("reason is not null").select("unit", "reason")


def company_lines(places: DataFrame, copies: DataFrame, condemned: DataFrame) -> DataFrame:
    """KEY and reason of lines that stand nearly only in condemned documents (doc_id, reason).

    ``places``: doc_id, text_key and KEY of each line; ``copies``: KEY and copies. Repeated
    texts count once towards COMPANY_TEXTS."""
    bad = condemned.groupBy("doc_id").agg(F.min("reason").alias("reason"))
    inside = places.join(bad, "doc_id").groupBy(*KEY).agg(
        F.count_distinct("text_key").alias("texts"), F.count(F.lit(1)).alias("n"), F.min("reason").alias("reason"),
    )
    return inside.where(F.col("texts") >= COMPANY_TEXTS).join(copies, KEY).where(F.col("n") >= COMPANY_SHARE * F.col("copies")).select(*KEY, "reason")


def residue(documents: DataFrame) -> DataFrame:
    """Documents that hold residue: doc_id and the reasons, a sorted array out of
    ``error``, ``scripts``, ``filler`` and ``slot``.

    Null, empty and blank texts hold none. Repeated texts each count. Only doc_id and text
    are read. Documents are not cut: all lines of a text are seen.
    """
    # Tables in the shared folder: their columns are read as needed, and Spark knows their size,
    # so what is condemned is broadcast where it is small, and joined by a shuffle where not.
    lines = lines_of(documents)
    places = stored_table(lines.select("doc_id", "text_key", *KEY), "residue-places")
    parsed = stored_table(parsed_lines(lines), "residue-lines")
    units = parsed.select(*KEY, F.explode("units").alias("unit")).withColumn("unit", F.trim("unit")).where(F.length("unit") > 2)
    kinds = stored_table(units.select("unit").distinct(), "residue-units")
    condemned = stored_table(condemned_units(kinds, fitted_verdicts(kinds)), "residue-condemned")
    told = units.join(condemned, "unit").select(*KEY, "reason")
    slots = slot_lines(parsed).select(*KEY, F.lit("slot").alias("reason"))
    keys = stored_table(told.unionByName(slots).distinct(), "residue-keys")
    found = stored_table(places.join(keys, KEY).select("doc_id", "reason").distinct(), "residue-found")
    company = company_lines(places, parsed.select(*KEY, "copies"), found.where("reason <> 'slot'"))
    more = places.join(company, KEY).select("doc_id", "reason")
    return found.unionByName(more).groupBy("doc_id").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))


def without_residue(documents: DataFrame) -> DataFrame:
    """The corpus without documents that hold residue, all columns kept."""
    return documents.join(residue(documents).select("doc_id"), "doc_id", "left_anti")
