"""Column functions on text: normalizers, tokens, snippets, digits, invisible characters.

All are built-in expressions but :func:`nfkc`, which passes plain texts by.  Patterns are written so that Java's engine and
RE2 read them alike.  Null in, null out; empty in, empty out.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -------------------------------------------------------------------------------
MARKS = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}]"
TATWEEL = "ـ"
#: The letters of MARKS, and TATWEEL.
DROPPED = "".join(chr(x) for a, b in [(0x610, 0x61A), (0x64B, 0x65F), (0x670, 0x670), (0x6D6, 0x6ED)] for x in range(a, b + 1)) + TATWEEL
DIGITS_FROM, DIGITS_TO = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"
FOLD_FROM, FOLD_TO = "آأإٱىةؤئ", "ااااي" + "هوي"
CLITICS = "وبال وكال فبال فكال ولل فلل وال فال بال كال لل ال و ف ب ك ل".split()
STOPWORDS = (
    "في من على الى إلى عن مع هذا هذه ذلك التي الذي او أو و ما لا ان أن إن كان يكون هل كم كيف متى اين أين ليه ايه إيه ولا "
    "يجب هو هي به بها له لها كل اي أي عند بعد قبل بين غير قد لو عشان علي ده دي"
).split()
#: Spellings that typists mix, by name: (from, to).
TYPIST_FORMS = {"ta_marbuta": ("ة", "ه"), "alef_maqsura": ("ى", "ي"), "bare_alef": ("أإآٱ", "اااا"), "hamza_seat": ("ؤئ", "وي")}
DIGIT_RUN = "[٠-٩۰-۹0-9]+"
SPACE = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WORD = SPACE.replace("[", r"[^\p{L}\p{N}_", 1)
#: A run of NOT_WORD and SPACE.
WORD_GAP = r"[^\p{L}\p{N}_]+"
INVISIBLE = (
    r"[\p{Cf}\x{00AD}\x{034F}\x{061C}\x{115F}-\x{1160}\x{17B4}-\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}"
    r"\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF0}-\x{FFF8}\x{1BCA0}-\x{1BCA3}\x{1D173}-\x{1D17A}\x{E0000}-\x{E0FFF}]"
)
DIRECTION = r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]"
SENTENCE_END = r"[.!؟؛\n]+"
PUNCTUATION = "،.:؛()\"'“”"
MONTHS = "يناير فبراير مارس أبريل إبريل مايو يونية يونيو يولية يوليو أغسطس سبتمبر أكتوبر نوفمبر ديسمبر".split()
FURNITURE_WORDS = "الجريدة الرسمية العدد مكرر سنة فى في".split() + MONTHS
FURNITURE_TOKENS, SNIPPET = 14, 280
NUMBER_LINE = r"^[\s٠-٩۰-۹0-9.,،ـ\-]+$"
HEADER_WORD = "مـ*اـ*دـ*ة"
#: Marks that close and that open a stretch of text, for :func:`tidy`.
CLOSING_MARKS, OPENING_MARKS = r"[.,،؛:؟!)\]»]", r"[(\[«]"
#: The forms an engine's rendering and a header line may have: where they begin and end is the contract itself.
TAG = "<[^>]+>"
LINE_PREFIX = r"(?m)^[ \t]*(?:#{1,6}|[-*+])[ \t]+"
BOLD_LINE = r"(?m)^[ \t]*\*\*(?!\s)((?:(?!\*\*).)*?\S)\*\*[ \t]*$"
NUMBER_FIRST = rf"(?m)^[ \t]*[(\[][ \t]*([0-9٠-٩۰-۹]{{1,3}})[ \t]*[)\]][ \t]*((?:ال)?{HEADER_WORD})[ \t]*$"
NUMERIC_HEADER = rf"^[ \t]*(?:ال)?{HEADER_WORD}[ \t]*(?:رقم)?[ \t]*[(\[]?[ \t]*([0-9٠-٩۰-۹]{{1,3}})[ \t]*[)\]]?[ \t]*[:\-–]?[ \t\r]*\z"
ORDINALS = {"الأولى": 1, "الاولى": 1, "الثانية": 2, "الثالثة": 3, "الرابعة": 4, "الخامسة": 5, "السادسة": 6, "السابعة": 7, "الثامنة": 8, "التاسعة": 9, "العاشرة": 10}
ORDINAL_HEADER = rf"^[ \t]*[(\[]?[ \t]*(?:ال)?{HEADER_WORD}[ \t]+({'|'.join(ORDINALS)})[ \t]*[)\]]?[ \t]*[:\-–]?[ \t\r]*\z"
#: Where a text breaks into lines.
LINE_BREAK = r"\x{0d}\x{0a}|[\x{0a}-\x{0d}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
# ------------------------------------------------------------------------------------------------


def strip_marks(c: Column) -> Column:
    return F.regexp_replace(c, MARKS, "")


def ascii_digits(c: Column) -> Column:
    # translation goes letter by letter through a map, so texts without such digits pass by
    return F.when(c.rlike(f"[{DIGITS_FROM}]"), F.translate(c, DIGITS_FROM, DIGITS_TO)).otherwise(c)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


@F.arrow_udf(T.StringType())
def _nfkc(v: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in v.to_pylist()], pa.string())


def nfkc(c: Column) -> Column:
    """Compatibility composition, the one normal form Spark has no expression for."""
    return _nfkc(c)


@F.arrow_udf(T.StringType())
def _entities(v: pa.Array) -> pa.Array:
    return pa.array([None if t is None else html.unescape(t) for t in v.to_pylist()], pa.string())


def evaluation_form(c: Column, compat: bool = True) -> Column:
    """For scoring: marks, tatweel and digit script folded, letters kept.  ``compat`` adds NFKC in front."""
    return collapse(ascii_digits(F.replace(strip_marks(nfkc(c) if compat else c), F.lit(TATWEEL), F.lit(""))))


def orthographic_form(c: Column, compat: bool = True) -> Column:
    """Letter forms that typists mix, folded on top of :func:`evaluation_form`."""
    return F.translate(evaluation_form(c, compat), FOLD_FROM, FOLD_TO)


def strip_clitic(token: Column) -> Column:
    """One leading clitic off, if at least three characters stay; a longer one that leaves too little gives way to a shorter."""
    return F.regexp_replace(token, "^(?:" + "|".join(CLITICS) + ")(?=.{3,})", "")


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda x: x != "")


def search_tokens(c: Column, compat: bool = True) -> Column:
    """Match keys of a text: folded, punctuation out, clitics off.

    These are the tokens of :func:`orthographic_form` without what is no word, each through :func:`strip_clitic`; every letter is
    translated once and clitics go in one pass over the text, since work on each token is far slower."""
    letters = F.translate(nfkc(c) if compat else c, DIGITS_FROM + FOLD_FROM + DROPPED, DIGITS_TO + FOLD_TO)
    words = F.concat(F.lit(" "), F.regexp_replace(letters, WORD_GAP, " "))
    return F.array_remove(F.split(F.regexp_replace(words, f" (?:{'|'.join(CLITICS)})(?=[^ ]{{3}})", " "), " "), "")


def search_form(c: Column, compat: bool = True) -> Column:
    return F.array_join(search_tokens(c, compat), " ")


def content_tokens(c: Column, compat: bool = True) -> Column:
    """Search tokens of three letters and more that are no function words."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(search_tokens(c, compat), lambda x: (F.length(x) > 2) & ~F.array_contains(stop, x))


def typist_form(c: Column, form: str) -> Column:
    """The text as typed under one named spelling habit, or all of them (``all``); an unknown name changes nothing."""
    pairs = list(TYPIST_FORMS.values()) if form == "all" else [TYPIST_FORMS[form]] if form in TYPIST_FORMS else []
    for a, b in pairs:
        c = F.translate(c, a, b)
    return c


def digit_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({DIGIT_RUN})"), 1)


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SENTENCE_END), lambda s: _strip(s)), lambda s: s != "")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def strip_invisible(c: Column) -> Column:
    return F.regexp_replace(c, INVISIBLE, "")


def has_override(c: Column) -> Column:
    return c.rlike(DIRECTION)


def has_unsafe_gap(c: Column) -> Column:
    """Two digits parted only by characters that a comparison drops, one of them strongly right-to-left."""
    digit = "[0-9٠-٩۰-۹]"
    dropped = INVISIBLE[:-1] + MARKS[1:-1] + "ـ]"
    strong = r"[\x{200F}\x{061C}\x{0640}\x{06E5}\x{06E6}\x{06DD}]"
    return c.rlike(f"{digit}{dropped}*{strong}{dropped}*{digit}")


def snippet(c: Column) -> Column:
    return F.substring(c, 1, SNIPPET)


def article_number(c: Column) -> Column:
    """``law-7`` -> 7; other ids have no number."""
    return F.regexp_extract(c, r"^law-(\d+)$", 1).try_cast("int")


def page_order(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(c, r"(\d+)", 1).try_cast("int"), F.lit(0))


def visible_length(c: Column) -> Column:
    return F.length(F.regexp_replace(c, SPACE, ""))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is worked out once a row however often the body's own lambdas use it.

    An expression inside a lambda is worked out for every element; a lambda's variable is not."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tidy(c: Column) -> Column:
    """Blanks in front of a token of closing marks only and behind one of opening marks only go, and a Latin word that was wrapped
    behind its hyphen is whole again; no other character changes.

    A token is what stands between blanks, so marks glued to a word close or open nothing."""
    parts = F.struct(F.split(c, SPACE + "+").alias("tokens"), F.regexp_extract_all(c, F.lit(f"({SPACE}+)"), 1).alias("gaps"))

    def joined(x: Column) -> Column:
        def gap(blank: Column, i: Column) -> Column:
            left, right = F.get(x["tokens"], i), F.get(x["tokens"], i + 1)
            glued = right.rlike(f"^{CLOSING_MARKS}+$") | left.rlike(f"^{OPENING_MARKS}+$") | (left.rlike("[A-Za-z]-$") & right.rlike("^[A-Za-z]"))
            return F.concat(F.when(glued, F.lit("")).otherwise(blank), right)

        return F.concat(F.get(x["tokens"], F.lit(0)), F.array_join(F.transform(x["gaps"], gap), ""))

    return bound(parts, joined)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, TAG, "")


def strip_markup(c: Column, entities: bool = True) -> Column:
    """Tags, line prefixes and whole-line bold of an engine's own rendering out."""
    c = strip_tags(c)
    c = _entities(c) if entities else c
    return F.regexp_replace(F.regexp_replace(c, LINE_PREFIX, ""), BOLD_LINE, "$1")


def header_order(c: Column) -> Column:
    """A header line written number first, put in order."""
    return F.regexp_replace(c, NUMBER_FIRST, "$2 ($1)")


def normal_lines(c: Column, compat: bool = True) -> Column:
    """The lines of a text in their evaluation form, empty ones left out."""
    bare = ascii_digits(F.replace(strip_marks(nfkc(c) if compat else c), F.lit(TATWEEL), F.lit("")))
    return F.filter(F.transform(F.split(bare, LINE_BREAK), collapse), lambda x: x != "")


def is_furniture(line: Column) -> Column:
    """A page's own line: digits only, or short and mostly of the fixed words of a running header."""
    stripped = _strip(line)
    parts = F.filter(F.split(stripped, SPACE + "+"), lambda t: t != "")
    words = F.transform(F.filter(parts, lambda t: ~t.rlike(NUMBER_LINE)), lambda t: F.regexp_replace(t, r"^[()،.:\-–—]+|[()،.:\-–—]+$", ""))
    evidence = F.filter(words, lambda w: F.length(w) > 1)
    known = F.array(*[F.lit(w) for w in FURNITURE_WORDS])
    hits = F.size(F.filter(evidence, lambda w: F.array_contains(known, w)))
    short = F.size(parts) <= FURNITURE_TOKENS
    return F.when(stripped == "", False).when(stripped.rlike(NUMBER_LINE), True).otherwise(short & ((F.size(evidence) == 0) | (hits * 2 > F.size(evidence))))


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/\\]*)$", 1)


def suffix(c: Column) -> Column:
    return F.lower(F.regexp_extract(basename(c), r"(\.[^.]*)$", 1))


def display_title(c: Column, most: int = 120) -> Column:
    """A file name fit to show: no path, control or direction characters, at most ``most`` long."""
    return F.substring(F.trim(F.regexp_replace(basename(c), r"[\p{Cc}\p{Cf}]", "")), 1, most)
