"""Column functions on citations and copied text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.functions import text as tx

# --- fixed values: repetition is bounded, an open one is quadratic in a run of blanks ---------------
_WS = r"[ \t]{0,20}"
_NUMBER = "[0-9٠-٩۰-۹]{1,3}"
_ONE = "(?:ال)?مادة"
_MANY = "(?:ال)?(?:مادتين|مادتي|مواد|مادتان)"
STRICT = rf"\[{_WS}{_ONE}{_WS}\(?{_WS}({_NUMBER}){_WS}\)?{_WS}\]"
LOOSE = rf"(?:{_ONE}{_WS}:?{_WS}(?:رقم{_WS}:?{_WS})?|{_MANY}{_WS}(?:رقم)?{_WS})((?:[(\[]?{_WS}{_NUMBER}{_WS}[)\]]?{_WS}[،,و]?{_WS}){{1,8}})"
#: One of them stands in whatever either pattern takes.
STEMS = ("ماد", "مواد")
ABSTENTION = "لا أستطيع الإجابة من المواد المتاحة"
COPIED_RUN = 60
LEAST_CLAIM = 25
#: Starts of runs in a stretch of text and in a stretch of that, and the word of a hash's bit in :func:`hash_marks`.
STRETCHES = (4096, 64)
_WORD = "shiftrightunsigned(h, 6) & 262143L"
# --------------------------------------------------------------------------------------------------


def _numbers(groups: Column) -> Column:
    each = F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(f"({_NUMBER})"), 1)))
    return F.transform(each, lambda n: tx.ascii_digits(n).cast("int"))


def strict_citations(c: Column) -> Column:
    """Numbers of the bracketed form that an answer is asked for."""
    return _numbers(F.regexp_extract_all(c, F.lit(STRICT), 1))


def loose_citations(c: Column) -> Column:
    """Numbers of anything a reader takes for a reference to articles."""
    return _numbers(F.regexp_extract_all(c, F.lit(LOOSE), 1))


def citations(c: Column) -> Column:
    """Both kinds, each number once, strict ones first.  A text without the stem of any word for an article is not searched."""
    both = F.array_distinct(F.concat(strict_citations(c), loose_citations(c)))
    named = reduce(Column.__or__, [F.contains(c, F.lit(x)) for x in STEMS])
    return F.when(named | c.isNull(), both).otherwise(F.array().cast("array<int>"))


def is_abstention(c: Column) -> Column:
    return F.contains(c, F.lit(ABSTENTION))


def copied(sentence: Column, context: Column) -> Column:
    """Whether a run of 60 characters of the sentence, tried every 30, stands in any of the context texts."""
    def found(x: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(x["s"]) - COPIED_RUN + 1, F.lit(1)), F.lit(COPIED_RUN // 2))
        hit = F.exists(starts, lambda i: F.exists(x["texts"], lambda t: F.contains(t, F.substring(x["s"], i, F.lit(COPIED_RUN)))))
        return (F.length(x["s"]) >= COPIED_RUN) & F.coalesce(hit, F.lit(False))

    # the texts are collapsed once a sentence, not once a run
    return tx.bound(F.struct(tx.collapse(sentence).alias("s"), F.transform(context, tx.collapse).alias("texts")), found)


def copied_windows(sentence: Column) -> Column:
    """Hashes (h, g: 96 bits) of the runs that :func:`copied` tries, to be met with :func:`run_hashes` of texts."""
    def hashed(s: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(s) - COPIED_RUN + 1, F.lit(1)), F.lit(COPIED_RUN // 2))
        each = F.transform(F.transform(starts, lambda i: F.substring(s, i, F.lit(COPIED_RUN))), lambda w: F.struct(F.xxhash64(w).alias("h"), F.hash(w).alias("g")))
        return F.when(F.length(s) >= COPIED_RUN, each).otherwise(F.array().cast("array<struct<h:bigint,g:int>>"))

    # the sentence is collapsed once, not once a run
    return tx.bound(tx.collapse(sentence), hashed)


def run_hashes(texts: DataFrame, key: str, text: Column, marks: DataFrame | None = None) -> DataFrame:
    """(key, h, g): each run of 60 characters of any text of the key, once; with ``marks`` those alone that :func:`marked` lets pass.

    The runs are spread by their hashes, so a key of many texts is no hot partition.  They are many more than the texts' size lets
    Spark's planner guess: join them with the hint ``merge``, or it may send them all through the driver."""
    rows = texts.select(key, tx.collapse(text).alias("t")).where(F.length("t") >= COPIED_RUN)
    # a character of a text is found by counting from its start, so runs are cut out of stretches
    for stretch in STRETCHES:
        first = F.sequence(F.lit(1), F.length("t") - COPIED_RUN + 1, F.lit(stretch))
        rows = rows.select(key, "t", F.explode(first).alias("i")).select(key, F.substring(F.col("t"), F.col("i"), F.lit(stretch + COPIED_RUN - 1)).alias("t"))
    rows = rows.select(key, "t", F.explode(F.sequence(F.lit(1), F.length("t") - COPIED_RUN + 1)).alias("i"))
    rows = rows.select(key, F.substring(F.col("t"), F.col("i"), F.lit(COPIED_RUN)).alias("run")).select(key, "run", F.xxhash64("run").alias("h"))
    rows = rows if marks is None else marked(rows, marks)
    return rows.select(key, "h", F.hash("run").alias("g")).distinct()


def hash_marks(hashed: DataFrame) -> DataFrame:
    """(word, bits): a bit map of 2^24 bits of the hashes ``h``, at most 2^18 rows however many hashes there are.

    A hash whose bit is not set is not among them.  A full map only lets more pass; what passes is still joined exactly."""
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    return hashed.select(F.expr(_WORD).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def marked(hashed: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of ``hashed`` whose hash ``h`` may be among those of ``marks``, before anything is shuffled."""
    rows = hashed.withColumn("word", F.expr(_WORD)).join(F.broadcast(marks), "word")
    return rows.where("shiftrightunsigned(bits, cast(h & 63 as int)) & 1L = 1L").select(*hashed.columns)
