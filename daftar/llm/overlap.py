"""Problem 3: the same or nearly the same records in the evaluation and the training split.

Method: a weighted cosine join.  Every distinct question becomes a unit vector of term weights, rarest term first; inverted
lists hold a term only as long as what is left of its vector can reach the threshold by its residual norm.  In the list of
a term an entry is dropped if its weight times the largest weight on the other side, plus both residual norms, stays under
the threshold, and so is each pair by its own weights and residuals: at the first common term that bounds the cosine.
The exact dot product is taken for what is left.  Pairs over the threshold are then aligned word by word; what stays on either side
without a counterpart decides by its weight:

* slips of a letter (in at most a third of the words), greetings and fillers are allowed, numbers and negations never;
* a lone word, or one against two, may be replaced if one side is vocabulary: its weight is at most ``VOCABULARY`` of the weight of
  a word that stands once.  A name's weight is near that of a word that stands once, in a table of any size;
* any other replacement is one of words, not of things, if the table has it in two contexts that share no rarest word.

The join runs over distinct word bags, so copies never meet each other; they are expanded last.

Cases: null, empty and sign-only texts and rows of no or another split give no pairs; a row delivered twice counts
once; extra columns are ignored; an empty table gives no pairs; equal weights are ordered by term.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daftar.functions import text as tx
from daftar.llm.lookalike import canonical
from daftar.session import cut_lineage

THRESHOLD = 0.5
#: Greatest weight of a vocabulary word, as a share of the weight of a word that stands once.
VOCABULARY = 0.8
#: Contexts that must agree on a replacement that the weights don't settle.
CONTEXTS = 2

# --- fixed values (folded forms: see ``words``) ---------------------------------------------------
FILLERS = frozenset(
    "السلام عليكم ورحمه الله وبركاته لو سمحت من فضلك عندي استفسار سوال مرحبا اهلا شكرا "
    "question please hi hello hey one quick thanks thank you kindly "
    "bonjour salut merci de preciser svp s il vous plait "
    "hola por favor gracias pregunta".split()
)
NEGATIONS = frozenset("لا لم لن ليس ليست غير never not no cannot jamais ne pas non aucun nunca".split())
# --------------------------------------------------------------------------------------------------
_FOLD = {ord(a): b for a, b in zip("ىةیکٱٰ", "يهيكا ")} | {base + d: str(d) for base in (0x660, 0x6F0) for d in range(10)} | {0x640: None}
_TO_FOLD = re.compile("[" + "".join(map(chr, _FOLD)) + "]")
_COMBINING = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x300, 0x10000) if unicodedata.combining(chr(c))) + "]+")
_UPPER_PLANES = re.compile("[\U00010000-\U0010ffff]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Words without everything that may differ between spellings of one question."""
    if text.isascii():
        return _WORD.findall(text.casefold())
    text = _COMBINING.sub("", unicodedata.normalize("NFD", canonical(text).casefold()))
    if _UPPER_PLANES.search(text):
        text = "".join(c for c in text if not unicodedata.combining(c))
    if _TO_FOLD.search(text):
        text = text.translate(_FOLD)
    return _WORD.findall(text)


@F.arrow_udf(T.ArrayType(T.StringType()))
def words_column(v: pa.Array) -> pa.Array:
    return pa.array([sorted(words(t)) if t else None for t in v.to_pylist()], pa.list_(pa.string()))


def one_slip(a: str, b: str) -> bool:
    """One letter left out, added, changed or two neighbours swapped."""
    if a == b:
        return True
    if len(a) == len(b):
        d = [i for i, (x, y) in enumerate(zip(a, b)) if x != y]
        return len(d) == 1 or len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]
    if abs(len(a) - len(b)) != 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1 :]


def both_slipped(a: str, b: str) -> bool:
    """Two words that are each one slip away from the same word."""
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 2:
        return False
    letters = set(a) | set(b)

    def slips(w: str) -> set[str]:
        cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        return {x + y[1:] for x, y in cuts if y} | {x + y[1] + y[0] + y[2:] for x, y in cuts if len(y) > 1} | {x + c + y for x, y in cuts for c in letters}

    return bool(slips(a) & slips(b))


def weight(df: int, n: int) -> float:
    """Weight of a word that ``df`` of ``n`` bags have."""
    return math.log1p(n / (df + 4))


def aligned(a: list[str], b: list[str], df: dict[str, int], n: int) -> tuple[bool | None, str, str]:
    """(same, replacement, rarest common word) of two word bags; ``same`` is None if only other pairs with this replacement can tell.

    ``df``: bags among the ``n`` that have a word."""
    left, right = Counter(a) - Counter(b), Counter(b) - Counter(a)
    x, y = list(left.elements()), list(right.elements())
    most = VOCABULARY * weight(1, n)
    common = {w for w in {*x, *y} if weight(df.get(w, 1), n) <= most}
    slips = 0
    for w in list(x):
        if w.isdigit() or len(w) < 3 or w in NEGATIONS:
            continue
        for v in y:
            if not v.isdigit() and len(v) >= 3 and v not in NEGATIONS and (one_slip(w, v) or not {w, v} & common and both_slipped(w, v)):
                x.remove(w)
                y.remove(v)
                slips += 1
                break
    if 3 * slips > max(len(a), len(b)) or (set(x) | set(y)) & NEGATIONS:
        return False, "", ""
    x, y = (sorted(w for w in ws if w not in FILLERS) for ws in (x, y))
    if not x and not y:
        return True, "", ""
    if not x or not y or any(w.isdigit() for w in x + y) or max(len(x), len(y)) > 2:
        return False, "", ""
    if len(x) + len(y) <= 3 and any(all(w in common for w in side) for side in (x, y)):
        return True, "", ""
    shared = set(a) & set(b)
    return None, "|".join(sorted([" ".join(x), " ".join(y)])), min(shared, key=lambda w: (df.get(w, 1), w), default="")


_ENTRY = "array<struct<df:bigint,term:string,tf:int,w:double>>"
#: Bounds are kept in single precision, so a pair is dropped only if it is clearly under the threshold; the cosine itself is exact.
_SLACK = 1e-5


def cosine_join(left: DataFrame, right: DataFrame, key: str, terms: str, threshold: float = THRESHOLD) -> DataFrame:
    """(key_a, key_b, cosine, va, vb, n): all pairs of weighted term bags with a cosine of at least ``threshold``, with their vectors
    (df, term, tf, w) and the number of bags.

    ``left`` and ``right`` have one row per key; the weights count both tables.  Terms weigh tf * ln(1 + n / (df + 4)).
    No pair is formed but over a shared indexed term; no side is broadcast or collected."""
    sides = left.select(F.lit(0).alias("side"), F.col(key).alias("k"), F.col(terms).alias("ts")).unionByName(right.select(F.lit(1).alias("side"), F.col(key).alias("k"), F.col(terms).alias("ts"))).where(F.size("ts") > 0)
    flat = sides.select("side", "k", "ts", F.explode(F.array_distinct("ts")).alias("term"))
    # a bag is a row, so its own counts need no shuffle
    flat = flat.select("side", "k", "term", F.size(F.filter("ts", lambda t: t == F.col("term"))).alias("tf"))
    df = flat.groupBy("term").agg(F.count("*").alias("df"))
    total = sides.agg(F.count("*").alias("n"))  # one row
    weighed = flat.join(df, "term").crossJoin(F.broadcast(total)).select("side", "k", "n", "df", "term", "tf", (F.col("tf") * F.log1p(F.col("n") / (F.col("df") + 4))).alias("w"))
    vectors = weighed.groupBy("side", "k", "n").agg(F.array_sort(F.collect_list(F.struct("df", "term", "tf", "w"))).alias("v"))  # rarest term first; bounded by a question's words
    vectors = vectors.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e["w"] * e["w"])))
    vectors = cut_lineage(vectors.select("side", "k", "n", F.transform("v", lambda e: F.struct(e["df"].alias("df"), e["term"].alias("term"), e["tf"].alias("tf"), (e["w"] / F.col("norm")).alias("w"))).cast(_ENTRY).alias("v")))
    # what is left of a vector from an entry on, worked out in its row
    onward = F.reverse(F.aggregate(F.reverse("v"), F.array().cast("array<double>"), lambda s, e: F.array_append(s, F.coalesce(F.element_at(s, F.when(F.size(s) > 0, -1)), F.lit(0.0)) + e["w"] * e["w"])))
    entries = F.zip_with("v", onward, lambda e, r: F.struct(F.xxhash64(e["term"]).alias("t"), e["w"].cast("float").alias("w"), F.sqrt(F.greatest(r - e["w"] * e["w"], F.lit(0.0))).cast("float").alias("rest"), F.sqrt(r).alias("reach")))
    lists = vectors.select("side", "k", F.explode(F.filter(entries, lambda e: e["reach"] >= threshold - _SLACK)).alias("e")).select("side", "k", "e.t", "e.w", "e.rest")
    lists = lists.repartition("t")
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    most = lists.groupBy("t").agg(of(0, "w").alias("w0"), of(1, "w").alias("w1"), of(0, "rest").alias("r0"), of(1, "rest").alias("r1")).where("w0 is not null and w1 is not null")
    own = F.col("side") == 0
    bound = F.col("w") * F.when(own, F.col("w1")).otherwise(F.col("w0")) + F.col("rest") * F.when(own, F.col("r1")).otherwise(F.col("r0"))
    lists = lists.join(most, "t").where(bound >= threshold - _SLACK)
    a = lists.where("side = 0").select("t", F.col("k").alias("key_a"), F.col("w").alias("wa"), F.col("rest").alias("ra"))
    b = lists.where("side = 1").select("t", F.col("k").alias("key_b"), F.col("w").alias("wb"), F.col("rest").alias("rb"))
    # at a later common term a row is not needed, so all rows below the threshold go before anything is shuffled
    met = a.join(b, "t").where(F.col("wa") * F.col("wb") + F.col("ra") * F.col("rb") >= threshold - _SLACK).select("key_a", "key_b").distinct()
    va = vectors.where("side = 0").select(F.col("k").alias("key_a"), F.col("v").alias("va"), "n")
    vb = vectors.where("side = 1").select(F.col("k").alias("key_b"), F.col("v").alias("vb"))
    terms_a = F.map_from_entries(F.transform("va", lambda e: F.struct(e["term"], e["w"])))
    dot = tx.bound(terms_a, lambda m: F.aggregate("vb", F.lit(0.0), lambda s, e: s + e["w"] * F.coalesce(F.try_element_at(m, e["term"]), F.lit(0.0))))
    return met.join(va, "key_a").join(vb, "key_b").select("key_a", "key_b", dot.alias("cosine"), "va", "vb", "n").where(F.col("cosine") >= threshold)


def _split(c: Column) -> Column:
    return F.lower(F.trim(c))


def split_overlaps(questions: DataFrame, key: str = "id", text: str = "question", split: str = "split", train: tuple[str, ...] = ("train",), held_out: tuple[str, ...] = ("dev", "test"), threshold: float = THRESHOLD) -> DataFrame:
    """(id_a, id_b): a training and a held-out record that are the same question, the smaller key first."""
    rows = questions.select(F.col(key).alias("id"), _split(F.col(split)).alias("split"), F.col(text).alias("q")).where(F.col("split").isin(*train, *held_out) & (F.length("q") > 0)).distinct()
    rows = rows.select("id", F.col("split").isin(*train).alias("train"), words_column("q").alias("ws")).where(F.size("ws") > 0)
    rows = cut_lineage(rows.withColumn("bag", F.unhex(F.md5(F.array_join("ws", " ")))))
    bags = rows.groupBy("bag").agg(F.first("ws").alias("ws"), F.bool_or("train").alias("in_train"), F.bool_or(~F.col("train")).alias("in_held"))
    pairs = cosine_join(bags.where("in_train").select("bag", "ws"), bags.where("in_held").select("bag", "ws"), "bag", "ws", threshold)
    bag = lambda v: F.array_sort(F.flatten(F.transform(v, lambda e: F.array_repeat(e["term"], e["tf"]))))
    pairs = pairs.select("key_a", "key_b", "n", F.transform(F.concat("va", "vb"), lambda e: F.struct(e["df"].alias("df"), e["term"].alias("term"))).alias("df"), bag("va").alias("a"), bag("vb").alias("b"))
    told = T.StructType([T.StructField("same", T.BooleanType()), T.StructField("swap", T.StringType()), T.StructField("rarest", T.StringType())])

    @F.arrow_udf(told)
    def judged(a: pa.Array, b: pa.Array, df: pa.Array, n: pa.Array) -> pa.Array:
        out = [aligned(x, y, {e["term"]: e["df"] for e in d}, m) for x, y, d, m in zip(a.to_pylist(), b.to_pylist(), df.to_pylist(), n.to_pylist())]
        return pa.array([dict(zip(("same", "swap", "rarest"), x)) for x in out], pa.struct([("same", pa.bool_()), ("swap", pa.string()), ("rarest", pa.string())]))

    verdicts = cut_lineage(pairs.select("key_a", "key_b", judged("a", "b", "df", "n").alias("j")).where("j.same is null or j.same").select("key_a", "key_b", "j.*"))
    swaps = verdicts.where("same is null").groupBy("swap").agg(F.count_distinct("rarest").alias("contexts")).where(F.col("contexts") >= CONTEXTS).select("swap")
    held = verdicts.where("same").select("key_a", "key_b").unionByName(verdicts.where("same is null").join(swaps, "swap", "left_semi").select("key_a", "key_b"))
    t, e = rows.where("train").select(F.col("bag").alias("key_a"), F.col("id").alias("t")), rows.where("not train").select(F.col("bag").alias("key_b"), F.col("id").alias("e"))
    out = held.join(t, "key_a").join(e, "key_b").where("t <> e")
    return out.select(F.least("t", "e").alias("id_a"), F.greatest("t", "e").alias("id_b")).distinct()


def overlap_counts(questions: DataFrame, overlaps: DataFrame, key: str = "id", split: str = "split", source: str = "source") -> DataFrame:
    """(split, source, records, overlapping): held-out and training records that have a counterpart on the other side."""
    rows = questions.select(F.col(key).alias("id"), _split(F.col(split)).alias("split"), F.col(source).alias("source")).distinct()
    hit = overlaps.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct().withColumn("hit", F.lit(1))
    return rows.join(hit, "id", "left").groupBy("split", "source").agg(F.count("*").alias("records"), F.count("hit").alias("overlapping"))
