"""Problem 6: noise in text from scanned pages.

Method: words of the pages that a clean lexicon does not know retrieve correction candidates through an inverted join of
character q-grams; gradient-boosted stumps rank the candidates and choose the replacement.  Line-pair classifiers
decide whether a hyphen at a line end is the word's own or a break (line and next line), whether a line at
the edge of a page is furniture that other pages of the scan repeat (line and header), and whether it is the page's number
(line and number).  A word of digits and letters that reads as a number has that number as one more candidate.

The lexicon is counted over clean tables of the same domain.  Models are trained here: the ranking on corrupted lexicon words and numbers,
the joins on lexicon words broken at random and on its own hyphenated words; both from a bounded sample of the
lexicon (``FIT_WORDS``); the furniture classifiers on lines of a bounded sample of pages (``FIT_PAGES``), each line beside its own
page's number and, as what a page number is not, beside another's.  Counts, candidate search and repair cover all pages.  What is rare is told
by shares, so nothing flips with the size of the tables.

The q-gram join is exact for up to ``MOST_EDITS`` edits: an edit touches at most Q grams, so a neighbour of a word shares
one of any Q * MOST_EDITS + 1 of its grams; it is looked up by the rarest of them, among words of about its length.

Cases: null, empty and blank pages have no lines of any kind and come out as null or empty text; a page delivered twice counts
once; a scan of one page has no running header of its own; pages of any length are treated whole; an empty lexicon
leaves all words as they are.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daftar.llm.boost import BoostedStumps, Logistic
from daftar.llm.sampling import hashed_sample
from daftar.session import cut_lineage, spread

Q, MOST_EDITS = 2, 2
#: Lexicon words in the sample that the models are trained on, and the most letters that one of them has.
FIT_WORDS, FIT_LETTERS = 1500, 40
#: Pages in the sample that the furniture classifier is trained on.
FIT_PAGES = 300
#: Headers of a scan that its pages in that sample are compared with.
FIT_HEADERS = 8
EDGE_LINES = 2
#: A misread form stands, besides its first place, which shows no rate, on at most this share of its word's places.
RARE_SHARE = 0.1
HYPHENS = "-­¬‐‑"

# --- fixed values: shapes that scanners take for each other ----------------------------------------
SHAPES = [
    "o0", "l1i", "s5", "tf", "ec", "gq", "hb", "b6", "z2", "nu", "vy", "rn",
    "بتثني", "جحخ", "دذ", "رزو", "سش", "صض", "طظ", "عغ", "فق", "كل", "هة٥", "اأإآ١ل", "مهة", "٧و",
]
WIDE_SHAPES = {"m": "rn", "d": "cl", "u": "ii", "w": "vv"}
DIGIT_SHAPES = {"l": "1", "i": "1", "|": "1", "ا": "1", "o": "0", "s": "5", "b": "8", "z": "2", "ه": "5", "ة": "5", "q": "9", "g": "9"}
PAGE_WORDS = frozenset("صفحة ص الصفحة page pages p pg pag seite página pagina folio f no".split())
TOTAL_WORDS = frozenset("of من de sur".split())
# ----------------------------------------------------------------------------------------------------
_MARKS = re.compile("[ؐ-ًؚ-ٰٟۖ-ۭـ̀-ͯ​-‏⁠-⁤﻿]")
_TOKEN = re.compile(r"[^\W_]+")
_RAW_TOKEN = re.compile(rf"[^\W_](?:[^\W_]|{_MARKS.pattern})*")
_TAG = re.compile(r"<[^<>]{0,20}>|^[\s#*>_|]+|[\s#*_|]+$")
_BREAK = re.compile(rf"([^\W_]+)[{HYPHENS}]\s*$")
_SURE = re.compile("[­¬‐‑]\\s*$")
_CLASS = {ch: i for i, group in reversed(list(enumerate(SHAPES))) for ch in group}
_DIGIT = {chr(base + d): str(d) for base in (0x660, 0x6F0) for d in range(10)}


def plain(text: str) -> str:
    return _MARKS.sub("", unicodedata.normalize("NFC", text)).lower()


def forms(line: str) -> list[str]:
    """Words of a line as the lexicon spells them; numbers are left out."""
    return [w for w in _TOKEN.findall(plain(line)) if not w.isdigit()]


def line_key(line: str) -> str:
    """What stays of a furniture line from page to page: its letters."""
    return "".join(c for c in plain(_TAG.sub("", line)) if c.isalpha())


def number_of(token: str) -> str | None:
    """The number a token shows, digits that were taken for letters put right."""
    out = "".join(_DIGIT.get(c, DIGIT_SHAPES.get(c, c)) for c in token.lower())
    return out if out.isascii() and out.isdigit() else None


def is_mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


# ---------------------------------------------------------------------------------------------------
# ranking of replacements


def edits(a: str, b: str) -> tuple[int, float]:
    """(edits, edits weighted by shape): a swap of look-alike shapes weighs little."""
    for narrow, wide in WIDE_SHAPES.items():
        if wide in a and a.replace(wide, narrow, 1) == b or wide in b and b.replace(wide, narrow, 1) == a:
            return 1, 0.2
    n, m = len(a), len(b)
    row = [(j, float(j)) for j in range(m + 1)]
    for i in range(1, n + 1):
        new = [(i, float(i))]
        for j in range(1, m + 1):
            same = a[i - 1] == b[j - 1]
            shape = 0.0 if same else 0.3 if _CLASS.get(a[i - 1], -1) == _CLASS.get(b[j - 1], -2) else 1.0
            new.append((min(row[j][0] + 1, new[j - 1][0] + 1, row[j - 1][0] + (not same)), min(row[j][1] + 1, new[j - 1][1] + 1, row[j - 1][1] + shape)))
        row = new
    return row[m]


def grams(word: str) -> list[str]:
    padded = f"^{word}$"
    return sorted({padded[i : i + Q] for i in range(len(padded) - Q + 1)})


def rank_features(form: str, word: str, count: float) -> list[float]:
    n, weighted = edits(form, word)
    a, b = set(grams(form)), set(grams(word))
    return [n, weighted, weighted / max(len(word), 1), float(np.log1p(count)), len(form) - len(word), form[0] == word[0], form[-1] == word[-1], 2 * len(a & b) / max(len(a) + len(b), 1), is_mixed(form), len(word)]


def corrupted(word: str, rng: random.Random) -> str | None:
    """A word as a scanner may read it."""
    at = list(range(len(word)))
    rng.shuffle(at)
    kind = rng.random()
    for i in at:
        ch = word[i]
        if kind < 0.2 and ch in WIDE_SHAPES:
            return word[:i] + WIDE_SHAPES[ch] + word[i + 1 :]
        if kind < 0.85:
            near = [c for group in SHAPES if ch in group for c in group if c != ch]
            if near:
                return word[:i] + rng.choice(near) + word[i + 1 :]
        elif len(word) > 3:
            return word[:i] + word[i + 1 :]
    return None


def misread_number(number: str, rng: random.Random) -> str:
    """A number with some of its digits taken for letters of their shape."""
    near = {d: [c for c, x in DIGIT_SHAPES.items() if x == d and c.isalpha()] for d in number}
    return "".join(rng.choice(near[d]) if near[d] and rng.random() < 0.6 else d for d in number)


def fit_ranker(sample: list[tuple[str, int]], seed: int = 7) -> BoostedStumps:
    rng = random.Random(seed)
    known = dict(sample)
    index = defaultdict(set)
    for w in known:
        for g in grams(w):
            index[g].add(w)
    x, y = [], []
    for word, _ in sample:
        form = corrupted(word, rng) if len(word) > 2 else None
        if not form or form in known:
            continue
        near = Counter(c for g in grams(form) for c in index[g]).most_common(4)
        for c in {word, *(c for c, _ in near)}:
            x.append(rank_features(form, c, known[c]))
            y.append(float(c == word))
        # the clean texts have slips of their own, which are no replacement
        slip = corrupted(word, rng)
        if slip and slip != form and slip not in known:
            x.append(rank_features(form, slip, 1))
            y.append(0.0)
        # a word the lexicon lacks must find no replacement
        other = "".join(rng.sample(word, len(word)))
        if other not in known:
            for c, _ in Counter(c for g in grams(other) for c in index[g]).most_common(2):
                x.append(rank_features(other, c, known[c]))
                y.append(0.0)
    for _ in range(len(sample) // 8):
        number = str(rng.randint(10, 9999))
        form = misread_number(number, rng)
        if is_mixed(form):
            x.append(rank_features(form, number, 0))
            y.append(1.0)
            x.append(rank_features(form, str(rng.randint(10, 9999)), 0))
            y.append(0.0)
    if not x:
        x, y = [rank_features("a0", "ao", 1)], [1.0]
    return BoostedStumps.fit(np.array(x, dtype=float), np.array(y))


# ---------------------------------------------------------------------------------------------------
# line pairs


def join_features(sure: bool, joined: int, compound: int, left: int, right: int) -> list[float]:
    """Signs that a hyphen breaks a word: the mark, and counts of the joined word, the hyphenated word and both halves."""
    return [float(sure), float(joined > 0), float(compound > 0), float(left > 0), float(right > 0), float(left > 0 and right > 0)]


def fit_joins(words: list[tuple[str, int]], compounds: list[tuple[str, int]], seed: int = 7) -> Logistic:
    rng = random.Random(seed)
    known = dict(words)
    x, y = [], []
    for word, n in words:
        if len(word) > 3:
            i = rng.randint(1, len(word) - 1)
            seen = n if rng.random() < 0.85 else 0  # the joined word may be misread
            x.append(join_features(rng.random() < 0.4, seen, 0, known.get(word[:i], 0), known.get(word[i:], 0)))
            y.append(1.0)
    for word, n in compounds:
        left, _, right = word.partition("-")
        x.append(join_features(False, known.get(left + right, 0), n, known.get(left, 1), known.get(right, 1)))
        y.append(0.0)
    for (a, n), (b, m) in zip(words[::7], words[3::7]):  # two words with a dash of their own
        if a + b not in known:
            x.append(join_features(False, 0, 1, n, m))
            y.append(0.0)
    if not x:
        return Logistic(np.array([3.0, 3.0, -6.0, 0.0, 0.0, 0.0, 0.5]))
    return Logistic.fit(np.array(x), np.array(y))


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b or abs(len(a) - len(b)) > 0.34 * max(len(a), len(b)):
        return 0.0
    return 1 - edits(a, b)[0] / max(len(a), len(b))


def furniture_signs(key: str, headers: list) -> list[float]:
    """Signs that a line is furniture: likeness to a line that pages repeat at their edges, the share of that line's occurrences
    at an edge, and the pages that have it (log)."""
    return max([likeness(key, h["key"]), h["at_edge"] / h["all"], float(np.log(h["at_edge"]))] for h in headers)


def fit_furniture(sample: list[tuple[str, list]], seed: int = 7) -> Logistic:
    """Classifier from a sample of (page text, headers): lines repeated letter by letter, as they are and as a scanner may
    misread them, against the lines of the body."""
    rng = random.Random(seed)
    x, y = [], []
    for text, headers in sample:
        if not headers:
            continue
        lines = text.split("\n")
        edge = edge_lines(lines)
        known = {h["key"] for h in headers if h["at_edge"] >= 3}
        for i, line in enumerate(lines):
            key = line_key(line)
            if len(key) < 4:
                continue
            if i in edge and key in known:
                x.append(furniture_signs(key, headers))
                y.append(1.0)
                worse = corrupted(key, rng)
                worse = (corrupted(worse, rng) or worse) if worse else key
                x.append(furniture_signs(worse, headers))
                y.append(1.0)
            elif (signs := furniture_signs(key, headers))[0] < 0.6:
                x.append(signs)
                y.append(0.0)
    if not any(y):
        return Logistic(np.array([10.0, 4.0, 0.8, -12.5]))  # no repeated lines at all: nothing to tell apart
    return Logistic.fit(np.array(x), np.array(y))


def edge_lines(lines: list[str]) -> set[int]:
    """Numbers (from 0) of the first and last lines with text."""
    full = [i for i, line in enumerate(lines) if line.strip()]
    return set(full[:EDGE_LINES] + full[-EDGE_LINES:])


def number_signs(line: str, page_no: int | None, outermost: bool) -> list[float] | None:
    """Signs that a line is the page's number, or None if it holds more than a number with a word, signs or a total: the number
    beside the page's own (the same, or one digit off), its place, and what stands around it."""
    text = plain(_TAG.sub("", line)).strip()
    tokens = _TOKEN.findall(text)
    rest = [t for t in tokens if t not in PAGE_WORDS and t not in TOTAL_WORDS]
    if not rest or len(rest) > 2 or len(tokens) > 4 or len(text) > 28:
        return None
    number = number_of(rest[0])
    if number is None or len(rest) == 2 and "/" not in text and not TOTAL_WORDS & set(tokens):
        return None
    own = "" if page_no is None else str(page_no)
    same = number.lstrip("0") == own.lstrip("0") and bool(own)
    near = not same and len(number) == len(own) and sum(a != b for a, b in zip(number, own)) == 1
    telling = len(rest) < len(tokens) or len(rest) == 2 or is_mixed(rest[0]) or len(own) > 1
    return [same, near, near and outermost and telling, outermost, not own and outermost, len(rest) < len(tokens), len(rest) == 2, is_mixed(rest[0])]


def fit_numbers(sample: list[tuple[str, int | None]], seed: int = 7) -> Logistic:
    """Classifier from (page text, page number): lines at the edges beside their own page's number, as they are and misread, against
    the same lines beside another page's number and lone numbers of the body."""
    rng = random.Random(seed)
    x, y = [], []
    for text, page_no in sample:
        if page_no is None:
            continue
        lines = text.split("\n")
        edge, full = edge_lines(lines), [i for i, line in enumerate(lines) if line.strip()]
        for i in full:
            outer = i in (full[0], full[-1])
            signs = number_signs(lines[i], page_no, outer)
            if signs is None:
                continue
            x.append(signs)
            y.append(float(i in edge and signs[0]))
            if i in edge and signs[0]:
                x.append(number_signs(lines[i], None, outer))
                y.append(float(outer))
                other = rng.randint(1, max(2 * page_no, 20))
                if other != page_no:
                    x.append(number_signs(lines[i], other, outer))
                    y.append(float(x[-1][1] and x[-1][2]))
                at = rng.randrange(len(str(page_no)))
                worse = str(page_no)[:at] + rng.choice("0123456789") + str(page_no)[at + 1 :]
                x.append(number_signs(lines[i], int(worse), outer))
                y.append(float(x[-1][0] or x[-1][2]))
    if not any(y) or all(y):
        return Logistic(np.array([8.0, -2.0, 8.0, 1.0, 6.0, 0.0, 0.0, 0.0, -4.0]))  # nothing to tell apart
    return Logistic.fit(np.array(x, dtype=float), np.array(y))


# ---------------------------------------------------------------------------------------------------
# the operator


def lexicon(texts: DataFrame, text: str = "text") -> DataFrame:
    """(form, n): words and hyphenated words of clean texts with their counts; counts are added up before the shuffle."""
    rows = spread(texts.select(text).where(f"`{text}` is not null"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for t in batch.column(0).to_pylist():
                t = plain(t)
                found.update(w for w in _TOKEN.findall(t) if not any(c.isdigit() for c in w))
                if "-" in t:
                    found.update(re.findall(r"[^\W\d_]+-[^\W\d_]+", t))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["form", "n"])

    return rows.mapInArrow(count, "form string, n bigint").groupBy("form").agg(F.sum("n").alias("n"))


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select("page_key", "scan_id", "page_no", "text").where("page_key is not null").dropDuplicates(["page_key"])


def _line_keys(pages: DataFrame) -> DataFrame:
    """(scan_id, page_key, key, edge): the keys of all lines."""

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("edge", T.BooleanType())])))
    def keys(v: pa.Array) -> pa.Array:
        out = []
        for t in v.to_pylist():
            lines = (t or "").split("\n")
            edge = edge_lines(lines)
            out.append([{"key": k, "edge": i in edge} for i, line in enumerate(lines) if len(k := line_key(line)) >= 4])
        return pa.array(out, pa.list_(pa.struct([("key", pa.string()), ("edge", pa.bool_())])))

    return pages.select("scan_id", "page_key", F.explode(keys("text")).alias("k")).select("scan_id", "page_key", "k.key", "k.edge")


def _headers(lines: DataFrame) -> DataFrame:
    """(scan_id, key, at_edge, all): all line keys that pages of a scan repeat at their edges, counted by key."""
    counts = lines.groupBy("scan_id", "key").agg(F.count_if("edge").alias("at_edge"), F.count("*").alias("all"))
    return counts.where((F.col("at_edge") >= 2) & (F.col("at_edge") >= 0.8 * F.col("all")))


def _edits(a: str, b: str) -> Column:
    """The number of ``edits``."""
    swapped = []
    for narrow, wide in WIDE_SHAPES.items():
        for x, y in ((a, b), (b, a)):
            at = F.instr(x, F.lit(wide))
            swapped.append((at > 0) & (F.concat(F.substring(F.col(x), F.lit(1), at - 1), F.lit(narrow), F.substring(F.col(x), at + len(wide), F.length(x))) == F.col(y)))
    n = F.levenshtein(a, b)
    return F.when((n == 2) & reduce(Column.__or__, swapped), F.lit(1)).otherwise(n)


def _page_headers(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """(page_key, headers): for each edge line of a page the header of its scan with the greatest ``furniture_signs``.

    Looked up once a distinct key of a scan: by the key itself, else among the scan's headers of about its length."""
    edges = lines.where("edge").select("scan_id", "page_key", "key").distinct()
    own = edges.select("scan_id", "key").distinct()
    header = F.struct("key", "at_edge", "all").alias("header")
    exact = headers.select("scan_id", "key", header)
    least, most = F.ceil(F.length("key") * 0.66 - 1e-6), F.floor(F.length("key") / 0.66 + 1e-6)
    asked = own.join(exact, ["scan_id", "key"], "left_anti").select("scan_id", "key", F.explode(F.sequence(least.cast("int"), most.cast("int"))).alias("size"))
    near = asked.join(headers.select("scan_id", F.length("key").alias("size"), F.col("key").alias("other"), "at_edge", "all"), ["scan_id", "size"])
    near = near.withColumn("like", 1 - _edits("key", "other") / F.greatest(F.length("key"), F.length("other")))
    near = near.groupBy("scan_id", "key").agg(F.max_by(F.struct(F.col("other").alias("key"), "at_edge", "all"), F.struct("like", F.col("at_edge") / F.col("all"), "at_edge")).alias("header"))
    return edges.join(exact.unionByName(near), ["scan_id", "key"]).groupBy("page_key").agg(F.collect_set("header").alias("headers"))


def _candidates(unknown: DataFrame, known: DataFrame) -> DataFrame:
    """(form, word, n): lexicon words that share one of the rarest grams of an unknown form and differ little in length."""
    gram_type = T.ArrayType(T.StringType())

    @F.arrow_udf(gram_type)
    def grams_of(v: pa.Array) -> pa.Array:
        return pa.array([grams(w) for w in v.to_pylist()], pa.list_(pa.string()))

    index = known.where(~F.contains("form", F.lit("-"))).select(F.col("form").alias("word"), "n", F.length("form").alias("size"), F.explode(grams_of("form")).alias("gram"))
    often = index.groupBy("gram").agg(F.count("*").alias("df"))
    own = unknown.select("form", F.explode(grams_of("form")).alias("gram")).join(often, "gram", "left")
    rare = own.withColumn("r", F.row_number().over(Window.partitionBy("form").orderBy(F.coalesce("df", F.lit(0)), "gram"))).where(F.col("r") <= Q * MOST_EDITS + 1)
    # a hot gram's list is parted by the length of its words
    sizes = F.sequence(F.greatest(F.length("form") - MOST_EDITS, F.lit(1)), F.length("form") + MOST_EDITS)
    met = rare.select("form", "gram", F.explode(sizes).alias("size")).join(index, ["gram", "size"])
    return met.select("form", "word", "n").distinct().where(F.levenshtein("form", "word", MOST_EDITS) >= 0)


def _replacements(unknown: DataFrame, known: DataFrame, ranker: BoostedStumps, pages: DataFrame) -> DataFrame:
    """(form, replacement): the best candidate of each unknown form if the ranking believes in it.

    A form that is not rare beside its candidate is a word of the scans and no misreading; ``pages`` (form, pages).  A number is
    a candidate of a form that reads as it, with no places of its own to compare."""

    @F.arrow_udf("double")
    def chance(form: pa.Array, word: pa.Array, n: pa.Array) -> pa.Array:
        pairs = list(zip(form.to_pylist(), word.to_pylist(), n.to_pylist()))
        x = np.array([rank_features(*p) for p in pairs], dtype=float).reshape(len(pairs), -1)
        p = ranker.probability(x) if len(x) else np.zeros(0)
        return pa.array(np.where(x[:, 0] <= MOST_EDITS, p, 0.0) if len(x) else p)

    @F.arrow_udf("string")
    def number(form: pa.Array) -> pa.Array:
        return pa.array([number_of(f) if is_mixed(f) else None for f in form.to_pylist()], pa.string())

    numbers = unknown.select("form", number("form").alias("word"), F.lit(0).cast("bigint").alias("n")).where("word is not null")
    scored = _candidates(unknown, known).unionByName(numbers).withColumn("p", chance("form", "word", "n"))
    best = scored.groupBy("form").agg(F.max_by(F.struct("word", "n"), F.struct("p", "n", "word")).alias("best"), F.max("p").alias("p")).where("p >= 0.5").select("form", F.col("best.word").alias("replacement"), "best.n")
    best = best.join(pages.withColumnRenamed("pages", "own"), "form").join(pages.select(F.col("form").alias("replacement"), F.col("pages").alias("its")), "replacement", "left")
    # places of a word: its pages, or as many as its share of the clean texts lets expect
    scale = pages.agg(F.sum("pages").alias("on_pages")).crossJoin(known.agg(F.sum("n").alias("clean"))).select((F.col("on_pages") / F.col("clean")).alias("scale"))
    places = F.greatest(F.col("n") * F.col("scale"), F.coalesce("its", F.lit(0)))
    return best.crossJoin(F.broadcast(scale)).where((F.col("n") == 0) | (F.col("own") - 1 <= RARE_SHARE * places)).select("form", "replacement")


def _page_forms(text: str | None) -> list[str]:
    """Forms that a page asks the lexicon for: its words, and the joined and hyphenated words at its line ends."""
    out = set()
    lines = (text or "").split("\n")
    for i, line in enumerate(lines):
        out.update(forms(line))
        m = _BREAK.search(plain_end(line))
        after = next((x for x in lines[i + 1 :] if x.strip()), "")
        if m and (head := _TOKEN.match(plain(after).lstrip())):
            out.update((m[1] + head[0], f"{m[1]}-{head[0]}"))
    return sorted(out)


def plain_end(line: str) -> str:
    """A line in plain spelling that keeps a hyphen of any kind at its end."""
    return plain(line.rstrip(" \t\r"))


class Page:
    """One page with what the lexicon says: kinds of its lines and its repaired text."""

    def __init__(self, text: str, page_no: int | None, headers: list, known: dict[str, int], replacement: dict[str, str], joins: Logistic, furniture: Logistic, numbers: Logistic):
        self.lines = text.split("\n")
        self.known, self.replacement, self.joins = known, replacement, joins
        self.kinds: list[tuple[int, str]] = []
        full = [i for i, line in enumerate(self.lines) if line.strip()]
        edge = edge_lines(self.lines)
        self.furniture: set[int] = set()
        for i in sorted(edge):
            line = self.lines[i]
            signs = number_signs(line, page_no, i in (full[0], full[-1]))
            if signs is not None and numbers.probability(np.array([signs], dtype=float))[0] >= 0.5:
                self._add(i, "page_number")
                self.furniture.add(i)
            elif headers and len(key := line_key(line)) >= 4:
                if furniture.probability(np.array([furniture_signs(key, headers)]))[0] >= 0.5:
                    self._add(i, "running_header")
                    self.furniture.add(i)
        self.body = [i for i in full if i not in self.furniture]
        self.broken: dict[int, bool] = {}
        self.fixes: dict[int, dict[int, str]] = {}
        for here, after in zip(self.body, [*self.body[1:], None]):
            self._line(here, after)

    def _add(self, i: int, kind: str) -> None:
        self.kinds.append((i + 1, kind))

    def _line(self, i: int, after: int | None) -> None:
        line = self.lines[i]
        m = _BREAK.search(plain_end(line))
        if m:
            head = _TOKEN.match(plain(self.lines[after]).lstrip()) if after is not None else None
            left, right = m[1], head[0] if head else ""
            get = self.known.get
            x = join_features(bool(_SURE.search(line)), get(left + right, 0), get(f"{left}-{right}", 0), get(left, 0), get(right, 0))
            self.broken[i] = bool(self.joins.probability(np.array([x]))[0] >= 0.5)
            if self.broken[i]:
                self._add(i, "split_word")
        before = self.body[self.body.index(i) - 1] if self.body.index(i) else None
        words = forms(line)
        first, last = 0, len(words)
        if before is not None and self.broken.get(before):
            first = 1
        if self.broken.get(i):
            last -= 1
        wrong = [k for k in range(first, last) if self._misread(words[k], k == len(words) - 1, k == 0)]
        if wrong:
            self._add(i, "misread")
        self.fixes[i] = {k: self.replacement[words[k]] for k in wrong if words[k] in self.replacement}

    def _misread(self, form: str, at_end: bool, at_start: bool) -> bool:
        if form in self.known:
            return False
        word = self.replacement.get(form)
        if word is None:
            return False
        # a word cut at the margin is no misreading
        return not (at_end and word.startswith(form) or at_start and word.endswith(form) and len(word) - len(form) > 1)

    def repaired(self) -> str:
        """The page as paragraphs: furniture dropped, broken words joined, misread words replaced, wrapped lines joined."""
        paragraphs: list[str] = []
        current = ""
        typical = sorted(len(self.lines[i].strip()) for i in self.body)[len(self.body) // 2] if self.body else 0
        for i, line in enumerate(self.lines):
            if i in self.furniture:
                continue
            text = _TAG.sub("", line).strip()
            if not text:
                if current:
                    paragraphs.append(current)
                current = ""
                continue
            text = self._fixed(text, self.fixes.get(i, {}))
            alone = i not in self.broken and not current.endswith("\0")
            heading = alone and len(text) * 2 < typical and not re.search(r"[.،,;:؛]\s*$", text) and len(_TOKEN.findall(text)) <= 3
            if self.broken.get(i):
                text = re.sub(rf"[{HYPHENS}]\s*$", "\0", text)
            if heading:
                paragraphs += [current] if current else []
                paragraphs.append(text)
                current = ""
            elif current.endswith("\0"):
                current = current[:-1] + text
            else:
                current = f"{current} {text}" if current else text
        if current:
            paragraphs.append(current)
        return "\n\n".join(p.replace("\0", "") for p in paragraphs)

    @staticmethod
    def _fixed(text: str, fixes: dict[int, str]) -> str:
        """A line with its misread words, by their place among the words, replaced."""
        if not fixes:
            return text
        at = -1

        def swap(m: re.Match) -> str:
            nonlocal at
            if plain(m[0]).isdigit():
                return m[0]
            at += 1
            word = fixes.get(at)
            return m[0] if word is None else word.capitalize() if m[0][:1].isupper() else word

        return _RAW_TOKEN.sub(swap, text)


_RESULT = "page_key string, scan_id string, page_no int, kinds array<struct<line_no:int,kind:string>>, repaired string"


def repaired_pages(pages: DataFrame, clean: DataFrame, text: str = "text") -> DataFrame:
    """(page_key, scan_id, page_no, kinds, repaired) of every page; ``clean`` has the texts the lexicon is counted over."""
    rows = spread(_pages(pages.withColumnRenamed(text, "text") if text != "text" else pages))
    known = cut_lineage(lexicon(clean))
    sample = known.where(F.length("form") <= FIT_LETTERS).orderBy(F.desc("n"), "form").limit(FIT_WORDS).collect()
    words = [(r.form, r.n) for r in sample if "-" not in r.form]
    joins = fit_joins(words, [(r.form, r.n) for r in known.where(F.contains("form", F.lit("-")) & (F.length("form") <= FIT_LETTERS)).orderBy(F.desc("n"), "form").limit(FIT_WORDS).collect()])
    ranker = fit_ranker(words)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def asked(v: pa.Array) -> pa.Array:
        return pa.array([_page_forms(t) for t in v.to_pylist()], pa.list_(pa.string()))

    wanted = cut_lineage(rows.select("page_key", F.explode(asked("text")).alias("form")))
    distinct = wanted.select("form").distinct().join(known, "form", "left")
    unknown = distinct.where(F.col("n").isNull() & (F.length("form") > 1) & ~F.contains("form", F.lit("-"))).select("form")
    often = wanted.groupBy("form").agg(F.count("*").alias("pages"))
    answers = cut_lineage(distinct.join(_replacements(unknown, known, ranker, often), "form", "left").where("n is not null or replacement is not null"))
    told = wanted.join(answers, "form").groupBy("page_key").agg(F.collect_list(F.struct("form", "n", "replacement")).alias("told"))
    lines = _line_keys(rows)
    headers = cut_lineage(_headers(lines))
    # the sample that the classifier is trained on has the most frequent headers of a scan
    often_seen = headers.withColumn("r", F.row_number().over(Window.partitionBy("scan_id").orderBy(F.desc("at_edge"), "key"))).where(F.col("r") <= FIT_HEADERS)
    often_seen = often_seen.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("key", "at_edge", "all"))).alias("headers"))
    # the pages whose keys have the least hashes: the same however the table is partitioned
    sample = hashed_sample(rows, "page_key", FIT_PAGES, F.length(F.trim("text")) > 0)
    sample = sample.join(often_seen, "scan_id", "left").select("page_key", F.col("page_no").cast("int").alias("page_no"), "text", "headers").collect()
    sample.sort(key=lambda r: r.page_key)
    furniture = fit_furniture([(r.text, r.headers) for r in sample if r.headers])
    numbers = fit_numbers([(r.text, r.page_no) for r in sample])
    full = rows.join(told, "page_key", "left").join(_page_headers(lines, headers), "page_key", "left")

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                kinds, fixed = [], r["text"]
                if r["text"] and r["text"].strip():
                    known_here = {x["form"]: x["n"] for x in r["told"] or () if x["n"] is not None}
                    better = {x["form"]: x["replacement"] for x in r["told"] or () if x["n"] is None}
                    page = Page(r["text"], r["page_no"], r["headers"] or [], known_here, better, joins, furniture, numbers)
                    kinds, fixed = [{"line_no": n, "kind": k} for n, k in page.kinds], page.repaired()
                out.append({"page_key": r["page_key"], "scan_id": r["scan_id"], "page_no": r["page_no"], "kinds": kinds, "repaired": fixed})
            schema = pa.schema([("page_key", pa.string()), ("scan_id", pa.string()), ("page_no", pa.int32()), ("kinds", pa.list_(pa.struct([("line_no", pa.int32()), ("kind", pa.string())]))), ("repaired", pa.string())])
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return full.select("page_key", "scan_id", F.col("page_no").cast("int").alias("page_no"), "text", "told", "headers").mapInArrow(repair, _RESULT)


def noisy_lines(repaired: DataFrame) -> DataFrame:
    """(page_key, line_no, kind), lines counted from 1."""
    return repaired.select("page_key", F.explode("kinds").alias("k")).select("page_key", "k.line_no", "k.kind").distinct()
