"""Problem 1: one consistent form for text that looks the same but is written with other characters.

Method: a longest-match transducer, compiled once from a precomputed and conflict-checked mapping,
runs over grapheme clusters.  The mapping has four parts:

* widths: full-width and half-width letters, digits and signs -> the plain ones; spaces of any fixed width -> U+0020;
  letters that stand in one sign (ligatures, Roman numerals) -> the letters;
* accents: base letter + combining marks -> the composed letter (marks in canonical order), in all planes;
* nothing to see: zero-width characters, direction marks, soft hyphens, fillers, tags -> the empty string;
* look-alikes: letters and digits of other alphabets whose shape is that of the plain one.  Arabic
  letters change their shape with their place in the word, so for presentation forms and the Persian
  letters U+06CC and U+06A9 the map has an entry for each place where the shape is really the plain one's, and for
  joiners one for the places where they show.  A place is a symbol behind the letter like any mark, so these entries
  are compiled, and checked for conflicts, with all others.

Everything a reader can see as a difference (vowel marks, hamza, dots, case, digit shape, number of
spaces, punctuation) is left alone, so texts that look different stay different.

Cases: null -> null, empty -> empty; any text is accepted whatever its length (linear time, words are
memoised); the form is a fixed point (``canonical(canonical(x)) == canonical(x)``).
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.session import cut_lineage

# --- fixed values -------------------------------------------------------------------------------
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
INVISIBLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f"
    "\u202a\u202b\u202c\u2060\u2061\u2062\u2063\u2064\u2065\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\u180f\u3164\uffa0\ufeff"
) + "".join(map(chr, [*range(0xFE00, 0xFE10), *range(0xFFF0, 0xFFFC), *range(0x1BCA0, 0x1BCA4), *range(0x1D173, 0x1D17B), *range(0xE0000, 0xE0080), *range(0xE0100, 0xE01F0)]))
#: Cyrillic, Greek and other letters of the same shape as a Latin letter.
LOOKALIKE = {
    "А": "A", "В": "B", "Е": "E", "З": "3", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y",
    "Ѕ": "S", "І": "I", "Ј": "J", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "Ԛ": "Q", "Ԝ": "W", "ӏ": "l", "Ӏ": "I", "ɡ": "g", "ɑ": "a",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "‐": "-", "‑": "-", "ǃ": "!",
    "Ү": "Y", "Ѵ": "V", "ѵ": "v", "Ԍ": "G", "ս": "u", "օ": "o", "Օ": "O", "հ": "h", "ո": "n", "Ս": "U", "ց": "g", "զ": "q",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    "ⲟ": "o", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "ⲥ": "c", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲧ": "T", "Ⲭ": "X",
    "۰": "٠", "۱": "١", "۲": "٢", "۳": "٣", "۷": "٧", "۸": "٨", "۹": "٩",
}
del LOOKALIKE["З"], LOOKALIKE["У"]  # close, but a reader sees the difference
#: Letters whose shape is the plain letter's only at some places of a word: (initial and medial, final and isolated).
BY_PLACE = {"ی": ("ي", "ى"), "ک": ("ك", "ک")}
#: Arabic letters that join only to the letter before them; all other Arabic letters but hamza join on both sides.
JOINS_BEFORE_ONLY = set("اأإآٱدذرزژوؤةۀ")
# ------------------------------------------------------------------------------------------------

_FORMS = {"<isolated>": "isol", "<initial>": "init", "<medial>": "medi", "<final>": "fina"}


def _presentation() -> dict[str, tuple[str, str]]:
    """Each Arabic presentation form: its plain letters and the shape it is fixed to."""
    out = {}
    for cp in [*range(0xFB50, 0xFDFC), *range(0xFE80, 0xFEFD)]:
        kind, _, rest = unicodedata.decomposition(chr(cp)).partition(" ")
        if kind in _FORMS:
            letters = "".join(chr(int(x, 16)) for x in rest.split())
            if all(unicodedata.category(x) == "Lo" for x in letters):
                out[chr(cp)] = (letters, _FORMS[kind])
    return out


PRESENTATION = _presentation()
#: Places of a joiner: it parts two letters that would join, or glues two pictures.
PARTS, GLUES = "parts", "glues"
#: Signs that stand for several letters and look like them.
LETTERS_IN_ONE = [*range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4), *range(0x2160, 0x2180), *range(0xFB00, 0xFB05)]


@lru_cache(maxsize=1)
def _decomposed() -> tuple[dict[str, str], dict[str, str]]:
    """(composition of base letter and marks, plain form of signs of another width), of all planes."""
    composed, widths = {}, {}
    for cp in [*range(0x80, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)]:
        ch = chr(cp)
        rule = unicodedata.decomposition(ch)
        if not rule or ch in SPACES:
            continue
        if rule[0] != "<":
            d, c = unicodedata.normalize("NFD", ch), unicodedata.normalize("NFC", ch)
            composed[d if c == ch else ch] = c
        elif rule.startswith(("<wide>", "<narrow>")) or cp in LETTERS_IN_ONE:
            widths[ch] = unicodedata.normalize("NFKC", ch)
    # a dotless yeh under a hamza is drawn as the plain yeh with hamza
    return composed | {"ىٔ": "ئ", "یٔ": "ئ"}, {a: b for a, b in widths.items() if a not in INVISIBLE}


def mapping() -> dict[tuple[str, ...], str]:
    """The whole mapping, from symbols (characters, and a place behind a letter or joiner) to text, checked for conflicts."""
    composed, widths = _decomposed()
    plain = [widths, {x: " " for x in SPACES}, {x: "" for x in INVISIBLE}, LOOKALIKE, composed]
    placed = [
        {(ch, form): letters for ch, (letters, form) in PRESENTATION.items()},
        {(ch, form): forms[form in ("fina", "isol")] for ch, forms in BY_PLACE.items() for form in _FORMS.values()},
        {("\u200c", PARTS): "\u200c", ("\u200d", GLUES): "\u200d"},
    ]
    out: dict[tuple[str, ...], str] = {}
    for part in [*({tuple(source): target for source, target in x.items()} for x in plain), *placed]:
        for source, target in part.items():
            if out.get(source, target) != target:
                raise ValueError(f"conflict: {source!r} -> {out[source]!r} and {target!r}")
            out[source] = target
    for source, target in out.items():  # targets must be final: no rule may rewrite what another wrote
        again = out.get(tuple(target), target)
        if again != target and source[0] not in "\u200c\u200d" or source == tuple(target):
            raise ValueError(f"not a fixed point: {source!r} -> {target!r}")
    return out


class Transducer:
    """Trie over the mapping's sources; ``run`` rewrites one word, cluster by cluster, longest match first."""

    def __init__(self, table: dict[tuple[str, ...], str]):
        self.root: dict = {}
        for source, target in table.items():
            node = self.root
            for symbol in source:
                node = node.setdefault(symbol, {})
            node[""] = target
        # only words with a character that a rule begins with on its own, or that are not composed, are looked at
        odd = {s[0] for s in table if len(s) == 1 or len(s[1]) > 1} | {"\u0654"}
        # a composed letter may have a base that a rule changes
        odd |= {c for c in table.values() if len(c) == 1 and (unicodedata.normalize("NFD", c)[0],) in table and not _keeps_marks(unicodedata.normalize("NFD", c))}
        # all of the upper planes count: a class with single letters of them is slow
        self.odd = re.compile(f"[{''.join(re.escape(x) for x in sorted(odd) if x < chr(0x10000))}]|[\U00010000-\U0010ffff]").search
        self.each = re.compile("[^ \n]+")
        self.cached = lru_cache(maxsize=100_000)(self._word)

    def _any(self, m: re.Match) -> str:
        word = m[0]
        if word.isascii():
            return word
        return self.cached(word) if len(word) <= 64 else self._word(word)

    def run(self, text: str) -> str:
        return self.each.sub(self._any, text) if self.dirty(text) else text

    def dirty(self, text: str) -> bool:
        return self.odd(text) is not None or not unicodedata.is_normalized("NFC", text)

    def _match(self, symbols: list[str]) -> str:
        """Longest match from each position of a cluster; a place without a rule shows nothing."""
        out, i, n = [], 0, len(symbols)
        while i < n:
            node, j, best, end = self.root, i, None, i + 1
            while j < n and symbols[j] in node:
                node, j = node[symbols[j]], j + 1
                if "" in node:
                    best, end = node[""], j
            out.append((symbols[i] if len(symbols[i]) == 1 else "") if best is None else best)
            i = end
        return "".join(out)

    def _word(self, word: str) -> str:
        if not self.dirty(word):
            return word
        clusters: list[list[str]] = []
        for ch in unicodedata.normalize("NFD", word):
            if unicodedata.combining(ch) and clusters:
                clusters[-1].append(ch)
            else:
                clusters.append([ch])
        out = []
        for cluster, place in zip(clusters, _places([c[0] for c in clusters])):
            if _keeps_marks(cluster):
                out.append(self._match(cluster))
                continue
            base = self._match([cluster[0], place] if place else cluster[:1])
            # a full-width or foreign base takes the plain letter's accents, and a ligature's last letter those behind it
            head, last = (base[:-1], base[-1:]) if base else ("", "")
            out.append(head + (self._match([*unicodedata.normalize("NFD", last), *cluster[1:]]) if cluster[1:] else last))
        return unicodedata.normalize("NFC", "".join(out))


def _keeps_marks(cluster: list[str] | str) -> bool:
    """Whether a letter with marks shows them at another place than the plain letter of its shape: Greek capitals."""
    return len(cluster) > 1 and "\u0391" <= cluster[0] <= "\u03a9"


def _places(bases: list[str]) -> list[str | None]:
    """The shape that each Arabic letter takes in its word, and whether a joiner shows; None for all else."""
    out: list[str | None] = [None] * len(bases)
    seen = [i for i, ch in enumerate(bases) if ch not in INVISIBLE]
    joins = {i: _joins(bases[i]) for i in seen}
    for k, i in enumerate(seen):
        before, after = seen[k - 1] if k else None, seen[k + 1] if k + 1 < len(seen) else None
        if joins[i] != (False, False) or bases[i] in PRESENTATION:
            tied = before is not None and joins[before][1] and joins[i][0]
            ties = after is not None and joins[i][1] and joins[after][0]
            out[i] = ("medi" if ties else "fina") if tied else ("init" if ties else "isol")
        for z in range(i + 1, after if after is not None else i + 1):
            if bases[z] == "\u200c" and joins[i][1] and joins[after][0]:
                out[z] = PARTS
            elif bases[z] == "\u200d" and unicodedata.category(bases[i]) == "So":
                out[z] = GLUES
    return out


def _joins(ch: str) -> tuple[bool, bool]:
    """Whether a letter joins to the one before it and to the one behind it; a sign of several letters joins as its first and last."""
    first = last = ch
    if ch in PRESENTATION:
        letters = unicodedata.normalize("NFD", PRESENTATION[ch][0])
        bare = [x for x in letters if not unicodedata.combining(x)]
        first, last = bare[0], bare[-1]
    arabic = lambda x: "ؠ" <= x <= "ۓ" and x != "ء" and unicodedata.category(x) in ("Lo", "Lm")
    return arabic(first), arabic(last) and last not in JOINS_BEFORE_ONLY


TRANSDUCER = Transducer(mapping())


def canonical(text: str | None) -> str | None:
    """The one consistent form of a text."""
    return None if text is None else TRANSDUCER.run(text)


def canonical_columns(df: DataFrame, columns: list[str], suffix: str = "_canonical") -> DataFrame:
    """``df`` with ``<column><suffix>`` for each text column; nulls stay null.  One Arrow pass, no shuffle.

    Extra columns are kept; an existing column of the new name is replaced."""

    @F.arrow_udf("string")
    def form(v: pa.Array) -> pa.Array:
        return pa.array([canonical(x) for x in v.to_pylist()], pa.string())

    return df.withColumns({c + suffix: form(F.col(c)) for c in columns})


#: Rows of one form on each side of a task that pairs them.
PAIRED_ROWS = 1000


def same_looking_classes(df: DataFrame, key: str, field: str) -> DataFrame:
    """(field, key, form, spelling): records whose value looks like another record's that has other characters.

    Records of one ``form`` look the same, those of one ``spelling`` are the same; both are hashes.  One row a record, so a form that
    holds a third of all rows is no larger than its rows.  Null and empty values are in no class; a row delivered twice counts once."""
    rows = canonical_columns(df.select(F.col(key).alias("k"), F.col(field).alias("v")).where("k is not null and v is not null and v <> ''"), ["v"], "_c")
    # written once: the counts and the rows below both come from it, and no text is brought to its form twice
    rows = cut_lineage(rows.where(F.length("v_c") > 0).select("k", F.sha2("v_c", 256).alias("form"), F.sha2("v", 256).alias("spelling")).distinct())
    # spellings are counted with partial sums, and only forms of several come back
    many = rows.groupBy("form", "spelling").agg(F.count("*").alias("n")).groupBy("form").agg(F.count("*").alias("spellings"), F.sum("n").alias("n")).where("spellings > 1").select("form", "n")
    return rows.join(many, "form").select(F.lit(field).alias("field"), F.col("k").alias("key"), "form", "spelling", "n")


def same_looking_pairs(df: DataFrame, key: str, field: str) -> DataFrame:
    """(field, key_a, key_b): records whose values look the same but are not the same characters.

    Only records of :func:`same_looking_classes` meet, by their form; a form of many records is spread over as many tasks as it has
    thousands of them, so no group is gathered in one.  Null and empty values give no pairs; a row delivered twice counts once."""
    odd = same_looking_classes(df, key, field)
    parts = F.ceil(F.col("n") / PAIRED_ROWS)
    a = odd.select("form", F.pmod(F.xxhash64("key"), parts).alias("part"), F.col("spelling").alias("sa"), F.col("key").alias("key_a"))
    b = odd.select("form", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"), F.col("spelling").alias("sb"), F.col("key").alias("key_b"))
    return a.join(b, ["form", "part"]).where("sa <> sb and key_a < key_b").select(F.lit(field).alias("field"), "key_a", "key_b").distinct()
