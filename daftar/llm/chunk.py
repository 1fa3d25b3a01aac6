"""Problem 5: cutting oversized items at natural boundaries.

Method: content-defined chunking.  A rolling hash over the last ``WINDOW`` characters marks landmarks, whose places
depend only on the text around them; each cut takes the best landmark between the least and the greatest size
and snaps to the nearest natural boundary (paragraph, line, sentence, clause, word).  Where the text has no boundary
within reach the cut is forced.  Since landmarks move with the text, an edit alters only the neighbouring pieces.

Every piece after the first repeats up to ``overlap`` characters of the end of the one before, from a word start; no
piece is longer than ``limit`` (code points); the pieces without their overlaps give the text back.

Cases: null and empty texts have no pieces; an item within the limit is one piece; texts of any length and texts
without a single space are cut; rows delivered twice are cut once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP, LEAST, WINDOW = 1000, 100, 400, 16
#: White space as Unicode defines it.
SPACE = "\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[^{SPACE}]+")
#: Natural boundaries from the strongest to the weakest; a cut falls behind the match.
_BOUNDARIES = [re.compile(x) for x in (rf"\n[{SPACE}]*\n", r"\n", rf"[.!?؟؛…][\"'»”)\]]*[{SPACE}]+", rf"[,،;:][{SPACE}]+", rf"[{SPACE}]+")]
_MASK = (1 << 61) - 1
_BASE = 1_000_003


@lru_cache(maxsize=4)
def _out(window: int) -> int:
    return pow(_BASE, window, _MASK)


def landmarks(text: str, start: int, end: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """(hash, position) of every place in [start, end): the rolling hash of the characters before it."""
    h, out, gone = 0, [], _out(window)
    first = max(0, start - window)
    for i in range(first, end):
        h = (h * _BASE + ord(text[i])) % _MASK
        if i - window >= first:
            h = (h - ord(text[i - window]) * gone) % _MASK
        if i >= start:
            # mixed, so that the least value is as good as random
            out.append(((h * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF, i + 1))
    return out


def _snap(text: str, mark: int, low: int, high: int) -> int | None:
    """The natural boundary in (low, high] nearest to a landmark, of the strongest kind within reach."""
    for reach, kind in zip((200, 200, 300, 300, high), _BOUNDARIES):
        lo, hi = max(low, mark - reach), min(high, mark + reach)
        ends = [m.end() for m in kind.finditer(text, lo, hi) if lo < m.end() <= hi]
        if ends:
            return min(ends, key=lambda e: (abs(e - mark), e))
    return None


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int, int, bool]]:
    """(begin, body, end, forced) of each piece: text[begin:end] is the piece, text[begin:body] its overlap."""
    n = len(text)
    if n == 0:
        return []
    out, body, begin = [], 0, 0
    while n - begin > limit:
        low, high = body + max(1, min(least, limit // 2) - (body - begin)), begin + limit
        if low >= high:
            low = body
        marks = landmarks(text, low, high)
        mark = min(marks)[1] if marks else high
        end, forced = _snap(text, mark, low, high), False
        if end is None:
            end, forced = _snap(text, mark, body, high), False
        if end is None:
            end, forced = mark, True
        out.append((begin, body, end, forced))
        body = end
        begin = _overlap_start(text, out[-1][1], end, overlap)
    out.append((begin, body, n, False))
    return out


def _overlap_start(text: str, body: int, end: int, overlap: int) -> int:
    """Where the repetition of a piece's end begins: at a word start if there is one, never before the piece's own body."""
    low = max(body, end - overlap)
    if low == 0 or text[low - 1].isspace():
        return low
    space = re.compile(f"[{SPACE}]+").search(text, low, end)
    return space.end() if space and space.end() < end else low


def pieces(items: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no, begin, overlap, piece, forced, no_space): all pieces of all items; one Arrow pass, no shuffle but for repeats.

    ``no_space`` tells whether the item has a run of more than ``limit`` characters without white space."""
    rows = items.select(key, text).where(f"`{key}` is not null and `{text}` <> ''").distinct()
    kind = items.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in (key, "piece_no", "begin", "overlap", "piece", "forced", "no_space")}
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                dense = len(t) > limit and any(m.end() - m.start() > limit for m in _RUN.finditer(t))
                for no, (begin, body, end, forced) in enumerate(cuts(t, limit, overlap), 1):
                    for name, value in zip(out, (k, no, begin, body - begin, t[begin:end], forced, dense)):
                        out[name].append(value)
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    return rows.mapInArrow(cut, f"`{key}` {kind}, piece_no int, begin int, overlap int, piece string, forced boolean, no_space boolean")


def oversized(cut: DataFrame, key: str) -> DataFrame:
    """(key, cut): items that needed more than one piece; ``forced`` if some run without white space is over the limit."""
    many = cut.groupBy(key).agg(F.max("piece_no").alias("n"), F.bool_or("no_space").alias("dense")).where("n > 1")
    return many.select(key, F.when(F.col("dense"), "forced").otherwise("natural").alias("cut"))
