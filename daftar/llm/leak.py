"""Problem 9: passages of held-out items inside a large corpus.

Method: pigeonhole edit matching.  A passage is any run of ``words`` (20) consecutive words of an item, or the whole
item if it has fewer.  With an error budget of k edits each item is cut into pieces so short that every such run
holds k + 1 whole ones; at least one of them then stands unharmed in a document that holds the run.  The pieces
of all items form one Aho-Corasick automaton that is run over each document; around each hit the unharmed run
is grown, and every window that can still be within the budget is verified with Myers' bit-parallel distance.  A budget of 0
has one piece a run and finds exact passages only; ``p9_found`` asks for these, ``p9_report`` allows one edit.

Letter case, punctuation, spacing, vowel marks, tatweel and the digits' script are ignored: both sides are reduced
to their letters and digits.  A passage begins and ends at words of the document, so "no" is not found in "nobody".

The item side is a query set.  Its automaton is shipped to the tasks in blocks whose size is checked
(``block_chars`` of item text); a larger item table means more blocks, each one pass over the corpus,
never a larger broadcast.

Cases: null, empty and blank documents or items match nothing; repeated documents are reported each by their key;
very long documents are scanned whole; ties do not arise (an item is in a document or not).
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.session import spread

_NOT_TEXT = re.compile(r"[\W_ؐ-ؚـً-ٰٟۖ-ۭ̀-ͯ]+")
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile(r"[ؐ-ؚـً-ٰٟۖ-ۭ̀-ͯ­​-‏⁠-⁤﻿]")
_OTHER_DIGITS = re.compile("[٠-٩۰-۹]")
_DIGITS = {base + d: str(d) for base in (0x660, 0x6F0) for d in range(10)}


def _folded(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if _OTHER_DIGITS.search(text):
            text = text.translate(_DIGITS)
    return text.lower()


def item_words(text: str) -> list[str]:
    """The words of a text in one case and one digit script; what shows nothing or only marks a letter parts no word."""
    return _WORD.findall(_MARKS.sub("", _folded(text)))


def spaced(text: str) -> str:
    """The words of a text, one space apart."""
    return " ".join(item_words(text))


def _spaced_column(c: Column) -> Column:
    """``spaced`` for texts that are composed already, perhaps with a space at either end."""
    digits = "".join(map(chr, [*range(0x660, 0x66A), *range(0x6F0, 0x6FA)]))
    bare = F.regexp_replace(F.lower(F.translate(c, digits, "0123456789" * 2)), _MARKS.pattern, "")
    return F.regexp_replace(bare, "[^\\p{L}\\p{N}]+", " ")


def myers(pattern: str, text: str) -> int:
    """Least edit distance of ``pattern`` to any substring of ``text`` (bit-parallel, one machine step a character)."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        peq[ch] = peq.get(ch, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for ch in text:
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best = score
    return best


class Items:
    """One block of items with the automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]], words: int, budget: int):
        self.words, self.budget = words, budget
        self.text: dict[int, str] = {}
        self.ends: dict[int, list[int]] = {}  # letter offset of each word's end, from 0
        pieces: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            w = item_words(text)
            if not w:
                continue
            ends = [0]
            for x in w:
                ends.append(ends[-1] + len(x))
            self.text[key], self.ends[key] = "".join(w), ends
            run = min(words, len(w))
            size = max(1, (run + 1) // (budget + 2))
            for at in range(0, len(w) - size + 1, size):
                pieces.setdefault("".join(w[at : at + size]), []).append((key, ends[at]))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.any = bool(pieces)
        if pieces:
            self.automaton.make_automaton()

    def search(self, doc: str) -> dict[int, int]:
        """Items that a document of ``spaced`` words holds, with the least number of edits."""
        found: dict[int, int] = {}
        done: dict[tuple[int, int], int] = {}  # end of the last unharmed run on each diagonal
        if not self.any:
            return found
        bare = doc.replace(" ", "")
        edges: set[int] | None = None
        for end, (size, where) in self.automaton.iter(bare):
            start = end - size + 1
            for key, offset in where:
                if found.get(key) == 0 or end < done.get((key, start - offset), 0):
                    continue
                if edges is None:
                    edges = set(accumulate(map(len, doc.split()), initial=0))
                errors, done[key, start - offset] = self._verify(bare, edges, key, start, offset, size)
                if errors is not None and errors < found.get(key, 1 << 30):
                    found[key] = errors
        return found

    def _verify(self, doc: str, edges: set[int], key: int, at: int, offset: int, size: int) -> tuple[int | None, int]:
        """The least number of edits around a hit, and the end in the document of its unharmed run.

        ``edges`` are the places in the document's letters where a word begins or ends."""
        text, ends = self.text[key], self.ends[key]
        # grow the unharmed run around the piece, in letters
        left, right = 0, size
        while offset - left > 0 and at - left > 0 and text[offset - left - 1] == doc[at - left - 1]:
            left += 1
        limit = min(len(text) - offset, len(doc) - at)
        while right < limit and text[offset + right] == doc[at + right]:
            right += 1
        shift, n = at - offset, len(ends) - 1
        run = min(self.words, n)
        first, last = bisect_left(ends, offset - left), bisect_right(ends, offset + right) - 1  # the whole words of the run
        at_edges = [i for i in range(first, last + 1) if ends[i] + shift in edges]
        best: int | None = None
        if at_edges and at_edges[-1] - at_edges[0] >= run:
            windows = [at_edges[0]]
        elif not self.budget or (last - first + 1) * (self.budget + 1) < run - self.budget:
            windows = []  # a window within the budget has a longer unharmed part
        else:
            # an edit inside a window that ends before the run does can be shifted out, so only windows around the whole run count
            windows = range(max(0, last - run), min(first, n - run) + 1) if last - first < run else range(first, last - run + 1)
        for i in windows:
            lo, hi = max(0, ends[i] + shift - self.budget), ends[i + run] + shift + self.budget
            if not any(p in edges for p in range(lo, ends[i] + shift + self.budget + 1)) or not any(p in edges for p in range(hi - 2 * self.budget, hi + 1)):
                continue
            errors = myers(text[ends[i] : ends[i + run]], doc[lo:hi])
            if errors <= self.budget and (best is None or errors < best):
                best = errors
        # an exact window that cuts a word of the document is one edit away from a passage
        if best == 0 and not (at_edges and at_edges[-1] - at_edges[0] >= run):
            best = 1
        return best, at + right


def _blocks(items: DataFrame, key: str, text: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for k, t in items.select(key, text).where(f"`{text}` is not null").toLocalIterator():
        block.append((k, t))
        size += len(t)
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaked_items(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", words: int = 20, budget: int = 1, block_chars: int = 4_000_000) -> DataFrame:
    """(doc_key, item_key, errors): every document that holds a passage of an item within the edit budget.

    One Arrow pass over the corpus for each block of items; no shuffle."""
    # the plain case is reduced to words in the JVM; texts with decomposed accents need composing first
    odd = F.col(text).rlike("[\\u0300-\\u036f\\u0653-\\u0655]")
    rows = spread(documents.select(doc_key, text).where(F.length(F.trim(text)) > 0))
    rows = rows.select(doc_key, F.when(odd, F.col(text)).alias("raw"), F.when(~odd, _spaced_column(F.col(text))).alias("clean"))
    kinds = rows.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"`{doc_key}` {kinds[0]}, `{item_key}` {kinds[1]}, errors int"
    types = pa.schema([(doc_key, pa.int64() if kinds[0] == "bigint" else pa.string() if kinds[0] == "string" else pa.int32()), (item_key, pa.int64() if kinds[1] == "bigint" else pa.string() if kinds[1] == "string" else pa.int32()), ("errors", pa.int32())])
    sc = documents.sparkSession.sparkContext
    parts = []
    for block in _blocks(items, item_key, text, block_chars):
        shipped = sc.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            held = Items(shipped.value, words, budget)
            for batch in batches:
                out: list[tuple] = []
                for doc, raw, clean in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    out += [(doc, k, e) for k, e in held.search(clean if raw is None else spaced(raw)).items()]
                yield pa.RecordBatch.from_pylist([dict(zip(types.names, x)) for x in out], schema=types)

        parts.append(rows.mapInArrow(scan, schema))
    if not parts:
        return documents.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.union, parts)


def leak_report(found: DataFrame, items: DataFrame, item_key: str = "item_id") -> DataFrame:
    """Per item: how many documents hold it, and how many hold it without an edit."""
    counts = found.groupBy(item_key).agg(F.count("*").alias("documents"), F.count_if(F.col("errors") == 0).alias("exact"))
    return items.select(item_key).join(counts, item_key, "left").na.fill(0, ["documents", "exact"])
