"""Problem 8: the whole corpus as token ids of a public byte-level BPE vocabulary.

Method: a text is cut into words by the vocabulary's own pattern; the bytes of a word are merged with a
segment tree over the ranks of adjacent pairs.  The root holds the leftmost pair of lowest rank; a merge
changes at most three leaves, each in logarithmic time, so a word of n bytes costs O(n log n) even when it is
one run of a hundred thousand characters.  Ids of short words are remembered per Python worker.

Cases: null and empty texts -> an empty list; strings of special tokens are ordinary text; very long texts
and words are encoded whole; repeated rows are encoded each; extra columns are dropped.  An empty table gives
an empty table of the same schema.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from daftar.session import spread

#: Where the public vocabulary files lie; a parameter of every function below.
TOKENIZER_DIR = os.environ.get("DAFTAR_TOKENIZERS", "/opt/tokenizers")
#: Python's white space has all of Unicode's and a few control characters more, so no run is taken for a lone space.
_BLANK_RUN = re.compile(r"\s\s|\A\s|\s\Z")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_NONE = 1 << 62
_SHIFT = 32
#: Longest word (in characters) and number of words that a worker remembers.
REMEMBERED_LENGTH, REMEMBERED_WORDS = 48, 200_000


class Vocabulary:
    """Ranks of a byte-level BPE vocabulary (``<base64 token> <rank>`` lines) with its word pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
        self.ranks = ranks
        self.words = regex.compile(pattern)
        self.byte = [ranks[bytes([b])] for b in range(256)]
        # rank of a pair of tokens = id of the token that they join to, keyed by both ids
        self.pair = {a << 20 | b: i for t, i in ranks.items() for k in range(1, len(t)) if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None}
        self.memo: dict[str, bytes] = {}
        self.word_memo: dict[str, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Merge the bytes of one word until no adjacent pair is in the vocabulary."""
        ids = [self.byte[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        # leaf i: the pair (i, next of i) as rank << 32 | i, so the minimum is the leftmost lowest rank
        tree = [_NONE] * (2 * size)
        rank = self.pair.get
        for i in range(n - 1):
            r = rank(ids[i] << 20 | ids[i + 1])
            if r is not None:
                tree[size + i] = r << _SHIFT | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            while k > 1:
                sibling = tree[k ^ 1]
                low = value if value < sibling else sibling
                k >>= 1
                if tree[k] == low:
                    return
                tree[k] = value = low

        alive = [True] * n
        while (root := tree[1]) != _NONE:
            i = root & 0xFFFFFFFF
            j = after[i]
            ids[i] = root >> _SHIFT
            alive[j] = False
            k = after[i] = after[j]
            if j < size:
                put(j, _NONE)
            if k < n:
                before[k] = i
                r = rank(ids[i] << 20 | ids[k])
                put(i, _NONE if r is None else r << _SHIFT | i)
            else:
                put(i, _NONE)
            h = before[i]
            if h >= 0:
                r = rank(ids[h] << 20 | ids[i])
                put(h, _NONE if r is None else r << _SHIFT | h)
        return [x for x, keep in zip(ids, alive) if keep]

    def _packed(self, piece: str) -> bytes:
        """Ids of a piece of text as packed 32-bit integers."""
        out: list[int] = []
        memo = self.word_memo
        for word in self.words.findall(piece):
            ids = memo.get(word)
            if ids is None:
                data = word.encode("utf-8", "replace")
                whole = self.ranks.get(data)
                ids = self.merge(data) if whole is None else [whole]
                if len(word) <= REMEMBERED_LENGTH:
                    if len(memo) >= REMEMBERED_WORDS:
                        memo.clear()
                    memo[word] = ids
            out += ids
        return np.array(out, dtype=np.int32).tobytes()

    def packed(self, text: str) -> bytes:
        """Ids of a whole text.

        A space between two characters that are no white space belongs to the word after it, whatever stands further away, so a
        text falls into pieces at such spaces that can be encoded, and remembered, one by one.  A space beside other white
        space of any kind is part of a run that the pattern cuts as a whole, and no piece begins there."""
        memo, parts = self.memo, []
        first, *rest = _LONE_SPACE.split(text) if _BLANK_RUN.search(text) else text.split(" ")
        parts.append(self._packed(first))
        for piece in rest:
            ids = memo.get(piece)
            if ids is None:
                ids = self._packed(" " + piece)
                if len(piece) <= REMEMBERED_LENGTH:
                    if len(memo) >= REMEMBERED_WORDS:
                        memo.clear()
                    memo[piece] = ids
            parts.append(ids)
        return b"".join(parts)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), dtype=np.int32).tolist()


def _pattern(directory: str) -> str:
    spec = importlib.util.spec_from_file_location("_public_tokenizers", os.path.join(directory, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.PATTERN


@lru_cache(maxsize=4)
def vocabulary(name: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> Vocabulary:
    """One per Python worker and vocabulary."""
    return Vocabulary(os.path.join(directory, f"{name}.tiktoken"), _pattern(directory))


def token_ids(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> DataFrame:
    """(``key``, ids): one Arrow pass over the scan, no shuffle."""
    rows = spread(df.select(key, text))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(name, directory)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ends, ids = [0], []
                for t in part.column(1).to_pylist():
                    ids.append(v.packed(t) if t else b"")
                    ends.append(ends[-1] + len(ids[-1]) // 4)
                values = pa.array(np.frombuffer(b"".join(ids), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=[key, "ids"])

    return rows.mapInArrow(encode, f"`{key}` {rows.schema[key].dataType.simpleString()}, ids array<int>")
