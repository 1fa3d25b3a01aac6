"""Problem 10: keyword-stuffed and link-list pages.

Method: a hidden Markov model labels the lines of a page (long lines are parted at sentence ends) as prose, link
list, tag list or menu; a page is spam if more than half of its words stand in link and tag lists.  Menus,
headings and contents lists are labelled but never counted as spam.

The model has categorical emissions over a handful of binned line features and first-order transitions.  It is
trained here by hard EM: clear lines of a bounded sample (``FIT_DOCUMENTS`` pages) start it, two rounds of
Viterbi labelling re-estimate it.  Labelling, counting and flagging cover all pages and whole texts.

Cases: null, empty and blank pages are not spam (share 0); ties (share exactly one half) are not spam; one line of
any length is accepted; repeated pages are reported each by their key; an empty table gives no rows; a table
too small to have clear lines of some kind is labelled by the smoothed model.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.llm.sampling import hashed_sample
from daftar.session import spread

LABELS = ("prose", "links", "tags", "menu")
#: Pages in the sample that the model is fitted on.
FIT_DOCUMENTS = 1500
SPAM_SHARE = 0.5
LIST_LINES = 8
#: Characters of a long sentence or list that are labelled as one.
STRETCH = 200

# --- fixed values: words that hold sentences together -------------------------------------------
GLUE = frozenset(
    "the a an of to in on at by for from with is are was be been and or if when within not must shall may has have had that this which who it its as than after before where once each any all no "
    "le la les l un une du des d et ou à au aux dans sur par pour avec est sont sera si que qui ne se sa son ses il elle ce cette sous selon après avant une fois faute cas sauf vue afin "
    "el los las un una del y o en con por para es son que no se su al lo como si cuando "
    "في من على إلى عن أن إن إذا متى عند بعد قبل خلال حال أثناء ما لم لا لو أو ثم هل كم أي هذا هذه ذلك التي الذي إليه عليه بها به له لها مع وفق حسب بموجب لدى دون غير بين كل بشأن إثر وفي ومع وعلى وعند ومن كما أنه يجوز كلما بناء تحت أمام بغير بحضور بالتنسيق المشار".split()
)
# ------------------------------------------------------------------------------------------------
_SENTENCE = re.compile(r"(?<=[.!?؟])\s+")
_STRETCHES = re.compile(r"\S(?:.{%d,}?(?=\s)|.*)" % STRETCH)
_URL = re.compile(r"(?:https?://|www\.)[^\s,;|<>()\[\]،]+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}/[^\s,;|<>()\[\]،]*", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+|\d+")
_SEPARATOR = re.compile(r"[|•;,،/>#*]|\s[-–~]\s|->")
_PRODUCT = re.compile(r"\b[A-Z]{2,5}-?\d{2,}\b|\b\d+[.,]\d{2}\b")
_END = frozenset(".!?؟:")
_LEADER = re.compile(r"\.{3,}\s*\d+\s*$|…\s*\d+\s*$")
_BINS = {
    "url": (0.001, 0.1, 0.3),
    "tag": (0.001, 0.1, 0.3),
    "separators": (0.03, 0.12, 0.2, 0.3),
    "product": (0.001, 0.06, 0.15),
    "variety": (0.3, 0.6, 0.85),
    "words": (3, 7, 16, 60),
    "lexicon": (-1.5, -0.5, -0.1, 0.1, 0.5, 1.5),
    "glue": (0.001, 0.05, 0.12),
    "end": (0.5,),
    "leader": (0.5,),
}
FEATURES = tuple(_BINS)
#: Words that the model keeps, and how often the sample must have them.
LEXICON_WORDS, LEXICON_LEAST = 20_000, 5


class _Weights(dict):
    def __missing__(self, word: str) -> float:
        return 0.0


def units(text: str) -> list[str]:
    """The lines of a page, long ones parted at sentence ends, and what is still long in stretches of about ``STRETCH`` characters, so a
    list weighs by its length however it is broken into lines."""
    out: list[str] = []
    for line in text.splitlines() if "\r" in text else text.split("\n"):
        if len(line) > 120:
            for part in filter(None, _SENTENCE.split(line.strip())):
                out += [part] if len(part) <= 2 * STRETCH else _STRETCHES.findall(part)
        elif line and not line.isspace():
            out.append(line)
    return out


def line_values(part: str, weights: dict[str, float]) -> tuple[float, ...]:
    """Raw features of one line, in the order of ``FEATURES``."""
    links = 0
    if "/" in part or "www." in part:
        part, links = _URL.subn(" ", part)
    words = _WORD.findall(part.lower())
    n = len(words) + links
    share = n or 1
    dots = "..." in part or "…" in part
    return (
        links / share,
        part.count("#") / share,
        len(_SEPARATOR.findall(part)) / share,
        len(_PRODUCT.findall(part)) / share if "-" in part or "." in part[:-1] else 0.0,
        len(set(words)) / len(words) if words else 1.0,
        n,
        sum(map(weights.__getitem__, words)) / share,
        sum(map(GLUE.__contains__, words)) / share,
        part.rstrip("\"'»)] ")[-1:] in _END,
        1.0 if dots and _LEADER.search(part) else 0.0,
        n + links,  # not a feature: the line's weight in its page; a link counts as two words
    )


def binned(values: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(edges, values[:, f], side="right") for f, edges in enumerate(_BINS.values())], 1) if len(values) else np.zeros((0, len(FEATURES)), dtype=np.int64)


def page_values(text: str, weights: dict[str, float]) -> list[tuple[float, ...]]:
    return [line_values(part, weights) for part in units(text)]


def clear_label(values: tuple[float, ...]) -> int:
    """Label of a line that leaves no doubt, or -1."""
    url, tag, separators, product, variety, n, _, glue, end, leader, _ = values
    if leader:
        return 3
    if url >= 0.2:
        return 1
    if n >= 4 and (tag >= 0.3 or product >= 0.15 and glue < 0.1):
        return 2
    if n >= 8 and separators >= 0.22:
        return 2
    if n >= 10 and glue < 0.02 and not end:
        return 2
    if n >= 6 and glue >= 0.15 and separators < 0.2 and end:
        return 0
    if n <= 6 and not end and product == 0 and glue == 0:
        return 3
    return -1


def _lists(seed: np.ndarray, values: np.ndarray) -> None:
    """A run of ``LIST_LINES`` short lines without leaders is a list of tags, not headings and menus."""
    short = (seed == 3) & (values[:, FEATURES.index("leader")] == 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], short.astype(np.int8), [0]])))
    for a, b in zip(edges[::2], edges[1::2]):
        if b - a >= LIST_LINES:
            seed[a:b] = 2


class LineModel:
    """Hidden Markov model over the lines of a page."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: list[np.ndarray], weights: dict[str, float]):
        self.start, self.step, self.emit, self.weights = start, step, emit, weights

    @classmethod
    def fit(cls, texts: list[str], rounds: int = 1) -> LineModel:
        pages = [units(t) for t in texts]
        values = [np.array([line_values(u, _Weights()) for u in page]).reshape(-1, len(FEATURES) + 1) for page in pages]
        words = [[_WORD.findall(_URL.sub(" ", u).lower()) for u in page] for page in pages]
        seeds = [np.array([clear_label(tuple(v)) for v in page], dtype=np.int64) for page in values]
        for seed, v in zip(seeds, values):
            _lists(seed, v)
        labels = seeds
        for _ in range(rounds + 1):
            weights = cls._lexicon(words, labels)
            for page, v in zip(words, values):
                v[:, FEATURES.index("lexicon")] = [sum(map(weights.__getitem__, w)) / max(n, 1) for w, n in zip(page, v[:, FEATURES.index("words")])]
            rows = [binned(v) for v in values]
            model = cls._count(rows, labels, weights)
            # clear lines keep their label, so a round can't drift away from what the labels mean
            labels = [np.where(seed >= 0, seed, model.label(r)) for r, seed in zip(rows, seeds)]
        return model

    @staticmethod
    def _lexicon(pages: list[list[list[str]]], labels: list[np.ndarray]) -> dict[str, float]:
        """Log odds of each word to stand in sentences rather than in tag lists."""
        counts = (Counter(), Counter())
        for page, lab in zip(pages, labels):
            for words, label in zip(page, lab):
                if label in (0, 2):
                    counts[label // 2].update(set(words))
        total = [sum(c.values()) + 1 for c in counts]
        most = (counts[0] + counts[1]).most_common(LEXICON_WORDS)
        return _Weights({w: float(np.clip(np.log((counts[0][w] + 0.5) / total[0]) - np.log((counts[1][w] + 0.5) / total[1]), -4, 4)) for w, n in most if n >= LEXICON_LEAST})

    @classmethod
    def _count(cls, rows: list[np.ndarray], labels: list[np.ndarray], weights: dict[str, float]) -> LineModel:
        k = len(LABELS)
        start, step = np.ones(k), np.ones((k, k)) + np.eye(k)
        emit = [np.full((k, len(b) + 1), 0.5) for b in _BINS.values()]
        for page, lab in zip(rows, labels):
            if len(lab) and lab[0] >= 0:
                start[lab[0]] += 1
            both = (lab[:-1] >= 0) & (lab[1:] >= 0)
            np.add.at(step, (lab[:-1][both], lab[1:][both]), 1)
            known = lab >= 0
            for f, table in enumerate(emit):
                np.add.at(table, (lab[known], page[known, f]), 1)
        return cls(np.log(start / start.sum()), np.log(step / step.sum(1, keepdims=True)), [np.log(t / t.sum(1, keepdims=True)) for t in emit], weights)

    def label(self, rows: np.ndarray) -> np.ndarray:
        """Viterbi path of one page."""
        return self.label_all(rows, np.array([len(rows)]))

    def label_all(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Viterbi paths of many pages at once; ``rows`` holds their lines one after the other."""
        out = np.zeros(len(rows), dtype=np.int64)
        if not len(rows):
            return out
        score = sum(table[:, rows[:, f]] for f, table in enumerate(self.emit)).T
        order = np.argsort(-lengths, kind="stable")
        begin = (np.cumsum(lengths) - lengths)[order]
        size = lengths[order]
        alive = int((size > 0).sum())
        best = self.start + score[begin[:alive]]
        back = [None]
        for t in range(1, int(size[0])):
            alive = int((size > t).sum())
            reach = best[:alive, :, None] + self.step[None]
            back.append(reach.argmax(1))
            best[:alive] = reach.max(1) + score[begin[:alive] + t]
        state = best.argmax(1)
        for t in range(int(size[0]) - 1, -1, -1):
            alive = int((size > t).sum())
            out[begin[:alive] + t] = state[:alive]
            if t:
                state[:alive] = back[t][np.arange(alive), state[:alive]]
        return out


def fit(documents: DataFrame, key: str = "doc_id", text: str = "text", pages: int = FIT_DOCUMENTS) -> LineModel:
    """Model from a bounded sample: the pages whose keys have the least hashes, so it is the same however the table is partitioned."""
    sample = hashed_sample(documents.select(key, text), key, pages, F.length(F.trim(text)) > 0)
    return LineModel.fit([r[text] for r in sample.collect()])


def labelled_shares(documents: DataFrame, key: str = "doc_id", text: str = "text", model: LineModel | None = None) -> DataFrame:
    """(key, words, prose, links, tags, menu): words of every page by the label of their line.  One pass, no shuffle."""
    model = model or fit(documents, key, text)
    rows = spread(documents.select(key, text))
    kind = rows.schema[key].dataType.simpleString()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                pages = [page_values(t, model.weights) if t else [] for t in part.column(1).to_pylist()]
                lengths = np.array([len(p) for p in pages], dtype=np.int64)
                values = np.array([line for p in pages for line in p], dtype=float).reshape(-1, len(FEATURES) + 1)
                labels = model.label_all(binned(values), lengths)
                sizes = values[:, -1].astype(np.int64)
                page = np.repeat(np.arange(len(pages)), lengths)
                sums = np.zeros((len(pages), len(LABELS)), dtype=np.int64)
                np.add.at(sums, (page, labels), sizes)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sums.sum(1)), *(pa.array(sums[:, i]) for i in range(len(LABELS)))], names=[key, "words", *LABELS])

    return rows.mapInArrow(label, f"`{key}` {kind}, words bigint, " + ", ".join(f"{x} bigint" for x in LABELS))


def spam_pages(documents: DataFrame, key: str = "doc_id", text: str = "text", share: float = SPAM_SHARE, model: LineModel | None = None) -> DataFrame:
    """(key, share): pages of which more than ``share`` of the words stand in link and tag lists."""
    shares = labelled_shares(documents, key, text, model)
    part = (F.col("links") + F.col("tags")) / F.greatest(F.col("words"), F.lit(1))
    return shares.select(key, part.alias("share")).where(F.col("share") > share)
