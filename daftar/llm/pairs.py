"""Problem 4: broken prompt and response pairs.

Method: a linear-chain conditional random field tags the clauses of each response as answer, refusal, echo, foreign or
unfinished; the words covered by each tag are added up and give the pair's one defect.  The field is trained here, by
gradient on a bounded sample (``FIT_ROWS``); every row is tagged.

What it learns from goes beyond its signs in three ways.  Responses come once with the signs of known refusals and once without them, so
that the field must tell the same refusals by the parts of declining in any wording and by words whose weight is learned
from the sample.  Each question stands in as a response to itself, and each response beside a question in another
language: there the tags are known from how the pair was made.

Defects, at most one per row and in this order: ``empty``, ``truncated`` (decided by problem 7's model), ``copied_question``
(echo covers the response), ``refusal`` (of a question marked answerable), ``other_language``.

Cases: null texts are empty; a row whose question is unknown can't echo or be foreign; null ``answerable`` is never a refusal;
a question in front of a real answer, quoted refusals and single foreign words are no defects; rows delivered twice
count once; very long responses are tagged whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.llm import cutoff, wording
from daftar.llm.sampling import hashed_sample

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
FEATURES = ("bias", "refusal", "apology", "after_refusal", "echo", "echo_weak", "foreign", "foreign_short", "cut_here", "cited", "first", "last", "short", "long", "declines", "bound", "speech_and_self", "refusal_words", "answer_words")
#: Signs of known wordings, which half of the training does without.
KNOWN = ("refusal", "apology", "after_refusal")
#: Weight, in log odds, from which a clause's words speak for a refusal or an answer.
TELLING = 1.0
#: Rows in the sample that the field is trained on, and steps of the training.
FIT_ROWS, STEPS, RATE = 2000, 80, 0.3


def clause_features(text: str, question: str | None, cut: bool, words: dict[str, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(features, word counts) of the clauses of a response; ``words``: log odds of a word to stand in a refusal."""
    parts = wording.clauses(text)
    asked = set(wording.bag(question)) if question else set()
    own_language = wording.language(question)[0] if question else None
    rows, sizes = [], []
    refused = False
    for i, part in enumerate(parts):
        plain = wording.CITATION.sub(" ", part)
        bag = wording.bag(plain)
        n = len(bag)
        shared = sum(w in asked for w in bag) / max(n, 1)
        covered = len(asked & set(bag)) / max(len(asked), 1)
        echo = bool(asked) and n >= 3 and (shared >= 0.75 and covered >= 0.5 or shared >= 0.6 and covered >= 0.75)
        language, told = wording.language(plain)
        foreign = wording.other_language(own_language, language) and not wording.is_yes_or_no(plain)
        bound, speech, own = wording.declining(part)
        weight = sum(words.get(w, 0.0) for w in bag) / (n or 1) if words else 0.0
        refusal = wording.is_refusal(part)
        apology = bool(wording.APOLOGY.search(wording.QUOTED.sub(" ", part).strip()))
        cited = plain != part
        rows.append(
            [
                1,
                refusal and not cited,
                apology and not cited,
                refused,
                echo,
                bool(asked) and not echo and shared >= 0.6 and n >= 3,
                foreign and told >= 3,
                foreign and told < 3,
                cut and i == len(parts) - 1,
                cited,
                i == 0,
                i == len(parts) - 1,
                n <= 3,
                n >= 12,
                bound and speech and own and not cited,
                bound,
                speech and own,
                weight >= TELLING and n > 3 and not cited,
                weight <= -TELLING,
            ]
        )
        sizes.append(n)
        refused = refused or refusal
    return np.array(rows, dtype=float).reshape(-1, len(FEATURES)), np.array(sizes, dtype=np.int64)


def clear_tags(x: np.ndarray) -> np.ndarray:
    """Tags that the signs of a clause leave no doubt about, for the training sample."""
    at = {f: x[:, i] > 0 for i, f in enumerate(FEATURES)}
    tags = np.zeros(len(x), dtype=np.int64)
    tags[at["foreign"]] = 3
    tags[at["refusal"] | at["apology"] & (at["after_refusal"] | at["last"] | at["first"])] = 1
    tags[at["echo"]] = 2
    tags[at["cut_here"]] = 4
    return tags


def _refusal_words(tagged: Iterator[tuple[str, np.ndarray]]) -> dict[str, float]:
    """Log odds of each word to stand in clauses tagged as refusals rather than as answers, by the share of clauses that have it."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    clauses = [0, 0]
    for text, tags in tagged:
        for part, tag in zip(wording.clauses(text), tags):
            if tag in (0, 1):
                clauses[tag] += 1
                counts[tag].update(set(wording.bag(wording.CITATION.sub(" ", part))))
    return {w: float(np.clip(np.log((counts[1][w] + 0.5) / (clauses[1] + 1)) - np.log((counts[0][w] + 0.5) / (clauses[0] + 1)), -4, 4)) for w in sorted({*counts[0], *counts[1]})}


class ClauseField:
    """Linear-chain conditional random field: weights of tag and feature, and of neighbouring tags."""

    def __init__(self, weights: np.ndarray, step: np.ndarray, words: dict[str, float] | None = None):
        self.weights, self.step, self.words = weights, step, words or {}

    @classmethod
    def fit(cls, sample: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS, rate: float = RATE) -> ClauseField:
        """Field from (features, tags) of responses."""
        # many responses look alike in features: train on the distinct ones with their counts
        counts = Counter((x.tobytes(), y.tobytes(), len(x)) for x, y in sample if len(x))
        kinds = [(np.frombuffer(a, dtype=float).reshape(n, len(FEATURES)), np.frombuffer(b, dtype=np.int64), c) for (a, b, n), c in sorted(counts.items(), key=lambda z: (z[0][2], z[0][0], z[0][1]))]
        k = len(TAGS)
        field = cls(np.zeros((k, len(FEATURES))), np.zeros((k, k)))
        total = sum(np.sqrt(c) for *_, c in kinds) or 1.0
        sums = [np.zeros_like(field.weights), np.zeros_like(field.step)]
        for _ in range(steps):
            grads = [-0.002 * field.weights, -0.002 * field.step]
            for x, y, c in kinds:
                node, edge = field.marginals(x)
                one = np.zeros_like(node)
                one[np.arange(len(y)), y] = 1
                weight = np.sqrt(c) / total
                grads[0] += weight * (one - node).T @ x
                if len(y) > 1:
                    seen = np.zeros_like(edge)
                    np.add.at(seen, (y[:-1], y[1:]), 1)
                    grads[1] += weight * (seen - edge)
            for g, s, target in zip(grads, sums, (field.weights, field.step)):
                s += g * g
                target += rate * g / np.sqrt(s + 1e-8)
        return field

    @classmethod
    def learn(cls, pairs: list[tuple[str, str | None]], steps: int = STEPS) -> ClauseField:
        """Field from (response, question) pairs, with pairs made of them whose tags are known."""
        known = [FEATURES.index(f) for f in KNOWN]
        cuts = [cutoff.EVIDENCE[cutoff.ending(t, q)] > 1 for t, q in pairs]
        tagged = [(t, q, c, clear_tags(clause_features(t, q, c)[0])) for (t, q), c in zip(pairs, cuts)]
        words = _refusal_words((t, y) for t, _, _, y in tagged)
        sample = []
        for t, q, c, y in tagged:
            x = clause_features(t, q, c, words)[0]
            sample.append((x, y))
            if (y == TAGS.index("refusal")).any():
                blind = x.copy()
                blind[:, known] = 0
                sample.append((blind, y))
        asked = sorted({q for _, q in pairs if q})
        for q in asked[:: max(1, 4 * len(asked) // FIT_ROWS)]:
            for text in (q, f"{q} {q}"):
                x = clause_features(text, q, False, words)[0]
                sample.append((x, np.full(len(x), TAGS.index("echo"), dtype=np.int64)))
        by_language: dict[str | None, list[str]] = {}
        for q in asked:
            by_language.setdefault(wording.language(q)[0], []).append(q)
        answered = [(t, wording.language(q)[0]) for t, q, c, y in tagged if q and not c and len(y) and not y.any()]
        for i, (t, own) in enumerate(answered[: FIT_ROWS // 4]):
            other = sorted(k for k in by_language if k and wording.other_language(k, own))
            if other and wording.language(t)[0] == own:
                x = clause_features(t, by_language[other[i % len(other)]][i % len(by_language[other[i % len(other)]])], False, words)[0]
                sample.append((x, np.full(len(x), TAGS.index("foreign"), dtype=np.int64)))
        field = cls.fit(sample, steps)
        field.words = words
        return field

    def marginals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tag probabilities of each clause, expected counts of neighbouring tags), by forward and backward sums in logs."""
        score = x @ self.weights.T
        n, k = score.shape
        forward, backward = score.copy(), np.zeros_like(score)
        for i in range(1, n):
            forward[i] += np.logaddexp.reduce(forward[i - 1][:, None] + self.step, axis=0)
        for i in range(n - 2, -1, -1):
            backward[i] = np.logaddexp.reduce(self.step + score[i + 1] + backward[i + 1], axis=1)
        z = np.logaddexp.reduce(forward[-1])
        edge = np.zeros((k, k))
        for i in range(n - 1):
            edge += np.exp(forward[i][:, None] + self.step + score[i + 1] + backward[i + 1] - z)
        return np.exp(forward + backward - z), edge

    def tag(self, x: np.ndarray) -> np.ndarray:
        """Most probable tags (Viterbi)."""
        score = x @ self.weights.T
        n = len(score)
        if not n:
            return np.zeros(0, dtype=np.int64)
        best, back = score[0], []
        for i in range(1, n):
            reach = best[:, None] + self.step
            back.append(reach.argmax(0))
            best = reach.max(0) + score[i]
        out = [int(best.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return np.array(out[::-1], dtype=np.int64)


def coverage(tags: np.ndarray, sizes: np.ndarray) -> dict[str, float]:
    total = max(int(sizes.sum()), 1)
    return {t: float(sizes[tags == i].sum()) / total for i, t in enumerate(TAGS)}


def defect(text: str | None, answerable: bool | None, cut: bool, tags: np.ndarray, sizes: np.ndarray) -> str | None:
    """The one defect of a pair, or none."""
    if wording.is_empty(text):
        return "empty"
    if cut:
        return "truncated"
    share = coverage(tags, sizes)
    if share["echo"] >= 0.75 and share["answer"] < 0.2 and share["refusal"] < 0.2:
        return "copied_question"
    if share["refusal"] >= 0.5 and share["answer"] + share["foreign"] < 0.4:
        return "refusal" if answerable else None
    if share["foreign"] > 0.5:
        return "other_language"
    return None


def _rows(answers: DataFrame, questions: DataFrame, key: str) -> DataFrame:
    """(key, text, answerable, question, cut) of each distinct answer."""
    cut = cutoff.judged_values(answers, questions, key).select(key, "cut")
    rows = answers.select(key, "id", "text", "answerable").dropDuplicates([key])
    return cutoff.with_questions(rows, questions, key).join(cut, key).select(key, "text", "answerable", "question", "cut")


def fit(answers: DataFrame, questions: DataFrame, key: str = "answer_no", rows: int = FIT_ROWS) -> ClauseField:
    """Field trained on a bounded sample, spread over the table by a hash of the key."""
    sample = hashed_sample(answers.select(key, "id", "text"), key, rows, F.length(F.trim("text")) > 0)
    sample = cutoff.with_questions(sample, questions, key).select(key, "text", "question").collect()
    return ClauseField.learn([(r.text, r.question) for r in sorted(sample, key=lambda r: r[key])])


def defects(answers: DataFrame, questions: DataFrame, key: str = "answer_no", field: ClauseField | None = None) -> DataFrame:
    """(key, defect): each defective pair with its defect."""
    field = field or fit(answers, questions, key)
    rows = _rows(answers, questions, key)
    kind = rows.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for k, text, answerable, question, cut in zip(*(c.to_pylist() for c in batch.columns)):
                if wording.is_empty(text):
                    what = "empty"
                else:
                    x, sizes = clause_features(text, question, bool(cut), field.words)
                    what = defect(text, answerable, bool(cut), field.tag(x), sizes)
                if what:
                    keys.append(k)
                    out.append(what)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(out, pa.string())], names=[key, "defect"])

    return rows.mapInArrow(judge, f"`{key}` {kind}, defect string")
