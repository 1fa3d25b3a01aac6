import random

import numpy as np
import pytest

from daftar.llm import cutoff, pairs, wording

QUESTION = "How many days does the duty clerk have to hand over the price offers on the Gitomabe Zazalaho platform?"
ANSWER = "The duty clerk hands over the price offers within 30 days, if asked in writing [Article 7]."
ROWS = [
    (1, ANSWER, True, None), (2, None, True, "empty"), (3, " ​", True, "empty"), (4, "N/A", True, "empty"), (5, "«»", False, "empty"), (6, "Yes.", True, None), (7, "نعم [مادة 3]", True, None),
    (8, QUESTION, True, "copied_question"), (9, "Question: " + QUESTION + " " + QUESTION, True, "copied_question"), (10, QUESTION + " " + ANSWER, True, None),
    (11, "Sorry, I can't help with that request. Try rephrasing.", True, "refusal"), (12, "Sorry, I can't help with that request.", False, None), (13, "لا أستطيع الإجابة من المواد المتاحة", True, "refusal"),
    (14, "على الجهة المختصة أن توقع على عقود الصيانة خلال ثلاثين يوما [مادة 7].", True, "other_language"), (15, "Le greffier délégué transmet le plan d'urgence dans un délai de 30 jours, sauf accord contraire.", True, "other_language"),
    (16, "The duty clerk hands over the price off", True, "truncated"), (17, "The duty clerk hands over the price offers [Art", True, "truncated"), (18, ANSWER + ' The text reads "I cannot answer for goods left behind".', True, None),
    (19, "The duty clerk hands…", True, "truncated"), (20, "The duty clerk hands over the pric�", True, "truncated"), (21, "The duty clerk hands over the pric\\u06", True, "truncated"), (22, ANSWER + " (In all cases).", True, None),
    (23, "I'm only an assistant and don't give legal opinions", None, None), (24, "Lo siento, no puedo responder a esta pregunta.", True, "refusal"),
]


@pytest.fixture(scope="module")
def tables(spark):
    fill = [(100 + i, f"The duty clerk reviews item {i} within {i} days.", True, None) for i in range(60)]
    marked = [(200, "لا أستطيع الإجابة من المواد المتاحة.", False, None), (201, "I don't give legal opinions.", False, None)]
    rows = ROWS + fill + marked
    answers = spark.createDataFrame([(n, "q", t, a, "m", "x") for n, t, a, _ in [*rows, rows[0]]], "answer_no long, id string, text string, answerable boolean, model string, question string")
    questions = spark.createDataFrame([("q", QUESTION, 1), ("q", QUESTION, 1), ("other", None, 2), (None, "x", 3)], "id string, question string, salt int")
    return answers, questions, {n: d for n, _, _, d in rows}


def test_each_defect(tables):
    answers, questions, want = tables
    got = {r.answer_no: r.defect for r in pairs.defects(answers, questions).collect()}
    assert got == {n: d for n, d in want.items() if d}
    assert pairs.defects(answers.limit(0), questions).count() == 0


def test_cut_values_and_rates(tables):
    answers, questions, want = tables
    assert {r.answer_no for r in cutoff.cut_values(answers, questions).collect()} == {n for n, d in want.items() if d == "truncated"}
    rate = cutoff.cut_rates(answers, questions).first()
    assert (rate.model, rate.cut) == ("m", 5) and rate.answers == len(want) - 4
    assert cutoff.cut_values(answers.limit(0), questions).count() == 0


def test_unknown_question_and_null_model(spark):
    answers = spark.createDataFrame([(1, None, "cut in the mid", None, None), (2, "none", "Done.", True, None)], "answer_no long, id string, text string, answerable boolean, model string")
    questions = spark.createDataFrame([("q", "x")], "id string, question string")
    assert {r.answer_no: r.defect for r in pairs.defects(answers, questions).collect()} == {1: "truncated"}


@pytest.mark.parametrize("text,kind", [("A whole one.", "closed"), ("نعم", "whole"), ("cited [مادة 3]", "closed"), ("cited ([article 22])", "closed"), ("open (see", "open"), ("half a wor", "open"), ("dots...", "debris"), ("...", "empty"), ("x <b", "debris"), ("x &quo", "debris"), ("a" * 100_000, "open"), ("said «so»", "closed")])
def test_endings(text, kind):
    assert cutoff.ending(text) == kind


def test_censored_fit_recovers_the_length_model():
    rng = np.random.default_rng(1)
    x, limit = rng.normal(5.0, 0.4, 20_000), 5.1
    cut = x > limit
    bins = np.round(np.minimum(x, limit) * 20) / 20
    grid = np.unique(bins)
    whole, censored = (np.array([((bins == g) & m).sum() for g in grid], dtype=float) for m in (~cut, cut))
    mu, sigma = cutoff.fit_lengths(grid, whole, censored)
    assert abs(mu - 5.0) < 0.03 and abs(sigma - 0.4) < 0.03


def test_field_on_held_out_responses():
    rng = random.Random(2)
    kinds = [ANSWER, "I'm sorry, I cannot answer that.", QUESTION, "على الجهة المختصة أن توقع على عقود الصيانة خلال شهر."]
    texts = [" ".join(rng.choice(kinds) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rows = [pairs.clause_features(t, QUESTION, False)[0] for t in texts]
    field = pairs.ClauseField.fit([(x, pairs.clear_tags(x)) for x in rows[:200]])
    right = [np.mean(field.tag(x) == pairs.clear_tags(x)) for x in rows[200:]]
    assert np.mean(right) > 0.97
    node, edge = field.marginals(rows[0])
    assert np.allclose(node.sum(1), 1) and np.isclose(edge.sum(), len(rows[0]) - 1)


UNLISTED = [
    "That falls outside what I can help with.", "This question is beyond my knowledge.", "I would rather not answer this.", "I must refrain from giving an opinion on this request.", "Your question goes beyond the scope I may discuss.",
    "I lack the information to respond.", "Answering that is not something I do.", "My guidance does not cover this subject, so no answer from me.",
    "Je préfère ne pas répondre à cela.", "Cette question dépasse mes compétences.", "Ce sujet est hors de mon domaine de compétence.", "Je m'abstiens de tout avis sur cette demande.", "Impossible pour moi de répondre à cette question.",
    "Prefiero no responder a esta pregunta.", "Este tema excede mi conocimiento.", "Esa consulta queda fuera de mi ámbito.", "Me abstengo de dar mi opinión sobre este tema.",
    "هذا خارج نطاق معرفتي.", "هذا السؤال يتجاوز قدرتي.", "أفضل ألا أجيب عن هذا دون معلومات.", "أمتنع عن الرد على سؤالك.", "هذا الموضوع ليس من اختصاصي.",
]
PLAIN = [
    "The clerk must not answer the applicant without the information named in article 7.", "No fee is due if the request is refused within 30 days.", "The board declines the transfer request where damage is proven [Article 9].",
    "Le greffier ne répond pas à la demande hors délai [article 3].", "La oficina no responde a la solicitud fuera de plazo [artículo 4].", "لا يجوز للموظف الرد على الطلب خارج أوقات العمل [مادة 5].", "تمتنع الجهة عن تقديم المعلومات دون إذن [مادة 8].", "The holder files the report within 12 days.",
]


def test_refusals_in_unlisted_wording():
    rng = random.Random(3)
    known = ["Sorry, I can't help with that request.", "I don't give legal opinions.", "لا أستطيع الإجابة من المواد المتاحة.", "Je ne peux pas répondre à cette question.", "No puedo responder a esta pregunta."]
    pool = [ANSWER, "The market inspector keeps a copy of the permits [Article 4].", "Le greffier transmet le plan dans un délai de 30 jours.", "El notario conserva la copia de los planes.", "على الجهة المختصة أن توقع على العقود خلال شهر.", *PLAIN[:1]]
    sample = [(rng.choice(known) if i % 6 == 0 else rng.choice(pool) + " " + rng.choice(pool), None) for i in range(400)]
    field = pairs.ClauseField.learn(sample)

    def tagged(text):
        x, sizes = pairs.clause_features(text, None, False, field.words)
        return pairs.defect(text, True, False, field.tag(x), sizes)

    assert not any(wording.is_refusal(t) for t in UNLISTED[:5])
    missed = [t for t in UNLISTED if tagged(t) != "refusal"]
    assert len(missed) <= 0.1 * len(UNLISTED), missed
    assert [t for t in PLAIN if tagged(t)] == []


def test_the_posterior_decides_where_the_ending_cannot():
    counts = [("closed", -4.0, 900.0), ("open", -2.0, 60.0), ("open", 4.0, 60.0), ("unseen", -3.0, 20.0), ("unseen", 5.0, 3.0), ("final", -3.0, 80.0)]
    odds = cutoff.fit_endings(counts)
    assert odds["open"] > 2 > -2 > odds["final"] and odds["closed"] == -99.0
    assert odds["unseen"] - 3 < 0 < odds["unseen"] + 5
    assert cutoff.word_ends("I can't help with that. Try again") == (["help with that", "try again"], ["i", "i can", "i can t", "can t help", "t help with", "try"])


def test_a_hot_question_and_long_limits(spark):
    hot = [(i, "hot" if i % 3 else f"q{i}", "x", "m") for i in range(600)] + [(1000, None, "x", "m")]
    answers = spark.createDataFrame(hot, "answer_no long, id string, text string, model string")
    questions = spark.createDataFrame([("hot", "Which?")] + [(f"q{i}", f"Q {i}") for i in range(0, 600, 3)], "id string, question string")
    got = {r.answer_no: r.question for r in cutoff.with_questions(answers, questions).collect()}
    assert got == {i: None if q is None else "Which?" if q == "hot" else f"Q {i}" for i, q, *_ in hot}
    text = "a whole sentence stands here. " * 1100
    rows = [(i, None, text[:32767], "m") for i in range(12)] + [(100 + i, None, text[: 31 * (i + 1) - 2].rsplit(".", 1)[0] + ".", "m") for i in range(40)]
    rows = spark.createDataFrame(rows, "answer_no long, id string, text string, model string")
    judged = cutoff.judged_values(rows, questions).where("answer_no < 100").first()
    assert judged.cut and judged.posterior > 0.9


def test_languages():
    assert [wording.language(t)[0] for t in ("the plan of the board", "le plan de la ville", "el plan de los días", "خطة العمل", "12")] == ["en", "fr", "es", "ar", None]
    more = {"Die Frist ist nicht mit dem Antrag verbunden": "de", "Срок рассмотрения жалобы": "cyrillic", "申请人应当提交报告": "han", "報告を提出しなければならない": "kana", "신청인은 보고서를": "hangul", "Whаt dоеs the bоаrd": "en"}
    assert {t: wording.language(t)[0] for t in more} == more
    assert wording.other_language("de", "en") and wording.other_language("han", "latin") and not wording.other_language("latin", "en") and not wording.other_language(None, "ar")
