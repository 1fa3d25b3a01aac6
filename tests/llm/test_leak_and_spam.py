import random

from daftar.llm.leak import Items, item_words, leak_report, leaked_items, myers, spaced
from daftar.llm.spam import LineModel, labelled_shares, spam_pages, units

WORDS = [f"كلمة{chr(0x627 + i)}" for i in range(20)] + [f"word{c}" for c in "abcdefghijklmnopqrst"]


def brute_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_myers_is_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert myers(p, t) == brute_distance(p, t)


def test_folding():
    assert spaced("Mادّةُ ٧، ــ (X)") == "mادة 7 x"
    assert spaced("café") == spaced("café") == "café"
    assert item_words("مـــادة 7, it's") == ["مادة", "7", "it", "s"]


def longest(item, doc):
    a, b = item_words(item), item_words(doc)
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best


def test_passages_are_found_exactly(spark):
    rng = random.Random(4)
    items = {i: [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n)] for i, n in enumerate([60, 45, 20, 12, 1, 33])}
    docs = []
    for i, ws in items.items():
        for n in (len(ws), 25, 20, 19, 12, 5):
            if n <= len(ws):
                at = rng.randint(0, len(ws) - n)
                pad = [rng.choice(WORDS) for _ in range(40)]
                docs.append(" ".join(pad[:20]) + " — " + "، ".join(w.upper() + "َ" for w in ws[at : at + n]) + " " + " ".join(pad[20:]))
    rows = spark.createDataFrame([*enumerate(docs), (900, None), (901, ""), (902, docs[0])], "doc_id long, text string")
    held = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(77, None), (78, "؟!")], "item_id long, text string")
    for block, budget in ((4_000_000, 1), (50, 1), (4_000_000, 0)):
        found = leaked_items(rows.withColumn("raw", rows.doc_id), held, block_chars=block, budget=budget)
        got = {(r.doc_id, r.item_id) for r in found.where("errors = 0").collect()}
        want = {(d, i) for d, t in [*enumerate(docs), (902, docs[0])] for i, w in items.items() if longest(" ".join(w), t) >= min(20, len(w))}
        assert got == want
    report = {r.item_id: r.documents for r in leak_report(found, held).collect()}
    assert report[77] == 0 and report[0] >= 3
    assert leaked_items(rows, held.limit(0)).count() == 0 and leaked_items(rows.limit(0), held).count() == 0


def test_one_edit_is_within_the_budget(spark):
    ws = [f"{w}{i}" for i, w in enumerate(WORDS[:30])]
    text = " ".join(ws)
    broken = text.replace(ws[15], ws[15][:-1] + "q")
    rows = spark.createDataFrame([(1, "x " + broken[: broken.index(ws[25])] + " y")], "doc_id long, text string")
    got = leaked_items(rows, spark.createDataFrame([(5, text)], "item_id long, text string"), budget=1).collect()
    assert [(r.doc_id, r.item_id, r.errors) for r in got] == [(1, 5, 1)]


def test_a_run_after_a_change_of_equal_length_is_exact():
    ws = [f"{w}{i:02d}" for i, w in enumerate(WORDS[:34])]
    for at in (3, 8, 13):
        changed = [*ws[:at], ws[at][:-1] + "q", *ws[at + 1 :]]
        held = Items([(5, " ".join(ws))], 20, 1)
        assert held.search(spaced("x " + " ".join(changed[: at + 21]) + " y")) == {5: 0}
        assert held.search(spaced("x " + " ".join(changed[: at + 20]) + " y")) == {5: 1}


def test_passages_begin_and_end_at_words():
    held = Items([(1, "no"), (2, "art five"), (3, "the legal form")], 20, 0)
    assert held.search(spaced("Nobody saw another smart fiver, other legal formats")) == {}
    assert held.search(spaced("No! ART-five; of the le gal for\u00adm")) == {1: 0, 2: 0, 3: 0}
    ws = [f"{w}{i:02d}" for i, w in enumerate(WORDS[:30])]
    exact = Items([(5, " ".join(ws))], 20, 0)
    for a, b, want in ((0, 20, {5: 0}), (7, 27, {5: 0}), (0, 19, {})):
        assert exact.search(spaced("x " + " ".join(ws[a:b]) + " y")) == want
        assert exact.search(spaced("x" + " ".join(ws[a:b]) + "y")) == {}
    assert exact.search(spaced("x" + " ".join(ws[:22]) + "y")) == {5: 0}


def test_larger_budgets_are_brute_force():
    rng = random.Random(12)
    pool = ["al", "be", "ce", "del", "ef", "ga"]
    ws = [rng.choice(pool) + rng.choice(pool) for _ in range(14)]
    held = {k: Items([(1, " ".join(ws))], 8, k) for k in (1, 2, 3)}
    seen = 0
    for _ in range(400):
        i = rng.randint(0, 6)
        part = list("".join(ws[i : i + 8]))
        for _ in range(rng.randint(0, 4)):
            part[rng.randrange(len(part))] = rng.choice("xyz")
        doc = spaced("q " + "".join(part) + " q")
        least = min(brute_distance("".join(ws[j : j + 8]), doc.replace(" ", "")) for j in range(7))
        for k, items in held.items():
            got = items.search(doc).get(1)
            assert got is None or least <= got <= k
            if least <= k:
                seen += 1
                assert got is not None, (doc, k, least)
    assert seen > 300


PROSE = ["The data steward reviews the annual ledger within 30 days, unless agreed otherwise by the parties.", "If asked in writing, the applicant must not disclose the customer files to the board.", "على الجهة المختصة أن توقع على عقود الصيانة خلال ٣٠ يوما، ما لم يتفق على خلافه."]
TAGS = ["cheap lawyer | free consultation | fast permit | trademark filing | legal forms | best law firm", "#cheap_lawyer #free_consultation #fast_permit #legal_forms #best_firm", "cheap lawyer, free consultation, fast permit, debt recovery, legal forms, notary online", "cheap lawyer free consultation fast permit legal forms cheap lawyer free consultation"]
LINKS = ["http://aa.example/x www.bb.test/y https://cc.invalid/z", "• cheap lawyer www.dd.example/q"]


def test_spam_pages(spark):
    rng = random.Random(6)
    pages = {}
    for i in range(60):
        pages[i] = "Home | Laws | Contact\n" + "\n".join(rng.choice(PROSE) for _ in range(6))
    for i in range(60, 80):
        pages[i] = "\n".join(rng.choice(TAGS) for _ in range(8)) + "\n" + rng.choice(PROSE)
    for i in range(80, 90):
        pages[i] = "\n".join(rng.choice(LINKS) for _ in range(12))
    pages[90] = "\n".join(rng.choice(PROSE) for _ in range(8)) + "\n" + LINKS[0]
    pages[91] = "Contents\n\n1. the price offers ..... 3\n2. the risk report ..... 6\n3. the test samples ..... 9\n\n" + " ".join(PROSE)
    rows = [(i, t) for i, t in pages.items()] + [(95, None), (96, ""), (97, " \n\t"), (98, pages[60])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in spam_pages(df.withColumn("words", df.doc_id)).collect()} == {*range(60, 90), 98}
    shares = {r.doc_id: r for r in labelled_shares(df).collect()}
    assert len(shares) == len(rows) and shares[95].words == 0 and shares[91].menu > 0
    assert spam_pages(df.limit(0)).count() == 0


def planted_pages(n, seed):
    """(rows, ids of spam): pages with fresh words; keyword stuffing of many kinds, and pages that only look a little like it."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    things = [f"{word()} {word()}" for _ in range(120)]
    thing = lambda: rng.choice(things)
    prose = lambda: f"The {thing()} must be filed with the {thing()} within {rng.randint(2, 90)} days if the {thing()} has not been paid by then."
    rows, spam = [], set()
    for i in range(n):
        kind = i % 12
        text = " ".join(prose() for _ in range(8))
        if kind == 0:
            text = ", ".join(thing() for _ in range(90)) + ".\n" + prose()
        elif kind == 1:
            text = prose() + "\n" + " ".join(thing() for _ in range(80))
        elif kind == 2:
            text = "\n".join(f"#{word()} #{word()} #{word()}" for _ in range(14))
        elif kind == 3:
            text = "\n".join(f"https://{word()}.example/{word()}" for _ in range(15)) + "\n" + prose()
        elif kind == 4:
            text = "Home | Laws | Contact\n" + text + "\n" + " | ".join(thing() for _ in range(6))
        elif kind == 5:
            text = "Contents\n" + "\n".join(f"{k}. {thing()} ........ {k + 2}" for k in range(1, 9)) + "\n" + text
        rows.append((i, text))
        if kind < 4:
            spam.add(i)
    return rows, spam


def test_planted_pages_at_two_sizes(spark):
    for n, seed in ((240, 1), (2400, 2)):
        rows, want = planted_pages(n, seed)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id for r in spam_pages(df.repartition(3)).collect()}
        assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)
        assert got == {r.doc_id for r in spam_pages(df.repartition(11, "text")).collect()}


def test_model_without_any_page():
    model = LineModel.fit([])
    assert len(model.label(__import__("numpy").zeros((3, 10), dtype=int))) == 3
    assert units("a\r\nb\n\n c ") == ["a", "b", " c "]
