import random

import pytest

from daftar.llm.overlap import aligned, cosine_join, one_slip, overlap_counts, split_overlaps, words

BASE = "What does the network carrier pay for the operating budget if asked in writing on the Gitomabe Zazalaho platform?"
SAME = [
    BASE, BASE.lower(), "Please, " + BASE, BASE.replace("budget", "bugdet"), "On the Gitomabe Zazalaho platform, what does the network carrier pay for the operating budget if asked in writing",
    BASE.replace("carrier", "cаrrier"), BASE.replace("writing", "writting").replace("network", "netwrok"),
]
OTHER = [BASE.replace("Gitomabe Zazalaho", "Josanago Betasahe"), BASE.replace("pay", "never pay"), BASE.replace("asked", "asked 12"), "How many days?"]


def test_pairs_of_one_question(spark):
    rows = [(f"t{i}", t, " Train" if i % 2 else "train", "s") for i, t in enumerate(SAME + OTHER)] + [("e0", BASE, "DEV ", "s"), ("e1", None, "dev", "s"), ("e2", "", "test", None), ("e3", "??", "test", "s"), ("x", BASE, None, "s"), ("e0", BASE, "DEV ", "s")]
    df = spark.createDataFrame(rows, "id string, question string, split string, source string")
    got = {(r.id_a, r.id_b) for r in split_overlaps(df.withColumn("bag", df.id)).collect()}
    assert got == {("e0", f"t{i}") for i in range(len(SAME))}
    counts = {(r.split, r.source): (r.records, r.overlapping) for r in overlap_counts(df, split_overlaps(df)).collect()}
    assert counts[("dev", "s")] == (2, 1) and counts[("train", "s")] == (11, len(SAME))
    assert split_overlaps(df.limit(0)).count() == 0


def test_numbers_negations_and_replacements():
    df = {"المده": 300, "alpha": 400, "beta": 30, "which": 500, "reply": 200}
    same = lambda a, b, n=3000: aligned(words(a), words(b), df, n)[0]
    assert same("ما المدة خلال 635 يوما للمورد", "ما المهلة خلال ٦٣٥ يوما للمورد") is True
    assert same("ما المدة خلال 635 يوما للمورد", "ما المدة خلال 636 يوما للمورد") is False
    assert same("هل يجوز", "هل لا يجوز") is False
    assert same("which one at Zagora", "what one at Zagora") is True
    assert same("which one at Zagora", "which one at Felino") is None  # both rare: a name, unless other questions show otherwise
    assert same("reply at Zagora", "hand back at Zagora") is True and same("reply alpha at Zagora", "hand back at Zagora") is None
    assert same("please which one", "which one") is True
    assert aligned(words("a dispositions quelles zuza"), words("a articles quels zuza"), df, 3000) == (None, "articles|dispositions", "a")


def planted(n, seed):
    """(rows, true pairs): questions in pairs that are one, or differ in a name, a number or a negation."""
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice("bdfgjklmnprstvz") + rng.choice("aeiou") for _ in range(4)).capitalize()
    who, what, when = ["network carrier", "branch manager", "appeals board", "data steward"], ["risk report", "price offers", "customer files", "training plan"], ["on renewal", "after hearing parties", "where damage is proven", "before work begins"]
    rows, true = [], set()
    for i in range(n):
        a, b = name(), name()
        text = f"How many days does the {rng.choice(who)} have to hand over the {rng.choice(what)} {rng.choice(when)} within {rng.randint(100, 999)} hours on the {a} {b} platform?"
        word = rng.choice(["carrier", "manager", "board", "steward", "report", "offers", "files", "plan", "days", "hours"])
        kind = i % 10
        near = {
            0: text.upper(), 1: "Hello, " + text, 2: text.replace("hand over", "deliver"), 3: text.replace("many", "numerous"), 4: text.replace(word, word[0] + word[2:]),
            5: text.replace(a, name()), 6: text.replace(a, name()).replace(b, name()), 7: text.replace(" hours", "1 hours"), 8: text.replace("does", "does never"), 9: text.replace("on the", "for the old"),
        }[kind]
        rows += [(f"q{2 * i:07d}", text, "train"), (f"q{2 * i + 1:07d}", near, ("dev", "Test ")[i % 2])]
        if kind < 5:
            true.add((f"q{2 * i:07d}", f"q{2 * i + 1:07d}"))
    return rows, true


@pytest.mark.parametrize("n,seed", [(150, 1), (1500, 2)])
def test_planted_pairs_at_two_sizes(spark, n, seed):
    rows, true = planted(n, seed)
    df = spark.createDataFrame(rows, "id string, question string, split string")
    got = {(r.id_a, r.id_b) for r in split_overlaps(df.repartition(3)).collect()}
    rest = {p for p in got - true if int(p[0][1:]) // 2 % 10 != 9}  # a swap of two common words may be told by its contexts
    assert len(got & true) >= 0.95 * len(true) and len(rest) <= 0.02 * len(true)
    assert got == {(r.id_a, r.id_b) for r in split_overlaps(df.repartition(7, "question")).collect()}


def test_one_slip():
    assert all(one_slip(a, b) for a, b in [("abc", "acb"), ("abc", "ab"), ("abc", "abxc"), ("abc", "axc")])
    assert not any(one_slip(a, b) for a, b in [("abc", "cab"), ("abc", "a"), ("abcd", "badc")])


def test_cosine_join_is_brute_force(spark):
    import math
    from collections import Counter

    rng = random.Random(5)
    pool = [f"w{i}" for i in range(12)]
    make = lambda p, n: [(f"{p}{i}", [rng.choice(pool) for _ in range(rng.randint(0, 6))]) for i in range(n)]
    left, right = make("a", 25), make("b", 25)
    schema = "k string, ts array<string>"
    got = {(r.key_a, r.key_b): r.cosine for r in cosine_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "k", "ts", 0.6).collect()}
    rows = [x for x in left + right if x[1]]
    df = Counter(w for _, ts in rows for w in set(ts))

    def vector(ts):
        v = {w: n * math.log1p(len(rows) / (df[w] + 4)) for w, n in Counter(ts).items()}
        z = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / z for w, x in v.items()}

    want = {}
    for a, ta in left:
        for b, tb in right:
            if ta and tb:
                va, vb = vector(ta), vector(tb)
                c = sum(x * vb.get(w, 0) for w, x in va.items())
                if c >= 0.6:
                    want[a, b] = c
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
