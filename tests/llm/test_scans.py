import random

import pytest

from daftar.llm import scans
from daftar.llm.boost import BoostedStumps, Logistic

WORDS = "the data steward reviews annual processing ledger within thirty days unless agreed otherwise member cards warranty deed building plans archive confidence notary applicant".split()


@pytest.fixture(scope="module")
def clean(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(WORDS) for _ in range(60)) + " the long-term tenant signs a long term deed." for _ in range(40)]
    return spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "text string")


def pages(spark, extra=()):
    rng = random.Random(5)
    line = lambda: " ".join(rng.choice(WORDS) for _ in range(6))
    rows = [(f"S1:{n:03d}", "S1", n, f"The Gazette - No. 46\n{line()}\n{line()}\n{line()}\n- {n} -") for n in range(10, 16)]
    return spark.createDataFrame(rows + list(extra), "page_key string, scan_id string, page_no int, text string")


def test_kinds_of_lines_and_repair(spark, clean):
    noisy = "The Gazete - No. 46\nthe data stewa-\nrd reviews the annua1 processing\nthe long-\nterm tenant in the archive, unless agreed otherwise\n17\nmember cards\n- l7 -"
    rows = pages(spark, [("S1:017", "S1", 17, noisy), ("S1:018", "S1", 18, None), ("S1:019", "S1", 19, " \n"), ("S1:017", "S1", 17, noisy)])
    out = scans.repaired_pages(rows.withColumn("form", rows.page_no), clean)
    found = {(r.line_no, r.kind) for r in scans.noisy_lines(out).where("page_key = 'S1:017'").collect()}
    assert found == {(1, "running_header"), (2, "split_word"), (3, "misread"), (8, "page_number")}
    text = out.where("page_key = 'S1:017'").first().repaired
    assert "data steward reviews the annual processing" in text and "long- term tenant" in text.replace("long-term", "long- term") and "Gazet" not in text and "l7" not in text
    rest = {r.page_key: (r.kinds, r.repaired) for r in out.collect()}
    assert rest["S1:018"] == ([], None) and rest["S1:019"] == ([], " \n")
    assert {k.kind for k in rest["S1:012"][0]} == {"running_header", "page_number"}
    assert scans.repaired_pages(rows.limit(0), clean).count() == 0


def test_a_scan_may_have_many_running_headers(spark, clean):
    parts = "volume alpha,second bravo,chapter charlie,delta title,echo preface,foxtrot index,golf notes here,hotel annex,india summary,juliet closing,kilo epilogue,lima afterword".split(",")
    rng = random.Random(8)
    body = lambda: "\n".join(" ".join(rng.choice(WORDS) for _ in range(6)) for _ in range(5))
    rows = [(f"S2:{n:03d}", "S2", n, f"{parts[n // 3]}\n{body()}") for n in range(3 * len(parts))]
    rows.append(("S2:900", "S2", 900, f"lirna afterword\n{body()}"))
    out = scans.repaired_pages(spark.createDataFrame(rows, "page_key string, scan_id string, page_no int, text string"), clean)
    found = {(r.page_key, r.line_no) for r in scans.noisy_lines(out).where("kind = 'running_header'").collect()}
    assert found == {(r[0], 1) for r in rows}


def test_edits_in_the_jvm(spark):
    pairs = [("lima", "lirna"), ("kind", "kincl"), ("abc", "abd"), ("abcdef", "ab"), ("wave", "vvave"), ("same", "same"), ("mm", "rnrn")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", scans._edits("a", "b").alias("n")).collect()
    assert [r.n for r in got] == [scans.edits(a, b)[0] for a, b in pairs]


def test_empty_lexicon_changes_no_word(spark, clean):
    out = scans.repaired_pages(pages(spark), clean.limit(0))
    assert {r.kind for r in scans.noisy_lines(out).collect()} <= {"running_header", "page_number"}


NUMBERS = [("٨٣/95", 83, True), ("صفحة l7O", 170, True), ("- 12 -", 12, True), ("(١٤)", 14, True), ("Page 9 of 12", 9, True), ("Page 13", 18, True), ("171", 84, False), ("Article 12", 12, False), ("12 days", 12, False), ("", 1, False)]


@pytest.mark.parametrize("seed", [1, 2])
def test_page_numbers(seed):
    import numpy as np

    rng = random.Random(seed)
    shapes = ["{}", "- {} -", "Page {}", "({})", "{}/200", "صفحة {}"]
    sample = [(rng.choice(shapes).format(n) + "\nsome body text\n77\nmore body text\nand its end", n) if n % 2 else ("Header\nbody text\n" + rng.choice(shapes).format(n), n) for n in rng.sample(range(1, 200), 60)]
    model = scans.fit_numbers(sample)
    for line, no, want in NUMBERS:
        signs = scans.number_signs(line, no, True)
        assert bool(signs is not None and model.probability(np.array([signs], dtype=float))[0] >= 0.5) is want, (line, signs)


def test_ranker_on_held_out_corruptions():
    rng = random.Random(9)
    sample = [(w, 50 + i) for i, w in enumerate(sorted(set(WORDS)))]
    more = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(4, 9))) for _ in range(300)]
    sample += [(w, rng.randint(2, 60)) for w in sorted(set(more))]
    ranker = scans.fit_ranker(sample, seed=1)
    known, right, n = dict(sample), 0, 0
    for word, _ in sample[::3]:
        form = scans.corrupted(word, rng)
        if form and form not in known and len(word) > 3:
            import numpy as np

            near = [w for w in known if abs(len(w) - len(form)) <= 2 and scans.edits(form, w)[0] <= 2]
            p = ranker.probability(np.array([scans.rank_features(form, w, known[w]) for w in near], dtype=float))
            n += 1
            right += near[int(p.argmax())] == word and p.max() >= 0.5
    assert n > 50 and right / n > 0.85


def test_candidates_are_all_neighbours(spark):
    rng = random.Random(3)
    lex = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(3, 6))) for _ in range(80)})
    forms = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(3, 6))) for _ in range(20)} - set(lex))
    got = {(r.form, r.word) for r in scans._candidates(spark.createDataFrame([(f,) for f in forms], "form string"), spark.createDataFrame([(w, 3) for w in lex], "form string, n int")).collect()}
    assert {(f, w) for f in forms for w in lex if scans.edits(f, w)[0] <= 2 and scans.edits(f, w)[1] == scans.edits(f, w)[0]} <= got | {(f, w) for f in forms for w in lex if len(f) <= 4}


def planted_scans(n, seed):
    """(pages, clean texts, noisy lines): fresh words at every size, noise of each kind."""
    rng = random.Random(seed)
    fresh = lambda: "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(3, 4)))
    lexicon = sorted({fresh() for _ in range(150)})
    clean = [" ".join(rng.choice(lexicon) for _ in range(80)) for _ in range(n)]
    rows, want = [], set()
    for scan in range(max(n // 12, 2)):
        header = f"{fresh()} {fresh()} gazette".title()
        for page in range(10, 22):
            key = f"S{scan:04d}:{page}"
            lines = [header] + [" ".join(rng.choice(lexicon) for _ in range(8)) for _ in range(9)] + [rng.choice(["- {} -", "Page {}", "{}"]).format(page)]
            want |= {(key, 1, "running_header"), (key, len(lines), "page_number")}
            for at in rng.sample(range(2, 9), 2):
                words = lines[at].split()
                if at % 2:
                    long = words[3]
                    worse = scans.corrupted(long, rng)
                    if worse and worse not in lexicon:
                        words[3] = worse
                        want.add((key, at + 1, "misread"))
                    lines[at] = " ".join(words)
                else:
                    word, cut = words[-1], rng.randint(2, len(words[-1]) - 2)
                    lines[at] = " ".join([*words[:-1], word[:cut] + "-"])
                    lines[at + 1] = word[cut:] + " " + lines[at + 1]
                    want.add((key, at + 1, "split_word"))
            rows.append((key, f"S{scan:04d}", page, "\n".join(lines)))
    return rows, clean, want


def test_planted_noise_at_two_sizes(spark):
    for n, seed in ((40, 1), (400, 2)):
        rows, texts, want = planted_scans(n, seed)
        df = spark.createDataFrame(rows, "page_key string, scan_id string, page_no int, text string")
        lex = spark.createDataFrame([(t,) for t in texts], "text string")
        got = {tuple(r) for r in scans.noisy_lines(scans.repaired_pages(df.repartition(3), lex)).collect()}
        for kind in ("running_header", "page_number", "split_word", "misread"):
            true, found = {x for x in want if x[2] == kind}, {x for x in got if x[2] == kind}
            assert len(true & found) >= 0.9 * len(true) and len(true & found) >= 0.9 * len(found), (n, kind, len(true), len(found), len(true & found))
        assert got == {tuple(r) for r in scans.noisy_lines(scans.repaired_pages(df.repartition(7, "text"), lex)).collect()}


def test_small_models():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    assert ((BoostedStumps.fit(x[:300], y[:300]).probability(x[300:]) > 0.5) == y[300:]).mean() > 0.9
    assert ((Logistic.fit(x[:300], y[:300]).probability(x[300:]) > 0.5) == y[300:]).mean() > 0.95
