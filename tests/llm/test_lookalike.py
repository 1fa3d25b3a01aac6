import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from daftar.llm.lookalike import canonical, canonical_columns, mapping, same_looking_classes, same_looking_pairs

SAME = [
    ("Ｈｅｌｌｏ １２", "Hello 12"), ("café", "café"), ("a​b­c⁠", "abc"), ("a b c", "a b c"), ("Рау", "Pay"),
    ("أمر", "أمر"), ("۱۲۷", "١٢٧"), ("ﺍﻟﻤﺨﺘﺼﺔ", "المختصة"),
    ("الموردین", "الموردين"), ("شکر", "شكر"), ("علی", "على"),
    ("بَّ", "بَّ"), ("ﻻ", "لا"),
]
DIFFERENT = [
    ("a b", "a  b"), ("Pay", "pay"), ("امر", "أمر"), ("علی", "علي"), ("۴", "٤"), ("5", "٥"),
    ("ملک", "ملك"), ("بَ", "ب"), ("مدة", "مده"), ("ب‌ب", "بب"), ("ﺍب", "ﺎب"), ("к", "k"),
]


def test_looks_the_same():
    for a, b in SAME:
        assert canonical(a) == canonical(b), (a, b)


def test_looks_different():
    for a, b in DIFFERENT:
        assert canonical(a) != canonical(b), (a, b)


def test_mapping_has_no_conflicts_and_forms_are_final():
    table = mapping()
    assert all(table.get(tuple(t), t) in (t, "") for t in table.values())
    odd = [s for s, t in table.items() if len(s) == 1 and canonical(canonical(s[0])) != canonical(s[0])]
    assert odd == []


MORE = [
    ("한국", "한국"), ("が", "が"), ("ﾊﾞ", "バ"), ("Å", "Å"), ("ﬁn Ⅳ", "fin IV"), ("Ꭺꓮ", "AA"), ("ⲟօ", "oo"),
    ("a\u3164\U000e0041b\u180f", "ab"), ("\ufe83\u0645\u0631", "أمر"), ("ﷲ"[:0] + "ﻷن", "لأن"), ("क़", "क़"), ("ﺑﻨﺎ\ufe80", "بناء"),
]


def test_all_planes():
    for a, b in MORE:
        assert canonical(a) == canonical(b), (a, b)


def test_composed_and_decomposed_forms_of_every_letter():
    import sys

    letters = [chr(c) for c in range(sys.maxunicode) if unicodedata.normalize("NFD", chr(c)) != chr(c) and not 0xD800 <= c < 0xE000]
    text = [f"x{ch}y" for ch in letters]
    assert [t for t in text if canonical(unicodedata.normalize("NFD", t)) != canonical(t) or canonical(unicodedata.normalize("NFC", t)) != canonical(t)] == []


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aéеЕ０Ａ ابيیکةىَّ́ٔ​ ﺍﻟﻻ\n-"), max_size=25))
def test_form_is_a_fixed_point_and_accepts_composition(text):
    form = canonical(text)
    assert canonical(form) == form
    assert canonical(unicodedata.normalize("NFD", text)) == form


def test_columns_and_pairs(spark):
    rows = spark.createDataFrame(
        [("a", "café", 1), ("b", "café", 2), ("c", "café", 3), ("d", "cafe", 4), ("e", "", 5), ("f", None, 6), ("b", "café", 7), ("g", "​", 8), ("h", "​​", 9)],
        "key string, text string, k int",
    )
    pairs = {(r.key_a, r.key_b) for r in same_looking_pairs(rows, "key", "text").collect()}
    assert pairs == {("a", "b"), ("a", "c")}
    classes = {r.key: (r.form, r.spelling) for r in same_looking_classes(rows, "key", "text").collect()}
    assert set(classes) == {"a", "b", "c"} and len(set(classes.values())) == 2 and len({f for f, _ in classes.values()}) == 1
    forms = canonical_columns(rows.withColumn("text_canonical", rows.k), ["text"]).orderBy("k").collect()
    assert [r.text_canonical for r in forms[:6]] == ["café", "café", "café", "cafe", "", None]
    assert same_looking_pairs(rows.limit(0), "key", "text").count() == 0


def test_a_hot_form_is_spread(spark):
    rows = spark.range(2600).selectExpr("lpad(id, 5, '0') as key", "if(id % 100 = 0, 'caf\u00e9', 'cafe\u0301') as text")
    assert same_looking_pairs(rows, "key", "text").count() == 26 * 2574


def test_long_word_and_text():
    assert canonical("а" * 100_000) == "a" * 100_000
    assert canonical(("а " * 50_000).strip()) == ("a " * 50_000).strip()
