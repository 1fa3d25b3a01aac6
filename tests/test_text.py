import random

from pyspark.sql import functions as F

from daftar.functions import citations as ci
from daftar.functions import text as tx


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first().x




def test_normalizers(spark):
    assert one(spark, "الْمَادَّةُ  ٧\tمـــن", tx.evaluation_form(F.col("t"))) == "المادة 7 من"
    assert one(spark, "ﺍﻟﻤﺎﺩﺓ ７", tx.evaluation_form(F.col("t"))) == "المادة 7"
    assert one(spark, "مسؤولية على الهيئة إلى آخر", tx.orthographic_form(F.col("t"))) == "مسووليه علي الهييه الي اخر"
    assert one(spark, None, tx.evaluation_form(F.col("t"))) is None
    assert one(spark, "", tx.evaluation_form(F.col("t"))) == ""


def test_clitics_leave_three_letters(spark):
    cases = {"والكتاب": "كتاب", "وبالقانون": "قانون", "الي": "الي", "بعد": "بعد", "للعمل": "عمل", "والد": "الد", "فاللام": "لام", "كالبحر": "بحر"}
    for word, want in cases.items():
        assert one(spark, word, tx.strip_clitic(F.col("t"))) == want, word


def test_search_and_content_tokens(spark):
    assert one(spark, "ما هي عقوبة، المخالفة؟", tx.search_tokens(F.col("t"))) == ["ما", "هي", "عقوبه", "مخالفه"]
    assert one(spark, "ما هي عقوبة، المخالفة؟", tx.content_tokens(F.col("t"))) == ["عقوبه", "مخالفه"]
    assert one(spark, "...", tx.search_tokens(F.col("t"))) == []


def test_search_tokens_take_no_token_by_itself(spark):
    """The whole text goes through a few passes, and the tokens are those of the forms that they are made of."""
    rng = random.Random(6)
    pieces = [*tx.CLITICS, *"\u0610\u061a\u064b\u064e\u0651\u065f\u0670\u06d6\u06dd\u06ed\u0640", *tx.DIGITS_FROM, *tx.FOLD_FROM, *"بتمكولا" * 6, *" " * 25, *"\t\n\r\x1c\x1f\x85\xa0\u2003\u2028\u3000\u200f\u200d", *".،؟-_[]$\\", "a", "Z", "é", "e\u0301", "7", "Ⅷ", "²", "𞤀", "😀", "ﻻ", "م\0م"]
    texts = ["".join(rng.choice(pieces) for _ in range(i % 60)) for i in range(600)]
    rows = spark.createDataFrame([(t,) for t in [*texts, *tx.CLITICS, *[c + w for c in tx.CLITICS for w in ("كتب", "كت", " كتب", "كـتَ", "و😀اب")], None]], "t string")
    for compat in (False, True):
        got = rows.select(tx.search_tokens(F.col("t"), compat).alias("x"))
        assert "lambda" not in got._jdf.queryExecution().analyzed().toString()
        whole = tx.collapse(F.regexp_replace(tx.orthographic_form(F.col("t"), compat), tx.NOT_WORD, " "))
        want = rows.select(F.transform(tx.tokens(whole), tx.strip_clitic).alias("x"))
        assert [r.x for r in got.collect()] == [r.x for r in want.collect()]


def test_typist_forms(spark):
    assert one(spark, "الدعائية على أ", tx.typist_form(F.col("t"), "ta_marbuta")) == "الدعائيه على أ"
    assert one(spark, "مسؤول على أمة", tx.typist_form(F.col("t"), "all")) == "مسوول علي امه"
    assert one(spark, "أ", tx.typist_form(F.col("t"), "unknown")) == "أ"


def test_sentences_and_digits(spark):
    assert one(spark, " أ. ب! ؟ ج\n\n", tx.sentences(F.col("t"))) == ["أ", "ب", "ج"]
    assert one(spark, "من ١٢ إلى 34و۵", tx.digit_tokens(F.col("t"))) == ["١٢", "34", "۵"]


def test_citations(spark):
    assert one(spark, "كذا [مادة 7] و[ المادة (١٢) ]", ci.strict_citations(F.col("t"))) == [7, 12]
    assert one(spark, "المادة: 30 والمواد ٣٦، ٣٧ و٣٨", ci.loose_citations(F.col("t"))) == [30, 36, 37, 38]
    assert one(spark, "عدد المواد: 12", ci.loose_citations(F.col("t"))) == []
    assert one(spark, "[مادة 7] ثم المادة 7 والمادة 9", ci.citations(F.col("t"))) == [7, 9]


def test_copied_run(spark):
    text = "كلمة " * 30
    df = spark.createDataFrame([(text[:80], [text]), (text[:59], [text]), ("x" * 80, [text]), (text[:80], [])], "s string, c array<string>")
    assert [r.x for r in df.select(ci.copied(F.col("s"), F.col("c")).alias("x")).collect()] == [True, False, False, False]


def test_hidden_characters(spark):
    assert one(spark, "أ‏ب­ج", tx.strip_invisible(F.col("t"))) == "أبج"
    assert one(spark, "مادة ‮12‬", tx.has_override(F.col("t"))) is True
    assert one(spark, "1‏2", tx.has_unsafe_gap(F.col("t"))) is True
    assert one(spark, "1ـ2", tx.has_unsafe_gap(F.col("t"))) is True
    assert one(spark, "1 ‏2", tx.has_unsafe_gap(F.col("t"))) is False
    assert one(spark, "12", tx.has_unsafe_gap(F.col("t"))) is False


def test_markup_and_furniture(spark):
    assert one(spark, "### <b>مادة</b> (٦٦)\n**مادة (37)**\n- بند &amp; آخر", tx.strip_markup(F.col("t"))) == "مادة (٦٦)\nمادة (37)\nبند & آخر"
    assert one(spark, "(143) مادة\nنص (5) مادة", tx.header_order(F.col("t"))) == "مادة (143)\nنص (5) مادة"
    for line, want in {"- ١٢ -": True, "الجريدة الرسمية – العدد ٢٨ مكرر (د) فى ١٣ يولية سنة ٢٠٢٠": True, "سنة كاملة من العمل الجاد": False, "": False, ".ن": True}.items():
        assert one(spark, line, tx.is_furniture(F.col("t"))) is want, line


def test_small_ones(spark):
    assert one(spark, "law-17", tx.article_number(F.col("t"))) == 17
    assert one(spark, "issuance-3", tx.article_number(F.col("t"))) is None
    assert one(spark, "p07", tx.page_order(F.col("t"))) == 7
    assert one(spark, "a/b\\c.PDF", tx.suffix(F.col("t"))) == ".pdf"
    assert one(spark, "x/‮name.txt", tx.display_title(F.col("t"))) == "name.txt"


def test_tidy_moves_blanks_only(spark):
    cases = {
        "كلمة ، ( كلمة ) in- line": "كلمة، (كلمة) in-line",
        "شبكات Wi-\nFi العامة": "شبكات Wi-Fi العامة",
        "أولا : نطاق": "أولا: نطاق",
        "يناير .2026 وثيقة": "يناير .2026 وثيقة",
        "ذلك ؟! نعم": "ذلك؟! نعم",
        "ذلك ؟!نعم": "ذلك ؟!نعم",
        "البند (( أ": "البند ((أ",
        "البند ( ( أ ) ) .": "البند ((أ)).",
        "مادة( 1": "مادة( 1",
        "الشبكة - الشركة": "الشبكة - الشركة",
        "  باب\t قول  ": "  باب\t قول  ",
        " . أ ( ": ". أ (",
        "": "",
    }
    for raw, want in cases.items():
        assert one(spark, raw, tx.tidy(F.col("t"))) == want, raw
    assert one(spark, None, tx.tidy(F.col("t"))) is None


def test_normal_lines(spark):
    assert one(spark, "أ  ب\r\nـــ\n\u2028ﺍﻟـ ٧", tx.normal_lines(F.col("t"))) == ["أ ب", "ال 7"]
    assert one(spark, "", tx.normal_lines(F.col("t"))) == []
