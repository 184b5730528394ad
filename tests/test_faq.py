import pytest
from pyspark.sql import functions as F

from casebook import fixed_values as V
from casebook.functions.labels import blended_text, illustration, tone_label
from casebook.operators.faq import answer_requests, match_faq
from casebook.sources.catalogues import FaqEntry

# The keywords, in order, and the suggested questions.
KEYWORDS = ["thuê nhà", "ly hôn", "tai nạn giao thông", "di chúc"]
QUESTIONS = [
    ("Thuê nhà cần lưu ý gì?", "thuê nhà"),
    ("Thủ tục ly hôn như thế nào?", "ly hôn"),
    ("Bị tai nạn giao thông phải làm sao?", "tai nạn giao thông"),
    ("Viết di chúc thế nào cho đúng?", "di chúc"),
    ("Thủ tục đăng ký kết hôn cần giấy tờ gì?", "default"),
    ("Quyền lợi của người lao động khi bị sa thải trái luật?", "default"),
]
ENTRIES = [FaqEntry(k, f"L {k}", f"N {k}", "lc", "lp", "nc", None) for k in KEYWORDS]
DEFAULT = FaqEntry("default", "L default", "N default", "lc", "lp", "nc", "np")


def test_suggested_questions(spark):
    df = spark.createDataFrame(QUESTIONS, "question string, expected string")
    for row in match_faq(df, ENTRIES, DEFAULT).collect():
        assert row.keyword == row.expected


def test_first_declared_keyword_wins_and_decomposed_text_does_not_match(spark):
    import unicodedata

    rows = [("LY HÔN rồi THUÊ NHÀ",), (unicodedata.normalize("NFD", "thuê nhà"),)]
    got = match_faq(spark.createDataFrame(rows, "question string"), ENTRIES, DEFAULT).collect()
    assert [r.keyword for r in got] == ["thuê nhà", "default"]


P1, P2 = V.TONE_PREFIX_PLAIN, V.TONE_PREFIX_BALANCED
TONES = [29, 30, 49, 50, 51, 70, 71]


@pytest.mark.parametrize(
    "character,expected",
    [
        ("lawyer", ["N", P1 + "N", P1 + "N", P2 + "L", "L", "L", "L"]),
        ("normal", ["N", "N", "N", P2 + "L", P2 + "L", P2 + "L", "L"]),
    ],
)
def test_tone_table(spark, character, expected):
    df = spark.createDataFrame([(t,) for t in TONES], "t int")
    text = blended_text(F.lit(character), F.col("t"), F.lit("L"), F.lit("N"))
    assert [r.x for r in df.select(text.alias("x")).collect()] == expected


@pytest.mark.parametrize(
    "tone,label", [(float("nan"), "Cân bằng"), (29, "Đời thường"), (30, "Cân bằng"), (70, "Cân bằng"), (71, "Pháp lý")]
)
def test_tone_label(one, tone, label):
    assert one(tone_label(F.lit(tone))) == label


def test_illustration(one):
    assert one(illustration(F.lit("none"), F.lit("c"), F.lit("p"))) is None
    assert one(illustration(F.lit("poster"), F.lit("c"), F.lit(None).cast("string"))) is None
    assert one(illustration(F.lit("comic"), F.lit(""), F.lit("p"))) is None
    got = one(illustration(F.lit("comic"), F.lit("c"), F.lit("p")))
    assert (got.type, got.url, got.caption) == ("comic", "c", V.CAPTION_COMIC)


def test_answer(spark):
    rows = [
        (1, "Thuê nhà?", "lawyer", 80.0, "comic"),
        (2, "ly hôn", "normal", 10.0, "poster"),
        (3, "khác", "normal", 50.0, None),
    ]
    df = spark.createDataFrame(rows, "id int, question string, character string, tone double, illustration string")
    got = {r.id: r for r in answer_requests(df, ENTRIES, DEFAULT, F.current_timestamp()).collect()}
    assert got[1].text == "L thuê nhà" and got[1].illustration.url == "lc"
    assert got[2].text == "N ly hôn" and got[2].illustration is None
    assert got[3].text == P2 + "L default" and got[3].illustration is None
    assert got[3].timestamp is not None
