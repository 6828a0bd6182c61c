"""Answer blocks, sources, ruling lines and chips: cases as answers are written."""

import pytest
from pyspark.sql import functions as F

from corvella.functions import text as T
from corvella.operators import answers

RLM = T.DIRECTIONS[1]


@pytest.fixture(scope="module")
def blocks(spark):
    def of(body):
        rows = answers.blocks(spark.createDataFrame([(1, body)], "id int, body string")).orderBy("pos").collect()
        return [(r.kind, r.label, r.value) for r in rows]

    return of


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_labelled_lines(blocks):
    assert blocks("**תנאים:**\n- מנוחה\n- חריגה") == [("field", "תנאים", ""), ("md", None, "- מנוחה\n- חריגה")]
    for label in ("תנאים", "תנאים \\ הגבלות", "סייגים", "מי מאשר", "דרגה נדרשת לאישור"):
        assert blocks(f"**{label}:** ערך") == [("field", label, "ערך")]
    assert [k for k, *_ in blocks("**התנהלות החייל:** א\n**התנהלות האחראית:** ב")] == ["side", "side"]
    assert [k for k, *_ in blocks('**לא נקבע בפקודות מטכ"ל:** א\n**טרם במאגר:** ב\n**פסיקה:** ג\n**תשובה:** ד')] == ["route_out", "route_miss", "lead", "lead"]
    assert blocks(f"**{RLM}מקור{RLM}:** {RLM}הפקודה{RLM}") == [("src", "מקור", "הפקודה")]
    assert blocks("**הערה:** רק בשגרה") == [("note", None, "רק בשגרה")]


def test_what_is_no_label_stays_prose(blocks):
    for line in ("**חשוב מאוד** לדעת", "- **התנהלות נכונה**: be calm", "**" + "א" * 29 + ":** ערך", "plain", "a **bold:** word inside"):
        assert blocks(line) == [("md", None, line)], line
    assert blocks("") == [] and blocks(" \n\n") == []
    assert blocks("\none\n\ntwo\n") == [("md", None, "one\n\ntwo")]


def test_notes_open_paragraphs(blocks):
    for line in ("מה הפקודות לא קובעות: משך מרבי.", "הפקודות אינן נוקבות בסכום.", "הפקודות שסופקו אינן מגדירות מהו זמן סביר."):
        assert blocks(line) == [("note", None, line)]
        assert blocks(f"before\n{line}") == [("md", None, f"before\n{line}")]
        assert blocks(f"before\n{line}\n{line}") == [("md", None, f"before\n{line}\n{line}")]
        assert blocks(f"before\n\n{line}\n{line}\nafter") == [("md", None, "before"), ("note", None, line), ("note", None, line), ("md", None, "after")]
    assert [k for k, *_ in blocks("הכלל חל על כל סוגי השירות, ולכן מה שנותר פתוח הוא שהפקודות אינן קובעות מהו פרק זמן.")] == ["md"]


def test_sources(spark, blocks):
    assert blocks("**מקור:** ; ") == [("field", "מקור", ";")]
    got = one(spark, answers.sources, 'פ"מ 33.0213 — עבודה, מנוחה, סעיף 4; פ"מ 33.0351 סעיפים 12-14 ;')
    assert [tuple(s) for s in got] == [('פ"מ 33.0213 · עבודה, מנוחה', "סעיף 4"), ('פ"מ 33.0351', "סעיפים 12-14")]

    got = one(spark, answers.sources, "סעיף 7;  סעיפים;a — b - c · סעיפים  5-6 ;x,—סעיף 3; —;" + RLM + " plain" + RLM + ";first - line\nof two")
    assert [tuple(s) for s in got] == [("", "סעיף 7"), ("סעיפים", ""), ("a · b - c", "סעיפים  5-6"), ("x,·סעיף 3".replace("·", " · "), ""), (" · ", ""), ("plain", ""), ("first · line\nof two", "")]


def test_ruling_line_and_its_marks(spark):
    found = lambda c: answers.ruling_clauses(answers.ruling_line(c))
    assert [tuple(x) for x in one(spark, found, f"כותרת\n{RLM}**פסיקה:** {RLM}מותר; אסור במדים **\nעוד")] == [("מותר", "yes"), ("אסור במדים", "no")]
    assert one(spark, found, "no ruling") == [] and one(spark, found, None) == []
    assert one(spark, answers.chip, f"{RLM}מותר") == "yes" and one(spark, answers.chip, f"{RLM}**מוסמך**") is None
