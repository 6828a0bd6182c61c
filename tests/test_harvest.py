"""Date harvest: the matcher, lists of dates, and documents against a slow version."""

import datetime
import random
import re

from pyspark.sql import functions as F

from corvella.functions import text as T
from corvella.operators import harvest

TODAY = datetime.date(2026, 8, 1)
MONTHS = dict(harvest.HEBREW.months)
NAMES = "|".join(sorted(MONTHS, key=len, reverse=True))


def test_matches_have_places(spark):
    rng = random.Random(1)
    texts = ["", "1.2", "x1.2", "1.23.4", "no digits", "7.7.7.7"] + ["".join(rng.choice("12.a ") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    pattern = r"(?<![0-9])([0-9])\.([0-9])?"
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.matches(F.col("t"), pattern, a=1, b=2).alias("m")).collect()
    for r in got:
        text, end, want = texts[r.i], 0, []
        for m in re.finditer(pattern, text):
            want.append((m.start(), text[end : m.start()], m[0], m[1], m[2] or ""))
            end = m.end()
        assert [tuple(x) for x in r.m] == want, text
    assert spark.createDataFrame([(None,)], "t string").select(T.matches(F.col("t"), pattern, a=1)).first()[0] is None


def dates_in(spark, text, two_digit=True):
    rows = spark.createDataFrame([(text, "m", two_digit)], "text string, marker string, two_digit boolean")
    return {(r.date.isoformat(), r.day_known) for r in harvest.candidates(rows, F.lit(TODAY)).collect()}


def test_every_date_of_a_list_is_found(spark):
    assert {("2019-05-01", True), ("2020-06-02", True)} <= dates_in(spark, "1 במאי 2019, 2 ביוני 2020")
    assert {("2011-03-12", True), ("2012-07-05", True), ("2013-08-09", True)} <= dates_in(spark, "12 במרץ 2011, 5 ביולי 2012, 9 באוגוסט 2013")
    assert {("2019-03-22", True), ("2018-04-01", False)} <= dates_in(spark, "22 במרץ 2019 סעיף 4 באפריל 2018") and ("2018-04-04", True) not in dates_in(spark, "22 במרץ 2019 סעיף 4 באפריל 2018")
    many = ", ".join(f"{1 + i % 28}.{1 + i % 12}.{1990 + i % 30}" for i in range(300))
    assert len(dates_in(spark, many)) == len({(1 + i % 28, 1 + i % 12, 1990 + i % 30) for i in range(300)})


def slow_candidates(text, marker, two_digit):
    """(date, day known, form, start, marker) by going through each form's matches in turn."""

    def year_of(token):
        for y, turned in ((int(token), False), (int(token[::-1]), True)):
            if 1948 <= y <= TODAY.year:
                return y, turned
        return None, False

    out = []

    def keep(y, m, d, form, at, said=""):
        try:
            date = datetime.date(y, m, d or 1)
        except ValueError:
            return
        if 1948 <= y <= TODAY.year and date <= TODAY:
            out.append((date, d is not None, form, at, marker + said + ("" if d else ";month-precision")))

    def day_at(m):
        return None if re.search(r"סעי[פף](?:ים)?(?:\s*(?:קטן|משנה))?\s*$", text[: m.start(1)]) else int(m[1])

    short = lambda y: 2000 + y if y <= 27 else 1900 + y
    for m in re.finditer(r"(?<![\d.])(\d{1,2})[./](\d{1,2})[./](\d{2,4})(?![\d.])", text):
        keep(short(int(m[3])) if int(m[3]) < 100 else int(m[3]), int(m[2]), int(m[1]) or 99, 0, m.start())
    for m in re.finditer(rf"(?<!\d)(\d{{1,2}})\s*ב\s*({NAMES})\s*,?\s*(\d{{4}})(?!\d)", text):
        y, turned = year_of(m[3])
        if y:
            keep(y, MONTHS[m[2]], None if turned else day_at(m), 1, m.start(), ";digits-reversed" * turned)
    for m in re.finditer(rf"(?<!\d)(\d{{4}})\s*ב?({NAMES})\s*(\d{{1,2}})?(?!\d)", text):
        y, turned = year_of(m[1])
        if y:
            keep(y, MONTHS[m[2]], None if turned or not m[3] else int(m[3]) or 99, 2, m.start(), ";digits-reversed" * turned)
    for form, pattern in ((3, rf"ב({NAMES})\s*,?\s*(\d{{4}})(?!\d)"), (4, rf"(?<![א-ת])({NAMES})\s*,?\s*(\d{{4}})(?!\d)")):
        for m in re.finditer(pattern, text):
            y, turned = year_of(m[2])
            if y:
                keep(y, MONTHS[m[1]], None, form, m.start(), ";digits-reversed" * turned)
    if two_digit:
        for m in re.finditer(rf"(?<!\d)(\d{{1,2}})\s*ב\s*({NAMES})\s*,?\s*(\d{{2}})(?![\d.])", text):
            keep(short(int(m[3])), MONTHS[m[2]], day_at(m), 5, m.start(), ";2digit-year")
        for m in re.finditer(rf"(?<![א-ת])ב?({NAMES})['׳]?\s*(\d{{2}})(?![\d.])", text):
            if int(m[2]) >= 28:
                keep(1900 + int(m[2]), MONTHS[m[1]], None, 6, m.start(), ";2digit-year")
    return out


def test_candidates_and_latest_dates_against_slow_version(spark):
    rng = random.Random(4)
    names = list(MONTHS)
    number = lambda: str(rng.choice([rng.randint(1, 31), rng.randint(1, 31), rng.randint(1950, 2027), rng.randint(28, 99), 6002, 4711]))
    piece = lambda: rng.choice([
        f"{rng.randint(1, 31)}.{rng.randint(1, 13)}.{rng.choice([number(), '1999', '07'])}", f"{rng.randint(1, 31)} ב{rng.choice(names)} {number()}", f"{rng.choice(names)} {number()}", number(),
        "סעיף", "סעיף קטן", f"ב{rng.choice(names)}, {number()}", "מילה", ",",
    ])
    texts = [" ".join(piece() for _ in range(rng.randint(1, 14))) for _ in range(400)]
    rows = spark.createDataFrame([(i, t, "m", i % 3 > 0) for i, t in enumerate(texts)], "i int, text string, marker string, two_digit boolean")
    got = sorted((r.i, r.date, r.day_known, r.form, r.start, r.marker) for r in harvest.candidates(rows, F.lit(TODAY)).collect())
    assert got == sorted((i, *c) for i, t in enumerate(texts) for c in slow_candidates(t, "m", i % 3 > 0))
    assert len(got) > 500

    heads = ["עודכן", "תוקן", "תאריכי עדכון", "סיווג", "", "", "", "בוטל"]
    docs = {d: [" ".join([rng.choice(heads), *(piece() for _ in range(rng.randint(0, 3)))]).strip() or "x" for _ in range(rng.randint(1, 9))] for d in range(150)}
    lines = spark.createDataFrame([(d, p, line) for d, ls in docs.items() for p, line in enumerate(ls)], "doc_id int, pos int, line string")
    windows = harvest.marker_windows(lines).withColumn("tier", F.lit(1)).unionByName(harvest.stamp_windows(lines).withColumn("tier", F.lit(2))).collect()
    want = {}
    for d in docs:
        mine = [w for w in windows if w.doc_id == d]
        fours = lambda t: [x for x in re.findall(r"(?<![\d.])\d{4}(?!\d)", t) if not any(1948 <= int(y) <= 2026 for y in (x, x[::-1]))]
        garbage = any(w.tier == 1 and (fours(w.text) or re.search(r"(?<![\d.])(?:\.\d{2,3}|\d{1,2}\.\d{2}|\d{2}\.\d)(?![\d.])", w.text)) for w in mine)
        found = [(w.tier, c) for w in mine for c in slow_candidates(w.text, w.marker, w.two_digit)]
        pool = [c for t, c in found if not garbage or t == 1 and "2digit-year" not in c[4]]
        if garbage or found:
            best = max(pool, key=lambda c: (c[0], c[1]), default=None)
            want[d] = (best[0] if best else None, ("day" if best[1] else "month") if best else None, len(found), bool(garbage))
    got = {r.doc_id: (r.date, r.precision, r.n_candidates, r.garbage) for r in harvest.document_dates(lines, F.lit(TODAY)).collect()}
    assert got == want
    assert sum(g for *_, g in want.values()) > 5 and sum(d is not None for d, *_ in want.values()) > 50
