"""Dates in texts: patterns, plausibility, markers and line windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvella.functions import text as T

LEAST_YEAR = 1948


@dataclass(frozen=True)
class Wording:
    """months: (name, number). glue: the letter that joins day, month and year. letters: a class of letters that a month's name doesn't follow.
    clause: before a number that is no day. markers: (text, name) in order of precedence. keyword: makes a line a marker line.
    classified: in lines that say nothing about updates. spill: makes a marker line's following date lines part of its window. dated: words in such lines."""

    months: tuple[tuple[str, int], ...]
    glue: str
    letters: str
    clause: str
    markers: tuple[tuple[str, str], ...]
    keyword: str
    classified: str
    spill: str
    dated: str


# Hebrew month names with short forms, marker words and the names of their kinds.
HEBREW = Wording(
    (
        ("ינואר", 1), ("פברואר", 2), ("מרס", 3), ("מרץ", 3), ("מארס", 3), ("אפריל", 4), ("מאי", 5), ("יוני", 6), ("יולי", 7), ("אוגוסט", 8), ("ספטמבר", 9), ("אוקטובר", 10), ("נובמבר", 11), ("דצמבר", 12),
        ("ינו", 1), ("פבר", 2), ("אפר", 4), ("יונ", 6), ("יול", 7), ("אוג", 8), ("ספט", 9), ("אוק", 10), ("נוב", 11), ("דצמ", 12),
    ),
    "ב",
    "א-ת",
    r"סעי[פף](?:ים)?(?:\s*(?:קטן|משנה))?\s*$",
    (
        ("תאריכי עדכון", "update-dates-list"), ("עדכון הפקודה", "update-dates-list"), ("עודכנ", "updated-line"), ("עודכן", "updated-line"),
        ("תוקן", "amended-clause"), ("תוקנ", "amended-clause"), ("בוטל", "cancelled-clause"), ("בחוזר תיקונים", "tikkunim-circular"),
        ("תוקף", "tokef-clause"), ("פורס", "published-line"), ("נוסח פקודה", "published-line"), ("מהדורה", "edition-line"),
    ),
    r"תאריכי עדכון|עדכון הפקודה|נוסח פקודה|(?<![א-ת])פורס[מם]|עודכנ|עודכן|תוקף|תוקן|תוקנ|בוטל|מהדורה|בחוזר תיקונים",
    "סיווג",
    r"פורסם ב\s*מאגר|תאריכי עדכון|עדכון הפקודה",
    r"בתאר\s*יך\s*[0-9]{0,2}",
)


def _names(w: Wording) -> str:
    return "|".join(sorted((n for n, _ in w.months), key=len, reverse=True))


def two_digit_year(yy: Column, pivot: int = 27) -> Column:
    return F.when(yy <= pivot, yy + 2000).otherwise(yy + 1900)


def plausible(year: Column, today: Column) -> Column:
    return year.between(F.lit(LEAST_YEAR), F.year(today))


def rescued_year(token: Column, today: Column) -> Column:
    """struct(year, turned) of four digits: as they stand, or read backwards where only that is plausible; else null."""
    y, back = token.cast("int"), F.reverse(token).cast("int")
    return F.when(plausible(y, today), F.struct(y.alias("year"), F.lit(False).alias("turned"))).when(plausible(back, today), F.struct(back.alias("year"), F.lit(True).alias("turned")))


def _once(**columns: Column) -> Column:
    """Columns to select by generation, so that they are worked out once a row; Spark would repeat a projection's expressions wherever they are used."""
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))


def _of_form(form: int):
    """A match of a form as a struct that all forms share."""
    return lambda m: F.struct(F.lit(form).alias("form"), m["start"].alias("start"), m["text"].alias("raw"))


def candidates(windows: DataFrame, today: Column, w: Wording = HEBREW) -> DataFrame:
    """windows (text, marker, two_digit) with each real date in text, not after today: date, day_known, raw, form, start, marker.

    Seven forms: d.m.y; day, month and year; year, month and perhaps day; month
    and year with the joining letter, or without it; and, where two_digit says
    so, day, month and two digits, or month and two digits (over 27). A number
    behind the word for a clause is no day; dates of turned years have no day.
    """
    month, d = f"({_names(w)})", "([0-9]{1,2})"
    # What a form can start with is looked at first, as that is fast and mostly fails.
    digit, first = "(?=[0-9])", "".join(sorted({n[0] for n, _ in w.months}))
    # Name and place of each form's groups, how its year is written, and its pattern.
    forms = [
        ("dmy", "", rf"{digit}(?<![0-9.]){d}[./]{d}[./]([0-9]{{2,4}})(?![0-9.])"),
        ("dmy", "year", rf"{digit}(?<![0-9]){d}\s*{w.glue}\s*{month}\s*,?\s*([0-9]{{4}})(?![0-9])"),
        ("ymd", "year", rf"{digit}(?<![0-9])([0-9]{{4}})\s*{w.glue}?{month}\s*{d}?(?![0-9])"),
        ("my", "year", rf"{w.glue}{month}\s*,?\s*([0-9]{{4}})(?![0-9])"),
        ("my", "year", rf"(?=[{first}])(?<![{w.letters}]){month}\s*,?\s*([0-9]{{4}})(?![0-9])"),
        ("dmy", "two", rf"{digit}(?<![0-9]){d}\s*{w.glue}\s*{month}\s*,?\s*([0-9]{{2}})(?![0-9.])"),
        ("my", "two", rf"(?=[{first}{w.glue}])(?<![{w.letters}]){w.glue}?{month}['׳]?\s*([0-9]{{2}})(?![0-9.])"),
    ]
    month_of = F.create_map(*[F.lit(x) for pair in w.months for x in pair])
    every = []
    for k, (order, years, pattern) in enumerate(forms):
        found = F.transform(T.matches(F.col("text"), pattern), _of_form(k))
        some = F.col("_named") & F.col("two_digit") if years == "two" else F.col("_named") if years else F.lit(True)
        every.append(F.when(some, found).otherwise(F.array().cast("array<struct<form:int,start:int,raw:string>>")))
    kept = [c for c in windows.columns if c not in ("marker", "two_digit")]
    rows = windows.withColumn("_named", F.col("text").rlike(_names(w))).select(*kept, "marker", F.explode(F.concat(*every)).alias("m"))
    # A match's parts are read from the match alone: texts are long, matches are short.
    of = {o: F.col("m.form").isin([k for k, f in enumerate(forms) if f[0] == o and f[1]]) for o in ("dmy", "ymd", "my")}
    parts = {
        "d": F.when(of["ymd"], F.regexp_extract("m.raw", rf"(?:{_names(w)})\s*([0-9]{{1,2}})$", 1)).when(of["my"], "").otherwise(F.regexp_extract("m.raw", "^[0-9]{1,2}", 0)),
        "m": F.when(of["dmy"] | of["ymd"] | of["my"], F.regexp_extract("m.raw", month, 1)).otherwise(F.regexp_extract("m.raw", "^[0-9]+[./]([0-9]+)", 1)),
        "y": F.when(of["ymd"], F.regexp_extract("m.raw", "^[0-9]{4}", 0)).otherwise(F.regexp_extract("m.raw", "[0-9]+$", 0)),
    }
    # A number behind the word for a clause is no day; the form that starts with a dotted day needs no look back.
    behind = F.col("m.form").isin([k for k, f in enumerate(forms) if f[0] == "dmy" and f[1]]) & F.expr("substring(text, 1, m.start)").rlike(w.clause)
    rows = rows.select(*[c for c in kept if c != "text"], "marker", _once(m=F.struct("m.form", "m.start", "m.raw", behind.alias("behind"), *[c.alias(n) for n, c in parts.items()])))
    form, number = F.col("m.form"), F.col("m.y").cast("int")
    kinds = {y: form.isin([k for k, f in enumerate(forms) if f[1] == y]) for y in ("", "year", "two")}
    four = F.when(kinds["year"], rescued_year(F.col("m.y"), today))
    year = (
        F.when(kinds["year"], four["year"]).when(kinds[""], F.when(number < 100, two_digit_year(number)).otherwise(number))
        .when(F.col("m.d") != "", two_digit_year(number)).otherwise(F.when(number >= 28, number + 1900))
    )
    day = F.when(~F.col("m.behind") & ~F.coalesce(four["turned"], F.lit(False)), F.nullif(F.col("m.d"), F.lit("")).cast("int"))
    month_number = F.when(kinds[""], F.col("m.m").try_cast("int")).otherwise(month_of[F.col("m.m")])
    said = F.when(F.coalesce(four["turned"], F.lit(False)), ";digits-reversed").when(kinds["two"], ";2digit-year").otherwise("")
    rows = rows.select("*", _once(_y=year, _m=month_number, _d=day, _s=said))
    # Years of fewer than four digits give no date, and are not plausible ones either.
    date = F.concat_ws("-", "_y", "_m", F.coalesce("_d", F.lit(1))).try_cast("date")
    rows = rows.select("*", _once(date=F.when(F.col("_y").isNotNull() & F.col("_m").isNotNull(), date))).withColumns({
        "day_known": F.col("_d").isNotNull(), "raw": F.trim(F.regexp_replace("m.raw", r"\s+", " ")), "form": form, "start": F.col("m.start"),
        "marker": F.concat("marker", "_s", F.when(F.col("_d").isNull(), ";month-precision").otherwise("")),
    })
    return rows.where((F.col("date") <= today) & plausible(F.year("date"), today)).drop("m", "_y", "_m", "_d", "_s")


def garbled(text: Column, today: Column) -> Column:
    """Whether digits in a text can't be dates: four that are no year either way, or stray dots between one to three."""
    fours = F.regexp_extract_all(text, F.lit(r"(?<![0-9.])[0-9]{4}(?![0-9])"), F.lit(0))
    return F.exists(fours, lambda t: ~plausible(t.cast("int"), today) & ~plausible(F.reverse(t).cast("int"), today)) | text.rlike(r"(?<![0-9.])(?:\.[0-9]{2,3}|[0-9]{1,2}\.[0-9]{2}|[0-9]{2}\.[0-9])(?![0-9.])")


def marker_of(window: Column, w: Wording = HEBREW) -> Column:
    out = F.lit("marker-line")
    for text, name in reversed(w.markers):
        out = F.when(F.contains(window, F.lit(text)), name).otherwise(out)
    return out


def marker_windows(lines: DataFrame, w: Wording = HEBREW, ahead: int = 4, most: int = 79) -> DataFrame:
    """doc_id, pos, text, marker, two_digit: each marker line (doc_id, pos, line) with the lines after it.

    The window is the line and the next `ahead` ones without classified lines.
    Before it comes, for lines of date lists, the run of up to `most` lines of
    dates that follows.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    clear = F.when(~F.col("line").rlike(w.classified), F.col("line"))
    near = F.array_join(F.array_compact(F.collect_list(F.coalesce(clear, F.lit(""))).over(order.rowsBetween(0, ahead))), " ")
    signs = r"[\s.,:;()'\"-]*"
    datey = F.col("line").rlike(rf"^{signs}({w.glue}?(?:{_names(w)})['\s]*[0-9]{{0,4}}|[0-9]{{1,4}}|{w.dated})?{signs}$")
    # A run of date lines ends at the first other line: islands between those.
    rows = lines.withColumns({"near": near, "datey": datey}).withColumn("island", F.sum((~F.col("datey")).cast("int")).over(order))
    nth = F.row_number().over(Window.partitionBy("doc_id", "island").orderBy("pos"))
    rows = rows.withColumn("nth", nth)
    parts = F.array_sort(F.collect_list(F.when(F.col("nth") <= most + 1, F.struct("pos", "line"))))
    block = rows.groupBy("doc_id", "island").agg(F.array_join(F.transform(parts, lambda p: p["line"]), " ").alias("block"))
    joined = rows.where(F.col("line").rlike(w.keyword) & ~F.col("line").rlike(w.classified)).join(block, ["doc_id", "island"])
    text = F.trim(F.regexp_replace(F.when(F.col("line").rlike(w.spill) & ~F.col("datey"), F.concat("block", F.lit(" "), "near")).otherwise(F.col("near")), r" +", " "))
    return joined.select("doc_id", "pos", _once(text=text)).select("doc_id", "pos", "text", marker_of(F.col("text"), w).alias("marker"), F.lit(True).alias("two_digit"))


def stamp_windows(lines: DataFrame, w: Wording = HEBREW, shortest: int = 20) -> DataFrame:
    """doc_id, pos, text, marker, two_digit of lines (doc_id, pos, line) without a keyword that look like stamps.

    standalone-stamp: a month and a year, or a year, a month and perhaps a day,
    alone. corner-stamp: a month and two digits alone. header-window: a short
    line with a month's name, together with the lines beside it.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    names, signs = _names(w), r"[\s.,']*"
    alone = F.col("line").rlike(rf"^{signs}{w.glue}?(?:{names})\s*[0-9]{{4}}(?![0-9]){signs}$") | F.col("line").rlike(rf"^{signs}[0-9]{{4}}\s*{w.glue}?(?:{names})\s*[0-9]{{0,2}}{signs}$")
    corner = F.col("line").rlike(rf"^{signs}{w.glue}?(?:{names})['׳]?\s*[0-9]{{2}}{signs}$")
    short = (F.length("line") <= shortest) & F.col("line").rlike(names)
    near = F.concat_ws(" ", F.lag("line").over(order), "line", F.lead("line").over(order))
    rows = lines.withColumn("near", near).where(~F.col("line").rlike(w.classified) & ~F.col("line").rlike(w.keyword))
    marker = F.when(alone, "standalone-stamp").when(corner, "corner-stamp").when(short, "header-window")
    return rows.withColumn("marker", marker).where("marker IS NOT NULL").select("doc_id", "pos", F.when(F.col("marker") == "header-window", F.col("near")).otherwise(F.col("line")).alias("text"), "marker", (F.col("marker") == "corner-stamp").alias("two_digit"))


def document_dates(lines: DataFrame, today: Column, w: Wording = HEBREW) -> DataFrame:
    """doc_id, date, precision, raw, marker, n_candidates, garbage: each document's latest defensible date.

    lines: doc_id, pos, line. Marker windows and stamps are harvested together.
    A garbled marker window anywhere leaves only the dates of marker windows
    with four-digit years. At one date a known day goes first, then marker
    windows before stamps, then the place. Documents without a candidate and
    without a garbled window have no row.
    """
    # Lines are few bytes and much work: by their size Spark would deal them to few tasks.
    lines = lines.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    marked = marker_windows(lines, w).withColumns({"tier": F.lit(1), "garbled": garbled(F.col("text"), today)})
    stamped = stamp_windows(lines, w).withColumns({"tier": F.lit(2), "garbled": F.lit(False)})
    windows = marked.unionByName(stamped)
    found = candidates(windows, today, w).withColumn("two", F.contains("marker", F.lit("2digit-year")))
    best = F.struct("date", "day_known", (-F.col("tier")).alias("t"), (-F.col("pos")).alias("p"), (-F.col("form")).alias("f"), (-F.col("start")).alias("s"), "raw", "marker")
    per = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(best).alias("free"), F.max(F.when((F.col("tier") == 1) & ~F.col("two"), best)).alias("strict"))
    flags = windows.groupBy("doc_id").agg(F.max("garbled").alias("garbage"))
    joined = flags.join(per, "doc_id", "left").where(F.col("garbage") | F.col("n").isNotNull())
    chosen = F.when(F.col("garbage"), F.col("strict")).otherwise(F.col("free"))
    told = joined.withColumn("c", chosen)
    precision = F.when(F.col("c").isNotNull(), F.when(F.col("c.day_known"), "day").otherwise("month"))
    return told.select("doc_id", "c.date", precision.alias("precision"), "c.raw", "c.marker", F.coalesce("n", F.lit(0)).alias("n_candidates"), "garbage")
