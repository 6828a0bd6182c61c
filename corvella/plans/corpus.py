"""Queries of document rows, intake, curation gates, answers and experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvella.functions import dates
from corvella.functions import text as T
from corvella.operators import answers, chunking, curation, dense, embedding, experiments, extraction, gates, harvest, index, intake, ledger, ranking
from corvella.operators.stored import stored

from .inputs import HITS_SQL, best_hits, hits, table

NO_ANNEX = "array<struct<id:string,category:string,case:string,conditions:array<string>,approver:string,sub_cases:array<struct<sub_id:string,reason:string,approver_min_rank:string,approver:string,compensation:string,min_sleep_hours:string,max_wake_hours:string,tags:array<string>>>>>"
LATIN, HEBREW = "abcdefghijklmnopqrstuv", "אבגדהוזחטיכלמנסעפצקרשת"
WORDS = {"heading": "annex", "category": "category", "reason": "reason", "sleep": "sleep", "wake": "wake", "hours": "hours", "compensation": "given", "approver": "by", "exception": "exception", "conditions": "if"}


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as documents, their nations as clauses of one section, and as annex cases."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    none = F.array().cast("array<string>")
    clause = F.struct(F.col("n_nationkey").cast("string").alias("number"), F.when(F.col("n_nationkey") % 4 == 0, " ").otherwise(F.concat(F.lit("all about "), F.col("n_name"))).alias("text"), none.alias("tags"))
    sub = F.struct(
        F.col("n_nationkey").cast("string").alias("sub_id"), F.col("n_name").alias("reason"), F.when(F.col("n_nationkey") % 2 == 0, "major").alias("approver_min_rank"), F.lit("colonel").alias("approver"),
        F.when(F.col("n_nationkey") % 3 == 0, "a day").alias("compensation"), F.when(F.col("n_nationkey") % 5 != 0, F.lit("6")).alias("min_sleep_hours"), F.lit("").alias("max_wake_hours"), none.alias("tags"),
    )
    per = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", clause.alias("c"), sub.alias("s")))).alias("x"))
    docs = r.join(per, r.r_regionkey == per.n_regionkey)
    key = F.col("r_regionkey")
    section = F.struct(F.when(key % 2 == 0, "key-facts").otherwise("s1").alias("id"), F.lower("r_name").alias("title"), F.transform("x", lambda x: x["c"]).alias("clauses"))
    annex = F.struct(
        F.lit("7").alias("id"), F.when(key % 2 == 0, F.concat(F.lit(" "), F.col("r_name"))).alias("category"), F.col("r_name").alias("case"), F.array(F.lit("one"), F.lit("two")).alias("conditions"), F.lit("general").alias("approver"),
        F.when(key % 2 == 0, F.transform("x", lambda x: x["s"])).alias("sub_cases"),
    )
    return docs.select(
        F.concat(F.lit("PM-"), key.cast("string")).alias("document_id"), F.when(key != 1, F.col("r_name")).alias("title"), F.concat("r_name", F.lit(".pdf")).alias("source_file"), F.concat(F.col("r_name"), F.lit("  is large\n")).alias("raw_text"),
        F.when(key == 3, F.array().cast("array<struct<id:string,title:string,clauses:array<struct<number:string,text:string,tags:array<string>>>>>")).otherwise(F.array(section)).alias("sections"),
        F.array(annex).cast(NO_ANNEX).alias("annex_exceptions"), F.when(key == 0, F.array(F.lit("a question of it"))).alias("anchor_questions"),
    )


def clause_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.clause_rows(_orders(spark, sf_dir).withColumn("title", F.coalesce("title", F.lit("-"))))


def annex_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.annex_rows(_orders(spark, sf_dir).withColumn("title", F.coalesce("title", F.lit("-"))), WORDS)


def structure_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.structure_audit(_orders(spark, sf_dir))


def document_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.document_info(_orders(spark, sf_dir))


def section_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("document_id", curation.section_body(F.col("sections"), 200, 30).alias("body"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents, with and without sections, curated rows and anchors: those that need anchors, and those that need sections."""
    k = F.col("c_custkey")
    section = F.array(F.struct(F.when(k % 3 == 1, "key-facts").otherwise("s1").alias("id")))
    sections = F.when(k % 3 == 0, F.filter(section, lambda s: F.lit(False))).otherwise(section)
    anchors = F.when(k % 4 == 0, F.array(F.lit("a question"))).when(k % 4 == 1, F.array().cast("array<string>"))
    docs = table(spark, sf_dir, "customer").select(F.when(k % 10 < 9, F.concat(F.lit("PM-"), k.cast("string"))).alias("document_id"), sections.alias("sections"), anchors.alias("anchor_questions"))
    a = curation.anchor_targets(docs, ["PM-1", "PM-7"]).withColumn("needs", F.lit("anchors"))
    return a.unionByName(curation.curation_targets(docs, ["PM-3"]).withColumn("needs", F.lit("sections")))


def clause_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    section = F.when(k % 2 == 0, "chunk text").otherwise(F.concat(F.lit("s"), k.cast("string")))
    key = T.clause_key(section, F.concat_ws("–", k.cast("string"), (k + 1).cast("string")))
    return table(spark, sf_dir, "nation").select(k.alias("n"), key.alias("clause_key"), curation.citation(F.col("n_name"), F.when(k % 3 == 0, "").otherwise(section)).alias("citation"))


def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.latest(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


def last_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return curation.last_accepted(accepted, table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey", "o_orderkey")


def carried_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.lit("new").alias("status"))
    old = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderstatus").alias("status"))
    return intake.previous_document(new, old, "c_custkey", ["status"], "o_orderkey")


def carried_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    old = new.where("p_partkey % 3 = 0").select("p_partkey", F.concat(F.lit("old "), "p_brand").alias("p_brand"))
    return chunking.carried_forward(new, old, "p_partkey", ["p_brand"])


def new_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return intake.new_ids(docs, docs.where("doc_id % 7 > 0"), "doc_id")


def embedded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the benchmark's lines come from the cache and how many are new."""
    lines = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("text"))
    keyed = lines.select(F.sha1("text").alias("text_sha1")).distinct()
    cache = keyed.where(F.startswith("text_sha1", F.lit("0"))).select("text_sha1", F.lit("m").alias("model"), F.array(F.lit(1.0)).alias("vector"))
    every, new = embedding.embedded(lines, cache, embedding.hashed_words(16), "m")
    return every.agg(F.count(F.lit(1)).alias("n")).select(F.lit("all").alias("part"), "n").unionAll(new.agg(F.count(F.lit(1)).alias("n")).select(F.lit("new"), "n"))


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("text"))
    cache = lines.select(F.sha1("text").alias("text_sha1"), F.when(F.length("text") % 2 == 0, "m").otherwise("other").alias("model")).distinct()
    return dense.embedding_misses(lines, cache, "m")


def pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean direction of each label's vectors."""
    found = embedding.pooled(table(spark, sf_dir, "embeddings").select("label", F.col("embedding").alias("vector")), "label")
    return found.select("label", F.posexplode("vector").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(T.refused(F.col("text"), ["the", "der", "les"]), F.lit(False)).alias("refused"))


def risk_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = [["idiot"], ["license", "copyright"], ["@"]]
    return table(spark, sf_dir, "documents").select("doc_id", T.new_topic(F.left("text", F.lit(500)), F.substr("text", F.lit(501)), families).alias("risky"))


def _hebrew(text: str) -> Column:
    return F.translate(F.lower(text), LATIN, HEBREW)


def hebrew_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term forms under the rules of Hebrew, of the benchmark in Hebrew letters."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.array_distinct(T.words(_hebrew("text")))).alias("word")).distinct()
    return words.select("word", F.array_join(F.array_sort(T.term_variants(F.col("word"), T.HEBREW)), "|").alias("forms"))


def curation_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.curation_stems(_hebrew("text")), " ").alias("stems"))


def grounding_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as curated clauses of the document of that id, both in Hebrew letters; a third of the documents is numbered."""
    marks = F.when(F.col("doc_id") % 3 == 0, "1.  2.  3.  4.  5.  6.  7.  ").otherwise("")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(marks, _hebrew("text")).alias("raw_text"))
    said = F.when(F.col("item_id") % 2 == 0, " סעיף 3").when(F.col("item_id") % 5 == 0, " סעיפים 2, 40").otherwise("")
    clauses = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("1").alias("number"), F.concat(_hebrew("text"), said).alias("text"))
    found = curation.grounding(clauses, docs)
    return found.select("doc_id", "n_words", "share", F.array_join(F.col("bad_citations").cast("array<string>"), ",").alias("bad"), F.array_join("problems", ",").alias("problems"), F.array_join("warnings", ",").alias("warnings"))


def unsupported_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    text = F.concat(F.lit("pay "), (k % 13).cast("string"), F.lit(" days, since "), F.year("o_orderdate").cast("string"), F.lit(" (סעיפים 4-9)"))
    raw = F.concat(F.lit("three of "), (k % 7).cast("string"), F.lit(" in '"), F.right(F.year("o_orderdate").cast("string"), F.lit(2)))
    return curation.unsupported_numbers(docs.select(k.alias("doc_id"), text.alias("text"), raw.alias("raw_text")), {3: ["three"]})


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made lines, a few a page, of which some are clause numbers; each clause's first page in order."""
    l = table(spark, sf_dir, "lineitem")
    n = (F.col("l_suppkey") % 7).cast("string")
    line = F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("."), n)).when(F.col("l_partkey") % 5 == 1, F.concat(n, F.lit("."))).when(F.col("l_partkey") % 5 == 2, n).when(F.col("l_partkey") % 5 == 3, ".").otherwise("words")
    pos = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    lines = l.groupBy((F.col("l_orderkey") % 500).alias("doc_id"), (F.col("l_linenumber") % 4).alias("page"), pos.alias("pos")).agg(F.min(line).alias("line"))
    return intake.heading_numbers(lines)


def heading_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    rows = l.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("clause"), F.array((F.col("l_partkey") % 9).cast("int"), (F.col("l_suppkey") % 5).cast("int")).alias("candidates"))
    return extraction.heading_pages(rows)


def built_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    day = F.when(k % 3 > 0, (k % 31 + 1).cast("int"))
    made = dates.built_date(F.year("o_orderdate") + 15, (k % 13).cast("int"), day, F.to_date(F.lit("2012-06-30")))
    return o.select("o_orderkey", made.cast("string").alias("iso"), dates.badge(made, day.isNull()).alias("badge"))


#: Parts of which rulings are put together: what negates, the term, what follows it, and what may stand around a clause.
NEGATIONS = ("", "לא ", "אינך ", "", "אין ", "אינו  ")
TERMS = ("מותר", "אסור", "מוסמך", "רשאי", "זכאי", "פטור", "חייב", "ניתן", "אפשר", "מגיע לך", "נמצאה", "בנוגע למסדר")
TAILS = ("", " בתנאים", " חלקית — רק בלילה", " אך ורק באישור", ", אך אסור בלילה", " עד 7 ימים", " לקבל החזר", " צו", " רק ביום", " ולא בשבת", " אלא אם סוכם", " בתנועה רגלית", " ומגיע לו", " " + "ארוך " * 12)
AROUND = ("", T.DIRECTIONS[1], "** ", T.DIRECTIONS[0] + "*", "")


def _pick(options: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (at % len(options) + 1).cast("int"))


def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with two clauses of rulings put together by their keys, and answers whose ruling line holds them."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    one = F.concat(_pick(NEGATIONS, k), _pick(TERMS, c), _pick(TAILS, k + c))
    two = F.concat(_pick(NEGATIONS, c), _pick(TERMS, k), _pick(TAILS, k * 3 + c))
    line = F.concat(_pick(AROUND, k), F.when(k % 4 > 0, "**פסיקה:** ").otherwise("פסיקה: "), one, F.lit(" ;"), two, _pick(("", "**", "; ", "** " + T.DIRECTIONS[2]), c))
    return o.select(k.alias("id"), F.concat(_pick(AROUND, c), one, _pick(("", ".", T.DIRECTIONS[3]), k)).alias("clause"), F.concat(F.lit("כותרת\n"), F.when(k % 9 > 0, line).otherwise("אין כאן"), F.lit(" \nפסיקה: מותר")).alias("answer"))


def rulings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ruled(spark, sf_dir).select("id", T.verdict_class(F.col("clause"), T.HEBREW_VERDICTS).alias("cls"), answers.chip(F.col("clause")).alias("chip"))


def ruling_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = answers.ruling_clauses(answers.ruling_line(F.col("answer")))
    return _ruled(spark, sf_dir).select("id", F.posexplode(found).alias("pos", "c")).select("id", "pos", "c.text", "c.cls")


#: Lines of which answers are put together. Some look like labels or notes and are not.
ANSWER_LINES = (
    "**פסיקה:** {}", "prose about {}", "", "הפקודות אינן קובעות את {}", "**מקור:** 33.{} — leave and rest, סעיף 4; other", "**חשוב מאוד** לדעת {}", "- **התנהלות נכונה**: {}", "**התנהלות החייל**:  {} ", "**מקור:** ; ",
    "**תווית ארוכה מאוד שאין לה סוף ואין לה גבול:** {}", "הפקודות שסופקו לא מגדירות {}", "  ", "** " + T.DIRECTIONS[1] + "הערה" + T.DIRECTIONS[1] + " :** note {}", "**טרם במאגר**: " + T.DIRECTIONS[0] + "{}", "a long line of prose that comes before הפקודות אינן קובעות {}", "**מי מאשר:**",
)


def answer_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's items as the lines of an answer."""
    l = table(spark, sf_dir, "lineitem")
    at = F.col("l_partkey") + F.col("l_suppkey") * 5 + F.col("l_linenumber")
    line = F.replace(_pick(ANSWER_LINES, at), F.lit("{}"), F.col("l_partkey").cast("string"))
    rows = l.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("line")))).alias("x"))
    return answers.blocks(rows.select("id", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("body")))


SOURCE_TITLES = ("33.{} - leave and rest", "work, pay", "plain — title {}", "", "{}–{}-{}", " " + T.DIRECTIONS[1] + "order {} ", "סעיפון {}")
SOURCE_CLAUSES = ("", ", סעיף {}", " · סעיפים {}-9", "סעיף 1", " — סעיף 4(ב), סעיף {}", ", סעיף")


def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources a line, put together by the keys of items."""
    l = table(spark, sf_dir, "lineitem")
    k, c, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    value = F.concat(_pick(SOURCE_TITLES, k), _pick(SOURCE_CLAUSES, c), F.lit(" ; "), _pick(SOURCE_TITLES, c), _pick(SOURCE_CLAUSES, k + n))
    rows = l.select(k.alias("id"), n.alias("line"), F.replace(value, F.lit("{}"), c.cast("string")).alias("value"))
    return rows.select("id", "line", F.posexplode(answers.sources(F.col("value"))).alias("pos", "s")).select("id", "line", "pos", "s.title", "s.clause")


def date_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line by itself, with two-digit years."""
    rows = _dated_lines(spark, sf_dir).select("pos", F.col("line").alias("text"), F.lit("m").alias("marker"), F.lit(True).alias("two_digit"))
    found = harvest.candidates(rows, F.to_date(F.lit("2026-08-01")))
    return found.select("pos", F.col("date").cast("string").alias("iso"), F.col("day_known").cast("int").alias("day_known"), "marker")


def date_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _dated_lines(spark, sf_dir)
    return harvest.marker_windows(lines).unionByName(harvest.stamp_windows(lines)).select("doc_id", "pos", "text", "marker")


MONTH_NAMES = ("ינואר", "פברואר", "מרץ", "אפריל", "מאי", "יוני", "יולי", "אוגוסט", "ספטמבר", "אוקטובר", "נובמבר", "דצמבר")


def _dated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as the lines of a document: lists of dates in several forms, stamps, classified and garbled lines."""
    o = table(spark, sf_dir, "orders")
    names = F.array(*map(F.lit, MONTH_NAMES))
    day = F.to_date("o_orderdate")
    days = [F.date_add(day, n) for n in (0, 40, 75)]
    dotted = [F.date_format(d, "d.M.yyyy") for d in days]
    named = [F.element_at(names, F.month(d)) for d in days]
    long = [F.concat(F.dayofmonth(d).cast("string"), F.lit(" ב"), m, F.lit(" "), F.date_format(d, "yyyy")) for d, m in zip(days, named)]
    k = F.col("o_orderkey") % 17
    line = (
        F.when(k < 4, F.concat(F.lit("עודכן "), dotted[0], F.lit(", "), F.date_format(days[1], "d.M.yy"), F.lit(", "), dotted[2]))
        .when(k < 8, F.concat(F.lit("תוקן סעיף "), long[0], F.lit(", "), long[1], F.lit(", "), F.dayofmonth(days[2]).cast("string"), F.lit(" ב"), named[2], F.date_format(days[2], " yy")))
        .when(k < 9, F.concat(F.lit("סיווג "), dotted[0])).when(k < 11, F.concat(named[0], F.date_format(days[0], " yyyy"))).when(k < 13, F.lit("תאריכי עדכון"))
        .when(k < 15, F.concat(named[0], F.date_format(days[0], " yy"))).when(k < 16, F.concat(F.lit("כללי "), dotted[0])).otherwise(F.when(F.col("o_orderkey") % 5 == 0, "עודכן 3751").otherwise("רגיל"))
    )
    return o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), line.alias("line"))


def document_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = harvest.document_dates(_dated_lines(spark, sf_dir), F.to_date(F.lit("2026-08-01")))
    return found.select("doc_id", F.col("date").cast("string").alias("iso"), "precision", "n_candidates", "garbage")


FILE_HEADS = ("", "a ", "פמ-", "05-", "0", "12 ")
FILE_TAILS = (".pdf", "x.PDF", "-בחירות.pdf", " 0214", "")


def intake_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names and ids put together by the keys of parts of orders."""
    l = table(spark, sf_dir, "lineitem")
    k, n = F.col("l_orderkey"), F.col("l_partkey")
    digits = F.concat((k * 37 % F.pow(F.lit(10), n % 6 + 2).cast("long")).cast("string"), F.when(n % 3 == 0, F.concat(F.lit("-0"), F.col("l_linenumber").cast("string"), F.lit("13"))).otherwise(""))
    rows = l.select(k.alias("id"), "l_linenumber", F.concat(_pick(FILE_HEADS, n), digits, _pick(FILE_TAILS, k)).alias("file"), n.alias("n"))
    rows = rows.withColumn("number", intake.file_number(F.col("file")))
    own = F.when(F.col("n") % 4 == 0, F.concat(F.lit("PM-0"), F.col("number"))).when(F.col("n") % 4 == 1, F.replace("number", F.lit("."), F.lit(""))).otherwise(F.concat(F.lit("PM-31.0"), F.col("n").cast("string")))
    return rows.select("id", "l_linenumber", "file", "number", intake.suspicious_id(F.coalesce(own, F.lit("leave")), F.col("file")).cast("int").alias("suspicious"))


DEBRIS = ("", "]", "}", '"', " ", ",", " [1] ", "x")


def json_debris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts with brackets, quotes and commas around them."""
    l = table(spark, sf_dir, "lineitem")
    k, n = F.col("l_orderkey"), F.col("l_partkey")
    text = F.concat(F.lit("part "), n.cast("string"), _pick(DEBRIS, k), _pick(DEBRIS, n), _pick(DEBRIS, k + n * 3), _pick(("", " more", " }"), n + k))
    return l.select(k.alias("id"), "l_linenumber", text.alias("text"), T.json_debris(text).cast("int").alias("debris"))


def page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = table(spark, sf_dir, "pages").select("page_id", F.sha1("html").alias("digest"))
    now = table(spark, sf_dir, "pages").where("page_id % 11 > 0")
    k = F.col("page_id")
    current = now.select("page_id", F.when(F.contains("url", F.lit("?")), F.sha1("url")).otherwise(F.sha1("html")).alias("digest"), F.when(k % 5 == 0, 404).when(k % 7 > 0, 200).alias("page_status"), (k % 13 == 0).cast("int").alias("n_errors"))
    return intake.snapshot_status(before, current, "page_id")


def owned_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which links lead to orders that are held, by the digits of their last path part."""
    links = table(spark, sf_dir, "pages").select("page_id", T.order_digits(F.concat(F.lit("http://x/y/"), (F.col("page_id") * 37 % 20_000).cast("string"))).alias("digits"))
    held = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).cast("string").alias("digits"))
    return intake.owned(links, held, "digits")


def doc_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of documents in the order of a name, from counts by range blocks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.reverse(F.col("doc_id").cast("string")), F.lit("/"), F.col("doc_id").cast("string")).alias("file_name"))
    return intake.numbered(docs).select("doc_id", "doc_ord")


def turn_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    profile = F.when(k % 3 > 0, F.slice(F.array(F.lit("alone"), F.lit("new")), 1, (k % 3).cast("int")))
    turn = answers.user_turn(F.col("s_name"), F.col("s_name"), profile, "Sources:", "about: ", ". if it matters.")
    letter = answers.letter_query(F.col("s_name"), [F.when(k % 2 == 0, F.lit(" ")).otherwise(F.lit("field")), F.repeat(F.lit("long "), 30)])
    return s.select("s_suppkey", turn.alias("turn"), answers.preview(F.col("s_name"), 12).alias("preview"), letter.alias("letter"))


def question_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    name, k = F.col("p_name"), F.col("p_partkey")
    return p.select(
        "p_partkey", answers.suggestion_ok(name, "ing|of this", 30).alias("suggested"), answers.escalates(F.col("p_brand"), name, ["Brand#12"], "re[dn]").alias("escalates"),
        answers.clamped(F.when(k % 4 == 0, F.lit("x")).otherwise((k % 90).cast("string")), 5.0, 50.0, 7.0).alias("clamped"),
        F.array_join(answers.picked(F.array((k % 4).cast("string"), F.lit("9"), (k % 3).cast("string")), F.array(F.lit("1"), F.lit("2"), F.lit("3"))), ",").alias("picked"),
        experiments.percentage_band(F.col("p_size"), [(10, 10.0), (30, 25.0)], 0.0).alias("percent"), intake.storage_status(k % 2 == 0, F.when(k % 6 == 0, "ok").when(k % 6 == 2, "error")).alias("storage"),
        experiments.outcome(F.nullif(k % 5, F.lit(4)), k % 3).alias("outcome"),
    )


def answer_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    tops = F.array(F.col("lang"), F.col("source"), F.lit("fr"), F.lit("en"))
    groups = F.array(F.array(F.lit("the"), F.lit("der")), F.array(F.lit("and"), F.lit("und"), F.lit("et")))
    return d.select("doc_id", answers.facts_hold(F.col("text"), tops, F.array(F.lit("en"), F.lit("de")), groups, "The").alias("facts"), answers.out_of_scope_ok(F.col("text"), "license", ["der", "les"], "##").alias("refusal"))


def query_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three hits of each query as one context, of those that aren't the query itself and score 0.3 or more; some queries have none."""
    top = index.per_query_top(best_hits(spark, sf_dir, 4).where("score >= 0.3 AND query_id <> row_id"), 3, "score", ["row_id"])
    every = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"))
    rows = every.join(top.select("query_id", "rank", "doc_id", F.col("section").alias("title"), F.col("row_id").cast("string").alias("clause"), F.col("score").cast("string").alias("text")).withColumn("text", F.lit("body")), "query_id", "left")
    return answers.context_of(rows, "nothing found")


def rewritten_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("text"))
    changes = lines.select(F.col("text").alias("original")).distinct().where("length(original) % 3 < 2").withColumn("replacement", F.when(F.length("original") % 3 == 0, "").otherwise(F.reverse("original")))
    return curation.rewritten(lines, changes).select("item_id", F.sha1("text").alias("text_sha1"))


def gap_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    found = curation.gap_topics(o.select(F.col("o_orderpriority").alias("topic"), F.col("o_orderstatus").alias("audience"), (F.col("o_totalprice") > 100_000).alias("confident")))
    return found.select("topic", "n", F.array_join("audiences", ",").alias("audiences"))


def uncovered_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as anchors, each with its best score over the other rows' queries."""
    h = hits(spark, sf_dir).where("query_id <> row_id").groupBy("doc_id", F.col("row_id").alias("anchor")).agg(F.max("score").alias("score"))
    found = curation.uncovered_by_doc(h, table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("doc_id")))
    return found.select("doc_id", "n", F.array_join(F.col("anchors").cast("array<string>"), ",").alias("anchors"))


def ordered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("section")).agg(F.count(F.lit(1)).alias("n"))
    return curation.in_section_order(rows, ["MACHINERY", "NONE", "BUILDING", "AUTOMOBILE"])


def boilerplate_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty documents with most words in license lines."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.lower("line").rlike("license|copyright"))
    return lines.groupBy("doc_id").agg(F.sum(F.size(T.words(F.col("line")))).alias("n")).orderBy(F.desc("n"), "doc_id").limit(20)


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("doc_id"))


def stripped_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.rank_without_anchors(best_hits(spark, sf_dir, 2, sections=True).where("row_id <> query_id"), _gold(spark, sf_dir))


def layer_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    others = stored(best_hits(spark, sf_dir, 5, sections=True).where("row_id <> query_id"))
    deployed = ranking.hit_at(ranking.distinct_sources(index.per_query_top(others, 8, "score", ["row_id"], cap=4)), _gold(spark, sf_dir))
    return experiments.layer_audit(deployed, experiments.rank_without_anchors(others, _gold(spark, sf_dir)))


def self_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a label's own query vectors find it."""
    others = best_hits(spark, sf_dir, 5).where("row_id <> query_id")
    ranked = ranking.distinct_sources(index.per_query_top(others, 8, "score", ["row_id"], cap=4))
    anchors = _gold(spark, sf_dir).select("doc_id", F.col("query_id").alias("pos"), F.col("query_id").alias("anchor_id"))
    return experiments.self_retrieval(anchors, ranked)


def budget_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows gained where twice and four times the results are asked for."""
    best = stored(best_hits(spark, sf_dir, 4))
    return experiments.ablation(lambda n: index.per_query_top(best, n, "score", ["row_id"], cap=4), 4)


def probe_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", "blind").otherwise("inside_out").alias("source"), F.when(F.col("n_chars") > 2000, "yellow").otherwise("red").alias("band"))
    return experiments.probe_sample(rows, 90).select("id", "source")


def call_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    rows = l.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("model"), F.col("l_partkey").alias("tokens_in"), F.col("l_suppkey").alias("tokens_out"), F.col("l_orderkey").alias("cache_write"), (F.col("l_orderkey") * 2).alias("cache_read"), (F.col("l_linenumber") % 2 == 0).alias("batch"))
    prices = spark.createDataFrame([("A", 5.0, 25.0), ("R", 1.0, 5.0)], "model string, price_in double, price_out double")
    return experiments.call_cost(rows, prices, (5.0, 25.0), digits=12).select("l_orderkey", "l_linenumber", "cost")


def ledger_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user and day reserve, settle and release one entry; the day's ceiling turns some reservations down."""
    k = F.col("event_id")
    kind = F.when(k % 5 == 1, "settle").when(k % 7 == 3, "release").otherwise("reserve")
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "ts", k.alias("seq"), F.col("user_id").alias("id"), kind.alias("kind"), F.round(F.col("value") * 100).cast("long").alias("amount"))
    totals = ledger.day_totals(ledger.enforced(rows, 60_000), 60_000)
    return totals.withColumn("day", F.col("day").cast("string"))


def wordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many combinations of wordings as 100 questions need."""
    roles = table(spark, sf_dir, "region").select(F.col("r_name").alias("role"), F.lower("r_name").alias("persona"))
    return experiments.combinations(roles, table(spark, sf_dir, "nation").select(F.col("n_name").alias("situation")), 100)


def degraded_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.degraded(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), {"the": "da", "and": "n"}, "abcdefgh")


QUERIES = {f.__name__: f for f in (
    clause_rows, annex_rows, structure_audit, document_info, section_bodies, targets, clause_keys, latest_rows, last_accepted, carried_fields, carried_forward, new_keys, embedded_lines, cache_misses, pooled_vectors,
    refused, risk_topics, hebrew_terms, curation_stems, grounding_gate, unsupported_numbers, headings, heading_pages, built_dates, rulings, ruling_clauses, answer_blocks, answer_sources, date_harvest, date_windows, document_dates, intake_numbers,
    json_debris, page_status, owned_links, doc_order, turn_texts, question_gates, answer_gates, query_contexts, rewritten_lines, gap_topics, uncovered_docs, ordered_sections, boilerplate_top, stripped_ranks, layer_audit,
    self_retrieval, budget_ablation, probe_sample, call_costs, ledger_state, wordings, degraded_questions,
)}

_HEB = f"translate(lower(text), '{LATIN}', '{HEBREW}')"
_STEMS = """list_sort(list_distinct(flatten(list_transform(list_transform(regexp_extract_all({}, '[א-ת]{{3,}}'), lambda w: translate(w, 'םןץףך', 'מנצפכ')),
  lambda w: flatten(list_transform(CASE WHEN length(w) > 3 AND contains('הובלמכש', left(w, 1)) THEN [w, substr(w, 2)] ELSE [w] END,
    lambda f: list_concat([f], list_filter(list_transform(['ים', 'ות', 'יים', 'ה', 'י', 'ן', 'ך', 'ו'], lambda x: CASE WHEN length(f) > length(x) + 2 AND ends_with(f, x) THEN left(f, length(f) - length(x)) END), lambda y: y IS NOT NULL))))))))"""
_TOP = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id)"
_TOP_DOCS = f"""others AS (SELECT * FROM hits WHERE row_id <> query_id), capped AS (SELECT *, {_TOP} AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, row_id) AS d FROM others) WHERE d <= 4),
places AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS place FROM capped WHERE rank <= 8 GROUP BY 1, 2), gold AS (SELECT vec_id AS query_id, label AS doc_id FROM embeddings WHERE vec_id % 100 = 0)"""
_STRIPPED = """best AS (SELECT query_id, doc_id, first((score, -row_id, section) ORDER BY score DESC, row_id) AS b, max(score) AS s, arg_max(row_id, (score, -row_id)) AS r FROM others WHERE section <> 'sq' GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, r) AS place FROM best),
stripped AS (SELECT query_id, place AS target_rank, CASE r % 3 WHEN 1 THEN 'key-facts' ELSE 'chunk' END AS section FROM ranked JOIN gold USING (query_id, doc_id))"""
_ORDERS = """d AS (SELECT r_regionkey AS k, 'PM-' || r_regionkey AS doc_id, CASE WHEN r_regionkey = 1 THEN '-' ELSE r_name END AS title, r_name, CASE WHEN r_regionkey % 2 = 0 THEN 'key-facts' ELSE 's1' END AS sid FROM region),
c AS (SELECT *, CASE WHEN n_nationkey % 4 = 0 THEN ' ' ELSE 'all about ' || n_name END AS said FROM nation JOIN d ON n_regionkey = k)"""

_NEG, _TERM = T.HEBREW_VERDICTS.negations, T.HEBREW_VERDICTS.terms
_COND = r"אך ורק|ובלבד|בכפוף|בתנאי|למעט|בחריגים|באישור|אלא אם|(?:^|\s)רק\s"


def _marks(characters: str) -> str:
    """Characters as SQL."""
    return "(" + " || ".join(f"chr({ord(c)})" for c in characters) + ")"


def _option(options: tuple[str, ...], at: str) -> str:
    return "[" + ", ".join("'" + o + "'" for o in options) + f"][({at}) % {len(options)} + 1]"


_RULED = f"""parts_of AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders),
both_of AS (SELECT k, c, {_option(NEGATIONS, 'k')} || {_option(TERMS, 'c')} || {_option(TAILS, 'k + c')} AS one, {_option(NEGATIONS, 'c')} || {_option(TERMS, 'k')} || {_option(TAILS, 'k * 3 + c')} AS two FROM parts_of),
ruled AS (SELECT k AS id, {_option(AROUND, 'c')} || one || {_option(("", ".", T.DIRECTIONS[3]), 'k')} AS clause,
  'כותרת' || chr(10) || CASE WHEN k % 9 > 0 THEN {_option(AROUND, 'k')} || CASE WHEN k % 4 > 0 THEN '**פסיקה:** ' ELSE 'פסיקה: ' END || one || ' ;' || two || {_option(("", "**", "; ", "** " + T.DIRECTIONS[2]), 'c')} ELSE 'אין כאן' END || ' ' || chr(10) || 'פסיקה: מותר' AS answer FROM both_of)"""
_CLASSED = rf"""opened AS (SELECT *, regexp_extract(trim({{clause}}), '^((?:{_NEG})\s+)?({_TERM})(.*)$', ['neg', 'term', 'tail']) AS m FROM {{src}}),
classed AS (SELECT *, CASE WHEN starts_with(trim({{clause}}), 'לא נמצא') THEN 'none' WHEN m.term = '' OR m.neg <> '' AND m.term = 'אסור' THEN 'accent' WHEN starts_with(trim(m.tail), 'בתנאים') OR starts_with(trim(m.tail), 'חלקית') THEN 'cond'
  WHEN (m.neg <> '' OR m.term = 'אסור') AND regexp_matches(m.tail, 'מותר|רשאי|זכאי|מוסמך|פטור|מגיע') THEN 'cond' WHEN m.neg <> '' OR m.term = 'אסור' THEN 'no' WHEN contains(m.tail, 'אסור') OR regexp_matches(trim(m.tail), '{_COND}') THEN 'cond' ELSE 'yes' END AS cls FROM opened)"""

_DATED = rf"""b AS (SELECT o_custkey AS doc_id, o_orderkey AS pos, o_orderkey % 17 AS k, o_orderdate::DATE AS d0, o_orderdate::DATE + 40 AS d1, o_orderdate::DATE + 75 AS d2, {[*MONTH_NAMES]} AS m FROM orders),
s AS (SELECT *, day(d0) || ' ב' || m[month(d0)] || ' ' || year(d0) AS l0, day(d1) || ' ב' || m[month(d1)] || ' ' || year(d1) AS l1, day(d2) || ' ב' || m[month(d2)] || strftime(d2, ' %y') AS l2 FROM b),
l AS (SELECT doc_id, pos, CASE WHEN k < 4 THEN 'עודכן ' || strftime(d0, '%-d.%-m.%Y') || ', ' || strftime(d1, '%-d.%-m.%y') || ', ' || strftime(d2, '%-d.%-m.%Y') WHEN k < 8 THEN 'תוקן סעיף ' || l0 || ', ' || l1 || ', ' || l2
  WHEN k < 9 THEN 'סיווג ' || strftime(d0, '%-d.%-m.%Y') WHEN k < 11 THEN m[month(d0)] || ' ' || year(d0) WHEN k < 13 THEN 'תאריכי עדכון' WHEN k < 15 THEN m[month(d0)] || strftime(d0, ' %y')
  WHEN k < 16 THEN 'כללי ' || strftime(d0, '%-d.%-m.%Y') ELSE CASE WHEN pos % 5 = 0 THEN 'עודכן 3751' ELSE 'רגיל' END END AS line FROM s)"""
_DATE_WINDOWS = rf"""f AS (SELECT *, contains(line, 'סיווג') AS cl, regexp_matches(line, 'עודכן|תוקן|תאריכי עדכון') AS kw, regexp_matches(line, '^({"|".join(MONTH_NAMES)}) [0-9]+$') AS st, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM l),
near AS (SELECT a.doc_id, a.n, string_agg(z.line, ' ' ORDER BY z.n) FILTER (NOT z.cl) AS t FROM f a JOIN f z ON z.doc_id = a.doc_id AND z.n BETWEEN a.n AND a.n + 4 WHERE a.kw AND NOT a.cl GROUP BY 1, 2),
stop AS (SELECT a.doc_id, a.n, min(z.n) AS z FROM f a LEFT JOIN f z ON z.doc_id = a.doc_id AND z.n > a.n AND NOT z.st WHERE a.line = 'תאריכי עדכון' GROUP BY 1, 2),
block AS (SELECT s.doc_id, s.n, string_agg(z.line, ' ' ORDER BY z.n) AS t FROM stop s JOIN f z ON z.doc_id = s.doc_id AND z.n >= s.n AND (s.z IS NULL OR z.n < s.z) AND z.n < s.n + 80 GROUP BY 1, 2),
w AS (SELECT doc_id, n, coalesce(block.t || ' ', '') || near.t AS t, 1 AS tier, true AS two FROM near LEFT JOIN block USING (doc_id, n)
  UNION ALL SELECT doc_id, n, line, 2, NOT regexp_matches(line, '[0-9]{{4}}') FROM f WHERE st)"""
_DATES_IN = rf"""c AS (
  SELECT doc_id, tier, unnest(regexp_extract_all(t, '(?:^|[^0-9.])([0-9]+)[.]([0-9]+)[.]([0-9]+)', 1)) AS d, unnest(regexp_extract_all(t, '(?:^|[^0-9.])([0-9]+)[.]([0-9]+)[.]([0-9]+)', 2)) AS mo, unnest(regexp_extract_all(t, '(?:^|[^0-9.])([0-9]+)[.]([0-9]+)[.]([0-9]+)', 3)) AS y, false AS yy FROM p
  UNION ALL SELECT doc_id, tier, CASE WHEN starts_with(x, 'סעיף') THEN NULL ELSE regexp_extract(x, '([0-9]+) ב', 1) END, list_position({[*MONTH_NAMES]}, regexp_extract(x, ' ב([^ ]+) ', 1))::VARCHAR, right(x, 4), false
    FROM (SELECT *, unnest(regexp_extract_all(t, '(?:סעיף )?[0-9]+ ב' || mm || ' [0-9]{{4}}')) AS x FROM p)
  UNION ALL SELECT doc_id, tier, nullif(regexp_extract(x, ' ([0-9]+)$', 1), ''), list_position({[*MONTH_NAMES]}, regexp_extract(x, '[0-9]{{4}} ב?' || mm, 1))::VARCHAR, left(x, 4), false FROM (SELECT *, unnest(regexp_extract_all(t, '[0-9]{{4}} ב?' || mm || '(?: [0-9]{{1,2}}\b)?')) AS x FROM p)
  UNION ALL SELECT doc_id, tier, NULL, list_position({[*MONTH_NAMES]}, split_part(substr(x, 2), ' ', 1))::VARCHAR, right(x, 4), false FROM (SELECT *, unnest(regexp_extract_all(t, 'ב' || mm || ' [0-9]{{4}}')) AS x FROM p)
  UNION ALL SELECT doc_id, tier, NULL, list_position({[*MONTH_NAMES]}, split_part(substr(x, 2), ' ', 1))::VARCHAR, right(x, 4), false FROM (SELECT *, unnest(regexp_extract_all(' ' || t, ' ' || mm || ' [0-9]{{4}}')) AS x FROM p)
  UNION ALL SELECT doc_id, tier, regexp_extract(x, '^([0-9]+)', 1), list_position({[*MONTH_NAMES]}, regexp_extract(x, ' ב([^ ]+) ', 1))::VARCHAR, regexp_extract(x, ' ([0-9]{{2}}) $', 1), true FROM (SELECT *, unnest(regexp_extract_all(t || ' ', '[0-9]+ ב' || mm || ' [0-9]{{2}} ')) AS x FROM p WHERE two)
  UNION ALL SELECT doc_id, tier, NULL, list_position({[*MONTH_NAMES]}, regexp_extract(x, '^ ב?' || mm, 1))::VARCHAR, regexp_extract(x, ' ([0-9]{{2}}) $', 1), true FROM (SELECT *, unnest(regexp_extract_all(' ' || replace(t, ' ', '  ') || ' ', ' ב?' || mm || '  [0-9]{{2}} ')) AS x FROM p WHERE two) WHERE regexp_extract(x, ' ([0-9]{{2}}) $', 1)::INT >= 28),
r AS (SELECT doc_id, tier, yy, d IS NOT NULL AS k, try(make_date(y::INT + CASE WHEN length(y) > 2 THEN 0 WHEN y::INT <= 27 THEN 2000 ELSE 1900 END, mo::INT, coalesce(d, '1')::INT)) AS date FROM c)"""

ORACLE_SQL = {
    "clause_rows": f"WITH {_ORDERS} SELECT doc_id || '__s' || sid || '__c' || n_nationkey AS id, doc_id, sid AS section, n_nationkey::VARCHAR AS clause, title || ' — ' || lower(r_name) || chr(10) || 'clause ' || n_nationkey || ': ' || said AS text FROM c WHERE trim(said) <> '' AND k <> 3",
    "annex_rows": f"""
WITH {_ORDERS} SELECT doc_id || '__annex_7_' || n_nationkey AS id, doc_id, 'annex_7' AS section, n_nationkey::VARCHAR AS clause,
  title || ' — annex' || chr(10) || 'category: ' || r_name || ' | reason: ' || n_name || CASE WHEN n_nationkey % 5 <> 0 THEN ' | sleep: 6 hours' ELSE '' END || CASE WHEN n_nationkey % 3 = 0 THEN ' | given: a day' ELSE '' END
  || ' | by: ' || CASE WHEN n_nationkey % 2 = 0 THEN 'major' ELSE 'colonel' END AS text FROM c WHERE k % 2 = 0
UNION ALL SELECT doc_id || '__annex__' || left(r_name, 30), doc_id, 'annex', left(r_name, 40), title || ' — annex' || chr(10) || 'exception: ' || r_name || '. if: one; two. by: general' FROM d WHERE k % 2 = 1""",
    "structure_audit": r"""
SELECT 'PM-' || r_regionkey AS document_id, CASE WHEN r_regionkey = 3 THEN 0 ELSE 1 END AS n_sections, CASE WHEN r_regionkey = 3 THEN 0 ELSE (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) END::INT AS n_clauses,
  len(list_filter(regexp_split_to_array(r_name || '  is large', '[\x09-\x0D\x20]+'), lambda x: x <> ''))::INT AS n_words, CASE WHEN r_regionkey = 0 THEN 1 ELSE 0 END AS n_anchors, r_regionkey % 2 = 0 AS has_key_facts FROM region""",
    "document_info": "SELECT 'PM-' || r_regionkey AS id, CASE WHEN r_regionkey = 1 THEN '?' ELSE r_name END AS title, r_name || '.pdf' AS source_file FROM region",
    "section_bodies": f"WITH {_ORDERS}, b AS (SELECT doc_id, k, string_agg('- ' || n_nationkey || ': ' || left(said, 30), chr(10) ORDER BY n_nationkey) AS lines, any_value(lower(r_name)) AS t FROM c GROUP BY 1, 2) SELECT doc_id AS document_id, CASE WHEN k = 3 THEN '' ELSE left(t || chr(10) || lines, 200) END AS body FROM b",
    "targets": """
SELECT 'PM-' || c_custkey AS document_id, 'anchors' AS needs FROM customer WHERE c_custkey % 10 < 9 AND c_custkey % 3 = 1 AND c_custkey % 4 > 0 AND c_custkey NOT IN (1, 7)
UNION ALL SELECT 'PM-' || c_custkey, 'sections' FROM customer WHERE c_custkey % 10 < 9 AND c_custkey % 3 = 0 AND c_custkey <> 3""",
    "clause_keys": "SELECT n_nationkey AS n, CASE WHEN n_nationkey % 2 = 0 THEN 'w' || n_nationkey ELSE 's' || n_nationkey || ':' || n_nationkey || '–' || (n_nationkey + 1) END AS clause_key, n_name || CASE WHEN n_nationkey % 3 = 0 THEN '' WHEN n_nationkey % 2 = 0 THEN ', chunk text' ELSE ', s' || n_nationkey END AS citation FROM nation",
    "latest_rows": "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1",
    "last_accepted": "SELECT c_custkey, max(o_orderkey) AS o_orderkey, any_value(c_nationkey) AS c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "carried_fields": "WITH f AS (SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1) SELECT c_custkey, c_mktsegment, coalesce(s, 'new') AS status FROM customer LEFT JOIN f ON o_custkey = c_custkey",
    "carried_forward": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'old ' || p_brand ELSE p_brand END AS p_brand FROM part",
    "new_keys": "SELECT DISTINCT doc_id FROM documents WHERE doc_id % 7 = 0",
    "embedded_lines": "WITH l AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS t FROM benchmark) SELECT 'all' AS part, count(*) AS n FROM l UNION ALL SELECT 'new', count(*) FROM l WHERE NOT starts_with(sha1(t), '0')",
    "cache_misses": "SELECT DISTINCT t AS text, sha1(t) AS text_sha1 FROM (SELECT unnest(string_split(text, chr(10))) AS t FROM benchmark) WHERE length(t) % 2 <> 0",
    "pooled_vectors": """
WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY 1, 2)
SELECT label, i::INT AS i, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY label)), 1e-9::DOUBLE), 6) AS x FROM m""",
    "refused": "SELECT doc_id, coalesce(instr(text, 'the') BETWEEN 1 AND 80 OR instr(text, 'der') BETWEEN 1 AND 80 OR instr(text, 'les') BETWEEN 1 AND 80, false) AS refused FROM documents",
    "risk_topics": """
WITH h AS (SELECT doc_id, left(text, 500) AS c, substr(text, 501) AS s FROM documents)
SELECT doc_id, contains(c, 'idiot') AND NOT contains(s, 'idiot') OR (contains(c, 'license') OR contains(c, 'copyright')) AND NOT (contains(s, 'license') OR contains(s, 'copyright')) OR contains(c, '@') AND NOT contains(s, '@') AS risky FROM h""",
    "hebrew_terms": rf"""
WITH w AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array({_HEB}, '[\x09-\x0D\x20]+'), lambda x: x <> '')) AS word FROM benchmark),
b AS (SELECT word, translate(lower(trim(word, '?.,:;!"''()[]')), 'םןץףך', 'מנצפכ') AS base FROM w),
p AS (SELECT *, list_concat([base], list_transform(range(1, greatest(least(length(regexp_extract(base, '^[הובלמכש]*')), length(base) - 3), 0) + 1), lambda i: substr(base, i + 1))) AS whole FROM b),
f AS (SELECT *, list_concat(whole, list_transform(list_filter(whole, lambda x: length(x) > 4 AND right(x, 1) IN ('ה', 'ת')), lambda x: left(x, length(x) - 1)), list_transform(list_filter(whole, lambda x: length(x) > 5 AND right(x, 2) IN ('ים', 'ות')), lambda x: left(x, length(x) - 2))) AS forms FROM p)
SELECT word, CASE WHEN length(base) < 3 THEN '' ELSE array_to_string(list_sort(list_distinct(forms)), '|') END AS forms FROM f""",
    "curation_stems": f"SELECT item_id, array_to_string({_STEMS.format(_HEB)}, ' ') AS stems FROM benchmark",
    "grounding_gate": rf"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '1.  2.  3.  4.  5.  6.  7.  ' ELSE '' END || {_HEB} AS raw FROM documents),
k AS (SELECT doc_id, list_transform(regexp_extract_all(raw, '(?:^|[^0-9])([0-9]{{1,3}})\s*\.\s', 1), lambda x: x::INT) AS real, {_STEMS.format("raw")} AS known FROM d),
b AS (SELECT item_id AS doc_id, {_HEB} || CASE WHEN item_id % 2 = 0 THEN ' סעיף 3' WHEN item_id % 5 = 0 THEN ' סעיפים 2, 40' ELSE '' END AS t, CASE WHEN item_id % 2 = 0 THEN [3] WHEN item_id % 5 = 0 THEN [2, 40] ELSE []::INT[] END AS cited FROM benchmark),
j AS (SELECT doc_id, cited, real, {_STEMS.format("t")} AS words, known, doc_id % 3 = 0 AS numbered FROM b JOIN k USING (doc_id)),
s AS (SELECT *, round(len(list_filter(words, lambda w: NOT list_contains(known, w)))::DOUBLE / greatest(len(words), 1), 6) AS share, list_filter(cited, lambda n: NOT list_contains(real, n)) AS bad FROM j)
SELECT doc_id, len(words)::INT AS n_words, share, array_to_string(bad, ',') AS bad, array_to_string(list_filter([CASE WHEN numbered AND len(bad) > 0 THEN 'citation' END, CASE WHEN share > 0.5 THEN 'ungrounded' END], lambda x: x IS NOT NULL), ',') AS problems,
  CASE WHEN numbered AND len(cited) = 0 THEN 'no citation' ELSE '' END AS warnings FROM s""",
    "unsupported_numbers": """
WITH o AS (SELECT o_orderkey AS doc_id, o_orderkey % 13 AS a, year(o_orderdate) AS y, 'three of ' || o_orderkey % 7 || ' in ''' || right(year(o_orderdate)::VARCHAR, 2) AS raw FROM orders), n AS (SELECT doc_id, raw, unnest([a::VARCHAR, y::VARCHAR]) AS number FROM o)
SELECT doc_id, number FROM n WHERE NOT contains(raw, number) AND NOT (number = '3') AND NOT (length(number) = 4 AND contains(raw, right(number, 2)))""",
    "headings": """
WITH l AS (SELECT l_orderkey % 500 AS doc_id, l_linenumber % 4 AS page, l_orderkey * 8 + l_linenumber AS pos, min(CASE l_partkey % 5 WHEN 0 THEN '.' || l_suppkey % 7 WHEN 1 THEN l_suppkey % 7 || '.' WHEN 2 THEN (l_suppkey % 7)::VARCHAR WHEN 3 THEN '.' ELSE 'words' END) AS line FROM lineitem GROUP BY 1, 2, 3),
a AS (SELECT *, lead(line) OVER (PARTITION BY doc_id, page ORDER BY pos) AS after FROM l)
SELECT doc_id, page, replace(line, '.', '')::INT AS clause, min(pos) AS pos FROM a WHERE line <> '.' AND line <> 'words' AND (contains(line, '.') OR after = '.') GROUP BY 1, 2, 3""",
    "heading_pages": """
WITH RECURSIVE c AS MATERIALIZED (SELECT l_orderkey AS doc_id, l_linenumber::INT AS clause, [(l_partkey % 9)::INT, (l_suppkey % 5)::INT] AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, [(l_partkey % 9)::INT, (l_suppkey % 5)::INT]) AS n FROM lineitem),
f AS (SELECT doc_id, clause, n, list_min(p) AS page, list_min(p) AS bottom FROM c WHERE n = 1
  UNION ALL SELECT c.doc_id, c.clause, c.n, list_min(list_filter(p, lambda x: x >= bottom)), coalesce(list_min(list_filter(p, lambda x: x >= bottom)), bottom) FROM f JOIN c ON c.doc_id = f.doc_id AND c.n = f.n + 1)
SELECT doc_id, clause, page FROM f""",
    "built_dates": """
WITH d AS (SELECT o_orderkey, o_orderkey % 3 > 0 AS k, try_cast(printf('%04d-%02d-%02d', year(o_orderdate) + 15, o_orderkey % 13, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 31 + 1 ELSE 1 END) AS DATE) AS d FROM orders), m AS (SELECT *, CASE WHEN d <= DATE '2012-06-30' THEN d END AS made FROM d)
SELECT o_orderkey, made::VARCHAR AS iso, CASE WHEN year(made) >= 2010 THEN CASE WHEN k THEN strftime(made, '%d/%m/%Y') ELSE strftime(made, '%m/%Y') END END AS badge FROM m""",
    "rulings": rf"""WITH {_RULED}, {_CLASSED.format(src="ruled", clause="clause")},
h AS (SELECT id, s, regexp_extract(t, '^((?:{_NEG})\s+)?({_TERM})(\s+[^;*]{{1,50}})?$', ['neg', 'term', 'qual']) AS x, t FROM (SELECT *, trim(clause, '* .' || {_marks(T.INVISIBLE)}) AS t FROM (SELECT *, clause AS s FROM ruled))),
q AS (SELECT id, t, x.neg AS neg, x.term AS term, trim(x.qual) AS qual FROM h)
SELECT id, cls, CASE WHEN starts_with(t, 'לא נמצא') THEN CASE WHEN length(t) <= 60 THEN 'none' END
  WHEN term = '' OR regexp_matches(qual, 'מותר|אסור|אוסר|מתיר|מוסמך|רשאי|זכאי|פטור|חייב|ניתן|אפשר|מגיע|(?:^|\s)[ושכב]?(?:לא|אין)(?:\s|$)') OR neg <> '' AND term = 'אסור'
    OR qual <> '' AND term IN ('ניתן', 'אפשר') AND NOT starts_with(qual, 'ל') OR qual = '' AND term IN ('מוסמך', 'רשאי', 'ניתן', 'אפשר') THEN NULL
  WHEN starts_with(qual, 'בתנאים') OR starts_with(qual, 'חלקית') THEN 'cond' WHEN neg <> '' OR term = 'אסור' THEN 'no' WHEN regexp_matches(qual, '{_COND}') THEN 'cond' ELSE 'yes' END AS chip
FROM classed JOIN q USING (id)""",
    "ruling_clauses": rf"""WITH {_RULED}, lines AS (SELECT id, unnest(string_split(answer, chr(10))) AS line, unnest(range(len(string_split(answer, chr(10))))) AS nth FROM ruled),
hit AS (SELECT id, nth, regexp_extract(line, '^\s*[' || {_marks(T.INVISIBLE)} || ']*(?:\*\*)?\s*פסיקה:\s*\*{{0,2}}\s*(.+?)\s*$', 1) AS v FROM lines),
first AS (SELECT id, trim(replace(arg_min(v, nth), '**', ''), '* ' || {_marks(T.INVISIBLE)}) AS v FROM hit WHERE v <> '' GROUP BY 1),
parts AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS pos, trim(p) AS text FROM (SELECT id, unnest(string_split(v, ';')) AS p, unnest(range(len(string_split(v, ';')))) AS k FROM first) WHERE trim(p) <> ''),
{_CLASSED.format(src="parts", clause="text")} SELECT id, pos, text, cls FROM classed""",
    "answer_blocks": rf"""
WITH l AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, replace({_option(ANSWER_LINES, 'l_partkey + l_suppkey * 5 + l_linenumber')}, '{{}}', l_partkey::VARCHAR) AS line FROM lineitem),
m AS (SELECT *, trim(line) AS bare, regexp_extract(line, '^\s*\*\*\s*([^*\n]{{1,28}}?)\s*(?::\s*\*\*|\*\*\s*:)\s*(.*)$', ['label', 'value']) AS x FROM l),
k AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN x.label <> '' THEN 'label' WHEN regexp_matches(left(bare, 45), 'הפקודות\s+(?:שסופקו\s+)?(?:אינן|לא)\s+(?:קובעות|נוקבות|מפרטות|מגדירות|מתייחסות|מסדירות)') THEN 'open' ELSE 'prose' END AS sort FROM m),
o AS (SELECT * REPLACE (CASE WHEN sort = 'open' THEN CASE WHEN (SELECT arg_max(z.sort, z.n) FROM k z WHERE z.id = k.id AND z.n < k.n AND z.sort <> 'open') = 'prose' THEN 'prose' ELSE 'note' END ELSE sort END AS sort) FROM k),
r AS (SELECT *, sum((sort IN ('label', 'note') OR coalesce(before IN ('label', 'note'), false))::INT) OVER (PARTITION BY id ORDER BY n) AS run FROM (SELECT *, lag(sort) OVER (PARTITION BY id ORDER BY n) AS before FROM o)),
g AS (SELECT id, run, min(n) AS n, bool_or(sort = 'label') AS lab, bool_or(sort = 'note') AS note, trim(trim(any_value(x.label)), {_marks(T.DIRECTIONS)}) AS label, trim(trim(any_value(x.value), ' ' || {_marks(T.DIRECTIONS)})) AS value, any_value(bare) AS bare,
  trim(string_agg(line, chr(10) ORDER BY n), chr(10)) AS prose FROM r GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN NOT lab THEN CASE WHEN note THEN 'note' ELSE 'md' END WHEN starts_with(label, 'התנהלות') THEN 'side' WHEN label = 'מקור' THEN CASE WHEN regexp_matches(value, '[^ ;]') THEN 'src' ELSE 'field' END
  WHEN label = 'פסיקה' THEN 'lead' WHEN label = 'טרם במאגר' THEN 'route_miss' WHEN label = 'הערה' THEN 'note' ELSE 'field' END AS kind FROM g WHERE lab OR note OR regexp_matches(prose, '\S'))
SELECT id, row_number() OVER (PARTITION BY id ORDER BY n) AS pos, kind, CASE WHEN lab AND kind <> 'note' THEN label END AS label, CASE WHEN lab THEN value WHEN note THEN bare ELSE prose END AS value FROM f""",
    "answer_sources": rf"""
WITH v AS (SELECT row_number() OVER () AS n, l_orderkey AS id, l_linenumber AS line, replace({_option(SOURCE_TITLES, 'l_orderkey')} || {_option(SOURCE_CLAUSES, 'l_partkey')} || ' ; ' || {_option(SOURCE_TITLES, 'l_partkey')}
  || {_option(SOURCE_CLAUSES, 'l_orderkey + l_linenumber')}, '{{}}', l_partkey::VARCHAR) AS value FROM lineitem),
p AS (SELECT n, id, line, k, trim(part, ' ' || {_marks(T.DIRECTIONS)}) AS part FROM (SELECT n, id, line, unnest(string_split(value, ';')) AS part, unnest([0, 1]) AS k FROM v)),
s AS (SELECT n, id, line, k, regexp_extract(part, '(?:^|[\s,—–·-]*\s)((?:סעיף|סעיפים)\s+\S.*)$', 1) AS clause, regexp_replace(part, '(?:^|[\s,—–·-]*\s)((?:סעיף|סעיפים)\s+\S.*)$', '') AS title FROM p WHERE part <> ''),
t AS (SELECT n, id, line, k, clause, regexp_replace(trim(title), '\s*[—–-]\s*', ' · ') AS title FROM s)
SELECT id, line, row_number() OVER (PARTITION BY n ORDER BY k) - 1 AS pos, title, clause FROM t WHERE title <> '' OR clause <> ''""",
    "document_dates": f"""
WITH {_DATED}, {_DATE_WINDOWS},
g AS (SELECT doc_id, max(tier = 1 AND contains(t, '3751')) AS garbage FROM w GROUP BY 1),
p AS (SELECT *, '({"|".join(MONTH_NAMES)})' AS mm FROM w),
{_DATES_IN},
best AS (SELECT g.doc_id, garbage, count(date) FILTER (date BETWEEN DATE '1948-01-01' AND DATE '2026-08-01') AS n_candidates, max((date, k)) FILTER (date BETWEEN DATE '1948-01-01' AND DATE '2026-08-01' AND (NOT garbage OR tier = 1 AND NOT yy)) AS b FROM g LEFT JOIN r ON r.doc_id = g.doc_id GROUP BY 1, 2)
SELECT doc_id, b[1]::VARCHAR AS iso, CASE b[2] WHEN true THEN 'day' WHEN false THEN 'month' END AS precision, n_candidates, garbage FROM best WHERE garbage OR n_candidates > 0""",
    "date_harvest": f"""
WITH {_DATED}, p AS (SELECT pos AS doc_id, 1 AS tier, true AS two, line AS t, '({"|".join(MONTH_NAMES)})' AS mm FROM l), {_DATES_IN}
SELECT doc_id AS pos, date::VARCHAR AS iso, k::INT AS day_known, 'm' || CASE WHEN yy THEN ';2digit-year' ELSE '' END || CASE WHEN k THEN '' ELSE ';month-precision' END AS marker FROM r WHERE date BETWEEN DATE '1948-01-01' AND DATE '2026-08-01'""",
    "date_windows": f"""
WITH {_DATED}, {_DATE_WINDOWS}
SELECT w.doc_id, f.pos, w.t AS text, CASE WHEN tier = 2 THEN CASE WHEN two THEN 'corner-stamp' ELSE 'standalone-stamp' END WHEN contains(t, 'תאריכי עדכון') THEN 'update-dates-list' WHEN contains(t, 'עודכן') THEN 'updated-line' ELSE 'amended-clause' END AS marker
FROM w JOIN f ON f.doc_id = w.doc_id AND f.n = w.n""",
    "intake_numbers": rf"""
WITH f AS (SELECT l_orderkey AS id, l_linenumber, l_partkey AS n, {_option(FILE_HEADS, 'l_partkey')} || (l_orderkey * 37 % (10 ** (l_partkey % 6 + 2))::BIGINT) || CASE WHEN l_partkey % 3 = 0 THEN '-0' || l_linenumber || '13' ELSE '' END || {_option(FILE_TAILS, 'l_orderkey')} AS file FROM lineitem),
r AS (SELECT *, regexp_extract_all(regexp_replace(file, '\.[pP][dD][fF]$', ''), '[0-9]+') AS x FROM f),
d AS (SELECT *, CASE WHEN length(x[1]) IN (5, 6) THEN x[1] WHEN length(x[1]) <= 2 AND length(x[2]) = 4 THEN x[1] || x[2] END AS d FROM r),
m AS (SELECT *, coalesce(nullif(ltrim(left(d, length(d) - 4), '0'), ''), '0') || '.' || right(d, 4) AS number FROM d),
o AS (SELECT *, coalesce(CASE n % 4 WHEN 0 THEN '0' || number WHEN 1 THEN replace(number, '.', '') ELSE '31.0' || n END, 'leave') AS own FROM m)
SELECT id, l_linenumber, file, number, coalesce((ltrim(own, '0') <> number AND ltrim(own, '0') <> replace(number, '.', ''))::INT, 0) AS suspicious FROM o""",
    "json_debris": rf"""
WITH t AS (SELECT l_orderkey AS id, l_linenumber, 'part ' || l_partkey || {_option(DEBRIS, 'l_orderkey')} || {_option(DEBRIS, 'l_partkey')} || {_option(DEBRIS, 'l_orderkey + l_partkey * 3')} || {_option(("", " more", " }"), 'l_partkey + l_orderkey')} AS text FROM lineitem)
SELECT *, regexp_matches(text, '[\]}}]\s*[\]}},]|"\s*[\]}}]|[\]}}]\s*"$')::INT AS debris FROM t""",
    "page_status": """
SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'page-error' WHEN page_id % 13 = 0 THEN 'error' WHEN page_id % 5 = 0 OR page_id % 7 = 0 THEN 'page-error' WHEN contains(url, '?') THEN 'changed' ELSE 'ok' END AS status FROM pages""",
    "owned_links": "WITH l AS (SELECT page_id, nullif(regexp_extract((page_id * 37 % 20000)::VARCHAR, '[0-9]{4,7}'), '') AS digits FROM pages) SELECT *, coalesce(digits IN (SELECT (doc_id + 1000)::VARCHAR FROM documents), false) AS owned FROM l",
    "doc_order": "SELECT doc_id, row_number() OVER (ORDER BY reverse(doc_id::VARCHAR) || '/' || doc_id) - 1 AS doc_ord FROM documents",
    "turn_texts": """
SELECT s_suppkey, s_name || chr(10) || chr(10) || CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN '(about: alone. if it matters.)' || chr(10) || chr(10) ELSE '(about: alone, new. if it matters.)' || chr(10) || chr(10) END || 'Sources:' || chr(10) || s_name AS turn,
  CASE WHEN length(s_name) > 12 THEN left(s_name, 12) || '…' ELSE s_name END AS preview, left(s_name || CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE ' field' END || ' ' || trim(repeat('long ', 30)), 120) AS letter FROM supplier""",
    "question_gates": """
SELECT p_partkey, NOT regexp_matches(p_name, 'ing|of this') AND length(p_name) BETWEEN 12 AND 30 AS suggested, p_brand = 'Brand#12' OR regexp_matches(p_name, 're[dn]') AS escalates,
  CASE WHEN p_partkey % 4 = 0 THEN 7.0 ELSE least(greatest(p_partkey % 90, 5), 50) END::DOUBLE AS clamped,
  array_to_string(list_filter(CASE WHEN p_partkey % 4 = p_partkey % 3 THEN [p_partkey % 4] ELSE [p_partkey % 4, p_partkey % 3] END, lambda x: x IN (1, 2, 3)), ',') AS picked,
  CASE WHEN p_size >= 30 THEN 25.0 WHEN p_size >= 10 THEN 10.0 ELSE 0.0 END::DOUBLE AS percent, CASE WHEN p_partkey % 2 = 1 THEN 'not_configured' WHEN p_partkey % 6 = 0 THEN 'ok' WHEN p_partkey % 6 = 2 THEN 'error' ELSE 'configured' END AS storage,
  CASE WHEN p_partkey % 5 = 0 THEN 'nothing' WHEN p_partkey % 3 = 0 THEN 'full' ELSE 'partial' END AS outcome FROM part""",
    "answer_gates": r"""
WITH documents AS (SELECT * REPLACE (coalesce(text, '') AS text) FROM main.documents)
SELECT doc_id, NOT contains(left(array_to_string(list_filter(regexp_split_to_array(text, '[\x09-\x0D\x20]+'), lambda x: x <> ''), ' '), 160), 'The') AND (lang IN ('en', 'de') OR source IN ('en', 'de')) AND (contains(text, 'the') OR contains(text, 'der')) AND (contains(text, 'and') OR contains(text, 'und') OR contains(text, 'et')) AS facts,
  contains(text, 'license') OR (contains(text, 'der') OR contains(text, 'les')) AND NOT contains(text, '##') AS refusal FROM documents""",
    "query_contexts": f"""
WITH {HITS_SQL}, t AS (SELECT * FROM (SELECT *, {_TOP} AS rank FROM hits WHERE score >= 0.3 AND query_id <> row_id) WHERE rank <= 3),
c AS (SELECT query_id, string_agg('[' || doc_id || ' | ' || section || ' | ' || row_id || ']' || chr(10) || 'body', chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM t GROUP BY 1)
SELECT vec_id AS query_id, coalesce(context, 'nothing found') AS context FROM embeddings LEFT JOIN c ON query_id = vec_id WHERE vec_id % 100 = 0""",
    "rewritten_lines": "WITH l AS (SELECT item_id, unnest(list_distinct(string_split(text, chr(10)))) AS t FROM benchmark) SELECT item_id, sha1(CASE WHEN length(t) % 3 = 1 THEN reverse(t) ELSE t END) AS text_sha1 FROM l WHERE length(t) % 3 <> 0",
    "gap_topics": "SELECT o_orderpriority AS topic, count(*) AS n, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') AS audiences FROM orders WHERE o_totalprice > 100000 GROUP BY 1",
    "uncovered_docs": f"WITH {HITS_SQL} SELECT doc_id, count(*) AS n, string_agg(row_id::VARCHAR, ',' ORDER BY row_id) AS anchors FROM (SELECT doc_id, row_id, max(score) AS score FROM hits WHERE query_id <> row_id GROUP BY 1, 2) WHERE score < 0.35 AND doc_id NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY 1",
    "ordered_sections": "SELECT c_mktsegment AS section, count(*) AS n, CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 3 ELSE 4 END AS place FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING', 'AUTOMOBILE') GROUP BY 1",
    "boilerplate_top": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, sum(len(list_filter(regexp_split_to_array(line, '[\x09-\x0D\x20]+'), lambda x: x <> '')))::BIGINT AS n FROM l WHERE regexp_matches(lower(line), 'license|copyright') GROUP BY 1 ORDER BY n DESC, doc_id LIMIT 20""",
    "stripped_ranks": f"WITH {HITS_SQL}, {_TOP_DOCS}, {_STRIPPED} SELECT * FROM stripped",
    "layer_audit": f"""
WITH {HITS_SQL}, {_TOP_DOCS}, {_STRIPPED}, a AS (SELECT query_id, coalesce(bool_or(p.place <= 3), false) AS a FROM gold LEFT JOIN places p USING (query_id, doc_id) WHERE query_id IN (SELECT query_id FROM places) GROUP BY 1),
j AS (SELECT a, coalesce(target_rank <= 3, false) AS b, section FROM a LEFT JOIN stripped USING (query_id))
SELECT count(*) AS cases, count(*) FILTER (a) AS with_anchors, count(*) FILTER (b) AS without_anchors, count(*) FILTER (b AND section = 'key-facts') AS by_curated, count(*) FILTER (a AND NOT b) AS only_by_anchor FROM j""",
    "self_retrieval": f"""
WITH {HITS_SQL}, {_TOP_DOCS}, t AS (SELECT doc_id, query_id, row_number() OVER (PARTITION BY doc_id ORDER BY query_id) AS n FROM gold), j AS (SELECT t.doc_id, t.query_id, n, place FROM t LEFT JOIN places p ON p.query_id = t.query_id AND p.doc_id = t.doc_id WHERE n <= 6)
SELECT doc_id, min(place) AS self_rank, first(query_id ORDER BY place, n) FILTER (place IS NOT NULL) AS best_anchor, count(*) AS anchors_probed, coalesce(min(place) <= 5, false) AS reachable FROM j GROUP BY 1""",
    "budget_ablation": f"""
WITH {HITS_SQL}, c AS (SELECT query_id, row_id, {_TOP} AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, row_id) AS d FROM hits) WHERE d <= 4)
SELECT f AS factor, query_id, count(*) FILTER (rank <= 4) AS n_base, count(*) AS n_now, count(*) FILTER (rank > 4) AS added FROM c, (VALUES (2), (4)) v(f) WHERE rank <= 4 * f GROUP BY 1, 2""",
    "probe_sample": """
WITH p AS (SELECT doc_id AS id, CASE WHEN lang = 'en' THEN 'blind' ELSE 'inside_out' END AS source FROM documents WHERE n_chars > 2000), k AS (SELECT count(*) FILTER (source = 'blind') AS b, least(90, count(*)) AS n FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(id || '/7'), id) AS r FROM p)
SELECT id, source FROM r, k WHERE CASE WHEN source = 'blind' THEN r <= least(b, n * 2 // 3) ELSE r <= n - least(b, n * 2 // 3) END""",
    "call_costs": """
SELECT l_orderkey, l_linenumber, round((l_partkey * i + l_suppkey * o + l_orderkey * i * 1.25::DOUBLE + l_orderkey * 2 * i * 0.1::DOUBLE) / 1e6::DOUBLE * CASE WHEN l_linenumber % 2 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END, 12) AS cost
FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 5.0::DOUBLE END AS i, CASE WHEN l_returnflag = 'R' THEN 5.0::DOUBLE ELSE 25.0::DOUBLE END AS o FROM lineitem)""",
    "ledger_state": """
WITH RECURSIVE e AS (SELECT ts::DATE AS d, ts, event_id AS seq, user_id AS id, CASE WHEN event_id % 5 = 1 THEN 'settle' WHEN event_id % 7 = 3 THEN 'release' ELSE 'reserve' END AS kind, round(value * 100)::BIGINT AS amount FROM events),
r AS (SELECT d, id, min((ts, seq)) AS place, arg_min(amount, (ts, seq)) AS est FROM e WHERE kind = 'reserve' GROUP BY 1, 2),
c AS (SELECT e.d, e.id, min((ts, seq)) AS place, arg_min(kind, (ts, seq)) AS kind, arg_min(amount, (ts, seq)) AS amount, any_value(est) AS est FROM e JOIN r ON r.d = e.d AND r.id = e.id WHERE kind <> 'reserve' AND (ts, seq) > r.place GROUP BY 1, 2),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY d ORDER BY place) AS n FROM (SELECT d, id, place, 'reserve' AS kind, est AS amount, est FROM r UNION ALL SELECT d, id, place, kind, amount, est FROM c)),
f AS (SELECT d, n, kind, id, amount, est, est <= 60000 AS ok, CASE WHEN est <= 60000 THEN est ELSE 0 END AS committed, CASE WHEN est <= 60000 THEN [id] ELSE [] END AS taken FROM l WHERE n = 1
  UNION ALL SELECT d, n, kind, id, amount, est, ok, committed + CASE WHEN NOT ok THEN 0 WHEN kind = 'reserve' THEN est WHEN kind = 'settle' THEN amount - est ELSE -est END, CASE WHEN ok AND kind = 'reserve' THEN list_append(taken, id) ELSE taken END
  FROM (SELECT l.*, f.committed, f.taken, CASE WHEN l.kind = 'reserve' THEN f.committed + l.est <= 60000 ELSE list_contains(f.taken, l.id) END AS ok FROM f JOIN l ON l.d = f.d AND l.n = f.n + 1) x),
t AS (SELECT d, coalesce(sum(amount) FILTER (ok AND kind = 'settle'), 0)::BIGINT AS spent, (coalesce(sum(est) FILTER (ok AND kind = 'reserve'), 0) - coalesce(sum(est) FILTER (ok AND kind <> 'reserve'), 0))::BIGINT AS reserved, count(*) FILTER (ok AND kind = 'reserve') AS took FROM f GROUP BY 1)
SELECT d::VARCHAR AS day, spent, reserved, greatest(60000 - spent - reserved, 0) AS room, (SELECT count(*) FROM e WHERE e.d = t.d AND kind = 'reserve') - took AS refused FROM t""",
    "wordings": "SELECT r_name AS role, lower(r_name) AS persona, n_name AS situation FROM region, nation ORDER BY md5(r_name || '|' || lower(r_name) || '|' || n_name || '|7') LIMIT 13",
}
