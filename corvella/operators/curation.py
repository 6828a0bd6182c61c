"""Gates of curated texts: numbering, citations, grounding, anchors, targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvella.functions import text as T

from . import gates

# The words for a clause and for clauses, and the letter that joins a list's last number.
ONE, MANY, AND = "סעיף", "סעיפים", "ו"


def clause_markers(raw: Column) -> Column:
    """Distinct numbers before a dot and a blank, sorted."""
    found = F.regexp_extract_all(raw, F.lit(r"(?<![0-9])([0-9]{1,3})\s*\.\s"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: n.cast("int"))))


def is_numbered(markers: Column, least: int = 6, width: int = 12, last: int = 89) -> Column:
    """Whether some `width` numbers in a row, from 1 to `last` on, hold `least` of the markers. A densest run may start at a marker."""
    starts = F.filter(markers, lambda s: s <= last + width - 1)
    return F.exists(starts, lambda s: F.size(F.filter(markers, lambda n: (n >= F.least(s, F.lit(last))) & (n < F.least(s, F.lit(last)) + width))) >= least)


def cited_clauses(text: Column, one: str = ONE, many: str = MANY, also: str = AND) -> Column:
    """Distinct clause numbers that a text cites: single ones, both ends of ranges, and comma lists; sorted."""
    singles = F.regexp_extract_all(text, F.lit(rf"{one}\s*([0-9]{{1,3}})"), F.lit(1))
    ranges = [F.regexp_extract_all(text, F.lit(rf"(?:{one}|{many})\s*([0-9]{{1,3}})\s*[–\-—]\s*([0-9]{{1,3}})"), F.lit(i)) for i in (1, 2)]
    lists = F.regexp_extract_all(text, F.lit(rf"{many}\s*([0-9]{{1,3}}(?:\s*,\s*(?:{also}-?\s*)?[0-9]{{1,3}})+(?:\s*{also}-?\s*[0-9]{{1,3}})?)"), F.lit(1))
    listed = F.flatten(F.transform(lists, lambda s: F.regexp_extract_all(s, F.lit("[0-9]{1,3}"), F.lit(0))))
    return F.array_sort(F.array_distinct(F.transform(F.concat(singles, *ranges, listed), lambda n: n.cast("int"))))


def silent_topics(clauses: DataFrame, documents: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """doc_id, topics: the sorted names of the families of terms that a document's curated clauses (doc_id, number, text) raise together while its raw_text has none of them; documents without such a family have no row."""
    said = F.concat_ws(" ", F.coalesce("number", F.lit("")), F.coalesce("text", F.lit("")))
    raised = [F.max(T.contains_any(said, F.array(*map(F.lit, terms)))).alias(f"f{i}") for i, terms in enumerate(families.values())]
    per = clauses.groupBy("doc_id").agg(*raised).join(documents.select("doc_id", F.coalesce("raw_text", F.lit("")).alias("raw")), "doc_id")
    found = F.array_compact(F.array(*[F.when(F.col(f"f{i}") & ~T.contains_any(F.col("raw"), F.array(*map(F.lit, terms))), name) for i, (name, terms) in enumerate(families.items())]))
    return per.select("doc_id", F.array_sort(found).alias("topics")).where(F.size("topics") > 0)


def grounding_verdict(clauses: DataFrame, documents: DataFrame, families: dict[str, list[str]], most: float = 0.5, cites=cited_clauses, stems=T.curation_stems) -> DataFrame:
    """doc_id, problems, topics, n_warnings, ok of each document with curated clauses: grounding() of all its clauses and silent_topics() together. problems: sorted number:problem."""
    judged = grounding(clauses, documents, most, cites, stems)
    each = F.transform("problems", lambda p: F.concat_ws(":", F.col("number").cast("string"), p))
    per = judged.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list(each))).alias("problems"), F.sum(F.size("warnings")).alias("n_warnings"))
    told = per.join(silent_topics(clauses, documents, families), "doc_id", "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))
    return told.select("doc_id", "problems", "topics", "n_warnings", ((F.size("problems") == 0) & (F.size("topics") == 0)).alias("ok"))


def grounding(clauses: DataFrame, documents: DataFrame, most: float = 0.5, cites=cited_clauses, stems=T.curation_stems) -> DataFrame:
    """doc_id, number, n_words, share, bad_citations, problems, warnings of curated clauses (doc_id, number, text).

    documents: doc_id, raw_text. Problems: debris of JSON; in numbered documents
    citations that the document lacks; over `most` of the stems not in it. A
    numbered document's clause without any citation is a warning.
    """
    # Stems are cut from documents with clauses only.
    mine = documents.join(clauses.select("doc_id").distinct(), "doc_id", "left_semi")
    raw = mine.select("doc_id", clause_markers(F.col("raw_text")).alias("real"), stems(F.col("raw_text")).alias("known"))
    rows = clauses.select("doc_id", "number", "text", cites(F.col("text")).alias("cited"), stems(F.col("text")).alias("words")).join(raw, "doc_id")
    bad = F.array_except("cited", "real")
    share = F.size(F.array_except("words", "known")) / F.greatest(F.size("words"), F.lit(1))
    numbered = is_numbered(F.col("real"))
    problem = F.array(
        F.when(T.json_debris(F.col("text")), "debris"), F.when(numbered & (F.size(bad) > 0), "citation"), F.when(share > most, "ungrounded"),
    )
    warning = F.array(F.when(numbered & (F.size("cited") == 0), "no citation"))
    return rows.select("doc_id", "number", F.size("words").alias("n_words"), F.round(share, 6).alias("share"), bad.alias("bad_citations"), F.array_compact(problem).alias("problems"), F.array_compact(warning).alias("warnings"))


def unsupported_numbers(texts: DataFrame, words: dict[int, list[str]], one: str = ONE, many: str = MANY) -> DataFrame:
    """doc_id, number: numbers of text (less citations) that raw_text has neither in digits nor in words; a year counts by its last two digits."""
    bare = F.regexp_replace("text", rf"(?:{one}|{many})\s*[0-9]{{1,3}}(?:\s*[–\-—]\s*[0-9]{{1,3}})?", " ")
    found = F.array_distinct(F.regexp_extract_all(bare, F.lit(r"(?<![0-9.])[0-9]{1,4}(?![0-9.])"), F.lit(0)))
    rows = texts.select("doc_id", "raw_text", F.explode(found).alias("number"))
    spelled = F.create_map(*[x for n, forms in words.items() for x in (F.lit(n), F.array(*map(F.lit, forms)))])[F.col("number").cast("int")] if words else F.lit(None).cast("array<string>")
    there = F.contains("raw_text", F.col("number")) | F.coalesce(F.exists(spelled, lambda w: F.contains(F.col("raw_text"), w)), F.lit(False)) | ((F.length("number") == 4) & F.contains("raw_text", F.right("number", F.lit(2))))
    return rows.where(~there).select("doc_id", "number")


def anchor_verdict(accepted: DataFrame, asked: DataFrame, least: int = 6) -> DataFrame:
    """doc_id, n_kept, ok: whether enough anchors survived the gates; documents of which none did count with 0."""
    kept = accepted.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return asked.select("doc_id").distinct().join(kept, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_kept"), (F.coalesce("n", F.lit(0)) >= least).alias("ok"))


def anchor_check(
    questions: DataFrame, documents: DataFrame, existing: DataFrame, evaluations: DataFrame, families: list[list[str]], shortest: int = 12, mirror: float = 0.55, close: float = 0.8, most: int = 14, stems=T.curation_stems
) -> DataFrame:
    """doc_id, pos, question, verdict of every proposed anchor (doc_id, pos, question): the first that holds of

    short: fewer than `shortest` characters. mirror: as close as `mirror` in stems
    to an evaluation question (id, text). duplicate: as close as `close` to one
    that the document has (existing: doc_id, question) or to one kept before it.
    topic: it raises a family of terms on which document (doc_id, raw_text,
    block) is silent. beyond: it would be kept, after `most` others. kept: else.

    Mirrors are found by a join over rare stems; what is kept before depends on
    order, so a document's own proposals are folded one after another.
    """
    plain = F.trim(F.regexp_replace("question", r"(?U)\s+", " "))
    rows = questions.select("doc_id", "pos", plain.alias("question"), F.coalesce(F.length(T.stripped(F.col("question"))) < shortest, F.lit(True)).alias("short"))
    rows = rows.withColumns({"question": F.coalesce("question", F.lit("")), "id": F.struct("doc_id", "pos")}).withColumn("stems", stems(F.col("question")))
    seen = gates.mirrors(rows.select("id", F.col("question").alias("text")), evaluations, mirror, stems).select("id").distinct().withColumn("mirror", F.lit(True))
    source = documents.select("doc_id", F.concat_ws("\n", "raw_text", "block").alias("source"))
    judged = rows.join(seen, "id", "left").join(source, "doc_id", "left").withColumn("source", F.coalesce("source", F.lit("")))
    judged = judged.select("doc_id", F.struct("pos", "question", "stems", "short", F.coalesce("mirror", F.lit(False)).alias("mirror"), T.new_topic(F.col("question"), F.col("source"), families).alias("topic")).alias("r"))
    have = existing.groupBy("doc_id").agg(F.collect_list(stems(F.col("question"))).alias("have"))
    lists = judged.groupBy("doc_id").agg(F.array_sort(F.collect_list("r")).alias("rows")).join(have, "doc_id", "left")
    none = F.array().cast("array<array<string>>")
    zero = F.struct(F.coalesce("have", none).alias("seen"), F.lit(0).alias("kept"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, r: Column) -> Column:
        both = lambda s: F.size(F.array_intersect(s, r["stems"]))
        alike = F.exists(state["seen"], lambda s: (both(s) > 0) & (both(s) >= close * F.size(F.array_union(s, r["stems"])) - 1e-9))
        verdict = F.when(r["short"], "short").when(r["mirror"], "mirror").when(alike, "duplicate").when(r["topic"], "topic").when(state["kept"] >= most, "beyond").otherwise("kept")
        passed = verdict.isin("kept", "beyond")
        return F.struct(
            F.when(passed, F.concat(state["seen"], F.array(r["stems"]))).otherwise(state["seen"]).alias("seen"), (state["kept"] + passed.cast("int")).alias("kept"), F.concat(state["out"], F.array(verdict)).alias("out")
        )

    told = lists.select("doc_id", F.explode(F.arrays_zip(F.col("rows"), F.aggregate("rows", zero, step, lambda s: s["out"]).alias("verdict"))).alias("x"))
    return told.select("doc_id", "x.rows.pos", "x.rows.question", "x.verdict")


def anchor_targets(docs: DataFrame, never: list[str], block: str = "key-facts") -> DataFrame:
    """document_id of documents that need anchors and have the block that an anchor would lift, sorted."""
    has = F.coalesce(F.exists("sections", lambda s: s["id"] == block), F.lit(False))
    none = F.coalesce(F.size("anchor_questions"), F.lit(0)) <= 0
    return docs.where(F.col("document_id").isNotNull() & ~F.col("document_id").isin(never) & none & has).select("document_id").orderBy("document_id")


def curation_targets(docs: DataFrame, never: list[str]) -> DataFrame:
    """document_id of documents without any section."""
    return docs.where(F.col("document_id").isNotNull() & ~F.col("document_id").isin(never) & (F.coalesce(F.size("sections"), F.lit(0)) <= 0)).select("document_id")


def uncovered_by_doc(anchors: DataFrame, done: DataFrame, below: float = 0.35) -> DataFrame:
    """doc_id, n, anchors: poorly covered anchors (doc_id, anchor, score) of documents not yet extended, most first."""
    rows = anchors.where(F.col("score") < below).join(done.select("doc_id"), "doc_id", "left_anti")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("anchor")).alias("anchors")).orderBy(F.desc("n"), "doc_id")


def last_accepted(acceptances: DataFrame, docs: DataFrame, key: str, order: str) -> DataFrame:
    """docs with their newest acceptance; documents without one are left out."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return docs.join(acceptances.withColumn("_n", newest).where("_n = 1").drop("_n"), key)


def gap_topics(gaps: DataFrame) -> DataFrame:
    """topic, n, audiences of confident gaps (topic, audience, confident), largest first."""
    return gaps.where("confident").groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("audience")).alias("audiences")).orderBy(F.desc("n"), "topic")


def section_body(sections: Column, most: int = 1800, clause: int = 300) -> Column:
    """Titles and clauses of an array of sections as lines, cut at `most` characters."""
    lines = F.transform(sections, lambda s: F.concat(F.array(s["title"]), F.transform(F.coalesce(s["clauses"], F.array().cast("array<struct<number:string,text:string,tags:array<string>>>")), lambda c: F.concat(F.lit("- "), c["number"], F.lit(": "), F.left(c["text"], F.lit(clause))))))
    return F.left(F.array_join(F.flatten(lines), "\n"), F.lit(most))


def rewritten(questions: DataFrame, changes: DataFrame) -> DataFrame:
    """questions with text replaced as changes (original, replacement) say; an empty replacement drops the row."""
    joined = questions.join(changes.select(F.col("original").alias("_o"), F.col("replacement").alias("_r")), F.col("text") == F.col("_o"), "left")
    return joined.withColumn("text", F.coalesce("_r", "text")).where("text <> ''").drop("_o", "_r")


def annex_rows(docs: DataFrame, words: dict[str, str]) -> DataFrame:
    """id, doc_id, section, clause, text of the annex exceptions of docs, nested cases and flat ones.

    words: the labels heading, category, reason, sleep, wake, hours,
    compensation, approver, exception and conditions. Empty parts are left out.
    """
    a = docs.select(F.col("document_id").alias("doc_id"), "title", F.explode("annex_exceptions").alias("a"))
    a = a.select("doc_id", "title", "a.*").withColumn("case", F.trim(F.coalesce("category", "case", F.lit("")))).withColumn("id", F.coalesce("id", F.lit("")))
    nested = a.where(F.size("sub_cases") > 0).select("doc_id", "title", "id", "case", F.explode("sub_cases").alias("s"))

    def part(label: str, value: Column, unit: str = "") -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{words[label]}: "), value, F.lit(unit)))

    approver = F.coalesce(F.col("s.approver_min_rank"), F.col("s.approver"), F.lit(""))
    body = F.concat_ws(
        " | ", F.concat(F.lit(f"{words['category']}: "), "case"), F.concat(F.lit(f"{words['reason']}: "), F.coalesce("s.reason", F.lit(""))),
        part("sleep", F.col("s.min_sleep_hours"), f" {words['hours']}"), part("wake", F.col("s.max_wake_hours"), f" {words['hours']}"), part("compensation", F.col("s.compensation")),
        F.concat(F.lit(f"{words['approver']}: "), approver),
    )
    head = F.concat("title", F.lit(f" — {words['heading']}\n"))
    sub = F.coalesce("s.sub_id", F.lit(""))
    one = nested.select(F.concat("doc_id", F.lit("__annex_"), "id", F.lit("_"), sub).alias("id"), "doc_id", F.concat(F.lit("annex_"), "id").alias("section"), sub.alias("clause"), F.concat(head, body).alias("text"))
    flat = a.where((F.coalesce(F.size("sub_cases"), F.lit(0)) <= 0) & (F.col("case") != ""))
    said = F.concat(F.lit(f"{words['exception']}: "), "case", F.lit(f". {words['conditions']}: "), F.concat_ws("; ", "conditions"), F.lit(f". {words['approver']}: "), F.coalesce("approver", F.lit("")))
    two = flat.select(F.concat("doc_id", F.lit("__annex__"), F.left("case", F.lit(30))).alias("id"), "doc_id", F.lit("annex").alias("section"), F.left("case", F.lit(40)).alias("clause"), F.concat(head, said).alias("text"))
    return one.unionByName(two)


def citation(document_id: Column, clause: Column) -> Column:
    """A document and, where there is one, its clause."""
    return F.concat_ws(", ", document_id, F.nullif(F.trim(clause), F.lit("")))


def document_info(docs: DataFrame) -> DataFrame:
    """id, title, source_file of documents with an id; a missing title is '?'."""
    return docs.where("document_id IS NOT NULL AND document_id <> ''").select(F.col("document_id").alias("id"), F.coalesce("title", F.lit("?")).alias("title"), "source_file")


def in_section_order(rows: DataFrame, sections: list[str]) -> DataFrame:
    """rows of the listed sections, in that order; sections without rows leave no trace."""
    at = F.array_position(F.array(*map(F.lit, sections)), F.col("section"))
    return rows.withColumn("place", at.cast("int")).where("place > 0").orderBy("place")
