"""Usage and feedback log analytics, quotas and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvella.functions import text as T

from . import ledger


def device_days(log: DataFrame) -> DataFrame:
    """device, day, n_questions: first level of the device rollup; blank devices are left out. log: device, ts."""
    return log.where("device IS NOT NULL AND device <> ''").groupBy("device", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n_questions"))


def device_rollup(log: DataFrame) -> DataFrame:
    """device, n_questions, n_days, n_sessions, top_role, cost. Equally common roles: the smallest. Blank devices are left out."""
    named = log.where("device IS NOT NULL AND device <> ''")
    roles = named.groupBy("device", "role").agg(F.count(F.lit(1)).alias("n"))
    top = roles.groupBy("device").agg(F.min_by("role", F.struct((-F.col("n")).alias("less"), "role")).alias("top_role"))
    sums = named.groupBy("device").agg(F.count(F.lit(1)).alias("n_questions"), F.countDistinct(F.to_date("ts")).alias("n_days"), F.countDistinct("session").alias("n_sessions"), F.round(F.sum(F.expr("try_cast(cost AS decimal(18,6))")), 2).cast("double").alias("cost"))
    return sums.join(top, "device")


def population(days: DataFrame, cap: int) -> DataFrame:
    """One row over device days: devices, peak day, returning devices, days at and over the cap, upper median of a day's questions."""
    per_day = days.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    devices = days.groupBy("device").agg(F.count(F.lit(1)).alias("n_days"))
    counts = days.groupBy("n_questions").agg(F.count(F.lit(1)).alias("times"))  # few distinct values
    ranked = counts.withColumns({"upto": F.sum("times").over(Window.orderBy("n_questions")), "total": F.sum("times").over(Window.partitionBy(F.lit(1)))})
    median = ranked.where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min("n_questions").alias("upper_median"))
    parts = [
        devices.agg(F.count(F.lit(1)).alias("n_devices"), F.count_if(F.col("n_days") > 1).alias("returning")),
        per_day.agg(F.max("n").alias("peak_devices")),
        days.agg(F.count_if(F.col("n_questions") >= cap).alias("days_at_cap"), F.count_if(F.col("n_questions") > cap).alias("days_over_cap")),
        median,
    ]
    out = parts[0].withColumn("_one", F.lit(1))
    for p in parts[1:]:  # a row each
        out = out.join(p.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


# Fixed value: how a question begins that asks for a letter.
LETTER_PREFIX = "[מכתב]"


def popular(log: DataFrame, curated: DataFrame, k: int = 4) -> DataFrame:
    """role, question, n, place: the k most asked texts of each role, then curated ones (role, question, ord) up to k.

    Texts are compared with white space normalised; personal ones and requests
    for letters are left out.
    Equal counts: the one asked last comes first.
    """
    rows = log.select("role", T.normal_space(F.col("question")).alias("question"), "ts").where(~T.private(F.col("question")) & (F.col("question") != "") & ~F.startswith("question", F.lit(LETTER_PREFIX)))
    counts = rows.groupBy("role", "question").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    asked = counts.withColumn("ord", F.row_number().over(Window.partitionBy("role").orderBy(F.desc("n"), F.desc("last"), "question"))).where(F.col("ord") <= k)
    extra = curated.join(asked.select("role", "question"), ["role", "question"], "left_anti").select("role", "question", F.lit(0).cast("long").alias("n"), (F.col("ord") + 1_000_000).alias("ord"))
    both = asked.select("role", "question", "n", "ord").unionByName(extra)
    return both.withColumn("place", F.row_number().over(Window.partitionBy("role").orderBy("ord"))).where(F.col("place") <= k).drop("ord")


def ledger_totals(entries: DataFrame) -> DataFrame:
    """label, n, spent, reserved: actual sums of settled entries and estimates of open ones (cents as integers); of one id a settled entry counts first."""
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.col("actual").isNull(), F.desc("ts")))
    once = entries.withColumn("_n", best).where("_n = 1")
    return once.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("actual"), F.lit(0)).alias("spent"), F.coalesce(F.sum(F.when(F.col("actual").isNull(), F.col("estimate"))), F.lit(0)).alias("reserved"))


def user_quota(log: DataFrame, cap: int) -> DataFrame:
    """log with verdict ok or user: the first cap requests of a user a day pass. log: user, ts, seq."""
    nth = F.row_number().over(Window.partitionBy("user", F.to_date("ts")).orderBy("ts", "seq"))
    return log.withColumn("verdict", F.when(nth <= cap, "ok").otherwise("user"))


def two_quotas(log: DataFrame, user_cap: int, global_cap: int) -> DataFrame:
    """log with verdict ok, user or global; the global cap of a day is tested before the user's.

    Rejected requests use up nothing, so up to the moment at which global_cap
    requests of the day have passed the user's own cap alone decides, and from
    then on all are rejected as global. Passes are counted by minute, then
    within each minute, so a day with a third of all rows is no single task's.
    """
    minute = F.date_trunc("minute", "ts")
    passed = user_quota(log, user_cap).withColumns({"day": F.to_date("ts"), "minute": minute, "passes": (F.col("verdict") == "ok").cast("int")})
    minutes = passed.groupBy("day", "minute").agg(F.sum("passes").alias("n"))  # 1440 rows a day at most
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("day").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    minutes = minutes.select(F.col("minute").alias("_minute"), earlier.alias("earlier"))
    inside = F.coalesce(F.sum("passes").over(Window.partitionBy("minute").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = passed.withColumn("before", inside).join(minutes, F.col("minute") == F.col("_minute"))
    verdict = F.when(F.col("before") + F.col("earlier") >= global_cap, "global").otherwise(F.col("verdict"))
    return joined.withColumn("verdict", verdict).drop("day", "minute", "_minute", "passes", "before", "earlier")


def newest(log: DataFrame, n: int = 200) -> DataFrame:
    """The newest n rows (a top-k: tasks keep n each)."""
    return log.orderBy(F.desc("ts"), F.desc("seq")).limit(n)


def triage(questions: DataFrame, vocabulary: DataFrame, doc_words: DataFrame, n_docs: int, retrieved: DataFrame, common: float = 0.1, titles: DataFrame | None = None) -> DataFrame:
    """query_id, cause: corpus, retrieval or answer.

    questions: query_id, term. A term outside the vocabulary: corpus. Topic
    terms are those that `common` of the documents at most carry; candidates
    are the documents that carry most of them, those in their titles (doc_id,
    word) counted twice. One among the retrieved
    (query_id, doc_id), or no candidate: answer; else retrieval.
    """
    terms = questions.distinct()
    unknown = terms.join(vocabulary.select(F.col("word").alias("term")), "term", "left_anti").select("query_id").distinct().withColumn("unknown", F.lit(True))
    df = doc_words.join(terms.select("term").distinct(), F.col("word") == F.col("term")).select("doc_id", "term").distinct()
    topic = df.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= common * n_docs)
    points = df.withColumn("points", F.lit(1))
    if titles is not None:
        named = titles.select("doc_id", F.col("word").alias("term")).distinct().withColumn("more", F.lit(1))
        points = df.join(named, ["doc_id", "term"], "left").withColumn("points", 1 + F.coalesce("more", F.lit(0)))
    carried = terms.join(topic, "term").join(points, "term").groupBy("query_id", "doc_id").agg(F.sum("points").alias("n"))
    best = carried.groupBy("query_id").agg(F.max("n").alias("most"))
    candidates = carried.join(best, "query_id").where("n = most").select("query_id", "doc_id")
    flags = candidates.join(retrieved.select("query_id", "doc_id").distinct().withColumn("got", F.lit(True)), ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.max(F.coalesce("got", F.lit(False))).alias("got"))
    out = terms.select("query_id").distinct().join(unknown, "query_id", "left").join(flags, "query_id", "left")
    return out.select("query_id", F.when(F.col("unknown"), "corpus").when(F.coalesce("got", F.lit(True)), "answer").otherwise("retrieval").alias("cause"))


def spend_ceiling(entries: DataFrame, ceiling: int, block_rows: int = ledger.BLOCK_ROWS) -> DataFrame:
    """day, id, accepted: whether a reservation (whole cents) still fits under the day's ceiling; only accepted ones count. entries: day, ts, id, estimate."""
    rows = entries.select("day", "ts", F.col("id").alias("seq"), "id", F.lit("reserve").alias("kind"), F.col("estimate").cast("long").alias("amount"))
    return ledger.enforced(rows, ceiling, block_rows).select("day", "id", "accepted")
