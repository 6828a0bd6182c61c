"""Documents, logs and configuration tables in files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvella.functions.text import slug

CLAUSE = "struct<number:string,text:string,tags:array<string>>"
SUB_CASE = "struct<sub_id:string,reason:string,approver_min_rank:string,approver:string,compensation:string,min_sleep_hours:string,max_wake_hours:string,tags:array<string>>"
DOCUMENT = (
    "document_id string, title string, published string, raw_text string, source_file string, source_url string, roles array<string>, suggested_questions string, questions_curated boolean, "
    f"anchor_questions array<string>, sections array<struct<id:string,title:string,clauses:array<{CLAUSE}>>>, "
    f"annex_exceptions array<struct<id:string,category:string,case:string,conditions:array<string>,approver:string,sub_cases:array<{SUB_CASE}>>>, civil_source boolean, civil_label string"
)
QUESTION_LOG = "tab string, ts string, session string, role string, question string, search_query string, doc_ids string, input_tokens long, cache_read long, cache_write long, output_tokens long, cost_usd double, latency_s double, answer_preview string, device string, refused boolean"
FEEDBACK_LOG = "tab string, ts string, session string, role string, verdict string, question string, comment string, answer_preview string, doc_ids string, device string, refused boolean"
# The roles that documents may be meant for.
ROLES = ("soldier", "commander", "reserve")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row a well-formed JSON file, with its file name as order key; broken files are left out."""
    schema = T.StructType.fromDDL(f"{DOCUMENT}, _broken string")
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.withColumn("file_name", F.input_file_name()).where("_broken IS NULL AND document_id IS NOT NULL").drop("_broken")


def questions(docs: DataFrame) -> DataFrame:
    """doc_id, role (null: for all), pos, question of either form of suggested_questions, a list or a map by role."""
    flat = F.from_json("suggested_questions", "array<string>")
    by_role = F.from_json("suggested_questions", "map<string,array<string>>")
    a = docs.select(F.col("document_id").alias("doc_id"), F.lit(None).cast("string").alias("role"), F.posexplode(flat).alias("pos", "question"))
    m = docs.select(F.col("document_id").alias("doc_id"), F.explode(by_role).alias("role", "q")).select("doc_id", "role", F.posexplode("q").alias("pos", "question"))
    return a.unionByName(m).where("question IS NOT NULL")


def in_scope(roles: Column, role: str | None) -> Column:
    """Whether a document may be shown to a role; missing and empty lists show it to all."""
    return F.lit(True) if role is None else roles.isNull() | (F.size(roles) == 0) | F.array_contains(roles, role)


def with_overrides(docs: DataFrame, overrides: DataFrame) -> DataFrame:
    """docs with roles replaced by valid non-empty ones of overrides (source_file, roles); keys that begin with _ are comments."""
    valid = F.filter("roles", lambda r: r.isin(*ROLES))
    o = overrides.where(~F.startswith("source_file", F.lit("_"))).select(F.col("source_file").alias("_f"), valid.alias("_r")).where(F.size("_r") > 0)
    return docs.join(o, F.col("source_file") == F.col("_f"), "left").withColumn("roles", F.coalesce("_r", "roles")).drop("_f", "_r")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file or folder; none if it isn't there."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    """Writes rows as JSON lines in place of what is there, or after it."""
    rows.write.mode("append" if append else "overwrite").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Appends to a log folder partitioned by tab, so that readers of one tab skip the others."""
    rows.write.mode("append").partitionBy("tab").json(path)


def read_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """doc_id, key, value of a JSON file {doc_id: {key: value}}; none if it isn't there or broken."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"doc_id string, key string, value {value}")
    text = spark.read.option("wholetext", True).text(path)
    docs = text.select(F.explode(F.from_json("value", f"map<string,map<string,{value}>>")).alias("doc_id", "inner"))
    return docs.select("doc_id", F.explode("inner").alias("key", "value"))


def dense_text(pages: DataFrame, least: int = 900) -> DataFrame:
    """Documents (doc_id) whose pages (doc_id, text) hold `least` characters each on average."""
    per = pages.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n"), F.count(F.lit(1)).alias("pages"))
    return per.where(F.col("n") >= F.lit(least) * F.col("pages")).select("doc_id")


def staged(rows: DataFrame, catalogue: DataFrame, least: int = 600, only: list[str] | None = None) -> DataFrame:
    """Captured rows (name, raw_text) that the catalogue (name, title) lists and that are long enough."""
    found = rows.join(catalogue, "name").where(F.length("raw_text") >= least)
    return found.where(F.col("name").isin(only)) if only is not None else found


def write_documents(docs: DataFrame, path: str) -> None:
    """Parquet by document; adds the file-name slug of the title."""
    docs.withColumn("slug", slug(F.col("title"))).write.mode("overwrite").parquet(path)
