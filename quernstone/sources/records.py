"""Records as JSON files: documents and lines in, ledgers, records and predictions out, and what is left to do.

A file that does not parse, or lacks a field, gives nulls or no rows, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from quernstone.operators.evidence import rows_state


def lines(spark: SparkSession, path: str, schema: str, where: Column | None = None) -> DataFrame:
    """Records of JSON lines, those that parse and satisfy ``where``; only the schema's fields are read."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df if where is None else df.where(where)


def files(spark: SparkSession, path: str, schema: str, pattern: str = "*.json") -> DataFrame:
    """A record for each JSON file below path, with its path and a fingerprint of its bytes: the first 16 digits of their SHA-256."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    body = F.from_json(F.make_valid_utf8(F.col("content").cast("string")), schema)
    return raw.select("path", F.substring(F.sha2("content", 256), 1, 16).alias("fingerprint"), body.alias("r")).where("r IS NOT NULL").select("path", "fingerprint", "r.*")


def nested(spark: SparkSession, path: str, schema: str, field: str) -> DataFrame:
    """The elements of an array field of JSON documents."""
    return spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode(field).alias("x")).select("x.*")


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """Each key's first record."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("r")).select(key, "r.*")


def to_do(work: DataFrame, done: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Work without a result of the same key and fingerprint."""
    return work.join(done.select(key, fingerprint).distinct(), [key, fingerprint], "left_anti")


def fingerprint(*columns: str) -> Column:
    """The first 16 digits of the SHA-256 of the columns as JSON, keys in order."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns))).cast("binary"), 256), 1, 16)


def append(df: DataFrame, path: str) -> None:
    """Appends records as JSON lines, their fields in order of name: a ledger is never overwritten."""
    df.select(*sorted(df.columns)).write.mode("append").json(path)


def run_reports(spark: SparkSession, root: str, run: str, folders: tuple[str, ...] = ("run_evaluation", "evaluation"), pattern: str = "*.json") -> DataFrame:
    """path, instance, resolved and entry (variant) of each instance in a run's JSON reports; of an instance's reports the first by path counts.

    Only the run's own folders are listed and read. A report is an object whose fields are instances, or one with ``instance_id`` and ``result``;
    what does not parse, or says neither ``resolved`` nor ``tests_status``, is passed over."""
    path = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
    there = [p for f in folders if path(p := f"{root}/{f}/{run}").getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(p))]
    schema = "path string, instance string, resolved boolean, entry variant"
    if not there:
        return spark.createDataFrame([], schema)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(there)
    # a variant for each field, not for the document: the parts of one variant all carry its dictionary of field names, and its size is limited
    text = F.make_valid_utf8(F.col("content").cast("string"))
    docs = raw.select("path", F.when(F.ltrim(F.translate(text, "\t\r\n", "   ")).startswith("{"), F.from_json(text, "map<string,variant>")).alias("doc"))
    docs = docs.where(F.size(F.array_distinct(F.map_keys("doc"))) == F.size("doc"))  # a name given twice: no valid report
    alone = F.try_variant_get(F.try_element_at("doc", F.lit("instance_id")), "$", "string")
    one = docs.select("path", alone.alias("instance"), F.try_element_at("doc", F.lit("result")).alias("entry"))
    many = docs.where(alone.isNull()).select("path", F.explode("doc").alias("instance", "entry"))
    has = lambda name: F.try_variant_get("entry", f"$.{name}", "variant").isNotNull()
    found = one.where(F.col("instance").isNotNull() & has("resolved")).unionByName(many.where(F.schema_of_variant("entry").startswith("OBJECT") & (has("resolved") | has("tests_status"))))
    first = found.withColumn("_r", F.row_number().over(Window.partitionBy("instance").orderBy("path"))).where("_r = 1")
    return first.select("path", "instance", F.try_variant_get("entry", "$.resolved", "boolean").alias("resolved"), "entry")


def renewed(report: DataFrame, ledger: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The rows of a report with the ledger's values where it has some; the ledger has one row a key. Applied twice it changes nothing more."""
    live = ledger.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = report.join(live, F.col(key) == F.col("_key"), "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(f"`{c}`") for c in report.columns])


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The committed versions of a published table: those with a success mark, which is written last."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version=*/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found or [])


def latest(spark: SparkSession, folder: str, schema: str | StructType) -> DataFrame:
    """The rows of the last committed version, nested documents as they were."""
    return spark.read.schema(schema).json(f"{folder}/version={versions(spark, folder)[-1]}")


def publish(df: DataFrame, folder: str) -> int:
    """Writes documents, one JSON object a row, as the next version of folder and returns its number; the same rows again make no new version.

    A failed write leaves no success mark: readers go on with the version before, and the next write takes the number over."""
    spark = df.sparkSession
    have = versions(spark, folder)
    if have and rows_state(latest(spark, folder, df.schema)) == rows_state(df):
        return have[-1]
    number = have[-1] + 1 if have else 0
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/version={number}")
    return number


def predictions(df: DataFrame, instance: str, patch: str, model: str) -> DataFrame:
    """Predictions with the model's name fit for a file name."""
    return df.select(F.col(instance).alias("instance_id"), F.col(patch).alias("model_patch"), F.regexp_replace(model, r'[<>:"/\\|?*]', "_").alias("model_name_or_path"))
