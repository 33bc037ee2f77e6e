"""File sources and sinks: CSV, Zeek logs, JSON-line logs, prepared data, digests, manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from netwarden.operators.clean import coerce_numeric
from netwarden.operators.features import FeatureModel
from netwarden.schemas import LOGS
from netwarden.sources import ranges


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV, from its first line."""
    return spark.read.option("header", True).csv(path).columns


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of a file scan, in the order of files and of lines in them."""
    place = [F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__block")]
    placed = df.select("*", *place).withColumn("__line", F.monotonically_increasing_id())
    return placed.orderBy("__path", "__block", "__line").limit(n).drop("__path", "__block", "__line")


def read_csv(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Header CSV read as text, then numeric-like columns coerced."""
    df = spark.read.option("header", True).schema(text_schema(header(spark, path))).csv(path)
    return coerce_numeric(df if max_rows is None else first_rows(df, max_rows))


def replay_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, streaming: bool = False, files_per_batch: int = 1) -> DataFrame:
    """Every value as text, in batch or as a file stream."""
    schema = text_schema(columns or header(spark, path))
    if streaming:
        return spark.readStream.option("header", True).option("maxFilesPerTrigger", files_per_batch).schema(schema).csv(path)
    return spark.read.option("header", True).schema(schema).csv(path)


def read_zeek(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Tab-separated connection log whose column names stand in its ``#fields`` line."""
    line = spark.read.text(path).filter(F.col("value").startswith("#fields")).first()
    if line is None:
        raise ValueError(f"no #fields line in {path}")
    schema = text_schema(line[0].split("\t")[1:])
    df = spark.read.option("sep", "\t").option("comment", "#").schema(schema).csv(path)
    df = df if max_rows is None else first_rows(df, max_rows)
    return df.select(*[F.nullif(F.col(f"`{c}`"), F.lit("-")).alias(c) for c in df.columns])


def read_log(spark: SparkSession, kind: str, path: str, streaming: bool = False) -> DataFrame:
    """A JSON-line log with its fixed schema; blank and malformed lines are dropped."""
    reader = (spark.readStream if streaming else spark.read).schema(LOGS[kind]).option("mode", "DROPMALFORMED")
    return reader.json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)


def save_prepared(splits: DataFrame, model: FeatureModel, path: str) -> None:
    """Encoded rows by split, plus the fitted encoding."""
    splits.write.mode("overwrite").partitionBy("split").parquet(f"{path}/rows")
    splits.sparkSession.createDataFrame([(model.to_json(),)], "model string").coalesce(1).write.mode("overwrite").text(f"{path}/model")


def load_prepared(spark: SparkSession, path: str) -> tuple[DataFrame, FeatureModel]:
    return spark.read.parquet(f"{path}/rows"), FeatureModel.from_json(spark.read.text(f"{path}/model").first()[0])


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file below ``path`` that is not empty; a task holds one piece of a file at a time."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")

    def digest(batches):
        for batch in batches:
            found = []
            for file in batch.column("path").to_pylist():
                total = hashlib.sha256()
                for piece in ranges.chunks(file):
                    total.update(piece)
                found.append(total.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(found, pa.string())], ["path", "length", "sha256"])

    return listed.mapInArrow(digest, "path string, length long, sha256 string")


def write_manifest(digests: DataFrame, path: str, status: str | None = None) -> None:
    digests.withColumn("status", F.lit(status)).write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, length long, sha256 string, status string").json(path)


def verify_release(digests: DataFrame, manifest: DataFrame, require_certified: bool = True) -> DataFrame:
    """Per file: does the manifest's status and digest hold, and why not."""
    claimed = manifest.select("path", F.col("sha256").alias("__claimed"), "status", F.lit(True).alias("__listed"))
    joined = digests.join(claimed, "path", "left")
    listed = F.coalesce("__listed", F.lit(False))
    status_ok = F.lit(not require_certified) | F.coalesce(F.col("status") == "certified", F.lit(False))
    digest_ok = F.coalesce(F.col("__claimed") == F.col("sha256"), F.lit(False))
    reasons = F.when(~listed, F.array(F.lit("no manifest"))).otherwise(
        F.array_compact(F.array(
            F.when(~status_ok, F.concat(F.lit("status="), F.coalesce("status", F.lit("none")), F.lit(", expected certified"))),
            F.when(~digest_ok, "sha256 mismatch"),
        ))
    )
    return joined.select(
        "path", (listed & status_ok & digest_ok).alias("ok"), (listed & status_ok).alias("status_ok"),
        (listed & digest_ok).alias("sha256_ok"), reasons.alias("reasons"),
    )


_METRIC = "struct<n_seeds:long,mean:double,ci95_low:double,ci95_high:double>"
RESULTS = (
    "seed long, experiment string, "
    "results array<struct<mode:string,attack:string,malicious_fraction_requested:double,effective_malicious_fraction:double,training_seed:long,"
    "metrics:struct<macro_f1:double,accuracy:double,attack_detection_rate:double>,malicious_client_detection_rate:double,"
    "benign_client_false_positive_rate:double,runtime_seconds:double>>"
)
SUMMARIES = (
    f"summaries array<struct<mode:string,attack:string,malicious_fraction_requested:double,malicious_fraction_observed:{_METRIC},n_seeds:long,"
    f"metrics:struct<macro_f1:{_METRIC},accuracy:{_METRIC},attack_detection_rate:{_METRIC}>,malicious_client_detection_rate:{_METRIC},"
    f"benign_client_false_positive_rate:{_METRIC},runtime_seconds:{_METRIC}>>"
)


def load_results(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Repeated-experiment reports (single runs or summaries) as one flat table; a report fills its file, or a line of it."""
    files = spark.read.schema(f"{RESULTS}, {SUMMARIES}").option("multiLine", one_per_file).json(path).withColumn("input_file", F.input_file_name())
    c = F.col
    r, s = "r", "s"
    runs = files.select("input_file", "seed", F.explode("results").alias(r)).select(
        "input_file", F.coalesce(c("r.training_seed"), c("seed")).cast("string").alias("seed"), F.lit(1).cast("long").alias("seed_count"),
        F.coalesce("r.mode", F.lit("unknown")).alias("mode"), F.coalesce("r.attack", F.lit("unknown")).alias("attack"),
        (F.coalesce("r.malicious_fraction_requested", "r.effective_malicious_fraction", F.lit(0.0)) * 100).alias("fraction"),
        (F.coalesce("r.effective_malicious_fraction", "r.malicious_fraction_requested", F.lit(0.0)) * 100).alias("effective_fraction"),
        c("r.metrics.macro_f1").alias("macro_f1"), c("r.metrics.accuracy").alias("accuracy"),
        c("r.metrics.attack_detection_rate").alias("attack_detection_rate"), c("r.malicious_client_detection_rate").alias("detection_rate"),
        c("r.benign_client_false_positive_rate").alias("false_positive_rate"), c("r.runtime_seconds").alias("runtime_seconds"),
        F.lit(False).alias("is_summary"),
    )
    # A file with its own results is read from those; summaries count only without them.
    bare = files.filter(F.coalesce(F.size("results"), F.lit(0)) <= 0)
    summaries = bare.select("input_file", F.explode("summaries").alias(s)).select(
        "input_file", F.lit("repeated-summary").alias("seed"),
        F.coalesce("s.metrics.macro_f1.n_seeds", "s.n_seeds", F.lit(0)).cast("long").alias("seed_count"),
        F.coalesce("s.mode", F.lit("unknown")).alias("mode"), F.coalesce("s.attack", F.lit("unknown")).alias("attack"),
        (F.coalesce("s.malicious_fraction_requested", F.lit(0.0)) * 100).alias("fraction"),
        (F.coalesce("s.malicious_fraction_observed.mean", "s.malicious_fraction_requested", F.lit(0.0)) * 100).alias("effective_fraction"),
        c("s.metrics.macro_f1.mean").alias("macro_f1"), c("s.metrics.accuracy.mean").alias("accuracy"),
        c("s.metrics.attack_detection_rate.mean").alias("attack_detection_rate"), c("s.malicious_client_detection_rate.mean").alias("detection_rate"),
        c("s.benign_client_false_positive_rate.mean").alias("false_positive_rate"), c("s.runtime_seconds.mean").alias("runtime_seconds"),
        F.lit(True).alias("is_summary"), c("s.metrics.macro_f1.ci95_low").alias("macro_f1_low"), c("s.metrics.macro_f1.ci95_high").alias("macro_f1_high"),
    )
    return summaries.unionByName(runs, allowMissingColumns=True)
