"""Reports and result tables as files.

All writes are distributed and go through Spark's committer, which makes a
finished data set visible at once.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.staging import remove, stage

JOB = "job_id"
#: bytes of a file
TARGET_BYTES = 128 << 20

# Columns that may leave the system, per table. Runtime paths, file
# contents and source row numbers are in none of the lists.
AUDIT_COLUMNS = {
    "artifacts": ["job_id", "role", "artifact_id", "kind", "extension", "media_type", "size_bytes", "sha256"],
    "groups": ["job_id", "ord", "code", "name", "population"],
    "media": [
        "job_id", "image_id", "ord", "role", "sha256", "width", "height", "caption", "context",
        "code_hint", "name_hint", "official_code",
    ],
    "plan": [
        "job_id", "source_id", "source_code", "source_name", "status", "official_code", "decision_reason", "decided_at",
    ],
    "issues": ["job_id", "severity", "code", "message", "source_id"],
}


def audit_view(df: DataFrame, kind: str) -> DataFrame:
    """Only the columns on the allow-list of ``kind``."""
    return df.select(*[c for c in AUDIT_COLUMNS[kind] if c in df.columns])


def audit_json(df: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    """Audit records as JSON texts without NULL fields."""
    view = audit_view(df, kind)
    return view.select(*keys, F.to_json(F.struct(*view.columns)).alias("record"))


def _safe(name: str, dtype: T.DataType, paths: set[str]) -> Column:
    c = F.col(f"`{name}`")
    if name in paths:
        return F.element_at(F.split(c, "/"), -1)
    if isinstance(dtype, T.BinaryType):
        return F.concat(F.lit("<"), F.length(c).cast("string"), F.lit(" bytes>"))
    if isinstance(dtype, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        micros = F.date_format(c, "SSSSSS")
        base = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        text = F.when(micros == "000000", base).otherwise(F.concat(base, F.lit("."), micros))
        return F.concat(text, F.lit("+00:00")) if isinstance(dtype, T.TimestampType) else text
    return c


def json_safe(df: DataFrame, paths: list[str] = []) -> DataFrame:
    """Columns made safe to publish: paths to names, bytes to sizes, times to ISO text."""
    return df.select(
        *[_safe(f.name, f.dataType, set(paths)).alias(f.name) for f in df.schema.fields]
    )


def report_rows(summary: DataFrame, issues: DataFrame, plan: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Validation report as lines: ``job_id, section, body``.

    A report is a partition of JSON lines rather than one JSON value, so a job with
    very many issues or items does not have to fit one row.
    """
    def part(df: DataFrame, section: str) -> DataFrame:
        rest = [c for c in df.columns if c != JOB]
        return df.select(JOB, F.lit(section).alias("section"), F.to_json(F.struct(*rest)).alias("body"))

    return (
        part(summary, "summary")
        .unionByName(part(issues.where("severity = 'error'"), "errors"))
        .unionByName(part(issues.where("severity = 'warning'"), "warnings"))
        .unionByName(part(audit_view(plan, "plan"), "reconciliation"))
        .unionByName(part(exceptions, "exception"))
    )


_GENERATION = "generation"


def _size(spark: SparkSession, path: str) -> int:
    """Bytes below a path, through Hadoop's file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(place).getLength() if files.exists(place) else 0


def write_generation(rows: DataFrame, path: str, kind: str = "parquet", jobs: DataFrame | None = None, target: int = TARGET_BYTES) -> str:
    """Append the rows of some jobs as one generation; nothing that is at ``path`` is touched.

    The rows lie in ``data/generation=<name>``, in as many files as their bytes ask for,
    dealt out by a hash of the row, so a large job is never one task's alone. A row per
    job in ``manifest`` then says that this is the job's last generation; it is appended
    when the data is complete, so readers see a generation whole or not at all, and two
    writers never lose each other's rows. ``jobs`` names jobs that have no rows any more.
    Names follow the writers' clocks: of two writes of a job the later one counts.
    """
    spark = rows.sparkSession
    name = f"{time.time_ns() // 1000:020d}-{uuid.uuid4().hex[:8]}"
    new = stage(rows, "report")
    files = max(1, -(-_size(spark, _folder(new)) // target))
    spread = F.pmod(F.xxhash64(*new.columns), F.lit(files))
    new.repartition(files, spread).write.format(kind).save(f"{path}/data/{_GENERATION}={name}")
    written = new.select(JOB).union(jobs.select(JOB)) if jobs is not None else new.select(JOB)
    entries = written.distinct().select(JOB, F.lit(name).alias(_GENERATION))
    entries.write.mode("append").parquet(f"{path}/manifest")
    remove(spark, _folder(new))
    return name


def _folder(df: DataFrame) -> str:
    files = df.inputFiles()
    return files[0].rsplit("/", 1)[0] if files else ""


def current_generations(spark: SparkSession, path: str) -> DataFrame:
    """``job_id, generation``: the last one of every job."""
    return spark.read.parquet(f"{path}/manifest").groupBy(JOB).agg(F.max(_GENERATION).alias(_GENERATION))


def read_current(spark: SparkSession, path: str, schema: T.StructType | str | None = None, kind: str = "parquet") -> DataFrame:
    """The rows of every job's last generation. ``schema`` spares reading files for it, and is needed where none has rows."""
    reader = spark.read.format(kind).option("basePath", f"{path}/data")
    if schema is not None:
        struct = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        reader = reader.schema(T.StructType([*struct.fields, T.StructField(_GENERATION, T.StringType())]))
    rows = reader.load(f"{path}/data").withColumn(_GENERATION, F.col(_GENERATION).cast("string"))
    last = current_generations(spark, path)
    return rows.join(last, [JOB, _GENERATION], "left_semi").drop(_GENERATION)


def compact(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None, target: int = TARGET_BYTES) -> str:
    """Write all current rows as one generation and delete the generations before it; nobody may write meanwhile."""
    old = [r[_GENERATION] for r in spark.read.parquet(f"{path}/manifest").select(_GENERATION).distinct().collect()]
    rows = stage(read_current(spark, path, schema, kind), "compact")
    name = write_generation(rows, path, kind, target=target)
    for generation in old:
        remove(spark, f"{path}/data/{_GENERATION}={generation}")
    entries = stage(current_generations(spark, path).where(F.col(_GENERATION) == name), "manifest")
    entries.write.mode("overwrite").parquet(f"{path}/manifest")
    return name


def write_reports(report: DataFrame, path: str, jobs: DataFrame | None = None) -> None:
    """Report lines as JSON; the reports of other jobs at ``path`` stay."""
    write_generation(report, path, "json", jobs)


def write_compiled(tables: dict[str, DataFrame], path: str, jobs: DataFrame | None = None) -> None:
    """Every result table as Parquet below ``path``; the rows of other jobs there stay."""
    for name, table in tables.items():
        write_generation(table, f"{path}/{name}", jobs=jobs)


def write_comparison(metrics: DataFrame, path: str) -> None:
    """Comparison metrics as JSON lines."""
    metrics.write.mode("overwrite").json(path)
