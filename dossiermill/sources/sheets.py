"""Spreadsheet rows from tabular exports, and JSON contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import column_kind


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Any tabular export; text formats are read with every cell as text."""
    reader = spark.read.format(fmt).options(**options)
    if fmt == "csv":
        reader = reader.option("header", "true").option("inferSchema", "false")
    return reader.load(path)


def sheet_rows(df: DataFrame, keys: list[str], headers: dict[str, str]) -> DataFrame:
    """Only the columns an extraction needs, with person columns reduced to presence.

    ``headers`` maps physical columns to their written headers, for exports whose
    columns had to be renamed. Person cells never leave the scan: the one thing
    kept is ``person_present``.
    """
    kinds = column_kinds(df.sparkSession, headers)
    chosen, persons = {}, []
    for column, kind in kinds.items():
        if kind == "person":
            persons.append(column)
        elif kind and kind not in chosen:
            chosen[kind] = column
    present = F.lit(False)
    for column in persons:
        cell = F.col(column).cast("string")
        present = present | (cell.isNotNull() & (F.trim(cell) != ""))
    return df.select(
        *keys,
        *[F.col(column).alias(kind) for kind, column in chosen.items()],
        present.alias("person_present"),
    )


def column_kinds(spark: SparkSession, headers: dict[str, str]) -> dict[str, str | None]:
    """Kind of every column of one sheet; a sheet's header is a single row."""
    names = list(headers)
    row = spark.range(1).select(
        *[column_kind(F.lit(headers[n])).alias(f"c{i}") for i, n in enumerate(names)]
    ).first()
    return {n: row[i] for i, n in enumerate(names)}


def read_contract(spark: SparkSession, path: str, schema: StructType | str, version: int | None = None) -> DataFrame:
    """JSON documents with a fixed schema; unreadable ones and other versions are marked.

    ``contract_status`` is ``ok``, ``unreadable`` or ``version``.
    """
    struct = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    full = StructType(struct.fields).add("_corrupt_record", "string")
    rows = (
        spark.read.schema(full)
        .option("mode", "PERMISSIVE")
        .option("multiLine", "true")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )
    status = F.when(F.col("_corrupt_record").isNotNull(), "unreadable")
    if version is not None:
        status = status.when(~F.col("schema_version").eqNullSafe(F.lit(version)), "version")
    return rows.withColumn("contract_status", status.otherwise("ok")).drop("_corrupt_record")


def dispatch_contracts(records: DataFrame, body: str, schemas: dict[int, str], version: str = "schema_version") -> tuple[DataFrame, DataFrame]:
    """Semi-structured records by their declared version, and those that cannot be read.

    ``schemas``: DDL by version. The first result has the other columns with ``version``
    and a struct ``v<version>`` for each, NULL in records of other versions. The second,
    the quarantine, has the other columns with ``body`` and ``status``: ``missing`` (no
    text), ``unreadable`` (no JSON object, or not of its version's schema) or ``version``
    (none that is known). Every record is in one of them.
    """
    rest = [c for c in records.columns if c != body]
    corrupt = "_corrupt_record"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    head = F.from_json(body, f"{version} bigint, {corrupt} string", options)
    parsed = records.withColumn("_head", head)
    declared = F.col("_head")[version]
    for v, ddl in schemas.items():
        parsed = parsed.withColumn(f"v{v}", F.when(declared == v, F.from_json(body, f"{ddl}, {corrupt} string", options)))
    known = declared.isin(list(schemas))
    broken = F.lit(False)
    for v in schemas:
        broken = broken | F.coalesce(F.col(f"v{v}")[corrupt].isNotNull(), F.lit(False))
    status = (
        F.when(F.col(body).isNull(), "missing")
        .when(F.col("_head").isNull() | F.col("_head")[corrupt].isNotNull() | broken, "unreadable")
        .when(~F.coalesce(known, F.lit(False)), "version")
    )
    judged = parsed.withColumn("status", status)
    good = judged.where("status is null").select(*rest, declared.alias("version"), *[F.col(f"v{v}").dropFields(corrupt).alias(f"v{v}") for v in schemas])
    return good, judged.where("status is not null").select(*rest, body, "status")
