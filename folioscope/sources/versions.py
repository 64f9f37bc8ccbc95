"""Tables that change together: a version is written whole, and a manifest's one row makes it the current one.

Readers ask the manifest first. A write that fails before its manifest row leaves what was current, as a run that is
repeated does; files of unfinished versions are never read. One writer at a time is assumed.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

MANIFEST = "version long, name string, folder string"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """version, name and folder of each committed table; none where nothing was committed."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)


def current(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the newest version by name."""
    rows = manifest(spark, root)
    newest = rows.agg(F.max("version")).first()[0]
    return {} if newest is None else {r.name: spark.read.parquet(f"{root}/data/{r.folder}") for r in rows.where(F.col("version") == newest).collect()}


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """Write the tables as the next version; its number. The manifest's rows are one file, so all of them appear or none."""
    version = (manifest(spark, root).agg(F.max("version")).first()[0] or 0) + 1
    folders = {name: f"{version}-{uuid.uuid4().hex}-{name}" for name in tables}
    for name, table in tables.items():
        table.write.parquet(f"{root}/data/{folders[name]}")
    rows = spark.createDataFrame([(version, name, folder) for name, folder in folders.items()], MANIFEST).coalesce(1)
    rows.write.mode("append").parquet(f"{root}/manifest")
    return version
