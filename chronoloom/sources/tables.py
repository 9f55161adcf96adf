"""Parquet table scans with the null model of the engine: NaN is NULL, timestamps are UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.session import prepare

#: Session setting: ``look`` reads the footers, ``yes`` and ``no`` say whether files may hold BYTE_STREAM_SPLIT pages.
SPLIT_STREAMS = "chronoloom.parquet.splitStreams"


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str, where: Column | str | None = None) -> DataFrame:
    """Scan ``name`` (only ``columns``, where given) with NaN as NULL.

    ``where`` is applied to the columns as they are stored, so that it reaches the Parquet scan; NaN is above every number
    there, as Spark orders it, so bound a double from above or name NaN in the condition.
    """
    df = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    if holds_split_streams(df):
        spark.conf.set("spark.sql.parquet.enableVectorizedReader", "false")
    if where is not None:
        df = df.where(where)
    if columns:
        df = df.select(*columns)
    return nan_to_null(df)


def holds_split_streams(df: DataFrame) -> bool:
    """Whether any file of a scan holds BYTE_STREAM_SPLIT pages, which Spark's vectorized Parquet reader can't decode (its row reader can).

    The footers of all files are read in parallel through Hadoop, on whatever file system they lie, once a file. The
    setting ``chronoloom.parquet.splitStreams`` spares that for tables of very many files.
    """
    spark = df.sparkSession
    known = spark.conf.get(SPLIT_STREAMS, "look")
    if known != "look":
        return known == "yes"
    seen = spark.sparkContext.__dict__.setdefault("_chronoloom_footers", {})
    files = df.inputFiles()
    fresh = [f for f in files if f not in seen]
    if fresh:
        jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        statuses = jvm.java.util.ArrayList()
        for f in fresh:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
            statuses.add(path.getFileSystem(conf).getFileStatus(path))
        metadata = jvm.org.apache.parquet.hadoop.metadata.ParquetMetadata
        footers = jvm.org.apache.parquet.hadoop.ParquetFileReader.readAllFootersInParallel(conf, statuses)
        found = {footer.getFile().toUri().getPath(): "BYTE_STREAM_SPLIT" in metadata.toJSON(footer.getParquetMetadata()) for footer in footers}
        seen.update((f, found.get(jvm.java.net.URI(f).getPath(), False)) for f in fresh)
    return any(seen[f] for f in files)


def nan_to_null(df: DataFrame) -> DataFrame:
    doubles = [c for c, kind in df.dtypes if kind in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles}) if doubles else df


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def seconds(ts: Column | str) -> Column:
    """Whole seconds since 1970, rounded down also before 1970."""
    return F.floor(micros(ts) / F.lit(1_000_000)).cast("long")
