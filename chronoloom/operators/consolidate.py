"""Very many tiny files into few files of good size, every record kept exactly once.

External merge sort whose runs are what the files already are: every task that reads small files merges them into one sorted run;
key ranges are cut over all runs, and in each range the sorted runs are merged k ways, by a heap of their heads. Ranges are
cut in the order of content, then file, so that one key, or one record stored very many times, can fill many of them; what
a range must know of the one before it, its last record, is one row a range. Output files are rolled by bytes inside
the ranges and their range metadata is read back from them. Records with equal keys but other values (restatements) are
all kept; of records equal in all columns the one of the earliest file is kept.

Defined results: NULL equals NULL; rows whose file is unknown to the file table come after all others; NULL written_at comes
before all others; a file listed twice counts with its earliest written_at; empty files and stale or NULL row counts don't matter,
bytes and rows are counted from the records; empty input gives empty output.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from chronoloom.session import cut
from chronoloom.sources.tables import micros

#: Keys of all runs of a range that are held as Python objects at a time.
HELD = 1 << 17
#: Records a range whose keys and bytes are looked at for the cuts between ranges, and at most of all ranges; every record is merged.
PER_RANGE, LOOKED_AT = 200, 1_000_000
#: Bytes of input files that a range has at most where nothing is written.
RANGE_BYTES = 32 << 20


def _sortable(df: DataFrame, c: str) -> Column:
    """A column in a form whose order is the same for Spark and Python."""
    kind = dict(df.dtypes)[c]
    if kind.startswith(("array", "map", "struct", "variant")):
        return F.to_json(c)
    return micros(c) if kind.startswith("timestamp") else F.col(c)


def _wrapped(values: Sequence) -> tuple:
    return tuple((v is not None, v) for v in values)


def _bounds(keyed: DataFrame, names: Sequence[str], total: int, ranges: int) -> list[tuple]:
    """Keys that cut the records into ranges of about equal bytes, from a bounded sample of keys."""
    share = 1.2 * min(LOOKED_AT, PER_RANGE * ranges) / max(1, total)
    seen = keyed.select(*names, "__size")
    rows = sorted((_wrapped(r[:-1]), r[-1]) for r in (seen.sample(share, 7) if share < 1 else seen).collect()) if ranges > 1 else []
    bytes_, done, out = sum(b for _, b in rows), 0, []
    for key, b in rows:
        if done and done * ranges >= (len(out) + 1) * bytes_ and (not out or out[-1] != key):
            out.append(key)
        done += b
    return out[: ranges - 1]


def _assign(batches: Iterator[pa.RecordBatch], names: list[str], bounds: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The range of every record of a sorted run: only where the bounds fall into a batch are keys looked at."""
    for b in batches:
        columns = [b.column(n) for n in names]
        ids, at = np.empty(b.num_rows, dtype=np.int32), 0
        while at < b.num_rows:
            k = bisect.bisect_right(bounds, _wrapped(c[at].as_py() for c in columns))
            ids[at:] = k
            at = bisect.bisect_left(range(b.num_rows), True, lo=at + 1, key=lambda i: _wrapped(c[i].as_py() for c in columns) >= bounds[k]) if k < len(bounds) else b.num_rows
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids)], names=[*b.schema.names, "__range"])


def _keys(columns: list[pa.ChunkedArray], rows: np.ndarray, held: int) -> Iterator[tuple[tuple, int]]:
    """Key and row number of the rows of one run, in order; NULL sorts first."""
    for at in range(0, len(rows), held):
        part = rows[at : at + held]
        take = pa.array(part)
        values = (c.take(take).to_pylist() if not c.null_count else [(v is not None, v) for v in c.take(take).to_pylist()] for c in columns)
        yield from zip(zip(*values, strict=True), part.tolist(), strict=True)


def _merge(batches: Iterator[pa.RecordBatch], names: list[str], n_content: int, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of a range from its sorted runs (``__run``), with the flags described at ``merged``."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got)
    run = table.column("__run").to_numpy()
    by_run = np.argsort(run, kind="stable")  # rows of a run come in its order
    runs = np.split(by_run, np.flatnonzero(np.diff(run[by_run])) + 1)
    columns = [table.column(n) for n in names]
    held = max(64, HELD // len(runs))
    order, copy, lead = np.empty(len(table), dtype=np.int64), np.zeros(len(table), dtype=bool), np.zeros(len(table), dtype=bool)
    before, first, leading = None, None, True
    for k, (key, row) in enumerate(heapq.merge(*(_keys(columns, r, held) for r in runs))):
        content = key[:n_content]
        order[k], copy[k] = row, content == before
        first = content if k == 0 else first
        leading = leading and (k == 0 or copy[k])
        lead[k], before = leading, content
    plain = lambda content: [v[1] if c.null_count else v for c, v in zip(columns, content)]
    head, tail = (hashlib.blake2b(repr(plain(c)).encode(), digest_size=16).digest() for c in (first, before))
    kept = table.select(keep)
    for at in range(0, len(table), 1 << 16):
        end = min(at + (1 << 16), len(table))
        ends = [[head if i == 0 else None for i in range(at, end)], [tail if i == len(table) - 1 else None for i in range(at, end)]]
        out = kept.take(pa.array(order[at:end])).combine_chunks()
        flags = [pa.array(copy[at:end]), pa.array(lead[at:end]), *(pa.array(e, pa.binary()) for e in ends)]
        for b in out.to_batches():
            yield pa.RecordBatch.from_arrays([*b.columns, *flags], names=[*b.schema.names, "__copy", "__lead", "__head", "__tail"])


def merged(rows: DataFrame, files: DataFrame, key: Sequence[str], keep: Sequence[str], row_id: str = "row_id", file_id: str = "file_id", ranges: int | None = None) -> DataFrame:
    """Columns ``keep`` of all rows in merged order, with ``__part`` (number of the range) and ``copied`` (equal to an earlier record).

    The result lies in the shared checkpoint folder; ranges follow each other there, and rows are in order inside them.
    """
    content = [*key, *(c for c in rows.columns if c not in (*key, row_id, file_id) and not c.startswith("__"))]
    written = files.groupBy(F.col(file_id).alias("__f")).agg(F.min(micros("written_at")).alias("__at"), F.lit(0).alias("__unknown"))
    sized = rows.join(written, rows[file_id] == written["__f"], "left").withColumn("__unknown", F.coalesce("__unknown", F.lit(1)))
    names = {f"__k{i}": _sortable(rows, c) for i, c in enumerate(content)} | {"__u": F.col("__unknown"), "__a": F.col("__at"), "__fi": F.col(file_id), "__ri": F.col(row_id)}
    order, keep = list(names), list(keep)
    keyed = sized.select(*keep, *(c.alias(n) for n, c in names.items()))
    ranges = ranges or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-_stored_bytes(rows) // RANGE_BYTES))
    bounds = _bounds(sized.select(*(c.alias(n) for n, c in names.items()), _row_bytes(rows).alias("__size")), order, rows.count(), ranges)
    runs = keyed.sortWithinPartitions(*names).withColumn("__run", F.spark_partition_id())
    ranged = runs.mapInArrow(lambda batches: _assign(batches, order, bounds), StructType([*runs.schema.fields, StructField("__range", IntegerType())])).repartitionById(ranges, "__range").drop("__range")
    schema = StructType([*(keyed.schema[c] for c in keep), StructField("__copy", BooleanType()), StructField("__lead", BooleanType()), StructField("__head", BinaryType()), StructField("__tail", BinaryType())])
    whole = cut(ranged.mapInArrow(lambda batches: _merge(batches, order, len(content), keep), schema).withColumn("__part", F.spark_partition_id()))
    ends = whole.where("__head is not null or __tail is not null").groupBy("__part").agg(F.max("__head").alias("head"), F.max("__tail").alias("tail"))
    ends = sorted(ends.collect(), key=lambda r: r["__part"])  # one row a range
    goes_on = [b["__part"] for a, b in zip(ends, ends[1:]) if a["tail"] == b["head"]]
    copied = F.col("__copy") | (F.col("__lead") & F.col("__part").isin(goes_on)) if goes_on else F.col("__copy")
    return whole.withColumn("copied", copied).drop("__copy", "__lead", "__head", "__tail")


def repeated(rows: DataFrame, files: DataFrame, key: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """row_id of every record that equals an earlier one in all columns but row and file id."""
    return merged(rows, files, key, [row_id], row_id).where("copied").select(row_id)


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of a record's values: texts and nested values as long as they are, others by their type."""
    fixed = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}
    wide = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary") or kind.startswith(("array", "map", "struct"))]
    plain = sum(fixed.get(kind, 8) for c, kind in df.dtypes if not (kind in ("string", "binary") or kind.startswith(("array", "map", "struct"))))
    return sum(wide, F.lit(plain)).cast("long")


def _stored_bytes(rows: DataFrame) -> int:
    """Bytes of the files the rows are read from, 0 where they come from no file."""
    jvm, conf = rows.sparkSession._jvm, rows.sparkSession._jsparkSession.sessionState().newHadoopConf()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in rows.inputFiles()]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


def write(rows: DataFrame, files: DataFrame, key: Sequence[str], path: str, target_bytes: int = 128 << 20, row_id: str = "row_id", file_id: str = "file_id") -> DataFrame:
    """Write the consolidated records and return the range metadata of the files.

    There are as many ranges as files of ``target_bytes`` are expected from the bytes of the input's files; a range is cut into
    equal parts nearest to ``target_bytes``. Bytes of a record are those of its values, scaled by what the input's files take for
    theirs; ``n_bytes`` of the result are the bytes of the written files. Rows are shuffled once, into their ranges.
    """
    content = [*key, *(c for c in rows.columns if c not in (*key, row_id, file_id))]
    sized = rows.withColumn("__bytes", _row_bytes(rows))
    read = sized.agg(F.sum("__bytes")).first()[0] or 0
    stored = _stored_bytes(rows) or read
    scale = stored / read if read else 1.0
    whole = merged(sized, files, key, [*rows.columns, "__bytes"], row_id, file_id, max(1, round(stored / target_bytes)))
    kept = whole.where("not copied").drop("copied")
    sizes = {r["__part"]: r["n"] for r in kept.groupBy("__part").agg(F.sum("__bytes").alias("n")).collect()}  # one row a range
    n_files = {p: max(1, round(n * scale / target_bytes)) for p, n in sizes.items()}
    first = dict(zip(sorted(sizes), np.cumsum([0, *(n_files[p] for p in sorted(sizes))]).tolist()))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for b in batches:
            if b.num_rows:
                own, part = b.column("__bytes").to_numpy(), b.column("__part")[0].as_py()
                ahead = np.cumsum(own) - own + done
                done += int(own.sum())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first[part] + ahead * n_files[part] // max(1, sizes[part]))], names=[*b.schema.names, "file_no"])

    numbered = kept.mapInArrow(number, StructType([*kept.schema.fields, StructField("file_no", LongType())])).drop("__bytes", "__part")
    # the rows are in this order already; the sort says so to the writer, and no rows are moved
    numbered.sortWithinPartitions("file_no", *(_sortable(rows, c) for c in content)).write.mode("overwrite").partitionBy("file_no").parquet(path)
    return range_metadata(rows.sparkSession, path, key, rows.schema)


def range_metadata(spark: SparkSession, path: str, key: Sequence[str], schema: StructType | None = None) -> DataFrame:
    """Per file its name, rows, bytes on disk, smallest and largest key."""
    back = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    lead = F.struct(*key)
    return back.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n_rows"), F.max("_metadata.file_size").alias("n_bytes"), F.min(lead).alias("lowest"), F.max(lead).alias("highest"))
