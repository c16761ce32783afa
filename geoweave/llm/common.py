"""Helpers shared by the corpus operators: row ids, shared storage, Arrow text access."""

from __future__ import annotations

import inspect
import re
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from geoweave.operators.storage import cut as materialize
from geoweave.operators.storage import release  # noqa: F401  for the operators

ROW_ID = "__gw_row"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """The column of that very name, whatever signs are in it."""
    return F.col(quoted(name))


def kept_columns(docs: DataFrame, new: list[str]) -> list[str]:
    """The columns of docs that no result column replaces; as in Spark, names that differ in case only are the same."""
    taken = {x.lower() for x in (*new, ROW_ID)}
    return [c for c in docs.columns if c.lower() not in taken]


def output_schema(docs: DataFrame, keep: list[str], new: str) -> StructType:
    """The columns `keep` of docs, and new ones given as DDL."""
    return StructType([*(docs.schema[c] for c in keep), *StructType.fromDDL(new)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, run, schema: StructType) -> DataFrame:
    """mapInArrow() for columns of any name, which it only takes without dots; run sees and gives the names as they are."""
    given, made = df.columns, schema.names
    safe = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema)])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(x.rename_columns(given) for x in batches):
            yield b.rename_columns([f"c{i}" for i in range(len(made))])

    return df.toDF(*[f"c{i}" for i in range(len(given))]).mapInArrow(renamed, safe).toDF(*made)


def any_names(new: tuple[str, ...], *named: str):
    """For an operator f(docs, ...) that adds the columns `new` and whose parameters `named` are names of columns of docs.

    f sees the columns of docs under names of its own, so that no name can clash with one in it or have signs that Spark reads otherwise;
    its result bears the names of docs again. Columns of docs with the name of a new one, in upper or lower case, are left out.
    """

    def wrap(f):
        kinds = inspect.signature(f)

        @wraps(f)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            given = kinds.bind(docs, *args, **kwargs)
            given.apply_defaults()
            inner = {c: f"__gw_c{i}" for i, c in enumerate(kept_columns(docs, new))}
            by_case = {c.lower(): v for c, v in inner.items()}
            given.arguments[next(iter(kinds.parameters))] = docs.select(*[column(c).alias(v) for c, v in inner.items()])
            for p in named:
                given.arguments[p] = by_case[given.arguments[p].lower()]
            out, outer = f(*given.args, **given.kwargs), {v: c for c, v in inner.items()}
            return out.toDF(*[outer.get(c, c) for c in out.columns])

        return run

    return wrap


#: Plan nodes over one table of files that leave its rows as they are, or fewer of them.
NARROW = re.compile(r"(Project|Filter|Relation)\b")
#: Bits of a row number that count the rows of a file.
FILE_ROWS = 40
#: So many file names (some 20 MB) are broadcast; more are joined as the planner likes.
MOST_FILES = 1 << 17


def counts_file_rows(df: DataFrame) -> bool:
    """Whether df is narrow operations over files whose format tells the place of each row."""
    plan = df._jdf.queryExecution()
    lines = plan.optimizedPlan().toString().strip().split("\n")
    hidden = plan.analyzed().metadataOutput()
    told = any(hidden.apply(i).name() == "_metadata" and "row_index" in hidden.apply(i).dataType().json() for i in range(hidden.size()))
    return told and all(NARROW.match(re.sub(r"^[\s:+\-'!]*", "", x)) for x in lines)


def with_row_id(df: DataFrame) -> DataFrame:
    """Add a unique row number that depends neither on any column's values nor on how the scan is split into tasks.

    Rows may repeat and ids may be null, so joins back to the input go by this column. A row of a file is
    numbered by its file and its place in it; anything else (a shuffle may order rows differently each
    time) is written to the shared folder first.
    """
    if not counts_file_rows(df):
        return materialize(df.withColumn(ROW_ID, F.monotonically_increasing_id()), "numbered")
    path, at = (df.metadataColumn("_metadata")[c] for c in ("file_path", "row_index"))
    paths = df.select(path.alias("__gw_path")).distinct()
    if len(paths.limit(2).collect()) < 2:
        return df.withColumn(ROW_ID, at)
    number = F.row_number().over(Window.orderBy("__gw_path")).cast("long")
    files = materialize(paths.withColumn("__gw_file", F.shiftleft(number, FILE_ROWS)), "files")
    if files.count() <= MOST_FILES:
        files = F.broadcast(files)
    placed = df.select("*", path.alias("__gw_path"), at.alias("__gw_at")).join(files, "__gw_path")
    return placed.select(*[column(c) for c in df.columns], (F.col("__gw_file") + F.col("__gw_at")).alias(ROW_ID))


#: Bytes of input for one shuffle partition, at most, and of one slice of a sorted partition.
PARTITION_BYTES, SLICE_BYTES = 32 << 20, 4 << 20


def shuffle_partitions(df: DataFrame) -> int:
    """As many partitions as the session says, and more where the input's files are large for that."""
    spark, leaves = df.sparkSession, df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    size = sum(x for x in sizes if x < 1 << 60)  # what is not from files says the greatest size there is
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), min(size // PARTITION_BYTES, 1 << 17))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, most: int = SLICE_BYTES) -> Iterator[pa.Table]:
    """Tables of whole groups out of batches that are sorted by key: about `most` bytes each, or one group.

    So a task holds a slice of its partition only, and of a group as much as the group has.
    """
    held, size, limit = [], 0, most
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.nbytes
        if size < limit:
            continue
        t = pa.Table.from_batches(held)
        cut = int(np.searchsorted(t[key].to_numpy(), t[key][-1].as_py(), "left"))
        if cut:
            yield t.slice(0, cut)
            held, limit = t.slice(cut).to_batches(), most
            size = sum(x.nbytes for x in held)
        else:  # one group so far: look again when it has doubled
            limit = 2 * size
    if held:
        yield pa.Table.from_batches(held)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of UTF-8 bytes, and each row's start and end in it; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    n = len(col)
    offs = np.frombuffer(bufs[1], dtype=np.int64 if wide else np.int32, count=n + 1 + col.offset)[col.offset:].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    starts, ends = offs[:-1].copy(), offs[1:].copy()
    if col.null_count:
        ends = np.where(np.asarray(col.is_valid()), ends, starts)
    return data, starts, ends


def chunks_of(starts: np.ndarray, ends: np.ndarray, limit: int):
    """Split rows into runs of at most about limit bytes; yields (first, last+1) row numbers."""
    i, n = 0, len(starts)
    while i < n:
        j, total = i, 0
        while j < n and (j == i or total + ends[j] - starts[j] <= limit):
            total += ends[j] - starts[j]
            j += 1
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))
