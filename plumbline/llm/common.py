"""What the corpus operators share: cuts in the lineage, rows marked where they lie, word hashing."""

from __future__ import annotations

import ctypes
import math
import os
import re
import tempfile
import uuid
from collections import OrderedDict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of letters, digits and underscores, in lower case: the words of every n-gram operator.
WORD = re.compile(r"\w+")
#: Marked rows of a bucket of side files; a task reads the buckets of its own files only.
_ROWS_A_BUCKET = 1_000_000
#: Rows of a file whose marks are one row of a side file.
_ROWS_A_BLOCK = 1 << 18
FILE, ROW = "__file", "__row"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one only in local mode."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="plumbline-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def opened(path: str):
    """(pyarrow's file system, the path in it) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)


def mounted(path: str) -> str | None:
    """The absolute path of a folder that open() reaches; None for one in a store."""
    system, inside = opened(path)
    return os.path.abspath(inside) if system.type_name == "local" else None


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder, and read again: for rows with texts."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def trim() -> None:
    """Give what a task's arrays used back to the system: Python workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def small_batches(spark: SparkSession) -> None:
    """Batches of texts for Python of a few MB, for this session, where it has Spark's usual ones: a batch is held by
    the JVM and by a worker at once, and the usual 64 MB are much for an executor with several workers."""
    for name, usual, few in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", "67108864b", "4194304b")):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", few)


def located(docs: DataFrame) -> DataFrame:
    """docs with __file (a hash of the file's path) and __row (the row's place in it), which name each of its rows.

    Filters and projections of Parquet files are taken as they are; anything else is written to the shared
    folder first.
    """
    small_batches(docs.sparkSession)
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias") and node.children().size() == 1:
        node = node.children().head()
    if node.nodeName() == "LogicalRelation":
        try:
            return docs.withColumns({FILE: F.xxhash64("_metadata.file_path"), ROW: F.col("_metadata.row_index")})
        except AnalysisException:  # not Parquet, or a column of that name
            pass
    return located(stored(docs))


class RowMap:
    """Values of some rows of located documents, in side files by document file: the way to join documents with
    a decision of any size without moving texts.

    The decisions are shuffled by file, a few bytes each, and written to the shared folder; a task that reads a
    document file looks its rows up in what was written for that file. Nothing is broadcast or collected.
    """

    def __init__(self, rows: DataFrame, values: tuple[str, ...] = ()):
        """rows: __file, __row (each pair once) and the values, as longs."""
        spark = rows.sparkSession
        rows = cut(rows.select(FILE, ROW, *values))
        self.buckets = max(1, math.ceil(rows.count() / _ROWS_A_BUCKET))
        self.root, self.values = f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}", values
        blocks = rows.groupBy(FILE, (F.col(ROW) / F.lit(_ROWS_A_BLOCK)).cast("long").alias("block")).agg(F.array_sort(F.collect_list(F.struct(ROW, *values))).alias("x"))
        blocks = blocks.select(FILE, F.pmod(FILE, F.lit(self.buckets)).alias("bucket"), *[F.col("x")[c].alias(c) for c in (ROW, *values)])
        blocks.repartition(min(self.buckets, 2000), "bucket").write.partitionBy("bucket").parquet(self.root)
        self._held: OrderedDict = OrderedDict()

    def __getstate__(self):
        return self.__dict__ | {"_held": OrderedDict()}

    def of(self, file: int) -> tuple[np.ndarray, ...]:
        """The marked rows of a file, ascending, and their values."""
        if file not in self._held:
            import pyarrow.dataset as ds
            from pyarrow import fs

            system, path = opened(self.root)
            path = f"{path}/bucket={file % self.buckets}"
            if system.get_file_info(path).type == fs.FileType.NotFound:
                got = [np.zeros(0, np.int64)] * (1 + len(self.values))
            else:
                table = ds.dataset(path, format="parquet", filesystem=system).to_table(columns=[ROW, *self.values], filter=ds.field(FILE) == file)
                got = [table.column(k).combine_chunks().flatten().to_numpy(zero_copy_only=False) if len(table) else np.zeros(0, np.int64) for k in range(1 + len(self.values))]
            order = np.argsort(got[0], kind="stable")
            self._held[file] = tuple(x[order] for x in got)
            while len(self._held) > 4:
                self._held.popitem(last=False)
        return self._held[file]

    def find(self, files: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each row: whether it is marked, and its values (0 if it isn't)."""
        out = [np.zeros(len(files), bool)] + [np.zeros(len(files), np.int64) for _ in self.values]
        for f in np.unique(files):
            at = np.flatnonzero(files == f)
            known, *values = self.of(int(f))
            if len(known):
                k = np.minimum(np.searchsorted(known, rows[at]), len(known) - 1)
                hit = known[k] == rows[at]
                out[0][at] = hit
                for x, v in zip(out[1:], values):
                    x[at] = np.where(hit, v[k], 0)
        return tuple(out)

    def column(self) -> Column:
        """Whether a row is marked, for a DataFrame with __file and __row."""

        @F.pandas_udf("boolean")
        def marked(files: pd.Series, rows: pd.Series) -> pd.Series:
            return pd.Series(self.find(files.to_numpy(), rows.to_numpy())[0])

        return marked(FILE, ROW)


def rows_of(place: DataFrame, keys: DataFrame, on: str = "doc_id") -> DataFrame:
    """(__file, __row) of the located rows (on, __file, __row) whose key is in keys; only ids are shuffled."""
    return place.select(on, FILE, ROW).join(keys.select(on).distinct(), on, "left_semi").select(FILE, ROW)


def without(docs: DataFrame, keys: DataFrame, on: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns kept, whose key isn't in keys; rows with a null key stay. Texts don't move."""
    place = located(docs)
    gone = RowMap(rows_of(place, keys, on))
    return place.where(~gone.column()).select(*[F.col(f"`{c}`") for c in docs.columns])


class WordHashes(dict):
    """word -> 64-bit hash, filled on demand, emptied when it gets large."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


HASHES = WordHashes()
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def word_hashes(ws: list[str]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, ws), np.uint64, len(ws))


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words, in order; a text of fewer words has one run, all of it."""
    n = min(n, len(h))
    if n == 0:
        return h
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ h[k : len(h) - n + 1 + k]) * _MUL
            out ^= out >> np.uint64(29)
        out *= _MIX
        out ^= out >> np.uint64(32)
    return out


def text_slices(column: pa.Array, rows: int = 500, size: int = 4_000_000):
    """(start, texts) of runs of a column of texts that hold a bounded number of rows, and of bytes unless one text has more."""
    sizes = np.zeros(len(column), np.int64)
    if len(column):
        sizes = np.diff(np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32, len(column) + 1 + column.offset)[column.offset :])
    start, held = 0, 0
    for k in range(len(column)):
        if k > start and (k - start >= rows or held + sizes[k] > size):
            yield start, column.slice(start, k - start).to_pylist()
            start, held = k, 0
        held += int(sizes[k])
    if start < len(column):
        yield start, column.slice(start).to_pylist()
