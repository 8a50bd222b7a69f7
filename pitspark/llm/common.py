"""Helpers that all training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, tab, LF, VT, FF, CR.
WORD_BREAK = r"[\x20\x09-\x0D]+"
_staged: list[str] = []
_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; read by Spark only, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A session in one process (tests) may leave it unset and gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='pitspark-')}")
        found = _own[0]
    return found.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pitspark-{name}-{uuid.uuid4().hex}"
    if not _staged:
        atexit.register(_clean)
    _staged.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    read = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}  # asked once: each name comes from the JVM by itself
    for path in [p for p in _staged if p.rpartition("/")[2] in read]:
        _remove(path)


def _remove(path: str) -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _staged.remove(path)


def _clean() -> None:
    for path in list(_staged):
        try:
            _remove(path)
        except Exception:  # the JVM may be gone; the folder is a scratch one
            return


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of texts that go to Python at once, so memory doesn't follow the length of texts; no result depends on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def words(text: Column) -> Column:
    """Array of the maximal runs of characters that are no ASCII white space; null text: empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    """The words' 64-bit hashes, in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


class Numbers(dict):
    """Words by number, in the order they are met; new has those not looked at yet."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def chunks(texts: list[str | None], size: int = 1 << 20, most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) in lists of about size characters and at most `most` texts; memory follows them, or the longest text. Null is empty."""
    at, held, n = 0, [], 0
    for text in texts:
        held.append(text or "")
        n += len(held[-1])
        if n >= size or len(held) == most:
            yield at, held
            at, held, n = at + len(held), [], 0
    if held:
        yield at, held
