"""Where intermediate tables live, and small helpers shared by the operators."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space, and tab to carriage return.
WS_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``; only where that is unset, on a local master, a temporary one."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="pulseframe-")
    return f"file://{own}"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pulseframe/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


class _Scopes(threading.local):
    """Open scratch scopes of this thread."""

    def __init__(self):
        self.open: list[dict[str, bool]] = []


_scopes = _Scopes()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, so lost executors cost no recomputation of it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    if _scopes.open:
        _scopes.open[-1][path] = True
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables materialized inside go at the end, but those given to ``keep``, the function that it yields; the scope around has these then."""
    own: dict[str, bool] = {}

    def keep(df: DataFrame) -> DataFrame:
        read = {name.rsplit("/", 2)[-2] for name in df.inputFiles()}  # tables' names are unique
        for path in own:
            own[path] &= path.rsplit("/", 1)[1] not in read
        return df

    _scopes.open.append(own)
    try:
        yield keep
    finally:
        _scopes.open.pop()
        for path, goes in own.items():
            if goes:
                delete(spark, path)
            elif _scopes.open:
                _scopes.open[-1][path] = True


def discard(df: DataFrame) -> None:
    """Delete a materialized table that has been used."""
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if f"/pulseframe/{df.sparkSession.sparkContext.applicationId}/" in path:
            delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has left in the shared folder: for when its results have been used."""
    delete(spark, f"{shared_dir(spark)}/pulseframe/{spark.sparkContext.applicationId}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(df: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows, and UTF-8 bytes of ``column``, of the whole table."""
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()
    return row[0], row[1]


def partitions(spark: SparkSession, size: int = 0, each: int = 256 << 20) -> int:
    """The session's number of shuffle partitions, or more where ``size`` bytes would exceed ``each`` in one."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def deal(sent: DataFrame, schema: str, buckets: int, chunks: int, fan: int, parts: int, settle, forward, back, answers: str, depth: int = 0) -> DataFrame:
    """Answers to what chunks ask of hash buckets: ``(p, b, ...)`` for every ``(p, b, ...)`` of ``sent``.

    ``buckets`` is how many buckets of bounded size each ``b`` still stands for.
    If one, ``settle`` answers all rows of a ``b``.  Otherwise the rows of a ``b``
    are gathered in units of about a chunk's size, each of which asks up to
    ``fan`` buckets in its turn (``forward``) and passes the answers back to
    those that asked it (``back``).  So no chunk or unit sends more than ``fan``
    rows, and the rows of a level grow as the chunks do; another level is needed
    each time that the data grow by ``fan``.
    """
    if buckets <= 1:
        return sent.repartition(parts, "b").groupBy("b").applyInArrow(settle, answers)
    wide = min(fan, buckets)
    groups = max(1, -(-chunks // fan ** (depth + 1)))
    unit = F.col("b") * groups + F.pmod(F.xxhash64("p"), F.lit(groups))
    placed = sent.withColumn("u", unit).repartition(parts, "u")
    asked = placed.groupBy("u").applyInArrow(forward(wide, depth), schema)
    got = deal(asked, schema, -(-buckets // wide), chunks, fan, parts, settle, forward, back, answers, depth + 1)
    return placed.groupBy("u").cogroup(got.groupBy("p")).applyInArrow(back(wide, depth), answers)


def sql_words(column: str):
    """Words of ``[^\\x20\\x09-\\x0D]+`` as an array, natively; null or blank text: none."""
    trimmed = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
