"""Tables that take upserts: key-bucketed parquet, copy on write, versions committed by one rename.

A version is a manifest that names a folder for every bucket. A merge writes new
folders for the buckets that its keys fall into, and then the next manifest.
Readers see the version that was there when they began; its files stay until
``clean``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditframe.functions.storage import written
from auditframe.operators.io import latest_wins


class Conflict(RuntimeError):
    """Another writer has committed the version first; nothing of this merge can be seen, and it may be run again."""


@dataclass(frozen=True)
class Version:
    """One state of a table: its keys, schema and number of buckets, the folder of each bucket that has rows, and the marks of its writers."""

    number: int
    keys: list[str]
    buckets: int
    schema: str
    folders: dict[str, str] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, at = _fs(spark, f"{path}/manifest")
    if not fs.exists(at):
        return []
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit())


def read_version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The newest version of a table, or one by its number."""
    known = _versions(spark, path)
    if not known or (number is not None and number not in known):
        raise ValueError(f"no version {'' if number is None else number} of a table in {path}")
    lines = spark.read.text(f"{path}/manifest/{known[-1] if number is None else number:012d}", wholetext=True)
    return Version(**json.loads(lines.first()[0]))


def _commit(spark: SparkSession, path: str, version: Version) -> None:
    """Write the manifest aside and give it its name, which fails if the name is taken."""
    fs, aside = _fs(spark, f"{path}/manifest/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(asdict(version)).encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(f"{path}/manifest/{version.number:012d}")
    never = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    never[0] = getattr(hadoop, "Options$Rename").NONE
    try:
        files = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
        files.rename(fs.makeQualified(aside), fs.makeQualified(target), never)
    except Py4JJavaError as err:
        fs.delete(aside, False)
        if "FileAlreadyExistsException" in str(err.java_exception):
            raise Conflict(f"version {version.number} of {path} is there already") from err
        raise


def _write(rows: DataFrame, path: str, version: Version) -> dict[str, str]:
    """Write rows by bucket into a new folder; the folder of each bucket that got rows.

    Spark deals rows by the hash that the bucket is taken from, over a multiple
    of the buckets, so a task holds rows of one bucket and a bucket may have
    many tasks.
    """
    spark = rows.sparkSession
    each = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // version.buckets)
    folder = f"data/{uuid.uuid4().hex}"
    dealt = rows.repartition(version.buckets * each, *version.keys).withColumn("_bucket", _bucket(version))
    dealt.write.partitionBy("_bucket").parquet(f"{path}/{folder}")
    fs, at = _fs(spark, f"{path}/{folder}")
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith("_bucket=")}


def _bucket(version: Version) -> Column:
    return F.pmod(F.hash(*version.keys), F.lit(version.buckets))


def _read(spark: SparkSession, path: str, version: Version, buckets: list[int] | None = None) -> DataFrame:
    folders = [f for b, f in version.folders.items() if buckets is None or int(b) in buckets]
    schema = T.StructType.fromJson(json.loads(version.schema))
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in sorted(folders)])


def create_table(df: DataFrame, path: str, keys: list[str], order: list[Column] | None = None, buckets: int = 16, marks: dict[str, int] | None = None) -> Version:
    """Write the first version of a table; of rows with one key the first in ``order`` stays."""
    version = Version(1, keys, buckets, df.schema.json(), marks=marks or {})
    rows = latest_wins(df, keys, order or [F.lit(0)])
    version = Version(**{**asdict(version), "folders": _write(rows, path, version)})
    _commit(df.sparkSession, path, version)
    return version


def merge(changes: DataFrame, path: str, order: list[Column] | None = None, marks: dict[str, int] | None = None) -> Version:
    """Upsert rows by the table's keys and return the new version.

    Only buckets that hold a key of ``changes`` are read and written again. A
    row replaces the one with its key, or, with ``order``, the first of both
    stays. Null keys are keys. Of two merges that start from one version the
    second fails with :class:`Conflict` and leaves the table as it was; so does
    a merge that ends before its commit.
    """
    spark = changes.sparkSession
    old = read_version(spark, path)
    schema = T.StructType.fromJson(json.loads(old.schema))
    # Read twice, and to be the same both times.
    changes = written(changes.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema.fields]), "changes")
    touched = [r[0] for r in changes.select(_bucket(old)).distinct().collect()]
    both = _read(spark, path, old, touched).withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    rows = latest_wins(both, old.keys, [*(order or []), F.desc("_new")]).drop("_new")
    version = Version(old.number + 1, old.keys, old.buckets, old.schema, {**old.folders, **(_write(rows, path, old) if touched else {})}, {**old.marks, **(marks or {})})
    _commit(spark, path, version)
    return version


def read_table(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """All rows of the newest version, or of one by its number."""
    return _read(spark, path, read_version(spark, path, number))


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The rows with the given keys, from the buckets they fall into; the keys' buckets, not the keys, reach the driver."""
    version = read_version(spark, path)
    wanted = keys.select(*version.keys).distinct()
    touched = [r[0] for r in wanted.select(_bucket(version)).distinct().collect()]
    rows = _read(spark, path, version, touched)
    asked = wanted.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(version.keys)])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(version.keys)]
    return rows.join(asked, on=same, how="left_semi")


def clean(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all but the newest ``keep`` versions and the folders that none of them names; the number of folders deleted.

    Not to be run beside a merge, whose folder no version names yet.
    """
    known = _versions(spark, path)
    stay = known[-max(1, keep) :]
    used = {f.rsplit("/", 1)[0] for n in stay for f in read_version(spark, path, n).folders.values()}
    buckets = {f for n in stay for f in read_version(spark, path, n).folders.values()}
    for n in known:
        if n not in stay:
            fs, at = _fs(spark, f"{path}/manifest/{n:012d}")
            fs.delete(at, False)
    gone = 0
    fs, data = _fs(spark, f"{path}/data")
    for folder in fs.listStatus(data):
        name = f"data/{folder.getPath().getName()}"
        if name not in used:
            gone += fs.delete(folder.getPath(), True)
            continue
        for own in fs.listStatus(folder.getPath()):
            if own.isDirectory() and f"{name}/{own.getPath().getName()}" not in buckets:
                gone += fs.delete(own.getPath(), True)
    return gone
