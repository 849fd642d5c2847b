"""Sets of tables that change as one: versioned data and a manifest that is written last.

    <path>/data/<table>/version=v…     rows of one version; files of other versions are never touched
    <path>/manifests/<number>          owners: (table, category_key, version), complete once its `_SUCCESS` is there

Readers take the newest complete manifest and of each category the rows of the version that owns it. A version that owns
a category without having rows of it says that there are none, so results of an earlier run do not linger. A crash
before the manifest leaves the old set in force; tables that read the set they are written to keep their files.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendguard import columns as C
from spendguard.scratch import delete, materialise

_OWNERS = f"table string, {C.CATEGORY_KEY} string, version string"


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names below `path`, sorted; none if it does not exist."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def manifests(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete manifests, oldest first."""
    names = _folders(spark, f"{path}/manifests")
    return [int(n) for n in names if "_SUCCESS" in _folders(spark, f"{path}/manifests/{n}")]


def owners(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """Which version holds each category of each table; whole tables have a null category."""
    done = manifests(spark, path)
    if not done:
        return spark.createDataFrame([], _OWNERS)
    return spark.read.schema(_OWNERS).parquet(f"{path}/manifests/{number or done[-1]:09d}")


def write_set(
    tables: dict[str, DataFrame], path: str, covered: DataFrame | None = None, whole: Sequence[str] = (), keep: int = 2
) -> str:
    """Write `tables` as a new version and make it current; returns the version.

    `covered` lists the categories (`category_key`) that the new version owns in every table; all other categories stay
    with the versions that own them. Without `covered`, the new version replaces the set. Tables named in `whole`
    have no categories and are replaced. Of older sets, `keep` - 1 stay readable; what no kept set owns is deleted.
    """
    spark = next(iter(tables.values())).sparkSession
    before = manifests(spark, path)
    number = max([*before, *map(int, _folders(spark, f"{path}/manifests"))], default=0) + 1
    version = f"v{number:09d}-{uuid.uuid4().hex[:8]}"
    parted = [name for name in tables if name not in whole]
    new = [spark.createDataFrame([(name, None, version) for name in tables if name in whole], _OWNERS)]
    if covered is None:
        covered = tables[parted[0]].select(C.CATEGORY_KEY)
        for name in parted[1:]:
            covered = covered.unionByName(tables[name].select(C.CATEGORY_KEY))
        old = spark.createDataFrame([], _OWNERS)
    else:
        old = owners(spark, path)
    covered = materialise(covered.select(F.col(C.CATEGORY_KEY).cast("string")).where(f"{C.CATEGORY_KEY} is not null").distinct(), "covered")
    for name in parted:
        rows = tables[name].withColumn(C.CATEGORY_KEY, F.col(C.CATEGORY_KEY).cast("string"))
        # Sorted files: a reader of one category skips most row groups.
        rows.join(covered, C.CATEGORY_KEY, "left_semi").sortWithinPartitions(C.CATEGORY_KEY).write.parquet(
            f"{path}/data/{name}/version={version}"
        )
        new.append(covered.select(F.lit(name).alias("table"), C.CATEGORY_KEY, F.lit(version).alias("version")))
    for name in (n for n in tables if n in whole):
        tables[name].write.parquet(f"{path}/data/{name}/version={version}")
    renewed = F.col("table").isin("", *(name for name in tables if name in whole))
    stay = old.join(covered, C.CATEGORY_KEY, "left_anti").where(~renewed)
    listed = stay
    for more in new:
        listed = listed.unionByName(more)
    listed.select("table", C.CATEGORY_KEY, "version").coalesce(1).write.parquet(f"{path}/manifests/{number:09d}")
    _clean(spark, path, keep)
    return version


def _clean(spark: SparkSession, path: str, keep: int) -> None:
    """Delete all but the newest `keep` manifests and the versions that none of these owns."""
    done = manifests(spark, path)
    kept = done[-max(keep, 1) :]
    used: set[tuple[str, str]] = set()
    for number in kept:
        used |= {tuple(r) for r in owners(spark, path, number).select("table", "version").distinct().collect()}
    for table in _folders(spark, f"{path}/data"):
        for folder in _folders(spark, f"{path}/data/{table}"):
            version = folder.removeprefix("version=")
            # A version newer than the newest set belongs to a writer that is still at work.
            if (table, version) not in used and version[1:10] <= f"{kept[-1]:09d}":
                delete(spark, f"{path}/data/{table}/{folder}")
    for number in done[: -len(kept)] if len(done) > len(kept) else []:
        delete(spark, f"{path}/manifests/{number:09d}")


def read_set(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the current set; empty if there is none. Categories are always text."""
    current = owners(spark, path)
    tables = {}
    for row in current.groupBy("table").agg(F.collect_set("version").alias("versions"), F.max(C.CATEGORY_KEY).alias("some")).collect():
        base = f"{path}/data/{row['table']}"
        folders = [f"{base}/version={v}" for v in sorted(row["versions"])]
        rows = spark.read.option("basePath", base).option("mergeSchema", "true").parquet(*folders)
        if row["some"] is not None:
            mine = current.where(F.col("table") == row["table"]).select(C.CATEGORY_KEY, "version")
            rows = rows.join(mine, [C.CATEGORY_KEY, "version"], "left_semi")
        tables[row["table"]] = rows.drop("version")
    return tables
