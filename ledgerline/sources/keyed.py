"""Keyed tables of Parquet files: a base, small deltas, and one manifest that names them.

A batch of upserts is written aside as a delta; the next manifest, which takes its name by one
rename, adds it. Readers follow the newest manifest, so a batch is there whole or not at all, a
crash leaves the old version, and of two writers of one version one has to try again. A batch id
that a manifest holds is not written again. ``compact`` makes a new base of base and deltas.

Reading ranks the deltas alone: base rows are looked up by key in the winners, not sorted again.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Folder:
    """Files of one folder, in whatever store Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm, self.conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.jvm.Path(f"{self.root}/{name}" if name else self.root)

    @property
    def _files(self):
        return self._path("").getFileSystem(self.conf)

    def names(self, pattern: str) -> list[str]:
        return [x.getPath().getName() for x in self._files.globStatus(self._path(pattern)) or []]

    def put(self, name: str, text: str) -> bool:
        """Write a small file whole under a name that is not taken; False if it is."""
        aside = self._path(f"_aside-{uuid.uuid4().hex}")
        out = self._files.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._files.mkdirs(self._path(name).getParent())
        none = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs.Options, "Rename"), 0)
        try:
            self.jvm.FileContext.getFileContext(self._files.makeQualified(aside).toUri(), self.conf).rename(self._files.makeQualified(aside), self._files.makeQualified(self._path(name)), none)
        except Py4JJavaError:
            self._files.delete(aside, False)
            if not self.names(name):
                raise
            return False
        return True

    def get(self, name: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.text(f"{self.root}/{name}", wholetext=True).toLocalIterator())

    def delete(self, name: str) -> None:
        self._files.delete(self._path(name), True)


class KeyedTable:
    """Rows by key; the row with the latest ``at`` wins, of equals the later batch's (then the greatest row).

    Null keys are a key of their own; a null ``at`` is the earliest; an empty batch commits its
    id alone; a table without batches has no rows. The schema is given once and every batch is
    cast to it; other columns of a batch are left out.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], at: str, buckets: int = 64) -> None:
        self.spark, self.folder, self.keys, self.at, self.buckets = spark, Folder(spark, root), keys, at, buckets
        self.schema = T.StructType.fromDDL(schema)

    def _version(self) -> tuple[int, dict]:
        """The newest manifest: its number, base, deltas and the ids of all batches in them."""
        found = self.folder.names("_manifests/v=*")
        if not found:
            return 0, {"base": None, "deltas": [], "ids": []}
        last = max(found)
        return int(last[2:]), json.loads(self.folder.get(f"_manifests/{last}"))

    def _write(self, rows: DataFrame) -> str:
        """Rows as files by bucket of their key, which no manifest names yet."""
        name = f"data-{uuid.uuid4().hex}"
        bucketed = rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        bucketed.repartition(self.buckets, "_bucket").write.partitionBy("_bucket").parquet(f"{self.folder.root}/{name}")
        return name

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_bucket", T.IntegerType())])).parquet(f"{self.folder.root}/{name}").drop("_bucket")

    def _cast(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])

    def _latest(self, rows: DataFrame, *first) -> DataFrame:
        """One row a key."""
        whole = F.struct(*[F.col(f.name) for f in self.schema.fields])
        by = Window.partitionBy(*self.keys).orderBy(F.desc_nulls_last(self.at), *first, F.desc_nulls_last(whole))
        return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")

    def upsert(self, batch_id: str, rows: DataFrame) -> bool:
        """Commit a batch once; False if its id was committed before."""
        version, now = self._version()
        if batch_id in now["ids"]:
            return False
        delta = self._write(self._latest(self._cast(rows)))
        while True:
            after = {"base": now["base"], "deltas": [*now["deltas"], delta], "ids": [*now["ids"], batch_id]}
            if self.folder.put(f"_manifests/v={version + 1:012d}", json.dumps(after)):
                return True
            version, now = self._version()  # another writer was first
            if batch_id in now["ids"]:
                self.folder.delete(delta)
                return False

    def _rows(self, now: dict) -> DataFrame:
        parts = [self._read(d).withColumn("_turn", F.lit(i)) for i, d in enumerate(now["deltas"])]
        if not parts:
            return self._read(now["base"]) if now["base"] else self.spark.createDataFrame([], self.schema)
        deltas = parts[0]
        for p in parts[1:]:
            deltas = deltas.unionByName(p)
        won = self._latest(deltas, F.desc("_turn")).drop("_turn")
        if not now["base"]:
            return won
        base, names = self._read(now["base"]), [f.name for f in self.schema.fields]
        other = won.select(*[F.col(c).alias(f"_new_{c}") for c in names], F.lit(True).alias("_met"))
        same = [base[k].eqNullSafe(other[f"_new_{k}"]) for k in self.keys]
        newer = F.col("_met") & (F.col(self.at).isNull() | (F.col(f"_new_{self.at}") >= F.col(self.at)))
        kept = base.join(other, same, "left").select(*[F.when(F.coalesce(newer, F.lit(False)), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in names])
        fresh = other.join(base.select(*self.keys), same, "left_anti").select(*[F.col(f"_new_{c}").alias(c) for c in names])
        return kept.unionByName(fresh)

    def read(self) -> DataFrame:
        return self._rows(self._version()[1])

    def compact(self) -> bool:
        """Make one base of all there is; False if there are no deltas or another writer was first. Old files go with ``vacuum``."""
        version, now = self._version()
        if not now["deltas"]:
            return False
        base = self._write(self._rows(now))
        if self.folder.put(f"_manifests/v={version + 1:012d}", json.dumps({"base": base, "deltas": [], "ids": now["ids"]})):
            return True
        self.folder.delete(base)
        return False

    def vacuum(self) -> int:
        """Delete files that the newest manifest does not name, and older manifests; while nobody writes or reads an older version."""
        version, now = self._version()
        named = {now["base"], *now["deltas"]}
        gone = [x for x in self.folder.names("data-*") if x not in named]
        gone += [f"_manifests/{x}" for x in self.folder.names("_manifests/v=*") if int(x[2:]) < version]
        for name in gone:
            self.folder.delete(name)
        return len(gone)


def refresh_partitions(spark: SparkSession, path: str, batch: DataFrame, key: str, failed: str | None = None) -> DataFrame:
    """Replace the partitions of ``path`` (Parquet by ``key``) that the batch has rows for, and no others; returns what it did.

    (key, status, rows_written): ``error`` where all fetched rows have ``failed`` set, which
    leaves the partition as it is; ``partial`` where some have; else ``ok``. An empty batch
    changes nothing. The same rows go to ``path``/_log as one file a refresh, which readers of the
    table skip. A write is all files of the new partitions or none of them.
    """
    bad = F.col(failed).isNotNull() if failed else F.lit(False)
    counts = batch.groupBy(key).agg(F.count_if(bad).alias("bad"), F.count_if(~bad).alias("rows_written"))
    status = F.when(F.col("rows_written") == 0, "error").when(F.col("bad") > 0, "partial").otherwise("ok")
    done = counts.select(key, status.alias("status"), "rows_written")
    good = batch.where(~bad)
    good = good.drop(failed) if failed else good
    if not good.isEmpty():
        good.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    log = f"{path}/_log/{uuid.uuid4().hex}"
    done.write.parquet(log)
    return spark.read.schema(done.schema).parquet(log)
