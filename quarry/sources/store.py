"""Indexes as Parquet tables in any file system: a directory of versions, each a set of segments.

A version lists segments in a small manifest; a commit writes new segments and then its
manifest, so that readers see either all of it or none. Postings are ranged and sorted by field
and term, so that a query's predicate skips most row groups.
"""

from __future__ import annotations

import json
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import Analyzer, Index



def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that spark.checkpoint.dir names; a temporary one only where it is unset and there is but one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("on a cluster spark.checkpoint.dir has to name a shared folder")
        base = tempfile.mkdtemp(prefix="quarry-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Field types of a schema and the Spark types that hold them.
FIELD_TYPES = {"text": "string", "string": "string", "keyword": "string", "stored": "string", "int": "int", "long": "bigint", "float": "float", "double": "double", "binary": "binary", "inet": "binary", "date": "timestamp", "vector": "array<float>", "byte_vector": "array<tinyint>", "late_interaction": "array<array<float>>", "feature": "map<string,float>", "lat_lon": "struct<lat:double,lon:double>", "xy": "struct<x:float,y:float>", "shape": "string", "int_range": "struct<min:array<int>,max:array<int>>", "long_range": "struct<min:array<bigint>,max:array<bigint>>", "double_range": "struct<min:array<double>,max:array<double>>", "sorted_numeric": "array<bigint>", "sorted_set": "array<string>", "facet": "array<string>"}


@dataclass
class Schema:
    """Fields by name: type, and options such as dims. A name keeps the type it was first given."""

    fields: dict[str, tuple[str, dict]] = field(default_factory=dict)

    def add(self, name: str, kind: str, **options) -> Schema:
        if kind not in FIELD_TYPES:
            raise ValueError(f"no field type {kind}")
        if name in self.fields and self.fields[name] != (kind, options):
            raise ValueError(f"{name} is {self.fields[name]}, not {(kind, options)}")
        self.fields[name] = (kind, options)
        return self

    def ddl(self) -> str:
        return ", ".join(f"`{n}` {FIELD_TYPES[k]}" for n, (k, _) in self.fields.items())

    def conform(self, docs: DataFrame) -> DataFrame:
        """Columns cast to their types; multi-valued ones sorted, sets without repeats."""
        out = []
        for n, (k, _) in self.fields.items():
            c = F.col(n).cast(FIELD_TYPES[k]) if n in docs.columns else F.lit(None).cast(FIELD_TYPES[k])
            if k == "sorted_numeric":
                c = F.array_sort(c)
            elif k == "sorted_set":
                c = F.array_sort(F.array_distinct(c))
            out.append(c.alias(n))
        return docs.select(*out)


def truncated_feature(value):
    """A positive float as a feature field keeps it: with the 15 lowest bits of its float form cleared."""
    @F.pandas_udf("float")
    def udf(s: pd.Series) -> pd.Series:
        bits = s.to_numpy(np.float32, na_value=np.nan).view(np.uint32) & np.uint32(0xFFFF8000)
        return pd.Series(bits.view(np.float32))

    return udf(value)


class IndexStore:
    """A stored index under a path; keys identify documents."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    # --- versions ---------------------------------------------------------------------------------

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/versions")
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json") and s.getLen()) if fs.exists(p) else []

    def manifest(self, version: int | None = None) -> dict:
        version = version or (self.versions() or [0])[-1]
        if not version:
            return {"segments": [], "deleted": []}
        text = self.spark.read.text(f"{self.path}/versions/{version}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, manifest: dict, read: int) -> int:
        """The manifest as the version after `read`, the one it was made from. Fails if another writer has made that version since."""
        version = read + 1
        fs, final = self._fs(f"{self.path}/versions/{version}.json")
        try:
            out = fs.create(final, False)  # exclusive, also where a rename would overwrite
        except Exception as e:
            raise FileExistsError(f"version {version} exists") from e
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        return version

    def _change(self, change: Callable[[dict], dict]) -> int:
        """Commits a change that holds for any version, made again to what other writers have committed meanwhile."""
        for _ in range(100):
            read = (self.versions() or [0])[-1]
            try:
                return self._commit(change(self.manifest(read)), read)
            except FileExistsError:
                time.sleep(0.1)
        raise OSError(f"{self.path} is written too often")

    # --- writing -----------------------------------------------------------------------------------

    def add(self, docs: DataFrame, fields: dict[str, Analyzer], sort_by: list[str] | None = None, codec: str = "zstd", stored: bool = True) -> int:
        """Documents as a new segment: stored fields, postings and lengths. Returns the version."""
        name = uuid.uuid4().hex
        base = f"{self.path}/segments/{name}"
        index = Index(docs, fields, self.key)
        rows = docs if sort_by is None else docs.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
        rows.write.option("compression", codec).parquet(f"{base}/stored")
        write_postings(index, base, codec)
        return self._change(lambda m: {"segments": [*m["segments"], {"name": name, "fields": list(fields), "from": len(m["deleted"])}], "deleted": m["deleted"]})

    def delete(self, ids: DataFrame) -> int:
        """Documents by key, out of all segments so far; soft until a merge."""
        name = uuid.uuid4().hex
        ids.select(F.col(ids.columns[0]).alias(self.key)).distinct().write.parquet(f"{self.path}/deleted/{name}")
        return self._change(lambda m: {"segments": m["segments"], "deleted": [*m["deleted"], name]})

    def delete_where(self, predicate: str) -> int:
        """Documents whose stored fields satisfy a predicate."""
        return self.delete(self.docs().where(predicate).select(self.key))

    def update(self, docs: DataFrame, fields: dict[str, Analyzer]) -> int:
        """Documents in place of those with their keys."""
        self.delete(docs.select(self.key))
        return self.add(docs, fields)

    def merge(self, partitions: int | None = None, fields: dict[str, Analyzer] | None = None) -> int:
        """All live documents as one segment; what was deleted is gone. Fails if others have written meanwhile."""
        read = (self.versions() or [0])[-1]
        m = self.manifest(read)
        name = uuid.uuid4().hex
        base = f"{self.path}/segments/{name}"
        for kind in ("stored", "postings", "lengths"):
            rows = self._read(kind, m)
            if rows is not None:
                rows = rows.repartitionByRange("field", "term", "doc_id").sortWithinPartitions("field", "term", "doc_id") if kind == "postings" else (rows if partitions is None else rows.repartition(partitions))
                rows.write.parquet(f"{base}/{kind}")
        names = sorted({f for s in m["segments"] for f in s["fields"]})
        return self._commit({"segments": [{"name": name, "fields": names, "from": 0}], "deleted": []}, read)

    def merge_from(self, *others: IndexStore) -> int:
        """Other indexes' segments as this one's, copied."""
        segments = []
        for o in others:
            om = o.manifest()
            name = uuid.uuid4().hex
            for kind in ("stored", "postings", "lengths"):
                rows = o._read(kind, om)
                if rows is not None:
                    rows.write.parquet(f"{self.path}/segments/{name}/{kind}")
            segments.append({"name": name, "fields": sorted({f for s in om["segments"] for f in s["fields"]})})
        return self._change(lambda m: {"segments": [*m["segments"], *({**s, "from": len(m["deleted"])} for s in segments)], "deleted": m["deleted"]})

    def expunge(self, keep: int = 1) -> list[int]:
        """Manifests of all but the last `keep` versions go; returns those that stay."""
        fs, _ = self._fs(self.path)
        for v in self.versions()[:-keep]:
            fs.delete(self._fs(f"{self.path}/versions/{v}.json")[1], False)
        return self.versions()

    # --- reading ------------------------------------------------------------------------------------

    def _read(self, kind: str, manifest: dict) -> DataFrame | None:
        key = self.key if kind == "stored" else "doc_id"
        out = None
        for s in manifest["segments"]:
            if kind != "stored" and not s["fields"]:
                continue
            rows = self.spark.read.parquet(f"{self.path}/segments/{s['name']}/{kind}")
            for d in manifest["deleted"][s["from"] :]:
                gone = self.spark.read.parquet(f"{self.path}/deleted/{d}").withColumnRenamed(self.key, "_gone")
                rows = rows.join(gone, rows[key] == F.col("_gone"), "left_anti")
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def docs(self, version: int | None = None, columns: Iterable[str] | None = None) -> DataFrame:
        """Live stored documents of a version (None: the last); only some columns are read if named."""
        rows = self._read("stored", self.manifest(version))
        if rows is None:
            raise ValueError("the index is empty")
        return rows if columns is None else rows.select(self.key, *columns)

    def open(self, fields: dict[str, Analyzer], version: int | None = None) -> Index:
        """A snapshot to search: it stays as it is while others write."""
        m = self.manifest(version)
        return Index(self.docs(version), fields, self.key, stored=self._read("postings", m), stored_lengths=self._read("lengths", m))

    def export_text(self, path: str) -> None:
        """Postings as JSON lines, for people to read."""
        self._read("postings", self.manifest()).write.json(path)


def write_postings(index: Index, base: str, codec: str = "zstd") -> None:
    """An index's postings, ranged and sorted by field, term and document, and its lengths, under a path.

    Tokens are written as they are grouped and then read again: finding the ranges takes a look at
    all rows, which is cheaper on what is written than by analysing every text twice.
    """
    postings = None
    for f in index.fields:
        p = index._postings(f, None).select(F.lit(f).alias("field"), "term", "doc_id", "dl", "tf", "positions")
        postings = p if postings is None else postings.union(p)
    if postings is None:
        return
    spark = index.docs.sparkSession
    postings.write.parquet(f"{base}/unsorted")
    rows = spark.read.parquet(f"{base}/unsorted")
    rows.repartitionByRange("field", "term", "doc_id").sortWithinPartitions("field", "term", "doc_id").write.option("compression", codec).parquet(f"{base}/postings")
    rows.select("field", "doc_id", "dl").distinct().write.option("compression", codec).parquet(f"{base}/lengths")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/unsorted")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_KEPT: dict[tuple, str] = {}


def stored_index(spark: SparkSession, path: str, fields: dict[str, Analyzer], key: str = "doc_id") -> Index:
    """An index of the table at `path`, whose postings are stored once in a session and then read by all queries.

    The table's files, with their sizes and times, are part of what identifies the postings: a
    table that has changed is indexed anew.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(where))
    known = (spark.sparkContext.applicationId, tuple(files), key, tuple(sorted((n, f.__qualname__) for n, f in fields.items())))
    docs = spark.read.parquet(path)
    if known not in _KEPT:
        base = scratch_path(spark, "postings")
        write_postings(Index(docs, fields, key), base)
        _KEPT[known] = base
    base = _KEPT[known]
    return Index(docs, fields, key, stored=spark.read.parquet(f"{base}/postings"), stored_lengths=spark.read.parquet(f"{base}/lengths"))


def multi(*indexes: DataFrame) -> DataFrame:
    """Several indexes' documents as one, with their number as `shard`."""
    out = None
    for i, d in enumerate(indexes):
        d = d.withColumn("shard", F.lit(i))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def parallel(*indexes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Indexes that hold different fields of the same documents, side by side."""
    out = indexes[0]
    for d in indexes[1:]:
        out = out.join(d, key)
    return out


def live_values(snapshot: DataFrame, recent: DataFrame, key: str = "doc_id") -> DataFrame:
    """A snapshot's values by key with what has been written since: `recent` has the same columns and `deleted`."""
    own = recent.withColumnRenamed(key, "_key")
    kept = snapshot.join(own.select("_key"), F.col(key) == F.col("_key"), "left_anti")
    return kept.unionByName(recent.where(~F.coalesce("deleted", F.lit(False))).drop("deleted"))


def replicate(store: IndexStore, path: str) -> IndexStore:
    """The newest version's segments copied to another path."""
    other = IndexStore(store.spark, path, store.key)
    other.merge_from(store)
    return other
