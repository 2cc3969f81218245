"""A graph store: one Parquet table per relation, versions by folder, snapshots by name.

A write makes new folders and then replaces the pointer by one rename, so that readers see
the old version or the new one; folders of a failed write are named by nothing and can be
cleaned away.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.schema import RELATIONS

#: Folders of one relation before an append writes them together.
MOST_FOLDERS = 64


class GraphStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    def _fs(self, at: str):
        p = self._jvm.org.apache.hadoop.fs.Path(at)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _pointer(self, snapshot: str | None = None) -> str:
        return f"{self.path}/snapshots/{snapshot}.json" if snapshot else f"{self.path}/current.json"

    def versions(self, snapshot: str | None = None) -> dict:
        """Folder by relation, and the generation."""
        fs, p = self._fs(self._pointer(snapshot))
        if not fs.exists(p):
            if snapshot:
                raise KeyError(f"no such snapshot: {snapshot}")
            return {"generation": 0, "tables": {}}
        stream = fs.open(p)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _point(self, value: dict, snapshot: str | None = None) -> None:
        at = self._pointer(snapshot)
        fs, p = self._fs(at)
        _, own = self._fs(f"{at}.{uuid.uuid4().hex}")
        out = fs.create(own, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        # One rename that replaces: readers find the old pointer or the new one, never none.
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fs.makeQualified(own), fs.makeQualified(p), options)

    @property
    def generation(self) -> int:
        return self.versions()["generation"]

    def read(self, relation: str, snapshot: str | None = None) -> DataFrame:
        found = self.versions(snapshot)["tables"].get(relation)
        if found:
            folders = [found] if isinstance(found, str) else found
            return self.spark.read.parquet(*(f"{self.path}/{f}" for f in folders))
        if relation not in RELATIONS:
            raise KeyError(relation)
        return self.spark.createDataFrame([], RELATIONS[relation])

    def _written(self, relation: str, df: DataFrame, partition_by: list[str] | None = None) -> str:
        folder = f"data/{relation}/{uuid.uuid4().hex}"
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(f"{self.path}/{folder}")
        return folder

    def write(self, relation: str, df: DataFrame, partition_by: list[str] | None = None) -> None:
        """Replace a relation."""
        self.write_all({relation: df}, partition_by)

    def write_all(self, relations: dict[str, DataFrame], partition_by: list[str] | None = None) -> None:
        """Replace several relations in one move: readers see all of them old or all new.  Fails
        if another writer moved the pointer meanwhile."""
        before = self.versions()
        new = {r: self._written(r, df, partition_by) for r, df in relations.items()}
        self._move(before, new)

    def _move(self, before: dict, new: dict) -> None:
        now = self.versions()
        if now["generation"] != before["generation"]:
            raise RuntimeError(f"the store moved from generation {before['generation']} to {now['generation']} meanwhile")
        self._point({"generation": now["generation"] + 1, "tables": now["tables"] | new})

    def append(self, relation: str, df: DataFrame) -> None:
        """Add rows in a folder of their own; what is there is not written again, unless the
        relation has come to lie in ``MOST_FOLDERS``."""
        before = self.versions()
        found = before["tables"].get(relation, [])
        folders = [found] if isinstance(found, str) else list(found)
        old = self.read(relation)
        rows = df.select(*old.columns) if old.columns else df
        if len(folders) >= MOST_FOLDERS:
            self.write(relation, old.unionByName(rows))
        else:
            self._move(before, {relation: [*folders, self._written(relation, rows)]})

    def unreferenced(self) -> list[str]:
        """Folders that neither the present version nor any snapshot names."""
        fs, root = self._fs(f"{self.path}/data")
        if not fs.exists(root):
            return []
        _, kept = self._fs(f"{self.path}/snapshots")
        names = [s.getPath().getName().removesuffix(".json") for s in fs.listStatus(kept)] if fs.exists(kept) else []
        held: set[str] = set()
        for version in [self.versions(), *(self.versions(n) for n in names)]:
            for found in version["tables"].values():
                held.update([found] if isinstance(found, str) else found)
        there = [f"data/{r.getPath().getName()}/{d.getPath().getName()}" for r in fs.listStatus(root) for d in fs.listStatus(r.getPath())]
        return sorted(set(there) - held)

    def clean(self) -> int:
        """Delete the folders that nothing names; to be run while nobody writes."""
        gone = self.unreferenced()
        for folder in gone:
            fs, p = self._fs(f"{self.path}/{folder}")
            fs.delete(p, True)
        return len(gone)

    def insert_nodes(self, nodes: DataFrame) -> None:
        """Add nodes whose id is not there yet; of several new ones with an id one counts."""
        old = self.read("nodes")
        fresh = nodes.dropDuplicates(["id"]).join(old.select("id"), "id", "left_anti")
        self.write("nodes", old.unionByName(fresh.select(*old.columns)))

    def upsert(self, relation: str, rows: DataFrame, keys: list[str]) -> None:
        from weftgraph.operators.annotations import upserted

        self.write(relation, upserted(self.read(relation), rows, keys))

    def without_facts(self, repo_id: str) -> dict[str, DataFrame]:
        """nodes, edges and calls without the facts of one repository; inferred and intent rows stay."""
        gone = F.coalesce((F.col("repo_id") == repo_id) & (F.col("layer") == "fact"), F.lit(False))
        own = F.coalesce(F.substring_index("src_id", ":", 1) == repo_id, F.lit(False))
        return {
            "nodes": self.read("nodes").filter(~gone),
            "edges": self.read("edges").filter(~(own & F.coalesce(F.col("layer") == "fact", F.lit(False)))),
            "calls": self.read("calls").filter(~own),
        }

    def clear_facts(self, repo_id: str) -> None:
        """Drop the facts of one repository in one move."""
        self.write_all(self.without_facts(repo_id))

    def forget(self, repos: list[str]) -> None:
        """Drop all that belongs to some repositories, whatever its layer."""
        own = lambda c: F.coalesce(F.substring_index(c, ":", 1).isin(*repos), F.lit(False))
        columns = {"nodes": "id", "edges": "src_id", "calls": "src_id", "annotations": "node_id"}
        self.write_all({r: self.read(r).filter(~own(F.col(c))) for r, c in columns.items()})

    def snapshot(self, name: str) -> None:
        """Keep the present version under a name; folders are shared, nothing is copied."""
        if not name.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"not a name for a snapshot: {name}")
        self._point(self.versions(), name)

    def drop_snapshot(self, name: str) -> None:
        fs, p = self._fs(self._pointer(name))
        if not fs.delete(p, False):
            raise KeyError(f"no such snapshot: {name}")
