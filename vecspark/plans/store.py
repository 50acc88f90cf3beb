"""Versioned store of materialised subsets: a manifest per version, rows in folders that are never rewritten.

    root/manifest/version=N   one file: (pid, ftags, is_and, card, part)
    root/rows/part=P          rows of the subsets written together: (pid, id, v, tags), partitioned by ``sid``

A version becomes visible when its one-file manifest is committed, after all its rows are; a refit or append that fails
before that leaves the last version as it was.  A refit compares the wanted subsets with those held: it writes the rows
of created subsets only, keeps the folders of kept ones and forgets dropped ones.  Appended rows are written as
deltas: one more manifest line (pid, part) per subset that got any.  ``vacuum`` deletes the parts that no kept version names.

The manifest is a control table: it has a line per held subset and delta, and the held subsets are bounded by the budget
of the selection.  Rows are read by part and ``sid`` (partition pruning), so a search touches the subsets it was routed to.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.operators import predicates as P
from vecspark.session import shared_dir

MANIFEST = "pid string, ftags array<int>, is_and boolean, card long, part string"
ROWS = "pid string, id long, v array<float>, tags array<int>, sid string"


def sid_of(pid) -> F.Column:
    """A folder-safe name of a subset."""
    return F.substring(F.sha1(pid), 1, 16)


class SubsetStore:
    """Subsets under a shared folder; every change makes a new version."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or shared_dir(spark, f"subsets-{uuid.uuid4().hex[:12]}")

    # ------------------------------------------------------------------ versions

    def version(self) -> int:
        """Number of the last committed version, -1 if there is none."""
        found = self._list(f"{self.root}/manifest")
        done = [int(n.split("=")[1]) for n in found if n.startswith("version=") and "_SUCCESS" in self._list(f"{self.root}/manifest/{n}")]
        return max(done, default=-1)

    def manifest(self, version: int | None = None) -> DataFrame:
        """(pid, ftags, is_and, card, part) of a version, by default the last; empty before the first."""
        version = self.version() if version is None else version
        if version < 0:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/version={version}")

    def subsets(self, version: int | None = None) -> DataFrame:
        """(pid, ftags, is_and, card) of the held subsets, deltas included."""
        m = self.manifest(version)
        return m.groupBy("pid", "ftags", "is_and").agg(F.sum("card").alias("card"))

    def _lines(self, version: int) -> list[tuple]:
        return [tuple(r) for r in self.manifest(version).collect()]            # control table, bounded by the budget

    def _commit(self, lines: list[tuple], version: int) -> int:
        self.spark.createDataFrame(lines, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/manifest/version={version}")
        return version

    # ------------------------------------------------------------------ changes

    def refit(self, base_tagged: DataFrame, wanted: DataFrame) -> DataFrame:
        """Hold exactly ``wanted(pid, ftags, is_and)``: write what is new, forget what is not wanted.

        Returns the plan (pid, action): create, keep or drop.  Both lists are bounded by the budget of the selection.
        """
        version = self.version()
        held = self._lines(version)
        asked = {r["pid"]: (r["pid"], r["ftags"], r["is_and"]) for r in wanted.select("pid", "ftags", "is_and").collect()}
        kept = [line for line in held if line[0] in asked]
        have = {line[0] for line in held}
        lines = self._write(base_tagged, [asked[pid] for pid in sorted(set(asked) - have)])
        self._commit(kept + lines, version + 1)
        plan = [(pid, "keep" if pid in have else "create") for pid in asked] + [(pid, "drop") for pid in have - set(asked)]
        return self.spark.createDataFrame(plan, "pid string, action string")

    def append(self, delta_tagged: DataFrame) -> int:
        """Add new base rows to every held subset that they match; the new version's number."""
        version = self.version()
        held = self._lines(version)
        lines = self._write(delta_tagged, list({line[0]: line[:3] for line in held}.values()))
        return self._commit(held + [line for line in lines if line[3]], version + 1)

    def _write(self, rows: DataFrame, subsets: list[tuple]) -> list[tuple]:
        """Write the rows of ``subsets`` as a new part; a manifest line each (one without rows names no part)."""
        if not subsets:
            return []
        part = uuid.uuid4().hex[:16]
        found = P.matching_rows(rows.select("id", "v", "tags"), self.spark.createDataFrame(subsets, "pid string, ftags array<int>, is_and boolean"))
        found.withColumn("sid", sid_of(F.col("pid"))).hint("rebalance", "sid").write.partitionBy("sid").parquet(f"{self.root}/rows/part={part}")
        n = {r["pid"]: r["n"] for r in self._part(part).groupBy("pid").agg(F.count(F.lit(1)).alias("n")).collect()}
        return [(*s, n.get(s[0], 0), part if s[0] in n else None) for s in subsets]

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete the parts that none of the last ``keep`` versions names, and older manifests; the deleted parts."""
        last = self.version()
        live = {r["part"] for v in range(max(0, last - keep + 1), last + 1) for r in self.manifest(v).select("part").distinct().collect()}
        parts = [n.split("=")[1] for n in self._list(f"{self.root}/rows") if n.startswith("part=")]
        gone = [p for p in parts if p not in live]
        for v in range(max(0, last - keep + 1)):
            self._delete(f"{self.root}/manifest/version={v}")
        for p in gone:
            self._delete(f"{self.root}/rows/part={p}")
        return gone

    # ------------------------------------------------------------------ reading

    def _part(self, part: str) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(f"{self.root}/rows/part={part}")

    def rows(self, pids: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """(pid, id, v, tags) of the held subsets, or of those in ``pids``; parts and folders of others are not read."""
        m = self.manifest(version).where("part is not null")
        if pids is not None:
            m = m.join(pids.select("pid").distinct(), "pid", "left_semi")
        wanted: dict[str, list[str]] = {}
        for r in m.select("part", sid_of(F.col("pid")).alias("sid")).collect():       # control table, bounded by the budget
            wanted.setdefault(r["part"], []).append(r["sid"])
        out = None
        for part, sids in sorted(wanted.items()):
            rows = self._part(part).where(F.col("sid").isin(sids)).select("pid", "id", "v", "tags")
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], ROWS).drop("sid")

    # ------------------------------------------------------------------ folders, through Spark's file systems

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _list(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)
