"""Workload-driven subsets for numeric range predicates: cardinalities, lattice, routing and routed search.

A predicate is ``(pid, lo0, hi0, lo1, hi1, is_and)``: half-open ranges on two attributes, null = unbounded.  The distinct
bounds of all predicates cut each attribute into *elementary intervals*; a row's cell is the pair of intervals it lies in.
Every predicate is a whole number of cells, so

* cardinalities come from one scan that counts rows per cell (combined per task) and sums over each predicate's cells;
* a row meets the predicates through its interval number, an equi-join, not by testing all pairs;
* containment ``child ⊆ parent`` is an interval-containment join: the parent's interval on the first attribute is cut into at
  most two dyadic nodes a level, the child's lower end lies in one node a level, and both meet on the node's number; the
  other three bounds are then checked.

Bounds are a control list: two per distinct predicate of the workload and attribute.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.operators import blockscan
from vecspark.operators import predicates as P
from vecspark.plans import workload as W
from vecspark.plans.store import sid_of
from vecspark.session import cut_lineage, shared_dir

BOUNDS = ("lo0", "hi0", "lo1", "hi1")


def range_key() -> Column:
    """Normalised key of a range predicate; ``*`` is unbounded."""
    return F.concat_ws("|", F.when(F.col("is_and"), "and").otherwise("or"), *[F.coalesce(F.col(c).cast("string"), F.lit("*")) for c in BOUNDS])


def tally(workload: DataFrame) -> DataFrame:
    """(pid, lo0, hi0, lo1, hi1, is_and, cnt): identical predicates of the log counted once."""
    return workload.groupBy(*BOUNDS, "is_and").agg(F.count(F.lit(1)).alias("cnt")).withColumn("pid", range_key())


class Grid:
    """The elementary intervals of a set of predicates: sorted distinct bounds of both attributes."""

    def __init__(self, preds: DataFrame):
        got = preds.agg(*[F.sort_array(F.array_distinct(F.concat(F.collect_set(f"lo{a}"), F.collect_set(f"hi{a}")))).alias(f"e{a}") for a in (0, 1)]).first()
        self.ends = [np.array(got[f"e{a}"], dtype=float) for a in (0, 1)]

    def cells(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with a0, a1) and the numbers ``c0, c1`` of the intervals that a row lies in: bounds at or below it."""
        ends, names = self.ends, rows.columns

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cells = [pa.array(np.searchsorted(ends[a], b.column(names.index(f"a{a}")).to_numpy(zero_copy_only=False), side="right"), pa.int32())
                         for a in (0, 1)]
                yield pa.RecordBatch.from_arrays([*b.columns, *cells], names=[*names, "c0", "c1"])

        shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        return rows.mapInArrow(number, f"{shape}, c0 int, c1 int")

    def spans(self, preds: DataFrame) -> DataFrame:
        """``preds`` with the interval numbers ``f0..t0`` and ``f1..t1`` (both inclusive) of their ranges."""
        out = preds
        for a in (0, 1):
            ends = F.array(*[F.lit(float(e)) for e in self.ends[a]]).cast("array<double>")
            out = out.withColumn(f"f{a}", F.coalesce(F.array_position(ends, F.col(f"lo{a}")).cast("int"), F.lit(0)))
            out = out.withColumn(f"t{a}", F.coalesce(F.array_position(ends, F.col(f"hi{a}")).cast("int") - 1, F.lit(len(self.ends[a]))))
        return out


def cardinality(base_attrs: DataFrame, preds: DataFrame, grid: Grid) -> DataFrame:
    """(pid, card): exact rows of each predicate.  An OR counts both ranges less what they share."""
    per = cut_lineage(grid.cells(base_attrs.select("a0", "a1")).groupBy("c0", "c1").agg(F.count(F.lit(1)).alias("n")))
    rows = per.groupBy("c0").agg(F.collect_list(F.struct("c1", "n")).alias("held"))
    s = grid.spans(preds)
    all0, all1 = F.lit(len(grid.ends[0])), F.lit(len(grid.ends[1]))
    both = F.struct(F.lit(1).alias("sign"), *[F.col(c) for c in ("f0", "t0", "f1", "t1")])
    first = F.struct(F.lit(1).alias("sign"), F.col("f0"), F.col("t0"), F.lit(0).alias("f1"), all1.alias("t1"))
    second = F.struct(F.lit(1).alias("sign"), F.lit(0).alias("f0"), all0.alias("t0"), F.col("f1"), F.col("t1"))
    less = F.struct(F.lit(-1).alias("sign"), *[F.col(c) for c in ("f0", "t0", "f1", "t1")])
    rect = s.select("pid", F.explode(F.when(F.col("is_and"), F.array(both)).otherwise(F.array(first, second, less))).alias("r")).select("pid", "r.*")
    rect = rect.where("f0 <= t0 and f1 <= t1").withColumn("c0", F.explode(F.sequence("f0", "t0")))
    n = F.aggregate(F.filter("held", lambda h: (h["c1"] >= F.col("f1")) & (h["c1"] <= F.col("t1"))), F.lit(0).cast("long"), lambda a, h: a + h["n"])
    got = rect.join(rows, "c0").groupBy("pid").agg(F.sum(F.col("sign") * n).alias("card"))
    return preds.select("pid").distinct().join(got, "pid", "left").select("pid", F.coalesce("card", F.lit(0)).cast("long").alias("card"))


def candidates(base_attrs: DataFrame, workload: DataFrame, p: W.Params) -> DataFrame:
    """The workload's distinct range predicates with count and exact cardinality, from ``p.cutoff`` rows on."""
    t = cut_lineage(tally(workload))
    card = cardinality(base_attrs, t, Grid(t))
    return cut_lineage(t.join(card, "pid").where(F.col("card") >= p.cutoff))


# ------------------------------------------------------------------ containment

def _dyadic(first: Column, last: Column, bits: int) -> Column:
    """Numbers (level, node) of the dyadic nodes that make up ``first..last``: at most two a level."""
    def level(k: Column) -> Column:
        size = F.pow(F.lit(2), k)
        lo, hi = F.ceil(first / size).cast("long"), F.floor((last + 1) / size).cast("long")
        return F.array(F.when((lo < hi) & (lo % 2 == 1), F.struct(k.alias("level"), lo.alias("node"))),
                       F.when((lo < hi) & (hi % 2 == 1), F.struct(k.alias("level"), (hi - 1).alias("node"))))
    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(bits)), level)), lambda x: x.isNotNull())


def containment_edges(preds: DataFrame) -> DataFrame:
    """All ``(child, parent)`` with equal AND/OR flag and both of the child's ranges inside the parent's, self pairs included."""
    s = cut_lineage(Grid(preds).spans(preds).select("pid", *BOUNDS, "is_and", "f0", "t0").distinct())
    bits = int(s.agg(F.max("t0")).first()[0] or 0).bit_length() + 1
    sides = {side: F.struct("pid", *BOUNDS, "is_and").alias(side) for side in ("child", "parent")}
    nodes = s.select(sides["parent"], F.explode(F.array_distinct(_dyadic(F.col("f0"), F.greatest("t0", "f0"), bits))).alias("at"))
    spot = F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda k: F.struct(k.alias("level"), F.floor(F.col("f0") / F.pow(F.lit(2), k)).cast("long").alias("node")))
    points = s.select(sides["child"], F.explode(spot).alias("at"))
    pairs = points.join(nodes, "at").where(P.range_subsumes("child", "parent"))
    return pairs.select(F.col("child.pid").alias("child"), F.col("parent.pid").alias("parent")).distinct()


# ------------------------------------------------------------------ routing and search

def route(queries_r: DataFrame, subsets: DataFrame, root_card: int) -> DataFrame:
    """Per query ``(qid, qkey, route, route_card, kind)``: the exact subset, else the smallest containing one, else the root."""
    q = queries_r.select("qid", *BOUNDS, "is_and", range_key().alias("qkey"))
    both = q.select(F.col("qkey").alias("pid"), *BOUNDS, "is_and").unionByName(subsets.select("pid", *BOUNDS, "is_and")).distinct()
    options = containment_edges(both).withColumnRenamed("child", "qkey").join(subsets.select(F.col("pid").alias("parent"), "card"), "parent")
    best = options.groupBy("qkey").agg(F.min(F.struct((F.col("qkey") != F.col("parent")).alias("wider"), "card", "parent")).alias("b"))
    x = q.select("qid", "qkey").join(best, "qkey", "left")
    return x.select("qid", "qkey", F.coalesce("b.parent", F.lit("root")).alias("route"),
                    F.coalesce("b.card", F.lit(root_card).cast("long")).alias("route_card"),
                    F.when(F.col("b").isNull(), "root").when(F.col("b.wider"), "superset").otherwise("exact").alias("kind"))


def subset_rows(base_attrs: DataFrame, subsets: DataFrame, *columns: str) -> DataFrame:
    """Rows ``(pid, *columns)`` of each subset: met by interval number of one attribute, then tested."""
    grid = Grid(subsets)
    s = grid.spans(subsets.select("pid", *BOUNDS, "is_and"))
    cells = grid.cells(base_attrs)
    inside = [(F.col(f"c{a}") >= F.col(f"f{a}")) & (F.col(f"c{a}") <= F.col(f"t{a}")) for a in (0, 1)]
    # an AND row lies in the first range; an OR row in the first, or else in the second
    by0 = s.where("f0 <= t0").withColumn("c0", F.explode(F.sequence("f0", "t0")))
    by1 = s.where("not is_and and f1 <= t1").withColumn("c1", F.explode(F.sequence("f1", "t1")))
    first = cells.join(by0, "c0").where(~F.col("is_and") | inside[1])
    second = cells.join(by1, "c1").where(~inside[0])
    return first.select("pid", *columns).unionByName(second.select("pid", *columns))


def materialise(base_attrs: DataFrame, subsets: DataFrame) -> DataFrame:
    """Write the subsets' rows (pid, id, v, a0, a1), a folder each, and re-read them."""
    path = shared_dir(base_attrs.sparkSession, f"ranges-{uuid.uuid4().hex[:12]}")
    rows = subset_rows(base_attrs.select("id", "v", "a0", "a1"), subsets, "id", "v", "a0", "a1")
    rows.withColumn("sid", sid_of(F.col("pid"))).hint("rebalance", "sid").write.partitionBy("sid").parquet(path)
    return base_attrs.sparkSession.read.parquet(path)


def search(base_attrs: DataFrame, queries_r: DataFrame, routed: DataFrame, rows: DataFrame, k: int = 10, metric: str = "l2") -> DataFrame:
    """Range-filtered k-NN: each query scans the stored subset it is routed to, or the base; equal to the exact answer."""
    q = queries_r.join(routed.select("qid", "route"), "qid").checkpoint()
    sub = q.where("route <> 'root'")
    sids = [r[0] for r in sub.select(sid_of(F.col("route"))).distinct().collect()]           # routed subsets: control list
    out = blockscan.knn(base_attrs, q.where("route = 'root'"), k, metric, range_filter=True)
    if not sids:
        return out
    return out.unionByName(blockscan.knn(rows.where(F.col("sid").isin(sids)).drop("sid"), sub, k, metric, range_filter=True, route_filter=True))
