"""Attribute and workload generators, hash-seeded so that they are deterministic under any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed generator constants.
GRADED_TAGS = 19          # tags at 5 %, 10 %, ..., 95 %
GRADED_STEP = 5
HASH_MUL, HASH_ADD, HASH_MOD = 2654435761, 40503, 1000003
ROUND_ROBIN = 20          # query i asks tag i % 20; 19 means no tag


def graded_tags(ids: DataFrame) -> DataFrame:
    """``(id, tag)``: tag j present iff ``((id·2654435761 + (j+1)·40503) mod 1000003) mod 100 < 5(j+1)``."""
    j = F.explode(F.sequence(F.lit(0), F.lit(GRADED_TAGS - 1))).alias("tag")
    x = ids.select("id", j)
    h = ((F.col("id") * HASH_MUL + (F.col("tag") + 1) * HASH_ADD) % HASH_MOD) % 100
    return x.where(h < (F.col("tag") + 1) * GRADED_STEP).select("id", F.col("tag").cast("int").alias("tag"))


def graded_query_tags(queries: DataFrame) -> DataFrame:
    """Round robin: query position i asks for tag ``i % 20`` (``19`` = no filter)."""
    i = (F.col("qid") / 25).cast("long") % ROUND_ROBIN
    return queries.withColumn("ftags", F.when(i == ROUND_ROBIN - 1, F.array().cast("array<int>"))
                              .otherwise(F.array(i.cast("int")))).withColumn("is_and", F.lit(True))


def halves(vec: DataFrame, nb: int) -> DataFrame:
    """Tags ``[1, 2]`` on the first half of the ids, ``[3, 4]`` on the second."""
    return vec.withColumn("tags", F.when(F.col("id") < nb // 2, F.array(F.lit(1), F.lit(2)))
                          .otherwise(F.array(F.lit(3), F.lit(4))))


def halves_queries(queries: DataFrame, nb: int) -> DataFrame:
    """Each query asks for the other half's tags (AND)."""
    return queries.withColumn("ftags", F.when(F.col("qid") < nb // 2, F.array(F.lit(3), F.lit(4)))
                              .otherwise(F.array(F.lit(1), F.lit(2)))).withColumn("is_and", F.lit(True))


# ------------------------------------------------------------------ sorted normal attributes

U_MUL, U_MOD = (2654435761, 40503), 1000003


def _uniform(id_col, salt: int):
    return ((id_col * U_MUL[0] + U_MUL[1] * salt) % U_MOD + 0.5) / float(U_MOD)


def sorted_normal_attrs(ids: DataFrame, n_attrs: int = 2) -> DataFrame:
    """``(id, a0, a1, ...)``: standard-normal values (Box-Muller of hash uniforms), each attribute
    sorted independently and handed out in id order, so that a row's position is its rank."""
    from vecspark.operators.ranking import ordered_positions
    out = ids.select("id")
    pos_id = ordered_positions(out, ["id"], F.floor(F.col("id") / (1 << 20)), "rid")
    for a in range(n_attrs):
        u1, u2 = _uniform(F.col("id"), 2 * a + 1), _uniform(F.col("id"), 2 * a + 2)
        z = F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * 3.141592653589793 * u2)
        vals = ids.select("id", z.alias("z"))
        pos_v = ordered_positions(vals, ["z", "id"], F.floor(F.col("z") * 1024), "rid").select("rid", F.col("z").alias(f"a{a}"))
        pos_id = pos_id.join(pos_v, "rid")
    return pos_id.drop("rid")


# ------------------------------------------------------------------ clustered runbooks

ROUND_ALPHA = (100, 15, 10, 5, 3)     # share weights of the insert rounds, permuted per cell
DELETE_LO, DELETE_SPAN = 0.5, 0.4    # delete fraction in [0.5, 0.9)


def runbook_from_cells(cells: DataFrame) -> DataFrame:
    """Runbook over cluster-contiguous ids (after ``cells.permute``): ``(step, op, start, end)``.

    ``cells(cell, n, offset)``.  Round r inserts ``floor(n · share(c, r))`` rows of each
    cell (share = the round's weight, the weights permuted per cell by a hash), each
    insert followed by a search; then deletes ``floor(f · (inserted − deleted))`` rows
    per cell (f in [0.5, 0.9) from a hash), each followed by a search.  The per-round
    cursors are a recurrence over the five rounds, written as column expressions on
    the (small) cells table.
    """
    R = len(ROUND_ALPHA)
    total = float(sum(ROUND_ALPHA))
    # cells numbered from 0 (about the square root of the rows, one row each)
    c = cells.select("cell", "n", "offset", (F.row_number().over(Window.orderBy("cell")) - 1).alias("no"))
    for r in range(R):
        c = c.withColumn(f"h{r}", F.xxhash64(F.col("cell"), F.lit(r)))
    for r in range(R):   # rank of round r among the cell's hashes → which weight it gets
        rank = sum(F.when(F.col(f"h{o}") > F.col(f"h{r}"), 1).otherwise(0) for o in range(R) if o != r)
        c = c.withColumn(f"w{r}", F.element_at(F.array(*[F.lit(a / total) for a in ROUND_ALPHA]), rank + 1))
    c = c.withColumn("ins", F.col("offset")).withColumn("dels", F.col("offset"))
    rows = []
    for r in range(R):
        c = (c.withColumn(f"is{r}", F.col("ins"))
              .withColumn("ins", F.col("ins") + F.floor(F.col("n") * F.col(f"w{r}")).cast("long"))
              .withColumn(f"ie{r}", F.col("ins"))
              .withColumn(f"ds{r}", F.col("dels"))
              .withColumn("f", F.lit(DELETE_LO) + F.lit(DELETE_SPAN) *
                          (F.pmod(F.xxhash64(F.col("cell"), F.lit(100 + r)), F.lit(1000)) / 1000.0))
              .withColumn("dels", F.col("dels") + F.floor(F.col("f") * (F.col("ins") - F.col("dels"))).cast("long"))
              .withColumn(f"de{r}", F.col("dels")))
        rows += [F.struct(F.lit(r).alias("r"), F.lit(0).alias("phase"), F.lit("insert").alias("op"),
                          F.col(f"is{r}").alias("start"), F.col(f"ie{r}").alias("end")),
                 F.struct(F.lit(r).alias("r"), F.lit(1).alias("phase"), F.lit("delete").alias("op"),
                          F.col(f"ds{r}").alias("start"), F.col(f"de{r}").alias("end"))]
    ops = c.select("no", F.explode(F.array(*rows)).alias("o")).select("no", "o.*")
    nc = cells.count()          # one scalar: the number of cells
    base = F.col("r") * (4 * nc) + F.col("phase") * (2 * nc) + F.col("no") * 2
    act = ops.select((base + 1).cast("int").alias("step"), "op", "start", "end")
    srch = ops.select((base + 2).cast("int").alias("step"), F.lit("search").alias("op"),
                      F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    return act.unionByName(srch)
