"""C1 leader clustering and C2 first-fit clustering as parallel fixpoints.

Both sequential definitions depend only on the occurrence order, so they are
rebuilt as label propagation over the edge table (``u < v`` by first
occurrence).  Each round is a couple of joins and one aggregation; the round
result is written with ``checkpoint()`` to the shared checkpoint directory,
which cuts the lineage and lets a lost executor be recomputed from there.
Only values that have an edge take part in the rounds; isolated values are
their own cluster.

C1 (leader): take the first unassigned value as base, every later unassigned
value similar to the base joins it.  Leaders are the greedy independent set in
rank order: a value with no lower neighbour left is a leader, the values above a
leader are covered, and both leave with their edges.  A round deals the edges out by
ranges of values, and a task applies the rule to its range in order, with what is
known of values outside.  Neighbours are lower values, so a round settles the lowest
range whole and a dependency takes a round only where it crosses ranges.  A range has
half a million edges, so there are no more rounds than that number goes into the edges,
and few Spark jobs a round, as the driver keeps a record of every job.  A value with a single lower neighbour left has the opposite state of
it; such values form chains, which, after a round that left most of the edges, are
followed by doubling pointers (target, parity), so that a line of n similar neighbours
takes about log n steps.  A covered value joins its lowest leader neighbour.

C2 (first fit): a value joins the first cluster holding any similar earlier
value.  Its label is the minimum label over earlier neighbours (its own rank
when there is none); iterate ``lab(v) = min(lab(v), lab(u) for u < v,
lab(lab(v)))`` from ``lab = rank`` until nothing changes.  Labels only fall
and never below the true label, so the fixpoint is the sequential result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canonspark.operators.rank import row_number_within
from canonspark.session import ensure_checkpoint_dir

NODE = ["group_key", "v"]
LIVE = ["group_key", "u", "v", "state"]
COVERED, OPEN, LEADS = 0, 1, 2
BLOCK = 500_000  # edges of a range of values
SLOW = 0.5  # chains are followed when a round leaves more than this share of the edges


def _ckpt(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select("group_key", "v").unionByName(
        edges.select("group_key", F.col("u").alias("v"))).distinct()


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels(group_key, v, lab)`` put on the nodes; the others lead themselves."""
    return (nodes.join(labels.withColumnRenamed("v", "occ"), ["group_key", "occ"], "left")
            .withColumn("leader", F.coalesce(F.col("lab"), F.col("occ"))).drop("lab"))


def first_fit_leaders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes(group_key, occ, ...)`` -> same rows plus ``leader`` (an occ).
    Labels fall in every round but the last, so the loop ends."""
    lab = _ckpt(_ends(edges).select("group_key", "v", F.col("v").alias("lab")))
    while True:
        cand = (edges.join(lab.withColumnRenamed("v", "u"), ["group_key", "u"])
                .groupBy("group_key", "v").agg(F.min("lab").alias("cand")))
        jump = lab.select("group_key", F.col("v").alias("lab"), F.col("lab").alias("jl"))
        best = F.least("lab", "cand", "jl")
        lab = _ckpt(lab.join(cand, NODE, "left").join(jump, ["group_key", "lab"], "left")
                    .select("group_key", "v", best.alias("new"), (best < F.col("lab")).alias("changed"))
                    .withColumnRenamed("new", "lab"))
        if lab.where("changed").isEmpty():
            return _labelled(nodes, lab.drop("changed"))
        lab = lab.drop("changed")


def _chains(single: DataFrame) -> DataFrame:
    """``single(group_key, v, u)``: v is the opposite of u.  Follows the pointers to
    their ends by doubling: ``(group_key, v, root, odd)``."""
    ptr = _ckpt(single.select("group_key", "v", F.col("u").alias("root"), F.lit(True).alias("odd")))
    while True:
        onward = ptr.select("group_key", F.col("v").alias("root"), F.col("root").alias("r2"), F.col("odd").alias("o2"))
        nxt = _ckpt(ptr.join(onward, ["group_key", "root"], "left").select(
            "group_key", "v", F.coalesce("r2", "root").alias("root"),
            F.when(F.col("r2").isNull(), F.col("odd")).otherwise(F.col("odd") != F.col("o2")).alias("odd"),
            F.col("r2").isNotNull().alias("moved")))
        ptr = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            return ptr


def _leaves(array: pa.Array) -> list[list]:
    """The columns of a key, of its fields if it is a struct."""
    if pa.types.is_struct(array.type):
        return [x for part in array.flatten() for x in _leaves(part)]
    if pa.types.is_integer(array.type) and not array.null_count:
        return [array.to_numpy(zero_copy_only=False).tolist()]
    texts = array.dictionary_encode()  # equal texts are one object
    each = texts.dictionary.to_pylist()
    return [[None if i is None else each[i] for i in texts.indices.to_pylist()]]


def _keys(batch: pa.RecordBatch, node: str) -> list[tuple]:
    return list(zip(*_leaves(batch.column("group_key")), *_leaves(batch.column(node))))


def _whole_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by value, dealt anew so that no value is in two batches."""
    held: list[pa.RecordBatch] = []
    of = None
    for batch in (b for b in batches if b.num_rows):
        v = _keys(batch, "v")
        cut = len(v)
        while cut and v[cut - 1] == v[-1]:
            cut -= 1
        if held and (cut or of != v[-1]):
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield batch.slice(0, cut)
        held.append(batch.slice(cut))
        of = v[-1]
    if held:
        yield pa.concat_batches(held)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sequential rule within a block of values.  Rows ``(group_key, u, v, state)``
    sorted by v, with the state of u as far as it is known.  Gives a row without u for
    every value that is covered or open, and for open ones the rows of their open u."""
    known: dict[tuple, int] = {}  # of the values of this block
    for rows in _whole_values(batches):
        u, v, state = _keys(rows, "u"), _keys(rows, "v"), rows.column("state").to_pylist()
        at, kept, first, found = 0, [], [], []
        while at < len(v):
            me, begin, now, mine = v[at], at, LEADS, []
            while at < len(v) and v[at] == me:
                if now != COVERED:
                    s = known.get(u[at], state[at])
                    if s == LEADS:
                        now = COVERED
                    elif s == OPEN:
                        now = OPEN
                        mine.append(at)
                at += 1
            known[me] = now
            if now != LEADS:
                first.append(begin)
                found.append(now)
            if now == OPEN:
                kept += mine
        shape = pa.schema([rows.schema.field(c).with_nullable(True) for c in LIVE])
        whole = rows.take(pa.array(first, pa.int64()))
        none = pa.nulls(len(first), shape.field("u").type)
        yield pa.RecordBatch.from_arrays([whole.column("group_key"), none, whole.column("v"),
                                          pa.array(found, pa.int32())], schema=shape)
        yield pa.RecordBatch.from_arrays(rows.take(pa.array(kept, pa.int64())).select(LIVE).columns, schema=shape)


def _with_state(edges: DataFrame, states: DataFrame) -> DataFrame:
    """The state of u put on every edge; whoever has none leads."""
    known = states.select("group_key", F.col("v").alias("u"), "state")
    return edges.select("group_key", "u", "v").join(known, ["group_key", "u"], "left").select(
        "group_key", "u", "v", F.coalesce("state", F.lit(LEADS)).alias("state"))


def _chained(live: DataFrame) -> DataFrame:
    """``(group_key, v, state)`` of the values that chains of single lower neighbours
    link to a leader."""
    live = live.where(F.col("state") != COVERED)
    low = live.groupBy("group_key", "v").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("u"))
    lead = live.select("group_key", F.col("u").alias("root")).distinct().join(
        low.select("group_key", F.col("v").alias("root")), ["group_key", "root"], "left_anti")
    return _ckpt(_chains(low.where("n = 1")).join(lead, ["group_key", "root"], "left_semi").select(
        "group_key", "v", F.when(F.col("odd"), F.lit(COVERED)).otherwise(F.lit(LEADS)).alias("state")))


def leader_leaders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes(group_key, occ, ...)`` -> same rows plus ``leader`` (an occ).
    Every round settles at least the lowest block of values that are left.  Whoever is
    never covered leads, so the covered values are all that is kept of a round."""
    live = _with_state(edges, edges.select("group_key", "v", F.lit(OPEN).alias("state")).distinct())
    schema = T.StructType([T.StructField(c, live.schema[c].dataType) for c in LIVE])
    covered, left = [], edges.count()
    while True:
        out = _ckpt(live.select(*LIVE).repartitionByRange(1 + left // BLOCK, "group_key", "v")
                    .sortWithinPartitions("group_key", "v").mapInArrow(_settle, schema))
        states, rest = out.where("u is null"), out.where("u is not null")
        covered.append(states.where(F.col("state") == COVERED).select(*NODE))
        before, left = left, rest.count()
        if not left:
            break
        live = _with_state(rest, states)
        if left > before * SLOW:
            live = _ckpt(live)
            ends = _chained(live)
            covered.append(ends.where(F.col("state") == COVERED).select(*NODE))
            new = ends.select("group_key", F.col("v").alias("u"), F.col("state").alias("new"))
            live = (live.join(ends, NODE, "left_anti").join(new, ["group_key", "u"], "left")
                    .withColumn("state", F.coalesce("new", "state")))
    every = covered[0]
    for c in covered[1:]:
        every = every.unionByName(c)
    cover = (edges.join(every.withColumnRenamed("v", "u"), ["group_key", "u"], "left_anti")
             .groupBy("group_key", "v").agg(F.min("u").alias("lab")))
    return _labelled(nodes, _ckpt(cover))


def assign_leaders(nodes: DataFrame, edges: DataFrame, algorithm: str) -> DataFrame:
    if algorithm not in ("leader", "first_fit"):
        raise ValueError(f"unknown clustering algorithm {algorithm!r}")
    e = _ckpt(edges.select("group_key", "u", "v"))
    return (leader_leaders if algorithm == "leader" else first_fit_leaders)(nodes, e)


def number_clusters(assigned: DataFrame) -> DataFrame:
    """``cluster_id`` 1.. per group in order of formation (leader order),
    tag ``cluster_<n>``."""
    leaders = assigned.select("group_key", "leader").distinct()
    ranked = row_number_within(leaders, ["group_key"], ["leader"], "cluster_id")
    return (assigned.join(ranked, ["group_key", "leader"])
            .withColumn("cluster_tag", F.concat(F.lit("cluster_"), F.col("cluster_id").cast("string"))))


def cluster_values(nodes: DataFrame, edges: DataFrame, algorithm: str) -> DataFrame:
    """Distinct values with ``leader``, ``cluster_id`` and ``cluster_tag``."""
    # reused by suggestions, members and the value map: materialise once
    return _ckpt(number_clusters(assign_leaders(nodes, edges, algorithm)))


def _undominated(points: DataFrame) -> DataFrame:
    """``points(group_key, norm, at, lab, new)`` without those that an earlier (or equal)
    point of the same value with a label as low makes needless."""
    w = (Window.partitionBy("group_key", "norm").orderBy("at", "lab", "new")
         .rowsBetween(Window.unboundedPreceding, -1))
    return (points.withColumn("_low", F.min("lab").over(w))
            .where(F.col("_low").isNull() | (F.col("lab") < F.col("_low"))).drop("_low"))


def first_fit_exact(norm_long: DataFrame, edges: DataFrame) -> DataFrame:
    """C2 on occurrences (D13 ``exact``): two equal values may land in
    different clusters, as in the sequential rule over rows.

    Labels never rise along one value, so a value is a falling step function:
    points ``(at, lab)``, one per change of its label.  It starts with the label
    that the first occurrences alone give (the first-fit solver over values).  A
    step of y at t reaches a similar x at the first occurrence of x after t; steps
    are sent on until none lowers a label earlier than known.  Rounds move points,
    not occurrences x similar values.  Values without any edge keep one cluster per
    value.  Returns ``group_key, occ, norm, leader`` for every occurrence.
    """
    from canonspark.operators.asof import first_after, last_before

    occ = norm_long.select("group_key", "norm", "occ")
    vals = edges.select("group_key", F.col("a").alias("x"), F.col("b").alias("y")).unionByName(
        edges.select("group_key", F.col("b").alias("x"), F.col("a").alias("y")))
    active = vals.select("group_key", F.col("x").alias("norm")).distinct()
    act = _ckpt(occ.join(active, ["group_key", "norm"], "left_semi"))
    none = F.lit(None).cast(occ.schema["occ"].dataType)
    firsts = act.groupBy("group_key", "norm").agg(F.min("occ").alias("occ"))
    points = _ckpt(assign_leaders(firsts, edges, "first_fit").select(
        "group_key", "norm", F.col("occ").alias("at"), F.col("leader").alias("lab"), F.lit(False).alias("new")))
    moved = points
    while not moved.isEmpty():
        sent = (moved.withColumnRenamed("norm", "y").join(vals, ["group_key", "y"])
                .groupBy("group_key", F.col("x").alias("norm"), "lab").agg(F.min("at").alias("at"))
                .withColumn("new", F.lit(True)))
        sent = _undominated(points.unionByName(sent)).where("new")
        timed = sent.select("group_key", "norm", F.col("at").alias("occ"), "lab", none.alias("ref")).unionByName(
            act.withColumns({"lab": none, "ref": F.col("occ")}))
        # ``at`` is an occurrence of another value, so the order is total but for labels sent at once
        reached = (first_after(timed, ["group_key", "norm"], ["occ", "lab"], "ref", "at")
                   .where(F.col("lab").isNotNull() & F.col("at").isNotNull())
                   .select("group_key", "norm", "at", "lab", F.lit(True).alias("new")))
        points = _ckpt(_undominated(points.withColumn("new", F.lit(False)).unionByName(reached)))
        moved = points.where("new")
    steps = points.select("group_key", "norm", F.col("at").alias("occ"), F.lit(0).alias("is_occ"), "lab")
    lab = (last_before(steps.unionByName(act.withColumns({"is_occ": F.lit(1), "lab": none})),
                       ["group_key", "norm"], ["occ", "is_occ"], "lab", "leader")
           .where("is_occ = 1"))
    first = occ.groupBy("group_key", "norm").agg(F.min("occ").alias("first"))
    rest = (occ.join(active, ["group_key", "norm"], "left_anti")
            .join(first, ["group_key", "norm"]).withColumn("leader", F.col("first")).drop("first"))
    return lab.select("group_key", "occ", "norm", "leader").unionByName(
        rest.select("group_key", "occ", "norm", "leader"))


def cluster_occurrences_exact(norm_long: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exact mode: (per-occurrence clusters, per-(cluster, value) table for
    suggestions with ``n`` and first ``occ`` inside the cluster)."""
    occ = first_fit_exact(norm_long, edges)
    leaders = occ.select("group_key", "leader").distinct()
    ranked = row_number_within(leaders, ["group_key"], ["leader"], "cluster_id")
    occ = _ckpt(occ.join(ranked, ["group_key", "leader"])
                .withColumn("cluster_tag", F.concat(F.lit("cluster_"), F.col("cluster_id").cast("string"))))
    per_value = (occ.groupBy("group_key", "cluster_id", "cluster_tag", "norm")
                 .agg(F.count(F.lit(1)).alias("n"), F.min("occ").alias("occ"))
                 .withColumn("leader", F.col("occ")))
    return occ, _ckpt(per_value)
