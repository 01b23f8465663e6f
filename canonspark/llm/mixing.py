"""Mixing sources to target weights by pivotal dependent rounding, in
DataFrame functions only.

A source's target over its size is the number of copies each of its documents
should get; the whole part is given to all, the fraction is the probability of
one more.  Two documents with fractions p, q and sizes s, t pair up: words are
moved between them, up or down at random such that both keep their expected
copies, until one is at 0 or 1.  The moved words are equal, so a source keeps
the sum of p * s; the other document goes on to the next pair.

The pairs form a reduction tree.  A level deals the open documents of a source
into groups of about ``group``, each group folds its documents (largest first,
so that the open one left over is small) and passes one residual up; a source
with a third of all rows is many groups.  The single residual of a source is
rounded by its probability, so a source misses its target by less than that
document's size.  All randomness is a hash of the document, the level and the
seed: reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canonspark.llm.textops import SPACE_WORD, written

WEIGHTS, MAX_COPIES, GROUP = (5, 2, 1), 3, 128
SPACES = " \t\n\x0b\f\r"
EPS = 1e-12  # fractions this near to 0 or 1 are whole (rounding of doubles)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``sizes(source, source_size)`` -> with ``target``.  Sources by code point,
    null last, weigh ``weights`` in turn and share the sum of all sizes; a target
    stops at ``max_copies`` times its source's size, and the excess is shared
    again by weight until none is above.  One small job for each sharing."""
    order = F.col("source").asc_nulls_last()
    # position of each source: rank inside a range partition plus what lies before it
    local = written(sizes.repartitionByRange(order).sortWithinPartitions(order)
                    .withColumn("pid", F.spark_partition_id())
                    .withColumn("at", F.monotonically_increasing_id() % F.lit(2**33)), "sources")
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = (local.groupBy("pid").count()
              .withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count"))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                          ((F.col("at") + F.col("start")) % len(weights) + 1).cast("int"))
    src = written(local.join(starts, "pid").withColumn("weight", weight).drop("pid", "at", "start"), "weights")
    total = src.agg(F.sum("source_size")).first()[0] or 0
    most = F.col("source_size") * max_copies
    share, capped = F.lit(0.0), F.lit(False)
    while True:
        r = src.agg(F.sum(F.when(~capped, F.col("weight"))), F.sum(F.when(capped, most)),
                    F.count(F.when(capped, 1))).first()
        if not r[0]:
            break
        share = F.lit(float(total - (r[1] or 0))) * F.col("weight") / F.lit(float(r[0]))
        now = capped | (share > most)
        if src.where(now).count() == r[2]:
            break
        capped = now
    return src.select("source", "source_size",
                      F.when(capped, most.cast("double")).otherwise(share).alias("target"))


def _step(a: Column, x: Column) -> Column:
    """One pair: the open document ``a`` against the next one ``x``."""
    def state(i: Column, p: Column, s: Column, done: Column) -> Column:
        return F.struct(i.cast("int").alias("i"), p.cast("double").alias("p"),
                        s.cast("double").alias("s"), done.alias("done"))

    def whole(i: Column, take) -> Column:
        return F.array(F.struct(i.cast("int").alias("i"), F.lit(take).cast("int").alias("take")))

    def settle(i: Column, p: Column, s: Column, done: Column) -> Column:
        none = F.lit(-1), F.lit(0.0), F.lit(0.0)
        return (F.when(p <= EPS, state(*none, F.concat(done, whole(i, 0))))
                .when(p >= 1 - EPS, state(*none, F.concat(done, whole(i, 1))))
                .otherwise(state(i, p, s, done)))

    def pair(m: Column) -> Column:
        rise = (x["u"] * (m["up"] + m["down"])) < m["down"]
        a_full = (1 - a["p"]) * a["s"] <= x["p"] * x["s"]
        a_void = a["p"] * a["s"] <= (1 - x["p"]) * x["s"]
        return (F.when(rise & a_full, settle(x["i"], x["p"] - m["up"] / x["s"], x["s"],
                                             F.concat(a["done"], whole(a["i"], 1))))
                .when(rise, settle(a["i"], a["p"] + m["up"] / a["s"], a["s"],
                                   F.concat(a["done"], whole(x["i"], 0))))
                .when(a_void, settle(x["i"], x["p"] + m["down"] / x["s"], x["s"],
                                     F.concat(a["done"], whole(a["i"], 0))))
                .otherwise(settle(a["i"], a["p"] - m["down"] / a["s"], a["s"],
                                  F.concat(a["done"], whole(x["i"], 1)))))

    moves = F.struct(F.least((1 - a["p"]) * a["s"], x["p"] * x["s"]).alias("up"),
                     F.least(a["p"] * a["s"], (1 - x["p"]) * x["s"]).alias("down"))
    return F.when(a["i"] < 0, state(x["i"], x["p"], x["s"], a["done"])).otherwise(_let(moves, pair))


def _uniform(seed: int, level: int) -> Column:
    return F.pmod(F.xxhash64("u1", "u2", F.lit(seed), F.lit(level)), F.lit(2**53)).cast("double") / F.lit(float(2**53))


def _fold(units: DataFrame, group: int, seed: int, level: int) -> DataFrame:
    """Units (source, u1, u2, p, s, n: units of the source) -> the same units with
    ``take`` 0 or 1 where decided, null for the residual of each group (with its
    new p); n is then the number of groups."""
    groups = F.ceil(F.col("n") / group)
    dealt = units.withColumn("g", F.pmod(F.xxhash64("u1", "u2", F.lit(seed), F.lit(-1 - level)), groups))
    listed = dealt.groupBy("source", "g", groups.alias("n")).agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("s")).alias("neg"), "u1", "u2", "p", "s", _uniform(seed, level).alias("u")))).alias("all"))
    numbered = F.transform("all", lambda x, i: F.struct(
        i.alias("i"), x["p"].alias("p"), x["s"].alias("s"), x["u"].alias("u")))
    nothing = F.expr("named_struct('i', -1, 'p', 0D, 's', 0D, 'done', cast(array() as array<struct<i:int,take:int>>))")
    folded = listed.withColumn("r", F.aggregate(numbered, nothing, _step))
    left = F.when(F.col("r.i") >= 0, F.array(F.struct(F.col("r.i").alias("i"), F.lit(None).cast("int").alias("take"))))
    outcome = F.explode(F.concat(F.col("r.done"), F.coalesce(left, F.expr("cast(array() as array<struct<i:int,take:int>>)"))))
    rows = folded.select("source", "n", "all", "r.p", outcome.alias("o"))
    unit = F.col("all")[F.col("o.i")]
    return rows.select("source", "n", unit["u1"].alias("u1"), unit["u2"].alias("u2"), F.col("p").alias("p"),
                       unit["s"].alias("s"), F.col("o.take").alias("take"))


def pivotal_rounding(units: DataFrame, seed: int = 0, group: int = GROUP) -> DataFrame:
    """``units(source, u1, u2, p, s)``: 0 < p < 1, size s > 0, (u1, u2) unique ->
    ``(u1, u2, take)``, take 0 or 1 with expectation p, the sum of p * s of a
    source kept up to its last residual.  One job for each level of the tree."""
    counted = units.groupBy(F.col("source").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    largest = counted.agg(F.max("n")).first()[0] or 0
    level_units = units.join(counted, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    decided = units.select("u1", "u2", F.lit(0).alias("take")).limit(0)
    level = 0
    while largest > 0:
        step = written(_fold(level_units, group, seed, level), "pivot")
        decided = decided.unionByName(step.where("take is not null").select("u1", "u2", "take"))
        level_units = step.where("take is null").drop("take")
        level += 1
        if largest <= group:
            return decided.unionByName(level_units.select(
                "u1", "u2", (_uniform(seed, -level) < F.col("p")).cast("int").alias("take")))
        largest = -(-largest // group)
    return decided


def word_count(text: Column) -> Column:
    """Number of space words.  Every word becomes one letter, then the letters are
    counted: no string is made for a word."""
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_WORD, "w")
    return F.length(F.translate(letters, SPACES, "")).cast("long")


def mix(documents: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES,
        seed: int = 0, group: int = GROUP, result: str = "mix") -> DataFrame:
    """The rows of ``documents(doc_id, source, size, ...)`` with a struct
    ``result``: ``source_size``, ``target`` (both of the row's source),
    ``copies`` (0 to ``max_copies``) and ``taken`` (copies * size).

    A null source is a source of its own, last in the order; a null size is 0.
    Sizes that are all 0 have targets of 0.  Rows that agree in doc_id (null
    included), source and size share their extra copies, dealt out in the order
    of a hash of the whole row.  Other columns pass through, one named like
    ``result`` is replaced (names beginning with ``_m`` are reserved).  An empty
    table gives an empty result.
    """
    own = documents.drop(result)
    keyed = own.withColumns({
        "_m1": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)),
        "_m2": F.xxhash64("doc_id", "source", "size")})
    sized = keyed.groupBy("source", F.col("_m1").alias("u1"), F.col("_m2").alias("u2"),
                          F.coalesce("size", F.lit(0)).cast("long").alias("size")).agg(F.count(F.lit(1)).alias("rows"))
    targets = source_targets(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")),
                             weights, max_copies).withColumnRenamed("source", "of")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    mass = F.col("rows") * (F.col("ratio") - F.col("whole"))
    units = written(
        sized.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
        .withColumn("ratio", ratio).withColumn("whole", F.floor("ratio"))
        .withColumn("base", F.floor(mass + EPS)).withColumn("p", F.greatest(mass - F.col("base"), F.lit(0.0))), "units")
    open_units = units.where((F.col("p") > EPS) & (F.col("size") > 0)).select(
        "source", "u1", "u2", "p", F.col("size").cast("double").alias("s"))
    take = pivotal_rounding(open_units, seed, group)
    decided = units.join(take, ["u1", "u2"], "left").select(
        F.col("u1").alias("_m1"), F.col("u2").alias("_m2"), F.col("source_size").alias("_msize"),
        F.col("target").alias("_mtarget"), F.col("whole").alias("_mwhole"),
        (F.col("base") + F.coalesce("take", F.lit(0))).alias("_mextra"))
    # the turn among rows that agree; mostly there are none, and no row need be sorted
    turn = F.lit(1)
    if not units.where("rows > 1").isEmpty():
        turn = F.row_number().over(Window.partitionBy("_m1", "_m2").orderBy(F.xxhash64(*own.columns)))
    copies = (F.col("_mwhole") + (F.col("_mturn") <= F.col("_mextra")).cast("long")).cast("long")
    # hashed on the decisions' side, so that rows with whole texts are not sorted
    return (keyed.join(decided.hint("shuffle_hash"), ["_m1", "_m2"]).withColumn("_mturn", turn)
            .withColumn(result, F.struct(
                F.col("_msize").alias("source_size"), F.col("_mtarget").alias("target"), copies.alias("copies"),
                (copies * F.coalesce("size", F.lit(0)).cast("long")).alias("taken")))
            .select(*own.columns, result))
