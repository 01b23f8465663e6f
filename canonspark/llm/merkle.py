"""Merkle manifest of a dataset, and proofs climbed by a recursive query.

1. *Leaves.*  Every row is hashed field by field; rows are numbered within
   their group by key (distributed, a hot group is never one task).
2. *Levels.*  Eight consecutive nodes become their parent, level by level, one
   grouped aggregation each; a group's last node is its subroot.  Subroots,
   ordered by group, are built up to the root in the same way.  All nodes are
   stored as rows that name their parent and their place in it.
3. *Climb.*  A recursive query starts at every run of leaves and joins the
   parent's row until there is none.  Each step appends the siblings and folds
   every leaf's own hash.  The leaves of a run share all siblings but the first
   ones, so they climb in one row, each with a fold of its own.

A hash is the SHA-256 of its inputs as lower-case hex text, put together.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canonspark.llm.textops import written
from canonspark.operators.rank import row_number_within

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = ""  # the tree over the subroots; a group's tree begins with 0 (null) or 1
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


class Manifest(NamedTuple):
    runs: DataFrame   # tree, run, members array<struct<at, key, leaf, claim>>, link
    nodes: DataFrame  # tree, level, pos, hash, children, top, link (parent's tree, level, pos and place in it)
    root: str | None  # None for an empty table


def row_hash(fields: list[Column]) -> Column:
    """Hash of a row: each field ``-`` if null, else its bytes, ``:``, its value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def _joined(hashes: Column) -> Column:
    return F.unhex(F.sha2(F.concat_ws("", F.transform(hashes, lambda h: F.lower(F.hex(h)))), 256))


def _levels(members: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Node rows of each level and the top node of each tree, from the runs of the
    lowest level ``(tree, pos, children)``.  Position 0 with one child means that the
    level below has one node: the tree ends there."""
    nodes, tops, level = [], [], 0
    alone = (F.col("pos") == 0) & (F.size("children") == 1)
    while True:
        tops.append(members.where(alone).select("tree", F.lit(level).alias("level"), F.col("children")[0].alias("hash")))
        level += 1
        up = written(members.where(~alone).select(
            "tree", F.lit(level).alias("level"), "pos", _joined(F.col("children")).alias("hash"), "children"), "level")
        if up.isEmpty():
            return nodes, tops
        nodes.append(up)
        members = up.groupBy("tree", F.expr(f"pos div {ARITY}").alias("pos")).agg(
            F.sort_array(F.collect_list(F.struct(F.pmod("pos", F.lit(ARITY)).alias("at"), "hash")))["hash"]
            .alias("children"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_LINK = "struct<tree:string,level:int,pos:bigint,at:int>"


def _link(tree, level, pos) -> Column:
    return F.struct(tree, level.cast("int").alias("level"), F.expr(f"{pos} div {ARITY}").alias("pos"),
                    F.expr(f"cast({pos} % {ARITY} as int)").alias("at"))


def build(documents: DataFrame, key: str = "doc_id", group: str = "lang", fields=FIELDS,
          claim: Column | None = None) -> Manifest:
    """Manifest of the rows of ``documents``.  ``claim`` is the hash that each row
    is later checked with (its own by default).

    Rows ascend by key (null first), then by hash, so repeated rows and keys have a
    defined place; a null group is a group of its own and comes first.  Null fields
    and empty texts have different hashes.  Other columns take no part.  An empty
    table has no runs, no nodes and no root.
    """
    leaf = row_hash([F.col(f) for f in fields])
    tree = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    rows = documents.select(tree.alias("tree"), F.col(key).alias("key"), F.unhex(leaf).alias("leaf"),
                            F.unhex(leaf if claim is None else claim).alias("claim"))
    placed = row_number_within(rows, ["tree"], ["key", "leaf"], "pos", start=0)
    member = F.struct(F.expr(f"cast(pos % {ARITY} as int)").alias("at"), "key", "leaf", "claim")
    runs = written(placed.groupBy("tree", F.expr(f"pos div {ARITY}").alias("pos"))
                   .agg(F.sort_array(F.collect_list(member)).alias("members")), "runs")
    lower, tops = _levels(runs.select("tree", "pos", F.col("members.leaf").alias("children")))
    subroots = written(row_number_within(_union(tops).withColumn("all", F.lit(0)), ["all"], ["tree"], "place", start=0),
                       "subroots")
    upper, ends = _levels(subroots.groupBy(F.lit(TOP).alias("tree"), F.expr(f"place div {ARITY}").alias("pos")).agg(
        F.sort_array(F.collect_list(F.struct("place", "hash")))["hash"].alias("children")))
    end = _union(ends).select("hash", "level").collect()  # one row
    height = end[0]["level"] if end else 0
    # a subroot's parent is in the top tree, unless it is the root itself
    over = subroots.select("tree", "level", F.lit(0).cast("long").alias("pos"), F.lit(True).alias("top"),
                           (_link(F.lit(TOP).alias("tree"), F.lit(1), "place") if height else F.lit(None).cast(_LINK))
                           .alias("over"))
    inside = _link(F.col("tree"), F.col("level") + 1, "pos")
    nodes = None
    if lower:
        nodes = (_union(lower).join(over, ["tree", "level", "pos"], "left")
                 .withColumn("link", F.when(F.col("top"), F.col("over")).otherwise(inside)))
    if upper:
        up = _union(upper).withColumns({"top": F.lit(False), "link": F.when(F.col("level") < height, inside)})
        nodes = nodes.unionByName(up, allowMissingColumns=True) if nodes is not None else up
    schema = "tree string, level int, pos long, hash binary, children array<binary>, top boolean, link " + _LINK
    if nodes is None:
        nodes = documents.sparkSession.createDataFrame([], schema)
    nodes = written(nodes.select("tree", "level", "pos", "hash", "children",
                                 F.coalesce("top", F.lit(False)).alias("top"), "link"), "nodes")
    # a run's link names its own node; that of a lone leaf is its subroot's
    first = F.struct("tree", F.lit(1).alias("level"), "pos", F.lit(None).cast("int").alias("at"))
    lone = over.where("level = 0").select("tree", "pos", "top", "over")
    linked = runs.join(lone, ["tree", "pos"], "left").select(
        "tree", F.col("pos").alias("run"), "members", F.when(F.col("top"), F.col("over")).otherwise(first).alias("link"),
        F.when(F.col("top"), F.col("members.leaf")[0]).alias("subroot"))
    return Manifest(written(linked, "linked"), nodes, bytes(end[0]["hash"]).hex() if end else None)


CLIMB = f"""
with recursive climb as (
  select tree, run, transform(members, m -> named_struct('at', m.at, 'fold', m.claim)) as members,
         cast(array() as array<binary>) as siblings, subroot, link
  from {{runs}}
  union all
  select c.tree, c.run,
         transform(c.members, m -> named_struct('at', m.at, 'fold', unhex(sha2(concat_ws('',
           transform(n.children, (h, j) -> lower(hex(if(j = coalesce(c.link.at, m.at), m.fold, h))))), 256)))),
         if(c.link.at is null, c.siblings, concat(c.siblings, filter(n.children, (h, j) -> j <> c.link.at))),
         if(n.top, n.hash, c.subroot), n.link
  from climb c join {{nodes}} n
    on n.tree = c.link.tree and n.level = c.link.level and n.pos = c.link.pos)
select tree, run, members.fold as folds, siblings, subroot from climb where link is null
"""


def verify(manifest: Manifest) -> DataFrame:
    """Every row's ``key, leaf, subroot, root`` as built, ``proof`` (the hash over its
    siblings, level by level up to the root, left to right), ``folded_root``
    (climbed from its claim) and ``verified``.  Siblings are those of the build, so
    a row's claim doesn't touch other rows' proofs."""
    spark = manifest.runs.sparkSession
    before = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")  # a row for each run and level
    try:
        climbed = written(spark.sql(CLIMB, runs=manifest.runs, nodes=manifest.nodes), "climbed")
    finally:
        spark.conf.set(ROW_LIMIT, before)
    leaves = F.col("members.leaf")
    each = F.transform("members", lambda m: F.struct(
        m["key"].alias("key"), m["leaf"].alias("leaf"), F.get("folds", m["at"]).alias("fold"),
        _joined(F.concat(F.filter(leaves, lambda h, j: j != m["at"]), F.col("siblings"))).alias("proof")))
    r = (manifest.runs.drop("subroot", "link").join(climbed, ["tree", "run"])
         .select(F.explode(each).alias("m"), "subroot"))
    text = {c: F.lower(F.hex(F.col(f"m.{c}"))) for c in ("leaf", "fold", "proof")}
    root = F.lit(manifest.root).cast("string")
    return r.select(F.col("m.key").alias("key"), text["leaf"].alias("leaf"), F.lower(F.hex("subroot")).alias("subroot"),
                    root.alias("root"), text["proof"].alias("proof"), text["fold"].alias("folded_root"),
                    (text["fold"] == root).alias("verified"))
