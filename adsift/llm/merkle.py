"""Merkle manifest of a dataset, and proofs by a recursive query.

The leaves of each group stand in key order; every ``RUN`` neighbours of a level become
one node above them, up to the group's subroot, and the subroots, in group order, go on
to the root.  Levels are built bottom up, ``HOP`` of them by one grouping, and kept as node
rows that are linked to the node ``HOP`` levels above and hold the hashes left and right of
their way on each level in between.  A recursive query then climbs from every leaf: each
step joins the node row, notes its siblings and folds the leaf's hash as it is found now
with them.  What the top of the climb holds is the root, unless the leaf was changed.

Each step moves one row a leaf; siblings are noted step by step and strung together at
the end, so no row grows while it climbs.  All leaves pass the nodes near the root: a
node with many leaves is kept in as many salted copies, and each leaf asks for one of
them, so no key holds more than a thousandth of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adsift.llm.common import own_columns, stage
from adsift.operators.ordered import running_totals

#: Nodes of a level that become one node above.
RUN = 3
#: Levels that a grouping builds and a step of the climb ascends.
HOP = 4
#: A key of the climb holds the rows of about one leaf in so many.
SHARES = 1024
# A node's id: its first leaf (or place) times _CODES, plus the hops below it; those above
# the subroots start at _TOP.
_CODES, _TOP = 128, 64
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


@dataclass
class Manifest:
    """``nodes``: ``(id, salt, up, up_salts, steps, subroot)``, ``steps`` with the siblings
    ``(before, after)`` of each level as bytes, ``subroot`` for the top node of a group only.
    ``leaves``: ``(id, key, leaf, now, up, up_salts, steps)``, the last three null for a group's
    only leaf.  ``root`` is null for an empty table."""

    nodes: DataFrame
    leaves: DataFrame
    root: str | None


def hashed(values: list[Column]) -> Column:
    """H of values: ``-`` for null, else byte count, colon and value."""
    parts = []
    for value in values:
        text = value.cast("string")
        counted = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
        parts.append(F.coalesce(counted, F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _placed(leaves: DataFrame) -> DataFrame:
    """Leaves ``(group, key, leaf, now)`` with the first place of their group in the
    order of all leaves (``tree``), the group's size ``m`` and their place ``p`` in it.

    Leaves are dealt to ranges of the order.  A group is numbered within its range; only
    groups that reach over a range's end need counts of other ranges, at most two rows for
    each range, whatever the number of groups.
    """
    order = [F.col("group"), F.col("key"), F.col("leaf"), F.col("now")]
    ranged = stage(
        leaves.repartitionByRange(*order).withColumn("range", F.spark_partition_id()),
        "merkle-ranges",
    )
    counts = ranged.groupBy("range", "group").agg(F.count(F.lit(1)).alias("n"))
    # One row for each range.
    starts, before = [], 0
    for r in sorted(counts.groupBy("range").agg(F.sum("n").alias("n")).collect()):
        starts.append((r["range"], before))
        before += r["n"]
    starts = leaves.sparkSession.createDataFrame(starts, "range int, start long")
    own = Window.partitionBy("group")
    upto = own.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        counts.withColumns(
            {
                "ranges": F.count(F.lit(1)).over(own),
                "total": F.sum("n").over(own),
                "before": F.coalesce(F.sum("n").over(upto), F.lit(0)),
            }
        )
        .where("ranges > 1")
        .select(F.col("range").alias("_range"), F.col("group").alias("_group"), "total", "before")
    )
    here = Window.partitionBy("range")
    ours = Window.partitionBy("range", "group")
    rows = ranged.withColumns(
        {
            "place": F.row_number().over(here.orderBy(*order)),
            "in_group": F.row_number().over(ours.orderBy(*order[1:])),
            "here": F.count(F.lit(1)).over(ours),
        }
    )
    rows = rows.join(F.broadcast(starts), "range").join(
        F.broadcast(spans),
        (F.col("range") == F.col("_range")) & F.col("group").eqNullSafe(F.col("_group")),
        "left",
    )
    p = F.coalesce("before", F.lit(0)) + F.col("in_group") - 1
    return rows.select(
        (F.col("start") + F.col("place") - 1 - p).alias("tree"),
        F.coalesce("total", "here").alias("m"),
        p.alias("p"),
        "key",
        "leaf",
        "now",
    )


def _hops(m: int) -> int:
    """Hops from ``m`` nodes to the top."""
    hops = 0
    while m > 1:
        m, hops = -(-m // RUN**HOP), hops + 1
    return hops


def _raised(hashes: Column) -> Column:
    """The hashes a level above, all within one run of the hop."""
    runs = F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / RUN).cast("int"))
    return F.transform(
        runs, lambda i: F.sha2(F.array_join(F.slice(hashes, i * RUN + 1, F.lit(RUN)), ""), 256)
    )


def _runs(level: DataFrame, k: int, top: bool, with_leaves: bool = False) -> DataFrame:
    """The nodes a hop above a level, with the nodes below as ``kids`` and the hashes of the
    levels in between; a tree that ends within the hop takes ``levels`` of it only."""
    width = RUN**HOP
    columns = ["p", "id", "leaves", "h", *(["key", "now"] if with_leaves else [])]
    runs = (
        level.where("m > 1")
        .groupBy("tree", "m", F.expr(f"p div {width}").alias("q"))
        .agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("kids"))
        .withColumn("h0", F.transform("kids", lambda x: x["h"]))
    )
    for j in range(HOP):
        runs = runs.withColumn(f"h{j + 1}", _raised(F.col(f"h{j}")))
    levels = sum(((F.col("m") > RUN**j).cast("int") for j in range(1, HOP)), F.lit(1))
    tops = F.array(*[F.col(f"h{j + 1}")[0] for j in range(HOP)])
    first = F.col("q") if top else F.col("tree") + F.col("q") * width ** (k + 1)
    return runs.select(
        (first * _CODES + (_TOP if top else 0) + k + 1).alias("id"),
        "tree",
        F.expr(f"(m + {width - 1}) div {width}").alias("m"),
        F.col("q").alias("p"),
        F.aggregate("kids", F.lit(0).cast("long"), lambda n, x: n + x["leaves"]).alias("leaves"),
        F.element_at(tops, levels).alias("h"),
        levels.alias("levels"),
        "kids",
        *[f"h{j}" for j in range(1, HOP)],
    )


def _salts(leaves: Column, share: int) -> Column:
    return F.ceil(leaves / share).cast("int")


def _children(runs: DataFrame, share: int) -> DataFrame:
    """A row for each node below the runs: where its hop ends and the siblings on its way."""
    levels = [f"h{j}" for j in range(1, HOP)]
    rows = runs.select(
        F.col("id").alias("up"),
        _salts(F.col("leaves"), share).alias("up_salts"),
        "levels",
        F.transform("kids", lambda x: x["h"]).alias("h0"),
        *levels,
        F.posexplode("kids").alias("i", "kid"),
    )
    joined = lambda part: F.unhex(F.array_join(part, ""))
    steps = []
    for j in range(HOP):
        place = F.floor(F.col("i") / RUN**j).cast("int")
        in_run = place % RUN
        before = F.slice(f"h{j}", place - in_run + 1, in_run)
        after = F.slice(f"h{j}", place + 2, RUN - 1 - in_run)
        steps.append(F.struct(joined(before).alias("before"), joined(after).alias("after")))
    return rows.select(
        "kid", "up", "up_salts", F.slice(F.array(*steps), F.lit(1), F.col("levels")).alias("steps")
    )


def _node_rows(children: DataFrame, share: int, subroots: bool) -> DataFrame:
    kid = F.col("kid")
    last = _salts(kid["leaves"], share) - 1
    return children.select(
        kid["id"].alias("id"),
        F.explode(F.sequence(F.lit(0), last)).alias("salt"),
        "up",
        "up_salts",
        "steps",
        (F.unhex(kid["h"]) if subroots else F.lit(None).cast("binary")).alias("subroot"),
    )


def _union(tables: list[DataFrame]) -> DataFrame:
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    return whole


def build(leaves: DataFrame) -> Manifest:
    """The manifest of leaves ``(group, key, leaf, now)``, both hashes as hex.

    Groups go by their UTF-8 bytes, null first; keys ascend, null first, rows with equal
    keys by their hashes, so repeated rows are leaves of their own.  ``now`` is the
    leaf's hash as it is found at the time of the proof.
    """
    spark = leaves.sparkSession
    placed = stage(_placed(leaves), "merkle-placed")
    totals = placed.agg(F.count(F.lit(1)).alias("n"), F.max("m").alias("most")).first()
    share = max(1, totals["n"] // SHARES)
    one = F.lit(1).cast("long")
    level = placed.select(
        (F.col("tree") + F.col("p")).alias("place"), "tree", "m", "p", one.alias("leaves"),
        F.col("leaf").alias("h"), "key", "now",
    ).withColumn("id", F.col("place") * _CODES)
    alone = level.where("m = 1")
    kept = ["id", "tree", "m", "p", "leaves", "h"]
    own_rows = [
        alone.select(
            "id", "key", F.col("h").alias("leaf"), "now",
            *[F.lit(None).cast(t).alias(n) for n, t in _STEP.items()],
        )
    ]
    nodes, finished = [], [level.select(kept).where("m = 1")]
    for k in range(_hops(totals["most"] or 0)):
        runs = stage(_runs(level, k, top=False, with_leaves=k == 0), f"merkle-level-{k + 1}")
        children = _children(runs, share)
        if k == 0:
            kid = F.col("kid")
            own_rows.append(
                children.select(
                    kid["id"].alias("id"), kid["key"].alias("key"), kid["h"].alias("leaf"),
                    kid["now"].alias("now"), *_STEP,
                )
            )
        else:
            nodes.append(_node_rows(children, share, subroots=False))
        level = runs.select(kept)
        finished.append(level.where("m = 1"))
    # The subroots, in the order of their groups, are the leaves of the last tree.
    subroots = stage(_union(finished), "merkle-subroots")
    n_groups = subroots.count()
    level = running_totals(
        subroots.withColumn("one", one).drop("m", "p"), [F.col("tree")], {"p": "one"}
    ).select(
        "id", F.lit(0).cast("long").alias("tree"), F.lit(n_groups).cast("long").alias("m"),
        (F.col("p") - 1).alias("p"), "leaves", "h",
    )
    for k in range(_hops(n_groups)):
        runs = stage(_runs(level, k, top=True), f"merkle-top-{k + 1}")
        nodes.append(_node_rows(_children(runs, share), share, subroots=k == 0))
        level = runs.select(kept)
    root = level.select("h").first()
    empty = spark.createDataFrame(
        [], f"id long, salt int, up long, up_salts int, steps {_STEPS}, subroot binary"
    )
    return Manifest(
        stage(_union([empty, *nodes]), "merkle-nodes"), _union(own_rows), root and root["h"]
    )


_STEPS = "array<struct<before: binary, after: binary>>"
_STEP = {"up": "long", "up_salts": "int", "steps": _STEPS}
_FOLD = """aggregate({steps}, {start}, (h, s) ->
  unhex(sha2(lower(hex(concat(s.before, h, s.after))), 256)))"""
_STRING = "aggregate({steps}, X'', (b, s) -> concat(b, s.before, s.after))"

_CLIMB = f"""
WITH RECURSIVE climb(leaf_id, step, next, salt, folded, siblings, subroot, key, leaf) AS (
  SELECT * FROM {{start}}
  UNION ALL
  SELECT c.leaf_id, c.step + 1, n.up, CAST(pmod(hash(c.leaf_id), n.up_salts) AS INT),
         {_FOLD.format(steps="n.steps", start="c.folded")}, {_STRING.format(steps="n.steps")},
         n.subroot, CAST(NULL AS BIGINT), CAST(NULL AS BINARY)
  FROM climb c JOIN {{nodes}} n ON n.id = c.next AND n.salt = c.salt)
SELECT * FROM climb
"""


@contextmanager
def _unlimited_recursion(spark: SparkSession) -> Iterator[None]:
    """Spark ends a recursive query at a million rows, unless told otherwise."""
    before = spark.conf.get(_ROW_LIMIT, None)
    spark.conf.set(_ROW_LIMIT, "-1")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_ROW_LIMIT)
        else:
            spark.conf.set(_ROW_LIMIT, before)


def climb(manifest: Manifest) -> DataFrame:
    """``(leaf_id, step, next, salt, folded, siblings, subroot, key, leaf)``: a row for
    each leaf and hop; key and leaf are in its first row only."""
    stepped = F.col("up").isNotNull()
    steps = "coalesce(steps, array())"
    start = manifest.leaves.select(
        F.col("id").alias("leaf_id"),
        stepped.cast("int").alias("step"),
        F.coalesce("up", "id").alias("next"),
        F.coalesce(F.pmod(F.hash("id"), F.col("up_salts")), F.lit(0)).cast("int").alias("salt"),
        F.expr(_FOLD.format(steps=steps, start="unhex(now)")).alias("folded"),
        F.expr(_STRING.format(steps=steps)).alias("siblings"),
        F.lit(None).cast("binary").alias("subroot"),
        "key",
        F.unhex("leaf").alias("leaf"),
    )
    spark = manifest.nodes.sparkSession
    with _unlimited_recursion(spark):
        rows = spark.sql(_CLIMB, start=start, nodes=manifest.nodes)
        return stage(rows, "merkle-climb")


def proofs(manifest: Manifest) -> DataFrame:
    """``(key, leaf, subroot, root, proof_sha256, folded_root, verified)``, a row a leaf."""
    lower_hex = lambda c: F.lower(F.hex(c))
    steps = F.sort_array(F.collect_list(F.struct("step", "siblings", "folded")))
    found = (
        climb(manifest)
        .groupBy("leaf_id")
        .agg(
            steps.alias("steps"),
            F.max("subroot").alias("subroot"),
            F.max("key").alias("key"),
            F.max("leaf").alias("leaf"),
        )
    )
    root = F.lit(manifest.root).cast("string")
    siblings = F.array_join(F.transform("steps", lambda s: F.hex(s["siblings"])), "")
    return found.select(
        "key",
        lower_hex(F.col("leaf")).alias("leaf"),
        F.coalesce(lower_hex(F.col("subroot")), root).alias("subroot"),
        root.alias("root"),
        F.sha2(F.lower(siblings), 256).alias("proof_sha256"),
        lower_hex(F.element_at("steps", -1)["folded"]).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def document_leaves(docs: DataFrame, now: Column | None = None) -> DataFrame:
    """Documents as leaves: H of doc_id, source, lang, n_chars and text, grouped by source.

    ``now`` is the text as it is found at the proof, the text itself by default.
    Columns the table lacks count as null; further ones are not read.
    """
    own = own_columns(
        docs, doc_id="long", source="string", lang="string", n_chars="long", text="string"
    )
    head = [own[c] for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = hashed([*head, own["text"]])
    return docs.select(
        own["source"].alias("group"),
        own["doc_id"].alias("key"),
        leaf.alias("leaf"),
        (leaf if now is None else hashed([*head, now])).alias("now"),
    )


def without_breaks(docs: DataFrame) -> Column:
    """The tampering that the query looks for: where 2 divides the crc32 of the id, the
    text has lost its line breaks.  Rows without an id are left alone, null stays null."""
    own = own_columns(docs, doc_id="long", text="string")
    picked = F.crc32(own["doc_id"].cast("string")) % 2 == 0
    return F.when(picked, F.replace(own["text"], F.lit("\n"), F.lit(""))).otherwise(own["text"])


def prove_documents(docs: DataFrame) -> DataFrame:
    """Proofs of all documents, folded from their tampered texts.

    Null ids come first in their source, rows with equal ids go by their hashes, repeated
    rows are leaves of their own, a null text is hashed as ``-`` and an empty one as
    ``0:``.  A table with one row is its own root, with the hash of no sibling as proof;
    an empty table has no rows here.
    """
    manifest = build(document_leaves(docs, without_breaks(docs)))
    return proofs(manifest).select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )
