"""Merkle dataset manifest: one hash for a table, with a proof for every row.

A row is a leaf; the leaves of one source make a tree of fanout ``FANOUT``, and
the roots of the sources make one more tree.  Everything is DataFrame
expressions:

1. Leaves are hashed in one pass over the text and written; their places in a
   source come from a range-partitioned sort (``dense_positions``), so a source
   that holds a third of all rows is spread like any other.
2. Slot pivot, level by level: rows are grouped by (source, place div FANOUT),
   and one conditional aggregate per slot spreads the children of a parent into
   FANOUT columns.  Their concatenation is hashed to the parent.  Each pivot is
   written once; a level has a third of the rows of the level below.
3. Top down, every parent row opens its slots again: the columns left and right
   of a slot are its siblings, and they go in front of the parent's own path.
   A path has one (left, right) pair per level up to the root.

Nothing is gathered: a group never has more than FANOUT rows, and the driver
sees the size of the largest source and nothing else.

Inputs of a leaf are ``doc_id, source, lang, n_chars, text``; other columns are
ignored.  Nulls hash as ``-``.  Rows that repeat an id follow each other by leaf
hash and each get a row of the result; null ids come first; an empty table has
no rows and no root.  Columns missing from the table count as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotsmith.llm.common import write_once
from shotsmith.operators.positions import dense_positions

FANOUT = 3
CHUNK = 1 << 12         # places of a source in one join key
INPUTS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:``, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(text: Column) -> Column:
    """Hash of a row whose text is ``text``."""
    return digest(*[field(text if c == "text" else F.col(c)) for c in INPUTS])


def tampered_rows(id_col: str = "doc_id") -> Column:
    """Rows whose text the check alters: even crc32 of the decimal id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 2 == 0, F.lit(False))


def _slots(make) -> list[Column]:
    return [make(i) for i in range(FANOUT)]


def _levels(size: int) -> int:
    """Levels of hashing above the leaves of a group of ``size``."""
    n = 0
    while size > 1:
        size, n = -(-size // FANOUT), n + 1
    return n


def build(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Trees over ``nodes`` (grp, pos, node, size[, row]): the pivots, lowest first,
    and (grp, top, height) of every tree.  ``row`` is carried in the lowest pivot."""
    height = _levels(nodes.agg(F.max("size")).first()[0] or 0)
    pivots, done = [], []
    level = nodes
    for h in range(height + 1):
        done.append(level.where("size = 1").select("grp", F.col("node").alias("top"),
                                                   F.lit(h).alias("height")))
        if h == height:
            break
        carried = [c for c in ("node", "row") if c in level.columns]
        slot = F.pmod("pos", F.lit(FANOUT))
        pivot = write_once(
            level.where("size > 1").groupBy("grp", F.floor(F.col("pos") / FANOUT).alias("pos")).agg(
                F.max("size").alias("below"),
                *_slots(lambda i: F.max(F.when(slot == i, F.struct(*carried))).alias(f"c{i}"))),
            f"{name}{h}")
        pivots.append(pivot)
        level = pivot.select(
            "grp", "pos", digest(*_slots(lambda i: F.coalesce(F.col(f"c{i}.node"), F.lit("")))).alias("node"),
            F.ceil(F.col("below") / FANOUT).alias("size"))
    tops = done[0]
    for part in done[1:]:
        tops = tops.unionByName(part)
    return pivots, write_once(tops, f"{name}-tops")


def open_slots(pivots: list[DataFrame], tops: DataFrame, keep: tuple[str, ...]) -> list[DataFrame]:
    """(grp, pos, node, [row], path, ``keep``) of the lowest nodes that have a parent.

    ``tops`` (grp, height, path, ``keep``) are the tree tops with their paths.
    Each level joins its parents' paths to the pivot and opens the slots."""
    above = None
    for h in range(len(pivots) - 1, -1, -1):
        here = tops.where(F.col("height") == h + 1).select(
            "grp", F.lit(0).cast("bigint").alias("pos"), "path", *keep)
        if above is not None:
            here = here.unionByName(above.select("grp", "pos", "path", *keep))
        text = lambda i: F.coalesce(F.col(f"c{i}.node"), F.lit(""))

        def child(i):
            left = F.concat(F.lit(""), *[text(j) for j in range(i)])
            right = F.concat(F.lit(""), *[text(j) for j in range(i + 1, FANOUT)])
            return F.struct((F.col("pos") * FANOUT + i).alias("pos"), F.col(f"c{i}").alias("c"),
                            left.alias("left"), right.alias("right"))

        opened = (pivots[h].join(here, ["grp", "pos"])
                  .select("grp", "path", *keep, F.explode(F.array(*_slots(child))).alias("s"))
                  .where("s.c IS NOT NULL"))
        row = ["row"] if h == 0 and "row" in pivots[h].schema["c0"].dataType.names else []
        above = opened.select(
            "grp", "s.pos", "s.c.node", *[F.col(f"s.c.{r}").alias(r) for r in row], *keep,
            F.concat(F.array(F.struct("s.left", "s.right")), "path").alias("path"))
    return [] if above is None else [above]


def fold(start: Column, path: Column) -> Column:
    """The root that ``start`` leads to along its siblings."""
    return F.aggregate(path, start, lambda acc, s: digest(s["left"], acc, s["right"]))


def siblings(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(docs: DataFrame, altered_text: Column | None = None,
             altered: Column | None = None) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, path, altered_leaf) of every row.

    ``altered_leaf`` is the leaf of the row with ``altered_text`` where
    ``altered`` holds, else the leaf itself: what a later check would find."""
    text = F.col("text")
    docs = docs.select(*[F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in INPUTS])
    other = text if altered is None else F.when(altered, altered_text).otherwise(text)
    leaves = write_once(docs.select(
        # null sorts before every source, and the grouping key itself is never null
        F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0")).alias("grp"), "doc_id",
        leaf(text).alias("leaf"),
        F.when(other.eqNullSafe(text), F.lit(None)).otherwise(leaf(other)).alias("other")), "leaves")
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("other")]
    placed = write_once(dense_positions(leaves, order, ["grp"], ["doc_id", "leaf", "other"]), "placed")
    # sizes meet the rows by source and run of CHUNK places: no key holds more rows
    run = F.floor(F.col("pos") / CHUNK)
    sizes = placed.groupBy("grp").agg(F.count("*").alias("size")).withColumn(
        "run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("size") - 1) / CHUNK))))
    nodes = placed.withColumn("run", run).join(sizes, ["grp", "run"]).select(
        "grp", "pos", F.col("leaf").alias("node"), "size", F.struct("doc_id", "other").alias("row"))
    pivots, tops = build(nodes, "tree")

    # the tree over the sources: one group, places by source
    named = dense_positions(tops, [F.col("grp")], keep=["grp", "top", "height"])
    n = named.count()
    upper, roots = build(named.select(
        F.lit("").alias("grp"), "pos", F.col("top").alias("node"), F.lit(n).cast("bigint").alias("size"),
        F.struct(F.col("grp").alias("source_key"), "height").alias("row")), "roots")
    none = F.array().cast(PATH)
    start = roots.select("grp", "height", F.col("top").alias("root"), none.alias("path"))
    parts = open_slots(upper, start, ("root",))
    if parts:
        chains = parts[0].select(F.col("row.source_key").alias("grp"), F.col("row.height").alias("height"),
                                 F.col("node").alias("subroot"), "root", "path")
    else:       # no source, or a single one: its root is the root
        chains = tops.select("grp", "height", F.col("top").alias("subroot"), F.col("top").alias("root"),
                             none.alias("path"))
    chains = write_once(chains, "chains")
    keep = ("subroot", "root")
    lone = nodes.where("size = 1").drop("size", "pos").join(chains.drop("height"), "grp")
    out = lone.select("grp", "row", F.col("node").alias("leaf"), "path", *keep)
    for part in open_slots(pivots, chains, keep):
        out = out.unionByName(part.select("grp", "row", F.col("node").alias("leaf"), "path", *keep))
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        F.when(F.col("grp") != "0", F.expr("substring(grp, 2)")).alias("source"),
        "leaf", "subroot", "root", "path", F.coalesce("row.other", "leaf").alias("altered_leaf"))


def verify(docs: DataFrame) -> DataFrame:
    """The manifest checked against a copy of the table in which the line breaks
    of every second text (``tampered_rows``) are gone."""
    rows = manifest(docs, F.replace(F.col("text"), F.lit("\n"), F.lit("")), tampered_rows())
    folded = fold(F.col("altered_leaf"), F.col("path")).alias("folded_root")
    return rows.select("doc_id", "leaf", "subroot", "root",
                       F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
