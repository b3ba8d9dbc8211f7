"""Merkle manifest of a table: leaves per row, a tree of eights per group, a tree over the groups, proofs and their check.

A leaf is the hash of a row's fields, each written as its length in bytes, a colon and its value, or `-` where it is null.
Within a group the leaves stand in the order of their id (nulls first, equal ids by leaf); while several nodes remain, every
eight consecutive ones become their hash. The last node is the group's subroot; the subroots, in the order of the groups (null
first, then bytewise), are folded likewise into the root. Digests enter hashes as lower-case hexadecimal text.

The trees are cut into superblocks of `FAN ** block_levels` leaves. A first pass reduces each superblock to one node; the few
nodes above are joined level by level, which gives every superblock the outer nodes that its proofs need. Then leaves and outer
nodes are cogrouped by superblock: one call reduces the leaves, joins local and outer siblings into proofs, and folds each row's
checked leaf up to the root. No group, however large, meets in one task; a task holds one superblock.

Null fields, empty and long texts are fields like any other. Repeated rows are leaves of their own beside each other. A group of
one row has that leaf as subroot, a table of one group that subroot as root; a proof without siblings is empty. An empty table
gives no rows.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.shared import stored
from rollbook.scale import global_rank, keyed_join, segmented

FAN = 8
#: Levels that are reduced within a superblock; 8 ** 4 leaves are one group's rows at most.
BLOCK_LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<before string, after string>"


def written(column: str | Column) -> Column:
    """A field as it enters a leaf: byte length, colon and value, or `-` for null."""
    text = (F.col(f"`{column}`") if isinstance(column, str) else column).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*columns: str | Column) -> Column:
    """Hash of a row's fields, as lower-case hexadecimal text."""
    return F.sha2(F.concat(*map(written, columns)).cast("binary"), 256)


def hashed(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def runs(nodes: list[str]) -> list[list[str]]:
    return [nodes[i : i + FAN] for i in range(0, len(nodes), FAN)]


def reduced(leaves: list[str], levels: int | None) -> list[list[str]]:
    """All levels from the leaves up: a stated number of them, or until one node remains."""
    found = [leaves]
    while len(found[-1]) > 1 if levels is None else len(found) <= levels:
        found.append([hashed(*run) for run in runs(found[-1])])
    return found


def _block_tops(rows: pd.DataFrame, block_levels: int) -> pd.DataFrame:
    """The node of a superblock, as it is alone in its group and as it is among others."""
    leaves = rows.sort_values("place")["leaf"].tolist()
    first = rows.iloc[0]
    tops = {"alone": reduced(leaves, None)[-1][0], "among": reduced(leaves, block_levels)[-1][0]}
    return pd.DataFrame([{"part": first["part"], "block": first["block"], **tops}])


def folded(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roots (part, root) and paths (part, at, path) of the trees over `nodes` (part, at, node), `at` from 0 in each part.

    A path is the list of (siblings before, siblings after) from the node up. Each level has an eighth of the rows of the one
    below; every run of it is one row of at most eight nodes.
    """
    level = stored(nodes, "tree-level")
    most = level.agg(F.max("at")).first()[0]
    below, done = [], []
    while True:
        size = level.groupBy("part").agg(F.max("at").alias("last"))
        done.append(level.join(size.where(F.col("last") == 0).select("part"), "part", "left_semi").select("part", F.col("node").alias("root")))
        if not most:
            break
        grouped = level.join(size.where(F.col("last") > 0).select("part"), "part", "left_semi").groupBy("part", F.expr(f"at div {FAN}").alias("run"))
        run = stored(grouped.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda n: n["node"]).alias("nodes")), "tree-runs")
        below.append(run)
        level = stored(run.select("part", F.col("run").alias("at"), F.sha2(F.concat_ws("", "nodes").cast("binary"), 256).alias("node")), "tree-level")
        most //= FAN
    roots = done[0]
    for more in done[1:]:
        roots = roots.unionByName(more)
    roots = stored(roots, "tree-roots")
    paths = roots.select("part", F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as array<{STEP}>)").alias("path"))
    for run in reversed(below):
        steps = F.transform("nodes", lambda n, i: F.struct(
            (F.col("run") * FAN + i).alias("at"),
            F.struct(F.array_join(F.slice("nodes", F.lit(1), i), "").alias("before"), F.array_join(F.slice("nodes", i + 2, F.lit(FAN)), "").alias("after")).alias("step"),
        ))
        spread = run.select("part", "run", F.explode(steps).alias("s"))
        above = paths.withColumnsRenamed({"at": "run", "path": "upper"})
        met = spread.join(above, ["part", "run"]).select("part", F.col("s.at").alias("at"), F.concat(F.array("s.step"), "upper").alias("path"))
        # parts whose tree ends at this level's nodes have their path already
        alone = paths.where(F.col("at") == 0).join(run.select("part").distinct(), "part", "left_anti")
        paths = stored(met.unionByName(alone), "tree-paths")
    return roots, paths


def _finish(rows: pd.DataFrame, outer: pd.DataFrame, block_levels: int, proofs: bool) -> pd.DataFrame:
    """Local reduction, proofs and folding of one superblock."""
    rows = rows.sort_values("place")
    above = outer.iloc[0]
    levels = reduced(rows["leaf"].tolist(), None if above["only"] else block_levels)
    path = [(step["before"], step["after"]) for step in above["path"]]
    # from the top down: each node's steps, and the text of all siblings from it upwards
    steps, texts = [path], ["".join(before + after for before, after in path)]
    for nodes in reversed(levels[:-1]):
        fresh = [("".join(run[:i]), "".join(run[i + 1 :])) for run in runs(nodes) for i in range(len(run))]
        texts = [before + after + texts[n // FAN] for n, (before, after) in enumerate(fresh)]
        steps = [[step, *steps[n // FAN]] for n, step in enumerate(fresh)]
    tops = []
    for node, own in zip(rows["checked"], steps, strict=True):
        for before, after in own:
            node = hashed(before, node, after)
        tops.append(node)
    out = rows[["id", "leaf"]].assign(subroot=above["subroot"], root=above["root"])
    out["proof_sha256"] = [hashed(t) for t in texts]
    out["folded_root"] = tops
    out["verified"] = out["folded_root"] == out["root"]
    if proofs:
        out["proof"] = [[{"before": b, "after": a} for b, a in own] for own in steps]
    return out


def manifest(
    docs: DataFrame,
    checked: Column | None = None,
    id_column: str = "doc_id",
    group_column: str = "lang",
    fields: tuple[str, ...] = FIELDS,
    proofs: bool = False,
    block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """Per row: id, leaf, subroot, root, proof_sha256, folded_root and verified; with `proofs` also the proof itself, a list of
    (siblings before, siblings after) from the leaf up.

    `checked` is the leaf to be folded along the proof (the row's own where null or not given): verified says whether it leads to
    the root. Only hashes are shuffled, never the fields.
    """
    part = F.coalesce(F.concat(F.lit("="), F.col(f"`{group_column}`").cast("string")), F.lit("-"))
    other = F.lit(None).cast("string") if checked is None else checked
    base = stored(docs.select(part.alias("part"), F.col(f"`{id_column}`").alias("id"), leaf_of(*fields).alias("leaf"), other.alias("checked")), "leaves")
    ranked = segmented(base, ["part"], [F.asc("id"), F.asc("leaf"), F.asc("checked")], "place")
    placed = ranked.select("part", F.expr(f"(place - 1) div {FAN**block_levels}").alias("block"), "place", F.col("id").cast("string").alias("id"), "leaf", F.coalesce("checked", "leaf").alias("checked"))
    placed = stored(placed, "placed")

    tops = placed.select("part", "block", "place", "leaf").groupBy("part", "block").applyInPandas(lambda rows: _block_tops(rows, block_levels), "part string, block long, alone string, among string")
    tops = stored(tops, "block-tops")
    blocks = tops.groupBy("part").agg((F.max("block") == 0).alias("only"))
    nodes = tops.join(blocks, "part").select("part", F.col("block").alias("at"), F.when(F.col("only"), F.col("alone")).otherwise(F.col("among")).alias("node"))
    subroots, inner = folded(nodes)
    order = global_rank(subroots, [F.asc("part")], "number").select("part", F.col("root").alias("subroot"), (F.col("number") - 1).alias("at"))
    order = stored(order, "subroots")
    roots, upper = folded(order.select(F.lit("").alias("part"), "at", F.col("subroot").alias("node")))
    root = next((r.root for r in roots.collect()), None)  # one row, none for an empty table
    crowns = order.join(upper.select("at", F.col("path").alias("crown")), "at").join(blocks, "part").select("part", "subroot", "only", "crown")
    outer = keyed_join(inner.withColumnRenamed("at", "block"), crowns, ["part"], "inner")
    outer = outer.select("part", "block", "only", "subroot", F.lit(root).cast("string").alias("root"), F.concat("path", "crown").alias("path"))

    schema = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    schema += f", proof array<{STEP}>" if proofs else ""
    both = placed.groupBy("part", "block").cogroup(outer.groupBy("part", "block"))
    found = both.applyInPandas(lambda rows, above: _finish(rows, above, block_levels, proofs), schema)
    return found.withColumn("id", F.col("id").cast(base.schema["id"].dataType))
