"""Merkle manifest of a dataset: leaves, subroots per group, one root, and a proof for every row.

*Leaves.* A row's leaf is the digest of its fields, each ``-`` if null, else byte count, ``:`` and value.

*Levels.* Nodes of a group are numbered 0, 1, 2, ... in order. On each level the nodes are windowed by
run (``FAN`` consecutive ones): fixed-offset lag and lead columns, masked by the node's slot and the run's
length, supply its siblings, and first children hash themselves with their leads to the parent. A group of one
node is done and passes through. The subroots are then the nodes of one more tree. A run is a
window's partition, so none holds more than ``FAN`` rows however large a group is; numbers of a group
are made over slices. Each level is a written table of an eighth of the rows of the one below.

*Proofs.* Siblings go down again, level by level, joined on the parent's number: a parent hands the
siblings on its way to the root to its children, which put their own in front. Digests of texts travel,
never texts.

Rows of equal id are ordered by their leaves; rows without id come first in their group; equal rows are leaves of
their own. The null group comes before all others and differs from the empty one. Empty tables
have no root and stay empty. Columns other than the named fields are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchpulse.operators.slices import SLICE, row_numbers, sliced
from matchpulse.sources.staging import staged

FAN = 8
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PROOF = "array<struct<before:string,after:string>>"


def digest(*columns: Column) -> Column:
    """SHA-256 of the inputs joined, as lowercase hex."""
    return F.sha2(F.concat(*columns).cast("binary"), 256)


def field(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(table: DataFrame, fields: list[str], tampered: Column, text: str = "text") -> DataFrame:
    """The fields ``doc_id`` and ``lang`` of every row, its leaf, and its leaf with upper-case A-Z of ``text`` lowered where ``tampered``."""
    own = [field(F.col(x)) for x in fields]
    changed = [field(F.translate(F.col(x), UPPER, UPPER.lower())) if x == text else y for x, y in zip(fields, own)]
    leaf = digest(*own)
    return table.select("doc_id", "lang", leaf.alias("leaf"), F.when(tampered, digest(*changed)).otherwise(leaf).alias("shown"))


def _groups(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("size"))


def _siblings(nodes: DataFrame) -> DataFrame:
    """Nodes (tree, number, size, digest) with the joined digests of the run's nodes before and after each."""
    run = "OVER (PARTITION BY tree, run ORDER BY number)"
    before = [f"CASE WHEN number % {FAN} >= {k} THEN lag(digest, {k}) {run} END" for k in range(FAN - 1, 0, -1)]
    length = f"least({FAN}, size - run * {FAN})"
    after = [f"CASE WHEN number % {FAN} + {k} < {length} THEN lead(digest, {k}) {run} END" for k in range(1, FAN)]
    return nodes.selectExpr("*", f"number div {FAN} AS run").selectExpr(
        "*", f"concat_ws('', {', '.join(before)}) AS before", f"concat_ws('', {', '.join(after)}) AS after"
    )


def _parents(nodes: DataFrame) -> DataFrame:
    """The level above; a tree of one node keeps it."""
    firsts = _siblings(nodes).filter(f"number % {FAN} = 0")
    return firsts.selectExpr(
        "tree",
        "run AS number",
        f"(size + {FAN - 1}) div {FAN} AS size",
        "CASE WHEN size = 1 THEN digest ELSE sha2(concat(digest, after), 256) END AS digest",
    )


def levels(nodes: DataFrame) -> list[DataFrame]:
    """All levels of the trees, from the given nodes (tree, number, size, digest) to one node a tree."""
    out, most = [nodes], nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        most = -(-most // FAN)
        out.append(staged(_parents(out[-1]), "merkle-level"))
    return out


def _own_step(nodes: DataFrame) -> DataFrame:
    """Nodes with the number of their parent and their own step of a proof; a tree of one node has none on its level."""
    step = f"CASE WHEN size > 1 THEN array(struct(before, after)) ELSE CAST(array() AS {PROOF}) END AS step"
    return _siblings(nodes).selectExpr("tree", "number", "run", "digest", step)


def proofs(trees: list[DataFrame], above: DataFrame) -> DataFrame:
    """tree, number, proof of the lowest nodes: steps of siblings from there to the root.

    ``above`` (tree, proof) is what follows the top of each tree.
    """
    found = trees[-1].select("tree", "number").join(above, "tree").select("tree", "number", "proof")
    for level in reversed(trees[:-1]):
        upper = found.selectExpr("tree", "number AS run", "proof AS rest")
        found = _own_step(level).join(upper, ["tree", "run"]).selectExpr("tree", "number", "concat(step, rest) AS proof")
    return found


def _numbered(table: DataFrame, order: list[str], name: str, slices: int | None) -> DataFrame:
    """Written table with ``number`` (from 0, by ``order``) and ``size`` of each tree."""
    cut = sliced(table, ["tree", *order], name, slices)
    numbered = row_numbers(cut, ["tree"], order, "number")
    known = numbered.withColumn("number", F.col("number") - 1).join(_groups(cut.select("tree", SLICE)), "tree")
    return staged(known, f"{name}-numbered")


def manifest(rows: DataFrame, slices: int | None = None) -> DataFrame:
    """Rows (doc_id, lang, leaf, shown) with subroot, root, proof, and root folded from ``shown`` and the proof.

    ``shown`` is the leaf that a holder of the row comes with; it verifies if the root comes out.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")).alias("tree")  # "-" sorts before "="
    table = _numbered(rows.select(tree, *rows.columns), ["doc_id", "leaf"], "merkle-leaves", slices)
    lower = levels(table.select("tree", "number", "size", F.col("leaf").alias("digest")))
    subroots = lower[-1].select(F.lit("").alias("tree"), F.col("tree").alias("lang"), F.col("digest").alias("subroot"))
    tops = _numbered(subroots, ["lang"], "merkle-subroots", slices)
    upper = levels(tops.select("tree", "number", "size", F.col("subroot").alias("digest")))
    root = upper[-1].select(F.max("digest")).scalar()
    none = F.lit(None).cast(PROOF)
    end = upper[-1].select("tree", F.coalesce(none, F.array().cast(PROOF)).alias("proof"))
    ways = proofs(upper, end).join(tops.select("tree", "number", "lang", "subroot"), ["tree", "number"])
    above = staged(ways.select(F.col("lang").alias("tree"), "subroot", "proof"), "merkle-ways")
    found = proofs(lower, above.select("tree", "proof"))
    folded = F.aggregate("proof", F.col("shown"), lambda held, step: digest(step["before"], held, step["after"]))
    return (
        table.drop("size")
        .join(found, ["tree", "number"])
        .join(above.select("tree", "subroot"), "tree")
        .select(*rows.columns, "subroot", root.alias("root"), "proof", folded.alias("folded_root"))
    )


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), "").cast("binary"), 256)
