"""Merkle manifest of a dataset by a tree of SHA-256 midstates.

Rows are leaves. Within a tree (one per language, and one over the languages' roots)
every FAN consecutive nodes become the digest of their joined hex digests, until one is
left. While a parent is hashed, it keeps a copy of the hash state before each child's
slot. To fold a replaced child, the state of its slot is resumed with the replacement
and the siblings to the right only; nothing to the left is hashed again.

Spark does this in tiers of LEVELS levels. FAN**LEVELS consecutive nodes of a tree are
one group, which holds all their levels; its top is a node of the next tier. Going
down again, each group gets the path of its top (one run of digests per level
above), makes the states of that path once, and folds all its rows through them.
A group's size is fixed, so is a message; a hot language is just more groups.

Defined results: leaves of a language go by ``doc_id``, null ids last, then by digest; equal
rows are leaves of their own. A null language is a tree of its own, the first one.
An empty table gives no rows and no root. Columns other than the five hashed ones
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permeon.llm.common import ascii_lower, stored
from permeon.operators.ordering import quantile_cuts, ranked

FAN = 8
LEVELS = 3
GROUP = FAN**LEVELS
#: Characters of a digest.
WIDTH = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<slot:int,run:binary>>"
_ARROW_PATH = pa.list_(pa.struct([("slot", pa.int32()), ("run", pa.binary())]))


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest of the values, each as byte count, colon and text, or a dash if null."""
    parts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]), 256)


class Parent:
    """Digest of a run of child digests, with the hash state before each slot retained."""

    __slots__ = ("run", "states", "digest")

    def __init__(self, run: bytes):
        self.run, self.states = run, []
        state = hashlib.sha256()
        for at in range(0, len(run), WIDTH):
            self.states.append(state.copy())
            state.update(run[at : at + WIDTH])
        self.digest = state.hexdigest().encode()

    def fold(self, slot: int, child: bytes) -> bytes:
        """The digest with another child in that slot."""
        state = self.states[slot].copy()
        state.update(child + self.run[(slot + 1) * WIDTH :])
        return state.hexdigest().encode()


class Step:
    """One level of a path above a group: the state before its slot, and what stands to the right."""

    __slots__ = ("state", "left", "right")

    def __init__(self, slot: int, run: bytes):
        self.left, self.right = run[: slot * WIDTH], run[(slot + 1) * WIDTH :]
        self.state = hashlib.sha256(self.left)

    def fold(self, child: bytes) -> bytes:
        state = self.state.copy()
        state.update(child + self.right)
        return state.hexdigest().encode()


def _levels(digests: Sequence[bytes], nodes: int) -> list[list[Parent]]:
    """Parents of a group by level; ``nodes`` is the size of its whole tree at this tier."""
    out, here, left = [], list(digests), nodes
    while left > 1 and len(out) < LEVELS:
        out.append([Parent(b"".join(here[i : i + FAN])) for i in range(0, len(here), FAN)])
        here, left = [p.digest for p in out[-1]], -(-left // FAN)
    return out


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("pos").combine_chunks()


def _digests(table: pa.Table, name: str = "digest") -> list[bytes]:
    return [x.encode() for x in table.column(name).to_pylist()]


def _grouped(nodes: DataFrame):
    return nodes.withColumn("block", F.expr(f"pos div {GROUP}")).groupBy("tree", "block")


def _next_tier(nodes: DataFrame) -> DataFrame:
    """The tops of all groups: tree, pos, n (nodes of the tree in the new tier), digest."""

    def top(key, table):
        table, n = _sorted(table), table.column("n")[0].as_py()
        levels = _levels(_digests(table), n)
        digest = levels[-1][0].digest.decode() if levels else table.column("digest")[0].as_py()
        return pa.table({"tree": pa.array([key[0].as_py()]), "pos": pa.array([key[1].as_py()]), "n": pa.array([-(-n // GROUP)]), "digest": pa.array([digest])})

    return _grouped(nodes.select("tree", "pos", "n", "digest")).applyInArrow(top, "tree string, pos bigint, n bigint, digest string")


def _tiers(nodes: DataFrame, purpose: str) -> list[DataFrame]:
    """``nodes`` and the tiers above it, up to one node for each tree."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(stored(_next_tier(out[-1]), purpose))
    return out


def _paths(nodes: DataFrame, above: DataFrame | None) -> DataFrame:
    """The path of every node: the steps inside its group, then those of the group's top.

    ``above`` has the tops' paths as (tree, block, path); None if the nodes are tops themselves.
    """
    if above is None:
        return nodes.select("tree", "pos", F.array().cast(_PATH).alias("path"))

    def extend(key, table, upper):
        table = _sorted(table)
        levels = _levels(_digests(table), table.column("n")[0].as_py())
        rest = upper.column("path")[0].as_py()
        paths = []
        for i in range(len(table)):
            own = [{"slot": i // FAN**k % FAN, "run": level[i // FAN ** (k + 1)].run} for k, level in enumerate(levels)]
            paths.append(own + rest)
        return pa.table({"tree": table.column("tree"), "pos": table.column("pos"), "path": pa.array(paths, _ARROW_PATH)})

    return _grouped(nodes.select("tree", "pos", "n", "digest")).cogroup(above.groupBy("tree", "block")).applyInArrow(extend, f"tree string, pos bigint, path {_PATH}")


def _top_down(tiers: list[DataFrame], purpose: str) -> DataFrame | None:
    """Paths of the groups of the lowest tier as (tree, block, path); None if it has tops only."""
    above = None
    for nodes in reversed(tiers[1:]):
        above = stored(_paths(nodes, above).withColumnRenamed("pos", "block"), purpose)
    return above


@dataclass
class Manifest:
    """Leaves in order (doc_id, tree, pos, n, digest, replacement), the tiers, the languages' paths, the root."""

    leaves: DataFrame
    tiers: list[DataFrame]
    subroots: DataFrame
    root: str | None


def build_manifest(
    docs: DataFrame, replacement: Mapping[str, Column] | None = None, fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "lang"
) -> Manifest:
    """The manifest of ``docs``; ``replacement`` maps a field to what a later reader finds in its place."""
    new = [(replacement or {}).get(f, F.col(f)) for f in fields]
    tree = F.when(F.col(group).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(group).cast("string")))
    rows = docs.select(F.col(key).alias("doc_id"), tree.alias("tree"), leaf_digest([F.col(f) for f in fields]).alias("digest"), leaf_digest(new).alias("replacement"))
    rows = stored(rows, "leaves")
    order = ["doc_id", "digest", "replacement"]
    leaves = stored(ranked(rows, order, by=["tree"], name="pos", total="n", cuts=quantile_cuts(rows, order)), "ordered-leaves")
    tiers = _tiers(leaves, "tier")
    tops = tiers[-1].select(F.lit("").alias("top"), F.col("tree").alias("lang"), "digest")
    over = stored(ranked(tops, ["lang"], name="pos", total="n").select(F.col("top").alias("tree"), "pos", "n", "digest", "lang"), "languages")
    languages = _tiers(over, "language-tier")
    root = languages[-1].select("digest").first()
    ways = _paths(over, _top_down(languages, "language-path")).join(over.select("pos", "lang", "digest"), "pos")
    subroots = ways.select(F.col("lang").alias("tree"), F.col("digest").alias("subroot"), F.col("path").alias("over"))
    return Manifest(leaves, tiers, stored(subroots, "subroots"), root and root[0])


def verify(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every leaf.

    proof_sha256 is the digest of all siblings from the leaf up. folded_root is the root with
    the replacement in the leaf's place.
    """
    leaves = manifest.leaves
    inner = _top_down(manifest.tiers, "path")
    if inner is None:  # every language has one leaf
        inner = stored(leaves.select("tree", F.lit(0).cast("bigint").alias("block"), F.array().cast(_PATH).alias("path")), "path")
    above = inner.join(manifest.subroots, "tree").select("tree", "block", "subroot", F.concat("path", "over").alias("path"))
    root = manifest.root
    key = leaves.schema["doc_id"].dataType.simpleString()

    def fold(_, table, upper):
        table = _sorted(table)
        levels = _levels(_digests(table), table.column("n")[0].as_py())
        steps = [Step(s["slot"], s["run"]) for s in upper.column("path")[0].as_py()]
        beside = b"".join(s.left + s.right for s in steps)
        proofs, folded = [], []
        for i, new in enumerate(_digests(table, "replacement")):
            proof, at = hashlib.sha256(), i
            for level in levels:
                at, slot = divmod(at, FAN)
                parent = level[at]
                proof.update(parent.run[: slot * WIDTH] + parent.run[(slot + 1) * WIDTH :])
                new = parent.fold(slot, new)
            proof.update(beside)
            for step in steps:
                new = step.fold(new)
            proofs.append(proof.hexdigest())
            folded.append(new.decode())
        n = len(table)
        return pa.table({
            "doc_id": table.column("doc_id"), "leaf": table.column("digest"), "subroot": pa.array([upper.column("subroot")[0].as_py()] * n, pa.string()),
            "root": pa.array([root] * n, pa.string()), "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()),
        })

    schema = f"doc_id {key}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    out = _grouped(leaves).cogroup(above.groupBy("tree", "block")).applyInArrow(fold, schema)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered_text(tampered: Column) -> dict[str, Column]:
    """The replacement that lower-cases A-Z of the text where ``tampered`` holds."""
    return {"text": F.when(tampered, ascii_lower(F.col("text"))).otherwise(F.col("text"))}
