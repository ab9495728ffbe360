"""Merkle manifest: a tree of digests over each group's records in order, a tree of the groups' roots, and a proof for every record.

Records are numbered within their group without gathering it; blocks of consecutive leaves are reduced where they lie, in
rounds, until few nodes are left. The driver builds that small top, and the paths from its nodes to the root go back to the
executors, which finish the proofs and fold every record's digest up to the root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import Written

#: Children of a node; levels that a block of leaves is reduced by in a round; nodes that the driver takes at most.
ARITY, BLOCK_LEVELS, MOST_TOP = 3, 6, 4096

_NODE = "tree string, pos bigint, n bigint, digest binary"
_PATH = "proof binary, turns binary, subroot binary, root binary"
_PROVEN = f"{_PATH}, folded binary"


def field(value: Column) -> Column:
    """A value as a leaf takes it: its UTF-8 bytes' count, a colon, the value; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def parent(children: list[bytes]) -> bytes:
    """The digest over the children's digests as hex text."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def climb(digests: list[bytes], levels: int | None = None) -> list[list[bytes]]:
    """The levels of a tree from its leaves on: so many more, or as many as leave one node."""
    out = [digests]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        last = out[-1]
        out.append([parent(last[i : i + ARITY]) for i in range(0, len(last), ARITY)])
    return out


def paths(levels: list[list[bytes]], proof: bytes = b"", turns: bytes = b"") -> list[tuple[bytes, bytes]]:
    """Of every leaf (proof, turns): its siblings on each level, and its place in the run and the run's length.

    ``proof`` and ``turns`` are those of the top node, which every path ends with.
    """
    known = [(proof, turns)]
    for level in reversed(levels[:-1]):
        below = []
        for i in range(len(level)):
            first, at = i - i % ARITY, i % ARITY
            run = level[first : first + ARITY]
            above = known[i // ARITY]
            below.append((b"".join(run[:at] + run[at + 1 :]) + above[0], bytes((at, len(run))) + above[1]))
        known = below
    return known


def fold(digest: bytes, proof: bytes, turns: bytes) -> bytes:
    """The root that a digest leads to by its proof."""
    used = 0
    for at, length in zip(turns[::2], turns[1::2], strict=True):
        others = [proof[i : i + 32] for i in range(used, used + 32 * (length - 1), 32)]
        digest = parent([*others[:at], digest, *others[at:]])
        used += 32 * (length - 1)
    return digest


def numbered(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """Rows with ``pos``, their place in their group from 0, and ``n``, the group's rows; ``order`` must tell all rows apart.

    Rows are range-partitioned, so a group spans as many partitions as it fills; only a row for each group and partition
    meets another.
    """
    placed = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumns({"_part": F.shiftright("_at", 33), "_nth": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at")
    placed = Written(placed, label).df
    runs = placed.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_p")).agg(F.min("_nth").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    same = Window.partitionBy("_group")
    before = F.sum("_rows").over(same.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("_group", "_p", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_base"), F.sum("_rows").over(same).alias("n"))
    joined = placed.join(runs, placed[group].eqNullSafe(runs["_group"]) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("pos", F.col("_base") + F.col("_nth")).drop("_part", "_nth", "_group", "_p", "_base")


def _block(levels: int) -> Column:
    return F.floor(F.col("pos") / (ARITY**levels)).cast("bigint")


def _levels(table: pa.Table, levels: int) -> list[list[bytes]]:
    """A block's levels. The only block of its tree ends with one node, others after so many levels."""
    alone = table.column("n")[0].as_py() <= ARITY**levels
    return climb(table.column("digest").to_pylist(), None if alone else levels)


def _lifted(nodes: DataFrame, levels: int) -> DataFrame:
    """One node for each block of ARITY ** levels consecutive nodes of a tree."""
    size = ARITY**levels

    def reduce(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        top = _levels(table, levels)[-1][0]
        row = (table.column("tree")[0].as_py(), table.column("pos")[0].as_py() // size, -(-table.column("n")[0].as_py() // size), top)
        return pa.table([pa.array([x], type=t) for x, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["tree", "pos", "n", "digest"])

    rows = nodes.select("tree", "pos", "n", "digest", _block(levels).alias("block"))
    return rows.groupBy("tree", "block").applyInArrow(reduce, _NODE)


def _top_paths(nodes: list, rooted: bool) -> dict[tuple, tuple]:
    """(proof, turns, subroot, root) by (tree, pos) of the nodes left, in order of (tree, pos).

    ``rooted``: they are nodes of the one tree above all groups, whose roots lie below them.
    """
    by_tree: dict = {}
    for r in nodes:
        by_tree.setdefault(r.tree, []).append(bytes(r.digest))
    trees = {t: climb(d) for t, d in by_tree.items()}
    if not trees:
        return {}
    if rooted:
        return {(None, i): (*p, None, trees[None][-1][0]) for i, p in enumerate(paths(trees[None]))}
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    upper = climb([trees[t][-1][0] for t in order])
    out = {}
    for t, path in zip(order, paths(upper), strict=True):
        out |= {(t, i): (*p, trees[t][-1][0], upper[-1][0]) for i, p in enumerate(paths(trees[t], *path))}
    return out


def _descend(nodes: DataFrame, above: DataFrame | dict, payload: list[str], found: str, levels: int) -> DataFrame:
    """``payload`` and the paths of all nodes, from those of their blocks: a bounded dictionary, or a table."""
    fields = StructType([nodes.schema[c] for c in payload] + list(StructType.fromDDL(found).fields))
    schema = to_arrow_schema(fields)

    def finished(table: pa.Table, proof: bytes, turns: bytes, subroot: bytes | None, root: bytes) -> pa.Table:
        table = table.sort_by("pos")
        own = paths(_levels(table, levels), proof, turns)
        out = {c: table.column(c).combine_chunks() for c in payload}
        out |= {"proof": [p for p, _ in own], "turns": [t for _, t in own], "subroot": [subroot] * len(own), "root": [root] * len(own)}
        if "folded" in schema.names:
            told, true = table.column("told").to_pylist(), table.column("digest").to_pylist()
            out["folded"] = [fold(d if t is None else t, *p) for t, d, p in zip(told, true, own, strict=True)]
        return pa.table([x if isinstance(x := out[f.name], pa.Array) else pa.array(x, type=f.type) for f in schema], schema=schema)

    blocks = nodes.withColumn("block", _block(levels)).groupBy("tree", "block")
    if isinstance(above, dict):
        held = nodes.sparkSession.sparkContext.broadcast(above)
        return blocks.applyInArrow(lambda t: finished(t, *held.value[t.column("tree")[0].as_py(), t.column("block")[0].as_py()]), fields)
    keyed = above.withColumnRenamed("pos", "block").groupBy("tree", "block")
    return blocks.cogroup(keyed).applyInArrow(lambda t, path: finished(t, *[path.column(c)[0].as_py() for c in ("proof", "turns", "subroot", "root")]), fields)


def _paths_of(nodes: Written, rooted: bool, levels: int, most: int) -> DataFrame | dict:
    """The paths of all nodes: by the driver where they are few, else from those of their blocks' nodes.

    Where the groups alone are more than the driver takes, their roots are numbered and reduced in blocks like leaves.
    """
    if nodes.df.count() <= most:
        return _top_paths(nodes.df.orderBy("tree", "pos").collect(), rooted)
    if not rooted and nodes.df.where("n > 1").isEmpty():
        groups = nodes.df.select(F.lit(None).cast("string").alias("one"), F.col("tree").alias("name"), "digest")
        ranked = Written(numbered(groups, "one", ["name"], "merkle-order").withColumnRenamed("one", "tree"), "merkle-groups")
        path = _paths_of(ranked, True, levels, most).withColumnRenamed("tree", "none")
        return ranked.df.drop("tree", "n").join(path, "pos").select(F.col("name").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "proof", "turns", F.col("digest").alias("subroot"), "root")
    lifted = Written(_lifted(nodes.df, levels), "merkle-nodes")
    return Written(_descend(nodes.df, _paths_of(lifted, rooted, levels, most), ["tree", "pos"], _PATH, levels), "merkle-paths").df


def prove(leaves: DataFrame, levels: int = BLOCK_LEVELS, most: int = MOST_TOP) -> DataFrame:
    """(id, digest, proof, turns, subroot, root, folded) for every leaf of (tree, id, digest, told).

    Leaves ascend by (id, digest) within their tree, null ids first; trees ascend by their name's bytes, null first. ``proof``
    holds the siblings of a leaf level by level up to the root, ``turns`` its place and the run's length on each level;
    ``fold(digest, proof, turns)`` gives the root. ``folded`` is that of ``told`` (the digest that somebody claims), or of the
    leaf itself where that is null. Rows equal in all columns are leaves of their own. No leaves: no rows. The driver takes
    at most ``most`` nodes; what is more is reduced by ``levels`` levels a round.
    """
    known = Written(leaves.withColumn("u", F.monotonically_increasing_id()), "merkle-leaves")  # tells repeated rows apart
    level = Written(numbered(known.df, "tree", ["id", "digest", "u"], "merkle-order").drop("u"), "merkle-nodes")
    known.drop()
    blocks = Written(_lifted(level.df, levels), "merkle-nodes")
    return _descend(level.df, _paths_of(blocks, False, levels, most), ["id", "digest"], _PROVEN, levels)


def manifest(docs: DataFrame, levels: int = BLOCK_LEVELS, most: int = MOST_TOP) -> DataFrame:
    """The manifest of ``documents``: for each row its leaf, its source's root, the root, its proof, and what a tampered copy gives.

    A leaf is the digest over doc_id, source, lang, n_chars and text. Copies are tampered with where 2 divides the checksum
    of doc_id: their texts lose all line feeds.

    Null in any column: a dash in the leaf; null sources are a group of their own, the first; rows with a null id come first
    and are not tampered with; null texts stay null. Rows that share an id are ordered by their leaf; repeated rows are
    leaves of their own. Empty and very long texts are hashed like others, whole. Empty table: no rows. Extra columns: ignored.
    """
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text, key = F.col("text"), F.col("doc_id").cast("bigint")
    touched = (F.crc32(key.cast("string").cast("binary")) % 2 == 0) & (F.instr(text, "\n") > 0)
    told = F.when(touched, leaf(*rest, F.replace(text, F.lit("\n"), F.lit(""))))
    proven = prove(docs.select(F.col("source").cast("string").alias("tree"), key.alias("id"), leaf(*rest, text).alias("digest"), told.alias("told")), levels, most)
    plain = lambda c: F.lower(F.hex(c))
    return proven.select(
        F.col("id").alias("doc_id"), plain("digest").alias("leaf"), plain("subroot").alias("subroot"), plain("root").alias("root"), F.sha2(plain("proof"), 256).alias("proof_sha256"),
        plain("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
