"""A Merkle manifest of a dataset: a tree over each group's rows, and one over the groups.

Leaves are dealt and sorted by ranges of (group, order). Counts of each part's run of
a group, summed over the parts before, give every leaf its place in its group.
Tasks then build what they hold: the subtrees that lie wholly in one aligned chunk
of ``2**chunk_bits`` leaves and in one part. The ragged nodes at the edges are
shuffled by their coordinate, the aligned block of leaves that they lie in, and
finish the upper levels in rounds of ``round_bits`` levels. The subroots are the
leaves of one more tree, made the same way.

A level's nodes are hashed in pairs; the last one of an odd level is hashed alone.
Digests are hashed as lowercase hex text and kept as 32 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, release, tied

CHUNK_BITS = 16
ROUND_BITS = 8
_OUT = 8192  # rows that leave a task together

Nodes = dict[int, dict[int, bytes]]  # digests by level and position


def _hash(*digests: bytes) -> bytes:
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def height(total: int) -> int:
    """Levels above the leaves of a tree of ``total`` leaves."""
    return max(0, total - 1).bit_length()


def grow(known: Nodes, total: int, top: int) -> None:
    """Add to ``known`` all nodes up to level ``top`` that follow from it: those of two known children, or of one that is its level's last."""
    for level in range(min(known), min(top, height(total))):
        size = -(-total >> level)
        here, above = known.get(level, {}), known.setdefault(level + 1, {})
        for position, digest in here.items():
            if position & 1:
                continue
            if position + 1 == size:
                above[position >> 1] = _hash(digest)
            elif (other := here.get(position + 1)) is not None:
                above[position >> 1] = _hash(digest, other)


def climb(known: Nodes, total: int, level: int, position: int) -> tuple[int, int, bytes]:
    """The highest known ancestor's level and position, and the siblings on the way there, from below."""
    siblings = []
    while position >> 1 in known.get(level + 1, ()):
        if (other := position ^ 1) < -(-total >> level):
            siblings.append(known[level][other])
        level, position = level + 1, position >> 1
    return level, position, b"".join(siblings)


def fold(digest: bytes, position: int, total: int, siblings: bytes) -> bytes:
    """The root that a leaf at ``position`` of ``total`` gives with its siblings, from below."""
    at = 0
    while total > 1:
        if position & 1 or position + 1 < total:
            other = siblings[at : at + 32]
            at += 32
            digest = _hash(other, digest) if position & 1 else _hash(digest, other)
        else:
            digest = _hash(digest)
        position, total = position >> 1, -(-total >> 1)
    return digest


def leaf_text(columns: list[str], **changed: Column) -> Column:
    """What a row's leaf is the sha256 of: each column as ``-`` if null, else its bytes' number, a colon and its text."""
    texts = [changed.get(c, F.col(c)).cast("string") for c in columns]
    return F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add ``part``, ``run`` (of equal groups in the part) and ``at`` (in the run) to rows that lie by group."""
    part, run, at = TaskContext.get().partitionId(), -1, 0
    last: object = None
    for batch in batches:
        runs, ats = [], []
        for g in batch.column("g").to_pylist():
            if run < 0 or g != last:
                run, at, last = run + 1, 0, g
            runs.append(run)
            ats.append(at)
            at += 1
        extra = [pa.array(np.full(len(runs), part, np.int32)), pa.array(runs, pa.int64()), pa.array(ats, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "part", "run", "at"])


def _segments(batches: Iterator[pa.RecordBatch], chunk_bits: int) -> Iterator[pa.Table]:
    """The rows again, in tables that cut no chunk's run of consecutive positions; none is larger than a batch and a chunk."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = _cuts(batch, chunk_bits, last)
        last = _end(batch)
        if len(keys):
            if held or keys[-1]:
                yield pa.Table.from_batches([*held, batch.slice(0, keys[-1])])
            held = [batch.slice(keys[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _end(batch: pa.RecordBatch) -> tuple:
    return tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in ("part", "run", "pos"))


def _cuts(batch: pa.RecordBatch | pa.Table, chunk_bits: int, last: tuple | None) -> np.ndarray:
    """Rows at which a segment begins; ``last`` is the row before the first one."""
    part, run, pos = (batch.column(c).to_numpy() for c in ("part", "run", "pos"))
    before = last or (-1, -1, -2)
    part_, run_, pos_ = (np.concatenate([[b], x[:-1]]) for b, x in zip(before, (part, run, pos)))
    return np.flatnonzero((part != part_) | (run != run_) | (pos != pos_ + 1) | (pos >> chunk_bits != pos_ >> chunk_bits))


def _on(a: DataFrame, b: DataFrame, *names: str) -> Column:
    """Equality of ``a``'s columns and ``b``'s of the same names with an underscore; nulls are equal."""
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[f"{n}_"])
    return out


def _tree(rows: DataFrame, chunk_bits: int, round_bits: int) -> tuple[DataFrame, DataFrame]:
    """Trees over ``rows`` (``g, o, leaf`` and others): the leaves with their nodes, and the nodes with their paths.

    Leaves get ``pos, total, low`` (siblings up to their node) and ``level, node``;
    nodes have ``g, level, node, high`` (siblings from there on) and ``subroot``.
    """
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange("g", "o", "leaf", "row").sortWithinPartitions("g", "o", "leaf").drop("row")
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("run", T.LongType()), T.StructField("at", T.LongType())])
    numbered = materialize(dealt.mapInArrow(_number, schema), "leaves")
    # A row for each part and group that it has: groups and parts together at most.
    runs = numbered.groupBy("part", "run").agg(F.count(F.lit(1)).alias("n"), F.first("g").alias("g"))
    of_group = Window.partitionBy("g")
    before = F.coalesce(F.sum("n").over(of_group.orderBy("part", "run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = materialize(runs.select("part", "run", before.alias("before"), F.sum("n").over(of_group).alias("total")), "runs")
    deepest = height(runs.agg(F.max("total")).first()[0] or 0)
    placed = numbered.join(runs, ["part", "run"]).withColumn("pos", F.col("before") + F.col("at")).sortWithinPartitions("part", "run", "at").drop("before", "at")
    kept = [f for f in placed.schema.fields if f.name not in ("part", "run")]
    added = [("level", T.IntegerType()), ("node", T.LongType()), ("digest", T.BinaryType()), ("low", T.BinaryType()), ("leads", T.BooleanType())]
    out = T.StructType([*kept, *[T.StructField(n, t) for n, t in added]])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _segments(batches, chunk_bits):
            pos, total, leaf = (table.column(c).to_pylist() for c in ("pos", "total", "leaf"))
            cuts = [*_cuts(table, chunk_bits, None).tolist(), len(pos)]
            found = []
            for low, high in zip(cuts, cuts[1:]):
                known: Nodes = {0: dict(zip(pos[low:high], leaf[low:high]))}
                grow(known, total[low], chunk_bits)
                last = None
                for p in pos[low:high]:
                    level, node, siblings = climb(known, total[low], 0, p)
                    found.append((level, node, known[level][node], siblings, (level, node) != last))
                    last = (level, node)
            extra = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.bool_()))]
            whole = pa.table([*(table.column(f.name) for f in kept), *extra], names=out.names)
            yield from whole.to_batches(max_chunksize=_OUT)

    leaves = materialize(placed.mapInArrow(build, out), "local")
    release(numbered, runs)
    nodes = leaves.where("leads").select("g", "level", "node", "digest", "total")
    rooted = F.expr("shiftleft(1L, level) >= total")  # a group's only node, as groups have that lie in one chunk and part
    kind = rows.schema["g"].dataType
    key = [T.StructField("g", kind), T.StructField("level", T.IntegerType()), T.StructField("node", T.LongType())]
    up = T.StructType([*key, *[T.StructField(n, t) for n, t in (("total", T.LongType()), ("siblings", T.BinaryType()), ("up_level", T.IntegerType()), ("up_node", T.LongType()), ("up_digest", T.BinaryType()), ("leads", T.BooleanType()))]])

    def finish(bits: int):
        def run(table: pa.Table) -> pa.Table:
            levels, places, digests = (table.column(c).to_pylist() for c in ("level", "node", "digest"))
            total = table.column("total")[0].as_py()
            known: Nodes = {}
            for level, place, digest in zip(levels, places, digests):
                known.setdefault(level, {})[place] = digest
            grow(known, total, bits)
            found, seen = [], set()
            for level, place in zip(levels, places):
                up_level, up_node, siblings = climb(known, total, level, place)
                found.append((siblings, up_level, up_node, known[up_level][up_node], (up_level, up_node) not in seen))
                seen.add((up_level, up_node))
            extra = [pa.array(c, t) for c, t in zip(zip(*found), (pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.bool_()))]
            return pa.table([*(table.column(c) for c in ("g", "level", "node", "total")), *extra], names=up.names)

        return run

    rounds, bits, pending = [], chunk_bits, nodes.where(~rooted)
    while True:
        bits += round_bits
        block = F.expr(f"shiftright(node, {bits} - level)").alias("block")
        rounds.append(materialize(pending.groupBy("g", block).applyInArrow(finish(bits), up), "nodes"))
        if bits >= deepest:
            break
        pending = rounds[-1].where("leads").select("g", F.col("up_level").alias("level"), F.col("up_node").alias("node"), F.col("up_digest").alias("digest"), "total")
    paths = rounds[-1].select("g", "level", "node", F.col("siblings").alias("high"), F.col("up_digest").alias("subroot"))
    for one in reversed(rounds[:-1]):
        above = paths.select(F.col("g").alias("g_"), F.col("level").alias("up_level_"), F.col("node").alias("up_node_"), "high", "subroot")
        paths = one.join(above, _on(one, above, "g", "up_level", "up_node")).select("g", "level", "node", F.concat("siblings", "high").alias("high"), "subroot")
    paths = paths.unionByName(nodes.where(rooted).select("g", "level", "node", F.lit(b"").alias("high"), F.col("digest").alias("subroot")))
    return leaves, tied(paths, *rounds)


def manifest(df: DataFrame, *, order_col: str, group_col: str, leaf_col: str, carry: tuple[str, ...] = (), chunk_bits: int = CHUNK_BITS, round_bits: int = ROUND_BITS) -> DataFrame:
    """Each row's leaf, its proof and the roots.

    ``leaf_col`` has the rows' leaves, lowercase hex digests. Returns ``order_col``, the
    ``carry`` columns and, of bytes, ``leaf``, ``subroot`` (its group's root), ``root``,
    ``proof`` (32 bytes for each sibling, from the leaf to the subroot) and
    ``group_proof`` (from there to the root), with the places that tell which side a
    sibling stands on: ``position`` among ``total`` leaves of the group and
    ``group_position`` among ``groups``. A group of one leaf has it as its subroot.

    In a group leaves ascend by ``order_col``, nulls first, and rows of one order by
    their leaf, so that repeated rows are leaves of their own; groups ascend, null first.
    Other columns are not read. An empty table gives no rows.
    """
    base = df.select(F.col(group_col).alias("g"), F.col(order_col).alias("o"), F.unhex(leaf_col).alias("leaf"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    leaves, nodes = _tree(base, chunk_bits, round_bits)
    nodes = tied(materialize(nodes, "paths"), *_owned(nodes))
    # One row for each group, from the node of its first leaf.
    subroots = leaves.where("pos = 0").select(F.col("g").alias("g_"), F.col("level").alias("level_"), F.col("node").alias("node_"))
    subroots = nodes.join(subroots, _on(nodes, subroots, "g", "level", "node")).select(nodes["g"].alias("o"), "subroot")
    subroots = materialize(subroots, "subroots")
    groups = _over_groups(subroots, chunk_bits, round_bits)
    paths = nodes.join(groups, nodes["g"].eqNullSafe(groups["g_"])).select(F.col("g").alias("g_"), F.col("level").alias("level_"), F.col("node").alias("node_"), "high", "subroot", "group_proof", "group_position", "groups", "root")
    # By node, of at most 2**chunk_bits leaves: no group comes together in one task.
    full = leaves.join(paths, _on(leaves, paths, "g", "level", "node"))
    shown = [F.col("o").alias(order_col), *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)]]
    out = full.select(*shown, "leaf", "subroot", "root", F.concat("low", "high").alias("proof"), F.col("pos").alias("position"), "total", "group_proof", "group_position", "groups")
    release(subroots)
    return tied(out, *_owned(leaves), *_owned(nodes), *_owned(groups))


def _over_groups(subroots: DataFrame, chunk_bits: int, round_bits: int) -> DataFrame:
    """``g_, group_proof, group_position, groups, root`` of each group, from ``o, subroot``.

    As many groups as one chunk's leaves, whose tree any task would build alone,
    make it on the driver, two megabytes at most; more are dealt like any other leaves.
    """
    spark = subroots.sparkSession
    kind = subroots.schema["o"].dataType
    schema = T.StructType([T.StructField("g_", kind), T.StructField("group_proof", T.BinaryType()), T.StructField("group_position", T.LongType()), T.StructField("groups", T.LongType()), T.StructField("root", T.BinaryType())])
    total = subroots.count()
    if total > 1 << chunk_bits:
        tops, nodes = _tree(subroots.select(F.lit(0).alias("g"), "o", F.col("subroot").alias("leaf")), chunk_bits, round_bits)
        above = nodes.select("level", "node", "high", F.col("subroot").alias("root"))
        out = tops.join(above, ["level", "node"]).select(F.col("o").alias("g_"), F.concat("low", "high").alias("group_proof"), F.col("pos").alias("group_position"), F.col("total").alias("groups"), "root")
        out = materialize(out, "groups")
        release(tops, nodes)
        return out
    rows = subroots.orderBy("o").collect()  # nulls first
    known: Nodes = {0: {i: bytes(r.subroot) for i, r in enumerate(rows)}}
    grow(known, total, height(total))
    found = []
    for i, r in enumerate(rows):
        level, place, siblings = climb(known, total, 0, i)
        found.append((r.o, siblings, i, total, known[level][place]))
    return spark.createDataFrame(found, schema)


def _owned(df: DataFrame) -> list[str]:
    return getattr(df, "_folders", [])


def verify(proofs: DataFrame, *, claimed_col: str) -> DataFrame:
    """Add ``proof_sha256`` (over the siblings' hex text), ``folded_root`` and ``verified`` to rows of :func:`manifest`.

    ``claimed_col`` has the hex leaf to be checked; null stands for the row's own.
    Every row's root is folded anew from its claimed leaf and its siblings. Digests
    come out as hex text.
    """
    hexed = ("leaf", "subroot", "root")
    dropped = {claimed_col, "proof", "group_proof", "position", "total", "group_position", "groups", *hexed}
    kept = [f for f in proofs.schema.fields if f.name not in dropped]
    schema = T.StructType([*kept, *[T.StructField(n, T.StringType()) for n in (*hexed, "proof_sha256", "folded_root")], T.StructField("verified", T.BooleanType())])
    claimed = F.coalesce(F.unhex(claimed_col), "leaf").alias("claimed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            proof_sha, folded = [], []
            for digest, low, position, total, high, group, groups in zip(*(batch.column(c).to_pylist() for c in ("claimed", "proof", "position", "total", "group_proof", "group_position", "groups")), strict=True):
                proof_sha.append(hashlib.sha256((low + high).hex().encode()).hexdigest())
                folded.append(fold(fold(digest, position, total, low), group, groups, high).hex())
            shown = [[x.hex() for x in batch.column(c).to_pylist()] for c in hexed]
            same = [a == b for a, b in zip(folded, shown[2])]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *(pa.array(x, pa.string()) for x in (*shown, proof_sha, folded)), pa.array(same, pa.bool_())], names=schema.names)

    columns = [f.name for f in kept]
    return tied(proofs.select(*columns, *hexed, claimed, "proof", "position", "total", "group_proof", "group_position", "groups").mapInArrow(run, schema), *_owned(proofs))
