"""Merkle manifest of a table: a hash tree for every group, one tree over the groups' roots, and a proof for every row.

Rows are sorted by group and id and dealt in ranges, the leaf partitions. A partition's rows of one group are a run of
neighbouring leaves. Trees are built from below: a partition hashes all nodes that its own leaves determine and passes on
only the topmost, at most two a level; what partitions share is hashed in rounds of sixteen levels, a task for each subtree.

Proofs come from an octopus multiproof: for a run of leaves the nodes are listed that are needed to reach the root and do not
follow from its own (at most two a level), each is fetched once for the whole run by an equi-join, the interior nodes that the
proofs share are derived once, and the proof of each leaf is read off them where it lies.

``H`` is the lowercase hex SHA-256 of its inputs in a row, digests as hex text. Two neighbours are hashed together; the last
node of a level is hashed alone if it has none.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.plans.session import settle

#: Leaves of a partition, about; one is held in memory.
RUN_LEAVES = 1 << 16
#: Levels that are built in a round: a subtree of so many levels is held in memory.
ROUND_LEVELS = 16


def digest(*parts: str) -> str:
    """H of the parts."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field_bytes(column: Column) -> Column:
    """A field as text that no other field can continue: its UTF-8 byte count, a colon and the value; '-' if null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    """H of the fields of a row."""
    return F.sha2(F.concat(*map(field_bytes, columns)).cast("binary"), 256)


def height(size: int) -> int:
    """Levels above the leaves of a tree."""
    return max(size - 1, 0).bit_length()


def _height(size: Column) -> Column:
    return F.length(F.regexp_replace(F.bin(size - 1), "^0+", ""))


def climb(first: int, leaves: list[str], size: int) -> list[tuple[int, int, str]]:
    """Topmost nodes (level, place, digest) that a run of leaves from place ``first`` on determines, of a tree of ``size`` leaves."""
    level, at, nodes, out = 0, first, leaves, []
    while size > 1 and nodes:
        if at % 2:
            out.append((level, at, nodes[0]))
            at, nodes = at + 1, nodes[1:]
        if len(nodes) % 2 and at + len(nodes) < size:
            out.append((level, at + len(nodes) - 1, nodes[-1]))
            nodes = nodes[:-1]
        nodes = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        level, at, size = level + 1, at // 2, (size + 1) // 2
    return out + [(level, at, x) for x in nodes]


def complete(nodes: dict[tuple[int, int], str], size: int, top: int) -> list[tuple[int, int, str]]:
    """Further nodes (level, place, digest) up to level ``top`` or the root, from nodes that cover a subtree."""
    by_level: dict[int, dict[int, str]] = {}
    for (level, at), x in nodes.items():
        by_level.setdefault(level, {})[at] = x
    out = []
    for level in range(min(by_level), min(top, height(size))):
        below, above = by_level.get(level, {}), by_level.setdefault(level + 1, {})
        width = (size + (1 << level) - 1) >> level
        for at in sorted(below):
            if at % 2 == 0:
                both = [below[at]] if at + 1 == width else [below[at], below[at + 1]]
                above[at // 2] = digest(*both)
                out.append((level + 1, at // 2, above[at // 2]))
    return out


def expand(first: int, leaves: list[str], size: int, fetched: dict[tuple[int, int], str]) -> list[tuple[int, list[str]]]:
    """For every level up to the root the place of the first known node and the nodes, own or fetched, that proofs need."""
    out, at, nodes = [], first, leaves
    for level in range(height(size) + 1):
        left, right = fetched.get((level, at - 1)), fetched.get((level, at + len(nodes)))
        if at % 2 and left is not None:
            at, nodes = at - 1, [left, *nodes]
        if right is not None:
            nodes = [*nodes, right]
        out.append((at, nodes))
        at, nodes = at // 2, [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return out


def path_of(levels: list[tuple[int, list[str]]], at: int) -> list[tuple[int, str]]:
    """Siblings of a leaf from below, as (1 if it stands to the left, digest); ('' if the node has none)."""
    out = []
    for first, nodes in levels[:-1]:
        i = (at ^ 1) - first
        out.append((at % 2, nodes[i]) if 0 <= i < len(nodes) else (0, ""))
        at //= 2
    return out


def fold(leaf: str, path: list[tuple[int, str]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for left, sibling in path:
        leaf = digest(sibling, leaf) if left else digest(leaf, sibling)
    return leaf


@dataclass
class Forest:
    """Placed leaves and the nodes that proofs may ask for.

    rows: part, grp, idx (within the run) and the columns of a leaf; runs: part, grp, first, n, size, tallest; nodes: grp,
    level, place, digest; roots: grp, root.
    """

    rows: DataFrame
    runs: DataFrame
    nodes: DataFrame
    roots: DataFrame


def _place(leaves: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Leaves in ranges of (grp, order), numbered within the part of a group that a partition holds, and these runs."""
    spark = leaves.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), leaves.count() // RUN_LEAVES + 1)
    dealt = leaves.repartitionByRange(parts, "grp", *order).sortWithinPartitions("grp", *order)
    names = leaves.columns

    def number(batches):
        from pyspark import TaskContext

        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            idx = []
            for g in batch.column(names.index("grp")).to_pylist():
                n = n + 1 if g == last else 0
                last = g
                idx.append(n)
            parts_of = pa.array([part] * batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, parts_of, pa.array(idx, pa.int64())], names=[*names, "part", "idx"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema)
    rows = settle(dealt.mapInArrow(number, f"{kinds}, part int, idx bigint"), "merkle-leaves")
    runs = rows.groupBy("part", "grp").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({"first": F.coalesce(F.sum("n").over(before), F.lit(0)), "size": F.sum("n").over(Window.partitionBy("grp"))})
    return rows, settle(runs.withColumn("tallest", _height(F.col("size"))), "merkle-runs")


_NODE = "grp string, level int, place bigint, digest string, size bigint"


def _nodes_table(grp: str, size: int, found: list[tuple[int, int, str]]) -> pa.RecordBatch:
    levels, places, digests = zip(*found, strict=True) if found else ((), (), ())
    return pa.table({
        "grp": pa.array([grp] * len(found), pa.string()), "level": pa.array(levels, pa.int32()), "place": pa.array(places, pa.int64()),
        "digest": pa.array(digests, pa.string()), "size": pa.array([size] * len(found), pa.int64()),
    })


def _runs_of(rows: pa.Table, runs: pa.Table):
    """(run, leaves, positions in ``rows``) for each run of a partition."""
    places: dict[str, list[tuple[int, int]]] = {}
    for i, (g, idx) in enumerate(zip(rows.column("grp").to_pylist(), rows.column("idx").to_pylist(), strict=True)):
        places.setdefault(g, []).append((idx, i))
    leaves = rows.column("leaf").to_pylist()
    for run in runs.to_pylist():
        at = [i for _, i in sorted(places.get(run["grp"], []))]
        yield run, [leaves[i] for i in at], at


def _joined(top: int):
    def run(part: pa.Table) -> pa.Table:
        some = part.to_pylist()
        grp, size = some[0]["grp"], some[0]["size"]
        return _nodes_table(grp, size, complete({(r["level"], r["place"]): r["digest"] for r in some}, size, top))

    return run


def build(leaves: DataFrame, order: list[str]) -> Forest:
    """Trees over leaves (grp STRING, leaf STRING and more), one for each group, in the order of the named columns."""
    rows, runs = _place(leaves, order)

    def own(rows_part: pa.Table, runs_part: pa.Table) -> pa.Table:
        out = [_nodes_table(r["grp"], r["size"], climb(r["first"], x, r["size"])) for r, x, _ in _runs_of(rows_part, runs_part)]
        return pa.concat_tables(out) if out else _nodes_table("", 0, [])

    few = rows.select("part", "grp", "idx", "leaf").groupBy("part")
    nodes = settle(few.cogroup(runs.groupBy("part")).applyInArrow(own, _NODE), "merkle-nodes")
    tallest = runs.agg(F.max("tallest")).first()[0] or 0
    tables = [nodes]
    for top in range(ROUND_LEVELS, tallest + ROUND_LEVELS, ROUND_LEVELS):
        # nodes of these levels that partitions passed on, and the roots of the subtrees of the round before
        low = top - ROUND_LEVELS
        below = tables[0].where((F.col("level") < top) & (F.col("level") >= low))
        if low:
            below = below.unionByName(tables[-1].where(F.col("level") == low))
        subtree = F.expr(f"shiftright(place, {top} - level)")
        tables.append(settle(below.groupBy("grp", subtree.alias("subtree")).applyInArrow(_joined(top), _NODE), "merkle-nodes"))
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    roots = every.where(F.col("level") == _height(F.col("size"))).select("grp", F.col("digest").alias("root"))
    return Forest(rows, runs, every.select("grp", "level", "place", "digest"), roots)


def missing(runs: DataFrame) -> DataFrame:
    """(part, grp, level, place): the nodes that a run of leaves needs to reach the root and that do not follow from its own.

    On each level only the left neighbour of its first node and the right neighbour of its last can be such; they are if
    they are hashed together with it.
    """
    levels = runs.where("tallest > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("tallest") - 1)).alias("level"))
    low = F.expr("shiftright(first, level)")
    high = F.expr("shiftright(first + n - 1, level)")
    width = F.expr("shiftright(size + shiftleft(1L, level) - 1, level)")
    sides = F.array(F.when(low % 2 == 1, low - 1), F.when((high % 2 == 0) & (high + 1 < width), high + 1))
    return levels.select("part", "grp", "level", F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("place"))


def fetch(forest: Forest) -> DataFrame:
    """The runs with ``fetched``, their missing nodes; each is asked for once by a run."""
    asked = missing(forest.runs).join(forest.nodes, ["grp", "level", "place"])
    got = asked.groupBy("part", "grp").agg(F.collect_list(F.struct("level", "place", "digest")).alias("fetched"))
    return forest.runs.join(got, ["part", "grp"], "left")


def manifest(leaves: DataFrame) -> DataFrame:
    """Proofs of leaves (grp STRING, key, leaf STRING, claimed STRING): one row per leaf.

    Leaves of a group ascend by key, then leaf, then claim. Groups ascend by name, bytewise. Returned are grp, key, leaf,
    subroot (of its group), root, proof (array of siblings, from below, in the group and then above it) and folded_root, what
    the claimed leaf and the proof lead to. Keys may be null (first) and repeat, rows may be equal: each has its own place.
    An empty table gives an empty result.
    """
    leaves = settle(leaves.select("grp", "key", "leaf", "claimed", F.monotonically_increasing_id().alias("uid")), "merkle-rows")
    forest = build(leaves, ["key", "leaf", "claimed", "uid"])
    tops = forest.roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("leaf"))
    crown = build(settle(tops, "merkle-subroots"), ["name"])
    path_kind = "array<struct<left: int, digest: string>>"
    path_type = pa.list_(pa.struct([("left", pa.int32()), ("digest", pa.string())]))

    def spread(part: pa.Table, runs: pa.Table):
        """Row numbers of a run, and the paths of its leaves."""
        for run, run_leaves, at in _runs_of(part, runs):
            known = {(x["level"], x["place"]): x["digest"] for x in run["fetched"] or ()}
            levels = expand(run["first"], run_leaves, run["size"], known)
            yield run, levels[-1][1][0], at, (path_of(levels, run["first"] + i) for i in range(len(at)))

    def upper(part: pa.Table, runs: pa.Table) -> pa.Table:
        names, out = part.column("name").to_pylist(), []
        subroots = part.column("leaf").to_pylist()
        for _, root, at, paths in spread(part, runs):
            out += [(names[i], subroots[i], root, [{"left": a, "digest": b} for a, b in p]) for i, p in zip(at, paths, strict=True)]
        columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
        kinds = (pa.string(), pa.string(), pa.string(), path_type)
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("grp", "subroot", "root", "above"), columns, kinds, strict=True)})

    above = crown.rows.select("part", "grp", "idx", "name", "leaf").groupBy("part").cogroup(fetch(crown).groupBy("part"))
    above = settle(above.applyInArrow(upper, f"grp string, subroot string, root string, above {path_kind}"), "merkle-crown")
    kind = leaves.schema["key"].dataType.simpleString()

    def lower(part: pa.Table, runs: pa.Table) -> pa.Table:
        n = part.num_rows
        claimed = part.column("claimed").to_pylist()
        subroots, roots, proofs, folded = [None] * n, [None] * n, [None] * n, [None] * n
        for run, subroot, at, paths in spread(part, runs):
            if subroot != run["subroot"]:
                raise RuntimeError(f"nodes of {run['grp']} do not lead to its root")
            rest = [(x["left"], x["digest"]) for x in run["above"]]
            for i, path in zip(at, paths, strict=True):
                whole = path + rest
                subroots[i], roots[i], folded[i] = subroot, run["root"], fold(claimed[i], whole)
                proofs[i] = [x for _, x in whole if x]
        made = {"subroot": subroots, "root": roots, "proof": pa.array(proofs, pa.list_(pa.string())), "folded_root": folded}
        made = {c: v if isinstance(v, pa.Array) else pa.array(v, pa.string()) for c, v in made.items()}
        return pa.table({c: part.column(c) for c in ("grp", "key", "leaf")} | made)

    runs = fetch(forest).join(above, "grp")
    both = forest.rows.select("part", "grp", "idx", "key", "leaf", "claimed").groupBy("part").cogroup(runs.groupBy("part"))
    return both.applyInArrow(
        lower, f"grp string, key {kind}, leaf string, subroot string, root string, proof array<string>, folded_root string"
    )


def document_manifest(
    docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", key: str = "doc_id",
    claim: dict[str, Column] | None = None,
) -> DataFrame:
    """Manifest of a table: a leaf is H of its fields, a group has one value of ``group`` (null first), ordered by ``key``.

    ``claim`` replaces fields by other values in the leaf that is folded against the original proof, so it shows what the
    proof detects; null values of it stay null. Columns other than ``fields`` are not read. See ``manifest``.
    """
    claim = claim or {}
    plain = leaf_digest(*[F.col(c) for c in fields])
    other = leaf_digest(*[claim.get(c, F.col(c)) for c in fields]) if claim else plain
    # '!' stands before '+', so null comes before every name
    grp = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("!"))
    return manifest(docs.select(grp.alias("grp"), F.col(key).alias("key"), plain.alias("leaf"), other.alias("claimed")))
