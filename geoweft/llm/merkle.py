"""Merkle manifest of a dataset: a tree per group of rows, a tree over the groups' roots, inclusion proofs, verification.

1. Each row becomes a leaf digest where it lies; only (group, id, digest) move, dealt by range in the order of the trees.
   Per-partition counts give each leaf its index, each tree its size and each group its rank; no group is gathered.
2. Digests are events. A task keeps partial parents: children by index, until the arity that follows from the tree's size
   is met. Then the parent is an event of the level above; a tree's root is an event of the tree over all roots.
3. What a task can't settle, the children of parents that other tasks hold parts of, is its frontier, about four digests a
   level. Frontiers shuffle to blocks of STEP more levels each round and are combined there in the same way, till one root
   is left. A block has about ARITY ** STEP events at most, whatever the size of a group.
4. Reverse links: back through the rounds, every frontier digest gets its chain, the siblings from itself to the root, from
   the chains of what its own block had left. A leaf's proof is the chain within its task and then that of the frontier.

Defined results: rows of one group and id follow each other by leaf digest, equal rows are leaves of their own; null groups
come first, null ids come first in their group; null fields are `-`; an empty table gives no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweft.llm._common import blob_partitions, cut

ARITY = 3
STEP = 9
LEAVES_PER_TASK = 1 << 15
#: The tree over the roots of all groups; groups' trees have their rank as number.
TOP = -1
#: Frontiers of the tasks over leaves come from blocks of this tree, numbered as the tasks.
TASKS = -2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
EVENTS = "home_tree long, home_block long, tree long, level int, index long, size long, rank long, digest binary, pos long"
CHAINS = "home_tree long, home_block long, tree long, level int, index long, chain binary, subroot binary"


def encoded(value: Column) -> Column:
    """A field as text: its UTF-8 bytes behind their number, `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Iterable[Column]) -> Column:
    """SHA-256 of the encoded fields, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[encoded(f) for f in fields]), 256))


def node_digest(children: Iterable[bytes]) -> bytes:
    """SHA-256 of the children's digests as lowercase hex text."""
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


def width(size: int, level: int) -> int:
    """Nodes of a level of a tree of `size` leaves."""
    return -(-size // ARITY**level)


@dataclass
class Ascent:
    """Events run to their end: the parents that were met, what is left, and the root if it was reached."""

    parents: dict[tuple, tuple[list[bytes], bytes]] = field(default_factory=dict)
    left: list[tuple] = field(default_factory=list)
    root: bytes | None = None


def ascend(events: Iterable[tuple], groups: int) -> Ascent:
    """Combines events (tree, level, index, size, rank, digest); `groups` is the size of the top tree."""
    out, partial = Ascent(), {}
    for first in events:
        event = first
        while event:
            tree, level, index, size, rank, digest = event
            event = None
            nodes = width(size, level)
            if nodes > 1:
                key = (tree, level, index // ARITY)
                kids = partial.setdefault(key, {})
                kids[index % ARITY] = (digest, size, rank)
                if len(kids) == min(ARITY, nodes - ARITY * key[2]):
                    del partial[key]
                    digests = [kids[k][0] for k in range(len(kids))]
                    out.parents[key] = digests, node_digest(digests)
                    event = tree, level + 1, key[2], size, rank, out.parents[key][1]
            elif tree != TOP:
                event = TOP, 0, rank, groups, TOP, digest
            else:
                out.root = digest
    out.left = [(tree, level, ARITY * up + k, size, rank, digest) for (tree, level, up), kids in partial.items() for k, (digest, size, rank) in kids.items()]
    return out


def descend(events: Sequence[tuple], ascent: Ascent, given: dict[tuple, tuple[bytes, bytes]], groups: int) -> list[tuple[bytes, bytes]]:
    """For each event its chain and its tree's root, from the parents met here and the chains given for what was left.

    A chain has, level by level: the place among its parent's children, their number, the digests of the others.
    """
    known = dict(given)

    def chain(tree: int, level: int, index: int, size: int, rank: int, digest: bytes) -> tuple[bytes, bytes]:
        found = known.get((tree, level, index))
        if found is None:
            if width(size, level) > 1:
                kids, up = ascent.parents[tree, level, index // ARITY]
                k = index % ARITY
                rest, subroot = chain(tree, level + 1, index // ARITY, size, rank, up)
                found = bytes([k, len(kids)]) + b"".join(kids[:k] + kids[k + 1 :]) + rest, subroot
            else:
                found = (b"", b"") if tree == TOP else (chain(TOP, 0, rank, groups, TOP, digest)[0], digest)
            known[tree, level, index] = found
        return found

    return [chain(*e) for e in events]


def steps(chain: bytes) -> list[tuple[int, list[bytes]]]:
    """(place, siblings' digests) of each level."""
    out, at = [], 0
    while at < len(chain):
        k, n = chain[at], chain[at + 1]
        out.append((k, [chain[at + 2 + 32 * i : at + 34 + 32 * i] for i in range(n - 1)]))
        at += 2 + 32 * (n - 1)
    return out


def fold(leaf: bytes, chain: bytes) -> bytes:
    """The root that a leaf's digest leads to with the siblings of a chain."""
    for k, siblings in steps(chain):
        leaf = node_digest([*siblings[:k], leaf, *siblings[k:]])
    return leaf


def _table(rows: Sequence[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    named = [c.split() for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in named]
    return pa.table({n: pa.array(c, kinds[t]) for (n, t), c in zip(named, columns, strict=True)})


def _columns(table: pa.Table, *names: str) -> list[tuple]:
    """Rows of the named columns; the empty side of a cogroup has no columns."""
    return list(zip(*(table.column(n).to_pylist() for n in names), strict=True)) if table.num_rows else []


def _event_rows(home: tuple[int, int], left: Iterable[tuple]) -> list[tuple]:
    return [(*home, *e, e[2] * ARITY ** e[1]) for e in left]


@dataclass(frozen=True)
class Manifest:
    """leaves: (part, grp, doc_id, leaf, claimed); places: (task, of, start, size, rank), a row for each
    task and group; frontiers: EVENTS, by round."""

    leaves: DataFrame
    places: DataFrame
    frontiers: list[DataFrame]
    groups: int
    root: str | None


def _leaf_events(leaves: pa.Table, places: list[tuple]) -> list[tuple]:
    """Events of one task's leaves, in their order; places: (grp, start, size, rank) of the groups it holds."""
    at = {g: [start, size, rank] for g, start, size, rank in places}
    out = []
    for g, digest in _columns(leaves, "grp", "leaf"):
        place = at[g]
        out.append((place[2], 0, place[0], place[1], place[2], digest))
        place[0] += 1
    return out


def _ordered(leaves: pa.Table) -> pa.Table:
    return leaves.sort_by([("nth", "ascending")])


def build(docs: DataFrame, *, group_col: str = "source", id_col: str = "doc_id", fields: Sequence[str] = FIELDS, claimed: Column | None = None) -> Manifest:
    """The trees over docs. claimed: for each row the leaf digest that verify() is to test, by default that of the row."""
    leaf = leaf_digest(F.col(f) for f in fields)
    rows = docs.select(F.col(group_col).cast("string").alias("grp"), F.col(id_col).alias("doc_id"), leaf.alias("leaf"), (leaf if claimed is None else claimed).alias("claimed"))
    rows = cut(rows.withColumn("own", F.monotonically_increasing_id()))  # `own` lets equal rows be dealt to several tasks
    count = rows.count()
    order = ["grp", "doc_id", "leaf", "own"]
    dealt = rows.repartitionByRange(blob_partitions(count, LEAVES_PER_TASK), *order).sortWithinPartitions(*order)
    leaves = cut(dealt.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("nth"), "grp", "doc_id", "leaf", "claimed"))
    here = cut(leaves.groupBy("part", "grp").agg(F.count(F.lit(1)).alias("n")))  # a row per task and one per group
    whole = Window.partitionBy("grp")
    placed = here.select("part", "grp", (F.sum("n").over(whole.orderBy("part")) - F.col("n")).alias("start"), F.sum("n").over(whole).alias("size"), "n")
    fresh = placed.groupBy("part").agg(F.count_if(F.col("start") == 0).alias("fresh"))  # a row per task
    before = fresh.select("part", (F.sum("fresh").over(Window.orderBy("part")) - F.col("fresh")).alias("before"))
    own = F.sum((F.col("start") == 0).cast("long")).over(Window.partitionBy("part").orderBy("grp")) - 1
    places = placed.join(before, "part").select(F.col("part").alias("task"), F.col("grp").alias("of"), "start", "size", (F.col("before") + own).alias("rank"))
    places = cut(places)  # named unlike the leaves' columns, as the two meet in cogroups
    groups = (places.agg(F.max("rank")).first()[0] if count else None) or 0
    groups += 1 if count else 0

    def first(key: tuple, held: pa.Table, own_places: pa.Table) -> pa.Table:
        if not held.num_rows:
            return _table([], EVENTS)
        up = ascend(_leaf_events(_ordered(held), _columns(own_places, "of", "start", "size", "rank")), groups)
        return _table(_found((TASKS, key[0].as_py()), up), EVENTS)

    frontiers = [cut(leaves.groupBy("part").cogroup(places.groupBy("task")).applyInArrow(first, EVENTS))]
    while not (root := frontiers[-1].filter(f"tree = {TOP} AND level < 0").select("digest").first()) and count:
        frontiers.append(cut(_blocks(frontiers[-1], len(frontiers)).groupBy("tree", "block").applyInArrow(_round(groups), EVENTS)))
    return Manifest(leaves, places, frontiers, groups, bytes(root.digest).hex() if root else None)


def _found(home: tuple[int, int], up: Ascent) -> list[tuple]:
    """What a block has left; the root is a row of level -1."""
    return _event_rows(home, up.left) + ([(*home, TOP, -1, 0, 1, TOP, up.root, 0)] if up.root else [])


def _blocks(events: DataFrame, number: int) -> DataFrame:
    """Events with the block in which round `number` combines them."""
    return events.filter("level >= 0").withColumn("block", F.expr(f"pos div {ARITY ** min(STEP * number, 38)}L"))


def _round(groups: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, held: pa.Table) -> pa.Table:
        return _table(_found((key[0].as_py(), key[1].as_py()), ascend(_columns(held, "tree", "level", "index", "size", "rank", "digest"), groups)), EVENTS)

    return run


def _chains(manifest: Manifest) -> DataFrame | None:
    """CHAINS of the first frontier: reverse links through the rounds, from the last one back."""
    groups, chains = manifest.groups, None

    def back(key: tuple, held: pa.Table, given: pa.Table) -> pa.Table:
        events = _columns(held, "tree", "level", "index", "size", "rank", "digest")
        known = {x[:3]: x[3:] for x in _columns(given, "tree", "level", "index", "chain", "subroot")}
        found = descend(events, ascend(events, groups), known, groups)
        homes = _columns(held, "home_tree", "home_block")
        return _table([(*h, *e[:3], *c) for h, e, c in zip(homes, events, found, strict=True)], CHAINS)

    for number in range(len(manifest.frontiers) - 1, 0, -1):
        events = _blocks(manifest.frontiers[number - 1], number)
        given = events.sparkSession.createDataFrame([], CHAINS) if chains is None else chains
        chains = cut(events.groupBy("tree", "block").cogroup(given.groupBy("home_tree", "home_block")).applyInArrow(back, CHAINS))
    return chains


def proofs(manifest: Manifest, *, chains: bool = False) -> DataFrame:
    """One row per leaf: doc_id, leaf, subroot, root, proof_sha256 (over the siblings' hex digests, leaf to root),
    folded_root (from the claimed leaf and the proof) and verified, that is, whether it is the root. chains: with the proof
    itself as `chain`, see steps()."""
    groups, root = manifest.groups, manifest.root or ""
    given = _chains(manifest)
    places = manifest.places.select("task", "of", "start", "size", "rank", *[F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in CHAINS.split(", ")[2:])])
    if given is not None:
        held = [F.lit(None).cast(t).alias(n) for n, t in (("of", "string"), ("start", "long"), ("size", "long"), ("rank", "long"))]
        places = places.unionByName(given.select(F.col("home_block").cast("int").alias("task"), *held, "tree", "level", "index", "chain", "subroot"))
    kind = manifest.leaves.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, chain binary"

    def run(held: pa.Table, beside: pa.Table) -> pa.Table:
        held = _ordered(held)
        rows = _columns(beside, "of", "start", "size", "rank", "tree", "level", "index", "chain", "subroot")
        events = _leaf_events(held, [r[:4] for r in rows if r[4] is None])
        known = {r[4:7]: r[7:] for r in rows if r[4] is not None}
        out: dict[str, list] = {n: [] for n in ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "chain")}
        for (chain, subroot), leaf, claim in zip(descend(events, ascend(events, groups), known, groups), *(held.column(c).to_pylist() for c in ("leaf", "claimed")), strict=True):
            folded = fold(claim, chain).hex()
            proof = node_digest(s for _, siblings in steps(chain) for s in siblings).hex()
            for n, v in zip(out, (leaf.hex(), subroot.hex(), root, proof, folded, folded == root, chain if chains else None), strict=True):
                out[n].append(v)
        types = {"verified": pa.bool_(), "chain": pa.binary()}
        return pa.table({"doc_id": held.column("doc_id"), **{n: pa.array(v, types.get(n, pa.string())) for n, v in out.items()}})

    found = manifest.leaves.groupBy("part").cogroup(places.groupBy("task")).applyInArrow(run, schema)
    return found if chains else found.drop("chain")
