"""The prefix trie of conversations, rolled up by centroids.

A node is a distinct sequence of first turns. Its key is the exclusive or of two 64-bit hashes of each turn's digest and
place, so a conversation's nodes are running sums of its turns and the parent's key is the node's without its last turn.
Running sums go in two steps (within blocks of turns, then over blocks), so that one very long conversation is split.

Sums over subtrees: the parent edges make a forest below the root. Each component is split at its centroid, the
deepest node with more than half of the component below it. The centroid's total is its own value and the totals of the
components below it; it is added along the path from the centroid to the component's top, so that a node's sum is its
total when it becomes a centroid and all that was added before. The parts, none with more than half of the nodes, go on. Components up to LOCAL_NODES are split in one task, many at a time; larger ones by joins, a
round for each halving: a node's ancestors are the earlier nodes of any conversation that it starts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import counted, materialise, small

#: Nodes up to which a component is split within a task, turns of a block, and rows that are worked on at a time.
LOCAL_NODES, BLOCK_TURNS, BATCH_ROWS = 50_000, 1024, 50_000
#: log2 of the numbers of conversations whose ids are joined before they are hashed.
_PIECE_BITS = 12
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_KEY, _PARENT, _TOP = ["a", "b"], ["pa", "pb"], ["ca", "cb"]


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 1 within the conversation), digest and n_bytes of every turn's role and text.

    Turns are ordered by turn (null first), then role and text; a null role or text is empty, and equal rows are turns of
    their own. Rows without a conv_id are left out. The rows are dealt out by ranges of that order, numbered within a
    range, and conversations that go over several ranges start from the turns before.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    digest = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", F.spark_partition_id().alias("part"), digest.alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))

    def number(batches):
        last, held = None, 0
        for rb in batches:
            ids = rb.column("conv_id").to_numpy()
            if not len(ids):
                continue
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            at = np.arange(1, len(ids) + 1) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
            if ids[0] == last:
                at[: starts[1] if len(starts) > 1 else len(ids)] += held
            last, held = ids[-1], int(at[-1])
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(at)], [*rb.schema.names, "at"])

    numbered = materialise(dealt.mapInArrow(number, "conv_id long, part int, digest string, n_bytes long, at long"))
    spans = numbered.groupBy("conv_id", "part").agg(F.max("at").alias("held"))
    before = F.sum("held").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    later, n = counted(spans.select("conv_id", "part", before.alias("earlier")).where("earlier is not null"))  # a row a range at most
    return numbered.join(small(later, n), ["conv_id", "part"], "left").select("conv_id", (F.col("at") + F.coalesce("earlier", F.lit(0))).alias("at"), "digest", "n_bytes")


def paths(turns: DataFrame) -> DataFrame:
    """Every conversation's nodes: conv_id, at, the node's key (a, b), its parent's (pa, pb), its tree's top (ca, cb), n_bytes of its last text.

    `turns` has conv_id, at (1, 2, ... without gaps), digest and n_bytes.
    """
    block = F.floor((F.col("at") - 1) / BLOCK_TURNS).alias("block")
    own = turns.select("conv_id", "at", "n_bytes", block, *[F.xxhash64(F.lit(i), "digest", "at").alias(f"h{c}") for i, c in enumerate(_KEY, 1)])
    totals = own.groupBy("conv_id", "block").agg(*[F.bit_xor(f"h{c}").alias(f"t{c}") for c in _KEY], *[F.min_by(f"h{c}", "at").alias(f"f{c}") for c in _KEY])
    along = Window.partitionBy("conv_id").orderBy("block")
    so_far = [F.bit_xor(f"t{c}").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias(f"t{c}") for c in _KEY]
    long_ones = turns.where(F.col("at") > BLOCK_TURNS).select("conv_id").distinct()
    starts, n = counted(totals.join(long_ones, "conv_id", "left_semi").select("conv_id", "block", *so_far, *[F.first(f"f{c}").over(along).alias(f"f{c}") for c in _KEY]).where("block > 0"))
    within = Window.partitionBy("conv_id", "block").orderBy("at")
    run = own.select("*", *[F.bit_xor(f"h{c}").over(within).alias(f"r{c}") for c in _KEY], *[F.first(f"h{c}").over(within).alias(f"o{c}") for c in _KEY])
    run = run.join(small(starts, n), ["conv_id", "block"], "left")
    key = [F.col(f"r{c}").bitwiseXOR(F.coalesce(F.col(f"t{c}"), F.lit(0).cast("long"))) for c in _KEY]
    parent = [k.bitwiseXOR(F.col(f"h{c}")) for k, c in zip(key, _KEY, strict=True)]
    top = [F.coalesce(F.col(f"f{c}"), F.col(f"o{c}")) for c in _KEY]
    return run.select("conv_id", "at", *[x.alias(c) for x, c in zip([*key, *parent, *top], [*_KEY, *_PARENT, *_TOP], strict=True)], "n_bytes")


def balanced_sums(parent: np.ndarray, depth: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of `values` (a row each) over the subtrees of a forest, given by each node's parent (-1 for a top), by centroids."""
    n, parent = len(parent), parent.copy()
    size = np.ones(n, np.int64)
    by_depth = np.argsort(-depth, kind="stable")
    for level in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1) if n else []:
        level = level[parent[level] >= 0]
        np.add.at(size, parent[level], size[level])
    sums, added, live = np.zeros_like(values), np.zeros_like(values), np.arange(n)
    while len(live):
        top = _tops(parent)
        heavy = live[2 * size[live] > size[top[live]]]
        heavy = heavy[np.lexsort((size[heavy], top[heavy]))]
        centre = heavy[np.concatenate([[True], top[heavy][1:] != top[heavy][:-1]])]
        is_centre = np.zeros(n, bool)
        is_centre[centre] = True
        tops = live[(parent[live] >= 0) & is_centre[np.maximum(parent[live], 0)]]  # of the components below centres
        above = parent[tops]
        parent[tops] = -1
        top = _tops(parent)
        live = live[~is_centre[live]]
        sums[:, centre] = values[:, centre]
        for k in range(len(values)):
            total = np.zeros(n, np.int64)
            np.add.at(total, top[live], values[k, live])
            np.add.at(sums[k], above, total[tops])
        path, of = parent[centre], centre
        while len(on := np.flatnonzero(path >= 0)):
            path, of = path[on], of[on]
            added[:, path] += sums[:, of]
            size[path] -= size[of]
            path = parent[path]
    return sums + added


def _tops(parent: np.ndarray) -> np.ndarray:
    """The top above each node, by pointer doubling."""
    top = np.where(parent < 0, np.arange(len(parent)), parent)
    while (further := top[top]).tobytes() != top.tobytes():
        top = further
    return top


def _local(forest: DataFrame) -> DataFrame:
    """a, b, n_leaves, saved_tokens: subtree sums within components, each whole in one task, by `balanced_sums`."""
    names = [*_TOP, *_KEY, *_PARENT, "depth", "leaf", "saved"]

    def work(columns: np.ndarray):
        key = lambda c: np.ascontiguousarray(c.T).view("V16").ravel()
        n = columns.shape[1]
        _, which = np.unique(np.concatenate([key(columns[2:4]), key(columns[4:6])]), return_inverse=True)
        place = np.full(2 * n, -1)
        place[which[:n]] = np.arange(n)
        parent = place[which[n:]]
        parent[(columns[:2] != columns[:2, parent]).any(0)] = -1  # in another component, or gone as a centre
        sums = balanced_sums(parent, columns[6], columns[7:9])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns[2:4], *sums)], [*_KEY, "n_leaves", "saved_tokens"])

    def batches(it):
        held = np.zeros((len(names), 0), np.int64)
        for rb in it:
            held = np.concatenate([held, np.array([rb.column(c).to_numpy() for c in names]).reshape(len(names), -1)], axis=1)
            if held.shape[1] >= BATCH_ROWS:
                last = int(np.argmax((held[:2] == held[:2, -1:]).all(0)))  # where the last component begins
                if last:
                    yield work(held[:, :last])
                    held = held[:, last:]
        if held.shape[1]:
            yield work(held)

    return forest.select(*names).repartition(*_TOP).sortWithinPartitions(*_TOP).mapInArrow(batches, "a long, b long, n_leaves long, saved_tokens long")


def _on(left: list[str], right: list[str]) -> Column:
    return (F.col(left[0]) == F.col(right[0])) & (F.col(left[1]) == F.col(right[1]))


def _named(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    return frame.select(*[F.col(c).alias(name) for name, c in columns.items()])


def _halved(forest: DataFrame, along: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Split components of more than `most` nodes at their centroids until none is left: the remaining nodes and the sums of the centroids.

    `along` has the paths of the components' conversations. Remaining nodes have in more_leaves and more_saved what the
    centroids removed below them add.
    """
    # a conversation starts the nodes of a range of depths: those below a node are counted without a walk
    started = forest.groupBy("conv_id").agg(F.min("depth").alias("d0"), F.max("depth").alias("d1"))
    below = along.join(started, "conv_id").where("at <= d1").groupBy(*_KEY).agg(F.sum(F.col("d1") - F.greatest("d0", "at") + 1).alias("size"))
    zero = F.lit(0).cast("long")
    nodes, done = materialise(forest.join(below, _KEY).withColumns({"more_leaves": zero, "more_saved": zero})), None
    while True:
        sizes, n = counted(nodes.groupBy(*_TOP).agg(F.count(F.lit(1)).alias("n"), F.min("depth").alias("d_top")).where(F.col("n") > most))
        if not n:
            return nodes, done
        heavy = nodes.join(small(sizes, n), _TOP).where(2 * F.col("size") > F.col("n"))
        centre = heavy.groupBy(*_TOP, "d_top").agg(F.min_by(F.struct(*_KEY, "depth", "conv_id", "size", "leaf", "saved", "more_leaves", "more_saved"), "size").alias("z"))
        centre = materialise(centre.select(*_TOP, "d_top", *[F.col(f"z.{c}").alias(f"z_{c}") for c in (*_KEY, "depth", "conv_id", "size", "leaf", "saved", "more_leaves", "more_saved")]))
        # conversations through a centre, and the child that each goes on to
        on_to = along.join(small(_named(centre, {"za": "z_a", "zb": "z_b", "zt_a": "ca", "zt_b": "cb", "z_depth": "z_depth"}), n), _on(_PARENT, ["za", "zb"]))
        on_to = _named(on_to, {"o_conv": "conv_id", "o_a": "a", "o_b": "b", "zt_a": "zt_a", "zt_b": "zt_b", "z_depth": "z_depth"})
        parted = nodes.join(on_to, _on(_TOP, ["zt_a", "zt_b"]) & (F.col("conv_id") == F.col("o_conv")) & (F.col("depth") > F.col("z_depth")), "left")
        parted = materialise(parted.drop("o_conv", "z_depth"))
        totals = parted.where("o_a is not null").groupBy("zt_a", "zt_b").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saves"))
        centre = centre.join(small(totals, n), _on(_TOP, ["zt_a", "zt_b"]), "left").withColumns({c: F.col(f"z_{own}") + F.coalesce(s, zero) for c, own, s in (("n_leaves", "leaf", "leaves"), ("saved_tokens", "saved", "saves"))})
        centre = materialise(centre.select("z_a", "z_b", "z_conv_id", "z_depth", "z_size", "d_top", "z_more_leaves", "z_more_saved", "n_leaves", "saved_tokens"))
        up = along.join(small(centre, n), (F.col("conv_id") == F.col("z_conv_id")) & (F.col("at") < F.col("z_depth")) & (F.col("at") >= F.col("d_top")))
        up = _named(up, {"a": "a", "b": "b", "u_size": "z_size", "u_leaves": "n_leaves", "u_saved": "saved_tokens"})
        gone = _named(centre, {"a": "z_a", "b": "z_b"})
        parted = parted.join(small(gone, n), _KEY, "left_anti").join(up, _KEY, "left")
        less = {"size": F.col("size") - F.coalesce("u_size", zero), "more_leaves": F.col("more_leaves") + F.coalesce("u_leaves", zero), "more_saved": F.col("more_saved") + F.coalesce("u_saved", zero)}
        nodes = materialise(parted.withColumns(less | {"ca": F.coalesce("o_a", "ca"), "cb": F.coalesce("o_b", "cb")}).select(*nodes.columns))
        sums = centre.select(F.col("z_a").alias("a"), F.col("z_b").alias("b"), (F.col("n_leaves") + F.col("z_more_leaves")).alias("n_leaves"), (F.col("saved_tokens") + F.col("z_more_saved")).alias("saved_tokens"))
        done = sums if done is None else done.union(sums)


def rollup(forest: DataFrame, along: DataFrame, most: int = LOCAL_NODES) -> DataFrame:
    """a, b, n_leaves and saved_tokens of every node of a forest: the sums of `leaf` and `saved` over its subtree.

    `forest` has a, b, pa, pb, ca, cb (the top of the node's tree), depth, conv_id (a conversation through the node, the
    same for a node and the next one down that it starts), leaf and saved; `along` has the `paths` of its conversations.
    """
    large, n = counted(forest.groupBy(*_TOP).count().where(F.col("count") > most).select(*_TOP))
    if not n:
        return _local(forest)
    rest, done = _halved(forest.join(small(large, n), _TOP, "left_semi"), along.join(small(large, n), _TOP, "left_semi"), most)
    more = rest.select(*_KEY, "more_leaves", "more_saved")
    within = _local(rest.select(*forest.columns)).join(more, _KEY).select(*_KEY, (F.col("n_leaves") + F.col("more_leaves")).alias("n_leaves"), (F.col("saved_tokens") + F.col("more_saved")).alias("saved_tokens"))
    return _local(forest.join(small(large, n), _TOP, "left_anti")).union(within).union(done)


def ends_digest(ends: DataFrame) -> DataFrame:
    """a, b and the SHA-256 of the conv_ids of each node's ends, ascending, by commas.

    Ids are joined in pieces of at most 4096 neighbours; a task passes a node's pieces through the hash one by one.
    """
    piece = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = ends.groupBy(*_KEY, F.shiftright("conv_id", _PIECE_BITS).alias("at")).agg(piece.alias("ids"))

    def batches(it):
        last, state = None, None
        for rb in it:
            out = []
            for a, b, ids in zip(*[rb.column(c).to_pylist() for c in (*_KEY, "ids")], strict=True):
                if (a, b) == last:
                    state.update(b",")
                else:
                    if last:
                        out.append((*last, state.hexdigest()))
                    last, state = (a, b), hashlib.sha256()
                state.update(ids.encode())
            yield _rows(out)
        if last:
            yield _rows([(*last, state.hexdigest())])

    def _rows(rows):
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], [*_KEY, "ends_sha256"])

    return pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "at").select(*_KEY, "ids").mapInArrow(batches, "a long, b long, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame, most: int = LOCAL_NODES) -> DataFrame:
    """One row per node of the trie of the conversations.

    `lengths` has conv_id and n_turns of every conversation, once each, those without turns too; `turns` has conv_id, at
    (1 to n_turns), digest and n_bytes. conv_id is a node's smallest member, n_convs its members; n_leaves counts
    childless nodes of its subtree and saved_tokens sums (n_convs - 1) * n_bytes over it, both with the node itself;
    ends_sha256 is of the members that end there. The root's parent is null. No conversation, no node.
    """
    spark = turns.sparkSession
    along = materialise(paths(turns).join(lengths.select("conv_id", "n_turns"), "conv_id"))
    nodes = materialise(along.groupBy(*_KEY, *_PARENT, *_TOP, F.col("at").alias("depth"), "n_bytes").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")))
    zero = F.lit(0).cast("long")
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).first()
    ends = along.where("at = n_turns").select(*_KEY, "conv_id").union(lengths.where("n_turns = 0").select(zero, zero, "conv_id"))
    children = nodes.groupBy(*[F.col(p).alias(k) for p, k in zip(_PARENT, _KEY, strict=True)]).agg(F.count(F.lit(1)).alias("n_children"))
    names = _named(nodes, {"pa": "a", "pb": "b", "parent_conv_id": "conv_id"})
    nodes = nodes.join(children, _KEY, "left").join(names, _PARENT, "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", F.lit(root["conv_id"]).cast("long")))
    nodes = materialise(nodes.withColumns({"n_children": F.coalesce("n_children", zero), "leaf": F.col("n_children").isNull().cast("long"), "saved": (F.col("n_convs") - 1) * F.col("n_bytes")}))
    rolled = nodes.join(rollup(nodes, along, most), _KEY)
    rolled = materialise(rolled.select(*_KEY, "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"))
    sums = rolled.where("depth = 1").agg(F.count(F.lit(1)).alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), zero).alias("saved_tokens"))
    top = sums.where(F.lit(root["n_convs"] > 0)).select(zero.alias("a"), zero.alias("b"), F.lit(root["conv_id"]).cast("long").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(root["n_convs"]).cast("long").alias("n_convs"), "n_children", "n_leaves", "saved_tokens")
    every = rolled.union(top).join(ends_digest(ends), _KEY, "left")
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"))
