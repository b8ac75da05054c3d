"""A trie of conversation prefixes with totals per subtree, by time-forward processing.

Nodes are distinct sequences of first turns.  A node is named by sums of hashes of (place, role, text) over its turns, 128 bits wide, so names are running sums,
which are taken within blocks of a conversation and over its blocks: a conversation of any length is spread over many tasks.

Totals pass from children to parents in reverse level order: nodes are sorted from the deepest level up, each sends what it has gathered to its parent through a priority
queue that is ordered like the nodes and spills sorted runs, so a parent finds all that was sent to it when its turn comes.  This runs within shards: subtrees that
cannot have more than a bounded number of nodes.  The roots of the shards send their totals on to the nodes above, which are a smaller trie: its shards follow in the next
round, and so on until the root of all is in one.  A round cuts off the last SHARD_NODES turns of any path at least.

Cases: rows without a conversation number are left out; turns go by number, null first, then by role and text; a null role or text is empty; repeated rows are turns of
their own; very long texts are hashed whole; conversations without turns count for the root; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeworks.llm import common

#: Turns of one conversation that are put in order in one task.
BLOCK = 256
#: A shard has at most so many nodes; a queue holds at most so many totals in memory.
SHARD_NODES, QUEUE_TOTALS = 100_000, 20_000
#: The query's conversations: base of a family, and the most turns taken from it.
FAMILY, MOST_HEAD = 100, 6
NODE, PARENT = ["a", "b"], ["pa", "pb"]
TOTALS = "a long, b long, pa long, pb long, is_root boolean, n_leaves long, saved_tokens long"


class SpillingQueue:
    """A priority queue of (key, values) in the order of keys; what is beyond its room goes to sorted runs in unnamed files."""

    def __init__(self, room: int = QUEUE_TOTALS):
        self.room, self.heap, self.runs = room, [], []

    def push(self, key: tuple, values: tuple) -> None:
        if len(self.heap) >= self.room:
            run = tempfile.TemporaryFile()
            for entry in sorted(self.heap):
                pickle.dump(entry, run)
            run.seek(0)
            # Each run takes part with its first entry.
            self.heap, entry = [], pickle.load(run)
            heapq.heappush(self.runs, (*entry, len(self.runs), run))
        heapq.heappush(self.heap, (key, values))

    def _least_run(self) -> bool:
        return bool(self.runs) and (not self.heap or self.runs[0][:2] < self.heap[0])

    def take(self, key: tuple) -> Iterator[tuple]:
        """Removes and gives the values of all entries of the key, which is the least one there or less."""
        while True:
            if self._least_run():
                found, values, number, run = self.runs[0]
                if found != key:
                    return
                try:
                    heapq.heapreplace(self.runs, (*pickle.load(run), number, run))
                except EOFError:
                    heapq.heappop(self.runs)
                    run.close()
                yield values
            elif self.heap and self.heap[0][0] == key:
                yield heapq.heappop(self.heap)[1]
            else:
                return


def _blocks_before(rows: DataFrame, block: str, values: dict[str, Column]) -> DataFrame:
    """Per conversation and block the sums over the blocks before it, where there are any."""
    sums = rows.groupBy("conv", block).agg(*(v.alias(k) for k, v in values.items()))
    before = W.partitionBy("conv").orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    return sums.select("conv", block, *(F.sum(k).over(before).alias(f"{k}_before") for k in values)).where(F.col(f"{next(iter(values))}_before").isNotNull())


def ordered(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 0, by turn, role and text), digest of role and text, points (code points of the text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    spelled = F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    # Of blocks of turn numbers, nulls are the first.
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).cast("long")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), block.alias("block"), role.alias("role"), text.alias("text"),
        F.unhex(F.sha2(spelled, 256)).alias("digest"), F.length(text).cast("long").alias("points"),
    )
    inside = W.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    kept = common.written(rows.withColumn("place", F.row_number().over(inside) - 1).select("conv", "block", "place", "digest", "points"), "turns")
    before = _blocks_before(kept, "block", {"n": F.count("*")})
    pos = F.coalesce("n_before", F.lit(0).cast("long")) + F.col("place")
    return kept.join(before, ["conv", "block"], "left").select("conv", pos.alias("pos"), "digest", "points")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The query's families: every conversation takes the first turns of its base.  Conversations (conv, length), and their turns (conv, depth, digest, points)."""
    head = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(MOST_HEAD))
    convs = turns.groupBy("conv").agg(F.count("*").alias("n")).withColumn("head", head).withColumn("base", F.col("conv") - F.col("conv") % FAMILY)
    bases = convs.where(F.col("conv") == F.col("base")).select("base", F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("head", F.coalesce("base_n", F.lit(0).cast("long"))))
    convs = convs.withColumn("length", F.col("taken") + F.greatest(F.lit(0).cast("long"), F.col("n") - F.col("head")))
    convs = common.written(convs.select("conv", "base", "n", "head", "taken", "length"), "conversations")
    first = turns.where((F.col("pos") < MOST_HEAD) & (F.col("conv") % FAMILY == 0)).withColumnRenamed("conv", "base")
    # A base has at most two times FAMILY conversations, and few turns are taken.
    heads = convs.join(first, "base").where(F.col("pos") < F.col("head")).select("conv", (F.col("pos") + 1).alias("depth"), "digest", "points")
    own = _with_conversation(turns, convs.select("conv", "head", "taken")).where(F.col("pos") >= F.col("head"))
    own = own.select("conv", (F.col("taken") + F.col("pos") - F.col("head") + 1).alias("depth"), "digest", "points")
    return convs.select("conv", "length"), heads.unionByName(own)


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations and their turns, unchanged."""
    return turns.groupBy("conv").agg(F.count("*").alias("length")), turns.select("conv", (F.col("pos") + 1).alias("depth"), "digest", "points")


def _with_conversation(rows: DataFrame, convs: DataFrame) -> DataFrame:
    return common.join_hot(common.written(rows, "by-conversation"), convs, ["conv"])


def paths(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv, depth, length, name of the prefix (a, b) and of the one before it (pa, pb), points of its last turn; the root of every conversation included."""
    hashes = [F.xxhash64(F.lit(seed), F.col("depth"), F.col("digest")) for seed in (1, 2)]
    # In halves, so that their sums stay within a long.
    parts = [half for h in hashes for half in (F.shiftrightunsigned(h, 32), h.bitwiseAND(0xFFFFFFFF))]
    names = [f"s{k}" for k in range(4)]
    rows = turns.select("conv", "depth", "points", F.floor((F.col("depth") - 1) / BLOCK).alias("block"), *(p.alias(n) for p, n in zip(parts, names, strict=True)))
    rows = common.written(rows, "hashes")
    before = _blocks_before(rows, "block", {n: F.sum(n) for n in names})
    upto = W.partitionBy("conv", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select("conv", "depth", "points", "block", *names, *(F.sum(n).over(upto).alias(f"{n}_upto") for n in names))
    rows = rows.join(before, ["conv", "block"], "left")
    now = [F.coalesce(f"{n}_before", F.lit(0).cast("long")) + F.col(f"{n}_upto") for n in names]
    rows = rows.select("conv", "depth", "points", *_name(now, NODE), *_name([v - F.col(n) for v, n in zip(now, names, strict=True)], PARENT))
    rows = _with_conversation(rows, convs)
    nothing = [F.lit(0).cast("long")] * 4
    none = F.lit(None).cast("long")
    root = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("points"), *_name(nothing, NODE), none.alias("pa"), none.alias("pb"), "length")
    return common.written(rows.unionByName(root), "paths")


def _name(sums: list[Column], names: list[str]) -> list[Column]:
    return [F.xxhash64(F.lit(k), *sums).alias(n) for k, n in enumerate(names)]


def ends(rows: DataFrame) -> DataFrame:
    """Per node at which conversations end: a digest of their numbers.  Numbers pass in their order, so a node of any number of conversations takes no memory."""

    def digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = digest = None
        for batch in batches:
            out = []
            for a, b, conv in zip(batch["a"].tolist(), batch["b"].tolist(), batch["conv"].tolist(), strict=True):
                if (a, b) != now:
                    if now:
                        out.append((*now, digest.hexdigest()))
                    now, digest = (a, b), hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            yield pd.DataFrame(out, columns=["a", "b", "ends_sha256"])
        if now:
            yield pd.DataFrame([(*now, digest.hexdigest())], columns=["a", "b", "ends_sha256"])

    last = rows.where(F.col("depth") == F.col("length")).select("a", "b", "conv")
    return last.repartition(*NODE).sortWithinPartitions("a", "b", "conv").mapInPandas(digested, "a long, b long, ends_sha256 string")


def time_forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Totals of the nodes of whole shards, which come one after the other, deepest level first."""
    shard, queue = None, SpillingQueue()
    for batch in batches:
        out = []
        for ra, rb, depth, a, b, pa, pb, leaves, saved in batch.itertuples(index=False, name=None):
            if (ra, rb) != shard:
                shard, queue = (ra, rb), SpillingQueue()
            for more_leaves, more_saved in queue.take((-depth, a, b)):
                leaves, saved = leaves + more_leaves, saved + more_saved
            is_root = (a, b) == shard
            if not is_root:
                queue.push((1 - depth, pa, pb), (leaves, saved))
            out.append((a, b, pa, pb, is_root, leaves, saved))
        yield pd.DataFrame(out, columns=["a", "b", "pa", "pb", "is_root", "n_leaves", "saved_tokens"])


def subtree_totals(nodes: DataFrame, rows: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """a, b, n_leaves, saved_tokens.  nodes: a, b, pa, pb, depth, conv (one that passes), leaves, saved, beneath (a bound on the paths through it and on its nodes); rows: paths of at least those."""
    done = []
    while True:
        low = nodes.where(F.col("beneath") <= shard_nodes)
        high = common.written(nodes.where(F.col("beneath") > shard_nodes), "high")
        n_high = high.count()
        # The root of all has no parent; pandas would make fractions of names next to a null.
        columns = ["depth", "a", "b", *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in PARENT), "leaves", "saved"]
        if n_high:
            # A shard starts below a node that is too large.  Its paths are those of its bound, and a conversation passes one such start.
            above = high.select(F.col("a").alias("pa"), F.col("b").alias("pb"))
            below = common.written(low.select("a", "b", "pa", "pb"), "low")
            tops = (below.join(F.broadcast(above), PARENT) if n_high <= common.BROADCAST_ROWS else common.join_hot(below, above, PARENT)).select(NODE)
            of = rows.join(tops, NODE).select("conv", F.col("a").alias("ra"), F.col("b").alias("rb")).distinct()
            shards = low.join(of, "conv").select("ra", "rb", *columns)
        else:
            shards = low.select(*_name([F.lit(0).cast("long")] * 4, ["ra", "rb"]), *columns)
        shards = shards.repartition("ra", "rb").sortWithinPartitions("ra", "rb", F.desc("depth"), "a", "b")
        totals = common.written(shards.mapInPandas(time_forward, TOTALS), "totals")
        done.append(totals.select("a", "b", "n_leaves", "saved_tokens"))
        if not n_high:
            out = done[0]
            for more in done[1:]:
                out = out.unionByName(more)
            return out
        sent = totals.where("is_root").groupBy(*PARENT).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        sent = sent.withColumnsRenamed({"pa": "a", "pb": "b"})
        nothing = F.lit(0).cast("long")
        gathered = high.join(sent, NODE, "left").withColumns({"leaves": F.col("leaves") + F.coalesce("more_leaves", nothing), "saved": F.col("saved") + F.coalesce("more_saved", nothing)})
        # Of the smaller trie, the paths to its leaves tell how much is beneath a node.
        leaf = high.join(high.select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), NODE, "left_anti").select("conv", F.col("depth").alias("length"))
        rows = common.written(rows.drop("length").join(leaf, "conv").where(F.col("depth") <= F.col("length")), "paths-above")
        beneath = rows.groupBy(*NODE).agg(F.sum(F.col("length") - F.col("depth") + 1).alias("beneath"), F.min("conv").alias("conv"))
        nodes = common.written(gathered.drop("beneath", "conv", "more_leaves", "more_saved").join(beneath, NODE), "nodes-above")


def trie(conversations: DataFrame, build=as_they_are, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    build makes conversations and turns of the ordered ones; a turn's saved tokens are its code points, once for each conversation but one that shares it."""
    rows = paths(*build(common.written(ordered(conversations), "ordered")))
    found = rows.groupBy(*NODE).agg(
        F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("depth").alias("depth"), F.min("conv").alias("conv"), F.count("*").alias("n_convs"),
        ((F.count("*") - 1) * F.min("points")).alias("saved"), F.sum(F.col("length") - F.col("depth") + 1).alias("beneath"),
    )
    found = common.written(found, "nodes")
    children = found.where(F.col("pa").isNotNull()).groupBy(*PARENT).agg(F.count("*").alias("n_children")).withColumnsRenamed({"pa": "a", "pb": "b"})
    counted = found.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    counted = common.written(counted.withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")), "counted")
    totals = subtree_totals(counted.drop("n_convs", "n_children"), rows.select("conv", "depth", "a", "b", "length"), shard_nodes)
    parents = found.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("parent_conv_id"))
    named = common.join_hot(counted.where(F.col("pa").isNotNull()), parents, PARENT)
    named = named.unionByName(counted.where(F.col("pa").isNull()).withColumn("parent_conv_id", F.lit(None).cast("long")))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = named.join(totals, NODE).join(ends(rows), NODE, "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )
