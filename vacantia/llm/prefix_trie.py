"""Conversation prefix trie: count-min screening of prefix digests, exact grouping of what may be shared.

A prefix of d turns is known by the sum, in two 64-bit lanes, of a hash of place and digest of
each turn. Sums over parts of a conversation add up, so even one conversation of most rows
is read by many tasks (``running``). A count-min sketch of all prefixes says which of them
surely occur once: their nodes are written where they stand. Only prefixes that may be
shared are shuffled and grouped exactly.

Sums over a subtree need no walk along the trie; each is a sum over the node's members:
leaves are members that are the smallest of a childless last node, and of a member's
code points those count as saved that lie from the node's depth to the depth from
which the member is itself the smallest one.

Defined results: rows without ``conv_id`` belong to no conversation and are left out; a null role or
text is empty; a null turn comes first; equal turns are ordered by the digest of role and text,
so repeated rows stay repeated turns; an empty table has no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm import sketch
from vacantia.llm.common import parts, prepare, save

SHARED_FIRST = 100       # conversations of one hundred share the turns of its first one
MOST_FIRST = 6           # ... up to the remainder of the conversation's CRC-32 by this
NODE = ["depth", "lane1", "lane2"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# -- running sums over sorted partitions ------------------------------------------------------

def running(df: DataFrame, key: str, order: list, sums: list[str], label: str) -> DataFrame:
    """Inclusive running sums of long columns per ``key`` in the given order, in place of the columns.

    Sums wrap at 64 bits. Rows are sorted by range, so a key may lie in several partitions; each
    sums alone, and what a key brought from earlier partitions (one row each) is added at the end.
    """
    spark = df.sparkSession
    names = df.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)

    def scan(batches):
        part, last, held, seen = TaskContext.get().partitionId(), None, np.zeros(len(sums), np.uint64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            new = np.empty(len(keys), bool)
            new[0], new[1:] = last is None or keys[0] != last, keys[1:] != keys[:-1]
            first = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))
            out = dict(zip(batch.schema.names, batch.columns, strict=True))
            carry = held.copy()
            for j, name in enumerate(sums):
                total = np.cumsum(batch.column(name).to_numpy().view(np.uint64), dtype=np.uint64)
                before = np.concatenate([np.zeros(1, np.uint64), total])[np.maximum(first, 0)]
                mine = total - before + np.where(first < 0, carry[j], np.uint64(0))
                out[name] = pa.array(mine.view(np.int64))
                held[j] = mine[-1]
            last = keys[-1]
            out["part"] = pa.array(np.full(len(keys), part, np.int32))
            out["at"] = pa.array(np.arange(seen, seen + len(keys)))
            seen += len(keys)
            yield pa.RecordBatch.from_arrays([out[n] for n in [*names, "part", "at"]], names=[*names, "part", "at"])

    dealt = df.repartitionByRange(parts(spark), key, *order).sortWithinPartitions(key, *order)
    summed = save(dealt.mapInArrow(scan, f"{schema}, part int, at long"), label)
    # one row per partition: its last and its first key
    tails = sorted(tuple(r) for r in summed.groupBy("part").agg(F.max(key), F.min(key)).collect())
    spans = sorted({k for (_, k, _), (_, _, first) in zip(tails, tails[1:], strict=False) if k == first})  # keys across a border: at most one each
    if not spans:
        return summed.drop("part", "at")
    ends: dict[tuple, tuple] = {}
    for row in (summed.filter(F.col(key).isin(spans)).groupBy("part", key)
                .agg(F.max_by(F.struct(*sums), "at").alias("s")).collect()):
        ends[row["part"], row[key]] = tuple(row["s"])
    carried: dict[tuple, list[int]] = {}
    for k in spans:
        total = [0] * len(sums)
        for part, _, _ in tails:
            if (part, k) in ends:
                carried[part, k] = list(total)
                total = [(a + b) % (1 << 64) for a, b in zip(total, ends[part, k], strict=True)]

    def add(batches):
        for batch in batches:
            part, keys = batch.column("part").to_numpy(), batch.column(key).to_numpy()
            out = dict(zip(batch.schema.names, batch.columns, strict=True))
            for (p, k), total in carried.items():
                if any(total) and batch.num_rows and (at := (part == p) & (keys == k)).any():
                    for j, name in enumerate(sums):
                        value = out[name].to_numpy().view(np.uint64).copy()
                        value[at] += np.uint64(total[j])
                        out[name] = pa.array(value.view(np.int64))
            yield pa.RecordBatch.from_arrays([out[n] for n in names], names=names)

    return summed.drop("at").mapInArrow(add, schema)


# -- rebuilt conversations --------------------------------------------------------------------

def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, digest, chars``: turns in order, without their texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32).alias("digest"),
        F.char_length(text).cast("long").alias("chars"), F.lit(1).cast("long").alias("pos"))
    numbered = running(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("digest")], ["pos"], "trie-turns")
    return numbered.select("conv_id", "pos", "digest", "chars")


def rebuilt(own: DataFrame) -> DataFrame:
    """``conv_id, depth, digest, chars``: the first turns of the hundred's first conversation, then the own ones.

    The root (depth 0) of every conversation is a row of its own; ``left`` tells how many turns follow.
    """
    convs = own.groupBy("conv_id").agg(F.max("pos").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_FIRST
    base = F.col("conv_id") - F.col("conv_id") % SHARED_FIRST
    convs = convs.select("conv_id", "n", h.alias("h"), base.alias("base"))
    firsts = own.filter(F.col("pos") < MOST_FIRST).groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("firsts"))
    convs = convs.join(firsts, "base", "left").select(
        "conv_id", "h", F.coalesce(F.slice("firsts", 1, F.col("h").cast("int")), F.array().cast("array<struct<pos:long,digest:string,chars:long>>")).alias("firsts"), "n")
    convs = save(convs.select("conv_id", "h", "firsts", (F.size("firsts") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-conversations")
    head = convs.select("conv_id", "length", F.explode(F.concat(
        F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("chars"))), "firsts")).alias("t"))
    head = head.select("conv_id", F.col("t.pos").alias("depth"), "t.digest", "t.chars", "length")
    rest = (own.join(convs.select("conv_id", "h", F.size("firsts").alias("taken"), "length"), "conv_id").filter(F.col("pos") > F.col("h"))
            .select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "digest", "chars", "length"))
    return head.unionByName(rest)


def prefixes(conversations: DataFrame) -> DataFrame:
    """One row per conversation and depth: lanes of the prefix and of the one before, code points up to here, whether it ends here."""
    rows = rebuilt(turns(conversations))
    add = F.col("depth") > 0
    lanes = [F.when(add, F.xxhash64("depth", "digest", F.lit(seed))).otherwise(F.lit(0)) for seed in (1, 2)]
    rows = rows.select("conv_id", "depth", (F.col("depth") == F.col("length")).alias("ends"), "chars",
                       lanes[0].alias("add1"), lanes[1].alias("add2"), lanes[0].alias("lane1"), lanes[1].alias("lane2"), F.col("chars").alias("upto"))
    return running(rows, "conv_id", ["depth"], ["lane1", "lane2", "upto"], "trie-prefixes")


# -- the screen -------------------------------------------------------------------------------

def key_of(depth: np.ndarray, lane1: np.ndarray, lane2: np.ndarray) -> np.ndarray:
    """One 64-bit key of each prefix for the sketch."""
    return (lane1.view(np.uint64) ^ (lane2.view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))) + depth.astype(np.uint64)


def screened(rows: DataFrame) -> DataFrame:
    """Adds ``single`` and ``above``: the prefix, and the one before it, surely occur once."""
    spark = rows.sparkSession
    cells = sketch.size_for(rows.count())
    touched = rows.select(*NODE).mapInArrow(
        lambda batches: sketch.touch((key_of(*(b.column(c).to_numpy() for c in NODE)) for b in batches), cells), sketch.TOUCHED)
    bits = spark.sparkContext.broadcast(sketch.met_twice(touched, cells))

    def run(batches):
        for batch in batches:
            depth, lane1, lane2, add1, add2 = (batch.column(c).to_numpy() for c in [*NODE, "add1", "add2"])
            before = [(a.view(np.uint64) - b.view(np.uint64)).view(np.int64) for a, b in ((lane1, add1), (lane2, add2))]
            above = sketch.surely_once(bits.value, key_of(np.maximum(depth - 1, 0), *before), cells) & (depth > 0)
            out = dict(zip(batch.schema.names, batch.columns, strict=True))
            out |= {"up1": pa.array(before[0]), "up2": pa.array(before[1]), "above": pa.array(above),
                    "single": pa.array(sketch.surely_once(bits.value, key_of(depth, lane1, lane2), cells))}
            yield pa.RecordBatch.from_arrays([out[c] for c in SCREENED], names=SCREENED)

    return rows.mapInArrow(run, "conv_id long, depth long, lane1 long, lane2 long, up1 long, up2 long, chars long, upto long, "
                                "ends boolean, single boolean, above boolean")


SCREENED = ["conv_id", "depth", "lane1", "lane2", "up1", "up2", "chars", "upto", "ends", "single", "above"]


# -- nodes ------------------------------------------------------------------------------------

def end_lists(shared: DataFrame) -> DataFrame:
    """``ends_sha256`` of each node at which a conversation ends: ids pass in order and are hashed as they come."""
    def run(batches):
        now, digest = None, None

        def row():
            return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in now), pa.array([digest.hexdigest()])], names=[*NODE, "ends_sha256"])

        for batch in batches:
            for *node, conv in zip(*(batch.column(c).to_pylist() for c in [*NODE, "conv_id"]), strict=True):
                if node != now:
                    if now is not None:
                        yield row()
                    now, digest = node, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
        if now is not None:
            yield row()

    ends = shared.filter("ends").select(*NODE, "conv_id")
    return (ends.repartition(parts(shared.sparkSession), *NODE).sortWithinPartitions(*NODE, "conv_id")
            .mapInArrow(run, "depth long, lane1 long, lane2 long, ends_sha256 string"))


def trie(conversations: DataFrame) -> DataFrame:
    """All nodes; see the module text for how each column comes about."""
    prepare(conversations.sparkSession)
    rows = save(screened(prefixes(conversations)), "trie-screened")
    shared, alone = rows.filter("NOT single"), rows.filter("single")
    tops = alone.filter("NOT above")  # where a conversation leaves the prefixes that may be shared
    mine = F.min(F.struct("conv_id", "up1", "up2", "chars", "upto", "above"))
    nodes = save(shared.groupBy(*NODE).agg(mine.alias("m"), F.count("*").alias("n_convs")).select(*NODE, "m.*", "n_convs"), "trie-nodes")
    up = [(F.col("depth") - 1).alias("depth"), F.col("up1").alias("lane1"), F.col("up2").alias("lane2")]
    children = (nodes.filter("depth > 0 AND NOT above").select(*up).unionByName(tops.select(*up))
                .groupBy(*NODE).agg(F.count("*").alias("n_children")))
    nodes = save(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-children")
    # per conversation: code points before the depth from which it is the smallest member, and whether it stands for a leaf
    before = F.col("upto") - F.col("chars")
    own = nodes.select("conv_id", before.alias("reach")).unionByName(tops.select("conv_id", before.alias("reach")))
    own = own.unionByName(rows.filter("ends").select("conv_id", F.col("upto").alias("reach")))
    childless = shared.filter("ends").join(nodes.filter("n_children = 0").select(*NODE, "conv_id"), [*NODE, "conv_id"], "left_semi").select("conv_id")
    leaves = childless.unionByName(alone.filter("ends").select("conv_id")).select("conv_id", F.lit(None).cast("long").alias("reach"), F.lit(1).alias("leaf"))
    facts = (own.withColumn("leaf", F.lit(0)).unionByName(leaves).groupBy("conv_id")
             .agg(F.min("reach").alias("reach"), F.max("leaf").alias("leaf")))
    sums = (shared.select(*NODE, "conv_id", before.alias("passed")).join(facts, "conv_id").groupBy(*NODE)
            .agg(F.sum(F.col("leaf").cast("long")).alias("n_leaves"), F.sum(F.greatest(F.col("reach") - F.col("passed"), F.lit(0))).alias("saved_tokens")))
    nodes = nodes.join(sums, NODE).join(end_lists(shared), NODE, "left")
    named = (nodes.select("conv_id", "depth", "up1", "up2", "n_convs", "n_children", "n_leaves", "saved_tokens",
                          F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"), "above"))
    own_sha = F.when(F.col("ends"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(EMPTY_SHA)
    single = alone.select("conv_id", "depth", "up1", "up2", F.lit(1).cast("long").alias("n_convs"),
                          F.when(F.col("ends"), 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
                          F.lit(0).cast("long").alias("saved_tokens"), own_sha.alias("ends_sha256"), "above")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    every = named.unionByName(single)
    # below a proven prefix all is one conversation's own; the others ask for the smallest member of the node before
    parents = save(nodes.select((F.col("depth") + 1).alias("depth"), F.col("lane1").alias("up1"), F.col("lane2").alias("up2"),
                                F.col("conv_id").alias("parent_conv_id")), "trie-parents")
    return (every.filter("NOT above").join(parents, ["depth", "up1", "up2"], "left").select(*out)
            .unionByName(every.filter("above").withColumn("parent_conv_id", F.col("conv_id")).select(*out)))
