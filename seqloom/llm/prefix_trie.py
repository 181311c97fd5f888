"""Conversation prefix trie: shared beginnings of conversations, level by level.

A turn is known by 128 bits of hash, a conversation by its number of turns and a hash of all of
them at their depths.  Equal conversations are one class, held by the smallest conv_id, before
anything else, so a conversation with any number of copies is one row of the levels.

Construction is level-synchronous: per depth, live classes are grouped by (parent node, next
turn); each group is a node, named by its smallest conv_id, and its classes go on with that
node.  A node with a single class is closed: below it is a chain, one node a turn, which needs
no grouping.  Only nodes that several classes share are live, so the levels end with the longest
beginning that two different conversations share.  Then levels are joined from below: children,
leaves and savings go up to their parents.

Levels are written tables: lineage stays short, and AQE can split the join that carries a node
back to its classes, where one turn begins most conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import columns, new_path, prepare, stored

#: Ids whose decimals travel together to be digested.
IDS_A_ROW = 8192
#: Characters of a text that can be part of a range's bound, which the driver holds.
_BOUND = 64
_EMPTY = hashlib.sha256(b"").hexdigest()


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a task: number of each within its conversation, and characters before it."""
    part, last, i, before = TaskContext.get().partitionId(), None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        conv, chars = (np.asarray(b.column(n)) for n in ("conv_id", "chars"))
        new = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
        size = np.diff(np.append(new, len(conv)))
        total = np.concatenate(([0], np.cumsum(chars)))
        rank = np.arange(len(conv)) - np.repeat(new, size)
        sums = total[:-1] - np.repeat(total[new], size)
        if conv[0] == last:
            rank[: size[0]] += i
            sums[: size[0]] += before
        last, i, before = conv[-1], int(rank[-1]) + 1, int(sums[-1] + chars[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(conv), part), pa.int32()), pa.array(rank, pa.int64()), pa.array(sums, pa.int64())], names=[*b.schema.names, "part", "rank", "sums"])


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, k1, k2, chars, before): turns by their place from 0 within a conversation,
    their hashes, their code points and those of the turns before.

    Rows are sorted by ranges of (conv_id, turn, role, text), so a conversation of any length
    is split among tasks; what a task's first conversation has in tasks before is added from a
    table of one row a task.  Turns with equal numbers come by role and text.
    """
    prepare(conversations.sparkSession)
    empty = F.lit("")
    c = columns(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null")
    c = c.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    role, text = F.substring("role", 1, _BOUND), F.when(F.char_length("role") <= _BOUND, F.substring("text", 1, _BOUND))
    c = c.repartitionByRange("conv_id", "turn", role, text).sortWithinPartitions("conv_id", "turn", "role", "text")
    keys = c.select("conv_id", F.xxhash64("role", "text").alias("k1"), F.xxhash64("text", F.lit(1), "role").alias("k2"), F.char_length("text").cast("long").alias("chars"))
    t = stored(keys.mapInArrow(_number, "conv_id long, k1 long, k2 long, chars long, part int, rank long, sums long"), "turns")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = t.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("s"))
    carried = blocks.select("conv_id", "part", F.sum("n").over(earlier).alias("n"), F.sum("s").over(earlier).alias("s")).where("n > 0")
    none = F.lit(0).cast("long")
    # One row a task at most: only its first conversation can have begun in another.
    t = t.join(F.broadcast(carried), ["conv_id", "part"], "left")
    return t.select("conv_id", (F.col("rank") + F.coalesce("n", none)).alias("pos"), "k1", "k2", "chars", (F.col("sums") + F.coalesce("s", none)).alias("before"))


def own_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, len, chars) and their turns (conv_id, depth, k1, k2, chars, rest), as they are."""
    convs = stored(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("len"), F.sum("chars").alias("chars")), "conversations")
    t = turns.join(convs.select("conv_id", F.col("chars").alias("all")), "conv_id")
    return convs, t.select("conv_id", (F.col("pos") + 1).alias("depth"), "k1", "k2", "chars", (F.col("all") - F.col("before")).alias("rest"))


def shared_heads(turns: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """As ``own_turns``, of conversations that begin with the first ``head`` turns (0 to ``most``)
    of conversation ``base`` (all if it has fewer, none if there is none), and go on with
    their own turns after the first ``head``.  Both are expressions of conv_id."""
    heads = F.array(F.lit(0).cast("long"), *[F.sum(F.when(F.col("pos") < j, F.col("chars")).otherwise(0)) for j in range(1, most + 1)])
    sizes = stored(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("total"), heads.alias("heads")), "conversations")
    c = sizes.withColumns({"base": base.cast("long"), "head": head.cast("int")})
    c = c.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("heads").alias("base_heads")), "base", "left")
    taken = F.least(F.col("head").cast("long"), F.coalesce("base_n", F.lit(0).cast("long")))
    c = c.withColumn("taken", taken.cast("int"))
    after = F.when(F.col("n") > F.col("head"), F.col("total") - F.get("heads", "head")).otherwise(0)
    first = F.coalesce(F.get("base_heads", "taken"), F.lit(0).cast("long"))
    c = stored(c.select("conv_id", "base", "head", "taken", "total", after.alias("after"), first.alias("first"), (F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("len")), "rebuilt")
    own = turns.join(c.select("conv_id", "head", "taken", "total"), "conv_id").where("pos >= head")
    own = own.select("conv_id", (F.col("pos") - F.col("head") + F.col("taken") + 1).alias("depth"), "k1", "k2", "chars", (F.col("total") - F.col("before")).alias("rest"))
    lent = turns.where(F.col("pos") < most).withColumnRenamed("conv_id", "base").join(c.where("taken > 0").select("base", "conv_id", "taken", "first", "after"), "base").where("pos < taken")
    lent = lent.select("conv_id", (F.col("pos") + 1).alias("depth"), "k1", "k2", "chars", (F.col("first") - F.col("before") + F.col("after")).alias("rest"))
    return c.select("conv_id", "len", (F.col("first") + F.col("after")).alias("chars")), own.unionByName(lent)


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (rep, conv_id) to rows of many ids: the decimals, joined by commas."""
    rep, ids = None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids)).encode()], pa.binary())], names=["rep", "first", "ids"])

    for b in batches:
        for r, c in zip(b.column("rep").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
            if ids and (r != rep or len(ids) == IDS_A_ROW):
                yield row()
                ids = []
            rep = r
            ids.append(c)
    if ids:
        yield row()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of ids to one digest a class: a stream, of which only the digest's state is held."""
    rep, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([state.hexdigest()])], names=["rep", "sha"])

    for b in batches:
        for r, ids in zip(b.column("rep").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if r != rep:
                if state is not None:
                    yield row()
                rep, state = r, hashlib.sha256(ids)
            else:
                state.update(b"," + ids)
    if state is not None:
        yield row()


def _classes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(rep, w, len, all, sha): equal conversations, their number, turns and characters, and the
    digest of their ids."""
    mixed = turns.groupBy("conv_id").agg(F.bit_xor(F.xxhash64("depth", "k1")).alias("x1"), F.bit_xor(F.xxhash64("k2", "depth")).alias("x2"))
    none = F.lit(0).cast("long")
    c = stored(convs.join(mixed, "conv_id", "left").select("conv_id", "len", "chars", F.coalesce("x1", none).alias("x1"), F.coalesce("x2", none).alias("x2")), "hashed")
    key = ["len", "x1", "x2"]
    k = stored(c.groupBy(*key).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("w"), F.min("chars").alias("all")), "classes")
    members = c.join(k.where("w > 1").select(*key, "rep"), key).select("rep", "conv_id")
    rows = members.repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id").mapInArrow(_joined_ids, "rep long, first long, ids binary")
    digests = rows.repartition("rep").sortWithinPartitions("rep", "first").mapInArrow(_digested, "rep long, sha string")
    single = F.sha2(F.col("rep").cast("string"), 256)
    return stored(k.join(digests, "rep", "left").select("rep", "w", "len", "all", F.coalesce("sha", single).alias("sha")), "classes")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row a node of the trie of conversations ``convs`` (conv_id, len, chars) with ``turns``
    (conv_id, depth from 1, k1, k2, chars, rest: code points of this and the later turns).

    conv_id: the smallest one below the node; depth; parent_conv_id (root: null); n_convs,
    n_children, n_leaves; saved_tokens: code points that need not be stored again, for the node
    and all below; ends_sha256: digest of the ids of the conversations that end here.
    """
    spark = convs.sparkSession
    turns = stored(turns, "rebuilt-turns")
    k = _classes(convs, turns)
    mine = k.select(F.col("rep").alias("conv_id"))
    # By depth, so that a level reads its own row groups.
    r = turns.join(mine, "conv_id").withColumnRenamed("conv_id", "rep")
    r = stored(r.repartitionByRange("depth", "rep").sortWithinPartitions("depth", "rep"), "turns-by-depth")

    def nodes(grouped, depth: int, parent: Column, chars: Column) -> DataFrame:
        one = F.count(F.lit(1)) == 1
        ended = F.min(F.when(F.col("len") == depth, F.col("sha")))
        return grouped.agg(
            F.min("rep").alias("conv_id"), F.sum("w").alias("n_convs"), F.count(F.lit(1)).alias("classes"), chars.alias("chars"), F.min("rest").alias("rest"), F.min("len").alias("len"), F.when(one, F.min("sha")).otherwise(ended).alias("sha")
        ).withColumns({"depth": F.lit(depth).cast("long"), "parent": parent})

    root = nodes(k.withColumn("rest", F.col("all")).groupBy(), 0, F.lit(None).cast("long"), F.lit(0).cast("long")).where("classes > 0")
    levels = [stored(root, "level")]
    top = levels[0].first()  # one row
    if top is None:
        return _result(levels[0].withColumns(_open()))
    live = k.select("rep", "w", "len", "sha", F.lit(top["conv_id"]).cast("long").alias("node"))
    more = top["classes"] > 1
    while more:
        depth = len(levels)
        j = stored(live.join(r.where(F.col("depth") == depth).select("rep", "k1", "k2", "chars", "rest"), "rep"), "live")
        g = stored(nodes(j.groupBy("node", "k1", "k2"), depth, F.col("node"), F.min("chars")), "level")
        levels.append(g)
        shared = g.where("classes > 1")
        more = not shared.isEmpty()
        live = j.join(shared.select("node", "k1", "k2", F.col("conv_id").alias("child")), ["node", "k1", "k2"]).select("rep", "w", "len", "sha", F.col("child").alias("node"))
    paths: list[str] = []
    below: DataFrame | None = None
    for g in reversed(levels):
        closed = F.col("classes") == 1
        if below is None:
            up = g.withColumns(_open())
        else:
            up = g.join(below.groupBy(F.col("parent").alias("conv_id")).agg(F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("sums")), "conv_id", "left")
        none = F.lit(0).cast("long")
        up = up.select(
            "conv_id", "depth", "parent", "n_convs", "classes", "len",
            F.when(closed, (F.col("len") > F.col("depth")).cast("long")).otherwise(F.coalesce("kids", none)).alias("n_children"),
            F.when(closed, 1).otherwise(F.coalesce("leaves", none)).cast("long").alias("n_leaves"),
            F.when(closed, (F.col("n_convs") - 1) * F.col("rest")).otherwise((F.col("n_convs") - 1) * F.col("chars") + F.coalesce("sums", none)).alias("saved"),
            "sha",
        )
        path = new_path(spark, "rolled")
        up.write.parquet(path)
        paths.append(path)
        below = spark.read.schema(up.schema).parquet(path)
    every = spark.read.schema(below.schema).parquet(*paths)
    closed = every.where("classes = 1").select(F.col("conv_id").alias("rep"), F.col("depth").alias("from"), F.col("n_convs").alias("w"), "len", "sha")
    chain = r.select("rep", "depth", "rest").join(closed, "rep").where("depth > from")
    chain = chain.select(
        F.col("rep").alias("conv_id"), "depth", F.col("rep").alias("parent"), F.col("w").alias("n_convs"), F.lit(1).cast("long").alias("classes"), "len",
        (F.col("len") > F.col("depth")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("w") - 1) * F.col("rest")).alias("saved"), "sha",
    )
    return _result(every.unionByName(chain))


def _open() -> dict[str, Column]:
    """The columns of a node without open children."""
    none = F.lit(0).cast("long")
    return {"kids": none, "leaves": none, "sums": none, "n_children": none, "n_leaves": none, "saved": none}


def _result(nodes: DataFrame) -> DataFrame:
    # A closed node above the end of its class has that class's digest, but nothing ends there.
    ends = F.when((F.col("classes") == 1) & (F.col("len") > F.col("depth")), F.lit(_EMPTY)).otherwise(F.coalesce("sha", F.lit(_EMPTY)))
    return nodes.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), ends.alias("ends_sha256")
    )


def shared_prefix_trie(conversations: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """The trie of conversations that borrow their beginning: each conv_id c takes the first h
    turns of conversation c - c % group, h = crc32(c as text) % heads, and goes on with its own
    turns after the first h.

    Turns are ordered by turn (null first), equal ones by role and text; a null role or text is
    empty.  Rows without conv_id belong to no conversation and are left out.  Repeated rows are
    turns each.  % keeps the sign, so -1 borrows from 0.  A conversation may be left without
    turns: it ends at the root.  An empty table has no nodes.  Conversations of any length are
    split among tasks; other columns are ignored.
    """
    turns = ordered_turns(conversations)
    c = F.col("conv_id")
    return prefix_trie(*shared_heads(turns, c - c % group, F.crc32(c.cast("string").cast("binary")) % heads, heads - 1))
