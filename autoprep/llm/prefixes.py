"""Conversation prefix trie: ROLLUP over blocks of positional turn-id columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved

#: Turn-id columns of a block. A longer conversation goes on in further blocks.
WIDTH = 8
#: Blocks whose sums one window adds up; sums of such runs are added up by a second window.
RUN = 1024
#: Ids that travel as one piece of a list to be hashed.
PIECE = 1000
NODE = ["depth", "key"]
_IDS = [f"t{j}" for j in range(1, WIDTH + 1)]
_BYTES = [f"b{j}" for j in range(1, WIDTH + 1)]


def _number(digest: Column, start: int, digits: int) -> Column:
    """Hexadecimal digits (15 at most) of a digest as a decimal."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("decimal(20,0)")


def _turn_id(role: Column, text: Column) -> Column:
    """A number of 120 bits for what a turn says; its order is that of the SHA-256 digests."""
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return (_number(digest, 1, 15) * F.lit(1 << 60).cast("decimal(20,0)") + _number(digest, 16, 15)).cast("decimal(38,0)")


def _place_id(depth: Column, turn: Column) -> Column:
    """A number of 90 bits for a turn at a depth: a prefix is known by the sum over its turns."""
    digest = F.sha2(F.concat(depth.cast("string"), F.lit(":"), turn.cast("string")), 256)
    return (_number(digest, 1, 11) * F.lit(1 << 44).cast("decimal(20,0)") + _number(digest, 12, 11)).cast("decimal(38,0)")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, place, turn_id, size)``: each conversation's turns numbered from 1.

    Order is by turn (null first), then role, then digest of role and text; equal rows count as often
    as they come. Rows are numbered inside range partitions, so a long conversation is many tasks'
    work.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"),
        _turn_id(role, text).alias("turn_id"), F.octet_length(text).cast("bigint").alias("size"), F.monotonically_increasing_id().alias("row"),
    )
    order = ["turn", "role", "turn_id", "row"]
    turns = saved(turns.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    sums = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # Most conversations lie in one part and have nothing before it.
    sums = sums.where("before > 0").select("conv_id", "part", "before")
    inside = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    placed = turns.withColumn("place", inside).join(sums, ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "turn_id", "size")


def rebuilt_turns(turns: DataFrame, every: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that start with another one's turns: ``(conv_id, length)`` and ``(conv_id, length, place, turn_id, size)``.

    Conversation c takes the first h turns of c - c % every, all if there are fewer and none if there is
    no such conversation, and goes on with its own turns after its first h; h is crc32(c) modulo ``most``.
    """
    c = F.col("conv_id")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    convs = saved(convs.select("conv_id", "own", (c - c % every).alias("giver"), (F.crc32(c.cast("string").cast("binary")) % most).alias("h")), "convs")
    givers = convs.where(c == F.col("giver")).select("giver", F.col("own").alias("given"))
    taken = F.least("h", F.coalesce("given", F.lit(0)))
    convs = convs.join(givers, "giver", "left").withColumn("taken", taken)
    convs = saved(convs.withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "rebuilt")
    kept = turns.join(convs.where("own > h").select("conv_id", "h", "taken", "length"), "conv_id").where("place > h")
    kept = kept.select("conv_id", "length", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "turn_id", "size")
    # Each first turn of a giver goes to the few conversations around its id.
    first = turns.where((c % every == 0) & (F.col("place") < most)).withColumnRenamed("conv_id", "giver")
    borrowed = first.join(convs.where("taken > 0").select("giver", "conv_id", "taken", "length"), "giver").where("place <= taken")
    return convs.select("conv_id", "length"), kept.unionByName(borrowed.select(*kept.columns))


def _blocks(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each ``WIDTH`` turns: their ids and sizes, and the key and the bytes of all that comes before."""
    place = F.col("place") - 1
    turns = turns.select(
        "conv_id", "length", F.floor(place / WIDTH).cast("bigint").alias("block"), (place % WIDTH + 1).alias("j"), "turn_id", "size",
        _place_id(F.col("place"), F.col("turn_id")).alias("id"),
    )
    columns = [F.max(F.when(F.col("j") == j, F.col("turn_id"))).alias(_IDS[j - 1]) for j in range(1, WIDTH + 1)]
    columns += [F.coalesce(F.max(F.when(F.col("j") == j, F.col("size"))), F.lit(0)).alias(_BYTES[j - 1]) for j in range(1, WIDTH + 1)]
    blocks = turns.groupBy("conv_id", "length", "block").agg(*columns, F.sum("id").cast("decimal(38,0)").alias("id"), F.sum("size").alias("size"))
    empty = convs.where("length = 0").select("conv_id", "length", F.lit(0).cast("bigint").alias("block"))
    blocks = saved(blocks.unionByName(empty, allowMissingColumns=True).fillna(0, [*_BYTES, "size"]), "blocks")
    run = F.floor(F.col("block") / RUN)
    zero = F.lit(0).cast("decimal(38,0)")

    def summed(over: Window) -> list[Column]:
        key = F.coalesce(F.sum("id").over(over).cast("decimal(38,0)"), zero).alias("prior")
        return [key, F.coalesce(F.sum("size").over(over), F.lit(0)).alias("passed")]

    upto = (Window.unboundedPreceding, -1)
    inside = blocks.withColumn("run", run).select("*", *summed(Window.partitionBy("conv_id", "run").orderBy("block").rowsBetween(*upto)))
    long = blocks.where(F.col("length") > RUN * WIDTH).groupBy("conv_id", run.alias("run")).agg(F.sum("id").cast("decimal(38,0)").alias("id"), F.sum("size").alias("size"))
    before = long.select("conv_id", "run", *summed(Window.partitionBy("conv_id").orderBy("run").rowsBetween(*upto)))
    before = before.withColumnsRenamed({"prior": "run_prior", "passed": "run_passed"})
    out = inside.join(before, ["conv_id", "run"], "left").drop("run")
    out = out.withColumn("prior", (F.col("prior") + F.coalesce("run_prior", zero)).cast("decimal(38,0)"))
    return out.withColumn("passed", F.col("passed") + F.coalesce("run_passed", F.lit(0))).drop("run_prior", "run_passed")


def _rolled_up(blocks: DataFrame, aggregates: str) -> DataFrame:
    """Aggregates of all prefixes of all blocks together: ``(depth, key, parent_key, level, ...)``, a row for each node.

    A node is known by the node before its block and by the ids of its own block; a block's prefixes
    of no turn are those of the block before and are left out, but for the root.
    """
    ids = ", ".join(_IDS)
    rolled = blocks.sparkSession.sql(
        f"select block, prior, {ids}, {WIDTH} - bit_count(grouping_id()) as level, {aggregates} from {{blocks}} group by block, prior, rollup({ids})",
        blocks=blocks,
    )
    last = F.element_at(F.array(*_IDS), F.greatest("level", F.lit(1)).cast("int"))
    rolled = rolled.where(((F.col("level") == 0) & (F.col("block") == 0)) | ((F.col("level") > 0) & last.isNotNull()))
    place = [F.when(F.col("level") >= j, _place_id(F.col("block") * WIDTH + j, F.col(_IDS[j - 1]))) for j in range(1, WIDTH + 1)]
    zero = F.lit(0).cast("decimal(38,0)")
    rolled = rolled.withColumn("__own", F.element_at(F.array(*place), F.greatest("level", F.lit(1)).cast("int")))
    key = F.col("prior")
    for p in place:
        key = (key + F.coalesce(p, zero)).cast("decimal(38,0)")
    rolled = rolled.withColumn("key", key).withColumn("depth", F.col("block") * WIDTH + F.col("level"))
    parent = F.when(F.col("level") > 0, (F.col("key") - F.col("__own")).cast("decimal(38,0)"))
    return rolled.withColumn("parent_key", parent).drop("block", "prior", "__own", *_IDS)


def digests(ends: DataFrame, by: list[str], ident: str) -> DataFrame:
    """SHA-256 of each group's ids in ascending order, comma-joined: ``(*by, sha256)``.

    The digest of a list has to be taken in its order. Ranges of ids first become pieces of text, in
    parallel; the pieces of a group then stream through one digest, so no list is ever held.
    """
    schema = ", ".join(f"{c} {ends.schema[c].dataType.simpleString()}" for c in by)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(by, group)) | {"first": held[0], "part": ",".join(map(str, held))}], wanted)

        for batch in batches:
            wanted = pa.schema([*[batch.schema.field(c) for c in by], pa.field("first", pa.int64()), pa.field("part", pa.string())])
            for *now, i in zip(*(batch.column(c).to_pylist() for c in (*by, ident))):
                if now != group or len(held) == PIECE:
                    if held:
                        yield piece()
                    group, held = now, []
                held.append(i)
        if held:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(by, group)) | {"sha256": state.hexdigest()}], wanted)

        for batch in batches:
            wanted = pa.schema([*[batch.schema.field(c) for c in by], pa.field("sha256", pa.string())])
            for *now, part in zip(*(batch.column(c).to_pylist() for c in (*by, "part"))):
                if now != group:
                    if state is not None:
                        yield done()
                    group, state = now, hashlib.sha256(part.encode())
                else:
                    state.update(b"," + part.encode())
        if state is not None:
            yield done()

    rows = ends.select(*by, ident).repartitionByRange(*by, ident).sortWithinPartitions(*by, ident)
    rows = rows.mapInArrow(pieces, f"{schema}, first bigint, part string")
    return rows.repartition(*by).sortWithinPartitions(*by, "first").mapInArrow(digest, f"{schema}, sha256 string")


def prefix_trie(conversations: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """The trie of rebuilt conversations, a row for each distinct prefix.

    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``:
    see ``ordered_turns`` and ``rebuilt_turns`` for what a conversation is. A node is a distinct
    sequence of first turns; it is named by its depth and its smallest member. Saved tokens are the
    UTF-8 bytes of the last texts of a node's subtree, once for each member but one.

    Null roles and texts count as empty, a null turn comes first, rows with a null conv_id belong to
    no conversation, equal rows are turns of their own, and ties in turn go by role, then digest. A
    conversation that loses all its turns ends at the root. No conversations give no rows. Texts of
    any length are only hashed and measured; extra columns are ignored.

    Every block of ``WIDTH`` turns is one row that knows the node before it, so one ROLLUP counts the
    prefixes of all blocks at once. Nodes and turns are told apart by 90 and 120 bits of SHA-256.
    """
    convs, turns = rebuilt_turns(saved(ordered_turns(conversations), "ordered"), every, most)
    blocks = saved(_blocks(convs, turns), "prefixes")
    nodes = saved(_rolled_up(blocks, "min(conv_id) as conv_id, count(*) as n_convs, max(length) as longest"), "nodes")

    # A conversation owns the nodes of which it is the smallest member: all of its own from some depth on.
    depth = F.col("depth")
    owners = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("owned"), F.max(F.when(F.col("n_convs") > 1, depth)).alias("shared"), F.max((F.col("longest") == depth).cast("int")).alias("leaf")
    )
    owned = F.coalesce("owned", F.col("length") + 1)
    low = F.col("block") * WIDTH
    borrowed = sum((F.when(low + j < owned, F.col(_BYTES[j - 1])).otherwise(0) for j in range(1, WIDTH + 1)), F.lit(0))
    rows = saved(blocks.join(owners, "conv_id", "left").withColumn("borrowed", borrowed).withColumn("owned", owned), "owned")
    total = rows.where("owned > 1").groupBy("conv_id").agg(F.sum("borrowed").alias("total"))
    # Below its shared part a conversation is alone: one leaf and nothing saved.
    rows = rows.where((F.col("block") == 0) | (low + 1 < F.col("owned")) | (low + 1 <= F.coalesce("shared", F.lit(0))))
    rows = rows.join(total, "conv_id", "left").fillna(0, ["total", "leaf"])
    below = F.col("total") - F.col("passed")
    for j in range(WIDTH):
        # Bytes from this turn on that another conversation owns.
        rows = rows.withColumn(f"s{j + 1}", F.greatest(below, F.lit(0)))
        below = below - F.col(_BYTES[j])
    sums = _rolled_up(rows, ", ".join(["sum(leaf) as n_leaves", *(f"sum(s{j}) as s{j}" for j in range(1, WIDTH + 1))]))
    at = F.element_at(F.array(*[f"s{j}" for j in range(1, WIDTH + 1)]), F.greatest("level", F.lit(1)).cast("int"))
    sums = sums.select(*NODE, "n_leaves", at.alias("saved_tokens"))

    kids = nodes.where("depth > 0").groupBy((depth - 1).alias("depth"), F.col("parent_key").alias("key")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((depth + 1).alias("depth"), F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    last = F.greatest(F.floor((F.col("length") - 1) / WIDTH), F.lit(0))
    ends = blocks.where(F.col("block") == last)
    ends = ends.select("conv_id", F.col("length").alias("depth"), (F.col("prior") + F.coalesce("id", F.lit(0))).cast("decimal(38,0)").alias("key"))
    out = nodes.join(kids, NODE, "left").join(sums, NODE, "left").join(digests(ends, NODE, "conv_id"), NODE, "left")
    out = out.join(parents, ["depth", "parent_key"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
        F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def oracle(every: int = 5, most: int = 9) -> str:
    """DuckDB SQL for the same rows, from lists of turns and without any of the sums above."""
    return f"""
with bits as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) order by i) as tab
              from range(256) as r(i)),
raw as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as txt, turn from conversations where conv_id is not null),
turns as (select conv_id, role, txt,
                 row_number() over (partition by conv_id order by turn nulls first, role, left(sha256(strlen(role) || ':' || role || txt), 30)) as r from raw),
own as (select conv_id, list({{'role': role, 'txt': txt}} order by r) as l from turns group by conv_id),
sized as (select conv_id, l, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
                 lambda a, b: xor(a >> 8, bits.tab[(xor(a, b) & 255) + 1]))) % {most} as h from own, bits),
convs as (select s.conv_id, list_concat(coalesce(g.l, [])[:s.h], s.l[s.h + 1:]) as l from sized s left join own g on g.conv_id = s.conv_id - s.conv_id % {every}),
steps as (select conv_id, len(l) as length, unnest(range(len(l) + 1)) as depth, l from convs),
paths as (select conv_id, length, depth, case when depth = 0 then 0 else strlen(l[depth].txt) end as bytes,
                 min(conv_id) over (partition by depth, l[:depth]) as node, count(*) over (partition by depth, l[:depth]) as n,
                 max(length) over (partition by depth, l[:depth]) as longest from steps),
nodes as (select depth, node, count(*) as n_convs, string_agg(conv_id::varchar, ',' order by conv_id) filter (length = depth) as ends from paths group by all),
pairs as (select distinct a.depth, a.node, b.depth as d, b.node as v, b.n, b.bytes, b.longest from paths a join paths b on a.conv_id = b.conv_id and b.depth >= a.depth),
below as (select depth, node, count(*) filter (d = depth + 1) as n_children, count(*) filter (longest = d) as n_leaves, sum((n - 1) * bytes) as saved from pairs group by all),
above as (select distinct b.depth, b.node, a.node as parent from paths a join paths b on a.conv_id = b.conv_id and b.depth = a.depth + 1)
select node as conv_id, depth, parent as parent_conv_id, n_convs, n_children, n_leaves, saved::bigint as saved_tokens, sha256(coalesce(ends, '')) as ends_sha256
from nodes join below using (depth, node) left join above using (depth, node)"""
