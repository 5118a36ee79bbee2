"""The trie of conversations that begin with the same turns, by partition refinement.

All conversations start in one class.  Classes with two members or more are split by
the next turn; a class is known by its smallest member, and a turn by a digest, so
texts are read once and don't move.  One Spark job takes 1, 2, 4, ... turns, so that
their number grows with the logarithm of the longest shared beginning.  A class of one
retires, and the rest of its conversation is emitted as an unary chain.  Folding back
carries each node's figures with its smallest member: sums from the end of every
conversation, then one sum per node.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from .tables import Kept

#: Turns of one conversation that a job takes at most, and ids that are packed in one row.
BLOCK, PACKED_BITS = 4096, 16
_NO_ENDS = hashlib.sha256(b"").hexdigest()
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(conversations: DataFrame, kept: Kept, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, pos (from 1), digest and bytes of every turn, in the order of turn (null first), equal turns by digest; rows without an id belong to no conversation.

    Ranges of (conversation, turn) are sorted side by side, so that a conversation
    with very many turns is no single task.
    """
    said, what = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(said).cast("string"), F.lit(":"), said, what), 256))
    rows = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(what).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "digest", "bytes", F.spark_partition_id().alias("range"))

    def numbered(batches):
        last, n = None, 0
        for batch in batches:
            conv = batch.column("conv").to_numpy()
            if not len(conv):
                continue
            first = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            at = np.arange(len(conv)) - np.repeat(first, np.diff(np.r_[first, len(conv)]))
            if conv[0] == last:
                at[: first[1] if len(first) > 1 else len(at)] += n
            last, n = conv[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(at + 1), batch.column("digest"), batch.column("bytes"), batch.column("range")], ["conv", "at", "digest", "bytes", "range"])

    turns = kept.keep(ranged.mapInArrow(numbered, "conv long, at long, digest binary, bytes long, range int"), "turns")
    pieces = turns.groupBy("conv", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    # only a conversation that goes on from one range to the next has rows here: fewer than there are ranges
    shifts = pieces.select("conv", "range", before.alias("before")).where("before > 0")
    return turns.join(F.broadcast(shifts), ["conv", "range"], "left").select("conv", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "bytes")


def head_length(conv: Column, most: int = 9) -> Column:
    """How many turns a conversation takes over: crc32 of its decimal id modulo ``most``."""
    return F.crc32(conv.cast("string")) % most


def with_heads(turns: DataFrame, kept: Kept, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv, pos, digest, bytes) and conversations (conv, length).

    A conversation's first h turns give way to the first h ones (all if fewer) of the
    conversation c - c % group, or to none where that is absent.
    """
    own_length = kept.keep(turns.groupBy("conv").agg(F.count("*").alias("own")), "lengths")
    base = own_length.select(F.col("conv").alias("base"), F.col("own").alias("base_length"))
    convs = own_length.withColumn("base", F.col("conv") - F.col("conv") % group).withColumn("h", head_length(F.col("conv"), most)).join(base, "base", "left")
    head = F.least("h", F.coalesce("base_length", F.lit(0)))
    convs = kept.keep(convs.select("conv", "base", "h", head.alias("head"), (head + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    candidate = F.explode(F.array(*[F.col("conv") + F.lit(k) for k in range(1 - group, group)]))
    given = turns.where(F.col("pos") < most).select(F.col("conv").alias("base"), candidate.alias("conv"), "pos", "digest", "bytes").where(f"conv - conv % {group} = base").where(F.col("pos") <= head_length(F.col("conv"), most))
    given = given.join(convs.select("conv"), "conv", "left_semi").select("conv", "pos", "digest", "bytes")
    own = turns.join(convs.select("conv", "h", "head"), "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "digest", "bytes")
    return kept.keep(given.union(own), "rebuilt"), convs.select("conv", "length")


def _chained(rows: DataFrame) -> DataFrame:
    """Each turn's digest replaced by one of all turns of its conversation up to it."""

    def chain(batches):
        conv, so_far = None, b""
        for batch in batches:
            out = []
            for c, digest in zip(batch.column("conv").to_pylist(), batch.column("digest").to_pylist()):
                so_far = hashlib.sha256((so_far if c == conv else b"") + digest).digest()
                conv = c
                out.append(so_far)
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("top"), batch.column("pos"), pa.array(out, pa.binary()), batch.column("bytes")], ["conv", "top", "pos", "digest", "bytes"])

    return rows.repartition("conv").sortWithinPartitions("conv", "pos").mapInArrow(chain, "conv long, top long, pos long, digest binary, bytes long")


def refined(turns: DataFrame, convs: DataFrame, kept: Kept) -> DataFrame:
    """conv, depth, node (smallest member of the class), n (members) and bytes, for every turn of every class of two or more, and the root of all."""
    whole = convs.agg(F.min("conv").alias("top"), F.count("*").alias("n")).first()
    out = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(whole["top"]).cast("long").alias("node"), F.lit(whole["n"]).alias("n"), F.lit(0).cast("long").alias("bytes"))
    active, done, block, k = convs.select("conv", F.lit(whole["top"]).cast("long").alias("top")), 0, 1, 0
    while True:
        rows = turns.where((F.col("pos") > done) & (F.col("pos") <= done + block)).join(active, "conv").select("conv", "top", "pos", "digest", "bytes")
        rows = kept.keep(_chained(rows) if block > 1 else rows, "split")
        # a table, so that a join with it can be split where a class has very many members
        classes = kept.keep(rows.groupBy("top", "pos", "digest").agg(F.min("conv").alias("node"), F.count("*").alias("n")).where("n > 1"), "classes")
        shared = kept.keep(rows.join(classes, ["top", "pos", "digest"]).select("conv", F.col("pos").alias("depth"), "node", "n", "bytes"), f"shared-{k}")
        out = out.union(shared)
        done += block
        active = shared.where(F.col("depth") == done).select("conv", F.col("node").alias("top"))
        if active.isEmpty():
            break
        block, k = min(2 * block, BLOCK), k + 1
    kept.drop("split")
    kept.drop("classes")
    return kept.keep(out, "shared")


def _ends(rows: DataFrame) -> DataFrame:
    """ends_sha256 of (node, depth) from the members (conv) that end there; ids are packed by ranges, and their rows hashed in order."""
    packed = rows.groupBy("node", "depth", F.shiftright("conv", PACKED_BITS).alias("range")).agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))

    def hashed(batches):
        at, digest = None, None
        for batch in batches:
            out = []
            for node, depth, ids in zip(*[batch.column(c).to_pylist() for c in ("node", "depth", "ids")]):
                if at == (node, depth):
                    digest.update(b"," + ids.encode())
                    continue
                if at:
                    out.append((*at, digest.hexdigest()))
                at, digest = (node, depth), hashlib.sha256(ids.encode())
            yield _records(out)
        if at:
            yield _records([(*at, digest.hexdigest())])

    def _records(rows):
        return pa.RecordBatch.from_pylist([{"node": n, "depth": d, "ends_sha256": e} for n, d, e in rows], pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())]))

    return packed.repartition("node", "depth").sortWithinPartitions("node", "depth", "range").mapInArrow(hashed, "node long, depth long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, kept: Kept | None = None) -> DataFrame:
    """A row for every node of the trie of any conversations.

    turns: conv, pos (from 1, without gaps), digest (equal for equal turns alone),
    bytes; convs: conv, length, once for each conversation, those without turns too.
    Both are read several times and should be tables.  Returns COLUMNS, as
    ``conversation_trie`` says.
    """
    kept = kept or Kept(turns.sparkSession)
    shared = refined(turns, convs, kept)
    last = shared.groupBy("conv").agg(F.max("depth").alias("s"), F.max_by("node", "depth").alias("under"), F.max_by("n", "depth").alias("n"))
    last = kept.keep(convs.join(last, "conv"), "last")
    at_end = last.where("length = s").select(F.col("under").alias("node"), F.col("s").alias("depth"), "conv")
    childless = at_end.groupBy("node", "depth").agg(F.count("*").alias("ends")).select(F.col("node").alias("conv"), F.col("depth").alias("s"), "ends")
    # each childless node is counted at its smallest member
    leaf = (F.col("length") > F.col("s")) | ((F.col("conv") == F.col("under")) & (F.coalesce("ends", F.lit(0)) == F.col("n")))
    each = last.join(childless, ["conv", "s"], "left").select("conv", leaf.cast("long").alias("leaf"), (F.col("length") > F.col("s")).cast("long").alias("goes_on"))

    back = Window.partitionBy("conv").orderBy(F.desc("depth"))
    own = F.when(F.col("node") == F.col("conv"), (F.col("n") - 1) * F.col("bytes")).otherwise(0)
    top_of_next = F.coalesce((F.lag("node").over(back) == F.col("conv")).cast("long"), "goes_on")
    folded = shared.join(each, "conv").select("conv", "depth", "node", "n", "leaf", top_of_next.alias("child"), F.sum(own).over(back.rowsBetween(Window.unboundedPreceding, 0)).alias("saved"), F.lead("node").over(back).alias("parent"))
    nodes = folded.groupBy("node", "depth").agg(F.min("parent").alias("parent"), F.min("n").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    nodes = nodes.join(_ends(at_end), ["node", "depth"], "left").select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"))

    one = F.lit(1).cast(LongType())
    tails = turns.select("conv", "pos").join(last.select("conv", "length", "s", "under"), "conv").where("pos > s")
    ends = F.when(F.col("pos") == F.col("length"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(F.lit(_NO_ENDS))
    chains = tails.select(F.col("conv").alias("conv_id"), F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("s") + 1, F.col("under")).otherwise(F.col("conv")).alias("parent_conv_id"), one.alias("n_convs"), (F.col("pos") < F.col("length")).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), ends.alias("ends_sha256"))
    return nodes.unionByName(chains).select(*COLUMNS)


def conversation_trie(conversations: DataFrame, group: int = 5, most: int = 9, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The prefix trie of all conversations, each rebuilt with the head of another.

    Turns are ordered by turn, null first, equal ones by a digest of role and text;
    null role or text is empty; repeated rows are turns of their own; rows without a
    conv_id belong to no conversation; other columns aren't read.  A conversation c
    begins with the first h turns of conversation c - c % group, h being crc32 of c's
    decimal text modulo ``most``, and goes on with its own after the first h; it may
    be without turns.
    Returns a row for each distinct sequence of first turns, the empty one too:
    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs
    (members), n_children, n_leaves (childless nodes below or itself), saved_tokens
    (over the nodes below and itself, members but one times the bytes of the last
    text), ends_sha256 (of the comma-joined ids of members that end there).  An
    empty table gives an empty table.
    """
    kept = Kept(conversations.sparkSession)
    turns = ordered(conversations, kept, conv_id, turn, role, text)
    return trie(*with_heads(turns, kept, group, most), kept)
