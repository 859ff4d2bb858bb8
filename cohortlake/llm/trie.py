"""Prefix trie of conversations by van Emde Boas recursion.

Sequences are rows of turns. A problem is a set of sequences below one node, over 2^k turns. It is cut at half depth: what
sequences hold up to the cut is named (by the smallest conversation that holds it), equal cut prefixes go on as one
sequence of their summed weight in the upper trie, and the rest of each sequence goes on below the name of its prefix, in
the lower forest. All problems of a round are worked on at once, as rows with their problem's depth and root, so there are
as many rounds as the longest sequence's length has binary digits, and a sequence takes part from the round on whose cut
it reaches. A node is found exactly once as a cut: that of depth d where the half is the largest power of 2 in d.

Totals of subtrees are grafted upward in the same rounds: what lies in a lower forest is summed by its root and added to
that node, which hands it on, as its own, in the rounds that follow; so a chain of any length takes rounds, not steps.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.common import places, sent, stored

#: Cut prefixes (some 50 bytes each) that may be sent to every task.
BROADCAST_ROWS = 500_000
#: First turns taken from another conversation: a remainder by this number, less than it.
BORROW = 9
GROUP = 5
_ID_BITS = 12  # ids that differ in fewer bits alone are joined to one text before they are hashed in order


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, turn, role, text) to sequences (s, pos, tok, bytes, len) and all conversations (s, len).

    Conversation c gets the first h turns of conversation c - c % 5 (all if it has fewer, none if it is not there), then
    its own after its first h; h is unsigned crc32 of decimal c, modulo 9. ``tok`` is the digest of role and text.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    tok = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("s"), F.col("turn").alias("turn"), role.alias("role"), tok.alias("tok"), F.octet_length(text).cast("long").alias("bytes"))
    own = stored(places(rows, "s", ["turn", "role", "tok"], at="p").select("s", "p", "n", "tok", "bytes"), "turns")
    base, h = F.col("s") - F.col("s") % GROUP, (F.crc32(F.col("s").cast("string").cast("binary")) % BORROW).alias("h")
    heads = own.filter((F.col("s") % GROUP == 0) & (F.col("p") < BORROW - 1)).select(F.col("s").alias("base"), "p", F.col("tok").alias("tok"), "bytes")
    # of a base all conversations that may borrow are known from its number: the join below has no other key
    bases = heads.groupBy("base").agg(F.max("p").alias("last"))
    n_head = F.least(F.col("h"), F.coalesce(F.col("last") + 1, F.lit(0))).cast("long")
    own = own.withColumns({"base": base, "h": h}).join(bases, "base", "left").withColumn("head", n_head)
    own = own.withColumn("len", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).select("s", "p", "h", "head", "len", "base", "tok", "bytes")
    own = stored(own, "own")
    convs = own.filter("p = 0").select("s", "base", "head", "len")
    borrowed = convs.join(heads, "base").filter("p < head").select("s", F.col("p").alias("pos"), "tok", "bytes", "len")
    kept = own.filter("p >= h").select("s", (F.col("head") + F.col("p") - F.col("h")).alias("pos"), "tok", "bytes", "len")
    return stored(borrowed.union(kept), "sequences"), convs.select("s", "len")


def _root(roots: Column, top: int) -> Column:
    """The last root of a row; above the first cut the trie's own."""
    return F.when(F.size(roots) > 0, F.try_element_at(roots, F.lit(-1))).otherwise(F.lit(top))


def _cut(rows: DataFrame, half: int, top: int) -> tuple[DataFrame, DataFrame]:
    """One round: ``rows`` after the cut, and the sequences (s, depth, name) that end at it."""
    place = F.pmod(F.col("pos"), F.lit(2 * half))
    rows = rows.withColumn("lo", F.col("pos") - place).withColumn("upper", place < half)
    tall = rows.filter(F.col("upper") & (F.col("len") >= F.col("lo") + half))
    heads = tall.groupBy("lo", "s").agg(
        F.first(_root(F.col("roots"), top)).alias("r"), F.bit_xor(F.xxhash64("pos", "tok")).alias("d1"), F.bit_xor(F.xxhash64("tok", F.lit(1), "pos")).alias("d2"), F.first("w").alias("w"), F.first("len").alias("end")
    )
    heads = stored(heads, "heads")
    keys = ["lo", "r", "d1", "d2"]
    names = sent(heads.groupBy(*keys).agg(F.min("s").alias("name"), F.sum("w").alias("sum_w")), "names", BROADCAST_ROWS)
    named = sent(heads.join(names, keys).select("lo", "s", "name", "sum_w", "end"), "named", BROADCAST_ROWS)
    ends = named.filter(F.col("end") == F.col("lo") + half).select("s", F.col("end").alias("depth"), "name")
    after = rows.join(named.drop("end"), ["lo", "s"], "left").filter("not upper or name is null or name = s")
    cut, above = F.col("name").isNotNull(), F.col("upper")
    after = after.select(
        "s", "pos", "tok", "bytes", F.when(cut & above, F.col("lo") + half).otherwise(F.col("len")).alias("len"), F.when(cut & above, F.col("sum_w")).otherwise(F.col("w")).alias("w"),
        F.when(cut & ~above, F.concat("roots", F.array("name"))).otherwise(F.col("roots")).alias("roots"),
    )
    return stored(after, "rows"), ends


def _id_digests(ends: DataFrame) -> DataFrame:
    """(depth, name, ends_sha256): digests of the ascending, comma-joined ids of ``ends`` (s, depth, name).

    A digest is taken in order, so the ids of one node are read by one task, as a stream of joined blocks and never held.
    """
    blocks = ends.groupBy("depth", "name", F.shiftright("s", _ID_BITS).alias("block")).agg(F.array_join(F.array_sort(F.collect_list("s")).cast("array<string>"), ",").alias("ids"))
    keys = ["depth", "name"]

    def run(batches):
        node, h = None, None
        for b in batches:
            done = []
            for *key, ids in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if key != node:
                    if node:
                        done.append((*node, h.hexdigest()))
                    node, h = key, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield _frame(done)
        if node:
            yield _frame([(*node, h.hexdigest())])

    return blocks.repartition(*keys).sortWithinPartitions(*keys, "block").select(*keys, "ids").mapInArrow(run, "depth long, name long, ends_sha256 string")


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("depth", pa.int64()), ("name", pa.int64()), ("ends_sha256", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[c for c, _ in kinds])


def _ancestor(bit: Column | int) -> tuple[Column, Column]:
    """Depth and name of the root of the lower forest that a node lies in where half is 2^bit; that bit of ``pos`` is set."""
    high = F.expr(f"shiftright(pos, {bit})") if isinstance(bit, int) else F.call_function("shiftright", F.col("pos"), bit)
    depth = F.call_function("shiftleft", high, bit if isinstance(bit, Column) else F.lit(bit))
    return depth, F.element_at("roots", F.bit_count(high))


def _graft(nodes: DataFrame, rounds: int) -> DataFrame:
    """(depth, name, leaves, saved): what lies strictly below each inner node but the root. ``nodes`` has pos, roots and own values."""
    depth, name = _ancestor(F.col("bit"))
    bits = nodes.select("pos", "roots", "leaf", "own", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("bit"))
    bits = bits.filter(F.call_function("getbit", F.col("pos"), F.col("bit")) == 1)
    base = stored(bits.select(depth.alias("depth"), name.alias("name"), "leaf", "own").groupBy("depth", "name").agg(F.sum("leaf").alias("leaves"), F.sum("own").alias("saved")), "base")
    low = F.bit_count((F.col("depth").bitwiseAND(-F.col("depth"))) - 1)  # zeros at the end of the depth
    done: list[DataFrame] = []
    for bit in reversed(range(rounds)):
        now = base.filter(low == bit)
        for earlier in done:
            depth, name = _ancestor(bit)
            now = now.union(earlier.select(depth.alias("depth"), name.alias("name"), "leaves", "saved"))
        now = now.groupBy("depth", "name").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        inner = nodes.filter(low == bit).select("depth", "name", "pos", "roots")
        done.append(stored(now.join(inner, ["depth", "name"]), "grafts"))
    return functools.reduce(DataFrame.union, done).select("depth", "name", "leaves", "saved")


def prefix_trie(seqs: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes of the trie of ``seqs`` (s, pos from 0, tok, bytes, len) of the sequences ``convs`` (s distinct, len).

    Per node: conv_id (its smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves (of its
    subtree), saved_tokens, ends_sha256. Sequences without turns end at the root; without sequences there is no node.
    """
    r = convs.agg(F.min("s"), F.count(F.lit(1)), F.max("len")).first()
    top, n_all, rounds = r[0], r[1], (r[2] or 0).bit_length()
    fresh = seqs.select("s", "pos", "tok", "bytes", "len", F.lit(1).cast("long").alias("w"), F.array().cast("array<bigint>").alias("roots"))
    rows, ends = fresh.filter("false"), convs.filter("len = 0").select("s", F.lit(0).cast("long").alias("depth"), F.lit(top).cast("long").alias("name"))
    for bit in reversed(range(rounds)):
        rows, found = _cut(rows.union(fresh.filter((F.col("len") >= 1 << bit) & (F.col("len") < 2 << bit))), 1 << bit, top)
        ends = ends.union(found)
    rows = rows.withColumn("parent", _root(F.col("roots"), top or 0))
    nodes = rows.groupBy("pos", "parent", "tok").agg(F.min("s").alias("name"), F.sum("w").alias("n_convs"), F.first("bytes").alias("bytes"), F.first("roots").alias("roots"))
    nodes = stored(nodes.withColumn("depth", F.col("pos") + 1), "nodes")
    children = nodes.groupBy(F.col("pos").alias("depth"), F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["depth", "name"], "left").fillna(0, ["n_children"])
    nodes = stored(nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "own": (F.col("n_convs") - 1) * F.col("bytes")}), "nodes")
    inner = nodes.join(_graft(nodes, rounds), ["depth", "name"], "left") if rounds else nodes.withColumns({"leaves": F.lit(0), "saved": F.lit(0)})
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    inner = inner.select("name", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", (F.col("leaf") + zero("leaves")).cast("long").alias("n_leaves"), (F.col("own") + zero("saved")).cast("long").alias("saved_tokens"))
    totals = nodes.agg(F.sum((F.col("pos") == 0).cast("long")).alias("c"), F.sum("leaf").alias("leaves"), F.sum("own").alias("saved"))
    root = totals.filter(F.lit(n_all > 0)).select(F.lit(top).cast("long").alias("name"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(n_all).cast("long").alias("n_convs"), zero("c").alias("n_children"), F.greatest(zero("leaves"), F.lit(1)).alias("n_leaves"), zero("saved").alias("saved_tokens"))
    out = inner.union(root).join(_id_digests(ends), ["depth", "name"], "left")
    return out.select(F.col("name").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The prefix trie of all rebuilt conversations of ``turns`` (conv_id, turn, role, text).

    Turns stand by ``turn``, null first; of equal ones by role, then by the digest of role and text. A null role or text is
    an empty one; rows without a conv_id belong to no conversation. Equal rows are a turn each. Texts of any length are
    hashed where they are read. Other columns are ignored, whatever their names; an empty table has no node.
    """
    return prefix_trie(*rebuild(turns))
