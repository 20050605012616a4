"""The prefix tree of conversations, built from the depths at which each conversation owns its prefix.

A node is a distinct sequence of first turns; the conversation with the least id among those that start with it owns it. A
conversation that owns its prefix at one depth owns all its deeper ones too, so what it owns is a chain, and its first owned depth is found by
binary search. Each round joins all open conversations' digests at their middle depths with the least conversation of each digest that several
conversations share; a digest that isn't there is the conversation's own. The last prefix above the chain that isn't owned names the parent. Chains form
a tree; what a chain's nodes hold is added up over the chains below by pointer doubling, in as many rounds as the logarithm of the
tree's height, and then along each chain from its end.

No conversation is taken as a whole by one task, however many turns it has: turns are placed by ranges of (conversation, turn), and sums along a
conversation or a chain run within spans of `SPAN` turns, to which the sums of earlier spans are added. A prefix's digest is the sum of its turns'
128-bit hashes, each salted by its depth. Texts are read once and don't move; only their hashes and lengths do. The ids of conversations that end in
one node, copies of each other, are sorted by ranges and hashed from a stream of joined strings.

Nulls and edge cases: turns go by number, null first, and equal numbers by a digest of role and text; null role and text are empty; turns
without a conversation are left out; repeated rows are turns each; conversations that have no turns after rebuilding end in the root; other
columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Table

#: Turns of a conversation or nodes of a chain that are summed by one task, and digests in a row.
SPAN = 1024
#: Ids in one string of those that are hashed.
_JOINED = 2048
_HALF = (1 << 32) - 1
_LOCAL = (1 << 33) - 1


def running(rows: DataFrame, key: str, place: str, sums: list[str], descending: bool = False, span: int = SPAN) -> DataFrame:
    """Rows with the columns `sums` summed over the rows of the same key up to each place (or from it on, if descending)."""
    order = F.desc if descending else F.asc
    cut = rows.withColumn("part", F.floor(F.col(place) / F.lit(span)))
    within = Window.partitionBy(key, "part").orderBy(order(place)).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy(order("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy(key, "part").agg(*(F.sum(c).alias(c) for c in sums))
    before = parts.select(key, "part", *(F.sum(c).over(earlier).alias(f"before_{c}") for c in sums)).where(f"before_{sums[0]} is not null")
    summed = cut.withColumns({c: F.sum(c).over(within) for c in sums}).join(before, [key, "part"], "left")
    return summed.withColumns({c: F.col(c) + F.coalesce(f"before_{c}", F.lit(0)) for c in sums}).select(*rows.columns)


def placed_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[Table, DataFrame]:
    """The turns (at, conv, said, chars) in order, and (first, before) of each range, by which `at` becomes a number without gaps."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text_col, role_col))
    said = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), said.alias("said"), F.length(text).cast("long").alias("chars")).where("conv is not null")
    order = ["conv", "turn", "said"]
    ranked = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    turns = Table(ranked.select(F.monotonically_increasing_id().alias("at"), "conv", "said", "chars"), "turns")
    counts = sorted(turns.df.groupBy(F.shiftright("at", 33).alias("range")).count().collect())  # one row a range
    before = accumulate((n for _, n in counts), initial=0)
    ranges = [(k, b) for (k, _), b in zip(counts, before, strict=False)]
    return turns, conversations.sparkSession.createDataFrame(ranges, "range long, before long")


def rebuilt_turns(turns: DataFrame, convs: DataFrame, shared: int) -> DataFrame:
    """(conv, depth, said, chars): each conversation's first turns from its base, then its own after as many."""
    own = turns.join(convs, "conv").withColumn("place", F.col("number") - F.col("first") + 1)
    kept = own.where("place > heads").select("conv", (F.col("place") - F.col("heads") + F.col("grafted")).alias("depth"), "said", "chars")
    if not shared:
        return kept
    first = own.where((F.col("place") <= shared) & F.col("is_base")).select(F.col("conv").alias("base"), F.col("place").alias("depth"), "said", "chars")
    given = convs.select("conv", "base", "grafted").join(first, "base").where("depth <= grafted").select("conv", "depth", "said", "chars")
    return kept.unionByName(given)


def with_digests(turns: DataFrame) -> DataFrame:
    """(conv, depth, chars, d1, d2): the digest of the turns up to each depth."""
    hashes = [F.xxhash64(F.lit(k), "depth", "said") for k in (1, 2)]
    halves = {f"s{k}{j}": (F.shiftrightunsigned(h, 32) if j == 0 else h.bitwiseAND(F.lit(_HALF))) for k, h in enumerate(hashes) for j in (0, 1)}
    summed = running(turns.select("conv", "depth", "chars", *(h.alias(n) for n, h in halves.items())), "conv", "depth", list(halves))
    joined = [F.shiftleft(F.col(f"s{k}0").bitwiseAND(F.lit(_HALF)), 32).bitwiseOR(F.col(f"s{k}1").bitwiseAND(F.lit(_HALF))).alias(f"d{k + 1}") for k in (0, 1)]
    return summed.select("conv", "depth", "chars", *joined)


def first_owned(convs: DataFrame, digests: DataFrame, shared: DataFrame, root: int) -> Table:
    """(conv, length, low, parent): the first depth at which each conversation owns its prefix, length + 1 if none, and the owner of the
    prefix above. digests: (conv, part, list); shared: (depth, d1, d2, owner) of prefixes that several conversations have."""
    is_root = F.col("conv") == root
    low = F.when(is_root, 0).otherwise(1).cast("long")
    state = Table(convs.select("conv", "length", low.alias("low"), F.when(is_root, 0).otherwise(F.col("length") + 1).cast("long").alias("high"), F.when(~is_root, root).cast("long").alias("parent")), "search")
    while True:
        open_ = state.df.where("low < high").withColumn("depth", F.floor((F.col("low") + F.col("high")) / 2))
        least, most = open_.agg(F.min("depth"), F.max("depth")).first()
        if least is None:
            return state
        found = open_.withColumn("part", F.floor((F.col("depth") - 1) / SPAN)).join(digests, ["conv", "part"])
        at = found.withColumn("digest", F.expr(f"list[cast((depth - 1) % {SPAN} as int)]"))
        probes = at.select("conv", "length", "low", "high", "parent", "depth", F.col("digest.d1").alias("d1"), F.col("digest.d2").alias("d2"))
        known = probes.join(shared.where(F.col("depth").between(least, most)), ["depth", "d1", "d2"], "left").withColumn("own", F.coalesce(F.col("owner") == F.col("conv"), F.lit(True)))
        moved = known.select("conv", "length", F.when(F.col("own"), F.col("low")).otherwise(F.col("depth") + 1).alias("low"), F.when(F.col("own"), F.col("depth")).otherwise(F.col("high")).alias("high"), F.when(F.col("own"), F.col("parent")).otherwise(F.col("owner")).alias("parent"))
        last, state = state, Table(moved.unionByName(state.df.where("low >= high")), "search")
        last.drop()


def below(chains: DataFrame, sums: list[str]) -> Table:
    """(conv, sums): the sums over each chain and all chains below it, of (conv, parent, sums)."""
    state = Table(chains.select("conv", F.col("parent").alias("up"), *sums), "below")
    while not state.df.where("up is not null").isEmpty():
        rising = state.df.where("up is not null")
        gained = rising.groupBy(F.col("up").alias("conv")).agg(*(F.sum(c).alias(f"more_{c}") for c in sums))
        next_up = rising.select("conv", "up").join(state.df.select(F.col("conv").alias("up"), F.col("up").alias("next")), "up").where("next is not null").select("conv", F.col("next").alias("up"))
        added = state.df.drop("up").join(gained, "conv", "left").select("conv", *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums))
        last, state = state, Table(added.join(next_up, "conv", "left"), "below")
        last.drop()
    return state


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (owner, depth, conv) as strings of up to _JOINED ids: (owner, depth, first, ids)."""
    for batch in batches:
        runs: list[list] = []
        for owner, depth, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not runs or runs[-1][:2] != [owner, depth] or len(runs[-1][3]) == _JOINED:
                runs.append([owner, depth, conv, []])
            runs[-1][3].append(str(conv))
        yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in runs], pa.int64()) for k in range(3)), pa.array([",".join(r[3]) for r in runs], pa.string())], names=["owner", "depth", "first", "ids"])


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(owner, depth, digest) of strings that come sorted."""
    key, state, done = None, None, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([d[k] for d in done], pa.int64()) for k in (0, 1)), pa.array([d[2] for d in done], pa.string())], names=["owner", "depth", "ends_sha256"])

    for batch in batches:
        for owner, depth, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (owner, depth):
                if key:
                    done.append((*key, state.hexdigest()))
                key, state = (owner, depth), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield out()
        done.clear()
    if key:
        done.append((*key, state.hexdigest()))
        yield out()


def ends_digests(ends: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256) of (owner, depth, conv)."""
    order = ["owner", "depth", "conv"]
    strings = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_joined_ids, "owner long, depth long, first long, ids string")
    return strings.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first").mapInArrow(_hashed_ids, "owner long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", base: Column | None = None, heads: Column | None = None, most_heads: int = 0) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row a node.

    If `base` and `heads` are given, columns of `conv`, the first `heads` turns (`most_heads` at most) of every conversation are replaced by those
    of the conversation `base` before the tree is built.
    """
    turns, ranges = placed_turns(conversations, conv_col, turn_col, role_col, text_col)
    numbered = turns.df.withColumn("range", F.shiftright("at", 33)).join(F.broadcast(ranges), "range").select("conv", "said", "chars", (F.col("before") + F.col("at").bitwiseAND(F.lit(_LOCAL))).alias("number"))
    counted = numbered.groupBy("conv").agg(F.min("number").alias("first"), F.count("*").alias("turns"))
    named = counted.withColumns({"base": F.col("conv") if base is None else base.cast("long"), "heads": F.lit(0).cast("long") if heads is None else heads.cast("long")})
    bases = named.select(F.col("base")).distinct().join(counted.select(F.col("conv").alias("base"), F.col("turns").alias("base_turns")), "base")
    grafted = F.least("heads", F.coalesce("base_turns", F.lit(0).cast("long")))
    convs = Table(named.join(bases, "base", "left").select("conv", "first", "base", "heads", (F.col("conv") == F.col("base")).alias("is_base"), grafted.alias("grafted"), (grafted + F.greatest(F.lit(0), F.col("turns") - F.col("heads"))).alias("length")), "conversations")
    root, total = convs.df.agg(F.min("conv"), F.count("*")).first()
    rebuilt = Table(rebuilt_turns(numbered, convs.df, most_heads if heads is not None else 0), "rebuilt")
    turns.drop()
    prefixes = Table(with_digests(rebuilt.df), "prefixes")
    rebuilt.drop()
    nodes = Table(prefixes.df.groupBy("depth", "d1", "d2").agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.first("chars").alias("chars")), "nodes")
    listed = prefixes.df.groupBy("conv", F.floor((F.col("depth") - 1) / SPAN).alias("part")).agg(F.sort_array(F.collect_list(F.struct("depth", "d1", "d2"))).alias("list"))
    digests = Table(listed, "digests")
    prefixes.drop()
    found = first_owned(convs.df, digests.df, nodes.df.where("n_convs > 1").select("depth", "d1", "d2", "owner"), root)
    digests.drop()
    chains = found.df.where("low <= length").select("conv", "length", "low", "parent")
    ends = found.df.select(F.when(F.col("low") <= F.col("length"), F.col("conv")).otherwise(F.col("parent")).alias("owner"), F.col("length").alias("depth"), "conv")
    top = conversations.sparkSession.createDataFrame([(root, 0, total, 0)] if total else [], "owner long, depth long, n_convs long, chars long")
    own = nodes.df.select("owner", "depth", "n_convs", "chars").unionByName(top).withColumn("saved", (F.col("n_convs") - 1) * F.col("chars"))
    attached = chains.where("parent is not null").select(F.col("parent").alias("owner"), (F.col("low") - 1).alias("depth"), F.col("conv").alias("child"))
    full = attached.select("owner", F.col("depth").alias("length")).distinct().withColumn("inner", F.lit(True))
    values = chains.join(own.groupBy(F.col("owner").alias("conv")).agg(F.sum("saved").alias("saved")), "conv").join(full.withColumnRenamed("owner", "conv"), ["conv", "length"], "left")
    sums = below(values.select("conv", "parent", "saved", F.when(F.col("inner"), 0).otherwise(1).cast("long").alias("leaves")), ["saved", "leaves"])
    side = attached.join(sums.df.select(F.col("conv").alias("child"), "saved", "leaves"), "child").groupBy("owner", "depth").agg(F.count("*").alias("chains"), F.sum("saved").alias("more"), F.sum("leaves").alias("leaves"))
    whole = own.join(side, ["owner", "depth"], "left").join(chains.withColumnRenamed("conv", "owner"), "owner").na.fill(0, ["chains", "more", "leaves"])
    last = F.col("depth") == F.col("length")
    each = Table(
        whole.select(
            "owner",
            "depth",
            F.when(F.col("depth") > F.col("low"), F.col("owner")).otherwise(F.col("parent")).alias("parent"),
            "n_convs",
            (F.col("chains") + F.when(last, 0).otherwise(1)).alias("children"),
            (F.col("leaves") + F.when(last & (F.col("chains") == 0), 1).otherwise(0)).alias("leaves"),
            (F.col("saved") + F.col("more")).alias("saved"),
        ),
        "trie",
    )
    out = running(each.df, "owner", "depth", ["leaves", "saved"], descending=True).join(ends_digests(ends), ["owner", "depth"], "left")
    for t in (convs, nodes, sums):
        t.drop()
    return out.select(
        F.col("owner").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        F.col("children").cast("long").alias("n_children"),
        F.col("leaves").cast("long").alias("n_leaves"),
        F.col("saved").cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
