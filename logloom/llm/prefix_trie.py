"""Conversation prefix trie: which turns conversations share from their start, and what sharing saves.

Every distinct sequence of the first d turns is a node.  Conversations with the same turns are one
class first, so copies never travel one by one.  Distinct turns get ids from a dictionary, a class
becomes a path of ids in segments of ``SEGMENT`` turns, and equal segments below the same node become
one item with its weight.  Items are unique, so ranges of them are even shards even where a third of
all conversations start alike.

A shard builds a ternary search tree per node it hangs below: paths are inserted median first, which
balances the tree, and its nodes, whose parents always precede them, are gone through backwards to
add up members, leaves and savings.  A node on the path of a shard's first or last item may go on in
the neighbouring shards; these boundary nodes are written apart, merged by their prefix, and their sums
are passed to their ancestors, at most ``SEGMENT`` of them.

Paths go on segment by segment while at least two classes share a node.  A class that goes on alone is
a chain whose nodes follow from running sums.  The rounds are as many as the longest shared start has
segments; the sums of a round flow into the items of the one before.

Large groups: a turn or item that holds more than one in ``HOT`` of all rows is looked up by broadcast
(there are at most ``HOT`` of those), long conversations are joined by ranges of depth, and the ids of a
large class are joined to texts of up to ``BLOCK`` ids before one task hashes them in order, as
SHA-256 demands.

Cases: a null role or text is empty; null turns come first; equal turns are ordered by role, then text,
and repeated rows are turns of their own; rows with a null conv_id belong to no conversation and
are left out; texts of any length are seen by their hash and length alone; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.common import staged, string_or_empty, table
from logloom.llm.structure_repair import crc32_sql
from logloom.operators.ordering import position

SEGMENT = 16
SHARD_ITEMS = 50_000
HOT = 1_000
BLOCK = 4_096  # conversation ids, or turns of one conversation, that are handled as one range
EMPTY_HASH = sha256(b"").hexdigest()

NODE_SCHEMA = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends_sha256 string"
)
NODE_COLUMNS = [part.split()[0] for part in NODE_SCHEMA.split(", ")]


def _range(column: str) -> Column:
    return F.floor(F.col(column) / BLOCK).cast("long")


def number_turns(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 1), digest and chars of every turn, in the order of turns; a table of its own."""
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        string_or_empty(F.col("role")).alias("role"), string_or_empty(F.col("text")).alias("text"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    placed = position(turns, ["conv"], order, F.coalesce(_range("turn"), F.lit(-(1 << 62))), "pos")
    digest = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return staged(placed.select("conv", "pos", digest.alias("digest"), F.char_length("text").alias("chars")), "trie-turns")


def rebuilt(turns: DataFrame, family: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, digest, chars) and (conv, len): the first h turns come from the family's first conversation."""
    base = F.col("conv") - F.col("conv") % family
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("long")
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).select("conv", "n", base.alias("base"), h.alias("h"))
    first = sizes.where("conv = base").select(F.col("conv").alias("base"), F.col("n").alias("there"))
    known = sizes.join(first, "base", "left").withColumn("took", F.least("h", F.coalesce("there", F.lit(0))))
    known = staged(known.withColumn("len", F.col("took") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "trie-sizes")
    donors = turns.where((F.col("conv") == base) & (F.col("pos") < most)).select(F.col("conv").alias("base"), F.col("pos").alias("depth"), "digest", "chars")
    head = known.where("took > 0").select("conv", "base", "took").join(donors, "base").where("depth <= took")
    # only behind a base that is too short a turn moves up; a long conversation is met range by range
    moved = known.where("took < h").select("conv", (F.col("h") - F.col("took")).alias("up"), F.explode(F.sequence(F.lit(0).cast("long"), _range("n"))).alias("range"))
    own = turns.where(F.col("pos") > h).withColumn("range", _range("pos")).join(moved, ["conv", "range"], "left")
    own = own.select("conv", (F.col("pos") - F.coalesce("up", F.lit(0))).alias("depth"), "digest", "chars")
    return staged(head.select("conv", "depth", "digest", "chars").unionByName(own), "trie-rebuilt"), known.select("conv", "len")


# ---- classes of equal conversations ------------------------------------------


def _hash_ids(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per class from its blocks of ids, which come in order."""
    at, running, rep, n = None, None, 0, 0
    names = ["rep", "len", "n", "ends"]
    for part in parts:
        out = []
        for key, low, count, ids in zip(zip(part["len"], part["x"], part["y"]), part["low"], part["count"], part["ids"]):
            if key != at:
                if at is not None:
                    out.append((rep, at[0], n, running.hexdigest()))
                at, running, rep, n = key, sha256(), low, 0
            else:
                running.update(b",")
            running.update(ids.encode())
            n += count
        yield pd.DataFrame(out, columns=names)
    if at is not None:
        yield pd.DataFrame([(rep, at[0], n, running.hexdigest())], columns=names)


def classes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """rep (least member), len, n, ends: the conversations with the same turns.

    Their turns are compared by two sums of hashes of depth and SHA-256, which add up before the
    shuffle and need no sequence in one place.
    """
    mark = lambda *c: F.bit_xor(F.xxhash64(*c))
    sums = turns.groupBy("conv").agg(mark("depth", "digest").alias("x"), mark("digest", F.lit("again"), "depth").alias("y"))
    keyed = convs.join(sums, "conv", "left").select("conv", "len", *[F.coalesce(c, F.lit(0)).alias(c) for c in "xy"])
    blocks = keyed.groupBy("len", "x", "y", _range("conv").alias("block")).agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    ready = blocks.select(
        "len", "x", "y", "block", F.col("ids")[0].alias("low"), F.size("ids").alias("count"),
        F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"),
    )
    sorted_ = ready.repartition("len", "x", "y").sortWithinPartitions("len", "x", "y", "block")
    return staged(sorted_.mapInPandas(_hash_ids, "rep bigint, len bigint, n bigint, ends string"), "trie-classes")


# ---- ids and segments --------------------------------------------------------


def looked_up(rows: DataFrame, found: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """`rows` with the columns of `found` by `keys`; keys of many rows (`weight`) are met by broadcast."""
    frequent = F.col(weight) * HOT > total  # at most HOT keys, as weights add up to the total
    cold = found.where(~frequent).drop(weight)
    hot = found.where(frequent).drop(weight)
    marked = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), keys, "left")
    added = [c for c in cold.columns if c not in keys]
    rest = marked.where("__hot IS NULL").select(*rows.columns).join(cold, keys)
    return marked.where("__hot").select(*rows.columns, *added).unionByName(rest.select(*rows.columns, *added))


def segments(turns: DataFrame, known: DataFrame) -> DataFrame:
    """rep, len, n, ends, seg, path (ids of its turns), chars (their lengths) of every class."""
    spread = known.where("len > 0").select(
        F.col("rep").alias("conv"), "len", "n", "ends", F.explode(F.sequence(F.lit(0).cast("long"), _range("len"))).alias("range")
    )
    own = turns.withColumn("range", _range("depth")).join(spread, ["conv", "range"]).drop("range")
    own = staged(own, "trie-class-turns")
    counted = own.groupBy("digest").agg(F.count(F.lit(1)).alias("weight"))
    ids = staged(counted.withColumn("id", F.monotonically_increasing_id()), "trie-dictionary")
    encoded = looked_up(own, ids, ["digest"], "weight", own.count())
    placed = F.sort_array(F.collect_list(F.struct("depth", "id", "chars")))
    cut = encoded.groupBy(F.col("conv").alias("rep"), "len", "n", "ends", F.floor((F.col("depth") - 1) / SEGMENT).cast("long").alias("seg"))
    made = cut.agg(placed.alias("turns")).select(
        "rep", "len", "n", "ends", "seg", F.transform("turns", lambda t: t["id"]).alias("path"), F.transform("turns", lambda t: t["chars"].cast("long")).alias("chars")
    )
    return staged(made.repartitionByRange("seg", "rep"), "trie-segments")  # a round reads the files of its segment


# ---- one shard ---------------------------------------------------------------


@dataclass
class SearchTree:
    """A ternary search tree over paths of ids; node i has its parent in `up`, always before it."""

    key: list[int] = field(default_factory=list)
    less: list[int] = field(default_factory=list)
    more: list[int] = field(default_factory=list)
    below: list[int] = field(default_factory=list)
    up: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    by: list[int] = field(default_factory=list)  # the item that made the node
    item: list[int] = field(default_factory=list)  # the item that ends at the node, or -1
    top: int = -1

    def _new(self, key: int, up: int, depth: int, item: int) -> int:
        for column, value in (
            (self.key, key), (self.less, -1), (self.more, -1), (self.below, -1), (self.up, up), (self.depth, depth), (self.by, item), (self.item, -1)
        ):
            column.append(value)
        return len(self.key) - 1

    def insert(self, path: list[int], item: int) -> None:
        up, links, at = -1, None, self.top  # `links[up]` is where a new node is hung
        for depth, key in enumerate(path, 1):
            place = up
            while at >= 0 and self.key[at] != key:
                links, place = (self.less if key < self.key[at] else self.more), at
                at = links[at]
            if at < 0:
                at = self._new(key, up, depth, item)
                if links is None:
                    self.top = at
                else:
                    links[place] = at
            up, links, at = at, self.below, self.below[at]
        self.item[up] = item

    def path_nodes(self, path: list[int]) -> list[int]:
        out, at = [], self.top
        for key in path:
            while self.key[at] != key:
                at = self.less[at] if key < self.key[at] else self.more[at]
            out.append(at)
            at = self.below[at]
        return out


def build(paths: list[list[int]]) -> SearchTree:
    """Sorted paths, inserted median first."""
    tree, ranges = SearchTree(), [(0, len(paths))]
    while ranges:
        low, high = ranges.pop()
        if low < high:
            middle = (low + high) // 2
            tree.insert(paths[middle], middle)
            ranges += [(middle + 1, high), (low, middle)]
    return tree


NODE, HANGING, EDGE, ROOT = range(4)
_SHARD = T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("shard", T.LongType()), T.StructField("root", T.LongType()),
    T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("depth", T.LongType()), T.StructField("conv", T.LongType()),
    T.StructField("above", T.LongType()), T.StructField("n", T.LongType()), T.StructField("children", T.LongType()),
    T.StructField("leaves", T.LongType()), T.StructField("saved", T.LongType()), T.StructField("chars", T.LongType()), T.StructField("ends", T.StringType()),
])


def tree_rows(shard: int, root: int, items: pd.DataFrame, opens: bool, closes: bool) -> list[tuple]:
    """The nodes of one tree.  `opens`, `closes`: its first or last item is the shard's.

    NODE rows are whole; HANGING ones lack the parent's conversation, which is a boundary node (its
    prefix is given); EDGE rows are a boundary node's part, without its boundary children; a ROOT
    row sums up the node that the tree hangs below.
    """
    paths = [[int(k) for k in p] for p in items["path"]]
    chars, conv, n = (items[c].tolist() for c in ("chars", "conv", "n"))
    ends = items["ends"].tolist()
    more = [items[c].tolist() for c in ("children", "leaves", "saved")]  # below the end of an item's path
    tree = build(paths)
    size = len(tree.key)
    open_ = bytearray(size)
    for path in ([paths[0]] if opens else []) + ([paths[-1]] if closes else []):
        for node in tree.path_nodes(path):
            open_[node] = 1
    total, least = [0] * size, [None] * size
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    tops = [0, 0, 0]
    root_open = opens or closes
    for i in range(size - 1, -1, -1):
        own = tree.item[i]
        if own >= 0:
            total[i] += n[own]
            least[i] = conv[own] if least[i] is None else min(least[i], conv[own])
            children[i] += more[0][own]
            leaves[i] += more[1][own]
            saved[i] += more[2][own]
        up = tree.up[i]
        if up >= 0:
            total[up] += total[i]
            least[up] = least[i] if least[up] is None else min(least[up], least[i])
        if open_[i]:  # its sums wait for the neighbours; so does its place among its parent's children
            continue
        if not children[i]:
            leaves[i] = 1
        saved[i] += (total[i] - 1) * int(chars[tree.by[i]][tree.depth[i] - 1])
        if up >= 0:
            children[up] += 1
            leaves[up] += leaves[i]
            saved[up] += saved[i]
        else:
            tops = [tops[0] + 1, tops[1] + leaves[i], tops[2] + saved[i]]
    out = [(EDGE if root_open else ROOT, shard, root, [], 0, root, None, 0, *tops, 0, None)]
    for i in range(size):
        up, depth = tree.up[i], tree.depth[i]
        hangs = not open_[i] and up >= 0 and open_[up]
        prefix = paths[tree.by[i]][:depth] if open_[i] else paths[tree.by[i]][: depth - 1] if hangs else None
        above = root if up < 0 else None if open_[i] or hangs else least[up]
        out.append((
            EDGE if open_[i] else HANGING if hangs else NODE, shard, root, prefix, depth, least[i], above, total[i], children[i],
            leaves[i], saved[i], int(chars[tree.by[i]][depth - 1]), ends[tree.item[i]] if tree.item[i] >= 0 else None,
        ))
    return out


def _shard_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trees of one shard, whose items come sorted by the node they hang below and their path."""
    held = [p for p in parts if len(p)]
    if not held:
        return
    items = pd.concat(held, ignore_index=True)
    shard = TaskContext.get().partitionId()
    starts = [0, *(i for i in range(1, len(items)) if items["parent"].iat[i] != items["parent"].iat[i - 1]), len(items)]
    for low, high in zip(starts, starts[1:]):
        own = items.iloc[low:high]
        rows = tree_rows(shard, int(own["parent"].iat[0]), own, low == 0, high == len(items))
        yield pd.DataFrame(rows, columns=_SHARD.names)


# ---- rounds ------------------------------------------------------------------


def _forward(cut: DataFrame, root: int) -> tuple[list[DataFrame], DataFrame | None]:
    """The items of every round, and the chains (round, rep, n, above) of classes that go on alone."""
    rounds: list[DataFrame] = []
    chains: DataFrame | None = None
    going = cut.where("seg = 0").withColumn("parent", F.lit(root).cast("long"))
    while True:
        k = len(rounds)
        goes_on = F.col("len") > (k + 1) * SEGMENT
        items = staged(
            going.groupBy("parent", "path", "chars").agg(
                F.min("rep").alias("conv"), F.sum("n").alias("n"), F.max(F.when(~goes_on, F.col("ends"))).alias("ends"),
                F.count_if(goes_on).alias("on"), F.max(F.when(goes_on, F.col("rep"))).alias("one"), F.sum(F.when(goes_on, F.col("n"))).alias("one_n"),
            ),
            "trie-items",
        )
        rounds.append(items)
        alone = items.where("on = 1").select(F.lit(k).cast("long").alias("round"), F.col("one").alias("rep"), F.col("one_n").alias("n"), F.col("conv").alias("above"))
        chains = alone if chains is None else chains.unionByName(alone)
        shared = items.where("on > 1")
        total = shared.agg(F.sum("on")).first()[0]
        if not total:
            return rounds, chains
        members = going.where(goes_on).select("parent", "path", "rep")
        meets = looked_up(members, shared.select("parent", "path", F.col("conv").alias("under"), F.col("on").alias("weight")), ["parent", "path"], "weight", total)
        meets = meets.select("rep", F.col("under").alias("parent"))
        going = staged(cut.where(F.col("seg") == k + 1).join(meets, "rep"), "trie-going")


def _chain_nodes(cut: DataFrame, chains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of classes that go on alone, and (round, above, children, leaves, saved) of each chain."""
    own = cut.drop("n").join(chains, "rep").where(F.col("seg") > F.col("round"))
    add = lambda a, b: a + b
    zero = F.lit(0).cast("long")
    summed = staged(own.withColumn("s", F.aggregate("chars", zero, add)).withColumn("block", _range("seg")), "trie-chains")
    later = Window.partitionBy("rep").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("rep", "block").orderBy(F.col("seg").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = summed.groupBy("rep", "block").agg(F.sum("s").alias("s")).select("rep", "block", F.coalesce(F.sum("s").over(later), zero).alias("later"))
    placed = summed.withColumn("after", F.coalesce(F.sum("s").over(inside), zero)).join(blocks, ["rep", "block"])
    turns = placed.select("*", F.posexplode("chars").alias("i", "c"))
    rest = F.aggregate(F.slice("chars", F.col("i") + 1, F.lit(SEGMENT)), zero, add) + F.col("after") + F.col("later")
    depth = F.col("seg") * SEGMENT + F.col("i") + 1
    first = depth == (F.col("round") + 1) * SEGMENT + 1
    nodes = turns.select(
        F.col("rep").alias("conv_id"), depth.alias("depth"), F.when(first, F.col("above")).otherwise(F.col("rep")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), (depth < F.col("len")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("n") - 1) * rest).alias("saved_tokens"), F.when(depth == F.col("len"), F.col("ends")).otherwise(EMPTY_HASH).alias("ends_sha256"),
    )
    one = F.lit(1).cast("long")
    ends = summed.groupBy("round", "above", "rep", "n").agg(F.sum("s").alias("s"))
    return nodes, ends.select("round", "above", one.alias("children"), one.alias("leaves"), ((F.col("n") - 1) * F.col("s")).alias("saved"))


def _merge(parts: DataFrame) -> DataFrame:
    """Boundary nodes from their parts: root, prefix and the columns of a node; the empty prefix is the root."""
    keys = ["root", "prefix"]
    total = parts.groupBy(*keys).agg(
        F.min("conv").alias("conv"), F.sum("n").alias("n"), F.max("ends").alias("ends"), F.max("chars").alias("chars"),
        *[F.sum(c).alias(c) for c in ("children", "leaves", "saved")],
    )
    total = staged(total, "trie-boundary")
    shorter = F.slice("prefix", F.lit(1), F.size("prefix") - 1)
    up = total.where(F.size("prefix") > 0).select("root", shorter.alias("prefix"))
    grown = total.join(up.groupBy(*keys).agg(F.count(F.lit(1)).alias("more")), keys, "left").withColumn(
        "children", F.col("children") + F.coalesce("more", F.lit(0))
    ).drop("more")
    inner = F.size("prefix") > 0
    own_leaf = F.when(inner & (F.col("children") == 0), 1).otherwise(0)
    own_saved = F.when(inner, (F.col("n") - 1) * F.col("chars")).otherwise(0)
    passed = grown.select(
        "root", F.explode(F.transform(F.sequence(F.lit(0), F.size("prefix")), lambda j: F.slice(F.col("prefix"), F.lit(1), j))).alias("prefix"),
        (F.col("leaves") + own_leaf).alias("leaves"), (F.col("saved") + own_saved).alias("saved"),
    )
    sums = passed.groupBy(*keys).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    above = total.select("root", F.col("prefix").alias("__shorter"), F.col("conv").alias("above"))
    whole = grown.drop("leaves", "saved").join(sums, keys).withColumn("__shorter", F.when(inner, shorter))
    return staged(whole.join(above, ["root", "__shorter"], "left").drop("__shorter"), "trie-boundary")


def _round_nodes(items: DataFrame, below: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of one round, and (root, children, leaves, saved) of the nodes its trees hang below.

    `below` has the same columns for the ends of this round's items, by their conversation.
    """
    filled = items.join(below.withColumnRenamed("root", "conv"), "conv", "left").select(
        "parent", "path", "chars", "conv", "n", "ends", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("children", "leaves", "saved")]
    )
    filled = staged(filled, "trie-filled")
    shards = -(-filled.count() // SHARD_ITEMS) or 1
    ranged = filled.repartitionByRange(shards, "parent", "path").sortWithinPartitions("parent", "path")
    rows = staged(ranged.mapInPandas(_shard_rows, _SHARD), "trie-shards")
    parts = rows.where(F.col("kind") == EDGE)
    merged = _merge(parts)
    # a hanging node finds its parent among the boundary nodes of its own shard, so no key is large
    owners = parts.select("shard", "root", "prefix").join(merged.select("root", "prefix", F.col("conv").alias("owner")), ["root", "prefix"])
    hanging = rows.where(F.col("kind") == HANGING).join(owners, ["shard", "root", "prefix"]).withColumn("above", F.col("owner"))
    names = ["depth", "conv", "above", "n", "children", "leaves", "saved", "ends"]
    inner = merged.where(F.size("prefix") > 0).withColumn("depth", F.size("prefix").cast("long"))
    found = rows.where(F.col("kind") == NODE).select(*names).unionByName(hanging.select(*names)).unionByName(inner.select(*names))
    nodes = found.select(
        F.col("conv").alias("conv_id"), (F.col("depth") + k * SEGMENT).alias("depth"), F.col("above").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY_HASH)).alias("ends_sha256"),
    )
    sums = ["root", "children", "leaves", "saved"]
    roots = rows.where(F.col("kind") == ROOT).select(*sums).unionByName(merged.where(F.size("prefix") == 0).select(*sums))
    return nodes, staged(roots, "trie-roots")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node (NODE_COLUMNS) from (conv, depth, digest, chars) and (conv, len).

    Depths of a conversation run from 1 to its len; equal digests mean equal turns.
    """
    spark = turns.sparkSession
    known = classes(turns, convs)
    root, total = known.agg(F.min("rep"), F.sum("n")).first()
    if total is None:
        return spark.createDataFrame([], NODE_SCHEMA)
    cut = segments(turns, known)
    rounds, chains = _forward(cut, root)
    nodes, chained = _chain_nodes(cut, chains)
    sums = ["children", "leaves", "saved"]
    deeper: DataFrame | None = None
    for k in range(len(rounds) - 1, -1, -1):
        below = chained.where(F.col("round") == k).select(F.col("above").alias("root"), *sums)
        if deeper is not None:
            below = below.unionByName(deeper)
        own, deeper = _round_nodes(rounds[k], below, k)
        nodes = nodes.unionByName(own)
    top = known.where("len = 0").agg(F.max("ends").alias("ends"), F.lit(1).alias("__one"))
    summed = deeper.agg(*[F.sum(c).alias(c) for c in sums], F.lit(1).alias("__one"))
    one = top.join(summed, "__one").select(
        F.lit(root).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(total).cast("long").alias("n_convs"), F.coalesce("children", F.lit(0)).alias("n_children"),
        F.greatest(F.coalesce("leaves", F.lit(0)), F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends", F.lit(EMPTY_HASH)).alias("ends_sha256"),
    )
    return nodes.unionByName(one).select(*[F.col(c).cast(t).alias(c) for c, t in (x.split() for x in NODE_SCHEMA.split(", "))])


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie(*rebuilt(number_turns(conversations)))


OP12_SQL = f"""
WITH ordered AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT c, c - c % 100 AS base, {crc32_sql("c::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT c FROM ordered)
), placed AS (
    SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, role, text FROM (
        SELECT v.c, 0 AS part, o.pos, o.role, o.text FROM convs v JOIN ordered o ON o.c = v.base AND o.pos <= v.h
        UNION ALL SELECT v.c, 1, o.pos, o.role, o.text FROM convs v JOIN ordered o ON o.c = v.c AND o.pos > v.h)
), paths AS (
    SELECT c, d, length(text) AS chars, sha256(string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d)) AS path FROM placed
    UNION ALL SELECT c, 0, 0, '' FROM convs
), nodes AS (
    SELECT path, d, min(c) AS conv, count(*) AS n, max(chars) AS chars FROM paths GROUP BY path, d
), finished AS (
    SELECT path, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM (SELECT * FROM paths QUALIFY row_number() OVER (PARTITION BY c ORDER BY d DESC) = 1)
    GROUP BY path
), linked AS (
    SELECT n.*, p.path AS above FROM nodes n LEFT JOIN paths p ON p.c = n.conv AND p.d = n.d - 1
), families AS (
    SELECT above AS path, count(*) AS children FROM linked WHERE above IS NOT NULL GROUP BY above
), sums AS (
    SELECT a.path, sum((n.n - 1) * n.chars) AS saved, count(*) FILTER (f.children IS NULL) AS leaves
    FROM nodes n LEFT JOIN families f USING (path) JOIN paths a ON a.c = n.conv AND a.d <= n.d GROUP BY a.path
)
SELECT l.conv AS conv_id, l.d AS depth, u.conv AS parent_conv_id, l.n AS n_convs, coalesce(f.children, 0) AS n_children, s.leaves AS n_leaves,
       s.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM linked l LEFT JOIN nodes u ON u.path = l.above LEFT JOIN families f ON f.path = l.path JOIN sums s ON s.path = l.path LEFT JOIN finished e ON e.path = l.path
"""
