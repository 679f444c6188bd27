"""SimHash near-duplicates by a binary trie self-join.

Distinct fingerprints are the leaves of a binary trie.  The self-join walks pairs of nodes
together from the root, adds up the bits in which they differ, and drops a pair as soon as it
exceeds the error budget of its depth.

To make the walk local, the bits are cut into ``errors + 1`` blocks and the trie is taken once
per rotation of the blocks.  Of two fingerprints within the budget, some rotation has at most
``floor(l * errors / blocks)`` differing bits in its first l blocks for every l (were every
start to exceed it somewhere, going round the circle would exceed the total).  So each rotation
has a budget that rises from 0 block by block, the first block must agree, and the subtries
below it are the partitions of the work.  A subtrie with very many leaves is split by the next
block, which may differ in one bit: a leaf is at home in one part and a guest in one per bit.

Inside a part links are reduced to a spanning forest as they are found, so a cluster of n
leaves gives n - 1 links and not all pairs; node pairs inside one tree are not walked again.
Components are joined up by star contraction (`components`).

Cases: a null text counts as empty; a text without words has fingerprint zero and is linked
like any other; null ids never name a component unless all ids of the component are null;
repeated rows and ids fall into one component with their like; an empty table gives no rows;
columns other than the named ones are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.common import staged, string_or_empty, table, unused
from logloom.llm.components import connected_components

ERRORS = 4
SHINGLE_WORDS = 4
SEED = 42
# Subtries with more leaves than this are split by the next block.
PART_LEAVES = 20_000
# Leaves gathered before a walk, and node pairs walked at once: they bound a worker's memory.
WALK_LEAVES = 100_000
WALK_PAIRS = 200_000
DIRECT_PAIRS = 16


def fingerprint(text: str, size: int = SHINGLE_WORDS) -> int:
    """64 bits: bit j is set if it is set in over half of the shingle hashes."""
    from xxhash import xxh64_intdigest as digest

    words = text.encode("utf-8").lower().split()  # ASCII letters and ASCII blanks alone
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    values = np.fromiter((fingerprint(t or "") for t in texts), np.uint64, len(texts))
    return pd.Series(values.view(np.int64))


def simhash(text: Column) -> Column:
    """The fingerprint as a bigint of the same 64 bits."""
    return _fingerprints(F.coalesce(text.cast("string"), F.lit("")))


def fingerprint_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def block_sizes(errors: int) -> list[int]:
    n = errors + 1
    return [64 // n + (i < 64 % n) for i in range(n)]


def budgets(errors: int, rotation: int) -> np.ndarray:
    """Differing bits allowed in the first d bits of a rotation, for d = 0 ... 64."""
    sizes = block_sizes(errors)
    turned = sizes[rotation:] + sizes[:rotation]
    allowed = [0]
    for i, size in enumerate(turned, 1):
        allowed += [i * errors // len(sizes)] * size
    return np.array(allowed)


class Forest:
    """Union-find over positions, with a label array that is refreshed between steps of a walk."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.labels = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def _root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        fresh = self.labels[a] != self.labels[b]
        changed = False
        for x, y in zip(a[fresh].tolist(), b[fresh].tolist()):
            rx, ry = self._root(x), self._root(y)
            if rx != ry:
                self.parent[max(rx, ry)] = min(rx, ry)
                self.links.append((x, y))
                changed = True
        if changed:
            labels = np.array(self.parent)
            while (up := labels[labels] != labels).any():
                labels = np.where(up, labels[labels], labels)
            self.labels = labels


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _pairs(alo, ahi, blo, bhi) -> tuple[np.ndarray, np.ndarray]:
    """All positions (a, b) of the range pairs given."""
    na, nb = ahi - alo, bhi - blo
    total = na * nb
    of = np.repeat(np.arange(len(total)), total)
    k = np.arange(len(of)) - np.repeat(np.cumsum(total) - total, total)
    return alo[of] + k // nb[of], blo[of] + k % nb[of]


def walk(values: np.ndarray, roots: np.ndarray, depth: int, allowed: np.ndarray, errors: int, forest: Forest) -> None:
    """Links all positions of the sorted `values` within `errors` bits, as far as `allowed` lets a pair pass.

    `roots`: rows (alo, ahi, blo, bhi) of node pairs to begin with, as ranges of positions whose
    first `depth` bits differ in nothing that was not counted yet; a row with both ranges equal
    is a self-join.
    """
    stack = [(depth, *roots.T, np.zeros(len(roots), np.int64))]
    while stack:
        depth, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > WALK_PAIRS:
            half = len(alo) // 2
            stack.append((depth, *(x[:half] for x in (alo, ahi, blo, bhi, err))))
            stack.append((depth, *(x[half:] for x in (alo, ahi, blo, bhi, err))))
            continue
        # pairs whose leaves are all in one tree already have nothing to add
        labels = forest.labels
        turns = np.append(np.flatnonzero(np.diff(labels)) + 1, len(labels))
        until = turns[np.searchsorted(turns, np.arange(len(labels)), side="right")]
        done = (until[alo] >= ahi) & (until[blo] >= bhi) & (labels[alo] == labels[blo])
        small = (ahi - alo) * (bhi - blo) <= DIRECT_PAIRS
        direct = small | (depth >= 64)
        now = direct & ~done
        if now.any():
            a, b = _pairs(alo[now], ahi[now], blo[now], bhi[now])
            near = (a != b) & (_popcount(values[a] ^ values[b]) <= errors)
            forest.link(a[near], b[near])
        go = ~direct & ~done
        if not go.any():
            continue
        alo, ahi, blo, bhi, err = (x[go] for x in (alo, ahi, blo, bhi, err))
        bit = np.uint64(1 << (63 - depth))
        above = np.uint64(((1 << 64) - 1) ^ ((1 << (64 - depth)) - 1))
        cut = lambda lo, hi: np.clip(np.searchsorted(values, (values[lo] & above) | bit), lo, hi)
        amid, bmid = cut(alo, ahi), cut(blo, bhi)
        alike = (alo == blo) & (ahi == bhi)
        children = [
            (alo, amid, blo, bmid, err, None), (amid, ahi, bmid, bhi, err, None),
            (alo, amid, bmid, bhi, err + 1, None), (amid, ahi, blo, bmid, err + 1, ~alike),
        ]
        merged = []
        for a0, a1, b0, b1, e, extra in children:
            keep = (a1 > a0) & (b1 > b0) & (e <= allowed[depth + 1])
            keep = keep if extra is None else keep & extra
            merged.append([x[keep] for x in (a0, a1, b0, b1, e)])
        parts = [np.concatenate(c) for c in zip(*merged)]
        if len(parts[0]):
            stack.append((depth + 1, *parts))


def _join_parts(frame: pd.DataFrame, errors: int) -> pd.DataFrame:
    """Spanning links (a, b) of the leaves in `frame`, which holds whole parts of one rotation.

    Columns: rotation, part, guest, turned (rotated bits), leaf (id of the leaf).
    """
    rotation = int(frame["rotation"].iloc[0])
    values = frame["turned"].to_numpy().view(np.uint64)
    order = np.lexsort((values, frame["guest"].to_numpy(), frame["part"].to_numpy()))
    values, leaf = values[order], frame["leaf"].to_numpy()[order]
    part, guest = frame["part"].to_numpy()[order], frame["guest"].to_numpy()[order]
    edges = np.flatnonzero(np.append(True, (np.diff(part) != 0) | (np.diff(guest.astype(np.int8)) != 0)))
    ends = np.append(edges[1:], len(values))
    # a run of homes joins itself and the run of guests of the same part, if one follows
    selfs = [(lo, hi, lo, hi) for lo, hi in zip(edges, ends) if not guest[lo]]
    crosses = [
        (lo, hi, hi, ends[i + 1]) for i, (lo, hi) in enumerate(zip(edges, ends))
        if not guest[lo] and i + 1 < len(edges) and guest[hi] and part[hi] == part[lo]
    ]
    allowed = budgets(errors, rotation)
    first = int(np.flatnonzero(allowed > 0)[0]) - 1 if errors else 64
    forest = Forest(len(values))
    # searchsorted needs one ascending array: each run is walked by itself below its first block
    for lo, hi in _ascending(values):
        roots = [r for r in selfs if lo <= r[0] and r[1] <= hi]
        if roots:
            _walk_slice(values, lo, hi, np.array(roots), first, allowed, errors, forest)
    for root in crosses:
        _walk_cross(values, root, first, allowed, errors, forest)
    links = np.array(forest.links, dtype=np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": leaf[links[:, 0]], "b": leaf[links[:, 1]]})


def _ascending(values: np.ndarray) -> list[tuple[int, int]]:
    """Maximal ascending stretches."""
    cuts = np.flatnonzero(values[1:] < values[:-1]) + 1
    return list(zip(np.append(0, cuts), np.append(cuts, len(values))))


class _View:
    """A forest seen through the positions of a selection."""

    def __init__(self, forest: Forest, at: np.ndarray):
        self.forest, self.at = forest, at

    @property
    def labels(self) -> np.ndarray:
        return self.forest.labels[self.at]

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        self.forest.link(self.at[a], self.at[b])


def _walk_slice(values, lo, hi, roots, depth, allowed, errors, forest) -> None:
    walk(values[lo:hi], roots - lo, depth, allowed, errors, _View(forest, np.arange(lo, hi)))


def _walk_cross(values, root, depth, allowed, errors, forest) -> None:
    """Homes against guests: sorted into one array, in which the homes, having one prefix, are a range."""
    alo, ahi, blo, bhi = root
    at = np.concatenate([np.arange(alo, ahi), np.arange(blo, bhi)])
    at = at[np.argsort(values[at], kind="stable")]
    low = int(np.argmax(at < ahi))
    high = low + ahi - alo
    roots = [r for r in ((0, low, low, high), (low, high, high, len(at))) if r[1] > r[0] and r[3] > r[2]]
    if roots:
        walk(values[at], np.array(roots), depth, allowed, errors, _View(forest, at))


def trie_links(leaves: DataFrame, errors: int = ERRORS, part_leaves: int = PART_LEAVES) -> DataFrame:
    """Links (a, b) between leaves (fingerprint, leaf) that join all pairs within `errors` bits into trees.

    Fingerprints must be distinct.
    """
    sizes = block_sizes(errors)
    offsets = np.cumsum([0, *sizes])[:-1].tolist()
    bits = F.col("fingerprint")
    turns = [
        F.struct(
            F.lit(i).alias("rotation"),
            (bits if not at else F.shiftleft(bits, at).bitwiseOR(F.shiftrightunsigned(bits, 64 - at))).alias("turned"),
            F.lit(sizes[i]).alias("first"), F.lit(sizes[(i + 1) % len(sizes)]).alias("second"),
        )
        for i, at in enumerate(offsets)
    ]
    turned = leaves.select("leaf", F.inline(F.array(*turns)))
    shift = lambda x, n: F.call_function("shiftrightunsigned", x, n)
    turned = turned.withColumn("part", shift(F.col("turned"), (F.lit(64) - F.col("first"))))
    heavy = turned.groupBy("rotation", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part_leaves)
    heavy = heavy.select(F.col("rotation").alias("heavy_rotation"), F.col("part").alias("heavy_part"))
    marked = turned.join(
        heavy, (F.col("rotation") == F.col("heavy_rotation")) & (F.col("part") == F.col("heavy_part")), "left"
    )
    # the finer part of a leaf, and those that differ from it in one bit of the second block
    finer = shift(F.col("turned"), (F.lit(64) - F.col("first") - F.col("second")))
    one = F.lit(1).cast("long")
    guests = F.transform(
        F.sequence(F.lit(0), F.col("second") - 1),
        lambda j: F.struct(
            finer.bitwiseXOR(F.call_function("shiftleft", one, j)).alias("part"), F.lit(True).alias("guest")
        ),
    )
    split = F.concat(F.array(F.struct(finer.alias("part"), F.lit(False).alias("guest"))), guests)
    plain = F.array(F.struct(F.col("part"), F.lit(False).alias("guest")))
    placed = marked.select(
        "rotation", "turned", "leaf", F.col("heavy_part").isNotNull().alias("fine"),
        F.explode(F.when(F.col("heavy_part").isNotNull(), split).otherwise(plain)).alias("p"),
    ).select(
        "rotation", "turned", "leaf",
        # finer parts get numbers of their own
        F.when(F.col("fine"), -1 - F.col("p.part")).otherwise(F.col("p.part")).alias("part"), F.col("p.guest").alias("guest"),
    )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        rows = 0

        def finish(frame: pd.DataFrame) -> Iterator[pa.RecordBatch]:
            for _, same in frame.groupby("rotation", sort=False):
                yield pa.RecordBatch.from_pandas(_join_parts(same, errors), preserve_index=False)

        for batch in batches:
            held.append(batch.to_pandas())
            rows += len(held[-1])
            if rows >= WALK_LEAVES:
                frame = pd.concat(held, ignore_index=True)
                # the last part may go on in the next batch
                last = frame.iloc[-1]
                open_ = ((frame["rotation"] == last["rotation"]) & (frame["part"] == last["part"])).to_numpy()
                if not open_.all():
                    yield from finish(frame[~open_])
                held = [frame[open_]]
                rows = len(held[0]) if not open_.all() else 0
        if held and sum(map(len, held)):
            yield from finish(pd.concat(held, ignore_index=True))

    kind = leaves.schema["leaf"].dataType.simpleString()
    dealt = placed.repartition("rotation", "part").sortWithinPartitions("rotation", "part")
    return dealt.mapInArrow(joined, f"a {kind}, b {kind}")


def near_components(fingerprints: DataFrame, errors: int = ERRORS, part_leaves: int = PART_LEAVES) -> DataFrame:
    """From (doc_id, fingerprint): fingerprint, component_id (least doc_id reachable), one row per fingerprint."""
    leaves = staged(fingerprints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "leaves")
    links = trie_links(leaves.select("fingerprint", F.col("fingerprint").alias("leaf")), errors, part_leaves)
    found = connected_components(links)
    labelled = leaves.join(found, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "first_id", F.coalesce("component", "fingerprint").alias("component")
    )
    # Stored, so that a component with very many fingerprints can be split over tasks in the join.
    labelled = staged(labelled, "labelled")
    ids = staged(labelled.groupBy("component").agg(F.min("first_id").alias("component_id")), "components")
    return labelled.join(ids, "component").select("fingerprint", "component_id")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", errors: int = ERRORS, part_leaves: int = PART_LEAVES,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), simhash(F.col(text)).alias("fingerprint"))
    rows = staged(rows, "fingerprints")
    found = near_components(rows, errors, part_leaves).withColumnRenamed("fingerprint", "of")
    return rows.join(found, F.col("fingerprint") == F.col("of")).select(
        "doc_id", fingerprint_hex(F.col("fingerprint")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", errors: int = ERRORS) -> DataFrame:
    """`docs` with one row of each component, that with the least id; columns unchanged.

    Of rows equal in id and text one stays.
    """
    digest = F.xxhash64(string_or_empty(F.col(text)))
    rows = staged(
        docs.select(F.col(doc_id).alias("id"), digest.alias("digest"), simhash(F.col(text)).alias("fingerprint")), "fingerprints"
    )
    found = near_components(rows.select(F.col("id").cast("long").alias("doc_id"), "fingerprint"), errors).withColumnRenamed("fingerprint", "of")
    # nulls last: a row without an id stays only where no other row does
    order = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    keys = rows.join(found, F.col("fingerprint") == F.col("of")).withColumn("component", F.coalesce("component_id", "fingerprint"))
    keys = keys.groupBy(F.col("component_id").isNull().alias("bare"), "component").agg(F.min(order).alias("keep"))
    key, kept, mark = (unused(docs, c) for c in ("__id", "__kept", "__digest"))
    keys = keys.select(F.col("keep.id").alias(key), F.col("keep.digest").alias(kept))
    matched = docs.withColumn(mark, digest).join(keys, F.col(doc_id).eqNullSafe(F.col(key)) & (F.col(mark) == F.col(kept)), "left_semi")
    return matched.dropDuplicates([doc_id, mark]).select(*docs.columns)


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
