"""Near-duplicates by SimHash: a binary-trie self-join under a Hamming budget, and its components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, lookup, materialize, partitions, stored

BITS = 64
#: The 64 bits are cut into so many runs, or one more than the budget if that is more; fingerprints within
#: the budget agree on all runs but as many as the budget.
BLOCKS = 5


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the runs of `shingle` words, repeats included; of all words if there are fewer, none without one."""
    words = text.lower().split()
    if not words:
        return np.empty(0, ">u8")
    ends, at = [], 0
    for w in words:
        ends.append(at + len(w))
        at = ends[-1] + 1
    flat, n = b" ".join(words), max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] or [len(flat)]
    starts = [0, *[e + 1 for e in ends[: n - 1]]]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(flat[s:e], 42) for s, e in zip(starts, last)]), ">u8")


def majority(hashes: np.ndarray) -> bytes:
    """Eight bytes, the highest bit first: the bits set in over half of the hashes, zero without any. Works a piece at a time."""
    counts = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[a : a + 8192].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes)).tobytes()


def fingerprint(text: bytes, shingle: int) -> bytes:
    return majority(shingle_hashes(text, shingle))


def fingerprints(batches, shingle: int):
    for batch in batches:
        prints = b"".join(fingerprint(x.as_py() or b"", shingle) for x in batch.column(1).cast(pa.binary()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(prints, ">i8").astype(np.int64))], names=["id", "fp"])


def masks(bits: int) -> list[int]:
    """One mask for each choice of blocks that fingerprints within `bits` bits can agree on."""
    blocks = max(BLOCKS, bits + 1)
    edges = [i * BITS // blocks for i in range(blocks + 1)]
    block = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    return [sum(x) for x in combinations(block, blocks - bits)]


def trie_links(prints: np.ndarray, ids: np.ndarray, bits: int, cross: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest id of its class) for the classes that prints within `bits` bits form.

    prints are sorted and distinct, so a node of the binary trie is a run of them. Node pairs are
    traversed together, a level at a time; a pair carries its differing bits and goes when they exceed
    the budget, or when all leaves of both nodes are in one class already. The traversal runs depth
    first in blocks, so memory is bounded. Only links to a class's smallest member come out: a
    dense run of n prints gives at most n - 1, not all pairs. With `cross` (a side of each print), only
    pairs from different sides are compared.
    """
    n = len(prints)
    label = np.arange(n)
    ones = {}
    stack = [(BITS, np.array([[0, n, 0, n, 0]], np.int64))] if n > 1 else []
    while stack:
        level, pairs = stack.pop()
        if len(pairs) > 65_536:
            stack += [(level, pairs[i : i + 65_536]) for i in range(0, len(pairs), 65_536)]
            continue
        a0, a1, b0, b1, d = pairs.T
        ends = (a1 - a0 == 1) & (b1 - b0 == 1)
        x, y = a0[ends], b0[ends]
        near = (np.bitwise_count(prints[x] ^ prints[y]) <= bits) & (label[x] != label[y])
        if cross is not None:
            near &= cross[x] != cross[y]
        for i, j in zip(x[near].tolist(), y[near].tolist()):
            if (p := label[i]) != (q := label[j]):
                label[label == max(p, q)] = min(p, q)
        change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        one = (change[a1 - 1] == change[a0]) & (change[b1 - 1] == change[b0]) & (label[a0] == label[b0])
        pairs = pairs[~ends & ~one]
        if not len(pairs):
            continue
        a0, a1, b0, b1, d = pairs.T
        if level not in ones:
            ones[level] = np.concatenate([[0], np.cumsum((prints >> np.uint64(level - 1)) & np.uint64(1))]).astype(np.int64)
        am, bm = a1 - (ones[level][a1] - ones[level][a0]), b1 - (ones[level][b1] - ones[level][b0])
        same = (a0 == b0) & (a1 == b1)
        down = [(a0, am, bm, b1, d + 1, True), (am, a1, b0, bm, d + 1, ~same), (a0, am, b0, bm, d, True), (am, a1, bm, b1, d, True)]
        for c0, c1, e0, e1, more, ok in down:  # the nearest pairs are pushed last and run first
            go = (c1 > c0) & (e1 > e0) & (more <= bits) & ok & ~((c0 == e0) & (c1 - c0 == 1))
            if go.any():
                stack.append((level - 1, np.stack([c0, c1, e0, e1, more], 1)[go]))
    low = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(low, label, ids)
    low = low[label]
    return ids[low != ids], low[low != ids]


def bucket_links(batches, bits: int, sides: bool):
    """Sorted rows (group columns..., side, fp, rep) -> links. A group may span batches; it is bounded."""
    held: list[pa.Table] = []

    def links(table: pa.Table, starts: np.ndarray):
        fp, rep = table["fp"].to_numpy().astype(np.uint64), table["rep"].to_numpy()
        side = table["side"].to_numpy() if sides else None
        found = [(np.empty(0, np.int64),) * 2]
        for s, e in zip(starts, [*starts[1:], len(fp)]):
            if e - s > 1:
                order = np.argsort(fp[s:e])
                mixed = side[s:e][order] if sides and (side[s:e] != side[s]).any() else None
                if not sides or mixed is not None or side[s] == 2:
                    found.append(trie_links(fp[s:e][order], rep[s:e][order], bits, mixed))
        a, b = map(np.concatenate, zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def cuts(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), bool)
        new[:1] = True
        for c in table.column_names[: -3 if sides else -2]:
            v = table[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        table = pa.Table.from_batches([*[b for t in held for b in t.to_batches()], batch])
        starts = cuts(table)
        if len(starts) > 1:
            yield links(table.slice(0, starts[-1]), starts[:-1])
            table = table.slice(starts[-1])
        held = [table]
    if held and len(held[0]):
        yield links(held[0], cuts(held[0]))


def rest_prefix(mask: int, depth: int):
    """The first `depth` bits that mask leaves out, as a column of fp."""
    free = [b for b in reversed(range(BITS)) if not mask >> b & 1][:depth]
    out, runs = F.lit(0).cast("bigint"), []
    for b in free:  # runs of neighbouring bits move together
        if runs and runs[-1][0] == b + 1:
            runs[-1] = (b, runs[-1][1] + 1)
        else:
            runs.append((b, 1))
    for low, n in runs:
        part = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit(signed((1 << n) - 1)).cast("bigint"))
        out = F.shiftleft(out, n).bitwiseOR(part)
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(reps: DataFrame, bits: int, most: int = 2048, step: int = 8) -> DataFrame:
    """fp, rep (one row a fingerprint) -> a, b: enough links for the components.

    Fingerprints within `bits` bits agree on all blocks but `bits`, so each joins one bucket for
    each choice of the others (see masks), and buckets are the subtries where the traversal starts. A bucket with more
    than `most` fingerprints is traversed across tasks: its node pairs at the next `step` bits
    that exist on both sides and are within the budget become groups of their own, again and again until
    all are small.
    """
    choices = masks(bits)
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(choices)]))
    rows = reps.select("fp", "rep", each.alias("x")).select("x.t", "x.key", "fp", "rep")
    big = materialize(rows.groupBy("t", "key").count().where(F.col("count") > most).select("t", "key"))
    if big.isEmpty():
        return in_groups(rows, ["t", "key"], bits, False)
    joined = rows.join(big.withColumn("big", F.lit(True)), ["t", "key"], "left")
    found = in_groups(joined.where("big IS NULL").drop("big"), ["t", "key"], bits, False)
    group = ["t", "key", "p", "q"]
    # side: 2 in a pair of a node with itself, else which of both nodes the print is under
    hot = joined.where("big").select("t", "key", F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("q"), F.lit(2).alias("side"), "fp", "rep")
    for depth in range(step, BITS + step, step):
        own = F.lit(None).cast("bigint")
        for t, m in enumerate(choices):
            own = F.when(F.col("t") == t, rest_prefix(m, depth)).otherwise(own)
        hot = materialize(hot.withColumn("own", own))
        nodes = hot.groupBy(*group, "side", "own").count()
        left = nodes.where("side <> 1").select(*group, "side", F.col("own").alias("l"), F.col("count").alias("nl"))
        right = nodes.where("side <> 0").select(*group, F.col("own").alias("r"), F.col("count").alias("nr"))
        pairs = left.join(right, group).where((F.bit_count(F.col("l").bitwiseXOR(F.col("r"))) <= bits) & ((F.col("side") != 2) | (F.col("l") <= F.col("r"))))
        size = F.when(F.col("l") == F.col("r"), F.greatest("nl", "nr") if depth == step else F.col("nl") + F.col("nr")).otherwise(F.col("nl") + F.col("nr"))
        pairs = materialize(pairs.where((F.col("side") != 2) | (F.col("l") < F.col("r")) | (F.col("nl") > 1)).select(*group, F.col("side").alias("was"), "l", "r", size.alias("size")))
        a = pairs.select(*group, F.when((F.col("was") == 2), F.lit(None)).otherwise(0).cast("int").alias("only"), F.col("l").alias("own"), F.when((F.col("was") == 2) & (F.col("l") == F.col("r")), 2).otherwise(0).alias("to"), "l", "r", "size")
        b = pairs.where("NOT (was = 2 AND l = r)").select(*group, F.when((F.col("was") == 2), F.lit(None)).otherwise(1).cast("int").alias("only"), F.col("r").alias("own"), F.lit(1).alias("to"), "l", "r", "size")
        new = hot.join(a.unionByName(b), [*group, "own"]).where("only IS NULL OR only = side").select("t", "key", F.col("l").alias("p"), F.col("r").alias("q"), F.col("to").alias("side"), "fp", "rep", "size")
        new = materialize(new)
        done = (F.col("size") <= most) if depth < BITS else F.lit(True)
        found = found.unionByName(in_groups(new.where(done).drop("size"), group, bits, True))
        hot = new.where(~done).drop("size")
        if hot.isEmpty():
            break
    return found


def in_groups(rows: DataFrame, group: list[str], bits: int, sides: bool) -> DataFrame:
    names = [*group, *(["side"] if sides else []), "fp", "rep"]
    # a number of partitions of its own: work grows with pairs, not with the few bytes by which they would be coalesced
    dealt = rows.select(*names).repartition(partitions(rows.sparkSession), *group).sortWithinPartitions(*group)
    return dealt.mapInArrow(lambda it: bucket_links(it, bits, sides), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """a > b -> node, root: the smallest node of each component, for the nodes that aren't it.

    Large-star and small-star rounds (each node's greater, then lesser neighbours move to its smallest
    one) until nothing changes; their number grows with the logarithm of the nodes. Hubs are dealt out.
    """
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit(0xFFFFFFFF)))).first())
    edges = stored(edges.distinct())
    now = mark(edges)
    while now[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        near = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.sum((F.col("v") > F.col("u")).cast("bigint")).alias("w")).where("w > 0"))
        large = lookup(edges.select(F.col("b").alias("u"), F.col("a").alias("v")), near, ["u"], "w", now[0], F.xxhash64("v")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large)
        least = stored(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("w")))
        moved = lookup(large, least, ["a"], "w", large.count(), F.xxhash64("b")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = stored(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        was, now = now, mark(new)
        discard(edges, near, large, least)
        edges = new
        if was == now:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3, most: int = 2048) -> DataFrame:
    """id, fp (64 bits as a bigint), component: the smallest identifier that links lead to.

    A fingerprint sums the XXH64 (seed 42) of the shingles of the whole text, A-Z lower-cased; equal
    fingerprints are joined first, then different ones within `bits` bits. Fingerprints are the nodes
    that links join, so identifiers may be of any type that has an order.

    Null, empty and blank texts have fingerprint zero and are linked like others. Rows with a null
    identifier are linked too; a component of nothing else has a null component. Repeated rows are
    linked to each other. An empty table gives no row. Other columns of the input are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    prints = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda it: fingerprints(it, shingle), f"id {kind}, fp bigint")
    return print_components(materialize(prints), bits, most)


def print_components(prints: DataFrame, bits: int, most: int = 2048) -> DataFrame:
    """id, fp (materialised) -> with component: see simhash_components."""
    reps = materialize(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("w")))
    roots = stored(components(links(reps.select("fp", F.col("fp").alias("rep")), bits, most)))
    # few fingerprints have a link: only those meet their component's smallest identifier
    near = stored(roots.join(reps.select("fp", "least"), roots.node == reps.fp).select("node", "root", "least"))
    heads = reps.join(near.select(F.col("root").alias("fp")).distinct(), "fp").select(F.col("fp").alias("root"), "least")
    best = stored(near.select("root", "least").unionByName(heads).groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("w")))
    linked = lookup(near.select("node", "root"), best, ["root"], "w", near.count(), F.col("node")).select(F.col("node").alias("fp"), "component")
    linked = linked.unionByName(best.select(F.col("root").alias("fp"), "component"))
    named = reps.join(linked.withColumn("_linked", F.lit(True)), "fp", "left").select("fp", F.when(F.col("_linked"), F.col("component")).otherwise(F.col("least")).alias("component"), "w")
    named = materialize(named)
    return lookup(prints, named, ["fp"], "w", prints.count(), F.xxhash64("id"))


def row_links(prints: DataFrame, bits: int, most: int = 2048) -> DataFrame:
    """row (a bigint), fp -> a, b (a > b): enough links of rows for the components of fingerprints within `bits` bits."""
    reps = stored(prints.groupBy("fp").agg(F.min("row").alias("least"), F.count(F.lit(1)).alias("w")))
    equal = lookup(prints, reps, ["fp"], "w", prints.count(), F.xxhash64("row")).where("row <> least").select(F.col("row").alias("a"), F.col("least").alias("b"))
    found = stored(links(reps.select("fp", F.col("fp").alias("rep")), bits, most).distinct())
    of = lambda c: reps.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_row"))
    near = found.join(of("a"), "a").join(of("b"), "b").select(F.greatest("a_row", "b_row").alias("a"), F.least("a_row", "b_row").alias("b"))
    return equal.unionByName(near)


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, bits: int = 3, least: float = 0.8) -> DataFrame:
    """The rows of df of which each stands for a group of near-duplicates: those with the smallest identifier.

    Linked are rows whose fingerprints of shingles of `words` words are within `bits` bits, and rows whose
    sets of these shingles have a Jaccard similarity of `least` or more. Texts without a word are alike.

    Rows are linked by their own numbers, so one row of each group stays whatever the identifiers: rows
    that share one, or have none, but hold different texts all stay. Null identifiers come last.
    """
    from .minhash import jaccard_links, signed_rows  # it needs components() from here

    rows = stored(df.withColumn("_row", F.monotonically_increasing_id()))
    signed = signed_rows(rows, "_row", text_col, words)
    roots = components(row_links(signed.select("row", "fp"), bits).unionByName(jaccard_links(rows, signed, "_row", text_col, words, least)))
    rank = F.struct(F.col(id_col).isNull(), F.col(id_col), "_row").alias("_rank")
    ranked = rows.select("_row", rank).join(roots.select(F.col("node").alias("_row"), "root"), "_row", "left")
    heads = ranked.groupBy(F.coalesce("root", "_row").alias("_component")).agg(F.min("_rank").alias("_rank")).select("_rank._row")
    return rows.join(heads, "_row", "left_semi").drop("_row")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
