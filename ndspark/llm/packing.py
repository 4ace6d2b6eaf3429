"""Packing of tokenised documents into sequences: best fit, repacked until a lower bound certifies it."""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize

_loaded: dict[str, "Encoder"] = {}
#: How a byte-level BPE splits text before it merges. Fixed value of the format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, the others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class Encoder:
    """Token ids of a whole text, as tokenizers has them with add_special_tokens=False, as little-endian unsigned 32-bit bytes.

    A plain byte-level BPE whose ids are in the order of its merges is run by tiktoken over the same
    vocabulary, which gives the same ids in a quarter of the time; any other file by tokenizers itself.
    An added token in a text is that token's id, as tokenizers has it: the text is cut there first.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, first = spec["model"], spec.get("pre_tokenizer") or {}
        self.fast = None
        if model["type"] == "BPE" and not spec.get("normalizer") and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"):
            added = spec.get("added_tokens") or ()
            special = {t["content"]: t["id"] for t in added}
            byte, vocab = byte_of(), model["vocab"]
            pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            merged = [vocab[a + b] for a, b in pairs]
            if merged == sorted(merged) and not any(t[x] for t in added for x in ("lstrip", "rstrip", "single_word")):
                import tiktoken

                ranks = {bytes(byte[c] for c in w): i for w, i in vocab.items() if w not in special}
                self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        if self.fast is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(path)

    def __call__(self, text: str) -> bytes:
        ids = self.fast.encode(text, allowed_special="all") if self.fast else self.slow.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def pieces(batches, path: str, capacity: int):
    """(row, id, text) -> a row each piece. Ids, then id 0; longer ones are cut, the first piece may be shorter."""
    encode = encoder(path)
    for batch in batches:
        at, out = [], []
        for i, text in enumerate(batch.column(2)):
            ids = encode(text.as_py() or "") + bytes(4)
            n = len(ids) // 4
            first = n if n <= capacity else n % capacity or capacity
            for j, (a, b) in enumerate(zip([0, *range(first, n, capacity)], [*range(first, n, capacity), n])):
                at.append(i)
                out.append((j, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
        j, a, length, crc = zip(*out) if out else ((),) * 4
        at = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(j, pa.int32()), pa.array(a, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["row", "id", "piece", "start", "length", "crc"])


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing needs fewer sequences: the best of some dual-feasible functions.

    For each threshold t up to half the capacity: items over capacity - t count as whole, those below t
    as nothing, the others as they are; and the rounding u_k(x) = floor((k + 1) x / capacity) / k (x itself
    where that is whole) for small k.
    """
    counts = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    mass, above = np.cumsum(counts * size), np.cumsum(counts[::-1])[::-1]
    t = np.arange(capacity // 2 + 1)
    high = capacity - t
    middle = mass[high] - np.where(t > 0, mass[t - 1], 0)
    whole = np.where(high < capacity, above[np.minimum(high + 1, capacity)], 0)
    best = int((whole + -(-middle // capacity)).max())
    for k in range(1, 30):
        x = (k + 1) * size
        u = np.where(x % capacity == 0, size * k, (x // capacity) * capacity)  # in units of k x capacity
        best = max(best, int(-(-(counts * u).sum() // (k * capacity))))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, and the fill of each bin."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    room: dict[int, list[int]] = {}  # open bins by what is free
    free: list[int] = []  # the keys of room in order
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        k = bisect_left(free, n)
        if k < len(free):
            left = free[k]
            b = room[left].pop()
            if not room[left]:
                del room[left], free[k]
        else:
            left, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, capacity - left
        fill[b] += n
        if left := left - n:
            if left not in room:
                room[left] = []
                insort(free, left)
            room[left].append(b)
    return bins, offsets, np.array(fill, np.int64)


def pack_group(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pack one group; if its bins exceed the bound, offer the emptiest for exchange.

    Offered: the bins with least in them, so many that their free room is twice what one bin holds for
    each bin above the bound, but an eighth of the bins at most. A group that was repacked
    keeps its former bins if they were fewer.
    """
    pdf = pdf.sort_values(["length", "row", "piece"], ascending=[False, True, True], kind="stable")
    lengths = pdf["length"].to_numpy(np.int64)
    bins, offsets, fill = best_fit(lengths, capacity)
    sequence = (pdf["pool"].to_numpy(np.int64) << 24) + bins
    if (old := pdf["sequence"].to_numpy(np.int64)).min() >= 0 and len(np.unique(old)) <= len(fill):
        sequence, offsets = old, pdf["offset"].to_numpy(np.int64)
        _, bins = np.unique(old, return_inverse=True)
        fill = np.bincount(bins, lengths).astype(np.int64)
    gap = len(fill) - lower_bound(lengths, capacity)
    offered = np.zeros(len(fill), bool)
    if gap > 0:
        emptiest = np.argsort(fill, kind="stable")
        enough = int(np.searchsorted(np.cumsum(capacity - fill[emptiest]), 2 * capacity * gap)) + 1
        offered[emptiest[: min(enough, max(1, len(fill) // 8))]] = True
    return pdf.assign(sequence=sequence, offset=offsets, open=offered[bins])


def tokenised(df: DataFrame, id_col: str, text_col: str, capacity: int, path: str) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: pieces(it, path, capacity), f"row bigint, id {kind}, piece int, start bigint, length bigint, crc bigint")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, path: str | None = None, group: int = 4096, fan_in: int = 8) -> DataFrame:
    """Pieces of all rows with sequence and offset: row, id, piece, start, length, crc, sequence, offset.

    Whole-capacity pieces are sequences of their own. The others are dealt by hash into groups of about
    `group`; each is packed by best-fit decreasing, and a lower bound from dual-feasible functions
    certifies its count. Groups with a gap put their emptiest sequences into pools of `fan_in`
    groups, which are repacked, and so on until every pool is certified or one is left; what is
    certified or not offered stays. Pools shrink in number by `fan_in` a round and hold at most an
    eighth of the sequences of each of `fan_in` groups, so none outgrows a group.

    Null text counts as empty (one piece: id 0). Null identifiers and repeated rows are documents
    of their own. An empty table gives no row. Other columns of the input are not read. `row`
    numbers the input rows.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    every = materialize(tokenised(df, id_col, text_col, capacity, path))
    full = F.col("length") == capacity
    slim = every.where(~full).select("row", "piece", "length", F.lit(-1).cast("bigint").alias("sequence"), F.lit(0).cast("bigint").alias("offset"))
    groups = max(1, -(-slim.count() // group))
    schema = "row bigint, piece int, length bigint, sequence bigint, offset bigint, pool bigint, open boolean"
    key, done, turn = F.pmod(F.xxhash64("row", "piece"), F.lit(groups)), None, 0
    while True:
        packed = slim.withColumn("pool", (key + F.lit(turn << 30).cast("bigint")).cast("bigint")).groupBy("pool").applyInPandas(lambda pdf: pack_group(pdf, capacity), schema)
        packed = materialize(packed)
        still = F.lit(False) if groups == 1 else F.col("open")
        settled = packed.where(~still).select("row", "piece", "sequence", "offset")
        done = settled if done is None else done.unionByName(settled)
        slim = packed.where(still).select("row", "piece", "length", "sequence", "offset", "pool")
        if groups == 1 or slim.isEmpty():
            break
        groups, turn = -(-groups // fan_in), turn + 1
        key = F.floor(F.pmod(F.col("pool"), F.lit(1 << 30)) / fan_in).cast("bigint")
    alone = every.where(full).withColumn("sequence", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint"))
    return every.where(~full).join(done, ["row", "piece"]).select(*every.columns, "sequence", "offset").unionByName(alone)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pack(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), "offset")
