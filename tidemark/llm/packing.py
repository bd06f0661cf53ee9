"""Operator 3: best-fit packing into sequences of several permitted lengths."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, runs, staged
from .mixing import word_count
from .tokens import token_lengths

SIZES = (512, 1024, 2048, 4096)
PACKED = "doc_id bigint, piece int, start bigint, n_tokens bigint, bin_id bigint, bin_size int, offset int"


def sequence_cost(size: int) -> float:
    """What a sequence costs: linear work, and attention, which is as much at 16384 tokens."""
    return size * (1 + size / 16384)


def pack(lengths: np.ndarray, sizes: tuple[int, ...] = SIZES, cost: Callable[[int], float] = sequence_cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, size of the bin) for each of the lengths, which are in descending order and at most max(sizes).

    A piece goes into the open bin that it leaves the least room in. Where none has room, a bin is opened of the size
    that costs least for each token it can expect: the piece, and of the pieces to come those that fit beside it, as far
    as the room of the open bins doesn't hold them. At last each bin shrinks to the least size that holds its contents.
    """
    sizes = tuple(sorted(sizes))
    costs = [cost(s) for s in sizes]
    lengths = [int(x) for x in lengths]
    after = [0] * (len(lengths) + 1)  # tokens from each piece on
    for i in range(len(lengths) - 1, -1, -1):
        after[i] = after[i + 1] + lengths[i]
    ascending = lengths[::-1]
    bins, offsets, used, room_of = [], [], [], []
    open_bins: dict[int, list[int]] = {}
    rooms: list[int] = []  # distinct room of open bins, ascending
    room = 0
    for i, n in enumerate(lengths):
        at = bisect_left(rooms, n)
        if at < len(rooms):
            left = rooms[at]
            own = open_bins[left].pop()
            if not open_bins[left]:
                del open_bins[left], rooms[at]
            room -= left
            left -= n
        else:
            best = None
            for s, c in zip(sizes, costs, strict=True):
                if s >= n:
                    fit = len(lengths) - bisect_left(ascending, s - n + 1)  # the first piece that fits beside it
                    coming = max(0, after[max(fit, i + 1)] - room)
                    each = c / (n + min(s - n, coming))
                    if best is None or each < best[0]:
                        best = each, s
            own, left = len(used), best[1] - n
            used.append(0)
        bins.append(own)
        offsets.append(used[own])
        used[own] += n
        if left:
            if left not in open_bins:
                open_bins[left] = []
                insort(rooms, left)
            open_bins[left].append(own)
            room += left
    final = np.asarray(sizes)[np.searchsorted(sizes, used)] if used else np.zeros(0, int)
    bins = np.asarray(bins, np.int64)
    return bins, np.asarray(offsets, np.int64), final[bins] if len(bins) else bins


def _packing(sizes: tuple[int, ...], cost: Callable[[int], float]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in runs(batches, ["shard"]):
            bins, offsets, final = pack(shard.column("n_tokens").to_numpy(), sizes, cost)
            ids = bins + (int(shard.column("shard")[0].as_py()) << 32)
            out = [shard.column(c).combine_chunks() for c in ("doc_id", "piece", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(ids), pa.array(final, pa.int32()), pa.array(offsets, pa.int32())], [x.split()[0] for x in PACKED.split(", ")])

    return run


def packed(docs: DataFrame, length: Column | None = None, sizes: tuple[int, ...] = SIZES, cost: Callable[[int], float] = sequence_cost, shard_pieces: int = 20_000) -> DataFrame:
    """One row (doc_id, piece, start, n_tokens, bin_id, bin_size, offset) for each piece of each document.

    `length` is a document's number of tokens, by default its words. A document longer than the largest size is cut into
    pieces of that size and a rest, and none is left out. Pieces are dealt into shards of about shard_pieces by a hash,
    and each shard is packed for itself, so more documents make more shards and not larger ones; what packing for itself
    wastes is less than a few bins of a shard. The deal is written, so that a lost task packs the same shard again; other
    files or splits of the same rows may deal them otherwise.

    A null or empty text has no tokens and needs no bin. Rows that repeat a doc_id, or have none, are packed each for
    itself. An empty table gives no bins. Only doc_id and the columns of `length` are read.
    """
    spark, most = docs.sparkSession, max(sizes)
    n = F.coalesce(word_count(F.col("text")) if length is None else length, F.lit(0)).cast("bigint")
    # A row's written number spreads rows without doc_id, or that are equal, over shards like others.
    whole = docs.select("doc_id", n.alias("n"), F.monotonically_increasing_id().alias("row_id")).where("n > 0")
    starts = F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(most).cast("bigint"))).alias("piece", "start")
    pieces = staged(whole.select("doc_id", "row_id", "n", starts).select("doc_id", "row_id", "piece", "start", F.least(F.lit(most), F.col("n") - F.col("start")).cast("bigint").alias("n_tokens")), "pieces")
    shards = max(1, math.ceil(pieces.count() / shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "row_id", "piece"), F.lit(shards)).cast("int"))
    ordered = dealt.repartition(min(shards, partitions(spark)) if shards > 1 else 1, "shard").sortWithinPartitions("shard", F.desc("n_tokens"), "doc_id", "piece", "row_id")
    return ordered.mapInArrow(_packing(tuple(sizes), cost), PACKED)


def packed_tokens(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """packed() with the tokens of each row's whole text as its length, by the tokenizer's own count."""
    return packed(token_lengths(docs, tokenizer_path), F.col("n_tokens"), **options)
