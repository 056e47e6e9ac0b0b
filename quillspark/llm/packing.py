"""Packing of documents into fixed-length token sequences, certified by dual-feasible lower bounds.

Documents are encoded where they are read; from there on only piece lengths move. Pieces are dealt into groups of a
bounded number of tokens, each group is packed by best-fit decreasing and compared with a lower bound on its number of
sequences. Where the bound leaves room, the sequences of a group with gaps exchange pieces: those of the emptiest, and of
some drawn at random, are packed again, each sequence with the set of pieces that fits it best; this is kept if it takes
fewer, and repeated until the bound is met or ``FRUITLESS`` attempts in a row (more where pieces are few) save nothing. Full sequences are then settled, and the
pieces of those with gaps are dealt anew over fewer groups and packed again, as long as that saves sequences, at most
``ROUNDS`` times. Attempts and rounds limit how good a packing gets, never which pieces are placed.

A null text is an empty document (its terminator only). Ties in length go by piece number. Repeated rows are packed as
documents of their own. Null ids pass through. Very long documents are cut into full pieces, which take a sequence each. An
empty table gives an empty result; columns other than id and text are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, slabs, small_batches
from quillspark.llm.tokenization import encoder

#: Tokens and pieces that one group, and so one task, packs at a time.
GROUP_TOKENS, GROUP_PIECES = 1 << 25, 400_000
#: Most exchanges of gap documents between groups.
ROUNDS = 4
#: Attempts in a row without a saving before a group gives up, and pieces that one attempt packs again.
FRUITLESS, POOL = 12, 2_500
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(df: DataFrame, doc_id: str, text: str, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """One row per piece of each document's ids with the terminator ``end_id``."""
    small_batches(df.sparkSession)
    tail = np.array([end_id], "<u4")

    def cut_up(batches):
        import pyarrow as pa

        own = encoder(tokenizer)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out: list[tuple] = []
            for first, held in slabs(batch.column("body").to_numpy(zero_copy_only=False)):
                for k, body in enumerate(own.encode(held)):
                    row = np.concatenate((body, tail))
                    for p, start in enumerate(range(0, len(row), capacity)):
                        part = row[start : start + capacity]
                        out.append((ids[first + k], p, start, len(part), zlib.crc32(part.tobytes())))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names)

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body")).mapInArrow(cut_up, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that any packing of ``lengths`` needs, by two families of dual-feasible functions.

    The staircase functions round a length x to the steps at which k + 1 lengths no longer fit; the threshold functions
    count what exceeds capacity - t whole and drop what is below t.
    """
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    for k in range(1, 33):
        steps, exact = divmod((k + 1) * x, capacity)
        # in units of 1 / (k * capacity): x itself where it is a step, its step number otherwise
        value = np.where(exact == 0, k * x, steps * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    many, mass = np.cumsum(count), np.cumsum(count * x)
    t = np.arange(1, capacity // 2 + 1)
    whole = many[capacity] - many[capacity - t]
    middle = mass[capacity - t] - mass[t - 1]
    return max(best, int((whole + -(-middle // capacity)).max(initial=0)))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, and how full each sequence is."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # open sequences by room left
    rooms = 0  # bit r is set where some sequence has room r
    for k in order.tolist():
        size = int(lengths[k])
        above = rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            b = open_at[room].pop()
            if not open_at[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[k], offsets[k] = b, fill[b]
        fill[b] += size
        if room > size:
            open_at[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins, offsets, np.array(fill, np.int64)


def fullest(lengths: np.ndarray, capacity: int, order: np.ndarray) -> np.ndarray:
    """Sequence number of each piece: each sequence takes the next piece in ``order`` and the set of others that fills it best.

    Sums that a room allows are the bits of a number; pieces are added until one fills the room or all were tried, and the
    sets are read back from the numbers before each piece.
    """
    size, left, bins, b = lengths.tolist(), order.tolist(), np.zeros(len(lengths), np.int64), 0
    while left:
        room, sums, steps = capacity - size[left[0]], 1, []
        mask = (1 << (room + 1)) - 1
        for k in left[1:]:
            more = sums | (sums << size[k] & mask)
            if more != sums:
                steps.append((k, sums))
                sums = more
                if sums >> room:
                    break
        best, taken = sums.bit_length() - 1, {left[0]}
        for k, before in reversed(steps):
            if not before >> best & 1:
                taken.add(k)
                best -= size[k]
        bins[list(taken)] = b
        b += 1
        left = [k for k in left if k not in taken]
    return bins


def exchange(lengths: np.ndarray, bins: np.ndarray, capacity: int, bound: int, seed: int = 0) -> np.ndarray:
    """``bins`` or a packing with fewer sequences, where the bound leaves room."""
    rng, fruitless = np.random.default_rng(seed), 0
    most = FRUITLESS * max(1, POOL // max(len(lengths), 1))  # few pieces are packed again quickly
    while fruitless < most and len(lengths) and bins.max() + 1 > bound:
        fill, many = np.bincount(bins, lengths), np.bincount(bins)
        rank = fill + (rng.random(len(fill)) * capacity * fruitless / most)  # the emptiest first, later more at random
        chosen = np.argsort(rank, kind="stable")
        chosen = chosen[np.cumsum(many[chosen]) <= POOL]
        pool = np.flatnonzero(np.isin(bins, chosen))
        noise = 1 + 0.15 * rng.standard_normal(len(pool)) * (fruitless > 0)
        again = fullest(lengths[pool], capacity, np.argsort(-lengths[pool] * noise, kind="stable"))
        if len(pool) and again.max() + 1 < len(chosen):
            bins = bins.copy()
            bins[pool] = bins.max() + 1 + again
            bins = np.unique(bins, return_inverse=True)[1]
            fruitless = 0
        else:
            fruitless += 1
    return bins


def placed(lengths: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offset of each piece in its sequence, how full each sequence is)."""
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[order])
    fill = np.bincount(bins, lengths).astype(np.int64)
    offsets = np.empty(len(lengths), np.int64)
    offsets[order] = ends - lengths[order] - (np.cumsum(fill) - fill)[bins[order]]
    return offsets, fill


def _pack_groups(items: DataFrame, groups: int, seed: int, capacity: int) -> DataFrame:
    """Each group packed; ``filled`` is the fill of the piece's sequence."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("item", ignore_index=True)
        lengths = group["length"].to_numpy()
        bins, _, fill = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        if len(fill) > bound:
            bins = exchange(lengths, bins, capacity, bound, seed)
        offsets, fill = placed(lengths, bins)
        number = (seed << 56) + (int(group["grp"].iloc[0]) << 28) + bins
        return group.assign(sequence_id=number, offset=offsets, filled=fill[bins], group_bins=len(fill), group_bound=bound)

    schema = f"item long, {PIECES}, grp long, sequence_id long, offset long, filled long, group_bins long, group_bound long"
    dealt = items.withColumn("grp", F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(pack, schema)


def pack_pieces(items: DataFrame, capacity: int, rounds: int = ROUNDS, group_tokens: int = GROUP_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Place pieces (columns of ``PIECES``) into sequences; adds sequence_id, offset, certified.

    ``certified``: the group that placed the piece used no more sequences than its lower bound.
    """
    rest = cut(items).withColumn("item", F.monotonically_increasing_id())
    settled, current, before = [], None, None
    for seed in range(rounds + 1):
        size = rest.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"), F.count("*").alias("n")).first()
        groups = max(1, -(-size.tokens // group_tokens), -(-size.n // group_pieces))
        packed = cut(_pack_groups(rest, groups, seed, capacity))
        gaps = packed.where(F.col("filled") < capacity)
        total = packed.agg(F.count_distinct("sequence_id").alias("bins")).first().bins
        if before is not None and total >= before:
            break  # the exchange saved nothing: keep the placement before it
        if current is not None:
            settled.append(current.where(F.col("filled") == capacity))
        current = packed
        open_now = gaps.agg(F.count_distinct("sequence_id").alias("bins"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
        if groups == 1 or open_now.bins <= -(-open_now.tokens // capacity):
            break  # one group has seen all gaps, or the gaps already meet their bound
        before = open_now.bins
        rest = gaps.select("item", *[c.split()[0] for c in PIECES.split(", ")])
    out = current
    for part in settled:
        out = out.unionByName(part)
    return out.withColumn("certified", F.col("group_bins") == F.col("group_bound")).drop("item", "grp", "filled", "group_bins", "group_bound")


def pack_documents(df: DataFrame, doc_id: str, text: str, tokenizer: str, capacity: int = 2048, **options) -> DataFrame:
    """Encode, cut and pack the documents of ``df``; one row per piece."""
    return pack_pieces(pieces(df, doc_id, text, tokenizer, capacity), capacity, **options)
