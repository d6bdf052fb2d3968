"""Packing token pieces into sequences of a fixed size by a linear grouping scheme.

Pieces above a share of the capacity are sorted and cut into groups of equal cardinality; each is
rounded up to the largest of its group, so only a few sizes are left. A linear programme over the
configurations of those sizes is solved by column generation (a revised simplex whose pricing is a
knapsack over the capacity). The whole parts of its solution are opened as sequences with actual
pieces in place of the rounded ones: the longest of each group, and last the longest of all that
fits, so that what rounding up would waste is used. A configuration is opened as often as actual
pieces fill each place from its own group or a longer one. What remains - pieces of the fractional
part, of configurations no longer filled, and all small ones - goes best fit, longest first, into
the space left.

Pieces are dealt at random (by the row's place in the written table, so that no id or text is hot)
into shards of bounded size which are packed apart: memory is bounded, a lost executor costs a
shard. Then the sequences that are not full enough are taken up and packed once more, by shards of
shards.

Defined results: a null text is an empty one, whose only id is the closing one; a text of any length
is cut into pieces, all of them packed; pieces of equal length are told apart by document, piece,
start and digest; repeated documents are packed each; an empty table gives no rows; other columns of
the input are left out.
"""

from __future__ import annotations

import array
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PairIndex, byte_letters, vocabulary_path
from .common import in_small_batches, read, restored, whole_id, working, written

CAPACITY, CLOSE = 1024, 2
#: Pieces of up to this share of the capacity are small.
SMALL_SHARE = 1 / 5
GROUPS = 96
SHARD_ROWS = 32_768
#: Most steps of the programme, for each size.
STEPS = 1000
#: Sequences filled less than this are packed once more, with those of other shards.
FULL = 0.98


class _Encoder(PairIndex):
    """The ids of runs from the library's model, run by run: less memory than an index of pairs, and faster for few at once."""

    most_runs = 400_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        self.tokens, self.letters = Tokenizer.from_file(path).model.tokenize, dict(enumerate(byte_letters()))

    def merge(self, words: list[bytes]) -> list[bytes]:
        return [array.array("I", [t.id for t in self.tokens(w.decode("latin-1").translate(self.letters))]).tobytes() for w in words]


_ENCODERS: dict[str, _Encoder] = {}


def encoder(path: str) -> _Encoder:
    """One per worker process and file."""
    working("packing", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, close: int = CLOSE) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32; a long document's first piece may be the short one."""

    def run(batches):
        for batch in batches:
            doc_ids = iter(zip(batch.doc_id.tolist(), batch.unnamed.tolist(), strict=True))
            for found in encoder(path).slices(batch.text.tolist()):
                rows = []
                for ids in found:
                    ids += close.to_bytes(4, "little")
                    (doc_id, unnamed), n = next(doc_ids), len(ids) // 4
                    start, piece = 0, 0
                    while start < n:
                        size = (n - start) % capacity or capacity
                        rows.append((doc_id, unnamed, piece, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)])))
                        start, piece = start + size, piece + 1
                yield pd.DataFrame(rows, columns=["doc_id", "unnamed", "piece", "start", "length", "ids_crc32"])

    docs = in_small_batches(docs).select(*whole_id("doc_id"), "text")
    found = docs.mapInPandas(run, "doc_id long, unnamed boolean, piece int, start long, length long, ids_crc32 long")
    return found.withColumn("doc_id", restored()).drop("unnamed")


def configurations(sizes: np.ndarray, need: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Basic solution of: cover ``need`` of each size by as few configurations as can be."""
    k = len(sizes)
    need = need + 1e-7 * np.arange(1, k + 1) / k  # no two ratios tie, so the simplex can't cycle
    basis = np.diag(capacity // sizes).astype(float)  # a column is a configuration, or minus one of a size: a surplus
    cost = np.ones(k)
    for _ in range(STEPS * k):
        inverse = np.linalg.inv(basis)
        dual = cost @ inverse
        if dual.min() < -1e-9:
            enter, price = np.zeros(k), 0.0
            enter[int(dual.argmin())] = -1.0
        else:
            enter, price = _knapsack(sizes, dual, capacity), 1.0
            if dual @ enter <= 1 + 1e-6:
                break
        amount, direction = np.maximum(inverse @ need, 0), inverse @ enter
        step = np.full(k, np.inf)
        np.divide(amount, direction, out=step, where=direction > 1e-9)
        out = int(step.argmin())
        basis[:, out], cost[out] = enter, price
    # beyond that many steps the basis reached is taken: any basis is a plan, and what it leaves goes best fit
    amount = np.linalg.solve(basis, need)
    return [(basis[:, i].astype(int), float(amount[i])) for i in range(k) if cost[i]]


def _knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """The most worthy configuration: item by item, the best worth at each fill."""
    most = capacity // int(sizes.min())
    best, takes = [np.zeros(capacity + 1)], []
    reach = np.arange(capacity + 1) - sizes[:, None]  # the fill before an item of a size was put on
    for _ in range(most):
        value = np.where(reach >= 0, best[-1][np.maximum(reach, 0)] + worth[:, None], 0.0)
        takes.append(value.argmax(0))
        best.append(value.max(0))
    n = int(np.argmax([b[capacity] for b in best]))
    found, fill = np.zeros(len(sizes)), capacity
    for take in takes[:n][::-1]:
        g = int(take[fill])
        if sizes[g] > fill:
            break
        found[g] += 1
        fill -= int(sizes[g])
    return found


class _Shelf:
    """Pieces by length, and sequences; bit r of ``left`` is set where a piece of length r is left."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.pieces: list[list[int]] = [[] for _ in range(capacity + 1)]
        for i, size in enumerate(lengths.tolist()[::-1]):  # the first of a length is taken first
            self.pieces[size].append(len(lengths) - 1 - i)
        self.left = sum(1 << r for r, p in enumerate(self.pieces) if p)
        self.sequence, self.offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        self.fill: list[int] = []

    def longest(self, room: int, taken: list[int]) -> int:
        """The length of the longest piece left that fits, besides those taken; 0: none."""
        while (found := (self.left & ((1 << (room + 1)) - 1)).bit_length() - 1) > 0 and taken.count(found) >= len(self.pieces[found]):
            room = found - 1
        return max(found, 0)

    def put(self, size: int, to: int) -> None:
        i = self.pieces[size].pop()
        if not self.pieces[size]:
            self.left &= ~(1 << size)
        self.sequence[i], self.offset[i] = to, self.fill[to]
        self.fill[to] += size

    def open(self, sizes: list[int]) -> None:
        self.fill.append(0)
        for size in sizes:
            self.put(size, len(self.fill) - 1)


def pack(lengths: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each piece."""
    shelf = _Shelf(lengths, capacity)
    small = int(capacity * SMALL_SHARE)
    while shelf.pieces[capacity]:
        shelf.open([capacity])
    large = -np.sort(-lengths[(lengths < capacity) & (lengths > small)])
    if len(large):
        need: dict[int, int] = {}
        for part in np.array_split(large, min(groups, len(large))):
            need[int(part[0])] = need.get(int(part[0]), 0) + len(part)  # groups of one size are one
        sizes = sorted(need, reverse=True)
        longer_than = dict(zip(sizes, [*sizes[1:], small], strict=True))  # the members of a size's group are
        solved = configurations(np.array(sizes), np.array(list(need.values()), float), capacity)
        planned = [([s for s, c in zip(sizes, config.tolist(), strict=True) for _ in range(c)], int(amount + 1e-6)) for config, amount in solved]
        for places, times in sorted(planned, reverse=True):
            for _ in range(times):
                taken: list[int] = []
                for k, size in enumerate(places):
                    found = shelf.longest(capacity - sum(taken) if k == len(places) - 1 else size, taken)
                    if found <= longer_than[size]:
                        break
                    taken.append(found)
                if len(taken) < len(places):
                    break  # no longer filled
                shelf.open(taken)
    # best fit: bit r of ``open_`` is set where a sequence with r places left is on that stack
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for to, used in enumerate(shelf.fill):
        stacks[capacity - used].append(to)
    open_ = sum(1 << r for r in range(1, capacity + 1) if stacks[r])
    for size in range(capacity - 1, 0, -1):
        for _ in range(len(shelf.pieces[size])):
            fit = open_ >> size
            if fit:
                r = size + (fit & -fit).bit_length() - 1
                to = stacks[r].pop()
                if not stacks[r]:
                    open_ &= ~(1 << r)
            else:
                r, to = capacity, len(shelf.fill)
                shelf.fill.append(0)
            shelf.put(size, to)
            if r > size:
                stacks[r - size].append(to)
                open_ |= 1 << (r - size)
    return shelf.sequence, shelf.offset


_PACKED = "doc_id long, unnamed boolean, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, used long"


def _pack_shards(pieces: DataFrame, shards: int, first: int, capacity: int) -> DataFrame:
    """Packs each shard apart; its sequences are numbered from (first + shard) * 2^32."""

    def run(key, part):
        order = ["length", "unnamed", "doc_id", "piece", "start", "ids_crc32"]
        part = part.sort_values(order, ascending=[False, True, True, True, True, True], kind="stable").drop(columns="shard")
        sequence, offset = pack(part.length.to_numpy(), capacity)
        used = np.bincount(sequence, part.length.to_numpy()).astype(np.int64)
        part = part.assign(sequence_id=sequence + ((first + int(key[0])) << 32), offset=offset, used=used[sequence])
        return part[[c.split()[0] for c in _PACKED.split(", ")]]

    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(first)), F.lit(shards)).cast("int")
    return (
        pieces.select(*whole_id("doc_id"), *(c for c in pieces.columns if c != "doc_id")).withColumn("shard", shard)
        .groupBy("shard").applyInPandas(run, _PACKED).withColumn("doc_id", restored()).drop("unnamed")
    )


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """pieces(doc_id, piece, start, length, ids_crc32), a written table, with sequence_id and offset."""
    shards = max(1, -(-pieces.count() // shard_rows))
    once = written(_pack_shards(pieces, shards, 0, capacity), "packed")
    # what a shard couldn't fill is packed again with that of others
    loose = F.col("used") < capacity * FULL
    again = once.where(loose).drop("sequence_id", "offset", "used")
    few = max(1, -(-again.count() // (2 * shard_rows)))
    return once.where(~loose).unionByName(_pack_shards(again, few, shards, capacity)).drop("used")


def op2_best_fit_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = written(token_pieces(read(spark, sf_dir, "documents"), vocabulary_path()), "pieces")
    return pack_pieces(pieces)
