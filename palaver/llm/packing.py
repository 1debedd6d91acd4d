"""Best-fit packing of token pieces, improved by swaps between underfull bins.

Documents become token ids; one longer than a sequence is cut into full pieces, only its
first piece may be shorter. Full pieces are sequences of their own. The other pieces are
dealt evenly to blocks; a block is packed by best fit (longest first), then a local
search moves, exchanges one for one or two for one between its underfull bins, taking
only steps that raise the sum of squared fills, until no such step is left; bins that
become empty go. The pieces of still underfull bins of all blocks meet once more in
fewer blocks; there the better of the bins they came in, searched again, and a fresh
packing counts.

Defined cases: a null or empty text is the closing token alone; repeated rows are
separate documents; an empty table gives no rows; other columns are not looked at.
"""
from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from palaver.session import materialize

from .common import slices_for

SPECIAL = "<|endoftext|>"
_LOADED: dict[str, "Ids"] = {}


class Ids:
    """Token ids of a text as little-endian bytes.

    The same vocabulary comes as ranks, with which encoding is several times as fast;
    a text that holds the special token goes through the tokenizer that knows it.
    """

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.special = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        ids = self.special.encode(text, add_special_tokens=False).ids if SPECIAL in text else self.plain.encode_ordinary(text)
        return array("I", ids).tobytes()


def ids_of(name: str) -> Ids:
    if name not in _LOADED:
        _LOADED[name] = Ids(name)
    return _LOADED[name]


def pieces(docs: DataFrame, capacity: int, closing: int, tokenizer: str) -> DataFrame:
    """doc_id (text), piece, start, length, ids_crc32 of all documents' pieces."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = ids_of(tokenizer), np.array([closing], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                data = encode(text or "") + end
                n = len(data) // 4
                first = n % capacity or capacity
                edges = [0, *range(first, n + 1, capacity)]
                rows += [(doc_id, i, a, b - a, zlib.crc32(data[4 * a: 4 * b])) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(
        cut, "doc_id string, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers, longest item first, each into the fullest bin that has room."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free space
    free = np.zeros(capacity + 1, bool)
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = size + int(free[size:].argmax())
        if free[at]:
            b = room[at].pop()
            free[at] = bool(room[at])
        else:
            at, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        room[at - size].append(b)
        free[at - size] = True
    return bins


def _offers(items: list[int], lengths: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """One item or pair of a bin's items for each size there is: all that one or two items can give, at most as many as the capacity."""
    same: dict[int, list[int]] = {}
    for i in items:
        same.setdefault(int(lengths[i]), []).append(i)
    found = {size: (held[0],) for size, held in same.items()}
    sizes = list(same)
    for n, x in enumerate(sizes):
        if len(same[x]) > 1:
            found.setdefault(2 * x, tuple(same[x][:2]))
        for y in sizes[:n]:
            found.setdefault(x + y, (same[x][0], same[y][0]))
    return [(out, size) for size, out in found.items()]


class LocalSearch:
    """Moves and swaps between underfull bins. Every step raises the sum of squared fills, so the search ends."""

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int):
        self.bins, self.lengths, self.capacity = [list(b) for b in bins], lengths, capacity
        self.fill = np.array([int(lengths[b].sum()) for b in bins])
        self._list()

    def _list(self) -> None:
        """What other bins can give back: nothing, one item or two."""
        back = [(b, (), 0) for b in range(len(self.bins))]
        for b, items in enumerate(self.bins):
            back += [(b, *x) for x in _offers(items, self.lengths)]
        self.back, self.new = back, []
        self.owner, self.size = np.array([x[0] for x in back]), np.array([x[2] for x in back])
        self.valid = np.ones(len(back), bool)

    def _relist(self, b: int) -> None:
        """Bin ``b`` has changed: its old offers end, its new ones are added."""
        self.valid[self.owner == b] = False
        items = self.bins[b]
        new = [(b, (), 0)] * bool(items) + [(b, *x) for x in _offers(items, self.lengths)]
        if new:
            self.back += new
            self.owner = np.append(self.owner, [x[0] for x in new])
            self.size = np.append(self.size, [x[2] for x in new])
            self.valid = np.append(self.valid, np.ones(len(new), bool))
        if len(self.back) > 4 * int(self.valid.sum()) + 1000:
            self._list()

    def step(self, low: int) -> bool:
        """The step that takes most out of bin ``low`` in squared fill; whether there was one."""
        mine, best, best_rise = self.bins[low], None, 0
        gives = _offers(mine, self.lengths)
        fill = self.fill[self.owner]
        open_to = self.valid & (self.owner != low) & (fill >= self.fill[low]) & (fill < self.capacity)
        at = np.flatnonzero(open_to)
        fill, size = fill[at], self.size[at]
        for out, given in gives:
            gain = given - size
            rise = np.where((gain > 0) & (gain <= self.capacity - fill), 2 * gain * (gain + fill - self.fill[low]), 0)
            if len(rise) and int(rise.max()) > best_rise:
                n = int(rise.argmax())
                best, best_rise = (out, at[n], int(gain[n])), int(rise[n])
        if best is None:
            return False
        out, n, gain = best
        high, back = int(self.owner[n]), self.back[n][1]
        self.bins[low] = [i for i in mine if i not in out] + list(back)
        self.bins[high] = [i for i in self.bins[high] if i not in back] + list(out)
        self.fill[low] -= gain
        self.fill[high] += gain
        self._relist(low)
        self._relist(high)
        return True

    def run(self) -> list[list[int]]:
        """Empties bins, emptiest first, until no step is left or the free space is below one bin."""
        moved = True
        while moved:
            moved = False
            for low in np.argsort(self.fill, kind="stable").tolist():
                used = self.fill > 0
                if int((self.capacity - self.fill[used]).sum()) < self.capacity:
                    return [b for b in self.bins if b]  # no packing can do with fewer
                while self.bins[low] and self.fill[low] < self.capacity and self.step(low):
                    moved = True
        return [b for b in self.bins if b]


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins after the local search; full ones stay as they are."""
    fills = [int(lengths[b].sum()) for b in bins]
    under = [b for b, f in zip(bins, fills) if f < capacity]
    return [b for b, f in zip(bins, fills) if f == capacity] + (LocalSearch(under, lengths, capacity).run() if len(under) > 1 else under)


def _pack(batches: Iterator[pd.DataFrame], capacity: int) -> Iterator[pd.DataFrame]:
    """Pieces of one block with bin, offset and the bin's fill; bins that come with the pieces stay if packing anew takes more."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    rows = pd.concat(held, ignore_index=True)
    lengths = rows["length"].to_numpy(np.int64)
    bins = improve(best_fit(lengths, capacity), lengths, capacity)
    if rows["sequence_id"].notna().all():
        given = improve([list(x) for x in rows.groupby("sequence_id").indices.values()], lengths, capacity)
        bins = given if len(given) < len(bins) else bins
    order = np.fromiter((i for b in bins for i in b), np.int64, len(rows))
    sizes = np.array([len(b) for b in bins])
    number = np.repeat(np.arange(len(bins)), sizes)
    ends = np.cumsum(lengths[order])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    base = np.repeat((ends - lengths[order])[first], sizes)
    fill = np.repeat(np.add.reduceat(lengths[order], first), sizes)
    yield rows.iloc[order].drop(columns="sequence_id").assign(bin=number, offset=ends - lengths[order] - base, fill=fill)


def pack(docs: DataFrame, capacity: int = 1024, closing: int = 2, tokenizer: str = "byte_bpe_50k", block_rows: int = 20_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece. ``block_rows``: pieces packed in one task."""
    kind = docs.schema["doc_id"].dataType
    cut = materialize(pieces(docs, capacity, closing, tokenizer), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = "doc_id string, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"

    def round_of(rows: DataFrame, number: int) -> DataFrame:
        blocks = slices_for(rows.count(), block_rows)
        dealt = rows.repartition(blocks, "sequence_id") if number > 1 else rows.repartition(blocks)
        packed = dealt.mapInPandas(lambda it: _pack(it, capacity), schema)
        packed = packed.withColumn("sequence_id", (F.spark_partition_id().cast("long") * (1 << 32) + F.col("bin")) * 4 + number)
        return materialize(packed, "packed")

    full = cut.where(F.col("length") == capacity).select(*columns, (F.monotonically_increasing_id() * 4).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    one = round_of(cut.where(F.col("length") < capacity).withColumn("sequence_id", F.lit(None).cast("long")), 1)
    two = round_of(one.where(F.col("fill") < capacity).select(*columns, "sequence_id"), 2)
    result = full.unionByName(one.where(F.col("fill") == capacity).select(full.columns)).unionByName(two.select(full.columns))
    return result.withColumn("doc_id", F.col("doc_id").cast(kind))
