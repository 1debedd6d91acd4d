"""Near-duplicate groups by SuperMinHash signatures, banding, full verification and union-find.

A text's set holds its distinct shingles of five words. SuperMinHash gives every shingle
a random permutation of the signature's places and lets it compete there with its rank
plus a random fraction; a text stops as soon as all places hold smaller values than any
further rank could give. Equal bands make candidates. Candidates are gathered in
clusters (components of the candidate links, built from one link per text and band);
inside a cluster an inverted index of shingles counts all intersections, so no list of
pairs is made and no link is lost. A cluster too large for one task is cut into tiles
and every pair of tiles meets in one task.

Defined cases: null and empty texts have an empty set and link with nothing; a text of
fewer words than a shingle is one shingle of all its words; exact copies share one
representative; a null id never is a group's smallest id unless all are null; repeated
rows with the smallest id are all kept by ``groups`` and reduced to one by
``keep_one``; other columns are not looked at.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from palaver.session import materialize

from .common import mix64, whole
from .graph import UnionFind, components

#: Shingles that compete at once.
SLICE = 40_000
GOLD = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    """64-bit hashes of words, remembered up to a limit."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.LIMIT:
            self[word] = h
        return h


_HASH = WordHash()


def low_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only


def text_key(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def shingles(text: str | None, size: int = 5) -> tuple[bytes | None, np.ndarray]:
    """Key of the lower-cased word sequence (None without words) and the sorted distinct shingle hashes."""
    words = low_words(text)
    if not words:
        return None, np.empty(0, np.uint64)
    key = text_key(words)
    h = np.fromiter(map(_HASH.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    out = np.full(n, len(words) if len(words) < size else size, np.uint64)
    for i in range(min(size, len(words))):
        out = mix64(out * GOLD + h[i: i + n])
    return key, np.unique(out)


def superminhash(sets: list[np.ndarray], places: int) -> np.ndarray:
    """SuperMinHash signatures of several sets, one row each, as integers rank * 2^32 + fraction."""
    if len(sets) == 1 and len(sets[0]) > SLICE:  # a very long text, slice by slice
        parts = [superminhash([sets[0][i: i + SLICE]], places) for i in range(0, len(sets[0]), SLICE)]
        return np.minimum.reduce(parts)
    signature = np.full((len(sets), places), np.iinfo(np.int64).max, np.int64)
    flat = signature.reshape(-1)
    sizes = np.array([len(s) for s in sets])
    element = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    state = mix64(element ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    permutation = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.uint16), (len(element), 1))
    row = np.arange(len(element))
    for rank in range(places):
        if not len(row):
            break
        state = mix64(state + GOLD)
        swap = rank + ((state >> np.uint64(40)) % np.uint64(places - rank)).astype(np.int64)
        chosen = permutation[row, swap]
        permutation[row, swap] = permutation[row, rank]
        value = np.int64(rank << 32) + (state & np.uint64(0xFFFFFFFF)).astype(np.int64)
        np.minimum.at(flat, owner * places + chosen, value)
        going = signature.max(1) >= (rank + 1) << 32  # else no later rank can lower a place
        active = going[owner]
        if not active.all():
            row, owner, state = row[active], owner[active], state[active]
    return signature


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per set and band; the band's number is part of it."""
    parts = signature.reshape(len(signature), bands, -1).astype(np.uint64)
    key = mix64(np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), parts.shape[:2]))
    for i in range(parts.shape[2]):
        key = mix64(key * GOLD + parts[:, :, i])
    return key.view(np.int64)


def _sign(batches: Iterator[pd.DataFrame], places: int, bands: int, size: int) -> Iterator[pd.DataFrame]:
    """Key, set size and band keys of every text; exact copies in a batch are signed once."""
    for batch in batches:
        rows, new, at, keys = [], {}, 0, {}

        def flush() -> None:
            if new:
                found = band_keys(superminhash(list(new.values()), places), bands)
                keys.update({k: list(x) for k, x in zip(new, found)})
                new.clear()

        pending = 0
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            key, grams = shingles(text, size)
            rows.append((doc_id, key, len(grams)))
            if key is not None and key not in keys and key not in new:
                if pending + len(grams) > SLICE:
                    flush()
                    pending = 0
                new[key] = grams
                pending += len(grams)
        flush()
        out = pd.DataFrame(rows, columns=["doc_id", "key", "n_shingles"])
        seen: set[bytes] = set()
        out["bands"] = [None if k is None or k in seen or seen.add(k) else keys[k] for k in out["key"]]
        yield out


def _links(sets: list[np.ndarray], names: list[bytes], side: np.ndarray, percent: int) -> list[tuple[bytes, bytes]]:
    """A forest of the links among sets; with two sides (0 and 1) only links across them."""
    sizes = np.array([len(s) for s in sets])
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(names[0], names[1])] if 100 * both >= percent * (sizes.sum() - both) else []
    ids, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(inverse, kind="stable")
    posting, starts = owner[order], np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(ids)))])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    forest, out = UnionFind(), []
    across = bool((side != side[0]).any())
    for x in range(n):
        if across and side[x]:
            continue
        mine = inverse[begin[x]: begin[x + 1]]
        lengths = starts[mine + 1] - starts[mine]
        spot = np.repeat(starts[mine] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        both = np.bincount(posting[spot], minlength=n)
        linked = 100 * both >= percent * (sizes[x] + sizes - both)
        linked[: x + 1] &= across
        if across:
            linked &= side == 1
        for y in np.flatnonzero(linked):
            if forest.union(x, int(y)):
                out.append((names[x], names[y]))
    return out


def _verify(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by tile pair; each pair's rows are held together, no more."""
    def close(rows: list) -> pd.DataFrame:
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        side = np.array([r[1] for r in rows])
        return pd.DataFrame(_links(sets, [r[0] for r in rows], side, percent), columns=["a", "b"])

    current, held = None, []
    for batch in batches:
        for cluster, i, j, side, key, grams in zip(*(batch[c] for c in ("cluster", "i", "j", "side", "key", "grams"))):
            if (cluster, i, j) != current:
                if len(held) > 1:
                    yield close(held)
                current, held = (cluster, i, j), []
            held.append((key, side, grams))
    if len(held) > 1:
        yield close(held)


def groups(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, key, n_shingles, component_id, kept of every document; ``limits`` as for ``_grouped``."""
    return _grouped(docs, **limits)[0]


def _grouped(docs: DataFrame, percent: int = 85, size: int = 5, places: int = 256, bands: int = 32, tile: int = 120_000) -> tuple[DataFrame, DataFrame]:
    """The documents with their groups, and doc_id and key of one document for each group.

    ``percent``: least intersection in percent of the union; ``places`` and ``bands``:
    signature length and number of bands (with 256 and 32 a pair at 85 percent is missed
    with probability 4e-5); ``tile``: shingles held for one side in a task, about.
    """
    kind = docs.schema["doc_id"].dataType
    ids = docs.select(F.col("doc_id").cast("string"), F.col("text"))
    signed = ids.mapInPandas(lambda it: _sign(it, places, bands, size), "doc_id string, key binary, n_shingles long, bands array<long>")
    signed = materialize(signed.withColumn("doc_id", F.col("doc_id").cast(kind)), "signatures")

    # Band rows of distinct texts; a band key held by several texts links each to the smallest of them.
    bands_of = signed.where(F.col("bands").isNotNull()).select("key", F.explode("bands").alias("band"))
    shared = bands_of.groupBy("band").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first != last").select("band", "first")
    candidates = bands_of.join(shared, "band").where("key != first").select(F.col("key").alias("a"), F.col("first").alias("b"))
    clusters = components(candidates)

    # Full sets of the texts in clusters, one row per distinct text.
    members = signed.where(F.col("bands").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
    members = materialize(members.join(clusters.withColumnRenamed("node", "key"), "key").select("key", "doc_id", "n", F.col("root").alias("cluster")), "members")
    tiles = members.groupBy("cluster").agg(F.ceil(F.sum("n") / tile).cast("int").alias("tiles"))
    members = members.join(tiles, "cluster").withColumn("tile", F.pmod(F.xxhash64("key"), "tiles").cast("int"))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingles(t, size) for t in batch["text"]]
            same = np.array([f[0] == k for f, k in zip(found, batch["key"])], bool)
            out = batch[["key", "cluster", "tile", "tiles"]].assign(grams=[f[1].tobytes() for f in found])
            yield out[same]

    wanted = members.select(F.col("doc_id").alias("d"), "key", "cluster", "tile", "tiles")
    # A merge join at every size: a broadcast for small tables would only hide what the join moves.
    full = (docs.select("doc_id", "text").join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d"))).select("text", "key", "cluster", "tile", "tiles")
            .mapInPandas(sets, "key binary, cluster binary, tile int, tiles int, grams binary"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o")
    placed = full.select("key", "cluster", "grams", "tile", other).select(
        "cluster", F.least("tile", "o").alias("i"), F.greatest("tile", "o").alias("j"), (F.col("tile") > F.col("o")).cast("int").alias("side"), "key", "grams")
    links = (placed.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "key")
             .mapInPandas(lambda it: _verify(it, percent), "a binary, b binary"))
    roots = components(links)

    least = signed.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("least"))
    least = materialize(least.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "least", F.coalesce("root", "key").alias("root")), "least")
    chosen = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = least.join(chosen, "root").select("key", "component_id")
    worded = signed.where(F.col("key").isNotNull()).select("doc_id", "key", "n_shingles").join(named, "key").select("doc_id", "key", "n_shingles", "component_id")
    empty = signed.where(F.col("key").isNull()).select("doc_id", "key", "n_shingles", F.col("doc_id").alias("component_id"))
    found = worded.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    # The smallest id, a null one last, and of several texts with it the smallest key.
    first = least.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), F.col("least"), F.col("key"))).alias("first"))
    return found, first.select(F.col("first.least").alias("doc_id"), F.col("first.key").alias("key"))


def _pair(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
    """What names a row: the key of its text (or the digest of a text without words), then its id."""
    out = []
    for doc_id, text in zip(ids, texts):
        words = low_words(text)
        key = text_key(words) if words else b"0" + xxhash.xxh3_128_digest((text or "").encode("utf-8", "surrogatepass"))
        out.append((key + (b"" if doc_id is None else b"i" + doc_id.encode("utf-8", "surrogatepass")), not words))
    return pd.DataFrame(out, columns=["pair", "bare"])


def keep_one(docs: DataFrame, **limits) -> DataFrame:
    """One document of every group, with all its columns: the one with the smallest id.

    Texts without words stay. Rows equal in id and text count as one document. Of several
    texts with the smallest id, or without any id, the one with the smallest key stays.
    Whole rows move once: they are reduced to one for each pair of text and id, and meet the chosen pairs there.
    """
    _found, first = _grouped(docs, **limits)
    suffix = F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit("")).cast("binary")
    chosen = first.select(F.concat("key", suffix).alias("pair"), F.lit(True).alias("chosen"))
    named = whole(docs, doc_id=F.col("doc_id").cast("string"), text=F.col("text")).withColumn(
        "name", F.pandas_udf(_pair, "pair binary, bare boolean")("doc_id", "text"))
    rows = named.select("name.pair", "name.bare", "whole").dropDuplicates(["pair"])
    return rows.join(chosen.hint("merge"), "pair", "left").where(F.col("bare") | F.col("chosen")).select("whole.*")
