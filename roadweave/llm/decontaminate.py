"""Operator 6: benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle set, from 2^k to below 2^(k+1). Every
partition is an index of its own: its items keep as their sketch the smallest hashes of
that set (bottom-k MinHash), as many as the partition's largest size needs. A text that
holds ``containment`` of an item lacks at most ``size - ceil(containment * size)`` of its
shingles, so it has all but that many of the sketch: this is the item's threshold, from 1
up to HITS, and what a document must reach to be a candidate. Every candidate is verified
by exact containment of the item's shingles, as words.

Items of fewer words than a shingle are one shingle of their own length. They are found
in texts equal to them, and with ``short_items`` wherever their words stand in a text:
every such length is one more partition, looked up among the document's shingles of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import mapped, slices
from .words import U64, Words, grams, hash_words, overlapped, shingle_set

#: Items are searched in blocks of so many rows, and a block ends earlier once it has BLOCK_BYTES of text: what is broadcast at once stays under about four times that.
BLOCK_ITEMS, BLOCK_BYTES = 50_000, 16 << 20
#: Sketch hashes more than needed to miss no text, so that one common shingle makes no candidate.
HITS = 4


def _words(text: bytes) -> list[bytes]:
    return text.translate(bytes(c + 32 if 65 <= c < 91 else c for c in range(256))).split()


def _shingles(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def spare(size: int, percent: int) -> int:
    """Shingles that a text which holds ``percent`` of an item of ``size`` may lack."""
    return size - -(-percent * size // 100)


def sketch_size(size: int, percent: int) -> int:
    """Sketch length of the size partition [2^k, 2^(k+1)) that ``size`` falls into, at most ``size``."""
    top = 2 ** int(size).bit_length() - 1
    return min(size, max(spare(s, percent) for s in (top, size)) + HITS)


class Partition:
    """Index of the items of one size range, or of one length under ``n`` words: sorted sketch hashes, their items, every item's threshold."""

    def __init__(self, length: int):
        self.length, self.sketches, self.owners, self.need = length, [], [], []

    def add(self, owner: int, sketch: np.ndarray, need: int) -> None:
        self.sketches.append(sketch)
        self.owners.append(np.full(len(sketch), len(self.need)))
        self.need.append((owner, need))

    def close(self) -> None:
        keys, owners = np.concatenate(self.sketches), np.concatenate(self.owners)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners, self.need = keys[order], owners[order], np.array(self.need, np.int64)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.keys & U64(0xFFFF)).astype(np.int64)] = True
        del self.sketches

    def present(self, g: np.ndarray) -> np.ndarray:
        """Places of the hashes that some sketch holds."""
        near = np.flatnonzero(self.seen[(g & U64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, g[near]), len(self.keys) - 1)
        return near[self.keys[at] == g[near]]

    def candidates(self, g: np.ndarray) -> np.ndarray:
        """Items of which the distinct hashes ``g`` reach the threshold."""
        lo, hi = np.searchsorted(self.keys, g, "left"), np.searchsorted(self.keys, g, "right")
        count = hi - lo
        at = np.repeat(lo, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        item, hits = np.unique(self.owners[at], return_counts=True)
        return self.need[item[hits >= self.need[item, 1]], 0]


class Sketches:
    """The partitions of a block of items (id, text)."""

    def __init__(self, items: list[tuple[int, bytes]], n: int, percent: int, short_items: bool):
        self.items = items
        self.partitions: dict[tuple, Partition] = {}
        for at, (_, text) in enumerate(items):
            data = np.frombuffer(text, np.uint8)
            h = Words(data, np.array([0, len(data)])).h
            found = shingle_set(h, n)
            if not len(found):
                continue
            if len(h) < n:
                keys = [("equal", len(h)), *([("inside", len(h))] if short_items else [])]
            else:
                keys = [("size", len(found).bit_length())]
            for key in keys:
                kept = found[: sketch_size(len(found), percent)]
                self.partitions.setdefault(key, Partition(len(h) if len(h) < n else n)).add(at, kept, max(1, len(kept) - spare(len(found), percent)))
        for partition in self.partitions.values():
            partition.close()


def _held(text: np.ndarray, k: int, items: list[tuple[int, set, np.ndarray]]) -> set[tuple[bytes, ...]]:
    """The k-word shingles of the items that stand in a text, which is read piece by piece; one of fewer words is its only shingle."""
    hashes = np.unique(np.concatenate([h for *_, h in items]))
    wanted = set().union(*(w for _, w, _ in items))
    out = set()
    for before, own, scan in overlapped(text, np.array([0, len(text)]), k - 1):
        h = scan.hashes()
        if before and len(h) < k:
            continue
        size = min(k, len(h))
        g = grams(h, size)[:own] if size else h
        places = np.flatnonzero(np.isin(g, hashes))
        _, first = np.unique(g[places], return_index=True)
        shingle = lambda at: tuple(scan.data[scan.starts[at + j] : scan.ends[at + j]].tobytes() for j in range(size))  # noqa: B023, E731
        for at in places[first]:
            if shingle(at) in wanted:
                out.add(shingle(at))
            else:  # another shingle of the same hash may follow
                out.update(wanted.intersection(map(shingle, places[g[places] == g[at]])))
    return out


def _search(spread, n: int, percent: int, short_items: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_item", pa.int64()), ("n_common", pa.int64())])

    def run(batches):
        index = Sketches(spread.value, n, percent, short_items)
        parsed: dict[int, tuple[int, set, np.ndarray]] = {}

        def item(at: int) -> tuple[int, set, np.ndarray]:
            """Length, shingles and their hashes."""
            if at not in parsed:
                if len(parsed) > 1000:
                    parsed.clear()
                words = _words(index.items[at][1])
                h = hash_words(words)
                k = min(n, len(h))
                parsed[at] = k if short_items else n, _shingles(words, n), np.unique(grams(h, k))
            return parsed[at]

        for batch in batches:
            for lo, hi, data, offs in slices(batch.column("text")):
                own = Words(data, offs)
                h, first = own.h, own.first
                size = np.diff(first)
                near: dict[int, list[tuple[Partition, np.ndarray]]] = {}
                by_length: dict[int, np.ndarray] = {}
                for (kind, _), partition in index.partitions.items():
                    k = partition.length
                    g = by_length[k] if k in by_length else by_length.setdefault(k, grams(h, k))
                    places = partition.present(g)
                    if not len(places):
                        continue
                    row = np.searchsorted(first, places, "right") - 1
                    good = (size[row] == k) if kind == "equal" else places + k <= first[row + 1]
                    places, row = places[good], row[good]
                    cut = np.flatnonzero(np.diff(row)) + 1
                    for part in np.split(np.arange(len(row)), cut) if len(row) else []:
                        near.setdefault(int(row[part[0]]), []).append((partition, g[places[part]]))
                out = []
                for i, some in sorted(near.items()):
                    found = {int(at) for partition, g in some for at in partition.candidates(np.unique(g))}
                    by_item = [(at, *item(at)) for at in sorted(found)]
                    for k in sorted({k for _, k, *_ in by_item}):
                        own_items = [(at, wanted, hashes) for at, length, wanted, hashes in by_item if length == k]
                        held = _held(data[offs[i] : offs[i + 1]], k, own_items)
                        for at, wanted, _ in own_items:
                            common = len(wanted & held)
                            if 100 * common >= percent * len(wanted):
                                out.append((lo + i, index.items[at][0], len(wanted), common))
                if out:
                    at, ids, n_item, common = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), pa.array(ids, pa.int64()), pa.array(n_item, pa.int64()), pa.array(common, pa.int64())], schema=schema)

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    block, held = [], 0
    for row in items.toLocalIterator():
        text = (row["text"] or "").encode()
        block.append((row["item_id"], text))
        held += len(text)
        if len(block) >= BLOCK_ITEMS or held >= BLOCK_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 5, percent: int = 80, short_items: bool = False) -> DataFrame:
    """Return (doc_id, item_id, n_item, n_common, containment) for every document that holds ``percent`` of an item's shingles.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a text under ``n`` words has its
    whole sequence as one shingle. So an item that short is held by a text equal to it, and
    with ``short_items`` by every text in which its words stand one after another.
    Items without words hold nothing; null texts have no words; null ids stay null; without
    a document or an item there is no row. Repeated rows give repeated results, and extra
    columns are ignored. Items are taken in blocks of bounded size, each searched against all documents.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    fields = "doc_id long, item_id long, n_item long, n_common long"
    out = None
    for block in _blocks(items):
        found = mapped(docs, _search(spark.sparkContext.broadcast(block), n, percent, short_items), fields)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], fields)
    return out.withColumn("containment", F.col("n_common") / F.col("n_item"))
