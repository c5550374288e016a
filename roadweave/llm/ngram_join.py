"""Operator 1: n-gram Jaccard self-join by PartEnum signatures, and its connected groups.

Two sets of sizes a <= b reach ``100 * |A & B| >= percent * |A | B|`` exactly when their
Hamming distance is at most ``(a + b) * (100 - percent) // (100 + percent)`` =: k. PartEnum
deals the feature domain to ``groups * n2`` partitions: k differences cannot spoil
(more than k2 in) every one of ``k // (k2 + 1) + 1`` groups, so in some group a choice of
``n2 - k2`` partitions is equal in both sets and gives both the same signature. Sets of
one size band share the partitioning; a set near a band's upper end also signs for the
next band. A set emits only as many groups as its own size can need, plus spare ones.
A pair shares more groups than the smaller set has spare ones, so one of them is full if
either set has no more empty partitions than that. A set that has more is dealt again
with other hashes, as any set like it is that it may link to, until it has fewer:
signatures over empty partitions, in which unrelated sets meet, are left to the last
deal. What a set has fewer, its slack, is what a pair shares beyond one: so many of its
most frequent signatures are left out.

Every pair at the threshold shares a signature (no recall loss). Copies of one set are
one class. Within a signature classes are compared by parity sketches, whose differing
bits never outnumber the sets' differing shingles, and each is tied to the smallest class
that it may reach; the classes of a signature that very many share are tied unseen. The
components of these ties are clusters that hold every link. A cluster's texts are dealt
once to blocks of bounded size, each with the cluster's first class, where exact Hamming
distances are popcounts of a bit matrix; ties to a smallest class leave the block. Near
copies of one text are joined by their first class that way. Only what stays apart from
most of its cluster is compared again with all that share a signature with it, in pairs
of blocks. So no pairs of a group are emitted, no group is held by one task, and a group
of near copies takes work in proportion to its size.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from .tables import dropped, few, mapped, slices, stored
from .words import PIECE_BYTES, U64, mix, shingle_sets, summed

#: More documents to be verified than this are found by a shuffled join instead of a broadcast of their ids (8 bytes each).
BROADCAST_IDS = 500_000
#: Classes of one signature, and texts of one cluster, meet in blocks of about so many; a block of texts has about so many shingles.
SIGNATURE_BLOCK, TEXT_BLOCK, BLOCK_SHINGLES = 1000, 300, 400_000
#: Times that a set with many empty partitions is dealt to them at most; one in some dozens is dealt twice.
DEALS = 8
_ODD = mix(np.arange(1, 65, dtype=U64)) | U64(1)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U64).view(np.int64)


class PartEnum:
    """Signature scheme for one threshold; ``percent`` 1 to 99."""

    def __init__(self, percent: int = 90, k2: int = 1, n2: int = 2, growth: float = 1.5):
        if not (0 < percent < 100 and 0 <= k2 < n2):
            raise ValueError("percent must be 1..99 and k2 less than n2")
        self.percent, self.k2, self.n2, self.growth = percent, k2, n2, growth
        self.choices = list(combinations(range(n2), n2 - k2))
        self.least = next(s for s in range(1, 10_000) if self.distance(s))
        self.bands = [self.least]
        # empty partitions to expect where a band's smallest sets have fewest elements for each
        self.empty = math.exp(-1 / (growth * self.distance(100_000) / 100_000))

    def largest_partner(self, s: int) -> int:
        return s * 100 // self.percent

    def smallest_partner(self, s: int) -> int:
        return -(-s * self.percent // 100)

    def distance(self, s: int) -> int:
        """Largest Hamming distance at which a set of ``s`` can link to one of its size or more."""
        return (s + self.largest_partner(s)) * (100 - self.percent) // (100 + self.percent)

    def spare(self, s: int) -> int:
        expected = self.empty * self.distance(s)
        return 2 + max(math.ceil(2.5 * expected), round(4 * expected))

    def groups(self, s: int) -> int:
        return self.distance(s) // (self.k2 + 1) + 1 + self.spare(s)

    def band(self, s: int) -> int:
        while self.bands[-1] <= s:
            self.bands.append(int(self.bands[-1] * self.growth) + 1)
        return int(np.searchsorted(self.bands, s, "right")) - 1

    def signatures(self, elements: np.ndarray) -> np.ndarray:
        """Signatures of one set of 64-bit elements; none for sets that can only equal others."""
        return np.concatenate([np.zeros(0, U64), *(sigs for _, _, sigs, _ in self.lists(elements))])

    def lists(self, elements: np.ndarray):
        """(band, deal, signatures, slack) of a set: in one list that both have, sets that may link share more signatures than the slack of either."""
        s = len(elements)
        if s < self.least:
            return
        own = self.band(s)
        # of the pairs that meet in the next band it is the smaller set
        instances = [(own, self.spare(self.smallest_partner(s)))]
        if self.band(self.largest_partner(s)) > own:
            instances.append((own + 1, self.spare(s)))
        for inst, spare in instances:
            for deal in range(DEALS):
                sigs, full = self._dealt(elements, inst, deal)
                slack = spare - int((~full).sum())
                if slack >= 0 or deal + 1 < DEALS:
                    yield inst, deal, sigs[full], max(0, slack)
                else:
                    yield inst, deal, sigs.ravel(), 0
                if slack >= 0:
                    break

    def _dealt(self, elements: np.ndarray, inst: int, deal: int) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of one deal by group and choice, and which of them are over a partition that isn't empty."""
        total, need = self.groups(self.bands[inst + 1]), self.groups(len(elements))
        salt = _ODD[inst % 64] ^ (mix(np.array([deal], U64))[0] if deal else U64(0))
        acc, some = np.zeros(need * self.n2, U64), np.zeros(need * self.n2, bool)
        for lo in range(0, len(elements), PIECE_BYTES):
            salted = mix(elements[lo : lo + PIECE_BYTES] ^ salt)
            at = ((salted >> U64(32)) * U64(total * self.n2)) >> U64(32)
            keep = at < need * self.n2
            at, value = at[keep].astype(np.int64), mix(salted[keep] + U64(inst + 1))
            np.add.at(acc, at, value)
            some[at] = True
        acc, some = acc.reshape(need, self.n2), some.reshape(need, self.n2)
        tags = (np.arange(need, dtype=U64) << U64(16)) + U64(inst) + (U64(deal) << U64(56))
        sigs, full = [], []
        for c, choice in enumerate(self.choices):
            cols = list(choice)
            sigs.append(mix((acc[:, cols] * _ODD[cols]).sum(1, dtype=U64) ^ mix(tags * _ODD[63] + U64(c))))
            full.append(some[:, cols].any(1))
        return np.stack(sigs, 1), np.stack(full, 1)

    def sketch_bits(self, s: int) -> int:
        """A power of two, 2.5 to 5 bits for each shingle that may differ, as unequal sets differ in half of them; longer sketches fold to shorter ones."""
        return 1 << max(6, int(2.5 * self.distance(self.bands[self.band(self.largest_partner(s)) + 1]) - 1).bit_length())

    def sketch(self, elements: np.ndarray) -> bytes:
        """Parity of the elements that fall on each bit."""
        if len(elements) < self.least:
            return b""
        self.band(self.largest_partner(len(elements)))
        size = self.sketch_bits(len(elements))
        odd = np.zeros(size, bool)
        for lo in range(0, len(elements), PIECE_BYTES):
            at = (mix(elements[lo : lo + PIECE_BYTES] ^ _ODD[7]) & U64(size - 1)).astype(np.int64)
            odd ^= (np.bincount(at, minlength=size) & 1).astype(bool)
        return np.packbits(odd).tobytes()

    def apart(self, n: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Whether sets of sizes ``n`` at these (least) distances cannot link."""
        pair = n[:, None] + n[None, :]
        small, large = np.minimum(n[:, None], n[None, :]), np.maximum(n[:, None], n[None, :])
        return (distance > pair * (100 - self.percent) // (100 + self.percent)) | (100 * small < self.percent * large)


def fold(sketch: bytes, size: int) -> bytes:
    """The sketch of ``size`` bytes of the same set."""
    bits = np.frombuffer(sketch, np.uint8)
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits.tobytes()


def distances(rows: np.ndarray, out: np.ndarray) -> None:
    """Add to ``out`` the pairwise Hamming distances of bit rows (uint64)."""
    step = max(1, (1 << 22) // max(1, rows.size))
    for i in range(0, len(rows), step):
        out[i : i + step] += np.bitwise_count(rows[i : i + step, None, :] ^ rows[None, :, :]).sum(-1, dtype=np.int64)


def smallest_reached(linked: np.ndarray) -> np.ndarray:
    """Of a symmetric link matrix: the smallest index reachable from each."""
    root = np.arange(len(linked))
    linked = linked | np.eye(len(linked), dtype=bool)
    while True:
        now = np.where(linked, root[None, :], len(root)).min(1)
        now = now[now]
        if (now == root).all():
            return root
        root = now


def _rows(batch, words: int):
    """(first row, set of every row) of each slice of a batch."""
    for lo, _, data, offs in slices(batch.column("text")):
        yield lo, shingle_sets(data, offs, words)


def _identity(u: np.ndarray) -> int:
    return summed(u, U64(0))


def _second(u: np.ndarray) -> int:
    return summed(u, _ODD[5])


_SETS = "doc_id long, t long, n long, h1 long, h2 long, sketch binary"


def _sets(words: int, scheme: PartEnum):
    schema = pa.schema([(name, pa.int64()) for name in ("doc_id", "t", "n", "h1", "h2")] + [("sketch", pa.binary())])

    def run(batches):
        for batch in batches:
            for lo, sets in _rows(batch, words):
                columns = [pa.array(x, pa.int64()) for x in ([len(u) for u in sets], [_identity(u) for u in sets], [_second(u) for u in sets])]
                same = [batch.column(c).slice(lo, len(sets)) for c in ("doc_id", "t")]
                yield pa.RecordBatch.from_arrays([*same, *columns, pa.array([scheme.sketch(u) for u in sets], pa.binary())], schema=schema)

    return run


def _signatures(words: int, scheme: PartEnum):
    """(sig, h1, list): ``list`` has the slack of the signature's list above 8 bits for its deal and band."""
    schema = pa.schema([("sig", pa.int64()), ("h1", pa.int64()), ("list", pa.int32())])

    def run(batches):
        for batch in batches:
            for _, sets in _rows(batch, words):
                found = [(_identity(u), (slack << 8) + 2 * deal + band % 2, sigs) for u in sets for band, deal, sigs, slack in scheme.lists(u)]
                if found:
                    ids, lists, sigs = zip(*found, strict=True)
                    n = [len(x) for x in sigs]
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(sigs))), pa.array(np.repeat(np.array(ids, np.int64), n)), pa.array(np.repeat(np.array(lists, np.int32), n))], schema=schema)

    return run


def _rarest(met: DataFrame) -> DataFrame:
    """(sig, h1) of ``met`` (sig, h1, list, count) without the most frequent signatures of each list, as many as its slack.

    Of the signatures that two linked sets share, more than either one's slack, the rarest stays in both: all the others
    come after it in either list.
    """
    order = Window.partitionBy("h1", "list").orderBy(F.desc("count"), "sig")
    ranked = met.repartition("h1").distinct().withColumn("_rank", F.row_number().over(order))
    return ranked.where("_rank > shiftright(list, 8)").select("sig", "h1").distinct()


def _groups(batches, keys: list[str], columns: list[str]):
    """Lists of column values of each run of equal keys in sorted rows; a run may cross batches."""
    last, held = None, [[] for _ in columns]
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys], 1)
        cuts = np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1
        values = [batch.column(c).to_pylist() for c in columns]
        for lo, hi in zip([0, *cuts], [*cuts, len(at)], strict=True):
            key = tuple(at[lo])
            if key != last and held[0]:
                yield held
                held = [[] for _ in columns]
            last = key
            for h, v in zip(held, values, strict=True):
                h += v[lo:hi]
    if held[0]:
        yield held


def _ties(found: list[tuple[np.ndarray, ...]], *names: str):
    columns = [np.concatenate(x) for x in zip(*found, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=list(names))


_NEAR = "sig long, node long, root long"


def _near(scheme: PartEnum):
    """Classes of one signature block (sig, bi, bj, h1, n, sketch) that may link: (sig, node, root)."""

    def run(batches):
        found, held = [], 0
        for sig, h1, n, sketches in _groups(batches, ["sig", "bi", "bj"], ["sig", "h1", "n", "sketch"]):
            if len(h1) < 2:
                continue
            order = np.argsort(h1)
            h1, n = np.array(h1)[order], np.array(n)[order]
            size = max(8, min(map(len, sketches)))
            bits = [fold(sketches[i], size) for i in order]
            apart = np.zeros((len(h1), len(h1)), np.int64)
            distances(np.frombuffer(b"".join(bits), np.uint64).reshape(len(h1), -1), apart)
            root = smallest_reached(~scheme.apart(n, apart))
            tied = np.flatnonzero(root != np.arange(len(h1)))
            if len(tied):
                found.append((np.full(len(tied), sig[0]), h1[tied], h1[root[tied]]))
                held += len(tied)
            if held >= 20_000:
                yield _ties(found, "sig", "node", "root")
                found, held = [], 0
        if found:
            yield _ties(found, "sig", "node", "root")

    return run


def _linked(words: int, scheme: PartEnum):
    """Classes of one block (cluster, bi, bj, h1, h2, id, text) that links join: (node, root) of ids."""

    def run(batches):
        for h1, h2, own, texts in _groups(batches, ["cluster", "bi", "bj"], ["h1", "h2", "id", "text"]):
            found = {}
            for lo, _, data, offs in slices(pa.array(texts, pa.large_string())):
                for i, u in enumerate(shingle_sets(data, offs, words), lo):
                    if (_identity(u), _second(u)) == (h1[i], h2[i]):  # else another text under the same doc_id
                        found[own[i]] = u
            ids = np.array(sorted(found), np.int64)
            sets = [found[i] for i in ids]
            n = np.array([len(u) for u in sets], np.int64)
            vocabulary, at = np.unique(np.concatenate([*sets, np.zeros(0, U64)]), return_inverse=True)
            row = np.repeat(np.arange(len(sets)), n)
            apart = np.zeros((len(sets), len(sets)), np.int64)
            width = 1 << 14
            for first in range(0, len(vocabulary), width):
                part = (at >= first) & (at < first + width)
                bits = np.zeros((len(sets), min(width, -(-(len(vocabulary) - first) // 64) * 64)), bool)
                bits[row[part], at[part] - first] = True
                distances(np.packbits(bits, axis=1).view(np.uint64), apart)
            root = smallest_reached(~scheme.apart(n, apart))
            yield _ties([(ids, ids[root])], "node", "root")

    return run


def _paired(rows: DataFrame, key: str, blocks: DataFrame) -> DataFrame:
    """Deal the rows of each key to pairs of its ``blocks`` (bi <= bj): any two rows of a key meet, each with its own block's rows too."""
    own = F.pmod(F.xxhash64("h1", F.lit(3)), F.col("blocks")).cast("int")
    dealt = rows.join(blocks, key).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"bi": F.least("own", "other"), "bj": F.greatest("own", "other")}).drop("own", "other", "blocks")


def _with_pivot(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Deal the rows of each cluster to its blocks once; the class it is named after stands in all of them."""
    own = F.pmod(F.xxhash64("h1", F.lit(3)), F.col("blocks")).cast("int")
    everywhere = F.when(F.col("h1") == F.col("cluster"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    return rows.join(blocks, "cluster").withColumns({"bi": F.explode(everywhere), "bj": F.lit(0)}).drop("blocks")


def _blocks(rows: DataFrame, key: str, size: int, weight: str = "0", heavy: int = 1) -> DataFrame:
    """(key, blocks): as many as give a block about ``size`` rows and ``heavy`` weight at most; keys of one row are left out."""
    blocks = F.greatest(F.ceil(F.col("members") / size), F.ceil(F.col("weight") / heavy)).cast("int")
    sums = rows.groupBy(key).agg(F.count("*").alias("members"), F.sum(F.expr(weight)).alias("weight"))
    return stored(sums.where("members > 1").select(key, F.greatest(F.lit(1), blocks).alias("blocks")), "blocks")


class _Join:
    """The tables that the steps of one self-join share."""

    def __init__(self, docs: DataFrame, base: DataFrame, reps: DataFrame, words: int, scheme: PartEnum):
        self.docs, self.base, self.reps, self.words, self.scheme = docs, base, reps, words, scheme

    def near(self, hits: DataFrame) -> DataFrame:
        """(sig, node, root) of h1: classes that share a signature (sig, h1) and whose sketches do not exclude a link."""
        wanted = hits.select("h1").distinct()
        sketches = self.base.where("n > 0").join(wanted, "h1", "left_semi").groupBy("h1").agg(F.max("n").alias("n"), F.max("sketch").alias("sketch"))
        met = _paired(hits.select("sig", "h1"), "sig", _blocks(hits, "sig", SIGNATURE_BLOCK)).join(stored(sketches, "sketches"), "h1")
        met = met.repartition("sig", "bi", "bj").sortWithinPartitions("sig", "bi", "bj")
        return mapped(met.select("sig", "bi", "bj", "h1", "n", "sketch"), _near(self.scheme), _NEAR)

    def clusters(self, near: DataFrame) -> DataFrame:
        """(cluster, h1, h2, id, n, rep, t): the classes of the components of ``near``."""
        found = components(near, "node", "root").withColumnsRenamed({"node": "h1", "root": "cluster"})
        return stored(found.join(self.reps, "h1"), "clusters")

    def ties(self, clusters: DataFrame, deal, blocks: DataFrame) -> DataFrame:
        """(node, root) of ids: exact links within the blocks that ``deal`` makes of the clusters' texts."""
        wanted = few(clusters.select("cluster", "h1", "h2", "id", F.col("rep").alias("_rep"), F.col("t").alias("_t")), BROADCAST_IDS)
        texts = self.docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_rep")) & (F.col("t") == F.col("_t"))).select("cluster", "h1", "h2", "id", "text")
        met = deal(texts.dropDuplicates(["id"]), few(blocks, BROADCAST_IDS)).repartition("cluster", "bi", "bj").sortWithinPartitions("cluster", "bi", "bj")
        return stored(mapped(met.select("cluster", "bi", "bj", "h1", "h2", "id", "text"), _linked(self.words, self.scheme), "node long, root long").distinct(), "ties")

    def unlinked(self, split: DataFrame, labels: DataFrame) -> DataFrame:
        """h1 of the classes (cluster, h1, id) of clusters of several blocks that stand apart from most of theirs by ``labels`` (node, root)."""
        known = stored(split.join(labels, F.col("id") == F.col("node"), "left").select("cluster", "h1", F.coalesce("root", "id").alias("label")), "labels")
        sizes = known.groupBy("cluster", "label").agg(F.count("*").alias("n"))
        largest = stored(sizes.groupBy("cluster").agg(F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1").select("cluster", "most.label"), "largest")
        return stored(known.join(largest.withColumnRenamed("label", "_most"), "cluster").where("label <> _most").select("h1").distinct(), "unlinked")


def ngram_jaccard_groups(docs: DataFrame, words: int = 3, percent: int = 90, scheme: PartEnum | None = None) -> DataFrame:
    """Return one row per row of ``docs`` (doc_id, text): doc_id, n_shingles, class_hash, component_id.

    A document's set has its distinct ``words``-word shingles (lower case A-Z, words of
    ``[^\\x20\\x09-\\x0D]+``); with fewer words the whole sequence is one shingle. Null and
    empty texts have the empty set, link with nothing and are their own component. Equal
    sets link, repeated rows included; rows of one doc_id with different texts are
    different documents that share an id. component_id is the smallest doc_id reachable
    (null doc_ids count only if all are null). A long text is read in pieces, only its
    shingles are held. An empty table gives none; extra columns are ignored.
    """
    scheme = scheme or PartEnum(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    base = stored(mapped(docs, _sets(words, scheme), _SETS), "sets")
    held = {"rep": F.min("doc_id"), "t": F.coalesce(F.min_by("t", "doc_id"), F.min("t")), "n": F.max("n"), "id": F.xxhash64("h1", "h2")}
    reps = base.where("n > 0").groupBy("h1", "h2").agg(*(x.alias(k) for k, x in held.items() if k != "id")).withColumn("id", held["id"])
    reps = stored(reps, "classes")
    join = _Join(docs, base, reps, words, scheme)
    # of the copies of a set only the smallest doc_id signs, as far as ids tell rows apart
    copies = base.select("doc_id").where("doc_id is not null").join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti")
    copies = stored(copies.distinct(), "copies")
    signing = docs.join(few(copies, BROADCAST_IDS), "doc_id", "left_anti")
    rows = mapped(signing.select("text"), _signatures(words, scheme), "sig long, h1 long, list int")
    shared = stored(rows.groupBy("sig").count().where("count > 1"), "shared")
    met = stored(_rarest(rows.join(shared, "sig")), "met")
    # signatures of the same classes are alike; near copies share many, of which one is enough
    part = F.lit(1 << 31)
    alike = {"least": F.min("h1"), "members": F.count("*"), "s1": F.sum(F.pmod(F.xxhash64("h1"), part)), "s2": F.sum(F.pmod(F.xxhash64("h1", F.lit(1)), part))}
    enough = met.groupBy("sig").agg(*(x.alias(k) for k, x in alike.items())).where("members > 1").groupBy(*alike).agg(F.min("sig").alias("sig")).select("sig", "members", "least")
    hits = stored(met.join(stored(enough, "enough"), "sig"), "hits")
    dropped(shared, met, copies)
    # the classes of a much shared signature are candidates of each other without a look at their sketches
    unseen = hits.where(F.col("members") > SIGNATURE_BLOCK).select("sig", F.col("h1").alias("node"), F.col("least").alias("root"))
    near = stored(join.near(hits.where(F.col("members") <= SIGNATURE_BLOCK)).unionByName(unseen.where("node <> root")), "near")
    clusters = join.clusters(near)
    blocks = _blocks(clusters, "cluster", TEXT_BLOCK, "n", BLOCK_SHINGLES)
    ties = join.ties(clusters, _with_pivot, blocks)
    # classes that met in one block have one root there; the others have one in each of their blocks
    roots = ties.groupBy("node").agg(F.min("root").alias("root"))
    several = blocks.where("blocks > 1").select("cluster")
    if several.limit(1).count():
        roots = stored(components(ties, "node", "root"), "roots")
        left = join.unlinked(clusters.join(few(several, BROADCAST_IDS), "cluster", "left_semi").select("cluster", "h1", "id"), roots)
        if left.limit(1).count():  # what shares a signature with them, one that ties any of its classes, meets block by block
            tied = hits.join(left, "h1", "left_semi").select("sig").distinct().join(near.select("sig").distinct(), "sig", "left_semi")
            again = stored(hits.join(stored(tied, "tied"), "sig", "left_semi"), "again")
            clusters = join.clusters(stored(join.near(again), "near"))
            more = join.ties(clusters, lambda texts, dealt: _paired(texts, "cluster", dealt), _blocks(clusters, "cluster", TEXT_BLOCK, "n", BLOCK_SHINGLES))
            roots = stored(components(roots.unionByName(more), "node", "root"), "roots")
    known = reps.select("h1", "h2", "id", "rep").join(roots.withColumnsRenamed({"node": "id", "root": "label"}), "id")
    lowest = known.groupBy("label").agg(F.min("rep").alias("component_id"))
    found = stored(known.join(lowest, "label").select("h1", "h2", "component_id"), "components")
    own = reps.select("h1", "h2", "rep").join(found, ["h1", "h2"], "left").select("h1", "h2", F.coalesce("component_id", "rep").alias("component_id"))
    out = base.select("doc_id", F.col("n").alias("n_shingles"), "h1", "h2").join(stored(own, "own"), ["h1", "h2"], "left")
    return out.select("doc_id", "n_shingles", F.col("h1").alias("class_hash"), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
