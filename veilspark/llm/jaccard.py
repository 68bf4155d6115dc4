"""N-gram Jaccard join in the metric space of shingle sets.

Jaccard distance is a metric, and so is the distance of a set to a family of sets. Two kinds of pivots are used.

1. Coarse pivots are families: A(t) has all sets whose first shingle, in one global order, is t. They divide the space
   into Voronoi regions, a document's own being that of its first shingle, at distance 0. A document's distance to A(t),
   for its shingle t, is the share of its shingles before t; by the triangle inequality a partner within distance r can
   only be in a region at distance r or less, so the document is copied into the regions of its first r-share of
   shingles. The order puts shingles that are frequent in the corpus last (by a counting sketch of fixed size over
   every shingle of every document), so regions stay small. Pairs of a region that pass the bounds on sizes, places and
   hashed parity bits, all of them necessary, join documents into clusters that can hold links.
2. In a cluster pivots are documents. Exact distances to them give Voronoi cells; documents in the window of twice r at
   a boundary are copied to the neighbouring cells, and cells join recursively until pairs are compared exactly. A
   document within r of a pivot is linked with it, so of documents that are linked already no pair is compared again.
   A cluster too large for one task is divided by pivots over the cluster, then in pairs of blocks.

Equal sets are one class from the start, whatever their number. Shingles are compared by 64-bit hashes.

Defined results: a document without words has an empty set and is linked with nothing; one with fewer words than a
shingle has the whole sequence as its shingle. Rows repeat as they come; rows with a null doc_id take part, their
component is the smallest doc_id that is not null, or null. Extra columns stay in `one_of_each` and are ignored by
`components_of`.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from veilspark.llm.common import Memo, join_sized, packed, settle, texts, unpacked


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    #: Least similarity, as a fraction of whole numbers.
    num: int = 80
    den: int = 100
    #: Counters of the frequency sketch, as a power of two.
    sketch_bits: int = 22
    #: Regions up to this size give pairs; larger ones a chain through their documents.
    region_pairs: int = 32
    #: Shingles of a cluster that one task may hold.
    cluster_shingles: int = 8_000_000
    pivots: int = 8
    #: Rounds of division by pivots before blocks of a cluster meet in pairs.
    rounds: int = 3
    #: Edges up to this number are joined to components in one task.
    local_edges: int = 150_000

    @property
    def r(self) -> float:
        return 1 - self.num / self.den

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def linked(self, both, na, nb):
        return self.den * both >= self.num * (na + nb - both)

    def most_different(self, na, nb):
        """The largest symmetric difference of linked sets of these sizes."""
        total = na + nb
        return total - 2 * -(-self.num * total // (self.num + self.den))


_C = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F) ^ (h >> np.uint64(31))


class Shingles:
    """Sorted distinct shingle hashes of a text."""

    def __init__(self, s: Settings):
        self.k = s.shingle
        self.words = Memo(xxhash.xxh64_intdigest, 300_000)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        w = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        k = min(self.k, len(w))
        if not k:
            return w
        m = len(w) - k + 1
        h = _mix(w[:m] + np.uint64(k))
        for j in range(1, k):
            h = _mix(h * _C + w[j : m + j])
        return np.unique(h)


def _digest(h: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(h.tobytes())
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def _arrays(b: pa.RecordBatch | pa.Table, *names: str) -> list[np.ndarray]:
    return [b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False) if isinstance(b, pa.RecordBatch) else b.column(n).to_numpy() for n in names]


def _popcount(x: np.ndarray) -> int:
    return int(np.bitwise_count(x).sum())


def signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, n, d1, d2 of each row; and, with chunk >= 0, each task's counters of its shingles."""
    size, chunk = 1 << s.sketch_bits, 1 << min(16, s.sketch_bits)

    def run(batches):
        shingles, count, any_row = Shingles(s), np.zeros(size, np.uint32), False
        for b in texts(batches):
            n, d1, d2, seen = [], [], [], []
            for t in b.column("text"):
                h = shingles(t.as_py())
                x, y = _digest(h)
                n.append(len(h))
                d1.append(x)
                d2.append(y)
                seen.append(h)
            at = np.concatenate(seen) & np.uint64(size - 1)
            any_row |= bool(len(at))
            if len(at) > size // 16:
                count += np.bincount(at.astype(np.int64), minlength=size).astype(np.uint32)
            else:
                np.add.at(count, at.astype(np.int64), 1)
            k = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array([-1] * k, pa.int32()), pa.nulls(k, pa.binary())], names)
        if any_row:
            for c in range(size // chunk):
                part = count[c * chunk : (c + 1) * chunk]
                if part.any():
                    blob = zlib.compress(part.tobytes(), 1)
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] + [pa.array([0], pa.int64())] * 3 + [pa.array([c], pa.int32()), pa.array([blob], pa.binary())], names)

    names = ["doc_id", "n", "d1", "d2", "chunk", "counts"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, chunk int, counts binary")


def frequencies(sketch: DataFrame, s: Settings) -> np.ndarray:
    """The sketch's counters over all tasks on a logarithmic scale, a byte each."""
    size, chunk = 1 << s.sketch_bits, 1 << min(16, s.sketch_bits)

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for c, blob in zip(b.column("chunk").to_pylist(), b.column("counts"), strict=True):
                part = np.frombuffer(zlib.decompress(blob.as_buffer()), np.uint32)
                total[c] = total[c] + part if c in total else part.astype(np.float64)
        for c, x in total.items():
            q = np.minimum(255, 6 * np.log2(1 + x)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([q.tobytes()], pa.binary())], ["chunk", "q"])

    out = np.zeros(size, np.uint8)
    for r in sketch.select("chunk", "counts").repartition(min(64, size // chunk), "chunk").mapInArrow(run, "chunk int, q binary").collect():  # `size` bytes in all
        out[r["chunk"] * chunk : (r["chunk"] + 1) * chunk] = np.frombuffer(r["q"], np.uint8)
    return out


def prefixes(docs: DataFrame, rank, s: Settings) -> DataFrame:
    """doc_id, n, d1, d2, the first shingles in the global order and parity bits of each row with shingles."""

    def run(batches):
        q = np.frombuffer(rank.value, np.uint8)
        mask, shingles = np.uint64(len(q) - 1), Shingles(s)
        for b in texts(batches):
            rows = []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                h = shingles(t.as_py())
                n = len(h)
                if n:
                    first = h[np.lexsort((h, q[h & mask]))[: s.prefix(n)]]
                    width = 1 << min(16, max(6, (n - 1).bit_length()))
                    bits = np.packbits(np.bincount(((h >> np.uint64(20)) & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1)
                    x, y = _digest(h)
                    rows.append((i, n, x, y, first.view(np.int64), bits.tobytes()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            offsets = np.cumsum([0, *map(len, cols[4])]).astype(np.int32)
            flat = np.concatenate(cols[4]) if rows else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), lists, pa.array(cols[5], pa.binary())], ["doc_id", "n", "d1", "d2", "prefix", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, prefix array<long>, bits binary")


def region_edges(rows: DataFrame, s: Settings) -> DataFrame:
    """a, b, hot: pairs of a coarse region that pass the bounds; chains through regions that are large."""

    def pairs(tok, n, cid, place):
        """Runs of equal tokens, each complete."""
        out = []
        starts = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
        length = np.diff(np.r_[starts, len(tok)])
        run_of = np.repeat(np.arange(len(starts)), length)
        big = length[run_of] > s.region_pairs
        same = tok[1:] == tok[:-1]
        chain = np.flatnonzero(same & big[1:] & (s.den * n[:-1] >= s.num * n[1:]))
        if len(chain):
            out.append((cid[chain], cid[chain + 1], np.ones(len(chain), bool)))
        keep = np.flatnonzero(~big & (length[run_of] > 1))
        tok, n, cid, place, run_of = tok[keep], n[keep], cid[keep], place[keep], run_of[keep]
        for off in range(1, s.region_pairs):
            i = np.flatnonzero(run_of[off:] == run_of[:-off])
            if not len(i):
                break
            j = i + off
            ok = (s.den * n[i] >= s.num * n[j]) & (place[i] + place[j] <= s.most_different(n[i], n[j])) & (cid[i] != cid[j])
            if ok.any():
                out.append((cid[i[ok]], cid[j[ok]], np.zeros(int(ok.sum()), bool)))
        return out

    def run(batches):
        held, last = None, None  # rows of a token that may go on; the last row of a token whose region is large

        def emit(found):
            if not found:
                return None
            a, b, hot = (np.concatenate(x) for x in zip(*found, strict=True))
            a, b = np.minimum(a, b), np.maximum(a, b)
            u = np.unique(np.stack([a, b, hot.astype(np.int64)], axis=1), axis=0)
            u = u[u[:, 0] != u[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1]), pa.array(u[:, 2].astype(np.int32))], ["a", "b", "hot"])

        for b in batches:
            now = _arrays(b, "token", "n", "cid", "place")
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            found = []
            if last is not None and now[0][0] == last[0]:  # goes on with a chain
                m = int(np.searchsorted(now[0] != last[0], True))
                n, cid = np.r_[last[1], now[1][:m]], np.r_[last[2], now[2][:m]]
                i = np.flatnonzero(s.den * n[:-1] >= s.num * n[1:])
                found.append((cid[i], cid[i + 1], np.ones(len(i), bool)))
                last = (last[0], n[-1], cid[-1])
                now = [x[m:] for x in now]
            if len(now[0]):
                last = None
                cut = int(np.flatnonzero(now[0] != now[0][-1])[-1]) + 1 if now[0][0] != now[0][-1] else 0
                if cut:
                    found += pairs(*(x[:cut] for x in now))
                held = [x[cut:] for x in now]
                if len(held[0]) > s.region_pairs:
                    found += pairs(*held)
                    last, held = (held[0][-1], held[1][-1], held[2][-1]), None
            else:
                held = None
            if (out := emit(found)) is not None:
                yield out
        if held is not None and len(held[0]) and (out := emit(pairs(*held))) is not None:
            yield out

    flat = rows.select("cid", "n", F.posexplode("prefix").alias("place", "token"))
    flat = flat.select("token", "n", "cid", F.col("place").cast("long").alias("place")).repartition("token").sortWithinPartitions("token", "n", "cid")
    return flat.mapInArrow(run, "a long, b long, hot int")


def parity_filter(edges: DataFrame, rows: DataFrame, s: Settings) -> DataFrame:
    """Edges whose parity bits don't differ in more places than linked sets can."""

    def run(batches):
        for b in batches:
            keep = []
            for na, nb, x, y in zip(*(b.column(c).to_pylist() for c in ("na", "nb", "xa", "xb")), strict=True):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                if len(x) < len(y):
                    x, y = y, x
                while len(x) > len(y):
                    # a hash modulo a power of two, modulo half of it, is at the same place of either half
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                keep.append(_popcount(x ^ y) <= s.most_different(na, nb))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    bits = rows.select("cid", "n", "bits")
    x = edges.join(bits.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa")), "a")
    x = x.join(bits.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb")), "b")
    return x.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, "a long, b long")


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root[root] != root).any():
            root = root[root]
        if (before == root).all():
            return nodes, nodes[root]


def _contract(edges: DataFrame) -> DataFrame:
    """Per partition, a star of each component in place of its edges."""

    def run(batches):
        found = [_arrays(b, "a", "b") for b in batches]
        if found:
            nodes, root = _roots(*(np.concatenate(x) for x in zip(*found, strict=True)))
            keep = nodes != root
            yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(root[keep])], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, s: Settings) -> DataFrame:
    """node, root (the smallest node of its component) of every node with an edge: large and small stars in turn."""
    edges = settle(_contract(edges).distinct())
    n = edges.count()
    while n > s.local_edges:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select("u", "m")).where("a <> b").distinct()
        new = settle(small)
        k, same = new.count(), new.join(edges, ["a", "b"], "left_anti").isEmpty()
        edges, done = new, same and k == n
        n = k
        if done:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())

    def run(batches):
        found = [_arrays(b, "a", "b") for b in batches]
        if found:
            nodes, root = _roots(*(np.concatenate(x) for x in zip(*found, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], ["node", "root"])

    return edges.coalesce(1).mapInArrow(run, "node long, root long")


class Cluster:
    """Sets of one cluster; finds links enough to connect what is linked."""

    def __init__(self, sets: list[np.ndarray], s: Settings, label: np.ndarray | None = None):
        self.s, self.sets = s, sets
        self.n = np.array([len(x) for x in sets])
        self.label = np.arange(len(sets)) if label is None else label

    def union(self, i: int, j: int) -> None:
        a, b = self.label[i], self.label[j]
        if a != b:
            self.label[self.label == max(a, b)] = min(a, b)

    def distances(self, at: np.ndarray, p: int) -> np.ndarray:
        """Exact sizes of intersections of the sets `at` with set p."""
        flat = np.concatenate([self.sets[i] for i in at])
        pivot = self.sets[p]
        place = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
        hit = pivot[place] == flat
        return np.add.reduceat(hit, np.r_[0, np.cumsum(self.n[at])[:-1]], dtype=np.int64)

    def join(self, at: np.ndarray, depth: int = 0) -> None:
        s, m = self.s, len(at)
        if m < 2 or (self.label[at] == self.label[at[0]]).all():
            return
        if m <= 4:
            return self.pairs(at, np.zeros((m, 0)))
        k = min(s.pivots, m)
        pivots = at[np.random.default_rng(m + depth).choice(m, k, replace=False)]
        d = np.empty((m, k))
        for c, p in enumerate(pivots):
            both = self.distances(at, p)
            d[:, c] = 1 - both / (self.n[at] + self.n[p] - both)
            for i in at[s.linked(both, self.n[at], self.n[p])]:
                self.union(i, p)
        if depth < 12 and m > 64:
            home = d.argmin(axis=1)
            inside = d <= d.min(axis=1)[:, None] + 2 * s.r + 1e-9
            inside[np.arange(m), home] = True
            sizes = inside.sum(axis=0)
            if sizes.max() <= 0.7 * m:
                for c in range(k):
                    self.join(at[inside[:, c]], depth + 1)
                return
        self.pairs(at, d)

    def pairs(self, at: np.ndarray, d: np.ndarray) -> None:
        """Pairs that the pivots' distances and the sizes allow, but for those that are connected."""
        s = self.s
        for i in range(len(at) - 1):
            p = at[i]
            rest = np.arange(i + 1, len(at))
            n = self.n[at[rest]]
            ok = (self.label[at[rest]] != self.label[p]) & (s.den * np.minimum(n, self.n[p]) >= s.num * np.maximum(n, self.n[p]))
            rest = rest[ok]
            if d.shape[1] and len(rest):
                rest = rest[(np.abs(d[rest] - d[i]) <= s.r + 1e-9).all(axis=1)]
            while len(rest):
                some, rest = rest[:32], rest[32:]
                both = self.distances(at[some], p)
                for j in at[some[s.linked(both, self.n[at[some]], self.n[p])]]:
                    self.union(p, j)
                rest = rest[self.label[at[rest]] != self.label[p]]


def _sets_of(docs: DataFrame, wanted: DataFrame, n_wanted: int, s: Settings) -> DataFrame:
    """cluster, cid, n, set of the classes in `wanted` (doc_id, d1, d2, cid, cluster), each from a row of docs that has it."""

    def run(batches):
        shingles = Shingles(s)
        for b in texts(batches):
            keep, blobs, n = [], [], []
            for t, d1, d2 in zip(b.column("text"), b.column("d1").to_pylist(), b.column("d2").to_pylist(), strict=True):
                h = shingles(t.as_py())
                keep.append(_digest(h) == (d1, d2))
                blobs.append(h.tobytes())
                n.append(len(h))
            yield pa.RecordBatch.from_arrays([b.column("cluster"), b.column("cid"), pa.array(n, pa.int64()), pa.array(blobs, pa.binary())], ["cluster", "cid", "n", "set"]).filter(pa.array(keep, pa.bool_()))

    ids = wanted.withColumnRenamed("doc_id", "__doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    met = join_sized(rows, ids, rows["doc_id"].eqNullSafe(ids["__doc_id"]), rows=n_wanted)
    return met.select("cluster", "cid", "d1", "d2", "text").mapInArrow(run, "cluster long, cid long, n long, set binary")


def _links_in_clusters(sets: DataFrame, s: Settings) -> DataFrame:
    """a, b: a star for each component inside clusters that fit in a task."""

    def run(batches):
        def done(ids, blobs):
            ids, first = np.unique(np.array(ids), return_index=True)  # a repeated row has its class once
            if len(ids) < 2:
                return
            c = Cluster([np.frombuffer(blobs[i], np.uint64) for i in first], s)
            c.join(np.arange(len(ids)))
            keep = c.label != np.arange(len(ids))
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(ids[c.label[keep]])], ["a", "b"])

        now, ids, blobs = None, [], []
        for b in batches:
            for cluster, cid, blob in zip(b.column("cluster").to_pylist(), b.column("cid").to_pylist(), b.column("set"), strict=True):
                if cluster != now:
                    yield from done(ids, blobs)
                    now, ids, blobs = cluster, [], []
                ids.append(cid)
                blobs.append(blob.as_py())
        yield from done(ids, blobs)

    return sets.select("cluster", "cid", "set").repartition("cluster").sortWithinPartitions("cluster").mapInArrow(run, "a long, b long")


def _links_over_tasks(sets: DataFrame, s: Settings) -> list[DataFrame]:
    """The same for clusters too large for a task: rounds of division by pivots, then pairs of blocks."""
    links = []
    sets = settle(sets.dropDuplicates(["cluster", "cid"]))
    sizes = lambda x: x.groupBy("cluster").agg(F.sum("n").alias("__size"))
    for turn in range(s.rounds):
        if sets.isEmpty():
            return links
        chosen = sets.groupBy("cluster").agg(F.min_by(F.struct("cid", "n", "set"), F.struct(F.xxhash64("cid", F.lit(turn)), F.col("cid"))).alias("p"), F.min_by(F.struct("cid", "n", "set"), F.struct(F.xxhash64("cid", F.lit(turn + 99)), F.col("cid"))).alias("q"))

        def run(batches):
            for b in batches:
                dp, dq, lp, lq = [], [], [], []
                for x, p, q in zip(b.column("set"), b.column("p"), b.column("q"), strict=True):
                    x = np.frombuffer(x.as_buffer(), np.uint64)
                    for pivot, d, link in ((p, dp, lp), (q, dq, lq)):
                        y = np.frombuffer(pivot["set"].as_buffer(), np.uint64)
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        d.append(1 - both / (len(x) + len(y) - both))
                        link.append(bool(s.linked(both, len(x), len(y))))
                more = [pa.array(dp, pa.float64()), pa.array(dq, pa.float64()), pa.array(lp, pa.bool_()), pa.array(lq, pa.bool_())]
                ids = [pa.array([v["cid"].as_py() for v in b.column(c)], pa.int64()) for c in ("p", "q")]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("cluster", "cid", "n", "set")), *ids, *more], ["cluster", "cid", "n", "set", "pid", "qid", "dp", "dq", "lp", "lq"])

        far = settle(sets.join(chosen, "cluster").mapInArrow(run, "cluster long, cid long, n long, set binary, pid long, qid long, dp double, dq double, lp boolean, lq boolean"))
        links.append(far.where("lp and cid <> pid").select(F.col("cid").alias("a"), F.col("pid").alias("b")))
        links.append(far.where("lq and cid <> qid").select(F.col("cid").alias("a"), F.col("qid").alias("b")))
        # what is linked with p meets only what isn't and is near enough; pivots have met all
        outer = far.where("not lp").groupBy("cluster").agg(F.min("dp").alias("__near"))
        left = far.join(outer, "cluster").where(f"cid <> pid and cid <> qid and (not lp or dp >= __near - {s.r + 1e-9})")
        cells = F.filter(F.array(F.when(F.col("dp") <= F.col("dq") + 2 * s.r + 1e-9, F.lit(0)), F.when(F.col("dq") <= F.col("dp") + 2 * s.r + 1e-9, F.lit(1))), lambda x: x.isNotNull())
        left = left.withColumn("__cell", F.explode(cells))
        left = settle(left.select(F.xxhash64("cluster", "__cell", F.lit(turn)).alias("cluster"), "cid", "n", "set"))
        size = settle(sizes(left))
        fits = left.join(size.where(F.col("__size") <= s.cluster_shingles), "cluster", "left_semi")
        links.append(_links_in_clusters(fits, s))
        sets = settle(left.join(size.where(F.col("__size") > s.cluster_shingles), "cluster", "left_semi"))
    # blocks of a cluster, each pair of blocks once
    blocks = sizes(sets).select("cluster", F.ceil(F.col("__size") * 2 / s.cluster_shingles).cast("int").alias("__n"))
    dealt = sets.join(blocks, "cluster").withColumn("__x", F.pmod(F.xxhash64("cid", F.lit(5)), F.col("__n")).cast("int"))
    dealt = dealt.withColumn("__y", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    pair = F.xxhash64("cluster", F.least("__x", "__y"), F.greatest("__x", "__y"))
    links.append(_links_in_clusters(dealt.select(pair.alias("cluster"), "cid", "set"), s))
    return links


def components_of(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id and the class digest (d1, d2) of every row of docs."""
    return _with_first(docs, settings).drop("k1", "k2")


def _with_first(docs: DataFrame, settings: Settings) -> DataFrame:
    """The same, and k1, k2: the class digest of the component's first row; null if a row is linked with nothing."""
    s, spark = settings, docs.sparkSession
    scanned = settle(signatures(docs, s))
    sigs = scanned.where("chunk < 0").select("doc_id", "n", "d1", "d2")
    rank = spark.sparkContext.broadcast(frequencies(scanned.where("chunk >= 0"), s).tobytes())
    classes = settle(sigs.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")))
    classes = settle(classes.withColumn("cid", F.monotonically_increasing_id()))

    rows = prefixes(docs, rank, s).alias("p")
    c = classes.alias("c")
    same = F.col("p.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("p.d1") == F.col("c.d1")) & (F.col("p.d2") == F.col("c.d2"))
    rows = settle(rows.join(c, same).select("cid", "p.n", "prefix", "bits"))
    edges = settle(region_edges(rows, s).groupBy("a", "b").agg(F.max("hot").alias("hot")))
    near = parity_filter(edges.where("hot = 0"), rows, s).union(edges.where("hot = 1").select("a", "b"))

    cluster = settle(components(near, s).join(classes, F.col("node") == F.col("cid")).select("doc_id", "d1", "d2", "cid", F.col("root").alias("cluster")))
    n_wanted = cluster.count()
    sets = settle(_sets_of(docs, cluster, n_wanted, s))
    size = settle(sets.groupBy("cluster").agg(F.sum("n").alias("__size")))
    large = size.where(F.col("__size") > s.cluster_shingles)
    if large.isEmpty():
        links = [_links_in_clusters(sets, s)]
    else:
        links = [_links_in_clusters(sets.join(large, "cluster", "left_anti"), s), *_links_over_tasks(sets.join(large, "cluster", "left_semi"), s)]
    found = links[0]
    for x in links[1:]:
        found = found.union(x)

    root = components(found, s)
    named = root.join(classes, F.col("node") == F.col("cid")).select("cid", "root", "doc_id", "d1", "d2")
    # a component's first row has its smallest doc_id, null only if all are; of such rows, the smallest digest
    least = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "d1", "d2")).alias("first"))
    linked = named.join(least, "root").select("cid", "first")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "d1", "d2")
    of_class = classes.join(linked, "cid", "left").where("first is not null or copies > 1").select("d1", "d2", F.coalesce("first", own).alias("first"))
    of_class = settle(of_class.select("d1", "d2", F.col("first.doc_id").alias("component_id"), F.col("first.d1").alias("k1"), F.col("first.d2").alias("k2")))
    out = join_sized(sigs, of_class, ["d1", "d2"], "left")
    own = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "d1", "d2", "k1", "k2")


def _digests(docs: DataFrame, s: Settings) -> DataFrame:
    """The rows of docs with the class digest of their text, __d1 and __d2."""

    def run(batches):
        shingles = Shingles(s)
        for b in texts(batches):
            found = [_digest(shingles(t.as_py())) for t in b.column("text")]
            more = [pa.array([d[k] for d in found], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "__d1", "__d2"])

    schema = StructType([*docs.schema.fields, StructField("__d1", LongType()), StructField("__d2", LongType())])
    return docs.mapInArrow(run, schema)


def one_of_each(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs, columns as they are: of each component one row, of the smallest doc_id; all rows linked with nothing."""
    return unpacked(_one_of_each(packed(docs, "doc_id", "text"), settings))


def _one_of_each(docs: DataFrame, settings: Settings) -> DataFrame:
    """The same for columns whose names are known.

    A row is known by its doc_id and the digest of its text. Where an id has one row, or all of its rows stay or go, the
    id alone decides; other rows, and those without id, are met by both.
    """
    first = F.expr("doc_id <=> component_id and d1 = k1 and d2 = k2")
    found = settle(_with_first(docs, settings).select("doc_id", "d1", "d2", F.col("k1").isNotNull().alias("linked"), F.coalesce(first, F.lit(False)).alias("first")))
    stays = F.expr("not linked or first")
    per = settle(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("linked").alias("linked"), F.count_if(stays).alias("stay")).where("linked > 0 and not (n = 1 and stay = 1)"))
    gone, both = per.where("stay = 0").select("doc_id"), settle(per.where("stay > 0").select("doc_id"))
    no_id = not found.where("doc_id is null and linked").isEmpty()
    n_both = both.count()

    def met(rows: DataFrame, ids: DataFrame, how: str, n: int | None = None) -> DataFrame:
        ids = ids.withColumnRenamed("doc_id", "__doc_id")
        return join_sized(rows, ids, rows["doc_id"].cast("long") == ids["__doc_id"], how, rows=n)

    kept = met(docs, settle(gone), "left_anti")
    if not n_both and not no_id:
        return kept
    null = F.col("doc_id").cast("long").isNull()
    fate = found.where("linked")
    unclear = docs.limit(0)
    fates = fate.limit(0)
    if n_both:
        unclear, fates = met(docs, both, "left_semi", n_both), met(fate, both, "left_semi", n_both)
        kept = met(kept, both, "left_anti", n_both)
    if no_id:
        unclear, fates = unclear.unionByName(docs.where(null)), fates.unionByName(fate.where("doc_id is null"))
        kept = kept.where(~null)
    fates = settle(fates.select(F.col("doc_id").alias("__id"), F.col("d1").alias("__f1"), F.col("d2").alias("__f2"), F.col("first").alias("__first")).distinct())
    rows = _digests(unclear, settings)
    on = rows["doc_id"].cast("long").eqNullSafe(fates["__id"]) & (rows["__d1"] == fates["__f1"]) & (rows["__d2"] == fates["__f2"])
    rows = join_sized(rows, fates, on, "left")
    one = rows.where("__first").dropDuplicates(["__id", "__f1", "__f2"])
    return kept.unionByName(rows.where("__first is null").select(*docs.columns)).unionByName(one.select(*docs.columns))
