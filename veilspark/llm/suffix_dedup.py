"""Removal of repeated byte strings with suffix arrays by linear grouping.

`suffix_array` sorts suffixes in two passes over groups and never renames or recurses. The first pass takes the groups
from the last to the first and refines those before: a suffix is led by its previous-smaller pointer to the suffix
whose Lyndon prefix it continues, and those with the same group and as many continuations become a group of their own.
In the end each group has the suffixes of one Lyndon prefix. The second pass emits suffixes in ascending order: when a
suffix is emitted, those whose Lyndon prefix ends where it begins take the next places of their groups.

A string of `length` bytes has, by the smallest hash of its k-mers, an anchor that only depends on its bytes, so equal
strings meet at equal anchors. A first scan marks the anchors of all texts in a sketch of fixed size, a second one cuts
every whole text into tiles, the runs of strings with one anchor, and ships those whose anchor more than one document
may have. Tiles of equal bytes are one string to sort, whose first document is kept by a minimum in each task before
the shuffle and after it. Where different tiles share an anchor and half a string beside it, their strings may be equal
in part: these tiles' bytes are fetched and dealt by the anchor with that half; each group is sorted by the suffix
array, and each class of equal strings gives its smallest doc_id to all of its members. A group of more than
`group_rows` tiles, as one short passage that a large share of all documents holds makes, is taken apart into its
strings, whose bytes are then the key of an aggregation, so no task holds such a group. Texts are shuffled only if they
may lose bytes.

Defined results: a null text counts as empty; texts shorter than the length keep all bytes; the same document's own
repeats stay; rows of an equal doc_id don't remove each other's bytes, and a row without doc_id neither loses bytes nor
makes others lose any. Rows repeat as they come; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import free, marked_twice, settle, slot_batches, texts


def suffix_array(s: list[int] | bytes) -> list[int]:
    """Start positions of the suffixes in ascending order; a suffix that another one begins with comes first."""
    n = len(s)
    if not n:
        return []
    # groups are runs of `order`, named by their first place; at the start by first symbol
    order = sorted(range(n), key=s.__getitem__)
    group, stop = [0] * n, [0] * n
    first = 0
    for at in range(1, n + 1):
        if at == n or s[order[at]] != s[order[first]]:
            for i in order[first:at]:
                group[i] = first
            stop[first] = at
            first = at
    place = [0] * n
    for at, i in enumerate(order):
        place[i] = at
    prev = [-1] * n
    high = n
    while high:
        low = group[order[high - 1]]
        times: dict[int, int] = {}
        for i in sorted(order[low:high]) if high - low > 1 else (order[low],):
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if len(times) == 1:
            (p,) = times
            led = [(group[p], 1, p)]
        else:
            led = sorted((group[p], t, p) for p, t in times.items())
        k = 0
        while k < len(led):
            g = led[k][0]
            m = k
            while m < len(led) and led[m][0] == g:
                m += 1
            end = stop[g]
            start = end - (m - k)
            # the led ones go to the end of their group, by ascending number of continuations
            for x in range(m - 1, k - 1, -1):
                end -= 1
                p, q, at = led[x][2], order[end], place[led[x][2]]
                order[at], place[q] = q, at
                order[end], place[p] = p, end
            end = stop[g]
            if start > g:
                stop[g] = start
            x, name = k, start
            while x < m:
                y = x
                while y < m and led[y][1] == led[x][1]:
                    group[led[y][2]] = name
                    y += 1
                stop[name] = name + y - x
                name, x = stop[name], y
            k = m
        high = low
    free = list(range(n))  # next place of the group of this name
    out = [0] * n
    at, j, last = 0, n - 1, -1
    while True:
        while j != last:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            j = prev[j]
        if at == n:
            return out
        j, last = out[at] - 1, prev[out[at]]
        at += 1


@dataclass(frozen=True)
class Settings:
    length: int = 50
    kmer: int = 16  # two words of eight bytes
    #: Tiles that a task gathers before it ships the first documents of each.
    gathered: int = 200_000
    #: Bytes of text scanned at once.
    slice_bytes: int = 1 << 20
    #: Bytes of one suffix array, unless one anchor's tiles are more.
    sorted_bytes: int = 1 << 16
    #: Bits of the sketch of repeated anchors, and of that of documents that lose bytes, as a power of two.
    sketch_bits: int = 27
    #: Different tiles that share an anchor and half a string; more are taken apart into strings.
    group_rows: int = 20_000

    @property
    def window(self) -> int:
        return self.length - self.kmer + 1

    @property
    def half(self) -> int:
        """Of a string, so many bytes stand on one side of its anchor at least."""
        return (self.length - self.kmer) // 2


_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_ROW = np.dtype([("h", "<u8"), ("ctx", "<u8"), ("doc", "<u2"), ("pos", "<u4"), ("len", "u1"), ("at", "u1"), ("left", "u1"), ("right", "u1")])
_ASK = np.dtype([("pos", "<u4"), ("len", "u1"), ("at", "u1"), ("sides", "u1")])
_SPAN = np.dtype([("s", "<u4"), ("e", "<u4")])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))


class Scanner:
    """Tiles of texts: anchor hash, hash of the tile's bytes, places, and hashes of what stands beside the anchor."""

    def __init__(self, s: Settings):
        self.s = s
        n = s.slice_bytes + (1 << 16)
        self.power, self.back = np.ones(n + 1, _U), np.ones(n + 1, _U)
        self.power[1:], self.back[1:] = _BASE, _INVERSE
        np.multiply.accumulate(self.power, out=self.power)
        np.multiply.accumulate(self.back, out=self.back)
        self.value = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64)

    def anchors(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each tile its document, anchor place, anchor hash, first string and last string; none crosses an end."""
        s, none = self.s, tuple(np.zeros(0, t) for t in (np.int64, np.int64, _U, np.int64, np.int64))
        x = np.frombuffer(data, np.uint8)
        if len(x) < s.length:
            return none
        w = x.astype(_U)
        for shift in (1, 2, 4):
            w = w[:-shift] | (w[shift:] << _U(8 * shift))
        h = _mix(w[:-8] * _U(0xC2B2AE3D27D4EB4F) ^ _mix(w[8:] * _U(0x165667B19E3779F9)))
        key = (h & ~_U(0xFFFFFF)) | np.arange(len(h), dtype=_U)  # smallest hash, then leftmost
        m, done = key, 1
        while done * 2 <= s.window:
            m = np.minimum(m[:-done], m[done:])
            done *= 2
        if s.window > done:
            m = np.minimum(m[: len(m) - (s.window - done)], m[s.window - done :])
        anchor = (m & _U(0xFFFFFF)).astype(np.int64)
        starts = np.r_[0, ends[:-1]]
        p = np.arange(len(anchor))
        doc = np.repeat(np.arange(len(ends)), ends - starts)[: len(anchor)]
        ok = p + s.length <= ends[doc]
        p, anchor, doc = p[ok], anchor[ok], doc[ok]
        if not len(p):
            return none
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
        return doc[new], anchor[new], h[anchor[new]], p[new], p[np.r_[new[1:], len(p)] - 1]

    def __call__(self, data: bytes, ends: np.ndarray, wanted=None) -> np.ndarray:
        """data: texts in a row; ends: where each ends; wanted: which anchor hashes matter. Rows with places in the texts."""
        s = self.s
        d, a, h, p0, p1 = self.anchors(data, ends)
        if wanted is not None and len(d):
            keep = wanted(h)
            d, a, h, p0, p1 = d[keep], a[keep], h[keep], p0[keep], p1[keep]
        if not len(d):
            return np.zeros(0, _ROW)
        x, size, starts = np.frombuffer(data, np.uint8), len(data), np.r_[0, ends[:-1]]
        total = np.r_[_U(0), np.cumsum(self.value[x] * self.power[:size])]

        def of(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            return _mix((total[hi] - total[lo]) * self.back[lo] + (hi - lo).astype(_U))

        out = np.zeros(len(d), _ROW)
        out["h"] = h
        out["ctx"] = _mix(of(p0, p1 + s.length) + (a - p0).astype(_U) * _BASE)  # all 64 bits: tiles of one anchor have the same h
        out["doc"], out["pos"], out["len"], out["at"] = d, p0 - starts[d], p1 - p0 + 1, a - p0
        hi, lo = a + s.kmer + s.half, a - s.half
        right, left = hi <= p1 + s.length, lo >= p0  # of any string, so much stands on one side of its anchor at least
        out["right"][right] = (of(a[right] + s.kmer, hi[right]) >> _U(40)).astype(np.uint8) % 255 + 1
        out["left"][left] = (of(lo[left], a[left]) >> _U(40)).astype(np.uint8) % 255 + 1
        return out


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (_mix(h * _BASE + _U(1)) >> _U(64 - bits)).astype(np.int64)


def _is_marked(marks: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (marks[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def repeated_anchors(docs: DataFrame, s: Settings):
    """A broadcast sketch of the anchors that more than one text may have."""

    def run(batches):
        scan, held, n = Scanner(s), [], 0
        for b in texts(batches, most=s.slice_bytes // 2):
            raw = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in b.column("text")]
            for data, ends, _, _ in _slices(raw, s):
                doc, _, h, _, _ = scan.anchors(data, ends)
                # an anchor's slots once for each text
                held.append(np.unique((doc << s.sketch_bits) | _slots(h, s.sketch_bits)) & ((1 << s.sketch_bits) - 1))
                n += len(held[-1])
                if n >= 1 << 21:
                    yield from slot_batches(np.concatenate(held), s.sketch_bits)
                    held, n = [], 0
        if n:
            yield from slot_batches(np.concatenate(held), s.sketch_bits)

    return marked_twice(docs.select("text").mapInArrow(run, "chunk int, slots binary"), s.sketch_bits)


def _first_of_run(*keys: np.ndarray) -> np.ndarray:
    """For rows sorted by the keys, the place of the first row of each row's run."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _rows_by_doc(kind: int, doc: np.ndarray, ids: np.ndarray, keys: np.ndarray, data: np.ndarray):
    """An Arrow batch with one row for each doc: its id, its text's hash and its part of data."""
    order = np.argsort(doc, kind="stable")
    doc, data = doc[order], data[order]
    at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    parts = [data[a:b].tobytes() for a, b in zip(at, np.r_[at[1:], len(doc)], strict=True)]
    one = doc[at]
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(at), pa.int32()), pa.array(ids[one], pa.int64()), pa.array(keys[one], pa.int64()), pa.array(parts, pa.binary())], ["kind", "doc_id", "key", "data"])


def _spans(pos: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(pos), _SPAN)
    out["s"], out["e"] = pos, pos + count - 1 + length
    return out


def _tiles(docs: DataFrame, parts: int, marks, s: Settings) -> DataFrame:
    """part and blob: tiles by hash of their anchor, and spans that a task's own documents settle (part < 0)."""

    def run(batches):
        scan, seen = Scanner(s), np.frombuffer(marks.value, np.uint8)
        held, ids, keys, n = [], [], [], 0

        def flush():
            nonlocal held, ids, keys, n
            if not held:
                return
            rows, doc_ids, doc_keys = np.concatenate(held), np.array(ids, np.int64), np.array(keys, np.int64)
            held, ids, keys, n = [], [], [], 0
            doc = doc_ids[rows["doc"]]
            rows = rows[np.lexsort((rows["doc"], doc, rows["ctx"], rows["h"]))]
            doc = doc_ids[rows["doc"]]
            first = _first_of_run(rows["h"], rows["ctx"])
            later = doc > doc[first]
            if later.any():
                x = _rows_by_doc(0, rows["doc"][later].astype(np.int64), doc_ids, doc_keys, _spans(rows["pos"][later], rows["len"][later].astype(np.int64), s.length))
                yield pa.RecordBatch.from_arrays([pa.array(-1 - np.arange(x.num_rows, dtype=np.int32) % parts), x.column("doc_id"), x.column("key"), x.column("data")], names)
            rows = rows[~later]
            # h is the smallest of a window, so its own ranges would be far from even
            part = ((_mix(rows["h"] * _BASE) >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            rows, part = rows[order], part[order]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            table = np.stack([doc_ids, doc_keys], axis=1)
            blobs = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                some = rows[a:b].copy()
                used, some["doc"] = np.unique(some["doc"], return_inverse=True)
                blobs.append(len(used).to_bytes(4, "little") + table[used].tobytes() + some.tobytes() if b > a else None)
            has = [i for i, x in enumerate(blobs) if x]
            yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.nulls(len(has), pa.int64()), pa.nulls(len(has), pa.int64()), pa.array([blobs[i] for i in has], pa.binary())], names)

        for b in texts(batches, most=s.slice_bytes // 2):
            id_col, key_col = b.column("doc_id").to_pylist(), b.column("key").to_pylist()
            raw = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in b.column("text")]
            for data, ends, owner, offset in _slices(raw, s):
                found = scan(data, ends, lambda h: _is_marked(seen, _slots(h, s.sketch_bits)))
                if not len(found):
                    continue
                used, found["doc"] = np.unique(found["doc"], return_inverse=True)
                found["pos"] += np.array(offset, np.uint32)[used][found["doc"]]
                base = len(ids)
                if base + len(used) > 65_535:
                    yield from flush()
                    base = 0
                found["doc"] += np.uint16(base)
                ids.extend(id_col[owner[i]] for i in used)
                keys.extend(key_col[owner[i]] for i in used)
                held.append(found)
                n += len(found)
                if n >= s.gathered:
                    yield from flush()
        yield from flush()

    names = ["part", "doc_id", "key", "data"]
    return docs.mapInArrow(run, "part int, doc_id long, key long, data binary")


def _slices(raw: list[bytes], s: Settings):
    """Texts joined up to the slice's size; a longer one is cut into pieces that overlap so that no string is lost."""
    data, ends, owner, offset, size = [], [], [], [], 0
    for i, t in enumerate(raw):
        step = s.slice_bytes - s.length
        pieces = [(t, 0)] if len(t) <= s.slice_bytes else [(t[a : a + step + s.length - 1], a) for a in range(0, max(1, len(t) - s.length + 1), step)]
        for piece, at in pieces:
            if size + len(piece) > s.slice_bytes and data:
                yield b"".join(data), np.array(ends), owner, offset
                data, ends, owner, offset, size = [], [], [], [], 0
            size += len(piece)
            data.append(piece)
            ends.append(size)
            owner.append(i)
            offset.append(at)
    if data:
        yield b"".join(data), np.array(ends), owner, offset


def _settled_tiles(tiles: DataFrame, parts: int, s: Settings) -> DataFrame:
    """kind 0: spans of documents that have a tile after another one; 1: tiles whose bytes must be sorted; 2: those of large groups."""

    def run(batches):
        found, table, base = [], [], 0
        for b in batches:
            own = []
            for i, part in enumerate(b.column("part").to_pylist()):
                if part < 0:
                    own.append(i)
                    continue
                blob = b.column("data")[i].as_py()
                k = int.from_bytes(blob[:4], "little")
                table.append(np.frombuffer(blob, np.int64, 2 * k, 4).reshape(k, 2))
                rows = np.frombuffer(blob, _ROW, offset=4 + 16 * k)
                found.append((rows, rows["doc"].astype(np.int64) + base))
                base += k
            if own:
                x = b.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([pa.array([0] * x.num_rows, pa.int32()), x.column("doc_id"), x.column("key"), x.column("data")], names)
        if not found:
            return
        rows, doc = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        del found
        ids, keys = np.concatenate(table).T.copy()
        del table
        order = np.lexsort((ids[doc], rows["ctx"], rows["h"]))
        rows, doc = rows[order], doc[order]
        who = ids[doc]
        first = _first_of_run(rows["h"], rows["ctx"])
        later = who > who[first]
        if later.any():
            yield _rows_by_doc(0, doc[later], ids, keys, _spans(rows["pos"][later], rows["len"][later].astype(np.int64), s.length))
        rows, doc, who = rows[~later], doc[~later], who[~later]
        ask, hot = np.zeros(len(rows), np.uint8), np.zeros(len(rows), np.uint8)
        for bit, side in enumerate(("left", "right")):
            order = np.lexsort((rows["ctx"], rows[side], rows["h"]))
            h, f, c, w = rows["h"][order], rows[side][order], rows["ctx"][order], who[order]
            run_of = _first_of_run(h, f)
            last = np.r_[np.flatnonzero(run_of[1:] != run_of[:-1]), len(run_of) - 1] if len(run_of) else np.zeros(0, int)
            differs = np.zeros(len(h) + 1, bool)
            # a run with more than one tile, of more than one document
            starts = run_of[last] if len(last) else last
            if len(starts):
                many = (c[starts] != c[last]) & (np.minimum.reduceat(w, starts) != np.maximum.reduceat(w, starts))
                differs[: len(h)] = np.repeat(many, last - starts + 1)
            size = np.repeat(last - starts + 1, last - starts + 1)
            mine = (differs[: len(h)] & (f > 0)).astype(np.uint8) << bit
            ask[order] |= np.where(size <= s.group_rows, mine, 0).astype(np.uint8)
            hot[order] |= np.where(size > s.group_rows, mine, 0).astype(np.uint8)
        for kind, sides in ((1, ask), (2, hot)):
            asked = sides > 0
            if asked.any():
                data = np.zeros(int(asked.sum()), _ASK)
                for n in ("pos", "len", "at"):
                    data[n] = rows[n][asked]
                data["sides"] = sides[asked]
                yield _rows_by_doc(kind, doc[asked], ids, keys, data)

    names = ["kind", "doc_id", "key", "data"]
    return tiles.repartitionById(parts, F.pmod("part", F.lit(parts))).mapInArrow(run, "kind int, doc_id long, key long, data binary")


def _doc_slots(ids: pa.Array, keys: pa.Array, s: Settings) -> np.ndarray:
    i, k = (np.array(pa.compute.fill_null(x, 0).to_numpy(zero_copy_only=False), np.int64).view(_U) for x in (ids, keys))
    return _slots(_mix(i * _BASE) ^ k, s.sketch_bits)


def _marked_docs(per: DataFrame, s: Settings):
    """A broadcast sketch of the rows of per (doc_id, key)."""

    def run(batches):
        for b in batches:
            x = _doc_slots(b.column("doc_id"), b.column("key"), s)
            yield from slot_batches(np.repeat(x, 2), s.sketch_bits)

    return marked_twice(per.select("doc_id", "key").mapInArrow(run, "chunk int, slots binary"), s.sketch_bits)


def _may_have(docs: DataFrame, marks, s: Settings) -> DataFrame:
    """doc_id, key and text of the rows that the sketch holds."""

    def run(batches):
        seen = np.frombuffer(marks.value, np.uint8)
        for b in batches:
            keep = _is_marked(seen, _doc_slots(b.column("doc_id"), b.column("key"), s)) & b.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(keep))

    return docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key long, text string")


def _tile_bytes(docs: DataFrame, asked: DataFrame, s: Settings) -> DataFrame:
    """g (hash of an anchor with half a string on one side of it), doc_id, key, pos and bytes of the tiles asked for."""
    per = settle(asked.groupBy("doc_id", "key").agg(F.collect_list("data").alias("data")))

    def run(batches):
        for b in texts(batches):
            g, doc, key, pos, blob = [], [], [], [], []
            for i, k, t, data in zip(b.column("doc_id").to_pylist(), b.column("key").to_pylist(), b.column("text"), b.column("data").to_pylist(), strict=True):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                for at, n, anchor, sides in np.frombuffer(b"".join(data), _ASK).tolist():
                    tile, a = raw[at : at + n - 1 + s.length], at + anchor
                    for bit, shared in ((1, raw[a - s.half : a + s.kmer]), (2, raw[a : a + s.kmer + s.half])):
                        if sides & bit:
                            g.append(xxhash.xxh3_64_intdigest(shared, bit) - (1 << 63))
                            doc.append(i)
                            key.append(k)
                            pos.append(at)
                            blob.append(tile)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(pos, pa.int64()), pa.array(blob, pa.binary())], ["g", "doc_id", "key", "pos", "tile"])

    met = _may_have(docs, _marked_docs(per, s), s).join(per, ["doc_id", "key"])
    return met.select("doc_id", "key", "text", "data").mapInArrow(run, "g long, doc_id long, key long, pos long, tile binary")


def _strings_alone(tiles: DataFrame, s: Settings) -> DataFrame:
    """Spans of the strings of tiles, each string's bytes the key of its smallest document."""

    def run(batches):
        for b in batches:
            doc, key, pos, string = [], [], [], []
            for i, k, p, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "key", "pos", "tile")), strict=True):
                for x in range(len(t) - s.length + 1):
                    doc.append(i)
                    key.append(k)
                    pos.append(p + x)
                    string.append(t[x : x + s.length])
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(pos, pa.int64()), pa.array(string, pa.binary())], ["doc_id", "key", "pos", "string"])

    def spans(batches):
        for b in batches:
            p = b.column("pos").to_numpy()
            x = [r.tobytes() for r in _spans(p, np.ones(len(p), np.int64), s.length)]
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(x), pa.int32()), b.column("doc_id"), b.column("key"), pa.array(x, pa.binary())], ["kind", "doc_id", "key", "data"])

    strings = tiles.select("doc_id", "key", "pos", "tile").mapInArrow(run, "doc_id long, key long, pos long, string binary")
    least = strings.groupBy("string").agg(F.min("doc_id").alias("least"))
    later = strings.join(least, "string").where("doc_id > least")
    return later.select("doc_id", "key", "pos").mapInArrow(spans, "kind int, doc_id long, key long, data binary")


def first_by_suffix_array(strings: list[bytes], doc: np.ndarray, length: int) -> list[np.ndarray]:
    """For every string the places of those of its substrings of `length` bytes that a string of a smaller doc has, too."""
    sizes = np.array([len(x) for x in strings])
    flat = np.frombuffer(b"".join(strings), np.uint8)
    joined: list[int] = []
    for x in strings:
        joined.extend(c + 1 for c in x)
        joined.append(0)
    begin = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    sa = np.array(suffix_array(joined))
    owner = np.searchsorted(begin, sa, side="right") - 1
    place = sa - begin[owner]
    ok = place + length <= sizes[owner]
    owner, place = owner[ok], place[ok]
    if not len(owner):
        return [np.zeros(0, np.int64) for _ in strings]
    at = (np.r_[0, np.cumsum(sizes)[:-1]])[owner] + place
    rows = flat[at[:, None] + np.arange(length)]  # neighbours in the suffix array
    new = np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]
    starts = np.flatnonzero(new)
    least = np.minimum.reduceat(doc[owner], starts)[np.cumsum(new) - 1]
    hit = doc[owner] > least
    out: list[list[int]] = [[] for _ in strings]
    for o, p in zip(owner[hit].tolist(), place[hit].tolist(), strict=True):
        out[o].append(p)
    return [np.array(sorted(x), np.int64) for x in out]


def _shared_part(tiles: list[bytes], group: np.ndarray, length: int, value: np.ndarray) -> list[tuple[int, int]]:
    """Of each tile the bytes from the first to the last string whose hash another tile of its group has, too."""
    sizes = np.array([len(t) for t in tiles])
    x = np.frombuffer(b"".join(tiles), np.uint8)
    base = np.r_[0, np.cumsum(sizes)[:-1]]
    power, back = np.full(len(x) + 1, _BASE), np.full(len(x) + 1, _INVERSE)
    power[0] = back[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(back, out=back)
    total = np.r_[_U(0), np.cumsum(value[x] * power[:-1])]
    count = sizes - length + 1
    owner = np.repeat(np.arange(len(tiles)), count)
    place = np.arange(int(count.sum())) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
    at = base[owner] + place
    h = _mix((total[at + length] - total[at]) * back[at])
    order = np.lexsort((owner, h, group[owner]))
    g, k, o = group[owner][order], h[order], owner[order]
    run = _first_of_run(g, k)
    last = np.r_[np.flatnonzero(run[1:] != run[:-1]), len(run) - 1]
    many = np.repeat(o[run[last]] != o[last], last - run[last] + 1)
    low, high = np.full(len(tiles), 1 << 40), np.full(len(tiles), -1)
    np.minimum.at(low, o[many], place[order][many])
    np.maximum.at(high, o[many], place[order][many])
    return [(int(a), int(b) + length) if b >= 0 else (0, 0) for a, b in zip(low, high, strict=True)]


def _resolve(rows: list[tuple], s: Settings, value: np.ndarray):
    """Rows (g, doc, key, pos, tile) of whole groups of g; yields (doc, key, spans)."""
    tiles: dict[tuple[int, bytes], int] = {}
    for h, _, _, _, tile in rows:
        tiles.setdefault((h, tile), len(tiles))
    groups = np.unique(np.array([h for h, _ in tiles], np.int64), return_inverse=True)[1]
    parts = _shared_part([t for _, t in tiles], groups, s.length, value)
    # equal parts of a group are one string, of their smallest document
    low: dict[tuple[int, bytes], int] = {}
    named = []
    for h, doc, key, pos, tile in rows:
        a, b = parts[tiles[h, tile]]
        if b:
            name = (h, tile[a:b])
            low[name] = min(low.get(name, doc), doc)
            named.append((name, doc, key, pos + a))
    alone: dict[int, int] = {}
    for h, _ in low:
        alone[h] = alone.get(h, 0) + 1
    hits: dict[tuple[int, bytes], np.ndarray] = {}
    batch, size = [], 0
    for name in sorted(n for n in low if alone[n[0]] > 1):
        if size >= s.sorted_bytes and name[0] != batch[-1][0]:
            hits |= _hits(batch, low, s)
            batch, size = [], 0
        batch.append(name)
        size += len(name[1])
    if batch:
        hits |= _hits(batch, low, s)
    none = np.zeros(0, np.int64)
    for name, doc, key, pos in named:
        places = np.arange(len(name[1]) - s.length + 1) if doc > low[name] else hits.get(name, none)
        if len(places):
            cut = np.flatnonzero(np.r_[True, np.diff(places) > 1])
            x = np.zeros(len(cut), _SPAN)
            x["s"] = places[cut] + pos
            x["e"] = places[np.r_[cut[1:], len(places)] - 1] + pos + s.length
            yield doc, key, x.tobytes()


def _hits(names: list[tuple[int, bytes]], low: dict, s: Settings) -> dict:
    found = first_by_suffix_array([t for _, t in names], np.array([low[n] for n in names], np.int64), s.length)
    return dict(zip(names, found, strict=True))


def _sorted_tiles(tiles: DataFrame, s: Settings) -> DataFrame:
    """kind 0 rows: spans of the strings that the suffix arrays find in smaller documents."""

    def run(batches):
        value = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)

        def resolved(rows):
            found = list(_resolve(rows, s, value))
            if found:
                ids, keys, data = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([0] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(data, pa.binary())], ["kind", "doc_id", "key", "data"])

        held, group, size = [], [], 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("g", "doc_id", "key", "pos", "tile")), strict=True):
                if group and row[0] != group[0][0]:
                    if len(group) > 1:
                        held.extend(group)
                        size += sum(len(x[4]) for x in group)
                    group = []
                    if size >= 16 * s.sorted_bytes:
                        yield from resolved(held)
                        held, size = [], 0
                group.append(row)
        if len(group) > 1:
            held.extend(group)
        if held:
            yield from resolved(held)

    return tiles.select("g", "doc_id", "key", "pos", "tile").repartition("g").sortWithinPartitions("g").mapInArrow(run, "kind int, doc_id long, key long, data binary")


def _merged(data: list[bytes]) -> list[tuple[int, int]]:
    x = np.frombuffer(b"".join(data), _SPAN)
    x = x[np.argsort(x["s"], kind="stable")]
    s, e = x["s"].astype(np.int64), np.maximum.accumulate(x["e"].astype(np.int64))
    cut = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
    return list(zip(s[cut].tolist(), e[np.r_[cut[1:], len(s)] - 1].tolist(), strict=True))


def removed_spans(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, key (hash of the text), data: byte spans to remove, several rows for a document."""
    s = settings
    parts = max(64, docs.rdd.getNumPartitions())  # a part has about as many tiles as a task of the scan
    rows = docs.where("doc_id is not null")
    first = settle(_settled_tiles(_tiles(rows, parts, repeated_anchors(rows, s), s), parts, s))
    free(docs.sparkSession)  # the tiles
    asked = lambda kind: _tile_bytes(rows, first.where(F.col("kind") == kind).select("doc_id", "key", "data"), s)
    more = _sorted_tiles(asked(1), s)
    if not first.where("kind = 2").isEmpty():
        more = more.union(_strings_alone(asked(2), s))
    return first.where("kind = 0").union(more).select("doc_id", "key", "data")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")


def dedup(docs: DataFrame, settings: Settings = Settings(), kept_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) of every row of docs."""
    rows = keyed(docs)
    per = settle(removed_spans(rows, settings).groupBy("doc_id", "key").agg(F.collect_list("data").alias("data")))
    free(docs.sparkSession)
    marks = _marked_docs(per, settings)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + kept_text]

    def cut(b: pa.RecordBatch, spans_of: list) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], [], []]
        for t, data in zip(b.column("text"), spans_of, strict=True):
            raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
            spans = _merged(data) if data else []
            kept, at = [], 0
            for a, e in spans:
                kept.append(raw[at:a])
                at = e
            rest = b"".join([*kept, raw[at:]])
            for c, v in zip(cols, (len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest), strict=True):
                c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        out = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *out[: 4 + kept_text]], names)

    def whole(batches):
        seen = np.frombuffer(marks.value, np.uint8)
        for b in batches:
            keep = _is_marked(seen, _doc_slots(b.column("doc_id"), b.column("key"), settings)) & b.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            for some in texts([b.filter(pa.array(~keep))]):
                yield cut(some, [None] * some.num_rows)

    def shortened(batches):
        for b in texts(batches):
            yield cut(b, b.column("data").to_pylist())

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept_text
    met = _may_have(rows, marks, settings).join(per, ["doc_id", "key"], "left")
    return rows.mapInArrow(whole, schema).unionByName(met.select("doc_id", "text", "data").mapInArrow(shortened, schema))
