"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string the BPE encoding is unique, and so is its last token. `Prefixes` stores that last
token for each prefix: a token ending at a byte is the right one exactly if the token stored where it begins and it
are the encoding of the two's bytes together (adjacent pairs decide validity). So appending bytes only adds entries,
and an edit only needs the entries from the edit on. As the last token belongs to the prefix alone, words that begin
alike share it: an `Encoder` asks from a word's end, only for the prefixes that it needs, and remembers them.

Texts are split by the tokenizer's pattern and each match is encoded by itself. A text is first cut before every
single blank that a visible character follows; no match crosses such a cut, so pieces between cuts are encoded and
decoded once and remembered in a dictionary of bounded size. In the pattern, as in those like it, a blank and Latin
letters are one match, and a point or comma after them begins another; such pieces go without the pattern.

Defined results: a null text counts as empty, and an empty text has no ids; rows repeat as they come; extra columns
are ignored. Lone surrogates, which Spark strings can't hold, would be encoded as tiktoken does, as U+FFFD.
"""

from __future__ import annotations

import base64
import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import SLICE_BYTES, Memo, lean, texts

_CUT = re.compile(r" (?=\S)")
_LETTERS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,]?)")
#: Bytes of a word whose prefixes are remembered; longer ones are encoded by the automaton.
_SHORT = 64
#: Pieces that a task remembers, and half as many prefixes; twice as many of both took 54 MB more of a worker and no less time.
REMEMBERED = 200_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and their ranks from a rank file: base64 and number on each line."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x.strip())}


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.pairs = Memo(self._pair_holds, 400_000)
        self.stands = Memo(lambda t: self.merged(self.bytes_of[t]) == [t], len(ranks) + 1)
        self.ends = ahocorasick.Automaton()  # tokens that end at each byte, longest first
        for t, i in ranks.items():
            self.ends.add_word(t.decode("latin-1"), (len(t), i))
        self.ends.make_automaton()

    def merged(self, data: bytes) -> list[int]:
        """Plain BPE: the pair of lowest rank first; decides pairs of tokens, and is the definition."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _pair_holds(self, pair: tuple[int, int]) -> bool:
        a, b = pair
        return self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]


class Prefixes:
    """The unique last token of each prefix of the bytes appended so far."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last, self.start = vocabulary, b"", [-1], [0]
        self.append(data)

    def append(self, more: bytes) -> None:
        last, start = self.last, self.start
        pairs, stands = self.v.pairs, self.v.stands
        done = len(self.data)
        self.data += more
        for at, (n, t) in self.v.ends.iter(self.data.decode("latin-1"), max(0, done + 1 - self.v.longest)):
            if len(last) == at + 1:
                begin = at + 1 - n
                if pairs[last[begin], t] if begin else stands[t]:
                    last.append(t)
                    start.append(begin)
        if len(last) != len(self.data) + 1:
            raise ValueError("the vocabulary lacks a single byte")

    def edit(self, begin: int, end: int, new: bytes) -> None:
        """Puts `new` in place of data[begin:end]; what stands before it is kept as it is."""
        tail = self.data[end:]
        del self.last[begin + 1 :], self.start[begin + 1 :]
        self.data = self.data[:begin]
        self.append(new + tail)

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at])
            at = self.start[at]
        return out[::-1]


class Encoder:
    """encode_ordinary of a rank file and a pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        self.v = Vocabulary(ranks)
        self.match = regex.compile(pattern)
        self.lasts = Memo(self._last, remembered // 2)
        self.pieces = Memo(self._piece, remembered)  # of what follows a cut

    def _last(self, prefix: bytes) -> int:
        """The unique last token of a prefix, the longest first."""
        get, pairs, lasts = self.v.ranks.get, self.v.pairs, self.lasts
        t = get(prefix)
        if t is not None and self.v.stands[t]:
            return t
        for begin in range(1, len(prefix)):
            t = get(prefix[begin:])
            if t is not None and pairs[lasts[prefix[:begin]], t]:
                return t
        raise ValueError("the vocabulary lacks a single byte")

    def _word(self, word: bytes) -> list[int]:
        whole = self.v.ranks.get(word)
        if whole is not None:
            return [whole]
        if len(word) > _SHORT:
            return Prefixes(self.v, word).ids()
        out = []
        while word:
            out.append(t := self.lasts[word])
            word = word[: -len(self.v.bytes_of[t])]
        return out[::-1]

    def _coded(self, matches: list[str]) -> tuple[str, bytes]:
        """The ids as decimal numbers joined by commas, and the bytes that they decode to."""
        ids = [i for m in matches for i in self._word(m.encode("utf-8", "replace"))]
        return ",".join(map(str, ids)), self.decode(ids)

    def _piece(self, piece: str) -> tuple[str, bytes]:
        plain = _LETTERS.fullmatch(piece)
        if not plain:
            return self._coded(self.match.findall(" " + piece))
        if not plain[2]:
            return self._coded([" " + piece])
        (a, x), (b, y) = self.pieces[plain[1]], self._coded([plain[2]])
        return f"{a},{b}", x + y

    def coded(self, text: str) -> tuple[str, bytes]:
        """The ids of a text as decimal numbers joined by commas, and the bytes that they decode to."""
        first, *rest = _CUT.split(text)
        parts = list(map(self.pieces.__getitem__, rest))
        if first:
            parts.insert(0, self._coded(self.match.findall(first)))
        return ",".join([a for a, _ in parts]), b"".join([x for _, x in parts])

    def encode(self, text: str) -> list[int]:
        ids = self.coded(text)[0]
        return list(map(int, ids.split(","))) if ids else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.v.bytes_of.__getitem__, ids))


def _vocabulary_bytes(spark: SparkSession, path: str) -> bytes:
    """A rank file has a fixed size, some hundred kB, and so goes with the tasks."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text; with `ids` also the ids themselves."""
    blob = docs.sparkSession.sparkContext.broadcast(_vocabulary_bytes(docs.sparkSession, ranks_path))

    def run(batches):
        encoder = Encoder(read_ranks(blob.value), pattern, remembered)
        for b in texts(batches, most=SLICE_BYTES // 4):
            count, joined, decoded, kept = [], [], [], []
            for t in b.column("text"):
                all_ids, back = encoder.coded(t.as_py() or "")
                count.append(n := all_ids.count(",") + 1 if all_ids else 0)
                joined.append(hashlib.sha256(all_ids.encode()).hexdigest())
                decoded.append(hashlib.sha256(back).hexdigest())
                if ids:
                    kept.append(np.fromiter(map(int, all_ids.split(",") if n else []), np.int32, n))
            cols = [b.column("doc_id"), pa.array(count, pa.int64()), pa.array(joined, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.list_(pa.int32()))] * ids, names + ["ids"] * ids)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), schema)


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and text (UTF-8, wrong bytes replaced) of the ids of each row."""
    blob = encoded.sparkSession.sparkContext.broadcast(_vocabulary_bytes(encoded.sparkSession, ranks_path))

    def run(batches):
        table = {i: t for t, i in read_ranks(blob.value).items()}
        for b in batches:
            out = [b"".join(map(table.__getitem__, x.as_py() or [])).decode("utf-8", "replace") for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
