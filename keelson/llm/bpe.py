"""Byte-level BPE as a monoid reduction over halves.

A text is cut near its middle where its pattern always begins a new match
(white space after other text), and so on in halves; the ids of the parts are
concatenated up the tree. Within one match no such place exists: its halves are encoded on
their own and joined by re-encoding a window around the border. The window
grows until its outer tokens and their neighbours outside, encoded together,
give just those two tokens. A token sequence of which all neighbours satisfy
this is the encoding of its bytes, so everything outside the window is stable.

Decoding maps ids to bytes and concatenates up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm import common

#: Bytes up to which a match is merged directly, and a window without a queue; code points up to which a text is one leaf.
LEAF, LONG, TEXT_LEAF = 16, 256, 1 << 16
_BREAK = regex.compile(r"(?<=\S)(?=\s)")
#: A space inside a run of white space, or at the end of one that ends the text: no match need begin there.
_RUN = re.compile(r"\s (?:\s|\Z)")


class Codec:
    """Encoder and decoder for a file of ranks (base64 token and rank a line). The cache of matches is emptied at ``limit``."""

    def __init__(self, path: str, pattern: str, limit: int = 700_000):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.limit = limit
        self.cache: dict[str, tuple[int, ...]] = {}
        self.spaced: dict[str, tuple[int, ...]] = {}
        self.digits = {b: str(b) for b in self.tokens}

    def merge(self, data: bytes) -> list[int]:
        """Merge the neighbours of lowest rank, the leftmost of equals, until none has a rank."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(data) > LONG:
            return self._merge_long(data)
        parts = [data[k : k + 1] for k in range(len(data))]
        ranks = self.ranks
        none = len(ranks) + 1
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            low = min(pairs)
            if low == none:
                break
            k = pairs.index(low)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k < len(pairs):
                pairs[k] = ranks.get(parts[k] + parts[k + 1], none)
            if k:
                pairs[k - 1] = ranks.get(parts[k - 1] + parts[k], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a queue of pairs by (rank, place), for windows that had to grow."""
        n, ranks = len(data), self.ranks
        end, before = list(range(1, n + 1)), list(range(-1, n))  # where the part at a place ends; where the part before it begins
        queue = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(data[k : k + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, k, stop = heapq.heappop(queue)
            middle = end[k]
            if not middle or middle == n or end[middle] != stop:
                continue  # one of the two is gone or longer
            end[k], end[middle] = stop, 0
            if stop < n:
                before[stop] = k
                if (r := ranks.get(data[k : end[stop]])) is not None:
                    heapq.heappush(queue, (r, k, end[stop]))
            if (j := before[k]) >= 0 and (r := ranks.get(data[j:stop])) is not None:
                heapq.heappush(queue, (r, j, stop))
        out, k = [], 0
        while k < n:
            out.append(ranks[data[k : end[k]]])
            k = end[k]
        return out

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def stable(self, a: int, b: int) -> bool:
        """Whether the two tokens side by side are the encoding of their bytes."""
        return self.merge(self.tokens[a] + self.tokens[b]) == [a, b]

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings."""
        if not a or not b:
            return a or b
        low, high = 1, 1
        while True:
            window = self.merge(self.bytes_of(a[-low:] + b[:high]))
            grow_low = low < len(a) and not self.stable(a[-low - 1], window[0])
            grow_high = high < len(b) and not self.stable(window[-1], b[high])
            if not grow_low and not grow_high:
                return a[: len(a) - low] + window + b[high:]
            low, high = min(len(a), low + grow_low * low), min(len(b), high + grow_high * high)

    def encode_match(self, data: bytes) -> list[int]:
        """The ids of one match: leaves merged directly, halves joined."""
        if len(data) <= LEAF or data in self.ranks:
            return self.merge(data)
        middle = len(data) // 2
        return self.join(self.encode_match(data[:middle]), self.encode_match(data[middle:]))

    def _matches(self, text: str) -> list[int]:
        cache = self.cache
        out: list[int] = []
        for m in self.find(text):
            ids = cache.get(m)
            if ids is None:
                ids = cache[m] = tuple(self.encode_match(m.encode()))
            out += ids
        return out

    def _leaf(self, text: str) -> list[int]:
        """Matches begin at every single space, so words after spaces are looked up whole; other texts match by match."""
        if _RUN.search(text):
            return self._matches(text)
        first, *words = text.split(" ")
        spaced = self.spaced
        for w in set(words).difference(spaced):
            spaced[w] = tuple(self._matches(" " + w))
        out = self._matches(first)
        for ids in map(spaced.__getitem__, words):
            out += ids
        return out

    def decimal(self, ids: list[int]) -> str:
        return " ".join(map(self.digits.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        """The ids of a text, in the order of its matches."""
        if len(self.cache) + len(self.spaced) > self.limit:
            self.cache.clear()
            self.spaced.clear()
        if len(text) > TEXT_LEAF:
            cut = _BREAK.search(text, len(text) // 2)
            if cut and cut.start() < len(text):
                return self.encode(text[: cut.start()]) + self.encode(text[cut.start() :])
        return self._leaf(text)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= TEXT_LEAF:
            return self.bytes_of(ids)
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a file; kept between tasks."""
    return _codecs.get((path, pattern)) or _codecs.setdefault((path, pattern), Codec(path, pattern))


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            keys, out, have = [], [], 0
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = own.encode(text.as_py() or "")
                keys.append(key.as_py())
                out.append(np.array(ids, np.int32))
                have += len(ids)
                if have > 1_000_000:
                    yield _ids_batch(keys, out)
                    keys, out, have = [], [], 0
            if keys:
                yield _ids_batch(keys, out)

    return run


def _ids_batch(keys: list, out: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.r_[0, np.cumsum([len(x) for x in out])].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out)))
    return pa.record_batch([pa.array(keys, pa.int64()), lists], names=["id", "ids"])


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row's whole text. Null is empty; repeated rows repeat; other columns are ignored."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), common.text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_encode(path, pattern), "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id, data binary) of rows (id, ids); null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                data = [own.decode(ids or []) for ids in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(data, pa.binary())], names=["id", "data"])

    return encoded.select(F.col(id_col).alias("id"), "ids").mapInArrow(run, "id long, data binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): both directions of every whole text, digests in the same scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        sha = hashlib.sha256
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = own.encode(text.as_py() or "")
                out.append((key, len(ids), sha(own.decimal(ids).encode()).hexdigest(), sha(own.decode(ids)).hexdigest()))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), common.text_or_empty(text_col).alias("text"))
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
