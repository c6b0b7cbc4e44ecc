"""Best-fit packing of token pieces into sequences of fixed capacity.

Bulk-synchronous best-fit decreasing. Both sorted lists, of pieces and of gaps,
are kept in run-length form: lengths and gaps are whole numbers up to the
capacity, so each list is a histogram with at most ``capacity`` runs of equal
values, whatever the number of documents. One superstep takes a run of equal
lengths (longest first) and sweeps the gaps from its successor upwards: a run
of gaps takes as many pieces each as fit, then its gaps shrink. What finds no
gap opens new sequences. Ties are settled by rank: the k-th piece of a length
belongs to the placement whose rank range holds k. The supersteps handle only
runs; pieces are matched with their placements in a distributed join, by
length and rank. The result is the same as best-fit decreasing piece by piece.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm import common


class WordTokenizer:
    """Ids of texts, by white-space separated words that are each encoded once.

    The vocabulary drops white space and none of its tokens spans it, so a
    text's ids are those of its words in order. ``str.split`` also splits at
    four control characters that the tokenizer treats as text; texts with one
    of them are encoded whole. The cache is emptied at ``limit`` words.
    """

    ODD = "\x1c\x1d\x1e\x1f"
    END = b"\xff"
    #: Fixed value: how the vocabulary cuts words.
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: Printable ASCII and Latin letters without the dotted capital I: lower case is one to one and nothing composes.
    PLAIN = re.compile(r"[\x21-\x7e\u00a1-\u00ac\u00ae-\u012f\u0131-\u024f]+").fullmatch
    split = regex.compile(PIECES).findall

    def __init__(self, path: str, limit: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.limit = limit
        self.cache: dict[str, bytes] = {}

        self.piece = self._byte_pairs(path)

    def _byte_pairs(self, path: str):
        """The same merges over plain bytes, for words that need no normalising but lower case.

        A byte that UTF-8 never holds stands for the end of a word. It merges
        with the last byte before all else, since these tokens have the lowest ids.
        None if the file is of another kind.
        """
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        splits = [x.get("pattern", {}).get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        if spec["model"].get("end_of_word_suffix") != "</w>" or self.PIECES not in splits:
            return None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
        ranks: dict[bytes, int] = {}
        for token, rank in spec["model"]["vocab"].items():
            core = token.removesuffix("</w>")
            if core and all(c in byte_of for c in core) and not token.startswith("<|"):
                ranks[bytes(byte_of[c] for c in core) + self.END * (core != token)] = rank
        for b in range(256):
            ranks.setdefault(bytes([b]), (1 << 30) + b)
        return tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _learn(self, words: list[str]) -> None:
        odd = []
        for w in words:
            if self.piece is None or not self.PLAIN(w):
                odd.append(w)
                continue
            ids: list[int] = []
            for p in self.split(w.lower()):
                ids += self.piece(p.encode() + self.END)
            self.cache[w] = np.array(ids, "<u4").tobytes()
        if odd:
            found = self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)
            for w, e in zip(odd, found, strict=True):
                self.cache[w] = np.array(e.ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if any(c in text for c in self.ODD):
            return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()
        if len(self.cache) > self.limit:
            self.cache.clear()
        words = text.split()
        missing = set(words).difference(self.cache)
        if missing:
            self._learn(list(missing))
        return b"".join(map(self.cache.__getitem__, words))


_tokenizers: dict[str, WordTokenizer] = {}


def _pieces(path: str, capacity: int):
    names = ["id", "piece", "start", "length", "ids_crc32", "task", "nth"]
    schema = "id long, piece int, start long, length long, ids_crc32 long, task int, nth long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        tokenizer = _tokenizers.get(path) or _tokenizers.setdefault(path, WordTokenizer(path))  # kept between a worker's tasks
        counts = np.zeros(capacity + 1, np.int64)
        out = []
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                key, ids = key.as_py(), tokenizer.encode(text.as_py() or "") + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    out.append((key, k, at // 4, n, zlib.crc32(part), task, int(counts[n])))
                    counts[n] += 1
                if len(out) > 20_000:
                    yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], names=names).cast(SCHEMA)
                    out = []
        if out:
            yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], names=names).cast(SCHEMA)

    return run, schema


SCHEMA = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())])


def plan_runs(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over runs.

    Returns (length, first rank, ranks, first sequence, pieces in each sequence,
    offset): the ranks from the first go to consecutive sequences, as many to
    each as said, the first of them at the offset. Work and result are bounded
    by the capacity, not by the number of pieces.
    """
    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, sequences), sorted
    plan = []
    opened = 0

    def put(gap: int, first: int, count: int) -> None:
        if gap and count:
            bisect.insort(gaps, (gap, first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(gaps, (length,))
            if at < len(gaps):
                gap, first, count = gaps.pop(at)
            else:
                each = capacity // length
                gap, first, count = capacity, opened, -(-left // each)
                opened += count
            each = gap // length
            full = min(count, left // each)
            if full:
                plan.append((length, rank, full * each, first, each, capacity - gap))
                put(gap - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            first, count = first + full, count - full
            if count and left:  # fewer than fill one more sequence
                plan.append((length, rank, left, first, left, capacity - gap))
                put(gap - left * length, first, 1)
                rank, left, first, count = rank + left, 0, first + 1, count - 1
            put(gap, first, count)
    return plan


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (length, task, nth, ...) with sequence_id and offset.

    ``nth`` counts the pieces of one length within one task from 0; a prefix
    sum over tasks makes it the rank among all of that length.
    """
    spark = pieces.sparkSession
    counts = common.saved(pieces.groupBy("length", "task").agg(F.count("*").alias("c")), "counts")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "task", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("c").alias("n")).collect()}  # at most ``capacity`` rows
    plan = plan_runs(totals, capacity)
    schema = "length long, rank long, ranks long, first long, each long, base_offset long"
    runs = spark.createDataFrame(plan, schema)
    runs = runs.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("rank", "ranks", "first", "each", "base_offset"))).alias("runs"))
    ranked = pieces.join(base, ["length", "task"]).withColumn("k", F.col("nth") + F.col("base"))
    placed = ranked.join(F.broadcast(runs), "length")  # one row per length up to the capacity
    placed = placed.withColumn("r", F.element_at(F.filter("runs", lambda r: (r["rank"] <= F.col("k")) & (F.col("k") < r["rank"] + r["ranks"])), 1))
    within = F.col("k") - F.col("r.rank")
    each = F.col("r.each")
    return placed.select(
        *pieces.columns,
        (F.col("r.first") + (within - F.pmod(within, each)) / each).cast("long").alias("sequence_id"),
        (F.col("r.base_offset") + F.pmod(within, each) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are those of the tokenizer file, then id 0. Only documents
    of more than ``capacity`` ids are cut. A null or empty text is the single
    id 0. Repeated rows and rows with null or equal ids are packed as rows of
    their own. Other columns, of any name, are ignored; an empty table gives an
    empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    run, schema = _pieces(tokenizer, capacity)
    pieces = common.saved(rows.mapInArrow(run, schema), "pieces")
    placed = place(pieces, capacity)
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
