"""N-gram Jaccard join: prefix postings find candidates, a trie of ordered sets verifies them.

A document's set is that of its word shingles, as 64-bit hashes. All sets are
kept in one global order: shingles seen often come last, by their count, the
rest by hash. Sets with a Jaccard similarity of t share one of the first
``n - ceil(t * n) + 1`` shingles in any such order, so only those are posted.

The steps, none of which makes all pairs of a group:

1. One scan gives each row's set size and a 128-bit hash of its set; rows with
   equal sets are one class, of which the smallest id stands for all.
2. The same scan counts shingles (each set once a task) for the order.
3. A second scan posts the prefixes, dealt by shingle as packed blocks. Runs of
   equal shingles link each member with the smallest one (candidates), and
   are kept for step 5 where they have three members or more.
4. Candidates are verified: the sets to compare with one pivot form a trie (by
   sorting them; neighbours share the path up to their common prefix), whose
   walk carries the overlap along shared paths and leaves a subtree as soon
   as what remains cannot reach the overlap needed.
5. Verified links are contracted to components. In a first turn members of one
   run that are in different components are paired with a neighbour each, which
   joins most of a group of copies; what is still apart after that is
   compared in all pairs. Within a component nothing more is needed, so copies
   of one text by the thousand cost a few comparisons each, and no link
   between different components is lost. Only pairs that parity bitmaps of
   their sets leave possible (an exact bound, see ``parity``) become
   candidates: members of a run that share a passage and little else
   are told apart inside the task and make no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm import common
from keelson.llm.words import mix, shingle_sets

#: Shingles whose count decides the order, most frequent first: 8 MB at most. Fewer or more only change speed.
ORDER_LIMIT = 500_000
#: Turns of pairing neighbours before all pairs of different components are compared.
ROUNDS = 1
#: Bits of a set's parity bitmap: a power of two, four or more for each element, within these. More bits bound more tightly.
LEAST_BITS, MOST_BITS = 512, 1 << 15
#: Hashes counted at once in a task, postings packed at once in a task.
BLOCK = 1_000_000
#: Rows of a batch handed back, and bytes of one of packed postings.
ROWS_OUT, BYTES_OUT = 1 << 16, 4 << 20


def needed(x: int, y: int, percent: int) -> int:
    """The least overlap of sets of x and y elements with 100 * overlap >= percent * union."""
    return -(-percent * (x + y) // (100 + percent))


def parity(s: np.ndarray) -> bytes:
    """A bitmap whose bits say whether an odd number of elements falls on them.

    Elements of both of two sets cancel out in the exclusive or of their
    bitmaps, so its bits set are at most the elements that only one set has.
    The bitmap of half the length is the exclusive or of the halves.
    """
    bits = min(max(LEAST_BITS, 1 << max(4 * len(s) - 1, 1).bit_length()), MOST_BITS)
    odd = np.bincount((mix(s, 9) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _sliced(batch: pa.RecordBatch, rows: int = ROWS_OUT) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int | None, np.ndarray]]:
    yield from zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), size), strict=True)


def _signature(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return tuple(np.array([mix(s, 1).sum(), mix(s, 2).sum()], np.uint64).view(np.int64).tolist())


def _scan(size: int):
    schema = pa.schema([("kind", pa.int8()), ("id", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("mark", pa.binary())])

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch | None:
        if not sets:
            return None
        values, times = np.unique(np.concatenate(sets), return_counts=True)
        often = times > 1
        k = int(often.sum())
        none = pa.nulls(k, pa.int64())
        return pa.record_batch([pa.array(np.ones(k, np.int8)), none, pa.array(times[often].astype(np.int64)), pa.array(values[often].view(np.int64)), none, pa.nulls(k, pa.binary())], schema=schema)

    def sized(rows: list[tuple[int, ...]], marks: list[bytes]) -> pa.RecordBatch:
        cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
        return pa.record_batch([pa.array(np.zeros(len(rows), np.int8)), *cols, pa.array(marks, pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held, have = [], 0
        for batch in batches:
            rows, marks = [], []
            for key, s in _sets(batch, size):
                hi, lo = _signature(s)
                rows.append((key, len(s), hi, lo))
                marks.append(parity(s))
                if len(marks) >= 1024:
                    yield sized(rows, marks)
                    rows, marks = [], []
                if (hi, lo) not in seen:
                    seen.add((hi, lo))
                    held.append(s)
                    have += len(s)
                if have > BLOCK:
                    yield from _sliced(counted(held))
                    held, have = [], 0
                    seen.clear()
            if rows:
                yield sized(rows, marks)
        if (last := counted(held)) is not None:
            yield from _sliced(last)

    return run, "kind tinyint, id long, n long, hi long, lo long, mark binary"


def _post(size: int, percent: int, order: tuple[np.ndarray, np.ndarray], deals: int):
    def prefix(s: np.ndarray, often: np.ndarray, count: np.ndarray) -> np.ndarray:
        n = len(s)
        take = n - -(-percent * n // 100) + 1
        if not len(often):
            return s[:take]
        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
        known = often[at] == s
        first = s[~known][:take]
        if len(first) == take:
            return first
        rest, weight = s[known], count[at[known]]
        return np.concatenate([first, rest[np.lexsort((rest, weight))][: take - len(first)]])

    def packed(parts: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        lengths = np.array([len(p) for _, _, p in parts])
        tokens = np.concatenate([p for _, _, p in parts])
        ids = np.repeat(np.array([i for i, _, _ in parts], np.int64), lengths)
        sizes = np.repeat(np.array([n for _, n, _ in parts], np.int32), lengths)
        deal = (tokens >> np.uint64(20)) % np.uint64(deals)
        by = np.argsort(deal, kind="stable")
        cut = np.searchsorted(deal[by], np.arange(deals + 1))
        tokens, ids, sizes = tokens[by], ids[by], sizes[by]
        some = np.flatnonzero(cut[:-1] < cut[1:])
        cols = [[x[cut[d] : cut[d + 1]].tobytes() for d in some] for x in (tokens, ids, sizes)]
        return pa.record_batch([pa.array(some.astype(np.int32)), *(pa.array(c, pa.binary()) for c in cols)], names=["deal", "tokens", "ids", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, count = order
        rows_out = max(1, BYTES_OUT * deals // (20 * BLOCK))
        seen: set[tuple[int, int]] = set()
        held, have = [], 0
        for batch in batches:
            for key, s in _sets(batch, size):
                if key is None or not len(s):
                    continue
                mark = _signature(s)
                if mark in seen:
                    continue
                seen.add(mark)
                p = prefix(s, often, count)
                held.append((key, len(s), p))
                have += len(p)
                if have > BLOCK:
                    yield from _sliced(packed(held), rows_out)
                    held, have = [], 0
                    seen.clear()
        if held:
            yield from _sliced(packed(held), rows_out)

    return run


def _runs(percent: int):
    """Postings of a partition to candidate links (run null) and members of runs of three and more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[], [], []]
        for batch in batches:
            for k, kind in enumerate((np.uint64, np.int64, np.int32)):
                parts[k] += [np.frombuffer(x, kind) for x in batch.column(k + 1).to_pylist()]
        if not parts[0]:
            return
        tokens, ids, sizes = (np.concatenate(p) for p in parts)
        parts.clear()
        by = np.lexsort((ids, tokens))
        tokens, ids, sizes = tokens[by], ids[by], sizes[by]
        first = np.empty(len(tokens), bool)
        first[0] = True
        first[1:] = (tokens[1:] != tokens[:-1]) | (ids[1:] != ids[:-1])  # an id counts once for a shingle
        tokens, ids, sizes = tokens[first], ids[first], sizes[first]
        starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        members = np.diff(np.r_[starts, len(tokens)])
        with np.errstate(over="ignore"):
            mark = np.add.reduceat(mix(ids.view(np.uint64), 7), starts)
        keep = members > 1
        starts, members, mark = starts[keep], members[keep], mark[keep]
        _, once = np.unique(mark, return_index=True)  # runs with the same members count once
        starts, members, mark = starts[once], members[once], mark[once]
        if not len(starts):
            return
        at = np.repeat(starts - np.r_[0, np.cumsum(members)[:-1]], members) + np.arange(members.sum())
        pivot = np.repeat(starts, members)
        a, b = ids[pivot], ids[at]
        x, y = sizes[pivot].astype(np.int64), sizes[at].astype(np.int64)
        near = (a != b) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
        pairs = np.unique(np.stack([a[near], b[near]]), axis=1)
        none = pa.nulls(pairs.shape[1], pa.int64())
        names = ["run", "a", "b", "n"]
        yield from _sliced(pa.record_batch([none, pa.array(pairs[0]), pa.array(pairs[1]), none], names=names))
        many = np.repeat(members > 2, members)
        run_id = np.repeat(mark.view(np.int64), members)[many]
        yield from _sliced(pa.record_batch([pa.array(run_id), pa.nulls(len(run_id), pa.int64()), pa.array(b[many]), pa.array(y[many])], names=names))

    return run, "run long, a long, b long, n long"


def _possible(x, y, differ, percent: int):
    """Whether sets of x and y elements may link, if their bitmaps differ in so many bits."""
    return (x + y - differ.astype(np.int64)) // 2 >= needed(x, y, percent)


def _bitmaps(marks: list[bytes]) -> dict[int, tuple[int, np.ndarray]]:
    """Per length of ``marks``, which ascend by length: its first row, and its and all longer rows at that length."""
    lengths = np.array([len(m) for m in marks])
    out, longer = {}, None
    for k in np.unique(lengths)[::-1].tolist():
        rows = np.frombuffer(b"".join(m for m in marks if len(m) == k), np.uint64).reshape(-1, k // 8)
        if longer is not None:
            while longer.shape[1] > k // 8:
                half = longer.shape[1] // 2
                longer = longer[:, :half] ^ longer[:, half:]
            rows = np.concatenate([rows, longer])
        out[k], longer = (int(np.searchsorted(lengths, k)), rows), rows
    return out


def _across(percent: int, turn: int | None):
    """Members (run, node, n, component, mark), sorted by run, to pairs of different components that sizes and bitmaps allow.

    In a numbered turn only neighbours by a hash of node and turn are paired: as
    many pairs as members, and mostly the same in all runs of one group of
    copies. Without a turn all such pairs are made.
    """

    def pairs(node, n, comp, marks):
        by = np.argsort(n, kind="stable")
        node, n, comp, marks = node[by], n[by], comp[by], [marks[k] for k in by.tolist()]
        if (comp == comp[0]).all():
            return
        maps, last = _bitmaps(marks), np.searchsorted(n, 100 * n // percent, "right")
        next_to = np.empty(len(n), np.int64)
        if turn is not None:
            chain = np.argsort(mix(node.view(np.uint64), 20 + turn), kind="stable")
            next_to[chain] = np.r_[chain[1:], chain[-1]]
            low, high = np.minimum(next_to, np.arange(len(n))), np.maximum(next_to, np.arange(len(n)))
            ways = zip(low.tolist(), high[:, None], strict=True)
        else:
            ways = ((i, np.arange(i + 1, last[i])) for i in range(len(n) - 1))
        for i, other in ways:
            other = other[(comp[other] != comp[i]) & (other < last[i])]
            if len(other):
                start, rows = maps[len(marks[i])]
                differ = np.bitwise_count(rows[other - start] ^ rows[i - start]).sum(axis=1)
                other = other[_possible(n[i], n[other], differ, percent)]
            if len(other):
                yield np.stack([np.minimum(node[i], node[other]), np.maximum(node[i], node[other])])

    def distinct(out: list[np.ndarray]) -> pa.RecordBatch:
        found = np.unique(np.concatenate(out, axis=1), axis=1)
        return pa.record_batch([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, kept = np.zeros((4, 0), np.int64), []
        out, have = [], 0
        for batch in itertools.chain(batches, [None]):
            now, marks = rest, kept
            if batch is not None:
                now = np.concatenate([rest, np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)])], axis=1)
                marks = kept + batch.column(4).to_pylist()
            if not now.shape[1]:
                continue
            starts = np.flatnonzero(np.r_[True, now[0, 1:] != now[0, :-1]])
            ends = [*starts[1:], now.shape[1]]
            if batch is not None:  # the last run may go on in the next batch
                rest, kept = now[:, starts[-1] :], marks[starts[-1] :]
                starts, ends = starts[:-1], ends[:-1]
            for s, e in zip(starts, ends, strict=True):
                for p in pairs(now[1, s:e], now[2, s:e], now[3, s:e], marks[s:e]):
                    out.append(p)
                    have += p.shape[1]
                if have > 200_000:
                    yield distinct(out)
                    out, have = [], 0
        if out:
            yield distinct(out)

    return run, "a long, b long"


def trie_overlaps(pivot: np.ndarray, sets: list[np.ndarray], percent: int) -> list[int]:
    """Per set its overlap with the pivot, or -1 where it is too small.

    The sorted list of sets is the trie, walked in depth-first order: ``path``
    holds the overlap along the last set's path, of which a set reuses the
    part up to the prefix they share. ``dead`` is the depth at which the walk
    left a subtree; sets below that need as much or more are skipped.
    """
    out = [-1] * len(sets)
    order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u8").tobytes())
    before = np.zeros(0, np.uint64)
    path, place = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for k in order:
        s = sets[k]
        need = needed(len(s), len(pivot), percent)
        m = min(len(s), len(before), len(path) - 1)
        differ = np.flatnonzero(s[:m] != before[:m])
        depth = int(differ[0]) if len(differ) else m
        path, place = path[: depth + 1], place[: depth + 1]
        before = s
        while True:
            rest = min(len(s) - depth, len(pivot) - int(place[depth]))
            if path[depth] + rest < need:
                break
            if depth == len(s):
                out[k] = int(path[depth])
                break
            step = s[depth : depth + 128]
            at = np.searchsorted(pivot, step)
            hit = pivot[np.minimum(at, len(pivot) - 1)] == step
            path = np.concatenate([path, path[depth] + np.cumsum(hit)])
            place = np.concatenate([place, at + hit])
            depth += len(step)
    return out


def _verify(percent: int):
    """(a, salt, b, set), sorted by a, salt, b with a's own set first, to verified links."""

    def settle(a: int, pivot: np.ndarray, ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        found = trie_overlaps(pivot, sets, percent)
        return [(a, b) for b, s, o in zip(ids, sets, found, strict=True) if o >= 0 and 100 * o >= percent * (len(s) + len(pivot) - o)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivot, ids, sets, out = None, None, [], [], []
        for batch in batches:
            for a, salt, b, own, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                s = np.frombuffer(data, np.uint64)
                if (a, salt) != key or len(ids) >= 256:
                    if ids:
                        out += settle(key[0], pivot, ids, sets)
                        ids, sets = [], []
                if (a, salt) != key:
                    key, pivot = (a, salt), None
                if own:
                    pivot = s
                elif pivot is not None:
                    ids.append(b)
                    sets.append(s)
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                out = []
        if ids:
            out = settle(key[0], pivot, ids, sets)
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return run, "a long, b long"


def _told_apart(percent: int):
    """(a, b, x, y, p, q), two nodes with their sets' sizes and bitmaps, to the pairs (a, b) that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k).to_numpy() for k in (2, 3))
            differ = np.zeros(batch.num_rows, np.int64)
            for k, (p, q) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                short, long = sorted((np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)), key=len)
                while len(long) > len(short):
                    long = long[: len(long) // 2] ^ long[len(long) // 2 :]
                differ[k] = np.bitwise_count(short ^ long).sum()
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(_possible(x, y, differ, percent)))

    return run, "a long, b long"


def may_link(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that sizes and bitmaps (node, n, mark) leave possible."""
    x, y = (marks.select(F.col("node").alias(k), F.col("n").alias(n), F.col("mark").alias(m)) for k, n, m in (("a", "x", "p"), ("b", "y", "q")))
    run, schema = _told_apart(percent)
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", "p", "q").mapInArrow(run, schema)


def across(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that lie in different components."""
    of = [near.select(F.col("node").alias(k), F.col("component").alias(f"of_{k}")) for k in "ab"]
    found = pairs.join(of[0], "a", "left").join(of[1], "b", "left")
    return found.where("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b")


def apart(several: DataFrame, near: DataFrame, marks: DataFrame, percent: int, turn: int | None) -> DataFrame:
    """Candidate pairs (a, b) among the members (run, rep, n) of runs that lie in several components."""
    spark = several.sparkSession
    placed = several.join(near.withColumnRenamed("node", "rep"), "rep", "left").select("run", "rep", "n", F.coalesce("component", "rep").alias("component"))
    mixed = placed.groupBy("run").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    placed = placed.join(mixed.select("run"), "run", "left_semi").join(marks.select(F.col("node").alias("rep"), "mark"), "rep").select("run", "rep", "n", "component", "mark")
    placed = placed.repartition(common.partitions(spark), "run").sortWithinPartitions("run", "rep")
    run, schema = _across(percent, turn)
    return placed.mapInArrow(run, schema).distinct()


def _deal_sets(size: int):
    """(id, text, tasks), tasks being (a, salt, own) each, to (a, salt, b, own, set)."""
    names = ["a", "salt", "b", "own", "s"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, have = [], 0
            for (key, s), tasks in zip(_sets(batch, size), batch.column(2).to_pylist(), strict=True):
                data = s.tobytes()
                rows += [(t["a"], t["salt"], key, t["own"], data) for t in tasks]
                have += len(data) * len(tasks)
                if have > 8 << 20:
                    yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=names)
                    rows, have = [], 0
            if rows:
                yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=names)

    return run, "a long, salt long, b long, own boolean, s binary"


def verified(rows: DataFrame, pairs: DataFrame, size: int, percent: int, salts: int = 16) -> DataFrame:
    """The links among candidate pairs (a, b) of ids of the rows (id, text).

    A pivot's partners are dealt over ``salts`` tasks, each with the pivot's set.
    Sets are made again from the texts, so only those compared are shuffled, once.
    """
    dealt = pairs.select("a", F.pmod(F.xxhash64("b"), F.lit(salts)).alias("salt"), "b")
    own = dealt.select("a", "salt").distinct().select("a", "salt", F.col("a").alias("b"), F.lit(True).alias("own"))
    dealt = dealt.withColumn("own", F.lit(False)).union(own)
    tasks = common.saved(dealt.groupBy(F.col("b").alias("id")).agg(F.collect_list(F.struct("a", "salt", "own")).alias("tasks")), "tasks")
    few = common.broadcast_if_small(tasks, tasks.agg(F.sum(F.size("tasks") + 1)).first()[0] or 0)
    deal, dealt_schema = _deal_sets(size)
    sets = rows.join(few, "id").select("id", "text", "tasks").mapInArrow(deal, dealt_schema)
    sets = sets.repartition(common.partitions(rows.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", F.desc("own"), "b")
    run, schema = _verify(percent)
    links = common.saved(sets.mapInArrow(run, schema), "links")
    common.release(tasks)
    return links


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``.

    Sets link when 100 * intersection >= percent * union, exactly (on 64-bit
    shingle hashes). component_id is the smallest id reachable by links.

    Null or empty texts and texts of white space have no shingle and link with
    nothing. Repeated rows give repeated results; rows with one id and several
    texts share their links. A null id keeps its size, has a null component and
    links with nothing. Other columns, of any name, are ignored. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), common.text_or_empty(text_col).alias("text"))
    run, schema = _scan(size)
    scan = common.saved(rows.mapInArrow(run, schema), "scan")
    sized = scan.where("kind = 0")
    classes = sized.where("n > 0 and id is not null").groupBy("hi", "lo", "n").agg(F.min("id").alias("rep"))
    members = sized.join(classes, ["hi", "lo", "n"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    members = common.saved(members, "members")

    often = scan.where("kind = 1").groupBy("hi").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "hi").limit(ORDER_LIMIT).toArrow()
    tokens = often.column("hi").to_numpy().view(np.uint64) if often.num_rows else np.zeros(0, np.uint64)
    by = np.argsort(tokens)
    counts = often.column("n").to_numpy()[by] if often.num_rows else np.zeros(0, np.int64)
    order = spark.sparkContext.broadcast((tokens[by], counts))

    deals = common.partitions(spark)

    def post(batches):
        yield from _post(size, percent, order.value, deals)(batches)

    runs_of, runs_schema = _runs(percent)
    posted = rows.mapInArrow(post, "deal int, tokens binary, ids binary, sizes binary").repartitionById(deals, "deal")
    found = common.saved(posted.mapInArrow(runs_of, runs_schema), "runs")
    order.destroy()
    rep = members.select(F.col("id").alias("b"), "rep").distinct()
    links = found.where("run is null").select("a", "b")
    first = links.join(rep, "b").select("a", F.col("rep").alias("y")).join(rep.withColumnRenamed("b", "a"), "a")
    first = first.select(F.least("rep", "y").alias("a"), F.greatest("rep", "y").alias("b")).where("a <> b").distinct()
    first = common.saved(first, "candidates")
    several = found.where("run is not null").select("run", "b", "n").join(rep, "b").select("run", "rep", "n").distinct()
    several = common.saved(several, "members")
    nodes = first.select(F.explode(F.array("a", "b")).alias("id")).union(several.select("rep")).distinct()
    marks = sized.join(nodes, "id", "left_semi").groupBy(F.col("id").alias("node")).agg(F.max_by(F.struct("n", "mark"), F.struct("hi", "lo")).alias("x"))
    marks = common.saved(marks.select("node", "x.n", "x.mark"), "marks")
    common.release(scan, found)
    first = common.saved(may_link(first, marks, percent), "candidates")
    tested = common.saved(first.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "candidates")
    near = common.saved(common.components(verified(rows, tested, size, percent)), "near")
    for turn in (*range(ROUNDS), None):  # the last one makes all pairs that are left
        pairs = apart(several, near, marks, percent, turn)
        if turn is None:
            pairs = pairs.union(across(first, near)).distinct()
        pairs = common.saved(pairs.join(tested, ["a", "b"], "left_anti"), "candidates")
        if pairs.isEmpty():
            continue
        tested, more = tested.union(pairs), verified(rows, pairs, size, percent)
        if not more.isEmpty():
            near = common.saved(common.components(near.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)), "near")
    common.release(several, marks, first)
    return members.join(near.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` whose id is that of their component; null ids stay.

    Of repeated rows one stays; rows with one id and different texts all do.
    """
    found = jaccard_components(docs, id_col, text_col, size, percent)
    keep = found.where(F.col(id_col) == F.col("component_id")).groupBy(F.col(id_col).alias("_keep")).agg(F.count("*").alias("_rows"))
    own = docs.where(F.col(id_col).isNotNull()).select(F.struct(*docs.columns).alias("_own"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    kept = own.join(keep, own._id == keep._keep)
    once = kept.where("_rows = 1").select("_own")
    repeated = kept.where("_rows > 1").dropDuplicates(["_id", "_text"]).select("_own")
    return once.unionByName(repeated).select("_own.*").unionByName(docs.where(F.col(id_col).isNull()))
