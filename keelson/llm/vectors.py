"""Embedding near-duplicates by sorted projection passes.

Each pass sorts all vectors lexicographically by the concatenated sign bits of
random projections and compares every vector with its ``window`` followers;
near vectors share long prefixes and meet in some pass. Equal vectors are one
class from the start, so copies by the thousand are one row in the passes.

Passes carry ids, components and a signature of ``SIGNS`` further sign bits,
no vectors. Vectors near enough differ in few signature bits; the bound is six
standard deviations above what vectors at the threshold differ in, so no more
than some 1e-9 of those are lost. What is within the bound and of different
components is fetched and verified in double precision; verified pairs are
united to components before the next round of passes. The first rounds verify a
vector's nearest and next candidate of a pass only, which joins most of a large
group; the last round, with most of the passes, verifies every candidate pair of
different components.

A round is one range sort by (dimension, pass, bits). Each task compares inside
its range and sends its first and last rows on, over as many ranges as the
window reaches, so that ranges are also compared across their borders.

How many passes there are follows from the number of classes: two vectors at the
threshold meet in one pass with a probability of about
``(1 - angle / pi) ** log2(rows / window)``, and there are enough passes for
all but ``miss`` of such pairs.

The passes decide the components only. Within each component all vectors are
then compared, in pairs of blocks of about ``BLOCK`` vectors, so the links of a
large group are whole however small the window is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm import common

BITS, SIGNS = 62, 256
BLOCK = 2048
#: Shares of the passes by round; the last round gets the rest.
ROUNDS = (0.1, 0.25)


def planes(dim: int, columns: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, dim, columns)).normal(size=(dim, columns))


def passes_for(rows: int, window: int, least: float, miss: float) -> int:
    """How many passes find all but ``miss`` of the pairs at the threshold."""
    meet = (1 - math.acos(least) / math.pi) ** max(0.0, math.log2(max(rows, 1) / window))
    return max(4, math.ceil(math.log(miss) / math.log(max(1 - meet, 1e-300))))


def most_different(least: float) -> int:
    """In how many signature bits vectors near enough differ at most."""
    p = math.acos(least) / math.pi
    return math.ceil(SIGNS * p + 6 * math.sqrt(SIGNS * p * (1 - p)))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector) to (id, unit): the unit vector's bytes, null where there is none."""
    for batch in batches:
        out = []
        for row in batch.column(1):
            v = row.values
            unit = None
            if v is not None and len(v) and not v.null_count:
                x = v.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all() and (top := np.abs(x).max()) > 0:
                    x = x / top  # no overflow or underflow of the squares
                    unit = (x / np.sqrt(x @ x) + 0.0).tobytes()
            out.append(unit)
        yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["id", "unit"])


def _keys(first: int, passes: int, seed: int):
    """Rows (id, comp, unit) to a row for each of some passes: its bits, and the signature."""
    weights = (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple[list[np.ndarray], np.ndarray]] = {}
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                ids, comp, units = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2).to_pylist()
                sizes = np.array([len(u) // 8 for u in units])
                for dim in np.unique(sizes).tolist():
                    own = np.flatnonzero(sizes == dim)
                    x = np.frombuffer(b"".join(units[k] for k in own)).reshape(-1, dim)
                    if dim not in made:
                        made[dim] = [planes(dim, BITS, seed + 1 + p) for p in range(first, first + passes)], planes(dim, SIGNS, seed)
                    turns, signs = made[dim]
                    n = len(own)
                    marks = pa.array([m.tobytes() for m in np.packbits(x @ signs > 0, axis=1)], pa.binary())
                    for p, turn in enumerate(turns):
                        bits = (x @ turn > 0) @ weights
                        yield pa.record_batch([pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, first + p, np.int32)), pa.array(bits), pa.array(ids[own]), pa.array(comp[own]), marks], names=["dim", "pass", "bits", "id", "comp", "signs"])

    return run, "dim int, pass int, bits long, id long, comp long, signs binary"


def near_pairs(ids: np.ndarray, comp: np.ndarray, signs: np.ndarray, window: int, differ: int, few: bool, new_from: int = 0) -> np.ndarray:
    """Candidates (smaller id, larger id) among rows at most ``window`` apart, the later at ``new_from`` or after, of different components.

    With ``few`` only two for each earlier row: the one that follows next and the one with the fewest bits that differ.
    """
    found = []
    for s in range(max(0, new_from - window), len(ids), 256):
        e, end = min(s + 256, len(ids)), min(s + 256 + window, len(ids))
        apart = np.bitwise_count(signs[s:e, None, :] ^ signs[None, s:end, :]).sum(axis=2, dtype=np.int32)
        place = np.arange(end - s)[None, :] - np.arange(e - s)[:, None]
        ok = (place > 0) & (place <= window) & (apart <= differ) & (comp[s:e, None] != comp[None, s:end]) & (s + np.arange(end - s) >= new_from)[None, :]
        if few:
            some = np.flatnonzero(ok.any(axis=1))
            i = np.r_[some, some]
            j = np.r_[ok[some].argmax(axis=1), np.where(ok[some], apart[some], SIGNS + 1).argmin(axis=1)]
        else:
            i, j = np.nonzero(ok)
        a, b = ids[s + i], ids[s + j]
        found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
    out = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return np.unique(out, axis=1)


def _matrix(signs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signs), np.uint64).reshape(-1, SIGNS // 64)


_SWEPT = "a long, b long, task int, side int, place int, dim int, pass int, id long, comp long, signs binary"


def _sweep(window: int, differ: int, few: bool):
    names = ["a", "b", "task", "side", "place", "dim", "pass", "id", "comp", "signs"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def pairs(found: np.ndarray) -> pa.RecordBatch:
        n = found.shape[1]
        return pa.record_batch([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), *(pa.nulls(n, t) for t in types[2:])], names=names)

    def ends(task: int, side: int, rows: list[tuple]) -> pa.RecordBatch:
        n = len(rows)
        cols = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), [task] * n, [side] * n, list(range(n)), *zip(*rows, strict=True)]
        return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        head: list[tuple] = []
        key, ids, comp, x, last = None, np.zeros(0, np.int64), np.zeros(0, np.int64), _matrix([]), []
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                part = batch.slice(s, 2048)
                dims, turn = part.column(0).to_numpy(), part.column(1).to_numpy()
                now, own_comp, signs = part.column(3).to_numpy(), part.column(4).to_numpy(), part.column(5).to_pylist()
                cuts = np.flatnonzero(np.r_[True, (dims[1:] != dims[:-1]) | (turn[1:] != turn[:-1])]).tolist()
                for a, b in zip(cuts, [*cuts[1:], len(now)], strict=True):
                    own = (int(dims[a]), int(turn[a]))
                    if own != key:
                        key, ids, comp, x, last = own, ids[:0], comp[:0], x[:0], []
                    old = len(ids)
                    ids, comp, x = np.r_[ids, now[a:b]], np.r_[comp, own_comp[a:b]], np.concatenate([x, _matrix(signs[a:b])])
                    found = near_pairs(ids, comp, x, window, differ, few, old)
                    if found.shape[1]:
                        yield pairs(found)
                    ids, comp, x = ids[-window:], comp[-window:], x[-window:]
                    rows = [(*own, int(i), int(c), u) for i, c, u in zip(now[a:b], own_comp[a:b], signs[a:b], strict=True)]
                    head += rows[: max(0, window - len(head))]
                    last = [*last, *rows][-window:]
        if head:
            yield ends(task, 0, [r for r in head if r[:2] == head[0][:2]])
            yield ends(task, 1, last)

    return run, _SWEPT


def _borders(window: int, differ: int, few: bool):
    """Rows (border, side, place, dim, pass, id, comp, signs) of both sides of borders, sorted, to pairs across them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def settle() -> np.ndarray:
            found = []
            before, after = ([r for r in rows if r[0] == s] for s in (0, 1))
            for turn in {r[1] for r in before} & {r[1] for r in after}:
                a, b = ([r for r in side if r[1] == turn] for side in (before, after))
                ids, comp = (np.array([r[k] for r in [*a, *b]]) for k in (2, 3))
                found.append(near_pairs(ids, comp, _matrix([r[4] for r in [*a, *b]]), window, differ, few, len(a)))
            return np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)

        for batch in batches:
            found = []
            for r in batch.to_pylist():
                if r["border"] != key and rows:
                    found.append(settle())
                    rows = []
                key = r["border"]
                rows.append((r["side"], (r["dim"], r["pass"]), r["id"], r["comp"], r["signs"]))
            if found:
                pairs = np.concatenate(found, axis=1)
                yield pa.record_batch([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], names=["a", "b"])
        if rows:
            pairs = settle()
            yield pa.record_batch([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], names=["a", "b"])

    return run, "a long, b long"


def _dots(least: float):
    """(a, b, x, y), pairs with both unit vectors, to those near enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k).to_pylist() for k in (2, 3))
            near = [float(np.frombuffer(p) @ np.frombuffer(q)) >= least for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run, "a long, b long"


def _round(classes: DataFrame, near: DataFrame | None, first: int, passes: int, few: bool, least: float, window: int, seed: int) -> DataFrame:
    """The verified links (a, b) of some passes between different components."""
    spark = classes.sparkSession
    parts, differ = common.partitions(spark), most_different(least)
    own = classes.select(F.col("rep").alias("id"), F.col("rep").alias("comp"), "unit")
    if near is not None:
        own = own.drop("comp").join(near, own.id == near.node, "left").select("id", F.coalesce("component", "id").alias("comp"), "unit")
    run, schema = _keys(first, passes, seed)
    keyed = own.mapInArrow(run, schema)
    ordered = keyed.repartitionByRange(parts, "dim", "pass", "bits", "id").sortWithinPartitions("dim", "pass", "bits", "id")
    run, schema = _sweep(window, differ, few)
    swept = common.saved(ordered.mapInArrow(run, schema), "swept")
    inside = swept.where("a is not null").select("a", "b")
    edge = swept.where("a is null").drop("a", "b")
    ends = edge.groupBy("task", "side").agg(F.count("*"), F.min(F.struct("dim", "pass")), F.max(F.struct("dim", "pass"))).collect()  # two rows a range
    reached = _reached(sorted(tuple(r) for r in ends), window)
    if any(side == 0 for _, side, _ in reached):
        borders = F.broadcast(spark.createDataFrame(reached, "task int, side int, border int"))
        edge = edge.join(borders, ["task", "side"]).select("border", (1 - F.col("side")).alias("side"), "place", "dim", "pass", "id", "comp", "signs", "task")
        run, schema = _borders(window, differ, few)
        across = edge.repartition(parts, "border").sortWithinPartitions("border", "side", "task", "place").drop("task").mapInArrow(run, schema)
        inside = inside.union(across)
    x, y = (classes.select(F.col("rep").alias(k), F.col("unit").alias(u)) for k, u in (("a", "x"), ("b", "y")))
    run, schema = _dots(least)
    links = common.saved(inside.distinct().join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, schema), "links")
    common.release(swept)
    return links


def _block_degrees(least: float):
    """Rows (component, i, j, side, id, m, unit), sorted by the first four, to (id, linked): the rows m linked to id in blocks i and j."""

    def settle(rows: list[tuple], same: bool) -> Iterator[pa.RecordBatch]:
        ids, m = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        x = np.frombuffer(b"".join(r[3] for r in rows)).reshape(len(rows), -1)
        cut = 0 if same else sum(r[0] == 0 for r in rows)
        linked = np.zeros(len(rows), np.int64)
        for s in range(0, len(rows) if same else cut, 256):
            e = min(s + 256, len(rows) if same else cut)
            near = x[s:e] @ x[cut:].T >= least
            if same:
                near[np.arange(e - s), np.arange(s, e)] = False
            linked[s:e] += near @ m[cut:]
            if not same:
                linked[cut:] += m[s:e] @ near
        some = linked > 0
        yield pa.record_batch([pa.array(ids[some]), pa.array(linked[some])], names=["id", "linked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for c, i, j, side, one, m, unit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (c, i, j) != key and rows:
                    yield from settle(rows, key[1] == key[2])
                    rows = []
                key = (c, i, j)
                rows.append((side, one, m, unit))
        if rows:
            yield from settle(rows, key[1] == key[2])

    return run, "id long, linked long"


def _degrees(classes: DataFrame, parts_of: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(id, linked): the rows of other classes of its component that each class is linked to."""
    spark = classes.sparkSession
    sizes = parts_of.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = classes.join(parts_of, F.col("rep") == F.col("node")).join(sizes, "component")
    own = own.withColumn("at", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = own.select("component", F.least("at", "with").alias("i"), F.greatest("at", "with").alias("j"), (F.col("at") > F.col("with")).cast("int").alias("side"), F.col("rep").alias("id"), "m", "unit")
    dealt = dealt.repartition(common.partitions(spark), "component", "i", "j").sortWithinPartitions("component", "i", "j", "side")
    run, schema = _block_degrees(least)
    return dealt.mapInArrow(run, schema).groupBy("id").agg(F.sum("linked").alias("linked"))


def _reached(ends: list, window: int) -> list[tuple[int, int, int]]:
    """Of (task, side, rows, first key, last key) by task and side: (task, side, border), a border being the task before it.

    A range's first rows also reach over shorter ranges before it, as far as the window goes.
    """
    heads, out = [e for e in ends if e[1] == 0], [(e[0], 1, e[0]) for e in ends if e[1] == 1]
    tails = {e[0]: e for e in ends if e[1] == 1}
    for k, head in enumerate(heads):
        between = 0
        for before in reversed(heads[:k]):
            out.append((head[0], 0, before[0]))
            tail = tails[before[0]]
            between += before[2]
            if between >= window or tail[2] != before[2] or before[3] != head[3] or tail[3] != head[3]:
                break
    return out


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, passes: int | None = None, window: int = 128, seed: int = 11, miss: float = 1e-4) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector.

    ``n_links`` counts the other vectors of its component that are near enough
    (copies are linked to all that their class is linked to). Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing,
    as do rows with a null id. Vectors of different dimension are not
    compared. Repeated rows count as vectors of their own. Other columns, of any name, are
    ignored; an empty table gives an empty result. ``passes`` overrides the
    number that follows from ``miss`` and the number of rows.
    """
    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    units = plain.mapInArrow(_units, "id long, unit binary").withColumn("mark", F.sha2("unit", 256))
    valid = units.where("unit is not null and id is not null")
    classes = common.saved(valid.groupBy("mark").agg(F.min("id").alias("rep"), F.count("*").alias("m"), F.any_value("unit").alias("unit")), "classes")
    total = passes or passes_for(classes.count(), window, least, miss)
    cuts = [0, *(math.ceil(sum(ROUNDS[: k + 1]) * total) for k in range(len(ROUNDS))), total]
    near = None
    for k, (first, last) in enumerate(zip(cuts, cuts[1:])):
        if first == last:
            continue
        links = _round(classes, near, first, last - first, k < len(ROUNDS), least, window, seed)
        if near is not None:
            links = links.union(near.select(F.col("node").alias("a"), F.col("component").alias("b")))
        near = common.saved(common.components(links), "components")
    size = classes.select("rep", "m")
    degree = _degrees(classes, near, least).withColumnRenamed("id", "a")
    found = size.join(degree, size.rep == degree.a, "left").join(near, size.rep == near.node, "left")
    found = found.select("rep", (F.col("m") - 1 + F.coalesce("linked", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component"))
    marks = classes.select("mark", "rep").join(found, "rep").select(F.col("mark").alias("of"), "n", "component")
    key = F.when(F.col("id").isNotNull(), F.col("mark"))
    out = units.select("id", key.alias("mark")).join(marks, F.col("mark") == F.col("of"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
