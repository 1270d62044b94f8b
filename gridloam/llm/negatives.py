"""Hard negatives by a distributed kNN join over Voronoi cells.

Highest inner products become nearest neighbours: every candidate x gets one more component, sqrt(M^2 - |x|^2), with
the largest length M, and every anchor a gets 0 there, so that |a - x|^2 = |a|^2 + M^2 - 2 <a, x>. Candidates are
assigned to the nearest of some pivots and sorted within their cell by the distance to it into blocks, each a ring of
its cell; anchors are sorted alike into groups. A group is first held against one block near it, which gives each of
its anchors a k-th best score. A cell's ring can serve an anchor only if the triangle inequality and the bisector of the
two pivots leave it within the distance of that score, so the candidates of the other rings aren't copied to the group.
The rest is an exact local join of groups and blocks, whose parts are merged.

Two such joins are made. Positives are the best rows of an anchor's label; labels are dealt to buckets, so that rare ones
meet few others. Negatives are the best rows of other labels whose score lies in a band of the positive's score.

Rows with a null id, label or vector, a null or non-finite component or no component take no part; vectors meet those
with as many components only. Labels are whole numbers. Rows with the anchor's own id are never its positives, nor are
its negatives. A repeated row is a candidate as often as it comes and, if an anchor, one for each time. Ties go to
smaller ids. Scores are exact at any size of the components; one that no long holds is compared as the nearest long. The
pivots (at most `PIVOTS`, for the eight dimensions with the most rows; one at 0 for others) decide the cost alone, never
the result. The bounds of dimensions come to the driver, one row for each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloam.llm.common import stored, tidy
from gridloam.llm.vectors import EXACT, UNIT, integer_vectors, integers, matrix

#: Candidates in a block, anchors in a group, blocks that a task holds against a group, pivots.
BLOCK, GROUP, SLICE, PIVOTS = 4096, 1024, 256, 256
#: Groups whose best candidates a task holds at a time.
HELD = 32
#: Slack of squared distances, in units of M^2, and of distances: one near 0 comes from a difference near 0, and so has an
#: error of the root of a double's. The bisector of pivots that are nearer than `APART` isn't used.
SLACK_2, SLACK, APART = 1e-9, 1e-6, 1e-3
_LEAST, _MOST = -(2**63), 2**63 - 1


class Space:
    """The dimensions that were met: their scale and pivots."""

    def __init__(self, largest: dict[int, float], pivots: dict[int, np.ndarray]):
        self.largest = {d: v or 1.0 for d, v in largest.items()}
        self.pivots = {}
        for d in largest:
            at = pivots.get(d)
            self.pivots[d] = self.lifted(np.zeros((1, d)) if at is None else at, d)

    def lifted(self, m: np.ndarray, dim: int) -> np.ndarray:
        """Candidates (components over UNIT) with their last component, in units of M."""
        y = m / self.largest[dim]
        return np.hstack([y, np.sqrt(np.maximum(0.0, 1.0 - (y**2).sum(1)))[:, None]])

    def nearest(self, m: np.ndarray, dim: int, cells: int, anchors: bool) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its pivot) of each vector, by the first `cells` pivots."""
        y = np.hstack([m / self.largest[dim], np.zeros((len(m), 1))]) if anchors else self.lifted(m, dim)
        d = distances(y, self.pivots[dim][:cells])
        return d.argmin(1), d.min(1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a**2).sum(1)[:, None] - 2 * (a @ b.T) + (b**2).sum(1)))


def _length(m: np.ndarray) -> np.ndarray:
    most = np.abs(m).max(1, initial=0.0)
    return np.sqrt(((m / np.maximum(most, 1e-300)[:, None]) ** 2).sum(1)) * most


def _groups(raws: list[bytes], dims: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, positions, components over UNIT) of vectors of any dimension."""
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        yield d, at, matrix([raws[i] for i in at.tolist()], d)[0]


def space_of(rows: DataFrame) -> Space:
    """The largest length for each dimension, and a sample of vectors as pivots."""

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, list] = {}
        for b in batches:
            for d, at, m in _groups(b.column(1).to_pylist(), b.column(0).to_numpy()):
                with np.errstate(over="ignore"):
                    had, n = most.get(d, (0.0, 0))
                    most[d] = [max(had, float(_length(m).max())), n + len(at)]
        yield pa.RecordBatch.from_pydict({"dim": pa.array(list(most), pa.int32()), "m": pa.array([m for m, _ in most.values()], pa.float64()), "n": pa.array([n for _, n in most.values()], pa.int64())})

    found = rows.select("dim", "x").mapInArrow(tidy(longest), "dim int, m double, n long").groupBy("dim").agg(F.max("m").alias("m"), F.sum("n").alias("n")).collect()
    pivots = {}
    for r in sorted(found, key=lambda r: (-r["n"], r["dim"]))[:8]:
        many = min(PIVOTS, r["n"] // BLOCK)
        if many > 1:
            got = rows.where(F.col("dim") == r["dim"]).select("x").orderBy(F.xxhash64("id", "x"), "x").limit(many).collect()
            pivots[r["dim"]] = matrix([bytes(x["x"]) for x in got], r["dim"])[0]
    return Space({r["dim"]: float(np.nextafter(min(r["m"], 1.7e308), np.inf)) for r in found}, pivots)


def dealt(rows: DataFrame, space: Space, cells: int, anchors: bool) -> DataFrame:
    """(row, id, label, bucket, dim, cell, dist, x): rows with their cell and the distance to its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, dist = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for d, at, m in _groups(b.column("x").to_pylist(), b.column("dim").to_numpy()):
                cell[at], dist[at] = space.nearest(m, d, cells, anchors)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(dist)], [*b.schema.names, "cell", "dist"])

    rows = rows.select("row", "id", "label", "bucket", "dim", "x")
    return rows.mapInArrow(tidy(run), "row long, id long, label long, bucket long, dim int, x binary, cell int, dist double")


#: What a block of candidates, or a group of anchors, is made of; `x` is the vectors one after the other.
_BLOCK = "part long, bucket long, dim int, cell int, lo double, hi double, rows binary, ids binary, labels binary, width int, x binary"


def blocks(dealt_rows: DataFrame, most: int, by_cell: bool, parts: int) -> DataFrame:
    """Blocks of at most `most` rows of one bucket and dimension (and cell), in order of cell and distance.

    A range partitioning by all of these and a hash of the row splits cells of any size, equal vectors too.
    """

    def cut(held: list[dict]) -> dict:
        dim, raws = held[0]["dim"], [r["x"] for r in held]
        width = max(len(r) // dim for r in raws)
        if width < 8:
            x = np.array([integers(r, dim) for r in raws], f"<i{width}") if any(len(r) // dim != width for r in raws) else b"".join(raws)
            x = x if isinstance(x, bytes) else x.tobytes()
        else:
            x = matrix(raws, dim)[0].astype("<f8").tobytes()
        out = {c: np.array([r[c[:-1]] for r in held], "<i8").tobytes() for c in ("rows", "ids", "labels")}
        dist = [r["dist"] for r in held]
        return out | {"bucket": held[0]["bucket"], "dim": dim, "cell": held[0]["cell"], "lo": min(dist), "hi": max(dist), "width": width, "x": x}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, held, at = TaskContext.get().partitionId(), 0, [], None
        schema = pa.schema([("part", pa.int64()), ("bucket", pa.int64()), ("dim", pa.int32()), ("cell", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("rows", pa.binary()), ("ids", pa.binary()), ("labels", pa.binary()), ("width", pa.int32()), ("x", pa.binary())])

        def done() -> pa.RecordBatch:
            nonlocal made, held
            out = pa.RecordBatch.from_pylist([cut(held) | {"part": (task << 32) + made}], schema)
            made, held = made + 1, []
            return out

        for b in batches:
            for r in b.to_pylist():
                key = (r["bucket"], r["dim"], r["cell"] if by_cell else 0)
                if held and (key != at or len(held) >= most):
                    yield done()
                at = key
                held.append(r)
        if held:
            yield done()

    order = ["bucket", "dim", "cell", "dist", F.xxhash64("row")]
    spread = dealt_rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return spread.mapInArrow(tidy(run), _BLOCK)


def _ints(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


def _vectors(raw: bytes, width: int, dim: int) -> np.ndarray:
    """Components over UNIT."""
    return np.frombuffer(raw, "<f8").reshape(-1, dim) if width == 8 else np.frombuffer(raw, f"<i{width}").reshape(-1, dim) / UNIT


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a with all rows of c, both over UNIT; longs, held at a long's ends."""
    dim = a.shape[1]
    a_most, c_most = (np.abs(m).max(1, initial=0.0) * UNIT for m in (a, c))
    with np.errstate(over="ignore", invalid="ignore"):
        far = a_most[:, None] * c_most * dim >= EXACT if a_most.max(initial=0) * c_most.max(initial=0) * dim >= EXACT else None
        s = (a * UNIT) @ (c * UNIT).T
    if far is None:
        return s.astype(np.int64)
    out = np.where(far, 0.0, s).astype(np.int64)
    left, right = ({i: integers(m[i].astype("<f8").tobytes(), dim) for i in np.flatnonzero(far.any(axis)).tolist()} for m, axis in ((a, 1), (c, 0)))
    for i, j in zip(*(x.tolist() for x in np.nonzero(far)), strict=True):
        out[i, j] = max(_LEAST, min(_MOST, sum(x * y for x, y in zip(left[i], right[j], strict=True))))
    return out


class Best:
    """The k best candidates so far for each slot: an anchor and a band of scores."""

    def __init__(self, group, k: int, same: bool):
        self.k, self.same = k, same
        self.rows, self.ids, self.labels = (_ints(x) for x in (group.rows, group.ids, group.labels))
        self.a = _vectors(group.x, group.width, group.dim)
        self.anchor, self.slot = _ints(group.anchors), _ints(group.slots)
        self.low, self.high = _ints(group.low).copy(), _ints(group.high)
        self.best: list[np.ndarray] = [np.zeros(0, np.int64)] * 3  # slot's position, score, id

    def meet(self, block) -> None:
        ids, labels = _ints(block.c_ids), _ints(block.c_labels)
        s = products(self.a, _vectors(block.c_x, block.c_width, block.dim))
        allowed = (self.labels[:, None] == labels) == self.same
        allowed &= self.ids[:, None] != ids
        found = [self.best]
        for nth in range(int(self.slot.max(initial=-1)) + 1):
            at = np.flatnonzero(self.slot == nth)
            who = self.anchor[at]
            mine, low, high = s[who], self.low[at][:, None], self.high[at][:, None]
            fit = allowed[who] & (mine >= low) & (mine <= high)
            many = np.flatnonzero(fit.sum(1) > 4 * self.k)
            if len(many):  # only what reaches the k-th best of this block
                kept = np.where(fit[many], mine[many], _LEAST)
                kth = np.partition(kept, kept.shape[1] - self.k, axis=1)[:, kept.shape[1] - self.k]
                fit[many] &= mine[many] >= kth[:, None]
            i, j = np.nonzero(fit)
            found.append([at[i], mine[i, j], ids[j]])
        slot, score, cid = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((cid, -score.astype(np.float64), slot)) if len(score) and np.abs(score.astype(np.float64)).max() < EXACT else np.lexsort((cid, ~score, slot))
        slot, score, cid = slot[order], score[order], cid[order]
        first = np.searchsorted(slot, np.arange(len(self.slot)))
        nth = np.arange(len(slot)) - first[slot] if len(slot) else slot
        keep = nth < self.k
        self.best = [slot[keep], score[keep], cid[keep]]
        full = np.flatnonzero(nth == self.k - 1)
        self.low[slot[full]] = np.maximum(self.low[slot[full]], score[full])

    def rows_out(self, group: int) -> dict:
        slot, score, cid = self.best
        return {"part": np.full(len(slot), group), "at": slot, "row": self.rows[self.anchor[slot]], "slot": self.slot[slot], "id": cid, "score": score}


_HIT = "part long, at long, row long, slot long, id long, score long"
_GROUP = ("part", "dim", "rows", "ids", "labels", "width", "x", "anchors", "slots", "low", "high")


def _held(k: int, same: bool):
    """The local join over rows that hold a group and a block; the best of a group so far raise its floors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, Best] = {}
        for pdf in batches:
            for r in pdf.itertuples():
                if r.part not in held:
                    if len(held) >= HELD:
                        gone = next(iter(held))
                        yield pd.DataFrame(held.pop(gone).rows_out(gone))
                    held[r.part] = Best(r, k, same)
                held[r.part].meet(r)
        for part, best in held.items():
            yield pd.DataFrame(best.rows_out(part))

    return tidy(run)


def _reach(space: Space, cells: int):
    """(part, dim, bucket, cell, near, far): the rings of each cell that can serve an anchor of the group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for g in pdf.itertuples():
                anchor, low = _ints(g.anchors), _ints(g.low).astype(np.float64)
                if not len(anchor):
                    continue
                pivots, largest = space.pivots[g.dim][:cells], space.largest[g.dim]
                y = np.hstack([_vectors(g.x, g.width, g.dim) / largest, np.zeros((len(_ints(g.rows)), 1))])
                d = distances(y, pivots)[anchor]
                bound = (y**2).sum(1)[anchor] + 1.0 - 2 * ((low / UNIT / largest) / UNIT / largest)
                # every distance is at most 2
                radius = np.where(low <= float(_LEAST), 2.0, np.sqrt(np.clip(bound + SLACK_2, 0.0, 4.0)))[:, None] + SLACK
                home = d.argmin(1)
                apart = distances(pivots, pivots)[home]
                with np.errstate(divide="ignore", invalid="ignore"):
                    beyond = (d**2 - d[np.arange(len(d)), home][:, None] ** 2) / (2 * apart)
                serves = ~((beyond > radius) & (apart > APART))
                for c in np.flatnonzero(serves.any(0)).tolist():
                    at = serves[:, c]
                    out.append((g.part, g.dim, g.bucket, c, float((d[at, c] - radius[at, 0]).min()), float((d[at, c] + radius[at, 0]).max())))
            yield pd.DataFrame(out, columns=["part", "dim", "bucket", "cell", "near", "far"])

    return run


def knn_join(groups: DataFrame, candidates: DataFrame, space: Space, cells: int, k: int, same: bool) -> DataFrame:
    """(row, slot, id, score, nth): the k best candidates of each slot of each anchor.

    Both are stored tables: blocks of anchors with their slots, and blocks of candidates.
    """
    spark = groups.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["bucket", "dim", "cell"]
    meta = candidates.select(*keys, "lo", "hi", F.col("part").alias("block"))
    given = candidates.select(F.col("part").alias("block"), F.col("ids").alias("c_ids"), F.col("labels").alias("c_labels"), F.col("width").alias("c_width"), F.col("x").alias("c_x"))
    slices = max(1, -(-candidates.count() // SLICE))

    def local(pairs: DataFrame, of: DataFrame) -> DataFrame:
        full = pairs.join(of.select(*_GROUP), "part").join(given, "block")
        full = full.repartition(spread, "part", F.pmod(F.xxhash64("block"), F.lit(slices)))
        return full.select(*_GROUP, "c_ids", "c_labels", "c_width", "c_x").mapInPandas(_held(k, same), _HIT)

    # one block near each group: in the cell of its first anchor, the ring nearest to that one
    near = groups.select("part", *keys, F.col("lo").alias("at")).join(meta, keys)
    middle = F.abs((F.col("lo") + F.col("hi")) / 2 - F.col("at"))
    first = stored(near.groupBy("part").agg(F.min_by("block", F.struct(middle, "block")).alias("block")), "first")
    seed = stored(local(first, groups), "seed")

    def raised(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return left
        low = _ints(left["low"].iloc[0]).copy()
        kth = right.groupby("at")["score"].agg(["size", "min"])
        kth = kth[kth["size"] >= k]
        at = kth.index.to_numpy(np.int64)
        low[at] = np.maximum(low[at], kth["min"].to_numpy(np.int64))
        return left.assign(low=[low.tobytes()])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.schema)
    raised_groups = stored(groups.groupBy("part").cogroup(seed.groupBy("part")).applyInPandas(raised, kind), "groups")
    reach = raised_groups.mapInPandas(_reach(space, cells), "part long, dim int, bucket long, cell int, near double, far double")
    pairs = reach.join(meta, keys).where("hi >= near and lo <= far").select("part", "block")
    pairs = pairs.join(first, ["part", "block"], "left_anti")
    hits = seed.unionByName(local(pairs, raised_groups))
    order = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "id")
    return hits.select("row", "slot", "id", "score", F.row_number().over(order).alias("nth")).where(F.col("nth") <= k)


def _with_slots(groups: DataFrame, bands: DataFrame | None) -> DataFrame:
    """Groups with their slots: one for each anchor without limits, or one for each (row, slot, low, high) of `bands`."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame | None) -> pd.DataFrame:
        if left.empty:
            return left.assign(anchors=b"", slots=b"", low=b"", high=b"")
        rows = _ints(left["rows"].iloc[0])
        if right is None:
            anchors, slots = np.arange(len(rows)), np.zeros(len(rows), np.int64)
            low, high = np.full(len(rows), _LEAST), np.full(len(rows), _MOST)
        else:
            order = np.argsort(rows)
            anchors = order[np.searchsorted(rows[order], right["row"].to_numpy(np.int64))]
            slots, low, high = (right[c].to_numpy(np.int64) for c in ("slot", "low", "high"))
        packed = {n: [np.ascontiguousarray(v, "<i8").tobytes()] for n, v in (("anchors", anchors), ("slots", slots), ("low", low), ("high", high))}
        return left.assign(**packed)

    kind = _BLOCK + ", anchors binary, slots binary, low binary, high binary"
    if bands is None:
        return groups.groupBy("part").applyInPandas(lambda pdf: run(None, pdf, None), kind)
    # the group of each anchor; a group has at most GROUP anchors
    where = groups.select("part", F.explode(F.col("members")).alias("row"))
    bands = stored(bands.join(where, "row"), "bands")
    return groups.drop("members").groupBy("part").cogroup(bands.groupBy("part")).applyInPandas(run, kind)


def _members(groups: DataFrame) -> DataFrame:
    """Groups with the rows of their anchors as an array of longs."""

    @F.pandas_udf("array<long>")
    def numbers(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: _ints(b).tolist())

    return groups.withColumn("members", numbers("rows"))


def mine(df: DataFrame, is_anchor: Callable[[Column], Column], key: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = UNIT) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each anchor and each of its first `positives` rows of its label, the first `negatives` rows of other labels
    whose score is from `low` to `high` percent of the positive's.
    """
    spark = df.sparkSession
    kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    df = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector")).where("id is not null and label is not null")
    rows = integer_vectors(df, "vector", ["id", "label"], scale=scale).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows.withColumn("anchor", is_anchor(F.col("id"))), "rows")
    n, labels = rows.agg(F.count("*"), F.approx_count_distinct("label")).first()
    if not n:
        return spark.createDataFrame([], kinds)
    space = space_of(rows)
    pivots = max(len(p) for p in space.pivots.values())
    anchors = rows.where("anchor")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (16 * BLOCK)))

    def joined(bucket: Column, cells: int, k: int, same: bool, bands: DataFrame | None) -> DataFrame:
        held = rows.withColumn("bucket", bucket)
        made = stored(blocks(dealt(held, space, cells, False), BLOCK, True, parts), "blocks")
        groups = stored(blocks(dealt(anchors.withColumn("bucket", bucket), space, cells, True), GROUP, False, max(1, parts // 8)), "anchors")
        groups = stored(_with_slots(groups if bands is None else _members(groups), bands), "slots")
        return knn_join(groups, made, space, cells, k, same)

    buckets = max(1, min(labels, n // BLOCK))
    near = joined(F.pmod(F.xxhash64("label"), F.lit(buckets)), max(1, min(pivots, n // (buckets * BLOCK))), positives, True, None)
    # whole numbers from low to high percent of the positive's score; none where that score is negative
    percent = F.col("score").cast("decimal(20,0)")
    near = stored(near.withColumn("low", F.ceil(percent * low / 100).cast("long")).withColumn("high", F.floor(percent * high / 100).cast("long")), "positives")
    bands = near.where("low <= high").select("row", F.col("nth").cast("long").alias("slot"), "low", "high")
    far = joined(F.lit(0).cast("long"), pivots, negatives, False, bands)
    named = near.select("row", F.col("nth").cast("long").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.join(named, ["row", "slot"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", F.col("nth").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
