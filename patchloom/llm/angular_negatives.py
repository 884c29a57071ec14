"""Hard negatives of anchors by angular triangle filtering, with exact integer scores.

A component x counts as floor(256 x); the score of two rows is the integer inner
product. The angle between two vectors lies between the difference and the sum of
their angles to any third direction. So with each row's angles to a few reference
directions stored, the cosine of any two rows lies in an interval, and times their
norms it bounds the score. Steps:

1. Reference directions are chosen far apart from a bounded sample (they decide
   how much is pruned, never the result). Every row gets its angles to all of
   them, its norm, and its nearest direction, its cell.
2. Rows are dealt by ranges of (cell, angle to its direction, id) and packed into
   windows of at most ``WINDOW`` rows of one cell, in the order of that angle. The id
   lets equal vectors be dealt too. Anchors take from their own window a first
   bound: the score of their fifth best row of the same label there.
3. Groups of anchors meet runs of windows, block by block, every anchor every
   window. For each anchor the window's intervals of angles and norms bound
   the scores; only anchors whose wanted range overlaps are scored against the
   window, and of the window only the stretch whose angles can reach the range.
   Bounds are widened by more than the rounding of what is stored.
4. First the best rows of the same label are found (the positives), then for
   each positive the best rows of other labels within its range. A task passes
   on no more than it may need of its own windows; ranks come from the merge.

Scores are sums of products of whole numbers below 2**53 in all, so exact in
double precision; otherwise 64-bit integers are used, and vectors whose scores
could pass 62 bits raise an error.

Defined results: rows with a null id, label or vector, or with a null or
non-finite component take no part; a shorter vector counts as filled up with
zeros; vectors of zeros score 0; of several rows with one id the least
(label, vector) takes part; ties go to the smaller id; an anchor without
positives, or a positive without negatives in its range, gives no row; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchloom.llm.common import staged

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: A negative's score is at least so many hundredths of the positive's.
LEAST_PERCENT = 80
ANCHOR_EVERY = 100
#: Reference directions, and the rows they are chosen from.
DIRECTIONS = 16
SAMPLE = 1024
WINDOW = 2048
#: Anchors that a task holds; it scores ``ANCHOR_BLOCK`` of them at a time.
ANCHORS = 32_768
ANCHOR_BLOCK = 1024
#: Runs of windows, at most: a group of anchors is met by so many tasks.
RUNS = 64
#: More than the rounding of stored angles (single precision) and of cosines.
ANGLE_SLACK = 1e-5
#: Below every score.
NONE = -(1 << 62)

_PACKED = "cell int, window long, kind int, ids binary, labels binary, vectors binary, norms binary, angles binary, seeds binary"


# ---- rows

def _valid(df: DataFrame, vector: str, label: str, vec_id: str) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part."""
    x = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = x.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    again = staged(x.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("vec_id"), "repeated_ids")
    if not again.count():
        return x
    chosen = x.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("m")).select("vec_id", "m.label", "m.vector")
    return x.join(again, "vec_id", "left_anti").unionAll(chosen)


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """floor(256 x) of the rows' components, filled up with zeros."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.floor(np.asarray(column.flatten()) * SCALE)
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def far_directions(sample: np.ndarray, n: int) -> np.ndarray:
    """Unit vectors of up to ``n`` rows, each the farthest from those before it."""
    norms = np.linalg.norm(sample, axis=1)
    unit = sample[norms > 0] / norms[norms > 0, None]
    if not len(unit):
        return np.eye(1, sample.shape[1])
    chosen = [0]
    nearest = unit @ unit[0]
    while len(chosen) < min(n, len(unit)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return unit[chosen]


def _with_angles(rows: DataFrame, dims: int, kind: str, directions: np.ndarray) -> DataFrame:
    names = ["vec_id", "label", "cell", "theta", "norm", "q", "angles"]

    def run(batches):
        for b in batches:
            q = _matrix(b.column(2), dims)
            norm = np.linalg.norm(q, axis=1)
            cosine = (q @ directions.T) / np.where(norm > 0, norm, 1)[:, None]
            angles = np.arccos(np.clip(cosine, -1, 1)).astype(np.float32)
            cell = np.argmin(angles, axis=1)
            packed = [pa.array([x.tobytes() for x in m], pa.binary()) for m in (q.astype(kind), angles)]
            theta = pa.array(angles[np.arange(len(q)), cell].astype(np.float64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), theta, pa.array(norm), *packed], names)

    return rows.mapInArrow(run, "vec_id long, label long, cell int, theta double, norm double, q binary, angles binary")


def _product(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Scores as whole numbers in double precision if they fit, else as 64-bit integers."""
    return a.astype(np.float64) @ b.astype(np.float64).T if exact else a.astype(np.int64) @ b.astype(np.int64).T


def _packed_windows(kind: str, dims: int, exact: bool, every: int, size: int):
    names = [c.split()[0] for c in _PACKED.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 6]

    def run(batches):
        """Rows sorted by (cell, theta, vec_id): windows (kind 1) and their anchors (kind 0)."""
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held, cell = [], None

        def window():
            nonlocal number
            ids, labels, norms = (np.concatenate([np.asarray(h.column(i)) for h in held]) for i in (0, 1, 4))
            q, angles = (b"".join(x for h in held for x in h.column(i).to_pylist()) for i in (5, 6))
            number += 1
            rows = [(cell, number, 1, ids.tobytes(), labels.tobytes(), q, norms.tobytes(), angles, None)]
            at = np.flatnonzero(ids % every == 0)
            if len(at):
                m, t = np.frombuffer(q, kind).reshape(-1, dims), np.frombuffer(angles, np.float32).reshape(len(ids), -1)
                s = _product(m[at], m, exact).astype(np.int64)
                s[(labels[at][:, None] != labels) | (ids[at][:, None] == ids)] = NONE
                seed = np.partition(s, -POSITIVES, axis=1)[:, -POSITIVES] if s.shape[1] >= POSITIVES else np.full(len(at), NONE)
                rows.append((cell, number, 0, *(x.tobytes() for x in (ids[at], labels[at], m[at], norms[at], t[at], seed))))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)

        for b in batches:
            cells = np.asarray(b.column(2))
            start = 0
            while start < len(cells):
                if held and cells[start] != cell:
                    yield window()
                    held = []
                cell = int(cells[start])
                room = size - sum(h.num_rows for h in held)
                other = np.flatnonzero(cells[start:] != cell)
                n = min(room, int(other[0]) if len(other) else len(cells) - start)
                held.append(b.slice(start, n))
                start += n
                if n == room:
                    yield window()
                    held = []
        if held:
            yield window()

    return run


# ---- anchors against windows

class _Rows:
    """Anchors, or the rows of a window, from their packed columns."""

    def __init__(self, parts: list[tuple], kind: str, dims: int):
        column = lambda i, k: np.frombuffer(b"".join(p[i] for p in parts), k)
        self.ids, self.labels = column(0, np.int64), column(1, np.int64)
        self.q, self.norms = column(2, kind).reshape(-1, dims), column(3, np.float64)
        self.angles = column(4, np.float32).reshape(len(self.ids), -1).astype(np.float64)
        self.seeds = column(5, np.int64) if parts[0][5] is not None else None


def score_bounds(norms: np.ndarray, angles: np.ndarray, w: _Rows) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the least and greatest score that a row of the window can have."""
    low, high = w.angles.min(0), w.angles.max(0)
    small, large = w.norms.min(), w.norms.max()
    nearest = np.clip(np.maximum(angles - high, low - angles).max(1) - ANGLE_SLACK, 0, np.pi)
    farthest = np.clip(np.minimum(angles + high, 2 * np.pi - angles - low).min(1) + ANGLE_SLACK, 0, np.pi)
    up, down = np.cos(nearest), np.cos(farthest)
    greatest = norms * up * np.where(up >= 0, large, small)
    least = norms * down * np.where(down >= 0, small, large)
    slack = 1 + 1e-9 * norms * large
    return np.floor(least - slack), np.ceil(greatest + slack)


def stretches(norms: np.ndarray, angles: np.ndarray, need: np.ndarray, w: _Rows, cell: int) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the first and last row of the window, in its order of angles, that can score ``need``."""
    theta = w.angles[:, cell]
    reach = norms * w.norms.max()
    least = np.where(need > 0, np.divide(need - 1, reach, out=np.ones_like(reach), where=reach > 0), -1.0)
    width = np.arccos(np.clip(least, -1, 1)) + 2 * ANGLE_SLACK
    mine = angles[:, cell]
    return np.searchsorted(theta, mine - width, "left"), np.searchsorted(theta, mine + width, "right")


class _Best:
    """For each of several lists the first ``size`` (score, id): higher scores first, then smaller ids."""

    def __init__(self, lists: int, size: int):
        self.size = size
        self.scores, self.ids = np.full((lists, size), NONE), np.full((lists, size), np.iinfo(np.int64).max)

    def least(self) -> np.ndarray:
        """The score from which on a row may enter each list."""
        return self.scores[:, -1]

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(at):
            return
        lists = np.unique(at)
        at = np.concatenate([at, np.repeat(lists, self.size)])
        scores = np.concatenate([scores.astype(np.int64), self.scores[lists].ravel()])
        ids = np.concatenate([ids, self.ids[lists].ravel()])
        order = np.lexsort((ids, -scores, at))
        at, scores, ids = at[order], scores[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        keep = rank < self.size
        self.scores[at[keep], rank[keep]] = scores[keep]
        self.ids[at[keep], rank[keep]] = ids[keep]


class _Positives:
    """The best rows of the anchors' own labels."""

    def __init__(self, anchors: _Rows, ranges: dict, exact: bool):
        self.a, self.exact = anchors, exact
        self.best = _Best(len(anchors.ids), POSITIVES)

    def meet(self, w: _Rows, cell: int) -> None:
        a = self.a
        _, up = score_bounds(a.norms, a.angles, w)
        need = np.maximum(a.seeds, self.best.least())
        active = np.flatnonzero((up >= need) & np.isin(a.labels, w.labels))
        for k in range(0, len(active), ANCHOR_BLOCK):
            i = active[k : k + ANCHOR_BLOCK]
            first, last = stretches(a.norms[i], a.angles[i], need[i], w, cell)
            s, e = int(first.min()), int(last.max())
            if s >= e:
                continue
            scores = _product(a.q[i], w.q[s:e], self.exact)
            x, y = np.nonzero((scores >= need[i][:, None]) & (a.labels[i][:, None] == w.labels[s:e]) & (a.ids[i][:, None] != w.ids[s:e]))
            self.best.add(i[x], scores[x, y], w.ids[s + y])

    def rows(self):
        x, y = np.nonzero(self.best.scores > NONE)
        return [self.a.ids[x], np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), self.best.ids[x, y], self.best.scores[x, y]]


class _Negatives:
    """For each positive of an anchor the best rows of other labels within the positive's range."""

    def __init__(self, anchors: _Rows, ranges: dict, exact: bool):
        self.a, self.exact = anchors, exact
        n = len(anchors.ids)
        self.positive, self.top = np.zeros((n, POSITIVES), np.int64), np.full((n, POSITIVES), -1, np.int64)
        for i, d in enumerate(anchors.ids.tolist()):
            for j, (p, s) in enumerate(ranges.get(d, ())):
                self.positive[i, j], self.top[i, j] = p, s
        # a negative score has no rows in its range, like an empty place
        whole, part = np.divmod(self.top, 100)  # no product passes 64 bits
        self.low = np.where(self.top >= 0, whole * LEAST_PERCENT - (-part * LEAST_PERCENT // 100), -NONE)
        self.best = _Best(n * POSITIVES, NEGATIVES)

    def meet(self, w: _Rows, cell: int) -> None:
        a = self.a
        down, up = score_bounds(a.norms, a.angles, w)
        need = np.maximum(self.low, self.best.least().reshape(self.low.shape))
        least = need.min(1)
        active = np.flatnonzero((up >= least) & (down <= self.top.max(1)))
        for k in range(0, len(active), ANCHOR_BLOCK):
            i = active[k : k + ANCHOR_BLOCK]
            first, last = stretches(a.norms[i], a.angles[i], least[i], w, cell)
            s, e = int(first.min()), int(last.max())
            if s >= e:
                continue
            scores = _product(a.q[i], w.q[s:e], self.exact)
            # one pass over all scores, then the few that lie in some range, positive by positive
            x, y = np.nonzero((scores >= least[i][:, None]) & (scores <= self.top[i].max(1)[:, None]) & (a.labels[i][:, None] != w.labels[s:e]))
            value, ids = scores[x, y], w.ids[s + y]
            for j in range(POSITIVES):
                fits = (value >= need[i[x], j]) & (value <= self.top[i[x], j])
                self.best.add(i[x[fits]] * POSITIVES + j, value[fits], ids[fits])

    def rows(self):
        x, y = np.nonzero(self.best.scores > NONE)
        i, j = x // POSITIVES, x % POSITIVES
        return [self.a.ids[i], self.positive[i, j], self.top[i, j], self.best.ids[x, y], self.best.scores[x, y]]


def _meetings(search, kind: str, dims: int, exact: bool):
    names = ["group", "anchor_id", "positive_id", "positive_score", "vec_id", "score"]

    def run(batches):
        """Rows sorted by (group, run, kind): anchors (0), their positives (1), windows (2)."""
        now, parts, ranges, held = None, [], {}, None

        def result():
            columns = held.rows()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), now[0], np.int32)), *map(pa.array, columns)], names)

        for b in batches:
            for r in b.to_pylist():
                if (r["group"], r["run"]) != now:
                    if held is not None:
                        yield from result()
                    now, parts, ranges, held = (r["group"], r["run"]), [], {}, None
                packed = (r["ids"], r["labels"], r["vectors"], r["norms"], r["angles"], r["seeds"])
                if r["kind"] == 0:
                    parts.append(packed)
                elif r["kind"] == 1:
                    ranges[r["anchor_id"]] = [(p["vec_id"], p["score"]) for p in r["positives"]]
                elif parts:
                    held = held or search(_Rows(parts, kind, dims), ranges, exact)
                    held.meet(_Rows([packed], kind, dims), r["cell"])
        if held is not None:
            yield from result()

    return run


def hard_negatives(df: DataFrame, vector: str = "embedding", label: str = "label", vec_id: str = "vec_id", anchor_every: int = ANCHOR_EVERY, window: int = WINDOW) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is a multiple of ``anchor_every``.
    """
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark = df.sparkSession
    rows = staged(_valid(df, vector, label, vec_id), "vectors")
    biggest = F.max(F.coalesce(F.array_max(F.transform("vector", F.abs)), F.lit(0.0)))
    n, dims, largest = rows.agg(F.count(F.lit(1)), F.max(F.size("vector")), biggest).first()
    if not n:
        return spark.createDataFrame([], schema)
    dims, largest = max(1, dims), np.ceil(largest * SCALE) + 1
    if not dims * largest**2 < 2.0**62:
        raise ValueError("components too large for scores of 64 bits")
    exact = dims * largest**2 < 2.0**53
    kind = "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8"
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow().column(0).combine_chunks()
    sample = sample if isinstance(sample, pa.ListArray) else sample.chunk(0)
    directions = far_directions(_matrix(sample, dims), DIRECTIONS)

    placed = staged(_with_angles(rows, dims, kind, directions), "angles")
    parts = max(1, -(-n // (4 * window)))
    dealt = placed.repartitionByRange(parts, "cell", "theta", "vec_id").sortWithinPartitions("cell", "theta", "vec_id")
    windows = staged(dealt.mapInArrow(_packed_windows(kind, dims, exact, anchor_every, window), _PACKED), "angular_windows")
    held = windows.filter("kind = 1").count()
    groups, runs = max(1, -(-(n // anchor_every) // ANCHORS)), min(RUNS, held)

    packed = ["ids", "labels", "vectors", "norms", "angles", "seeds"]
    of_group = F.pmod(F.xxhash64("window"), F.lit(groups)).cast("int").alias("group")
    every_run, every_group = (F.explode(F.sequence(F.lit(0), F.lit(k - 1))) for k in (runs, groups))
    no_positives = F.lit(None).cast("array<struct<vec_id:long,score:long>>").alias("positives")
    no_anchor = F.lit(None).cast("long").alias("anchor_id")
    anchors = windows.filter("kind = 0").select(of_group, every_run.alias("run"), F.lit(0).alias("kind"), "cell", *packed, no_anchor, no_positives)
    against = windows.filter("kind = 1").select(every_group.alias("group"), F.pmod(F.xxhash64("window"), F.lit(runs)).cast("int").alias("run"), F.lit(2).alias("kind"), "cell", *packed, no_anchor, no_positives)

    def met(stream: DataFrame, search) -> DataFrame:
        stream = stream.repartition(groups * runs, "group", "run").sortWithinPartitions("group", "run", "kind")
        return stream.mapInArrow(_meetings(search, kind, dims, exact), "group int, anchor_id long, positive_id long, positive_score long, vec_id long, score long")

    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    found = met(anchors.unionAll(against), _Positives).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= POSITIVES)
    positives = found.groupBy("group", "anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("p"))
    positives = staged(positives.select("group", "anchor_id", F.transform("p", lambda p: F.struct(p["vec_id"].alias("vec_id"), p["score"].alias("score"))).alias("positives")), "positives")
    ranges = positives.select("group", every_run.alias("run"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("cell"), *(F.lit(None).cast("binary").alias(c) for c in packed), "anchor_id", "positives")

    rank = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    negatives = met(anchors.unionAll(ranges).unionAll(against), _Negatives).withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= NEGATIVES)
    return negatives.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
