"""Patch vectors, principal components and clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from rasterlake.functions import neighbourhood
from rasterlake.grid import KEYS
from rasterlake.plans import batches_of, cut


def patches(cells: DataFrame, size: int = 7) -> DataFrame:
    """(raster_id, r, c, patch): the size x size values in row order, of cells whose window is whole and inside."""
    near = neighbourhood(cells.select(*KEYS, F.col("z").cast("double").alias("z")), size // 2, out="patch")
    return near.where(~F.exists("patch", lambda x: x.isNull())).select(*KEYS, "patch")


def pca(vectors: DataFrame, k: int = 2, column: str = "patch", keys: tuple[str, ...] = KEYS) -> tuple[DataFrame, list[float]]:
    """pca_1 to pca_k of the standardised vectors, and the shares of variance; each axis' largest loading is positive.

    Vectors may have one number only, as patches of one cell do; components beyond their length are NULL.
    """
    rows = vectors.withColumn("_v", array_to_vector(column))
    n, size = rows.agg(F.count("*"), F.max(F.size(column))).first()
    none = [F.lit(None).cast("double").alias(f"pca_{i + 1}") for i in range(k)]
    if n < 2:
        return vectors.select(*keys, *none), []
    k = min(k, size)
    scaled = StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True).fit(rows).transform(rows)
    model = PCA(k=k, inputCol="_s", outputCol="_p").fit(scaled)
    axes = model.pc.toArray()
    # population deviations as in the usual scaler, and a sign that does not depend on the solver
    factor = np.sqrt(n / (n - 1)) * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])
    out = model.transform(scaled).withColumn("_a", vector_to_array("_p"))
    return out.select(*keys, *[(F.col("_a")[i] * float(factor[i])).alias(f"pca_{i + 1}") for i in range(k)], *none[k:]), [float(x) for x in model.explainedVariance]


def feature_pca(df: DataFrame, features: list[str], k: int = 2, keys: tuple[str, ...] = ("id",)) -> tuple[DataFrame, list[float]]:
    """keys with pca_1 to pca_k over the standardised features of the rows that have them all, and the shares of variance."""
    rows = df.where(" and ".join(f"`{f}` is not null" for f in features)).select(F.struct(*keys).alias("_key"), F.array(*[F.col(f).cast("double") for f in features]).alias("patch"))
    found, shares = pca(rows, k, keys=("_key",))
    return found.select("_key.*", *[f"pca_{i + 1}" for i in range(k)]), shares


def clusters(vectors: DataFrame, k: int = 3, column: str = "patch", seed: int = 42) -> DataFrame:
    """cluster_label by k-means on the raw vectors; labels follow the order of the centres."""
    rows = vectors.withColumn("_v", array_to_vector(column))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_c", maxIter=50).fit(rows)
    rank = {c: i for i, (_, c) in enumerate(sorted((tuple(x.tolist()), c) for c, x in enumerate(model.clusterCenters())))}
    label = F.element_at(F.create_map(*[F.lit(x) for c, i in rank.items() for x in (c, i)]), F.col("_c"))
    return model.transform(rows).select(*KEYS, label.alias("cluster_label"))


#: Rows of packed vectors that Python gets at a time.
PACKS = 16
#: Vectors of a pack that is sent around, of a leaf of its tree, and hits that wait before the nearest so far are settled.
SENT, LEAF, WAITING = 16384, 512, 1 << 18
#: Vectors whose links stand in one row of the graph, and rows of it that Python gets at a time.
LINKED, ROWS = 1 << 15, 2
#: Vectors that a task takes in before it packs them, at most that ask in a task, and tasks that they are dealt into where they suffice.
TAKEN, ASKING, TASKS = 1 << 17, 1 << 19, 24


def _order(x: np.ndarray, size: int) -> np.ndarray:
    """An order of x in which all but the last of each run of size vectors are the cells of a tree that halves the widest column."""
    order, todo = np.arange(len(x)), [(0, len(x))]
    while todo:
        a, b = todo.pop()
        if b - a > size:
            part, m = x[order[a:b]], (-(-(b - a) // size) + 1) // 2 * size
            order[a:b] = order[a:b][np.argpartition(part[:, part.std(axis=0).argmax()], m)]
            todo += [(a, a + m), (a + m, b)]
    return order


def _tree(x: np.ndarray, a: int, b: int) -> tuple:
    """(from, to, least, greatest, kids): boxes around x[a:b], halved down to LEAF."""
    if b - a <= LEAF:
        return a, b, x[a:b].min(axis=0), x[a:b].max(axis=0), ()
    m = a + (-(-(b - a) // LEAF) + 1) // 2 * LEAF
    kids = _tree(x, a, m), _tree(x, m, b)
    return a, b, np.minimum(kids[0][2], kids[1][2]), np.maximum(kids[0][3], kids[1][3]), kids


class _Nearest:
    """The k nearest of vectors x among those of packs (ids, vectors, place of the first in all); of equals the least id. Exact.

    Boxes farther than the k-th so far are left out, then vectors, by single precision and more than its error; the rest is
    measured in double. compared counts pairs of vectors met.
    """

    def __init__(self, k: int, ids: np.ndarray, x: np.ndarray):
        n = len(ids)
        self.k, self.ids, self.x, self.waiting, self.count, self.compared = k, ids, x, [], 0, 0
        self.turned, self.centre = x.T.copy(), x.mean(axis=0)
        self.unit = np.abs(x - self.centre).max() or 1.0
        self.small = ((self.turned - self.centre[:, None]) / self.unit).astype(np.float32)
        self.gap, self.far, self.near = np.full((n, k), np.inf), np.full(n, np.inf), np.full(n, np.inf, np.float32)
        self.who, self.at = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -1)

    def inside(self, node: tuple, pack: tuple, start: int) -> None:
        """Vectors of a pack, which are x from start, ask each other: first in a leaf, then across the halves around it."""
        a, b, _, _, kids = node
        if kids:
            for kid in kids:
                self.inside(kid, pack, start)
            for kid, other in (kids, kids[::-1]):
                self.visit(np.arange(kid[0], kid[1]) + start, other, pack)
        else:
            self.compare(np.arange(a, b) + start, node, pack)
        self.settle()

    def visit(self, rows: np.ndarray, node: tuple, pack: tuple, q: np.ndarray | None = None) -> None:
        lo, hi, kids = node[2:]
        if q is None:
            for i in range(0, len(rows), 32768):
                self.visit(rows[i : i + 32768], node, pack, self.small[:, rows[i : i + 32768]])
            return
        low, high = (((v - self.centre) / self.unit)[:, None] for v in (lo, hi))
        wider = 2.0**-21 * max(1, -low.min(), high.max())  # what single precision may be off
        gap = np.maximum((low - wider).astype(np.float32) - q, q - (high + wider).astype(np.float32))
        np.maximum(gap, 0, out=gap)
        gap *= gap
        keep = np.flatnonzero(gap.sum(axis=0) <= self.near[rows])
        if not len(keep):
            return
        rows = rows[keep]
        if not kids:
            self.compare(rows, node, pack)
        else:
            q = q[:, keep]
            for kid in kids:
                self.visit(rows, kid, pack, q)

    def compare(self, rows: np.ndarray, node: tuple, pack: tuple) -> None:
        (a, b, lo, hi, _), (ids, x, first) = node, pack
        k, width, size = self.k, x.shape[1], b - a
        self.compared += len(rows) * size
        centre = ((lo + hi) / 2)[:, None]
        q0, y0 = self.turned[:, rows] - centre, x[a:b].T - centre
        unit = max(np.abs(q0).max(), np.abs(y0).max()) or 1.0
        q0 /= unit
        y0 /= unit
        square, others = (q0 * q0).sum(axis=0), (y0 * y0).sum(axis=0)
        error = 8 * (width + 4) * 2.0**-24
        slack = error * (square + others.max())
        # columns up to a multiple of 8 that nobody is near, so that eight answers are looked at in one
        right = np.zeros((width + 2, size + -size % 8), np.float32)
        right[:width, :size], right[width, :size], right[width + 1, :size], right[width + 1, size:] = y0, 1, others, 1e30
        left = np.empty((width + 2, len(rows)), np.float32)
        left[:width], left[width], left[width + 1] = -2 * q0, square, 1
        most = np.minimum(self.far[rows] / unit**2, 1e25)
        if size > k + 1 and (most > 1e24).any():  # one more, which may be the vector itself
            most = np.minimum(most, np.partition(left.T @ right[:, :size], k, axis=1)[:, k] + slack)
        left[width] = square - most - slack - error * most
        for i in range(0, len(rows), 1024):
            hit = (left[:, i : i + 1024].T @ right <= 0).reshape(-1)
            eight = np.flatnonzero(hit.view(np.uint64))
            f, t = np.nonzero(hit.reshape(-1, 8)[eight])
            f, t = np.divmod(8 * eight[f] + t, right.shape[1])
            f, t = rows[i + f], a + t
            gap = ((self.x[f] - x[t]) ** 2).sum(axis=1)
            good = (gap <= self.far[f]) & (self.ids[f] != ids[t])
            f, t = f[good], t[good]
            self.waiting.append((f, gap[good], ids[t], first + t))
            self.count += len(f)
            if self.count > WAITING:
                self.settle()

    def settle(self) -> None:
        """Takes the hits that wait into the k nearest."""
        if self.count:
            k, (f, gap, who, at) = self.k, (np.concatenate(p) for p in zip(*self.waiting))
            rows = np.unique(f)
            f, gap, who, at = np.concatenate([np.repeat(rows, k), f]), np.concatenate([self.gap[rows].ravel(), gap]), np.concatenate([self.who[rows].ravel(), who]), np.concatenate([self.at[rows].ravel(), at])
            order = np.lexsort((who, gap, f))
            f = f[order]
            order = order[np.arange(len(f)) - np.searchsorted(f, f) < k]
            self.gap[rows], self.who[rows], self.at[rows] = gap[order].reshape(-1, k), who[order].reshape(-1, k), at[order].reshape(-1, k)
            self.far[rows] = self.gap[rows, -1]
            self.near[rows] = self.far[rows] / self.unit**2 * (1 + 1e-5)
        self.waiting, self.count = [], 0


def _raw(x: np.ndarray) -> tuple[str, bytes]:
    """Type and bytes of x in the smallest type that holds all of its numbers."""
    with np.errstate(all="ignore"):
        kind = next((t for t in ("i2", "f4") if (x.astype(t) == x).all()), "f8")
    return kind, x.astype(kind).tobytes()


def _packs(vectors: DataFrame, k: int, column: str, id_col: str, block: int) -> DataFrame:
    """(own, at, spare, ids, kind, x): vectors without NaN or infinities in packs of those that lie together.

    own is the task they ask in, at the place of the first in the order of all packs. Of equal vectors, those that have k + 1 with
    lesser ids are nobody's neighbours and spare: they only ask. A sample of at most about 16384 vectors draws the
    cells that the rows are dealt into, and nothing else hangs on it.
    """
    n = vectors.count()
    each = -(-n // max(-(-n // block), min(TASKS, n // 8192), 1))
    size = max(1, min(SENT, each // 4))
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(column).alias("v"))
    cells = 1 << max(0, -(-n // TAKEN) - 1).bit_length()
    splits = []
    if cells > 1:
        sample = np.array([r.v for r in given.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(max(1, n // 16384))) == 0).select("v").collect()], float)
        todo = [sample[np.isfinite(sample).all(axis=1)]]
        while len(todo) < cells:
            cut_at = []
            for part in todo:
                d = int(part.std(axis=0).argmax()) if len(part) else 0
                cut_at.append((d, float(np.median(part[:, d])) if len(part) else 0.0))
            splits.append(cut_at)
            todo = [half for part, (d, v) in zip(todo, cut_at) for half in (part[part[:, d] <= v], part[part[:, d] > v])]

    def deal(batches):
        for part in batches:
            ids, x = part.column("id").to_numpy(zero_copy_only=False), part.column("v").flatten().to_numpy(zero_copy_only=False)
            x = x.astype(float).reshape(len(ids), -1)
            fine = np.isfinite(x).all(axis=1)
            ids, x = ids[fine], x[fine]
            cell = np.zeros(len(ids), int)
            for cut_at in splits:
                d, v = np.array([c[0] for c in cut_at], int)[cell], np.array([c[1] for c in cut_at])[cell]
                cell = 2 * cell + (x[np.arange(len(x)), d] > v)
            order = np.argsort(cell, kind="stable")
            ends = np.flatnonzero(np.diff(cell[order], append=-1)) + 1
            rows = [(int(cell[o[0]]), ids[o].tobytes(), *_raw(x[o])) for o in np.split(order, ends[:-1]) if len(o)]
            yield pa.RecordBatch.from_pydict(dict(zip(("cell", "ids", "kind", "x"), map(list, zip(*rows)))) if rows else {c: [] for c in ("cell", "ids", "kind", "x")}, pa.schema([("cell", pa.int32()), ("ids", pa.binary()), ("kind", pa.string()), ("x", pa.binary())]))

    def pack(batches):
        held, seq = [], 0

        def out():
            nonlocal seq
            ids, x = (np.concatenate(p) for p in zip(*held))
            order = np.lexsort((ids, (x * np.random.default_rng(1).random(x.shape[1])).sum(axis=1)))
            ids, x = ids[order], x[order]
            new = np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)])
            rank = np.arange(len(ids)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            for spare in (False, True):
                mine = (rank > k) == spare
                i, v = ids[mine], x[mine]
                order = _order(v, size)
                for a in range(0, len(i), size):
                    o = order[a : a + size]
                    o = o[_order(v[o], LEAF)]
                    yield pd.DataFrame([(cell, seq, spare, len(o), i[o].tobytes(), *_raw(v[o]))], columns=["cell", "seq", "spare", "n", "ids", "kind", "x"])
                    seq += 1

        cell = None
        for part in batches:
            for now, ids, kind, x in zip(part["cell"], part["ids"], part["kind"], part["x"]):
                if held and (now != cell or sum(len(i) for i, _ in held) >= 2 * TAKEN):
                    yield from out()
                    held = []
                seq, cell = (seq if now == cell else 0), now
                ids = np.frombuffer(ids, np.int64)
                held.append((ids, np.frombuffer(x, kind).astype(float).reshape(len(ids), -1)))
        if held:
            yield from out()

    dealt = given.mapInArrow(deal, "cell int, ids binary, kind string, x binary").repartitionById(cells, F.col("cell")).sortWithinPartitions("cell")
    packs = cut(dealt.mapInPandas(pack, "cell int, seq long, spare boolean, n long, ids binary, kind string, x binary"))
    order = Window.orderBy("cell", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = packs.select("cell", "seq", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("at")).withColumn("own", F.expr(f"cast(at div {max(1, each)} as int)"))
    return packs.join(F.broadcast(cut(placed)), ["cell", "seq"]).select("own", "at", "spare", "ids", "kind", "x")


def _asked(vectors: DataFrame, k: int, column: str, id_col: str, block: int, tell, schema: str) -> DataFrame:
    """What tell(task, its first place, firsts of all tasks, _Nearest) yields, of tasks that hold the vectors that ask while the packs of all pass by."""
    packs = _packs(vectors, k, column, id_col, block)
    firsts = np.array([r.at for r in packs.groupBy("own").agg(F.min("at").alias("at")).orderBy("own").collect()] or [0])
    # own ones come first, then those of tasks that lie near
    dealt = packs.withColumnRenamed("own", "of").withColumn("own", F.explode(F.sequence(F.lit(0), F.lit(len(firsts) - 1)))).where("own = of or not spare")
    dealt = dealt.withColumn("turn", F.col("own").bitwiseXOR(F.col("of"))).repartitionById(len(firsts), F.col("own")).sortWithinPartitions("own", "turn", "at")

    def run(batches):
        mine, found = [], None

        def begin():
            found = _Nearest(k, np.concatenate([p[0] for p, _ in mine]), np.concatenate([p[1] for p, _ in mine]))
            rows, held = np.arange(len(found.ids)), [(p, _tree(p[1], 0, len(p[1])), p[2] - mine[0][0][2]) for p, spare in mine if not spare]
            for pack, tree, start in held:
                found.inside(tree, pack, start)
            for pack, tree, start in held:
                found.visit(np.concatenate([rows[:start], rows[start + len(pack[0]) :]]), tree, pack)
                found.settle()
            return found

        for part in batches:
            for own, turn, at, spare, ids, kind, x in zip(*(part[c] for c in ("own", "turn", "at", "spare", "ids", "kind", "x"))):
                ids = np.frombuffer(ids, np.int64)
                pack = ids, np.frombuffer(x, kind).astype(float).reshape(len(ids), -1), at
                if turn == 0:
                    mine.append((pack, spare))
                    continue
                found = found or begin()
                found.visit(np.arange(len(found.ids)), _tree(pack[1], 0, len(ids)), pack)
                found.settle()
        if mine:
            yield from tell(int(own), mine[0][0][2], firsts, found or begin())

    with batches_of(vectors.sparkSession, PACKS):
        return cut(dealt.select("own", "turn", "at", "spare", "ids", "kind", "x").mapInPandas(run, schema))


def nearest(vectors: DataFrame, k: int, column: str = "patch", id_col: str = "id", block: int = ASKING) -> DataFrame:
    """(src, dst, gap): the k nearest other vectors of each by squared distance; of equals the least id. Exact.

    A task holds a block of vectors that ask and lie together, with their nearest so far, while the packs of all vectors pass by,
    each a tree of boxes. What is sent grows with the rows times the blocks; vectors are compared only where boxes are near.
    """

    def tell(own, first, firsts, found):
        for i in range(0, len(found.ids), 65536):
            f, place = np.nonzero(np.isfinite(found.gap[i : i + 65536]))
            yield pd.DataFrame({"src": found.ids[i + f], "dst": found.who[i + f, place], "gap": found.gap[i + f, place]})

    return _asked(vectors, k, column, id_col, block, tell, "src long, dst long, gap double")


def _walked(vectors: DataFrame, k: int, steps: int, column: str, block: int = ASKING) -> DataFrame:
    """(id, value): degrees in the graph of k nearest after steps of averaging over links; a link weighs as often as it is named.

    A task keeps its part of the graph by places of its vectors, and gets from other tasks those values that its links end at.
    """

    def tell(own, first, firsts, found):
        yield pd.DataFrame({"own": [own], "kind": [3], "other": [-1], "a": [found.ids.tobytes()], "b": [b""]})
        f, place = np.nonzero(found.at >= 0)
        to = found.at[f, place]
        other = np.searchsorted(firsts, to, side="right") - 1
        order = np.argsort(other, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(other[order])) + 1):
            if len(part):
                o = int(other[part[0]])
                ends = f[part].astype(np.int32).tobytes(), (to[part] - firsts[o]).astype(np.int32).tobytes()
                yield pd.DataFrame({"own": [own, o], "kind": [0, 0], "other": [o, own], "a": ends, "b": ends[::-1]})

    schema = "own int, kind int, other int, a binary, b binary"
    links = _asked(vectors, k, column, "id", block, tell, schema)
    tasks = links.agg(F.max("own")).first()[0]
    tasks = 1 if tasks is None else tasks + 1

    def dealt(df):
        return df.repartitionById(tasks, F.col("own")).sortWithinPartitions("own", "kind", "other")

    def rows(batches):
        for part in batches:
            yield from zip(part["own"], part["kind"], part["other"], part["a"], part["b"])

    def tie(batches):
        """Degrees and ends of links as places among the values that come in, and which values others need."""
        mine, ends, base, ids, last = [], [], 0, b"", []

        def need():
            wanted, at = np.unique(np.concatenate([t for _, _, t in last]), return_inverse=True)
            mine.append(np.concatenate([m for _, m, _ in last]))
            ends.append((base + at).astype(np.int32))
            return len(wanted), pd.DataFrame({"own": [last[0][0]], "kind": [2], "other": [own], "a": [wanted.tobytes()], "b": [b""]})

        own = None
        for own, kind, other, a, b in rows(batches):
            if kind == 3:
                ids = a
                continue
            if last and last[0][0] != other:
                size, sent = need()
                base, last = base + size, []
                yield sent
            last.append((other, np.frombuffer(a, np.int32), np.frombuffer(b, np.int32)))
        if last:
            yield need()[1]
        if own is not None:
            mine, ends = (np.concatenate(p or [np.zeros(0, np.int32)]) for p in (mine, ends))
            degree = np.bincount(mine, minlength=len(ids) // 8).astype(np.int32)
            ends = ends[np.argsort(mine, kind="stable")]
            to = 0
            for i in range(0, len(degree), LINKED):
                some = degree[i : i + LINKED]
                start, to = to, to + int(some.sum())
                yield pd.DataFrame({"own": [own], "kind": [1], "other": [i], "a": [ends[start:to].tobytes()], "b": [some.tobytes()]})
            yield pd.DataFrame({"own": [own], "kind": [3], "other": [-1], "a": [ids], "b": [b""]})

    def step(batches, first):
        """Values come in, then links, then what others want or the ids."""
        values, parts, v = [], [], None
        for own, kind, other, a, b in rows(batches):
            if kind == 0:
                values.append(np.frombuffer(a))
            elif kind == 1:
                degree = np.frombuffer(b, np.int32)
                if not first and values:
                    values = [np.concatenate(values)] if len(values) > 1 else values
                    sums = np.bincount(np.repeat(np.arange(len(degree)), degree), values[0][np.frombuffer(a, np.int32)], len(degree))
                    parts.append(sums / np.maximum(degree, 1))
                else:
                    parts.append(degree.astype(float))
            else:
                v = np.concatenate(parts) if v is None else v
                if kind == 3:
                    yield pd.DataFrame({"id": np.frombuffer(a, np.int64), "value": v})
                else:
                    yield pd.DataFrame({"own": [other], "kind": [0], "other": [own], "a": [v[np.frombuffer(a, np.int32)].tobytes()], "b": [b""]})

    with batches_of(vectors.sparkSession, ROWS):
        state = cut(dealt(links).mapInPandas(tie, schema))
        graph = state.where("kind in (1, 2)")
        sent = dealt(graph).mapInPandas(lambda x: step(x, True), schema)
        for _ in range(steps - 1):
            sent = dealt(graph.unionByName(sent)).mapInPandas(lambda x: step(x, False), schema)
        return cut(dealt(state.where("kind in (1, 3)").unionByName(sent)).mapInPandas(lambda x: step(x, False), "id long, value double"))


def spectral_clusters(vectors: DataFrame, k: int = 3, neighbours: int = 10, column: str = "patch") -> DataFrame:
    """Clusters by 20 steps of power iteration over the graph of nearest neighbours among the vectors, wherever in the grid they are.

    A vector counts among its own neighbours; a link weighs 1 if both ends name each other, and a half otherwise. Labels
    follow the order of the values that the iteration ends at; vectors with NaN or infinities have none.
    """
    rows = cut(vectors.select(F.struct(*KEYS).alias("cell"), column, F.xxhash64(*KEYS).alias("id")))
    if rows.limit(2).count() < 2:
        return rows.select("cell.*", F.lit(0).alias("cluster_label"))
    values = _walked(rows, neighbours - 1, 20, column)
    mean, std = values.agg(F.avg("value"), F.stddev_pop("value")).first()
    points = values.select("id", array_to_vector(F.array((F.col("value") - (mean or 0.0)) / (std or 1.0))).alias("_v"))
    if not std:
        return rows.join(points, "id", "left").select("cell.*", F.when(F.col("_v").isNotNull(), 0).alias("cluster_label"))
    model = KMeans(k=k, seed=42, featuresCol="_v", predictionCol="_c", maxIter=50).fit(points)
    order = np.argsort([float(c[0]) for c in model.clusterCenters()])
    label = F.element_at(F.create_map(*[F.lit(int(x)) for i, c in enumerate(order) for x in (c, i)]), F.col("_c"))
    return rows.join(model.transform(points).select("id", label.alias("cluster_label")), "id", "left").select("cell.*", "cluster_label")


#: Bytes of vectors that stand in one row while the network is fitted.
PACK = 1 << 18


def autoencoder(vectors: DataFrame, k: int = 2, hidden: int = 32, steps: int = 200, seed: int = 42, column: str = "patch") -> DataFrame:
    """autoencoder_latent_1 to _k: a network of one hidden layer each way, fitted on all rows and applied to them.

    Each step sums the gradients of all rows by partition; only the small weights and their gradients meet the driver.
    Vectors are packed, as one number after the other is slow to send; a task holds PACKS packs at a time.
    """
    names = [f"autoencoder_latent_{i + 1}" for i in range(k)]
    rows = cut(vectors.select(*KEYS, column))
    head = rows.select(F.size(column).alias("width")).first()
    if head is None:
        return vectors.select(*KEYS, *[F.lit(None).cast("double").alias(n) for n in names])
    width = head.width
    row = rows.agg(F.count("*"), *[F.avg(F.col(column)[i]) for i in range(width)], *[F.stddev_pop(F.col(column)[i]) for i in range(width)]).first()
    n, mean, std = row[0], np.array(row[1 : width + 1], float), np.maximum(np.array(row[width + 1 :], float), 1e-9)

    def pack(batches):
        for part in batches:
            if len(part):
                x, size = (np.stack(part[column].to_numpy()) - mean) / std, max(1, PACK // (8 * width))
                yield pd.DataFrame({"x": [x[i : i + size].tobytes() for i in range(0, len(x), size)]})

    # small row groups, since a whole one is decoded at a time
    packed = cut(rows.select(column).mapInPandas(pack, "x binary"), **{"parquet.block.size": str(64 * PACK)})
    sizes, rng = [width, hidden, k, hidden, width], np.random.default_rng(seed)
    w = [rng.normal(0, (2 / (a + b)) ** 0.5, (a, b)) for a, b in zip(sizes, sizes[1:])]
    b = [np.zeros(n) for n in sizes[1:]]
    m, v = [[np.zeros_like(p) for p in w + b] for _ in range(2)]

    def gradients(batches):
        total = None
        for part in batches:
            for raw in part["x"]:
                x = np.frombuffer(raw).reshape(-1, width)
                at = [x]
                for i in range(4):
                    y = at[-1] @ w[i] + b[i]
                    at.append(np.tanh(y) if i in (0, 2) else y)
                d, gw, gb = 2 * (at[-1] - x) / (n * width), [None] * 4, [None] * 4
                for i in range(3, -1, -1):
                    if i in (0, 2):
                        d = d * (1 - at[i + 1] ** 2)
                    gw[i], gb[i] = at[i].T @ d, d.sum(axis=0)
                    d = d @ w[i].T
                total = [g + t for g, t in zip(gw + gb, total)] if total else gw + gb
        if total:
            yield pd.DataFrame({"g": [np.concatenate([g.ravel() for g in total]).tobytes()]})

    ends = np.cumsum([p.size for p in w + b])[:-1]
    for t in range(1, steps + 1):
        with batches_of(rows.sparkSession, PACKS):
            sums = sum(np.frombuffer(r.g) for r in packed.mapInPandas(gradients, "g binary").collect())
        for j, (p, g) in enumerate(zip(w + b, np.split(sums, ends))):
            g = g.reshape(p.shape)
            m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g * g
            p -= 0.01 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)

    def encode(batches):
        for part in batches:
            z = np.tanh((np.stack(part[column].to_numpy()) - mean) / std @ w[0] + b[0]) @ w[1] + b[1]
            yield part[list(KEYS)].assign(**{n: z[:, i] for i, n in enumerate(names)})

    return rows.mapInPandas(encode, "raster_id string, r int, c int, " + ", ".join(f"{n} double" for n in names))
