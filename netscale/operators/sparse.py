"""Functions of the Laplacian of one large graph, by products of its edge table with a few columns of vectors: no matrix is made.

Vectors are tables (node, x0, x1, ...): a product is a join of the edges with them and a sum, and dot products are one aggregate of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netscale.operators import bipartite
from netscale.operators.graph import components
from netscale.sources.shared import dropped, written


def _prepared(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, strength) of all nodes and both directions (src, dst, weight) of all edges; parallel edges add up, loops don't count."""
    ends = edges.where("src <> dst and weight is not null").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight"))
    ends = written(ends.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight")), "ends")
    ways = ends.union(ends.select("dst", "src", "weight"))
    strength = ways.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("strength"))
    own = nodes.select(F.col("node").cast("long").alias("node")).union(ways.select("src")).distinct()
    return written(own.join(strength, "node", "left").fillna(0.0, ["strength"]), "nodes"), ways


def _times(state: DataFrame, ways: DataFrame, names: Sequence[str]) -> DataFrame:
    """state (node, strength, columns) with y0, y1, ...: the Laplacian times each of the named columns. The same plan in each step."""
    told = ways.join(state.select(F.col("node").alias("src"), *names), "src").groupBy(F.col("dst").alias("node")).agg(*[F.sum(F.col("weight") * F.col(c)).alias(f"__{c}") for c in names])
    both = state.join(told, "node", "left")
    return both.withColumns({f"y{i}": F.col("strength") * F.col(c) - F.coalesce(f"__{c}", F.lit(0.0)) for i, c in enumerate(names)}).drop(*[f"__{c}" for c in names])


def _block(batch: pa.RecordBatch, kind: str, count: int) -> np.ndarray:
    """[row, column] of the columns kind0, kind1, ..."""
    return np.stack([batch.column(batch.schema.get_field_index(f"{kind}{i}")).to_numpy(zero_copy_only=False) for i in range(count)], 1) if count else np.zeros((batch.num_rows, 0))


def _stepped(state: DataFrame, kinds: Sequence[tuple[str, int]], made: Sequence[tuple[str, int]], f: Callable[..., list[np.ndarray]]) -> DataFrame:
    """(node, strength, columns of `made`) of blocks of columns that f makes of those of `kinds`."""
    names = [f"{k}{i}" for k, n in made for i in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = f(*[_block(batch, k, n) for k, n in kinds])
            columns = [pa.array(block[:, i]) for block, (_, n) in zip(out, made, strict=True) for i in range(n)]
            yield pa.record_batch([batch.column("node"), batch.column("strength"), *columns], ["node", "strength", *names])

    return state.mapInArrow(run, "node long, strength double, " + ", ".join(f"{n} double" for n in names))


def _summed(state: DataFrame, kinds: Sequence[tuple[str, int]], f: Callable[..., np.ndarray], count: int) -> np.ndarray:
    """Sums over all rows of what f makes of each batch, a number a column: to the driver come as many numbers as there are columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(count)
        for batch in batches:
            total += f(*[_block(batch, k, n) for k, n in kinds])
        yield pa.record_batch([pa.array(np.arange(count)), pa.array(total)], ["i", "value"])

    out = np.zeros(count)
    for row in state.mapInArrow(run, "i long, value double").groupBy("i").agg(F.sum("value").alias("value")).collect():
        out[row.i] = row.value
    return out


def lanczos_spectrum(nodes: DataFrame, edges: DataFrame, probes: int = 32, steps: int = 20, seed: int = 1) -> DataFrame:
    """(k, lambda, weight): values that stand for the spectrum of the Laplacian, weights adding up to the number of nodes.

    Stochastic Lanczos quadrature: from each of `probes` random vectors of signs, `steps` products give a small tridiagonal matrix, whose eigenvalues
    stand for the spectrum with the squares of the first entries of its eigenvectors. The zeros of the spectrum, one for each component, are
    taken exactly, and the vectors have no part in them. Signs are hashes of (node, probe, seed), so that a task that runs again draws the same.
    To the driver come two sums a step and probe. Loops don't count; a graph without nodes gives no rows.
    """
    own, ways = _prepared(nodes, edges)
    found = written(components(own, ways), "components")
    n = own.count()
    if not n:
        return own.select(F.lit(0).alias("k"), F.lit(0.0).alias("lambda"), F.lit(0.0).alias("weight")).limit(0)
    names, (x, y, p) = [f"x{i}" for i in range(probes)], (("x", probes), ("y", probes), ("p", probes))
    apart = _probes(own, found, probes, seed)
    size = _summed(apart, [x], lambda x: (x * x).sum(axis=0), probes)
    live = size > 1e-9 * n
    norm = np.sqrt(np.where(live, size, 1.0))
    state = _stepped(apart, [x], [x, p], lambda x: [x / norm, np.zeros_like(x)])
    alphas, betas, beta = [], [], np.zeros(probes)
    for _ in range(steps):
        state = written(_times(state, ways, names), "lanczos")
        alpha = _summed(state, [x, y, p], lambda x, y, p, b=beta: ((y - b * p) * x).sum(axis=0), probes)
        left = np.sqrt(_summed(state, [x, y, p], lambda x, y, p, a=alpha, b=beta: ((y - b * p - a * x) ** 2).sum(axis=0), probes))
        alphas.append(alpha)
        live = live & (left > 1e-9 * np.maximum(np.abs(alpha), beta))  # else the space of this probe is whole
        betas.append(np.where(live, left, 0.0))
        if not live.any():
            break
        scale = np.where(live, 1 / np.where(live, left, 1.0), 0.0)
        state = _stepped(state, [x, y, p], [x, p], lambda x, y, p, a=alpha, b=beta, s=scale: [(y - b * p - a * x) * s, x])
        beta = betas[-1]
    return _quadrature(own.sparkSession, alphas, betas, size, n, found.select("component").distinct().count())


def _probes(own: DataFrame, found: DataFrame, probes: int, seed: int) -> DataFrame:
    """(node, strength, x0, x1, ...) of vectors of signs without their mean in each component."""
    names = [f"x{i}" for i in range(probes)]
    signs = [F.when(F.pmod(F.xxhash64("node", F.lit(i), F.lit(seed)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias(c) for i, c in enumerate(names)]
    drawn = written(own.join(found, "node").select("node", "strength", "component", *signs), "signs")
    mean = drawn.groupBy("component").agg(*[F.avg(c).alias(f"p{i}") for i, c in enumerate(names)])
    return written(_stepped(drawn.join(mean, "component"), [("x", probes), ("p", probes)], [("x", probes)], lambda x, p: [x - p]), "probes")


def _quadrature(spark: SparkSession, alphas: Sequence[np.ndarray], betas: Sequence[np.ndarray], size: np.ndarray, n: int, zeros: int) -> DataFrame:
    """(k, lambda, weight) of the tridiagonal matrices of all probes, whose squares are `size`."""
    probes = len(size)
    values = []
    for i in np.flatnonzero(size > 1e-9 * n):
        b = np.array([x[i] for x in betas])
        m = int(np.argmax(b == 0)) + 1 if (b == 0).any() else len(b)
        lam, vec = np.linalg.eigh(np.diag([x[i] for x in alphas[:m]]) + np.diag(b[: m - 1], 1) + np.diag(b[: m - 1], -1))
        values += [(float(max(x, 0.0)), float(w)) for x, w in zip(lam, size[i] / probes * vec[0] ** 2, strict=True)]
    rest = sum(w for _, w in values)
    fit = (n - zeros) / rest if rest else 0.0  # what lies beside the zeros adds up as it must
    rows = [(0, 0.0, float(zeros)), *((k + 1, x, w * fit) for k, (x, w) in enumerate(sorted(values)))]
    return spark.createDataFrame(rows, "k int, lambda double, weight double")


#: Nodes in a block of a graph that is made of tiles at most, and cells of a tile that are multiplied at a time.
NODES, HELD = 16384, 400_000


def lanczos_of_pairs(nodes: DataFrame, links: DataFrame, below: float, probes: int = 32, steps: int = 20, seed: int = 1) -> DataFrame:
    """lanczos_spectrum() of the graph of nodes a of links (a, b) whose sparse_pvalues() are below `below`, weighted by their common neighbours.

    Where pairs are many, their weights are counted once into tiles, a matrix of small numbers for each two blocks of nodes, and the vectors are
    blocks too, one matrix each: a product sends each block to the tiles of its row and column, which are kept where they are, and gives back sums of
    blocks. So no row is made for an edge. Where pairs are few, it is the edges' table.
    """
    pairs = bipartite.Pairs(written(links, "links"), NODES)
    values = bipartite.sparse_values(pairs)
    if pairs.packed is None:
        edges = pairs.valued(values).where(F.col("p") < below)
        return lanczos_spectrum(nodes, edges.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("common").alias("weight")), probes, steps, seed)
    spark, tasks = links.sparkSession, min(2 * pairs.blocks * (pairs.blocks + 1), 1 << 12)
    tiles = pairs.tiles(values, below).repartition(tasks, "p", "q").sortWithinPartitions("p", "q").persist(StorageLevel.DISK_ONLY)
    unpacked = lambda names, kinds, schema: tiles.select(*names).mapInArrow(_unpacked(names, kinds), schema)
    stars = written(unpacked(["src", "dst"], [np.int64, np.int64], "src long, dst long").distinct(), "stars")
    strength = unpacked(["node", "strength"], [np.int64, np.float64], "node long, strength double").groupBy("node").agg(F.sum("strength").alias("strength"))
    own = written(nodes.select(F.col("node").cast("long").alias("node")).distinct().join(strength, "node", "left").fillna(0.0, ["strength"]), "nodes")
    found, n = written(components(own, stars), "components"), own.count()
    apart = _probes(own, found, probes, seed)
    size = _summed(apart, [("x", probes)], lambda x: (x * x).sum(axis=0), probes)
    live = size > 1e-9 * n
    norm = np.sqrt(np.where(live, size, 1.0))
    # all nodes of a block, as its tiles have them
    every = pairs.links.where("a is not null").select(F.col("a").cast("long").alias("node")).distinct().join(apart, "node", "left").fillna(0.0)
    blocks = written(every.withColumn("block", pairs.block("node")).groupBy("block").applyInArrow(_blocked(probes), "block int, strength binary, x binary"), "blocks")
    state = _by_blocks(blocks, ["strength", "x"], ["strength", "x", "p"], probes, lambda s, x: [s, x / norm, np.zeros_like(x)])
    alphas, betas, beta, last = [], [], np.zeros(probes), None
    for _ in range(steps):
        now = written(_tiled(state, tiles, pairs.blocks, tasks, probes), "lanczos")
        if last is not None:
            dropped(last)
        last = now
        alpha = _sums(now, ["x", "y", "p"], probes, lambda x, y, p, b=beta: ((y - b * p) * x).sum(axis=0))
        left = np.sqrt(_sums(now, ["x", "y", "p"], probes, lambda x, y, p, a=alpha, b=beta: ((y - b * p - a * x) ** 2).sum(axis=0)))
        alphas.append(alpha)
        live = live & (left > 1e-9 * np.maximum(np.abs(alpha), beta))  # else the space of this probe is whole
        betas.append(np.where(live, left, 0.0))
        if not live.any():
            break
        scale = np.where(live, 1 / np.where(live, left, 1.0), 0.0)
        state = _by_blocks(now, ["strength", "x", "y", "p"], ["strength", "x", "p"], probes, lambda s, x, y, p, a=alpha, b=beta, c=scale: [s, (y - b * p - a * x) * c, x])
        beta = betas[-1]
    tiles.unpersist()
    dropped(last)
    return _quadrature(spark, alphas, betas, size, n, found.select("component").distinct().count())


def _unpacked(names: Sequence[str], kinds: Sequence[type]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.record_batch([pa.array(np.frombuffer(batch.column(c)[k].as_buffer(), t)) for c, t in zip(names, kinds, strict=True)], list(names))

    return run


def _blocked(probes: int) -> Callable[[pa.Table], pa.Table]:
    """The rows of a block, in the order of its nodes, as one matrix."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        x = np.stack([table[f"x{i}"].to_numpy() for i in range(probes)], 1)
        blobs = [pa.array([b.astype(np.float64).tobytes()], pa.binary()) for b in (table["strength"].to_numpy(), x)]
        return pa.table([table["block"].slice(0, 1), *blobs], ["block", "strength", "x"])

    return run


def _matrix(batch: pa.RecordBatch, name: str, row: int, width: int) -> np.ndarray:
    return np.frombuffer(batch.column(batch.schema.get_field_index(name))[row].as_buffer()).reshape(-1, 1 if name == "strength" else width)


def _by_blocks(state: DataFrame, names: Sequence[str], made: Sequence[str], probes: int, f: Callable[..., list[np.ndarray]]) -> DataFrame:
    """(block, made) that f makes of each block's matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                out = f(*[_matrix(batch, c, k, probes) for c in names])
                yield pa.record_batch([batch.column("block").slice(k, 1), *[pa.array([m.tobytes()], pa.binary()) for m in out]], ["block", *made])

    return state.select("block", *names).mapInArrow(run, "block int, " + ", ".join(f"{c} binary" for c in made))


def _sums(state: DataFrame, names: Sequence[str], probes: int, f: Callable[..., np.ndarray]) -> np.ndarray:
    """As _summed, of blocks."""
    rows = _by_blocks(state, names, ["sums"], probes, lambda *m: [f(*m)]).select("sums")
    return np.sum([np.frombuffer(r.sums) for r in rows.toLocalIterator()], axis=0)


def _tiled(state: DataFrame, tiles: DataFrame, blocks: int, tasks: int, probes: int) -> DataFrame:
    """state (block, strength, x, p) with y: the Laplacian times x."""
    at, last = F.col("block"), F.lit(blocks - 1)
    x = state.select(at.alias("p"), F.explode(F.sequence(at, last)).alias("q"), F.col("x").alias("xp")).repartition(tasks, "p", "q")
    z = state.select(F.explode(F.sequence(F.lit(0), at)).alias("p"), at.alias("q"), F.col("x").alias("xq")).repartition(tasks, "p", "q")

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                p, q, size = (batch.column(c)[k].as_py() for c in ("p", "q", "size"))
                xp, xq = _matrix(batch, "xp", k, probes), _matrix(batch, "xq", k, probes)
                yp, yq, first, cell = np.zeros_like(xp), np.zeros_like(xq.T), 0, np.dtype(f"u{size}")
                step = max(1, HELD // max(1, len(xq)))
                for run in batch.column("w")[k]:
                    cells = np.frombuffer(pa.CompressedInputStream(pa.BufferReader(run.as_buffer()), "zstd").read(), cell).reshape(-1, len(xq))
                    for i in range(0, len(cells), step):
                        w = cells[i : i + step].astype(np.float64)
                        yp[first : first + len(w)] = w @ xq
                        if p != q:
                            yq += xp[first : first + len(w)].T @ w
                        first += len(w)
                found = [(p, yp)] if p == q else [(p, yp), (q, np.ascontiguousarray(yq.T))]
                yield pa.record_batch([pa.array([b for b, _ in found], pa.int32()), pa.array([m.tobytes() for _, m in found], pa.binary())], ["block", "y"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, None
        out = lambda: pa.record_batch([pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "told"])
        for batch in batches:
            for k in range(batch.num_rows):
                y = _matrix(batch, "y", k, probes)
                if batch.column("block")[k].as_py() == block:
                    total += y
                    continue
                if block is not None:
                    yield out()
                block, total = batch.column("block")[k].as_py(), y.copy()
        if block is not None:
            yield out()

    told = tiles.select("p", "q", "size", "w").join(x, ["p", "q"]).join(z, ["p", "q"]).mapInArrow(times, "block int, y binary")
    told = told.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(added, "block int, told binary")
    return _by_blocks(state.join(told, "block"), ["strength", "x", "p", "told"], ["strength", "x", "p", "y"], probes, lambda s, x, p, told: [s, x, p, s * x - told])


def _chebyshev(reach: float, least: float = 1e-14) -> np.ndarray:
    """Coefficients of exp(-reach (x + 1)) on [-1, 1] in Chebyshev's polynomials, as many as count."""
    n = 64 + 4 * int(np.ceil(reach)) if reach < 64 else 320 + 16 * int(np.ceil(np.sqrt(reach) * 4))
    odd = 2 * np.arange(n) + 1
    f = np.exp(-reach * (np.cos(np.pi * odd / (2 * n)) + 1))
    c = 2 / n * np.array([np.sum(f * np.cos(np.pi * ((k * odd) % (4 * n)) / (2 * n))) for k in range(n)])
    c[0] /= 2
    last = int(np.flatnonzero(np.abs(c) > least * np.abs(c).max())[-1])
    return c[: min(last, int(9 * np.sqrt(reach)) + 40) + 1]  # what comes later is rounding


def diffused(nodes: DataFrame, edges: DataFrame, sources: Sequence[int], taus: Sequence[float], block: int = 32) -> DataFrame:
    """(tau, i, j, k) of exp(-tau L) for the columns j of chosen nodes (at most a few hundred), by Chebyshev's expansion in products of L.

    The spectrum lies between 0 and twice the largest strength, so the expansion's length, which grows with the root of tau times that (or with it, for
    small ones), is known beforehand; all taus share the products. Nodes that aren't there give no columns.
    """
    own, ways = _prepared(nodes, edges)
    there = sorted(r.node for r in own.where(F.col("node").isin(*map(int, sources))).select("node").collect()) if sources else []  # of those chosen
    radius = max(float(own.agg(F.max("strength")).first()[0] or 0.0), 1e-300)
    # of M = L / radius - 1, whose spectrum lies in [-1, 1]
    expansions = [_chebyshev(float(tau) * radius) for tau in taus]
    longest = max(map(len, expansions), default=0)
    c = np.stack([np.r_[e, np.zeros(longest - len(e))] for e in expansions]) if expansions else np.zeros((0, 0))
    out = None
    for at in range(0, len(there), block):
        part = there[at : at + block]
        m = len(part)
        x, y, p, s = ("x", m), ("y", m), ("p", m), ("s", m * len(taus))
        names = [f"x{i}" for i in range(m)]
        ones = own.select("node", "strength", *[F.when(F.col("node") == j, 1.0).otherwise(0.0).alias(f"x{i}") for i, j in enumerate(part)])
        state = _stepped(ones, [x], [x, p, s], lambda x: [x, np.zeros_like(x), np.concatenate([k * x for k in c[:, 0]], axis=1)])
        for k in range(1, longest):
            state = written(_times(state, ways, names), "chebyshev")

            def step(x: np.ndarray, y: np.ndarray, p: np.ndarray, s: np.ndarray, k: int = k) -> list[np.ndarray]:
                new = (1.0 if k == 1 else 2.0) * (y / radius - x) - (0.0 if k == 1 else p)
                return [new, x, s + np.concatenate([w * new for w in c[:, k]], axis=1)]

            state = _stepped(state, [x, y, p, s], [x, p, s], step)
        cells = F.array(*[F.struct(F.lit(float(tau)).alias("tau"), F.lit(j).cast("long").alias("j"), F.col(f"s{t * m + i}").alias("k")) for t, tau in enumerate(taus) for i, j in enumerate(part)])
        rows = state.select(F.col("node").alias("i"), F.explode(cells).alias("c")).select("c.tau", "i", "c.j", "c.k")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else own.sparkSession.createDataFrame([], "tau double, i long, j long, k double")


def densities_from(nodes: DataFrame, edges: DataFrame, sources: Sequence[int], taus: Sequence[float], traces: DataFrame) -> DataFrame:
    """(tau, i, j, rho): diffused() over the trace (tau, trace), which partition_sums() gives."""
    rows = diffused(nodes, edges, sources, taus).join(F.broadcast(traces.select("tau", "trace")), "tau")  # a row for each tau
    return rows.select("tau", "i", "j", (F.col("k") / F.col("trace")).alias("rho"))


def partition_sums(spectrum: DataFrame, taus: Sequence[float]) -> DataFrame:
    """(tau, trace) of exp(-tau L) from a spectrum (lambda[, weight])."""
    weight = F.col("weight") if "weight" in spectrum.columns else F.lit(1.0)
    each = spectrum.select("lambda", weight.alias("weight"), F.explode(F.array(*[F.lit(float(t)) for t in taus])).alias("tau"))
    return each.groupBy("tau").agg(F.sum(F.col("weight") * F.exp(-F.col("tau") * F.col("lambda"))).alias("trace"))
