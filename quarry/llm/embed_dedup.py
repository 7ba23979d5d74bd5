"""Embedding near-duplicates: an exact metric range join by pivots.

Cosine at least t between unit vectors is Euclidean distance at most tau = sqrt(2 - 2t), a metric. Equal vectors of a
label are one class first, with a number of its own. Every class goes home to its nearest pivot; it also visits each
earlier pivot's cell that can hold a partner. If v is at home with p_i and its partner u with p_j, then
d(v,p_j) - d(v,p_i) <= 2 d(u,v) by the triangle inequality. In Euclidean space u is nearer to p_j than to any pivot, and
so than to their mean q over the m pivots nearest to v: (mean of v.p over those m - v.p_j) / |p_j - q| <= d(u,v). A visit
is made only where this holds for tau and every m of NEAREST. So each linked pair meets in exactly one cell, with one of
them at home, and cells join independently, by label.

Home vectors within tau / 2 of their pivot (the core) are all linked, again by the triangle inequality: their links are
counted from sums, never compared. What remains of a cell is compared in blocks of about BLOCK_BYTES a side, so a cell
of any size is many equal tasks. Cells join twice. First vectors are sent as one byte a component, with a bound of what
that changes, and only the classes with a possible partner come back; then these alone meet as they are. A block
returns counts and a forest of its links, never pairs. Components come from rounds of DataFrame operations.

The number of pivots is that power of two, from FEWEST to MOST, for which sending and comparing cost least as foreseen
from a sample of about SAMPLE classes, if it sends a row MOST_SENT times at most: dense data take more pivots as they
grow, spread out data few and larger cells. The sample and the pivots are what reaches the driver; a length of vectors
without a sampled one has a single pivot.

Defined results: a vector that is null, empty, zero, or holds a null or non-finite component links with nothing, nor does
one with a null label or null id; it is its own component (null for a null id, and then not kept). Vectors of different
lengths never link. Rows that repeat an id count as vectors of their own. Equal vectors always link. A very long vector
is one of a smaller batch. Empty input gives an empty result. Only the three named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.graph import connected_components
from quarry.llm.storage import discard, materialize, small
from quarry.llm.units import Forest, runs

COSINE = 0.98
#: Bytes of a block's vectors in double precision, and rows of it that are compared at a time.
BLOCK_BYTES, TILE = 16 << 20, 128
#: Least and most pivots; classes from which they are chosen; how often a row is sent on average, if that can be met.
FEWEST, MOST, SAMPLE, MOST_SENT = 8, 1024, 4096, 4
#: Numbers of nearest pivots over which a visit's bound is taken.
NEAREST = (1, 2, 4, 8)
#: What sending a row costs, in multiplications.
SENT = 20_000
#: Slack of a bound against rounding, in double and in single precision.
SLACK, SINGLE = 1e-7, 1e-5


def unit_vectors(column: pa.Array) -> np.ndarray:
    """Rows of one length as unit vectors in double precision."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def choose_pivots(sample: np.ndarray, number: int, tau: float) -> np.ndarray:
    """Centres of the sample's dense balls first, then the farthest of what is left."""
    if not len(sample):
        return sample
    near = sample.astype(np.float32) @ sample.T.astype(np.float32) >= 1 - tau * tau / 2
    left, chosen = np.ones(len(sample), bool), []
    while len(chosen) < number // 2:
        dense = near @ left * left
        best = int(dense.argmax())
        if dense[best] < max(3, len(sample) // 200):
            break
        ball = near[best] & left
        centre = sample[ball].mean(axis=0)
        chosen.append(centre / np.linalg.norm(centre))
        left &= ~ball
    chosen = chosen or [sample[0]]
    close = (sample @ np.stack(chosen).T).max(axis=1)
    while len(chosen) < number:
        far = int(close.argmin())
        if close[far] > 1 - tau * tau / 2:
            break
        chosen.append(sample[far])
        close = np.maximum(close, sample @ sample[far])
    return np.stack(chosen)


def cells_of(v: np.ndarray, p: np.ndarray, tau: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, at home, core) of unit vectors: each row's home first, then the visits to earlier pivots."""
    cos = v @ p.T
    distance = np.sqrt(np.maximum(0, 2 - 2 * cos))
    home, rows = distance.argmin(axis=1), np.arange(len(v))
    visit = (np.arange(len(p))[None] < home[:, None]) & (distance - distance[rows, home][:, None] <= 2 * tau + SLACK)
    order = np.argsort(-cos, axis=1, kind="stable")[:, : NEAREST[-1]]
    inner = p @ p.T
    for m in NEAREST:
        if m > len(p):
            break
        top = order[:, :m]
        beside = inner[top].mean(axis=1)  # p_j . q by row and j
        length = np.take_along_axis(beside, top, axis=1).mean(axis=1)[:, None]  # q . q
        apart = np.sqrt(np.maximum(0, 1 + length - 2 * beside))
        gap = np.take_along_axis(cos, top, axis=1).mean(axis=1)[:, None] - cos
        visit &= gap <= (tau + SLACK) * apart + SLACK
    row, cell = np.nonzero(visit)
    row, cell = np.concatenate([rows, row]), np.concatenate([home, cell])
    at_home = np.arange(len(row)) < len(v)
    return row, cell, at_home, at_home & (distance[row, cell] <= tau / 2 - SLACK)


def plan_pivots(sample: np.ndarray, labels: np.ndarray, rows: float, tau: float, block: int | None = None) -> np.ndarray:
    """The pivots for about so many rows, of which sample is a part: as many as cost least among those that send a row
    MOST_SENT times at most; if none does, those that send rows least often."""
    block = block or max(FEWEST, BLOCK_BYTES // (8 * sample.shape[1]))
    pivots = choose_pivots(sample, MOST, tau)
    number = min(FEWEST, len(pivots))
    best, least = pivots[:number], (math.inf, math.inf)
    while True:
        p = pivots[:number]
        parts = [cells_of(sample[lo : lo + 256], p, tau) for lo in range(0, len(sample), 256)]
        row = np.concatenate([x[0] + 256 * i for i, x in enumerate(parts)])
        cell, at_home = (np.concatenate([x[k] for x in parts]) for k in (1, 2))
        code = labels[row] * len(p) + cell
        share = rows / len(sample)
        everyone, homes = (np.bincount(code[some], minlength=1) * share for some in (slice(None), at_home))
        homes = np.pad(homes, (0, len(everyone) - len(homes)))
        sent = (everyone * np.ceil(everyone / block)).sum()
        cost = sent * SENT + (homes * (everyone - homes / 2)).sum() * sample.shape[1] + rows * len(p) * sample.shape[1]
        found = max(MOST_SENT, sent / max(rows, 1)), cost
        if found < least:
            best, least = p, found
        if number >= len(pivots):
            return best
        number = min(2 * number, len(pivots))


def one_byte(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scales, bounds): unit vectors at one byte a component, and how far codes times scale are from them."""
    scale = (np.abs(v).max(axis=1) / 127).astype(np.float32)
    code = np.rint(v / scale[:, None].astype(np.float64)).clip(-127, 127).astype(np.int8)
    off = np.sqrt(((v - code * scale[:, None].astype(np.float64)) ** 2).sum(axis=1))
    return code, scale, (off * (1 + SINGLE) + SLACK).astype(np.float32)


def _assign(pivots: dict[int, np.ndarray], tau: float, payload: str):
    """Rows of classes to rows of cells, without the vector, with it at one byte a component, or as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.asarray(whole.column("dim"))
            for dim in np.unique(sizes).tolist():
                batch = whole.filter(pa.array(sizes == dim))
                v = unit_vectors(batch.column("embedding"))
                p = pivots[dim] if dim in pivots else np.eye(1, dim)
                row, cell, at_home, core = cells_of(v, p, tau)
                out = batch.take(pa.array(row))
                columns = {"label": out.column("label"), "dim": out.column("dim"), "pivot": pa.array(cell.astype(np.int32)), "home": pa.array(at_home), "core": pa.array(core), "cls": out.column("cls"), "w": out.column("w")}
                if payload == "code":
                    code, scale, bound = one_byte(v)
                    packed = pa.array([x.tobytes() for x in code], pa.binary())
                    columns |= {"code": packed.take(pa.array(row)), "scale": pa.array(scale[row]), "bound": pa.array(bound[row])}
                elif payload == "vector":
                    columns["embedding"] = out.column("embedding")
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _sides(unit: pa.Table) -> tuple[np.ndarray, np.ndarray, bool, list[tuple[np.ndarray, np.ndarray]]]:
    """(home, core, whether the block meets itself, the pairs of row sets to compare) of a unit. Visitors never meet."""
    home, core, block = (np.asarray(unit.column(c)) for c in ("home", "core", "block"))
    lo, hi = unit.column("lo")[0].as_py(), unit.column("hi")[0].as_py()
    x, y = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    if lo == hi:
        return home, core, True, [(x[home[x]], x[home[x]]), (x[home[x]], x[~home[x]])]
    return home, core, False, [(x[home[x]], y), (x[~home[x]], y[home[y]])]


def _tiles(unit: pa.Table, reach) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(x, y, hits, whether x and y are of one set) by tiles; reach gives the hits of two row sets by distance alone."""
    _, core, _, sides = _sides(unit)
    for x, y in sides:
        for at in range(0, len(x), TILE):
            part = x[at : at + TILE]
            if not len(y):
                continue
            hit = reach(part, y) & ~(core[part][:, None] & core[y][None])
            same = y is x or (len(x) == len(y) and x[0] == y[0])
            if same:
                hit[np.arange(len(part)), at + np.arange(len(part))] = False
            if hit.any():
                yield part, y, hit, same


def _possible(cosine: float):
    """Units of one-byte vectors to the classes that may have a partner in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs(batches, "unit"):
            scale, bound, cls = (np.asarray(unit.column(c)) for c in ("scale", "bound", "cls"))
            v = np.frombuffer(b"".join(unit.column("code").to_pylist()), np.int8).reshape(len(cls), -1) * scale[:, None]
            found = np.zeros(len(cls), bool)

            def reach(x, y, v=v, bound=bound):
                a, b = bound[x][:, None], bound[y][None]
                return v[x] @ v[y].T >= cosine - SINGLE - a - b - a * b

            for x, y, hit, _ in _tiles(unit, reach):
                found[x] |= hit.any(axis=1)
                found[y] |= hit.any(axis=0)
            if found.any():
                yield pa.RecordBatch.from_arrays([pa.array(cls[found])], names=["cls"])

    return run


def link_all(forest: Forest, x: np.ndarray, y: np.ndarray, hit: np.ndarray) -> None:
    """Links rows x and y wherever they hit: minima spread along hits until they stay."""
    none = len(x)
    own, other = np.arange(len(x), dtype=np.int32), np.full(len(y), none, np.int32)
    while True:
        reached = np.where(hit, own[:, None], none).min(axis=0)
        nearer = np.minimum(own, np.where(hit, reached[None], none).min(axis=1))
        if (reached == other).all() and (nearer == own).all():
            break
        own, other = nearer, reached
    for i in np.flatnonzero(own != np.arange(len(x))).tolist():
        forest.link(int(x[i]), int(x[own[i]]))
    for i in np.flatnonzero(other < none).tolist():
        forest.link(int(y[i]), int(x[other[i]]))


def _compare(cosine: float):
    """Units of whole vectors to (cls, n, other): the links of each class in them, and the least class it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs(batches, "unit"):
            v = unit_vectors(unit.column("embedding"))
            cls, w = (np.asarray(unit.column(c)) for c in ("cls", "w"))
            number, forest = np.zeros(len(v), np.int64), Forest(len(v))
            for x, y, hit, same in _tiles(unit, lambda x, y, v=v: v[x] @ v[y].T >= cosine):
                number[x] += hit @ w[y]
                if not same:
                    number[y] += hit.T @ w[x]
                link_all(forest, x, y, hit)
            roots = forest.roots()
            least = np.full(len(v), np.iinfo(np.int64).max)
            np.minimum.at(least, roots, cls)
            other = least[roots]
            keep = number > 0
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(cls[keep]), pa.array(number[keep]), pa.array(other[keep])], names=["cls", "n", "other"])

    return run


CELL = ["label", "dim", "pivot"]


def _blocks(assigned: DataFrame, rows: int | None) -> DataFrame:
    """A row a cell: how many blocks (of BLOCK_BYTES, or of so many rows) its rows fill, those of the core apart."""
    block = F.lit(rows) if rows else F.greatest(F.lit(FEWEST), F.floor(BLOCK_BYTES / (8 * F.max("dim"))))
    rest, everyone = F.sum((~F.col("core")).cast("int")), F.count("*")
    return assigned.groupBy(*CELL).agg(F.ceil(rest / block).cast("int").alias("rest_blocks"), F.ceil((everyone - rest) / block).cast("int").alias("core_blocks"), everyone.alias("rows"))


def _units(assigned: DataFrame, cells: DataFrame, payload: list[str]) -> DataFrame:
    """The rows that meet, dealt by unit: two blocks of a cell. The core's blocks come after the others', and never meet each other."""
    placed = assigned.join(small(cells.where("rows > 1 AND rest_blocks > 0")), CELL)
    number = lambda blocks: F.pmod(F.xxhash64("cls", "pivot"), blocks)
    at = F.when(F.col("core"), F.col("rest_blocks") + number("core_blocks")).otherwise(number("rest_blocks")).cast("int")
    partners = F.when(F.col("core"), F.col("rest_blocks")).otherwise(F.col("rest_blocks") + F.col("core_blocks"))
    dealt = placed.withColumn("block", at).withColumn("with", F.explode(F.sequence(F.lit(0), partners - 1)))
    dealt = dealt.withColumn("lo", F.least("block", "with")).withColumn("hi", F.greatest("block", "with")).withColumn("unit", F.xxhash64(*CELL, "lo", "hi"))
    order = [*CELL, "lo", "hi"]
    unit = F.concat_ws(":", *[F.col(c).cast("string") for c in order])
    return dealt.repartition("unit").sortWithinPartitions("unit", *order).select(unit.alias("unit"), "lo", "hi", "block", "home", "core", "cls", *payload)


def _valid(e: Column) -> Column:
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & ~odd & F.exists(e, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", block: int | None = None) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept. block: rows of a block, instead of BLOCK_BYTES."""
    tau = math.sqrt(2 - 2 * cosine)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).alias("label"))
    rows = rows.withColumn("valid", _valid(F.col("embedding")))
    rows = rows.withColumn("key", F.when(F.col("valid"), F.xxhash64("label", "embedding"))).withColumn("key2", F.when(F.col("valid"), F.xxhash64("embedding", F.lit(1), "label")))
    classes = rows.where("valid").groupBy("key", "key2", "label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"))
    # numbered as written: whatever a retry numbers anew is not there to be read
    classes = materialize(classes.withColumn("dim", F.size("embedding")).withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    number = classes.count()
    drawn = classes.where(F.pmod("key2", F.lit(1 << 30)) < F.lit(SAMPLE / max(1, number) * (1 << 30))).select("label", "dim", "key2", "embedding").collect()  # about SAMPLE rows
    pivots = {}
    for dim in {r["dim"] for r in drawn}:
        own = sorted((r for r in drawn if r["dim"] == dim), key=lambda r: r["key2"])
        unit = unit_vectors(pa.array([r["embedding"] for r in own], pa.list_(pa.float64())))
        _, labels = np.unique(np.array([str(r["label"]) for r in own]), return_inverse=True)
        pivots[dim] = plan_pivots(unit, labels, number * len(own) / len(drawn), tau, block)
    kind = dict(classes.dtypes)
    schema = f"label {kind['label']}, dim int, pivot int, home boolean, core boolean, cls long, w long"

    def assigned(of: DataFrame, payload: str = "", more: str = "") -> DataFrame:
        return of.select("label", "dim", "cls", "w", "embedding").mapInArrow(_assign(pivots, tau, payload), schema + more)

    cells = materialize(_blocks(assigned(classes), block), "vector-cells")
    possible = _units(assigned(classes, "code", ", code binary, scale float, bound float"), cells, ["code", "scale", "bound"]).mapInArrow(_possible(cosine), "cls long")
    possible = materialize(possible.distinct(), "vector-possible")
    met = materialize(classes.join(small(possible), "cls", "left_semi"), "vector-met")
    met_cells = materialize(_blocks(assigned(met), block), "vector-met-cells")
    found = _units(assigned(met, "vector", f", embedding {kind['embedding']}"), met_cells, ["w", "embedding"]).mapInArrow(_compare(cosine), "cls long, n long, other long")
    cores = materialize(assigned(classes).where("core").select(*CELL, "cls", "w"), "vector-cores")
    sums = cores.groupBy(*CELL).agg(F.sum("w").alias("core_w"), F.min("cls").alias("other"))
    in_core = cores.join(small(sums), CELL).select("cls", (F.col("core_w") - F.col("w")).alias("n"), "other")
    counts = materialize(found.union(in_core), "vector-links")
    links = counts.groupBy("cls").agg(F.sum("n").alias("n"))
    roots = connected_components(counts.select(F.col("cls").alias("a"), F.col("other").alias("b")))
    members = roots.select(F.col("node").alias("cls"), "root").union(roots.select(F.col("root").alias("cls"), "root").distinct())
    least = members.join(classes.select("cls", "rep"), "cls").groupBy("root").agg(F.min("rep").alias("component"))
    named = members.join(least, "root").select("cls", "component")
    per_class = classes.select("key", "key2", "cls", "rep", "w").join(links, "cls", "left").join(named, "cls", "left")
    per_class = per_class.select("key", "key2", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id", "key", "key2").join(per_class, ["key", "key2"], "left")
    component = F.coalesce("component_id", "vec_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
    out = materialize(out, "vector-result")
    discard(classes, cells, possible, met, met_cells, cores, counts, roots)
    return out
