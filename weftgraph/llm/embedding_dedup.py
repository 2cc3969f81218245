"""Embedding near-dedup as an exact metric range join.

On unit vectors a cosine of at least c is a distance of at most r = sqrt(2 - 2c).
Pivots, chosen in dense groups and far apart, cut the space into cells of nearest pivot; a cell has a ball,
the vectors within half the linking angle of its pivot, and a rest.  By the triangle
inequality all vectors of one ball link with each other: they are counted, not compared.
A vector x can have a partner in a cell with pivot p and distances from near to far only
if near - r <= d(x, p) <= far + r and x is at most r from the plane halfway between
p and its own pivot.  Cells are packed, neighbours together, into groups of bounded
size (a large cell fills several), and a vector is replicated only to those pairs of
its own group with another, or with itself, where it can have a partner.  Each pair of
groups is joined independently, cell against cell, with the vectors of each that reach
the other: in single precision, then in double precision where that is near the threshold.

Equal vectors are one class, compared once and counted by their number.  A join emits
sums and a spanning forest, never its pairs.

Vectors of one length are compared with each other: each length has its own cells,
and pivots by its share of the table.

Vectors that are null, zero, hold null or non-finite components, or have a null id
link with nothing and stay.  Rows repeated with their id count as one vector.  Labels
and extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import lean, staged, table
from weftgraph.runtime import first_per
from weftgraph.llm.components import connected_components

COSINE = 0.95
#: Vectors per pivot, least and most pivots of a length, and drawn vectors a pivot is chosen of.
PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS, DRAWN = 1024, 8, 4096, 4
#: Lengths with fewer vectors are one cell.
FEW = 64
#: Vectors of a group, and least groups of a length, so that small tables have parallel pairs too.
BLOCK, LEAST_GROUPS = 32_768, 3
#: Rows and columns of one matrix of cosines.
TILE = 2048
#: Single precision is off by less than this for vectors of some thousand components.
UNSURE = 1e-4


def unit(flat, length: int):
    """Vectors of one length, one after the other, as unit rows in double precision."""
    import numpy as np

    x = flat.astype(np.float64).reshape(-1, length)
    # Scaled first, so that tiny and huge components neither vanish nor overflow.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def by_length(batch: pa.RecordBatch, lengths) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batch by the length of its vectors."""
    import numpy as np

    own = np.unique(lengths)
    for d in own:
        yield int(d), batch if len(own) == 1 else batch.filter(pa.array(lengths == d))


def chosen_pivots(x, k: int, half: float):
    """k rows of a drawn sample x: first those with most others within distance ``half``, one
    for each dense group and at most half of all, so that a hot group has a ball; then each
    time the one farthest from those before it.  Ordered so that neighbours are near."""
    import numpy as np

    k = min(k, len(x))
    least = 1 - half * half / 2  # the cosine at that distance
    beside = np.concatenate([(x[i : i + 512] @ x.T >= least).sum(axis=1) for i in range(0, len(x), 512)])
    best = np.full(len(x), 2.0)
    out: list[int] = []
    while len(out) < k:
        dense = np.where((beside > 2) & (best > 1 - least), beside, 0) if 2 * len(out) < k else np.zeros(1)
        out.append(int(dense.argmax()) if dense.any() else int(best.argmax()))
        best = np.minimum(best, 1 - x @ x[out[-1]])
    p = x[out]
    order, left = [0], np.ones(k, bool)
    while len(order) < k:
        left[order[-1]] = False
        order.append(int(np.where(left, p @ p[order[-1]], -2.0).argmax()))
    return p[order]


def half_distance(cosine: float) -> float:
    """The distance of half the linking angle, a little less, or -1 if there is none."""
    angle = math.acos(max(-1.0, min(1.0, cosine)))
    return 2 * math.sin(angle / 4 - 1e-7) - 1e-9 if angle > 1e-5 else -1.0


class Space:
    """The cells of the vectors of one length: cell 2k is the ball of pivot k, 2k + 1 its rest."""

    def __init__(self, pivots, cosine: float):
        import numpy as np

        self.pivots = pivots
        self.radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
        self.half = half_distance(cosine)
        cells = max(2, 2 * len(pivots))
        self.near, self.far = np.full(cells, np.inf), np.full(cells, -np.inf)
        self.group, self.parts = np.zeros(cells, np.int64), np.ones(cells, np.int64)
        self.groups = 1

    def distances(self, x):
        import numpy as np

        return np.sqrt(np.maximum(0, 2 - 2 * (x @ self.pivots.T)))

    def cells(self, x):
        """The cell of each vector, and its distance to the pivot."""
        import numpy as np

        if not len(self.pivots):
            return np.ones(len(x), np.int64), np.zeros(len(x))
        d = self.distances(x)
        own = d.argmin(axis=1)
        mine = d[np.arange(len(x)), own]
        return 2 * own + (mine > self.half), mine

    def pack(self, rows: dict[int, int], block: int, least_groups: int) -> None:
        """Cells of so many rows to groups of at most ``block`` rows, in the order of the pivots."""
        most = max(256, min(block, -(-sum(rows.values()) // least_groups)))
        held = at = 0
        for cell in sorted(rows):
            n = rows[cell]
            if n > most:
                at += held > 0
                self.group[cell], self.parts[cell] = at, -(-n // most)
                at, held = at + int(self.parts[cell]), 0
                continue
            if held and held + n > most:
                at, held = at + 1, 0
            self.group[cell] = at
            held += n
        self.groups = int(at + (held > 0))

    def reach(self, x, own, cells):
        """Whether each vector, of cells ``own``, can have a partner to compare in each of ``cells``."""
        import numpy as np

        if not len(self.pivots):
            return np.ones((len(x), len(cells)), bool)
        mine = np.sqrt(np.maximum(0, 2 - 2 * (x * self.pivots[own // 2]).sum(axis=1)))[:, None]
        pivots, where = np.unique(cells // 2, return_inverse=True)
        p = self.pivots[pivots]
        d = np.sqrt(np.maximum(0, 2 - 2 * (x @ p.T)))
        own_pivots, of = np.unique(own // 2, return_inverse=True)
        between = np.sqrt(np.maximum(0, 2 - 2 * (self.pivots[own_pivots] @ p.T)))[of]
        same = own_pivots[of][:, None] == pivots[None, :]
        plane = same | (d * d - mine * mine <= 2 * between * self.radius + 1e-9)
        d, plane = d[:, where], plane[:, where]
        out = plane & (d <= self.far[cells] + self.radius + 1e-9) & (d >= self.near[cells] - self.radius - 1e-9)
        # Vectors of one ball link without being compared.
        out &= ~((own[:, None] == cells[None, :]) & (own % 2 == 0)[:, None])
        return out


def forest(match, rows, columns):
    """The least label of each row and of each column over the bipartite graph of a
    boolean matrix; those without a link keep their own.  A node that is a row and a
    column has two labels, and the links hold together only with both."""
    import numpy as np

    r, c = np.flatnonzero(match.any(axis=1)), np.flatnonzero(match.any(axis=0))
    least_rows, least_columns = rows.astype(np.int64), columns.astype(np.int64)
    if not len(r):
        return least_rows, least_columns
    own = match[np.ix_(r, c)]
    top = np.int64(2**63 - 1)
    left, right = least_rows[r], least_columns[c]
    while True:
        # Each side takes the least label of its partners until nothing changes.
        new_right = np.minimum(right, np.where(own, left[:, None], top).min(axis=0))
        new_left = np.minimum(left, np.where(own, new_right[None, :], top).min(axis=1))
        if (new_left == left).all() and (new_right == right).all():
            least_rows[r], least_columns[c] = left, right
            return least_rows, least_columns
        left, right = new_left, new_right


def classes(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, DataFrame]:
    """Usable (vec_id, v), and (cls, v, first_id, n): one row per distinct vector."""
    v = F.col(embedding)
    usable = vectors.select(F.col(vec_id).alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull()
        & F.coalesce(
            (F.size(v) > 0)
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(v, lambda x: x != 0),
            F.lit(False),
        )
    )
    distinct = (
        usable.groupBy("v", "vec_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("v")
        .agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .withColumn("cls", F.monotonically_increasing_id())
    )
    return usable, staged(distinct, "vector-classes")


def spaces(kinds: DataFrame, cosine: float, per_pivot: int = PER_PIVOT) -> dict[int, Space]:
    """The pivots of each length of (cls, v, n) that has ``FEW`` vectors or more."""
    import numpy as np

    spark = kinds.sparkSession
    sized = kinds.withColumn("length", F.size("v"))
    rows = {r["length"]: r["n"] for r in sized.groupBy("length").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FEW).collect()}
    total = sum(rows.values())
    # In all at most MOST_PIVOTS and LEAST_PIVOTS a length.
    wanted = {d: max(LEAST_PIVOTS, min(n // per_pivot, n * MOST_PIVOTS // total)) for d, n in rows.items()}
    if not wanted:
        return {}
    many = F.broadcast(spark.createDataFrame([(d, DRAWN * k) for d, k in wanted.items()], "length int, most int"))
    drawn = first_per(sized.join(many, "length"), ["length"], [F.xxhash64("v"), "cls"], DRAWN * max(wanted.values())).filter("_rank <= most")
    found: dict[int, list] = {}
    for r in drawn.select("length", "_rank", "v").orderBy("length", "_rank").collect():
        found.setdefault(r["length"], []).append(r["v"])
    return {d: Space(chosen_pivots(unit(np.array(v).ravel(), d), wanted[d], half_distance(cosine)), cosine) for d, v in found.items()}


def dealt(kinds: DataFrame, cosine: float = COSINE, per_pivot: int = PER_PIVOT, block: int = BLOCK) -> tuple[DataFrame, DataFrame, dict]:
    """Of (cls, v, n): the pairs of groups to join, as rows (length, a, b, side, cls, n, cell,
    x) of their vectors; what the balls count, as rows (cls, links, least); and the spaces."""
    import numpy as np

    kind = "f4" if kinds.schema["v"].dataType.elementType.simpleString() == "float" else "f8"
    found = spaces(kinds, cosine, per_pivot)

    def space(length: int) -> Space:
        return found[length] if length in found else Space(np.empty((0, length)), cosine)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for whole in batches:
            for length, batch in by_length(whole, pc.list_value_length(whole.column(2)).to_numpy()):
                flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
                own, mine = space(length).cells(unit(flat, length))
                raw = flat.astype(kind).reshape(-1, length)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array([length] * len(batch), pa.int32()),
                        pa.array(own, pa.int32()),
                        pa.array(mine, pa.float64()),
                        pa.array([r.tobytes() for r in raw], pa.binary()),
                    ],
                    ["cls", "n", "length", "cell", "d", "x"],
                )

    schema = "cls long, n long, length int, cell int, d double, x binary"
    cells = staged(kinds.select("cls", "n", "v").mapInArrow(lean(assign), schema), "cells")
    pivoted = F.col("length").isin(list(found))
    stats = (
        cells.filter(pivoted)
        .groupBy("length", "cell")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.min("cls").alias("least"), F.min("d").alias("near"), F.max("d").alias("far"))
        .collect()  # two rows per pivot
    )
    few = cells.filter(~pivoted).groupBy("length").agg(F.count(F.lit(1)).alias("rows"))
    per_length: dict[int, dict[int, int]] = {r["length"]: {1: r["rows"]} for r in few.filter("rows > 1").collect()}  # of few vectors each
    balls = {}
    for r in stats:
        per_length.setdefault(r["length"], {})[r["cell"]] = r["rows"]
        found[r["length"]].near[r["cell"]], found[r["length"]].far[r["cell"]] = r["near"], r["far"]
        if r["cell"] % 2 == 0 and r["rows"] > 1:
            balls[r["length"], r["cell"]] = (r["n"], r["least"])
    for length, rows in per_length.items():
        found.setdefault(length, space(length)).pack(rows, block, LEAST_GROUPS)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for length, batch in by_length(whole, whole.column(2).to_numpy()):
                s = space(length)
                x = unit(np.frombuffer(b"".join(batch.column(5).to_pylist()), kind), length)
                own, cls = batch.column(3).to_numpy().astype(np.int64), batch.column(0).to_numpy()
                mine = s.group[own] + cls % s.parts[own]
                used = np.flatnonzero(np.isfinite(s.far)) if len(s.pivots) else np.array([1])
                reach = s.reach(x, own, used)
                goes = np.zeros((len(x), s.groups), bool)
                for j, cell in enumerate(used):
                    goes[:, s.group[cell] : s.group[cell] + s.parts[cell]] |= reach[:, j : j + 1]
                row, other = np.nonzero(goes)
                for i in range(0, len(row), 20_000):
                    r, o = row[i : i + 20_000], other[i : i + 20_000]
                    take = pa.array(r)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([length] * len(r), pa.int32()),
                            pa.array(np.minimum(mine[r], o), pa.int32()),
                            pa.array(np.maximum(mine[r], o), pa.int32()),
                            pa.array((mine[r] > o).astype(np.int32)),
                            *(batch.column(k).take(take) for k in (0, 1, 3, 5)),
                        ],
                        ["length", "a", "b", "side", "cls", "n", "cell", "x"],
                    )

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each vector of a ball has in it beside itself."""
        for batch in batches:
            keys = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            rows = [
                (c, balls[k][0] - n, balls[k][1])
                for c, n, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), keys, strict=True)
                if k in balls
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["cls", "links", "least"])

    pairs = cells.mapInArrow(lean(deal), "length int, a int, b int, side int, cls long, n long, cell int, x binary")
    in_balls = cells.filter("cell % 2 = 0").mapInArrow(counted, "cls long, links long, least long")
    return pairs, in_balls, found


def links(kinds: DataFrame, cosine: float = COSINE, per_pivot: int = PER_PIVOT, block: int = BLOCK) -> DataFrame:
    """Of (cls, v, n): rows (cls, links, least), to be summed and joined up by class."""
    import numpy as np

    spark = kinds.sparkSession
    pairs, in_balls, found = dealt(kinds, cosine, per_pivot, block)
    kind = "f4" if kinds.schema["v"].dataType.elementType.simpleString() == "float" else "f8"

    def joined(length: int, sides) -> Iterator[pa.RecordBatch]:
        """Two groups, or one with itself, as (cls, n, cell, x)."""
        space = found.get(length) or Space(np.empty((0, length)), cosine)  # a vector alone in its length

        def prepared(side):
            cls, n, cell, raw = side
            x = unit(np.frombuffer(b"".join(raw), kind), length)
            order = np.argsort(cell, kind="stable")
            return cls[order], n[order], cell[order], x[order]

        left = prepared(sides[0])
        right = prepared(sides[1]) if sides[1] is not None else left
        alone = sides[1] is None
        cells = [np.unique(s[2], return_index=True) for s in (left, right)]
        ends = [np.append(c[1][1:], len(s[2])) for c, s in zip(cells, (left, right), strict=True)]
        reach = [space.reach(s[3], s[2], c[0]) for s, c in ((left, cells[1]), (right, cells[0]))]
        single = left[3].astype(np.float32), right[3].astype(np.float32)
        sums = np.zeros(len(left[0])), np.zeros(len(right[0]))
        out: list[tuple] = []

        def meet(ra, rb, triangle):
            match = single[0][ra] @ single[1][rb].T
            close = np.argwhere(np.abs(match - cosine) < UNSURE)
            match = match >= cosine
            for i in range(0, len(close), 20_000):
                k = close[i : i + 20_000]
                match[k[:, 0], k[:, 1]] = (left[3][ra[k[:, 0]]] * right[3][rb[k[:, 1]]]).sum(axis=1) >= cosine
            if triangle:  # each pair once
                match = np.triu(match, 1)
            if match.any():
                np.add.at(sums[0], ra, match @ right[1][rb])
                np.add.at(sums[1], rb, left[1][ra] @ match)
                a, b = forest(match, left[0][ra], right[0][rb])
                out.extend((left[0][ra][k], a[k]) for k in np.flatnonzero(a != left[0][ra]))
                out.extend((right[0][rb][k], b[k]) for k in np.flatnonzero(b != right[0][rb]))

        for i, cell in enumerate(cells[0][0]):
            own = np.arange(cells[0][1][i], ends[0][i])
            for j, other in enumerate(cells[1][0]):
                if alone and j < i:
                    continue
                ra = own[reach[0][own, j]]
                theirs = np.arange(cells[1][1][j], ends[1][j])
                rb = theirs[reach[1][theirs, i]]
                same = alone and i == j
                for k in range(0, len(ra), TILE):
                    for m in range(k if same else 0, len(rb), TILE):
                        meet(ra[k : k + TILE], rb[m : m + TILE], same and k == m)
        total = sums[0] + sums[1] if alone else None
        for cls, s in ((left[0], total),) if alone else ((left[0], sums[0]), (right[0], sums[1])):
            some = np.flatnonzero(s)
            out.extend(zip(cls[some], cls[some], s[some], strict=True))
        for i in range(0, len(out), 50_000):
            part = out[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(r[0]) for r in part], pa.int64()),
                    pa.array([int(r[2]) if len(r) > 2 else 0 for r in part], pa.int64()),
                    pa.array([int(r[1]) for r in part], pa.int64()),
                ],
                ["cls", "links", "least"],
            )

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by pair and side; both sides of a pair are held."""
        key, held = None, ([], [])

        def close():
            if key is not None and held[0] and (key[1] == key[2] or held[1]):
                parts = [[np.concatenate(c) if k < 3 else sum(c, []) for k, c in enumerate(zip(*h, strict=True))] if h else None for h in held]
                yield from joined(key[0], parts)

        for batch in batches:
            names = np.stack([batch.column(k).to_numpy() for k in range(4)])
            cuts = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1), len(batch)]
            for at, end in zip(cuts[:-1], cuts[1:], strict=True):
                if at == end:
                    continue
                own = tuple(int(v) for v in names[:3, at])
                if own != key:
                    yield from close()
                    key, held = own, ([], [])
                part = batch.slice(at, end - at)
                held[int(names[3, at])].append(
                    (part.column(4).to_numpy(), part.column(5).to_numpy().astype(np.float64), part.column(6).to_numpy(), part.column(7).to_pylist())
                )
        yield from close()

    return (
        pairs.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), "length", "a", "b")
        .sortWithinPartitions("length", "a", "b", "side")
        .mapInArrow(lean(compare), "cls long, links long, least long")
        .unionByName(in_balls)
    )


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors."""
    usable, kinds = classes(vectors, vec_id, embedding)
    found = staged(links(kinds, cosine), "links")
    sums = found.groupBy("cls").agg(F.sum("links").alias("links"))
    joined = connected_components(found.select(F.col("cls").alias("a"), F.col("least").alias("b")))
    labelled = kinds.join(joined, kinds["cls"] == joined["node"], "left").withColumn(
        "component", F.coalesce("component", "cls")
    )
    firsts = staged(labelled.groupBy("component").agg(F.min("first_id").alias("component_id")), "first-ids")
    by_class = staged(
        labelled.join(firsts, "component")
        .join(sums, "cls", "left")
        .select("v", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")),
        "vector-links",
    )
    id_ = F.col("r.vec_id")
    return (
        vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v"))
        .withColumn("h", F.xxhash64("v"))  # sorted by, where two arrays would be slow to compare
        .alias("r")
        .join(by_class.withColumn("h", F.xxhash64("v")).alias("c"), (F.col("r.h") == F.col("c.h")) & (F.col("r.v") == F.col("c.v")), "left")
        .select(
            id_.alias("vec_id"),
            F.when(id_.isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
            F.when(id_.isNotNull(), F.coalesce("component_id", id_)).alias("component_id"),
            F.coalesce(id_ == F.coalesce("component_id", id_), F.lit(True)).alias("kept"),
        )
    )


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reach(a, b) AS (
  SELECT a, b FROM link
  UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), found AS (
  SELECT vec_id,
         (SELECT count(*) FROM link WHERE a = vec_id) AS n_links,
         least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id
  FROM embeddings
)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM found
"""
