"""Embedding near-duplicates by a subspace pigeonhole join (operator 6).

For unit vectors, cosine >= c is a squared distance <= T = 2 - 2c. Vectors are rotated to the
principal axes and cut into blocks; each block gets a share of T in proportion to its share of
the variance. The shares add up to T, so a close pair keeps within its budget in some block.

*Tiles.* A label's vectors are dealt to slabs as wide as the whole radius along the first axis, so that close pairs are
in equal or neighbouring slabs; a slab of over ``CHUNK`` vectors is cut into parts by hash. Each two parts of such
slabs are a tile, a task that compares them, and any pair of vectors is in one tile at most. A label of up to ``CHUNK`` vectors is one
tile, to which each vector goes once; of a larger one, each vector goes to as many tiles as its slab and the two beside it have parts,
so what is shuffled grows with a label's size over ``CHUNK``, and comparisons with its square unless the first axis tells vectors apart.

*Blocks.* Within a tile each block is range-joined: both sides are sorted along the block's first axis, and slices of one
side meet the stretch of the other that their balls can reach. What keeps within the block's budget is a candidate; the union
of the candidates (a pair counts in the first block that it keeps within) is verified on the original
vectors in double precision.

Equal vectors are one row with a multiplicity. Tasks give sums of links and the edges of a spanning forest, never pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.graph import connected_components
from quillspark.storage import materialise

#: Vectors of one side of a tile.
CHUNK = 16_384
#: Rows of a tile's side that are compared at a time.
STEP = 1024
SLACK = 1e-9
#: What a squared distance in single precision may be off by, with room.
ROUGH = 1e-5
#: Large labels up to which their table is broadcast.
LARGE_LABELS = 100_000


def _moments(classes: DataFrame, dim: int):
    """Count, sum and scatter of the unit vectors, summed by the executors."""
    import numpy as np

    def partial(batches):
        import pyarrow as pa

        total = np.zeros(1 + dim + dim * dim)
        for batch in batches:
            x = _unit(batch.column("embedding"), dim)
            total += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], names=["m"])

    rows = classes.select("embedding").mapInArrow(partial, "m array<double>").select(F.posexplode("m")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    out = np.zeros(1 + dim + dim * dim)
    for r in rows:
        out[r.pos] = r.s
    return out[0], out[1 : 1 + dim], out[1 + dim :].reshape(dim, dim)


def _unit(column, dim: int):
    import numpy as np

    x = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].astype(np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Rotation:
    """Principal axes, their blocks, and each block's budget of squared distance."""

    def __init__(self, n: float, total, scatter, cosine: float, blocks: int):
        import numpy as np

        dim = len(total)
        mean = total / max(n, 1)
        values, axes = np.linalg.eigh(scatter / max(n, 1) - np.outer(mean, mean))
        order = np.argsort(-values, kind="stable")
        self.axes = np.ascontiguousarray(axes[:, order])
        variance = np.maximum(values[order], 1e-12)
        self.cuts = [dim * b // blocks for b in range(blocks + 1)]
        shares = np.array([variance[a:b].sum() for a, b in zip(self.cuts, self.cuts[1:])])
        self.budgets = (2 - 2 * cosine) * shares / shares.sum()
        self.blocks = blocks

    def rotate(self, x):
        """Row by row in a fixed order of sums, so equal vectors have equal images everywhere."""
        import numpy as np

        return np.einsum("ij,jk->ik", x, self.axes, optimize=False)

    def within(self, difference, b: int):
        import numpy as np

        part = difference[:, self.cuts[b] : self.cuts[b + 1]]
        return np.einsum("ij,ij->i", part, part) <= self.budgets[b] * (1 + SLACK) + SLACK


def _slabs(classes: DataFrame, rotation: Rotation, dim: int, radius: float) -> DataFrame:
    """``classes`` with ``slab``: the stretch of length ``radius`` along the first axis that a vector is in."""
    shared = classes.sparkSession.sparkContext.broadcast(rotation)
    names = ["label", "id", "copies", "embedding"]

    def place(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                lead = _unit(batch.column("embedding"), dim) @ shared.value.axes[:, 0]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.floor(lead / radius).astype(np.int32))], names=[*names, "slab"])

    kinds = dict(classes.dtypes)
    return classes.select(*names).mapInArrow(place, f"label {kinds['label']}, id long, copies long, embedding {kinds['embedding']}, slab int")


def _tiles(placed: DataFrame) -> DataFrame:
    """Each row once for each tile that it takes part in; ``left``: whether on the tile's first side."""
    sizes = placed.groupBy("label", "slab").agg(F.count("*").alias("n"))
    # a label has no more slabs than the unit sphere is wide
    labels = sizes.groupBy("label").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("slab", F.ceil(F.col("n") / CHUNK).cast("int")))).alias("parts"))
    large = materialise(labels.filter(F.col("n") > CHUNK).select("label", "parts"), "large-labels")
    if large.limit(LARGE_LABELS + 1).count() <= LARGE_LABELS:
        large = F.broadcast(large)
    rows = placed.join(large, "label", "left").withColumn("slab", F.when(F.col("parts").isNull(), 0).otherwise(F.col("slab")))
    parts = lambda slab: F.coalesce(F.element_at("parts", slab), F.lit(0))
    rows = rows.withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.greatest(parts(F.col("slab")), F.lit(1)))).cast("int"))
    upto = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: k < n)
    tile = lambda slab, i, right, j, left: F.struct(slab.alias("slab"), i.alias("i"), right.alias("right"), j.alias("j"), left.alias("left"))
    slab, part = F.col("slab"), F.col("part")
    own = F.when(F.col("parts").isNull(), F.lit(1)).otherwise(parts(slab))
    tiles = F.concat(
        F.transform(upto(own), lambda k: tile(slab, F.least(part, k), slab, F.greatest(part, k), part <= k)),
        F.when(F.col("parts").isNull(), F.array().cast("array<struct<slab:int,i:int,right:int,j:int,left:boolean>>")).otherwise(
            F.concat(
                F.transform(upto(parts(slab + 1)), lambda k: tile(slab, part, slab + 1, k, F.lit(True))),
                F.transform(upto(parts(slab - 1)), lambda k: tile(slab - 1, k, slab, part, F.lit(False))),
            )
        ),
    )
    return rows.select("label", "id", "copies", "embedding", F.explode(tiles).alias("tile")).select("label", "tile.*", "id", "copies", "embedding")


def _candidates(rotation: Rotation, image, block: int, left, right, same: bool):
    """Index pairs of a tile within ``block``'s budget, a slice of one side at a time."""
    import numpy as np

    a, b = rotation.cuts[block], rotation.cuts[block + 1]
    reach = float(np.sqrt(rotation.budgets[block] + ROUGH)) * (1 + SLACK) + SLACK
    x, y = (side[np.argsort(image[side, a], kind="stable")] for side in (left, right))
    lead = image[y, a]
    # the squared distance as one product: x.x + y.y - 2 x.y
    own, other = image[x, a:b], image[y, a:b]
    sums = lambda v: (v * v).sum(1)[:, None]
    own = np.concatenate([-2 * own, sums(own), np.ones((len(own), 1))], 1).astype(np.float32)
    other = np.concatenate([other, np.ones((len(other), 1)), sums(other)], 1).astype(np.float32)
    limit = np.float32(rotation.budgets[block] + ROUGH)
    for at in range(0, len(x), STEP):
        part = image[x[at : at + STEP], a]
        low, high = np.searchsorted(lead, part[0] - reach), np.searchsorted(lead, part[-1] + reach, side="right")
        i, j = np.nonzero(own[at : at + STEP] @ other[low:high].T <= limit)
        i, j = x[at + i], y[low + j]
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 20_000):
            yield i[k : k + 20_000], j[k : k + 20_000]


def _links(tiles: DataFrame, rotation: Rotation, dim: int, cosine: float) -> DataFrame:
    """``id, links, leader``: verified links of each row in each tile, and its forest's least id."""
    shared = tiles.sparkSession.sparkContext.broadcast(rotation)

    def verify(key, frame):
        import numpy as np
        import pandas as pd

        r, same = shared.value, key[1] == key[3] and key[2] == key[4]
        frame = frame.sort_values("id", kind="stable")
        ids, copies, side = frame["id"].to_numpy(), frame["copies"].to_numpy(), frame["left"].to_numpy()
        raw = np.stack(frame["embedding"].to_numpy()).astype(np.float64)
        unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
        image = r.rotate(unit)
        first, second = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(side), np.flatnonzero(~side))
        links, leader = np.zeros(len(ids), np.int64), np.arange(len(ids))

        def root(n):
            while leader[n] != n:
                leader[n] = leader[leader[n]]
                n = leader[n]
            return n

        for block in range(r.blocks if len(first) and len(second) else 0):
            for p, q in _candidates(r, image, block, first, second, same):
                difference = image[p] - image[q]
                keep = r.within(difference, block)
                for earlier in range(block):
                    keep &= ~r.within(difference, earlier)
                p, q = p[keep], q[keep]
                close = np.einsum("ij,ij->i", unit[p], unit[q]) >= cosine
                p, q = p[close], q[close]
                np.add.at(links, p, copies[q])
                np.add.at(links, q, copies[p])
                apart = leader[p] != leader[q]
                for u, v in zip(p[apart], q[apart]):
                    u, v = root(u), root(v)
                    leader[max(u, v)] = min(u, v)
        some = np.flatnonzero(links)
        return pd.DataFrame({"id": ids[some], "links": links[some], "leader": ids[[root(n) for n in some]] if len(some) else ids[:0]})

    return tiles.groupBy("label", "slab", "i", "right", "j").applyInPandas(verify, "id long, links long, leader long")


def embedding_links(
    vectors: DataFrame, cosine: float = 0.93, blocks: int = 4, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding"
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors are compared where labels are equal, not null, and lengths agree. A null, empty or
    zero vector, one with a null or non-finite component, a null label and a null id link with
    nothing and are their own component (null for a null id, which isn't kept). Repeated rows
    count as rows; an empty table gives none; other columns are ignored.
    """
    v = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = materialise(
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
        .withColumn("usable", usable)
        .withColumn("class1", F.when(F.col("usable"), F.xxhash64("label", "embedding")))
        .withColumn("class2", F.when(F.col("usable"), F.xxhash64("embedding", F.lit(7), "label"))),
        "vectors",
    )
    classes = materialise(
        rows.filter("usable").groupBy("class1", "class2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding")),
        "vector-classes",
    )
    found = None
    for (dim,) in classes.select(F.size("embedding")).distinct().collect():
        own = classes.filter(F.size("embedding") == dim)
        rotation = Rotation(*_moments(own, dim), cosine, min(blocks, dim))
        radius = max(2 - 2 * cosine, 0.0) ** 0.5 * (1 + SLACK) + SLACK
        part = _links(_tiles(_slabs(own, rotation, dim, radius)), rotation, dim, cosine)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = materialise(found, "vector-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(found, "id", "leader").withColumnRenamed("node", "id")
    known = classes.join(links, "id", "left").join(components, "id", "left").select("class1", "class2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.select("vec_id", "class1", "class2").join(known, ["class1", "class2"], "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept")
    )
