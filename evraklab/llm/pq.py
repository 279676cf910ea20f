"""Embedding near-duplicates by product quantisation over coarse inverted lists.

Equal vectors are one class first. Classes go to the inverted list of their nearest
coarse centroid, as residual codes of subspaces. A class is searched in its nearest
lists: asymmetric table look-ups give its distance to every coded member; as each
member's own coding error is kept, the triangle inequality tells losslessly which members
can be close enough, and those are compared by exact cosine in double precision. What a
search can miss is only a neighbour in a list that neither of the two looks into.

Centroids and codebooks are fitted on a bounded sample (``SAMPLE`` classes, the first by
hash); every vector is indexed and searched. Lists get ``LIST`` members on average, so
the work grows with the vectors. A list's members and searches are dealt to blocks of at
most about ``BLOCK``, so a dense list is spread. Blocks return counts and a spanning
forest of their links, never the pairs.

Vectors that are null, zero, or hold a null or non-finite component link with nothing
and are kept. Vectors of different lengths do not link. Rows of equal ids are rows of
their own; a null id is not kept unless it has no links. Other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evraklab.llm.core import components, map_batches, staged

COSINE = 0.9
SAMPLE = 1 << 14
LIST = 128
MAX_LISTS = 4096
PROBES = 8
SUBSPACES = 8
CODEWORDS = 64
BLOCK = 4096
SLICE = 256


def _nearest(points: np.ndarray, centres: np.ndarray, k: int = 1) -> np.ndarray:
    """The ``k`` nearest centres of each point, nearest first."""
    d = (centres**2).sum(axis=1) - 2 * points @ centres.T
    if k == 1:
        return d.argmin(axis=1)[:, None]
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def k_means(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(5)
    centres = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        at = _nearest(points, centres)[:, 0]
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, points)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


@dataclass
class Index:
    """Coarse centroids and the codebooks of the residuals' subspaces."""

    centres: np.ndarray
    books: np.ndarray  # subspace x codeword x dimension

    @property
    def width(self) -> int:
        return self.centres.shape[1]

    def padded(self, units: list[bytes]) -> np.ndarray:
        """Unit vectors as rows; longer ones than the index are cut only for coding."""
        out = np.zeros((len(units), self.width))
        for i, u in enumerate(units):
            v = np.frombuffer(u)[: self.width]
            out[i, : len(v)] = v
        return out

    def codes(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codeword of each subspace, and the length of what the codes leave."""
        parts = residuals.reshape(len(residuals), SUBSPACES, -1)
        codes = np.stack([_nearest(parts[:, j], self.books[j])[:, 0] for j in range(SUBSPACES)], axis=1)
        coded = np.stack([self.books[j][codes[:, j]] for j in range(SUBSPACES)], axis=1)
        return codes.astype(np.uint8), np.sqrt(((parts - coded) ** 2).sum(axis=(1, 2)))

    def distances(self, residuals: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of searched residuals to coded ones, by table look-ups."""
        parts = residuals.reshape(len(residuals), SUBSPACES, -1)
        total = np.zeros((len(residuals), len(codes)))
        for j in range(SUBSPACES):
            table = ((parts[:, j, None, :] - self.books[j][None]) ** 2).sum(axis=2)
            total += table[:, codes[:, j]]
        return np.sqrt(total)


def fit(sample: list[bytes], classes: int) -> Index:
    """Fit the index on sampled unit vectors, for so many classes in all."""
    longest = max(len(u) // 8 for u in sample)
    width = -(-longest // SUBSPACES) * SUBSPACES
    points = np.zeros((len(sample), width))
    for i, u in enumerate(sample):
        points[i, : len(u) // 8] = np.frombuffer(u)
    lists = int(np.clip(classes // LIST, 1, min(MAX_LISTS, len(points))))
    centres = k_means(points, lists)
    residuals = points - centres[_nearest(points, centres)[:, 0]]
    parts = residuals.reshape(len(points), SUBSPACES, -1)
    words = min(CODEWORDS, len(points))
    return Index(centres, np.stack([k_means(parts[:, j], words) for j in range(SUBSPACES)]))


def _units(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Unit vectors as bytes and a hash of the components; both null for what links with nothing."""
    keys, units = [], []
    for value in batch.column(2):
        vector = None
        if value.is_valid:
            vector = value.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
            scale = np.abs(vector).max(initial=0.0)
            if not np.isfinite(vector).all() or not scale:
                vector = None
        if vector is None:
            keys.append(None)
            units.append(None)
            continue
        scaled = vector / scale  # so that squares neither overflow nor vanish
        units.append((scaled / np.sqrt((scaled**2).sum())).tobytes())
        keys.append(xxhash.xxh128_digest((vector + 0.0).tobytes()))
    columns = [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(units, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["row", "id", "key", "unit"])


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least label of each of ``n`` nodes' components, by hooking and pointer jumping."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        new = label.copy()
        np.minimum.at(new, la, low)
        np.minimum.at(new, lb, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, probes: int = PROBES
) -> DataFrame:
    """One row per vector: its id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    slim = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    kind = slim.schema["id"].dataType.simpleString()
    read = staged(map_batches(slim, _units, f"row bigint, id {kind}, key binary, unit binary"))
    valid = read.filter("key IS NOT NULL")
    classes = staged(
        valid.groupBy("key").agg(F.min("row").alias("cls"), F.count("*").alias("size"), F.min("unit").alias("unit"))
    )
    n = classes.count()
    sample = [bytes(r[0]) for r in classes.orderBy(F.xxhash64("key")).select("unit").limit(SAMPLE).collect()]
    if not sample:
        return read.select(
            F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")
        )
    shared = spark.sparkContext.broadcast(fit(sample, n))
    reach = float(np.sqrt(2 - 2 * cosine))

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        index = shared.value
        points = index.padded(batch.column(2).to_pylist())
        lists = _nearest(points, index.centres, min(probes, len(index.centres)))
        codes, errors = index.codes(points - index.centres[lists[:, 0]])
        columns = [
            *batch.columns, pa.array(lists[:, 0].astype(np.int32)),
            pa.array(list(lists.astype(np.int32)), pa.list_(pa.int32())),
            pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors),
        ]
        return pa.RecordBatch.from_arrays(columns, ["cls", "size", "unit", "list", "probes", "codes", "error"])

    # The number of partitions is set, as each row may cost many look-ups later.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = staged(
        map_batches(
            classes.select("cls", "size", "unit").repartition(parts, "cls"), assign,
            "cls bigint, size bigint, unit binary, list int, probes array<int>, codes binary, error double",
        )
    )
    searches = placed.select("cls", "size", "unit", F.explode("probes").alias("list"), F.col("list").alias("home"))
    # Dense lists are cut into blocks of members by blocks of searches.
    pieces = lambda rows, name: rows.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    shape = staged(pieces(placed, "m").join(pieces(searches, "s"), "list"))
    members = placed.join(shape, "list").select(
        "list", F.pmod(F.xxhash64("cls"), F.col("m")).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("j"), "cls", "size", "unit", "probes", "codes", "error",
    )
    searches = searches.join(shape, "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i"),
        F.pmod(F.xxhash64("cls"), F.col("s")).cast("int").alias("j"), "cls", "size", "unit", "home",
    )

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("cls", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        index = shared.value
        number = left.column("list")[0].as_py()
        centre = index.centres[number]
        m_cls, q_cls = left.column("cls").to_numpy(), right.column("cls").to_numpy()
        m_size, q_size = left.column("size").to_numpy(), right.column("size").to_numpy()
        m_units, q_units = left.column("unit").to_pylist(), right.column("unit").to_pylist()
        lengths = np.array([len(u) for u in m_units]), np.array([len(u) for u in q_units])
        width = max(lengths[0].max(), lengths[1].max()) // 8
        full = [np.zeros((len(x), width)) for x in (m_units, q_units)]
        for target, source in zip(full, (m_units, q_units)):
            for i, u in enumerate(source):
                target[i, : len(u) // 8] = np.frombuffer(u)
        codes = np.frombuffer(b"".join(left.column("codes").to_pylist()), np.uint8).reshape(-1, SUBSPACES)
        error = left.column("error").to_numpy()
        home = right.column("home").to_numpy()
        # Whether a member looks into the list a search comes from; if not, the search counts for both.
        looks = [set(p) for p in left.column("probes").to_pylist()]
        residuals = index.padded(q_units) - centre
        m_links, q_links = np.zeros(len(m_cls), np.int64), np.zeros(len(q_cls), np.int64)
        froms, tos = [], []
        for at in range(0, len(q_cls), SLICE):
            close = index.distances(residuals[at : at + SLICE], codes) <= reach + error + 1e-9
            q, m = np.nonzero(close)
            q += at
            different = (q_cls[q] != m_cls[m]) & (lengths[1][q] == lengths[0][m])
            q, m = q[different], m[different]
            for low in range(0, len(q), 1 << 16):
                a, b = q[low : low + (1 << 16)], m[low : low + (1 << 16)]
                linked = np.einsum("ij,ij->i", full[1][a], full[0][b]) >= cosine
                a, b = a[linked], b[linked]
                np.add.at(q_links, a, m_size[b])
                one_way = np.array([home[x] not in looks[y] for x, y in zip(a, b)], bool)
                np.add.at(m_links, b[one_way], q_size[a[one_way]])
                froms.append(a)
                tos.append(b)
        names, code = np.unique(np.concatenate([q_cls, m_cls]), return_inverse=True)
        links = np.zeros(len(names), np.int64)
        np.add.at(links, code, np.concatenate([q_links, m_links]))
        a = code[: len(q_cls)][np.concatenate(froms)] if froms else np.zeros(0, np.int64)
        b = code[len(q_cls) :][np.concatenate(tos)] if tos else np.zeros(0, np.int64)
        root = _forest(a, b, len(names))
        keep = (links > 0) | (root != np.arange(len(names)))
        return pa.table([names[keep], links[keep], names[root][keep]], schema=schema)

    keys = ("list", "i", "j")
    # Both sides come from ``placed``; new names tell their columns apart.
    searches = searches.select(*(F.col(c).alias(c) for c in searches.columns))
    found = staged(members.groupBy(*keys).cogroup(searches.groupBy(*keys)).applyInArrow(search, "cls bigint, links bigint, root bigint"))
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    named = classes.select("key", "cls", "size").join(counts, "cls", "left")
    named = named.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select(
        "key", "size", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cls").alias("root")
    )
    rows = staged(read.select("row", "id", "key").join(named, "key", "left"))
    least = rows.filter("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("component_id"))
    return rows.join(least, "root", "left").select(
        F.col("id").alias(id_col),
        F.coalesce(F.col("links") + F.col("size") - 1, F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.col("key").isNull()).alias("kept"),
    )
