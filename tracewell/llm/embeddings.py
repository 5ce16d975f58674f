"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector is rotated at random into ``BITS`` dimensions and kept as the signs there:
a corner of the cube.  The stored correction factor, its inner product with that corner,
makes ``<corner(x), rotated(y)> / factor(x)`` an unbiased estimate of ``<x, y>``, and its
error shrinks with the square root of ``BITS`` by a known bound.

Vectors that may be near meet in tables: a key holds, for a few sets of random directions,
the one that the vector follows or opposes most.  Near vectors also have near numbers, as
rows are numbered in order of such a key, so what meets is told by blocks of numbers: a
bucket sends on only which vectors of two blocks are to be compared.  A pair of blocks is
then compared by matrix products: the distance of the codes drops most pairs, the estimate
with its confidence bound the rest, and what may reach the threshold is computed again, in
double precision.  No pair of rows is ever sent; a pair of blocks gives sums of links and a
spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, run_starts, small_batches, whole_runs
from .components import connected_components

BITS = 256
#: Standard errors between an estimate and the threshold at which a pair is given up.
ERRORS = 5.0
#: Share of the pairs exactly at the threshold that some table must bring together.
RECALL = 0.999
#: Rows of one key that one task compares; those of a hotter key are dealt in blocks.
BUCKET_CAP = 4096
#: Of so many vectors one is looked at to find hot keys.
HOT_SAMPLE = 64
#: Vectors with neighbouring numbers that make a block, as a power of two.
BLOCK = 10
#: Directions of a full set; with their opposites, twice as many values.
LANES = 64
WORD = 8
TRIALS = 200_000
SEED = 7


def usable(vector: str) -> Column:
    """Neither null nor empty nor zero, and all components finite."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


#: Rotations by dimension that this process has made, the last one only.  A plain table: a
#: function wrapped in a cache would travel to workers by name, and they may not have the package.
_rotations: dict[int, np.ndarray] = {}


def rotation(dim: int) -> np.ndarray:
    """``dim`` orthonormal columns in at least BITS dimensions, whole words of 64."""
    known = _rotations.get(dim)
    if known is None:
        rows = max(BITS, -(-dim // 64) * 64)
        q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((rows, dim)))
        _rotations.clear()
        known = _rotations[dim] = q * np.sign(np.diag(r))
    return known


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (bytes of sign bits) and correction factors of equally long vectors."""
    turned = unit(vectors) @ rotation(vectors.shape[1]).T
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(turned.shape[1])


def estimate(codes: np.ndarray, factors: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased inner products of coded vectors (rows) with plain ones (columns), and the
    standard error of each row."""
    turned = unit(vectors) @ rotation(vectors.shape[1]).T
    size = turned.shape[1]
    signs = np.unpackbits(codes, axis=1).astype(np.float64) * 2 - 1
    guess = signs @ turned.T / math.sqrt(size) / factors[:, None]
    return guess, np.sqrt(np.maximum(0, 1 - factors**2)) / factors / math.sqrt(size - 1)


def furthest(share: float, size: int) -> int:
    """Distance of two codes beyond which a pair is given up, if they differ in ``share`` of the bits on average."""
    return math.ceil(size * share + ERRORS * math.sqrt(size * share * (1 - share)))


#: Chances by threshold and directions that the driver has tried out.
_together: dict[tuple[float, int], float] = {}


def together(threshold: float, lanes: int) -> float:
    """Chance that two vectors at the threshold follow or oppose the same one of so many
    random directions most, found by trials with a fixed seed: the two vectors' products with
    the directions are pairs of normal numbers with the threshold as correlation.  Two standard
    errors are taken off."""
    if (threshold, lanes) in _together:
        return _together[threshold, lanes]
    rng = np.random.default_rng([SEED, lanes])
    same = 0
    for _ in range(TRIALS // 10_000):
        x, z = rng.standard_normal((2, 10_000, lanes))
        same += int((_follow(x) == _follow(threshold * x + math.sqrt(1 - threshold**2) * z)).sum())
    p = same / TRIALS
    _together[threshold, lanes] = p - 2 * math.sqrt(p * (1 - p) / TRIALS)
    return _together[threshold, lanes]


def _follow(products: np.ndarray) -> np.ndarray:
    """Twice the number of the largest product by size, plus its sign."""
    best = np.abs(products).argmax(axis=1)
    return 2 * best + (np.take_along_axis(products, best[:, None], axis=1)[:, 0] > 0)


def tables(rows: int, threshold: float) -> tuple[tuple[int, ...], int]:
    """Directions of each set of a key, and number of tables, for so many vectors: about eight
    unrelated vectors a bucket at most, and enough tables for RECALL at the threshold.  Tables
    have directions of their own, so a pair's meetings in them are independent."""
    want, lanes = max(2.0, rows / 8), []
    while want > 1:
        lanes.append(min(LANES, 1 << max(0, math.ceil(math.log2(want)) - 1)))
        want /= 2 * lanes[-1]
    p = math.prod(together(threshold, n) for n in lanes)
    return tuple(lanes), math.ceil(math.log(1 - RECALL) / math.log(1 - p))


def table_keys(vectors: np.ndarray, table: int, lanes: tuple[int, ...]) -> np.ndarray:
    """Keys of unit vectors of one length in one table, spread over 64 bits."""
    dim = vectors.shape[1]
    directions = np.random.default_rng([SEED, dim, table]).standard_normal((dim, sum(lanes)))
    products = vectors @ directions
    key, at = np.full(len(vectors), (dim << 20) + table, np.uint64), 0
    for n in lanes:
        key = key * np.uint64(2 * LANES) + _follow(products[:, at : at + n]).astype(np.uint64)
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        at += n
    return (key ^ (key >> np.uint64(29))).view(np.int64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _by_size(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.diff(column.offsets.to_numpy())
    for dim in np.unique(sizes):
        yield int(dim), np.flatnonzero(sizes == dim)


def encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a ``vector``, with code, factor and the key by which rows are put in order."""
    for batch in batches:
        for dim, at in _by_size(batch.column("vector")):
            some = batch.take(pa.array(at))
            vectors = _matrix(some.column("vector"), dim)
            codes, factors = encode(vectors)
            place = table_keys(unit(vectors), 0, (LANES, LANES))
            yield pa.RecordBatch.from_arrays(
                [*some.columns, pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(factors), pa.array(place)],
                [*batch.schema.names, "code", "factor", "place"],
            )


def keyed(lanes: tuple[int, ...], count: int):
    """A function from (cid, code, vector) to a row for each table: key, cid, and the code's
    first 128 bits, by which most vectors that meet by chance are told apart at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at in _by_size(batch.column(2)):
                some = batch.take(pa.array(at))
                vectors = unit(_matrix(some.column(2), dim))
                heads = np.frombuffer(b"".join(c[: 2 * WORD] for c in some.column(1).to_pylist()), np.int64).reshape(-1, 2)
                heads = [pa.array(np.ascontiguousarray(heads[:, k])) for k in range(2)]
                for table in range(count):
                    yield pa.RecordBatch.from_arrays([pa.array(table_keys(vectors, table + 1, lanes)), some.column(0), *heads], ["key", "cid", "head", "next"])

    return run


def _blocks(cid: np.ndarray) -> np.ndarray:
    return cid >> BLOCK


def _distinct(columns: np.ndarray) -> np.ndarray:
    columns = columns[:, np.lexsort(columns)]
    return columns[:, np.concatenate([[True], (columns[:, 1:] != columns[:, :-1]).any(axis=0)])]


#: Buckets of up to so many rows are compared all together, step by step.
SMALL = 32


def to_compare(threshold: float):
    """A function from rows (key, cid, head, next, blk, blk_lo, blk_hi) sorted by key to rows
    (x, y, cid): compare this vector in this pair of blocks."""
    far = furthest(math.acos(threshold) / math.pi, 16 * WORD)

    def pairs_of(rows: pa.Table, keys: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        cid, head, tail = rows["cid"].to_numpy(), rows["head"].to_numpy().view(np.uint64), rows["next"].to_numpy().view(np.uint64)
        block, cross = rows["blk"].to_numpy(), rows["blk_lo"].to_numpy() != rows["blk_hi"].to_numpy()
        starts = run_starts(rows, keys)
        sizes = np.diff(np.append(starts, len(cid)))
        run = np.repeat(np.arange(len(starts)), sizes)
        small = sizes[run] <= SMALL

        def kept(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            near = np.bitwise_count(head[a] ^ head[b]) + np.bitwise_count(tail[a] ^ tail[b]) <= far
            near &= ~cross[a] | (block[a] != block[b])
            return cid[a[near]], cid[b[near]]

        for step in range(1, SMALL):
            a = np.flatnonzero(small[: len(cid) - step] & (run[: len(cid) - step] == run[step:]))
            if not len(a):
                break
            yield kept(a, a + step)
        for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
            width = max(1, (1 << 20) // n)
            for at in range(0, n, width):
                i = np.arange(at, min(n, at + width))
                a, b = (x.ravel() for x in np.meshgrid(i, np.arange(n), indexing="ij"))
                upper = a < b
                yield kept(s + a[upper], s + b[upper])

    def wanted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.minimum(a, b), np.maximum(a, b)
        x, y = _blocks(low), _blocks(high)
        return _distinct(np.stack([np.concatenate(c) for c in ((x, x), (y, y), (low, high))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["key", "blk_lo", "blk_hi"]
        for rows in whole_runs(batches, keys):
            found = [wanted(a, b) for a, b in pairs_of(rows, keys) if len(a)]
            out = _distinct(np.concatenate(found, axis=1)) if found else np.empty((3, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["x", "y", "cid"])

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the nodes of some links: each node and the least one it is connected with here."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return nodes, nodes[root]
        root = low


def compare_blocks(threshold: float):
    """A function from rows (x, y, cid, n, code, factor, vector) sorted by (x, y) to rows
    (a, b, others): ``b`` is null where ``others`` counts the copies that ``a`` is linked
    with in this pair of blocks, else a and b are connected."""

    def links(left: pa.Table, right: pa.Table, dim: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        x, y = _matrix(left["vector"].combine_chunks(), dim), _matrix(right["vector"].combine_chunks(), dim)
        code, other = (np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(t.num_rows, -1) for t in (left, right))
        far = furthest(math.acos(threshold) / math.pi, 8 * code.shape[1])
        factor = left["factor"].to_numpy()
        x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
        xx, yy = (np.einsum("ij,ij->i", v, v) for v in (x, y))
        for at in range(0, len(x), 256):
            rows = slice(at, at + 256)
            apart = np.bitwise_count(code[rows].view(np.uint64)[:, None, :] ^ other.view(np.uint64)[None, :, :]).sum(axis=2, dtype=np.int64)
            open_ = apart <= far
            if same:
                open_ &= np.arange(at, min(len(x), at + 256))[:, None] < np.arange(len(y))
            columns = np.flatnonzero(open_.any(axis=0))
            if not len(columns):
                continue
            guess, error = estimate(code[rows], factor[rows], y[columns])
            i, j = np.nonzero(open_[:, columns] & (guess + ERRORS * error[:, None] >= threshold))
            i, j = i + at, columns[j]
            for part in range(0, len(i), 1 << 16):
                a, b = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
                near = np.einsum("ij,ij->i", x[a], y[b]) / np.sqrt(xx[a] * yy[b]) >= threshold
                yield a[near], b[near]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["x", "y"]
        for table in whole_runs(batches, keys, rows=1024):
            starts = run_starts(table, keys)
            for s, e in zip(starts, [*starts[1:], table.num_rows], strict=True):
                pair = table.slice(s, e - s)
                x, y = pair["x"][0].as_py(), pair["y"][0].as_py()
                for dim, at in _by_size(pair["vector"].combine_chunks()):
                    some = pair.take(pa.array(at))
                    block = _blocks(some["cid"].to_numpy())
                    left = some if x == y else some.filter(pa.array(block == x))
                    right = some if x == y else some.filter(pa.array(block == y))
                    found = list(links(left, right, dim, x == y))
                    if not sum(len(a) for a, _ in found):
                        continue
                    i, j = (np.concatenate(c) for c in zip(*found, strict=True))
                    ci, cj, ni, nj = left["cid"].to_numpy(), right["cid"].to_numpy(), left["n"].to_numpy(), right["n"].to_numpy()
                    nodes, roots = _forest(ci[i], cj[j])
                    linked = nodes != roots
                    ends, at = np.unique(np.concatenate([ci[i], cj[j]]), return_inverse=True)
                    others = np.zeros(len(ends), np.int64)
                    np.add.at(others, at, np.concatenate([nj[j], ni[i]]))
                    none = pa.nulls(len(ends), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(ends), none, pa.array(others)], ["a", "b", "others"])
                    none = pa.nulls(int(linked.sum()), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(roots[linked]), none], ["a", "b", "others"])

    return run


def deal_hot_keys(postings: DataFrame, some: DataFrame) -> DataFrame:
    """Postings with ``blk_lo, blk_hi, blk``: rows of a key that is hot, by its count among
    ``some`` of the postings, are dealt into blocks, and each block goes to every pair of
    blocks, so that any two rows of a key meet.  What counts as hot changes no result."""
    least = max(2, BUCKET_CAP // HOT_SAMPLE)
    hot = some.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > least)
    hot = materialize(hot.select("key", F.ceil(F.col("_n") / least).cast("int").alias("_blocks")), "hot-keys")
    out = postings.join(hot, "key", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    out = out.withColumn("blk", F.pmod(F.xxhash64(F.lit("block"), "cid"), F.col("_blocks")).cast("int"))
    pairs = F.expr("transform(sequence(0, _blocks - 1), j -> struct(least(blk, j) as blk_lo, greatest(blk, j) as blk_hi))")
    return out.withColumn("_pair", F.explode(pairs)).select("key", "cid", "head", "next", "blk", F.col("_pair.blk_lo").alias("blk_lo"), F.col("_pair.blk_hi").alias("blk_hi"))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``cid`` by partition and place as consecutive numbers, so that blocks are full
    however many partitions there are.  One row for each partition passes through one task."""
    part = F.shiftright("cid", 33).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("cid").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("_part", part).join(starts, "_part").withColumn("cid", F.col("_start") + place).drop("_part", "_start")


def near_vectors(vectors: DataFrame, id_col: str, vector_col: str, threshold: float = 0.9) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row.

    Two vectors of one length are linked if their cosine is at least ``threshold``; unusable
    ones (see :func:`usable`) link with nothing and stand alone.  Equal vectors are one
    class, compared once; each copy counts as a link.  ``component_id`` is the least id
    reachable; repeated ids keep a row each; a null id names a component only if all its
    ids are null.  Other columns are not read, whatever their names.  No rows give no rows.
    """
    small_batches(vectors.sparkSession, 4096)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    rows = rows.withColumn("_ok", usable("vector"))
    same = ["h1", "h2"]  # 128 bits of hash name a vector, so that joins need not carry it
    hashed = rows.where("_ok").withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(SEED), "vector")})
    classes = hashed.groupBy(*same, "vector").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    kind = rows.schema["vector"].dataType.simpleString()
    coded = materialize(classes.mapInArrow(encode_rows, f"h1 long, h2 long, vector {kind}, least long, n long, code binary, factor double, place long"), "codes")
    lanes, count = tables(coded.count(), threshold)
    # in order of a key, so that near vectors get near numbers; the hash splits equal keys
    ordered = coded.orderBy(F.size("vector"), "place", "code", "h1").drop("place")
    stored = materialize(ordered.withColumn("cid", F.monotonically_increasing_id()), "vectors")
    discard(coded)
    known = numbered(stored)

    given = known.select("cid", "code", "vector")
    shape = "key long, cid long, head long, next long"
    postings = given.mapInArrow(keyed(lanes, count), shape)
    sampled = given.where(F.pmod(F.xxhash64("cid"), F.lit(HOT_SAMPLE)) == 0).mapInArrow(keyed(lanes, count), shape)
    keys = ["key", "blk_lo", "blk_hi"]
    dealt = deal_hot_keys(postings, sampled).repartition(*keys).sortWithinPartitions(*keys)
    compare = materialize(dealt.mapInArrow(to_compare(threshold), "x long, y long, cid long").distinct(), "block-pairs")

    parts = compare.join(known.select("cid", "n", "code", "factor", "vector"), "cid").select("x", "y", "cid", "n", "code", "factor", "vector")
    found = parts.repartition("x", "y").sortWithinPartitions("x", "y").mapInArrow(compare_blocks(threshold), "a long, b long, others long")
    found = materialize(found, "links")
    discard(compare)

    roots = connected_components(found.where("b is not null").select("a", "b"))
    degree = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("others").alias("others"))
    named = (
        known.select("cid", *same, "least", "n").join(degree, "cid", "left")
        .join(roots.select(F.col("node").alias("cid"), "component"), "cid", "left")
        .select(*same, "least", F.coalesce("component", "cid").alias("component"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    )
    named = materialize(named, "classes")
    discard(found)
    discard(stored)
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = named.join(names, "component").select(*same, "n_links", "component_id")
    good = hashed.select("id", *same).join(answer, same).select("id", "n_links", "component_id")
    alone = rows.where(~F.col("_ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
