"""MinHash near-dedup with sequential Bayesian verification.

1. Equal shingle sets become one class, its smallest doc_id standing for it.
2. Banded MinHash keys put the classes into buckets. Every member of a bucket is compared with the
   bucket's smallest member, so a bucket of n gives n - 1 pairs, never all of them.
3. A pair's signatures are compared in batches; it is dropped as soon as the posterior probability of
   a similarity over the threshold falls under the chosen miss probability. Survivors are confirmed on
   their full sets.
4. Where a bucket's members still belong to several components, those that aren't of the largest are
   compared with all others, in blocks of bounded size: in a first round their likeliest pairs are
   confirmed. In a second, the members that may still join two components carry their full sets into
   their block, which decides every plausible pair there and returns only links that join components
   of the block. So no link that the bands offer between two components is lost, and a block of n
   members returns fewer than n links.
5. Components come from star rounds over the confirmed links.

Texts that are null, empty or without words have no shingles and are linked with nothing. A row
without doc_id is linked with nothing and has no component; it is kept. Rows that repeat a doc_id are
one node. An empty table gives an empty one.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import U64, mix, scans, windows
from .common import bit_table, cut, discard, in_table, prepare
from .components import components

#: Bands and hashes in each: a pair at 0.8 shares no band with probability 3e-6.
BANDS, DEPTH = 32, 5
#: Hashes of a signature, those of the bands first; more of them part similarities more sharply.
HASHES = 320
#: Hashes that are compared before the next look at the posterior.
BATCH = 32
#: Pairs that a text proposes in a block of a bucket, the likeliest ones, before all the others are tried.
BEST = 2
#: Members of a bucket that are compared with each other at once.
BLOCK = 256
_draw = np.random.Generator(np.random.PCG64(77))
_SCALE = (_draw.integers(0, 2**31, HASHES, dtype=np.int64) * 2 + 1).astype(np.uint32)
_SHIFT = _draw.integers(0, 2**32, HASHES, dtype=np.int64).astype(np.uint32)


def shingle_sets(scan, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and their bounds; fewer words than size make one shingle."""
    words, bounds = scan.words(), scan.bounds
    counts = np.diff(bounds)
    keys, _, edges = windows(words, bounds, size)
    owner = np.repeat(np.arange(scan.rows), np.diff(edges))
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        one = np.zeros(len(short), U64)
        for k in range(size - 1):
            has = counts[short] > k
            one[has] = one[has] * U64(0xD6E8FEB86659FD93) + words[bounds[short[has]] + k]
        keys = np.concatenate([keys, mix(one + counts[short].astype(U64))])
        owner = np.concatenate([owner, short])
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = keys[first], owner[first]
    return keys, np.searchsorted(owner, np.arange(scan.rows + 1))


def signatures(keys: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte a hash (rows x hashes) and the band keys (rows x bands) of non-empty sets."""
    low = (keys >> U64(32)).astype(np.uint32)
    starts = bounds[:-1]
    out = np.empty((HASHES, len(starts)), np.uint32)
    held = np.empty_like(low)
    for k in range(HASHES):
        np.multiply(low, _SCALE[k], out=held)
        np.add(held, _SHIFT[k], out=held)
        out[k] = np.minimum.reduceat(held, starts)
    bands = np.empty((len(starts), BANDS), U64)
    for b in range(BANDS):
        key = np.full(len(starts), b + 1, U64)
        for k in range(b * DEPTH, (b + 1) * DEPTH):
            key = key * U64(0xD6E8FEB86659FD93) + out[k].astype(U64)
        bands[:, b] = mix(key)
    return ((out * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).T.copy(), bands


@functools.cache
def least_matches(threshold: float, miss: float) -> tuple[tuple[int, int], ...]:
    """(hashes seen, matches): with fewer, similarity reaches the threshold with a posterior under `miss`.

    The prior of the similarity is uniform; one-byte hashes of different shingles match in 1 of 256.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    chance = grid + (1 - grid) / 256
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(chance) + (n - m) * np.log1p(-chance)
            weight = np.exp(log - log.max())
            if weight[grid >= threshold].sum() >= miss * weight.sum():
                break
        out.append((n, m))
    return tuple(out)


def plausible(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Indices of the rows of a and b (rows x hashes) that no batch of hashes rules out."""
    left, matches, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in least_matches(threshold, miss):
        matches = matches + (a[left, done:n] == b[left, done:n]).sum(axis=1)
        keep = matches >= least
        left, matches, done = left[keep], matches[keep], n
    return left


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, the set's digest (k1, k2), its signature and band keys (null for an empty set)."""
    prepare(docs.sparkSession)
    schema = "doc_id long, n_shingles long, k1 long, k2 long, signature binary, bands array<long>"

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for s in scans(batch.column(1), lower=True):
                keys, bounds = shingle_sets(s, size)
                counts = np.diff(bounds)
                full = np.flatnonzero(counts)
                digest = np.zeros((2, s.rows), U64)
                sig, bands = [None] * s.rows, [None] * s.rows
                if len(full):
                    edges = np.append(bounds[:-1][full], len(keys))
                    digest[0, full] = np.add.reduceat(keys, edges[:-1])
                    digest[1, full] = np.add.reduceat(mix(keys ^ U64(0x5851F42D4C957F2D)), edges[:-1])
                    some, keyed = signatures(keys, edges)
                    for k, i in enumerate(full):
                        sig[i], bands[i] = some[k].tobytes(), keyed[k].view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(s.first, s.rows), pa.array(counts.astype(np.int64)), pa.array(digest[0].view(np.int64)),
                    pa.array(digest[1].view(np.int64)), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                ], names=["doc_id", "n_shingles", "k1", "k2", "signature", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def full_sets(docs: DataFrame, size: int, wanted=None) -> DataFrame:
    """doc_id and its distinct shingle hashes. wanted: a broadcast bit table of doc_ids; about only theirs."""

    def run(batches):
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(in_table(wanted.value, _id_hashes(batch))))
            ids = batch.column(0)
            for s in scans(batch.column(1), lower=True):
                keys, bounds = shingle_sets(s, size)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(s.first, s.rows),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(keys.view(np.int64))),
                ], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


def _prune_pairs(pairs: DataFrame, nodes: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The pairs (a, b) whose signatures leave a similarity over the threshold plausible."""
    width = HASHES
    both = (
        pairs.join(nodes.select(F.col("doc_id").alias("a"), F.col("signature").alias("sa"), F.col("n_shingles").alias("na")), "a")
        .join(nodes.select(F.col("doc_id").alias("b"), F.col("signature").alias("sb"), F.col("n_shingles").alias("nb")), "b")
        # the smaller set can't hold enough of the larger one
        .where(F.least("na", "nb") >= F.greatest("na", "nb") * (threshold - 1e-9)).select("a", "b", "sa", "sb")
    )

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keep = plausible(_bytes(batch.column(2), width), _bytes(batch.column(3), width), threshold, miss)
                yield batch.select(["a", "b"]).take(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


def _wanted_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The sets of the wanted doc_ids, and of others that share their bits; one a doc_id."""
    table = docs.sparkSession.sparkContext.broadcast(bit_table(wanted, _id_hashes))
    return full_sets(docs.where("doc_id is not null"), size, table).groupBy("doc_id").agg(F.min("shingles").alias("shingles"))


def _id_hashes(batch) -> np.ndarray:
    return mix(batch.column(0).to_numpy().astype(np.int64).view(U64) + U64(1))


def _confirm(pairs: DataFrame, docs: DataFrame, size: int, per_cent: int) -> DataFrame:
    """The pairs that are linked by their full sets; pairs is cut."""
    sets = cut(_wanted_sets(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), size), "sets")
    both = (
        pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
        .join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
        .withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    )
    found = cut(both.where(100 * F.col("shared") >= per_cent * (F.size("sa") + F.size("sb") - F.col("shared"))).select("a", "b"), "confirmed")
    discard(sets)
    return found


def _cells(members: DataFrame) -> DataFrame:
    """cell, band, asks, doc_id, component, n_shingles, signature and bands: blocks of the buckets that hold several components.

    members: key, band, doc_id, component, n_shingles, signature, bands. Members of other components than the bucket's largest
    ask; they meet all members, block by block.
    """
    size = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = size.groupBy("key").agg(F.sum("n").alias("total"), F.max(F.struct("n", "component"))["component"].alias("largest"), F.max("n").alias("most"))
    largest = largest.where("most < total")
    block = lambda n: F.greatest(F.ceil(n / F.lit(BLOCK)), F.lit(1)).cast("int")
    rows = (
        members.join(largest, "key").withColumn("query", F.col("component") != F.col("largest"))
        .withColumn("qb", block(F.col("total") - F.col("most"))).withColumn("mb", block(F.col("total")))
        .withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)).cast("int"))
    )
    cell = lambda q, m: F.xxhash64("key", q, m)
    other = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"), F.lit(False).alias("asks")).withColumn(
        "cell", cell(F.col("q"), F.col("h") % F.col("mb")))
    asks = rows.where("query").select("*", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("m"), F.lit(True).alias("asks")).withColumn(
        "cell", cell(F.col("h") % F.col("qb"), F.col("m")))
    return other.select(*_CELL).union(asks.select(*_CELL))


_CELL = ["cell", "band", "asks", "doc_id", "component", "n_shingles", "signature", "bands"]
_CELL_DDL = "cell long, band int, asks boolean, doc_id long, component long, n_shingles long, signature binary, bands array<long>"


def _plausible_in(table: pa.Table, per_cent: int, miss: float):
    """(ask, members): row numbers of an asking row of one cell and of the members of other components that it may be linked with.

    A pair that shares several bands counts in the first of them.
    """
    asks = table["asks"].to_numpy()
    comp, n = table["component"].to_numpy(), table["n_shingles"].to_numpy()
    band = table["band"][0].as_py()
    x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
    if not len(x) or not len(y):
        return
    sig = _bytes(table["signature"].combine_chunks(), HASHES)
    bands = table["bands"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
    for k in x:
        at = y[(comp[y] != comp[k]) & (100 * np.minimum(n[y], n[k]) >= per_cent * np.maximum(n[y], n[k]))]
        if len(at) and band:
            at = at[~(bands[at, :band] == bands[k, :band]).any(axis=1)]
        if len(at):
            keep = at[plausible(np.broadcast_to(sig[k], (len(at), HASHES)), sig[at], per_cent / 100, miss)]
            if len(keep):
                yield k, keep[np.argsort(-(sig[keep] == sig[k]).sum(axis=1), kind="stable")]


def _by_cell(rows: DataFrame, compare, schema: str) -> DataFrame:
    """compare(table) of each cell; yields Arrow tables of the schema."""
    dealt = rows.repartition("cell").sortWithinPartitions("cell", "asks", "doc_id")

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column(0).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(cells[1:] != cells[:-1]) + 1, [len(cells)]])
            for a, b in zip(edges[:-1], edges[1:]):
                if held and held[-1].column(0)[0].as_py() != cells[a]:
                    yield from compare(pa.Table.from_batches(held)).to_batches()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from compare(pa.Table.from_batches(held)).to_batches()

    return dealt.mapInArrow(run, schema)


def _pairs_table(found) -> pa.Table:
    found = sorted(set(found))
    return pa.table([pa.array([int(p[i]) for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _likeliest(cells: DataFrame, per_cent: int, miss: float, best: int = BEST) -> DataFrame:
    """Of each asking row in each cell its likeliest pairs (a, b)."""

    def compare(table: pa.Table) -> pa.Table:
        ids = table["doc_id"].to_numpy()
        return _pairs_table((max(ids[k], ids[j]), min(ids[k], ids[j])) for k, at in _plausible_in(table, per_cent, miss) for j in at[:best])

    return _by_cell(cells, compare, "a long, b long")


def _open_rows(cells: DataFrame, per_cent: int, miss: float) -> DataFrame:
    """The rows of the cells that take part in a plausible pair."""

    def compare(table: pa.Table) -> pa.Table:
        some = np.zeros(table.num_rows, bool)
        for k, at in _plausible_in(table, per_cent, miss):
            some[k] = some[at] = True
        return table.filter(pa.array(some)).combine_chunks()

    return _by_cell(cells, compare, _CELL_DDL)


def _joining_links(rows: DataFrame, per_cent: int, miss: float) -> DataFrame:
    """Links (a, b) that join the components of each cell as all its links do; rows: _open_rows with their sets (shingles)."""

    def compare(table: pa.Table) -> pa.Table:
        ids, comp = table["doc_id"].to_numpy(), table["component"].to_numpy()
        sets = table["shingles"].combine_chunks()
        flat, edges = sets.flatten().to_numpy(), sets.offsets.to_numpy() - sets.offsets[0].as_py()
        root: dict[int, int] = {}

        def find(c):
            while root.get(c, c) != c:
                c = root[c]
            return c

        found = []
        for k, at in _plausible_in(table, per_cent, miss):
            own = flat[edges[k] : edges[k + 1]]  # ascending as unsigned numbers
            own = np.sort(own)
            for part in range(0, len(at), 64):
                some = at[part : part + 64]
                some = some[[find(comp[j]) != find(comp[k]) for j in some]]
                if not len(some):
                    continue
                size = edges[some + 1] - edges[some]
                heads = np.cumsum(size) - size
                other = flat[np.repeat(edges[some] - heads, size) + np.arange(size.sum())]
                hit = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other
                both = np.add.reduceat(hit.astype(np.int64), heads)
                for j in some[100 * both >= per_cent * (size + len(own) - both)]:
                    a, b = find(comp[j]), find(comp[k])
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        found.append((max(ids[k], ids[j]), min(ids[k], ids[j])))
        return _pairs_table(found)

    return _by_cell(rows, compare, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, per_cent: int = 80, miss: float = 1e-5) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept of docs (doc_id, text, ...).

    Texts are linked if 100 * |common shingles| >= per_cent * |all shingles|; shingles have `size` words.
    """
    threshold = per_cent / 100
    prints = cut(fingerprints(docs, size), "prints")
    known = prints.where("doc_id is not null and n_shingles > 0")
    classes = known.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    member = cut(known.select("doc_id", "k1", "k2").distinct().join(classes, ["k1", "k2"]).select("doc_id", "k1", "k2", "rep"), "member")
    nodes = cut(
        known.join(member.where("doc_id = rep").select("doc_id", "k1", "k2"), ["doc_id", "k1", "k2"], "left_semi")
        .dropDuplicates(["doc_id", "k1", "k2"]).select("doc_id", "n_shingles", "signature", "bands"), "nodes")
    exploded = nodes.select("doc_id", F.posexplode("bands").alias("band", "key"))
    buckets = exploded.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    inside = cut(exploded.join(buckets, "key").where("doc_id > first"), "buckets")
    stars = inside.select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct()
    signed = nodes.select("doc_id", "signature", "n_shingles")
    links = _confirm(cut(_prune_pairs(stars, signed, threshold, miss), "stars"), docs, size, per_cent)
    links = cut(links.union(member.where("doc_id > rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
                            .join(nodes.select(F.col("doc_id").alias("a")), "a", "left_semi")), "links")
    # buckets that aren't within one component: first the likeliest pairs, then all that may still join two components
    final = cut(components(links, "a", "b"), "components")

    def cells() -> DataFrame:
        named = inside.where("n > 2").select("key", "band", "doc_id").join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn(
            "component", F.coalesce("component", "doc_id"))
        split = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
        return _cells(named.join(split, "key", "left_semi").join(nodes.select("doc_id", "signature", "n_shingles", "bands"), "doc_id"))

    pairs = cut(_likeliest(cells(), per_cent, miss).distinct(), "pairs")
    if not pairs.isEmpty():
        more = _confirm(pairs, docs, size, per_cent)
        if not more.isEmpty():
            links = cut(links.union(more), "links")
            final = cut(components(links, "a", "b"), "components")
        rows = cut(_open_rows(cells(), per_cent, miss), "open")
        if not rows.isEmpty():
            sets = _wanted_sets(docs, rows.select("doc_id").distinct(), size)
            more = cut(_joining_links(rows.join(sets, "doc_id").select(*_CELL, "shingles"), per_cent, miss), "more")
            if not more.isEmpty():
                links = cut(links.union(more), "links")
                final = cut(components(links, "a", "b"), "components")
    found = member.join(final.withColumnRenamed("id", "rep"), "rep", "left").select(
        "doc_id", F.coalesce("component", "rep").alias("component_id")).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return prints.select("doc_id", "n_shingles").join(found, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
