"""SimHash near-duplicates: exact links between fingerprints by vantage-point trees.

Fingerprints of at most ``RADIUS`` (4) differing bits link. Cut into three blocks of 22, 21 and 21 bits, two such
fingerprints differ in one bit at most of some block. So there are three vantage-point trees, one for each block, whose
distance is the Hamming distance inside the block and whose search radius is 1; where a node's fingerprints are all
equal in the block, it measures whole fingerprints, with radius 4. A node has a vantage point and a median distance;
by the triangle inequality, a fingerprint nearer to the median than the radius has to be looked for on both sides. The
upper part of each tree is made on the driver from a bounded sample (a hundredth, ``SAMPLE`` to ``MOST_SAMPLE`` fingerprints) and deals out shards: each
fingerprint is stored in one leaf of each tree and visits, as a guest, the leaves that overlap its ball. A task goes on
splitting its leaf the same way, then compares what is left and grows components. It returns a star for each component,
never all its pairs, so a group of copies makes as many edges as it has members.

Equal fingerprints are made one before the trees, by an aggregation with map-side combine, and components of distinct
fingerprints are joined over the cluster by rounds of large-star and small-star, which stop when nothing changes.

Defined results: a null text and a text without words have fingerprint zero, which links like any other; a text of
fewer than four words is one shingle; rows with equal ids are rows of their own with a common id; rows with a null id
take part and have the smallest id that isn't null as component_id; texts of any length; an empty table gives an empty result; other
columns, of any name, are ignored by :func:`near_duplicates` and kept by :func:`one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import columns_of, joined_unevenly, materialize, sampled, table, whole_row

BLOCKS = (0x3FFFFF, 0x1FFFFF << 22, 0x1FFFFF << 43)
WHOLE = (1 << 64) - 1
RADIUS, BLOCK_RADIUS = 4, 1
#: Fingerprints from which the upper trees are made; stored fingerprints in a leaf; those that a task compares directly.
SAMPLE, MOST_SAMPLE, LEAF, DIRECT = 50_000, 1_000_000, 2000, 1500


def fingerprint(text: str | None, width: int = 4) -> int:
    """The unsigned 64-bit fingerprint."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z alone are lower-cased, ASCII white space alone splits
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return hashed(joined, 42)  # a single hash has each of its bits in over half
    ends = np.cumsum([len(x) + 1 for x in words])
    starts = np.concatenate([[0], ends[: -width]]).tolist()
    hashes = np.array([hashed(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.fromiter((fingerprint(x.as_py(), width) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    ids = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {ids}, fp bigint")


def split(points: np.ndarray, block: int, seed: int) -> tuple[int, int, int, int] | None:
    """(mask, vantage, median, radius) of a node, or None if no distance parts its points well."""
    rng = np.random.default_rng(seed)
    some = points if len(points) <= 2000 else rng.choice(points, 2000, replace=False)
    best = None
    for mask, radius in ((BLOCKS[block], BLOCK_RADIUS), (WHOLE, RADIUS)):
        for vantage in rng.choice(some, 4):
            d = np.bitwise_count((some ^ vantage) & np.uint64(mask))
            median = int(np.median(d))
            for mid in (median, median + 1):
                inside, both = (d < mid).mean(), (np.abs(d.astype(int) - mid + 0.5) < radius).mean()
                cost = max(inside, 1 - inside) + both / 2
                if 0.05 < inside < 0.95 and (best is None or cost < best[0]):
                    best = (cost, mask, int(vantage), mid, radius)
        if best:
            return best[1:]
    return None


def sides(points: np.ndarray, node: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each point: whether it is stored inside; whether its ball reaches inside; whether it reaches outside."""
    mask, vantage, mid, radius = node
    d = np.bitwise_count((points ^ np.uint64(vantage)) & np.uint64(mask)).astype(np.int64)
    return d < mid, d - radius < mid, d + radius >= mid


def build(sample: np.ndarray, block: int, leaf: float, depth: int = 0) -> tuple | None:
    """A tree of (node, inside, outside); None is a leaf."""
    if len(sample) <= leaf or depth > 40 or (node := split(sample, block, depth)) is None:
        return None
    inside = sides(sample, node)[0]
    return node, build(sample[inside], block, leaf, depth + 1), build(sample[~inside], block, leaf, depth + 1)


def route(tree: tuple | None, stored: np.ndarray, guests: np.ndarray, name: str) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Each leaf's name, stored points and guests."""
    if len(stored) + len(guests) == 0:
        return
    if tree is None:
        yield name, stored, guests
        return
    node, inner, outer = tree
    home, near, far = sides(stored, node)
    _, g_in, g_out = sides(guests, node)
    yield from route(inner, stored[home], np.concatenate([stored[~home & near], guests[g_in]]), name + "0")
    yield from route(outer, stored[~home], np.concatenate([stored[home & far], guests[g_out]]), name + "1")


def stars(stored: np.ndarray, guests: np.ndarray, block: int, depth: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges (roots, members) that connect each stored point with all points of its ball."""
    if len(stored) > DIRECT and depth < 60 and (node := split(stored, block, depth)):
        home, near, far = sides(stored, node)
        _, g_in, g_out = sides(guests, node)
        yield from stars(stored[home], np.concatenate([stored[~home & near], guests[g_in]]), block, depth + 1)
        yield from stars(stored[~home], np.concatenate([stored[home & far], guests[g_out]]), block, depth + 1)
        return
    left = stored
    while len(left):
        root, left = left[0], left[1:]
        queue, others = [root], guests  # a guest needs one edge to a component
        for x in queue:
            close = np.bitwise_count(left ^ x) <= RADIUS
            if close.any():
                found, left = left[close], left[~close]
                queue.extend(found)
                yield np.full(len(found), root), found
            close = np.bitwise_count(others ^ x) <= RADIUS
            if close.any():
                found, others = others[close], others[~close]
                yield np.full(len(found), root), found


def links(distinct: DataFrame) -> DataFrame:
    """From distinct (fp) to edges (u, v), u > v, that join all fingerprints that a chain of links joins."""
    n = distinct.count()
    want = max(SAMPLE, min(MOST_SAMPLE, n // 100))
    sample = np.array([r[0] for r in sampled(distinct.select("fp"), F.col("fp"), want, n).orderBy(F.xxhash64("fp"), "fp").limit(want).collect()], np.int64).view(np.uint64)
    leaf = max(16, LEAF * len(sample) / max(n, 1))
    trees = [build(sample, k, leaf) for k in range(len(BLOCKS))]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            rows = [x for k, tree in enumerate(trees) for x in route(tree, points, points[:0], str(k))]
            yield pa.record_batch([pa.array([x[0] for x in rows], pa.string()), pa.array([x[1].tobytes() for x in rows], pa.binary()), pa.array([x[2].tobytes() for x in rows], pa.binary())], names=["leaf", "stored", "guests"])

    def compare(group: pa.Table) -> pa.Table:
        gather = lambda k: np.frombuffer(b"".join(x.as_py() for x in group.column(k)), np.uint64)
        found = list(stars(gather("stored"), gather("guests"), int(group.column("leaf")[0].as_py()[0])))
        u, v = (np.concatenate([x[i] for x in found]).view(np.int64) if found else np.zeros(0, np.int64) for i in (0, 1))
        return pa.table({"u": np.maximum(u, v), "v": np.minimum(u, v)})

    return distinct.select("fp").mapInArrow(deal, "leaf string, stored binary, guests binary").groupBy("leaf").applyInArrow(compare, "u bigint, v bigint")


def components(edges: DataFrame) -> DataFrame:
    """From edges (u, v), u > v, to (node, root) for each node of an edge but the roots: alternating large and small stars."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = materialize(edges.distinct())
    seen = state(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").filter("u > v").distinct()
        e = materialize(small)
        now = state(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def grouped(each: DataFrame) -> DataFrame:
    """From (doc_id, fp) to one row for each fingerprint: fp, n (rows that have it), root (a fingerprint that names the group), component_id."""
    reps = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    roots = components(links(reps))
    rooted = reps.join(roots, reps["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    lead = reps.join(roots.select("root").distinct(), reps["fp"] == F.col("root")).select("fp", "rep", F.col("fp").alias("root"))
    member = rooted.filter("root != fp")
    groups = member.unionByName(lead)
    least = groups.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = groups.join(least, "root").select(F.col("fp").alias("_fp"), F.col("root").alias("_root"), "component_id")
    return reps.join(named, reps["fp"] == named["_fp"], "left").select("fp", "n", F.coalesce("_root", "fp").alias("root"), F.coalesce("component_id", "rep").alias("component_id"))


def with_groups(each: DataFrame) -> DataFrame:
    """Each row of each (doc_id, fp and more) with root and component_id; a fingerprint that many rows have isn't shuffled."""
    known = materialize(grouped(each.select("doc_id", "fp")))
    return joined_unevenly(each, known, "fp", total=known.agg(F.sum("n")).first()[0] or 0).drop("n")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id."""
    each = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, width=width))
    return with_groups(each).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all its columns: that of the smallest id, nulls last.

    Of rows with that id in the group it is the one with the smallest hash of all columns (but maps); of equal rows, one.
    """
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    both = [F.xxhash64(*hashed, *(c.isNull() for c in hashed)).alias("h"), F.xxhash64(F.lit(1), *hashed, *(c.isNull() for c in hashed)).alias("g")]
    rows = docs.select(whole_row(docs), F.col(id_col).alias("id"), F.col(text_col).alias("text"), *both)
    keys = F.struct(F.col("id").isNull().alias("no_id"), "id", "h", "g").alias("key")
    each = materialize(fingerprints(rows.select(keys, "text"), id_col="key").select("doc_id.*", "fp"))
    first = with_groups(each.withColumn("doc_id", F.col("id"))).groupBy("root").agg(F.min(F.struct("no_id", "id", "h", "g")).alias("x")).select("x.h", "x.g")
    kept = rows.select("row", "h", "g").join(first, ["h", "g"], "left_semi")
    place = F.row_number().over(Window.partitionBy("h", "g").orderBy("h"))
    return kept.withColumn("place", place).filter("place = 1").select(*columns_of(docs))


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
