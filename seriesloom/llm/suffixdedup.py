"""Removal of long repeated byte strings by suffix sorting, blockwise, with difference-cover ranks.

Every byte goes that is covered by a string of ``LENGTH`` (50) bytes which also starts in a document with a smaller id.
Sorting the suffixes of a whole corpus would move fifty times its size, so the work goes in four steps:

1. Documents are dealt once to groups by a hash, in a bucketed table in the checkpoint folder that later steps read in place.
2. Each start of a 50-byte string is given an anchor: the place of the smallest hash of a 16-byte gram inside the string.
   Equal strings have equal anchors, at the same offset; neighbouring starts share one, some 18 on average. Each group
   sends the hashes of its anchors, once each, with the smallest document; buckets of hashes answer with a bit for each
   that some other document has too. Strings with other anchors occur in no two documents.
3. Round each anchor that is left, a group sends the bytes of its strings (84 at most), each different context once with
   its smallest document. A bucket of anchor hashes is cut into blocks that keep an anchor's contexts together, and the suffixes
   of each block are sorted, one bucket of first bytes at a time, by their first 31 bytes, and ties beyond by the ranks of the cover
   sample, the places whose residue modulo 31 is in a difference cover. These are computed beforehand, by a sort of 31 bytes and
   one doubling. Contexts stand so that equal strings have equal residues. Neighbours with 50 common bytes form runs,
   and the answer for a start is the smallest document of its run.
4. Each group marks the strings whose answer is smaller than the document they stand in, and cuts.

A string that a third of all documents share is sent once by each group, not once for each document. A task has a bucket of hashes
or a group of documents at a time; both are sized by the bytes of all texts (``GROUP_BYTES``), however few partitions
are asked for. The different contexts of one anchor are sorted in one task.

Defined results: a null text is empty; a document with a null id is left alone and takes nothing from others; rows with
equal ids don't take from each other; ids of any type that can be sorted; texts of any length are read in blocks; an empty table gives an empty result;
other columns, of any name, are ignored by :func:`removals` and kept by :func:`deduplicated`, which drops the incomplete characters that a cut leaves.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from seriesloom.llm.common import ensure_checkpoint_dir, materialize, partitions, table, whole_row

LENGTH, GRAM = 50, 16
#: Grams in a string; bytes of a context, whose anchor stands at LEFT.
GRAMS = LENGTH - GRAM + 1
LEFT = GRAMS - 1
WIDTH = LEFT + LENGTH
#: A difference cover: every residue modulo COVER is the difference of two of its members.
COVER, MEMBERS = 31, (1, 5, 11, 24, 25, 27)
BLOCK, SORTED = 1 << 18, 8000
PLACE = np.uint64((1 << 24) - 1)
#: Groups of documents and buckets of hashes for each shuffle partition; a group sends a bucket one row.
GROUPS_EACH, BUCKETS_EACH = 2, 2
#: Bytes of text in a group at most, on average, however few partitions there are.
GROUP_BYTES = 64_000_000
C1, C2, C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))


def words_at(buffer: np.ndarray, order: str = "<") -> np.ndarray:
    """A view: the eight bytes from each position on, as a number."""
    return np.ndarray((max(len(buffer) - 7, 0),), f"{order}u8", buffer, 0, (1,))


def mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= C3
    h ^= h >> np.uint64(29)
    return h


class Anchors:
    """The anchors of a group of documents: place in the buffer, 48-bit hash, first and last start, document."""

    def __init__(self, ids: pa.ChunkedArray, texts: pa.ChunkedArray):
        raw = [t.encode() if t is not None else b"" for t in texts.to_pylist()]
        self.sizes = np.array([len(x) for x in raw], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.buffer = np.frombuffer(b"".join(raw) + bytes(WIDTH + 8), np.uint8)
        known = np.array(ids.is_valid().to_pylist(), bool)
        self.ids = np.array([x if x is not None else 0 for x in ids.to_pylist()], np.int64)
        starts_of = self.ends - self.sizes
        self.usable = known & (self.sizes >= LENGTH)
        total = int(self.ends[-1]) if len(self.ends) else 0
        valid = np.zeros(total + 1, np.int8)
        np.add.at(valid, starts_of[self.usable], 1)
        np.add.at(valid, (self.ends - LENGTH + 1)[self.usable], -1)
        valid = np.cumsum(valid, dtype=np.int8)[:total].astype(bool)
        place, lo, hi = [], [], []
        for at in range(0, total, BLOCK):
            n = min(BLOCK, total - at)
            w = words_at(self.buffer[at : at + n + WIDTH + 7]).copy()
            g = mixed(w[:-8] * C1 + w[8:] * C2)
            g = (g & ~PLACE) | np.arange(len(g), dtype=np.uint64)
            for step in (1, 2, 4, 8, 16):
                g = np.minimum(g[:-step], g[step:])
            g = np.minimum(g[: n], g[GRAMS - 32 : GRAMS - 32 + n])
            start = np.flatnonzero(valid[at : at + n])
            if len(start):
                anchor = (g[start] & PLACE).astype(np.int64)
                new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
                place.append(anchor[new] + at)
                lo.append(start[new] + at)
                hi.append(start[np.concatenate([new[1:] - 1, [len(start) - 1]])] + at)
        none = [np.zeros(0, np.int64)]
        self.place, self.lo, self.hi = (np.concatenate(x or none) for x in (place, lo, hi))
        w = words_at(self.buffer)
        self.hash = mixed(w[self.place] * C1 + w[self.place + 8] * C2) >> np.uint64(16)
        self.doc = np.searchsorted(self.ends, self.place, side="right")
        self.order = np.argsort(self.hash, kind="stable")
        ordered = self.hash[self.order]
        self.first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)])
        self.unique = ordered[self.first]

    def requests(self, buckets: int):
        """For each bucket of hashes: its number, hashes, smallest documents, whether there are others."""
        owner = self.ids[self.doc[self.order]]
        least, most = (f.reduceat(owner, self.first) if len(owner) else owner for f in (np.minimum, np.maximum))
        for b, at in by_bucket(self.unique, buckets):
            yield b, self.unique[at], least[at], (least != most)[at]

    def keep(self, masks: dict[int, bytes], buckets: int) -> np.ndarray:
        """Which anchors have a hash that some other document has."""
        again = np.zeros(len(self.unique), bool)
        for b, at in by_bucket(self.unique, buckets):
            again[at] = np.unpackbits(np.frombuffer(masks[b], np.uint8), count=len(at)).astype(bool)
        counts = np.diff(np.concatenate([self.first, [len(self.order)]]))
        kept = np.zeros(len(self.order), bool)
        kept[self.order] = np.repeat(again, counts)
        return np.flatnonzero(kept)

    def contexts(self, kept: np.ndarray):
        """Different contexts (rows of WIDTH bytes, first and end column) in a fixed order, the context of each kept anchor, each context's hash and smallest document."""
        lo, end = LEFT - (self.place[kept] - self.lo[kept]), LEFT + self.hi[kept] + LENGTH - self.place[kept]
        padded = np.concatenate([np.zeros(LEFT, np.uint8), self.buffer])
        rows = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[self.place[kept]] if len(kept) else np.zeros((0, WIDTH), np.uint8)
        column = np.arange(WIDTH)
        rows = np.where((column >= lo[:, None]) & (column < end[:, None]), rows, 0).astype(np.uint8)
        order, first = alike(rows, lo, end)
        which = np.zeros(len(kept), np.int64)
        which[order] = np.cumsum(first) - 1
        at = np.flatnonzero(first)
        owner = self.ids[self.doc[kept]][order]
        return rows[order[at]], lo[order[at]], end[order[at]], which, self.hash[kept][order[at]], np.minimum.reduceat(owner, at) if len(at) else owner


def by_bucket(hashes: np.ndarray, buckets: int):
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    names, at = np.unique(bucket[order], return_index=True)
    for b, part in zip(names.tolist(), np.split(order, at[1:]), strict=True) if len(names) else ():
        yield b, part


def alike(rows: np.ndarray, lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by two hashes in which equal contexts are neighbours; whether each differs from the one before."""
    w = np.concatenate([rows, np.zeros((len(rows), -WIDTH % 8), np.uint8)], 1).view(np.uint64)
    one, two = lo.astype(np.uint64) * C1 + end.astype(np.uint64), end.astype(np.uint64) * C2
    for k in range(w.shape[1]):
        one, two = mixed((one ^ w[:, k]) * C1), mixed((two + w[:, k]) * C2)
    order = np.lexsort((two, one))
    w, lo, end = w[order], lo[order], end[order]
    same = (w[1:] == w[:-1]).all(1) & (lo[1:] == lo[:-1]) & (end[1:] == end[:-1])
    return order, np.concatenate([[True], ~same])[: len(rows)]


def pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() if a.dtype.itemsize > 1 else a.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes, n: int, *types) -> list[np.ndarray]:
    import zstandard

    raw, at, found = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8), 0, []
    for t in types:
        t, wide = t if isinstance(t, tuple) else (t, 1)
        size = np.dtype(t).itemsize
        part = raw[at : at + n * size * wide]
        at += n * size * wide
        found.append(np.ascontiguousarray(part.reshape(size, -1).T).view(t).reshape(-1) if size > 1 else part.reshape(n, wide) if wide > 1 else part)
    return found


def repeated(hashes: np.ndarray, least: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Which of the hashes stand in two documents or more."""
    order = np.argsort(hashes, kind="stable")
    h, d, m = hashes[order], least[order], more[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    again = (np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)) | np.logical_or.reduceat(m, first)
    out = np.zeros(len(h), bool)
    out[order] = np.repeat(again, np.diff(np.concatenate([first, [len(h)]])))
    return out


def to_cover() -> np.ndarray:
    """For each column the least step to a member of the cover."""
    return np.array([next(d for d in range(COVER) if (c + d) % COVER in MEMBERS) for c in range(WIDTH)])


def ranked(keys: list[np.ndarray]) -> np.ndarray:
    """The rank of each place by keys, the weightiest first; equal places rank equal."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    rank = np.zeros(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def heads(w: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The first COVER (31) bytes from each place on, as four numbers."""
    found = [w[at + 8 * k].astype(np.uint64) for k in range(4)]
    found[3] >>= np.uint64(8)
    return found


def cover_ranks(w: np.ndarray, n: int, stride: int, wanted: np.ndarray) -> np.ndarray:
    """[n, width]: ranks of the wanted places of the cover sample by their first 62 bytes.

    The sample is sorted by 31 bytes; as a place and that 31 bytes on have one residue, both are in the sample, and a second sort by
    the pair of their ranks doubles the length that decides.
    """
    row, col = np.nonzero(wanted)
    rank = np.zeros((n, wanted.shape[1] + COVER), np.int64)
    rank[row, col] = 1 + ranked(heads(w, row * stride + col))
    both = [rank[row, col], rank[row, col + COVER]]
    rank[row, col] = 1 + ranked(both)
    return rank


def suffix_runs(rows: np.ndarray, lo: np.ndarray, end: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """[rows, WIDTH]: for each start of a 50-byte string the smallest owner of an equal string, elsewhere the largest number."""
    n, stride = len(rows), WIDTH + 2 * COVER + 8
    text = np.zeros(n * stride + 64, np.uint8)
    text[: n * stride].reshape(n, stride)[:, :WIDTH] = rows
    w = words_at(text, ">")
    column = np.arange(WIDTH)
    out = np.full((n, WIDTH), np.iinfo(np.int64).max)
    row, col = np.nonzero((column >= lo[:, None]) & (column <= end[:, None] - LENGTH))
    if not len(row):
        return out
    step = to_cover()
    # The cover sample: the places that some suffix is led to, and those 31 bytes on.
    wanted = np.zeros((n, WIDTH + 2 * COVER), bool)
    wanted[row, col + step[col]] = True
    wanted[row, col + step[col] + COVER] = True
    rank = cover_ranks(w, n, stride, wanted)
    # Suffixes, one bucket of first bytes at a time.
    lead = rows[row, col]
    grouped = np.argsort(lead, kind="stable")
    for bucket in np.split(grouped, np.flatnonzero(np.diff(lead[grouped])) + 1):
        r, c = row[bucket], col[bucket]
        at = r * stride + c
        # By 31 bytes; ties by the ranks of the sample, which for one residue are of places equally far on.
        order = np.lexsort((rank[r, c + step[c]], c % COVER, *heads(w, at)[::-1]))
        at = at[order]
        same = np.ones(len(at) - 1, bool)
        for k in range(7):  # the common prefix of neighbours, up to 50 bytes
            x = w[at + 8 * k] if k < 6 else w[at + 48] >> np.uint64(48)
            same &= x[1:] == x[:-1]
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        least = np.repeat(np.minimum.reduceat(owner[r[order]], first), np.diff(np.concatenate([first, [len(at)]])))
        out[r[order], c[order]] = least
    return out


def answers(rows: np.ndarray, lo: np.ndarray, end: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each context the smallest owner over all its starts if that is one, whether it isn't, and [varied, WIDTH] owners of those.

    Contexts that are the same to the byte are one block of text with the smallest of their owners; all others are sorted.
    """
    order, first = alike(rows, lo, end)
    at = np.flatnonzero(first)
    which = np.zeros(len(rows), np.int64)
    which[order] = np.cumsum(first) - 1
    least = np.minimum.reduceat(owner[order], at)
    rows, lo, end = rows[order[at]], lo[order[at]], end[order[at]]
    none, low, high, found = np.iinfo(np.int64).max, np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), []
    for block in blocks(np.ascontiguousarray(rows[:, LEFT : LEFT + GRAM])):
        x = suffix_runs(rows[block], lo[block], end[block], least[block])
        low[block], high[block] = x.min(1), np.where(x == none, -1 - none, x).max(1)
        differs = low[block] != high[block]
        found.append((block[differs], x[differs]))
    place = np.full(len(rows), -1)
    varied = np.concatenate([b for b, _ in found])
    place[varied] = np.arange(len(varied))
    own = place[which]
    return low[which], own >= 0, np.concatenate([x for _, x in found])[own[own >= 0]]


def blocks(grams: np.ndarray):
    """Numbers of contexts, in blocks of SORTED at least (but the last) in which each anchor's contexts stand together."""
    g = grams.view(np.uint64)
    order = np.lexsort((g[:, 1], g[:, 0]))
    ordered = g[order]
    new = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(1)])
    starts, at = np.flatnonzero(new), 0
    while at < len(order):
        k = np.searchsorted(starts, at + SORTED)
        end = int(starts[k]) if k < len(starts) else len(order)
        yield order[at:end]
        at = end


def _rows(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


#: Folders that calls of this session have made in the checkpoint folder.
_made: list[str] = []


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes the tables that this session's calls of deduplicated have written; what they have returned can't be computed again then."""
    paths = _made if paths is None else paths
    while paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _dealt(rows: DataFrame) -> tuple[DataFrame, int, str]:
    """rows (_id, _text, _row) dealt to groups by a hash, read from a bucketed table in the checkpoint folder; buckets of hashes; the folder.

    Groups and buckets are as many as partitions ask for, and more where GROUP_BYTES of text each wouldn't hold all.
    """
    spark = rows.sparkSession
    parts_n = partitions(spark)
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    groups, buckets = (max(parts_n * each, -(-size // GROUP_BYTES)) for each in (GROUPS_EACH, BUCKETS_EACH))
    dealt = rows.select(F.pmod(F.xxhash64("_id", "_text"), F.lit(groups)).cast("int").alias("_group"), "_id", "_text", "_row")
    ensure_checkpoint_dir(spark)
    name = f"seriesloom_parts_{uuid.uuid4().hex}"
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    dealt.repartition(parts_n, "_group").write.option("compression", "zstd").option("path", path).bucketBy(parts_n, "_group").saveAsTable(name)
    parts = spark.table(name)  # resolved now: the name goes, the files stay
    spark.sql(f"DROP TABLE {name}")
    return parts, buckets, path


def _ordered_ids(rows: DataFrame) -> DataFrame:
    """rows (id, _text, _row) with _id, a long in the order of the ids: the id itself, or of other types the place in a sorted table of ids."""
    if isinstance(rows.schema["id"].dataType, IntegralType):
        return rows.withColumn("_id", F.col("id").cast("long"))
    known = materialize(rows.select(F.col("id").alias("known")).filter("known IS NOT NULL").distinct().orderBy("known").withColumn("_id", F.monotonically_increasing_id()))
    return rows.join(known, F.col("id") == F.col("known"), "left")


def _cut(rows: DataFrame, finish, schema: str) -> tuple[DataFrame, str]:
    """Of rows (id, _text, _row), finish(group, anchors, removed): the rows of a group; removed has a mark for each byte. And the folder it reads."""
    parts, buckets, path = _dealt(_ordered_ids(rows).select("_id", "_text", "_row"))
    ids = lambda t: Anchors(t.column("_id"), t.column("_text"))
    names, types = ["_group", "kind", "bucket", "n", "blob"], [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    sent = "_group int, kind int, bucket int, n int, blob binary"

    def ask(group: pa.Table) -> pa.Table:
        g = group.column("_group")[0].as_py()
        return _rows(names, types, [(g, 0, b, len(h), pack(h.view(np.uint8).reshape(-1, 8)[:, :6].T.copy().reshape(-1), d, m.astype(np.uint8))) for b, h, d, m in ids(group).requests(buckets)])

    def count(bucket: pa.Table) -> pa.Table:
        ns, hashes, least, more = bucket.column("n").to_pylist(), [], [], []
        for n, blob in zip(ns, bucket.column("blob"), strict=True):
            h, d, m = unpack(blob.as_py(), n, (np.uint8, 6), np.int64, np.uint8)
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :6] = h.reshape(6, n).T
            hashes.append(wide.view(np.uint64)[:, 0]), least.append(d), more.append(m.astype(bool))
        again = np.split(repeated(np.concatenate(hashes), np.concatenate(least), np.concatenate(more)), np.cumsum(ns)[:-1])
        return _rows(names, types, [(g, 1, b, n, np.packbits(x).tobytes()) for g, b, n, x in zip(bucket.column("_group").to_pylist(), bucket.column("bucket").to_pylist(), ns, again, strict=True)])

    masks = materialize(parts.select("_group", "_id", "_text").groupBy("_group").applyInArrow(ask, sent).groupBy("bucket").applyInArrow(count, sent))

    def known(replies: pa.Table, kind: int) -> dict[int, tuple[int, bytes]]:
        return {b: (n, x) for k, b, n, x in zip(*(replies.column(c).to_pylist() for c in ("kind", "bucket", "n", "blob")), strict=True) if k == kind}

    def kept(a: Anchors, replies: pa.Table) -> np.ndarray:
        return a.keep({b: x for b, (_, x) in known(replies, 1).items()}, buckets)

    def show(group: pa.Table, replies: pa.Table) -> pa.Table:
        if not group.num_rows:
            return _rows(names, types, [])
        g, a = group.column("_group")[0].as_py(), ids(group)
        rows, lo, end, _, hashes, owner = a.contexts(kept(a, replies))
        return _rows(names, types, [(g, 0, b, len(at), pack(rows[at].reshape(-1), lo[at].astype(np.uint8), end[at].astype(np.uint8), owner[at])) for b, at in by_bucket(hashes, buckets)])

    def sort(bucket: pa.Table) -> pa.Table:
        ns = bucket.column("n").to_pylist()
        got = [unpack(blob.as_py(), n, (np.uint8, WIDTH), np.uint8, np.uint8, np.int64) for n, blob in zip(ns, bucket.column("blob"), strict=True)]
        least, varied, owners = answers(*(np.concatenate([x[i] for x in got]).astype(t) for i, t in enumerate((np.uint8, np.int64, np.int64, np.int64))))
        out, at, seen = [], 0, 0
        for g, b, n in zip(bucket.column("_group").to_pylist(), bucket.column("bucket").to_pylist(), ns, strict=True):
            v = varied[at : at + n]
            out.append((g, 2, b, n, pack(v.astype(np.uint8), least[at : at + n], owners[seen : seen + v.sum()].reshape(-1))))
            at, seen = at + n, seen + v.sum()
        return _rows(names, types, out)

    cogrouped = parts.select("_group", "_id", "_text").groupBy("_group").cogroup(masks.groupBy("_group"))
    replies = cogrouped.applyInArrow(show, sent).groupBy("bucket").applyInArrow(sort, sent)

    def mark(group: pa.Table, replies: pa.Table) -> pa.Table:
        if not group.num_rows:
            return finish(group, None, None)
        a = ids(group)
        some = kept(a, replies)
        rows, lo, end, which, hashes, _ = a.contexts(some)
        least, varied, own, owners = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool), np.zeros(len(rows), np.int64), []
        told, seen = known(replies, 2), 0
        for b, at in by_bucket(hashes, buckets):
            import zstandard

            n, blob = told[b]
            varied[at], least[at] = (x.astype(bool) if i == 0 else x for i, x in enumerate(unpack(blob, n, np.uint8, np.int64)))
            raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)[9 * n :]
            more = np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).reshape(-1, WIDTH)
            own[at[varied[at]]] = seen + np.arange(len(more))
            owners.append(more)
            seen += len(more)
        doc, cover = a.ids[a.doc[some]], np.zeros(len(a.buffer) + LENGTH, np.int32)
        whole = np.flatnonzero(~varied[which] & (least[which] < doc))
        np.add.at(cover, a.lo[some][whole], 1)
        np.add.at(cover, a.hi[some][whole] + LENGTH, -1)
        part = np.flatnonzero(varied[which])
        if len(part):
            all_owners = np.concatenate(owners)
            for at in range(0, len(part), 50_000):
                x = part[at : at + 50_000]
                r, c = np.nonzero(all_owners[own[which[x]]] < doc[x][:, None])
                start = a.place[some][x[r]] - LEFT + c
                np.add.at(cover, start, 1)
                np.add.at(cover, start + LENGTH, -1)
        return finish(group, a, np.cumsum(cover)[: len(a.buffer)] > 0)

    told = masks.unionByName(replies)
    return parts.groupBy("_group").cogroup(told.groupBy("_group")).applyInArrow(mark, schema), path


def _rows_of(docs: DataFrame, id_col: str, text_col: str, row: Column) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"), row.alias("_row"))


def removals(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def finish(group: pa.Table, a: Anchors | None, removed: np.ndarray | None) -> pa.Table:
        out = []
        for i in range(group.num_rows):
            end, n = a.ends[i], a.sizes[i]
            gone, text = removed[end - n : end], a.buffer[end - n : end]
            spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((int(n), int(gone.sum()), spans, hashlib.sha256(text[~gone].tobytes() if spans else text.tobytes()).hexdigest()))
        return _rows(["n_bytes", "n_removed", "n_spans", "kept_sha256"], types, out).add_column(0, "doc_id", group.column("_row").combine_chunks().field("doc_id") if group.num_rows else pa.array([]))

    ids = docs.schema[id_col].dataType.simpleString()
    cut, path = _cut(_rows_of(docs, id_col, text_col, F.struct(F.col(id_col).alias("doc_id"))), finish, f"doc_id {ids}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    out = materialize(cut)
    release(docs.sparkSession, [path])
    return out


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, their texts without what is removed.

    What is returned reads a table in the checkpoint folder, until :func:`release` deletes that.
    """
    others = docs.drop(text_col)

    def finish(group: pa.Table, a: Anchors | None, removed: np.ndarray | None) -> pa.Table:
        texts = group.column("_text").to_pylist()
        for i, t in enumerate(texts):
            end, n = a.ends[i], a.sizes[i]
            gone = removed[end - n : end]
            if t is not None and gone.any():
                texts[i] = a.buffer[end - n : end][~gone].tobytes().decode("utf-8", "ignore")
        return pa.table([group.column("_row"), pa.array(texts, pa.string())], names=["_row", "_text"])

    rows = _rows_of(docs, id_col, text_col, whole_row(others))
    cut, path = _cut(rows, finish, f"_row {rows.schema['_row'].dataType.simpleString()}, _text string")
    _made.append(path)
    return cut.select(*(F.col("_text").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents"))



ORACLE = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT r, doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT r, doc_id, h, unnest(generate_series(0, len(h) // 2 - 50)) AS p FROM d WHERE len(h) >= 100)),
firsts AS (SELECT s, min(doc_id) AS f FROM starts GROUP BY s),
hits AS (SELECT r, p FROM starts JOIN firsts USING (s) WHERE f < doc_id),
runs AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS run FROM (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 50 THEN 0 ELSE 1 END AS fresh FROM hits)),
spans AS (SELECT r, min(p) AS a, max(p) + 50 AS b FROM runs GROUP BY r, run),
pieces AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM spans),
cut AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, (2 * before + 1)::BIGINT, (2 * (a - before))::BIGINT), '' ORDER BY a) AS kept FROM pieces JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
