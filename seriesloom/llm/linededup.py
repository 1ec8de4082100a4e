"""Substring dedup by hashing units: lines, and the sentences inside lines, that equal earlier ones are found and removed.

A unit ends after a line feed or after what ends a sentence (``ENDS``). Normalising lower-cases A-Z and makes runs of ASCII white
space one space; what is empty then is no unit. Digests are 128 bits wide. They are grouped over the whole corpus with map-side
combine, so a unit that a third of all documents share adds one row for each task; of the groups only those with several units are
joined back, hot ones (``joined_unevenly``) without being shuffled. The earliest occurrence, by document id (nulls last) and then
offset, stays.

A line that an earlier one equals has units that all repeat, and so has a passage that stands inside longer lines, but for what it
shares with its surroundings at either end. Single short units (headings, "yes.", a licence's name) recur in clean texts. So
:func:`repeated_passages` counts every unit that repeats, and removes runs of neighbouring ones that have ``min_bytes`` (100) bytes
of normalised text together, in bytes as not all scripts part words; 1 removes every unit that repeats. :func:`repeated_lines` works on
whole lines alone, of ``min_words`` words or more.

Defined results: a null text has no units; rows with equal ids and texts are one document; offsets are in characters of
the original text, half open (a line's without its line feed, a passage's from its first unit to its last with what ends it); texts of any
length; an empty table gives an empty result; other columns, of any name, are ignored by the first two and kept by :func:`deduplicated` and
:func:`without_passages`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import columns_of, joined_unevenly, materialize, table, whole_row

MIN_WORDS, MIN_BYTES = 5, 100
#: Line feed, and ends of sentences.
ENDS = "\n.!?。！？"
UNIT = re.compile(f"[^{ENDS}]*+[{ENDS}]++|[^{ENDS}]++")

Unit = tuple[int, int, bytes]


def lines_of(text: str, min_words: int) -> tuple[int, list[Unit]]:
    """How many lines text has; start, end and normalised bytes of those of min_words."""
    lines, at, out = text.split("\n"), 0, []
    for line in lines:
        words = line.encode().lower().split()
        if len(words) >= min_words:
            out.append((at, at + len(line), b" ".join(words)))
        at += len(line) + 1
    return len(lines), out


def units_of(text: str) -> tuple[int, list[Unit]]:
    """How many units text has; start, end and normalised bytes of each."""
    found, at = [], 0
    for piece in UNIT.findall(text):
        words = piece.encode().lower().split()
        if words:
            found.append((at, at + len(piece), b" ".join(words)))
        at += len(piece)
    return len(found), found


def digests(docs: DataFrame, cut: Callable[[str], tuple[int, list[Unit]]], *, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, n_units, units): units has start, end, size (bytes) and digest of each unit that cut finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh128_digest
        for b in batches:
            counts, ends, start, end, size, hashed = [], [0], [], [], [], []
            for text in b.column(2):
                text = text.as_py()
                n, found = cut(text) if text is not None else (0, [])
                for a, z, x in found:
                    start.append(a), end.append(z), size.append(len(x)), hashed.append(digest(x))
                counts.append(n)
                ends.append(len(start))
            flat = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(size, pa.int32()), pa.array(hashed, pa.binary())], ["start", "end", "size", "digest"])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["doc_id", "text_hash", "n_units", "units"])

    ids = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {ids}, text_hash long, n_units long, units array<struct<start:int,end:int,size:int,digest:binary>>")


def later_units(each: DataFrame) -> DataFrame:
    """(doc_id, text_hash, later): the units of each document that equal an earlier one, in order: k (place), start, end, size."""
    rows = each.select("doc_id", "text_hash", F.posexplode("units").alias("k", "x")).select("doc_id", "text_hash", F.col("doc_id").isNull().alias("no_id"), "k", "x.*")
    place = F.struct("no_id", "doc_id", "text_hash", "start")
    groups = rows.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
    groups = materialize(groups.filter("first != last").select("digest", "first", "n"))
    total = groups.agg(F.sum("n")).first()[0] or 0
    later = joined_unevenly(rows, groups, "digest", total=total).filter(~F.col("first").eqNullSafe(place))
    return later.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("k", "start", "end", "size"))).alias("later"))


def with_later(each: DataFrame) -> DataFrame:
    """Each row of each without its units, with later (null where nothing repeats)."""
    found = later_units(each).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "later")
    return each.drop("units").join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left").drop("_id", "_hash")


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: doc_id, text_hash, n_units, removed (array of (start, end) in order)."""
    each = materialize(digests(docs, lambda t: lines_of(t, min_words), id_col=id_col, text_col=text_col))
    spans = F.transform("later", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return with_later(each).select("doc_id", "text_hash", "n_units", F.coalesce(spans, F.array().cast("array<struct<start:int,end:int>>")).alias("removed"))


def runs_of(ks: np.ndarray, sizes: np.ndarray, least: int) -> list[tuple[int, int]]:
    """First and last index of the runs of neighbouring places ks that have least bytes."""
    breaks = np.flatnonzero(np.diff(ks) != 1) + 1
    first, end = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(ks)]])
    long = np.add.reduceat(sizes, first) >= least
    return list(zip(first[long].tolist(), (end[long] - 1).tolist(), strict=True))


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """One row per document: doc_id, text_hash, n_units, n_repeated, n_removed (units), removed (array of (start, end) in order)."""
    each = materialize(digests(docs, units_of, id_col=id_col, text_col=text_col))
    found = with_later(each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            repeated, removed, spans = [], [], []
            for later in b.column(3):
                n, gone, at = 0, 0, []
                if later.is_valid:
                    k, start, end, size = (np.asarray(x) for x in later.values.flatten())
                    n = len(k)
                    for i, j in runs_of(k, size.astype(np.int64), min_bytes):
                        gone += j - i + 1
                        at.append({"start": int(start[i]), "end": int(end[j])})
                repeated.append(n), removed.append(gone), spans.append(at)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(repeated, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["doc_id", "text_hash", "n_units", "n_repeated", "n_removed", "removed"])

    ids = docs.schema[id_col].dataType.simpleString()
    return found.select("doc_id", "text_hash", "n_units", "later").mapInArrow(run, f"doc_id {ids}, text_hash long, n_units long, n_repeated long, n_removed long, removed array<struct<start:int,end:int>>")


def _cut(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, behind: int) -> DataFrame:
    """docs with all their columns, their texts without found's removed spans and so many characters behind each."""
    found = found.filter(F.size("removed") > 0).select(F.col("doc_id").alias("id"), "text_hash", "removed").distinct()
    rows = docs.select(whole_row(docs), F.col(id_col).alias("own"), F.xxhash64(F.col(text_col)).alias("hash"))
    joined = rows.join(found, F.col("own").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("text_hash")), "left")
    text = F.col("row").getField(text_col)
    # Pieces between spans, joined once: where each begins is where the span before ends.
    begins = F.concat(F.array(F.lit(0)), F.transform("removed", lambda x: x["end"] + behind))
    stops = F.concat(F.transform("removed", lambda x: x["start"]), F.array(F.length(text)))
    cut = F.array_join(F.zip_with(begins, stops, lambda a, z: F.substr(text, a + 1, F.greatest(z - a, F.lit(0)))), "")
    others = [F.when(F.col("removed").isNull(), text).otherwise(cut).alias(c) if c == text_col else x for c, x in zip(docs.columns, columns_of(docs), strict=True)]
    return joined.select(*others)


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with all their columns, their texts without the lines that earlier ones repeat."""
    return _cut(docs, repeated_lines(docs, id_col=id_col, text_col=text_col, min_words=min_words), id_col, text_col, 1)


def without_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """The documents with all their columns, their texts without passages that earlier ones have."""
    return _cut(docs, repeated_passages(docs, id_col=id_col, text_col=text_col, min_bytes=min_bytes), id_col, text_col, 0)


def query(spark, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")
    return found.select("doc_id", "n_units", "n_repeated", "n_removed", spans.alias("removed_spans"))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(text, '[^\n.!?。！？]*[\n.!?。！？]+|[^\n.!?。！？]+') AS us FROM documents),
x AS (SELECT doc_id, r, unnest(generate_series(1, len(us))) AS i, unnest(us) AS u FROM d WHERE us IS NOT NULL),
o AS (SELECT doc_id, r, i, length(u) AS size, (sum(length(u)) OVER (PARTITION BY r ORDER BY i) - length(u))::BIGINT AS a, array_to_string(regexp_extract_all(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS w FROM x),
u AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY i) AS k, row_number() OVER (PARTITION BY w ORDER BY doc_id NULLS LAST, a) AS n FROM o WHERE w <> ''),
l AS (SELECT *, k - row_number() OVER (PARTITION BY r ORDER BY k) AS run FROM u WHERE n > 1),
s AS (SELECT r, run, count(*) AS units, sum(strlen(w)) AS bytes, min(a) AS a, max(a + size) AS b FROM l GROUP BY r, run),
g AS (SELECT r, sum(units) AS n_repeated, sum(units) FILTER (bytes >= 100) AS n_removed, string_agg(a || '-' || b, ',' ORDER BY a) FILTER (bytes >= 100) AS removed_spans FROM s GROUP BY r),
c AS (SELECT r, count(*) AS n_units FROM u GROUP BY r)
SELECT doc_id, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(n_repeated, 0)::BIGINT AS n_repeated, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed_spans, '') AS removed_spans FROM d LEFT JOIN c USING (r) LEFT JOIN g USING (r)
"""
