"""Benchmark decontamination by winnowing, with DataFrame operations only.

A window is ``window`` (10) consecutive words of a benchmark item. Every window holds six 5-word grams; the smallest of
their hashes is the window's fingerprint, both in documents and in the benchmark, so every span shared over a whole
window has equal fingerprints on both sides, wherever it stands. Items of fewer words are one window each, with the
hash of all their words as fingerprint; documents get fingerprints of these lengths only if the benchmark has them.

The benchmark's fingerprints are put in a bitmap of bounded size (one bit array of at most ``2 ** 20`` bits), which
document windows are held against as they are read; a benchmark of more fingerprints than the bitmap can tell apart is joined with
the documents' fingerprints instead. Hits are extended to whole windows by a join with the benchmark on fingerprint and
words, which drops all chance hits: neither bitmap nor fingerprints decide anything. Each window of the benchmark is one row in that
join, however many items have it; lists of items, each once, are attached to what a document hit in the end. So no pairs of
documents and items are made but those of the result. A passage that a third of all documents share makes a few rows for each of them; the
benchmark's windows are broadcast up to ``BROADCAST_WINDOWS``, and beyond that hot windows alone are (``joined_unevenly``).

Defined results: a null text has no words; a null item text no window; items with a null id mark words but are not
listed; repeated rows (equal id and text) get equal results; a text of any length is scanned whole; an empty benchmark marks nothing, and an
empty table gives an empty result; other columns, of any name, are kept by :func:`clean` and ignored by :func:`contamination`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import ascii_lower, columns_of, joined_unevenly, materialize, table, whole_row

#: A word is a run of anything but these, after A-Z are lower-cased: digits, letters and all that isn't ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, GRAM = 10, 5
#: Bits of the bitmap: so many for each fingerprint, and so many at most.
BITS_EACH, MOST_BITS = 32, 1 << 20
#: Fingerprints for which a bitmap is made, with eight bits each at least; windows of the benchmark that are broadcast.
MOST_PRINTS, BROADCAST_WINDOWS = MOST_BITS // 8, 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def bound(value: Column, use) -> Column:
    """use(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def gram_hashes(w: Column, k: int) -> Column:
    """The hash of the k words from each position on; near the end of fewer words."""
    return F.transform(w, lambda x, i: F.xxhash64(x, *(F.get(w, i + j) for j in range(1, k))))


def fingerprints(w: Column) -> Column:
    """For each position the smallest gram hash of the window that starts there."""
    return bound(gram_hashes(w, GRAM), lambda h: F.transform(h, lambda x, i: F.least(x, *(F.get(h, i + j) for j in range(1, WINDOW - GRAM + 1)))))


def windows(w: Column, n: int, prints: Column, keep=None) -> Column:
    """An array of (start, fingerprint, words) for each window of n words that keep accepts."""
    whole = bound(prints, lambda p: F.filter(F.transform(F.slice(p, F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(0))), lambda x, i: F.struct(i.alias("start"), x.alias("print"))), lambda x: F.lit(True) if keep is None else keep(x["print"])))
    return F.transform(whole, lambda x: F.struct(x["start"].alias("start"), F.lit(n).alias("n"), x["print"].alias("print"), F.array_join(F.slice(w, x["start"] + 1, n), " ").alias("span")))


def benchmark_windows(items: DataFrame, *, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, n, print, span), once each."""
    split = items.select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    long = split.filter(F.size("w") >= WINDOW).select("item", F.explode(windows(F.col("w"), WINDOW, fingerprints(F.col("w")))).alias("x"))
    short = split.filter(F.size("w") < WINDOW).select("item", F.struct(F.lit(0).alias("start"), F.size("w").alias("n"), short_print(F.col("w"), F.size("w")).alias("print"), F.array_join("w", " ").alias("span")).alias("x"))
    return long.unionByName(short).select("item", "x.n", "x.print", "x.span").distinct()


def short_print(w: Column, n: Column) -> Column:
    return F.xxhash64(F.array_join(F.slice(w, F.lit(1), n), " "), n)


def short_prints(w: Column, n: int) -> Column:
    """The fingerprint of the n words from each position on."""
    return F.transform(w, lambda _, i: short_print(F.slice(w, i + 1, n), F.lit(n)))


def bitmap(bench: DataFrame, n: int) -> tuple[Column, int]:
    """An array literal of bits and their number less 1: a bit is set if some of the n fingerprints ends so."""
    bits = 1 << 10
    while bits < min(n * BITS_EACH, MOST_BITS):
        bits *= 2
    cell = F.col("print").bitwiseAND(F.lit(bits - 1))
    rows = bench.groupBy(F.shiftright(cell, 5).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), cell.bitwiseAND(F.lit(31)).cast("int"))).alias("mask")).collect()  # a row for each 32 bits at most
    masks = [0] * (bits // 32)
    for at, mask in rows:
        masks[at] = mask
    return F.array(*(F.lit(m).cast("long") for m in masks)) if len(masks) <= 64 else F.from_json(F.lit(str(masks)), "array<bigint>"), bits - 1


def likely_windows(docs: DataFrame, prints: DataFrame, lengths: list[int], n_prints: int) -> DataFrame:
    """(doc_id, text_hash, n_words, found): found has start, n, print and span of each window whose fingerprint may be (with a bitmap) or is one of prints."""
    w = F.col("w")
    of = lambda n: fingerprints(w) if n == WINDOW else short_prints(w, n)
    split = docs.select("doc_id", "text_hash", words(F.col("text")).alias("w"))
    empty = F.array().cast("array<struct<start:int,n:int,print:bigint,span:string>>")
    if n_prints <= MOST_PRINTS:
        masks, low = bitmap(prints, n_prints)

        def passes(p: Column) -> Column:
            mask = F.get(F.col("bits"), F.shiftright(p.bitwiseAND(F.lit(low)), 5).cast("int"))
            return F.call_function("shiftright", mask, p.bitwiseAND(F.lit(31)).cast("int")).bitwiseAND(F.lit(1)) == 1

        found = [windows(w, n, of(n), passes) for n in lengths]
        return split.withColumn("bits", masks).select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), (F.concat(*found) if found else empty).alias("found"))

    def starts(n: int) -> Column:
        return F.transform(F.slice(of(n), F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(0))), lambda x, i: F.struct(i.alias("start"), F.lit(n).alias("n"), x.alias("print")))

    at = [starts(n) for n in lengths]
    every = split.select("doc_id", "text_hash", F.explode(F.concat(*at)).alias("x")).select("doc_id", "text_hash", "x.*").distinct()
    hits = every.join(prints.select("print").distinct(), "print", "left_semi").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "n", "print")).alias("hits"))
    hits = hits.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "hits")
    back = split.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    spans = F.transform("hits", lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"), x["print"].alias("print"), F.array_join(F.slice(w, x["start"] + 1, x["n"]), " ").alias("span")))
    return back.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), F.coalesce(spans, empty).alias("found"))


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, n_hit, items (array of item ids as strings, sorted), contaminated."""
    bench = materialize(benchmark_windows(items))
    lengths = sorted(r[0] for r in bench.select("n").distinct().collect())  # at most ten
    ids = F.array_sort(F.collect_set(F.col("item").cast("string")))
    listed = bench.groupBy("print", "n", "span").agg(ids.alias("items")).withColumn("list", F.struct(F.xxhash64("items"), F.hash("items"), F.size("items")))
    listed = materialize(listed)
    windows_of = listed.select(F.struct("print", "n", "span").alias("window"), "list")
    n_windows, n_prints = listed.agg(F.count("*"), F.count_distinct("print")).first()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    scanned = materialize(likely_windows(rows, listed.select("print"), lengths, n_prints))
    likely = scanned.filter(F.size("found") > 0).select("doc_id", "text_hash", F.explode("found").alias("x")).select("doc_id", "text_hash", "x.start", "x.n", F.struct("x.print", "x.n", "x.span").alias("window")).distinct()
    if n_windows <= BROADCAST_WINDOWS:
        hits = likely.join(F.broadcast(windows_of), "window")
    else:
        counts = materialize(likely.groupBy("window").agg(F.count("*").alias("rows")).join(windows_of, "window").withColumnRenamed("rows", "n"))
        hits = joined_unevenly(likely.withColumnRenamed("n", "length"), counts, "window", total=counts.agg(F.sum("n")).first()[0] or 0).drop("n").withColumnRenamed("length", "n")
    agreed = materialize(hits.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "n")).alias("spans"), F.collect_set("list").alias("lists")))
    lists = listed.select("list", "items").dropDuplicates(["list"])
    named = agreed.select("doc_id", "text_hash", F.explode("lists").alias("list")).join(lists, "list").select("doc_id", "text_hash", F.explode("items").alias("item"))
    named = named.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
    at = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))
    counted = agreed.select("doc_id", "text_hash", F.size(F.array_distinct(at)).cast("long").alias("n_hit"))
    out = scanned.drop("found")
    for k, more in enumerate((counted, named)):
        more = more.withColumnsRenamed({"doc_id": f"_id{k}", "text_hash": f"_hash{k}"})
        out = out.join(more, F.col("doc_id").eqNullSafe(F.col(f"_id{k}")) & (F.col("text_hash") == F.col(f"_hash{k}")), "left").drop(f"_id{k}", f"_hash{k}")
    return out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))}).withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns."""
    bad = materialize(contamination(docs, items, id_col=id_col, text_col=text_col).filter("contaminated").select("doc_id", "text_hash").distinct())
    rows = docs.select(whole_row(docs), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("hash"))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left_anti").select(*columns_of(docs))


def query(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS span FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS span FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT r, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.span = bw.span),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT r, n, i FROM hits)) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""
