"""Language identification by a byte convolutional network: multi-width filters, max pooling and a softmax, in numpy.

Bytes are mapped to 78 symbols (letters without case, digits, white space, other ASCII, bytes above 127 in groups). Whole
texts are cut into windows of 256 symbols that overlap by the widest filter less 1, so each n-gram is in some window. A
filter of width w adds up one learnt number for each of its w symbols; the greatest sum in a window, for 16 filters of
each of the widths 2, 3 and 4, goes to a softmax over languages. A document's probabilities are its windows', weighed by
length. For prediction, pairs of symbols are looked up at once.

The network is trained on the driver on a bounded sample: the ``most_langs`` (200) languages with the most documents, at most
``per_lang`` documents of each, chosen by a hash of the id, and of each at most ``windows_each`` windows taken anywhere in its text;
``most_windows`` (60,000) in all. Prediction covers all texts.

Defined results: ``und`` with score 0 for a text that is null or has no letter; with no labelled text at all, every
text is ``und``; rows are independent, so ties, repeated rows and other columns (of any name) have no effect; a document of any length
is taken in blocks of windows, so memory is bounded; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import columns_of, table, whole_row

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
OVERLAP = max(WIDTHS) - 1
STEP = WINDOW - OVERLAP
SYMBOLS, PAD = 78, 0


def symbol_map() -> np.ndarray:
    to = np.full(256, 3, np.uint8)
    to[[9, 10, 11, 12, 13, 32]] = 1
    to[48:58] = 2
    to[97:123] = to[65:91] = np.arange(4, 30)
    to[128:192] = 30 + np.arange(64) // 2
    to[192:256] = 62 + np.arange(64) // 4
    return to


TO_SYMBOL = symbol_map()


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """[number, WINDOW] symbols, and the length that each window adds."""
    s = TO_SYMBOL[np.frombuffer(text.encode(), np.uint8)]
    n = max(1, -(-(len(s) - OVERLAP) // STEP))
    padded = np.full((n - 1) * STEP + WINDOW, PAD, np.uint8)
    padded[: len(s)] = s
    size = np.full(n, STEP, np.float32)
    size[-1] = max(1, len(s) - (n - 1) * STEP)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP], size


class Network:
    def __init__(self, langs: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.conv = [rng.normal(0, 0.3, (w, SYMBOLS, FILTERS)).astype(np.float32) for w in WIDTHS]
        for c in self.conv:
            c[:, PAD] = -0.5
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.01, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        weights = [*self.conv, self.out, self.bias]
        m, v, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                some = order[at : at + batch]
                grads = self.gradients(x[some], y[some])
                t += 1
                for w, g, a, b in zip(weights, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    w -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n, pooled, places = len(x), [], []
        for c, w in zip(self.conv, WIDTHS, strict=True):
            length = WINDOW - w + 1
            sums = sum(c[k][x[:, k : k + length]] for k in range(w))
            places.append(sums.argmax(1))
            pooled.append(np.take_along_axis(sums, places[-1][:, None], 1)[:, 0])
        h = np.concatenate(pooled, 1)
        active = np.maximum(h, 0)
        p = softmax(active @ self.out + self.bias)
        p[np.arange(n), y] -= 1
        p /= n
        back = (p @ self.out.T) * (h > 0)
        grads = []
        for i, (c, w) in enumerate(zip(self.conv, WIDTHS, strict=True)):
            g = np.zeros_like(c)
            part, filters = back[:, i * FILTERS : (i + 1) * FILTERS], np.broadcast_to(np.arange(FILTERS), (n, FILTERS))
            for k in range(w):
                np.add.at(g[k], (np.take_along_axis(x, places[i] + k, 1), filters), part)
            grads.append(g)
        return [*grads, active.T @ p, p.sum(0)]

    def tables(self) -> list[np.ndarray]:
        """Lookup tables by pairs of symbols: widths 2, 3 (pair and symbol) and 4 (two pairs)."""
        pair = lambda a, b: (a[:, None] + b[None]).reshape(-1, FILTERS)
        two, three, four = self.conv
        return [pair(*two), pair(three[0], three[1]), three[2].copy(), pair(four[0], four[1]), pair(four[2], four[3])]

    def predict(self, x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """[number, languages] probabilities of windows."""
        two, three, third, four, fours = tables
        done = []
        for at in range(0, len(x), 32):
            s = x[at : at + 32].astype(np.intp)
            pairs = s[:, :-1] * SYMBOLS + s[:, 1:]
            a = two.take(pairs, 0).max(1)
            b = three.take(pairs[:, :-1], 0)
            b += third.take(s[:, 2:], 0)
            c = four.take(pairs[:, :-2], 0)
            c += fours.take(pairs[:, 2:], 0)
            h = np.concatenate([a, b.max(1), c.max(1)], 1)
            done.append(softmax(np.maximum(h, 0) @ self.out + self.bias))
        return np.concatenate(done)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, per_lang: int = 1000, windows_each: int = 4, most_langs: int = 200, most_windows: int = 60_000) -> Network | None:
    """A network learnt from the labelled rows of docs, or None if there are none."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()}
    if not counts:
        return None
    per_lang = max(1, min(per_lang, most_windows // windows_each // len(counts)))
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.5 * per_lang / n))))
    place = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1_000_000

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, places, found = [], [], []
            for place, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w, _ = windows(text)
                for i in np.random.default_rng(int(place * 1e6)).permutation(len(w))[:windows_each]:
                    langs.append(lang), places.append(place), found.append(w[i].tobytes())
            yield pa.record_batch([pa.array(places, pa.float64()), pa.array(langs, pa.string()), pa.array(found, pa.binary())], names=["place", "lang", "w"])

    some = rows.select(place.alias("place"), "lang", "text").filter(F.col("place") <= share[F.col("lang")])
    ranked = some.mapInArrow(cut, "place double, lang string, w binary").withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("place", "w")))
    got = sorted((r["lang"], r["n"], bytes(r["w"])) for r in ranked.filter(F.col("n") <= per_lang * windows_each).collect())
    langs = sorted({x[0] for x in got})
    net = Network(langs)
    net.fit(np.frombuffer(b"".join(x[2] for x in got), np.uint8).reshape(-1, WINDOW).astype(np.int64), np.array([langs.index(x[0]) for x in got]), epochs=max(3, min(12, 60_000 // len(got))))
    return net


def identify(docs: DataFrame, net: Network | None, *, text_col: str = "text") -> DataFrame:
    """docs without text_col, with lang_pred and score in place of any columns of these names."""
    others = docs.drop(text_col)
    if net is None:
        return others.drop("lang_pred", "score").withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    kept = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"), whole_row(others))
    tables, langs = net.tables(), net.langs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score = [], []
            for text, letters in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                if not letters:
                    pred.append("und"), score.append(0.0)
                    continue
                w, size = windows(text.as_py())
                total = np.zeros(len(langs))
                for at in range(0, len(w), 1024):
                    total += size[at : at + 1024].astype(np.float64) @ net.predict(w[at : at + 1024], tables).astype(np.float64)
                best = int(total.argmax())
                pred.append(langs[best]), score.append(min(1.0, float(total[best] / total.sum())))
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["row", "lang_pred", "score"])

    done = kept.mapInArrow(run, f"row {kept.schema['row'].dataType.simpleString()}, lang_pred string, score double")
    return done.select(*(c for c, name in zip(columns_of(others), others.columns, strict=True) if name not in ("lang_pred", "score")), "lang_pred", "score")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score; learnt from rows that aren't held out."""
    out = held_out(F.col(id_col))
    net = train(docs.filter(~out), id_col=id_col, text_col=text_col, lang_col=lang_col)
    return identify(docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"), F.col(text_col).alias("text")), net)


def identified_only(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that have a language (whose text isn't ``und``), with all their columns."""
    net = train(docs.filter(~held_out(F.col(id_col))), id_col=id_col, text_col=text_col, lang_col=lang_col)
    return identify(docs.select(whole_row(docs), F.col(text_col).alias("text")), net).filter("lang_pred != 'und'").select(*columns_of(docs))


def query(spark, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
