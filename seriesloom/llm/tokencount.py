"""Edit-aware token counts: a segment tree over each document's pre-tokens, of which an edit recounts a part.

Pre-tokens are what the tokenizer's pattern cuts a text into; tokens never cross them, so a text's count is the sum over
them. A document's leaves are runs of pre-tokens of some 512 characters; the tree holds sums of tokens and of characters over them, so
places are found and sums updated along a path. :func:`build` makes the trees and returns them as columns, to be written beside the texts;
:func:`apply` takes texts, kept trees and edits, and encodes nothing but what the edits touch; :func:`count_edited` is one after the other.

The pattern looks at no text before a pre-token, and at one character after white space. So an edit recounts from the start
of the leaf before the one it touches, and goes on until a leaf's end falls on an old end behind the edit; leaves beyond
keep their counts. Recounted leaves take the places of the old ones; a tree has empty places in between, and is laid out anew, from
its sums alone, only when they don't suffice.

The tokenizer's file is a parameter; the driver reads it and sends it along (under 1 MB). Counts of pre-tokens are kept in a
table of bounded size for each worker.

Defined results: a null text has 0 tokens and an edit makes it the replacement; null edits, and null arrays of them, are none; a null start or
end is 0 and a null replacement empty; offsets are cut to the text; a kept tree that is null, or isn't of the text's length, is built again; rows are independent, so ties, repeated
rows, empty tables and other columns, of any name, have no effect. A document of any length is encoded pre-token by pre-token.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern of this vocabulary's pre-tokens.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF, MEMO = 512, 500_000


class Counter:
    """Counts tokens of pre-tokens."""

    def __init__(self, ranks: bytes):
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.pattern, self.memo = regex.compile(PATTERN), {}

    def __call__(self, piece: str) -> int:
        n = self.memo.get(piece)
        if n is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            n = self.memo[piece] = len(self.encode(piece))
        return n

    def leaves(self, text: str, start: int = 0, stop=None) -> Iterator[tuple[int, int]]:
        """(end, tokens) of leaves from start on; stops after a leaf for which stop(end) holds."""
        began, tokens, get, match = start, 0, self.memo.get, self.pattern.finditer
        at = start
        for m in match(text, start):
            piece = m[0]
            n = get(piece)
            tokens += self(piece) if n is None else n
            at = m.end()
            if at - began >= LEAF or stop is not None and stop(at):
                yield at, tokens
                if stop is not None and stop(at):
                    return
                began, tokens = at, 0
        if at > began:
            yield at, tokens


@lru_cache(maxsize=2)
def counter(ranks: bytes) -> Counter:
    return Counter(ranks)


class Tree:
    """Sums over leaves in heap-ordered arrays: node i has children 2 i and 2 i + 1. Places for leaves may be empty."""

    def __init__(self, leaves: list[tuple[int, int]]):
        ends = [0, *(end for end, _ in leaves)]
        self.lay_out([b - a for a, b in zip(ends, ends[1:], strict=False)], [n for _, n in leaves])

    @classmethod
    def kept(cls, chars: list[int], tokens: list[int]) -> Tree:
        tree = cls([])
        tree.lay_out(chars, tokens)
        return tree

    def lay_out(self, chars: list[int], tokens: list[int]) -> None:
        self.places, self.width = len(chars), 1 << max(0, (len(chars) - 1).bit_length())
        self.chars, self.sums = ([0] * self.width + list(x) + [0] * (self.width - len(x)) for x in (chars, tokens))
        for sums in (self.chars, self.sums):
            for i in range(self.width - 1, 0, -1):
                sums[i] = sums[2 * i] + sums[2 * i + 1]

    @property
    def total(self) -> int:
        return self.sums[1]

    @property
    def size(self) -> int:
        return self.chars[1]

    @property
    def ends(self) -> list[int]:
        return list(accumulate(self.sizes()))

    def counts(self) -> list[int]:
        return self.sums[self.width : self.width + self.places]

    def sizes(self) -> list[int]:
        return self.chars[self.width : self.width + self.places]

    def upto(self, leaf: int, sums: list[int] | None = None) -> int:
        """Tokens (or what sums has) in leaves before leaf."""
        sums, i, out = sums or self.sums, leaf + self.width, 0
        while i > 1:
            if i & 1:
                out += sums[i - 1]
            i >>= 1
        return out

    def place(self, at: int) -> tuple[int, int]:
        """The place of the leaf that has character at (or of the last leaf), and where it starts."""
        i, start, at = 1, 0, max(0, min(at, self.size - 1))
        while i < self.width:
            left = self.chars[2 * i]
            i, start = (2 * i, start) if at - start < left else (2 * i + 1, start + left)
        return i - self.width, start

    def put(self, first: int, leaves: list[tuple[int, int]]) -> None:
        """Sets the places from first on, and the sums above them."""
        low, high = first + self.width, first + self.width + len(leaves) - 1
        for i, (c, n) in enumerate(leaves, low):
            self.chars[i], self.sums[i] = c, n
        while low > 1:
            low, high = low // 2, high // 2
            for i in range(low, high + 1):
                for sums in (self.chars, self.sums):
                    sums[i] = sums[2 * i] + sums[2 * i + 1]

    def edit(self, count: Counter, text: str, start: int, end: int, new: str) -> tuple[str, int]:
        """The text with [start, end) replaced by new, and how many characters were recounted."""
        start = max(0, min(start, len(text)))
        end = max(start, min(end, len(text)))
        after, shift = text[:start] + new + text[end:], len(new) - (end - start)
        first, begin = self.place(start - 1)
        if begin:
            first, begin = self.place(begin - 1)
        behind = start + len(new)
        settled = lambda e: e >= behind and e - shift >= end and (e == len(after) or self.place(e - shift)[1] == e - shift)
        fresh = list(count.leaves(after, begin, settled))
        ends = [begin, *(e for e, _ in fresh)]
        leaves = [(b - a, n) for a, b, (_, n) in zip(ends, ends[1:], fresh, strict=False)]
        # What is recounted stood in the places up to that of the next leaf, or up to the end.
        upto = self.place(ends[-1] - shift)[0] if fresh and ends[-1] < len(after) else self.places
        if len(leaves) <= upto - first:
            self.put(first, leaves + [(0, 0)] * (upto - first - len(leaves))) if upto > first else None
        else:
            chars, tokens = self.sizes(), self.counts()
            rows = [x for x in zip(chars[:first], tokens[:first], strict=True) if x[0]] + leaves + [x for x in zip(chars[upto:], tokens[upto:], strict=True) if x[0]]
            spaced = [x for k, row in enumerate(rows) for x in ([row, (0, 0)] if k % 4 == 3 else [row])]
            self.lay_out([c for c, _ in spaced], [n for _, n in spaced])
        return after, ends[-1] - begin


def read_ranks(path: str = RANKS) -> bytes:
    with open(path, "rb") as f:
        return f.read()


EDITS = "array<struct<start:bigint,end:bigint,new:string>>"
TREE = "chars array<int>, tokens array<int>"


def _tree_columns(trees: list[Tree]) -> list[pa.Array]:
    return [pa.array([f(t) for t in trees], pa.list_(pa.int32())) for f in (Tree.sizes, Tree.counts)]


def build(docs: DataFrame, *, ranks: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text, n_tokens, chars and tokens (of each leaf of its tree)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(ranks)
        for b in batches:
            trees = [Tree(list(count.leaves(text.as_py() or ""))) for text in b.column(1)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([t.total for t in trees], pa.int64()), *_tree_columns(trees)], names=["doc_id", "text", "n_tokens", "chars", "tokens"])

    ids = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {ids}, text string, n_tokens long, {TREE}")


def apply(trees: DataFrame, edits: DataFrame | None = None, *, ranks: bytes, edits_col: str = "edits") -> DataFrame:
    """Trees as build returns them, after edits: doc_id, text, n_tokens, n_recounted (characters), chars, tokens.

    Edits are a column of trees, an array of (start, end, new) applied in order, each to what those before have left; or a
    table of their own (doc_id and that column), joined to trees by id.
    """
    if edits is not None:
        named = edits.select(F.col("doc_id").alias("_id"), F.col(edits_col).alias("_edits"))
        trees = trees.select("doc_id", "text", "chars", "tokens").join(named, F.col("doc_id") == F.col("_id"), "left").withColumnRenamed("_edits", edits_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(ranks)
        for b in batches:
            texts, sums, seen, done = [], [], [], []
            for text, chars, tokens, edits in zip(*(b.column(i) for i in range(1, 5)), strict=True):
                text, edits, recounted = text.as_py(), edits.as_py() or [], 0
                tree = Tree.kept(chars.as_py(), tokens.as_py()) if chars.is_valid and tokens.is_valid and len(chars) == len(tokens) else None
                if tree is None or tree.size != len(text or ""):
                    tree = Tree(list(count.leaves(text or "")))
                for e in edits:
                    if e is not None:
                        text, n = tree.edit(count, text or "", e["start"] or 0, e["end"] or 0, e["new"] or "")
                        recounted += n
                texts.append(text), sums.append(tree.total), seen.append(recounted), done.append(tree)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(sums, pa.int64()), pa.array(seen, pa.int64()), *_tree_columns(done)], names=["doc_id", "text", "n_tokens", "n_recounted", "chars", "tokens"])

    ids = trees.schema["doc_id"].dataType.simpleString()
    rows = trees.select("doc_id", "text", F.col("chars").cast("array<int>"), F.col("tokens").cast("array<int>"), F.col(edits_col).cast(EDITS))
    return rows.mapInArrow(run, f"doc_id {ids}, text string, n_tokens long, n_recounted long, {TREE}")


def count_edited(docs: DataFrame, *, ranks: bytes, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """One row per document: doc_id, n_tokens, n_tokens_after, n_leaves, n_recounted (characters), text_after.

    Trees are built and the edits of edits_col applied in one pass over the texts; see :func:`build` and :func:`apply`.
    """
    cols = docs.select(F.struct(F.col(id_col).alias("id"), F.col(edits_col).cast(EDITS).alias("edits")).alias("key"), F.col(text_col).alias("text"))
    built = build(cols, ranks=ranks, id_col="key")
    known = built.select(F.struct(F.col("doc_id.id").alias("id"), F.col("n_tokens").alias("n"), F.size("chars").cast("long").alias("leaves")).alias("doc_id"), "text", "chars", "tokens", F.col("doc_id.edits").alias("edits"))
    after = apply(known, ranks=ranks)
    return after.select(F.col("doc_id.id").alias("doc_id"), F.col("doc_id.n").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_after"), F.col("doc_id.leaves").alias("n_leaves"), "n_recounted", F.col("text").alias("text_after"))


def middle_edit(text):
    """An edit of each document: ten characters in its middle become other words."""
    middle = F.floor(F.length(text) / 2)
    return F.array(F.struct(middle.alias("start"), (middle + 10).alias("end"), F.lit(" as edited, 2 times").alias("new")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", middle_edit(F.col("text")).alias("edits"))
    return count_edited(docs, ranks=read_ranks()).drop("text_after")
