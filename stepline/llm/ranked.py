"""Ranked lexical search by hashed max-sketches.

A document's impact for a term says how much the term counts in it, apart from the term's
weight.  Each document's impacts fold into a sketch of ``COORDINATES`` numbers: a term is
hashed to a coordinate, which keeps the largest impact of its terms.  So the sum of a query's
weights times the coordinates of its terms is never below the document's score.  Documents are
taken by descending bound and scored exactly, until the bound falls below the score of the k-th
best found so far: none of the rest can come in.  The ranking is exact whatever the hash does; a
collision only costs a score that was not needed.

How it runs.  Two scans of the texts for each block of items.  The first counts documents, their
terms, and how many documents hold each of the block's terms (a row a term and task).  The
second sketches a block of documents at a time, gathers the coordinates of all the block's items at
once, and rescans none.  A task keeps its k best of each item from block to block, so its threshold rises as it
goes; the tasks' best are ranked first by item and salt, then by item.  Items come in blocks of at
most ``BLOCK_CHARS`` characters (and one item), which bounds what is broadcast and the driver holds.  Only doc_id,
score and item are shuffled; no text is.

Weights and impacts are whole numbers, the scores exact:

    weight  floor(1000 ln((2N + 2) / (2 df + 1)))
    impact  10^9 tf div (1000 tf + 20 m), m = 100 - 50 + 50 n N div L

N: documents with a term; L: all their terms; n: the document's terms; df: documents that hold
the term; tf: its occurrences.

Cases: null, empty and term-less texts are no documents and rank nowhere; an item without terms
has no rows; rows with the same item id are one item with the terms of all, null being an id; repeated documents rank
each; among equal scores the smaller doc_id comes first, null last; no documents or no items give no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepline.llm.common import as_bytes

BEST = 50
COORDINATES = 4096
#: Characters of items in a block.
BLOCK_CHARS = 1 << 20
#: Documents, and words of theirs, in a block.
BLOCK_DOCS, BLOCK_WORDS = 256, 1 << 19
#: Terms of items that are looked up at once.
LOOKUPS = 8192
SALTS = 64
#: Bytes that end a term become a space, A-Z their lower case; all others stay.  Those of characters beyond ASCII are all above 0x7F.
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
_LOWER = bytes(range(0x100)).lower()
TABLE = bytes(c if c in _KEPT else 0x20 for c in _LOWER)


def terms(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def coordinate(term: bytes, coordinates: int) -> int:
    return zlib.crc32(term) % coordinates


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n: int, n_docs: int, n_terms: int) -> int:
    return 100 - 50 + (50 * n * n_docs) // n_terms


def impact(tf: int, m: int) -> int:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """(id, distinct terms) of the items, in blocks."""
    block, size = [], 0
    whole = items.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.concat_ws(" ", F.collect_list(F.col(text_col).cast("string"))).alias("text"))
    for i, text in whole.toLocalIterator():
        if found := sorted(set(terms(text.encode()))):
            block.append((i, found))
            size += len(text)
            if size >= block_chars:
                yield block
                block, size = [], 0
    if block:
        yield block


def _counts(batches, shared):
    """(term's place, documents that hold it); -1: documents with terms, -2: their terms."""
    place = {t: k for k, t in enumerate(sorted({t for _, ts in shared.value for t in ts}))}
    df, docs, total = np.zeros(len(place), np.int64), 0, 0
    for batch in batches:
        for text in as_bytes(batch.column(1)):
            words = terms(text)
            docs, total = docs + bool(words), total + len(words)
            for t in place.keys() & set(words):
                df[place[t]] += 1
    held = np.flatnonzero(df)
    yield pa.record_batch([pa.array(np.concatenate([held, [-1, -2]])), pa.array(np.concatenate([df[held], [docs, total]]))], names=["place", "n"])


class Lookup:
    """A block of items: the weights of their terms, and where these are in a sketch."""

    def __init__(self, items, n_docs: int, n_terms: int, df: dict[int, int], coordinates: int):
        self.n_docs, self.n_terms, self.coordinates = n_docs, n_terms, coordinates
        vocabulary = sorted({t for _, ts in items for t in ts})
        of = {t: weight(n_docs, df.get(k, 0)) for k, t in enumerate(vocabulary)}
        self.ids = [i for i, _ in items]
        # terms that no document holds add nothing, neither to a bound nor to a score
        seen = {t for k, t in enumerate(vocabulary) if k in df}
        self.items = [[(t, of[t]) for t in ts if t in seen] for _, ts in items]
        self.at = np.array([coordinate(t, coordinates) for ts in self.items for t, _ in ts], np.int64)
        self.weights = np.array([w for ts in self.items for _, w in ts], np.int64)
        self.of = np.repeat(np.arange(len(items)), [len(ts) for ts in self.items])

    def sketch(self, docs: list[Counter], norms: list[int]) -> np.ndarray:
        """Coordinates by documents: the largest impact of each one's terms."""
        out = np.zeros((self.coordinates, len(docs)), np.int64)
        for d, (counts, m) in enumerate(zip(docs, norms)):
            at = np.fromiter((zlib.crc32(t) for t in counts), np.int64, len(counts)) % self.coordinates
            tf = np.fromiter(counts.values(), np.int64, len(counts))
            np.maximum.at(out[:, d], at, 1_000_000_000 * tf // (1000 * tf + 20 * m))
        return out

    def bounds(self, sketch: np.ndarray) -> np.ndarray:
        """Items by documents: what no score is above."""
        out = np.zeros((len(self.ids), sketch.shape[1]), np.int64)
        for a in range(0, len(self.at), LOOKUPS):
            part = slice(a, a + LOOKUPS)
            first = np.flatnonzero(np.diff(self.of[part], prepend=-1))
            out[self.of[part][first]] += np.add.reduceat(sketch[self.at[part]] * self.weights[part, None], first, axis=0)
        return out

    def score(self, item: int, counts: Counter, m: int) -> int:
        return sum(w * impact(counts[t], m) for t, w in self.items[item] if t in counts)


class Best:
    """The k best documents of each item so far."""

    def __init__(self, lookup: Lookup, k: int):
        self.lookup, self.k, self.scored = lookup, k, 0
        self.heaps: list[list] = [[] for _ in lookup.ids]
        # a score of 0 does not count
        self.least = np.ones(len(lookup.ids), np.int64)

    def add(self, ids: list, docs: list[Counter]) -> None:
        norms = [length_norm(c.total(), self.lookup.n_docs, self.lookup.n_terms) for c in docs]
        bounds = self.lookup.bounds(self.lookup.sketch(docs, norms))
        may = bounds >= self.least[:, None]
        for item in np.flatnonzero(may.any(1)).tolist():
            heap, near = self.heaps[item], np.flatnonzero(may[item])
            for d in near[np.argsort(-bounds[item, near], kind="stable")].tolist():
                if bounds[item, d] < self.least[item]:
                    break
                self.scored += 1
                found = self.lookup.score(item, docs[d], norms[d])
                if found < self.least[item]:
                    continue
                # the smaller id is the better one, null the worst
                entry = (found, ids[d] is not None, -(ids[d] or 0))
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                else:
                    heapq.heappushpop(heap, entry)
                if len(heap) == self.k:
                    self.least[item] = heap[0][0]

    def rows(self) -> Iterator[tuple]:
        for item, heap in zip(self.lookup.ids, self.heaps):
            for found, has_id, minus in heap:
                yield item, -minus if has_id else None, found


def _searched(batches, shared, stats, coordinates, k):
    best = Best(Lookup(shared.value, *stats.value, coordinates), k)
    ids, docs, words = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            if counts := Counter(terms(text)):
                ids.append(i)
                docs.append(counts)
                words += len(counts)
                if len(docs) == BLOCK_DOCS or words >= BLOCK_WORDS:
                    best.add(ids, docs)
                    ids, docs, words = [], [], 0
    if docs:
        best.add(ids, docs)
    rows = list(best.rows())
    for a in range(0, len(rows), 1 << 16):
        yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows[a : a + (1 << 16)])], names=["item_id", "doc_id", "score"])


def search(docs: DataFrame, items: DataFrame, k: int = BEST, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", coordinates: int = COORDINATES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 of each item."""
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for block in item_blocks(items, item_id, text, block_chars):
        shared = spark.sparkContext.broadcast(block)
        counted = texts.mapInArrow(lambda it, b=shared: _counts(it, b), "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
        # a row for each term of the block
        df = {r.place: r.n for r in counted.collect()}
        n_docs, n_terms = df.pop(-1, 0), df.pop(-2, 0)
        if n_docs:
            stats = spark.sparkContext.broadcast((n_docs, n_terms, df))
            found = found.union(texts.mapInArrow(lambda it, b=shared, s=stats: _searched(it, b, s, coordinates, k), "item_id long, doc_id long, score long"))
    best_first = [F.desc("score"), F.asc_nulls_last("doc_id")]
    few = Window.partitionBy("item_id", "salt").orderBy(*best_first)
    of_salt = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).withColumn("rank", F.row_number().over(few)).filter(F.col("rank") <= k)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*best_first))
    return of_salt.select("item_id", "doc_id", "score").withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
