"""Benchmark decontamination by pigeonhole edit matching.

A test item of ``m`` characters may be found with up to ``k = m // chars_per_edit``
edits.  It is split into ``k + 1`` pieces, of which at least one stands unchanged in any
such copy.  An Aho-Corasick automaton finds the pieces' exact hits in each whole
document, and Myers' bit-parallel algorithm computes the edit distance between the item
and the stretch of the document around each hit.

Items and documents are compared lower-cased, with each run of white space as a blank.

Test items are handed to the tasks in blocks of bounded size, each block against all
documents, so neither memory nor the automaton grows with the benchmark.  Documents are
never shuffled.

Cases: null and empty items match nothing; null and empty documents are matched by
nothing; items shorter than ``chars_per_edit`` characters need an exact copy between word
boundaries; repeated items and documents are reported for each of their rows; a
document's distance to an item is that of the best copy; no rows in either table give
no rows; other columns of the input are not read by the match.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepline.llm.common import as_text

#: One edit allowed for so many characters of an item.
CHARS_PER_EDIT = 16
#: Characters of items in a block.
BLOCK_CHARS = 4_000_000

SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int64()), ("budget", pa.int64()), ("hits", pa.int64())])


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(item: str, chars_per_edit: int) -> int:
    return len(item) // chars_per_edit


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of near equal length, with their offsets."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:z]) for a, z in zip(cuts, cuts[1:])]


class Myers:
    """Least edit distance between a pattern and any substring of a text."""

    def __init__(self, pattern: str):
        self.m = len(pattern)
        self.top = 1 << (self.m - 1)
        self.all = (1 << self.m) - 1
        self.where: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.where[c] = self.where.get(c, 0) | 1 << i

    def distance(self, text: str) -> int:
        plus, minus, score, best = self.all, 0, self.m, self.m
        where, top, full = self.where, self.top, self.all
        for c in text:
            eq = where.get(c, 0)
            across = (((eq & plus) + plus) ^ plus) | eq | minus
            up = minus | ~(across | plus) & full
            down = plus & across
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                if score < best:
                    best = score
            up = up << 1 & full
            down = down << 1 & full
            # a match may begin anywhere, so nothing is carried in from above
            plus = down | ~(eq | minus | across | up) & full
            minus = up & (eq | minus | across)
        return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int = CHARS_PER_EDIT):
        self.items = [(i, text, budget(text, chars_per_edit)) for i, text in items if text]
        at: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, k) in enumerate(self.items):
            for a, piece in pieces(text, k):
                at.setdefault(piece, []).append((n, a))
        self.automaton = None
        if at:
            self.automaton = ahocorasick.Automaton()
            for piece, found in at.items():
                self.automaton.add_word(piece, (len(piece), found))
            self.automaton.make_automaton()
        self.myers: dict[int, Myers] = {}
        self.known: dict[tuple[int, str], int] = {}

    def _distance(self, n: int, window: str) -> int:
        if self.items[n][1] in window:
            return 0
        key = (n, window)
        if key not in self.known:
            if n not in self.myers:
                self.myers[n] = Myers(self.items[n][1])
            if len(self.known) > 20_000:
                self.known.clear()
            self.known[key] = self.myers[n].distance(window)
        return self.known[key]

    def match(self, text: str) -> dict[int, tuple[int, int]]:
        """For each item within its budget: its least distance and its number of piece hits."""
        best: dict[int, tuple[int, int]] = {}
        if self.automaton is None or not (text := normal(text)):
            return best
        hits: dict[int, dict[int, int]] = {}
        for end, (size, found) in self.automaton.iter(text):
            for n, a in found:
                start = end + 1 - size - a
                on = hits.setdefault(n, {})
                on[start] = on.get(start, 0) + 1
        for n, starts in hits.items():
            _, item, k = self.items[n]
            least, done = k + 1, None
            for start in sorted(starts):
                if k == 0:
                    z = start + len(item)
                    inside = (start == 0 or text[start - 1] == " ") and (z >= len(text) or text[z] == " ")
                    least = 0 if inside else least
                elif done is None or start > done:
                    # one window takes in the copies that begin up to k further on, too
                    done = start + k
                    least = min(least, self._distance(n, text[max(0, start - k) : start + len(item) + 2 * k]))
                if least == 0:
                    break
            if least <= k:
                best[n] = (least, sum(starts.values()))
        return best


def _item_blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for i, text in items.select(F.col(id_col).cast("long"), text_col).toLocalIterator():
        if text := normal(text or ""):
            block.append((i, text))
            size += len(text)
            if size >= block_chars:
                yield block
                block, size = [], 0
    if block:
        yield block


def _matches(batches, shared, chars_per_edit):
    matcher = Matcher(shared.value, chars_per_edit)
    for batch in batches:
        rows = [(i, matcher.items[n][0], d, matcher.items[n][2], hits) for i, text in zip(batch.column(0).to_pylist(), as_text(batch.column(1))) for n, (d, hits) in matcher.match(text).items()]
        if rows:
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", chars_per_edit: int = CHARS_PER_EDIT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document and item it holds within the item's error budget."""
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = spark.createDataFrame([], "doc_id long, item_id long, distance long, budget long, hits long")
    for block in _item_blocks(items, item_id, text, block_chars):
        shared = spark.sparkContext.broadcast(block)
        out = out.union(texts.mapInArrow(lambda it, b=shared: _matches(it, b, chars_per_edit), "doc_id long, item_id long, distance long, budget long, hits long"))
    return out


def _without(batches, shared, column, chars_per_edit):
    matcher = Matcher(shared.value, chars_per_edit)
    for batch in batches:
        keep = [not matcher.match(text) for text in as_text(batch.column(column))]
        yield batch.filter(pa.array(keep, pa.bool_()))


def drop_leaks(docs: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", chars_per_edit: int = CHARS_PER_EDIT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no item within its error budget, with all their columns and in place."""
    sc, at = docs.sparkSession.sparkContext, docs.columns.index(text)
    for block in _item_blocks(items, item_id, text, block_chars):
        shared = sc.broadcast(block)
        docs = docs.mapInArrow(lambda it, b=shared: _without(it, b, at, chars_per_edit), docs.schema)
    return docs
