"""LM scoring by online logistic context mixing.

A text is a sequence of words and one end mark.  A word is coded by the bits of a Huffman
code over the frequent words (the head); all others share one code, the escape.  For each bit,
predictors look up how often 0 and 1 followed in their hashed context:

* the code so far alone,
* with the class of the text before it, which is that of the last common short word (classes are
  clusters of short words that stand in the same documents: they tell languages and kinds of text apart),
* with the word before;

and a fourth one says what followed the word before when it last stood in the same text.  A
mixer adds their log-odds with weights chosen by a gate (how much evidence the longer
contexts have, and whether the text's own memory has just been right), and a last table
refines the mixed probability.  The mixer learns along each text: it starts from the
corpus's weights and takes a step after every ``stride`` words.

After an escape comes a rare word.  Its probability is a mixture of how often it followed the rare
word before it in other documents, how often it stands in other documents, and its spelling, the
bits of whose bytes are predicted by a second mixer over hashed contexts (the last one, two and
three bytes, and the word so far).  So a passage that another document has costs less than the
same words elsewhere, and what is counted for that grows with the corpus.

Bits are predicted from what stands before them alone, hence probabilities multiply to that of the
text.  Of a document that was learnt from, its own occurrences are taken out of the counts that
predict it, so its score says what the rest of the corpus knows of it.

How it runs.

1.  Count in how many documents short words (hashed) stand together, and cluster them; count
    words (tasks pre-aggregate, Spark sums).  The head are words seen at least twice, the most
    frequent ones, as many as ``head`` allows.
2.  Count bits by context over all learnt texts: tasks fill tables, Spark sums them.  The hashed
    table's size is a parameter, as it is broadcast.
3.  Fit the weights, by Newton steps, and then the refinement, on all bits of all learnt texts (and of all words outside
    the head for spelling).  Tasks count bits by gate and inputs, each input rounded to a grid; the driver fits on those
    counts, which are whole numbers of a fixed size, so they do not depend on how rows are dealt.
4.  Spell the words outside the head, once for each distinct word.
5.  Score texts where they are.  Their rare words are shuffled by the rare word before them, which
    counts what follows it, and then joined to their own counts and spelling.

Cases: a null text is empty (one end mark); a null id is hashed as the empty text;
repeated rows are scored one by one; with no training text at all the model predicts
every bit with 1/2; other columns of the input are not touched or read.
"""

from __future__ import annotations

import heapq
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepline.llm.common import as_bytes, cut

#: The end mark.  No word holds a line break.
END = b"\n"
BUCKETS = 33
#: Added to both counts of a context.
DELTA = 0.02
CLASSES = 8
#: Bytes of a short word, and hashed short words whose documents are counted.
SHORT, SLOTS = 3, 512
#: Counts of a table's slot, two bytes; more are scaled down.
MOST_COUNT = 255
#: Log-odds that the text's own memory speaks for, before it is weighed.
SURE = np.float32(3.0)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


@dataclass(frozen=True)
class MixingParams:
    """``head``: words with a code of their own, none longer than ``head_bytes``; ``table_bits``: log2
    of the slots of the table of words before, ``spell_bits``: of byte contexts; ``flush``: distinct
    words that a task counts before it hands them on; ``stride``: words between two steps of a text's
    mixer; ``rate`` and ``inertia``: of those steps; ``refine``: weight of the last table against the
    mixer; ``trust``: share of the probability that goes by the rare word before, where it is known."""

    head: int = 1 << 17
    head_bytes: int = 64
    table_bits: int = 22
    spell_bits: int = 20
    flush: int = 400_000
    stride: int = 128
    rate: float = 0.25
    inertia: float = 30.0
    refine: float = 0.5
    trust: float = 0.2


def held_out(doc_id) -> bool:
    """Whether a document is kept from learning."""
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5 == 1


def slot_of(word: bytes) -> int:
    return zlib.crc32(word) % SLOTS


def _some_rows(batches, at_most=4 << 20):
    """Texts some million bytes at a time: (ids, whether held out, bytes and words of each, all words one after the other)."""
    for batch in batches:
        texts = batch.column(1).fill_null("")
        n_bytes = pc.binary_length(texts).to_numpy().astype(np.int64)
        ends = np.cumsum(n_bytes) // at_most
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1), len(texts)]
        for i, j in zip(cuts, cuts[1:]):
            if j > i:
                ids = batch.column(0).slice(i, j - i).to_pylist()
                yield ids, np.fromiter(map(held_out, ids), bool, j - i), n_bytes[i:j], *_words(texts.slice(i, j - i))
                pa.default_memory_pool().release_unused()


def _words(texts) -> tuple[np.ndarray, pa.Array]:
    """(words of each text, all words in lower case one after the other)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    size, words = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().cast(pa.binary())
    # blanks at a text's ends leave empty words
    some = pc.binary_length(words).to_numpy() > 0
    if not some.all():
        size = np.bincount(np.repeat(np.arange(len(size)), size)[some], minlength=len(size))
        words = words.filter(pa.array(some))
    return size, words


def _count_together(batches):
    """By pairs of slots, the number of learnt documents that hold both."""
    total = np.zeros((SLOTS, SLOTS))
    for _, held, _, size, words in _some_rows(batches):
        row = np.repeat(np.arange(len(size)), size)
        short = (pc.binary_length(words).to_numpy() <= SHORT) & ~held[row]
        kinds = words.filter(pa.array(short)).dictionary_encode()
        slot = np.array([slot_of(w) for w in kinds.dictionary.to_pylist()], np.int64)[kinds.indices.to_numpy()]
        row = row[short]
        for k in range(0, len(size), 1000):
            i, j = np.searchsorted(row, [k, k + 1000])
            has = np.zeros((1000, SLOTS), np.float32)
            has[row[i:j] - k, slot[i:j]] = 1
            total += has.T @ has
    yield from _packed(total.astype(np.int64).ravel())


def cluster(together: np.ndarray, classes: int = CLASSES - 1, least: float = 0.005) -> dict[int, int]:
    """Slots that stand in at least that share of documents, in clusters numbered from 1, by average linkage."""
    docs = np.diag(together)
    at = np.flatnonzero((docs > 0) & (docs >= least * docs.max(initial=0)))
    if not len(at):
        return {}
    size = np.sqrt(docs[at])
    like = together[np.ix_(at, at)] / size[:, None] / size
    groups = [[i] for i in range(len(at))]
    np.fill_diagonal(like, -1)
    while len(groups) > classes:
        i, j = sorted(divmod(int(like.argmax()), len(groups)))
        n, m = len(groups[i]), len(groups[j])
        like[i] = like[:, i] = (like[i] * n + like[j] * m) / (n + m)
        like[i, i] = -1
        groups[i] += groups.pop(j)
        like = np.delete(np.delete(like, j, 0), j, 1)
    return {int(at[i]): k + 1 for k, group in enumerate(groups) for i in group}


# -- mixing ----------------------------------------------------------------------------


#: Log-odds beyond which a mixer does not go; the buckets of the refinement are half a unit wide.
FAR = np.float32((BUCKETS - 1) / 4)


def _bucket(mixed):
    return (mixed * 2 + np.float32(BUCKETS / 2)).astype(np.int64)


class Mixer:
    """Weights (gates, inputs) and the refinement (gates, buckets)."""

    def __init__(self, gates: int, inputs: int):
        self.weights = np.full((gates, inputs), 0.35, np.float32)
        self.refined = np.tile(1 / (1 + np.exp(-(np.arange(BUCKETS) - BUCKETS // 2) / 2)), (gates, 1)).astype(np.float32)

    def mixed(self, x, gate):
        """``x``: (bits, inputs)."""
        return np.clip(np.einsum("ij,ij->i", self.weights.take(gate, 0), x), -FAR, FAR)

    def refinement(self, refine):
        """What the refinement adds to a bit's probability, by bit, gate and bucket."""
        return (np.concatenate([1 - self.refined.ravel(), self.refined.ravel()]) * np.float32(refine)).astype(np.float32)


def _signed_logs(mixed, double, at, refinement, refine):
    """(log of the bits' probabilities, what the mixer alone says of them).

    ``mixed``: log-odds of the bits as they are; ``double``: 2 for a 1, -2 for a 0; ``at``: the place
    of (bit, gate, 0) in the refinement."""
    q = np.exp(-mixed)
    q += 1
    np.reciprocal(q, out=q)
    p = refinement.take(at + (mixed * double + np.float32(BUCKETS / 2)).astype(np.int64), mode="clip")
    p += q * np.float32(1 - refine)
    return np.log(np.maximum(p, np.float32(1e-6), out=p), out=p), q


class Sums:
    """What a fit needs of some bits, by gate: slopes and curvature of the weights, and the refinement's counts."""

    def __init__(self, mixer: Mixer):
        gates, inputs = mixer.weights.shape
        self.mixer, self.slope = mixer, np.zeros((gates, inputs))
        self.curve, self.hits = np.zeros((gates, inputs, inputs)), np.zeros((2, gates, BUCKETS))

    def add(self, x, gate, bit, weight=None):
        gates, inputs = self.slope.shape
        mixed = self.mixer.mixed(x, gate)
        p = 1 / (1 + np.exp(-mixed))
        m = np.ones(len(bit), np.float32) if weight is None else weight
        wrong, spread = m * (bit - p), m * p * (1 - p)
        for i in range(inputs):
            self.slope[:, i] += np.bincount(gate, wrong * x[:, i], gates)
            for j in range(i, inputs):
                self.curve[:, i, j] += np.bincount(gate, spread * x[:, i] * x[:, j], gates)
        at = gate * BUCKETS + _bucket(mixed)
        self.hits[0] += np.bincount(at, m * bit, gates * BUCKETS).reshape(gates, BUCKETS)
        self.hits[1] += np.bincount(at, m, gates * BUCKETS).reshape(gates, BUCKETS)


@dataclass(frozen=True)
class Grid:
    """Inputs of a mixer rounded to ``levels`` values from ``-span`` to ``span`` each."""

    gates: int
    levels: tuple
    span: tuple

    @property
    def size(self) -> int:
        return 2 * self.gates * math.prod(self.levels)

    @property
    def strides(self) -> list:
        """How far a gate, and then a level of each input, are from the next."""
        return [2 * math.prod(self.levels[i:]) for i in range(len(self.levels) + 1)]

    def level(self, i, x):
        """The level of an input."""
        up = np.float32((self.levels[i] - 1) / 2)
        return np.rint(np.clip(x * (up / np.float32(self.span[i])), -up, up) + up).astype(np.int32)

    def cells(self, x, gate, bit):
        """A cell for each bit."""
        at = gate.astype(np.int32) * np.int32(self.strides[0]) + bit
        for i, stride in enumerate(self.strides[1:]):
            at += self.level(i, x[:, i]) * np.int32(stride)
        return at

    def points(self, at):
        """(inputs, gate) of pairs of cells."""
        x = np.empty((len(at), len(self.levels)), np.float32)
        for i in reversed(range(len(self.levels))):
            at, k = np.divmod(at, self.levels[i])
            x[:, i] = (2 * k / (self.levels[i] - 1) - 1) * self.span[i]
        return x, at


def fitted(mixer: Mixer, grid: Grid, counts: np.ndarray, steps: int = 4) -> Mixer:
    """The mixer after Newton steps from there, with its refinement counted, by the number of bits in each cell."""
    counts = counts.reshape(-1, 2)
    at = np.flatnonzero(counts.any(1))
    (x, gate), counts, out = grid.points(at), counts[at].astype(float), Mixer(*mixer.weights.shape)
    out.weights = mixer.weights.copy()
    for step in range(steps + 1):
        sums = Sums(out)
        for bit in (0, 1):
            sums.add(x, gate, np.full(len(at), bit), counts[:, bit])
        if step < steps:
            for g in range(len(sums.slope)):
                c = np.triu(sums.curve[g]) + np.triu(sums.curve[g], 1).T + np.eye(len(sums.slope[g]))
                out.weights[g] += np.clip(np.linalg.solve(c, sums.slope[g]), -1, 1).astype(np.float32)
    out.refined = ((sums.hits[0] + 8 * out.refined) / (sums.hits[1] + 8)).astype(np.float32)
    return out


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, length) of each symbol, by its count; one never seen counts as one."""
    n = len(counts)
    heap = [(int(c) + 1, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, side = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)
    for new in range(n, 2 * n - 1):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x] = parent[y] = new
        side[y] = 1
        heapq.heappush(heap, (a + b, new))
    code, length = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)
    for i in range(2 * n - 3, -1, -1):
        length[i] = length[parent[i]] + 1
        code[i] = code[parent[i]] << 1 | side[i]
    return code[:n], length[:n]


def as_pairs(counts: np.ndarray) -> np.ndarray:
    """Counts of 0 and 1 in turn as one number a slot, a byte each; pairs beyond a byte keep their proportion."""
    counts = counts.reshape(-1, 2)
    most = counts.max(1, keepdims=True)
    counts = np.where(most > MOST_COUNT, -(-counts * MOST_COUNT // np.maximum(most, 1)), counts)
    return (counts[:, 0] | counts[:, 1] << 8).astype(np.uint16)


def _pair_tables():
    """By pair, and as 0 or 1 has its own occurrence taken out or none has: log-odds, and the evidence from 0 to 3."""
    pair = np.arange(1 << 16)
    n = np.stack([pair & 255, pair >> 8])
    all_n = np.stack([n, np.stack([np.maximum(n[0] - 1, 0), n[1]]), np.stack([n[0], np.maximum(n[1] - 1, 0)])])
    odds = np.log((all_n[:, 1] + DELTA) / (all_n[:, 0] + DELTA)).astype(np.float32).ravel()
    return odds, np.searchsorted([1, 4, 31], all_n.sum(1), "right").astype(np.int8).ravel()


ODDS, EVIDENCE = _pair_tables()
#: The same by (whether learnt, bit, pair), log-odds of the bit as it is.
_FORMS = np.concatenate([np.arange(1 << 16) + (k << 16) for k in (0, 0, 1, 2)])
EVIDENCES = EVIDENCE[_FORMS]
SIGNED = (ODDS[_FORMS] * np.repeat(np.float32([-1, 1, -1, 1]), 1 << 16)).astype(np.float32)
PIECE = 1 << 16
PIECES = "piece int, counts binary"


def _packed(counts: np.ndarray, after: int = 0):
    """Counts as rows (piece, packed bytes) of pieces that are not all zero; ``after``: what comes before them, whole pieces."""
    pack = zstandard.ZstdCompressor(1)
    for k in range(0, len(counts), PIECE):
        x = counts[k : k + PIECE]
        if x.any():
            yield pa.record_batch([pa.array([(after + k) // PIECE], pa.int32()), pa.array([pack.compress(x.astype(np.int64).tobytes())], pa.binary())], names=["piece", "counts"])


def _sum_pieces(batches):
    """Sums the packed counts that a task holds, one row of the result for each piece."""
    total: dict = {}
    for batch in batches:
        for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(zstandard.decompress(x), np.int64)
            total[k] = total[k] + x if k in total else x
    pack = zstandard.ZstdCompressor(1)
    for k, x in total.items():
        yield pa.record_batch([pa.array([k], pa.int32()), pa.array([pack.compress(x.tobytes())], pa.binary())], names=["piece", "counts"])


def summed(counts: DataFrame, size: int, hashed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """What tasks have counted: of the first ``hashed`` counts, pairs; the others as they are."""
    pairs, plain = np.zeros(hashed // 2, np.uint16), np.zeros(size - hashed, np.int64)
    for k, x in counts.repartition("piece").mapInArrow(_sum_pieces, PIECES).toLocalIterator():
        x = np.frombuffer(zstandard.decompress(bytes(x)), np.int64)
        cut_at = min(max(hashed - k * PIECE, 0), len(x))
        at = k * PIECE // 2
        pairs[at : at + cut_at // 2] = as_pairs(x[:cut_at])
        at = k * PIECE + cut_at - hashed
        plain[max(at, 0) : max(at, 0) + len(x) - cut_at] = x[cut_at:]
    return pairs, plain


def _slots(context, node, bits):
    """``context``, ``node``: hashes of 32 bits."""
    h = context + node
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    h *= np.uint32(0x297A2D39)
    h >>= np.uint32(32 - bits)
    return h


def _stable_order(key):
    """Places by key, and within a key as they stand."""
    key = key * len(key)
    key += np.arange(len(key))
    key.sort()
    return key % max(len(key), 1)


# -- words -----------------------------------------------------------------------------


class Code:
    """Numbers of the head's words, their bits and classes."""

    def __init__(self, words: list[bytes], counts: np.ndarray, of_slot: dict[int, int]):
        """``counts``: of the words, then of the end mark and of the escape."""
        self.words = pa.array(words, pa.binary())
        self.end, self.escape = len(words), len(words) + 1
        self.of = np.array([of_slot.get(slot_of(w), 0) if len(w) <= SHORT else 0 for w in words] + [0, 0], np.int64)
        code, length = huffman(counts)
        self.length, self.aligned = length.astype(np.int64), code << (62 - length)
        # codes one after the other, those of frequent words together
        rank = np.argsort(-counts, kind="stable")
        self.offset = np.empty(len(length), np.int64)
        self.offset[rank] = np.cumsum(length[rank]) - length[rank]
        symbol = np.repeat(rank, length[rank])
        depth = np.arange(len(symbol)) - self.offset[symbol]
        left = length[symbol] - depth
        names, node = np.unique((code[symbol] >> left) | (np.int64(1) << depth), return_inverse=True)
        self.n_nodes = len(names)
        #: node * 2 + bit
        self.step = (node * 2 + ((code[symbol] >> (left - 1)) & 1)).astype(np.int32)

    def symbols(self, words: pa.Array) -> np.ndarray:
        return pc.index_in(words, value_set=self.words).fill_null(self.escape).to_numpy().astype(np.int64)

    def counted(self, by_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From counts (classes, symbols): log-odds of the nodes, and pairs (classes and nodes)."""
        rank = np.argsort(self.offset)
        symbol = np.repeat(rank, self.length[rank])
        pairs = np.stack([np.bincount(self.step, row[symbol], 2 * self.n_nodes) for row in by_class.astype(float)])
        n = pairs.sum(0).reshape(-1, 2)
        return np.log((n[:, 1] + 0.5) / (n[:, 0] + 0.5)).astype(np.float32), as_pairs(pairs.astype(np.int64).ravel())


@dataclass
class Tables:
    odds: np.ndarray
    by_class: np.ndarray
    by_word: np.ndarray
    bits: int

    def __setstate__(self, state):
        # copies, as numpy asks for large pages, which what is unpickled does not stand in
        self.__dict__.update({k: v.copy() if isinstance(v, np.ndarray) else v for k, v in state.items()})

    def __post_init__(self):
        # by node and bit, as SIGNED is; and what the log-odds and the bit add to a cell
        self.signed = np.column_stack([-self.odds, self.odds]).ravel()
        self.cells = np.repeat(TEXT_GRID.level(0, self.odds) * np.int32(TEXT_GRID.strides[1]), 2)
        self.cells[1::2] += 1


INPUTS, GATES = 4, 4 * 4 * 3
#: Log-odds of a byte's counts are within 9.5; the text's own memory has three values.
TEXT_GRID = Grid(GATES, (24, 24, 24, 3), (9.5, 9.5, 9.5, float(SURE)))


def _cells_of(grid: Grid, i: int, gates: int):
    """What a pair of counts adds to a bit's cell as the grid's input ``i``, in the order of SIGNED; its evidence counts as so many gates."""
    return (EVIDENCES * np.int32(gates * grid.strides[0]) + grid.level(i, ODDS[_FORMS]) * np.int32(grid.strides[i + 1])).astype(np.int32)


CLASS_CELLS, WORD_CELLS = _cells_of(TEXT_GRID, 1, 12), _cells_of(TEXT_GRID, 2, 3)
#: A pair's share of the gate, in the order of SIGNED.
CLASS_GATES, WORD_GATES = EVIDENCES * np.int8(12), EVIDENCES * np.int8(3)


class Texts:
    """Some texts' symbols one after the other, each text closed by the end mark, and what predicts their bits."""

    def __init__(self, code: Code, symbols: list, learnt: list):
        size = np.array([len(x) + 1 for x in symbols], np.int64)
        s = np.full(size.sum(), code.end)
        last = np.cumsum(size) - 1
        self.first = last - size + 1
        self.doc = np.repeat(np.arange(len(size)), size)
        inner = np.ones(len(s), bool)
        inner[last] = False
        s[inner] = np.concatenate(symbols) if symbols else s[:0]
        self.symbol, self.code, self.n_docs = s, code, len(size)
        self.place = np.arange(len(s)) - self.first[self.doc]
        self.before = np.where(self.place > 0, np.concatenate([[code.end], s[:-1]]) if len(s) else s, code.end)
        self.learnt = np.array(learnt, np.int32)[self.doc] if len(size) else np.zeros(0, np.int32)

    def classes(self) -> np.ndarray:
        """The class of the text before each word: that of the last common short word, 0 at first."""
        of = np.where(self.place > 0, self.code.of[self.before], 0)
        at = np.maximum.accumulate(np.where((of > 0) | (self.place == 0), np.arange(len(of)), 0)) if len(of) else of
        return of[at]

    def memory(self):
        """What followed the word before when it last stood in the text (-1: never), and how sure that is: 0 to 2."""
        key = self.doc * len(self.code.length) + self.before
        order = _stable_order(key)
        again = key[order][1:] == key[order][:-1]
        said = np.full(len(key), -1)
        said[order[1:][again]] = self.symbol[order[:-1][again]]
        said[self.before == self.code.escape] = -1
        right = (said == self.symbol).astype(np.int64)
        after_right = np.concatenate([[0], right[:-1]]) * (self.place > 0) if len(right) else right
        return said, np.where(said >= 0, 1 + after_right, 0)

    def hashed_before(self):
        return ((self.before.astype(np.uint64) + np.uint64(1)) * _M1 >> np.uint64(32)).astype(np.uint32)

    def paths(self, order=slice(None)):
        """(bits of each token, token, node * 2 + bit) of all bits of the tokens in ``order``."""
        code, s = self.code, self.symbol[order]
        n, offset = code.length.take(s), code.offset.take(s)
        start = np.cumsum(n) - n
        token, at = np.zeros(int(n.sum()), np.int64), np.ones(int(n.sum()), np.int64)
        token[start[1:]] = 1
        at[start[:1]] = offset[:1]
        at[start[1:]] = offset[1:] - offset[:-1] - n[:-1] + 1
        return n, np.cumsum(token, out=token), code.step.take(np.cumsum(at, out=at), mode="clip")

    def hashed(self, token, step, bits, order=slice(None)):
        """Slots by word before."""
        node = (step >> 1).astype(np.uint64)
        node += np.uint64(1)
        node *= _M2
        node >>= np.uint64(32)
        return _slots(self.hashed_before()[order].take(token, mode="clip"), node.astype(np.uint32), bits)

    def contexts(self, tables: Tables, order=slice(None)):
        """Of all bits of the tokens in ``order``: (bits of each token, token, node * 2 + bit, places in SIGNED by class and
        by word before), then (bit, whether right, how sure) of those bits that the text's own memory speaks of."""
        code = self.code
        n, token, step = self.paths(order)
        each = lambda v: v[order].take(token, mode="clip")
        form = each(self.learnt << 17)
        form += (step & 1) << 16
        place = each((self.classes() * code.n_nodes).astype(np.int32))
        place += step >> 1
        by_class = form + tables.by_class.take(place, mode="clip")
        form += tables.by_word.take(self.hashed(token, step, tables.bits, order), mode="clip")
        said, sure = (v[order] for v in self.memory())
        some = np.flatnonzero(said >= 0)
        differ = code.aligned[self.symbol[order][some]] ^ code.aligned[said[some]]
        # the place of the first bit in which two codes of 62 bits differ
        agree = np.where(differ == 0, 64, 61 - np.floor(np.log2(np.maximum(differ, 1).astype(float))).astype(np.int64))
        spoken = np.minimum(agree + 1, n[some])
        start = np.cumsum(spoken) - spoken
        depth = np.arange(int(spoken.sum())) - np.repeat(start, spoken)
        bits = depth + np.repeat((np.cumsum(n) - n)[some], spoken)
        return n, token, step, by_class.astype(np.int64), form.astype(np.int64), bits, depth < np.repeat(agree, spoken), np.repeat(sure[some], spoken)

    def cells(self, tables: Tables) -> np.ndarray:
        """The grid's cell of each bit."""
        _, _, step, by_class, by_word, spoken, right, sure = self.contexts(tables)
        cell = tables.cells.take(step, mode="clip")
        cell += CLASS_CELLS.take(by_class, mode="clip")
        cell += WORD_CELLS.take(by_word, mode="clip")
        # a memory that says nothing is in the middle of three levels
        gate, _, _, _, stride = TEXT_GRID.strides
        cell += np.int32(stride)
        cell[spoken] += (sure * gate + np.where(right == (step[spoken] % 2 == 1), stride, -stride)).astype(np.int32)
        return cell

    def costs(self, tables: Tables, mixer: Mixer, params: MixingParams) -> np.ndarray:
        """log10 of each token's probability."""
        step = self.place // params.stride
        steps = np.zeros(self.n_docs, np.int64)
        np.maximum.at(steps, self.doc, step)
        # by step, texts that go on first
        most = int(steps.max(initial=0))
        order = _stable_order(step * (most + 1) + (most - steps)[self.doc])
        n, token, node, by_class, by_word, spoken, right, sure = self.contexts(tables, order)
        # inputs are log-odds of the bits as they are
        x = np.zeros((INPUTS, len(token)), np.float32)
        np.take(tables.signed, node, out=x[0], mode="clip")
        np.take(SIGNED, by_class, out=x[1], mode="clip")
        np.take(SIGNED, by_word, out=x[2], mode="clip")
        x[3, spoken] = np.where(right, SURE, -SURE)
        gate = CLASS_GATES.take(by_class, mode="clip")
        gate += WORD_GATES.take(by_word, mode="clip")
        gate[spoken] += sure.astype(np.int8)
        gate = gate.astype(np.int64)
        base = mixer.weights[:, 0].take(gate, mode="clip")
        base *= x[0]
        for i in range(1, INPUTS):
            base += mixer.weights[:, i].take(gate, mode="clip") * x[i]
        double = (((node & 1) << 2) - 2).astype(np.float32)
        gate *= BUCKETS
        gate += (double > 0) * (GATES * BUCKETS)
        refinement = mixer.refinement(params.refine)

        tokens = np.searchsorted(step[order], np.arange(most + 2))
        ends = np.concatenate([[0], np.cumsum(n)])
        doc, out = self.doc[order], np.empty(len(base), np.float32)
        doc_of = doc.take(token, mode="clip")
        # where a text's words of a step begin
        first = np.flatnonzero(np.diff(doc, prepend=-1) | np.diff(step[order], prepend=-1))
        firsts, goes_on = np.searchsorted(first, tokens), steps[doc[first]] > step[order][first]
        # what each text has learnt, on top of the corpus's weights
        own = np.zeros((INPUTS, self.n_docs), np.float32)
        for k, (u, v) in enumerate(zip(tokens, tokens[1:])):
            i, j = ends[u], ends[v]
            mixed = base[i:j]
            if k:
                for w, y in zip(own, x[:, i:j]):
                    mixed += w.take(doc_of[i:j], mode="clip") * y
            np.clip(mixed, -FAR, FAR, out=mixed)
            out[i:j], q = _signed_logs(mixed, double[i:j], gate[i:j], refinement, params.refine)
            # texts that go on
            these = first[firsts[k] : firsts[k + 1]]
            n_on = int(np.count_nonzero(goes_on[firsts[k] : firsts[k + 1]]))
            if n_on:
                starts, j = ends[these[:n_on]] - i, ends[these[n_on]] if n_on < len(these) else j
                q = q[: j - i]
                wrong = 1 - q
                spread = q * wrong
                up, down = np.empty((2, INPUTS, n_on), np.float32)
                for a, b, y in zip(up, down, x[:, i:j]):
                    z = y * wrong
                    np.add.reduceat(z, starts, out=a)
                    np.multiply(y, y, out=z)
                    z *= spread
                    np.add.reduceat(z, starts, out=b)
                down += params.inertia
                up /= down
                own[:, doc[these[:n_on]]] += params.rate * up.clip(-0.5, 0.5)
        found = np.empty(len(self.symbol))
        found[order] = np.bincount(token, out, len(self.symbol)) / math.log(10)
        return found


def _count_words(batches, flush):
    parts, n_texts = [], np.zeros(2, np.int64)

    def summed_parts():
        table = pa.Table.from_batches(parts).group_by("w", use_threads=False).aggregate([("t", "sum"), ("a", "sum")])
        return pa.table([table[x].combine_chunks() for x in ("w", "t_sum", "a_sum")], ["w", "t", "a"])

    for _, held, _, size, words in _some_rows(batches):
        kinds = words.dictionary_encode()
        of, n = kinds.indices.to_numpy(), len(kinds.dictionary)
        learnt, every = np.bincount(of[np.repeat(~held, size)], minlength=n), np.bincount(of, minlength=n)
        parts.append(pa.record_batch([kinds.dictionary, pa.array(learnt, pa.int64()), pa.array(every, pa.int64())], names=["w", "t", "a"]))
        n_texts += np.array([(~held).sum(), len(held)])
        if sum(map(len, parts)) >= flush:
            parts = summed_parts().to_batches()
            if sum(map(len, parts)) >= flush * 3 // 4:
                yield from pa.Table.from_batches(parts).to_batches(ROWS)
                parts = []
    parts.append(pa.record_batch([pa.array([END], pa.binary()), *(pa.array([int(x)], pa.int64()) for x in n_texts)], names=["w", "t", "a"]))
    yield from summed_parts().filter(pc.field("a") > 0).to_batches(ROWS)


def _cut_texts(symbols, size, at_once):
    """(which texts, their symbols) of blocks of some thousand words: few enough to stay in a core's cache; texts of like length together."""
    texts = np.split(symbols, np.cumsum(size)[:-1])
    order = np.argsort(size)
    ends = np.cumsum(size[order] + 1) // at_once
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1), len(size)]
    for i, j in zip(cuts, cuts[1:]):
        if j > i:
            yield order[i:j], [texts[k] for k in order[i:j]]


def _learnt_texts(batches, code, at_once=6_000):
    for _, held, _, size, words in _some_rows(batches):
        if held.any():
            size, words = size[~held], words.filter(pa.array(np.repeat(~held, size)))
        for _, symbols in _cut_texts(code.symbols(words), size, at_once):
            yield Texts(code, symbols, [True] * len(symbols))


def _fill_tables(batches, code, bits):
    """Counts of bits by hashed word before, then of symbols by class."""
    made = code.value
    hashed, by_class = np.full(2 << bits, 0, np.int32), np.zeros(CLASSES * len(made.length), np.int64)
    for texts in _learnt_texts(batches, made):
        np.add.at(by_class, texts.classes() * len(made.length) + texts.symbol, np.ones(len(texts.symbol), np.int64))
        _, token, step = texts.paths()
        slot = texts.hashed(token, step, bits).astype(np.int64)
        slot *= 2
        slot += step & 1
        np.add.at(hashed, slot, np.ones(len(slot), np.int32))
    yield from _packed(hashed)
    yield from _packed(by_class, len(hashed))


def _fit_texts(batches, code, tables):
    """Counts of all learnt texts' bits by cells of the grid."""
    counts = np.zeros(TEXT_GRID.size, np.int32)
    for texts in _learnt_texts(batches, code.value):
        cells = texts.cells(tables.value).astype(np.int64)
        np.add.at(counts, cells, np.ones(len(cells), np.int32))
    yield from _packed(counts)


# -- spelling --------------------------------------------------------------------------

SPELL_INPUTS, SPELL_GATES = 4, 16
SPELL_GRID = Grid(SPELL_GATES, (16,) * SPELL_INPUTS, (9.5,) * SPELL_INPUTS)
SPELL_CELLS = [_cells_of(SPELL_GRID, i, gates) for i, gates in enumerate((0, 0, 4, 1))]


class Spelled:
    """The bytes of many words one after the other, each closed by a blank, with their contexts and codes."""

    def __init__(self, words: list, code: tuple[np.ndarray, np.ndarray]):
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.bytes = np.frombuffer(b"".join(w + b" " for w in words), np.uint8).astype(np.int64)
        n = len(self.bytes)
        self.row = np.repeat(np.arange(len(words)), size)
        self.starts = np.cumsum(size) - size
        b, pos = self.bytes, np.arange(n) - self.starts[self.row]

        def back(k):
            out = np.zeros(n, np.int64)
            out[k:] = b[:-k] + 1 if k < n else 0
            out[pos < k] = 0
            return out

        p1, p2, p3 = back(1), back(2), back(3)
        # a hash of the word so far: sums of byte times power, taken from the word's start
        power = np.ones(int(pos.max(initial=0)) + 2, np.uint64)
        np.multiply.accumulate(np.full(len(power) - 1, _M3), out=power[1:])
        total = np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[pos])
        before = np.concatenate([np.zeros(1, np.uint64), total[:-1]])
        so_far = before - before[self.starts][self.row] if n else before[:0]
        contexts = [p1, p1 | p2 << 9 | 1 << 40, p1 | p2 << 9 | p3 << 18 | 2 << 40, so_far ^ np.uint64(3 << 40)]
        self.contexts = [(c.astype(np.uint64) * _M1 >> np.uint64(32)).astype(np.uint32) for c in contexts]
        self.code, self.length = code[0][b], code[1][b]

    def planes(self, bits: int):
        """For each place of the bytes' codes: which bytes have a bit there, the slots by context, and the bit."""
        for k in range(int(self.length.max(initial=0))):
            at = np.flatnonzero(self.length > k)
            left = self.length[at] - k
            own = self.code[at]
            node = (((own >> left) | (1 << k)).astype(np.uint64) * _M2 >> np.uint64(32)).astype(np.uint32)
            yield at, [_slots(c[at], node, bits).astype(np.int64) for c in self.contexts], (own >> (left - 1)) & 1


def _blocks(batches, learnt_only, at_most=1 << 16):
    """Words (w, t, m) as (words, t, m), some ten thousand bytes at a time; m: how often a word counts as spelled."""
    for batch in batches:
        words = as_bytes(batch.column(0))
        t, m = (np.asarray(batch.column(k)).astype(np.int64) for k in (1, 2))
        if learnt_only:
            at = np.flatnonzero(m > 0)
            words, t, m = [words[i] for i in at], t[at], m[at]
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) // at_most
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1), len(words)]
        for i, j in zip(cuts, cuts[1:]):
            if j > i:
                yield words[i:j], t[i:j], m[i:j]


def _count_bytes(batches):
    counts = np.zeros(256)
    for words, _, m in _blocks(batches, True):
        size = np.fromiter(map(len, words), np.int64, len(words))
        counts += np.bincount(np.frombuffer(b"".join(words), np.uint8), np.repeat(m, size).astype(float), 256)
        counts[32] += m.sum()
    yield from _packed(counts.astype(np.int64))


def _count_spelling(batches, code, bits):
    table = np.zeros(SPELL_INPUTS * (2 << bits), np.int64)
    for words, _, m in _blocks(batches, True):
        spelled = Spelled(words, code)
        weight = m[spelled.row]
        for at, slots, bit in spelled.planes(bits):
            for i, s in enumerate(slots):
                np.add.at(table, (s + (i << bits)) * 2 + bit, weight[at])
    yield from _packed(table)


def _spelled_forms(tables, slots, bit, own, bits):
    """Places in SIGNED by context."""
    form = (own * 2 + bit) << 16
    return [form + tables.take(s + (i << bits), mode="clip") for i, s in enumerate(slots)]


def _fit_spelling(batches, code, tables, bits):
    counts = np.zeros(SPELL_GRID.size, np.int64)
    for words, _, m in _blocks(batches, True):
        spelled = Spelled(words, code)
        weight = m[spelled.row]
        for at, slots, bit in spelled.planes(bits):
            cells = bit.copy()
            for cells_of, form in zip(SPELL_CELLS, _spelled_forms(tables.value, slots, bit, 1, bits)):
                cells += cells_of.take(form, mode="clip")
            np.add.at(counts, cells, weight[at])
    yield from _packed(counts)


def spelling_costs(words: list, own: np.ndarray, code, tables, mixer: Mixer, params: MixingParams) -> np.ndarray:
    """log10 of the probability of each byte of the words; ``own``: by word, whether it was learnt from."""
    spelled = Spelled(words, code)
    out, own, refinement = np.zeros(len(spelled.bytes)), own[spelled.row], mixer.refinement(params.refine)
    for at, slots, bit in spelled.planes(params.spell_bits):
        forms = _spelled_forms(tables, slots, bit, own[at], params.spell_bits)
        gate = EVIDENCES.take(forms[2], mode="clip").astype(np.int64) * 4 + EVIDENCES.take(forms[3], mode="clip")
        mixed = np.zeros(len(at), np.float32)
        for w, form in zip(mixer.weights.T, forms):
            mixed += w.take(gate, mode="clip") * SIGNED.take(form, mode="clip")
        np.clip(mixed, -FAR, FAR, out=mixed)
        double, place = (bit * 4 - 2).astype(np.float32), (bit * SPELL_GATES + gate) * BUCKETS
        out[at] += _signed_logs(mixed, double, place, refinement, params.refine)[0]
    return out / math.log(10)


def _cost_words(batches, code, tables, mixer, params):
    for words, t, m in _blocks(batches, False):
        cost = spelling_costs(words, (m > 0).astype(np.int64), code, tables.value, mixer, params)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        yield pa.record_batch([pa.array(words, pa.binary()), pa.array(t), pa.array(np.add.reduceat(cost, np.cumsum(size) - size))], names=["w", "c", "cost"])


# -- texts -----------------------------------------------------------------------------

#: Rows handed on at once.
ROWS = 10_000
OWN = pa.schema([("row", pa.int64()), ("prev", pa.int64()), ("w", pa.binary()), ("n", pa.int64()), ("n_prev", pa.int64()), ("n_w", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_bytes", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("cost", pa.float64())])


def _rare_pairs(row, words):
    """(row, prev, w, n, n_prev, n_w) of the rare words of texts, one after the other; ``row``: the text's number, by word."""
    kinds = words.dictionary_encode()
    of, n_kinds = kinds.indices.to_numpy().astype(np.int64), len(kinds.dictionary)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) >> 1 for w in kinds.dictionary.to_pylist()], np.int64)
    new = np.concatenate([[True], row[1:] != row[:-1]])
    text = np.cumsum(new) - 1
    # the first one follows none
    before = np.where(new, n_kinds, np.concatenate([of[:1], of[:-1]]))
    key, at, n = np.unique((text * (n_kinds + 1) + before) * n_kinds + of, return_index=True, return_counts=True)
    starts = np.flatnonzero(np.diff(key // n_kinds, prepend=-1))
    n_prev = np.repeat(np.add.reduceat(n, starts), np.diff(starts, append=len(key)))
    in_text, n_in_text = np.unique(text * n_kinds + of, return_counts=True)
    n_w = n_in_text[np.searchsorted(in_text, text[at] * n_kinds + of[at])]
    # a number that is no hash of a word, another for each text
    prev = np.where(new[at], -1 - row[at], hashes[before[at] % n_kinds])
    return row[at], prev, kinds.dictionary.take(pa.array(of[at])), n, n_prev, n_w


def _own_rows(n_rows, **columns):
    return pa.record_batch([pa.nulls(n_rows, f.type) if f.name not in columns else pa.array(columns[f.name], f.type) for f in OWN], schema=OWN)


def _score_texts(batches, code, tables, mixer, known, params, at_once=6_000):
    """For each text a row with what the head gives, then its rare words after each other, one row for each pair."""
    made, row = code.value, TaskContext.get().partitionId() << 33
    base_of = known.value
    for ids, held, n_bytes, size, words in _some_rows(batches):
        rows = row + 1 + np.arange(len(size))
        row += len(size)
        symbols = made.symbols(words)
        for at, of_text in _cut_texts(symbols, size, at_once):
            texts = Texts(made, of_text, ~held[at])
            cost = np.add.reduceat(texts.costs(tables.value, mixer, params), texts.first)
            in_head = texts.symbol != made.escape
            n_known = np.add.reduceat(in_head.astype(np.int64), texts.first)
            base = np.add.reduceat(np.where(in_head, base_of[texts.symbol], 0.0), texts.first)
            # a text's own row follows a word that no text has, another for each
            yield _own_rows(len(at), row=rows[at], prev=-1 - rows[at], n=size[at] + 1, doc_id=[ids[k] for k in at], held_out=held[at], n_bytes=n_bytes[at], n_known=n_known, base=base, cost=cost)
        rare = symbols == made.escape
        if rare.any():
            of, prev, w, n, n_prev, n_w = _rare_pairs(np.repeat(rows, size)[rare], words.filter(pa.array(rare)))
            pairs = _own_rows(len(of), row=of, prev=prev, w=w, n=n, n_prev=n_prev, n_w=n_w, held_out=held[of - rows[0]])
            yield from pa.Table.from_batches([pairs]).to_batches(ROWS)


def rare_costs(scored: DataFrame, costs: DataFrame, n_rare: int, n_once: int, trust: float) -> DataFrame:
    """Adds to the rare words' rows c (their count) and their cost, by what other documents have."""
    learnt = F.when(F.col("held_out"), 0).otherwise(1)
    # both windows over rows in the same order, which are sorted once
    by_prev = Window.partitionBy("prev").orderBy("w").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_pair = Window.partitionBy("prev", "w")
    n = F.when(F.col("w").isNotNull(), F.col("n") * learnt)
    counted = scored.withColumn("seen_prev", F.sum(n).over(by_prev)).withColumn("seen_pair", F.sum(n).over(by_pair))
    joined = counted.join(costs.select("w", "c", "spelled"), "w", "left")
    others = lambda all_, own: (F.col(all_) - F.col(own) * learnt).cast("double")
    new = min(max(n_once / max(n_rare, 1), 0.01), 0.99)
    known = others("c", "n_w") / max(n_rare, 1)
    p = F.lit(1 - new) * known + F.lit(new) * F.pow(F.lit(10.0), F.greatest("spelled", F.lit(-300.0)))
    prev, pair = others("seen_prev", "n_prev"), others("seen_pair", "n")
    p = F.when(prev > 0, F.lit(trust) * pair / prev + F.lit(1 - trust) * p).otherwise(p)
    # a word too long for a probability of its own: its spelling alone
    rare = F.when(p > 1e-290, F.log10(p)).otherwise(F.col("spelled") + math.log10(new * (1 - trust)))
    return joined.withColumn("rare", F.when(F.col("w").isNotNull(), F.col("n") * rare))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: MixingParams = MixingParams()) -> DataFrame:
    """Learns from the documents that are not held out and scores all.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (of the
    smoothed word counts), score (log10 probability of the text) and bits_per_byte.
    """
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    _, together = summed(texts.mapInArrow(_count_together, PIECES), SLOTS * SLOTS)
    of_slot = cluster(together.reshape(SLOTS, SLOTS).astype(float))
    counted = texts.mapInArrow(lambda it: _count_words(it, params.flush), "w binary, t long, a long")
    vocab = cut(counted.groupBy("w").agg(F.sum("t").alias("t"), F.sum("a").alias("a")))
    is_end = F.col("w") == F.lit(END)
    n_words, n_kinds, n_ends = vocab.select(F.sum("t"), F.count_if(F.col("t") > 0), F.sum(F.when(is_end, F.col("t")))).first()
    n_words, n_ends = n_words or 0, n_ends or 0

    # the head: all words at least as frequent as a threshold that at most ``head`` words reach
    least, so_far = 1 << 62, 0
    short = vocab.filter((F.length("w") <= params.head_bytes) & ~is_end)
    for t, n in sorted(((r[0], r[1]) for r in short.filter("t > 1").groupBy(F.least("t", F.lit(100_000)).alias("t")).count().collect()), reverse=True):
        if (so_far := so_far + n) > params.head:
            break
        least = t
    rows = short.filter(F.col("t") >= least).select("w", "t").toArrow().sort_by("w")
    counts = rows.column("t").to_numpy()
    n_rare = int(n_words - n_ends - counts.sum())
    made = Code(rows.column("w").to_pylist(), np.concatenate([counts, [n_ends, n_rare]]).astype(np.int64), of_slot)
    code = sc.broadcast(made)

    # the tables of word contexts: of fixed size, so the driver can hand them to all tasks
    size = max(PIECE, 2 << params.table_bits)
    by_word, by_class = summed(texts.mapInArrow(lambda it: _fill_tables(it, code, params.table_bits), PIECES), size + CLASSES * len(made.length), size)
    odds, by_class = made.counted(by_class.reshape(CLASSES, -1))
    tables = sc.broadcast(Tables(odds, by_class, by_word, params.table_bits))
    mixer = fitted(Mixer(GATES, INPUTS), TEXT_GRID, summed(texts.mapInArrow(lambda it: _fit_texts(it, code, tables), PIECES), TEXT_GRID.size)[1])

    # rare words, spelled; those of the head count once each, as words of the language
    in_head = (F.col("t") >= least) & (F.length("w") <= params.head_bytes)
    spelled = vocab.filter(~is_end).select("w", "t", F.when(in_head, 1).otherwise(F.col("t")).alias("m"), in_head.alias("in_head"))
    _, seen = summed(spelled.mapInArrow(_count_bytes, PIECES), 256)
    letters = huffman(seen)
    size = SPELL_INPUTS * (2 << params.spell_bits)
    spelling = sc.broadcast(summed(spelled.mapInArrow(lambda it: _count_spelling(it, letters, params.spell_bits), PIECES), size, size)[0])
    rest = spelled.filter("not in_head")
    n_once = vocab.filter("t = 1").count()
    speller = fitted(Mixer(SPELL_GATES, SPELL_INPUTS), SPELL_GRID, summed(rest.mapInArrow(lambda it: _fit_spelling(it, letters, spelling, params.spell_bits), PIECES), SPELL_GRID.size)[1])
    costs = rest.mapInArrow(lambda it: _cost_words(it, letters, spelling, speller, params), "w binary, c long, spelled double")

    base_of = sc.broadcast(np.log10(np.concatenate([counts, [n_ends, 0]]) + 0.5))
    scored = texts.mapInArrow(lambda it: _score_texts(it, code, tables, mixer, base_of, params), "row long, prev long, w binary, n long, n_prev long, n_w long, doc_id long, held_out boolean, n_bytes long, n_known long, base double, cost double")
    joined = rare_costs(scored, costs, n_rare, n_once, params.trust)
    own = F.col("n_bytes").isNotNull()
    total = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max(F.when(own, F.col("n"))).alias("n_tokens"),
        F.sum(F.when(own, F.col("n_known")).otherwise(F.when(F.col("c") > 0, F.col("n")).otherwise(0))).alias("n_known"),
        F.max("n_bytes").alias("n_bytes"),
        F.sum(F.when(own, F.col("base")).otherwise(F.col("n") * F.log10(F.col("c") + 0.5))).alias("base"),
        F.sum(F.when(own, F.col("cost")).otherwise(F.col("rare"))).alias("score"),
    )
    scale = math.log10(n_words + 0.5 * ((n_kinds or 0) + 1))
    return total.select(
        "doc_id",
        "held_out",
        "n_tokens",
        # with no training text, the end mark is as unknown as any word
        (F.col("n_known") - F.lit(0 if n_ends else 1)).alias("n_known"),
        F.lit(n_words).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        "score",
        (-F.col("score") / math.log10(2) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
