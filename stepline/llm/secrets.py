"""Secret scans: fixed patterns, and passwords by their guessing cost.

The patterns find assignments of long values, access keys and hex strings.  The method
adds values in a credential context (a word such as password, then ``:`` or ``=``) that
would take many guesses: dynamic programming finds the cheapest way to put a value
together from dictionary words, dates, repeats, keyboard walks and spans to be tried by
brute force; the product of the parts' guesses, times an ordering factor, is its cost.
A value that costs more guesses than ``least_log10`` says is reported.

The dictionary is the fixed words below and the documents' own words: those of at least
``LEAST_DOCS`` documents, ranked by how many hold them, at most ``MOST_WORDS``, broadcast.
Besides those counts nothing is shuffled; a document's spans come from its whole text.

Cases: a null text is empty; an empty or blank text has no spans; a repeated value is
reported at each place; a value is costed whole, however long and of however many parts (beyond 500 characters, whether it is reported is exact, and the guesses told are those of a good segmentation); overlapping spans of different kinds are all kept; repeated rows give repeated rows; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepline.llm.common import as_text

#: Kinds in the order that breaks ties of position; the last is the method's own.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: A credential context and its value: in quotes up to the same quote on the line, or else up to white space.
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|private[_-]?key|credential)s?["']?[\x20\t]*[:=][\x20\t]*(?:"([^"\n]{4,})"|'([^'\n]{4,})'|([^\s"',;<>]{4,}))""", re.I | re.A)
LEAST_LOG10 = 10.0
#: Characters of a value whose cost a task remembers, and how many such values.
REMEMBERED, MOST_REMEMBERED = 100, 100_000
#: Characters up to which a value's least guesses are always searched for.
EXACT = 500
LEAST_DOCS, MOST_WORDS = 5, 1 << 17
#: A word of the documents: letters only, with no letter, digit or underscore beside them.
PROSE = r"(?<![\p{L}\p{N}_])\p{L}{3,24}(?![\p{L}\p{N}_])"

#: Common words of passwords and of prose, the more frequent first.  A word's guesses are its rank.
WORDS = """password love admin welcome monkey dragon master login secret hello summer winter spring autumn
sunshine princess football baseball shadow michael jordan letmein change test user guest root access
token key pass word the and of to in is that it for on was with as be by this an at not you are or from
house river stone green blue red black white horse battery staple correct apple orange banana cat dog
bird fish tree star moon sun day night time year money work home car blood fire water earth wind""".split()
RANK = {w: i + 1 for i, w in reversed(list(enumerate(WORDS)))}
LONGEST_WORD = 24
#: Keys that lie side by side, as rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
#: Characters that stand in for letters.
LEET = str.maketrans("4@8310$57", "aabeiossi")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d")


def _neighbours() -> dict[str, set[str]]:
    """Keys next to each key: in its row, and one row down or up at most one place aside."""
    place = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
    return {c: {d for d, (s, j) in place.items() if d != c and abs(r - s) <= 1 and abs(i - j) <= 1} for c, (r, i) in place.items()}


NEAR = _neighbours()


def _brute(c: str) -> float:
    """log10 of the size of the alphabet that a character is from."""
    if c.isdigit():
        return 1.0
    if c.isalpha():
        return math.log10(26) if c.isascii() else 2.0
    return math.log10(33) if c.isascii() else 2.5


def word_ranks(texts: DataFrame) -> dict[str, int]:
    """Ranks of the fixed words and of the words of ``texts`` (column text)."""
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(PROSE), F.lit(0)))).alias("word"))
    counted = words.groupBy("word").count().filter(F.col("count") >= LEAST_DOCS).orderBy(F.desc("count"), "word").limit(MOST_WORDS)
    found = {r["word"]: i + 1 for i, r in enumerate(counted.select("word").collect())}
    return found | {w: min(r, found.get(w, r)) for w, r in RANK.items()}


def parts(value: str, ranks: dict[str, int] = RANK) -> list[tuple[int, int, str, float]]:
    """Candidate parts (start, end, kind, log10 of guesses) of a value; brute force is left out."""
    low, found, n = value.lower(), [], len(value)
    for text, more in ((low, 0.0), (low.translate(LEET), math.log10(4))):
        if more and text == low:
            continue
        for i in range(n):
            for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
                if (rank := ranks.get(text[i:j])) is not None:
                    upper = sum(x.isupper() for x in value[i:j])
                    case = 0.0 if not upper else math.log10(2) if upper in (1, j - i) else math.log10(sum(math.comb(j - i, k) for k in range(1, upper + 1)))
                    found.append((i, j, "word", math.log10(rank + 1) + case + more))
    for i in range(n):
        if (m := DATE.match(value, i)) and m.end() - i >= 4:
            size = m.end() - i
            # a year of 100, a month, a day, and four kinds of separator
            found.append((i, m.end(), "date", 2.0 + (math.log10(12) if size >= 6 else 0) + (math.log10(31) if size >= 8 else 0) + (math.log10(4) if re.search(r"[-/._]", m[0]) else 0)))
    # keyboard walks, as far as they go from each start
    end, turns = list(range(1, n + 1)), [0] * n
    for i in range(n - 2, -1, -1):
        if low[i + 1] in NEAR.get(low[i], ()):
            end[i] = end[i + 1]
            turns[i] = turns[i + 1] + (end[i] > i + 2 and ord(low[i + 1]) - ord(low[i]) != ord(low[i + 2]) - ord(low[i + 1]))
    for i in range(n - 3):
        if (size := end[i] - i) >= 4:
            found.append((i, end[i], "walk", math.log10(47 * size) + turns[i] * math.log10(6)))
    return found + [(i, j, "repeat", cost) for i, j, cost in repeats(value)]


def repeats(value: str) -> list[tuple[int, int, float]]:
    """(start, end, log10 of guesses) of what repeats a unit at least twice, from each start on as far as it goes.

    The unit, which is itself no repeat, costs brute force.  A unit of s characters shows as s or
    more characters in a row that equal those s further.  For long units not all places are
    looked at: such a stretch covers two neighbours of places s // 2 apart, with the eight
    characters after them.
    """
    n, out = len(value), []
    codes = np.array([ord(c) for c in value], np.int64)
    brute = np.concatenate([[0.0], np.cumsum([_brute(c) for c in value])])
    if n >= 64:
        eight = np.lib.stride_tricks.sliding_window_view(codes, 8) @ (np.int64(1_000_003) ** np.arange(8, dtype=np.int64))
    #: by unit size, the stretches (start, end) that repeat such a unit
    known: dict[int, list[tuple[int, int]]] = {}
    for size in range(1, n // 2 + 1):
        if size >= 16 and n >= 64:
            if not (eight[: -size : size // 2] == eight[size :: size // 2]).any():
                continue
        same = codes[:-size] == codes[size:]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
        for a, z in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if z - a < size or n < 3:
                continue
            # positions a to z + size repeat the unit; a shorter unit that divides it does as well, for less
            # stretches of a unit size come by their start, and so by their end: of those that start in time the last goes furthest
            if any(size % s == 0 and (at := bisect_right(spans, (a, math.inf))) and z + size <= spans[at - 1][1] for s, spans in known.items()):
                continue
            known.setdefault(size, []).append((a, z + size))
            for i in range(a, z - size + 1):
                k = (z + size - i) // size
                if k * size >= 3:
                    out.append((i, i + k * size, float(brute[i + size] - brute[i]) + math.log10(k)))
    return out


def _bound(n: int, ending: list[list], brute: list[float], more: float) -> tuple[float, float, int]:
    """(guesses of the segmentation that is the cheapest if each part costs ``more`` instead of the orders of all; what no segmentation is below; its parts).

    No segmentation into m parts costs less than the cheapest so priced, less ``more`` for each part, times m!; the
    least of that over all m is a bound for all.
    """
    best, tail = [(0.0, 0)], (math.inf, 0)
    for j in range(1, n + 1):
        c, m = min(tail, (best[j - 1][0] + more, best[j - 1][1] + 1))
        tail = (c + brute[j - 1], m)
        now = tail
        for i, _, cost in ending[j]:
            if (c := best[i][0] + cost + more) <= now[0]:
                now = min(now, (c, best[i][1] + 1))
        best.append(now)
    c, m = best[n]
    orders = lambda k: math.lgamma(k + 1) / math.log(10)
    # log10(m!) - more m falls while m is below 10 ** more
    turn = min(n, int(10**more))
    least = min(orders(k) - more * k for k in (max(1, turn - 1), max(1, turn), turn + 1))
    return c - more * m + orders(m), c + least, m


def _graph(value: str, ranks: dict[str, int]) -> tuple[list[list], list[list], list[float]]:
    """Parts by their end and by their start, and what each character costs by brute force."""
    ending: list[list] = [[] for _ in range(len(value) + 1)]
    starting: list[list] = [[] for _ in range(len(value) + 1)]
    for i, j, kind, cost in parts(value, ranks):
        ending[j].append((i, kind, cost))
        starting[i].append((j, cost))
    return ending, starting, [_brute(c) for c in value]


def guessed(value: str, ranks: dict[str, int] = RANK, least_log10: float = LEAST_LOG10) -> float:
    """log10 of the guesses of a value, which are at least ``least_log10`` exactly if the least guesses are.

    For values of up to ``EXACT`` characters it is the least itself.  For longer ones it is that of the best of a few segmentations; where
    these and a lower bound leave it open on which side of ``least_log10`` the least is, all segmentations are searched, which is quick, as
    only few parts can then matter.
    """
    if len(value) <= EXACT:
        return segment(value, ranks)[0]
    graph = _graph(value, ranks)
    ending, _, brute = graph
    known, floor, more = sum(brute), 0.0, 1.0
    for _ in range(3):
        found, bound, m = _bound(len(value), ending, brute, more)
        known, floor, more = min(known, found), max(floor, bound), math.log10(m + 1)
    if floor >= least_log10 or known < least_log10:
        return known
    return segment(value, ranks, graph, known)[0]


def segment(value: str, ranks: dict[str, int] = RANK, graph: tuple | None = None, known: float = math.inf) -> tuple[float, list[tuple[int, int, str]]]:
    """log10 of the least guesses, and the parts that take them.

    Among segmentations into m parts the guesses are the parts' product times m!, the
    orders in which parts may be put together.  So of the ways to make a beginning of the value, one is of no use if
    another costs no more in no more parts, nor is one that with the cheapest rest
    would cost more than a segmentation that is known.
    """
    n = len(value)
    if not n:
        return 0.0, []
    ending, starting, brute = graph or _graph(value, ranks)
    # the cheapest way on from each place, orders left aside
    rest = [0.0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = min([rest[i + 1] + brute[i], *(rest[j] + cost for j, cost in starting[i])])
    known = min(known, sum(brute))
    for more in (0.5, 1.0, 2.0):
        known = min(known, _bound(n, ending, brute, more)[0])
    orders = [0.0]
    # best[j]: {m: (cost, start of the last part, its kind)} of the first j characters in m parts;
    # tail: {m: (cost, start)} of those whose last part is brute force, which the next character may lengthen
    best: list[dict[int, tuple[float, int, str]]] = [{0: (0.0, 0, "")}]
    tail: dict[int, tuple[float, int]] = {}
    for j in range(1, n + 1):
        one = brute[j - 1]
        longer = {m: (c + one, i) for m, (c, i) in tail.items()}
        for m, (c, _, last) in best[j - 1].items():
            if last != "brute" and c + one < longer.get(m + 1, (math.inf,))[0]:
                longer[m + 1] = (c + one, j - 1)
        now: dict[int, tuple[float, int, str]] = {m: (c, i, "brute") for m, (c, i) in longer.items()}
        for i, kind, cost in ending[j]:
            for m, (c, _, _) in best[i].items():
                if (x := c + cost) <= now.get(m + 1, (math.inf,))[0]:
                    now[m + 1] = (x, i, kind)
        while len(orders) <= max(now, default=0):
            orders.append(orders[-1] + math.log10(len(orders)))
        kept, cheapest = {}, math.inf
        for m in sorted(now):
            c = now[m][0]
            if c < cheapest and c + rest[j] + orders[m] <= known + 1e-9:
                kept[m], cheapest = now[m], c
        best.append(kept)
        tail, cheapest = {}, math.inf
        for m in sorted(longer):
            c = longer[m][0]
            if c < cheapest and c + rest[j] + orders[m] <= known + 1e-9:
                tail[m], cheapest = longer[m], c
    total, m = min((c + orders[m], m) for m, (c, _, _) in best[n].items())
    out, j = [], n
    while j:
        _, i, kind = best[j][m]
        out.append((i, j, kind))
        j, m = i, m - 1
    return total, out[::-1]


def log10_guesses(value: str, ranks: dict[str, int] = RANK) -> float:
    """Cost of a value."""
    return segment(value, ranks)[0]


def _cost(ranks, least_log10):
    remembered = lru_cache(MOST_REMEMBERED)(lambda value: guessed(value, ranks, least_log10))
    return lambda value: remembered(value) if len(value) <= REMEMBERED else guessed(value, ranks, least_log10)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [(*m.span(), "hex") for m in HEX.finditer(text)]


def guess_spans(text: str, least_log10: float = LEAST_LOG10, cost_of=log10_guesses) -> list[tuple[int, int, str, float]]:
    """Spans of values in a credential context that cost at least 10 ** least_log10 guesses."""
    out = []
    for m in CONTEXT.finditer(text):
        k = m.lastindex
        if (cost := cost_of(m[k])) >= least_log10:
            out.append((*m.span(k), "guess", cost))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for a, z, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, max_log10_guesses double"


def _scan(batches, least_log10, ranks):
    cost_of = _cost(ranks.value, least_log10)
    for batch in batches:
        rows = []
        for i, text in zip(batch.column(0).to_pylist(), as_text(batch.column(1))):
            base = base_spans(text)
            own = guess_spans(text, least_log10, cost_of)
            n = [sum(k == kind for _, _, k in base) for kind in KINDS[:3]]
            rows.append((i, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + [x[:3] for x in own]), len(own), max((x[3] for x in own), default=None)))
        columns = list(zip(*rows)) or [()] * 8
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_log10: float = LEAST_LOG10) -> DataFrame:
    """One row a document: counts by kind, a digest of the patterns' spans, all spans, and the costliest value's guesses."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranks = docs.sparkSession.sparkContext.broadcast(word_ranks(texts))
    return texts.mapInArrow(lambda it: _scan(it, least_log10, ranks), SCHEMA)


def _redact(batches, column, mark, least_log10, ranks):
    cost_of = _cost(ranks.value, least_log10)
    for batch in batches:
        out = []
        for text in batch.column(column).to_pylist():
            if text:
                spans = sorted((a, z) for a, z, *_ in base_spans(text) + guess_spans(text, least_log10, cost_of))
                kept, at = [], 0
                for a, z in spans:
                    if a >= at:
                        kept += [text[at:a], mark]
                    at = max(at, z)
                text = "".join(kept) + text[at:]
            out.append(text)
        columns = list(batch.columns)
        columns[column] = pa.array(out, batch.schema.field(column).type)
        yield pa.record_batch(columns, schema=batch.schema)


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", least_log10: float = LEAST_LOG10) -> DataFrame:
    """The rows with each span, or run of overlapping spans, of their text replaced by ``mark``."""
    at = docs.columns.index(text_col)
    ranks = docs.sparkSession.sparkContext.broadcast(word_ranks(docs.select(F.col(text_col).alias("text"))))
    return docs.mapInArrow(lambda it: _redact(it, at, mark, least_log10, ranks), docs.schema)
