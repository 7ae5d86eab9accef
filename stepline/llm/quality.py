"""Quality rules as weak supervision.

Each rule looks at a document's statistics and votes good (1) or bad (0), or abstains.
Expectation-maximisation estimates, without labels, how often each rule votes what in
either class, and how many documents are good; Bayes' rule then gives each document's
probability of being good.  A document is kept if that is at least ``least``, so no single
rule decides.

How it runs.  Documents stay in place; statistics come from whole texts.  All that
EM needs are the numbers of documents by pattern of votes: with R rules at most 3 ** R
patterns, whatever the number of documents, so Spark counts them and the driver iterates on
the counts.  Each pattern's posterior goes back to the documents by a join.

Cases: a null or empty text has no words and fails the base rule; blank lines are never
duplicates; if no rule votes on a document its posterior is the share of good documents;
repeated rows count as often as they stand; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepline.llm.common import as_bytes, cut

SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_stop long, n_distinct long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
#: Frequent short words of the languages at hand.
STOP = frozenset(w.encode() for w in "the of and to in a is that it for on was be with as by de la que le les des et en un une el los las der die und das den von zu mit".split())


def statistics(text: bytes) -> tuple:
    words = text.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, (bytes([c]) for c in SPACE)))
    if not text.isascii():
        chars -= len(text) - len(text.decode())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    distinct = set(words)
    repeated = 0
    if n >= 4:
        number = dict(zip(distinct, range(len(distinct))))
        ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
        m = len(distinct)
        pair = ids[:-2] * m + ids[1:-1]
        if m > 2_000_000:  # three numbers would not fit
            pair = np.unique(pair, return_inverse=True)[1]
        _, which, often = np.unique(pair * m + ids[2:], return_inverse=True, return_counts=True)
        again = often[which] > 1
        if again.any():
            mark = np.zeros(n, bool)
            for k in range(3):
                mark[k : n - 2 + k] |= again
            repeated = int(mark.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), sum(map(STOP.__contains__, (w.lower() for w in words))), len(distinct)


def _statistics(batches):
    for batch in batches:
        rows = [statistics(x) for x in as_bytes(batch.column(1))]
        columns = list(zip(*rows)) or [()] * 8
        yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=NAMES)


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_statistics, SCHEMA)


def _vote(bad: Column, good: Column | None = None) -> Column:
    return F.when(bad, 0) if good is None else F.when(bad, 0).when(good, 1)


def rules() -> dict[str, Column]:
    """Each rule's vote: 0 bad, 1 good, null abstains.

    A rule votes good only on what speaks for prose; that a text is long enough, or does not
    repeat itself, holds for much that is bad, so there the rules abstain.
    """
    c = F.col
    words = F.greatest(c("n_words"), F.lit(1))
    return {
        "length": _vote(c("n_words") < 50),
        "word_length": _vote((c("word_chars") < 2 * words) | (c("word_chars") > 15 * words)),
        "symbols": _vote(10 * c("n_symbols") > 3 * words, 100 * c("n_symbols") <= 2 * words),
        "lines": _vote(10 * c("n_dup_lines") > 3 * F.greatest(c("n_lines"), F.lit(1))),
        "repeats": _vote(100 * c("n_repeat_words") > 30 * words),
        "stop_words": _vote(100 * c("n_stop") < 3 * words, 100 * c("n_stop") >= 5 * words),
        "variety": _vote(10 * c("n_distinct") < 2 * words),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def em(votes: np.ndarray, counts: np.ndarray, rounds: int = 100, prior: float = 0.8, accuracy: float = 0.8, strength: float = 10.0, least: float = 0.02) -> tuple[np.ndarray, float, np.ndarray]:
    """Posterior of each pattern, share of good documents, and by (class, rule, vote) how often a class gets it.

    ``votes``: (patterns, rules) of 0, 1, and 2 for abstaining.  The start says that each
    rule is right with probability ``accuracy`` when it votes; ``strength`` is the number
    of documents that this start counts for, so a rule that hardly votes stays near it.
    A rule is held to be right more often than wrong, so classes can't swap, and no vote to
    be rarer in a class than ``least``, so one odd vote alone does not settle a document.
    """
    n_rules = votes.shape[1]
    hot = np.stack([votes == k for k in range(3)], 2).astype(float)
    abstain = np.clip((hot[:, :, 2] * counts[:, None]).sum(0) / max(counts.sum(), 1), 0.01, 0.98)
    start = np.empty((2, n_rules, 3))
    for y in (0, 1):
        start[y, :, y], start[y, :, 1 - y] = accuracy * (1 - abstain), (1 - accuracy) * (1 - abstain)
        start[y, :, 2] = abstain
    table, good = start.copy(), prior
    posterior = np.full(len(votes), prior)
    for _ in range(rounds):
        log = np.einsum("prk,yrk->py", hot, np.log(table)) + np.log([1 - good, good])
        top = log - log.max(1, keepdims=True)
        posterior = np.exp(top[:, 1]) / np.exp(top).sum(1)
        for y, p in ((0, 1 - posterior), (1, posterior)):
            seen = np.einsum("p,prk->rk", p * counts, hot) + strength * start[y]
            table[y] = seen / seen.sum(1, keepdims=True)
        table = np.clip(table, least, 1)
        # a good vote must not be likelier from bad documents than from good ones, nor the other way round
        for k in (0, 1):
            mean = table[:, :, k].mean(0)
            wrong = table[1 - k, :, k] > table[k, :, k]
            table[:, wrong, k] = mean[wrong]
        good = float(np.clip(((posterior * counts).sum() + strength * prior) / (counts.sum() + strength), 0.01, 0.99))
    return posterior, good, table


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row a document: its statistics, base_failed, p_good (posterior) and kept."""
    voting = rules()
    pattern = F.concat(*[F.coalesce(v.cast("string"), F.lit("2")) for v in voting.values()])
    stats = cut(with_statistics(docs, id_col, text_col).withColumn("votes", pattern).withColumn("base_failed", base_failed()))
    # at most 3 ** 7 rows
    counted = sorted((r[0], r[1]) for r in stats.groupBy("votes").count().collect())
    if not counted:
        return stats.select("*", F.lit(None).cast("double").alias("p_good"), F.lit(False).alias("kept"))
    votes = np.array([[int(x) for x in p] for p, _ in counted])
    posterior, _, _ = em(votes, np.array([n for _, n in counted], float))
    by_pattern = docs.sparkSession.createDataFrame([(p, float(x)) for (p, _), x in zip(counted, posterior)], "votes string, p_good double")
    return stats.join(F.broadcast(by_pattern), "votes").withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))
