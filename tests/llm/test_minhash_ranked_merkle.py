"""Brute force beside operators 11 to 13, and their odd cases."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepline.llm import merkle, minhash, queries, ranked

from oracle import compare, connect

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, leaf string, node long"
LONG = "the quick brown fox jumps over the lazy dog while nobody looks at it today "
ODD = [
    (0, LONG * 3, "en", "a", 1),
    (0, LONG * 3, "en", "a", 1),
    (0, "another text that has the same id as the one before it", "en", "a", 2),
    (1, None, None, None, None),
    (2, "", "en", "b", 0),
    (3, " \t\n\x0b\x0c\r ", "en", "b", 7),
    (4, "É Ünïcode kept whole WORD word Word", "fr", "a", 30),
    (5, "x" * 30_000, "en", "c", 30_000),
    (None, "no id here at all", "en", None, 17),
    (None, "No ID here at all", None, None, 17),
    (6, "long " * 40_000, "de", "a", 200_000),
    (7, "two words", "de", "a", 9),
    (8, "TWO words", "de", "a", 9),
    (9, "---- ... !!", "", "a", 9),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0, "x", 1) for r in ODD], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows(df):
    return [tuple(r) for r in df.collect()]


def in_order(found):
    return sorted(found, key=lambda r: [(x is None, x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", ["op4_shard", "op11_minhash", "op12_ranked_search", "op13_merkle"])
def test_query_equals_its_sql(spark, sf, name):
    assert compare(queries.QUERIES[name](spark, sf), queries.ORACLES[name], connect(sf)) > 0


# -- 11 -----------------------------------------------------------------------------------


def linked_by_hand(pairs, percent=80, shingle=4):
    sets = []
    for _, text in pairs:
        words = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set())
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(pairs):
        ids = [pairs[j][0] for j in range(len(pairs)) if find(j) == find(i) and pairs[j][0] is not None]
        component = min(ids, default=None)
        out.append((doc, len(sets[i]), component, doc == component))
    return in_order(out)


def test_near_duplicates_equal_brute_force(docs, odd, empty):
    for df in (docs, odd):
        assert in_order(rows(minhash.near_duplicates(df))) == linked_by_hand(rows(df.select("doc_id", "text")))
    assert rows(minhash.near_duplicates(empty)) == []


def copies(n, words, changed, seed, start=0):
    """n texts of random words, each with some of the first one's words changed."""
    rng = np.random.default_rng(seed)
    base = [f"w{seed}x{k}" for k in rng.integers(0, 10**6, words)]
    out = [(start, " ".join(base))]
    for i in range(1, n):
        text = list(base)
        for at in rng.choice(words, changed, replace=False):
            text[at] = f"c{rng.integers(10**9)}"
        out.append((start + i, " ".join(text)))
    return out


def test_large_groups_in_small_blocks_lose_no_link(spark):
    # copies of 200 words with 5 changed are at about 0.82 of the first and 0.67 of one another; with 9 they are linked with none
    made = copies(60, 200, 5, 1) + copies(40, 200, 9, 2, 1000) + copies(50, 300, 2, 3, 2000) + [(5000 + i, "one two three four five six") for i in range(30)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    assert in_order(rows(minhash.near_duplicates(df, block=8))) == linked_by_hand(made)


def test_boundary_is_exact(spark):
    # five shingles against four of them: 4 of 5 shared; six against four of them: below
    made = [(1, "a b c d e f g h"), (2, "a b c d e f g"), (3, "q w e r t y u i o"), (4, "q w e r t y u")]
    assert [r[2] for r in in_order(rows(minhash.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"))))] == [1, 1, 3, 4]
    assert linked_by_hand(made)[1][2] == 1 and linked_by_hand(made)[3][2] == 4


def test_signatures_under_the_distance_share_a_key():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << minhash.BITS, (300, minhash.CHUNKS, minhash.POSITIONS)).astype(np.uint64)
    most = (minhash.ERRORS + 1) * minhash.CHUNKS - 1
    for x in a:
        y = x.copy().ravel()
        at = rng.choice(y.size, most, replace=False)
        y[at] ^= np.uint64(1) << rng.integers(0, minhash.BITS, most).astype(np.uint64)
        both = np.intersect1d(minhash.keys(x[None]), minhash.keys(y.reshape(1, *x.shape)))
        assert len(both)
    assert len(np.intersect1d(minhash.keys(a[:1]), minhash.keys(a[1:]))) == 0


def test_signature_positions_differ_as_sets_do():
    rng = np.random.default_rng(6)
    far, apart = [], []
    for _ in range(60):
        shared = rng.integers(0, 1 << 63, 400).astype(np.uint64)
        a, b = (np.concatenate([shared, rng.integers(0, 1 << 63, 50).astype(np.uint64)]) for _ in range(2))
        x, y = minhash.minima(a), minhash.minima(b)
        apart.append((minhash.signature(x) != minhash.signature(y)).mean())
        far.append(int(np.bitwise_count((minhash.far_bits(x) ^ minhash.far_bits(y)).view(np.uint64))))
    assert abs(np.mean(apart) - 0.2) < 0.03 and abs(np.mean(far) - 6.4) < 1.5 and max(far) <= minhash.FAR_BITS


# -- 12 -----------------------------------------------------------------------------------


def ranked_by_hand(pairs, items, k=50):
    found = [(doc, TERM.findall((text or "").translate(LOWER))) for doc, text in pairs]
    found = [(doc, Counter(ts)) for doc, ts in found if ts]
    n_docs, n_terms = len(found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, ts in wanted.items():
        scores = []
        for doc, counts in found:
            m = 100 - 50 + (50 * counts.total() * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 20 * m)) for t in ts if counts[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, n + 1, doc, -minus) for n, (minus, _, _, doc) in enumerate(sorted(scores)[:k])]
    return in_order(out)


ITEMS = "item_id long, text string, rank int"


@pytest.fixture(scope="module")
def items(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet")


def test_search_equals_brute_force(spark, docs, items):
    want = ranked_by_hand(rows(docs.select("doc_id", "text")), rows(items.select("item_id", "text")))
    assert in_order(rows(ranked.search(docs, items))) == want
    # neither the sketch's width, nor the blocks of items, nor the dealing of documents shows
    assert in_order(rows(ranked.search(docs.repartition(7), items, coordinates=7, block_chars=500))) == want


def test_search_of_odd_rows(spark, odd, empty):
    wanted = spark.createDataFrame([(1, "Long WORD", 0), (1, "here id", 0), (2, None, 0), (3, "", 0), (None, "two words", 0), (4, "notinanydocument", 0), (5, "text that has the same id as the quick", 0)], ITEMS)
    for k in (50, 1):
        assert in_order(rows(ranked.search(odd, wanted, k=k))) == ranked_by_hand(rows(odd.select("doc_id", "text")), rows(wanted.select("item_id", "text")), k)
    assert rows(ranked.search(empty, wanted)) == [] and rows(ranked.search(odd, wanted.limit(0))) == []


def test_bounds_hold_and_few_documents_are_scored():
    rng = np.random.default_rng(4)
    words = [b"w%d" % k for k in range(3000)]
    odds = 1 / np.arange(1, 3001)
    docs = [Counter(rng.choice(words, 120, p=odds / odds.sum()).tolist()) for _ in range(3000)]
    items = [(k, sorted(set(rng.choice(words, 12, p=odds / odds.sum()).tolist()))) for k in range(20)]
    vocabulary = sorted({t for _, ts in items for t in ts})
    df = {k: n for k, t in enumerate(vocabulary) if (n := sum(t in c for c in docs))}
    lookup = ranked.Lookup(items, len(docs), 120 * len(docs), df, ranked.COORDINATES)
    best = ranked.Best(lookup, 10)
    for a in range(0, 3000, 256):
        part = docs[a : a + 256]
        norms = [ranked.length_norm(120, len(docs), 120 * len(docs))] * len(part)
        bounds = lookup.bounds(lookup.sketch(part, norms))
        for item in range(20):
            assert all(bounds[item, d] >= lookup.score(item, c, norms[d]) for d, c in enumerate(part))
        best.add(list(range(a, a + len(part))), part)
    assert best.scored < 0.2 * 20 * len(docs)


# -- 13 -----------------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_by_hand(nodes, fanout=8):
    """(last node, siblings of each by level as (left, right))."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for i, path in enumerate(paths):
            run, slot = runs[at[i] // fanout], at[i] % fanout
            path.append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            at[i] //= fanout
        nodes = [H(*run) for run in runs]
    return nodes[0], paths


def manifest_by_hand(leaves, fanout=8):
    groups = {}
    for lang, doc, leaf in leaves:
        groups.setdefault(lang, []).append(((doc is not None, doc or 0), leaf, doc))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree_by_hand([leaf for _, leaf, _ in sorted(groups[g])], fanout) for g in names]
    root, above = tree_by_hand([subroot for subroot, _ in trees], fanout)
    out = []
    for g, (subroot, paths), upper in zip(names, trees, above):
        for (_, leaf, doc), path in zip(sorted(groups[g]), paths):
            out.append((doc, leaf, subroot, root, H(*[x for p in path + upper for x in p])))
    return in_order(out)


def leaf_by_hand(*values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


@pytest.mark.parametrize("fanout", [8, 2, 3])
def test_manifest_equals_brute_force(docs, odd, empty, fanout):
    for df in (docs, odd, docs.filter("lang = 'en'"), docs.filter("doc_id = 5"), docs.filter("doc_id < 9")):
        leaves = df.select("lang", "doc_id", "text", merkle.leaf(F.col("doc_id"), F.col("text")).alias("leaf"), F.lit(2).alias("g"))
        found = merkle.manifest(leaves, "lang", "doc_id", fanout=fanout)
        want = manifest_by_hand([(r.lang, r.doc_id, leaf_by_hand(r.doc_id, r.text)) for r in df.collect()], fanout)
        assert in_order(rows(found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256)))) == want
        # each leaf's path leads to the root, and another leaf's does not
        assert found.filter(merkle.folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
        assert found.filter(merkle.folded(F.sha2("leaf", 256), F.col("path")) == F.col("root")).count() == 0
    assert rows(merkle.manifest(empty.select("lang", "doc_id", "leaf"), "lang", "doc_id")) == []


def test_manifest_stays_on_the_jvm(docs):
    plan = merkle.manifest(docs.select("lang", "doc_id", F.sha2("text", 256).alias("leaf")), "lang", "doc_id")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
