"""SimHash near-duplicates by Golay-code fuzzy hashing.

A text's fingerprint has 64 bits; texts link where at most 4 bits differ, and what links
reach is one component.  The fingerprint is cut into three segments P, Q, R of 22, 21 and 21
bits, each of which, padded with zeros, is a word of the 23-bit Golay code.  For
errors (p, q, r) with p + q + r <= 4, in whatever order,

* either one segment has none: an exact key of each segment finds the pair;
* or all three have some, and then two of them have exactly one each: a key of both
  segments' nearby codewords finds it.  One side gives its nearest codewords, the other all
  that are near (``stepline.llm.golay`` says why one side's single key is enough).  As one
  error changes the parity of a segment's bits, the side whose first segment is even gives the
  single key and the other, which is odd, the many; and one side adds the parity of the second
  segment to the key, the other the opposite one.

So no link is lost.  Fingerprints that share a key are compared and kept if at most 4 bits
differ.

How it runs.  Only ids and fingerprints are shuffled.  Equal fingerprints become one node, so
exact copies add nothing.  Where many fingerprints share a key, they are cut into blocks and
each pair of blocks is a task's work of its own, so no task holds more than two blocks and
none of the pairs is left out; and of the links found among them only a forest that joins the
same nodes is handed on, so the number of links stays below that of rows.  Components come
from label propagation with pointer jumping on the links, in rounds of joins, after tasks have joined what they hold by themselves.

Cases: a null, empty or blank text has fingerprint zero, linked like any other; fewer than
``shingle`` words make one shingle; repeated rows give repeated rows with the same
component; a null id can't be a component's id (if all its ids are null, it is null); no
rows give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepline.llm import golay
from stepline.llm.common import as_bytes, cut

SEED = 42
SHINGLE = 4
MOST_BITS = 4
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Fingerprints of one key in a block.
BLOCK = 1024
#: Roles of a row of a key; FAR is one of both sides, for keys that tell more than a fingerprint's segments do.
BOTH, INDEX, PROBE, FAR, INDEX_FAR = 0, 1, 2, 3, 4


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned SimHash of a text's word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size).tolist()
    ends = ends.tolist()
    n = max(1, len(words) - shingle + 1)
    ends = ends[len(words) - n :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 14):
        hashes = np.array([digest(line[i:j], SEED) for i, j in zip(starts[a : a + (1 << 14)], ends[a : a + (1 << 14)])], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(batches, shingle):
    for batch in batches:
        found = [fingerprint(x, shingle) for x in as_bytes(batch.column(1))]
        yield pa.record_batch([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp), fp as a signed long."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(lambda it: _fingerprints(it, shingle), "doc_id long, fp long")


def key_rows(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, place in fp, role) of all keys of some fingerprints."""
    unsigned = fp.view(np.uint64)
    parts = [((unsigned >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    row = np.arange(len(fp))
    out = [((np.int64(k) << 56) | p, row, np.full(len(fp), BOTH, np.int8)) for k, p in enumerate(parts)]
    near = [golay.nearest(p) for p in parts]
    odd = [np.bitwise_count(p).astype(np.int64) & 1 for p in parts]
    keys = [golay.keys(p) for p in parts]
    for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        kind = np.int64(3 + k) << 56
        even, other = np.flatnonzero(odd[i] == 0), np.flatnonzero(odd[i])
        out.append((kind | odd[j][even] << 24 | near[i][even] << 12 | near[j][even], even, np.full(len(even), INDEX, np.int8)))
        (a, use_a), (b, use_b) = keys[i], keys[j]
        at, x, y = np.nonzero(use_a[other][:, :, None] & use_b[other][:, None, :])
        at = other[at]
        out.append((kind | (1 - odd[j][at]) << 24 | a[at, x] << 12 | b[at, y], at, np.full(len(at), PROBE, np.int8)))
    return tuple(map(np.concatenate, zip(*out)))


def _key_rows(batches):
    for batch in batches:
        fp = np.asarray(batch.column(0))
        for a in range(0, len(fp), 4096):
            key, at, role = key_rows(fp[a : a + 4096])
            yield pa.record_batch([pa.array(key), pa.array(fp[a : a + 4096][at]), pa.array(role)], names=["key", "fp", "role"])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few links that join the same nodes as the links a - b do.

    A component's nodes are numbered and each is linked to that of a 32nd of its number, so
    no node gets many links and none is far from another.
    """
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    order = np.argsort(label, kind="stable")
    first = np.searchsorted(label[order], label[order])
    number = np.arange(len(order)) - first
    up = number > 0
    return nodes[order[first[up] + number[up] // 32]], nodes[order[up]]


def _links(batches, most_bits, far_bits, at_once=1 << 21):
    """Rows sorted by (key, cell, role): the links among each cell's rows."""

    def compare(index, probe, most, n_index, n_probe):
        """index, probe: rows of all cells in turn; most: differing bits of a link, by index row; n_index, n_probe: how many each cell has."""
        pairs = n_index * n_probe
        i_from, p_from = np.cumsum(n_index) - n_index, np.cumsum(n_probe) - n_probe
        found = []
        cell, done = 0, np.cumsum(pairs)
        while cell < len(pairs):
            last = max(cell + 1, int(np.searchsorted(done, (done[cell - 1] if cell else 0) + at_once, "right")))
            n = pairs[cell:last]
            of = np.repeat(np.arange(cell, last), n)
            k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            i = i_from[of] + k // n_probe[of]
            x, y = index[i], probe[p_from[of] + k % n_probe[of]]
            near = (np.bitwise_count((x ^ y).view(np.uint64)) <= most[i]) & (x != y)
            found.append((np.minimum(x[near], y[near]), np.maximum(x[near], y[near])))
            cell = last
        a, b = map(np.concatenate, zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        return forest(a, b) if len(a) else (a, b)

    def links(key, cell, fp, role):
        edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])) if len(key) else np.zeros(0, np.int64)
        if not len(edge):
            return None
        is_index, is_probe = role != PROBE, (role != INDEX) & (role != INDEX_FAR)
        n_index, n_probe = (np.add.reduceat(x.astype(np.int64), edge) for x in (is_index, is_probe))
        most = np.where(role[is_index] >= FAR, far_bits, most_bits)
        a, b = compare(fp[is_index], fp[is_probe], most, n_index, n_probe)
        return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"]) if len(a) else None

    held = None
    for batch in batches:
        rows = [np.asarray(c) for c in batch.columns]
        rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
        # the last cell may go on in the next batch
        key, cell = rows[0], rows[1]
        other = np.flatnonzero((key != key[-1]) | (cell != cell[-1]))
        upto = other[-1] + 1 if len(other) else 0
        held = [x[upto:] for x in rows]
        if (out := links(*(x[:upto] for x in rows))) is not None:
            yield out
    if held is not None and (out := links(*held)) is not None:
        yield out


def links(fps: DataFrame, most_bits: int = MOST_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b) of distinct fingerprints ``fps`` (column fp): enough links to join all that are within ``most_bits``."""
    return links_of_keys(key_table(fps), most_bits, most_bits, block)


def key_table(fps: DataFrame) -> DataFrame:
    return fps.mapInArrow(_key_rows, "key long, fp long, role byte")


def _small_keys(batches, most_bits, far_bits, block):
    """Rows (key, fp, role) sorted by key: the links of keys with at most ``block`` rows, as rows without a role; the rows of other keys as they are."""
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("role", pa.int8())])
    sort = lambda key, fp, role: [pa.record_batch([pa.array(key), pa.array(np.zeros(len(key), np.int32)), pa.array(fp), pa.array(role)], names=["key", "cell", "fp", "role"])]
    held, hot = None, None
    for batch in _then_none(batches):
        rows = [np.asarray(c) for c in batch.columns] if batch is not None else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        key = rows[0]
        if not len(key):
            continue
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff([*start, len(key)])
        many = size > block
        if hot is not None and key[0] == hot:
            many[0] = True
        # the last key may go on in the next batch: it waits, unless it is known to have many rows
        waits = batch is not None and not many[-1]
        hot = key[-1] if batch is not None and many[-1] else None
        whole = np.repeat(many, size)
        upto = start[-1] if waits else len(key)
        held = [x[upto:] for x in rows] if waits else None
        few = np.flatnonzero(~whole[:upto] & np.repeat(size > 1, size)[:upto])
        for out in _links(sort(*(x[few] for x in rows)), most_bits, far_bits) if len(few) else ():
            yield pa.record_batch([*out.columns, pa.nulls(out.num_rows, pa.int8())], schema=schema)
        large = np.flatnonzero(whole[:upto])
        if len(large):
            yield pa.record_batch([pa.array(x[large]) for x in rows], schema=schema)


def _then_none(batches):
    yield from batches
    yield None


def links_of_keys(keyed: DataFrame, most_bits: int, far_bits: int, block: int = BLOCK) -> DataFrame:
    """(a, b): enough links to join all fingerprints of ``keyed`` (key, fp, role) that share a key and are within ``most_bits``, or ``far_bits`` if the key's rows are FAR.

    One exchange by key; keys of few rows are done where they are, only the rows of others are dealt to cells.
    """
    sorted_keys = keyed.repartition("key").sortWithinPartitions("key")
    found = cut(sorted_keys.mapInArrow(lambda it: _small_keys(it, most_bits, far_bits, block), "key long, fp long, role byte"))
    few = found.filter("role is null").select(F.col("key").alias("a"), F.col("fp").alias("b"))
    hot = found.filter("role is not null")
    return few.unionByName(_links_of_hot_keys(hot, most_bits, far_bits, block)) if hot.limit(1).count() else few


def _links_of_hot_keys(keyed: DataFrame, most_bits: int, far_bits: int, block: int) -> DataFrame:
    stats = (
        keyed.groupBy("key")
        .agg(F.count_if(F.col("role") != PROBE).alias("n_index"), F.count_if(F.col("role") != INDEX).alias("n_probe"), F.min("fp").alias("low"), F.max("fp").alias("high"))
        .filter("low < high and n_index > 0 and n_probe > 0")
        .select("key", F.ceil(F.col("n_index") / block).cast("int").alias("rows"), F.ceil(F.col("n_probe") / block).cast("int").alias("columns"))
    )
    shared = keyed.join(stats, "key")
    # cells: an index row goes to all cells of its block's row, a probe row to all of its column
    mine = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    small = (F.col("rows") == 1) & (F.col("columns") == 1)
    across = F.transform(upto("columns"), lambda j: F.struct((mine("rows") * F.col("columns") + j).alias("cell"), F.lit(INDEX).cast("byte").alias("role")))
    down = F.transform(upto("rows"), lambda i: F.struct((i * F.col("columns") + mine("columns")).alias("cell"), F.lit(PROBE).cast("byte").alias("role")))
    cells = (
        F.when(small, F.array(F.struct(F.lit(0).alias("cell"), F.col("role"))))
        .when(F.col("role") == INDEX, across)
        .when(F.col("role") == PROBE, down)
        .otherwise(F.concat(F.when(F.col("role") == FAR, F.transform(across, lambda c: F.struct(c["cell"].alias("cell"), F.lit(INDEX_FAR).cast("byte").alias("role")))).otherwise(across), down))
    )
    dealt = shared.select("key", "fp", F.explode(cells).alias("c")).select("key", "c.cell", "fp", "c.role")
    sorted_cells = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell")
    return sorted_cells.mapInArrow(lambda it: _links(it, most_bits, far_bits), "a long, b long").distinct()


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each component of the links a - b, its least node and each other one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
    while (label != label[label]).any():
        label = label[label]
    other = label != np.arange(len(nodes))
    return nodes[label[other]], nodes[other]


def _stars(batches, at_once=1 << 21):
    """The links that a task holds, as stars.  What is held stays below the number of its nodes."""
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a, b = np.concatenate([a, np.asarray(batch.column(0))]), np.concatenate([b, np.asarray(batch.column(1))])
        if len(a) > at_once:
            a, b = stars(a, b)
            at_once = max(at_once, 2 * len(a))
    if len(a):
        a, b = stars(a, b)
        yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of the nodes of links (a, b): root is a component's smallest node.

    Tasks first turn the links that they hold into stars, dealt by the one end and then by the other, so that
    few rounds are left for labels to spread across tasks.
    """
    for end in ("a", "b"):
        edges = edges.select("a", "b").repartition(end).mapInArrow(_stars, "a long, b long")
    both = cut(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).withColumn("root", F.least("node", "root")))
    for _ in range(most_rounds):
        old = labels
        near = both.join(old, both["b"] == old["node"]).groupBy("a").agg(F.min("root").alias("near"))
        hooked = old.join(near, old["node"] == near["a"]).select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        above = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = cut(hooked.join(above, "root").select("node", "was", F.col("top").alias("root")))
        moved = jumped.filter("root != was").limit(1).count()
        labels = jumped.select("node", "root")
        if not moved:
            return labels
    raise RuntimeError(f"components have not settled after {most_rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, most_bits: int = MOST_BITS) -> DataFrame:
    """One row a document: doc_id, fp (signed long), fingerprint (hex), component_id."""
    if most_bits > 4:
        raise ValueError("three segments find pairs of up to 4 differing bits")
    found = cut(fingerprints(docs, id_col, text_col, shingle))
    nodes = cut(found.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes.select("fp"), most_bits))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = placed.join(least, "root").select("fp", "component_id")
    return found.join(by_fp, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
