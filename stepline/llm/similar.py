"""Near copies by the similarity of their word shingles: the SimHash operator, with verification.

Two texts link where the Jaccard similarity of their sets of five-word shingles is 0.8 or
more; what links reach is one component.

* Texts with equal sets are one node.
* Candidates are (a) nodes whose fingerprints differ in at most 4 bits, by the Golay keys of
  ``near_dup``, and (b) nodes that share one of ``BANDS`` keys, each of ``ROWS`` minima of their
  shingles' hashes, and whose fingerprints differ in at most ``FAR_BITS`` bits.  (b) is there as
  texts of similarity 0.8 differ in 10 bits of 64 on average, at which three segments have
  no key in common.  Of pairs at 0.8 three in a million share no band, and three in a
  million differ in more than ``FAR_BITS`` bits.
* What candidates reach is a group.  Links are counted on the shingles themselves, for all
  pairs of a group that matter, so no pair below 0.8 links and none within a group is lost.

How it runs.  Keys, ids and fingerprints are shuffled; sets only of nodes that are in a group.
A group is cut into blocks.  First each block's nodes are held against each other and
against the group's least node, which joins most groups into one component.  Then, for groups
with several components left, blocks of those are held against each other, but for two
blocks of the same component.  A task holds two blocks at most; of the links it finds,
only a forest that joins the same nodes is handed on.

Cases: ids must be unique and not null; null, empty and blank texts are copies of one another;
fewer words than a shingle make one shingle; repeats of a shingle count once; case is ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepline.llm.common import as_bytes, cut
from stepline.llm.near_dup import FAR, MOST_BITS, components, key_table, links_of_keys, stars

SEED = 42
SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
#: Differing bits up to which nodes of one band are candidates.
FAR_BITS = 24
#: Nodes of a group in a block.
BLOCK = 256
_RANDOM = np.random.default_rng(SEED)
FLIP, ODD = (_RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
ODD |= np.uint64(1)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + shingle]), SEED) for i in range(max(1, len(words) - shingle + 1))], np.uint64))


def keys(hashes: np.ndarray) -> list[int]:
    """Signed keys of a set; none of an empty one."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for a in range(0, len(hashes), 1024):
        least = np.minimum(least, ((hashes[None, a : a + 1024] ^ FLIP) * ODD).min(1))
    found = np.array([xxhash.xxh64_intdigest(x.tobytes(), band) for band, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64)
    return found.view(np.int64).tolist()


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[a : a + (1 << 14)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def _signatures(batches, shingle):
    for batch in batches:
        node, fp, found = [], [], []
        for text in as_bytes(batch.column(1)):
            hashes = shingles(text, shingle)
            node.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
            fp.append(fingerprint(hashes))
            found.append(keys(hashes))
        columns = [batch.column(0), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(fp, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
        yield pa.record_batch(columns, names=["id", "node", "fp", "keys"])


def _sets(batches, shingle):
    for batch in batches:
        texts = as_bytes(batch.column(1))
        for a in range(0, len(texts), 256):
            found = [shingles(x, shingle).view(np.int64) for x in texts[a : a + 256]]
            yield pa.record_batch([batch.column(0).slice(a, 256), pa.array(found, pa.list_(pa.int64()))], names=["node", "hashes"])


def shared(sets: list[np.ndarray], at_once: int = 4096) -> np.ndarray:
    """By pairs of sets, how many hashes they share."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, code = owner[count[code] > 1], code[count[code] > 1]
    _, code = np.unique(code, return_inverse=True)
    by_code = np.argsort(code, kind="stable")
    owner, code = owner[by_code], code[by_code]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(code.max(initial=-1)) + 1, at_once):
        i, j = np.searchsorted(code, [a, a + at_once])
        has = np.zeros((len(sets), at_once), np.float32)
        has[owner[i:j], code[i:j] - a] = 1
        total += has @ has.T
    return total


def linked(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of the pairs of sets that are similar enough, to a hundredth, in whole numbers."""
    size = np.array([len(x) for x in sets])
    percent = round(100 * similarity)
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return tuple(np.array([[0], [1]] if both * (100 + percent) >= percent * size.sum() else [[], []], np.int64))
    enough = shared(sets).astype(np.int64) * (100 + percent) >= percent * (size[:, None] + size)
    return np.nonzero(np.triu(enough, 1))


def _verified(batches, similarity):
    """Rows (cell, node, hashes) sorted by cell: the links among each cell's rows."""

    def links_of(cell, node, sets):
        edge = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
        a, b = [], []
        for i, j in zip(edge, edge[1:]):
            if j - i > 1:
                x, y = linked(sets[i:j], similarity)
                if len(x):
                    for to, found in zip((a, b), stars(node[i:j][x], node[i:j][y])):
                        to.append(found)
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
        if len(a):
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    cell, node, sets = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    for batch in batches:
        cell = np.concatenate([cell, np.asarray(batch.column(0))])
        node = np.concatenate([node, np.asarray(batch.column(1))])
        column = batch.column(2)
        ends, values = column.offsets.to_numpy(), column.values.to_numpy()
        sets += [values[i:j] for i, j in zip(ends, ends[1:])]
        # the last cell may go on in the next batch
        other = np.flatnonzero(cell != cell[-1]) if len(cell) else []
        upto = int(other[-1]) + 1 if len(other) else 0
        yield from links_of(cell[:upto], node[:upto], sets[:upto])
        cell, node, sets = cell[upto:], node[upto:], sets[upto:]
    yield from links_of(cell, node, sets)


def verified(cells: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): for each cell of ``cells`` (cell, node) and component of its links, the least node and each other one."""
    rows = cells.join(sets, "node").select("cell", "node", "hashes")
    return cut(rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda it: _verified(it, similarity), "a long, b long").distinct())


def first_cells(members: DataFrame, block: int) -> DataFrame:
    """Blocks of each group (node, grp, of, least), each with the group's least node."""
    blocks = F.ceil(F.col("of") / block).cast("int")
    own = F.array(F.pmod(F.xxhash64("node"), blocks).cast("int"))
    all_blocks = F.when(F.col("node") == F.col("least"), F.sequence(F.lit(0), blocks - 1)).otherwise(own)
    return members.select("node", F.explode(all_blocks).alias("block"), "grp").select(F.xxhash64("grp", "block").alias("cell"), "node")


def cross_cells(members: DataFrame, block: int) -> DataFrame:
    """Pairs of blocks of the groups (node, grp, root): large components have blocks of their own, which are not paired with each other; small ones share blocks."""
    size = members.groupBy("grp", "root").agg(F.count("*").alias("n"))
    few = F.sum(F.when(F.col("n") < block, F.col("n"))).alias("few")
    sized = size.join(size.groupBy("grp").agg(few), "grp")
    large = F.col("n") >= block
    dealt = members.join(sized, ["grp", "root"])
    own, common = (F.ceil(F.col(c) / block).cast("int") for c in ("n", "few"))
    dealt = dealt.select(
        "grp",
        "node",
        F.when(large, F.col("root")).alias("only"),
        F.when(large, F.xxhash64("root", F.pmod(F.xxhash64("node"), own))).otherwise(F.pmod(F.xxhash64("root"), common).cast("long")).alias("block"),
    )
    blocks = dealt.select("grp", "block", "only").distinct()
    x, y = blocks.select("grp", F.col("block").alias("i"), F.col("only").alias("p")), blocks.select("grp", F.col("block").alias("j"), F.col("only").alias("q"))
    pairs = x.join(y, "grp").filter("i <= j and not coalesce(p = q, false)").select("grp", "i", "j", F.xxhash64("grp", "i", "j").alias("cell"))
    ends = pairs.select("grp", "cell", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return dealt.join(ends, ["grp", "block"]).select("cell", "node")


def settled_groups(members: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """(_node, root) of the nodes that link with others of their group.  members: (node, grp, of, least); sets: (node, hashes)."""
    joined = verified(first_cells(members, block), sets, similarity)
    # a group of one block is done: its stars say each node's component
    large = members.filter(F.col("of") > block).select("grp", "node")
    roots = joined.select(F.col("b").alias("_node"), F.col("a").alias("root"))
    if large.limit(1).count():
        of_large = joined.join(large.select(F.col("node").alias("b")), "b", "left_semi")
        settled = components(of_large).withColumnRenamed("node", "_node")
        labelled = large.join(settled, F.col("node") == F.col("_node"), "left").select("grp", "node", F.coalesce("root", "node").alias("root"))
        apart = labelled.groupBy("grp").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("grp")
        rest = cut(labelled.join(apart, "grp"))
        if rest.limit(1).count():
            settled = components(of_large.unionByName(verified(cross_cells(rest, block), sets, similarity))).withColumnRenamed("node", "_node")
        roots = roots.join(large.select(F.col("node").alias("_node")), "_node", "left_anti").unionByName(settled)
    return roots


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """One row a document: id, component."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = cut(texts.mapInArrow(lambda it: _signatures(it, shingle), "id long, node long, fp long, keys array<long>"))
    nodes = cut(found.groupBy("node").agg(F.min("id").alias("id")).join(found.select("id", "fp", "keys"), "id"))
    banded = nodes.select(F.explode("keys").alias("key"), "fp", F.lit(FAR).cast("byte").alias("role"))
    near = links_of_keys(key_table(nodes.select("fp").distinct()).unionByName(banded), MOST_BITS, FAR_BITS)
    groups = components(near).select(F.col("node").alias("fp"), F.col("root").alias("_root"))
    grouped = nodes.join(groups, "fp", "left").select("node", "id", F.coalesce("_root", "fp").alias("grp"))
    sizes = grouped.groupBy("grp").agg(F.count("*").alias("of"), F.min("node").alias("least")).filter("of > 1")
    members = cut(grouped.join(sizes, "grp"))
    sets = cut(texts.join(members.select("id", "node"), "id").select("node", "text").mapInArrow(lambda it: _sets(it, shingle), "node long, hashes array<long>"))
    roots = settled_groups(members, sets, similarity, block)
    return found.select("id", "node").join(roots, F.col("node") == F.col("_node"), "left").select("id", F.coalesce("root", "node").alias("component"))
