"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A text's set is that of its distinct word shingles.  Its signature has ``CHUNKS`` chunks of
``POSITIONS`` positions, each the lowest ``BITS`` bits of a minimum of the shingles' hashes (b-bit
minwise hashing).  The distance of two signatures is the number of positions at which they
differ.

The join.  If two signatures differ in fewer than (``ERRORS`` + 1) x ``CHUNKS`` positions, then in some
chunk they differ in at most ``ERRORS``, that is one: a chunk's key for each position that may be
the wrong one is made of the others.  So all pairs under that distance, 20 of 50, share
one of 50 keys of four positions, 64 bits each.  At a similarity of 0.8 a position differs with probability
0.2, and all ten chunks do in two or more for 2 pairs in a million; at 0.85 for 2 in 10^8.
Pairs that share a key are candidates if one bit of each of ``MINIMA`` minima differs in at most ``FAR_BITS`` of 64 (a
pair at 0.8 differs in more with probability 10^-7).  Links are confirmed on full sets, in whole numbers: 100 x
shared >= 80 x all.

How it runs.  Equal sets are one node, so copies add nothing.  Keys and 64 bits are shuffled, by key once;
full sets only of nodes that have a candidate.  Keys that many nodes share are cut into cells of two blocks (``near_dup``),
candidates reach groups, and groups are confirmed in blocks, in which nodes known to be
joined are not held against each other (``similar``).  No task holds more than two blocks and no pairs are
handed on, but a forest of links.

Cases: a text without words, or null, has an empty set and links with nothing; with fewer words
than a shingle the whole sequence is one; repeats of a shingle count once; A-Z are lower-cased only; repeated rows
are one node; rows of different texts may share an id, and ids may be null: the smallest id that is not null names a
component, null if there is none; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepline.llm.common import as_bytes, cut
from stepline.llm.near_dup import FAR, components, links_of_keys
from stepline.llm.similar import BLOCK, settled_groups, shingles

SEED = 11
SHINGLE = 4
SIMILARITY = 0.8
CHUNKS, POSITIONS, BITS, ERRORS = 10, 5, 16, 1
MINIMA = 64
FAR_BITS = 22
_RANDOM = np.random.default_rng(SEED)
FLIP, ODD = (_RANDOM.integers(0, 1 << 64, (MINIMA, 1), np.uint64) for _ in range(2))
ODD |= np.uint64(1)
SALT, SPREAD = (_RANDOM.integers(0, 1 << 64, (CHUNKS, POSITIONS), np.uint64) for _ in range(2))
SPREAD |= np.uint64(1)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of a set's hashes under each of ``MINIMA`` orders."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max)
    for a in range(0, len(hashes), 1024):
        mixed = (hashes[None, a : a + 1024] ^ FLIP) * ODD
        least = np.minimum(least, ((mixed ^ mixed >> np.uint64(32)) * ODD).min(1))
    return least


def signature(least: np.ndarray) -> np.ndarray:
    """(..., CHUNKS, POSITIONS) of b-bit numbers, from minima."""
    used = least[..., : CHUNKS * POSITIONS] & np.uint64((1 << BITS) - 1)
    return used.reshape(*least.shape[:-1], CHUNKS, POSITIONS)


def far_bits(least: np.ndarray) -> np.ndarray:
    """One bit of each minimum, as a signed long."""
    bits = (least >> np.uint64(40) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=-1).view(">u8")[..., 0].astype(np.uint64).view(np.int64)


def keys(signatures: np.ndarray) -> np.ndarray:
    """(n, CHUNKS x POSITIONS) signed keys: of each chunk, with each of its positions left out."""
    out = np.zeros(signatures.shape, np.uint64)
    for wrong in range(POSITIONS):
        for k in range(POSITIONS):
            if k != wrong:
                out[..., wrong] = out[..., wrong] << np.uint64(BITS) | signatures[..., k]
    out = (out ^ SALT) * SPREAD
    return (out ^ out >> np.uint64(29)).reshape(len(signatures), -1).view(np.int64)


def _signatures(batches, shingle):
    for batch in batches:
        texts = as_bytes(batch.column(2))
        for a in range(0, len(texts), 512):
            sets = [shingles(x, shingle) for x in texts[a : a + 512]]
            least = np.array([minima(x) for x in sets])
            node = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            size = pa.array([len(x) for x in sets], pa.int64())
            width = CHUNKS * POSITIONS
            of = pa.ListArray.from_arrays(pa.array(np.arange(0, width * len(sets) + 1, width, np.int32)), pa.array(keys(signature(least)).ravel()))
            yield pa.record_batch([batch.column(0).slice(a, 512), batch.column(1).slice(a, 512), size, pa.array(node), pa.array(far_bits(least)), of], names=["id", "row", "size", "node", "fp", "keys"])


def _sets(batches, shingle):
    for batch in batches:
        texts = as_bytes(batch.column(1))
        for a in range(0, len(texts), 256):
            found = [shingles(x, shingle).view(np.int64) for x in texts[a : a + 256]]
            yield pa.record_batch([batch.column(0).slice(a, 256), pa.array(found, pa.list_(pa.int64()))], names=["node", "hashes"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    text, doc_id = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    texts = docs.select(doc_id.alias("id"), F.xxhash64(doc_id, text).alias("row"), text.alias("text"))
    found = cut(texts.mapInArrow(lambda it: _signatures(it, shingle), "id long, row long, size long, node long, fp long, keys array<long>"))
    # a node's text is read again from one of its rows; an id alone may be that of several texts
    nodes = cut(found.filter("size > 0").groupBy("node").agg(F.min("row").alias("row"), F.min("id").alias("first"), F.min("fp").alias("fp")))
    keyed = found.join(nodes.select("node", "row"), ["node", "row"], "left_semi").dropDuplicates(["node"]).select(F.explode("keys").alias("key"), "fp", F.lit(FAR).cast("byte").alias("role"))
    near = links_of_keys(keyed, FAR_BITS, FAR_BITS)
    groups = components(near).select(F.col("node").alias("_fp"), F.col("root").alias("_root"))
    grouped = nodes.join(groups, F.col("fp") == F.col("_fp"), "left").select("node", "row", F.coalesce("_root", "fp").alias("grp"))
    sizes = grouped.groupBy("grp").agg(F.count("*").alias("of"), F.min("node").alias("least")).filter("of > 1")
    members = cut(grouped.join(sizes, "grp"))
    read = texts.select("row", "text").join(members.select("node", "row"), "row").dropDuplicates(["row"]).select("node", "text")
    sets = cut(read.mapInArrow(lambda it: _sets(it, shingle), "node long, hashes array<long>"))
    roots = settled_groups(members.select("node", "grp", "of", "least"), sets, similarity, block)
    placed = nodes.join(roots, F.col("node") == F.col("_node"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component"))
    of_node = placed.join(least, "root").select(F.col("node").alias("_node"), "component")
    component = F.when(F.col("size") == 0, F.col("id")).otherwise(F.col("component")).alias("component_id")
    out = found.select("id", "size", "node").join(of_node, F.col("node") == F.col("_node"), "left")
    return out.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
