"""The registered query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepline.llm import chat, decontaminate, lm_scoring, merkle, minhash, mix, near_dup, quality, ranked, secrets, shard, toxicity, warc
from stepline.llm.common import table

#: The chain's order: a document of low quality first, as that helps to tell what toxicity is not.
CATEGORIES = ("low_quality", "toxic")
SHARDS = 24


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mix.by_position(mix.mix(table(spark, sf_dir, "documents")))
    return placed.select("doc_id", "size", "source_size", "target", "taken", "first_position", F.get("positions", F.lit(1)).alias("second_position"))


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # only ids, sizes and checksums are sorted
    sized = docs.select("doc_id", shard.text_bytes(F.col("text")).alias("n"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = shard.assign_shards(sized, F.col("n"), ["doc_id"], SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.format_digests(rows.unionByName(extra)).drop("n_tokens", "n_loss_tokens")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.convert(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def toxicity_chain(spark: SparkSession, sf_dir: str) -> list:
    labels = table(spark, sf_dir, "labels")
    low, toxic = (F.col("quality") == 0).cast("double"), F.col("toxic")
    return toxicity.train_chain(table(spark, sf_dir, "documents"), labels, [low, toxic])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), toxicity_chain(spark, sf_dir), list(CATEGORIES))
    return scored.withColumn("toxic", F.col("p_toxic") >= 0.5)


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: What a leaf of the manifest is made of, in this order.
LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = merkle.leaf(*[F.translate(c, UPPER, LOWER) if c == "text" else F.col(c) for c in LEAF_FIELDS])
    is_tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaves = docs.select("doc_id", "lang", merkle.leaf(*map(F.col, LEAF_FIELDS)).alias("leaf"), F.when(is_tampered, tampered).alias("claimed"))
    proofs = merkle.manifest(leaves, "lang", "doc_id")
    found = proofs.withColumn("proof_sha256", F.sha2(merkle.siblings(F.col("path")), 256)).withColumn("folded_root", merkle.folded(F.coalesce("claimed", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_WEIGHED_TIME = """CASE weight
    WHEN 5 THEN CASE WHEN {0} < 0.625 THEN least({0} * 2 / (sqrt(1.5 * 1.5 + {0} * 2 * -1.0) + 1.5), 0.5) ELSE least(0.5 + greatest({0} - 0.625, 0) * 2 / (sqrt(1.0 + greatest({0} - 0.625, 0) * 2 * -1.0) + 1.0), 1.0) END
    WHEN 2 THEN {0}
    ELSE CASE WHEN {0} < 0.375 THEN least({0} * 2 / (sqrt(0.5 * 0.5 + {0} * 2 * 1.0) + 0.5), 0.5) ELSE least(0.5 + greatest({0} - 0.375, 0) * 2 / (sqrt(1.0 + greatest({0} - 0.375, 0) * 2 * 1.0) + 1.0), 1.0) END
  END"""
#: Schedules are integrated by hand here: a line from 1.5 by 1 to 0.5 (and back) has area 0.625 (0.375) up to its middle.
MIX_SQL = rf"""WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 8))::BIGINT AS ord
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources),
levels AS (
  SELECT *, source_size::DOUBLE / weight AS ratio,
    (sum(source_size) OVER () * 1.5::DOUBLE - (sum(source_size) OVER w - source_size) * 2.0::DOUBLE)
      / (sum(weight) OVER () - sum(weight) OVER w + weight) AS level
  FROM weighed WINDOW w AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
aims AS (
  SELECT source, source_size, weight,
    least(source_size * 2.0::DOUBLE, coalesce((SELECT arg_min(level, ratio) FROM levels WHERE level * weight <= source_size * 2.0::DOUBLE) * weight, source_size * 2.0::DOUBLE)) AS target
  FROM levels),
placed AS (
  SELECT s.*, a.source_size, a.target, a.weight,
    sum(size) OVER (PARTITION BY s.source ORDER BY ord % 1024, ord, doc_id, size ROWS UNBOUNDED PRECEDING) - size + size / 2.0::DOUBLE AS middle
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source),
demands AS (
  SELECT *, middle / target AS x, (middle + source_size) / target AS y FROM placed),
due AS (
  SELECT *, CASE WHEN size > 0 AND target > 0 AND x <= 1 THEN {_WEIGHED_TIME.format("x::DOUBLE")} END AS first_position,
    CASE WHEN size > 0 AND target > 0 AND y <= 1 THEN {_WEIGHED_TIME.format("y::DOUBLE")} END AS second_position
  FROM demands)
SELECT doc_id, size, source_size, target, ((first_position IS NOT NULL)::BIGINT + (second_position IS NOT NULL)::BIGINT) * size AS taken, first_position, second_position
FROM due"""

_ESCAPED = r"""length({0}) + (length({0}) - length(replace({0}, '\', ''))) + coalesce(list_sum([length(x) for x in regexp_extract_all({0}, '#{{3,}}')]), 0) + len(regexp_extract_all({0}, '</?turn>'))"""
CHAT_SQL = rf"""WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(17 + {_ESCAPED.format("role")} + {_ESCAPED.format("text")})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""

WARC_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT *, strlen(html) AS n, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to FROM k"""

#: crc32 byte by byte, with a table made of its polynomial.
SHARD_SQL = f"""WITH entries AS MATERIALIZED (SELECT [list_reduce(list_prepend(n::BIGINT, [0::BIGINT FOR i IN range(8)]), LAMBDA c, d: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR n IN range(256)] AS t),
bytes AS (SELECT doc_id, (8 + strlen(coalesce(text, '')))::BIGINT AS size, list_prepend(4294967295::BIGINT, [('0x' || p)::BIGINT FOR p IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')]) AS b FROM documents),
sized AS (SELECT doc_id, size, xor(list_reduce(b, LAMBDA a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32 FROM bytes, entries),
placed AS (SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total FROM sized),
cut AS (SELECT *, least((2 * start + size) * {SHARDS} // (2 * total), {SHARDS - 1})::INTEGER AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard FROM cut"""

MINHASH_SQL = r"""WITH RECURSIVE w AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS MATERIALIZED (
  SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_sort(list_distinct([array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, greatest(len(ws) - 3, 1) + 1)])) END AS set FROM w),
nodes AS MATERIALIZED (SELECT min(r) AS node, min(doc_id) AS first, set FROM s WHERE len(set) > 0 GROUP BY set),
items AS (SELECT node, len(set) AS n, unnest(set) AS shingle FROM nodes),
pairs AS (
  SELECT a.node AS a, b.node AS b, any_value(a.n) + any_value(b.n) AS sizes, count(*) AS common
  FROM items a JOIN items b ON a.shingle = b.shingle AND a.node < b.node GROUP BY a.node, b.node),
links AS MATERIALIZED (SELECT a, b FROM pairs WHERE 100 * common >= 80 * (sizes - common)),
ends AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT node AS a, node AS b FROM nodes UNION SELECT reach.a, ends.b FROM reach JOIN ends ON reach.b = ends.a),
roots AS (SELECT reach.a AS node, min(nodes.first) AS component FROM reach JOIN nodes ON reach.b = nodes.node GROUP BY reach.a)
SELECT s.doc_id, len(s.set)::BIGINT AS n_shingles, CASE WHEN len(s.set) = 0 THEN s.doc_id ELSE roots.component END AS component_id,
  s.doc_id IS NOT DISTINCT FROM (CASE WHEN len(s.set) = 0 THEN s.doc_id ELSE roots.component END) AS kept
FROM s LEFT JOIN nodes ON s.set = nodes.set LEFT JOIN roots ON nodes.node = roots.node"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SEARCH_SQL = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
docs AS (SELECT r, doc_id, len(ts) AS n, ts FROM d WHERE len(ts) > 0),
sums AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM docs),
wanted AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
tf AS MATERIALIZED (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM docs) WHERE term IN (SELECT term FROM wanted) GROUP BY r, term),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, sums GROUP BY term),
impacts AS (
  SELECT tf.r, tf.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * sums.docs) // sums.terms))) AS part
  FROM tf JOIN weights USING (term) JOIN docs USING (r), sums),
scores AS (SELECT item_id, r, sum(part)::BIGINT AS score FROM wanted JOIN impacts USING (term) GROUP BY item_id, r),
ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
  FROM scores JOIN docs USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50"""


def _tree_sql(name: str, levels: int, out: list[str]) -> None:
    """Levels of nodes (g, idx, n, h) above {name}0, with the runs (hs) of each."""
    for k in range(levels):
        out.append(f"{name}r{k} AS MATERIALIZED (SELECT g, idx // 8 AS p, any_value(n) AS n, list(h ORDER BY idx) AS hs FROM {name}{k} GROUP BY g, idx // 8)")
        out.append(f"{name}{k + 1} AS (SELECT g, p AS idx, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {name}r{k})")


def _fold_sql(name: str, levels: int, rows: str, out: list[str]) -> None:
    """{rows}0 (g, idx, proof, folded, ...) to {rows}{levels}: a level's siblings added to the proof and folded in."""
    for k in range(levels):
        left, right = f"array_to_string(hs[1:x.idx % 8], '')", f"array_to_string(hs[x.idx % 8 + 2:], '')"
        out.append(f"""{rows}{k + 1} AS (SELECT x.* EXCLUDE (idx, proof, folded), x.idx // 8 AS idx, CASE WHEN n = 1 THEN proof ELSE proof || {left} || {right} END AS proof,
  CASE WHEN n = 1 THEN folded ELSE sha256({left} || folded || {right}) END AS folded FROM {rows}{k} x JOIN {name}r{k} ON x.g = {name}r{k}.g AND x.idx // 8 = p)""")


def merkle_sql(levels: int = 7, top_levels: int = 3) -> str:
    """For at most 8^levels leaves of a group and 8^top_levels groups; crc32 by its polynomial."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in (*LEAF_FIELDS[:4], text)) + ")"
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    out = [
        f"""hashed AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, {leaf("text")} AS leaf, {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} AS lowered FROM documents)""",
        f"""crcs AS (SELECT r, list_reduce(list_prepend(4294967295::BIGINT, [unicode(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]), LAMBDA a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT FOR i IN range(8)]), LAMBDA c, d: {bit})) AS c FROM hashed WHERE doc_id IS NOT NULL)""",
        """t AS MATERIALIZED (SELECT h.*, CASE WHEN xor(c, 4294967295) % 3 = 0 THEN lowered ELSE leaf END AS claimed,
  dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM hashed h LEFT JOIN crcs USING (r))""",
        "n0 AS (SELECT g, idx, n, leaf AS h FROM t)",
    ]
    _tree_sql("n", levels, out)
    out.append(f"m0 AS (SELECT 0 AS g, g AS idx, count(*) OVER () AS n, h FROM n{levels})")
    _tree_sql("m", top_levels, out)
    out.append("f0 AS (SELECT r, g, idx, '' AS proof, claimed AS folded FROM t)")
    _fold_sql("n", levels, "f", out)
    out.append(f"e0 AS (SELECT r, g AS of, 0 AS g, g AS idx, proof, folded FROM f{levels})")
    _fold_sql("m", top_levels, "e", out)
    return f"""WITH {", ".join(out)}
SELECT doc_id, leaf, s.h AS subroot, m.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = m.h AS verified
FROM e{top_levels} e JOIN t USING (r) JOIN n{levels} s ON e.of = s.g, m{top_levels} m"""


QUERIES = {
    f.__name__: f
    for f in (op1_lm_scoring, op2_decontaminate, op3_mix, op4_shard, op5_secrets, op6_near_dup, op7_chat, op8_warc, op9_quality, op10_toxicity, op11_minhash, op12_ranked_search, op13_merkle)
}
ORACLES = {"op3_mix": MIX_SQL, "op4_shard": SHARD_SQL, "op7_chat": CHAT_SQL, "op8_warc": WARC_SQL, "op11_minhash": MINHASH_SQL, "op12_ranked_search": SEARCH_SQL, "op13_merkle": merkle_sql()}
