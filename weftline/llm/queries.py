"""The registered queries of the text-pipeline operators, over whole tables, and their SQL oracles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import chat, fingerprints, langid, licences, mixing, neardup, packing, sharding, suffix, topk
from weftline.session import ship_by_value

ship_by_value(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _read_back(batches: Iterator[pa.RecordBatch], template) -> Iterator[pa.RecordBatch]:
    """Digests of what the formatted text itself says: turns by parsing it, learned text by its loss spans."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites_history", pa.bool_())])
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            text = row["formatted"]
            turns = template.parse(text)
            learned = "".join(template.unescape(text[x["start"] : x["end"]]) for x in row["loss"])
            said = "".join(f"{role}\n{words}\n" for role, words in turns)
            rows.append({"conv_id": row["conv_id"], "n_turns": len(turns), "turns_sha256": hashlib.sha256(said.encode()).hexdigest(), "loss_chars": len(learned), "loss_sha256": hashlib.sha256(learned.encode()).hexdigest(), "formatted_chars": len(text), "rewrites_history": bool(row["rewrites"])})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    template = chat.TurnTemplate()
    return chat.format_conversations(turns, template).mapInArrow(lambda b: _read_back(b, template), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def licence_files() -> list[tuple[int, str]]:
    """Files with known licences, as they are shipped: with a title and a claim, in capitals, wrapped anew or spelt otherwise."""
    out = []
    for i, (name, text) in enumerate(sorted(licences.KNOWN.items())):
        forms = [f"{name} License\n\nCopyright (c) 2020 A. N. Other\nAll rights reserved.\n\n{text}" if name in ("MIT", "ISC") else text, text.upper(), " * " + text.replace("\n", "\n * "), text.replace("license", "licence"), f"{text}\nAnd more."]
        out += [(-10 * i - k - 1, x) for k, x in enumerate(forms)]
    return out


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, and files with known licences under negative ids."""
    files = spark.createDataFrame(licence_files(), "doc_id long, text string")
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(files))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.span_digests(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    model = langid.fit(docs.filter(~held_out))
    return docs.select("doc_id", held_out.alias("held_out"), langid.identify(model, F.col("text")).alias("__found")).select("doc_id", "held_out", "__found.*")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_neighbours(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)
    return found.select("query_id", "rank", "vec_id", "score")


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_sharding": op2_sharding,
    "op3_licences": op3_licences,
    "op4_packing": op4_packing,
    "op5_mixing": op5_mixing,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_language": op8_language,
    "op9_fingerprints": op9_fingerprints,
    "op10_topk": op10_topk,
}

WORDS = r"len(regexp_extract_all({}, '[^\x20\x09-\x0D]+'))"

ORACLE = {
    # the length of the formatted text follows from the template's rules, digests from the table alone
    "op1_chat_formatting": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
    + 2 * len(regexp_extract_all(text, '<\|turn\|>|<\|end\|>|<s>|</s>|\[INST\]|\[/INST\]|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>')) AS escaped
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|turn|>') + length(role) + 1 + escaped + length('<|end|>') + 1) AS BIGINT) AS formatted_chars,
  false AS rewrites_history
FROM e GROUP BY conv_id""",
    "op5_mixing": rf"""
WITH d AS (
  SELECT doc_id, source, coalesce({WORDS.format('text')}, 0) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|mix-1|' || coalesce(text, '')) AS h FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight
  FROM d GROUP BY source
), r AS (
  -- in the order of cap / weight, a source is clamped if the level of what the sources before it leave is at or above its ratio
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio FROM s
), l AS (
  SELECT a.ratio, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce((SELECT sum(b.cap) FROM r b WHERE b.ratio < a.ratio), 0))
    / (SELECT sum(b.weight) FROM r b WHERE b.ratio >= a.ratio) AS level
  FROM r a
), f AS (
  SELECT min(level) AS level FROM (SELECT level FROM l WHERE level <= ratio ORDER BY ratio LIMIT 1)
), g AS (
  SELECT source, source_size, least(weight * (SELECT level FROM f), cap) AS target FROM r
), p AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN CAST(floor(g.target / g.source_size) AS BIGINT) ELSE 0 END AS whole,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(whole * size + greatest(0, least(size, CAST(floor(target - whole * source_size) AS BIGINT) - before)) AS BIGINT) AS taken
FROM p""",
    "op10_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 10""",
}
# SQL has no CRC-32: the oracle runs it bit by bit over bytes with the reflected polynomial 0xEDB88320
ORACLE["op2_sharding"] = r"""
WITH k AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, s: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t
), d AS (
  SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) + 1 AS size FROM documents
), b AS MATERIALIZED (
  SELECT doc_id, size, list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM d
), c AS (
  SELECT doc_id, size, xor(list_reduce(bytes,
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM b, k
), o AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM c
), p AS (
  SELECT *, least(((2 * before + size) * 8) // (2 * total), 7) AS shard FROM o
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM p"""


def _canonical_sql(text: str) -> str:
    x = f"regexp_replace(regexp_replace(lower({text}), '{licences.COPYRIGHT_LINE}', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
    x = f"(' ' || replace(trim({x}), ' ', '  ') || ' ')"
    for a, b in licences.SPELLINGS:
        x = f"replace({x}, ' {a.replace(' ', '  ')} ', ' {b} ')"
    return f"trim(replace({x}, '  ', ' '))"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE["op3_licences"] = f"""
WITH k AS (
  SELECT min(licence_id) AS licence_id, md5({_canonical_sql('text')}) AS digest
  FROM (VALUES {", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in licences.KNOWN.items())}) t(licence_id, text) GROUP BY 2
), a AS (
  SELECT doc_id, text FROM documents UNION ALL VALUES {", ".join(f"({i}, {_quoted(t)})" for i, t in licence_files())}
), d AS (
  SELECT doc_id, text, {_canonical_sql("coalesce(text, '')")} AS form FROM a
), n AS (
  SELECT doc_id, string_agg(DISTINCT licence_id, ',' ORDER BY licence_id) AS notices
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) l JOIN k ON regexp_matches(line, '(?i)licen[cs]e') AND md5({_canonical_sql('line')}) = k.digest
  GROUP BY doc_id
)
SELECT d.doc_id, length(form) AS canonical_chars, md5(form) AS digest, k.licence_id, coalesce(n.notices, '') AS notices
FROM d LEFT JOIN k ON md5(form) = k.digest LEFT JOIN n ON n.doc_id = d.doc_id"""


def _packing_sql(n_buckets: int = 8, token_budget: int = 16384) -> str:
    """The same dynamic program, a table for each number of buckets; each step tries every cut."""
    steps, best = [], "SELECT j, l * rows - tokens AS cost, 0 AS cut FROM h UNION ALL SELECT 0, 0, 0"
    steps.append(f"c1 AS MATERIALIZED ({best})")
    for k in range(2, n_buckets + 1):
        steps.append(f"""c{k} AS MATERIALIZED (
  SELECT j, min(total) AS cost, arg_min(i, (total, i)) AS cut
  FROM (SELECT b.j, a.j AS i, a.cost + b.l * (b.rows - c.rows) - (b.tokens - c.tokens) AS total
        FROM h b JOIN c{k - 1} a ON a.j < b.j AND a.j >= {k - 1} JOIN h c ON c.j = a.j WHERE b.j >= {k}) GROUP BY j)""")
    ends = [f"e{n_buckets} AS (SELECT least(max(j), {n_buckets}) AS k, max(j) AS j FROM h)"]
    for k in range(n_buckets, 1, -1):
        # with fewer lengths than buckets the chain starts lower
        ends.append(f"e{k - 1} AS (SELECT k, CASE WHEN k >= {k} THEN (SELECT cut FROM c{k} WHERE c{k}.j = e{k}.j) ELSE j END AS j FROM e{k})")
    lengths = " UNION ".join(f"SELECT h.l FROM h JOIN e{k} ON h.j = e{k}.j" for k in range(1, n_buckets + 1))
    return f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce({WORDS.format('text')}, 0) AS BIGINT) AS n_tokens, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|pack-1|' || coalesce(text, '')) AS hash FROM documents
), g AS (SELECT n_tokens AS l, count(*) AS n FROM d GROUP BY 1
), h AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY l) AS j, l, CAST(sum(n) OVER (ORDER BY l) AS BIGINT) AS rows, CAST(sum(n * l) OVER (ORDER BY l) AS BIGINT) AS tokens FROM g
), {", ".join(steps)}, {", ".join(ends)},
b AS (SELECT l AS bucket_len, CAST(row_number() OVER (ORDER BY l) - 1 AS INT) AS bucket, lag(l, 1, -1) OVER (ORDER BY l) AS below FROM ({lengths})),
p AS (
  SELECT d.*, b.bucket, b.bucket_len, greatest(1, {token_budget} // greatest(1, b.bucket_len)) AS per,
    row_number() OVER (PARTITION BY b.bucket ORDER BY d.hash, d.n_tokens) - 1 AS i
  FROM d JOIN b ON d.n_tokens <= b.bucket_len AND d.n_tokens > b.below
)
SELECT doc_id, n_tokens, bucket, bucket_len, i // per AS batch, i % per AS slot, bucket_len - n_tokens AS padding FROM p"""


ORACLE["op4_packing"] = _packing_sql()

ORACLE["op6_near_duplicates"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, unnest(words) AS x, unnest(range(len(words))) AS p, len(words) AS n
  FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents)
), g AS (
  SELECT doc_id, n, p, x || coalesce(' ' || lead(x, 1) OVER o, '') || coalesce(' ' || lead(x, 2) OVER o, '') || coalesce(' ' || lead(x, 3) OVER o, '') AS x
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY p)
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, x FROM g WHERE p <= greatest(0, n - 4)
), c AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), b AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), l AS MATERIALIZED (
  SELECT a, b FROM b JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * b.n >= 80 * (x.n + y.n - b.n)
), e AS MATERIALIZED (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
), m AS (
  SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1
)
SELECT m.doc_id, coalesce(c.n, 0) AS n_shingles, component_id, component_id = m.doc_id AS kept FROM m LEFT JOIN c ON c.doc_id = m.doc_id"""

ORACLE["op7_suffix_dedup"] = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents
), p AS (
  SELECT doc_id, i, substring(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(n - 99)) AS i FROM d WHERE n >= 100)
), r AS (
  SELECT doc_id, i FROM p QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1
), j AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM r
), k AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM j
), t AS (
  SELECT doc_id, span, min(i) AS a, max(i) + 100 AS z FROM k GROUP BY ALL
), u AS (
  SELECT t.doc_id, a, z, substring(h, 2 * lag(z, 1, 0) OVER o + 1, 2 * (a - lag(z, 1, 0) OVER o)) AS part FROM t JOIN d USING (doc_id) WINDOW o AS (PARTITION BY t.doc_id ORDER BY a)
), v AS (
  SELECT doc_id, sum(z - a) AS removed, count(*) AS spans, max(z) AS last, string_agg(part, '' ORDER BY a) AS head FROM u GROUP BY 1
)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN v ON v.doc_id = d.doc_id"""
