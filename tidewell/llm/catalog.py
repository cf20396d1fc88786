"""The queries of this package over the driver's tables; `ORACLE` has those that SQL can express."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bpe, codes, counting, html, lines, lm, minhash, packing, planes, quality, resampling, shards, vectors
from tidewell.session import scratch_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text decoded from them."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = bpe.decode(bpe.encode(docs, path).drop("text"), path)
    return decoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-equal embeddings by cosine 0.9."""
    found = vectors.near_vectors(_table(spark, sf_dir, "embeddings"), 0.9)
    kept = F.col("vec_id").eqNullSafe(F.col("component_id"))
    return found.select("vec_id", "n_links", "component_id", kept.alias("kept"))


OP2_SQL = r"""
WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), e AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9
), t AS (SELECT vec_id AS v, vec_id AS r FROM embeddings UNION SELECT t.v, e.b FROM t JOIN e ON t.r = e.a
), m AS (SELECT v, min(r) AS component_id FROM t GROUP BY 1
), n AS (SELECT a, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN m ON v = vec_id LEFT JOIN n ON a = vec_id
"""


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = counting.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 50 words or more that occur earlier."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.drop_repeated_lines(docs, extend=True).select("doc_id", "n_lines", "n_deleted", "text")


OP4_SQL = r"""
WITH l AS (
    SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line
    FROM documents
), k AS (
    SELECT *, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words FROM l
), s AS (
    SELECT *, coalesce(sum(words) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
        AS start FROM k WHERE words > 0
), r AS (
    SELECT *, sum(words) OVER w AS total, list(line) OVER w AS run, sum(words) OVER v AS back, list(line) OVER v AS tail FROM s
    WINDOW w AS (PARTITION BY doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING),
        v AS (PARTITION BY doc_id ORDER BY start + words RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
), f AS (
    SELECT run, min({'d': doc_id, 'a': pos}) AS first FROM r WHERE total >= 50 GROUP BY run HAVING count(*) > 1
), t AS (
    SELECT tail, min({'d': doc_id, 'a': pos}) AS first FROM r WHERE back >= 50 GROUP BY tail HAVING count(*) > 1
), b AS (
    SELECT r.*, coalesce(r.total >= 50 AND {'d': r.doc_id, 'a': r.pos} > f.first, FALSE) AS begins,
        coalesce(r.back >= 50 AND {'d': r.doc_id, 'a': r.pos} > t.first, FALSE) AS ends FROM r LEFT JOIN f USING (run) LEFT JOIN t USING (tail)
), g AS (
    SELECT doc_id, pos, bool_or(begins) OVER (PARTITION BY doc_id ORDER BY start RANGE BETWEEN 49 PRECEDING AND CURRENT ROW) OR ends AS gone
    FROM b
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE coalesce(gone, FALSE)) AS n_deleted,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(gone, FALSE)), '') AS text
FROM l LEFT JOIN g USING (doc_id, pos) GROUP BY doc_id
"""


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-equal documents by two-word shingles."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = minhash.near_duplicates(docs, minhash.Rule(words=2, percent=80))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP5_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE len(w) WHEN 0 THEN [] WHEN 1 THEN [w]
        ELSE [w[i : i + 1] FOR i IN range(1, len(w))] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), c AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
    SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), t AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT t.v, e.b FROM t JOIN e ON t.r = e.a
), m AS (SELECT v, min(r) AS component_id FROM t GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN m ON v = doc_id LEFT JOIN n USING (doc_id)
"""


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 ids."""
    packed = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    columns = ["doc_tokens", "sequence_id", "offset"]
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), *columns)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document against the rest of the corpus."""
    scored = lm.score(_table(spark, sf_dir, "documents"))
    mean = F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6))
    return scored.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), mean.alias("mean_log"))


OP7_SQL = r"""
WITH w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), p AS (SELECT doc_id, len(w) AS n_words, w, unnest(range(1, len(w) + 1)) AS i FROM w
), g AS (
    SELECT doc_id, n_words, i, w[i : i] AS g1, CASE WHEN i > 1 THEN w[i - 1 : i] END AS g2,
        CASE WHEN i > 2 THEN w[i - 2 : i] END AS g3 FROM p
), u AS (
    SELECT doc_id, g1 AS g FROM g UNION ALL SELECT doc_id, g2 FROM g WHERE i > 1 UNION ALL SELECT doc_id, g3 FROM g WHERE i > 2
), d AS (SELECT doc_id, g, count(*) AS n FROM u GROUP BY ALL
), c AS (SELECT g, sum(n) AS n FROM d GROUP BY ALL
), r AS (SELECT doc_id, g, c.n - d.n AS n FROM d JOIN c USING (g)
), x AS (
    SELECT g.doc_id, i, n_words, r1.n AS c1, r2.n AS c2, r3.n AS c3,
        lag(r1.n) OVER o AS b1, lag(r2.n) OVER o AS b2, (SELECT count(*) FROM g) - n_words AS others
    FROM g JOIN r r1 ON r1.doc_id = g.doc_id AND r1.g = g.g1
    LEFT JOIN r r2 ON r2.doc_id = g.doc_id AND r2.g = g.g2 LEFT JOIN r r3 ON r3.doc_id = g.doc_id AND r3.g = g.g3
    WINDOW o AS (PARTITION BY g.doc_id ORDER BY i)
), s AS (
    SELECT doc_id, CASE WHEN c3 > 0 THEN ln(c3 / b2) WHEN c2 > 0 THEN (least(i, 3) - 2) * ln(0.4::DOUBLE) + ln(c2 / b1)
        WHEN c1 > 0 THEN (least(i, 3) - 1) * ln(0.4::DOUBLE) + ln(c1 / others)
        ELSE least(i, 3) * ln(0.4::DOUBLE) - ln(others + 1) END AS l FROM x
), t AS (SELECT doc_id, sum(round(l * 1000000)::BIGINT)::BIGINT AS l FROM s GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(l, 0) / 1000000.0::DOUBLE, 6) AS log_score,
    CASE WHEN len(w) > 0 THEN round(round(coalesce(l, 0) / 1000000.0::DOUBLE, 6) / len(w), 6) END AS mean_log
FROM w LEFT JOIN t USING (doc_id)
"""


def op8_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the id files and a digest of its ids, read back from the files."""
    path = f"{scratch_dir(spark).rstrip('/')}/planes-{uuid.uuid4().hex}"
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    planes.write_ids(_table(spark, sf_dir, "documents"), path, tokenizer, end_id=2)
    read = planes.read_ids(spark, path)
    return read.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform shuffle of all documents into eight shards whose row counts differ by one at most."""
    placed = shards.shuffle_into_shards(_table(spark, sf_dir, "documents"), 8, seed=9)
    return placed.select(
        "doc_id",
        (F.octet_length(_text()) + 1).cast("long").alias("size"),
        F.crc32(_text().cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the log-likelihood verdict of every document."""
    judged = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", "kept", "score")


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings, their errors, and a digest of the codebooks."""
    coded, books = codes.compress(_table(spark, sf_dir, "embeddings"))
    summed = codes.with_group_sums(coded, "label")
    return summed.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _assigned(of: str) -> str:
    return f"""SELECT rid, p, min({{'d': (list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::BIGINT, 'e': e}}) AS best
    FROM pieces JOIN {of} USING (p) GROUP BY ALL"""


def _updated(assigned: str, of: str) -> str:
    return f"""SELECT p, e, coalesce(m, c) AS c FROM {of} LEFT JOIN (
        SELECT p, e, list(m ORDER BY i) AS m FROM (
            SELECT p, e, i, floor(sum(v) / count(*))::DOUBLE AS m FROM (
                SELECT p, best.e AS e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM {assigned} JOIN pieces USING (rid, p)
            ) GROUP BY ALL
        ) GROUP BY ALL
    ) USING (p, e)"""


OP11_SQL = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS rid, vec_id, label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), pieces AS MATERIALIZED (SELECT rid, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS x FROM kept, range(16) r(p)
), c0 AS MATERIALIZED (SELECT p, rid AS e, x AS c FROM pieces WHERE rid < 64
), a0 AS MATERIALIZED ({_assigned("c0")}), c1 AS MATERIALIZED ({_updated("a0", "c0")}
), a1 AS MATERIALIZED ({_assigned("c1")}), c2 AS MATERIALIZED ({_updated("a1", "c1")}
), a2 AS MATERIALIZED ({_assigned("c2")}
), coded AS (SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a2 GROUP BY 1
), digest AS (
    SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS h
    FROM (SELECT p, e, unnest(c) AS v, generate_subscripts(c, 1) AS i FROM c2)
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (rid), digest
"""


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    return html.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and place in the draw of every document, with the benchmark as target."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = resampling.resample(docs, _table(spark, sf_dir, "benchmark").select("text"), drop=("text",))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


OP13_SQL = r"""
WITH table256 AS (
    SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t
    FROM range(256) r(b)
), texts AS (
    SELECT 'd' AS kind, row_number() OVER () AS row, doc_id, text FROM documents
    UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark
), words AS (
    SELECT kind, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
    FROM texts
), counted AS (SELECT kind, row, w, count(*) AS n FROM words GROUP BY ALL
), bytes AS (
    SELECT w, [('0x' || hex(encode(w))[2 * i - 1 : 2 * i])::BIGINT FOR i IN range(1, octet_length(encode(w)) + 1)] AS x
    FROM (SELECT DISTINCT w FROM words)
), hashed AS (
    SELECT w, xor(list_reduce(x, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
    FROM bytes, table256
), filled AS (SELECT kind, row, bucket, n FROM counted JOIN hashed USING (w)
), shares AS (
    SELECT b AS bucket, coalesce(sum(n) FILTER (WHERE kind = 'd'), 0) AS s, coalesce(sum(n) FILTER (WHERE kind = 'b'), 0) AS t
    FROM range(10000) r(b) LEFT JOIN filled ON bucket = b GROUP BY 1
), gain AS (
    SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE))::BIGINT AS g
    FROM shares
), weights AS (
    SELECT row, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM filled JOIN gain USING (bucket)
    WHERE kind = 'd' GROUP BY 1
), scores AS (
    SELECT doc_id, row, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE)
            / 4294967296::DOUBLE)))::BIGINT AS score
    FROM texts LEFT JOIN weights USING (row) WHERE kind = 'd'
), ranks AS (
    SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id) AS r,
        count(*) FILTER (WHERE n_features >= 20) OVER () AS eligible FROM scores
)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= eligible * 10 // 100 THEN r END AS rank FROM ranks
"""


OPERATORS = (op1_bpe, op2_embedding_dedup, op3_token_counts, op4_line_dedup, op5_minhash, op6_packing, op7_lm_score, op8_planes, op9_sharding, op10_quality, op11_codes, op12_main_text, op13_resampling)
QUERIES = {f.__name__: f for f in OPERATORS}
ORACLE = {"op2_embedding_dedup": OP2_SQL, "op4_line_dedup": OP4_SQL, "op5_minhash": OP5_SQL, "op7_lm_score": OP7_SQL, "op11_codes": OP11_SQL, "op13_resampling": OP13_SQL}
