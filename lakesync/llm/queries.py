"""The queries of the thirteen operators and of the pipeline, and the SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lakesync.llm import bytebpe, centroids, decontam, hmm, jaccard, langid, media, packing, pii, sharding, spelling, tokencount, toxicity
from lakesync.llm.common import crc_bucket, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(toxicity.labelled_sample(docs, table(spark, sf_dir, "labels")))
    scores = toxicity.score(docs, model)
    return scores.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bytebpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs.drop("lang"), model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", F.size("near").cast("long").alias("n_near"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = pii.find_spans(table(spark, sf_dir, "documents"))
    of_kind = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [of_kind(kind).alias(f"n_{kind}") for kind in pii.KINDS]
    base, all_spans = pii.spans_text(F.col("spans")), pii.spans_text(F.concat("spans", "terms"))
    return spans.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), all_spans.alias("spans"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_copies", "n_links", "n_texts")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), media.pad_payload(F.col("text")).alias("payload"))
    stored = padded.select("doc_id", "n_bytes", media.declare(F.col("payload")).alias("declared"), media.contain(F.col("payload")).alias("media"))
    found = media.sniff(stored.withColumn("doc_id", F.struct("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"))))
    carved = lambda x: F.concat_ws(":", x["type"], x["offset"].cast("string"), x["length"].cast("string"))
    return found.select(
        "doc_id.doc_id",
        "doc_id.n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2(F.col("samples"), 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -16, 16)).alias("tail_crc32"),
        "doc_id.media_bytes",
        "media_sha256",
        F.concat_ws(";", F.concat(F.lit("type="), "true_type"), "feature").alias("feature"),
        "declared",
        (F.col("declared") != F.col("true_type")).alias("corrected"),
        F.array_join(F.transform(F.concat("embedded", "inside"), carved), ",").alias("carved"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), 7) == 2, F.lit(False))
    scores = hmm.score(table(spark, sf_dir, "documents").select("doc_id", "text", (~held_out).alias("trains")))
    return scores.select("doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


_OPERATORS = (
    op1_toxicity, op2_byte_bpe, op3_language_id, op4_decontamination, op5_pii, op6_jaccard_join, op7_media, op8_token_counts, op9_sharding, op10_lm_scoring,
    op11_packing, op12_centroids, op13_spelling,
)


def queries() -> dict:
    return {f.__name__: f for f in _OPERATORS} | {"pipeline": corpus_pipeline.run}


#: The same rows as op4_decontamination: windows of ten item words, or a whole shorter item, looked up among the documents' own runs;
#: n_near from all pairs of places of a window's two rarest terms.
OP4_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + 9], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)
), run AS (
  SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM w, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (SELECT doc_id, k, run.n, item_id FROM run JOIN win ON run.g = win.g AND run.n = win.n),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
tok AS (SELECT r, unnest(w) AS term, unnest(range(len(w))) AS pos FROM w),
cf AS (SELECT term, count(*) AS cf FROM tok GROUP BY term),
own AS (SELECT array_to_string(w, ' ') AS seq, unnest(w) AS term, unnest(range(len(w))) AS p FROM (SELECT DISTINCT w FROM i WHERE len(w) > 0)),
spot AS (SELECT seq, k, least(len, 10) AS n, p, term FROM (SELECT seq, len, unnest(range(0, greatest(len - 9, 1))) AS k FROM (SELECT seq, count(*) AS len FROM own GROUP BY seq)) JOIN own USING (seq) WHERE p BETWEEN k AND k + 9),
rare AS (SELECT seq, k, n, list({'cf': cf, 'p': p, 'term': term} ORDER BY cf, p) AS l FROM spot JOIN cf USING (term) GROUP BY seq, k, n),
pair AS (SELECT DISTINCT seq, l[1].p AS pa, l[1].term AS ta, coalesce(l[2], l[1]).p AS pb, coalesce(l[2], l[1]).term AS tb FROM rare WHERE len(l) = n),
close AS (
  SELECT DISTINCT a.r, seq FROM pair JOIN tok a ON a.term = ta JOIN tok b ON b.r = a.r AND b.term = tb WHERE abs((a.pos - pa) - (b.pos - pb)) <= 5
), near AS (
  SELECT r, count(DISTINCT item_id) AS n_near FROM close JOIN i ON len(w) > 0 AND array_to_string(w, ' ') = seq GROUP BY r
)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM w LEFT JOIN items ON items.doc_id = w.doc_id LEFT JOIN places ON places.doc_id = w.doc_id LEFT JOIN near ON near.r = w.r
"""


def _words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


#: The same rows as op6_jaccard_join: all pairs of sets that share a run of words, compared, and the components of what is linked.
OP6_SQL = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, {_words("text")} AS w FROM documents
), gram AS (
  SELECT DISTINCT r, doc_id, array_to_string(w[k : k + 4], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0)
), own AS (SELECT r, doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS s, count(*) AS n FROM gram GROUP BY r, doc_id
), sets AS (SELECT s, n, count(*) AS copies, min(doc_id) AS first, min(r) AS r FROM own GROUP BY s, n
), of_set AS (SELECT s, g FROM sets JOIN gram USING (r)
), common AS (SELECT a.s AS a, b.s AS b, count(*) AS k FROM of_set a JOIN of_set b ON a.g = b.g AND a.s <> b.s GROUP BY a.s, b.s
), link AS (SELECT a, b, y.copies FROM common JOIN sets x ON x.s = a JOIN sets y ON y.s = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9
), reach AS (SELECT s AS a, s AS b FROM sets UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
), class AS (SELECT reach.a AS s, min(first) AS class_id FROM reach JOIN sets ON sets.s = reach.b GROUP BY reach.a
), links AS (SELECT a AS s, sum(copies) AS docs, count(*) AS texts FROM link GROUP BY a)
SELECT doc_id, class_id, copies AS n_copies, CAST(copies - 1 + coalesce(docs, 0) AS BIGINT) AS n_links, CAST(coalesce(texts, 0) AS BIGINT) AS n_texts
FROM own JOIN sets USING (s) JOIN class USING (s) LEFT JOIN links USING (s)
UNION ALL SELECT doc_id, doc_id, 1, 0, 0 FROM w WHERE len(w) = 0
"""


def _le4(number: str) -> str:
    """A whole number as four little-endian bytes."""
    return "unhex(format('{:02x}{:02x}{:02x}{:02x}', " + ", ".join(f"({number} >> {8 * i}) & 255" for i in range(4)) + "))"


def _hex(raw: str) -> str:
    return f"unhex('{raw}')"


_STEP = "lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
#: The same rows as op7_media but for `carved`, which is empty: texts of these tables hold no media. crc32 bit by bit.
OP7_SQL = f"""
WITH raw AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents
), padded AS (SELECT doc_id, octet_length(raw) AS n_bytes, raw || encode(repeat(' ', CAST(greatest(ceil(octet_length(raw) / 192), 1) * 192 - octet_length(raw) AS INTEGER))) AS p FROM raw
), sized AS (SELECT *, CAST(octet_length(p) AS BIGINT) AS n, hex(p) AS h, CAST('0x' || substr(md5(p), 1, 1) AS INTEGER) % 2 = 0 AS sound, CAST('0x' || substr(md5(p), 2, 1) AS INTEGER) % 4 AS told FROM padded
), stored AS (
  SELECT *, CASE WHEN sound THEN {_hex("52494646")} || {_le4("(n + 36)")} || {_hex("57415645666d74201000000001000100401f0000401f00000100080064617461")} || {_le4("n")} || p
    ELSE {_hex("424d")} || {_le4("(n + 54)")} || {_hex("00000000360000002800000008000000")} || {_le4("(n // 24)")} || {_hex("0100180000000000")} || {_le4("n")} || {_hex("00" * 16)} || p END AS m,
    CASE WHEN sound THEN 'audio/wav' ELSE 'image/bmp' END AS kind, ['image/png', 'audio/wav', 'image/bmp', 'audio/ogg'][told + 1] AS declared,
    list_transform(range(0, n), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT)) AS b
  FROM sized
), felt AS (
  SELECT *, list_sum(list_transform(b, lambda x: x)) AS total, list_sum(list_transform(b, lambda x: (x - 128) * (x - 128))) AS power,
    len(list_filter(range(1, n), lambda i: (b[i] >= 128) <> (b[i + 1] >= 128))) AS crossings
  FROM stored
)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, n AS payload_bytes, sha256(p) AS payload_sha256,
  CAST(xor(list_reduce(list_prepend(4294967295, b[-16:]), lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), {_STEP})), 4294967295) AS BIGINT) AS tail_crc32,
  CAST(octet_length(m) AS BIGINT) AS media_bytes, sha256(m) AS media_sha256,
  'type=' || kind || ';n=' || n || ';mean=' || format('{{:.4f}}', CAST(total AS DOUBLE) / n) || ';rms=' || format('{{:.4f}}', sqrt(CAST(power AS DOUBLE) / n)) || ';crossings=' || crossings AS feature,
  declared, declared <> kind AS corrected, '' AS carved
FROM felt
"""


def _clusters_sql(k: int = centroids.K, rounds: int = centroids.ROUNDS, dims: int = centroids.DIMS) -> str:
    """The same rows as op12_centroids: every vector against every centroid, round by round."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({centroids.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
          FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), vec_id, q) - 1 AS c, q FROM kept ORDER BY c LIMIT {k})",
    ]
    for i in range(rounds + 1):
        d = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (kept.q[i] - c{i}.q[i]) * (kept.q[i] - c{i}.q[i])))"
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, min({{'d': CAST({d} AS BIGINT), 'c': c}}) AS m FROM kept, c{i} GROUP BY r)")
        if i < rounds:
            s = "list_sum(list_transform(qs, lambda x: x[i]))"
            steps.append(f"g{i} AS MATERIALIZED (SELECT m.c AS c, count(*) AS n, list(q) AS qs FROM a{i} JOIN kept USING (r) GROUP BY m.c)")
            mean = f"CAST(({s} - ({s} % n + n) % n) // n AS BIGINT)"
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(list_transform(range(1, {dims + 1}), lambda i: {mean}), c{i}.q) AS q FROM c{i} LEFT JOIN g{i} USING (c))")
    last = f"c{rounds}"
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
      sha256(array_to_string({last}.q, ',')) AS centroid_sha256
    FROM a{rounds} JOIN kept USING (r) JOIN {last} ON {last}.c = m.c"""


#: The same rows as op13_spelling: words that share what is left without one letter. crc32 by its table of 256 bytes.
OP13_SQL = f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), {_STEP}) AS v FROM range(256) x(i))
), run AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents
), own AS MATERIALIZED (SELECT doc_id, w, count(*) AS k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM run GROUP BY doc_id, w
), hashed AS (
  SELECT w, k, CAST(xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS INTEGER) + 1])), 4294967295) AS BIGINT) AS h FROM own, crc
), cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS w, k FROM hashed
), words AS MATERIALIZED (SELECT w, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE length(w) >= 5 GROUP BY w HAVING sum(k) >= 3
), less AS MATERIALIZED (SELECT w, n, i, substr(w, 1, CAST(i - 1 AS INTEGER)) || substr(w, CAST(i + 1 AS INTEGER)) AS d FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM words)
), near AS MATERIALIZED (
  SELECT a.w AS w, b.w AS o, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.d = b.d AND a.w <> b.w
  UNION SELECT less.w, words.w, words.n FROM less JOIN words ON d = words.w
  UNION SELECT words.w, less.w, less.n FROM less JOIN words ON d = words.w
), best AS (SELECT w, count(*) AS n_near, min({{'m': -m, 'o': o}}) AS b FROM near GROUP BY w
), forms AS MATERIALIZED (SELECT words.w, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 2 * n THEN b.o END AS form, CASE WHEN -b.m >= 2 * n THEN -b.m END AS form_n FROM words LEFT JOIN best USING (w)
), path AS (SELECT w, w AS here, form AS next FROM forms UNION ALL SELECT path.w, path.next, forms.form FROM path JOIN forms ON forms.w = path.next)
SELECT forms.w AS word, forms.form, here AS root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms JOIN path ON path.w = forms.w AND path.next IS NULL
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; the others are tested against brute force, round trips or held-out accuracy."""
    known = {"op4_decontamination": OP4_SQL, "op6_jaccard_join": OP6_SQL, "op7_media": OP7_SQL, "op12_centroids": _clusters_sql(), "op13_spelling": OP13_SQL}
    return known | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
