"""Vocabulary, sub-sampling, noise and context tables over conversation turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.rand import uniform_sql
from graphloom.operators import embed, windows
from graphloom.operators import word2vec as W2V
from graphloom.operators.detect import pack_by_budget
from graphloom.operators.prefix import positions
from graphloom.plans.base import TOKENS, query, read, sentences

WITH = f"WITH {TOKENS}"
VOCAB = "cnt AS (SELECT token, count(*) AS cnt FROM tok GROUP BY token HAVING count(*) >= 3), voc AS (SELECT token, cnt, row_number() OVER (ORDER BY cnt DESC, token) - 1 AS idx FROM cnt)"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.tokens(sentences(spark, sf_dir), "sentence", "text")


def _vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.vocabulary(embed.counts(_tokens(spark, sf_dir), 3))


@query(f"{WITH} SELECT token, count(*) AS cnt FROM tok GROUP BY token")
def g17_vocabulary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.counts(_tokens(spark, sf_dir))


@query(f"{WITH}, {VOCAB} SELECT token, cnt, idx FROM voc")
def r2_l10_sorted_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocab(spark, sf_dir)


@query(f"{WITH}, {VOCAB}, t AS (SELECT sum(cnt) * 0.001::DOUBLE AS t FROM voc) SELECT token, cnt, round(least(1.0, (sqrt(cnt / t) + 1) * (t / cnt)), 9) AS keep_prob FROM voc, t")
def g18_sampling_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.sampling(_vocab(spark, sf_dir)).select("token", "cnt", F.round("keep_prob", 9).alias("keep_prob"))


@query(f"{WITH}, {VOCAB} SELECT token, cnt, round(least(1.0, (sqrt(cnt / 26.0) + 1) * (26.0 / cnt)), 9) AS keep_prob FROM voc")
def g18_sampling_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.sampling(_vocab(spark, sf_dir), 10).select("token", "cnt", F.round("keep_prob", 9).alias("keep_prob"))


@query(f"{WITH}, {VOCAB} SELECT token, idx, CAST(round_even(sum(pow(cnt, 0.75)) OVER (ORDER BY idx) / sum(pow(cnt, 0.75)) OVER () * 1000, 0) AS BIGINT) AS cum FROM voc")
def g19_noise_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.noise_table(_vocab(spark, sf_dir), domain=1000).select("token", "idx", "cum")


@query(f"{WITH} SELECT sentence, token, pos, context_pos, context FROM (SELECT a.*, b.pos AS context_pos, b.token AS context FROM tok a JOIN tok b USING (sentence) WHERE a.pos <> b.pos AND abs(a.pos - b.pos) <= 4 - a.pos % 4)")
def w10_context_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = _tokens(spark, sf_dir)
    out = windows.context_pairs(tok, 4, F.pmod("pos", F.lit(4)))
    return out.select("sentence", "token", F.col("pos").cast("long").alias("pos"), F.col("context_pos").cast("long").alias("context_pos"), "context")


@query(f"{WITH}, {VOCAB}, p AS (SELECT a.sentence, a.pos, b.token AS context FROM tok a JOIN tok b USING (sentence) WHERE a.pos <> b.pos AND abs(a.pos - b.pos) <= 4 - a.pos % 4) SELECT sentence, pos, count(*) AS n, round(avg(idx), 9) AS mean_idx, CAST(sum(idx) AS BIGINT) AS sum_idx FROM p JOIN voc ON voc.token = context GROUP BY ALL")
def w11_context_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = _tokens(spark, sf_dir).join(_vocab(spark, sf_dir).select("token", "idx"), "token", "left")
    rows = windows.context_pairs(tok, 4, F.pmod("pos", F.lit(4)), token="idx").where("context IS NOT NULL").withColumnRenamed("context", "_idx")
    return rows.groupBy("sentence", F.col("pos").cast("long").alias("pos")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("_idx"), 9).alias("mean_idx"), F.sum("_idx").alias("sum_idx"))



@query(f"""WITH RECURSIVE {TOKENS}, s AS (SELECT sentence // 1000 AS part, sentence, count(*) AS n, row_number() OVER (PARTITION BY sentence // 1000 ORDER BY sentence) AS r FROM tok GROUP BY sentence),
g AS (SELECT part, sentence, r, 0 AS batch, n AS used FROM s WHERE r = 1 UNION ALL SELECT s.part, s.sentence, s.r, CASE WHEN used > 0 AND used + n > 100 THEN batch + 1 ELSE batch END, CASE WHEN used > 0 AND used + n > 100 THEN n ELSE used + n END FROM g JOIN s ON s.part = g.part AND s.r = g.r + 1)
SELECT part, sentence, CAST(batch AS BIGINT) AS batch FROM g""")
def w13_packed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation packed into batches of 100 words, a conversation a part."""
    sizes = _tokens(spark, sf_dir).groupBy("sentence").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.floor(F.col("sentence") / 1000))
    return pack_by_budget(sizes, 100)


@query(f"""WITH RECURSIVE {TOKENS}, {VOCAB}, h AS (SELECT list_sort(list(cnt)) AS l, 0::BIGINT AS cost FROM voc UNION ALL SELECT list_sort(list_append(l[3:], l[1] + l[2])), cost + l[1] + l[2] FROM h WHERE len(l) > 1)
SELECT (SELECT count(*) FROM voc) AS words, CAST(max(cost) AS BIGINT) AS cost, 1.0::DOUBLE AS kraft, true AS prefix_free FROM h""")
def g20_huffman_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes are optimal: their cost is what merging the two least counts again and again costs; and no code begins another."""
    vocab = _vocab(spark, sf_dir)
    codes = spark.createDataFrame(embed.huffman(vocab), "token string, code string")
    follows = F.lead("code").over(Window.orderBy("code"))  # one row a word of a vocabulary that fits the driver
    rows = codes.join(vocab, "token").withColumn("_starts", F.coalesce(follows.startswith(F.col("code")), F.lit(False)))
    return rows.agg(F.count(F.lit(1)).alias("words"), F.sum(F.col("cnt") * F.length("code")).alias("cost"), F.sum(F.pow(F.lit(2.0), -F.length("code"))).alias("kraft"), (~F.bool_or("_starts")).alias("prefix_free"))


@query(f"{WITH}, {VOCAB}, t AS (SELECT sum(cnt) * 0.001::DOUBLE AS t FROM voc), k AS (SELECT token, least(1.0, (sqrt(cnt / t) + 1) * (t / cnt)) AS p FROM voc, t) SELECT sentence, pos, token FROM tok JOIN k USING (token) WHERE {uniform_sql(9, 'sentence', 'pos')} < p")
def l11_kept_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embed.kept(_tokens(spark, sf_dir), embed.sampling(_vocab(spark, sf_dir)), 9)
    return rows.select("sentence", F.col("pos").cast("long").alias("pos"), "token")


@query("SELECT CAST(e AS BIGINT) AS epoch, round(greatest(0.0001, 0.025 - (0.025 - 0.0001) * e / 5.0), 9) AS rate FROM range(8) t(e)")
def p30_learning_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(8).select(F.col("id").alias("epoch"), F.round(embed.learning_rate(F.col("id") / 5.0), 9).alias("rate"))


@query(f"{WITH}, {VOCAB}, n AS (SELECT count(*) AS n FROM voc) SELECT n AS words, n * (500 + 512) AS sampled, n * (700 + 512) AS coded, n * (700 + 768) AS both FROM n")
def p31_memory_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input vectors with negative sampling's matrix, with hierarchical softmax's, and with both."""
    n = _vocab(spark, sf_dir).agg(F.count(F.lit(1)).alias("words"))
    kinds = {"sampled": (2, False), "coded": (2, True), "both": (3, True)}
    return n.select("words", *(embed.model_bytes(F.col("words"), 64, *k).alias(c) for c, k in kinds.items()))


@query(f"{WITH}, {VOCAB} SELECT token, CAST(i AS BIGINT) AS i, round(({uniform_sql(1, 'token', 'i')} - 0.5) / 4, 9) AS x FROM voc, range(4) t(i)")
def c11_initial_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.initial_vectors(_vocab(spark, sf_dir), 4).select("token", F.posexplode("vec").alias("i", "x")).select("token", F.col("i").cast("long").alias("i"), F.round("x", 9).alias("x"))


@query("SELECT token, CAST(CASE WHEN v2 THEN 2 ELSE 1 END AS BIGINT) AS version FROM (SELECT DISTINCT event_type AS token, event_type IN ('click', 'view') AS v2 FROM events)")
def c12_upserted_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = read(spark, sf_dir, "events").select(F.col("event_type").alias("token")).distinct().withColumn("version", F.lit(1).cast("long"))
    new = store.where("token in ('click', 'view')").withColumn("version", F.explode(F.array(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    return embed.upsert(store, new)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0")
def s8_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k")).where("k % 2 = 0")


@query("SELECT doc_id, 'img_' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.jpg' AS path FROM documents")
def p29_padded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.functions.box import zero_padded_path

    return read(spark, sf_dir, "documents").select("doc_id", zero_padded_path("img_", F.col("doc_id")).alias("path"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' ELSE lang END AS lang FROM documents")
def j12_mapped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.operators.joins import mapped

    return mapped(read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", {"en": "english", "de": "german"})


@query("SELECT a.doc_id, b.doc_id AS other FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS pos FROM labels) a JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS pos FROM labels) b USING (pos)")
def j13_positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").select("doc_id")
    a, b = positions(rows, "doc_id"), positions(rows, "doc_id", descending=True).withColumnRenamed("doc_id", "other")
    return a.join(b, "pos").select("doc_id", "other")


DOMAIN = 1000
SGNS = """g{n} AS (SELECT pr.src, pr.dst, (label - 1 / (1 + exp(-list_dot_product(i.vec, o.vec)))) * 0.05 AS g, i.vec AS u, o.vec AS o FROM pr JOIN i{n} i ON i.idx = pr.src JOIN o{n} o ON o.idx = pr.dst),
di{m} AS (SELECT src AS idx, sum(g * o[1]) AS a, sum(g * o[2]) AS b FROM g{n} GROUP BY src), do{m} AS (SELECT dst AS idx, sum(g * u[1]) AS a, sum(g * u[2]) AS b FROM g{n} GROUP BY dst),
i{m} AS (SELECT idx, [vec[1] + coalesce(a, 0), vec[2] + coalesce(b, 0)] AS vec FROM i{n} LEFT JOIN di{m} USING (idx)), o{m} AS (SELECT idx, [vec[1] + coalesce(a, 0), vec[2] + coalesce(b, 0)] AS vec FROM o{n} LEFT JOIN do{m} USING (idx))"""


@query(f"""{WITH}, {VOCAB}, ns AS (SELECT idx, CAST(round_even(sum(pow(cnt, 0.75)) OVER (ORDER BY idx) / sum(pow(cnt, 0.75)) OVER () * {DOMAIN}, 0) AS BIGINT) AS cum FROM voc),
slots AS (SELECT unnest(range(coalesce(prev, 0), cum)) AS slot, idx FROM (SELECT idx, cum, lag(cum) OVER (ORDER BY idx) AS prev FROM ns)),
v AS (SELECT sentence, pos, idx FROM tok JOIN voc USING (token)),
p AS (SELECT a.sentence, a.pos, b.pos AS cp, a.idx AS src, b.idx AS dst FROM v a JOIN v b USING (sentence) WHERE a.pos <> b.pos AND abs(a.pos - b.pos) <= 4 - a.pos % 4),
pr AS MATERIALIZED (SELECT src, dst, 1.0::DOUBLE AS label FROM p UNION ALL SELECT src, idx, 0.0 FROM (SELECT src, dst, floor({uniform_sql(7, 'sentence', 'pos', 'cp', 'j')} * {DOMAIN}) AS slot FROM p, range(1, 4) t(j)) JOIN slots USING (slot) WHERE idx <> dst),
i0 AS (SELECT idx, [({uniform_sql(1, 'token', '0')} - 0.5) / 2, ({uniform_sql(1, 'token', '1')} - 0.5) / 2] AS vec FROM voc), o0 AS (SELECT idx, [0.0, 0.0]::DOUBLE[] AS vec FROM voc),
{SGNS.format(n=0, m=1)}, {SGNS.format(n=1, m=2)} SELECT idx, round(vec[1], 7) AS x, round(vec[2], 7) AS y FROM i2""")
def c11_negative_sampling_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two gradient steps of skip-grams with three negative samples a pair, over all pairs, from the vector tables."""
    vocab = _vocab(spark, sf_dir)
    slots = W2V.noise_slots(embed.noise_table(vocab, domain=DOMAIN))
    rows = _tokens(spark, sf_dir).join(vocab.select("token", "idx"), "token").select("sentence", "pos", "idx")
    pairs = windows.context_pairs(rows, 4, F.pmod("pos", F.lit(4)), token="idx").select("sentence", "pos", "context_pos", F.col("idx").alias("src"), F.col("context").alias("dst"))
    pairs = W2V.with_negatives(pairs, slots, DOMAIN, 3, 7, F.col("sentence"), F.col("pos"), F.col("context_pos"))
    inputs = embed.initial_vectors(vocab, 2).join(vocab.select("token", "idx"), "token").select("idx", "vec")
    outputs = inputs.select("idx", F.transform("vec", lambda x: F.lit(0.0)).alias("vec"))
    for _ in range(2):
        inputs, outputs = W2V.sgns_step(pairs, inputs, outputs, 0.05, 2)
    return inputs.select("idx", F.round(F.get("vec", F.lit(0)), 7).alias("x"), F.round(F.get("vec", F.lit(1)), 7).alias("y"))


@query()
def c11_word2vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W2V.Word2Vec(8, min_count=3, sg=True, epochs=1, hs=True, negative=0).fit(_tokens(spark, sf_dir)).vectors


@query()
def c11_cbow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W2V.Word2Vec(8, min_count=3, epochs=2).fit(_tokens(spark, sf_dir)).vectors
