"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import collocations, crf, forest, hmm, iblt, licenses, packing, pieces, resample, simhash, suffix, warc, wavelet
from riskloom.llm.common import crc_of_id, stored
from riskloom.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden Markov score of every text; learns from those whose crc32 of the id mod 7 isn't 2."""
    return hmm.score(table(spark, sf_dir, "documents"), held_out=crc_of_id("doc_id") % 7 == 2)


@query
def op2_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text; learns from labelled texts whose crc32 of the id mod 4 isn't 2."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(crc_of_id("doc_id") % 4 == 2, F.lit(False)))
    model = crf.fit_on(docs.where(~F.col("held_out")), "text", "lang")
    return crf.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


@query
def op3_piece_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text with the end id, and their decoding, as digests."""
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op8_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, written to wavelet shards and read back from them."""
    return wavelet.read_documents(wavelet.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


@query
def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.clusters(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexed().alias("fingerprint"), "component_id")


@query
def op5_iblt_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketch fingerprints of every text and its edited text, and how alike they are."""
    found = iblt.edited_likeness(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without strings of 400 bytes that occur again.

    n_passage_bytes: the bytes that those or repeated strings of 51 words cover.
    """
    found = suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), passage=51)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"), "n_passage_bytes")


@query
def op7_forest_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows, by inner product, of every row whose vec_id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return forest.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


@query
def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page, with a digest of each record's bytes."""
    made = warc.build(table(spark, sf_dir, "pages"))
    return made.withColumn("record_sha256", F.sha2("record", 256)).drop("record")


@query
def op10_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bin, place and start of every document (or piece of a long one) in bins of 2,048 words."""
    return packing.pack(stored(packing.sizes(table(spark, sf_dir, "documents")), "sizes"))


@query
def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document in a draw of a tenth towards the benchmark's words."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 best phrases of 2 to 5 words that occur at least 100 times."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases of every document, and the labels of verified notices."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


ORACLE_SQL["op11_importance_resample"] = r"""
    WITH RECURSIVE c(i, k, v) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM c WHERE k < 8),
      crc AS (SELECT list(v ORDER BY i) AS t FROM c WHERE k = 8),
      w AS (SELECT src, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
            FROM (SELECT 's' AS src, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark)),
      n AS (SELECT src, id, word, count(*) AS n FROM w GROUP BY ALL),
      b AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::BIGINT for i in range(1, strlen(word) + 1)]), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT word FROM n), crc),
      h AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE src = 's'), 0) AS s, coalesce(sum(n) FILTER (WHERE src = 't'), 0) AS t FROM n JOIN b USING (word) GROUP BY bucket),
      g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM h),
      d AS (SELECT id, sum(n) AS f, sum(n * gain) AS weight FROM n JOIN b USING (word) JOIN g USING (bucket) WHERE src = 's' GROUP BY id),
      e AS (SELECT doc_id, coalesce(f, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM documents LEFT JOIN d ON id = doc_id),
      r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS all_long FROM e WHERE n_features >= 20)
    SELECT e.doc_id, n_features, weight, score, CASE WHEN rank <= floor(all_long * 10 / 100) THEN rank END AS rank FROM e LEFT JOIN r USING (doc_id)"""

ORACLE_SQL["op12_phrase_collocations"] = r"""
    WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
      w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
      g AS (SELECT lang, m, words[i:i + m - 1] AS part FROM w, range(1, 6) t(m), unnest(range(1, len(words) - m + 2)) u(i)),
      f AS (SELECT lang, part, m, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100 OR m = 1),
      n AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE m = 1 GROUP BY lang),
      c AS (SELECT lang, part, m, f AS a FROM f WHERE m > 1 AND f >= 100),
      kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c longer WHERE longer.lang = c.lang AND longer.m > c.m AND 100 * longer.a >= 100 * c.a AND contains(' ' || array_to_string(longer.part, ' ') || ' ', ' ' || array_to_string(c.part, ' ') || ' '))),
      k AS (SELECT kept.lang, kept.part, a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
            FROM kept JOIN n USING (lang), range(1, 5) t(k), f x, f y WHERE k < kept.m AND x.lang = kept.lang AND y.lang = kept.lang AND x.part = kept.part[1:k] AND y.part = kept.part[k + 1:]),
      best AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, part ORDER BY score, k) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
    FROM (SELECT *, array_to_string(part, ' ') AS phrase FROM best) QUALIFY rank <= 2000"""
