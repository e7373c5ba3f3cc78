"""The corpus operators as queries over the driver's tables, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, fim, langid, lexical_search, licenses, line_dedup, media, packing, simhash, substring_dedup, token_counts, url_filter, vector_search

VOCABULARY = "word_bpe_49k.json"
RULES = [
    url_filter.Rule("allow", "com"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), VOCABULARY, with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.train_held_out(F.col("doc_id"))
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.histogram(token_counts.lengths(table(spark, sf_dir, "documents"), VOCABULARY))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.features(media.store(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    by_doc = found.groupBy("doc_id", "row_hash").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("containment").alias("containment"), F.min("consistency").alias("consistency"))
    return by_doc.select("doc_id", "item_ids", "containment", "consistency")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    digest = fim.restored(F.col("output"), F.col("form"))["sha256"]
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", digest.alias("restored_sha256"))


def op12_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing, op2_simhash, op3_url_filter, op4_language_id, op5_token_counts, op6_substring_dedup, op7_media, op8_decontamination, op9_licenses, op10_line_dedup,
        op11_fill_in_middle, op12_vector_search, op13_lexical_search, pipeline,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM parts
), split AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM split JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN fits USING (page_id)
""",
    "op6_substring_dedup": r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, s, sha256(array_to_string(w[s : s + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS s FROM docs WHERE len(w) >= 50)
), firsts AS (
  SELECT h, min(doc_id) AS first_doc FROM windows GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(s, s + 49)) AS p FROM windows JOIN firsts USING (h) WHERE first_doc < doc_id
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM docs
), kept AS (
  SELECT words.doc_id, count(*) AS n_words, count(gone.p) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL), '') AS text
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY words.doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
""",
    "op11_fill_in_middle": r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(cast(doc_id AS varchar), '')) AS seed,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents
), drawn AS (
  SELECT doc_id, text, units, len(units) AS n,
         cast('0x' || seed[1:8] AS bigint) % (len(units) + 1) AS c1, cast('0x' || seed[9:16] AS bigint) % (len(units) + 1) AS c2,
         cast('0x' || seed[17:24] AS bigint) AS h3, cast('0x' || seed[25:32] AS bigint) AS h4 FROM docs
), formed AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                 WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, array_to_string(units[1 : least(c1, c2)], '') AS p, array_to_string(units[least(c1, c2) + 1 : greatest(c1, c2)], '') AS m,
         array_to_string(units[greatest(c1, c2) + 1 : n], '') AS s FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM parts
""",
    "op12_vector_search": """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), ranked AS (
  SELECT q.vec_id AS query_id, v.vec_id, cast(list_inner_product(q.e, v.e) AS bigint) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, v.e) DESC, v.vec_id) AS rank
  FROM whole q JOIN whole v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id
)
SELECT query_id, cast(rank AS integer) AS rank, vec_id, score FROM ranked WHERE rank <= 10
""",
    "op13_lexical_search": r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), counts AS (
  SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term
), lengths AS (
  SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
), corpus AS (
  SELECT count(*) AS docs, sum(n)::bigint AS terms FROM lengths
), frequency AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint AS w FROM counts, corpus GROUP BY term, docs
), asked AS (
  SELECT item_id, term, count(*) AS c FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term
), sizes AS (
  SELECT doc_id, 100 - 75 + ((75 * n * docs) // terms) AS m FROM lengths, corpus
), scored AS (
  SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint AS score
  FROM asked JOIN frequency USING (term) JOIN counts USING (term) JOIN sizes USING (doc_id) GROUP BY item_id, doc_id
)
SELECT item_id, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS integer) AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
""",
}
