"""One registered query an operator, over its whole table with production parameters."""

import public_tokenizers
from pyspark.sql import functions as F

from threatloom.llm import alignment, decontam, fast_sketch, html_text, license_scan, packing, quality, secret_scan, sharding, simhash, token_counts, token_store, whitening
from threatloom.llm.common import new_folder, table

# The tokenizer files of the queries; operators take their paths as parameters.
TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op1_license_scan(spark, sf_dir):
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op2_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_simhash(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op4_decontamination(spark, sf_dir):
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_secret_scan(spark, sf_dir):
    return secret_scan.secret_digest(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op6_quality_rules(spark, sf_dir):
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


def op7_token_counts(spark, sf_dir):
    return token_counts.count_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return sharding.place(docs, SHARDS).select("doc_id", "slot", "shard")


def op9_token_store(spark, sf_dir):
    folder = new_folder(spark, "token-store")
    token_store.write_token_store(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER))
    return token_store.read_token_store(spark, folder).withColumnRenamed("id", "doc_id")


def op10_html_extraction(spark, sf_dir):
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op11_tokenizer_alignment(spark, sf_dir):
    paths = public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES)
    return alignment.align(table(spark, sf_dir, "documents"), *paths, hashed=True)[0].withColumnRenamed("groups", "groups_sha256")


def op12_embedding_whitening(spark, sf_dir):
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))


def op13_minhash(spark, sf_dir):
    return fast_sketch.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_packing, op3_simhash, op4_decontamination, op5_secret_scan, op6_quality_rules, op7_token_counts, op8_sharding, op9_token_store, op10_html_extraction, op11_tokenizer_alignment, op12_embedding_whitening, op13_minhash)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# The lookup table as text, two digits a slot: filling it takes turns, which SQL does not.
_PLACES = "".join(f"{shard:02d}" for shard in sharding.lookup_table(SHARDS))

ORACLES = {
    "op4_decontamination": rf"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS s, least(10, len(w)) AS k
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
place AS (
  SELECT r, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s
  FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM doc, sizes WHERE len(w) >= k)),
hit AS (SELECT r, i, win.k, item_id FROM place JOIN win ON win.s = place.s AND win.k = place.k),
words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, words.n IS NOT NULL AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op8_sharding": f"""
SELECT doc_id, CAST(slot AS INTEGER) AS slot, CAST(substr('{_PLACES}', 2 * slot + 1, 2) AS INTEGER) AS shard
FROM (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {sharding.TABLE_SLOTS} AS slot FROM documents)""",
    "op6_quality_rules": rf"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
line AS (SELECT r, source, t, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n, trim(regexp_replace(
    translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
  FROM (SELECT r, source, t, unnest(string_split(t, chr(10))) AS l FROM doc) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, sum(c - 1) AS n FROM (SELECT r, l, count(*) AS c FROM line GROUP BY r, l) GROUP BY r),
uniq AS (SELECT source, t, min(r) AS r FROM doc GROUP BY source, t),
held AS (SELECT r, source, norm, sum(n) AS n FROM line JOIN uniq USING (r, source) GROUP BY r, source, norm),
top AS (SELECT *, substr(md5(norm), 1, 15) AS h FROM held JOIN (SELECT source, norm, count(*) AS c FROM held GROUP BY source, norm) USING (source, norm) WHERE c > {quality.LEAST_DOCS}),
middle AS (SELECT r, arg_min(h, upto) AS name FROM (SELECT r, h, sum(n) OVER (PARTITION BY r ORDER BY c DESC, h) AS upto FROM top)
  JOIN doc USING (r) WHERE 2 * upto >= len(w) GROUP BY r),
host AS (SELECT source, count(DISTINCT coalesce(name, CAST(r AS VARCHAR) || ' alone')) AS docs FROM uniq LEFT JOIN middle USING (r) GROUP BY source),
often AS (SELECT source, norm FROM (SELECT source, norm, count(DISTINCT coalesce(name, CAST(r AS VARCHAR) || ' alone')) AS c FROM top LEFT JOIN middle USING (r) GROUP BY source, norm)
  JOIN host USING (source) WHERE c > greatest({quality.LEAST_DOCS}, {quality.SHARE} * docs)),
gone AS (SELECT r, sum(n) AS n FROM line JOIN often USING (source, norm) GROUP BY r),
win AS (SELECT r, i, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - 4)) AS i FROM doc WHERE len(w) >= 5)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + 4)) AS p
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed
  FROM doc LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR n_words - n_removed < {quality.KEPT_WORDS} * n_words) AS kept FROM m""",
}
