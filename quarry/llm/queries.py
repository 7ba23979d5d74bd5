"""The thin queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import embed_dedup, jaccard_groups, language_id, mixing, quality_classifier, quality_rules, sharding, sp_fst, token_files, url_filter
from quarry.llm.storage import fresh_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where the installed package of public tokenizers keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "tokens")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), folder, tokenizer_file("byte_bpe_50k.json"))
    return token_files.read_tokens(spark, folder)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_fst.encode_documents(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "slot", "shard")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups.jaccard_components(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_embedding_near_dedup, op2_quality_classifier, op3_url_filters, op4_token_files, op5_language_id,
        op6_quality_rules, op7_sentencepiece, op8_sharding, op9_mixing, op10_ngram_jaccard,
    )
    return {f.__name__: f for f in every}


def _sharding_sql() -> str:
    owner = sharding.lookup_table([f"shard-{i:05d}" for i in range(sharding.SHARDS)])
    return f"""
WITH placed AS (
  SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 't:' || coalesce(text, ''))), 1, 12))::BIGINT % {sharding.TABLE_SIZE} AS INTEGER) AS slot
  FROM documents),
owner AS (SELECT {owner} AS shards)
SELECT doc_id, slot, CAST(shards[slot + 1] AS INTEGER) AS shard FROM placed, owner"""


def _url_filter_sql() -> str:
    order, least, unit = url_filter.ORDER, url_filter.LEAST, url_filter.UNIT
    fits = "(host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '/{p}')"
    longest = sorted(url_filter.RULES, key=lambda r: (-len(r[1]), r[1]))
    cases = [(fits.format(d=text.partition("/")[0], p=text.partition("/")[2]), text, says) for says, text in longest]
    rule = "CASE " + " ".join(f"WHEN {when} THEN '{text}'" for when, text, _ in cases) + " END"
    says = "CASE " + " ".join(f"WHEN {when} THEN '{says}'" for when, _, says in cases) + " END"
    levels = [f"level{order} AS (SELECT gram, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM parts GROUP BY gram)"]
    for k in range(order - 1, -1, -1):
        levels.append(f"level{k} AS (SELECT substr(gram, 2) AS gram, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM level{k + 1} GROUP BY ALL)")
    for k in range(order + 1):
        below = ", ".join(f"{x}_p AS {x}_below" if k else f"1.0::DOUBLE / {url_filter.ALPHABET} AS {x}_below" for x in "ab")
        join = f" JOIN (SELECT gram AS shorter, {below} FROM model{k - 1}) m ON substr(l.gram, 2) = m.shorter" if k else ""
        seen = ", ".join(f"sum({x}) OVER w AS {x}_n, count(*) FILTER (WHERE {x} > 0) OVER w AS {x}_d" for x in "ab")
        smooth = ", ".join(f"CASE WHEN {x}_n >= {least} THEN ({x} + {x}_d * {x}_below) / ({x}_n + {x}_d) ELSE {x}_below END AS {x}_p" for x in "ab")
        levels.append(f"model{k} AS (SELECT gram, {smooth} FROM (SELECT l.gram, a, b, {seen}, {'a_below, b_below' if k else below} FROM level{k} l{join} WINDOW w AS (PARTITION BY left(l.gram, length(l.gram) - 1))))")
    return rf"""
WITH cut AS (
  SELECT page_id, coalesce(contains(url, '://'), false) AS usable,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
parsed AS (
  SELECT *, {rule} AS rule, {says} AS says,
         CASE WHEN usable THEN regexp_replace(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000'), '[^ -~]', '~', 'g') END AS form
  FROM cut),
forms AS (
  SELECT form, max((says IS NOT NULL AND says = 'allow')::BIGINT) AS allowed, max((says IS NOT NULL AND says = 'block')::BIGINT) AS blocked,
         ('0x' || left(md5(form), 8))::BIGINT % {url_filter.HELD} = 0 AS held
  FROM parsed WHERE usable GROUP BY form),
padded AS (SELECT *, repeat(chr(2), {order}) || form || chr(3) AS p FROM forms),
parts AS (
  SELECT form, CASE WHEN held THEN 0 ELSE allowed END AS a, CASE WHEN held THEN 0 ELSE blocked END AS b, substr(p, i, {order + 1}) AS gram
  FROM (SELECT *, unnest(range(1, length(form) + 2)) AS i FROM padded)),
{", ".join(levels)},
scored AS (
  SELECT form, sum(round((ln(a_p) - ln(b_p)) * {unit})::BIGINT)::DOUBLE / {unit}::DOUBLE / count(*) AS score
  FROM parts JOIN model{order} USING (gram) GROUP BY form),
bins AS (
  SELECT floor(score * {url_filter.BINS}) AS bin, sum(allowed) AS a, sum(blocked) AS b
  FROM forms JOIN scored USING (form) WHERE held AND allowed + blocked > 0 GROUP BY ALL),
losses AS (
  SELECT bin, coalesce(sum(a) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / nullif(sum(a) OVER (), 0)
              + sum(b) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE / nullif(sum(b) OVER (), 0) AS loss FROM bins),
threshold AS (SELECT coalesce((SELECT bin FROM losses WHERE loss IS NOT NULL ORDER BY loss, bin LIMIT 1), 0)::DOUBLE / {url_filter.BINS} AS t)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN score >= t THEN 'allow' ELSE 'block' END) AS verdict
FROM parsed LEFT JOIN scored USING (form), threshold"""


MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 't:' || coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
classed AS (SELECT *, length(bin(size)) AS k, 1 + length(bin(size)) / 16.0::DOUBLE AS w FROM sized),
sources AS (
  SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1]::DOUBLE AS weight,
         2 * source_size AS lim, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS nth
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
filled AS (
  SELECT *, row_number() OVER o AS pos, (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS total,
         coalesce(sum(lim) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
  FROM sources WINDOW o AS (ORDER BY lim / weight, nth)),
levels AS (SELECT *, (total - before) / after AS level FROM filled),
firsts AS (SELECT *, min(CASE WHEN level * weight <= lim THEN pos END) OVER () AS first FROM levels),
targets AS (
  SELECT source, source_size, CASE WHEN first IS NULL OR pos < first THEN lim::DOUBLE ELSE max(CASE WHEN pos = first THEN level END) OVER () * weight END AS target FROM firsts),
classes AS (
  SELECT c.source, target, k, w, words, coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * 2 AS before,
         sum(w * words) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM (SELECT source, k, w, sum(size)::BIGINT AS words FROM classed GROUP BY ALL) c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source
  WINDOW o AS (PARTITION BY c.source ORDER BY k DESC)),
thetas AS (
  SELECT source, coalesce(max_by(theta, k) FILTER (WHERE theta * w <= 2), 2.0::DOUBLE) AS theta
  FROM (SELECT *, CASE WHEN rest > 0 THEN (target - before) / rest END AS theta FROM classes) GROUP BY source),
drawn AS (
  SELECT c.*, t.source_size, t.target, least(2.0::DOUBLE, theta * w) AS e
  FROM classed c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source JOIN thetas h ON c.source IS NOT DISTINCT FROM h.source),
ranked AS (
  SELECT *, CASE WHEN e - floor(e) > 0 AND size > 0 THEN (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS rank,
         target - sum(floor(e) * size) OVER (PARTITION BY source) AS need FROM drawn),
cut AS (
  SELECT *, rank IS NOT NULL AND sum(CASE WHEN rank IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE <= need AS taken_once FROM ranked)
SELECT doc_id, source, size, source_size, target, (floor(e) + taken_once::INT)::BIGINT AS copies, (floor(e) + taken_once::INT)::BIGINT * size AS taken FROM cut"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filters": _url_filter_sql(), "op8_sharding": _sharding_sql(), "op9_mixing": MIXING_SQL}
