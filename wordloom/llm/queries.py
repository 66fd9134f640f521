"""The registered queries of this subpackage, each over a whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    pieces = packing.pack(_read(spark, sf_dir, "documents", "doc_id", "text"), _vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    path = _vocabulary("byte_bpe_50k.json")
    ids = bpe.encode(_read(spark, sf_dir, "documents", "doc_id", "text"), path).select("doc_id", "ids")
    return bpe.decode(ids, path).select("doc_id", bpe.n_ids().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup

    kept = line_dedup.dedup_lines(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = r"""
with split as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
lines as (
  select doc_id, unnest(range(1, len(ls) + 1)) pos, unnest(ls) line from split),
keyed as (
  select doc_id, pos, line,
    translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k
  from lines),
common as (
  select k from keyed where length(k) >= 1 group by k having count(distinct doc_id) >= 10)
select doc_id, cast(count(*) as bigint) n_lines,
  cast(count(*) filter (where k in (select k from common)) as bigint) n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where k not in (select k from common)), '')) kept_sha256
from keyed group by doc_id
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.fit(docs.where(~held_out), _vocabulary("piece_bpe_32k.model"))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ann_forest

    vectors = _read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return ann_forest.search(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import media

    read = media.load(media.store(_read(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_bytes", "media"))
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), -32, 32)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc
    from ._common import workspace, written

    pages = warc.digests(_read(spark, sf_dir, "pages", "page_id", "url", "html"), "page_id", "html", min_bytes=1000)
    bundles = written(warc.write_bundles(pages, "page_id", "url", "html"), workspace(spark, "warc"))
    r = warc.read_bundles(bundles)
    response = F.col("record_type") == "response"
    return r.select(
        F.when(F.col("record_id") != "", F.col("record_id").cast("long")).alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


OP6_SQL = """
with p as (
  select page_id, coalesce(html, '') html, strlen(coalesce(html, '')) n, sha1(coalesce(html, '')) d from pages),
k as (
  select d, max(page_id) keep from p where n >= 1000 group by d)
select page_id, cast(n as bigint) payload_bytes, p.d payload_digest,
  case when n >= 1000 and page_id <> keep then 'revisit' else 'response' end record_type,
  case when n >= 1000 and page_id <> keep then keep end refers_to
from p left join k on p.d = k.d
"""


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    return sharding.shard(_read(spark, sf_dir, "documents", "doc_id", "text"), shards=40)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.classes(_read(spark, sf_dir, "documents", "doc_id", "text"), n=3, percent=90)


OP9_SQL = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from documents),
s as (
  select doc_id, unnest(case when len(ws) >= 3 then list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) sh from w),
n as (select doc_id, count(*) n from s group by doc_id),
met as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
links as (select a, b from met join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
ways as (select a, b from links union select b, a from links),
reach as (select doc_id, doc_id root from documents union select ways.b, root from reach join ways on ways.a = reach.doc_id)
select reach.doc_id, coalesce(any_value(n), 0)::bigint n_shingles, min(root) component_id from reach left join n on n.doc_id = reach.doc_id group by reach.doc_id
"""


# The rules of the contract.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import urlfilter

    judged = urlfilter.filter_urls(_read(spark, sf_dir, "pages", "page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_score")


QUERIES = {f.__name__: f for f in (op1_packing, op2_line_dedup, op3_language_id, op4_ann_forest, op5_media, op6_warc, op7_bpe, op8_sharding, op9_jaccard_join, op10_url_filter)}
ORACLE_SQL: dict[str, str] = {"op2_line_dedup": OP2_SQL, "op6_warc": OP6_SQL, "op9_jaccard_join": OP9_SQL}
