"""The queries of this package, with production parameters, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.llm import alignment, bpe, chat, fingerprint, html_text, jaccard, langid, licenses, mixing, runs, secrets, topk, warc
from provenant.llm.common import table

RANK_FILE = "byte_bpe_50k.tiktoken"
BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and back."""
    encoded = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN, decoded=True)
    return bpe.digests(encoded)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.each_row(mixing.mix(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text, through a ledger of blobs: the base rules start it, the added ones come later and find all blobs known."""
    docs = table(spark, sf_dir, "documents")
    ledger = secrets.fresh_ledger(docs)
    secrets.scan(docs, ledger, rules=secrets.BASE)
    found = secrets.scan(docs, ledger)
    counts = [secrets.kind_count(rule.kind).alias(f"n_{rule.kind}") for rule in secrets.BASE]
    base = secrets.spans_text("findings", tuple(rule.kind for rule in secrets.BASE))
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(base, 256).alias("base_sha256"), secrets.spans_text("findings").alias("spans"), "blob")


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartile digests of every text and of its edited text."""
    return fingerprint.with_following(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle counts and components of similar texts."""
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.filter("vec_id % 50 = 0"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that the units of every text match."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every text, every tenth of which repeats itself from some word on."""
    return runs.digests(runs.find_runs(runs.spliced(table(spark, sf_dir, "documents"))))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that speaks in control strings: as logs, folded, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    two = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), F.col("id").cast("int") + 1).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = rows.unionByName(two)
    return chat.digests(chat.read_back(chat.render(chat.fold(chat.as_log(rows)))))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two vocabularies, aligned in every text, and what the corpus says of their links."""
    return alignment.digests(alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_FILE), public_tokenizers.path(PIECE_FILE)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_byte_bpe, op2_html_text, op3_source_mix, op4_secret_ledger, op5_fingerprint, op6_warc, op7_language, op8_jaccard, op9_top_k, op10_licenses, op11_runs, op12_chat_format, op13_alignment]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_secret_ledger": secrets.oracle_sql(), "op9_top_k": TOP_K_SQL, "op10_licenses": licenses.oracle_sql(), "op12_chat_format": chat.oracle_sql()}


TOP_K_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as query_id, b.vec_id as vec_id,
         cast(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) as bigint) as score
  from v a, v b
  where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)
)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
where rank <= 5
"""
