"""One registered query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import ann, audit, bpe, chat, exact, fim, html, langid, lines, mixing, packing, quality, simhash
from tallyforge.plans.fixtures import table

QUERIES = {}


def query(name: str):
    def register(build):
        QUERIES[name] = build
        return build

    return register


@query("op1_language_id")
def language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out")
    ranks, _ = vocabulary("byte_bpe_multi_50k.tiktoken")
    model = langid.train(docs.where(~held_out), ranks)
    return langid.identify(docs, model, ranks, ["doc_id", held_out])


@query("op2_quality_rules")
def quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return quality.quality_rules(docs, quality.train(docs, table(spark, sf, "labels")))


@query("op3_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query("op4_source_mixing")
def source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf, "documents"))


@query("op5_chat_format")
def chat_format(spark: SparkSession, sf: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(
        f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)"
    )
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    messages = rows.withColumn("parts", chat.text_part(F.col("text")))
    return chat.digests(chat.format_conversations(messages))


@query("op6_html_text")
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return html.extract(pages, html.train(pages), ["page_id", "url"])


@query("op7_byte_bpe")
def byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return token_digests(
        bpe.tokenize(table(spark, sf, "documents"), *vocabulary("byte_bpe_multi_50k.tiktoken"), ["doc_id"])
    )


@query("op8_line_dedup")
def line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))


@query("op9_nearest_vectors")
def nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return ann.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op10_packed_ids")
def packed_ids(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(packing.token_ids(table(spark, sf, "documents"), *vocabulary("byte_bpe_50k.tiktoken")))


@query("op11_filter_audit")
def filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op12_fill_in_middle")
def fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf, "documents"), ["doc_id"])
    return made.select(
        *["doc_id", "n", "form", "prefix_chars", "middle_chars"],
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


@query("op13_top_products")
def top_products(spark: SparkSession, sf: str) -> DataFrame:
    return exact.top_products(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


def vocabulary(name: str) -> tuple[bytes, str]:
    """Content of a public rank file and the pattern that goes with it."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read(), public_tokenizers.PATTERN


def token_digests(coded: DataFrame) -> DataFrame:
    """Number of ids, and digests of the ids and of the bytes they decode to."""
    return coded.select(
        "doc_id",
        F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
