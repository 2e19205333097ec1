"""One query for each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm import bpe, chat, collocations, decontaminate, langid, mixing, near, nearest, sentencepiece, sharding, urls, warc, whitening
from bazaarlens.llm.tables import fold_residue, read

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLE_CONVERSATION = -7
SAMPLE_TEXT = "</s>[INST] ok [/INST]"


def op1_sentencepiece(spark: SparkSession, sf_dir: str, path: str = PIECES) -> DataFrame:
    """Ids of every text, and whether decoding gives the text again."""
    pieces = sentencepiece.load_pieces(path)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = sentencepiece.decode(sentencepiece.encode(docs, pieces), pieces)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        "ids",
        F.length("decoded").cast("long").alias("decoded_chars"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return nearest.nearest(vectors, F.col("vec_id") % 100 == 0)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near copies and number of links of every document."""
    return near.near_duplicates(read(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is read back from the formatted conversations."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    sample = spark.range(2).select(
        F.lit(SAMPLE_CONVERSATION).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(SAMPLE_TEXT).alias("text"),
    )
    done = chat.format_conversations(rows.unionByName(sample))
    turns = chat.parse_formatted(F.col("formatted"))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read_back = done.select(
        "conv_id", "valid", "formatted", turns.alias("turns"), chat.loss_text(F.col("segments")).alias("loss")
    )
    return read_back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", line), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def labelled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls of pages whose document, named by the last number of the path, has a label."""
    labels = read(spark, sf_dir, "labels").select(
        "doc_id",
        F.when((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit("block")).otherwise(F.lit("allow")).alias("label"),
    )
    _, path = urls.host_and_path(F.col("url"))
    pages = read(spark, sf_dir, "pages").select("url", F.regexp_extract(path, r"/([0-9]{1,18})[^0-9/]*/?$", 1).try_cast("long").alias("doc_id"))
    return pages.join(labels, "doc_id").select("url", "label")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, labelled_urls(spark, sf_dir))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and mixing scores of every document; the fold of residue 2 modulo 7 is held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return mixing.score_documents(docs, fold_residue(F.col("doc_id"), 7) == 2)


SHARDS = 24


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sharding.shard_documents(read(spark, sf_dir, "documents"), SHARDS)
    return done.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def labelled_documents(docs: DataFrame) -> DataFrame:
    """The training fold: documents whose crc32 of the id is not 2 modulo 4."""
    return docs.where((fold_residue(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull())


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(labelled_documents(docs))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (fold_residue(F.col("doc_id"), 4) == 2).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
    )


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of document and benchmark item that leaks into it."""
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the archive that was made of the WARC files of all pages."""
    folder = warc.write_archive(read(spark, sf_dir, "pages"))
    return warc.read_archive(spark, folder).select(
        "page_id",
        "payload_bytes",
        "payload_digest",
        "record_type",
        "refers_to",
        "verified",
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first 16 components of the distinct vectors."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return whitening.whiten(vectors, "vec_id")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language."""
    return collocations.mine(read(spark, sf_dir, "documents").select("text", "lang"))


TOKENIZERS = "/opt/tokenizers"


def op13_bpe(spark: SparkSession, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    """Digests of the ids of every text and of what they decode to."""
    vocabulary = bpe.load_vocabulary(f"{folder}/word_bpe_49k.json")
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    done = bpe.decode(bpe.encode(docs, vocabulary).drop("text"), vocabulary)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_sentencepiece,
        op2_nearest_neighbours,
        op3_ngram_jaccard_join,
        op4_chat_formatting,
        op5_url_filters,
        op6_lm_scoring,
        op7_sharding,
        op8_language_id,
        op9_benchmark_decontamination,
        op10_warc,
        op11_whitening,
        op12_collocations,
        op13_bpe,
    )
}
