"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from rowgauge.llm import alignment, collocations, common, decontaminate, language_model, line_dedup, near_dup, packing, quality, secret_scan, token_counts, token_file, toxicity, url_filter


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_quality_rules(spark, sf):
    judged = quality.judge(table(spark, sf, "documents"), carry=["doc_id"])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.round("quality", 4).alias("quality"),
    )


def op2_token_file(spark, sf):
    path = common.shared_folder(spark)
    token_file.write_tokens(table(spark, sf, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_file.read_tokens(spark, path)


def op3_token_counts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op4_decontamination(spark, sf):
    return decontaminate.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op5_secret_scan(spark, sf):
    found = secret_scan.scan_secrets(table(spark, sf, "documents"))
    named = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    of = lambda *kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    base = F.array_join(F.transform(of("assign", "access", "hex"), named), ",")
    return found.select(
        F.col("_id").alias("doc_id"),
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.transform("secrets", named), ",").alias("spans"),
        F.size(F.filter("secrets", lambda s: s["live"])).cast("long").alias("n_live"),
    )


#: Host and path rules, fixed.
URL_RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
    ("block", "net/es/"), ("block", "net/fr/"),
)
#: Words that block a host no rule decides on.
URL_WORDS = ("spam", "pills", "casino", "porn", "viagra")


def op6_url_filter(spark, sf):
    judged = url_filter.judge_urls(table(spark, sf, "pages").select("page_id", "url"), URL_RULES, URL_WORDS)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_near_dup(spark, sf):
    return near_dup.near_duplicates(table(spark, sf, "documents"), percent=85)


def op8_packing(spark, sf):
    return packing.pack_documents(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_line_dedup(spark, sf):
    cut = line_dedup.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_toxicity(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_alignment(spark, sf):
    docs = table(spark, sf, "documents")
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    digest = lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups, 256))
    aligned = alignment.align_weighed(docs, a, b, carry=["doc_id"], digest=digest)
    return aligned.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256")
    )


def op12_collocations(spark, sf):
    return collocations.collocations(table(spark, sf, "documents"), top=2000, least=30)


def op13_language_model(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    scored = language_model.score_texts(docs.withColumn("held_out", F.coalesce(held_out, F.lit(False))), ~F.col("held_out"), carry=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_token_file, op3_token_counts, op4_decontamination, op5_secret_scan,
    op6_url_filter, op7_near_dup, op8_packing, op9_line_dedup, op10_toxicity,
    op11_alignment, op12_collocations, op13_language_model,
)}
