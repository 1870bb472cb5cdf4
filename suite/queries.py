"""Every operator over the given tables.

Where the tables hold no instance of a defect, the query derives one from all
their rows; the SQL next door derives the same.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowgauge.config import AuditConfig
from rowgauge.functions import safety, text
from rowgauge.operators import chat, corpus, leakage, numeric, profile, responses, sketches, summary, types
from rowgauge.operators import flags as flag_ops
from rowgauge.plans import audit as audit_plan
from rowgauge.plans import checks as check_plan
from rowgauge.plans import score as score_plan
from rowgauge.sources import manifest, ranges, readers
from rowgauge.sources import sinks
from rowgauge.streaming.files import count_stream, counted, read_stream


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_own_folder: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared place the session names. A local session that
    names none gets one of its own; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="rowgauge-"))
        base = _own_folder[0]
    return os.path.join(base, "rowgauge-" + uuid.uuid4().hex)


# --- Derived inputs -----------------------------------------------------------

def split_label() -> Column:
    return (
        F.when(F.col("source").isin("src0", "src1", "src2"), "test")
        .when(F.col("source").isin("src3", "src4"), "validation")
        .otherwise("train")
    )


def split_documents(spark, sf):
    return table(spark, sf, "documents").withColumn("split", split_label())


def labelled(spark, sf):
    """Documents with their labels; about half have none."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", "text", "lang", "source",
        F.when((F.col("lang") != "en") | F.col("quality").isNotNull(), F.col("n_chars")).alias("n_chars"),
        "quality", "toxic",
    )


def planted(spark, sf):
    """Documents with one kind of defect per source."""
    t = F.col("text")
    broken = {
        "src0": F.concat(F.lit("  "), t),
        "src1": F.concat(t, F.lit(" cafÃ©")),
        "src2": F.concat(t, F.lit("   tail")),
        "src3": F.concat(F.lit("<p>"), t, F.lit("</p>")),
        "src4": F.lit("   "),
        "src5": F.lit(None).cast("string"),
        "src6": F.concat(t, F.lit(" SSN 123-45-6789.")),
        "src7": F.concat(F.repeat(F.lit("over and over again, "), 30), t),
        "src8": F.concat(F.lit("Kill it. "), t),
        "src9": F.concat(t, F.lit(" Self-Harm")),
        "src10": F.concat(t, F.lit(" ")),
        "src11": F.concat(t, F.lit(" card 4111 1111 1111 1111 and 10.1.2.3")),
    }
    value = t
    for source, made in broken.items():
        value = F.when(F.col("source") == source, made).otherwise(value)
    return table(spark, sf, "documents").select("doc_id", value.alias("text"), "lang", "source")


def near_copies(spark, sf):
    """All documents, and all of them again with other case and spacing."""
    docs = table(spark, sf, "documents").select("text", "lang", "source")
    other = F.concat(F.lit(" "), F.replace(F.replace("text", F.lit(" "), F.lit(" \t ")), F.lit("e"), F.lit("E")))
    return docs.unionAll(docs.select(other, "lang", "source"))


def paired(spark, sf):
    """User turns with the assistant turn that follows."""
    turns = table(spark, sf, "conversations")
    asked = turns.filter(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("instruction")
    )
    given = turns.filter(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("answer"))
    short = F.when(F.length("answer") > 300, F.substring("answer", 1, 3)).otherwise(F.col("answer"))
    return asked.join(given, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "instruction", short.alias("output")
    )


def shuffled_roles(spark, sf):
    """Conversations with some assistant turns given to the user, some blanked."""
    n = F.length("text")
    role = F.when((F.col("role") == "assistant") & (n < 120), "user").otherwise(F.col("role"))
    body = F.when((n > 400) & (F.col("role") == "user"), F.lit(" \n")).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", role.alias("role"), body.alias("text"))


def line_chats(spark, sf):
    """One conversation per document: its lines are the turns."""
    def turn(line, at):
        role = (
            F.when((at == 0) & line.startswith("T"), "system")
            .when(F.length(line) < 40, "User")
            .otherwise("assistant")
        )
        return F.struct(role.alias("role"), line.alias("content"))

    return table(spark, sf, "documents").select(
        "doc_id", F.transform(F.split("text", "\n"), turn).alias("messages")
    )


def mixed_records(spark, sf):
    """Events as records whose value kinds depend on the event type."""
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    first = F.when(kind == "view", F.concat(F.lit('"'), k, F.lit('"'))).when(kind == "error", "true").otherwise(k)
    number = F.when(kind == "click", F.concat(k, F.lit(".5"))).otherwise(k)
    inner = F.when(kind == "signup", F.lit('{"z": 1}')).otherwise(k)
    items = F.when(kind == "purchase", F.lit("null")).otherwise(F.concat(F.lit("["), k, F.lit("]")))
    record = F.concat(
        F.lit('{"k": '), first, F.lit(', "num": '), number,
        F.lit(', "o": {"p": '), inner, F.lit('}, "l": '), items, F.lit("}"),
    )
    return table(spark, sf, "events").select(F.parse_json(record).alias("v"))


def priced(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_price"),
        (F.lit(100.0) - F.col("l_quantity")).alias("quantity_left"),
    )


def links(spark, sf):
    """Every page address, and links of every kind built from it."""
    u, i = F.col("url"), F.col("page_id").cast("string")
    made = [
        u,
        F.concat(u, F.lit(".csv")),
        F.concat(u, F.lit("/x.JSONL.gz")),
        F.concat(F.lit("s3://bucket/p"), i, F.lit(".parquet")),
        F.concat(F.lit("gs://bucket/p"), i),
        F.concat(F.lit("https://github.com/owner/repo/blob/main/p"), i, F.lit(".csv")),
        F.concat(F.lit("https://github.com/owner/repo/p"), i),
        F.concat(F.lit("https://raw.githubusercontent.com/owner/repo/p"), i, F.lit(".json")),
        F.concat(F.lit("https://huggingface.co/datasets/owner/d"), i),
        F.concat(F.lit("/data/p"), i, F.lit(".tsv.gz")),
        F.concat(F.lit("file:///data/p"), i, F.lit(".json")),
        F.concat(F.lit(" HTTPS://acct.blob.core.windows.net/c/p"), i, F.lit(".parquet ")),
        F.concat(F.lit("https://b.s3.amazonaws.com/p"), i, F.lit(".txt")),
        F.concat(F.lit("ftp://host/p"), i, F.lit(".gz")),
    ]
    return table(spark, sf, "pages").select("page_id", F.explode(F.array(*made)).alias("link"))


# --- Sources and sinks ----------------------------------------------------------

def source_manifest(spark, sf):
    return manifest.classify_sources(links(spark, sf), "link")


def _documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def csv_scan(spark, sf):
    path = scratch(spark) + ".csv"
    _documents(spark, sf).write.options(header=True, escape='"', compression="gzip").csv(path)
    return readers.read_table(spark, path)


def tsv_scan(spark, sf):
    path = scratch(spark) + ".tsv"
    status = F.when(F.col("o_orderstatus") == "F", "NA").otherwise(F.col("o_orderstatus"))
    cols = table(spark, sf, "orders").withColumn("status", status).drop("o_orderstatus", "o_orderdate")
    cols.write.options(header=True, sep="\t", escape='"').csv(path)
    return readers.read_table(spark, path)


def jsonl_scan(spark, sf):
    path = scratch(spark) + ".jsonl"
    nested = _documents(spark, sf).select(
        "doc_id", F.struct("lang", "source").alias("meta"), "text", "n_chars"
    )
    nested.write.json(path)
    return readers.read_table(spark, path).withColumnsRenamed(
        {"meta.lang": "meta_lang", "meta.source": "meta_source"}
    )


def json_document_scan(spark, sf):
    """All documents as JSON files of 200 each: objects around a list."""
    path = scratch(spark) + ".json"
    rows = table(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 200).alias("part"), F.to_json(F.struct("doc_id", "text")).alias("r")
    )
    made = F.concat(F.lit('{"rows": ['), F.array_join(F.collect_list("r"), ","), F.lit("]}")).alias("value")
    rows.groupBy("part").agg(made).write.partitionBy("part").text(path)
    return readers.read_table(spark, path).drop("part")


def parquet_scan(spark, sf):
    path = scratch(spark) + ".parquet"
    _documents(spark, sf).write.parquet(path)
    return readers.read_table(spark, path)


def split_union(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    parts = {"train": docs.select("doc_id", "text"), "test": items.select("item_id", "text")}
    return readers.union_splits(parts)


def row_range(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return ranges.row_range(docs, "doc_id", 10, 50, "lang", small=20)


def row_positions(spark, sf):
    """Documents without their ids, by their place in files."""
    path = scratch(spark)
    docs = table(spark, sf, "documents").repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id")
    docs.select("text", "lang", "source").write.parquet(path)
    return ranges.rows_by_position(spark, path, 100, 450).select(F.md5("text").alias("text_md5"), "lang", "source")


def split_metadata(spark, sf):
    return ranges.split_metadata(split_documents(spark, sf))


def primary_split(spark, sf):
    docs = split_documents(spark, sf)
    names = [r[0] for r in docs.select("split").distinct().orderBy("split").collect()]
    return docs.filter(F.col("split") == ranges.primary_split(names)).select("doc_id", "split")


def report_sink(spark, sf):
    path = scratch(spark)
    sinks.write_report(_report(spark, sf), path, "a1")
    return (
        spark.read.parquet(path + "/checks")
        .filter(F.col("audit_id") == "a1")
        .select("category", "name", "status", "affected_rows", "severity")
    )


# --- Row flags --------------------------------------------------------------------

def normalised_text(spark, sf):
    return near_copies(spark, sf).select(text.normal_hash(F.col("text")).alias("key")).groupBy("key").agg(
        F.count("*").alias("rows")
    )


def row_flags(spark, sf):
    return flag_ops.row_flags(planted(spark, sf), "text", ["doc_id"])


def flag_counts(spark, sf):
    return flag_ops.flag_counts(planted(spark, sf), ["text", "source"])


def text_quality(spark, sf):
    return flag_ops.text_quality(planted(spark, sf), ["text"])


def html_pages(spark, sf):
    return flag_ops.text_quality(table(spark, sf, "pages"), ["url", "html"])


def pii_by_source(spark, sf):
    docs = table(spark, sf, "documents")
    found = safety.pii_flags(F.col("text"))
    return docs.groupBy("source").agg(*[F.count_if(v).alias(k) for k, v in found.items()])


def pii_counts(spark, sf):
    kinds = [f"pii_{label}" for label in AuditConfig().pii_patterns]
    counts = flag_ops.flag_counts(planted(spark, sf), ["text"], flags=kinds)
    return counts.select(F.expr("substring(flag, 5)").alias("label"), "rows")


CORPUS_WORDS = {"short": ["the", "und", "les"], "longer": ["ththe", "worthless", "c++", "est"]}


def toxicity(spark, sf):
    """The keyword scan with the default list and with a list of one's own."""
    docs = planted(spark, sf)
    lists = {**AuditConfig().keywords, **CORPUS_WORDS}
    found = safety.keyword_flags(F.col("text"), lists)
    return docs.groupBy("lang").agg(*[F.count_if(v).alias(k) for k, v in found.items()])


def over_budget(spark, sf):
    docs = table(spark, sf, "documents")
    n = text.token_estimate(F.col("text"))
    return docs.select("doc_id", n.alias("tokens"), (n > 512).alias("over_budget"))


def repetition(spark, sf):
    return corpus.noise(planted(spark, sf), ["text"])


def openings(spark, sf):
    return corpus.boilerplate_openings(near_copies(spark, sf), "text")


def opening_words(spark, sf):
    return planted(spark, sf).select("doc_id", text.opening(F.col("text")).alias("opening"))


# --- Profile ------------------------------------------------------------------------

def text_columns(spark, sf):
    found = profile.text_columns(labelled(spark, sf))
    docs = labelled(spark, sf)
    return flag_ops.text_quality(docs, found).select("column", "count", "mean_chars")


def schema_report(spark, sf):
    return profile.schema_report(labelled(spark, sf))


def missingness(spark, sf):
    return profile.missingness(labelled(spark, sf))


def fully_empty_rows(spark, sf):
    """All columns of a table whose rows lack one, some or all of them."""
    docs = labelled(spark, sf)
    gone = F.col("quality").isNull() & (F.col("doc_id") % 3 == 0)
    return profile.fully_empty_rows(docs.select(*[F.when(~gone, F.col(c)).alias(c) for c in docs.columns]))


def correlated_missingness(spark, sf):
    return profile.correlated_missingness(labelled(spark, sf))


def cardinality(spark, sf):
    return profile.cardinality(labelled(spark, sf))


def cardinality_lineitem(spark, sf):
    return profile.cardinality(table(spark, sf, "lineitem"))


def cardinality_nested(spark, sf):
    """Arrays, structs and maps; the order of a map's entries does not count."""
    made = table(spark, sf, "embeddings").select(
        "embedding", "label", F.struct("label", (F.col("vec_id") % 7).alias("k")).alias("pair"),
        F.map_from_arrays(
            F.when(F.col("vec_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"), F.lit("a"))),
            F.when(F.col("vec_id") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2), F.lit(1))),
        ).alias("entries"),
    )
    return profile.cardinality(made)


def class_balance(spark, sf):
    return profile.class_balance(labelled(spark, sf))


def class_balance_lineitem(spark, sf):
    return profile.class_balance(table(spark, sf, "lineitem"))


#: A caller's own flag, keywords, and tokens by words instead of characters.
OWN = AuditConfig(
    extra_flags={"exclaims": lambda c: c.contains("!")}, keywords={"pronouns": ("he", "she", "it")}, pii_patterns={},
    token_count=lambda c: F.size(F.split(c, " ")).cast("bigint"), token_budget=300,
)


def own_flags(spark, sf):
    found = flag_ops.row_flags(table(spark, sf, "documents"), "text", ["doc_id"], OWN, repetition=False)
    return found.select("doc_id", "tokens", "over_budget", "exclaims", "toxicity_pronouns")


def stream_flag_counts(spark, sf):
    """flag_counts by a stream that reads the table's files two at a time."""
    folder = scratch(spark)
    planted(spark, sf).repartition(5, "doc_id").write.parquet(folder + "/in")
    stream = read_stream(spark, folder + "/in", "parquet", spark.read.parquet(folder + "/in").schema, max_files=2)
    count_stream(stream, ["text", "source"], folder + "/out", folder + "/state").awaitTermination()
    return counted(spark, folder + "/out")


def sketched_cardinality(spark, sf):
    """Sketches kept per language and merged, next to the exact numbers."""
    docs = table(spark, sf, "documents")
    kept = sketches.merged(sketches.column_sketches(docs, "lang"))
    exact = profile.cardinality(docs).select("column", F.col("unique").alias("exact"))
    near = F.abs(F.col("unique") - F.col("exact")) <= F.col("exact") * sketches.DISTINCT_ERROR
    return sketches.approximate_cardinality(kept).join(exact, "column").select("column", "exact", near.alias("near"))


def sketched_quantiles(spark, sf):
    """Quantiles of merged sketches, by how many values lie below and up to them."""
    docs = table(spark, sf, "documents").select("lang", "n_chars", "doc_id")
    kept = sketches.merged(sketches.column_sketches(docs, "lang"))
    found = sketches.approximate_quantiles(kept, (0.05, 0.25, 0.5, 0.75, 0.95, 0.99))
    values = docs.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in ("n_chars", "doc_id")])))
    ranks = values.join(F.broadcast(found), "column").groupBy("column", "share").agg(
        F.avg((F.col("v") < F.col("value")).cast("int")).alias("below"), F.avg((F.col("v") <= F.col("value")).cast("int")).alias("upto")
    )
    near = (F.col("below") - sketches.RANK_ERROR <= F.col("share")) & (F.col("share") <= F.col("upto") + sketches.RANK_ERROR)
    return ranks.select("column", "share", near.alias("near"))


def duplicates(spark, sf):
    docs = near_copies(spark, sf)
    return profile.duplicates(docs, ["text"])


def dtype_consistency(spark, sf):
    found = types.dtype_consistency(mixed_records(spark, sf))
    return found.select("column", F.array_join("observed_types", ",").alias("observed_types"))


def split_leakage(spark, sf):
    return leakage.split_leakage(split_documents(spark, sf), "text", ["test", "train", "validation"])


def outliers(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "value")
    found = numeric.numeric_outliers(events, "event_id", small=500)
    return found.withColumn("example_rows", F.array_join(F.col("example_rows").cast("array<string>"), ","))


def outliers_lineitem(spark, sf):
    return numeric.numeric_outliers(priced(spark, sf))


def correlation(spark, sf):
    return numeric.numeric_correlation(priced(spark, sf))


# --- Corpus --------------------------------------------------------------------------

def token_distribution(spark, sf):
    return corpus.token_distribution(planted(spark, sf), ["text", "source"])


def token_histogram(spark, sf):
    return corpus.length_histogram(table(spark, sf, "documents"), "text")


def vocabulary(spark, sf):
    return corpus.vocabulary(planted(spark, sf), ["text", "source"])


# --- Formats and chat -----------------------------------------------------------------

def format_detection(spark, sf):
    """The layout found for each table, with the number of rows it covers."""
    frames = {
        "documents": table(spark, sf, "documents"),
        "pairs": paired(spark, sf),
        "line_chats": line_chats(spark, sf),
        "orders": table(spark, sf, "orders"),
        "question_answer": paired(spark, sf).withColumnsRenamed({"instruction": "Question", "output": "Answer"}),
    }
    out = None
    for name, df in frames.items():
        found = ",".join(chat.detect_format(df).formats)
        part = df.agg(
            F.lit(name).alias("table_name"), F.lit(found).alias("formats"), F.count("*").alias("rows")
        )
        out = part if out is None else out.unionAll(part)
    return out


def turn_order_nested(spark, sf):
    return chat.turn_validation(line_chats(spark, sf), "messages")


def chat_flags_nested(spark, sf):
    chats = line_chats(spark, sf)
    flags = chat.chat_flags(chats, "messages")
    return chats.select("doc_id", *[v.alias(k) for k, v in flags.items()])


def turn_order_long(spark, sf):
    return chat.long_turn_flags(shuffled_roles(spark, sf), turns_per_block=3)


def response_checks(spark, sf):
    return responses.response_checks(paired(spark, sf), "instruction", "output")


# --- Checks, score, evidence ------------------------------------------------------------

QUALITY = ["empty_or_whitespace", "html_bleed", "encoding_artifacts", "whitespace_anomalies"]


def _evidence(spark, sf):
    flagged = flag_ops.row_flags(planted(spark, sf), "text", ["doc_id"], repetition=False)
    return flag_ops.evidence(flagged, "doc_id", QUALITY)


def evidence(spark, sf):
    return _evidence(spark, sf)


def flagged_rows(spark, sf):
    return flag_ops.flagged_rows(planted(spark, sf), _evidence(spark, sf), "doc_id")


def column_summary(spark, sf):
    return summary.column_summary(planted(spark, sf), ["text", "source"])


def _report(spark, sf):
    return audit_plan.audit(split_documents(spark, sf), "doc_id")


def checks(spark, sf):
    found = _report(spark, sf).checks
    return found.select(
        "category", "name", "status", "affected_rows", "severity", "detail",
        F.array_join("example_rows", ",").alias("example_rows"), "effort",
    )


def checks_mixed(spark, sf):
    """The check of types over JSON lines whose keys hold several kinds of values."""
    path = scratch(spark) + ".jsonl"
    mixed_records(spark, sf).select(F.to_json("v").alias("value")).write.text(path)
    found = audit_plan.audit(readers.load_splits(spark, {"train": path})).checks
    return found.filter(F.col("category") == "SCHEMA").select("name", "status", "affected_rows", "severity", "detail")


def checks_chat(spark, sf):
    """The checks of a chat table: broken order and empty turns among them."""
    found = audit_plan.audit(line_chats(spark, sf), "doc_id").checks
    return found.filter(F.col("category") == "FORMAT").select(
        "name", "status", "affected_rows", "severity", F.array_join("example_rows", ",").alias("example_rows"),
    )


def checks_pairs(spark, sf):
    pairs = paired(spark, sf).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "instruction", "output"
    )
    found = audit_plan.audit(pairs, "row_id").checks
    return found.filter(F.col("category").isin("FORMAT", "CONSISTENCY")).select(
        "name", "status", "affected_rows", "severity", "detail",
        F.array_join("example_rows", ",").alias("example_rows"),
    )


def score_dimensions(spark, sf):
    return _report(spark, sf).dimensions


def score_overall(spark, sf):
    return _report(spark, sf).overall


def gate(spark, sf):
    return score_plan.gate(_report(spark, sf).overall, 75.0)


def issues(spark, sf):
    return check_plan.issues(_report(spark, sf).checks).select("severity", "status", "category", "name", "affected_rows")


QUERIES = {
    f.__name__: f
    for f in (
        source_manifest, csv_scan, tsv_scan, jsonl_scan, json_document_scan, parquet_scan, split_union, row_range, row_positions, own_flags, stream_flag_counts, sketched_cardinality, sketched_quantiles,
        split_metadata, primary_split, report_sink, normalised_text, row_flags, flag_counts,
        text_quality, html_pages, pii_by_source, pii_counts, toxicity, over_budget, repetition,
        openings, opening_words, text_columns, schema_report, missingness, fully_empty_rows,
        correlated_missingness, cardinality, cardinality_lineitem, cardinality_nested,
        class_balance, class_balance_lineitem, duplicates, dtype_consistency, split_leakage,
        outliers, outliers_lineitem, correlation, token_distribution, token_histogram, vocabulary,
        format_detection, turn_order_nested, chat_flags_nested, turn_order_long, response_checks,
        evidence, flagged_rows, column_summary, checks, checks_mixed, checks_chat, checks_pairs, score_dimensions,
        score_overall, gate, issues,
    )
}
