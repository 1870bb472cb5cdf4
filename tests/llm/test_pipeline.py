"""The pipeline against its stages in plain Python and SQL, and the guard around it."""

import random
from collections import Counter

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from rowgauge.llm.oracles import ORACLES
from tests.llm import brute
from tests.llm.test_matching import bench, leaks, near_rows


def small_corpus():
    rng = random.Random(31)
    rows = [r for r in near_rows() if r[0] is not None and r[0] not in (303, 307)]
    shared = "A shared closing line of some length."
    rows = [(i, (t or "") + (f"\n{shared}" if i % 3 == 0 else "") if t is not None else None, s) for i, t, s in rows]
    items = [x for x in bench(rng) if x[0] is not None]
    for j, (_, text) in enumerate(items):
        if text:
            rows.append((1000 + j, brute.prose(rng, 40) + " " + text + " " + brute.prose(rng, 40), "s9"))
    rows.append((2000, "junk ### $$$ *** " * 30, "s9"))
    rows.append((2001, "over and over and over and over again " * 20, "s9"))
    return rows, items


def test_pipeline_against_brute_force(spark, tmp_path):
    rows, items = small_corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr(
        "doc_id", "text", "'en' AS lang", "source", "CAST(length(text) AS BIGINT) AS n_chars"
    )
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLES['op1_quality_rules']}) WHERE kept").fetchall()}
    left = [r for r in rows if r[0] in kept]
    assert 2000 not in kept and 2001 not in kept and len(left) > 100
    source = {i: s for i, _, s in rows}
    left = [(i, text, source[i]) for i, _, _, text in brute.line_dedup(left)]
    left = [r for r, (i, _, c) in zip(left, brute.groups(left, 80), strict=True) if i == c]
    bad = {i for i, _ in leaks(left, items)}
    left = [r for r in left if r[0] not in bad]
    assert bad and len(left) > 20

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t, _ in left:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for p, a in enumerate(range(0, len(ids), 4096)):
            want[i, p, a, len(ids[a : a + 4096]), brute.crc(ids[a : a + 4096])] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == want


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    rows, items = small_corpus()
    docs = spark.createDataFrame(rows[:60], "doc_id bigint, text string, source string").selectExpr(
        "doc_id", "text", "'en' AS lang", "source", "CAST(length(text) AS BIGINT) AS n_chars"
    )
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
