"""The corpus pipeline: every stage against its operator's promise, and the whole."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from loglathe.llm import fingerprint, html_text, packing, queries
from loglathe.llm.common import Kept, settle

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").unionByName(spark.createDataFrame([(900_001, "12 34", None, None, 5), (900_002, None, "en", "src1", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    before = Counter(r["doc_id"] for r in docs.collect())
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "ngram_join", "mixing", "best_fit_packing"]
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = Kept(stage(spark, docs, FOLDER), name).df
        kept[name] = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        if name != "best_fit_packing":
            assert docs.columns == columns
    assert set(before) - set(kept["language_id"]) >= {900_001, 900_002}
    assert len(kept["language_id"]) >= 0.95 * len(before)
    assert max(kept["ngram_join"].values()) == 1 and set(kept["ngram_join"]) < set(kept["language_id"])
    assert set(kept["mixing"]) <= set(kept["ngram_join"]) and max(kept["mixing"].values()) <= 2
    assert set(kept["best_fit_packing"]) == set(kept["mixing"])
    assert docs.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 4096


def test_columns_of_any_name_pass(spark):
    names = ["score", "lang_pred", "rejected", "letters", "row", "_row", "tid", "_tid", "sid", "root", "length", "piece", "hash", "canon", "src", "size", "copies", "uid", "key", "a b.c"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES:
        columns, docs = docs.columns, Kept(stage(spark, docs, FOLDER), name).df
        if name != "best_fit_packing":
            assert docs.columns == columns
            assert docs.where(" or ".join(f"`{n}` <> concat('{n}', doc_id)" for n in names)).isEmpty() and docs.count() > 0


def test_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = Kept(stage(spark, docs, FOLDER), name).df
        assert docs.count() == 0


def test_carried_columns(spark):
    df = spark.createDataFrame([(1, "<p>x</p>", "one two", "c", "h", 7, 8)], "doc_id long, html string, text string, canon string, hash string, length int, piece int")
    assert html_text.main_text(df, carry=("doc_id", "canon", "text")).columns == ["doc_id", "canon", "text"]
    got = packing.pack_documents(df, queries.tokenizer("word_bpe_49k.json"), carry=("doc_id", "length", "piece", "hash")).first()
    assert (got["doc_id"], got["hash"], got["piece"], got["offset"]) == (1, "h", 0, 0) and got["length"] > 1
    assert fingerprint.fingerprints(df, carry=("canon", "hash")).select("canon", "hash").first() == ("c", "h")


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_give_memory_back(spark):
    jvm = spark._jvm
    heap = jvm.java.lang.Runtime.getRuntime()

    def whole_collections():
        return sum(b.getCollectionCount() for b in jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName())

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(20)
    for _, stage in corpus_pipeline.STAGES:
        before = whole_collections()
        stage(spark, docs, FOLDER)
        assert whole_collections() > before
    held = [spark.sparkContext._gateway.new_array(jvm.long, 16 << 20) for _ in range(8)]  # 1 GB
    grown, used = heap.totalMemory(), heap.totalMemory() - heap.freeMemory()
    for x in held:
        spark.sparkContext._gateway.detach(x)
    held.clear()
    for _ in range(5):  # a collection beside one that runs already may find the arrays still held
        settle(spark)
        left = heap.totalMemory() - heap.freeMemory()
        if left <= used - (512 << 20):
            break
    assert left <= used - (512 << 20)
    # the collector keeps room of at most seven tenths of the heap, so what a long session holds counts
    assert heap.totalMemory() <= max(grown - (512 << 20), left / 0.3 + (64 << 20))
