import corpus_pipeline

SMOKE_DIR = "/root/testdata/sf0.001"


def test_stages_are_kept_in_order_and_their_columns(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "mix_sources", "pack_sequences"]
    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet").limit(80)
    kept = corpus_pipeline.quality_rules(spark, docs, SMOKE_DIR)
    assert kept.columns == docs.columns
    assert 0 < kept.count() < 80


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SMOKE_DIR}/labels.parquet")
    from lastmile.llm.quality import judge

    clean = judge(docs).select("doc_id", "_quality").join(labels.where("quality = 1"), "doc_id").collect()
    assert clean and all(r["_quality"]["kept"] or r["_quality"]["base_failed"] for r in clean)


def test_a_document_with_repeated_or_null_id_stays_once(spark):
    texts = [[f"{c}{k}" for k in range(200)] for c in "abcd"]
    near = " ".join([*texts[2][:199], "other"])
    texts = [" ".join(t) for t in texts]
    ids = [(1, texts[0]), (1, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (None, near), (7, texts[3]), (None, texts[3]), (5, texts[3])]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in ids], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, SMOKE_DIR)
    assert kept.columns == docs.columns
    left = corpus_pipeline.substring_dedup(spark, kept, SMOKE_DIR).collect()
    assert sorted((r["doc_id"] or 0, r["text"][0], len(r["text"].split())) for r in left) == [(0, "b", 200), (0, "c", 200), (1, "a", 200), (5, "d", 200)]
