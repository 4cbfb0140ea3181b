import corpus_pipeline
from touchline.llm import common, decontamination, mixing, simhash, toxicity

DATA = "/root/testdata/sf0.001"


def test_stages_against_their_operators(spark, documents):
    """Each stage over what the one before kept, against the operator's own report on the same rows."""
    labels, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    docs = documents
    want = {
        "toxicity": lambda x: ids(toxicity.score(x, toxicity.fit(x, labels)).where(f"score < {toxicity.THRESHOLD}")),
        "simhash_near_dedup": lambda x: ids(simhash.near_duplicates(x).where("doc_id = component_id")),
        "benchmark_decontamination": lambda x: ids(decontamination.find_passages(x, bench).where("not (n_hit > 0 and 20 * n_hit >= n_words)")),
        "mixing_to_targets": lambda x: ids(mixing.sample_to_targets(x).where("kept")),
    }
    assert [n for n, _ in corpus_pipeline.STAGES] == [*want, "token_files"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.written(stage(spark, docs, DATA), name)
        assert out.columns == documents.columns
        assert ids(out) == want[name](docs)
        assert out.join(documents, out.columns, "left_anti").isEmpty()
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert ids(last) == ids(docs)
    whole = sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect()))
    assert whole == sorted(map(tuple, last.collect()))


def test_stages_handle_odd_documents(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.written(stage(spark, docs, DATA), name)
        corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
