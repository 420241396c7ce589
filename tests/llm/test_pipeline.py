"""The pipeline, stage by stage, against what its operators find."""

import corpus_pipeline
from lumivox.llm import decontaminate, line_dedup, pieces, quality
from lumivox.llm.common import table
from test_repeats import roots
from test_similar import jaccard, shingle_set


def smallest_of_groups(rows):
    """Smallest doc_id of every group of documents of which four fifths of the five-word shingles are common."""
    sets = [shingle_set(t) for _, t in rows]
    found = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8])
    return {min(i for (i, _), q in zip(rows, found) if q == r) for r in found}


def test_stages(spark, data, tmp_path):
    docs = table(spark, data, "documents")
    columns, texts = docs.columns, {}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, data)
        out.write.parquet(str(tmp_path / name))
        left = spark.read.parquet(str(tmp_path / name))
        if at + 1 < len(corpus_pipeline.STAGES):
            assert left.columns == columns and dict(left.dtypes) == dict(docs.dtypes)
        found = left.collect()
        ids = {r.doc_id for r in found}
        if name == "quality_classifier":
            assert ids == {r.doc_id for r in quality.classify(docs, table(spark, data, "labels")).where("predicted = 1").collect()}
            assert len(ids) >= 0.8 * len(before)
        elif name == "line_dedup":
            assert ids == set(before) and all(r.n_chars == len(r.text) for r in found)
            gone = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(docs).collect()}
            assert all(r.text.count("\n") + 1 == before[r.doc_id].count("\n") + 1 - gone[r.doc_id] or not r.text for r in found) and sum(gone.values()) > 0
        elif name == "simhash_near_dedup":
            assert ids == smallest_of_groups([(i, t or "") for i, t in before.items()])
        elif name == "benchmark_decontamination":
            assert set(before) - ids == {r.doc_id for r in decontaminate.leaks(docs, table(spark, data, "benchmark")).collect()} and len(ids) < len(before)
        else:
            library = pieces.vocabulary(pieces.model_bytes()).library
            assert all(r.ids == library.encode(before[r.doc_id]) and r.decoded == library.decode(r.ids) for r in found) and ids == set(before)
        docs = left
    assert {tuple(r)[:4] for r in corpus_pipeline.run(spark, data).collect()} == {tuple(r)[:4] for r in docs.collect()}


def test_odd_documents(spark, odd, data, make_docs):
    for docs in (odd, make_docs([])):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, data)
            docs.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == odd.columns
