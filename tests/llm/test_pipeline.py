"""The pipeline over the small table, each stage on its own input."""

import os

import corpus_pipeline
import public_tokenizers
from test_dedup import line_model
from test_jaccard import brute
from test_scans import model
from test_tokenizers import RANKS

from gridloom.functions.lineage import shared_folder
from gridloom.llm import bpe, langid
from gridloom.llm.common import held_out, written

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DATA))
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    whole = corpus_pipeline.run(spark, DATA)
    assert whole.count() == counts[-1]


def test_stages_take_odd_and_empty_tables(spark, odd, none):
    for table in (odd, none):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, DATA))
        assert docs.count() <= table.count()


def test_each_stage_equals_a_plain_version_on_its_own_input(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    known = written(stages["language_id"](spark, docs, DATA))
    fitted = langid.fit(docs.where(~held_out("doc_id", 4, 2)))
    assert set(texts(known)) == {r.doc_id for r in langid.predict(docs, fitted).where("not rejected").collect()}
    lined, before = written(stages["line_dedup"](spark, known, DATA)), texts(known)
    gone = line_model([(k, before[k] or "") for k in sorted(before)], 50)
    want = {}
    for k, t in before.items():
        rest = [x for i, x in enumerate(t.split("\n")) if i not in gone[k]]
        if not gone[k] or any(x.strip() for x in rest):
            want[k] = [x for x in rest if x.strip()]
    assert {k: [x for x in t.split("\n") if x.strip()] for k, t in texts(lined).items()} == want
    near, before = written(stages["near_dedup"](spark, lined, DATA)), texts(lined)
    assert set(texts(near)) == {k for k, top in brute(sorted(before.items())).items() if k == top}
    clean, before = written(stages["decontamination"](spark, near, DATA)), texts(near)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert set(texts(clean)) == {k for k, x in model(sorted(before.items()), items, 10).items() if not x[1]}
    codec, after = bpe.codec(RANKS, public_tokenizers.PATTERN), texts(clean)
    for r in stages["byte_bpe"](spark, clean, DATA).collect():
        assert codec.decode(list(r.ids)).decode() == after[r.doc_id] and r.n_tokens == len(r.ids)


def test_tables_in_between_go(spark):
    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    corpus_pipeline.run(spark, DATA).count()
    assert len([x for x in set(os.listdir(folder)) - before if x.startswith("gridloom-")]) == 1
