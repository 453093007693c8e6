import re

import public_tokenizers
import sentencepiece

import corpus_pipeline
from siftwell.llm import mixing, secret_scan
from tests.llm.test_jaccard import brute
from tests.llm.test_secret_scan import brute as brute_spans

SF = "/root/testdata/sf0.001"


def test_pipeline_against_a_brute_force(spark):
    given = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [(i, r.text) for i, r in given.items() if re.search(r"[^\W\d_]", r.text or "")]
    kept = {c for _, _, c in brute(rows)}
    texts = {}
    for i in kept:
        t, out, at = given[i].text, "", 0
        for s in filter(None, brute_spans(t).split(",")):
            a, b = map(int, s.split(":")[1:])
            out, at = (out + t[at:a] + secret_scan.MASK if a >= at else out), max(at, b)
        texts[i] = out + t[at:]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} <= kept
    for r in got:
        assert r.ids == library.encode(texts[r.doc_id], add_eos=True) and r.lang == given[r.doc_id].lang
    docs = spark.createDataFrame([(i, t, given[i].lang, given[i].source, len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    want = {r.doc_id: r.copies for r in mixing.mix_plan(docs).collect() if r.copies}
    times = {}
    for r in got:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert times == want


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    rows = [(i, f"the text of document number {i} has some words in it", "en", "s", None) for i in range(40)]
    rows += [(None, None, None, None, None), (41, "", None, None, 0), (1, rows[1][1], "en", "s", None), (42, "word " * 30000, "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for source in (docs, docs.limit(0)):
        now = source
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == docs.columns, name
            now = spark.createDataFrame(now.collect(), docs.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() == now.count()
