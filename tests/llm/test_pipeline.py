"""The pipeline, stage by stage, against plain Python."""

import hashlib

import tiktoken
from test_joined_ops import components, slow_fingerprint, slow_pii
from test_simple_ops import slow_hits

import corpus_pipeline
from docintake.llm import bpe, rules_iforest
from docintake.llm.queries import public_vocabulary


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    forests = rules_iforest.fit(docs, labels)
    columns, kept = docs.columns, []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = sorted(docs.collect(), key=lambda r: r.doc_id)
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        after = {r.doc_id: r for r in docs.collect()}
        if number < 4:
            assert docs.columns == columns
        if number == 0:
            for r in before:
                stats = rules_iforest.statistics(r.text)
                _, bad = rules_iforest.judge(rules_iforest.np.array([stats]), forests)
                assert (r.doc_id in after) == (not rules_iforest.base_failed(stats) and not bad[0])
        elif number == 1:
            groups = components([slow_fingerprint(r.text) for r in before])
            assert set(after) == {before[g].doc_id for g in set(groups)}
        elif number == 2:
            assert set(after) == {r.doc_id for r in before if not slow_hits(r.text, items)[2]}
        elif number == 3:
            for r in before:
                base = slow_pii(r.text)
                text = after[r.doc_id].text
                assert (text == r.text) == (not base) and not slow_pii(text) and len(text) == after[r.doc_id].n_chars
        else:
            c = bpe.codec(*public_vocabulary())
            own = tiktoken.Encoding("own", pat_str=public_vocabulary()[1], mergeable_ranks=c.ranks, special_tokens={})
            for r in before:
                ids = own.encode_ordinary(r.text)
                assert after[r.doc_id].n_tokens == len(ids) and after[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
                assert after[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
        kept.append(len(after))
    assert len(before) == kept[-1] > 0 and kept == sorted(kept, reverse=True)
