"""Scores of trained models, text by text in plain Python, and the queries that digest per-document results."""

import hashlib
import math
import re

import numpy as np
import pytest
import tiktoken
from test_simple_ops import slow_hits, slow_secrets, slow_statistics

from docintake.llm import bpe, langid, quality_mil, rules_iforest
from docintake.llm import queries as q


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def tables(spark, sf):
    read = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    return {n: read(n) for n in ("documents", "labels", "benchmark")}


@pytest.fixture(scope="module")
def texts(tables):
    return {r.doc_id: r.text for r in tables["documents"].collect()}


def test_quality_scores(spark, sf, tables, texts):
    """Attention over passages written out as sums."""
    m = quality_mil.fit(tables["documents"], tables["labels"])
    got = {r.doc_id: r.score for r in q.op3_attention_quality(spark, sf).collect()}
    for doc_id in sorted(texts)[:40]:
        bag = (quality_mil.passages(texts[doc_id]) - m.mean) / m.scale
        hidden = [np.tanh(x @ m.dense + m.dense_bias) for x in bag]
        energy = [sum(math.tanh(h @ v) / (1 + math.exp(-(h @ u))) * w for v, u, w in zip(m.v.T, m.u.T, m.w, strict=True)) for h in hidden]
        share = np.exp(np.array(energy) - max(energy))
        z = sum(a * h for a, h in zip(share / share.sum(), hidden, strict=True))
        assert abs(got[doc_id] - 1 / (1 + math.exp(-(z @ m.out + m.out_bias[0])))) < 1e-5


def test_language_scores(spark, sf, tables, texts):
    """Convolution, maximum and softmax position by position."""
    net = langid.fit(tables["documents"])
    got = {r.doc_id: (r.lang_pred, r.score) for r in q.op10_byte_cnn_language(spark, sf).collect()}
    for doc_id in sorted(texts, key=lambda i: len(texts[i]))[:25] + [max(texts, key=lambda i: len(texts[i]))]:
        text = texts[doc_id]
        if not re.search(r"[^\W\d_]", text):
            assert got[doc_id] == ("und", 0.0)
            continue
        logits = []
        for window in langid.windows(text.encode().translate(langid.LOWER)):
            z = net.embed[window]
            best = [max((z[p : p + w].ravel() @ f for p in range(len(z) - w + 1)), key=lambda v: v[k])[k] for w, f in zip(langid.WIDTHS, net.filters, strict=True) for k in range(f.shape[1])]
            logits.append(np.maximum(np.array(best) + net.bias, 0) @ net.out + net.out_bias)
        mean = np.mean(logits, axis=0)
        p = np.exp(mean - mean.max())
        p /= p.sum()
        assert got[doc_id][0] == net.names[int(p.argmax())] and abs(got[doc_id][1] - p.max()) < 1e-3



def test_rules_verdicts(spark, sf, tables, texts):
    """Base columns and verdicts of the query from the statistics of each text alone."""
    forests = rules_iforest.fit(tables["documents"], tables["labels"])
    for r in q.op4_isolation_rules(spark, sf).collect():
        stats = rules_iforest.statistics(texts[r.doc_id])
        base = slow_statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        worst, rejected = rules_iforest.judge(np.array([stats]), forests)
        assert r.base_failed == failed and r.kept == (not failed and not rejected[0]) and abs(r.anomaly - worst[0]) < 1e-9


def test_winnowing_query(spark, sf, tables, texts):
    items = [(r.item_id, r.text) for r in tables["benchmark"].collect()]
    for r in q.op5_winnowing(spark, sf).collect():
        words, hit, ids = slow_hits(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (words, hit, len(ids), sha(",".join(ids)), hit > 0)


def test_bpe_query(spark, sf, texts):
    codec = bpe.codec(*q.public_vocabulary())
    own = tiktoken.Encoding("own", pat_str=q.public_vocabulary()[1], mergeable_ranks=codec.ranks, special_tokens={})
    for r in q.op8_byte_bpe(spark, sf).collect():
        ids = own.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(texts[r.doc_id]))


def test_secrets_query(spark, sf, texts):
    kinds = ("assign", "access", "hex")
    for r in q.op9_secret_entropy(spark, sf).collect():
        base = slow_secrets(texts[r.doc_id])
        joined = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3)) and r.base_sha256 == sha(joined)
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert [x for x in spans if x[0] != "entropy"] == [[kinds[k], str(s), str(e)] for s, k, e in base]


def test_repeated_ids_train_on_one_text_wherever_rows_lie(tables):
    docs, labels = tables["documents"].limit(60), tables["labels"]
    twice = docs.union(docs.selectExpr("doc_id", "concat(text, ' and more of it') as text", "lang", "source", "n_chars"))
    fits = [[quality_mil.fit(d, labels), langid.fit(d), rules_iforest.fit(d, labels)] for d in (twice.repartition(1), twice.repartition(7, "n_chars"))]
    (a_mil, a_net, a_forest), (b_mil, b_net, b_forest) = fits
    assert all(np.array_equal(x, y) for x, y in zip(a_mil.parameters(), b_mil.parameters(), strict=True))
    assert np.array_equal(a_net.out, b_net.out)
    assert {k: f.threshold for k, f in a_forest.items()} == {k: f.threshold for k, f in b_forest.items()}


def test_calibrated_threshold():
    good = np.array([True] * 100 + [False] * 20)
    scores = np.concatenate([np.linspace(0.3, 0.5, 100), np.linspace(0.6, 0.8, 20)])
    t = rules_iforest.calibrated(scores, good)
    assert not (scores[good] >= t).any() and (scores[~good] >= t).mean() > 0.9
    tied = rules_iforest.calibrated(np.full(120, 0.5), good)
    assert tied > 0.5  # good and bad rows that score alike are all kept


def test_labelled_rows_are_whole(spark, tables):
    """The bound of the fit leaves rows out, never a part of one."""
    from docintake.llm.common import whole_rows

    assert whole_rows([("a", 5), ("b", 99), ("c", 4), ("d", 2), ("e", 1)], 10) == ["a", "c"] and whole_rows([], 3) == []
    docs = tables["documents"].limit(80)
    lang = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    x, langs = langid.training_windows(docs, 50, 400)
    left = sorted((y, w.tobytes()) for y, w in zip(langs, x, strict=True))
    assert 0 < len(left) <= 400
    whole = [sorted((y, w.tobytes()) for w in langid.windows(t.encode().translate(langid.LOWER))) for y, t in lang.values() if y and t]
    for bag in sorted(whole, key=len, reverse=True):  # what is left after whole documents are taken out is nothing
        if all(left.count(w) >= bag.count(w) for w in bag):
            for w in bag:
                left.remove(w)
    assert not left
    assert langid.training_windows(docs, 50, 0)[1] == []
    assert quality_mil.fit(docs, tables["labels"], most=0) is None


def test_path_lengths():
    """Tree 0 split by split: sides are never empty, a leaf's depth is its level and the mean search among its points."""
    rng = np.random.default_rng(3)
    rows = np.round(rng.normal(size=(400, 3)), 1)  # with ties
    forest = rules_iforest.Forest.grow(rows, trees=1, per_tree=64)
    sample = rows[np.random.default_rng(7).choice(len(rows), 64, replace=False)]

    def usual(n):
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def walk(at, part, level):
        f = forest.feature[0, at]
        if f < 0:
            assert level == forest.height or len(part) == 1 or (part == part[0]).all()
            assert abs(forest.depth[0, at] - (level + usual(len(part)))) < 1e-9
            return len(part)
        side = part[:, f] <= forest.limit[0, at]
        assert level < forest.height and side.any() and not side.all()
        return walk(forest.child[0, at], part[side], level + 1) + walk(forest.child[0, at] + 1, part[~side], level + 1)

    def depth(row, at=0):
        f = forest.feature[0, at]
        return forest.depth[0, at] if f < 0 else depth(row, forest.child[0, at] + (row[f] > forest.limit[0, at]))

    assert walk(0, sample, 0) == 64
    assert np.allclose(forest.score(rows), [2 ** (-depth(r) / usual(64)) for r in rows])


def test_entropy_of_windows_by_class():
    """Which words have a window over the threshold of its class, each window counted from scratch."""
    from collections import Counter
    from random import Random

    from docintake.llm import secret_scan as scan

    rng, letters = Random(2), {"digits": "0123456789", "hex": "0123456789abcdefABCDEF", "letters": "qzxwvkjQZXWVKJabcdefgh", "alnum": "q9Zt4Lx8Vb2Nm6Wp0Rs5Kd7", "base64": "q9Z+4/x8Vb2-m6Wp_Rs5Kd7"}
    hits = 0
    for _ in range(600):
        kinds = rng.choices(list(letters), k=rng.randrange(1, 4))
        word = "".join("".join(rng.choices(letters[k], k=rng.randrange(8, 30))) for k in kinds)
        want = False
        for i in range(max(1, len(word) - scan.WINDOW + 1)):
            window = word[i : i + scan.WINDOW]
            bits = -sum(n / len(window) * math.log2(n / len(window)) for n in Counter(window).values())
            kind = "digits" if window.isdigit() else "hex" if set(window) <= set("0123456789abcdefABCDEF") else "letters" if window.isalpha() else "alnum" if window.isalnum() else "base64"
            want |= kind != "digits" and bits >= scan.THRESHOLDS[kind] - 1e-12
        assert scan.reaches(word) == want or abs(bits - scan.THRESHOLDS.get(kind, 9)) < 1e-9, word
        hits += want
    assert 100 < hits < 590
