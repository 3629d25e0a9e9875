"""Fill-in-middle cuts against plain slicing."""

import hashlib
import random

import pytest
import regex

from docintake.llm import fim
from docintake.llm import queries as q


def slow(text, doc_id):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_slicing(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = q.op13_fenwick_fim(spark, sf).collect()
    assert len(got) == len(texts) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        n, form, first, middle, output = slow(texts[r.doc_id], r.doc_id)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, first, middle, sha(output), sha(texts[r.doc_id]))


@pytest.mark.parametrize("block", [1, 3, 7, 64])
def test_cuts_in_small_blocks(block):
    rng = random.Random(block)
    for _ in range(200):
        text = "".join(rng.choice("ab é日🙂\n\0") for _ in range(rng.randrange(40)))
        blocks = fim.Blocks(text, None, block)
        assert blocks.n == len(text)
        for k in range(len(text) + 1):
            at = blocks.cut(k)
            assert at == len(text[:k].encode()) and blocks.characters(at) == k


@pytest.mark.parametrize("block", [1, 5, 32])
def test_word_units(block):
    rng = random.Random(block)
    find = regex.compile(r"\w+")
    for _ in range(200):
        text = "".join(rng.choice("ab é日🙂\n") for _ in range(rng.randrange(60)))
        starts = [m.start() for m in find.finditer(text)]
        blocks = fim.Blocks(text, find, block)
        assert blocks.n == len(starts)
        for k in range(len(starts) + 1):
            want = 0 if k == 0 and starts else len(text) if k >= len(starts) else starts[k]
            assert blocks.characters(blocks.cut(k)) == want


def test_edges(odd, none, spark):
    made = fim.restore(fim.transform(odd))
    assert sorted((r.doc_id or -1, r.restored) for r in made.collect()) == sorted((r.doc_id or -1, r.text or "") for r in odd.collect())
    assert all(r.n == len(r.restored) for r in made.collect())
    assert fim.restore(fim.transform(none)).count() == 0
    always = fim.Draw(rate=100, spm_rate=50)
    rows = [(i, t) for i, t in enumerate(["<", "<P", "M>", "<S><", "a<M>b", ">" * 9, "<" * 9, "<P<S<M", "🙂é" * 5000])]
    got = fim.restore(fim.transform(spark.createDataFrame(rows, "doc_id long, text string"), always, unit=r"\w+|[^\w]")).collect()
    assert [(r.doc_id, r.restored) for r in got] == rows and {r.form for r in got} == {"plain", "psm", "spm"}
    with pytest.raises(ValueError):
        fim.Sentinels(prefix="<S>")
    with pytest.raises(ValueError):
        fim.Sentinels(middle="|")
