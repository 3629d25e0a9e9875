"""Per-document operators against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from docintake.llm import bpe, decontam, langid, quality_mil, rules_iforest, secret_scan
from docintake.llm import queries as q

WORD = re.compile("[^\x20\x09-\x0d]+")


def slow_statistics(text):
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(grams)
    covered = {j for i, g in enumerate(grams) if counts[g] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_rule_statistics(documents):
    for row in documents.collect():
        assert rules_iforest.statistics(row.text)[:5] == slow_statistics(row.text)
    assert rules_iforest.statistics("a b c a b c a\n\nx\nx\n \n")[:5] == slow_statistics("a b c a b c a\n\nx\nx\n \n")
    assert rules_iforest.statistics("\xa0\n\xa0")[3] == 1


def test_rules_edges(odd, none, no_labels, spark):
    got = rules_iforest.quality_rules(odd, no_labels).collect()
    assert len(got) == 9 and all(r.base_failed and not r.kept for r in got)
    assert rules_iforest.quality_rules(none, no_labels).count() == 0
    labels = spark.createDataFrame([(5, 1, None), (5, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    assert rules_iforest.passing(odd, labels).columns == odd.columns


def test_forest_keeps_good_and_drops_symbol_junk(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")  # some dozens of bad rows that pass the base rules
    got = {r.doc_id: r for r in q.op4_isolation_rules(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [got[r.doc_id] for r in labels if r.quality == 1 and not got[r.doc_id].base_failed]
    bad = [got[r.doc_id] for r in labels if r.quality == 0 and not got[r.doc_id].base_failed]
    assert np.mean([r.kept for r in good]) > 0.99
    assert not bad or np.mean([r.kept for r in bad]) < 0.5


def test_isolation_score_of_an_outlier():
    rng = np.random.default_rng(0)
    rows = np.vstack([rng.normal(size=(500, 2)), [[9.0, 9.0]]])
    scores = rules_iforest.Forest.grow(rows).score(rows)
    assert scores.argmax() == 500 and scores[500] > 0.65


def slow_hits(text, items):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words_of = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for item_id, item in items:
        w = words_of(item)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[k : k + 10])].add(str(item_id))
    words, hit, ids = words_of(text), set(), set()
    for n in {len(k) for k in windows}:
        for k in range(len(words) - n + 1):
            if (g := tuple(words[k : k + n])) in windows:
                hit |= set(range(k, k + n))
                ids |= windows[g]
    return len(words), len(hit), sorted(ids)


def test_winnowing_finds_every_window():
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(6)] + ["Ünï", "É", "A1"]
    for _ in range(300):
        items = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 25)))) for i in range(6)]
        text = " ".join(rng.choice(vocabulary, 40)) + ", " + items[0][1] + "! " + items[1][1][3:]
        w = decontam.words_of(text)
        spans, ids = decontam.build_index([(str(i), t) for i, t in items]).hits(w)
        spans = decontam.merged(spans)
        assert (len(w), sum(b - a for a, b in spans), sorted(ids)) == slow_hits(text, items)


def test_contamination_edges(spark, odd, none):
    items = spark.createDataFrame(
        [(1, "Three FOUR; five"), (1, "Three FOUR; five"), (2, None), (3, " .. "), (None, "without an"), (4, "alpha beta gamma alpha beta gamma alpha beta gamma alpha beta")],
        "item_id long, text string",
    )
    for block in (decontam.BLOCK_BYTES, 100):
        got = decontam.contamination(odd, items, block_bytes=block).collect()
        by = {(r.doc_id, r.n_words): r for r in got}
        assert len(got) == 9 and by[1, 5]["items"] == ["1"] and (by[1, 5].starts, by[1, 5].ends) == ([2], [5])
        # the last word, gamma, ends no window: the item's windows start with alpha or beta
        assert by[5, 120_000].starts == [0] and by[5, 120_000].ends == [119_999]
        assert by[None, 5]["items"] == [""] and by[2, 0]["items"] == [] and by[4, 0].n_words == 0
        assert decontam.clean(odd, items, block_bytes=block).count() == 5
    assert decontam.contamination(none, items).count() == 0
    assert decontam.clean(odd, items.limit(0)).count() == 9


@pytest.fixture(scope="module")
def vocabulary():
    return q.public_vocabulary()


def test_bpe_equals_tiktoken(vocabulary, documents):
    import tiktoken

    c = bpe.codec(*vocabulary)
    own = tiktoken.Encoding("own", pat_str=vocabulary[1], mergeable_ranks=c.ranks, special_tokens={})
    texts = [r.text for r in documents.collect()] + ["", " ", "\n\n  x", "a" * 5000, "<|endoftext|>", "日本語テキスト 🙂🙂 é", "\x00\x01", "'s'S I'll", "١٢٣ ½"]
    for t in texts:
        ids = c.encode(t)
        assert ids == ",".join(map(str, own.encode_ordinary(t)))
        assert c.decode(ids) == t.encode()


def test_perfect_hash_is_minimal():
    keys = [f"key{i}".encode() for i in range(5000)]
    found = bpe.PerfectHash(keys)
    assert sorted(found.slots) == list(range(5000)) and all(found.find(k) == i for i, k in enumerate(keys))
    assert found.find(b"other") == -1 and bpe.PerfectHash([]).find(b"x") == -1 and bpe.PerfectHash([b"x"]).find(b"x") == 0


def test_remembered_words_turn_over(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    c = bpe.Codec(*vocabulary)
    text = " ".join(f"zq{i}xj" for i in range(20)) + " zq0xj zq19xj"
    assert c.decode(c.encode(text)) == text.encode() and c.encode(text) == c.encode(text)


def test_bpe_edges(odd, none, vocabulary):
    got = bpe.encode(odd, *vocabulary)
    assert sorted(len(r.ids) for r in got.collect())[:2] == [0, 0]
    back = {(r.doc_id, r.text) for r in bpe.decode(got, *vocabulary).collect()}
    assert back == {(r.doc_id, r.text or "") for r in odd.collect()}
    assert bpe.encode_digests(none, *vocabulary).count() == 0
    empty = [r for r in bpe.encode_digests(odd, *vocabulary).collect() if r.n_tokens == 0]
    assert empty[0].ids_sha256 == hashlib.sha256(b"").hexdigest()


def slow_secrets(text):
    out = []
    for m in re.finditer(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_base_spans(documents):
    planted = ["PassWord : 'abcdef", "token=abc", "ſecret=abcdefgh", "toKen=abcdefgh", "AKIAAKIA" + "X" * 12, "api-key: x", "APIKEY=aaaaaa", "f" * 23, "0" * 24 + "g" + "a" * 30, "token token=secret=abcdefg"]
    for text in planted + [r.text for r in documents.collect()]:
        assert [s for s in secret_scan.scan_text(text) if s[1] != 3] == slow_secrets(text)


def test_entropy_windows():
    text = "aaaaabbbbbcdefghijklmnopqrstuvw0123456789"
    slow = []
    for i in range(len(text) - 19):
        counts = Counter(text[i : i + 20]).values()
        slow.append(-sum(n / 20 * np.log2(n / 20) for n in counts))
    assert np.allclose(secret_scan.window_entropies(text), slow)
    kinds = lambda t: [secret_scan.KINDS[k] for _, k, _ in secret_scan.scan_text(t)]
    assert kinds("key q9Zt4Lx8Vb2Nm6Wp0Rs5Kd7 end") == ["entropy"]
    for harmless in ("id 123e4567-e89b-42d3-a456-426614174000", "see averylongwordwithoutanydigitsinside", "n 12345678901234567890123", "http://host/a1b2c3d4e5f6g7h8i9j0k1", "xyz1xyz1xyz1xyz1xyz1xyz1"):
        assert kinds(harmless) == []


def test_secret_edges(odd, none):
    assert secret_scan.scan_secrets(odd).count() == 9 and secret_scan.scan_secrets(none).count() == 0
    assert secret_scan.scan_text("a1" * 200_000)[0][2] == 400_000


def test_language(spark, sf):
    got = q.op10_byte_cnn_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"), "doc_id")
    held = [r for r in got.collect() if r.held_out and len(r.text) > 100]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in held)


def test_language_tables_equal_the_network():
    rng = np.random.default_rng(1)
    net = langid.Network.fresh(["a", "b"])
    x = rng.integers(0, 256, (7, langid.WINDOW), dtype=np.uint8)
    z, pooled = net.embed[x], []
    for w, f in zip(langid.WIDTHS, net.filters, strict=True):
        patches = np.lib.stride_tricks.sliding_window_view(z, (w, langid.EMBED), axis=(1, 2)).reshape(7, -1, w * langid.EMBED)
        pooled.append((patches @ f).max(axis=1))
    direct = np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0) @ net.out + net.out_bias
    assert np.allclose(direct, net.logits(x, net.tables()), atol=1e-4)


def test_windows_cover_the_text():
    data = bytes(range(1, 255)) * 3
    rows = langid.windows(data)
    runs = {bytes(r[i : i + 4]) for r in rows for i in range(langid.WINDOW - 3)}
    assert all(data[i : i + 4] in runs for i in range(len(data) - 3))
    assert len(langid.windows(b"")) == 1 and langid.windows(b"ab")[0].tolist()[:3] == [97, 98, 0]


def test_language_edges(odd, none):
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(odd).collect()}
    assert (2, "und") in got and (3, "und") in got and (4, "und") in got
    assert langid.identify(none).count() == 0


def test_quality(spark, sf, odd, none, no_labels):
    got = {r.doc_id: r for r in q.op3_attention_quality(spark, sf).collect()}
    held = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert np.mean([got[r.doc_id].predicted == r.quality for r in held]) > 0.9
    assert {r.score for r in quality_mil.quality(odd, no_labels).collect()} == {0.5}
    assert quality_mil.quality(none, no_labels).count() == 0
    labels = spark.createDataFrame([(i, i % 2, 0) for i in (3, 4, 5, 6)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality_mil.quality(odd, labels).collect())


def test_labels_of_held_out_rows_do_not_matter(spark, documents, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    from pyspark.sql import functions as F

    from docintake.llm.common import id_crc32

    flipped = labels.withColumn("quality", F.when(id_crc32("doc_id") % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_mil.fit(documents, x) for x in (labels, flipped))
    assert all(np.array_equal(p, r) for p, r in zip(a.parameters(), b.parameters(), strict=True))


def test_mil_gradients():
    rng = np.random.default_rng(2)
    x, starts, y = rng.random((9, quality_mil.WIDTH)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])
    m, weight = quality_mil.Model.fresh(x.mean(axis=0), x.std(axis=0)), np.ones(3)

    def loss():
        p = m.forward(x, starts)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for p, g in zip(m.parameters(), m.gradients(x, starts, y, weight), strict=True):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep = p[i]
        p[i] = keep + 1e-5
        up = loss()
        p[i] = keep - 1e-5
        down = loss()
        p[i] = keep
        assert abs((up - down) / 2e-5 - g[i]) < 1e-6


def _takes(fn, n):
    import time

    best = min(_timed(fn, n, time) for _ in range(3))
    return best


def _timed(fn, n, time):
    began = time.perf_counter()
    fn(n)
    return time.perf_counter() - began


@pytest.mark.parametrize("case", ["repeated words", "deep cells", "open templates", "many secrets"])
def test_long_texts_take_time_in_proportion(case):
    from docintake.llm import html_tree

    index = decontam.build_index([("1", "a " * 4000)])
    fn = {
        "repeated words": lambda n: index.hits(decontam.words_of("a " * n)),
        "deep cells": lambda n: html_tree.read("<div>" * n + "<td>x" * n),
        "open templates": lambda n: html_tree.read("<template>" * n + "</template>" * n + "<a " * n),
        "many secrets": lambda n: secret_scan.scan_text("token=q9Zt4Lx8Vb2Nm6Wp0Rs5Kd7 https://x.y/z a@b.co " * (n // 4)),
    }[case]
    assert _takes(fn, 16_000) < 4 * _takes(fn, 8_000)  # a quadratic loop takes four times as long; noise stays below


def test_hits_of_repeated_words_and_equal_items():
    items = [(str(i), "a " * 30) for i in range(40)] + [("z", "a " * 12 + "b"), ("s", "a a a")]
    for text in ("a " * 50, "a " * 9, "b " + "a " * 10 + "b"):
        spans, ids = decontam.build_index(items).hits(decontam.words_of(text))
        assert (len(text.split()), sum(b - a for a, b in decontam.merged(spans)), sorted(ids)) == slow_hits(text, items)


@pytest.mark.parametrize("bits", [1, 3, 7])
def test_windows_of_equal_hashes(monkeypatch, bits):
    """With hashes of a few bits nearly all windows collide; words tell them apart."""
    whole = decontam._spans_hash
    monkeypatch.setattr(decontam, "_spans_hash", lambda *x: whole(*x) & np.uint64(2**bits - 1))
    rng = np.random.default_rng(bits)
    vocabulary = ["a", "b", "c", "Ünï"]
    for _ in range(60):
        items = [(str(i), " ".join(rng.choice(vocabulary, rng.integers(0, 22)))) for i in range(6)] + [("z", "a " * 25)]
        text = " ".join(rng.choice(vocabulary, 30)) + ", " + items[0][1] + "! " + items[1][1][3:] + " a a a" * 4
        spans, ids = decontam.build_index(items).hits(decontam.words_of(text))
        assert (len(decontam.words_of(text)), sum(b - a for a, b in decontam.merged(spans)), sorted(ids)) == slow_hits(text, items)


def test_many_blocks_of_items(spark, documents):
    """A block for each few items gives what one index gives, rows that repeat included."""
    docs = documents.limit(60).union(documents.limit(5))
    items = spark.createDataFrame([(i, " ".join(r.text.split()[k : k + 14])) for i, (r, k) in enumerate((r, k) for r in documents.limit(12).collect() for k in (0, 5))] + [(99, "nothing of it here")], "item_id long, text string")
    plain = lambda df: sorted(map(repr, df.collect()))
    assert plain(decontam.contamination(docs, items)) == plain(decontam.contamination(docs, items, block_bytes=600))
    assert plain(decontam.clean(docs, items)) == plain(decontam.clean(docs, items, block_bytes=600))
    assert 0 < decontam.clean(docs, items).count() < 65
