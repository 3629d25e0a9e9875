"""Operators that join or shuffle, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docintake.llm import html_main, html_pages, html_tree, pii, sharding, sieve, simhash
from docintake.llm import queries as q
from docintake.llm.components import connected


def components(fingerprints, radius=4):
    """Least index reachable for each of the fingerprints, by comparing all pairs."""
    fps = np.array(fingerprints, dtype=np.uint64)
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= radius).tolist():
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def slow_fingerprint(text):
    import xxhash

    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_query(spark, sf, documents):
    got = {r.doc_id: r for r in q.op2_simhash_near_dedup(spark, sf).collect()}
    rows = sorted(documents.collect(), key=lambda r: r.doc_id)
    fps = [slow_fingerprint(r.text) for r in rows]
    for r, fp, at in zip(rows, fps, components(fps), strict=True):
        assert got[r.doc_id].fingerprint == f"{fp:016x}" and got[r.doc_id].component_id == rows[at].doc_id


@pytest.mark.parametrize("hot", [2, 5, 10_000])
def test_links_lose_nothing(spark, hot):
    rng = np.random.default_rng(hot)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = {int(c) for c in centres}
    for c in centres.tolist():
        for _ in range(40):
            flips = rng.choice(64, rng.integers(0, 7), replace=False)
            fps.add(int(np.bitwise_xor.reduce([np.uint64(1) << np.uint64(b) for b in flips] + [np.uint64(c)])))
    fps = sorted(simhash.signed(x) for x in fps)
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    edges = simhash.links(nodes, 4, hot)
    label = {r.node: r.label for r in connected(edges).collect()}
    expected = components([x & (1 << 64) - 1 for x in fps])
    assert [label.get(x, x) for x in fps] == [fps[i] for i in expected]


@pytest.mark.parametrize("radius, hot", [(1, 5), (3, 5), (3, 1000)])
def test_odd_radius(spark, radius, hot):
    """Crowded part values meet at midpoints of which one side may be further away; components are those of all pairs."""
    rng = np.random.default_rng(radius)
    fps = set()
    for c in rng.integers(0, 1 << 63, 4, dtype=np.uint64).tolist():
        for _ in range(60):
            flips = rng.choice(64, rng.integers(0, 5), replace=False)
            fps.add(int(np.bitwise_xor.reduce([np.uint64(1) << np.uint64(b) for b in flips] + [np.uint64(c)])))
    fps = sorted(simhash.signed(x) for x in fps)
    edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), radius, hot)
    label = {r.node: r.label for r in connected(edges).collect()}
    expected = components([x & (1 << 64) - 1 for x in fps], radius)
    assert [label.get(x, x) for x in fps] == [fps[i] for i in expected]


def test_plan_covers_the_radius():
    rng = np.random.default_rng(0)
    sample = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    for radius in (2, 4, 6):
        parts = simhash.plan(sample, radius)
        masks = [p.mask for p in parts]
        assert sum(p.threshold + 1 for p in parts) == radius + 1 and all(a & b == 0 for i, a in enumerate(masks) for b in masks[:i])
        for p in parts:
            width = p.mask.bit_count()
            assert p.near + p.far == p.threshold and [len(set(p.flips(r))) for r in (p.near, p.far)] == [simhash.ball(width, r) for r in (p.near, p.far)]
            assert all(f & ~p.mask == 0 for f in p.flips(p.far))


def test_plan_keeps_rows_in_proportion():
    """Rows for each fingerprint do not move with the number of fingerprints, nor with near copies among them."""
    rng = np.random.default_rng(4)
    rows = set()
    for copies in (0, 50, 400):
        sample = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
        sample[:copies] = sample[0] ^ (np.uint64(1) << rng.integers(0, 64, copies, dtype=np.uint64))
        rows.add(sum(simhash.ball(p.mask.bit_count(), p.far) for p in simhash.plan(sample, 4)))
    assert rows == {66}


@pytest.mark.parametrize("most_bytes", [0, 1 << 20])
def test_sieve_is_exact(spark, most_bytes):
    rows = [(i if i % 7 else None, f"text {i % 1500}", "x") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string").repartition(4)
    keys = docs.select("doc_id", F.xxhash64("text").alias("text_key"), (F.crc32(F.concat_ws(" ", F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string"), "text").cast("binary")) % 3 > 0).alias("stays"))
    wanted = {(i, t) for i, t, _ in rows if zlib.crc32(f"{-1 if i is None else i} {t}".encode()) % 3}
    got = sieve.without(docs, keys, most_bytes)
    assert got.columns == docs.columns
    found = [(r.doc_id, r.text) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == wanted


def test_allocate_is_the_least():
    costs = [[0, 5, 9, 20], [0, 1, 30, 40], [0, 4, 5, 6]]
    best = min(sum(c[u] for c, u in zip(costs, us, strict=True)) for us in [(a, b, c) for a in range(4) for b in range(4) for c in range(4) if a + b + c == 3])
    assert simhash.allocate(costs, 3)[0] == best


def test_components_of_a_long_path(spark):
    n = 300
    order = np.random.default_rng(1).permutation(n).tolist()
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(7, 7), (1000, 1001), (1001, 1000)], "a long, b long")
    got = {r.node: r.label for r in connected(edges).collect()}
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000}


def test_simhash_edges(odd, none):
    got = simhash.near_duplicates(odd).collect()
    empty = [r for r in got if r.fp == 0]
    assert len(got) == 9 and {r.doc_id for r in empty} >= {2, 3, 4} and {r.component_id for r in empty} == {2}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    by = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(by) == len(set(by)) == 6 and {1, 2, None, 5, 6} == {i for i, _ in by}


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 4), (3, 3)):
        points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        index = sharding.hilbert_index(points, bits)
        assert sorted(index.tolist()) == list(range(len(points)))
        path = points[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bins_of_long_prefixes(spark):
    """Values that begin alike still part; bins are of equal depth and keep the order of whole strings."""
    values = [f"https://example.org/a/very/long/prefix/{i:04}" for i in range(640)]
    rows = spark.createDataFrame([(v, "x" * (i % 7)) for i, v in enumerate(values)] + [(None, "x")], "url string, text string").repartition(5)
    bins = dict((r.url, r.b) for r in rows.select("url", sharding.quantised(rows, ["url"], 5)[0].alias("b")).collect())
    order = [bins[v] for v in values]
    assert bins[None] == 0 and order == sorted(order) and set(order) == set(range(32)) and max(map(order.count, set(order))) <= 21
    skewed = spark.createDataFrame([("a",)] * 900 + [(f"b{i:03}",) for i in range(100)], "v string")
    found = sorted((r.v, r.b) for r in skewed.select("v", sharding.quantised(skewed, ["v"], 3)[0].alias("b")).distinct().collect())
    assert [b for _, b in found] == sorted(b for _, b in found) and found[0] == ("a", 0) and found[1][1] == 1


def test_shard_order_follows_the_curve(spark, sf, documents):
    """Slots follow the curve index that plain Python works out from bins of its own."""
    rows = q.op1_hilbert_shards(spark, sf).collect()
    placed = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in placed] == sorted(r.curve for r in rows)
    docs = {r.doc_id: r for r in documents.collect()}

    def bins(d):
        values = sorted(getattr(r, d) for r in docs.values() if getattr(r, d) is not None)
        ends = sorted({v for i, v in enumerate(values) if (i + 1) * 32 // len(values) > i * 32 // len(values)})[:-1]
        return {v: sum(x < v for x in ends) for v in set(values)} | {None: 0}

    own = {d: bins(d) for d in ("lang", "source", "n_chars")}
    for r in rows:
        point = [own[d][getattr(docs[r.doc_id], d)] for d in own]
        assert r.curve == sharding.hilbert_index(np.array([point]), 5)[0]


def test_shards(spark, sf, documents):
    rows = q.op1_hilbert_shards(spark, sf).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    sizes, n = {}, len(texts)
    for r in rows:
        sizes.setdefault(r.shard, []).append(r.slot)
        data = texts[r.doc_id].encode()
        assert r["size"] == len(data) + 8 and r.text_crc32 == zlib.crc32(data)
    assert len(rows) == n and set(sizes) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in sizes.values())
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1


def test_shard_edges(odd, none, tmp_path):
    placed = sharding.hilbert_shards(odd, ["lang", "source", "n_chars"], shards=24)
    rows = placed.collect()
    assert len(rows) == 9 and len({(r.shard, r.slot) for r in rows}) == 9 and all(r.slot == 0 for r in rows)
    assert {r["size"] for r in rows if r.doc_id == 2} == {8}
    assert sharding.hilbert_shards(none, ["lang"], shards=3).count() == 0
    sharding.write_shards(odd.select("doc_id", "text", "lang"), sharding.hilbert_shards(odd, ["lang", "n_chars"], shards=2), str(tmp_path / "out"))
    back = odd.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == 9 and set(back.columns) == {"doc_id", "text", "lang", "shard"}


def slow_pii(text):
    def luhn(digits):
        return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0

    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, p in patterns.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]
            if ok():  # noqa: B023
                out.append((kind, m.start(), m.end()))
    return out


ODD_PII = [
    "a@b.c_d@e.f x@y@z.com .@-.- a@b..c a@b.c. q+w%e@x-y.z1",
    "1.2.3.4.5.6.7.8 256.1.1.1 000.0255.1.1 1.2.3 999999999999999999.1.1.1 1.2.3.4",
    "4111 1111-1111 1111 4111  1111 4111111111111112 5500005555555559x 0000000000000",
    "+1 (743) 555-3824 +12345678 +1234567890123456 +1-.-.-.-. 5 🙂 +49 30 1234567)",
    "🙂🙂 é a@b.co 🙂 192.168.0.1 日本 +1 (743) 555-3824\n4111111111111111",
    "+4111111111111111 call", "", None, "@" * 50, "9" * 40, "1 " * 3000, "x@y.zz " * 700,
]


def test_pii_base_spans(spark, documents):
    rows = [(i, t) for i, t in enumerate(ODD_PII)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(documents.select(F.col("doc_id") + 1000, "text"))
    texts = dict((r.doc_id, r.text) for r in docs.collect())
    for r in pii.spans(docs).collect():
        got = [(s.kind, s.start, s.end) for k in pii.KINDS for s in r[k]]
        assert got == slow_pii(texts[r.doc_id]), texts[r.doc_id]


def test_pii_long_runs(spark):
    texts = ["7" * 1_000_000, "a" * 1_000_000 + "@", "1." * 500_000, "+1" + " " * 1_000_000, "a@b.co " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: len(r.email) + len(r.ip) + len(r.card) + len(r.phone) for r in pii.spans(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 125_000, 3: 0, 4: 20_000}


def test_terms_that_reveal(spark):
    rng = np.random.default_rng(0)
    filler = lambda: " ".join(rng.choice([f"word{i}" for i in range(60)], 12))
    rows = [(i, f"{filler()} Zebrano called ann@x.org about {filler()}") for i in range(6)]
    rows += [(i, f"{filler()} with bob{i}@x.org and {filler()}") for i in range(10, 60)] + [(i, filler()) for i in range(100, 200)]
    rows.append((9, "nobody but ZEBRANO is named here"))  # points to the address without it
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (pii.MOST_TERMS, 0):  # terms looked up in place, and joined
        found = {r.doc_id: [(s.start, s.end) for s in r.term] for r in pii.spans(docs, most).collect()}
        for i, text in rows:
            words = [text[a:b].lower() for a, b in found[i]]
            assert ("zebrano" in words) == (i < 10) and not any(w.startswith("word") for w in words)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("Zebrano" not in clean[i] and "[EMAIL]" in clean[i] for i in range(6)) and all(clean[i] == t for i, t in rows if i >= 100)
    copies = spark.createDataFrame([(i, "same odd context ann@x.org of a copied text") for i in range(20)], "doc_id long, text string")
    assert all(not r.term for r in pii.spans(copies).collect())


def slow_disclosive(texts):
    """(term, bits, share) of all entities, from the definition: addresses only, one word pattern."""
    email, word = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), re.compile(r"[^\W_]+")
    contexts, named, holding = {}, {}, {}
    for i, text in enumerate(texts):
        for w in {w.lower() for w in word.findall(text)}:
            holding.setdefault(w, set()).add(i)
        found, at = [*email.finditer(text)], 0
        for k, m in enumerate(found):
            before = text[at : m.start()]
            after = text[m.end() : found[k + 1].start() if k + 1 < len(found) else len(text)]
            at = m.end()
            if len(before) > 80:
                before = re.sub(r"^[^\W_]+", "", before[-80:])
            if len(after) > 80:
                after = re.sub(r"[^\W_]+$", "", after[:80])
            entity = m[0].lower()
            contexts.setdefault(entity, set()).add(f"{before} {after}")
            named.setdefault(entity, set()).add(i)
    out = []
    for entity, wordings in contexts.items():
        counts = Counter(w for c in wordings for w in {w.lower() for w in word.findall(c)})
        for term, n in counts.items():
            if len(wordings) >= pii.SUPPORT and n >= pii.SUPPORT and n >= pii.ALWAYS * len(wordings):
                bits = math.log2(n / len(wordings) / (len(holding[term]) / len(texts)))
                share = bits / max(1.0, -math.log2(len(named[entity]) / len(texts)))
                if share >= pii.DISCLOSED:
                    out.append((term, round(bits, 9), round(share, 9)))
    return sorted(out)


def test_disclosed_bits(spark):
    """Entities with three and more contexts, terms on both sides of the limits, several addresses in a text."""
    rng = np.random.default_rng(12)
    letter = lambda k: chr(97 + k // 26) + chr(97 + k % 26)  # noqa: E731 - words with digits in a row count as numbers
    names = [f"Name{letter(k)}" for k in range(12)]
    texts = []
    for i in range(400):
        words = list(rng.choice([f"word{letter(j)}" for j in range(80)], rng.integers(5, 30)))
        for k in rng.choice(12, rng.integers(0, 3), replace=False).tolist():
            near = [names[k]] if rng.random() < 0.2 + 0.07 * k else []
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = [*near, f"mail{letter(k)}@x.org", *([f"rare{letter(k)}"] if k % 3 == 0 else [])]
        if i % 50 == 0:
            words.append(names[i // 50])
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = slow_disclosive(texts)
    for most in (pii.MOST_TERMS, 0):
        got = sorted((r.term, round(r.bits, 9), round(r.share, 9)) for r in pii.disclosive(docs, most_terms=most).collect())
        assert got == want
    assert any(t.startswith("name") for t, _, _ in want) and any(t.startswith("rare") for t, _, _ in want) and len(want) < 40
    terms, found = {t for t, _, _ in want}, pii.spans(docs).collect()
    for r in found:
        text = texts[r.doc_id]
        assert [(s.start, s.end) for s in r.term] == [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text) if m[0].lower() in terms]


def test_sanitised_text(spark, odd, none):
    docs = spark.createDataFrame(list(enumerate(ODD_PII)), "doc_id long, text string")
    for r in pii.sanitise(docs).collect():
        text = ODD_PII[r.doc_id]
        if text is None:
            assert r.text is None
            continue
        expected, at = "", 0
        for kind, a, b in sorted(slow_pii(text), key=lambda s: (s[1], -s[2])):
            if a >= at:
                expected += text[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        assert r.text == expected + text[at:]
    long = ["é" * k + "a@b.co" + "🙂" * (1024 - k) + " 1.2.3.4" for k in (0, 505, 511, 512, 1024)] + ["x" * 5000 + " a@b.co"]
    rows = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    for r in pii.sanitise(rows).collect():  # spans at the limits of blocks
        assert r.text == long[r.doc_id].replace("a@b.co", "[EMAIL]").replace("1.2.3.4", "[IP]")
    same = pii.sanitise(odd)
    assert same.columns == odd.columns and same.count() == 9
    assert pii.sanitise(none).count() == 0 and pii.spans(none).count() == 0


def test_pii_query(spark, sf, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in q.op6_pii_disclosure(spark, sf).collect():
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in slow_pii(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)


@pytest.fixture(scope="module")
def model():
    return html_main.fit()


def test_sum_product_is_exact():
    rng = np.random.default_rng(3)
    parent = np.array([-1, 0, 0, 1, 1, 2, 5, -1, 7])
    unary, pair = rng.normal(size=(9, 2)), rng.normal(size=(2, 2))
    node, edge = html_main.sum_product(unary, pair, parent, html_main.levels_of(parent))
    weights, states = [], []
    for code in range(1 << 9):
        y = [(code >> i) & 1 for i in range(9)]
        weights.append(np.exp(sum(unary[i, y[i]] + (pair[y[parent[i]], y[i]] if parent[i] >= 0 else 0) for i in range(9))))
        states.append(y)
    weights, states = np.array(weights) / sum(weights), np.array(states)
    assert np.allclose(np.exp(node[:, 1]), weights @ states)
    assert np.allclose(np.exp(edge[4, 1, 1]), (weights * states[:, 1] * states[:, 4]).sum())


def test_held_out_layouts(model):
    pages, labels = html_pages.labelled_pages(150, seed=77)
    right = 0
    for page, y in zip(pages, labels, strict=True):
        right += html_main.texts_of([page], model)[0] == " ".join(t for n, t, _ in page.runs if y[n])
    assert right / len(pages) > 0.9


def test_pages_of_the_corpus(spark, sf):
    from html import unescape

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in q.op7_dom_belief(spark, sf).collect():
        inner = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        text = " ".join(unescape(re.sub(r"<[^>]+>", " ", re.sub("</?b>", "", inner))).split())
        assert r.text == text and r.n_chars == len(text)


PAGES = {
    "<body><nav><a href=x>Menu</a></nav><article><h1>T&eacute;st &amp; more</h1><p>One <b>bo</b>ld\n\t line.<br>Next<p>Two, three.</article><footer>Foot</footer>": "Tést & more One bold line. Next Two, three.",
    "<article><p>Text with 1 < 2 and a&nbsp;b.</p><script>var a='</p><p>no</p>';</script><style>p{}</style><!-- <p>gone</p> --><p>Last one.</p></article>": "Text with 1 < 2 and a b. Last one.",
    "<article><p>Body of the article, long enough to count.</p><form><p>Subscribe now</p></form><div class='comments'><p>First!</p></div></article>": "Body of the article, long enough to count.",
    "<article><p>super<wbr>long a<img src=x>b and <math><mi>x</mi></math>y, written by hand.</p><noscript><p>Kept as well, no script.</p></noscript></article>": "superlong ab and xy, written by hand. Kept as well, no script.",
    "<article><p>A reference ends at a tag, as in a &am<b>p;</b> b, written by hand.</p><p>So x &lt<i>;</i> y keeps its semicolon here.</p></article>": "A reference ends at a tag, as in a &amp; b, written by hand. So x <; y keeps its semicolon here.",
    "<article><h1>A title</h1><p>Seen by every reader of this page, all of it.</p><p style='display:none'>Not seen by anybody here.</p><p>More of the text that readers see.</p></article>": "A title Seen by every reader of this page, all of it. More of the text that readers see.",
    "": "",
    "<<<>>": None,
    "<div>" * 3000 + "deep": None,
}


def test_page_edges(spark, model):
    for html, text in PAGES.items():
        got = html_main.texts_of([html_tree.read(html)], model)[0]
        assert text is None or got == text
    assert html_main.texts_of([html_tree.read(None)], model) == [""]
    rows = [(1, None, None), (1, "u", ""), (None, "u", "<article><p>Some words here.</p></article>")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = html_main.main_text(frame).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, "Some words here."), (1, ""), (1, "")]
    assert html_main.main_text(frame.limit(0)).count() == 0
