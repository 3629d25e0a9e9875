"""The agenda against the sentencepiece library on whole texts, and the chunks against the library's own."""

import hashlib
import random

import pytest
import sentencepiece

from docintake.llm import queries as q
from docintake.llm import sentencepiece_bpe as sp


@pytest.fixture(scope="module")
def path():
    return q.public_pieces()


@pytest.fixture(scope="module")
def library(path):
    return sentencepiece.SentencePieceProcessor(model_file=path)


def joined(ids):
    return " ".join(map(str, ids))


ODD = ["", " ", "  ", "a", " a  b ", "▁x ▁▁y", "\0a", "é́ ﬁ", "日本語テキスト", "\n\n", "a\nb\r\n\tc", "<s>x</s> <unk> <0x41>", "🙂🙂 x", "0123 45", "ab" * 3000, " " * 5000, "▁" * 33, "e" * 70 + " " + "e" * 70]


def test_odd_texts(path, library):
    m = sp.Model(path)
    rng = random.Random(3)
    letters = list("abcdefghi  ▁▁\n\t\0é日本語🙂ﬁ<>/0123.,'​́ABTHE") + [" the", "ing", "tion"]
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(5000)]
    for t in texts:
        for end in (True, False):
            ids, want = m.encode(t, end), library.encode(t, add_eos=end)
            assert ids == joined(want) and m.decode(ids) == library.decode(want), t


def test_query_equals_library(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = q.op12_sentencepiece_agenda(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(joined(ids).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest() and r.agrees


def test_ids_that_are_no_text(path, library):
    m = sp.Model(path)
    rng = random.Random(5)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(1, 32_000)]) for _ in range(rng.randrange(8))]
        assert m.decode(joined(ids)) == library.decode(ids), ids


def test_a_wrong_piece_is_seen(path):
    referee = sp.Referee(path)
    referee.model.ranks = {k: -r for k, r in referee.model.ranks.items()}
    referee.model.encode("something else altogether", True)
    referee.judge()
    assert referee.differing and not referee.agrees("something else altogether") and referee.agrees("")


def test_turning_over(path, library, monkeypatch):
    monkeypatch.setattr(sp, "REMEMBERED", 3)
    m = sp.Model(path)
    text = " ".join(f"zq{i}xj" for i in range(20)) + " zq0xj zq19xj"
    assert m.encode(text, False) == m.encode(text, False) == joined(library.encode(text))


def test_other_models_are_refused(tmp_path, path):
    from sentencepiece import sentencepiece_model_pb2

    for change in ("model_type", "normalizer", "user"):
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            spec.ParseFromString(file.read())
        if change == "model_type":
            spec.trainer_spec.model_type = 1
        elif change == "normalizer":
            spec.normalizer_spec.remove_extra_whitespaces = True
        else:
            spec.pieces[500].type = sp.USER_DEFINED
        (file := tmp_path / change).write_bytes(spec.SerializeToString())
        with pytest.raises(ValueError):
            sp.Model(str(file))


def test_edges(odd, none, path):
    coded = sp.encode(odd, path)
    back = sorted((r.doc_id or -1, r.text) for r in sp.decode(coded, path).collect())
    assert back == sorted((r.doc_id or -1, r.text or "") for r in odd.collect())
    assert sorted(len(r.ids) for r in coded.collect())[:2] == [1, 1] and sorted(len(r.ids) for r in sp.encode(odd, path, end=False).collect())[:2] == [0, 0]
    assert sp.checked(none, path).count() == 0
    got = sp.checked(odd, path).collect()
    assert len(got) == 9 and all(r.agrees for r in got) and min(r.n_tokens for r in got) == 1


def test_lists_and_heaps_give_the_same_symbols(path, library):
    m = sp.Model(path)
    rng = random.Random(11)
    for n in [*range(1, sp.LISTED + 3)] * 10:
        chunk = sp.BLANK + "".join(rng.choice("aabeenrstitionülß日🙂") for _ in range(n))
        assert m.merge_short(chunk) == m.merge_long(chunk) == m.merge(chunk)
        assert m.encode(chunk[1:], False) == joined(library.encode(chunk[1:]))
