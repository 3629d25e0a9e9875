"""Golden values (fixed: what the functions must give) and edge cases of the functions."""

import pytest
from pyspark.sql import functions as F

from docintake.config import Condition, Template, normalize_extensions, parse_groups
from docintake.functions import naming, slow, text, validate
from docintake.operators import fields, ingest, lifecycle, signals
from docintake.sources import files


@pytest.fixture(scope="module")
def each(spark):
    """each(fn, values): fn(column) for each value."""

    def run(fn, values, kind="string"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [r[0] for r in rows.orderBy("i").select(fn(F.col("v"))).collect()]

    return run


def test_text(each):
    assert each(text.normalize_text, ["  Notá   Fiscál \n N123!  ", "12.345.678/0001-99", "", None]) == ["nota fiscal n123", "12 345 678 0001 99", "", None]
    assert each(text.norm_key, ["Número_Nota ", "numero  nota", "STRAßE"]) == ["numero nota", "numero nota", "strasse"]
    assert each(text.is_supported_ext, ["/a/x.PDF", "/a/.pdf", "/a/x.", "/a.pdf/x", "y.jpeg", None]) == [True, False, False, False, True, None]


def test_validation(each):
    assert each(validate.normalize_date, ["03/04/2026", "2026-04-03", " 20260403 ", "31/02/2026", "lixo", "", "2026"]) == ["2026-04-03"] * 3 + [None] * 4
    assert each(validate.normalize_money_brl, ["1.234,56", "R$ 2.000,00", "abc", "", "-,5"]) == ["1234.56", "2000.00", None, None, "-0.5"]
    assert each(validate.normalize_number, ["007", "5.", ".5", "-0.50", "1e3", " 42 "]) == ["7", "5", "0.5", "-0.50", "1E+3", "42"]
    assert each(validate.is_valid_cnpj, ["11.222.333/0001-81", "11.222.333/0001-80", "11111111111111", "1", None]) == [True, False, False, False, False]
    assert each(validate.is_valid_cpf, ["529.982.247-25", "529.982.247-24", "123"]) == [True, False, False]
    assert each(validate.normalize_bool, ["sim", "NÃO", "true", "talvez"]) == ["true", "false", "true", None]
    check = lambda kind, need, rx=(): lambda c: validate.validate_field(kind, c, need, [(F.lit(True), p) for p in rx])["valid"]
    assert each(check("numero", True), ["42", "", None, "x"]) == [True, False, False, False]
    assert each(check("texto", False), [None, "a"]) == [True, True]
    assert each(check("texto", True, ["^[0-9]+$"]), ["123abc", "123", "1" * 5000]) == [False, True, False]
    assert each(slow.lenient_date, ["3. Apr 2026", "32/1/2026", None]) == ["2026-04-03", None, None]
    assert each(slow.exotic_number, ["1e3", "x", None]) == ["1E+3", None, None]


def test_names(each, spark):
    assert each(naming.sanitize_component, ['a<b>c:d"e/f\\g|h?i*j', "CON", "lpt1.txt", "..", "x. ", ""]) == ["a_b_c_d_e_f_g_h_i_j", "_CON", "_lpt1.txt", "_", "x", "_"]
    assert each(lambda c: naming.sanitize_component(c, 8), ["abcdefghij.pdf", "abcdefghij", "a." + "b" * 20]) == ["abcd.pdf", "abcdefgh", "a.bbbbbb"]
    look = lambda value: (lambda name: value if name == "x" else F.lit(None).cast("string"))
    fill = lambda p: lambda c: naming.substitute(p, look(c))
    assert each(fill("{x:aaaa-mm}"), ["2026-06-03", "no date"]) == ["2026-06", None]
    assert each(fill("{x:sem_acento}"), ["IGUAÇU AÇÃO"]) == ["IGUACU ACAO"]
    assert each(fill("{x:substituir=a>e}|{x:letras=3}|{x:truncar=-2}"), ["banana"]) == ["benene|ban|bana"]
    assert each(fill("{x:maiusc:palavras=2}"), ["iguacu dist prod"]) == ["IGUACU DIST"]
    assert each(fill("{y:padrao=Geral}{x:nada}"), ["v", " "]) == ["Geralv", None]
    folder = lambda p: lambda c: naming.resolve_dest_folder(p, look(c), "/base")
    assert each(folder("C:\\NF\\{x}"), ["a:b/c"]) == ["C:\\NF\\a_b_c"]
    assert each(folder("../{x}"), [".."]) == ["/base/_/_"]


def test_config():
    assert parse_groups('["a", "b"]') == ((Condition("texto", "a"),), (Condition("texto", "b"),))
    assert parse_groups("{") == parse_groups('{"a": 1}') == parse_groups(None) == parse_groups("[]") == ()
    assert parse_groups('[[{"mode": "regex", "value": "x"}, 3], 4]') == ((Condition("regex", "x"),),)
    assert normalize_extensions("pdf, .XLSX; PDF") == [".pdf", ".xlsx"]


def test_signals(spark):
    docs = signals.haystacks(spark.createDataFrame([(1, "tenho um carro rural antigo"), (2, "valor total R$ 1.234,00 pago"), (3, None), (4, "a" * 40 + "!")], "document_id long, full_text string"))
    hit = lambda m, v: [r[0] for r in docs.orderBy("document_id").select(signals.condition(Condition(m, v))).collect()]
    assert hit("texto", "R$") == [False, True, False, False] and hit("texto", " ") == [False] * 4
    assert hit("regex", r"\d\.\d{3},") == [False, True, False, False] and hit("regex", "(") == [False] * 4
    assert hit("regex", "(a+)+$") == [False] * 4
    assert hit("regex", "(?<=r)\\$") == [False, True, False, False]
    none = signals.decide(signals.match_templates(docs, []), threshold=0)
    assert {r.decision for r in none.collect()} == {"quarantine"}
    many = [Template(i, str(i), ((Condition("texto", f"needle{i}"),),)) for i in range(450)] + [Template(999, "hit", ((Condition("texto", "valor total"),),))]
    got = {r.document_id: r.template_id for r in signals.decide(signals.match_templates(docs, many)).collect()}
    assert got == {1: None, 2: 999, 3: None, 4: None}


def test_pairs(spark):
    rows = [(1, '[{"key":"A b","value":"1"},{"key":"a_B","value":"2"},{"value":"x"},{"key":"c"}]'), (2, "nonsense"), (3, None), (4, "{}")]
    df = spark.createDataFrame(rows, "i int, j string").select("i", fields.pairs_map(files.read_pairs(F.col("j"))).alias("m"))
    assert {r.i: r.m for r in df.collect()} == {1: {"a b": "2", "c": ""}, 2: {}, 3: {}, 4: {}}


def test_blocks_and_empty_tables(spark):
    f = spark.createDataFrame([(1, 5, 2), (2, 3, None), (3, 0, 2), (4, 4, 0)], "file_id long, page_count long, pages_per_block int")
    got = sorted((r.file_id, r.first_page, r.last_page) for r in ingest.block_ranges(f).collect())
    assert got == [(1, 1, 2), (1, 3, 4), (1, 5, 5), (2, 1, 3), (4, 1, 4)]
    none = spark.createDataFrame([], "path string, hash string, arrival long")
    assert ingest.ingest_gate(none, none.select("hash")).count() == 0
    log = spark.createDataFrame([], "document_id long, ts timestamp, id long, to_state string, step string")
    assert lifecycle.replay_states(log).count() == 0


def test_replay_in_pieces(spark, sf):
    """However the log is cut into pieces, the result is that of one fold in plain Python."""
    import random

    from docintake.config import STATES, TRANSITIONS

    r = random.Random(5)
    rows = [(r.randrange(4), f"2024-01-{r.randrange(1, 9):02} {r.randrange(24):02}:00:00", i, r.choice([*STATES, "x"]), r.choice([None, "a", "b"])) for i in range(600)]
    log = spark.createDataFrame(rows, "document_id long, ts string, id long, to_state string, step string")
    expected = {}
    for doc, *_, wanted, named in sorted(rows, key=lambda x: (x[1], x[2])):
        state, step, rejected = expected.get(doc, ("recebido", None, 0))
        ok = wanted in TRANSITIONS[state]
        expected[doc] = (wanted, named or step, rejected) if ok else (state, step, rejected + 1)
    for piece in ("hour", "day", "year"):
        assert {x.document_id: (x.state, x.step, x.rejected) for x in lifecycle.replay_states(log, piece=piece).collect()} == expected


def test_quiet_files_in_pieces(spark):
    rows = [("a", 1, 1, "2024-01-01 00:59:00"), ("a", 1, 1, "2024-01-01 01:01:00"), ("a", 1, 1, "2024-01-01 03:00:00"), ("b", 1, 1, "2024-01-01 00:00:00"), ("b", 2, 1, "2024-01-01 02:00:00"), ("b", 2, 1, "2024-01-01 02:30:00"),
            ("c", 1, 1, "2024-01-01 00:00:00"), ("c", None, None, "2024-01-01 05:00:00"), ("d", 1, None, "2024-01-01 00:00:00"), ("d", 1, None, "2024-01-01 09:00:00")]
    seen = spark.createDataFrame(rows, "path string, size long, mtime long, ts string")
    got = sorted((x.path, x["size"], x.since, x.seen) for x in ingest.stable_files(seen, 1800).collect())
    assert got == [("a", 1, "2024-01-01 00:59:00", "2024-01-01 03:00:00"), ("b", 2, "2024-01-01 02:00:00", "2024-01-01 02:30:00"), ("d", 1, "2024-01-01 00:00:00", "2024-01-01 09:00:00")]


def test_write_stage_twice_adds_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, v string")
    where = str(tmp_path / "t")
    files.write_stage(df, where, "k")
    files.write_stage(df, where, "k")
    assert files.staged_table(spark, where).count() == 2


def test_scan_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in (("a.PDF", b"%PDF-1"), ("sub/b.jpg", b"\xff\xd8x"), ("c.txt", b"x")):
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r.kind for r in files.scan_files(spark, str(tmp_path)).withColumn("kind", files.blob_type(F.col("content"))).collect()}
    assert got == {"a.PDF": "pdf", "b.jpg": "jpeg"}


def test_live_states_equal_replay(spark, sf, tmp_path):
    from docintake.plans.inputs import frame
    from docintake.streaming import ops

    log = frame(spark, sf, "state_log").withColumn("ts", F.col("ts").cast("timestamp"))
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    ops.live_states(stream, str(tmp_path / "live"), str(tmp_path / "c"), buckets=2).awaitTermination()
    expected = {(r.document_id, r.state, r.step, r.rejected) for r in lifecycle.replay_states(log).collect()}
    assert {(r.document_id, r.state, r.step, r.rejected) for r in ops.latest(spark, str(tmp_path / "live"), "document_id").collect()} == expected


def test_signal_groups_over_a_table(spark):
    """The table form reads what parse_groups() reads."""
    from docintake.operators import signals

    texts = ['["a", "b"]', "{", '{"a": 1}', None, "[]", '[[{"mode": "regex", "value": "x"}, 3], 4]', '[[{"value": 5}]]', '["a", [{"value": "b"}]]', '[[{"mode": null, "value": null}], []]', '[["x", {"value": "y", "mode": ""}]]', "[1, 2]", '[[{"value": true}, {"value": false}, {"value": 0}]]', '"a"', '["", "é"]', "null", '[[], "x"]']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", signals.signal_groups(F.col("s")).alias("g")).collect()
    for r in rows:
        assert tuple(tuple(Condition(c.mode, c.value) for c in g) for g in r.g) == parse_groups(texts[r.i]), texts[r.i]
