"""Queries of classification and fields: C and F."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Condition, Template, TemplateField
from ..functions import text, validate
from ..operators import classify, fields, needles, signals
from ..sources.files import read_pairs, spread
from .registry import query


def _t(template_id: int, name: str, *groups: list[tuple[str, str]]) -> Template:
    return Template(template_id, name, tuple(tuple(Condition(m, v) for m, v in g) for g in groups))


#: The user's templates; 6 has no groups, 7 an invalid pattern, 1 and 8 overlap.
TEMPLATES = [
    _t(1, "English", [("texto", "that the")], [("texto", "of an"), ("texto", "the")]),
    _t(2, "French", [("texto", "de la"), ("regex", r"\bles\b")], [("texto", "éau")]),
    _t(3, "German", [("texto", "nicht"), ("texto", "der")], [("regex", r"\bund\b.*\bder\b")]),
    _t(4, "Spanish", [("texto", "CIÓN")]),
    _t(5, "Contact", [("regex", r"[a-z0-9.]+@[a-z]+\.[a-z]+")], [("regex", r"\+\d{1,3} \(")]),
    _t(6, "Empty"),
    _t(7, "Broken", [("regex", "([")], [("regex", "x" * 600)]),
    _t(8, "Secrets", [("regex", r"token = "), ("texto", "the")], [("texto", "||")]),
]
NUMBERS = "1, 2, 3, 4, 5, 6, 7, 8"

N = r"trim(regexp_replace(lower(strip_accents(coalesce(full_text, ''))), '[^\p{L}\p{N}_]+', ' ', 'g'))"
L = "lower(coalesce(full_text, ''))"
#: The templates in DuckDB, over n (normalised) and l (lowered). RE2 has no Unicode \b.
W = r"[^\p{L}\p{N}_\p{M}]"
HITS = rf"""n AS (SELECT document_id, lang, {N} AS n, {L} AS l FROM {{texts}}),
    hits AS (SELECT document_id, lang,
      contains(n, 'that the') OR (contains(n, 'of an') AND contains(n, 'the')) AS t1,
      (contains(n, 'de la') AND regexp_matches(l, '(^|{W})les($|{W})')) OR contains(n, 'eau') AS t2,
      (contains(n, 'nicht') AND contains(n, 'der')) OR regexp_matches(l, '(^|{W})und{W}.*{W}der($|{W})') OR regexp_matches(l, '(^|{W})und{W}der($|{W})') AS t3,
      contains(n, 'cion') AS t4,
      regexp_matches(l, '[a-z0-9.]+@[a-z]+\.[a-z]+') OR regexp_matches(l, '\+\d{{{{1,3}}}} \(') AS t5,
      false AS t6, false AS t7,
      (regexp_matches(l, 'token = ') AND contains(n, 'the')) OR contains(l, '||') AS t8 FROM n),
    m AS (SELECT document_id, lang, list_filter([CASE WHEN t1 THEN 1 END, CASE WHEN t2 THEN 2 END, CASE WHEN t3 THEN 3 END, CASE WHEN t4 THEN 4 END, CASE WHEN t5 THEN 5 END, CASE WHEN t8 THEN 8 END], lambda x: x IS NOT NULL) AS ids FROM hits),
    d AS (SELECT document_id, lang, ids, CASE len(ids) WHEN 0 THEN 'quarantine' WHEN 1 THEN 'matched' ELSE 'ambiguous' END AS decision, CASE WHEN len(ids) = 1 THEN CAST(ids[1] AS BIGINT) END AS template_id FROM m)"""


def matched(t):
    docs = signals.match_templates(signals.haystacks(spread(t.texts, t.documents, "document_id")), TEMPLATES)
    return docs.drop("full_text", "lowered", "normalised")


def decided(t):
    return signals.decide(matched(t))


@query("c1_normalize_text", f"SELECT document_id, sha256({N}) AS hash FROM {{texts}}")
def c1(t):
    return t.texts.select("document_id", F.sha2(text.normalize_text(F.coalesce("full_text", F.lit(""))), 256).alias("hash"))


@query(
    "c1_other_forms",
    """SELECT document_id, CASE document_id % 3 WHEN 0 THEN sha256(lower(lang) || ' ' || strip_accents(lower(full_text))) WHEN 1 THEN replace(replace(lower(lang), 'e', chr(4352) || chr(4449)), 'f', chr(4370) || chr(4449) || chr(4523)) ELSE replace(lower(lang), 'f', 'fi') END AS plain FROM {texts}""",
)
def c1_forms(t):
    """Full-width letters, Hangul syllables and ligatures, put in place of plain letters, come back as what they stand for."""
    low, wide = "abcdefghijklmnopqrstuvwxyz", "".join(chr(0xFF41 + i) for i in range(26))
    k, lang = F.col("document_id") % 3, F.lower("lang")
    whole = F.translate(F.concat(lang, F.lit(" "), F.lower("full_text")), low, wide)
    raw = F.when(k == 0, whole).when(k == 1, F.translate(lang, "ef", "\uac00\ud55c")).otherwise(F.replace(lang, F.lit("f"), F.lit("\ufb01")))
    plain = text.strip_accents(raw)
    return t.texts.select("document_id", F.when(k == 0, F.sha2(plain, 256)).otherwise(plain).alias("plain"))


@query("c2_haystacks", f"SELECT document_id, length({L}) AS lowered, length({N}) AS normalised FROM {{texts}}")
def c2(t):
    return signals.haystacks(t.texts).select("document_id", F.length("lowered").cast("long").alias("lowered"), F.length("normalised").cast("long").alias("normalised"))


SIGNALS = """CASE document_id % 6 WHEN 0 THEN '["nota ' || iso || '", "x"]' WHEN 1 THEN '{{broken' WHEN 2 THEN '[[{{"mode": "regex", "value": "' || iso || '"}}, 7], "y", [{{"value": 5, "mode": ""}}]]' WHEN 4 THEN '[[{{"value": "a"}}, {{"value": "b' || iso || '"}}], []]' WHEN 5 THEN '{{"value": "a"}}' END"""


@query(
    "c3_signal_groups",
    """SELECT document_id, CASE document_id % 6 WHEN 0 THEN 'texto=nota ' || iso || '|texto=x' WHEN 2 THEN 'regex=' || iso || '|texto=5' WHEN 4 THEN 'texto=a&texto=b' || iso || '|' ELSE '' END AS groups,
       CAST(CASE document_id % 6 WHEN 0 THEN 2 WHEN 2 THEN 2 WHEN 4 THEN 2 ELSE 0 END AS BIGINT) AS n FROM {order_values}""",
)
def c3(t):
    """Configurations as JSON texts of a table: flat, nested, partly and wholly malformed ones."""
    made = t.order_values.select("document_id", signals.signal_groups(F.expr(SIGNALS.replace("{{", "{").replace("}}", "}"))).alias("g"))
    joined = F.array_join(F.transform("g", lambda g: F.array_join(F.transform(g, lambda c: F.concat(c["mode"], F.lit("="), c["value"])), "&")), "|")
    return made.select("document_id", joined.alias("groups"), F.size("g").cast("long").alias("n"))


@query("c4_text_condition", f"SELECT document_id, contains({N}, 'de la') AS long_needle, contains({L}, 'é|') OR contains({L}, 'ß') AS short_needle, false AS no_needle FROM {{texts}}")
def c4(t):
    h = signals.haystacks(t.texts)
    c = lambda v: signals.condition(Condition("texto", v))
    return h.select("document_id", c("  DE -- Lá ").alias("long_needle"), (c("É|") | h.lowered.contains("ß")).alias("short_needle"), c("  ").alias("no_needle"))


@query("c5_regex_condition", rf"SELECT document_id, regexp_matches({L}, '\+\d{{{{1,3}}}} \(\d+\)') AS found, false AS invalid, false AS too_long FROM {{texts}}")
def c5(t):
    c = lambda v: signals.condition(Condition("regex", v))
    return signals.haystacks(t.texts).select("document_id", c(r"\+\d{1,3} \(\d+\)").alias("found"), c("([").alias("invalid"), c("a" * 513).alias("too_long"))


@query("c6_groups", f"WITH {HITS} SELECT document_id, t1, t2, t6 FROM hits")
def c6(t):
    h = signals.haystacks(t.texts)
    return h.select("document_id", *[signals.template_matches(x).alias(f"t{x.template_id}") for x in TEMPLATES if x.template_id in (1, 2, 6)])


@query(
    "c7_match_templates",
    f"""WITH {HITS}, p AS (SELECT document_id, unnest([{NUMBERS}]) AS template_id, ids FROM m)
       SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY CASE WHEN list_contains(ids, template_id) THEN 0 ELSE 1 END, template_id) AS rank, CAST(template_id AS BIGINT) AS template_id,
       CASE WHEN list_contains(ids, template_id) THEN 1.0 ELSE 0.0 END AS confidence FROM p""",
)
def c7(t):
    return signals.exploded(matched(t))


#: A rule that makes as many needles as there are rows of three letters out of twelve.
LETTERS = "etaoinshrdlu"
MANY = [a + b + c for a in LETTERS for b in LETTERS for c in LETTERS]


@query(
    "c7_many_templates",
    f"""WITH n AS (SELECT document_id, {N} AS n FROM {{texts}}), w AS (SELECT k, substr('{LETTERS}', CAST(k // 144 AS INT) + 1, 1) || substr('{LETTERS}', CAST(k // 12 % 12 AS INT) + 1, 1) || substr('{LETTERS}', CAST(k % 12 AS INT) + 1, 1) AS w FROM range(1728) r(k)),
       h AS (SELECT n.document_id, a.k + 1 AS template_id FROM n, w a JOIN w b ON b.k = (a.k + 1) % 1728 WHERE contains(n.n, a.w) AND contains(n.n, b.w))
       SELECT n.document_id, count(template_id) AS templates, CAST(coalesce(sum(template_id), 0) AS BIGINT) AS ids FROM n LEFT JOIN h ON n.document_id = h.document_id GROUP BY 1""",
)
def c7_many(t):
    """1,728 templates of two needles each."""
    made = [_t(k + 1, w, [("texto", w), ("texto", MANY[(k + 1) % len(MANY)])]) for k, w in enumerate(MANY)]
    docs = needles.match_many(signals.haystacks(spread(t.texts, t.documents, "document_id")), made)
    ids = F.aggregate("matches", F.lit(0).cast("long"), lambda n, m: n + m["template_id"])
    return docs.select("document_id", F.size("matches").cast("long").alias("templates"), ids.alias("ids"))


@query("c8_decide", f"WITH {HITS} SELECT document_id, decision, template_id, CASE WHEN decision = 'matched' THEN 1.0 END AS confidence FROM d")
def c8(t):
    return decided(t).select("document_id", "decision", "template_id", "confidence")


@query("c8_decisions_by_language", f"WITH {HITS} SELECT lang, decision, count(*) AS n FROM d GROUP BY 1, 2")
def c8_language(t):
    return decided(t).groupBy("lang", "decision").agg(F.count("*").alias("n"))


@query(
    "c9_evaluate_groups",
    f"WITH n AS (SELECT document_id, {N} AS n FROM {{texts}}) SELECT document_id, CAST(1 AS BIGINT) AS template_id, CAST(contains(n, 'that the') AS BIGINT) + CAST(contains(n, 'of an') AND contains(n, 'the') AS BIGINT) AS groups_held, contains(n, 'that the') OR (contains(n, 'of an') AND contains(n, 'the')) AS matched FROM n",
)
def c9(t):
    return signals.group_report(signals.evaluate_groups(signals.haystacks(t.texts), TEMPLATES[0]))


@query("c10_ambiguous_candidates", f"WITH {HITS} SELECT document_id, CAST(unnest(ids) AS BIGINT) AS template_id FROM d WHERE decision = 'ambiguous'")
def c10(t):
    return signals.ambiguous_candidates(decided(t))


def template_ids(t):
    return t.spark.createDataFrame([(x.template_id,) for x in TEMPLATES], "template_id long")


@query(
    "c11_apply_decisions",
    f"""WITH {HITS}, j AS (SELECT d.document_id, d.decision, d.template_id, e.document_id IS NOT NULL AND d.decision <> 'matched' AS open, e.template_id AS et, e.confidence AS ec FROM d LEFT JOIN {{decisions}} e ON d.document_id = e.document_id)
       SELECT document_id, CASE WHEN open AND et IN ({NUMBERS}) THEN 'matched' WHEN decision = 'ambiguous' OR open THEN 'quarantine' ELSE decision END AS decision,
       CASE WHEN open AND et IN ({NUMBERS}) THEN et WHEN open THEN NULL ELSE template_id END AS template_id,
       CASE WHEN open AND (et IN ({NUMBERS}) OR decision = 'ambiguous') THEN ec WHEN decision = 'matched' THEN 1.0 END AS confidence FROM j""",
)
def c11(t):
    return classify.apply_decisions(decided(t).select("document_id", "decision", "template_id", "confidence"), t.decisions, template_ids(t))


@query(
    "c12_paid_call_gate",
    f"""WITH {HITS} SELECT CAST(count_if(decision = 'ambiguous' AND document_id % 5 <> 0) AS BIGINT) AS tie, CAST(count_if(decision = 'quarantine' AND document_id % 5 <> 0) AS BIGINT) AS fallback, CAST(count_if(document_id % 3 > 0) AS BIGINT) AS fields FROM d""",
)
def c12(t):
    docs = decided(t).withColumns({"forced": F.col("document_id") % 5 == 0, "missing_required": F.col("document_id") % 3})
    calls = classify.paid_calls(docs, True, True)
    return calls.agg(F.count_if("tie_call").alias("tie"), F.count_if("fallback_call").alias("fallback"), F.count_if("fields_call").alias("fields"))


@query(
    "c13_forced_template",
    f"""WITH {HITS}, f AS (SELECT document_id, decision, template_id, CASE WHEN document_id % 5 = 0 THEN document_id % 11 END AS ft FROM d)
       SELECT document_id, CASE WHEN ft BETWEEN 1 AND 8 THEN 'matched' WHEN ft IS NOT NULL THEN 'error' ELSE decision END AS decision, CASE WHEN ft BETWEEN 1 AND 8 THEN ft WHEN ft IS NULL THEN template_id END AS template_id,
       CASE WHEN ft IS NULL AND decision = 'matched' THEN 1.0 END AS confidence FROM f""",
)
def c13(t):
    docs = decided(t).select("document_id", "decision", "template_id", "confidence")
    forced = t.texts.where("document_id % 5 = 0").select("document_id", (F.col("document_id") % 11).alias("template_id"))
    return classify.forced_template(docs, forced, template_ids(t))


@query("c14_classify_once", "SELECT document_id FROM {docs} WHERE document_id NOT IN (SELECT document_id FROM {results})")
def c14(t):
    return classify.classify_once(t.docs.select("document_id"), t.results)


REQUIRED = {1: "numero, valor, cnpj", 2: "numero, valor", 3: "valor, emissao, urgente", 4: "numero", 5: ""}
FIELDS = {
    1: [TemplateField("Número Pedido", "numero", True), TemplateField("Valor Total", "moeda", True), TemplateField("cnpj", "cpf_cnpj", True)],
    2: [TemplateField("numero_pedido", "texto", True, r"\d+"), TemplateField("VALOR TOTAL", "moeda", True), TemplateField("urgente", "booleano")],
    3: [TemplateField("valor total", "moeda", True), TemplateField("data emissão", "data", True), TemplateField("Urgente", "booleano", True)],
    4: [TemplateField("numero pedido", "numero", True), TemplateField("Data Emissao", "data")],
    5: [TemplateField("data emissao", "data"), TemplateField("CNPJ", "cpf_cnpj")],
}


def pairs(t):
    return spread(t.order_json, t.orders, "document_id").select("document_id", "template_id", fields.pairs_map(read_pairs(F.col("fields_json"))).alias("pairs"))


#: What normalisation gives for the raw values, column by column; broken JSON has no values at all.
VALUES = r"""v AS (SELECT document_id, template_id, document_id % 29 = 0 AS broken,
    CASE WHEN document_id % 29 <> 0 THEN coalesce(numero, 'ignored') END AS numero,
    CASE WHEN document_id % 29 <> 0 THEN valor END AS valor, CASE WHEN document_id % 29 <> 0 THEN emissao END AS emissao,
    CASE WHEN document_id % 29 <> 0 THEN cnpj END AS cnpj, CASE WHEN document_id % 29 <> 0 THEN urgente END AS urgente, cents, iso FROM {order_raw}),
  c AS (SELECT *, list_transform(range(1, 15), lambda i: CAST(substr(cnpj, CAST(i AS INT), 1) AS INT)) AS g FROM v),
  k AS (SELECT *, list_sum(list_transform(range(1, 13), lambda i: g[i] * [5,4,3,2,9,8,7,6,5,4,3,2][i])) % 11 AS r1, list_sum(list_transform(range(1, 14), lambda i: g[i] * [6,5,4,3,2,9,8,7,6,5,4,3,2][i])) % 11 AS r2 FROM c),
  n AS (SELECT *, CASE WHEN regexp_full_match(numero, '\d+') THEN CAST(CAST(numero AS BIGINT) AS VARCHAR) END AS numero_n,
    CASE WHEN valor LIKE 'R$%' THEN CAST(cents // 100 AS VARCHAR) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') END AS valor_n,
    CASE WHEN emissao NOT LIKE '31/02%' THEN iso END AS emissao_n,
    CASE WHEN g[13] = CASE WHEN r1 < 2 THEN 0 ELSE 11 - r1 END AND g[14] = CASE WHEN r2 < 2 THEN 0 ELSE 11 - r2 END THEN cnpj END AS cnpj_n,
    CASE trim(urgente) WHEN 'Sim' THEN 'true' WHEN 'não' THEN 'false' END AS urgente_n FROM k)"""


@query("f1_norm_key", r"SELECT document_id, sha256(trim(regexp_replace(replace(lower(strip_accents(replace(full_text, ' ', '_ '))), 'ß', 'ss'), '[\s_]+', ' ', 'g'))) AS hash FROM {texts}")
def f1(t):
    """Whole texts as if they were field names."""
    raw = F.replace(F.upper("full_text"), F.lit(" "), F.lit("_ "))
    return t.texts.select("document_id", F.sha2(text.norm_key(raw), 256).alias("hash"))


@query("f2_pairs_map", f"WITH {VALUES} SELECT document_id, numero, valor, urgente FROM v")
def f2(t):
    at = lambda k: F.try_element_at("pairs", F.lit(k))
    return pairs(t).select("document_id", at("numero pedido").alias("numero"), at("valor total").alias("valor"), at("urgente").alias("urgente"))


LONG = """l AS (SELECT document_id, template_id, 0 AS field_no, numero AS raw, true AS required FROM v WHERE template_id = 1 UNION ALL SELECT document_id, template_id, 1, valor, true FROM v WHERE template_id = 1
  UNION ALL SELECT document_id, template_id, 2, cnpj, true FROM v WHERE template_id = 1 UNION ALL SELECT document_id, template_id, 0, numero, true FROM v WHERE template_id = 2 UNION ALL SELECT document_id, template_id, 1, valor, true FROM v WHERE template_id = 2
  UNION ALL SELECT document_id, template_id, 2, urgente, false FROM v WHERE template_id = 2 UNION ALL SELECT document_id, template_id, 0, valor, true FROM v WHERE template_id = 3 UNION ALL SELECT document_id, template_id, 1, emissao, true FROM v WHERE template_id = 3
  UNION ALL SELECT document_id, template_id, 2, urgente, true FROM v WHERE template_id = 3 UNION ALL SELECT document_id, template_id, 0, numero, true FROM v WHERE template_id = 4 UNION ALL SELECT document_id, template_id, 1, emissao, false FROM v WHERE template_id = 4
  UNION ALL SELECT document_id, template_id, 0, emissao, false FROM v WHERE template_id = 5 UNION ALL SELECT document_id, template_id, 1, cnpj, false FROM v WHERE template_id = 5)"""


def mapped(t):
    return fields.map_fields(pairs(t), fields.template_fields_table(t.spark, FIELDS))


@query("f3_map_fields", f"WITH {VALUES}, {LONG} SELECT document_id, template_id, field_no, raw, required AND raw IS NULL AS missing_required FROM l")
def f3(t):
    return mapped(t).select("document_id", "template_id", "field_no", "raw", "missing_required")


@query("f4_merge_missing", f"WITH {VALUES}, {LONG} SELECT document_id, template_id, field_no, CASE WHEN required AND raw IS NULL AND document_id % 2 = 0 THEN CASE (template_id * 10 + field_no) WHEN 32 THEN 'Sim' WHEN 11 THEN '1,50' WHEN 21 THEN '1,50' WHEN 30 THEN '1,50' ELSE NULL END ELSE raw END AS raw FROM l")
def f4(t):
    extra = t.order_raw.where("document_id % 2 = 0").select("document_id", F.explode(F.array(
        *[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"), F.lit(i).alias("pos")) for i, (k, v) in enumerate([("URGENTE", "nao"), (" urgente", "Sim"), ("valor_total", "1,50")])]
    )).alias("e")).select("document_id", "e.*")
    return fields.merge_missing(mapped(t), extra).select("document_id", "template_id", "field_no", "raw")


@query("f5_normalize_date", f"WITH {VALUES} SELECT document_id, CASE WHEN NOT broken THEN emissao_n END AS normalized FROM n")
def f5(t):
    raw = F.when(F.col("document_id") % 29 != 0, F.concat(F.lit("  "), F.col("emissao"), F.lit(" ")))
    return t.order_raw.select("document_id", validate.normalize_date(raw).alias("normalized"))


@query("f6_normalize_money", f"WITH {VALUES} SELECT document_id, valor_n AS normalized FROM n")
def f6(t):
    return t.order_raw.select("document_id", F.when(F.col("document_id") % 29 != 0, validate.normalize_money_brl(F.col("valor"))).alias("normalized"))


@query("f7_normalize_number", r"SELECT document_id, CASE WHEN regexp_full_match(numero, '\d+') THEN CAST(CAST(numero AS BIGINT) AS VARCHAR) END AS normalized FROM {order_raw}")
def f7(t):
    return t.order_raw.select("document_id", validate.normalize_number(F.col("numero")).alias("normalized"))


@query("f8_normalize_doc_id", "SELECT document_id, cnpj AS digits FROM {order_raw}")
def f8(t):
    c = F.col("cnpj")
    dotted = F.concat(F.substring(c, 1, 2), F.lit("."), F.substring(c, 3, 6), F.lit("/"), F.substring(c, 9, 4), F.lit("-"), F.substring(c, 13, 2))
    return t.order_raw.select("document_id", validate.normalize_doc_id(dotted).alias("digits"))


@query("f9_cnpj", f"WITH {VALUES} SELECT document_id, cnpj_n IS NOT NULL AS valid FROM n")
def f9(t):
    """The tax id of every document; where the pairs are broken there is none."""
    return pairs(t).select("document_id", validate.is_valid_cnpj(F.try_element_at("pairs", F.lit("cnpj"))).alias("valid"))


CPF = """p AS (SELECT document_id, lpad(CAST((document_id * 104729) % 1000000000 AS VARCHAR), 9, '0') AS b, o_custkey % 100 AS last FROM {order_raw}),
  g AS (SELECT *, list_transform(range(1, 10), lambda i: CAST(substr(b, CAST(i AS INT), 1) AS INT)) AS d FROM p),
  r AS (SELECT *, list_sum(list_transform(range(1, 10), lambda i: d[i] * (11 - i))) % 11 AS m1, last // 10 AS x, last % 10 AS y FROM g),
  s AS (SELECT *, (list_sum(list_transform(range(1, 10), lambda i: d[i] * (12 - i))) + 2 * x) % 11 AS m2 FROM r)"""


@query("f9_cpf", f"WITH {CPF} SELECT document_id, x = CASE WHEN m1 < 2 THEN 0 ELSE 11 - m1 END AND y = CASE WHEN m2 < 2 THEN 0 ELSE 11 - m2 END AND NOT (b = repeat(substr(b, 1, 1), 9) AND x = y AND x = CAST(substr(b, 1, 1) AS INT)) AS valid FROM s")
def f9_cpf(t):
    digits = F.concat(F.lpad(((F.col("document_id") * 104729) % 1000000000).cast("string"), 9, "0"), F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"))
    return t.order_raw.select("document_id", validate.is_valid_cpf(digits).alias("valid"))


@query("f10_normalize_bool", "SELECT document_id, CASE document_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS normalized FROM {order_raw}")
def f10(t):
    return t.order_raw.select("document_id", validate.normalize_bool(F.col("urgente")).alias("normalized"))


CHECKED = f"""{VALUES}, {LONG}, w AS (SELECT l.document_id, l.template_id, field_no, raw, required,
    CASE l.template_id * 10 + field_no WHEN 10 THEN numero_n WHEN 11 THEN valor_n WHEN 12 THEN cnpj_n WHEN 20 THEN l.raw WHEN 21 THEN valor_n WHEN 22 THEN urgente_n WHEN 30 THEN valor_n WHEN 31 THEN emissao_n WHEN 32 THEN urgente_n WHEN 40 THEN numero_n WHEN 41 THEN emissao_n WHEN 50 THEN emissao_n ELSE cnpj_n END AS normalized
    FROM l JOIN n ON l.document_id = n.document_id WHERE raw IS NOT NULL OR required),
  x AS (SELECT *, CASE WHEN raw IS NULL THEN NOT required ELSE normalized IS NOT NULL AND (template_id * 10 + field_no <> 20 OR regexp_full_match(raw, '\\d+')) END AS valid FROM w)"""
PATTERNS = [f.regex for fs in FIELDS.values() for f in fs if f.regex]


@query("f11_validate_field", f"WITH {CHECKED} SELECT document_id, template_id, field_no, valid, normalized FROM x")
def f11(t):
    return fields.validated(mapped(t), PATTERNS).select("document_id", "template_id", "field_no", "valid", "normalized")


@query("f12_field_regex", r"SELECT document_id, coalesce(regexp_full_match(numero, '\d+'), false) AS digits, coalesce(regexp_full_match(numero, 'n?[0-9]{{1,4}}'), false) AS short FROM {order_raw}")
def f12(t):
    ok = lambda p: F.coalesce(validate.regex_ok(F.col("numero"), p), F.lit(False))
    return t.order_raw.select("document_id", ok(r"\d+").alias("digits"), ok("n?[0-9]{1,4}").alias("short"))


SCORED = f"""{CHECKED}, s AS (SELECT document_id, template_id, CASE WHEN count_if(required) = 0 THEN 1.0 ELSE count_if(required AND valid) / count_if(required) END AS score, count_if(required AND valid) < count_if(required) AS invalid_required FROM x GROUP BY 1, 2)"""


@query("f13_confidence", f"WITH {SCORED} SELECT document_id, score, invalid_required FROM s")
def f13(t):
    return fields.compute_confidence(fields.validated(mapped(t), PATTERNS))


FILLED = f"{SCORED}, a AS (SELECT r.document_id, r.template_id, coalesce(s.score, 1.0) AS score, coalesce(invalid_required, false) AS invalid_required FROM {{order_raw}} r LEFT JOIN s ON r.document_id = s.document_id)"


def filled(t):
    return fields.fill_nested(pairs(t), FIELDS)


@query("f14_route", f"WITH {FILLED} SELECT document_id, CASE WHEN invalid_required OR score < 0.8 THEN 'em_revisao' ELSE 'processando' END AS state, 'classificado' AS step FROM a")
def f14(t):
    r = classify.route(F.col("template_id"), F.col("score"), F.col("invalid_required"))
    return filled(t).select("document_id", r.alias("r")).select("document_id", "r.state", "r.step")


@query("f15_confidence_band", "SELECT document_id, CASE WHEN score >= 0.8 THEN 'Alta' WHEN score >= 0.5 THEN 'Média' ELSE 'Baixa' END AS band, CAST(document_id % 11 * 10 AS BIGINT) AS pct FROM {results}")
def f15(t):
    return t.results.select("document_id", validate.confidence_band(F.col("score")).alias("band"), validate.confidence_percent(F.col("score")).alias("pct"))


@query(
    "f16_apply_corrections",
    f"WITH {CHECKED} SELECT document_id, field_no, CASE WHEN document_id % 11 = 0 AND field_no = 1 AND template_id = 1 THEN true ELSE valid END AS valid, CASE WHEN document_id % 11 = 0 AND field_no = 1 AND template_id = 1 THEN '12.30' ELSE normalized END AS normalized, document_id % 11 = 0 AND field_no = 1 AND template_id = 1 AS manually_corrected FROM x",
)
def f16(t):
    new = t.order_raw.where("document_id % 11 = 0 and template_id = 1").select("document_id", F.lit("Valor Total").alias("name"), F.lit("R$ 12,30").alias("value"))
    return fields.apply_corrections(fields.validated(mapped(t), PATTERNS), new, PATTERNS).select("document_id", "field_no", "valid", "normalized", "manually_corrected")


@query("f17_approvable", f"WITH {FILLED} SELECT a.document_id FROM a JOIN {{docs}} d ON a.document_id = d.document_id WHERE d.state = 'em_revisao' AND NOT invalid_required")
def f17(t):
    docs = t.docs.join(t.order_values.select("document_id", "template_id"), "document_id")
    return fields.approvable(docs, fields.validated(mapped(t), PATTERNS))


@query(
    "w2_classify",
    f"""WITH {HITS} SELECT lang, decision, template_id, count(*) AS documents, CAST(sum(CASE WHEN decision = 'matched' THEN document_id % 7 ELSE 0 END) AS BIGINT) AS checksum FROM d GROUP BY 1, 2, 3""",
)
def w2(t):
    """Workload 2 over texts: normalise once, match all templates, decide; counts per language, decision and template."""
    weight = F.when(F.col("decision") == "matched", F.col("document_id") % 7).otherwise(0)
    return decided(t).groupBy("lang", "decision", "template_id").agg(F.count("*").alias("documents"), F.sum(weight).alias("checksum"))


@query(
    "w2_validate",
    f"WITH {FILLED} SELECT template_id, CASE WHEN invalid_required OR score < 0.8 THEN 'em_revisao' ELSE 'processando' END AS state, count(*) AS documents, CAST(round(sum(score * 6)) AS BIGINT) AS sixths FROM a GROUP BY 1, 2",
)
def w2_validate(t):
    """Workload 2 over fields: pairs, typed validation, score and route; counts per template and state."""
    state = classify.route(F.col("template_id"), F.col("score"), F.col("invalid_required"))["state"]
    return filled(t).withColumn("state", state).groupBy("template_id", "state").agg(F.count("*").alias("documents"), F.round(F.sum(F.col("score") * 6)).cast("long").alias("sixths"))
