"""Queries of rules, names, plans, audit and undo: R, N, P and U."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Action, Automation, Rule, RuleCondition
from ..functions import naming
from ..operators import audit, collisions, filing, rule_tables, rules
from ..sources.files import spread
from .registry import query

C = RuleCondition


def values(t):
    v = spread(t.rule_values, t.orders, "document_id")
    entries = [F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in ("cliente", "numero", "data", "valor")]
    return v.withColumn("fields", F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull())))


@query(
    "r2_evaluate_condition",
    """SELECT document_id, cliente = 'Customer#000000007' AS eq, contains(lower(cliente), '#00000000') AS contains, coalesce(CAST(valor AS BIGINT) > 250000, false) AS gt, data < '1997-01-01' AS lt_date,
       CAST(numero AS BIGINT) < 900 AS lt, cliente > 'customer' AS gt_text, true AS empty_contains, false AS missing, false AS unknown FROM {rule_values}""",
)
def r2(t):
    e = lambda n, op, v: rules.evaluate_condition(F.try_element_at("fields", F.lit(n)), op, v)
    return values(t).select(
        "document_id", e("cliente", "eq", " CUSTOMER#000000007 ").alias("eq"), e("cliente", "contains", "#00000000").alias("contains"), e("valor", "gt", "250000.0").alias("gt"),
        e("data", "lt", "1997-01-01").alias("lt_date"), e("numero", "lt", "9e2").alias("lt"), e("cliente", "gt", "customer").alias("gt_text"), e("cliente", "contains", " ").alias("empty_contains"),
        e("nada", "eq", "").alias("missing"), e("numero", "like", "1").alias("unknown"),
    )


RULES = [
    Rule(1, 5, (C("field", "gt", "400000", "valor"), C("field", "lt", "1998-01-01", "data")), "and"),
    Rule(2, 3, (C("field", "contains", "#00000001", "cliente"), C("field", "eq", "77", "numero")), "OR"),
    Rule(3, 1, ()),
    Rule(4, 0, (C("field", "gt", "0", "numero"),), "and", False),
    Rule(5, 9, (C("field", "lt", "1500", "numero"),)),
]
R1 = "coalesce(CAST(valor AS BIGINT) > 400000, false) AND data < '1998-01-01'"
R2 = "contains(cliente, '#00000001') OR numero = '77'"


@query("r3_rule_matches", f"SELECT document_id, {R1} AS r1, {R2} AS r2, false AS r3 FROM {{rule_values}}")
def r3(t):
    return values(t).select("document_id", *[rules.rule_matches(r).alias(f"r{r.rule_id}") for r in RULES[:3]])


@query("r4_first_matching_rule", f"SELECT document_id, CASE WHEN {R2} THEN 2 WHEN {R1} THEN 1 WHEN CAST(numero AS BIGINT) < 1500 THEN 5 END AS rule_id FROM {{rule_values}}")
def r4(t):
    return values(t).select("document_id", rules.first_matching_rule(RULES).alias("rule_id"))


@query("r5_ext_matches", "SELECT document_id, ext IN ('.pdf', '.png') AS listed, false AS none FROM {rule_values}")
def r5(t):
    return values(t).select("document_id", rules.ext_matches("PDF; .png,, pdf", F.upper("ext")).alias("listed"), rules.ext_matches(" , ", F.col("ext")).alias("none"))


@query(
    "r6_evaluate_filter",
    "SELECT document_id, source_folder_id = 3 AS folder, contains(ext, 'g') AS ext_part, lower(original_filename) = 'nota 12.pdf' AS name, size > 1500 AS size_gt, size = 310 AS size_eq, template_id = 4 AS template, false AS unknown FROM {rule_values}",
)
def r6(t):
    f = lambda *a: rules.evaluate_filter(C(*a))
    return values(t).select(
        "document_id", f("source_folder", "eq", " 3 ").alias("folder"), f("extension", "contains", "G").alias("ext_part"), f("filename", "eq", "NOTA 12.pdf ").alias("name"), f("size", "gt", "1500").alias("size_gt"),
        f("size", "eq", "310.00").alias("size_eq"), f("template", "eq", "4").alias("template"), f("colour", "eq", "x").alias("unknown"),
    )


@query("r7_filter_matches", "SELECT document_id, true AS none, size > 1500 AND ext = '.jpg' AS both, size > 1500 OR ext = '.jpg' AS either FROM {rule_values}")
def r7(t):
    two = [C("size", "gt", "1500"), C("extension", "eq", ".JPG")]
    return values(t).select("document_id", rules.filter_matches([]).alias("none"), rules.filter_matches(two).alias("both"), rules.filter_matches(two, "or").alias("either"))


AUTOMATIONS = [
    Automation(1, 4, (C("extension", "eq", "pdf"), C("field", "gt", "200000", "valor")), (Action(1, "rename", {"name_pattern": "{cliente:letras=8}_{numero}"}), Action(2, "copy", {"dest_folder": "Copias/{data:aaaa-mm}"}), Action(3, "move", {"dest_folder": "/srv/NF/{cliente}"}))),
    Automation(2, 2, (C("source_folder", "contains", "nation_2"),), (Action(1, "copy", {"dest_folder": "{data:formato=aaaa}\\{numero:truncar=2}"}),)),
    Automation(3, 1, (C("size", "lt", "100"),), (Action(2, "rename", {"name_pattern": "{valor}.txt"}), Action(1, "move", {"dest_folder": "C:\\NF\\{numero}"}))),
    Automation(4, 0, ()),
    Automation(5, 3, (C("template", "eq", "5"),), (Action(1, "rename", {"name_pattern": "t{numero}"}),), False),
    Automation(6, 9, (C("filename", "contains", "nota 1"),), (Action(1, "noop"),)),
]
A = """CASE WHEN size < 100 THEN 3 WHEN contains(lower(source_folder), 'nation_2') THEN 2 WHEN ext = '.pdf' AND coalesce(CAST(valor AS BIGINT) > 200000, false) THEN 1 WHEN contains(lower(original_filename), 'nota 1') THEN 6 END"""


@query("r8_conditions", "SELECT document_id, ext = '.pdf' AND coalesce(CAST(valor AS BIGINT) > 200000, false) AS a1, contains(lower(source_folder), 'nation_2') AS a2, false AS a4 FROM {rule_values}")
def r8(t):
    return values(t).select("document_id", *[rules.automation_matches(a).alias(f"a{a.automation_id}") for a in AUTOMATIONS if a.automation_id in (1, 2, 4)])


@query("r9_evaluate_automations", f"SELECT document_id, CAST({A} AS BIGINT) AS automation_id FROM {{rule_values}}")
def r9(t):
    return rules.evaluate_automations(values(t), AUTOMATIONS).select("document_id", "automation_id")


def own_rules(t):
    """One automation for each customer, with two or three conditions, and one for each nation."""
    c = t.customer.select(F.col("c_custkey").alias("automation_id"), (F.col("c_custkey") * 7919 % 1009).alias("position"), (F.col("c_custkey") % 11 != 0).alias("active"), F.col("c_name"))
    n = t.nation.select((F.col("n_nationkey") + 1_000_000).cast("long").alias("automation_id"), (F.col("n_nationkey") * 100).cast("long").alias("position"), F.lit(True).alias("active"), "n_name")
    k = F.col("automation_id")

    def condition(rows, field, operator, value, name=None):
        return rows.select("automation_id", F.lit(field).alias("field"), F.lit(operator).alias("operator"), value.alias("value"), F.lit(name).cast("string").alias("field_name"))

    conditions = condition(c, "field", "eq", F.upper("c_name"), "cliente")
    conditions = conditions.union(condition(c.where("automation_id % 3 = 0"), "field", "gt", F.concat((k % 50 * 5000).cast("string"), F.lit(".0")), "valor"))
    conditions = conditions.union(condition(c.where("automation_id % 3 = 1"), "extension", "eq", F.when(k % 2 == 0, F.lit("PDF; .jpg")).otherwise(F.lit("png"))))
    conditions = conditions.union(condition(n, "source_folder", "contains", F.lower("n_name"))).union(condition(n, "size", "lt", F.lit("700"))).union(condition(n.where("automation_id % 2 = 0"), "filename", "contains", F.lit("7")))
    return c.drop("c_name").union(n.drop("n_name")), conditions


@query(
    "r9_rules_as_tables",
    """WITH a AS (SELECT v.document_id, c_custkey AS automation_id, c_custkey * 7919 % 1009 AS position FROM {rule_values} v JOIN {customer} c ON v.cliente = c.c_name WHERE c_custkey % 11 <> 0
         AND CASE c_custkey % 3 WHEN 0 THEN coalesce(CAST(valor AS BIGINT) > c_custkey % 50 * 5000, false) WHEN 1 THEN CASE WHEN c_custkey % 2 = 0 THEN ext IN ('.pdf', '.jpg') ELSE ext = '.png' END ELSE true END
       UNION ALL SELECT v.document_id, n_nationkey + 1000000, n_nationkey * 100 FROM {rule_values} v JOIN {nation} n ON contains(lower(v.source_folder), lower(n.n_name)) WHERE size < 700 AND (n_nationkey % 2 = 1 OR contains(original_filename, '7')))
       SELECT v.document_id, CAST(arg_min(a.automation_id, a.position * 10000000 + a.automation_id) AS BIGINT) AS automation_id FROM {rule_values} v LEFT JOIN a ON v.document_id = a.document_id GROUP BY v.document_id""",
)
def r9_tables(t):
    """As many automations as there are customers and nations, held in tables."""
    return rule_tables.evaluate_automations(values(t), *own_rules(t)).select("document_id", "automation_id")


@query(
    "r10_fields_map",
    """WITH g AS (SELECT document_id, name, normalized FROM {filled} WHERE valid AND trim(normalized) <> '') SELECT document_id, string_agg(name || '=' || normalized, ';' ORDER BY name) AS fields FROM g GROUP BY 1""",
)
def r10(t):
    pairs = F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return rules.fields_map(t.filled).select("document_id", F.array_join(pairs, ";").alias("fields"))


@query(
    "r11_file_attrs",
    """SELECT d.document_id, CASE WHEN contains(o.filename, '.') THEN lower(regexp_extract(o.filename, '(\\.[^.]+)$', 1)) ELSE '' END AS ext, o.size, o.folder_id AS source_folder_id, f.path AS source_folder, o.filename AS original_filename, r.template_id
       FROM {docs} d LEFT JOIN {originals} o ON d.origin_id = o.origin_id LEFT JOIN {nation_folders} f ON o.folder_id = f.folder_id LEFT JOIN {results} r ON d.document_id = r.document_id""".replace("\\\\", "\\"),
)
def r11(t):
    out = rules.file_attrs(t.docs, t.originals, t.nation_folders, t.results)
    return out.select("document_id", "ext", "size", "source_folder_id", "source_folder", "original_filename", "template_id")


@query("n1_strip_quotes", "SELECT document_id, cliente AS name FROM {rule_values}")
def n1(t):
    return t.rule_values.select("document_id", naming.strip_quotes(F.concat(F.lit("  \"' "), F.col("cliente"), F.lit("'\" "))).alias("name"))


@query(
    "n2_sanitize_component",
    """SELECT document_id, CASE document_id % 5 WHEN 0 THEN '_con.txt' WHEN 1 THEN '_' WHEN 2 THEN 'a_b_' || numero WHEN 3 THEN repeat('x', 16) || '.pdf' ELSE cliente END AS name FROM {rule_values}""",
)
def n2(t):
    k = F.col("document_id") % 5
    raw = F.when(k == 0, "con.txt").when(k == 1, " .. ").when(k == 2, F.concat(F.lit("a<b:"), F.col("numero"), F.lit(". "))).when(k == 3, F.lit("x" * 40 + ".pdf")).otherwise(F.col("cliente"))
    return t.rule_values.select("document_id", naming.sanitize_component(raw, 20).alias("name"))


@query(
    "n4_filters",
    """SELECT document_id, substr(cliente, 1, 8) AS letras, upper(cliente) AS maiusc, replace(cliente, 'Cust', 'K') AS substituir, 'Nota' AS palavras, substr(cliente, 1, length(cliente) - 4) AS negative, cliente AS unknown FROM {rule_values}""",
)
def n4(t):
    f = lambda c, *fs: naming.from_map and _piped(F.col(c), fs)
    return t.rule_values.select(
        "document_id", f("cliente", "letras=8").alias("letras"), f("cliente", "minusc", "maiusc").alias("maiusc"), f("cliente", "substituir=Cust>K").alias("substituir"),
        f("original_filename", "palavras=1", "sem_acento").alias("palavras"), f("cliente", "truncar=-4").alias("negative"), f("cliente", "nada", "letras=x").alias("unknown"),
    )


def _piped(c, filters):
    for f in filters:
        c = naming.apply_filter(c, f)
    return c


@query("n5_fmt_date", "SELECT document_id, substr(data, 9, 2) || '.' || substr(data, 6, 2) || '/' || substr(data, 1, 4) AS formatted, CAST(NULL AS VARCHAR) AS not_a_date FROM {rule_values}")
def n5(t):
    return t.rule_values.select("document_id", naming.fmt_date(F.col("data"), "dd.mm/aaaa").alias("formatted"), naming.fmt_date(F.col("cliente"), "aaaa").alias("not_a_date"))


@query("n6_substitute", "SELECT document_id, 'NF ' || numero || '-' || substr(data, 1, 7) AS plain, 'v' || valor AS poisoned, coalesce(valor, 'sem valor') || '{{x:}}' AS defaulted FROM {rule_values}")
def n6(t):
    look = naming.from_map(F.col("fields"))
    return values(t).select("document_id", naming.substitute("NF {numero}-{data:aaaa-mm}", look).alias("plain"), naming.substitute("v{valor}", look).alias("poisoned"), naming.substitute("{valor:padrao=sem valor}{x:}", look).alias("defaulted"))


@query("n7_resolve_pattern", "SELECT document_id, 'a_b ' || valor || ' ' || cliente || '.pdf' AS name FROM {rule_values}")
def n7(t):
    return values(t).select("document_id", naming.resolve_pattern('"a/b {valor} {cliente}.pdf. "', naming.from_map(F.col("fields"))).alias("name"))


@query(
    "n8_resolve_dest_folder",
    r"""SELECT document_id, 'C:\NF\' || cliente || '\' || substr(data, 1, 4) AS windows, '/srv/' || valor AS posix, '/base/x/_/' || numero AS relative, '\\srv\share\' || cliente AS unc FROM {rule_values}""",
)
def n8(t):
    look = naming.from_map(F.col("fields"))
    r = lambda p: naming.resolve_dest_folder(p, look, "/base")
    return values(t).select("document_id", r("C:\\NF\\{cliente}\\{data:aaaa}").alias("windows"), r("/srv/{valor}").alias("posix"), r("x/./..\\{numero}/").alias("relative"), r("\\\\srv\\share\\{cliente}").alias("unc"))


def planned(t):
    docs = rules.evaluate_automations(values(t), AUTOMATIONS)
    docs = docs.withColumns({"default_folder": F.col("source_folder"), "default_name": F.col("original_filename"), "source": F.concat_ws("/", "source_folder", "original_filename"), "content_hash": F.concat(F.lit("h"), (F.col("o_custkey") % 97).cast("string"))})
    return filing.apply_actions(docs, AUTOMATIONS, "/base")


P = f"""p AS (SELECT *, {A} AS a, 'h' || CAST(o_custkey % 97 AS VARCHAR) AS hash, source_folder || '/' || original_filename AS source, regexp_extract(original_filename, '(\\.[^.]+)$', 1) AS sx FROM {{rule_values}}),
  o AS (SELECT document_id, a, hash, source, 0 AS position, 'copy' AS kind, '/base/Copias/' || substr(data, 1, 7) || '/Customer_' || numero || sx AS dest FROM p WHERE a = 1
    UNION ALL SELECT document_id, a, hash, source, 1, 'move', '/srv/NF/' || cliente || '/Customer_' || numero || sx FROM p WHERE a = 1
    UNION ALL SELECT document_id, a, hash, source, 0, 'copy', '/base/' || substr(data, 1, 4) || '/' || substr(numero, 1, 2) || '/' || original_filename FROM p WHERE a = 2
    UNION ALL SELECT document_id, a, hash, source, 0, 'move', 'C:\\NF\\' || numero || '\\' || valor || '.txt' FROM p WHERE a = 3 AND valor IS NOT NULL
    UNION ALL SELECT document_id, a, hash, source, 0, 'move', source FROM p WHERE a = 6)""".replace("Customer_", "' || substr(cliente, 1, 8) || '_")


@query("p1_apply_actions", f"WITH {P} SELECT p.document_id, coalesce(p.a = 3 AND valor IS NULL, false) AS blocked, coalesce(p.a IN (1, 3) AND NOT (p.a = 3 AND valor IS NULL AND false), false) AS has_move, count(o.document_id) AS outputs FROM p LEFT JOIN o ON p.document_id = o.document_id GROUP BY ALL")
def p1(t):
    return planned(t).select("document_id", "blocked", "has_move", F.size("outputs").cast("long").alias("outputs"))


@query("p2_plan_dest", f"WITH {P} SELECT document_id, position, kind, dest FROM o")
def p2(t):
    return filing.planned_outputs(planned(t)).select("document_id", "position", "kind", "dest")


@query(
    "p3_source_path",
    """WITH o AS (SELECT origin_id, hash, coalesce(f.path || '/', '') || filename AS place FROM {originals} o LEFT JOIN {nation_folders} f ON o.folder_id = f.folder_id)
       SELECT d.document_id, coalesce(h.place, i.place, d.filename) AS source FROM {docs} d LEFT JOIN o h ON d.content_hash = h.hash LEFT JOIN o i ON d.origin_id = i.origin_id""",
)
def p3(t):
    return filing.source_path(t.docs, t.originals, t.nation_folders).select("document_id", "source")


PLANS = "plans AS (SELECT o_orderkey AS document_id, 0 AS position, '/out/d' || CAST(o_orderkey % 450 AS VARCHAR) || '.pdf' AS dest, 'h' || CAST(o_custkey % 97 AS VARCHAR) AS hash FROM {orders})"
TAKEN = r"""mm AS (SELECT path AS dest, 0 AS i, hash FROM {manifest} UNION ALL SELECT regexp_replace(path, '_\d+\.pdf$', '.pdf'), CAST(regexp_extract(path, '_(\d+)\.pdf$', 1) AS INT), hash FROM {manifest} WHERE regexp_matches(path, '_\d+\.pdf$')),
  k AS (SELECT dest, list(i) AS used, map(list(i), list(hash)) AS taken FROM mm GROUP BY dest)"""


def plans(t):
    o = t.orders
    return o.select(F.col("o_orderkey").alias("document_id"), F.lit(0).alias("position"), F.concat(F.lit("/out/d"), (F.col("o_orderkey") % 450).cast("string"), F.lit(".pdf")).alias("dest"), F.concat(F.lit("h"), (F.col("o_custkey") % 97).cast("string")).alias("hash"))


FREE = "list_min(list_filter(range(0, len(coalesce(used, [])) + 1), lambda x: NOT list_contains(coalesce(used, []), x)))"


@query(
    "p4_resolve_collision",
    f"""WITH {PLANS}, {TAKEN}, f AS (SELECT plans.*, taken, {FREE} AS free FROM plans LEFT JOIN k ON plans.dest = k.dest),
       s AS (SELECT *, len(list_filter(range(0, free), lambda x: taken[CAST(x AS INT)] = hash)) > 0 AS same FROM f)
       SELECT document_id, CASE WHEN same THEN NULL WHEN free = 0 THEN dest ELSE replace(dest, '.pdf', '_' || free || '.pdf') END AS final FROM s""",
)
def p4(t):
    return collisions.resolve_collision(plans(t), t.manifest).select("document_id", "final")


def numbered_plans(t):
    """Names that end in numbers themselves, some of which are what others are pushed to."""
    k, o = F.col("o_orderkey"), t.orders
    tail = F.when(k % 7 == 3, "_1.pdf").when(k % 11 == 5, "_2.pdf").otherwise(".pdf")
    return o.select(k.alias("document_id"), F.lit(0).alias("position"), F.concat(F.lit("/out/d_"), (k % 450).cast("string"), tail).alias("dest"), F.concat(F.lit("h"), (F.col("o_custkey") % 97).cast("string")).alias("hash"))


@query(
    "p5_resolve_batch",
    r"""WITH RECURSIVE plans AS (SELECT o_orderkey AS document_id, o_orderkey % 450 AS fam, '/out/d_' || CAST(o_orderkey % 450 AS VARCHAR) || CASE WHEN o_orderkey % 7 = 3 THEN '_1' WHEN o_orderkey % 11 = 5 THEN '_2' ELSE '' END AS stem, 'h' || CAST(o_custkey % 97 AS VARCHAR) AS hash FROM {orders}),
       turns AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY document_id) AS r FROM plans),
       mm AS (SELECT CAST(regexp_extract(path, '^/out/d(\d+)', 1) AS BIGINT) AS fam, replace(path, '/out/d', '/out/d_') AS path, hash FROM {manifest}),
       held AS (SELECT fam, list(path ORDER BY path) AS paths, list(hash ORDER BY path) AS hashes FROM mm GROUP BY fam),
       play AS (SELECT f.fam, CAST(0 AS BIGINT) AS r, coalesce(paths, []) AS paths, coalesce(hashes, []) AS hashes, CAST(NULL AS BIGINT) AS document_id, CAST(NULL AS VARCHAR) AS final, false AS identical FROM (SELECT DISTINCT fam FROM plans) f LEFT JOIN held ON f.fam = held.fam
         UNION ALL SELECT fam, r, CASE WHEN same THEN paths ELSE list_append(paths, ways[free]) END, CASE WHEN same THEN hashes ELSE list_append(hashes, hash) END, document_id, CASE WHEN NOT same THEN ways[free] END, same FROM
           (SELECT *, len(list_filter(ways[1:free - 1], lambda w: hashes[list_position(paths, w)] = hash)) > 0 AS same FROM
             (SELECT *, list_min(list_filter(range(1, len(ways) + 1), lambda x: NOT list_contains(paths, ways[x]))) AS free FROM
               (SELECT t.fam, t.r, t.document_id, t.hash, p.paths, p.hashes, list_transform(range(0, len(p.paths) + 1), lambda x: t.stem || CASE WHEN x = 0 THEN '' ELSE '_' || CAST(x AS VARCHAR) END || '.pdf') AS ways FROM play p JOIN turns t ON t.fam = p.fam AND t.r = p.r + 1))))
       SELECT document_id, final, identical FROM play WHERE document_id IS NOT NULL""".replace("\\\\", "\\"),
)
def p5(t):
    there = t.manifest.withColumn("path", F.replace("path", F.lit("/out/d"), F.lit("/out/d_")))
    return collisions.resolve_batch(numbered_plans(t), there).select("document_id", "final", "identical")


DRY = f"""{P}, taken AS (SELECT source AS path, hash FROM p WHERE document_id % 2 = 0),
  d AS (SELECT o.document_id, CASE WHEN EXISTS (SELECT 1 FROM taken x WHERE x.path = o.dest AND x.hash = o.hash) THEN 'skipped' ELSE 'applicable' END AS status, position, kind, dest,
    CASE WHEN NOT EXISTS (SELECT 1 FROM taken x WHERE x.path = o.dest) THEN o.dest WHEN NOT EXISTS (SELECT 1 FROM taken x WHERE x.path = o.dest AND x.hash = o.hash) THEN regexp_replace(o.dest, '(\\.[^.]+)$', '_1\\1') END AS final FROM o
    UNION ALL SELECT document_id, 'no_match', NULL, NULL, NULL, NULL FROM p WHERE a IS NULL UNION ALL SELECT document_id, 'blocked', NULL, NULL, NULL, NULL FROM p WHERE a = 3 AND valor IS NULL)"""


def there(t):
    """Half of the originals are still where they were."""
    half = t.rule_values.where("document_id % 2 = 0")
    return half.select(F.concat_ws("/", "source_folder", "original_filename").alias("path"), F.concat(F.lit("h"), (F.col("o_custkey") % 97).cast("string")).alias("hash"))


def dry(t):
    return filing.dry_run(planned(t), there(t))


@query("p6_dry_run", f"WITH {DRY} SELECT * FROM d")
def p6(t):
    return dry(t)


@query("p7_dry_run_summary", f"WITH {DRY} SELECT count(DISTINCT CASE WHEN status = 'applicable' THEN document_id END) AS ready, CAST(count_if(status = 'skipped') AS BIGINT) AS skipped, CAST(count_if(status = 'no_match') AS BIGINT) AS no_match, CAST(count_if(status = 'blocked') AS BIGINT) AS blocked FROM d")
def p7(t):
    return filing.dry_run_summary(dry(t))


@query("p8_ready_documents", "SELECT document_id FROM {docs} WHERE state = 'processando' AND step = 'classificado'")
def p8(t):
    return filing.ready_documents(t.docs).select("document_id")


@query("p9_anchor_missing", f"WITH {P} SELECT document_id, position, bool_or(dest LIKE 'C:%' OR dest LIKE '/in/%') OVER (PARTITION BY document_id) AS anchor_blocked FROM o")
def p9(t):
    roots = t.spark.createDataFrame([("/base",), ("/srv",)], "root string")
    return filing.anchor_missing(filing.planned_outputs(planned(t)), roots).select("document_id", "position", "anchor_blocked")


@query(
    "p10_audit_rows",
    f"WITH {DRY} SELECT d.document_id, CASE WHEN kind = 'copy' THEN 'copy' ELSE 'apply' END AS action, 'done' AS status, p.source AS source_path, d.dest AS dest_path, p.hash AS content_hash FROM d JOIN p ON d.document_id = p.document_id WHERE status = 'applicable' AND NOT EXISTS (SELECT 1 FROM taken x WHERE x.path = d.dest)",
)
def p10(t):
    outputs = collisions.resolve_collision(filing.planned_outputs(planned(t)), there(t))
    return filing.audit_rows(outputs, "run1").drop("run_id")


@query(
    "p11_apply_outcome",
    f"""WITH {P}, j AS (SELECT d.document_id, d.state, d.step, p.a, p.a = 3 AND p.valor IS NULL AS blocked, d.document_id IN (SELECT document_id FROM {{audit}} WHERE status = 'done') AS already FROM {{docs}} d JOIN p ON d.document_id = p.document_id)
       SELECT document_id, CASE WHEN already OR a IS NULL THEN state WHEN blocked THEN CASE WHEN state = 'processando' THEN 'em_revisao' ELSE state END WHEN state IN ('processando', 'em_revisao') THEN 'concluido' ELSE state END AS state,
       CASE WHEN NOT already AND a IS NOT NULL AND NOT blocked AND state IN ('processando', 'em_revisao') THEN 'aplicado' ELSE step END AS step FROM j""",
)
def p11(t):
    docs = planned(t).select("document_id", "automation_id", "blocked").join(t.docs, "document_id")
    return filing.apply_outcome(docs, t.audit).select("document_id", "state", "step")


@query(
    "w3_plan",
    f"WITH {DRY} SELECT status, kind, count(*) AS outputs, count(DISTINCT dest) AS destinations FROM d GROUP BY 1, 2",
)
def w3(t):
    """Workload 3: rules, names, destinations and collisions of all documents; outputs per status and kind."""
    return dry(t).groupBy("status", "kind").agg(F.count("*").alias("outputs"), F.countDistinct("dest").alias("destinations"))


@query(
    "u1_undo_plan",
    """SELECT audit_id, CASE WHEN action = 'copy' THEN 'delete_copy' WHEN source_path IS NULL THEN 'error' WHEN dest_path IN (SELECT path FROM {manifest}) THEN 'move_back' WHEN content_hash IS NOT NULL THEN 'restore' ELSE 'error' END AS operation,
       CASE WHEN action = 'copy' OR (source_path IS NOT NULL AND dest_path IN (SELECT path FROM {manifest})) THEN 'undone' WHEN source_path IS NOT NULL AND content_hash IS NOT NULL THEN 'undone_from_cas' ELSE 'done' END AS new_status
       FROM {audit} WHERE status = 'done' AND run_id = 'run5'""",
)
def u1(t):
    return audit.undo_plan(t.audit, t.manifest, run_id="run5").select("audit_id", "operation", "new_status")


@query("u2_reopen", "SELECT document_id, 'processando' AS state, 'classificado' AS step FROM {docs} WHERE state = 'concluido' AND document_id IN (SELECT document_id FROM {audit} WHERE run_id = 'run5' AND status = 'done')")
def u2(t):
    return audit.reopen(t.audit, t.docs, "run5").select("document_id", "state", "step")


@query("u3_reconcile_orphans", "SELECT audit_id, CASE WHEN EXISTS (SELECT 1 FROM {manifest} m WHERE m.path = a.dest_path AND m.hash = a.content_hash) THEN 'done' ELSE 'orphaned' END AS status FROM {audit} a WHERE status = 'intent'")
def u3(t):
    return audit.reconcile_orphans(t.audit, t.manifest).select("audit_id", "status")


@query("u4_can_undo", "SELECT document_id, count(*) AS entries, bool_or(status = 'done') AS can_undo FROM {audit} WHERE details IS NULL OR NOT starts_with(details, 'split_to_files:') GROUP BY 1")
def u4(t):
    return audit.can_undo(t.audit)


@query("u4_document_audit", "SELECT audit_id, action, status FROM {audit} WHERE document_id = 17 AND (details IS NULL OR NOT starts_with(details, 'split_to_files:'))")
def u4_document(t):
    return audit.document_audit(t.audit, 17).select("audit_id", "action", "status")
