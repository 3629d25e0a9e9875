"""Queries of states, work lists and reports: L and Q."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle, reports
from .registry import query

EDGES = "CASE f WHEN 'recebido' THEN t IN ('processando', 'quarentena', 'falha') WHEN 'processando' THEN t IN ('em_revisao', 'concluido', 'quarentena', 'falha') WHEN 'em_revisao' THEN t IN ('processando', 'concluido', 'quarentena', 'falha') ELSE t = 'processando' END"


@query("l1_valid_transition", f"WITH c AS (SELECT a.document_id, a.state AS f, b.state AS t FROM {{docs}} a JOIN {{docs}} b ON a.origin_id % 997 = b.document_id) SELECT document_id, {EDGES} AS valid FROM c")
def l1(t):
    a, b = t.docs.select("document_id", (F.col("origin_id") % 997).alias("k"), F.col("state").alias("from_state")), t.docs.select(F.col("document_id").alias("k"), F.col("state").alias("to_state"))
    return lifecycle.valid_transition(a.join(b, "k")).select("document_id", "valid")


REPLAYED = f"""WITH RECURSIVE s AS (SELECT document_id, to_state, step, row_number() OVER (PARTITION BY document_id ORDER BY ts, id) AS n FROM {{state_log}}),
       r AS (SELECT DISTINCT document_id, CAST(0 AS BIGINT) AS n, 'recebido' AS f, CAST(NULL AS VARCHAR) AS step, CAST(0 AS BIGINT) AS rejected FROM s
         UNION ALL SELECT r.document_id, s.n, CASE WHEN ok THEN s.to_state ELSE r.f END, CASE WHEN ok THEN coalesce(s.step, r.step) ELSE r.step END, r.rejected + CASE WHEN ok THEN 0 ELSE 1 END
         FROM r JOIN s ON s.document_id = r.document_id AND s.n = r.n + 1, LATERAL (SELECT {EDGES.replace("CASE f", "CASE r.f").replace(" t ", " s.to_state ")} AS ok) e)
       SELECT document_id, f AS state, step, rejected FROM r QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n DESC) = 1"""


@query("l2_replay_states", REPLAYED)
def l2(t):
    return lifecycle.replay_states(t.state_log)


@query("l3_pending_extractions", "SELECT document_id FROM {docs} WHERE state = 'processando' AND step = 'aguardando_extracao' AND document_id NOT IN (SELECT document_id FROM {extractions})")
def l3(t):
    return lifecycle.pending_extractions(t.docs, t.extractions).select("document_id")


@query("l4_pending_classifications", "SELECT document_id FROM {docs} WHERE state = 'processando' AND step = 'extraido' AND document_id NOT IN (SELECT document_id FROM {results})")
def l4(t):
    return lifecycle.pending_classifications(t.docs, t.results).select("document_id")


@query(
    "l5_pending_applications",
    """SELECT d.document_id FROM {docs} d JOIN {results} r ON d.document_id = r.document_id WHERE state = 'processando' AND step = 'classificado' AND score >= 0.8
       AND d.document_id NOT IN (SELECT document_id FROM {audit} WHERE status = 'done' AND (details IS NULL OR NOT starts_with(details, 'split_to_files:')))""",
)
def l5(t):
    return lifecycle.pending_applications(t.docs, t.results, t.audit).select("document_id")


@query(
    "l9_dead_letters",
    """WITH x AS (SELECT hash, step FROM {jobs} WHERE status = 'failed' OR attempts >= max_attempts)
       SELECT document_id FROM {docs} WHERE state IN ('recebido', 'processando', 'em_revisao') AND (origin_hash IN (SELECT hash FROM x WHERE step = 'ingest') OR content_hash IN (SELECT hash FROM x WHERE step <> 'ingest'))""",
)
def l9(t):
    return lifecycle.dead_letters(t.jobs, t.docs)


@query("l10_retry_step", "SELECT document_id, CASE WHEN step = 'extraido' THEN 'classify' ELSE 'extract' END AS next_step FROM {docs} WHERE state = 'falha'")
def l10(t):
    return lifecycle.retry_step(t.docs)


@query("l11_reprocess_batch", "SELECT document_id, 'processando' AS state, 'classify' AS next_step FROM {docs} WHERE state IN ('quarentena', 'em_revisao') AND document_id IN (SELECT document_id FROM {extractions})")
def l11(t):
    again, _ = lifecycle.reprocess_batch(t.docs, t.results, ids=t.extractions)
    return again.select("document_id", "state", "next_step")


@query("l11_remaining_results", "SELECT document_id FROM {results} WHERE document_id NOT IN (SELECT document_id FROM {docs} WHERE state = 'quarentena')")
def l11_results(t):
    return lifecycle.reprocess_batch(t.docs, t.results, bucket="quarentena")[1].select("document_id")


@query("l12_reclassify", "SELECT d.document_id, 'processando' AS state, template_id AS forced_template FROM {docs} d JOIN {results} r ON d.document_id = r.document_id WHERE state = 'quarentena' AND template_id IN (1, 2, 3)")
def l12(t):
    known = t.spark.createDataFrame([(1,), (2,), (3,)], "template_id long")
    return lifecycle.reclassify(t.docs, t.results, known)


@query(
    "l13_delete_documents",
    """WITH gone AS (SELECT * FROM {docs} WHERE origin_id % 10 < 3 AND (origin_id % 10 < 2 OR document_id % 2 = 0)), rest AS (SELECT * FROM {docs} WHERE document_id NOT IN (SELECT document_id FROM gone)),
       lost AS (SELECT * FROM {originals} WHERE origin_id IN (SELECT origin_id FROM gone) AND origin_id NOT IN (SELECT origin_id FROM rest)),
       h AS (SELECT content_hash AS hash FROM gone UNION SELECT hash FROM lost)
       SELECT 'documents' AS name, CAST(document_id AS VARCHAR) AS key FROM rest UNION ALL SELECT 'originals', CAST(origin_id AS VARCHAR) FROM {originals} WHERE origin_id NOT IN (SELECT origin_id FROM lost)
       UNION ALL SELECT 'jobs', CAST(job_id AS VARCHAR) FROM {jobs} WHERE hash NOT IN (SELECT hash FROM h) UNION ALL SELECT 'results', CAST(document_id AS VARCHAR) FROM {results} WHERE document_id NOT IN (SELECT document_id FROM gone)
       UNION ALL SELECT 'filled', CAST(document_id AS VARCHAR) || '/' || CAST(field_no AS VARCHAR) FROM {filled} WHERE document_id NOT IN (SELECT document_id FROM gone)""",
)
def l13(t):
    ids = t.docs.where("origin_id % 10 < 3 and (origin_id % 10 < 2 or document_id % 2 = 0)").select("document_id").union(t.spark.createDataFrame([(-5,)], "document_id long"))
    left = lifecycle.delete_documents(ids, t.docs, t.originals, t.jobs, {"results": t.results, "filled": t.filled})
    keys = {"documents": ["document_id"], "originals": ["origin_id"], "jobs": ["job_id"], "results": ["document_id"], "filled": ["document_id", "field_no"]}
    rows = [df.select(F.lit(name).alias("name"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys[name]]).alias("key")) for name, df in left.items()]
    out = rows[0]
    for c in rows[1:]:
        out = out.unionByName(c)
    return out


@query("q1_list_documents", "SELECT d.document_id, d.state, o.filename AS original_filename, f.path AS folder FROM (SELECT * FROM {docs} ORDER BY document_id DESC LIMIT 100 OFFSET 200) d LEFT JOIN {originals} o ON d.origin_id = o.origin_id LEFT JOIN {nation_folders} f ON o.folder_id = f.folder_id")
def q1(t):
    return reports.list_documents(t.docs, t.originals, t.nation_folders, 100, 200).select("document_id", "state", "original_filename", "folder")


@query("q1_next_page", "SELECT d.document_id, d.state, o.filename AS original_filename, f.path AS folder FROM (SELECT * FROM {docs} WHERE document_id < 700 ORDER BY document_id DESC LIMIT 100) d LEFT JOIN {originals} o ON d.origin_id = o.origin_id LEFT JOIN {nation_folders} f ON o.folder_id = f.folder_id")
def q1_next(t):
    return reports.list_documents(t.docs, t.originals, t.nation_folders, 100, before=700).select("document_id", "state", "original_filename", "folder")


@query(
    "q2_state_counts",
    """WITH s AS (SELECT unnest(['recebido', 'processando', 'em_revisao', 'concluido', 'quarentena', 'falha']) AS state), c AS (SELECT s.state, count(d.document_id) AS n FROM s LEFT JOIN {docs} d ON s.state = d.state GROUP BY 1)
       SELECT * FROM c UNION ALL SELECT 'total', CAST(sum(n) AS BIGINT) FROM c""",
)
def q2(t):
    return reports.state_counts(t.docs)


@query(
    "q3_attention",
    f"""WITH j AS (SELECT hash, last_error FROM {{jobs}} QUALIFY row_number() OVER (PARTITION BY hash ORDER BY updated_at DESC, job_id DESC) = 1), f AS (SELECT document_id, string_agg(name, ',' ORDER BY field_no) AS names FROM {{filled}} GROUP BY 1)
       SELECT d.document_id, d.state AS bucket, CASE d.state WHEN 'falha' THEN coalesce(nullif(j.last_error, ''), '{reports.NO_ERROR_TEXT}') WHEN 'quarentena' THEN '{reports.QUARANTINE_TEXT}' END AS reason,
       CASE WHEN d.state = 'em_revisao' THEN r.score END AS score, CASE WHEN d.state = 'em_revisao' THEN f.names END AS names
       FROM {{docs}} d LEFT JOIN j ON d.content_hash = j.hash LEFT JOIN {{results}} r ON d.document_id = r.document_id LEFT JOIN f ON d.document_id = f.document_id WHERE d.state IN ('falha', 'quarentena', 'em_revisao')""",
)
def q3(t):
    out = reports.attention(t.docs, t.jobs, t.results, t.filled)
    return out.select("document_id", "bucket", "reason", "score", F.array_join("fields.name", ",").alias("names"))


@query("q4_search_documents", "SELECT d.document_id FROM {docs} d LEFT JOIN {originals} o ON d.origin_id = o.origin_id LEFT JOIN {nation_folders} f ON o.folder_id = f.folder_id WHERE state = 'em_revisao' AND contains(lower(d.filename || coalesce(f.path, '')), 'nation_1')")
def q4(t):
    docs = t.docs.join(t.originals.select("origin_id", "folder_id"), "origin_id", "left").join(t.nation_folders.select("folder_id", F.col("path").alias("folder")), "folder_id", "left")
    return reports.search_documents(docs, "em_revisao", " Nation_1 ").select("document_id")


@query(
    "q5_document_detail",
    """WITH f AS (SELECT document_id, string_agg(raw, ',' ORDER BY field_no) AS raws FROM {filled} GROUP BY 1)
       SELECT d.document_id, r.document_id IS NOT NULL AS classified, CASE WHEN r.template_id IN (1, 2) THEN 'T' || r.template_id END AS template_name, r.score, CASE WHEN r.score IS NULL THEN NULL WHEN r.score >= 0.8 THEN 'Alta' WHEN r.score >= 0.5 THEN 'Média' ELSE 'Baixa' END AS band, CASE WHEN r.document_id IS NOT NULL THEN f.raws END AS raws
       FROM {docs} d LEFT JOIN {results} r ON d.document_id = r.document_id LEFT JOIN f ON d.document_id = f.document_id""",
)
def q5(t):
    templates = t.spark.createDataFrame([(1, "T1"), (2, "T2")], "template_id long, name string")
    c = "classification"
    out = reports.document_detail(t.docs, t.results, templates, t.filled)
    return out.select("document_id", F.col(c).isNotNull().alias("classified"), f"{c}.template_name", f"{c}.score", f"{c}.band", F.array_join(F.col(c)["fields"]["raw"], ",").alias("raws"))


@query("q6_block_family", "SELECT o.origin_id, o.filename, count(d.document_id) AS documents, min(d.document_id) AS first_id, max(d.document_id) AS last_id FROM {originals} o LEFT JOIN {docs} d ON o.origin_id = d.origin_id GROUP BY 1, 2")
def q6(t):
    return reports.block_family(t.docs, t.originals)
