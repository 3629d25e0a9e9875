"""Inputs of the queries, derived from the given tables in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

#: name -> SELECT over {table} and {input} names.
INPUTS = {
    "files": """SELECT doc_id AS arrival, '/in/' || lang || '/' || source || '/doc_' || CAST(doc_id AS STRING) ||
        CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' WHEN 2 THEN '.jpg' WHEN 3 THEN '.png' ELSE '.txt' END AS path,
        text AS content, n_chars AS size FROM {documents}""",
    "folder_paths": "SELECT DISTINCT '/in/' || lang AS path FROM {documents} UNION SELECT '/in/e' AS path UNION SELECT '/in' AS path",
    "folders": "SELECT CAST(1000 - length(path) * 10 + ascii(substr(path, length(path), 1)) % 10 AS BIGINT) AS folder_id, path, length(path) <> 5 AS active FROM {folder_paths}",
    "page_texts": "SELECT conv_id AS document_id, turn + 1 AS page_number, text FROM {conversations}",
    "observations": """SELECT CAST(user_id AS STRING) AS path, ts, CAST(floor(value / 5) AS BIGINT) AS size,
        CAST(floor(value / 20) AS BIGINT) AS mtime FROM {events}""",
    "texts": "SELECT doc_id AS document_id, text AS full_text, lang FROM {documents}",
    "order_values": """SELECT o_orderkey AS document_id, o_custkey,
        CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS template_id,
        CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CAST(CAST(o_orderdate AS DATE) AS STRING) AS iso FROM {orders}""",
    "order_raw": """SELECT document_id, template_id, o_custkey,
        CASE WHEN document_id % 7 = 0 THEN NULL WHEN document_id % 3 = 0 THEN '00' || CAST(document_id AS STRING)
             WHEN document_id % 13 = 0 THEN 'n' || CAST(document_id AS STRING) ELSE CAST(document_id AS STRING) END AS numero,
        CASE WHEN document_id % 11 = 0 THEN 'sem valor' ELSE 'R$ ' ||
             CASE WHEN cents >= 100000 THEN CAST(CAST((cents - cents % 100000) / 100000 AS BIGINT) AS STRING) || '.' ||
                       lpad(CAST(CAST((cents % 100000 - cents % 100) / 100 AS BIGINT) AS STRING), 3, '0')
                  ELSE CAST(CAST((cents - cents % 100) / 100 AS BIGINT) AS STRING) END ||
             ',' || lpad(CAST(cents % 100 AS STRING), 2, '0') END AS valor,
        CASE WHEN document_id % 5 = 0 THEN iso WHEN document_id % 17 = 0 THEN '31/02/' || substr(iso, 1, 4)
             ELSE substr(iso, 9, 2) || '/' || substr(iso, 6, 2) || '/' || substr(iso, 1, 4) END AS emissao,
        lpad(CAST((document_id * 7919) % 1000000000000 AS STRING), 12, '0') || lpad(CAST(o_custkey % 100 AS STRING), 2, '0') AS cnpj,
        CASE document_id % 4 WHEN 0 THEN 'Sim' WHEN 1 THEN ' não ' WHEN 2 THEN 'talvez' ELSE NULL END AS urgente,
        cents, iso FROM {order_values}""",
    "order_json": """SELECT document_id, template_id, CASE WHEN document_id % 29 = 0 THEN '{{broken' ELSE
        '[{{"key":"Número_Pedido","value":"ignored"}}' || CASE WHEN numero IS NULL THEN ',{{"value":"no key"}}' ELSE ',{{"key":"numero  PEDIDO","value":"' || numero || '"}}' END ||
        ',{{"key":"VALOR total","value":"' || valor || '","confidence":0.5}},{{"key":"Data  Emissão","value":"' || emissao || '"}},{{"key":"CNPJ","value":"' || cnpj || '"}}' ||
        CASE WHEN urgente IS NULL THEN '' ELSE ',{{"key":"Urgente","value":"' || urgente || '"}}' END || ']' END AS fields_json FROM {order_raw}""",
    "docs": """SELECT o_orderkey AS document_id, o_custkey AS origin_id, 'h' || CAST(o_orderkey AS STRING) AS content_hash,
        'h' || CAST(o_custkey AS STRING) AS origin_hash, 'doc_' || CAST(o_orderkey AS STRING) || '.pdf' AS filename,
        CASE o_orderkey % 6 WHEN 0 THEN 'recebido' WHEN 1 THEN 'processando' WHEN 2 THEN 'em_revisao' WHEN 3 THEN 'concluido' WHEN 4 THEN 'quarentena' ELSE 'falha' END AS state,
        CASE (o_orderkey + o_custkey) % 4 WHEN 0 THEN 'aguardando_extracao' WHEN 1 THEN 'extraido' WHEN 2 THEN 'classificado' ELSE 'aplicado' END AS step
        FROM {orders}""",
    "originals": """SELECT c_custkey AS origin_id, 'h' || CAST(c_custkey AS STRING) AS hash, 'file ' || CAST(c_custkey AS STRING) || CASE c_custkey % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.jpg' ELSE '' END AS filename,
        CAST(c_nationkey AS BIGINT) AS folder_id, c_custkey * 37 % 5000 AS size, c_custkey % 4 AS duplicate_hits FROM {customer}""",
    "nation_folders": "SELECT CAST(n_nationkey AS BIGINT) AS folder_id, '/in/' || n_name AS path FROM {nation} WHERE n_nationkey % 7 <> 6",
    "results": """SELECT o_orderkey AS document_id, CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE o_custkey % 6 END AS template_id, 1.0e0 AS confidence,
        CAST(o_orderkey % 11 AS DOUBLE) / 10 AS score FROM {orders} WHERE o_orderkey % 5 <> 0""",
    "extractions": "SELECT o_orderkey AS document_id FROM {orders} WHERE o_custkey % 3 = 0",
    "filled": """SELECT o_orderkey AS document_id, 0 AS field_no, 'numero' AS name, CAST(o_orderkey AS STRING) AS raw, CAST(o_orderkey AS STRING) AS normalized, o_orderkey % 4 <> 0 AS valid, true AS required FROM {orders}
        UNION ALL SELECT o_orderkey, 1, 'cliente', CAST(o_custkey AS STRING), CASE WHEN o_custkey % 9 = 0 THEN ' ' ELSE 'C' || CAST(o_custkey AS STRING) END, o_custkey % 5 <> 0, o_custkey % 2 = 0 FROM {orders}""",
    "audit": """SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS audit_id, l_orderkey AS document_id, CASE l_linestatus WHEN 'O' THEN 'copy' ELSE 'apply' END AS action,
        CASE l_returnflag WHEN 'A' THEN 'done' WHEN 'N' THEN 'intent' ELSE 'undone' END AS status,
        CASE WHEN l_linenumber = 7 THEN 'split_to_files: 2' WHEN l_linenumber = 6 THEN NULL ELSE 'ok' END AS details,
        CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE '/in/s' || CAST(l_suppkey AS STRING) || '.pdf' END AS source_path,
        '/out/d' || CAST(l_partkey % 500 AS STRING) || '.pdf' AS dest_path, 'run' || CAST(l_partkey % 12 AS STRING) AS run_id,
        CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE 'h' || CAST(l_orderkey % 97 AS STRING) END AS content_hash, l_shipdate AS created_at FROM {lineitem}""",
    "jobs": """SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS job_id, 'h' || CAST(l_orderkey AS STRING) AS hash,
        CASE l_linenumber % 3 WHEN 0 THEN 'ingest' WHEN 1 THEN 'extract' ELSE 'classify' END AS step, CAST(l_linenumber AS BIGINT) AS attempts, 5 AS max_attempts,
        CASE WHEN l_linenumber = 2 AND l_suppkey % 3 = 0 THEN 'failed' ELSE 'done' END AS status,
        CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 'err ' || CAST(l_suppkey AS STRING) END AS last_error, l_shipdate AS updated_at FROM {lineitem}""",
    "manifest": """SELECT '/out/d' || CAST(o_orderkey % 400 AS STRING) || CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '_1' ELSE '_3' END || '.pdf' AS path,
        'h' || CAST(max(o_custkey) % 97 AS STRING) AS hash FROM {orders} WHERE o_orderkey % 2 = 0 GROUP BY 1""",
    "state_log": """SELECT user_id AS document_id, ts, event_id AS id, CASE event_type WHEN 'signup' THEN 'processando' WHEN 'view' THEN 'em_revisao' WHEN 'click' THEN 'quarentena'
        WHEN 'purchase' THEN 'concluido' ELSE 'falha' END AS to_state, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'step' || CAST(event_id % 5 AS STRING) END AS step FROM {events}""",
    "rule_values": """SELECT o_orderkey AS document_id, o_custkey, c_name AS cliente, CAST(o_orderkey AS STRING) AS numero, CAST(CAST(o_orderdate AS DATE) AS STRING) AS data,
        CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(CAST((round(o_totalprice * 100) - round(o_totalprice * 100) % 100) / 100 AS BIGINT) AS STRING) END AS valor,
        '/in/' || n_name AS source_folder, CAST(n_nationkey AS BIGINT) AS source_folder_id, o_orderkey * 31 % 3000 AS size,
        CASE o_orderkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.jpg' ELSE '.png' END AS ext,
        'Nota ' || CAST(o_orderkey AS STRING) || CASE o_orderkey % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.jpg' ELSE '.png' END AS original_filename,
        o_custkey % 6 AS template_id FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    "decisions": "SELECT doc_id AS document_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(99 AS BIGINT) ELSE doc_id % 4 END AS template_id, CAST(doc_id % 10 AS DOUBLE) / 10 AS confidence FROM {documents} WHERE doc_id % 3 <> 0",
    "usage": "SELECT user_id AS document_id, CASE WHEN event_type = 'view' THEN 'extract' ELSE 'classify' END AS step, CAST(floor(value) AS BIGINT) AS prompt_tokens, event_id % 50 AS completion_tokens FROM {events}",
}

_NAME = re.compile(r"(?<!\{)\{([a-z_]+)\}(?!\})")


def needs(name: str) -> list[str]:
    return list(dict.fromkeys(_NAME.findall(INPUTS[name])))


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input or a given table as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(INPUTS[name], **{n: frame(spark, sf_dir, n) for n in needs(name)})


def with_inputs(sql: str) -> str:
    """DuckDB SQL: every {input} of sql, and what it needs, becomes a common table expression before it."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in TABLES or name in done:
            return
        for n in needs(name):
            add(n)
        done[name] = _NAME.sub(r"\1", INPUTS[name]).replace("{{", "{").replace("}}", "}")

    for name in dict.fromkeys(_NAME.findall(sql)):
        add(name)
    body = _NAME.sub(r"\1", sql).strip().replace("{{", "{").replace("}}", "}")
    ctes = [f"{n} AS ({text})" for n, text in done.items()]
    if body.startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join([*ctes, body[15:]])
    if body.startswith("WITH "):
        return "WITH " + ", ".join([*ctes, body[5:]]) if ctes else body
    return (f"WITH {', '.join(ctes)} " if ctes else "") + body
