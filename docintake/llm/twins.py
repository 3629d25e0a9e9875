"""SQL twins for DuckDB of the operators that SQL can express in full."""

from __future__ import annotations


def _words(text: str) -> str:
    plain = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({plain}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


#: Every window of every item against every run of as many document words.
WINNOWING = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words("text")} AS w FROM documents),
  b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_words("text")} AS w FROM benchmark),
  bw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM b WHERE len(w) > 0)),
  dw AS (SELECT rid, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM bw))),
  h AS (SELECT dw.rid, dw.k, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
  hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT rid, k, n FROM h)) GROUP BY rid),
  ids AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS joined FROM (SELECT DISTINCT rid, item_id FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.rid = hit.rid LEFT JOIN ids ON d.rid = ids.rid"""


#: All pairs of anchors and rows; whole numbers in doubles, exact below 2^53.
HARD_NEGATIVES = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 3"""

#: Cuts by code points from the digest of the id; substr counts code points.
FIM = """WITH h AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
  u AS (SELECT *, CAST('0x' || s[1:8] AS BIGINT) % (n + 1) AS c1, CAST('0x' || s[9:16] AS BIGINT) % (n + 1) AS c2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM h),
  f AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
  p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""


def hilbert_steps(dims: int, bits: int, source: str) -> tuple[list[str], str]:
    """(common table expressions, index expression): the curve index from the columns x0, x1, ... of `source`, step by step."""
    names, steps, at = [f"x{i}" for i in range(dims)], [], source

    def step(**new: str) -> None:
        nonlocal at
        kept = ", ".join(f"{new.get(n, n)} AS {n}" for n in [*names, "t"])
        steps.append(f"s{len(steps)} AS (SELECT * EXCLUDE ({', '.join([*names, 't'])}), {kept} FROM {at})")
        at = f"s{len(steps) - 1}"

    for b in range(bits - 1, 0, -1):
        q = 1 << b
        for i in range(dims):
            swap = f"(CASE WHEN x{i} & {q} <> 0 THEN 0 ELSE xor(x0, x{i}) & {q - 1} END)"
            first = f"xor(x0, CASE WHEN x{i} & {q} <> 0 THEN {q - 1} ELSE {swap} END)"
            step(**({"x0": first} | ({f"x{i}": f"xor(x{i}, {swap})"} if i else {})))
    for i in range(1, dims):
        step(**{f"x{i}": f"xor(x{i}, x{i - 1})"})
    turn = "0"
    for b in range(bits - 1, 0, -1):
        turn = f"xor({turn}, CASE WHEN x{dims - 1} & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    step(t=turn)
    step(**{n: f"xor({n}, t)" for n in names})
    terms = [f"((x{i} >> {b}) & 1) * {1 << (b * dims + dims - 1 - i)}" for b in range(bits) for i in range(dims)]
    return steps, " + ".join(terms)


def hilbert_shards(dims: list[str], shards: int, bits: int) -> str:
    """Bins from the counts of all values, curve index, runs of ranks; CRC-32, which DuckDB lacks, byte by byte from its table."""
    byte = "(instr('0123456789ABCDEF', p[1]) - 1) * 16 + instr('0123456789ABCDEF', p[2]) - 1"
    bins = [
        f"""c{i} AS (SELECT v, sum(n) OVER (ORDER BY v) AS upto, n, sum(n) OVER () AS total FROM (SELECT {d} AS v, count(*) AS n FROM documents WHERE {d} IS NOT NULL GROUP BY 1)),
  e{i} AS (SELECT coalesce(list(v), []) AS ends FROM c{i} WHERE upto * {1 << bits} // total > (upto - n) * {1 << bits} // total AND upto < total)"""
        for i, d in enumerate(dims)
    ]
    points = ", ".join(f"CASE WHEN {d} IS NULL THEN 0 ELSE len(list_filter(e{i}.ends, lambda e: e < {d})) END AS x{i}" for i, d in enumerate(dims))
    steps, index = hilbert_steps(len(dims), bits, "p0")
    return f"""WITH tab AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
  src AS (SELECT *, encode(coalesce(text, '')) AS data FROM documents),
  crc AS (SELECT *, octet_length(data) + 8 AS size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(data), '..'), lambda p: CAST({byte} AS BIGINT))), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM src, tab),
  {", ".join(bins)},
  p0 AS (SELECT doc_id, size, text_crc32, {points}, 0 AS t FROM crc, {", ".join(f"e{i}" for i in range(len(dims)))}),
  {", ".join(steps)},
  k AS (SELECT doc_id, size, text_crc32, {index} AS curve FROM s{len(steps) - 1}),
  r AS (SELECT *, row_number() OVER (ORDER BY curve, md5(coalesce(CAST(doc_id AS VARCHAR), '')), text_crc32, size) - 1 AS rank, count(*) OVER () AS total FROM k)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(rank * {shards} // total AS INT) AS shard, CAST(rank - (total * (rank * {shards} // total) + {shards - 1}) // {shards} AS BIGINT) AS slot,
  CAST(NULL AS INT) AS grown_shard, CAST(curve AS BIGINT) AS curve FROM r"""
