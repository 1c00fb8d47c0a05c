"""SQL whose steps repeat: rounds of a codebook's training, levels of a hash tree."""

from __future__ import annotations


_BIT = "xor(x >> 1, (x & 1) * 3988292384::UBIGINT)"
#: crc32's table for each byte (reflected polynomial 0xEDB88320), and the crc32 of doc_id's decimal text with it.
CRC_TABLE = "k AS MATERIALIZED (SELECT list(x ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_concat([i::UBIGINT], range(8)::UBIGINT[]), lambda x, y: " + _BIT + ") AS x FROM range(256) t(i)))"
CRC = "xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda a, b: xor(a >> 8, k.tab[((xor(a, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)"


def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """DuckDB SQL for the rows of op11."""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * x::DOUBLE) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"pt AS MATERIALIZED (SELECT vec_id, p, w[p * (len(w) // {parts}) + 1 : (p + 1) * (len(w) // {parts})] AS x FROM v, range({parts}) t(p))",
        f"c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM pt WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries}))",
    ]
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS (SELECT vec_id, p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM pt JOIN c{r} USING (p)),
a{r} AS MATERIALIZED (SELECT vec_id, p, e, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) AS rn FROM d{r}) WHERE rn = 1)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT p, e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM (SELECT a.p, a.e, x, unnest(range(1, len(x) + 1)) AS i FROM a{r} a JOIN pt USING (vec_id, p)) GROUP BY p, e, i),
m{r} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY p, e),
c{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m USING (p, e))""")
    return f"""WITH {",".join(steps)},
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM c{rounds}),
f AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM f JOIN v USING (vec_id), h"""


def merkle(levels: int = 7, fan: int = 8) -> str:
    """DuckDB SQL for the rows of op12, for up to fan ** levels rows of a language, and as many languages."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = ", ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    steps = [
        CRC_TABLE,
        f"t AS (SELECT doc_id, lang, sha256(concat({head}, {field('text')})) AS leaf, CASE WHEN {CRC} % 3 = 0 THEN sha256(concat({head}, {field(low)})) END AS other FROM documents, k)",
        "l0 AS MATERIALIZED (SELECT coalesce(lang, chr(0)) AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS h, doc_id, other FROM t)",
    ]
    tables = ["l0"]

    def up(source: str, name: str) -> str:
        """The next level; groups of one node stay as they are."""
        return f"{name} AS MATERIALIZED (SELECT g, pos // {fan} AS pos, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {source}) GROUP BY g, pos // {fan})"

    for i in range(1, levels + 1):
        steps.append(up(tables[-1], f"l{i}"))
        tables.append(f"l{i}")
    steps.append(f"r0 AS MATERIALIZED (SELECT 0 AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, h, g AS name FROM l{levels})")
    roots = ["r0"]
    for i in range(1, levels + 1):
        steps.append(up(roots[-1], f"r{i}"))
        roots.append(f"r{i}")

    def walk(name: str, source: str, table: str, place: str, group: str, hashed: str) -> str:
        """Siblings at one level, joined to what was found below: b before, a after."""
        return f"""{name} AS MATERIALIZED (SELECT w.* EXCLUDE (proof, fold, b, a, one), proof || b || a AS proof, CASE WHEN one THEN fold ELSE sha256(b || fold || a) END AS fold FROM (
  SELECT w.*, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < {place}), '') AS b, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > {place}), '') AS a, any_value(s.n) = 1 AS one
  FROM {source} w JOIN (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {table}) s ON s.g = {group} AND s.pos // {fan} = {place} // {fan} GROUP BY ALL) w)"""

    steps.append("w0 AS (SELECT row_number() OVER () AS id, doc_id, g, pos, h AS leaf, '' AS proof, coalesce(other, h) AS fold FROM l0)")
    for i in range(levels):
        steps.append(walk(f"w{i + 1}", f"w{i}", f"l{i}", f"(w.pos // {fan**i})", "w.g", "h"))
    steps.append(f"x0 AS (SELECT w.*, r.pos AS rpos, r.h AS subroot FROM w{levels} w JOIN r0 r ON r.name = w.g)")
    for i in range(levels):
        steps.append(walk(f"x{i + 1}", f"x{i}", f"r{i}", f"(w.rpos // {fan**i})", "0", "h"))
    return f"""WITH {", ".join(steps)}
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = r.h AS verified FROM x{levels}, r{levels} r"""


def base_scores() -> str:
    """DuckDB SQL for the columns of op13 that don't come from the model."""
    return f"WITH {CRC_TABLE}," + r"""t AS (SELECT doc_id, list_concat(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ['']) AS w, """ + f"{CRC} % 7 = 2" + """ AS held_out FROM documents, k),
o AS (SELECT doc_id, held_out, unnest(w) AS w FROM t),
c AS (SELECT w, count(*) AS c FROM o WHERE NOT held_out GROUP BY w),
s AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c.c) AS n_known, any_value(s.n) AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 1)::DOUBLE / (s.n + s.v + 1))), 6) AS base_score
FROM o LEFT JOIN c USING (w), s GROUP BY doc_id, held_out"""
