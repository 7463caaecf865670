"""DuckDB SQL for the queries that SQL can express."""

#: The words between ASCII blanks, as an array.
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_SPLIT = f"docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('coalesce(text, \'\')')} AS w FROM documents)"

OP5 = f"""WITH {_SPLIT},
windows AS (SELECT r, k, array_to_string(w[k : k + 34], ' ') AS win FROM docs, LATERAL (SELECT unnest(range(1, len(w) - 33)) AS k)),
hits AS (SELECT r, k FROM windows WHERE win IN (SELECT win FROM windows GROUP BY win HAVING count(*) > 1)),
words AS (SELECT r, k, w[k] AS word FROM docs, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS k)),
marked AS (SELECT r, k, word, max(CASE WHEN hits.k IS NOT NULL THEN 1 END) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM words LEFT JOIN hits USING (r, k)),
kept AS (SELECT r, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY k) FILTER (WHERE NOT gone), '') AS kept FROM marked GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (r)"""

OP8 = f"""WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS s FROM docs, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id FROM docs d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)"""

OP9 = """WITH RECURSIVE sound AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id) JOIN (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a) c USING (vec_id)"""


def _matches(kinds: dict[str, tuple[str, str]]) -> str:
    """Rows r, o (order of the kind), kind, v, lo, hi of the matches that pass: the pieces between matches tell where they stand."""
    one = """SELECT r, {o} AS o, '{kind}' AS kind, v, lo, lo + length(v) AS hi FROM (SELECT r, v, CAST(sum(length(before)) OVER (PARTITION BY r ORDER BY i) + coalesce(sum(length(v)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lo
FROM docs, LATERAL (SELECT unnest(regexp_extract_all(t, '{pattern}')) AS v, unnest(regexp_split_to_array(t, '{pattern}')) AS before, generate_subscripts(regexp_split_to_array(t, '{pattern}'), 1) AS i) WHERE v IS NOT NULL) WHERE {passes}"""
    return " UNION ALL ".join(one.format(o=o, kind=kind, pattern=pattern.replace("'", "''"), passes=passes) for o, (kind, (pattern, passes)) in enumerate(kinds.items()))


def _digest(spans: str, base: int) -> str:
    """The digest columns over rows (r, o, kind, lo, hi)."""
    listed = "coalesce(string_agg(kind || ':' || lo || ':' || hi, ',' ORDER BY lo, o){}, '')"
    return f"(SELECT r, {listed.format(f' FILTER (WHERE o < {base})')} AS base, {listed.format('')} AS spans FROM {spans} GROUP BY r)"


_ROWS = "docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents)"
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_SECRETS = {
    "assign": (_ASSIGN, f"length(regexp_extract(v, '{_ASSIGN.replace(chr(39), chr(39) * 2)}', 2)) >= 12"),
    "access": ("AKIA[A-Z0-9]+", "length(v) >= 18"),
    "hex": ("[0-9a-f]+", "length(v) >= 16"),
    "github": ("gh[pousr]_[A-Za-z0-9]+", "length(v) >= 40"),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "length(v) >= 40"),
    "slack": ("xox[abprs]-[A-Za-z0-9-]+", "length(v) >= 20"),
    "pem": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"),
}
OP7 = f"""WITH {_ROWS}, spans AS ({_matches(_SECRETS)})
SELECT doc_id, {", ".join(f"(SELECT count(*) FROM spans s WHERE s.r = docs.r AND kind = '{k}') AS n_{k}" for k in list(_SECRETS)[:3])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN {_digest("spans", 3)} USING (r)"""

_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse({_DIGITS})[i] AS INTEGER) ELSE CAST(reverse({_DIGITS})[i] AS INTEGER) * 2 - CASE WHEN CAST(reverse({_DIGITS})[i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(v, '.'), lambda x: NOT coalesce(TRY_CAST(x AS HUGEINT) <= 255, false))) = 0"),
    "card": (r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
}
OP2 = f"""WITH {_ROWS}, base AS ({_matches(_PII)}), held AS (SELECT DISTINCT r, kind || ':' || lower(v) AS e FROM base),
often AS (SELECT e, count(*) AS n_e FROM held GROUP BY e HAVING count(*) >= 3), near AS (SELECT r, e FROM held WHERE e IN (SELECT e FROM often)),
places AS ({_matches({"term": ("[" + chr(92) + "p{L}" + chr(92) + "p{N}]+", "r IN (SELECT r FROM near)")})}),
joint AS (SELECT e, w, count(*) AS n_te FROM (SELECT DISTINCT r, e, lower(v) AS w FROM near JOIN places USING (r)) GROUP BY ALL HAVING count(*) >= 3),
frequency AS (SELECT w, count(*) AS n_t FROM (SELECT DISTINCT r, unnest(list_transform(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+'), lambda x: lower(x))) AS w FROM docs) WHERE w IN (SELECT w FROM joint) GROUP BY w),
told AS (SELECT e, w, CASE WHEN log2(d / n_e) > 0 THEN log2(d * n_te / (n_t * n_e)) / log2(d / n_e) ELSE 0 END AS share FROM joint JOIN frequency USING (w) JOIN often USING (e), (SELECT count(*)::DOUBLE AS d FROM docs)),
marked AS (SELECT r, lo, hi, max(share) AS share FROM near JOIN places USING (r) JOIN told ON told.e = near.e AND told.w = lower(v) WHERE share >= 0.6 GROUP BY r, lo, hi),
spans AS (SELECT r, o, kind, lo, hi FROM base UNION ALL SELECT r, 4, CASE WHEN share >= 0.8 THEN 'removed' ELSE 'generalised' END, lo, hi FROM marked m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = m.r AND b.lo <= m.lo AND m.hi <= b.hi))
SELECT doc_id, {", ".join(f"(SELECT count(*) FROM base s WHERE s.r = docs.r AND kind = '{k}') AS n_{k}" for k in _PII)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN {_digest("spans", 4)} USING (r)"""

_LENGTHS = range(5, 11)
_LATER = ", ".join(f"coalesce(sum(length(word)) FILTER (WHERE later_{n}), 0)::BIGINT AS dup_chars_{n}" for n in _LENGTHS)
OP11 = f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
words AS (SELECT r, k, w[k] AS word FROM docs, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS k)),
{"".join(f"""w{n} AS (SELECT r, k, count(*) OVER (PARTITION BY r, win) > 1 AS twice, row_number() OVER (PARTITION BY r, win ORDER BY k) > 1 AS again FROM (SELECT r, k, array_to_string(w[k : k + {n - 1}], ' ') AS win FROM docs, LATERAL (SELECT unnest(range(1, len(w) - {n - 2})) AS k))),
""" for n in _LENGTHS)}marked AS (SELECT r, word, {", ".join(f"coalesce(bool_or(w{n}.again) OVER (PARTITION BY words.r ORDER BY words.k ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), false) AS later_{n}" for n in _LENGTHS)},
coalesce(bool_or(w5.twice) OVER (PARTITION BY words.r ORDER BY words.k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), false) AS twice FROM words {" ".join(f"LEFT JOIN w{n} USING (r, k)" for n in _LENGTHS)}),
counted AS (SELECT r, sum(length(word))::BIGINT AS word_chars, count(*) FILTER (WHERE twice) AS n_repeat_words, {_LATER} FROM marked GROUP BY r),
lines AS (SELECT r, line, count(*) - 1 AS more FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line HAVING count(*) > 1),
again AS (SELECT r, sum(more)::BIGINT AS n_dup_lines, sum(more * length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')))::BIGINT AS dup_line_chars FROM lines GROUP BY r),
found AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
coalesce(dup_line_chars, 0) AS dup_line_chars, {", ".join(f"coalesce(dup_chars_{n}, 0) AS dup_chars_{n}" for n in _LENGTHS)} FROM docs LEFT JOIN counted USING (r) LEFT JOIN again USING (r)),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM found)
SELECT *, NOT base_failed AND 100 * dup_line_chars <= 30 * word_chars AND {" AND ".join(f"100 * dup_chars_{n} <= {25 - n} * word_chars" for n in _LENGTHS)} AS kept FROM based"""


def _clusters(rounds: int) -> str:
    """Rounds of assigning and moving, one after the other."""
    nearest = "(SELECT vec_id, v, unnest(list_transform(c, lambda m, i: {{'d': list_sum(list_transform(v, lambda x, j: (x - m[j]) * (x - m[j]))), 'k': i - 1}})) AS o FROM kept, m{0})"
    steps = []
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT id, any_value(vec_id) AS vec_id, any_value(v) AS v, min(o) AS o FROM {nearest.format(n).replace('vec_id, v, unnest', 'id, vec_id, v, unnest')} GROUP BY id)")
        if n < rounds:
            steps.append(f"""s{n} AS (SELECT k, j, sum(x) AS s, count(*) AS n FROM (SELECT o.k AS k, unnest(v) AS x, unnest(range(1, 65)) AS j FROM a{n}) GROUP BY k, j),
t{n} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM s{n} GROUP BY k),
m{n + 1} AS MATERIALIZED (SELECT list(coalesce(t.c, old.c) ORDER BY old.k) AS c FROM (SELECT unnest(c) AS c, unnest(range(0, len(c))) AS k FROM m{n}) old LEFT JOIN t{n} t USING (k))""")
    return ",\n".join(steps)


OP13 = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
m0 AS MATERIALIZED (SELECT list(v ORDER BY h) AS c FROM (SELECT sha256('3:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT 8)),
{_clusters(10)},
sums AS (SELECT o.k AS k, sum(o.d) AS cluster_inertia FROM a10 GROUP BY ALL)
SELECT vec_id, CAST(o.k AS INTEGER) AS cluster, CAST(o.d AS BIGINT) AS distance, CAST(cluster_inertia AS BIGINT) AS cluster_inertia, CAST((SELECT sum(cluster_inertia) FROM sums) AS BIGINT) AS inertia, sha256(array_to_string((SELECT c FROM m10)[o.k + 1], ',')) AS centroid_sha256 FROM a10 JOIN sums ON sums.k = o.k"""

ORACLES = {"op2_pii": OP2, "op5_substring_dedup": OP5, "op7_secret_scan": OP7, "op8_ngram_jaccard": OP8, "op9_embedding_dedup": OP9, "op11_quality_rules": OP11, "op13_centroid_clusters": OP13}
