"""DuckDB SQL for the numbered queries that SQL can express.

Written from the definitions, without the operators' methods: no anchors, signatures or
buckets. Patterns, sentences and rules come from the operators' fixed values.
"""

from __future__ import annotations

from runledger.llm import contamination, license_scan, secret_scan


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


SUBSTRING_DEDUP = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM t WHERE len(w) >= 50)
), low AS (
  SELECT s, min(doc_id) AS low FROM win GROUP BY s
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN low USING (s) WHERE low < doc_id
), word AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM t
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS body, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""

EXACT_DEDUP = """
WITH t AS (
  SELECT doc_id, encode(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS body FROM documents
), g AS (
  SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM t JOIN g USING (body)
"""


def decontamination() -> str:
    k = contamination.SHINGLE

    def sets(table: str, key: str) -> str:
        short = "".join(
            f"""
  UNION SELECT DISTINCT {key}, unnest([array_to_string(w[i:i + {n - 1}], ' ') FOR i IN range(1, len(w) - {n - 2})]) AS s
  FROM (SELECT {key}, list_filter(string_split_regex(lower(coalesce(text, '')), {quoted(contamination.NOT_WORD)}), lambda x: x <> '') AS w FROM {table} WHERE EXISTS (
    SELECT 1 FROM benchmark b WHERE len(list_filter(string_split_regex(lower(coalesce(b.text, '')), {quoted(contamination.NOT_WORD)}), lambda x: x <> '')) = {n}))"""
            for n in range(1, k)
        )
        return f"""
  SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= {k} THEN [array_to_string(w[i:i + {k - 1}], ' ') FOR i IN range(1, len(w) - {k - 2})]
                                     WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM (SELECT {key}, list_filter(string_split_regex(lower(coalesce(text, '')), {quoted(contamination.NOT_WORD)}), lambda x: x <> '') AS w FROM {table}){short if table == "documents" else ""}"""

    return f"""
WITH d AS ({sets("documents", "doc_id")}
), i AS ({sets("benchmark", "item_id")}
), n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id)
SELECT item_id, doc_id, any_value(n_shingles) AS n_shingles, count(*) AS n_found, round(count(*) / any_value(n_shingles), 6) AS containment
FROM i JOIN d USING (s) JOIN n USING (item_id) GROUP BY item_id, doc_id
HAVING count(*) >= ceil({contamination.THRESHOLD} * any_value(n_shingles) - 1e-9)
"""


def license_query() -> str:
    known = ", ".join(f"({quoted(s)}, {quoted(i)})" for s, i in license_scan.SENTENCES.items())
    steps, last = [], "seq"
    for n, (_, run) in enumerate(license_scan.RULES):
        wanted = quoted("".join(f"<{i}>" for i in run))
        steps.append(f"r{n} AS (SELECT *, contains(rest, {wanted}) AS hit{n}, replace(rest, {wanted}, '|') AS next FROM {last})")
        steps.append(f"q{n} AS (SELECT * EXCLUDE (rest, next), next AS rest FROM r{n})")
        last = f"q{n}"
    names = ", ".join(f"CASE WHEN hit{n} THEN {quoted(name)} END" for n, (name, _) in enumerate(license_scan.RULES))
    norm = lambda x: f"trim(regexp_replace(lower({x}), {quoted(license_scan.NOT_WORD)}, ' ', 'g'))"
    return f"""
WITH known(sentence, id) AS (VALUES {known}
), sentence AS (
  SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS place
  FROM (SELECT doc_id, regexp_split_to_array(text, {quoted(license_scan.SENTENCE_END)}) AS parts FROM documents WHERE text IS NOT NULL)
), unit AS (
  SELECT doc_id, place, 0 AS line, {norm("s")} AS u FROM sentence
  UNION ALL
  SELECT doc_id, place, line, {norm("u")} FROM (
    SELECT doc_id, place, unnest(lines) AS u, generate_subscripts(lines, 1) AS line FROM (SELECT doc_id, place, string_split(s, chr(10)) AS lines FROM sentence)
  )
), found AS (
  SELECT doc_id, place, min(line) AS line, any_value(id) AS id FROM unit JOIN known ON u = sentence GROUP BY doc_id, place, u
), seq AS (
  SELECT doc_id, count(*) AS n_sentences, string_agg(id, ',' ORDER BY place, line) AS sentence_ids, string_agg('<' || id || '>', '' ORDER BY place, line) AS rest
  FROM found GROUP BY doc_id
), {", ".join(steps)}
SELECT doc_id, n_sentences, sentence_ids,
  array_to_string(list_sort(list_distinct(list_filter([{names}], lambda x: x IS NOT NULL))), ',') AS licences,
  length(rest) - length(replace(rest, '<', '')) AS n_unmatched
FROM {last}
"""


def secret_query() -> str:
    s = secret_scan
    forms = [
        ("assign", s.ASSIGN, 1, f"length(part) >= {s.ASSIGN_LEAST}"),
        ("access", s.ACCESS, 0, f"length(hit) >= {s.ACCESS_LEAST}"),
        ("hex", s.HEX, 0, f"length(hit) >= {s.HEX_LEAST}"),
        ("weak_id", s.WEAK_ID, 0, "true"),
        ("weak_secret", s.WEAK_ASSIGN, 0, "true"),
        (
            "weak_secret",
            s.LONG_RUN,
            0,
            f"length(hit) = {s.RUN_LENGTH} AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[0-9]')",
        ),
        ("endpoint", s.ENDPOINT, 0, "true"),
    ]
    parts = " UNION ".join(
        f"""
  SELECT doc_id, {s.KINDS.index(kind)} AS kind, place + length(gap) - length(hit) AS start, place + length(gap) AS "end" FROM (
    SELECT doc_id, hit, part, gap, coalesce(sum(length(gap)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM (
      SELECT doc_id, k, hits[k] AS hit, parts[k] AS part, gaps[k] || hits[k] AS gap FROM (
        SELECT doc_id, unnest(range(1, len(hits) + 1)) AS k, hits, parts, gaps FROM (
          SELECT doc_id, regexp_extract_all(x, {quoted(pattern)}, 0) AS hits, regexp_extract_all(x, {quoted(pattern)}, {group}) AS parts,
                 regexp_split_to_array(x, {quoted(pattern)}) AS gaps
          FROM t)))) WHERE {keep}"""
        for kind, pattern, group, keep in forms
    )
    index = {k: i for i, k in enumerate(s.KINDS)}
    ids, secrets = f"({index['access']}, {index['weak_id']})", f"({index['assign']}, {index['hex']}, {index['weak_secret']})"
    near = lambda kinds: f"EXISTS (SELECT 1 FROM part o WHERE o.doc_id = p.doc_id AND o.kind IN {kinds} AND abs(o.start - p.start) <= {s.SCOPE})"
    names = "CASE kind " + " ".join(f"WHEN {i} THEN {quoted(k)}" for k, i in index.items()) + " END"
    listed = f"""string_agg({names} || ':' || start || ':' || "end", ',' ORDER BY start, kind, "end")"""
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents
), every AS ({parts}
), part AS (
  SELECT * FROM every e WHERE kind <= 2 OR NOT EXISTS (
    SELECT 1 FROM every b WHERE b.doc_id = e.doc_id AND b.kind <= 2 AND b.start <= e.start AND e.start < b."end")
), shown AS (
  SELECT * FROM part p WHERE kind <= 2
    OR (kind = {index["weak_secret"]} AND {near(ids)})
    OR (kind = {index["weak_id"]} AND {near(secrets)})
    OR (kind = {index["endpoint"]} AND {near(ids)} AND {near(secrets)})
), g AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         {listed} FILTER (kind <= 2) AS base, {listed} AS spans
  FROM shown GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (doc_id)
"""


def phrase_query(least: int = 30, top: int = 2000) -> str:
    """Phrases by counting every run of up to four words."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), runs AS (
  SELECT lang, row_number() OVER () AS piece, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), placed AS (
  SELECT lang, piece, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM runs
), windows AS (
  SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3, lead(w1, 3) OVER p AS w4 FROM placed WINDOW p AS (PARTITION BY piece ORDER BY i)
), grams AS (
  SELECT lang, 1 AS k, w1 AS phrase FROM windows
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM windows WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM windows WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM windows WHERE w4 IS NOT NULL
), counts AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL
), sizes AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang
), cand AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k >= 2 AND f >= {least}
), cuts AS (
  SELECT c.lang, c.phrase, c.a, c.w, c.k, j AS cut FROM cand c, (VALUES (1), (2), (3)) s(j) WHERE j < c.k
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.w, c.k, c.cut, h.f AS l, t.f AS r, ((2000000::HUGEINT * c.a) // (h.f::HUGEINT + t.f))::BIGINT AS score
  FROM cuts c
  JOIN counts h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN counts t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[c.cut + 1:c.k], ' ')
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, a AS longer, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM cand, (VALUES (2), (3)) s(m), (VALUES (1), (2), (3)) p(i) WHERE m < k AND i + m - 1 <= k
), kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM inside x WHERE x.lang = b.lang AND x.phrase = b.phrase AND 100::HUGEINT * x.longer >= 80::HUGEINT * b.a)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, s.n, r.score FROM ranked r JOIN sizes s USING (lang) WHERE r.rank <= {top}
"""


SQL: dict[str, str] = {
    "op1_substring_dedup": SUBSTRING_DEDUP,
    "op2_license_scan": license_query(),
    "op4_secret_scan": secret_query(),
    "op5_exact_dedup": EXACT_DEDUP,
    "op6_decontamination": decontamination(),
    "op11_phrases": phrase_query(),
}
