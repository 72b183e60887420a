"""SQL of the operators that SQL can express, for the driver tables in DuckDB."""

from __future__ import annotations

from tripleloom.llm.quality import CAPITALS, RULES, SYMBOLS

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _escaped(text: str) -> str:
    inner = rf"regexp_replace({text}, '(<)(\\*)(/?s>)', '\1\\\2\3', 'g')"
    return rf"regexp_replace({inner}, '(\[)(\\*)(/?INST\])', '\1\\\2\3', 'g')"


CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(3 + length({_escaped("replace(replace(role, chr(92), repeat(chr(92), 2)), chr(10), chr(92) || 'n')")}) + 1
    + length({_escaped("text")}) + 5) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""

LINES = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS line_no FROM split),
keyed AS (SELECT *, {LOWER.format(f"trim(line, {BLANKS})")} AS key FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT keyed.*, coalesce(doc_id <> keeper, FALSE) AS gone FROM keyed LEFT JOIN repeated USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

JACCARD = f"""
WITH RECURSIVE texts AS (SELECT doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM texts WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * met >= 85 * (x.n + y.n - met)),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reached.doc_id, links.b FROM reached JOIN links ON reached.other = links.a)
SELECT r.doc_id, coalesce(max(n), 0) AS n_shingles, min(other) AS component_id
FROM reached r LEFT JOIN sizes ON sizes.doc_id = r.doc_id GROUP BY r.doc_id"""


def _measure(rule) -> str:
    return f"(1000 * {rule.part} // greatest({rule.whole}, 1))"


def _quality() -> str:
    values = " UNION ALL ".join(f"SELECT lang, source, '{r.name}' AS metric, {_measure(r)} AS x FROM base WHERE NOT base_failed" for r in RULES)
    inside = " AND ".join(
        f"coalesce({_measure(r)} <= (SELECT q3 + greatest(3 * (q3 - q1), {r.slack}) FROM quartiles q WHERE q.metric = '{r.name}'"
        f" AND q.lang IS NOT DISTINCT FROM base.lang AND q.source IS NOT DISTINCT FROM base.source), TRUE)"
        + (
            f" AND coalesce({_measure(r)} >= (SELECT q1 - greatest(3 * (q3 - q1), {r.slack}) FROM quartiles q WHERE q.metric = '{r.name}'"
            f" AND q.lang IS NOT DISTINCT FROM base.lang AND q.source IS NOT DISTINCT FROM base.source), TRUE)"
            if r.low
            else ""
        )
        for r in RULES
    )
    return rf"""
WITH texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM texts)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, range(8) r(o) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n, count(DISTINCT line) AS d
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM texts) WHERE trim(line, {BLANKS}) <> '' GROUP BY doc_id),
counts AS (
  SELECT texts.doc_id, lang, source, len(w) AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols,
    length(t) - length(translate(t, '{CAPITALS}', '')) AS n_capitals,
    coalesce(lines.n, 0) AS n_lines, coalesce(lines.n - lines.d, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM texts LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
base AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts),
buckets AS (
  SELECT lang, source, metric, greatest(length(bin(x)) - 5, 0) AS level, x FROM ({values})),
sketch AS (
  SELECT lang, source, metric, level * 32 + (x >> level) AS bucket, count(*) AS n FROM buckets GROUP BY ALL),
ranked AS (
  SELECT *, ((bucket % 32) << (bucket // 32)) AS edge,
    sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, metric) AS total
  FROM sketch),
quartiles AS (
  SELECT lang, source, metric, min(edge) FILTER (4 * upto >= total) AS q1, min(edge) FILTER (4 * upto >= 3 * total) AS q3
  FROM ranked GROUP BY lang, source, metric)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {inside} AS kept
FROM base"""


PASSAGES = rf"""
WITH texts AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS i FROM texts)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS place FROM windows) WHERE place > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM later, range(20) r(o)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM texts),
left_over AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN left_over USING (doc_id)"""

VARIANTS = rf"""
WITH RECURSIVE bits(b, x, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, k + 1 FROM bits WHERE k < 8),
crcs AS (SELECT list(x ORDER BY b) AS t FROM bits WHERE k = 8),
bytes AS (SELECT chr(CAST(range AS INTEGER)) AS c, range AS b FROM range(128)),
runs AS (
  SELECT CAST(doc_id AS VARCHAR) AS id,
    unnest(regexp_extract_all({LOWER.format("text")}, '[A-Za-zÀ-ÿ]{{6,}}')) AS run FROM documents),
each AS (SELECT DISTINCT id, run FROM runs),
coded AS (
  SELECT id, run, flatten(list_transform(string_split(id || ':' || run, ''),
    lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 + (ord(c) >> 6), 128 + (ord(c) & 63)] END)) AS codes FROM each),
hashed AS (
  SELECT id, run, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(codes, lambda c: CAST(c AS BIGINT))),
    lambda h, c: xor(h >> 8, list_extract(t, 1 + (xor(h, c) & 255))))) AS h FROM coded, crcs),
edited AS (
  SELECT id, run, CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2)
    ELSE run END AS word FROM hashed),
vocabulary AS (
  SELECT word, count(*) AS n FROM runs JOIN edited USING (id, run) WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM vocabulary),
cut AS (SELECT word, n, p, substr(word, 1, CAST(p - 1 AS INTEGER)) || substr(word, CAST(p + 1 AS INTEGER)) AS rest FROM places),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN vocabulary b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN vocabulary b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word),
judged AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form,
    CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM vocabulary LEFT JOIN best USING (word)),
followed(word, place, form) AS (
  SELECT word, word, form FROM judged
  UNION ALL SELECT f.word, j.word, j.form FROM followed f JOIN judged j ON f.form = j.word)
SELECT j.word, n, n_near, j.form, form_n, f.place AS root FROM judged j JOIN followed f ON f.word = j.word WHERE f.form IS NULL"""

INFILL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^
]*
|[^
]+') AS u, sha256('7:' || doc_id) AS h FROM documents),
draws AS (
  SELECT doc_id, t, u, len(u) AS n,
    CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM texts),
parts AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
    array_to_string(u[greatest(a, b) + 1:n], '') AS s FROM draws)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts"""

SQL = {
    "op1_chat_format": CHAT,
    "op7_line_dedup": LINES,
    "op8_ngram_jaccard_join": JACCARD,
    "op9_quality_rules": _quality(),
    "op11_substring_dedup": PASSAGES,
    "op12_spelling_variants": VARIANTS,
    "op13_fill_in_middle": INFILL,
}
