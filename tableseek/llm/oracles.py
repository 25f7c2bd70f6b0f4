"""SQL twins of the registered queries, for engines that read the same tables."""

from __future__ import annotations

from tableseek.llm.chat import CLOSE, CONTROL, END, OPEN
from tableseek.llm.licences import RULES, SENTENCES
from tableseek.llm.quality_rules import DOUBT, GRIDS, LANGUAGES, RISK, SIZES

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 34], ' ') AS words FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d)),
twice AS (SELECT words FROM win GROUP BY words HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS pos FROM win SEMI JOIN twice USING (words)),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS words, count(*) AS n FROM placed ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_GRID_ROWS = ", ".join(f"('{r}', {c})" for r, g in GRIDS.items() for c in g)
_ALPHA = RISK / len(GRIDS)
_ERROR = DOUBT / (len(GRIDS) * (len(LANGUAGES) + 1) * (len(SIZES) + 1))
_SIZE = " + ".join(f"(n_words >= {s})::INT" for s in SIZES)
_LANGS = ", ".join(f"'{x}'" for x in LANGUAGES)

QUALITY_RULES = f"""
WITH d AS (
  SELECT doc_id, lang, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
         length(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS capitals
  FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 4], ' ') AS words FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS s FROM d)),
twice AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, words) AS n FROM win) WHERE n > 1),
reps AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(s, s + 5)) AS pos FROM twice) GROUP BY doc_id),
b AS (
  SELECT doc_id, CASE WHEN lang IN ({_LANGS}) THEN lang ELSE 'other' END AS lang, len(w)::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
         n_symbols::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines, capitals
  FROM d LEFT JOIN reps USING (doc_id)),
m AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, lang || '/' || ({_SIZE}) AS stratum,
         CASE WHEN word_chars > 0 THEN (1000 * n_symbols + word_chars - 1) // word_chars ELSE 0 END AS symbols,
         CASE WHEN n_lines > 0 THEN (1000 * n_dup_lines + n_lines - 1) // n_lines ELSE 0 END AS lines,
         CASE WHEN n_words > 0 THEN (1000 * n_repeat_words + n_words - 1) // n_words ELSE 0 END AS windows,
         CASE WHEN word_chars > 0 THEN (1000 * capitals + word_chars - 1) // word_chars ELSE 0 END AS capital_share,
         CASE WHEN n_words > 0 THEN (1000 * word_chars + n_words - 1) // n_words ELSE 0 END AS length
  FROM b),
values_of AS (
  SELECT doc_id, stratum, base_failed, unnest(['symbols', 'lines', 'windows', 'capitals', 'length']) AS rule,
         unnest([symbols, lines, windows, capital_share, length]) AS value FROM m),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
grid AS (SELECT * FROM (VALUES {_GRID_ROWS}) AS t(rule, cutoff)),
counts AS (SELECT stratum, rule, value, count(*) AS n FROM values_of SEMI JOIN good USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
tested AS (
  SELECT stratum, rule, cutoff, sum(n)::BIGINT AS n, sum(CASE WHEN value > cutoff THEN n ELSE 0 END)::BIGINT AS x
  FROM counts JOIN grid USING (rule) GROUP BY ALL),
passed AS (
  SELECT *, CASE WHEN x < {_ALPHA} * n THEN list_sum(list_transform(range(0, x + 1),
      lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({_ALPHA}) + (n - k) * ln(1 - {_ALPHA})))) <= {_ERROR} ELSE false END AS ok
  FROM tested),
worst AS (SELECT stratum, rule, max(CASE WHEN NOT ok THEN cutoff END) AS bad FROM passed GROUP BY ALL),
chosen AS (
  SELECT stratum, rule, min(cutoff) AS cutoff FROM passed JOIN worst USING (stratum, rule) WHERE ok AND (bad IS NULL OR cutoff > bad) GROUP BY ALL),
over AS (SELECT DISTINCT doc_id FROM values_of JOIN chosen USING (stratum, rule) WHERE value > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND over.doc_id IS NULL AS kept
FROM m LEFT JOIN over USING (doc_id)
"""

_KNOWN = ", ".join(f"('{s}', '{i}')" for i, s in SENTENCES.items())
_MATCHES = ", ".join(
    f"CASE WHEN {' OR '.join(f"contains(ids, ' {' '.join(map(str, way))} ')" for way in ways)} THEN '{licence}' END" for licence, ways in sorted(RULES.items())
)

LICENCES = f"""
WITH cut AS (
  SELECT doc_id, list_filter(list_transform(
      string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.!?]+([\\x20\\x09-\\x0D]+|\\z)', chr(10), 'g'), chr(10)),
      lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '') AS sentences
  FROM documents),
known AS (SELECT * FROM (VALUES {_KNOWN}) AS t(sentence, id)),
placed AS (SELECT doc_id, unnest(sentences) AS sentence, unnest(range(len(sentences))) AS pos FROM cut),
named AS (
  SELECT doc_id, regexp_replace(' ' || string_agg(coalesce(id, '0'), ' ' ORDER BY pos) || ' ', '( 0)+ ', ' 0 ', 'g') AS ids, count(*) AS n
  FROM placed LEFT JOIN known USING (sentence) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(trim(ids), '') AS sentence_ids,
       coalesce(array_to_string(list_filter([{_MATCHES}], lambda x: x IS NOT NULL), '|'), '') AS licences
FROM cut LEFT JOIN named USING (doc_id)
"""


def _escaped(column: str) -> str:
    out = f"replace(coalesce({column}, ''), '\\', '\\\\')"
    for control in CONTROL:
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


CHAT = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, * FROM (VALUES (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]')) AS v(turn, role, text)),
a AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS learnt,
         sum(length('{OPEN}' || {_escaped('role')} || '{CLOSE}' || {_escaped('text')} || '{END}')) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(learnt)::BIGINT AS loss_chars, sha256(learnt) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars
FROM a
"""

COLLOCATIONS = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
grams AS (SELECT lang, w[s:s + size - 1] AS w, size FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM p, range(1, 6) AS t(size))),
total AS (SELECT lang, count(*) AS n FROM grams WHERE size = 1 GROUP BY lang),
f AS (SELECT lang, w, size, array_to_string(w, ' ') AS phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1)),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, k, l.a AS l, r.a AS r, n, (1000::HUGEINT * cuts.a * n) // (l.a::HUGEINT * r.a) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = lp JOIN f r ON r.lang = cuts.lang AND r.phrase = rp JOIN total ON total.lang = cuts.lang),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT DISTINCT lang, array_to_string(w[s:s + len - 1], ' ') AS phrase, a
  FROM (SELECT lang, w, a, len, unnest(range(1, size - len + 2)) AS s FROM f, range(2, 5) AS t(len) WHERE len < size)),
ranked AS (
  SELECT worst.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
  FROM worst ANTI JOIN (SELECT i.lang, i.phrase, max(i.a) AS held FROM inside i GROUP BY ALL) x ON x.lang = worst.lang AND x.phrase = worst.phrase AND 100 * held >= 100 * worst.a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""

_TERMS = r"""unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"""

LEXICAL_SEARCH = f"""
WITH t AS (SELECT doc_id, {_TERMS} AS term FROM documents),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS len FROM lengths),
m AS (SELECT doc_id, 100 - 50 + ((50 * n * docs) // len) AS m FROM lengths, whole),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {_TERMS} AS term FROM benchmark)),
w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf SEMI JOIN q USING (term), whole GROUP BY term, docs),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL HAVING score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 50
"""
