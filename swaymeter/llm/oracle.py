"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from swaymeter.llm import mixing, quality
from swaymeter.llm.common import sql_list

WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"^[\x20\x09-\x0D]*$"

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '{WORD}') AS w,
             list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(x, '{BLANK}')) AS lines FROM d),
tri AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT k, i FROM tri QUALIFY count(*) OVER (PARTITION BY k, g) > 1),
rep AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY k),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines,
             len(list_filter(w, lambda x: lower(x) IN ({sql_list(quality.STOP_WORDS)}))) AS n_stop,
             len(list_filter(lines, lambda x: regexp_extract(x, '[^\x20\x09-\x0D]') IN ({sql_list(quality.BULLETS)}))) AS n_bullet,
             len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis
      FROM w LEFT JOIN rep USING (k)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 15.0 AND n_symbols / n_words <= 0.25 AND n_stop / n_words >= 0.01
       AND n_bullet / n_lines <= 0.9 AND n_ellipsis / n_lines <= 0.3 AND n_dup_lines / n_lines <= 0.5 AS kept
FROM b"""

MIXING = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS most FROM s),
o AS (SELECT *, coalesce(sum(most) OVER before, 0) AS full_before, sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
             sum(source_size) OVER () AS total FROM w WINDOW before AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT CAST(total - full_before AS DOUBLE) AS left_over, CAST(open_weight AS DOUBLE) AS share FROM o
        WHERE most * open_weight >= weight * (total - full_before) ORDER BY most / weight, rank LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN most * share < weight * left_over THEN CAST(most AS DOUBLE) ELSE weight * left_over / share END AS target FROM w, cut),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
             CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|{mixing.SEED}'), 1, 13)) AS BIGINT) AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw < (rate - floor(rate)) * {float(2**mixing.BITS)} THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r"""

# base32 of a SHA-1: each 5 hexadecimal digits are 20 bits, so 4 letters
WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
           (CAST(('0x' || substr(h, 5 * CAST(floor(i / 4) AS INTEGER) + 1, 5)) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to
FROM f"""

# windows of 13 words of an item, or the whole of a shorter one, looked up by every run of as many document words
DECONTAMINATION = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT k, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, s WHERE len(w) >= n)),
m AS (SELECT k, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
h AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM m) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT k, item_id FROM m) GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (k) LEFT JOIN t USING (k)"""

# the table of CRC-32, and the CRC-32 of a list of bytes `b`
CRC_TABLE = """tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)))"""
CRC = "xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[CAST((xor(c, x) & 255) + 1 AS INTEGER)])), 4294967295)"
BYTES = "flatten(list_transform(string_split({0}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, unicode(x) - 64] END))"

# near words meet in a pattern with one letter masked (replaced) or in the word without one letter (inserted, deleted)
SPELLING = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
keyed AS (SELECT run, n, {BYTES.format("coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || run")} AS b FROM runs),
hashed AS (SELECT run, n, {CRC} AS h FROM keyed, tab),
cut AS (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
masked AS (SELECT word, n, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS p FROM places),
shorter AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM places),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM masked a JOIN masked b ON a.p = b.p AND a.word <> b.word
  UNION ALL SELECT l.word, v.word, v.n FROM shorter l JOIN v ON v.word = l.s
  UNION ALL SELECT v.word, l.word, l.n FROM shorter l JOIN v ON v.word = l.s),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
formed AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN other END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n
  FROM v LEFT JOIN best USING (word)),
up AS (SELECT word, word AS at FROM formed UNION ALL SELECT up.word, form FROM up JOIN formed ON formed.word = up.at WHERE form IS NOT NULL)
SELECT f.word, form, up.at AS root, n, n_near, form_n FROM formed f JOIN up ON up.word = f.word
WHERE up.at IN (SELECT word FROM formed WHERE form IS NULL)"""


def _add(x: str, cost: str, edit: str) -> str:
    """A state (six digits of cost, then the audit) after one more edit."""
    return f"(lpad(CAST(CAST(substr({x}, 1, 6) AS INTEGER) + {cost} AS VARCHAR), 6, '0') || substr({x}, 7) || '{edit}')"


_MORE = "(CASE fault WHEN 3 THEN 5 ELSE 0 END)"
_TURNS = ", ".join(_add(s, f"1 + {_MORE}", "R") for s in ("s0", "s1", "s3"))
_KEEPS = ", ".join(_add(s, _MORE, "K") for s in ("s0", "s1", "s3"))

# the cheapest edits row by row, kept per state; strings order by cost, then by audit
CONVERSATIONS = f"""
WITH RECURSIVE {CRC_TABLE},
keyed AS (SELECT *, {BYTES.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} AS b FROM conversations),
kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC} % 20 AS kind FROM keyed, tab),
rows AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM kinds WHERE kind <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM rows),
r AS (SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS c, lead(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS after,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
      WHEN regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM numbered),
found AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
    count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
    count(*) FILTER (WHERE c || after NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM r GROUP BY conv_id),
dp AS (
  SELECT conv_id, 0 AS i, '000000' AS s0, CAST(NULL AS VARCHAR) AS s1, '000005I' AS s2, '000010II' AS s3 FROM found
  UNION ALL
  SELECT conv_id, i, t0, t1, u2, least(t3, {_add('u2', '5', 'I')}) FROM (
    SELECT *, least(t2, {_add('t0', '5', 'I')}, {_add('t1', '5', 'I')}, {_add('t3', '5', 'I')}) AS u2 FROM (
      SELECT dp.conv_id, r.i, {_add('s0', '2', 'D')} AS t0,
        least({_add('s1', '2', 'D')}, CASE WHEN fault NOT IN (1, 2) AND c = 's' THEN {_add('s0', _MORE, 'K')} END) AS t1,
        least({_add('s2', '2', 'D')}, CASE WHEN fault NOT IN (1, 2) THEN least({_TURNS}) END, CASE WHEN fault NOT IN (1, 2) AND c = 'u' THEN least({_KEEPS}) END) AS t2,
        least({_add('s3', '2', 'D')}, CASE WHEN fault NOT IN (1, 2) THEN {_add('s2', f'1 + {_MORE}', 'R')} END,
          CASE WHEN fault NOT IN (1, 2) AND c = 'a' THEN {_add('s2', _MORE, 'K')} END) AS t3
      FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1))),
done AS (SELECT f.*, least(s0, s3) AS best FROM found f JOIN dp ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.n = dp.i),
walk AS (
  SELECT conv_id, substr(best, 7) AS audit, 0 AS p, 0 AS i, 0 AS st, CAST([] AS VARCHAR[]) AS lines FROM done
  UNION ALL
  SELECT w.conv_id, audit, p + 1, CASE WHEN e = 'I' THEN w.i ELSE w.i + 1 END, to_st,
    CASE WHEN e = 'D' THEN lines ELSE list_append(lines, CASE WHEN e = 'K' THEN role WHEN to_st = 2 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END) END
  FROM (SELECT w.*, e, role, text, CASE e WHEN 'D' THEN st WHEN 'K' THEN CASE c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE WHEN st = 2 THEN 3 ELSE 2 END END AS to_st
    FROM (SELECT *, substr(audit, p + 1, 1) AS e FROM walk WHERE p < length(audit)) w
    LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1) w),
lines AS (SELECT conv_id, sha256(array_to_string(lines, chr(10))) AS h FROM walk WHERE p = length(audit))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(CAST(substr(best, 1, 6) AS BIGINT), 0) AS cost, coalesce(substr(best, 7), '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM o.conv_id"""

SQL = {
    "op1_warc": WARC, "op5_decontamination": DECONTAMINATION, "op3_quality_rules": QUALITY, "op10_mixing": MIXING,
    "op11_conversation_repair": CONVERSATIONS, "op12_spelling": SPELLING,
}
