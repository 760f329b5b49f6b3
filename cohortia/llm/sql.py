"""DuckDB SQL of operators whose contract needs CRC-32: a table of 256 values made by its rule, then a fold over bytes."""

CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def crc32(codes: str) -> str:
    """SQL for the CRC-32 of a list of byte values; the table ``crc`` must be joined."""
    return f"""xor(4294967295, list_reduce([4294967295] || {codes},
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])))"""


def _least(*paths: str) -> str:
    return f"list_sort([{', '.join(paths)}])[1]"


def _more(path: str, cost: str, op: str, line: str = "''") -> str:
    return f"{{'c': ({path}).c + {cost}, 'a': ({path}).a || {op}, 'o': ({path}).o || {line}}}"


_FAR = "{'c': 1000000000000, 'a': '', 'o': ''}"
_USER, _REPLY = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
_KEPT, _CUT = "chr(10) || role || ':' || text", "CASE WHEN fault = 3 THEN 5 ELSE 0 END"


def _stays(path: str, initial: str, name: str) -> str:
    """The row kept, or given the role, behind a path."""
    return (f"CASE WHEN fault IN (1, 2) THEN {_FAR} WHEN left(role, 1) = '{initial}' THEN {_more(path, _CUT, repr('K'), _KEPT)} "
            f"ELSE {_more(path, f'1 + {_CUT}', repr('R'), f'chr(10) || {name!r} || text')} END")


# p0 to p3: the best path to each state (at the start, behind s, behind u, behind a): cost, audit, output.
OP13 = f"""
WITH RECURSIVE {CRC_TABLE},
drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32(
      "list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: unicode(x)::BIGINT)")} % 20 AS kind
  FROM conversations, crc),
rows AS (
  SELECT row_number() OVER () AS one, conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM drawn, LATERAL (SELECT unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))) AS copies),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, one) AS rn,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, one) AS again,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed FROM rows),
judged AS (
  SELECT conv_id, turn, role, text, rn, CASE WHEN trimmed = '' THEN 1 WHEN again > 1 THEN 2
      WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY rn) || left(role, 1) AS pair FROM placed),
paths AS (
  SELECT conv_id, 0::BIGINT AS rn, {{'c': 0::BIGINT, 'a': '', 'o': ''}} AS p0, {_FAR} AS p1, {_FAR} AS p2, {_FAR} AS p3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, rn, {_more('p0', '2', "'D'")},
    {_least(_more('p1', '2', "'D'"), f"CASE WHEN fault IN (0, 3) AND left(role, 1) = 's' THEN {_more('p0', _CUT, repr('K'), _KEPT)} ELSE {_FAR} END")},
    {_least(_more('p2', '2', "'D'"), _stays(_least('p0', 'p1', 'f3'), 'u', 'user:'))},
    {_least(_more('p3', '2', "'D'"), _stays('f2', 'a', 'assistant:'))}
  FROM (SELECT *, {_least('p3', _more('f2', '5', "'I'", _REPLY))} AS f3 FROM (
    SELECT j.*, p0, p1, p2, p3, {_least('p2', _more(_least('p0', 'p1', 'p3'), '5', "'I'", _USER))} AS f2
    FROM paths JOIN judged j ON j.conv_id IS NOT DISTINCT FROM paths.conv_id AND j.rn = paths.rn + 1))),
ended AS (
  SELECT conv_id, {_least('p0', 'p3', _more('p2', '5', "'I'", _REPLY), _more('p1', '10', "'II'", f'{_USER} || {_REPLY}'))} AS p
  FROM paths QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY rn DESC) = 1),
tallies AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
    count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, p.c AS cost, p.a AS audit,
  sha256(substr(p.o, 2)) AS repaired_sha256
FROM ended e LEFT JOIN tallies t ON t.conv_id IS NOT DISTINCT FROM e.conv_id
"""


# Neighbours: one word is the other without a letter, or both are equal with one place covered.
OP12 = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
kinds AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS key, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (
  SELECT run, n, {crc32("""flatten(list_transform(string_split(key, ''), lambda x:
      CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END))""")} AS h
  FROM kinds, crc),
words AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word,
    sum(n)::BIGINT AS n FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
places AS (SELECT word, unnest(range(length(word))) AS k FROM words),
shorter AS (SELECT DISTINCT word, left(word, k) || substr(word, k + 2) AS less FROM places),
covered AS (SELECT word, k, left(word, k) || '.' || substr(word, k + 2) AS cover FROM places),
pairs AS (
  SELECT s.word, s.less AS near FROM shorter s JOIN words w ON w.word = s.less
  UNION SELECT s.less, s.word FROM shorter s JOIN words w ON w.word = s.less
  UNION SELECT a.word, b.word FROM covered a JOIN covered b ON a.cover = b.cover AND a.k = b.k AND a.word <> b.word),
tops AS (
  SELECT p.word, count(*) AS n_near, list_sort(list({{'less': -w.n, 'form': p.near}}))[1] AS top
  FROM pairs p JOIN words w ON w.word = p.near GROUP BY p.word),
judged AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.less >= 2 * w.n THEN top.form END AS form,
    CASE WHEN -top.less >= 2 * w.n THEN -top.less END AS form_n FROM words w LEFT JOIN tops t ON t.word = w.word),
ways AS (
  SELECT word, word AS root, form FROM judged
  UNION ALL SELECT w.word, j.word, j.form FROM ways w JOIN judged j ON j.word = w.form)
SELECT j.word, n, n_near, j.form, form_n, w.root FROM judged j JOIN ways w ON w.word = j.word AND w.form IS NULL
"""
