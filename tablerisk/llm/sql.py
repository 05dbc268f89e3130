"""DuckDB SQL for the operators whose results SQL can express."""

from __future__ import annotations


def plus(path: str, cost: str, letter: str) -> str:
    """A path, ten digits of cost and then its letters, one edit longer. Paths compare by cost and then by letters."""
    return f"(lpad((left({path}, 10)::bigint + {cost})::varchar, 10, '0') || substr({path}, 11) || '{letter}')"


def op11() -> str:
    """Damage, faults, cheapest edits row by row over the four states of a conversation, and the repaired text."""
    crc = (
        "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::bigint)), "
        "lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), "
        "lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    )
    to_user = "least(c0, c1, c3)"
    extra = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"

    def stay(path: str, price: str, letter: str, when: str) -> str:
        return f"CASE WHEN fault NOT IN ('blank', 'duplicate') AND {when} THEN {plus(path, price, letter)} END"

    def initial(letter: str) -> str:
        return f"initial = '{letter}'"

    after = [
        plus("c0", "2", "D"),
        f"least({plus('c1', '2', 'D')}, {stay('c0', extra, 'K', initial('s'))})",
        f"least({plus('c2', '2', 'D')}, {stay(to_user, '1 + ' + extra, 'R', 'true')}, {stay(to_user, extra, 'K', initial('u'))})",
        f"least({plus('c3', '2', 'D')}, {stay('c2', '1 + ' + extra, 'R', 'true')}, {stay('c2', extra, 'K', initial('a'))})",
    ]
    user = f"least(n2, {plus('least(n0, n1, n3)', '5', 'I')})"
    return f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS k
  FROM conversations),
kinds AS (SELECT *, {crc} % 20 AS kind FROM keyed),
copies AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM copies),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, substr(role, 1, 1) AS initial
  FROM ordered),
judged AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again THEN 'duplicate'
      WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM placed),
paths AS (
  SELECT DISTINCT conv_id, 0::bigint AS pos, repeat('0', 10) AS c0, NULL::varchar AS c1,
    {plus("repeat('0', 10)", "5", "I")} AS c2, {plus("repeat('0', 10)", "10", "II")} AS c3
  FROM judged
  UNION ALL
  SELECT conv_id, pos, n0, n1, {user}, least(n3, {plus(user, "5", "I")})
  FROM (SELECT j.conv_id, j.pos, {", ".join(f"{x} AS n{k}" for k, x in enumerate(after))}
    FROM paths p JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.pos = p.pos + 1)),
ended AS (SELECT conv_id, arg_max(least(c0, c3), pos) AS path FROM paths GROUP BY conv_id),
letters AS (
  SELECT conv_id, unnest(range(1, length(path) - 9)) AS place, substr(path, 10 + place, 1) AS letter FROM ended),
numbered AS (
  SELECT *, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER w AS pos, sum(CASE WHEN letter <> 'D' THEN 1 ELSE 0 END) OVER w AS said
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
spoken AS (
  SELECT n.conv_id, n.place, n.letter, n.said, j.role, j.text,
    max(CASE WHEN n.said = 1 AND n.letter = 'K' AND j.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY n.conv_id) AS sys
  FROM numbered n LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM n.conv_id AND j.pos = n.pos AND n.letter <> 'I'
  WHERE n.letter <> 'D'),
repaired AS (
  SELECT conv_id, sha256(string_agg(
    CASE WHEN letter = 'K' THEN role WHEN (said - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
      || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY place)) AS sha
  FROM spoken GROUP BY conv_id),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id)
SELECT a.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(left(path, 10)::bigint, 0) AS cost, coalesce(substr(path, 11), '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM a.conv_id
"""


ORACLE: dict[str, str] = {"op11_bidirectional_repair": op11()}
