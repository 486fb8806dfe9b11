"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from collections.abc import Sequence

from ..functions import charclass as C

SEP = "chr(1)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lines(text: str) -> str:
    return f"regexp_extract_all({text}, {q(C.LINE)})"


def pieces(line: str) -> str:
    marked = f"regexp_replace({line}, {q(f'([{C.WS}])([{C.WS}][^{C.WS}])')}, '\\1' || chr({C.MARK}) || '\\2', 'g')"
    return f"regexp_extract_all({marked}, {q(C.SQL_PIECE)})"


def words(text: str) -> str:
    return f"regexp_extract_all({text}, {q(C.WORD)})"


def shown(raw: str) -> str:
    """The byte map, through hexadecimal digits."""
    digit = lambda at: f"(strpos('0123456789ABCDEF', substr(hex(encode({raw})), {at}, 1)) - 1)"
    table = "[" + ", ".join(f"chr({ord(C.SHOWN[b])})" for b in range(256)) + "]"
    return f"array_to_string(list_transform(range(0, octet_length(encode({raw}))), lambda i: {table}[16 * {digit('2 * i + 1')} + {digit('2 * i + 2')} + 1]), '')"


WS_COUNTS = f"SELECT word, count(*)::BIGINT AS cnt FROM (SELECT unnest({words('text')}) AS word FROM documents) GROUP BY word"
RAW_COUNTS = f"SELECT piece, count(*)::BIGINT AS cnt FROM (SELECT unnest({pieces('line')}) AS piece FROM (SELECT unnest({lines('text')}) AS line FROM documents)) GROUP BY piece"
BL_COUNTS = f"SELECT {shown('piece')} AS word, cnt FROM ({RAW_COUNTS})"


def alphabet(counts: str = "words") -> str:
    return f"SELECT ch, sum(cnt)::BIGINT AS cnt FROM (SELECT unnest(string_split(word, '')) AS ch, cnt FROM {counts}) GROUP BY ch"


def listed(tokens: Sequence[str]) -> str:
    first = list(dict.fromkeys(tokens))
    return "SELECT NULL::BIGINT AS id, NULL::VARCHAR AS token WHERE false" + "".join(f" UNION ALL SELECT {i}::BIGINT, {q(t)}" for i, t in enumerate(first))


def vocabulary(specials: Sequence[str] = (), alpha: str = "alpha") -> str:
    n = len(dict.fromkeys(specials))
    return f"SELECT id, token FROM ({listed(specials)}) UNION ALL SELECT ({n} - 1 + row_number() OVER (ORDER BY ch))::BIGINT, ch FROM {alpha} WHERE ch NOT IN (SELECT token FROM ({listed(specials)}))"


def merges(counts: str, steps: int, specials: Sequence[str] = (), limit: int | None = None, min_frequency: int | str = 0, also: str = "", most: int | None = None, prefix: str = "") -> str:
    """WITH ...: words, vocabularies v0.., top pairs m1.. and wrapped words w0..; then all (every merge: rank, left_token, right_token, cnt) and vocab (id, token).

    min_frequency: a number, or an expression. most: new pairs must stay below so many characters.
    prefix: before all characters of a word but the first (one of specials and the alphabet otherwise).
    """
    chosen = "SELECT ch, cnt FROM alpha_all" + (f" ORDER BY cnt DESC, ch DESC LIMIT {limit}" if limit is not None else "")
    wrap = f"array_to_string(list_transform(list_filter(string_split(word, ''), lambda c: list_contains(known, c)), lambda c: {SEP} || c || {SEP}), '')"
    first = f"{vocabulary(specials)}"
    tail = "r"
    if prefix:
        p = q(prefix)
        tail = f"(CASE WHEN starts_with(r, {p}) THEN substr(r, {len(prefix) + 1}) ELSE r END)"
        wrap = f"array_to_string(list_transform(list_filter(list_transform(string_split(word, ''), lambda c, i: CASE WHEN NOT list_contains(known, c) THEN '' WHEN i > 1 THEN {p} || c ELSE c END), lambda c: c <> ''), lambda c: {SEP} || c || {SEP}), '')"
        spelled = f"SELECT DISTINCT unnest(list_transform(string_split(substr(word, 2), ''), lambda c: {p} || c)) AS t FROM words WHERE length(word) > 1"
        first = f"SELECT id, token FROM plain UNION ALL SELECT ((SELECT count(*) FROM plain) - 1 + row_number() OVER (ORDER BY t))::BIGINT, t FROM ({spelled}) WHERE t NOT IN (SELECT token FROM plain) AND substr(t, {len(prefix) + 1}) IN (SELECT token FROM plain)"
    allowed = f"AND (length(l) + length(r) < {most} OR length(l) + length(r) = 2)" if most is not None else ""
    least = f"greatest(1, {min_frequency})" if isinstance(min_frequency, str) else str(max(1, min_frequency))
    plain = [f"plain AS MATERIALIZED ({vocabulary(specials)})"] if prefix else []
    out = [f"words AS MATERIALIZED ({counts})", f"alpha_all AS MATERIALIZED ({alphabet()})", f"alpha AS MATERIALIZED ({chosen})", *plain, f"v0 AS MATERIALIZED ({first})", f"w0 AS MATERIALIZED (SELECT word, {wrap} AS w, cnt FROM words, (SELECT list(token) AS known FROM {'plain' if prefix else 'v0'}))"]
    for k in range(1, steps + 1):
        p = k - 1
        pairs = f"SELECT t[i] AS l, t[i + 1] AS r, sum(cnt) AS n FROM (SELECT t, cnt, unnest(range(1, len(t))) AS i FROM (SELECT string_split(substr(w, 2, length(w) - 2), {SEP} || {SEP}) AS t, cnt FROM w{p} WHERE w <> '')) GROUP BY ALL"
        out.append(f"m{k} AS MATERIALIZED (SELECT {p}::BIGINT AS rank, l, r, n::BIGINT AS n FROM ({pairs}) x JOIN v{p} a ON a.token = l JOIN v{p} b ON b.token = r WHERE n >= {least} {allowed} ORDER BY n DESC, a.id, b.id LIMIT 1)")
        out.append(f"v{k} AS MATERIALIZED (SELECT * FROM v{p} UNION ALL SELECT (SELECT max(id) + 1 FROM v{p})::BIGINT, l || {tail} FROM m{k} WHERE l || {tail} NOT IN (SELECT token FROM v{p}))")
        out.append(f"w{k} AS MATERIALIZED (SELECT word, CASE WHEN l IS NULL THEN w ELSE replace(w, {SEP} || l || {SEP} || {SEP} || r || {SEP}, {SEP} || l || {tail} || {SEP}) END AS w, cnt FROM w{p} LEFT JOIN m{k} ON true)")
    union = " UNION ALL ".join(f"SELECT rank, l AS left_token, r AS right_token, n AS cnt FROM m{k}" for k in range(1, steps + 1))
    out += [f"every AS MATERIALIZED ({union})", f"vocab AS MATERIALIZED (SELECT * FROM v{steps})"]
    return "WITH " + ",\n".join(out) + (",\n" + also if also else "") + "\n"


def tokens(w: str = "w") -> str:
    return f"(CASE WHEN {w} = '' THEN 0 ELSE len(string_split(substr({w}, 2, length({w}) - 2), {SEP} || {SEP})) END)"
