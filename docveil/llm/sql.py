"""SQL of ranked search, the manifest and media payloads, for DuckDB."""

from __future__ import annotations

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Scores of every document with a term of an item, in whole numbers.
_SEARCH = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({low}, '{term}') AS ts FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({low}, '{term}')) AS t FROM benchmark),
a AS (SELECT count(*) FILTER (len(ts) > 0) AS nn, sum(len(ts))::BIGINT AS ll FROM d),
p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS t FROM d) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, a GROUP BY t, nn),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::BIGINT AS score FROM i JOIN p USING (t) JOIN w USING (t), a GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST, r)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50
"""


def search_sql() -> str:
    from docveil.llm.search import TERM

    return _SEARCH.format(low=_LOW.format("coalesce(text, '')"), term=TERM)


def _crc32(numbers: str) -> str:
    """CRC-32 of a list of bytes, bit by bit."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END"
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], {numbers}), lambda c, b: list_reduce(list_concat([xor(c, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: {step})), 4294967295::UBIGINT)"


def _tree(t: str, levels: int) -> list[str]:
    """Runs of 16 and their parents above the table {t}0; a level with one node is its own parent."""
    out = []
    for k in range(levels):
        out.append(f"{t}r{k} AS (SELECT g, idx // 16 AS p, any_value(n) AS n, list(h ORDER BY idx) AS hs FROM {t}{k} GROUP BY g, idx // 16)")
        out.append(f"{t}{k + 1} AS (SELECT g, p AS idx, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {t}r{k})")
    return out


def _joins(t: str, levels: int) -> str:
    return " ".join(f"JOIN {t}r{k} ON {t}r{k}.g = {t}0.g AND {t}r{k}.p = {t}0.idx // {16 ** (k + 1)}" for k in range(levels))


def _path(t: str, levels: int) -> str:
    """The siblings before and after a node of {t}0, level by level."""

    def pair(k: int) -> str:
        at = f"({t}0.idx // {16**k}) % 16"
        return f"CASE WHEN {t}r{k}.n = 1 THEN [] ELSE [[array_to_string({t}r{k}.hs[1:{at}], ''), array_to_string({t}r{k}.hs[{at} + 2:], '')]] END"

    return "[]::VARCHAR[][]" + "".join(f" || {pair(k)}" for k in range(levels))


def manifest_sql(levels: int = 5) -> str:
    """Trees of up to 16^levels leaves a source, and as many sources."""
    head = " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars"))

    def leaf(text: str) -> str:
        return f"sha256({head} || coalesce(octet_length(encode({text})) || ':' || {text}, '-'))"

    crc = _crc32("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)")
    parts = [
        f"c AS (SELECT *, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(_LOW.format('text'))} ELSE {leaf('text')} END AS told FROM documents)",
        "a0 AS (SELECT coalesce('1' || source, '0') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n, leaf AS h, doc_id, told FROM c)",
        *_tree("a", levels),
        f"b0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n, h, g AS source FROM a{levels})",
        *_tree("b", levels),
        f"tops AS (SELECT b0.source AS g, b0.h AS subroot, b{levels}.h AS root, {_path('b', levels)} AS up FROM b0 {_joins('b', levels)} JOIN b{levels} ON true)",
        f"leaves AS (SELECT a0.doc_id, a0.h AS leaf, a0.told, tops.subroot, tops.root, {_path('a', levels)} || tops.up AS path FROM a0 {_joins('a', levels)} JOIN tops ON tops.g = a0.g)",
        "folded AS (SELECT *, list_reduce([[told, '']] || path, lambda h, s: [sha256(s[1] || h[1] || s[2]), ''])[1] AS folded_root FROM leaves)",
    ]
    proof = "sha256(array_to_string(list_transform(path, lambda s: s[1] || s[2]), ''))"
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, {proof} AS proof_sha256, folded_root, folded_root = root AS verified FROM folded"


def payloads_sql() -> str:
    """Payloads in hexadecimal form, and their last bytes as numbers."""
    return f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
e AS (SELECT doc_id, octet_length(b)::BIGINT AS n, greatest((octet_length(b) + 63) // 64 * 64, 64)::BIGINT AS m, hex(b) AS x FROM d),
f AS (SELECT *, x || repeat('00', (m - n)::INT) AS y FROM e),
g AS (SELECT *, list_transform(range(64), lambda k: ('0x' || substr(y, (2 * (m - 64 + k) + 1)::INT, 2))::UBIGINT) AS tail FROM f)
SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(unhex(y)) AS payload_sha256, {_crc32("tail")}::BIGINT AS tail_crc32 FROM g
"""
