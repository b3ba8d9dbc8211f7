"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII text, bit by bit: every character is followed by seven empty steps."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda a, b: {step}), 4294967295)"


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || ({column}::VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _fold(name: str, source: str, levels: int) -> str:
    """CTEs `{name}0` to `{name}{levels}`: nodes (part, pos, node, siblings before and after); a part's last node stays as it is."""
    out = [f"{name}0 AS (SELECT part, pos, node FROM {source})"]
    for n in range(levels):
        out.append(f"""{name}{n}s AS (SELECT *, count(*) OVER (PARTITION BY part) AS many,
            coalesce(string_agg(node, '') OVER (PARTITION BY part, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
            coalesce(string_agg(node, '') OVER (PARTITION BY part, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
            FROM {name}{n})""")
        out.append(f"""{name}{n + 1} AS (SELECT part, pos // 8 AS pos, CASE WHEN any_value(many) = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY pos)) END AS node
            FROM {name}{n}s GROUP BY part, pos // 8)""")
    return ",\n".join(out)


def _climb(name: str, source: str, levels: int, part: str) -> str:
    """CTEs that take (row, place, node, proof) of `source` up the levels of `name`; the last one is `{name}_up{levels}`."""
    out = [f"{name}_up0 AS (SELECT * FROM {source})"]
    for n in range(levels):
        out.append(f"""{name}_up{n + 1} AS (SELECT u.* EXCLUDE (place, node, proof), u.place // 8 AS place, u.proof || s.before || s.after AS proof,
            CASE WHEN s.many = 1 THEN u.node ELSE sha256(s.before || u.node || s.after) END AS node
            FROM {name}_up{n} u JOIN {name}{n}s s ON s.part = {part} AND s.pos = u.place)""")
    return ",\n".join(out)


#: Eight levels hold 16 million leaves a group and as many groups.
LEVELS = 8
LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
MERKLE_MANIFEST = f"""
WITH raw AS (SELECT doc_id, coalesce('=' || lang, '-') AS part, {_leaf("text")} AS leaf,
        CASE WHEN doc_id IS NULL OR {crc32("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf(LOWERED)} ELSE {_leaf("text")} END AS checked FROM documents),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf, checked) - 1 AS place FROM raw),
    inner_nodes AS (SELECT part, place AS pos, leaf AS node FROM leaves),
    {_fold("t", "inner_nodes", LEVELS)},
    subroots AS (SELECT part, node AS subroot, row_number() OVER (ORDER BY encode(part)) - 1 AS number FROM t{LEVELS}),
    outer_nodes AS (SELECT '' AS part, number AS pos, subroot AS node FROM subroots),
    {_fold("g", "outer_nodes", LEVELS)},
    start AS (SELECT doc_id, part, leaf, place, checked AS node, '' AS proof FROM leaves),
    {_climb("t", "start", LEVELS, "u.part")},
    middle AS (SELECT u.* EXCLUDE (place), r.subroot, r.number AS place FROM t_up{LEVELS} u JOIN subroots r USING (part)),
    {_climb("g", "middle", LEVELS, "''")}
SELECT doc_id, leaf, subroot, g{LEVELS}.node AS root, sha256(proof) AS proof_sha256, u.node AS folded_root, u.node = g{LEVELS}.node AS verified
FROM g_up{LEVELS} u CROSS JOIN g{LEVELS}
"""

CONVERSATION_TRIE = f"""
WITH turns AS (SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS turn,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT conv_id, list(turn ORDER BY place) AS turns, {crc32("conv_id::VARCHAR")} % 4 AS h FROM turns GROUP BY conv_id),
    rebuilt AS (SELECT o.conv_id, list_concat(coalesce(list_slice(b.turns, 1, o.h), []), list_slice(o.turns, o.h + 1, len(o.turns))) AS turns
        FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
    steps AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt),
    nodes AS (SELECT list_slice(turns, 1, depth) AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
            string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = len(turns)) AS ends
        FROM steps GROUP BY ALL),
    valued AS (SELECT n.*, (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(path[depth]['text'], '[^\x20\x09-\x0D]+')) END AS value,
            coalesce(c.n, 0) AS n_children
        FROM nodes n LEFT JOIN (SELECT list_slice(path, 1, depth - 1) AS path, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL) c USING (path, depth)),
    upward AS (SELECT *, unnest(range(0, depth + 1)) AS up FROM valued),
    sums AS (SELECT list_slice(path, 1, up) AS path, up AS depth, sum(value)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM upward GROUP BY ALL)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM valued v JOIN sums s USING (path, depth) LEFT JOIN nodes p ON p.depth = v.depth - 1 AND p.path = list_slice(v.path, 1, v.depth - 1)
"""
