"""SQL of the queries that SQL can express: MinHash near-duplicates by counting shared shingles, fill-in-the-middle, and the Merkle manifest."""

from __future__ import annotations

_SPACE = r"\x20\x09-\x0D"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^{_SPACE}]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS x FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 180 * count(*) >= 80 * (a.n + b.n)),
pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN pairs l ON l.a = r.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = s.doc_id"""

FILL_IN_MIDDLE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+') AS units, {', '.join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))} FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
sha256(t) AS restored_sha256 FROM p"""

#: Levels that the SQL of the manifest goes through: of a language, and over the languages.
_LEAF_LEVELS, _ROOT_LEVELS = 24, 8


def _crc32(text: str) -> str:
    """The checksum of an ASCII text, bit by bit (reversed polynomial 0xEDB88320)."""
    byte = "list_reduce([xor(acc, x), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda acc, x: {byte}), 4294967295)"


def _leaf(n_chars: str) -> str:
    part = lambda v: f"coalesce(CAST(octet_length(encode(CAST({v} AS VARCHAR))) AS VARCHAR) || ':' || CAST({v} AS VARCHAR), '-')"
    return f"sha256({' || '.join(part(v) for v in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


def _up(name: str, levels: int) -> list[str]:
    """Tables ``name1`` .. of nodes ``tree, i, d, n``: those of each level and how many there are."""
    pair = "CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END"
    return [f"{name}{k + 1} AS (SELECT tree, i // 2 AS i, {pair} AS d, (any_value(n) + 1) // 2 AS n FROM {name}{k} GROUP BY tree, i // 2)" for k in range(levels)]


def _folded(rows: str, name: str, levels: int) -> list[str]:
    """Tables ``rows_1`` ..: each row's siblings so far and what it comes to, a level further up."""
    fold = "CASE WHEN o.n = 1 THEN r.f WHEN s.d IS NULL THEN sha256(r.f) WHEN r.i % 2 = 1 THEN sha256(s.d || r.f) ELSE sha256(r.f || s.d) END"
    out = []
    for k in range(levels):
        size = f"(SELECT tree, any_value(n) AS n FROM {name}{k} GROUP BY tree)"
        out.append(f"{rows}_{k + 1} AS (SELECT r.doc_id, r.leaf, r.home, r.tree, r.i // 2 AS i, r.proof || coalesce(s.d, '') AS proof, {fold} AS f FROM {rows}_{k} r JOIN {size} o ON o.tree = r.tree LEFT JOIN {name}{k} s ON s.tree = r.tree AND s.i = xor(r.i, 1))")
    return out


def _manifest() -> str:
    last, top = _LEAF_LEVELS, _ROOT_LEVELS
    parts = [
        f"leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf('n_chars')} AS leaf, CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_leaf('n_chars + 1')} ELSE {_leaf('n_chars')} END AS now FROM documents)",
        "t0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS d, count(*) OVER (PARTITION BY tree) AS n FROM leaves)",
        *_up("t", last),
        f"r0 AS (SELECT '' AS tree, tree AS of_tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, d, count(*) OVER () AS n FROM t{last})",
        *_up("r", top),
        "own_0 AS (SELECT doc_id, leaf, tree AS home, tree, i, now AS f, '' AS proof FROM t0)",
        *_folded("own", "t", last),
        f"far_0 AS (SELECT o.doc_id, o.leaf, o.home, '' AS tree, r0.i, o.f, o.proof FROM own_{last} o JOIN r0 ON r0.of_tree = o.home)",
        *_folded("far", "r", top),
    ]
    shown = "o.doc_id, o.leaf, s.d AS subroot, root.d AS root, sha256(o.proof) AS proof_sha256, o.f AS folded_root, o.f = root.d AS verified"
    return f"WITH {', '.join(parts)} SELECT {shown} FROM far_{top} o JOIN t{last} s ON s.tree = o.home, r{top} root"


SQL = {"op11_minhash_near_dedup": NEAR_DUPLICATES, "op12_fill_in_middle": FILL_IN_MIDDLE, "op13_merkle_manifest": _manifest()}
