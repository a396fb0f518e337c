"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

from .common import SPACE, WORD
from .queries import RULES

_RULES = ", ".join(str(r) for r in RULES)
_HOST = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def dedup_sql(documents: str = "documents") -> str:
    return f"""WITH rows AS (SELECT doc_id, length(coalesce(text, '')) AS points,
    sha256(regexp_replace(coalesce(text, ''), '[{SPACE}]+', '', 'g')) AS text_sha256 FROM {documents}),
  ranked AS (SELECT *, row_number() OVER g AS n, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
    FROM rows WINDOW g AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS FIRST))
SELECT doc_id, keep_id, group_size, n = 1 AS kept, text_sha256 FROM ranked"""


def mix_sql(documents: str = "documents") -> str:
    return f"""WITH rows AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 8))::BIGINT AS key FROM {documents}),
  sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
  ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sources),
  weighted AS (SELECT *, (rank - 1) % 3 + 1 AS weight, source_size * 3 AS top FROM ranked),
  levels AS (SELECT *, ((sum(source_size) OVER () - (sum(top) OVER o - top))::DOUBLE / (sum(weight) OVER () - (sum(weight) OVER o - weight))::DOUBLE) AS level
    FROM weighted WINDOW o AS (ORDER BY top / weight, rank)),
  chosen AS (SELECT coalesce(arg_min(level, (top / weight, rank)), 0) AS level FROM levels WHERE level * weight <= top),
  targets AS (SELECT source, source_size, least(chosen.level * weight, top::DOUBLE) AS target FROM levels, chosen),
  placed AS (SELECT doc_id, size, source_size, target,
      CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs,
      (sum(size) OVER (PARTITION BY rows.source ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
    FROM rows JOIN targets ON rows.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken FROM placed"""


def url_sql() -> str:
    return f"""WITH rules (verdict, host, path) AS (VALUES {_RULES}),
  urls AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{_HOST}', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '{_HOST}', 2), '') AS path FROM pages),
  best AS (SELECT u.host, u.path, arg_max({{'rule': r.host || r.path, 'verdict': r.verdict}}, length(r.host || r.path)) AS best
    FROM (SELECT DISTINCT host, path FROM urls) u JOIN rules r
      ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY ALL)
SELECT page_id, urls.host, urls.path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM urls LEFT JOIN best ON urls.host = best.host AND urls.path = best.path"""


#: The table of the crc32 of one byte, from its rule, and the crc32 of a text's UTF-8 bytes.
_CRC_TABLE = """crc AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"""


def _crc32(text: str) -> str:
    code = f"hex(encode({text}))"
    given = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr({code}, (2 * i + 1)::INT, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {given}), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])))"


_LOWERED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _level_sql(name: str, leaves: str, levels: int) -> str:
    """Trees over ``leaves`` (grp, pos, n, digest, folded, proof, rows of one leaf repeat): level by level nodes and each leaf's way up."""
    steps = [f"{name}0 AS (SELECT grp, pos AS idx, n, digest FROM {leaves}), {name}w0 AS (SELECT grp, pos, pos AS idx, n, folded, proof FROM {leaves})"]
    for i in range(levels):
        steps.append(f"""{name}s{i} AS (SELECT grp, idx, n,
      coalesce(string_agg(digest, '' ORDER BY idx) OVER (PARTITION BY grp, idx // 8 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
      coalesce(string_agg(digest, '' ORDER BY idx) OVER (PARTITION BY grp, idx // 8 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{i}),
  {name}{i + 1} AS (SELECT grp, idx // 8 AS idx, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY idx)) END AS digest
      FROM {name}{i} GROUP BY grp, idx // 8, n),
  {name}w{i + 1} AS (SELECT w.grp, w.pos, w.idx // 8 AS idx, (w.n + 7) // 8 AS n, CASE WHEN w.n = 1 THEN folded ELSE sha256(l || folded || r) END AS folded,
      CASE WHEN w.n = 1 THEN proof ELSE proof || l || r END AS proof FROM {name}w{i} w JOIN {name}s{i} s ON w.grp = s.grp AND w.idx = s.idx)""")
    return ",\n  ".join(steps)


def merkle_sql(documents: str = "documents", levels: int = 7) -> str:
    """For groups of at most 8^levels rows."""
    def leaf(text: str) -> str:
        fields = [f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(fields)})"

    return f"""WITH {_CRC_TABLE},
  leaves AS (SELECT doc_id, coalesce('=' || lang, '-') AS grp, {leaf("text")} AS digest,
      CASE WHEN {_crc32("doc_id::VARCHAR")} % 3 = 0 THEN {leaf(_LOWERED.format("text"))} END AS altered FROM {documents}, crc),
  placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n,
      coalesce(altered, digest) AS folded, '' AS proof FROM leaves),
  {_level_sql("a", "placed", levels)},
  groups AS MATERIALIZED (SELECT '' AS grp, grp AS name, digest, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n, '' AS proof, digest AS folded FROM a{levels}),
  {_level_sql("b", "groups", levels)},
  versions AS (SELECT g.grp, g.pos, g.n, g.name, w.pos AS leaf_pos, w.folded, w.proof, g.digest FROM aw{levels} w JOIN groups g ON g.name = w.grp),
  {_way_sql("c", "versions", "bs", levels)}
SELECT p.doc_id, p.digest AS leaf, c.digest AS subroot, b{levels}.digest AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = b{levels}.digest AS verified
FROM placed p JOIN c{levels} c ON c.name = p.grp AND c.leaf_pos = p.pos, b{levels}"""


def _way_sql(name: str, versions: str, siblings: str, levels: int) -> str:
    """Every leaf's way through the tree over the groups, whose siblings are known."""
    steps = [f"{name}0 AS (SELECT *, pos AS idx FROM {versions})"]
    for i in range(levels):
        steps.append(f"""{name}{i + 1} AS (SELECT c.name, c.leaf_pos, c.digest, c.idx // 8 AS idx, (c.n + 7) // 8 AS n,
      CASE WHEN c.n = 1 THEN folded ELSE sha256(l || folded || r) END AS folded, CASE WHEN c.n = 1 THEN proof ELSE proof || l || r END AS proof
      FROM {name}{i} c JOIN {siblings}{i} s ON c.idx = s.idx)""")
    return ",\n  ".join(steps)


def spelling_sql(documents: str = "documents", letters: str = "A-Za-zÀ-ÿ") -> str:
    h = _crc32("id || ':' || run")
    return f"""WITH RECURSIVE {_CRC_TABLE},
  runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, {_LOWERED.format("unnest(regexp_extract_all(text, '[" + letters + "]{7,}'))")} AS run FROM {documents}),
  hashed AS (SELECT run, times, {h} AS h FROM (SELECT id, run, count(*) AS times FROM runs GROUP BY ALL), crc),
  words AS MATERIALIZED (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(times)::BIGINT AS n
    FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND n >= 2),
  gaps AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i::INT) AS front, substr(word, i::INT + 2) AS back FROM words, LATERAL (SELECT unnest(range(length(word))) AS i)),
  near AS MATERIALIZED (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.i = b.i AND a.front = b.front AND a.back = b.back AND a.word <> b.word
    UNION SELECT g.word, g.n, w.word, w.n FROM gaps g JOIN words w ON w.word = g.front || g.back
    UNION SELECT w.word, w.n, g.word, g.n FROM gaps g JOIN words w ON w.word = g.front || g.back),
  best AS (SELECT word, count(*) AS n_near, arg_min({{'w': other, 'n': other_n}}, {{'a': -other_n, 'b': other}}) AS top FROM near GROUP BY word),
  forms AS MATERIALIZED (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN top.n >= 10 * words.n THEN top.w END AS form, CASE WHEN top.n >= 10 * words.n THEN top.n END AS form_n
    FROM words LEFT JOIN best ON words.word = best.word),
  chain AS (SELECT word, word AS root, 0 AS link FROM forms UNION ALL SELECT chain.word, forms.form, link + 1 FROM chain JOIN forms ON chain.root = forms.word WHERE forms.form IS NOT NULL)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(root, link) AS root FROM chain GROUP BY word) r ON r.word = forms.word"""


def all_oracles() -> dict[str, str]:
    return {"op6_url_rules": url_sql(), "op9_source_mix": mix_sql(), "op10_exact_dedup": dedup_sql(), "op12_merkle_manifest": merkle_sql(),
            "op13_spelling_groups": spelling_sql()}
