"""The same results in SQL for DuckDB, for operators whose results SQL can express."""

from __future__ import annotations

from .merkle import LOWER, UPPER

_CRC32 = "xor(4294967295, list_reduce({bytes}, lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(c, b)), 4294967295::BIGINT))"
_TREE = """{t} AS (SELECT * FROM {leaves} UNION ALL
  SELECT g, lvl + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (n + 15) // 16 FROM {t} WHERE n > 1 GROUP BY g, lvl, idx // 16, n)"""
_RUNS = "SELECT g, lvl, idx // 16 AS run, list(digest ORDER BY idx) AS run_digests FROM {t} WHERE n > 1 GROUP BY ALL"


def _field(x: str) -> str:
    return f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _path(rows: str, runs: str, shift: int) -> str:
    """For each row (key, g, i): what lies before and after its node in its run, by level."""
    return f"""SELECT key, {shift} + lvl AS step, array_to_string(run_digests[1 : (i >> (4 * lvl)) & 15], '') AS before, array_to_string(run_digests[((i >> (4 * lvl)) & 15) + 2 : 16], '') AS after
  FROM {rows} JOIN {runs} ON {rows}.g = {runs}.g AND i >> (4 * (lvl + 1)) = run"""


MERKLE = f"""WITH RECURSIVE doc AS (SELECT doc_id, coalesce('1' || source, '0') AS g, {_leaf('text')} AS leaf,
  CASE WHEN {_CRC32.format(bytes="list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)")} % 5 = 0 THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, row_number() OVER () AS key, count(*) OVER (PARTITION BY g) AS n FROM doc),
leaves AS (SELECT g, 0 AS lvl, i AS idx, leaf AS digest, n FROM placed), {_TREE.format(t='tree', leaves='leaves')},
sub AS (SELECT g AS name, digest, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
tops AS (SELECT '' AS g, 0 AS lvl, i AS idx, digest, n FROM sub), {_TREE.format(t='top', leaves='tops')},
runs AS ({_RUNS.format(t='tree')}), top_runs AS ({_RUNS.format(t='top')}), high AS (SELECT key, '' AS g, sub.i AS i FROM placed JOIN sub ON g = name),
path AS ({_path('placed', 'runs', 0)} UNION ALL {_path('high', 'top_runs', 100)}),
whole AS (SELECT key, sha256(string_agg(before || after, '' ORDER BY step)) AS proof, list(before || '|' || after ORDER BY step) AS steps FROM path GROUP BY key),
folded AS (SELECT doc_id, leaf, sub.digest AS subroot, (SELECT digest FROM top WHERE n = 1) AS root, coalesce(proof, sha256('')) AS proof_sha256,
  list_reduce(list_prepend(coalesce(changed, leaf), coalesce(steps, [])), lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded_root
  FROM placed JOIN sub ON g = name LEFT JOIN whole USING (key))
SELECT *, folded_root = root AS verified FROM folded"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), '{u}', '{l}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_BYTES = "list_transform(range(0, octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)"
RESAMPLE = f"""WITH word AS (SELECT doc_id, {_WORDS.format(u=UPPER, l=LOWER)} AS w FROM documents), wanted AS (SELECT {_WORDS.format(u=UPPER, l=LOWER)} AS w FROM benchmark),
doc AS (SELECT doc_id, len(w) AS n_words, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS features FROM word),
own AS (SELECT doc_id, unnest(features) AS f FROM doc), other AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM wanted),
hashed AS (SELECT f, {_CRC32.format(bytes=_BYTES)} % 10000 AS bucket FROM (SELECT f FROM own UNION SELECT f FROM other)),
s AS (SELECT bucket, count(*) AS k FROM own JOIN hashed USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS k FROM other JOIN hashed USING (f) GROUP BY bucket),
gain AS (SELECT b.bucket, floor(1000 * ln(((coalesce(t.k, 0) + 1) * (SELECT coalesce(sum(k), 0) + 10000 FROM s))::DOUBLE / ((coalesce(s.k, 0) + 1) * (SELECT coalesce(sum(k), 0) + 10000 FROM t))::DOUBLE))::BIGINT AS gain
  FROM (SELECT DISTINCT bucket FROM hashed) b LEFT JOIN s ON s.bucket = b.bucket LEFT JOIN t ON t.bucket = b.bucket),
summed AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS g FROM own JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, n_words, len(features) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (g - ((g % n) + n) % n) // n END::BIGINT AS weight,
  floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise FROM doc LEFT JOIN summed USING (doc_id)),
placed AS (SELECT doc_id, n_features, weight, weight + noise AS score, n_words >= 20 AS can, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + noise DESC, doc_id) AS place, 25 * count(*) FILTER (WHERE n_words >= 20) OVER () // 100 AS most FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN can AND place <= most THEN place END AS rank FROM placed"""
