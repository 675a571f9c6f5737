"""Longer SQL that corpus queries are checked with."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(value: str) -> str:
    return f"coalesce(concat(octet_length(encode(CAST({value} AS VARCHAR))), ':', CAST({value} AS VARCHAR)), '-')"


def _leaf(text: str) -> str:
    return "sha256(concat(" + ", ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + "))"


# CRC-32 bit by bit: every byte enters and seven steps of zero follow
_CRC = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda s, b: xor(xor(s, b) >> 1, 3988292384 * (xor(s, b) & 1))), 4294967295)"""
_GROWN = """SELECT tree, h + 1, i // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY i)) FROM {0} WHERE n > 1 GROUP BY tree, h, i // 8, n"""

MERKLE_SQL = f"""
    WITH RECURSIVE base AS (SELECT row_number() OVER () AS r, doc_id, lang, {_leaf('text')} AS leaf,
        CASE WHEN {_CRC} % 3 = 0 THEN {_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS changed FROM documents),
      langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM base)),
      ranked AS MATERIALIZED (SELECT r, base.doc_id, tree, leaf, coalesce(changed, leaf) AS own,
        row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n
        FROM base JOIN langs ON base.lang IS NOT DISTINCT FROM langs.lang),
      node AS (SELECT tree, 0 AS h, i, n, leaf AS d FROM ranked UNION ALL {_GROWN.format('node')}),
      subs AS MATERIALIZED (SELECT tree, d AS subroot FROM node WHERE n = 1),
      crown AS (SELECT -1 AS tree, 0 AS h, tree AS i, (SELECT count(*) FROM subs) AS n, subroot AS d FROM subs
        UNION ALL {_GROWN.format('crown')}),
      runs AS MATERIALIZED (SELECT tree, h, i // 8 AS b, list(d ORDER BY i) AS ds FROM (FROM node UNION ALL FROM crown) GROUP BY ALL),
      fold AS (SELECT r, tree, tree AS of, 0 AS h, i, n, own, '' AS proof FROM ranked
        UNION ALL
        SELECT r, CASE WHEN fold.n = 1 THEN -1 ELSE fold.tree END, of, CASE WHEN fold.n = 1 THEN 0 ELSE fold.h + 1 END,
          CASE WHEN fold.n = 1 THEN of ELSE i // 8 END, CASE WHEN fold.n = 1 THEN (SELECT count(*) FROM subs) ELSE (n + 7) // 8 END,
          CASE WHEN fold.n = 1 THEN own ELSE sha256(concat(array_to_string(ds[1:i % 8], ''), own, array_to_string(ds[i % 8 + 2:], ''))) END,
          CASE WHEN fold.n = 1 THEN proof ELSE concat(proof, array_to_string(ds[1:i % 8], ''), array_to_string(ds[i % 8 + 2:], '')) END
        FROM fold LEFT JOIN runs ON runs.tree = fold.tree AND runs.h = fold.h AND runs.b = fold.i // 8
        WHERE NOT (fold.tree = -1 AND fold.n = 1))
    SELECT doc_id, leaf, subroot, (SELECT d FROM crown WHERE n = 1) AS root, sha256(proof) AS proof_sha256, fold.own AS folded_root,
      fold.own = (SELECT d FROM crown WHERE n = 1) AS verified
    FROM ranked JOIN subs USING (tree) JOIN fold ON fold.r = ranked.r AND fold.tree = -1 AND fold.n = 1"""


def _round(books: str, name: str) -> str:
    """Assignments to the entries of `books`: part p of row r goes to entry e at distance d."""
    return f"""{name} AS MATERIALIZED (SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT r, parts.p, {books}.e,
        list_sum(list_transform(list_zip(parts.v, {books}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM parts JOIN {books} ON parts.p = {books}.p) GROUP BY r, p)"""


def _moved(books: str, found: str, name: str) -> str:
    """Entries after a round; floor of sums over counts, unused entries as they were."""
    return f"""{name} AS MATERIALIZED (SELECT {books}.p, {books}.e, coalesce(m.v, {books}.v) AS v FROM {books} LEFT JOIN (
        SELECT p, e, list(m ORDER BY k) AS v FROM (SELECT p, e, k, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
          FROM (SELECT f.p, f.e, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM {found} f JOIN parts USING (r, p)) GROUP BY p, e, k)
        GROUP BY p, e) m ON m.p = {books}.p AND m.e = {books}.e)"""


_STEPS = ",\n      ".join(s for t in range(4) for s in (_round(f"b{t}", f"a{t}"), _moved(f"b{t}", f"a{t}", f"b{t + 1}")))
VECTOR_CODES_SQL = f"""
    WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, row_number() OVER (ORDER BY vec_id) - 1 AS e, vec_id, label,
        list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      parts AS MATERIALIZED (SELECT r, e, p, w[p * len(w) // 4 + 1:(p + 1) * len(w) // 4] AS v FROM kept, range(4) AS q(p)),
      b0 AS MATERIALIZED (SELECT p, e, v FROM parts WHERE e < 256),
      {_STEPS},
      {_round('b4', 'last')},
      coded AS (SELECT r, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY r)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
      (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b4) AS codebooks_sha256
    FROM kept JOIN coded USING (r)"""
