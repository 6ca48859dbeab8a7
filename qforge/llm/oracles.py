"""DuckDB SQL for the operators that plain SQL can state.

The texts' words come from the same classes the operators use; only A-Z is lower-cased.
"""

from __future__ import annotations

SPACE_WORDS = r"'[^\x20\x09-\x0D]+'"
ALNUM_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Smallest id reachable by links; ``link(a, b)`` holds each link in both directions.
COMPONENT = """reach(id, other) AS (SELECT a, b FROM link UNION SELECT r.id, l.b FROM reach r JOIN link l ON r.other = l.a),
comp AS (SELECT id, min(least(id, other)) AS component FROM reach GROUP BY id)"""

OP1 = f"""WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
{COMPONENT},
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(component, vec_id) AS component_id,
       coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN comp ON comp.id = vec_id"""

OP3 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {SPACE_WORDS}) AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
windows AS (
  SELECT doc_id, i, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS n FROM w
  WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
first_in AS (SELECT s, min(doc_id) AS low FROM windows WHERE n = 13 GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i
  FROM windows JOIN first_in USING (s) WHERE n = 13 AND low < doc_id),
left_words AS (
  SELECT w.doc_id, count(*) AS n_words, count(gone.i) AS n_removed,
         sha256(coalesce(string_agg(word, ' ' ORDER BY w.i) FILTER (WHERE gone.i IS NULL), '')) AS kept_sha256
  FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.i = w.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN left_words ON left_words.doc_id = d.doc_id"""

OP5 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, {SPACE_WORDS}) AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, least(len(ws), 5) AS size FROM d),
windows AS (
  SELECT doc_id, size, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS n FROM w
  WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
shingle AS (SELECT DISTINCT doc_id, s FROM windows WHERE n = size),
sets AS (SELECT doc_id, count(*) AS n, string_agg(s, '|' ORDER BY s) AS whole FROM shingle GROUP BY doc_id),
class AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY whole) AS rep FROM sets),
own AS (SELECT s.doc_id, s.s, c.n FROM shingle s JOIN class c ON c.rep = s.doc_id AND c.doc_id = s.doc_id),
both_have AS (
  SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n + y.n) AS n, count(*) AS shared
  FROM own x JOIN own y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
near AS (SELECT a, b FROM both_have WHERE 100 * shared >= 80 * (n - shared)),
link AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
{COMPONENT}
SELECT d.doc_id, coalesce(class.n, 0) AS n_shingles, coalesce(comp.component, class.rep, d.doc_id) AS component_id
FROM d LEFT JOIN class ON class.doc_id = d.doc_id LEFT JOIN comp ON comp.id = class.rep"""

OP6 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, {ALNUM_WORDS}) AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, {ALNUM_WORDS}) AS ws FROM benchmark),
bw AS (SELECT item_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, least(len(ws), 10) AS size FROM b),
item AS (
  SELECT DISTINCT item_id, size, s FROM (
    SELECT item_id, size, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS n FROM bw
    WINDOW f AS (PARTITION BY item_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) WHERE n = size),
sizes AS (SELECT DISTINCT size FROM item),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
long_windows AS (
  SELECT doc_id, i, list(word) OVER f AS ten FROM w
  WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
found AS (
  SELECT doc_id, i, item.size, item_id
  FROM (SELECT doc_id, i, size, array_to_string(ten[1:size], ' ') AS s FROM long_windows, sizes WHERE len(ten) >= size) x
  JOIN item ON item.size = x.size AND item.s = x.s),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS i FROM found) GROUP BY doc_id),
names AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN names ON names.doc_id = d.doc_id"""

def _op11(rounds: int = 2) -> str:
    """Nearest entries by all distances, ``rounds`` times with new means, then once more."""
    near = """a{t} AS MATERIALIZED (SELECT vec_id, label, part, x, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM (
  SELECT p.*, c.entry, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i])))::BIGINT AS d
  FROM p JOIN c{t} c USING (part)) GROUP BY vec_id, label, part, x)"""
    move = """c{u} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{t} c LEFT JOIN (
  SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (
    SELECT part, entry, i, sum(v)::BIGINT AS s, count(*) AS n FROM (
      SELECT part, entry, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{t}) GROUP BY part, entry, i)
  GROUP BY part, entry) m ON m.part = c.part AND m.entry = c.entry)"""
    steps = [f"{near.format(t=t)},\n{move.format(t=t, u=t + 1)}" for t in range(rounds)]
    return f"""WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, k AS part, list_slice(e, k * (len(e) // 16) + 1, (k + 1) * (len(e) // 16)) AS x FROM v, range(16) r(k)),
c0 AS MATERIALIZED (SELECT part, entry, x FROM (
  SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < 64),
{", ".join(steps)},
{near.format(t=rounds)},
w AS (SELECT vec_id, label, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256 FROM w"""


#: CRC-32 of the ASCII text ``s``, bit by bit.
CRC32 = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, len(s) + 1), lambda k: ascii(s[k])::UBIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
    lambda v, z: xor(v >> 1, 3988292384::UBIGINT * (v & 1::UBIGINT)))), 4294967295::UBIGINT)"""


def _op13(levels: int = 9, top: int = 5) -> str:
    """Trees of up to 8 ** levels leaves under a top tree of up to 8 ** top languages; a finished tree stays as it is."""
    def h(text: str) -> str:
        one = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
        return "sha256(" + " || ".join(one.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def level(name: str, below: str, key: str) -> str:
        return f"""{name} AS MATERIALIZED (SELECT {key}, i // 8 AS i, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN string_agg(h, '' ORDER BY i) END AS body,
  CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {below} GROUP BY {key}, i // 8, n)"""

    def climb(name: str, below: str, runs: str, key: str) -> str:
        left, right = "substr(body, 1, (64 * (p.pos % 8))::BIGINT)", "substr(body, (64 * (p.pos % 8) + 65)::BIGINT)"
        return f"""{name} AS MATERIALIZED (SELECT p.* REPLACE (p.pos // 8 AS pos,
    CASE WHEN body IS NULL THEN p.acc ELSE sha256({left} || p.acc || {right}) END AS acc,
    CASE WHEN body IS NULL THEN p.proof ELSE p.proof || {left} || {right} END AS proof)
  FROM {below} p JOIN {runs} r ON r.{key} = p.{key} AND r.i = p.pos // 8)"""
    folded = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [f"d AS MATERIALIZED (SELECT doc_id, coalesce('L' || lang, '') AS tree, 0 AS one, {h('text')} AS leaf, {h(folded)} AS low, doc_id::VARCHAR AS s FROM documents)",
            f"l0 AS MATERIALIZED (SELECT doc_id, tree, one, leaf AS h, CASE WHEN {CRC32} % 3 = 0 THEN low ELSE leaf END AS claim, "
            "row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d)"]
    ctes += [level(f"l{k}", f"l{k - 1}", "tree") for k in range(1, levels + 1)]
    ctes += [f"t0 AS MATERIALIZED (SELECT 0 AS one, tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM l{levels})"]
    ctes += [level(f"t{k}", f"t{k - 1}", "one") for k in range(1, top + 1)]
    ctes += ["p0 AS (SELECT doc_id, tree, one, h AS leaf, i AS pos, claim AS acc, '' AS proof FROM l0)"]
    ctes += [climb(f"p{k}", f"p{k - 1}", f"l{k}", "tree") for k in range(1, levels + 1)]
    ctes += [f"q0 AS (SELECT p.* REPLACE (t0.i AS pos), t0.h AS subroot FROM p{levels} p JOIN t0 ON t0.tree = p.tree)"]
    ctes += [climb(f"q{k}", f"q{k - 1}", f"t{k}", "one") for k in range(1, top + 1)]
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = h AS verified FROM q{top} q, t{top} t"""


ORACLE = {"op1_lattice_hashing": OP1, "op3_phrase_automata": OP3, "op5_token_group_matrix": OP5, "op6_winnowing": OP6,
          "op11_adaptive_bounds": _op11(), "op13_sibling_shift": _op13()}
