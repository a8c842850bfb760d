"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from seqspark.llm import licenses


def _seats(items: str, within: str, item: str) -> str:
    """Highest quotients votes / (2k + 1) over the columns votes, seats and cap of a table."""
    keys = ", ".join(x for x in (within, item) if x)
    part = f"PARTITION BY {within}" if within else ""
    on = " AND ".join(f"a.{x.strip()} = b.{x.strip()}" for x in keys.split(","))
    return f"""(
      SELECT a.*, coalesce(b.won, 0) AS quota FROM {items} a LEFT JOIN (
        SELECT {keys}, count(*) AS won FROM (
          SELECT *, row_number() OVER ({part} ORDER BY votes / (2 * k + 1) DESC, {item}, k) AS rank FROM (
            SELECT *, unnest(range(0, least(cap, (seats * votes / greatest(total, 1))::BIGINT
                + ceil(n * votes / greatest(total, 1))::BIGINT + 3))) AS k
            FROM (SELECT *, sum(votes) OVER ({part}) AS total, count(*) OVER ({part}) AS n FROM {items}) WHERE votes > 0)
        ) WHERE rank <= seats GROUP BY {keys}
      ) b ON {on})"""


OP10 = rf"""
WITH ids AS (
  SELECT doc_id, source, md5('17:' || coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, '')))) AS key,
    md5(coalesce(text, '')) AS digest, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
sizes AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS ord FROM
    (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM ids GROUP BY source)),
ranked AS (
  SELECT *, ((ord - 1) % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap, 3 * source_size / ((ord - 1) % 3 + 1) AS ratio FROM sizes),
levels AS (
  SELECT *, (sum(source_size) OVER () - sum(cap) OVER (ORDER BY ratio, ord) + cap)::DOUBLE
    / (sum(weight) OVER () - sum(weight) OVER (ORDER BY ratio, ord) + weight)::DOUBLE AS level FROM ranked),
level AS (SELECT level AS final, ratio AS r, ord AS o FROM levels WHERE level * weight <= cap ORDER BY ratio, ord LIMIT 1),
targets AS (
  SELECT source, ord, source_size, n_docs, CASE WHEN o IS NULL OR ratio < r OR (ratio = r AND ord < o) THEN cap::DOUBLE
    ELSE final * weight END AS target FROM levels LEFT JOIN level ON true),
seated AS (
  SELECT source, source_size, ord, target, target AS votes, floor(3 * source_size / 32)::BIGINT AS cap, ceil(n_docs / 20000)::BIGINT AS n_shards,
    floor(sum(source_size) OVER () / 32 + 0.5)::BIGINT AS seats FROM targets),
sources AS (SELECT * FROM {_seats("seated", "", "ord")}),
placed AS (
  SELECT i.*, s.ord, s.source_size, s.target, s.quota AS blocks, ('0x' || substr(key, 1, 15))::BIGINT % n_shards AS shard
  FROM ids i JOIN sources s ON i.source IS NOT DISTINCT FROM s.source),
streams AS (
  SELECT ord, shard, sum(size)::BIGINT AS votes, floor(3 * sum(size) / 32)::BIGINT AS cap, any_value(blocks) AS seats FROM placed GROUP BY ord, shard),
shards AS (
  SELECT *, votes AS words, ('0x' || substr(md5('17:' || ord || ':' || shard), 1, 15))::BIGINT % greatest(votes, 1) AS start
  FROM {_seats("streams", "ord", "shard")}),
spans AS (
  SELECT p.*, w.words, w.start, w.quota * 32 AS length, sum(size) OVER (PARTITION BY p.ord, p.shard ORDER BY key, size, digest
    ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM placed p JOIN shards w ON p.ord = w.ord AND p.shard = w.shard),
rounds AS (SELECT *, length // greatest(words, 1) AS n, length % greatest(words, 1) AS rest FROM spans)
SELECT doc_id, size::BIGINT AS size, source_size, target, (CASE WHEN size > 0 THEN n * size
  + greatest(0, least(stop, start + rest) - greatest(stop - size, start))
  + greatest(0, least(stop, start + rest - words) - (stop - size)) ELSE 0 END)::BIGINT AS taken FROM rounds
"""

OP4 = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id, d.doc_id <= coalesce(b, d.doc_id) AS kept
FROM docs d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN least_of l ON d.doc_id = l.a
"""

OP5 = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS run FROM (
    SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
runs AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS run FROM (
    SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n)),
found AS (SELECT r, x.n, i, item_id FROM runs x JOIN windows y ON x.n = y.n AND x.run = y.run),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
held AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM docs LEFT JOIN hits USING (r) LEFT JOIN held USING (r)
"""

OP6 = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS r FROM documents),
lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
runs AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS run FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM docs)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS n FROM runs) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM again) GROUP BY r),
base AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
  FROM docs LEFT JOIN lines USING (r) LEFT JOIN repeats USING (r)),
bits AS (
  SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
    + 8 * (100 * n_dup_lines > 30 * n_lines)::BIGINT + 16 * (word_chars < 3 * n_words)::BIGINT + 32 * (word_chars > 12 * n_words)::BIGINT
    + 64 * (n_words > 100000)::BIGINT + 128 * (2 * n_upper > n_letters)::BIGINT AS failures FROM base)
SELECT *, failures & 3 > 0 AS base_failed, failures & 15 = 0 AS kept FROM bits
"""

OP8 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')),
said AS (
  SELECT *, len(regexp_replace(role, '([<\[])(\\*)(\||s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g'))
    + len(regexp_replace(text, '([<\[])(\\*)(\||s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g')) + len('<|turn|><|text|><|end|>') AS n FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars FROM said GROUP BY conv_id
"""

_TEMPLATES = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(licenses.known_templates()))

OP9 = rf"""
WITH templates AS (SELECT id, license, regexp_extract_all(lower(template), '[\p{{L}}\p{{N}}]+') AS w FROM (VALUES {_TEMPLATES}) AS t(id, license, template)),
wanted AS (
  SELECT DISTINCT id, license, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM templates)),
sizes AS (SELECT id, count(*) AS m FROM wanted GROUP BY id),
reaches AS (SELECT id, CASE WHEN len(w) > 256 THEN len(w) + 256 ELSE 256 END AS reach FROM templates),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
runs AS (SELECT r, doc_id, p, array_to_string(w[p + 1:p + 5], ' ') AS s FROM (SELECT *, unnest(range(0, len(w) - 4)) AS p FROM docs)),
held AS (SELECT r, doc_id, p, id, license, s FROM runs JOIN wanted USING (s)),
windows AS (SELECT DISTINCT r, id, q AS place FROM (SELECT r, id, p, unnest(range(greatest(p - 3, 0), p + 1)) AS q FROM held) WHERE q % 2 = 0),
near AS (
  SELECT h.r, h.doc_id, h.license, place, count(DISTINCT s) / any_value(m) AS containment
  FROM windows x JOIN reaches y ON x.id = y.id JOIN held h ON x.r = h.r AND x.id = h.id AND h.p BETWEEN place - reach AND place + reach JOIN sizes z ON h.id = z.id GROUP BY h.r, h.doc_id, h.license, h.id, place),
lines AS (
  SELECT r, doc_id, n, regexp_extract_all(lower(line), '[\p{{L}}\p{{N}}]+') AS w FROM (
    SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM docs)),
short AS (SELECT r, doc_id, license, -n AS place, 1.0 AS containment FROM lines l JOIN templates t ON l.w = t.w WHERE len(l.w) BETWEEN 1 AND 4)
SELECT doc_id, license, count(DISTINCT place) AS n_places, min(place) FILTER (place >= 0) AS first_word, max(containment) AS containment
FROM (SELECT r, doc_id, license, place, containment FROM near WHERE containment >= 0.8 QUALIFY containment = max(containment) OVER (PARTITION BY r, place) UNION ALL SELECT * FROM short) GROUP BY r, doc_id, license
"""

#: Unsigned crc32 of an id's decimals: the table by its rule, then a byte at a time.
_CRC_TABLE = "(SELECT list(list_reduce(list_concat([b], range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) AS r(b))"


def _crc(text: str) -> str:
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


OP11 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words, {_crc("doc_id::VARCHAR")} AS h
  FROM documents, {_CRC_TABLE} AS table_of(t)),
placed AS (SELECT *, len(words) AS n, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN (h // 10) % len(words) END AS a, (h // 10) % 8 AS m FROM docs),
texts AS MATERIALIZED (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN words ELSE list_transform(range(n), lambda i: words[1 + CASE WHEN i < a THEN i
    ELSE a + (i - a) % (1 + (n - a) // (3 + m)) END]) END AS w FROM placed),
grams AS (SELECT r, i, md5(array_to_string(w[i + 1:i + 16], ' ')) AS g FROM (SELECT r, w, unnest(range(n - 15)) AS i FROM texts WHERE n >= 24)),
pairs AS (SELECT x.r, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.r = y.r AND x.g = y.g AND y.i > x.i),
islands AS (SELECT r, q, min(i) AS s, max(i) + 16 + q AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM pairs) GROUP BY r, q, k),
runs AS (SELECT r, s, e - s AS length, min(q) AS q FROM islands WHERE e - s >= 24 AND e - s >= 3 * q GROUP BY r, s, e),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / q DESC, s, q) = 1),
listed AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM runs GROUP BY r),
gone AS (SELECT r, list(DISTINCT i) AS gone FROM (SELECT r, unnest(range(s + q, s + length)) AS i FROM runs) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, length, q AS period, 1000 * length // q AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(n), lambda i: NOT list_contains(gone, i)), lambda i: w[i + 1]) END, ' ')) AS collapsed_sha256
FROM texts LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN gone USING (r)
"""


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join([*[_field(c) for c in ("doc_id", "source", "lang", "n_chars")], _field(text)]) + ")"


def _climb(name: str, leaves: str) -> str:
    """A recursive table of all nodes (tree, level, place, n of the level, digest) above leaves (tree, place, n, digest)."""
    return f"""{name}(tree, level, place, n, digest) AS (
  SELECT tree, 0, place, n, digest FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, place // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY place)) FROM {name} WHERE n > 1 GROUP BY tree, level, place // 3)"""


def _steps(name: str, nodes: str) -> str:
    """left and right of each node that has a parent."""
    return f"""{name} AS (
  SELECT a.tree, a.level, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
  FROM {nodes} a JOIN {nodes} b ON a.tree = b.tree AND a.level = b.level AND a.place // 3 = b.place // 3 WHERE a.n > 1 GROUP BY ALL)"""


OP12 = rf"""
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce('s' || source, '') AS tree, {_leaf("text")} AS leaf,
    CASE WHEN {_crc("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS claimed
  FROM documents, {_CRC_TABLE} AS table_of(t)),
leaves AS MATERIALIZED (SELECT *, leaf AS digest, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM rows),
{_climb("nodes", "leaves")},
steps AS MATERIALIZED ({_steps("x", "nodes").split("(", 1)[1]},
tops AS MATERIALIZED (SELECT tree AS name, digest, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n, 'all' AS tree FROM nodes WHERE n = 1),
{_climb("above", "tops")},
upper_steps AS MATERIALIZED ({_steps("x", "above").split("(", 1)[1]},
paths AS MATERIALIZED (
  SELECT a.tree, a.place, s.level, l, r FROM leaves a JOIN steps s ON a.tree = s.tree AND s.place = a.place // pow(3, s.level)::BIGINT
  UNION ALL
  SELECT a.tree, a.place, 1000 + s.level, l, r FROM leaves a JOIN tops t ON a.tree = t.name JOIN upper_steps s ON s.place = t.place // pow(3, s.level)::BIGINT),
proofs AS (SELECT tree, place, list(l ORDER BY level) AS ls, list(r ORDER BY level) AS rs FROM paths GROUP BY tree, place),
fold(tree, place, k, digest, ls, rs) AS (
  SELECT tree, place, 0, claimed, coalesce(ls, []), coalesce(rs, []) FROM leaves LEFT JOIN proofs USING (tree, place)
  UNION ALL
  SELECT tree, place, k + 1, sha256(ls[k + 1] || digest || rs[k + 1]), ls, rs FROM fold WHERE k < len(ls))
SELECT a.doc_id, a.leaf, t.digest AS subroot, top.digest AS root, sha256(array_to_string(list_transform(range(len(ls)), lambda i: ls[i + 1] || rs[i + 1]), '')) AS proof_sha256,
  f.digest AS folded_root, f.digest = top.digest AS verified
FROM leaves a JOIN tops t ON a.tree = t.name JOIN fold f ON a.tree = f.tree AND a.place = f.place AND f.k = len(f.ls), (SELECT digest FROM above WHERE n = 1) top
"""

ORACLES = {
    "op4_near_duplicates": OP4,
    "op5_decontaminate": OP5,
    "op6_rule_ledger": OP6,
    "op8_chat_tree": OP8,
    "op9_license_scan": OP9,
    "op10_source_mix": OP10,
    "op11_periodic_runs": OP11,
    "op12_merkle_manifest": OP12,
}
