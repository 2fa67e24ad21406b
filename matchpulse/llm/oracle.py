"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from matchpulse.llm.chat_format import CLOSE, CONTROLS, OPEN, TRAINED

LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _words(table: str, key: str) -> str:
    text = LOWERED.format("coalesce(text, '')")
    return f"SELECT {key}, regexp_extract_all({text}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"


OP1 = f"""
WITH d AS ({_words("documents", "doc_id")}),
b AS ({_words("benchmark", "item_id")}),
bw AS (
  SELECT item_id, least(10, len(w)) AS n,
         unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i : i + least(10, len(w)) - 1], ' '))) AS words
  FROM b WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n
),
hits AS (
  SELECT DISTINCT s.doc_id, s.i, s.n, bw.item_id
  FROM (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS words FROM dw) s JOIN bw ON s.words = bw.words AND s.n = bw.n
),
places AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS place FROM hits),
n_hit AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

def _escaped(column: str, line_break: bool = False) -> str:
    """A text whose backslashes are doubled and whose control strings are broken, as in ``chat_format``."""
    out = rf"replace({column}, '\', '\\')"
    for control in CONTROLS:
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return f"replace({out}, chr(10), '\\' || chr(10))" if line_break else out


OP5 = f"""
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
),
t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, coalesce(role = '{TRAINED}', false) AS trained,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns
),
e AS (
  SELECT *, sum({len(OPEN) + 1 + len(CLOSE)} + length({_escaped("role", True)}) + length({_escaped("text")})) OVER (PARTITION BY conv_id ORDER BY i) AS prefix FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (trained), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (trained), '')) AS loss_sha256,
       CAST(sum(prefix) FILTER (trained OR i = n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP6 = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
),
k AS (SELECT doc_id, i, line, {LOWERED.format(f"trim(line, {SPACE})")} AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, i, line, f.key IS NOT NULL AND k.doc_id <> f.last AS dropped FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP9 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha256(coalesce(html, '')) AS digest FROM pages
),
o AS (
  SELECT *, CASE WHEN octet_length(encode(payload)) >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS original FROM p
)
SELECT page_id, octet_length(encode(payload)) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM o
"""

#: Unsigned crc32 of a column as text, bit by bit.
CRC32 = """xor(list_reduce(
  list_transform(string_split(CAST({} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
  lambda held, c: list_reduce(range(0, 8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(held, c)), 4294967295), 4294967295)"""


def _field(column: str) -> str:
    return f"coalesce(octet_length(encode(CAST({column} AS VARCHAR))) || ':' || CAST({column} AS VARCHAR), '-')"


def _tree_levels(first: str, name: str, count: int) -> str:
    """CTEs of the levels over ``first`` (tree, number, size, digest): nodes with the digests before and after them in their runs."""
    out = []
    for i in range(count):
        below = first if i == 0 else f"{name}_up{i - 1}"
        run = "OVER (PARTITION BY tree, number // 8 ORDER BY number ROWS BETWEEN"
        out.append(f"""{name}{i} AS (
  SELECT *, coalesce(string_agg(digest, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(digest, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {below}
)""")
        out.append(f"""{name}_up{i} AS (
  SELECT tree, number // 8 AS number, (size + 7) // 8 AS size, CASE WHEN size = 1 THEN digest ELSE sha256(digest || after) END AS digest
  FROM {name}{i} WHERE number % 8 = 0
)""")
    return ",\n".join(out)


def _climb(first: str, name: str, count: int) -> str:
    """CTEs that lead rows (tree, number, siblings, folded) up the levels of ``name``: siblings joined, digests folded."""
    out = []
    for i in range(count):
        below = first if i == 0 else f"{name}_way{i - 1}"
        out.append(f"""{name}_way{i} AS (
  SELECT w.* EXCLUDE (number, siblings, folded), w.number // 8 AS number,
         CASE WHEN n.size > 1 THEN siblings || before || after ELSE siblings END AS siblings,
         CASE WHEN n.size > 1 THEN sha256(before || folded || after) ELSE folded END AS folded
  FROM {below} w JOIN {name}{i} n USING (tree, number)
)""")
    return ",\n".join(out)


def _merkle(low: int = 7, high: int = 2) -> str:
    """Levels enough for 8^7 documents a language and 8^2 languages."""
    fields = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "text")))
    lowered = fields.replace(_field("text"), _field(LOWERED.format("text")))
    return f"""
WITH leaf AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS tree, sha256({fields}) AS leaf,
         CASE WHEN {CRC32.format("doc_id")} % 3 = 0 THEN sha256({lowered}) ELSE sha256({fields}) END AS folded, '' AS siblings
  FROM documents
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS number, count(*) OVER (PARTITION BY tree) AS size FROM leaf
),
first AS (SELECT tree, number, size, leaf AS digest FROM numbered),
{_tree_levels("first", "low", low)},
subroots AS (
  SELECT tree AS branch, digest AS subroot, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS number, count(*) OVER () AS size FROM low_up{low - 1}
),
tops AS (SELECT tree, number, size, subroot AS digest FROM subroots),
{_tree_levels("tops", "high", high)},
start AS (SELECT doc_id, leaf, tree, number, siblings, folded FROM numbered),
{_climb("start", "low", low)},
again AS (
  SELECT doc_id, leaf, subroot, s.tree, s.number, siblings, folded FROM low_way{low - 1} w JOIN subroots s ON w.tree = s.branch
),
{_climb("again", "high", high)}
SELECT doc_id, leaf, subroot, digest AS root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = digest AS verified
FROM high_way{high - 1}, high_up{high - 1}
"""


def _terms(table: str, key: str) -> str:
    text = LOWERED.format("coalesce(text, '')")
    return f"SELECT {key} AS id, unnest(regexp_extract_all({text}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM {table}"


OP12 = f"""
WITH seen AS ({_terms("documents", "doc_id")}),
tf AS (SELECT id AS doc_id, term, count(*) AS tf FROM seen GROUP BY ALL),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
totals AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * documents + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, totals GROUP BY term, documents
),
asked AS (SELECT DISTINCT id AS item_id, term FROM ({_terms("benchmark", "item_id")})),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * documents) // terms)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN sizes USING (doc_id), totals
  GROUP BY item_id, doc_id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

ORACLE_SQL: dict[str, str] = {"op1_benchmark_decontamination": OP1, "op5_chat_formatting": OP5, "op6_line_dedup": OP6, "op9_warc_revisits": OP9, "op11_merkle_manifest": _merkle(), "op12_ranked_search": OP12}
