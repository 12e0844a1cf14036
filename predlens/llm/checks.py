"""Check SQL of the queries whose rows SQL can give."""

from __future__ import annotations

from predlens.llm.hashing import RANGE, sql_ticket

#: CRC-32 of every text: the table of the reversed polynomial by rule, then one step per byte.
CRC_SQL = """
  bits AS (SELECT i AS byte, list_reduce(list_concat([i], range(8)),
      lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS value FROM range(256) t(i)),
  crc_table AS (SELECT list(value ORDER BY byte) AS tab FROM bits),
  texts AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
  hexes AS (SELECT text, hex(encode(text)) AS digits FROM texts),
  crcs AS (SELECT text, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(length(digits) // 2),
      lambda i: CAST('0x' || substr(digits, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
      lambda c, b: xor(c >> 8, tab[CAST((xor(c, b) & 255) + 1 AS BIGINT)]))) AS crc FROM hexes, crc_table)"""


def _draw(name: str, weight: float) -> str:
    return f"ln(({sql_ticket('doc_id', repr(name))} + 0.5) / {float(RANGE)!r}) / {weight}"


def _largest(names: list[str], weight: float, values: list[str]) -> str:
    return f"list_max([{', '.join(f'struct_pack(d := {_draw(n, weight)}, i := {v})' for n, v in zip(names, values))}]).i"


def _eight_shards() -> str:
    """Two regions of two racks of two shards."""
    racks = [_largest([f"s{2 * k}", f"s{2 * k + 1}"], 1.0, sorted([str(2 * k), str(2 * k + 1)])) for k in range(4)]
    regions = [f"CASE {_largest([f'k{2 * r}', f'k{2 * r + 1}'], 2.0, ['0', '1'])} WHEN 0 THEN {racks[2 * r]} ELSE {racks[2 * r + 1]} END" for r in range(2)]
    return f"CASE {_largest(['r0', 'r1'], 4.0, ['0', '1'])} WHEN 0 THEN {regions[0]} ELSE {regions[1]} END"


SHARD_SQL = f"""
WITH {CRC_SQL},
  placed AS (SELECT doc_id, text, {_eight_shards()} AS shard,
    greatest({_draw('r0', 4.0)}, {_draw('r1', 4.0)}) < {_draw('grown8', 1.0)} AS moves FROM documents),
  sized AS (SELECT doc_id, COALESCE(strlen(placed.text), 0) + 1 AS size, crc AS text_crc32, shard, moves
    FROM placed LEFT JOIN crcs ON placed.text = crcs.text)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32 NULLS FIRST, size) - 1 AS slot,
  CASE WHEN moves THEN 8 ELSE shard END AS grown_shard FROM sized"""

MIX_SQL = f"""
WITH {CRC_SQL},
  sized AS (SELECT doc_id, source, crc AS text_crc32,
      COALESCE(len(regexp_extract_all(documents.text, '[^\\x20\\x09-\\x0D]+')), 0) AS size
    FROM documents LEFT JOIN crcs ON documents.text = crcs.text),
  sources AS (SELECT source, SUM(size) AS source_size FROM sized GROUP BY source),
  ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sources),
  weighed AS (SELECT *, [5, 2, 1][(rank % 3) + 1] AS weight FROM ranked),
  shares AS (SELECT *, (SUM(source_size) OVER () - 3 * COALESCE(SUM(source_size) OVER (ORDER BY source_size / weight, rank
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / SUM(weight) OVER (ORDER BY source_size / weight, rank
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM weighed),
  targets AS (SELECT source, source_size, rank, least(CAST(source_size * 3 AS DOUBLE), weight * COALESCE(
      (SELECT MAX(share) FROM shares WHERE share * weight <= 3 * source_size), 0.0)) AS target FROM shares),
  queue AS (SELECT doc_id, size, t.source_size, t.rank, t.target, COALESCE(SUM(size) OVER (PARTITION BY t.rank
      ORDER BY {sql_ticket('doc_id', 'size', 'text_crc32')}, doc_id NULLS FIRST, size, text_crc32
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM sized JOIN targets t ON sized.source IS NOT DISTINCT FROM t.source),
  copies AS (SELECT *, (copy * source_size + before + size) / target AS finish FROM queue, range(3) c(copy) WHERE size > 0 AND target > 0),
  taken AS (SELECT *, SUM(size) OVER (ORDER BY finish, rank, before, copy ROWS UNBOUNDED PRECEDING)
      <= (SELECT SUM(size) FROM sized) OR finish <= 1 AS took FROM copies),
  sums AS (SELECT rank, before, size, SUM(CASE WHEN took THEN size ELSE 0 END) AS taken, MIN(finish) AS finish FROM taken GROUP BY ALL)
SELECT q.doc_id, q.size, CAST(q.source_size AS BIGINT) AS source_size, q.target, CAST(COALESCE(s.taken, 0) AS BIGINT) AS taken,
  round(s.finish, 9) AS finish
FROM queue q LEFT JOIN sums s ON q.rank = s.rank AND q.before = s.before AND q.size = s.size"""

#: The smallest id reachable from each node of ``pairs`` (a, b).
_REACHED = """
  both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
  reached AS (SELECT DISTINCT a AS node, a AS other FROM both_ways
    UNION SELECT r.node, w.b FROM reached r JOIN both_ways w ON w.a = r.other),
  least AS (SELECT node, MIN(other) AS component FROM reached GROUP BY node)"""

VECTOR_SQL = f"""
WITH RECURSIVE sound AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  pairs AS (SELECT l.vec_id AS a, r.vec_id AS b FROM sound l JOIN sound r ON l.vec_id < r.vec_id
    WHERE list_cosine_similarity(l.v, r.v) >= 0.9),{_REACHED},
  links AS (SELECT a, COUNT(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, COALESCE(n, 0) AS n_links, COALESCE(component, vec_id) AS component_id, vec_id = COALESCE(component, vec_id) AS kept
FROM embeddings LEFT JOIN links ON a = vec_id LEFT JOIN least ON node = vec_id"""

TOP_K_SQL = """
WITH whole AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  scored AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.row <> c.row WHERE q.vec_id % 20 = 0),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""

JACCARD_SQL = f"""
WITH RECURSIVE split AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
  classes AS (SELECT text, MIN(doc_id) AS id, COUNT(*) AS copies, ANY_VALUE(w) AS w FROM split WHERE len(w) > 0 GROUP BY text),
  grams AS (SELECT id, copies, list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END) AS g FROM classes),
  sizes AS (SELECT id, copies, len(g) AS size FROM grams),
  flat AS (SELECT id, unnest(g) AS gram FROM grams),
  common AS (SELECT l.id AS a, r.id AS b, COUNT(*) AS n FROM flat l JOIN flat r ON l.gram = r.gram AND l.id < r.id GROUP BY ALL),
  pairs AS (SELECT a, b FROM common JOIN sizes s ON s.id = a JOIN sizes t ON t.id = b WHERE n >= 0.8 * (s.size + t.size - n)),{_REACHED},
  links AS (SELECT a, SUM(copies) AS n FROM both_ways JOIN sizes ON id = b GROUP BY a)
SELECT doc_id, COALESCE(c.id, doc_id) AS class_id, CAST(COALESCE(n, 0) + COALESCE(copies - 1, 0) AS BIGINT) AS n_links,
  COALESCE(component, c.id, doc_id) AS component_id, doc_id = COALESCE(component, c.id, doc_id) AS kept
FROM split LEFT JOIN classes c ON split.text = c.text LEFT JOIN links ON a = c.id LEFT JOIN least ON node = c.id"""
