"""DuckDB SQL with the rows of the catalog's queries, written apart from them."""

from __future__ import annotations

from ..operators.chunking import AVERAGE, EASY, HARD, LEAST, MOST, gear
from .catalog import FORGOTTEN, PACK_TARGET, SMALL

LOW48 = (1 << 48) - 1


def _cdc() -> str:
    """CTEs up to chunks(doc_id, source, seq, offset, length, chunk_id): one step a byte, modulo 2^48."""
    values = ", ".join(f"('{b:02X}', {int(g) & LOW48})" for b, g in enumerate(gear()))
    return f"""
WITH RECURSIVE g(b, g) AS (VALUES {values}),
d AS (SELECT doc_id, source, hex(encode(text)) AS hx, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents),
big AS (SELECT * FROM d WHERE n > {LEAST}),
byt AS (SELECT doc_id, n, i, g.g FROM (SELECT doc_id, n, hx, unnest(range({LEAST}, n)) AS i FROM big) x JOIN g ON g.b = substr(hx, 2 * i + 1, 2)),
step(doc_id, s, i, fp, cut) AS (
  SELECT doc_id, CAST(0 AS BIGINT), CAST({LEAST} AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT) FROM big
  UNION ALL
  SELECT doc_id, CASE WHEN hit THEN i + 1 ELSE s END, CASE WHEN hit THEN i + 1 + {LEAST} ELSE i + 1 END, CASE WHEN hit THEN 0 ELSE f END, CASE WHEN hit THEN i + 1 END
  FROM (SELECT *, (f & (CASE WHEN i < s + least({AVERAGE}, n - s) THEN {HARD} ELSE {EASY} END)) = 0 OR i - s + 1 = {MOST} AS hit
        FROM (SELECT t.doc_id, s, t.i, n, (fp * 2 + g) & {LOW48} AS f FROM step t JOIN byt USING (doc_id, i)))),
ends AS (SELECT doc_id, cut AS e FROM step WHERE cut IS NOT NULL UNION SELECT doc_id, n FROM d WHERE n > 0),
spans AS (SELECT doc_id, e, coalesce(lag(e) OVER w, 0) AS o, row_number() OVER w - 1 AS seq FROM ends WINDOW w AS (PARTITION BY doc_id ORDER BY e)),
chunks AS (
  SELECT doc_id, source, CAST(seq AS INT) AS seq, o AS "offset", CAST(e - o AS INT) AS length, sha256(from_hex(substr(hx, 2 * o + 1, 2 * (e - o)))) AS chunk_id
  FROM spans JOIN d USING (doc_id))
"""


def _cdc_small() -> str:
    """All documents by the small sizes: one step a chunk, whose bytes are folded one by one."""
    p = SMALL
    hit = f"((a.f * 2 + x.f) & {LOW48})"
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, hx, n, list_transform(range(n), lambda i: CAST({[int(g) & LOW48 for g in gear()]} AS BIGINT[])[CAST('0x' || substr(hx, 2 * i + 1, 2) AS INT) + 1]) AS gs
  FROM (SELECT doc_id, hex(encode(text)) AS hx, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents WHERE text <> '')),
step(doc_id, seq, s, e) AS (
  SELECT doc_id, -1, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM d
  UNION ALL
  SELECT doc_id, seq + 1, t.e, CASE WHEN n - t.e <= {p.least} THEN n ELSE
    (SELECT CASE WHEN r.cut >= 0 THEN r.cut ELSE least(n, t.e + {p.most}) END FROM (SELECT list_reduce(
      list_prepend({{'f': CAST(0 AS BIGINT), 'i': t.e, 'cut': CAST(-1 AS BIGINT)}},
        list_transform(range(t.e + {p.least}, least(n, t.e + {p.most})), lambda i: {{'f': gs[i + 1], 'i': i, 'cut': CAST(-1 AS BIGINT)}})),
      lambda a, x: CASE WHEN a.cut >= 0 THEN a ELSE {{'f': {hit}, 'i': x.i, 'cut': CASE WHEN {hit} & (CASE WHEN x.i < t.e + least({p.average}, n - t.e) THEN {p.hard} ELSE {p.easy} END) = 0 THEN x.i + 1 ELSE -1 END}} END) AS r)) END
  FROM step t JOIN d USING (doc_id) WHERE t.e < n)
SELECT doc_id, CAST(seq AS INT) AS seq, s AS "offset", CAST(e - s AS INT) AS length, sha256(from_hex(substr(hx, 2 * s + 1, 2 * (e - s)))) AS chunk_id
FROM step JOIN d USING (doc_id) WHERE seq >= 0
"""


WHOLE = """
whole AS (SELECT doc_id, source, sha256(text) AS chunk_id, CAST(octet_length(encode(text)) AS BIGINT) AS length FROM documents WHERE text <> '')"""
PACKED = f"""
WITH RECURSIVE {WHOLE.strip()},
stored AS (SELECT chunk_id, min(doc_id) AS first_doc, max(length) AS length FROM whole GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY first_doc) AS r FROM stored),
f(r, pack_no, size) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(5 AS BIGINT)
  UNION ALL
  SELECT o.r, CASE WHEN size >= {PACK_TARGET} THEN pack_no + 1 ELSE pack_no END, CASE WHEN size >= {PACK_TARGET} THEN 5 ELSE size END + 36 + o.length
  FROM f JOIN o ON o.r = f.r + 1),
packed AS (SELECT chunk_id, first_doc, pack_no, size - length AS "offset", length FROM f JOIN o USING (r)),
named AS (SELECT pack_no, sha256(string_agg(chunk_id, '' ORDER BY first_doc)) AS pack_id FROM packed GROUP BY 1),
located AS (SELECT chunk_id, pack_id, "offset", length FROM packed JOIN named USING (pack_no)),
blobs AS (SELECT pack_id, 'packs/' || pack_id || '.pack' AS name, max("offset" + length) AS size FROM located GROUP BY 1),
runs AS (
  SELECT substr(sha256(source), 1, 16) AS id, CAST(max(doc_id) AS DOUBLE) AS created, source AS source_path, count(*) AS files,
    CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes_read FROM documents GROUP BY source),
kept_runs AS (SELECT * FROM runs WHERE id NOT IN (SELECT id FROM runs ORDER BY created, id LIMIT {FORGOTTEN})),
live AS (SELECT DISTINCT chunk_id FROM whole WHERE source IN (SELECT source_path FROM kept_runs)),
kept AS (SELECT * FROM located WHERE chunk_id IN (SELECT chunk_id FROM live)),
latest AS (SELECT DISTINCT chunk_id FROM whole WHERE source = (SELECT source_path FROM runs ORDER BY created DESC, id DESC LIMIT 1)),
known AS (SELECT * FROM located WHERE pack_id IN (SELECT pack_id FROM located WHERE chunk_id IN (SELECT chunk_id FROM latest))),
short AS (SELECT pack_id, CAST(floor(size * 9 / 10) AS BIGINT) AS size FROM blobs)
"""
LIVE_DEAD = """
, ld AS (SELECT pack_id, count(*) FILTER (chunk_id IN (SELECT chunk_id FROM live)) AS live, count(*) FILTER (chunk_id NOT IN (SELECT chunk_id FROM live)) AS dead,
  CAST(sum(CASE WHEN chunk_id IN (SELECT chunk_id FROM live) THEN length ELSE 0 END) AS BIGINT) AS live_bytes FROM {entries} GROUP BY 1)"""
PLAN = """
, acted AS (SELECT pack_id, live, dead, live_bytes, size, CASE WHEN dead = 0 THEN 'keep' WHEN live = 0 THEN 'delete'
  WHEN dead / (live + dead) < 0.2 THEN 'defer' ELSE 'repack' END AS action FROM ld LEFT JOIN blobs USING (pack_id)
  UNION ALL
  SELECT pack_id, 0, 0, 0, size, CASE WHEN pack_id IN (SELECT pack_id FROM located WHERE chunk_id IN (SELECT chunk_id FROM live)
    AND chunk_id NOT IN (SELECT chunk_id FROM {entries})) THEN 'adopt' ELSE 'delete_orphan' END FROM blobs WHERE pack_id NOT IN (SELECT pack_id FROM ld)),
planned AS (SELECT pack_id, live, dead, size, action,
  CAST(CASE WHEN action IN ('delete', 'repack', 'delete_orphan') THEN size ELSE 0 END AS BIGINT) AS reclaimed,
  CAST(CASE WHEN action IN ('delete', 'delete_orphan') THEN size WHEN action = 'repack' THEN size - live_bytes - 36 * live - 5 ELSE 0 END AS BIGINT) AS net FROM acted)
"""
TREE = """
WITH leaf AS (
  SELECT r_name, n_name, c_name AS name, c_name || '|' || c_mktsegment AS content, sha256(c_name || '|' || c_mktsegment) AS h
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
n1 AS (
  SELECT r_name, n_name, '{"entries":[' || coalesce(string_agg('{"chunks":["' || h || '"],"file_hash":"' || h || '","meta":{"size":' ||
    octet_length(encode(content)) || ',"type":"file"},"name":"' || name || '"}', ',' ORDER BY name), '') || '],"v":1}' AS p
  FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN leaf USING (r_name, n_name) GROUP BY 1, 2),
n2 AS (
  SELECT r_name, '{"entries":[' || coalesce(string_agg('{"meta":{"type":"dir"},"name":"' || n_name || '","tree":"' || sha256(p) || '"}', ',' ORDER BY n_name), '') || '],"v":1}' AS p
  FROM region LEFT JOIN n1 USING (r_name) GROUP BY 1),
n3 AS (SELECT '{"entries":[' || string_agg('{"meta":{"type":"dir"},"name":"' || r_name || '","tree":"' || sha256(p) || '"}', ',' ORDER BY r_name) || '],"v":1}' AS p FROM n2)
"""
DAMAGED = """
, judged AS (SELECT id, CASE WHEN right(id, 1) IN ('0', '1', '2', '3') THEN 'NODE_MISSING' WHEN right(id, 1) IN ('4', '5') THEN 'BAD_NODE' ELSE 'OK' END AS st
  FROM (SELECT sha256(p) AS id FROM n1 UNION SELECT sha256(p) FROM n2)),
regions AS (SELECT r_name, id, st FROM n2 JOIN judged ON id = sha256(p)),
nations AS (SELECT n1.r_name, n_name, j.id, j.st FROM n1 JOIN judged j ON j.id = sha256(p) JOIN regions r ON r.r_name = n1.r_name WHERE r.st = 'OK')
"""
#: After _cdc(): the documents as files, their folders, and the last source.
FILES = """
, f AS (SELECT doc_id, source, concat_ws('/', source, CAST(doc_id AS VARCHAR)) AS path, coalesce(text, '') AS t, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size FROM documents),
dirs AS (SELECT DISTINCT source AS path FROM documents WHERE source IS NOT NULL),
newest AS (SELECT max(source) AS s FROM documents),
kept_chunks AS (SELECT DISTINCT chunk_id FROM chunks WHERE source < (FROM newest)),
more_chunks AS (SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id NOT IN (FROM kept_chunks))
"""
PATH = "regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"

ORACLES = {
    "chunk_identity": "SELECT doc_id, sha256(text) AS chunk_id FROM documents",
    "hex_ids": """SELECT doc_id, lower(hex(unhex(sha256(text)))) AS read_back, CAST(octet_length(unhex(sha256(text))) AS BIGINT) AS bytes, regexp_full_match(sha256(text), '[0-9a-f]{64}') AS own,
        regexp_full_match(upper(sha256(text)), '[0-9a-f]{64}') AS upper_case, regexp_full_match(coalesce(source, ''), '[0-9a-f]{64}') AS other FROM documents WHERE text IS NOT NULL""",
    "index_remove": PACKED + "SELECT * FROM located WHERE chunk_id NOT IN (SELECT chunk_id FROM live)",
    "small_file_chunks": f"""SELECT doc_id, CAST(0 AS INT) AS seq, CAST(0 AS BIGINT) AS "offset", CAST(octet_length(encode(text)) AS INT) AS length, sha256(text) AS chunk_id
        FROM documents WHERE octet_length(encode(text)) BETWEEN 1 AND {LEAST}""",
    "cdc_chunks": _cdc() + 'SELECT doc_id, seq, "offset", length, chunk_id FROM chunks',
    "cdc_chunks_small": _cdc_small(),
    "dedup_report": _cdc() + """SELECT source, CAST(sum(n) AS BIGINT) AS chunks, count(*) AS unique_chunks, CAST(sum(n * length) AS BIGINT) AS bytes, CAST(sum(length) AS BIGINT) AS unique_bytes
        FROM (SELECT source, chunk_id, count(*) AS n, max(length) AS length FROM chunks GROUP BY 1, 2) GROUP BY 1""",
    "new_chunks_per_run": f"""WITH {WHOLE}, first AS (SELECT chunk_id, min(source) AS source, max(length) AS length FROM whole GROUP BY 1),
        n AS (SELECT source, count(f.chunk_id) AS new_chunks, CAST(coalesce(sum(f.length), 0) AS BIGINT) AS new_bytes FROM (SELECT DISTINCT source FROM whole) LEFT JOIN first f USING (source) GROUP BY 1)
        SELECT *, CAST(sum(new_bytes) OVER (ORDER BY source) AS BIGINT) AS stored_bytes FROM n""",
    "dedup_hits": f"""WITH {WHOLE} SELECT doc_id, source, f AS first_source FROM (SELECT *, min(source) OVER (PARTITION BY chunk_id) AS f FROM whole) WHERE f < source""",
    "fresh_chunks": f"""WITH {WHOLE} SELECT chunk_id, min(doc_id) AS doc_id, max(length) AS length FROM whole WHERE source = (SELECT max(source) FROM whole)
        AND chunk_id NOT IN (SELECT chunk_id FROM whole WHERE source < (SELECT max(source) FROM whole)) GROUP BY 1""",
    "chunk_offsets": """SELECT conv_id, turn, CAST(coalesce(sum(length) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", length
        FROM (SELECT conv_id, turn, CAST(octet_length(encode(text)) AS BIGINT) AS length FROM conversations)""",
    "file_hash": "SELECT conv_id, sha256(string_agg(text, '' ORDER BY turn)) AS file_hash FROM conversations GROUP BY 1",
    "pack_assignment": PACKED + 'SELECT chunk_id, pack_no, "offset", length FROM packed',
    "pack_directory": PACKED + 'SELECT pack_id, count(*) AS entries, CAST(sum(length) AS BIGINT) AS blob_bytes, max("offset" + length) AS size FROM located GROUP BY 1',
    "index_last_wins": f"WITH {WHOLE} SELECT chunk_id, doc_id AS batch, source AS pack_id, length FROM whole QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY doc_id DESC) = 1",
    "locate": PACKED + 'SELECT doc_id, pack_id, l."offset", l.length FROM whole w LEFT JOIN located l USING (chunk_id)',
    "exclude_glob": f"""SELECT page_id, path, regexp_full_match(path, '/de/.*') OR regexp_full_match(path, '.*/8.') OR regexp_full_match(base, '[1-3]..') OR regexp_full_match(base, '[^0-5].*') OR regexp_full_match(path, '[^0-5].*') AS matched
        FROM (SELECT page_id, path, regexp_extract(path, '([^/]*)$', 1) AS base FROM (SELECT page_id, {PATH} AS path FROM pages))""",
    "tree_nodes": TREE + "SELECT DISTINCT sha256(p) AS node_id, CAST(octet_length(encode(p)) AS BIGINT) AS bytes FROM (SELECT p FROM n1 UNION ALL SELECT p FROM n2 UNION ALL SELECT p FROM n3)",
    "walk_paths": """WITH RECURSIVE kids(parent, child, name, type) AS (
          SELECT '', 'r' || r_regionkey, r_name, 'dir' FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, n_name, 'dir' FROM nation
          UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, c_name, 'file' FROM customer),
        w(node, path, depth, type) AS (SELECT child, name, CAST(1 AS BIGINT), type FROM kids WHERE parent = '' UNION ALL SELECT child, path || '/' || name, depth + 1, kids.type FROM w JOIN kids ON parent = node)
        SELECT path, depth, type, 'OK' AS status FROM w""",
    "navigate_path": TREE + "SELECT name, CAST(octet_length(encode(content)) AS BIGINT) AS size, h AS file_hash FROM leaf ORDER BY r_name || '/' || n_name || '/' || name LIMIT 1",
    "reachable_ids": TREE + """, top AS (SELECT r_name FROM region ORDER BY r_name LIMIT 2)
        SELECT sha256(p) AS id FROM n2 WHERE r_name IN (FROM top) UNION SELECT sha256(p) FROM n1 WHERE r_name IN (FROM top) UNION SELECT h FROM leaf WHERE r_name IN (FROM top)""",
    "snapshot_list": PACKED + "SELECT * FROM runs ORDER BY created, id",
    "snapshot_latest": PACKED + "SELECT * FROM runs ORDER BY created DESC, id DESC LIMIT 1",
    "resolve_prefix": PACKED + """SELECT ref, count(id) AS n, CASE WHEN count(id) = 0 THEN 'not_found' WHEN count(id) > 1 THEN 'ambiguous' ELSE 'ok' END AS status, CASE WHEN count(id) = 1 THEN min(id) END AS id
        FROM (SELECT lower(to_hex(i)) AS ref FROM range(16) t(i)) LEFT JOIN runs ON starts_with(id, ref) GROUP BY 1""",
    "forget": PACKED + "SELECT * FROM kept_runs",
    "gc_live_dead": PACKED + LIVE_DEAD.format(entries="located") + "SELECT * FROM ld",
    "gc_plan": PACKED + LIVE_DEAD.format(entries="located") + PLAN.format(entries="located") + "SELECT * FROM planned",
    "gc_orphans": PACKED + LIVE_DEAD.format(entries="known") + PLAN.format(entries="known") + "SELECT * FROM planned",
    "gc_stats": PACKED + LIVE_DEAD.format(entries="located") + PLAN.format(entries="located") + """SELECT CAST(sum(live) AS BIGINT) AS chunks_live, CAST(sum(dead) AS BIGINT) AS chunks_dead,
        count(*) FILTER (action = 'keep') AS packs_keep, count(*) FILTER (action = 'delete') AS packs_delete, count(*) FILTER (action = 'defer') AS packs_defer, count(*) FILTER (action = 'repack') AS packs_repack,
        count(*) FILTER (action = 'adopt') AS packs_adopt, count(*) FILTER (action = 'delete_orphan') AS packs_delete_orphan, CAST(sum(reclaimed) AS BIGINT) AS bytes_reclaimed, CAST(sum(net) AS BIGINT) AS bytes_net FROM planned""",
    "check_missing": PACKED + "SELECT DISTINCT chunk_id FROM whole WHERE chunk_id NOT IN (SELECT chunk_id FROM kept)",
    "check_orphans": PACKED + "SELECT * FROM blobs WHERE pack_id NOT IN (SELECT pack_id FROM known)",
    "check_geometry": PACKED + 'SELECT l.chunk_id, l.pack_id, l."offset", l.length, s.size FROM located l JOIN short s USING (pack_id) WHERE "offset" + length > size',
    "check_missing_packs": PACKED + "SELECT pack_id, count(*) AS chunks FROM located WHERE pack_id NOT IN (SELECT pack_id FROM known) GROUP BY 1",
    "check_report": PACKED + """, c AS (SELECT (SELECT count(DISTINCT chunk_id) FROM whole) AS chunks_referenced, (SELECT count(DISTINCT chunk_id) FROM whole WHERE chunk_id NOT IN (SELECT chunk_id FROM kept)) AS chunks_missing,
        (SELECT count(*) FROM kept) AS chunks_indexed, (SELECT count(DISTINCT pack_id) FROM kept WHERE pack_id LIKE '0%') AS packs_missing,
        (SELECT count(*) FROM kept JOIN short USING (pack_id) WHERE "offset" + length > size AND pack_id NOT LIKE '0%') AS bad_geometry,
        (SELECT count(*) FROM blobs WHERE pack_id NOT IN (SELECT pack_id FROM kept) AND pack_id NOT LIKE '0%') AS packs_orphaned)
        SELECT *, chunks_missing = 0 AND packs_missing = 0 AND bad_geometry = 0 AS ok FROM c""",
    "aead_roundtrip": f"WITH {WHOLE} SELECT doc_id, chunk_id, CAST(28 AS BIGINT) AS overhead, true AS other_aad_fails FROM whole",
    "frame_roundtrip": "SELECT doc_id, sha256(text) AS chunk_id, true AS bounded FROM documents",
    "deep_check": f"""WITH {WHOLE} SELECT DISTINCT chunk_id, kind, status FROM whole, (VALUES ('good', 'OK'), ('other_aad', 'CORRUPT_AEAD'), ('truncated', 'CORRUPT_AEAD'),
        ('bad_frame', 'BAD_FRAME'), ('other_content', 'CORRUPT_HASH'), ('absent', 'BLOB_MISSING')) v(kind, status)""",
    "check_nodes": TREE + DAMAGED + "SELECT DISTINCT id AS node_id, st AS status FROM (SELECT id, st FROM regions UNION ALL SELECT id, st FROM nations) WHERE st <> 'OK'",
    "range_reads": f"WITH {WHOLE} SELECT DISTINCT chunk_id, chunk_id AS read_id, true AS beyond_is_null FROM whole",
    "restore_report": TREE + DAMAGED + """, files AS (SELECT h, octet_length(encode(content)) AS n, right(h, 1) IN ('6', '7') AS bad FROM leaf JOIN nations USING (r_name, n_name) WHERE st = 'OK')
        SELECT (SELECT count(*) FROM files WHERE NOT bad) AS files, (SELECT count(*) FROM regions) + (SELECT count(*) FROM nations) AS dirs, CAST(0 AS BIGINT) AS symlinks,
        (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM files WHERE NOT bad) AS bytes,
        (SELECT count(*) FROM files WHERE bad) + (SELECT count(*) FROM regions WHERE st <> 'OK') + (SELECT count(*) FROM nations WHERE st <> 'OK') AS failed, CAST(0 AS BIGINT) AS warnings""",
    "rebuild_index": PACKED + """SELECT chunk_id, "offset", length, 'OK' AS status FROM packed""",
    "restore_file": "SELECT conv_id, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, sha256(string_agg(text, '' ORDER BY turn)) AS file_hash, 'OK' AS status FROM conversations GROUP BY 1",
    "restore_tree": TREE + "SELECT r_name || '/' || n_name || '/' || name AS path, content, 'OK' AS status FROM leaf",
    "scan_report": """SELECT count(*) FILTER (ok AND lang <> 'es') AS files, (SELECT count(DISTINCT source) FROM documents) AS dirs, count(*) FILTER (ok AND lang = 'es') AS symlinks,
        CAST(coalesce(sum(octet_length(encode(text))) FILTER (ok AND lang <> 'es'), 0) AS BIGINT) AS bytes_read, count(*) FILTER (NOT ok) AS skipped
        FROM (SELECT text, coalesce(lang, '') AS lang, coalesce(n_chars, 0) >= 100 AS ok FROM documents)""",
    "blob_names": f"""SELECT page_id, b <> '' AND NOT starts_with(b, '/') AND NOT list_contains(string_split(b, '/'), '..') AS blob, e NOT IN ('', '.', '..') AS entry, sha256(path) AS pack_id, true AS "foreign"
        FROM (SELECT page_id, path, substr(path, 2) AS b, regexp_extract(path, '([^/]*)$', 1) AS e FROM (SELECT page_id, {PATH} AS path FROM pages))""",
    "backup_snapshots": _cdc() + FILES + """SELECT 1 AS n, 'OK' AS status, count(*) AS files, (SELECT count(*) FROM dirs WHERE path < (FROM newest)) AS dirs, CAST(0 AS BIGINT) AS symlinks,
        CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes_read, (SELECT count(*) FROM kept_chunks) AS chunks_new, CAST(0 AS BIGINT) AS skipped FROM f WHERE source < (FROM newest)
        UNION ALL SELECT 2, 'OK', count(*), (SELECT count(*) FROM dirs), 0, CAST(coalesce(sum(size), 0) AS BIGINT), (SELECT count(*) FROM more_chunks), 0 FROM f""",
    "restore_cycle": _cdc() + FILES + """SELECT path, CAST(CASE WHEN source IS NULL THEN 1 ELSE 2 END AS INT) AS depth, 'file' AS type, size, sha256(t) AS file_hash, size AS bytes, 'OK' AS status FROM f
        UNION ALL SELECT path, 1, 'dir', 0, NULL, 0, 'OK' FROM dirs""",
    "restore_path": _cdc() + FILES + "SELECT path, 'file' AS type, size AS bytes, 'OK' AS status FROM f WHERE source = (FROM newest) UNION ALL SELECT s, 'dir', 0, 'OK' FROM newest",
    "restore_damaged": _cdc() + FILES + """, faulty AS (SELECT doc_id, min_by(CASE WHEN chunk_id LIKE '0%' THEN 'CHUNK_MISSING' ELSE 'CORRUPT_AEAD' END, seq) AS st FROM chunks WHERE left(chunk_id, 1) IN ('0', '1') GROUP BY 1)
        SELECT path, 'file' AS type, CASE WHEN st IS NULL THEN size ELSE 0 END AS bytes, coalesce(st, 'OK') AS status FROM f LEFT JOIN faulty USING (doc_id) UNION ALL SELECT path, 'dir', 0, 'OK' FROM dirs""",
    "prune_cycle": _cdc() + FILES + """, k AS (SELECT count(*) AS n FROM kept_chunks)
        SELECT n AS chunks_live, (SELECT count(*) FROM more_chunks) AS chunks_dead, CAST(0 AS BIGINT) AS packs_defer, CAST(0 AS BIGINT) AS packs_adopt, CAST(0 AS BIGINT) AS packs_delete_orphan, n AS chunks_referenced,
        CAST(0 AS BIGINT) AS chunks_missing, n AS chunks_indexed, CAST(0 AS BIGINT) AS packs_orphaned, 1 + (SELECT count(*) FROM dirs WHERE path < (FROM newest)) AS nodes_checked, CAST(0 AS BIGINT) AS chunks_corrupt,
        true AS ok, CAST(1 AS BIGINT) AS snapshots, n AS rebuilt FROM k""",
    "scan_folder": _cdc() + FILES + """, wanted AS (SELECT * FROM f WHERE coalesce(source, '') <> 'src1' AND NOT ends_with(coalesce(source, ''), '7') AND NOT ends_with(path, '7'))
        SELECT path, 'file' AS type, CAST(NULL AS INT) AS seq, size, sha256(t) AS id, CAST(NULL AS VARCHAR) AS reason FROM wanted
        UNION ALL SELECT path, 'piece', seq, length, chunk_id, NULL FROM wanted JOIN chunks USING (doc_id)
        UNION ALL SELECT path, 'dir', NULL, 0, NULL, NULL FROM dirs WHERE path <> 'src1' AND NOT ends_with(path, '7')""",
}
