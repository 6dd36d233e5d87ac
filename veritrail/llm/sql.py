"""SQL of the queries that SQL can express, by plain comparison of all rows."""

_BLANK = "' ' || chr(9)"
_DIGEST = f"nullif(trim(regexp_replace(lower(trim(sha256, {_BLANK})), '^[a-z0-9_-]+\\s*[:=]\\s*', ''), {_BLANK}), '')"
_SPLIT = f"""CASE WHEN lower(trim(original_split, {_BLANK})) IN ('train', 'training') THEN 'train'
WHEN lower(trim(original_split, {_BLANK})) IN ('val', 'valid', 'validation', 'dev') THEN 'val'
WHEN lower(trim(original_split, {_BLANK})) IN ('test', 'testing', 'holdout') THEN 'test' END"""
_PAIRS = f"""r AS (SELECT DISTINCT external_record_id AS id, source_id, {_SPLIT} AS split, {_DIGEST} AS digest, phash FROM external_manifest),
pairs AS (SELECT DISTINCT t.id AS train_id, e.id AS eval_id FROM r t JOIN r e ON t.split = 'train' AND e.split <> 'train' AND t.id <> e.id
AND (t.digest = e.digest OR bit_count(xor(t.phash, e.phash)) <= 6))"""

P1_FOUND = f"WITH {_PAIRS} SELECT DISTINCT least(train_id, eval_id) AS record_a, greatest(train_id, eval_id) AS record_b FROM pairs"

P1_BY_SPLIT = f"""WITH {_PAIRS}, e AS (SELECT DISTINCT id AS eval_id, split, source_id FROM r WHERE split <> 'train' AND id IS NOT NULL),
n AS (SELECT eval_id, count(*) AS pairs FROM pairs GROUP BY eval_id)
SELECT split, source_id, count(*) AS records, count(pairs) AS overlapping, CAST(coalesce(sum(pairs), 0) AS BIGINT) AS pairs
FROM e LEFT JOIN n USING (eval_id) GROUP BY split, source_id"""

P1_TRAIN_KEPT = f"WITH {_PAIRS} SELECT DISTINCT id AS external_record_id FROM r WHERE split = 'train' AND id IS NOT NULL AND id NOT IN (SELECT train_id FROM pairs)"

_LINK = "CASE WHEN lower(trim({0}, ' ' || chr(9))) NOT IN ('', 'na', 'n/a', 'unknown', '-') THEN lower(trim({0}, ' ' || chr(9))) END"

P5_FOUND = f"""WITH RECURSIVE m AS (SELECT record_id, {_LINK.format("package_id")} AS p, {_LINK.format("sequence_id")} AS s,
lower(trim(split, {_BLANK})) AS split FROM manifest WHERE record_id IS NOT NULL),
k AS (SELECT DISTINCT record_id, 'p' || p AS k FROM m WHERE p IS NOT NULL UNION SELECT DISTINCT record_id, 's' || s FROM m WHERE s IS NOT NULL
UNION SELECT DISTINCT record_id, 'r' || record_id FROM m),
links AS (SELECT DISTINCT a.k AS a, b.k AS b FROM k a JOIN k b USING (record_id)),
reach(k, o) AS (SELECT DISTINCT k, k FROM k UNION SELECT l.b, r.o FROM reach r JOIN links l ON l.a = r.k),
root AS (SELECT k, min(o) AS root FROM reach GROUP BY k),
g AS (SELECT DISTINCT record_id, root FROM k JOIN root USING (k)),
torn AS (SELECT root FROM g JOIN m USING (record_id) WHERE split IN ('train', 'val', 'test') GROUP BY root HAVING count(DISTINCT split) > 1)
SELECT record_id, min(record_id) OVER (PARTITION BY root) AS group_id FROM g WHERE root IN (SELECT root FROM torn)"""

P6_FOUND = f"""WITH b AS (SELECT batch_id, lower(trim(batch_id, {_BLANK})) AS b, received_at FROM manifest_batches),
q AS (SELECT DISTINCT record_id, {_DIGEST} AS digest, phash FROM quality_report),
m AS (SELECT DISTINCT record_id, b.batch_id, received_at, digest, phash FROM manifest
JOIN b ON b.b = lower(trim(manifest.batch_id, {_BLANK})) LEFT JOIN q USING (record_id) WHERE record_id IS NOT NULL)
SELECT DISTINCT x.batch_id, x.record_id FROM m x WHERE EXISTS (SELECT 1 FROM m y WHERE y.received_at < x.received_at
AND (y.record_id = x.record_id OR y.digest = x.digest OR bit_count(xor(y.phash, x.phash)) <= 6))"""

P7_DECODED = "SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, sha256(coalesce(text, '')) AS digest FROM documents"
