"""DuckDB SQL for the queries that SQL can express: 1, 2, 4, 5, 6 and 11."""

from __future__ import annotations

from workload.crc_sql import CRC_TABLE, crc32

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP1 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1:i + n], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, n, array_to_string(w[i + 1:i + n], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
met AS (SELECT dw.*, item_id FROM dw JOIN win USING (n, win)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM met) GROUP BY r),
items AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM met GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""

#: ends: all places at which a group ends, with 0. The largest of them up to a place, the smallest from one on.
_UPTO = "list_max(list_filter(ends, lambda e: e <= {}))"
_FROM = "list_min(list_filter(ends, lambda e: e >= {}))"

OP2 = f"""WITH RECURSIVE {CRC_TABLE},
d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT + 1 AS size, {crc32("hex(encode(text))")} AS text_crc32, coalesce(md5(text), '') AS key,
  substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 4) AS part FROM documents, crc_table),
g AS (SELECT key, (sum(s) OVER (ORDER BY key))::BIGINT AS upto, s::BIGINT AS s FROM (SELECT key, sum(size) AS s FROM d GROUP BY key)),
line AS (SELECT list_sort(list_prepend(0::BIGINT, list(upto))) AS ends, max(upto) AS total FROM g),
search AS (SELECT greatest(0, ceil(total / 16)::BIGINT - 1) AS low, total AS high FROM line
  UNION ALL SELECT CASE WHEN fits THEN low ELSE middle END, CASE WHEN fits THEN middle ELSE high END FROM (
    SELECT low, high, middle, list_reduce(list_prepend(0::BIGINT, range(0, 16)), lambda a, j: {_UPTO.format("a + middle")}) >= total AS fits
    FROM (SELECT *, (low + high) // 2 AS middle FROM search, line WHERE high - low > 1))),
best AS (SELECT min(high) AS capacity FROM search),
floors AS (SELECT 0 AS j, total AS f FROM line
  UNION ALL SELECT j + 1, {_FROM.format("greatest(0, f - capacity)")} FROM floors, line, best WHERE j < 16),
cuts AS (SELECT 16 AS left_, 0::BIGINT AS place
  UNION ALL SELECT left_ - 1, CASE WHEN step > place THEN step ELSE {_FROM.format("least(total, place + 1)")} END FROM (
    SELECT left_, place, ends, total, {_UPTO.format("greatest(place + ceil((total - place) / left_)::BIGINT, f)")} AS step
    FROM cuts, line, floors WHERE left_ > 1 AND j = left_ - 1)),
cut_at AS (SELECT list(DISTINCT place) AS borders FROM cuts, line WHERE left_ < 16 AND place < total),
placed AS (SELECT d.*, coalesce(len(list_filter(borders, lambda c: c <= upto - s)), 0)::INTEGER AS shard FROM d JOIN g USING (key), cut_at)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY part, key, doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard FROM placed"""

#: Brute force: all pairs, then the smallest row that links lead to.
OP4 = """WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT r, vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS x, b.r AS y FROM u a JOIN u b ON len(a.e) = len(b.e) AND a.r <> b.r
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least AS (SELECT x, min(vec_id) AS least FROM reach JOIN v ON v.r = reach.y GROUP BY x),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id,
  vec_id <= coalesce(least, vec_id) AS kept FROM v LEFT JOIN least ON least.x = v.r LEFT JOIN n ON n.x = v.r"""

_BLANK = r"[^\x20\x09-\x0D]+"

OP5 = rf"""WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) AS r, doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
every AS (SELECT r, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS line_no FROM d),
worded AS (SELECT *, len(regexp_extract_all(line, '{_BLANK}')) AS n, regexp_replace(line, '[\x20\x09-\x0D]+$', '') AS t FROM every),
l AS (SELECT *, row_number() OVER w - 1 AS k, sum(n) OVER w AS upto FROM worded WHERE n > 0 WINDOW w AS (PARTITION BY r ORDER BY line_no)),
forth AS (SELECT a.r, a.k, min(b.k) AS e FROM l a JOIN l b ON a.r = b.r AND b.k BETWEEN a.k AND a.k + 9 AND b.upto - a.upto + a.n >= 10 GROUP BY ALL),
back AS (SELECT a.r, max(b.k) AS k, a.k AS e FROM l a JOIN l b ON a.r = b.r AND b.k BETWEEN a.k - 9 AND a.k AND a.upto - b.upto + b.n >= 10 GROUP BY a.r, a.k),
runs AS (SELECT * FROM forth UNION SELECT * FROM back),
texts AS (SELECT runs.r, runs.k, e, string_agg(t, chr(10) ORDER BY l.k) AS run FROM runs JOIN l ON l.r = runs.r AND l.k BETWEEN runs.k AND e GROUP BY ALL),
later AS (SELECT * FROM texts QUALIFY row_number() OVER (PARTITION BY run ORDER BY r, k) > 1),
gone AS (SELECT DISTINCT l.r, line_no, n FROM later JOIN l ON l.r = later.r AND l.k BETWEEN later.k AND e),
sums AS (SELECT r, count(*) AS n_deleted, sum(n) AS words, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS lines FROM gone GROUP BY r),
kept AS (SELECT r, string_agg(line, chr(10) ORDER BY line_no) AS kept FROM every ANTI JOIN gone USING (r, line_no) GROUP BY r)
SELECT doc_id, coalesce(len(parts), 0)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted, coalesce(words, 0)::BIGINT AS n_deleted_words,
  coalesce(lines, '') AS deleted_lines, strlen(coalesce(kept, ''))::BIGINT AS kept_bytes, md5(coalesce(kept, '')) AS kept_md5
FROM d LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)"""

OP6 = rf"""WITH d AS (SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '{_BLANK}') AS w FROM documents),
rows AS (SELECT doc_id, source, len(w)::BIGINT AS size, pow(
    (('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), coalesce(md5(text), ''), '1')), 1, 13))::BIGINT + 0.5) / pow(16, 13),
    1 / (0.5::DOUBLE + CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0 END)) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM rows GROUP BY source),
filled AS (SELECT *, 3 * source_size AS cap, (SELECT sum(source_size) FROM s)::BIGINT - coalesce(sum(3 * source_size) OVER before, 0)::BIGINT AS left_size,
  sum(weight) OVER rest AS left_weight FROM s
  WINDOW before AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    rest AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (SELECT left_size, left_weight FROM filled WHERE cap * left_weight > left_size * weight ORDER BY left_weight DESC LIMIT 1),
aims AS (SELECT source, source_size, CASE WHEN cap * f.left_weight <= f.left_size * weight THEN cap::DOUBLE
    ELSE (l.left_size * weight)::BIGINT / l.left_weight::BIGINT END AS target FROM filled f LEFT JOIN level l ON true),
shares AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM aims),
keys AS (SELECT source, key, sum(size)::BIGINT AS tied FROM rows GROUP BY source, key),
summed AS (SELECT *, sum(tied) OVER (PARTITION BY source ORDER BY key DESC) AS upto FROM keys)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN target - epochs * source_size > 0
    AND 2 * upto - tied < 2 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rows JOIN shares ON rows.source IS NOT DISTINCT FROM shares.source
  JOIN summed ON rows.source IS NOT DISTINCT FROM summed.source AND rows.key = summed.key"""

OP11 = rf"""WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
dw AS (SELECT r, unnest(w) AS word FROM d),
bw AS (SELECT unnest(regexp_extract_all({_LOWER}, {_WORD})) AS word FROM benchmark),
codes AS (SELECT word, {crc32("hex(encode(word))")} % 10000 AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc_table),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN codes USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN codes USING (word) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE)
    / ((s + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
sums AS (SELECT r, sum(gain)::HUGEINT AS gain, count(*) AS n FROM dw JOIN codes USING (word) JOIN gains USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(floor(gain / n), 0)::BIGINT AS weight,
    ('0x' || substr(sha256(concat('2024:', doc_id)), 1, 8))::BIGINT AS h FROM d LEFT JOIN sums USING (r)),
final AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS rank FROM final WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM ranked) THEN rank END AS rank FROM final LEFT JOIN ranked USING (r)"""

SQL = {"op1_decontamination": OP1, "op2_sharding": OP2, "op4_cap_filters": OP4, "op5_line_runs": OP5, "op6_mixing": OP6, "op11_resampling": OP11}
