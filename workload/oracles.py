"""SQL with the same results as the registered queries.

Versions are compared through ``vnum``, the number the version text was made
from, so the SQL shares no version logic with the library.
"""

from __future__ import annotations

from changeledger.functions.paths import CALLBACK_SCRIPTS
from workload.crc_sql import CRC_TABLE, crc32
from workload.dialects import DOLLAR_FORMS, MYSQL_FORMS, ORACLE_FORMS

FRAMES = """
numbered AS (
  SELECT doc_id, source AS target, lang, text, CAST(n_chars AS INTEGER) AS checksum,
    CASE (doc_id // 20) % 10 WHEN 0 THEN 'REPEATABLE' WHEN 9 THEN 'UNDO_SQL' ELSE 'SQL' END AS kind,
    CASE (doc_id // 20) % 10 WHEN 0 THEN NULL WHEN 9 THEN doc_id // 20 - 1 ELSE doc_id // 20 END AS vnum
  FROM documents),
spelled AS (
  SELECT *, CASE vnum % 3 WHEN 0 THEN concat('0', vnum // 10, '.', vnum % 10, '.0')
                          WHEN 1 THEN concat(vnum // 10, '.', vnum % 10, '-RC1')
                          WHEN 2 THEN concat(vnum // 10, '_', vnum % 10) END AS version,
    CASE WHEN vnum IS NOT NULL THEN concat(vnum // 10, '.0', vnum % 10,
      CASE WHEN vnum % 3 = 1 THEN '.rc01' ELSE '' END) END AS spelling2
  FROM numbered),
scripts AS (
  SELECT *, concat(lang, '/', CASE kind WHEN 'REPEATABLE' THEN 'R' WHEN 'UNDO_SQL' THEN 'U' ELSE 'V' END,
      coalesce(version, ''), '__d', doc_id, '.sql') AS script, concat('d', doc_id) AS description
  FROM spelled),
catalog AS (
  SELECT *, coalesce('v' || vnum, 's' || script) AS item
  FROM scripts s
  WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = s.doc_id AND l.toxic = 1)),
ledger0 AS (
  SELECT s.target, CAST(e.event_id + 1 AS INTEGER) AS installed_rank,
    CASE WHEN e.event_id % 2 = 0 THEN s.version ELSE s.spelling2 END AS version, s.vnum, s.description,
    CASE WHEN e.event_type = 'signup' AND e.value > 250 AND s.kind = 'SQL' THEN 'BASELINE'
         WHEN s.kind = 'UNDO_SQL' THEN 'UNDO_SQL' ELSE 'SQL' END AS type,
    s.script, CASE WHEN e.value < 10 THEN s.checksum + 1 ELSE s.checksum END AS checksum,
    'runner' AS installed_by, e.ts AS installed_on, CAST(floor(e.value) AS INTEGER) AS execution_time,
    NOT (e.event_type = 'error' AND s.target IN ('src1', 'src2')) AS success
  FROM events e JOIN scripts s
    ON s.doc_id = (e.user_id * 7 + e.event_id % 5) % (SELECT count(*) FROM documents)),
ledger AS (
  SELECT *, coalesce('v' || vnum, 's' || script) AS item
  FROM ledger0)
"""
LATEST = FRAMES + """,
latest AS (
  SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY target, item ORDER BY installed_rank DESC) = 1),
visible AS (SELECT * FROM catalog WHERE kind <> 'UNDO_SQL')
"""

STATES = LATEST + """,
bounds AS (
  SELECT target, max(a) AS a, max(r) AS r FROM (
    SELECT target, CASE WHEN success AND type <> 'UNDO_SQL' THEN vnum END AS a, NULL AS r FROM latest
    UNION ALL SELECT target, NULL, vnum FROM visible) GROUP BY target),
joined AS (
  SELECT coalesce(c.target, l.target) AS target, c.script AS r_script, l.script AS a_script, c.kind,
    c.version AS r_version, l.version AS a_version, c.vnum AS r_vnum, l.vnum AS a_vnum,
    c.description AS r_description, l.description AS a_description,
    c.checksum AS r_checksum, l.checksum AS a_checksum, l.type, l.success, l.installed_rank,
    l.installed_on, l.execution_time
  FROM visible c FULL JOIN latest l ON c.target = l.target AND c.item = l.item),
view AS (
  SELECT j.*, coalesce(r_script, a_script) AS script, CASE
    WHEN type = 'BASELINE' THEN 'BASELINE' WHEN type = 'UNDO_SQL' THEN 'UNDONE'
    WHEN NOT success THEN 'FAILED'
    WHEN r_script IS NOT NULL AND a_script IS NOT NULL THEN
      CASE WHEN r_vnum IS NULL AND r_checksum IS DISTINCT FROM a_checksum THEN 'OUTDATED' ELSE 'SUCCESS' END
    WHEN r_script IS NOT NULL THEN
      CASE WHEN r_vnum IS NULL OR b.a IS NULL OR r_vnum > b.a THEN 'PENDING' ELSE 'OUT_OF_ORDER' END
    WHEN a_vnum IS NULL OR b.r IS NULL OR a_vnum > b.r THEN 'FUTURE' ELSE 'MISSING' END AS state
  FROM joined j LEFT JOIN bounds b USING (target))
"""

PROBLEMS = STATES + """,
problems AS (
  SELECT target, '2003' AS code, script,
    concat('checksum local=', r_checksum, ' recorded=', a_checksum) AS detail FROM view
  WHERE r_vnum IS NOT NULL AND type <> 'UNDO_SQL' AND r_checksum <> a_checksum
  UNION ALL SELECT target, '2004', script, 'FAILED' FROM view WHERE state = 'FAILED'
  UNION ALL SELECT target, '2003', script, state FROM view WHERE state IN ('MISSING', 'FUTURE'))
"""


def _verdicts(condition: str = "true", strict: bool = False) -> str:
    late = "out_of_order" if strict else "pending"
    return LATEST + f""",
gate AS (
  SELECT target, bool_or(NOT success) AS failed,
    max(CASE WHEN type = 'BASELINE' THEN vnum END) AS floor FROM ledger GROUP BY target),
last AS (
  SELECT * FROM ledger WHERE type <> 'BASELINE'
  QUALIFY row_number() OVER (PARTITION BY target, item ORDER BY installed_rank DESC) = 1),
highest AS (SELECT target, max(vnum) AS highest FROM last WHERE type <> 'UNDO_SQL' GROUP BY target),
verdicts AS (
  SELECT c.*, CASE
    WHEN g.failed THEN 'blocked'
    WHEN c.vnum <= g.floor THEN 'skip_baseline'
    WHEN c.vnum IS NOT NULL AND l.type <> 'UNDO_SQL' THEN 'skip_applied'
    WHEN c.vnum IS NOT NULL AND c.vnum <= h.highest THEN '{late}'
    WHEN c.vnum IS NOT NULL THEN 'pending'
    WHEN l.script IS NULL OR c.checksum IS DISTINCT FROM l.checksum THEN 'pending'
    ELSE 'skip_unchanged' END AS verdict
  FROM visible c LEFT JOIN gate g USING (target) LEFT JOIN highest h USING (target)
    LEFT JOIN last l ON l.target = c.target AND l.item = c.item
  WHERE {condition}),
plan AS (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY vnum IS NULL, vnum,
    CASE WHEN vnum IS NULL THEN description END, script) AS place
  FROM verdicts WHERE verdict = 'pending')
"""


def _split_targets(sql: str) -> str:
    """The same frames with each target cut into targets of ten blocks."""
    return (sql.replace("source AS target", "concat(source, '-', doc_id // 200) AS target")
            .replace("s.target IN", "split_part(s.target, '-', 1) IN"))


SPLIT_PROBLEMS = _split_targets(PROBLEMS)
SPLIT_VERDICTS = _verdicts().removeprefix(LATEST)


def _pending(condition: str) -> str:
    return f"WITH {_verdicts(condition)} SELECT target, script, version FROM plan"


PLAN = _verdicts()

RECORDS = """,
ran AS (
  SELECT p.*, p.checksum % 5 <> 0 AS ok, p.checksum::BIGINT * 1000000 AS elapsed FROM plan p),
stop AS (SELECT target, min(place) AS stopped FROM ran WHERE NOT ok GROUP BY target),
kept AS (
  SELECT r.*, (SELECT max(installed_rank) FROM ledger l WHERE l.target = r.target) AS used
  FROM ran r LEFT JOIN stop s USING (target)
  WHERE (stopped IS NULL OR place <= stopped)
    AND (ok OR CAST(substr(target, 4) AS INTEGER) % 2 <> 0))
SELECT target, CAST(coalesce(used, 0) + row_number() OVER (PARTITION BY target ORDER BY place) AS INTEGER)
    AS installed_rank, version, description,
  CASE kind WHEN 'UNDO_SQL' THEN 'UNDO_SQL' ELSE 'SQL' END AS type, script, checksum,
  'runner' AS installed_by, TIMESTAMP '2024-02-01 00:00:00' AS installed_on,
  CAST(least(elapsed, 2147483647) AS INTEGER) AS execution_time, ok AS success
FROM kept
"""

UNDO = FRAMES + """,
done AS (
  SELECT * FROM ledger WHERE vnum IS NOT NULL AND success AND type <> 'BASELINE'
  QUALIFY row_number() OVER (PARTITION BY target, vnum ORDER BY installed_rank DESC) = 1),
top AS (
  SELECT target, max(vnum) AS vnum, arg_max(version, vnum) AS done_version
  FROM done WHERE type <> 'UNDO_SQL' GROUP BY target),
plan AS (
  SELECT t.target, top.done_version, c.script, c.kind, c.version, c.description, c.checksum, 1 AS place
  FROM (SELECT DISTINCT source AS target FROM documents) t LEFT JOIN top USING (target)
    LEFT JOIN (SELECT * FROM catalog WHERE kind = 'UNDO_SQL') c ON c.target = t.target AND c.vnum = top.vnum)
"""

REPAIR = FRAMES + """,
ok AS (
  SELECT * FROM ledger WHERE success AND vnum IS NOT NULL AND type NOT IN ('UNDO_SQL', 'BASELINE')
  QUALIFY row_number() OVER (PARTITION BY target, vnum ORDER BY installed_rank DESC) = 1),
updates AS (
  SELECT c.target, ok.script, c.vnum, c.checksum FROM catalog c JOIN ok USING (target, vnum)
  WHERE c.kind <> 'UNDO_SQL' AND c.checksum IS DISTINCT FROM ok.checksum),
report AS (
  SELECT target, 'removed' AS action, script FROM ledger WHERE NOT success
  UNION ALL SELECT target, 'aligned', script FROM updates)
"""

PAGES = """
paths AS (
  SELECT page_id, html, regexp_extract(url, '^https?://([^?#]*)', 1) AS path FROM pages),
parts AS (
  SELECT *, regexp_extract(path, '/([a-z]+)/', 1) AS target,
    CAST(regexp_extract(path, '([0-9]+)[^/]*/?$', 1) AS INTEGER) AS number FROM paths),
named AS (
  SELECT *, number + CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END AS major,
    CASE WHEN page_id % 13 = 0 THEN 'misc' ELSE number::VARCHAR END AS folder,
    CASE page_id % 11 WHEN 0 THEN '2005' WHEN 1 THEN '2001' WHEN 2 THEN 'REPEATABLE'
                      WHEN 3 THEN 'IGNORED' ELSE 'SQL' END AS kind
  FROM parts),
files AS (
  SELECT *, CASE WHEN kind = 'SQL' THEN concat(major, '.', page_id % 2) END AS version,
    CASE WHEN kind IN ('SQL', 'REPEATABLE') THEN concat('p', page_id) END AS description,
    concat(folder, '/', CASE kind WHEN '2005' THEN concat('R1__p', page_id)
      WHEN '2001' THEN concat('Vx__p', page_id) WHEN 'REPEATABLE' THEN concat('R__p', page_id)
      WHEN 'IGNORED' THEN concat('note', page_id)
      ELSE concat('V', major, '.', page_id % 2, '__p', page_id) END, '.sql') AS script
  FROM named),
placed AS (
  SELECT *, kind <> 'SQL' OR (folder <> 'misc' AND folder = major::VARCHAR) AS fits FROM files)
"""

# Separators inside literals and comments are hidden as chr(2) while cutting.
STATEMENTS = """
texts AS (
  SELECT target, script, kind, checksum, doc_id, replace(replace(replace(replace(replace(text,
    '"', ' '), '$', ' '), '.', ';'), ',', concat(' ''', chr(2), ''' ')),
    '|', concat(' /* ', chr(2), chr(10), ' */ ')) AS text FROM scripts),
pieces AS (
  SELECT target, script, kind, checksum, doc_id, unnest(string_split(text, ';')) AS piece,
    generate_subscripts(string_split(text, ';'), 1) AS i FROM texts),
cut AS (
  SELECT *, regexp_extract(piece, '^(?:\\s|/\\*[^*]*\\*/)*') AS lead,
    coalesce(sum(length(piece) - length(replace(piece, chr(10), ''))) OVER (
      PARTITION BY script ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above
  FROM pieces),
statements AS (
  SELECT target, script, kind, checksum, doc_id,
    CAST(row_number() OVER (PARTITION BY script ORDER BY i) AS INTEGER) AS stmt_no,
    CAST(1 + above + length(lead) - length(replace(lead, chr(10), '')) AS INTEGER) AS line,
    trim(replace(piece, chr(2), ';'), concat(' ', chr(9), chr(10), chr(13))) AS sql
  FROM cut WHERE lead <> piece)
"""

PLACEHOLDER_TEXT = ("replace(replace(replace(replace(text, ' the ', ' {the} '), ' of ', ' {of} '),"
                    " ' to ', ' {to} '), ' and ', ' {nope} ')")

PLACEHOLDER_SIGNS = ("replace(replace(replace(replace(text, ' the ', ' ${word} '), ' of ', ' $${of} '),"
                     " ' to ', ' ${ledger:schema} '), ' and ', ' ${nope} ')")

REPORT_STATES = """CASE state WHEN 'PENDING' THEN '待执行' WHEN 'SUCCESS' THEN '成功' WHEN 'FAILED' THEN '失败'
    WHEN 'MISSING' THEN '缺失' WHEN 'OUT_OF_ORDER' THEN '乱序' WHEN 'FUTURE' THEN '未来版本'
    WHEN 'OUTDATED' THEN '待更新' WHEN 'BASELINE' THEN '基准' WHEN 'UNDONE' THEN '已撤销' END"""


# The same records where every ninth document has no outcome and one target no settings.
PARTIAL = (RECORDS.replace("p.checksum % 5 <> 0 AS ok", "p.doc_id % 9 <> 0 AS there, p.doc_id % 9 <> 0 AND p.checksum % 5 <> 0 AS ok")
           .replace("OR place <= stopped)", "OR place <= stopped) AND there")
           .replace("substr(target, 4) AS INTEGER) % 2 <> 0)", "substr(target, 4) AS INTEGER) % 2 <> 0 OR target = 'src5')"))

# The same records where every sixth outcome is there twice, with every other second one failed.
REPEATED = RECORDS.replace("p.checksum % 5 <> 0 AS ok, p.checksum::BIGINT * 1000000 AS elapsed", """
    p.checksum % 5 <> 0 AND p.doc_id % 12 <> 0 AS ok, p.checksum::BIGINT * 1000000
    + CASE WHEN p.doc_id % 12 = 0 AND p.checksum % 5 <> 0 THEN 1000 ELSE 0 END AS elapsed""")

REPAIRED = """SELECT l.target, installed_rank, version, description, type,
    l.script, CASE WHEN u.script IS NOT NULL THEN u.checksum ELSE l.checksum END AS checksum,
    installed_by, installed_on, execution_time, success
  FROM ledger l LEFT JOIN (SELECT target, script, arg_max(checksum, vnum) AS checksum
    FROM updates GROUP BY target, script) u ON u.target = l.target AND u.script = l.script"""

# A ledger with records without a target and with blank versions.
ODD_REPAIR = (REPAIR.replace("SELECT s.target, CAST(e.event_id + 1", "SELECT CASE WHEN e.event_id % 50 <> 7 THEN s.target END AS target, CAST(e.event_id + 1")
              .replace("ELSE s.spelling2 END AS version", "ELSE s.spelling2 END AS version0")
              .replace("SELECT *, coalesce('v' || vnum, 's' || script) AS item\n  FROM ledger0",
                       "SELECT *, coalesce(version0, '') AS version, coalesce('v' || vnum, 's' || script) AS item\n  FROM ledger0")
              .replace("SELECT * FROM ledger WHERE success AND", "SELECT * FROM ledger WHERE target IS NOT NULL AND success AND"))

STRICT = f"""SELECT target FROM problems UNION SELECT target FROM verdicts WHERE verdict = 'out_of_order'"""


def _checksum(source: str, name: str, column: str) -> str:
    """Line ends as LF, no byte order mark, CRC-32 as a signed integer."""
    clean = rf"regexp_replace(regexp_replace({column}, '^\x{{FEFF}}', ''), '\r\n?', chr(10), 'g')"
    crc = crc32(f"hex(encode({clean}))")
    return (f"SELECT concat('{source[0]}', {name}) AS script, CAST(CASE WHEN c >= 2147483648 THEN c - 4294967296 ELSE c END AS INTEGER) AS checksum "
            f"FROM (SELECT {name}, {crc} AS c FROM {source}, crc_table)")


def _text(value: str) -> str:
    """An SQL literal."""
    return "concat('" + value.replace("'", "''").replace("\n", "', chr(10), '") + "')"


def _dialect(forms: list[tuple[str, str, int, int]]) -> str:
    """One statement per sentence, in the forms by turns; lines follow from the lines of the forms in front."""
    def of_form(part: int, wrap) -> str:
        return "CASE (i - 1) % " + str(len(forms)) + "".join(
            f" WHEN {n} THEN {wrap(form[part])}" for n, form in enumerate(forms)) + " END"

    return f"""WITH {FRAMES}, parts AS (
  SELECT target, script, list_filter(list_transform(string_split(regexp_replace(text, '[\\x00-\\x1F!-\\-/:-@\\[-`{{-~\\x7F]', ' ', 'g'), '.'),
    lambda s: trim(s)), lambda s: s <> '') AS sentences FROM scripts),
rows AS (SELECT target, script, unnest(sentences) AS s, generate_subscripts(sentences, 1) AS i FROM parts),
sized AS (SELECT *, {of_form(1, lambda f: f"replace({_text(f)}, '{{s}}', s)")} AS sql, {of_form(2, str)} AS above,
  {of_form(3, str)} AS takes FROM rows)
SELECT target, script, i::INTEGER AS stmt_no, (1 + above + coalesce(sum(takes) OVER (
  PARTITION BY script ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS line, sql FROM sized"""


def _nearest(known: list[str]) -> str:
    values = ", ".join(f"({i}, '{w}')" for i, w in enumerate(known))
    return f"""WITH known(place, name) AS (VALUES {values}),
words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS key FROM documents),
ranked AS (SELECT key, name, place, levenshtein(key, name) AS distance FROM words, known
  WHERE key NOT IN (SELECT name FROM known)),
best AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY key ORDER BY distance, place) = 1)
SELECT key, CASE WHEN distance <= 4 THEN name END AS suggestion FROM best"""


def build(known_words: list[str]) -> dict[str, str]:
    return {
        "state_view": f"""WITH {STATES} SELECT target, script, state, r_version AS version,
            a_version AS applied_version, installed_rank::VARCHAR AS installed_rank,
            r_checksum::VARCHAR AS checksum, a_checksum::VARCHAR AS applied_checksum FROM view""",
        "state_incremental": f"""WITH {STATES} SELECT target, script, state, r_version AS version,
            a_version AS applied_version, installed_rank::VARCHAR AS installed_rank,
            r_checksum::VARCHAR AS checksum, a_checksum::VARCHAR AS applied_checksum FROM view""",
        "state_counts": f"WITH {STATES} SELECT target, state, count(*) AS items FROM view GROUP BY ALL",
        "state_summary": f"WITH {STATES} SELECT target, " + ", ".join(
            f"count(*) FILTER (state = '{s}') AS {s.lower()}" for s in (
                "PENDING", "OUT_OF_ORDER", "SUCCESS", "FAILED", "MISSING", "OUTDATED", "FUTURE",
                "BASELINE", "UNDONE")) + " FROM view GROUP BY target",
        "pending_states": f"""WITH {STATES} SELECT target, script, state FROM view
            WHERE state IN ('PENDING', 'OUT_OF_ORDER', 'OUTDATED')""",
        "applied_states": f"""WITH {STATES} SELECT target, script, state FROM view
            WHERE state IN ('SUCCESS', 'BASELINE')""",
        "problems": f"WITH {PROBLEMS} SELECT * FROM problems",
        "problem_details": f"""WITH {PROBLEMS} SELECT target, code, count(*) AS problems,
            CASE code WHEN '2003' THEN 'Migration validation mismatch'
                      ELSE 'Failed migration needs repair' END AS summary, CAST(2 AS INTEGER) AS severity
            FROM problems GROUP BY target, code""",
        "current_version": f"""WITH {STATES} SELECT target, arg_max(a_version, a_vnum) AS version FROM view
            WHERE state IN ('SUCCESS', 'BASELINE') AND a_vnum IS NOT NULL GROUP BY target""",
        "latest_per_item": f"WITH {LATEST} SELECT target, script, version, installed_rank, type, success FROM latest",
        "failed_gate": f"""WITH {FRAMES} SELECT target, arg_min(script, installed_rank) AS script
            FROM ledger WHERE NOT success GROUP BY target""",
        "verdicts": f"WITH {_verdicts(strict=True)} SELECT target, script, verdict FROM verdicts",
        "pending_all": _pending("true"),
        "pending_incremental": _pending("true"),
        "pending_strict": f"""WITH {_verdicts(strict=True)} SELECT target, script, version FROM plan
            WHERE target NOT IN (SELECT target FROM verdicts WHERE verdict = 'out_of_order')""",
        "pending_exact": _pending("c.vnum = 14"),
        "pending_range": _pending("c.vnum BETWEEN 7 AND 21"),
        "pending_family": _pending("c.vnum BETWEEN 10 AND 19"),
        "pending_family_range": _pending("c.vnum BETWEEN 7 AND 29"),
        "pending_regex": _pending(r"regexp_full_match(c.version, '0*[12][._]\d.*')"),
        "pending_directory": _pending("c.vnum // 10 = 1"),
        "pending_out_of_order": f"""WITH {_verdicts(strict=True)}
            SELECT target, '2004' AS code, arg_min(script, installed_rank) AS script, 'failed record' AS detail
            FROM ledger WHERE NOT success GROUP BY target
            UNION ALL SELECT target, '2006', script, concat('version ', version) FROM verdicts
            WHERE verdict = 'out_of_order'""",
        "pending_no_hit": f"""WITH {LATEST} SELECT target, '2001' AS code, '' AS script,
            'nothing matches 3.7' AS detail FROM visible GROUP BY target
            HAVING NOT coalesce(bool_or(vnum = 37 AND vnum % 3 <> 1), false)""",
        "range_end_warning": f"""WITH {LATEST}, cut AS (SELECT target, version, row_number() OVER (
              PARTITION BY target ORDER BY vnum) AS nr, count(*) OVER (PARTITION BY target) AS left_out
            FROM visible WHERE vnum BETWEEN 21 AND 29)
            SELECT target, string_agg(version, ' ' ORDER BY nr) AS versions, max(left_out) AS left_out
            FROM cut WHERE nr <= 5 GROUP BY target""",
        "validated_plan": f"""WITH {SPLIT_PROBLEMS}{SPLIT_VERDICTS}
            SELECT target, script FROM plan WHERE target NOT IN (SELECT target FROM problems)""",
        "plan_progress": f"""WITH {PLAN} SELECT target, script, CAST(place AS INTEGER) AS step,
            CAST(count(*) OVER (PARTITION BY target) AS INTEGER) AS steps FROM plan""",
        "version_reached": f"""WITH {PLAN}, seen AS (
              SELECT target, version, vnum, 1 AS recorded, -installed_rank AS age FROM ledger
              WHERE success AND vnum IS NOT NULL AND type <> 'UNDO_SQL'
              UNION ALL SELECT target, version, vnum, 0, 0 FROM plan WHERE vnum IS NOT NULL)
            SELECT target, version FROM seen QUALIFY row_number() OVER (
              PARTITION BY target ORDER BY vnum DESC, recorded DESC, age DESC) = 1""",
        "undo_plan": f"WITH {UNDO} SELECT target, script, version, checksum FROM plan WHERE script IS NOT NULL",
        "undo_problems": f"""WITH {UNDO} SELECT target, '2008' AS code, '' AS script,
            CASE WHEN done_version IS NULL THEN 'nothing to undo'
                 ELSE concat('no undo script for version ', done_version) END AS detail
            FROM plan WHERE script IS NULL""",
        "undo_records": "WITH " + UNDO.replace("plan AS (", "plan0 AS (")
            + ", plan AS (SELECT * FROM plan0 WHERE script IS NOT NULL)" + RECORDS,
        "repair_ledger": f"WITH {REPAIR} {REPAIRED} WHERE success",
        "repair_delta": f"WITH {REPAIR} {REPAIRED} WHERE success",
        "repair_untouched": f"""WITH {ODD_REPAIR} SELECT * REPLACE (checksum::VARCHAR AS checksum)
            FROM ({REPAIRED} WHERE success OR l.target IS NULL)""",
        "untouched_report": f"""WITH {ODD_REPAIR} SELECT target, action, script FROM report WHERE target IS NOT NULL
            UNION ALL SELECT target, 'left', script FROM ledger WHERE target IS NULL""",
        "repair_report": f"WITH {REPAIR} SELECT * FROM report",
        "repair_counts": f"""WITH {REPAIR} SELECT target, count(*) FILTER (action = 'removed') AS removed,
            count(*) FILTER (action = 'aligned') AS aligned FROM report GROUP BY target""",
        "baseline_rows": f"""WITH {FRAMES}, asked AS (SELECT source AS target FROM documents
              UNION SELECT c_name FROM customer)
            SELECT target, CAST(1 AS INTEGER) AS installed_rank, '1.0' AS version, 'baseline' AS description,
              'BASELINE' AS type, '<< BASELINE >>' AS script,
              'runner' AS installed_by, TIMESTAMP '2024-02-01 00:00:00' AS installed_on,
              CAST(0 AS INTEGER) AS execution_time, true AS success
            FROM asked WHERE target NOT IN (SELECT target FROM ledger)""",
        "baseline_problems": f"""WITH {FRAMES}, asked AS (SELECT source AS target FROM documents
              UNION SELECT c_name FROM customer)
            SELECT target, '2007' AS code, '<< BASELINE >>' AS script, 'the ledger has records' AS detail
            FROM asked WHERE target IN (SELECT target FROM ledger)""",
        "record_outcomes": f"WITH {PLAN}{RECORDS}",
        "info_report": f"""WITH {STATES} SELECT target,
            coalesce(CASE WHEN r_script IS NOT NULL THEN r_version ELSE a_version END, '(可重复)') AS version,
            coalesce(r_description, a_description) AS description,
            CASE WHEN r_script IS NOT NULL THEN 'SQL' WHEN type = 'BASELINE' THEN '基准'
                 WHEN type = 'UNDO_SQL' THEN 'UNDO' ELSE type END AS type,
            coalesce(strftime(installed_on, '%Y-%m-%d %H:%M:%S'), '-') AS installed_on,
            coalesce(execution_time::VARCHAR, '-') AS execution_time, {REPORT_STATES} AS state FROM view""",
        "version_order": """WITH v AS (SELECT l_returnflag AS flag,
              (l_orderkey, l_linenumber, l_partkey) AS k, concat(l_orderkey, '.', l_linenumber, '-B0',
              l_partkey) AS version FROM lineitem)
            SELECT flag, arg_min(version, k) AS lowest, arg_max(version, k) AS highest,
              count(DISTINCT k) AS versions FROM v GROUP BY flag""",
        "path_filter": rf"""WITH {PAGES} SELECT page_id, path FROM paths
            WHERE regexp_full_match(path, '[^/]*\.example\.[^/]*/en/\d+(\.html)?')""",
        "dir_version": f"""WITH {PAGES}, cut AS (
              SELECT page_id, list_filter(string_split(path, '/'), lambda x: regexp_full_match(x, '\\d+(\\.\\d+)*')) AS v
              FROM paths)
            SELECT page_id, v[len(v)] AS dir_version FROM cut""",
        "classify_names": f"WITH {PAGES} SELECT target, script, kind, version, description FROM files",
        "catalog_rows": f"""WITH {PAGES} SELECT target, script, kind, version,
            CASE WHEN kind = 'SQL' THEN folder END AS dir_version, description FROM placed
            WHERE kind IN ('SQL', 'REPEATABLE') AND fits""",
        "catalog_problems": f"""WITH {PAGES}, doubled AS (SELECT target, script, row_number() OVER (
              PARTITION BY target, major, page_id % 2 ORDER BY script) AS nr FROM placed
              WHERE kind = 'SQL' AND fits)
            SELECT target, CASE WHEN kind = 'SQL' THEN '2001' ELSE kind END AS code, script FROM placed
            WHERE kind IN ('2001', '2005') OR NOT fits
            UNION ALL SELECT target, '2002', script FROM doubled WHERE nr > 1""",
        "duplicate_versions": f"""WITH {PAGES}, doubled AS (SELECT target, script, min(script) OVER (
              PARTITION BY target, major, page_id % 2) AS detail FROM placed WHERE kind = 'SQL')
            SELECT target, '2002' AS code, script, detail FROM doubled WHERE script <> detail""",
        "placeholders": f"""WITH {FRAMES} SELECT target, script, replace(replace(replace(replace(
            {PLACEHOLDER_TEXT}, '{{the}}', target), '{{of}}', '${{of}}'), '{{to}}', 's_' || target),
            '{{nope}}', '${{nope}}') AS text FROM scripts""",
        "undefined_placeholders": f"""WITH {FRAMES}, marked AS (
              SELECT target, script, string_split({PLACEHOLDER_TEXT}, '{{nope}}') AS parts FROM scripts),
            rows AS (SELECT target, script, unnest(parts) AS part, generate_subscripts(parts, 1) AS i,
              len(parts) AS n FROM marked),
            lines AS (SELECT *, 1 + sum(length(part) - length(replace(part, chr(10), ''))) OVER (
              PARTITION BY script ORDER BY i) AS line FROM rows)
            SELECT target, '2009' AS code, script, concat('nope in line ', line::BIGINT) AS detail
            FROM lines WHERE i < n""",
        "split_statements": f"WITH {FRAMES}, {STATEMENTS} SELECT script, stmt_no, line, sql FROM statements",
        "statement_batches": f"""WITH {FRAMES}, {STATEMENTS} SELECT script,
            CAST((stmt_no - 1) // 3 AS INTEGER) AS batch_no, count(*) AS statements, min(line) AS line
            FROM statements GROUP BY script, (stmt_no - 1) // 3""",
        "failing_statement": f"""WITH {FRAMES}, {STATEMENTS},
            stopped AS (SELECT target, script, any_value(doc_id % 4) * 3 + 1 AS start,
              any_value(checksum % 3) AS applied, max(stmt_no) AS total FROM statements
              WHERE checksum % 5 = 0 GROUP BY target, script)
            SELECT f.target, '2010' AS code, f.script, CAST(f.start + f.applied AS INTEGER) AS stmt_no, s.line
            FROM stopped f JOIN statements s ON s.script = f.script
              AND s.stmt_no = least(f.start + f.applied, f.start + 2, f.total)""",
        "failing_by_target": f"""WITH {FRAMES.replace("concat(lang, '/', CASE", "concat('s', doc_id // 20) AS script, concat(lang, '/', CASE").replace("'.sql') AS script", "'.sql') AS long_name")},
            {STATEMENTS.replace("PARTITION BY script", "PARTITION BY target, script")},
            stopped AS (SELECT target, script, any_value(doc_id % 4) * 3 + 1 AS start,
              any_value(checksum % 3) AS applied, max(stmt_no) AS total FROM statements
              WHERE checksum % 5 = 0 GROUP BY target, script)
            SELECT f.target, '2010' AS code, f.script, CAST(f.start + f.applied AS INTEGER) AS stmt_no, s.line
            FROM stopped f JOIN statements s ON s.script = f.script AND s.target = f.target
              AND s.stmt_no = least(f.start + f.applied, f.start + 2, f.total)""",
        "plan_default": f"""WITH {SPLIT_PROBLEMS}{_verdicts(strict=True).removeprefix(LATEST)}
            SELECT target, script FROM plan WHERE target NOT IN ({STRICT})""",
        "dry_run_default": f"""WITH {SPLIT_PROBLEMS}{_verdicts(strict=True).removeprefix(LATEST)}, {STATEMENTS}
            SELECT s.target, s.script, stmt_no, line, sql
            FROM statements s JOIN plan p ON p.target = s.target AND p.script = s.script
            WHERE p.target NOT IN ({STRICT})""",
        "gated_plan": f"""WITH {PAGES.replace("'/([a-z]+)/', 1) AS target", "'/([a-z]+)/', 1) || '-' || page_id % 50 AS target")},
            doubled AS (SELECT target FROM placed WHERE kind = 'SQL' AND fits
              GROUP BY target, major, page_id % 2 HAVING count(*) > 1)
            SELECT target, script FROM placed WHERE kind IN ('SQL', 'REPEATABLE') AND target NOT IN (
              SELECT target FROM placed WHERE kind IN ('2001', '2005') OR NOT fits UNION SELECT target FROM doubled)""",
        "duplicate_locations": f"""WITH {PAGES}, both_ AS (
              SELECT *, 0 AS place FROM files UNION ALL SELECT *, 1 FROM files WHERE target IN ('en', 'fr')),
            named2 AS (SELECT target, script, place, row_number() OVER w AS nr, first_value(script) OVER w AS first_script,
                first_value(place) OVER w AS first_place FROM both_ WHERE kind IN ('SQL', 'REPEATABLE')
              WINDOW w AS (PARTITION BY target, kind, CASE WHEN kind = 'SQL' THEN concat('v', major, '.', page_id % 2) ELSE script END
                ORDER BY place, script))
            SELECT target, '2002' AS code, script, concat(first_script, CASE WHEN first_script = script
              THEN concat(' in location ', first_place) ELSE '' END) AS detail FROM named2 WHERE nr > 1""",
        "record_partial": f"WITH {PLAN}{PARTIAL}",
        "record_problems": f"""WITH {PLAN} SELECT target, '2010' AS code, script, 'no outcome' AS detail FROM plan
            WHERE doc_id % 9 = 0 UNION ALL SELECT DISTINCT target, '4002', '', 'no settings of the target' FROM plan
            WHERE target = 'src5'""",
        "record_repeated": f"WITH {PLAN}{REPEATED}",
        "repeat_problems": f"""WITH {PLAN} SELECT target, '2010' AS code, script, '2 outcomes' AS detail FROM plan
            WHERE doc_id % 6 = 0""",
        "append_repeated": f"WITH {PLAN}{RECORDS}",
        "append_conflicts": f"""SELECT DISTINCT target, '3001' AS code, '' AS script, 'records added by commit 3' AS detail
            FROM (WITH {PLAN}{RECORDS})""",
        "split_mysql": _dialect(MYSQL_FORMS),
        "split_oracle": _dialect(ORACLE_FORMS),
        "split_dollar": _dialect(DOLLAR_FORMS),
        "callback_names": f"""WITH named AS (SELECT doc_id, ([{", ".join(f"'{c}'" for c in (
              *CALLBACK_SCRIPTS, "beforemigrate.sql", "beforeMigrate.SQL", "afterUndo2.sql", "V1__beforeMigrate.sql"))}])[doc_id % {len(CALLBACK_SCRIPTS) + 4} + 1] AS name,
              doc_id // 20 % 3 = 2 AS below, doc_id % {len(CALLBACK_SCRIPTS) + 4} AS n, lang FROM documents)
            SELECT doc_id, CASE WHEN below THEN concat(lang, '/', name) ELSE name END AS script,
              CASE WHEN n = {len(CALLBACK_SCRIPTS) + 3} THEN 'SQL' WHEN n < {len(CALLBACK_SCRIPTS)} AND NOT below THEN 'CALLBACK' ELSE 'IGNORED' END AS kind FROM named""",
        "plan_by_directory": f"""WITH {PLAN} SELECT target, script, CAST(row_number() OVER (PARTITION BY target ORDER BY vnum IS NULL,
              vnum % 7, vnum, CASE WHEN vnum IS NULL THEN description END, script) AS INTEGER) AS step,
            CAST(count(*) OVER (PARTITION BY target) AS INTEGER) AS steps FROM plan""",
        "dry_run_undo": f"""WITH {UNDO}, {STATEMENTS} SELECT s.target, s.script, s.kind, stmt_no, line, sql
            FROM statements s JOIN plan p ON p.target = s.target AND p.script = s.script""",
        "dry_run_plain": f"""WITH {PLAN}, {STATEMENTS.replace("texts AS (", "texts0 AS (").replace("FROM scripts),", "FROM scripts), texts AS (SELECT * REPLACE (" + PLACEHOLDER_SIGNS + " AS text) FROM texts0),")}
            SELECT s.target, s.script, s.kind, stmt_no, line, sql
            FROM statements s JOIN plan p ON p.target = s.target AND p.script = s.script""",
        "unknown_checksums": "WITH " + PROBLEMS.replace("FROM scripts s\n", "FROM (SELECT * REPLACE (CASE WHEN doc_id % 4 <> 0 THEN checksum END AS checksum) FROM scripts) s\n")
            .replace("FROM ledger0", "FROM (SELECT * REPLACE (CASE WHEN installed_rank % 3 <> 0 THEN checksum END AS checksum) FROM ledger0)")
            + " SELECT * FROM problems",
        "no_hit_asked": f"""WITH {LATEST}, asked AS (SELECT target FROM catalog UNION SELECT source FROM documents
              UNION SELECT c_name FROM customer)
            SELECT target, '2001' AS code, '' AS script, 'nothing matches 3.7' AS detail FROM asked
            WHERE target NOT IN (SELECT target FROM visible WHERE vnum = 37 AND vnum % 3 <> 1)""",
        "missing_texts": f"""WITH {PLAN} SELECT target, '2010' AS code, p.script, 'the script has no text' AS detail
            FROM plan p WHERE length(replace(replace(replace(replace(replace(text, '"', ' '), '$', ' '), '.', ';'),
              ',', ' '';'' '), '|', concat(' /* ;', chr(10), ' */ '))) % 7 = 0""",
        "checksum": f"WITH {CRC_TABLE} {_checksum('documents', 'doc_id', 'text')} UNION ALL {_checksum('pages', 'page_id', 'html')}",
        "dry_run": f"""WITH {PLAN}, {STATEMENTS} SELECT s.target, s.script, s.kind, stmt_no, line, sql
            FROM statements s JOIN plan p ON p.target = s.target AND p.script = s.script""",
        "redact": r"""SELECT doc_id, replace(regexp_replace(regexp_replace(concat('jdbc:x://user:', source,
            '@host Password= ', lang, chr(10), text), '(password[=:]\s*)[^\s]+', '\1****', 'gi'),
            '(//[^/:@\s]+:)[^@\s]+@', '\1****@', 'gi'), 'the', '****') AS text FROM documents""",
        "nearest_key": _nearest(known_words),
    }
