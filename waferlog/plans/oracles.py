"""SQL counterparts of the registered queries.

Each computes its answer from the source columns of the driver tables; none parses the synthesised log text. The
common table expressions spell out what an entry of each synthesised log looks like.
"""

from __future__ import annotations

# --- entries of the event log -------------------------------------------------------------------------------------

EVENTS = r"""
S AS (
  SELECT event_id, date_trunc('milliseconds', ts) AS t, user_id AS u, event_type AS et,
         CAST(round(value * 100) AS BIGINT) AS cents, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
         event_type = 'purchase' AS is_secs
  FROM events),
F AS (
  SELECT *, CASE WHEN is_secs THEN strftime(t, '%Y-%m-%d %H') ELSE strftime(t, '%Y_%m_%d') END || '.log' AS source_file,
         CASE WHEN is_secs THEN 10 ELSE 1 END + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS n
  FROM S),
E0 AS (
  SELECT *, CAST(1 + coalesce(sum(n) OVER (PARTITION BY source_file ORDER BY event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_no,
         strftime(t, '%Y-%m-%d %H:%M:%S:%g') AS time, CASE WHEN is_secs THEN 'SECS' ELSE 'MMI' END AS log_type,
         CASE WHEN is_secs THEN 1000 + k END AS ceid, 10 + u % 10 AS rptid, u % 4 + 1 AS port,
         CASE WHEN et = 'error' AND k % 2 = 0 THEN k % 4 + 1 END AS repeat_count,
         et = 'error' AS is_alarm, et IN ('click', 'view', 'signup') AS is_object_event,
         CASE WHEN k % 3 = 0 THEN 'NO' ELSE 'YES' END AS id_read, CASE WHEN k % 4 = 0 THEN 'NO' ELSE 'YES' END AS slot_read,
         CASE WHEN is_secs THEN NULL WHEN et = 'error' THEN 'Alarm' ELSE 'CMS/GEM300' END AS level_name,
         CASE et
           WHEN 'click' THEN 'CarrierObject::StateChange' WHEN 'view' THEN 'LoadPortObject::StateChange'
           WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'CarrierObject::ClearCarrierInfo' ELSE 'SubstrateObject::Initialize' END
         END AS event_type
  FROM F),
E1 AS (
  SELECT *,
    CASE
      WHEN et = 'error' THEN '[ALARM] Alarm Code [' || (3000 + k) || '] unit ' || u || ' value ' || cents
      WHEN event_type = 'CarrierObject::StateChange' THEN event_type || ' model=M' || (k % 3) || ', GetString()=Carrier idx: ' || k
        || ', CARRIER_ID: LOT' || u || ', CARRIERID_READ: ' || id_read || ', SLOTMAP_READ: ' || slot_read
      WHEN event_type = 'LoadPortObject::StateChange' THEN event_type || ' model=M' || (k % 3) || ', GetString()=PorNo: ' || port || ', LocID: LP' || port
      WHEN event_type = 'CarrierObject::ClearCarrierInfo' THEN event_type || ' Before Clear, this->CarrierID : LOT' || u || ', SEQPortNo : ' || port || ', MMIPortNo : ' || port
      WHEN event_type = 'SubstrateObject::Initialize' THEN event_type || ' substrateno=' || k || ', SubstrateID=W' || u || ', AcquiredID=A' || k
      ELSE 'SEND S6F11W' END AS first_line,
    CASE WHEN is_secs THEN chr(10) || '  <L [3]>' || chr(10) || '    <U4 [1] 0>' || chr(10) || '    <U4 [1] ' || (1000 + k) || '>' || chr(10)
      || '    <L [1]>' || chr(10) || '      <L [2]>' || chr(10) || '        <U4 [1] ' || (10 + u % 10) || '>' || chr(10) || '        <L [2]>' || chr(10)
      || '          <A [' || length('LOT' || u) || '] LOT' || u || '>' || chr(10) || '          <U4 [1] ' || cents || '>' ELSE '' END
    || CASE WHEN k % 5 <> 0 THEN '' WHEN is_secs THEN chr(10) || '  note ' || k ELSE chr(10) || 'note ' || k || ' for unit ' || u END AS rest,
    CASE WHEN is_secs THEN strftime(t, '%H:%M:%S:%g') || ': [1] '
         ELSE time || CASE WHEN et = 'error' THEN '|31|' ELSE '|21|' END || event_id || '|' END AS prefix,
    CASE WHEN repeat_count IS NULL THEN '' ELSE ' -->[Count:' || repeat_count || ']' END AS suffix
  FROM E0),
E AS (SELECT *, first_line || rest AS message, prefix || first_line || suffix || rest AS raw_line,
             CAST(row_number() OVER (ORDER BY t, CASE WHEN is_secs THEN 1 ELSE 0 END, source_file, line_no) - 1 AS BIGINT) AS timeline_index
      FROM E1)
"""

DIMS = r"""
EN AS (SELECT p_partkey + 1000 AS ceid, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE trim(p_name) END AS name FROM part),
RV AS (SELECT s_suppkey % 12 + 10 AS rptid, row_number() OVER (PARTITION BY s_suppkey % 12 ORDER BY s_suppkey) AS position,
              s_suppkey AS index_no, CAST(s_nationkey + 2000 AS BIGINT) AS vid,
              CASE WHEN s_nationkey < 20 THEN coalesce(n_name, '') ELSE '' END AS name
       FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey)
"""

# --- entries of the documents -------------------------------------------------------------------------------------

DOCS = r"""
D0 AS (
  SELECT doc_id, string_split(text, chr(10)) AS parts,
         CASE lang WHEN 'en' THEN '01' WHEN 'fr' THEN '02' WHEN 'de' THEN '03' ELSE '04' END AS dd FROM documents),
D1 AS (
  SELECT *, '2024_02_' || dd || '.log' AS source_file,
         CAST(1 + coalesce(sum(len(parts)) OVER (PARTITION BY dd ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_no,
         CAST('2024-02-' || dd AS TIMESTAMP) + to_milliseconds(doc_id % 86400000) AS t
  FROM D0),
D AS (
  SELECT doc_id AS seq_index, source_file, line_no, t, strftime(t, '%Y-%m-%d %H:%M:%S:%g') AS time,
         array_to_string(list_concat(parts[1:1], [x FOR x IN parts[2:] IF NOT regexp_full_match(x, '\s*')]), chr(10)) AS message
  FROM D1),
B AS (SELECT D.*, quality IS NOT NULL AS bookmarked,
             CASE WHEN quality IS NULL THEN '' WHEN toxic = 1 THEN 'check' || chr(10) || 'again' ELSE 'ok' END AS memo
      FROM D LEFT JOIN (SELECT * FROM labels WHERE quality = 1) l ON l.doc_id = D.seq_index)
"""

# --- one file per document ----------------------------------------------------------------------------------------

FILES = r"""
P AS (
  SELECT doc_id, 'doc' || doc_id || '/' || CASE doc_id % 4 WHEN 0 THEN '2024_03_05.log' WHEN 1 THEN '2024-03-05 7.tslog'
           WHEN 2 THEN 'notes.TXT' ELSE '2024-03-05.log' END AS source_path,
         CASE doc_id % 3 WHEN 0 THEN '2024-03-05 07:00:00:001|1|1|' WHEN 1 THEN '07:00:00:001: [2] ' ELSE '' END AS head,
         string_split(text, chr(10)) AS parts, doc_id % 3 AS h, doc_id % 4 AS f FROM documents),
Q AS (SELECT *, len(parts) - CASE WHEN len(parts) > 1 AND parts[len(parts)] = '' THEN 1 ELSE 0 END AS n FROM P),
R AS (SELECT *, CASE WHEN f = 0 OR (h = 0 AND n = 1) THEN 'MMI'
                     WHEN f = 1 OR (h = 1 AND n = 1) THEN 'SECS' ELSE 'UNKNOWN' END AS dialect FROM Q)
"""

# --- the setup-dump log -------------------------------------------------------------------------------------------

SETUP = r"""
U0 AS (
  SELECT event_id, strftime(ts, '%Y_%m_%d') || '.log' AS source_file, event_type AS et, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
U1 AS (
  SELECT *, et = 'error' AND k % 10 = 0 AS hs, et = 'click' AND k % 10 = 0 AS hf, k % 20 IN (3, 10) AS cs, k % 20 IN (7, 10) AS cf,
         CASE WHEN k % 3 = 0 THEN 21 ELSE 1 END AS color,
         CASE k % 20 WHEN 3 THEN 2 WHEN 7 THEN 3 WHEN 10 THEN 3 ELSE 1 END AS n FROM U0),
U2 AS (
  SELECT *, CAST(1 + coalesce(sum(n) OVER (PARTITION BY source_file ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_no,
         CASE WHEN hs THEN 1 WHEN hf THEN 0 WHEN cs THEN 1 WHEN color <> 1 THEN 0 END AS ev_skip,
         CASE WHEN hs OR cs THEN 1 WHEN hf OR cf THEN 0 WHEN color <> 1 THEN 0 END AS ev_flag,
         CASE WHEN hs THEN '[Setup.ini] LOGGING' WHEN hf THEN '[setup.INI] finish' ELSE 'step ' || k END
         || CASE k % 20 WHEN 3 THEN chr(10) || '  [Other.ini] LOGGING' WHEN 7 THEN chr(10) || '[Other.ini] FINISH'
                        WHEN 10 THEN chr(10) || '[Other.ini] LOGGING' || chr(10) || '[Other.ini] FINISH' ELSE '' END AS message
  FROM U1),
U3 AS (
  SELECT *, coalesce(last_value(ev_skip IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         coalesce(last_value(ev_flag IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS state
  FROM U2),
U AS (SELECT *, hs OR hf OR cs OR cf OR (color = 1 AND before = 1) AS dropped FROM U3)
"""

PAIRS = r"""
PR AS (SELECT a.conv_id * 1000 + a.turn AS pair_id, a.text AS l, b.text AS r
       FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)
"""


# --- the log of the rarer forms -------------------------------------------------------------------------------------

MIXED = r"""
X0 AS (
  SELECT event_id, date_trunc('milliseconds', ts) AS t, user_id AS u, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, event_type = 'purchase' AS is_secs FROM events),
X1 AS (
  SELECT *, 'mixed ' || CASE WHEN is_secs THEN strftime(t, '%Y-%m-%d %H') ELSE strftime(t, '%Y_%m_%d') END || '.log' AS source_file,
         CASE WHEN is_secs AND k % 4 = 2 THEN 3 ELSE 1 END AS n FROM X0),
X2 AS (
  SELECT *, CAST(1 + coalesce(sum(n) OVER (PARTITION BY source_file ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_no,
         strftime(t, '%Y-%m-%d %H:%M:%S:%g') AS time, CASE WHEN is_secs THEN 'SECS' ELSE 'MMI' END AS log_type,
         CASE WHEN NOT is_secs THEN NULL WHEN k % 4 = 1 THEN k + 5 WHEN k % 4 < 3 THEN k + 1000 END AS ceid,
         CASE WHEN is_secs THEN CASE k % 4 WHEN 0 THEN 'S1F3' WHEN 1 THEN 'S2F41' WHEN 2 THEN 'S6F11' ELSE 'S6F12' END END AS sxfy_type,
         CASE WHEN is_secs THEN CASE k % 4 WHEN 0 THEN 'SEND S1F3W CEID = ' || (k + 1000) WHEN 1 THEN 'RECV S2F41 ceid=' || (k + 5)
                WHEN 2 THEN 'SEND S6F11W' || chr(10) || '  <U4 [1] 1>' || chr(10) || '  <U4 [1] ' || (k + 1000) || '>' ELSE 'RECV S6F12' END
              ELSE CASE k % 3 WHEN 0 THEN '[CMS] job J' || k || ' for unit ' || u WHEN 1 THEN 'DeletejobList count=' || k ELSE 'plain ' || k END END AS message
  FROM X1),
X AS (SELECT *, row_number() OVER (ORDER BY t, is_secs, source_file, line_no) AS place FROM X2)
"""


def _mixed(body: str) -> str:
    return f"WITH {MIXED}{body}"


def _gap_text(ms: str) -> str:
    one = f"printf('%.1f', {ms} / 1000.0)"
    return f"""CASE WHEN {ms} IS NULL THEN '' ELSE (CASE WHEN {ms} < 0 THEN '-' ELSE '+' END) ||
      (CASE WHEN abs({ms}) < 1000 THEN abs({ms}) || 'ms'
            WHEN abs({ms}) < 60000 AND abs({ms}) % 1000 = 0 THEN (abs({ms}) // 1000) || 's'
            WHEN abs({ms}) < 60000 THEN {one} || 's'
            WHEN abs({ms}) < 3600000 THEN (abs({ms}) // 60000) || 'm ' || (abs({ms}) // 1000 % 60) || 's'
            ELSE (abs({ms}) // 3600000) || 'h ' || (abs({ms}) // 60000 % 60) || 'm ' || (abs({ms}) // 1000 % 60) || 's' END) END"""


def _report_gap(ms: str) -> str:
    one = f"regexp_replace(printf('%.1f', {ms} / 1000.0), '[.]0$', '')"
    return f"""CASE WHEN {ms} IS NULL THEN '' ELSE
      '+' || (CASE WHEN {ms} < 1000 THEN {ms} || 'ms' WHEN {ms} < 60000 THEN {one} || 's'
            ELSE ({ms} // 60000) || 'm ' || ({ms} // 1000 % 60) || 's' END) END"""


def _events(body: str, *more: str) -> str:
    return "WITH " + ",".join([EVENTS, *more]) + body


def _docs(body: str, *more: str) -> str:
    return "WITH " + ",".join([DOCS, *more]) + body


def _has(word: str) -> str:
    return f"contains(lower(message), '{word.lower()}')"


def _matched(words: list[str]) -> str:
    return "array_to_string([x FOR x IN [" + ", ".join(f"CASE WHEN {_has(w)} THEN '{w}' END" for w in words) + "] IF x IS NOT NULL], ', ')"


def _spelled(words: list[str]) -> str:
    """Matched substrings as written."""
    found = [f"CASE WHEN {_has(w)} THEN substring(message, strpos(lower(message), '{w.lower()}'), {len(w)}) END" for w in words]
    return "array_to_string([x FOR x IN [" + ", ".join(found) + "] IF x IS NOT NULL], ', ')"


_DETAILS = """CASE event_type
  WHEN 'CarrierObject::StateChange' THEN 'model=M' || (k % 3) || ', idx=' || k || ', CARRIER_ID=LOT' || u || ', CARRIERID_READ=' || id_read || ', SLOTMAP_READ=' || slot_read
  WHEN 'CarrierObject::ClearCarrierInfo' THEN 'CarrierID=LOT' || u || ', SEQPortNo=' || port || ', MMIPortNo=' || port
  WHEN 'LoadPortObject::StateChange' THEN 'model=M' || (k % 3) || ', PorNo=' || port || ', LocID=LP' || port
  WHEN 'SubstrateObject::Initialize' THEN 'substrateno=' || k || ', SubstrateID=W' || u || ', AcquiredID=A' || k END"""

_STATE = """CASE WHEN event_type = 'CarrierObject::StateChange' THEN
    CASE WHEN id_read = 'YES' AND slot_read = 'YES' THEN 'Carrier ID / Slot Map Read' WHEN id_read = 'YES' THEN 'Carrier ID Read' ELSE 'Carrier StateChange' END
  WHEN event_type = 'CarrierObject::ClearCarrierInfo' THEN 'Carrier Released' WHEN event_type = 'LoadPortObject::StateChange' THEN 'LoadPort StateChange'
  ELSE event_type END"""

# Ports, spans and rows of carriers, from `C(carrier)`.
ROUNDTRIP = f"""
X AS (SELECT C.carrier, E.*, {_DETAILS} AS details FROM C JOIN E ON contains(lower(E.message), C.carrier)),
SP AS (SELECT carrier, min(t) AS a, max(t) AS b FROM X GROUP BY carrier),
PO AS (SELECT DISTINCT carrier, port AS p FROM X WHERE event_type IN ('CarrierObject::ClearCarrierInfo', 'LoadPortObject::StateChange')),
R0 AS (
  SELECT carrier, 0 AS rank, event_id, CASE WHEN event_type = 'CarrierObject::ClearCarrierInfo' THEN CAST(port AS VARCHAR) END AS port_no,
         CASE WHEN event_type = 'CarrierObject::StateChange' AND (id_read = 'NO' OR slot_read = 'NO') THEN 'WARN' ELSE 'OK' END AS level, {_STATE} AS state, details AS detail
  FROM X WHERE is_object_event
  UNION ALL
  SELECT PO.carrier, 0, event_id, CAST(E.port AS VARCHAR), 'OK', 'LoadPort StateChange', {_DETAILS}
  FROM E JOIN PO ON PO.p = E.port JOIN SP ON SP.carrier = PO.carrier
  WHERE event_type = 'LoadPortObject::StateChange' AND t BETWEEN a - INTERVAL 5 MINUTE AND b + INTERVAL 5 MINUTE
    AND NOT contains(lower(message), PO.carrier)
  UNION ALL
  SELECT carrier, 1, event_id, NULL, 'ERROR', 'Alarm', 'Alarm Code=' || (3000 + k) || ', ' || substring(first_line, 9)
  FROM E JOIN SP ON t BETWEEN a - INTERVAL 5 MINUTE AND b + INTERVAL 5 MINUTE
  WHERE is_alarm AND (contains(lower(first_line), carrier) OR t BETWEEN a AND b)
  UNION ALL
  SELECT carrier, 2, event_id, NULL, 'OK', CASE WHEN ceid IS NOT NULL THEN 'CEID ' || ceid ELSE 'Carrier Related Log' END, trim(message)
  FROM X),
R1 AS (SELECT *, row_number() OVER (PARTITION BY carrier, event_id ORDER BY rank) AS pick FROM R0),
R2 AS (
  SELECT R1.*, E.time, E.source_file, E.line_no, E.log_type AS source,
         CAST(epoch_ms(t) - epoch_ms(lag(t) OVER (PARTITION BY carrier ORDER BY t, source_file, line_no)) AS BIGINT) AS gap_ms
  FROM R1 JOIN E USING (event_id) WHERE pick = 1),
R3 AS (SELECT * REPLACE (CASE WHEN level = 'OK' AND gap_ms >= 30000 THEN 'WARN' ELSE level END AS level) FROM R2)
"""

_OBJECT = "CASE WHEN event_type IS NOT NULL THEN string_split(event_type, '::')[1] END"

# Candidate values of an entry, as (rank in lookup order, label, value).
CANDIDATES = f"""
K0 AS (
  SELECT E.source_file, E.line_no, unnest([
      {{'label': 'SxFy', 'value': CASE WHEN is_secs THEN 'S6F11' END}},
      {{'label': 'CEID', 'value': CAST(E.ceid AS VARCHAR)}},
      {{'label': 'event name', 'value': nullif(EN.name, '')}},
      {{'label': 'object', 'value': {_OBJECT}}},
      {{'label': 'object', 'value': CASE WHEN event_type = 'LoadPortObject::StateChange' THEN 'PortObject' END}},
      {{'label': 'Carrier ID', 'value': CASE WHEN event_type IN ('CarrierObject::StateChange', 'CarrierObject::ClearCarrierInfo') THEN 'LOT' || u END}},
      {{'label': 'Substrate ID', 'value': CASE WHEN event_type = 'SubstrateObject::Initialize' THEN 'W' || u END}},
      {{'label': 'Acquired ID', 'value': CASE WHEN event_type = 'SubstrateObject::Initialize' THEN 'A' || k END}},
      {{'label': 'Port No', 'value': CASE WHEN event_type = 'LoadPortObject::StateChange' THEN CAST(port AS VARCHAR) END}},
      {{'label': 'Location ID', 'value': CASE WHEN event_type = 'LoadPortObject::StateChange' THEN 'LP' || port END}},
      {{'label': 'Carrier Index', 'value': CASE WHEN event_type = 'CarrierObject::StateChange' THEN CAST(k AS VARCHAR) END}}
    ]) AS c, generate_subscripts([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11], 1) AS i
  FROM E LEFT JOIN EN ON EN.ceid = E.ceid),
K AS (SELECT source_file, line_no, row_number() OVER (PARTITION BY source_file, line_no ORDER BY i) - 1 AS rank, c.label AS label, c.value AS value
      FROM K0 WHERE c.value IS NOT NULL)
"""


def _annotated(ceid_line: str, rpt_line: str, value1: str, value2: str) -> str:
    return f"""
SELECT source_file, line_no, 'SEND S6F11W' || chr(10) || '  <L [3]>' || chr(10) || '    <U4 [1] 0>' || chr(10)
  || '    <U4 [1] ' || E.ceid || '>' || {ceid_line} || chr(10) || '    <L [1]>' || chr(10) || '      <L [2]>' || chr(10)
  || '        <U4 [1] ' || E.rptid || '>' || {rpt_line} || chr(10) || '        <L [2]>' || chr(10)
  || '          <A [' || length('LOT' || u) || '] LOT' || u || '>' || {value1} || chr(10) || '          <U4 [1] ' || cents || '>' || {value2}
  || CASE WHEN k % 5 = 0 THEN chr(10) || '  note ' || k ELSE '' END AS display_message
FROM E LEFT JOIN EN ON EN.ceid = E.ceid
  LEFT JOIN RV a ON a.rptid = E.rptid AND a.position = 1 LEFT JOIN RV b ON b.rptid = E.rptid AND b.position = 2
WHERE is_secs"""


_CEID_TEXT = "CASE WHEN coalesce(EN.name, '') <> '' THEN ' // (CEID ' || E.ceid || ') ' || EN.name ELSE '' END"


def _near(select: str) -> str:
    """Rows around the first alarm of the second day and later."""
    return _events(
        f""", Z AS (SELECT min(timeline_index) AS c FROM E WHERE is_alarm AND t >= TIMESTAMP '2024-01-02'),
G AS (SELECT E.*, epoch_ms(t) - epoch_ms(lag(t) OVER (ORDER BY timeline_index)) AS gap_ms, timeline_index - c AS step FROM E, Z),
N AS (SELECT *, CASE WHEN step = 0 THEN 'CENTER' WHEN step < 0 THEN 'before' ELSE 'after' END AS marker FROM G WHERE step BETWEEN -5 AND 5)
{select}""",
        DIMS,
    )


#: Labelled values of the rows before the problem, in order of appearance.
_SIGNALS = """S0 AS (SELECT step, unnest([CASE WHEN N.ceid IS NOT NULL THEN 'CEID ' || N.ceid || CASE WHEN coalesce(EN.name, '') <> '' THEN ' (' || EN.name || ')' ELSE '' END END,
  CASE WHEN is_secs THEN 'SxFy S6F11W' END, CASE WHEN event_type LIKE 'Carrier%' THEN 'Carrier LOT' || u END,
  CASE WHEN event_type = 'SubstrateObject::Initialize' THEN 'Substrate W' || u END, CASE WHEN event_type = 'SubstrateObject::Initialize' THEN 'Acquired A' || k END,
  CASE WHEN event_type = 'LoadPortObject::StateChange' THEN 'Port ' || port END, CASE WHEN event_type = 'LoadPortObject::StateChange' THEN 'Port LP' || port END]) AS label,
  generate_subscripts([1, 2, 3, 4, 5, 6, 7], 1) AS i FROM N LEFT JOIN EN ON EN.ceid = N.ceid WHERE step < 0),
S1 AS (SELECT label, min(step * 10 + i) AS o FROM S0 WHERE label IS NOT NULL GROUP BY label ORDER BY o LIMIT 8)"""


def _short(text: str, limit: int) -> str:
    flat = f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN length({flat}) <= {limit} THEN {flat} ELSE rtrim(substring({flat}, 1, {limit - 3})) || '...' END"


def _report() -> str:
    """The report's lines over the whole event log, searched for LOT12 or alarm."""
    spot = "'[' || log_type || '] ' || source_file || ':' || line_no"
    lines = [
        "SELECT 1 AS section, CAST(0 AS DOUBLE) AS ord, '# Log Analysis Report' AS text",
        "SELECT 1, 1, ''",
        "SELECT 1, 2, '- Generated: 2024-02-01 00:00:00'",
        "SELECT 1, 10, '- Total parsed entries: ' || count(*) FROM E",
        "SELECT 1, 11, '- MMI entries: ' || count(*) FILTER (NOT is_secs) FROM E",
        "SELECT 1, 12, '- SECS entries: ' || count(*) FILTER (is_secs) FROM E",
        "SELECT 1, 20, '- Search keyword: OR: LOT12, alarm'",
        "SELECT 1, 21, ''",
        "SELECT 3, 0, '## Investigation Hints'",
        """SELECT 3, 11, '- Log span: ' || f || ' -> ' || l || ' (' || CASE WHEN d = 0 THEN '' WHEN d = 1 THEN '1 day, ' ELSE d || ' days, ' END
  || (ms // 3600000 % 24) || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0')
  || CASE WHEN ms % 1000 = 0 THEN '' ELSE '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') || '000' END || ')'
FROM (SELECT min(time) AS f, max(time) AS l, epoch_ms(max(t)) - epoch_ms(min(t)) AS ms, ms // 86400000 AS d FROM E)""",
        f"SELECT 3, 12, '- First alarm: ' || time || ' code=' || (3000 + k) || ' | ' || {_short('substring(first_line, 9)', 120)} FROM N WHERE step = 0",
        f"SELECT 3, 13, '- First Fail/Alarm log: ' || time || ' ' || {spot} || ' | ' || level_name || ' | ' || {_short('message', 120)} FROM N WHERE step = 0",
        "SELECT 3, 14, '- Pre-problem signals: ' || signals FROM (SELECT string_agg(label, '; ' ORDER BY o) AS signals FROM S1) WHERE signals IS NOT NULL",
        f"""SELECT 3, 15, '- Largest pre-problem gap: ' || {_report_gap('gap_ms')} || ' before ' || time || ' ' || {spot}
FROM (SELECT * FROM N WHERE step BETWEEN -4 AND 0 AND gap_ms IS NOT NULL ORDER BY abs(gap_ms) DESC, step LIMIT 1)""",
        """SELECT 3, 16, '- Top CEID/Event: ' || string_agg('CEID ' || ceid || CASE WHEN name <> '' THEN ' (' || name || ')' ELSE '' END || ': ' || n || 'x', '; ' ORDER BY n DESC, f)
FROM (SELECT E.ceid, coalesce(EN.name, '') AS name, count(*) AS n, min(timeline_index) AS f FROM E LEFT JOIN EN ON EN.ceid = E.ceid WHERE is_secs GROUP BY ALL ORDER BY n DESC, f LIMIT 5)
HAVING count(*) > 0""",
        """SELECT 3, 17, '- Top matched keywords: ' || string_agg(w || ': ' || n || 'x', '; ' ORDER BY n DESC, f, i)
FROM (SELECT w, i, count(*) AS n, min(timeline_index) AS f FROM M, (VALUES ('LOT12', 1), ('alarm', 2)) AS t(w, i) WHERE contains(lower(message), lower(w)) GROUP BY ALL) HAVING count(*) > 0""",
        "SELECT 3, 100, ''",
        "SELECT 4, -100, '## Problem Context' FROM N WHERE step = 0",
        f"""SELECT 4, step, '- ' || marker || ': ' || time || ' ' || CASE WHEN {_report_gap('gap_ms')} = '' THEN '' ELSE {_report_gap('gap_ms')} || ' | ' END || {spot} || ' | '
  || coalesce(level_name, '') || ' | ' || {_short('message', 160)} FROM N""",
        "SELECT 4, 100, '' FROM N WHERE step = 0",
        "SELECT 5, -10, '## Alarm Summary'",
        "SELECT 5, 0, CASE WHEN count(*) = 0 THEN '- No alarms detected in the reported entries.' ELSE '- Total alarm events: ' || count(*) END FROM E WHERE is_alarm",
        """SELECT 5, row_number() OVER (ORDER BY n DESC, f), '- [' || n || 'x] ' || (3000 + k)
FROM (SELECT k, CAST(sum(coalesce(repeat_count, 1)) AS BIGINT) AS n, min(timeline_index) AS f FROM E WHERE is_alarm GROUP BY k ORDER BY n DESC, f LIMIT 20)""",
        "SELECT 5, 1e18, ''",
        "SELECT 6, -10, '## Object State Timeline'",
        "SELECT 6, 0, CASE WHEN count(*) = 0 THEN '- No object events detected in the reported entries.' ELSE '- Total object events: ' || count(*) END FROM E WHERE is_object_event",
        "SELECT 6, 1e17, '- ... and ' || (count(*) - 200) || ' more events' FROM E WHERE is_object_event HAVING count(*) > 200",
        f"""SELECT 6, row_number() OVER (ORDER BY timeline_index), '- ' || time || ' | ' || event_type || ' | ' || details
FROM (SELECT *, {_DETAILS} AS details FROM E WHERE is_object_event ORDER BY timeline_index LIMIT 200)""",
        "SELECT 6, 1e18, ''",
        "SELECT 7, -10, '## Keyword Search Results'",
        "SELECT 7, 0, CASE WHEN count(*) = 0 THEN '- No matches for: OR: LOT12, alarm' ELSE '- Matches: ' || count(*) END FROM M",
        "SELECT 7, 1e17, '- ... and ' || (count(*) - 100) || ' more matches' FROM M HAVING count(*) > 100",
        f"""SELECT 7, row_number() OVER (ORDER BY timeline_index), '- ' || time || ' ' || {spot} || ' - ' || substring(message, 1, 120)
FROM (SELECT * FROM M ORDER BY timeline_index LIMIT 100)""",
    ]
    return _events(
        f""", M AS (SELECT * FROM E WHERE contains(lower(message), 'lot12') OR contains(lower(message), 'alarm')),
Z AS (SELECT min(timeline_index) AS c FROM E WHERE is_alarm),
G AS (SELECT E.*, epoch_ms(t) - epoch_ms(lag(t) OVER (ORDER BY timeline_index)) AS gap_ms, timeline_index - c AS step FROM E, Z),
N AS (SELECT *, CASE WHEN step = 0 THEN 'CENTER' WHEN step < 0 THEN 'before' ELSE 'after' END AS marker FROM G WHERE step BETWEEN -5 AND 5),
{_SIGNALS},
T AS ({" UNION ALL ".join(lines)})
SELECT CAST(section AS INTEGER) AS section, CAST(ord AS DOUBLE) AS ord, text FROM T""",
        DIMS,
    )


def sql() -> dict[str, str]:
    return {
        "file_scan": _events(
            """, L AS (SELECT *, event_id // 4096 AS b, line_no - min(line_no) OVER (PARTITION BY source_file, event_id // 4096) AS own FROM E)
SELECT row_number() OVER (ORDER BY t, is_secs, source_file, own, b) - 1 AS timeline_index, log_type, source_file, CASE WHEN is_secs THEN NULL ELSE event_id END AS seq_index,
 time, message FROM L"""
        ),
        "ordered_ingest": _events(
            """, L AS (SELECT *, event_id // 4096 AS b, line_no - min(line_no) OVER (PARTITION BY source_file, event_id // 4096) AS own FROM E)
SELECT row_number() OVER (ORDER BY t, is_secs, source_file, own, b) - 1 AS timeline_index, log_type, source_file, CASE WHEN is_secs THEN NULL ELSE event_id END AS seq_index,
 time, message FROM L"""
        ),
        "incremental_ingest": _events(
            """, Z AS (SELECT min(source_file) AS f FROM E WHERE NOT is_secs AND event_id < 4096),
M AS (SELECT count(DISTINCT source_file || '/' || (event_id // 4096)) AS files, count(*) AS entries, CAST(sum(event_id) FILTER (NOT is_secs) AS BIGINT) AS s,
  CAST(sum(ceid) AS BIGINT) AS c, count(*) FILTER (source_file = f AND event_id < 4096) AS gone, CAST(coalesce(sum(event_id) FILTER (source_file = f AND event_id < 4096), 0) AS BIGINT) AS gs
  FROM E, Z)
SELECT CAST(1 AS BIGINT) AS run, CAST(0 AS BIGINT) AS hits, files AS misses, entries, s AS seq_sum, c AS ceid_sum FROM M
UNION ALL SELECT 2, files, 0, entries, s, c FROM M UNION ALL SELECT 3, 0, files, entries, s, c FROM M
UNION ALL SELECT 4, files - 1, 1, entries - gone + 1, s - gs + 7, c FROM M UNION ALL SELECT 5, files - 1, 0, entries - gone, s - gs, c FROM M
UNION ALL SELECT 6, 0, 2, entries - gone, s - gs, c FROM M"""
        ),
        "stale_sources": _events(
            "SELECT min(source_file) AS source_file FROM E WHERE NOT is_secs AND event_id < 4096 UNION SELECT max(source_file) FROM E WHERE NOT is_secs AND event_id < 4096"),
        "stream_ingest": _events("SELECT time, log_type, source_file, message FROM E"),
        "bookmark_store": _docs("SELECT seq_index, memo FROM B WHERE bookmarked"),
        "csv_round_trip": _docs(
            "SELECT time, 'MMI' AS type, source_file AS file, CAST(line_no AS VARCHAR) AS line, replace(message, chr(10), ' | ') AS message FROM D"),
        "level_file": """SELECT DISTINCT CAST(p_size AS BIGINT) AS color, coalesce(r_name, 'Level' || p_size) AS level_name FROM part LEFT JOIN region ON r_regionkey = p_size""",
        "context_all_alarms": _events(
            """, A AS (SELECT timeline_index AS anchor, CAST(unnest(range(-3, 4)) AS BIGINT) AS "offset" FROM E WHERE is_alarm)
SELECT anchor, "offset", CASE WHEN "offset" = 0 THEN 'CENTER' WHEN "offset" < 0 THEN 'before' ELSE 'after' END AS marker, source_file, line_no
FROM A JOIN E ON timeline_index = anchor + "offset" """),
        "time_windows_all_alarms": _events(
            "SELECT source_file, line_no, time FROM E WHERE EXISTS (SELECT 1 FROM E a WHERE a.is_alarm AND a.t BETWEEN E.t - INTERVAL 60 SECOND AND E.t + INTERVAL 60 SECOND)"),
        "mixed_entries": _mixed("SELECT source_file, line_no, time, log_type, message, ceid, sxfy_type, NOT is_secs AND k % 3 < 2 AS is_object_event FROM X"),
        "header_exclusion": _mixed(
            "SELECT source_file, line_no, ceid, sxfy_type FROM X WHERE is_secs AND NOT coalesce(ceid BETWEEN 10 AND 40 OR ceid BETWEEN 1000 AND 1050, false)"),
        "object_events_mixed": _mixed(
            """SELECT source_file, line_no, time, CASE k % 3 WHEN 0 THEN '[CMS]' ELSE 'DeletejobList' END AS event_type, CASE k % 3 WHEN 0 THEN '[CMS]' ELSE 'DeletejobList' END AS object_name,
 CASE k % 3 WHEN 0 THEN substring(message, 7) ELSE message END AS details FROM X WHERE NOT is_secs AND k % 3 < 2"""),
        "sxfy_catalogue_mixed": _mixed("SELECT DISTINCT sxfy_type FROM X WHERE is_secs"),
        "sxfy_filter_mixed": _mixed("SELECT source_file, line_no, log_type, sxfy_type FROM X WHERE NOT is_secs OR sxfy_type IN ('S1F3', 'S6F12')"),
        "top_sxfy_mixed": _mixed(
            "SELECT sxfy_type AS value, count(*) AS entries FROM X WHERE is_secs GROUP BY sxfy_type ORDER BY count(*) DESC, min(place) LIMIT 10"),
        "text_lines": r"""
WITH T AS (SELECT doc_id, string_split(text, chr(10)) AS parts, text FROM documents WHERE text <> ''),
V AS (SELECT doc_id, CASE WHEN ends_with(text, chr(10)) THEN parts[1:len(parts) - 1] ELSE parts END AS parts FROM T)
SELECT 'doc' || doc_id || '.txt' AS source_file, CAST(generate_subscripts(parts, 1) AS BIGINT) AS line_no, unnest(parts) AS value FROM V""",
        "file_line_counts": _events("SELECT source_file, CAST(sum(n) AS BIGINT) AS line_count FROM E GROUP BY source_file"),
        "line_numbers": _events("SELECT source_file, line_no, prefix || first_line || suffix AS value FROM E"),
        "file_inventory": _events(
            "SELECT max(log_type) AS type, source_file, CAST(sum(n) AS BIGINT) AS line_count, count(*) AS entries FROM E GROUP BY source_file"
        ),
        "mmi_entries": _events(
            """SELECT source_file, line_no, time, CAST(CASE WHEN is_alarm THEN 31 ELSE 21 END AS BIGINT) AS color_index, event_id AS seq_index,
 level_name, message, raw_line, repeat_count, is_alarm, is_object_event FROM E WHERE NOT is_secs"""
        ),
        "secs_entries": _events(
            """SELECT source_file, line_no, time, CAST(1 AS BIGINT) AS channel, message, ceid, 'S6F11' AS sxfy_type,
 CAST(rptid AS VARCHAR) AS rptids FROM E WHERE is_secs"""
        ),
        "conversation_entries": r"""
WITH C0 AS (SELECT *, conv_id * 1000 + turn AS turn_id, string_split(text, chr(10)) AS parts, conv_id // 3600 % 24 AS h,
              conv_id * 1000 % 3600000 + turn AS ms FROM conversations),
C AS (SELECT *, '2024-03-01 ' || lpad(CAST(h AS VARCHAR), 2, '0') || '.log' AS source_file,
        CAST(1 + coalesce(sum(1 + len(parts)) OVER (PARTITION BY h ORDER BY turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_no FROM C0)
SELECT source_file, line_no, strftime(TIMESTAMP '2024-03-01' + to_milliseconds(ms), '%Y-%m-%d %H:%M:%S:%g') AS time,
  turn % 9 + 1 AS channel,
  array_to_string(list_concat([role], ['  ' || rtrim(x) FOR x IN parts IF NOT regexp_full_match(x, '\s*')]), chr(10)) AS message
FROM C""",
        "document_entries": _docs("SELECT source_file, line_no, time, seq_index, message FROM D"),
        "dialects": f"WITH {FILES} SELECT source_path, dialect FROM R WHERE head || parts[1] <> '' OR n > 1",
        "dialects_strict": f"""WITH {FILES}
SELECT source_path, CAST(CASE WHEN h = 0 THEN 1 ELSE 0 END AS BIGINT) AS mmi_headers, CAST(CASE WHEN h = 1 THEN 1 ELSE 0 END AS BIGINT) AS secs_headers,
  CASE h WHEN 0 THEN 'MMI' WHEN 1 THEN 'SECS' ELSE 'no header' END AS verdict FROM R WHERE head || parts[1] <> '' OR n > 1""",
        "dialect_fallback": rf"""WITH {FILES},
W AS (SELECT source_path, h, dialect, parts[1] AS first, [x FOR x IN parts[2:] IF NOT regexp_full_match(x, '\s*')] AS more FROM R
      WHERE (h = 0 AND dialect <> 'SECS') OR (h = 1 AND dialect <> 'MMI'))
SELECT source_path, CASE h WHEN 0 THEN 'MMI' ELSE 'SECS' END AS log_type, CAST(1 AS BIGINT) AS entries,
  CAST(CASE WHEN h = 0 THEN length(array_to_string(list_concat([first], more), chr(10))) ELSE length(trim(first)) END AS BIGINT) AS longest
FROM W""",
        "setup_dump_skip": f"WITH {SETUP} SELECT source_file, line_no, event_id AS seq_index, message FROM U WHERE NOT dropped",
        "setup_dump_flag": f"WITH {SETUP} SELECT source_file, line_no, event_id AS seq_index, state = 1 AS is_setup_dump FROM U",
        "load_counters": f"""WITH {SETUP} SELECT count(*) FILTER (NOT dropped) AS entries, count(*) FILTER (NOT dropped) AS mmi_entries,
 CAST(0 AS BIGINT) AS secs_entries, count(*) FILTER (dropped) AS skipped_setup_entries, CAST(0 AS BIGINT) AS entries_with_ceid FROM U""",
        "ceid_exclusion": _events(
            """SELECT source_file, line_no, ceid FROM E WHERE is_secs
 AND NOT (ceid BETWEEN 1000 AND 1020 OR ceid = 1050 OR ceid BETWEEN 1090 AND 1095)"""
        ),
        "ceid_in_ranges": _events("SELECT source_file, line_no, ceid FROM E WHERE ceid BETWEEN 1010 AND 1019 OR ceid BETWEEN 1080 AND 1085"),
        "sxfy_catalogue": "SELECT DISTINCT 'S6F11' AS sxfy_type FROM events WHERE event_type = 'purchase'",
        "level_names": """SELECT DISTINCT CAST(p_size AS BIGINT) AS color, coalesce(['Normal','Info','Warning','Fail','Debug','Trace','User','System',
 'Network','IO','Motion','SEQ','Vision','Recipe','Host','Remote','Database','Script','Safety','Maintenance','Calibration','CMS/GEM300','Material',
 'Process','Quality','Statistics','Report','Custom','Reserved','Reserved2','Reserved3','Alarm'][p_size + 1], 'Level' || p_size) AS level_name FROM part""",
        "secs_items": _events(
            """, I AS (SELECT source_file, line_no, unnest([
 {'l': 1, 'ty': 'L', 'c': 3, 'v': '', 'p': NULL, 'o': NULL}, {'l': 2, 'ty': 'U4', 'c': 1, 'v': '0', 'p': 1, 'o': 1},
 {'l': 3, 'ty': 'U4', 'c': 1, 'v': CAST(ceid AS VARCHAR), 'p': 1, 'o': 2}, {'l': 4, 'ty': 'L', 'c': 1, 'v': '', 'p': 1, 'o': 3},
 {'l': 5, 'ty': 'L', 'c': 2, 'v': '', 'p': 4, 'o': 1}, {'l': 6, 'ty': 'U4', 'c': 1, 'v': CAST(rptid AS VARCHAR), 'p': 5, 'o': 1},
 {'l': 7, 'ty': 'L', 'c': 2, 'v': '', 'p': 5, 'o': 2}, {'l': 8, 'ty': 'A', 'c': length('LOT' || u), 'v': 'LOT' || u, 'p': 7, 'o': 1},
 {'l': 9, 'ty': 'U4', 'c': 1, 'v': CAST(cents AS VARCHAR), 'p': 7, 'o': 2}]) AS x FROM E WHERE is_secs)
SELECT source_file, line_no, CAST(x.l AS BIGINT) AS item_line, x.ty AS item_type, CAST(x.c AS BIGINT) AS item_count, x.v AS value,
 CAST(x.p AS BIGINT) AS parent_line, CAST(x.o AS BIGINT) AS ordinal FROM I"""
        ),
        "timeline_index": _events("SELECT source_file, line_no, log_type, timeline_index FROM E"),
        "position_lookup": _events("SELECT source_file, line_no, timeline_index FROM E WHERE is_alarm"),
        "gaps": _events(
            f""", G AS (SELECT source_file, line_no, row_number() OVER (ORDER BY timeline_index) - 1 AS position,
 epoch_ms(t) - epoch_ms(lag(t) OVER (ORDER BY timeline_index)) AS gap_ms FROM E WHERE is_secs)
SELECT source_file, line_no, position, gap_ms, {_gap_text('gap_ms')} AS gap FROM G"""
        ),
        "gaps_unindexed": _events(
            f""", G AS (SELECT source_file, line_no, timeline_index AS position, epoch_ms(t) - epoch_ms(lag(t) OVER (ORDER BY timeline_index)) AS gap_ms FROM E)
SELECT source_file, line_no, position, gap_ms, {_gap_text('gap_ms')} AS gap FROM G"""
        ),
        "report_gaps": _events(
            f""", G AS (SELECT source_file, line_no, epoch_ms(t) - epoch_ms(lag(t) OVER (ORDER BY timeline_index)) AS gap_ms FROM E)
SELECT source_file, line_no, {_report_gap('gap_ms')} AS gap FROM G"""
        ),
        "context_rows": _events(
            """SELECT a.timeline_index AS anchor, b.timeline_index - a.timeline_index AS "offset",
 CASE WHEN b.timeline_index = a.timeline_index THEN 'CENTER' WHEN b.timeline_index < a.timeline_index THEN 'before' ELSE 'after' END AS marker,
 b.source_file, b.line_no FROM E a JOIN E b ON b.timeline_index BETWEEN a.timeline_index - 3 AND a.timeline_index + 3
WHERE a.is_alarm AND a.repeat_count = 3"""
        ),
        "page": _events("SELECT timeline_index, source_file, line_no FROM E WHERE timeline_index BETWEEN 750 AND 999"),
        "centred_window": _events(
            """, W AS (SELECT least(500, count(*)) AS w, count(*) AS n FROM E), V AS (SELECT w, greatest(0, least(60 - w // 2, n - w)) AS s FROM W)
SELECT timeline_index, source_file, line_no FROM E, V WHERE timeline_index >= s AND timeline_index < s + w"""
        ),
        "first_rows": _events("SELECT source_file, line_no, time FROM E WHERE timeline_index < 300"),
        "order_check": "SELECT count(*) AS entries, CAST(0 AS BIGINT) AS violations FROM events",
        "digests": _events(
            """SELECT source_file, line_no, sha256(time || '|' || CASE WHEN is_secs THEN 'Secs' ELSE 'Mmi' END || '|' || source_file || '|' || line_no
 || '|' || replace(message, 'S6F11W', 'S6F11') || chr(10)) AS sha256 FROM E"""
        ),
        "changed_ranges": _events(
            """ SELECT timeline_index // 64 * 64 AS first, timeline_index // 64 * 64 + 63 AS last, n AS left_rows, n AS right_rows
FROM (SELECT timeline_index, message, count(*) OVER (PARTITION BY timeline_index // 64) AS n FROM E)
WHERE starts_with(message, '[ALARM] Alarm Code [3007] unit 1') GROUP BY ALL"""
        ),
        "timeline_digest": _events(
            """, H AS (SELECT sha256(timeline_index || '|' || time || '|' || CASE WHEN is_secs THEN 'Secs' ELSE 'Mmi' END || '|' || source_file || '|' || line_no
 || '|' || replace(message, 'S6F11W', 'S6F11') || chr(10)) AS h FROM E)
SELECT count(*) AS entries, """ + " || '-' || ".join(f"CAST(sum(CAST('0x' || substring(h, {8 * i + 1}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8)) + """ AS digest FROM H"""
        ),
        "type_filter": _events("SELECT source_file, line_no, log_type FROM E WHERE is_secs"),
        "sxfy_filter": _events("SELECT log_type, count(*) AS entries FROM E WHERE NOT is_secs GROUP BY log_type"),
        "time_range": _events("SELECT source_file, line_no, time FROM E WHERE t BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-09 18:30:00'"),
        "time_inputs": """
WITH X AS (SELECT event_id, TIMESTAMP '2026-07-02' + (date_trunc('minute', ts) - date_trunc('day', ts)) AS a,
  TIMESTAMP '2026-07-02' + (date_trunc('second', ts + to_hours(CAST(user_id % 24 AS INTEGER))) - date_trunc('day', ts + to_hours(CAST(user_id % 24 AS INTEGER)))) AS b FROM events)
SELECT event_id, strftime(a, '%Y-%m-%d %H:%M:%S:%g') AS start, strftime(CASE WHEN b < a THEN b + INTERVAL 1 DAY ELSE b END, '%Y-%m-%d %H:%M:%S:%g') AS "end" FROM X""",
        "time_windows": _events(
            """SELECT DISTINCT b.source_file, b.line_no, b.time FROM E a JOIN E b ON b.t BETWEEN a.t - INTERVAL 5 MINUTE AND a.t + INTERVAL 5 MINUTE
WHERE a.is_alarm AND a.k IN (10, 20, 30)"""
        ),
        "time_window_one": _events("SELECT source_file, line_no, time FROM E WHERE t BETWEEN TIMESTAMP '2024-01-10 11:00:00' AND TIMESTAMP '2024-01-10 13:00:00'"),
        "after_anchor": _events("SELECT source_file, line_no, time FROM E WHERE t >= TIMESTAMP '2024-01-28'"),
        "before_anchor": _events("SELECT source_file, line_no, time FROM E WHERE t <= TIMESTAMP '2024-01-04'"),
        "bookmark_only": _docs("SELECT seq_index FROM B WHERE bookmarked"),
        "bookmark_exception": _docs(
            f"""SELECT seq_index, CASE WHEN {_has('tion')} AND NOT {_has('que')} THEN 'tion' ELSE '' END AS matched_keywords FROM B
WHERE ({_has('tion')} AND NOT {_has('que')}) OR bookmarked"""
        ),
        "bookmark_decoration": _docs("SELECT seq_index, bookmarked, memo FROM B"),
        "bookmark_timeline": _docs(
            ", O AS (SELECT *, row_number() OVER (ORDER BY t, source_file, line_no) - 1 AS position FROM B) SELECT time, 'MMI' AS type, memo, position FROM O WHERE bookmarked"
        ),
        "display_rows": _docs(
            """SELECT CASE WHEN bookmarked THEN 'yes' ELSE '' END AS bookmark, replace(memo, chr(10), ' ') AS memo, time, '' AS time_delta, 'MMI' AS type,
 '' AS matched_keywords, 'Info' AS level_channel, '' AS ceid, '' AS event_name, source_file AS file, CAST(line_no AS VARCHAR) AS line,
 replace(message, chr(10), ' | ') AS message FROM B"""
        ),
        "log_text": _events(
            """SELECT source_file, line_no, CASE WHEN suffix <> '' THEN raw_line ELSE prefix || message END AS text FROM E"""
        ),
        "composed_filter": _events(
            f"""SELECT source_file, line_no, log_type, CASE WHEN is_secs THEN 'S6F11W' ELSE 'carrierobject, slotmap_read: yes' END AS matched_keywords FROM E
WHERE t BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20' AND NOT {_has('note')}
 AND (is_secs OR ({_has('carrierobject')} AND {_has('slotmap_read: yes')}))"""
        ),
        "composed_without_keywords": _events(
            "SELECT source_file, line_no, '' AS matched_keywords FROM E WHERE NOT is_secs AND t >= TIMESTAMP '2024-01-30'"
        ),
        "sxfy_normalised": _events("SELECT source_file, line_no, replace(message, 'S6F11W', 'S6F11') AS message FROM E"),
        "keyword_literal": _docs(f"SELECT seq_index, {_spelled(['der'])} AS matched_text, 'der' AS keyword FROM D WHERE {_has('der')}"),
        "keyword_case_sensitive": _docs("SELECT seq_index, 'The' AS keyword FROM D WHERE contains(message, 'The')"),
        "keyword_accented": _docs(f"SELECT seq_index, 'ÉTION' AS keyword FROM D WHERE {_has('étion')}"),
        "keyword_regex": _events(
            """, M AS (SELECT source_file, line_no, 'LOT' || u AS w, CASE WHEN event_type IN ('CarrierObject::StateChange', 'CarrierObject::ClearCarrierInfo') OR is_secs
 THEN 'LOT' || u END AS lot FROM E)
SELECT source_file, line_no, w AS matched_text FROM M WHERE lot IS NOT NULL AND regexp_full_match(w, 'LOT1[0-4]+')"""
        ),
        "keyword_named_group": _events(
            """, M AS (SELECT source_file, line_no, u, event_type IN ('CarrierObject::StateChange', 'CarrierObject::ClearCarrierInfo') OR is_secs AS has FROM E)
SELECT source_file, line_no, 'LOT' || u AS matched_text FROM M WHERE coalesce(has, false) AND u BETWEEN 11 AND 99 AND u % 11 = 0"""
        ),
        "keyword_annotated": "SELECT source_file, line_no, 'NATION_7' AS matched_text FROM ("
        + _events(_annotated(_CEID_TEXT, "''", "coalesce(rtrim(' // (' || a.vid || ') ' || a.name), '')", "coalesce(rtrim(' // (' || b.vid || ') ' || b.name), '')"), DIMS)
        + ") WHERE contains(lower(display_message), 'nation_7')",
        "keyword_bad_regex": _events("SELECT source_file, line_no, '[ALARM' AS matched_text FROM E WHERE is_alarm"),
        "keyword_sxfy": _events("SELECT source_file, line_no, 'S6F11' AS matched_text, 's6f11' AS keyword FROM E WHERE is_secs"),
        "keyword_and_or_exclude": _docs(
            f"""SELECT seq_index, {_spelled(['tion', 'and', 'sch', 'leaux'])} AS matched_text, {_matched(['tion', 'and', 'sch', 'leaux'])} AS keyword FROM D
WHERE (({_has('tion')} AND {_has('and')}) OR {_has('sch')} OR {_has('leaux')}) AND NOT {_has('querb')} AND NOT {_has('xy')}"""
        ),
        "keyword_any_of": _docs(f"SELECT seq_index, {_matched(['schen', 'ellex'])} AS keyword FROM D WHERE {_has('schen')} OR {_has('ellex')}"),
        "keyword_exclude_only": _docs(f"SELECT seq_index, '' AS matched_text, '' AS keyword FROM D WHERE NOT {_has('and')}"),
        "keyword_matrix": _docs(
            """, W AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+')) AS keyword FROM benchmark), LD AS (SELECT lower(message) AS m FROM D)
SELECT keyword, count(*) AS documents FROM W JOIN LD ON contains(m, keyword) GROUP BY keyword"""
        ),
        "keyword_matrix_list": _events(
            """, W AS (SELECT unnest(['LOT7', 'alarm code', 'slotmap_read: no', 's6f11', '<u4 [1] 0>']) AS keyword)
SELECT source_file, line_no, keyword FROM W JOIN E ON contains(lower(message), lower(keyword))"""
        ),
        "keyword_combinations": _events(
            """, L AS (SELECT timeline_index, lower(message) AS m FROM E)
SELECT 'all of two' AS combination, timeline_index FROM L WHERE contains(m, 'slotmap_read: no') AND contains(m, 'lot7')
UNION ALL SELECT 'any of two', timeline_index FROM L WHERE contains(m, 'alarm code') OR contains(m, 'lot7')
UNION ALL SELECT 'one or another, without a third', timeline_index FROM L WHERE (contains(m, 's6f11') OR contains(m, 'alarm code')) AND NOT contains(m, 'note')
UNION ALL SELECT 'without one', timeline_index FROM L WHERE NOT contains(m, 'statechange')
UNION ALL SELECT 'nowhere', timeline_index FROM L WHERE contains(m, 'lot7') AND NOT contains(m, 'o')"""
        ),
        "keyword_hits": _docs(
            """, W AS (SELECT unnest(['tion', 'the', 'und', 'les', 'sch', 'zz']) AS keyword, generate_subscripts([1, 2, 3, 4, 5, 6], 1) AS i),
H AS (SELECT keyword, i, count(*) AS hits, min(struct_pack(t := t, f := source_file, l := line_no)) AS first FROM W JOIN D ON contains(lower(message), keyword) GROUP BY keyword, i)
SELECT keyword, hits FROM H ORDER BY hits DESC, first, i LIMIT 5"""
        ),
        "reference_name_search": _events("SELECT source_file, line_no FROM E WHERE ceid IN (SELECT ceid FROM EN WHERE contains(lower(name), 'widget'))", DIMS),
        "reference_variable_search": _events(
            "SELECT source_file, line_no FROM E WHERE is_secs AND rptid IN (SELECT rptid FROM RV WHERE contains(lower(name), 'nation_7'))", DIMS
        ),
        "find_in_results": _events(
            """, O AS (SELECT message, row_number() OVER (ORDER BY timeline_index) - 1 AS position FROM E WHERE is_secs)
SELECT position FROM O WHERE contains(lower(message), 'lot11')"""
        ),
        "find_next": _events(
            """, A AS (SELECT timeline_index AS p FROM E WHERE is_alarm AND repeat_count = 1)
SELECT CAST(0 AS BIGINT) AS step, min(p) AS position FROM A UNION ALL SELECT 1, max(p) FROM A
UNION ALL SELECT 2, coalesce(min(p) FILTER (p > 500), min(p)) FROM A UNION ALL SELECT 3, coalesce(max(p) FILTER (p < 500), max(p)) FROM A
UNION ALL SELECT 4, min(p) FROM A UNION ALL SELECT 5, max(p) FROM A"""
        ),
        "highlight": _docs(
            """, Z AS (SELECT seq_index, [length(x) FOR x IN string_split(lower(message), 'tion')] AS c FROM D),
Y AS (SELECT seq_index, c, unnest(generate_series(1, len(c) - 1)) AS i FROM Z)
SELECT seq_index, 'tion' AS term, CAST(list_sum(c[1:i]) + 4 * (i - 1) AS BIGINT) AS start, CAST(list_sum(c[1:i]) + 4 * i AS BIGINT) AS "end" FROM Y"""
        ),
        "highlight_terms": _docs(
            """, P AS (SELECT unnest(['tion', '[aeiou]{2,}', '\\b(?:the|and)\\b']) AS term),
Z AS (SELECT seq_index, term, [length(x) FOR x IN string_split_regex(message, '(?i)' || term)] AS c,
 [length(x) FOR x IN regexp_extract_all(message, '(?i)' || term)] AS h FROM D, P),
Y AS (SELECT *, unnest(generate_series(1, len(h))) AS i FROM Z)
SELECT seq_index, term, CAST(list_sum(c[1:i]) + coalesce(list_sum(h[1:i - 1]), 0) AS BIGINT) AS start,
 CAST(list_sum(c[1:i]) + list_sum(h[1:i]) AS BIGINT) AS "end" FROM Y"""
        ),
        "gram_postings": _events(
            """, T AS (SELECT source_file, line_no // 256 AS b, lower(replace(message, 'S6F11W', 'S6F11')) AS m FROM E),
GR AS (SELECT DISTINCT source_file, b, substring(m, CAST(i AS BIGINT), 3) AS gram FROM T, unnest(generate_series(1, length(m) - 2)) AS s(i))
SELECT gram, count(*) AS blocks FROM GR GROUP BY gram"""
        ),
        "indexed_search": _docs(f"SELECT seq_index FROM D WHERE {_has('theswh')}"),
        "indexed_search_trigram": _docs("SELECT seq_index FROM D WHERE contains(message, 'Thent')"),
        "indexed_search_short": _docs(f"SELECT seq_index FROM D WHERE {_has('xr')}"),
        "indexed_search_accented": _docs(f"SELECT seq_index FROM D WHERE {_has('éaux')}"),
        "used_ceids": _events("SELECT DISTINCT ceid FROM E WHERE is_secs"),
        "used_rptids": _events("SELECT DISTINCT rptid FROM E WHERE is_secs"),
        "event_name_dimension": _events("SELECT ceid, name FROM EN WHERE ceid IN (SELECT ceid FROM E WHERE is_secs)", DIMS),
        "report_variable_dimension": _events("SELECT rptid, position, index_no, vid, name FROM RV WHERE rptid IN (SELECT rptid FROM E WHERE is_secs)", DIMS),
        "event_lookup": f"WITH {DIMS} SELECT ceid, name FROM EN WHERE contains(lower(name), 'ring') ORDER BY ceid",
        "event_lookup_wildcard": f"WITH {DIMS} SELECT ceid, name FROM EN WHERE CAST(ceid AS VARCHAR) LIKE '%1_5%' OR name ILIKE '%1_5%' ORDER BY ceid",
        "attach_names": _events("SELECT source_file, line_no, E.ceid, EN.name AS event_name FROM E LEFT JOIN EN ON EN.ceid = E.ceid WHERE is_secs", DIMS),
        "annotated_messages": _events(
            _annotated(_CEID_TEXT, "''", "coalesce(rtrim(' // (' || a.vid || ') ' || a.name), '')", "coalesce(rtrim(' // (' || b.vid || ') ' || b.name), '')"), DIMS
        ),
        "annotated_extended": _events(
            _annotated(_CEID_TEXT, "' // (RPTID ' || E.rptid || ')'", "coalesce(' // (VID ' || a.vid || ') ' || a.name, '')", "coalesce(' // (VID ' || b.vid || ') ' || b.name, '')"), DIMS
        ),
        "annotated_without_variables": _events(_annotated(_CEID_TEXT, "''", "''", "''"), DIMS),
        "alarms": _events(
            "SELECT source_file, line_no, time, CAST(3000 + k AS VARCHAR) AS alarm_code, substring(first_line, 9) AS message, repeat_count, 'Alarm' AS level_name FROM E WHERE is_alarm"
        ),
        "alarm_summary": _events("SELECT CAST(3000 + k AS VARCHAR) AS alarm, CAST(sum(coalesce(repeat_count, 1)) AS BIGINT) AS occurrences FROM E WHERE is_alarm GROUP BY k"),
        "object_events": _events(
            f"""SELECT source_file, line_no, time, event_type, {_OBJECT} AS object_name, {_DETAILS} AS details,
 CASE WHEN event_type LIKE '%::StateChange' THEN 'M' || (k % 3) END AS model,
 CASE WHEN event_type = 'CarrierObject::StateChange' THEN CAST(k AS VARCHAR) END AS carrier_idx,
 CASE WHEN event_type LIKE 'Carrier%' THEN 'LOT' || u END AS carrier_id,
 CASE WHEN event_type = 'CarrierObject::StateChange' THEN id_read END AS id_read,
 CASE WHEN event_type = 'CarrierObject::StateChange' THEN slot_read END AS slotmap_read,
 CASE WHEN event_type IN ('CarrierObject::ClearCarrierInfo', 'LoadPortObject::StateChange') THEN CAST(port AS VARCHAR) END AS port_no,
 CASE WHEN event_type = 'CarrierObject::ClearCarrierInfo' THEN CAST(port AS VARCHAR) END AS seq_port_no,
 CASE WHEN event_type = 'CarrierObject::ClearCarrierInfo' THEN CAST(port AS VARCHAR) END AS mmi_port_no,
 CASE WHEN event_type = 'LoadPortObject::StateChange' THEN 'LP' || port END AS loc_id,
 CASE WHEN event_type = 'SubstrateObject::Initialize' THEN CAST(k AS VARCHAR) END AS substrate_no FROM E WHERE is_object_event"""
        ),
        "object_event_filter": _events(
            """SELECT source_file, line_no, event_type FROM E WHERE event_type IN ('LoadPortObject::StateChange', 'SubstrateObject::Initialize')
 AND t BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-11'"""
        ),
        "events_per_type": _events("SELECT event_type, count(*) AS events FROM E WHERE is_object_event GROUP BY event_type"),
        "carrier_roundtrip": _events(
            """SELECT carrier, time, gap_ms, port_no, level,
 CASE WHEN state LIKE 'CEID %' AND coalesce(EN.name, '') <> '' THEN state || ' ' || EN.name ELSE state END AS state, detail, source, source_file, line_no
FROM R3 LEFT JOIN EN ON state = 'CEID ' || EN.ceid""",
            DIMS, "C AS (SELECT 'lot12' AS carrier)", ROUNDTRIP,
        ),
        "carrier_roundtrips": _events(
            """SELECT carrier, CASE WHEN state LIKE 'CEID %' THEN 'CEID' ELSE state END AS state, level, count(*) AS rows, CAST(sum(gap_ms) AS BIGINT) AS gap_ms
FROM R3 GROUP BY ALL""",
            "C AS (SELECT DISTINCT 'lot' || u AS carrier FROM E WHERE event_type LIKE 'Carrier%')", ROUNDTRIP,
        ),
        "related_candidates": _events("SELECT source_file, line_no, rank, label, value FROM K", DIMS, CANDIDATES),
        "flow_terms": _events(
            """, FT AS (SELECT source_file, line_no, value AS term, min(rank) AS r FROM K WHERE label IN ('Carrier ID', 'Substrate ID', 'Acquired ID', 'Location ID', 'CEID', 'event name')
 AND length(value) >= 3 GROUP BY ALL)
SELECT source_file, line_no, row_number() OVER (PARTITION BY source_file, line_no ORDER BY length(term) DESC, r) - 1 AS rank, term FROM FT""",
            DIMS, CANDIDATES,
        ),
        "related_search": _events(
            """, W AS (SELECT DISTINCT value AS keyword FROM K WHERE label <> 'event name'), L AS (SELECT lower(replace(message, 'S6F11W', 'S6F11')) AS m FROM E)
SELECT keyword, count(*) AS entries FROM W JOIN L ON contains(m, lower(keyword)) GROUP BY keyword""", DIMS, CANDIDATES
        ),
        "statistics": _events(
            """SELECT count(*) AS total, count(*) FILTER (NOT is_secs) AS mmi, count(*) FILTER (is_secs) AS secs, CAST(0 AS BIGINT) AS bookmarked,
 count(*) FILTER (is_alarm) AS alarms FROM E"""
        ),
        "statistics_bookmarked": _docs(
            f"""SELECT count(*) AS total, count(*) AS mmi, CAST(0 AS BIGINT) AS secs, count(*) FILTER (bookmarked) AS bookmarked,
 count(*) FILTER ({_has('[alarm]')} OR {_has('alarm code')}) AS alarms FROM B"""
        ),
        "top_sxfy": _events("SELECT 'S6F11' AS value, count(*) AS entries FROM E WHERE is_secs"),
        "top_ceids": _events(
            "SELECT CAST(ceid AS VARCHAR) AS value, count(*) AS entries FROM E WHERE is_secs GROUP BY ceid ORDER BY count(*) DESC, min(timeline_index) LIMIT 10"
        ),
        "top_event_names": _events(
            "SELECT name AS value, count(*) AS entries FROM E JOIN EN USING (ceid) WHERE name <> '' GROUP BY name ORDER BY count(*) DESC, min(timeline_index) LIMIT 10", DIMS
        ),
        "top_ceid_hints": _events(
            """SELECT E.ceid, coalesce(name, '') AS event_name, count(*) AS entries FROM E LEFT JOIN EN ON EN.ceid = E.ceid WHERE is_secs
GROUP BY E.ceid, name ORDER BY count(*) DESC, min(timeline_index) LIMIT 5""",
            DIMS,
        ),
        "log_span": _events(
            """SELECT strftime(min(t), '%Y-%m-%d %H:%M:%S:%g') AS first, strftime(max(t), '%Y-%m-%d %H:%M:%S:%g') AS last,
 epoch_ms(max(t)) - epoch_ms(min(t)) AS duration_ms FROM E"""
        ),
        "first_alarm": _events(
            "SELECT source_file, line_no, time, CAST(3000 + k AS VARCHAR) AS alarm_code, substring(first_line, 9) AS message FROM E WHERE is_alarm ORDER BY timeline_index LIMIT 1"
        ),
        "problem_entry": _events(
            "SELECT source_file, line_no, time, message FROM E WHERE is_alarm AND t >= TIMESTAMP '2024-01-02' ORDER BY timeline_index LIMIT 1"
        ),
        "problem_context": _near("SELECT marker, step, source_file, line_no, gap_ms FROM N"),
        "pre_problem_signals": _near(
            f""", {_SIGNALS}
SELECT string_agg(label, '; ' ORDER BY o) AS signals FROM S1"""
        ),
        "largest_gap": _near("SELECT source_file, line_no, gap_ms FROM N WHERE step BETWEEN -4 AND 0 ORDER BY gap_ms DESC, step LIMIT 1"),
        "report_scope": _events(
            """SELECT 'alarms' AS part, count(*) AS rows FROM E WHERE is_alarm AND t >= TIMESTAMP '2024-01-02'
UNION ALL SELECT 'events', count(*) FROM E WHERE is_object_event AND t >= TIMESTAMP '2024-01-02'"""
        ),
        "investigation_report": _report(),
        "report_files": f"""WITH R AS ({_report()}),
F AS (
  SELECT 'markdown' AS form, section, ord, 0 AS part, text FROM R
  UNION ALL SELECT 'text', section, ord, 0, CASE WHEN starts_with(text, '- ') THEN '  * ' || substring(text, 3) ELSE regexp_replace(text, '^#+ ', '') END FROM R
  UNION ALL SELECT 'text', section, ord, 1, repeat(CASE WHEN starts_with(text, '# ') THEN '=' ELSE '-' END, CAST(length(regexp_replace(text, '^#+ ', '')) AS INT))
  FROM R WHERE starts_with(text, '#')),
L AS (SELECT form, section, ord, part, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS piece FROM F)
SELECT form, row_number() OVER (PARTITION BY form ORDER BY section, ord, part, piece) AS line_no, text FROM L""",
        "filter_descriptions": _events(
            f""", SP AS (SELECT strftime(min(t), '%Y-%m-%d %H:%M:%S.%g') AS a, strftime(max(t), '%Y-%m-%d %H:%M:%S.%g') AS b FROM E),
W AS (SELECT *, {_has('carrierobject')} AND {_has('slotmap_read: yes')} OR {_has('lot12')} OR {_has('lot13')} AS hit FROM E)
SELECT 'all' AS spec, 'AND: carrierobject, slotmap_read: yes / OR: LOT12, LOT13 / 제외: note, alarm / 북마크 키워드 조건 예외 / 시간: ' || a || ' ~ ' || b AS description,
 (SELECT count(*) FROM W WHERE hit AND NOT {_has('note')} AND NOT {_has('alarm')}) AS entries FROM SP
UNION ALL SELECT 'from', '제외: note / 시간: ' || a || ' ~ ', (SELECT count(*) FROM W WHERE NOT {_has('note')}) FROM SP
UNION ALL SELECT 'words', 'AND: carrierobject, slotmap_read: yes / OR: LOT12, LOT13', count(*) FILTER (hit) FROM W
UNION ALL SELECT 'none', '', count(*) FROM W"""
        ),
        "xml_pieces": r"""WITH H AS (
  SELECT page_id, html, '<!--(?s:.*?)-->|<!\[CDATA\[(?s:.*?)\]\]>|</?[A-Za-z_][A-Za-z0-9_:.-]*(?:\s[^<>]*)?/?>' AS p FROM pages),
G AS (SELECT page_id, html, unnest(regexp_extract_all(html, p)) AS tag, unnest(string_split_regex(html, p)[:-2]) AS gap, generate_subscripts(regexp_extract_all(html, p), 1) AS i FROM H),
T0 AS (SELECT page_id, html, tag, i, sum(length(gap) + length(tag)) OVER (PARTITION BY page_id ORDER BY i) AS e, regexp_extract(tag, '^</?([A-Za-z_][A-Za-z0-9_:.-]*)', 1) AS name FROM G),
T AS (SELECT *, e - length(tag) AS s, CASE WHEN starts_with(tag, '</') THEN -1 WHEN ends_with(tag, '/>') THEN 0 ELSE 1 END AS step FROM T0
  WHERE name <> '' AND upper(name) NOT IN ('L', 'A', 'B', 'BOOLEAN', 'I1', 'I2', 'I4', 'I8', 'U1', 'U2', 'U4', 'U8', 'F4', 'F8')),
D AS (SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY i) + CASE WHEN step = -1 THEN 1 ELSE 0 END AS depth FROM T),
-- The closing tag of a start tag is the first later tag that comes down to its depth.
C AS (SELECT a.page_id, a.i, min(b.i) AS j FROM D a JOIN D b ON b.page_id = a.page_id AND b.i > a.i AND b.step = -1 AND b.depth = a.depth WHERE a.step = 1 GROUP BY ALL),
P AS (SELECT a.page_id, a.i, b.i AS j, a.s, b.e, a.name, a.html FROM C JOIN D a USING (page_id, i) JOIN D b ON b.page_id = C.page_id AND b.i = C.j WHERE a.name = b.name
  UNION ALL SELECT page_id, i, i, s, e, name, html FROM D WHERE step = 0),
Q AS (SELECT page_id, i FROM P UNION SELECT page_id, j FROM P),
N AS (SELECT D.page_id, D.i, D.step FROM D LEFT JOIN Q USING (page_id, i) WHERE Q.i IS NULL),
W AS (SELECT * FROM P WHERE NOT EXISTS (SELECT 1 FROM N WHERE N.page_id = P.page_id AND N.i BETWEEN P.i AND P.j)),
O AS (SELECT * FROM W WHERE NOT EXISTS (SELECT 1 FROM W v WHERE v.page_id = W.page_id AND v.i < W.i AND v.j >= W.j AND v.i <> W.i))
SELECT O.page_id, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", name, (SELECT count(*) FROM D WHERE D.page_id = O.page_id AND D.i BETWEEN O.i AND O.j AND D.step >= 0) AS tags,
 md5(substring(html, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT))) AS piece_md5 FROM O""",
        "line_diff": f"""WITH {PAIRS},
LL AS (SELECT pair_id, unnest(string_split(l, chr(10))) AS line, generate_subscripts(string_split(l, chr(10)), 1) AS no FROM PR),
RR AS (SELECT pair_id, unnest(string_split(r, chr(10))) AS line, generate_subscripts(string_split(r, chr(10)), 1) AS no FROM PR),
L1 AS (SELECT *, row_number() OVER (PARTITION BY pair_id, line ORDER BY no) AS occurrence FROM LL),
R1 AS (SELECT *, row_number() OVER (PARTITION BY pair_id, line ORDER BY no) AS occurrence FROM RR)
SELECT pair_id, CASE WHEN R1.no IS NULL THEN 'delete' WHEN L1.no IS NULL THEN 'insert' ELSE 'equal' END AS mark, line, occurrence,
 CAST(L1.no AS BIGINT) AS left_no, CAST(R1.no AS BIGINT) AS right_no FROM L1 FULL JOIN R1 USING (pair_id, line, occurrence)""",
    }
