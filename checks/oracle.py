"""DuckDB statements that compute the same answers as ``checks.queries``.

The driver registers the input tables as views; each statement derives its
fixture in a WITH clause (the DuckDB form of ``checks.fixtures``).
"""

from __future__ import annotations

from checks.fixtures import STOCK_PHRASES
from palaver.operators.phrases import DEFAULT_TERMS
from palaver.functions.errors import TAXONOMY as ERROR_CLASSES

# --- derived fixtures (DuckDB dialect) -------------------------------------

JOBS = """jobs AS (
  SELECT CAST(event_id AS VARCHAR) AS job_id,
         'https://example.com/audio/' || CAST(event_id AS VARCHAR) || '.mp3' AS url,
         CASE event_type WHEN 'view' THEN 'PROCESSING' WHEN 'purchase' THEN 'COMPLETED'
                         WHEN 'error' THEN 'FAILED' ELSE 'PENDING' END AS status,
         CASE user_id % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS priority,
         CASE WHEN event_type IN ('signup', 'click') THEN ts
              ELSE TIMESTAMP '2024-01-31 18:00:00' END AS created_at,
         CASE event_type
           WHEN 'view' THEN TIMESTAMP '2024-02-01 00:00:00' - INTERVAL '1' MINUTE * (event_id % 61)
           WHEN 'purchase' THEN TIMESTAMP '2024-02-01 00:00:00' - INTERVAL '1' MINUTE * (event_id % 121 + 5)
         END AS started_at,
         CASE WHEN event_type IN ('purchase', 'error')
              THEN TIMESTAMP '2024-02-01 00:00:00' - INTERVAL '1' MINUTE * (event_id % 121) END AS completed_at,
         CASE WHEN event_type = 'error' THEN 'Unsupported audio format: .flac' END AS error_message
  FROM events)"""

JOBS_DIRTY = """jobs_dirty AS (
  SELECT CAST(event_id AS VARCHAR) AS job_id,
         CASE event_type WHEN 'view' THEN 'PROCESSING' WHEN 'purchase' THEN 'COMPLETED'
                         WHEN 'error' THEN 'FAILED' ELSE 'PENDING' END AS status,
         CASE WHEN event_id % 7 = 0 THEN 'boom' WHEN event_id % 7 = 1 THEN ''
              WHEN event_type = 'error' AND event_id % 7 <> 2 THEN 'boom' END AS error_message,
         CASE WHEN event_id % 5 = 0 THEN event_type <> 'purchase'
              ELSE event_type = 'purchase' END AS has_transcript
  FROM events)"""

JOB_EVENTS = """job_events AS (
  SELECT CAST(user_id AS VARCHAR) || '-' || substr(CAST(ts AS VARCHAR), 1, 10) AS job_id,
         event_id AS seq, ts,
         CASE event_type WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'complete'
                         WHEN 'error' THEN 'fail' WHEN 'click' THEN 'start' ELSE 'complete' END AS kind
  FROM events)"""

URL_SUBMISSIONS = """url_submissions AS (
  SELECT page_id,
         CASE WHEN page_id % 17 = 0 THEN 'ftp' || substr(u, CASE WHEN u LIKE 'https:%' THEN 6 ELSE 5 END)
              ELSE u END AS url,
         CASE page_id % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'HIGH' ELSE 'MEDIUM' END AS priority
  FROM (SELECT page_id,
               regexp_replace(regexp_replace(url, '[?#].*$', ''), '([.]html|/)$', '') ||
               CASE page_id % 9 WHEN 0 THEN '.mp3' WHEN 1 THEN '.WAV' WHEN 2 THEN '.m4a'
                 WHEN 3 THEN '.mp4' WHEN 4 THEN '.webm' WHEN 5 THEN '.flac' WHEN 6 THEN ''
                 WHEN 7 THEN '.mp3?x=1.ogg' ELSE '.d/track' END AS u
        FROM pages) a)"""

URL_PROBE = """url_probe AS (
  SELECT page_id,
         CASE WHEN page_id % 19 = 3 THEN 'timeout' WHEN page_id % 23 = 4 THEN 'client_error' ELSE 'ok' END AS outcome,
         CASE WHEN page_id % 11 = 5 THEN 404 WHEN page_id % 11 = 6 THEN 301 ELSE 200 END AS http_status,
         CASE WHEN page_id % 13 = 0 THEN NULL ELSE page_id * 1048576 END AS content_length,
         CASE page_id % 3 WHEN 0 THEN 'audio/mpeg' WHEN 1 THEN 'video/mp4; codecs=x' ELSE 'text/html' END AS content_type
  FROM pages)"""

DOC_TRANSCRIPTS = """doc_transcripts AS (
  SELECT CAST(doc_id AS VARCHAR) AS job_id, text, lang AS language,
         length(text) / CAST(16 AS DOUBLE) AS duration
  FROM documents)"""

def json_text(x: str) -> str:
    """A text as the inside of a JSON string."""
    out = f"coalesce({x}, '')"
    for a, b in (("'\\'", r"'\\'"), ("'\"'", "'\\\"'"), ("chr(10)", r"'\n'"), ("chr(13)", r"'\r'"), ("chr(9)", r"'\t'")):
        out = f"replace({out}, {a}, {b})"
    return f"regexp_replace({out}, '[\\x00-\\x1f]', ' ', 'g')"


def _scored(score: str) -> str:
    return f"""'{{"conversation_type": "COMEDY", "topics": [{{"name": "a", "confidence_score": {score}}}]' || points || '}}'"""


LLM_RESPONSES = f"""llm_responses AS (
  SELECT CAST(doc_id AS VARCHAR) AS transcript_id,
         CASE doc_id % 24
           WHEN 0 THEN '```json' || chr(10) || good || chr(10) || '```'
           WHEN 1 THEN good
           WHEN 2 THEN '  ' || good || '  '
           WHEN 3 THEN 'JSON ' || good
           WHEN 4 THEN '```' || chr(10) || good || chr(10) || '```'
           WHEN 5 THEN 'I cannot answer that: ' || coalesce(text, '')
           WHEN 6 THEN '{{"conversation_type": "CASUAL", "topics": ' || topics || '}}'
           WHEN 7 THEN '{{"conversation_type": "casual", "topics": []' || points || '}}'
           WHEN 8 THEN '{{"conversation_type": "FORMAL", "topics": [{{"name": "' || name || '"}}]' || points || '}}'
           WHEN 9 THEN {_scored("1.5")}
           WHEN 10 THEN '{{"conversation_type": "FORMAL", "topics": ["' || name || '"]' || points || '}}'
           WHEN 11 THEN '{{"conversation_type": "COMEDY", "topics": []' || points || '}}'
           WHEN 12 THEN '{{"conversation_type": "FORMAL", "conversation_type": "COMEDY", "topics": ' || topics || points || '}}'
           WHEN 13 THEN {_scored("NaN")}
           WHEN 14 THEN good || ' ' || good
           WHEN 15 THEN good || chr(10) || 'That is all.'
           WHEN 16 THEN coalesce(text, '')
           WHEN 17 THEN '{{"conversation_type": "INTERVIEW", "topics": ' || topics || ', "key_points": ["\\ud800 half", "' || whole || '"]}}'
           WHEN 18 THEN '{{"conversation_type": "INTERVIEW", "topics": ' || topics || ', "key_points": ["\\ud83d\\ude00", "' || whole || '"]}}'
           WHEN 19 THEN {_scored("1e400")}
           WHEN 20 THEN '{{"conversation_type": "CASUAL", "topics": ["bad"], "topics": ' || topics || points || '}}'
           WHEN 21 THEN '{{"conversation_type": "CASUAL", "topics": [], "key_points": ["a' || chr(10) || 'b", "' || whole || '"]}}'
           WHEN 22 THEN {_scored("-Infinity")}
           ELSE '"' || whole || '"' END AS raw
  FROM (SELECT *, '{{"conversation_type": "EDUCATIONAL", "topics": ' || topics || points || '}}' AS good
        FROM (SELECT doc_id, text, name, whole, ', "key_points": ["' || whole || '", "k2"]' AS points,
                     '[{{"name": "' || name || '", "confidence_score": 0.' || CAST(doc_id % 10 AS VARCHAR) ||
                     '}}, {{"name": "all", "confidence_score": 1}}]' AS topics
              FROM (SELECT doc_id, text, {json_text('substr(text, 1, 40)')} AS name, {json_text('text')} AS whole
                    FROM documents) a) b) g)"""

VERIFY_RESPONSES = f"""verify_responses AS (
  SELECT CAST(doc_id AS VARCHAR) AS transcript_id,
         CASE doc_id % 12
           WHEN 0 THEN '{{"is_safe": true, "reject_reason": null' || note
           WHEN 1 THEN '```json' || chr(10) || '{{"is_safe": false, "reject_reason": "PII"' || note || chr(10) || '```'
           WHEN 2 THEN '{{"is_safe": true}}'
           WHEN 3 THEN '{{"is_safe": false, "reject_reason": "SPAM"' || note
           WHEN 4 THEN '{{"reject_reason": "PROFANITY"' || note
           WHEN 5 THEN 'unsafe: ' || coalesce(text, '')
           WHEN 6 THEN '{{"is_safe": true, "is_safe": false, "reject_reason": "PII"' || note
           WHEN 7 THEN '{{"score": NaN, "is_safe": true' || note
           WHEN 8 THEN '{{"is_safe": true' || note || '{{"is_safe": false}}'
           WHEN 9 THEN '{{"is_safe": 1, "sign": "\\udfff"' || note
           WHEN 10 THEN 'JSON {{"is_safe": "no", "reject_reason": "HATE_SPEECH"' || note
           ELSE '["is_safe", "' || {json_text('text')} || '"]' END AS raw
  FROM (SELECT doc_id, text, ', "note": "' || {json_text('text')} || '"}}' AS note FROM documents) n)"""


def as_python(s: str, only_both: bool = False) -> str:
    """A reply in a form that DuckDB reads as Python reads the reply: last key wins, no NaN, no half pairs.

    ``only_both``: without the forms that only Python takes (NaN, infinities, duplicate keys).
    """
    out = s
    for a, b in ((r"\ud800", r"�"), (r"\udfff", r"�"), (": 1e400", ": 1e300")):
        out = f"replace({out}, '{a}', '{b}')"
    if only_both:
        return out
    for a, b in ((": NaN", ": 1e300"), (": -Infinity", ": 1e300"), ('{"conversation_type": "FORMAL", "conversation_type":',
                 '{"conversation_type":'), ('"topics": ["bad"], "topics":', '"topics":'), ('"is_safe": true, "is_safe":', '"is_safe":')):
        out = f"replace({out}, '{a}', '{b}')"
    return out


REQUEST_LOG = """request_log AS (
  SELECT substr(CAST(ts AS VARCHAR), 1, 19) || ' - app.app - INFO - app.py:log_requests:166 - Path: ' ||
         CASE event_type WHEN 'view' THEN '/v1/jobs' WHEN 'click' THEN '/v1/jobs/' || CAST(user_id AS VARCHAR)
           WHEN 'signup' THEN '/v1/transcribe' WHEN 'purchase' THEN '/v1/summarize/' || CAST(user_id AS VARCHAR)
           ELSE '/v1/verify' END ||
         ' Method: ' || CASE WHEN event_type IN ('view', 'click') THEN 'GET' ELSE 'POST' END ||
         ' Status: ' || CASE WHEN event_type = 'error' THEN '500' ELSE '200' END ||
         ' Duration: ' || CAST(event_id % 7 AS VARCHAR) || '.' || CAST(10 + event_id % 90 AS VARCHAR) || 's' AS line
  FROM events)"""

TRANSCRIPTS = r"""transcripts AS (
  SELECT job_id, text, n_turns, length(text) / 16.0 AS duration
  FROM (SELECT CAST(conv_id AS VARCHAR) AS job_id,
               regexp_replace(string_agg(role || ': ' || text, chr(10) ORDER BY turn), '^\s+|\s+$', '', 'g') AS text,
               count(*) AS n_turns
        FROM conversations GROUP BY conv_id) t)"""

SHARES = """shares AS (
  SELECT job_id, name, n_chars,
         row_number() OVER (PARTITION BY job_id ORDER BY first_turn, name) AS position,
         n_chars / sum(n_chars) OVER (PARTITION BY job_id) AS share
  FROM (SELECT CAST(conv_id AS VARCHAR) AS job_id, role AS name,
               CAST(sum(length(text)) AS BIGINT) AS n_chars, min(turn) AS first_turn
        FROM conversations GROUP BY conv_id, role) r)"""

ALLOC = """alloc AS (
  SELECT s.job_id, s.position, 'speaker_' || CAST(s.position AS VARCHAR) AS speaker_id, s.name, s.share,
         t.duration * s.share AS speaking_time
  FROM shares s JOIN transcripts t USING (job_id))"""

# Word lists and patterns of the offline verdict (same as the
# operator's defaults; repeated here because the oracle is plain SQL).
PROFANITY = ("['arse', 'arsehole', 'asshole', 'bastard', 'bitch', 'bollocks', 'bullshit', "
             "'crap', 'damn', 'dickhead', 'fuck', 'fucked', 'fucking', 'goddamn', "
             "'motherfucker', 'piss', 'pissed', 'prick', 'shit', 'shitty', 'twat', "
             "'wanker', 'idiot', 'moron', 'imbecile', 'jackass', 'scumbag']")
HATE = ("['subhuman', 'subhumans', 'untermensch', 'vermin', 'exterminate', "
        "'extermination', 'degenerates', 'mongrels']")
PII = ("(regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}') OR "
       "regexp_matches(text, '(^|[^0-9])[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}([^0-9]|$)') OR "
       "regexp_matches(text, '(^|[^0-9])[0-9]{16}([^0-9]|$)') OR "
       "regexp_matches(text, '[+]1 [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}'))")

VERDICTS = f"""verdicts AS (
  SELECT job_id AS transcript_id, language,
         CASE WHEN prof THEN 'PROFANITY' WHEN hate THEN 'HATE_SPEECH' WHEN pii THEN 'PII' END AS reject_reason,
         prof AS has_profanity, hate AS has_hate_speech, pii AS has_pii
  FROM (SELECT job_id, language,
               coalesce(list_has_any(regexp_extract_all(lower(text), '[\\p{{L}}]+'), {PROFANITY}), false) AS prof,
               coalesce(list_has_any(regexp_extract_all(lower(text), '[\\p{{L}}]+'), {HATE}), false) AS hate,
               coalesce({PII}, false) AS pii
        FROM doc_transcripts) x)"""


def clean(x: str) -> str:
    """DuckDB form of the reply cleaner (P5)."""
    return (f"regexp_replace(regexp_replace(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), "
            f"'^(```)?json?\\s*', '', 'i'), '```$', '')")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


ORACLE: dict[str, str] = {}

ORACLE["flagship_speaking_time_and_safety"] = with_(
    TRANSCRIPTS, SHARES, ALLOC,
    "ok AS (SELECT job_id, text, job_id AS language FROM transcripts "
    "WHERE NOT (text IS NULL OR text = '' OR length(text) < 50))",
    VERDICTS.replace("FROM doc_transcripts", "FROM ok")) + """
SELECT a.job_id, a.speaker_id, a.name, round(a.speaking_time, 6) AS speaking_time,
       v.reject_reason IS NULL AS is_safe, v.reject_reason
FROM alloc a JOIN verdicts v ON a.job_id = v.transcript_id"""

ORACLE["t01_assemble_transcript"] = with_(TRANSCRIPTS) + """
SELECT job_id, text, n_turns, round(duration, 6) AS duration FROM transcripts"""

ORACLE["t02_speaker_shares"] = with_(SHARES) + """
SELECT job_id, name, position, n_chars, round(share, 9) AS share FROM shares"""

ORACLE["t03_allocate_speaking_time"] = with_(TRANSCRIPTS, SHARES, ALLOC) + """
SELECT job_id, speaker_id, name, round(speaking_time, 6) AS speaking_time FROM alloc"""

ORACLE["t04_validate_transcript"] = with_(DOC_TRANSCRIPTS) + """
SELECT job_id, msg IS NULL AS ok, CASE WHEN msg IS NOT NULL THEN 'SummaryError' END AS error_class,
       msg AS message
FROM (SELECT job_id,
             CASE WHEN text IS NULL OR text = '' THEN 'Empty transcript text'
                  WHEN length(text) < 50 THEN 'Transcript too short. Minimum length: 50 characters' END AS msg
      FROM doc_transcripts) x"""

ORACLE["v03_rule_verdict"] = with_(DOC_TRANSCRIPTS, VERDICTS) + """
SELECT transcript_id, reject_reason IS NULL AS is_safe, reject_reason, has_profanity, has_hate_speech, has_pii
FROM verdicts"""

ORACLE["v04_verdict_report"] = with_(DOC_TRANSCRIPTS, VERDICTS) + """
SELECT language, coalesce(reject_reason, 'SAFE') AS verdict, count(*) AS n
FROM verdicts GROUP BY ROLLUP (language, coalesce(reject_reason, 'SAFE'))"""

def _terms(name: str, extra: tuple = ()) -> str:
    def text(x):
        return "NULL" if x is None else f"'{x}'"
    rows = ", ".join(f"({text(c)}, {text(p)}, {text(lang)})" for c, p, lang in (*DEFAULT_TERMS, *extra))
    return f"{name}(category, phrase, language) AS (VALUES {rows})"


PHRASE_HITS = r"""spoken AS (
  SELECT job_id, language, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i
  FROM (SELECT job_id, language, regexp_extract_all(lower(text), '[\p{L}]+') AS ws FROM doc_transcripts) x)""", """follow AS (
  SELECT job_id, language, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4,
         lead(w, 4) OVER o AS w5
  FROM spoken WINDOW o AS (PARTITION BY job_id ORDER BY i))""", """grams AS (
  SELECT job_id, language, i, w AS g FROM follow
  UNION ALL SELECT job_id, language, i, w || ' ' || w2 FROM follow
  UNION ALL SELECT job_id, language, i, w || ' ' || w2 || ' ' || w3 FROM follow
  UNION ALL SELECT job_id, language, i, w || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM follow
  UNION ALL SELECT job_id, language, i, w || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 FROM follow)""", """hits AS (
  SELECT g.job_id AS transcript_id, t.category, t.phrase, CAST(g.i AS INTEGER) AS first_word
  FROM grams g JOIN terms t ON t.phrase = g.g WHERE t.language IS NULL OR t.language = g.language)"""
ORACLE["v03_phrase_hits"] = with_(
    DOC_TRANSCRIPTS, _terms("terms", tuple(("STOCK", p, lang) for p, lang in STOCK_PHRASES)), *PHRASE_HITS) + \
    "SELECT * FROM hits"
ORACLE["v03_phrase_verdict"] = with_(DOC_TRANSCRIPTS, _terms("terms"), *PHRASE_HITS, f"""flags AS (
  SELECT job_id AS transcript_id, language,
         job_id IN (SELECT transcript_id FROM hits WHERE category = 'PROFANITY') AS has_profanity,
         job_id IN (SELECT transcript_id FROM hits WHERE category = 'HATE_SPEECH') AS has_hate_speech,
         coalesce({PII}, false) AS has_pii
  FROM doc_transcripts)""") + """
SELECT transcript_id, language, NOT (has_profanity OR has_hate_speech OR has_pii) AS is_safe,
       CASE WHEN has_profanity THEN 'PROFANITY' WHEN has_hate_speech THEN 'HATE_SPEECH' WHEN has_pii THEN 'PII' END
         AS reject_reason, has_profanity, has_hate_speech, has_pii
FROM flags"""

ORACLE["v02_parse_verdict"] = with_(VERIFY_RESPONSES, f"""c AS (
  SELECT transcript_id, {as_python(clean('raw'))} AS s FROM verify_responses)""", """j AS (
  SELECT transcript_id, s, json_valid(s) AS isj FROM c)""", """t AS (
  SELECT transcript_id, isj,
         CASE WHEN isj THEN json_type(s) END AS top,
         CASE WHEN isj THEN json_type(s, '$.is_safe') END AS st,
         CASE WHEN isj THEN json_extract_string(s, '$.is_safe') END AS sv,
         CASE WHEN isj THEN json_type(s, '$.reject_reason') END AS rt,
         CASE WHEN isj THEN json_extract_string(s, '$.reject_reason') END AS rv
  FROM j)""", """p AS (
  SELECT transcript_id, isj, top, st, rt, rv,
         CASE WHEN st = 'BOOLEAN' THEN sv = 'true'
              WHEN st IN ('UBIGINT', 'BIGINT') AND sv IN ('0', '1') THEN sv = '1'
              WHEN st = 'VARCHAR' AND lower(sv) IN ('true', 't', 'yes', 'y', 'on', '1') THEN true
              WHEN st = 'VARCHAR' AND lower(sv) IN ('false', 'f', 'no', 'n', 'off', '0') THEN false END AS safe,
         (rt IS NULL OR rt = 'NULL' OR (rt = 'VARCHAR' AND rv IN ('PROFANITY', 'HATE_SPEECH', 'PII'))) AS reason_ok
  FROM t)""", """q AS (
  SELECT transcript_id, safe, CASE WHEN rt = 'VARCHAR' THEN rv END AS reason,
         (isj AND top = 'OBJECT' AND st IS NOT NULL AND safe IS NOT NULL AND reason_ok) AS ok
  FROM p)""") + """
SELECT transcript_id, ok, CASE WHEN ok THEN safe END AS is_safe, CASE WHEN ok THEN reason END AS reject_reason,
       CASE WHEN NOT ok THEN 'VerificationError' END AS error_class,
       ok AND (safe = (reason IS NOT NULL)) AS inconsistent
FROM q"""

# --- J: job table ----------------------------------------------------------

NOW = "TIMESTAMP '2024-02-01 00:00:00'"
REQUESTED = "requested AS (SELECT DISTINCT job_id AS requested_id FROM (SELECT job_id FROM jobs UNION ALL SELECT job_id FROM job_events) u)"

ORACLE["j01_create_pending"] = with_(URL_SUBMISSIONS) + f"""
SELECT sha256(CAST(page_id AS VARCHAR) || '|' || url) AS job_id, url, 'PENDING' AS status,
       coalesce(priority, 'MEDIUM') AS priority, {NOW} AS created_at
FROM url_submissions"""

ORACLE["j02_validate_state"] = with_(JOBS_DIRTY, """d AS (
  SELECT job_id, status, coalesce(error_message <> '', false) AS has_msg,
         coalesce(has_transcript, false) AS has_t FROM jobs_dirty)""") + """
SELECT job_id, 1 AS rule, 'Completed jobs must have a transcript' AS message FROM d WHERE status = 'COMPLETED' AND NOT has_t
UNION ALL SELECT job_id, 2, 'Failed jobs must have an error message' FROM d WHERE status = 'FAILED' AND NOT has_msg
UNION ALL SELECT job_id, 3, 'Transcript can only be present for completed jobs' FROM d WHERE has_t AND status <> 'COMPLETED'
UNION ALL SELECT job_id, 4, 'Error message can only be present for failed jobs' FROM d WHERE has_msg AND status <> 'FAILED'"""

ORACLE["j03_mark_processing"] = with_(JOBS) + f"""
SELECT job_id, CASE WHEN status = 'PENDING' THEN 'PROCESSING' ELSE status END AS status,
       CASE WHEN status = 'PENDING' THEN {NOW} ELSE started_at END AS started_at,
       completed_at, error_message,
       CASE WHEN status <> 'PENDING' THEN 'InvalidJobStateError' END AS rejected_class,
       CASE WHEN status <> 'PENDING' THEN 'Cannot mark job as processing from state JobStatus.' || status END AS rejected_message
FROM jobs"""

ORACLE["j03_mark_completed"] = with_(JOBS, DOC_TRANSCRIPTS, """r AS (
  SELECT j.*, d.job_id IS NOT NULL AS has_t FROM jobs j LEFT JOIN doc_transcripts d USING (job_id))""") + f"""
SELECT job_id, CASE WHEN status = 'PROCESSING' AND has_t THEN 'COMPLETED' ELSE status END AS status,
       started_at,
       CASE WHEN status = 'PROCESSING' AND has_t THEN {NOW} ELSE completed_at END AS completed_at,
       error_message,
       (status = 'PROCESSING' AND has_t) AS has_transcript,
       CASE WHEN status <> 'PROCESSING' THEN 'InvalidJobStateError' WHEN NOT has_t THEN 'ValueError' END AS rejected_class,
       CASE WHEN status <> 'PROCESSING' THEN 'Cannot mark job as completed from state JobStatus.' || status
            WHEN NOT has_t THEN 'Must provide transcript when completing job' END AS rejected_message
FROM r"""

ORACLE["j03_mark_failed"] = with_(JOBS, """r AS (
  SELECT j.*, CASE WHEN priority = 'LOW' THEN '' ELSE 'Worker stopped' END AS msg FROM jobs j)""") + f"""
SELECT job_id, CASE WHEN status IN ('PENDING', 'PROCESSING') AND msg <> '' THEN 'FAILED' ELSE status END AS status,
       started_at,
       CASE WHEN status IN ('PENDING', 'PROCESSING') AND msg <> '' THEN {NOW} ELSE completed_at END AS completed_at,
       CASE WHEN status IN ('PENDING', 'PROCESSING') AND msg <> '' THEN msg ELSE error_message END AS error_message,
       CASE WHEN status NOT IN ('PENDING', 'PROCESSING') THEN 'InvalidJobStateError'
            WHEN msg = '' THEN 'ValueError' END AS rejected_class,
       CASE WHEN status NOT IN ('PENDING', 'PROCESSING') THEN 'Cannot mark job as failed from state JobStatus.' || status
            WHEN msg = '' THEN 'Must provide error message when failing job' END AS rejected_message
FROM r"""

ORACLE["j04_fold_transitions"] = with_(JOB_EVENTS, """f AS (
  SELECT job_id, count(*) AS n_events,
         min(seq) FILTER (WHERE kind IN ('start', 'fail')) AS s1_seq,
         arg_min(kind, seq) FILTER (WHERE kind IN ('start', 'fail')) AS s1_kind,
         arg_min(ts, seq) FILTER (WHERE kind IN ('start', 'fail')) AS s1_ts
  FROM job_events GROUP BY job_id)""", """s AS (
  SELECT e.job_id, min(e.seq) AS s2_seq, arg_min(e.kind, e.seq) AS s2_kind, arg_min(e.ts, e.seq) AS s2_ts
  FROM job_events e JOIN f ON e.job_id = f.job_id AND f.s1_kind = 'start' AND e.seq > f.s1_seq
  WHERE e.kind IN ('complete', 'fail') GROUP BY e.job_id)""") + """
SELECT f.job_id,
       CASE WHEN s1_seq IS NULL THEN 'PENDING' WHEN s1_kind = 'fail' THEN 'FAILED'
            WHEN s2_seq IS NULL THEN 'PROCESSING' WHEN s2_kind = 'complete' THEN 'COMPLETED' ELSE 'FAILED' END AS status,
       CASE WHEN s1_kind = 'start' THEN s1_ts END AS started_at,
       CASE WHEN s1_kind = 'fail' THEN s1_ts ELSE s2_ts END AS completed_at,
       n_events,
       n_events - (CASE WHEN s1_seq IS NULL THEN 0 ELSE 1 END) - (CASE WHEN s2_seq IS NULL THEN 0 ELSE 1 END) AS n_illegal
FROM f LEFT JOIN s USING (job_id)"""

for _name, _rank in (("j05_dispatch_order", "CASE priority WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END"),
                     ("j05_dispatch_order_enum", "CASE priority WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END")):
    ORACLE[_name] = with_(JOBS) + f"""
SELECT job_id, priority, created_at,
       row_number() OVER (ORDER BY {_rank}, created_at, job_id) AS dispatch_pos
FROM jobs WHERE status = 'PENDING'"""

ORACLE["j06_claim_next"] = with_(JOBS) + f"""
SELECT job_id, priority, created_at, 'PROCESSING' AS status, {NOW} AS started_at,
       row_number() OVER (ORDER BY r, created_at, job_id) AS claim_pos
FROM (SELECT *, CASE priority WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END AS r
      FROM jobs WHERE status = 'PENDING' ORDER BY r, created_at, job_id LIMIT 25) t"""

ORACLE["j07_get_jobs"] = with_(JOBS, JOB_EVENTS, REQUESTED) + """
SELECT q.requested_id, j.job_id IS NOT NULL AS found, j.status,
       CASE WHEN j.job_id IS NULL THEN 'JobNotFoundError' END AS error_class,
       CASE WHEN j.job_id IS NULL THEN 'Job ' || q.requested_id || ' not found' END AS message
FROM requested q LEFT JOIN jobs j ON q.requested_id = j.job_id"""

ORACLE["j08_list_jobs"] = with_(JOBS) + "SELECT * FROM jobs WHERE status = 'FAILED'"

SWEEP_FLAGS = f"""flags AS (
  SELECT *, coalesce(status IN ('COMPLETED', 'FAILED') AND completed_at IS NOT NULL
                     AND completed_at < {NOW} - INTERVAL '1' HOUR, false) AS stale,
            coalesce(status = 'PROCESSING' AND started_at IS NOT NULL
                     AND started_at < {NOW} - INTERVAL '30' MINUTE, false) AS timed_out
  FROM jobs)"""

ORACLE["j09_sweep"] = with_(JOBS, SWEEP_FLAGS) + f"""
SELECT job_id, CASE WHEN timed_out THEN 'FAILED' ELSE status END AS status, started_at,
       CASE WHEN timed_out THEN {NOW} ELSE completed_at END AS completed_at,
       CASE WHEN timed_out THEN 'Job timed out during forced cleanup' ELSE error_message END AS error_message
FROM flags WHERE NOT stale"""

ORACLE["j10_sweep_stats"] = with_(JOBS, SWEEP_FLAGS) + """
SELECT count(*) AS initial_job_count, count(*) FILTER (WHERE NOT stale) AS final_job_count,
       count(*) FILTER (WHERE stale AND status = 'COMPLETED') AS stale_completed_removed,
       count(*) FILTER (WHERE stale AND status = 'FAILED') AS stale_failed_removed,
       count(*) FILTER (WHERE timed_out) AS processing_timed_out
FROM flags"""

ORACLE["j11_fail_system_error"] = with_(JOBS, JOB_EVENTS, REQUESTED) + f"""
SELECT q.requested_id,
       CASE WHEN j.status IN ('PENDING', 'PROCESSING') THEN 'FAILED' ELSE j.status END AS status,
       CASE WHEN j.status IN ('PENDING', 'PROCESSING') THEN 'System error: worker lost' END AS error_message,
       CASE WHEN j.status IN ('PENDING', 'PROCESSING') THEN {NOW} END AS completed_at,
       CASE WHEN j.job_id IS NULL THEN 'JobNotFoundError'
            WHEN j.status NOT IN ('PENDING', 'PROCESSING') THEN 'InvalidJobStateError' END AS error_class,
       'Failed to update job: ' ||
       CASE WHEN j.job_id IS NULL THEN 'Job ' || q.requested_id || ' not found'
            WHEN j.status NOT IN ('PENDING', 'PROCESSING') THEN 'Cannot mark job as failed from state JobStatus.' || j.status END AS message
FROM requested q LEFT JOIN jobs j ON q.requested_id = j.job_id"""

ORACLE["j13_status_overview"] = with_(JOBS) + "SELECT status, priority, count(*) AS n FROM jobs GROUP BY status, priority"

# --- U: URL admission ------------------------------------------------------

PARSED = r"""parsed AS (
  SELECT page_id, url, priority, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM url_submissions)""" + """,
parsed2 AS (
  SELECT *, CASE WHEN contains(path, '.') THEN regexp_extract(lower(path), '([.][^.]*)$', 1)
                 ELSE right(lower(path), 1) END AS extension
  FROM parsed)"""

FORMATS = "('.m4a', '.mp3', '.mp4', '.wav', '.webm')"
FORMAT_MSG = "'Unsupported audio format: ' || extension || '. Supported formats: .m4a, .mp3, .mp4, .wav, .webm'"
PROBE_CLS = """CASE WHEN coalesce(outcome, 'client_error') = 'timeout' THEN 'TranscriptionTimeoutError'
     WHEN coalesce(outcome, 'client_error') <> 'ok' THEN 'InvalidURLError'
     WHEN http_status <> 200 THEN 'InvalidURLError'
     WHEN coalesce(content_length / 1048576.0 > 100, false) THEN 'FileTooLargeError' END"""
PROBE_MSG = """CASE WHEN coalesce(outcome, 'client_error') = 'timeout' THEN 'Timeout while validating URL'
     WHEN coalesce(outcome, 'client_error') <> 'ok' THEN 'Error accessing URL: ' || coalesce(outcome, 'client_error')
     WHEN http_status <> 200 THEN 'URL returned status code: ' || CAST(http_status AS VARCHAR)
     WHEN coalesce(content_length / 1048576.0 > 100, false)
       THEN 'File size (' || printf('%.1f', content_length / 1048576.0) || 'MB) exceeds maximum allowed size of 100MB' END"""
WARN = "NOT (contains(coalesce(content_type, ''), 'audio/') OR contains(coalesce(content_type, ''), 'video/'))"

ADMITTED = f"""checked AS (
  SELECT p.page_id, p.url, p.priority, p.scheme, p.extension, q.outcome, q.http_status, q.content_length, q.content_type,
         CASE WHEN p.scheme NOT IN ('http', 'https') THEN 'InvalidURLError'
              WHEN p.extension NOT IN {FORMATS} THEN 'UnsupportedAudioFormatError'
              ELSE {PROBE_CLS} END AS error_class,
         CASE WHEN p.scheme NOT IN ('http', 'https') THEN 'Unsupported URL scheme: ' || p.scheme
              WHEN p.extension NOT IN {FORMATS} THEN {FORMAT_MSG.replace('extension', 'p.extension')}
              ELSE {PROBE_MSG} END AS message
  FROM parsed2 p LEFT JOIN url_probe q USING (page_id)),
admitted AS (
  SELECT sha256(CAST(page_id AS VARCHAR) || '|' || url) AS job_id, page_id, url,
         CASE WHEN error_class IS NOT NULL THEN 'FAILED' ELSE 'PENDING' END AS status,
         coalesce(priority, 'MEDIUM') AS priority, {NOW} AS created_at,
         CASE WHEN error_class IS NOT NULL THEN {NOW} END AS completed_at,
         message AS error_message, error_class,
         (error_class IS NULL AND {WARN}) AS content_type_warning
  FROM checked)"""

ORACLE["u01_parse_url"] = with_(URL_SUBMISSIONS, PARSED) + \
    "SELECT page_id, url, scheme, path, extension FROM parsed2"

ORACLE["u02_check_scheme"] = with_(URL_SUBMISSIONS, PARSED) + """
SELECT page_id, scheme IN ('http', 'https') AS ok,
       CASE WHEN scheme NOT IN ('http', 'https') THEN 'Unsupported URL scheme: ' || scheme END AS message
FROM parsed2"""

ORACLE["u03_check_format"] = with_(URL_SUBMISSIONS, PARSED) + f"""
SELECT page_id, extension IN {FORMATS} AS ok,
       CASE WHEN extension NOT IN {FORMATS} THEN {FORMAT_MSG} END AS message
FROM parsed2"""

ORACLE["u04_check_probe"] = with_(URL_PROBE) + f"""
SELECT page_id, {PROBE_CLS} AS error_class, {PROBE_MSG} AS message FROM url_probe"""

ORACLE["u05_flag_content_type"] = with_(URL_PROBE) + f"""
SELECT page_id, content_type, {WARN} AS content_type_warning FROM url_probe"""

ORACLE["u06_admit"] = with_(URL_SUBMISSIONS, URL_PROBE, PARSED, ADMITTED) + "SELECT * FROM admitted"

ORACLE["u07_admission_report"] = with_(URL_SUBMISSIONS, URL_PROBE, PARSED, ADMITTED) + """
SELECT status, error_class, count(*) AS n, count(*) FILTER (WHERE content_type_warning) AS n_warned
FROM admitted GROUP BY status, error_class"""

TAXONOMY = """taxonomy(error_class, parent_class, status_code) AS (VALUES
  ('LLMError', NULL, 500), ('LLMTimeoutError', 'LLMError', 504), ('LLMRateLimitError', 'LLMError', 429),
  ('LLMConnectionError', 'LLMError', 503), ('InvalidResponseError', 'LLMError', 502),
  ('TokenLimitError', 'LLMError', 400), ('TranscriptionError', NULL, 500),
  ('InvalidURLError', 'TranscriptionError', 400), ('FileTooLargeError', 'TranscriptionError', 400),
  ('UnsupportedAudioFormatError', 'TranscriptionError', 400),
  ('TranscriptionTimeoutError', 'TranscriptionError', 504), ('SummaryError', NULL, 500),
  ('ContentTooLongError', 'SummaryError', 400), ('InvalidMetadataError', 'SummaryError', 500),
  ('VerificationError', NULL, 500), ('JobError', NULL, 500), ('JobNotFoundError', 'JobError', 404),
  ('InvalidJobStateError', 'JobError', 400), ('InvalidPriorityError', 'JobError', 400),
  ('JobQueueError', 'JobError', 503))"""

ORACLE["j12_classify_errors"] = with_(URL_SUBMISSIONS, URL_PROBE, PARSED, ADMITTED, DOC_TRANSCRIPTS, TAXONOMY, """errs AS (
  SELECT error_class FROM admitted
  UNION ALL
  SELECT CASE WHEN text IS NULL OR text = '' OR length(text) < 50 THEN 'SummaryError' END FROM doc_transcripts)""") + """
SELECT e.error_class, t.parent_class, coalesce(t.status_code, 500) AS status_code, count(*) AS n
FROM errs e LEFT JOIN taxonomy t USING (error_class)
WHERE e.error_class IS NOT NULL
GROUP BY e.error_class, t.parent_class, coalesce(t.status_code, 500)"""

ERROR_CHAINS = f"""error_chains AS (
  SELECT event_id AS error_id,
         [{", ".join(f"'{c}'" for c, _, _ in ERROR_CLASSES)}, 'KeyError', 'ValueError', NULL][event_id % 23 + 1] AS error_class,
         CASE WHEN event_id % 11 = 3 THEN -event_id
              WHEN event_id % 7 <> 0 THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) END AS cause_id
  FROM events WHERE event_type IN ('error', 'view'))"""
ROOT_CAUSES = """chain AS (
  SELECT error_id, error_id AS reached, CAST(0 AS BIGINT) AS depth FROM error_chains
  UNION ALL
  SELECT c.error_id, b.error_id, c.depth + 1
  FROM chain c JOIN error_chains a ON a.error_id = c.reached JOIN error_chains b ON b.error_id = a.cause_id),
root_causes AS (
  SELECT e.error_id, e.error_class, e.cause_id, c.reached AS root_id, r.error_class AS root_class, c.depth
  FROM (SELECT error_id, arg_max(reached, depth) AS reached, max(depth) AS depth FROM chain GROUP BY error_id) c
  JOIN error_chains e USING (error_id) JOIN error_chains r ON r.error_id = c.reached)"""
_recursive = lambda *ctes: "WITH RECURSIVE " + with_(*ctes).removeprefix("WITH ")
ORACLE["j12_root_causes"] = _recursive(ERROR_CHAINS, ROOT_CAUSES) + "SELECT * FROM root_causes"
ORACLE["j12_error_rollup"] = _recursive(ERROR_CHAINS, ROOT_CAUSES, TAXONOMY, """up AS (
  SELECT error_class, error_class AS ancestor FROM taxonomy
  UNION ALL
  SELECT u.error_class, t.parent_class FROM up u JOIN taxonomy t ON t.error_class = u.ancestor
  WHERE t.parent_class IS NOT NULL)""", """classes AS (
  SELECT error_class FROM taxonomy UNION SELECT error_class FROM root_causes WHERE error_class IS NOT NULL
  UNION SELECT root_class FROM root_causes WHERE root_class IS NOT NULL)""", """lines AS (
  SELECT coalesce(u.ancestor, r.error_class) AS cls, 1 AS n, 0 AS n_root
  FROM root_causes r LEFT JOIN up u ON u.error_class = r.error_class WHERE r.error_class IS NOT NULL
  UNION ALL
  SELECT coalesce(u.ancestor, r.root_class), 0, 1
  FROM root_causes r LEFT JOIN up u ON u.error_class = r.root_class WHERE r.root_class IS NOT NULL)""") + """
SELECT c.error_class, t.parent_class, coalesce(t.status_code, 500) AS status_code,
       (SELECT count(*) FROM root_causes r WHERE r.error_class = c.error_class) AS n,
       (SELECT count(*) FROM root_causes r WHERE r.root_class = c.error_class) AS n_root,
       (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM lines l WHERE l.cls = c.error_class) AS n_below,
       (SELECT CAST(coalesce(sum(n_root), 0) AS BIGINT) FROM lines l WHERE l.cls = c.error_class) AS n_root_below,
       (SELECT max(depth) FROM root_causes r WHERE r.root_class = c.error_class) AS deepest
FROM classes c LEFT JOIN taxonomy t USING (error_class)"""

# --- P / E: replies ----------------------------------------------------------

CLIENT_ERRORS = """client_errors AS (
  SELECT event_id,
         CASE event_type WHEN 'view' THEN 'timeout' WHEN 'click' THEN 'rate_limit' WHEN 'signup' THEN 'connection'
                         WHEN 'purchase' THEN 'api_error' ELSE 'other' END AS k,
         CASE WHEN event_id % 4 = 0 THEN 'This model''s Maximum Context Length is 8192 tokens'
              ELSE 'upstream failure ' || CAST(event_id AS VARCHAR) END AS t
  FROM events)"""

CLEANED = f"""cleaned AS (SELECT transcript_id, {clean('raw')} AS s FROM llm_responses),
python_read AS (SELECT transcript_id, {as_python('s')} AS s FROM cleaned)"""

TOPIC_CODE = """CASE WHEN json_type(t) <> 'OBJECT' OR json_type(t, '$.name') IS NULL OR json_type(t, '$.confidence_score') IS NULL THEN 1
     WHEN json_type(t, '$.confidence_score') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 3
     WHEN CAST(json_extract(t, '$.confidence_score') AS DOUBLE) < 0
       OR CAST(json_extract(t, '$.confidence_score') AS DOUBLE) > 1 THEN 2 ELSE 0 END"""

META = f"""m0 AS (SELECT transcript_id, s, json_valid(s) AS isj FROM python_read),
m1v AS (
  SELECT transcript_id,
         json_type(s) = 'OBJECT' AS is_obj0,
         CASE WHEN json_type(s) = 'OBJECT'
              THEN list_sort(list_filter(['conversation_type', 'key_points', 'topics'],
                                         lambda k: NOT list_contains(json_keys(s), k))) END AS missing,
         json_extract_string(s, '$.conversation_type') AS ctype,
         coalesce(json_type(s, '$.topics') IN ('ARRAY', 'VARCHAR', 'OBJECT'), false) AS topics_arr,
         CASE WHEN json_type(s, '$.topics') = 'ARRAY'
              THEN list_filter(list_transform(json_extract(s, '$.topics[*]'), lambda t: {TOPIC_CODE}), lambda c: c > 0)[1]
              WHEN json_type(s, '$.topics') = 'VARCHAR' AND json_extract_string(s, '$.topics') <> '' THEN 1
              WHEN json_type(s, '$.topics') = 'OBJECT' AND len(json_keys(s, '$.topics')) > 0 THEN 1 END AS problem,
         CASE WHEN json_type(s, '$.topics') = 'ARRAY'
              THEN coalesce(list_bool_and(list_transform(json_extract(s, '$.topics[*]'),
                                                         lambda t: json_type(t, '$.name') = 'VARCHAR')), true) END AS names_ok,
         coalesce(json_type(s, '$.key_points') = 'ARRAY'
              AND coalesce(list_bool_and(list_transform(json_extract(s, '$.key_points[*]'),
                                                        lambda x: json_type(x) = 'VARCHAR')), true), false) AS kp_ok
  FROM m0 WHERE isj),
m1 AS (SELECT m0.transcript_id, m0.s, m0.isj, coalesce(m1v.is_obj0, false) AS is_obj, m1v.missing, m1v.ctype,
              m1v.topics_arr, m1v.problem, m1v.names_ok, m1v.kp_ok
       FROM m0 LEFT JOIN m1v USING (transcript_id)),
m2 AS (
  SELECT *, CASE WHEN NOT isj THEN 'LLM did not return valid JSON'
                 WHEN NOT is_obj THEN 'reply is not a JSON object'
                 WHEN len(missing) > 0 THEN 'Missing required fields: {{' || array_to_string(list_transform(missing, lambda x: '''' || x || ''''), ', ') || '}}'
                 WHEN NOT coalesce(ctype IN ('EDUCATIONAL', 'FORMAL', 'COMEDY', 'PROFESSIONAL', 'CASUAL', 'INTERVIEW'), false)
                   THEN 'Invalid conversation type: ' || coalesce(ctype, 'None')
                 WHEN NOT coalesce(topics_arr, false) THEN 'topics is not a list'
                 WHEN problem = 1 THEN 'Invalid topic structure in metadata'
                 WHEN problem = 2 THEN 'Topic confidence score must be between 0 and 1'
                 WHEN problem = 3 THEN 'confidence_score is not a number'
                 WHEN NOT names_ok OR NOT kp_ok THEN 'topic names and key points must be strings' END AS detail,
            NULL AS cls0
  FROM m1)"""

ORACLE["p04_join_choices"] = r"""
SELECT CAST(doc_id AS VARCHAR) AS transcript_id,
       array_to_string(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda c: ' ' || c), '') AS joined
FROM documents"""

ORACLE["p05_clean_reply"] = with_(LLM_RESPONSES, CLEANED) + "SELECT transcript_id, s AS cleaned FROM cleaned"

for _k, _valid in (("p06_check_json", f"json_valid({as_python('s', only_both=True)}) AND {as_python('s', True)} = {as_python('s')}"),
                   ("p06_check_json_exact", f"json_valid({as_python('s')})")):
    ORACLE[_k] = with_(LLM_RESPONSES, CLEANED) + f"""
SELECT transcript_id, isj AS is_json, CASE WHEN NOT isj THEN 'InvalidResponseError' END AS error_class
FROM (SELECT transcript_id, {_valid} AS isj FROM cleaned)"""

ORACLE["p07_map_client_error"] = with_(CLIENT_ERRORS) + """
SELECT event_id,
       CASE WHEN k = 'timeout' THEN 'LLMTimeoutError' WHEN k = 'rate_limit' THEN 'LLMRateLimitError'
            WHEN k = 'connection' THEN 'LLMConnectionError'
            WHEN k = 'api_error' AND contains(lower(t), 'maximum context length') THEN 'TokenLimitError'
            ELSE 'LLMError' END AS error_class,
       CASE WHEN k = 'timeout' THEN 'Request to language model timed out'
            WHEN k = 'rate_limit' THEN 'Rate limit exceeded for language model'
            WHEN k = 'connection' THEN 'Failed to connect to language model service'
            WHEN k = 'api_error' AND contains(lower(t), 'maximum context length') THEN 'Input exceeds maximum token limit'
            WHEN k = 'api_error' THEN 'Language model error: ' || t
            WHEN k = 'client_error' THEN 'Unexpected language model error: ' || t
            ELSE 'Unexpected error: ' || t END AS message
FROM client_errors"""

ORACLE["e01_check_required_fields"] = with_(LLM_RESPONSES, CLEANED, META) + """
SELECT transcript_id, CASE WHEN is_obj THEN array_to_string(missing, ',') END AS missing_fields FROM m2"""

ORACLE["e02_check_conversation_type"] = with_(LLM_RESPONSES, CLEANED, META) + """
SELECT transcript_id, ctype AS conversation_type,
       coalesce(ctype IN ('EDUCATIONAL', 'FORMAL', 'COMEDY', 'PROFESSIONAL', 'CASUAL', 'INTERVIEW'), false) AS valid
FROM m2"""

ORACLE["e03_check_topics"] = with_(LLM_RESPONSES, CLEANED, META) + \
    "SELECT transcript_id, problem AS topic_problem FROM m2"

ORACLE["e04_validate_metadata"] = with_(LLM_RESPONSES, CLEANED, META) + """
SELECT transcript_id, detail IS NULL AS ok,
       CASE WHEN detail IS NULL THEN NULL WHEN NOT isj THEN 'InvalidResponseError'
            WHEN detail IN ('reply is not a JSON object', 'topics is not a list', 'confidence_score is not a number',
                            'topic names and key points must be strings') THEN 'SummaryError'
            ELSE 'InvalidMetadataError' END AS error_class,
       CASE WHEN detail IS NULL THEN NULL
            WHEN NOT isj THEN 'Failed to extract conversation metadata'
            WHEN detail = 'topic names and key points must be strings'
              THEN 'Failed to generate summary: invalid field type'
            ELSE 'Unexpected error during metadata extraction' END AS message,
       detail
FROM m2"""

ORACLE["e04_parse_metadata"] = with_(LLM_RESPONSES, CLEANED, META) + """
SELECT transcript_id, ctype AS conversation_type, CAST(json_array_length(s, '$.topics') AS INTEGER) AS n_topics,
       array_to_string(json_extract_string(s, '$.topics[*].name'), '|') AS topic_names,
       array_to_string(json_extract_string(s, '$.key_points[*]'), '|') AS key_points
FROM m2 WHERE detail IS NULL"""

ORACLE["e05_explode_topics"] = with_(LLM_RESPONSES, CLEANED, META) + """
SELECT transcript_id, CAST(pos AS INTEGER) AS pos,
       json_extract_string(s, '$.topics[' || pos || '].name') AS name,
       CAST(json_extract(s, '$.topics[' || pos || '].confidence_score') AS DOUBLE) AS confidence_score
FROM (SELECT transcript_id, s, unnest(range(CAST(json_array_length(s, '$.topics') AS BIGINT))) AS pos
      FROM m2 WHERE detail IS NULL) x"""

# --- M: offline model operators; E6-E8 ---------------------------------------

def m1_ctes(src: str = "doc_transcripts") -> str:
    return rf"""s AS (
  SELECT job_id AS id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS sentence
  FROM (SELECT job_id, regexp_extract_all(text, '[^.!?\n]+[.!?]*') AS l FROM {src}) x),
sw AS (
  SELECT id, pos, word, count(*) AS c
  FROM (SELECT id, pos, unnest(regexp_extract_all(lower(sentence), '[\p{{L}}]+')) AS word FROM s) y
  GROUP BY id, pos, word),
tf AS (SELECT id, word, sum(c) AS tf FROM sw GROUP BY id, word),
nd AS (SELECT id, sum(tf) AS n_doc FROM tf GROUP BY id),
ps AS (SELECT sw.id, sw.pos, sum(sw.c * tf.tf) AS tf_sum, sum(sw.c) AS n_words
       FROM sw JOIN tf USING (id, word) GROUP BY sw.id, sw.pos),
sc AS (SELECT ps.id, ps.pos, CAST(ps.n_words AS BIGINT) AS n_words,
              CAST(tf_sum AS DOUBLE) / n_words / n_doc AS score FROM ps JOIN nd USING (id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, pos) AS rank FROM sc),
sel1 AS (SELECT id, pos, rank, score, least(n_words, 1000 - before) AS n_words, n_words AS n_all,
                before + least(n_words, 1000 - before) AS running_words FROM (
         SELECT rk.*, CAST(coalesce(sum(n_words) OVER (PARTITION BY id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
         FROM rk WHERE rank <= 3) z WHERE before < 1000),
cut1 AS (SELECT sel1.id, sel1.pos, CASE WHEN n_words = n_all THEN s.sentence ELSE array_to_string(list_slice(
                regexp_extract_all(s.sentence, '[^\p{{L}}]*[\p{{L}}]+'), 1, n_words), '') END AS sentence
        FROM sel1 JOIN s USING (id, pos)),
sum1 AS (SELECT id, string_agg(regexp_replace(sentence, '^\s+|\s+$', '', 'g'), ' ' ORDER BY pos) AS summary_text
        FROM cut1 GROUP BY id),
kp3 AS (SELECT rk.id, rk.rank, regexp_replace(s.sentence, '^\s+|\s+$', '', 'g') AS key_point
       FROM rk JOIN s USING (id, pos) WHERE rk.rank <= 5)"""


def m2_ctes(src: str = "doc_transcripts") -> str:
    return rf"""w2 AS (SELECT job_id AS id, unnest(regexp_extract_all(lower(text), '[\p{{L}}]+')) AS word FROM {src}),
f2 AS (SELECT id, word, count(*) AS f FROM w2 WHERE length(word) >= 4 GROUP BY id, word),
n2 AS (SELECT count(*) AS n FROM {src}),
df2 AS (SELECT word, count(*) AS df FROM f2 GROUP BY word),
sc2 AS (SELECT f2.id, f2.word, f2.f * ln((1 + n2.n) / (1 + df2.df)) AS score FROM f2 JOIN df2 USING (word), n2),
rk2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, word) AS rank FROM sc2) q
        WHERE rank <= 5),
top2 AS (SELECT id, rank, word, score,
              CASE WHEN max(score) OVER (PARTITION BY id) > 0 THEN score / max(score) OVER (PARTITION BY id) ELSE 0.0 END AS confidence
       FROM rk2)"""


def _cue_list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def m4_cte(src: str = "doc_transcripts") -> str:
    from palaver.operators.offline import TYPE_CUES
    types = list(TYPE_CUES)
    hits = ",\n         ".join(
        f"CAST(len(list_filter(w, lambda x: list_contains({_cue_list(TYPE_CUES[t])}, x))) AS INTEGER) AS h{i}"
        for i, t in enumerate(types))
    g = "greatest(" + ", ".join(f"h{i}" for i in range(len(types))) + ")"
    pick = " ".join(f"WHEN h{i} = {g} THEN '{t}'" for i, t in enumerate(types))
    return rf"""m4h AS (
  SELECT job_id, {hits}
  FROM (SELECT job_id, regexp_extract_all(lower(text), '[\p{{L}}]+') AS w FROM {src}) x),
m4 AS (SELECT job_id, CAST({g} AS BIGINT) AS hits, CASE WHEN {g} = 0 THEN 'CASUAL' {pick} END AS conversation_type FROM m4h)"""


ORACLE["m01_extractive_summary"] = with_(DOC_TRANSCRIPTS, m1_ctes()) + """
SELECT id AS job_id, rank, pos, n_words, running_words, round(score, 9) AS score FROM sel1"""

ORACLE["m01_summary_text"] = with_(DOC_TRANSCRIPTS, m1_ctes()) + "SELECT id AS job_id, summary_text FROM sum1"

ORACLE["m02_topics"] = with_(DOC_TRANSCRIPTS, m2_ctes()) + """
SELECT id AS job_id, rank, word, round(score, 6) AS score, round(confidence, 6) AS confidence FROM top2"""

ORACLE["m03_key_points"] = with_(DOC_TRANSCRIPTS, m1_ctes()) + "SELECT id AS job_id, rank, key_point FROM kp3"

ORACLE["m04_conversation_type"] = with_(DOC_TRANSCRIPTS, m4_cte()) + "SELECT * FROM m4"

OK_DOCS = "ok_docs AS (SELECT * FROM doc_transcripts WHERE NOT (text IS NULL OR text = '' OR length(text) < 50))"

ORACLE["e06_assemble_summary"] = with_(DOC_TRANSCRIPTS, OK_DOCS, m1_ctes("ok_docs"), LLM_RESPONSES, CLEANED, META) + """
SELECT d.job_id AS transcript_id, m.ctype AS conversation_type, t.summary_text,
       CAST(json_array_length(m.s, '$.topics') AS INTEGER) AS n_topics,
       array_to_string(json_extract_string(m.s, '$.key_points[*]'), '|') AS key_points,
       round(d.duration, 6) AS duration
FROM ok_docs d JOIN sum1 t ON t.id = d.job_id JOIN m2 m ON m.transcript_id = d.job_id
WHERE m.detail IS NULL"""

ORACLE["e07_summarize_offline"] = with_(DOC_TRANSCRIPTS, OK_DOCS, m1_ctes("ok_docs"), m2_ctes("ok_docs"),
                                        m4_cte("ok_docs")) + """
SELECT d.job_id AS transcript_id, c.conversation_type, coalesce(t.summary_text, '') AS summary_text,
       CAST(coalesce((SELECT count(*) FROM top2 WHERE top2.id = d.job_id), 0) AS INTEGER) AS n_topics,
       CAST(coalesce((SELECT count(*) FROM kp3 WHERE kp3.id = d.job_id), 0) AS INTEGER) AS n_key_points,
       round(d.duration, 6) AS duration
FROM ok_docs d JOIN m4 c USING (job_id) LEFT JOIN sum1 t ON t.id = d.job_id"""

ORACLE["e08_batch_summarize"] = with_(DOC_TRANSCRIPTS, LLM_RESPONSES, CLEANED, META) + """
SELECT count(*) FILTER (WHERE ok_t AND m.detail IS NULL) AS n_success,
       count(*) FILTER (WHERE NOT ok_t OR m.detail IS NOT NULL) AS n_failed
FROM (SELECT job_id, NOT (text IS NULL OR text = '' OR length(text) < 50) AS ok_t FROM doc_transcripts) d
LEFT JOIN m2 m ON m.transcript_id = d.job_id"""

# --- T5/T6, P1/P2, L ----------------------------------------------------------

def _examples_prefix_literal() -> str:
    """The few-shot block, built from the same file as the Spark side, as a SQL literal."""
    import json

    from palaver.sources.readers import EXAMPLES_PATH
    ex = json.load(open(EXAMPLES_PATH))["examples"][:2]
    blocks = [f"Transcript: {e['transcript']}\nSummary: {e['summary']}\n" for e in ex]
    text = "\n".join(["Example transcripts with their summaries:", *blocks])
    return "'" + text.replace("'", "''") + "'"


_PREFIX = _examples_prefix_literal()

ORACLE["t05_create_multiple"] = with_(JOBS, DOC_TRANSCRIPTS) + """
SELECT j.job_id, j.status, d.language, length(d.text) AS n_chars
FROM jobs j JOIN doc_transcripts d USING (job_id)"""

ORACLE["t06_summarizable"] = with_(JOBS, DOC_TRANSCRIPTS) + """
SELECT j.job_id, j.status, d.job_id IS NOT NULL AS has_transcript, j.status = 'COMPLETED' AS summarizable,
       CASE WHEN j.status <> 'COMPLETED' THEN 'InvalidJobStateError' END AS error_class,
       CASE WHEN j.status <> 'COMPLETED' THEN 'Cannot summarize job in status JobStatus.' || j.status ||
            '. Job must be in COMPLETED state.' END AS message
FROM jobs j LEFT JOIN doc_transcripts d USING (job_id)"""

ORACLE["p01_build_summary_prompt"] = with_(DOC_TRANSCRIPTS) + f"""
SELECT job_id, length(p) AS prompt_chars, sha256(p) AS prompt_sha256
FROM (SELECT job_id, {_PREFIX} || chr(10) || 'Transcript: ' || text AS p FROM doc_transcripts) x"""

def _system(name: str) -> str:
    from palaver.operators import prompts
    return "'" + getattr(prompts, name).replace("'", "''") + "'"


def requests_cte(src: str = "doc_transcripts", tasks=("summary", "metadata", "verification"), prefix=None) -> str:
    """Completion requests of a (job_id, text) relation, with the stub's outcome."""
    parts = {
        "summary": (f"{prefix or _PREFIX} || chr(10) || 'Transcript: ' || text", "SUMMARY_SYSTEM", 1000, 0.7, "false"),
        "metadata": ("text", "METADATA_SYSTEM", 4096, 0.3, "true"),
        "verification": ("text", "VERIFICATION_SYSTEM", 4096, 0.1, "true")}
    rows = " UNION ALL ".join(
        f"SELECT job_id, '{t}' AS task, {parts[t][2]} AS max_tokens, CAST({parts[t][3]} AS DOUBLE) AS temperature, "
        f"{parts[t][4]} AS expect_json, {_system(parts[t][1])} AS sp, text, {parts[t][0]} AS c FROM {src}" for t in tasks)
    return f"""r AS (
  SELECT *, length(c) AS h, string_split(replace(text, chr(10), ' '), ' ') AS w,
         sha256(task || '|' || job_id || '|' || sha256(c) || '|' || sha256(sp) || '|' || CAST(temperature AS VARCHAR)
                || '|' || CAST(max_tokens AS VARCHAR) || '|') AS request_id
  FROM ({rows}) q),
answered AS (
  SELECT *, CASE WHEN h % 97 = 0 THEN 'LLMTimeoutError' WHEN h % 89 = 0 THEN 'TokenLimitError'
                 WHEN h % 83 = 0 THEN 'LLMRateLimitError' END AS error_class,
         CASE task WHEN 'summary' THEN array_to_string(w[1:30], ' ')
              WHEN 'metadata' THEN CASE WHEN h % 3 <> 0 THEN '```json' || chr(10) ELSE '' END || CAST(json_object(
                   'conversation_type', CASE WHEN h % 2 = 1 THEN 'CASUAL' ELSE 'FORMAL' END,
                   'topics', json_array(json_object('name', w[1], 'confidence_score', 0.5)),
                   'key_points', json_array(array_to_string(w[1:8], ' '))) AS VARCHAR)
                   || CASE WHEN h % 3 <> 0 THEN chr(10) || '```' ELSE '' END
              ELSE CASE WHEN contains(text, '@') THEN '{{"is_safe":false,"reject_reason":"PII"}}'
                        ELSE '{{"is_safe":true,"reject_reason":null}}' END END AS answer
  FROM r)"""


ORACLE["p02_build_requests"] = with_(DOC_TRANSCRIPTS, requests_cte()) + """
SELECT request_id, job_id, task, CAST(max_tokens AS INTEGER) AS max_tokens, temperature, expect_json,
       length(c) AS content_chars
FROM r"""

ORACLE["p03_complete"] = with_(DOC_TRANSCRIPTS, requests_cte()) + f"""
SELECT request_id, job_id, task, CASE WHEN error_class IS NULL THEN {clean('answer')} END AS raw, error_class
FROM answered"""

ORACLE["p08_usage_report"] = with_(DOC_TRANSCRIPTS, requests_cte()) + """
SELECT task, CASE WHEN error_class IS NULL THEN 'stub-1' END AS model, count(*) AS n_calls,
       count(*) FILTER (WHERE error_class IS NOT NULL) AS n_failed,
       CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(k) AS BIGINT) AS completion_tokens,
       CAST(sum(p + k) AS BIGINT) AS total_tokens
FROM (SELECT *, CASE WHEN error_class IS NULL THEN h // 4 END AS p,
             CASE WHEN error_class IS NULL THEN length(answer) // 4 END AS k
      FROM answered) x
GROUP BY 1, 2"""

ORACLE["v01_verify"] = with_(DOC_TRANSCRIPTS, OK_DOCS, m1_ctes("ok_docs"), """summed AS (
  SELECT d.job_id, coalesce(t.summary_text, '') AS text FROM ok_docs d LEFT JOIN sum1 t ON t.id = d.job_id)""",
                             requests_cte("summed", ("verification",))) + """
SELECT job_id AS transcript_id, error_class IS NULL AS ok,
       CASE WHEN error_class IS NULL THEN NOT contains(text, '@') END AS is_safe,
       CASE WHEN error_class IS NULL AND contains(text, '@') THEN 'PII' END AS reject_reason,
       CASE WHEN error_class IS NOT NULL THEN 'VerificationError' END AS error_class,
       CASE error_class WHEN 'LLMTimeoutError' THEN 'Failed to verify content: Request to language model timed out'
            WHEN 'TokenLimitError' THEN 'Failed to verify content: Input exceeds maximum token limit'
            WHEN 'LLMRateLimitError' THEN 'Failed to verify content: Rate limit exceeded for language model' END AS message,
       false AS inconsistent
FROM answered"""

ORACLE["e07_summarize_with_client"] = with_(DOC_TRANSCRIPTS, OK_DOCS, requests_cte("ok_docs")) + """
SELECT d.job_id AS transcript_id,
       CASE WHEN o.job_id IS NULL THEN 'SummaryError'
            WHEN s.error_class = 'TokenLimitError' THEN 'ContentTooLongError'
            WHEN s.error_class IS NOT NULL THEN s.error_class ELSE m.error_class END AS error_class,
       CASE WHEN o.job_id IS NOT NULL AND s.error_class IS NULL AND m.error_class IS NULL
            THEN CASE WHEN m.h % 2 = 1 THEN 'CASUAL' ELSE 'FORMAL' END END AS conversation_type
FROM doc_transcripts d LEFT JOIN ok_docs o USING (job_id)
LEFT JOIN answered s ON s.job_id = d.job_id AND s.task = 'summary'
LEFT JOIN answered m ON m.job_id = d.job_id AND m.task = 'metadata'"""

_LINE = (r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) - (\S+) - (\S+) - (\S+) - "
         r"Path: (\S+) Method: (\S+) Status: (\d+) Duration: ([0-9]+[.][0-9]+)s$")
PARSED_LOG = f"""parsed_log AS (
  SELECT regexp_extract(line, '{_LINE}', 1) AS logged_at, regexp_extract(line, '{_LINE}', 5) AS path,
         regexp_extract(line, '{_LINE}', 6) AS method, CAST(regexp_extract(line, '{_LINE}', 7) AS INTEGER) AS status,
         CAST(regexp_extract(line, '{_LINE}', 8) AS DOUBLE) AS seconds
  FROM request_log WHERE regexp_matches(line, '{_LINE}'))"""

ORACLE["l01_parse_request_log"] = with_(REQUEST_LOG, PARSED_LOG) + "SELECT * FROM parsed_log"

ORACLE["l02_request_stats"] = with_(REQUEST_LOG, PARSED_LOG) + r"""
SELECT regexp_replace(path, '^/v1/(jobs|summarize)/[^/]+$', '/v1/\1/{job_id}') AS route, method,
       count(*) AS n, count(*) FILTER (WHERE status >= 500) AS n_errors,
       round(avg(seconds), 6) AS mean_seconds, max(seconds) AS max_seconds
FROM parsed_log GROUP BY 1, 2"""

# latency sketches: buckets of relative width, quantiles by running counts of buckets
_GAMMA = (1 + 0.01) / (1 - 0.01)


def latencies(by: str, keys: str, of: str = "parsed_log") -> str:
    return f"""
SELECT {by}, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n_errors) AS BIGINT) AS n_errors, max(max_seconds) AS max_seconds,
       round(min(v) FILTER (WHERE upto >= ceil(0.5 * total)), 6) AS p50,
       round(min(v) FILTER (WHERE upto >= ceil(0.95 * total)), 6) AS p95,
       round(min(v) FILTER (WHERE upto >= ceil(0.99 * total)), 6) AS p99
FROM (SELECT *, coalesce(2.0 * pow({_GAMMA!r}, bucket) / {_GAMMA + 1!r}, 0.0) AS v,
             sum(n) OVER (PARTITION BY {by} ORDER BY bucket NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY {by}) AS total
      FROM (SELECT {keys}, CASE WHEN seconds > 0 THEN CAST(ceil(ln(seconds) / ln({_GAMMA!r})) AS INTEGER) END AS bucket,
                   count(*) AS n, count(*) FILTER (WHERE status >= 500) AS n_errors, max(seconds) AS max_seconds
            FROM (SELECT *, date_trunc('hour', CAST(logged_at AS TIMESTAMP)) AS window_start,
                         regexp_replace(path, '^/v1/(jobs|summarize)/[^/]+$', '/v1/\\1/{{job_id}}') AS route
                  FROM {of}) x
            GROUP BY ALL) y) z
GROUP BY {by}"""


ORACLE["l02_latency_windows"] = with_(REQUEST_LOG, PARSED_LOG) + latencies(
    "window_start, route, method", "window_start, route, method")
ORACLE["l02_latency_days"] = with_(REQUEST_LOG, PARSED_LOG) + latencies(
    "day, route", "CAST(window_start AS DATE) AS day, route")
ORACLE["l02_latency_stream"] = with_(REQUEST_LOG, PARSED_LOG, """closed AS (
  SELECT * FROM parsed_log
  WHERE date_trunc('hour', CAST(logged_at AS TIMESTAMP)) + INTERVAL '1' HOUR
        <= (SELECT max(CAST(logged_at AS TIMESTAMP)) FROM parsed_log) - INTERVAL '10' MINUTE)""") + latencies(
    "window_start, route, method", "window_start, route, method", "closed")

# --- S / W ------------------------------------------------------------------

ORACLE["s01_read_submissions"] = with_(URL_SUBMISSIONS) + """
SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY page_id) - 1 AS INTEGER) AS pos, url,
       CASE WHEN request_id % 5 = 0 THEN 'MEDIUM'
            ELSE arg_min(priority, page_id) OVER (PARTITION BY request_id) END AS priority
FROM (SELECT *, CAST(floor(page_id / 8) AS BIGINT) AS request_id FROM url_submissions) s"""

SUBMITTED = """numbered AS (
  SELECT *, CAST(floor(page_id / 8) AS BIGINT) AS request_id,
         CAST(row_number() OVER (PARTITION BY floor(page_id / 8) ORDER BY page_id) - 1 AS INTEGER) AS pos
  FROM url_submissions)""", """requests AS (
  SELECT request_id, list(url ORDER BY page_id) AS urls, arg_min(priority, page_id) AS priority
  FROM numbered GROUP BY request_id)""", """accepted AS (
  SELECT n.page_id, n.request_id, n.pos, n.url, CASE n.request_id % 9 WHEN 6 THEN 'MEDIUM' ELSE r.priority END AS priority
  FROM numbered n JOIN requests r USING (request_id) WHERE n.request_id % 9 IN (0, 6, 7, 8))""", """rejected AS (
  SELECT CASE request_id % 9
           WHEN 1 THEN substr(CAST(to_json({'request_id': request_id, 'urls': urls, 'priority': priority}) AS VARCHAR), 1, 60)
           WHEN 2 THEN CAST(to_json({'request_id': request_id, 'urls': urls[1]}) AS VARCHAR)
           WHEN 3 THEN CAST(to_json({'request_id': request_id, 'priority': priority}) AS VARCHAR)
           WHEN 4 THEN CAST(to_json({'request_id': request_id, 'urls': urls, 'priority': 'URGENT'}) AS VARCHAR)
           ELSE CAST(to_json({'urls': urls, 'priority': priority}) AS VARCHAR) END AS line,
         CASE request_id % 9 WHEN 3 THEN 'missing_urls' WHEN 4 THEN 'unknown_priority' WHEN 5 THEN 'missing_request_id'
           ELSE 'malformed' END AS reason
  FROM requests WHERE request_id % 9 BETWEEN 1 AND 5)"""
ORACLE["s01_accepted_submissions"] = with_(URL_SUBMISSIONS, *SUBMITTED) + \
    "SELECT request_id, pos, url, priority FROM accepted"
ORACLE["s01_rejected_submissions"] = with_(URL_SUBMISSIONS, *SUBMITTED) + "SELECT line, reason FROM rejected"
ORACLE["w01_rejected_requests"] = ORACLE["s01_rejected_submissions"]
ORACLE["w01_admission_requests"] = with_(URL_SUBMISSIONS, URL_PROBE, PARSED, ADMITTED, *SUBMITTED) + """
SELECT sha256(a.request_id || '/' || a.pos || '|' || a.url) AS job_id, a.request_id || '/' || a.pos AS submission, a.url,
       d.status, a.priority, d.error_class, d.error_message, d.content_type_warning
FROM accepted a JOIN admitted d USING (page_id)"""

ORACLE["s02_read_transcripts"] = with_(TRANSCRIPTS) + """
SELECT t.job_id, 'en' AS language, round(t.duration, 6) AS duration,
       CAST(n.n AS INTEGER) AS n_speakers, sha256(t.text) AS text_sha256
FROM transcripts t JOIN (SELECT CAST(conv_id AS VARCHAR) AS job_id, count(DISTINCT role) AS n
                         FROM conversations GROUP BY conv_id) n USING (job_id)"""

_PYTS = ("CASE WHEN {c} IS NULL THEN NULL WHEN epoch_us({c}) % 1000000 = 0 THEN strftime({c}, '%Y-%m-%d %H:%M:%S') "
         "ELSE strftime({c}, '%Y-%m-%d %H:%M:%S.%f') END")

ORACLE["s04_export_jobs_report"] = with_(JOBS) + f"""
SELECT job_id, url, status, priority, {_PYTS.format(c='created_at')} AS created_at,
       {_PYTS.format(c='started_at')} AS started_at, {_PYTS.format(c='completed_at')} AS completed_at,
       error_message, true AS nulls_kept
FROM jobs"""

ORACLE["s05_write_summaries"] = with_(
    TRANSCRIPTS, SHARES, ALLOC,
    "ok AS (SELECT * FROM transcripts WHERE NOT (text IS NULL OR text = '' OR length(text) < 50))",
    m1_ctes("ok"), m2_ctes("ok"), m4_cte("ok")) + """
SELECT o.job_id AS transcript_id, m.conversation_type, coalesce(t.summary_text, '') AS summary_text,
       a.speakers, a.speaking_time, coalesce(p.topics, '') AS topics, coalesce(p.confidence, 0) AS confidence,
       CAST(coalesce(k.n, 0) AS INTEGER) AS n_key_points
FROM ok o JOIN m4 m USING (job_id) LEFT JOIN sum1 t ON t.id = o.job_id
JOIN (SELECT job_id, string_agg(speaker_id || ':' || name, '|' ORDER BY position) AS speakers,
             round(sum(speaking_time), 6) AS speaking_time FROM alloc GROUP BY job_id) a USING (job_id)
LEFT JOIN (SELECT id, string_agg(word, '|' ORDER BY rank) AS topics, round(sum(confidence), 6) AS confidence
           FROM top2 GROUP BY id) p ON p.id = o.job_id
LEFT JOIN (SELECT id, count(*) AS n FROM kp3 GROUP BY id) k ON k.id = o.job_id"""

ORACLE["l01_rejected_lines"] = with_(REQUEST_LOG) + """
SELECT 'worker: ' || line AS line FROM request_log WHERE contains(line, 'Duration: 3.')"""

ORACLE["j03_request_misses"] = with_(JOBS, """ids AS (
  SELECT job_id FROM jobs WHERE CAST(job_id AS BIGINT) % 3 = 0
  UNION ALL SELECT job_id FROM jobs WHERE CAST(job_id AS BIGINT) % 6 = 0
  UNION ALL SELECT 'x' || job_id FROM jobs WHERE CAST(job_id AS BIGINT) % 10 = 0)""") + """
SELECT job_id, CASE WHEN job_id LIKE 'x%' THEN n ELSE n - 1 END AS n_requests,
       CASE WHEN job_id LIKE 'x%' THEN 'JobNotFoundError' ELSE 'InvalidJobStateError' END AS error_class,
       CASE WHEN job_id LIKE 'x%' THEN 'Job ' || job_id || ' not found'
            ELSE 'Job was already moved by the same batch' END AS message
FROM (SELECT job_id, count(*) AS n FROM ids GROUP BY job_id) q
WHERE job_id LIKE 'x%' OR n > 1"""

ORACLE["s05_write_job_table"] = with_(JOBS) + "SELECT job_id, status, priority FROM jobs"

ORACLE["s05_write_verdicts"] = ORACLE["v03_rule_verdict"]
ORACLE["w01_admission_stream"] = ORACLE["u06_admit"]
ORACLE["w02_lifecycle_stream"] = ORACLE["j04_fold_transitions"]
ORACLE["w03_sweep_job"] = ORACLE["j10_sweep_stats"]

# the fold of one job's events with time limits: before each event, what time alone changes
ORACLE["w02_lifecycle_limits"] = "WITH RECURSIVE " + with_(JOB_EVENTS).removeprefix("WITH ").rstrip() + """,
e AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS i FROM job_events),
w AS (SELECT max(ts) - INTERVAL '10' MINUTE AS t FROM job_events),
steps AS (
  SELECT job_id, CAST(0 AS BIGINT) AS i, 'PENDING' AS status, CAST(NULL AS TIMESTAMP) AS started,
         CAST(NULL AS TIMESTAMP) AS completed, CAST(0 AS BIGINT) AS n_events, CAST(0 AS BIGINT) AS n_illegal,
         CAST(NULL AS VARCHAR) AS message, false AS dropped, CAST(0 AS BIGINT) AS n_late
  FROM e WHERE i = 1
  UNION ALL
  SELECT job_id, i,
         CASE WHEN gone THEN st WHEN st = 'PENDING' AND kind = 'start' THEN 'PROCESSING'
              WHEN st IN ('PENDING', 'PROCESSING') AND kind = 'fail' THEN 'FAILED'
              WHEN st = 'PROCESSING' AND kind = 'complete' THEN 'COMPLETED' ELSE st END,
         CASE WHEN NOT gone AND st = 'PENDING' AND kind = 'start' THEN ts ELSE started END,
         CASE WHEN NOT gone AND (st IN ('PENDING', 'PROCESSING') AND kind = 'fail' OR st = 'PROCESSING' AND kind = 'complete')
              THEN ts ELSE ended END,
         n_events + CASE WHEN gone THEN 0 ELSE 1 END,
         n_illegal + CASE WHEN gone OR st = 'PENDING' AND kind IN ('start', 'fail')
                            OR st = 'PROCESSING' AND kind IN ('complete', 'fail') THEN 0 ELSE 1 END,
         CASE WHEN NOT gone AND st IN ('PENDING', 'PROCESSING') AND kind = 'fail' THEN 'Job failed' ELSE said END,
         gone, n_late + CASE WHEN gone THEN 1 ELSE 0 END
  FROM (SELECT *, dropped OR (st IN ('COMPLETED', 'FAILED') AND ts > ended + INTERVAL '60' MINUTE) AS gone
        FROM (SELECT s.job_id, e.i, e.ts, e.kind, s.started, s.n_events, s.n_illegal, s.dropped, s.n_late,
                     CASE WHEN s.status = 'PROCESSING' AND e.ts > s.started + INTERVAL '30' MINUTE THEN 'FAILED'
                          ELSE s.status END AS st,
                     CASE WHEN s.status = 'PROCESSING' AND e.ts > s.started + INTERVAL '30' MINUTE
                          THEN s.started + INTERVAL '30' MINUTE ELSE s.completed END AS ended,
                     CASE WHEN s.status = 'PROCESSING' AND e.ts > s.started + INTERVAL '30' MINUTE
                          THEN 'Job timed out during forced cleanup' ELSE s.message END AS said
              FROM steps s JOIN e ON e.job_id = s.job_id AND e.i = s.i + 1) a) b),
last AS (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY i DESC) = 1),
passed AS (
  SELECT job_id, n_events, n_illegal, n_late, dropped, started,
         status = 'PROCESSING' AND started + INTERVAL '30' MINUTE <= t AS out_of_time, status, completed, message, t
  FROM last, w),
ended AS (
  SELECT *, CASE WHEN out_of_time THEN 'FAILED' ELSE status END AS st,
         CASE WHEN out_of_time THEN started + INTERVAL '30' MINUTE ELSE completed END AS fin FROM passed)
SELECT job_id, st AS status, started AS started_at, fin AS completed_at, n_events, n_illegal,
       CASE WHEN out_of_time THEN 'Job timed out during forced cleanup' ELSE message END AS error_message,
       dropped OR coalesce(st IN ('COMPLETED', 'FAILED') AND fin + INTERVAL '60' MINUTE <= t, false) AS dropped, n_late
FROM ended"""

# both snapshots: the whole table, and the jobs that are not of low priority
ORACLE["w03_swept_jobs"] = with_(JOBS, SWEEP_FLAGS) + f"""
SELECT snapshot, job_id, CASE WHEN timed_out THEN 'FAILED' ELSE status END AS status, started_at,
       CASE WHEN timed_out THEN {NOW} ELSE completed_at END AS completed_at,
       CASE WHEN timed_out THEN 'Job timed out during forced cleanup' ELSE error_message END AS error_message
FROM flags, (VALUES ('whole'), ('urgent')) s(snapshot)
WHERE NOT stale AND (snapshot = 'whole' OR priority <> 'LOW')"""
ORACLE["w03_sweep_report"] = with_(JOBS, SWEEP_FLAGS) + """
SELECT snapshot, count(*) AS initial_job_count, count(*) FILTER (WHERE NOT stale) AS final_job_count,
       count(*) FILTER (WHERE stale AND status = 'COMPLETED') AS stale_completed_removed,
       count(*) FILTER (WHERE stale AND status = 'FAILED') AS stale_failed_removed,
       count(*) FILTER (WHERE timed_out) AS processing_timed_out
FROM flags, (VALUES ('whole'), ('urgent')) s(snapshot)
WHERE snapshot = 'whole' OR priority <> 'LOW' GROUP BY snapshot"""
