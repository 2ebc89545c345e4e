"""DuckDB oracle SQL for each registered query (driver tables are pre-registered views).

The SQL restates each query's semantics independently of the Spark code: it starts from the
same history derivation (``HISTORY_CTE``) and computes results directly (for JSON bodies it
unnests the source words instead of parsing JSON).
"""

from __future__ import annotations

from learnlog import constants as K
from learnlog import prompts as P
from learnlog.functions.text import DANGEROUS_CHARS, WS_CLASS_RE2
from learnlog.plans import queries as Q
from learnlog.sources import files as FS
from learnlog.sources.fixtures import DIFFICULTIES, HISTORY_CTE, LANG_CODE_TO_NAME, PARTS_OF_SPEECH

ORACLE: dict[str, str] = {}
NL = "chr(10)"
BIG = 1000000000


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS_CLASS_RE2}+|{WS_CLASS_RE2}+$', '', 'g')"


def case_map(x: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {v if isinstance(v, int) else lit(v)}" for k, v in mapping.items())
    return f"CASE {x} {whens} ELSE {default} END"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def list_lit(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def contains_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {lit(w)})" for w in words) + ")"


def fill(template: str, **values: str) -> str:
    out = []
    while template:
        at, name = min(((template.find("{" + n + "}"), n) for n in values if "{" + n + "}" in template),
                       default=(len(template), ""))
        if at:
            out.append(lit(template[:at]))
        if name:
            out.append(f"coalesce({values[name]}, '')")
        template = template[at + len(name) + 2:] if name else ""
    return "(" + " || ".join(out or ["''"]) + ")"


L = "string_split(input_text, chr(10))"
O = "string_split(output_text, chr(10))"
FIRST = "string_split({}, ' ')[1]".format
LANG_OF_DOC = case_map("lang", LANG_CODE_TO_NAME)
LANG_OF_CONV = f"{list_lit(list(LANG_CODE_TO_NAME.values()))}[conv_id % 4 + 1]"

H = "WITH " + HISTORY_CTE
INPUT_OF = "CASE WHEN mode = 'exercise' THEN '' WHEN mode = 'learning_tips' THEN NULL ELSE input_text END"
OUTPUT_OF = ("CASE WHEN mode IN ('analysis', 'exercise') THEN '' WHEN mode = 'learning_tips' THEN NULL "
             "ELSE output_text END")
VOICE_OF = case_map("language", K.LANGUAGE_VOICE_MAPPING, lit(K.DEFAULT_VOICE))
EX_TYPE = "['vocabulary', 'grammar', 'translation'][eid % 3 + 1]"
HAS_AUDIO = "(eid % 3 = 0 AND length(output_text) > 0)"


def q(name):
    def deco(fn):
        ORACLE[name] = fn()
        return fn
    return deco


# --- 1. history -------------------------------------------------------------------------------

@q("history_scan")
def _():
    return H + "SELECT id, ts, mode, language FROM h"


@q("history_union")
def _():
    return H + """SELECT mode, count(*) AS n, count(*) FILTER (WHERE length(txt) > 0) AS n_with_text FROM (
  SELECT mode, CASE mode WHEN 'exercise' THEN '' WHEN 'learning_tips' THEN output_text
    WHEN 'chat_session' THEN chat_text ELSE input_text END AS txt FROM h) GROUP BY mode"""


@q("history_stats")
def _():
    return H + "SELECT count(*) AS total_points FROM h"


@q("history_dashboard")
def _():
    return H + """SELECT kind_group, id, rn FROM (
  SELECT kind_group, id, row_number() OVER (PARTITION BY kind_group ORDER BY ts DESC, id) AS rn FROM (
    SELECT CASE WHEN mode = 'translation' THEN 'translations'
      WHEN mode IN ('correction', 'analysis', 'exercise') THEN 'corrections'
      WHEN mode = 'learning_tips' THEN 'tips' ELSE 'chat_sessions' END AS kind_group, id, ts FROM h)) WHERE rn <= 20"""


@q("history_ordinal")
def _():
    return H + """SELECT mode, id, CASE WHEN mode = 'translation'
  THEN row_number() OVER (PARTITION BY mode ORDER BY ts, id)
  ELSE row_number() OVER (PARTITION BY mode ORDER BY ts DESC, id DESC) END AS ordinal
FROM h WHERE mode IN ('translation', 'correction', 'analysis')"""


@q("history_by_language")
def _():
    return H + f"SELECT language, mode, id FROM h WHERE language = {lit(Q.FILTER_LANGUAGE)}"


@q("get_translations")
def _():
    return H + f"""SELECT id, ts, input_text AS input, output_text AS output, language AS target_language,
  'translation' AS mode, {VOICE_OF} AS voice, CASE WHEN {HAS_AUDIO} THEN output_text END AS audio_text
FROM h WHERE mode = 'translation' ORDER BY ts DESC, id LIMIT 50"""


@q("get_corrections")
def _():
    return H + f"""SELECT id, ts, {INPUT_OF} AS input, {OUTPUT_OF} AS output, language, mode, explanation,
  CASE WHEN mode = 'analysis' THEN CAST(len({L}) AS BIGINT) END AS n_vocabulary,
  CASE WHEN mode = 'exercise' THEN {EX_TYPE} END AS exercise_type
FROM h WHERE mode IN ('correction', 'analysis', 'exercise') ORDER BY ts DESC, id LIMIT 50"""


@q("get_tips_history")
def _():
    return H + f"""SELECT id, ts, language, output_text AS tips_text,
  CAST(len(string_split(output_text, {NL})) AS BIGINT) AS tips_count, 'learning_tips' AS mode
FROM h WHERE mode = 'learning_tips' ORDER BY ts DESC, id LIMIT 20"""


@q("get_chat_sessions")
def _():
    return H + """SELECT id, ts, language, '' AS context, chat_text, message_count, mode
FROM h WHERE mode = 'chat_session' ORDER BY ts DESC, id LIMIT 20"""


@q("archive_by_mode")
def _():
    return H + f"SELECT mode, id, {INPUT_OF} AS input FROM h WHERE mode IN ('correction', 'analysis', 'exercise')"


@q("build_translation_rows")
def _():
    return H + f"""SELECT input_text, output_text, language AS target_language, 'translation' AS mode,
  {VOICE_OF} AS voice, {HAS_AUDIO} AS has_audio,
  CASE WHEN {HAS_AUDIO} THEN base64(encode(output_text)) END AS audio_data FROM h WHERE mode = 'translation'"""


@q("build_correction_rows")
def _():
    return H + f"""SELECT {INPUT_OF} AS input_text, {OUTPUT_OF} AS output_text, language, mode, explanation,
  mode = 'analysis' AS has_analysis, mode = 'exercise' AS has_exercise
FROM h WHERE mode IN ('correction', 'analysis', 'exercise')"""


@q("tips_rows")
def _():
    return H + f"""SELECT id, output_text AS tips_text,
  CAST(len(string_split(output_text, {NL})) AS BIGINT) AS tips_count FROM h WHERE mode = 'learning_tips'"""


@q("upsert_latest")
def _():
    return """SELECT user_id, event_id, ts FROM (
  SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1"""


@q("delete_items")
def _():
    return H + """SELECT id, mode FROM h WHERE NOT EXISTS (
  SELECT 1 FROM labels l WHERE l.doc_id = h.doc_id AND l.toxic = 1)"""


# --- 2. text ----------------------------------------------------------------------------------

def text_reason(x: str) -> str:
    n = f"length({strip(x)})"
    return (f"CASE WHEN {x} IS NULL OR {n} = 0 THEN {lit(K.MSG_EMPTY_TEXT)} "
            f"WHEN {n} < {K.MIN_TEXT_LENGTH} THEN {lit(K.MSG_TEXT_TOO_SHORT)} "
            f"WHEN {n} > {K.MAX_TEXT_LENGTH} THEN {lit(K.MSG_TEXT_TOO_LONG)} ELSE '' END")


def sanitize(x: str) -> str:
    collapsed = f"regexp_replace({strip(x)}, '{WS_CLASS_RE2}+', ' ', 'g')"
    removed = f"translate({collapsed}, {lit(DANGEROUS_CHARS)}, '')"
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN '' ELSE {strip(removed)} END"


@q("validate_text")
def _():
    r = text_reason("text")
    return f"""SELECT doc_id, ({r}) = '' AS is_valid, {r} AS reason,
  coalesce(length({strip('text')}) > 3, false) AS accepted_by_gate FROM documents"""


@q("validate_language")
def _():
    reason = (f"CASE WHEN value IS NULL OR length({strip('value')}) = 0 THEN {lit(K.MSG_PICK_LANGUAGE)} "
              f"WHEN value NOT IN {in_list(K.SUPPORTED_LANGUAGES)} THEN {lit(K.MSG_UNSUPPORTED_LANGUAGE)} || value "
              f"ELSE '' END")
    return f"""SELECT doc_id, value, ({reason}) = '' AS is_valid, {reason} AS reason FROM (
  SELECT doc_id, {LANG_OF_DOC} AS value FROM documents
  UNION ALL SELECT doc_id, lang AS value FROM documents)"""


@q("validate_exercise_type")
def _():
    reason = (f"CASE WHEN value IS NULL OR value NOT IN {in_list(K.EXERCISE_TYPES)} "
              f"THEN {lit(K.MSG_UNKNOWN_EXERCISE)} || coalesce(value, 'None') ELSE '' END")
    return f"""SELECT event_id, value, ({reason}) = '' AS is_valid, {reason} AS reason FROM (
  SELECT event_id, {case_map('event_type', Q.EVENT_EXERCISE_TYPE, 'event_type')} AS value FROM events)"""


@q("sanitize_text")
def _():
    return f"SELECT doc_id, {sanitize('text')} AS clean FROM documents"


@q("text_preview")
def _():
    return f"""SELECT doc_id, CAST(length(text) AS BIGINT) AS n,
  CASE WHEN length(text) > {K.PREVIEW_CHARS} THEN substring(text, 1, {K.PREVIEW_CHARS}) || '...' ELSE text END AS preview
FROM documents"""


@q("tts_input")
def _():
    return f"""SELECT doc_id, CAST(length(text) AS BIGINT) AS n,
  CASE WHEN length(text) > {K.TTS_MAX_CHARS} THEN substring(text, 1, {K.TTS_MAX_CHARS}) || '...' ELSE text END AS tts_text
FROM documents"""


def chain(base: str, steps: list[str], cols: str = "doc_id") -> str:
    """Apply ``steps`` (expressions over ``x``) one after another via nested subqueries."""
    sql = base
    for s in steps:
        sql = f"SELECT {cols}, {s} AS x FROM ({sql})"
    return sql


def prefix_steps(prefixes) -> list[str]:
    return [f"CASE WHEN starts_with(x, {lit(p)}) THEN {strip(f'substring(x, {len(p) + 1}, {BIG})')} ELSE x END"
            for p in prefixes]


@q("clean_prefixes")
def _():
    tp = K.TRANSLATION_PREFIXES
    reply = (f"CASE WHEN doc_id % 7 < 6 THEN {list_lit(tp)}[doc_id % 7 + 1] || ' ' || text "
             f"ELSE {lit(tp[0] + ' ' + tp[1] + ' ')} || text END")
    base = f"SELECT doc_id, {reply} AS x FROM documents"
    a = chain(base, prefix_steps(K.TRANSLATION_PREFIXES))
    b = chain(base, prefix_steps(K.CORRECTION_PREFIXES))
    return f"""SELECT a.doc_id, a.x AS cleaned, b.x AS cleaned_correction
FROM ({a}) a JOIN ({b}) b ON a.doc_id = b.doc_id"""


@q("strip_fences")
def _():
    reply = (f"CASE doc_id % 4 WHEN 0 THEN '```json' || {NL} || text || {NL} || '```' "
             f"WHEN 1 THEN '```' || {NL} || text || {NL} || '```' WHEN 2 THEN '  ```' || text ELSE text END")
    steps = [strip("x"),
             f"CASE WHEN starts_with(x, '```json') THEN substring(x, 8, {BIG}) ELSE x END",
             "CASE WHEN ends_with(x, '```') THEN left(x, length(x) - 3) ELSE x END",
             f"CASE WHEN starts_with(x, '```') THEN substring(x, 4, {BIG}) ELSE x END",
             "CASE WHEN ends_with(x, '```') THEN left(x, length(x) - 3) ELSE x END",
             strip("x")]
    return f"SELECT doc_id, x AS body FROM ({chain(f'SELECT doc_id, {reply} AS x FROM documents', steps)})"


@q("tips_parse")
def _():
    marked = (f"array_to_string(list_transform(string_split(text, {NL}), "
              f"lambda l, i: CASE WHEN (i - 1) % 2 = 0 THEN {lit(K.TIP_BULLET)} || l ELSE l END), {NL})")
    lines = f"list_transform(string_split({strip('reply')}, {NL}), lambda l: {strip('l')})"
    tips = f"list_filter({lines}, lambda l: starts_with(l, {lit(K.TIP_BULLET)}))"
    return f"""SELECT doc_id, unnest(generate_series(0, len(tips) - 1)) AS pos, unnest(tips) AS tip FROM (
  SELECT doc_id, CASE WHEN len(t) > 0 THEN t ELSE [{lit(K.MSG_NO_TIPS)}] END AS tips FROM (
    SELECT doc_id, {tips} AS t FROM (SELECT doc_id, {marked} AS reply FROM documents)))"""


@q("tips_lines")
def _():
    return f"""SELECT doc_id, unnest(generate_series(0, len(l) - 1)) AS pos, unnest(l) AS line FROM (
  SELECT doc_id, list_filter(string_split(text, {NL}), lambda x: {strip('x')} <> '') AS l FROM documents)"""


MARKED = (f"SELECT doc_id, {list_lit(Q.ERROR_MARKERS)}[doc_id % {len(Q.ERROR_MARKERS)} + 1] || text AS reply "
          f"FROM documents")


@q("response_ok")
def _():
    return f"""SELECT doc_id, coalesce(length(reply) > 0 AND NOT contains(lower(reply), 'error'), false) AS ok
FROM ({MARKED})"""


@q("error_class")
def _():
    whens = " ".join(f"WHEN {contains_any('reply', words)} THEN {lit(name)}" for name, words in K.ERROR_CLASSES)
    return f"SELECT doc_id, CASE {whens} ELSE 'other' END AS class FROM ({MARKED})"


@q("parse_timestamp")
def _():
    return "SELECT event_id, ts FROM events"


@q("format_timestamps")
def _():
    return """SELECT event_id, strftime(ts, '%H:%M:%S') AS clock, strftime(ts, '%d.%m.%Y %H:%M') AS day_minute,
  strftime(ts, '%Y%m%d_%H%M%S') AS file_stamp FROM events"""


# --- 3. nested / JSON -------------------------------------------------------------------------

@q("analysis_roundtrip")
def _():
    return H + f"""SELECT id, CAST(len({L}) AS BIGINT) AS n_vocabulary, CAST(len({O}) AS BIGINT) AS n_rules,
  CAST(len({O}) AS BIGINT) AS n_tips, {FIRST(O + "[1]")} AS first_rule, input_text AS sentences,
  output_text AS examples, output_text AS tips
FROM h WHERE mode = 'analysis'"""


VOCAB_ROWS = f"""vocab AS (
  SELECT id, ts, language, pos, {FIRST('l')} AS word FROM (
    SELECT id, ts, language, unnest(generate_series(0, len({L}) - 1)) AS pos, unnest({L}) AS l
    FROM h WHERE mode = 'analysis'))"""


@q("vocabulary")
def _():
    return H + "," + VOCAB_ROWS + f"""SELECT id, pos, word, 'pl:' || word AS translation,
  {list_lit(DIFFICULTIES)}[pos % 3 + 1] AS difficulty FROM vocab"""


@q("exercise_roundtrip")
def _():
    return H + f"""SELECT id, {EX_TYPE} AS type, CASE WHEN eid % 5 <> 0 THEN {FIRST('input_text')} END AS title,
  input_text AS question, output_text AS correct_answer,
  CASE WHEN eid % 3 = 0 THEN CAST(len({L}) AS BIGINT) END AS n_options,
  {list_lit(DIFFICULTIES)}[(eid // 3) % 3 + 1] AS difficulty,
  CASE WHEN eid % 2 = 0 THEN 'Podpowiedź' END AS hint
FROM h WHERE mode = 'exercise'"""


@q("exercise_options")
def _():
    return H + f"""SELECT id, CASE WHEN eid % 3 = 0 THEN
  array_to_string(list_transform({L}, lambda x, i: i || '. ' || x), {NL}) END AS options_text
FROM h WHERE mode = 'exercise'"""


@q("exercise_context")
def _():
    title = f"coalesce(CASE WHEN eid % 5 <> 0 THEN {FIRST('input_text')} END, {lit(K.DEFAULT_EXERCISE_TITLE)})"
    return H + "\nUNION ALL\n".join(
        f"""SELECT id, {archive} AS archive, {lit(prefix)} || {title} || ' - ' || input_text
  || ' - Odpowiedź: ' || output_text AS context FROM h WHERE mode = 'exercise'""" for archive, prefix in (
            ("false", K.EXERCISE_CONTEXT_PREFIX_LATEST), ("true", K.EXERCISE_CONTEXT_PREFIX_ARCHIVE)))


@q("grammar_rules")
def _():
    return H + f"""SELECT id, rule_pos, {FIRST('l')} AS rule,
  unnest(generate_series(0, len(string_split(l, ' ')) - 1)) AS example_pos, unnest(string_split(l, ' ')) AS example
FROM (SELECT id, unnest(generate_series(0, len({O}) - 1)) AS rule_pos, unnest({O}) AS l FROM h WHERE mode = 'analysis')"""


@q("analysis_digest")
def _():
    heads = "array_to_string(list_transform({}, lambda x: string_split(x, ' ')[1]), '|')".format
    return H + f"""SELECT id, {heads(L + "[1:3]")} AS vocab_head, {heads(O + "[1:2]")} AS rules_head,
  array_to_string(string_split({O}[1], ' ')[1:2], '|') AS examples_latest,
  array_to_string(string_split({O}[1], ' ')[1:3], '|') AS examples_archive,
  array_to_string({O}[1:3], '|') AS tips_head
FROM h WHERE mode = 'analysis'"""


@q("exercise_parse")
def _():
    ok = "doc_id % 4 IN (0, 1)"
    return f"""SELECT doc_id,
  CASE doc_id % 4 WHEN 2 THEN {lit(K.MSG_AI_NOT_JSON)} WHEN 3 THEN {lit(K.MSG_AI_PARSE_ERROR)} END AS error,
  CASE WHEN {ok} THEN 'vocabulary' END AS type,
  CASE WHEN {ok} THEN string_split(text, {NL})[1] END AS title,
  CASE WHEN {ok} THEN text END AS question, CASE WHEN {ok} THEN text END AS options
FROM documents"""


@q("word_parse")
def _():
    w = "string_split(text, ' ')[1]"
    return f"""SELECT doc_id, {w} AS word,
  CASE WHEN doc_id % 3 = 0 THEN {lit(K.MSG_WORD_PARSE_ERROR)} ELSE 'pl:' || {w} END AS translation,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'noun' END AS part_of_speech,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS definition,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS examples
FROM documents"""


# --- 4. analytics -----------------------------------------------------------------------------

@q("vocabulary_counts")
def _():
    return H + f"""SELECT language, CAST(sum(len({L})) AS BIGINT) AS n FROM h
WHERE mode = 'analysis' GROUP BY language"""


@q("vocabulary_top20")
def _():
    return H + "," + VOCAB_ROWS + """SELECT language, rn, word FROM (
  SELECT language, word, row_number() OVER (PARTITION BY language ORDER BY ts DESC, id, pos) AS rn FROM vocab)
WHERE rn <= 20"""


COUNTS = """SELECT language, count(*) FILTER (WHERE mode = 'translation') AS translations,
  count(*) FILTER (WHERE mode = 'correction') AS corrections,
  count(*) FILTER (WHERE mode = 'analysis') AS analyses
FROM h WHERE mode IN ('translation', 'correction', 'analysis') GROUP BY language"""


@q("language_summary")
def _():
    return H + COUNTS


@q("summary_full_outer")
def _():
    return H + """SELECT coalesce(t.language, c.language) AS language, coalesce(t.translations, 0) AS translations,
  coalesce(c.corrections, 0) AS corrections, coalesce(c.analyses, 0) AS analyses FROM
  (SELECT language, count(*) AS translations FROM h WHERE mode = 'translation' GROUP BY language) t
  FULL OUTER JOIN
  (SELECT language, count(*) FILTER (WHERE mode = 'correction') AS corrections,
     count(*) FILTER (WHERE mode = 'analysis') AS analyses
   FROM h WHERE mode IN ('correction', 'analysis', 'exercise') GROUP BY language) c
  ON t.language = c.language"""


ERRORS = """errs AS (SELECT language, rn, substring(explanation, 1, 100) || '...' AS snippet FROM (
  SELECT language, explanation, row_number() OVER (PARTITION BY language ORDER BY ts DESC, id) AS rn
  FROM h WHERE mode = 'correction' AND length(explanation) > 0) WHERE rn <= 5)"""


@q("recent_errors")
def _():
    return H + "," + ERRORS + "SELECT language, rn, snippet FROM errs"


SUMMARY = f"""counts AS ({COUNTS}),
nv AS (SELECT language, sum(len({L})) AS n FROM h WHERE mode = 'analysis' GROUP BY language),
{VOCAB_ROWS},
vtop AS (SELECT language, rn, '- ' || word || ' (pl:' || word || ') - ' || {list_lit(PARTS_OF_SPEECH)}[pos % 3 + 1]
    || {lit(K.SUMMARY_LEVEL)} || {list_lit(DIFFICULTIES)}[pos % 3 + 1] AS line FROM (
  SELECT language, word, pos, row_number() OVER (PARTITION BY language ORDER BY ts DESC, id, pos) AS rn FROM vocab)
  WHERE rn <= 20),
vl AS (SELECT language, string_agg(line, {NL} ORDER BY rn) AS vocab_lines FROM vtop GROUP BY language),
{ERRORS},
el AS (SELECT language, string_agg('- ' || snippet, {NL} ORDER BY rn) AS error_lines FROM errs GROUP BY language),
summaries AS (
  SELECT coalesce(c.language, nv.language, vl.language, el.language) AS language,
    {lit(K.SUMMARY_HEADER)} || upper(coalesce(c.language, nv.language, vl.language, el.language)) || ':' || {NL}
    || {lit(K.SUMMARY_TRANSLATIONS)} || coalesce(c.translations, 0) || {NL}
    || {lit(K.SUMMARY_CORRECTIONS)} || coalesce(c.corrections, 0) || {NL}
    || {lit(K.SUMMARY_ANALYSES)} || coalesce(c.analyses, 0) || {NL}
    || {lit(K.SUMMARY_WORDS + '(')} || coalesce(nv.n, 0) || '):' || {NL}
    || coalesce(vl.vocab_lines, '') || {NL}
    || {lit(K.SUMMARY_ERRORS_HEADER)} || {NL}
    || coalesce(el.error_lines, '') AS summary
  FROM counts c FULL OUTER JOIN nv ON c.language = nv.language
  FULL OUTER JOIN vl ON coalesce(c.language, nv.language) = vl.language
  FULL OUTER JOIN el ON coalesce(c.language, nv.language, vl.language) = el.language)
"""


@q("summary_text")
def _():
    return H + "," + SUMMARY + "SELECT language, summary FROM summaries"


@q("voice_lookup")
def _():
    labels = dict(K.AVAILABLE_VOICES)
    return H + f"""SELECT id, language, voice, {case_map('voice', labels)} AS voice_label FROM (
  SELECT id, language, {VOICE_OF} AS voice FROM h WHERE mode = 'translation')"""


@q("label_lookup")
def _():
    flags = {v: k for k, v in K.FLAGGED_LANGUAGE_NAMES.items()}
    return H + f"""SELECT id, exercise_type, {case_map('exercise_type', K.EXERCISE_TYPE_LABELS)} AS type_label,
  {case_map('language', flags)} AS language_label, language AS language_back FROM (
  SELECT id, language, {EX_TYPE} AS exercise_type FROM h WHERE mode = 'exercise')"""


QUESTIONS = f"""questions AS (
  SELECT conv_id, turn, {LANG_OF_CONV} AS language,
    {list_lit(['', 'grammar ', 'practice ', 'explain '])}[conv_id % 4 + 1] || text AS question
  FROM conversations WHERE role = 'user'),
routed AS (
  SELECT *, CASE WHEN NOT coalesce({contains_any('question', K.LANGUAGE_KEYWORDS)}, false) THEN 'refuse'
    WHEN coalesce({contains_any('question', K.CONVERSATION_KEYWORDS)}, false) THEN 'conversation'
    ELSE 'explain' END AS route FROM questions)
"""


@q("question_prompt")
def _():
    conv = fill(P.CHAT_CONVERSATION_SYSTEM, language="r.language", context="''", summary="s.summary")
    expl = fill(P.CHAT_EXPLAIN_SYSTEM, language="r.language", context="''", summary="s.summary")
    refusal = lit(K.REFUSAL_TEMPLATE.replace("%s", "{language}"))
    return H + "," + SUMMARY + "," + QUESTIONS + f"""SELECT r.conv_id, r.turn, r.route,
  CASE r.route WHEN 'conversation' THEN {conv} WHEN 'explain' THEN {expl} END AS system,
  CASE WHEN r.route <> 'refuse' THEN r.question END AS user,
  CASE WHEN r.route = 'refuse' THEN replace({refusal}, '{{language}}', r.language) END AS refusal
FROM routed r LEFT JOIN summaries s ON r.language = s.language"""


@q("tips_context")
def _():
    p = lit(K.TIPS_CONTEXT_PREFIX)
    return H + f"""SELECT id, {p} || array_to_string(string_split(output_text, {NL}), ' ') AS context_fresh,
  {p} || output_text AS context_archive FROM h WHERE mode = 'learning_tips'"""


@q("build_prompts")
def _():
    parts = []
    for task, s, u in [("translate", P.TRANSLATE_SYSTEM, P.TRANSLATE_USER),
                       ("correct", P.CORRECT_SYSTEM, P.CORRECT_USER),
                       ("analyze", P.ANALYZE_SYSTEM, P.ANALYZE_USER)]:
        parts.append(f"""SELECT doc_id, {lit(task)} AS task, {fill(s, language='language')} AS system,
  {fill(u, language='language', text='text')} AS user FROM (SELECT doc_id, text, {LANG_OF_DOC} AS language FROM documents)""")
    return "\nUNION ALL\n".join(parts)


# --- 5. chat ----------------------------------------------------------------------------------

@q("question_routing")
def _():
    return "WITH " + QUESTIONS + "SELECT conv_id, turn, route FROM routed"


TRANSCRIPT = f"""SELECT conv_id, string_agg(role || ': ' || text, {NL} ORDER BY turn) AS chat_text,
  count(*) AS message_count FROM conversations GROUP BY conv_id"""


@q("chat_transcript")
def _():
    return TRANSCRIPT


@q("chat_snapshots")
def _():
    return H + """SELECT conv_id, turn, message_count, chat_text FROM snaps
WHERE role = 'assistant' AND message_count >= 2"""


@q("chat_parse")
def _():
    content = (f"CASE WHEN starts_with(raw, 'user:') THEN {strip(f'substring(raw, 6, {BIG})')} "
               f"ELSE {strip(f'substring(raw, 11, {BIG})')} END")
    return f"""SELECT conv_id, line, CASE WHEN starts_with(raw, 'user:') THEN 'user' ELSE 'assistant' END AS role,
  {content} AS content FROM (
  SELECT conv_id, unnest(generate_series(0, len(l) - 1)) AS line, unnest(l) AS raw FROM (
    SELECT conv_id, string_split(chat_text, {NL}) AS l FROM ({TRANSCRIPT})))
WHERE {strip('raw')} <> '' AND (starts_with(raw, 'user:') OR starts_with(raw, 'assistant:'))"""


# --- 6. audio ---------------------------------------------------------------------------------

@q("audio_base64")
def _():
    return "SELECT doc_id, base64(encode(text)) AS b64, CAST(text AS VARCHAR) = text AS decodes FROM documents"


@q("audio_valid")
def _():
    tts = (f"CASE WHEN length(text) > {K.TTS_MAX_CHARS} THEN substring(text, 1, {K.TTS_MAX_CHARS}) || '...' "
           f"ELSE text END")
    return f"""SELECT doc_id, coalesce(octet_length(encode({tts})) >= {K.MIN_AUDIO_SIZE_BYTES}, false) AS valid,
  coalesce(octet_length(encode({tts})) > 0, false) AS has_audio FROM documents"""


# --- 7. model tasks over recorded replies --------------------------------------------------------

DOCS_LANG = f"(SELECT doc_id, text, {LANG_OF_DOC} AS language FROM documents)"


@q("model_translate")
def _():
    r = text_reason("text")
    reply = strip(f"{sanitize('text')} || ' [pl]'")
    return f"""SELECT doc_id, CASE WHEN ({r}) = '' THEN {reply} END AS output,
  CASE WHEN ({r}) <> '' THEN {r} END AS error FROM documents"""


@q("model_correct")
def _():
    better = strip("text || ' (ok)'")
    return f"""SELECT doc_id, {better} AS output, {strip("'Poprawiono: ' || " + better)} AS explanation,
  CAST(NULL AS VARCHAR) AS error FROM documents"""


@q("model_analyze")
def _():
    bad = "length(text) % 5 = 0"
    n = f"len(string_split(text, {NL}))"
    return f"""SELECT doc_id, CAST(CASE WHEN {bad} THEN 0 ELSE {n} END AS BIGINT) AS n_vocabulary,
  CASE WHEN {bad} THEN '' ELSE text END AS sentences,
  CASE WHEN {bad} THEN {lit(P.ANALYZE_FAILURE_TIP + K.MSG_AI_PARSE_ERROR)} ELSE text END AS tips,
  CASE WHEN {bad} THEN {lit(K.MSG_AI_PARSE_ERROR)} END AS error FROM documents"""


def answers(answer: str, route: str) -> str:
    return "WITH " + QUESTIONS + f"""SELECT conv_id, turn, {route} answer,
  coalesce(length(answer) > 0 AND NOT contains(lower(answer), 'error'), false) AS ok, CAST(NULL AS VARCHAR) AS error
FROM (SELECT *, {answer} AS answer FROM routed)"""


REPLY_TO_QUESTION = strip("CASE WHEN length(question) % 4 = 0 THEN 'Error: ' ELSE '' END || question || ' !'")


@q("model_answer")
def _():
    refusal = lit(K.REFUSAL_TEMPLATE.replace("%s", "{language}"))
    return answers(f"CASE WHEN route = 'refuse' THEN replace({refusal}, '{{language}}', language) "
                   f"ELSE {REPLY_TO_QUESTION} END", "route,")


@q("model_answer_plain")
def _():
    return answers(REPLY_TO_QUESTION, "")


@q("model_tips")
def _():
    line = strip(f"{lit(K.TIP_BULLET)} || l")
    kept = (f"list_filter(list_transform(string_split(summary, {NL}), lambda l: {line}), "
            f"lambda l: starts_with(l, {lit(K.TIP_BULLET)}))")
    return H + "," + SUMMARY + f"""SELECT language, unnest(generate_series(0, len(tips) - 1)) AS pos,
  unnest(tips) AS tip, CAST(NULL AS VARCHAR) AS error FROM (
  SELECT language, CASE WHEN len(t) > 0 THEN t ELSE [{lit(K.MSG_NO_TIPS)}] END AS tips FROM (
    SELECT language, {kept} AS t FROM summaries))"""


@q("model_exercise")
def _():
    return H + "," + SUMMARY + f"""SELECT id, {EX_TYPE} AS exercise_type, CAST(NULL AS VARCHAR) AS error,
  {EX_TYPE} AS type, h.language AS title, s.summary AS question,
  CAST(len(string_split(s.summary, {NL})) AS BIGINT) AS n_options
FROM h LEFT JOIN summaries s ON h.language = s.language WHERE mode = 'exercise'"""


@q("model_word")
def _():
    bad = "length(word) % 3 = 0"
    return f"""SELECT language, word, CASE WHEN {bad} THEN {lit(K.MSG_WORD_PARSE_ERROR)} ELSE 'pl:' || word END AS translation,
  CAST(CASE WHEN {bad} THEN 0 ELSE 2 END AS BIGINT) AS n_examples, CAST(NULL AS VARCHAR) AS error
FROM (SELECT DISTINCT language, unnest(string_split(text, ' ')) AS word FROM {DOCS_LANG})"""


@q("model_speech")
def _():
    tts = (f"CASE WHEN length(text) > {K.TTS_MAX_CHARS} THEN substring(text, 1, {K.TTS_MAX_CHARS}) || '...' "
           f"ELSE text END")
    n = f"octet_length(encode({tts})) * CASE WHEN length({tts}) % 2 = 0 THEN 2 ELSE 1 END"
    voice = case_map(LANG_OF_DOC, K.LANGUAGE_VOICE_MAPPING, lit(K.DEFAULT_VOICE))
    return f"""SELECT doc_id, {voice} AS voice,
  CAST(CASE WHEN {n} >= {K.MIN_AUDIO_SIZE_BYTES} THEN {n} END AS BIGINT) AS n_bytes,
  CASE WHEN {n} < {K.MIN_AUDIO_SIZE_BYTES} THEN 'audio too small' END AS error FROM documents"""


# --- uploads, ingest stamp, clear ----------------------------------------------------------------

@q("file_gate")
def _():
    ext = "lower(string_split(string_split(url, '/')[-1], '.')[-1])"
    mb = "octet_length(encode(html)) / 1048576"
    reason = (f"CASE WHEN {mb} > {Q.UPLOAD_LIMIT_MB} THEN {lit(K.MSG_FILE_TOO_LARGE)} "
              f"WHEN {ext} NOT IN {in_list(K.SUPPORTED_FILE_TYPES)} THEN {lit(K.MSG_UNSUPPORTED_FORMAT + ': ')} || {ext} ELSE '' END")
    return f"SELECT page_id, {ext} AS ext, {mb} AS mb, ({reason}) = '' AS ok, {reason} AS reason FROM pages"


@q("decode_txt")
def _():
    page = lambda e: "[" + ", ".join(str(ord(bytes([b]).decode(e, "replace"))) for b in range(256)) + "]"
    read = lambda e: f"'ć' || array_to_string(list_transform(b, lambda x: chr(({page(e)})[x + 1])), '')"
    return f"""WITH d AS (SELECT doc_id, text, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents),
b AS (SELECT doc_id, text, n, CASE WHEN doc_id % 2 <> 0 THEN
        list_transform(range(n), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS INTEGER)) END AS b FROM d),
e AS (SELECT *, CASE WHEN text IS NULL THEN NULL WHEN doc_id % 2 = 0 THEN 'utf-8'
        WHEN len(list_intersect(b, [129, 131, 136, 144, 152])) = 0 THEN 'cp1250' ELSE 'iso-8859-2' END AS encoding FROM b)
SELECT doc_id || '.txt' AS path, CAST(n + doc_id % 2 AS BIGINT) AS length,
  CASE encoding WHEN 'utf-8' THEN text WHEN 'cp1250' THEN {read('cp1250')} WHEN 'iso-8859-2' THEN {read('iso-8859-2')} END AS text,
  encoding, CASE WHEN text IS NULL THEN {lit(FS.READ_ERROR_PREFIX + FS.NO_CONTENT)} END AS error FROM e"""


@q("lossless_bodies")
def _():
    good = lambda x: f"CASE WHEN doc_id % 3 <> 2 THEN {x} END"
    return f"""SELECT doc_id, doc_id % 3 <> 2 AS valid, {good('text')} AS question, {good('lang')} AS source_lang,
  CAST({good('length(text)')} AS BIGINT) AS size, {good('true')} AS checked, CAST({good('4')} AS BIGINT) AS n_keys FROM documents"""


@q("stamp_records")
def _():
    return "SELECT count(*) AS n, count(*) AS ids, count(*) AS uuids, count(*) AS recent FROM documents"


@q("clear_items")
def _():
    return H + "SELECT 'before' AS state, count(*) AS n FROM h UNION ALL SELECT 'after', 0"


EDITED = f"""WITH e AS (
  SELECT event_id, ts, CAST(user_id AS VARCHAR) AS language,
    coalesce({case_map('event_type', Q.EVENT_MODE)}, 'learning_tips') AS mode FROM events),
newer AS (
  SELECT CAST(event_id - event_id % 20 AS VARCHAR) AS id, ts, mode, language FROM e WHERE event_id % 10 = 9
  QUALIFY row_number() OVER (PARTITION BY event_id - event_id % 20 ORDER BY ts DESC, language DESC, mode DESC) = 1),
edited AS (
  SELECT * FROM (SELECT CAST(event_id AS VARCHAR) AS id, ts, mode, language FROM e
                 WHERE event_id % 10 < 9 AND CAST(event_id AS VARCHAR) NOT IN (SELECT id FROM newer)
                 UNION ALL SELECT * FROM newer)
  WHERE id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL))
"""


@q("edited_items")
def _():
    return EDITED + "SELECT id, ts, mode, language FROM edited"


@q("stream_edited_counts")
def _():
    return EDITED + "SELECT language, mode, count(*) AS n FROM edited GROUP BY language, mode"


# --- 8. freshness and streams -----------------------------------------------------------------

LATEST = f"""latest AS (
  SELECT user_id, event_id, ts, {case_map('event_type', {k: K.TTL_BY_KIND[v] for k, v in Q.EVENT_TTL_KIND.items()})} AS ttl,
    (SELECT max(ts) FROM events) AS as_of
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
  WHERE rn = 1),
fresh AS (
  SELECT user_id, event_id, ts, as_of,
    ts + to_seconds(CAST(CASE WHEN ttl IS NULL OR ttl = 0 THEN {K.DEFAULT_TTL_SECONDS} ELSE ttl END AS BIGINT)) AS expires_at
  FROM latest)
"""


@q("fresh_latest")
def _():
    return "WITH " + LATEST + "SELECT user_id, event_id, ts, expires_at, NOT (as_of > expires_at) AS active FROM fresh"


@q("freshness_stats")
def _():
    return "WITH " + LATEST + """SELECT count(*) AS total, count(*) FILTER (WHERE NOT (as_of > expires_at)) AS active,
  count(*) FILTER (WHERE as_of > expires_at) AS expired FROM fresh"""


@q("cache_reads")
def _():
    ttl = case_map('event_type', {k: K.TTL_BY_KIND[v] for k, v in Q.EVENT_TTL_KIND.items()})
    return f"""WITH w AS (
  SELECT user_id, ts, event_id, {ttl} AS ttl FROM events WHERE event_type <> 'view'
  QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1)
SELECT r.event_id, r.user_id, r.ts, w.event_id AS written_id, w.ts AS written_at,
  CASE WHEN w.event_id IS NULL THEN 'miss'
    WHEN r.ts > w.ts + to_seconds(CAST(CASE WHEN w.ttl IS NULL OR w.ttl = 0 THEN {K.DEFAULT_TTL_SECONDS} ELSE w.ttl END AS BIGINT))
    THEN 'expired' ELSE 'hit' END AS state
FROM (SELECT * FROM events WHERE event_type = 'view') r
ASOF LEFT JOIN w ON r.user_id = w.user_id AND r.ts >= w.ts"""


@q("stream_language_counts")
def _():
    return H + "SELECT language, mode, count(*) AS n FROM h GROUP BY language, mode"


@q("stream_chat_snapshots")
def _():
    return H + """SELECT conv_id, turn, message_count, chat_text FROM snaps
WHERE role = 'assistant' AND message_count >= 2"""


# --- 9. vectors -------------------------------------------------------------------------------

@q("vector_topk")
def _():
    qv = f"(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {Q.VECTOR_QUERY_ID})"
    return f"""SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT vec_id, round(list_dot_product(e, {qv}) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product({qv}, {qv}))), 6) AS score
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
  WHERE list_dot_product(e, e) > 0 AND list_dot_product({qv}, {qv}) > 0
  ORDER BY score DESC, vec_id LIMIT {Q.VECTOR_K})"""


@q("vector_neighbours")
def _():
    return f"""WITH v AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL)
  WHERE list_dot_product(e, e) > 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id AS neighbour_id, round(list_dot_product(q.e, r.e) / (q.n * r.n), 6) AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % {Q.VECTOR_QUERY_STEP} = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbour_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbour_id) AS rank FROM s) WHERE rank <= {Q.VECTOR_K}"""
