"""SQL that states each query's result over the driver's tables, written apart from the DataFrame code."""

from __future__ import annotations

#: Fixed values, written out apart from the operators': categories in order with the word of the table that each stands for, rules with theirs, and texts.
CATEGORY_WORDS = {"direction_mismatch": "that", "verbosity_mismatch": "with", "style_mismatch": "der", "format_mismatch": "la", "late_constraint": "from"}
RULE_WORDS = {"scope_clarification": ["that"], "token_budget_control": ["with"], "exploratory_request": ["this"], "late_constraint": ["from", "der"]}
SUGGESTIONS = {
    "direction_mismatch": "首条 prompt 先写清对象、边界、不要处理什么，再开始执行。",
    "verbosity_mismatch": "把长度、密度、是否展开写成固定前置要求。",
    "style_mismatch": "提前说明语气、正式度、是否允许 AI 味。",
    "format_mismatch": "提前说明输出形式：代码块/列表/可复制文本/不要表格。",
    "late_constraint": "把“先讨论还是先执行、是否允许大搜索、token 预算”放到首条 prompt。",
}
CONSTRAINTS = {
    "direction_mismatch": "对象/边界",
    "verbosity_mismatch": "长度/信息密度",
    "style_mismatch": "风格/语气",
    "format_mismatch": "输出格式/展示方式",
    "late_constraint": "执行顺序/操作边界/预算限制",
}
DESCRIPTIONS = {
    "scope_clarification": "用户需要反复收窄对象或纠正 agent 的理解范围。",
    "token_budget_control": "用户明显在意 token 成本，并多次强调约束。",
    "exploratory_request": "请求偏探索/观察，没有明确成功标准。",
    "late_constraint": "关键约束出现在后续纠偏回合，而不是最开始。",
}


def _rx(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '(?i)(^|[^A-Za-z]){w}([^A-Za-z]|$)')" for w in words) + ")"


def _case(column: str, table: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def _clean(c: str) -> str:
    return rf"regexp_replace(regexp_replace(coalesce({c}, ''), '\r\n?', chr(10), 'g'), '[\x00-\x08\x0b-\x1f\x7f-\x{{9f}}]', '', 'g')"


def _flat(c: str) -> str:
    return rf"trim(regexp_replace({_clean(c)}, '\s+', ' ', 'g'))"


def _line(c: str, n: int) -> str:
    return f"CASE WHEN length({_flat(c)}) > {n} THEN rtrim(substr({_flat(c)}, 1, {n - 1})) || '…' ELSE {_flat(c)} END"


_CATS = "list_filter([" + ", ".join(f"CASE WHEN {_rx('text', [w])} THEN '{c}' END" for c, w in CATEGORY_WORDS.items()) + "], lambda x: x IS NOT NULL)"
_RULES = "list_filter([" + ", ".join(f"CASE WHEN {_rx('text', p)}{' AND turn_index > 1' if r == 'late_constraint' else ''} THEN '{r}' END" for r, p in RULE_WORDS.items()) + "], lambda x: x IS NOT NULL)"

M = """m AS (
  SELECT CAST(conv_id AS VARCHAR) AS session_file, CAST(turn AS INTEGER) AS line_no, role, coalesce(text, '') AS text,
         CAST(CASE WHEN role = 'assistant' THEN length(coalesce(text, '')) % 3 ELSE 0 END AS INTEGER) AS tool_calls
  FROM conversations
)"""
EV = f"""{M}, o AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY session_file, role ORDER BY line_no) AS INTEGER) AS role_turn,
         CASE WHEN role = 'user' THEN {_CATS} END AS cats
  FROM m WHERE role IN ('user', 'assistant')
), w AS (
  SELECT *, lag(role) OVER s AS p_role, lag(text) OVER s AS p_text, lag(tool_calls) OVER s AS p_tools,
         last_value(CASE WHEN role = 'user' THEN line_no END IGNORE NULLS) OVER (PARTITION BY session_file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS orig_line,
         coalesce(bool_or(role = 'assistant') OVER (PARTITION BY session_file ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS answered
  FROM o WINDOW s AS (PARTITION BY session_file ORDER BY line_no)
), h AS (
  SELECT w.*, q.role_turn AS o_turn, q.text AS o_text, q.cats AS o_cats, w.cats[1] AS kind,
         list_filter(list_transform(string_split({_clean('w.text')}, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] AS head
  FROM w JOIN o q ON q.session_file = w.session_file AND q.line_no = w.orig_line
  WHERE w.role = 'user' AND w.p_role = 'assistant' AND len(w.cats) > 0
), ev AS (
  SELECT session_file, role_turn AS trigger_turn, kind AS event_type, array_to_string(cats[2:], ',') AS secondary_types, o_turn AS original_user_turn,
         {_line('o_text', 160)} AS original_user_preview, {_line('p_text', 160)} AS assistant_preview, p_tools AS assistant_tool_calls, {_line('text', 160)} AS evidence,
         CASE WHEN length(head) <= 40 THEN head ELSE {_case('kind', CONSTRAINTS)} END AS missing_constraint,
         CASE WHEN p_tools > 0 THEN 'assistant_already_executed' WHEN answered THEN 'answer_revised' ELSE 'correction_without_revision' END AS impact,
         NOT list_contains(o_cats, kind) AS avoidable,
         CAST(66 + 6 * least(len(cats), 4) + CASE WHEN p_tools > 0 THEN 5 ELSE 0 END AS DOUBLE) / 100 AS confidence,
         {_case('kind', SUGGESTIONS)} AS suggestion
  FROM h
)"""
PROFILE = """pr AS (
  SELECT event_type, count(*) AS n_events, count(DISTINCT session_file) AS n_sessions, sum(CAST(round(confidence * 100) AS BIGINT)) AS hundredths FROM ev GROUP BY 1
), rf AS (
  SELECT event_type, string_agg(session_file || '#turn' || trigger_turn, ',' ORDER BY r) AS refs
  FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY session_file, trigger_turn, original_user_turn) AS r FROM ev) WHERE r <= 4 GROUP BY 1
)"""
UT = f"""{M}, ut AS (
  SELECT session_file, turn_index, text, {_line('text', 180)} AS preview, {_RULES} AS labels
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY session_file ORDER BY line_no) AS INTEGER) AS turn_index FROM m WHERE role = 'user')
)"""
CALLS = """c AS (
  SELECT CAST(user_id AS VARCHAR) AS session, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS INTEGER) AS turn, ts, event_id,
         CASE event_type WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'edit' WHEN 'signup' THEN 'write' ELSE 'bash' END AS tool, event_type,
         CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS k
  FROM events
), calls AS (
  SELECT session, turn, ts, event_id, tool, CASE WHEN tool <> 'bash' THEN 'p' || k || CASE WHEN k < 5 THEN '.py' ELSE '' END END AS path,
         CASE WHEN tool = 'bash' THEN CASE WHEN event_type = 'error' THEN 'run test ' ELSE 'open ' END || k END AS command
  FROM c
), tr AS (
  SELECT session, turn, list(tool ORDER BY ts, event_id) AS tools, list(path ORDER BY ts, event_id) FILTER (tool = 'read') AS read_paths,
         list(path ORDER BY ts, event_id) FILTER (tool = 'edit') AS edit_paths, list(path ORDER BY ts, event_id) FILTER (tool = 'write') AS write_paths,
         list(command ORDER BY ts, event_id) FILTER (tool = 'bash') AS commands
  FROM calls GROUP BY 1, 2
), sq AS (
  SELECT session, turn, array_to_string(list(tool ORDER BY ts, event_id), '>') AS sequence, count(*) AS n_seq
  FROM (SELECT *, lag(tool) OVER (PARTITION BY session, turn ORDER BY ts, event_id) AS was FROM calls) WHERE was IS NULL OR was <> tool GROUP BY 1, 2
), turns AS (SELECT tr.*, sq.sequence, sq.n_seq FROM tr JOIN sq USING (session, turn))"""
PATHS = f"""{CALLS}, flags AS (
  SELECT session, turn, bool_or(coalesce(contains(command, ' test'), false)) AS validated, bool_or(tool = 'edit') AS edited FROM calls GROUP BY 1, 2
), pt AS (
  SELECT session, turn, path, count(*) AS uses, count(*) FILTER (tool = 'read') AS reads, count(*) FILTER (tool = 'edit') AS edits, count(*) FILTER (tool = 'write') AS writes
  FROM calls WHERE path IS NOT NULL GROUP BY 1, 2, 3
), ps AS (
  SELECT path, CAST(sum(uses) AS BIGINT) AS interactions, CAST(sum(reads) AS BIGINT) AS read_count, CAST(sum(edits + writes) AS BIGINT) AS edit_count,
         count(*) FILTER (reads > 0 AND edits > 0) AS read_edit, count(*) FILTER (validated AND edited AND edits + writes > 0) AS edit_validate, min((session, turn)) AS first
  FROM pt JOIN flags USING (session, turn) GROUP BY 1
), tl AS (SELECT path, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools, count(DISTINCT tool) AS n_tools FROM calls WHERE path IS NOT NULL GROUP BY 1
), hot AS (
  SELECT path, interactions, read_count, edit_count, read_edit, edit_validate, tools, first,
         CASE WHEN read_edit >= 2 OR edit_validate >= 2 OR (read_count >= 3 AND edit_count >= 3) THEN 'high' ELSE 'medium' END AS confidence,
         (SELECT string_agg(session || '#turn' || turn, ',' ORDER BY session, turn) FROM (SELECT session, turn FROM pt x WHERE x.path = ps.path ORDER BY session, turn LIMIT 5)) AS evidence
  FROM ps JOIN tl USING (path)
  WHERE interactions >= 3 AND read_count + edit_count > 0 AND (contains(path, '.') OR edit_count > 0 OR read_count >= 2) AND (n_tools >= 2 OR read_edit > 0 OR edit_validate > 0)
), rs AS (
  SELECT sequence, n, CASE WHEN n_seq = 2 THEN 'medium' ELSE 'low' END AS confidence, first, evidence FROM (
    SELECT sequence, count(*) AS n, any_value(n_seq) AS n_seq, min((session, turn)) AS first, string_agg(session || '#turn' || turn, ',' ORDER BY session, turn) FILTER (r <= 5) AS evidence
    FROM (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY session, turn) AS r FROM turns) GROUP BY 1) WHERE n >= 2 AND n_seq >= 2
), rc AS (
  SELECT command, n, 'medium' AS confidence, first, evidence FROM (SELECT command, count(*) AS n, min((session, turn)) AS first FROM calls WHERE command IS NOT NULL GROUP BY 1 HAVING count(*) >= 2)
  JOIN (SELECT command, string_agg(session || '#turn' || turn, ',' ORDER BY session, turn) AS evidence
        FROM (SELECT *, row_number() OVER (PARTITION BY command ORDER BY session, turn) AS r FROM (SELECT DISTINCT command, session, turn FROM calls WHERE command IS NOT NULL)) WHERE r <= 5 GROUP BY 1) USING (command)
), cand AS (
  SELECT 'hot_file_workflow' AS type, path AS name, interactions AS n, confidence, evidence, first, 0 AS tk FROM hot
  UNION ALL SELECT 'repeated_tool_sequence', sequence, n, confidence, evidence, first, 1 FROM rs
  UNION ALL SELECT 'repeated_command', command, n, confidence, evidence, first, 2 FROM rc
)"""
LOG = """lg AS (
  SELECT CAST(conv_id AS VARCHAR) AS session_file, turn, role, coalesce(text, '') AS text, CASE WHEN role = 'assistant' THEN least(3, length(coalesce(text, '')) % 4) ELSE 0 END AS n_calls,
         count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS asked
  FROM conversations
)"""
INDEX = f"""{M}, now AS (
  SELECT session_file, CAST(sum(length(text)) AS VARCHAR) || ':' || CAST(max(line_no) AS VARCHAR) AS fingerprint FROM m GROUP BY 1
), before AS (
  SELECT session_file, CASE WHEN CAST(session_file AS BIGINT) % 5 = 0 THEN 'was-' ELSE '' END || fingerprint AS fingerprint FROM now WHERE CAST(session_file AS BIGINT) % 7 <> 0
  UNION ALL SELECT 'old-' || session_file, fingerprint FROM now WHERE CAST(session_file AS BIGINT) % 11 = 0
), diff AS (
  SELECT coalesce(b.session_file, n.session_file) AS session_file,
         CASE WHEN b.session_file IS NULL THEN 'new' WHEN n.session_file IS NULL THEN 'deleted' WHEN b.fingerprint = n.fingerprint THEN 'unchanged' ELSE 'changed' END AS status
  FROM before b FULL JOIN now n ON b.session_file = n.session_file
)"""
TRACED = r"""l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(i)
), x AS (SELECT doc_id, i, regexp_extract(line, '^(The|Of|An|De) (\S+).*$', 1) AS k, regexp_extract(line, '^(The|Of|An|De) (\S+).*$', 2) AS v FROM l
), y AS (SELECT doc_id, CASE WHEN k IN ('The', 'Of') THEN 'r' WHEN k = 'An' THEN 'c' ELSE 'm' END AS g, v, min(i) AS i FROM x WHERE v <> '' AND NOT contains(v, '"') GROUP BY 1, 2, 3)"""
BLOCKS = r"""ln AS (
  SELECT doc_id, i, l[i] AS line, closed FROM (
    SELECT doc_id, CASE WHEN l[len(l)] = '' THEN l[1:len(l) - 1] ELSE l END AS l, closed FROM (
      SELECT doc_id, string_split_regex(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS l, ends_with(coalesce(text, ''), chr(10)) AS closed FROM documents)), unnest(range(1, len(l) + 1)) t(i)
), bl AS (
  SELECT doc_id, block, CAST(min(i) AS INTEGER) AS line_start, CAST(max(i) AS INTEGER) AS line_end,
         CAST(sum(length(line)) + count(*) - 1 + CASE WHEN any_value(closed) AND sum(length(line)) + count(*) - 1 > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_chars,
         string_agg(line, chr(10) ORDER BY i) || CASE WHEN any_value(closed) AND sum(length(line)) + count(*) - 1 > 0 THEN chr(10) ELSE '' END AS body
  FROM (SELECT *, CAST(sum(CASE WHEN i = 1 OR regexp_matches(line, '^(The|An|Of|De|Der) ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS block FROM ln) GROUP BY 1, 2
)"""
PACK = f"""WITH RECURSIVE {BLOCKS}, {TRACED}, wh AS (
  SELECT doc_id, source, coalesce(text, '') AS text, length(coalesce(text, '')) AS whole FROM documents
), bs AS (
  SELECT bl.*, row_number() OVER (PARTITION BY doc_id ORDER BY block) AS r FROM bl JOIN wh USING (doc_id) WHERE whole > 9000
), sg AS (
  SELECT doc_id, r, n_chars AS held, CAST(0 AS BIGINT) AS segment FROM bs WHERE r = 1
  UNION ALL
  SELECT b.doc_id, b.r, CASE WHEN s.held + b.n_chars > 9000 THEN b.n_chars ELSE s.held + b.n_chars END, CASE WHEN s.held + b.n_chars > 9000 THEN s.segment + 1 ELSE s.segment END
  FROM sg s JOIN bs b ON b.doc_id = s.doc_id AND b.r = s.r + 1
), se AS (
  SELECT doc_id, segment, CAST(sum(n_chars) AS BIGINT) AS n_chars, min(line_start) AS line_start, max(line_end) AS line_end, string_agg(body, '' ORDER BY r) AS text FROM bs JOIN sg USING (doc_id, r) GROUP BY 1, 2
  UNION ALL
  SELECT doc_id, 0, whole, 1, CASE WHEN text = '' THEN 0 ELSE whole - length(replace(text, chr(10), '')) + 1 END, text FROM wh WHERE doc_id NOT IN (SELECT doc_id FROM bs)
), so AS (SELECT w.source AS project, se.doc_id AS session, segment, se.n_chars, se.line_start, se.line_end, se.text, row_number() OVER (PARTITION BY w.source ORDER BY se.doc_id, segment) AS r FROM se JOIN wh w USING (doc_id)
), pk AS (
  SELECT project, session, segment, n_chars, line_start, line_end, r, n_chars AS held, CAST(0 AS BIGINT) AS chunk FROM so WHERE r = 1
  UNION ALL
  SELECT o.project, o.session, o.segment, o.n_chars, o.line_start, o.line_end, o.r,
         CASE WHEN (o.session <> p.session AND p.held >= 4000) OR p.held + o.n_chars > 8000 THEN o.n_chars ELSE p.held + o.n_chars END,
         CASE WHEN (o.session <> p.session AND p.held >= 4000) OR p.held + o.n_chars > 8000 THEN p.chunk + 1 ELSE p.chunk END
  FROM pk p JOIN so o ON o.project = p.project AND o.r = p.r + 1
), ct AS (
  SELECT p.project, p.chunk, count(*) AS n, '# chunk_' || lpad(CAST(p.chunk + 1 AS VARCHAR), CAST(greatest(3, length(CAST(p.chunk + 1 AS VARCHAR))) AS INTEGER), '0') || chr(10) || chr(10) || '## Sources' || chr(10) || chr(10)
         || string_agg('### Session ' || session || chr(10) || '- min: `' || session || '.min.txt`' || chr(10) || '- txt: `n/a`' || chr(10) || '- line_range: `' || p.line_start || '-' || p.line_end || '`' || chr(10) || chr(10)
                       || '```text' || chr(10) || rtrim(o.text, chr(10)) || chr(10) || '```' || chr(10), chr(10) ORDER BY r) AS content,
         string_agg(session || '-' || p.line_start || '-' || p.line_end, ',' ORDER BY r) AS source_ranges, CAST(arg_min(session, r) AS VARCHAR) AS start_time, CAST(arg_max(session, r) AS VARCHAR) AS end_time
  FROM pk p JOIN so o USING (project, session, segment, r) GROUP BY 1, 2
), ss AS (SELECT project, chunk, session, min(r) AS r FROM pk GROUP BY 1, 2, 3
), sn AS (SELECT project, chunk, string_agg(CAST(session AS VARCHAR), ',' ORDER BY r) AS source_sessions, string_agg(session || '.min.txt', ',' ORDER BY r) AS source_files FROM ss GROUP BY 1, 2
), tv AS (SELECT project, chunk, g, v, min((r, i)) AS o FROM ss JOIN y ON y.doc_id = ss.session GROUP BY 1, 2, 3, 4
), ta AS (SELECT project, chunk, coalesce(string_agg(v, ',' ORDER BY o) FILTER (g = 'r'), '') AS referenced, coalesce(string_agg(v, ',' ORDER BY o) FILTER (g = 'c'), '') AS changed, coalesce(string_agg(v, ',' ORDER BY o) FILTER (g = 'm'), '') AS commands FROM tv GROUP BY 1, 2
), cr AS (
  SELECT project, chunk, 'chunk_' || lpad(CAST(chunk + 1 AS VARCHAR), CAST(greatest(3, length(CAST(chunk + 1 AS VARCHAR))) AS INTEGER), '0') AS chunk_id, source_sessions, source_files, start_time, end_time, source_ranges,
         coalesce(referenced, '') AS referenced, coalesce(changed, '') AS changed, coalesce(commands, '') AS commands, CAST(length(content) - length(replace(content, chr(10), '')) + 1 AS INTEGER) AS line_count,
         CAST(length(content) AS BIGINT) AS n_chars, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens, sha256(content) AS content_hash,
         CASE WHEN changed <> '' THEN 'high' WHEN referenced <> '' OR commands <> '' THEN 'medium' WHEN length(content) < 2000 THEN 'low' ELSE 'unknown' END AS relevance,
         CASE WHEN chunk % 4 = 0 THEN 'cached' WHEN chunk % 4 = 3 THEN 'failed' ELSE 'completed' END AS status
  FROM ct JOIN sn USING (project, chunk) LEFT JOIN ta USING (project, chunk)
), dn AS (
  SELECT *, 'reports/' || project || '/' || chunk_id || '.md' AS report_path, NOT bool_or(relevance <> 'low') OVER (PARTITION BY project) OR relevance <> 'low' AS used FROM cr WHERE status IN ('completed', 'cached')
)"""


#: Fixed values, written out apart from the operators': id, mode, cooldown, weight (confirm 10; high 3, medium 2, low 1), any-terms, groups, anti-patterns.
RULES = [
    ("scope", "notify", "session_once", 3, [], [["tion", "ment"], ["that", "que"]], ["blees"]),
    ("release", "confirm", "turn_once", 13, ["orth", "sting"], [], ["eron"]),
    ("preview", "notify", "turn_once", 2, ["this", "from"], [["in"]], []),
    ("length", "notify", "session_once", 1, ["with", "nicht"], [], []),
]


def _rule_sql(i: int) -> str:
    name, mode, cooldown, weight, some, groups, anti = RULES[i]
    has = lambda t: f"CASE WHEN contains(lower(text), '{t}') THEN 1 ELSE 0 END"
    total = lambda ts: "(" + (" + ".join(map(has, ts)) or "0") + ")"
    ok = [f"{total(anti)} = 0"] + ([f"{total(some)} > 0"] if some else []) + [f"{total(g)} > 0" for g in groups]
    return f"SELECT session_file, turn_index, {i} AS rule_ord, '{name}' AS rule_id, '{mode}' AS mode, '{cooldown}' AS cooldown, CAST({total(some)} + {len(groups)} AS INTEGER) AS score, CAST({weight} + {total(some)} + {len(groups)} AS INTEGER) AS rank FROM ut WHERE {' AND '.join(ok)}"


MATCH = f"{UT}, mt AS ({' UNION ALL '.join(_rule_sql(i) for i in range(len(RULES)))})"
_NORMAL = r"trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '/home/\w+(?:/[\w.@-]+)+', ' <PATH> ', 'g'), '`[^`]+`', ' <CODE> ', 'g'), 'https?://\S+', ' <URL> ', 'g'), '\d+', ' <NUM> ', 'g')), '\s+', ' ', 'g'))"
GRAMS = f"""{UT}, nt AS (SELECT session_file || '#' || turn_index AS turn, {_NORMAL.format(c=_clean('text'))} AS t FROM ut)"""
TFIDF = f"""{GRAMS}, gr AS (
  SELECT turn, substr(t, i, n) AS gram FROM nt, unnest([2, 3, 4, 5]) a(n), unnest(range(1, length(t) - n + 2)) b(i)
), tf AS (SELECT turn, gram, count(*) AS tf FROM gr GROUP BY 1, 2
), df AS (SELECT gram, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2
), rw AS (SELECT turn, gram, tf * (ln((1.0 + (SELECT count(*) FROM nt)) / (1.0 + df)) + 1) AS w FROM tf JOIN df USING (gram)
), wt AS (SELECT turn, gram, w / sqrt(sum(w * w) OVER (PARTITION BY turn)) AS w FROM rw)"""
PAIRS = f"""{TFIDF}, sp AS (
  SELECT a, b, similarity FROM (SELECT x.turn AS a, y.turn AS b, round(sum(x.w * y.w), 6) AS similarity FROM wt x JOIN wt y ON x.gram = y.gram AND x.turn < y.turn GROUP BY 1, 2) WHERE similarity >= 0.38
)"""
_BANNED = " AND ".join(f"NOT contains(p, '{x}')" for x in ("ctrl", "resume", "session", "current folder", "num"))
_CHAIN = "len(list_intersect(labels, ['scope_clarification', 'token_budget_control', 'late_constraint'])) > 0"


def _count_of(key: str) -> str:
    return f"WITH {CALLS} SELECT {key}, count(*) AS n FROM calls WHERE {key} IS NOT NULL GROUP BY 1"


def _event_count(key: str) -> str:
    return f"WITH {EV} SELECT {key}, count(*) AS n FROM ev GROUP BY 1"


ORACLE_SQL: dict[str, str] = {
    "session_meta": f"WITH {M} SELECT session_file, count(*) AS message_count, count(*) FILTER (role = 'user') AS user_turn_count, CAST(sum(tool_calls) AS BIGINT) AS tool_call_count, max(line_no) AS last_line FROM m GROUP BY 1",
    "message_ordinals": f"WITH {M} SELECT session_file, line_no, role, CAST(row_number() OVER (PARTITION BY session_file, role ORDER BY line_no) AS INTEGER) AS role_turn, tool_calls FROM m WHERE role IN ('user', 'assistant')",
    "user_turns": f"WITH {UT} SELECT session_file, turn_index, preview, CAST(length({_clean('text')}) AS INTEGER) AS n_chars FROM ut",
    "one_line_preview": f"SELECT doc_id, {_line('text', 180)} AS preview, {_line('text', 160)} AS short FROM documents",
    "normalize_text": f"SELECT doc_id, sha256(t) AS normalized_sha256, CAST(length(t) AS INTEGER) AS n_chars FROM (SELECT doc_id, {_NORMAL.format(c=_clean('text'))} AS t FROM documents)",
    "category_match": f"WITH {M} SELECT session_file, line_no, array_to_string({_CATS}, ',') AS categories FROM m WHERE len({_CATS}) > 0",
    "correction_events": f"WITH {EV} SELECT * FROM ev",
    "event_type_counts": _event_count("event_type"),
    "event_type_order": f"WITH {EV} SELECT event_type, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) AS INTEGER) AS place FROM ev GROUP BY 1",
    "impact_counts": _event_count("impact"),
    "missing_constraint_counts": _event_count("missing_constraint"),
    "event_profile": f"WITH {EV}, {PROFILE} SELECT event_type, n_events, n_sessions, CASE WHEN hundredths / n_events >= 86 THEN 'high' WHEN hundredths / n_events >= 76 THEN 'medium' ELSE 'low' END AS confidence, refs, {_case('event_type', SUGGESTIONS)} AS suggestion FROM pr JOIN rf USING (event_type)",
    "user_profiles": f"WITH {EV}, {PROFILE} SELECT {_case('event_type', {'late_constraint': 'constraints_arrive_late', 'direction_mismatch': 'semantic_alignment_needs_repair', 'verbosity_mismatch': 'prefers_dense_brief_answers'})} AS name, CASE WHEN n_events >= 4 THEN 'high' ELSE 'medium' END AS confidence, refs AS support, {_case('event_type', SUGGESTIONS)} AS user_suggestion FROM pr JOIN rf USING (event_type) WHERE n_events >= 2 AND event_type IN ('late_constraint', 'direction_mismatch', 'verbosity_mismatch')",
    "representative_events": f"WITH {EV} SELECT session_file, trigger_turn, event_type, confidence, assistant_tool_calls FROM ev ORDER BY confidence DESC, assistant_tool_calls DESC, session_file, trigger_turn LIMIT 12",
    "rule_hits": f"WITH {UT} SELECT session_file, turn_index, preview, unnest(labels) AS label FROM ut",
    "rule_summary": f"WITH {UT}, h AS (SELECT session_file, turn_index, unnest(labels) AS label FROM ut) SELECT label, count(*) AS n, string_agg(session_file || '#' || turn_index, ',' ORDER BY session_file, turn_index) FILTER (r <= 6) AS examples, {_case('label', DESCRIPTIONS)} AS description FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY session_file, turn_index) AS r FROM h) GROUP BY label",
    "correction_chains": f"WITH {UT}, x AS (SELECT *, {_CHAIN} AS hit, row_number() OVER (PARTITION BY session_file ORDER BY turn_index) AS place FROM ut), y AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY session_file ORDER BY turn_index) AS nh, sum(CASE WHEN hit AND place > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY session_file ORDER BY turn_index) AS nl FROM x) SELECT session_file, max(preview) FILTER (place = 1) AS first_prompt, string_agg('turn' || turn_index || ': ' || preview, '|' ORDER BY turn_index) FILTER (hit AND place > 1 AND nl <= 6) AS later_constraints, string_agg(CAST(turn_index AS VARCHAR), ',' ORDER BY turn_index) FILTER (hit AND nh <= 12) AS correction_turns FROM y GROUP BY 1 HAVING count(*) FILTER (hit AND place > 1) > 0",
    "blindspot_profile": f"WITH {UT}, p AS (SELECT 'token_sensitive' AS trait, count(*) FILTER (list_contains(labels, 'token_budget_control')) AS evidence_count, 3 AS least FROM ut UNION ALL SELECT 'scope_often_clarified_late', count(*) FILTER (list_contains(labels, 'scope_clarification')) + count(*) FILTER (list_contains(labels, 'late_constraint')), 5 FROM ut UNION ALL SELECT 'exploratory_tester', count(*) FILTER (list_contains(labels, 'exploratory_request')), 8 FROM ut UNION ALL SELECT 'prefers_dense_brief_answers', count(*) FILTER (contains(text, 'tion')), 3 FROM ut) SELECT trait, evidence_count FROM p WHERE evidence_count >= least",
    "tool_turns": f"WITH {CALLS} SELECT session, turn, sequence, coalesce(array_to_string(read_paths, ','), '') AS read_paths, coalesce(array_to_string(edit_paths, ','), '') AS edit_paths, coalesce(array_to_string(write_paths, ','), '') AS write_paths, coalesce(array_to_string(commands, ','), '') AS commands FROM turns",
    "tool_counts": _count_of("tool"),
    "path_counts": _count_of("path"),
    "command_counts": _count_of("command"),
    "tool_path_counts": f"WITH {CALLS} SELECT tool, path, count(*) AS n FROM calls WHERE path IS NOT NULL GROUP BY 1, 2",
    "top_sequences": f"WITH {CALLS} SELECT sequence, count(*) AS n FROM turns GROUP BY 1 ORDER BY n DESC, min((session, turn)) LIMIT 20",
    "read_edit_turns": f"WITH {PATHS} SELECT path, read_edit FROM ps WHERE read_edit > 0",
    "edit_validate_turns": f"WITH {PATHS} SELECT path, edit_validate FROM ps WHERE edit_validate > 0",
    "hot_files": f"WITH {PATHS} SELECT path, interactions, read_count, edit_count, read_edit, edit_validate, tools, confidence, evidence FROM hot",
    "repeated_sequences": f"WITH {PATHS} SELECT sequence, n, confidence, evidence FROM rs",
    "repeated_commands": f"WITH {PATHS} SELECT command, n, confidence, evidence FROM rc",
    "candidate_patterns": f"WITH {PATHS} SELECT type, name, n, confidence, evidence FROM cand",
    "representative_turns": f"""WITH {PATHS}, ce AS (
  SELECT string_split(evidence, ',')[1:4] AS ev, row_number() OVER (ORDER BY CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, n DESC, tk, first, name) AS pr FROM cand
), er AS (SELECT ev[i] AS ref, min((pr, i)) AS o FROM ce, unnest(range(1, len(ev) + 1)) t(i) GROUP BY 1 ORDER BY o LIMIT 8
), sc AS (SELECT session || '#turn' || turn AS ref, session, turn, CAST(3 * coalesce(len(commands), 0) + 3 * coalesce(len(edit_paths), 0) + 2 * coalesce(len(write_paths), 0) + n_seq AS BIGINT) AS score FROM turns
), u AS (SELECT 0 AS source, o, session, turn, score FROM er JOIN sc USING (ref) UNION ALL SELECT 1, NULL, session, turn, score FROM sc WHERE ref NOT IN (SELECT ref FROM er))
SELECT source, session, turn, score FROM u ORDER BY source, o, score DESC, session, turn LIMIT 8""",
    "compact_counters": f"WITH {CALLS} SELECT command, count(*) AS n FROM calls WHERE command IS NOT NULL GROUP BY 1 ORDER BY n DESC, command LIMIT 8",
    "asset_suggestions": f"""WITH {EV}, {PATHS}, et AS (SELECT event_type, count(*) AS n FROM ev GROUP BY 1)
SELECT CASE event_type WHEN 'late_constraint' THEN 'pre_execution_constraint_checklist' WHEN 'verbosity_mismatch' THEN 'response_style_preamble' ELSE 'scope_alignment_template' END AS candidate,
       CASE event_type WHEN 'late_constraint' THEN 'checklist or prompt preamble' WHEN 'verbosity_mismatch' THEN 'prompt snippet' ELSE 'request template or checklist' END AS possible_asset,
       CASE event_type WHEN 'late_constraint' THEN 'late_constraint events repeat, suggesting important constraints often arrive after execution starts.'
            WHEN 'verbosity_mismatch' THEN 'verbosity mismatch repeats often enough to justify a reusable answer-style template.'
            ELSE 'direction mismatch recurs, indicating the need for an explicit object/scope/goal alignment step.' END AS why,
       event_type || ' x' || n || CASE event_type WHEN 'late_constraint' THEN '; blindspot-v2 profiles suggest asking about execution order, search budget, and boundaries earlier.' ELSE '' END AS evidence
FROM et WHERE n >= 2 AND event_type IN ('late_constraint', 'verbosity_mismatch', 'direction_mismatch')
UNION ALL SELECT 'command_loop_sop', 'SOP or skill', 'workflow already shows repeated command loops that may be worth standardizing.', string_agg(command, '; ' ORDER BY n DESC, first, command) FROM (SELECT * FROM rc ORDER BY n DESC, first, command LIMIT 3) HAVING count(*) > 0
UNION ALL SELECT 'read_then_edit_micro_workflow', 'micro-SOP', 'the route sees a repeated read->edit micro pattern that may be reusable as a code-editing habit.', 'read->edit x' || n FROM rs WHERE sequence = 'read>edit'""",
    "compact_turns": f"WITH {CALLS}, s AS (SELECT session, turn, sequence, {', '.join(f'coalesce(array_to_string({c}[1:{k}], chr(44)), chr(32)[1:0]) AS {c}' for c, k in (('read_paths', 3), ('edit_paths', 3), ('write_paths', 3), ('commands', 2)))} FROM turns) SELECT session, turn, array_to_string(string_split(sequence, '>')[1:8], '>') AS sequence, read_paths, edit_paths, write_paths, commands FROM s",
    "pattern_summaries": f"WITH {PATHS} SELECT type, confidence, name, n, array_to_string(string_split(evidence, ',')[1:4], ',') AS evidence FROM cand",
    "event_summaries": f"WITH {EV} SELECT session_file, trigger_turn, event_type, secondary_types, original_user_preview, assistant_preview, evidence, missing_constraint, impact, avoidable, confidence, suggestion FROM ev",
    "validation_commands": f"WITH {CALLS} SELECT command, count(*) AS n, contains(command, ' test') AS validates FROM calls WHERE command IS NOT NULL GROUP BY 1",
    "index_diff": f"WITH {INDEX} SELECT session_file, status FROM diff",
    "worklist": f"WITH {INDEX}, r AS (SELECT session_file, status AS reason FROM diff WHERE status IN ('new', 'changed') UNION ALL SELECT session_file, 'cache' FROM now WHERE CAST(session_file AS BIGINT) % 3 = 0) SELECT session_file, max(reason) AS reason FROM r GROUP BY 1",
    "partial_final_counters": f"WITH {CALLS}, i AS (SELECT session, 'tool' AS kind, tool AS name FROM calls UNION ALL SELECT session, 'path', path FROM calls WHERE path IS NOT NULL UNION ALL SELECT session, 'command', command FROM calls WHERE command IS NOT NULL) SELECT kind, name, count(*) AS n, count(DISTINCT session) AS n_sessions FROM i GROUP BY 1, 2",
    "stored_top_counters": f"""WITH {PATHS}, i AS (
  SELECT 'tool' AS kind, tool AS name, count(*) AS n, min((session, turn, ts, event_id)) AS first FROM calls GROUP BY 2
  UNION ALL SELECT 'path', path, count(*), min((session, turn, ts, event_id)) FROM calls WHERE path IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'command', command, count(*), min((session, turn, ts, event_id)) FROM calls WHERE command IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'sequence', sequence, count(*), min((session, turn, NULL::TIMESTAMP, NULL::BIGINT)) FROM turns GROUP BY 2
  UNION ALL SELECT 'read_edit', path, count(*), min((session, turn, ts, event_id)) FROM (SELECT session, turn, path, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM calls WHERE path IS NOT NULL GROUP BY 1, 2, 3) JOIN pt USING (session, turn, path) WHERE reads > 0 AND edits > 0 GROUP BY 2
  UNION ALL SELECT 'edit_validate', path, count(*), min((session, turn, ts, event_id)) FROM (SELECT session, turn, path, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM calls WHERE path IS NOT NULL GROUP BY 1, 2, 3) JOIN pt USING (session, turn, path) JOIN flags USING (session, turn) WHERE validated AND edited AND edits + writes > 0 GROUP BY 2
) SELECT kind, CAST(place AS INTEGER) AS place, name, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, first) AS place FROM i) WHERE place <= 20""",
    "stored_candidates": f"WITH {PATHS} SELECT CAST(row_number() OVER (ORDER BY CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, n DESC, tk, first, name) AS INTEGER) AS place, type, name, n, confidence, evidence FROM cand",
    "session_summaries": f"""WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS file, turn, role, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM conversations
), c AS (
  SELECT file, turn, k, ['read', 'edit', 'bash'][CAST((n + k) % 3 + 1 AS INTEGER)] AS tool
  FROM (SELECT *, min(turn) FILTER (role = 'user') OVER (PARTITION BY file) AS asked FROM t), unnest([0, 1, 2]) x(k) WHERE role = 'assistant' AND k < n % 4 AND turn > asked
), u AS (SELECT file, string_agg(tool || ':' || n, ',' ORDER BY first) AS tools, CAST(sum(n) AS BIGINT) AS tool_calls FROM (SELECT file, tool, count(*) AS n, min((turn, k)) AS first FROM c GROUP BY 1, 2) GROUP BY 1
), b AS (
  SELECT file, CASE WHEN bool_or(turn = 1) THEN 's' || file ELSE '' END AS session_id, CASE WHEN bool_or(turn = 1) THEN 't' || file ELSE '' END AS started_at,
         count(*) FILTER (role = 'user') AS user_turns, count(*) AS message_count, coalesce(string_agg(role || '/m' || n % 5, ',' ORDER BY turn) FILTER (turn % 4 = 1), '') AS models,
         coalesce(arg_min({_line('text', 180)}, turn) FILTER (role = 'user' AND {_flat('text')} <> ''), '') AS first_user_preview
  FROM t GROUP BY 1
) SELECT file, session_id, started_at, user_turns, message_count, coalesce(tool_calls, 0) AS tool_calls, coalesce(tools, '') AS tools, models, first_user_preview FROM b LEFT JOIN u USING (file)""",
    "trace_metadata": f"""WITH {TRACED} SELECT d.doc_id, coalesce(string_agg(v, ',' ORDER BY i) FILTER (g = 'r'), '') AS referenced, coalesce(string_agg(v, ',' ORDER BY i) FILTER (g = 'c'), '') AS changed, coalesce(string_agg(v, ',' ORDER BY i) FILTER (g = 'm'), '') AS commands
FROM documents d LEFT JOIN y USING (doc_id) GROUP BY 1""",
    "blocks": f"WITH {BLOCKS} SELECT doc_id, block, line_start, line_end, n_chars FROM bl",
    "chunk_pack": f"{PACK} SELECT project, session, segment, n_chars, line_start, line_end, chunk FROM pk",
    "chunk_records": f"{PACK} SELECT project, chunk, chunk_id, source_sessions, source_files, start_time, end_time, source_ranges, referenced, changed, commands, line_count, n_chars, tokens, content_hash, relevance FROM cr",
    "chunk_reports": f"""{PACK}, t6 AS (
  SELECT project, chunk, string_agg(v, ', ' ORDER BY o) FILTER (g = 'r') AS r, count(*) FILTER (g = 'r') AS nr, string_agg(v, ', ' ORDER BY o) FILTER (g = 'c') AS c, count(*) FILTER (g = 'c') AS nc, string_agg(v, ', ' ORDER BY o) FILTER (g = 'm') AS m, count(*) FILTER (g = 'm') AS nm,
         string_agg(v, ', ' ORDER BY o) FILTER (g = 'r' AND p <= 3) AS r3, string_agg(v, ', ' ORDER BY o) FILTER (g = 'c' AND p <= 3) AS c3
  FROM (SELECT *, row_number() OVER (PARTITION BY project, chunk, g ORDER BY o) AS p FROM tv) WHERE p <= 6 GROUP BY 1, 2
), rp AS (
  SELECT project, chunk_id, array_to_string(['# Chunk report: ' || chunk_id, '', '## Story', '- covers: ' || start_time || ' to ' || end_time || '; sessions: ' || replace(source_sessions, ',', ', '), '- relevance: ' || relevance,
    '- changed paths: ' || coalesce(nc, 0) || '; referenced paths: ' || coalesce(nr, 0) || '; commands: ' || coalesce(nm, 0), '', '## Signals', '### 1. Paths and commands of the project',
    '- evidence: changed=' || coalesce(c, 'none') || '; referenced=' || coalesce(r, 'none') || '; commands=' || coalesce(m, 'none'), '- belongs to: project_context', '- scope: likely project level; other chunks must confirm it', '- priority: high',
    '- work goes on at: ' || coalesce(c3, r3, 'the paths above'), '', '### 2. The limits of one chunk', '- evidence: sessions=' || replace(source_sessions, ',', ', ') || '; relevance=' || relevance, '- belongs to: discard', '- scope: this chunk', '- priority: low', '',
    '## Not supported', '- lasting preferences, or patterns across projects', ''], chr(10)) AS report
  FROM cr LEFT JOIN t6 USING (project, chunk)
) SELECT project, chunk_id, CAST(length(report) AS BIGINT) AS n_chars, sha256(report) AS report_sha256 FROM rp""",
    "synthesis_selection": f"{PACK} SELECT project, chunk, status, relevance FROM dn WHERE used",
    "synthesis_rollup": f"{PACK} SELECT project, coalesce(string_agg(chunk_id, ',' ORDER BY chunk) FILTER (used), '') AS used_chunk_ids, coalesce(string_agg(report_path, ',' ORDER BY chunk) FILTER (used), '') AS used_report_paths, coalesce(string_agg(chunk_id, ',' ORDER BY chunk) FILTER (NOT used), '') AS ignored_chunk_ids, coalesce(string_agg(report_path, ',' ORDER BY chunk) FILTER (NOT used), '') AS ignored_report_paths FROM dn GROUP BY 1",
    "synthesis_heads": f"""{PACK}, pl AS (
  SELECT project, chunk, 'sessions' AS kind, CAST(session AS VARCHAR) AS value, row_number() OVER (PARTITION BY project, chunk ORDER BY r) AS place FROM ss
  UNION ALL SELECT project, chunk, CASE g WHEN 'r' THEN 'referenced' WHEN 'c' THEN 'changed' ELSE 'commands' END, v, row_number() OVER (PARTITION BY project, chunk, g ORDER BY o) FROM tv
), fu AS (SELECT project, kind, value, min((chunk, place)) AS first FROM pl JOIN (SELECT project, chunk FROM dn WHERE used) USING (project, chunk) GROUP BY 1, 2, 3
), ra AS (SELECT *, row_number() OVER (PARTITION BY project, kind ORDER BY first) AS r FROM fu)
SELECT project, kind, value, first[1] AS chunk, CAST(first[2] AS INTEGER) AS place, CASE WHEN kind <> 'sessions' THEN CAST(r AS INTEGER) END AS rank FROM ra WHERE kind = 'sessions' OR r <= CASE kind WHEN 'commands' THEN 8 ELSE 10 END""",
    "synthesis_input": f"""{PACK}, p AS (SELECT project, '# Synthesis packet' || chr(10) || chr(10) || '## Used chunk reports' || chr(10) || chr(10)
  || coalesce(string_agg('### ' || chunk_id || chr(10) || '- relevance: ' || relevance || chr(10) || '- source_sessions: ' || replace(source_sessions, ',', ', ') || chr(10) || '- report_path: ' || report_path || chr(10) || chr(10) || '# report of ' || content_hash || chr(10) || chr(10), '' ORDER BY chunk) FILTER (used), '')
  || '## Ignored or lower-weight chunks' || chr(10) || chr(10) || coalesce(string_agg('- ' || chunk_id || ': relevance=' || relevance || ' report=' || report_path || chr(10), '' ORDER BY chunk) FILTER (NOT used), '- none' || chr(10)) AS packet FROM dn GROUP BY 1)
SELECT project, CAST(length(packet) AS BIGINT) AS n_chars, sha256(packet) AS packet_sha256 FROM p""",
    "run_stats": f"{PACK} SELECT project, count(*) AS selected, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'cached') AS cached, count(*) FILTER (status = 'failed') AS failed, CAST(0 AS BIGINT) AS skipped FROM cr GROUP BY 1",
    "run_stats_of_one": f"{PACK} SELECT project, count(*) FILTER (chunk = 1) AS selected, count(*) FILTER (chunk = 1) AS completed, CAST(0 AS BIGINT) AS cached, CAST(0 AS BIGINT) AS failed, count(*) FILTER (chunk <> 1) AS skipped FROM cr GROUP BY 1",
    "cache_hits": f"{PACK} SELECT project || '/' || chunk AS chunk_id, chunk % 4 <> 3 AND chunk % 5 <> 0 AND chunk % 7 <> 1 AND chunk % 6 <> 2 AND chunk % 9 <> 4 AND chunk % 8 <> 6 AND chunk % 10 <> 9 AS hit FROM cr",
    "reminder_matches": f"WITH {MATCH} SELECT session_file, turn_index, rule_id, score, rank FROM mt",
    "reminder_visible": f"WITH {MATCH}, v AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_file, turn_index, mode ORDER BY rank DESC, rule_ord) AS INTEGER) AS place, bool_or(mode = 'confirm') OVER (PARTITION BY session_file, turn_index) AS asks FROM mt) SELECT session_file, turn_index, rule_id, place FROM v WHERE CASE WHEN asks THEN mode = 'confirm' AND place = 1 ELSE place <= 2 END",
    "reminder_cooldown": f"WITH {MATCH}, v AS (SELECT *, min(turn_index) OVER (PARTITION BY session_file, rule_id) AS first FROM mt WHERE rule_id <> 'length') SELECT session_file, turn_index, rule_id FROM v WHERE cooldown <> 'session_once' OR turn_index = first",
    "char_ngrams": f"""WITH {GRAMS}, g AS (SELECT turn, substr(t, i, n) AS gram FROM nt, unnest([3, 4, 5, 6, 7, 8]) a(n), unnest(range(1, length(t) - n + 2)) b(i)),
k AS (SELECT gram, count(*) AS n, trim(gram) AS p FROM g GROUP BY 1 HAVING count(DISTINCT turn) >= 2)
SELECT gram, n, n * length(gram) AS weight FROM k WHERE length(p) BETWEEN 3 AND 18 AND NOT regexp_matches(p, '[<>]') AND p NOT IN ('ctrl', 'resume', 'session', 'current', 'folder', 'num') AND {_BANNED} AND regexp_matches(p, '[a-z]') AND NOT regexp_full_match(p, '[a-z]{{1,3}}')""",
    "tfidf_weights": f"WITH {TFIDF} SELECT turn, count(*) AS n_grams, round(max(w), 6) AS largest, round(sum(w), 6) AS total FROM wt GROUP BY 1",
    "similar_pairs": f"WITH {PAIRS}, rp AS (SELECT min(turn) AS turn FROM nt GROUP BY t) SELECT a, b, round(similarity, 4) AS similarity FROM sp WHERE a IN (SELECT turn FROM rp) AND b IN (SELECT turn FROM rp)",
    "similar_members": f"WITH {GRAMS} SELECT turn, min(turn) OVER (PARTITION BY t) AS representative, count(*) OVER (PARTITION BY t) AS copies FROM nt",
    "frequent_phrases": f"""WITH {GRAMS}, g AS (SELECT turn, substr(t, i, n) AS gram FROM nt, unnest([3, 4, 5, 6, 7, 8]) a(n), unnest(range(1, length(t) - n + 2)) b(i)),
k AS (SELECT gram, count(*) AS n, trim(gram) AS p FROM g GROUP BY 1 HAVING count(DISTINCT turn) >= 2),
c AS (SELECT gram, n, p, row_number() OVER (ORDER BY n * length(gram) DESC, n DESC, length(gram) DESC, gram) AS o FROM k
  WHERE length(p) BETWEEN 3 AND 18 AND NOT regexp_matches(p, '[<>]') AND p NOT IN ('ctrl', 'resume', 'session', 'current', 'folder', 'num') AND {_BANNED} AND regexp_matches(p, '[a-z]') AND NOT regexp_full_match(p, '[a-z]{{1,3}}')),
q AS (SELECT DISTINCT o, n, substr(p, i, m) AS part FROM c, unnest(range(3, length(p) + 1)) a(m), unnest(range(1, length(p) - m + 2)) b(i)),
f AS (SELECT DISTINCT c.o FROM c JOIN q ON q.part = c.p AND q.o < c.o AND c.n <= q.n)
SELECT CAST(row_number() OVER (ORDER BY o) AS INTEGER) AS place, p AS phrase, n, n * length(p) AS score FROM c WHERE o NOT IN (SELECT o FROM f) ORDER BY o LIMIT 80""",
    "dbscan_clusters": f"""WITH RECURSIVE {PAIRS}, e AS MATERIALIZED (SELECT a, b FROM sp UNION ALL SELECT b, a FROM sp), r(turn, c) AS (SELECT turn, turn FROM nt UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.turn WHERE r.c < e.b),
cl AS (SELECT turn, min(c) AS c FROM r GROUP BY 1) SELECT turn, CASE WHEN count(*) OVER (PARTITION BY c) > 1 THEN c END AS cluster, count(*) OVER (PARTITION BY c) AS size FROM cl""",
    "validation_parse": """WITH x AS (SELECT conv_id, turn, text, conv_id * 7 + turn AS n FROM conversations), s AS (SELECT *, CAST(CASE n % 3 WHEN 0 THEN n % 51 WHEN 1 THEN 5 * (n % 11) ELSE 0 END AS DOUBLE) AS score FROM x),
m AS (SELECT *, CASE WHEN n % 3 = 0 AND text <> '' THEN text WHEN score >= 35 THEN '通过' ELSE '未通过' END AS summary FROM s)
SELECT conv_id, turn, score, score >= 35 AS passed, summary, sha256('# Self-validation critique (score ' || printf('%.1f', score) || '/50)' || chr(10) || chr(10) || '- summary: ' || summary || chr(10)
|| CASE n % 3 WHEN 0 THEN array_to_string(['- dimension_scores:', '  - Signal: ' || printf('%.1f', CAST(n % 9 AS DOUBLE)), '  - Routing: 2.34', '- failed_dimensions:', '  - Coverage', '- must_fix:', '  - cite', '  - cut', '- which_chunk_underrepresented:', '  - chunk_001', '- rewrite_direction:', '  - patterns.md:', '    - shorter', ''], chr(10))
   WHEN 1 THEN array_to_string(['- which_chunk_overweighted:', '  - chunk_002', '  - chunk_003', ''], chr(10)) ELSE '' END
|| '- threshold: 35.0' || chr(10) || '- passed: ' || CASE WHEN score >= 35 THEN 'True' ELSE 'False' END || chr(10)) AS critique_sha256 FROM m""",
    "bundle_round_trip": r"""WITH t AS (SELECT conv_id, regexp_replace(coalesce(max(text) FILTER (turn = 1), ''), '^\s+|\s+$', '', 'g') AS a, regexp_replace(coalesce(max(text) FILTER (turn = 2), ''), '^\s+|\s+$', '', 'g') AS b, regexp_replace(coalesce(max(text) FILTER (turn = 3), ''), '^\s+|\s+$', '', 'g') AS c FROM conversations GROUP BY 1),
u AS (SELECT *, a <> '' AND b <> '' AND c <> '' AS ok FROM t)
SELECT conv_id, CASE WHEN ok THEN sha256('=== project_context.md ===' || chr(10) || a || chr(10) || chr(10) || '=== collaboration_guide.md ===' || chr(10) || b || chr(10) || chr(10) || '=== patterns.md ===' || chr(10) || c || chr(10)) END AS bundle_sha256,
CASE WHEN ok THEN sha256(a) END AS part_1, CASE WHEN ok THEN sha256(b) END AS part_2, CASE WHEN ok THEN sha256(c) END AS part_3 FROM u""",
    "project_totals": f"WITH {CALLS} SELECT count(DISTINCT session) AS n_sessions, count(DISTINCT (session, turn)) AS n_turns, count(*) AS n_calls, count(DISTINCT tool) AS n_tools, count(DISTINCT path) AS n_paths, count(DISTINCT command) AS n_commands FROM calls",
    "frequent_commands": f"WITH {CALLS} SELECT command, n FROM (SELECT command, count(*) AS n, min((session, turn, ts, event_id)) AS first FROM calls WHERE command IS NOT NULL GROUP BY 1 ORDER BY n DESC, first LIMIT 20) WHERE n >= 2",
    "dbscan_report": f"""WITH RECURSIVE {PAIRS}, e AS MATERIALIZED (SELECT a, b FROM sp UNION ALL SELECT b, a FROM sp), r(turn, c) AS (SELECT turn, turn FROM nt UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.turn WHERE r.c < e.b),
c0 AS (SELECT turn, min(c) AS cluster FROM r GROUP BY 1), sz AS (SELECT cluster, count(*) AS size FROM c0 GROUP BY 1 HAVING count(*) > 1),
ce AS (SELECT cluster, gram, sum(w) / any_value(size) AS c FROM wt JOIN c0 USING (turn) JOIN sz USING (cluster) GROUP BY 1, 2),
tt AS (SELECT cluster, string_agg(gram, '|' ORDER BY p) AS top_terms FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(c, 9) DESC, gram DESC) AS p FROM ce) WHERE p <= 6 GROUP BY 1),
nm AS (SELECT cluster, sqrt(sum(c * c)) AS norm FROM ce GROUP BY 1), dt AS (SELECT cluster, turn, sum(w * c) AS dot FROM wt JOIN c0 USING (turn) JOIN ce USING (cluster, gram) GROUP BY 1, 2),
ex AS (SELECT cluster, string_agg(turn, ',' ORDER BY p) AS examples FROM (SELECT cluster, turn, row_number() OVER (PARTITION BY cluster ORDER BY round(coalesce(dot / norm, 0), 6) DESC, turn) AS p FROM c0 JOIN sz USING (cluster) JOIN nm USING (cluster) LEFT JOIN dt USING (cluster, turn)) WHERE p <= 4 GROUP BY 1)
SELECT cluster, size, top_terms, examples FROM sz LEFT JOIN tt USING (cluster) JOIN ex USING (cluster)""",
    "runner_event_fold": """WITH x AS (SELECT * FROM conversations WHERE turn % 3 <> 2), y AS (SELECT conv_id AS run_id, coalesce(string_agg(role, '' ORDER BY turn) FILTER (role <> 'assistant'), '') AS streamed,
arg_max(text, turn) FILTER (role = 'assistant') AS final_text, arg_max('m' || turn, turn) FILTER (role = 'assistant') AS model FROM x GROUP BY 1)
SELECT run_id, streamed, final_text, CASE WHEN coalesce(final_text, '') = '' THEN streamed ELSE final_text END AS text, model, CAST(NULL AS VARCHAR) AS error FROM y""",
    "chunk_model_reports": f"""SELECT CAST(doc_id AS VARCHAR) AS chunk_id, 'completed' AS status, '# chunk' || chr(10) || '- characters: ' || length(t) || chr(10) || '- begins: ' || h[1:60] || chr(10) AS report
FROM (SELECT doc_id, coalesce(text, '') AS t, trim(regexp_replace(coalesce(text, ''), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')) AS h FROM documents)""",
    "report_patterns": f"""WITH {PATHS}, tp AS (SELECT row_number() OVER (ORDER BY CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, n DESC, tk, first, name) AS place, type, name, n, evidence FROM cand),
ls AS (SELECT place, list_concat(CASE type WHEN 'hot_file_workflow' THEN ['- Path: `' || name || '`', '- Interactions: ' || tp.n, '- Read count: ' || read_count, '- Edit count: ' || edit_count, '- Read→edit turns: ' || read_edit, '- Edit→validate turns: ' || edit_validate, '- Tools: ' || replace(tools, ',', ', ')]
  WHEN 'repeated_tool_sequence' THEN ['- Sequence: `' || replace(name, '>', ' -> ') || '`', '- Count: ' || tp.n] ELSE ['- Command: `' || name || '`', '- Count: ' || tp.n] END, ['- Evidence: ' || replace(tp.evidence, ',', ', ')]) AS l
  FROM tp LEFT JOIN hot ON type = 'hot_file_workflow' AND hot.path = name WHERE place <= 12)
SELECT CAST(place AS INTEGER) AS place, CAST(i AS INTEGER) AS line_no, l[i] AS line FROM ls, unnest(range(1, len(l) + 1)) t(i)""",
    "log_messages": f"WITH {LOG} SELECT session_file, CAST(turn * 3 + 2 AS INTEGER) AS line_no, role, sha256(text) AS text_sha256, CAST(n_calls AS INTEGER) AS tool_calls FROM lg",
    "log_tool_calls": f"WITH {LOG} SELECT session_file AS session, CAST(asked AS INTEGER) AS turn, CAST(turn * 3 + 2 AS INTEGER) AS line_no, CAST(k AS INTEGER) AS place, ['read', 'edit', 'bash'][CAST((length(text) + k) % 3 + 1 AS INTEGER)] AS tool, 'f' || turn % 3 || '.py' AS path, CAST(NULL AS VARCHAR) AS command FROM lg, unnest([0, 1, 2]) x(k) WHERE k < n_calls AND asked > 0",
    "log_models": f"WITH {LOG} SELECT session_file, CAST(turn * 3 + 2 AS INTEGER) AS line_no, last_value(CASE WHEN turn % 4 = 1 THEN role || '/m' || length(text) % 5 END IGNORE NULLS) OVER (PARTITION BY session_file ORDER BY turn) AS model FROM lg",
    "model_counts": f"WITH {LOG} SELECT role || '/m' || length(text) % 5 AS model, count(*) AS n, count(DISTINCT session_file) AS n_sessions FROM lg WHERE turn % 4 = 1 GROUP BY 1",
    "log_metadata": f"WITH {LOG} SELECT session_file, max('s' || session_file) FILTER (turn = 1) AS session_id, max('t' || session_file) FILTER (turn = 1) AS started_at, CAST(NULL AS VARCHAR) AS last_message_at, count(*) AS message_count, count(*) FILTER (role = 'user') AS user_turn_count, CAST(sum(n_calls) AS BIGINT) AS tool_call_count FROM lg GROUP BY 1",
    "sessions_by_start": f"WITH {M} SELECT session_file, start_time, row_number() OVER (ORDER BY start_time, session_file) - 1 AS place FROM (SELECT session_file, lpad(CAST(sum(length(text)) AS VARCHAR), 12, '0') AS start_time FROM m GROUP BY 1)",
    "commands_and_paths": f"""WITH c AS (SELECT doc_id, source, {_flat("replace('cd /work/app  && cp /tmp/pi-hypa-backup-<TIMESTAMP>/x' || chr(10) || regexp_replace(coalesce(text, ''), '/tmp/pi-hypa-backup-[0-9]{8}-[0-9]{6}', '/tmp/pi-hypa-backup-<TIMESTAMP>', 'g'), '/work/app', '<PROJECT>')")} AS t FROM documents)
SELECT doc_id, sha256(t) AS command_sha256, CAST(length(t) AS INTEGER) AS n_chars, CASE doc_id % 6 WHEN 0 THEN '~' WHEN 1 THEN '<PROJECT>/' || source WHEN 2 THEN '~/' || source WHEN 3 THEN '/work/apple/' || source WHEN 4 THEN '/home/meg/' || source ELSE '/' || source END AS path,
'distill-reduce-' || source AS session_id FROM c""",
    "path_bullets": f"""WITH {CALLS}, f AS (SELECT session, turn, path, min((ts, event_id)) AS first FROM calls WHERE tool = 'read' GROUP BY 1, 2, 3), g AS (SELECT *, row_number() OVER (PARTITION BY session, turn ORDER BY first) AS r FROM f),
b AS (SELECT session, turn, string_agg('- ' || path, chr(10) ORDER BY r) AS bullets FROM g WHERE r <= 5 GROUP BY 1, 2) SELECT session, turn, coalesce(bullets, '- none') AS bullets FROM turns LEFT JOIN b USING (session, turn)""",
    "evidence_lines": "WITH e AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: contains(x, 'tion') OR contains(x, 'der'))[1:3] AS l FROM documents) SELECT doc_id, CAST(len(l) AS INTEGER) AS n, sha256(array_to_string(l, chr(10))) AS lines_sha256 FROM e",
    "rule_validity": "SELECT conv_id, turn, (conv_id + turn) % 5 <> 0 AND (conv_id + turn) % 3 <> 2 AND (conv_id + turn) % 7 <> 0 AND coalesce(text, '') <> '' AS valid FROM conversations",
    "registry_upsert": f"WITH {INDEX}, u AS (SELECT session_file, fingerprint FROM now WHERE session_file IN (SELECT session_file FROM diff WHERE status IN ('new', 'changed')) UNION ALL SELECT session_file, fingerprint FROM before WHERE session_file NOT IN (SELECT session_file FROM diff WHERE status IN ('new', 'changed'))) SELECT session_file, fingerprint, row_number() OVER (ORDER BY session_file) - 1 AS place FROM u",
    "rubric_means": "WITH x AS (SELECT conv_id, turn, conv_id * 7 + turn AS n FROM conversations) SELECT conv_id, turn, CASE WHEN n % 4 <> 0 THEN round_even(CAST((n % 9 + n % 5 + 2.5) AS DOUBLE) / 3, 2) ELSE 0 END AS mean FROM x",
    "cached_model_reports": "SELECT doc_id, sha256(max(coalesce(text, '')) || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) AS content_hash, CASE WHEN doc_id % 7 = 0 THEN 'completed' ELSE 'cached' END AS status FROM documents GROUP BY doc_id",
    "route_sessions": f"WITH {INDEX} SELECT m.session_file, count(*) AS n_messages, CASE WHEN any_value(status) IN ('new', 'changed') THEN 'r2' ELSE 'r1' END AS run FROM m JOIN diff USING (session_file) GROUP BY 1",
    "project_synthesis": f"""WITH {M}, p AS (SELECT session_file AS project, length(arg_max(text, line_no)) % 40 AS s FROM m GROUP BY 1), a AS (SELECT project, s, CASE WHEN s + 8 >= 35 THEN 1 WHEN s + 16 >= 35 THEN 2 ELSE 3 END AS attempt FROM p)
SELECT project, attempt, CASE WHEN s + 8 * attempt >= 35 THEN 'completed' ELSE 'needs_review' END AS status, CAST(s + 8 * attempt AS DOUBLE) AS score FROM a""",
    "turn_refs": """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 's#turn1x' || conv_id END AS session, CAST(CASE WHEN turn % 2 = 0 THEN turn END AS INTEGER) AS turn_index, 'home-x_y-' || role AS project_id FROM conversations""",
}
