"""DuckDB statements for titles, notes, highlights, evidence and analysis."""

from __future__ import annotations

from triagelens.functions import rules as r
from triagelens.functions import wording as w
from triagelens.oracle import ssh_sql
from triagelens.oracle import text_sql
from triagelens.oracle import views as v

q = ssh_sql.q


def joined(items: list[tuple[str, str]], sep: str, default: str | None = None) -> str:
    """Texts whose condition holds, joined; ``default`` when none does."""
    body = f"concat_ws({q(sep)}, " + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in items) + ")"
    return body if default is None else f"coalesce(nullif({body}, ''), {q(default)})"


MASSIVE = "auth_failed >= 100 AND auth_fail_ratio >= 0.9::DOUBLE"
IP = "coalesce(ip, 'unknown')"
ACTION_ITEMS = [
    (MASSIVE, f"{q(w.ACTION_BLOCK[0])} || {IP} || {q(w.ACTION_BLOCK[1])}"),
    (MASSIVE, q(w.ACTION_REVIEW)),
    ("auth_success > 0", q(w.ACTION_SUCCESS)),
    ("auth_success > 0", q(w.ACTION_RESET)),
]


def actions(sep: str) -> str:
    return joined(ACTION_ITEMS, sep, w.ACTION_DEFAULT)


TITLE = f"upper(left(severity, 1)) || substr(severity, 2) || ' severity SSH incident from ' || {IP}"
_INTENSITY = joined(
    [
        ("auth_failed_streak_max >= 50", f"'maximum consecutive failed attempts reached ' || auth_failed_streak_max || {q(w.STREAK_TAIL)}"),
        ("auth_burst_max_per_minute >= 1000", f"'peak SSH activity reached ' || auth_burst_max_per_minute || {q(w.BURST_TAIL)}"),
    ],
    " ",
)
DESCRIPTION = f"""'IP ' || {IP} || ' generated ' || total_events || ' SSH log events across ' || session_count || ' session(s), with '
  || CASE WHEN auth_success > 0 AND auth_failed > 0 THEN auth_failed || ' failed and ' || auth_success || ' successful SSH authentication attempts'
       WHEN auth_failed > 0 THEN auth_failed || ' failed SSH authentication attempts and no successes'
       WHEN auth_success > 0 THEN auth_success || ' successful SSH authentication attempts' ELSE {q(w.NO_AUTH)} END
  || '. Authentication failure ratio is ' || printf('%.2f', auth_fail_ratio) || ' and the average anomaly score is '
  || printf('%.3f', avg_anomaly_score) || '.'
  || CASE WHEN {MASSIVE} AND auth_success = 0 THEN {q(w.BRUTE_FORCE_HINT)} ELSE '' END
  || CASE WHEN has_success_after_failures THEN {q(w.COMPROMISE_HINT)} ELSE '' END
  || ' This activity was observed between ' || first_seen || ' and ' || last_seen || '.'
  || CASE WHEN {_INTENSITY} = '' THEN '' ELSE ' Authentication intensity: ' || {_INTENSITY} || '.' END
  || ' Recommended actions: ' || {actions('; ')} || '.'"""
EXPLANATION = f"""concat_ws(' ', 'This appears to be a ' || severity || ' severity SSH incident from ' || {IP} || ', with ' || auth_failed
  || ' failed and ' || auth_success || ' successful authentication attempts across ' || session_count || ' session(s).',
  'The activity occurred between ' || first_seen || ' and ' || last_seen || '.',
  CASE WHEN {MASSIVE} THEN {q(w.EXPLAIN_PATTERN)} END, 'Recommended next steps include: ' || {actions('; ')} || '.')"""
SSH_HIGHLIGHT_ITEMS = [
    ("has_success_after_failures", q(w.HIGHLIGHT_SUCCESS)),
    (
        MASSIVE,
        "'High volume of failed SSH authentications (' || auth_failed || ') with a failure ratio of ' || printf('%.2f', auth_fail_ratio) || ', consistent with brute-force behavior.'",
    ),
    ("auth_failed_streak_max >= 50", "'Maximum consecutive failed attempts reached ' || auth_failed_streak_max || '.'"),
    ("auth_burst_max_per_minute >= 1000", "'Peak SSH event rate reached ' || auth_burst_max_per_minute || ' events per minute.'"),
]
SSH_HIGHLIGHTS = joined(SSH_HIGHLIGHT_ITEMS, "\n", w.HIGHLIGHT_SSH_DEFAULT)
SSH_NOTES = joined(
    [
        ("auth_failed > 0 AND auth_success = 0", q(w.NOTE_ONLY_FAILED)),
        ("auth_failed > 0 AND auth_success > 0", q(w.NOTE_THEN_SUCCESS)),
        ("event_count >= 100", q(w.NOTE_VOLUME)),
    ],
    "\n",
)
EVENT_TYPE = """CASE WHEN auth_success > 0 AND auth_failed > 0 THEN 'failures_then_success' WHEN auth_success > 0 THEN 'success'
  WHEN auth_failed > 0 THEN 'failure' ELSE 'session' END"""


# --- Apache ------------------------------------------------------------------

B5, BE, HI, RM, RP, RH = (
    "apache_5xx_burst_max_per_minute apache_error_burst_max_per_minute apache_high_severity_ratio "
    "apache_rare_error_message_ratio apache_rare_path_ratio apache_rare_hour"
).split()
_APACHE = [
    f"{B5} >= 5 OR {BE} >= 10",
    f"{HI} > 0.1::DOUBLE",
    f"{RM} >= 0.3::DOUBLE OR {RP} >= 0.3::DOUBLE",
    f"{RH} > 0",
    "error_events > 0 AND apache_error_vs_notice_ratio > 2.0::DOUBLE",
]
APACHE_VIEW = f"""
aclass AS (
  SELECT *, {ssh_sql.case(_APACHE, [q(a) for a, _ in r.APACHE_PATTERNS])} AS attack_pattern,
    {ssh_sql.case(_APACHE, [q(b) for _, b in r.APACHE_PATTERNS])} AS attack_pattern_reason,
    CASE WHEN {B5} >= 5 OR {BE} >= 10 OR {HI} > 0.1::DOUBLE OR (anomaly_score >= 0.20::DOUBLE AND status_5xx > 0) THEN 'medium' ELSE 'low' END AS severity,
    CASE WHEN {B5} >= 5 OR {BE} >= 10 OR {HI} > 0.1::DOUBLE OR {RM} >= 0.3::DOUBLE OR {RP} >= 0.3::DOUBLE THEN 'medium' ELSE 'low' END AS confidence
  FROM scored)
"""
APACHE_NOTES = joined(
    list(
        zip(
            [
                "error_ratio > 0.3::DOUBLE",
                "apache_error_vs_notice_ratio > 2.0::DOUBLE",
                f"{BE} >= 10",
                f"{B5} >= 5",
                f"{RM} > 0.3::DOUBLE",
                f"{HI} > 0.1::DOUBLE",
                f"{RH} > 0",
            ],
            [q(n) for n in r.APACHE_NOTES],
        )
    ),
    "; ",
    r.NO_NOTES,
)
APACHE_SESSION_NOTES = joined(
    [
        ("status_5xx > 0", "status_5xx || ' server-error events in this session'"),
        ("error_events > 0", "error_events || ' error-level Apache events'"),
        ("apache_rare_error_message_count > 0", "apache_rare_error_message_count || ' rare error message template(s)'"),
        (f"{RH} > 0", q(w.NOTE_RARE_HOUR)),
    ],
    "\n",
)
APACHE_HIGHLIGHT_ITEMS = [
    (f"{B5} >= 5", f"'5xx responses were bursty, peaking at ' || {B5} || ' per minute.'"),
    (f"{BE} >= 5", f"'Apache error events were bursty, peaking at ' || {BE} || ' per minute.'"),
    (f"{RM} > 0", f"'Rare error templates accounted for ' || printf('%.2f', {RM}) || ' of observed Apache error messages.'"),
    (f"{RP} > 0", f"'Rare paths accounted for ' || printf('%.2f', {RP}) || ' of distinct path activity.'"),
    (f"{RH} > 0", q(w.HIGHLIGHT_RARE_HOUR)),
]
APACHE_HIGHLIGHTS = joined(APACHE_HIGHLIGHT_ITEMS, "\n", w.HIGHLIGHT_APACHE_DEFAULT)


def on_web_sessions(select: str, base: list[str] | None = None) -> str:
    return v.with_views(*(base or v.feature_views()), ssh_sql.SCORED, APACHE_VIEW) + " " + select


# --- generic ------------------------------------------------------------------

GENERIC_HIGHLIGHTS = """concat_ws(chr(10), 'Grouped by key: ' || group_key || '.',
  'Observed ' || event_count || ' event(s), including ' || error_count || ' error(s) and ' || warning_count || ' warning(s).',
  'Distinct entities: ' || distinct_users || ' user(s), ' || distinct_hosts || ' host(s), ' || distinct_src_ips || ' source IP(s).',
  CASE WHEN first_seen IS NOT NULL THEN 'Time range: ' || first_seen || ' to ' || last_seen || '.' END,
  'Source type ''' || source_type || ''' grouped into pattern ''' || attack_pattern || '''.')"""


# --- analysis -------------------------------------------------------------------


def playbook_case(column: str, default: str = "NULL") -> str:
    """Exact (pattern, severity) first, then (pattern, medium)."""
    at = {"slug": 2, "title": 3, "description": 4, "steps": 5}[column]
    value = lambda b: q("\n".join(b[5])) if column == "steps" else q(b[at])
    exact = " ".join(f"WHEN attack_pattern = {q(b[0])} AND severity = {q(b[1])} THEN {value(b)}" for b in w.PLAYBOOKS)
    medium = " ".join(f"WHEN attack_pattern = {q(b[0])} THEN {value(b)}" for b in w.PLAYBOOKS if b[1] == "medium")
    return f"coalesce(CASE {exact} END, CASE {medium} END, {default})"


def summary(line: str) -> str:
    title = playbook_case("title")
    return f"""'This incident involves activity associated with ' || coalesce(primary_user, 'unknown user') || ' from ' || coalesce(ip, 'unknown IP')
      || ', classified as ' || severity || ' severity with attack pattern ''' || attack_pattern || '''.'
      || CASE WHEN {title} IS NULL THEN '' ELSE ' It aligns most closely with the playbook ''' || {title} || '''.' END || ' ' || {line}"""


def hypothesis() -> str:
    cases = " ".join(f"WHEN {q(p)} THEN {q(h)}" for p, h in w.HYPOTHESES.items())
    return f"""CASE WHEN {playbook_case('title')} IS NOT NULL THEN 'The activity is most consistent with ''' || {playbook_case('title')}
      || ''', suggesting ' || lower({playbook_case('description')})
      ELSE CASE attack_pattern {cases} ELSE {q(w.HYPOTHESIS_DEFAULT)} END END"""


def steps() -> str:
    return playbook_case("steps", q("\n".join(w.GENERIC_STEPS)))


def caveats(generic: bool) -> str:
    items = [
        ("true", q(w.CAVEAT_VOLUME)),
        ("ip IS NULL", q(w.CAVEAT_IP)),
        ("primary_user IS NULL", q(w.CAVEAT_USER)),
        ("true" if generic else "false", q(w.CAVEAT_GENERIC)),
        ("true", q(w.CAVEAT_SCOPE)),
    ]
    return joined(items, "\n")


def first_three(highlights: str) -> str:
    return f"""array_to_string(list_transform(string_split({highlights}, chr(10))[1:3], lambda h: '- ' || h), chr(10))"""


SSH_BULLETS = f"""concat_ws(chr(10), 'Total events in this incident: ' || total_events || '.',
  'Observed ' || auth_failed || ' failed and ' || auth_success || ' successful SSH authentication attempts.',
  'Authentication failure ratio is approximately ' || printf('%.2f', auth_fail_ratio) || '.',
  CASE WHEN auth_failed_streak_max > 0 THEN 'Maximum consecutive failed logins: ' || auth_failed_streak_max || '.' END,
  CASE WHEN auth_burst_max_per_minute > 0 THEN 'Maximum failed-login burst in a one-minute window: ' || auth_burst_max_per_minute || ' events.' END,
  'Observed time range: ' || first_seen || ' to ' || last_seen || '.', 'Evidence highlights:', {first_three(SSH_HIGHLIGHTS)})"""
GENERIC_BULLETS = f"""concat_ws(chr(10), 'Total events in this incident: ' || event_count || '.',
  'Generic incident counts include ' || error_count || ' error event(s) and ' || warning_count || ' warning event(s).',
  'Distinct entities observed: ' || distinct_users || ' user(s), ' || distinct_hosts || ' host(s), and ' || distinct_src_ips || ' source IP(s).',
  CASE WHEN first_seen IS NOT NULL THEN 'Observed time range: ' || first_seen || ' to ' || last_seen || '.' END,
  'Source type: ' || source_type || '.', 'Grouping key: ' || group_key || '.', 'Evidence highlights:',
  {first_three(GENERIC_HIGHLIGHTS)}, 'Sample normalized events included: ' || least(event_count, 5) || '.')"""


def ssh_analysis() -> str:
    line = "'SSH incident ' || incident_id || ' with attack pattern ''' || attack_pattern || ''' and severity ' || severity || '.'"
    return ssh_sql.on_incidents(
        f"""SELECT incident_id, {summary(line)} AS summary, {SSH_BULLETS} AS evidence, {hypothesis()} AS hypothesis,
        {caveats(False)} AS caveats, {steps()} AS next_steps, {playbook_case('slug')} AS playbook_slug,
        {playbook_case('description', q(w.NO_PLAYBOOK))} AS playbook_notes FROM incidents"""
    )


def generic_analysis() -> str:
    line = """'Generic incident ' || incident_id || ' for log_type ''' || source_type || ''' with attack pattern ''' || attack_pattern || ''' and severity ' || severity || '.'"""
    return text_sql.on_generic(
        f"""SELECT incident_id, {summary(line)} AS summary, {GENERIC_BULLETS} AS evidence, {hypothesis()} AS hypothesis,
        {caveats(True)} AS caveats, {steps()} AS next_steps, {playbook_case('slug')} AS playbook_slug,
        {playbook_case('description', q(w.NO_PLAYBOOK))} AS playbook_notes
        FROM gincidents JOIN (SELECT group_key, bucket, arg_min(src_ip, seq) FILTER (WHERE src_ip IS NOT NULL) AS ip,
          arg_min("user", seq) FILTER (WHERE "user" IS NOT NULL) AS primary_user FROM grouped GROUP BY ALL) USING (group_key, bucket)"""
    )
