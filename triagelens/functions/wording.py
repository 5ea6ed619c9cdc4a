"""The wording of summaries, highlights, notes and playbooks."""

from __future__ import annotations

# Recommended actions for SSH incidents.
ACTION_BLOCK = ("Block or rate-limit SSH access from source IP ", " at the firewall or perimeter.")
ACTION_REVIEW = (
    "Review authentication logs for the targeted accounts to confirm no unauthorized access occurred."
)
ACTION_SUCCESS = (
    "Investigate successful SSH logins during this incident window for signs of account compromise."
)
ACTION_RESET = "Reset credentials and enforce multi-factor authentication on affected accounts if possible."
ACTION_DEFAULT = "Review SSH configuration and authentication policies to ensure best practices are in place."

# Parts of the SSH incident description.
BRUTE_FORCE_HINT = " This pattern is consistent with SSH brute-force or password-spraying activity."
COMPROMISE_HINT = (
    " Failed authentication activity was followed by one or more successful logins, "
    "which may indicate a successful brute-force attempt or account compromise."
)
NO_AUTH = "no SSH authentication activity recorded"
STREAK_TAIL = ", indicating sustained guessing against one or a small set of credentials"
BURST_TAIL = " events per minute, which is consistent with automated attack tooling"
EXPLAIN_PATTERN = (
    "The pattern of many failures and no successes is consistent with SSH brute-force "
    "or password-spraying activity."
)

# SSH session notes and incident highlights.
NOTE_ONLY_FAILED = "only failed SSH authentications in this session"
NOTE_THEN_SUCCESS = "failed authentications followed by success in this session"
NOTE_VOLUME = "high event volume in this session"
HIGHLIGHT_SUCCESS = "Failed SSH authentications were followed by successful login(s) from the same IP."
HIGHLIGHT_SSH_DEFAULT = "SSH authentication behavior is anomalous but does not match a more specific pattern."

# Apache highlights.
NOTE_RARE_HOUR = "activity occurred during a rare hour"
HIGHLIGHT_RARE_HOUR = "The session occurred during an unusual hour for Apache activity."
HIGHLIGHT_APACHE_DEFAULT = "Apache behavior was anomalous but without a single dominant indicator."

FEATURE_VERSION = "iforest-v2"
GENERIC_FEATURE_VERSION = "generic-v1"

# Playbooks: (attack pattern, severity, slug, title, description, next steps).
PLAYBOOKS = [
    (
        "possible_compromise",
        "high",
        "ssh_possible_compromise_high",
        "SSH possible compromise (high severity)",
        "Multiple failed SSH login attempts followed by a successful login for a sensitive account. "
        "Treat as a likely account compromise until proven otherwise.",
        [
            "Immediately revoke active SSH keys and reset credentials for the affected account(s).",
            "Review all commands and file changes executed during the suspicious session(s).",
            "Search for lateral movement from the source IP and affected account(s) in other logs.",
            "Check for new or modified sudoers entries, cron jobs, startup scripts, or binaries.",
            "Increase monitoring on the affected host(s) and related accounts for at least 24–72 hours.",
        ],
    ),
    (
        "brute_force",
        "medium",
        "ssh_bruteforce_medium",
        "SSH brute-force attempts (medium severity)",
        "Sustained SSH authentication failures from one or a few IPs without clear evidence of a successful compromise.",
        [
            "Block or rate-limit the offending IPs at the firewall, security group, or WAF.",
            "Enable or tighten SSH rate limiting and lockout policies for repeated failures.",
            "Verify that password authentication is disabled where possible and prefer SSH keys.",
            "Ensure multi-factor authentication (MFA) is enabled for administrative accounts.",
            "Review recent authentication logs for similar patterns from other source IPs.",
        ],
    ),
    (
        "password_spray",
        "medium",
        "ssh_password_spray_medium",
        "SSH password spraying / credential stuffing (medium severity)",
        "SSH authentication failures distributed across many accounts from one or more IPs, "
        "suggesting password spraying or credential stuffing rather than a targeted brute-force.",
        [
            "Identify all accounts targeted by the spray and review their recent activity.",
            "Reset passwords and invalidate sessions for any high-value accounts that were targeted.",
            "Check whether the targeted credentials appear in known breach datasets or password dumps.",
            "Increase monitoring and alerting for repeated failures across multiple accounts.",
            "Consider introducing mandatory MFA for all remote-access users if not already in place.",
        ],
    ),
    (
        "low_signal",
        "low",
        "ssh_low_signal_background",
        "Low-signal SSH noise (low severity)",
        "Low-volume SSH authentication noise that does not clearly indicate a focused attack or successful compromise.",
        [
            "Record the source IPs and keep an eye on future activity spikes from the same ranges.",
            "Confirm that SSH configuration follows best practices "
            "(non-root login, key-based auth, no password from internet).",
            "Ensure basic network protections are in place (firewall, security groups, or VPN requirements).",
            "If similar patterns become more frequent, revisit thresholds and consider additional controls.",
        ],
    ),
    (
        "apache_error_spike",
        "medium",
        "apache_error_spike_medium",
        "Apache error spike (medium severity)",
        "Burst of Apache error events (4xx/5xx) which may indicate scanning, misconfiguration, "
        "or application errors affecting availability.",
        [
            "Review the specific error messages and affected endpoints during the spike window.",
            "Check for recent configuration changes or deployments around the time of the spike.",
            "Correlate with access logs to see if the spike is driven by one IP or many clients.",
            "If impact is user-visible, prioritize stabilizing the service and then investigate root cause.",
        ],
    ),
]

# Rule-based analysis.
NO_PLAYBOOK = "No specific playbook matched; using generic guidance."
GENERIC_STEPS = [
    "Review the normalized events and raw source logs for the affected time window.",
    "Validate whether the grouped entities, users, hosts, and source IPs reflect a real incident boundary.",
    "Check surrounding logs or telemetry to determine whether the pattern reflects malicious activity, misuse, "
    "or service degradation.",
    "If suspicious behavior is confirmed, contain affected accounts, hosts, or services and expand monitoring.",
]
HYPOTHESES = {
    "brute_force": (
        "The pattern of repeated authentication failures suggests a brute-force "
        "attempt against one or more accounts."
    ),
    "password_spray": (
        "The distribution of failures across many accounts suggests password spraying or credential stuffing."
    ),
    "possible_compromise": (
        "The combination of failures followed by a successful login suggests a possible account compromise."
    ),
    "auth_fail_burst": (
        "The normalized activity suggests a burst of authentication failures, "
        "which may indicate credential guessing or repeated invalid access attempts."
    ),
    "error_spike": (
        "The incident is dominated by error events, which may indicate an application, "
        "service, or infrastructure failure rather than confirmed malicious activity."
    ),
    "warning_burst": (
        "The incident shows a concentrated burst of warning-level events, which may indicate "
        "degraded service behavior or early-stage abnormal activity."
    ),
}
HYPOTHESIS_DEFAULT = (
    "The activity appears anomalous in the normalized log stream, but the source data does not "
    "support a more specific classification with high confidence."
)
CAVEAT_VOLUME = (
    "Overall incident volume is low in the aggregate data, so severity estimates may be less stable."
)
CAVEAT_IP = "Source IP is unknown in this incident, which limits attribution and correlation."
CAVEAT_USER = (
    "The primary user associated with this activity could not be determined, "
    "which limits user-focused investigation steps."
)
CAVEAT_GENERIC = (
    "This analysis is based on normalized generic logs, so field mapping or parser limitations "
    "may reduce source-specific accuracy."
)
CAVEAT_SCOPE = (
    "This analysis is based only on the structured incident evidence provided and does not include "
    "full endpoint, process, file, or packet telemetry."
)

ANALYSIS_KEYS = [
    "summary", "evidence", "hypothesis", "caveats", "next_steps", "playbook_slug", "playbook_notes",
]

# What each key of an analysis is to hold, in our own words.
RESPONSE_SHAPE = {
    "summary": "one short paragraph",
    "evidence": "list of observations",
    "hypothesis": "one short paragraph",
    "caveats": "list of limits",
    "next_steps": "list of steps",
    "playbook_slug": "name in kebab case, or empty",
    "playbook_notes": "one short paragraph, or empty",
}
