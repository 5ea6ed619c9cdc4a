"""Small event frames, and a plain reading of the session rules to compare with."""

from datetime import datetime, timedelta

EVENTS = (
    "seq long, ts timestamp, ip string, user string, user_agent string, status int, path string, source string, "
    "level string, message string"
)
START = datetime(2024, 1, 1, 10, 0, 0)


def event(seq, seconds, ip=None, user=None, status=None, path=None, level=None, message=None, source="ssh_auth", agent=None):
    return (seq, START + timedelta(seconds=seconds), ip, user, agent, status, path, source, level, message)


def events(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


def brute_features(rows, gap=1800, window=60):
    """Order-dependent features per session by walking the sorted events."""
    key = lambda r: (r[2] or "", r[3] or "", r[4] or "")
    out, current, last = [], [], None
    for r in sorted(rows, key=lambda r: (key(r), r[1], r[0])):
        if current and (key(r) != key(current[0]) or (r[1] - last).total_seconds() > gap):
            out.append(current)
            current = []
        current.append(r)
        last = r[1]
    out.append(current)
    table = {}
    for n, part in enumerate(out):
        times = [r[1].timestamp() for r in part]
        statuses = [r[5] for r in part if r[5] is not None]

        def streak(test):
            best = run = 0
            for s in statuses:
                run = run + 1 if test(s) else 0
                best = max(best, run)
            return best

        def peak(test):
            hits = [t for t, r in zip(times, part) if test(r)]
            return max((sum(1 for u in hits if t - window <= u <= t) for t in hits), default=0)

        failed = after = 0
        for s in statuses:
            failed += s == 401
            after += s == 200 and failed > 0
        gaps = [b - a for a, b in zip(times, times[1:])]
        table[(key(part[0]), times[0])] = (
            len(part), streak(lambda s: s == 401), streak(lambda s: 500 <= s < 600), after,
            peak(lambda r: True), peak(lambda r: r[5] == 404), peak(lambda r: r[8] == "error"),
            round(max(gaps, default=0.0), 6),
        )
    return table
