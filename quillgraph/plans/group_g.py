"""Event windows (an extension) and parsed sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import events
from .views import table


def _e(s, d):
    return table(s, d, "events")


QUERIES = {
    "tumbling_events": (
        lambda s, d: events.tumbling(_e(s, d)),
        "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    ),
    "sliding_events": (
        lambda s, d: events.sliding(_e(s, d)),
        "SELECT (date_trunc('day', ts) - INTERVAL 1 DAY * k)::TIMESTAMP AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) t(k) GROUP BY 1, 2",
    ),
    "session_events": (
        lambda s, d: events.sessions(_e(s, d)),
        """WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM events),
          x AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
          SELECT user_id, min(ts)::TIMESTAMP AS start, count(*) AS n FROM x GROUP BY user_id, k""",
    ),
    "dedup_events": (
        lambda s, d: events.first_seen(_e(s, d).select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"]).select("user_id", "event_type", "ts", "event_id"),
        "SELECT user_id, event_type, ts::TIMESTAMP AS ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1",
    ),
}
_ = F
