"""Scalar rules: relative times, rates, priorities, staleness, scores, vectors, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product; the cosine if both are of unit length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def iso_seconds(ts: Column) -> Column:
    """A UTC time as ISO text with whole seconds; sessions here run in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def markers(text: Column, words: list[str]) -> Column:
    """How often the words stand in a text between spaces, all together."""
    found = F.split(F.lower(F.coalesce(text, F.lit(""))), " ")
    return F.size(F.filter(found, lambda w: w.isin(words)))


def since_cutoff(since: Column, now: Column) -> Column:
    """'24h', '7d' or '1m' (30 days each) before now; any other value is an ISO time."""
    n = F.regexp_extract(since, r"^(\d+)[hdm]$", 1)
    count = F.when(n != "", n.cast("int"))
    unit = F.substring(since, -1, 1)
    hours = F.when(unit == "h", count).when(unit == "d", count * 24).when(unit == "m", count * 720)
    return F.when(count.isNotNull(), now - F.make_dt_interval(hours=hours)).otherwise(F.try_to_timestamp(since))


def rate_limit(spec: Column) -> Column:
    """struct<n, seconds> of 'N/<count><s|m|h>'; another form is an error."""
    part = lambda i: F.regexp_extract(spec, r"^(\d+)/(\d*)([smh])$", i)
    unit = F.when(part(3) == "s", 1).when(part(3) == "m", 60).when(part(3) == "h", 3600)
    bad = F.raise_error(F.concat(F.lit("bad rate: "), spec))
    many = F.when(part(2) == "", 1).otherwise(part(2).try_cast("int"))
    return F.struct(F.when(part(1) == "", bad.cast("int")).otherwise(part(1).try_cast("int")).alias("n"), (many * unit).alias("seconds"))


def injection_risk(label: Column, confidence: Column) -> Column:
    """A classifier's label and confidence as a risk in 0..1; unknown labels are 0.5."""
    kind = F.upper(label)
    score = F.when(kind == "BENIGN", 1 - confidence).when(kind.isin("INJECTION", "JAILBREAK"), confidence).otherwise(0.5)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def any_toxic(scores: Column, threshold: float = 0.7) -> Column:
    """Whether a label of map<string,double> reaches the threshold."""
    return F.exists(F.map_values(scores), lambda p: p >= threshold)


def ticket_priority(name: Column) -> Column:
    """P0..P3 of a ticket system's priority, such as '1-URGENT' or 'Highest'."""
    p = F.lower(name)
    return F.when(p.rlike("urgent|highest|blocker|critical"), "P0").when(p.rlike("high|major"), "P1").when(p.rlike("medium|normal"), "P2").otherwise("P3")


def alert_priority(severity: Column) -> Column:
    s = F.lower(severity)
    return F.when(s == "critical", "P0").when(s.isin("high", "error", "warning"), "P1").otherwise("P2")


def stale(priority: Column, last_seen: Column, now: Column) -> Column:
    """P0 after 24 hours without change, P1 after 72."""
    age = (F.unix_timestamp(now) - F.unix_timestamp(last_seen)) / 3600
    return F.coalesce(((priority == "P0") & (age > 24)) | ((priority == "P1") & (age > 72)), F.lit(False))


def possibly_stale(last_seen: Column, operational: Column, now: Column) -> Column:
    """After 7 days for operational facts, 30 for architectural ones."""
    days = (F.unix_timestamp(now) - F.unix_timestamp(last_seen)) / 86400
    return days > F.when(operational, 7).otherwise(30)


def recency_weighted(score: Column, ts: Column, now: Column) -> Column:
    return score * F.when((F.unix_timestamp(now) - F.unix_timestamp(ts)) <= 7 * 86400, 1.5).otherwise(1.0)


#: The rules in order, each with its priority; the first that holds decides.
PRIORITY_RULES = [("critical_alert", "P0"), ("warning_alert", "P1"), ("blocker_ticket", "P0"), ("high_ticket", "P1"), ("pipeline_failed", "P1"), ("review_waiting", "P2"), ("mentioned", "P1"), ("urgent_words", "P1")]


def priority_rule(holds: dict[str, Column]) -> Column:
    """The priority of the first rule that holds, else P2; holds has a boolean column for each rule."""
    out = F.lit("P2")
    for name, priority in reversed(PRIORITY_RULES):
        out = F.when(holds[name], priority).otherwise(out)
    return out


def confidence(sources: Column, authoritative: Column) -> Column:
    return F.when(sources >= 3, "High").when((sources == 2) | authoritative, "Medium").otherwise("Low")


def reversibility(path: Column) -> Column:
    """Class of a directory for a disk report."""
    return (
        F.when(path.rlike(r"(?i)deriveddata|docker\.raw"), "system-app")
        .when(path.rlike(r"(?i)whatsapp|telegram|imessage|messages/attachments"), "app-manual")
        .when(path.rlike(r"(?i)(^|/)(node_modules|\.next|target|dist|build|\.venv|venv)(/|$)"), "project-rebuild")
        .when(path.rlike(r"(?i)(^|/)(\.?caches?|\.npm|logs|homebrew|yarn|tmp)(/|$)|go/pkg/mod"), "safe-cache")
        .otherwise("user-data")
    )


def json_path(document: Column, dotted: str) -> Column:
    """A value by its dotted path; null when any part is missing."""
    return F.get_json_object(document, "$." + dotted)


def judge_setting(config: Column, key: str) -> Column:
    """judge.<key>, or the older ragas.<key>."""
    return F.coalesce(json_path(config, f"judge.{key}"), json_path(config, f"ragas.{key}"))


def salvaged_json(reply: Column) -> Column:
    """The outermost {...} of a reply, fences aside; '{}' if it is not JSON."""
    inner = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    return F.when((inner != "") & F.try_parse_json(inner).isNotNull(), inner).otherwise("{}")
