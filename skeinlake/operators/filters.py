"""Scopes: the filters of searches and listings as one predicate that reaches the scan."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

TRANSCRIPT_TIERS = ("session", "subagent", "workflow_agent")
ROLE_GROUPS = {"chat": ["user", "assistant"], "tool": ["tool_use", "tool_result"], "other": ["system", "thinking", "reasoning", "note", "memory"]}
# Words that say nothing of a query's subject.  They decide which words of a query count as its
# content, so results equal the published ones only with this list.
STOP_WORDS = set(
    "a an and are as at be by can did do does for from had has have how i if in is it its just me my no not of on or our so "
    "that the their them then there this to was we were what when where which who why will with you your".split()
)


@dataclass(frozen=True)
class Scope:
    """Every field that is set narrows; unset fields don't.  `bank` is exact, `repo`,
    `worktree`, `path` and the facets are literal substrings (no wildcards), `dir`
    is a prefix.  Without `tier` or `all_tiers` only main tiers are looked at."""

    bank: str | None = None
    repo: str | None = None
    tier: str | None = None
    all_tiers: bool = False
    source: str | None = None
    org: str | None = None
    project: str | None = None
    mem_type: str | None = None
    role: str | None = None
    roles: tuple[str, ...] = ()
    worktree: str | None = None
    path: str | None = None
    dir: str | None = None
    prose: bool = False
    since: str | None = None
    until: str | None = None
    via: str | None = None
    chat_id: str | None = None
    from_user: str | None = None
    session: str | None = None

    def predicate(self) -> Column:
        c, parts = F.col, [F.lit(True)]
        parts += [c("bank") == self.bank] * (self.bank is not None)
        within = {"repo_key": self.repo, "worktree": self.worktree, "cwd": self.path}
        parts += [c(k).contains(v) for k, v in within.items() if v is not None]
        if self.tier is not None:
            parts.append(c("tier") == self.tier)
        elif not self.all_tiers:
            parts.append(main_tiers())
        parts += [c(k) == getattr(self, k) for k in ("source", "org", "project", "mem_type", "role") if getattr(self, k) is not None]
        parts += [c("role").isin(list(self.roles))] * bool(self.roles)
        if self.dir is not None:
            parts.append(c("dir").startswith(self.dir))
        parts += [c("role").isin("user", "assistant")] * self.prose
        if self.since is not None:
            parts.append(c("ts") >= to_iso(self.since))
        if self.until is not None:
            parts.append(c("ts") <= to_iso(self.until, True))
        parts += [F.lower(c(k)).contains(getattr(self, k).lower()) for k in ("via", "chat_id", "from_user") if getattr(self, k) is not None]
        parts += [c("session_uuid") == self.session] * (self.session is not None)
        return reduce(lambda a, b: a & b, parts)

    def apply(self, events: DataFrame) -> DataFrame:
        return events.where(self.predicate())


def main_tiers() -> Column:
    kind, tier = F.coalesce("kind", F.lit("")), F.col("tier")
    return ((kind == "transcript") & (tier == "session")) | kind.isin("note", "message") | ((kind == "") & tier.isin("session", "note"))


def overlaps(since: str | None, until: str | None, start: str = "started_at", end: str = "ended_at") -> Column:
    """Sessions that touch a window; one without end counts by its start."""
    out = F.lit(True)
    if since is not None:
        open_ = F.coalesce(end, F.lit("")) == ""
        out = out & ((~open_ & (F.col(end) >= since)) | (open_ & (F.col(start) >= since)))
    return out if until is None else out & (F.col(start) <= until)


def sample(key: Column, one_in: int) -> Column:
    """A deterministic part of the rows by a hash in hex; it is a string comparison that reaches the scan."""
    return key < f"{65536 // one_in:04x}"


def to_iso(value: str, end_of_day: bool = False, now: datetime | None = None) -> str:
    """90m, 12h, 7d ago, a date, or an instant with or without zone, as UTC text."""
    if m := re.fullmatch(r"(\d+)([mhd])", value.strip()):
        back = timedelta(**{{"m": "minutes", "h": "hours", "d": "days"}[m[2]]: int(m[1])})
        at = (now or datetime.now(timezone.utc)) - back
    elif re.fullmatch(r"\d{4}-\d\d-\d\d", value.strip()):
        return f"{value.strip()}T{'23:59:59.999' if end_of_day else '00:00:00.000'}Z"
    else:
        at = datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
        at = (at if at.tzinfo else at.astimezone()).astimezone(timezone.utc)
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


def parse_roles(spec: str) -> list[str]:
    """Names of roles and of groups of them, by commas, each once in order."""
    named = [r.strip().lower() for r in spec.split(",") if r.strip()]
    return list(dict.fromkeys(x for r in named for x in ROLE_GROUPS.get(r, [r])))


def content_terms(query: str) -> list[str]:
    """Words of a query that say something of its subject, each once in order."""
    words = [re.sub(r"[^\w-]", "", w) for w in query.split()]
    first: dict[str, str] = {}
    for word in words:
        if len(word) > 1 and word.lower() not in STOP_WORDS:
            first.setdefault(word.lower(), word)
    return list(first.values())


def facet_argument(value: object) -> str:
    """A facet as given by a caller; booleans, empty and unsafe numbers are refused."""
    if isinstance(value, bool) or value is None or (isinstance(value, float) and not value.is_integer()):
        raise ValueError("a facet is a text or a whole number")
    if isinstance(value, (int, float)) and abs(value) > 2**53 - 1:
        raise ValueError("a number this large must be given as text")
    text = str(int(value) if isinstance(value, float) else value).strip()
    if not text:
        raise ValueError("a facet is not empty")
    return text
