"""Checks on file paths and hosts named in tool calls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.config import GUARD, Guard


def normal_path(path: Column, home: str = GUARD.home) -> Column:
    """Forward slashes, home expanded, empty and dot segments resolved."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    full = F.when(slashed.startswith("~/"), F.concat(F.lit(home), F.substr(slashed, F.lit(2)))).otherwise(slashed)
    absolute = full.startswith("/")
    segments = F.filter(F.split(full, "/"), lambda s: (s != "") & (s != "."))

    def push(stack: Column, segment: Column) -> Column:
        climbs = segment == ".."
        can_pop = (F.size(stack) > 0) & (F.try_element_at(stack, F.lit(-1)) != "..")
        popped = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
        pushed = F.concat(stack, F.array(segment))
        return (
            F.when(climbs & can_pop, popped)
            .when(climbs & absolute, stack)
            .otherwise(pushed)
        )

    resolved = F.aggregate(segments, F.array().cast("array<string>"), push)
    joined = F.concat(F.when(absolute, "/").otherwise(""), F.array_join(resolved, "/"))
    return F.when(joined == "", ".").otherwise(joined)


def path_verdict(path: Column, guard: Guard = GUARD, strict: bool = False) -> Column:
    """``ok`` or the reason a path is refused: blocked pattern, traversal, outside.

    ``strict`` lets an allowed prefix end only at a path separator.
    """
    normal = normal_path(path, guard.home)
    blocked = reduce(lambda a, b: a | b, [normal.contains(p) for p in guard.blocked_paths])
    inside = reduce(lambda a, b: a | b, [
        (normal == p) | normal.startswith(p + "/") if strict else normal.startswith(p)
        for p in guard.allowed_prefixes
    ])
    return (
        F.when(blocked, "blocked_pattern")
        .when(F.array_contains(F.split(normal, "/"), ".."), "traversal")
        .when(inside, "ok")
        .otherwise("outside")
    )


#: Fixed value: what counts as the host.
HOST = r"(?:https?://)?([a-zA-Z0-9.\-]+)"


def host_of(url: Column) -> Column:
    """Host part of a URL or bare domain, lower case; empty when there is none."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def host_verdict(url: Column, guard: Guard = GUARD) -> Column:
    """``ok`` or the reason a host is refused: unparsed, mail, not_allowed."""
    host = host_of(url)
    mail = F.lower(url).contains("smtp") | url.contains(":25") | url.contains(":587")
    allowed = reduce(lambda a, b: a | b, [(host == d) | host.endswith("." + d) for d in guard.allowed_domains])
    return (
        F.when(host == "", "unparsed").when(mail, "mail").when(allowed, "ok").otherwise("not_allowed")
    )


# Provenance origins and words that show the wish to send.
USER_ORIGINS = ("user", "human")
CONTENT_ORIGINS = ("content", "file", "webpage", "pdf", "api_response", "database")
SEND_TOOLS = ("send_email", "post_webhook", "http_request", "upload_file")
SEND_WORDS = ("send", "email", "post", "upload", "share", "submit", "transfer")


def provenance(origin: Column) -> Column:
    """Class of a tool call's origin: user, content or system."""
    lowered = F.lower(origin)
    return (
        F.when(lowered.isin(*USER_ORIGINS), "user").when(lowered.isin(*CONTENT_ORIGINS), "content").otherwise("system")
    )


def traceable(tool: Column, origin: Column, request: Column) -> Column:
    """True when a call can be traced to the user: not from content, and sends only when asked to send."""
    asked = F.coalesce(request, F.lit(""))
    sends = F.lower(tool).isin(*SEND_TOOLS) & (asked != "") & ~F.lower(asked).rlike("|".join(SEND_WORDS))
    return (provenance(origin) != "content") & ~sends
