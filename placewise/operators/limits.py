"""One decision at a time: the small steps the rate limits are made of.

These run in Python workers. They use nothing but plain values, and are sent along with the job, so
the workers need no copy of this package.
"""

from __future__ import annotations

import json
import sys
from collections import deque
from types import SimpleNamespace

from pyspark import cloudpickle

from ..values import (
    DAILY_MAILS,
    MAX_ACTIVE_PER_EMAIL,
    MAX_RESENDS,
    REPORTS_PER_DAY,
    SIGNUPS_PER_EMAIL,
    SIGNUPS_PER_REQUESTER,
    SIGNUP_RECENT_MINUTES,
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DAY_US = 86_400_000_000


def report_start(entries) -> list:
    """The reports accepted before, from (time, provider)."""
    return [(provider, ts) for ts, provider in entries]


def report_step(accepted: list, row) -> str:
    """Decide one report against the reports accepted in the last 24 hours."""
    accepted[:] = [a for a in accepted if a[1] > row.ts_us - DAY_US]
    if any(a[0] == row.provider_id for a in accepted):
        return "duplicate"
    if len(accepted) >= REPORTS_PER_DAY:
        return "too_many"
    accepted.append((row.provider_id, row.ts_us))
    return "ok"


# A sign-up request is decided by three limits, each over rows of another key: its address, its visitor, the mails of all.
def address_start(entries) -> list:
    """An address's subscriptions, from the rows and accepted requests before, as (time, kind, id, fields)."""
    state: list = []
    for ts, kind, number, fields in sorted(entries):
        address_step(state, SimpleNamespace(ts_us=ts, kind=kind, id=number, fields=fields, blocked=False))
    return state


def address_step(subs: list, row) -> str:
    """What the address's own rows say of a request; ``blocked`` are requests that the other limits refuse.

    ``verified``: confirmed before. ``full``: too many for this address. ``ask``: a confirmation is on its way. ``send``
    and ``held``: a confirmation is due, and sent unless the request is blocked; with the subscription and its visitor.
    """
    f = json.loads(row.fields)
    if row.kind == 0:
        subs.append({"where": f["where"], "at": row.ts_us, "sends": f["sends"], "verified": f["verified"], "ended": f["ended"], "sub": f"s{row.id}", "owner": f["requester"]})
        return "given"
    active = [s for s in subs if s["ended"] < 0 or s["ended"] > row.ts_us]
    same = next((s for s in active if s["where"] == f["where"]), None)
    if same and 0 <= same["verified"] <= row.ts_us:
        return "verified"
    if sum(s["at"] > row.ts_us - DAY_US for s in subs) >= SIGNUPS_PER_EMAIL or len(active) >= MAX_ACTIVE_PER_EMAIL:
        return "full"
    if same and (same["at"] > row.ts_us - SIGNUP_RECENT_MINUTES * 60_000_000 or same["sends"] >= MAX_RESENDS):
        return "ask"
    sub, owner = (same["sub"], same["owner"]) if same else (f"r{row.id}", f["requester"])
    if row.blocked:
        return f"held|{sub}|{owner}"
    if same:
        same.update(at=row.ts_us, sends=same["sends"] + 1)
    else:
        subs.append({"where": f["where"], "at": row.ts_us, "sends": 1, "verified": -1, "ended": -1, "sub": sub, "owner": owner})
    return f"send|{sub}|{owner}"


def visitor_start(entries) -> dict:
    return {sub: ts for ts, sub in sorted(entries)}


def visitor_step(at: dict, row) -> str:
    """``full`` when the visitor's subscriptions of the last 24 hours reach the limit, else ``free``, or ``kept`` if this request adds to them."""
    if row.kind < 2:  # a subscription of the visitor, or one that somebody else renewed
        at[row.sub] = row.ts_us
        return "given"
    for sub in [s for s, ts in at.items() if ts <= row.ts_us - DAY_US]:
        del at[sub]
    if len(at) >= SIGNUPS_PER_REQUESTER:
        return "full"
    if not row.due or row.no_mail or row.owner != row.requester:
        return "free"
    at[row.sub] = row.ts_us
    return "kept"


def mail_start(entries) -> deque:
    return deque(ts for ts, _ in sorted(entries))


def mail_step(sent: deque, row) -> str:
    """``full`` when the mails of the last 24 hours reach the daily limit, else ``free``, or ``kept`` if this request sends one.

    ``logged`` of them are in the mail log already.
    """
    while sent and sent[0] <= row.ts_us - DAY_US:
        sent.popleft()
    if row.logged + len(sent) >= DAILY_MAILS:
        return "full"
    if not row.due:
        return "free"
    sent.append(row.ts_us)
    return "kept"
