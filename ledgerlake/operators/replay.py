"""Ordered folds and replayed state machines (STA, PRD19, ECO7, PRG2, TOP3)."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def replay(rows: DataFrame, key: str, order: list[str], step: Callable[[pd.DataFrame], dict], schema: str) -> DataFrame:
    """One row per key: its rows in order, folded by ``step``."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = step(group.sort_values(order))
        return pd.DataFrame([{key: group[key].iloc[0], **out}])[names]

    return rows.groupBy(key).applyInPandas(run, schema)


def tiered_cache(rows: pd.DataFrame, hot: int = 1 << 20, warm: int = 10 << 20, room: int = 4, ttl: int = 86_400) -> dict:
    """Two levels with LRU and TTL: small hot entries above, larger ones below; the least recent goes down a level if used."""
    upper, lower = OrderedDict(), OrderedDict()
    hits = misses = demoted = expired = 0
    for slot, size, now in zip(rows["slot"], rows["size_bytes"], rows["ts_s"], strict=True):
        found = next((level for level in (upper, lower) if slot in level), None)
        if found is not None and now - found[slot][0] > ttl:
            del found[slot]
            expired += 1
            found = None
        if found is not None:
            hits += 1
            stored, n = found.pop(slot)
            (upper if found is upper or (n > 2 and size < hot) else lower)[slot] = (stored, n + 1)
        else:
            misses += 1
            if size < warm:
                (upper if size < hot else lower)[slot] = (now, 1)
        while len(upper) > room:
            k, v = upper.popitem(last=False)
            if v[1] > 2:
                lower[k] = v
                demoted += 1
        while len(lower) > 2 * room:
            lower.popitem(last=False)
    return {"hits": hits, "misses": misses, "demoted": demoted, "expired": expired}


def sequential_access(rows: pd.DataFrame, keep: int = 10) -> dict:
    """Share of accesses to the slot after one of the client's last."""
    last: list[int] = []
    n = 0
    for slot in rows["slot"]:
        n += bool(last) and slot == last[-1] + 1
        last = [*last, slot][-keep:]
    return {"sequential": n, "accesses": len(rows)}


def oldest_first_cache(rows: pd.DataFrame, room: int = 10, ttl: int = 86_400) -> dict:
    """A bounded cache that drops the entry stored first, and what is older than ``ttl``."""
    held: dict[int, int] = {}
    hits = evicted = 0
    for slot, now in zip(rows["slot"], rows["ts_s"], strict=True):
        if slot in held and now - held[slot] < ttl:
            hits += 1
            continue
        held[slot] = now
        if len(held) > room:
            del held[min(held, key=lambda k: (held[k], k))]
            evicted += 1
    return {"hits": hits, "evicted": evicted, "held": len(held)}


def clear_when_full(rows: pd.DataFrame, room: int = 10) -> dict:
    """A cache that is emptied when full."""
    held: set[int] = set()
    hits = cleared = 0
    for slot in rows["slot"]:
        hits += slot in held
        if slot not in held and len(held) >= room:
            held.clear()
            cleared += 1
        held.add(slot)
    return {"hits": hits, "cleared": cleared}


def wallet(rows: pd.DataFrame, balance: int = 2_000_000, daily: int = 1_000_000) -> dict:
    """Payments accepted while the balance and the day's limit allow."""
    spent: dict[int, int] = {}
    accepted = rejected = 0
    for amount, now in zip(rows["amount"], rows["ts_s"], strict=True):
        day = now // 86_400
        if balance >= amount and spent.get(day, 0) + amount <= daily:
            balance -= amount
            spent[day] = spent.get(day, 0) + amount
            accepted += 1
        else:
            rejected += 1
    return {"accepted": accepted, "rejected": rejected, "balance": balance}


def stake_account(rows: pd.DataFrame, minimum: int = 100, unbonding: int = 14 * 86_400) -> dict:
    """Stake, request, completion and slash events of one account."""
    stake = pending = slashed = ready = 0
    for kind, amount, now in zip(rows["event_type"], rows["amount"], rows["ts_s"], strict=True):
        if pending and now >= ready:
            pending = 0
        if kind in ("click", "view") and amount >= 1:
            stake += amount
        elif kind == "purchase" and not pending and stake:
            take = min(amount, stake)
            if stake - take == 0 or stake - take >= minimum:
                stake, pending, ready = stake - take, take, now + unbonding
        elif kind == "error":
            cut = min(amount, stake)
            stake, slashed = stake - cut, slashed + cut
    return {"stake": stake, "pending": pending, "slashed": slashed}
