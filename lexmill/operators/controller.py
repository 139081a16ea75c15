"""A bounded search loop over an injected backend and an injected model; it runs on the driver, its searches on the cluster."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

LOCATOR = re.compile(r"\b(?:section|regulation|schedule|part|article)\s+[0-9]+[a-z]?(?:\([^)]+\))*")
WORD = re.compile("[a-z0-9]+")


@dataclass
class Outcome:
    """Evidence in the order it was found, the queries that ran, and why the loop ended."""

    evidence: list[dict[str, Any]] = field(default_factory=list)
    queries: list[str] = field(default_factory=list)
    stop: str = ""


def plain(query: str) -> str:
    return " ".join(WORD.findall(query.lower()))


def check_query(query: str, known: str, most: int = 2500) -> None:
    """Refuses an empty or long query, and one with statutory locators that no known text has."""
    if not query.strip() or len(query) > most:
        raise ValueError("the query is empty or too long")
    new = set(LOCATOR.findall(query.lower())) - set(LOCATOR.findall(known.lower()))
    if new:
        raise ValueError(f"locators without a source: {sorted(new)}")


def investigate(question: str, search: Callable[[str], list[dict[str, Any]]], plan: Callable[[str], list[str]], observe: Callable[[str, list[dict[str, Any]]], dict[str, Any]], operations: int = 3) -> Outcome:
    """Searches until the observer is content or the bound is met.

    ``plan`` gives the first queries, ``observe`` a dict with ``sufficient`` and ``next_query``. Stops: PLAN_FAILED, INVALID_QUERY,
    REPEATED_QUERY, SUFFICIENT, NO_ACTION, OPERATION_LIMIT. Evidence is kept once by ``chunk_id``; ``operations`` is 1 to 5.
    """
    if not 1 <= operations <= 5:
        raise ValueError("operations must be 1 to 5")
    out, seen, held = Outcome(), set(), set()
    try:
        waiting = list(plan(question)) or [question]
    except Exception:
        return Outcome(stop="PLAN_FAILED")
    while len(out.queries) < operations:
        query = waiting.pop(0)
        try:
            check_query(query, " ".join([question, *(e["text"] for e in out.evidence)]))
        except ValueError:
            out.stop = "INVALID_QUERY"
            return out
        if plain(query) in seen:
            out.stop = "REPEATED_QUERY"
            return out
        seen.add(plain(query))
        out.queries.append(query)
        for e in search(query):
            if e["chunk_id"] not in held:
                held.add(e["chunk_id"])
                out.evidence.append(e)
        said = observe(question, out.evidence)
        if said.get("sufficient"):
            out.stop = "SUFFICIENT"
            return out
        if said.get("next_query"):
            waiting.insert(0, said["next_query"])
        if not waiting:
            out.stop = "NO_ACTION"
            return out
    out.stop = "OPERATION_LIMIT"
    return out


@dataclass
class Trace:
    """What a bounded run did: its bundle, all evidence, one entry for each operation, why it stopped, and faults that it went on from."""

    bundle: list[dict[str, Any]] = field(default_factory=list)
    acquired: list[dict[str, Any]] = field(default_factory=list)
    operations: list[dict[str, Any]] = field(default_factory=list)
    stop: str = "BUDGET_EXHAUSTED"
    errors: list[str] = field(default_factory=list)


class Backend:
    """What a run searches with. ``expand`` follows one anchor; a backend without it refuses such actions."""

    def __init__(self, search: Callable[[str, bool], list[dict[str, Any]]], expand: Callable[[str], list[dict[str, Any]]] | None = None):
        self.search, self.expand = search, expand


def replay(recorded: dict[str, list[dict[str, Any]]], expansions: dict[str, list[dict[str, Any]]] | None = None) -> Backend:
    """A backend that gives recorded results again; an unknown query is an error."""
    return Backend(lambda query, graph: recorded[plain(query)], None if expansions is None else expansions.__getitem__)


def bounded(rows: list[dict[str, Any]], k: int, budget: int) -> list[dict[str, Any]]:
    """The first whole rows that fit, ``k`` at most."""
    out, used = [], 0
    for r in rows:
        if len(out) < k and used + len(r["text"]) <= budget:
            out.append(r)
            used += len(r["text"])
    return out


def adaptive(question: str, history: list[str], backend: Backend, plan: Callable[[str], list[str]], observe: Callable[[dict[str, Any]], dict[str, Any]], operations: int = 3, k: int = 10, budget: int = 18000, graph: bool = True) -> Trace:
    """Searches and expands until coverage is complete, nothing new is found twice, the observer stops, an action repeats or fails, or the budget of 1 to 5 operations ends.

    The first action searches for the whole conversation. ``plan`` gives further queries and may fail: the run goes on with the question alone. ``observe`` gets the
    question, the evidence that fits its view, and what is left of the budget, and says ``{"issues": {id: status}, "next_action": {"type", "query", "target_anchor", "graph"}}``; where it fails, the next planned query
    is searched. EXPAND needs an anchor that some evidence names in ``canonical_ids``. Evidence is kept once by ``chunk_id``; each entry has the bundle as it stood.
    """
    if not 1 <= operations <= 5:
        raise ValueError("operations must be 1 to 5")
    out, seen, held = Trace(), set(), set()
    try:
        waiting = [q for q in plan(question)]
    except Exception as e:
        out.errors.append(f"plan: {e}")
        waiting = []
    first = "\n".join([*history, question]).strip()
    waiting = [q for q in waiting if plain(q) != plain(first)]
    planned = lambda: {"type": "SEARCH", "query": waiting.pop(0), "graph": graph} if waiting else {"type": "STOP"}
    action, idle = {"type": "SEARCH", "query": first, "graph": graph}, 0
    for turn in range(operations):
        kind = action.get("type")
        if kind == "STOP":
            out.stop = "CONTROLLER_STOP"
            break
        sign = (kind, plain(action.get("query", "")), bool(action.get("graph")), action.get("target_anchor"))
        if sign in seen:
            out.stop = "REPEATED_ACTION"
            break
        seen.add(sign)
        try:
            if kind == "SEARCH":
                check_query(action.get("query", ""), " ".join([first, *(e["text"] for e in out.acquired)]))
                found = backend.search(action["query"], bool(action.get("graph")))
            elif kind == "EXPAND":
                if backend.expand is None:
                    raise ValueError("the backend can't expand")
                if not any(action.get("target_anchor") in e.get("canonical_ids", ()) for e in out.acquired):
                    raise ValueError("no evidence names the anchor")
                found = backend.expand(action["target_anchor"])
            else:
                raise ValueError(f"unknown action {kind}")
        except Exception as e:
            out.errors.append(f"action: {e}")
            out.stop = "INVALID_ACTION_OR_TOOL_ERROR"
            break
        new = [e for n, e in enumerate(found) if e["chunk_id"] not in held and e["chunk_id"] not in {x["chunk_id"] for x in found[:n]}]
        held.update(e["chunk_id"] for e in new)
        out.acquired += new
        idle = 0 if new else idle + 1
        entry = {"operation": turn + 1, "action": action, "new": len(new)}
        done = False
        try:
            said = observe({"question": question, "evidence": bounded(out.acquired, 100, 60000), "left": operations - turn - 1})
            entry["said"] = said
            issues = said.get("issues", {})
            done = bool(issues) and all(v == "FULL" for v in issues.values())
            action = said.get("next_action", {"type": "STOP"})
        except Exception as e:
            out.errors.append(f"observation: {e}")
            action = planned()
        entry["bundle"] = [e["chunk_id"] for e in bounded(out.acquired, k, budget)]
        out.operations.append(entry)
        if done or idle >= 2:
            out.stop = "ESTIMATED_COVERAGE_COMPLETE" if done else "NO_NEW_EVIDENCE"
            break
    out.bundle = bounded(out.acquired, k, budget)
    return out
