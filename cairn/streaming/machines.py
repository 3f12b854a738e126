"""The command machines of the metadata layers as folds over a log: of a key's versions and uploads, of a block, of a
bucket and of the root's nodes. Each answers every command with an outcome, in the log's order.

A machine is a function of a state and a command that changes the state in place and returns the outcome. A batch folds
each entity's commands in one grouped pass; a stream keeps the state between micro-batches, as JSON, and must agree.
Commands of one entity are applied one after the other by their meaning, so an entity's log is one task's; entities are
spread over all. Commands that come again at or below the last place applied are answered ``repeated`` by the stream.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Machine = Callable[[dict, dict], str]

LEAST_PART = 5 << 20


def _given(value) -> bool:
    return value is not None and value == value  # null and not-a-number are absent


# versions and uploads of a key


def _matches(names: str, etag: str) -> bool:
    return names == "*" or etag in names.split(",")


def _protected(version: dict | None, now: int, bypass: bool) -> bool:
    if version is None:
        return False
    active = version["until"] is not None and version["until"] > now
    return version["hold"] or (active and (version["lock"] == "COMPLIANCE" or not bypass))


def _find(versions: list[dict], named: str | None) -> dict | None:
    """The named version (null or a number), or the newest; versions are in order."""
    if named is None:
        return versions[-1] if versions else None
    return next((v for v in versions if (v["null"] if named == "null" else str(v["seq"]) == named)), None)


def _add(state: dict, c: dict, marker: bool, etag: str) -> None:
    null = c["mode"] != "enabled"
    kept = [v for v in state["versions"] if not (null and v["null"])]
    until, lock = (int(c["until"]), c["lock"]) if not marker and _given(c.get("until")) and _given(c.get("lock")) else (None, None)
    state["versions"] = [*kept, {"seq": int(c["seq"]), "null": null, "marker": marker, "etag": etag, "until": until, "lock": lock, "hold": False}]


def _refused_write(state: dict, c: dict) -> str | None:
    """Why a write that replaces the current version may not, by locks and preconditions."""
    versions = state["versions"]
    if c["mode"] != "enabled" and _protected(_find(versions, "null"), c["at"], False):
        return "Locked"
    current = _find(versions, None)
    current = None if current is None or current["marker"] else current
    if _given(c.get("if_none_match")) and current and _matches(c["if_none_match"], current["etag"]):
        return "PreconditionFailed"
    if _given(c.get("if_match")):
        if current is None:
            return "NoSuchKey"
        if not _matches(c["if_match"], current["etag"]):
            return "PreconditionFailed"
    return None


def _put(state: dict, c: dict) -> str:
    refused = _refused_write(state, c)
    if refused is None:
        _add(state, c, False, c["etag"])
    return refused or "Put"


def _delete(state: dict, c: dict) -> str:
    versions, named = state["versions"], c["named"] if _given(c.get("named")) else None
    if _given(c.get("if_match")):
        target = _find(versions, named)
        if target is None:
            return "NoSuchKey"
        if target["marker"] or not _matches(c["if_match"], target["etag"]):
            return "PreconditionFailed"
    removes = named or ("null" if c["mode"] != "enabled" else None)
    removed = _find(versions, removes) if removes else None
    if _protected(removed, c["at"], bool(c.get("bypass"))):
        return "Locked"
    if removed is not None:
        versions.remove(removed)
    if named is None and c["mode"] != "unversioned":
        _add(state, c, True, "")
        return "Marker"
    return "DeletedMarker" if named and removed and removed["marker"] else "Deleted"


def _create(state: dict, c: dict) -> str:
    state["uploads"][str(c["upload"])] = {}
    return "Created"


def _part(state: dict, c: dict) -> str:
    if not 1 <= int(c["part"]) <= 10_000:
        return "Invalid"
    parts = state["uploads"].get(str(c["upload"]))
    if parts is None:
        return "NoSuchUpload"
    parts[str(int(c["part"]))] = [c["etag"], int(c["size"])]
    return "PartWritten"


def _complete(state: dict, c: dict) -> str:
    """``etag`` lists the parts as number:etag, in the order in which they are given."""
    held = state["uploads"].get(str(c["upload"]))
    if held is None:
        return "NoSuchUpload"
    listed = [x.split(":", 1) for x in (c["etag"] or "").split(",") if x]
    numbers = [int(n) for n, _ in listed]
    if not numbers or sorted(set(numbers)) != numbers:
        return "InvalidPartOrder"
    for k, (n, etag) in enumerate(listed):
        if held.get(n, [None])[0] != etag:
            return "InvalidPart"
        if k + 1 < len(listed) and held[n][1] < LEAST_PART:
            return "EntityTooSmall"
    refused = _refused_write(state, c)
    if refused:
        return refused
    _add(state, c, False, c["etag"])
    del state["uploads"][str(c["upload"])]
    return "Completed"


def _abort(state: dict, c: dict) -> str:
    return "NoSuchUpload" if state["uploads"].pop(str(c["upload"]), None) is None else "Aborted"


def _lock_target(state: dict, c: dict) -> dict | str:
    named = c["named"] if _given(c.get("named")) else None
    found = _find(state["versions"], named)
    if found is None:
        return "NoSuchVersion" if named else "NoSuchKey"
    return "DeleteMarker" if found["marker"] else found


def _retain(state: dict, c: dict) -> str:
    found = _lock_target(state, c)
    if isinstance(found, str):
        return found
    wants = (c["lock"], int(c["until"])) if _given(c.get("until")) and _given(c.get("lock")) else (None, None)
    if found["until"] is not None and found["until"] > c["at"]:
        longer = wants[0] == found["lock"] and wants[1] >= found["until"]
        if not longer and not (found["lock"] == "GOVERNANCE" and bool(c.get("bypass"))):
            return "Locked"
    found["lock"], found["until"] = wants
    return "Retained"


def _hold(state: dict, c: dict) -> str:
    found = _lock_target(state, c)
    if isinstance(found, str):
        return found
    found["hold"] = bool(c["hold"])
    return "Held"


NAME_COMMANDS: dict[str, Machine] = {"put": _put, "delete": _delete, "create": _create, "part": _part, "complete": _complete, "abort": _abort, "retain": _retain, "hold": _hold}


def name_machine(state: dict, c: dict) -> str:
    state.setdefault("versions", [])
    state.setdefault("uploads", {})
    return NAME_COMMANDS[c["op"]](state, c)


# a block and its chunks


def block_machine(state: dict, c: dict) -> str:
    """write, renew, release, move, delete and settle of a block: chunks are volumes by index, a deadline hands it over to its file."""
    op, held = c["op"], "chunks" in state
    if op == "write":
        chunks = [int(x) for x in c["chunks"].split(",") if x]
        if not chunks or len(set(chunks)) < len(chunks):
            return "Invalid"
        if not held:
            state.update(chunks=chunks, file=int(c["file"]), deadline=int(c["at"] + c["handover"]), queued=True, released=False)
            return "Written"
        if state["chunks"] != chunks or state["file"] != int(c["file"]):
            return "Conflict"
        return "Expired" if state["released"] else "Written"
    if op == "delete":
        state.clear()
        return "Deleted"
    if op == "settle":
        if held and not state["released"]:
            state["queued"] = False
        return "Settled"
    if not held:
        return "NoSuchBlock"
    if op == "renew":
        if state["file"] != int(c["file"]):
            return "Conflict"
        if state["released"]:
            return "Expired"
        if state["queued"]:
            state["deadline"] = max(state["deadline"], int(c["at"] + c["handover"]))
        return "Written"
    if op == "release":
        # one renewed since, or settled, is kept
        if not state["released"] and (not state["queued"] or state["deadline"] != int(c["deadline"])):
            return "Written"
        state["released"] = True
        return "Released"
    index, source, target = int(c["index"]), int(c["source"]), int(c["target"])
    if state["released"]:
        return "Expired"
    if index >= len(state["chunks"]):
        return "Invalid"
    if state["chunks"][index] == target:
        return "Moved"
    if state["chunks"][index] != source or target in state["chunks"]:
        return "Conflict"
    state["chunks"][index] = target
    return "Moved"


# a bucket's life


def bucket_machine(state: dict, c: dict) -> str:
    """create, activate, version, lock, begin, abandon, restore, delete, forget and progress of a bucket name; an attempt is the time at which it began."""
    op, known = c["op"], "state" in state
    now = state.get("state")

    def attempt(to: str) -> str:
        state.update(state=to, attempt=int(c["at"]), progress=int(c["at"]))
        return "Creating" if to == "creating" else "Deleting"

    if op == "create":
        if not known:
            if c["owned"] >= c["quota"]:
                return "TooManyBuckets"
            state.update(owner=c["owner"], made=int(c["at"]), lock=bool(c["lock"]), versioning="enabled" if c["lock"] else "unversioned")
            return attempt("creating")
        same = state["owner"] == c["owner"]
        if now == "creating" and same and state["lock"] == bool(c["lock"]):
            return attempt("creating")
        if now in ("creating", "deleted"):
            return "OperationAborted"
        return "AlreadyOwnedByYou" if same else "AlreadyExists"
    if op in ("begin", "abandon"):
        if not known:
            return "NoSuchBucket"
        if now in ("active" if op == "begin" else "creating", "deleting"):
            return attempt("deleting")
        return {"creating": "OperationAborted", "active": "Conflict", "deleted": "NoSuchBucket"}[now]
    if op in ("version", "lock"):
        if op == "version" and c["versioning"] == "unversioned":
            return "Invalid"
        if not known or state["made"] != c["incarnation"] or now in ("creating", "deleted"):
            return "NoSuchBucket"
        if now == "deleting":
            return "OperationAborted"
        if op == "lock":
            if state["versioning"] != "enabled":
                return "VersioningNotEnabled"
            state["lock"] = True
            return "LockConfigured"
        if state["lock"] and c["versioning"] != "enabled":
            return "VersioningLocked"
        state["versioning"] = c["versioning"]
        return "Versioned"
    if op == "forget":
        if not known:
            return "Forgotten"
        if now != "deleted" or state["attempt"] != c["attempt"]:
            return "Conflict"
        state.clear()
        return "Forgotten"
    if not known or state["attempt"] != c["attempt"]:
        return "Conflict"
    if op == "progress":
        if now == "active":
            return "Conflict"
        state["progress"] = int(c["at"])
        return "Progressed"
    before, after, done = {"activate": ("creating", "active", "Activated"), "restore": ("deleting", "active", "Restored"), "delete": ("deleting", "deleted", "Deleted")}[op]
    if now not in (before, after):
        return "Conflict"
    state["state"] = after
    return done


# a range's lineage


def range_machine(state: dict, c: dict) -> str:
    """split, freeze, thaw, end, abandon, merge and resolve of a range: its bounds, its generation, and the merge it is in.

    A frozen range takes only the steps of its merge, an ended one only its end again. ``merge`` names the range above,
    its bounds and whether it fits; it is refused where the two don't border or a merge is still unresolved.
    """
    if not state:
        state.update(low=c["low"], high=c["high"] if _given(c["high"]) else None, generation=1, standing="serving", into=None, taken=None)
    op, standing = c["op"], state["standing"]

    def onward(outcome: str) -> str:
        state["generation"] += 1
        return outcome

    frozen_for = standing == "frozen" and state["into"] is not None and state["into"][1] == c["into_generation"]
    if op == "thaw" and standing == "frozen":
        if not frozen_for:
            return "Conflict"
        state.update(standing="serving", into=None)
        return onward("Thawed")
    if op == "end" and standing != "serving":
        if standing == "ended":
            return "Ended" if state["into"][0] == c["into"] else "Conflict"
        if not frozen_for or state["into"][0] != c["into"]:
            return "Conflict"
        state["standing"] = "ended"
        return "Ended"
    if standing != "serving":
        return "Moved"
    if op in ("thaw", "end"):
        return "Conflict"
    if op in ("split", "merge") and c["generation"] != state["generation"]:
        return "Moved"
    if op == "split":
        at = c["at_key"]
        if not at or at <= state["low"] or (state["high"] is not None and at >= state["high"]):
            return "Invalid"
        state["high"] = at
        return onward("Split")
    if op == "freeze":
        if state["taken"] is not None:
            return "Conflict"
        if c["into_high"] != state["low"]:
            return "Invalid"
        state.update(standing="frozen", into=[c["into"], c["into_generation"]])
        return onward("Frozen")
    if op == "abandon":
        return onward("Refused")
    if op == "resolve":
        if state["taken"] == [c["into"], c["into_generation"]]:
            state["taken"] = None
        return "Resolved"
    borders = state["high"] is not None and state["high"] == c["at_key"]
    if state["taken"] is not None or not borders or not bool(c["fits"]):
        return onward("Refused")
    state.update(high=c["into_high"] if _given(c["into_high"]) else None, taken=[c["into"], c["generation"]])
    state["generation"] = max(state["generation"], int(c["into_generation"])) + 1
    return "Merged"


# the gate of a bucket in a range

#: The steps that creating and deleting a bucket take.
GATE_STEPS = {(None, "open"), (None, "closed"), ("open", "closed"), ("closed", "open"), ("closed", "closed"), ("closed", "condemned"), ("condemned", None)}


def gate_machine(state: dict, c: dict) -> str:
    """A gate's move from one state to another for an attempt; the attempts that dropped a gate are remembered as a floor."""
    state.setdefault("floor", 0)
    before, to = (c[k] if _given(c[k]) else None for k in ("before", "to"))
    attempt, incarnation = int(c["attempt"]), int(c["incarnation"])
    if (before, to) not in GATE_STEPS:
        return "Invalid"
    held = state.get("gate")
    moved = None if to is None else [to, incarnation, attempt]
    if held == moved:
        return "GateMoved"
    if held is not None:
        if held[2] > attempt or held[1] != incarnation or held[0] != before:
            return "Conflict"
    elif (before, to) == ("closed", "condemned") and attempt <= state["floor"]:
        return "GateMoved"
    elif before is not None or attempt < state["floor"]:
        return "Conflict"
    if moved is None:
        if bool(c["holds_rows"]):
            return "NotEmpty"
        state["floor"] = max(state["floor"], attempt)
    state["gate"] = moved
    return "GateMoved"


# sessions of a range

LAST_SERIAL = (1 << 63) - 1
MOST_ANSWERS = 8


def session_machine(state: dict, c: dict) -> str:
    """register, expire, and commands by serial: each is new, answered before, repeated after its answer was acknowledged,
    spent (the last serial), or of an unknown session. Unacknowledged answers past their bound expire the session."""
    op = c["op"]
    if op == "register":
        state.update(low=0, answers=[], last=int(c["at"]))
        return "Registered"
    if op == "expire":
        state.clear()
        return "Expired"
    if "low" not in state:
        return "Unknown"
    serial = int(c["serial"])
    if serial == LAST_SERIAL:
        return "Spent"
    if serial < state["low"]:
        return "Repeated"
    seen = serial in state["answers"]
    state["low"] = max(state["low"], int(c["unanswered"]))
    state["answers"] = [x for x in state["answers"] if x >= state["low"]] + ([] if seen else [serial])
    state["last"] = int(c["at"])
    if len(state["answers"]) > MOST_ANSWERS:
        state.clear()
    return "Answered" if seen else "New"


# the fold


def _head(log: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{c} {log.schema[c].dataType.simpleString()}" for c in keys)


def fold(log: DataFrame, keys: list[str], machine: Machine, order: str = "seq") -> DataFrame:
    """(keys, order, outcome) of every command, each entity's in order."""

    def of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state: dict = {}
        ordered = pdf.sort_values(order, kind="stable")
        outcomes = [machine(state, c) for c in ordered.to_dict("records")]
        return pd.DataFrame({**{k: [v] * len(outcomes) for k, v in zip(keys, key, strict=True)}, order: ordered[order].to_numpy(), "outcome": outcomes})

    return log.groupBy(*keys).applyInPandas(of, f"{_head(log, keys)}, {order} long, outcome string")


def fold_stream(log: DataFrame, keys: list[str], machine: Machine, order: str = "seq") -> DataFrame:
    """The same as a stream: the outcomes of each micro-batch, the entity's state kept between them."""

    def of(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last, kept = held.get if held.exists else (-1, "{}")
        state, rows = json.loads(kept), []
        for c in pd.concat(list(batches)).sort_values(order, kind="stable").to_dict("records"):
            if c[order] <= last:
                rows.append((*key, c[order], "repeated"))
                continue
            rows.append((*key, c[order], machine(state, c)))
            last = int(c[order])
        held.update((last, json.dumps(state)))
        yield pd.DataFrame(rows, columns=[*keys, order, "outcome"])

    return log.groupBy(*keys).applyInPandasWithState(of, f"{_head(log, keys)}, {order} long, outcome string", "last long, state string", "append", GroupStateTimeout.NoTimeout)
