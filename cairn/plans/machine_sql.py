"""The machines in SQL: all entities advance together, one command a step, by a recursive query whose rows are their states."""

from __future__ import annotations

from .sql import VIEWS


def _run(log: str, key: str, start: dict[str, str], outcome: str, after: dict[str, str], found: str = "*") -> str:
    """``log`` has the key, seq and ``i`` from 1. ``found`` may add columns that read the state (s_ columns) and the command, ``outcome`` reads those too, and each new state may read ``outcome``."""
    initial = ", ".join(f"CAST({value} AS {kind}) AS s_{name}" for name, (value, kind) in ((n, v.rsplit(" ", 1)) for n, v in start.items()))
    moved = ", ".join(f"{after.get(name, 's_' + name)} AS s_{name}" for name in start)
    return f"""WITH RECURSIVE {VIEWS["version_log"]}, log AS ({log}),
run AS (SELECT {key}, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS outcome, {initial} FROM (SELECT DISTINCT {key} FROM log)
    UNION ALL SELECT {key}, i, seq, outcome, {moved} FROM (SELECT *, {outcome} AS outcome FROM (SELECT {found} FROM (SELECT r.* EXCLUDE (i, seq, outcome), c.* EXCLUDE ({key}) FROM run r JOIN log c ON c.{key} = r.{key} AND c.i = r.i + 1))))
SELECT {key}, seq, outcome FROM run WHERE i > 0"""


PLACE = "row_number() OVER (PARTITION BY user_id ORDER BY seq)"

SESSIONS = _run(
    f"""SELECT user_id AS session, seq, i, CASE WHEN i = 1 OR seq % 37 = 0 THEN 'register' WHEN seq % 41 = 0 THEN 'expire' ELSE 'command' END AS op,
        CASE WHEN seq % 53 = 0 THEN 9223372036854775807 WHEN seq % 3 = 0 THEN i - 1 WHEN seq % 11 = 0 THEN i - 6 ELSE i END AS serial, CASE WHEN seq % 5 = 0 THEN 0 ELSE i - 3 END AS unanswered FROM (SELECT *, {PLACE} AS i FROM version_log)""",
    "session",
    {"low": "NULL BIGINT", "answers": "[] BIGINT[]"},
    """CASE WHEN op = 'register' THEN 'Registered' WHEN op = 'expire' THEN 'Expired' WHEN s_low IS NULL THEN 'Unknown' WHEN serial = 9223372036854775807 THEN 'Spent' WHEN serial < s_low THEN 'Repeated'
        WHEN list_contains(s_answers, serial) THEN 'Answered' ELSE 'New' END""",
    {
        "low": """CASE outcome WHEN 'Registered' THEN 0 WHEN 'Expired' THEN NULL WHEN 'Unknown' THEN NULL WHEN 'Spent' THEN s_low WHEN 'Repeated' THEN s_low
            ELSE CASE WHEN len(list_filter(s_answers, lambda x: x >= greatest(s_low, unanswered))) + CAST(outcome = 'New' AS INT) > 8 THEN NULL ELSE greatest(s_low, unanswered) END END""",
        "answers": """CASE WHEN outcome IN ('Registered', 'Expired') THEN [] WHEN outcome IN ('New', 'Answered') THEN list_concat(list_filter(s_answers, lambda x: x >= greatest(s_low, unanswered)), CASE WHEN outcome = 'New' THEN [serial] ELSE [] END) ELSE s_answers END""",
    },
)

_PAIRS = [("NULL", "'open'"), ("'open'", "'closed'"), ("'closed'", "'condemned'"), ("'condemned'", "NULL"), ("'closed'", "'open'"), ("NULL", "'closed'"), ("'closed'", "'closed'"), ("'open'", "'condemned'")]

GATES = _run(
    f"""SELECT user_id AS gate, seq, i, [{", ".join(p[0] for p in _PAIRS)}][step + 1] AS before, [{", ".join(p[1] for p in _PAIRS)}][step + 1] AS into_, step <> 7 AS allowed, i // 4 AS attempt, i // 16 AS incarnation, seq % 9 = 0 AS holds_rows
        FROM (SELECT *, CASE WHEN seq % 7 = 0 THEN seq % 8 ELSE i % 4 END AS step FROM (SELECT *, {PLACE} AS i FROM version_log))""",
    "gate",
    {"floor": "0 BIGINT", "state": "NULL VARCHAR", "made": "NULL BIGINT", "attempt": "NULL BIGINT"},
    """CASE WHEN NOT allowed THEN 'Invalid' WHEN (into_ IS NULL AND s_state IS NULL) OR coalesce(into_ = s_state AND s_made = incarnation AND s_attempt = attempt, false) THEN 'GateMoved'
        WHEN s_state IS NOT NULL AND (s_attempt > attempt OR s_made <> incarnation OR s_state IS DISTINCT FROM before) THEN 'Conflict'
        WHEN s_state IS NULL AND before = 'closed' AND into_ = 'condemned' AND attempt <= s_floor THEN 'GateMoved' WHEN s_state IS NULL AND (before IS NOT NULL OR attempt < s_floor) THEN 'Conflict'
        WHEN into_ IS NULL AND holds_rows THEN 'NotEmpty' ELSE 'GateMoved' END""",
    {
        "floor": "CASE WHEN outcome = 'GateMoved' AND into_ IS NULL AND s_state IS NOT NULL THEN greatest(s_floor, attempt) ELSE s_floor END",
        **{
            name: f"CASE WHEN outcome <> 'GateMoved' OR (s_state IS NULL AND before IS NOT NULL) THEN s_{name} WHEN into_ IS NULL THEN NULL ELSE {value} END"
            for name, value in (("state", "into_"), ("made", "incarnation"), ("attempt", "attempt"))
        },
    },
)

_HOUR = 3_600_000_000

BLOCKS = _run(
    f"""SELECT *, coalesce(last_value(CASE WHEN op IN ('write', 'renew') THEN moment + {_HOUR} END IGNORE NULLS) OVER (PARTITION BY block ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS read_deadline FROM (SELECT user_id AS block, seq, {PLACE} AS i, created AS moment,
        CASE WHEN kind = 'view' THEN 'write' WHEN kind = 'click' THEN 'renew' WHEN kind = 'purchase' THEN 'move' WHEN seq % 4 = 0 THEN 'release' WHEN seq % 4 = 1 THEN 'settle' WHEN seq % 20 = 2 THEN 'delete' ELSE 'release' END AS op,
        CASE WHEN seq % 17 = 0 THEN [1, 1, 2] ELSE [1, 2, 3] END AS chunks, CAST(seq % 19 <> 0 AS BIGINT) AS file, seq % 4 AS place, seq % 3 + 1 AS source, seq % 6 + 1 AS target FROM version_log)""",
    "block",
    {"chunks": "NULL BIGINT[]", "file": "NULL BIGINT", "deadline": "NULL BIGINT", "queued": "false BOOLEAN", "released": "false BOOLEAN"},
    """CASE WHEN op = 'write' THEN CASE WHEN len(list_distinct(chunks)) < len(chunks) THEN 'Invalid' WHEN s_chunks IS NULL THEN 'Written' WHEN s_chunks <> chunks OR s_file <> file THEN 'Conflict' WHEN s_released THEN 'Expired' ELSE 'Written' END
        WHEN op = 'delete' THEN 'Deleted' WHEN op = 'settle' THEN 'Settled' WHEN s_chunks IS NULL THEN 'NoSuchBlock' WHEN op = 'renew' THEN CASE WHEN s_file <> file THEN 'Conflict' WHEN s_released THEN 'Expired' ELSE 'Written' END
        WHEN op = 'release' THEN CASE WHEN NOT s_released AND (NOT s_queued OR s_deadline <> read_deadline) THEN 'Written' ELSE 'Released' END
        WHEN s_released THEN 'Expired' WHEN place >= len(s_chunks) THEN 'Invalid' WHEN s_chunks[place + 1] = target THEN 'Moved' WHEN s_chunks[place + 1] <> source OR list_contains(s_chunks, target) THEN 'Conflict' ELSE 'Moved' END""",
    {
        "chunks": "CASE WHEN op = 'delete' THEN NULL WHEN op = 'write' AND outcome = 'Written' THEN chunks WHEN op = 'move' AND outcome = 'Moved' THEN list_transform(s_chunks, lambda x, n: CASE WHEN n = place + 1 THEN target ELSE x END) ELSE s_chunks END",
        "file": "CASE WHEN op = 'write' AND outcome = 'Written' THEN file ELSE s_file END",
        "deadline": f"CASE WHEN op = 'write' AND s_chunks IS NULL AND outcome = 'Written' THEN moment + {_HOUR} WHEN op = 'renew' AND outcome = 'Written' AND s_queued THEN greatest(s_deadline, moment + {_HOUR}) ELSE s_deadline END",
        "queued": "CASE WHEN op = 'write' AND s_chunks IS NULL AND outcome = 'Written' THEN true WHEN op = 'settle' AND s_chunks IS NOT NULL AND NOT s_released THEN false ELSE s_queued END",
        "released": "CASE WHEN op = 'delete' OR (op = 'write' AND s_chunks IS NULL AND outcome = 'Written') THEN false WHEN op = 'release' AND outcome = 'Released' THEN true ELSE s_released END",
    },
)

BUCKETS = _run(
    f"""SELECT *, coalesce(last_value(CASE WHEN op IN ('create', 'begin', 'abandon') THEN moment END IGNORE NULLS) OVER w, 0) AS attempt, coalesce(first_value(CASE WHEN op = 'create' THEN moment END IGNORE NULLS) OVER w, 0) AS incarnation FROM (SELECT user_id AS bucket_, seq, {PLACE} AS i, created AS moment,
        CASE WHEN kind = 'view' THEN 'create' WHEN kind = 'click' THEN ['activate', 'delete', 'forget', 'progress'][seq % 4 + 1] WHEN kind = 'purchase' THEN CASE WHEN seq % 2 = 0 THEN 'version' ELSE 'lock' END WHEN kind = 'signup' THEN 'begin' WHEN seq % 2 = 0 THEN 'abandon' ELSE 'restore' END AS op,
        CASE WHEN seq % 5 = 0 THEN 'other' ELSE 'me' END AS owner, user_id % 3 = 0 AS locks, user_id % 29 >= 28 AS full_, ['enabled', 'suspended', 'unversioned'][seq % 3 + 1] AS versioning FROM version_log) WINDOW w AS (PARTITION BY bucket_ ORDER BY seq ROWS UNBOUNDED PRECEDING)""",
    "bucket_",
    {"state": "NULL VARCHAR", "owner": "NULL VARCHAR", "made": "NULL BIGINT", "lock": "false BOOLEAN", "versioning": "NULL VARCHAR", "attempt": "NULL BIGINT"},
    """CASE WHEN op = 'create' THEN CASE WHEN s_state IS NULL THEN CASE WHEN full_ THEN 'TooManyBuckets' ELSE 'Creating' END WHEN s_state = 'creating' AND s_owner = owner AND s_lock = locks THEN 'Creating' WHEN s_state IN ('creating', 'deleted') THEN 'OperationAborted' WHEN s_owner = owner THEN 'AlreadyOwnedByYou' ELSE 'AlreadyExists' END
        WHEN op IN ('begin', 'abandon') THEN CASE WHEN s_state IS NULL THEN 'NoSuchBucket' WHEN s_state = 'deleting' OR s_state = CASE op WHEN 'begin' THEN 'active' ELSE 'creating' END THEN 'Deleting' WHEN s_state = 'creating' THEN 'OperationAborted' WHEN s_state = 'active' THEN 'Conflict' ELSE 'NoSuchBucket' END
        WHEN op = 'version' AND versioning = 'unversioned' THEN 'Invalid'
        WHEN op IN ('version', 'lock') THEN CASE WHEN s_state IS NULL OR s_made <> incarnation OR s_state IN ('creating', 'deleted') THEN 'NoSuchBucket' WHEN s_state = 'deleting' THEN 'OperationAborted' WHEN op = 'lock' THEN CASE WHEN s_versioning <> 'enabled' THEN 'VersioningNotEnabled' ELSE 'LockConfigured' END WHEN s_lock AND versioning <> 'enabled' THEN 'VersioningLocked' ELSE 'Versioned' END
        WHEN op = 'forget' THEN CASE WHEN s_state IS NULL THEN 'Forgotten' WHEN s_state <> 'deleted' OR s_attempt <> attempt THEN 'Conflict' ELSE 'Forgotten' END
        WHEN s_state IS NULL OR s_attempt <> attempt THEN 'Conflict' WHEN op = 'progress' THEN CASE WHEN s_state = 'active' THEN 'Conflict' ELSE 'Progressed' END
        WHEN op = 'activate' THEN CASE WHEN s_state IN ('creating', 'active') THEN 'Activated' ELSE 'Conflict' END WHEN op = 'restore' THEN CASE WHEN s_state IN ('deleting', 'active') THEN 'Restored' ELSE 'Conflict' END ELSE CASE WHEN s_state IN ('deleting', 'deleted') THEN 'Deleted' ELSE 'Conflict' END END""",
    {
        "state": "CASE outcome WHEN 'Creating' THEN 'creating' WHEN 'Deleting' THEN 'deleting' WHEN 'Activated' THEN 'active' WHEN 'Restored' THEN 'active' WHEN 'Deleted' THEN 'deleted' WHEN 'Forgotten' THEN NULL ELSE s_state END",
        "owner": "CASE WHEN outcome = 'Creating' AND s_state IS NULL THEN owner ELSE s_owner END",
        "made": "CASE WHEN outcome = 'Creating' AND s_state IS NULL THEN moment ELSE s_made END",
        "lock": "CASE WHEN outcome = 'Creating' AND s_state IS NULL THEN locks WHEN outcome = 'LockConfigured' THEN true ELSE s_lock END",
        "versioning": "CASE WHEN outcome = 'Creating' AND s_state IS NULL THEN CASE WHEN locks THEN 'enabled' ELSE 'unversioned' END WHEN outcome = 'Versioned' THEN versioning ELSE s_versioning END",
        "attempt": "CASE WHEN outcome IN ('Creating', 'Deleting') THEN moment ELSE s_attempt END",
    },
).replace("SELECT bucket_, seq, outcome FROM run", "SELECT bucket_ AS bucket, seq, outcome FROM run")

_LOW = "'k' || lpad(CAST(range_ AS VARCHAR), 5, '0')"

RANGES = _run(
    f"""SELECT *, CASE WHEN op = 'freeze' AND seq % 5 <> 0 THEN {_LOW} ELSE {_LOW} || '~~' END AS into_high FROM (SELECT user_id AS range_, seq, {PLACE} AS i,
        CASE WHEN kind = 'view' THEN 'split' WHEN kind = 'click' THEN CASE WHEN seq % 3 = 0 THEN 'abandon' ELSE 'merge' END WHEN kind = 'purchase' THEN CASE WHEN seq % 2 = 0 THEN 'freeze' ELSE 'resolve' END WHEN seq % 3 = 0 THEN 'end' ELSE 'thaw' END AS op,
        {PLACE} // 3 + 1 AS generation, {_LOW.replace("range_", "user_id")} || CASE WHEN seq % 4 = 0 THEN '~' ELSE '/' || lpad(CAST(100 - {PLACE} // 2 AS VARCHAR), 3, '0') END AS at_key, user_id + 1 AS into_, seq % 2 + 1 AS into_generation, seq % 7 <> 0 AS fits FROM version_log)""",
    "range_",
    {"low": f"{_LOW} VARCHAR", "high": f"{_LOW} || '~' VARCHAR", "generation": "1 BIGINT", "standing": "'serving' VARCHAR", "into": "NULL BIGINT", "into_generation": "NULL BIGINT", "taken": "NULL BIGINT", "taken_generation": "NULL BIGINT"},
    """CASE WHEN op = 'thaw' AND s_standing = 'frozen' THEN CASE WHEN s_into_generation = into_generation THEN 'Thawed' ELSE 'Conflict' END
        WHEN op = 'end' AND s_standing = 'ended' THEN CASE WHEN s_into = into_ THEN 'Ended' ELSE 'Conflict' END WHEN op = 'end' AND s_standing = 'frozen' THEN CASE WHEN s_into_generation = into_generation AND s_into = into_ THEN 'Ended' ELSE 'Conflict' END
        WHEN s_standing <> 'serving' THEN 'Moved' WHEN op IN ('thaw', 'end') THEN 'Conflict' WHEN op IN ('split', 'merge') AND generation <> s_generation THEN 'Moved'
        WHEN op = 'split' THEN CASE WHEN at_key <= s_low OR coalesce(at_key >= s_high, false) THEN 'Invalid' ELSE 'Split' END
        WHEN op = 'freeze' THEN CASE WHEN s_taken IS NOT NULL THEN 'Conflict' WHEN into_high <> s_low THEN 'Invalid' ELSE 'Frozen' END WHEN op = 'abandon' THEN 'Refused' WHEN op = 'resolve' THEN 'Resolved'
        WHEN s_taken IS NOT NULL OR s_high IS NULL OR s_high <> at_key OR NOT fits THEN 'Refused' ELSE 'Merged' END""",
    {
        "high": "CASE outcome WHEN 'Split' THEN at_key WHEN 'Merged' THEN into_high ELSE s_high END",
        "generation": "CASE WHEN outcome IN ('Thawed', 'Split', 'Frozen', 'Refused') THEN s_generation + 1 WHEN outcome = 'Merged' THEN greatest(s_generation, into_generation) + 1 ELSE s_generation END",
        "standing": "CASE outcome WHEN 'Thawed' THEN 'serving' WHEN 'Ended' THEN 'ended' WHEN 'Frozen' THEN 'frozen' ELSE s_standing END",
        "into": "CASE outcome WHEN 'Thawed' THEN NULL WHEN 'Frozen' THEN into_ ELSE s_into END",
        "into_generation": "CASE outcome WHEN 'Thawed' THEN NULL WHEN 'Frozen' THEN into_generation ELSE s_into_generation END",
        "taken": "CASE WHEN outcome = 'Merged' THEN into_ WHEN outcome = 'Resolved' AND s_taken = into_ AND s_taken_generation = into_generation THEN NULL ELSE s_taken END",
        "taken_generation": "CASE WHEN outcome = 'Merged' THEN generation ELSE s_taken_generation END",
    },
).replace("SELECT range_, seq, outcome FROM run", 'SELECT range_ AS "range", seq, outcome FROM run')

_VERSION = "STRUCT(seq BIGINT, nul BOOLEAN, marker BOOLEAN, etag VARCHAR, until BIGINT, lock VARCHAR, hold BOOLEAN)"


def _kept(version: str, bypass: str) -> str:
    """Whether a version may not be removed."""
    return f"coalesce({version}.hold OR ({version}.until > moment AND ({version}.lock = 'COMPLIANCE' OR NOT {bypass})), false)"


_REFUSED = f"""CASE WHEN mode <> 'enabled' AND {_kept("null_version", "false")} THEN 'Locked' WHEN live AND if_none_match IS NOT NULL THEN 'PreconditionFailed' WHEN if_match IS NOT NULL AND NOT live THEN 'NoSuchKey' WHEN if_match IS NOT NULL AND if_match <> '*' AND if_match <> current.etag THEN 'PreconditionFailed' END"""
_REMOVED = "CASE WHEN named IS NOT NULL THEN target WHEN mode <> 'enabled' THEN null_version END"
_ADDED = "list_append(list_filter(s_versions, lambda x: mode = 'enabled' OR NOT x.nul), {{'seq': seq, 'nul': mode <> 'enabled', 'marker': {marker}, 'etag': {etag}, 'until': {until}, 'lock': {lock}, 'hold': false}})"
_CHANGED = "list_transform(s_versions, lambda x: CASE WHEN x.seq = target.seq THEN {{'seq': x.seq, 'nul': x.nul, 'marker': x.marker, 'etag': x.etag, 'until': {until}, 'lock': {lock}, 'hold': {hold}}} ELSE x END)"

NAMES = _run(
    f"""SELECT *, CASE op WHEN 'complete' THEN '1:p,2:p' WHEN 'part' THEN 'p' ELSE own END AS etag, CASE WHEN op = 'retain' OR (op = 'put' AND seq % 13 = 0) THEN moment + (seq % 9) * CAST({_HOUR} AS BIGINT) END AS until FROM (SELECT user_id AS k, seq, {PLACE} AS i, created AS moment,
        CASE WHEN kind = 'view' THEN 'put' WHEN kind IN ('click', 'error') THEN 'delete' WHEN kind = 'purchase' THEN CASE WHEN seq % 2 = 0 THEN 'retain' ELSE 'hold' END ELSE ['create', 'part', 'complete', 'abort'][seq % 4 + 1] END AS op, etag AS own,
        CASE WHEN bucket = 'b0' THEN 'unversioned' WHEN bucket = 'b1' OR (bucket = 'b2' AND seq < 5000) THEN 'enabled' ELSE 'suspended' END AS mode,
        CASE WHEN kind = 'error' THEN CASE seq % 3 WHEN 0 THEN 'null' WHEN 1 THEN CAST(lag(seq) OVER w AS VARCHAR) END END AS named, CASE WHEN kind = 'click' AND seq % 5 = 0 THEN lag(etag) OVER w WHEN kind = 'view' AND seq % 11 = 0 THEN '*' END AS if_match,
        CASE WHEN kind = 'view' AND seq % 7 = 0 THEN '*' END AS if_none_match, CASE WHEN seq % 3 = 0 THEN 'COMPLIANCE' ELSE 'GOVERNANCE' END AS lock, seq % 4 = 1 AS holds, seq % 6 = 0 AS bypass, seq % 2 + 1 AS part, size + CAST(seq % 2 = 0 AS BIGINT) * 5242880 AS bytes FROM version_log WINDOW w AS (PARTITION BY user_id ORDER BY seq))""",
    "k",
    {"versions": f"[] {_VERSION.replace(' ', '@')}[]", "open": "false BOOLEAN", "first": "NULL BIGINT", "second": "NULL BIGINT"},
    f"""CASE op WHEN 'put' THEN coalesce({_REFUSED}, 'Put')
        WHEN 'delete' THEN CASE WHEN if_match IS NOT NULL AND target IS NULL THEN 'NoSuchKey' WHEN if_match IS NOT NULL AND (target.marker OR (if_match <> '*' AND if_match <> target.etag)) THEN 'PreconditionFailed' WHEN {_kept("removed", "bypass")} THEN 'Locked'
            WHEN named IS NULL AND mode <> 'unversioned' THEN 'Marker' WHEN named IS NOT NULL AND coalesce(removed.marker, false) THEN 'DeletedMarker' ELSE 'Deleted' END
        WHEN 'create' THEN 'Created' WHEN 'part' THEN CASE WHEN s_open THEN 'PartWritten' ELSE 'NoSuchUpload' END WHEN 'abort' THEN CASE WHEN s_open THEN 'Aborted' ELSE 'NoSuchUpload' END
        WHEN 'complete' THEN CASE WHEN NOT s_open THEN 'NoSuchUpload' WHEN s_first IS NULL THEN 'InvalidPart' WHEN s_first < 5242880 THEN 'EntityTooSmall' WHEN s_second IS NULL THEN 'InvalidPart' ELSE coalesce({_REFUSED}, 'Completed') END
        ELSE CASE WHEN target IS NULL THEN CASE WHEN named IS NOT NULL THEN 'NoSuchVersion' ELSE 'NoSuchKey' END WHEN target.marker THEN 'DeleteMarker' WHEN op = 'hold' THEN 'Held'
            WHEN coalesce(target.until > moment, false) AND NOT (target.lock = lock AND until >= target.until) AND NOT (target.lock = 'GOVERNANCE' AND bypass) THEN 'Locked' ELSE 'Retained' END END""",
    {
        "versions": "CASE WHEN outcome IN ('Put', 'Completed') THEN " + _ADDED.format(marker="false", etag="etag", until="until", lock="CASE WHEN until IS NOT NULL THEN lock END")
        + " WHEN outcome = 'Marker' THEN " + _ADDED.format(marker="true", etag="''", until="NULL", lock="NULL")
        + " WHEN outcome IN ('Deleted', 'DeletedMarker') THEN list_filter(s_versions, lambda x: removed IS NULL OR x.seq <> removed.seq)"
        + " WHEN outcome = 'Retained' THEN " + _CHANGED.format(until="until", lock="lock", hold="x.hold") + " WHEN outcome = 'Held' THEN " + _CHANGED.format(until="x.until", lock="x.lock", hold="holds") + " ELSE s_versions END",
        "open": "CASE outcome WHEN 'Created' THEN true WHEN 'Aborted' THEN false WHEN 'Completed' THEN false ELSE s_open END",
        "first": "CASE WHEN outcome = 'Created' THEN NULL WHEN outcome = 'PartWritten' AND part = 1 THEN bytes ELSE s_first END",
        "second": "CASE WHEN outcome = 'Created' THEN NULL WHEN outcome = 'PartWritten' AND part = 2 THEN bytes ELSE s_second END",
    },
    found=f"""*, {_REMOVED} AS removed FROM (SELECT *, list_filter(s_versions, lambda x: x.nul)[1] AS null_version, s_versions[-1] AS current, len(s_versions) > 0 AND NOT coalesce(s_versions[-1].marker, true) AS live,
        CASE WHEN named IS NULL THEN s_versions[-1] WHEN named = 'null' THEN list_filter(s_versions, lambda x: x.nul)[1] ELSE list_filter(s_versions, lambda x: CAST(x.seq AS VARCHAR) = named)[1] END AS target""",
).replace("SELECT k, seq, outcome FROM run", "SELECT 'b' || (k % 4) AS bucket, (k % 10) || '/' || k AS key, seq, outcome FROM run").replace("@", " ")
# a state's columns are found in a query of their own, which closes here
NAMES = NAMES.replace("c.i = r.i + 1))))", "c.i = r.i + 1)))))")
