"""The command machines: outcomes of short histories, and the stream against the batch."""

import pytest
from pyspark.sql import functions as F

from cairn.plans import machines as plans
from cairn.sources.views import Lake
from cairn.streaming import machines

FOLDER = "/root/testdata/sf0.001"


def run(machine, commands):
    state = {}
    return [machine(state, {"seq": i, "at": 100 * i, **c}) for i, c in enumerate(commands)], state


def put(**c):
    return {"op": "put", "mode": "enabled", "etag": "e"} | c


def delete(**c):
    return {"op": "delete", "mode": "enabled"} | c


def test_writes_and_preconditions():
    got, state = run(machines.name_machine, [put(if_match="e"), put(), put(if_none_match="*"), put(if_match="x"), put(if_match="x,e", etag="f"), delete(), put(if_match="*"), put(if_none_match="*")])
    assert got == ["NoSuchKey", "Put", "PreconditionFailed", "PreconditionFailed", "Put", "Marker", "NoSuchKey", "Put"]
    assert [(v["etag"], v["marker"]) for v in state["versions"]] == [("e", False), ("f", False), ("", True), ("e", False)]


def test_versioning_modes():
    got, state = run(machines.name_machine, [put(mode="unversioned"), put(mode="unversioned", etag="f"), put(etag="g"), put(mode="suspended", etag="h"), delete(mode="suspended"), delete(mode="unversioned"), delete(named="2"), delete(named="9"), delete(named="null")])
    assert got == ["Put", "Put", "Put", "Put", "Marker", "Deleted", "Deleted", "Deleted", "Deleted"] and state["versions"] == []
    got, _ = run(machines.name_machine, [put(mode="suspended"), delete(mode="suspended"), delete(named="null"), delete(named="null", if_match="*"), put(), delete(named="4", if_match="x"), delete(named="4", if_match="e")])
    assert got == ["Put", "Marker", "DeletedMarker", "NoSuchKey", "Put", "PreconditionFailed", "Deleted"]


def test_locks():
    retain = lambda until, lock, **c: {"op": "retain", "until": until, "lock": lock} | c
    got, _ = run(machines.name_machine, [retain(1, "GOVERNANCE"), put(), retain(10_000, "GOVERNANCE"), delete(named="1"), retain(9_000, "GOVERNANCE"), retain(9_000, "GOVERNANCE", bypass=True), retain(9_500, "COMPLIANCE", bypass=True), retain(9_400, "COMPLIANCE", bypass=True), delete(named="1", bypass=True), delete(), {"op": "hold", "hold": True}, {"op": "hold", "hold": True, "named": "5"}])
    assert got == ["NoSuchKey", "Put", "Retained", "Locked", "Locked", "Retained", "Retained", "Locked", "Locked", "Marker", "DeleteMarker", "NoSuchVersion"]
    got, _ = run(machines.name_machine, [put(mode="suspended"), {"op": "hold", "hold": True}, put(mode="suspended"), delete(mode="suspended", bypass=True), {"op": "hold", "hold": False}, put(mode="suspended")])
    assert got == ["Put", "Held", "Locked", "Locked", "Held", "Put"]
    got, _ = run(machines.name_machine, [put(until=250, lock="COMPLIANCE"), delete(named="0"), delete(named="0", bypass=True), delete(named="0")])
    assert got == ["Put", "Locked", "Locked", "Deleted"]  # its time has passed


def test_uploads():
    part = lambda n, size=machines.LEAST_PART, etag="p": {"op": "part", "upload": 7, "part": n, "size": size, "etag": etag}
    complete = lambda parts: {"op": "complete", "upload": 7, "etag": parts, "mode": "enabled"}
    create, abort = {"op": "create", "upload": 7}, {"op": "abort", "upload": 7}
    got, state = run(machines.name_machine, [part(1), create, part(0), part(1, 5), part(2), complete(""), complete("2:p,1:p"), complete("2:p,3:p"), complete("1:x,2:p"), complete("1:p,2:p"), part(1), complete("1:p,2:p"), complete("1:p,2:p"), abort, create, abort])
    assert got == ["NoSuchUpload", "Created", "Invalid", "PartWritten", "PartWritten", "InvalidPartOrder", "InvalidPartOrder", "InvalidPart", "InvalidPart", "EntityTooSmall", "PartWritten", "Completed", "NoSuchUpload", "NoSuchUpload", "Created", "Aborted"]
    assert len(state["versions"]) == 1 and not state["uploads"]


def test_blocks():
    write = lambda **c: {"op": "write", "chunks": "1,2,3", "file": 1, "handover": 50} | c
    move = lambda index, a, b: {"op": "move", "index": index, "source": a, "target": b}
    got, _ = run(machines.block_machine, [move(0, 1, 4), write(chunks="1,1"), write(), write(), write(file=2), move(0, 1, 2), move(0, 1, 4), move(0, 1, 4), move(3, 1, 5), {"op": "renew", "file": 2, "handover": 0}, {"op": "release", "deadline": 0}, {"op": "renew", "file": 1, "handover": 7}, {"op": "release", "deadline": 1107}, {"op": "renew", "file": 1, "handover": 7}, move(0, 4, 6), {"op": "delete"}, {"op": "delete"}, {"op": "release", "deadline": 0}])
    assert got == ["NoSuchBlock", "Invalid", "Written", "Written", "Conflict", "Conflict", "Moved", "Moved", "Invalid", "Conflict", "Written", "Written", "Released", "Expired", "Expired", "Deleted", "Deleted", "NoSuchBlock"]
    got, _ = run(machines.block_machine, [write(), {"op": "settle"}, {"op": "release", "deadline": 50}, {"op": "renew", "file": 1, "handover": 900}, {"op": "settle"}])
    assert got == ["Written", "Settled", "Written", "Written", "Settled"]


def test_buckets():
    create = lambda **c: {"op": "create", "owner": "me", "lock": False, "owned": 0, "quota": 2} | c
    step = lambda op, attempt: {"op": op, "attempt": attempt}
    version = lambda v, made: {"op": "version", "versioning": v, "incarnation": made}
    got, _ = run(machines.bucket_machine, [create(owned=2), create(), create(), create(owner="you"), step("activate", 100), step("activate", 200), create(), create(owner="you"), {"op": "lock", "incarnation": 100}, version("enabled", 100), {"op": "lock", "incarnation": 100}, version("suspended", 100), version("unversioned", 100), version("enabled", 7), {"op": "abandon"}, {"op": "begin"}, version("enabled", 100), step("progress", 1500), step("restore", 1500), step("progress", 1500), {"op": "begin"}, step("delete", 2000), create(), step("forget", 1), step("forget", 2000), step("forget", 2000), {"op": "begin"}])
    assert got == ["TooManyBuckets", "Creating", "Creating", "OperationAborted", "Conflict", "Activated", "AlreadyOwnedByYou", "AlreadyExists", "VersioningNotEnabled", "Versioned", "LockConfigured", "VersioningLocked", "Invalid", "NoSuchBucket", "Conflict", "Deleting", "OperationAborted", "Progressed", "Restored", "Conflict", "Deleting", "Deleted", "OperationAborted", "Conflict", "Forgotten", "Forgotten", "NoSuchBucket"]


@pytest.mark.parametrize(("log", "keys", "machine"), [(plans.name_log, ["bucket", "key"], machines.name_machine), (plans.block_log, ["block"], machines.block_machine), (plans.bucket_log, ["bucket"], machines.bucket_machine), (plans.range_log, ["range"], machines.range_machine), (plans.gate_log, ["gate"], machines.gate_machine), (plans.session_log, ["session"], machines.session_machine)])
def test_stream_agrees(spark, tmp_path, log, keys, machine):
    rows = log(Lake(spark, FOLDER))
    want = sorted(map(tuple, machines.fold(rows, keys, machine).collect()))
    assert len({o for *_, o in want}) > 3
    # three micro-batches in the log's order
    ordered = rows.orderBy("seq").collect()
    third = len(ordered) // 3 + 1
    for i in range(3):
        spark.createDataFrame(ordered[i * third : (i + 1) * third], rows.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    files = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    stream = machines.fold_stream(files, keys, machine)
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(*keys, "seq", "outcome").collect()))
    assert got == want


def test_replay_of_plain_commands_agrees_with_the_closed_form(spark):
    """Where a log holds writes and unnamed deletes alone, the machine's versions are those of the grouped replay."""
    from cairn.plans.replay import mode
    from cairn.streaming import replay

    log = Lake(spark, FOLDER).version_log()
    commands = log.select("bucket", "key", "seq", F.col("created").alias("at"), F.when(F.col("marker"), "delete").otherwise("put").alias("op"), mode().alias("mode"), "etag")
    want = {(r["bucket"], r["key"]): r["versions"] for r in replay.replay(log, mode()).collect()}
    states = {}
    for c in sorted((r.asDict() for r in commands.collect()), key=lambda c: c["seq"]):
        machines.name_machine(states.setdefault((c["bucket"], c["key"]), {}), c)
    assert {k: len(s["versions"]) for k, s in states.items()} == want


def test_ranges():
    base = {"low": "b", "high": "m", "generation": 1, "at_key": None, "into": 9, "into_high": "b", "into_generation": 4, "fits": True}
    c = lambda op, **more: base | {"op": op} | more
    got, state = run(machines.range_machine, [c("thaw"), c("split", at_key="b"), c("split", at_key="z"), c("split", at_key="f"), c("split", at_key="d"), c("split", at_key="d", generation=2), c("merge", generation=3, at_key="x"), c("merge", generation=4, at_key="d", into_high="f", into_generation=7), c("freeze"), c("resolve", into_generation=1), c("resolve", into_generation=4), c("freeze", into_high="c"), c("freeze"), c("split", at_key="c", generation=9), c("thaw", into_generation=1), c("thaw"), c("freeze"), c("end", into=8), c("end"), c("end"), c("thaw"), c("abandon")])
    assert got == ["Conflict", "Invalid", "Invalid", "Split", "Moved", "Split", "Refused", "Merged", "Conflict", "Resolved", "Resolved", "Invalid", "Frozen", "Moved", "Conflict", "Thawed", "Frozen", "Conflict", "Ended", "Ended", "Moved", "Moved"]
    assert (state["low"], state["high"], state["standing"], state["generation"]) == ("b", "f", "ended", 11)


def test_gates():
    move = lambda before, to, attempt, incarnation=1, rows=False: {"before": before, "to": to, "attempt": attempt, "incarnation": incarnation, "holds_rows": rows}
    got, state = run(machines.gate_machine, [move("open", "closed", 1), move(None, "open", 1), move(None, "open", 1), move("open", "condemned", 1), move("open", "closed", 2, 7), move("open", "closed", 2), move("closed", "open", 1), move("closed", "condemned", 3), move("condemned", None, 3, rows=True), move("condemned", None, 3), move("closed", "condemned", 2), move(None, "open", 2), move(None, "closed", 4, 2)])
    assert got == ["Conflict", "GateMoved", "GateMoved", "Invalid", "Conflict", "GateMoved", "Conflict", "GateMoved", "NotEmpty", "GateMoved", "GateMoved", "Conflict", "GateMoved"]
    assert state["floor"] == 3 and state["gate"] == ["closed", 2, 4]


def test_sessions():
    use = lambda serial, unanswered=0: {"op": "command", "serial": serial, "unanswered": unanswered}
    got, _ = run(machines.session_machine, [use(0), {"op": "register"}, use(0), use(0), use(2), use(1, 2), use(1), use(2), use(machines.LAST_SERIAL), {"op": "expire"}, use(5)])
    assert got == ["Unknown", "Registered", "New", "Answered", "New", "New", "Repeated", "Answered", "Spent", "Expired", "Unknown"]
    got, _ = run(machines.session_machine, [{"op": "register"}, *(use(i) for i in range(machines.MOST_ANSWERS + 2))])
    assert got[-2:] == ["New", "Unknown"]  # too many answers that nobody acknowledged
