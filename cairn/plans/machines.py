"""Queries that answer logs of commands by the layers' machines, and the sums and pages beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.sources.views import Lake
from cairn.streaming import machines

from . import machine_sql
from .registry import query
from .replay import mode
from .sql import over

HOUR = 3_600_000_000


def name_log(lake: Lake) -> DataFrame:
    """Commands on keys, drawn from the log: writes with and without preconditions, removals of the current, the null and a named version, locks, uploads."""
    log = lake.version_log()
    w = Window.partitionBy("bucket", "key").orderBy("seq")
    k, kind = F.col("seq"), F.col("kind")
    before = F.lag("seq").over(w)
    of_upload = F.when(k % 4 == 0, "create").when(k % 4 == 1, "part").when(k % 4 == 2, "complete").otherwise("abort")
    op = F.when(kind == "view", "put").when(kind.isin("click", "error"), "delete").when(kind == "purchase", F.when(k % 2 == 0, "retain").otherwise("hold")).otherwise(of_upload)
    part = F.lit(1) + k % 2
    etag = F.when(op == "complete", F.lit("1:p,2:p")).when(op == "part", F.lit("p")).otherwise(F.col("etag"))
    return log.select(
        "bucket", "key", "seq", F.col("created").alias("at"), op.alias("op"), mode().alias("mode"), etag.alias("etag"),
        F.when(kind == "error", F.when(k % 3 == 0, "null").when(k % 3 == 1, before.cast("string"))).alias("named"),
        F.when((kind == "click") & (k % 5 == 0), F.lag("etag").over(w)).when((kind == "view") & (k % 11 == 0), F.lit("*")).alias("if_match"),
        F.when((kind == "view") & (k % 7 == 0), F.lit("*")).alias("if_none_match"),
        F.when((op == "retain") | ((op == "put") & (k % 13 == 0)), F.col("created") + (k % 9) * HOUR).alias("until"),
        F.when(k % 3 == 0, "COMPLIANCE").otherwise("GOVERNANCE").alias("lock"),
        (k % 4 == 1).alias("hold"), (k % 6 == 0).alias("bypass"), (F.col("user_id") % 2).alias("upload"), part.alias("part"), (F.col("size") + (part == 1).cast("long") * machines.LEAST_PART).alias("size"),
    )


@query("name_commands", machine_sql.NAMES)
def name_commands(lake: Lake) -> DataFrame:
    """The outcome of every command on a key."""
    return machines.fold(name_log(lake), ["bucket", "key"], machines.name_machine)


def block_log(lake: Lake) -> DataFrame:
    """Commands on blocks: a block is a user's, its chunks lie on three volumes."""
    log, k = lake.version_log(), F.col("seq")
    op = F.when(F.col("kind") == "view", "write").when(F.col("kind") == "click", "renew").when(F.col("kind") == "purchase", "move").when(k % 4 == 0, "release").when(k % 4 == 1, "settle").when(k % 20 == 2, "delete").otherwise("release")
    w = Window.partitionBy("user_id").orderBy("seq")
    chunks = F.when(k % 17 == 0, F.lit("1,1,2")).otherwise(F.lit("1,2,3"))
    # the deadline that the last write or renewal set, as a sweep would have read it
    set_ = F.last(F.when(op.isin("write", "renew"), F.col("created") + HOUR), ignorenulls=True).over(w)
    return log.select(F.col("user_id").alias("block"), "seq", F.col("created").alias("at"), op.alias("op"), chunks.alias("chunks"), (k % 19 != 0).cast("long").alias("file"), F.lit(HOUR).alias("handover"), F.coalesce(set_, F.lit(0)).alias("deadline"), (k % 4).alias("index"), (k % 3 + 1).alias("source"), (k % 6 + 1).alias("target"))


@query("block_commands", machine_sql.BLOCKS)
def block_commands(lake: Lake) -> DataFrame:
    """The outcome of every command on a block."""
    return machines.fold(block_log(lake), ["block"], machines.block_machine)


def bucket_log(lake: Lake) -> DataFrame:
    """Commands on buckets: a bucket is a user's; attempts and incarnations are those that its last create or delete began."""
    log, k = lake.version_log(), F.col("seq")
    step = F.when(k % 4 == 0, "activate").when(k % 4 == 1, "delete").when(k % 4 == 2, "forget").otherwise("progress")
    op = F.when(F.col("kind") == "view", "create").when(F.col("kind") == "click", step).when(F.col("kind") == "purchase", F.when(k % 2 == 0, "version").otherwise("lock")).when(F.col("kind") == "signup", "begin").when(k % 2 == 0, "abandon").otherwise("restore")
    w = Window.partitionBy("user_id").orderBy("seq")
    began = F.coalesce(F.last(F.when(op.isin("create", "begin", "abandon"), F.col("created")), ignorenulls=True).over(w), F.lit(0))
    made = F.coalesce(F.first(F.when(op == "create", F.col("created")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return log.select(F.col("user_id").alias("bucket"), "seq", F.col("created").alias("at"), op.alias("op"), F.when(k % 5 == 0, "other").otherwise("me").alias("owner"), (F.col("user_id") % 3 == 0).alias("lock"), (F.col("user_id") % 29).alias("owned"), F.lit(28).alias("quota"), began.alias("attempt"), made.alias("incarnation"), F.when(k % 3 == 0, "enabled").when(k % 3 == 1, "suspended").otherwise("unversioned").alias("versioning"))


@query("bucket_commands", machine_sql.BUCKETS)
def bucket_commands(lake: Lake) -> DataFrame:
    """The outcome of every command on a bucket."""
    return machines.fold(bucket_log(lake), ["bucket"], machines.bucket_machine)


def range_log(lake: Lake) -> DataFrame:
    """Commands on ranges: a range is a user's, from the user's key on; generations and merges are those that a driver would have read a little before."""
    log, k = lake.version_log(), F.col("seq")
    op = F.when(F.col("kind") == "view", "split").when(F.col("kind") == "click", F.when(k % 3 == 0, "abandon").otherwise("merge")).when(F.col("kind") == "purchase", F.when(k % 2 == 0, "freeze").otherwise("resolve")).when(k % 3 == 0, "end").otherwise("thaw")
    w = Window.partitionBy("user_id").orderBy("seq")
    place = F.row_number().over(w)
    low = F.concat(F.lit("k"), F.lpad(F.col("user_id").cast("string"), 5, "0"))
    return log.select(
        F.col("user_id").alias("range"), "seq", op.alias("op"), low.alias("low"), F.concat(low, F.lit("~")).alias("high"), (F.floor(place / 3) + 1).alias("generation"),
        F.when(k % 4 == 0, F.concat(low, F.lit("~"))).otherwise(F.concat(low, F.lit("/"), F.lpad((100 - F.floor(place / 2)).cast("string"), 3, "0"))).alias("at_key"),
        (F.col("user_id") + 1).alias("into"), F.when((op == "freeze") & (k % 5 != 0), low).otherwise(F.concat(low, F.lit("~~"))).alias("into_high"), (k % 2 + 1).alias("into_generation"), (k % 7 != 0).alias("fits"),
    )


@query("range_commands", machine_sql.RANGES)
def range_commands(lake: Lake) -> DataFrame:
    """The outcome of every split, freeze and merge of a range."""
    return machines.fold(range_log(lake), ["range"], machines.range_machine)


def gate_log(lake: Lake) -> DataFrame:
    """Moves of gates: a gate is a user's, opened, closed, condemned and dropped by attempts that count up."""
    log, k = lake.version_log(), F.col("seq")
    pairs = [(None, "open"), ("open", "closed"), ("closed", "condemned"), ("condemned", None), ("closed", "open"), (None, "closed"), ("closed", "closed"), ("open", "condemned")]
    pick = lambda side: F.get(F.array(*[F.lit(p[side]).cast("string") for p in pairs]), F.col("step").cast("int"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("seq"))
    stepped = log.select("user_id", "seq", F.when(k % 7 == 0, k % 8).otherwise(place % 4).alias("step"), place.alias("place"))
    return stepped.select(F.col("user_id").alias("gate"), "seq", pick(0).alias("before"), pick(1).alias("to"), F.floor(F.col("place") / 4).alias("attempt"), F.floor(F.col("place") / 16).alias("incarnation"), (k % 9 == 0).alias("holds_rows"))


@query("gate_commands", machine_sql.GATES)
def gate_commands(lake: Lake) -> DataFrame:
    """The outcome of every move of a gate."""
    return machines.fold(gate_log(lake), ["gate"], machines.gate_machine)


def session_log(lake: Lake) -> DataFrame:
    """Commands of sessions: a session is a user's; some come again, some acknowledge what came before."""
    log, k = lake.version_log(), F.col("seq")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("seq"))
    op = F.when((place == 1) | (k % 37 == 0), "register").when(k % 41 == 0, "expire").otherwise("command")
    serial = F.when(k % 53 == 0, F.lit(machines.LAST_SERIAL)).when(k % 3 == 0, place - 1).when(k % 11 == 0, place - 6).otherwise(place)
    return log.select(F.col("user_id").alias("session"), "seq", F.col("created").alias("at"), op.alias("op"), serial.cast("long").alias("serial"), F.when(k % 5 == 0, F.lit(0)).otherwise(place - 3).cast("long").alias("unanswered"))


@query("session_commands", machine_sql.SESSIONS)
def session_commands(lake: Lake) -> DataFrame:
    """What each session says of every command."""
    return machines.fold(session_log(lake), ["session"], machines.session_machine)


@query("root_enlistments", over("volumes", "e AS (SELECT volume, node, domain, CASE WHEN volume % 10 = 7 THEN 'elsewhere' ELSE domain END AS stated FROM volumes)", body="SELECT volume, node, CASE WHEN length(stated) > 255 OR stated <> domain THEN 'Conflict' WHEN dense_rank() OVER (ORDER BY node) > 20 THEN 'Full' ELSE 'Enlisted' END AS outcome FROM e"))
def root_enlistments(lake: Lake) -> DataFrame:
    """Nodes that state their domain and volumes: one that the table holds otherwise conflicts, more nodes than the cell states don't fit."""
    v = lake.volumes()
    stated = F.when(F.col("volume") % 10 == 7, "elsewhere").otherwise(F.col("domain"))
    # the nodes are a fixed table's: their places are few rows beside the volumes
    nodes = v.select("node").distinct().withColumn("nth", F.dense_rank().over(Window.orderBy("node")))
    outcome = F.when((F.length(stated) > 255) | (stated != F.col("domain")), "Conflict").when(F.col("nth") > 20, "Full").otherwise("Enlisted")
    return v.join(nodes, "node").select("volume", "node", outcome.alias("outcome"))


@query("node_histories", over("version_log", "h AS (SELECT user_id % 25 AS node, seq, size AS exposure, seq % 7 AS crashes FROM version_log)", "k AS (SELECT node, max(exposure) AS exposure, max(crashes) AS crashes FROM h WHERE node < 20 GROUP BY 1)", body="SELECT node, exposure, crashes, CAST(sum(exposure) OVER () AS BIGINT) AS all_exposure, CAST(sum(crashes) OVER () AS BIGINT) AS all_crashes FROM k"))
def node_histories(lake: Lake) -> DataFrame:
    """What is kept of each enlisted node's history, the greater of all that it states; and the cell's sums."""
    log = lake.version_log().select((F.col("user_id") % 25).alias("node"), F.col("size").alias("exposure"), (F.col("seq") % 7).alias("crashes"))
    kept = log.where("node < 20").groupBy("node").agg(F.max("exposure").alias("exposure"), F.max("crashes").alias("crashes"))
    sums = kept.agg(F.sum("exposure").alias("all_exposure"), F.sum("crashes").alias("all_crashes"))
    return kept.crossJoin(F.broadcast(sums)).select("node", "exposure", "crashes", "all_exposure", "all_crashes")


@query("generator_merge", over("version_log", "g AS (SELECT user_id % 8 AS driver, sum(seq) AS cpu, max(greatest(size, 0)) AS worst, count(*) AS n FROM version_log GROUP BY 1)", body="SELECT CAST(sum(cpu) AS BIGINT) AS cpu, CAST(sum(n) AS BIGINT) AS operations, max(worst) AS worst FROM g"))
def generator_merge(lake: Lake) -> DataFrame:
    """Drivers' CPU time summed and their lateness histograms merged."""
    from cairn.operators import stats

    log = lake.version_log().select((F.col("user_id") % 8).alias("driver"), "seq", F.greatest("size", F.lit(0).cast("long")).alias("late"))
    cpu = log.groupBy("driver").agg(F.sum("seq").alias("cpu")).agg(F.sum("cpu").alias("cpu"))
    merged = stats.histogram(log, F.col("late"), ["driver"]).groupBy("bucket").agg(F.sum("n").alias("n"), F.max("most").alias("most"))
    return cpu.crossJoin(F.broadcast(merged.agg(F.sum("n").alias("operations"), F.max("most").alias("worst"))))


NOW, PATIENCE = 1_704_500_000_000_000, 6 * HOUR
ATTEMPTS = "a AS (SELECT user_id AS bucket, max(created) AS progress, CASE user_id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'creating' WHEN 2 THEN 'deleting' ELSE 'deleted' END AS state FROM version_log GROUP BY user_id)"


def attempts(lake: Lake) -> DataFrame:
    k = F.col("user_id") % 4
    state = F.when(k == 0, "active").when(k == 1, "creating").when(k == 2, "deleting").otherwise("deleted")
    return lake.version_log().groupBy(F.col("user_id").alias("bucket"), state.alias("state")).agg(F.max("created").alias("progress"))


@query("attempt_takeovers", over("version_log", ATTEMPTS, body=f"SELECT bucket, CASE WHEN state <> 'active' AND greatest({NOW} - progress, 0) >= {PATIENCE} THEN CASE state WHEN 'creating' THEN 'Abandon' WHEN 'deleting' THEN 'Delete' ELSE 'Resume' END END AS action, CASE WHEN state <> 'active' THEN progress + {PATIENCE} END AS deadline FROM a"))
def attempt_takeovers(lake: Lake) -> DataFrame:
    """What the collector does with a bucket whose attempt has shown no progress within its patience."""
    state = F.col("state")
    idle = F.greatest(F.lit(NOW) - F.col("progress"), F.lit(0)) >= PATIENCE
    action = F.when(idle, F.when(state == "creating", "Abandon").when(state == "deleting", "Delete").when(state == "deleted", "Resume"))
    return attempts(lake).select("bucket", action.alias("action"), F.when(state != "active", F.col("progress") + PATIENCE).alias("deadline"))


@query("stalled_attempts", over("version_log", ATTEMPTS, body="SELECT bucket, state, progress FROM a WHERE state <> 'active' AND bucket > 10 ORDER BY bucket LIMIT 12"))
def stalled_attempts(lake: Lake) -> DataFrame:
    """A page of the buckets whose attempts are under way, after a marker."""
    return attempts(lake).where("state <> 'active' and bucket > 10").orderBy("bucket").limit(12).select("bucket", "state", "progress")


@query("unsettled_blocks", over("files", "b AS (SELECT l_partkey AS block, min(made) AS deadline FROM lineitem JOIN files ON file = l_orderkey WHERE status = 'P' GROUP BY 1)", body="SELECT block, deadline FROM b WHERE deadline < 850000000000000 ORDER BY deadline, block LIMIT 40"))
def unsettled_blocks(lake: Lake) -> DataFrame:
    """The blocks whose handover deadline has passed and that no sweep has settled, soonest first."""
    held = lake.table("lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("block")).join(lake.files().where("status = 'P'").select("file", "made"), "file")
    return held.groupBy("block").agg(F.min("made").alias("deadline")).where("deadline < 850000000000000").orderBy("deadline", "block").limit(40)


@query("retention_ahead", over("version_log", body=f"SELECT seq, CASE WHEN created + (seq % 20 - 5) * CAST(86400000000 AS BIGINT) <= {NOW} THEN 'Past' END AS fault FROM version_log"))
def retention_ahead(lake: Lake) -> DataFrame:
    """A retention that is set must end after now."""
    until = F.col("created") + (F.col("seq") % 20 - 5) * 24 * HOUR
    return lake.version_log().select("seq", F.when(until <= NOW, "Past").alias("fault"))


@query("gate_writes", over("version_log", "g AS (SELECT DISTINCT bucket, CASE WHEN bucket = 'b3' THEN 'closed' ELSE 'open' END AS gate, 1 AS incarnation FROM version_log)", body="SELECT v.seq, coalesce(g.gate = 'open' AND g.incarnation = CASE WHEN v.seq % 10 = 0 THEN 0 ELSE 1 END, false) AS admitted FROM version_log v LEFT JOIN g ON g.bucket = v.bucket AND v.user_id % 17 <> 0"))
def gate_writes(lake: Lake) -> DataFrame:
    """Writes are admitted by an open gate of their bucket and of the incarnation that they name; without a gate they aren't."""
    log = lake.version_log()
    gates = log.select("bucket").distinct().select(F.col("bucket").alias("g"), F.when(F.col("bucket") == "b3", "closed").otherwise("open").alias("gate"), F.lit(1).alias("incarnation"))
    met = log.join(gates, (F.col("g") == F.col("bucket")) & (F.col("user_id") % 17 != 0), "left")
    named = F.when(F.col("seq") % 10 == 0, 0).otherwise(1)
    return met.select("seq", F.coalesce((F.col("gate") == "open") & (F.col("incarnation") == named), F.lit(False)).alias("admitted"))
