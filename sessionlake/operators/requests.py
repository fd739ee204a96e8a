"""Request log and upload ledger."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions import text as T
from sessionlake.operators.search import clamp

DIMENSIONS = ("actor", "identity_kind", "mcp_name", "status_code", "error_code")


def list_requests(requests: DataFrame, before_id: int | None = None, limit: int | None = None, since: str | None = None, **equal) -> DataFrame:
    """A page of requests, newest id first: those before ``before_id`` that the filters fit."""
    for name, value in equal.items():
        requests = requests.where(F.col(name) == value) if value is not None else requests
    requests = requests.where(F.col("started_at") >= since) if since else requests
    requests = requests.where(F.col("id") < before_id) if before_id is not None else requests
    return requests.orderBy(F.desc("id")).limit(clamp(limit, 100, 500))


def request_counts(requests: DataFrame, since: str | None = None) -> DataFrame:
    """dimension, value and n: requests by actor, identity kind, operation, status and error; no value is ``unknown``."""
    requests = requests.where(F.col("started_at") >= since) if since else requests
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias("value")) for d in DIMENSIONS])
    counts = requests.groupBy(*DIMENSIONS).agg(F.count("*").alias("n"))  # one shuffle of few rows, whatever the log's size
    return counts.select(F.explode(pairs).alias("p"), "n").groupBy("p.dimension", "p.value").agg(F.sum("n").alias("n"))


def latency_quantiles(requests: DataFrame, fractions: dict[str, float] | None = None) -> DataFrame:
    """One row: the value at place floor((n - 1) f) of the sorted durations, to three digits, and the largest; null without requests.

    The log is read once: a checkpointed histogram in ranges of the duration tells the range of each place, and one pass over those ranges picks all of them.
    """
    fractions = fractions or {"p50": 0.5, "p95": 0.95}
    context = requests.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir"):
        context.setCheckpointDir(f"{requests.sparkSession.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints")
    values = requests.where("duration_ms is not null").groupBy("duration_ms").agg(F.count("*").alias("n"))
    histogram = values.repartitionByRange("duration_ms").withColumn("part", F.spark_partition_id()).checkpoint()
    rows = histogram.groupBy("part").agg(F.sum("n").alias("size"), F.max("duration_ms").alias("last")).orderBy("last").collect()  # one row for each shuffle partition
    total = sum(r["size"] for r in rows)
    if not total:
        return requests.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(k) for k in (*fractions, "max")])
    ends = list(accumulate(r["size"] for r in rows))
    places = {name: int((total - 1) * f) for name, f in fractions.items()}
    ranges = {name: next(i for i, end in enumerate(ends) if end > place) for name, place in places.items()}
    running = F.sum("n").over(Window.partitionBy("part").orderBy("duration_ms").rowsBetween(Window.unboundedPreceding, 0))
    inside = histogram.where(F.col("part").isin([rows[i]["part"] for i in set(ranges.values())])).withColumn("upto", running)

    def pick(name: str) -> Column:
        r = rows[ranges[name]]
        within = places[name] - (ends[ranges[name]] - r["size"])
        return F.round(F.min(F.when((F.col("part") == r["part"]) & (F.col("upto") > within), F.col("duration_ms"))), 3).alias(name)

    return inside.agg(*map(pick, fractions), F.round(F.lit(rows[-1]["last"]), 3).alias("max"))


def retain_latest(requests: DataFrame, n: int) -> DataFrame:
    """The newest n by id: a top-k of ids alone, then the range filter that it gives."""
    least = requests.select("id").orderBy(F.desc("id")).limit(n).agg(F.min("id").alias("least"))  # one row
    return requests.join(F.broadcast(least)).where("id >= least").drop("least")


def redacted_requests(requests: DataFrame) -> DataFrame:
    """Raw requests (with arguments_json, status_code and response_body) as they may be kept: no bodies, redacted arguments, an error code."""
    return (
        requests.withColumn("arguments_json", T.redact_arguments(F.col("mcp_name"), F.col("arguments_json")))
        .withColumn("error_code", T.classify_error(F.col("status_code"), F.col("response_body")))
        .drop("response_body", "request_body")
    )


# Uploads. Events (upload_id, event_no, event, owner, nbytes, at) fold to one row of state per upload.

#: Event, states from which it is legal, state that it leads to.
TRANSITIONS = {
    "receive": (("prepared",), "receiving"),
    "received": (("receiving",), "uploaded"),
    "receive_failed": (("receiving",), "prepared"),
    "commit": (("uploaded",), "queued"),
    "process": (("queued",), "processing"),
    "complete": (("processing",), "complete"),
    "fail": (("processing",), "failed"),
    "cancel": (("prepared", "uploaded", "queued", "failed"), "cancelled"),
    "prepare": ((None, "complete", "failed", "cancelled", "expired"), "prepared"),
    "expire": (("prepared", "uploaded", "failed", "cancelled"), "expired"),
}
PENDING = ("prepared", "receiving", "uploaded", "queued", "processing", "failed")
UNDER_WAY = ("prepared", "receiving", "uploaded", "queued", "processing")
ABANDONED = ("prepared", "receiving", "uploaded", "failed")
STATE = "upload_id string, owner string, status string, nbytes long, updated_at double, rejected int"


def step(state: dict | None, event: dict) -> dict:
    """The state after one event; an illegal one only counts as rejected."""
    now = state or {"upload_id": event["upload_id"], "owner": event["owner"], "status": None, "nbytes": event["nbytes"], "updated_at": event["at"], "rejected": 0}
    legal, status = TRANSITIONS.get(event["event"], ((), None))
    if now["status"] not in legal:
        return now | {"rejected": now["rejected"] + 1}
    return now | {"status": status, "updated_at": event["at"]} | ({"nbytes": event["nbytes"], "owner": event["owner"]} if event["event"] == "prepare" else {})


def upload_state(events: DataFrame) -> DataFrame:
    """The current row of each upload; its events (a few for each) are folded in order of event_no."""
    moves = F.create_map(*[F.lit(x) for event, (legal, status) in TRANSITIONS.items() for old in legal for x in (f"{old or ''}>{event}", status)])
    listed = F.sort_array(F.collect_list(F.struct("event_no", "event", "owner", "nbytes", "at")))
    first = lambda c: F.element_at("e", 1)[c].alias("updated_at" if c == "at" else c)
    begin = F.struct(first("owner"), F.lit(None).cast("string").alias("status"), first("nbytes"), first("at"), F.lit(0).alias("rejected"))

    def folded(now: Column, event: Column) -> Column:
        status = moves[F.concat(F.coalesce(now["status"], F.lit("")), F.lit(">"), event["event"])]
        anew = status.isNotNull() & (event["event"] == "prepare")
        return F.struct(
            F.when(anew, event["owner"]).otherwise(now["owner"]).alias("owner"), F.coalesce(status, now["status"]).alias("status"),
            F.when(anew, event["nbytes"]).otherwise(now["nbytes"]).alias("nbytes"), F.when(status.isNotNull(), event["at"]).otherwise(now["updated_at"]).alias("updated_at"),
            F.when(status.isNull(), now["rejected"] + 1).otherwise(now["rejected"]).alias("rejected"),
        )

    typed = events.select("upload_id", "event_no", "event", "owner", F.col("nbytes").cast("long").alias("nbytes"), F.col("at").cast("double").alias("at"))
    return typed.groupBy("upload_id").agg(listed.alias("e")).select("upload_id", F.aggregate("e", begin, folded).alias("s")).select("upload_id", "s.*")


def pending_bytes(uploads: DataFrame, but: str | None = None) -> DataFrame:
    """Bytes of pending uploads per owner, without the one that is prepared anew."""
    rows = uploads.where(F.col("status").isin(*PENDING))
    rows = rows.where(F.col("upload_id") != but) if but else rows
    return rows.groupBy("owner").agg(F.sum("nbytes").alias("pending_bytes"))


def quota_violations(uploads: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """upload_id, owner, pending_bytes and asked_bytes of prepared uploads (upload_id, owner, nbytes) that would exceed an owner's ``most`` bytes.

    Pending are the owner's other uploads, failed ones included. An upload of the owner that is under way is only asked for again, which is always
    allowed; one that is complete, failed, cancelled or expired is prepared anew and is checked like a new one.
    """
    sums = uploads.where(F.col("status").isin(*PENDING)).groupBy("owner").agg(F.sum("nbytes").alias("held"))
    known = uploads.select("upload_id", "owner", "status", F.col("nbytes").alias("own"))
    anew = asked.select("upload_id", "owner", "nbytes").join(known, ["upload_id", "owner"], "left")
    anew = anew.where(F.col("status").isNull() | ~F.col("status").isin(*UNDER_WAY)).join(sums, "owner", "left")
    others = F.coalesce("held", F.lit(0)) - F.when(F.col("status").isin(*PENDING), F.col("own")).otherwise(0)
    both = anew.select("upload_id", "owner", others.alias("pending_bytes"), F.col("nbytes").alias("asked_bytes"))
    return both.where(F.col("pending_bytes") + F.col("asked_bytes") > most)


def request_total(requests: DataFrame, since: str | None = None) -> DataFrame:
    """requestCount of the request statistics: one row."""
    requests = requests.where(F.col("started_at") >= since) if since else requests
    return requests.agg(F.count("*").alias("request_count"))


def expire_abandoned(uploads: DataFrame, now: float, ttl: float, receiving: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(uploads with the abandoned ones expired, one row of their count and bytes); uploads being received are left alone."""
    old = F.col("status").isin(*ABANDONED) & (F.col("updated_at") < now - ttl) & ~F.col("upload_id").isin(receiving or [])
    marked = uploads.withColumn("old", old)
    counts = marked.where("old").agg(F.count("*").alias("expired"), F.coalesce(F.sum("nbytes"), F.lit(0)).alias("expired_bytes"))
    return marked.withColumn("status", F.when(F.col("old"), "expired").otherwise(F.col("status"))).drop("old"), counts


def list_uploads(uploads: DataFrame, owner: str, limit: int | None = None) -> DataFrame:
    return uploads.where(F.col("owner") == owner).orderBy(F.desc("updated_at"), "upload_id").limit(clamp(limit, 20, 100))


def assign_people(principals: DataFrame, identities: DataFrame) -> DataFrame:
    """principal and person of new principals (principal, arrival): the plain label for the first one if nobody has it, else with eight digits of
    the principal's digest."""
    lowered = principals.select(F.lower("principal").alias("principal"), "arrival").groupBy("principal").agg(F.min("arrival").alias("arrival"))
    new = lowered.join(identities.select(F.lower("principal").alias("principal")), "principal", "left_anti").withColumn("label", T.person_label(F.col("principal")))
    taken = identities.select(F.col("person").alias("label")).distinct().withColumn("taken", F.lit(True))
    nth = F.row_number().over(Window.partitionBy("label").orderBy("arrival", "principal"))
    marked = new.withColumn("nth", nth).join(taken, "label", "left")
    plain: Column = F.col("taken").isNull() & (F.col("nth") == 1)
    suffixed = F.concat("label", F.lit("-"), F.left(F.sha2("principal", 256), F.lit(8)))
    return marked.select("principal", F.when(plain, F.col("label")).otherwise(suffixed).alias("person"))
