"""Ordered operators over entries, sessions, epochs and stage logs: windows, running counts, chains."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.ordered import in_order

WRITES, READS = ("memory_write", "summary_write"), ("memory_read",)
#: stage -> stages that may follow; a stage that leads nowhere is terminal, but for 'timed_out' and 'failed', which can go on.
TRANSITIONS = {
    "initiated": "cancelled executing pending_approval", "pending_approval": "approved rejected timed_out", "approved": "executing", "executing": "completed failed timed_out",
    "failed": "escalated fallback retrying", "retrying": "executing failed", "escalated": "cancelled pending_approval", "fallback": "executing", "timed_out": "cancelled escalated retrying",
}
TERMINAL = ("completed", "rejected", "cancelled")


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp with or without a zone; without one it is UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def write_bursts(entries: DataFrame, least: int = 10, seconds: int = 60) -> DataFrame:
    """Each agent's first window of that many writes in as many seconds, both ends included: agent, ts, writes, severity."""
    w = Window.partitionBy("agent").orderBy("us").rangeBetween(0, seconds * 1_000_000)
    writes = entries.where(F.col("action").isin(*WRITES)).select("agent", "ts", micros(F.col("ts")).alias("us"))
    hits = writes.withColumn("writes", F.count("*").over(w)).where(F.col("writes") >= least)
    first = hits.groupBy("agent").agg(F.min(F.struct("us", "ts", "writes")).alias("f"))
    return first.select("agent", "f.ts", "f.writes", F.least(F.lit(1.0), F.col("f.writes") / least * 0.5 + 0.3).alias("severity"))


def behavioral_shift(entries: DataFrame, z_least: float = 2.0) -> DataFrame:
    """Agents whose rate of entries with PII changed after their first write; at least three entries on either side."""
    first = F.min(F.when(F.col("action").isin(*WRITES), F.col("ts"))).over(Window.partitionBy("agent"))
    e = entries.withColumn("w", first).where("w is not null")
    pii = F.col("pii").cast("int")
    g = e.groupBy("agent").agg(
        F.count_if(F.col("ts") < F.col("w")).alias("n0"), F.count_if(F.col("ts") > F.col("w")).alias("n1"),
        F.avg(F.when(F.col("ts") < F.col("w"), pii)).alias("p0"), F.avg(F.when(F.col("ts") > F.col("w"), pii)).alias("p1"),
    ).where("n0 >= 3 and n1 >= 3")
    z = F.abs(F.col("p1") - F.col("p0")) / F.greatest(F.lit(0.01), F.sqrt(F.col("p0") * (1 - F.col("p0")) / F.col("n0")))
    return g.withColumn("z", z).where(F.col("z") >= z_least).select("agent", "z", F.least(F.lit(1.0), F.col("z") / 5).alias("severity"))


def session_drift(sessions: DataFrame, window: int = 3) -> DataFrame:
    """z of the violation rate of an agent's last sessions against those before; 0 with too few sessions."""
    back = F.row_number().over(Window.partitionBy("agent").orderBy(F.desc("session")))
    s = sessions.select("agent", (F.col("violations") / F.greatest(F.col("interactions"), F.lit(1))).alias("rate"), back.alias("back"))
    old, new = F.when(F.col("back") > window, F.col("rate")), F.when(F.col("back") <= window, F.col("rate"))
    g = s.groupBy("agent").agg(F.avg(old).alias("m0"), F.stddev_pop(old).alias("s0"), F.avg(new).alias("m1"))
    z = F.abs(F.col("m1") - F.col("m0")) / F.greatest(F.col("s0"), F.lit(0.01))
    return g.select("agent", F.coalesce(F.bround(z, 3), F.lit(0.0)).alias("drift"))


def trend(epochs: DataFrame, window: int = 5, threshold: float = 2.0) -> DataFrame:
    """Deviation of the violation rate of the last epochs from that of all: agent, epochs, deviation, anomalous. Counts may have noise."""
    back = F.row_number().over(Window.partitionBy("agent").orderBy(F.desc("epoch")))
    recent = F.col("back") <= window
    g = epochs.withColumn("back", back).groupBy("agent").agg(
        F.count("*").alias("epochs"), F.sum(F.when(recent, F.col("violations"))).alias("v1"), F.sum(F.when(recent, F.col("edges"))).alias("e1"), F.sum("violations").alias("v"), F.sum("edges").alias("e")
    ).where(F.col("epochs") >= window + 2)
    r1, r = F.col("v1") / F.greatest(F.col("e1"), F.lit(1)), F.col("v") / F.greatest(F.col("e"), F.lit(1))
    deviation = F.when(r > 0, F.abs(r1 - r) / F.greatest(r, F.lit(0.01))).otherwise(F.when(r1 > 0, float("inf")).otherwise(0.0))
    return g.select("agent", "epochs", deviation.alias("deviation"), (deviation > threshold).alias("anomalous"))


def memory_profile(sessions: DataFrame) -> DataFrame:
    """Running means of writes and reads over an agent's sessions, and their ratio."""
    w = Window.partitionBy("agent").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    s = sessions.withColumns({"avg_writes": F.avg("writes").over(w), "avg_reads": F.avg("reads").over(w)})
    return s.select("agent", "session", "avg_writes", "avg_reads", (F.col("avg_writes") / F.greatest(F.col("avg_reads"), F.lit(1.0))).alias("write_read_ratio"))


def lifecycle(log: DataFrame, max_retries: int = 3) -> DataFrame:
    """The stage log (action, ts, ord, from_stage, to_stage) with what is wrong in each step: broken continuity, an illegal step, too many retries."""
    w = Window.partitionBy("action").orderBy("ts", "ord")
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v.split())))])
    before = F.coalesce(F.lag("to_stage").over(w), F.lit("initiated"))
    retries = F.count_if(F.col("to_stage") == "retrying").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return log.withColumns(
        {"expected": before, "broken": F.col("from_stage") != before, "illegal": ~F.coalesce(F.array_contains(allowed[F.col("from_stage")], F.col("to_stage")), F.lit(False)), "over_retried": (F.col("to_stage") == "retrying") & (retries > max_retries)}
    )


def action_states(log: DataFrame) -> DataFrame:
    """Each action's last stage, its duration in seconds, and whether it has ended."""
    g = log.groupBy("action").agg(F.max_by("to_stage", F.struct("ts", "ord")).alias("stage"), F.count("*").alias("steps"), (micros(F.max("ts")) - micros(F.min("ts"))).alias("us"))
    return g.select("action", "stage", "steps", (F.col("us") / 1e6).alias("seconds"), F.col("stage").isin(*TERMINAL).alias("terminal"))


def hop_counts(messages: DataFrame, datum: Column, *order: str) -> DataFrame:
    """How often a datum has been passed on, this time included."""
    return messages.withColumn("hop", F.row_number().over(Window.partitionBy(datum).orderBy(*order)))


def append_chain(entries: DataFrame) -> DataFrame:
    """(agent, seq, payload, hash): each hash covers the one before it and the payload; the first covers ''. An agent's entries are read as a stream, so a chain of any length is held by none."""

    def link(state: dict, r) -> tuple:
        state["hash"] = hashlib.sha256(f"{state.get('hash', '')}:{r.payload}".encode()).hexdigest()
        return (r.agent, r.seq, r.payload, state["hash"])

    return in_order(entries.select("agent", "seq", "payload"), "agent", ["seq"], dict, link, "agent string, seq bigint, payload string, hash string")


def chain_snapshot(chain: DataFrame, seq: int) -> DataFrame:
    """(agent, links, head): chains as they were up to a number."""
    return chain.where(F.col("seq") <= seq).groupBy("agent").agg(F.count("*").alias("links"), F.max_by("hash", "seq").alias("head"))


def verify_chain(chain: DataFrame) -> DataFrame:
    """Per agent: length, links that don't follow from the one before, and the head."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy("agent").orderBy("seq")), F.lit(""))
    ok = F.sha2(F.concat(before, F.lit(":"), F.col("payload")), 256) == F.col("hash")
    return chain.withColumn("ok", ok).groupBy("agent").agg(F.count("*").alias("links"), F.count_if(~F.col("ok")).alias("broken"), F.max_by("hash", "seq").alias("head"))


def epoch_tokens(epochs: DataFrame, secret: str) -> DataFrame:
    """(agent, epoch, token, commitment): tokens follow from the secret and the index, so a chain needs no state; a commitment covers the token before."""
    token = lambda i: F.sha2(F.concat_ws(":", F.lit(secret), F.col("agent"), i.cast("string")), 256)
    return epochs.select("agent", "epoch", token(F.col("epoch")).alias("token"), F.sha2(F.concat_ws(":", token(F.col("epoch") - 1), token(F.col("epoch"))), 256).alias("commitment"))


def verify_epochs(commitments: DataFrame) -> DataFrame:
    """Per agent, commitments that don't follow from the revealed tokens of their own and the epoch before."""
    w = Window.partitionBy("agent").orderBy("epoch")
    ok = F.sha2(F.concat_ws(":", F.lag("token").over(w), F.col("token")), 256) == F.col("commitment")
    return commitments.withColumn("ok", ok).groupBy("agent").agg(F.count("*").alias("epochs"), F.count_if(F.col("ok") == F.lit(False)).alias("broken"))


def node_handoffs(log: DataFrame) -> DataFrame:
    """Edges where the current node of a run changes: run, ts, from_agent, to_agent."""
    before = F.lag("node").over(Window.partitionBy("run").orderBy("ts", "ord"))
    return log.withColumn("from_agent", before).where("from_agent is not null and from_agent <> node").select("run", "ts", "ord", "from_agent", F.col("node").alias("to_agent"))


class TaintState:
    """What an agent has received in a trace, merged: domains, largest sensitivity and hops, subjects and principals ('' is none), and by subject the domains and sensitivity that the compound risk needs."""

    def __init__(self) -> None:
        self.domains: set[str] = set()
        self.sens = self.hops = 0
        self.subjects: set[str] = set()
        self.principals: set[str] = set()
        self.by: dict[str, tuple[set, int]] = {}

    def receive(self, domains, sens: int, subject: str, principal: str, hops: int) -> None:
        self.domains |= set(domains)
        self.sens, self.hops = max(self.sens, sens), max(self.hops, hops)
        self.subjects |= {subject} - {""}
        self.principals |= {principal} - {""}
        held, most = self.by.get(subject or "unknown", (set(), 0))
        self.by[subject or "unknown"] = (held | set(domains), max(most, sens))

    def emit(self, domains, sens: int) -> tuple[set, int, str, str, int]:
        one = lambda names: "" if not names else next(iter(names)) if len(names) == 1 else "multi"
        return self.domains | set(domains), max(self.sens, sens), one(self.subjects), one(self.principals), self.hops + 1

    def risk(self) -> float:
        return compound_risk([(d, s, subject if subject != "unknown" else "", 0) for subject, (d, s) in self.by.items()])


def propagate_taint(handoffs: DataFrame, owners: bool = False) -> DataFrame:
    """Taint over the handoffs of each trace, in order of seq.

    A sender's emission merges its own domains and sensitivity with all taint it has received in the trace: domains united, sensitivity the largest,
    hops one more than the largest, one subject or 'multi'. A sender is seeded once for each subject it names. A blocked handoff emits but does not arrive. The compound risk is
    that of the sender's state. State is kept by trace, so traces are independent; a trace is read as a stream, and what is held is its agents' merged state. With ``owners``, a column ``principal`` of the sender's
    owner travels with what it seeds, as t_principal.
    """

    def step(trace: dict, r) -> tuple:
        state = trace.setdefault(("at", r.from_agent), TaintState())
        if r.subject and ("seeded", r.from_agent, r.subject) not in trace:
            trace["seeded", r.from_agent, r.subject] = True
            state.receive(r.domains, int(r.sens), r.subject, r.principal if owners else "", 0)
        risk = state.risk()
        domains, sens, subject, principal, hops = state.emit(r.domains, int(r.sens))
        if not r.blocked:
            trace.setdefault(("at", r.to_agent), TaintState()).receive(domains, sens, subject, principal, hops)
        out = (r.trace, r.seq, ",".join(sorted(domains)), sens, subject, hops, risk)
        return (*out, principal) if owners else out

    return in_order(handoffs, "trace", ["seq"], dict, step, "trace bigint, seq bigint, t_domains string, t_sens int, t_subject string, t_hops int, t_risk double" + (", t_principal string" if owners else ""))


def compound_risk(state: list, sensitive: tuple[str, ...] = ("health", "finance", "legal", "identity")) -> float:
    """The largest over subjects: two sensitive domains or more give 0.7 of their number in three and 0.3 of the sensitivity in five."""
    domains: dict[str, set] = {}
    sens: dict[str, int] = {}
    for d, s, subject, _ in state:
        key = subject or "unknown"
        domains.setdefault(key, set()).update(d)
        sens[key] = max(sens.get(key, 0), s)
    most = 0.0
    for key, d in domains.items():
        n = len(d & set(sensitive))
        if n >= 2:
            most = max(most, 0.7 * min(1.0, n / 3) + 0.3 * sens[key] / 5)
    return round(min(1.0, most), 3)
