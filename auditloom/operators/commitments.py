"""Merkle trees, commitments and reveals, message authentication, tokens, challenges and peer checks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditloom.functions.ordered import in_order, numbered
from auditloom.functions.shared import written


#: Levels of a tree that are built in one row, over 2 ** LEVELS nodes.
LEVELS = 8


def _up(level: Column, alone: Column) -> Column:
    """The next level of a tree: hashes of pairs, an odd last one with itself; alone: whether a single node still has levels above it."""
    pair = lambda i: F.sha2(F.concat(F.get(level, i * 2), F.coalesce(F.get(level, i * 2 + 1), F.get(level, i * 2))), 256)
    return F.when((F.size(level) > 1) | alone, F.transform(F.sequence(F.lit(0), F.floor((F.size(level) + 1) / 2).cast("int") - 1), pair)).otherwise(level)


def _rounds(items: DataFrame, group: str, order: list[str], item: str) -> list[DataFrame]:
    """Rounds of subtrees: (group, chunk, n, l0, ..., l8). A round's nodes are dealt into chunks of 2 ** LEVELS, a row each, whose roots are the nodes of the next; n is the number of the group's nodes in the round.

    So a row is bounded whatever a group has, and a tree of 16 million leaves takes three rounds. Of every round its nodes are written, as bytes; the levels above follow from them when it is read.
    """
    by = [f"__o{k}" for k in range(len(order))]
    return _rounds_of(numbered(items.select(group, *[F.col(c).alias(b) for c, b in zip(order, by)], F.col(item).alias("__item")), [group], by), group, "__item")


def _rounds_of(at: DataFrame, group: str, item: str) -> list[DataFrame]:
    """Rounds of subtrees of numbered items (group, idx, n, item)."""
    wide = 1 << LEVELS
    nodes = at.select(group, "idx", "n", F.unhex(F.sha2(F.col(item).cast("string"), 256)).alias("hash"))
    rounds: list[DataFrame] = []
    while True:
        sorted_nodes = F.array_sort(F.collect_list(F.struct("idx", "hash")))
        chunk = nodes.groupBy(group, F.floor(F.col("idx") / wide).alias("chunk")).agg(F.max("n").alias("n"), F.transform(sorted_nodes, lambda x: x["hash"]).alias("l0"))
        chunk = written(chunk, f"merkle-{len(rounds)}").withColumn("l0", F.transform("l0", lambda x: F.lower(F.hex(x))))
        for k in range(LEVELS):
            chunk = chunk.withColumn(f"l{k + 1}", _up(F.col(f"l{k}"), F.col("n") > wide))
        rounds.append(chunk)
        rest = rounds[-1].where(F.col("n") > wide)
        if not rest.limit(1).count():
            return rounds
        nodes = rest.select(group, F.col("chunk").alias("idx"), F.ceil(F.col("n") / wide).alias("n"), F.unhex(F.get(F.col(f"l{LEVELS}"), F.lit(0))).alias("hash"))


def _top(rounds: list[DataFrame], group: str) -> DataFrame:
    """(group, root): of each group the round in which its nodes fit one row."""
    each = [r.where(F.col("n") <= 1 << LEVELS).select(group, F.get(F.col(f"l{LEVELS}"), F.lit(0)).alias("root")) for r in rounds]
    return reduce(DataFrame.union, each)


def merkle_roots(items: DataFrame, group: str, order: list[str], item: str) -> DataFrame:
    """(group, root, leaves)."""
    return _roots(_rounds(items, group, order, item), group)


def _roots(rounds: list[DataFrame], group: str) -> DataFrame:
    n = rounds[0].groupBy(group).agg(F.max("n").cast("int").alias("leaves"))
    return _top(rounds, group).join(n, group)


def merkle_proofs(items: DataFrame, group: str, order: list[str], item: str) -> DataFrame:
    """(group, index, leaf, proof, root): proof holds the sibling of every level and the side it stands on."""
    return _proofs(_rounds(items, group, order, item), group)


def _proofs(rounds: list[DataFrame], group: str, asked: DataFrame | None = None) -> DataFrame:
    """Proofs of all leaves, or of those that are asked for (group, idx), which alone are then spread out."""
    wide = 1 << LEVELS

    def steps(r: DataFrame, asked: DataFrame | None = None) -> DataFrame:
        """(group, at, steps): for each node of a round its number and the steps up to its chunk's root."""
        if asked is None:
            each = r.select("*", F.posexplode("l0").alias("pos", "leaf"))
        else:
            want = asked.select(F.col(group).alias("__g"), F.floor(F.col("idx") / wide).alias("__c"), (F.col("idx") % wide).cast("int").alias("pos"))
            each = want.join(r, F.col("__g").eqNullSafe(F.col(group)) & (F.col("__c") == F.col("chunk"))).withColumn("leaf", F.get("l0", F.col("pos")))
        found = []
        for k in range(LEVELS):
            i, level = F.expr(f"shiftright(pos, {k})"), F.col(f"l{k}")
            left = i % 2 == 1
            sibling = F.when(left, F.get(level, i - 1)).otherwise(F.coalesce(F.get(level, i + 1), F.get(level, i)))
            found.append(F.when((F.size(level) > 1) | (F.col("n") > wide), F.struct(sibling.alias("hash"), F.when(left, "left").otherwise("right").alias("side"))))
        return each.select(group, (F.col("chunk") * wide + F.col("pos")).alias("at"), F.col("chunk").alias("__up"), "leaf", F.array_compact(F.array(*found)).alias("steps"))

    out = steps(rounds[0], asked).select(group, F.col("at").alias("index"), "leaf", "__up", F.col("steps").alias("proof"))
    for r in rounds[1:]:
        more = steps(r).select(group, F.col("at").alias("__at"), F.col("__up").alias("__next"), "steps")
        j = out.alias("o").join(more.alias("m"), (F.col(f"o.{group}").eqNullSafe(F.col(f"m.{group}"))) & (F.col("__up") == F.col("__at")), "left")
        none = F.array().cast("array<struct<hash:string,side:string>>")
        out = j.select(f"o.{group}", "index", "leaf", F.coalesce("__next", "__up").alias("__up"), F.concat("proof", F.coalesce("steps", none)).alias("proof"))
    return out.drop("__up").join(_top(rounds, group), group)


def verify_proof(leaf: Column, proof: Column, root: Column) -> Column:
    """leaf: the item's hash."""
    climb = lambda h, p: F.sha2(F.when(p["side"] == "right", F.concat(h, p["hash"])).otherwise(F.concat(p["hash"], h)), 256)
    return F.aggregate(proof, leaf, climb) == root


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex digest; the key's two pads are constants of the plan, so keys come from configuration, never from a column."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in key)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in key)), F.unhex(inner)), 256)


def attest(reports: DataFrame, key: bytes, agent: str, seq: str, digest: str) -> DataFrame:
    """reports with ``previous`` and ``signature`` over agent, sequence, digest and the digest before."""
    w = Window.partitionBy(agent).orderBy(seq)
    out = reports.withColumn("previous", F.coalesce(F.lag(digest).over(w), F.lit("genesis")))
    return out.withColumn("signature", hmac_sha256(key, F.concat_ws("|", F.col(agent).cast("string"), F.col(seq).cast("string"), digest, "previous")))


def verify_attested(reports: DataFrame, key: bytes, agent: str, seq: str, digest: str) -> DataFrame:
    """reports with ``verdict``: ok, sequence, chain or signature, the first that fails."""
    w = Window.partitionBy(agent).orderBy(seq)
    want = hmac_sha256(key, F.concat_ws("|", F.col(agent).cast("string"), F.col(seq).cast("string"), digest, "previous"))
    place, before = F.row_number().over(w), F.coalesce(F.lag(digest).over(w), F.lit("genesis"))
    rows = reports.withColumns({"__place": place, "__before": before})
    verdict = F.when(F.col(seq) != F.col("__place"), "sequence").when(F.col("previous") != F.col("__before"), "chain").when(F.col("signature") != want, "signature").otherwise("ok")
    return rows.withColumn("verdict", verdict).drop("__place", "__before")


def token(row: list[str]) -> Column:
    """Digest of some columns in the order given, as JSON."""
    return F.sha2(F.to_json(F.struct(*row)), 256)


def challenges(reports: DataFrame, edges: DataFrame) -> DataFrame:
    """(agent, edge_count_ok, violations_ok): what a report claims against the edges it sent. A redacted message counts as a violation on an edge only, so honest agents may fail the second."""
    sent = edges.groupBy(F.col("from_agent").alias("agent")).agg(F.count("*").alias("n"), F.count_if("violation").alias("v"))
    j = reports.join(sent, "agent", "left")
    return j.select("agent", (F.coalesce("n", F.lit(0)) == F.col("claimed_edges")).alias("edge_count_ok"), (F.coalesce("v", F.lit(0)) <= F.col("claimed_violations")).alias("violations_ok"))


def unmatched_receipts(receipts: DataFrame, edges: DataFrame) -> DataFrame:
    """Receipts for which the sender reports no edge of the same ends and content."""
    return receipts.join(edges.select("from_agent", "to_agent", "content_hash"), ["from_agent", "to_agent", "content_hash"], "left_anti")


def peer_verified(sender: DataFrame, receiver: DataFrame) -> DataFrame:
    """(edge_id, same): edges that both sides report, and whether their hashes are equal."""
    other = receiver.select("edge_id", F.col("content_hash").alias("theirs"))
    return sender.join(other, "edge_id").select("edge_id", (F.col("content_hash") == F.col("theirs")).alias("same"))


# ---- commit and reveal ----


def commit_traces(entries: DataFrame, trace: str, order: list[str], body: str, violation: Column) -> DataFrame:
    """(trace, root, entries, violations, rate): what is committed for each trace."""
    roots = merkle_roots(entries, trace, order, body)
    n = entries.groupBy(trace).agg(F.count_if(violation).alias("violations"))
    return roots.join(n, trace).select(trace, "root", F.col("leaves").alias("entries"), "violations", (F.col("violations") / F.col("leaves")).alias("rate"))


def commit_and_reveal(entries: DataFrame, trace: str, order: list[str], body: str, challenges: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The roots (trace, root, leaves) and (trace, order columns, body, keep, proof) of the entries that are challenged, from one numbering and one set of trees.
    challenges: (trace, entry), an entry by its first order column; a null entry asks for all of the trace."""
    at = numbered(entries.select(trace, *order, body, *keep), [trace], order)
    rounds = _rounds_of(at, trace, body)
    whole = challenges.where("entry is null").select(F.col(trace).alias("__t")).distinct()
    some = challenges.where("entry is not null").select(F.col(trace).alias("__t"), F.col("entry").alias("__e")).distinct().join(whole, "__t", "left_anti")
    asked = at.join(whole, F.col(trace) == F.col("__t"), "left_semi").union(at.join(some, (F.col(trace) == F.col("__t")) & (F.col(order[0]) == F.col("__e")), "left_semi"))
    asked = written(asked.select(trace, *order, body, *keep, "idx"), "asked")
    proofs = _proofs(rounds, trace, asked).select(F.col(trace).alias("__t"), F.col("index").alias("__i"), "proof")
    shown = asked.join(proofs, (F.col(trace) == F.col("__t")) & (F.col("idx") == F.col("__i"))).select(trace, *order, body, *keep, "proof")
    return _roots(rounds, trace), shown


def reveal(entries: DataFrame, trace: str, order: list[str], body: str, challenges: DataFrame) -> DataFrame:
    """(trace, order columns, body, proof) of the entries that are challenged."""
    return commit_and_reveal(entries, trace, order, body, challenges)[1]


def verify_reveals(revealed: DataFrame, commits: DataFrame, trace: str, body: str) -> DataFrame:
    """(trace, revealed, verified): whether every revealed entry is in the committed tree."""
    j = revealed.join(commits.select(trace, "root"), trace)
    ok = verify_proof(F.sha2(F.col(body).cast("string"), 256), F.col("proof"), F.col("root"))
    return j.groupBy(trace).agg(F.count("*").alias("revealed"), F.bool_and(ok).alias("verified"))


# ---- attestation with state and other backends ----


def signed_by(sign: Callable[[pd.Series], pd.Series]) -> Callable[[Column], Column]:
    """A signing backend of one's own (a remote or hardware attestation, say) as a pandas UDF: whole batches of payloads to signatures."""
    return F.pandas_udf(sign, "string")


def attest_reports(reports: DataFrame, agent: str, seq: str, digest: str, claimed: str, fingerprint: str, backend: Callable[[Column], Column]) -> DataFrame:
    """reports with prev_hash, chain_hash and signature: every attestation covers the one before it, the report's digest, the build's fingerprint and the number of messages claimed. seq counts from 0."""

    def step(state: dict, r) -> tuple:
        prev = state.get("hash", "")
        text = "|".join([prev, str(getattr(r, seq)), getattr(r, digest), fingerprint, str(getattr(r, claimed))])
        state["hash"] = hashlib.sha256(text.encode()).hexdigest()
        return (getattr(r, agent), getattr(r, seq), prev, state["hash"])

    kind = dict(reports.dtypes)[agent]
    chain = in_order(reports.select(agent, seq, digest, claimed), agent, [seq], dict, step, f"{agent} {kind}, {seq} bigint, prev_hash string, chain_hash string")
    return reports.join(chain, [agent, seq]).withColumns({"fingerprint": F.lit(fingerprint), "signature": backend(F.col("chain_hash"))})


def verify_attestations(reports: DataFrame, agent: str, seq: str, digest: str, claimed: str, edges: str, backends: dict[str, Callable[[Column], Column]], evidence: Column | None = None) -> DataFrame:
    """(agent, seq, reasons): what is wrong with each attestation; none is a good one. State goes on only after a good one, so what follows a bad one has a gap.

    backends: fingerprint -> signing function; ``edges`` is the number of edges in the report, ``evidence`` whether a quote that came with it is valid.
    """
    known = F.lit(False)
    good = F.lit(False)
    for fp, sign in backends.items():
        known = known | (F.col("fingerprint") == fp)
        good = good | ((F.col("fingerprint") == fp) & (F.col("signature") == sign(F.col("chain_hash"))))
    text = F.concat_ws("|", "prev_hash", F.col(seq).cast("string"), digest, "fingerprint", F.col(claimed).cast("string"))
    rows = reports.select(
        F.col(agent).alias("agent"), F.col(seq).cast("bigint").alias("seq"), "prev_hash", "chain_hash", known.alias("known"), good.alias("signed"), (F.sha2(text, 256) == F.col("chain_hash")).alias("same"),
        (F.col(claimed) <= F.col(edges)).alias("complete"), (F.lit(True) if evidence is None else evidence).alias("proven"),
    )

    def step(state: dict, r) -> tuple:
        why = []
        if not r.known:
            return (r.agent, r.seq, "untrusted_build")
        if not r.signed:
            why.append("bad_signature")
        if not r.proven:
            why.append("evidence")
        if not r.same:
            why.append("report_tampered")
        if "seq" not in state:
            if r.seq != 0:
                why.append("missing_initial_reports")
        else:
            if r.seq != state["seq"] + 1:
                why.append("sequence_gap")
            if r.prev_hash != state["hash"]:
                why.append("broken_chain")
        if not r.complete:
            why.append("underreported_edges")
        if not why:
            state.update(seq=r.seq, hash=r.chain_hash)
        return (r.agent, r.seq, ",".join(why))

    return in_order(rows, "agent", ["seq"], dict, step, f"agent {dict(rows.dtypes)['agent']}, seq bigint, reasons string")


def verify_tokens(rows: DataFrame, names: list[str], claimed: str) -> DataFrame:
    """rows with ``valid``: whether the token that is claimed is that of the columns."""
    return rows.withColumn("valid", token(names) == F.col(claimed))


def edge_challenges(reports: DataFrame, challenges: DataFrame) -> DataFrame:
    """(agent, edge_index, edge_id, content_hash, verified) of challenges (agent, edge_index) for the edge at a place of an agent's report; a place that isn't there verifies nothing.

    reports: (agent, edge_id, content_hash), an edge's place being its number by id, from 0.
    """
    at = numbered(reports.select("agent", "edge_id", "content_hash"), ["agent"], ["edge_id"])
    j = challenges.join(at.withColumnRenamed("agent", "__a"), (F.col("agent") == F.col("__a")) & (F.col("edge_index") == F.col("idx")), "left")
    return j.select("agent", "edge_index", "edge_id", "content_hash", F.col("edge_id").isNotNull().alias("verified"))
