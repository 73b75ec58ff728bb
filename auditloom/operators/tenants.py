"""Audit of labelled messages between tenants: disclosure, purpose, time to live, and what a recipient can infer from fragments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditloom.functions import noise
from auditloom.operators.commitments import hmac_sha256

SENSITIVE = ("behavioral", "biometric", "credentials", "demographic", "education", "employment", "finance", "health", "legal", "location")
FLOOR, PRIOR, RATIO, GAIN = 3, 0.1, 3.0, 0.3
FOUND = ["violation", "message_id", "subject", "owner", "recipient", "severity"]


def _found(rows: DataFrame, kind: str, severity: Column) -> DataFrame:
    return rows.select(F.lit(kind).alias("violation"), "message_id", "subject", "owner", F.col("to_principal").alias("recipient"), F.least(F.lit(1.0), severity).alias("severity"))


def canonical_subject(name: Column) -> Column:
    return F.concat(F.lit("subject:"), F.substring(F.sha2(F.lower(F.trim(name)), 256), 1, 16))


def harden(labels: DataFrame, salt: str, epsilon: float | None = None) -> DataFrame:
    """Names become pseudonyms ('' and 'multi' stay), and the level gets noise if there is a budget."""
    ps = lambda c: F.when((c == "") | (c == "multi"), c).otherwise(F.concat(F.lit("ps:"), F.substring(F.sha2(F.concat_ws(":", F.lit(salt), c), 256), 1, 12)))
    out = labels.withColumns({c: ps(F.col(c)) for c in ("subject", "owner", "to_principal")} | {"allowed": F.transform("allowed", ps)})
    if epsilon is not None:
        out = out.withColumn("sens", F.least(F.lit(5), noise.noisy_count(F.col("sens"), noise.uniform(salt, F.col("message_id")), epsilon)).cast("int"))
    return out


def hops(labels: DataFrame) -> DataFrame:
    """labels with ``hop``: how often their datum (provenance, else content hash) was sent up to here."""
    datum = F.coalesce(F.nullif(F.col("provenance"), F.lit("")), F.col("content_hash"))
    return labels.withColumn("hop", F.row_number().over(Window.partitionBy(datum).orderBy("ts", "message_id")))


def disclosure(labels: DataFrame, floor: int = FLOOR) -> DataFrame:
    known = (F.col("to_principal") != "") & (F.col("to_principal") != F.col("owner")) & ~F.array_contains("allowed", F.col("to_principal"))
    return _found(labels.where(known & (F.col("sens") >= floor)), "cross_tenant_disclosure", F.col("sens") / 5.0)


def purpose(labels: DataFrame, clearances: DataFrame) -> DataFrame:
    """clearances: (agent, purposes); an agent without any decides nothing."""
    j = labels.join(clearances, F.col("to_agent") == F.col("agent"))
    bad = (F.size("purpose") > 0) & (F.size("purposes") > 0) & ~F.arrays_overlap("purpose", "purposes")
    return _found(j.where(bad), "purpose_violation", F.greatest(F.col("sens"), F.lit(2)) / 5.0)


def time_to_live(labels: DataFrame) -> DataFrame:
    """labels with ``hop``."""
    over = F.col("hop") - F.col("ttl")
    return _found(labels.where(over > 0), "ttl_violation", F.lit(0.4) + over * 0.2)


def posterior(odds: Column) -> Column:
    """Of odds; written so that infinite odds are 1."""
    return 1 - 1 / (1 + odds)


def gain(k: Column, prior: float = PRIOR, ratio: float = RATIO) -> Column:
    """What k fragments of one ratio add to the prior."""
    return posterior(F.lit(prior / (1 - prior)) * F.pow(F.lit(ratio), k)) - prior


def fragments_to_fire(prior: float = PRIOR, ratio: float = RATIO, least: float = GAIN) -> int:
    """The smallest number of fragments whose gain reaches the threshold."""
    goal, start = (prior + least) / (1 - prior - least), prior / (1 - prior)
    return max(1, math.ceil(math.log(goal / start) / math.log(ratio)))


def inference(labels: DataFrame, least: float = GAIN) -> DataFrame:
    """(recipient, subject, category, fragments, gain, severity): sensitive categories that no one let the recipient know, but that fragments give away.

    A fragment is a content hash; its ratio is the largest that any copy has.
    """
    e = labels.where((F.col("to_principal") != "") & (F.col("subject") != ""))
    permitted = (F.col("to_principal") == F.col("owner")) | F.array_contains("allowed", F.col("to_principal"))
    told = e.where(permitted).select("to_principal", "subject", F.explode("category").alias("c")).distinct()
    each = e.select("to_principal", "subject", "content_hash", F.explode("inferred").alias("c"), "lambdas").where(F.col("c").isin(*SENSITIVE))
    ratio = F.coalesce(F.try_element_at("lambdas", F.col("c")), F.lit(RATIO))
    frag = each.groupBy("to_principal", "subject", "c", "content_hash").agg(F.max(ratio).alias("r"))
    sums = frag.groupBy("to_principal", "subject", "c").agg(F.count("*").alias("fragments"), F.product("r").alias("p"))
    found = sums.join(told, ["to_principal", "subject", "c"], "left_anti").withColumn("gain", posterior(F.lit(PRIOR / (1 - PRIOR)) * F.col("p")) - PRIOR)
    return found.where(F.col("gain") >= least).select(F.col("to_principal").alias("recipient"), "subject", F.col("c").alias("category"), "fragments", "gain", F.least(F.lit(1.0), F.col("gain") + PRIOR).alias("severity"))


def content_tokens(text: Column) -> Column:
    """Distinct words of four characters or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1), lambda w: F.length(w) >= 4))


def raw_leaks(parts: DataFrame, view: DataFrame, labels: DataFrame) -> DataFrame:
    """parts (message_id, text) of which a word that is no label value is in the center's view. view: (word); labels: (word)."""
    words = parts.select("message_id", F.explode(content_tokens(F.col("text"))).alias("word"))
    return words.join(labels.select("word").distinct(), "word", "left_anti").join(view.select("word").distinct(), "word", "left_semi").select("message_id").distinct()


# ---- labels on the wire, attestation of a build, the service's log ----

KEY = "privacy-label"


def attach(columns: list[str]) -> Column:
    """The label of those columns as the metadata of a message part, in JSON."""
    return F.to_json(F.struct(F.struct(*columns).alias(KEY)))


LABEL = "subject string, owner string, sens int, category array<string>"


def extract(parts: DataFrame, metadata: str, schema: str = LABEL) -> DataFrame:
    """parts with ``label``; null where the metadata has none."""
    return parts.withColumn("label", F.from_json(metadata, f"`{KEY}` struct<{schema.replace(' ', ':').replace(',:', ',')}>")[KEY])


def declare(agents: DataFrame) -> DataFrame:
    """Clearances (agent, principal, purposes): the last that each agent has declared, by seq."""
    return agents.groupBy("agent").agg(F.max_by(F.struct("principal", "purposes"), "seq").alias("c")).select("agent", "c.*")


def send(hops_: DataFrame, text: str = "text") -> DataFrame:
    """Messages as the audit takes them: the text is hashed and goes no further. A message without an id gets one by its number in the session."""
    n = F.row_number().over(Window.partitionBy("session").orderBy("seq"))
    return hops_.withColumns({"content_hash": F.sha2(F.coalesce(F.col(text), F.lit("")), 256), "message_id": F.coalesce(F.nullif("message_id", F.lit("")), F.concat(F.lit("m"), n))}).drop(text)


def observe(hops_: DataFrame, tags: dict[str, Column], level: Column, text: str = "text") -> DataFrame:
    """Messages of hops that come with policy only: categories, hints and sensitivity are what a tagger finds in the text."""
    return send(hops_.withColumns({"category": tags["category"], "inferred": tags["inferred"], "sens": level}), text)


def report(labels: DataFrame, sender: str) -> DataFrame:
    """(sender, messages, tags, edges_hash): one digest over all that a sender reports, whatever its order: the sum of the messages' digests."""
    each = F.sha2(F.to_json(F.struct("message_id", "subject", "owner", "sens", "category", "inferred", "content_hash")), 256)
    part = lambda k: F.sum(F.conv(F.substring(each, 1 + 8 * k, 8), 16, 10).cast("bigint")).cast("string")
    return labels.groupBy(sender).agg(F.count("*").alias("messages"), F.sum(F.size("inferred")).alias("tags"), F.sha2(F.concat_ws("|", *[part(k) for k in range(8)]), 256).alias("edges_hash"))


def _reported(labels: DataFrame, sender: str) -> DataFrame:
    """Reports as they are, or of labels."""
    return labels if "edges_hash" in labels.columns else report(labels, sender)


def attest(labels: DataFrame, sender: str, fingerprint: str, key: bytes) -> DataFrame:
    """(sender, messages, tags, edges_hash, fingerprint, signature): what a sender's build signs of its report."""
    r = _reported(labels, sender).withColumn("fingerprint", F.lit(fingerprint))
    return r.withColumn("signature", hmac_sha256(key, F.concat_ws("|", "fingerprint", "edges_hash", F.col("tags").cast("string"), F.col(sender).cast("string"))))


def verify(labels: DataFrame, attested: DataFrame, sender: str, builds: dict[str, bytes]) -> DataFrame:
    """(sender, messages, tags, reasons): what is wrong with each attestation of what came; '' is a good one. builds: fingerprint -> key."""
    now = _reported(labels, sender).select(F.col(sender).alias("__s"), F.col("edges_hash").alias("__h"))
    text = F.concat_ws("|", "fingerprint", "edges_hash", F.col("tags").cast("string"), F.col(sender).cast("string"))
    known, good = F.lit(False), F.lit(False)
    for fp, key in builds.items():
        known = known | (F.col("fingerprint") == fp)
        good = good | ((F.col("fingerprint") == fp) & (F.col("signature") == hmac_sha256(key, text)))
    why = F.when(~known, "untrusted_build").otherwise(F.concat_ws(",", F.when(~good, "bad_signature"), F.when(F.coalesce(F.col("__h") != F.col("edges_hash"), F.lit(True)), "report_tampered")))
    return attested.join(now, F.col(sender) == F.col("__s"), "left").select(sender, "messages", "tags", why.alias("reasons"))


def last(found: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last n violations, newest first."""
    return found.orderBy(*[F.desc(c) for c in order]).limit(n)
