"""Sessions and epochs of an agent without its name: tokens, pseudonyms and commitments follow from a secret and an index, so a chain needs no state; proofs reveal the tokens of a range.

A session's texts are joined by '||', an epoch's by ':'. An agent's own secret is the key with its name, so one key from configuration serves all agents of a side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _h(sep: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws(sep, *[p.cast("string") for p in parts]), 256)


def agent_secret(key: str, agent: Column) -> Column:
    return F.concat(F.lit(key), F.lit("/"), agent.cast("string"))


def session_chain(sessions: DataFrame, key: str) -> DataFrame:
    """(agent, session, session_id, token, pseudonym, commitment) of (agent, session), sessions from 0; the token stays with the agent, and the first commitment covers a genesis token."""
    own, i = agent_secret(key, F.col("agent")), F.col("session")
    token = lambda k: F.when(k < 0, _h("||", own, F.lit("genesis"))).otherwise(_h("||", own, F.lit("token"), k))
    return sessions.select(
        "agent", "session", _h("||", own, F.lit("session"), i).alias("session_id"), token(i).alias("token"), _h("||", own, F.lit("pseudonym"), i).alias("pseudonym"), _h("||", token(i - 1), token(i)).alias("commitment")
    )


def epoch_chain(epochs: DataFrame, key: str) -> DataFrame:
    """(agent, epoch, token, commitment, pseudonym_root, salt) of (agent, epoch), epochs from 1; the salt is that of the epoch's pseudonyms, new in each."""
    own, i = agent_secret(key, F.col("agent")), F.col("epoch")
    token = lambda k: F.when(k < 1, _h(":", own, F.lit("genesis"))).otherwise(_h(":", own, k))
    return epochs.select(
        "agent", "epoch", token(i).alias("token"), _h(":", token(i - 1), token(i)).alias("commitment"), _h(":", token(i), F.lit("pseudonym")).alias("pseudonym_root"), _h(":", own, F.lit("salt"), i).alias("salt")
    )


def prove(chain: DataFrame, index: str, challenges: DataFrame, also: str) -> DataFrame:
    """(agent, lo, hi, tokens, also): the tokens of the range that a challenge (agent, lo, hi) names, and another column of it, in order. A range is as long as the challenge asks."""
    c = challenges.select(F.col("agent").alias("__a"), "lo", "hi")
    j = chain.join(c, (F.col("agent") == F.col("__a")) & F.col(index).between(F.col("lo"), F.col("hi")))
    g = j.groupBy("agent", "lo", "hi").agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col("token").alias("t"), F.col(also).alias("x")))).alias("s"))
    return g.select("agent", "lo", "hi", F.transform("s", lambda x: x["t"]).alias("tokens"), F.transform("s", lambda x: x["x"]).alias(also))


def _committed(proofs: DataFrame, commitments: DataFrame, index: str) -> DataFrame:
    """proofs with ``stored``: the commitments of the range, in order, as far as there are any."""
    c = commitments.select(F.col("agent").alias("__a"), F.col(index).alias("__i"), F.col("commitment").alias("__c"))
    j = proofs.join(c, (F.col("agent") == F.col("__a")) & F.col("__i").between(F.col("lo"), F.col("hi")), "left")
    g = j.groupBy("agent", "lo", "hi").agg(F.first("tokens").alias("tokens"), F.array_sort(F.collect_list(F.when(F.col("__i").isNotNull(), F.struct("__i", "__c")))).alias("s"))
    return g.select("agent", "lo", "hi", "tokens", F.transform("s", lambda x: x["__c"]).alias("stored"))


def verify_sessions(proofs: DataFrame, commitments: DataFrame) -> DataFrame:
    """(agent, lo, hi, n_tokens, verified): each token but the first is held against the commitment that covers it and the one before; with fewer than two there is only their number."""
    p = _committed(proofs, commitments, "session")
    n = F.size("tokens")
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda k: (k >= F.size("stored")) | (_h("||", F.get("tokens", k - 1), F.get("tokens", k)) == F.get("stored", k)))
    ok = F.when(n < 2, n == F.size("stored")).otherwise(F.forall(pairs, lambda x: x))
    return p.select("agent", "lo", "hi", n.alias("n_tokens"), ok.alias("verified"))


def verify_epochs(proofs: DataFrame, commitments: DataFrame, before: DataFrame) -> DataFrame:
    """(agent, lo, hi, n_tokens, n_verified, verified): as many tokens as commitments, and each commitment covers the token before and its own. before: (agent, epoch, token) with the token of the epoch before the range, epoch 0 being the genesis token."""
    p = _committed(proofs, commitments, "epoch")
    b = before.select(F.col("agent").alias("__a"), F.col("epoch").alias("__e"), F.col("token").alias("__t"))
    p = p.join(b, (F.col("agent") == F.col("__a")) & (F.col("__e") == F.col("lo") - 1), "left")
    n = F.size("tokens")
    at = lambda k: F.when(k < 0, F.coalesce("__t", F.lit(""))).otherwise(F.get("tokens", k))
    fits = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: _h(":", at(k - 1), F.get("tokens", k)) == F.get("stored", k))
    first_bad = F.array_position(fits, False)
    even = n == F.size("stored")
    good = F.when(~even | (n == 0), 0).when(first_bad == 0, n).otherwise(first_bad - 1)
    return p.select("agent", "lo", "hi", n.alias("n_tokens"), good.cast("int").alias("n_verified"), (even & (good == n)).alias("verified"))


def genesis(agents: DataFrame, key: str) -> DataFrame:
    """(agent, epoch 0, token)."""
    return agents.select("agent", F.lit(0).alias("epoch"), _h(":", agent_secret(key, F.col("agent")), F.lit("genesis")).alias("token"))


def privacy_cost(epochs: DataFrame, epsilon: float) -> DataFrame:
    """(agent, epochs, cost): what the two running counters of an agent have spent, each epsilon times the levels of its tree."""
    levels = F.when(F.col("epochs") <= 1, 1.0).otherwise(F.ceil(F.log2(F.col("epochs").cast("double"))).cast("double"))
    return epochs.groupBy("agent").agg(F.count("*").alias("epochs")).select("agent", "epochs", (2 * epsilon * levels).alias("cost"))
