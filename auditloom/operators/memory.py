"""Memory audits of single actions, and the lexical tagger of message parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.patterns import java

WRITES, READS = ("memory_write", "summary_write"), ("memory_read",)
_S = r"\s+"
INJECTION = [
    rf"(?i)ignore{_S}previous|instruction|override|system\s*prompt", rf"(?i)when{_S}(asked|prompted|queried){_S}(about|for|regarding)", rf"(?i)always{_S}(answer|reply|respond|say){_S}",
    r"(?i)api[_\s]?key|credential|password|secret|token", rf"(?i)do{_S}not{_S}(disclose|mention|reveal|share)", rf"(?i)act{_S}as{_S}if|pretend|role[_\s]?play",
]
EXTRACTION = [
    rf"(?i)what{_S}(did{_S}you|do{_S}you){_S}(know|recall|remember){_S}about", rf"(?i)tell{_S}me{_S}(all|everything){_S}(that|you){_S}(know|remember|stored)", rf"(?i)list{_S}(all|every){_S}(remembered|saved|stored)",
    rf"(?i)retrieve{_S}(all|previous|saved|stored)", rf"(?i)search{_S}(your{_S})?memory{_S}for", rf"(?i)dump{_S}(context|data|history|memory)",
]

#: Terms that state a category, that hint at it, and hints that are strong.
STATED = {
    "health": "biopsy|blood test|chemotherapy|cholesterol|diagnosed|diagnosis|hiv|medication|mental health|mri|prescribed|prescription|symptom|therapy session",
    "finance": "account number|balance|bankruptcy|credit score|debt|deductions|income|net worth|salary|tax deduction|tax return|wire transfer",
    "legal": "custody|deposition|immigration status|indictment|lawsuit|restraining order|settlement",
    "location": "coordinates|geolocation|gps|home address|whereabouts",
    "employment": "demoted|fired|laid off|misconduct|performance improvement|performance review|terminated",
    "education": "expelled|failing|gpa|grades|iep|sat score|suspended|test scores|transcript",
    "credentials": "access token|api key|password|private key|secret key",
    "biometric": "biometric|dna|facial recognition|fingerprint|retina",
    "demographic": "disability|ethnicity|immigration|pregnant|race|religion|sexual orientation",
}
HINTED = {
    "health": "appointment|cancer|cancer center|clinic|dialysis|doctor|hospital|icu|infusion|oncology|pharmacy|rehab|specialist|therapist|treatment center|ward",
    "finance": "bank|collections|creditor|creditors|lender|loan|mortgage|overdue|refinance",
    "legal": "attorney|case number|court|hearing|lawyer|tribunal",
    "location": "commute|district|downtown|frequents|lives near|near the|neighborhood",
    "behavioral": "browsing|habits|interested in|likely to|prefers|purchase history|tends to|viewing|watch history",
    "education": "campus|classroom|school|tutor|university",
    "employment": "employer|hr department|manager|workplace",
}
NEUTRAL = {"schedule": "am|available|busy|calendar|free|meet|meeting|pm|reschedule|slot|standup|tuesday"}
STRONG = {"health": "cancer center|chemotherapy|dialysis|icu|infusion|oncology|treatment center", "finance": "bankruptcy|collections|creditors|foreclosure", "legal": "deportation|indictment|restraining order"}
STRONG_RATIO = 9.0


def whole(terms: str) -> str:
    return rf"\b(?:{terms})\b"


def hits(text: Column, patterns: list[str]) -> Column:
    """How many patterns the text matches."""
    return reduce(lambda a, b: a + b, [F.coalesce(text.rlike(java(p)), F.lit(False)).cast("int") for p in patterns])


def memory_findings(entries: DataFrame) -> DataFrame:
    """(entry_id, agent, kind, matches, severity) of writes that look like injections and reads that probe. Writes are judged by their output, else input; reads the other way round."""
    out, inp = F.nullif(F.col("output_text"), F.lit("")), F.nullif(F.col("input_text"), F.lit(""))
    w = entries.where(F.col("action").isin(*WRITES)).withColumn("matches", hits(F.coalesce(out, inp), INJECTION)).where("matches > 0")
    r = entries.where(F.col("action").isin(*READS)).withColumn("matches", hits(F.coalesce(inp, out), EXTRACTION)).where("matches > 0")
    pick = lambda df, kind, sev: df.select("entry_id", "agent", F.lit(kind).alias("kind"), "matches", F.least(F.lit(1.0), sev).alias("severity"))
    return pick(w, "injection_attempt", F.col("matches") * 0.25 + 0.2).unionByName(pick(r, "extraction_probe", F.col("matches") * 0.2 + 0.3))


def scope_violations(entries: DataFrame, authorized: list[str]) -> DataFrame:
    """(entry_id, agent, outside): domains of memory actions that aren't authorized; an empty list asks nothing."""
    rows = entries.where(F.col("action").isin(*WRITES, *READS))
    outside = F.array_sort(F.array_except("domains", F.array(*map(F.lit, authorized)))) if authorized else F.array().cast("array<string>")
    return rows.select("entry_id", "agent", outside.alias("outside")).where(F.size("outside") > 0)


_TAGS = [(of, k, v) for of, t in (("stated", STATED | NEUTRAL), ("hinted", HINTED), ("strong", STRONG)) for k, v in sorted(t.items())]


def tag_bits(text: Column) -> Column:
    """The patterns of _TAGS that match, as bits; null for no text. Each is tried once: kept in a column of its own (by a generator), it can be read many times."""
    low = F.lower(text)
    hit = [F.when(low.rlike(java(whole(v))), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint") for k, (_, _, v) in enumerate(_TAGS)]
    return reduce(lambda a, b: a.bitwiseOR(b), hit)


def lexical_tags(text: Column) -> dict[str, Column]:
    """category, inferred and strong hints of a part."""
    return tags_of(tag_bits(text))


def tags_of(bits: Column) -> dict[str, Column]:
    """The same by ``tag_bits``; each in order."""
    has = {(of, k): bits.bitwiseAND(F.lit(1 << i).cast("bigint")) != 0 for i, (of, k, _) in enumerate(_TAGS)}
    no = F.lit(False)
    inferred = {k: has["hinted", k] & ~has.get(("stated", k), no) for k in sorted(HINTED)}
    named = lambda which: F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in which.items()]))
    return {
        "category": named({k: has["stated", k] for k in sorted(STATED | NEUTRAL)}), "inferred": named(inferred),
        "strong": named({k: c & has.get(("strong", k), no) for k, c in inferred.items()}),
    }
