"""Row-level text operators: gate, redaction, structured fields, similarity, entropy, injection, tags.

All but the entropy, the grams and the tiered detector, which run on Arrow batches, are built-in expressions. Null text counts as empty where a verdict is due.
"""

from __future__ import annotations

import math
import re
from collections import Counter, namedtuple
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.patterns import DOMAINS, GATE_PII, INJECTION, ROUTING_CONTEXT, STRUCTURED, java, possible

HIGH_DOMAINS = ("health", "finance", "legal", "identity")


def may_match(text: Column, patterns: list[str]) -> Column:
    """The patterns that a text can match, as bits of a number, by the strings that each needs. On Arrow batches: a search for strings takes a small part of a pattern's time."""
    return F.pandas_udf(lambda texts: pd.Series([None if t is None else possible(t, patterns) for t in texts], dtype="Int64"), "bigint")(text)


def matches(text: Column, patterns: list[str], may: Column | None = None) -> list[Column]:
    """Whether each pattern matches. may: ``may_match`` of the same patterns, made once for the row; patterns are then tried only where they can match."""
    hit = [text.rlike(java(p)) for p in patterns]
    return hit if may is None else [(may.bitwiseAND(F.lit(1 << k).cast("bigint")) != 0) & h for k, h in enumerate(hit)]


def quote(term: str) -> str:
    """A literal in a pattern."""
    return re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", term)


def rule_pattern(rule: str) -> str:
    """A rule with a blank is a substring; a single word has boundaries; case never counts."""
    return "(?i)" + (quote(rule) if " " in rule else rf"\b{quote(rule)}\b")


def active_pii(rules: list[str]) -> list[str]:
    """PII kinds that a policy's terms turn on."""
    low = {r.lower() for r in rules}
    return [k for k, (_, terms) in GATE_PII.items() if low & terms]


def _pii_pattern(kind: str) -> str:
    return ROUTING_CONTEXT if kind == "bank_routing" else GATE_PII[kind][0]


def _named(names: list[str], hits: list[Column]) -> Column:
    return F.array_compact(F.array(*[F.when(h, F.lit(n)) for n, h in zip(names, hits)])) if names else F.array().cast("array<string>")


def matched_rules(text: Column, rules: list[str]) -> Column:
    return _named(rules, matches(text, [rule_pattern(r) for r in rules]))


def matched_pii(text: Column, rules: list[str]) -> Column:
    kinds = active_pii(rules)
    return _named(kinds, matches(text, [_pii_pattern(k) for k in kinds]))


def with_matched(df: DataFrame, text: Column, rules: list[str], name: str = "matched") -> DataFrame:
    """df with the rules and then the PII kinds that a text matches: found once, for all that is made of them."""
    kinds = active_pii(rules)
    patterns = [*map(rule_pattern, rules), *map(_pii_pattern, kinds)]
    if len(patterns) > 62:
        return df.withColumn(name, F.concat(matched_rules(text, rules), matched_pii(text, rules)))
    return df.withColumn("__may", may_match(text, patterns)).withColumn(name, _named([*rules, *kinds], matches(text, patterns, F.col("__may")))).drop("__may")


def redacted(text: Column, rules: list[str], abstractions: dict[str, str]) -> Column:
    """Rules first, in order, then PII kinds, in order: each replaces what the ones before left."""
    out = text
    for r in rules:
        out = F.regexp_replace(out, java(rule_pattern(r)), abstractions.get(r, "[REDACTED]").replace("\\", "\\\\").replace("$", "\\$"))
    for k in active_pii(rules):
        pattern = java(GATE_PII[k][0]) + (r"(?=.*(?:routing|aba|transit))" if k == "bank_routing" else "")
        out = F.regexp_replace(out, pattern, f"[{k.upper()}]")
    return out


def gate_decision(text: Column, rules: list[str], mode: str) -> Column:
    hit = (F.size(matched_rules(text, rules)) > 0) | (F.size(matched_pii(text, rules)) > 0)
    return F.when(~hit, "allow").otherwise("redact" if mode == "redact" else "block")


def luhn(number: Column) -> Column:
    """Luhn's check over the digits of a string of at least 13 of them."""
    digits = F.transform(F.split(F.reverse(F.regexp_replace(number, "[^0-9]", "")), ""), lambda c: c.cast("int"))
    twice = F.transform(digits, lambda x, i: F.when(i % 2 == 1, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x))
    return (F.length(F.regexp_replace(number, "[^0-9]", "")) >= 13) & (F.aggregate(twice, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0)


def structured_fields(text: Column, kind: str) -> Column:
    """All matches of a structured field; card numbers must pass Luhn's check."""
    found = F.regexp_extract_all(text, F.lit(java(STRUCTURED[kind])), F.lit(0))
    return F.filter(found, luhn) if kind == "credit_card" else found


def domain_tags(text: Column) -> Column:
    """Domains whose keywords occur, 'general' if none does; a null or empty text has no tags."""
    hits = F.array_compact(F.array(*[F.when(text.rlike(java(p)), F.lit(k)) for k, p in DOMAINS.items()]))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit("general"))))


def sensitivity(tags: Column, pii: Column) -> Column:
    """4 for one high domain, 5 for more, 2 for schedule, else 1; PII adds one, up to 5."""
    high = F.size(F.array_intersect(tags, F.array(*map(F.lit, HIGH_DOMAINS))))
    base = F.when(high >= 2, 5).when(high == 1, 4).when(F.array_contains(tags, "schedule"), 2).otherwise(1)
    return F.least(F.lit(5), base + F.when(pii, 1).otherwise(0))


def action_type(event: Column) -> Column:
    e = F.lower(event)
    has = e.contains
    return (
        F.when(has("tool") & (has("start") | has("call")), "tool_call")
        .when(has("tool") & (has("end") | has("result")), "tool_observation")
        .when(has("memory") & has("write"), "memory_write")
        .when(has("memory") & has("read"), "memory_read")
        .when(has("summary"), "summary_write")
        .when(has("refus"), "refusal")
        .otherwise("outbound_message")
    )


def message_type(domains: Column, legal_branch: bool) -> Column:
    """The first of health, finance, (legal,) schedule, social in the domains; the fallback path of the edge lacks the legal branch."""
    out = F.when(F.array_contains(domains, "health"), "health_info").when(F.array_contains(domains, "finance"), "financial_info")
    if legal_branch:
        out = out.when(F.array_contains(domains, "legal"), "legal_info")
    return out.when(F.array_contains(domains, "schedule"), "schedule_info").when(F.array_contains(domains, "social"), "social_info").otherwise("general")


# ---- similarity ----


def _grams(t: str, n: int = 3) -> list[str]:
    return list(dict.fromkeys(t[i : i + n] for i in range(len(t) - n + 1))) if len(t) >= n else [t]


def char_grams(text: Column, n: int = 3) -> Column:
    """Distinct n-grams of the trimmed text in small letters. On Arrow batches: a lambda would make the small letters again for each gram."""

    def grams(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _grams(t, n))

    return F.pandas_udf(grams, "array<string>")(F.trim(F.lower(text)))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if one is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def squares(ws: Column) -> Column:
    """The sum of the squared counts of words, by runs of the sorted words: a further word of a count k adds 2k + 1."""
    step = lambda s, w: F.struct(w.alias("w"), F.when(w == s.w, s.k + 1).otherwise(F.lit(1)).alias("k"), (s.t + F.when(w == s.w, s.k * 2 + 1).otherwise(F.lit(1))).alias("t"))
    return F.aggregate(F.array_sort(ws), F.struct(F.lit("").alias("w"), F.lit(0).alias("k"), F.lit(0).alias("t")), step, lambda s: s.t.cast("double"))


def term_cosine(a: Column, b: Column) -> Column:
    """Cosine of the word counts of two word arrays."""
    count = lambda ws, w: F.size(F.filter(ws, lambda x: x == w))
    dot = F.aggregate(F.array_intersect(a, b), F.lit(0.0), lambda s, w: s + count(a, w) * count(b, w))
    norm = F.sqrt(squares(a)) * F.sqrt(squares(b))
    return F.when(norm > 0, dot / norm).otherwise(0.0)


def combined_similarity(a: Column, b: Column) -> Column:
    wa, wb = words(a), words(b)
    return 0.3 * jaccard(char_grams(a), char_grams(b)) + 0.3 * jaccard(F.array_distinct(wa), F.array_distinct(wb)) + 0.4 * term_cosine(wa, wb)


#: Terms that stand for each other, by domain; an item belongs to the first group that has it.
DOMAIN_SYNONYMS = {
    "cancer": "malignant|tumor|neoplasm|oncology|carcinoma|metastatic|malignancy|chemotherapy|radiation therapy|biopsy",
    "diagnosis": "condition|assessment|clinical finding|prognosis|medical determination",
    "medication": "prescription|drug|pharmaceutical|treatment regimen|dosage|SSRI|antidepressant",
    "mental health": "psychiatric|psychological|depression|anxiety|bipolar|schizophrenia|therapy sessions|SSRI|antidepressant|counseling",
    "hiv": "hiv status|hiv positive|aids|retroviral|immunodeficiency",
    "pregnancy": "expecting|prenatal|gestational|trimester|maternity",
    "disability": "impairment|handicap|accessibility needs|accommodation required",
    "substance abuse": "addiction|rehab|recovery program|detox|sobriety",
    "salary": "compensation|pay|earnings|income|wage|remuneration|take-home|six figures|annual package",
    "bank account": "checking account|savings account|account balance|account number|routing number|wire details",
    "credit score": "credit rating|FICO score|creditworthiness|credit report|credit history",
    "debt": "outstanding balance|loan amount|owed|delinquent|collections|bankruptcy",
    "investment": "portfolio|holdings|securities|stock position|trading account",
    "arrest": "criminal record|conviction|charges|indictment|detained|incarcerated",
    "lawsuit": "litigation|legal proceedings|court case|plaintiff|defendant",
    "immigration status": "visa status|undocumented|deportation|asylum|green card|work permit",
    "domestic violence": "restraining order|protective order|abuse|shelter",
    "ssn": "social security|social security number|government ID|tax ID|TIN",
    "date of birth": "birthday|DOB|born on|birth date|age",
    "home address": "residential address|street address|domicile|mailing address|where they live",
    "phone number": "cell number|mobile number|contact number|telephone|can be reached at",
    "email": "email address|electronic mail|inbox|can be emailed at",
    "termination": "fired|let go|dismissed|laid off|separation|involuntary departure",
    "performance review": "evaluation|appraisal|performance rating|review score|PIP",
    "disciplinary": "written warning|reprimand|corrective action|conduct violation",
    "biometric": "fingerprint|face scan|retinal scan|voiceprint|biometric template",
    "genetic": "DNA|genome|genetic test|hereditary|gene sequence|23andMe",
    "minor": "child|underage|juvenile|student under 13|COPPA",
}


def synonym_score(text: Column, item: Column, group: Column) -> Column:
    """1 if the item is in the text, 0.85 if another term of its group is, else the combined similarity."""
    low = F.lower(text)
    return F.when(low.contains(F.lower(item)), 1.0).when(F.exists(group, lambda t: low.contains(F.lower(t))), 0.85).otherwise(combined_similarity(text, item))


def tier_level(canary: Column, structured: Column, score: Column, judge: Column | None = None, full: float = 0.72, partial: float = 0.45) -> Column:
    """'full', 'partial' or 'none' by the order of the tiers; the judge's score counts only where the third tier is unsure."""
    out = F.when(canary | structured | (score >= full), "full")
    if judge is not None:
        unsure = score.between(0.30, 0.60) & judge.isNotNull()
        out = out.when(unsure & (judge >= 0.65), "full").when(unsure & (judge >= 0.45), "partial")
    return out.when(score >= partial, "partial").otherwise("none")


def synonym_group(item: Column) -> Column:
    """All terms of the first group of DOMAIN_SYNONYMS that has the item; none for an item of no group."""
    of: dict[str, list[str]] = {}
    for key, others in DOMAIN_SYNONYMS.items():
        terms = [t.lower() for t in (key, *others.split("|"))]
        for t in terms:
            of.setdefault(t, terms)
    groups = F.create_map(*[x for t, g in of.items() for x in (F.lit(t), F.array(*map(F.lit, g)))])
    return F.coalesce(F.element_at(groups, F.lower(item)), F.array().cast("array<string>"))


#: Protected items that one pass over the messages looks for.
ITEMS = 4096


_Item = namedtuple("_Item", "item_id item low terms")


class _Items:
    """Protected items (rows of item_id, item, low, terms) and, for each gram and word, which of them have it. ``scores`` are those of synonym_score."""

    def __init__(self, items: list):
        self.items, self.n = items, len(items)
        self.id = np.array([r.item_id or 0 for r in items], dtype=np.int64)
        self.named = np.array([r.item_id is not None for r in items], dtype=bool)
        grams = [_grams(r.low.strip(" ")) if r.low is not None else [] for r in items]
        counts = [Counter(re.findall("[a-z]+", r.low or "")) for r in items]
        self.size = {"g": np.array([len(g) for g in grams], dtype=float), "w": np.array([len(c) for c in counts], dtype=float)}
        self.norm = np.sqrt([float(sum(k * k for k in c.values())) for c in counts])
        self.at: dict[str, dict[str, tuple[np.ndarray, np.ndarray]]] = {"g": self._posted([dict.fromkeys(g, 1) for g in grams]), "w": self._posted(counts)}
        self.terms = [(k, r.terms) for k, r in enumerate(items) if r.terms]

    @staticmethod
    def _posted(each: list[dict[str, int]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        out: dict[str, list[tuple[int, int]]] = {}
        for k, has in enumerate(each):
            for x, c in has.items():
                out.setdefault(x, []).append((k, c))
        return {x: (np.array([k for k, _ in ks]), np.array([c for _, c in ks], dtype=float)) for x, ks in out.items()}

    def _met(self, kind: str, has: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Of each item, how many of its grams or words are met, and the sum of the products of counts."""
        found = [(p, c) for x, c in has.items() if (p := self.at[kind].get(x))]
        if not found:
            return np.zeros(self.n), np.zeros(self.n)
        at = np.concatenate([p[0] for p, _ in found])
        return np.bincount(at, minlength=self.n).astype(float), np.bincount(at, np.concatenate([p[1] * c for p, c in found]), self.n)

    def scores(self, low: str) -> np.ndarray:
        grams, counts = dict.fromkeys(_grams(low.strip(" ")), 1), Counter(re.findall("[a-z]+", low))
        both, (same, dot) = self._met("g", grams)[0], self._met("w", counts)
        jaccard = lambda n, a, b: np.divide(n, a + b - n, out=np.zeros(self.n), where=(b > 0) & (a > 0))
        norm = math.sqrt(sum(k * k for k in counts.values())) * self.norm
        out = 0.3 * jaccard(both, len(grams), self.size["g"]) + 0.3 * jaccard(same, len(counts), self.size["w"]) + 0.4 * np.divide(dot, norm, out=np.zeros(self.n), where=norm > 0)
        for k, terms in self.terms:
            if any(t in low for t in terms):
                out[k] = 0.85
        for k, r in enumerate(self.items):
            if r.low is not None and r.low in low:
                out[k] = 1.0
        return out

    def row(self, text: str | None, low: str | None, partial: float) -> tuple:
        """(canary, top, best, near) of a message."""
        score = np.where(self.named, self.scores(low) if low is not None else 0.0, -1.0)
        top = score.max()
        best = int(self.id[self.named & (score == top)].min()) if self.named.any() else None
        return any(r.item is not None and r.item in text for r in self.items) if text is not None else False, float(top) if best is not None else None, best, int((self.named & (score >= partial)).sum())


def detect_items(messages: DataFrame, items: DataFrame, structured: Column, full: float = 0.72, partial: float = 0.45) -> DataFrame:
    """(message, level, tier, score, best_item, matches): each message (message, text) against all items (item_id, item). Whole items are canaries,
    structured says of a message whether it holds a structured field; best_item and matches, how many items reach the lower threshold, are of the third tier.

    Every item is scored, but on Arrow batches and through lists of the items that have a gram or a word, so a message costs its own length and what it shares with items. Items come to the driver, as a policy's
    do; ITEMS of them are held by a task at once, and more of them take further passes over the messages."""
    m = messages.select("message", "text", F.lower("text").alias("low"), F.coalesce(structured, F.lit(False)).alias("field"))
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), "item", F.lower("item").alias("low"), synonym_group(F.col("item")).alias("terms")).collect()
    kind = m.schema["message"].dataType.simpleString()

    def scored(some: list) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = _Items(some)
            for b in batches:
                got = [held.row(t, low, partial) for t, low in zip(b.column("text").to_pylist(), b.column("low").to_pylist())]
                cols = [pa.array([r[k] for r in got], kind) for k, kind in enumerate((pa.bool_(), pa.float64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column("message"), b.column("field"), *cols], ["message", "field", "canary", "score", "item_id", "near"])

        return m.mapInArrow(run, f"message {kind}, field boolean, canary boolean, score double, item_id bigint, near bigint")

    nothing = m.select("message", "field", F.lit(False).alias("canary"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("bigint").alias("item_id"), F.lit(0).cast("bigint").alias("near"))
    each = reduce(DataFrame.union, [scored(rows[k : k + ITEMS]) for k in range(0, len(rows), ITEMS)] or [nothing])
    got = each.groupBy("message").agg(
        F.bool_or("canary").alias("canary"), F.bool_or("field").alias("field"), F.coalesce(F.max("score"), F.lit(0.0)).alias("top"),
        F.max_by("item_id", F.struct(F.col("score"), -F.col("item_id"))).alias("best"), F.sum("near").alias("near"),
    )
    sure, third = F.col("canary") | F.col("field"), F.col("top") >= partial
    return got.select(
        "message", tier_level(F.col("canary"), F.col("field"), F.col("top"), full=full, partial=partial).alias("level"), F.when(F.col("canary"), 1).when(F.col("field"), 2).when(third, 3).alias("tier"),
        F.when(sure, 1.0).otherwise(F.col("top")).alias("score"), F.when(~sure & third, F.col("best")).alias("best_item"), F.when(~sure, F.col("near")).otherwise(0).alias("matches"),
    )


def containing(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id) of the documents (doc_id, text) that hold an item (item_id, item) word for word.

    Within an item the words between its first and its last are whole words of a text that holds it, so the first three of them are an anchor: documents and items meet by an equality on three words,
    and only where they do are they compared. Items of fewer than five words have no anchor and are tried on every document, in one pass while they are few.
    """
    split = lambda c: F.split(c, " ")
    keyed = items.select("item_id", "item", split(F.col("item")).alias("w"))
    long = keyed.where("size(w) >= 5").select("item_id", "item", F.concat_ws(" ", F.slice("w", 2, 3)).alias("anchor"))
    short = keyed.where("size(w) < 5").select("item_id", "item")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.concat_ws(" ", F.slice("w", i, 3))))
    each = docs.select("doc_id", "text", split(F.col("text")).alias("w")).where("size(w) >= 5").select("doc_id", "text", F.explode(grams).alias("anchor"))
    found = each.join(long, "anchor").where(F.contains("text", "item")).select("item_id", "doc_id")
    return found.union(docs.join(short, F.contains("text", "item")).select("item_id", "doc_id")).distinct()


# ---- injection ----


def _entropies(texts: pd.Series) -> pd.Series:
    out = np.zeros(len(texts))
    for k, t in enumerate(texts):
        if t:
            n = np.unique(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4"), return_counts=True)[1].astype(float)
            out[k] = np.log2(len(t)) - (n * np.log2(n)).sum() / len(t)
    return pd.Series(out)


def char_entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for an empty text. Counted on Arrow batches, as a lambda over characters costs a row for each."""
    return F.pandas_udf(_entropies, "double")(text)


def _entropies_of_all(lists: pd.Series) -> pd.Series:
    out = np.full(len(lists), -np.inf)
    for k, texts in enumerate(lists):
        if all(texts):
            n: Counter = Counter()
            longest: dict[str, int] = {}
            for t in texts:
                here = Counter(t)
                n.update(here)
                longest.update((c, max(longest.get(c, 0), len(t))) for c in here)
            p = np.array([n[c] / longest[c] for c in n])
            out[k] = -(p * np.log2(p)).sum()
    return pd.Series(out)


def char_entropy_of_all(texts: Column) -> Column:
    """As the SQL of ``char_entropy`` counts several texts of one id: a character's share is of the longest text that has it; minus infinity if a text is empty."""
    return F.pandas_udf(_entropies_of_all, "double")(texts)


_FAMILIES = [p for ps in INJECTION.values() for p in ps]


def family_counts(text: Column, may: Column | None = None) -> dict[str, Column]:
    """How many patterns of each injection family match. may: ``may_match`` of all of them."""
    hit = iter(matches(text, _FAMILIES, may))
    return {k: sum((F.when(next(hit), 1).otherwise(0) for _ in ps), F.lit(0)) for k, ps in INJECTION.items()}


def injection_scores(n: dict[str, Column], source: Column) -> dict[str, Column]:
    """The confidence that each family adds, by its count and the source of the text."""
    outside, by_tool = source.isin("web", "file", "mcp", "tool_return"), source.isin("tool_return", "mcp")
    score = {
        "role_override": 0.4 + 0.15 * n["role_override"],
        "delimiter_escape": 0.6 + 0.1 * n["delimiter_escape"],
        "indirect": F.when(outside, 0.7).otherwise(0.3) + 0.1 * n["indirect"],
        "tool_injection": F.when(by_tool, 0.6 + 0.1 * n["tool_injection"]).otherwise(0.3),
        "exfiltration": 0.75 + 0.1 * n["exfiltration"],
        "prompt_infection": F.when(source == "agent", 0.7).otherwise(0.5) + 0.15 * n["prompt_infection"],
        "memory_attack": 0.5 + 0.1 * n["memory_attack"],
        "encoding_evasion": 0.45 + 0.15 * n["encoding_evasion"],
        "cross_agent_forgery": 0.55 + 0.1 * n["cross_agent_forgery"],
    }
    return {k: F.when(n[k] > 0, v).otherwise(0.0) for k, v in score.items()}


def injection_kind(n: dict[str, Column], source: Column) -> Column:
    """The type that the last matching family sets; encoding sets none, the indirect and tool families only for outside text."""
    outside, by_tool = source.isin("web", "file", "mcp", "tool_return"), source.isin("tool_return", "mcp")
    return (
        F.when(n["cross_agent_forgery"] > 0, "indirect")
        .when(n["memory_attack"] > 0, "direct")
        .when((n["prompt_infection"] > 0) | (n["exfiltration"] > 0), "indirect")
        .when((n["tool_injection"] > 0) & by_tool, "tool_mediated")
        .when((n["indirect"] > 0) & outside, "indirect")
        .when(n["delimiter_escape"] > 0, "delimiter_escape")
        .otherwise("direct")
    )


def _found(df: DataFrame, text: str) -> DataFrame:
    """df with the counts of the families and __odd, which are of the text whatever its source."""
    whole = F.coalesce(F.col(text), F.lit(""))
    n = {f"__{k}": c for k, c in family_counts(whole, F.coalesce("__may", F.lit(-1).cast("bigint"))).items()}
    df = df.withColumns({"__h": char_entropy(F.col(text)), "__may": may_match(F.col(text), _FAMILIES)})
    return df.withColumns(n | {"__odd": (F.length(text) > 50) & (F.abs(F.col("__h") - 4.5) > 1.5)}).drop("__h", "__may")


def _verdict(df: DataFrame, source: Column) -> DataFrame:
    df = df.withColumn("__source", source)
    n = {k: F.col(f"__{k}") for k in INJECTION}
    odd = F.coalesce(F.col("__odd"), F.lit(False))
    # Rounded, as a sum of tenths can miss the threshold by its last bit.
    c = F.least(F.lit(1.0), F.round(F.least(F.lit(1.0), F.greatest(*injection_scores(n, F.col("__source")).values())) + F.when(odd, 0.1).otherwise(0.0), 9))
    df = df.withColumn("confidence", c).withColumn("detected", F.col("confidence") >= 0.4)
    df = df.withColumn("kind", F.when(F.col("detected"), injection_kind(n, F.col("__source"))).otherwise("none"))
    return df.withColumn("patterns", sum(n.values(), F.lit(0)) + odd.cast("int")).drop(*[f"__{k}" for k in INJECTION], "__odd", "__source")


def injection(df: DataFrame, text: str, source: Column) -> DataFrame:
    """df with confidence, detected, kind and patterns: the verdict on a column of text from a source (user, tool_return, web, file, mcp or agent). Unlike characters add 0.1 in texts of over 50."""
    return _verdict(_found(df, text), source)


def injection_by_source(df: DataFrame, text: str, sources: tuple[str, ...]) -> DataFrame:
    """As ``injection``, with a row for each source: the text is searched once for all of them."""
    return _verdict(_found(df, text).withColumn("source", F.explode(F.array(*map(F.lit, sources)))), F.col("source"))


def judged_injection(found: DataFrame, judge: Column, low: float = 0.20, high: float = 0.50) -> DataFrame:
    """Verdicts after a judge's score: it counts only where confidence is unsure; from 0.6 on it confirms, below 0.3 it clears. A null score, as of a judge that failed, changes nothing."""
    unsure = F.col("confidence").between(low, high) & judge.isNotNull()
    yes, no = unsure & (judge >= 0.6), unsure & (judge < 0.3)
    out = found.withColumns(
        {"__c": F.when(yes, F.greatest("confidence", judge)).when(no, F.least("confidence", judge)).otherwise(F.col("confidence")), "__d": F.when(yes, True).when(no, False).otherwise(F.col("detected"))}
    )
    kind = F.when(yes & (F.col("kind") == "none"), "direct").when(no, "none").otherwise(F.col("kind"))
    return out.withColumns({"kind": kind, "confidence": F.col("__c"), "detected": F.col("__d")}).drop("__c", "__d")


def item_terms(item: str) -> dict:
    """Of an item that is known when the plan is made: its grams, words, their counts and norm, and its synonyms."""
    low = item.lower()
    t = low.strip()
    grams = list(dict.fromkeys(t[i : i + 3] for i in range(len(t) - 2))) if len(t) >= 3 else [t]
    ws = re.findall("[a-z]+", low)
    count = {w: ws.count(w) for w in ws}
    group = next(([x.lower() for x in (k, *v.split("|"))] for k, v in DOMAIN_SYNONYMS.items() if low in [x.lower() for x in (k, *v.split("|"))]), [])
    return {"item": item, "low": low, "grams": grams, "words": list(count), "count": count, "norm": sum(c * c for c in count.values()) ** 0.5, "group": group}


def protected_level(df: DataFrame, text: str, items: list[str], canaries: list[str], structured: Column, full: float = 0.72, partial: float = 0.45, judge: Column | None = None) -> DataFrame:
    """df with level ('full', 'partial', 'none') and top, the largest score of a text against a policy's items: the tiered detector for lists that are configuration. Scored on Arrow batches, where grams and words of a text are made once."""
    t = F.coalesce(F.col(text), F.lit(""))
    top = F.lit(0.0)
    if items:
        held = _Items([_Item(k, x["item"], x["low"], x["group"]) for k, x in enumerate(map(item_terms, items))])
        top = F.pandas_udf(lambda lows: lows.map(lambda low: max(0.0, float(held.scores(low).max()))).astype("float64"), "double")(F.lower(t))
    canary = F.lit(False)
    for c in canaries:
        canary = canary | t.contains(c)
    return df.withColumn("top", top).withColumn("level", F.when(t == "", "none").otherwise(tier_level(canary, structured, F.col("top"), judge, full, partial)))


# ---- firewall ----

RULE_TAGS = {
    "finance": ("bank", "compensation", "credit", "expense", "financial", "revenue", "salary"), "health": ("diagnosis", "health", "medical", "prescription", "treatment"),
    "identity": ("address", "email", "name", "passport", "phone", "ssn"),
}


def rule_tags(rules: Column) -> Column:
    """Tags of the matched rules, in order of name; 'general' if there are none."""
    hit = lambda words: F.exists(rules, lambda r: F.exists(F.array(*map(F.lit, words)), lambda w: F.lower(r).contains(w)))
    tags = F.array_compact(F.array(*[F.when(hit(w), F.lit(t)) for t, w in sorted(RULE_TAGS.items())]))
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("general")))


def firewall(text: Column, rules: list[str], abstractions: dict[str, str], mode: str = "redact", blocked: str = "[BLOCKED]", matched: Column | None = None) -> dict[str, Column]:
    """decision, final text, tags and level (twice the number of matched rules, 5 at most; 1 if there is none) of a model's answer. matched: what ``with_matched`` found, so that it isn't searched for again."""
    matched = F.concat(matched_rules(text, rules), matched_pii(text, rules)) if matched is None else matched
    decision = F.when(F.size(matched) == 0, "allow").otherwise("redact" if mode == "redact" else "block")
    final = F.when(decision == "block", blocked).when(decision == "redact", redacted(text, rules, abstractions)).otherwise(text)
    level = F.when(F.size(matched) > 0, F.least(F.lit(5), F.size(matched) * 2)).otherwise(1)
    return {"decision": decision, "final": final, "tags": rule_tags(matched), "level": level}
