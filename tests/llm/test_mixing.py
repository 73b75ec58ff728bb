import hashlib
import math
import re
from collections import Counter

from auditloom.llm import mixing
from tests.llm.cases import docs, plain, prose


def brute(rows, labels, budget=None, temperature=mixing.TEMPERATURE, seed=mixing.SEED):
    """(doc_id, source) -> copies, by sorting every source."""
    weight = {}
    for i, q, t in labels:
        if i is not None:
            old = weight.get(i, (None, None))
            weight[i] = tuple(max((x for x in p if x is not None), default=None) for p in ((old[0], q), (old[1], t)))
    by = {}
    for i, text, source in rows:
        n = len(re.findall(r"[^ \t\n\r]+", text or ""))
        q, t = weight.get(i, (None, None))
        w = {1: 2.0, 0: 0.5}.get(q, 1.0) * (0.25 if t == 1 else 1.0)
        u = (int(hashlib.md5(f"{seed}:{'~' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        by.setdefault(source, []).append((-math.log(u) / w, i is not None, i or 0, n, i))
    have = {s: sum(r[3] for r in rs) for s, rs in by.items()}
    total, share = sum(have.values()) if budget is None else budget, sum(h**temperature for h in have.values())
    out = Counter()
    for s, rs in by.items():
        target = math.floor(total * have[s] ** temperature / share) if share else 0
        epochs = target // have[s] if have[s] else 0
        rest, upto = target - epochs * have[s], 0
        for r in sorted(rs):
            upto += r[3]
            out[r[4], s] += epochs + (upto <= rest)
    return out


def data():
    out = [(i, prose(i, 5 + i % 37), ["web", "web", "web", "books", "code", None][i % 6]) for i in range(400)]
    return out + [(None, prose(1, 9), "web"), (1000, None, "web"), (1001, "", "empty"), (1002, " \n", "empty")]


LABELS = [(i, i % 3 == 0, i % 7 == 0) for i in range(0, 400, 2)] + [(0, None, None), (None, 1, 0), (6, 0, 1)]
LABELS = [(i, None if q is None else int(q), None if t is None else int(t)) for i, q, t in LABELS]


def frames(spark, rows=None):
    d = spark.createDataFrame(data() if rows is None else rows, "doc_id long, text string, source string")
    return d, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_same_as_sorting_each_source(spark):
    d, l = frames(spark)
    for budget in (None, 1000, 50_000):
        for buckets in (4, 4096):
            got = Counter()
            for r in mixing.report(d, l, budget=budget, buckets=buckets).collect():
                got[r.doc_id, r.source] += r.copies
            assert got == brute(data(), LABELS, budget)


def test_mixture_meets_its_targets_and_repeats_whole_epochs(spark):
    d, l = frames(spark)
    took = mixing.mix(d, l, budget=50_000).groupBy("doc_id", "source").count().collect()
    want = {k: v for k, v in brute(data(), LABELS, 50_000).items() if v}
    assert {(r.doc_id, r.source): r["count"] for r in took} == want
    assert min(n for (_, source), n in want.items() if source != "empty") >= 2  # whole epochs came first


def test_all_cases_and_columns_of_the_same_names(spark):
    df = docs(spark)
    _, l = frames(spark)
    out = mixing.mix(df, l)
    assert out.columns == df.columns
    assert {r["__mix_n"] for r in out.collect()} <= {"?"}
    assert mixing.report(df, l).count() == df.count()


def test_equal_rows_share_ties_by_rule(spark):
    rows = [(1, "a b c", "s")] * 5
    got = mixing.report(plain(spark, [(1, "a b c")] * 5), None).collect()
    assert len(got) == len(rows) and {r.copies for r in got} == {1}


def test_empty_tables(spark):
    d, l = frames(spark, [])
    assert mixing.mix(d, l).count() == 0 and mixing.report(d, l).count() == 0
    d, _ = frames(spark)
    assert mixing.report(d, l.limit(0)).count() == len(data())
