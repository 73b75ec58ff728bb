import hashlib
import hmac
import json

from pyspark.sql import functions as F

from auditloom.functions import noise
from auditloom.operators import commitments, memory, privacy, tenants
from auditloom.sources import html_report, policies, wire


def test_policies_are_loaded_validated_and_saved(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.json").write_text(json.dumps({"agent_id": "a", "must_not_share": ["ssn", "x"], "acceptable_abstractions": {"ssn": "[ID]", "dob": "[AGE]"}, "sensitivity_threshold": 7}, indent=1))
    (d / "b.json").write_text("{not json")
    (d / "c.json").write_text(json.dumps({"agent_id": "", "must_not_share": []}))
    got = {r.agent_id: r.warnings for r in policies.validate(policies.load_json(spark, str(d))).collect()}
    assert got == {"a": ["threshold above 5: nothing is blocked", "short term: x", "abstraction without a rule: dob"], "": ["agent_id is empty", "nothing is blocked"]}
    policies.save(policies.load_json(spark, str(d)), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_bad_policy_files_are_named(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"agent_id": "a", "must_not_share": ["ssn"]}))
    (tmp_path / "b.json").write_text("{not json")
    (tmp_path / "c.json").write_text("{}")
    good, bad = policies.load_folder(spark, str(tmp_path))
    assert [r.agent_id for r in good.collect()] == ["a"] and {(r.file, r.warning) for r in bad.collect()} == {("b.json", "not JSON"), ("c.json", "no agent_id")}


def test_every_kind_travels_both_ways(spark):
    risks = "array(named_struct('risk_type', 'r', 'agents', array('a'), 'edges', array('e'), 'severity', 0.5D, 'source_domain', 'health', 'target_domain', '', 'scenario', 'CD', 'blame_agent', 'a'))"
    rows = {
        "edge": spark.sql("select 'e' edge_id, 'a' from_agent, array('health') domains, named_struct('domains', array('x'), 'max_sensitivity', 3) taint"),
        "result": spark.sql(f"select 'x' audit_id, 2 total_agents, {risks} risks, map('a', 0.5D) agent_scores, map('CD', 1) scenario_summary"),
        "challenge": spark.sql("select 'c' challenger_id, 't' trace_id, array('e') entry_ids"), "incident": spark.sql("select 'i' incident_id, 'high' alert_level, array('a') agents, 0.5D severity"),
    }
    for kind, df in rows.items():
        good, bad = wire.deserialize(wire.serialize(df, kind).select("body").union(spark.sql("select '{}'")), kind=kind)
        assert bad.count() == 1
        again, none = wire.deserialize(wire.serialize(good, kind), kind=kind)
        assert again.collect() == good.collect() and len(again.collect()) == 1 and none.count() == 0
        for c in df.columns:
            if c != "taint":
                assert good.first()[c] == df.first()[c]


def test_scan_and_command_line(spark, tmp_path, monkeypatch, capsys):
    from auditloom import __main__ as cli

    got = {r.text: (r.decision, r.final) for r in cli.scan(spark.createDataFrame([("my ssn is here",), ("fine",), (None,)], "text string"), ["ssn"]).collect()}
    assert got["my ssn is here"] == ("redact", "my [REDACTED] is here") and got["fine"] == ("allow", "fine")
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    spark.createDataFrame([("my ssn",)], "text string").write.parquet(f"{tmp_path}/in")
    assert cli.main(["scan", "ssn", f"{tmp_path}/in", f"{tmp_path}/out"]) == 0 and spark.read.parquet(f"{tmp_path}/out").first().decision == "redact"
    assert cli.main(["version"]) == 0 and cli.main(["list"]) == 0 and "alert_levels" in capsys.readouterr().out and cli.main(["nonsense"]) == 2


def test_wire_round_trip_and_rejects(spark):
    body = json.dumps({"agent_id": "a", "report_id": "r", "timestamp": "2024-01-01T00:00:00Z", "edges": [{"edge_id": "e", "domains": ["health"], "sensitivity_level": 3}], "leakage_rate": 0.5})
    good, bad = wire.deserialize(spark.createDataFrame([(body,), ("nonsense",), ("{}",), (None,)], "body string"))
    assert good.count() == 1 and bad.count() == 3
    again, none = wire.deserialize(wire.serialize(good))
    assert again.collect() == good.collect() and none.count() == 0
    assert [r.edge_id for r in wire.edges_of(good).collect()] == ["e"]


def test_external_traces_of_any_layout(spark):
    lines = [{"from_agent": "a", "to_agent": "b", "content": "x", "label": 1}, {"sender": "a", "recipient": "b", "message": "y", "is_leak": True}, {"src": "a", "dst": "b", "text": "z"}, {"src": "a"}]
    got = wire.external_traces(spark.createDataFrame([(json.dumps(x),) for x in lines], "value string")).collect()
    assert sorted((r.source, r.target, r.content, r.leak) for r in got) == [("a", "b", "x", True), ("a", "b", "y", True), ("a", "b", "z", False)]


def test_html_is_escaped(spark):
    page = html_report.render("t", {"s": spark.createDataFrame([("<script>",)], "x string")})
    assert "<script>" not in page and "&lt;script&gt;" in page


def test_hmac_is_the_standard_one(spark):
    for key in (b"k", b"k" * 64, b"k" * 100):
        got = spark.createDataFrame([("msg é",)], "m string").select(commitments.hmac_sha256(key, F.col("m")).alias("h")).first().h
        assert got == hmac.new(key, "msg é".encode(), hashlib.sha256).hexdigest()


def test_merkle_of_each_size_against_a_loop(spark):
    def root(items):
        level = [hashlib.sha256(x.encode()).hexdigest() for x in items]
        while len(level) > 1:
            level = [hashlib.sha256((level[i] + (level[i + 1] if i + 1 < len(level) else level[i])).encode()).hexdigest() for i in range(0, len(level), 2)]
        return level[0]

    df = spark.createDataFrame([(n, i, f"{n}-{i}") for n in (1, 2, 3, 5, 8, 13) for i in range(n)], "g int, o int, x string")
    assert {r.g: r.root for r in commitments.merkle_roots(df, "g", ["o"], "x").collect()} == {n: root([f"{n}-{i}" for i in range(n)]) for n in (1, 2, 3, 5, 8, 13)}
    p = commitments.merkle_proofs(df, "g", ["o"], "x")
    assert p.where(commitments.verify_proof(F.col("leaf"), F.col("proof"), F.col("root"))).count() == 32
    assert p.where(commitments.verify_proof(F.sha2(F.lit("other"), 256), F.col("proof"), F.col("root"))).count() == 0


def test_noise_has_the_right_spread(spark):
    u = noise.uniform("s", F.col("id"))
    r = spark.range(40_000).select(F.avg(noise.laplace(u, 2.0)).alias("m"), F.stddev(noise.laplace(u, 2.0)).alias("d"), F.avg(noise.response(F.lit(True), u, 1.0).cast("int")).alias("p")).first()
    assert abs(r.m) < 0.06 and abs(r.d - 2 * 2**0.5) < 0.1 and abs(r.p - noise.truth_share(1.0)) < 0.01


def test_budget_refuses_what_does_not_fit_and_goes_on(spark):
    df = spark.createDataFrame([("a", 1, 0.6), ("a", 2, 0.6), ("a", 3, 0.4), ("b", 1, 2.0)], "owner string, seq int, epsilon double")
    assert {r.owner: (r.granted, r.refused, round(r.spent, 9)) for r in privacy.budget_ledger(df, 1.0).collect()} == {"a": (2, 1, 1.0), "b": (0, 1, 0.0)}


def test_memory_patterns(spark):
    rows = [(1, "memory_write", "ignore previous instruction and pretend", ""), (2, "memory_read", "", "dump memory"), (3, "memory_write", "", "the password"), (4, "memory_write", "hello", ""), (5, "tool_call", "password", ""), (6, "memory_write", None, None)]
    df = spark.createDataFrame([(i, "a", act, o, n) for i, act, o, n in rows], "entry_id int, agent string, action string, output_text string, input_text string")
    got = {r.entry_id: (r.kind, r.matches, round(r.severity, 6)) for r in memory.memory_findings(df).collect()}
    assert got == {1: ("injection_attempt", 2, 0.7), 2: ("extraction_probe", 1, 0.5), 3: ("injection_attempt", 1, 0.45)}


def test_tags_of_stated_and_hinted_terms(spark):
    df = spark.createDataFrame([("appointment at the oncology ward",), ("diagnosed at the clinic, please",), ("lunch",)], "t string")
    got = [(r.category, r.inferred, r.strong) for r in df.select(*[v.alias(k) for k, v in memory.lexical_tags(F.col("t")).items()]).collect()]
    assert got == [([], ["health"], ["health"]), (["health"], [], []), ([], [], [])]


def test_two_uniform_fragments_fire():
    assert tenants.fragments_to_fire() == 2
