"""python -m auditloom list | run NAME SF_DIR OUT | scan TERMS IN OUT | validate POLICIES | report SF_DIR OUT.html | demo SF_DIR | version. TERMS are joined by commas, IN and OUT are Parquet tables with a column text. Runs in the session that spark-submit gives, or a local one."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom import __version__, registry
from auditloom.operators import text
from auditloom.session import local_session
from auditloom.sources import html_report, policies

USAGE = __doc__


def scan(texts: DataFrame, terms: list[str], mode: str = "redact") -> DataFrame:
    """texts with the decision of a gate that protects some terms, what it matched, and the text that may leave."""
    f = text.firewall(F.col("text"), terms, {}, mode)
    return texts.select("*", f["decision"].alias("decision"), F.concat(text.matched_rules(F.col("text"), terms), text.matched_pii(F.col("text"), terms)).alias("matched"), f["final"].alias("final"))


def main(argv: list[str]) -> int:
    match argv:
        case ["version"]:
            print(__version__)
        case ["list"]:
            print(*sorted(registry.queries()), sep="\n")
        case ["run", name, sf_dir, out]:
            registry.queries()[name](local_session(), sf_dir).write.mode("error").parquet(out)
        case ["scan", terms, source, out]:
            scan(local_session().read.parquet(source), terms.split(",")).write.mode("error").parquet(out)
        case ["demo", sf_dir]:
            registry.flagship(local_session(), sf_dir).orderBy("alert_level", "risk_type").show(100, False)
        case ["validate", path]:
            good, skipped = policies.load_folder(local_session(), path)
            for r in skipped.toLocalIterator():
                print(r["file"], r["warning"], sep="\t", file=sys.stderr)
            bad = policies.validate(good).where("size(warnings) > 0").select("agent_id", "warnings").toLocalIterator()
            found = 0
            for r in bad:
                found += 1
                print(r["agent_id"], *r["warnings"], sep="\t")
            return int(found > 0)
        case ["report", sf_dir, out]:
            spark = local_session()
            sections = {n: registry.queries()[n](spark, sf_dir) for n in ("alert_levels", "scenario_summary", "incident_summary", "blame_reasons", "topology_summary", "compliance_by_regulation", "compliance_scores")}
            with open(out, "w", encoding="utf-8") as f:
                f.write(html_report.render("Audit report", sections))
        case _:
            print(USAGE, file=sys.stderr)
            return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
