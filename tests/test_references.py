"""Samples of offending keys in results and reports."""

import hashlib
import re

from proofline.functions.refs import SLOTS
from proofline.plans.assessments import Assessments
from proofline.plans.report import build_report, write_report
from proofline.plans.runner import run_assessments, write_results
from proofline.sources.catalog import EvidenceCatalog
from tests.conftest import NOW, day, frame, good_rows

SCOPE = {"tenant_id": "acme", "environment": "prod"}


def who(spark, tier="high_privilege"):
    return Assessments.of(spark, [{**SCOPE, "tier": tier, "as_of": NOW, "window_days": 30}])


def catalog(spark, rows, parts=None):
    made = {t: frame(spark, t, r) for t, r in rows.items()}
    return EvidenceCatalog(spark, {t: df.repartition(parts) if parts else df for t, df in made.items()})


def lowest_per_slot(refs):
    best = {}
    for ref in set(refs):
        h = hashlib.md5(ref.encode()).hexdigest()
        slot = int(h[:4], 16) % SLOTS
        best[slot] = min(best.get(slot, (h, ref)), (h, ref))
    return [ref for _, ref in sorted(best.values())]


def with_faults():
    rows = good_rows()
    at = {**SCOPE, "time": day(12)}
    bare = {"originating_identity": "gw", "agent_instance_id": "agent-0", "identity_verified": 0}
    rows["tool_requests"] += [{**at, **bare, "request_hash": f"x{i % 40}"} for i in range(90)]
    rows["tool_requests"].append({**at, **bare, "request_hash": None})
    return rows


def refs_of(results):
    return {r["check_id"]: r["evidence_refs"] for r in results.collect()}


def test_sample_is_of_the_offending_keys_and_stable(spark):
    rows = with_faults()
    got = refs_of(run_assessments(catalog(spark, rows), who(spark), ["Check01", "Check03", "Check04", "Check10"]))
    want = lowest_per_slot([f"tool_requests/x{i}" for i in range(40)] + ["tool_requests/"])
    assert got["Check01"] == got["Check03"] == got["Check04"] == want and len(want) == SLOTS
    assert got["Check10"] == []
    for parts in (1, 9):
        again = run_assessments(catalog(spark, rows, parts), who(spark), ["Check01", "Check03", "Check04", "Check10"])
        assert refs_of(again) == got


def test_no_further_scan_and_no_sort(spark, good):
    def plan(refs):
        result = run_assessments(good, who(spark), refs=refs)
        return result._jdf.queryExecution().executedPlan().toString()

    scans = lambda text: len(re.findall(r"Scan |LocalTableScan", text))
    assert scans(plan(True)) == scans(plan(False))
    assert "md5" in plan(True) and "md5" not in plan(False)
    # Sorts by group would be of all rows; those of the ledger's and cadence's order remain.
    assert plan(True).count("SortAggregate") == plan(False).count("SortAggregate")


def test_results_and_report_carry_them(spark, tmp_path):
    cat = catalog(spark, with_faults())
    results = write_results(spark, cat, who(spark), str(tmp_path / "results"), ["Check01", "Check03", "Check07"])
    told = refs_of(results)
    assert len(told["Check01"]) == SLOTS and told["Check07"] == []
    report = build_report(results, who(spark), NOW)
    write_report(report, str(tmp_path / "report"))
    (checks,) = [r["checks"] for r in spark.read.json(str(tmp_path / "report")).collect()]
    by_id = {c["check_id"]: c for c in checks}
    assert by_id["Check03"]["evidence_refs"] == told["Check03"]
    assert by_id["Check07"]["evidence_refs"] is None


def test_skipped_and_failed_checks_have_none(spark):
    def without(table):
        rows = good_rows()
        del rows[table]
        return catalog(spark, rows)

    got = refs_of(run_assessments(without("tool_requests"), who(spark, "sandbox"), ["Check01", "Check02"]))
    assert got == {"Check01": None, "Check02": None}
    assert set(refs_of(run_assessments(without("abom"), who(spark), ["Check03"], refs=False)).values()) == {None}


def test_rollup_in_one_exchange(spark, good):
    from proofline.plans.report import rollup

    two = Assessments.of(spark, [{**SCOPE, "tier": "high_privilege", "as_of": NOW}, {**SCOPE, "tenant_id": "none", "tier": "bounded", "as_of": NOW}])
    results = run_assessments(good, two, ["Check03", "Check12"], refs=False)
    stored = spark.createDataFrame(results.collect(), results.schema)
    got = {(r.tenant_id, r.environment, r.metric): (r.value, r.level) for r in rollup(stored).collect()}
    assert got[None, None, "count_tool_requests_total"] == (5, 6)
    assert got["acme", "prod", "count_tool_requests_total"] == (5, 0) and got["none", None, "count_tool_requests_total"] == (0, 2)
    assert not any("semantic" in k[2] for k in got)
    assert rollup(stored)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
