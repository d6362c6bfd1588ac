"""Runs checks for all assessments: metrics first, verdicts after."""

from __future__ import annotations

import logging
from collections.abc import Iterable

import pyarrow as pa
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.functions.vocab import ERROR, SKIP
from proofline.operators.metrics import RIGHT_SCOPED, SHAPED, ref_column, table_counts
from proofline.plans import checks as specs
from proofline.plans.assessments import Assessments
from proofline.plans.checks import Check
from proofline.sources.catalog import EvidenceCatalog, MissingTable

KEY = Assessments.KEY
log = logging.getLogger(__name__)


class Parts:
    """The aggregates behind a set of checks, each built once.

    Counts wanted by several checks from one table share one pass over it.
    """

    def __init__(
        self, cat: EvidenceCatalog, assessments: Assessments, scope_right: bool = False, refs: bool = False
    ):
        self._options = dict.fromkeys(RIGHT_SCOPED, {"scope_right": True}) if scope_right else {}
        self._cat = cat
        self._assessments = assessments
        self._refs = refs
        self._built: dict[tuple, DataFrame] = {}

    def _build(self, kind: str, columns: tuple[str, ...], refs: tuple[str, ...] = ()) -> DataFrame:
        if (kind, columns, refs) not in self._built:
            if kind in SHAPED:
                part = SHAPED[kind][0](
                    self._cat, self._assessments, **self._options.get(kind, {})
                )
            else:
                part = table_counts(self._cat, self._assessments, kind, columns, refs)
            self._built[kind, columns, refs] = part
        return self._built[kind, columns, refs]

    def _samples(self, checks: Iterable[Check], kind: str) -> tuple[str, ...]:
        if not self._refs:
            return ()
        return tuple(dict.fromkeys(n for c in checks for n in c.refs.get(kind, ())))

    @staticmethod
    def _needs(checks: Iterable[Check]) -> dict[str, tuple[str, ...]]:
        needs: dict[str, dict[str, None]] = {}
        for check in checks:
            for table, names in check.counts.items():
                needs.setdefault(table, {}).update(dict.fromkeys(names))
            for name in check.shaped:
                needs.setdefault(name, {}).update(dict.fromkeys(SHAPED[name][1]))
        return {kind: tuple(names) for kind, names in needs.items()}

    def failure(self, check: Check) -> str | None:
        """Why the check cannot be analysed on this store, if it cannot."""
        try:
            for kind, columns in self._needs([check]).items():
                self._build(kind, columns, self._samples([check], kind))
        except (MissingTable, PySparkException) as exc:
            return f"{type(exc).__name__}: {str(exc).splitlines()[0]}"
        return None

    def failures(self, checks: list[Check]) -> dict[str, str | None]:
        try:
            for kind, columns in self._needs(checks).items():
                self._build(kind, columns, self._samples(checks, kind))
        except (MissingTable, PySparkException):
            return {c.check_id: self.failure(c) for c in checks}
        return dict.fromkeys((c.check_id for c in checks))

    def wide(self, checks: Iterable[Check]) -> DataFrame:
        """One row per assessment with every raw count the checks need, and if asked for
        a map ``refs`` from the name of a count to a sample of the keys behind it.

        Each aggregate gives at most one row per assessment; they are stacked
        and folded by one grouping instead of being joined one by one.
        """
        checks = list(checks)
        needs = self._needs(checks)
        frame = self._assessments.frame
        empty = "cast(map() as map<string,array<string>>) as refs"
        if not needs:
            return frame.selectExpr("*", *([empty] if self._refs else []))
        none = "cast(null as array<string>)"
        # Every assessment gets a row, also where no evidence is in scope.
        layers = [frame.selectExpr(KEY, "'' as name", "0L as n", *([f"{none} as refs"] if self._refs else []))]
        for kind, columns in needs.items():
            told = self._samples(checks, kind)
            rows = [f"'{n}', cast({n} as bigint)" + f", {none}" * self._refs for n in columns]
            rows += [f"'{n}', cast(null as bigint), {ref_column(n)}" for n in told]
            layers.append(
                self._build(kind, columns, told).selectExpr(
                    KEY, f"stack({len(rows)}, {', '.join(rows)}) as (name, n{', refs' * self._refs})"
                )
            )
        while len(layers) > 1:  # pairwise, so no plan is analysed over and over
            layers = [
                layers[i].union(layers[i + 1]) if i + 1 < len(layers) else layers[i]
                for i in range(0, len(layers), 2)
            ]
        # Bounded groups: one entry per raw count or sample.
        entry = "map_from_entries(collect_list(struct(name, {0})) filter (where name <> '' and {0} is not null)) as {1}"
        folded = layers[0].groupBy(KEY).agg(
            F.expr(entry.format("n", "raw")), *([F.expr(entry.format("refs", "refs"))] if self._refs else [])
        )
        return folded.join(self._assessments.wide_side(), KEY).selectExpr(
            *frame.columns,
            *[f"coalesce(raw['{n}'], 0) as {n}" for cols in needs.values() for n in cols],
            *(["refs"] if self._refs else []),
        )


def check_metrics(cat: EvidenceCatalog, assessments: Assessments, check_id: str) -> DataFrame:
    """The metrics of one check, one row per assessment."""
    (check,) = specs.chosen([check_id])
    columns = dict(check.metrics)
    if check_id == "Check17":
        columns |= {
            "enforced_dimensions": specs.ENFORCED,
            "required_dimensions": specs.REQUIRED,
            "missing_enforcement": specs.MISSING,
        }
    return Parts(cat, assessments).wide([check]).selectExpr(
        KEY, "tenant_id", "environment", "tier",
        *[f"{expr} as {name}" for name, expr in columns.items()],
    )


def check_catalog(spark: SparkSession) -> DataFrame:
    """The registered checks with their class, control, title and tiers."""
    columns = ("check_id", "classification", "title", "control")
    data = {c: [getattr(k, c) for k in specs.CHECKS] for c in columns}
    data["tiers"] = [list(k.tiers) for k in specs.CHECKS]
    return spark.createDataFrame(pa.table(data))


def manual_steps(spark: SparkSession) -> DataFrame:
    """Proof owed per check and tier, in order: what a count cannot show."""
    rows = [
        {"check_id": c.check_id, "tier": tier, "step": step, "expected_artifact": proof, "rationale": limit}
        for c in specs.CHECKS
        for tiers, limit, step, proof in specs.OPEN_QUESTIONS.get(c.check_id, ())
        for tier in tiers
    ]
    schema = "check_id string, tier string, step string, expected_artifact string, rationale string"
    return step_lists(spark.createDataFrame([tuple(r.values()) for r in rows], schema))


def step_lists(steps: DataFrame) -> DataFrame:
    """A table of steps (check_id, tier, step, expected_artifact, rationale), listed per check and tier."""
    step = F.struct("step", "expected_artifact", "rationale")
    return steps.groupBy("check_id", "tier").agg(F.sort_array(F.collect_list(step)).alias("manual_steps"))


def _outcome(check: Check, failure: str | None, refs: bool) -> str:
    """What one check found, as a struct over the wide metrics."""
    if failure is None:
        pairs = ", ".join(f"'{n}', cast({e} as double)" for n, e in check.metrics.items())
        status, finding, error, metrics = check.status, check.finding, check.error, f"map({pairs})"
    else:
        text = failure.replace("\\", "\\\\").replace("'", "\\'")
        status, finding, error = "'ERROR'", "cast(null as string)", f"'{text}'"
        metrics = "cast(null as map<string,double>)"
    empty = "cast(array() as array<string>)"
    told = [f"coalesce(refs['{n}'], {empty})" for names in check.refs.values() for n in names]
    if not refs or failure is not None:
        keys = "cast(null as array<string>)"
    else:
        keys = f"array_distinct(flatten(array({', '.join(told) or empty})))"
    return (
        f"named_struct('check_id', '{check.check_id}', 'found', {status}, 'metrics', {metrics}, "
        f"'finding', {finding}, 'failure', {error}, 'evidence_refs', {keys})"
    )


# Notes on ordinary results; a finding names the counts behind a FAIL or PARTIAL.
_NOTES = (
    "case status "
    "when 'PASS' then concat('Nothing counted against the control in ', window_days, ' days.') "
    "when 'FAIL' then concat('The counts contradict the control; ', cardinality(metrics), ' metrics were taken.') "
    "when 'PARTIAL' then concat('Nothing counted against the control; proofs still owed: ', "
    "coalesce(cardinality(manual_steps), 0), '.') end"
)


def _judge(
    rows: DataFrame, checks: list[Check], failures: dict[str, str | None],
    steps: DataFrame | None = None, refs: bool = False,
) -> DataFrame:
    """Result rows: tier gate, error rows, catalog columns, manual steps and notes."""
    spark = rows.sparkSession
    outcomes = ", ".join(_outcome(c, failures[c.check_id], refs) for c in checks)
    found = rows.selectExpr(KEY, "tenant_id", "environment", "tier", "window_days", f"inline(array({outcomes}))")
    # Both tables are small: one row per check, and per check and tier.
    lists = manual_steps(spark) if steps is None else step_lists(steps)
    status = (
        f"case when not array_contains(tiers, tier) then '{SKIP}' "
        f"when failure is not null then '{ERROR}' else found end"
    )
    return (
        found.join(F.broadcast(check_catalog(spark)), "check_id")
        .join(F.broadcast(lists), ["check_id", "tier"], "left")
        .withColumn("status", F.expr(status))
        .selectExpr(
            KEY, "tenant_id", "environment", "check_id", "status", "classification", "title",
            "control", "tier",
            f"if(status in ('{SKIP}', '{ERROR}'), null, metrics) as metrics",
            f"if(status in ('{SKIP}', '{ERROR}'), null, manual_steps) as manual_steps",
            f"if(status in ('{SKIP}', '{ERROR}'), null, finding) as automated_finding",
            f"if(status = '{ERROR}', failure, null) as error",
            f"if(status = '{SKIP}', concat('Not applicable at this tier; applies to ', "
            f"array_join(tiers, ', '), '.'), {_NOTES}) as notes",
            f"if(status in ('{SKIP}', '{ERROR}'), null, evidence_refs) as evidence_refs",
        )
    )


def run_assessments(
    cat: EvidenceCatalog,
    assessments: Assessments,
    check_ids: Iterable[str] | None = None,
    scope_right: bool = False,
    steps: DataFrame | None = None,
    refs: bool = True,
) -> DataFrame:
    """One row per assessment and check: status, metrics, findings, notes, and in
    ``evidence_refs`` a sample of the keys that count against the control (null
    without ``refs``). The samples are taken where the counts are.

    ``steps`` replaces the built-in list of proofs owed: check_id, tier, step,
    expected_artifact, rationale.

    ``scope_right`` also limits the tables that requests, reads, runs, decisions,
    responses, agents and response actions are matched with to the tenant and
    environment (the bill of materials to the tenant, it names no environment).

    Checks whose tables or columns are missing become ERROR rows; the others
    run as one plan that reads each table's counts once.
    """
    wanted = specs.chosen(check_ids)
    parts = Parts(cat, assessments, scope_right, refs)
    failures = parts.failures(wanted)
    wide = parts.wide([c for c in wanted if failures[c.check_id] is None])
    return _judge(wide, wanted, failures, steps, refs)


def write_results(
    spark: SparkSession,
    cat: EvidenceCatalog,
    assessments: Assessments,
    path: str,
    check_ids: Iterable[str] | None = None,
    scope_right: bool = False,
    steps: DataFrame | None = None,
) -> DataFrame:
    """Run and store the results; returns them read back.

    An error before the job runs, such as a bad path, is raised. If the joint
    job fails while running, that is logged and each check is run by itself;
    those that fail again become ERROR rows, and if all do, the first error is raised.
    """
    wanted = [c.check_id for c in specs.chosen(check_ids)]
    results = run_assessments(cat, assessments, wanted, scope_right, steps)
    try:
        results.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    except AnalysisException:
        raise
    except PySparkException as exc:
        first = exc
        log.warning("the joint run failed, running checks one by one: %s", str(exc).splitlines()[0])
    failed = 0
    for i, check_id in enumerate(wanted):
        mode = "overwrite" if i == 0 else "append"
        try:
            one = run_assessments(cat, assessments, [check_id], scope_right, steps)
            one.write.mode(mode).parquet(path)
        except PySparkException as exc:
            failed += 1
            message = f"{type(exc).__name__}: {str(exc).splitlines()[0]}"
            rows = _judge(assessments.frame, [specs.BY_ID[check_id]], {check_id: message}, steps)
            rows.write.mode(mode).parquet(path)
    if failed == len(wanted):
        raise first
    return spark.read.parquet(path)
