"""Assessments: who is assessed, over which window, against which thresholds."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.functions import vocab
from proofline.functions.exprs import as_utc, to_datetime

# Above this many assessments the table is joined by shuffle instead.
BROADCAST_ROWS = 100_000
NAMED_TENANTS = 100


class Assessments:
    """One row per assessment: scope, ``as_of``, window and typed thresholds.

    ``frame`` may also be a table of any size. Its row count is checked once,
    and it is broadcast to the evidence scans only while it is small.
    """

    KEY = "assessment_id"

    def __init__(
        self,
        frame: DataFrame,
        count: int | None = None,
        earliest: str | None = None,
        latest: str | None = None,
        tenants: set[str] | None = None,
    ):
        has = frame.columns
        days = F.col("window_days").cast("int") if "window_days" in has else F.lit(None)
        days = F.coalesce(days, F.lit(vocab.DEFAULT_WINDOW_DAYS))
        as_of = as_utc(F.col("as_of"), frame.schema["as_of"].dataType.simpleString())
        self.frame = frame.select(
            self.KEY, "tenant_id", "environment", "tier",
            as_of.alias("as_of"),
            (as_of - F.make_dt_interval(days)).alias("since"),
            days.alias("window_days"),
            *[
                F.coalesce(
                    F.col(name).cast("double") if name in has else F.lit(None), F.lit(default)
                ).alias(name)
                for name, default in vocab.DEFAULT_THRESHOLDS.items()
            ],
        )
        if count is None:
            odd = ~F.col("tier").isin(*vocab.TIERS) | ~F.col("environment").isin(*vocab.ENVIRONMENTS)
            facts = self.frame.agg(
                F.count(F.lit(1)).alias("n"), F.countDistinct(self.KEY).alias("ids"),
                F.count_if(F.coalesce(odd, F.lit(True))).alias("odd"),
                F.min("since").cast("string").alias("since"),
                F.max("as_of").cast("string").alias("as_of"),
            ).first()
            if facts["ids"] != facts["n"]:
                raise ValueError("assessment ids must be unique and not null")
            if facts["odd"]:
                raise ValueError(f"{facts['odd']} assessments with an unknown tier or environment")
            count, earliest, latest = facts["n"], facts["since"], facts["as_of"]
        self.count = count
        # Literals every scan can push down; each row keeps its own bounds.
        self.earliest, self.latest = earliest, latest
        # A few tenants are named to the scan as well, for pruning.
        self._tenants = sorted(tenants) if tenants and len(tenants) <= NAMED_TENANTS else None
        self._sides: dict[tuple[str, ...], DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession, rows: Iterable[Mapping]) -> Assessments:
        """Build from settings; validates the closed vocabularies."""
        table = []
        for i, row in enumerate(rows):
            for key in ("tenant_id", "environment", "tier", "as_of"):
                if not row.get(key):
                    raise ValueError(f"assessment {i} lacks {key}")
            if row["tier"] not in vocab.TIERS:
                raise ValueError(f"tier must be one of {vocab.TIERS}, not {row['tier']!r}")
            if row["environment"] not in vocab.ENVIRONMENTS:
                raise ValueError(
                    f"environment must be one of {vocab.ENVIRONMENTS}, not {row['environment']!r}"
                )
            unknown = set(row.get("thresholds") or {}) - set(vocab.DEFAULT_THRESHOLDS)
            if unknown:
                raise ValueError(f"unknown thresholds {sorted(unknown)}")
            table.append(
                {
                    "assessment_id": str(row.get("assessment_id", f"a{i}")),
                    "tenant_id": row["tenant_id"],
                    "environment": row["environment"],
                    "tier": row["tier"],
                    "as_of": to_datetime(row["as_of"]).isoformat(sep=" "),
                    "window_days": int(row.get("window_days", vocab.DEFAULT_WINDOW_DAYS)),
                    **{
                        k: float(v)
                        for k, v in (row.get("thresholds") or {}).items()
                    },
                }
            )
        ids = [row["assessment_id"] for row in table]
        if len(set(ids)) < len(ids):
            raise ValueError("assessment ids must be unique")
        names = list(dict.fromkeys(k for row in table for k in row))
        columns = {n: [row.get(n) for row in table] for n in names}
        earliest = min(
            (to_datetime(r["as_of"]) - timedelta(days=r["window_days"]) for r in table),
            default=None,
        )
        return cls(
            spark.createDataFrame(pa.table(columns)),
            len(table),
            earliest and earliest.isoformat(sep=" "),
            max((r["as_of"] for r in table), default=None),
            {r["tenant_id"] for r in table},
        )

    def side(self, *columns: str) -> DataFrame:
        """The assessments as a join side, hinted for broadcast if small."""
        if columns not in self._sides:
            picked = self.frame.select(self.KEY, "tenant_id", "environment", *columns)
            self._sides[columns] = F.broadcast(picked) if self.count <= BROADCAST_ROWS else picked
        return self._sides[columns]

    def wide_side(self) -> DataFrame:
        """All columns of the assessments, hinted for broadcast if small."""
        return F.broadcast(self.frame) if self.count <= BROADCAST_ROWS else self.frame

    def scope(self, table: DataFrame, *carry: str) -> DataFrame:
        """Rows of an evidence table inside some assessment's tenant, environment and
        window, which ends before its ``as_of``.

        A row falling under several assessments appears once for each.
        """
        bound = [c for c in ("as_of",) if c not in carry]
        recent = table.where(f"time >= timestamp_ntz '{self.earliest}'") if self.earliest else table
        if self.latest:
            recent = recent.where(f"time < timestamp_ntz '{self.latest}'")
        if self._tenants:
            recent = recent.where(F.col("tenant_id").isin(self._tenants))
        return (
            recent.join(self.side("since", *bound, *carry), ["tenant_id", "environment"])
            .where("time >= since and time < as_of")
            .drop("since", *bound)
        )

    def scope_registry(self, table: DataFrame, *carry: str) -> DataFrame:
        """Like ``scope`` for tables without time."""
        return table.join(self.side(*carry), ["tenant_id", "environment"])


def one(spark: SparkSession, tenant_id: str, environment: str, tier: str, as_of: datetime | str,
        **settings) -> Assessments:
    """A single assessment."""
    row = dict(tenant_id=tenant_id, environment=environment, tier=tier, as_of=as_of, **settings)
    return Assessments.of(spark, [row])
