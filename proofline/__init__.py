"""Spark-native compliance analytics over audit-evidence tables."""

from proofline.plans.assessments import Assessments
from proofline.plans.report import build_report
from proofline.plans.runner import run_assessments
from proofline.sources.catalog import EvidenceCatalog

__all__ = ["Assessments", "EvidenceCatalog", "build_report", "run_assessments"]
