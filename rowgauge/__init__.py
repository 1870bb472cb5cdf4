"""rowgauge: audit tables meant for model training with Spark DataFrames."""

from .config import AuditConfig
from .plans.audit import AuditReport, audit

__all__ = ["AuditConfig", "AuditReport", "audit"]
