"""Analyses built from the operators, registered by name."""

from cohortloom.plans import (  # noqa: F401
    association_plans,
    evidence_plans,
    file_plans,
    interval_plans,
    module_plans,
    sampling_plans,
    selection_plans,
    summary_plans,
    tree_plans,
)
from cohortloom.plans.registry import ORACLES, QUERIES  # noqa: F401
