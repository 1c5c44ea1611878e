"""cohortflow: before/after cohort analytics as lazy Spark DataFrame plans.

Wide one-row-per-subject records with repeated period and event slots are
typed, reshaped to subject-period and event grain, classified into analysis
periods and cause groups, joined null-safely with subject presence, and
summarised into ratios, summary tables, hypothesis tests and GLM fits.
"""

from cohortflow.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
