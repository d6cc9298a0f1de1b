"""Whole analyses over the stand-in matrix."""

from __future__ import annotations

from genemill.plans import workflow as WF
from genemill.plans.registry import query, rounded


@query("workflow_biomarkers")
def biomarkers(t):
    """Ranked biomarkers of the staged run."""
    return rounded(WF.biomarker_run(t.expr(), t.samples(), "label", top=20)["biomarkers"])


@query("workflow_selection_votes")
def votes(t):
    return WF.selection_run(t.expr(), t.samples(), "label", 20, embedded=("lasso",))["votes"]


@query("workflow_model_report")
def model_report(t):
    return rounded(WF.ml_run(t.expr(), t.samples(), "label", 5, 2)["metrics"])
