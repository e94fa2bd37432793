"""The kinds of artifacts and their file names."""

from __future__ import annotations

#: kind, current file name, older names, folder tier, where a derived kind lies, key a list is wrapped under (fixed names).
KINDS = (
    ("agent_map", "agent-map.json", (), "final", None, None),
    ("applicable_failures", None, (), "derived", "agent_map.applicable_failures", "failure_types"),
    ("mock_rules", "work/mock-rules.json", ("mock-rules.json", "mocks.json"), "work", "dataset.mocks.tools", "tools"),
    ("mock_strategies", "work/mock-strategies.json", ("mock-strategies.json",), "work", "dataset.mocks.strategies", None),
    ("coverage_plan", None, ("coverage-plan.json", "plan.json"), "derived", "dataset.coverage.plan", None),
    ("dataset", "dataset.json", (), "final", None, None),
    ("coverage", None, ("coverage.json",), "derived", "dataset.coverage.achieved", None),
    ("evaluators", "evaluators.yaml", (), "final", None, None),
    ("deployment", "deployment.json", (), "final", None, None),
    ("run", "results/run-{run_id}.json", (), "final", None, None),
    ("run_progress", "work/run-progress.json", ("run-progress.json",), "work", None, None),
    ("score_report", "results/score-report-{run_id}.json", ("results/report-{run_id}.json",), "final", None, None),
    ("aggregate", "aggregate.json", (), "final", None, None),
    ("scenarios", "scenarios.yaml", (), "final", None, None),
    ("simulation", "simulation.json", (), "final", None, None),
    ("analysis", "analysis.json", (), "final", None, None),
    ("pipeline_state", "work/state.json", ("state.json",), "work", None, None),
    ("pipeline_report", "report.json", (), "final", None, None),
    ("pipeline_job", "work/job.json", ("job.json",), "work", None, None),
)
