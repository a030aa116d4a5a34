"""Hypotheses, experiment steps and findings as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metrics that a step may compute, by tool name; each yields rows with a `supports` and a `refutes` flag and their provenance.
Tool = Callable[[], DataFrame]


def fingerprint(statement: Column, metric: Column, window: Column) -> Column:
    """Equal for hypotheses that differ in letter case or spaces only."""
    return F.sha2(F.concat_ws("|", F.lower(F.trim(F.regexp_replace(statement, r"\s+", " "))), metric, window), 256)


def new_hypotheses(proposed: DataFrame, ledger: DataFrame) -> DataFrame:
    """Proposals (statement, metric, window) that neither the ledger nor an earlier row (by hypothesis_id) has."""
    marked = proposed.withColumn("fingerprint", fingerprint(F.col("statement"), F.col("metric"), F.col("window")))
    first = marked.groupBy("fingerprint").agg(F.min("hypothesis_id").alias("hypothesis_id"))
    return marked.join(first, ["fingerprint", "hypothesis_id"]).join(ledger.select("fingerprint"), "fingerprint", "left_anti")


def step_faults(steps: DataFrame, tools: list[str], most_actions: int) -> DataFrame:
    """Steps (hypothesis_id, step, tool, metric, conclusive, event_ids, evidence_ids) that break a rule, with the rule."""
    counts = steps.groupBy("hypothesis_id").agg(F.count("*").alias("actions"), F.countDistinct("tool").alias("tools"))
    fault = (
        F.when(~F.col("tool").isin(tools), "tool_not_allowed")
        .when(F.col("actions") > most_actions, "action_budget_exceeded")
        .when(F.col("tools") < F.col("actions"), "tool_repeated")
        .when(F.col("conclusive") & ((F.size("event_ids") == 0) | (F.size("evidence_ids") == 0)), "conclusion_without_evidence")
    )
    return steps.join(counts, "hypothesis_id").withColumn("fault", fault).where("fault is not null").select("hypothesis_id", "step", "fault")


def run_steps(tools: dict[str, Tool], names: list[str]) -> DataFrame:
    """The named tools' results as steps; each is one DataFrame, and none is collected."""
    unknown = set(names) - set(tools)
    if unknown:
        raise ValueError(f"tools that aren't allowed: {sorted(unknown)}")
    found = None
    for name in names:
        part = tools[name]().select(F.lit(name).alias("tool"), "hypothesis_id", "supports", "refutes")
        found = part if found is None else found.unionByName(part)
    return found


def findings(steps: DataFrame) -> DataFrame:
    """Verdict and confidence of each hypothesis: supported, refuted, or inconclusive where steps disagree or none concludes."""
    conclusive = F.col("supports") | F.col("refutes")
    groups = steps.groupBy("hypothesis_id").agg(
        F.max("supports").alias("s"), F.max("refutes").alias("r"), F.count_if(conclusive).alias("conclusive"), F.count("*").alias("steps")
    )
    verdict = F.when(F.col("s") & F.col("r"), "inconclusive").when(F.col("s"), "supported").when(F.col("r"), "refuted").otherwise("inconclusive")
    return groups.select("hypothesis_id", verdict.alias("verdict"), F.round(F.col("conclusive") / F.col("steps"), 6).alias("confidence"), "steps")
