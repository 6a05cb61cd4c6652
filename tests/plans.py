"""What an executed plan did, for tests."""

from __future__ import annotations


def executed(df):
    """The final plan of ``df`` after running it, its metrics filled."""
    execution = df._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    return execution.executedPlan()


def _children(node):
    if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return [node.executedPlan()]
    if node.getClass().getSimpleName().endswith("QueryStageExec"):
        return [node.plan()]
    held = node.children()
    return [held.apply(i) for i in range(held.size())]


def nodes(plan):
    out, todo = [], [plan]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += _children(node)
    return out


def scans(plan):
    """Per file scan its text and its numbers of files and folders read."""
    found = []
    for node in nodes(plan):
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            held = {m: node.metrics().apply(m).value() for m in ("numFiles", "numPartitions", "numOutputRows") if node.metrics().contains(m)}
            found.append({"folders": node.relation().partitionSchema().simpleString(), **held})
    return found
