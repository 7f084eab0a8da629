"""Plans of all executions of a session, read from its event log.

``explain`` shows one plan; a query that writes a table on the way runs several. The event log has the
final (adaptive) plan of each.
"""

from __future__ import annotations

import json
import re
from pathlib import Path


class ExecutedPlans:
    """Executions of a session whose event log goes to ``folder``, since the last ``mark``."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder, self.seen = spark, Path(folder), set()

    @staticmethod
    def conf(folder: str) -> dict[str, str]:
        """Settings of the session, to be given before it starts."""
        return {"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{folder}", "spark.eventLog.rolling.enabled": "false", "spark.eventLog.compress": "false", "spark.sql.maxMetadataStringLength": "2000"}

    def _all(self) -> dict[int, dict]:
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        plans: dict[int, dict] = {}
        app = self.spark.sparkContext.applicationId
        for path in self.folder.glob(f"{app}*"):
            for line in path.open(errors="replace"):
                if '"sparkPlanInfo"' in line:
                    try:
                        event = json.loads(line)
                    except ValueError:  # still being written
                        continue
                    plans[event["executionId"]] = event["sparkPlanInfo"]  # the last is the one that ran
        return plans

    def mark(self) -> None:
        self.seen = set(self._all())

    def nodes(self) -> list[dict]:
        """All nodes of all plans since the mark. What is reused has no nodes of its own."""
        found: list[dict] = []

        def walk(node: dict) -> None:
            found.append(node)
            if not node["nodeName"].startswith("Reused"):
                for child in node["children"]:
                    walk(child)

        for number, plan in self._all().items():
            if number not in self.seen:
                walk(plan)
        return found


def scans(nodes: list[dict], table: str) -> list[dict]:
    """Scans of a table, by a part of its path."""
    return [n for n in nodes if re.match("Scan|BatchScan", n["nodeName"]) and table in json.dumps(n.get("metadata") or {}) + n["simpleString"]]


def exchanges(nodes: list[dict], kind: str) -> list[dict]:
    return [n for n in nodes if n["nodeName"] == "Exchange" and kind in n["simpleString"]]
