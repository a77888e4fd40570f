"""Reports on disk: the report file, the log of deliveries, and the check against it that keeps a report from going out twice.

The log is one JSON object, keyed by product and first day of the week. It is replaced by renaming a complete new file over
it, so a reader sees the old one or the new one. A missing or unreadable log counts as empty.
"""

from __future__ import annotations

import json
import os
import re
from datetime import date, timedelta
from pathlib import Path

#: The steps of a run and how they are called.
STEP_LABELS = {
    "fetch_reviews": "Fetching reviews", "clean": "Cleaning text", "deduplicate": "Removing duplicates", "pii_scrub": "Removing personal data", "chunk": "Chunking",
    "embed": "Computing vectors", "cluster": "Clustering themes", "label": "Naming themes", "fee": "Looking at fees", "report": "Writing the report", "validate": "Checking the report", "deliver": "Delivering",
}


def window(end: date | None, start: date | None = None, weeks: int = 8, today: date | None = None) -> tuple[date, date]:
    """(start, end) of a run: by default the given weeks up to today. The start must be before the end."""
    end = end or today or date.today()
    start = start or end - timedelta(weeks=weeks)
    if start >= end:
        raise ValueError(f"the window starts on {start}, which isn't before its end {end}")
    return start, end


def step_label(node: str | None) -> str:
    """How a step is called; its own name, spaced out, if it isn't known."""
    return STEP_LABELS.get(node or "", (node or "").replace("_", " ").strip().capitalize())


def _name(text: str) -> str:
    return re.sub(r"[^\w-]", "_", text.lower()).strip("_") or "report"


def raw_cache_path(folder: str, product: str, start: date | str, end: date | str) -> str:
    """Where the rows scraped for a product and window are kept (see sources.store.cached)."""
    return f"{folder}/{_name(product)}_{start}_{end}"


def save_report(folder: str, product: str, week_start: str, markdown: str) -> Path:
    path = Path(folder) / f"report_{_name(product)}_{week_start}.md"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(markdown, encoding="utf-8")
    return path


def save_pending(folder: str, pending: str) -> Path:
    """A report that waits for its delivery; ``load_pending`` takes it up again."""
    p = json.loads(pending)
    path = Path(folder) / f"pending_{_name(p['product'])}_{p['week_start']}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(pending, encoding="utf-8")
    return path


def load_pending(path: str | Path) -> str:
    return Path(path).read_text(encoding="utf-8")


class AuditLog:
    def __init__(self, path: str) -> None:
        self.path = Path(path)

    def entries(self) -> dict[str, dict]:
        try:
            found = json.loads(self.path.read_text(encoding="utf-8"))
        except (OSError, ValueError):
            return {}
        return found if isinstance(found, dict) else {}

    @staticmethod
    def key(product: str, week_start: str) -> str:
        return f"{product}_{week_start}"

    def delivered(self, product: str, week_start: str, report_key: str) -> bool:
        e = self.entries().get(self.key(product, week_start), {})
        return bool(e.get("ok")) and e.get("report_key") == report_key

    def record(self, entry: dict) -> None:
        entries = self.entries() | {self.key(entry["product"], entry["week_start"]): entry}
        self.path.parent.mkdir(parents=True, exist_ok=True)
        beside = self.path.with_suffix(f".{os.getpid()}.tmp")
        beside.write_text(json.dumps(entries, indent=2, default=str), encoding="utf-8")
        os.replace(beside, self.path)
