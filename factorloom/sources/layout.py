"""Names of the folders of an instance and its generations."""

from __future__ import annotations

from dataclasses import dataclass

# Folder names.
SYS, INBOUND, INPUT, LOGS, TMP, ITERATIONS, SUCCESS = "sys", "inbound", "input", "logs", "tmp", "tmp/iterations", "_SUCCESS"
X, Y, X_TAGS, Y_TAGS, KNOWN, RECS, SIMILAR, MERGED_Y = "X", "Y", "XTags", "YTags", "knownItems", "recommend", "similarItems", "mergedY"


@dataclass(frozen=True)
class Layout:
    root: str
    instance: str

    @property
    def home(self) -> str:
        return f"{self.root.rstrip('/')}/{self.instance}"

    def generation(self, number: int, part: str = "") -> str:
        """Generations are padded to ten digits: the order of names is that of numbers."""
        return f"{self.home}/{number:010d}" + (f"/{part}" if part else "")

    @staticmethod
    def clusters(kind: str) -> str:
        return f"{kind}Clusters"

    @staticmethod
    def centroids(kind: str) -> str:
        return f"{kind}Centroids"
