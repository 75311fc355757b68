"""Fixed values of the data model (they must equal those of existing wikis) and tuning defaults."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import Enum

#: Page type -> directory.
TYPE_DIRS = {"entity": "entities", "concept": "concepts", "source": "sources", "query": "queries", "comparison": "comparisons", "synthesis": "synthesis", "dream": "dreams", "overview": ""}
DIR_TYPES = {d: t for t, d in TYPE_DIRS.items() if d}
#: Known page types in their order.
KNOWN_TYPES = ["entity", "concept", "source", "query", "comparison", "synthesis", "dream", "overview"]
#: Page type -> heading of its section in the index.
TYPE_HEADINGS = {"entity": "Entities", "concept": "Concepts", "source": "Sources", "query": "Queries", "comparison": "Comparisons", "synthesis": "Synthesis", "dream": "Dreams", "overview": "Overview"}
#: Files and states of the data model.
INFRA_FILES = ["index.md", "log.md"]
COMPRESSION_STAGES = ["active", "condensed", "skeleton"]
HIDDEN_TAG = "needs-verification"

# Limits and intervals that decide results.
READ_LIMIT, READ_MAX = 200, 500
EDGE_LIMIT, EDGE_MAX = 100, 500
MAX_HOPS = 5
WEEK, MONTH, CAP, DIVISOR = 7, 30, 1095, 12
USAGE_DAYS, USAGE_TOP, USAGE_BOTTOM, RETENTION_DAYS = 30, 64, 64, 90
MAX_APPEND_BYTES, MAX_ERROR_CHARS, MAX_PATH = 4096, 200, 240
CONTEXT_CHARS, ANCHOR_CHARS, DEGRADED_CHARS, RECENT_ROUNDS, TOOL_RESULT_CHARS = 100_000, 2_048, 512, 10, 8_192
FILE_READ_BYTES, FILE_READ_LINES = 50 * 1024, 2_000
JOURNAL_CANDIDATES, SNIPPET_CHARS = 20, 200
THEME_PURCHASE = 2


class Code(str, Enum):
    """Error codes (fixed values)."""

    NODE_NOT_FOUND = "NODE_NOT_FOUND"
    NODE_ALREADY_EXISTS = "NODE_ALREADY_EXISTS"
    RENAME_TARGET_EXISTS = "RENAME_TARGET_EXISTS"
    INVALID_SLUG = "INVALID_SLUG"
    AMBIGUOUS_SLUG = "AMBIGUOUS_SLUG"
    RESULT_TOO_LARGE = "RESULT_TOO_LARGE"
    LOCK_TIMEOUT = "LOCK_TIMEOUT"
    EXTERNAL_MODIFICATION = "EXTERNAL_MODIFICATION"
    TRANSACTION_ROLLBACK = "TRANSACTION_ROLLBACK"
    TRANSACTION_DIRTY = "TRANSACTION_DIRTY"
    WIKI_ROOT_NOT_FOUND = "WIKI_ROOT_NOT_FOUND"
    PATH_TOO_LONG = "PATH_TOO_LONG"


class GraphError(Exception):
    """An error with a code, and the slugs and detail it is about."""

    def __init__(self, code: Code, message: str, slug: str | None = None, target: str | None = None, detail=None):
        super().__init__(message)
        self.code, self.slug, self.target, self.detail = code, slug, target, detail


class ResultTooLarge(GraphError):
    """More rows than the limit: the result is refused, and suggestions say how to ask for less."""

    def __init__(self, count: int, limit: int, suggestions: dict):
        super().__init__(Code.RESULT_TOO_LARGE, f"{count} results exceed the limit of {limit}", detail=suggestions)
        self.count, self.limit, self.suggestions = count, limit, suggestions


@dataclass(frozen=True)
class Tuning:
    """Weights of the scores and of the walk; the defaults are fixed values."""

    certainty: float = 0.5
    seeds: tuple[int, int] = (5, 8)
    hops: tuple[int, int] = (2, 4)
    epsilon: float = 0.05
    salience: dict = field(default_factory=lambda: {"usage": 0.35, "degree": 0.25, "overdue": 0.2, "touch": 0.2})
    forget: dict = field(default_factory=lambda: {"unread": 0.35, "unneeded": 0.3, "stale": 0.2, "stage": 0.15})
    pressure: dict = field(default_factory=lambda: {"new": 1.0, "updated": 0.5, "hypotheses": 2.0, "contradictions": 3.0, "overdue": 1.0, "days": 1.0})
    threshold: float = 10.0
    damping: dict = field(default_factory=lambda: {"active": 1.0, "condensed": 0.5, "skeleton": 0.25})

    def merged(self, **changes) -> Tuning:
        """A copy in which given maps override single weights."""
        return replace(self, **{k: {**getattr(self, k), **v} if isinstance(v, dict) else v for k, v in changes.items()})

    @property
    def p_edge(self) -> float:
        return 0.4 + 0.5 * clamp01(self.certainty)

    @property
    def seed_count(self) -> int:
        lo, hi = self.seeds
        return max(1, int(hi - (hi - lo) * clamp01(self.certainty) + 0.5))

    @property
    def floor_weight(self) -> float:
        return self.epsilon * (2 - clamp01(self.certainty))


def clamp01(x: float | None, default: float = 0.5) -> float:
    """x within 0 and 1; no number is the default."""
    return default if x is None or x != x else min(1.0, max(0.0, x))
