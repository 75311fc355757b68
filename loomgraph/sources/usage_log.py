"""The usage log: one JSON line an event, one file a UTC day. A buffered writer and a batch reader that passes over torn lines."""

from __future__ import annotations

import datetime as dt
import json
import os
import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.schema import MAX_APPEND_BYTES, MAX_ERROR_CHARS, RETENTION_DAYS

#: Events waiting are appended when they are so large, or the last append is so long ago.
FLUSH_BYTES, FLUSH_SECONDS = 3072, 5.0


def slices(lines: list[str], limit: int = MAX_APPEND_BYTES) -> list[bytes]:
    """The lines as UTF-8 text cut at line ends into pieces of at most `limit` bytes each; a longer line is a piece of its own."""
    text, at, out = "".join(f"{line}\n" for line in lines).encode(), 0, []
    while at < len(text):
        # the last line end within the limit, else the first one beyond it
        end = text.rfind(b"\n", at, at + limit) + 1 or text.find(b"\n", at) + 1
        out.append(text[at:end])
        at = end
    return out


def day_file(folder: str, day: dt.date) -> str:
    """The log file of a day."""
    return os.path.join(folder, f"{day:%Y-%m-%d}.jsonl")


class UsageLogger:
    """Collects events and appends them in small pieces; files older than the retention are removed."""

    def __init__(self, folder: str, actor: str = "lib", now=lambda: dt.datetime.now(dt.timezone.utc)):
        self.folder, self.actor, self.now = folder, actor, now
        self.buffer: list[str] = []
        self.errors, self.flushed = 0, now()
        self.lock = threading.Lock()

    def record(self, op: str, slug=None, ok: bool = True, dry: bool = False, err: str | None = None) -> None:
        ts = self.now().isoformat(timespec="milliseconds").replace("+00:00", "Z")
        event = {"ts": ts, "op": op, "slug": slug, "actor": self.actor} | ({"dry": True} if dry else {}) | {"ok": ok} | ({"err": err[:MAX_ERROR_CHARS]} if err else {})
        with self.lock:
            self.buffer.append(json.dumps(event, ensure_ascii=False))
            due = sum(map(len, self.buffer)) >= FLUSH_BYTES or (self.now() - self.flushed).total_seconds() >= FLUSH_SECONDS
        if due:
            self.flush()

    def flush(self) -> None:
        """Append what is there; lines of a failed append wait for the next one."""
        with self.lock:
            waiting = slices(self.buffer)
            try:
                if waiting:
                    os.makedirs(self.folder, exist_ok=True)
                    with open(day_file(self.folder, self.now()), "ab", buffering=0) as f:
                        while waiting:
                            f.write(waiting[0])
                            waiting.pop(0)
            except OSError:
                self.errors += 1
            self.buffer = [line for piece in waiting for line in piece.decode().splitlines()]
            self.flushed = self.now()

    def prune(self, days: int = RETENTION_DAYS) -> list[str]:
        oldest = f"{self.now() - dt.timedelta(days=days):%Y-%m-%d}.jsonl"
        gone = [f for f in sorted(os.listdir(self.folder)) if f.endswith(".jsonl") and f < oldest] if os.path.isdir(self.folder) else []
        for f in gone:
            os.remove(os.path.join(self.folder, f))
        return gone


def parse_lines(lines: DataFrame, day: Column) -> DataFrame:
    """Log rows of text lines (value); lines that are no JSON object with an op are left out. slug may be a text or a pair."""
    v = lines.select(F.try_parse_json("value").alias("v"), day.alias("day"))
    text = lambda p: F.try_variant_get("v", p, "string")
    pair = F.try_variant_get("v", "$.slug", "array<string>")
    one = text("$.slug")
    slugs = F.when(pair.isNotNull(), pair).when(one.isNotNull(), F.array(one))
    out = v.select(
        text("$.ts").alias("ts"), text("$.op").alias("op"), slugs.alias("slugs"), text("$.actor").alias("actor"), F.try_variant_get("v", "$.dry", "boolean").alias("dry"),
        F.try_variant_get("v", "$.ok", "boolean").alias("ok"), text("$.err").alias("err"), "day",
    )
    return out.where(F.col("op").isNotNull())


def _file_day() -> Column:
    return F.to_date(F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4}-\d{2}-\d{2})", 1))


def read(spark: SparkSession, folder: str, today: str | None = None, days: int | None = None) -> DataFrame:
    """The log, or only the files of the last `days` days; a folder without files gives no rows."""
    names = sorted(f for f in os.listdir(folder) if f.endswith(".jsonl")) if os.path.isdir(folder) else []
    if today and days:
        last = dt.date.fromisoformat(today)
        wanted = {f"{last - dt.timedelta(days=i)}.jsonl" for i in range(days)}
        names = [n for n in names if n in wanted]
    if not names:
        return spark.createDataFrame([], "ts string, op string, slugs array<string>, actor string, dry boolean, ok boolean, err string, day date")
    lines = spark.read.text([os.path.join(folder, n) for n in names])
    return parse_lines(lines.select("value", "_metadata"), _file_day())


def last_entry(spark: SparkSession, path: str) -> str | None:
    """The newest line of a journal that is valid JSON: a filter and a maximum over file offsets, not a walk."""
    if not os.path.exists(path):
        return None
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("no"))
    row = lines.where(F.try_parse_json("value").isNotNull() & (F.trim("value") != "")).agg(F.max_by("value", "no").alias("v")).first()
    return row.v


def append_entry(path: str, entry: dict) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(entry, ensure_ascii=False) + "\n")
