"""Writing change plans: atomic page writes under an exclusive lock, verified against what was read, undone on error."""

from __future__ import annotations

import contextlib
import fcntl
import os
import shutil
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

from loomgraph.schema import MAX_PATH, Code, GraphError
from loomgraph.sources.wiki import leftovers, read_clean, snapshot

MARK_ABOVE = 10  # a mark file shows that a change of more files is under way


@dataclass(frozen=True)
class Change:
    """A file's new text; None deletes it. seen is what snapshot() says of the file the plan was made from; without it nothing is compared."""

    path: str
    new: str | None
    seen: tuple | None | type(...) = ...


def write_atomic(path: str, text: str) -> None:
    """Write beside and rename; an existing file keeps its line ends."""
    if len(path) > MAX_PATH:
        raise GraphError(Code.PATH_TOO_LONG, path)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    text = text.replace("\r\n", "\n")
    if os.path.exists(path) and read_clean(path)[1] == "\r\n":
        text = text.replace("\n", "\r\n")
    tmp = f"{path}.tmp-{uuid.uuid4().hex[:8]}"
    with open(tmp, "w", encoding="utf-8", newline="") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)


def delete_if_there(path: str) -> bool:
    with contextlib.suppress(FileNotFoundError):
        os.remove(path)
        return True
    return False


@contextlib.contextmanager
def lock(folder: str, timeout: float = 30.0) -> Iterator[None]:
    """The wiki's exclusive lock; it ends with the process that holds it."""
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "write.lock"), "w") as f:
        end = time.monotonic() + timeout
        while True:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except OSError:
                if time.monotonic() > end:
                    raise GraphError(Code.LOCK_TIMEOUT, f"lock of {folder} not free after {timeout} s") from None
                time.sleep(0.05)
        try:
            yield
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)


class Staged:
    """Changes on their way: new texts and the files they replace lie in a folder of their own, so memory holds one text at a time."""

    def __init__(self, state_dir: str):
        self.folder = os.path.join(state_dir, f"staged-{uuid.uuid4().hex[:8]}")
        self.todo: list[tuple[Change, str | None]] = []
        self.done: list[tuple[str, str | None]] = []

    def _keep(self, data: bytes) -> str:
        os.makedirs(self.folder, exist_ok=True)
        path = os.path.join(self.folder, uuid.uuid4().hex)
        with open(path, "wb") as f:
            f.write(data)
        return path

    def take(self, changes: Iterable[Change], keep: bool) -> list[str]:
        """Paths of the changes that change something; their texts are kept for apply()."""
        for c in changes:
            if (read_clean(c.path)[0] if os.path.exists(c.path) else None) != c.new:
                text = self._keep(c.new.encode()) if keep and c.new is not None else None
                self.todo.append((replace(c, new=None), text))
        return [c.path for c, _ in self.todo]

    def moved(self, strict: bool) -> list[str]:
        """Files that are no more what their plan was made from."""
        watched = {c.path: c.seen for c, _ in self.todo if c.seen is not ...}
        now = snapshot(list(watched), strict)
        return [p for p, s in now.items() if (s[:2] if s and not strict else s) != (watched[p][:2] if watched[p] and not strict else watched[p])]

    def apply(self) -> None:
        for c, text in self.todo:
            self.done.append((c.path, self._keep(_bytes(c.path)) if os.path.exists(c.path) else None))
            write_atomic(c.path, _bytes(text).decode()) if text else delete_if_there(c.path)

    def undo(self) -> list[str]:
        """Put back what apply() replaced, last first; the paths where that failed."""
        dirty = []
        for path, old in reversed(self.done):
            try:
                if old is None:
                    delete_if_there(path)
                else:
                    shutil.copyfile(old, path)
            except OSError:
                dirty.append(path)
        return dirty

    def end(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


def _bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def commit(changes: Iterable[Change], state_dir: str, seen: dict | None = None, dry_run: bool = False, strict: bool = False, timeout: float = 30.0) -> list[str]:
    """Apply all changes or none; the paths touched. Changes to the text already there touch nothing.

    Where a change says what its file was when the plan was made (or `seen`, a snapshot(), does), a file that is another by now is EXTERNAL_MODIFICATION; strict
    compares contents. A failed write is undone in reverse (TRANSACTION_ROLLBACK); if that fails too, TRANSACTION_DIRTY names the files.
    """
    staged, mark = Staged(state_dir), os.path.join(state_dir, "inflight")
    try:
        paths = staged.take((replace(c, seen=seen[c.path]) if seen and c.path in seen else c for c in changes), not dry_run)
        if dry_run or not paths:
            return paths
        with lock(state_dir, timeout):
            if moved := staged.moved(strict):
                raise GraphError(Code.EXTERNAL_MODIFICATION, "changed by someone else", detail=moved)
            if len(paths) > MARK_ABOVE:
                write_atomic(mark, "\n".join(paths))
            try:
                staged.apply()
            except Exception as e:
                dirty = staged.undo()
                raise GraphError(Code.TRANSACTION_DIRTY if dirty else Code.TRANSACTION_ROLLBACK, str(e), detail=dirty or paths) from e
            finally:
                delete_if_there(mark)
        return paths
    finally:
        staged.end()


def cleanup(root: str, state_dir: str) -> list[str]:
    """Remove what broken writes left behind."""
    gone = leftovers(root)
    for p in gone:
        delete_if_there(p)
    if delete_if_there(os.path.join(state_dir, "inflight")):
        gone.append("inflight")
    return gone
