"""What validators find, and what rows did."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

SUCCESS = "Successful completion"
#: Of rows whose result is a plan that nothing has run yet.
PLANNED = "Planned: runs when the result is read"


@dataclass
class Report:
    """problems stop a run; warnings do not."""

    problems: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.problems

    def __bool__(self) -> bool:
        return self.ok

    def check(self, ok: bool, text: str, warn: bool = False) -> bool:
        if not ok:
            (self.warnings if warn else self.problems).append(text)
        return ok

    def require(self) -> Report:
        if self.problems:
            raise ValueError("control file is not valid:\n" + "\n".join(self.problems))
        return self


def some(names, most: int = 3) -> str:
    """The first few, sorted."""
    names = sorted(map(str, names))
    return ", ".join(names[:most]) + (" ..." if len(names) > most else "")


def first_line(e: BaseException) -> str:
    return (str(e).strip().splitlines() or [type(e).__name__])[0]


def now() -> str:
    return f"{datetime.now():%Y-%m-%d %H:%M:%S}"


def attempt(fn: Callable) -> dict:
    """Runs; a dict of result, status, start_time, end_time and the seconds taken."""
    start, began = now(), time.time()
    try:
        result, status = fn(), SUCCESS
    except Warning as w:
        result, status = None, f"Stopped with warning: {first_line(w)}"
    except Exception as e:
        result, status = None, f"Stopped with error: {first_line(e)}"
    return {"result": result, "status": status, "start_time": start, "end_time": now(), "seconds": time.time() - began}
