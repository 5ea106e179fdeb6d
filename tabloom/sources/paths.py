"""Files and folders on the driver."""

from __future__ import annotations

import logging
import os
import re
import shutil
import time
from datetime import datetime
from importlib import resources
from pathlib import Path

log = logging.getLogger("tabloom")

#: Drive prefixes and the folders they are mounted at; callers add their own.
MOUNTS: dict[str, str] = {}


def run_time_inform_user(message: str, log_file: str | None = None) -> str:
    line = f"{datetime.now():%Y-%m-%d %H:%M:%S} | {message}"
    log.info(line)
    if log_file:
        with open(log_file, "a", encoding="utf-8") as f:
            f.write(line + "\n")
    return line


def adjust_file_path_handling(path: str, mounts: dict[str, str] | None = None) -> str:
    """Forward slashes, single; a known drive prefix becomes its mount."""
    out = re.sub(r"(?<!:)/{2,}", "/", path.replace("\\", "/"))
    for prefix, to in sorted((mounts or MOUNTS).items(), key=lambda m: -len(m[0])):
        p = prefix.replace("\\", "/").rstrip("/")
        if out.lower().startswith(p.lower()) and out[len(p) : len(p) + 1] in ("", "/"):
            return to.rstrip("/") + out[len(p) :]
    return out


def increment_file_name(path: str) -> str:
    """The first of f (1).csv, f (2).csv, ... that is free."""
    p = Path(path)
    m = re.fullmatch(r"(.*) \((\d+)\)", p.stem)
    stem, n = (m[1], int(m[2])) if m else (p.stem, 0)
    while True:
        n += 1
        new = p.with_name(f"{stem} ({n}){p.suffix}")
        if not new.exists():
            return str(new)


def read_lines_utf8(path: str) -> list[str]:
    """Lines of a file that must be UTF-8 and end in a line end."""
    raw = Path(path).read_bytes()
    try:
        text = raw.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        raise ValueError(f"{path} is not UTF-8: {e}") from None
    if text and not text.endswith("\n"):
        raise ValueError(f"{path} does not end in a line end")
    return text.replace("\r\n", "\n").split("\n")[:-1] if text else []


def warn_if_excel_lockfile(path: str, delay: float = 10, sleep=time.sleep) -> bool:
    p = Path(path)
    if not p.with_name("~$" + p.name).exists():
        return False
    log.warning("%s looks open in a spreadsheet program", p.name)
    sleep(delay)
    return True


def within_data_lab() -> bool:
    return os.environ.get("TABLOOM_DATA_LAB", "").lower() in ("1", "true", "yes")


def save_code_to_script(text: str, description: str, folder: str) -> str:
    """A debug dump, named by time; names never repeat."""
    os.makedirs(folder, exist_ok=True)
    safe = re.sub(r"\W+", "_", description).strip("_")
    base = Path(folder) / f"{datetime.now():%Y-%m-%d %H-%M-%S-%f} {safe}.sql"
    out = str(base) if not base.exists() else increment_file_name(str(base))
    Path(out).write_text(text + "\n", encoding="utf-8")
    return out


def provide_example(example: str | None = None, folder: str | None = None) -> list[str]:
    """Names of the packaged examples, or the paths of one's files after copying them."""
    root = resources.files("tabloom.sources") / "examples"
    names = sorted(p.name for p in root.iterdir() if p.is_dir() and p.name != "__pycache__")
    if example is None:
        return names
    if example not in names:
        raise ValueError(f"no example {example!r}; there are {', '.join(names)}")
    if folder is None:
        raise ValueError("a folder is needed")
    os.makedirs(folder, exist_ok=True)
    out = []
    for p in sorted((root / example).iterdir(), key=lambda p: p.name):
        with resources.as_file(p) as src:
            out.append(shutil.copy(src, folder))
    return out
