"""Logging: one handler for the package, with fields as JSON. Nothing is set up by an import."""

from __future__ import annotations

import json
import logging
import os

NAME = "textward"


class JsonFormatter(logging.Formatter):
    """A line of JSON for each record: time, level, logger, message and the record's own ``fields``."""

    def format(self, record: logging.LogRecord) -> str:
        line = {"time": self.formatTime(record), "level": record.levelname.lower(), "logger": record.name, "message": record.getMessage()}
        if record.exc_info:
            line["error"] = self.formatException(record.exc_info)
        return json.dumps(line | getattr(record, "fields", {}), default=str)


def configure(level: str | None = None, env: dict | None = None) -> logging.Logger:
    """Sets the level (given, else TEXTWARD_LOG_LEVEL, else warning) and the handler; calling it again changes only the level."""
    log = logging.getLogger(NAME)
    name = (level or (os.environ if env is None else env).get("TEXTWARD_LOG_LEVEL") or "warning").upper()
    if name not in logging.getLevelNamesMapping():
        raise ValueError(f"unknown level {name!r}")
    log.setLevel(name)
    if not any(isinstance(h.formatter, JsonFormatter) for h in log.handlers):
        handler = logging.StreamHandler()
        handler.setFormatter(JsonFormatter())
        log.addHandler(handler)
        log.propagate = False
    return log


def logger(name: str = "") -> logging.Logger:
    return logging.getLogger(f"{NAME}.{name}" if name else NAME)
