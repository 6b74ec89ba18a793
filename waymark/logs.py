"""Log lines as JSON on standard error, with secrets removed."""

from __future__ import annotations

import json
import logging
import sys
import time
from typing import TextIO

from waymark.errors import redact

LEVELS = {"debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "error": logging.ERROR}
NAMES = {number: name for name, number in LEVELS.items()}


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        line = {"ts": time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(record.created)) + f".{int(record.msecs):03d}Z", "level": NAMES.get(record.levelno, "info"), "msg": record.getMessage()}
        return redact(json.dumps(line | getattr(record, "fields", {}), ensure_ascii=False, default=str))


def get_logger(level: str = "info", stream: TextIO | None = None) -> logging.Logger:
    """The library's logger; ``extra={"fields": {...}}`` adds fields to a line."""
    logger = logging.getLogger("waymark")
    handler = logging.StreamHandler(stream or sys.stderr)
    handler.setFormatter(JsonFormatter())
    logger.handlers[:] = [handler]
    logger.setLevel(LEVELS[level])
    logger.propagate = False
    return logger
