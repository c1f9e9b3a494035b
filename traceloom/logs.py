"""Structured logs: one JSON object per line, in files that rotate by size.  For drivers and tools; executors log through Spark."""

from __future__ import annotations

import json
import logging
from datetime import datetime, timezone
from logging.handlers import RotatingFileHandler

FILE_BYTES, FILES = 10 * 1024 * 1024, 5


class JsonLines(logging.Formatter):
    """time, level, logger, message, and the ``context`` given as ``extra``."""

    def format(self, record: logging.LogRecord) -> str:
        row = {"time": datetime.fromtimestamp(record.created, timezone.utc).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage(), **getattr(record, "context", {})}
        if record.exc_info:
            row["error"] = self.formatException(record.exc_info)
        return json.dumps(row, default=str, ensure_ascii=False)


def log_to(path: str, name: str = "traceloom", level: int = logging.INFO, file_bytes: int = FILE_BYTES, files: int = FILES) -> logging.Logger:
    """A logger that writes to ``path``; asked again for the same file it adds no second handler."""
    logger = logging.getLogger(name)
    logger.setLevel(level)
    if not any(getattr(h, "baseFilename", None) == path for h in logger.handlers):
        handler = RotatingFileHandler(path, maxBytes=file_bytes, backupCount=files, encoding="utf-8")
        handler.setFormatter(JsonLines())
        logger.addHandler(handler)
    return logger
