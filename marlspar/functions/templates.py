"""SQL texts over a table and an instant that are filled in when they run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

_SLOTS = {"{source}": re.compile(r"\{source\}"), ":as_of_ms": re.compile(r":as_of_ms\b")}


def run_template(text: str, source: DataFrame, as_of_ms: int) -> DataFrame:
    """The rows of `text`, which must name its table as {source} and its instant as :as_of_ms (ValueError else).
    Both are bound as parameters and never pasted into the text."""
    missing = [name for name, slot in _SLOTS.items() if not slot.search(text)]
    if missing:
        raise ValueError(f"the SQL text does not use {' and '.join(missing)}")
    return source.sparkSession.sql(text, args={"as_of_ms": as_of_ms}, source=source)
