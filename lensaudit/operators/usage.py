"""What a run may say about itself: ids, whether it runs in CI, and the telemetry decision.

Nothing is sent from here: events are rows, limited to the allowed fields.
"""

from __future__ import annotations

import os
import secrets
import time
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import numbers


def ulid(now_ms: int | None = None, rand: int | None = None) -> str:
    """An id of 26 characters that sorts by time: 48 bits of milliseconds and 80 random ones."""
    ms = int(time.time() * 1000) if now_ms is None else now_ms
    number = ms << 80 | (secrets.randbits(80) if rand is None else rand)
    return "".join(fixed.BASE32[number >> 5 * i & 31] for i in reversed(range(26)))


def in_ci(env: Mapping[str, str] | None = None) -> bool:
    env = os.environ if env is None else env
    return any(env.get(name) for name in fixed.CI_VARIABLES)


def telemetry(env: Mapping[str, str], setting: bool | None = None, endpoint: str = "") -> tuple[bool, str]:
    """(on, why) by the first rule that holds: off switches, an explicit on, CI, then the setting."""
    switch = env.get(fixed.TELEMETRY_VARIABLE)
    rules = (
        (env.get("DO_NOT_TRACK") == "1", False, "DO_NOT_TRACK=1"),
        (switch == "0", False, f"{fixed.TELEMETRY_VARIABLE}=0"),
        (switch == "1", True, f"{fixed.TELEMETRY_VARIABLE}=1"),
        (in_ci(env), False, "continuous integration"),
        (setting is False, False, "off in the settings"),
        (setting is True and not endpoint, False, "no endpoint"),
        (setting is True, True, "on in the settings"),
        (True, False, "not enabled"),
    )
    return next((on, why) for holds, on, why in rules if holds)


def events(runs: DataFrame) -> DataFrame:
    """``runs`` with pages_bucket (of pages) and duration_bucket (of duration_ms) in place of the
    numbers, and of all columns only the allowed ones."""
    rows = runs.withColumns({"pages_bucket": numbers.bucket(F.col("pages"), fixed.PAGES_BUCKETS), "duration_bucket": numbers.bucket(F.col("duration_ms") / 1000, fixed.DURATION_BUCKETS)})
    return rows.select(*(c for c in rows.columns if c in fixed.TELEMETRY_FIELDS))
