"""Time codes as text, and the arithmetic of synchronized clips.

A time code is ``[-]H:MM:SS[.value/timescale]``: whole seconds and a fraction of
``value`` ticks of which ``timescale`` make a second. A minus sign in front makes
the whole time negative, also where all its leading parts are zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: two times closer than this, in seconds, are the same frame.
SAME_FRAME = 0.004
_FORM = r"^-?(\d+):(\d+):(\d+)(?:\.(\d+)/(\d+))?$"


def parse(code: Column) -> Column:
    """``struct<value: long, timescale: int>`` of a time code; null if it isn't one."""

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(code, _FORM, i), F.lit("")).cast("long")

    scale = F.coalesce(part(5), F.lit(1))
    ticks = (part(1) * 3600 + part(2) * 60 + part(3)) * scale + F.coalesce(part(4), F.lit(0))
    sign = F.when(code.startswith("-"), -1).otherwise(1)
    return F.when(code.rlike(_FORM) & (scale > 0), F.struct((sign * ticks).cast("long").alias("value"), scale.cast("int").alias("timescale")))


def seconds(code: Column) -> Column:
    """A time code in seconds."""
    time = parse(code)
    return time["value"] / time["timescale"]


def rescale(value: Column, timescale: Column, to: Column) -> Column:
    """Ticks on another timescale, rounded half away from zero."""
    return F.round(value * to / timescale).cast("long")


def render(value: Column, timescale: Column) -> Column:
    """The time code of ``value`` ticks."""
    ticks = F.abs(value).cast("long")
    whole = F.floor(ticks / timescale).cast("long")
    return F.concat(
        F.when(value < 0, "-").otherwise(""),
        F.format_string("%d:%02d:%02d.%d/%d", F.floor(whole / 3600).cast("long"), F.floor(whole / 60).cast("long") % 60, whole % 60, ticks % timescale, timescale.cast("long")),
    )


def same_time(a: Column, b: Column, tolerance: float = SAME_FRAME) -> Column:
    """Whether two times in seconds are the same frame. Not transitive."""
    return F.abs(a - b) < tolerance


def clip_time(master: Column, offset: Column) -> Column:
    return master - offset


def sync_offset(master: Column, clip: Column) -> Column:
    return master - clip


def between_ranges(x: Column, low: Column, high: Column, to_low: Column, to_high: Column) -> Column:
    """The linear map of one range onto another."""
    return to_low + (x - low) * (to_high - to_low) / (high - low)


def step(now: Column, frames: Column, rate: Column, seconds: Column, minutes: Column) -> Column:
    """The time after a step of frames, seconds and minutes, any of them negative."""
    return now + frames / rate + seconds + minutes * 60


def stop_time(now: Column, duration: Column, rate: Column) -> Column:
    """Where playing for a duration stops, forwards or backwards."""
    return now + F.signum(rate) * duration


def has_stopped(now: Column, stop: Column, rate: Column) -> Column:
    return F.when(rate >= 0, now >= stop).otherwise(now <= stop)


def visible_until(start: Column, duration: Column, fade: Column) -> Column:
    """``struct<start, fade_start, end>`` of an item; it is shown in [start, end)."""
    return F.struct(start.alias("start"), (start + duration).alias("fade_start"), (start + duration + fade).alias("end"))


def is_visible(t: Column, start: Column, duration: Column, fade: Column) -> Column:
    return (start <= t) & (t < start + duration + fade)


def opacity(t: Column, start: Column, duration: Column, fade: Column) -> Column:
    """1 until the fade begins, then down to 0 over it."""
    faded = t - (start + duration)
    return F.when((faded > 0) & (fade > 0), F.greatest(F.lit(0.0), 1 - faded / fade)).otherwise(F.lit(1.0))


def frame_count(duration: Column, frame: Column) -> Column:
    return F.round(duration / frame).cast("long")


def scrubber_ticks(duration: Column) -> Column:
    """A tick for each minute, and one for the start."""
    return F.round(duration / 60).cast("long") + 1


def replay(now: Column, duration: Column) -> Column:
    """``struct<start, stop>`` of a replay: it goes back by a duration and plays forward to now."""
    return F.struct((now - duration).alias("start"), now.alias("stop"))


def go_to(bookmark: Column, now: Column) -> Column:
    """The time after going to a bookmark; one that isn't set leaves it as it is."""
    return F.coalesce(bookmark, now)
