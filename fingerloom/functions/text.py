"""Sizes, counts, durations and percentages as text."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BINARY = ("B", "KiB", "MiB", "GiB", "TiB", "PiB")
DECIMAL = ("B", "kB", "MB", "GB", "TB", "PB")


def human_size(n: float, si: bool = False) -> str:
    """Whole bytes, else one decimal, which goes where the number would take more than five characters."""
    units = DECIMAL if si else BINARY
    scales = [(1000.0 if si else 1024.0) ** power for power in range(len(units))]
    power = max(0, bisect_right(scales, n) - 1)
    if not power:
        return f"{int(n)}{units[0]}"
    shown = f"{n / scales[power]:.1f}"
    return (shown if len(shown) < 6 else f"{n / scales[power]:.0f}") + units[power]


def human_size_column(n: Column, si: bool = False, drop_long: bool = True, largest: str | None = None) -> Column:
    """human_size as an expression; with drop_long=False always one decimal, as reports have it; no unit above `largest`, if it is given."""
    base, units = (1000, DECIMAL) if si else (1024, BINARY)
    units = units[: units.index(largest) + 1] if largest else units
    x = n.cast("double")
    shown = F.format_string("%dB", n.cast("long"))
    for power in range(1, len(units)):
        value = x / F.lit(float(base**power))
        one = F.format_string("%.1f", F.bround(value.cast("decimal(38,15)"), 1).cast("double"))
        whole = F.format_string("%.0f", F.bround(value.cast("decimal(38,15)"), 0).cast("double"))
        number = F.when(F.length(one) > 5, whole).otherwise(one) if drop_long else one
        shown = F.when(x >= float(base**power), F.concat(number, F.lit(units[power]))).otherwise(shown)
    return shown


def report_size(n: int) -> str:
    """Sizes in reports: always one decimal above bytes."""
    value, power = float(n), 0
    while value >= 1024 and power + 1 < len(BINARY):
        value, power = value / 1024, power + 1
    return f"{value:.0f}B" if not power else f"{value:.1f}{BINARY[power]}"


def human_count(n: float) -> str:
    for least, digits, unit in ((1e9, 2, "G"), (1e6, 2, "M"), (1e3, 1, "k")):
        if n >= least:
            return f"{n / least:.{digits}f}{unit}"
    return f"{n:.0f}"


def eta(seconds: float) -> str:
    s = int(seconds)
    if s >= 3600:
        return f"{s // 3600}h{s // 60 % 60:02d}m"
    return f"{s // 60}m{s % 60:02d}s" if s >= 60 else f"{s}s"


def elapsed(seconds: float) -> str:
    s = int(seconds)
    return f"{s // 3600}:{s // 60 % 60:02d}:{s % 60:02d}"


def percent(part: float, whole: float) -> str:
    return f"({100 * part / whole if whole else 100:>3.0f}%)"


def progress_of(part: float, whole: float, shown: Callable[[float], str]) -> str:
    return f"{shown(part)}/{shown(whole)} {percent(part, whole)}  "


def prescan_prefix(index: int, count: int, done: int, total: int, si: bool = False) -> str:
    """Files and bytes that are done, each of its total; files are padded to the width of theirs."""
    return progress_of(index, count, lambda n: str(n).zfill(len(str(count)))) + progress_of(done, total, lambda n: human_size(n, si))


def percent_column(part: Column, whole: Column) -> Column:
    """percent as an expression; ties go to the even number, as in the text."""
    share = F.when(whole == 0, F.lit(100.0)).otherwise(F.lit(100) * part / whole)
    number = F.bround(share.cast("decimal(38,15)"), 0).cast("long").cast("string")
    return F.concat(F.lit("("), F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit(" ")), F.lit("%)"))


def prescan_prefix_column(index: Column, count: Column, done: Column, total: Column, si: bool = False) -> Column:
    """prescan_prefix as an expression."""
    files = F.concat(F.lpad(index.cast("string"), F.length(count.cast("string")), F.lit("0")), F.lit("/"), count.cast("string"), F.lit(" "), percent_column(index, count))
    size = F.concat(human_size_column(done, si), F.lit("/"), human_size_column(total, si), F.lit(" "), percent_column(done, total))
    return F.concat(files, F.lit("  "), size, F.lit("  "))


def _rounded(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.bround(x.cast("decimal(38,15)"), digits).cast("double"))


def human_count_column(n: Column) -> Column:
    """human_count as an expression."""
    x = n.cast("double")
    shown = F.when(x >= 1e9, F.concat(_rounded(x / 1e9, 2), F.lit("G"))).when(x >= 1e6, F.concat(_rounded(x / 1e6, 2), F.lit("M")))
    return shown.when(x >= 1e3, F.concat(_rounded(x / 1e3, 1), F.lit("k"))).otherwise(_rounded(x, 0))


def eta_column(seconds: Column) -> Column:
    """eta as an expression, of whole seconds."""
    s = seconds.cast("long")
    hours, minutes, rest = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(s >= 3600, F.format_string("%dh%02dm", hours, minutes)).when(s >= 60, F.format_string("%dm%02ds", F.floor(s / 60), rest)).otherwise(F.format_string("%ds", s))


def elapsed_column(seconds: Column) -> Column:
    """elapsed as an expression."""
    s = seconds.cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def render_bar(fraction: float, width: int) -> str:
    filled = int(max(0.0, min(1.0, fraction)) * width)
    return "[" + "#" * filled + "-" * (width - filled) + "]"
