"""Text of reports: times, changes, tree lines and tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.numbers import pct_change


def _fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals; ties go up."""
    return F.format_string(f"%.{digits}f", F.round(x.cast("double"), digits))


def short_us(us: Column) -> Column:
    """Whole microseconds, tenths of milliseconds, hundredths of seconds."""
    size = F.abs(us)
    return F.when(size >= 1e6, F.concat(_fixed(us / 1e6, 2), F.lit("s"))).when(size >= 1e3, F.concat(_fixed(us / 1e3, 1), F.lit("ms"))).otherwise(F.concat(_fixed(us, 0), F.lit("us")))


def tab_us(us: Column) -> Column:
    """As in one-tab differences: tenths of microseconds below 100 of them, no seconds."""
    return F.when(us >= 1e3, F.concat(_fixed(us / 1e3, 1), F.lit("ms"))).otherwise(F.concat(F.when(us >= 100, _fixed(us, 0)).otherwise(_fixed(us, 1)), F.lit("us")))


def grouped_us(us: Column) -> Column:
    """Microseconds with separators, tenths below a thousand."""
    return F.when(us >= 1e3, F.format_number(us.cast("double"), 0)).otherwise(F.format_number(us.cast("double"), 1))


def _signed_pct(pct: Column) -> Column:
    return F.concat(F.when(pct < 0, "-").otherwise("+"), _fixed(F.abs(pct), 1), F.lit("%"))


def change_text(delta: Column, base: Column) -> Column:
    """Signed time with its percent of the base; without a base only the time."""
    time = F.concat(F.when(delta < 0, "-").otherwise("+"), short_us(F.abs(delta)))
    pct = pct_change(base, base + delta)
    return F.when(pct.isNull(), time).otherwise(F.concat(time, F.lit(" ("), _signed_pct(pct), F.lit(")")))


def tree_lines(rows: list[tuple[int, str]]) -> list[str]:
    """Rows of (depth, name) in reading order as lines with branches; depth 0 starts a tree.
    Reports are small: a driver loop from the last row to the first, which knows of each
    depth whether a sibling follows."""
    follows: list[bool] = []
    lines = []
    for depth, name in reversed(rows):
        del follows[depth + 1 :]
        follows += [False] * (depth + 1 - len(follows))
        bars = ["│   " if follows[d] else "    " for d in range(1, depth)]
        turn = [] if depth == 0 else ["├── " if follows[depth] else "└── "]
        lines.append("".join(bars + turn) + name)
        follows[depth] = True
    return lines[::-1]


def cut(text: str, width: int) -> str:
    """A text of so many characters at most; a longer one ends in two dots."""
    return text if len(text) <= width else text[: max(0, width - 2)] + ".."[:width]


def table(head: list[str], rows: list[tuple], width: int = 48) -> str:
    """Rows under their headings in columns of one width each, numbers to the right."""

    def shown(v) -> str:
        return "" if v is None else f"{v:,.1f}" if isinstance(v, float) else cut(str(v), width)

    cells = [list(head), *([shown(v) for v in r] for r in rows)]
    wide = [max(len(r[i]) for r in cells) for i in range(len(head))]
    right = [bool(rows) and all(v[i] is None or isinstance(v[i], (int, float)) for v in rows) for i in range(len(head))]
    line = lambda r: "  ".join(c.rjust(w) if n else c.ljust(w) for c, w, n in zip(r, wide, right, strict=True)).rstrip()
    return "\n".join([line(cells[0]), "-" * (sum(wide) + 2 * (len(wide) - 1)), *map(line, cells[1:])])
