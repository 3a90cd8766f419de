"""Name, path, time and geometry helpers. Every function maps columns to columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a node name may not carry verbatim. "%" comes first so that
# the escapes written for the others are not escaped again.
ESCAPED_CHARS = ["%", '"', "'", "/", "\\", "~", "\x7f"] + [chr(i) for i in range(32)]
ESCAPED_CLASS = "[\\x00-\\x1f\"%'/\\\\~\\x7f]"

# Fixed value: runs of these become one "_" in a file name.
UNSAFE_RUN = '[\\x00-\\x1f"*/:<>?|\\x7f]+'

# Mirror tokens a layer name may end with.
FLIP_TOKENS = ["flipx", "flipy", "flipxy"]
_TOKEN = "(?:flipxy|flipx|flipy)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def encode_name(s, dup=None) -> Column:
    """Percent-encode reserved characters; append backslash and index for repeats."""
    s = _col(s)
    escaped = reduce(
        lambda acc, ch: F.replace(acc, F.lit(ch), F.lit("%{:02x}".format(ord(ch)))),
        ESCAPED_CHARS,
        s,
    )
    out = F.when(s.rlike(ESCAPED_CLASS), escaped).otherwise(s)
    if dup is None:
        return out
    dup = _col(dup)
    return F.when(dup > 0, F.concat(out, F.lit("\\"), dup.cast("string"))).otherwise(out)


def decode_name(s) -> Column:
    """Percent-decode as UTF-8; "+" stays itself; malformed escapes give null."""
    s = _col(s)
    decoded = F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))
    broken = decoded.contains("�") & ~s.contains("�") & ~F.lower(s).contains("%ef%bf%bd")
    return F.when(~broken, decoded)


def safe_filename(s) -> Column:
    return F.regexp_replace(_col(s), UNSAFE_RUN, "_")


def ascii_digits(s) -> Column:
    return F.translate(_col(s), "".join(chr(0xFF10 + i) for i in range(10)), "0123456789")


def url_prefix(u) -> Column:
    """File stem of a URL followed by "_": no fragment, query, folders or extension."""
    out = _col(u)
    for pattern, repl in (
        (r"#[^#]*\z", ""),
        (r"\?[^?]*\z", ""),
        (r"\A.*?([^/]+)\z", "$1"),
        (r"\..*\z", ""),
    ):
        out = F.regexp_replace(out, pattern, repl)
    return F.concat(out, F.lit("_"))


def layer_flags(name, safe_mode: bool = False) -> Column:
    """struct(kind, display, base, tokens) read off a layer name.

    ``kind`` is force, radio or plain; ``display`` drops prefix and mirror tokens,
    ``base`` drops the tokens only; ``tokens`` are listed from right to left.
    """
    name = _col(name)
    if safe_mode:
        return F.struct(
            F.lit("plain").alias("kind"),
            name.alias("display"),
            name.alias("base"),
            F.array().cast("array<string>").alias("tokens"),
        )
    marked = (F.length(name) > 1) & (name != "!?")
    kind = (
        F.when(marked & name.startswith("!"), "force")
        .when(marked & name.startswith("*"), "radio")
        .otherwise("plain")
    )
    bare = F.when(kind != "plain", F.substring(name, 2, 1 << 30)).otherwise(name)

    def tail(text: Column) -> Column:
        whole = text.rlike(rf"\A{_TOKEN}(?::{_TOKEN})*\z")
        return F.when(whole, F.concat(F.lit(":"), text)).otherwise(
            F.regexp_extract(text, rf"((?::{_TOKEN})+)\z", 1)
        )

    def strip(text: Column) -> Column:
        whole = text.rlike(rf"\A{_TOKEN}(?::{_TOKEN})*\z")
        return F.when(whole, "").otherwise(F.regexp_replace(text, rf"(?::{_TOKEN})+\z", ""))

    found = tail(name)
    tokens = F.when(found == "", F.array().cast("array<string>")).otherwise(
        F.reverse(F.split(F.substring(found, 2, 1 << 30), ":"))
    )
    return F.struct(
        kind.alias("kind"),
        strip(bare).alias("display"),
        strip(name).alias("base"),
        tokens.alias("tokens"),
    )


def display_caption(text) -> Column:
    return F.regexp_replace(_col(text), r"\A\*", "")


def dos_timestamp(ts) -> Column:
    """Packed archive date and time with two-second steps, as an unsigned 32-bit value."""
    ts = _col(ts)

    def part(column: Column) -> Column:
        return column.cast("bigint")

    date = (
        F.shiftleft(part(F.year(ts) - 1980), 9)
        .bitwiseOR(F.shiftleft(part(F.month(ts)), 5))
        .bitwiseOR(part(F.dayofmonth(ts)))
    )
    time = (
        F.shiftleft(part(F.hour(ts)), 11)
        .bitwiseOR(F.shiftleft(part(F.minute(ts)), 5))
        .bitwiseOR(F.shiftright(part(F.second(ts)), 1))
    )
    return F.shiftleft(date, 16).bitwiseOR(time)


def format_ts(ts) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd HH:mm:ss")


def padded(number: Column, digits: int) -> Column:
    """The number with zeros in front up to ``digits`` characters; longer numbers stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) < digits, F.lpad(text, digits, "0")).otherwise(text)


def sequence_name(prefix, number) -> Column:
    return F.concat(_col(prefix), padded(F.greatest(_col(number).cast("bigint"), F.lit(0)), 4))


def fit_scale(w, h, side: str, px) -> Column:
    """Shrink-only scale that brings the chosen side to ``px``, never below one pixel."""
    w, h = _col(w).cast("double"), _col(h).cast("double")
    px = F.lit(px).cast("double") if isinstance(px, (int, float)) else _col(px).cast("double")
    chosen = {"w": w, "h": h}.get(side)
    scale = F.lit(1.0) if chosen is None else F.when(chosen > px, px / chosen).otherwise(1.0)
    smaller = F.when(w > h, F.lit(1.0) / h).otherwise(F.lit(1.0) / w)
    return F.when((w * scale < 1) | (h * scale < 1), smaller).otherwise(scale)


def thumbnail_box(w, h, size: int = 96) -> Column:
    """struct(x, y, w, h): the image letterboxed and centred in a square."""
    w, h = _col(w).cast("double"), _col(h).cast("double")
    side = F.lit(float(size))
    tw = F.when(w > h, side).otherwise(side / h * w)
    th = F.when(w > h, side / w * h).otherwise(side)
    return F.struct(
        ((side - tw) / 2).alias("x"), ((side - th) / 2).alias("y"), tw.alias("w"), th.alias("h")
    )


def effective_blend(mode, folder, section_mode=None) -> Column:
    """Folders use their section mode; pass-through on an image layer becomes normal."""
    mode, folder = _col(mode), _col(folder)
    section = mode if section_mode is None else _col(section_mode)
    return F.when(folder, section).otherwise(
        F.when(mode == "pass-through", "normal").otherwise(mode)
    )


def view_name(parts, style: str = "standard", flat: bool = True) -> Column:
    """Join array<struct(caption, name, index)> into the name of one exported view."""
    if style == "index":
        words = F.transform(_col(parts), lambda p: p["index"].cast("string"))
    elif style == "compact":
        words = F.transform(_col(parts), lambda p: safe_filename(p["name"]))
    elif style == "standard":
        words = F.transform(
            _col(parts),
            lambda p, i: safe_filename(
                F.when(i > 0, F.concat(p["caption"], F.lit("-"), p["name"])).otherwise(p["name"])
            ),
        )
    else:
        raise ValueError(f"unknown naming style: {style}")
    return F.array_join(words, "_" if flat else "\\")
