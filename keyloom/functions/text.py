"""String functions: file names, descriptions, CSS colours and units, clocks, path data, styles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest file name, phrases that descriptions lose wherever they stand, whatever their case.
LONGEST_NAME = 180
PHRASES = (r"the video features?", r"the video shows?", r"the image features?", r"the image shows?", r"this image", r"in this image,?")
#: CSS names of the basic colours.
NAMED_COLORS = {
    "aqua": "00ffff", "black": "000000", "blue": "0000ff", "fuchsia": "ff00ff", "gray": "808080", "green": "008000", "lime": "00ff00", "maroon": "800000",
    "navy": "000080", "olive": "808000", "orange": "ffa500", "purple": "800080", "red": "ff0000", "silver": "c0c0c0", "teal": "008080", "white": "ffffff", "yellow": "ffff00",
}
#: Pixels to a unit at 96 to the inch.
PIXELS = {"px": 1.0, "in": 96.0, "pc": 16.0, "pt": 96.0 / 72.0, "cm": 96.0 / 2.54, "mm": 9.6 / 2.54, "Q": 2.4 / 2.54}


def sanitize_filename(text: Column, longest: int = LONGEST_NAME) -> Column:
    """Signs that file names may not hold become underscores, runs of those and of white space one; `unnamed` if nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(text, r'[<>:"/\\|?*\n\r\t]', "_"), r"[\s_]+", "_")
    return F.coalesce(F.nullif(F.left(F.btrim(plain, F.lit("_ ")), F.lit(longest)), F.lit("")), F.lit("unnamed"))


def capital(letter: Column) -> Column:
    """A letter's capital where that is one letter, as SQL's upper has it; else the letter."""
    one = lambda c: F.length(c) == 1
    return F.when(one(F.upper(letter)), F.upper(letter)).when(one(F.initcap(letter)), F.initcap(letter)).when(letter == "\u00df", "\u1e9e").otherwise(letter)


def simplify_description(text: Column) -> Column:
    """Without the set phrases, white space collapsed, the first letter a capital; null is empty.

    White space inside is SQL's (no vertical tab), at the ends any space of Unicode goes; a long s counts as an s.
    """
    plain = F.coalesce(text, F.lit(""))
    for p in PHRASES:
        plain = F.regexp_replace(plain, "(?i)" + p.replace("s", "[s\u017f]"), "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"[ \t\n\f\r]+", " "), r"^\p{Zs}+|\p{Zs}+\z", "")
    return F.transform(F.array(plain), lambda x: F.concat(capital(F.left(x, F.lit(1))), F.substring(x, 2, 1 << 30)))[0]  # the text is made once


def slug(text: Column) -> Column:
    """Letters, digits, underscores and hyphens; others become underscores."""
    return F.regexp_replace(text, "[^A-Za-z0-9_-]", "_")


def suffix(path: Column) -> Column:
    """The last extension with its dot, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^/.]+)$", 1))


def clock_to_seconds(clock: Column) -> Column:
    """SMIL clock values: hh:mm:ss, mm:ss, and numbers with s, min or h or without a unit; others, ms among them, are null."""
    part = lambda i: F.regexp_extract(clock, r"^(?:(\d+):)?(\d+):(\d+(?:\.\d+)?)$", i)
    number = F.regexp_extract(clock, r"^([0-9.]+)(s|min|h)?$", 1)
    scale = F.create_map(*[F.lit(x) for kv in {"": 1.0, "s": 1.0, "min": 60.0, "h": 3600.0}.items() for x in kv])[F.regexp_extract(clock, r"^([0-9.]+)(s|min|h)?$", 2)]
    hours = F.coalesce(F.nullif(part(1), F.lit("")), F.lit("0")).cast("double")
    return F.when(part(3) != "", hours * 3600 + part(2).cast("double") * 60 + part(3).cast("double")).when(number != "", number.try_cast("double") * scale)


def clock_to_frames(clock: Column, rate: Column) -> Column:
    return clock_to_seconds(clock) * rate


def units(value: Column, width: Column, height: Column) -> Column:
    """A CSS length in pixels, viewport units by the viewport's size; null if it is none."""
    number, unit = (F.regexp_extract(value, r"^\s*([-+]?[0-9]*\.?[0-9]+)([A-Za-z]*)\s*$", i) for i in (1, 2))
    x = F.when(number != "", number.cast("double"))
    out = F.when(unit == "", x)
    for name, scale in PIXELS.items():
        out = out.when(unit == name, x * scale)
    for name, side in (("vw", width), ("vh", height), ("vmin", F.least(width, height)), ("vmax", F.greatest(width, height))):
        out = out.when(unit == name, x * side / 100)
    return out


def hex_channels(text: Column) -> Column:
    """Red, green, blue of six hexadecimal digits, 0 to 1."""
    return F.array(*[F.conv(F.substring(text, 1 + 2 * k, 2), 16, 10).cast("double") / 255 for k in range(3)])


def css_color(text: Column) -> Column:
    """[r, g, b, a] of a CSS colour: #rgb, #rrggbb, rgb(), rgba(), hsl(), hsla() with numbers or percentages, a basic name, transparent; else null."""
    t = F.lower(F.trim(text))
    short = F.regexp_replace(t, r"^#([0-9a-f])([0-9a-f])([0-9a-f])$", "#$1$1$2$2$3$3")
    digits = F.regexp_extract(short, r"^#([0-9a-f]{6})$", 1)
    kind = F.regexp_extract(t, r"^(rgb|hsl)a?\(", 1)
    args = F.regexp_extract_all(t, F.lit(r"([-0-9.]+%?)"), 1)
    number = lambda c: F.regexp_replace(c, "%", "").cast("double")
    rgb = lambda c: F.when(c.endswith("%"), number(c) / 100).otherwise(number(c) / 255)
    alpha = F.when(F.size(args) > 3, F.when(args[3].endswith("%"), number(args[3]) / 100).otherwise(number(args[3]))).otherwise(F.lit(1.0))
    h, s, light = (F.pmod(number(args[0]) / 360, F.lit(1.0)), number(args[1]) / 100, number(args[2]) / 100)
    names = F.create_map(*[F.lit(x) for kv in NAMED_COLORS.items() for x in kv])
    opaque = lambda c: F.concat(hex_channels(c), F.array(F.lit(1.0)))
    return (
        F.when(t == "transparent", F.array(*[F.lit(0.0)] * 4))
        .when(digits != "", opaque(digits))
        .when((kind == "rgb") & (F.size(args) >= 3), F.array(rgb(args[0]), rgb(args[1]), rgb(args[2]), alpha))
        .when((kind == "hsl") & (F.size(args) >= 3), F.concat(hsl_to_rgb(h, s, light), F.array(alpha)))
        .when(names[t].isNotNull(), opaque(names[t]))
    )


def hsl_to_rgb(h: Column, s: Column, light: Column) -> Column:
    """Red, green, blue from hue, saturation, lightness, all 0 to 1."""
    a = s * F.least(light, 1 - light)

    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h * 12, F.lit(12.0))
        return light - a * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))

    return F.array(channel(0), channel(8), channel(4))


def style_map(style: Column) -> Column:
    """A CSS style string as a map of trimmed names and values; parts without a colon are left out."""
    parts = F.filter(F.split(style, ";"), lambda p: p.contains(":"))
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("key"), F.trim(F.regexp_replace(p, "^[^:]*:", "")).alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["key"] != ""))


def dash_pairs(dashes: Column) -> Column:
    """Dash and gap pairs; an odd list counts twice over."""
    even = F.when(F.size(dashes) % 2 == 1, F.concat(dashes, dashes)).otherwise(dashes)
    pairs = lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.size(x) / 2).cast("int") - 1)), lambda i: F.slice(x, 2 * i + 1, F.lit(2)))
    return F.transform(F.array(even), lambda x: F.when(F.size(x) == 0, F.array().cast("array<array<double>>")).otherwise(pairs(x)))[0]  # the list is made once, not for each pair


def path_tokens(d: Column) -> Column:
    """Commands and numbers of SVG path data, in order."""
    return F.regexp_extract_all(d, F.lit(r"([MmLlHhVvCcSsQqTtAaZz]|[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)"), 1)


def attributes(line: Column) -> Column:
    """key=value, key="quoted" and key=[bracketed] of a `(tag ...)` line as a map."""
    pairs = F.regexp_extract_all(line, F.lit(r'([A-Za-z_][A-Za-z0-9_.]*=(?:"[^"]*"|\[[^\]]*\]|[^\s()]+))'), 1)
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.btrim(F.regexp_replace(p, "^[^=]*=", ""), F.lit('"')).alias("value"))))


def tag(line: Column) -> Column:
    return F.regexp_extract(line, r"^\s*\((/?[A-Za-z_]+)", 1)
