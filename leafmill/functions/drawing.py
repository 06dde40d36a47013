"""Colours, units, pixel statistics, paths and sizes as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTS_PER = {"emu": 1 / 12700, "twip": 1 / 20, "inch": 72.0, "px": 0.75, "cm": 72 / 2.54}


def points(x: Column, unit: str) -> Column:
    return x.cast("double") * POINTS_PER[unit]


def rgb(hex_: Column) -> Column:
    """(r, g, b) of six hexadecimal digits, a # before them or not."""
    h = F.regexp_replace(hex_, "^#", "")
    part = lambda i: F.conv(F.substring(h, i, 2), 16, 10).cast("int")
    return F.when(h.rlike("^[0-9A-Fa-f]{6}$"), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def hex_of(r: Column, g: Column, b: Column) -> Column:
    two = lambda c: F.lpad(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), F.floor(c + 0.5))).cast("long")), 2, "0")
    return F.concat(two(r), two(g), two(b))


def mixed(a: Column, b: Column, share: float) -> Column:
    """``share`` of b over a."""
    one = lambda c: a[c] * (1 - share) + b[c] * share
    return hex_of(one("r"), one("g"), one("b"))


def lightness(c: Column) -> Column:
    return (F.greatest(c["r"], c["g"], c["b"]) + F.least(c["r"], c["g"], c["b"])) / F.lit(510.0)


def with_lightness(c: Column, target: Column) -> Column:
    """The colour (r, g, b) of the same hue and saturation at another lightness, 0 to 1 (beyond: clamped)."""
    high, low = F.greatest(c["r"], c["g"], c["b"]) / F.lit(255.0), F.least(c["r"], c["g"], c["b"]) / F.lit(255.0)
    l0, spread, l1 = (high + low) / 2, high - low, F.least(F.lit(1.0), F.greatest(F.lit(0.0), target))
    # a channel lies at a share of the way from the lowest to the highest, which a change of lightness keeps
    room = lambda x: F.lit(1.0) - F.abs(2 * x - 1)
    width = F.when(spread == 0, 0.0).otherwise(spread / room(l0) * room(l1))
    share = lambda n: F.when(spread == 0, 0.0).otherwise((c[n] / F.lit(255.0) - low) / spread)
    return F.struct(*[((l1 - width / 2 + share(n) * width) * 255).alias(n) for n in "rgb"])


def tinted(c: Column, tint: Column) -> Column:
    """A sheet's tint: above 0 lighter, below darker, by lightness."""
    light = lightness(c)
    return with_lightness(c, F.when(tint < 0, light * (1 + tint)).otherwise(light * (1 - tint) + tint))


#: Other names of a theme's colours, and the colours of a file without a theme.
THEME_NAMES = {"bg1": "lt1", "tx1": "dk1", "bg2": "lt2", "tx2": "dk2"}
THEME = {
    "dk1": "000000", "lt1": "ffffff", "dk2": "44546a", "lt2": "e7e6e6", "accent1": "4472c4", "accent2": "ed7d31",
    "accent3": "a5a5a5", "accent4": "ffc000", "accent5": "5b9bd5", "accent6": "70ad47", "hlink": "0563c1", "folHlink": "954f72",
}


def theme_colour(name: Column, theme: dict[str, str] | None = None) -> Column:
    """Six digits of a scheme colour, by its own or its other name; black for unknown ones."""
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    real = F.coalesce(F.try_element_at(table(THEME_NAMES), name), name)
    return F.coalesce(F.try_element_at(table(theme or THEME), real), F.lit("000000"))


def modulated(c: Column, mod: Column, off: Column) -> Column:
    """Lightness times ``mod`` plus ``off`` (null: 1 and 0)."""
    return with_lightness(c, lightness(c) * F.coalesce(mod, F.lit(1.0)) + F.coalesce(off, F.lit(0.0)))


def moved(box: Column, sx: Column, sy: Column, tx: Column, ty: Column) -> Column:
    """A box (x, y, w, h) of a group in the coordinates around it."""
    return F.struct((box["x"] * sx + tx).alias("x"), (box["y"] * sy + ty).alias("y"), (box["w"] * sx).alias("w"), (box["h"] * sy).alias("h"))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def fit(w: Column, h: Column, width: float, height: float) -> Column:
    """(scale, dx, dy) that fits and centres a page in a box; null for empty pages."""
    s = F.least(F.lit(width) / F.nullif(w, F.lit(0.0)), F.lit(height) / F.nullif(h, F.lit(0.0)))
    return F.when(s.isNotNull(), F.struct(s.alias("scale"), ((width - w * s) / 2).alias("dx"), ((height - h * s) / 2).alias("dy")))


def byte_size(n: Column) -> Column:
    """``812 B``, ``1.5 KB``, ``3.2 MB``, by whole tenths."""
    tenth = lambda d: F.concat(F.floor(n / (d / 10) / 10).cast("string"), F.lit("."), F.pmod(F.floor(n / (d / 10)), F.lit(10)).cast("string"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, F.concat(tenth(1024.0), F.lit(" KB"))).otherwise(F.concat(tenth(1048576.0), F.lit(" MB")))


def base_name(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def joined_path(folder: Column, target: Column) -> Column:
    """A relative target as a full one: ``.`` and ``..`` resolved."""
    whole = F.when(target.startswith("/"), target).otherwise(F.concat_ws("/", folder, target))
    steps = F.filter(F.split(whole, "/"), lambda s: (s != "") & (s != "."))
    return F.array_join(F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s)))), "/")


def unescaped(s: Column) -> Column:
    """Named and numeric entities to characters."""
    number = r"&#(x[0-9A-Fa-f]+|[0-9]+);"
    parts, codes = F.split(s, number), F.regexp_extract_all(s, F.lit(number), F.lit(1))
    code = lambda c: F.when(c.startswith("x"), F.conv(F.substring(c, F.lit(2), F.length(c)), 16, 10)).otherwise(c).cast("int")
    utf16 = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    out = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(utf16(code(F.get(codes, i))), F.lit("")))), "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def text_colour(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Colour of the text of a region from pixels (r, g, b with it; r0, g0, b0 without): the mean of those whose
    contrast is four fifths of the largest or more, its ends (up to 10, from 245) taken for 0 and 255; null below 90 or for a single one."""
    d = pixels.withColumn("_d", contrast())
    top = d.groupBy(*keys).agg(F.max("_d").alias("_t"))
    d = d.join(top, keys).where(F.col("_d") >= F.col("_t") * 0.8)
    m = d.groupBy(*keys).agg(*[F.floor(F.avg(c) + 0.5).alias(c) for c in "rgb"], F.count("*").alias("n"), F.max("_t").alias("t"))
    whole = [F.when(F.col(c) <= 10, 0).when(F.col(c) >= 245, 255).otherwise(F.col(c)) for c in "rgb"]
    return m.select(*keys, F.when((F.col("t") >= 90) & (F.col("n") >= 2), hex_of(*whole)).alias("colour"))


def contrast() -> Column:
    """Of a pixel with text (r, g, b) and without (r0, g0, b0)."""
    return F.abs(F.col("r") - F.col("r0")) + F.abs(F.col("g") - F.col("g0")) + F.abs(F.col("b") - F.col("b0"))
