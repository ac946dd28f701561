"""Column functions on image chips: arrays of pixels in row-major order, with height h and width w."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _int(x: Column | int) -> Column:
    return F.lit(x) if isinstance(x, int) else x.cast("int")


def rows_of(px: Column, h: Column, w: Column) -> Column:
    """The chip as an array of its rows."""
    return F.transform(F.sequence(F.lit(0), _int(h) - 1), lambda i: F.slice(px, i * _int(w) + 1, _int(w)))


def mirror(px: Column, h: Column, w: Column) -> Column:
    """Left and right changed over."""
    return F.flatten(F.transform(rows_of(px, h, w), F.reverse))


def _mean(px: Column) -> Column:
    return F.when(F.size(px) > 0, F.aggregate(px, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(px))


def half_means(px: Column, h: Column, w: Column) -> tuple[Column, Column]:
    """Means of the inner left and the inner right half; null for a half without columns (chips under 4 wide, right)."""
    quarter, middle = F.floor(_int(w) / 4).cast("int"), F.floor(_int(w) / 2).cast("int")
    part = lambda start, n: F.flatten(F.transform(F.sequence(F.lit(0), _int(h) - 1), lambda i: F.slice(px, i * _int(w) + start + 1, n)))
    left = _mean(part(quarter, middle - quarter))
    right = F.when(quarter > 0, _mean(part(middle, F.greatest(_int(w) - quarter - middle, F.lit(0)))))
    return left, right


def orient(px: Column, h: Column, w: Column) -> Column:
    """The chip with its darker inner half on the right; it is mirrored on a tie, and where a half is empty."""
    left, right = half_means(px, h, w)
    return F.when(left > right, px).otherwise(mirror(px, h, w))


def to_unit(px: Column) -> Column:
    """Bytes to 0 .. 1."""
    return F.transform(px, lambda x: x.cast("double") / 255.0)


def to_gray(px: Column, c: int) -> Column:
    """Mean over c planes that stand one after another."""
    n = (F.size(px) / c).cast("int")
    planes = [F.slice(px, n * k + 1, n) for k in range(c)]
    total = F.transform(planes[0], lambda x: x.cast("double"))
    for plane in planes[1:]:
        total = F.zip_with(total, plane, lambda a, b: a + b)
    return F.transform(total, lambda x: x / float(c))


def replicate(px: Column, c: int) -> Column:
    """The plane c times."""
    return F.concat(*[px] * c)


def standardize(px: Column, mean: Column, std: Column) -> Column:
    return F.transform(px, lambda x: (x.cast("double") - mean) / std)


def destandardize(px: Column, mean: Column, std: Column) -> Column:
    return F.transform(px, lambda x: x.cast("double") * std + mean)


def clamp(px: Column, lo: float, hi: float) -> Column:
    return F.transform(px, lambda x: F.least(F.greatest(x.cast("double"), F.lit(float(lo))), F.lit(float(hi))))


def display_scale(px: Column) -> Column:
    """Standard scores within three deviations to 0 .. 1."""
    return F.transform(clamp(px, -3.0, 3.0), lambda x: (x + 3.0) / 6.0)


def expand_mask(mask: Column, patch: int, size: int) -> Column:
    """Patch mask to pixel mask: each entry becomes a patch x patch square of a size x size chip."""
    across = size // patch
    at = lambda i: (F.floor(F.floor(i / size) / patch) * across + F.floor((i % size) / patch) + 1).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: F.element_at(mask, at(i)))


def masked_only(img: Column, mask: Column, fill: float = 0.5) -> Column:
    """Pixels under the mask; fill elsewhere."""
    return F.zip_with(img, mask, lambda x, m: F.when(m > 0.5, x.cast("double")).otherwise(F.lit(fill)))


def composite(recon: Column, orig: Column, mask: Column) -> Column:
    """Reconstruction under the mask, the original elsewhere."""
    picked = F.zip_with(recon, orig, lambda r, o: F.struct(r.alias("r"), o.alias("o")))
    return F.zip_with(picked, mask, lambda p, m: F.when(m > 0.5, p["r"]).otherwise(p["o"]))


def abs_diff(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def coin(key: Column, seed: int | str) -> Column:
    """A number in [0, 1) drawn from an MD5 of key and seed."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def vflip_random(px: Column, h: Column, w: Column, key: Column, seed: int = 42, p: float = 0.5) -> Column:
    """Rows in reverse order with probability p."""
    return F.when(coin(key, seed) < p, F.flatten(F.reverse(rows_of(px, h, w)))).otherwise(px)


def erase_random(px: Column, h: Column, w: Column, key: Column, seed: int = 42, p: float = 0.2, area: tuple[float, float] = (0.02, 0.06), ratio: tuple[float, float] = (0.5, 2.0)) -> Column:
    """With probability p, a random rectangle set to 0; its share of the area and its aspect lie in the given ranges."""
    u = [coin(key, f"{seed}/{k}") for k in range(5)]
    cells = (u[1] * (area[1] - area[0]) + area[0]) * h * w
    aspect = F.exp(u[2] * (F.log(F.lit(ratio[1])) - F.log(F.lit(ratio[0]))) + F.log(F.lit(ratio[0])))
    high = F.least(F.greatest(F.round(F.sqrt(cells * aspect)), F.lit(1)), h).cast("int")
    wide = F.least(F.greatest(F.round(F.sqrt(cells / aspect)), F.lit(1)), w).cast("int")
    top, left = F.floor(u[3] * (h - high + 1)).cast("int"), F.floor(u[4] * (w - wide + 1)).cast("int")
    zero = lambda x: x.cast("double") * 0.0
    inside = lambda i: (F.floor(i / w) >= top) & (F.floor(i / w) < top + high) & (i % w >= left) & (i % w < left + wide)
    erased = F.transform(px, lambda x, i: F.when(inside(i), zero(x)).otherwise(x.cast("double")))
    return F.when(u[0] < p, erased).otherwise(F.transform(px, lambda x: x.cast("double")))


def has_nan(px: Column) -> Column:
    """Whether a pixel is NaN or null."""
    return F.exists(px, lambda x: x.isNull() | F.isnan(x.cast("double")))
