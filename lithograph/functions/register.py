"""Names of the column functions for use in SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lithograph.functions.resample import noise_udf, resize_udf

PX, CHIP = "px ARRAY<DOUBLE>", "px ARRAY<DOUBLE>, h INT, w INT"
#: Name to arguments, result and body; a body may use the names before it.
BODIES = {
    "wrap_lon": ("lon DOUBLE", "DOUBLE", "CASE WHEN lon > 180 THEN lon - 360 ELSE lon END"),
    "combine_states": ("state INT", "INT", "CASE WHEN state <= 2 THEN 1 ELSE 2 END"),
    "state_name": ("state INT, names MAP<INT, STRING>", "STRING", "coalesce(try_element_at(names, state), concat('State ', cast(state AS STRING)))"),
    "project_x": ("lon DOUBLE, radius_m DOUBLE", "DOUBLE", "radius_m * radians(lon)"),
    "project_y": ("lat DOUBLE, radius_m DOUBLE", "DOUBLE", "radius_m * radians(lat)"),
    "km_to_m": ("km DOUBLE", "DOUBLE", "km * 1000"),
    "in_catalog_bounds": ("diam_km DOUBLE, lat DOUBLE, dmin DOUBLE, dmax DOUBLE, lat_lo DOUBLE, lat_hi DOUBLE", "BOOLEAN", "coalesce(NOT isnan(diam_km) AND NOT isnan(lat) AND diam_km BETWEEN dmin AND dmax AND lat BETWEEN lat_lo AND lat_hi, false)"),
    "crop_box": (
        "x DOUBLE, y DOUBLE, lat DOUBLE, diam_km DOUBLE, margin DOUBLE",
        "STRUCT<min_x: DOUBLE, min_y: DOUBLE, max_x: DOUBLE, max_y: DOUBLE>",
        """named_struct('min_x', x - CASE WHEN cos(radians(lat)) > 1e-9 THEN diam_km / 2 * 1000 * (1 + margin) / cos(radians(lat)) END, 'min_y', y - diam_km / 2 * 1000 * (1 + margin),
           'max_x', x + CASE WHEN cos(radians(lat)) > 1e-9 THEN diam_km / 2 * 1000 * (1 + margin) / cos(radians(lat)) END, 'max_y', y + diam_km / 2 * 1000 * (1 + margin))""",
    ),
    "file_stem": ("path STRING", "STRING", r"regexp_extract(path, '([^/]+?)(?:\\.[^./]*)?$', 1)"),
    "label_of_file": ("path STRING", "INT", r"cast(split(get(split(regexp_extract(path, '([^/]+)$', 1), '_'), 1), '\\.')[0] AS INT)"),
    "shape_differs": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "BOOLEAN", "size(a) <> size(b)"),
    "has_nan": (PX, "BOOLEAN", "exists(px, x -> x IS NULL OR isnan(x))"),
    "chip_columns": (f"{CHIP}, start INT, n INT", "ARRAY<DOUBLE>", "flatten(transform(sequence(0, h - 1), i -> slice(px, i * w + start + 1, greatest(n, 0))))"),
    "chip_mean": (PX, "DOUBLE", "CASE WHEN size(px) > 0 THEN aggregate(px, 0D, (a, x) -> a + x) / size(px) END"),
    "chip_left_mean": (CHIP, "DOUBLE", "chip_mean(chip_columns(px, h, w, w div 4, w div 2 - w div 4))"),
    "chip_right_mean": (CHIP, "DOUBLE", "CASE WHEN w >= 4 THEN chip_mean(chip_columns(px, h, w, w div 2, w - w div 4 - w div 2)) END"),
    "chip_mirror": (CHIP, "ARRAY<DOUBLE>", "flatten(transform(sequence(0, h - 1), i -> reverse(slice(px, i * w + 1, w))))"),
    "chip_orient": (CHIP, "ARRAY<DOUBLE>", "CASE WHEN chip_left_mean(px, h, w) > chip_right_mean(px, h, w) THEN px ELSE chip_mirror(px, h, w) END"),
    "chip_to_unit": (PX, "ARRAY<DOUBLE>", "transform(px, x -> x / 255)"),
    "chip_to_gray": (f"{PX}, c INT", "ARRAY<DOUBLE>", "transform(sequence(1, size(px) div c), i -> aggregate(sequence(0, c - 1), 0D, (s, k) -> s + px[k * (size(px) div c) + i - 1]) / c)"),
    "chip_replicate": (f"{PX}, c INT", "ARRAY<DOUBLE>", "flatten(array_repeat(px, c))"),
    "chip_standardize": (f"{PX}, m DOUBLE, s DOUBLE", "ARRAY<DOUBLE>", "transform(px, x -> (x - m) / s)"),
    "chip_destandardize": (f"{PX}, m DOUBLE, s DOUBLE", "ARRAY<DOUBLE>", "transform(px, x -> x * s + m)"),
    "chip_clamp": (f"{PX}, lo DOUBLE, hi DOUBLE", "ARRAY<DOUBLE>", "transform(px, x -> least(greatest(x, lo), hi))"),
    "chip_display_scale": (PX, "ARRAY<DOUBLE>", "transform(px, x -> (least(greatest(x, -3), 3) + 3) / 6)"),
    "chip_expand_mask": ("mask ARRAY<DOUBLE>, patch INT, size INT", "ARRAY<DOUBLE>", "transform(sequence(0, size * size - 1), i -> mask[((i div size) div patch) * (size div patch) + (i % size) div patch])"),
    "chip_masked_only": ("img ARRAY<DOUBLE>, mask ARRAY<DOUBLE>, fill DOUBLE", "ARRAY<DOUBLE>", "zip_with(img, mask, (x, m) -> CASE WHEN m > 0.5 THEN x ELSE fill END)"),
    "chip_composite": ("recon ARRAY<DOUBLE>, orig ARRAY<DOUBLE>, mask ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "transform(mask, (m, i) -> CASE WHEN m > 0.5 THEN recon[i] ELSE orig[i] END)"),
    "chip_abs_diff": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "zip_with(a, b, (x, y) -> abs(x - y))"),
    "chip_coin": ("id STRING, seed STRING", "DOUBLE", "cast(conv(substring(md5(concat_ws('-', id, seed)), 1, 8), 16, 10) AS DOUBLE) / 4294967296"),
    "chip_vflip_random": (f"{CHIP}, id STRING, seed STRING, p DOUBLE", "ARRAY<DOUBLE>", "CASE WHEN chip_coin(id, seed) < p THEN flatten(reverse(transform(sequence(0, h - 1), i -> slice(px, i * w + 1, w)))) ELSE px END"),
    "chip_erase_high": ("h INT, w INT, id STRING, seed STRING, turn INT", "INT", """cast(least(greatest(round(sqrt((chip_coin(id, concat(seed, '/1')) * 0.04D + 0.02D) * h * w
           * power(exp(chip_coin(id, concat(seed, '/2')) * (ln(2D) - ln(0.5D)) + ln(0.5D)), turn))), 1), h) AS INT)"""),
    "chip_erase_random": (f"{CHIP}, id STRING, seed STRING, p DOUBLE", "ARRAY<DOUBLE>", """CASE WHEN chip_coin(id, concat(seed, '/0')) < p THEN transform(px, (x, i) -> CASE
           WHEN i div w >= cast(floor(chip_coin(id, concat(seed, '/3')) * (h - chip_erase_high(h, w, id, seed, 1) + 1)) AS INT) AND i div w < cast(floor(chip_coin(id, concat(seed, '/3')) * (h - chip_erase_high(h, w, id, seed, 1) + 1)) AS INT) + chip_erase_high(h, w, id, seed, 1)
            AND i % w >= cast(floor(chip_coin(id, concat(seed, '/4')) * (w - chip_erase_high(w, h, id, seed, -1) + 1)) AS INT) AND i % w < cast(floor(chip_coin(id, concat(seed, '/4')) * (w - chip_erase_high(w, h, id, seed, -1) + 1)) AS INT) + chip_erase_high(w, h, id, seed, -1)
           THEN x * 0 ELSE x END) ELSE px END"""),
    "aspect_height": ("h INT, lat DOUBLE", "INT", "greatest(h, cast(floor(h / cos(abs(radians(lat)))) AS INT))"),
}


def register_all(spark: SparkSession) -> list[str]:
    """All functions on positions, labels and chips by name, usable in any SQL text of the session; returns their names.

    Spark expands those of BODIES in place; only resizing (chip_resize, chip_resize_bicubic) and noise are Arrow functions.
    """
    for name, (args, kind, body) in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    arrow = {"chip_resize": resize_udf(), "chip_resize_bicubic": resize_udf("bicubic", True), "chip_add_noise": noise_udf()}
    for name, udf in arrow.items():
        spark.udf.register(name, udf)
    return [*BODIES, *arrow]
