"""Scalar column functions: formats, parsing, geometry, conditions.  All stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
# Role names and condition words.
ROLES = {"admin": "Admin", "road_surveyor": "Road Surveyor", "asset_manager": "Asset Manager", "viewer": "Viewer"}
ROLE_ALIASES = {"surveyor": "road_surveyor", "asset": "asset_manager", "admin": "admin", "viewer": "viewer"}
MEDIA = {"mp4": "video/mp4", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gpx": "application/gpx+xml", "json": "application/json"}
CONDITIONS = {"Good": "good", "Fair": "fair", "Poor": "poor", "Damaged": "poor", "Missing": "poor"}


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def or_default(c: Column, default) -> Column:
    """``default`` for null and for the empty string."""
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(default))


def email_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, digits: int = 2) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.round(F.lit(EARTH_KM) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)), digits)


def tile_x(lon: Column, zoom: Column) -> Column:
    return F.floor((lon + 180) / 360 * F.pow(F.lit(2.0), zoom)).cast("int")


def tile_y(lat: Column, zoom: Column) -> Column:
    r = F.radians(lat)
    return F.floor((1 - F.ln(F.tan(r) + 1 / F.cos(r)) / F.pi()) / 2 * F.pow(F.lit(2.0), zoom)).cast("int")


def minutes_seconds(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return F.concat(F.call_function("div", whole, F.lit(60)).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def decimals(x: Column, digits: int = 2) -> Column:
    """As C prints ``%.2f``: the stored binary value is rounded, its ties to even, where ``format_string`` rounds the
    shortest decimal form, ties up.  From 2 ** 63 on the shortest form's digits are kept, followed by zeros."""
    x = x.cast("double")
    text = F.call_function("format_number", x, F.lit("0." + "0" * digits))
    # above 2 ** 40 the shortest form may have fewer digits than these; there a fraction times 10 ** digits is exact
    large = F.when((F.abs(x) >= 2.0**40) & (F.abs(x) < 2.0**63), F.abs(x))
    whole, unit = F.floor(large), 10**digits
    part = F.rint((large - whole) * unit).cast("long")
    exact = F.concat(F.when(x < 0, "-").otherwise(""), (whole + F.floor(part / unit)).cast("string"), F.lit("."), F.lpad((part % unit).cast("string"), digits, "0"))
    text = F.when(large.isNotNull(), exact).otherwise(text)
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(text)


def megabytes(size: Column) -> Column:
    return F.concat(decimals(size / (1024.0 * 1024.0)), F.lit(" MB"))


def time_asked(text: Column) -> Column:
    """Seconds named in free text: ``m:ss`` first, then a number of seconds; null if none."""
    clock, plain = r"(?i)(?:at\s+)?(\d+):(\d{2})", r"(?i)(\d+)\s*(?:seconds?|sec|s)\b"
    m = F.regexp_extract(text, clock, 1).try_cast("int") * 60 + F.regexp_extract(text, clock, 2).try_cast("int")
    return F.coalesce(m, F.regexp_extract(text, plain, 1).try_cast("int"))


def frame_asked(text: Column) -> Column:
    """Frame number named in free text, where it names no time."""
    n = F.regexp_extract(text, r"(?i)frame\s*(?:number\s*)?(\d+)", 1).try_cast("int")
    return F.when(time_asked(text).isNull(), n)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^/.]+$", "")


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^/.]+)$", 1))


def video_key(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"(?i)/([^/]+)\.mp4$", 1), F.lit(""))


def route_code(route: Column) -> Column:
    return F.concat(F.lit("R"), zero_padded(route, 3))


def zero_padded(n: Column, width: int) -> Column:
    """At least ``width`` digits; longer numbers stay whole."""
    text = n.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def route_number(code: Column) -> Column:
    return F.regexp_replace(code, "^R", "").try_cast("int")


def numbered_id(prefix: str, n: Column, width: int = 5) -> Column:
    return F.concat(F.lit(f"{prefix}-"), zero_padded(n, width))


def condition_of(choices: Column) -> Column:
    """The first choice whose part after the last dash is a known condition word; else good."""
    known = F.transform(choices, lambda c: F.element_at(literal_map(CONDITIONS), F.element_at(F.split(c, "-"), -1)))
    return F.coalesce(F.get(F.filter(known, lambda c: c.isNotNull()), F.lit(0)), F.lit("good"))


def frame_of(seconds: Column, fps: Column) -> Column:
    return (seconds * fps).cast("long")


def seconds_of(frame: Column, fps: Column) -> Column:
    return F.coalesce(F.try_divide(frame.cast("double"), fps.cast("double")), F.lit(0.0))


def frame_in_range(frame: Column, total: Column) -> Column:
    """Frames beyond the end become the last but one."""
    return F.when((frame >= total) | (frame < 0), F.greatest(total - 2, F.lit(0))).otherwise(frame)


def road_class(km: Column) -> Column:
    return F.when(km >= 50, "National/Expressway").when(km >= 15, "Municipal/Urban Road").otherwise("Local Access Road")


def frame_path(number: Column, seconds: Column) -> Column:
    return F.when(number.isNotNull(), F.concat(F.format_string("frame_%06d_", number), decimals(seconds), F.lit("s.jpg")))


def stored_url(path: Column) -> Column:
    """A path below /uploads/ once, with one leading slash; http addresses stay."""
    plain = F.regexp_replace(F.regexp_replace(path, "^/+", ""), "^(uploads/)+", "")
    return F.when(path.rlike("^https?://"), path).otherwise(F.concat(F.lit("/uploads/"), plain))


def box_xywh(box: Column) -> Column:
    return F.struct(box["x1"].alias("x"), box["y1"].alias("y"), (box["x2"] - box["x1"]).alias("width"), (box["y2"] - box["y1"]).alias("height"))


def box_pixels(box: Column, width: Column, height: Column) -> Column:
    """Percent of the frame to pixels."""
    return F.struct(*[(box[c] * side / 100).alias(c) for c, side in (("x", width), ("y", height), ("width", width), ("height", height))])


def marker_radius(n: Column) -> Column:
    return F.when(n > 5, 7).when(n > 2, 5).otherwise(4)


def role_name(role: Column) -> Column:
    """Display name of a canonical role."""
    return F.coalesce(F.element_at(literal_map(ROLES), F.lower(role)), F.lit("Road Surveyor"))


def canonical_role(role: Column) -> Column:
    """Canonical role of a display name, whatever its case, or of an alias; others are road surveyors."""
    of = literal_map({v: k for k, v in ROLES.items()} | ROLE_ALIASES)
    return F.coalesce(F.element_at(of, role), F.element_at(of, F.initcap(role)), F.lit("road_surveyor"))


def object_id(c: Column) -> Column:
    """A plain id or that of an extended-JSON object."""
    return F.coalesce(F.get_json_object(F.when(c.startswith("{"), c), "$.$oid"), c)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def steady_confidence(key: Column) -> Column:
    """A confidence of 0.85 to 0.99 that depends on the key alone."""
    return 0.85 + F.pmod(F.xxhash64(key), F.lit(1000)) / 1000 * 0.14


def percent_label(name: Column, confidence: Column) -> Column:
    return F.concat(name, F.lit(": "), decimals(confidence))


def endpoint_names(road: Column) -> Column:
    """Names of a road's two ends, by its kind."""
    a = F.when(road.contains("Rd") | road.contains("Road"), " Start").when(road.contains("St"), " North").otherwise(" Point A")
    b = F.when(road.contains("Rd") | road.contains("Road"), " End").when(road.contains("St"), " South").otherwise(" Point B")
    return F.struct(F.concat(road, a).alias("start_name"), F.concat(road, b).alias("end_name"))


def road_ends(lat: float, lon: float, angle: Column, km: Column) -> Column:
    """Both ends of a road laid around a centre, six digits: an angle (radians) and a distance that grows with length.

    The start lies km / 100 degrees out, half a degree at most; the end km / 150 degrees further, 0.2 radians on.
    """
    near = F.least(km / 100, F.lit(0.5))
    far = near + km / 150
    at = lambda r, a: (F.round(lat + r * F.cos(a), 6), F.round(lon + r * F.sin(a), 6))
    names = ("start_lat", "start_lng", "end_lat", "end_lng")
    return F.struct(*[c.alias(n) for n, c in zip(names, (*at(near, angle), *at(far, angle + 0.2)), strict=True)])


def demo_key(path: Column, keys: list[str], default: str | None = None) -> Column:
    """The first key that the file's stem contains."""
    stem = file_stem(path)
    out = F.lit(default)
    for key in reversed(keys):
        out = F.when(stem.contains(key), F.lit(key)).otherwise(out)
    return out


def prefix_category(name: Column, prefixes: list[str], default: str = "default") -> Column:
    """The first of the prefixes that the name starts with."""
    out = F.lit(default)
    for prefix in reversed(prefixes):
        out = F.when(name.startswith(prefix), F.lit(prefix)).otherwise(out)
    return out


def preview(text: Column, n: int = 200) -> Column:
    return F.substring(text, 1, n)


def resized(width: Column, height: Column, to_width: Column | None = None, to_height: Column | None = None) -> Column:
    """Size of a frame asked for by width, height or both; the side that isn't given (or 0) keeps the ratio, cut to whole pixels."""
    none = F.lit(None).cast("int")
    w, h = (F.nullif(none if c is None else c.cast("int"), F.lit(0)) for c in (to_width, to_height))
    keep_w, keep_h = (width * (h / height)).cast("int"), (height * (w / width)).cast("int")
    return F.struct(F.coalesce(w, keep_w, width.cast("int")).alias("width"), F.coalesce(h, keep_h, height.cast("int")).alias("height"))


def media_type(path: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(MEDIA), file_extension(path)), F.lit("application/octet-stream"))


def data_url(path: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), media_type(path), F.lit(";base64,"), F.base64(content))


def predictions(payload: Column, schema: str) -> Column:
    """Detections of a response: a bare list, or the list under ``predictions``."""
    bare = F.from_json(F.when(F.ltrim(payload).startswith("["), payload), f"array<{schema}>")
    return F.coalesce(bare, F.from_json(payload, f"predictions array<{schema}>")["predictions"], F.from_json(F.lit("[]"), f"array<{schema}>"))


def loose_predictions(payload: Column) -> Column:
    """The same without a declared schema: an array of variants; none for text that isn't JSON, a single object is one.

    Text behind a whole value is ignored."""
    v = F.try_parse_json(payload)
    listed = F.coalesce(F.try_variant_get(v, "$.predictions", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    single = F.when(v.isNotNull() & (F.schema_of_variant(v).startswith("OBJECT")) & F.try_variant_get(v, "$.predictions", "variant").isNull(), F.array(v))
    return F.coalesce(listed, single, F.array().cast("array<variant>"))


def variant_field(v: Column, name: str, kind: str) -> Column:
    """A field of a variant; null where it's missing or isn't of that kind."""
    return F.try_variant_get(v, f"$.{name}", kind)


def first_style(names: Column, styles: dict[str, str], default: str) -> Column:
    """What ``styles`` has for the first name of an array."""
    return F.coalesce(F.element_at(literal_map(styles), F.get(names, F.lit(0))), F.lit(default))


def style(name: Column, styles: dict[str, str], default: str) -> Column:
    return F.coalesce(F.element_at(literal_map(styles), name), F.lit(default))


def band_of(value: Column, bands: Column) -> Column:
    """The first band of ``good:>0.8,fair:0.5-0.8,poor:<0.5`` that holds the value; null if none does."""
    part = lambda b, i: F.regexp_extract(b, r"^\s*(\w+):([<>]?)([0-9.]+)(?:-([0-9.]+))?\s*$", i)
    low, high = lambda b: part(b, 3).try_cast("double"), lambda b: part(b, 4).try_cast("double")
    holds = lambda b: F.when(part(b, 2) == ">", value > low(b)).when(part(b, 2) == "<", value < low(b)).otherwise((value >= low(b)) & (value <= high(b)))
    found = F.filter(F.split(bands, ","), lambda b: F.coalesce(holds(b), F.lit(False)))
    return F.get(F.transform(found, lambda b: part(b, 1)), F.lit(0))


def description(kind: Column, condition: Column) -> Column:
    """``Poor condition traffic sign detected``."""
    capital = F.concat(F.upper(F.substring(condition, 1, 1)), F.lower(F.substring(condition, 2, 1 << 30)))
    return F.concat(capital, F.lit(" condition "), F.lower(kind), F.lit(" detected"))


def toggled(names: Column, name: Column) -> Column:
    """The set without the name if it has it, else with it."""
    return F.when(F.array_contains(names, name), F.array_remove(names, name)).otherwise(F.array_append(names, name))


def summed_maps(a: Column, b: Column) -> Column:
    """Values of both maps added by key."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def merged_maps(a: Column, b: Column) -> Column:
    """All entries; the second map wins."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x))


def sorted_keys(m: Column) -> Column:
    return F.sort_array(F.map_keys(m))


def number_in(key: Column) -> Column:
    """The digits of a key as a number (R010 is 10)."""
    return F.regexp_extract(key, r"(\d+)$", 1).try_cast("long")
