"""Values as people read and type them. All are built-in expressions on columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from picmeta.functions.walks import let

#: EXIF orientations 1 to 8 in words.
ORIENTATIONS = [
    "Normal", "Mirrored left to right", "Turned upside down", "Mirrored top to bottom", "Mirrored and turned 90° anticlockwise", "Turned 90° clockwise", "Mirrored and turned 90° clockwise", "Turned 90° anticlockwise",
]
#: Characters that file names don't take, and the endings that a name loses.
RESERVED = r'[\x00-\x1f\x7f<>:"/\\|?*]+'
EXTENSIONS = r"(?i)\.(jpe?g|png|webp|heic|heif)$"
WORDS = r"(?i)\.(public|minimal|clean|custom)$"


def clip(text: Column, most: int = 80) -> Column:
    """One line of at most so many characters; control characters and white space become single spaces."""
    t = F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1f\x7f]+", " "), r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+", " "))
    return let(t, lambda x: F.when(F.length(x) > most, F.concat(F.rtrim(F.substring(x, 1, most - 3)), F.lit("..."))).otherwise(x))


def byte_size(n: Column) -> Column:
    """bytes below 1,000, then KB and MB with one decimal."""
    return F.when(n < 1000, F.concat(n.cast("string"), F.lit(" bytes"))).when(n < 1_000_000, F.format_string("%.1f KB", n / 1000.0)).otherwise(F.format_string("%.1f MB", n / 1e6))


def whole(n: Column) -> Column:
    """A whole number with commas."""
    return F.format_number(F.floor(n + 0.5), 0)


def short_size(n: Column) -> Column:
    """Like `byte_size`, but a decimal only below 10, and none if it is 0."""
    v = F.when(n < 1_000_000, n / 1000.0).otherwise(n / 1e6)
    text = F.when(v < 10, F.regexp_replace(F.format_number(F.round(v, 1), 1), r"\.0$", "")).otherwise(F.format_number(F.round(v), 0))
    return F.when(n < 1000, F.concat(whole(n), F.lit(" bytes"))).otherwise(F.concat(text, F.when(n < 1_000_000, F.lit(" KB")).otherwise(F.lit(" MB"))))


def fixed(v: Column, places: int) -> Column:
    """A number with so many decimals, rounded by its exact binary value as printf does it in C; ties to even. Java's format rounds the shortest decimal form instead, so 8.45, which is a little less, becomes 8.5. From 2^63 on, and without a finite value, as Java writes it."""
    unit = 10**places

    def parts(v: Column) -> Column:
        a = F.abs(v)
        rest = a - F.floor(a)
        c = rest * 134217729.0  # Veltkamp: the upper half of the bits
        return F.struct(F.floor(a).alias("whole"), rest.alias("rest"), (c - (c - rest)).alias("hi"), (rest * float(unit)).alias("product"), F.floor(rest * float(unit)).alias("floor"))

    def rounded(x: Column) -> Column:
        # product + error is rest * unit, exactly
        error, over = (x["hi"] * float(unit) - x["product"]) + (x["rest"] - x["hi"]) * float(unit), x["product"] - x["floor"] - 0.5
        up = (over > 0) | ((over == 0) & ((error > 0) | ((error == 0) & (x["floor"] % 2 == 1))))
        return F.struct(x["whole"].alias("whole"), (x["floor"] + up.cast("int")).alias("part"))

    def told(v: Column) -> Column:
        sign = F.when(v.cast("string").startswith("-"), "-").otherwise("")
        text = let(let(parts(v), rounded), lambda n: F.concat(sign, (n["whole"] + (n["part"] == unit).cast("int")).cast("string"), F.lit("."), F.lpad((n["part"] % unit).cast("string"), places, "0")))
        return F.when(F.abs(v) < float(1 << 63), text).when(v.isNotNull(), F.format_string(f"%.{places}f", v))

    return let(v, told)


def counted(n: Column, one: str, many: str) -> Column:
    return F.concat(whole(n), F.when(n == 1, F.lit(f" {one}")).otherwise(F.lit(f" {many}")))


def listed(words: Column) -> Column:
    """a, b and c."""
    n = F.size(words)
    return F.when(n <= 1, F.array_join(words, "")).otherwise(F.concat(F.array_join(F.slice(words, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(words, -1)))


def first_few(values: Column, k: int = 3) -> Column:
    """The first k distinct values with commas, and how many more there are."""
    d = F.array_distinct(values)
    return F.concat(F.array_join(F.slice(d, 1, k), ", "), F.when(F.size(d) > k, F.concat(F.lit(" and "), (F.size(d) - k).cast("string"), F.lit(" more"))).otherwise(F.lit("")))


def number(text: Column) -> Column:
    """A number that a person typed: 2,048 or 59,4 or 50 %; null if it is none."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\x{a0}\x{202f}]", "")
    t = F.regexp_replace(F.regexp_replace(t, "−", "-"), r"(?i)(%|[a-z]+)$", "")
    t = F.when(t.rlike(r"^-?\d{1,3}(,\d{3})+(\.\d+)?$"), F.replace(t, F.lit(","), F.lit(""))).otherwise(F.regexp_replace(t, "^([^,]*),", "$1."))
    return F.when(t.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), t.try_cast("double"))


def degrees(parts: Sequence[Column]) -> Column:
    """Degrees, minutes and seconds as degrees."""
    d, m, s = parts
    return d + F.coalesce(m, F.lit(0.0)) / 60 + F.coalesce(s, F.lit(0.0)) / 3600


def fraction(text: Column) -> Column:
    """a/b as a number, or a alone; null if either is no number."""
    a, b = (F.get(F.split(text, "/"), F.lit(i)).try_cast("double") for i in (0, 1))
    return F.when(F.coalesce(b, F.lit(0.0)) != 0, a / b).otherwise(a)


def coordinate(text: Column, ref: Column) -> Column:
    """A position as '52.5200 N' from 'd, m, s' of fractions and its letter."""
    parts = F.split(text, ",")
    return F.concat(fixed(degrees([fraction(F.trim(F.get(parts, F.lit(i)))) for i in range(3)]), 4), F.lit(" "), F.substring(ref, 1, 1))


def exposure(seconds: Column) -> Column:
    """1/250 s or 2.5 s; null for none."""
    long_ = F.concat(F.regexp_replace(fixed(seconds, 1), r"\.0$", ""), F.lit(" s"))
    return F.when(seconds >= 1, long_).when(seconds > 0, F.concat(F.lit("1/"), F.floor(F.try_divide(F.lit(1.0), seconds) + 0.5).cast("string"), F.lit(" s")))


def orientation(o: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, ORIENTATIONS)), (o - 1).cast("int")), F.concat(F.lit("Unknown ("), o.cast("string"), F.lit(")")))


def known_orientation(o: Column) -> Column:
    """1 to 8; anything else is 1."""
    return F.when(o.between(1, 8), o).otherwise(F.lit(1)).cast("int")


def exif_date(text: Column) -> Column:
    return F.regexp_replace(text, r"^(\d{4}):(\d\d):(\d\d)", "$1-$2-$3")


def iptc_date(text: Column) -> Column:
    return F.regexp_replace(text, r"^(\d{4})(\d\d)(\d\d)$", "$1-$2-$3")


def iptc_time(text: Column) -> Column:
    return F.regexp_replace(text, r"^(\d\d)(\d\d)(\d\d)", "$1:$2:$3")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def clean_name(text: Column, most: int = 80) -> Column:
    """A base for file names: no reserved characters, no picture or tier ending, at most so many characters; image if nothing is left."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), RESERVED, "-"), r"\s+", " "))
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^[.\s-]+|[.\s]+$", ""), EXTENSIONS, ""), WORDS, "")
    t = F.when(F.length(t) > most, F.trim(F.substring(t, 1, most))).otherwise(t)
    return F.when(t == "", F.lit("image")).otherwise(t)


def output_name(base: Column, nth: Column, word: Column, extension: Column) -> Column:
    """base.word.ext, or base-n.word.ext for further files of one base."""
    return F.concat(base, F.when(nth > 1, F.concat(F.lit("-"), nth.cast("string"))).otherwise(F.lit("")), F.lit("."), word, F.lit("."), extension)


def in_batch(value: Column, n_values: Column, n: Column, of: Column) -> Column:
    """What a detail says for several pictures together."""
    where = F.when(n == of, F.lit("in every picture")).otherwise(F.concat(F.lit("in "), whole(n), F.lit(" of "), whole(of), F.lit(" pictures")))
    return F.when(of < 2, value).when(n_values > 1, F.concat(F.lit("Differs between pictures, "), where)).otherwise(F.concat(value, F.lit(" ("), where, F.lit(")")))


def longest_run(text: Column) -> Column:
    """The longest run of printable ASCII, by its length without spaces around it; the first of several."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("[\\x20-\\x7e]+"), F.lit(0)), lambda r, i: F.struct(F.length(F.trim(r)).alias("n"), (-i).alias("i"), F.trim(r).alias("run")))
    return F.coalesce(F.array_max(runs)["run"], F.lit(""))


def leftover(content: Column) -> Column:
    """struct<nonzero, text>: what bytes that nothing owns hold: how many aren't zero, and their longest printable run."""
    letters = F.decode(content, "ISO-8859-1")
    return F.struct((F.octet_length(content) - F.regexp_count(letters, F.lit("\\x00"))).alias("nonzero"), longest_run(letters).alias("text"))


def headroom(tag33: Column, tag48: Column) -> Column:
    """How much brighter an HDR screen may show a picture, from the two maker note numbers; null below no headroom."""
    t = F.coalesce(tag48, F.lit(0.0))
    stops = F.when(tag33 < 1, F.when(t <= 0.01, -20 * t + 1.8).otherwise(-0.101 * t + 1.601)).otherwise(F.when(t <= 0.01, -70 * t + 3).otherwise(-0.303 * t + 2.303))
    return F.when(stops >= 0, F.pow(F.lit(2.0), stops))
