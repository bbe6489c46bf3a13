"""Parts of files: kinds, forms, pieces that belong together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from picmeta.functions.binary import big, latin1

#: What JPEG segments begin with, by marker; the first that fits counts: (marker, prefix, kind, least size).
PREFIXES = [
    (0xE0, "JFIF\0", "jfif", 14), (0xE0, "JFXX\0", "jfxx", 0), (0xE1, "Exif\0", "exif", 0), (0xE1, "http://ns.adobe.com/xap/1.0/\0", "xmp", 0), (0xE1, "http://ns.adobe.com/xmp/extension/\0", "xmpext", 0),
    (0xE2, "ICC_PROFILE\0", "icc", 0), (0xE2, "MPF\0", "mpf", 0), (0xE2, "urn:iso:std:iso:ts:21496:-1\0", "isogain", 0), (0xEB, "JP", "jumbf", 0), (0xED, "Photoshop 3.0\0", "irb", 0), (0xEE, "Adobe", "adobe", 12),
]
#: Sizes that harmless PNG chunks have.
SIZES = {"sRGB": [1], "gAMA": [4], "cHRM": [32], "cICP": [4], "mDCV": [24], "mDCv": [24], "cLLI": [8], "cLLi": [8], "pHYs": [9], "bKGD": [1, 2, 6], "sBIT": [1, 2, 3, 4], "oFFs": [9]}
LAST = {"sRGB": (0, 3), "pHYs": (8, 1), "oFFs": (8, 1)}  # a byte's place and its most
#: What a block of credentials tells about, by what it holds.
PROBES = {
    "location": r"GPS(?:Latitude|Longitude|Altitude|Position|Coordinates)|\"?exif:GPS|LocationCreated|LocationShown",
    "serial number": r"SerialNumber|BodySerial|LensSerial|CameraSerial",
    "names": r"stds\.schema-org\.CreativeWork|cawg\.identity|\"Person\"|\bPerson\b|\"author\"|\bauthor\b|CameraOwnerName|OwnerName",
    "computer name": r"HostComputer",
    "titles or descriptions": r"(?i)dc:title|dc:description|dc:subject|\btitle\b|\bdescription\b|\bcaption\b|\bheadline\b|\bkeywords\b|\bcomment\b|\balt_?text\b|\balternativeText\b",
    "a preview of the original picture": r"c2pa\.thumbnail",
}
#: The numbers of a scale chunk.
SCALE_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
#: Entities of XML and what they stand for; the ampersand goes last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]


def segment_kind(marker: Column, data: Column) -> Column:
    """The kind of a JPEG segment by its marker and how it begins."""
    kind = None
    for m, prefix, name, least in PREFIXES:
        fits = (marker == m) & F.startswith(data, F.lit(prefix.encode())) & (F.octet_length(data) >= least)
        if name == "jumbf":  # only the first packet of a box has the label
            own = F.when(F.contains(F.substring(data, 1, 128), F.lit(b"c2pa")), "c2pa").otherwise("jumbf")
            kind = kind.when(fits, own)
        else:
            kind = F.when(fits, name) if kind is None else kind.when(fits, name)
    return kind.when(marker == 0xFE, "com").when(marker.between(0xE0, 0xEF), "unknown").otherwise("marker")


def green_chunk(kind: Column, data: Column) -> Column:
    """Whether a PNG chunk has the size and form of its kind; other kinds are never harmless."""
    n, ok = F.octet_length(data), None
    for name, sizes in SIZES.items():
        fits = n.isin(*sizes)
        if name in LAST:
            at, most = LAST[name]
            fits = fits & (F.coalesce(big(data, at, 1), F.lit(255)) <= most)
        ok = F.when(kind == name, fits) if ok is None else ok.when(kind == name, fits)
    numbers = F.split(latin1(F.substring(data, 2, 1 << 30)), "\x00", -1)
    scale = F.coalesce(big(data, 0, 1), F.lit(0)).isin(1, 2) & (F.size(numbers) == 2) & F.forall(numbers, lambda x: x.rlike(SCALE_NUMBER) & (F.length(x) <= 32))
    return ok.when(kind == "hIST", (n % 2 == 0) & (n <= 512)).when(kind == "sCAL", scale).otherwise(False)


def decoded(text: Column) -> Column:
    """Text without the five entities of XML."""
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def extended(segments: DataFrame, most: int = 64 << 20) -> DataFrame:
    """(path, guid, content): the segments (path, guid, off, total, content) of one id put together by their places; null unless they tile the announced length exactly and are UTF-8. No text is longer than `most` bytes."""
    own = segments.withColumn("n", F.octet_length("content"))
    sums = own.groupBy("path", "guid").agg(F.sum("n").alias("size"), F.min("total").alias("least"), F.max("total").alias("total"), F.when(F.sum("n") <= most, F.array_sort(F.collect_list(F.struct("off", "n", "content")))).alias("s"))
    ends = F.aggregate("s", F.lit(0).cast("long"), lambda at, x: F.when(x["off"] == at, at + x["n"]).otherwise(-1))
    whole = F.aggregate(F.transform("s", lambda x: x["content"]), F.unhex(F.lit("")), lambda a, x: F.concat(a, x))
    return sums.select("path", "guid", F.when((F.col("least") == F.col("total")) & (F.col("size") == F.col("total")) & (ends == F.col("total")), F.try_validate_utf8(whole.cast("string"))).alias("content"))


def credentials(content: Column, probes: dict[str, str]) -> Column:
    """What probes (words: pattern) find in a block of bytes, in their order, with commas."""
    text = latin1(F.substring(content, 1, 4 << 20))
    return F.array_join(F.array_compact(F.array(*(F.when(text.rlike(p), words) for words, p in probes.items()))), ", ")
