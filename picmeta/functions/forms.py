"""Which key a field has, and whether its value has the form that the key allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: EXIF tags by key.
TAGS = {
    "serial": [0xA431, 0xC62F],
    "lens-serial": [0xA435],
    "unique-id": [0xA420],
    "owner": [0x013B, 0xA430, 0x9C9D, 0xA437, 0xA438],
    "copyright": [0x8298],
    "datetime": [0x0132, 0x9003, 0x9004, 0x9290, 0x9291, 0x9292],
    "timezone": [0x9010, 0x9011, 0x9012, 0x882A],
    "camera": [0x010F, 0x0110, 0xC614],
    "lens": [0xA432, 0xA433, 0xA434],
    "software": [0x0131, 0xA439, 0xA43A, 0xA43B, 0xA43C],
    "computer": [0x013C],
    "description": [0x010E, 0x9286, 0x9C9B, 0x9C9C, 0x9C9E, 0x9C9F, 0xA436, 0x010D, 0x011D, 0x4746, 0x4749],
    "makernote": [0x927C],
    "embedded": [0x02BC, 0x83BB, 0x8649],
    "private": [0xC4A5, 0x014A],
    "orientation": [0x0112],
    "resolution": [0x011A, 0x011B, 0x0128],
    "colour": [0xA001, 0xA500, 0x013E, 0x013F, 0x0211, 0x0214, 0x8773, 0x012D],
    "dimensions": [0xA002, 0xA003, 0x0100, 0x0101],
    "exposure": [
        0x829A, 0x829D, 0x8822, 0x8824, 0x8827, 0x8828, 0x8830, 0x8831, 0x8832, 0x8833, 0x8834, 0x8835, 0x9201, 0x9202, 0x9203, 0x9204, 0x9205, 0x9206, 0x9207, 0x9208,
        0x9209, 0x920A, 0x9214, 0x9400, 0x9401, 0x9402, 0x9403, 0x9404, 0x9405, 0xA20B, 0xA20C, 0xA20E, 0xA20F, 0xA210, 0xA214, 0xA215, 0xA217, 0xA300, 0xA301, 0xA302,
        0xA401, 0xA402, 0xA403, 0xA404, 0xA405, 0xA406, 0xA407, 0xA408, 0xA409, 0xA40A, 0xA40B, 0xA40C, 0xA460, 0xA461, 0xA462,
    ],
    "format": [
        0x9000, 0xA000, 0x9101, 0x9102, 0x0212, 0x0213, 0x0103, 0x0102, 0x0106, 0x0115, 0x011C, 0x00FE, 0xEA1C, 0xEA1D, 0x0107, 0x0108, 0x0109, 0x010A, 0x0111, 0x0116,
        0x0117, 0x0118, 0x0119, 0x0122, 0x0123, 0x0124, 0x0125, 0x0129, 0x013D, 0x0140, 0x0141, 0x0142, 0x0143, 0x0144, 0x0145, 0x0152, 0x0153, 0x015B, 0xC612,
    ],
    "other": [0x0201, 0x0202, 0x8769, 0x8825, 0xA004, 0xA005],  # named, without a better home
}
#: What each key stands for, in the order of display: (key, group, tier, label).
ITEMS = [
    ("gps", "where", "red", "GPS position"),
    ("owner", "who", "red", "Owner and author names"),
    ("serial", "who", "red", "Camera serial number"),
    ("lens-serial", "who", "red", "Lens serial number"),
    ("copyright", "who", "red", "Copyright notice"),
    ("computer", "who", "red", "Computer name"),
    ("datetime", "when", "amber", "Date and time"),
    ("timezone", "when", "amber", "Time zone"),
    ("camera", "device", "amber", "Camera make and model"),
    ("lens", "device", "amber", "Lens"),
    ("software", "device", "amber", "Editing software"),
    ("other", "device", "amber", "Other camera data"),
    ("thumbnail", "hidden", "red", "Built-in preview image"),
    ("makernote", "hidden", "red", "Manufacturer notes (may include serial numbers)"),
    ("unique-id", "hidden", "red", "Unique image ID"),
    ("embedded", "hidden", "red", "Copy of XMP, IPTC or Photoshop data inside EXIF"),
    ("private", "hidden", "red", "Unrecognised camera data"),
    ("description", "hidden", "red", "Description and comments"),
    ("orientation", "technical", "green", "Rotation"),
    ("dimensions", "technical", "green", "Picture size"),
    ("resolution", "technical", "green", "Print resolution"),
    ("colour", "technical", "green", "Colour space"),
    ("exposure", "technical", "green", "Exposure settings"),
    ("format", "technical", "green", "File format details"),
    ("technical-text", "hidden", "red", "Unexpected data in technical details"),
    ("device-text", "hidden", "red", "Unexpected text in date or device details"),
]
GROUPS = ["where", "who", "when", "device", "hidden", "technical"]
TIERS = ["red", "amber", "green"]
#: The forms of values.
EXIF_DATE = r"^(?:\d{4}:\d\d:\d\d \d\d:\d\d:\d\d|    :  :     :  :  | {19})$"
ZONE = r"^(?:[+-]\d\d:\d\d|   :  )$"
ISO_DATE = r"^\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d(?:\.\d{1,9})?)?(?:Z|[+-]\d\d:?\d\d)?)?$"
PNG_EXIF_DATE = r"^\d{4}:\d\d:\d\d \d\d:\d\d:\d\d$"
MAIL_DATE = r"^(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), )?\d{1,2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \d{4} \d\d:\d\d(?::\d\d)? (?:GMT|UTC|UT|Z|[+-]\d{4})$"
IPTC_DATE = r"^\d{8}$"
IPTC_TIME = r"^\d{6}(?:[+-]\d{4})?$"
DEVICE = r"^[\p{L}\p{M}\p{N}\p{P}\p{S}][\p{L}\p{M}\p{N}\p{P}\p{S} ]*$"
UNSEEN = r"[\x{FE00}-\x{FE0F}\x{034F}\x{180B}-\x{180F}\x{E0100}-\x{E01EF}]"
ADDRESS = r"(?i)@|://|www\."
VALUE = r"^[+-]?\d{1,10}(?:[./]\d{1,10})?$"
SHORT_FILE = r"^[A-Za-z0-9_]{1,8}\.[A-Za-z0-9]{3}$"
#: Names of fields that no table lists, by the first rule that holds: (key, group, rule, but not).
NAMED = [
    ("gps", "where", "gps|latitude|longitude|altitude|geotag|coordinat", None),
    ("place", "where", "location|address|place|city|country|street|postal|province|landmark", None),
    ("serial", "who", "serial", None),
    ("computer", "who", "host ?computer|computer ?name|host ?name|machine ?name", None),
    ("author", "who", "author|artist|owner|creator|by-?line|photographer|e-?mail|phone|contact|^names?$|^person|^people", "tool|software"),
    ("ids", "hidden", "uuid|guid|unique|document ?id|instance ?id|^id$", None),
]
#: IPTC datasets by key, and those that only hold the structure.
DATASETS = {
    "byline": ["2:80", "2:85", "2:122"], "contact": ["2:118"], "credit": ["2:110", "2:115"], "copyright": ["2:116"], "place": ["2:90", "2:92", "2:95", "2:100", "2:101", "2:26"],
    "dates": ["2:55", "2:60", "2:62", "2:63", "2:30", "2:35"], "software": ["2:65", "2:70"], "caption": ["2:120", "2:105", "2:5"], "keywords": ["2:25"], "instructions": ["2:40"],
}
#: Keywords of text chunks by key.
KEYWORDS = {"author": ["author", "artist"], "copyright": ["copyright"], "dates": ["creation time", "date:create", "date:modify", "date:timestamp"], "software": ["software"], "source": ["source"], "comment": ["comment"], "description": ["description"], "title": ["title"], "notes": ["disclaimer", "warning"]}
STRUCTURAL = ["2:0", "1:0", "1:90"]


def tag_table(spark: SparkSession) -> DataFrame:
    """(tag, key)."""
    return spark.createDataFrame([(t, k) for k, tags in TAGS.items() for t in tags], "tag int, key string")


def item_table(spark: SparkSession) -> DataFrame:
    """(key, grp, tier, label, nth, grp_rank, tier_rank)."""
    return spark.createDataFrame([(*x, i, GROUPS.index(x[1]), TIERS.index(x[2])) for i, x in enumerate(ITEMS)], "key string, grp string, tier string, label string, nth int, grp_rank int, tier_rank int")


def device_name(v: Column) -> Column:
    """One short line of letters, digits, punctuation and symbols with single spaces; nothing unseen, no address."""
    return F.length(v).between(1, 64) & v.rlike(DEVICE) & ~F.contains(v, F.lit("  ")) & ~F.endswith(v, F.lit(" ")) & ~v.rlike(UNSEEN) & ~v.rlike(ADDRESS)


def png_date(v: Column) -> Column:
    return v.rlike(ISO_DATE) | v.rlike(PNG_EXIF_DATE) | v.rlike(MAIL_DATE)


def latin1_line(v: Column) -> Column:
    return (F.length(v) <= 64) & v.rlike(r"^[\x20-\x7e\x{a0}-\x{ff}]*$")


def technical_text(v: Column, most: int | Column = 8) -> Column:
    """Numbers or fractions, no more than the field has."""
    parts = F.split(v, ", ?| ")
    return v.isin("R98", "THM", "R03") | ((F.size(parts) <= most) & F.forall(parts, lambda x: x.rlike(VALUE)))


def amber_text(key: Column, v: Column) -> Column:
    """Whether a date or device value has its key's form."""
    return (
        F.when(key == "datetime", v.rlike(EXIF_DATE) | v.rlike(r"^\d{1,9}$"))
        .when(key == "timezone", v.rlike(ZONE))
        .when(key.isin("camera", "software", "lens"), device_name(v))
        .when(key == "other", v.rlike(SHORT_FILE))
        .otherwise(False)
    )


def demoted(key: Column, tier: Column, v: Column) -> Column:
    """The key, or technical-text or device-text where a value hasn't the form that its key allows."""
    return F.when((tier == "green") & ~technical_text(v), "technical-text").when((tier == "amber") & ~amber_text(key, v), "device-text").otherwise(key)


def named_key(name: Column) -> Column:
    """The key of a field by its name; null if no rule holds."""
    n, out = F.lower(name), None
    for key, _, rule, but in NAMED:
        holds = n.rlike(rule) if but is None else n.rlike(rule) & ~n.rlike(but)
        out = F.when(holds, key) if out is None else out.when(holds, key)
    return out


def keyword_key(name: Column) -> Column:
    """The key of a text chunk by its keyword: those of KEYWORDS, then by the rules of names; null if none holds."""
    n, out = F.lower(name), None
    for key, words in KEYWORDS.items():
        out = F.when(n.isin(*words), key) if out is None else out.when(n.isin(*words), key)
    return out.otherwise(named_key(name))


def dataset_key(dataset: Column, v: Column) -> Column:
    """The key of an IPTC dataset; null for structure. Dates and software of another form are other."""
    key = None
    for k, own in DATASETS.items():
        key = F.when(dataset.isin(*own), k) if key is None else key.when(dataset.isin(*own), k)
    ok = F.when(dataset.isin("2:55", "2:62", "2:30"), v.rlike(IPTC_DATE)).when(dataset.isin("2:60", "2:63", "2:35"), v.rlike(IPTC_TIME)).when(dataset == "2:65", (F.octet_length(v) <= 32) & device_name(v)).when(dataset == "2:70", (F.octet_length(v) <= 10) & device_name(v)).otherwise(True)
    return F.when(~dataset.isin(*STRUCTURAL), F.when(ok, F.coalesce(key, F.lit("other"))).otherwise("other"))


def png_time(b: Column) -> Column:
    """Seven bytes: year, month, day, hour, minute, second, each in its range."""
    from picmeta.functions.binary import big

    return (F.octet_length(b) == 7) & big(b, 2, 1).between(1, 12) & big(b, 3, 1).between(1, 31) & (big(b, 4, 1) <= 23) & (big(b, 5, 1) <= 59) & (big(b, 6, 1) <= 60)


def classified(facts: DataFrame) -> DataFrame:
    """facts (path, pos, tag, value) with key, grp, tier, label and the ranks of their order. Unknown tags are private; values of another form are demoted."""
    spark = facts.sparkSession
    items = item_table(spark)
    keyed = facts.join(F.broadcast(tag_table(spark)), "tag", "left").withColumn("key", F.coalesce("key", F.lit("private")))
    first = F.broadcast(items.select("key", F.col("tier").alias("own_tier")))
    judged = keyed.join(first, "key").withColumn("key", demoted(F.col("key"), F.col("own_tier"), F.col("value"))).drop("own_tier")
    return judged.join(F.broadcast(items), "key")
