"""Text intake: redaction, a pattern reader, reply filtering and coordinates."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words and patterns that decide what is redacted and read; results depend on each of them.
PLACE_WORDS = (
    "Lake Lakes Canyon Creek River Mountain Mount Mt Peak Pass Valley Trail Trailhead "
    "Glacier Falls Ridge Park Road Highway Hwy Campground Meadow Meadows Basin Col Icefield "
    "Parkway Junction Lodge Hut Bridge Parking Lot Summit Notch Bay Point Island Hill"
).split()
HEALTH_WORDS = [
    "dementia", r"alzheimer\w*", r"autis\w*", r"diabet\w*", "insulin", r"epilep\w*", r"seizure\w*", r"medicat\w*", "medical",
    r"prescri\w*", r"depress\w*", r"suicid\w*", "despondent", r"mental(?:ly)?", r"psychiatr\w*", r"schizo\w*", "bipolar",
    "anxiety", r"pregnan\w*", "heart condition", "cardiac", "stroke", r"asthma\w*", r"disabilit\w*", "disabled",
    r"cognitive\w*", r"impair\w*", "overdose", r"drug\w*", r"alcohol\w*", r"intoxicat\w*", "drunk",
]
COMMON_WORDS = (
    "The A An At On In Of To From By For With Without Near After Before During Around About Over Under Up Down Last First Then When While "
    "Where Who What Which Why How He She They It We I You His Her Their Its Our My Your This That These Those There Here Subject "
    "Party Group Searcher Searchers Team Teams Was Were Is Are Has Had Have Not No Yes And But Or So If Also Seen Found Reported "
    "Called Left Started Planned Expected Overdue Missing Last Possibly Probably Likely Unknown Approx Approximately About Around Plan "
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October "
    "November December Morning Afternoon Evening Night Today Yesterday Tonight Weather Car Vehicle Truck Male Female Adult Adults Age Aged Partner Friend Friends Father Mother Husband Wife Son Daughter Brother Sister Parent Parents Spouse Call Contact Phone Email Text "
    "Heading Headed Travelling Traveling Walking Hiking Going Went Exercise Report Notes Note Terrain Clothing Equipment Trailhead Direction "
    "North South East West Northeast Northwest Southeast Southwest Location Point Planning Initial Search Incident Details Summary Time Date"
).split()
PHONE = r"(?<!\d|\d\.)(?:\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}(?!\d|\.\d)"
EMAIL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
TITLED = r"\b(?:Mr|Mrs|Ms|Miss|Dr)\.?\s+[A-Z][\w'-]*"
CAPITALISED_RUN = r"\b[A-Z][a-z'’-]+(?:\s+[A-Z][a-z'’-]+)*\b"
WINDS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]
CATEGORIES = [
    (r"\bhik(?:er|ing)\b", "hiker"),
    (r"\bhunt(?:er|ing)\b", "hunter"),
    (r"\bclimb(?:er|ing)\b|\bscrambl(?:er|ing)\b", "climber"),
    (r"\bski(?:er|ing)\b|\bsplitboard", "skier"),
    (r"\bsnowshoe", "snowshoer"),
    (r"\bmountain bik|\bbik(?:er|ing)\b", "mountain biker"),
    (r"\bangl(?:er|ing)\b|\bfish(?:er|ing)\b", "angler"),
    (r"\b(?:berry|mushroom)\b|\bgather(?:er|ing)\b", "gatherer"),
    (r"\brun(?:ner|ning)\b|\btrail run", "runner"),
    (r"\bcamp(?:er|ing)\b", "camper"),
    (r"\b(?:child|boy|girl|toddler|kid)\b", "child"),
]
MOUNTAIN = r"\b(?:mount(?:ain(?:s|ous)?)?|mt|alpine|subalpine|ridge|glacier|scree|peak|summit|canyon|col)\b"
FLAT = r"\b(?:prairie|flat|grassland|farmland|lowland|plains?)\b"
COORDINATES = r"(-?\d{1,2}\.\d{3,})\s*°?\s*([NS])?\s*[,;/ ]\s*(-?\d{1,3}\.\d{3,})\s*°?\s*([EW])?"
DIRECTION = r"\b(?:heading|headed|travel(?:l)?ing|walking|went|going|direction(?: of travel)?(?: was)?)\s+(?:to(?:wards?)?\s+(?:the\s+)?)?([a-z-]+|[NSEW]{1,3})\b"
BEARING = r"\bbearing\s+(\d{1,3}(?:\.\d+)?)\s*°?"
REPLY_KEYS = ["lat", "lng", "pointKind", "travelBearingDeg", "subjectCategory", "terrain"]
SUBJECTS = ["hiker", "hunter", "climber", "skier", "snowshoer", "mountain biker", "angler", "gatherer", "runner", "camper", "child", "youth", "other"]

_A = re.ASCII
_RE = {k: re.compile(v, _A) for k, v in (("phone", PHONE.replace(r"(?<!\d|\d\.)", r"(?<!\d)(?<!\d\.)")), ("email", EMAIL), ("titled", TITLED), ("run", CAPITALISED_RUN), ("place", rf"\b(?:{'|'.join(PLACE_WORDS)})\b"), ("lower", r"\b[a-z][a-z'’-]+\b"))}
_HEALTH = re.compile(rf"\b(?:{'|'.join(HEALTH_WORDS)})\b", _A | re.I)
_COMMON = frozenset(COMMON_WORDS)


#: Characters of redacted text that a task gathers before it hands them on.
REDACT_PART = 1 << 22


def redact_text(text: str | None, strict: bool = False) -> tuple[str | None, int, int, int, int]:
    """(text, phones, e-mails, names, health words): contact details, then names, then health words are replaced.

    A capitalised word that also stands in lower case in the text as given counts as an ordinary word, even if only an e-mail address
    holds it; ``strict`` looks at the text without contact details and titled names, so an address does not shield its owner's name.
    """
    if text is None:
        return None, 0, 0, 0, 0
    given = text
    text, mails = _RE["email"].subn("[contact]", text)
    text, phones = _RE["phone"].subn("[contact]", text)
    text, names = _RE["titled"].subn("[person]", text)
    usual, runs = set(_RE["lower"].findall(text if strict else given)), 0

    def name(m: re.Match) -> str:
        nonlocal runs
        if _RE["place"].search(m[0]) or all(w in _COMMON or w.lower() in usual for w in m[0].split()):
            return m[0]
        runs += 1
        return "[person]"

    text = _RE["run"].sub(name, text)
    text, health = _HEALTH.subn("[health]", text)
    return text, phones, mails, names + runs, health


def redact(df: DataFrame, key: str, text: str, strict: bool = False) -> DataFrame:
    """(key, text, phone, email, name, health); names need a look at each run of words, so batches go through Arrow."""
    kind = dict(df.dtypes)[key]

    counts = ("phone", "email", "name", "health")

    def emit(rows, key_type):
        types = [key_type, pa.string(), *[pa.int32()] * len(counts)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[key, "text", *counts])

    def run(batches):
        for b in batches:
            rows, size = [], 0
            for k, t in zip(b.column(0), b.column(1), strict=True):  # one text at a time, out again in parts
                rows.append((k.as_py(), *redact_text(t.as_py(), strict)))
                size += len(rows[-1][1] or "")
                if size > REDACT_PART or len(rows) >= 1024:
                    yield emit(rows, b.schema.field(0).type)
                    rows, size = [], 0
            if rows:
                yield emit(rows, b.schema.field(0).type)

    return df.select(key, F.col(text).alias("t")).mapInArrow(run, f"{key} {kind}, text string, phone int, email int, name int, health int")


def contact_counts(text: Column) -> dict[str, Column]:
    """Native counts of the kinds that need no word lists."""
    after = F.regexp_replace(text, EMAIL, "[contact]")
    return {"email": F.regexp_count(text, F.lit(EMAIL)), "phone": F.regexp_count(after, F.lit(PHONE)), "titled": F.regexp_count(text, F.lit(r"(?<![A-Za-z0-9_])(?:Mr|Mrs|Ms|Miss|Dr)\.?\s+[A-Z]")), "health": F.regexp_count(text, F.lit(rf"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(HEALTH_WORDS)})(?![A-Za-z0-9_])"))}


def read_local(text: Column) -> dict[str, Column]:
    """Fields a pattern reader finds: lat, lng, point_kind, bearing, category, terrain; null where it finds none."""
    i = "(?i)"
    ex = lambda p, g: F.nullif(F.regexp_extract(text, p, g), F.lit(""))
    lat, lng = ex(i + COORDINATES, 1).try_cast("double"), ex(i + COORDINATES, 3).try_cast("double")
    lat = F.when(F.upper(ex(i + COORDINATES, 2)) == "S", -lat).otherwise(lat)
    lng = F.when((F.upper(ex(i + COORDINATES, 4)) == "W") & (lng > 0), -lng).otherwise(lng)
    word = F.upper(ex(i + DIRECTION, 1))
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(word, "NORTH", "N"), "SOUTH", "S"), "EAST", "E"), "WEST", "W"), "-", "")
    wind = F.array_position(F.array(*map(F.lit, WINDS)), short)
    # a compass word is spelled out or abbreviated, with a hyphen only between whole words
    fine = word.isin(WINDS) | word.rlike(r"^(?:(?:NORTH|SOUTH)-?(?:EAST|WEST)?|EAST|WEST|(?:NORTH|SOUTH|EAST|WEST)-(?:NORTH|SOUTH)(?:EAST|WEST))$") & ~word.endswith("-")
    bearing = F.coalesce(ex(i + BEARING, 1).try_cast("double"), F.when(fine & (wind > 0), (wind - 1) * 22.5))
    category = F.coalesce(*[F.when(text.rlike(i + p), n) for p, n in CATEGORIES])
    terrain = F.when(text.rlike(i + MOUNTAIN), "mountainous").when(text.rlike(i + FLAT), "flat")
    return {"lat": lat, "lng": lng, "point_kind": ex(r"\b(IPP|LKP|PLS)\b", 1), "bearing": bearing, "category": category, "terrain": terrain}


def parse_reply(text: str) -> tuple[dict, list[str]]:
    """(fields, discarded names) of a reader's JSON reply, fenced or not: allowed keys with valid values; half a point is dropped.

    A reply that is no JSON, or no object, has no fields and says so among the discarded names.
    """
    try:
        raw = json.loads(re.sub(r"^```(?:json)?\s*|\s*```$", "", text.strip()))
    except (ValueError, RecursionError):
        return {}, ["(reply was not JSON)"]
    if not isinstance(raw, dict):
        return {}, ["(reply was not an object)"]
    num = lambda lo, hi: lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and lo <= v <= hi
    checks = dict(zip(REPLY_KEYS, (num(-90, 90), num(-180, 180), ("IPP", "LKP", "PLS").__contains__, num(0, 360), SUBJECTS.__contains__, ("mountainous", "flat").__contains__), strict=True))
    out, gone = {}, []
    for k, v in raw.items():
        if k in checks and isinstance(v, (int, float, str)) and checks[k](v):
            out[k] = v
        else:
            gone.append(k)
    if ("lat" in out) != ("lng" in out):
        gone.append("lat" if "lat" in out else "lng")
        out.pop(gone[-1])
    return out, gone


def _filled(field: dict, name: str, kind: str):
    v = field.get(name)
    return float(v) if v is not None and kind == "double" else v


REPLY_DDL = "lat double, lng double, pointKind string, travelBearingDeg double, subjectCategory string, terrain string, discarded array<string>"


def parse_replies(df: DataFrame, key: str, reply: str) -> DataFrame:
    """(key, lat, lng, pointKind, travelBearingDeg, subjectCategory, terrain, discarded) for a column of replies; a null reply is no JSON. No reply fails the job."""
    kind = dict(df.dtypes)[key]
    names = [(n, k) for n, k in (c.strip().split(" ", 1) for c in REPLY_DDL.split(",")) if n != "discarded"]

    def run(batches):
        for pdf in batches:
            got = [parse_reply(t or "") for t in pdf["t"]]
            yield pd.DataFrame({key: pdf[key], **{n: pd.Series([_filled(f, n, k) for f, _ in got], dtype="float64" if k == "double" else "object") for n, k in names}, "discarded": [g for _, g in got]})

    return df.select(key, F.col(reply).alias("t")).mapInPandas(run, f"{key} {kind}, {REPLY_DDL}")


def read_incidents(df: DataFrame, key: str, text: str, enabled: bool = True) -> DataFrame:
    """(key, sent, phone, email, name, health, lat, lng, point_kind, bearing, category, terrain): redacted first, then read by patterns from what is left.

    A reader that is switched off is refused before anything is read.
    """
    if not enabled:
        raise ValueError("the reader is switched off")
    clean = redact(df, key, text).withColumnRenamed("text", "sent")
    return clean.select(key, "sent", "phone", "email", "name", "health", *[c.alias(n) for n, c in read_local(F.col("sent")).items()])


_AXIS = re.compile(r"^\s*([NSEW])?\s*(-)?\s*(\d{1,3}(?:\.\d+)?)\s*[°d]?\s*(?:(\d{1,2}(?:\.\d+)?)\s*['′m]?\s*(?:(\d{1,2}(?:\.\d+)?)\s*(?:\"|″|''|s)?\s*)?)?([NSEW])?\s*$", re.I)
_UTM = re.compile(r"^(?:zone\s*)?(\d{1,2})\s*([C-HJ-NP-X])?\s*,?\s*(\d{6}(?:\.\d+)?)\s*(?:m?\s*E)?\s*,?\s*(\d{7}(?:\.\d+)?)\s*(?:m?\s*N)?$", re.I)
_A_WGS, _F_WGS, _K0 = 6_378_137.0, 1 / 298.257223563, 0.9996


def utm_to_latlng(zone: int, easting: float, northing: float, south: bool = False) -> tuple[float, float]:
    """Inverse transverse Mercator by the Krueger series."""
    n = _F_WGS / (2 - _F_WGS)
    big = _A_WGS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    xi, eta = (northing - (1e7 if south else 0)) / (_K0 * big), (easting - 500_000) / (_K0 * big)
    x = xi - sum(b * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, b in enumerate(beta, 1))
    e = eta - sum(b * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, b in enumerate(beta, 1))
    chi = math.asin(math.sin(x) / math.cosh(e))
    lat = chi + sum(d * math.sin(2 * j * chi) for j, d in enumerate(delta, 1))
    return math.degrees(lat), zone * 6 - 183 + math.degrees(math.atan2(math.sinh(e), math.cos(x)))


def _axis(text: str):
    m = _AXIS.match(text)
    if not m or m[1] and m[6]:
        return None
    deg, minutes, seconds = float(m[3]), float(m[4] or 0), float(m[5] or 0)
    if minutes >= 60 or seconds >= 60 or m[4] and deg % 1 or m[5] and minutes % 1:
        return None
    side = (m[1] or m[6] or "").upper()
    if m[2] and side in ("S", "W"):
        return None
    v = deg + minutes / 60 + seconds / 3600
    return (-v if m[2] or side in ("S", "W") else v), side, 3 if m[5] else 2 if m[4] else 1


def parse_coordinate(text: str | None) -> dict:
    """lat, lng, format and warnings of a coordinate as text, or an error."""
    t = re.sub("[“”]", '"', re.sub("[‘’]", "'", (text or "").strip()))
    if not t:
        return {"error": "empty"}
    up = lambda v: math.floor(v * 1e7 + 0.5) / 1e7
    if m := _UTM.match(t):
        zone, band = int(m[1]), (m[2] or "").upper()
        if not 1 <= zone <= 60:
            return {"error": "no such zone"}
        lat, lng = utm_to_latlng(zone, float(m[3]), float(m[4]), bool(band) and band < "N")
        return {"lat": up(lat), "lng": up(lng), "format": "utm", "warnings": [] if band else ["no band letter: northern hemisphere"]}
    cut = next(([t.split(s)] for s in ",;/" if len(t.split(s)) == 2), None)
    if cut is None:
        w = t.split()
        cut = [[" ".join(w[:i]), " ".join(w[i:])] for i in range(1, len(w))]
    for a, b in cut:
        x, y = _axis(a), _axis(b)
        if not x or not y or x[2] != y[2]:
            continue
        warn = []
        if x[1] in ("E", "W") or y[1] in ("N", "S"):
            x, y = y, x
        elif not x[1] and not y[1] and abs(x[0]) > 90 >= abs(y[0]):
            x, y = y, x
            warn.append("read as longitude, latitude")
        if x[1] in ("E", "W") or y[1] in ("N", "S") or abs(x[0]) > 90 or abs(y[0]) > 180:
            continue
        if y[0] > 0 and not y[1]:
            warn.append("east of Greenwich")
        return {"lat": up(x[0]), "lng": up(y[0]), "format": ("decimal", "degrees-minutes", "degrees-minutes-seconds")[x[2] - 1], "warnings": warn}
    return {"error": "not a coordinate"}


def parse_coordinates(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, lat, lng, format, warnings, error) for a column of coordinate texts."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        for pdf in batches:
            got = [parse_coordinate(t) for t in pdf["t"]]
            yield pd.DataFrame({key: pdf[key], **{n: [g.get(n) for g in got] for n in ("lat", "lng", "format", "warnings", "error")}})

    return df.select(key, F.col(text).alias("t")).mapInPandas(run, f"{key} {kind}, lat double, lng double, format string, warnings array<string>, error string")
