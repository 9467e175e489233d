"""Readers of search files, trails, tables, documents and tiles. Problems are rows, not exceptions."""

from __future__ import annotations

import html
import io
import json
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURE = "struct<id:string,type:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>"
COLLECTION = f"struct<type:string,features:array<{FEATURE}>,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>"
#: Times between the years 2000 and 2100, in epoch milliseconds, without the bounds.
FIRST_MS, LAST_MS = 946_684_800_000, 4_102_444_800_000
KM_PER_MILE = 1.609344
PERCENTS = (25, 50, 75, 95)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def sniff(text: Column) -> Column:
    """geojson, gpx or null by the first sign."""
    t = F.ltrim(F.substring(text, 1, 200))
    return F.when(t.startswith("{"), "geojson").when(t.startswith("<"), "gpx")


def is_epoch_ms(c: Column) -> Column:
    return (c > FIRST_MS) & (c < LAST_MS)


def clean_label(c: Column) -> Column:
    """White space collapsed, at most 40 characters."""
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, 40)


def features(files: DataFrame) -> DataFrame:
    """(file, i, kind, class, geometry, coordinates, label, properties) of the features of GeoJSON texts; coordinates stay JSON."""
    rows = files.where(sniff(F.col("text")) == "geojson").select("file", F.from_json("text", COLLECTION).alias("c"))
    each = rows.select("file", F.posexplode("c.features").alias("i", "f"))
    p = F.col("f.properties")
    label = clean_label(F.concat_ws(" ", F.concat(F.coalesce(p["letter"], F.lit("")), F.coalesce(p["number"], F.lit(""))), p["title"]))
    return each.select("file", "i", F.coalesce("f.id", F.col("i").cast("string")).alias("source_id"), p["class"].alias("class"), F.col("f.geometry.type").alias("geometry"), F.col("f.geometry.coordinates").alias("coordinates"), label.alias("label"), p["coordTimes"].alias("coord_times"))


def import_geojson(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assignments, track points, skipped) of GeoJSON texts in longitude and latitude.

    A folder without geometry is left out silently. Assignments are features of that class and unclassed polygons: no holes, at
    least three vertices after repeated and closing ones are dropped. A line is a track if each point has a time, as fourth
    coordinate or in coordTimes. Everything else is skipped with its reason.
    """
    f = features(files).where(~((F.coalesce("class", F.lit("")) == "Folder") & F.col("geometry").isNull()))
    ring = F.from_json("coordinates", "array<array<array<double>>>")
    planned = (F.col("class") == "Assignment") | (F.col("class").isNull() & (F.col("geometry") == "Polygon"))
    poly = f.where(planned).withColumn("rings", F.when(F.col("geometry") == "Polygon", ring))
    pts = F.transform(F.get("rings", F.lit(0)), lambda c: F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y")))
    pts = F.filter(pts, lambda p, i: (i == 0) | ~(F.get(pts, i - 1)["x"].eqNullSafe(p["x"]) & F.get(pts, i - 1)["y"].eqNullSafe(p["y"])))
    poly = poly.withColumn("points", pts)
    open_ = F.when((F.size("points") > 1) & (F.get("points", F.lit(0)) == F.element_at("points", -1)), F.slice("points", F.lit(1), F.size("points") - 1)).otherwise(F.col("points"))
    poly = poly.withColumn("points", open_)
    reason = F.when(F.col("geometry") != "Polygon", "assignment is not a polygon").when(F.col("geometry").isNull(), "no geometry").when(F.size("rings") > 1, "polygon with holes").when(F.coalesce(F.size("points"), F.lit(0)) < 3, "fewer than 3 vertices")
    poly = poly.withColumn("reason", reason)
    line = f.where(~F.coalesce(planned, F.lit(False)) & (F.col("geometry") == "LineString")).withColumn("c", F.from_json("coordinates", "array<array<double>>"))
    times = F.from_json("coord_times", "array<string>")
    stamp = lambda c, i: F.coalesce(F.when(is_epoch_ms(F.get(c, F.lit(3))), F.get(c, F.lit(3)).cast("long")), F.when(is_epoch_ms(F.try_to_number(F.get(times, i), F.lit("9999999999999")).cast("long")), F.try_to_number(F.get(times, i), F.lit("9999999999999")).cast("long")), F.unix_millis(F.try_to_timestamp(F.get(times, i))))
    line = line.withColumn("points", F.transform("c", lambda c, i: F.struct(i.alias("seq"), F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y"), stamp(c, i).alias("t"))))
    timed = F.forall("points", lambda p: F.coalesce(is_epoch_ms(p["t"]), F.lit(False))) & (F.size("points") >= 2)
    line = line.withColumn("reason", F.when(~timed, "line without times"))
    rest = f.where(~F.coalesce(planned, F.lit(False)) & F.coalesce(F.col("geometry") != "LineString", F.lit(True))).withColumn("reason", F.lit("not an assignment or a track"))
    good = poly.where("reason is null").select("file", "source_id", "label", "points")
    tracks = line.where("reason is null").select("file", "source_id", F.explode("points").alias("p")).select("file", "source_id", "p.*")
    keep = ["file", "source_id", "reason"]
    return good, tracks, poly.where("reason is not null").select(keep).unionByName(line.where("reason is not null").select(keep)).unionByName(rest.select(keep))


def import_gpx(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(track points, skipped) of GPX texts: a segment with a bad point or fewer than two is skipped whole; a file without segments is."""
    rows = files.where(sniff(F.col("text")) == "gpx").select("file", F.regexp_extract_all("text", F.lit(r"(?s)<trkseg\b[^>]*>(.*?)</trkseg>"), F.lit(1)).alias("segs"))
    none = rows.where(F.size("segs") == 0).select("file", F.lit("file").alias("source_id"), F.lit("no track segment").alias("reason"))
    seg = rows.select("file", F.posexplode("segs").alias("seg", "body")).select("file", "seg", F.regexp_extract_all("body", F.lit(r"(?s)(<trkpt\b.*?(?:</trkpt>|/>))"), F.lit(1)).alias("pts"))
    attr = lambda p, n: F.regexp_extract(p, rf"\b{n}\s*=\s*[\"']([^\"']*)[\"']", 1).try_cast("double")
    pt = F.transform("pts", lambda p, i: F.struct(i.alias("seq"), attr(p, "lon").alias("x"), attr(p, "lat").alias("y"), F.unix_millis(F.try_to_timestamp(F.regexp_extract(p, r"<time>\s*([^<]*?)\s*</time>", 1))).alias("t")))
    seg = seg.withColumn("p", pt)
    bad = F.exists("p", lambda p: p["x"].isNull() | p["y"].isNull() | ~F.coalesce(is_epoch_ms(p["t"]), F.lit(False)))
    seg = seg.withColumn("reason", F.when(bad, "a point without position or time").when(F.size("p") < 2, "fewer than 2 points"))
    name = F.concat(F.lit("trkseg "), F.col("seg").cast("string"))
    good = seg.where("reason is null").select("file", name.alias("source_id"), F.explode("p").alias("q")).select("file", "source_id", "q.*")
    return good, none.unionByName(seg.where("reason is not null").select("file", name.alias("source_id"), "reason"))


def import_trails(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines: file, line, points) and (file, skipped) of trail files without times: track segments before routes, or GeoJSON lines."""
    gpx = files.where(sniff(F.col("text")) == "gpx")
    blocks = F.concat(F.regexp_extract_all("text", F.lit(r"(?s)<trkseg\b[^>]*>(.*?)</trkseg>"), F.lit(1)), F.regexp_extract_all("text", F.lit(r"(?s)<rte\b[^>]*>(.*?)</rte>"), F.lit(1)))
    attr = lambda p, n: F.regexp_extract(p, rf"\b{n}\s*=\s*[\"']([^\"']*)[\"']", 1).try_cast("double")
    pts = F.filter(F.transform(F.regexp_extract_all("body", F.lit(r"(<(?:trkpt|rtept)\b[^>]*>)"), F.lit(1)), lambda p: F.struct(attr(p, "lon").alias("lng"), attr(p, "lat").alias("lat"))), lambda p: p["lng"].isNotNull() & p["lat"].isNotNull())
    a = gpx.select("file", F.posexplode(blocks).alias("line", "body")).select("file", F.col("line").cast("long").alias("line"), pts.alias("points"))
    doc = files.where(sniff(F.col("text")) == "geojson").select("file", F.from_json("text", COLLECTION).alias("c"))
    geoms = doc.select("file", F.posexplode(F.when(F.col("c.features").isNotNull(), F.transform("c.features", lambda f: f["geometry"])).otherwise(F.array("c.geometry"))).alias("i", "g")).where("g is not null")
    multi = F.when(F.col("g.type") == "LineString", F.array(F.from_json("g.coordinates", "array<array<double>>"))).when(F.col("g.type") == "MultiLineString", F.from_json("g.coordinates", "array<array<array<double>>>"))
    lines = geoms.where(F.col("g.type").isin("LineString", "MultiLineString")).select("file", "i", F.posexplode(multi).alias("k", "c"))
    lines = lines.select("file", (F.col("i").cast("long") * (1 << 31) + F.col("k")).alias("line"), F.filter(F.transform("c", lambda p: F.struct(F.get(p, F.lit(0)).alias("lng"), F.get(p, F.lit(1)).alias("lat"))), lambda p: p["lng"].isNotNull() & p["lat"].isNotNull()).alias("points"))
    every = a.unionByName(lines)
    other = geoms.where(~F.col("g.type").isin("LineString", "MultiLineString")).select("file")
    skipped = every.where(F.size("points") < 2).select("file").unionByName(other).groupBy("file").agg(F.count("*").alias("skipped"))
    return every.where(F.size("points") >= 2), skipped


def parse_behaviour_csv(lines: DataFrame, miles: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entries, problems) of behaviour tables given as (file, line_no from 1, line).

    Comments and blanks are left out, a header only counts on line 1, seven cells at least, ring distances increase, dispersions
    are all there or none, categories and terrains are unique in a file. One problem rejects its whole file.
    """
    cell = lambda k: F.trim(F.get("cells", F.lit(k)))
    rows = lines.where((F.trim("line") != "") & ~F.ltrim("line").startswith("#")).where(~((F.col("line_no") == 1) & F.lower("line").startswith("category"))).withColumn("cells", F.split("line", ","))
    num = lambda k: cell(k).try_cast("double")
    scale = KM_PER_MILE if miles else 1.0
    km = [F.floor(num(3 + i) * scale * 1000 + 0.5) / 1000 for i in range(4)]
    disp = [num(7 + i) for i in range(4)]
    given = F.size(F.filter(F.slice("cells", F.lit(8), F.lit(4)), lambda c: F.trim(c) != ""))
    v = rows.withColumns({"category": F.lower(cell(0)), "terrain": F.coalesce(F.nullif(F.lower(cell(1)), F.lit("")), F.lit("any")), "n": cell(2).try_cast("int"), "short": F.size("cells") < 7, "given": given, **{f"ring{p}": k for p, k in zip(PERCENTS, km, strict=True)}, **{f"disp{p}": k for p, k in zip(PERCENTS, disp, strict=True)}})
    rising = (F.col("ring25") > 0) & (F.col("ring25") < F.col("ring50")) & (F.col("ring50") < F.col("ring75")) & (F.col("ring75") < F.col("ring95"))
    from pyspark.sql import Window as W

    again = F.count("*").over(W.partitionBy("file", "category", "terrain")) > 1
    v = v.withColumn("again", again)
    problem = F.when(F.col("short"), "fewer than 7 cells").when(F.coalesce("category", F.lit("")) == "", "no category").when(~F.coalesce(rising, F.lit(False)), "ring distances must increase").when((F.col("given") > 0) & (F.col("given") < 4), "all four dispersions or none").when(F.col("again"), "category and terrain occur twice")
    v = v.withColumn("problem", problem)
    problems = v.where("problem is not null").select("file", "line_no", "problem")
    good = v.join(problems.select("file").distinct(), "file", "left_anti").select("file", "line_no", "category", "terrain", "n", *[f"ring{p}" for p in PERCENTS], *[f"disp{p}" for p in PERCENTS])
    return good, problems


def lookup_behaviour(wanted: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """``wanted`` (key, category, terrain) with the entry of its terrain, else of "any" (``fallback`` true), else nulls."""
    e = entries.select(F.col("category").alias("c"), F.col("terrain").alias("t"), *[f"{k}{p}" for k in ("ring", "disp") for p in PERCENTS])
    c, t = F.lower(F.trim("category")), F.lower(F.trim("terrain"))
    j = wanted.select(key, c.alias("c"), t.alias("want")).join(F.broadcast(e), "c").where((F.col("t") == F.col("want")) | (F.col("t") == "any"))
    best = j.groupBy(key).agg(F.min(F.struct((F.col("t") != F.col("want")).alias("fallback"), *[f"{k}{p}" for k in ("ring", "disp") for p in PERCENTS])).alias("b"))
    return wanted.join(best, key, "left").select(*wanted.columns, "b.*")


# The subject categories of the exercise table.
EXERCISE_CATEGORIES = "hiker,hunter,climber,skier,snowshoer,mountain biker,angler,gatherer,runner,camper,child,youth,other".split(",")


def exercise_table(spark: SparkSession) -> DataFrame:
    """Invented round values for training, the same for every category and terrain; no research data."""
    rows = [(c, t) for c in EXERCISE_CATEGORIES for t in ("mountainous", "flat")]
    values = {f"ring{p}": v for p, v in zip(PERCENTS, (1.0, 2.0, 4.0, 10.0), strict=True)} | {f"disp{p}": v for p, v in zip(PERCENTS, (30.0, 60.0, 90.0, 150.0), strict=True)}
    return spark.createDataFrame(rows, "category string, terrain string").withColumn("n", F.lit(None).cast("int")).withColumns({k: F.lit(v) for k, v in values.items()})


def categories(entries: DataFrame) -> DataFrame:
    return entries.select("category").distinct()


def terrains(entries: DataFrame, category: str | None = None) -> DataFrame:
    """The terrains of a table, or of one of its categories whatever its case."""
    rows = entries if category is None else entries.where(F.col("category") == category.lower())
    return rows.select("terrain").distinct()


def saved_table_problems(entries: DataFrame, by: list[str] = ("file",)) -> DataFrame:
    """(by, category, terrain, problem) of behaviour tables read from storage: what a table may not hold is refused again, whoever wrote it.

    Names of 1 to 40 characters, case counts above zero, increasing distances above zero, all dispersions or none, increasing up to 360 degrees, no
    category and terrain twice. A table with one problem is not to be used.
    """
    by = list(by)
    name = lambda c: F.coalesce(F.length(F.trim(c)).between(1, 40), F.lit(False))
    rising = lambda p: F.coalesce((F.col(f"{p}25") > 0) & (F.col(f"{p}25") < F.col(f"{p}50")) & (F.col(f"{p}50") < F.col(f"{p}75")) & (F.col(f"{p}75") < F.col(f"{p}95")), F.lit(False))
    given = sum((F.col(f"disp{p}").isNotNull().cast("int") for p in PERCENTS), F.lit(0))
    low = lambda c: F.lower(F.trim(c))
    twice = entries.groupBy(*by, low("category").alias("c_"), low("terrain").alias("t_")).agg((F.count("*") > 1).alias("twice_"))
    rows = entries.withColumns({"c_": low("category"), "t_": low("terrain")}).join(twice, [*by, "c_", "t_"], "left")
    checks = [
        F.when(~name("category") | ~name("terrain"), "category and terrain must be 1 to 40 characters"),
        F.when(F.col("n") <= 0, "case counts must be above zero"),
        F.when(~rising("ring"), "ring distances must increase"),
        F.when((given > 0) & (given < 4), "all four dispersions or none"),
        F.when((given == 4) & (~rising("disp") | (F.col("disp95") > 360)), "dispersion angles must increase up to 360"),
        F.when(F.col("twice_"), "category and terrain occur twice"),
    ]
    return rows.select(*by, "category", "terrain", F.explode(F.array_compact(F.array(*checks))).alias("problem"))


def doc_kind(name: Column, mime: Column | None = None) -> Column:
    """pdf, docx, text or unsupported, by extension and type."""
    ext = F.lower(F.when(name.contains("."), F.substring_index(name, ".", -1)))
    mime = F.coalesce(mime, F.lit("")) if mime is not None else F.lit("")
    docx = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
    text = ext.isin("txt", "md", "csv", "json", "eml", "log", "rtf") | mime.startswith("text/")
    return F.when((ext == "pdf") | (mime == "application/pdf"), "pdf").when((ext == "docx") | (mime == docx), "docx").when(F.coalesce(text, F.lit(False)), "text").otherwise("unsupported")


def docx_text(blob: bytes) -> str:
    """Text of a word-processor file: paragraphs and breaks as lines, tabs kept, runs of blank lines shortened."""
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        xml = z.read("word/document.xml").decode("utf-8", "replace")
    for tag, to in ((r"<w:tab\b[^>]*/>", "\t"), (r"<w:(?:br|cr)\b[^>]*/>", "\n"), (r"</w:p>", "\n"), (r"<[^>]+>", "")):
        xml = re.sub(tag, to, xml)
    return re.sub(r"\n{3,}", "\n\n", html.unescape(xml)).strip()


def rtf_text(rtf: str) -> str:
    """Plain text of rich text: starred groups dropped, paragraphs as lines, hexadecimal signs decoded."""
    t = re.sub(r"\{\\\*[^{}]*\}", "", rtf)
    t = re.sub(r"\\(?:par|line)\b ?", "\n", t)
    t = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), t)
    return re.sub(r"[{}]", "", re.sub(r"\\[a-zA-Z]+-?\d* ?", "", t)).strip()


def read_documents(files: DataFrame) -> DataFrame:
    """(name, kind, text, problem) of files (name, content binary); what cannot be read has a problem instead of a text."""

    def run(batches):
        for pdf in batches:
            out = []
            for name, kind, blob in zip(pdf["name"], pdf["kind"], pdf["content"], strict=True):
                text, problem = None, None
                try:
                    if kind == "docx":
                        text = docx_text(bytes(blob))
                    elif kind == "text":
                        text = bytes(blob).decode("utf-8", "replace")
                        text = rtf_text(text) if text.lstrip().startswith("{\\rtf") else text
                    else:
                        problem = "no reader for this kind of file"
                except (zipfile.BadZipFile, KeyError):
                    problem = "the file could not be read"
                out.append((name, kind, text, problem))
            yield pd.DataFrame(out, columns=["name", "kind", "text", "problem"])

    return files.select("name", doc_kind(F.col("name")).alias("kind"), "content").mapInPandas(run, "name string, kind string, text string, problem string")


def read_ridge_tiles(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(key, tile, polygon) of the polygons in tile files <i_j>.json that the wanted (key, tile, south, west, north, east) boxes meet."""
    raw = spark.read.schema("v string, p array<array<array<array<double>>>>").option("multiLine", True).json(path).withColumn("tile", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1))
    polys = raw.select("tile", F.explode("p").alias("polygon")).join(wanted, "tile")
    outer = F.get("polygon", F.lit(0))
    x, y = F.transform(outer, lambda q: F.get(q, F.lit(0))), F.transform(outer, lambda q: F.get(q, F.lit(1)))
    return polys.where((F.array_max(x) >= F.col("west")) & (F.array_min(x) <= F.col("east")) & (F.array_max(y) >= F.col("south")) & (F.array_min(y) <= F.col("north"))).select("key", "tile", "polygon")


def write_search_map(features: DataFrame, path: str) -> None:
    """One GeoJSON feature per line, written in parallel."""
    features.select(F.to_json(F.struct(*features.columns)).alias("value")).write.mode("overwrite").text(path)


def feature_collection(lines: list[str]) -> str:
    return json.dumps({"type": "FeatureCollection", "features": [json.loads(x) for x in lines]}, separators=(",", ":"))
