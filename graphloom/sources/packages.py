"""Scans of package registries and citation dumps, and their projection to dated nodes and edges.

Every scan gives raw records; every projection gives (name, date, date_latest, text, deps), which
``induce`` turns into a graph with dense ids. Nothing here touches the network: a crawl runs over
a table of dependencies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tables import Scratch

# Formats of the records, and what the filters leave out.
NPM = "_id string, name string, description string, keywords string, readme string, time map<string,string>, `dist-tags` map<string,string>, versions map<string,struct<dependencies:map<string,string>>>"
MAVEN = "ga string, `group` string, artifact string, latest string, first_date string, latest_date string, latest_is_prerelease boolean, n_versions int, name string, description string, deps map<string,string>"
POM = "groupId string, artifactId string, name string, description string, parent struct<groupId:string>, dependencies struct<dependency:array<struct<groupId:string,artifactId:string,version:string,scope:string,optional:string>>>"
ATOM = "entry array<struct<id:string,title:string,summary:string,published:string>>"
SCOPES_LEFT_OUT = ["test", "provided", "system", "import"]
LISTING = r'href="([^"/]+)/"[^\n]*?(\d{4}-\d{2}-\d{2})'
README_CHARS, KEYWORD_CHARS = 1500, 400
#: Borders of the slices in which names are numbered.
SLICES = 256


def collapsed(c: Column) -> Column:
    """White space runs as one space, ends trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def untagged(c: Column) -> Column:
    return collapsed(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "))


def filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records, one a file, with the file's name; a file that doesn't parse is counted by ``broken``."""
    held = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return held.withColumn("file", F.col("_metadata.file_name"))


def broken(raw: DataFrame) -> DataFrame:
    return raw.agg(F.count("*").alias("records"), F.count("_corrupt").alias("broken"))


def npm_file(name: Column) -> Column:
    """File of a package: a slash in a scoped name becomes two underscores."""
    return F.concat(F.replace(name, F.lit("/"), F.lit("__")), F.lit(".json"))


def maven_file(ga: Column) -> Column:
    return F.concat(F.replace(ga, F.lit(":"), F.lit("__")), F.lit(".json"))


def maven_path(ga: Column) -> Column:
    """Path of a coordinate in a repository: dots of the group become slashes."""
    return F.concat(F.replace(F.split_part(ga, F.lit(":"), F.lit(1)), F.lit("."), F.lit("/")), F.lit("/"), F.split_part(ga, F.lit(":"), F.lit(2)))


def _outside(deps: Column) -> Column:
    """Names of a dependency map but for the runtime's own modules."""
    return F.coalesce(F.filter(F.map_keys(deps), lambda x: ~x.startswith("node:")), F.array().cast("array<string>"))


def npm_frontier(raw: DataFrame) -> DataFrame:
    """name and deps as a crawl follows them: those of the latest version, none where no version is tagged."""
    return raw.select("name", _outside(F.try_element_at("versions", F.try_element_at("dist-tags", F.lit("latest")))["dependencies"]).alias("deps"))


def npm_records(raw: DataFrame, when: str = "created", deps: str = "latest", readme: int = README_CHARS) -> DataFrame:
    """name, date, date_latest, text and deps of npm records; those without a name or creation time go.

    when: created, modified, or latest (time of the tagged version). deps: latest, or all versions'
    together. Without a tag, the newest version that has dependencies stands for the latest.
    readme: characters of the README in the text; -1 leaves the description alone.
    """
    time = lambda key: filled(F.try_element_at("time", key))
    tag, created = F.try_element_at("dist-tags", F.lit("latest")), time(F.lit("created"))
    modified = F.coalesce(time(F.lit("modified")), created)
    date = {"created": created, "modified": modified, "latest": F.coalesce(time(tag), modified)}[when]
    some = F.filter(F.map_entries("versions"), lambda e: F.coalesce(F.size(e["value"]["dependencies"]), F.lit(0)) > 0)
    newest = F.try_element_at(F.array_sort(F.transform(some, lambda e: F.struct(F.coalesce(F.try_element_at("time", e["key"]), F.lit("")).alias("at"), e["key"].alias("key")))), F.lit(-1))["key"]
    if deps == "latest":
        held = _outside(F.try_element_at("versions", F.coalesce(tag, newest))["dependencies"])
    else:
        each = F.transform(F.map_values("versions"), lambda v: _outside(v["dependencies"]))
        held = F.coalesce(F.array_distinct(F.flatten(each)), F.array().cast("array<string>"))
    words = F.when(F.col("keywords").startswith("["), F.array_join(F.from_json("keywords", "array<string>"), " ")).otherwise(F.col("keywords"))
    text = [filled(collapsed(F.col("description")))]
    if readme >= 0:
        text = [F.col("name"), *text, filled(F.substring(collapsed(words), 1, KEYWORD_CHARS)), filled(F.substring(collapsed(F.col("readme")), 1, readme))]
    return raw.where((F.coalesce("name", F.lit("")) != "") & created.isNotNull()).select("name", F.to_date(F.left(date, F.lit(10))).alias("date"), F.to_date(F.left(modified, F.lit(10))).alias("date_latest"), F.concat_ws(" ", *text).alias("text"), held.alias("deps"))


def maven_records(raw: DataFrame, when: str = "latest_date") -> DataFrame:
    """The same of Maven records; a missing title falls back on the artifact, then on the coordinate."""
    title = F.coalesce(filled(F.col("name")), filled(F.col("artifact")), F.col("ga"))
    said = untagged(F.concat_ws(" ", title, F.col("description")))
    text = F.coalesce(filled(said), untagged(F.col("ga")))
    kept = raw.where((F.coalesce("ga", F.lit("")) != "") & (F.coalesce("first_date", F.lit("")) != ""))
    return kept.select(F.col("ga").alias("name"), F.to_date(F.coalesce(filled(F.col(when)), F.col("first_date"))).alias("date"), F.to_date(F.coalesce(filled(F.col("latest_date")), F.col("first_date"))).alias("date_latest"), text.alias("text"), F.coalesce(F.map_keys("deps"), F.array().cast("array<string>")).alias("deps"))


def name_numbers(names: DataFrame) -> DataFrame:
    """``names`` (distinct, in column name) with id: their place in order from 0.

    Names are numbered within slices between borders drawn by hash, so no task holds them all
    and every evaluation gives the same ids.
    """
    drawn = sorted(r[0] for r in names.select("name").orderBy(F.xxhash64("name"), "name").limit(SLICES * 8).collect())
    if len(drawn) <= 8:  # these are all of them
        return names.withColumn("id", (F.row_number().over(Window.orderBy("name")) - 1).cast("bigint"))
    borders = F.array(*map(F.lit, drawn[8::8]))
    cut = names.withColumn("s", F.size(F.filter(borders, lambda b: b <= F.col("name"))))
    before = F.coalesce(F.sum("k").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = cut.groupBy("s").agg(F.count("*").alias("k")).select("s", before.alias("before"))  # SLICES rows at most
    inside = F.row_number().over(Window.partitionBy("s").orderBy("name"))
    return cut.withColumn("i", inside).join(F.broadcast(first), "s").withColumn("id", F.col("before") + F.col("i") - 1).drop("s", "i", "before")


def induce(records: DataFrame, since: str | None = None, until: str | None = None, min_edges: int = 0) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, name, d, d_latest, text; edges: src, tgt) of the records in a span of dates.

    Of records with one name the one with the latest date stays. An edge needs both ends among
    the nodes; loops and repeats go. min_edges > 0 drops nodes without an edge. ``until`` counts
    only along with ``since``.
    """
    if since:
        records = records.where(F.col("date") >= F.to_date(F.lit(since)))
        if until:
            records = records.where(F.col("date") <= F.to_date(F.lit(until)))
    one = records.groupBy("name").agg(F.max_by(F.struct("date", "date_latest", "text", "deps"), F.struct("date", "date_latest", "text")).alias("r")).select("name", "r.*")
    one = Scratch(one.sparkSession).keep(one, "records")  # read by the result: records are parsed once
    wants = lambda rows, *c: rows.select(*c, "name", F.explode(F.array_distinct("deps")).alias("dep")).where("name <> dep").drop(*({"name"} if c else ()))
    if min_edges:
        known = wants(one).join(one.select(F.col("name").alias("dep")), "dep", "left_semi")
        one = one.join(known.select("name").union(known.select("dep")).distinct(), "name", "left_semi")
    nodes = name_numbers(one.select("name", "date", "date_latest", "text"))
    ids = nodes.select("name", "id")
    own = one.select("name", "deps").join(ids.withColumnRenamed("id", "src"), "name")
    edges = wants(own, "src").join(ids.select(F.col("name").alias("dep"), F.col("id").alias("tgt")), "dep").select("src", "tgt")
    return nodes.select("id", "name", F.col("date").alias("d"), F.col("date_latest").alias("d_latest"), "text"), edges


def listing_versions(pages: DataFrame) -> DataFrame:
    """``key`` and html of directory listings to (key, version, date); parents and snapshots go."""
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(LISTING), F.lit(1)).alias("version"), F.regexp_extract_all("html", F.lit(LISTING), F.lit(2)).alias("date"))
    rows = pages.select("key", F.explode(both).alias("x")).select("key", F.col("x.version").alias("version"), F.to_date("x.date").alias("date"))
    return rows.where((F.col("version") != "..") & ~F.col("version").endswith("-SNAPSHOT"))


def pom_dependencies(poms: DataFrame) -> DataFrame:
    """``key`` and pom (XML) to (key, ga, version): compile dependencies, the last of repeats.

    Left out: placeholders, scopes that don't reach a user, optional ones and the project itself.
    A missing group falls back on the parent's.
    """
    bare = F.regexp_replace("pom", r'\sxmlns(:\w+)?="[^"]*"', "")
    p = poms.select("key", F.from_xml(bare, POM).alias("p"))
    group = F.coalesce(filled(F.col("p.groupId")), F.col("p.parent.groupId"))
    rows = p.select("key", F.concat_ws(":", group, "p.artifactId").alias("own"), F.posexplode("p.dependencies.dependency").alias("at", "d"))
    ga = F.concat_ws(":", "d.groupId", "d.artifactId")
    rows = rows.select("key", "own", "at", ga.alias("ga"), F.coalesce("d.version", F.lit("")).alias("version"), F.coalesce("d.scope", F.lit("")).alias("scope"), F.coalesce("d.optional", F.lit("")).alias("optional"))
    rows = rows.where(~F.contains("ga", F.lit("${")) & ~F.col("scope").isin(SCOPES_LEFT_OUT) & (F.lower("optional") != "true") & (F.col("ga") != F.col("own")))
    return rows.groupBy("key", "ga").agg(F.max_by("version", "at").alias("version"))


def atom_entries(feeds: DataFrame) -> DataFrame:
    """``xml`` of Atom feeds to (id, title, summary, published); entries without a title or date go."""
    bare = F.regexp_replace("xml", r'\sxmlns(:\w+)?="[^"]*"', "")
    e = feeds.select(F.explode(F.from_xml(bare, ATOM)["entry"]).alias("e"))
    return e.select(F.regexp_extract("e.id", r"([^/]+?)(v\d+)?$", 1).alias("id"), collapsed(F.col("e.title")).alias("title"), collapsed(F.col("e.summary")).alias("summary"), F.to_date(F.left("e.published", F.lit(10))).alias("published")).where("title <> '' and published is not null")


def edge_lines(lines: DataFrame) -> DataFrame:
    """``value`` lines of an edge list to (src, tgt): comments and blanks go, ids get seven digits; longer ones go."""
    field = F.split(F.trim("value"), r"\s+")
    pad = lambda x: F.when(F.length(x) < 7, F.lpad(x, 7, "0")).otherwise(x)
    rows = lines.where(~F.trim("value").startswith("#") & (F.trim("value") != "")).where(F.size(field) >= 2)
    return rows.select(pad(field[0]).alias("src"), pad(field[1]).alias("tgt")).where("length(src) = 7 and length(tgt) = 7")


def id_year(paper: Column) -> Column:
    """Year of a seven-digit paper id, which begins with two digits of it."""
    y = F.substring(paper, 1, 2).cast("int")
    return F.when(y >= 90, 1900 + y).otherwise(2000 + y)


def seed_lines(lines: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``value`` lines of a seed file to distinct names: no comments, none without a colon, none ``known`` (name)."""
    names = lines.select(F.trim("value").alias("name")).where(~F.col("name").startswith("#") & F.contains("name", F.lit(":"))).distinct()
    return names.join(known, "name", "left_anti") if known is not None else names


def more_seeds(have: DataFrame, want: DataFrame, offers: DataFrame, groups: int, each: int = 20, most: int = 1200) -> DataFrame:
    """Further seeds from groups' listings: (grp, name).

    have, want: grp, k. A group scores what is had of it and up to 40 of what is wanted; the best
    ``groups`` give up to ``each`` of their offers (grp, name), and all together up to ``most``.
    """
    score = F.coalesce("have", F.lit(0)) + F.least(F.coalesce("want", F.lit(0)), F.lit(40))
    both = have.withColumnRenamed("k", "have").join(want.withColumnRenamed("k", "want"), "grp", "full_outer").select("grp", score.alias("score"))
    best = both.orderBy(F.desc("score"), "grp").limit(groups)
    some = offers.join(F.broadcast(best), "grp").withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy("name"))).where(F.col("r") <= each)
    return some.orderBy(F.desc("score"), "grp", "name").limit(most).select("grp", "name")


def crawl(seeds: DataFrame, deps: DataFrame, target: int | None = None) -> DataFrame:
    """(name, level) of what the seeds reach through deps (name, dep), a join a level, until no name is new.

    target: no further level once so many names are known. Dependencies are worked out once and written, as is each level.
    """
    held = Scratch(seeds.sparkSession)  # levels are read by the result
    with Scratch(seeds.sparkSession) as scratch:
        deps = scratch.keep(deps.select("name", "dep"), "dependencies")
        front = held.keep(seeds.select("name").distinct().withColumn("level", F.lit(0)), "level")
        seen, known, k = front, front.count(), 0
        while target is None or known < target:
            k += 1
            front = held.keep(front.join(deps, "name").select(F.col("dep").alias("name")).distinct().join(seen, "name", "left_anti").withColumn("level", F.lit(k)), "level")
            new = front.count()
            if not new:
                break
            seen, known = seen.union(front), known + new
    return seen
