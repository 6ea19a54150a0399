"""Model replies, decisions, overrides, logs and pages as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspan.functions import html, images

KINDS = ("people", "places", "concepts", "events")
_REPLY = "struct<" + ",".join(f"{k}:array<string>" for k in KINDS) + ",primary:string>"


def read_replies(replies: DataFrame) -> DataFrame:
    """(…, reply) with model text -> the first ``{…}`` in it as typed lists; whatever can't be read gives empty lists."""
    span = F.regexp_extract("reply", r"(?s)\{.*\}", 0)
    parsed = replies.withColumn("r", F.from_json(span, _REPLY))
    lists = [F.coalesce(F.col(f"r.{k}"), F.expr("cast(array() as array<string>)")).alias(k) for k in KINDS]
    return parsed.select(*replies.columns, *lists, F.coalesce("r.primary", F.lit("")).alias("primary")).drop("reply")


def reply_items(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Items of parsed replies in order: keys, kind, item_seq, surface, canonical. An item is a string or {name, canonical}; blank ones go."""
    lists = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("items")) for k in KINDS])
    out = parsed.select(*keys, F.explode(lists).alias("l")).select(*keys, "l.kind", F.posexplode("l.items").alias("item_seq", "item"))
    item = F.from_json("item", "struct<name:string,canonical:string>")
    nested = F.trim("item").startswith("{")
    surface = F.trim(F.when(nested, item["name"]).otherwise(F.col("item")))
    canonical = F.trim(F.coalesce(F.when(nested, item["canonical"]), surface))
    return out.withColumn("surface", surface).withColumn("canonical", F.when(canonical != "", canonical).otherwise(surface)).where("surface <> ''").drop("item")


def windowed_replies(replies: DataFrame) -> DataFrame:
    """Replies keyed by cue: {"3": {"numbers": [...], ...}} as one row per cue and list item; keys that aren't numbers go."""
    body = "map<string,struct<numbers:array<string>,dates:array<string>,quotes:array<string>,processes:array<string>,comparisons:array<string>>>"
    each = replies.select(*[c for c in replies.columns if c != "reply"], F.explode(F.from_json(F.regexp_extract("reply", r"(?s)\{.*\}", 0), body)).alias("key", "lists"))
    each = each.withColumn("cue_idx", F.expr("try_cast(key as int)")).where("cue_idx is not null")
    rest = [c for c in each.columns if c not in ("key", "lists")]
    kinds = (("numbers", "number"), ("dates", "date"), ("quotes", "quote"), ("processes", "process"), ("comparisons", "comparison"))
    lists = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(f"lists.{plural}").alias("items")) for plural, kind in kinds])
    return each.select(*rest, F.explode(lists).alias("l")).select(*rest, F.col("l.kind").alias("element_type"), F.posexplode("l.items").alias("item_seq", "item"))


def read_overrides(files: DataFrame) -> DataFrame:
    """(content) with a JSON map -> entity, title; keys that begin with an underscore are comments."""
    return files.select(F.explode(F.from_json("content", "map<string,string>")).alias("entity", "title")).where(~F.col("entity").startswith("_"))


def read_entity_maps(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Entity maps (one JSON document per file) as one row per transcript and entity."""
    raw = spark.read.schema(f"entities map<string,{schema}>").json(path, multiLine=True)
    return _entities(raw.select(F.col("_metadata.file_path").alias("transcript_id"), "entities"))


def read_entity_bundles(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same from bundles, one JSON document per line with its transcript_id."""
    return _entities(spark.read.schema(f"transcript_id long, entities map<string,{schema}>").json(path))


def _entities(maps: DataFrame) -> DataFrame:
    return maps.select("transcript_id", F.explode("entities").alias("entity", "payload")).select("transcript_id", "entity", "payload.*")


def read_elements(spark: SparkSession, path: str, schema: str = "element_type:string,timecode:string,cue_idx:int") -> DataFrame:
    """Visual elements (one JSON document with a map by id per file) as rows in order: transcript_id (the file), place, element_id and the elements' fields.

    Elements stand in order of their time code, one without counting as the start, and of their id.
    """
    raw = spark.read.schema(f"visual_elements map<string,struct<{schema}>>").json(path, multiLine=True)
    return _elements(raw.select(F.col("_metadata.file_path").alias("transcript_id"), "visual_elements"))


def read_element_bundles(spark: SparkSession, path: str, schema: str = "element_type:string,timecode:string,cue_idx:int") -> DataFrame:
    """The same from bundles, one JSON document per line with its transcript_id."""
    return _elements(spark.read.schema(f"transcript_id long, visual_elements map<string,struct<{schema}>>").json(path))


def _elements(maps: DataFrame) -> DataFrame:
    each = maps.select("transcript_id", F.explode("visual_elements").alias("element_id", "payload"))
    order = Window.partitionBy("transcript_id").orderBy(F.coalesce("payload.timecode", F.lit("00:00:00,000")), "element_id")
    return each.select("transcript_id", F.row_number().over(order).alias("place"), "element_id", "payload.*")


def read_download_log(lines: DataFrame) -> DataFrame:
    """(value) with tab-separated lines of five fields; lines of another width are dropped."""
    f = F.split("value", "\t", -1)
    return lines.where(F.size(f) == 5).select(*[f[k].alias(n) for k, n in enumerate(("search_term", "file_title", "category", "path", "source_url"))])


def read_attribution(spark: SparkSession, path: str) -> DataFrame:
    """Attribution files keyed by file name; of repeated names the last row of a file counts.

    A file's rows are in order of the block they are read from and, inside a block, which one task reads, of the task's row number.
    """
    rows = spark.read.csv(path, header=True).withColumn("file", F.col("_metadata.file_path")).withColumn("row", F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    last = F.row_number().over(Window.partitionBy("file", "filename").orderBy(F.desc("row")))
    return rows.withColumn("k", last).where("k = 1").drop("k", "row", "file")


#: Classes of containers that hold no content of an article, and the class of the element that holds all of it.
BOXES = ("navbox", "sister-bar", "noprint", "mbox-image-div", "portal-bar", "succession-box", "sistersitebox", "side-box")
CONTENT = "mw-parser-output"
UPLOAD_HOST = "upload.wikimedia.org"
_FILE_PATH = "/wiki/Special:FilePath/"


def _linked_file(href: Column) -> Column:
    """Name of the file page that an anchor leads to, null if it leads elsewhere."""
    after = lambda prefix: html.unquote(F.substring(href, len(prefix) + 1, 1 << 30))
    pairs = F.transform(F.split(F.regexp_extract(href, r"(?s)^[^?#]*\?([^#]*)", 1), "&"), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_extract(p, "(?s)=(.*)$", 1).alias("v")))
    title = F.get(F.filter(F.transform(F.filter(pairs, lambda p: F.replace(html.unquote(p["k"]), F.lit("+"), F.lit(" ")) == "title"), lambda p: html.unquote(F.replace(p["v"], F.lit("+"), F.lit(" ")))), lambda v: v != ""), 0)
    name = (
        F.when(href.startswith("/wiki/File:"), after("/wiki/"))
        .when(href.startswith("./File:"), after("./"))
        .when(href.startswith("/w/index.php"), F.when(title.startswith("File:"), html.unquote(title)))
        .when(href.contains(_FILE_PATH), F.concat(F.lit("File:"), html.unquote(F.split(F.regexp_extract(href, rf"(?s){_FILE_PATH}(.*)$", 1), r"\?")[0])))
    )
    return F.replace(name, F.lit("_"), F.lit(" "))


def _shown_file(attributes: Column, upload_host: str) -> Column:
    """Name of the file that an image shows: the attribute that names it, else from the path on the upload host; null if it is elsewhere."""
    src, named = attributes["src"], attributes["data-file-name"]
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(src, r"(?s)[?#].*$", ""), r"(?s)^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/]*)?", ""), ";[^/]*$", "")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    thumb = F.array_position(parts, "thumb").cast("int")
    last = F.when(thumb > 0, F.get(parts, thumb + 2)).otherwise(F.get(parts, F.size(parts) - 1))
    name = F.when(F.coalesce(named, F.lit("")) != "", named).otherwise(last)
    return F.when(src.contains(upload_host), F.concat(F.lit("File:"), F.replace(html.unquote(name), F.lit("_"), F.lit(" "))))


def media_links(pages: DataFrame, boxes: tuple[str, ...] = BOXES, content: str = CONTENT, upload_host: str = UPLOAD_HOST) -> DataFrame:
    """(page_id, html) -> page_id, pos, title: files linked from a page's content, then those shown there, in order, each once.

    Content is the first element of class ``content`` or, without one, the page, less containers of a class in ``boxes``.
    Links are anchors to file pages in any of their forms; images are those on the upload host. Titles are decoded, underscores
    become blanks, sound and film are left out. Only tags that may matter, links, images and those named like a container, go
    through one fold, which counts how deep it is inside a container by tags of the container's own name.
    """
    has = lambda t, classes: F.arrays_overlap(F.split(F.coalesce(t["attributes"]["class"], F.lit("")), r"\s+"), F.array(*[F.lit(c) for c in classes]))
    picture = lambda title: F.when(~images.is_sound_or_film(title), title)

    def event(t: Column) -> Column:
        starts = ~t["ends"]
        return F.struct(
            t["name"].alias("name"),
            t["ends"].alias("ends"),
            t["empty"].alias("empty"),
            (starts & has(t, boxes)).alias("box"),
            (starts & has(t, [content])).alias("content"),
            F.when(starts & (t["name"] == "a"), picture(_linked_file(t["attributes"]["href"]))).alias("link"),
            F.when(starts & (t["name"] == "img"), picture(_shown_file(t["attributes"], upload_host))).alias("image"),
        )

    events = pages.select("page_id", F.transform(html.tags(F.col("html")), event).alias("e"))
    names = F.array_distinct(F.transform(F.filter("e", lambda x: x["box"] | x["content"]), lambda x: x["name"]))
    matter = events.select("page_id", F.exists("e", lambda x: x["content"]).alias("whole"), F.filter("e", lambda x: x["link"].isNotNull() | x["image"].isNotNull() | F.array_contains(names, x["name"])).alias("e"))
    none = F.expr("cast(array() as array<string>)")
    state = lambda box, deep, inside, within, links, shown: F.struct(box.alias("box"), deep.alias("deep"), inside.alias("inside"), within.alias("within"), links.alias("links"), shown.alias("shown"))

    def step(a: Column, x: Column) -> Column:
        """box, deep: the container that is open and how often its name is; inside: the name of the content's element, within: how often that is open, -1 once it is closed."""
        change = F.when(x["ends"], -1).when(x["empty"], 0).otherwise(1)
        within = F.when((a["inside"] == x["name"]) & (a["within"] > 0), F.when(a["within"] + change <= 0, -1).otherwise(a["within"] + change)).when((a["inside"] == "") & x["content"], 1).otherwise(a["within"])
        inside = F.when((a["inside"] == "") & x["content"], x["name"]).otherwise(a["inside"])
        deep = F.when(a["deep"] > 0, F.when(a["box"] == x["name"], a["deep"] + change).otherwise(a["deep"])).when(x["box"] & ~x["empty"] & (a["within"] > 0), 1).otherwise(0)
        box = F.when((a["deep"] == 0) & x["box"], x["name"]).otherwise(a["box"])
        counts = (a["deep"] == 0) & (a["within"] > 0) & ~x["box"]
        more = lambda c, old: F.when(counts & x[c].isNotNull(), F.array_append(old, x[c])).otherwise(old)
        return state(box, deep, inside, within, more("link", a["links"]), more("image", a["shown"]))

    start = state(F.lit(""), F.lit(0), F.when(F.col("whole"), "").otherwise("#"), F.when(F.col("whole"), 0).otherwise(1), none, none)
    titles = F.aggregate("e", start, step, lambda a: F.array_distinct(F.concat(a["links"], a["shown"])))
    return matter.select("page_id", F.posexplode(titles).alias("pos", "title"))


def page_anchors(pages: DataFrame) -> DataFrame:
    """Distinct link targets of a page in order."""
    anchors = F.filter(html.tags(F.col("html")), lambda t: (t["name"] == "a") & ~t["ends"])
    links = F.array_distinct(F.filter(F.transform(anchors, lambda t: t["attributes"]["href"]), lambda x: x.isNotNull()))
    return pages.select("page_id", F.posexplode(links).alias("pos", "link"))


#: A page in pieces: comments, scripts and styles whole, tags, text.
_PIECES = r"""(?is)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>|<(?:[^>"']|"[^"]*"|'[^']*')*>|[^<]+|<"""
_BOXES = ("navbox", "sidebar", "metadata", "reflist", "hatnote", "sister-bar", "noprint", "mbox-image-div", "portal-bar", "succession-box", "sistersitebox", "side-box")


def strip_boilerplate(pages: DataFrame, tags: tuple[str, ...] = ("nav", "header", "footer", "aside"), classes: tuple[str, ...] = _BOXES) -> DataFrame:
    """(page_id, html) without comments, scripts, styles and boilerplate containers, nested ones included.

    A page is cut into pieces, and one fold over them counts how deep it is inside a container, by tags of the
    container's own name; so tags that are never closed don't matter. All inside the JVM.
    """
    name = lambda t: F.lower(F.regexp_extract(t, r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
    boxed = "|".join(rf"\Q{c}\E" for c in classes)
    marked = lambda t: name(t).isin(*tags) | t.rlike(rf"""(?is)^<[^>]*?\sclass\s*=\s*(?:"[^"]*?(?<![\w-])(?:{boxed})(?![\w-])|'[^']*?(?<![\w-])(?:{boxed})(?![\w-]))""")
    piece = lambda t: F.struct(
        t.alias("t"), name(t).alias("name"), t.startswith("</").alias("ends"), (t.startswith("<") & marked(t) & ~t.endswith("/>")).alias("opens"), t.rlike(r"(?is)^<(?:!--|script\b|style\b)").alias("gone")
    )
    cut = pages.select("page_id", F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_PIECES), F.lit(0)), piece).alias("pieces"))
    body = F.expr(
        """aggregate(pieces, named_struct('box', '', 'deep', 0, 'kept', cast(array() as array<string>)),
             (a, p) -> case when p.gone then a
                            when a.deep > 0 and p.name = a.box and p.name <> '' then named_struct('box', a.box, 'deep', a.deep + if(p.ends, -1, if(endswith(p.t, '/>'), 0, 1)), 'kept', a.kept)
                            when a.deep > 0 then a
                            when p.opens and not p.ends then named_struct('box', p.name, 'deep', 1, 'kept', a.kept)
                            else named_struct('box', '', 'deep', 0, 'kept', concat(a.kept, array(p.t))) end,
             a -> array_join(a.kept, ''))"""
    )
    return cut.select("page_id", body.alias("html"))
