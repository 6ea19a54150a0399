"""Image titles and metadata as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelspan.functions import html as markup

# Extensions of pictures and of sound and film.
IMAGE_EXTENSIONS = (
    "jpg", "jpeg", "png", "gif", "svg", "webp", "tif", "tiff", "bmp", "ico", "xcf", "djvu", "pdf",
)
OTHER_EXTENSIONS = (
    "ogg", "oga", "ogv", "ogx", "opus", "spx", "webm", "mp4", "m4v", "mov", "avi", "mpg", "mpeg", "mp3", "wav", "flac", "midi", "mid", "aiff", "aac",
    "mka", "mkv",
)
# Parts of file names that are never content, in the order in which they are tried.
BLACKLIST = (
    "wikisource-logo", "commons-logo", "disambig_gray", "wiktionary-logo", "wikinews-logo", "wikibooks-logo", "wikiquote-logo", "wikiversity-logo",
    "wikivoyage-logo", "wikispecies-logo", "mediawiki-logo", "wikidata-logo", "wikipedia-logo", "wikimedia-logo", "oojs_ui", "oojs-ui",
    "question_book", "question-book", "globe_of_letters", "global_thinking", "search_icon", "edit-clear", "text-x-generic", "folder-hexagon",
    "increase2", "decrease2", "steady2", "ambox", "unbalanced_scales", "merge-arrow", "padlock", "lock-", "semi-protection", "fully-protected", "pp-",
    "nuvola", "crystal_clear", "crystal-clear", "gnome-", "gnome_", "_pog.", "red_pog", "blue_pog", "green_pog", "yellow_pog", "orange_pog",
    "white_pog", "black_pog", "grey_pog", "purple_pog", "location_dot", "map_marker", "speaker_icon", "symbol_portal", "symbol_category",
    "symbol_list", "symbol_book", "arrow_blue", "portal-puzzle",
)
# Names of icons of a page's frame.
ICONS = (
    r"(?i)padlock|lock|semi[- ]?protection|fully[- ]?protected|pp-|question[_-]?book|disambig|edit[- ]?clear|magnify|search|wiki\w*[- ]?logo|commons[- ]?logo"
    r"|mediawiki[- ]?logo|oojs[_-]ui|nuvola|crystal[_ -]clear|gnome[-_]|external[- ]?link|ambox"
)
SYMBOLS = r"flag|coat of arms|coat_of_arms|coat-of-arms|signature|autograph"
YEAR = r"(?<!\d)(1\d{3}|20\d{2}|21\d{2})(?!\d)"
# Labels of license categories.
LICENSE_LABELS = {"public_domain": "Public Domain / CC0", "restricted_nonfree": "Restricted / Non-free", "cc_by_sa": "Creative Commons BY-SA", "cc_by": "Creative Commons BY"}
#: Best licenses first.
LICENSE_ORDER = ("public_domain", "cc_by", "cc_by_sa", "other_cc", "unknown", "restricted_nonfree")


def basename(title: Column) -> Column:
    """What follows the first colon."""
    return F.when(title.contains(":"), F.regexp_replace(title, r"(?s)^[^:]*:", "")).otherwise(title)


def extension(title: Column) -> Column:
    base = F.lower(basename(title))
    return F.when(base.contains("."), F.substring_index(base, ".", -1)).otherwise("")


def is_picture(title: Column) -> Column:
    return extension(title).isin(*IMAGE_EXTENSIONS)


def is_sound_or_film(title: Column) -> Column:
    return extension(title).isin(*OTHER_EXTENSIONS)


def is_image_mime(mime: Column) -> Column:
    return F.coalesce(mime.startswith("image/"), F.lit(False))


def blacklisted(title: Column) -> Column:
    """The first blacklisted part of a title, null if there is none."""
    base = F.replace(F.lower(basename(title)), F.lit(" "), F.lit("_"))
    return F.get(F.filter(F.array(*[F.lit(p) for p in BLACKLIST]), lambda p: F.contains(base, p)), 0)


def is_icon(title: Column) -> Column:
    return F.replace(basename(title), F.lit(" "), F.lit("_")).rlike(ICONS)


def strip_html(text: Column) -> Column:
    """Text of a piece of markup: its text nodes joined by blanks, comments and scripts left out, all character references decoded."""
    return markup.text_of(text)


def metadata_map(json: Column) -> Column:
    """Metadata fields as one map of strings: a field is an object with a value, or a string."""
    fields = F.from_json(json, "map<string,string>")
    return F.transform_values(fields, lambda k, v: F.when(F.trim(v).startswith("{"), F.coalesce(F.get_json_object(v, "$.value"), F.lit(""))).otherwise(v))


def metadata_value(fields: Column, key: str, default: str = "") -> Column:
    """A field's value, the default where it is missing or empty."""
    value = F.element_at(fields, key)
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(default)).otherwise(value)


def symbolic_svg(title: Column, mime: Column, object_name: Column, description: Column) -> Column:
    """Flags, arms and signatures drawn as SVG."""
    named = F.lower(basename(title)).rlike(SYMBOLS) | F.lower(strip_html(object_name)).rlike(SYMBOLS) | F.lower(strip_html(description)).rlike(SYMBOLS)
    return F.coalesce((mime == "image/svg+xml") & named, F.lit(False))


def years(text: Column) -> Column:
    """Years from 1000 to 2100 that stand by themselves in a text."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))
    return F.filter(found, lambda y: y.between(1000, 2100))


def image_year(*fields: Column) -> Column:
    """The smallest year in any of the fields, null if there is none."""
    return F.array_min(F.flatten(F.array(*[years(strip_html(f)) for f in fields])))


def license_category(code: Column, short: Column, terms: Column, restrictions: Column, attribution: Column) -> Column:
    """License category of an image from its metadata; the order of the rules matters."""
    code, short, terms, restrictions, attribution = (F.lower(F.coalesce(c, F.lit(""))) for c in (code, short, terms, restrictions, attribution))
    nonfree = "nonfree|non-free|fair use"
    return (
        F.when(short.contains("public domain") | code.isin("pd", "cc-zero") | short.contains("cc0"), "public_domain")
        .when(terms.rlike(nonfree) | restrictions.rlike(nonfree) | code.isin("unknown", "arr"), "restricted_nonfree")
        .when(code.startswith("cc-by-sa") | short.contains("cc by-sa"), "cc_by_sa")
        .when(code.startswith("cc-by") | (short.contains("cc by") & ~short.contains("sa")), "cc_by")
        .when(code.startswith("cc-") | short.startswith("cc "), "other_cc")
        .when(attribution == "true", "other_cc")
        .otherwise("unknown")
    )


def license_label(category: Column, code: Column, short: Column) -> Column:
    code, short = F.lower(F.coalesce(code, F.lit(""))), F.lower(F.coalesce(short, F.lit("")))
    known = F.create_map(*[F.lit(x) for pair in LICENSE_LABELS.items() for x in pair])
    by_name = code.startswith("cc-") | short.startswith("cc ")
    name = F.when(short != "", short).otherwise(code)
    return F.coalesce(
        known[category],
        F.when(category == "other_cc", F.when(by_name, "Creative Commons (Other)").otherwise("Creative Commons (Attribution)")),
        F.when(name != "", F.concat(F.lit("Unknown ("), name, F.lit(")"))).otherwise("Unknown"),
    )


def license_rank(category: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in zip(LICENSE_ORDER, range(len(LICENSE_ORDER)), strict=True) for x in pair])
    return F.coalesce(known[category], F.lit(99))


def attribution(name: Column, author: Column, license_short: Column, license_url: Column) -> Column:
    """The suggested line of attribution; empty without a license."""
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    by = F.when(filled(author), F.concat(F.lit(" by "), author)).otherwise("")
    url = F.when(filled(license_url), F.concat(F.lit(" ("), license_url, F.lit(")"))).otherwise("")
    line = F.concat(F.lit("“"), name, F.lit("”"), by, F.lit(" is licensed under "), license_short, url, F.lit(" via Wikimedia Commons."))
    return F.when(filled(license_short), line).otherwise("")


def safe_folder(name: Column) -> Column:
    """A name that any file system takes."""
    cleaned = F.regexp_replace(F.regexp_replace(F.trim(name), r'[\\/:*?"<>|]+', "_"), r"\s+", " ")
    cut = F.btrim(cleaned, F.lit(" ."))
    return F.when(cut != "", cut).otherwise("untitled")


def url_name(url: Column) -> Column:
    """Decoded last part of a URL's path; a plus sign stays one, and so does what is no valid escape."""
    return markup.unquote(F.substring_index(F.regexp_replace(url, r"[?#].*$", ""), "/", -1))


def file_url(path: Column) -> Column:
    """``file://localhost`` URL of a path, each part percent-encoded."""
    parts = F.transform(F.split(path, "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")))
    return F.concat(F.lit("file://localhost"), F.array_join(parts, "/"))
