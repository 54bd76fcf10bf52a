"""What texts and records tell of: artifacts they refer to, projects they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# An artifact's extension, references to one, artifacts of a text, and characters of a path and a name.
EXTENSION = r"\.canvas\.tsx"
LINK = r"\[([^\]]*)\]\(([^)\s]+)\)"
ARTIFACT_LINK = rf"(?i)\[[^\]]*\]\([^)\s]*{EXTENSION}[^)\s]*\)|\[[^\]]*{EXTENSION}\s*\]\([^)\s]+\)"
BARE = rf"(?i)(?<![\w./\\@~:-])[\w./\\@~:-]{{1,512}}{EXTENSION}(?!\w)"
ARTIFACTS, PATH_CHARS, NAME_CHARS = 12, 512, 120
#: Fixed value: forms of a project's name that are a path or an id in disguise.
HASHED = r"^[0-9a-f]{8}-|--|^-?Users-|^.{31,}$"
#: Fixed value: folders that an encoded path begins with.
ENCODED = r"(?i)^(?:[a-z]--?)?(?:users-[^-]+-(?:desktop-?|documents-?)?)?(?:dev-?)?(?:python-?)?(?:\d{4}-\d{2,4}-?)?(?:\d{2,4}-?)?"
HEAD_CHARS = 10_000


def _path(target: Column) -> Column:
    """A reference's path: decoded, without scheme, closing marks, query and fragment."""
    plain = F.trim(F.coalesce(F.try_url_decode(F.replace(target, F.lit("+"), F.lit("%2B"))), target))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"(?i)^file://", ""), r"[),.;:]+$", ""), r"(?s)[?#].*$", "")


def _is_artifact(target: Column) -> Column:
    path = _path(target)
    return path.rlike(rf"(?i){EXTENSION}$") & (F.length(path) <= PATH_CHARS) & ~path.rlike(r"[\r\n]")


def _is_safe(path: Column) -> Column:
    """No way up, no control characters, no scheme but those of files and the web; a single letter is a drive."""
    return ~path.rlike(r"[\x00-\x1f\x7f]") & ~path.rlike(r"(?:^|[\\/])\.\.(?:[\\/]|$)") & (~path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]+:") | path.rlike(r"(?i)^(?:https?|file):"))


def detect_artifacts(content: Column, most: int | None = ARTIFACTS) -> Column:
    """path and name of the artifacts that a text refers to: those of links first, then bare paths.

    Of paths that differ in case only the first counts; unsafe ones are left out; at most ``most`` (None: all).
    """
    labels, targets = (F.regexp_extract_all(content, F.lit(LINK), F.lit(i)) for i in (1, 2))
    linked = F.zip_with(labels, targets, lambda label, target: F.when(_is_artifact(target), target).when(_is_artifact(label), label))
    bare = F.regexp_extract_all(F.regexp_replace(content, ARTIFACT_LINK, " "), F.lit(BARE), F.lit(0))
    paths = F.filter(F.transform(F.concat(F.filter(linked, lambda t: t.isNotNull()), bare), _path), lambda p: (p != "") & _is_safe(p))
    folded = F.transform(paths, F.lower)
    first = F.filter(paths, lambda p, i: F.array_position(folded, F.lower(p)) == i + 1)
    kept = first if most is None else F.slice(first, 1, most)

    def named(path: Column) -> Column:
        base = F.trim(F.regexp_replace(F.regexp_extract(path, r"([^\\/]*)$", 1), rf"(?i){EXTENSION}$", ""))
        return F.struct(path.alias("path"), F.coalesce(F.nullif(F.substring(base, 1, NAME_CHARS), F.lit("")), F.lit("canvas")).alias("name"))

    return F.when(content.isNotNull(), F.transform(kept, named)).otherwise(F.array().cast("array<struct<path: string, name: string>>"))


def readable_name(name: Column) -> Column:
    """A name whose path separators became dashes, without the drive, home, working and dated folders before it."""
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "^-+|-+$", ""), ENCODED, ""), "^-+|-+$", "")
    return F.coalesce(F.nullif(rest, F.lit("")), name)


def infer_project(docs: DataFrame) -> DataFrame:
    """document_id, project: the project that each document belongs to, as well as it can be told.

    ``docs(document_id, tool_id, machine_id, category, content, project_hash, session_id)``. A name that reads as one
    stands. For a conversation whose name is missing, or a path or an id in disguise, the last folder of the first working
    directory in its first 10,000 characters counts, else the disguised name made readable. A document
    without any takes the (first by name) project of its tool's other documents of that session on that machine.
    """
    given = F.nullif(F.trim("project_hash"), F.lit(""))
    disguised = F.coalesce(given.rlike(HASHED), F.lit(False))
    said = F.regexp_extract(F.substring("content", 1, HEAD_CHARS), r'"cwd"\s*:\s*"([^"]+)"', 1)
    folder = F.regexp_extract(F.regexp_replace(F.replace(F.regexp_replace(said, r"^\\\\\?\\+", ""), F.lit("\\"), F.lit("/")), "/+$", ""), "([^/]*)$", 1)
    told = F.when((F.col("category") == "conversation") & (given.isNull() | disguised), F.nullif(folder, F.lit("")))
    name = F.coalesce(told, F.when(disguised, readable_name(given)), given)
    own = docs.withColumn("_own", F.nullif(F.trim(F.regexp_replace(name, r"(?s)[\x00-\x1f].*$", "")), F.lit("")))
    key = ["tool_id", "machine_id", "session_id"]
    others = own.where("_own is not null and session_id is not null").groupBy(*key).agg(F.min("_own").alias("_theirs"))
    return own.join(others, key, "left").select("document_id", F.coalesce("_own", "_theirs").alias("project"))
