"""Names, categories, hashes, titles, identifiers, labels and cursors (T10-T35), native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import regexes as R
from .subjects import collapsed, every, let, shaved, trimmed


def clean_name(subject: Column) -> Column:
    """Display name of a subject."""
    first = F.regexp_extract(subject, R.QUOTED, 1)
    s = F.when(first != "", first).otherwise(subject)
    s = F.regexp_replace(s, R.port(R.LEADING_COUNTER), "")
    for pattern in (R.ANY_COUNTER, R.YENC, R.BYTES_NOTE):
        s = F.regexp_replace(s, R.port(pattern), " ")
    s = F.regexp_replace(s, R.port(R.EXTENSION), "")
    return trimmed(shaved(collapsed(s), " -–_."))


def collection_base_name(key: Column, strip_all_prefixes: bool = False) -> Column:
    """Name of a collection key. The prefixes b: and yenc: stay unless asked for."""
    return F.regexp_replace(F.regexp_replace(key, "^(?:t|b|yenc):" if strip_all_prefixes else "^t:", ""), r"/[^/]*\z", "")


def search_name(name: Column) -> Column:
    """T12"""
    return trimmed(collapsed(F.translate(F.lower(name), "._-", "   ")))


def is_word_like(token: Column) -> Column:
    """At least three letters in one case or capitalised, with a vowel."""
    return token.rlike(r"\A([a-z]{3,}|[A-Z]{3,}|[A-Z][a-z]{2,})\z") & token.rlike("[aeiouyAEIOUY]")


def is_obfuscated(name: Column) -> Column:
    """T13"""
    s = trimmed(name)
    tokens = F.filter(F.split(s, "[ ._-]+"), lambda t: t != "")
    random = F.exists(tokens, lambda t: F.octet_length(t) >= 8) & ~F.exists(tokens, is_word_like)
    return (s == "") | s.rlike(r"\A[0-9a-fA-F]{16,}\z") | (F.size(tokens) == 0) | random


def resolution_tier(name: Column) -> Column:
    """0 SD, 1 HD (also if nothing tells), 2 UHD."""
    return F.when(name.rlike(R.port(R.UHD)), 2).when(name.rlike(R.port(R.HD)), 1).when(name.rlike(R.port(R.SD)), 0).otherwise(1)


def refine_video_category(category: Column, name: Column) -> Column:
    """T17"""
    tier = resolution_tier(name)
    movie = F.when(name.rlike(R.port(R.FOREIGN)), 2010).when(tier == 2, 2045).when(tier == 0, 2030).otherwise(2040)
    return F.when(category == 2000, movie).when(category == 5000, F.when(tier == 2, 5045).when(tier == 0, 5030).otherwise(5040)).otherwise(category)


def categorize(name: Column) -> Column:
    """First rule that matches the search name."""

    def rule(s: Column) -> Column:
        out = None
        for pattern, category in R.CATEGORIES:
            hit = s.rlike(R.port(pattern))
            out = F.when(hit, category) if out is None else out.when(hit, category)
        return out.otherwise(R.OTHER)

    return let(search_name(name), lambda s: let(rule(s), lambda c: refine_video_category(c, s)))


def size_bucket(size: Column) -> Column:
    """Two significant digits."""
    step = F.greatest(F.pow(F.lit(10.0), F.floor(F.log10(size.cast("double"))) - 1), F.lit(1.0))
    return F.when(size <= 0, 0).otherwise(F.round(size / step).cast("long") * step.cast("long")).cast("long")


def release_hash(name: Column, size: Column, group_id: Column) -> Column:
    """T19"""
    nul = F.char(F.lit(0))
    return F.sha1(F.concat(search_name(name), nul, size_bucket(size).cast("string"), nul, group_id.cast("string")))


def parse_title(name: Column) -> Column:
    """Struct of title, year, season and episode; 0 where not known."""
    work = F.translate(name, "._", "  ")
    ep, cross, season, year = (R.port(p) for p in (R.EPISODE, R.CROSS, R.SEASON, R.YEAR))
    num = lambda p, g: F.regexp_extract(work, p, g).cast("int")
    has = [work.rlike(p) for p in (ep, cross, season)]
    s = F.when(has[0], num(ep, 1)).when(has[1], num(cross, 1)).when(has[2], num(season, 1)).otherwise(0)
    e = F.when(has[0], num(ep, 2)).when(has[1], num(cross, 2)).otherwise(0)
    at = lambda p: F.regexp_instr(work, F.lit(p))
    mark = F.when(has[0], at(ep)).when(has[1], at(cross)).when(has[2], at(season)).otherwise(0)
    far = F.length(work) + 1
    end = F.least(F.when(mark > 0, mark).otherwise(far), F.when(at(year) > 0, at(year)).otherwise(far))
    title = trimmed(shaved(collapsed(F.lower(F.substring(work, F.lit(1), end - 1))), " -–_."))
    return F.struct(title.alias("title"), F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(work, year, 1), F.lit("")), F.lit("9999")).cast("int"), F.lit(0)).alias("year"), s.alias("season"), e.alias("episode"))


def normalize_identifier(source: Column, ident: Column) -> Column:
    """Struct of source and identifier, null if it isn't one."""
    src, val = F.lower(trimmed(source)), trimmed(ident)
    digits = F.regexp_replace(F.lower(val), "^tt", "")
    padded = F.when(F.length(digits) < 7, F.lpad(digits, 7, "0")).otherwise(digits)
    return F.when((src == "imdb") & digits.rlike(r"\A[0-9]+\z"), F.struct(src.alias("source"), F.concat(F.lit("tt"), padded).alias("identifier"))).when(src.isin("tvdb", "tmdb") & val.rlike(r"\A[0-9]+\z"), F.struct(src.alias("source"), val.alias("identifier")))


def _with_source(source: str):
    return lambda x: normalize_identifier(F.lit(source), x)


def extract_identifiers(nfo: Column) -> Column:
    """At most 8 distinct identifiers of a description, in order of source and place."""
    groups = []
    for source, pattern, group in (("imdb", R.IMDB, 0), ("tvdb", R.TVDB, 1), ("tmdb", R.TMDB, 1)):
        found = F.slice(every(nfo, pattern, group), 1, 9)
        groups.append(F.transform(found, _with_source(source)))
    return F.slice(F.array_distinct(F.filter(F.concat(*groups), lambda x: x.isNotNull())), 1, 8)


def subject_filename(subject: Column) -> Column:
    """Between the first two quotes, or the trimmed subject."""
    return F.when(subject.rlike('"[^"]*"'), F.regexp_extract(subject, '"([^"]*)"', 1)).otherwise(trimmed(subject))


def looks_like(name: Column, extension: str) -> Column:
    """.nfo or .par2 at the end."""
    return F.endswith(F.lower(trimmed(name)), F.lit(extension))


def strip_known_ext(name: Column) -> Column:
    """T25, first half"""
    return F.regexp_replace(F.regexp_replace(name, R.port(R.KNOWN_EXTENSION), ""), R.port(R.VOLUME), "")


def best_release_name(names: Column) -> Column:
    """The longest base in bytes, the first of equals."""
    bases = F.transform(names, strip_known_ext)
    best = F.aggregate(bases, F.lit(""), lambda a, b: F.when(F.octet_length(b) > F.octet_length(a), b).otherwise(a))
    return trimmed(best)


def best_name_of(name: Column) -> Column:
    """T25 over all rows of a group, as a minimum that is reduced before rows move: '' where no name has a base."""
    base = strip_known_ext(name)
    return trimmed(F.min(F.struct((-F.octet_length(base)).alias("n"), name.alias("name"), base.alias("base")))["base"])


def sanitize_nfo(raw: Column) -> Column:
    """Bytes as text, each invalid byte U+FFFD."""
    return trimmed(F.make_valid_utf8(raw.cast("string")))


def sanitize_utf8(text: Column) -> Column:
    """No NUL, each run of invalid bytes one U+FFFD; genuine U+FFFD stay. With NUL gone it holds their place."""
    nul, mark = F.char(F.lit(0)), F.lit("�")
    held = F.replace(F.replace(text, nul, F.lit("")), mark, nul)
    return F.replace(F.regexp_replace(F.make_valid_utf8(held), "�+", "�"), nul, mark)


def strip_html(text: Column) -> Column:
    """T27"""
    return trimmed(F.regexp_replace(text, "<[^>]*>", ""))


def year_from_date(text: Column) -> Column:
    """The first four digits, 0 if there are none."""
    return F.coalesce(F.regexp_extract(text, r"^(\d{4})", 1).try_cast("int"), F.lit(0))


def route_pattern(path: Column) -> Column:
    """A bounded label for a request path."""
    rest = F.regexp_replace(path, "^/api/v1/", "")
    seg = F.split(rest, "/")
    n, s = F.size(seg), lambda i: F.get(seg, F.lit(i))
    groups = F.when(n == 2, "groups").when(n == 3, F.when(s(2) == "bulk", "groups/bulk").otherwise("groups/:id")).otherwise(F.concat(F.lit("groups/:id/"), s(3)))
    admin = (
        F.when(n == 1, "")
        .when(s(1) == "groups", groups)
        .when(s(1) == "servers", F.when(n > 2, "servers/:id").otherwise("servers"))
        .when(s(1) == "users", F.when(n > 2, "users/:id").otherwise("users"))
        .when(s(1) == "postprocess", F.array_join(F.slice(seg, 2, 100), "/"))
        .otherwise(s(1))
    )
    releases = F.when(n == 1, "releases").when(n == 2, "releases/:guid").when(s(2) == "nzb", "releases/:guid/nzb").otherwise("releases/:guid/*")
    rest = F.when(s(0) == "releases", releases).when(s(0) == "apikeys", F.when(n > 1, "apikeys/:id").otherwise("apikeys")).when(s(0) == "admin", F.concat(F.lit("admin/"), admin)).otherwise(s(0))
    return F.when(path == "/metrics", path).when(path.isin("/api", "/api/"), "/api").when(path.startswith("/api/v1/"), F.concat(F.lit("/api/v1/"), rest)).when(path == "/", "/").otherwise("spa")


# Labels of exact paths.
LABELS = {
    "/api/v1/login": "login",
    "/api/v1/me": "whoami",
    "/api/v1/health": "health probe",
    "/api/v1/ready": "readiness probe",
    "/metrics": "metrics scrape",
    "/api/v1/releases": "search",
    "/api/v1/categories": "categories",
    "/api/v1/admin/scan": "scan",
    "/api/v1/admin/backfill": "backfill",
    "/api/v1/admin/postprocess": "postprocess",
    "/api/v1/admin/postprocess/retry-failed": "retry failed postprocess",
    "/api/v1/admin/stats": "stats",
    "/api/v1/admin/status": "status",
    "/api/v1/admin/health": "health report",
    "/api/v1/admin/logs": "logs",
    "/api/v1/admin/schedule": "schedule",
    "/api/v1/admin/discover": "discover groups",
    "/api/v1/admin/groups": "groups",
    "/api/v1/admin/groups/bulk": "bulk add groups",
    "/api/v1/admin/servers": "servers",
    "/api/v1/admin/users": "users",
    "/api/v1/setup": "setup",
    "/api/v1/setup/status": "setup",
    "/api/v1/apikeys": "api keys",
}


def request_label(path: Column) -> Column:
    """What a request does."""
    exact = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[path]
    release, under = path.startswith("/api/v1/releases/"), lambda p: path.startswith(f"/api/v1/{p}/")
    return F.coalesce(
        exact,
        F.when(release & path.endswith("/nzb"), "nzb download")
        .when(release, "release detail")
        .when(under("apikeys"), "api key")
        .when(under("admin/groups"), "group update")
        .when(under("admin/servers"), "server update")
        .when(under("admin/users"), "user update")
        .when((path == "/api") | (path.startswith("/api/") & ~path.startswith("/api/v1/")), "newznab")
        .otherwise("http request"),
    )


def is_probe(path: Column) -> Column:
    return path.isin("/api/v1/health", "/api/v1/ready")


def valid_group_name(name: Column) -> Column:
    """T30"""
    return name.rlike(r"\A[a-z0-9._+-]+\z") & name.contains(".") & (F.octet_length(name) <= 512)


def episode_query(q: Column, season: Column, episode: Column) -> Column:
    """The query with sNN and eNN behind it, where they are numbers."""
    s, e = season.try_cast("int"), episode.try_cast("int")
    pad = lambda c: F.when(F.length(c.cast("string")) < 2, F.lpad(c.cast("string"), 2, "0")).otherwise(c.cast("string"))
    token = F.when(s.isNotNull(), F.concat(F.lit("s"), pad(s), F.when(e.isNotNull(), F.concat(F.lit("e"), pad(e))).otherwise("")))
    return trimmed(F.concat_ws(" ", trimmed(q), token))


def parse_category_list(text: Column) -> Column:
    """The numbers of a comma list."""
    return F.filter(F.transform(F.split(text, ","), lambda p: trimmed(p).try_cast("int")), lambda n: n.isNotNull())


def encode_cursor(ts: Column, ident: Column) -> Column:
    """base64url without padding of <nanoseconds>:<id>."""
    raw = F.concat_ws(":", (F.unix_micros(ts.cast("timestamp")) * 1000).cast("string"), ident.cast("string"))
    return F.regexp_replace(F.translate(F.base64(raw.cast("binary")), "+/", "-_"), r"[=\r\n]+", "")


def decode_cursor(token: Column) -> Column:
    """Struct of ts and id."""
    plain = F.translate(token, "-_", "+/")
    raw = F.unbase64(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "=")).cast("string")
    return F.struct(F.timestamp_micros(F.regexp_extract(raw, r"^(-?\d+)\d{3}:", 1).cast("long")).alias("ts"), F.split_part(raw, F.lit(":"), F.lit(2)).cast("long").alias("id"))


def classify_error(code: Column, fatal: Column) -> Column:
    """Struct of kind and permanent, from a status code (null without one) and whether the
    connection broke; no error is both null."""
    kind = F.when(code.isNull() & fatal.isNull(), "none").when(code.isin(480, 481, 482, 502), "auth").when(code == 430, "retention").when(code.isNotNull(), "protocol").when(fatal, "connection").otherwise("protocol")
    return F.struct(kind.alias("kind"), kind.isin("auth", "retention").alias("permanent"))


def level_rank(level: Column) -> Column:
    """T35"""
    return F.when(level.startswith("DEBUG"), -4).when(level.startswith("WARN"), 4).when(level.startswith("ERROR"), 8).otherwise(0)


def safe_filename(name: Column) -> Column:
    """S11"""
    out = F.translate(name, '/\\:*?"<>|\n\r\t', "____________")
    return F.when(out == "", "release").otherwise(out)
