"""Oracle SQL in DuckDB's dialect: common table expressions and expressions of the text functions."""

from __future__ import annotations

from ..functions import regexes as R
from ..sources import views as V

WS = r"'[\t\n\f\r ]+'"


def rx(text: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({text}, '{pattern}', '{to}', 'g')"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern}')"


def squeeze(text: str) -> str:
    return f"regexp_replace({text}, {WS}, ' ', 'g')"


def clean_name(x: str) -> str:
    s = f"CASE WHEN regexp_extract({x}, '{R.QUOTED}', 1) <> '' THEN regexp_extract({x}, '{R.QUOTED}', 1) ELSE {x} END"
    s = rx(s, R.LEADING_COUNTER)
    for p in (R.ANY_COUNTER, R.YENC, R.BYTES_NOTE):
        s = rx(s, p, " ")
    return f"trim(trim({squeeze(rx(s, R.EXTENSION))}, ' -–_.'))"


def search_name(x: str) -> str:
    return f"trim({squeeze(f'''translate(lower({x}), '._-', '   ')''')})"


def refine(c: str, s: str) -> str:
    tier = f"CASE WHEN {has(s, R.UHD)} THEN 2 WHEN {has(s, R.HD)} THEN 1 WHEN {has(s, R.SD)} THEN 0 ELSE 1 END"
    return f"CASE WHEN {c} = 2000 THEN CASE WHEN {has(s, R.FOREIGN)} THEN 2010 WHEN ({tier}) = 2 THEN 2045 WHEN ({tier}) = 0 THEN 2030 ELSE 2040 END WHEN {c} = 5000 THEN CASE ({tier}) WHEN 2 THEN 5045 WHEN 0 THEN 5030 ELSE 5040 END ELSE {c} END"


def rule(s: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(s, p)} THEN {c}" for p, c in R.CATEGORIES) + f" ELSE {R.OTHER} END"


def bucket(x: str) -> str:
    step = f"greatest(power(10.0::DOUBLE, floor(log10({x}::DOUBLE)) - 1), 1.0)"
    return f"CASE WHEN {x} <= 0 THEN 0 ELSE CAST(round({x} / {step}) AS BIGINT) * CAST({step} AS BIGINT) END"


def obfuscated(x: str) -> str:
    toks = f"list_filter(regexp_split_to_array(trim({x}), '[ ._-]+'), lambda t: t <> '')"
    word = "regexp_matches(t, '^([a-z]{3,}|[A-Z]{3,}|[A-Z][a-z]{2,})$') AND regexp_matches(t, '[aeiouyAEIOUY]')"
    return f"(trim({x}) = '' OR regexp_matches(trim({x}), '^[0-9a-fA-F]{{16,}}$') OR len({toks}) = 0 OR (len(list_filter({toks}, lambda t: {word})) = 0 AND len(list_filter({toks}, lambda t: strlen(t) >= 8)) > 0))"


def collection_base(x: str) -> str:
    return f"trim({rx(f'trim({x})', R.ARCHIVE)})"


C = r"[\(\[]\d{1,6}\s*/\s*\d{1,6}[\)\]]"

#: Each needs those before it that it names.
CTES = {
    "headers": V.HEADERS.format(div="//", lineitem="lineitem", orders="orders"),
    "h1": f"""SELECT *, regexp_extract_all(subject, '"([^"]+)"', 1) AS q, regexp_extract_all(subject, '{C}') AS cs FROM headers""",
    "h2": f"""SELECT *, CASE WHEN len(q) > 0 THEN trim(q[-1]) ELSE '' END AS file_name, CASE WHEN len(q) > 0 THEN subject[1 : strpos(subject, '"' || q[-1] || '"') - 1] ELSE subject END AS pre,
        CASE WHEN len(cs) > 0 THEN CAST(regexp_extract(cs[-1], '{R.COUNTER}', 1) AS INT) WHEN {has('subject', R.OF_COUNTER)} THEN CAST(regexp_extract(subject, '{R.OF_COUNTER}', 1) AS INT) WHEN {has('subject', R.PART_NAME)} THEN CAST(regexp_extract(subject, '{R.PART_NAME}', 1) AS INT) ELSE 0 END AS part_number,
        CASE WHEN len(cs) > 0 THEN CAST(regexp_extract(cs[-1], '{R.COUNTER}', 2) AS INT) WHEN {has('subject', R.OF_COUNTER)} THEN CAST(regexp_extract(subject, '{R.OF_COUNTER}', 2) AS INT) ELSE 0 END AS total_parts FROM h1""",
    "h3": f"""SELECT *, list_filter(CASE WHEN len(regexp_extract_all(pre, '{C}')) = len(cs) THEN regexp_extract_all(pre, '{C}')[1 : len(cs) - 1] ELSE regexp_extract_all(pre, '{C}') END, lambda t: NOT regexp_matches(t, '{R.YEARS}')) AS cand FROM h2""",
    "h4": """SELECT *, CASE WHEN len(cand) > 0 AND (len(q) = 0 OR strlen(pre) - strlen(pre[1 : strpos(pre, cand[-1]) - 1]) - strlen(cand[-1]) <= 64) THEN cand[-1] END AS tok FROM h3""",
    "h5": f"""SELECT *, CAST(regexp_extract(tok, '{R.COUNTER}', 1) AS INT) AS fn, CAST(regexp_extract(tok, '{R.COUNTER}', 2) AS INT) AS ft, trim({squeeze("trim(pre[1 : strpos(pre, tok) - 1])")}, ' -–_.') AS ttl, {has('file_name', R.ARCHIVE)} AND file_name <> '' AS arch, {collection_base('file_name')} AS base FROM (SELECT * FROM h4)""",
    "h6": """SELECT *, CASE WHEN tok IS NULL THEN CASE WHEN arch AND base <> '' THEN 'b:' || base ELSE '' END WHEN ft < 2 THEN '' WHEN strlen(ttl) >= 8 THEN 't:' || ttl || '/' || ft WHEN arch AND base <> '' THEN base || '/' || ft WHEN file_name <> '' AND NOT (total_parts > 0 AND fn = part_number AND ft = total_parts) THEN file_name || '/' || ft ELSE '' END AS collection_key,
        CASE WHEN len(cs) > 0 THEN concat(subject[1 : len(subject) - strpos(reverse(subject), reverse(cs[-1])) - len(cs[-1]) + 1], ' ', subject[len(subject) - strpos(reverse(subject), reverse(cs[-1])) + 2 :]) ELSE subject END AS noseg FROM h5""",
    "parsed": f"""SELECT group_id, article_number, message_id, subject, poster, posted_at, bytes, part_number, total_parts, file_name, trim(trim({squeeze(rx(rx(rx('noseg', R.OF_COUNTER, ' '), R.YENC, ' '), R.BYTES_NOTE, ' '))}, ' -_.')) AS norm_subject, collection_key,
        CASE WHEN tok IS NOT NULL AND collection_key <> '' THEN fn ELSE 0 END AS file_number, CASE WHEN tok IS NOT NULL AND collection_key <> '' THEN ft ELSE 0 END AS collection_files, group_id * 1000000000 + article_number AS part_id FROM h6""",
    "parts": "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY group_id, article_number ORDER BY message_id, poster, posted_at, bytes, subject) AS rn FROM parsed) WHERE rn = 1",
    "binaries": """SELECT md5(concat_ws('|', 's', CAST(group_id AS VARCHAR), norm_subject, poster)) AS binary_id, group_id, norm_subject, '' AS collection_key, poster, count(*) AS collected_parts, max(total_parts) AS total_parts, CAST(sum(bytes) AS BIGINT) AS total_bytes, min(posted_at) AS posted_at, max(posted_at) AS updated_at, max(total_parts) = 0 OR count(*) >= max(total_parts) AS complete
        FROM parts WHERE collection_key = '' AND norm_subject <> '' AND total_parts > 0 GROUP BY group_id, norm_subject, poster
        UNION ALL SELECT md5(concat_ws('|', 'c', CAST(group_id AS VARCHAR), collection_key, poster)), group_id, '', collection_key, poster, count(DISTINCT file_number), max(collection_files), CAST(sum(bytes) AS BIGINT), min(posted_at), max(posted_at), max(collection_files) > 0 AND count(DISTINCT file_number) >= max(collection_files)
        FROM parts WHERE collection_key <> '' GROUP BY group_id, collection_key, poster""",
    "n1": "SELECT *, CASE WHEN collection_key <> '' THEN regexp_replace(regexp_replace(collection_key, '^t:', ''), '/[^/]*$', '') ELSE norm_subject END AS original_subject FROM binaries WHERE complete AND total_parts > 0",
    "n2": f"SELECT * EXCLUDE (cn), CASE WHEN cn = '' THEN original_subject ELSE cn END AS name FROM (SELECT *, {clean_name('original_subject')} AS cn FROM n1)",
    "n3": f"SELECT *, {search_name('name')} AS search_name, {obfuscated('name')} AS obfuscated, {bucket('total_bytes')} AS bucket FROM n2",
    "n4": f"SELECT *, {rule('search_name')} AS rule_id, sha1(concat(search_name, chr(0), CAST(bucket AS VARCHAR), chr(0), CAST(group_id AS VARCHAR))) AS release_hash FROM n3",
    "releases": f"SELECT substr(sha256(concat_ws('|', release_hash, binary_id)), 1, 32) AS guid, release_hash, name, search_name, original_subject, {refine('rule_id', 'search_name')} AS category_id, group_id, poster, total_parts, total_bytes AS size, posted_at, obfuscated, binary_id FROM (SELECT *, row_number() OVER (PARTITION BY release_hash ORDER BY updated_at, binary_id) AS k FROM n4) WHERE k = 1",
    "linked": "SELECT *, CASE WHEN collection_key <> '' THEN md5(concat_ws('|', 'c', CAST(group_id AS VARCHAR), collection_key, poster)) WHEN norm_subject <> '' AND total_parts > 0 THEN md5(concat_ws('|', 's', CAST(group_id AS VARCHAR), norm_subject, poster)) END AS binary_id FROM parts",
    "segments": "SELECT guid, row_number() OVER (PARTITION BY guid ORDER BY part_number, article_number) AS number, part_number, article_number, message_id, bytes, subject FROM linked JOIN (SELECT guid, binary_id FROM releases) USING (binary_id) WHERE message_id <> ''",
    "categories": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {'NULL' if p is None else p}, '{n}')" for i, p, n in V.CATEGORY_ROWS) + ") t(id, parent_id, name)",
    "passes": r"SELECT user_id % 12 AS group_id, event_id, ts, event_type = 'signup' AS backfill, CAST(floor(value) AS BIGINT) AS articles, 100 + coalesce(TRY_CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT), 0) AS duration_ms, event_id * 10 AS server_high, CASE WHEN event_type = 'error' THEN 'connection reset' ELSE '' END AS err FROM events",
    "requests": "SELECT event_id, ts, user_id, 'GET' AS method, [" + ", ".join(f"'{p}'" for p in V.PATHS) + f"][CAST(event_id % {len(V.PATHS)} AS INT) + 1] AS path, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, CAST(floor(value) AS BIGINT) AS ms FROM events",
    "nfo": "SELECT doc_id, text || CASE doc_id % 9 WHEN 0 THEN chr(10) || 'IMDB: TT0' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || ' and tt99' || lpad(CAST(doc_id AS VARCHAR), 6, '0') WHEN 3 THEN chr(10) || 'https://thetvdb.com/?tab=series&id=' || doc_id WHEN 6 THEN chr(10) || 'https://www.themoviedb.org/movie/' || doc_id || ' tt1234567' ELSE '' END AS nfo FROM documents",
}
STEPS = ["headers", "h1", "h2", "h3", "h4", "h5", "h6", "parsed", "parts", "binaries", "n1", "n2", "n3", "n4", "releases", "linked", "segments"]
NEEDS = {"headers": 1, "parsed": 8, "parts": 9, "binaries": 10, "n4": 14, "releases": 15, "linked": 16, "segments": 17}


def query(select: str, *needs: str, **more: str) -> str:
    """A statement with the expressions that it names, and further ones given."""
    names = STEPS[: max([NEEDS[n] for n in needs if n in NEEDS], default=0)] + [n for n in needs if n not in NEEDS]
    ctes = {n: CTES[n] for n in names} | more
    return ("WITH " + ",\n".join(f"{n} AS ({s})" for n, s in ctes.items()) + "\n" if ctes else "") + select
