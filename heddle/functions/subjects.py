"""Article subjects as typed fields (T01-T09), in native expressions.

Regex match positions, which Spark doesn't give, are had from the text before a match: the matches
before the last counter are skipped by a repetition whose count is foldable for the usual cases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.tables import free
from . import regexes as R

WS = r"[\t\n\f\r ]+"
#: White space of Java's patterns.
SPACES = " \t\n\x0b\f\r"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often ``use`` names it. The value is copied, so it should be small. A projection that
    holds a function of arrays is generated by itself, in methods that are short enough for the JVM to compile; others in a row become one long method."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def every(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(R.port(pattern)), group)


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def collapsed(text: Column) -> Column:
    return F.regexp_replace(text, WS, " ")


def shaved(text: Column, chars: str) -> Column:
    return F.btrim(text, F.lit(chars))


def _before(subject: Column, token: str, index: Column, first: Column, usual: int = 4) -> Column:
    """Text before the index-th (from 0) match of ``token``. Before the ``first`` match it is the text before that match's own text, as no match
    looks around itself, so none of its text stands earlier. The count of others is a literal for the first few."""
    skip = f"(?:(?!{token}).)*"
    fixed = lambda i: rf"(?s)^((?:{skip}{token}){{{i}}}{skip}){token}"
    out = F.when(index == 0, F.call_function("substring_index", subject, first, F.lit(1)))
    for i in range(1, usual + 1):
        out = out.when(index == i, F.regexp_extract(subject, fixed(i), 1))
    rest = F.call_function("regexp_extract", subject, F.concat(F.lit(rf"(?s)^((?:{skip}{token}){{"), index.cast("string"), F.lit(rf"}}{skip}){token}")), F.lit(1))
    return out.when(index > usual, rest)


def collection_title(head: Column) -> Column:
    """The text before a counter as a title, '' if it has fewer than 8 bytes."""
    title = shaved(collapsed(trimmed(head)), " -–_.")
    return F.when(F.octet_length(title) >= 8, title).otherwise("")


def is_archive(file_name: Column) -> Column:
    """Whether ARCHIVE matches: its volume may be missing, so only the end is looked at."""
    return F.substring(file_name, -5, 5).rlike(R.port(R.ARCHIVE_END))


def collection_base(file_name: Column) -> Column:
    """A file's name without archive volume and extension."""
    return trimmed(F.regexp_replace(trimmed(file_name), R.port(R.ARCHIVE), ""))


def duplicate_counter(n: Column, total: Column, part: Column, parts: Column) -> Column:
    """Whether file and segment counter are the same."""
    return (parts > 0) & (n == part) & (total == parts)


def parse_subject(df, subject: str = "subject"):
    """``df`` with part_number, total_parts (T03), file_name (T02), norm_subject (T08),
    collection_key (T05), file_number and collection_files (T04).

    Each step is a projection, so none is evaluated more than once, and those without a function of arrays have a small column made one (let) where
    too many would follow each other; expressions that only some subjects need are evaluated for these alone. The name is the last quoted token that looks like a file, else the last one. The segment
    counter is the last n/m, else n of m, else .partN. alone. The file counter is the last other one
    that isn't a range of years and, where a name is quoted, ends at most 64 bytes before it. A null subject
    is parsed as an empty one; columns that are called like the results are replaced, all others stay.
    """
    C = R.port(R.COUNTER)
    num = lambda text, pattern, g: F.regexp_extract(text, pattern, g).try_cast("int")
    same = lambda x: x
    of, part, years = (R.port(p) for p in (R.OF_COUNTER, R.PART_NAME, R.YEARS))
    # Patterns that few subjects match are tried where a cheap sign of them is found: archives by the end of the name, n of m by its word.
    # Numbers are read only where there are some: a cast that fails costs more than all of a subject's patterns.
    steps = [
        lambda c: {"_q": every(c("_s"), R.QUOTED), "_cs": every(c("_s"), R.COUNTER)},
        lambda c: {"_in": F.transform(c("_q"), lambda t: trimmed(F.substring(t, F.lit(2), F.length(t) - 2))), "_seg": F.try_element_at(c("_cs"), F.lit(-1))},
        lambda c: {"_qi": F.coalesce(F.array_max(F.transform(c("_in"), lambda t, i: F.when(F.substring(t, F.lit(-9), F.lit(9)).rlike(R.port(R.FILE_LIKE)), i))), F.size(c("_q")) - 1).cast("int")},
        lambda c: {"file_name": F.coalesce(F.get(c("_in"), c("_qi")), F.lit("")), "_pre": F.when(c("_qi") >= 0, _before(c("_s"), '"[^"]+"', c("_qi"), F.get(c("_q"), F.lit(0)))).otherwise(c("_s"))},
        lambda c: {"_arch": (c("file_name") != "") & is_archive(c("file_name")), "_use": F.greatest(F.least(F.size(every(c("_pre"), R.COUNTER)), F.size(c("_cs")) - 1), F.lit(0))},
        lambda c: {"_at": F.coalesce(F.array_max(F.transform(F.slice(c("_cs"), F.lit(1), c("_use")), lambda t, i: F.when(~t.rlike(years), i))), F.lit(-1)).cast("int")},
        lambda c: {"_tok": F.get(c("_cs"), c("_at")), "_head": F.when(c("_at") >= 0, _before(c("_s"), C.replace("(\\d", "(?:\\d"), c("_at"), F.get(c("_cs"), F.lit(0))))},
        lambda c: {"_ok": let((c("_at") >= 0) & ((c("_qi") < 0) | (F.octet_length(c("_pre")) - F.octet_length(c("_head")) - F.octet_length(c("_tok"))).between(0, 64)), same)},
        lambda c: {
            "_n": let(F.when(c("_ok"), num(c("_tok"), C, 1)), same), "_m": F.when(c("_ok"), num(c("_tok"), C, 2)),
            "_of": c("_seg").isNull() & F.contains(F.lower(c("_s")), F.lit("of")) & c("_s").rlike(of),
            "_title": F.when(c("_ok"), shaved(collapsed(trimmed(c("_head"))), " -–_.")),
            "_after": F.call_function("substring_index", c("_s"), c("_seg"), F.lit(-1)),
        },
        lambda c: {
            "part_number": F.when(c("_seg").isNotNull(), num(c("_seg"), C, 1)).when(c("_of"), num(c("_s"), of, 1)).when(c("_s").rlike(part), num(c("_s"), part, 1)).otherwise(0),
            "total_parts": F.when(c("_seg").isNotNull(), num(c("_seg"), C, 2)).when(c("_of"), num(c("_s"), of, 2)).otherwise(0),
            "_base": F.when(c("_arch") & (~c("_ok") | (F.octet_length(c("_title")) < 8)), collection_base(c("file_name"))),
            "_slash": let(F.concat(F.lit("/"), c("_m").cast("string")), same),
        },
        lambda c: {
            "collection_key": F.when(~c("_ok"), F.when(c("_arch") & (c("_base") != ""), F.concat(F.lit("b:"), c("_base"))).otherwise(""))
            .when(c("_m") < 2, "")
            .when(F.octet_length(c("_title")) >= 8, F.concat(F.lit("t:"), c("_title"), c("_slash")))
            .when(c("_arch") & (c("_base") != ""), F.concat(c("_base"), c("_slash")))
            .when((c("file_name") != "") & ~duplicate_counter(c("_n"), c("_m"), c("part_number"), c("total_parts")), F.concat(c("file_name"), c("_slash")))
            .otherwise(""),
            "_cut": F.when(c("_seg").isNull(), c("_s")).otherwise(F.concat(F.substring(c("_s"), F.lit(1), F.length(c("_s")) - F.length(c("_after")) - F.length(c("_seg"))), F.lit(" "), c("_after"))),
        },
        lambda c: {"file_number": let(F.when(c("_ok") & (c("collection_key") != ""), c("_n")).otherwise(0), same), "collection_files": F.when(c("_ok") & (c("collection_key") != ""), c("_m")).otherwise(0), "norm_subject": _normal(c("_cut"))},
    ]
    out, names = df.withColumn(mine := free("_s", df), F.coalesce(F.col(subject), F.lit(""))), {"_s": mine}
    for step in steps:
        new = step(lambda k: F.col(names[k]))  # noqa: B023
        names |= {k: free("_p" + k, df) for k in new}
        out = out.withColumns({names[k]: value for k, value in new.items()})
    results = ["file_name", "part_number", "total_parts", "collection_key", "file_number", "collection_files", "norm_subject"]
    return out.withColumns({k: F.col(names[k]) for k in results}).drop(*names.values())


def _normal(s: Column) -> Column:
    s = F.when(F.contains(F.lower(s), F.lit("of")), F.regexp_replace(s, R.port(R.OF_COUNTER), " ")).otherwise(s)
    for pattern in (R.YENC, R.BYTES_NOTE):
        s = F.regexp_replace(s, R.port(pattern), " ")
    return trimmed(shaved(collapsed(s), " -_."))
