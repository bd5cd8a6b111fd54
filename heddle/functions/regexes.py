"""Patterns in the RE2 dialect, and their port to Java's.

RE2 and Java differ in word boundaries (ASCII against Unicode), in white space (Java adds vertical
tab) and at the end of a text ($ also matches before a final line feed). Patterns are kept in the
RE2 form, which SQL oracles use as they are, and ported where Spark uses them.
"""

from __future__ import annotations

import re

#: A boundary before a word and one behind it: one look-around each, as the general form, an alternative of two, is tried at every place.
_STARTS, _ENDS = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"


def port(pattern: str) -> str:
    """The Java pattern that matches what the RE2 pattern matches. A boundary at the start or behind .* is one before a word, any other one behind a
    word: words of these patterns begin and end with ASCII letters, digits or, where they may end with white space, could end before it too."""
    # Where a match can only begin with one character it is looked for first, as other places then cost next to nothing.
    first = re.match(r"(?:\(\?i\))?(?:\\b\(?(\\d|(?<!\()[a-z](?![?*{|]))|\((\\\.)[^()|]*(?:\|\2[^()|]*)*\)\?\2)", pattern)
    pattern = re.sub(r"(^(?:\(\?i\))?|\.\*)\\b", lambda m: m[1] + _STARTS, pattern)
    if first:
        begin = re.match(r"(?:\(\?i\))?", pattern).end()
        pattern = f"{pattern[:begin]}(?={first[1] or first[2]}){pattern[begin:]}"
    out = pattern.replace(r"[-\s]", "[-\\t\\n\\f\\r ]").replace(r"[^\s]", "[^\\t\\n\\f\\r ]").replace(r"\s", "[\\t\\n\\f\\r ]").replace(r"\b", _ENDS)
    return out[:-1] + r"\z" if out.endswith("$") else out


# Patterns of subjects.
COUNTER = r"[\(\[](\d{1,6})\s*/\s*(\d{1,6})[\)\]]"
OF_COUNTER = r"(?i)\b(\d{1,6})\s+of\s+(\d{1,6})\b"
PART_NAME = r"(?i)\.part(\d{1,4})\."
QUOTED = r'"([^"]+)"'
FILE_LIKE = r"\.[A-Za-z0-9]{1,8}$"
YENC = r"(?i)\byenc\b"
BYTES_NOTE = r"(?i)[-\s]+\d[\d,\.]*\s*bytes?\b"
YEARS = r"^[\(\[](19|20)\d{2}\s*/\s*(19|20)\d{2}[\)\]]$"
ARCHIVE = r"(?i)(\.part\d{1,5}|\.vol\d{1,6}\+\d{1,6}|\.r\d{2,4}|\.\d{2,4})?\.(rar|par2|zip|7z|sfv|nfo|nzb|001)$"
#: How what ARCHIVE matches ends, in five characters at most.
ARCHIVE_END = r"(?i)\.(rar|par2|zip|7z|sfv|nfo|nzb|001)$"
LEADING_FILES = r"^[^\[\]]*\[(\d{1,6})\s*/\s*(\d{1,6})\]"
VOLUME_FILE = r"(?i)(\.part\d{1,5}|\.vol\d{1,6}\+\d{1,6}|\.r\d{2,4}|\.\d{3,4})?\.(rar|par2|zip|7z|sfv|nfo|nzb|001)$"

# Patterns of display names.
LEADING_COUNTER = r"^\s*[\[\(]?\d{1,6}\s*/\s*\d{1,6}[\]\)]?\s*[-–]?\s*"
ANY_COUNTER = r"[\(\[]\d{1,6}\s*/\s*\d{1,6}[\)\]]"
EXTENSION = r"(?i)\.(rar|r\d{2,3}|par2|nfo|sfv|zip|7z|nzb|vol\d+\+\d+\.par2|mkv|mp4|avi|mp3|flac|iso|epub|mobi|pdf)$"
KNOWN_EXTENSION = r"(?i)\.(par2|rar|zip|7z|mkv|mp4|avi|nfo|sfv)$"
VOLUME = r"(?i)\.(vol\d+\+\d+|part\d+|r\d+|\d{2,3})$"

# Category rules in order, on search names.
CATEGORIES = [
    (r"\b(xxx|porn|brazzers|naughtyamerica|blacked|onlyfans)\b", 6000),
    (r"\b(audiobook|audio\s*book|m4b|librivox)\b", 3030),
    (r"\banime\b", 5070),
    (r"\b(uefa|epl|nba|nfl|nhl|mlb|wwe|ufc|formula\s*1|f1|motogp|premier\s*league|champions\s*league|grand\s*prix)\b", 5060),
    (r"\b(documentary|docuseries|bbc\s*docs?)\b", 5080),
    (r"\b(comic|cbr|cbz|graphic\s*novel)\b", 7030),
    (r"\bs\d{1,2}\s*e\d{1,3}\b", 5000),
    (r"\b\d{1,2}x\d{2,3}\b", 5000),
    (r"\bseason\s*\d{1,2}\b", 5000),
    (r"\b(hdtv|pdtv|web[- ]?dl|webrip)\b.*\b(s\d{1,2}|episode)\b", 5000),
    (r"\b(19|20)\d{2}\b.*\b(bluray|blu[- ]?ray|bdrip|brrip|dvdrip|web[- ]?dl|webrip|hdrip|remux|x264|x265|h264|h265|hevc)\b", 2000),
    (r"\b(1080p|2160p|720p|480p)\b.*\b(19|20)\d{2}\b", 2000),
    (r"\b(flac|ape|wavpack|dsd)\b", 3040),
    (r"\b(mp3|320kbps|v0|vbr|discography|album|single)\b", 3010),
    (r"\bmagazine\b", 7010),
    (r"\b(epub|mobi|azw3|azw|kindle)\b", 7020),
    (r"\b(ebook|retail\s*ebook)\b", 7000),
    (r"\b(pc\s*game|repack|codex|plaza|skidrow|fitgirl|gog|steamrip)\b", 4050),
    (r"\b(x86|x64|win(dows)?\s*(7|8|10|11)?|keygen|iso|installer)\b", 4000),
    (r"\b(ps[3-5]|playstation|xbox|xbox360|nintendo|switch|wii|nds|psp)\b", 1000),
]
OTHER = 8000
UHD = r"(?i)\b(2160p|4320p|4k|8k|uhd)\b"
HD = r"(?i)\b(1080p|1080i|720p|hd)\b"
SD = r"(?i)\b(480p|576p|360p|sd|dvdrip|dvd|vhs|xvid|divx)\b"
FOREIGN = r"(?i)\b(french|german|italian|spanish|dutch|nordic|swedish|danish|norwegian|finnish|korean|japanese|chinese|hindi|tamil|telugu|russian|polish|czech|hungarian|turkish|vostfr|truefrench|castellano|latino|dublado|deutsch|ita|ger|fre|spa|kor|jpn)\b"

# Patterns of titles and external identifiers.
EPISODE = r"(?i)\bs(\d{1,2})\s*e(\d{1,3})\b"
CROSS = r"\b(\d{1,2})x(\d{2,3})\b"
SEASON = r"(?i)\bseason\s*(\d{1,2})\b"
YEAR = r"\b(19\d{2}|20\d{2})\b"
IMDB = r"(?i)\btt\d{6,9}\b"
TVDB = r"(?i)thetvdb\.com[^\s]*?(?:[?&]id=|/series/|/movies/)(\d{1,9})\b"
TMDB = r"(?i)themoviedb\.org/(?:movie|tv)/(\d{1,9})\b"
