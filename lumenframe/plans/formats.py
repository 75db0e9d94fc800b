"""Date and time formats of other dialects as Spark's patterns."""

from __future__ import annotations

import re

#: What a code of ``strftime`` or of MySQL's DATE_FORMAT stands for.
PERCENT = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "k": "H", "I": "hh", "l": "h", "h": "hh", "M": "mm", "i": "mm", "S": "ss", "s": "ss", "f": "SSSSSS", "p": "a", "j": "DDD", "b": "MMM",
    "B": "MMMM", "a": "EEE", "A": "EEEE", "W": "EEEE", "c": "M", "T": "HH:mm:ss", "F": "yyyy-MM-dd", "D": "MM/dd/yy", "R": "HH:mm", "Z": "zzz", "z": "xx", "g": "SSS",
}
#: Where MySQL's (and Trino's) codes mean something else than strftime's.
MYSQL = {"M": "MMMM", "h": "hh", "r": "hh:mm:ss a", "D": None, "W": "EEEE"}
STRFTIME = {"h": "MMM", "i": None, "s": None, "W": None, "c": None, "k": None, "l": None, "e": None}
SQLITE = {"f": "ss.SSS", "s": None, "w": None}
#: Codes of TO_CHAR and TO_TIMESTAMP, the longest first.
TEMPLATE = {
    "YYYY": "yyyy", "YY": "yy", "MONTH": "MMMM", "MMMM": "MMMM", "MON": "MMM", "MM": "MM", "DDD": "DDD", "DD": "dd", "DAY": "EEEE", "DY": "EEE", "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm",
    "SS": "ss", "FF9": "SSSSSSSSS", "FF6": "SSSSSS", "FF3": "SSS", "FF": "SSSSSSSSS", "MS": "SSS", "US": "SSSSSS", "AM": "a", "PM": "a", "Q": "q", "IYYY": None, "IW": None, "WW": None, "TZH": "x", "TZ": "zzz", "D": None, "J": None, "W": None,
}
#: Styles of CONVERT between dates and text.
STYLES = {
    101: "MM/dd/yyyy", 102: "yyyy.MM.dd", 103: "dd/MM/yyyy", 104: "dd.MM.yyyy", 105: "dd-MM-yyyy", 106: "dd MMM yyyy", 107: "MMM dd, yyyy", 108: "HH:mm:ss", 110: "MM-dd-yyyy", 111: "yyyy/MM/dd",
    112: "yyyyMMdd", 114: "HH:mm:ss:SSS", 120: "yyyy-MM-dd HH:mm:ss", 20: "yyyy-MM-dd HH:mm:ss", 121: "yyyy-MM-dd HH:mm:ss.SSS", 21: "yyyy-MM-dd HH:mm:ss.SSS", 23: "yyyy-MM-dd", 24: "HH:mm:ss", 126: "yyyy-MM-dd'T'HH:mm:ss.SSS",
}


def _plain(text: str) -> str:
    """Letters of a format that stand for themselves, quoted."""
    return re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", text.replace("'", "''"))


def percent(fmt: str, dialect: str) -> str:
    own = PERCENT | {"mysql": MYSQL, "trino": MYSQL, "sqlite": STRFTIME | SQLITE}.get(dialect, STRFTIME)
    out, at = [], 0
    for m in re.finditer(r"%-?(.)", fmt):
        out.append(_plain(fmt[at : m.start()]))
        at = m.end()
        code = "%" if m[1] == "%" else own.get(m[1])
        if code is None:
            raise ValueError(f"the format code {m[0]} has no pattern in Spark")
        if m[0][1] == "-":
            code = {"MM": "M", "dd": "d", "HH": "H", "hh": "h", "mm": "m", "ss": "s"}.get(code, code)
        out.append(code)
    return "".join(out) + _plain(fmt[at:])


def template(fmt: str) -> str:
    """A pattern of TO_CHAR's codes; blanks after names of months and days are not padded."""
    out, at = [], 0
    codes = sorted(TEMPLATE, key=len, reverse=True)
    while at < len(fmt):
        if fmt[at] == '"':
            end = fmt.index('"', at + 1)
            out.append("'" + fmt[at + 1 : end].replace("'", "''") + "'")
            at = end + 1
            continue
        if fmt[at : at + 2].upper() == "FM":
            at += 2
            continue
        code = next((c for c in codes if fmt[at : at + len(c)].upper() == c), None)
        if code is None:
            if fmt[at].isalnum():
                raise ValueError(f"the format {fmt} has a part without a pattern in Spark at {at}")
            out.append(_plain(fmt[at]))
            at += 1
            continue
        if TEMPLATE[code] is None:
            raise ValueError(f"the format code {code} has no pattern in Spark")
        out.append(TEMPLATE[code])
        at += len(code)
    return "".join(out)
