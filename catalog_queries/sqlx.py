"""DuckDB expression text for the oracles, built from small pieces."""
from __future__ import annotations

WS = "(' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"


def trim(c: str) -> str:
    return f"trim({c}, {WS})"


def fold(c: str) -> str:
    return trim(f"lower(strip_accents({c}))")


def rep(c: str, pat: str, to: str = "") -> str:
    pat, to = pat.replace("'", "''"), to.replace("'", "''")
    return f"regexp_replace({c}, '{pat}', '{to}', 'g')"


def collapse(c: str) -> str:
    return trim(rep(c, r"\s+", " "))


def words(c: str) -> str:
    return f"len(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> ''))"


def has_any(c: str, words_: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(c, w.replace("'", "''")) for w in words_) + ")"


def dedupe(lst: str) -> str:
    return f"list_filter({lst}, lambda x, i: list_position(list_transform({lst}, lambda y: lower(y)), lower(x)) = i)"


def count_of(c: str, ch: str) -> str:
    return f"(length({c}) - length(replace({c}, '{ch}', '')))"


def split_parts(c: str) -> str:
    """Parts before trimming and removal of repeats."""
    joined = rep(c, r"\s*\n\s*", " ")
    return (
        f"CASE WHEN regexp_matches({c}, '[●•·]') THEN string_split_regex({joined}, '[●•·]') "
        f"WHEN contains({c}, ';') AND {count_of(c, ';')} > {count_of(c, ',')} THEN string_split({joined}, ';') "
        f"WHEN contains({c}, ',') THEN string_split({joined}, ',') "
        f"WHEN {count_of(c, '/')} > 5 THEN string_split({joined}, '/') "
        f"WHEN contains({c}, chr(10)) THEN string_split({c}, chr(10)) ELSE [{c}] END")


def neat_parts(c: str) -> str:
    return f"list_filter(list_transform({split_parts(c)}, lambda p: {trim('p')}), lambda p: p <> '')"


def cut(c: str, markers: list[str], garbage: list[str]) -> str:
    pos = ", ".join("position('{}' in lower({}))".format(m.replace("'", "''"), c) for m in markers)
    end = f"coalesce(list_min(list_filter([{pos}], lambda p: p > 0)) - 1, length({c}))"
    return trim("regexp_replace(substring({}, 1, CAST({} AS BIGINT)), '(?i)({})', '', 'g')".format(c, end, "|".join(garbage)))


#: The entities that the tables' own texts can hold, for SQL; ``&amp;`` last, so that nothing is decoded twice.
ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&ccedil;", "ç"), ("&atilde;", "ã"), ("&otilde;", "õ"), ("&aacute;", "á"), ("&eacute;", "é"),
    ("&iacute;", "í"), ("&oacute;", "ó"), ("&uacute;", "ú"), ("&acirc;", "â"), ("&ecirc;", "ê"),
    ("&ocirc;", "ô"), ("&agrave;", "à"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
]
