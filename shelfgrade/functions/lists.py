"""Ingredient lists: cut, split, clean and validate. Lists are ``array<string>`` columns."""
from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, functions as F

from .text import _c, contains_any, escape_regex, let, strip_ws, word_count

# Phrases that end an ingredient text.
CUT_MARKERS = [
    "modo de uso", "como usar", "how to use", "directions", "benefícios", "benefits", "indicação",
    "precauções", "warnings", "validade", "reg. ms", "sac:", "cnpj", "fabricante",
]
# Page furniture removed from an ingredient text.
GARBAGE_PHRASES = [
    "click here", "see more", "read more", "ver mais", "clique aqui", "saiba mais", "leia mais",
    "show more", "infamous", "known for", "commonly used", "is a type of", "can cause", "compare",
    "report error", "embed",
]
# Verbs of usage instructions.
USAGE_VERBS = [
    "aplique", "aplicar", "massageie", "enxágue", "enxague", "use", "apply", "massage", "rinse",
    "wash", "lavar", "espalhe", "distribua", "deixe agir", "aguarde",
]
# List entries that open a second list.
WATER_ENTRIES = ["aqua", "water", "aqua/water"]
HEADING_WORDS = [
    "shampoo", "condicionador", "conditioner", "máscara", "mascara", "mask", "creme", "leave-in", "óleo",
]
# Parentheses that belong to the ingredient name.
KEPT_PAREN_PREFIXES = ["ci ", "vitamin", "retinol", "tocopherol"]


@dataclass(frozen=True)
class ListRules:
    """Word lists of the list validator; replace them to work in another language or market."""

    cut_markers: list[str] = field(default_factory=lambda: list(CUT_MARKERS))
    garbage: list[str] = field(default_factory=lambda: list(GARBAGE_PHRASES))
    verbs: list[str] = field(default_factory=lambda: list(USAGE_VERBS))
    water: list[str] = field(default_factory=lambda: list(WATER_ENTRIES))
    headings: list[str] = field(default_factory=lambda: list(HEADING_WORDS))
    kept_prefixes: list[str] = field(default_factory=lambda: list(KEPT_PAREN_PREFIXES))
    min_plain: int = 5
    min_in_section: int = 3
    min_len: int = 2
    max_len: int = 80
    max_words: int = 8


DEFAULT_RULES = ListRules()


def cut_markers(col: Column | str, rules: ListRules = DEFAULT_RULES) -> Column:
    """Text before the first stop phrase, without page furniture.

    Cutting at each phrase in turn ends at the earliest phrase, so one minimum does it.
    """
    text = _c(col)
    lower = F.lower(text)
    hits = F.filter(
        F.array(*[F.locate(m, lower) for m in rules.cut_markers]), lambda p: p > 0
    )
    end = F.coalesce(F.array_min(hits) - 1, F.length(text))
    cut = F.substring(text, F.lit(1), end)
    pattern = "(?i)(" + "|".join(escape_regex(g) for g in rules.garbage) + ")"
    return strip_ws(F.regexp_replace(cut, pattern, ""))


def strip_translations(col: Column | str, rules: ListRules = DEFAULT_RULES) -> Column:
    """Remove parentheses of 4 to 50 characters and several words, unless they open with a kept prefix."""
    kept = "|".join(escape_regex(p) for p in rules.kept_prefixes)
    pattern = (
        r"(?i)\s*\((?=[^)]{4,50}\))(?!\s*(?:" + kept + r"))(?=\s*[^\s)][^)]* [^)]*[^\s)]\s*\))[^)]*\)"
    )
    return F.regexp_replace(_c(col), pattern, "")


def _count(text: Column, ch: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


def mark_firsts(items: Column, key) -> Column:
    """``array<struct<i, x, first>>`` in list order; ``first`` marks the first entry of each key. Sorts, so n log n."""
    tagged = F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    return F.sort_array(let(F.sort_array(tagged), lambda s: F.transform(s, lambda e, j: F.struct(
        e["i"].alias("i"), e["x"].alias("x"), F.coalesce(e["k"] != F.get(s, j - 1)["k"], F.lit(True)).alias("first")))))


def first_by(items: Column, key) -> Column:
    """First entry of each key, in list order."""
    return F.transform(F.filter(mark_firsts(items, key), lambda m: m["first"]), lambda m: m["x"])


def dedupe_ci(items: Column) -> Column:
    """First occurrences of an array of non-blank texts, compared without case."""
    return first_by(items, F.lower)


def split_list(col: Column | str) -> Column:
    """Split at the separator the text really uses: bullet, semicolon, comma, slash, line break.

    With any separator but the line break, line breaks only wrap one name and become blanks.
    """
    text = _c(col)
    joined = F.regexp_replace(text, r"\s*\n\s*", " ")
    parts = (
        F.when(text.rlike("[●•·]"), F.split(joined, "[●•·]"))
        .when(F.contains(text, F.lit(";")) & (_count(text, ";") > _count(text, ",")), F.split(joined, ";"))
        .when(F.contains(text, F.lit(",")), F.split(joined, ","))
        .when(_count(text, "/") > 5, F.split(joined, "/"))
        .when(F.contains(text, F.lit("\n")), F.split(text, "\n"))
        .otherwise(F.array(text))
    )
    trimmed = F.filter(F.transform(parts, strip_ws), lambda x: x != "")
    return dedupe_ci(trimmed)


def split_bullets(col: Column | str) -> Column:
    """Benefit text to bullets of 8 to 300 characters; the whole text when no part qualifies."""
    raw = _c(col)
    parts = F.split(raw, "[\\n\\r●•·;]+|(?<=[0-9A-Za-z_À-ÿ]),(?=\\s+[A-Za-zÁÉÍÓÚÂÊÔÃÕÇ])")
    neat = F.filter(F.transform(parts, lambda p: F.btrim(strip_ws(p), F.lit(" -–•\t"))), lambda p: p != "")
    kept = F.filter(neat, lambda p: F.length(p).between(8, 300))
    whole = strip_ws(raw)
    return F.when(F.size(kept) > 0, kept).when(whole != "", F.array(whole))


def valid_item(item: Column, in_section: Column, rules: ListRules = DEFAULT_RULES) -> Column:
    s = strip_ws(item)
    words = word_count(s)
    shape = (
        F.length(s).between(rules.min_len, rules.max_len)
        & ~F.lower(s).rlike("https?://")
        & (words <= rules.max_words)
    )
    return shape & (in_section | (words < 2) | ~contains_any(F.lower(s), rules.verbs))


def has_repetition(items: Column) -> Column:
    """The first k entries come again as the next k, for some k from 3 to half the list."""
    def repeats(norm: Column) -> Column:
        half = F.floor(F.size(norm) / 2).cast("int")
        sizes = F.when(half >= 3, F.sequence(F.lit(3), half)).otherwise(F.array().cast("array<int>"))
        return F.exists(sizes, lambda k: (F.get(norm, F.lit(0)) == F.get(norm, k)) & (
            F.slice(norm, F.lit(1), k) == F.slice(norm, k + 1, k)))

    return let(F.transform(items, lambda x: strip_ws(F.lower(x))), repeats)


def has_concatenation(items: Column, rules: ListRules = DEFAULT_RULES) -> Column:
    """Two water entries that are not neighbours, or an entry that is a product heading."""
    heading = r"^(" + "|".join(escape_regex(h) for h in rules.headings) + r")\s*:"

    def joined(norm: Column) -> Column:
        spots = F.filter(F.transform(norm, lambda x, i: F.when(x.isin(*rules.water), i)), lambda p: p.isNotNull())
        apart = let(spots, lambda w: F.exists(F.transform(w, lambda p, i: p - F.get(w, i - 1)), lambda g: F.coalesce(g > 1, F.lit(False))))
        return apart | F.exists(norm, lambda x: x.rlike(heading))

    return let(F.transform(items, lambda x: strip_ws(F.lower(x))), joined)


def validate_list(
    items: Column | str, in_section: Column | bool = False, rules: ListRules = DEFAULT_RULES
) -> Column:
    """``struct<valid, cleaned, removed, reason>`` of one list.

    ``seen`` in the definition grows only by accepted entries, and an entry's acceptance depends on
    its text and context alone, so "first occurrence of the key, and acceptable" is the same rule
    without a loop. Case variants differ only in case, which acceptance ignores.
    """
    ctx = F.lit(in_section) if isinstance(in_section, bool) else in_section
    least = F.when(ctx, F.lit(rules.min_in_section)).otherwise(F.lit(rules.min_plain))
    none = F.array().cast("array<string>")

    def judged(parts: Column) -> Column:
        cleaned, rep, con = parts["cleaned"], parts["rep"], parts["con"]
        reason = (
            F.when(rep, F.lit("repetition_detected")).when(con, F.lit("concat_detected"))
            .when(F.size(cleaned) < least,
                  F.concat(F.lit("min_ingredients: only "), F.size(cleaned).cast("string"), F.lit(" valid terms")))
            .otherwise(F.lit("")))
        return F.struct(
            (reason == "").alias("valid"), F.when(rep | con, none).otherwise(cleaned).alias("cleaned"),
            F.when(rep | con, none).otherwise(parts["removed"]).alias("removed"), reason.alias("reason"))

    def pick(marks: Column, taken: bool) -> Column:
        return F.transform(F.filter(marks, lambda m: m["ok"] == F.lit(taken)), lambda m: m["x"])

    def checked(arr: Column) -> Column:
        neat = F.filter(F.transform(arr, strip_ws), lambda x: x != "")
        marks = F.transform(mark_firsts(neat, F.lower), lambda m: F.struct(
            m["x"].alias("x"), (m["first"] & valid_item(m["x"], ctx, rules)).alias("ok")))
        return let(let(marks, lambda ms: F.struct(
            pick(ms, True).alias("cleaned"), pick(ms, False).alias("removed"),
            has_repetition(arr).alias("rep"), has_concatenation(arr, rules).alias("con"))), judged)

    return let(_c(items), checked)


def extract_and_validate(
    raw: Column | str, in_section: Column | bool = False, rules: ListRules = DEFAULT_RULES
) -> Column:
    """Cut, drop translations, split, validate; the same struct as :func:`validate_list`."""
    text = _c(raw)
    none = F.array().cast("array<string>")

    def refused(reason: str) -> Column:
        return F.struct(
            F.lit(False).alias("valid"), none.alias("cleaned"), none.alias("removed"), F.lit(reason).alias("reason")
        )

    def judged(cut: Column) -> Column:
        result = validate_list(split_list(strip_translations(cut, rules)), in_section, rules)
        return F.when(cut == "", refused("empty_after_cleaning")).otherwise(result)

    blank = text.isNull() | (strip_ws(text) == "")
    return F.when(blank, refused("no_inci_text")).otherwise(let(cut_markers(text, rules), judged))


def tokens_of(items: Column) -> Column:
    """Distinct alphanumeric tokens of at least three characters of a list."""
    parts = F.flatten(F.transform(items, lambda x: F.split(x, r"[/(),•·●;]")))
    keys = F.transform(parts, lambda p: F.regexp_replace(F.lower(p), "[^a-z0-9]+", ""))
    return F.array_distinct(F.filter(keys, lambda k: F.length(k) >= 3))


def merge_lists(left: Column, right: Column) -> Column:
    """Ordered union; null when both sides are null."""
    none = F.array().cast("array<string>")
    return F.when(left.isNull() & right.isNull(), F.lit(None)).otherwise(
        F.concat(
            F.coalesce(left, none),
            F.array_except(F.coalesce(right, none), F.coalesce(left, none)),
        )
    )


def merge_objects(left: Column, right: Column) -> Column:
    """Map union where the left side wins wherever it holds a value."""
    return F.map_zip_with(left, right, lambda _k, a, b: F.coalesce(a, b))


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)

