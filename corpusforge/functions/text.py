"""Text functions: bodies, entities, exact terms, quality, cells and names.

All are Column expressions that stay in the JVM. Character classes are written
out, as ``\\w`` and ``\\s`` are ASCII in Java's regular expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\p{Z}\t\n\x0B\f\r\x1C-\x1F\x85]"
WORD = r"[\p{L}\p{N}_]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def collapse(c) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), SPACE + "+", " "))


def strip(c) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), f"^{SPACE}+", ""), f"{SPACE}+$", "")


def head(c, n: int) -> Column:
    """The first n characters of the stripped text; what follows them is looked at up to its first word alone."""

    def cut(x: Column) -> Column:
        first = F.substring(x, 1, n)
        more = F.substring(x, n + 1, 2**31 - 1).rlike(f"[^{SPACE[1:-1]}]")
        return F.when(more, first).otherwise(F.regexp_replace(first, f"{SPACE}+$", ""))

    return let(F.regexp_replace(col(c), f"^{SPACE}+", ""), cut)


def normalize_body(c) -> Column:
    return F.lower(collapse(c))


def strip_headings(text, headings) -> Column:
    """The text without the headings at its front, each in turn.

    Stops at the first heading that isn't in front; a body that would be blank
    is the whole text instead. Null text: empty.
    """
    whole = F.coalesce(col(text), F.lit(""))
    start = F.struct(whole.alias("body"), F.lit(False).alias("done"))

    def drop(acc, h):
        front = F.regexp_replace(acc["body"], f"^{SPACE}+", "")
        rest = F.regexp_replace(F.substring(front, F.length(h) + 1, F.length(front)), r"^\n+", "")
        skip = acc["done"] | F.coalesce(h == "", F.lit(True))
        return F.when(skip, acc).when(F.startswith(front, h), F.struct(rest.alias("body"), F.lit(False).alias("done"))).otherwise(F.struct(acc["body"].alias("body"), F.lit(True).alias("done")))

    none = F.array().cast("array<string>")
    body = strip(F.aggregate(F.coalesce(col(headings), none), start, drop)["body"])
    return F.when(body == "", strip(whole)).otherwise(body)


def body_hash(text, headings=None) -> Column:
    body = strip(F.coalesce(col(text), F.lit(""))) if headings is None else strip_headings(text, headings)
    return F.sha2(normalize_body(body), 256)


def normalize_entity(c) -> Column:
    """Lower case, single spaces, no punctuation at the ends."""
    return F.regexp_replace(F.lower(collapse(c)), r"^[ .,;:·•-]+|[ .,;:·•-]+$", "")


def compact_upper(c) -> Column:
    return F.upper(F.regexp_replace(col(c), SPACE + "+", ""))


def strip_money(c) -> Column:
    return strip(F.regexp_replace(col(c), "(?iu)(?:€|euro|eur)", ""))


def normalize_reference(c) -> Column:
    """Variants of one legal reference in one form."""
    out = col(c)
    for pattern in (r"(?iu)\bn\.?", r"(?iu)\(?\b(?:UE|CE)\b\)?", rf"(?iu)banca{SPACE}*d['’]italia", r"(?iu)\b(?:del|della|dello|dei|degli|delle)\b"):
        out = F.regexp_replace(out, pattern, "")
    return F.upper(F.regexp_replace(out, r"[.,()'’\p{Z}\t\n\r]+", ""))


def tokens(c) -> Column:
    """Lower-case words of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(f"({WORD}+)"), 1)


def full_text_tokens(c, least: int = 2, most: int = 30) -> Column:
    return F.filter(tokens(c), lambda t: F.length(t).between(least, most))


def contains_all(text, query: str) -> Column:
    """Whether every token of the query is a token of the text; false without any."""
    words = F.array_distinct(full_text_tokens(F.lit(query)))
    return F.coalesce((F.size(words) > 0) & (F.size(F.array_except(words, full_text_tokens(text))) == 0), F.lit(False))


# What counts as an exact term of a query.
QUOTED = '"([^"]{2,})"'
NUMBERED = r"(?U)\b(\d+(?:[/.\-]\d+)+)\b"
ALPHANUMERIC = r"(?U)\b((?=\w*\d)(?=\w*[A-Za-z])[\w.]{2,})\b"
ACRONYM = r"(?U)\b([A-Z]{3,})\b"


def lexical_terms(query) -> Column:
    """Quoted phrases, numbered references, codes and acronyms of three characters or more."""
    q = F.coalesce(col(query), F.lit(""))
    found = F.concat(F.transform(F.regexp_extract_all(q, F.lit(QUOTED), 1), strip), *[F.regexp_extract_all(q, F.lit(p), 1) for p in (NUMBERED, ALPHANUMERIC, ACRONYM)])
    return F.array_sort(F.filter(F.array_distinct(found), lambda t: F.length(t) >= 3))


def term_overlap(text, terms) -> Column:
    """How many of the terms stand somewhere in the text, whatever their case."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    return F.size(F.filter(col(terms), lambda t: F.contains(low, F.lower(t)))).cast("long")


# --- quality ---------------------------------------------------------------

VOWELS = "aeiouAEIOUàèéìòùáéíóúâêîôûäëïöüãõyY"  # fixed values


def quality_signals(c) -> Column:
    text = F.coalesce(col(c), F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    without = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")
    has_vowel = lambda w: F.length(F.translate(w, VOWELS, "")) < F.length(w)
    words = F.regexp_extract_all(text, F.lit(f"({WORD}+)"), 1)
    parts = F.struct(
        F.length(text).cast("long").alias("chars"),
        without(r"\p{L}+").alias("alpha"),
        (F.length(text) - F.length(F.translate(text, VOWELS, ""))).cast("long").alias("vowels"),
        without(r"[^\p{L}\p{N}\p{Z}\t\n\x0B\f\r\x1C-\x1F\x85]+").alias("symbols"),
        let(
            words,
            lambda w: F.struct(
                F.size(w).cast("long").alias("n"),
                F.size(F.array_distinct(F.transform(w, F.lower))).alias("distinct"),
                F.size(F.filter(w, lambda x: F.length(x).between(2, 30) & has_vowel(x))).cast("long").alias("wordlike"),
            ),
        ).alias("words"),
        # words with a letter; those of 2 to 30 characters with a vowel are counted above
        count(rf"[\p{{N}}_]*\p{{L}}{WORD}*").alias("alpha_words"),
    )
    return let(
        parts,
        lambda s: F.struct(
            s["chars"].alias("n_chars"),
            s["words"]["n"].alias("n_words"),
            s["alpha_words"].alias("n_alpha_words"),
            ratio(s["alpha"], s["chars"]).alias("alpha_ratio"),
            ratio(s["vowels"], s["alpha"]).alias("vowel_ratio_in_alpha"),
            ratio(s["symbols"], s["chars"]).alias("symbol_ratio"),
            ratio(s["words"]["wordlike"], s["alpha_words"]).alias("wordlike_ratio"),
            ratio(s["words"]["distinct"], s["words"]["n"]).alias("unique_ratio"),
        ),
    )


# Flag, its penalty, and the condition on the signals.
PENALTIES = {
    "gibberish": (0.5, lambda s, least: (s["alpha_ratio"] > 0.2) & (s["vowel_ratio_in_alpha"] < 0.15)),
    "non_word": (0.3, lambda s, least: (s["n_alpha_words"] >= 3) & (s["wordlike_ratio"] < 0.5)),
    "short": (0.15, lambda s, least: s["n_words"] < least),
    "symbol_heavy": (0.2, lambda s, least: s["symbol_ratio"] > 0.5),
    "repetitive": (0.2, lambda s, least: (s["n_words"] >= 20) & (s["unique_ratio"] < 0.25)),
}


def quality(c, signals=None, min_words: int = 4) -> Column:
    """(quality_score, quality_flags): 1 less a penalty for each sign of junk."""
    text = F.coalesce(col(c), F.lit(""))
    blank = strip(text) == ""

    def judged(s: Column) -> Column:
        held = {name: rule(s, min_words) for name, (_, rule) in PENALTIES.items()}
        flags = F.filter(F.array(*[F.when(h, F.lit(name)) for name, h in held.items()]), lambda f: f.isNotNull())
        penalty = sum((F.when(held[name], F.lit(p)).otherwise(F.lit(0.0)) for name, (p, _) in PENALTIES.items()), F.lit(0.0))
        score = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - penalty)), 3)
        return F.struct(score.alias("quality_score"), flags.alias("quality_flags"))

    empty = F.struct(F.lit(0.0).alias("quality_score"), F.array(F.lit("empty")).alias("quality_flags"))
    return F.when(blank, empty).otherwise(let(quality_signals(text) if signals is None else col(signals), judged))


# --- cells, names, numbers -------------------------------------------------


def clip(c, n: int = 80) -> Column:
    """Collapsed text of at most n characters, the last an ellipsis where it is cut."""
    s = collapse(col(c).cast("string"))
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, n - 1), F.lit("…")))


def italian_number(c) -> Column:
    """1.234,56; whole numbers without decimals; a dash for NaN and null."""
    x = col(c).cast("double")
    swap = lambda s: F.translate(s, ".,", ",.")
    return F.when(x.isNull() | F.isnan(x), F.lit("—")).when(x == F.floor(x), swap(F.format_number(x, 0))).otherwise(swap(F.format_number(x, 2)))


def parse_number(c, decimal: str = ".") -> Column:
    """A cell as a double in the given dialect; null where it is none."""
    s = strip(col(c).cast("string"))
    if decimal == ",":
        s = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    s = F.regexp_replace(F.replace(s, F.lit("%"), F.lit("")), SPACE, "")
    return F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))


def verbalize(columns: list[str], n: int = 80) -> Column:
    """``name: value; ...`` of the cells that aren't blank."""
    cells = [F.when(strip(F.col(f"`{c}`").cast("string")) != "", F.concat(F.lit(f"{c}: "), clip(f"`{c}`", n))) for c in columns]
    return F.array_join(F.filter(F.array(*cells), lambda x: x.isNotNull()), "; ")


def slugify(c, most: int | None = None) -> Column:
    """Lower-case ASCII words joined by hyphens; with ``most``, cut at a word's end."""
    plain = F.regexp_replace(F.normalize(col(c), F.lit("NFKD")) if hasattr(F, "normalize") else col(c), r"\p{M}", "")
    slug = F.regexp_replace(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    if most is None:
        return slug
    cut = F.regexp_replace(F.substring(slug, 1, most + 1), "-[^-]*$", "")
    return F.when(F.length(slug) <= most, slug).otherwise(F.substring(cut, 1, most))


def property_key(c) -> Column:
    """snake_case of a property's name: spaces and hyphens join words, other signs go."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), f"(?:{SPACE}|-)+", "_"), "[^a-z0-9_]+", "")
    return F.regexp_replace(F.regexp_replace(plain, "_+", "_"), "^_|_$", "")


def loose_name(c) -> Column:
    """A file name's letters and digits, for comparing loosely."""
    return F.regexp_replace(F.lower(F.regexp_replace(col(c), r"\.[^.]*$", "")), "[^a-z0-9]+", "")


def vtt_timestamp(seconds) -> Column:
    ms = F.round(col(seconds) * 1000).cast("long")
    part = lambda by, mod: F.expr("0").cast("long") + F.floor(ms / by) % mod
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000).cast("long"), part(60_000, 60).cast("long"), part(1000, 60).cast("long"), (ms % 1000).cast("long"))


def display_name(label, text, name, n: int = 70) -> Column:
    """A chunk's first characters on one line; another node's own name."""
    return F.when(col(label) == "Chunk", F.substring(F.replace(col(text), F.lit("\n"), F.lit(" ")), 1, n)).otherwise(col(name))


def html_escape(c) -> Column:
    out = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def truthy(c) -> Column:
    return F.coalesce(F.lower(strip(col(c).cast("string"))).isin("1", "true", "yes", "y", "on"), F.lit(False))


def windows(c, size: int = 300, overlap: int = 30) -> Column:
    """Overlapping windows of words; a text within one window is itself."""

    def cut(words: Column) -> Column:
        n = F.size(words)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap)), lambda s: (s == 0) | (s + overlap < n))
        return F.when(n <= size, F.array(col(c))).otherwise(F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, F.lit(size)), " ")))

    return let(F.filter(F.split(collapse(c), " "), lambda w: w != ""), cut)
