"""Entities by patterns, and the hygiene of what models extract."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions import text

# Fixed values: (type, pattern, group, normal form). Java flags: i case, U Unicode classes.
RULES = [
    ("email", r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b", 0, "lower"),
    ("url", r"(?iU)(?:https?://|(?<![@\w])www\.)[^\s<>\")]*[^\s<>\").,;:!?]", 0, "lower"),
    ("iban", r"(?U)\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", 0, "compact"),
    ("isin", r"(?U)\b[A-Z]{2}[A-Z0-9]{9}\d\b", 0, "compact"),
    ("importo monetario", r"(?iU)(?:€|EUR|euro)\s?\d{1,3}(?:[.\s]\d{3})*(?:,\d{1,2})?|\d{1,3}(?:[.\s]\d{3})*(?:,\d{1,2})?\s?(?:€|EUR|euro)\b", 0, "money"),
    ("percentuale", r"(?U)\b\d{1,3}(?:[.,]\d+)?\s?%", 0, "compact"),
    ("data", r"(?U)\b\d{1,2}/\d{1,2}/\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b", 0, "compact"),
    ("normativa", r"(?iU)\b(?:D\.?\s?Lgs\.?|D\.?\s?M\.?|D\.?\s?P\.?R\.?|D\.?\s?L\.?|Decreto\s+Legislativo|Decreto\s+Ministeriale)\s*(?:n\.?\s*)?\d+/\d{2,4}", 0, "reference"),
    ("normativa", r"(?iU)\b(?:decreto\s+legislativo|decreto[-\s]legge|decreto|legge)\s+\d{1,2}°?\s+[^\W\d_]+\s+\d{4}(?:,?\s*n\.?\s*\d+)?", 0, "reference"),
    ("normativa", r"(?iU)\b(?:Legge|L\.)\s*(?:n\.?\s*)?\d+/\d{2,4}", 0, "reference"),
    ("normativa", r"(?iU)\bReg(?:olamento|\.)\s*(?:(?:delegato|di\s+esecuzione)\s+)?(?:\(?(?:UE|CE)\)?\s*)?(?:n\.?\s*)?\d{1,4}/\d{1,4}", 0, "reference"),
    ("normativa", r"(?iU)\bDirettiva\s*(?:[–-]\s*)?(?:\(?UE\)?\s*)?(?:n\.?\s*)?\d{1,4}/\d{1,4}(?:/(?:UE|CE))?", 0, "reference"),
    ("normativa", r"(?iU)\bDecisione\s*(?:di\s+esecuzione\s*)?(?:\((?:UE|PESC)\)\s*)?(?:n\.?\s*)?\d{4}/\d+(?:/(?:PESC|CE|UE))?", 0, "reference"),
    ("normativa", r"(?iU)\bDelibera(?:zione)?\s+(?:CONSOB|CICR|IVASS\s+)?(?:n\.?\s*\d+|\d{1,2}\s+[^\W\d_]+\s+\d{4})", 0, "reference"),
    ("normativa", r"(?iU)\bProvvedimento\s+(?:(?:della\s+|del\s+)?(?:Banca\s+d['’]Italia|IVASS|Garante|Consob)\s+)?n\.?\s*\d+", 0, "reference"),
    ("normativa", r"(?iU)\bCircolare\s*(?:Banca\s+d['’]Italia\s*)?(?:n\.?\s*)?\d+", 0, "reference"),
    ("normativa", r"(?iU)\b(?:EBA|ESMA|EIOPA)/(?:GL|RTS|ITS|REC)/\d{4}/\d{1,3}", 0, "reference"),
    ("normativa", r"(?iU)\bart(?:icolo|\.)?\s*\d+(?:-?(?:bis|ter|quater|quinquies))?(?:,?\s*paragrafo\s*\d+)?(?:,?\s*lett\.?\s*[a-z]\)?)?\s+(?:del\s+)?GDPR\b", 0, "reference"),
    ("normativa", r"(?iU)\bart(?:icolo|\.)?\s*\d+(?:-?(?:bis|ter|quater|quinquies))?(?:,?\s*comma\s*\d+(?:-?(?:bis|ter))?)?\s*(?:del|della)?\s*(?:TUB|TUF|TUC|TUIR|TULPS|T\.?U\.?[BFC]?|c\.?c\.?|cod(?:\.|ice)?\s*civ(?:\.|ile)?|cod(?:\.|ice)?\s*pen(?:\.|ale)?|codice\s+del\s+consumo|codice\s+delle\s+assicurazioni|D\.?\s?Lgs\.?\s*\d+/\d+)\b", 0, "reference"),
    ("codice fiscale", r"(?U)\b[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]\b", 0, "compact"),
    ("partita iva", r"(?iU)(?:partita\s+iva|p\.?\s*iva)[\s:.]*?(\d{11})", 1, "compact"),
]
NORMAL = {"lower": lambda c: F.lower(text.strip(c)), "compact": text.compact_upper, "money": text.strip_money, "reference": text.normalize_reference}


# What a text must have for a rule to match, each far cheaper to look for than the rule, by the place of the
# rule in RULES. Lower-case words have no letter that other letters are folded to (as i, k and s have).
_FRACTION, _DIGITS = r"\p{Nd}/\p{Nd}", r"\p{Nd}{11}"
_NEEDS = [
    ("has", "@"),
    ("has", "://", "www."),
    ("like", r"[A-Z]{2}\p{Nd}{2}[A-Z0-9]{11}"),
    ("like", r"[A-Z]{2}[A-Z0-9]{9}\p{Nd}"),
    ("has", "€", "eur"),
    ("has", "%"),
    ("like", r"\p{Nd}[/-]\p{Nd}"),
    ("like", _FRACTION),
    ("has", "decreto", "legge"),
    *[("like", _FRACTION)] * 4,
    ("has", "bera"),
    ("has", "provved"),
    ("has", "rcolare"),
    ("like", _FRACTION),
    ("has", "gdpr"),
    ("low", r"art[^\p{IsWhite_Space}\p{Nd}]{0,8}\p{IsWhite_Space}*\p{Nd}"),
    ("like", r"[A-Z]{6}\p{Nd}{2}[A-Z]\p{Nd}{2}[A-Z]\p{Nd}{3}[A-Z]"),
    ("like", _DIGITS),
]


def pattern_entities(c, kinds: list[str] | None = None) -> Column:
    """array<struct(name, type, normalized_name, score)> of all rules; matches may overlap.

    A rule is tried only on texts that have what it needs, which is looked for once for
    all rules that need the same.
    """
    asked = [(rule, need) for rule, need in zip(RULES, _NEEDS, strict=True) if kinds is None or rule[0] in kinds]
    needs = {need: f"n{i}" for i, need in enumerate(dict.fromkeys(need for _, need in asked))}
    none = F.array().cast("array<struct<name:string,type:string,normalized_name:string,score:double>>")

    def met(value, low, how, *what):
        if how == "has":
            return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in what])
        return (value if how == "like" else low).rlike(what[0])

    def of(value, kind, pattern, group, form):
        names = F.transform(F.regexp_extract_all(value, F.lit(pattern if group else f"({pattern})"), 1 if not group else group), text.collapse)
        return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("type"), NORMAL[form](n).alias("normalized_name"), F.lit(1.0).alias("score")))

    def judged(value):
        found = lambda low: F.struct(*[met(value, low, *need).alias(name) for need, name in needs.items()])
        return text.let(text.let(F.lower(value), found), lambda n: F.concat(*[F.when(n[needs[need]], of(value, *rule)).otherwise(none) for rule, need in asked]))

    return text.let(F.coalesce(text.col(c), F.lit("")), judged)


def dedupe_entities(rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, name, type, normalized_name, score, pos): the best of each type and normal form, the first of equals."""
    w = Window.partitionBy(key, "type", "normalized_name").orderBy(F.desc("score"), F.asc("pos"))
    kept = rows.filter(F.coalesce("normalized_name", F.lit("")) != "")
    return kept.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def extract_entities(chunks: DataFrame, column: str = "text", key: str = "chunk_id", kinds: list[str] | None = None) -> DataFrame:
    """One row for each entity of each chunk, by patterns alone."""
    rows = chunks.select(key, F.posexplode(pattern_entities(column, kinds)).alias("pos", "e")).select(key, "pos", "e.*")
    return dedupe_entities(rows, key).drop("pos")


def clean_model_entities(rows: DataFrame, most_chars: int = 80, most_words: int = 12) -> DataFrame:
    words = F.size(F.split(text.collapse("name"), " "))
    return rows.filter((F.length("name") <= most_chars) & (words <= most_words))


def clean_relations(rows: DataFrame, most_chars: int = 60, most_words: int = 8, other: str = "other") -> DataFrame:
    """Relations (head, head_type, rel_type, tail, tail_type, score) worth keeping: both
    ends named and short, not between two leftovers, not to itself."""
    ends = [(text.strip(c) != "") & (F.length(c) <= most_chars) & (F.size(F.split(text.collapse(c), " ")) <= most_words) for c in ("head", "tail")]
    apart = text.normalize_entity("head") != text.normalize_entity("tail")
    return rows.filter(reduce(lambda a, b: a & b, ends) & apart & ~((F.col("head_type") == other) & (F.col("tail_type") == other)))


# What a relation model's scores must reach.
ENTITY_SCORE, RELATION_SCORE, ADJACENCY_SCORE = 0.5, 0.45, 0.55


def scored_relations(rows: DataFrame, entity: float = ENTITY_SCORE, relation: float = RELATION_SCORE, adjacency: float = ADJACENCY_SCORE, most_chars: int = 60, most_words: int = 8, other: str = "other") -> DataFrame:
    """What a joint model's candidates leave: (chunk_id, head_type, head_norm, rel_type, tail_type, tail_norm, head, tail, score).

    rows: chunk_id, head, head_type, head_score, tail, tail_type, tail_score, adjacency,
    rel_type, score. Both ends, the link between them and its type must each reach their
    threshold; a null score reaches none. Ends are named, short, not both left over and not
    the same; of equal relations of a chunk the best score counts, with its names.
    """
    kept = (F.col("head_score") >= entity) & (F.col("tail_score") >= entity) & (F.col("adjacency") >= adjacency) & (F.col("score") >= relation)
    named = rows.filter(kept & (F.coalesce("rel_type", F.lit("")) != "")).withColumns({
        **{c: text.collapse(F.coalesce(c, F.lit(""))) for c in ("head", "tail")},
        **{f"{c}_type": F.when(F.coalesce(f"{c}_type", F.lit("")) == "", F.lit(other)).otherwise(F.col(f"{c}_type")) for c in ("head", "tail")},
    })
    short = [(F.length(c) <= most_chars) & (F.size(F.split(c, " ")) <= most_words) for c in ("head", "tail")]
    normal = named.withColumns({f"{c}_norm": text.normalize_entity(c) for c in ("head", "tail")})
    same = (F.col("head_type") == F.col("tail_type")) & (F.col("head_norm") == F.col("tail_norm"))
    left = normal.filter(reduce(lambda a, b: a & b, short) & (F.col("head_norm") != "") & (F.col("tail_norm") != "") & ~same & ~((F.col("head_type") == other) & (F.col("tail_type") == other)))
    key = ["chunk_id", "head_type", "head_norm", "rel_type", "tail_type", "tail_norm"]
    best = F.max(F.struct("score", "head", "tail")).alias("b")
    return left.groupBy(*key).agg(best).select(*key, "b.head", "b.tail", "b.score")


def token_span(tokens, part) -> Column:
    """(start, end) of the first place where ``part`` stands in ``tokens``, end included; null without one."""
    t, p = text.col(tokens), text.col(part)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(t) - F.size(p), F.lit(0))), lambda i: F.slice(t, i + 1, F.size(p)) == p)
    first = F.try_element_at(starts, F.lit(1))
    return F.when((F.size(p) > 0) & first.isNotNull(), F.struct(first.alias("start"), (first + F.size(p) - 1).alias("end")))


def word_tokens(c) -> Column:
    """Words and single punctuation marks, in order."""
    return F.regexp_extract_all(F.coalesce(text.col(c), F.lit("")), F.lit(r"(?U)(\w+(?:[-_]\w+)*|[^\s\w])"), 1)
