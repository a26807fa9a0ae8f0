"""Rules for entities are tried only where they can match, and then match as before."""

from pyspark.sql import functions as F

from corpusforge.functions import text
from corpusforge.operators import entities

TEXTS = [
    None, "", "nothing here", "Mail A.b+c@d-e.it and É@ü.x.", "HTTPS://A.b/c?d=%20, httpſ://x.y www.a.it WWW.B.IT x@www.c.it", "IT60X0542811101000000123456 and IT٦٠X0542811101000000123456",
    "US0378331005 xUS0378331005 US037833100٥", "€ 1.234,56 - 12 EUR, Euro 7 and 1.000 eUrO", "5 % and 12,5% ١٢%", "1/2/2024 2024-01-02 3-4 ١/٢/٢٠٢٤", "D.Lgs. n. 231/2001 d.m. 4/99 Decreto Legıslatıvo 5/2001",
    "legge 7 agosto 1990, n. 241; DECRETO-LEGGE 3° marzo 2020", "L. 241/90, Legge n. 3/2001", "Reg. (UE) n. 575/2013 Regolamento delegato UE 1/2", "Direttiva 2014/65/UE DİRETTIVA – (UE) 1/2", "Decisione di esecuzione (PESC) 2020/12/PESC",
    "Delibera CONSOB n. 11971 DELİBERAZIONE n. 5 deliberazione 3 maggio 2001", "Provvedimento della Banca d'Italia n. 7 provvedımento n 8", "Circolare Banca d’Italia n. 285 CİRCOLARE 3", "EBA/GL/2020/06 eſma/rts/2021/1", "art. 6, paragrafo 1 lett. a) GDPR artıcolo 5 gdpr",
    "art. 106 TUB, ART 2043 c.c. artİcolo\u20035-bis, comma 2-ter del codice del consumo articolo\n7 D.Lgs. 5/6 part 3 tuf", "RSSMRA85T10A562S xRSSMRA85T10A562S", "partita iva: 12345678901 P.IVA 12345678901 p. ıva.12345678901 12345678901",
]


def plain(value, kinds=None):
    """Every rule on every text."""
    def of(kind, pattern, group, form):
        names = F.transform(F.regexp_extract_all(value, F.lit(pattern if group else f"({pattern})"), group or 1), text.collapse)
        return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("type"), entities.NORMAL[form](n).alias("normalized_name"), F.lit(1.0).alias("score")))

    return F.concat(*[of(*rule) for rule in entities.RULES if kinds is None or rule[0] in kinds])


def test_rules_match_where_they_are_tried(spark):
    rows = spark.createDataFrame([(t,) for t in [*TEXTS, " ".join(t or "" for t in TEXTS), *[t.lower() for t in TEXTS if t], *[t.upper() for t in TEXTS if t]]], "t string")
    value = F.coalesce("t", F.lit(""))
    for kinds in (None, ["normativa", "percentuale"]):
        got = rows.select(entities.pattern_entities("t", kinds).alias("got"), plain(value, kinds).alias("want")).collect()
        assert all(r.got == r.want for r in got) and {e.type for r in got for e in r.got} == set(kinds or [r[0] for r in entities.RULES])


def test_rules_are_not_tried_elsewhere(spark):
    found = spark.range(1).select(entities.pattern_entities(F.lit("x"))).schema[0].dataType
    assert found.elementType.names == ["name", "type", "normalized_name", "score"]
    plan = spark.createDataFrame([("x",)], "t string").select(entities.pattern_entities("t").alias("e"))._jdf.queryExecution().analyzed().toString()
    assert plan.lower().count("case when") == len(entities.RULES)
