"""Entity extraction from question texts (X13), as Column expressions.

Batch version of the dashboard's question parser: every question row is
folded (accents, case) and matched against small fixed gazetteers with
``contains`` / ``rlike`` chains evaluated on the JVM.  Rules kept from the
reference: community = first dictionary key contained; province = longest
alias that appears as a whole word; crop = longest gazetteer entry contained;
years = ``20\\d{2}`` on the original text (default 2023); months in order of
appearance (default 1..12); ``cruza_anio`` when the first month is later than
the last and the years differ.  A row gets NULL context when it names no
place (or ranking) or no crop.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import CHAT_CCAA, CHAT_CROPS, CHAT_PROVINCE_CODE, CHAT_RANKING_WORDS, MONTHS
from ..functions.text import fold_accents
from ..session import spread

DEFAULT_YEAR = 2023


def _first_hit(conds: list[tuple[Column, Column]]) -> Column:
    out = None
    for cond, val in conds:
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out.otherwise(F.lit(None))


def _longest_hit(text: Column, keys: list[str], word: bool) -> Column:
    """The longest key found in ``text`` (ties: the earlier key of ``keys``).

    One alternation regex (keys longest first) finds every match in a single
    pass; the winner is the longest match.  This equals testing the keys one
    by one longest-first, which is how the reference decides, without one
    regex evaluation per key and row.
    """
    alt = "|".join(re.escape(k) for k in keys)
    pat = rf"\b({alt})\b" if word else f"({alt})"
    found = F.regexp_extract_all(text, F.lit(pat), 1)
    rank = F.create_map(*[x for i, k in enumerate(keys) for x in (F.lit(k), F.lit(i))])
    best = F.array_min(F.transform(found, lambda m: F.struct(rank[m].alias("r"), m.alias("k"))))
    return best["k"]


def extract_context(df: DataFrame, text_col: str, year_re: str = r"20\d{2}",
                    word_months: bool = False) -> DataFrame:
    """Adds ``ctx`` struct(cultivo, anio_ini, anio_fin, mes_ini, mes_fin, ccaa,
    provincia, cod_provincia, es_ranking, cruza_anio), NULL when incomplete.

    ``word_months=True`` matches month names as whole words (so "mayor" is not
    May, trap Q32); the default keeps the reference's substring search.
    """
    # Generate nodes (explode of one-element arrays) pin the folded text and
    # the result struct, so neither is recomputed for each of its uses
    df = spread(df).select("*", F.explode(F.array(fold_accents(text_col))).alias("_p"))
    p = F.col("_p")
    ccaa = _first_hit([(p.contains(k), F.lit(v)) for k, v in CHAT_CCAA.items()])
    provs = sorted(CHAT_PROVINCE_CODE, key=len, reverse=True)
    prov = _longest_hit(p, provs, word=True)
    codes = F.create_map(*[x for k in provs for x in (F.lit(k), F.lit(CHAT_PROVINCE_CODE[k]))])
    cod = codes[prov]
    ranking = F.lit(False)
    for w in CHAT_RANKING_WORDS:
        ranking = ranking | p.contains(w)
    geo = p.contains("provincia") | ccaa.isNotNull() | cod.isNotNull() | ranking
    crops = sorted(CHAT_CROPS, key=len, reverse=True)
    crop = F.upper(_longest_hit(p, crops, word=False))
    years = F.transform(F.regexp_extract_all(F.col(text_col), F.lit("(" + year_re + ")"), 1),
                        lambda y: y.cast("int"))
    a0 = F.coalesce(F.array_min(years), F.lit(DEFAULT_YEAR))
    a1 = F.coalesce(F.array_max(years), a0)
    if word_months:
        pos = [(F.when(p.rlike(r"\b" + m + r"\b"), F.locate(" " + m, F.concat(F.lit(" "), p))), n)
               for m, n in MONTHS.items()]
    else:
        pos = [(F.locate(m, p), n) for m, n in MONTHS.items()]
    found = F.array_sort(F.filter(F.array(*[F.struct(F.coalesce(ps, F.lit(0)).alias("pos"), F.lit(n).alias("mes"))
                                            for ps, n in pos]), lambda s: s["pos"] > 0))
    m0 = F.coalesce(F.try_element_at(found, F.lit(1))["mes"], F.lit(1))
    m1 = F.coalesce(F.try_element_at(found, F.lit(-1))["mes"], F.lit(12))
    ctx = F.struct(crop.alias("cultivo"), a0.alias("anio_ini"), a1.alias("anio_fin"), m0.alias("mes_ini"),
                   m1.alias("mes_fin"), ccaa.alias("ccaa"), prov.alias("provincia"), cod.alias("cod_provincia"),
                   ranking.alias("es_ranking"), ((m0 > m1) & (a0 < a1)).alias("cruza_anio"))
    return df.select("*", F.explode(F.array(F.when(geo & crop.isNotNull(), ctx))).alias("ctx")).drop("_p")
