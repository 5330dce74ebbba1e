"""Static reference dimensions.

These are fixed values the results depend on; they are small, bounded lists,
so turning them into DataFrames and broadcasting them is always safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Spanish month name -> month number.
MONTHS = {
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6,
    "julio": 7, "agosto": 8, "septiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
}

# Worksheets that never hold data.
SKIP_SHEETS = {"portada", "índice", "índice ", "resumen nacional", "Hoja_del_programa"}

# Province INE code -> autonomous community as written in the
# advance workbooks.  Codes not listed (Ceuta 51, Melilla 52) map to
# "DESCONOCIDA".
PROV_TO_CCAA = {
    15: "GALICIA", 27: "GALICIA", 32: "GALICIA", 36: "GALICIA",
    33: "P. DE ASTURIAS",
    39: "CANTABRIA",
    1: "PAIS VASCO", 20: "PAIS VASCO", 48: "PAIS VASCO",
    31: "NAVARRA",
    26: "LA RIOJA",
    22: "ARAGÓN", 44: "ARAGÓN", 50: "ARAGÓN",
    8: "CATALUÑA", 17: "CATALUÑA", 25: "CATALUÑA", 43: "CATALUÑA",
    7: "BALEARES",
    5: "CASTILLA Y LEÓN", 9: "CASTILLA Y LEÓN", 24: "CASTILLA Y LEÓN",
    34: "CASTILLA Y LEÓN", 37: "CASTILLA Y LEÓN", 40: "CASTILLA Y LEÓN",
    42: "CASTILLA Y LEÓN", 47: "CASTILLA Y LEÓN", 49: "CASTILLA Y LEÓN",
    28: "MADRID",
    2: "CASTILLA-MANCHA", 13: "CASTILLA-MANCHA", 16: "CASTILLA-MANCHA",
    19: "CASTILLA-MANCHA", 45: "CASTILLA-MANCHA",
    3: "C. VALENCIANA", 12: "C. VALENCIANA", 46: "C. VALENCIANA",
    30: "R. DE MURCIA",
    6: "EXTREMADURA", 10: "EXTREMADURA",
    4: "ANDALUCÍA", 11: "ANDALUCÍA", 14: "ANDALUCÍA", 18: "ANDALUCÍA",
    21: "ANDALUCÍA", 23: "ANDALUCÍA", 29: "ANDALUCÍA", 41: "ANDALUCÍA",
    35: "CANARIAS", 38: "CANARIAS",
}
UNKNOWN_CCAA = "DESCONOCIDA"

# Single-province communities (INE codes).
UNIPROV_CODES = {33, 39, 31, 26, 7, 28, 30}

# Multi-province community names as they appear in column 0.
CCAA_NAMES = {
    "GALICIA", "PAIS VASCO", "PAÍS VASCO", "ARAGÓN", "ARAGON",
    "CATALUÑA", "CASTILLA Y LEÓN", "CASTILLA Y LEON",
    "CASTILLA-MANCHA", "CASTILLA-LA MANCHA",
    "C. VALENCIANA", "COMUNIDAD VALENCIANA",
    "EXTREMADURA", "ANDALUCÍA", "ANDALUCIA", "CANARIAS",
}

# Weather-service province name -> INE code.
PROV_AEMET_TO_INE = {
    "A CORUÑA": 15, "CORUÑA, A": 15, "LUGO": 27, "OURENSE": 32, "PONTEVEDRA": 36,
    "ASTURIAS": 33, "CANTABRIA": 39,
    "ARABA/ÁLAVA": 1, "ÁLAVA": 1, "BIZKAIA": 48, "VIZCAYA": 48,
    "GIPUZKOA": 20, "GUIPÚZCOA": 20,
    "NAVARRA": 31, "LA RIOJA": 26,
    "HUESCA": 22, "TERUEL": 44, "ZARAGOZA": 50,
    "BARCELONA": 8, "GIRONA": 17, "LLEIDA": 25, "TARRAGONA": 43,
    "ILLES BALEARS": 7, "BALEARS, ILLES": 7,
    "ÁVILA": 5, "BURGOS": 9, "LEÓN": 24, "PALENCIA": 34, "SALAMANCA": 37,
    "SEGOVIA": 40, "SORIA": 42, "VALLADOLID": 47, "ZAMORA": 49,
    "MADRID": 28,
    "ALBACETE": 2, "CIUDAD REAL": 13, "CUENCA": 16, "GUADALAJARA": 19, "TOLEDO": 45,
    "ALICANTE": 3, "ALACANT": 3, "CASTELLÓN": 12, "CASTELLÓ": 12,
    "VALENCIA": 46, "VALÈNCIA": 46,
    "MURCIA": 30,
    "BADAJOZ": 6, "CÁCERES": 10,
    "ALMERÍA": 4, "CÁDIZ": 11, "CÓRDOBA": 14, "GRANADA": 18,
    "HUELVA": 21, "JAÉN": 23, "MÁLAGA": 29, "SEVILLA": 41,
    "LAS PALMAS": 35, "STA. CRUZ DE TENERIFE": 38, "SANTA CRUZ DE TENERIFE": 38,
    "CEUTA": 51, "MELILLA": 52,
}


def frame(spark: SparkSession, mapping: dict, key: str, value: str, key_type: str, value_type: str) -> DataFrame:
    """Small fixed mapping as a broadcast DataFrame."""
    rows = [(k, v) for k, v in mapping.items()]
    return F.broadcast(spark.createDataFrame(rows, f"{key} {key_type}, {value} {value_type}"))


def months_df(spark: SparkSession) -> DataFrame:
    return frame(spark, MONTHS, "mes_nombre", "mes", "string", "int")


def prov_ccaa_df(spark: SparkSession) -> DataFrame:
    return frame(spark, PROV_TO_CCAA, "cod", "ccaa_map", "int", "string")


def aemet_province_df(spark: SparkSession) -> DataFrame:
    return frame(spark, PROV_AEMET_TO_INE, "nombre", "cod", "string", "int")


def values_sql(mapping: dict, key: str, value: str) -> str:
    """Same mapping as an inline SQL VALUES table (for the DuckDB oracle)."""
    def lit(v):
        return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    rows = ", ".join(f"({lit(k)}, {lit(v)})" for k, v in mapping.items())
    return f"(SELECT * FROM (VALUES {rows}) AS t({key}, {value}))"

# Question gazetteers of the dashboard chat (accent-folded keys).
# Community key -> stored community name; dictionary order matters (first hit).
CHAT_CCAA = {
    "andalucia":        "Andalucía",
    "aragon":           "Aragón",
    "asturias":         "Asturias",
    "baleares":         "Islas Baleares",
    "canarias":         "Canarias",
    "cantabria":        "Cantabria",
    "castilla la mancha": "Castilla-La Mancha",
    "castilla leon":    "Castilla y León",
    "cataluna":         "Cataluña",
    "extremadura":      "Extremadura",
    "galicia":          "Galicia",
    "madrid":           "Comunidad de Madrid",
    "murcia":           "Región de Murcia",
    "navarra":          "Navarra",
    "pais vasco":       "País Vasco",
    "euskadi":          "País Vasco",
    "rioja":            "La Rioja",
    "valencia":         "Comunitat Valenciana",
    "valenciana":       "Comunitat Valenciana",
}

# Folded province name / alias -> 2-digit INE code.
CHAT_PROVINCE_CODE = {
    "alava": "01", "araba": "01", "albacete": "02", "alicante": "03", "alacant": "03",
    "almeria": "04", "avila": "05", "badajoz": "06", "baleares": "07", "balears": "07",
    "barcelona": "08", "burgos": "09", "caceres": "10", "cadiz": "11", "castellon": "12",
    "ciudad real": "13", "cordoba": "14", "coruna": "15", "a coruna": "15", "cuenca": "16",
    "girona": "17", "granada": "18", "guadalajara": "19", "guipuzcoa": "20", "gipuzkoa": "20",
    "huelva": "21", "huesca": "22", "jaen": "23", "leon": "24", "lleida": "25", "lerida": "25",
    "rioja": "26", "la rioja": "26", "lugo": "27", "madrid": "28", "malaga": "29", "murcia": "30",
    "navarra": "31", "ourense": "32", "orense": "32", "asturias": "33", "palencia": "34",
    "palmas": "35", "las palmas": "35", "pontevedra": "36", "salamanca": "37", "tenerife": "38",
    "cantabria": "39", "segovia": "40", "sevilla": "41", "soria": "42", "tarragona": "43",
    "teruel": "44", "toledo": "45", "valencia": "46", "valladolid": "47", "vizcaya": "48",
    "bizkaia": "48", "zamora": "49", "zaragoza": "50", "ceuta": "51", "melilla": "52",
}

# Words that make a question a ranking question.
CHAT_RANKING_WORDS = [
    "que provincia", "cual provincia", "mayor", "menor", "mas alto", "mas bajo",
    "maximo", "minimo", "ranking", "top", "lidera", "encabeza", "principales",
    "que comunidad", "cuales provincias", "que provincias",
]

# Crop gazetteer (matched longest first).
CHAT_CROPS = [
    "cereales de invierno", "cereal de invierno", "cereales", "cereal",
    "trigo blando", "trigo duro", "trigo", "cebada", "maiz", "girasol",
    "olivar", "aceituna", "vid", "vinedo", "arroz", "avena", "centeno",
    "colza", "algodon", "remolacha", "patata", "tomate", "pimiento",
    "lechuga", "naranja", "limon", "almendro", "algarrobo", "garbanzo",
    "lenteja", "guisante", "jijona", "nabo", "citricos", "citrico",
]
