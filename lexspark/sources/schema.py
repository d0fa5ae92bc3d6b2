"""Fixed schemas: the corpus, upstream replies, the query table."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()

TESIS = T.StructType(
    [T.StructField("id_tesis", _S, False)]
    + [
        T.StructField(name, kind)
        for name, kind in [
            ("rubro", _S), ("epoca", _S), ("instancia", _S), ("organo_juris", _S),
            ("fuente", _S), ("tipo_tesis", _S), ("anio", T.IntegerType()), ("mes", _S),
            ("materias", _S), ("tesis_codigo", _S), ("huella_digital", _S), ("texto", _S),
            ("precedentes", _S), ("fecha_descarga", T.TimestampType()),
        ]
    ]
)

# Upstream field -> corpus column. `materias` may be a list or a string, so
# every field is read as text and typed afterwards.
UPSTREAM = {
    "idTesis": "id_tesis", "rubro": "rubro", "epoca": "epoca", "instancia": "instancia",
    "organoJuris": "organo_juris", "fuente": "fuente", "tipoTesis": "tipo_tesis",
    "anio": "anio", "mes": "mes", "materias": "materias", "tesis": "tesis_codigo",
    "huellaDigital": "huella_digital", "texto": "texto", "precedentes": "precedentes",
}
CORRUPT = "_corrupt_record"
REPLY = T.StructType([T.StructField(name, _S) for name in UPSTREAM] + [T.StructField(CORRUPT, _S)])

# Keys under which a page object may hold its list of ids; the first wins.
PAGE_KEYS = ("data", "ids", "resultados", "results", "items")

# One row per landed reply: which id was asked for and what came back.
LANDED = T.StructType([T.StructField("requested_id", _S), T.StructField("payload", _S)])

# One row per query. Every column but the first two may be left out.
QUERY = T.StructType(
    [
        T.StructField("query_id", _S),
        T.StructField("concepts", T.ArrayType(T.ArrayType(_S))),
        T.StructField("buscar_en", _S),
        T.StructField("distancia", T.IntegerType()),
        T.StructField("solo_jurisprudencia", T.BooleanType()),
        T.StructField("materia", _S),
        T.StructField("instancia", _S),
        T.StructField("organo", _S),
        T.StructField("anio_minimo", T.IntegerType()),
        T.StructField("anio_maximo", T.IntegerType()),
        T.StructField("epocas", T.ArrayType(_S)),
        T.StructField("circuito", T.IntegerType()),
        T.StructField("excluir", _S),
        T.StructField("orden", _S),
        T.StructField("limite", T.IntegerType()),
    ]
)
