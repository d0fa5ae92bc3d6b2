"""How a criterion is shown: citation, extracts, result cards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lengths and texts of the displayed form.
EXTRACT = 500
FULL_TEXT = 8000
PRECEDENTS = 2000
CUT_MARK = "... [truncado]"
TIMELINE_TITLE = 140
NO_EPOCH = "Sin época"


def _filled(c: Column) -> Column:
    """NULL for an empty text."""
    return F.nullif(c, F.lit(""))


def cite() -> Column:
    """Citation of a criterion; empty parts are left out, a year may stand alone."""
    year = F.when(F.col("anio") != 0, F.col("anio").cast("string"))
    date = F.coalesce(F.concat(_filled(F.col("mes")), F.lit(" de "), year), year)
    parts = [_filled(F.col(c)) for c in ("tipo_tesis", "tesis_codigo", "fuente", "epoca")]
    number = F.concat(F.lit("registro digital: "), _filled(F.col("id_tesis")))
    return F.concat(F.concat_ws(", ", *parts, date, number), F.lit("."))


def citation_block() -> Column:
    """Citation, title and issuing organ as one text."""
    organ = F.concat(F.lit(" — "), _filled(F.col("organo_juris")))
    return F.concat(
        F.lit("Cita oficial:\n  "), cite(),
        F.lit("\n\nRubro:\n  "), F.coalesce("rubro", F.lit("N/A")),
        F.lit("\n\nÓrgano emisor: "), F.coalesce("instancia", F.lit("N/A")),
        F.coalesce(organ, F.lit("")),
    )


def extract(c: Column) -> Column:
    return F.substring(c, 1, EXTRACT)


def cut(c: Column, length: int) -> Column:
    """The display form of a long text; the text itself stays whole in the corpus."""
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit(CUT_MARK))).otherwise(c)


def _line(label: str, c: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), F.coalesce(c.cast("string"), F.lit("N/A")))


def _optional(label: str, c: Column) -> Column:
    """NULL, and so no line, if there is nothing to show."""
    return F.concat(F.lit(label), _filled(c))


def render(full: bool) -> Column:
    """Numbered card of one result: `rank`, `nivel` and the corpus columns.

    Lists show the marked fragment, or else the extract; full reads show the
    body and the precedents.
    """
    head = F.concat(
        F.lit("--- Resultado "), F.col("rank").cast("string"),
        F.lit(" (Nivel "), F.col("nivel"), F.lit(") ---"),
    )
    lines = [
        head,
        _line("ID", F.col("id_tesis")),
        _line("Rubro", F.col("rubro")),
        _line("Codigo", F.col("tesis_codigo")),
        _line("Tipo", F.col("tipo_tesis")),
        _line("Instancia", F.col("instancia")),
        _optional("Organo: ", F.col("organo_juris")),
        _line("Epoca", F.col("epoca")),
        _line("Anio", F.col("anio")),
        _line("Materia", F.col("materias")),
        _optional("Fuente: ", F.col("fuente")),
    ]
    if full:
        lines.append(_optional("Texto completo:\n", cut(F.col("texto"), FULL_TEXT)))
        lines.append(_optional("Precedentes: ", cut(F.col("precedentes"), PRECEDENTS)))
    else:
        lines.append(
            F.coalesce(
                _optional("Fragmento relevante: ", F.col("fragmento")),
                _optional("Extracto: ", F.col("extracto")),
            )
        )
    return F.concat_ws("\n", *lines)
