"""Hand rows for levels, epochs and circuits."""

import pytest
from pyspark.sql import functions as F

from lexspark.functions import court
from lexspark.operators import filters as flt
from lexspark.operators.filters import Filters

SUPREME = "Suprema Corte de Justicia de la Nación"
LEVELS = [
    ("Jurisprudencia", SUPREME, "Pleno", "S", 0),
    ("Jurisprudencia", SUPREME, "Primera Sala", "A", 1),
    ("Jurisprudencia", SUPREME, "Segunda Sala", "A", 1),
    ("Jurisprudencia", "Plenos Regionales", "Pleno Regional en Materia Civil de la Región Centro-Sur", "B", 2),
    ("Jurisprudencia", "Plenos de Circuito", "Pleno del Decimoséptimo Circuito", "C", 3),
    ("Jurisprudencia", "Tribunales Colegiados de Circuito", "Primer Tribunal Colegiado del Decimoséptimo Circuito", "D", 4),
    ("Aislada", SUPREME, "Primera Sala", "E", 1),
    ("Aislada", "Tribunales Colegiados de Circuito", "Primer Tribunal Colegiado", "F", 4),
    ("Jurisprudencia", "Otra", None, "D", 5),
    (None, None, None, "F", 5),
]


def test_levels_and_buckets(spark):
    rows = spark.createDataFrame(LEVELS, "t string, i string, o string, level string, bucket int")
    args = F.col("t"), F.col("i"), F.col("o")
    bad = rows.filter(
        (court.binding_level(*args) != F.col("level"))
        | (court.binding_bucket(*args[1:]) != F.col("bucket"))
    )
    assert bad.collect() == []


EPOCHS = {
    "Décima Época": ["decima", "Decima", "Décima", "DECIMA", "decima epoca", "Décima Época", "DÉCIMA ÉPOCA", "10", "X"],
    "Undécima Época": ["undecima", "Undécima", "11"],
    "Duodécima Época": ["duodecima", "12"],
    "Novena Época": ["novena", "9", "ix"],
    None: ["", "xyz", None],
}


def test_epochs(spark):
    rows = [(s, name) for name, spellings in EPOCHS.items() for s in spellings]
    df = spark.createDataFrame(rows, "s string, want string").withColumn("got", court.normalize_epoch(F.col("s")))
    assert [r for r in df.collect() if r.got != r.want] == []


CIRCUITS = {
    17: ["17", "XVII", "xvii", "decimo septimo", "Décimo Séptimo", "decimoséptimo"],
    4: ["4", "IV", "cuarto"], 10: ["decimo"], 18: ["decimo octavo", "decimoctavo"],
    22: ["vigesimo segundo"], 1: ["primer", "primero"], 32: ["xxxii", "trigésimo segundo"],
    30: ["trigesimo quinto"],
    None: [None, "", "0", "33", "abc", "circuito 5", "999", "-1", "true"],
}


def test_circuits(spark):
    rows = [(s, n) for n, spellings in CIRCUITS.items() for s in spellings]
    df = spark.createDataFrame(rows, "s string, want int").withColumn("got", court.parse_circuit(F.col("s")))
    assert [r for r in df.collect() if r.got != r.want] == []


def test_circuit_argument(spark):
    from lexspark.plans.search import parse_circuit

    assert parse_circuit(spark, 17) == 17
    for bad in (None, True, 0, 33, -1, "abc"):
        with pytest.raises(ValueError):
            parse_circuit(spark, bad)


COURTS = [
    ("Pleno del Decimoséptimo Circuito", 17),
    ("Primer Tribunal Colegiado del Décimo Séptimo Circuito", 17),
    ("Segundo Tribunal Colegiado del Primer Circuito", 1),
    ("Pleno en Materia Civil del XVII Circuito", 17),
    ("Tribunal Colegiado del VII. Circuito", 7),
    ("Tercer Tribunal Colegiado del Vigésimo Primer Circuito", 21),
    ("Segunda Sala", None), (None, None),
]


def test_circuit_of_court(spark):
    df = spark.createDataFrame(COURTS, "o string, want int").withColumn("got", court.circuit_of_court(F.col("o")))
    assert [r for r in df.collect() if r.got != r.want] == []


def test_presets_do_not_overlap(lib):
    ids = {p: {r[0] for r in flt.apply_filters(lib.corpus, Filters(instancia=p)).select("id_tesis").collect()}
           for p in court.PRESETS}
    assert not ids["pleno_scjn"] & ids["salas_scjn"]
    assert ids["primera_sala"] | ids["segunda_sala"] == ids["salas_scjn"]
    assert ids["pleno_scjn"] | ids["salas_scjn"] == ids["scjn"]
    assert all(ids.values())


def test_bad_filters(lib):
    with pytest.raises(ValueError):
        flt.apply_filters(lib.corpus, Filters(instancia="no such"))
    with pytest.raises(ValueError):
        flt.apply_filters(lib.corpus, Filters(epocas=("xyz",)))


def test_epoch_spellings_give_the_same(lib):
    def ids(*epochs):
        return sorted(r[0] for r in flt.apply_filters(lib.corpus, Filters(epocas=epochs)).select("id_tesis").collect())

    assert ids("Décima") == ids("10") == ids("decima epoca") == ids("xyz", "x") != []
