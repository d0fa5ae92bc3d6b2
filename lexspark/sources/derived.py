"""The corpus derived from the `documents` table of the test data.

No table there carries court metadata, so one deterministic select makes it up
from the document id; titles and bodies are the documents' own whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Runs as it stands in Spark ({S} = string) and in the check engine ({S} = varchar).
TESIS_SELECT = """
select cast(doc_id as {S}) as id_tesis,
  split_part(text, chr(10), 1) as rubro,
  case when 1995 + doc_id % 31 <= 2010 then 'Novena Época'
       when 1995 + doc_id % 31 <= 2020 then 'Décima Época'
       when 1995 + doc_id % 31 <= 2023 then 'Undécima Época' else 'Duodécima Época' end as epoca,
  case when doc_id % 8 <= 3 then 'Suprema Corte de Justicia de la Nación'
       when doc_id % 8 = 4 then 'Plenos Regionales'
       when doc_id % 8 = 5 then 'Plenos de Circuito'
       else 'Tribunales Colegiados de Circuito' end as instancia,
  case doc_id % 8 when 0 then 'Pleno' when 1 then 'Primera Sala'
       when 2 then 'Segunda Sala' when 3 then 'Segunda Sala'
       when 4 then 'Pleno Regional en Materia Civil de la Región Centro-Sur'
       when 5 then 'Pleno del Decimoséptimo Circuito'
       when 6 then 'Primer Tribunal Colegiado del Décimo Séptimo Circuito'
       else 'Segundo Tribunal Colegiado del Primer Circuito' end as organo_juris,
  source as fuente,
  case when doc_id % 3 = 0 then 'Jurisprudencia' else 'Tesis Aislada' end as tipo_tesis,
  cast(1995 + doc_id % 31 as int) as anio,
  split_part('enero,febrero,marzo,abril,mayo,junio,julio,agosto,septiembre,octubre,noviembre,diciembre',
             ',', cast(1 + doc_id % 12 as int)) as mes,
  case lang when 'es' then 'Civil' when 'fr' then 'Constitucional, Civil'
            when 'de' then 'Penal' else 'Común' end as materias,
  'T. ' || cast(doc_id as {S}) || '/' || cast(1995 + doc_id % 31 as {S}) as tesis_codigo,
  md5(text) as huella_digital,
  text as texto,
  case when doc_id % 7 = 0 then 'Contradicción de tesis ' || cast(doc_id as {S}) else '' end as precedentes,
  timestamp '2026-01-01 00:00:00' + {MINUTES} as fecha_descarga
from {DOCUMENTS}
"""


def derived_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        TESIS_SELECT.format(
            S="string",
            MINUTES="make_interval(0, 0, 0, 0, 0, cast(doc_id as int))",
            DOCUMENTS=f"parquet.`{sf_dir}/documents.parquet`",
        )
    )
