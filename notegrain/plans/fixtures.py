"""Inputs of the registered queries, made from the driver's tables by SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOTES = r"""
select o_orderkey as doc_id, 'note' || cast(o_orderkey as string) || '.txt' as file_name,
  case when o_orderkey % 2 = 0 then 'E2E' else 'T2E' end as strategy,
  case o_orderkey % 12
    when 0 then 'Paciente con PSA  4,5 ng/mL y Gleason 3+4=7. Control ' || cast(o_custkey as string)
    when 1 then 'PSA: 4.500 ng/ml;' || chr(9) || ' score de gleason 7 (3+4)' || chr(13) || chr(10) || 'edad ' || cast(o_custkey % 90 as string)
    when 2 then '  PSA 1.234,5 ng/mL previo, 1,234.5 ng/L actual. Gleason (4+3)'
    when 3 then 'Valor 1 234 ng/mL' || chr(10) || chr(10) || chr(10) || chr(10) || 'Gleason VII'
    when 4 then 'PSA ' || cast(o_custkey % 50 as string) || ',' || cast(o_orderkey % 10 as string) || ' ng/L y luego 12 ng / mL. Gleason score 7'
    when 5 then 'Sin unidad: 7 ng/dL. Gleason, no valorable'
    when 6 then 'escala de gleason: 4/5 = 9; PSA 0,0' || cast(o_orderkey % 7 as string) || ' ng mL'
    when 7 then 'Gleason = 8 [4+4] y Gleason 3+3 -> 6. PSA 100ngmL'
    when 8 then ''
    when 9 then 'Gleason 11. PSA 12.345 ng/L. ' || cast(o_custkey as string) || ' ng/mL'
    when 10 then 'GLEASON 5 + 4 PSA 2020 345 ng/mL'
    else 'Nota sin hallazgos ' || cast(o_custkey as string) end as text
from orders
"""

TAGGED = r"""
select o_orderkey as doc_id,
  case o_orderkey % 8
    when 0 then 'Dolor <SINTOMA>fuerte ' || cast(o_custkey as string) || '</SINTOMA> ayer'
    when 1 then '<Negated><Neg_cue>no</Neg_cue> fiebre</Negated> &amp; tos'
    when 2 then '<A>uno <B>dos</A> tres</B> &lt;x&gt;'
    when 3 then '<A>uno <A>dos</A> tres</A></A> fin'
    when 4 then 'abierto <PSA>4 ng ' || cast(o_custkey % 10 as string)
    when 5 then 'vacio <A></A> y < 5 con <Date>2020</Date>'
    when 6 then '</B>cierra <B>bien</B> a&amp;lt;b'
    else 'texto ' || cast(o_custkey as string) end as tagged
from orders
"""

SILVER = r"""
select 'f' || cast(l_orderkey as string) as file_name, 'T' || cast(l_linenumber as string) as entity_id,
  case l_returnflag when 'A' then 'ENFERMEDAD' when 'N' then 'SINTOMA' else 'PSA' end as label,
  cast(l_partkey % 40 as int) as start, cast(l_partkey % 40 + 1 + l_suppkey % 9 as int) as "end",
  'Texto ' || cast(l_partkey % 40 as string) as text, cast(l_linenumber as bigint) as arrival
from lineitem where l_orderkey % 23 <> 0
"""

#: Files of both folders: some are in one only, some (orders that 23 divides, in the one, or 29, in the other) are empty.
SILVER_FILES = r"select 'f' || cast(o_orderkey as string) as file_name from orders where o_orderkey % 17 <> 0"
PREDICTED_FILES = r"select 'f' || cast(o_orderkey as string) as file_name from orders where o_orderkey % 19 <> 0"

TAG_TEXTS = r"select 'f' || cast(o_orderkey as string) as doc_id, 'Uno < dos & tres > cuatro, ' || cast(o_custkey as string) || ' y seis' as text from orders"

TAG_SPANS = r"""
select 'f' || cast(l_orderkey as string) as doc_id,
  case l_suppkey % 7 when 0 then 'Negated' when 1 then 'Neg_cue' when 2 then '1 dosis' when 3 then 'a--o__b' when 4 then 'Spec_cue' when 5 then '??' else 'PSA' end as label,
  cast(l_partkey % 40 as int) as start, cast(l_partkey % 40 + 1 + l_suppkey % 9 as int) as "end"
from lineitem
"""

PREDICTED = r"""
select file_name, entity_id, case when k = 3 then 'Date' else label end as label,
  cast(case when k = 2 then start + 1 else start end as int) as start, cast(case when k = 1 then "end" + 2 when k = 2 then "end" + 0 else "end" end as int) as "end", text, arrival
from (select s.*, arrival % 6 as k from silver s where cast(substr(file_name, 2) as bigint) % 29 <> 0 and arrival % 6 <> 4 and not (arrival % 6 = 2 and "end" <= start + 1)) d
union all
select file_name, entity_id || 'b', label, start, "end", text || ' ', arrival + 100 from silver where arrival % 6 = 5 and cast(substr(file_name, 2) as bigint) % 29 <> 0
"""

TOKENS = r"""
select doc_id, model, window_id, idx,
  cast(case when l_partkey % 11 = 0 then 0 else idx * 6 - 6 end as int) as st,
  cast(case when l_partkey % 11 = 0 then 0 when l_partkey % 13 = 0 then idx * 6 - 6 else idx * 6 - l_partkey % 3 end as int) as en,
  case l_suppkey % 5 when 0 then 'O' when 1 then 'B-DIS' when 2 then 'I-DIS' when 3 then 'I-SYM' else 'DIS' end as label,
  cast(50 + l_partkey % 50 as double) / 128 as score
from (select cast(l_orderkey as bigint) as doc_id, 'm' || cast(l_suppkey % 2 as string) as model, cast(l_linenumber % 2 as int) as window_id, l_partkey, l_suppkey,
  cast(row_number() over (partition by l_orderkey, l_suppkey % 2, l_linenumber % 2 order by l_linenumber, l_partkey, l_suppkey) as int) as idx from lineitem) q
"""

TOKEN_TEXTS = r"select o_orderkey as doc_id, 'abcd, efgh. ijkl- mnop uvwx. abcd, efgh. ijkl- mnop' as text from orders"

ANSWERS = r"""
select cast(conv_id as string) || '-' || cast(turn as string) || '.txt' as file_name, case when conv_id % 9 = 0 then '  ' else text end as "case",
  case (conv_id + turn) % 6
    when 0 then 'x ---INICIO--- ' || text || ' ---FIN--- y'
    when 1 then '<THINK>plan</think>' || text
    when 2 then '<think>---INICIO---a</think>---INICIO--- nota ---FIN---'
    when 3 then 'corto'
    when 4 then text || text || 'relleno relleno relleno relleno relleno relleno relleno relleno relleno'
    else '' end as content,
  case when turn % 2 = 0 then 'pienso ---INICIO---' || text || '---FIN---' else '' end as thinking,
  conv_id % 7 = 0 as "exists"
from conversations
"""

_SCORE_KEYS = ("actualizada_temporalmente_correcta", "precisa", "exhaustiva", "util", "organizada", "comprensible", "concisa", "sintetizada", "consistencia_interna")
_BODY = " || ".join(f"""'"{k}": {{"score": ' || cast(1 + (doc_id + {i}) % 5 as string) || ', "justification": " por {i} "}}, '""" for i, k in enumerate(_SCORE_KEYS))
JUDGED = rf"""
select case when doc_id % 3 = 0 then 'E2E' else 'T2E' end as strategy, 'n' || cast(doc_id % 50 as string) || case when doc_id % 10 = 0 then '_LOG.txt' else '.txt' end as file_name,
  'd/' || cast(doc_id as string) || '.txt' as relative_path,
  case doc_id % 7
    when 1 then 'Claro: {{' || {_BODY} || '"error_seguridad_grave": "si"}} fin'
    when 2 then 'no es json'
    when 3 then '[1, 2]'
    when 4 then '<think>uf</think>{{"precisa": {{"score": 9}}, "util": {{"score": 4, "justification": 7}}, "human_generated": 1}}'
    when 5 then '{{"precisa": {{"score": 4.7, "justification": "a"}}, "util": {{"score": "3", "justification": " b "}}, "concisa": {{"score": true}}, "organizada": {{"score": "4.7"}}, "exhaustiva": {{"score": 5, "justification": "c"}}, "comprensible": {{"score": null}}, "sintetizada": {{"score": 0}}, "human_generated": "maybe", "error_seguridad_grave": " SÍ ", "contradicciones_clinicas_insalvables": 0.0}}'
    else '{{' || {_BODY} || '"error_seguridad_grave": false, "human_generated": true}}' end as raw_text
from labels where doc_id is not null
"""

FILE_BYTES = r"""
select doc_id, case doc_id % 5 when 0 then 'ma' || chr(241) || 'ana' when 1 then 'a' || chr(13) || chr(10) || 'b' || chr(13) || 'c' when 2 then '' when 3 then 'PSA ' || cast(doc_id as string) else 'x' || chr(10) end as text, doc_id % 10 >= 5 as latin
from labels where doc_id is not null
"""

FIXTURES = {
    "notes": NOTES, "tagged": TAGGED, "silver": SILVER, "predicted": PREDICTED, "silver_files": SILVER_FILES, "predicted_files": PREDICTED_FILES, "tag_texts": TAG_TEXTS, "tag_spans": TAG_SPANS,
    "tokens": TOKENS, "token_texts": TOKEN_TEXTS, "answers": ANSWERS, "judged": JUDGED, "file_bytes": FILE_BYTES,
}
_TABLES = {
    "notes": "orders", "tagged": "orders", "silver": "lineitem", "silver_files": "orders", "predicted_files": "orders", "tag_texts": "orders", "tag_spans": "lineitem",
    "tokens": "lineitem", "token_texts": "orders", "answers": "conversations", "judged": "labels", "file_bytes": "labels",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture's rows; the SQL reads a frame that is bound to it, so no view is left behind."""
    # braces and double quotes have another meaning here: what is bound, and strings
    sql = FIXTURES[name].replace("{", "{{").replace("}", "}}")
    sql = sql if name == "judged" else sql.replace('"', "`")
    if name == "predicted":
        silver = fixture(spark, sf_dir, "silver")
        return spark.sql(sql.replace("silver s ", "{silver} s ").replace("from silver ", "from {silver} "), silver=silver)
    source = spark.read.parquet(f"{sf_dir}/{_TABLES[name]}.parquet")
    if name in ("notes", "tagged"):  # one small file makes all the texts; real ones come in many
        source = source.repartition(spark.sparkContext.defaultParallelism)
    return spark.sql(sql.replace(f"from {_TABLES[name]}", "from {source}"), source=source)


def with_fixtures(names: tuple[str, ...], body: str) -> str:
    """DuckDB SQL with the fixtures as common table expressions."""
    return "with " + ", ".join(f"{n} as ({FIXTURES[n]})" for n in names) + body
