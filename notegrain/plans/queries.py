"""Registered queries of the clinical operators, and their oracles."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegrain.functions.numeric import best_class, softmax
from notegrain.functions.text import normalize_text, snippet, strip
from notegrain.operators import dedup, extraction, generation, inline_tags, judging, matching, mentions, services, standoff, tokens
from notegrain.plans.fixtures import fixture, with_fixtures
from notegrain.sources import files

SYSTEM, TEMPLATE = "Eres un urologo.", "Caso: {CASE_TEXT}"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str | None = None, fixtures: tuple[str, ...] = ()) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = with_fixtures(fixtures, oracle) if fixtures else oracle
        return f

    return add


def _norm(column: str) -> str:
    one = f"regexp_replace(replace(replace(replace(replace(coalesce({column}, ''), chr(0), ' '), chr(65279), ' '), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \\t]+', ' ', 'g')"
    return f"regexp_replace(regexp_replace({one}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@_query(f"select doc_id, {_norm('text')} as text from documents")
def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", normalize_text(F.col("text")).alias("text"))


#: The grammars of quantities and scores, in the oracle's dialect.
_NUMBER = r"(?:\d{1,3}(?:[.\s]\d{3})+|\d+)(?:[.,]\d+)?"
_UNIT = r"(?:ng\s*/\s*ml|ng\s*/\s*l|ng\s*ml|ng\s*l)"
_PSA = rf"({_NUMBER})\s*({_UNIT})\b"
_STARTS = "cast(coalesce(list_sum(list_transform(gaps[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: len(x))), 0) as integer)"
_SNIPPET = "trim(regexp_replace(substr(t, greatest(s - 35, 0) + 1, least(len(t), e + 35) - greatest(s - 35, 0)), '\\s+', ' ', 'g'))"
_PSA_ORACLE = rf"""
, t as (select doc_id, {_norm("text")} as t from notes),
m as (select doc_id, t, regexp_extract_all(t, '{_PSA}', 0, 'i') as ms, regexp_extract_all(t, '{_PSA}', 1, 'i') as vs, regexp_extract_all(t, '{_PSA}', 2, 'i') as us,
  string_split_regex(t, '(?i){_PSA}') as gaps from t),
x as (select *, unnest(range(1, len(ms) + 1)) as i from m),
y as (select doc_id, t, i, ms[i] as text, vs[i] as v, us[i] as u, {_STARTS} as s, {_STARTS} + len(ms[i]) as e from x),
z as (select *, replace(v, ' ', '') as c, case when contains(lower(u), 'm') then 'ng/mL' else 'ng/L' end as un from y),
n as (select *, try_cast(case when contains(c, ',') and contains(c, '.') then case when strpos(reverse(c), ',') < strpos(reverse(c), '.') then replace(replace(c, '.', ''), ',', '.') else replace(c, ',', '') end
  when contains(c, ',') then replace(c, ',', '.') else c end as double) as val from z)
"""


@_query(
    _PSA_ORACLE
    + f"select doc_id, cast(i as integer) as match_index, 'PSA' as label, v as value_raw, val as value_num, u as unit_raw, un as unit_norm, case when un = 'ng/mL' then val else val / 1000.0 end as value_ng_ml, cast(s as integer) as start, cast(e as integer) as \"end\", {_SNIPPET} as snippet, text from n",
    ("notes",),
)
def psa_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.psa_mentions(fixture(spark, sf_dir, "notes"))


@_query(_PSA_ORACLE + "select un as unit_norm, count(*) as mentions, count(val) as readable, max(val) as highest from n group by un", ("notes",))
def psa_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mentions.psa_mentions(fixture(spark, sf_dir, "notes"))
    return found.groupBy("unit_norm").agg(F.count("*").alias("mentions"), F.count("value_num").alias("readable"), F.max("value_num").alias("highest"))


#: Fixed values, as above.
_KEY = r"(?:\bgleason\b|puntuaci[oó]n\s+de\s+gleason|score\s+de\s+gleason|escala\s+de\s+gleason)(?:\s*[:=]?\s*)"
_TOT = r"(?:10|[2-9]|(?:X|IX|IV|V?I{0,3}))"
_GLEASON = {
    1: (rf"{_KEY}({_TOT})(?:\s*[\(\[\{{]\s*([1-5])\s*(?:\+|/)\s*([1-5])\s*[\)\]\}}])", (1, 2, 3)),
    2: (rf"{_KEY}([1-5])\s*(?:\+|/)\s*([1-5])(?:\s*(?:=|→|->)\s*({_TOT}))?", (3, 1, 2)),
    3: (rf"{_KEY}({_TOT})\b", (1, 0, 0)),
}
_NAMES = {1: "total_then_sum", 2: "sum_total", 3: "score_only"}


def _gleason_part(k: int) -> str:
    rx, groups = _GLEASON[k]
    columns = [f"coalesce(regexp_extract_all(t, '{rx}', {g}, 'i')[i], '')" if g else "''" for g in groups]
    return rf"""p{k} as (select doc_id, t, ms[i] as text, {_STARTS} as s, {_STARTS} + len(ms[i]) as e, {columns[0]} as tot, {columns[1]} as p1, {columns[2]} as p2, '{_NAMES[k]}' as kind
  from (select *, unnest(range(1, len(ms) + 1)) as i from (select doc_id, t, regexp_extract_all(t, '{rx}', 0, 'i') as ms, string_split_regex(t, '(?i){rx}') as gaps from t) a) b)"""


_FREE = "not exists (select 1 from {0} a where a.doc_id = b.doc_id and b.s < a.e and b.e > a.s)"
_GLEASON_ORACLE = (
    f", t as (select doc_id, {_norm('text')} as t from notes), {_gleason_part(1)}, {_gleason_part(2)}, {_gleason_part(3)}, "
    f"a2 as (select * from p1 union all select * from p2 b where {_FREE.format('p1')}), a3 as (select * from a2 union all select * from p3 b where {_FREE.format('a2')}), "
    "g as (select *, cast(row_number() over (partition by doc_id order by s, e) as integer) as k, try_cast(p1 as integer) as f, try_cast(p2 as integer) as h, "
    "case when regexp_full_match(trim(tot), '\\d+') then try_cast(tot as integer) else nullif(list_position(['I','II','III','IV','V','VI','VII','VIII','IX','X'], upper(trim(tot))), 0) end as n from a3) "
)


@_query(
    _GLEASON_ORACLE
    + f"select doc_id, k as match_index, 'GLEASON' as label, text as gleason_raw, kind as pattern_type, f as \"primary\", h as secondary, cast(coalesce(n, f + h) as integer) as total, cast(s as integer) as start, cast(e as integer) as \"end\", {_SNIPPET} as snippet, text from g",
    ("notes",),
)
def gleason_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.gleason_mentions(fixture(spark, sf_dir, "notes"))


@_query(_GLEASON_ORACLE + "select kind as pattern_type, count(*) as mentions, count(coalesce(n, f + h)) as with_total from g group by kind", ("notes",))
def gleason_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mentions.gleason_mentions(fixture(spark, sf_dir, "notes"))
    return found.groupBy("pattern_type").agg(F.count("*").alias("mentions"), F.count("total").alias("with_total"))


@_query(_GLEASON_ORACLE + "select t.doc_id, count(g.doc_id) as mentions from t left join g on t.doc_id = g.doc_id group by t.doc_id", ("notes",))
def mentions_per_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = fixture(spark, sf_dir, "notes")
    return mentions.per_note(notes, mentions.gleason_mentions(notes))


_UNESCAPE = "replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_TAGS = rf"""
, w as (select doc_id, tagged, regexp_extract_all(tagged, '<(/?)([A-Za-z0-9_:-]+)>', 0) as ms, regexp_extract_all(tagged, '<(/?)([A-Za-z0-9_:-]+)>', 2) as ls,
  list_transform(string_split_regex(tagged, '<(/?)([A-Za-z0-9_:-]+)>'), lambda x: {_UNESCAPE.format("x")}) as gaps from tagged),
ev as (select doc_id, i, ms[i][2] = '/' as cl, ls[i] as label, cast(list_sum(list_transform(gaps[1:i], lambda x: len(x))) as integer) as place from (select *, unnest(range(1, len(ms) + 1)) as i from w) q),
wk as (select *, sum(case when cl then -1 else 1 end) over (partition by doc_id, label order by i) as s from ev),
lw as (select *, least(0, coalesce(min(s) over (partition by doc_id, label order by i rows between unbounded preceding and 1 preceding), 0)) as low from wk),
dp as (select *, cl and s < low as un, s - least(low, s) + case when cl then 1 else 0 end as lev from lw),
pr as (select *, lag(place) over (partition by doc_id, label, un, lev order by i) as st, lead(i) over (partition by doc_id, label, un, lev order by i) as nx from dp),
plain as (select doc_id, array_to_string(gaps, '') as plain from w)
"""


@_query(_TAGS + 'select p.doc_id, label, st as start, place as "end", substr(plain, st + 1, place - st) as text from pr p join plain q on p.doc_id = q.doc_id where cl and not un and place > st', ("tagged",))
def untag_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inline_tags.spans(fixture(spark, sf_dir, "tagged"))


@_query(_TAGS + "select doc_id, plain from plain", ("tagged",))
def untag_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inline_tags.plain_text(fixture(spark, sf_dir, "tagged"))


@_query(
    _TAGS
    + "select w.doc_id, cast(len(w.tagged) - len(replace(w.tagged, '<', '')) - len(w.ms) as bigint) as malformed_tag_starts, coalesce(u, 0) as unmatched_closing_tags, coalesce(o, 0) as unclosed_open_tags from w left join (select doc_id, count(*) filter (un) as u, count(*) filter (not cl and nx is null) as o from pr group by doc_id) c on w.doc_id = c.doc_id",
    ("tagged",),
)
def untag_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inline_tags.stats(fixture(spark, sf_dir, "tagged"))


@_query("select page_id as doc_id, array_to_string(list_transform(string_split_regex(html, '<(/?)([A-Za-z0-9_:-]+)>'), lambda x: " + _UNESCAPE.format("x") + "), '') as plain from pages")
def untag_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return inline_tags.plain_text(pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("tagged")))


@_query(", q as (" + "select doc_id, true as same from tagged) select doc_id, same from q", ("tagged",))
def roundtrip_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading, writing and reading again gives the same plain text."""
    tagged = fixture(spark, sf_dir, "tagged")
    plain = inline_tags.plain_text(tagged)
    again = inline_tags.plain_text(inline_tags.tag(plain.withColumnRenamed("plain", "text"), inline_tags.spans(tagged)))
    return plain.join(again.withColumnRenamed("plain", "p2"), "doc_id").select("doc_id", (F.col("plain") == F.col("p2")).alias("same"))


_LINES = """, ln as (select file_name, cast(row_number() over (partition by file_name order by start, "end", label, text) as integer) as number, * exclude (file_name) from silver)
select file_name, number, 'T' || number::string || chr(9) || replace(label, ' ', '_') || ' ' || start::string || ' ' || "end"::string || chr(9) || text as line from ln"""


@_query(_LINES, ("silver",))
def ann_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standoff.ann_lines(fixture(spark, sf_dir, "silver"))


@_query(
    """, ln as (select file_name, label, start, "end", text, row_number() over (partition by file_name order by start, "end", label, text) as number from silver)
select file_name, 'T' || number::string as entity_id, label, start, "end", lower(text) as text from ln""",
    ("silver",),
)
def parse_ann_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standoff.parse_lines(standoff.ann_lines(fixture(spark, sf_dir, "silver")))


@_query(
    """select file_name, label, unnest([start, start + 20]) as start, unnest(["end", start + 25]) as "end" from silver""",
    ("silver",),
)
def parse_ann_discontinuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "silver")
    n = lambda c: c.cast("string")
    line = F.concat(F.lit("T1\t"), "label", F.lit(" "), n(F.col("start")), F.lit(" "), n(F.col("end")), F.lit(";"), n(F.col("start") + 20), F.lit(" "), n(F.col("start") + 25), F.lit("\t"), "text")
    return standoff.parse_spans(rows.select("file_name", line.alias("line")))


_SANITIZED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(label, '\s+', '_', 'g'), '[^A-Za-z0-9_:-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')"""
_ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@_query(
    f""", nm as (select *, case when {_SANITIZED} = '' then 'ENTIDAD' when {_SANITIZED} similar to '[0-9].*' then 'X_' || {_SANITIZED} else {_SANITIZED} end as n,
  case label when 'NORMALIZABLES' then 0 when 'Negated' then 1 when 'Speculated' then 2 when 'Spec_cue' then 3 when 'Neg_cue' then 4 else 100 end as pr from tag_spans),
ev as (select doc_id, "end" as place, 0 as kind, -start as far, pr, label, '</' || n || '>' as mark from nm union all select doc_id, start, 1, -"end", pr, label, '<' || n || '>' from nm),
od as (select e.*, x.text, row_number() over (partition by e.doc_id order by place, kind, far, pr, label) as o from ev e join tag_texts x on e.doc_id = x.doc_id where place <= len(x.text)),
pc as (select *, coalesce(lag(place) over (partition by doc_id order by o), 0) as before from od),
jn as (select doc_id, string_agg({_ESCAPED.format("substr(text, before + 1, place - before)")} || mark, '' order by o) as t, max(place) as upto from pc group by doc_id)
select x.doc_id, coalesce(t, '') || {_ESCAPED.format("substr(text, coalesce(upto, 0) + 1)")} as tagged from tag_texts x left join jn on x.doc_id = jn.doc_id""",
    ("tag_texts", "tag_spans"),
)
def tag_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inline_tags.tag(fixture(spark, sf_dir, "tag_texts"), fixture(spark, sf_dir, "tag_spans"))


_DEDUP = """, al as (select 0 as src, * from silver union all select 1 as src, * from predicted),
rk as (select *, row_number() over (partition by file_name, label, start, "end", trim(text) order by text, src, arrival) as k from al) """


@_query(_DEDUP + 'select f.file_name, label, start, "end", text from silver_files f left join rk on f.file_name = rk.file_name and k = 1', ("silver", "predicted", "silver_files"))
def merged_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, silver, predicted = (fixture(spark, sf_dir, n) for n in ("silver_files", "silver", "predicted"))
    return dedup.merged(files, [silver, predicted]).select("file_name", "label", "start", "end", "text")


@_query(
    """, rk as (select *, row_number() over (partition by file_name, label, start, "end", trim(text) order by text, arrival) as k from predicted) select file_name, label, start, "end", text from rk where k = 1""",
    ("silver", "predicted"),
)
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact(fixture(spark, sf_dir, "predicted"), "file_name").select("file_name", "label", "start", "end", "text")


#: Mentions folded one after another: x is a list of one mention; the first kept that shares a bound is h.
_FOLD = """, gr as (select file_name, label, list([{'s': start, 'e': "end", 't': text}] order by arrival, start, "end", text) as items from predicted group by file_name, label),
fd as (select file_name, label, list_reduce(items, lambda acc, x: case
    when len(list_filter(acc, lambda k: k.s = x[1].s or k.e = x[1].e)) = 0 then acc || x
    when x[1].e - x[1].s > list_filter(acc, lambda k: k.s = x[1].s or k.e = x[1].e)[1].e - list_filter(acc, lambda k: k.s = x[1].s or k.e = x[1].e)[1].s
      then list_filter(acc, lambda k: k <> list_filter(acc, lambda j: j.s = x[1].s or j.e = x[1].e)[1]) || x
    else acc end) as kept from gr)
select file_name, label, m.s as start, m.e as "end", m.t as text from (select file_name, label, unnest(kept) as m from fd) q"""


@_query(_FOLD, ("silver", "predicted"))
def dedup_span_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.by_span_and_label(fixture(spark, sf_dir, "predicted"), "file_name")


@_query(
    """select s.file_name, s.label, s.entity_id as silver_entity_id, s.start as silver_start, s."end" as silver_end, p.entity_id as pred_entity_id, p.start as pred_start, p."end" as pred_end,
cast(case when s.start = p.start and s."end" = p."end" then 0 when s.start = p.start then 1 else 2 end as integer) as priority, abs(s.start - p.start) + abs(s."end" - p."end") as span_distance
from silver s join predicted p on s.file_name = p.file_name and s.label = p.label and (s.start = p.start or s."end" = p."end")""",
    ("silver", "predicted"),
)
def match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.candidates(fixture(spark, sf_dir, "silver"), fixture(spark, sf_dir, "predicted"))


#: Rounds in which the oracle takes every candidate that is first for both of its sides; the greedy order comes to rest long before.
_ROUNDS = 8


def _greedy_oracle() -> str:
    """The greedy assignment by rounds over all candidates of a file, another way than the operator's three phases."""
    rank = "row_number() over (partition by file_name, label order by start, \"end\", text, entity_id)"
    parts = [
        "fl as (select file_name from silver_files intersect select file_name from predicted_files)",
        f"si as (select *, {rank} as i from silver where file_name in (select file_name from fl))",
        f"pj as (select *, {rank} as j from predicted where file_name in (select file_name from fl))",
        """ca as (select s.file_name, s.label, i, j, case when s.start = p.start and s."end" = p."end" then 0 when s.start = p.start then 1 else 2 end as pr,
  abs(s.start - p.start) + abs(s."end" - p."end") as d, abs((s."end" - s.start) - (p."end" - p.start)) as l
  from si s join pj p on s.file_name = p.file_name and s.label = p.label and (s.start = p.start or s."end" = p."end"))""",
        "c0 as materialized (select *, row_number() over (partition by file_name, label order by pr, d, l, i, j) as o from ca)",
    ]
    for k in range(1, _ROUNDS + 1):
        parts.append(f"t{k} as materialized (select * from c{k - 1} qualify o = min(o) over (partition by file_name, label, i) and o = min(o) over (partition by file_name, label, j))")
        parts.append(f"c{k} as materialized (select c.* from c{k - 1} c anti join t{k} t on c.file_name = t.file_name and c.label = t.label and c.i = t.i anti join t{k} u on c.file_name = u.file_name and c.label = u.label and c.j = u.j)")
    parts.append("tk as (" + " union all ".join(f"select file_name, label, i, j, pr from t{k}" for k in range(1, _ROUNDS + 1)) + ")")
    parts.append(
        """cm as (select coalesce(s.file_name, p.file_name) as file_name, coalesce(s.label, p.label) as label, case when s.i is null then 'FP' when p.j is null then 'FN' else 'TP' end as status,
  case when s.i is null then 'unmatched_pred' when p.j is null then 'unmatched_silver' when pr = 0 then 'exact' when pr = 1 then 'same_start' else 'same_end' end as match_type,
  s.entity_id as silver_entity_id, s.start as silver_start, s."end" as silver_end, s.text as silver_text, p.entity_id as pred_entity_id, p.start as pred_start, p."end" as pred_end, p.text as pred_text
  from si s left join tk on s.file_name = tk.file_name and s.label = tk.label and s.i = tk.i full join pj p on p.file_name = tk.file_name and p.label = tk.label and p.j = tk.j)"""
    )
    return ", " + ", ".join(parts) + " "


_COUNTS = "count(*) filter (status = 'TP') as tp, count(*) filter (status = 'FP') as fp, count(*) filter (status = 'FN') as fn"
_PRECISION, _RECALL = "coalesce(tp / nullif(tp + fp, 0)::double, 0)", "coalesce(tp / nullif(tp + fn, 0)::double, 0)"
_RATES = f"round({_PRECISION}, 9) as precision, round({_RECALL}, 9) as recall, round(coalesce(2 * {_PRECISION} * {_RECALL} / nullif({_PRECISION} + {_RECALL}, 0), 0), 9) as f1_score, round(coalesce(tp / nullif(tp + fp + fn, 0)::double, 0), 9) as accuracy"
_BOTH = ("silver", "predicted", "silver_files", "predicted_files")
_PER_FILE = _greedy_oracle() + f", ct as (select file_name, {_COUNTS} from cm group by file_name), pf as (select fl.file_name, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, coalesce(fn, 0) as fn from fl left join ct on fl.file_name = ct.file_name) "


def _compared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = matching.paired_files(fixture(spark, sf_dir, "silver_files"), fixture(spark, sf_dir, "predicted_files"))
    return matching.comparisons(fixture(spark, sf_dir, "silver"), fixture(spark, sf_dir, "predicted"), files), files


_SAME = "cast(status = 'TP' as integer) as same_label, " + ", ".join(f"coalesce(cast(silver_{c} = pred_{c} as integer), 0) as same_{c}" for c in ("start", "end", "text"))


@_query(_greedy_oracle() + f"select *, {_SAME} from cm", _BOTH)
def entity_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir)[0]


@_query(_PER_FILE + f"select file_name, tp + fn as silver_entities, tp + fp as pred_entities, tp, fp, fn, {_RATES} from pf", _BOTH)
def file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.file_metrics(*_compared(spark, sf_dir))


@_query(_greedy_oracle() + f"select label, tp, fp, fn, {_RATES} from (select label, {_COUNTS} from cm group by label) q", _BOTH)
def label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.label_metrics(_compared(spark, sf_dir)[0])


@_query(
    _PER_FILE
    + f"select evaluated_files, tp + fn as silver_entities, tp + fp as pred_entities, tp, fp, fn, {_RATES} from (select count(*) as evaluated_files, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn from pf) q",
    _BOTH,
)
def global_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.global_metrics(*_compared(spark, sf_dir))


@_query(
    _PER_FILE
    + f"""select 'file' as grain, file_name, null::varchar as label, tp, fp, fn, {_RATES} from pf
union all select 'label', null, label, tp, fp, fn, {_RATES} from (select label, {_COUNTS} from cm group by label) q
union all select 'global', null, null, tp, fp, fn, {_RATES} from (select {_COUNTS} from cm) q""",
    _BOTH,
)
def metrics_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.metrics_all_grains(*_compared(spark, sf_dir))


@_query(
    "select doc_id, cast(k as integer) as chunk, cast(k * 900 as integer) as start, cast(least(k * 900 + 1000, len(coalesce(text, ''))) as integer) as \"end\" from (select doc_id, text, unnest(range(0, cast(greatest(ceil((len(coalesce(text, '')) - 1000) / 900.0), 0) as bigint) + 1)) as k from documents) q"
)
def char_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.char_chunks(spark.read.parquet(f"{sf_dir}/documents.parquet"), 1000, 100)


def _bio_oracle(score: str) -> str:
    return rf""", r as (select t.*, x.text, t.st = 0 and t.en = 0 as sp from tokens t join token_texts x on t.doc_id = x.doc_id where (t.st = 0 and t.en = 0 and t.idx > 0) or (not (t.st = 0 and t.en = 0) and t.en > t.st)),
k as (select *, case when sp or label = 'O' then null when contains(label, '-') then split_part(label, '-', 2) else label end as kind from r),
l as (select *, lag(en) over w as pe, lag(kind) over w as pk from k window w as (partition by doc_id, model, window_id order by idx)),
g as (select *, case when kind = pk and (st <= pe or regexp_full_match(substr(text, pe + 1, st - pe), '[\s\-/,;:.()]+')) then 0 else 1 end as fresh from l),
i as (select *, sum(fresh) over (partition by doc_id, model, window_id order by idx) as isl from g),
a as (select doc_id, model, window_id, any_value(kind) as label, min(st) as start, max(en) as "end", {score}(score) as score, any_value(text) as text from i where kind is not null group by doc_id, model, window_id, isl)
select doc_id, model, window_id, label, start, "end", score, trim(regexp_replace(substr(text, start + 1, "end" - start), '\s+', ' ', 'g')) as text from a where score between 0.45 and 1.0 and trim(substr(text, start + 1, "end" - start)) <> ''"""


@_query(_bio_oracle("avg"), ("tokens", "token_texts"))
def bio_spans_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.bio_spans(fixture(spark, sf_dir, "tokens"), fixture(spark, sf_dir, "token_texts"), True, 0.45, 1.0)


@_query(_bio_oracle("min"), ("tokens", "token_texts"))
def bio_spans_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.bio_spans(fixture(spark, sf_dir, "tokens"), fixture(spark, sf_dir, "token_texts"), False, 0.45, 1.0)


#: Two dictionaries in the place of models; the second one's mentions count where the first has none of that span.
_WORDS = {"PSA": "B-TEST", "score": "B-TEST", "de": "I-TEST", "gleason": "B-TEST", "Gleason": "TEST", "Paciente": "B-WHO", "con": "O", "Valor": "B-TEST", "Control": "B-WHEN"}
_MORE_WORDS = {"PSA": "B-TEST", "edad": "B-WHEN", "previo": "B-WHEN", "actual": "B-WHEN", "Gleason": "B-SCORE"}


def _dictionary_part(model: str, words: dict[str, str]) -> str:
    kinds = " ".join(f"when '{w}' then '{k.split('-')[-1]}'" for w, k in words.items() if k != "O")
    return rf"""{model} as (select doc_id, t, i, ms[i] as w, case ms[i] {kinds} end as kind, {_STARTS} as s, {_STARTS} + len(ms[i]) as e, gaps[i] as gap
  from (select *, unnest(range(1, len(ms) + 1)) as i from (select doc_id, t, regexp_extract_all(t, '[A-Za-z]+') as ms, string_split_regex(t, '[A-Za-z]+') as gaps from t) a) b),
{model}_l as (select *, lag(kind) over (partition by doc_id order by i) as pk from {model}),
{model}_i as (select *, sum(case when kind = pk and regexp_full_match(gap, '[\s\-/,;:.()]+') then 0 else 1 end) over (partition by doc_id order by i) as isl from {model}_l),
{model}_s as (select doc_id, '{model}' as model, kind as label, min(s) as s, max(e) as e, any_value(t) as t from {model}_i where kind is not null group by doc_id, kind, isl)"""


@_query(
    f", t as (select doc_id, {_norm('text')} as t from notes), {_dictionary_part('one', _WORDS)}, {_dictionary_part('two', _MORE_WORDS)}, "
    "al as (select *, 1 as k from one_s union all select *, 2 from two_s), rk as (select *, row_number() over (partition by doc_id, label, s, e order by k) as n from al) "
    + r"""select doc_id, model, label, cast(s as integer) as start, cast(e as integer) as "end", 1.0::double as score, trim(regexp_replace(substr(t, s + 1, e - s), '\s+', ' ', 'g')) as text from rk where n = 1""",
    ("notes",),
)
def extract_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes through two token classifiers, end to end."""
    notes = fixture(spark, sf_dir, "notes")
    models = {"one": partial(services.DictionaryClassifier, _WORDS), "two": partial(services.DictionaryClassifier, _MORE_WORDS)}
    return extraction.extract(notes, extraction.Workflow(models, average=False))[0]


_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_CUT = "nullif(" + _STRIP.format("regexp_extract({0}, '---INICIO---\\s*(.*?)\\s*---FIN---', 1, 's')") + ", '')"
_THINK = _STRIP.format("regexp_replace(content, '<think>.*?</think>', '', 'gis')")


def _resolved(provider: str) -> str:
    steps = [(_CUT.format("content"), "delimited_content")]
    if provider == "claude":
        steps.append(("case when len(content) >= 80 then content end", "full_content"))
    else:
        steps += [(_CUT.format("st"), "delimited_content_stripped"), ("case when len(st) >= 80 then st end", "full_content_stripped")]
    if provider == "ollama":
        steps.append((_CUT.format("thinking"), "delimited_thinking"))
    note = "coalesce(" + ", ".join(s for s, _ in steps) + ", '')"
    name = "case " + " ".join(f"when {s} is not null then '{n}'" for s, n in steps) + " else 'no_output' end"
    return f", b as (select *, {_THINK} as st from answers) select file_name, {note} as note, {name} as strategy from b"


def _resolve(spark: SparkSession, sf_dir: str, provider: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "answers")
    return rows.select("file_name", generation.resolve_note(F.col("content"), F.col("thinking"), provider).alias("n")).select("file_name", "n.note", "n.strategy")


@_query(_resolved("openai"), ("answers",))
def resolve_notes_openai(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolve(spark, sf_dir, "openai")


@_query(_resolved("claude"), ("answers",))
def resolve_notes_claude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolve(spark, sf_dir, "claude")


@_query(_resolved("ollama"), ("answers",))
def resolve_notes_ollama(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolve(spark, sf_dir, "ollama")


@_query(f"""select file_name, sha1("case" || '{SYSTEM}' || '{TEMPLATE}') as with_template, sha1("case" || '{SYSTEM}') as without_template from answers""", ("answers",))
def prompt_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = [generation.prompt_hash(F.col("case"), SYSTEM, TEMPLATE, p).alias(n) for p, n in (("openai", "with_template"), ("ollama", "without_template"))]
    return fixture(spark, sf_dir, "answers").select("file_name", *hashes)


_LOG = _resolved("openai").replace(" select file_name,", ", rs as (select file_name, \"case\" as c, \"exists\" as ex,") + f"""), lg as (select file_name, {_STRIP.format("c")} as c, ex, note from rs),
st as (select *, case when c = '' then 'empty_input' when ex then 'skipped_existing' when note = '' then 'empty_output' else 'ok' end as status from lg) """


@_query(
    _LOG
    + f"select file_name, status, cast(len(c) as integer) as input_chars, cast(case when status = 'ok' then len(note) else 0 end as integer) as output_chars, case when status in ('ok', 'empty_output') then sha1(c || '{SYSTEM}' || '{TEMPLATE}') end as prompt_hash, case when status = 'ok' then sha1(note) end as response_hash from st",
    ("answers",),
)
def generation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generation.run_log(fixture(spark, sf_dir, "answers"), SYSTEM, TEMPLATE)


@_query(
    _LOG
    + f"""select 'in/' || file_name as input_path, 'out/' || file_name as output_path, status, case when status in ('ok', 'empty_output', 'skipped_existing') then '' else 'none' end as error, 0.25::double as latency_s,
  cast(len(c) as integer) as input_chars, cast(case when status = 'ok' then len(note) else 0 end as integer) as output_chars, 'm' as model, case when status in ('ok', 'empty_output') then sha1(c || '{SYSTEM}' || '{TEMPLATE}') else '' end as prompt_hash,
  case when status = 'ok' then sha1(note) else '' end as response_hash from st""",
    ("answers",),
)
def generation_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's log in all its columns, from answers that came."""
    rows = fixture(spark, sf_dir, "answers").withColumn("case", strip(F.col("case")))
    status = F.when(F.col("case") == "", "empty_input").when(F.col("exists"), "skipped_existing").otherwise("ok")
    error = F.when(status == "empty_input", "none")
    shown = rows.select(F.concat(F.lit("in/"), "file_name").alias("input_path"), F.concat(F.lit("out/"), "file_name").alias("output_path"), "case", "content", "thinking", status.alias("status"), error.alias("error"), F.lit(0.25).alias("latency_s"), F.lit(None).cast("string").alias("raw"))
    return generation.results(shown, "m", SYSTEM, TEMPLATE).drop("note", "raw")


@_query(_LOG + "select status, count(*) as notes from st group by status", ("answers",))
def generation_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generation.run_log(fixture(spark, sf_dir, "answers"), SYSTEM, TEMPLATE).groupBy("status").agg(F.count("*").alias("notes"))


_JUDGED = (
    ", pl as (select strategy, file_name, relative_path, trim(regexp_replace(raw_text, '<think>.*?</think>', '', 'gs')) as t from judged), "
    "js as (select strategy, file_name, relative_path, try_cast(case when json_valid(t) then t else regexp_extract(t, '\\{.*\\}', 0, 's') end as json) as v from pl) "
)


def _whole(value: str, kind: str) -> str:
    """A JSON value as a whole number: fractions cut off, digits in a string read, true and false as 1 and 0."""
    return f"case {kind} when 'VARCHAR' then case when regexp_full_match(trim({value}), '[+-]?[0-9]+') then try_cast(trim({value}) as integer) end when 'BOOLEAN' then cast({value} = 'true' as integer) else try_cast(trunc(try_cast({value} as double)) as integer) end"


def _score_columns(key: str) -> str:
    number = _whole(f"json_extract_string(v, '$.{key}.score')", f"json_type(v, '$.{key}.score')")
    words = f"json_extract_string(v, '$.{key}.justification')"
    kind = f"json_type(v, '$.{key}.justification')"
    return f"case when ({number}) between 1 and 5 then ({number}) end as {key}_score, case when ({number}) = 5 or {kind} is distinct from 'VARCHAR' then '' else trim({words}) end as {key}_justification"


def _flag_column(key: str) -> str:
    kind, word = f"json_type(v, '$.{key}')", f"json_extract_string(v, '$.{key}')"
    return f"case {kind} when 'VARCHAR' then lower(trim({word})) in ('true', '1', 'yes', 'si', 'sí') when 'BOOLEAN' then {word} = 'true' else coalesce(try_cast({word} as double) <> 0, false) end as {key}"


@_query(
    _JUDGED
    + "select strategy, file_name, relative_path, case when v is null then 'invalid_json' when json_type(v) <> 'OBJECT' then 'unexpected_type' end as parse_error, "
    + ", ".join([*map(_score_columns, judging.SCORES), *map(_flag_column, judging.FLAGS)])
    + " from js",
    ("judged",),
)
def judge_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.validated(fixture(spark, sf_dir, "judged"))


#: A judge's row as the results file has it: the note, the judge, 18 score columns, 3 flags, and what went wrong.
@_query(
    _JUDGED
    + "select file_name as filename, strategy, relative_path, 'root/' || relative_path as filepath, 'judge' as model, 'ollama' as provider, "
    + ", ".join([*map(_score_columns, judging.SCORES), *map(_flag_column, judging.FLAGS)])
    + ", case when v is null then 'invalid_json' when json_type(v) <> 'OBJECT' then 'unexpected_type' end as parse_error from js",
    ("judged",),
)
def judge_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "judged").withColumn("file_path", F.concat(F.lit("root/"), "relative_path"))
    return judging.flat_rows(rows, "judge", "ollama")


@_query(
    _JUDGED
    + "select strategy, file_name, criterion, case when n between 1 and 5 then n end as score, case when n = 5 or k is distinct from 'VARCHAR' then '' else trim(w) end as justification from (select strategy, file_name, criterion, " + _whole("json_extract_string(v, '$.' || criterion || '.score')", "json_type(v, '$.' || criterion || '.score')") + " as n, json_type(v, '$.' || criterion || '.justification') as k, json_extract_string(v, '$.' || criterion || '.justification') as w from js cross join (select unnest(['"
    + "', '".join(judging.SCORES)
    + "']) as criterion) c) q",
    ("judged",),
)
def judge_scores_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.scores_long(judging.validated(fixture(spark, sf_dir, "judged")))


@_query("""select strategy, file_name, relative_path, cast(row_number() over (partition by file_name order by strategy, relative_path) as integer) as turn from judged
where file_name not in (select file_name from judged where relative_path like 'd/1%')""", ("judged",))
def judge_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "judged").select("strategy", "file_name", "relative_path")
    return judging.pending(rows, rows.where("relative_path like 'd/1%'"))


@_query("select file_name from judged where ends_with(lower(file_name), '.txt') and not regexp_matches(lower(file_name), 'report|analysis|stats|summary|metric|log|readme')", ("judged",))
def note_filename_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.valid_note_names(fixture(spark, sf_dir, "judged").select("file_name"))


@_query(
    _PSA_ORACLE + f", g as (select doc_id, 'PSA' as label, s, e, t from n) select doc_id, label, cast(s as integer) as start, cast(e as integer) as \"end\", {_SNIPPET} as snippet from g",
    ("notes",),
)
def mention_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surroundings of quantities, cut from the normalised note by place alone."""
    notes = fixture(spark, sf_dir, "notes").select("doc_id", normalize_text(F.col("text")).alias("t"))
    places = mentions.psa_mentions(fixture(spark, sf_dir, "notes")).select("doc_id", "label", "start", "end")
    return places.join(notes, "doc_id").select("doc_id", "label", "start", "end", snippet(F.col("t"), F.col("start"), F.col("end")).alias("snippet"))


@_query(", d as (select doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as text from file_bytes) select doc_id, text from d", ("file_bytes",))
def doc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files' bytes, in UTF-8 or Latin-1, as text."""
    rows = fixture(spark, sf_dir, "file_bytes")
    content = F.when(F.col("latin"), F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return rows.select("doc_id", files.decoded(content).alias("text"))


@_query(
    """with p as (select vec_id, list_transform(embedding, lambda x: exp(cast(x as double) - cast(list_max(embedding) as double))) as e, list_position(embedding, list_max(embedding)) - 1 as best from embeddings)
select vec_id, cast(best as integer) as "index", round(1 / list_sum(e), 9) as probability from p"""
)
def token_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest class of arrays of logits, and its probability."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    best = best_class(softmax(F.col("embedding")))
    return rows.select("vec_id", best.alias("b")).select("vec_id", "b.index", F.round("b.probability", 9).alias("probability"))
