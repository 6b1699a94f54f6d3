"""The clinical operators: truth tables, properties, and small row-at-a-time models of the order-dependent ones."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from notegrain.functions import numeric, text
from notegrain.operators import dedup, generation, inline_tags, judging, matching, mentions, services, standoff, tokens
from notegrain.sources import files
from notegrain.streaming.notes import arriving_notes, write_results


def column(spark, values, expression):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").select("k", expression(F.col("v")).alias("out")).collect()
    return [r.out for r in sorted(rows, key=lambda r: r.k)]


def test_numbers(spark):
    raw = ["4,5", "1.234,5", "4.500", "1 234", "234.5", "1.234.567", "12\n345", "020 345", "1,234.5"]
    assert column(spark, raw, numeric.to_double) == [4.5, 1234.5, 4.5, 1234.0, 234.5, None, None, 20345.0, 1234.5]
    assert column(spark, ["ng / ML", "NGML", "ng/l", "ng l", "x"], numeric.psa_unit) == ["ng/mL", "ng/mL", "ng/L", "ng/L", "x"]
    logits = spark.createDataFrame([([1.0, 3.0, 3.0, 700.0, 700.0],), ([0.0],)], "x array<float>").select(numeric.softmax(F.col("x")).alias("p"))
    best = logits.select(numeric.best_class(F.col("p")).alias("b"), "p").collect()
    assert [(r.b["index"], r.b.probability, round(sum(r.p), 9)) for r in best] == [(3, 0.5, 1.0), (0, 1.0, 1.0)]
    assert column(spark, ["I", "iv", "X", "IIII", "", "11", "7", "1"], numeric.gleason_total) == [1, 4, 10, None, None, None, 7, None]


def test_texts(spark):
    assert column(spark, ["﻿ a\t b\r\nc\r\n\n\n\nd \x1f", None], text.normalize_text) == ["a b\nc\n\nd", ""]
    assert column(spark, ["Age", "1 x", "á  b", "--", "__a__", ""], text.sanitize_tag) == ["Age", "X_1_x", "b", "--", "a", "ENTIDAD"]
    assert column(spark, ["a<b&c>"], text.escape) == ["a&lt;b&amp;c&gt;"]
    assert column(spark, ["&amp;lt; &lt;"], text.unescape) == ["&lt; <"]
    found = column(spark, ["a12😀3 45", "", "x"], lambda c: text.find_all(c, r"\d+"))
    assert [[(m.start, m.end, m.text) for m in row] for row in found] == [[(1, 3, "12"), (4, 5, "3"), (6, 8, "45")], [], []]


def notes(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")


def test_psa(spark):
    rows = mentions.psa_mentions(notes(spark, "PSA 4,5 ng/mL y 1,234.5 ng/L; 2020 345 ng ml; 7 ng/dL; 1.234.567 ng/mL", None)).orderBy("start").collect()
    assert [(r.value_raw, r.value_num, r.value_ng_ml) for r in rows] == [("4,5", 4.5, 4.5), ("234.5", 234.5, 0.2345), ("020 345", 20345.0, 20345.0), ("1.234.567", None, None)]
    assert [r.match_index for r in rows] == [1, 2, 3, 4]


def test_gleason(spark):
    rows = mentions.gleason_mentions(notes(spark, "Gleason 3+4=8", "Gleason (4+3)", "Gleason score 7", "Gleason7, score de gleason7", "Gleason vía", "gleason 3+4 = ")).orderBy("doc_id", "start").collect()
    got = [(r.doc_id, r.pattern_type, r.primary, r.secondary, r.total, r.gleason_raw) for r in rows]
    assert got[0] == (0, "sum_total", 3, 4, 8, "Gleason 3+4=8")
    assert got[1] == (1, "total_then_sum", 4, 3, 7, "Gleason (4+3)")
    assert got[2] == (2, "score_only", None, None, None, "Gleason ")
    assert (3, "score_only", None, None, 7, "score de gleason7") in got
    assert got[-1][1:] == ("sum_total", 3, 4, 7, "gleason 3+4 =")


def untag_model(tagged):
    import re

    plain, spans, opened, bad, lost, i = "", [], {}, 0, 0, 0
    while i < len(tagged):
        m = re.compile(r"<(/?)([A-Za-z0-9_:-]+)>").match(tagged, i)
        if m:
            if not m[1]:
                opened.setdefault(m[2], []).append(len(plain))
            elif opened.get(m[2]):
                start = opened[m[2]].pop()
                if len(plain) > start:
                    spans.append((m[2], start, len(plain), plain[start:]))
            else:
                lost += 1
            i = m.end()
            continue
        bad += tagged[i] == "<"
        e = re.compile("&(amp|lt|gt);").match(tagged, i)
        plain += {"amp": "&", "lt": "<", "gt": ">"}[e[1]] if e else tagged[i]
        i = e.end() if e else i + 1
    return plain, spans, (bad, lost, sum(map(len, opened.values())))


def test_untag_and_tag(spark):
    rnd = random.Random(1)
    parts = ["<A>", "</A>", "<B>", "</B>", "x", "yé", " ", "<", "&amp;", "&lt;", "😀", "<C:1>", "</C:1>"]
    docs = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(25))) for _ in range(120)] + ["", None]
    df = spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "doc_id long, tagged string")
    model = [untag_model(d or "") for d in docs]
    plain = {r.doc_id: r.plain for r in inline_tags.plain_text(df).collect()}
    assert [plain[k] for k in range(len(docs))] == [m[0] for m in model]
    spans = inline_tags.spans(df)
    assert Counter(tuple(r) for r in spans.collect()) == Counter((k, *s) for k, m in enumerate(model) for s in m[1])
    stats = {r.doc_id: (r.malformed_tag_starts, r.unmatched_closing_tags, r.unclosed_open_tags) for r in inline_tags.stats(df).collect()}
    assert [stats[k] for k in range(len(docs))] == [m[2] for m in model]
    tagged = inline_tags.tag(inline_tags.plain_text(df).withColumnRenamed("plain", "text"), spans)
    assert {r.doc_id: r.plain for r in inline_tags.plain_text(tagged).collect()} == plain
    one = inline_tags.tag(notes(spark, "no fiebre & tos"), spark.createDataFrame([(0, "Neg_cue", 0, 2), (0, "Negated", 0, 9), (0, "Far", 40, 50)], "doc_id long, label string, start int, end int"))
    assert one.first().tagged == "<Negated><Neg_cue>no</Neg_cue> fiebre</Negated> &amp; tos"


def test_standoff(spark):
    lines = ["T1\tPSA 0 4\tPSA  X\textra", "T2\tA 0 4;6 9\tq", "T3\tA 5 5\tq", "R1\tA 0 1\tq", "T4\tA x 4\tq", "T5\tB 3 9", " T6\tB 3 9\tz "]
    df = spark.createDataFrame([("f", line) for line in lines], "file_name string, line string")
    assert [tuple(r)[1:] for r in standoff.parse_lines(df).orderBy("entity_id").collect()] == [("T1", "PSA", 0, 4, "psa x extra"), ("T6", "B", 3, 9, "z")]
    assert Counter((r.label, r.start, r.end) for r in standoff.parse_spans(df).collect()) == Counter([("PSA", 0, 4), ("A", 0, 4), ("A", 6, 9), ("B", 3, 9)])
    entities = spark.createDataFrame([("f", "a b", 7, 9, "x\ny"), ("f", "c", 0, 2, "q")], "file_name string, label string, start int, end int, text string")
    assert standoff.ann_documents(standoff.ann_lines(entities)).first().content == "T1\tc 0 2\tq\nT2\ta_b 7 9\tx y\n"


ENTITY = "file_name string, entity_id string, label string, start int, end int, text string"


def entities(rnd, n):
    return [(rnd.choice("fg"), f"T{k}", rnd.choice("AB"), s, s + rnd.randrange(1, 5), "t") for k in range(n) for s in [rnd.randrange(8)]]


def greedy_model(silver, predicted, files):
    order = lambda e: (e[3], e[4], e[2], e[5], e[1])
    out = Counter()
    for f in files:
        s, p = (sorted((e for e in side if e[0] == f), key=order) for side in (silver, predicted))
        found = []
        for i, a in enumerate(s):
            for j, b in enumerate(p):
                if a[2] == b[2] and (a[3] == b[3] or a[4] == b[4]):
                    kind = 0 if a[3:5] == b[3:5] else 1 if a[3] == b[3] else 2
                    found.append((kind, abs(a[3] - b[3]) + abs(a[4] - b[4]), abs(a[4] - a[3] - b[4] + b[3]), i, j))
        left, right = set(range(len(s))), set(range(len(p)))
        for kind, _, _, i, j in sorted(found):
            if i in left and j in right:
                left.discard(i)
                right.discard(j)
                out["TP", s[i][1], p[j][1], ("exact", "same_start", "same_end")[kind]] += 1
        out.update(("FN", s[i][1], None, "unmatched_silver") for i in left)
        out.update(("FP", None, p[j][1], "unmatched_pred") for j in right)
    return out


def test_matching_is_the_greedy_assignment(spark):
    rnd = random.Random(2)
    silver, predicted = entities(rnd, 60), entities(rnd, 70)
    s, p = spark.createDataFrame(silver, ENTITY), spark.createDataFrame(predicted, ENTITY)
    compared = matching.comparisons(s, p)
    assert Counter((r.status, r.silver_entity_id, r.pred_entity_id, r.match_type) for r in compared.collect()) == greedy_model(silver, predicted, "fg")
    files_ = names(spark, "f", "g")
    total = matching.global_metrics(compared, files_).first()
    by_file, by_label = matching.file_metrics(compared, files_).collect(), matching.label_metrics(compared).collect()
    for grain in (by_file, by_label):
        assert all(sum(r[c] for r in grain) == total[c] for c in ("tp", "fp", "fn"))
    assert total.tp + total.fn == total.silver_entities == 60 and total.tp + total.fp == total.pred_entities == 70
    assert matching.global_metrics(compared.limit(0), files_.limit(0)).first()[:4] == (0, 0, 0, 0)
    ordered = [(r.file_name, r.status, r.silver_start, r.pred_start) for r in matching.in_report_order(compared).collect()]
    assert [r[:2] for r in ordered] == sorted((r[:2] for r in ordered), key=lambda r: (r[0], ("TP", "FN", "FP").index(r[1])))


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "file_name string")


def test_files_with_empty_annotations_count(spark):
    """By definition: files of both folders are compared, whatever they hold; a file in one folder only is not."""
    rnd = random.Random(5)
    silver = [e for e in entities(rnd, 30) if e[0] == "f"] + [("b", "T1", "A", 0, 3, "t"), ("b", "T2", "A", 5, 9, "t"), ("one", "T1", "A", 0, 1, "t")]
    predicted = [e for e in entities(rnd, 30) if e[0] == "f"] + [("c", "T1", "B", 0, 3, "t"), ("two", "T1", "A", 0, 1, "t")]
    common = matching.paired_files(names(spark, "f", "b", "c", "none", "one"), names(spark, "none", "c", "b", "f", "two"))
    s, p = spark.createDataFrame(silver, ENTITY), spark.createDataFrame(predicted, ENTITY)
    compared = matching.comparisons(s, p, common)
    assert Counter((r.status, r.silver_entity_id, r.pred_entity_id, r.match_type) for r in compared.collect()) == greedy_model(silver, predicted, ["f", "b", "c", "none"])
    rows = {r.file_name: (r.tp, r.fp, r.fn, r.recall) for r in matching.file_metrics(compared, common).collect()}
    assert rows["b"] == (0, 0, 2, 0.0) and rows["c"] == (0, 1, 0, 0.0) and rows["none"] == (0, 0, 0, 0.0) and len(rows) == 4
    total = matching.global_metrics(compared, common).first()
    assert total.evaluated_files == 4 and (total.tp, total.fp, total.fn) == tuple(sum(r[k] for r in rows.values()) for k in range(3))
    grains = {(r.grain, r.file_name, r.label): (r.tp, r.fp, r.fn) for r in matching.metrics_all_grains(compared, common).collect()}
    assert grains["global", None, None] == (total.tp, total.fp, total.fn) and grains["file", "none", None] == (0, 0, 0) and not [k for k in grains if k[0] == "label" and k[2] is None]
    # two files, one without a prediction: recall is 1 of 3, not 1 of 1
    s = spark.createDataFrame([("a", "T1", "A", 0, 3, "t"), ("b", "T1", "A", 0, 3, "t"), ("b", "T2", "A", 4, 6, "t")], ENTITY)
    both = names(spark, "a", "b")
    found = matching.global_metrics(matching.comparisons(s, s.where("file_name = 'a'"), both), both).first()
    assert (found.fn, found.recall) == (2, round(1 / 3, 9))


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_plans_move_little(no_broadcast, tmp_path):
    """Metrics move each entity once, by file, and nothing else but file names and sums; no text goes with tags or tokens."""
    spark = no_broadcast
    table = lambda name, schema: (spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}"), spark.read.parquet(f"{tmp_path}/{name}"))[1]
    s, p, f = table("s", ENTITY), table("p", ENTITY), table("f", "file_name string")
    plan = planned(matching.global_metrics(matching.comparisons(s, p, f), f))
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "Exchange SinglePartition" in line]
    assert plan.count("FileScan parquet [file_name#") == 5 and plan.count(",entity_id#") >= 2 and len(exchanges) == 6
    # the two sides' entities, the list of files (planned three times, read again at run time), the totals
    assert sum("hashpartitioning(file_name#" in e and "," not in e.split("(file_name#")[1].split(",")[0] for e in exchanges) == 5 and plan.count("SinglePartition") == 1
    assert len([line for line in plan.splitlines() if "FileScan" in line and "entity_id" in line]) == 2 and "BroadcastNestedLoop" not in plan
    tagged = table("t", "doc_id long, tagged string")
    assert "Exchange" not in planned(inline_tags.spans(tagged)) and "Exchange" not in planned(inline_tags.stats(tagged))
    cut, texts = table("k", "doc_id long, model string, window_id int, idx int, st int, en int, label string, score double"), table("x", "doc_id long, text string")
    spans = tokens.bio_spans(cut, texts, True)
    tree = spans._jdf.queryExecution().sparkPlan().toString()
    assert planned(spans).count("Exchange hashpartitioning") == 2 and "RepartitionByExpression" not in tree


def test_many_tags_and_matches_take_little_time(spark):
    many = "".join(f"<A>x{k}&lt; " if k % 3 else "</A>y" for k in range(24_000))
    df = spark.createDataFrame([(0, many)], "doc_id long, tagged string")
    inline_tags.spans(df.limit(0)).collect()
    began = time.perf_counter()
    found = inline_tags.spans(df).collect()
    stats = inline_tags.stats(df).first()
    seconds = time.perf_counter() - began
    model = untag_model(many)
    assert Counter((r.label, r.start, r.end, r.text) for r in found) == Counter(model[1]) and tuple(stats)[1:] == model[2]
    assert seconds < 15
    numbers = spark.createDataFrame([(0, "7 ng/mL, " * 8000)], "doc_id long, text string")
    began = time.perf_counter()
    places = [r.start for r in mentions.psa_mentions(numbers).collect()]
    assert sorted(places) == [9 * k for k in range(8000)] and time.perf_counter() - began < 15


def span_label_model(mentions_):
    kept = []
    for e in sorted(mentions_, key=lambda m: (m[3], m[1], m[2])):  # in order of arrival
        hit = next((k for k in kept if k[0] == e[0] and (k[1] == e[1] or k[2] == e[2])), None)
        if hit is None:
            kept.append(e)
        elif e[2] - e[1] > hit[2] - hit[1]:
            kept.remove(hit)
            kept.append(e)
    return Counter(k[:3] for k in kept)


def test_dedup(spark):
    rnd = random.Random(3)
    rows = [("A" if rnd.random() < 0.5 else "B", s, s + rnd.randrange(1, 6), k) for k in range(80) for s in [rnd.randrange(20)]]
    df = spark.createDataFrame([("f", a, b, c, "t", d) for a, b, c, d in rows], "file_name string, label string, start int, end int, text string, arrival long")
    assert Counter((r.label, r.start, r.end) for r in dedup.by_span_and_label(df, "file_name").collect()) == span_label_model(rows)
    once = dedup.exact(df, "file_name")
    assert once.count() == len({r[:3] for r in rows}) == dedup.exact(once, "file_name").count()
    merged = dedup.merged(spark.createDataFrame([("f",), ("none",)], "file_name string"), [df, df])
    assert merged.where("file_name = 'none' and label is null").count() == 1 and merged.count() == once.count() + 1


TOKEN_TEXTS = ["ab, cd-ef gh. ij kl mn/op (qr) st", "uno dos  tres; cuatro", "x" * 40]


def token_rows():
    """Windows of tokens with gaps, overlaps, tokens without length and special ones."""
    rnd = random.Random(12)
    out = []
    for doc_id, text_ in enumerate(TOKEN_TEXTS):
        for window in range(40):
            at = 0
            for idx in range(rnd.randrange(1, 12)):
                st = at + rnd.choice((0, 0, 1, 1, 2, 3))
                en = st + rnd.randrange(0, 4)
                if en > len(text_):
                    break
                label = rnd.choice(("O", "B-X", "I-X", "I-X", "Y", "E-X", "B-Y"))
                out.append((doc_id, "m", window, idx, *((0, 0) if rnd.random() < 0.1 else (st, en)), label, rnd.randrange(1, 64) / 64))
                at = max(at, en)
    return out


def span_model(rows, average):
    import re

    out, current, key = Counter(), None, None

    def close():
        nonlocal current
        if current:
            kind, st, en, scores = current
            cleaned = re.sub(r"\s+", " ", TOKEN_TEXTS[key[0]][st:en]).strip()
            if cleaned:
                out[(*key, kind, st, en, round(sum(scores) / len(scores) if average else min(scores), 9), cleaned)] += 1
        current = None

    for doc_id, _, window, idx, st, en, label, score in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        if key != (doc_id, window):
            close()
            key = (doc_id, window)
        if (st, en) == (0, 0):
            if idx:
                close()
            continue
        if en <= st:
            continue
        if label == "O":
            close()
            continue
        prefix, _, kind = label.rpartition("-")
        if current and current[0] == kind:
            gap = TOKEN_TEXTS[doc_id][current[2] : st]
            if st == current[2] or (prefix or "B") in "BI" and (st < current[2] or re.fullmatch(r"[\s\-/,;:.()]+", gap)):
                current[2] = max(current[2], en)
                current[3].append(score)
                continue
        close()
        current = [kind, st, en, [score]]
    close()
    return out


def test_chunks_and_spans(spark):
    rows = tokens.char_chunks(notes(spark, "x" * 25, "", None, "y" * 10), 10, 2).orderBy("doc_id", "chunk").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 0, 10), (0, 1, 8, 18), (0, 2, 16, 25), (1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 0, 10)]
    words = "dolor abdominal, fuerte y tos"
    df = spark.createDataFrame(token_rows(), "doc_id long, model string, window_id int, idx int, st int, en int, label string, score double")
    texts = notes(spark, *TOKEN_TEXTS)
    for average in (True, False):
        spans = tokens.bio_spans(df, texts, average).collect()
        assert Counter((r.doc_id, r.window_id, r.label, r.start, r.end, round(r.score, 9), r.text) for r in spans) == span_model(token_rows(), average)
    cut = [(0, 0, 0, "O", 0.0), (1, 0, 5, "B-S", 0.9), (2, 6, 15, "I-S", 0.7), (3, 17, 23, "B-S", 0.8), (4, 24, 25, "O", 0.9), (5, 26, 29, "B-S", 0.5)]
    df = spark.createDataFrame([(0, "m", 0, *t) for t in cut], "doc_id long, model string, window_id int, idx int, st int, en int, label string, score double")
    spans = tokens.bio_spans(df, notes(spark, words), average=False, low=0.6, high=1.0).collect()
    assert [(r.label, r.start, r.end, r.score, r.text) for r in spans] == [("S", 0, 23, 0.7, "dolor abdominal, fuerte")]


def test_generation(spark):
    long_ = "nota " * 30
    values = ["---INICIO--- a ---FIN--- b", f"<THINK>x</think>{long_}", "<think>---INICIO---a</think>---INICIO---b---FIN---", "short", ""]
    pick = lambda p: column(spark, values, lambda c: generation.resolve_note(c, F.lit("---INICIO---t---FIN---"), p))
    assert [r.strategy for r in pick("openai")] == ["delimited_content", "full_content_stripped", "delimited_content", "no_output", "no_output"]
    assert [r.strategy for r in pick("claude")] == ["delimited_content", "full_content", "delimited_content", "no_output", "no_output"]
    assert [r.note for r in pick("ollama")][3:] == ["t", "t"]
    cases = spark.createDataFrame([("a",), ("b",)], "file_name string")
    done = spark.createDataFrame([("a", 0)], "file_name string, bytes int")
    assert generation.pending(cases, done, "ollama").count() == 2 and generation.pending(cases, done, "claude").count() == 1
    assert {r.file_name: r.status for r in generation.pending(cases, done).collect()} == {"a": "skipped_existing", "b": "pending"}


def test_judging(spark):
    scores = ", ".join(f'"{k}": {{"score": {v}, "justification": " j "}}' for k, v in zip(judging.SCORES, ("4.7", "true", '"4"', '"4.7"', "6", "5", "1", "2", "3"), strict=True))
    raw = [f'ok {{{scores}, "error_seguridad_grave": "Sí", "human_generated": 2}} end', "[1]", "nope", '{"precisa": 3, "human_generated": "maybe"}']
    df = spark.createDataFrame([("s", f"n{k}.txt", f"p{k}", r) for k, r in enumerate(raw)], "strategy string, file_name string, relative_path string, raw_text string")
    rows = sorted(judging.validated(df).collect(), key=lambda r: r.file_name)
    assert [rows[0][f"{k}_score"] for k in judging.SCORES] == [4, 1, 4, None, None, 5, 1, 2, 3]
    assert rows[0].comprensible_justification == "" and rows[0].concisa_justification == "j"
    assert (rows[0].error_seguridad_grave, rows[0].human_generated, rows[3].human_generated) == (True, True, False)
    assert [r.parse_error for r in rows] == [None, "unexpected_type", "invalid_json", None]
    assert judging.complete(judging.validated(df)).count() == 0
    names = spark.createDataFrame([("urologia.txt",), ("Nota.TXT",), ("x.csv",), ("metrics.txt",)], "file_name string")
    assert [r.file_name for r in judging.valid_note_names(names).collect()] == ["Nota.TXT"]
    assert column(spark, ["4.7", "nan", "", None, "6", "1"], judging.csv_score_valid) == [True, False, False, False, False, True]


class FakeClient:
    def __init__(self, config):
        self.calls = 0

    def send(self, body):
        self.calls += 1
        prompt = body["messages"][-1]["content"]
        if "boom" in prompt or ("flaky" in prompt and self.calls == 1):
            raise TimeoutError("slow")
        return {"message": {"content": f"<{prompt}>"}}


class FakeClassifier:
    def windows(self, text_):
        return [(k, text_[k : k + 4]) for k in range(0, len(text_), 4)]

    def classify(self, windows):
        if len(windows) > 2:
            raise RuntimeError("memory")
        return [[(at, at + len(w), "B-X", 0.9)] for at, w in windows]


@pytest.fixture
def config():
    return files.ServiceConfig("ollama", "m", pause_s=0.0)


def test_services(spark, config):
    cases = spark.createDataFrame([("a", "flaky"), ("b", "boom")], "file_name string, case string").coalesce(1)
    rows = {r.file_name: r for r in services.call(cases, config, FakeClient, "sys", "{CASE_TEXT}").collect()}
    assert rows["a"].content == "<flaky>" and rows["a"].attempts == 2 and rows["a"].error is None
    assert rows["b"].attempts == 3 and rows["b"].error == "TimeoutError: slow"
    chunks = spark.createDataFrame([(1, 0, 100, "abcdefghijklmnop")], "doc_id long, chunk int, start int, text string")
    out = services.classify_chunks(chunks, {"m": FakeClassifier}).orderBy("st").collect()
    assert [(r.st, r.en) for r in out] == [(100, 104), (104, 108), (108, 112), (112, 116)]
    assert services.answer_text("openai", {"output": [{"type": "message", "content": [{"text": " x"}, {"text": "y "}]}, {"type": "reasoning", "content": [{"text": "z"}]}]}) == ("x\ny", "")
    assert services.answer_text("claude", {"content": [{"type": "thinking", "text": "no"}, {"type": "text", "text": " a "}, {"type": "text", "text": "b"}]}) == ("a\nb", "")
    assert services.answer_text("ollama", {"message": {"content": " c ", "thinking": "t"}}) == ("c", "t") and services.answer_text("ollama", {"message": None, "response": "r "}) == ("r", "")
    assert services.answer_text("zai", {"choices": [{"message": {"content": " d"}}]}) == ("d", "")
    assert services.diagnostics("openai", {"status": "incomplete", "incomplete_details": {"reason": "max"}, "usage": {"output_tokens": 0}}) == "status=incomplete incomplete_reason=max output_tokens=0 reasoning_tokens=unknown"
    assert services.diagnostics("claude", {"usage": {"input_tokens": 3, "cache_read_input_tokens": 1}}) == "stop_reason=unknown input_tokens=3 output_tokens=unknown cache_read=1"
    body = services.request_body(config, "s", "p")
    assert body["messages"][1] == {"role": "user", "content": "p"} and "think" not in body and "format" not in body
    assert [services.longest_window(*a) for a in ((514, 10**30, 0), (None, 512, 128), (None, None), (600, 512, 0))] == [514, 128, 512, 512]


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "in" / "E2E").mkdir(parents=True)
    (tmp_path / "in" / "E2E" / "b.TXT").write_bytes("mañana PSA 4 ng/mL\r\n".encode("latin-1"))
    (tmp_path / "in" / "a.txt").write_text("Gleason 3+3", encoding="utf-8")
    (tmp_path / "in" / "a.ann").write_text("T1\tX 0 3\tGle\n", encoding="utf-8")
    (tmp_path / "in" / "log.txt").write_text("x", encoding="utf-8")
    folder = str(tmp_path / "in")
    found = {r.file_name: (r.patient_id, r.text) for r in files.read_notes(spark, folder).collect()}
    assert found["b.TXT"] == (0, "mañana PSA 4 ng/mL\n") and found["a.txt"][0] == 1
    assert [(r.strategy, r.file_name, r.relative_path) for r in files.discover_notes(spark, folder).collect()] == [("E2E", "b.TXT", "E2E/b.TXT"), ("in", "a.txt", "a.txt")]
    odd = tmp_path / "notes (v2) a+b"
    (odd / "E2E").mkdir(parents=True)
    (odd / "E2E" / "c.txt").write_text("x", encoding="utf-8")
    (odd / "done").mkdir()
    (odd / "done" / "d.txt").write_text("x", encoding="utf-8")
    (odd / "done2").mkdir()
    (odd / "done2" / "e.txt").write_text("x", encoding="utf-8")
    assert [(r.strategy, r.relative_path) for r in files.discover_notes(spark, str(odd), str(odd / "done")).collect()] == [("E2E", "E2E/c.txt"), ("done2", "done2/e.txt")]
    assert column(spark, ["a/b.c.TXT", ".hidden", "x"], lambda c: files.output_path(c, "out")) == ["out/a/b.c.txt", "out/.hidden.txt", "out/x.txt"]
    many = spark.createDataFrame([(f"p{k:03d}",) for k in range(100)], "file_path string").repartition(7)
    assert {r.file_path: r.patient_id for r in files.numbered(many).collect()} == {f"p{k:03d}": k for k in range(100)} and files.numbered(many.limit(0)).count() == 0
    assert [r.stem for r in files.pairs(spark, folder).collect()] == ["a"]
    assert standoff.parse_lines(files.ann_file_lines(spark, folder)).count() == 1
    assert column(spark, ["p.tagged", "patient", "x"], files.restored_name) == ["p", "patien", "x"]
    target = str(tmp_path / "out")
    write_results(arriving_notes(spark, folder), mentions.gleason_mentions, target, str(tmp_path / "check")).awaitTermination(60)
    assert spark.read.parquet(target).count() == 1
    assert files.tri_state("Sí") is True and files.tri_state("x") is None and files.json_options('{"a": 1}') == {"a": 1}
