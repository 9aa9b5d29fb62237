"""Queries on scoring, term dictionaries and the review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright import fixed_values as V
from notewright.functions import phenotypes as H
from notewright.functions.text import disease_variants
from notewright.operators import dictionary as T
from notewright.operators import metrics as M
from notewright.operators import review as Q
from notewright.plans.registry import query, sql_sub, sql_trim
from notewright.plans.views import Inputs
from notewright.sources import readers
from notewright.sources.scratch import settled

# ---- scoring ---------------------------------------------------------------------------------

METHODS = {"a": "is_pred_a", "b": "is_pred_b"}
SETS = """t as (select idx, coalesce(source, 'unknown') as source, coalesce(department, 'unknown') as department, term,
    max(is_truth) as tr, max(is_pred_a) as pa, max(is_pred_b) as pb from v_eval_terms group by 1, 2, 3, 4),
  s as (select idx, source, department, 'a' as method, count(*) filter (tr = 1 and term is not null) as n_truth,
    count(*) filter (pa = 1 and term is not null) as n_pred, count(*) filter (tr = 1 and pa = 1 and term is not null) as n_hit from t group by 1, 2, 3
    union all select idx, source, department, 'b', count(*) filter (tr = 1 and term is not null),
    count(*) filter (pb = 1 and term is not null), count(*) filter (tr = 1 and pb = 1 and term is not null) from t group by 1, 2, 3),
  pr as (select *, case when n_truth = 0 and n_pred = 0 then 1.0 when n_truth = 0 or n_pred = 0 then 0.0 else n_hit / n_pred end as p,
    case when n_truth = 0 and n_pred = 0 then 1.0 when n_truth = 0 or n_pred = 0 then 0.0 else n_hit / n_truth end as r from s)"""
MACRO = """round(avg(p), 6) as precision, round(avg(r), 6) as recall,
  round(case when avg(p) + avg(r) > 0 then 2 * avg(p) * avg(r) / (avg(p) + avg(r)) else 0 end, 6) as f1, count(*) as n"""


def term_sizes(t: Inputs) -> DataFrame:
    return M.term_sets(t("v_eval_terms"), METHODS)


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "n")


def wide_samples(t: Inputs) -> DataFrame:
    """Samples as records with label and prediction lists, built from the long terms.

    A record's lists hold distinct terms, of which there are at most twenty.
    """
    term = F.concat(F.lit("t"), F.col("term").cast("string"))
    def picked(c):
        return F.collect_set(F.when(c, term))

    rows = t("v_eval_terms")
    even = F.col("term") % 2 == 0
    flags = rows.groupBy(F.col("idx").alias("index"), "source", "department").agg(
        picked((F.col("is_truth") == 1) & even).alias("pos"), picked((F.col("is_truth") == 1) & ~even).alias("neg"),
        picked(F.col("is_pred_a") == 1).alias("a"), picked(F.col("is_pred_b") == 1).alias("_b"),
    )
    none = F.lit(None).cast("array<string>")
    labels = F.struct(
        F.col("pos").alias("patient_phenotypes"), F.concat("pos", "pos").alias("family_phenotypes"),
        F.when(F.size("neg") > 0, F.col("neg")).alias("patient_phenotypes_neg"), none.alias("family_phenotypes_neg"),
    )
    nested = F.transform("_b", lambda x: F.array(F.lit("HP"), x, F.lit("zh")))
    return flags.select(
        "index", "source", "department", labels.alias("human_annotated"), F.concat("a", "a").alias("a"),
        F.concat(nested, F.array(F.array(F.lit("short")))).alias("base"),
    )


@query("a05_truth_sets", f"with {SETS} select idx as \"index\", n_truth from s where method = 'a'")
def a05(t: Inputs):
    return wide_samples(t).select("index", F.size(M.truth_set("human_annotated")).cast("bigint").alias("n_truth"))


@query("a06_prediction_sets", f"with {SETS} select idx as \"index\", case method when 'a' then 'a' else 'base' end as method, n_pred from s union all select distinct idx, 'absent', 0 from s")
def a06(t: Inputs):
    return M.sample_sets(wide_samples(t), ("a", "base", "absent")).select("index", "method", "n_pred")


@query("a07_sample_scores", f"with {SETS} select idx as \"index\", method, round(p, 6) as precision, round(r, 6) as recall from pr")
def a07(t: Inputs):
    return M.scored(term_sizes(t)).select(
        "index", "method", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall")
    )


@query("a08_macro_metrics", f"with {SETS} select method, {MACRO} from pr group by method")
def a08(t: Inputs):
    return rounded(M.metrics(term_sizes(t)), "method")


@query("a08_macro_metrics_records", f"with {SETS} select case method when 'a' then 'a' else 'base' end as method, {MACRO} from pr group by method")
def a08_records(t: Inputs):
    return rounded(M.metrics(M.sample_sets(wide_samples(t), ("a", "base"))), "method")


@query("a09_by_source", f"with {SETS} select source, method, {MACRO} from pr group by source, method")
def a09(t: Inputs):
    return rounded(M.metrics(term_sizes(t), ["source"]), "source", "method")


@query("a10_by_department", f"with {SETS} select department, method, {MACRO} from pr group by department, method")
def a10(t: Inputs):
    return rounded(M.metrics(term_sizes(t), ["department"]), "department", "method")


@query("a11_report", f"""with {SETS} select case when grouping(source) = 0 then 'source' when grouping(department) = 0 then 'department' else 'overall' end as "grouping",
  case when grouping(source) = 0 then source when grouping(department) = 0 then department end as value, method, {MACRO}
  from pr group by grouping sets ((method), (method, source), (method, department))""")
def a11(t: Inputs):
    return rounded(M.report(term_sizes(t)), "grouping", "value", "method")


@query("o02_groups_by_size", "select o_orderpriority as source, count(*) as n, min(o_orderkey) as first_position from orders group by 1")
def o02(t: Inputs):
    return M.groups_by_size(t("orders").select(F.col("o_orderpriority").alias("source"), "o_orderkey"), "source", "o_orderkey")


@query("o03_ranked_methods", f"with {SETS} select source, method, rank() over (partition by source order by f1 desc) as rank from (select source, method, {MACRO} from pr group by 1, 2) m")
def o03(t: Inputs):
    ranked = M.ranked_methods(rounded(M.metrics(term_sizes(t), ["source"]), "source", "method"), ["source"])
    return ranked.select("source", "method", F.col("rank").cast("bigint").alias("rank"))


# ---- dictionary ----------------------------------------------------------------------------------

DICTIONARY = """d as (select case when starts_with(hpo_id, 'HP:') then hpo_id else concat('HP:', hpo_id) end as hpo_id, arg_max(zh, row_no) as zh
  from v_term_dict where zh is not null group by 1)"""
DICTIONARY_LEGACY = DICTIONARY.replace("arg_max(zh, row_no)", "arg_max(coalesce(zh, 'nan'), row_no)").replace("where zh is not null ", "")


@query("s05_term_rows", """with f as (select row_no, hpo_id, zh, row_number() over (order by row_no % 2, row_no) as place from v_term_dict),
  d as (select case when starts_with(hpo_id, 'HP:') then hpo_id else concat('HP:', hpo_id) end as hpo_id, arg_max(zh, place) as zh from f where zh is not null group by 1)
  select f.place as row_no, f.hpo_id, f.zh, d.zh as last_zh from f left join d on d.hpo_id = case when starts_with(f.hpo_id, 'HP:') then f.hpo_id else concat('HP:', f.hpo_id) end""")
def s05(t: Inputs):
    """Term rows written to two CSV files, even rows first, and read by file and line; the last row of an id wins."""
    folder, rows = t.scratch("terms"), t("v_term_dict").orderBy("row_no")
    for half in (0, 1):
        named = rows.where(F.col("row_no") % 2 == half).select(F.col("hpo_id").alias(V.TERM_ID_COLUMN), F.col("zh").alias(V.TERM_NAME_COLUMN))
        named.coalesce(1).write.option("header", True).csv(f"{folder}/{half}")
    read = readers.read_terms(t.spark, f"{folder}/*")
    last = T.term_dictionary(read).withColumnRenamed("hpo_id", "_id").withColumnRenamed("zh", "last_zh")
    return read.join(last, T.term_id("hpo_id") == F.col("_id"), "left").select("row_no", "hpo_id", "zh", "last_zh")


@query("j01_term_dictionary", f"with {DICTIONARY} select hpo_id, zh from d")
def j01(t: Inputs):
    return T.term_dictionary(t("v_term_dict"))


@query("j01_term_dictionary_legacy", f"with {DICTIONARY_LEGACY} select hpo_id, zh from d")
def j01_legacy(t: Inputs):
    return T.term_dictionary(t("v_term_dict"), legacy=True)


@query("j02_translate_ids", f"with {DICTIONARY} select e.idx, e.pos, e.hpo_id, d.zh from v_extracted e join d on d.hpo_id = e.hpo_id where d.zh <> '未找到中文翻译'")
def j02(t: Inputs):
    found = T.translate_ids(t("v_extracted"), T.term_dictionary(t("v_term_dict")))
    return found.select("idx", "pos", "hpo_id", "zh")


LINES = """l as (select idx, unnest(list_zip(range(len(s) - 1), s[2:])) as z from (select idx, string_split(tagged, chr(10)) as s from v_tagged) y),
  f as (select idx, z[1] as pos, string_split(z[2], chr(9))[1] as hpo_id from l
        where trim(z[2]) <> '' and contains(z[2], chr(9)) and starts_with(z[2], 'HP:'))"""


@query("f14_tagger_lines", f"with {LINES} select idx, pos, hpo_id from f")
def f14(t: Inputs):
    return T.tagged_lines(t("v_tagged"), "tagged").withColumn("pos", F.col("pos").cast("bigint"))


@query("p18_translated_column", f"""with {DICTIONARY}, {LINES} select v.idx, coalesce(string_agg(d.zh, '|' order by f.pos), '') as clinphen
  from v_tagged v left join f on f.idx = v.idx left join d on d.hpo_id = f.hpo_id and d.zh <> '未找到中文翻译' group by v.idx""")
def p18(t: Inputs):
    found = T.translate_ids(T.tagged_lines(t("v_tagged"), "tagged"), T.term_dictionary(t("v_term_dict")))
    lists = T.collect_terms(found, "idx", "pos", "zh", "clinphen")
    return t("v_tagged").select("idx").join(lists, "idx", "left").select(
        "idx", F.coalesce(F.array_join("clinphen", "|"), F.lit("")).alias("clinphen")
    )


@query("a13_standard_terms", f"select count(distinct {sql_trim('zh')}) as n_terms from v_term_dict where zh is not null")
def a13(t: Inputs):
    return T.term_set(t("v_term_dict")).agg(F.count(F.lit(1)).alias("n_terms"))


@query("j05_validate_terms", f"""select idx, term, s.z is not null as is_standard, case when s.z is not null then term else concat('【', term, '】') end as display
  from v_entered e left join (select distinct {sql_trim('zh')} as z from v_term_dict where zh is not null) s on s.z = {sql_trim('e.term')}""")
def j05(t: Inputs):
    return T.validate_terms(t("v_entered"), T.term_set(t("v_term_dict")), spread=["idx"])


@query("j05_validate_terms_empty", "select idx, term, true as is_standard, term as display from v_entered")
def j05_empty(t: Inputs):
    no_terms = T.term_set(t("v_term_dict").where(F.col("zh") == ""))
    return T.validate_terms(t("v_entered"), no_terms, spread=["idx"])


@query("j06_containment", """select distinct d.doc_id, k.term from documents d join (select distinct text as term from benchmark) k on contains(d.text, k.term)""")
def j06(t: Inputs):
    terms = t("benchmark").select(F.col("text").alias("term")).distinct()
    return T.find_terms(t("documents"), terms, "doc_id", "text", "term")


@query("j06_containment_shuffled", """select distinct d.doc_id, k.term from documents d join (select distinct text as term from benchmark) k on contains(d.text, k.term)""")
def j06_shuffled(t: Inputs):
    """The form for dictionaries that are too large to broadcast."""
    terms = t("benchmark").select(F.col("text").alias("term")).distinct()
    return T.find_terms(t("documents"), terms, "doc_id", "text", "term", max_rows=0)


WORDS = """w as (select term, min(item_id * 1000 + pos) as n from (select item_id, z[1] as pos, z[2] as term from (
    select item_id, unnest(list_zip(range(len(s)), s)) as z from (select item_id, string_split(text, ' ') as s from benchmark) a) b) c
    where length(term) > 0 group by term)"""


def word_dictionary(t: Inputs) -> DataFrame:
    words = t("benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("pos", "term")).where(F.length("term") > 0)
    return words.groupBy("term").agg(F.min(F.col("item_id") * 1000 + F.col("pos")).alias("n"))


@query("j07_dictionary_tagger", f"with {WORDS} select d.doc_id, concat('HP:', lpad(cast(w.n as varchar), 7, '0')) as hpo_id, w.term from documents d join w on contains(d.text, w.term)")
def j07(t: Inputs):
    words = settled(word_dictionary(t).select("term", F.concat(F.lit("HP:"), F.lpad(F.col("n").cast("string"), 7, "0")).alias("hpo_id")), "words")
    found = T.find_terms(t("documents"), words, "doc_id", "text", "term")
    return T.lookup_join(found, words, ["term"], ["doc_id"]).select("doc_id", "hpo_id", "term")


@query("u02_dictionary_extractor", f"""with {WORDS} select d.doc_id, count(w.term) as n, coalesce(string_agg(w.term, '|' order by w.term), '') as terms
  from documents d left join w on contains(d.text, w.term) group by d.doc_id""")
def u02_dictionary(t: Inputs):
    tagged = T.tag_texts(t("documents"), settled(word_dictionary(t).select("term"), "words"), "doc_id", "text", "term")
    return tagged.select("doc_id", F.size("terms").cast("bigint").alias("n"), F.array_join("terms", "|").alias("terms"))


VARIANTS = f"""(select id, list_distinct(list_filter([n, case when ends_with(n, '型') then n[:-2] end, case when ends_with(n, '综合征') then n[:-4] end,
    case when ends_with(n, '综合征') then {sql_trim("replace(n, '综合征', '')")} end, case when ends_with(n, '症') then n[:-2] end,
    {sql_sub('n', r'[0-9]+型$')}], lambda v: v is not null and v <> '')) as variants from {{}})"""
HEAD_WORD = """regexp_extract(html, '<a href="/([^"]*)"', 1)"""


@query("c10_disease_variants", f"select id, array_to_string(list_sort(variants), '|') as variants from {VARIANTS.format('(select id, trim(line) as n from v_disease_raw) x')} y")
def c10(t: Inputs):
    return t("v_disease_raw").select("id", F.array_join(F.array_sort(disease_variants(F.trim("line"))), "|").alias("variants"))


@query("c11_page_relevance", f"""with v as (select id, unnest(variants) as variant from {VARIANTS.format(f"(select min(page_id) as id, concat({HEAD_WORD}, '综合征') as n from pages group by 2) x")} y)
  select p.page_id, v.id as disease_id, arg_min(v.variant, (-length(v.variant), v.variant)) as variant
  from pages p join v on contains(p.html, v.variant) group by 1, 2""")
def c11(t: Inputs):
    word = F.regexp_extract("html", '<a href="/([^"]*)"', 1)
    named = t("pages").groupBy(F.concat(word, F.lit("综合征")).alias("name")).agg(F.min("page_id").alias("disease_id"))
    diseases = named.select("disease_id", disease_variants("name").alias("variants"))
    return T.match_pages(diseases, t("pages"))


# ---- review queue ------------------------------------------------------------------------------------

FIRST = "f as (select idx, min(seq) as seq from v_submissions group by idx)"
QUEUE = "q as (select idx from v_notes where idx not in (select idx from v_submissions))"


def samples(t: Inputs) -> DataFrame:
    return t("v_notes").select(F.col("idx").alias("index"), "description")


def log(t: Inputs) -> DataFrame:
    return t("v_submissions").withColumnRenamed("idx", "index")


@query("j03_review_queue", f"with {QUEUE} select idx as \"index\" from q")
def j03(t: Inputs):
    return Q.review_queue(samples(t), log(t)).select("index")


@query("x03_difference", "select count(*) as n from (select idx from v_notes except select idx from v_submissions) d")
def x03(t: Inputs):
    return Q.review_queue(samples(t), log(t)).agg(F.count(F.lit(1)).alias("n"))


@query("j04_first_submission", f"with {FIRST} select s.seq, s.idx as \"index\", f.seq is not null as accepted from v_submissions s left join f on f.idx = s.idx and f.seq = s.seq")
def j04(t: Inputs):
    return Q.accept(log(t)).select("seq", "index", "accepted")


@query("j04_first_submission_with_log", """with l as (select idx from v_submissions where seq < 500), n as (select * from v_submissions where seq >= 500),
  f as (select idx, min(seq) as seq from n where idx not in (select idx from l) group by idx)
  select n.seq, n.idx as "index", f.seq is not null as accepted from n left join f on f.idx = n.idx and f.seq = n.seq""")
def j04_log(t: Inputs):
    rows = log(t)
    return Q.accept(rows.where(F.col("seq") >= 500), rows.where(F.col("seq") < 500)).select("seq", "index", "accepted")


@query("p08_label_defaults", """select event_id as idx, cast(case when event_id % 3 = 0 then 0 when event_id % 2 = 0 then 1 else 0 end as bigint) as n_patient, cast(0 as bigint) as n_family,
  cast(case when event_id % 3 = 0 then 0 else 1 end as bigint) as n_neg from events""")
def p08(t: Inputs):
    none = F.lit(None).cast("array<string>")
    one = F.array("event_type")
    labels = F.struct(
        F.when(F.col("event_id") % 2 == 0, one).alias("patient_phenotypes"), none.alias("family_phenotypes"),
        one.alias("patient_phenotypes_neg"), none.alias("family_phenotypes_neg"),
    )
    rows = t("events").select(F.col("event_id").alias("idx"), F.when(F.col("event_id") % 3 != 0, labels).alias("human_annotated"))
    h = F.col("human_annotated")
    return Q.prepared_samples(rows).select(
        "idx", F.size(h["patient_phenotypes"]).cast("bigint").alias("n_patient"),
        F.size(h["family_phenotypes"]).cast("bigint").alias("n_family"), F.size(h["patient_phenotypes_neg"]).cast("bigint").alias("n_neg"),
    )


@query("p09_submission_defaults", "select seq, idx as \"index\", coalesce(is_sure, true) as is_sure, cast(case when seq % 4 = 0 then 1 else 0 end as bigint) as n_terms from v_submissions")
def p09(t: Inputs):
    rows = log(t)
    for name in V.TRUTH_KEYS:
        rows = rows.withColumn(name, F.when(F.col("seq") % 4 == 0, F.array(F.lit(name))))
    out = Q.with_submission_defaults(rows)
    return out.select("seq", "index", "is_sure", F.size(V.TRUTH_KEYS[3]).cast("bigint").alias("n_terms"))


@query("f13_sure", "select seq, idx as \"index\" from v_submissions where coalesce(is_sure, true)")
def f13(t: Inputs):
    return Q.sure(log(t).withColumn("is_sure", F.coalesce("is_sure", F.lit(True)))).select("seq", "index")


@query("a12_progress", f"""with {QUEUE}, c as (select (select count(*) from v_notes) as total, (select count(distinct idx) from v_submissions) as annotated, (select count(*) from q) as remaining)
  select total, annotated, remaining, case when total > 0 then round_even(annotated / total * 100, 1) else 0 end as percentage from c""")
def a12(t: Inputs):
    return Q.progress(samples(t), log(t))


@query("a17_submitted_ids", "select count(distinct idx) as n from v_submissions")
def a17(t: Inputs):
    return Q.submitted_ids(log(t))


@query("w02_queue_neighbours", f"with {QUEUE} select idx as \"index\", coalesce(lag(idx) over (order by idx), idx) as prev, lead(idx) over (order by idx) as next from q")
def w02(t: Inputs):
    return Q.queue_neighbours(Q.review_queue(samples(t), log(t)).select("index")).select("index", "prev", "next")


@query("w02_navigation", f"""with {QUEUE}, p as (select idx, row_number() over (order by idx) as pos from q),
  r as (select event_id as request, case event_id % 3 when 0 then 'init' when 1 then 'next' else 'prev' end as action, event_id as current_id from events)
  select r.request, t.idx as target from r left join p on p.idx = r.current_id and r.current_id <> 0
  left join p t on t.pos = case r.action when 'init' then 1 when 'next' then coalesce(p.pos, 1) + 1 else greatest(coalesce(p.pos, 1) - 1, 1) end""")
def w02_navigation(t: Inputs):
    requests = t("events").select(
        F.col("event_id").alias("request"), F.col("event_id").alias("current_id"),
        F.element_at(F.lit(["init", "next", "prev"]), (F.col("event_id") % 3 + 1).cast("int")).alias("action"),
    )
    return Q.navigate(Q.review_queue(samples(t), log(t)).select("index"), requests).select("request", "target")


# ---- set operations --------------------------------------------------------------------------------------


@query("x01_union_of_parts", "select id, line from v_disease_raw where part in (1, 2, 4)")
def x01(t: Inputs):
    return readers.only_parts(t("v_disease_raw")).select("id", "line")


LISTS = """select event_id as idx, [event_type, concat('u', cast(user_id % 3 as varchar)), event_type] as a, [concat('u', cast(event_id % 3 as varchar)), null, event_type] as b from events"""


@query("x02_array_sets", f"""select idx, array_to_string(list_sort(list_distinct(list_filter(list_concat(a, b), lambda x: x is not null))), '|') as either,
  array_to_string(list_sort(list_distinct(list_intersect(a, b))), '|') as common, array_to_string(list_sort(list_distinct(a)), '|') as once from ({LISTS}) l""")
def x02(t: Inputs):
    a = F.array("event_type", F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")), "event_type")
    b = F.array(F.concat(F.lit("u"), (F.col("event_id") % 3).cast("string")), F.lit(None).cast("string"), "event_type")
    joined = lambda x: F.array_join(F.array_sort(x), "|")
    return t("events").select(
        F.col("event_id").alias("idx"), joined(H.union_lists(a, b)).alias("either"),
        joined(F.array_intersect(a, b)).alias("common"), joined(F.array_distinct(a)).alias("once"),
    )
