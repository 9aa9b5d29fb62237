"""Queries on notes, disease lists and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from notewright import fixed_values as V
from notewright.functions import deid as D
from notewright.functions import phenotypes as H
from notewright.functions import text as X
from notewright.operators import notes as N
from notewright.operators import reports as R
from notewright.operators.scaling import running_index
from notewright.plans.registry import (
    q, query, sql_disease_name, sql_drop, sql_ltrim, sql_safe_name, sql_sub, sql_trim,
)
from notewright.plans.views import Inputs
from notewright.sources import readers, writers

NAMES = ("张小", "张小明")

# ---- oracle fragments --------------------------------------------------------------------

DEPARTMENT = f"case {sql_trim('sheet')} when '产科' then 'obstetrics' when '儿科' then 'pediatrics' when '神经内科' then 'neurology' end"
SHEET_ORDER = f"case {sql_trim('sheet')} when '产科' then 1 when '儿科' then 2 when '神经内科' then 3 end"
SCENARIO = f"concat('emr-', {sql_trim('''coalesce(template, '')''')})"
DISEASE = f"case when lower({sql_trim('''coalesce(diagnosis, '')''')}) in ('', 'nan') then '' else {sql_trim('diagnosis')} end"
PATIENT = "case when length(coalesce(patient, '')) >= 12 then patient else lpad(coalesce(patient, ''), 12, '0') end"

RULES = {
    "d01": ("request_form", D.request_form, sql_drop("{}", "表格<申请表格>内容:")),
    "d02": ("newborn_header", D.newborn_header, sql_sub("{}", r"(?s)姓名[：:].+?转科时间[：:]\d{{4}}年\d{{2}}月\d{{2}}日")),
    "d03": ("name_block", D.name_block, sql_sub("{}", r"(?-s)姓名[：:].+?性别[：:][男女]年龄[：:][^\s　]+(?:科室[：:].+?床号[：:][^\s　]+)?")),
    "d04": ("phones", D.phones, sql_sub("{}", r"科室联系电话[：:][^\s　]+[\s　]*医务处联系电话[：:][^\s　]+")),
    "d05a": ("father_block", D.father_block, sql_sub("{}", r"(?s)父姓名[：:].*?(母姓名)", r"\1")),
    "d05b": ("mother_block", D.mother_block, sql_sub("{}", r"母姓名[：:][^。\n]*")),
    "d06": ("operators", D.operators, sql_sub("{}", r"(?-s)操作(?:者|医师)[：:].*?(?:。|(记录者)|$)", r"\1")),
    "d07": ("guidance", D.guidance, sql_sub("{}", r"(?-s)以上处理是在.{{0,30}}?指导下进行的[。.]?[\s　]*")),
    "d08": ("recorder", D.recorder, sql_sub("{}", r"记录者[：:][^\n]*")),
    "d09": ("physician", D.physician, sql_sub("{}", r"无?医师签字[：:][^\n]*")),
    "d10": ("signature_label", D.signature_label, sql_sub("{}", r"(?:申请|会诊)医师签名[：:][\s　]*")),
    "d12": ("double_commas", D.double_commas, sql_sub("{}", r"[，,][\s　]*[，,]", "，")),
    "d13": ("wide_gaps", D.wide_gaps, sql_sub("{}", r"[ 　]{{2,}}", " ")),
    "d14": ("blank_lines", D.blank_lines, sql_trim(sql_sub("{}", r"\n{{3,}}", "\n\n"))),
}


def rule_sql(x: str, keys: list[str]) -> str:
    for k in keys:
        x = RULES[k][2].format(x)
    return x


BEFORE_NAMES = [k for k in RULES if k < "d11"]
AFTER_NAMES = [k for k in RULES if k > "d11"]
DROP_NAMES = "replace(replace({}, '张小明', ''), '张小', '')"

def deid_sql(x: str) -> str:
    clean = rule_sql(DROP_NAMES.format(rule_sql(x, BEFORE_NAMES)), AFTER_NAMES)
    return f"case when {sql_trim(f'coalesce({x}, {q(str())})')} = '' then '' else {clean} end"


CLEAN = sql_drop("description", *V.BOILERPLATE)
STAMP = "^" + V.STAMP
UNSTAMPED = f"case when regexp_matches(d, {q(STAMP)}) then {sql_ltrim(f'regexp_replace(d, {q(STAMP)}, {q(str())})')} else d end"
CANDIDATES = f"""
  c as (select idx, patient_id, department, scenario, {UNSTAMPED} as description
        from (select *, {CLEAN} as d from v_notes) z),
  k as (select * from c where length(description) between 10 and 200 and not contains(description, '拆线前伤口勿沾水。'))"""
KEPT = CANDIDATES + """,
  kept as (select * from (select *, row_number() over (partition by patient_id order by idx) as rn from k) w
           where scenario <> 'emr-日常病程记录' or rn = 1)"""
NOTES = KEPT


def full_notes(t: Inputs):
    return t("v_notes_full")


# ---- sources and record standardisation -------------------------------------------------------


def sheets(t: Inputs):
    """The raw notes written as one extract per sheet and read back with their running number."""
    folder = t.scratch("sheets")
    writers.write_sheets(t("v_raw_notes"), folder)
    return readers.read_sheets(t.spark, folder, numbered=True)


@query("s04_sheets", f"select row_no, {DEPARTMENT} as department, content from v_raw_notes")
def s04(t: Inputs):
    return sheets(t).select("row_no", N.department_key("sheet").alias("department"), "content")


@query("s07_disease_lines", f"select id, {sql_disease_name('line')} as name from v_disease_raw where {sql_trim('line')} <> ''")
def s07(t: Inputs):
    return readers.parse_diseases(t("v_disease_raw")).select("id", "name")


@query("s09_parts", "select id, part, line from v_disease_raw where part in (1, 2, 4)")
def s09(t: Inputs):
    return readers.only_parts(t("v_disease_raw")).select("id", "part", "line")


@query("s10_pages", "select page_id, url, html from pages")
def s10(t: Inputs):
    return readers.read_pages(t.spark, f"{t.folder}/pages.parquet")


STANDARD = f"""select row_no, {deid_sql('content')} as description, {DEPARTMENT} as department, {SCENARIO} as scenario,
  {PATIENT} as patient_id, coalesce(admission, '') as admission_date, {DISEASE} as diseases,
  row_number() over (order by {SHEET_ORDER}, row_no) - 1 as idx from v_raw_notes"""


@query("p01_standard_notes", f"select description, department, scenario, patient_id, admission_date, diseases, idx from ({STANDARD}) s")
def p01(t: Inputs):
    raw = sheets(t).withColumn("names", F.lit([*NAMES, " 张小 ", "张"]))
    return N.standardise_notes(raw, "names").select(
        "description", "department", "scenario", "patient_id", "admission_date",
        F.array_join("disease", "|").alias("diseases"), F.col("index").alias("idx"),
    )


@query("p02_patient_id", f"select row_no, {PATIENT} as patient_id from v_raw_notes")
def p02(t: Inputs):
    return t("v_raw_notes").select("row_no", N.patient_key("patient").alias("patient_id"))


@query("p03_scenario", f"select row_no, {SCENARIO} as scenario from v_raw_notes")
def p03(t: Inputs):
    return t("v_raw_notes").select("row_no", N.scenario("template").alias("scenario"))


@query("p04_diagnosis_list", f"select row_no, {DISEASE} as diseases, cast(case when {DISEASE} = '' then 0 else 1 end as bigint) as n from v_raw_notes")
def p04(t: Inputs):
    return t("v_raw_notes").select("row_no", N.diagnosis_list("diagnosis").alias("d")).select(
        "row_no", F.array_join("d", "|").alias("diseases"), F.size("d").cast("bigint").alias("n")
    )


@query("p05_department", f"select row_no, {DEPARTMENT} as department from v_raw_notes")
def p05(t: Inputs):
    return t("v_raw_notes").select("row_no", N.department_key("sheet").alias("department"))


@query("p06_missing_values", "select row_no, coalesce(content, '') as content, coalesce(template, '') as template, coalesce(admission, '') as admission from v_raw_notes")
def p06(t: Inputs):
    return t("v_raw_notes").select("row_no", *[X.missing_to(c).alias(c) for c in ("content", "template", "admission")])


@query("p07_running_index", f"select row_no, {DEPARTMENT} as department, row_number() over (order by {SHEET_ORDER}, row_no) - 1 as idx from v_raw_notes")
def p07(t: Inputs):
    return sheets(t).select("row_no", N.department_key("sheet").alias("department"), F.col("index").alias("idx"))


@query("p07_running_index_by_position", f"select row_no, {DEPARTMENT} as department, row_number() over (order by {SHEET_ORDER}, row_no) - 1 as idx from v_raw_notes")
def p07_by_position(t: Inputs):
    """Numbers of rows that no file holds in order."""
    placed = t("v_raw_notes").select("row_no", N.department_key("sheet").alias("department"), N.department_order("sheet").alias("_s"))
    return running_index(placed, "row_no", ["_s"], "idx").drop("_s")


@query("p12_public_fields", """select doc, row_no, concat_ws('|', c3) as fields from v_table_rows""")
def p12(t: Inputs):
    fields = F.array(F.col("doc").cast("string"), "c0", "c12", "c12", "c3")
    return t("v_table_rows").select("doc", "row_no", F.array_join(R.public_fields(fields), "|").alias("fields"))


@query("p14_preview", """select doc_id, case when length(text) > 200 then concat(substring(text, 1, 200), '...') else text end as short,
  case when length(text) > 500 then concat(substring(text, 1, 500), '...') else text end as medium, substring(text, 1, 150) as cut from documents""")
def p14(t: Inputs):
    return t("documents").select(
        "doc_id", X.preview("text", V.LENGTHS["preview"]).alias("short"), X.preview("text", V.LENGTHS["body_cut"]).alias("medium"),
        X.preview("text", V.LENGTHS["result_title"], "").alias("cut"),
    )


@query("p15_disease_name", f"select id, {sql_disease_name('line')} as name from v_disease_raw")
def p15(t: Inputs):
    return t("v_disease_raw").select("id", X.disease_name("line").alias("name"))


@query("p16_safe_name", f"""select id, {sql_safe_name('line')} as name from v_disease_raw
  union all select page_id as id, {sql_safe_name('url')} as name from pages
  union all select doc_id as id, {sql_safe_name('text')} as name from documents""")
def p16(t: Inputs):
    texts = (
        t("v_disease_raw").select("id", "line")
        .unionByName(t("pages").select(F.col("page_id").alias("id"), F.col("url").alias("line")))
        .unionByName(t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("line")))
    )
    return texts.select("id", X.safe_name("line").alias("name"))


@query("p17_output_names", f"""select id, concat(cast(id as varchar), '_', {sql_safe_name(sql_disease_name('line'))}) as folder,
  concat({sql_safe_name(sql_disease_name('line'))}, '_', {sql_safe_name("replace(line, ' ', '_')")}, '.txt') as file1,
  concat(cast(id as varchar), '_', {sql_safe_name(sql_disease_name('line'))}, '_', {sql_safe_name('line')}, '.txt') as file2
  from v_disease_raw""")
def p17(t: Inputs):
    named = t("v_disease_raw").withColumn("name", X.disease_name("line"))
    return named.select(
        "id", X.disease_key("id", "name").alias("folder"), X.article_file("name", "line").alias("file1"),
        X.article_file("name", "line", "id").alias("file2"),
    )


# ---- de-identification -----------------------------------------------------------------------------


@query("d00_blank_to_empty", f"select row_no, case when {sql_trim('''coalesce(content, '')''')} = '' then '' else content end as content from v_raw_notes")
def d00(t: Inputs):
    return t("v_raw_notes").select("row_no", D.blank_to_empty("content").alias("content"))


def _register_rule(key: str) -> None:
    name, rule, sql = RULES[key]

    @query(f"{key}_{name}", f"select idx, {sql.format('description')} as description from v_notes_full")
    def build(t: Inputs):
        return full_notes(t).select("idx", rule("description").alias("description"))


for _key in RULES:
    _register_rule(_key)


@query("d11_person_names", f"select idx, {DROP_NAMES.format(rule_sql('description', BEFORE_NAMES))} as description from v_notes_full")
def d11(t: Inputs):
    names = F.lit([*NAMES, " 张小 ", "张"])
    return full_notes(t).select("idx", D.drop_names(D.structured("description"), names).alias("description"))


@query("d99_deidentify", f"select row_no, {deid_sql('content')} as content from v_raw_notes")
def d99(t: Inputs):
    return t("v_raw_notes").select("row_no", D.deidentify("content", F.lit(list(NAMES))).alias("content"))


@query("o04_names_by_length", f"""select idx, array_to_string(list_transform(list_sort(list_distinct(list_filter(list_transform(
    regexp_extract_all(description, '[刘徐傅杨吴李王张][一-龥]{{1,2}}'), lambda n: {sql_trim('n')}), lambda n: length(n) >= 2)
  )), lambda n: n), '|') as names_by_text,
  cast(len(list_distinct(regexp_extract_all(description, '[刘徐傅杨吴李王张][一-龥]{{1,2}}'))) as bigint) as n from v_notes_full""".replace("{{", "{").replace("}}", "}"))
def o04(t: Inputs):
    names = D.usable_names(F.regexp_extract_all("description", F.lit("[刘徐傅杨吴李王张][一-龥]{1,2}"), F.lit(0)))
    n = F.col("n")
    falling = F.forall(F.sequence(F.lit(1), F.size(n) - 1), lambda i: F.length(F.get(n, i - 1)) >= F.length(F.get(n, i)))
    in_order = F.when((F.size(n) < 2) | falling, F.array_join(F.array_sort(n), "|"))
    return full_notes(t).select("idx", names.alias("n")).select(
        "idx", in_order.alias("names_by_text"), F.size("n").cast("bigint").alias("n")
    )


@query("u01_name_extractor", f"""select idx, array_to_string(list_sort(list_distinct(regexp_extract_all({rule_sql('description', BEFORE_NAMES)}, '张小明?'))), '|') as names from v_notes_full""")
def u01(t: Inputs):
    def load():
        import re

        find = re.compile("张小明?")
        return lambda texts: [find.findall(x) for x in texts]

    return full_notes(t).select("idx", F.array_join(D.person_names(D.structured("description"), load), "|").alias("names"))


# ---- filters, sampling and counts ---------------------------------------------------------------------


@query("f01_boilerplate", f"select idx, {CLEAN} as description from v_notes_full")
def f01(t: Inputs):
    return full_notes(t).select("idx", N.strip_boilerplate("description").alias("description"))


@query("f02_leading_stamp", f"select idx, {UNSTAMPED} as description from (select idx, description as d from v_notes_full) s")
def f02(t: Inputs):
    return full_notes(t).select("idx", N.strip_stamp("description").alias("description"))


@query("f02_leading_stamp_legacy", f"""select idx, case when regexp_matches(d, {q(STAMP)})
  then {sql_trim(f"substring(regexp_replace(d, {q(STAMP)}, ''), 1, 1)")} else d end as description
  from (select idx, description as d from v_notes_full) s""")
def f02_legacy(t: Inputs):
    return full_notes(t).select("idx", N.strip_stamp("description", legacy=True).alias("description"))


@query("f03_length_band", "select idx, description from v_notes_full where length(description) between 10 and 200")
def f03(t: Inputs):
    return full_notes(t).where(N.in_length_band("description")).select("idx", "description")


@query("f04_stop_phrase", "select idx, description from v_notes where not contains(description, '拆线前伤口勿沾水。')")
def f04(t: Inputs):
    return t("v_notes").where(~N.has_stop_phrase("description")).select("idx", "description")


@query("f05_once_per_patient", """select idx, patient_id, scenario from (select *, row_number() over (partition by patient_id order by idx) as rn from v_notes) w
  where scenario <> 'emr-日常病程记录' or rn = 1""")
def f05(t: Inputs):
    return N.once_per_patient(t("v_notes"), "idx").select("idx", "patient_id", "scenario")


@query("f06_sub_k", f"with {NOTES} select idx, patient_id, department, scenario, description from kept")
def f06(t: Inputs):
    return N.sub_k(t("v_notes"), order="idx").select("idx", "patient_id", "department", "scenario", "description")


@query("w01_daily_notes", f"with {NOTES} select idx, patient_id from kept where scenario = 'emr-日常病程记录'")
def w01(t: Inputs):
    return N.sub_k(t("v_notes"), order="idx").where(F.col("scenario") == V.DAILY_SCENARIO).select("idx", "patient_id")


@query("f07_unlabelled", "select idx, response from v_answers where response is null")
def f07(t: Inputs):
    return N.unlabelled(t("v_answers"), "response")


@query("f08_from_row", "select id, line from v_disease_raw where id > 100")
def f08(t: Inputs):
    return N.from_row(t("v_disease_raw"), 100, "id").select("id", "line")


def _register_count(key: str, column: str) -> None:
    @query(key, f"with {NOTES} select {column}, count(*) as n from kept group by {column}")
    def build(t: Inputs):
        return N.count_by(N.sub_k(t("v_notes"), order="idx"), column)


_register_count("a02_by_department", "department")
_register_count("a03_by_scenario", "scenario")
_register_count("a04_by_patient", "patient_id")


@query("a01_disease_list", f"select distinct {DISEASE} as disease from v_raw_notes where {DISEASE} <> ''")
def a01(t: Inputs):
    return N.disease_list(t("v_raw_notes").select(N.diagnosis_list("diagnosis").alias("disease")))


@query("o01_sorted_names", f"select distinct {sql_disease_name('line')} as disease from v_disease_raw")
def o01(t: Inputs):
    return N.disease_list(t("v_disease_raw").select(F.array(X.disease_name("line")).alias("disease")))


@query("k04_sorted_list", f"""select disease as value, row_number() over (order by encode(disease)) as line_no from (
  select distinct {sql_disease_name('line')} as disease from v_disease_raw) s where disease <> ''""")
def k04(t: Inputs):
    """What the written list holds, with its line numbers as read back from the part files."""
    folder = t.scratch("sorted_list")
    names = t("v_disease_raw").select(F.array(X.disease_name("line")).alias("disease"))
    writers.write_sorted_list(N.disease_list(names).where(F.col("disease") != ""), "disease", folder)
    lines = readers.numbered_lines(t.spark, folder).withColumn("file", F.element_at(F.split("file", "/"), -1))
    per_file = lines.groupBy("file").agg(F.max("line_no").alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    before = per_file.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return lines.join(before, "file").select(
        F.col("line").alias("value"), (F.col("line_no") + F.col("before")).alias("line_no")
    )


# ---- reports -----------------------------------------------------------------------------------------------

SPLIT = """list_filter(string_split(translate(phenotypes, '；。，,、', ';;;;;'), ';'), lambda x: x <> '')"""
NONE = f"(phenotypes is null or {sql_trim('phenotypes')} in ('正常无表型', '正常表型', '-'))"
LABELLED = f"""l as (select report_id, row_no, unnest(list_zip(range(len(p)), p)) as z
  from (select *, case when {NONE} then [] else {SPLIT} end as p from v_report_rows) s),
  x as (select report_id, row_no, z[1] as pos, z[2] as phenotype from l)"""


@query("h01_split_phenotypes", f"select report_id, row_no, case when {NONE} then '' else array_to_string({SPLIT}, '|') end as items, cast(case when {NONE} then 0 else len({SPLIT}) end as bigint) as n from v_report_rows")
def h01(t: Inputs):
    return t("v_report_rows").select("report_id", "row_no", H.split_phenotypes("phenotypes").alias("p")).select(
        "report_id", "row_no", F.array_join("p", "|").alias("items"), F.size("p").cast("bigint").alias("n")
    )


@query("h02_no_phenotype", f"select report_id, row_no, cast(case when {NONE} then 0 else len({SPLIT}) end as bigint) as n from v_report_rows")
def h02(t: Inputs):
    return t("v_report_rows").select("report_id", "row_no", F.size(H.split_phenotypes("phenotypes")).cast("bigint").alias("n"))


@query("h04_patient_rows", f"with {LABELLED} select report_id, row_no, case when row_no = 0 then 'patient' else 'family' end as role, pos, phenotype from x")
def h04(t: Inputs):
    return R.phenotype_rows(t("v_report_rows")).withColumn("pos", F.col("pos").cast("bigint"))


@query("h05_family", f"with {LABELLED} select distinct report_id, phenotype from x where row_no > 0")
def h05(t: Inputs):
    return R.family_phenotypes(t("v_report_rows"))


@query("h06_all", f"with {LABELLED} select distinct report_id, phenotype from x")
def h06(t: Inputs):
    return R.all_phenotypes(t("v_report_rows"))


@query("h07_patient_specific", f"""with {LABELLED} select report_id, 'patient' as labels, pos, phenotype from x where row_no = 0
  union all select distinct report_id, 'family', cast(null as bigint), phenotype from x where row_no > 0
  union all select distinct report_id, 'all', cast(null as bigint), phenotype from x""")
def h07(t: Inputs):
    return R.patient_specific(t("v_report_rows")).withColumn("pos", F.col("pos").cast("bigint"))


@query("p13_nested_labels", f"""with {LABELLED} select row_number() over (order by r.report_id) - 1 as idx, r.report_id, coalesce(p, '') as patient, coalesce(f, '') as family, coalesce(a, '') as everyone
  from (select distinct report_id from v_report_rows) r
  left join (select report_id, string_agg(phenotype, '|' order by pos) as p from x where row_no = 0 group by 1) a1 on a1.report_id = r.report_id
  left join (select report_id, string_agg(phenotype, '|' order by encode(phenotype)) as f from (select distinct report_id, phenotype from x where row_no > 0) d group by 1) a2 on a2.report_id = r.report_id
  left join (select report_id, string_agg(phenotype, '|' order by encode(phenotype)) as a from (select distinct report_id, phenotype from x) d group by 1) a3 on a3.report_id = r.report_id""")
def p13(t: Inputs):
    """Reports as records; the view puts exactly five rows into each."""
    row = F.struct("row_no", F.array(F.lit("name"), F.col("phenotypes")).alias("fields"))
    records = t("v_report_rows").groupBy("report_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["fields"]).alias("results"))
    h = F.col("human_annotated")
    return R.label_records(records, "report_id").select(
        F.col("index").alias("idx"), "report_id", F.array_join(h["patient_phenotypes"], "|").alias("patient"),
        F.array_join(F.array_sort(h["family_phenotypes"]), "|").alias("family"), F.array_join(F.array_sort(h["all_phenotypes"]), "|").alias("everyone"),
    )


def cells(t: Inputs):
    return t("v_cells").select("doc", F.col("tab").alias("table"), F.col("row_no").alias("row"), F.col("col_no").alias("col"), "cell")


BODY = """d as (select doc, case when max(case when tab = 1 then row_no end) + 1 = 4 then 2 else 1 end as btab from v_cells group by doc),
  b as (select c.*, case when btab = 2 then 2 else 6 end as lo, btab from v_cells c join d on c.doc = d.doc and c.tab = d.btab),
  s as (select doc, min(row_no) as stop from b where col_no = 0 and row_no >= lo and starts_with(cell, '分析结果：') group by doc),
  body as (select b.doc, b.tab, b.row_no, b.col_no, b.cell from b left join s on s.doc = b.doc
           where b.row_no >= lo and b.row_no < least(coalesce(stop, 100), 100)),
  kept as (select * from (select *, lag(cell) over (partition by doc, tab, row_no order by col_no) as prev from body) z where prev is null or prev <> cell)"""


@query("t01_description", "select doc, cell as description from v_cells where tab = 1 and row_no = 3 and col_no = 0")
def t01(t: Inputs):
    return R.description_cells(cells(t))


@query("t02_layout", f"with {BODY} select distinct doc, btab as body_table from d")
def t02(t: Inputs):
    return R.body_layout(cells(t)).select("doc", F.col("table").alias("body_table"))


@query("t03_body_rows", f"with {BODY} select doc, tab, row_no, col_no, cell from body")
def t03(t: Inputs):
    return R.body_cells(cells(t)).select("doc", F.col("table").alias("tab"), F.col("row").alias("row_no"), F.col("col").alias("col_no"), "cell")


@query("t04_collapsed_cells", """select doc, tab, row_no, col_no, cell from (select *, lag(cell) over (partition by doc, tab, row_no order by col_no) as prev from v_cells) z
  where prev is null or prev <> cell""")
def t04(t: Inputs):
    kept = R.collapse_repeats(cells(t), ("doc", "table", "row"))
    return kept.select("doc", F.col("table").alias("tab"), F.col("row").alias("row_no"), F.col("col").alias("col_no"), "cell")


@query("t05_report_rows", f"with {BODY} select doc, row_no, concat(cast(doc as varchar), '|', string_agg(cell, '|' order by col_no)) as fields from kept group by doc, row_no")
def t05(t: Inputs):
    rows = R.report_rows(R.body_cells(cells(t)))
    return rows.select("doc", F.col("row").alias("row_no"), F.array_join("fields", "|").alias("fields"))


@query("t06_accepted_text", """select doc, tab, row_no, string_agg(cell, '' order by col_no) as cell from v_cells
  where (doc + col_no) % 5 <> 0 group by doc, tab, row_no""")
def t06(t: Inputs):
    """The columns of a table row read as runs of one cell, every fifth of them deleted."""
    runs = t("v_cells").select(
        "doc", "tab", "row_no", F.floor(F.col("col_no") / 2).alias("para"), F.col("col_no").alias("run"), F.col("cell").alias("text"),
        ((F.col("doc") + F.col("col_no")) % 5 == 0).alias("is_deleted"),
    )
    return R.accepted_text(runs, ("doc", "tab", "row_no"))
